"""Names that overwrite nothing against a procedural version, the file sink with failing tasks, versions of any form."""

from __future__ import annotations

import os
import random
import subprocess
import sys
import textwrap
import threading

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lathework.functions import formats, paths
from lathework.operators import batch, naming, release
from lathework.plans import file_queries, image_job
from lathework.sources import feed, file_sink, intake
from lathework.sources.stash import finished, stash

SF = "/root/testdata/sf0.001"


def first_free(base, ext, taken):
    for k in range(10_000):
        name = (f"{base}-{k}" if k else base) + (f".{ext}" if ext else "")
        if name not in taken:
            return name
    return None


def by_hand(rows, there):
    """(planned, final) of rows (dir, base, ext, out_ext, kept) in order."""
    taken = {}
    for d, b, e in there:
        taken.setdefault(d, set()).add(b + (f".{e}" if e else ""))
    planned = []
    for d, b, _, out, _ in rows:
        planned.append(first_free(b, out, taken.setdefault(d, set())))
        taken[d].add(planned[-1])
    final = list(planned)
    for k, (d, b, own, _, kept) in enumerate(rows):
        if kept and planned[k]:
            taken[d].discard(planned[k])
            final[k] = first_free(b, own, taken[d])
            taken[d].add(final[k])
    return list(zip(planned, final, strict=True))


def test_fallback_query(spark):
    rows, there = file_queries.guarded_rows(spark, SF)
    rows = rows.orderBy("idx").collect()
    want = by_hand([(r["out_dir"], r["base"], r["ext"], r["out_ext"], r["kept_original"]) for r in rows], [tuple(r) for r in there.collect()])
    out = file_queries.fallback_names(spark, SF).orderBy("idx").collect()
    assert [(r["planned"], r["out_name"]) for r in out] == want
    assert len({(r["out_dir"], r["out_name"]) for r in out}) == len(out) and any(a != b for a, b in want)


@pytest.mark.parametrize("seed", range(3))
def test_names_at_random(spark, seed):
    rng = random.Random(seed)
    bases = ["a", "a-1", "a-1-1", "a-2", "a-2-1", "b", "b-1", "c", "d.x", "a-10", "a-12345", "", "-1"]
    rows = [(rng.choice(["/", "/x"]), rng.choice(bases), rng.choice(["png", "gif", ""]), rng.choice(["png", "gif"]), rng.random() < 0.6) for _ in range(150)]
    there = [(rng.choice(["/", "/x"]), rng.choice(bases), rng.choice(["png", "gif"])) for _ in range(12)]
    df = spark.createDataFrame([(k // 2, *r, k, "mine") for k, r in enumerate(rows)], "idx long, out_dir string, base string, ext string, out_ext string, kept_original boolean, k long, _name string").repartition(1).sortWithinPartitions("k")
    existing = spark.createDataFrame(there, "out_dir string, base string, out_ext string")
    planned = naming.assign_names(df, existing=existing).withColumn("planned", F.col("out_name"))  # every idx comes twice
    got = {r["k"]: (r["planned"], r["out_name"]) for r in naming.fallback_names(planned.repartition(1).sortWithinPartitions("k"), existing=existing).where("_name = 'mine'").collect()}
    assert [got[k] for k in range(len(rows))] == by_hand(rows, there)


def test_names_of_odd_rows(spark):
    names = ["_idx", "_num", "_row", "_dir", "_base", "_ext", "_root", "_name", "_there", "_rank", "num", "row", "dir", "own", "planned", "name", "taken", "final", "stem", "step"]
    df = spark.createDataFrame([(None, "/x", "a", "png", "gif", True), (None, "/x", "a", "png", "gif", None), (1, None, None, "png", None, True), (1, "/x", "a", "gif", "gif", True)], "idx long, out_dir string, base string, ext string, out_ext string, kept_original boolean").withColumns({n: F.lit("mine") for n in names})
    out = naming.fallback_names(naming.assign_names(df))
    rows = out.collect()
    assert len(rows) == 4 and all(r[n] == "mine" for r in rows for n in names) and out.columns == [*df.columns, "out_name"]
    assert len({(r["out_dir"], r["out_name"]) for r in rows}) == 4 and None not in {r["out_name"] for r in rows}
    assert naming.fallback_names(naming.assign_names(df.limit(0))).count() == 0


def test_guard_overwrites_nothing(spark):
    """With b-compressed.gif on disk and b.gif kept, the original goes to b-compressed-1.gif; a file in the root stays there."""
    gif = bytes.fromhex("474946383961") + (100).to_bytes(2, "little") * 2
    files = spark.createDataFrame([(0, "/in/b.gif", 50, gif), (1, "/b.GIF", 50, gif), (2, "/in/NOTES.TXT", 5, b"hello")], "idx long, path string, length long, content binary")
    there = spark.createDataFrame([("/in", "b-compressed", "gif")], "out_dir string, base string, out_ext string")
    plan = image_job.plan_images(files, image_job.COMPRESS_LOSSLESS, existing=there)
    out = image_job.finish_images(plan, spark.createDataFrame([(0, 60), (1, 60)], "idx long, new_bytes long"), image_job.COMPRESS_LOSSLESS, existing=there).orderBy("idx").collect()
    assert [r["output"] for r in out] == ["/in/b-compressed-1.gif", "/b-compressed.gif", None]
    assert out[2]["failure"] == "“TXT” files aren't supported here."
    assert [r[0] for r in spark.createDataFrame([("/a.png",), ("a.png",), ("/x/a.png",), (None,)], "p string").select(paths.parent(F.col("p"))).collect()] == ["/", "", "/x", None]


# Versions.
def test_version_order(spark):
    tags = ["v1.9.0", "v1.10.0", "v2.0.0", "v2.0.0-rc1", "v2.0.0-rc10", "v2.0.0-rc2", "v2.0.0.1", "v10", "v9.99999999999999999999999", "v9.100000000000000000000000", "v1", "v0", "v1a"]
    want = ["v0", "v1", "v1.9.0", "v1.10.0", "v1a", "v2.0.0", "v2.0.0-rc1", "v2.0.0-rc2", "v2.0.0-rc10", "v2.0.0.1", "v9.99999999999999999999999", "v9.100000000000000000000000", "v10"]
    df = spark.createDataFrame([(t,) for t in tags], "tag string")
    assert [r[0] for r in df.orderBy(release.version_order(F.col("tag"))).collect()] == want
    assert release.latest_tag(df).collect()[0][0] == "v10"
    assert release.latest_tag(spark.createDataFrame([("v2.0.0",), ("v2.0.0-rc1",)], "tag string")).collect()[0][0] == "v2.0.0-rc1"
    assert release.latest_tag(spark.createDataFrame([("x1",), (None,), ("va",)], "tag string")).count() == 0


def test_next_version_keeps_columns(spark):
    df = spark.createDataFrame([("mine", "mine", "1.2.3")], "last string, kind string, tag string")
    none = F.lit(None).cast("string")
    assert release.with_next_version(df, F.col("tag"), none, none, none).collect()[0].asDict() == {"last": "mine", "kind": "mine", "tag": "1.2.3", "version": "1.2.4", "error": None}


def test_fixed_tables(spark):
    assert {(r["format"], r["can_encode"]) for r in formats.format_table(spark).collect()} == {("png", True), ("jpeg", True), ("heic", False), ("tiff", True), ("webp", False)}
    assert [r["format"] for r in formats.lossy_choices(spark).collect()] == ["jpeg"]
    assert [r["id"] for r in image_job.tools_in(spark, "Images").collect()] == ["heic-convert", "compress", "resize"]
    assert [tuple(r) for r in intake.path_list(spark, ["/a/x.png", None, "/b y/ä.jpg", "/a/x.png"]).collect()] == [(0, "/a/x.png"), (1, "/b y/ä.jpg"), (2, "/a/x.png")]


# The sink.
def tree(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, files in os.walk(folder) for f in files}


def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content binary, staging string").repartition(3)


def test_sink(spark, tmp_path):
    where = f"{tmp_path}/out"
    df = rows_of(spark, ("a/x.bin", b"1", "mine"), ("y", b"", "mine"), (None, b"2", "mine"), ("failed", None, "mine"), ("ä b/c", b"\0" * 3_000_000, "mine"))
    file_sink.write_files(df, where, F.col("path"), F.col("content"))
    want = {"a/x.bin": b"1", "y": b"", "ä b/c": b"\0" * 3_000_000}
    assert tree(where) == want and not [d for d in os.listdir(where) if d.startswith(".")]
    file_sink.write_files(df.limit(0), where, F.col("path"), F.col("content"))
    for bad in ([("new", b"n", ""), ("a/x.bin", b"other", "")], [("new", b"n", ""), ("twice", b"1", ""), ("twice", b"2", "")], [("new", b"n", ""), ("../out of it", b"1", "")]):
        with pytest.raises(Exception):
            file_sink.write_files(rows_of(spark, *bad), where, F.col("path"), F.col("content"))
        assert tree(where) == want and not [d for d in os.listdir(where) if d.startswith(".")]
    assert not (tmp_path / "out of it").exists()
    with pytest.raises(Exception):
        df.select("path", "content").write.format(file_sink.NAME).mode("overwrite").save(where)
    assert tree(where) == want


def most_tasks(spark, act):
    """Tasks of the widest stage that a function starts."""
    sc, group = spark.sparkContext, f"tasks of {act}"
    sc.setJobGroup(group, group)
    act()
    sc.setLocalProperty("spark.jobGroup.id", None)
    track = sc.statusTracker()
    stages = [track.getStageInfo(k) for job in track.getJobIdsForGroup(group) for k in track.getJobInfo(job).stageIds]
    return max(x.numTasks for x in stages if x)


def test_many_files_and_folders_have_many_tasks(spark, tmp_path):
    where, one = f"{tmp_path}/out", spark.range(0, 9000, 1, 1)
    name = F.concat((F.col("id") % 40).cast("string"), F.lit("/"), F.col("id").cast("string"))
    assert most_tasks(spark, lambda: file_sink.write_files(one, where, name, F.lit(b""))) >= 3
    assert sum(len(names) for _, _, names in os.walk(where)) == 9000 and len(os.listdir(where)) == 40
    folders = one.select(F.concat(F.lit(f"{where}/"), (F.col("id") % 42).cast("string")).alias("out_dir"))
    assert most_tasks(spark, lambda: intake.existing_names(folders).collect()) == 42
    assert intake.existing_names(folders).count() == 9000


def test_files_are_read_as_spark_reads_them(spark, tmp_path):
    for name in ("a/x.bin", "a/b/ü y", "top", "_hidden/x", ".h", "a/_no", "a/_k=1/x", "big"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode() * (400_000 if name == "big" else 1))
    (tmp_path / "none").mkdir()
    want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    for where in (str(tmp_path), f"file://{tmp_path}/", f"file:{tmp_path}"):
        got = intake.read_files(spark, where)
        assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert intake.read_files(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "none" / "empty").write_bytes(b"")
    assert [(r["length"], r["content"]) for r in intake.read_files(spark, str(tmp_path / "none")).collect()] == [(0, b"")]
    (tmp_path / "none" / "empty").unlink()
    assert sorted(map(tuple, intake.read_files(spark, str(tmp_path), content=False).collect())) == sorted(map(tuple, want.drop("content").collect()))
    assert [r["length"] for r in intake.read_files(spark, str(tmp_path), "*.bin").collect()] == [7] and intake.read_files(spark, f"{tmp_path}/top").count() == 1


def test_read_files_are_dealt_by_their_number(spark, tmp_path):
    """Spark's reader has a task for 32 files and their whole list in the driver."""
    file_sink.write_files(spark.range(300), str(tmp_path), F.concat(F.lit("d/"), F.col("id")), F.lit(b"x"))
    assert most_tasks(spark, lambda: intake.read_files(spark, str(tmp_path)).where("content = X'78'").collect()) <= 4
    assert intake.read_files(spark, str(tmp_path)).where("content = X'78'").count() == 300


def test_tasks_that_name_files_may_run_again(tmp_path):
    root = str(tmp_path)
    attempt, n = file_sink.stage(root, ".s", iter([("a/b", b"1"), (None, b"2"), ("c", b""), ("d", None)]))
    other, _ = file_sink.stage(root, ".s", iter([("e", b""), ("c", b"3")]))
    for _ in range(2):
        file_sink.name_all(root, attempt)
    with pytest.raises(FileExistsError):
        file_sink.name_all(root, other)
    file_sink.take_back(root, other)
    file_sink.sweep(root, ".s")
    assert n == 2 and tree(tmp_path) == {"a/b": b"1", "c": b""}


FAILING = """
    import sys
    sys.path.insert(0, {root!r})
    from pyspark import TaskContext
    from pyspark.sql import SparkSession, functions as F
    from lathework.sources import file_sink
    spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").getOrCreate()

    @F.udf("binary")
    def content(k):
        if k == 77 and TaskContext.get().attemptNumber() < {times}:
            raise ValueError("not yet")
        return str(k).encode()

    file_sink.write_files(spark.range(100, numPartitions=2), {where!r}, F.concat(F.lit("f"), F.col("id")), content("id"))
"""


@pytest.mark.parametrize("times", [2, 9])
def test_sink_with_a_task_that_fails(tmp_path, times):
    """Twice, and then it works; or for good, and then no file is left."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    where = f"{tmp_path}/out"
    os.makedirs(where)
    (tmp_path / "out" / "keep").write_bytes(b"old")
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(FAILING.format(root=root, where=where, times=times))], capture_output=True, timeout=120, check=False)
    assert (done.returncode == 0) == (times == 2), done.stderr[-2000:]
    want = {f"f{k}": str(k).encode() for k in range(100)} if times == 2 else {}
    assert tree(where) == {"keep": b"old", **want} and not [d for d in os.listdir(where) if d.startswith(".")]


# Batches that are broken off, and their progress.
def test_ledger(spark, tmp_path):
    """The run breaks off at row 50; what ended tasks have done is not done again."""
    log, folder = tmp_path / "log", f"{tmp_path}/ledger"
    log.mkdir()
    df = spark.range(64).select(F.col("id").alias("idx"), F.concat(F.lit("f"), F.col("id")).alias("path")).repartitionByRange(8, "idx")

    def job(row, log=str(log)):
        if row["idx"] == 50 and row["attempt"] == 1:
            raise SystemExit("worker lost")
        with open(f"{log}/{row['idx']}", "a") as f:
            f.write("x")
        if row["idx"] == 3 and row["attempt"] < 3:
            raise batch.JobError("notAPDF", "bad")
        return row["path"], None

    assert batch.ledger(spark, folder) is None
    with pytest.raises(Exception):
        batch.run_recorded(df, job, folder)
    ended = {r["idx"] for r in batch.ledger(spark, folder).collect()} if batch.ledger(spark, folder) is not None else set()
    ran = {int(f.name) for f in log.iterdir()}
    assert ended <= ran and 50 not in ended
    second = batch.run_recorded(df, job, folder).collect()
    assert {r["idx"] for r in second} == set(range(64)) and [(r["idx"], r["error_code"]) for r in second if r["failure"]] == [(3, "notAPDF")]
    times = {int(f.name): len(f.read_text()) for f in log.iterdir()}
    assert all(times[k] == 1 for k in ended if k != 3)
    third = {r["idx"]: (r["failure"], r["attempt"], r["runs"]) for r in batch.run_recorded(df, job, folder).collect()}
    assert third[3][0] is None and third[3][1] == 3 and {len(f.read_text()) for f in log.iterdir() if int(f.name) in ended - {3}} == {1}
    assert sum(1 for f in log.iterdir() if len(f.read_text()) > times[int(f.name)]) == 1  # only row 3 ran again
    assert batch.run_recorded(df, job, folder).count() == 64


PROGRESS = """
    import sys
    sys.path.insert(0, {root!r})
    from pyspark import TaskContext
    from pyspark.sql import SparkSession, functions as F
    from lathework.operators import batch
    spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "10").getOrCreate()

    def job(row):
        if row["idx"] == 77 and TaskContext.get().attemptNumber() == 0:
            raise SystemExit("lost")
        return "x", None

    df = spark.range(100).select(F.col("id").alias("idx"), F.lit("p").alias("path")).repartition(4)
    progress = batch.Progress(spark, 100)
    out = batch.run_jobs(df, job, step=progress.step)
    assert out.count() == 100 and progress.done == 100, progress.done
    assert len(out.collect()) == 100 and progress.done == 100, progress.done
"""


def test_progress_counts_retried_tasks_once():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(PROGRESS.format(root=root))], capture_output=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr[-2000:]


def test_stashes_of_other_threads_stay(spark):
    made, inside, go = [], threading.Event(), threading.Event()

    def other():
        inside.wait(60)
        made.append(stash(spark.range(5).toDF("x")))
        go.set()

    thread = threading.Thread(target=other)
    thread.start()

    def stage():
        inside.set()
        go.wait(60)
        return stash(spark.range(3).toDF("x"))

    assert finished(stage).count() == 3
    thread.join()
    assert made[0].count() == 5


def test_first_of_each_with_null_orders(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 2, 2), ("b", None, 3)], "k string, idx long, v int")
    assert sorted((r["k"], r["idx"], r["v"]) for r in intake.first_of_each(df, F.col("k")).collect()) == [("a", 2, 2), ("b", None, 3)]


def png(width, height):
    return bytes.fromhex("89504E470D0A1A0A0000000D49484452") + width.to_bytes(4, "big") + height.to_bytes(4, "big")


def test_plan_looks_into_the_output_folders(spark, tmp_path):
    for name in ("a.png", "a-1.png", "b", "c.jpg"):
        (tmp_path / name).write_bytes(png(4, 4))
    (tmp_path / "d.png").mkdir()
    rows = [(0, "/in/a.png", 24, png(9, 9)), (1, "/in/b.png", 24, png(9, 9)), (2, "/in/c.png", 24, png(9, 9)), (3, "/in/d.png", 24, png(9, 9)), (4, "/other/a.png", 24, png(9, 9))]
    files = spark.createDataFrame(rows, "idx long, path string, length long, content binary")
    options = image_job.Options(folder=str(tmp_path))
    want = ["a-2.png", "b.png", "c.png", "d-1.png", "a-3.png"]
    assert [r["out_name"] for r in image_job.plan_images(files, options, look=True).orderBy("idx").collect()] == want
    there = image_job.files_there(files, options)
    assert [r["out_name"] for r in image_job.plan_images(files, options, existing=there).orderBy("idx").collect()] == want
    missing = image_job.Options(folder=str(tmp_path / "none"))
    assert image_job.files_there(files, missing).count() == 0
    assert image_job.files_there(files.limit(0), options).count() == 0


def test_existing_names_of_odd_folders(spark, tmp_path):
    (tmp_path / ".profile").write_text("")
    (tmp_path / "x.tar.gz").write_text("")
    (tmp_path / "Ü ber.PNG").write_text("")
    folders = spark.createDataFrame([(str(tmp_path),), (str(tmp_path),), (None,), ("",), (f"{tmp_path}/none",), ("file://" + str(tmp_path),)], "out_dir string")
    found = [tuple(r) for r in intake.existing_names(folders).orderBy("out_dir", "base").collect()]
    names = [(".profile", ""), ("x.tar", "gz"), ("Ü ber", "PNG")]
    assert found == [(d, *n) for d in (str(tmp_path), "file://" + str(tmp_path)) for n in names]


def feed_file(folder, name, items):
    body = "".join(f"<item><title>{t}</title>" + (f"<sparkle:shortVersionString>{v}</sparkle:shortVersionString>" if v else "") + f'<enclosure url="{u}" length="1"/></item>' for t, v, u in items)
    (folder / name).write_text(f'<rss xmlns:sparkle="urn:x"><channel>{body}</channel></rss>')


def test_feed_polls(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    known = lambda df: {(r["title"], r["version"], r["url"]) for r in df.collect()}
    assert feed.known_releases(spark, state).count() == 0
    feed_file(folder, "one.xml", [("a", "1.0", "u1"), ("b", "1.1", "u2"), ("no version", None, "u3")])
    first = {("a", "1.0", "u1"), ("b", "1.1", "u2"), ("no version", None, "u3")}
    assert known(feed.poll_feed(spark, str(folder), state)) == first
    assert known(feed.poll_feed(spark, str(folder), state)) == first  # nothing new
    polls = sorted(p.name for p in (tmp_path / "state" / "entries").glob("poll=*"))
    assert polls == ["poll=0"]
    feed_file(folder, "two.xml", [("b again", "1.1", "u4"), ("c", "1.2", "u5")])
    second = {("a", "1.0", "u1"), ("b again", "1.1", "u4"), ("no version", None, "u3"), ("c", "1.2", "u5")}
    assert known(feed.poll_feed(spark, str(folder), state)) == second
    (folder / "one.xml").unlink()  # an old feed that goes takes nothing along
    assert known(feed.poll_feed(spark, str(folder), state)) == second
    feed_file(folder, "three.xml", [])
    assert known(feed.poll_feed(spark, str(folder), state)) == second


def test_a_poll_of_many_files_has_few_tasks(spark, tmp_path):
    folder, jobs = tmp_path / "in", spark.sparkContext._jsc.sc().statusStore().jobsList
    folder.mkdir()
    for k in range(150):
        feed_file(folder, f"{k}.xml", [("a", f"1.{k}", "u")])
    old, setting = jobs(None).size(), spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    assert feed.poll_feed(spark, str(folder), str(tmp_path / "state")).count() == 150
    found = jobs(None)
    assert found.size() > old and max(found.apply(k).numTasks() for k in range(found.size() - old)) < 100  # the newest come first
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == setting


def test_a_poll_takes_files_by_portions(spark, tmp_path, monkeypatch):
    folder, state = tmp_path / "in", tmp_path / "state"
    monkeypatch.setattr(feed, "FILES", 20, raising=False)
    folder.mkdir()
    for k in range(70):
        feed_file(folder, f"{k}.xml", [("a", f"1.{k}", "u")])
    store = spark._jsparkSession.sharedState().statusStore()
    old = store.executionsList().size()
    known = feed.poll_feed(spark, str(folder), str(state))
    assert {r["version"] for r in known.collect()} == {f"1.{k}" for k in range(70)}
    assert sorted(p.name for p in (state / "entries").iterdir()) == ["poll=0"]
    runs, files = store.executionsList(), []
    for k in range(old, runs.size()):
        metrics = runs.apply(k).metrics()
        ids = [metrics.apply(m).accumulatorId() for m in range(metrics.size()) if metrics.apply(m).name() == "number of files read"]
        files += [int(v.get().replace(",", "")) for i in ids if (v := store.executionMetrics(runs.apply(k).executionId()).get(i)).isDefined()]
    assert 0 < max(files) <= 20  # of any plan
    kept = "".join(p.read_text() for p in (state / "checkpoint" / "sources" / "0").iterdir() if not p.name.startswith("."))
    assert "parquet" in kept and ".xml" not in kept  # what the stream's driver keeps in mind


def test_a_poll_reads_late_files_with_old_dates(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    feed_file(folder, "one.xml", [("a", "1.0", "u1")])
    feed.poll_feed(spark, str(folder), state)
    feed_file(folder, "two.xml", [("b", "1.1", "u2")])
    os.utime(folder / "two.xml", (1_000_000_000, 1_000_000_000))
    assert {r["version"] for r in feed.poll_feed(spark, str(folder), state).collect()} == {"1.0", "1.1"}


def test_a_poll_goes_on_from_a_state_without_notes(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state [1]")
    folder.mkdir()
    for name, items in (("a +%.xml", [("a", "1.0", "u1"), ("b", "1.1", "u2")]), ("b.xml", [("b2", "1.1", "u2"), ("c", "1.2", "u3")])):
        feed_file(folder, name, items)
        files = spark.readStream.format("xml").option("rowTag", "item").schema(feed.ITEM).load(str(folder))
        entries = files.select(*feed.entry(), F.col("_metadata.file_modification_time").alias("came"), F.col("_metadata.file_path").alias("file"))
        stream = entries.writeStream.foreachBatch(lambda batch, poll: batch.write.parquet(f"{state}/entries/poll={poll}"))
        stream.option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    os.utime(folder / "a +%.xml")
    feed_file(folder, "c.xml", [("d", "1.3", "u4")])
    for _ in range(2):
        assert {(r["title"], r["version"]) for r in feed.poll_feed(spark, str(folder), state).collect()} == {("a", "1.0"), ("b2", "1.1"), ("c", "1.2"), ("d", "1.3")}
    feed_file(folder, "d.xml", [("d2", "1.3", "u4")])
    assert {(r["title"], r["version"]) for r in feed.poll_feed(spark, str(folder), state).collect()} == {("a", "1.0"), ("b2", "1.1"), ("c", "1.2"), ("d2", "1.3")}
    read = spark.read.parquet(feed._literal(f"{state}/entries"))
    assert read.groupBy("poll").count().orderBy("poll").collect() == [(0, 2), (1, 2), (2, 1), (3, 1)]


def test_a_poll_of_odd_names(spark, tmp_path):
    folder, state = tmp_path / "in [1]", tmp_path / "state"
    names = ["a b.xml", "x[1].xml", "s*r.xml", "q?.xml", "{a,b}.xml", "back\\slash.xml", "per%20cent.xml", "ü.xml", "plus+#.xml"]
    for odd, below in ((folder, []), (tmp_path / "plain", ["day=1/d.xml", "day=2/x/e.xml"])):
        for sub in ("sub", "_sub", *map(os.path.dirname, below)):
            (odd / sub).mkdir(parents=True)
        for k, name in enumerate([*names, *below]):
            feed_file(odd, name, [("a", f"1.{k}", "u")])
        for name in (".hidden.xml", "_hidden.xml", "_sub/y.xml", "sub/y.xml"):
            feed_file(odd, name, [("a", f"not {name}", "u")])
        (odd / "empty.xml").write_text("")
        (odd / "nowhere.xml").symlink_to(odd / "none")
    want = {f"1.{k}" for k in range(len(names) + 2)}
    found = feed.poll_feed(spark, str(tmp_path / "plain"), str(state))
    assert {r["version"] for r in found.collect()} == want
    same = (f"file://{tmp_path}/plain/", f"{tmp_path}/sub/..//plain", f"file:{tmp_path}/plain")
    for k, again in enumerate(same):
        (tmp_path / "sub").mkdir(exist_ok=True)
        assert feed.poll_feed(spark, again, str(state)).count() == len(want), k
    assert sorted(p.name for p in (state / "entries").iterdir()) == ["poll=0"]  # nothing is read again
    globbed = feed.poll_feed(spark, str(folder).replace("[", "\\[").replace("]", "\\]"), str(tmp_path / "globbed"))  # by Spark's own list
    assert {r["version"] for r in globbed.collect()} == {f"1.{k}" for k in range(len(names))}
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        feed.poll_feed(spark, str(tmp_path / "none"), str(tmp_path / "none state"))


def test_a_poll_broken_off_between_portions_shows_nothing(spark, tmp_path, monkeypatch):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    feed_file(folder, "0.xml", [("a", "1.0", "u")])
    feed.poll_feed(spark, str(folder), state)
    for k in range(1, 30):
        feed_file(folder, f"{k}.xml", [("a", f"1.{k}", "u")])
    monkeypatch.setattr(feed, "FILES", 10)
    opened, calls = feed._opened, []

    def breaks(session, names):
        calls.append(names)
        if len(calls) == 3:
            raise RuntimeError("as if the driver had gone")
        return opened(session, names)

    monkeypatch.setattr(feed, "_opened", breaks)
    with pytest.raises(Exception, match="as if the driver had gone"):
        feed.poll_feed(spark, str(folder), state)
    assert [r["version"] for r in feed.known_releases(spark, state).collect()] == ["1.0"]
    (folder / "7.xml").unlink()  # a noted file that goes
    feed_file(folder, "late.xml", [("a", "2.0", "u")])
    assert {r["version"] for r in feed.poll_feed(spark, str(folder), state).collect()} == {f"1.{k}" for k in range(30) if k != 7} | {"2.0"}
    assert spark.read.parquet(f"{state}/entries").count() == 30


def test_a_poll_that_was_broken_off_is_made_again(spark, tmp_path, monkeypatch):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    feed_file(folder, "one.xml", [("a", "1.0", "u1"), ("b", "1.1", "u2")])
    feed.poll_feed(spark, str(folder), state)
    commits = tmp_path / "state" / "checkpoint" / "commits"
    for left in commits.iterdir():  # as if the driver had gone after the rows were written, before the poll was noted as done
        left.unlink()
    again = feed.poll_feed(spark, str(folder), state)
    assert sorted(r["version"] for r in again.collect()) == ["1.0", "1.1"]
    assert spark.read.parquet(f"{state}/entries").count() == 2
