"""Fixed vectors and edge cases of the file tools' operators."""

from __future__ import annotations

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lathework.functions import formats, paths, sizes, texts
from lathework.functions.resize import Resize, target_size
from lathework.operators import batch, naming, release
from lathework.operators.metadata import metadata_entries
from lathework.operators.headers import HEAD, declared_size, image_header, image_size
from lathework.plans.image_job import COMPRESS_LOSSLESS, Options, finish_images, plan_images, resize_options
from lathework.sources import feed, intake


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


RESIZE = [
    (Resize("fit", 1000, 1000), 4000, 3000, False, (1000, 750)),
    (Resize("fit", 2000, None), 4000, 3000, False, (2000, 1500)),
    (Resize("fit", 8000, 8000), 4000, 3000, False, None),
    (Resize("fit", 8000, 8000), 4000, 3000, True, (8000, 6000)),
    (Resize("longest", amount=2000), 4000, 3000, False, (2000, 1500)),
    (Resize("longest", amount=2000), 3000, 4000, False, (1500, 2000)),
    (Resize("percent", amount=50), 4000, 3000, False, (2000, 1500)),
    (Resize("percent", amount=100), 4000, 3000, False, None),
    (Resize("exact", 500, 500), 4000, 3000, False, (500, 500)),
    (Resize("percent", amount=0.001), 4000, 3000, False, (1, 1)),
    (Resize("percent", amount=50), 0, 0, False, None),
    (Resize("fit", 0, 100), 4000, 3000, False, (1, 1)),
    (Resize("fit"), 4000, 3000, False, None),
    (Resize("exact", 0, 100), 4000, 3000, False, None),
    (Resize(), 4000, 3000, False, None),
    (Resize("percent", amount=50), None, 3000, False, None),
]


def test_resize_vectors(spark):
    cols = [target_size(r, F.lit(w).cast("double"), F.lit(h).cast("double"), up).alias(f"r{k}") for k, (r, w, h, up, _) in enumerate(RESIZE)]
    row = one(spark, *cols)
    for found, (*_, want) in zip(row, RESIZE, strict=True):
        assert (tuple(found) if found else None) == want


def test_active():
    assert not Resize().active() and not Resize("fit").active() and not Resize("exact", 0, 100).active()
    assert not Resize("percent", amount=100).active() and Resize("longest", amount=1024).active()


@pytest.mark.parametrize(("a", "b", "end"), [(1000, 0, "0 bytes"), (1000, 996, "(about the same)"), (1000, 995, "(1% smaller)"), (1000, 1500, "(50% larger)"), (0, 5, "5 bytes")])
def test_savings(spark, a, b, end):
    assert one(spark, sizes.savings_label(F.lit(a).cast("long"), F.lit(b).cast("long")).alias("x"))[0].endswith(end)


def test_labels(spark):
    n = [0, 1, 999, 1000, 1499, 810_000, 2_400_000, 1_234_000_000, None]
    rows = spark.createDataFrame(list(enumerate(n)), "k long, n long").orderBy("k").select(sizes.byte_label(F.col("n")), sizes.download_label(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["0 bytes", "1 byte", "999 bytes", "1 KB", "1 KB", "810 KB", "2.4 MB", "1.23 GB", None]
    assert rows[0][1] is None and rows[6][1] == "2.3 MB" and rows[7][1] == "1177 MB" and rows[8][1] is None


def test_paths(spark):
    given = ["/a/b.tar.GZ", "x", "/d/.profile", "", None, "/a/../b//c/./d.png"]
    rows = spark.createDataFrame(list(enumerate(given)), "k long, p string").orderBy("k").select(paths.extension(F.col("p")), paths.base_name(F.col("p")), paths.parent(F.col("p")), paths.standard(F.col("p"))).collect()
    assert [r[0] for r in rows] == ["gz", "", "", "", None, "png"]
    assert [r[1] for r in rows][:4] == ["b.tar", "x", ".profile", ""]
    assert rows[0][2] == "/a" and rows[1][2] == "" and rows[5][3] == "/b/c/d.png" and rows[4][3] is None


def test_intake(spark):
    rows = intake.path_list(spark, ["/a/x.png", None, "/a/y.PNG", "/a/./x.png", "/a/z.txt"])
    assert [r["idx"] for r in intake.with_extension(rows, ["png"]).orderBy("idx").collect()] == [0, 1, 2]
    assert intake.with_extension(rows, []).count() == 4
    new = intake.queued(rows, intake.path_list(spark, ["/a/b/../z.txt"]))
    assert [r["idx"] for r in new.orderBy("idx").collect()] == [0, 1]
    assert intake.without(rows, "/a/y.PNG").count() == 3 and intake.cleared(rows).count() == 0


def test_standard_web_addresses(spark):
    """Empty parts of a web address tell pages apart; of a file's path they do not."""
    given = {"https://x/en/7//img3.JPG": "https://x/en/7//img3.JPG", "https://x/en/7//./x/../img3.JPG": "https://x/en/7//img3.JPG", "https://x/en/7/./x/../img3.JPG": "https://x/en/7/img3.JPG", "https://x/../../a": "https://x/a", "https://x/a/..": "https://x/", "https://x/a/./?q=/../b": "https://x/a/?q=/../b", "https://x/a/.": "https://x/a/", "https://x": "https://x", "file:///a//b": "file:/a/b", "/a//b": "/a/b"}
    rows = spark.createDataFrame(list(given.items()), "path string, want string").select("want", paths.standard(F.col("path")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    new = intake.queued(intake.path_list(spark, ["https://x/7//a", "https://x/7/a", "https://x/7//b", "/7//a", "/7/a"]), intake.path_list(spark, ["https://x/7//./x/../b"]))
    assert [r["idx"] for r in new.orderBy("idx").collect()] == [0, 1, 3]


def brute_names(rows, existing=()):
    taken, out = set(existing), {}
    for idx, base in sorted(rows):
        k = 0
        while (name := f"{base}-{k}" if k else base) in taken:
            k += 1
        taken.add(name)
        out[idx] = f"{name}.png"
    return out


def test_names_are_greedy(spark):
    bases = ["photo", "photo-1", "photo", "photo", "b-2", "b", "b-2", "b-2-1", "solo", "solo-7", "photo-2", ""]
    df = spark.createDataFrame([(k, "d", b, "png") for k, b in enumerate(bases)], "idx long, out_dir string, base string, out_ext string")
    found = {r["idx"]: r["out_name"] for r in naming.assign_names(df).collect()}
    assert found == brute_names(list(enumerate(bases)))
    there = spark.createDataFrame([("d", "photo", "png"), ("d", "photo-1", "png"), ("d", "solo", "png")], "out_dir string, base string, out_ext string")
    found = {r["idx"]: r["out_name"] for r in naming.assign_names(df, existing=there).collect()}
    assert found == brute_names(list(enumerate(bases)), ["photo", "photo-1", "solo"])
    assert naming.assign_names(df.limit(0)).count() == 0


def test_names_run_out(spark):
    df = spark.range(10_050).select(F.col("id").alias("idx"), F.lit("d").alias("out_dir"), F.lit("x").alias("base"), F.lit("png").alias("out_ext"))
    row = naming.assign_names(df).agg(F.count("out_name"), F.countDistinct("out_name"), F.max(F.when(F.col("out_name").isNotNull(), F.col("idx")))).first()
    assert tuple(row) == (10_000, 10_000, 9_999)


def test_batch(spark):
    files = intake.path_list(spark, [f"/tmp/{k}" for k in range(24)])

    def job(row):
        if row["idx"] == 3:
            raise batch.JobError("notAPDF", "bad")
        if row["idx"] == 5:
            raise ValueError("odd")
        return row["path"] + ".out", "ok"

    rows = batch.in_order(batch.run_jobs(files, job, width=6)).collect()
    assert [r["idx"] for r in rows] == list(range(24))
    assert [(r["idx"], r["error_code"], r["failure"]) for r in rows if r["failure"]] == [(3, "notAPDF", "bad"), (5, "unexpected", "odd")]
    out = batch.run_jobs(files, job)
    assert batch.batch_summary(out).first()["summary"] == "22 done, 2 failed"
    assert sorted(r["idx"] for r in batch.retry_queue(out).collect()) == [3, 5]
    assert batch.first_success(out).first()["output"] == "/tmp/0.out"
    assert batch.run_jobs(files.limit(0), job).count() == 0
    with pytest.raises(ValueError, match="width"):
        batch.run_jobs(files, job, width=0)


@pytest.mark.parametrize(
    ("tag", "labels", "bump", "given", "want"),
    [("v1.10.0", "", None, "", ("1.10.1", None)), ("1.2.3", "minor major", None, "", ("2.0.0", None)), (None, "major", None, "", ("1.0.0", None)), ("v2.0.0-rc1", "", None, "", (None, "bad latest tag")), ("1.2.3", "release:minor", "major", "", ("1.3.0", None)), ("1.2.3", "minority", "major", "", ("2.0.0", None)), ("1.2.3", "", "odd", "", (None, "bad bump")), ("1.2.3", "", None, "9.9.9", ("9.9.9", None)), ("1.2.3", "", None, "9.9", (None, "bad version")), ("1.2.3", "patch", "major", "", ("2.0.0", None)), ("1.2.3", "", "", "", ("1.2.4", None)), ("", None, "junk", None, ("1.0.0", None)), ("1.2.3", "docs\tmajor", None, "", ("1.2.4", None))],
)
def test_next_version(spark, tag, labels, bump, given, want):
    row = release.with_next_version(spark.range(1), *[F.lit(x).cast("string") for x in (tag, labels, bump, given)]).select("version", "error").first()
    assert tuple(row) == want


def test_latest_tag(spark):
    tags = spark.createDataFrame([("v1.9.0",), ("v1.10.0",), ("nightly",), ("vx",), (None,)], "tag string")
    assert [r[0] for r in release.latest_tag(tags).collect()] == ["v1.10.0"]
    assert release.latest_tag(tags.limit(0)).count() == 0


def test_feed(spark, tmp_path):
    item = '<item><title>{v}</title><pubDate>{d}</pubDate><sparkle:version>{b}</sparkle:version><sparkle:shortVersionString>{v}</sparkle:shortVersionString><sparkle:minimumSystemVersion>14.10</sparkle:minimumSystemVersion><enclosure url="u{b}" length="{b}00" {s}/></item>'
    body = item.format(v="1.1.0", d="Mon, 05 Jan 2026 16:04:38 +0530", b=7, s='sparkle:edSignature="abc"') + item.format(v="1.0.0", d="Sun, 04 Jan 2026 08:07:04 +0000", b=4, s="")
    (tmp_path / "feed.xml").write_text(f'<rss xmlns:sparkle="x"><channel>{body}</channel></rss>')
    df = feed.read_feed(spark, str(tmp_path / "feed.xml"))
    rows = {r["version"]: r for r in df.collect()}
    assert rows["1.1.0"]["minimum_system"] == "14.10" and rows["1.1.0"]["length"] == 700 and rows["1.1.0"]["published"].hour == 10
    assert [r["version"] for r in feed.unsigned(df).collect()] == ["1.0.0"]
    new = df.where("version = '1.1.0'").withColumn("title", F.lit("again"))
    assert {(r["version"], r["title"]) for r in feed.carried_forward(df, new).collect()} == {("1.1.0", "again"), ("1.0.0", "1.0.0")}
    payload = F.lit('{"tag_name":"v1","assets":[{"name":"a.zip","browser_download_url":"z","size":1},{"name":"A.DMG","browser_download_url":"d","size":2}]}')
    assert tuple(one(spark, feed.release_download(payload, "f").alias("x"))[0]) == ("d", 2)
    assert tuple(one(spark, feed.release_download(F.lit("nonsense"), "f").alias("x"))[0]) == ("f", None)


def png(w, h):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (3 * w + 1) * h)) + chunk(b"IEND", b"")


JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc4\x00\x03x\xff\xc0\x00\x0b\x08\x01\x2c\x01\x90" + b"\0" * 8


def test_headers():
    assert image_size(png(32, 24)) == (32, 24) and image_size(JPEG) == (400, 300)
    assert image_size(b"GIF89a" + struct.pack("<HH", 5, 6)) == (5, 6) and image_size(b"\x01\x02\x03\x04") == (None, None) and image_size(None) == (None, None)


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def test_headers_of_other_kinds():
    ispe = [box(b"ispe", struct.pack(">III", 0, w, h)) for w, h in ((512, 512), (4032, 3024), (320, 240))]
    heic = box(b"ftyp", b"heic\0\0\0\0mif1") + box(b"meta", b"\0" * 4, box(b"hdlr", b"x" * 20), box(b"iprp", box(b"ipco", *ispe), box(b"ipma", b"\0" * 8)))
    assert image_size(heic + box(b"mdat", b"z" * 100)) == image_size(heic.replace(b"heic", b"avif")) == (4032, 3024)
    for end in "<>":
        entries = struct.pack(end + "HHIHH", 256, 3, 1, 640, 0) + struct.pack(end + "HHII", 257, 4, 1, 480) + struct.pack(end + "HHII", 258, 3, 3, 9)
        tiff = (b"II*\0" if end == "<" else b"MM\0*") + struct.pack(end + "I", 90_000) + b"p" * 89_992 + struct.pack(end + "H", 3) + entries
        assert image_size(tiff) == (640, 480) and image_header(tiff[:HEAD]) == (None, None, False, True, 1)
    assert image_size(b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0" + (1999).to_bytes(3, "little") + (999).to_bytes(3, "little")) == (2000, 1000)
    assert image_size(b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + (99 | 49 << 14).to_bytes(4, "little")) == (100, 50)
    assert image_size(b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 300, 200)) == (300, 200)
    assert image_header(b"FUJIFILMCCD-RAW 0201") == (None, None, True, False, 1)
    for whole in (heic, tiff, JPEG, png(3, 4)):
        for n in range(0, len(whole), 1 + len(whole) // 200):
            assert image_size(whole[:n]) in ((None, None), image_size(whole))  # cut off anywhere, never raises


def test_camera_files():
    def tags(end, *entries, onward=0):
        return struct.pack(end + "H", len(entries)) + b"".join(struct.pack(end + "HHI", t, 4, 1) + struct.pack(end + "I", v) for t, v in entries) + struct.pack(end + "I", onward)

    dng = b"II*\0" + struct.pack("<I", 8) + tags("<", (254, 1), (256, 256), (257, 171), (330, 62)) + tags("<", (254, 0), (256, 6000), (257, 4000), (274, 8))
    assert image_header(dng) == (4000, 6000, False, False, 8)
    assert image_size(dng.replace(struct.pack("<HHII", 254, 4, 1, 0), struct.pack("<HHII", 254, 4, 1, 4))) == (256, 171)  # a mask is no image
    only = b"MM\0*" + struct.pack(">I", 8) + tags(">", (254, 1), (256, 20), (257, 10), onward=50) + tags(">", (254, 1), (256, 40), (257, 30), onward=8)
    assert image_size(only) == (40, 30)  # reduced images in a circle: the largest
    heic = box(b"ftyp", b"heic\0\0\0\0") + box(b"meta", b"\0" * 4, box(b"pitm", b"\0" * 4, struct.pack(">H", 7)), box(b"iprp", box(b"ipco", box(b"ispe", struct.pack(">III", 0, 9000, 9000)), box(b"irot", b"\1"), box(b"ispe", struct.pack(">III", 0, 400, 300))), box(b"ipma", b"\0\0\0\1", struct.pack(">IHBHH", 1, 7, 2, 0x8002, 3))))
    assert image_header(heic) == (300, 400, False, False, 8)
    for whole in (dng, only, heic):
        for n in range(len(whole)):
            image_header(whole[:n])  # never raises
        for n in range(len(whole)):
            image_header(whole[:n] + b"\xff" * 4 + whole[n + 4 :])


def test_metadata():
    entries = struct.pack("<HHI", 271, 2, 6) + struct.pack("<I", 60) + struct.pack("<HHIHH", 274, 3, 1, 8, 0) + struct.pack("<HHII", 34853, 4, 1, 70)
    tags = b"II*\0" + struct.pack("<IH", 8, 3) + entries + b"\0" * 14 + b"Maker\0" + b"\0" * 4 + struct.pack("<HHHIBBBB", 1, 0, 1, 4, 2, 3, 0, 0)
    want = [("tiff", "271", "Maker"), ("orientation", "", "8"), ("gps", "0", "2,3,0,0")]
    assert metadata_entries(tags) == want
    iptc = b"8BIM\x04\x04\0\0" + struct.pack(">I", 19) + b"\x1c\2\x19\0\4\xc3\xa4bc" + b"\x1c\2\x19\0\2de" + b"\x1c\2\x50" + b"\0"
    jpeg = b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", 8 + len(tags)) + b"Exif\0\0" + tags + b"\xff\xed" + struct.pack(">H", 16 + len(iptc)) + b"Photoshop 3.0\0" + iptc + b"\xff\xda"
    assert metadata_entries(jpeg) == [*want, ("iptc", "2:25", "äbc;de")]
    assert metadata_entries(b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 9) + b"pHYs" + struct.pack(">IIB", 2835, 5669, 1) + b"crc!") == [("dpiWidth", "", "72"), ("dpiHeight", "", "144")]
    assert metadata_entries(None) == metadata_entries(b"GIF89a") == []
    for whole in (tags, jpeg):
        for n in range(len(whole)):
            metadata_entries(whole[:n])
            metadata_entries(whole[:n] + b"\xff" * 3 + whole[n + 3 :])  # never raises


def test_sizes_beyond_the_head(spark):
    long = JPEG[:2] + (b"\xff\xe1\xff\xff" + b"e" * 65_533) * 3 + JPEG[2:]
    rows = spark.createDataFrame([(1, long), (2, png(5, 6)), (3, None), (4, b"x")], "k long, c binary").select("k", declared_size(F.col("c")).alias("s")).orderBy("k").collect()
    assert [(r["s"]["width"], r["s"]["height"]) for r in rows] == [(400, 300), (5, 6), (None, None), (None, None)]


def test_names_of_random_bases(spark):
    import random

    rng = random.Random(6)
    bases = [rng.choice("ab") + "".join(rng.choice(("", "-1", "-2", "-3", "-0", "-01", "-12345")) for _ in range(3)) for _ in range(400)]
    there = sorted({rng.choice(bases) for _ in range(25)} | {"a-9", "b-1-1-1"})
    df = spark.createDataFrame([(k, "d", b, "png") for k, b in enumerate(bases)], "idx long, out_dir string, base string, out_ext string")
    for existing in ((), there):
        old = spark.createDataFrame([("d", b, "png") for b in existing], "out_dir string, base string, out_ext string")
        found = {r["idx"]: r["out_name"] for r in naming.assign_names(df, existing=old).collect()}
        assert found == brute_names(list(enumerate(bases)), existing)


def test_many_numbered_names_are_not_one_group(spark):
    # One repeat among 30,000 numbered scans: only the numbers within reach are numbered one after the other.
    df = spark.range(30_000).select(F.col("id").alias("idx"), F.lit("d").alias("out_dir"), F.concat(F.lit("scan-"), (F.col("id") + 20_000).cast("string")).alias("base"), F.lit("png").alias("out_ext"))
    df = df.union(spark.createDataFrame([(30_000, "d", "scan", "png"), (30_001, "d", "scan", "png")], df.schema))
    out = naming.assign_names(df)
    assert out.select("out_name").distinct().count() == 30_002 and out.where("out_name = 'scan-1.png'").first()["idx"] == 30_001


def test_progress(spark):
    files = intake.path_list(spark, [f"/tmp/{k}" for k in range(40)])
    progress = batch.Progress(spark, 40)
    assert progress.done == 0
    batch.run_jobs(files, lambda row: (row["path"], None), width=4, step=progress.step).collect()
    assert progress.done == progress.total == 40


def test_image_plan(spark, tmp_path):
    for name, data in {"a.png": png(40, 30), "b.jpg": JPEG, "notes.txt": b"hello", "broken.png": b"\x01\x02\x03\x04", "a.heic": b"\0\0\0\x18ftypheic"}.items():
        (tmp_path / name).write_bytes(data)
    files = intake.read_files(spark, str(tmp_path)).withColumn("name", paths.file_name(F.col("path"))).withColumn("idx", F.hash("name").cast("long"))
    options = resize_options(Resize("fit", 20, 20))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in plan_images(files, options).collect()}
    assert rows["a.png"]["out_name"] == "a-resized.png" and tuple(rows["a.png"]["target"]) == (20, 15)
    assert rows["b.jpg"]["format"] == "jpeg" and rows["b.jpg"]["out_name"] == "b-resized.jpg"
    assert rows["notes.txt"]["error_code"] == "unsupportedInput" and "txt" in rows["notes.txt"]["failure"]
    assert rows["broken.png"]["error_code"] == "decodeFailed" and rows["a.heic"]["error_code"] == "decodeFailed"  # cut off before its size
    plan = plan_images(files, COMPRESS_LOSSLESS)
    written = plan.where("error_code IS NULL").select("idx", (F.col("original_bytes") + F.when(F.col("format") == "png", 0).otherwise(-1)).alias("new_bytes"))
    done = {r["input"].rsplit("/", 1)[1]: r for r in finish_images(plan, written, COMPRESS_LOSSLESS).collect()}
    assert done["a.png"]["kept_original"] and not done["a.png"]["metadata_stripped"] and done["a.png"]["detail"].startswith("Already optimal")
    assert not done["b.jpg"]["kept_original"] and done["b.jpg"]["output"].endswith("/b-compressed.jpg")
    assert done["notes.txt"]["output"] is None and len(done) == 5
    codes = {r["error_code"] for r in plan_images(files, Options(fmt="heic")).collect()}
    assert codes == {"unsupportedOutput", "unsupportedInput", "decodeFailed"}


def test_formats(spark):
    heads = [png(1, 1), JPEG, b"II*\0", b"RIFF1234WEBP", b"\0\0\0\x18ftypheic", b"GIF8", None]
    rows = spark.createDataFrame([(k, h) for k, h in enumerate(heads)], "k long, c binary").orderBy("k").select(formats.magic_format(F.col("c"))).collect()
    assert [r[0] for r in rows] == ["png", "jpeg", "tiff", "webp", "heic", None, None]
    row = one(spark, *[formats.inferred_format(F.lit(None).cast("string"), F.lit(e)).alias(e) for e in ("jpg", "jpeg", "tif", "WEBP", "gif")])
    assert tuple(row) == ("jpeg", "png", "png", "webp", "png")


def test_texts(spark):
    row = one(spark, texts.whole_number(F.lit("12")).alias("a"), texts.whole_number(F.lit("1.5")).alias("b"), texts.whole_number(F.lit("x"), 0).alias("c"), texts.whole_number(F.lit(None).cast("string"), 0).alias("d"), texts.html_escape(F.lit('<a&"b">')).alias("e"))
    assert tuple(row) == (12, None, 0, 0, "&lt;a&amp;&quot;b&quot;&gt;")
    assert one(spark, texts.summary(F.lit(1), F.lit(0)).alias("x"))[0] == "Done — 1 file" and one(spark, texts.summary(F.lit(0), F.lit(2)).alias("x"))[0] == "Failed — 2 files"
