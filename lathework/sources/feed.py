"""Release feeds (RSS), read at once or polled, and release records (JSON)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .file_sink import spread
from .intake import names_in
from .stash import discard, finished, moved

#: An item of an update feed. Versions are text: 14.10 is not 14.1.
ITEM = """title string, pubDate string, link string, `sparkle:version` string, `sparkle:shortVersionString` string,
    `sparkle:minimumSystemVersion` string, description string,
    enclosure struct<_url: string, _length: long, `_sparkle:edSignature`: string>"""
#: What is kept of an item.
RELEASES = "title string, published timestamp, link string, build string, version string, minimum_system string, notes string, url string, length long, signature string"
#: Tasks that look a portion of feed files up, and that read it, for each core.
LISTERS = 4
#: Feed files of a portion; the driver holds the names of one portion at a time.
FILES = 10_000
#: What is noted of a feed file.
FOUND = "path string"
RELEASE = "tag_name string, html_url string, assets array<struct<name: string, browser_download_url: string, size: long>>"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """One row for each release in a feed."""
    return spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path).select(*entry())


def entry() -> list[Column]:
    """The columns of a release, out of an item."""
    return [
        F.col("title"),
        feed_time(F.col("pubDate")).alias("published"),
        F.col("link"),
        F.col("`sparkle:version`").alias("build"),
        F.col("`sparkle:shortVersionString`").alias("version"),
        F.col("`sparkle:minimumSystemVersion`").alias("minimum_system"),
        F.col("description").alias("notes"),
        F.col("enclosure._url").alias("url"),
        F.col("enclosure._length").alias("length"),
        F.col("enclosure.`_sparkle:edSignature`").alias("signature"),
    ]


def poll_feed(spark: SparkSession, folder: str, state: str) -> DataFrame:
    """Reads the feed files that came into `folder` since the last poll, and returns all releases known by now (known_releases).

    Tasks list the folder and join its names with those noted in tables below `state`; the new ones are noted there, so
    a file is read once, known by its name. A stream that takes what is there and stops reads the notes; its checkpoint
    below `state` knows which polls are done. Each poll's entries are a partition of a table below `state` that is
    written again from the start if the poll is broken off; a poll that finds nothing new adds none. All executors must
    reach both folders by their names, one poll runs at a time, and items that are no XML are null entries. A noted file
    that goes before it is read has none.

    The driver holds the names of FILES files at a time, but for folders that are not on a local or mounted file system:
    those are listed by Spark, in the driver.
    """
    note_new(spark, folder, state)
    found = spark.readStream.schema(FOUND).parquet(f"{_literal(state)}/files/*.parquet")

    def record(batch: DataFrame, poll: int) -> None:
        session, part, mode = batch.sparkSession, f"{state}/entries/.poll={poll}", "overwrite"
        tasks = LISTERS * session.sparkContext.defaultParallelism
        # In the stream's own session: Spark looks each file up before it reads it, by a task a file, and keeps what it saw.
        listers = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
        session.conf.set(listers, str(min(int(session.conf.get(listers)), tasks)))
        session.conf.set("spark.sql.hive.filesourcePartitionFileCacheSize", "0")
        for names in portions(batch):
            if (files := _opened(session, names)) is not None:
                came = [F.col("_metadata.file_modification_time").alias("came"), F.col("_metadata.file_path").alias("file")]
                files.select(*entry(), *came).coalesce(tasks).write.mode(mode).parquet(part)
                mode = "append"
        if mode == "append":
            moved(session, part, f"{state}/entries/poll={poll}")

    query = found.writeStream.foreachBatch(record).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return known_releases(spark, state)


def note_new(spark: SparkSession, folder: str, state: str) -> None:
    """Notes the files of a folder that are not noted yet. Names are joined by a shuffle, as a broadcast would go through the driver."""
    new = finished(lambda: names_in(spark, folder).join(noted(spark, state).hint("merge"), "path", "left_anti"))
    if not new.isEmpty():
        new.write.mode("append").parquet(f"{state}/files")
    discard(new)


def noted(spark: SparkSession, state: str) -> DataFrame:
    """(path) of the files that polls know. Those of polls made before files were noted are taken from their entries, once."""
    files, before = f"{state}/files", f"{state}/files-before"
    if (notes := _kept(spark, FOUND, files)) is None and (entries := _kept(spark, "file string", f"{state}/entries")) is not None:
        path = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
        entries.select(path.alias("path")).distinct().write.mode("overwrite").parquet(before)
    tables = [table for table in (notes, _kept(spark, FOUND, before)) if table is not None]
    return reduce(DataFrame.unionAll, tables) if tables else spark.createDataFrame([], FOUND)


def portions(found: DataFrame, most: int | None = None) -> Iterator[list[str]]:
    """The names in a table, by so many at a time."""
    most = most or FILES
    names = (r["path"] for r in spread(found, "path", most).toLocalIterator())
    while part := list(islice(names, most)):
        yield part


def _opened(spark: SparkSession, names: list[str]) -> DataFrame | None:
    """The items of files, without those that are gone; None if all are."""

    def items(names: list[str]) -> DataFrame:
        return spark.read.format("xml").option("rowTag", "item").schema(ITEM).load([_literal(name) for name in names])

    if (files := _there(lambda: items(names))) is None:
        at, settings = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
        left = [name for name in names if at(name).getFileSystem(settings).exists(at(name))]
        files = items(left) if left else None
    return files


def _literal(path: str) -> str:
    """A path that Spark does not take for a glob."""
    return "".join(f"\\{c}" if c in "\\*?[]{}" else c for c in path)


def _kept(spark: SparkSession, schema: str, path: str) -> DataFrame | None:
    return _there(lambda: spark.read.schema(schema).parquet(_literal(path)))


def _there(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What read() returns; None if a path of it does not exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def known_releases(spark: SparkSession, state: str) -> DataFrame:
    """The last entry of each version over all polls, so that those no longer in a feed are carried forward.

    Of one poll the file changed last counts, then the later name, then the later and larger entry. Entries without a
    version are told apart by their links to the file. Before anything was found there are none.
    """
    entries = _kept(spark, f"{RELEASES}, came timestamp, file string, poll long", f"{state}/entries")
    if entries is None:
        return spark.createDataFrame([], RELEASES)
    columns = [c for c in entries.columns if c not in ("came", "file", "poll")]
    known_by = [F.col("version"), F.when(F.col("version").isNull(), F.col("url")).alias("_url")]
    last = F.max_by(F.struct(*columns), F.struct("poll", "came", "file", F.struct("published", *[c for c in columns if c != "published"])))
    return entries.groupBy(*known_by).agg(last.alias("last")).select("last.*")


def feed_time(text: Column) -> Column:
    """RFC 822 dates of any offset as timestamps; the weekday is not looked at."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))


def carried_forward(old: DataFrame, new: DataFrame, key: str = "version") -> DataFrame:
    """New entries, and the old ones of versions that are not among them."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns))


def unsigned(feed: DataFrame) -> DataFrame:
    """Entries without a signature; a release needs this to be empty."""
    return feed.where(F.coalesce(F.col("signature"), F.lit("")) == "")


def release_download(payload: Column, fallback: str) -> Column:
    """struct<url, size> of the first .dmg asset of a release record, else the fallback link without a size."""
    release = F.from_json(payload, RELEASE)
    asset = F.get(F.filter(release["assets"], lambda a: F.lower(a["name"]).endswith(".dmg")), 0)
    return F.struct(F.coalesce(asset["browser_download_url"], F.lit(fallback)).alias("url"), asset["size"].alias("size"))
