"""Release versions: the latest tag, and the one that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The whole text, up to its very end.
VERSION = r"^[0-9]+\.[0-9]+\.[0-9]+\z"


def version_order(tag: Column) -> Column:
    """A text whose byte order is that of tags: runs of digits by their number, of any length, all else as it is.

    A tag that goes on stands above the one it goes on from: v2.0.0-rc1 above v2.0.0. Leading zeros do not count.
    """
    runs = F.regexp_extract_all(tag, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    number = lambda r: F.regexp_replace(r, "^0+(?=[0-9])", "")
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lpad(F.length(number(r)).cast("string"), 9, "0"), number(r))).otherwise(r)), "")


def latest_tag(tags: DataFrame, tag: str = "tag") -> DataFrame:
    """The highest version among the tags that start with v and a digit, as (tag); no row if there is none. Tags equal in order go by their text."""
    return tags.where(F.col(tag).rlike("^v[0-9]")).orderBy(version_order(F.col(tag)).desc(), F.col(tag).desc()).limit(1).select(tag)


def bump_kind(labels: Column, bump: Column) -> Column:
    """The bump asked for (patch if null or empty), unless a label says major or minor; of both labels major wins.

    Labels are words between single spaces, with or without `release:` before them. Any other label, patch
    included, changes nothing.
    """
    words = F.split(F.coalesce(labels, F.lit("")), " ")
    has = {k: F.arrays_overlap(words, F.array(F.lit(k), F.lit(f"release:{k}"))) for k in ("major", "minor")}
    return F.when(has["major"], "major").when(has["minor"], "minor").otherwise(F.coalesce(F.when(bump != "", bump), F.lit("patch")))


def with_next_version(df: DataFrame, latest: Column, labels: Column, bump: Column, explicit: Column) -> DataFrame:
    """Adds `version` and `error`: the version after `latest` (X.Y.Z with or without v; null or empty: none yet).

    A well-formed explicit version is returned as it is, any other one is an error. Without a tag the
    first version is 1.0.0, whatever the bump. A latest version of another form, or an unknown bump, is an error; so
    is a number to be raised that has no successor in 64 bits. Numbers that are not raised stay as they are written.
    """
    last = F.coalesce(F.regexp_replace(latest, "^v", ""), F.lit(""))
    rows = df.select(F.struct("*").alias("row"), F.coalesce(explicit, F.lit("")).alias("given"), last.alias("last"), bump_kind(labels, bump).alias("kind"))
    kind, given, last = F.col("kind"), F.col("given"), F.col("last")
    x, y, z = (F.split_part(last, F.lit("."), F.lit(n)) for n in (1, 2, 3))

    def raised(part: Column) -> Column:
        return F.try_add(part.try_cast("long"), F.lit(1).cast("long")).cast("string")

    formed = last.rlike(VERSION)
    bumped = F.when(kind == "major", F.concat(raised(x), F.lit(".0.0"))).when(kind == "minor", F.concat(x, F.lit("."), raised(y), F.lit(".0"))).when(kind == "patch", F.concat(x, F.lit("."), y, F.lit("."), raised(z)))
    rows = rows.withColumns({"sound": given.rlike(VERSION), "bumped": F.when(formed, bumped), "formed": formed})
    bumped, sound = F.col("bumped"), F.col("sound")
    version = F.when(given != "", F.when(sound, given)).when(last == "", "1.0.0").otherwise(bumped)
    known = kind.isin("major", "minor", "patch")
    error = F.when((given != "") & ~sound, "bad version").when((given != "") | (last == ""), None).when(~F.col("formed"), "bad latest tag").when(~known, "bad bump").when(bumped.isNull(), "number too long")
    return rows.select("row.*", version.alias("version"), error.cast("string").alias("error"))


def previous_version(latest: Column) -> Column:
    """The latest version without its v; empty if there is none."""
    return F.coalesce(F.regexp_replace(latest, "^v", ""), F.lit(""))


def build_number(commits: DataFrame) -> DataFrame:
    return commits.agg(F.count("*").alias("build"))


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)
