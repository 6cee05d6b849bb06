"""Parts of a file path as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the file name; empty without a dot, and for names like `.profile`."""
    return F.lower(raw_extension(path))


def raw_extension(path: Column) -> Column:
    """The extension in the case it is written in."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)


def base_name(path: Column) -> Column:
    """The file name without its extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    """The folder of a path; empty for a bare name, `/` for what lies in the root."""
    return F.when(path.rlike(r"^/[^/]*\z"), "/").otherwise(F.regexp_extract(path, r"^(.*)/[^/]*$", 1))


def joined(folder: Column, name: Column) -> Column:
    """The path of a name in a folder; an empty folder adds nothing, one that ends in a slash no other."""
    return F.concat(folder, F.when((folder == "") | folder.endswith("/"), "").otherwise("/"), name)


def standard(path: Column) -> Column:
    """The path with `//`, `/./` and `/name/..` resolved, as far as text shows it. In a web address (any scheme but file) empty parts count, so only dots go."""
    site, below, query = (F.regexp_extract(path, r"^((?!(?i:file):)[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)/([^?#]*)((?s:.*))$", k) for k in (1, 2, 3))
    web, bare = site != "", path.rlike(r"^(?!(?i:file):)[A-Za-z][A-Za-z0-9+.-]*://[^/]*\z")
    parts = F.filter(F.split(F.when(web, below).otherwise(path), "/"), lambda p: (p != ".") & (web | (p != "")))
    # A part and the .. after it cancel; the empty array stands for the root.
    stack = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    ends = F.when(web & below.rlike(r"(^|/)\.\.?\z"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))  # `a/.` is the folder `a/`
    head = F.when(web, F.concat(site, F.lit("/"))).when(path.startswith("/"), "/").otherwise("")
    return F.when(bare, path).when(path.isNotNull(), F.concat(head, F.array_join(F.concat(stack, ends), "/"), query))
