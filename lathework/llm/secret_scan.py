"""Secrets in texts: fixed patterns, and windows of high Shannon entropy over candidate strings.

A candidate is a long run of the signs that keys are written in. Within it, each character class has its own runs; a
window slides over a run, and one count that falls and one that rises give the next window's entropy. Windows at or
above the class's threshold propose a span, unless an allow-list knows the string or what stands around it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, bounded, slices


@dataclass(frozen=True)
class CharClass:
    """A character class: the runs it reads, the window, the bits at which a window is random, and what it must hold besides."""

    name: str
    run: str
    window: int
    least_bits: float
    holds: tuple[str, ...]


#: The base kinds in their order, with their patterns. The letters of the keywords are ASCII only.
_KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
_EITHER = "|".join(re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", w) for w in _KEYWORDS)
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(rf"(?:{_EITHER})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
#: Runs are read to their end, so a least length in the pattern leaves the same matches as one that is asked for later.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8

#: Classes from the narrowest to the widest. A random window of each has about half a bit more than its threshold.
CLASSES = (
    CharClass("entropy_hex", r"[0-9a-f]+|[0-9A-F]+", 32, 3.0, (r"[0-9]", r"[A-Fa-f]")),
    CharClass("entropy_alnum", r"[A-Za-z0-9]+", 24, 3.7, (r"[0-9]", r"[A-Z]", r"[a-z]")),
    CharClass("entropy_base64", r"[A-Za-z0-9+/_=-]+", 32, 4.1, (r"[0-9]", r"[A-Z]", r"[a-z]")),
)
KINDS = BASE + tuple(c.name for c in CLASSES)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
_RUNS = {c.name: re.compile(c.run) for c in CLASSES}
_HOLDS = {c.name: [re.compile(h) for h in c.holds] for c in CLASSES}

#: Words before a candidate that say it is a digest or a number in public, and such after which data are embedded.
ALLOWED_BEFORE = re.compile(r"(?i:sha-?(?:1|224|256|384|512)|md5|checksum|digest|integrity|commit|revision|fingerprint|etag|uuid|guid|base64,)[^A-Za-z0-9]{0,4}$")
#: Strings that are no secrets: examples, runs of the alphabet or the digits, addresses, lists of words.
ALLOWED = re.compile(r"(?i:example|sample|dummy|placeholder|changeme|abcdefgh|01234567|12345678|deadbeef)|(.)\1{5}")
_ADDRESS = re.compile(r"(?:https?|ftp|file)://\S*$|www\.\S*$")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_WORDS = re.compile(r"(?:^|[+/_=-]|(?<=[a-z0-9])(?=[A-Z]))(?:[A-Z]?[a-z]{3,}|[A-Z]{3,}|[0-9]{1,4})(?=$|[+/_=-]|[A-Z0-9])")
#: Characters before a candidate that the allow-list looks at.
BEFORE = 64


def window_bits(run: str, window: int) -> Iterator[float]:
    """The Shannon entropy of each window of a run, in bits a sign.

    The sum of c * log2(c) over the window's counts c changes at two counts from one window to the next.
    """
    steps = [0.0, 0.0, *(c * math.log2(c) for c in range(2, window + 1))]
    counts: dict[str, int] = {}
    total, most = 0.0, math.log2(window)
    for k, sign in enumerate(run):
        if k >= window:
            gone = run[k - window]
            c = counts[gone]
            counts[gone] = c - 1
            total += steps[c - 1] - steps[c]
        c = counts.get(sign, 0)
        counts[sign] = c + 1
        total += steps[c + 1] - steps[c]
        if k >= window - 1:
            yield most - total / window


def random_spans(run: str, kind: CharClass) -> list[tuple[int, int, float]]:
    """(start, end, highest bits) of each stretch of a run that windows at or above the threshold cover; one that covers half of the run is the whole run."""
    out: list[tuple[int, int, float]] = []
    for k, bits in enumerate(window_bits(run, kind.window)):
        if bits < kind.least_bits or not all(h.search(run, k, k + kind.window) for h in _HOLDS[kind.name]):
            continue
        start, _, top = out.pop() if out and k <= out[-1][1] else (k, k, 0.0)
        out.append((start, k + kind.window, max(top, bits)))
    for start, end, top in out:
        if 2 * (end - start) >= len(run):
            return [(0, len(run), top)]
    return out


def allowed_place(text: str, start: int, end: int, known: frozenset[str] = frozenset()) -> bool:
    """Whether the allow-list suppresses a whole candidate: a known string, an address, a digest that is called one."""
    found, before = text[start:end], text[max(0, start - BEFORE) : start]
    return bool(found in known or _UUID.fullmatch(found) or ALLOWED_BEFORE.search(before) or _ADDRESS.search(before))


def allowed_string(found: str) -> bool:
    """Whether the allow-list suppresses a span: an example, or words for the greater part."""
    return bool(ALLOWED.search(found)) or 2 * sum(len(m[0]) for m in _WORDS.finditer(found)) > len(found)


def find_secrets(text: str | None, known: frozenset[str] = frozenset()) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, bits) by start, then by kind as listed; offsets are code points, end exclusive.

    The spans of the base kinds always stay. Those that entropy adds are left out where the allow-list knows them and
    where they touch a span of a base kind or of a narrower class.
    """
    text = text or ""
    out: list[tuple[str, int, int, float]] = []
    low = text.encode("utf-8", "surrogatepass").lower()  # ASCII letters only
    if b"pass" in low or b"secret" in low or b"token" in low or b"api" in low:
        out += [("assign", *m.span(), 0.0) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", *m.span(), 0.0) for m in ACCESS.finditer(text)]
    candidates = [m.span() for m in CANDIDATE.finditer(text)]
    out += [("hex", *m.span(), 0.0) for a, b in candidates if b - a >= 32 for m in HEX.finditer(text, a, b)]
    out = [(kind, a, b, entropy(text[a:b])) for kind, a, b, _ in out]
    base = sorted((a, b) for _, a, b, _ in out)
    at = 0
    for start, end in candidates:
        while at < len(base) and base[at][1] <= start:
            at += 1
        taken = []
        for a, b in base[at:]:
            if a >= end:
                break
            taken.append((a, b))
        if taken and taken[0][0] <= start and taken[0][1] >= end or allowed_place(text, start, end, known):
            continue
        for kind in CLASSES:
            for run in _RUNS[kind.name].finditer(text, start, end):
                if len(run[0]) < kind.window:
                    continue
                for a, b, bits in random_spans(run[0], kind):
                    a, b = run.start() + a, run.start() + b
                    if not any(a < y and x < b for x, y in taken) and not allowed_string(text[a:b]):
                        taken.append((a, b))
                        out.append((kind.name, a, b, bits))
    order = {k: n for n, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[1], order[s[0]], s[2]))


def entropy(found: str) -> float:
    """Bits a sign of a whole string."""
    counts = {c: found.count(c) for c in set(found)}
    return max(0.0, math.log2(len(found)) - sum(c * math.log2(c) for c in counts.values()) / len(found)) if found else 0.0


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("bits", T.DoubleType())])


def scan_secrets(df: DataFrame, text: str = "text", keep_text: bool = True, known: frozenset[str] = frozenset()) -> DataFrame:
    """Adds `secrets`: the spans of each whole text, with the entropy of the span or of its most random window.

    `known` strings are allowed besides the fixed allow-list. Null and empty texts have no spans; repeated rows are
    scanned each; a column named secrets is replaced. Without keep_text the text column is dropped and not sent
    back. One pass over the rows, no shuffle, and time linear in a text of any length.
    """
    df = df.drop("secrets")
    fields = [f for f in df.schema.fields if keep_text or f.name != text]
    schema = T.StructType(fields + [T.StructField("secrets", T.ArrayType(SPAN))])
    to = arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                spans = [[dict(zip(("kind", "start", "end", "bits"), s, strict=True)) for s in find_secrets(t, known)] for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(spans, type=to.field("secrets").type)], schema=to)

    return bounded(df).mapInArrow(scan, schema)


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_digest(spans: Column) -> Column:
    """sha256 of the base kinds' spans as written."""
    return F.sha2(written(F.filter(spans, lambda s: s["kind"].isin(*BASE))), 256)
