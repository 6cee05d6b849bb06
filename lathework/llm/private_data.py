"""Personal data: regular expressions propose spans, validators confirm them, context words adjust a score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, bounded, slices


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: country and check digits go last, letters count from 10, the remainder is 1."""
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def digits_of(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def ip_parts(span: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in span.split("."))


def social_security(span: str) -> bool:
    a, b, c = span.split("-")
    return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    `base` spans stay whatever their score; the spans of other kinds need `threshold`. A confirmed span
    scores `score`, plus `lift` if one of `context` stands within `window` characters of it.
    """

    name: str
    pattern: str
    confirm: object = None
    base: bool = True
    score: float = 0.6
    lift: float = 0.35
    context: tuple[str, ...] = ()
    window: int = 48
    threshold: float = 0.5
    group: int = 0
    needs: str = ""


#: The kinds that must be found and their patterns. Runs of digits start where no digit stands before
#: them, which finds the same leftmost matches in linear time.
BASE = (
    Kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", context=("mail", "contact", "@"), score=0.9, needs="@"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ip_parts, context=("ip", "host", "address", "server"), score=0.7, needs="."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])+", lambda s: 13 <= len(d := digits_of(s)) <= 19 and luhn(d), context=("card", "visa", "credit", "payment"), score=0.7),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits_of(s)) <= 15, context=("phone", "tel", "call", "mobile", "fax"), score=0.7, needs="+"),
)
#: Kinds that the scoring adds. The weak ones need a context word.
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", mod97, False, 0.6, 0.3, ("iban", "account", "bank")),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", social_security, False, 0.3, 0.4, ("ssn", "social security"), needs="-"),
    Kind("secret", r"(?i:token|secret|password|api[_-]?key)[\"']?\s{0,4}[:=]\s{0,4}[\"']?([A-Za-z0-9+/_.-]{16,})", lambda s: any(c.isdigit() for c in s) and any(c.isalpha() for c in s), False, 0.6, 0.2, ("token", "key", "secret"), group=1),
)
KINDS = BASE + ADDED
NAMES = {k.name: n for n, k in enumerate(KINDS)}

_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_COMPILED = {k.name: re.compile(k.pattern) for k in KINDS}


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, found from each @ so that long words cost linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        m = _EMAIL_DOMAIN.match(text, at)
        start = at
        if m:
            while start > done and text[start - 1] in _EMAIL_LOCAL:
                start -= 1
        if m and start < at:
            done = m.end()
            yield start, done
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def find_spans(text: str | None, kinds: tuple[Kind, ...] = KINDS) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in the order of the kinds, then by start; offsets are code points, end exclusive."""
    out = []
    text = text or ""
    for kind in kinds:
        if kind.needs and kind.needs not in text:
            continue
        if kind.name == "email":
            found = _emails(text)
        else:
            found = (m.span(kind.group) for m in _COMPILED[kind.name].finditer(text))
        for a, b in found:
            if kind.confirm and not kind.confirm(text[a:b]):
                continue
            score = kind.score
            if kind.context:
                near = f"{text[max(0, a - kind.window) : a]} {text[b : b + kind.window]}".lower()
                score += kind.lift * any(w in near for w in kind.context)
            if kind.base or score >= kind.threshold:
                out.append((kind.name, a, b, min(1.0, score)))
    return out


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def redact(text: str | None, spans: list[tuple]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    if not spans:
        return text
    merged: list[list] = []
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2], NAMES[s[0]])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    out, at = [], 0
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])


def detect_private_data(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds `pii` (spans with scores) and, with keep_text, `redacted` (the text with spans replaced).

    Null and empty texts have no spans and stay as they are; repeated rows are scanned each. Columns named
    pii or redacted are replaced. Without keep_text the text column is dropped and not sent back. One pass
    over the rows, no shuffle; a text of any length is scanned in time linear in it.
    """
    df = df.drop("pii", "redacted")
    fields = [f for f in df.schema.fields if keep_text or f.name != text]
    schema = T.StructType(fields + [T.StructField("pii", T.ArrayType(SPAN))] + ([T.StructField("redacted", T.StringType())] if keep_text else []))
    to = arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(text).to_pylist()
                spans = [find_spans(t) for t in texts]
                cols = [part.column(f.name) for f in fields]
                cols.append(pa.array([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in x] for x in spans], type=to.field("pii").type))
                if keep_text:
                    cols.append(pa.array([redact(t, s) for t, s in zip(texts, spans, strict=True)], type=to.field("redacted").type))
                yield pa.RecordBatch.from_arrays(cols, schema=to)

    return bounded(df).mapInArrow(scan, schema)


def base_digest(spans: F.Column) -> F.Column:
    """sha256 of kind:start:end of the base kinds' spans, comma-joined."""
    base = F.filter(spans, lambda s: s["kind"].isin(*[k.name for k in BASE]))
    return F.sha2(written(base), 256)


def written(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: F.Column, kind: str) -> F.Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
