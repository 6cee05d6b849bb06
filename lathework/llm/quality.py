"""Quality rules as a short-circuit cascade, ordered by rejections per second of work."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_schema, bounded, slices, sums, words_of

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BLANK = " \t\n\x0b\x0c\r"


class Texts:
    """Statistics of a run of texts, each computed at most once and only for the rows that ask for it."""

    def __init__(self, texts: pa.Array) -> None:
        self.texts = pc.fill_null(texts, "")
        self.n = len(texts)
        self._known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def get(self, name: str, rows: np.ndarray) -> np.ndarray:
        """The statistic for `rows` (increasing row numbers)."""
        values, done = self._known.setdefault(name, (np.zeros(self.n, dtype=np.int64), np.zeros(self.n, dtype=bool)))
        new = rows[~done[rows]]
        if len(new):
            values[new] = STATISTICS[name](self.texts if len(new) == self.n else self.texts.take(pa.array(new)))
            done[new] = True
        return values[rows]


def n_words(texts: pa.Array) -> np.ndarray:
    return np.diff(words_of(texts)[1])


def word_chars(texts: pa.Array) -> np.ndarray:
    words, starts = words_of(texts)
    return sums(np.asarray(pc.utf8_length(words), dtype=np.int64), starts)


def n_symbols(texts: pa.Array) -> np.ndarray:
    joined = "\n".join(texts.to_pylist()).encode()
    ends = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64) + 1)
    return sums(np.concatenate([_SYMBOL[np.frombuffer(joined, dtype=np.uint8)], [False]]), np.concatenate([[0], ends]))


def _lines(texts: pa.Array) -> Iterator[list[str]]:
    for t in texts.to_pylist():
        yield [x for x in t.split("\n") if x.strip(_BLANK)]


def n_lines(texts: pa.Array) -> np.ndarray:
    return np.array([len(x) for x in _lines(texts)], dtype=np.int64)


def n_dup_lines(texts: pa.Array) -> np.ndarray:
    return np.array([len(x) - len(set(x)) for x in _lines(texts)], dtype=np.int64)


def n_repeat_words(texts: pa.Array) -> np.ndarray:
    """Words that lie in a three-word window found twice or more in their text."""
    words, starts = words_of(texts)
    encoded = words.dictionary_encode() if len(words) else None
    marked = np.zeros(len(words), dtype=bool)
    if len(words) > 3:
        ids = np.asarray(encoded.indices, dtype=np.int64)
        size = len(encoded.dictionary)
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        at = np.flatnonzero(doc[2:] == doc[:-2])
        pairs = np.unique(ids[at] * size + ids[at + 1], return_inverse=True)[1]
        key = pairs * size + ids[at + 2]  # exact: below the square of the slice's words
        order = np.argsort(key, kind="stable")
        key, where = key[order], at[order]
        twin = np.flatnonzero((key[1:] == key[:-1]) & (doc[where[1:]] == doc[where[:-1]]))
        found = np.concatenate([where[twin], where[twin + 1]])
        for k in range(3):
            marked[found + k] = True
    return sums(marked, starts)


def n_shouted(texts: pa.Array) -> np.ndarray:
    """Words of two letters or more, all of them upper case."""
    words, starts = words_of(texts)
    upper = np.asarray(pc.and_(pc.utf8_is_upper(words), pc.greater(pc.utf8_length(words), 1)))
    return sums(upper, starts)


STATISTICS: dict[str, Callable[[pa.Array], np.ndarray]] = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_lines": n_lines,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
    "n_shouted": n_shouted,
}


@dataclass(frozen=True)
class Rule:
    """Rejects where `fails` is true of the named statistics. A `base` rule alone makes base_failed."""

    name: str
    uses: tuple[str, ...]
    fails: Callable[..., np.ndarray]
    base: bool = False


RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 50, True),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 50 * n, True),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < 2 * n) | (c > 12 * n)),
    Rule("duplicate_lines", ("n_dup_lines", "n_lines"), lambda d, n: (d >= 3) & (10 * d > 3 * n)),
    Rule("shouting", ("n_shouted", "n_words"), lambda s, n: 2 * s > n),
)


def _trial(df: DataFrame, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """Seconds and rejections of every rule on its own, summed over each task's rows."""
    to = pa.schema([("rule", pa.int32()), ("seconds", pa.float64()), ("rows", pa.int64()), ("rejected", pa.int64())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, seen, out = np.zeros(len(rules)), 0, np.zeros(len(rules), dtype=np.int64)
        for batch in batches:
            for part in slices(batch, text):
                every = np.arange(part.num_rows)
                seen += part.num_rows
                for k, rule in enumerate(rules):
                    fresh, began = Texts(part.column(text)), time.perf_counter()
                    out[k] += int(rule.fails(*[fresh.get(s, every) for s in rule.uses]).sum())
                    spent[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rules), dtype=np.int32)), pa.array(spent), pa.array(np.full(len(rules), seen)), pa.array(out)], schema=to)

    return bounded(df.select(text)).mapInArrow(measure, "rule int, seconds double, rows long, rejected long")


def order_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, fraction: float = 0.01, seed: int = 5) -> tuple[Rule, ...]:
    """The rules by rejections per second on a random sample of the rows, highest first.

    Rows that no rule rejects cost the same in any order, so this greedy order keeps the expected cost low.
    Times differ between runs and so may the order; verdicts do not depend on it.
    """
    found = _trial(df.sample(False, fraction, seed), text, rules).groupBy("rule").sum("seconds", "rejected").collect()
    gain = {r[0]: (r[2] + 0.5) / (r[1] + 1e-6) for r in found}
    return tuple(rules[k] for k in sorted(range(len(rules)), key=lambda k: -gain.get(k, 0.0)))


def cascade(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] | None = None, report: tuple[str, ...] = (), keep_text: bool = True, keep_rejected: bool = True) -> DataFrame:
    """Adds `kept`, `base_failed`, `failed_rule` (the first that rejected; null if kept), `n_rules` (rules tried) and the statistics in `report`.

    Each rule sees only the rows that the rules before it have let through. With "n_words" and
    "n_repeat_words" reported, base_failed is known for all rows; otherwise it is null where the cascade
    stopped before the base rules. Null texts count as empty; an empty text fails on its words. Repeated
    rows get the same verdict. Columns of these names are replaced. Without keep_rejected only rows that are
    kept come back. One pass, no shuffle.
    """
    rules = rules or order_rules(df, text)
    df = df.drop("kept", "base_failed", "failed_rule", "n_rules", *report)
    fields = [f for f in df.schema.fields if keep_text or f.name != text]
    added = [T.StructField("kept", T.BooleanType()), T.StructField("base_failed", T.BooleanType()), T.StructField("failed_rule", T.StringType()), T.StructField("n_rules", T.IntegerType())]
    schema = T.StructType(fields + added + [T.StructField(s, T.LongType()) for s in report])
    to = arrow_schema(schema)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                block, left = Texts(part.column(text)), np.arange(part.num_rows)
                failed, tried = np.full(part.num_rows, -1), np.zeros(part.num_rows, dtype=np.int32)
                for k, rule in enumerate(rules):
                    tried[left] += 1
                    bad = rule.fails(*[block.get(s, left) for s in rule.uses])
                    failed[left[bad]] = k
                    left = left[~bad]
                every = np.arange(part.num_rows)
                stats = {s: block.get(s, every) for s in report}
                known, base = np.ones(part.num_rows, dtype=bool), np.zeros(part.num_rows, dtype=bool)
                for k, rule in enumerate(rules):
                    if not rule.base:
                        continue
                    if set(rule.uses) <= set(report):
                        base |= rule.fails(*[stats[s] for s in rule.uses])
                    else:
                        base |= failed == k
                        known &= (failed < 0) | (failed >= k)
                names = [r.name for r in rules]
                cols = [part.column(f.name) for f in fields]
                cols += [pa.array(failed < 0), pa.array(base, mask=~(known | base)), pa.array([names[k] if k >= 0 else None for k in failed], type=to.field("failed_rule").type), pa.array(tried)]
                cols += [pa.array(stats[s]) for s in report]
                out = pa.RecordBatch.from_arrays(cols, schema=to)
                yield out if keep_rejected else out.filter(pa.array(failed < 0))

    return bounded(df).mapInArrow(judge, schema)
