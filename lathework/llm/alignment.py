"""Alignment of two tokenizers' tokens, and how often their ids are linked in a corpus.

Each byte of a text gets a label: whether a token of A ends there, one of B, both or none. A regular expression scans
the label string and extracts spans that reach up to a byte where both end; the labels counted in a span tell how many
tokens of each side form its group.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, bounded, slices, stash
from .token_counts import byte_letters

#: Labels of a byte: no token ends, one of A, one of B, both.
NONE, A_END, B_END, BOTH = b"-AB|"
SPAN = re.compile(rb"[-AB]*\|")
#: Characters of new words that are tokenized at once.
SEGMENT = 1 << 15
#: Distinct words, and ids of theirs, that a worker keeps.
MOST_WORDS, MOST_IDS = 1 << 19, 1 << 23
#: Id pairs of a group that are listed at once.
PAIRS = 1 << 20
#: Rows (about 24 bytes) up to which the table of id pairs is broadcast; a larger one is joined by shuffling.
BROADCAST_PAIRS = 1 << 21
#: Copies of the pair table in that shuffle, over which the links of a frequent pair are dealt.
SALTS = 16

GROUPS = T.ArrayType(T.StructType([T.StructField("a", T.ArrayType(T.IntegerType())), T.StructField("b", T.ArrayType(T.IntegerType()))]))
LINKS = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("n", T.LongType())]))


#: Where a text is cut into words: single spaces between other signs. No token of either side spans such a place: a word
#: of A starts with the space, and B's pieces (checked when they are loaded) have their space sign in front. So each
#: distinct word is tokenized once, B adding the space itself, and the words' groups in order are the text's.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_NO_IDS = np.empty(0, dtype=np.int32)


class Ragged:
    """Arrays of many words, one after the other."""

    def __init__(self, dtype: type) -> None:
        self.values, self.ends = np.empty(0, dtype=dtype), np.zeros(1, dtype=np.int64)

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values = np.concatenate([self.values, values])
        self.ends = np.concatenate([self.ends, self.ends[-1] + sizes.cumsum()])

    def take(self, which: np.ndarray) -> np.ndarray:
        """The values of these words in order."""
        size = self.ends[which + 1] - self.ends[which]
        total = size.cumsum()
        return self.values[np.repeat(self.ends[which] - total + size, size) + np.arange(total[-1] if len(total) else 0)]


@dataclass(frozen=True)
class Aligned:
    """A text's ids of both sides, the tokens of each side in each group, and its distinct links with their token pairs."""

    a: np.ndarray
    b: np.ndarray
    of_a: np.ndarray
    of_b: np.ndarray
    links: np.ndarray
    n: np.ndarray


class Aligner:
    """Both tokenizers with the bytes of each of their tokens, and the aligned words that were met so far."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        entries = {k: bytes(letters[c] for c in t) for t, k in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        self.bytes_a = [entries.get(k, b"") for k in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        # A space inside a piece, or an A that does not cut words off at spaces, would make the words of a text depend on each other.
        self.cuts = not any(" " in p.replace("▁", " ").lstrip(" ") for p in pieces) and [t for t, _ in self.a.pre_tokenizer.pre_tokenize_str("x y")] == ["x", "Ġy"]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.sound = np.empty(0, dtype=bool)
        self.ids_a, self.ids_b, self.of_a, self.of_b = (Ragged(t) for t in (np.int32, np.int32, np.int64, np.int64))

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the ids of A for a space and the text, and those of B for the text; none where the bytes of either are not those of a space and the text."""
        sides = [[e.ids for e in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)]
        out = []
        for text, *pair in zip(texts, *sides, strict=True):
            whole = f" {text}".encode()
            same = text and all(b"".join(map(names.__getitem__, ids)) == whole for ids, names in zip(pair, (self.bytes_a, self.bytes_b), strict=True))
            out.append(tuple(np.array(ids, dtype=np.int32) for ids in pair) if same else (_NO_IDS, _NO_IDS))
        return out

    def labels(self, a: np.ndarray, b: np.ndarray) -> bytes:
        """The label of each byte."""
        ends = self.size_a[a].cumsum() - 1, self.size_b[b].cumsum() - 1
        marks = np.zeros(int(ends[0][-1]) + 1 if len(a) else 0, dtype=np.uint8)
        marks[ends[0]] = 1
        marks[ends[1]] += 2
        return np.frombuffer(bytes([NONE, A_END, B_END, BOTH]), dtype=np.uint8)[marks].tobytes()

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of A, tokens of B and bytes in each group, in order."""
        spans = SPAN.findall(self.labels(a, b))
        both = 1  # the label that closes a span
        of_a = np.array([s.count(A_END) + both for s in spans], dtype=np.int64)
        of_b = np.array([s.count(B_END) + both for s in spans], dtype=np.int64)
        return of_a, of_b, np.array([len(s) for s in spans], dtype=np.int64)

    def _learn(self, words: list[str]) -> None:
        """Aligns new words. Joined by spaces they are tokenized together, unless a word among them doesn't come back byte by byte."""
        runs: list[list[str]] = [[]]
        room = SEGMENT
        for w in words:
            if room < 0 or not self.cuts or w[:1].isspace() or w[-1:].isspace():  # at whose edge a space would not stand alone
                runs.append([])
                room = SEGMENT
            runs[-1].append(w)
            room = room - len(w) if not w[-1:].isspace() else -1
        runs = [r for r in runs if r]
        again: list[str] = []
        for run, (a, b) in zip(runs, self.ids([" ".join(r) for r in runs]), strict=True):
            if len(a) or len(run) == 1:
                self._keep(run, a, b)
            else:
                again += run
        for run, (a, b) in zip(again, self.ids(again), strict=True) if again else ():
            self._keep([run], a, b)

    def _keep(self, words: list[str], a: np.ndarray, b: np.ndarray) -> None:
        """Takes a run of words apart again: all of them end where groups end."""
        of_a, of_b, size = self.groups(a, b)
        cut = np.zeros(len(words) + 1, dtype=np.int64)  # groups before each word
        if len(a):
            cut[1:] = np.searchsorted(size.cumsum(), np.cumsum([1 + len(w.encode()) for w in words])) + 1
        for ids, of, of_ids in ((a, of_a, self.ids_a), (b, of_b, self.ids_b)):
            of_ids.add(ids, np.diff(np.concatenate([[0], of.cumsum()])[cut]))
        self.of_a.add(of_a, np.diff(cut))
        self.of_b.add(of_b, np.diff(cut))
        self.sound = np.append(self.sound, np.full(len(words), bool(len(a))))
        for w in words:
            self.known[w] = len(self.known)

    def align(self, texts: list[str | None]) -> list[Aligned]:
        """All texts; those without tokens have empty arrays."""
        if len(self.known) > MOST_WORDS or len(self.ids_a.values) > MOST_IDS:
            self._clear()
        words = [(_CUT.split(t) if self.cuts else [t]) if t else [] for t in texts]
        new = [w for w in dict.fromkeys(w for ws in words for w in ws) if w not in self.known]
        if new:
            self._learn(new)
        out = []
        for ws in words:
            which = np.array([self.known[w] for w in ws], dtype=np.int64)
            if not self.sound[which].all():
                which = which[:0]
            a, b, of_a, of_b = (r.take(which) for r in (self.ids_a, self.ids_b, self.of_a, self.of_b))
            out.append(Aligned(a, b, of_a, of_b, *linked(a, b, of_a, of_b)))
        return out


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker and pair of files."""
    return Aligner(path_a, path_b)


def linked(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct id pairs (a << 32 | b) of tokens that share a group, ascending, and how many token pairs each stands for.

    The pairs of a large group are counted from its distinct ids; those of all others are listed some at a time.
    """
    start_a, start_b = (np.concatenate([[0], x.cumsum()[:-1]]).astype(np.int64) for x in (of_a, of_b))
    total = of_a * of_b
    keys, counts = [], []
    for g in np.flatnonzero(total > 64):
        (x, nx), (y, ny) = (np.unique(t[s[g] : s[g] + n[g]], return_counts=True) for t, s, n in ((a, start_a, of_a), (b, start_b, of_b)))
        most = max(1, PAIRS // len(y))
        for at in range(0, len(x), most):
            keys.append(((x[at : at + most].astype(np.int64)[:, None] << 32) | y).reshape(-1))
            counts.append((nx[at : at + most, None] * ny).reshape(-1))
            if sum(map(len, keys)) > 4 * PAIRS:
                keys, counts = ([x] for x in _summed(keys, counts))
    small = np.flatnonzero(total <= 64)
    for some in np.array_split(small, max(1, -(-int(total[small].sum()) // PAIRS))):
        of = np.repeat(np.arange(len(some)), total[some])
        place = np.arange(len(of)) - np.repeat(total[some].cumsum() - total[some], total[some])
        wide = of_b[some][of]
        keys.append((a[start_a[some][of] + place // np.maximum(wide, 1)].astype(np.int64) << 32) | b[start_b[some][of] + place % np.maximum(wide, 1)])
        counts.append(np.ones(len(of), dtype=np.int64))
    return _summed(keys, counts)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    known, which = np.unique(np.concatenate(keys), return_inverse=True)
    return known, np.bincount(which, np.concatenate(counts), len(known)).astype(np.int64)


def align_tokens(df: DataFrame, path_a: str, path_b: str, text: str = "text", keep_text: bool = True, keep_groups: bool = True, derive: Callable[[list[Aligned]], dict[str, pa.Array]] | None = None, derived: T.StructType | None = None) -> DataFrame:
    """Adds `groups` (the ids of A and of B in each smallest run of bytes that tokens of both fill) and `links`.

    A is the tokenizers file `path_a`, a byte-level BPE, and reads a space and the text; B is the sentencepiece model
    `path_b`, which adds that space itself. Special strings in a text are plain text. `links` has each distinct pair
    of an A id and a B id that share a group, with `n`, the number of their token pairs. `derive` makes columns of the
    schema `derived` from the aligned rows of a batch inside the task, where the groups need not be sent back
    (keep_groups false).

    Null and empty texts have no groups and no links, and so have texts that one of the two doesn't give back byte by
    byte. Repeated rows are aligned each; columns of the names that are added are replaced. One pass without a
    shuffle; a long text is tokenized in words, cut where no token can span, so memory grows with its ids alone.
    """
    more = [T.StructField("groups", GROUPS)] * keep_groups + [T.StructField("links", LINKS)] + (list(derived.fields) if derived else [])
    df = df.drop(*[f.name for f in more], "groups")
    fields = [f for f in df.schema.fields if keep_text or f.name != text]
    schema = T.StructType(fields + more)
    to = arrow_schema(schema)

    def listed(flat: pa.Array, sizes: list[int] | np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)

    def columns(rows: list[Aligned]) -> dict[str, pa.Array]:
        out = derive(rows) if derive else {}
        if keep_groups:
            sides = [listed(pa.array(np.concatenate([getattr(r, k) for r in rows]), pa.int32()), np.concatenate([getattr(r, f"of_{k}") for r in rows])) for k in "ab"]
            out["groups"] = listed(pa.StructArray.from_arrays(sides, fields=list(to.field("groups").type.value_type)), [len(r.of_a) for r in rows])
        keys = np.concatenate([r.links for r in rows])
        flat = [pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(np.concatenate([r.n for r in rows]))]
        out["links"] = listed(pa.StructArray.from_arrays(flat, fields=list(to.field("links").type.value_type)), [len(r.links) for r in rows])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = aligner(path_a, path_b)
        for batch in batches:
            for part in slices(batch, text):
                made = columns(machine.align(part.column(text).to_pylist()))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), *(made[f.name].cast(to.field(f.name).type) for f in more)], schema=to)

    return bounded(df).mapInArrow(run, schema)


def count_links(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows with `links`: their table, written and numbered, and (a, b, docs, best) for each id pair.

    `docs` is the number of rows that hold the pair, `best` whether no other pair of the same A id is in more. Pairs
    are counted in each task before the shuffle, so a pair that all documents hold costs a row a task.
    """
    rows = stash(df.select(F.monotonically_increasing_id().alias("number"), F.struct(*[c for c in df.columns if c != "links"]).alias("row"), "links"))
    counts = stash(rows.select(F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.count("*").alias("docs")))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return rows, stash(counts.join(most, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best")))


def score_links(df: DataFrame) -> DataFrame:
    """Replaces `links` by `n_best`, the token pairs whose ids are a best pair, and `count_sum`, the sum of their pairs' `docs`.

    Rows are documents of their own, also where they are equal; rows without links (or null ones) get zeros. Columns
    of these two names are replaced. All other columns are carried through a shuffle, so leave texts out. The pair
    table is broadcast only up to BROADCAST_PAIRS rows, which is checked; a larger one is joined by shuffling, with
    the links of each pair dealt over SALTS copies.
    """
    rows, pairs = count_links(df.drop("n_best", "count_sum"))
    links = rows.select("number", F.explode("links").alias("l")).select("number", "l.*")
    if pairs.count() <= BROADCAST_PAIRS:
        found = links.join(F.broadcast(pairs), ["a", "b"])
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        found = links.withColumn("salt", F.pmod("number", F.lit(SALTS)).cast("int")).join(pairs.withColumn("salt", salt), ["a", "b", "salt"])
    sums = found.groupBy("number").agg(F.sum(F.when(F.col("best"), F.col("n"))).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.drop("links").join(sums, "number", "left").select("row.*", *[F.coalesce(c, zero).alias(c) for c in ("n_best", "count_sum")])


SUMMARY = T.StructType([T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")] + [T.StructField("written_sha256", T.StringType())])


@lru_cache(maxsize=1)
def _names(most: int) -> list[str]:
    """Each id followed by each of the signs of written()."""
    return [f"{k}{sign}" for k in range(most) for sign in ",|;"]


def written(row: Aligned) -> str:
    """`a1,a2|b1;a3|b2,b3`: the ids of each group in order."""
    if not len(row.a):
        return ""
    codes = np.empty(len(row.a) + len(row.b), dtype=np.int64)
    for ids, of, before, sign in ((row.a, row.of_a, row.of_b.cumsum() - row.of_b, 1), (row.b, row.of_b, row.of_a.cumsum(), 2)):
        code = 3 * ids.astype(np.int64)
        code[of.cumsum() - 1] += sign  # the last of its group
        codes[np.arange(len(ids)) + np.repeat(before, of)] = code
    return "".join(map(_names(int(codes.max()) // 3 + 1 | 0xFFFF).__getitem__, codes.tolist()))[:-1]


def summarized(rows: list[Aligned]) -> dict[str, pa.Array]:
    """Columns SUMMARY, for derive: tokens of each side, groups, token pairs, and the sha256 of written() (empty without tokens)."""
    sums = {"n_a": [len(r.a) for r in rows], "n_b": [len(r.b) for r in rows], "n_groups": [len(r.of_a) for r in rows], "n_links": [int(r.of_a @ r.of_b) for r in rows]}
    texts = map(written, rows)
    return {**{k: pa.array(v, pa.int64()) for k, v in sums.items()}, "written_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts], pa.string())}
