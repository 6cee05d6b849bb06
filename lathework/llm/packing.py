"""Packing documents into fixed windows by lexical retrieval.

The documents of a task are gathered into shards of a few million tokens, each with an inverted index of
its own. A seed document asks the index for the unused documents most like it by BM25; these fill the
seed's window one after the other, as many as it takes, and the last one is cut where the window ends. What
is left of it seeds the next window, so only a shard's last window is ever short. Where no unused document
shares a term with the seed, the next one in input order goes on as the seed.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_schema, bounded, slices
from .token_counts import compiled

#: Tokens of a shard (one more document may stand over). A shard is what one task holds at a time.
SHARD_TOKENS = 1_000_000
#: Neighbours in the first page of a search.
NEIGHBOURS = 32
#: The most frequent terms, each in an eighth of a shard's documents or more, have a full row of weights, up to this many cells.
DENSE_CELLS = 4 << 20
#: The usual BM25 parameters.
K1, B = 1.2, 0.75

PIECES = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


class Bm25:
    """Inverted index of a shard: for each token, its documents with their BM25 weights."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray) -> None:
        self.ids, self.starts, self.asked = ids, starts, -1
        n = len(starts) - 1
        length = np.diff(starts)
        key = ids.astype(np.int64)
        key *= n
        key += np.repeat(np.arange(n, dtype=np.int32), length)
        key, often = np.unique(key, return_counts=True)
        term, doc = (key // n).astype(np.int32), (key % n).astype(np.int32)
        self.terms, first, spread = np.unique(term, return_index=True, return_counts=True)
        idf = np.log1p((n - spread + 0.5) / (spread + 0.5))
        damp = K1 * (1 - B + B * length / max(1.0, length.mean()))
        weight = np.repeat(idf, spread) * often * (K1 + 1) / (often + damp[doc])
        # Rows of the index are documents by place; those used up are taken out from time to time.
        self.place = np.arange(n)
        common = np.argsort(-spread, kind="stable")[: DENSE_CELLS // max(1, n)]
        common = common[8 * spread[common] >= n]
        self.row = np.full(len(self.terms), -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), n))
        for k, t in enumerate(common.tolist()):
            at = slice(first[t], first[t] + spread[t])
            self.dense[k, doc[at]] = weight[at]
        # A term of one document scores that document alone, which is never its own neighbour.
        listed = (self.row < 0) & (spread > 1)
        kept = np.repeat(listed, spread)
        self.doc, self.weight = doc[kept], weight[kept]
        self.first = np.concatenate([[0], np.cumsum(np.where(listed, spread, 0))])

    def narrow(self, unused: np.ndarray) -> None:
        """Takes the used documents out of the index where they are half of it. Weights stay those of the whole shard."""
        kept = unused[self.place]
        if 2 * np.count_nonzero(kept) > len(kept):
            return
        self.asked = -1
        to = np.cumsum(kept) - 1
        posted = kept[self.doc]
        self.first = np.concatenate([[0], np.cumsum(posted)])[self.first]
        self.doc, self.weight = to[self.doc[posted]], self.weight[posted]
        self.dense, self.place = self.dense[:, kept], self.place[kept]

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of each document of the index for all distinct terms of the seed."""
        mine = np.searchsorted(self.terms, np.unique(self.ids[self.starts[seed] : self.starts[seed + 1]]))
        lo, size = self.first[mine], self.first[mine + 1] - self.first[mine]
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        # Added term by term in both parts, so that equal documents have equal scores.
        score = np.bincount(self.doc[at], weights=self.weight[at], minlength=len(self.place)).astype(np.float64)
        for k in self.row[mine][self.row[mine] >= 0].tolist():
            score += self.dense[k]
        return score

    def neighbours(self, seed: int, unused: np.ndarray, most: int = NEIGHBOURS) -> np.ndarray:
        """The `most` unused documents with the highest scores, best first, ties by place; none that shares no term."""
        if seed != self.asked:
            self.asked, self.score = seed, self.scores(seed)
        found = np.flatnonzero(unused[self.place] & (self.score > 0))
        score = self.score[found]
        if len(found) > most:
            least = np.partition(score, -most)[-most]
            above, level = np.flatnonzero(score > least), np.flatnonzero(score == least)
            top = np.concatenate([above, level[: most - len(above)]])
            found, score = found[top], score[top]
        return self.place[found[np.lexsort((found, -score))]]


def pack_shard(ids: np.ndarray, starts: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of pieces that hold each id of the shard once."""
    n, length = len(starts) - 1, np.diff(starts)
    index = Bm25(ids, starts)
    unused = length > 0
    out: list[tuple[int, int, int, int, int]] = []
    sequence, room, next_seed = 0, window, 0
    doc, at = -1, 0  # the document being laid out, and how much of it is done
    seed, queue = -1, deque()  # whose neighbours fill the window, and those found so far
    most = NEIGHBOURS
    while True:
        if doc < 0 or at == length[doc]:
            if seed >= 0 and not queue:
                index.narrow(unused)
                # A document has a token at least, so a second page holds all that the window can take.
                queue, most = deque(index.neighbours(seed, unused, most).tolist()), room
            if queue:
                doc = queue.popleft()
            else:
                while next_seed < n and not unused[next_seed]:
                    next_seed += 1
                if next_seed == n:
                    return out
                doc = seed = next_seed
                most = NEIGHBOURS
            at = 0
            unused[doc] = False
        take = min(room, int(length[doc]) - at)
        out.append((doc, at, take, sequence, window - room))
        at, room = at + take, room - take
        if not room:
            sequence, room = sequence + 1, window
            seed, most = doc if at < length[doc] else -1, NEIGHBOURS
            queue.clear()


def pack(df: DataFrame, path: str, text: str = "text", window: int = 4096, end_id: int = 2) -> DataFrame:
    """The pieces of all documents: the columns of df but the text, and start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its text's by the tokenizer in `path`, then end_id; null and empty texts are just
    end_id. Each id lies in exactly one piece; a sequence's pieces are gapless from 0 and fill the window,
    but for the last sequence of a shard. ids_crc32 is of the piece's ids as little-endian 32-bit numbers.
    Repeated rows are documents of their own. Columns of these names are replaced. Documents of any length
    are cut into whole windows. No shuffle: a shard is a run of a task's rows, so a source, key or group of
    copies of any size spreads over as many shards as it has tokens for.
    """
    df = df.drop(*PIECES.fieldNames())
    fields = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType(fields + PIECES.fields)
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, task, sequence = compiled(path), TaskContext.get().partitionId() << 33, 0
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            rows = pa.Table.from_batches([h[0] for h in held]).combine_chunks()
            ids = np.concatenate([h[1] for h in held])
            starts = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(h[2]) for h in held]))])
            held.clear()
            pieces = np.array(pack_shard(ids, starts, window), dtype=np.int64).reshape(-1, 5)
            doc, at, size, seq, offset = pieces.T
            raw = ids.astype("<u4").tobytes()
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((starts[doc] + at).tolist(), (starts[doc] + at + size).tolist(), strict=True)]
            columns = [at, size, np.array(sums, dtype=np.int64), np.diff(starts)[doc], task + sequence + seq, offset]
            sequence += int(seq[-1]) + 1
            taken = rows.take(pa.array(doc)).columns if fields else []
            return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in taken), *(pa.array(c) for c in columns)], schema=to)

        waiting = 0
        for batch in batches:
            for part in slices(batch, text):
                ids, starts = tokenizer.encode(pc.fill_null(part.column(text), "").to_pylist())
                # One more id at the end of each document.
                ends = starts + np.arange(len(starts))
                full = np.full(len(ids) + part.num_rows, end_id, dtype=np.uint32)
                inner = np.ones(len(full), dtype=bool)
                inner[ends[1:] - 1] = False
                full[inner] = ids
                rows = pa.RecordBatch.from_arrays([part.column(f.name) for f in fields], names=[f.name for f in fields])
                held.append((rows, full, ends))
                waiting += len(full)
                if waiting >= SHARD_TOKENS:
                    yield flush()
                    waiting = 0
        if held:
            yield flush()

    return bounded(df).mapInArrow(run, schema)
