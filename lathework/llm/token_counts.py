"""Token counts by finite-state transducers compiled from a tokenizer.

A BPE tokenizer with a pattern that splits text into words becomes two deterministic machines:

* The splitter reads character classes and marks where words start. Its transitions generate a small
  monoid of state maps, so a text is cut into equal chunks, each chunk becomes one element, and a parallel
  prefix scan over the elements gives every chunk its entry state.
* The word transducer reads the bytes of a word. Its state holds what can still matter: the longest end of
  the word that starts some token and, for each place in it where a token may begin, the last token of the
  encoding up to there. Each transition is annotated with the change in the number of tokens emitted; the
  last byte of a word leads back to the start. Two neighbouring tokens are right if no merge of lower rank
  crosses their border, which is all that a BPE encoding has to satisfy.

Transitions are compiled when they are first needed and kept for the worker's life, up to a bound.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_schema, bounded, slices, sums

#: Code points per chunk of the splitter.
CHUNK = 256
#: The word transducer starts anew beyond so many states, which bounds its memory.
MOST_STATES = 60_000

SPACE, LETTER, NUMBER, OTHER, APOSTROPHE, ENDS, R_V, L, E = range(9)
#: Splitter states: between words, in letters, in other signs, after an apostrophe that starts a word, and after that and r or v, or l.
GAP, WORD, SIGNS, QUOTE, QUOTE_RV, QUOTE_L = range(6)


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and what starts (1: a word at this character, 2: a word at the one before) for each state and class.

    Fixed values: words are the contractions 's 't 're 've 'm 'll 'd, runs of letters, single numbers and runs of other signs.
    """
    to, out = np.zeros((6, 9), dtype=np.uint8), np.zeros((6, 9), dtype=np.uint8)
    letters = (LETTER, ENDS, R_V, L, E)
    for state in range(6):
        for c in range(9):
            if c == SPACE:
                to[state, c] = GAP
            elif c == NUMBER:
                to[state, c], out[state, c] = GAP, 1
            elif c in letters:
                to[state, c], out[state, c] = WORD, int(state != WORD)
            elif state in (SIGNS, QUOTE):
                to[state, c] = SIGNS
            else:
                to[state, c], out[state, c] = (QUOTE if c == APOSTROPHE else SIGNS), 1
    to[QUOTE, ENDS], out[QUOTE, ENDS] = GAP, 0
    to[QUOTE, R_V], out[QUOTE, R_V] = QUOTE_RV, 0
    to[QUOTE, L], out[QUOTE, L] = QUOTE_L, 0
    for state, last in ((QUOTE_RV, E), (QUOTE_L, L)):
        for c in range(9):
            if c == last:
                to[state, c], out[state, c] = GAP, 0
            elif c in letters:
                to[state, c], out[state, c] = WORD, 2
            else:  # the letter before was a word of its own
                to[state, c], out[state, c] = to[WORD, c], out[WORD, c] | 2
    return to, out


class Splitter:
    """The splitter with the monoid of its state maps."""

    def __init__(self) -> None:
        self.to, self.out = _splitter()
        known: dict[bytes, int] = {}
        maps: list[np.ndarray] = []

        def element(m: np.ndarray) -> int:
            if m.tobytes() not in known:
                known[m.tobytes()] = len(maps)
                maps.append(m)
            return known[m.tobytes()]

        self.unit = element(np.arange(6, dtype=np.uint8))
        step, k = [], 0
        while k < len(maps):
            step.append([element(self.to[maps[k], c]) for c in range(9)])
            k += 1
        self.maps, self.step = np.array(maps), np.array(step, dtype=np.int16)
        self.product = np.array([[known[b[a].tobytes()] for b in maps] for a in maps], dtype=np.int16)  # first a, then b
        # The same tables in one row, by 9 times the element or state plus the class; the latter with what starts in the two low bits.
        self.next_element = (9 * self.step).astype(np.int32).reshape(-1)
        self.next_state = (36 * self.to.astype(np.int32) + self.out).reshape(-1)

    def starts(self, classes: np.ndarray) -> np.ndarray:
        """Which characters start a word. The classes must end in a space."""
        n = len(classes)
        chunks = -(-n // CHUNK)
        grid = np.full(chunks * CHUNK, SPACE, dtype=np.uint8)
        grid[:n] = classes
        grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
        element = np.full(chunks, 9 * self.unit, dtype=np.int32)
        for row in grid:
            element = self.next_element.take(element + row)
        element //= 9
        # Parallel prefix scan: after the round with distance d, an element covers 2 d chunks.
        d = 1
        while d < chunks:
            element = np.concatenate([element[:d], self.product[element[:-d], element[d:]]])
            d *= 2
        entry = np.concatenate([[self.unit], element[:-1]])
        state = 9 * self.maps[entry, GAP].astype(np.int32)
        marks = np.empty((CHUNK, chunks), dtype=np.uint8)
        for k, row in enumerate(grid):
            found = self.next_state.take(state + row)
            marks[k] = found & 3
            state = found >> 2
        marks = marks.T.reshape(-1)[:n]
        here = (marks & 1).astype(bool)
        here[:-1] |= marks[1:] > 1
        return here


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordTransducer:
    """Bytes of a word to the number of its tokens. A symbol is a byte, plus 256 if it is the word's last."""

    def __init__(self, model: dict) -> None:
        suffix = model["end_of_word_suffix"]
        letters = byte_letters()

        def symbols(token: str) -> tuple[int, ...]:
            last = token.endswith(suffix)
            out = [letters[c] for c in (token[: -len(suffix)] if last else token)]
            if last:
                out[-1] += 256
            return tuple(out)

        ids = {symbols(t): k for t, k in model["vocab"].items()}
        self.rank: dict[tuple[int, int], int] = {}  # of the merge of two tokens
        born, parts = {}, {}  # rank of the merge that makes a token, and its two halves
        for r, (a, b) in enumerate(model["merges"]):
            x, y = symbols(a), symbols(b)
            pair = ids[x], ids[y]
            self.rank[pair] = r
            if ids[x + y] not in born:
                born[ids[x + y]], parts[ids[x + y]] = r, pair
        self.ids = {s: k for s, k in ids.items() if len(s) == 1 or k in parts}
        self.prefixes = {s[:k] for s in self.ids for k in range(1, len(s) + 1)}
        self.width = np.zeros(max(ids.values()) + 1, dtype=np.int64)  # bytes of each token
        for piece, k in ids.items():
            self.width[k] = len(piece)
        # Tokens along the right and the left edge, from the whole token inward, with the rank at which each becomes part of the next.
        self.right, self.left = {}, {}
        for k in self.ids.values():
            for edge, side in ((self.right, 1), (self.left, 0)):
                chain, at, until = [], k, len(model["merges"])
                while True:
                    chain.append((at, until))
                    if at not in parts:
                        break
                    at, until = parts[at][side], born[at]
                edge[k] = tuple(chain)
        # For a token on a right edge: what it merges with, and all beginnings of that.
        self.after: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        back = {k: s for s, k in self.ids.items()}
        for (x, y), r in self.rank.items():
            self.after.setdefault(x, []).append((r, back[y]))
        self.reach: dict[tuple[int, int], tuple[frozenset, frozenset]] = {}
        self._clear()

    def _clear(self) -> None:
        start = ((), ((0, (), 0),))
        self.states: dict[tuple, int] = {start: 0}
        self.held: list[tuple] = [start]
        self.code = np.zeros(256, dtype=np.uint8)  # bytes to columns, in order of appearance; column 0: not seen
        self.bytes: list[int] = [-1]
        # By state and byte: the next state, the change in tokens and the last token then; and the latter two for a word's last byte.
        self.next = np.full((1024, 32), -1, dtype=np.int32)
        self.change, self.final_change = (np.zeros((1024, 32), dtype=np.int8) for _ in range(2))
        self.token, self.final_token = (np.full((1024, 32), -1, dtype=np.int32) for _ in range(2))

    def _grow(self, wider: Callable[[np.ndarray], np.ndarray]) -> None:
        for name in ("next", "change", "final_change", "token", "final_token"):
            setattr(self, name, wider(getattr(self, name)))

    def _stands(self, edge: tuple[tuple[int, int], ...], b: int) -> bool:
        """Whether the border between a token with that right edge and its neighbour b survives all merges."""
        for x, until_x in edge:
            for y, until_y in self.left[b]:
                r = self.rank.get((x, y))
                # On equal ranks the left one of two overlapping merges goes first.
                if r is not None and r < until_x and r <= until_y:
                    return False
        return True

    def _relevant(self, edge: tuple[tuple[int, int], ...], piece: tuple[int, ...]) -> tuple[tuple[int, int], ...]:
        """The part of a right edge that can still merge with something in a word that goes on with `piece`."""
        out = []
        for item in edge:
            if item not in self.reach:
                whole = [y for r, y in self.after.get(item[0], ()) if r < item[1]]
                self.reach[item] = frozenset(whole), frozenset(y[:k] for y in whole for k in range(1, len(y) + 1))
            whole, begun = self.reach[item]
            if piece in begun or any(piece[:k] in whole for k in range(1, len(piece))):
                out.append(item)
        return tuple(out)

    def _read(self, state: tuple, symbol: int) -> tuple[tuple, int, int]:
        """The next state, the change in the number of tokens and the last token."""
        tail, places = state
        n = len(tail)
        ends = [(d, edge, count, tail[n - d :] + (symbol,)) for d, edge, count in places]
        for _, edge, count, piece in ends:  # the longest token whose border stands
            token = self.ids.get(piece)
            if token is not None and self._stands(edge, token):
                change = count + 1
                break
        if symbol >= 256:
            return self.held[0], change, token
        kept = [(d + 1, self._relevant(edge, piece), count - change) for d, edge, count, piece in ends if piece in self.prefixes]
        tail = tail + (symbol,)
        return (tail[len(tail) - kept[0][0] :] if kept else (), (*kept, (0, self.right[token], 0))), change, token

    def _column(self, byte: int) -> None:
        if not self.code[byte]:
            self.code[byte] = len(self.bytes)
            self.bytes.append(byte)
            if len(self.bytes) > self.next.shape[1]:
                self._grow(lambda x: np.hstack([x, np.full((len(x), 32), -1, dtype=x.dtype)]))

    def _compile(self, state: int, column: int, last: bool) -> None:
        target, change, token = self._read(self.held[state], self.bytes[column] + 256 * last)
        if last:
            self.final_change[state, column], self.final_token[state, column] = change, token
            return
        to = self.states.get(target)
        if to is None:
            to = self.states[target] = len(self.held)
            self.held.append(target)
            if to >= len(self.next):
                self._grow(lambda x: np.vstack([x, np.full_like(x, -1)]))
        self.next[state, column], self.change[state, column], self.token[state, column] = to, change, token

    def _steps(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For each byte of the words read side by side: how many words go on, how many it is the last of, their states and columns.

        Words come longest first; those that go on stand before those that end.
        """
        for b in np.unique(data):
            self._column(int(b))
        columns = self.code[data]
        alive = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), side="right")
        state = np.zeros(len(lengths), dtype=np.int64)
        for k, n in enumerate(alive):
            on = int(alive[k + 1]) if k + 1 < len(alive) else 0
            column = columns[starts[:n] + k]
            for lo, hi, table in ((on, n, "final_token"), (0, on, "token")):
                if lo < hi and len(new := np.flatnonzero(getattr(self, table)[state[lo:hi], column[lo:hi]] < 0)):
                    for key in np.unique(state[lo:hi][new] * 256 + column[lo:hi][new]):
                        self._compile(int(key) >> 8, int(key) & 255, lo == on and table == "final_token")
            yield on, n, state[:n], column
            state[:on] = self.next[state[:on], column[:on]]

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of the words at `starts` with `lengths` bytes (1 at least): the sums of their transitions' annotations."""
        if len(self.held) > MOST_STATES:
            self._clear()
        out = np.zeros(len(starts), dtype=np.int64)
        if not len(starts):
            return out
        order = np.argsort(-lengths, kind="stable")
        total = np.zeros(len(starts), dtype=np.int64)
        for on, n, state, column in self._steps(data, starts[order], lengths[order]):
            total[:on] += self.change[state[:on], column[:on]]
            total[on:n] += self.final_change[state[on:], column[on:]]
        out[order] = total
        return out

    def tokens(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' token ids in order, and the places of their last bytes: the last token at a word's end, the one before that, and so on."""
        if len(self.held) > MOST_STATES:
            self._clear()
        if not len(starts):
            return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
        last = np.zeros(len(data), dtype=np.int32)
        order = np.argsort(-lengths, kind="stable")
        first = starts[order]
        for k, (on, n, state, column) in enumerate(self._steps(data, first, lengths[order])):
            last[first[:on] + k] = self.token[state[:on], column[:on]]
            last[first[on:n] + k] = self.final_token[state[on:], column[on:]]
        ends, at, begin = np.zeros(len(data), dtype=bool), starts + lengths - 1, starts
        while len(at):
            ends[at] = True
            at = at - self.width[last[at]]
            more = at >= begin
            at, begin = at[more], begin[more]
        where = np.flatnonzero(ends)
        return last[where].astype(np.uint32), where


class CompiledTokenizer:
    """Tokens of texts as the library gives them for the file `path`, without begin, end or added special tokens.

    The file must hold a byte-level BPE with word ends, NFC and lower case, and the pattern of Splitter.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not spec["model"].get("end_of_word_suffix") or spec["model"].get("continuing_subword_prefix"):
            raise ValueError("only a BPE with word ends can be compiled")
        self.library = Tokenizer.from_file(path)
        added = [t["content"] for t in spec["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.splitter, self.words = Splitter(), WordTransducer(spec["model"])
        self.classes = np.full(0x110000, 255, dtype=np.uint8)  # 255: not asked yet
        for c in range(128):
            self.classes[c] = self._class(chr(c))
        for signs, k in (("stmd", ENDS), ("rv", R_V), ("l", L), ("e", E), ("'", APOSTROPHE)):
            for c in signs:
                self.classes[ord(c)] = k

    def _class(self, c: str) -> int:
        """What the library's own splitter takes a character for."""
        pieces = len(self.library.pre_tokenizer.pre_tokenize_str(f"a{c}a"))
        if pieces < 3:
            return LETTER if pieces == 1 else SPACE
        return NUMBER if len(self.library.pre_tokenizer.pre_tokenize_str(c + c)) == 2 else OTHER

    def _normal(self, text: str) -> str:
        """As the library's normalizer gives it, but for the kind of white space."""
        if text.isascii():
            return text.lower()
        try:
            text.encode("latin-1")
            simple = True
        except UnicodeEncodeError:
            simple = max(text) < "ɐ" and "İ" not in text
        if simple:  # precomposed letters, each with one lower case
            return unicodedata.normalize("NFC", text).lower()
        return self.library.normalizer.normalize_str(text)

    def _words(self, normal: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 of all texts, the words' places and lengths in it, and the first word of each text (one more entry than texts)."""
        joined = " ".join([*normal, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        classes = self.classes[points]
        if (classes == 255).any():
            for c in np.unique(points[classes == 255]):
                self.classes[c] = self._class(chr(c))
            classes = self.classes[points]
        at = np.flatnonzero(self.splitter.starts(classes))
        # A word ends where the next one starts or at white space.
        blank = classes == SPACE
        breaks = np.flatnonzero(blank)
        ends = np.minimum(np.append(at[1:], len(points)), breaks[np.cumsum(blank, dtype=np.int32)[at]])
        wide = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), dtype=np.int64)])
        text_starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in normal])])
        return np.frombuffer(joined.encode(), dtype=np.uint8), wide[at], wide[ends] - wide[at], np.searchsorted(at, text_starts)

    @staticmethod
    def _distinct(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct words' bytes, places and lengths, and which of them each word is."""
        # Words and the gaps between them in turn, as one array over the same bytes.
        cuts = np.empty(2 * len(starts) + 1, dtype=np.int64)
        cuts[:-1:2], cuts[1:-1:2], cuts[-1] = starts, starts + lengths, len(data)
        runs = pa.Array.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        words = runs.take(pa.array(np.arange(0, 2 * len(starts), 2))).dictionary_encode()
        known = words.dictionary
        size = np.asarray(pc.binary_length(known), dtype=np.int64)
        offsets = np.frombuffer(known.buffers()[1], dtype=np.int64)[known.offset : known.offset + len(known)]
        return np.frombuffer(known.buffers()[2], dtype=np.uint8), offsets, size, np.asarray(words.indices)

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text. Each distinct word is read once."""
        special, normal = np.zeros(len(texts), dtype=np.int64), []
        for k, text in enumerate(texts):
            if self._has_added(text):
                parts = self.added.split(text)
                special[k] = len(parts) - 1
                normal.append(" ".join(map(self._normal, parts)))
            else:
                normal.append(self._normal(text))
        if not normal:
            return special
        data, starts, lengths, first = self._words(normal)
        if not len(starts):
            return special
        data, starts, lengths, which = self._distinct(data, starts, lengths)
        return special + sums(self.words.counts(data, starts, lengths)[which], first)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and where each text's ids start (one more entry than texts)."""
        odd = {k: self.library.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts) if self._has_added(t)}
        if not texts:
            return np.empty(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        data, starts, lengths, first = self._words(["" if k in odd else self._normal(t) for k, t in enumerate(texts)])
        ids = np.empty(0, dtype=np.uint32)
        if len(starts):  # each distinct word is read once
            data, starts, lengths, which = self._distinct(data, starts, lengths)
            known, ends = self.words.tokens(data, starts, lengths)
            begin = np.searchsorted(ends, starts)
            size = np.diff(np.append(begin, len(known)))[which]
            total = np.concatenate([[0], np.cumsum(size)])
            ids, first = known[np.repeat(begin[which] - total[:-1], size) + np.arange(total[-1])], total[first]
        if odd:
            parts = [np.array(odd[k], dtype=np.uint32) if k in odd else ids[first[k] : first[k + 1]] for k in range(len(texts))]
            ids, first = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, first

    def _has_added(self, text: str) -> bool:
        return bool(self.added and "<" in text and self.added.search(text))


@lru_cache(maxsize=2)
def compiled(path: str) -> CompiledTokenizer:
    """One for each worker and file."""
    return CompiledTokenizer(path)


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 2048, keep_text: bool = True) -> DataFrame:
    """Adds `n_bytes` (UTF-8), `n_tokens` and `over_limit` (n_tokens > limit) for the whole of each text.

    Special strings inside a text count as the tokenizer's default has it: one token each. Null and empty
    texts have no bytes and no tokens; repeated rows are counted each; columns of these names are replaced.
    One pass without a shuffle. A task works on a few MB of text at a time, or on one text if that is longer.
    """
    df = df.drop("n_bytes", "n_tokens", "over_limit")
    fields = [f for f in df.schema.fields if keep_text or f.name != text]
    schema = T.StructType(fields + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        for batch in batches:
            for part in slices(batch, text):
                texts = pc.fill_null(part.column(text), "")
                n = machine.count(texts.to_pylist())
                size = pc.cast(pc.binary_length(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), size, pa.array(n), pa.array(n > limit)], schema=to)

    return bounded(df).mapInArrow(run, schema)
