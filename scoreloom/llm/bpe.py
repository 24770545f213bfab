"""Byte-level BPE encoding and decoding by a monoid tree reduction.

Encoding a piece of bytes splits it in half, encodes the halves recursively, down to leaves of a few bytes, and joins them: the tokens at
the boundary are encoded anew, and the window of new tokens grows by a neighbour at a time on the side where its seam isn't
stable, until the tokens outside provably stay. They do once each seam is stable, that is, once the two tokens at the seam, encoded alone side by side, come out as
themselves: a sequence is the encoding of its bytes exactly when each two neighbours are that of theirs.
Texts are a tree above the pieces: the halves of a long text, cut where no piece can reach across, are
encoded on their own and concatenated. Decoding concatenates up the same kind of tree.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that a task may keep of encoded words, of their parts and of seams; a full store is emptied, and all are at the task's end.
WORD_BYTES, STRING_BYTES, SEAM_BYTES = 96 << 20, 24 << 20, 16 << 20
#: What an entry of a store takes besides its contents, about.
ENTRY = 200
#: Encodings of parts of words of so many bytes at most are kept.
STRING = 64
#: A leaf of the tree has at most so many bytes; strings of so many are merged along a list, longer ones with a heap.
LEAF_BYTES, LIST_BYTES = 8, 64
#: More than any rank.
_NONE = 1 << 62
#: Longer texts are halved; ids of which there are more are decoded in halves.
LEAF_CHARS, LEAF_IDS = 1 << 16, 1 << 14
#: Rows leave a task in batches of about so many bytes.
BATCH_BYTES = 8 << 20

#: A visible character before white space; the signs between U+001C and U+001F are white space to re alone, and so stand on neither side.
_SAFE = re.compile(r"\S(?=[ \t\n\r])")
_codecs: dict[tuple[str, str], Codec] = {}


class Codec:
    """The ranks of a vocabulary file (base64 token and rank per line) and the pattern that splits texts."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(n) for t, n in (line.split() for line in f if line.strip())}
        self.tokens: dict[int, bytes] = {n: t for t, n in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        """Empties the stores."""
        self.words: dict[str, bytes] = {}
        self.strings: dict[bytes, tuple[int, ...]] = {}
        self.seams: dict[tuple[int, int], tuple[int, ...] | None] = {}
        self.word_bytes = self.string_bytes = 0

    def merge(self, s: bytes) -> tuple[int, ...]:
        """s encoded at once, merging the leftmost pair of least rank again and again: the tree's leaves and the pairs at its seams."""
        if (n := self.ranks.get(s)) is not None:
            return (n,)
        rank, size = self.ranks.get, len(s)
        if size <= LIST_BYTES:
            at = list(range(size + 1))  # where the parts start, and the end
            pairs = [rank(s[i : i + 2], _NONE) for i in range(size - 1)]
            while pairs and (least := min(pairs)) != _NONE:
                i = pairs.index(least)
                del pairs[i], at[i + 1]
                if i < len(pairs):
                    pairs[i] = rank(s[at[i] : at[i + 2]], _NONE)
                if i:
                    pairs[i - 1] = rank(s[at[i - 1] : at[i + 1]], _NONE)
            return tuple([self.ranks[s[i:end]] for i, end in itertools.pairwise(at)])
        ends = list(range(1, size + 1))  # of the part that starts at each place
        before = list(range(-1, size - 1))  # the start of the part before
        alive = [True] * size
        heap = [(r, i, i + 2) for i in range(size - 1) if (r := rank(s[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = ends[i]
            if not alive[i] or middle >= size or ends[middle] != end:
                continue  # one of the two has been merged since
            alive[middle], ends[i] = False, end
            if end < size:
                before[end] = i
                if (r := rank(s[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if (p := before[i]) >= 0 and (r := rank(s[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        return tuple(self.ranks[s[i : ends[i]]] for i in range(size) if alive[i])

    def pair(self, x: int, y: int) -> tuple[int, ...] | None:
        """The encoding of two tokens' bytes; None if the seam between them is stable."""
        try:
            return self.seams[x, y]
        except KeyError:
            if len(self.seams) * ENTRY >= SEAM_BYTES:
                self.seams.clear()
            found = self.merge(self.tokens[x] + self.tokens[y])
            return self.seams.setdefault((x, y), None if found == (x, y) else found)

    def join(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of a followed by those of b, both encodings themselves."""
        if not a or not b or self.pair(a[-1], b[0]) is None:
            return a + b
        # what lies right of the seam: the window's tokens, the next one last, and then b from `rest` on
        left, window, rest = list(a), [], 0
        for _ in range(64 * (len(a) + len(b)) + 1024):
            if not window and rest == len(b):
                return tuple(left)
            y = window[-1] if window else b[rest]
            new = self.pair(left[-1], y) if left else None
            if new is None and left and not window:
                return (*left, *b[rest:])
            if window:
                window.pop()
            else:
                rest += 1
            if new is None:
                left.append(y)
            else:
                left.pop()
                window += reversed(new)
        return self.merge(b"".join([self.tokens[x] for x in a + b]))  # not known to happen

    def encode_piece(self, s: bytes) -> tuple[int, ...]:
        if (n := self.ranks.get(s)) is not None:
            return (n,)
        if len(s) <= LEAF_BYTES:
            return self.merge(s)
        half = len(s) // 2
        return self.join(self.part(s[:half]), self.part(s[half:]))

    def part(self, s: bytes) -> tuple[int, ...]:
        """The encoding of a half, which is kept, as other words have it too; whole pieces are kept as words alone."""
        if (known := self.strings.get(s)) is not None:
            return known
        out = self.encode_piece(s)
        if len(s) <= STRING:
            self.string_bytes += ENTRY + len(s) + 8 * len(out)
            if self.string_bytes >= STRING_BYTES:
                self.strings.clear()
                self.string_bytes = 0
            self.strings[s] = out
        return out

    def encode_word(self, word: str) -> bytes:
        ids = array("I", self.encode_piece(word.encode()))
        if ids.itemsize != 4:
            raise RuntimeError("an unsigned int has four bytes here")
        if sys.byteorder == "big":
            ids.byteswap()
        out = ids.tobytes()
        self.word_bytes += ENTRY + len(word) + len(out)
        if self.word_bytes >= WORD_BYTES:
            self.words.clear()
            self.word_bytes = 0
        self.words[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of text as little-endian unsigned 32-bit integers."""
        if len(text) > LEAF_CHARS and (cut := self.cut(text)):
            return self.encode(text[:cut]) + self.encode(text[cut:])
        words, fresh = self.words, self.encode_word
        return b"".join([words.get(w) or fresh(w) for w in self.split(text)])

    @staticmethod
    def cut(text: str) -> int:
        """A place near the middle between a visible character and white space, which no piece spans; 0 if there is none."""
        middle = len(text) // 2
        for start, end in ((middle, len(text)), (0, middle)):
            if (m := _SAFE.search(text, start, end)) and m.end() < len(text):
                return m.end()
        return 0

    def decode(self, ids: memoryview) -> bytes:
        """The bytes of little-endian unsigned 32-bit ids."""
        if len(ids) > LEAF_IDS:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _mapped(column: str, outs: tuple[str, ...], of: Callable[[], Callable[..., tuple[bytes, ...]]], end: Callable[[], None], keep: bool = False):
    """mapInArrow function that adds the binary columns outs = of()(value of column), in batches of bounded size; column goes unless kept; end() comes last."""

    def flush(batch: pa.RecordBatch, start: int, values: list[tuple[bytes, ...]]) -> pa.RecordBatch:
        part = batch.slice(start, len(values))
        others = {n: c for n, c in zip(batch.schema.names, part.columns, strict=True) if keep or n != column}
        return pa.RecordBatch.from_pydict(others | {n: pa.array([v[k] for v in values], pa.binary()) for k, n in enumerate(outs)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = of()
        try:
            for batch in batches:
                start, size, values = 0, 0, []
                for x in batch.column(column):
                    values.append(do(x.as_py()))
                    size += sum(map(len, values[-1]))
                    if size >= BATCH_BYTES:
                        yield flush(batch, start, values)
                        start, size, values = start + len(values), 0, []
                if values or not batch.num_rows:
                    yield flush(batch, start, values)
        finally:
            end()
            pa.default_memory_pool().release_unused()

    return run


def _replaced(docs: DataFrame, column: str, outs: tuple[str, ...], path: str, pattern: str, of: Callable[[], Callable[..., tuple[bytes, ...]]]) -> DataFrame:
    """docs with column replaced by outs; other columns of these names go."""
    docs = docs.drop(*(n for n in outs if n != column))
    others = docs.drop(column)
    schema = ", ".join([*(f"`{n}` {t}" for n, t in others.dtypes), *(f"{n} binary" for n in outs)])
    # a worker serves other tasks after this one, so that what it learnt of words doesn't stay
    mapped = _mapped(column, outs, of, lambda: codec(path, pattern).forget())
    return docs.select(*[F.col(f"`{c}`") for c in others.columns], F.col(column)).mapInArrow(mapped, schema)


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text") -> DataFrame:
    """docs with column replaced by ids: its encoding as little-endian unsigned 32-bit integers, binary.

    Each match of pattern is encoded separately, without special tokens. Null and empty texts have no ids.
    Other columns and all rows stay, repeated ones too; but one named ids would clash and goes, as the new one takes its place.
    """

    def start() -> Callable[[str | None], tuple[bytes]]:
        encode_ = codec(path, pattern).encode
        return lambda text: (encode_(text or ""),)

    return _replaced(docs, column, ("ids",), path, pattern, start)


def round_trip(docs: DataFrame, path: str, pattern: str, column: str = "text") -> DataFrame:
    """decode(encode(docs)): ids in place of column, and decoded, the bytes that these ids stand for.

    The two in a chain keep two Python processes a task, each with the vocabulary and batches of its own; here one process does both.
    """

    def start() -> Callable[[str | None], tuple[bytes, bytes]]:
        own = codec(path, pattern)

        def both(text: str | None) -> tuple[bytes, bytes]:
            ids = own.encode(text or "")
            return ids, own.decode(memoryview(ids).cast("I"))

        return both

    return _replaced(docs, column, ("ids", "decoded"), path, pattern, start)


def decode(df: DataFrame, path: str, pattern: str, column: str = "ids") -> DataFrame:
    """df with the column of ids kept and decoded beside it, the bytes they stand for; null ids are none, and another column decoded goes."""
    df = df.drop("decoded")
    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), "decoded binary"])

    def start() -> Callable[[bytes | None], tuple[bytes]]:
        decode_ = codec(path, pattern).decode
        return lambda ids: (decode_(memoryview(ids or b"").cast("I")),)

    return df.mapInArrow(_mapped(column, ("decoded",), start, lambda: None, keep=True), schema)


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
