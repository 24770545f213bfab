"""Exact substring dedup: every byte covered by a string of LENGTH bytes that also starts elsewhere.

Windows of LENGTH bytes are told apart in three passes over the texts, none of which moves a whole text.
First, each window has an anchor, the least hash among its k-grams, so that equal windows have equal anchors;
only runs of windows whose anchor occurs again can repeat. Second, runs with equal bytes settle each other.
Third, the rest is sorted with its neighbours of the same anchor by a two-stage suffix sort: suffixes that
are smaller than their successors are sorted directly, the others are induced from them by scanning the
buckets of first bytes, and adjacent common prefixes of LENGTH bytes are the repeats. Anchors with too many
different runs for one task are split by further anchors, and what is left open by the digests of its windows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import cut, slices
from scoreloom.llm.decontamination import LEAST_BITS, MOST_BITS, _bits
from scoreloom.llm.shingles import mix, powers, prefix

#: Bytes of a repeat, and of the k-grams that anchor it.
LENGTH, GRAM = 400, 64
#: An anchor with more different runs than this is resolved by so many further anchors and by window digests.
MOST_RUNS, SEEDS = 400, 8
#: Suffixes sorted together.
BLOCK = 1 << 17
#: Bytes of texts whose hashes are held at once.
PIECE = 1 << 18
#: Windows of a run; a periodic text, whose anchor never changes, has several runs, most of them equal.
LONGEST = 4096


def slide(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    k = 1
    y = x
    while 2 * k <= width:
        y = np.minimum(y[:-k], y[k:])
        k *= 2
    return np.minimum(y[: len(y) - (width - k)], y[width - k :]) if k < width else y


class Runs(NamedTuple):
    """Of each run of windows of one anchor: the text, the anchor, the first window, the number of windows, and
    whether its windows may repeat within it, as its anchor occurs again there."""

    text: np.ndarray
    anchor: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    twice: np.ndarray


def runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Runs:
    """The runs of all texts, in order. A long text is read in pieces, which run into each other."""
    pieces = [(i, at, raw[at : at + PIECE + length - 1]) for i, raw in enumerate(texts) if len(raw) >= length for at in range(0, len(raw) - length + 1, PIECE)]
    parts: list[Runs] = []
    group: list[tuple[int, int, bytes]] = []
    size = 0
    for piece in pieces:
        group.append(piece)
        size += len(piece[2])
        if size >= PIECE:
            parts.append(_runs(group, length, gram))
            group, size = [], 0
    if group:
        parts.append(_runs(group, length, gram))
    if not parts:
        none = np.zeros(0, np.int64)
        return Runs(none, np.zeros(0, np.uint64), none, none, np.zeros(0, bool))
    text, anchor, start, windows, twice = (np.concatenate(x) for x in zip(*parts, strict=True))
    # what a piece's end cut is one run, and may hold its anchor in both pieces
    joins = np.flatnonzero((text[1:] == text[:-1]) & (anchor[1:] == anchor[:-1]) & (start[1:] == start[:-1] + windows[:-1])) + 1
    if len(joins):
        head = np.ones(len(text), bool)
        head[joins] = False
        first = np.flatnonzero(head)
        windows = np.add.reduceat(windows, first)
        cut_ = np.diff(np.append(first, len(text))) > 1
        text, anchor, start, twice = text[first], anchor[first], start[first], np.logical_or.reduceat(twice, first) | cut_
    return Runs(text, anchor, start, windows, twice)


def _runs(group: list[tuple[int, int, bytes]], length: int, gram: int) -> Runs:
    data = np.frombuffer(b"".join(p[2] for p in group), np.uint8)
    sums = prefix(data)
    m = len(data) - gram + 1
    h = mix((sums[gram:] - sums[:m]) * powers(len(sums))[1][:m])
    width = length - gram + 1
    least = slide(h, width)
    sizes = np.array([len(p[2]) for p in group])
    begin = np.cumsum(sizes) - sizes
    piece = np.repeat(np.arange(len(group)), sizes)[: len(least)]
    inside = np.arange(len(least)) + length <= (begin + sizes)[piece]
    same = np.zeros(len(least), bool)
    same[1:] = (least[1:] == least[:-1]) & (piece[1:] == piece[:-1]) & inside[:-1]
    first = np.flatnonzero(inside & ~same)
    ends = np.append(np.flatnonzero(~inside), len(least))  # a run ends where the next begins or its piece's windows do
    stop = np.minimum(np.append(first[1:], len(least)), ends[np.searchsorted(ends, first)])
    anchor = least[first]
    # places of k-grams that are the least of some window; a run that holds its anchor twice has two such places in a row
    top = np.concatenate((np.zeros(width - 1, np.uint64), np.where(inside, least, np.uint64(0)), np.zeros(width - 1, np.uint64)))
    place = np.flatnonzero(h == ~slide(~top, width)[: len(h)])
    again = np.flatnonzero(h[place[1:]] == h[place[:-1]])
    twice = np.zeros(len(first), bool)
    for i, j in zip(place[again].tolist(), place[again + 1].tolist(), strict=True):
        lo, hi = np.searchsorted(first, i - width + 1, "right") - 1, np.searchsorted(first, j, "right")
        for k in range(max(lo, 0), hi):
            if anchor[k] == h[i] and first[k] <= i and j < stop[k] + width - 1:
                twice[k] = True
    of = piece[first]
    return Runs(np.array([p[0] for p in group])[of], anchor, first - begin[of] + np.array([p[1] for p in group])[of], stop - first, twice)


def _digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def _text(x) -> bytes:
    return (x.as_py() or "").encode()


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every run's anchor; twice if the run may repeat within itself."""
    for batch in batches:
        for part in slices(batch, "text"):
            found = runs([_text(x) for x in part.column("text")])
            out = np.concatenate((found.anchor, found.anchor[found.twice]))
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], names=["anchor"])


def _segments(bits: bytes, content: bool) -> Callable:
    """The runs whose anchors pass the filter; with content, each digest once a batch with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits, np.uint8)
        mask = len(table) * 8 - 1
        for whole in batches:
            for batch in slices(whole, "text"):
                rows: list[tuple] = []
                seen: set[tuple] = set()
                texts = [_text(x) for x in batch.column("text")]
                found = runs(texts)
                at_bit = (found.anchor & np.uint64(mask)).astype(np.int64)
                passed = np.flatnonzero(table[at_bit >> 3] >> (at_bit & 7).astype(np.uint8) & 1)
                whole_runs = zip(*(c[passed].tolist() for c in found), strict=True)
                for i, anchor, start, windows, twice in ((i, a, s + k, min(LONGEST, n - k), t) for i, a, s, n, t in whole_runs for k in range(0, n, LONGEST)):
                    part = texts[i][start : start + windows + LENGTH - 1]
                    d = _digest(part)
                    if not content:
                        rows.append((i, anchor, d, start, windows, twice))
                    elif (anchor, d) not in seen:
                        seen.add((anchor, d))
                        rows.append((i, anchor, d, part))
                columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * (4 if content else 6)
                anchors = pa.array(np.array(columns[1], np.uint64).view(np.int64))
                if content:
                    yield pa.RecordBatch.from_arrays([anchors, pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], names=["anchor", "digest", "content"])
                else:
                    keys = batch.column("key").take(pa.array(columns[0], pa.int64()))
                    more = [pa.array(columns[k], t) for k, t in ((2, pa.binary()), (3, pa.int64()), (4, pa.int64()), (5, pa.bool_()))]
                    yield pa.RecordBatch.from_arrays([keys, anchors, *more], names=["key", "anchor", "digest", "start", "windows", "twice"])

    return run


def suffixes(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The suffix array of text, in order of the first depth bytes at least, by two-stage sorting."""
    n = len(text)
    following = np.append(text[1:].astype(np.int16), -1)
    differs = np.flatnonzero(text != following)
    smaller = (text < following)[differs][np.searchsorted(differs, np.arange(n))]  # equal bytes: as the next
    direct = np.flatnonzero(smaller)
    padded = np.concatenate((text, np.zeros(depth, np.uint8)))
    words = np.lib.stride_tricks.as_strided(padded, (n, depth), (1, 1))
    keys = np.ascontiguousarray(words[direct]).view(f"S{depth}").ravel()
    direct = direct[np.argsort(keys, kind="stable")]
    ends = np.searchsorted(text[direct], np.arange(257))
    coming: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def induce(chunk: np.ndarray, own: int) -> np.ndarray:
        """Deals the predecessors that are larger than chunk's suffixes to their buckets; returns those of the same."""
        p = chunk[chunk > 0] - 1
        p = p[~smaller[p]]
        if not len(p):
            return p
        c = text[p]
        order = np.argsort(c, kind="stable")
        p, c = p[order], c[order]
        cuts = np.flatnonzero(np.diff(c)) + 1
        same = p[:0]
        for part in np.split(p, cuts):
            if text[part[0]] == own:
                same = part
            else:
                coming[text[part[0]]].append(part)
        return same

    if n:
        coming[text[-1]].append(np.array([n - 1]))
    for c in range(256):
        chunk = np.concatenate(coming[c]) if coming[c] else np.zeros(0, np.int64)
        while len(chunk):
            out.append(chunk)
            chunk = induce(chunk, c)
        mine = direct[ends[c] : ends[c + 1]]
        if len(mine):
            out.append(mine)
            induce(mine, -1)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def repeated(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part whether each of its windows also starts elsewhere in the parts."""
    sizes = np.array([len(p) for p in parts])
    text = np.frombuffer(b"".join(parts), np.uint8)
    starts = np.cumsum(sizes) - sizes
    room = np.repeat(starts + sizes, sizes) - np.arange(len(text))  # bytes left in the part
    order = suffixes(text, length)
    order = order[room[order] >= length]
    same = np.zeros(len(order), bool)
    view = np.lib.stride_tricks.as_strided(text, (max(0, len(text) - length + 1), length), (1, 1))
    for at in range(0, len(order) - 1, 4096):
        a, b = order[at : at + 4097][:-1], order[at : at + 4097][1:]
        same[at : at + len(a)] = (view[a] == view[b]).all(axis=1)
    again = np.zeros(len(text), bool)
    again[order[:-1][same[:-1]]] = True
    again[order[1:][same[:-1]]] = True
    return [again[s : s + z - length + 1] for s, z in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _ranges(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return [{"from": int(a), "to": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_RANGES = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole anchors, which come one after the other, are sorted; gives the windows that repeat by digest."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated([r[2] for r in rows])
        some = [(r, f) for r, f in zip(rows, found, strict=True) if f.any()]
        arrays = [pa.array([r[0] for r, _ in some], pa.int64()), pa.array([r[1] for r, _ in some], pa.binary()), pa.array([_ranges(f) for _, f in some], _RANGES)]
        return pa.RecordBatch.from_arrays(arrays, names=["anchor", "digest", "ranges"])

    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for anchor, digest, content in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "content")), strict=True):
            if size >= BLOCK and anchor != rows[-1][0]:
                yield solve(rows)
                rows, size = [], 0
            rows.append((anchor, digest, content))
            size += len(content)
    if rows:
        yield solve(rows)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs split wherever one of several further anchors of their windows changes."""
    for batch in batches:
        rows: list[tuple] = []
        for anchor, digest, content in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "content")), strict=True):
            data = np.frombuffer(content, np.uint8)
            sums = prefix(data)
            m = len(data) - GRAM + 1
            h = (sums[GRAM:] - sums[:m]) * powers(len(sums))[1][:m]
            keys = [slide(mix(h ^ np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)), LENGTH - GRAM + 1) for seed in range(SEEDS)]
            change = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            first = np.flatnonzero(np.concatenate(([True], change)))
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys[0])], strict=True):
                n, part = b - a, content[a : b + LENGTH - 1]
                name = _digest(anchor.to_bytes(8, "little", signed=True) + b"".join(k[a].tobytes() for k in keys))
                # windows repeat within only if the part is periodic: what all of them hold then comes again
                periodic = n > 1 and (n > LENGTH - GRAM or part.find(part[n - 1 : n - 1 + GRAM], n, 2 * n + GRAM) >= 0)
                rows.append((anchor, digest, a, n, name, _digest(part), periodic, part))
        columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 8
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["anchor", "digest", "from", "windows", "anchors", "bytes", "twice", "content"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, name, content in zip(*(batch.column(c).to_pylist() for c in ("key", "bytes", "content")), strict=True):
            n = len(content) - LENGTH + 1
            arrays = [pa.array([key] * n, pa.string()), pa.array([name] * n, pa.binary()), pa.array(range(n), pa.int64()), pa.array([_digest(content[i : i + LENGTH]) for i in range(n)], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "bytes", "at", "window"])


def _filter(df: DataFrame) -> bytes:
    """A filter of bounded size that all of df's anchors pass, and few others."""
    n = df.count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << math.ceil(math.log2(16 * max(n, 1)))))
    return np.packbits(_bits(df, "anchor", size), bitorder="little").tobytes()


def repeats(rows: DataFrame) -> DataFrame:
    """(key, start, end): bytes of the texts of (key, text) rows covered by repeated strings; may overlap."""
    texts = rows.select("text").where(F.octet_length("text") >= LENGTH)
    again = cut(texts.mapInArrow(_anchors, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    keyed = rows.where(F.octet_length("text") >= LENGTH).select("key", "text")
    found = cut(keyed.mapInArrow(_segments(_filter(again), False), "key string, anchor long, digest binary, start long, windows long, twice boolean"))
    by_digest = found.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("copies"), F.max("twice").alias("twice"))
    by_anchor = by_digest.groupBy("anchor").agg(F.count(F.lit(1)).alias("different"), F.min("copies").alias("least"), F.max("twice").alias("any_twice"))
    open_ = cut(by_anchor.where((F.col("least") == 1) & ((F.col("different") > 1) | F.col("any_twice"))).select("anchor", "different"))
    settled = found.join(by_digest.where("copies > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi").select("key", "start", (F.col("start") + F.col("windows") + LENGTH - 1).alias("end"))
    contents = texts.mapInArrow(_segments(_filter(open_.select("anchor")), True), "anchor long, digest binary, content binary").join(open_, "anchor")
    contents = cut(contents.groupBy("anchor", "digest").agg(F.first("content").alias("content"), F.first("different").alias("different")))
    few = contents.where(F.col("different") <= MOST_RUNS).select("anchor", "digest", "content").repartition("anchor").sortWithinPartitions("anchor")
    sorted_ = few.mapInArrow(_sort, "anchor long, digest binary, ranges array<struct<from:long,to:long>>").select("anchor", "digest", F.inline("ranges"))
    many = contents.where(F.col("different") > MOST_RUNS).select("anchor", "digest", "content")
    windows = sorted_.unionByName(refined(many))
    rest = found.join(windows, ["anchor", "digest"]).select("key", (F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to") + LENGTH - 1).alias("end"))
    return settled.unionByName(rest)


def refined(runs_: DataFrame) -> DataFrame:
    """(anchor, digest, from, to): ranges of repeated windows of (anchor, digest, content) runs, however many share an anchor.

    The runs are split where one of SEEDS further anchors changes. Equal windows have all anchors in common, so
    that a split run is settled if its bytes come again, or if no other has its anchors. The windows of the
    others, few next to all, are told apart by their digests.
    """
    parts = cut(runs_.mapInArrow(_split, "anchor long, digest binary, from long, windows long, anchors binary, bytes binary, twice boolean, content binary"))
    copies = parts.groupBy("anchors", "bytes").agg(F.count(F.lit(1)).alias("copies"), F.max("twice").alias("twice"))
    different = copies.groupBy("anchors").agg(F.count(F.lit(1)).alias("different"), F.max("twice").alias("any_twice"), F.min("copies").alias("least"))
    again = parts.join(copies.where("copies > 1").select("anchors", "bytes"), ["anchors", "bytes"], "left_semi").select("anchor", "digest", "from", (F.col("from") + F.col("windows")).alias("to"))
    open_ = different.where((F.col("least") == 1) & ((F.col("different") > 1) | F.col("any_twice"))).select("anchors")
    left = parts.join(open_, "anchors", "left_semi").groupBy("anchors", "bytes").agg(F.first("content").alias("content")).select(F.hex("anchors").alias("key"), "bytes", "content")
    cells = cut(left.mapInArrow(_windows, "key string, bytes binary, at long, window binary"))
    twice = cells.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    hit = cells.join(twice, "window", "left_semi")
    # neighbouring windows become ranges before they are dealt to the runs that hold them
    line = Window.partitionBy("key", "bytes").orderBy("at")
    ranges = hit.withColumn("island", F.col("at") - F.row_number().over(line)).groupBy("key", "bytes", "island").agg(F.min("at").alias("lo"), (F.max("at") + 1).alias("hi"))
    single = parts.join(copies.where("copies = 1").select("anchors", "bytes"), ["anchors", "bytes"], "left_semi").select("anchor", "digest", "from", F.hex("anchors").alias("key"), "bytes")
    rest = single.join(ranges, ["key", "bytes"]).select("anchor", "digest", (F.col("from") + F.col("lo")).alias("from"), (F.col("from") + F.col("hi")).alias("to"))
    return again.unionByName(rest)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            out: list[list] = [[], [], [], []]
            for x, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw, kept, end, n, merged = _text(x), [], 0, 0, 0
                last = -1
                for s in spans.as_py() or []:
                    a, b = s["start"], s["end"]
                    if a > last:  # a new run; touching ones are one
                        kept.append(raw[end:a])
                        n, merged = n + b - a, merged + 1
                        end = last = b
                    elif b > last:
                        n += b - last
                        end = last = b
                kept.append(raw[end:])
                for column, value in zip(out, (len(raw), n, merged, b"".join(kept)), strict=True):
                    column.append(value)
            arrays = [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def deduplicate(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    Texts are UTF-8 bytes; null counts as empty. Matches never cross rows; a string that starts twice in one
    row repeats as well, overlaps included. Repeated rows repeat each other. Rows with a null doc_id take part.
    No rows give no rows; other columns play no part.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)).alias("key"))
    spans = repeats(rows).distinct().groupBy(F.col("key").alias("k")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    joined = rows.join(spans, F.col("key") == F.col("k"), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_remove, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept binary")
