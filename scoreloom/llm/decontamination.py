"""Benchmark decontamination: short test items are searched inside long documents.

A size-partitioned MinHash containment search. The items are partitioned by the number of their shingles, by
powers of two, and each class has an index of its own. An item of q shingles keeps the q - ceil(t q) + 1 least
of its shingles' hashes: a document that contains the share t of an item has at least one of them, so that no
item is missed. A document probes the classes whose items it is long enough to contain, each with that class's
filter. Candidates are verified by their exact share of common shingles, as text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import cut, slices
from scoreloom.llm.shingles import shingles, text_of

#: Bits of the filters that documents are held against: a power of two by the number of item shingles, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


def _item_shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shingles([t.as_py() or "" for t in batch.column("text")], words, True)
            texts = pa.array([text_of(s, i, True) for i in range(len(s.hash))], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(s.text, pa.int64())), pa.array(s.hash.view(np.int64)), texts], names=["item_id", "hash", "shingle"])

    return run


def _bits(df: DataFrame, column: str, size: int) -> np.ndarray:
    """A bit array of size bits in which the bits of column's values, modulo size, are set. The driver gets size / 8 bytes at most."""
    at = F.pmod(F.col(column), F.lit(size)) + 1
    rows = df.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for r in rows.toLocalIterator():
        raw = np.frombuffer(bytes(r["bits"]), np.uint8)
        start = (r["b"] - 1) * 4096
        out[start : start + len(raw)] = raw[: len(out) - start]
    return np.unpackbits(out, bitorder="little")


def _filters(index: DataFrame, threshold: float) -> dict[int, tuple[int, np.ndarray]]:
    """Per size class, of which there are as many as powers of two: the fewest shingles of a document that contains
    an item of it, and the bits of its hashes. The driver gets MOST_BITS / 8 bytes for 32 classes at most."""
    rows = index.groupBy("size_class").agg(F.count(F.lit(1)).alias("n"), F.min("q").alias("q")).collect()
    sizes = {r["size_class"]: min(MOST_BITS // 32, max(LEAST_BITS // 32, 1 << math.ceil(math.log2(64 * r["n"])))) for r in rows}
    if not rows:
        return {}
    size = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col("size_class")]
    at = index.select("size_class", (F.pmod("hash", size) + 1).alias("at"))
    out = {k: np.zeros(n // 8, np.uint8) for k, n in sizes.items()}
    for r in at.groupBy("size_class", F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toLocalIterator():
        raw, mine = np.frombuffer(bytes(r["bits"]), np.uint8), out[r["size_class"]]
        start = (r["b"] - 1) * 4096
        mine[start : start + len(raw)] = raw[: len(mine) - start]
    return {r["size_class"]: (math.ceil(r["q"] * threshold - 1e-9), out[r["size_class"]]) for r in rows}


_PROBES = pa.list_(pa.struct([("size_class", pa.int64()), ("hash", pa.int64())]))


def _probe(every: bytes, filters: dict[int, tuple[int, np.ndarray]], words: int):
    """Per document that holds one of the least hashes of a class: which, and all of its shingles that pass the filter of every item shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(every, np.uint8), bitorder="little")
        mask = np.uint64(len(bits) - 1)
        for whole in batches:
            for batch in slices(whole, "text"):
                s = shingles([t.as_py() or "" for t in batch.column("text")], words, True)
                passed = np.flatnonzero(bits[s.hash & mask])
                rows: dict[int, dict[int, str]] = {}
                for i in passed.tolist():
                    mine = rows.setdefault(int(s.text[i]), {})
                    if int(s.hash[i]) not in mine:
                        mine[int(s.hash[i])] = text_of(s, i, True)
                sizes = np.bincount(s.text, minlength=batch.num_rows)
                out: dict[str, list] = {"row": [], "n": [], "probes": [], "shingles": []}
                for row, mine in rows.items():
                    h = np.fromiter(mine, np.uint64, len(mine))
                    probes = []
                    for size_class, (least, table) in filters.items():
                        if sizes[row] >= least:
                            at = (h & np.uint64(len(table) * 8 - 1)).astype(np.int64)
                            hit = h[(table[at >> 3] >> (at & 7).astype(np.uint8) & 1) > 0]
                            probes += [{"size_class": size_class, "hash": x} for x in hit.view(np.int64).tolist()]
                    if probes:
                        for k, v in zip(out, (row, int(sizes[row]), probes, list(mine.values())), strict=True):
                            out[k].append(v)
                ids = batch.column("doc_id").take(pa.array(out["row"], pa.int64()))
                arrays = [pa.array(out["n"], pa.int64()), pa.array(out["probes"], _PROBES), pa.array(out["shingles"], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([ids, *arrays], names=["doc_id", "n_shingles", "probes", "shingles"])

    return run


def least_hashes(q: Column, threshold: float) -> Column:
    """How many of an item's q least hashes find every document that contains its share threshold."""
    return q - F.ceil(q * F.lit(threshold) - F.lit(1e-9)) + 1


def search(docs: DataFrame, items: DataFrame, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for each document row that contains that share of an item.

    Words are runs of letters and digits, lower-cased. Items without words are in no document; an item or
    document of fewer words than a shingle has one shingle of all its words. Null texts count as empty.
    Items with a null item_id are ignored; items that share an item_id are one item with the shingles of
    all. Each document row is judged alone; equal results of repeated rows are given once.
    """
    kinds = dict(items.dtypes)["item_id"], dict(docs.dtypes)["doc_id"]
    cells = items.where("item_id is not null").select("item_id", "text").mapInArrow(_item_shingles(words), f"item_id {kinds[0]}, hash long, shingle string").distinct()
    order = Window.partitionBy("item_id").orderBy("hash")
    sizes = cells.groupBy("item_id").agg(F.count(F.lit(1)).alias("q"), F.collect_list("shingle").alias("of_item"))
    ranked = cells.withColumn("rank", F.row_number().over(order)).withColumn("q", F.count(F.lit(1)).over(Window.partitionBy("item_id")))
    index = ranked.where(F.col("rank") <= least_hashes(F.col("q"), threshold)).select("item_id", "q", F.floor(F.log2("q")).alias("size_class"), "hash")
    n = cells.count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << math.ceil(math.log2(64 * max(n, 1)))))
    every = np.packbits(_bits(cells, "hash", size), bitorder="little").tobytes()
    probe = _probe(every, _filters(index, threshold), words)
    hits = cut(docs.select("doc_id", "text").mapInArrow(probe, f"doc_id {kinds[1]}, n_shingles long, probes array<struct<size_class:long,hash:long>>, shingles array<string>").withColumn("row", F.monotonically_increasing_id()))
    # candidates are found by numbers alone; a document's shingles go to each of its candidates once
    found = hits.select("row", "n_shingles", F.inline("probes")).join(index, ["size_class", "hash"]).where(F.col("n_shingles") >= F.ceil(F.col("q") * threshold - 1e-9))
    pairs = found.select("row", "item_id").distinct()
    shared = F.size(F.array_intersect("shingles", "of_item"))
    return (
        pairs.join(hits.select("row", "doc_id", "shingles"), "row").join(sizes, "item_id").withColumn("n_shared", shared)
        .where(F.col("n_shared") >= F.col("q") * threshold - 1e-9)
        .select("doc_id", "item_id", F.col("n_shared").cast("long").alias("n_shared"), F.col("q").alias("n_item"), (F.col("n_shared") / F.col("q")).alias("containment"))
        .distinct()
    )


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs whose text contains no item, all columns kept. Rows are judged by their text alone, so that a null doc_id is like any other; a null text stays."""
    text = F.md5("text")
    bad = search(docs.where("text is not null").select(text.alias("doc_id"), "text"), items, threshold).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, text == F.col("__bad"), "left_anti").select(*docs.columns)
