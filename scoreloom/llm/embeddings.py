"""Embedding near-dedup with a forest of random-projection trees.

In each tree vectors of a label go down recursive random splits: a node projects on a random direction and
sends a vector left or right of a threshold, or to both sides if it lies within the spill margin, so that
close vectors seldom part and never in every tree. Vectors are compared within the leaves, the exact cosine
decides, and the links of all trees are united.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import cut
from scoreloom.llm.components import components

#: Trees, vectors a leaf should hold, and the half width of the overlap as a share of the largest distance of linked vectors.
TREES, LEAF, SPILL = 5, 256, 0.15
#: The thresholds are medians of at most so many vectors, the first by a hash, and so many bytes; every vector is indexed.
SAMPLE, SAMPLE_BYTES = 40_000, 64 << 20
#: A leaf of more vectors is compared in blocks of so many, each pair of blocks apart.
BLOCK = 2048


class Forest(NamedTuple):
    """thresholds by (label, dimension, tree) and node, 0 where the sample has none; vectors a leaf should hold; margin of the spill."""

    thresholds: dict[tuple, dict[int, float]]
    trees: int
    leaf: int
    margin: float

    def depth(self, n: int) -> int:
        """Levels of a tree of n vectors."""
        return max(0, math.ceil(math.log2(max(n, 1) / self.leaf)))


def direction(dimension: int, tree: int, level: int) -> np.ndarray:
    v = np.random.default_rng([dimension, tree, level]).standard_normal(dimension)
    return v / np.linalg.norm(v)


def route(v: np.ndarray, forest: Forest, key: tuple, n: int, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of unit vectors v, some of a group of n, in one tree; a leaf is numbered as in a heap, with the root 1."""
    rows, nodes = np.arange(len(v)), np.ones(len(v), np.int64)
    known = forest.thresholds.get((*key, tree), {})
    for level in range(forest.depth(n)):
        x = (v @ direction(key[1], tree, level))[rows]
        unique, inverse = np.unique(nodes, return_inverse=True)
        cut_at = np.array([known.get(int(n), known.get(-level - 1, 0.0)) for n in unique])[inverse]
        left, right = x <= cut_at + forest.margin, x >= cut_at - forest.margin
        rows, nodes = np.concatenate((rows[left], rows[right])), np.concatenate((2 * nodes[left], 2 * nodes[right] + 1))
    return rows, nodes


def grow(sample: dict[tuple, np.ndarray], counts: dict[tuple, int], trees: int, leaf: int, margin: float) -> Forest:
    """A forest whose thresholds are medians of the sample at each node, or at the level where a node has few."""
    thresholds: dict[tuple, dict[int, float]] = {}
    forest = Forest(thresholds, trees, leaf, margin)
    for key, v in sample.items():
        for tree in range(trees):
            known: dict[int, float] = {}
            nodes = np.ones(len(v), np.int64)
            for level in range(forest.depth(counts[key])):
                x = v @ direction(key[1], tree, level)
                known[-level - 1] = float(np.median(x))
                if level < 16:
                    order = np.argsort(nodes, kind="stable")
                    for part in np.split(order, np.flatnonzero(np.diff(nodes[order])) + 1):
                        if len(part) >= 16:
                            known[int(nodes[part[0]])] = float(np.median(x[part]))
                at = np.array([known.get(int(n), known[-level - 1]) for n in nodes])
                nodes = 2 * nodes + (x > at)
            thresholds[(*key, tree)] = known
    return forest


def _unit(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    raw = batch.column("vector")
    raw = raw.combine_chunks() if isinstance(raw, pa.ChunkedArray) else raw
    v = np.asarray(raw.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(raw), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _leaves(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("label", "dimension", "n")), strict=True)):
                keys.setdefault(key, []).append(i)
            batch = batch.drop_columns(["n"])
            for (*key, n), at in keys.items():
                part = batch.take(pa.array(at))
                v = _unit(part)
                for tree in range(forest.trees):
                    rows, nodes = route(v, forest, tuple(key), n, tree)
                    out = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(len(rows), tree, np.int32)), pa.array(nodes)], names=[*out.schema.names, "tree", "leaf"])

    return run


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        ids, v = table.column("id").to_numpy(), _unit(table)
        lo, hi = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        a_out, b_out = [], []
        for at in range(0, len(lo), 512):
            rows = lo[at : at + 512]
            i, j = np.nonzero(v[rows] @ v[hi].T >= threshold)
            i, j = rows[i], hi[j]
            keep = ids[i] < ids[j] if block.min() == block.max() else ids[i] != ids[j]
            a_out.append(np.minimum(ids[i[keep]], ids[j[keep]]))
            b_out.append(np.maximum(ids[i[keep]], ids[j[keep]]))
        return pa.table({"a": np.concatenate(a_out).astype(np.int64), "b": np.concatenate(b_out).astype(np.int64)})

    return run


def links(classes: DataFrame, threshold: float, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs of ids of (id, label, dimension, vector) rows whose cosine reaches threshold."""
    sizes = cut(classes.groupBy("label", "dimension").agg(F.count(F.lit(1)).alias("n")))
    # thresholds are learnt for the largest groups, as many as the sample can serve; other groups split at 0
    top = sizes.where(F.col("n") > leaf).orderBy(F.desc("n"), "label", "dimension").limit(sample // 16).collect()
    counts = {(r["label"], r["dimension"]): r["n"] for r in top}
    rows = min(sample, SAMPLE_BYTES // (8 * max([1, *(k[1] for k in counts)])))
    share = min(1.0, 0.9 * rows / max(1, sum(counts.values())))
    picked = classes.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("label", "dimension", "vector").limit(rows).toArrow()
    by: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(picked.column("label").to_pylist(), picked.column("dimension").to_pylist(), strict=True)):
        if key in counts:
            by.setdefault(key, []).append(i)
    vectors = {k: _unit(picked.take(pa.array(rows))) for k, rows in by.items()}
    margin = SPILL * float(np.sqrt(2 - 2 * threshold))
    forest = grow(vectors, counts, trees, leaf, margin)
    kinds = dict(classes.dtypes)
    schema = f"id {kinds['id']}, label {kinds['label']}, dimension int, vector {kinds['vector']}, tree int, leaf long"
    placed = classes.join(sizes, ["label", "dimension"]).select("id", "label", "dimension", "vector", "n").mapInArrow(_leaves(forest), schema)
    key = ["label", "dimension", "tree", "leaf"]
    large = placed.groupBy(*key).count().where(F.col("count") > block).select(*key, F.ceil(F.col("count") / block).cast("int").alias("n"))
    blocks = F.coalesce("n", F.lit(1))
    cells = placed.join(large, key, "left").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    against = F.when(blocks == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1))
    cells = cells.withColumn("other", F.explode(against)).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    return cells.groupBy(*key, "lo", "hi").applyInArrow(_compare(threshold), "a long, b long").distinct()


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id, kept.

    Vectors are compared only if their labels and lengths are equal; null labels and ids, and vectors that are
    null, empty, zero or hold null or non-finite components link with nothing: their component is their own id.
    Equal vectors are one class on the way and links of each other. Repeated rows count as vectors of their
    own. kept is whether vec_id is the least id reachable; a null id is kept. No rows give no rows.
    """
    v = F.col("embedding").cast("array<double>")
    fine = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0),
        F.lit(False),
    )
    rows = vectors.select("vec_id", "label", "embedding", fine.alias("fine"))
    ok = rows.where("fine").select("vec_id", "label", "embedding")
    classes = cut(ok.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("dimension", F.size("embedding")))
    pairs = cut(links(classes.select("id", "label", "dimension", F.col("embedding").alias("vector")), threshold))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.groupBy("id").agg(F.sum("n").alias("n"))
    linked = both.join(sizes.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.sum("n").alias("more")).withColumnRenamed("a", "id")
    known = components(pairs)
    told = classes.join(linked, "id", "left").join(known, "id", "left").select(
        F.col("label").alias("c_label"), F.col("embedding").alias("c_embedding"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    good = ok.join(told, (F.col("label") == F.col("c_label")) & (F.col("embedding") == F.col("c_embedding"))).select("vec_id", "n_links", "component_id")
    out = good.unionByName(rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
