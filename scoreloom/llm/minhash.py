"""MinHash near-dedup of documents with ProbMinHash over weighted word shingles.

Each shingle of a document, weighted by how often it occurs there, sends arrivals of a Poisson process with
its weight as the rate to random registers; a register keeps the shingle that arrives first. Two documents
agree in a register with the probability Jaccard similarity of their weights. A document is done as soon as
no later arrival can come first anywhere. Bands of registers give candidates, and the exact probability
Jaccard similarity of their shingles decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import cut, likely, slices
from scoreloom.llm.components import components
from scoreloom.llm.shingles import mix, shingles

#: 24 bands of 4 registers: documents of similarity 0.8 meet in a band but for 4 in a million.
BANDS, ROWS = 24, 4
#: Texts held against one hub in a task; a hub of more has several blocks.
BLOCK = 512

_GOLD = 0x9E3779B97F4A7C15


def sketch(text: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """(texts, registers): the elements that arrive first; text, element and weight list each text's elements.

    Arrivals are drawn from hashes of the element and the arrival's number. Every round draws the next
    arrival of each element that may still come first in a register.
    """
    first = np.full((texts, registers), np.inf)
    winner = np.zeros((texts, registers), np.uint64)
    t, e, w = text, element, weight
    time = np.zeros(len(t))
    step = 0
    while len(t):
        step += 1
        bits = mix(e + np.uint64(step * _GOLD % 2**64))
        time = time - np.log(((bits >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / w
        register = (mix(bits ^ np.uint64(_GOLD)) % np.uint64(registers)).astype(np.int64)
        order = np.lexsort((e, time))[::-1]  # the earliest is written last
        at = (t[order], register[order])
        better = time[order] < first[at]
        at = (at[0][better], at[1][better])
        first[at], winner[at] = time[order][better], e[order][better]
        open_ = time < first.max(axis=1)[t]
        t, e, w, time = t[open_], e[open_], w[open_], time[open_]
    return winner


def weighted(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of the distinct shingles of each text."""
    s = shingles(texts, words)
    order = np.lexsort((s.hash, s.text))
    t, h = s.text[order], s.hash[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(t)), bool), (t[1:] != t[:-1]) | (h[1:] != h[:-1]))))
    return t[new], h[new], np.diff(np.append(new, len(t))).astype(np.float64)


def node(text: str = "text"):
    """The name of a text: all documents of equal texts are one node of the graph."""
    return F.unhex(F.md5(text))


def _once(batch: pa.RecordBatch) -> tuple[pa.Array, list[str]]:
    """The nodes of a batch and their texts, equal texts once."""
    found = dict(zip(batch.column("node").to_pylist(), batch.column("text"), strict=True))
    return pa.array(list(found), pa.binary()), [t.as_py() or "" for t in found.values()]


def _bands(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                nodes, texts = _once(batch)
                t, h, w = weighted(texts, words)
                got = sketch(t, h, w, len(texts), bands * rows).reshape(len(texts), bands, rows)
                key = np.zeros((len(texts), bands), np.uint64)
                for r in range(rows):
                    key = mix(key * np.uint64(0x100000001B3) + got[:, :, r])
                some = np.flatnonzero(np.bincount(t, minlength=len(texts)))
                flat = pa.array(key[some].reshape(-1).view(np.int64))
                offsets = pa.array(np.arange(0, len(some) * bands + 1, bands), pa.int32())
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(some)), pa.ListArray.from_arrays(offsets, flat)], names=["node", "bands"])

    return run


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """The probability Jaccard similarity of two weighted sets: sorted elements a with weights x, b with y."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    only_a, only_b = x.sum() - x[i].sum(), y.sum() - y[j].sum()
    p, q = x[i], y[j]
    order = np.argsort(q / p, kind="stable")
    p, q = p[order], q[order]
    ratio = q / p
    first = np.searchsorted(ratio, ratio, "left")
    below = np.concatenate(([0.0], np.cumsum(p)))[first] + only_a
    above = q.sum() - np.concatenate(([0.0], np.cumsum(q)))[first] + only_b
    return float((1.0 / (below / p + above / q)).sum())


def _held(threshold: float):
    """Rows come by hub and block, the hub's own shingles first: only these stay in memory while its texts pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, h, x = None, None, None
        for batch in batches:
            tokens, counts = batch.column("tokens"), batch.column("counts")
            edges = tokens.offsets.to_numpy()
            flat, weight = tokens.values.to_numpy().view(np.uint64), counts.values.to_numpy().astype(np.float64)
            pairs, found = [], []
            for k, (of, other) in enumerate(zip(batch.column("hub").to_pylist(), batch.column("spoke").to_pylist(), strict=True)):
                part = slice(edges[k], edges[k + 1])
                if other is None:
                    hub, h, x = of, flat[part].copy(), weight[part].copy()
                    continue
                if of != hub:
                    raise RuntimeError("a hub's shingles come before its texts")
                s = similarity(h, x, flat[part], weight[part])
                if s >= threshold - 1e-9:
                    pairs.append((min(of, other), max(of, other)))
                    found.append(s)
            columns = [pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    return run


def verify(pairs: DataFrame, bags: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b, similarity) of those pairs (hub, spoke) of nodes whose shingles are similar enough.

    Each text's shingles move once a pair and those of a hub once a block of its spokes, so that a hub of many is
    dealt over many tasks and none holds more than one hub and a batch.
    """
    blocks = cut(pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")))
    own = bags.select(F.col("node").alias("hub"), "tokens", "counts").join(blocks, "hub")
    own = own.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("binary").alias("spoke"), "tokens", "counts")
    dealt = pairs.join(blocks, "hub").select("hub", F.pmod(F.xxhash64("spoke"), "blocks").cast("int").alias("block"), "spoke")
    others = dealt.join(bags.select(F.col("node").alias("spoke"), "tokens", "counts"), "spoke").select(own.columns)
    rows = own.unionByName(others).repartition("hub", "block").sortWithinPartitions("hub", "block", F.col("spoke").asc_nulls_first())
    return rows.select("hub", "spoke", "tokens", "counts").mapInArrow(_held(threshold), "a binary, b binary, similarity double")


def links(docs: DataFrame, threshold: float = 0.8, words: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(a, b, similarity): verified links between nodes, the digests of different texts, that are enough for their components.

    In a bucket of a band all texts are compared with the one of them that meets the most texts in all bands.
    The texts of buckets that still hold several components are held against each other by prefix filters,
    so that no bucket's pairs are all compared.
    """
    texts = docs.where("doc_id is not null and text is not null").select(node().alias("node"), "text")
    # copies are sketched once a slice and one sketch of them is left on the way to the shuffle
    sketches = cut(texts.mapInArrow(_bands(words, bands, rows), "node binary, bands array<long>").groupBy("node").agg(F.first("bands").alias("bands")))
    cells = sketches.select("node", F.posexplode("bands").alias("band", "hash"))
    sizes = cells.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cells.join(sizes, ["band", "hash"])
    # the hub of a group of near copies meets the others in more bands than they meet each other
    met = cut(met.join(met.groupBy("node").agg(F.sum("n").alias("meets")), "node"))
    hubs = met.groupBy("band", "hash").agg(F.max_by("node", F.struct("meets", "node")).alias("to"))
    spokes = met.join(hubs, ["band", "hash"]).select("node", "to").where("node <> to")
    pairs = spokes.groupBy(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).agg(F.min("to").alias("hub"))
    pairs = cut(pairs.select("a", "b", "hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("spoke")))
    bags = cut(shingled(texts, met.select("node").distinct(), words))
    found = cut(verify(pairs.select("hub", "spoke"), bags, threshold))
    known = components(found)

    placed = met.join(known.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("band", "hash").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band", "hash")
    rest = placed.join(mixed, ["band", "hash"], "left_semi")
    members = cut(rest.select(F.col("node").alias("id"), "component").distinct())
    sets = cut(bags.withColumnRenamed("node", "id").join(members, "id").select("id", "component", "tokens", "counts", "total", "repeats"))
    last = prefix_pairs(sets.where("not repeats"), threshold).unionByName(weighted_prefix_pairs(sets, threshold))
    last = cut(last.distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
    return found if last.isEmpty() else found.unionByName(verify(last.select(F.col("a").alias("hub"), F.col("b").alias("spoke")), bags, threshold))


def shingled(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, tokens, counts, total, repeats) of the wanted nodes, each once: shingles, how often each occurs, the sum, whether one occurs again."""
    schema = "node binary, tokens array<long>, counts array<int>, total double, repeats boolean"
    some = likely(texts, "node", wanted).mapInArrow(_bags(words), schema).join(wanted, "node", "left_semi")
    return some.groupBy("node").agg(F.first(F.struct("tokens", "counts", "total", "repeats")).alias("x")).select("node", "x.*")


def _bags(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                nodes, texts = _once(batch)
                t, h, w = weighted(texts, words)
                edges = pa.array(np.searchsorted(t, np.arange(len(texts) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(edges, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(edges, pa.array(w.astype(np.int32)))]
                totals = np.bincount(t, w, minlength=len(texts))
                twice = np.bincount(t, w > 1, minlength=len(texts)) > 0
                yield pa.RecordBatch.from_arrays([nodes, *lists, pa.array(totals.astype(np.float64)), pa.array(twice)], names=["node", "tokens", "counts", "total", "repeats"])

    return run


#: Sizes of one class are within this ratio.
CLASS = 0.97


def prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of (id, component, tokens) sets of different components that may reach a Jaccard similarity.

    A prefix filter: with tokens in order of their number of sets, two similar sets share a token among the
    first few of each, as many as they may have that the other lacks. How many follows from both sizes, so that
    sets are held against each class of smaller sizes with the prefix that it takes. Similar sets are never
    missed, and those which differ from all others by tokens of their own meet nobody.
    """
    share = threshold / (1 + threshold)  # of both sizes together that similar sets have in common
    cells = sets.select("id", "component", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    often = cells.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    known = cells.join(often, "token")
    mine = Window.partitionBy("id")
    rank = F.col("size") - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("sets", "token"))  # tokens of its own come first
    ranked = known.withColumn("rank", rank)
    length = lambda common: F.col("size") - F.ceil(F.col("size") * common - F.lit(1e-9)) + 1
    ranked = cut(ranked.where(F.col("rank") <= length(F.lit(threshold))).withColumn("class", F.floor(F.log("size") / F.lit(-math.log(CLASS)))))
    smaller = ranked.where(F.col("rank") <= length(F.lit(2 * share))).select("token", "class", F.col("id").alias("a"), F.col("size").alias("size_a"), F.col("component").alias("component_a"), (F.col("size") - F.col("rank") + 1).alias("left_a"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(math.log(threshold) / math.log(CLASS)))))
    larger = ranked.withColumn("step", steps).where(F.col("rank") <= length(F.lit(share) * (1 + F.pow(F.lit(CLASS), F.col("step") + 1))))
    larger = larger.select("token", (F.col("class") - F.col("step")).alias("class"), F.col("id").alias("b"), F.col("size").alias("size_b"), F.col("component").alias("component_b"), (F.col("size") - F.col("rank") + 1).alias("left_b"))
    # from the first token they share on, both must have enough tokens left
    enough = F.least("left_a", "left_b") >= (F.col("size_a") + F.col("size_b")) * share - 1e-9
    met = smaller.join(larger, ["token", "class"]).where(enough & (F.col("component_a") != F.col("component_b")) & ((F.col("size_a") < F.col("size_b")) | (F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b"))))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def weighted_prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """As prefix_pairs, by weight, for pairs of which one at least repeats a token.

    Let u and v be the shares of two sets' weights on tokens that the other lacks. Their probability Jaccard
    similarity is at most 2 (2 - u^2 - v^2) / (2 + u + v)^2, which falls in u and v. The weight before the first
    token they share, in order of their number of sets, bounds u and v from below; so one set shares a token
    before (1 - t) / (1 + t) of its weight is past and the other before 1 - t is.
    """
    if sets.where("repeats").isEmpty():
        return sets.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    cells = sets.select("id", "component", "repeats", "total", F.inline(F.arrays_zip("tokens", "counts"))).select("id", "component", "repeats", F.col("tokens").alias("token"), (F.col("counts") / F.col("total")).alias("weight"))
    # tokens that no set which repeats one has come first in the order, whatever sets have them
    cells = likely(cells, "token", sets.where("repeats").select(F.explode("tokens").alias("token")))
    often = cells.groupBy("token").agg(F.count(F.lit(1)).alias("sets"), F.max("repeats").alias("some")).where("sets > 1 and some").drop("some")
    mine = Window.partitionBy("id")
    here = F.coalesce(F.sum("weight").over(mine.orderBy("sets", "token").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranked = cells.join(often, "token").withColumn("before", 1 - F.sum("weight").over(mine) + here)
    ranked = cut(ranked.where(F.col("before") <= 1 - threshold + 1e-9).select("id", "component", "repeats", "token", "before"))
    one = ranked.where(F.col("before") <= (1 - threshold) / (1 + threshold) + 1e-9)
    two = ranked.select(F.col("id").alias("id2"), F.col("component").alias("component2"), F.col("repeats").alias("repeats2"), "token", F.col("before").alias("before2"))
    u, v = F.col("before"), F.col("before2")
    bound = 2 * (2 - u * u - v * v) / ((2 + u + v) * (2 + u + v))
    met = one.join(two, "token").where((F.col("component") != F.col("component2")) & (F.col("repeats") | F.col("repeats2")) & (bound >= threshold - 1e-9))
    return met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """Per document row: doc_id, class_id, component_id, kept.

    class_id is the least doc_id with the same text, component_id the least doc_id reachable by links of
    similarity threshold or more, kept whether the row's doc_id is that. Words are runs between ASCII white
    space, lower-cased; a text of fewer words than a shingle has one shingle of all its words; texts
    without words link with exact copies only. Rows that share a doc_id count as one document: all their texts are linked. Rows with a
    null doc_id or a null text link with nothing and are kept; their ids are their doc_id. No rows give no rows.
    """
    some = cut(docs.where("doc_id is not null and text is not null").select("doc_id", node().alias("node")))
    classes = some.groupBy("node").agg(F.min("doc_id").alias("class_id"))
    several = some.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b <> most").select("doc_id", "b")
    shared = some.join(several, "doc_id").select(F.col("node").alias("a"), "b").where("a <> b").distinct()
    known = components(links(docs, threshold, words).select("a", "b").unionByName(shared)).withColumnRenamed("id", "node")
    named = classes.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    told = cut(named.join(least, "component").select("node", "class_id", "component_id"))
    members = some.join(told, "node").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("component_id").alias("component_id"))
    rows = docs.select("doc_id").join(members, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """The rows of docs that near_duplicates keeps, one of each group, all columns; of repeated rows all stay."""
    gone = near_duplicates(docs, threshold, words).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
