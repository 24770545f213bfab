"""Quality: a regularised quadratic discriminant over document statistics.

A text becomes a vector of transformed statistics (lengths, shares of capitals, signs, digits and stop words, repetition).
Each class of labelled documents is a normal distribution with a covariance of its own, drawn towards that of both
classes and towards a sphere. A document's evidence is the difference of the two log densities, each from a Mahalanobis
distance by a Cholesky factor that is computed once; a logistic curve turns evidence into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import cut, slices

#: Frequent words of the languages at hand.
STOP = frozenset(
    "a an and are as at be by for from have he in is it not of on or that the this to was with you der die das den dem des ein eine er es ich im ist mit nicht sie und von zu auf für "
    "le la les un une du et en est dans que qui pour pas sur au ce il je plus el los las del se lo por con una su para al como y o no si".split()
)
#: Words of a window in which repetition is counted; characters of a piece, in which all is counted, cut at white space.
WINDOW, PIECE = 128, 1 << 18
#: Each share starts from so many words of the usual value given with it, so that a short text tells little.
START = 12.0
#: How many statistics' worth of documents of both classes stand beside a class, and the part of a sphere in a covariance.
POOLED, SPHERE = 2.0, 0.05
#: Evidence counts within these bounds.
LIMIT = 40.0

_CAPITAL, _LETTER, _DIGIT = re.compile(r"[A-Z]"), re.compile(r"[^\W\d_]+"), re.compile(r"\d")
_SIGN, _POINT, _END = re.compile(r"[^\w\s.,;:!?'\"()-]"), re.compile(r"[.,;:?]"), re.compile(r"[.!?](?:\s|$)")
_SPACE = re.compile(r"\s")

NAMES = ("words", "word_length", "capitals", "signs", "points", "exclamations", "digits", "distinct", "top_word", "stop_words", "wordless", "repeated_lines", "line_length", "ends")


def pieces(text: str) -> Iterator[str]:
    """text in parts of PIECE characters and what is left of the word at their end; a word of more than a piece is cut."""
    at = 0
    while at < len(text):
        found = _SPACE.search(text, at + PIECE, at + 2 * PIECE) if at + PIECE < len(text) else None
        to = found.end() if found else at + 2 * PIECE if at + 2 * PIECE < len(text) else len(text)
        yield text[at:to]
        at = to


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of NAMES; a null text is an empty one."""
    n = Counter()
    for piece in pieces(text or ""):
        words = piece.split()
        lines = [x for line in piece.split("\n") if (x := line.strip())]
        n["chars"] += sum(map(len, words))
        n["words"] += len(words)
        n["letters"] += sum(map(len, _LETTER.findall(piece)))
        n["lines"] += len(lines)
        n["repeated"] += len(lines) - len(set(lines))
        n["exclamations"] += piece.count("!")
        for name, pattern in (("capitals", _CAPITAL), ("digits", _DIGIT), ("signs", _SIGN), ("points", _POINT), ("ends", _END)):
            n[name] += len(pattern.findall(piece))
        n["stop"] += sum(w.lower().strip(".,;:!?") in STOP for w in words)
        n["wordless"] += sum(not _LETTER.search(w) for w in words)
        for i in range(0, len(words), WINDOW):
            counts = Counter(words[i : i + WINDOW])
            n["distinct"] += len(counts)
            n["top"] += max(counts.values())
    k = n["words"]
    share = lambda x, usual, of=k: (x + START * usual) / (of + START)
    log = lambda x: math.log(x + 0.01)
    arc = lambda x: math.asin(math.sqrt(min(1.0, x)))
    return [
        math.log(k + START), math.log(share(n["chars"], 5.0)), log(share(n["capitals"], 0.03, n["letters"])), log(share(n["signs"], 0.02)), log(share(n["points"], 0.12)), log(share(n["exclamations"], 0.0)),
        log(share(n["digits"], 0.05)), arc(share(n["distinct"], 0.85)), log(share(n["top"], 0.07)), arc(share(n["stop"], 0.3)), log(share(n["wordless"], 0.01)), log((n["repeated"] + 0.1) / (n["lines"] + 4)),
        math.log((k + START) / (n["lines"] + 1)), log(share(n["ends"], 0.08)),
    ]


class Model(NamedTuple):
    """Of each class, 0 and 1: its mean, the inverse of the Cholesky factor of its covariance and the logs of factor and prior; the curve.

    Without examples of both classes there are no classes, and bias alone gives every document the same score.
    """

    centre: np.ndarray
    scale: np.ndarray
    classes: tuple[tuple[np.ndarray, np.ndarray, float], ...]
    bias: float
    slope: float


def density_difference(model: Model, x: np.ndarray) -> np.ndarray:
    """The log density of class 1 less that of class 0, for each row of x, within LIMIT."""
    if not model.classes:
        return np.zeros(len(x))
    z = (x - model.centre) / model.scale
    logs = [constant - 0.5 * np.square((z - mean) @ inverse.T).sum(axis=1) for mean, inverse, constant in model.classes]
    return np.clip(logs[1] - logs[0], -LIMIT, LIMIT)


def discriminant(n: dict[int, float], sums: dict[int, np.ndarray], products: dict[int, np.ndarray]) -> Model:
    """The model of the classes' counts, sums and sums of products, with an unfitted curve."""
    size = len(NAMES)
    if not (n.get(0) and n.get(1)):
        share = (n.get(1, 0) + 1) / (n.get(0, 0) + n.get(1, 0) + 2)
        return Model(np.zeros(size), np.ones(size), (), math.log(share / (1 - share)), 1.0)
    total = n[0] + n[1]
    centre = (sums[0] + sums[1]) / total
    scale = np.sqrt(np.maximum(np.diag(products[0] + products[1]) / total - centre**2, 0)) + 1e-3
    means = {c: (sums[c] / n[c] - centre) / scale for c in n}
    spread = {c: (products[c] / n[c] - np.outer(sums[c], sums[c]) / n[c] ** 2) / np.outer(scale, scale) for c in n}
    pooled = sum(n[c] * spread[c] for c in n) / total
    classes = []
    for c in (0, 1):
        own = (n[c] * spread[c] + POOLED * size * pooled) / (n[c] + POOLED * size)
        own = (1 - SPHERE) * own + SPHERE * (np.trace(own) / size + 1e-6) * np.eye(size)
        factor = np.linalg.cholesky(own)
        classes.append((means[c], np.linalg.inv(factor), float(math.log(n[c] / total) - np.log(np.diag(factor)).sum())))
    return Model(centre, scale, tuple(classes), 0.0, 1.0)


def curve(x: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Bias and slope of the logistic curve of y on x, n times each; a weak prior holds the slope at 1 and the bias at 0."""
    at = np.array([0.0, 1.0])
    prior = np.array([0.05, 2.0])
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -LIMIT, LIMIT)))
        slope = design.T @ (n * (y - p)) - prior * (at - [0.0, 1.0])
        bend = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag(prior)
        step = np.linalg.solve(bend, slope)
        at = at + step / max(1.0, float(np.abs(step).max()))
    return float(at[0]), max(0.0, float(at[1]))


def held_out(docs: DataFrame) -> DataFrame:
    """docs with held_out: crc32 of doc_id as text, modulo 5, is 0. A null doc_id is in no held-out fold."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, "text")):
        x = pa.array([statistics(t.as_py()) for t in batch.column("text")], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("same"), x], names=["doc_id", "same", "x"])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, same, x) of every row of docs, computed once; texts that are the same have the same number `same`."""
    kind = dict(docs.dtypes)["doc_id"]
    text = F.coalesce("text", F.lit(""))
    return cut(docs.select("doc_id", F.xxhash64(text).alias("same"), "text").mapInArrow(_statistics, f"doc_id {kind}, same long, x array<double>"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), len(NAMES))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class: the count (at -1), sums (0 on) and sums of products (after these) of the task's rows."""
    size = len(NAMES)
    total = np.zeros((2, 1 + size + size * size))
    for batch in batches:
        x, y = _matrix(batch.column("x")), np.asarray(batch.column("quality"))
        for c in (0, 1):
            own = x[y == c]
            total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    width = total.shape[1]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], width), pa.int32()), pa.array(np.tile(np.arange(width) - 1, 2), pa.int32()), pa.array(total.ravel())], names=["quality", "at", "value"])


def learn(stats: DataFrame, labels: DataFrame) -> Model:
    """The model of all labelled documents outside the held-out fold.

    Labels that are null or neither 0 nor 1, and those without a document, teach nothing; equal texts count once, as what most of
    their labels say, 1 if as many say either. What reaches the driver are sums: two rows for each pair of statistics, and counts of bins of evidence.
    """
    marks = held_out(labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality")).where("not held_out")
    taught = stats.join(marks.select("doc_id", "quality"), "doc_id").groupBy("same").agg(F.avg("quality").alias("q"), F.max("x").alias("x"))
    taught = cut(taught.select("x", (F.col("q") >= 0.5).cast("int").alias("quality")))
    rows = taught.mapInArrow(_moments, "quality int, at int, value double").groupBy("quality", "at").agg(F.sum("value").alias("value")).collect()
    size = len(NAMES)
    total = {c: np.zeros(1 + size + size * size) for c in (0, 1)}
    for r in rows:
        total[r["quality"]][r["at"] + 1] = r["value"]
    model = discriminant({c: t[0] for c, t in total.items()}, {c: t[1 : 1 + size] for c, t in total.items()}, {c: t[1 + size :].reshape(size, size) for c, t in total.items()})
    if not model.classes:
        return model
    found = taught.mapInArrow(_bins(model), "quality int, bin int").groupBy("quality", "bin").count().collect()
    x, y, n = (np.array([f(r) for r in found], float) for f in (lambda r: (r["bin"] + 0.5) / 4, lambda r: r["quality"], lambda r: r["count"]))
    bias, slope = curve(x, y, n)
    return model._replace(bias=bias, slope=slope)


def _bins(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.floor(density_difference(model, _matrix(batch.column("x"))) * 4).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(bins)], names=["quality", "bin"])

    return run


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.clip(model.bias + model.slope * density_difference(model, _matrix(batch.column("x"))), -LIMIT, LIMIT)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "score"])

    return run


def score(stats: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Per row of stats (see measured): doc_id, held_out, score from 0 to 1, predicted (score >= threshold).

    A null or empty text is scored by its statistics, all at their usual values. Repeated rows are scored alike; no
    rows give no rows; other columns play no part.
    """
    kind = dict(stats.dtypes)["doc_id"]
    out = held_out(stats.select("doc_id", "x").mapInArrow(_score(model), f"doc_id {kind}, score double"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """score() of all docs by the model that the labels of some teach."""
    stats = measured(docs)
    return score(stats, learn(stats, labels), threshold)
