"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length.

Folding lowers the case, undoes compatibility forms and accents, and maps look-alike letters and digits
used as letters, so that `l0ser` and `lоser` with a Cyrillic letter read as `loser`. The lexicon is
learned: terms are folded words and word beginnings that labelled toxic documents hold more densely than others. A
match adds the log of the ratio of the two rates, and every word of the text takes the difference of the rates away: the
log likelihood ratio of two Poisson rates, so that a chance likeness in a long text weighs little. Exception phrases are
two-word phrases around a term which occur only in documents that are not toxic; a match inside one counts nothing.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import slices

# Letters of other scripts that look like Latin ones, and digits or signs written for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t",
    "н": "h", "в": "b", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ε": "e", "ı": "i", "ł": "l", "ø": "o",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

#: Insults known beforehand; each has PRIOR as its weight until the labels teach another, and goes if they speak against it.
SEEDS = ("clown", "disgusting", "dumb", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "scumbag", "stupid", "trash", "worthless")
PRIOR = 3.0
#: What a word takes away where no rate was learnt, and the occurrences and words that every rate starts from.
TOLL, START, START_WORDS = 0.002, 0.5, 5000.0
#: A term must be in so many toxic training documents at least, as a count and as a share, and have these log odds.
MIN_TOXIC, MIN_SHARE, MIN_LOG_ODDS = 4, 0.01, 2.5
#: Lengths of word beginnings that may become terms.
STEMS = (4, 5, 6, 7, 8)
#: A term counts for a document that holds it once in so many words at least; a chance likeness in a long text teaches nothing.
SPARSE = 60
#: Bias and slope of the score before any label.
UNFITTED = (-1.5, 1.0)
#: At most so many labelled documents, the first by a hash of doc_id, teach the lexicon.
MAX_LABELLED = 20_000
#: Evidence counts within these bounds.
LIMIT = 30.0

PLAIN = re.compile(r"[a-z]+")
_FOLD = str.maketrans(HOMOGLYPHS)
_LEET = str.maketrans(DIGITS)
_ODD = re.compile(r"[^\x00-\x7f]+")


def _fold_run(m: re.Match) -> str:
    s = unicodedata.normalize("NFKD", m.group().lower())
    return "".join(c for c in s if not unicodedata.combining(c)).translate(_FOLD).lower()


_MIXED = re.compile(r"[a-z0-9@$!]*[a-z][a-z0-9@$!]*")
_NEEDS = re.compile(r"(?:(?<=[a-z])[0134578@$!]|[0134578@$](?=[a-z]))")


def _unleet(m: re.Match) -> str:
    word = m.group()
    core = word.rstrip("!")
    return word if core.isalpha() else core.translate(_LEET) + word[len(core) :]


def fold(text: str) -> str:
    """text in lower case, with homoglyphs, accents and digits or signs inside words undone."""
    text = text.lower()
    if not text.isascii():
        text = _ODD.sub(_fold_run, text)
    if _NEEDS.search(text):
        text = _MIXED.sub(_unleet, text)
    return text


class Lexicon(NamedTuple):
    """terms: folded term to weight; exceptions: folded phrases; bias and slope turn evidence into a score; tolls: what a
    word of a text with the term takes away, TOLL for terms without one."""

    terms: dict[str, float]
    exceptions: tuple[str, ...]
    bias: float
    slope: float
    tolls: dict[str, float] = {}  # noqa: RUF012


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's words and beginnings: how many, of how many words, and whether densely."""
    for batch in (part for whole in batches for part in slices(whole, "text")):
        rows: list[list] = [[], [], [], [], []]
        for i, text in enumerate(batch.column("text")):
            words = Counter(PLAIN.findall(fold(text.as_py() or "")))
            seen = Counter({f"{w} ": k for w, k in words.items() if len(w) >= 3})
            for w, k in words.items():
                for n in STEMS:
                    if len(w) >= n:
                        seen[w[:n]] += k
            total = words.total()
            for column, values in zip(rows, ([i] * len(seen), seen.keys(), seen.values(), [total] * len(seen), [k * SPARSE >= total for k in seen.values()]), strict=True):
                column.extend(values)
        arrays = [pa.array(x, t) for x, t in zip(rows[1:], (pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("toxic").take(pa.array(rows[0], pa.int64())), *arrays], names=["toxic", "term", "k", "words", "dense"])


def _phrases(terms: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = automaton(Lexicon(terms, (), 0, 1))
        for batch in (part for whole in batches for part in slices(whole, "text")):
            docs, out = [], []
            for i, text in enumerate(batch.column("text")):
                folded = fold(text.as_py() or "")
                found = set()
                for start, end, *_ in match.hits(folded):
                    left = PLAIN.findall(folded[max(0, start - 24) : start])
                    right = PLAIN.findall(folded[end : end + 24])
                    word = folded[start:end].strip()
                    found |= {f"{left[-1]} {word}"} if left else set()
                    found |= {f"{word} {right[0]}"} if right else set()
                docs += [i] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([batch.column("toxic").take(pa.array(docs, pa.int64())), pa.array(out, pa.string())], names=["toxic", "term"])

    return run


class automaton:  # noqa: N801
    """Aho-Corasick over a lexicon's terms and exception phrases."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.tree = ahocorasick.Automaton()
        for term, weight in lexicon.terms.items():
            self.tree.add_word(term.strip(), (len(term.strip()), weight, term.endswith(" "), term))
        for phrase in lexicon.exceptions:
            self.tree.add_word(phrase, (len(phrase), None, True, ""))
        if len(self.tree):
            self.tree.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float, str]]:
        """(start, end, weight, term) of the best term of each word that begins or is a term, exceptions left out."""
        if not len(self.tree):
            return []
        best: dict[int, tuple[int, float, str]] = {}
        skip: list[tuple[int, int]] = []
        for last, (n, weight, whole, term) in self.tree.iter(folded):
            start, end = last + 1 - n, last + 1
            if start and folded[start - 1].isalpha() or whole and end < len(folded) and folded[end].isalpha():
                continue
            if weight is None:
                skip.append((start, end))
            elif start not in best or weight > best[start][1]:
                best[start] = (end, weight, term)
        return [(s, *found) for s, found in sorted(best.items()) if not any(a <= s and found[0] <= b for a, b in skip)]


def held_out(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Lexicon:
    """The lexicon of at most max_labelled labelled documents outside the held-out fold.

    A document with several labels is toxic if one of them says so, and equal texts count once; labels without a document, or null,
    teach nothing. Without toxic examples the lexicon is SEEDS and the score's curve UNFITTED. What reaches the
    driver are terms that a share of the toxic examples hold and phrases that three examples hold, all of them, and the numbers of documents by bin of
    evidence: max_labelled bounds them all.
    """
    marks = held_out(labels.where("toxic is not null and doc_id is not null").select("doc_id", "toxic")).where("not held_out")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    sample = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")
    sample = sample.groupBy(F.xxhash64("text").alias("h"), "text").agg(F.max("toxic").alias("toxic")).select("toxic", "text").persist()
    try:
        totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        pos, neg = totals.get(1, 0), totals.get(0, 0)
        if not pos:
            return Lexicon({f"{w} ": PRIOR for w in SEEDS}, (), *UNFITTED)
        seen = sample.mapInArrow(_features, "toxic int, term string, k long, words long, dense boolean")
        odds = F.log(((F.col("p") + 0.1) / (pos + 0.2)) / ((F.col("q") + 0.1) / (neg + 0.2)))
        bad, good = F.col("toxic") == 1, F.col("toxic") == 0
        sums = [F.coalesce(F.sum(F.when(of, F.col(c))), F.lit(0)).alias(n) for n, of, c in (("k1", bad, "k"), ("words1", bad, "words"), ("k0", good, "k"), ("words0", good, "words"))]
        rows = seen.groupBy("term").agg(F.count_if(bad & F.col("dense")).alias("p"), F.count_if(good & F.col("dense")).alias("q"), F.count_if(bad).alias("any_p"), F.count_if(good).alias("any_q"), *sums).withColumn("w", odds)
        dense = (F.col("p") >= max(MIN_TOXIC, MIN_SHARE * pos)) & (F.col("w") >= MIN_LOG_ODDS)
        # words that hardly any other document holds need not be dense
        told = F.col("term").endswith(" ") & (F.col("any_p") >= 2 * max(MIN_TOXIC, MIN_SHARE * pos)) & (F.col("any_q") == 0)
        sure = sorted(rows.where(dense | told).collect(), key=lambda r: (-r["w"], r["term"]))
        chosen = choose({r["term"]: (r["p"], r["q"], r["w"]) for r in sure})
        rates = {r["term"]: ((r["k1"] + START) / (r["words1"] + START_WORDS), (r["k0"] + START) / (r["words0"] + START_WORDS)) for r in sure if r["term"] in chosen}
        keep = {t: math.log(a / b) for t, (a, b) in rates.items() if a > b}
        against = {r["term"] for r in rows.where(F.col("term").isin([f"{w} " for w in SEEDS]) & (F.col("w") < 1)).collect()}
        keep = {f"{w} ": PRIOR for w in SEEDS if f"{w} " not in against} | keep
        phrases = (
            sample.mapInArrow(_phrases(keep), "toxic int, term string").groupBy("term").agg(F.count_if(bad).alias("p"), F.count_if(good).alias("q"))
            .where((F.col("p") == 0) & (F.col("q") >= 3)).collect()
        )
        lexicon = Lexicon(keep, tuple(sorted(r["term"] for r in phrases)), 0.0, 1.0, {t: rates[t][0] - rates[t][1] for t in keep if t in rates})
        found = sample.mapInArrow(_evidence(lexicon), "toxic int, x double").where("x is not null")
        bins = found.groupBy("toxic", F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), "x")) * 4).alias("b")).count().collect()
        if not bins:
            return lexicon._replace(bias=UNFITTED[0], slope=UNFITTED[1])
        bias, slope = _fit([((r["b"] + 0.5) / 4, r["toxic"], r["count"]) for r in bins])
        return lexicon._replace(bias=bias, slope=max(slope, 0.0))
    finally:
        sample.unpersist()


def choose(found: dict[str, tuple[int, int, float]]) -> dict[str, float]:
    """Of nested terms those that say most: term to (toxic documents, others, weight) in, term to weight out.

    A whole word ends in a space. A beginning goes if a longer term covers nearly all of its documents; what
    is left under a beginning that is about as telling goes too.
    """
    longer: dict[str, int] = {}
    for term, (p, _, _) in found.items():
        word = term.strip()
        for n in STEMS:
            if n < len(word) or n == len(word) and term != word:
                longer[word[:n]] = max(longer.get(word[:n], 0), p)
    left = {t: v for t, v in found.items() if t.endswith(" ") or longer.get(t, 0) < 0.98 * v[0]}
    told = lambda t, v: any((b := left.get(t.strip()[:n])) and t.strip()[:n] != t and (b[1] <= v[1] or b[2] >= v[2] - 0.5) for n in STEMS)
    return {t: v[2] for t, v in left.items() if not told(t, v)}


def evidence(lexicon: Lexicon, hits: list[tuple[int, int, float, str]], chars: int) -> float:
    """The matches' weights less the toll of the text's words, of about six characters each, at the highest of the terms found."""
    return sum(h[2] for h in hits) - chars / 6 * max(lexicon.tolls.get(h[3], TOLL) for h in hits)


def _evidence(lexicon: Lexicon):
    """Of documents with a match; others have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = automaton(lexicon)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            folded = [fold(t.as_py() or "") for t in batch.column("text")]
            x = [evidence(lexicon, hits, len(f)) if (hits := match.hits(f)) else None for f in folded]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.float64())], names=["toxic", "x"])

    return run


def _fit(points: list[tuple[float, int, int]], steps: int = 60) -> tuple[float, float]:
    """Logistic regression of the label on the evidence, from counts by bin, with a little shrinkage."""
    a, b = 0.0, 1.0
    for _ in range(steps):
        g0 = g1 = 0.0
        h00, h01, h11 = 1e-6, 0.0, 1e-2
        g1 -= 1e-2 * b
        for x, y, n in points:
            z = max(-30.0, min(30.0, a + b * x))
            p = 1 / (1 + math.exp(-z))
            g0 += n * (y - p)
            g1 += n * (y - p) * x
            v = n * max(p * (1 - p), 1e-9)
            h00, h01, h11 = h00 + v, h01 + v * x, h11 + v * x * x
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        step = min(1.0, 3.0 / max(abs(da), abs(db), 1e-12))
        a, b = a + step * da, b + step * db
    return a, b


def _score(lexicon: Lexicon, out_names: tuple[str, str] = ("score", "n_hits")):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = automaton(lexicon)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            out, n = [], []
            for text in batch.column("text"):
                folded = fold(text.as_py() or "")
                hits = match.hits(folded)
                z = lexicon.bias + lexicon.slope * max(-LIMIT, min(LIMIT, evidence(lexicon, hits, len(folded)))) if hits else -LIMIT
                out.append(1 / (1 + math.exp(-max(-60.0, min(60.0, z)))) if hits else 0.0)
                n.append(len(hits))
            columns = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.float64()), pa.array(n, pa.int64())], names=[*names, *out_names])

    return run


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score from 0 to 1, predicted (score >= threshold), n_hits.

    A null or empty text has the score 0. Texts are read whole. A null doc_id is in no held-out fold.
    Repeated rows are scored alike; no rows give no rows; other columns play no part.
    """
    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", "text").mapInArrow(_score(lexicon), f"doc_id {kind}, score double, n_hits long")
    return held_out(out).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits")


def clean(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores below threshold, all columns; a null text scores 0 and stays."""
    rest = [c for c in docs.columns if c != "text"]
    judged = docs.select(*[F.col(f"`{c}`") for c in rest], F.col("text").alias("__kept"), "text")
    kinds = ", ".join(f"`{c}` {t}" for c, t in judged.drop("text").dtypes)
    scored = judged.mapInArrow(_score(lexicon, ("__score", "__hits")), f"{kinds}, __score double, __hits long")
    return scored.where(F.col("__score") < threshold).withColumnRenamed("__kept", "text").select(*[f"`{c}`" for c in docs.columns])
