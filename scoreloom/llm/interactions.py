"""Filter interaction audit: what each of five filters removes after any others, from the edges of their lattice.

A document fails some of the five filters. It contributes to every edge (the filters already applied, the next one) of
the lattice of subsets, 80 in all; documents are counted by the filters that they fail first, so that an edge takes at most 32 counts a
part. An order of the filters is a path of five edges through the lattice: the 600 steps of all orders are joined to the edges.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import cut

FILTERS = "ABCDE"
#: White space between words.
SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def fails(words: Column, text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides."""
    n = F.size(words).cast("long")
    return {
        "A": n < 100,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < n * 80,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.length(text).cast("long") * 10,
        "D": text.rlike(r"[#$%&*|]"),
    }


def _bits(conditions: dict[str, Column]) -> Column:
    out = F.lit(0)
    for name, failed in conditions.items():
        out = out + F.when(failed, 1 << FILTERS.index(name)).otherwise(0)
    return out


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed) of every row: its language and the filters that it fails as bits.

    Texts are read once, and equal ones found by their SHA-256; null ones are empty. E fails where the same text stands under a smaller doc_id: rows that
    share a doc_id don't fail each other, and a null doc_id neither fails nor makes others fail.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.array_remove(F.split(text, SPACE), "").alias("words"))
    rows = cut(rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("same"), _bits(fails(F.col("words"), F.col("text"))).alias("own")))
    first = rows.groupBy("same").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    both = rows.join(first.select("same", "first"), "same", "left")
    return both.select("doc_id", "part", (F.col("own") + _bits({"E": F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))})).alias("failed"))


def edges(counts: DataFrame) -> DataFrame:
    """(part, applied, next) with COUNTS and shapley, from (part, failed, n, good, toxic): all 80 edges of each part."""
    bit = [1 << i for i in range(len(FILTERS))]
    lattice = [F.struct(F.lit(s).alias("applied"), F.lit(b).alias("next")) for b in bit for s in range(1 << len(FILTERS)) if not s & b]
    at = counts.withColumn("edge", F.explode(F.array(*lattice))).select("*", "edge.*").drop("edge")
    earlier = F.col("failed").bitwiseAND(F.col("applied")) != 0
    here = F.col("failed").bitwiseAND(F.col("next")) != 0
    total = lambda column, where, name: F.sum(F.when(where, F.col(column)).otherwise(0)).alias(name)
    out = at.groupBy("part", "applied", "next").agg(
        total("n", ~earlier & ~here, "kept"), total("n", ~earlier & here, "removed"), total("n", earlier & here, "redundant"), total("n", F.col("failed") == F.col("next"), "unique_fails"),
        total("good", ~earlier & here, "good_lost"), total("toxic", ~earlier & here, "toxic_lost"),
    )
    # of the orders, so many pass an edge: those of what is applied times those of what is still to come
    paths = [factorial(k) * factorial(len(FILTERS) - 1 - k) for k in range(len(FILTERS))]
    weighed = F.col("removed") * F.get(F.array(*map(F.lit, paths)), F.bit_count("applied"))
    sums = out.groupBy("part", "next").agg(F.sum(weighed).alias("shapley"))
    return out.join(sums, ["part", "next"])


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step from 1, bits applied before, bit of the filter) of all orders: 600 rows."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, name in enumerate(order):
            out.append(("".join(order), k + 1, before, 1 << FILTERS.index(name)))
            before |= 1 << FILTERS.index(name)
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: COUNTS and shapley, zeros included.

    Every row of docs counts. A document is good or toxic if one of its labels says so; labels without a document play no part. Empty texts
    fail A alone. No documents give no rows; other columns play no part.
    """
    said = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    marks = marks.where("good = 1 or toxic = 1")
    counted = judged(docs).join(marks, "doc_id", "left").groupBy("part", "failed").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )
    paths = docs.sparkSession.createDataFrame(steps(), "filter_order string, step int, applied int, next int")
    return edges(counted).join(F.broadcast(paths), ["applied", "next"]).select("part", "filter_order", "step", *COUNTS, "shapley")


SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
o AS (SELECT t, min(doc_id) AS first FROM w GROUP BY t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
|| CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS failed
FROM w JOIN o USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
p(o) AS (SELECT '' UNION ALL SELECT o || x FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE length(o) < 5 AND NOT contains(o, x)),
s AS (SELECT o AS filter_order, step, o[step] AS letter, o[1:step - 1] AS before FROM (SELECT o, unnest(range(1, 6)) AS step FROM p WHERE length(o) = 5)),
e AS (SELECT part, filter_order, step, letter, n, good, toxic, contains(failed, letter) AS here, before <> '' AND regexp_matches(failed, '[' || before || '_]') AS earlier, failed = letter AS alone FROM c, s),
a AS (SELECT part, filter_order, CAST(step AS INT) AS step, letter, sum(CASE WHEN NOT here AND NOT earlier THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN here AND NOT earlier THEN n ELSE 0 END)::BIGINT AS removed,
sum(CASE WHEN here AND earlier THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN here AND NOT earlier THEN good ELSE 0 END)::BIGINT AS good_lost,
sum(CASE WHEN here AND NOT earlier THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM e GROUP BY ALL)
SELECT * EXCLUDE letter, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM a"""
