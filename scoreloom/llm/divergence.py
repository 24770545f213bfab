"""Source divergence audit: how the words of each source of a language differ from other sources and from the language.

Tasks count terms by source in vectorized SQL. The counts are dealt into shards by a hash of language and term, so
that all counts of a term meet; DuckDB finds in each shard the kept terms, then partial sums of pairs of
sources and the shard's first ranks. Spark adds and ranks what the shards give.

A pair's value sums over all kept terms, most of which either source lacks. A source's share of a term that it lacks is one
number, p0. With f(p, q) the term's part, the sum is that of f(p, q0) over all terms plus that of f(p0, q) - f(p0, q0) over the other's
terms, both from histograms of shares, plus a correction for the terms that both have, which alone are joined in the shards.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import shared_folder, slices

#: Bytes of texts that are counted at once, and of a piece of a long text.
BYTES = 4 << 20
#: Rows of a shard, about, and how many shards there are at least.
SHARD_ROWS, MIN_SHARDS = 250_000, 96
#: A term is kept if so many documents of its language hold it; ranks of terms; the unit of shares.
MIN_DOCS, RANKS, UNIT = 3, 200, 1_000_000_000
#: Salts between which a group's terms are ranked first.
SALTS = 32

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_BREAK = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def _duck():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "preserve_insertion_order": False})


def _pieces(batch: pa.RecordBatch) -> pa.Table:
    """The rows of batch, numbered, with texts in lower case (A-Z alone); a long text is several rows, each a batch of its own, cut between terms."""
    text = pc.ascii_lower(pc.fill_null(batch.column("text"), ""))
    names = ["lang", "source", "doc", "text"]
    if len(batch) > 1 or len(text) and pc.binary_length(text)[0].as_py() <= BYTES:
        return pa.Table.from_arrays([batch.column("lang"), batch.column("source"), pa.array(range(len(batch)), pa.int64()), text], names=names)
    whole, at, out = text[0].as_py() if len(text) else "", 0, []
    while at < len(whole):
        found = _BREAK.search(whole, at + BYTES)
        to = found.start() if found else len(whole)
        out.append(pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("source"), pa.array([0], pa.int64()), pa.array([whole[at:to]], text.type)], names=names))
        at = to
    return pa.Table.from_batches(out) if out else pa.Table.from_arrays([pa.array([], t) for t in (pa.string(), pa.string(), pa.int64(), pa.string())], names=names)


COUNT_SQL = f"""WITH t AS (SELECT lang, source, doc, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM texts), d AS (SELECT lang, source, doc, term, count(*) AS n FROM t GROUP BY ALL)
SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM d GROUP BY ALL"""

KEPT_SQL = f"""WITH k AS (SELECT lang, term, sum(n) AS all_n, min(source) AS least FROM counts GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS})
SELECT c.lang, c.source, c.term, c.n, CAST(k.all_n AS BIGINT) AS lang_n, c.source = k.least AS first FROM counts c JOIN k USING (lang, term)"""

# shares as 128-bit integers while they are made; a share is at most UNIT + 1, so that squares of differences fit 64 bits
SHARES_SQL = f"""CREATE TABLE shares AS SELECT lang, source, term, CAST(1 + ({UNIT}::HUGEINT * (n + 1)) // (total + v) AS BIGINT) AS p, CAST(1 + {UNIT}::HUGEINT // (total + v) AS BIGINT) AS p0,
CAST(1 + ({UNIT}::HUGEINT * (lang_n + 1)) // (lang_total + v) AS BIGINT) AS q FROM kept"""

SUMS_SQL = f"""SELECT lang, source, 'both' AS part, item, CAST(sum(x) AS BIGINT) AS value, 0::BIGINT AS n FROM (SELECT a.lang, a.source, b.source AS item,
(a.p - b.p) * (a.p - b.p) // b.p - (a.p - b.p0) * (a.p - b.p0) // b.p0 - (a.p0 - b.p) * (a.p0 - b.p) // b.p + (a.p0 - b.p0) * (a.p0 - b.p0) // b.p0 AS x
FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source) GROUP BY ALL
UNION ALL SELECT lang, source, 'share', NULL, p, count(*) FROM shares GROUP BY ALL
UNION ALL SELECT lang, source, 'term', term, value, 0 FROM (SELECT lang, source, term, (p - q) * (p - q) // q AS value FROM shares WHERE p > q)
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {RANKS}"""


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    duck = _duck()
    for part in (part for whole in batches for part in slices(whole, "text", BYTES)):
        duck.register("texts", _pieces(part))
        yield from duck.sql(COUNT_SQL).to_arrow_table().to_batches()
        duck.unregister("texts")


def _kept(counts: pa.Table) -> pa.Table:
    duck = _duck()
    duck.register("counts", counts)
    return duck.sql(KEPT_SQL).to_arrow_table()


def _sums(kept: pa.Table) -> pa.Table:
    duck = _duck()
    duck.register("kept", kept)
    duck.execute(SHARES_SQL)
    return duck.sql(SUMS_SQL).to_arrow_table()


def _stored(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/divergence-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sharded(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int"))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term, by source."""
    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    rows = named.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _part(p: str, q: str) -> str:
    return f"({p} - {q}) * ({p} - {q}) div {q}"


def audit(docs: DataFrame, shard_rows: int = SHARD_ROWS, min_shards: int = MIN_SHARDS) -> DataFrame:
    """Per language and source its divergence from the other sources (part pair) and its terms above the language's share (part term), ranked.

    Null texts, languages and sources are ''. Every row is a document of its own. A source without terms has the share of a term that
    it lacks for every kept term; a language without kept terms gives its pairs the value 0; a language of one source has no pairs.
    No rows give no rows; other columns play no part. The values fit a long while a language keeps fewer than 10^9 terms.
    """
    counts = _stored(term_counts(docs))
    shards = max(min_shards, -(-counts.count() // shard_rows))
    kept = _stored(_sharded(counts, shards).select("shard", "lang", "source", "term", "n", "docs").groupBy("shard").applyInArrow(lambda t: _kept(t), "lang string, source string, term string, n long, lang_n long, first boolean"))

    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("v"))
    langs = own.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("v").alias("v"))
    occurring = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    groups = occurring.join(own.drop("v"), ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "lang_total", "v"])
    groups = _stored(groups.withColumn("p0", F.when(F.col("v") > 0, F.expr(f"1 + {UNIT}L div (total + v)"))))

    rows = _sharded(kept, shards).join(groups.drop("p0"), ["lang", "source"]).select("shard", "lang", "source", "term", "n", "lang_n", "total", "v", "lang_total")
    found = _stored(rows.groupBy("shard").applyInArrow(lambda t: _sums(t), "lang string, source string, part string, item string, value long, n long"))

    # histograms of shares; the terms that a source lacks have the share p0
    has = found.where("part = 'share'").groupBy("lang", "source", F.col("value").alias("p")).agg(F.sum("n").alias("n"))
    lacks = groups.join(has.groupBy("lang", "source").agg(F.sum("n").alias("terms")), ["lang", "source"], "left").where("v > 0").select("lang", "source", F.col("p0").alias("p"), (F.col("v") - F.coalesce("terms", F.lit(0))).alias("n"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    one = has.unionByName(lacks).join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.expr(f"n * ({_part('p', 'q0')})")).alias("value"))
    mine = groups.where("v > 0").select("lang", "source", "p0")
    two = has.withColumnRenamed("source", "item").join(other.select("lang", "item", "q0"), ["lang", "item"]).join(mine, "lang").where("source <> item")
    two = two.groupBy("lang", "source", "item").agg(F.sum(F.expr(f"n * ({_part('p0', 'p')} - {_part('p0', 'q0')})")).alias("value"))
    both = found.where("part = 'both'").select("lang", "source", "item", "value")
    none = groups.where("v = 0").select("lang", "source").join(other.select("lang", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = one.unionByName(two).unionByName(both).unionByName(none.select("lang", "source", "item", "value")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    order = [F.desc("value"), F.asc("item")]
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).withColumn("part", F.lit("pair"))
    terms = found.where("part = 'term'").select("lang", "source", "item", "value").withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    best = terms.withColumn("i", F.row_number().over(Window.partitionBy("lang", "source", "salt").orderBy(*order))).where(F.col("i") <= RANKS)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= RANKS).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(*columns).unionByName(best.select(*columns))


SQL = rf"""WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS MATERIALIZED (SELECT lang, source, doc, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM d), k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang), g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d), c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT lang, source, term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (total + v)::HUGEINT AS BIGINT) AS p FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (k.n + 1)) // (v.n + v)::HUGEINT AS BIGINT) AS q FROM k JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r QUALIFY part = 'pair' OR rank <= 200"""
