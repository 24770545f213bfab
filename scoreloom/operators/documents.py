"""Nested JSON documents as rows: a row a leaf, with its path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nesting(document: Column) -> Column:
    """An upper bound of a document's depth: its opening brackets."""
    return F.char_length(F.regexp_replace(document, r"[^\[{]", ""))


def leaves(rows: DataFrame, keys: list[str], document: str, depth: int | None = None) -> DataFrame:
    """keys, path, names (the object keys on the way), depth, kind and value (text; null for null) of each leaf of the JSON documents.

    Scalars are leaves, and so are empty objects and arrays, with their JSON as value. A text that is no JSON has no leaf. Each level is one more generator over the rows
    that the level above gave, without a shuffle; levels are as many as the most opening brackets of a document, unless depth is given, and what lies deeper is one leaf of JSON.
    """
    spark = rows.sparkSession
    if depth is None:
        depth = rows.agg(F.max(nesting(F.col(document)))).first()[0] or 0
    none = F.array().cast("array<string>")
    out = rows.select(*keys, F.try_parse_json(document).alias("__v"), F.lit("$").alias("path"), none.alias("names"), F.lit(0).alias("depth")).where("__v IS NOT NULL")
    for _ in range(depth):
        inner = out.lateralJoin(spark.tvf.variant_explode_outer(F.col("__v").outer()), how="left")
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        child = F.col("value").isNotNull()
        out = inner.select(
            *keys, F.coalesce("value", "__v").alias("__v"), F.when(child, F.concat("path", step)).otherwise(F.col("path")).alias("path"),
            F.when(child & F.col("key").isNotNull(), F.array_append("names", F.col("key"))).otherwise(F.col("names")).alias("names"), (F.col("depth") + child.cast("int")).alias("depth"),
        )
    kind = F.lower(F.regexp_extract(F.schema_of_variant("__v"), "^[A-Z]+", 0))
    text = F.when(kind.isin("object", "array"), F.to_json("__v")).otherwise(F.try_variant_get(F.col("__v"), "$", "string"))
    return out.select(*keys, "path", "names", "depth", kind.alias("kind"), text.alias("value"))


def without(found: DataFrame, dropped: tuple[str, ...]) -> DataFrame:
    """The leaves that lie below none of the dropped keys."""
    return found.where(~F.arrays_overlap("names", F.array(*map(F.lit, dropped))))
