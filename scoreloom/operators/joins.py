"""Joins that take more than a condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators import ordered


def pair_results(kernels: DataFrame, references: DataFrame, key: str = "base_task_id") -> DataFrame:
    """Kernel results with their reference result, and the speedup.

    references holds key and reference_runtime, kernels key, correctness and kernel_runtime. Without a
    reference the runtime is -1.0; the speedup is 0.0 unless the kernel is correct and both runtimes are above 0.
    """
    runtime = F.coalesce("reference_runtime", F.lit(-1.0))
    fast = F.coalesce(F.col("correctness"), F.lit(False)) & (F.col("kernel_runtime") > 0) & (runtime > 0)
    return kernels.join(references.select(key, "reference_runtime"), key, "left").withColumns(
        {"reference_runtime": runtime, "speedup": F.when(fast, F.try_divide(runtime, F.col("kernel_runtime"))).otherwise(0.0)}
    )


def merge_metadata(first: Column, second: Column) -> Column:
    """Two maps as one; the second's value wins."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    a, b = F.coalesce(first, empty), F.coalesce(second, empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def lookup(rows: DataFrame, tables: list[DataFrame], key: str, value: str) -> DataFrame:
    """rows with value from the first of tables that has the key."""
    out = rows
    for i, t in enumerate(tables):
        out = out.join(t.select(key, F.col(value).alias(f"__{i}")), key, "left")
    return out.withColumn(value, F.coalesce(*[F.col(f"__{i}") for i in range(len(tables))])).drop(*[f"__{i}" for i in range(len(tables))])


def pieces(low: Column, high: Column) -> Column:
    """The numbers from low to high as array of struct(level, at): disjoint runs from at 2^level on, 2^level long each, at most two of a level."""
    shift = lambda x, k: F.call_function("shiftright", x, k)
    odd = lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 1

    def of(k: Column) -> Column:
        first, past = -shift(-low, k), shift(high + 1, k)  # what is left of the run at this level
        left = F.when((first < past) & odd(first), F.struct(k.alias("level"), first.alias("at")))
        right = F.when((first < past) & odd(past), F.struct(k.alias("level"), (past - 1).alias("at")))
        return F.array(left, right)

    levels = F.sequence(F.lit(0), F.floor(F.log2((high - low + 2).cast("double"))).cast("int"))
    return F.array_compact(F.flatten(F.transform(levels, of)))


def interval_join(left: DataFrame, right: DataFrame, on: list[str], a: tuple[str, str], b: tuple[str, str], unit: int | None = None) -> DataFrame:
    """Rows of left and right, equal on the columns `on`, whose closed intervals overlap.

    a and b name the integer start and end columns of left and right, which must differ. Two intervals overlap if one begins within
    the other, so that pairs come from two joins of starts with intervals: those that begin in a left one, and left starts after a right one's. Intervals are
    cut into runs of cells of `unit` numbers, two for each power of two at most, however long they are; a start looks in the run of each size
    that some interval has. The unit is a quarter of the usual length unless given.
    """
    one, two = left.where(F.col(a[1]) >= F.col(a[0])), right.where(F.col(b[1]) >= F.col(b[0]))
    if unit is None:
        length = lambda df, c: df.select((F.col(c[1]) - F.col(c[0]) + 1).cast("double").alias("n"))
        usual = length(one, a).unionByName(length(two, b)).agg(F.avg(F.log2("n"))).first()[0]
        unit = max(1, int(2 ** ((usual or 0) - 2)))
    cell = lambda x: F.floor(x / F.lit(unit)).cast("long")
    shift = lambda x, k: F.call_function("shiftright", x, k)

    def meet(spans: DataFrame, of: tuple[str, str], starts: DataFrame, start: str) -> DataFrame:
        runs = spans.withColumn("__run", F.explode(pieces(cell(F.col(of[0])), cell(F.col(of[1])))))
        sizes = sorted(r[0] for r in runs.select("__run.level").distinct().collect())  # 63 at most
        if not sizes:
            sizes = [0]
        at = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), shift(cell(F.col(start)), F.lit(k)).alias("at")) for k in sizes]))
        return runs.join(starts.withColumn("__run", at), [*on, "__run"]).drop("__run")

    began = meet(one, a, two, b[0]).where((F.col(b[0]) >= F.col(a[0])) & (F.col(b[0]) <= F.col(a[1])))
    later = meet(two, b, one, a[0]).where((F.col(a[0]) > F.col(b[0])) & (F.col(a[0]) <= F.col(b[1])))
    return began.unionByName(later.select(*began.columns))


def fuzzy_match(a: Column, b: Column) -> Column:
    """Equal or one within the other, whatever the case."""
    x, y = F.lower(a), F.lower(b)
    return F.contains(x, y) | F.contains(y, x)


def fuzzy_semi(rows: DataFrame, name: str, words: DataFrame, word: str, gram: int = 3) -> DataFrame:
    """The rows whose name is a word, holds one or is held by one, whatever the case; null names match nothing.

    Nothing is compared with everything: what is held begins with a few characters that its holder has somewhere, so that
    holders are joined by all their runs of up to gram characters, and candidates are verified.
    """
    n = rows.select(F.lower(name).alias("n")).where("n is not null").distinct()
    w = words.select(F.lower(word).alias("w")).where("w is not null").distinct()

    def runs(x: str) -> Column:
        size = F.char_length(x)
        of = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - k + 1)), lambda i: F.substring(x, i, F.lit(k)))
        some = [of(k) for k in range(1, gram + 1)]
        return F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *some))).alias("run")

    def start(x: str) -> Column:
        return F.substring(x, 1, gram).alias("run")

    one = n.select("n", runs("n")).join(w.select("w", start("w")), "run").where(F.contains("n", "w"))
    two = w.select("w", runs("w")).join(n.select("n", start("n")), "run").where(F.contains("w", "n"))
    found = one.select("n").unionByName(two.select("n")).distinct()
    return rows.join(found, F.lower(name) == F.col("n"), "left_semi")


def positional_compare(left: DataFrame, right: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Rows of two tables by their position in `order`: whether each of columns is equal, nulls alike.

    The order column is numeric or a time; see numbered().
    """
    a, b = numbered(left, order), numbered(right, order)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")).alias(f"{c}_equal") for c in columns]
    return a.alias("a").join(b.alias("b"), "position", "full").select("position", F.col(f"a.{order}").isNotNull().alias("in_left"), F.col(f"b.{order}").isNotNull().alias("in_right"), *same)


def numbered(df: DataFrame, order: str, parts: int = 64) -> DataFrame:
    """df with position from 1 by its numeric or time column order, which no task sorts as a whole.

    Rows fall between approximate quantiles, of which the driver gets parts - 1, are numbered there, and start
    from the count of the rows before.
    """
    part = ordered.range_of(df, order, parts)
    if part is None:
        return df.withColumn("position", F.row_number().over(Window.orderBy(order)).cast("long"))
    parted = df.withColumn("__part", part)
    within = parted.withColumn("__i", F.row_number().over(Window.partitionBy("__part").orderBy(order)))
    counts = parted.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return within.join(F.broadcast(offsets), "__part").withColumn("position", F.col("__offset") + F.col("__i")).drop("__part", "__i", "__offset")


def unambiguous(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) for the keys with a single value."""
    return rows.groupBy(key).agg(F.min(value).alias(value), F.count_distinct(value).alias("__n")).where("__n = 1").drop("__n")
