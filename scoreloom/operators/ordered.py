"""Order-dependent operators: latest rows, queues, samples, sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions import stats
from scoreloom.sources.files import scratch


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by the order columns; aggregated before the shuffle, so that hot keys don't gather."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return rows.groupBy(*keys).agg(best).select(*keys, "__row.*").select(*rows.columns)


def first_of(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Order-keeping dedup: each key with its first position."""
    return rows.groupBy(*keys).agg(F.min(position).alias(position))


def queue_positions(rows: DataFrame, queue: list[str], order: list[str], parts: int = 64) -> DataFrame:
    """rows with fifo_position from 1 within each queue; the first column of order is numeric or a time.

    Rows are numbered within a queue's ranges of that column and start from the count of the queue's ranges before.
    """
    part = range_of(rows, order[0], parts)
    if part is None:
        return rows.withColumn("fifo_position", F.row_number().over(Window.partitionBy(*queue).orderBy(*order)))
    parted = rows.withColumn("__part", part)
    within = parted.withColumn("__i", F.row_number().over(Window.partitionBy(*queue, "__part").orderBy(*order)))
    counts = parted.groupBy(*queue, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*queue).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    both = within.alias("a").join(offsets.alias("b"), _same("a", "b", [*queue, "__part"]))
    return both.select(*[f"a.{c}" for c in rows.columns], (F.col("b.__offset") + F.col("a.__i")).alias("fifo_position"))


#: Rows that a range holds at least, about; so many rows in all are one range.
RANGE_ROWS = 250_000


def range_of(df: DataFrame, order: str, parts: int = 64, least: int | None = None) -> Column | None:
    """The range, from 0 and fewer than parts, of the numeric or time column order between its approximate quantiles, of which the driver gets
    parts - 1; None if there are no more than `least` rows (RANGE_ROWS), which a task sorts at once."""
    least = RANGE_ROWS if least is None else least
    if df.limit(least + 1).count() <= least:
        return None
    bounds = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    part = F.lit(0)
    for x in sorted(set(bounds)):
        part = part + F.when(F.col(order) > F.lit(x), 1).otherwise(0)
    return part


def _same(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def _at_indexes_by_ranges(rows: DataFrame, keys: list[str], x: str, wanted: dict[str, Callable[[Column], Column]], parts: int = 64) -> DataFrame:
    """at_indexes for groups of which a sketch has missed a value.

    No task holds a group: equal values are counted first, a window over the few ranges of a group finds the range
    of each index, and only the values of those ranges are sorted, each range by itself.
    """
    counts = rows.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    parted = counts.withColumn("__part", range_of(counts, "__v", parts, 0))
    sums = parted.groupBy(*keys, "__part").agg(F.sum("__n").alias("__size"))
    group = Window.partitionBy(*keys)
    sums = sums.withColumns({"__before": F.sum("__size").over(group.orderBy("__part")) - F.col("__size"), "__all": F.sum("__size").over(group)})
    local = {f"__at_{k}": f(F.col("__all")) - F.col("__before") for k, f in wanted.items()}
    inside = sums.select(*keys, "__part", *[F.when((i >= 0) & (i < F.col("__size")), i).alias(k) for k, i in local.items()])
    hit = inside.where(F.coalesce(*local).isNotNull())
    both = parted.alias("p").join(hit.alias("h"), _same("p", "h", [*keys, "__part"])).select("p.*", *[f"h.{k}" for k in local])
    upto = F.sum("__n").over(Window.partitionBy(*keys, "__part").orderBy("__v"))
    ranked = both.withColumn("__upto", upto)
    here = lambda k: (F.col(f"__at_{k}") < F.col("__upto")) & (F.col(f"__at_{k}") >= F.col("__upto") - F.col("__n"))
    return ranked.groupBy(*keys).agg(*[F.max(F.when(here(k), F.col("__v"))).alias(k) for k in wanted])


#: Size of the sketches, about twice the error of their ranks, and the points in rank at which they are read.
SKETCH, MARGIN, GRID = 4000, 2, 1024
#: Groups whose brackets are broadcast at most.
FEW_GROUPS = 100_000


def at_indexes(rows: DataFrame, keys: list[str], x: str, wanted: dict[str, Callable[[Column], Column]], parts: int = 64) -> DataFrame:
    """keys and, under each name of wanted, the value at the index that it makes of the number of a group's sorted values; nulls don't count."""
    return _picked(rows, keys, x, _bracketed(rows, keys, x, [], wanted), wanted, parts)


def _bracketed(rows: DataFrame, keys: list[str], x: str, plain: list[Column], wanted: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys, the aggregates plain, __n values, and for each name of wanted a lower and an upper bound of its value, from a sketch of the group."""
    spark = rows.sparkSession
    sketch = F.kll_sketch_agg_double(F.col(x).cast("double"), F.lit(SKETCH)).alias("__sketch")
    points = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    groups = rows.groupBy(*keys).agg(*plain, F.count(x).alias("__n"), sketch)
    read = groups.withColumn("__grid", F.when(F.col("__n") > 0, F.kll_sketch_get_quantile_double("__sketch", points))).drop("__sketch")
    at = lambda f, by, side: F.get("__grid", F.greatest(F.lit(0), F.least(F.lit(GRID), (side(F.try_divide(f(F.col("__n")) + 0.5, F.col("__n")) * GRID) + by).cast("int"))))
    bounds = [c for k, f in wanted.items() for c in (at(f, -MARGIN, F.floor).alias(f"__lo_{k}"), at(f, MARGIN, F.ceil).alias(f"__hi_{k}"))]
    kept = scratch(spark)
    out = read.select("*", *bounds).drop("__grid")
    out.write.parquet(kept)
    return spark.read.schema(out.schema).parquet(kept)


def _picked(rows: DataFrame, keys: list[str], x: str, groups: DataFrame, wanted: dict[str, Callable[[Column], Column]], parts: int = 64) -> DataFrame:
    """at_indexes with the bounds of _bracketed.

    One pass counts: the values within the bounds each, those between them as one cell, so that little is shuffled of a group; a window
    over its cells finds the indexes. A value that the bounds have missed lies in such a cell: these groups are done again by ranges.
    """
    spark = rows.sparkSession
    names = [c for k in wanted for c in (f"__lo_{k}", f"__hi_{k}")]
    bounds = groups.where("__n > 0").select(*keys, "__n", *names)
    if bounds.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS:
        bounds = F.broadcast(bounds)
    values = rows.where(F.col(x).isNotNull()).select(*keys, F.col(x).alias("__v"))
    both = values.alias("r").join(bounds.alias("g"), _same("r", "g", keys)).select("r.*", "__n", *names)
    d = F.col("__v").cast("double")
    inside, above = F.lit(False), F.lit(0)
    for k in wanted:
        inside = inside | ((d >= F.col(f"__lo_{k}")) & (d <= F.col(f"__hi_{k}")))
        above = above + F.when(d > F.col(f"__hi_{k}"), 1).otherwise(0)
    celled = both.select(*keys, "__v", "__n", F.when(inside, F.col("__v")).alias("__cell"), F.when(~inside, above).alias("__gap"))
    cells = celled.groupBy(*keys, "__cell", "__gap").agg(F.count(F.lit(1)).alias("__m"), F.min("__v").alias("__v"), F.max("__v").alias("__last"), F.max("__n").alias("__n"))
    ranked = cells.withColumn("__upto", F.sum("__m").over(Window.partitionBy(*keys).orderBy("__v")))
    here = {k: (f(F.col("__n")) < F.col("__upto")) & (f(F.col("__n")) >= F.col("__upto") - F.col("__m")) for k, f in wanted.items()}
    missed = F.lit(False)
    for found in here.values():
        missed = missed | (found & (F.col("__v") != F.col("__last")))
    out = ranked.groupBy(*keys).agg(*[F.max(F.when(found, F.col("__v"))).alias(k) for k, found in here.items()], F.max(missed).alias("__missed"))
    kept = scratch(spark)
    out.write.parquet(kept)
    done = spark.read.schema(out.schema).parquet(kept)
    rest = done.where("__missed")
    done = done.where("NOT __missed").drop("__missed")
    if rest.isEmpty():
        return done
    again = rows.alias("r").join(rest.select(*keys).alias("g"), _same("r", "g", keys), "left_semi")
    return done.unionByName(_at_indexes_by_ranges(again, keys, x, wanted, parts).select(*done.columns))


def summaries(rows: DataFrame, keys: list[str], x: str, plain: list[Column], indexes: dict[str, Callable[[Column], Column]], median: str | None = None) -> DataFrame:
    """The aggregates plain of each group of rows, the values at indexes (see at_indexes), and the true median of x under the name median."""
    wanted = dict(indexes)
    if median:
        wanted |= {"__low": lambda n: F.floor((n - 1) / 2), "__high": lambda n: F.ceil((n - 1) / 2)}
    groups = _bracketed(rows, keys, x, plain, wanted)
    found = _picked(rows, keys, x, groups, wanted)
    both = groups.alias("a").join(found.alias("b"), _same("a", "b", keys), "left")
    middle = [(F.col("b.__low") * 0.5 + F.col("b.__high") * 0.5).alias(median)] if median else []
    own = [c for c in groups.columns if not c.startswith("__")]
    return both.select(*[f"a.`{c}`" for c in own], *[f"b.{k}" for k in indexes], *middle)


def metric_summary(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """stats.metric_summary for groups of any size."""
    plain = [F.count(x).alias("n"), F.min(x).alias("min"), F.round(F.avg(x), 3).alias("avg"), F.max(x).alias("max")]
    out = summaries(rows, keys, x, plain, {"p95": lambda n: stats.nearest_index(n, 0.95)}, "p50")
    return out.select(*keys, "n", "min", "avg", F.round("p50", 3).alias("p50"), "p95", "max")


def trailing_count(rows: DataFrame, key: str, micros: str, wanted: Column, span_micros: int) -> DataFrame:
    """rows with n_trailing: the wanted rows of the same key in the span up to each row, its far end excluded."""
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-span_micros + 1, Window.currentRow)
    return rows.withColumn("n_trailing", F.count_if(wanted).over(w))


def exact_sample(rows: DataFrame, stratum: str, sizes: dict, key: Column) -> DataFrame:
    """Exactly sizes[s] rows of each stratum s, the first by key; fails if a stratum is short."""
    counts = {r[0]: r[1] for r in rows.where(F.col(stratum).isin(list(sizes))).groupBy(stratum).count().collect()}
    short = {s: n for s, n in sizes.items() if counts.get(s, 0) < n}
    if short:
        raise ValueError(f"too few rows for {short}; there are {counts}")
    parts = [rows.where(F.col(stratum) == F.lit(s)).orderBy(key).limit(n) for s, n in sizes.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def wait_action(age_sec: Column, status: Column, owner_ok: Column, task_timeout: Column, queue_timeout: Column) -> Column:
    """What happens to a waiting task: stale assignments and those beyond the least of both timeouts are requeued."""
    limit = F.when((task_timeout > 0) & (queue_timeout > task_timeout), task_timeout).otherwise(queue_timeout)
    return (
        F.when(~owner_ok, "requeue_stale_assignment").when(status != "pending", "keep").when(age_sec.isNull() | (limit <= 0), "keep")
        .when(age_sec > limit, "requeue_queue_wait_timeout").otherwise("keep")
    )


def rotated(items: Column, by: Column) -> Column:
    """items begun at index `by` modulo their number."""
    k = F.pmod(by, F.size(items)).cast("int")
    return F.concat(F.slice(items, k + 1, F.size(items) - k), F.slice(items, F.lit(1), k))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of old with those of new in place of rows of the same keys."""
    both = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)))
    return latest(both, keys, "__age").drop("__age")
