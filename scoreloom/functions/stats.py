"""Percentiles, roundings and other numeric expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sorted(x: Column) -> Column:
    return F.array_sort(F.collect_list(x))


def nearest_index(n: Column, q: float) -> Column:
    """round((n - 1) q), half to even: the index of the nearest rank among n sorted values."""
    return F.bround((n - 1) * F.lit(float(q)), 0).cast("long")


def truncated_index(n: Column, q: float) -> Column:
    """min(n - 1, floor(n q)): another definition than nearest_index."""
    return F.least(n - 1, F.floor(n * F.lit(float(q)))).cast("long")


def nearest_rank(x: Column, q: float) -> Column:
    """The value at nearest_index of the sorted values; null if there are none. It gathers a group in one task: for small groups, see ordered.summaries."""
    values = _sorted(x)
    return F.get(values, nearest_index(F.size(values), q).cast("int"))


def truncated_rank(x: Column, q: float) -> Column:
    """The value at truncated_index of the sorted values; for small groups, as nearest_rank."""
    values = _sorted(x)
    return F.get(values, truncated_index(F.size(values), q).cast("int"))


def _printed(x: Column, form: str) -> Column:
    """x as C's printf prints it, ties of its exact binary value to even; format_string rounds the digits of its text, ties up. Null stays null."""

    def put(values: pd.Series) -> pd.Series:
        return values.map(lambda v: form % v)

    value = x.cast("double")
    return F.when(value.isNotNull(), F.pandas_udf(put, "string")(F.coalesce(value, F.lit(0.0))))  # pandas would take a null for NaN


def significant(x: Column, digits: int = 3) -> Column:
    """x at so many significant digits."""
    return _printed(x, f"%.{digits - 1}e").cast("double")


def percent(part: Column, whole: Column) -> Column:
    """part / whole as text with two decimals and a percent sign; 0.00% unless whole is above 0."""
    return _printed(F.when(whole > 0, part / whole).otherwise(F.lit(0.0)) * 100, "%.2f%%")


def safe_ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """a / b where b is neither null nor 0, else the given value."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(otherwise).cast("double"))


def allclose(a: Column, b: Column, rtol: float = 1e-4, atol: float = 1e-5) -> Column:
    """|a - b| <= atol + rtol |b|; equal infinities are close, NaN is close to nothing."""
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    near = finite(a) & finite(b) & (F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b))
    return ((a == b) & ~F.isnan(b)) | near


def all_close(x: Column, y: Column, rtol: float = 1e-4, atol: float = 1e-5) -> Column:
    """allclose for two arrays; arrays of different lengths aren't close."""
    pairs = F.zip_with(x, y, lambda a, b: allclose(a.cast("double"), b.cast("double"), rtol, atol))
    return (F.size(x) == F.size(y)) & F.forall(pairs, lambda p: F.coalesce(p, F.lit(False)))


def timing_stats(x: Column, digits: int | None = None) -> list[Column]:
    """Mean, population deviation, least, greatest, all at so many significant digits if given, and count."""
    shown = lambda c: significant(c, digits) if digits else c
    return [shown(F.avg(x)).alias("mean"), shown(F.stddev_pop(x)).alias("std"), shown(F.min(x)).alias("min"), shown(F.max(x)).alias("max"), F.count(x).alias("n")]


def metric_summary(x: Column) -> list[Column]:
    """Count, least, mean and true median at 3 decimals, 95th percentile by nearest rank, greatest; for small groups, as nearest_rank."""
    return [
        F.count(x).alias("n"), F.min(x).alias("min"), F.round(F.avg(x), 3).alias("avg"), F.round(F.median(x), 3).alias("p50"),
        nearest_rank(x, 0.95).alias("p95"), F.max(x).alias("max"),
    ]
