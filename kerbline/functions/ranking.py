"""Average ranks, percentile ranks, rank correlation and overlap of the highest; window functions by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank with ties sharing the mean of their ranks."""
    first = F.rank().over(Window.partitionBy(*keys).orderBy(value))
    same = F.count("*").over(Window.partitionBy(*keys, value))
    return first + (same - 1) / 2


def percent_rank(value: str, keys: list[str]) -> Column:
    """Average rank over the number of values that are not null; null for a null."""
    n = F.count(value).over(Window.partitionBy(*keys))
    # nulls sort first and so lift all others by their number
    nulls = F.count("*").over(Window.partitionBy(*keys)) - n
    return F.when(F.col(value).isNotNull(), (average_rank(value, keys) - nulls) / F.nullif(n, F.lit(0)))


def spearman(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y", least: int = 3) -> DataFrame:
    """(keys, n, spearman) from the rows where both are there; null below least rows or without any variance."""
    both = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.select(*keys, average_rank(x, keys).alias("rx"), average_rank(y, keys).alias("ry"))
    n, sx, sy = F.count("*"), F.var_pop("rx"), F.var_pop("ry")
    cov = F.covar_pop("rx", "ry")
    return ranked.groupBy(*keys).agg(n.alias("n"), F.when((n >= least) & (sx > 0) & (sy > 0), F.try_divide(cov, F.sqrt(sx * sy))).alias("spearman"))


def top_overlap(pairs: DataFrame, keys: list[str], id_col: str, x: str = "x", y: str = "y", share: float = 0.1) -> DataFrame:
    """(keys, n, k, top_overlap): of the k highest by x, the share that is among the k highest by y; ties by id."""
    both = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    order = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(c).desc(), id_col))
    n = F.count("*").over(Window.partitionBy(*keys))
    ranked = both.select(*keys, n.alias("n"), F.greatest(F.lit(1), F.rint(n * share)).cast("long").alias("k"), order(x).alias("rx"), order(y).alias("ry"))
    hits = F.sum(F.when((F.col("rx") <= F.col("k")) & (F.col("ry") <= F.col("k")), 1).otherwise(0))
    return ranked.groupBy(*keys, "n", "k").agg((hits / F.col("k")).alias("top_overlap"))


def weighted_mean(value: str, weight: str) -> Column:
    """Of the rows whose value is not null."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return F.try_divide(F.sum(F.col(value) * w), F.nullif(F.sum(w), F.lit(0.0)))


def pearson(x: str, y: str) -> Column:
    """Correlation of the rows where both are there; null without any variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    return F.when((F.var_pop(a) > 0) & (F.var_pop(b) > 0), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def compared(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y", tolerance: float = 1e-5) -> DataFrame:
    """(keys, n, share_within_tol, max_rel_err, spearman) of x against y, from the rows where both are there."""
    both = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    error = F.abs(F.col(x) - F.col(y)) / F.greatest(F.abs(F.col(y)), F.lit(1e-12))
    own = both.groupBy(*keys).agg(F.avg(F.when(error <= tolerance, 1.0).otherwise(0.0)).alias("share_within_tol"), F.max(error).alias("max_rel_err"))
    return spearman(both, keys, x, y).join(own, keys)
