"""Measures from node counts and depths, and classes of values, as column expressions; what is undefined is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def d_value(k: Column) -> Column:
    return F.when(k > 2, 2 * (k * (F.log2((k + 2) / 3) - 1) + 1) / F.nullif((k - 1) * (k - 2), F.lit(0)))


def p_value(k: Column) -> Column:
    return F.when(k > 2, 2 * (k - F.log2(k.cast("double")) - 1) / F.nullif((k - 1) * (k - 2), F.lit(0)))


def mean_depth(k: Column, td: Column) -> Column:
    return F.try_divide(td, F.when(k > 1, k - 1))


def asymmetry(k: Column, td: Column) -> Column:
    """Relative asymmetry; undefined for up to two nodes and for a mean depth of one."""
    md = mean_depth(k, td)
    return F.when((k > 2) & (md > 1), 2 * (md - 1) / F.nullif(k - 2, F.lit(0)))


def integration(k: Column, td: Column) -> dict[str, Column]:
    ra = asymmetry(k, td)
    # the argument of the logarithm below the line must exceed one
    low = td - k + 1
    return {
        "mean_depth": mean_depth(k, td), "ra": ra, "rra": F.try_divide(ra, d_value(k)), "integration_hh": F.try_divide(d_value(k), ra), "integration_pv": F.try_divide(p_value(k), ra),
        "integration_tekl": F.when(ra.isNotNull() & (low > 1), F.try_divide(F.ln(0.5 * (k - 2)), F.ln(low.cast("double")))),
    }


def angular(nc: Column, td: Column, ch: Column) -> dict[str, Column]:
    nc, td, ch = nc.cast("double"), td.cast("double"), ch.cast("double")
    return {"integration": F.when(td > 1e-9, F.try_divide(nc * nc, td)), "nain": F.pow(nc, F.lit(1.2)) / (td + 2), "nach": F.ln(ch + 1) / F.ln(td + 3)}


def normalised_choice(choice: Column, k: Column) -> Column:
    return F.when(k > 2, choice / F.nullif((k - 1) * (k - 2) / 2, F.lit(0.0)))


def quintile(pct: Column) -> Column:
    """0 to 4 of a percentile rank, equal values together; -1 where missing."""
    return F.coalesce(F.least(F.lit(4), F.greatest(F.lit(0), F.floor(pct * 5 - 1e-9))), F.lit(-1)).cast("long")


def percentile99(pct: Column) -> Column:
    return F.coalesce(F.least(F.lit(99), F.greatest(F.lit(0), F.floor(pct * 100 - 1e-9))), F.lit(-1)).cast("long")


def classed(value: Column, edges: list[float], right_closed: bool = False) -> Column:
    """The number of edges at or below (right closed: below) value."""
    out = F.lit(0)
    for e in edges:
        out = out + F.when(value > e if right_closed else value >= e, 1).otherwise(0)
    return F.when(value.isNotNull(), out).cast("long")


DIVERGENCE = [-0.5, -0.25, -0.1, 0.1, 0.25, 0.5]


def divergence99(a: Column, b: Column) -> Column:
    """Class 0 to 6 of the difference of two percentiles from 0 to 99; -1 where one is missing. Middle classes take both their edges."""
    d = a - b
    out = F.when(d <= -50, 0).when(d <= -25, 1).when(d < -10, 2).when(d <= 10, 3).when(d < 25, 4).when(d < 50, 5).otherwise(6)
    return F.when((a >= 0) & (b >= 0), out).otherwise(-1).cast("long")


def quantile_bins(rows: DataFrame, column: str, shares: list[float], right_closed: bool = False) -> DataFrame:
    """Adds bin, by the column's own quantiles: how many lie at or below (right closed: below) its value."""
    edges = rows.agg(F.percentile(column, F.array(*map(F.lit, shares))).alias("__e"))
    over = lambda e: (F.col(column) > e) if right_closed else (F.col(column) >= e)
    number = F.aggregate("__e", F.lit(0).cast("long"), lambda s, e: s + F.when(over(e), 1).otherwise(0))
    return rows.crossJoin(F.broadcast(edges)).withColumn("bin", F.when(F.col(column).isNotNull(), number)).drop("__e")  # one row
