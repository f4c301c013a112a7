"""Statistics by the conventions that the reports need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Error of an approximate rank is a group's size over ACCURACY; MARGIN is three times that, so
#: that beyond SMALL values the bounds are at least two ranks from the one that is looked for.
ACCURACY, MARGIN, SMALL = 10_000, 3e-4, 10_000


def deviation(value: str) -> Column:
    """Sample standard deviation; 0 for a single value."""
    return F.coalesce(F.stddev_samp(value), F.lit(0.0))


def midpoint_percentile(df: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """Percentile by the midpoint rule: at rank clamp(p n + 0.5, 1, n), interpolated. Exact; null values don't count.

    An approximate percentile, whose rank is wrong by n / ACCURACY at most, gives
    a lower and an upper bound about the rank; values below are counted, and
    only those between (a few thousandths of the group, equal ones once) are
    ordered. Outliers make no difference. A group of up to SMALL values is ordered whole.
    """
    rows = df.where(F.col(value).isNotNull())
    near = [min(max(p + d, 0.0), 1.0) for d in (-MARGIN, MARGIN)]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(value).alias("_least"), F.max(value).alias("_most"), F.percentile_approx(value, near, ACCURACY).alias("_near"))
    small = F.col("_n") <= SMALL
    rank = F.least(F.greatest(F.col("_n") * p + 0.5, F.lit(1.0)), F.col("_n").cast("double"))
    sizes = sizes.select(*keys, rank.alias("_h"), F.when(small, F.col("_least")).otherwise(F.col("_near")[0]).alias("_lo"), F.when(small, F.col("_most")).otherwise(F.col("_near")[1]).alias("_hi"))
    placed = rows.select(*keys, value).join(sizes, keys)
    # one row for all values below, with their count; the others by value
    counts = placed.where(F.col(value) <= F.col("_hi")).groupBy(*keys, "_h", F.when(F.col(value) >= F.col("_lo"), F.col(value)).alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()))
    at = counts.withColumn("_upto", upto)
    holds = lambda k: (F.col("_upto") >= k) & (F.col("_upto") - F.col("_c") < k)
    low, high = (F.max(F.when(holds(k), F.col("_v"))) for k in (F.floor("_h"), F.ceil("_h")))
    out = at.groupBy(*keys).agg(low.alias("_a"), high.alias("_z"), F.max(F.col("_h") - F.floor("_h")).alias("_f"))
    return out.select(*keys, (F.col("_a") + F.col("_f") * (F.col("_z") - F.col("_a"))).alias(name))


def short_number(x: str) -> Column:
    """Three decimals from 0.01, four from 0.001, else scientific."""
    c = F.col(x)
    return F.when(c >= 0.01, F.format_string("%.3f", c)).when(c >= 0.001, F.format_string("%.4f", c)).otherwise(F.format_string("%.2e", c))


def percent(x: str) -> Column:
    """One decimal and a percent sign."""
    return F.format_string("%.1f%%", F.col(x))
