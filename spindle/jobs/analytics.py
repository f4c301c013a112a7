"""Reports over benchmark timings (executable, threads, chunk, run, time)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindle.functions.statistics import deviation, midpoint_percentile, percent, short_number

GROUP = ["executable", "threads"]


def p90(times: DataFrame) -> DataFrame:
    return midpoint_percentile(times, GROUP, "time", 0.9, "p90")


def chunk_p90(times: DataFrame) -> DataFrame:
    return midpoint_percentile(times, [*GROUP, "chunk"], "time", 0.9, "p90")


def std(times: DataFrame) -> DataFrame:
    return times.groupBy(*GROUP).agg(deviation("time").alias("std"))


def mean(times: DataFrame) -> DataFrame:
    return times.groupBy(*GROUP).agg(F.avg("time").alias("mean"))


def baseline(summary: DataFrame, name: str) -> DataFrame:
    """Mean over the thread counts of the first executable whose name holds `name`, case ignored."""
    own = summary.where(F.lower("executable").contains(name.lower()))
    first = own.agg(F.min("executable").alias("executable"))
    return own.join(F.broadcast(first), "executable").agg(F.avg("p90").alias("baseline"))


def relative(summary: DataFrame, name: str) -> DataFrame:
    """Percent of ideal speed-up for all but the baseline executable."""
    base = baseline(summary, name)
    rest = summary.where(~F.lower("executable").contains(name.lower())).crossJoin(F.broadcast(base))
    return rest.select(*GROUP, (F.try_divide(F.col("baseline"), F.col("p90") * F.col("threads")) * 100).alias("efficiency"))


def efficiency(summary: DataFrame, name: str) -> DataFrame:
    """The same, and the ideal line."""
    ideal = summary.select(F.lit("ideal").alias("executable"), "threads", F.lit(100.0).alias("efficiency")).distinct()
    return relative(summary, name).unionByName(ideal)


def _placed(summary: DataFrame, y: str) -> DataFrame:
    """x (place of the thread count), y, its rank among equal x (equal y the same), and side of each label."""
    counts = summary.select("threads").distinct().select("threads", F.dense_rank().over(Window.orderBy("threads")).cast("long").alias("x"))
    own = summary.join(counts, "threads").withColumn("rank", F.rank().over(Window.partitionBy("x").orderBy(y)).cast("long"))
    return own.select("executable", "x", F.col(y).alias("y"), "rank", F.when(F.col("rank") % 2 == 0, "left").otherwise("top").alias("side"))


def labels(summary: DataFrame) -> DataFrame:
    """Places and texts of the labels of times."""
    return _placed(summary, "p90").withColumn("label", short_number("y"))


def efficiency_labels(summary: DataFrame, name: str) -> DataFrame:
    """Places and texts of the labels of efficiencies; the baseline and the ideal line have none."""
    return _placed(relative(summary, name), "efficiency").withColumn("label", percent("y"))


def heat(summary: DataFrame, threads: list[int]) -> DataFrame:
    """Chunk by thread count, one row for each executable and chunk."""
    return summary.groupBy("executable", "chunk").pivot("threads", threads).agg(F.first("p90")).select("executable", "chunk", *(F.col(str(t)).alias(f"t{t}") for t in threads))


def bins(summary: DataFrame) -> DataFrame:
    """Bin 1..256 of each cell between its executable's least and greatest; 256 if they are equal."""
    span = summary.groupBy("executable").agg(F.min("p90").alias("lo"), F.max("p90").alias("hi"))
    scaled = F.try_divide(F.col("p90") - F.col("lo"), F.col("hi") - F.col("lo"))
    own = F.coalesce(F.least(F.greatest(F.round(scaled * 255) + 1, F.lit(1.0)), F.lit(256.0)), F.lit(256.0))
    return summary.join(span, "executable").select(*GROUP, "chunk", own.cast("long").alias("bin"))
