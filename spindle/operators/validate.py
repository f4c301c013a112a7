"""Comparison of two results y by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-12
LISTED = 19


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    joined = a.withColumnRenamed("y", "a").join(b.withColumnRenamed("y", "b"), "i", "full")
    return joined.select("i", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))


def absolute(tolerance: float = TOLERANCE) -> Column:
    return F.abs(F.col("a") - F.col("b")) > tolerance


def mixed(tolerance: float = TOLERANCE) -> Column:
    """Beyond tolerance / 1000 and tolerance times the greater magnitude."""
    return F.abs(F.col("a") - F.col("b")) > tolerance * 1e-3 + tolerance * F.greatest(F.abs("a"), F.abs("b"))


def mismatches(pairs: DataFrame, differs: Column) -> DataFrame:
    return pairs.agg(F.count_if(differs).alias("mismatches"))


def first_mismatches(pairs: DataFrame, differs: Column, n: int = LISTED) -> DataFrame:
    return pairs.where(differs).orderBy("i").limit(n)
