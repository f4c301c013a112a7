"""Products and sums of doubles without error: y is the exact sum, rounded once, whatever the schedule.

A product is taken apart into two doubles that add up to it exactly (its fused
multiply-add, by halves of the factors). A double lies in a bin of 32 binary
exponents, in which it is three whole numbers of 30 bits; bins add up as longs,
in any order, before and after the shuffle. A row's few bins are one whole
number, which is rounded to the nearest double.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.sources import shipping

from .spmv import completed

#: Exponents of a bin, and bits of a limb; a bin's whole numbers count multiples of 2^(BIN * bin - LOW).
BIN, LIMB, LOW = 32, 30, 56
#: Binary exponents of a product within which its two parts are doubles; beyond, it raises.
LEAST, MOST = -900, 900


def two_product(a: Column, b: Column) -> tuple[Column, Column]:
    """The rounded product, and what it lacks: p + e is a * b exactly."""
    half = lambda x: x * 134217729.0 - (x * 134217729.0 - x)
    ah, bh = half(a), half(b)
    al, bl = a - ah, b - bh
    p = a * b
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def multiply_add(a: Column, b: Column, c: Column) -> Column:
    """a * b + c as an array of three doubles whose exact sum it is."""
    p, e = two_product(a, b)
    return F.array(p, e, c)


def _limbs(x: Column) -> Column:
    """struct(bin, l0, l1, l2) of a double that is not 0: x = (l0 + l1 * 2^30 + l2 * 2^60) * 2^(BIN * bin - LOW)."""
    b = F.floor(F.log2(F.abs(x)) / BIN).cast("int")
    # by halves, as the whole factor can be beyond a double
    shift = F.lit(LOW) - b * BIN
    first = F.floor(shift / 2)
    scaled = x * F.pow(F.lit(2.0), first) * F.pow(F.lit(2.0), shift - first)
    cut = lambda v, bits: F.when(v >= 0, F.floor(v / 2.0**bits)).otherwise(-F.floor(-v / 2.0**bits))
    high = cut(scaled, 2 * LIMB)
    rest = scaled - high.cast("double") * 2.0 ** (2 * LIMB)
    mid = cut(rest, LIMB)
    return F.struct(b.alias("bin"), (rest - mid.cast("double") * 2.0**LIMB).cast("long").alias("l0"), mid.cast("long").alias("l1"), high.cast("long").alias("l2"))


def _rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for bins in batch.column(1).to_pylist():
            low = min(b["bin"] for b in bins)
            n = sum((b["l0"] + (b["l1"] << LIMB) + (b["l2"] << 2 * LIMB)) << BIN * (b["bin"] - low) for b in bins)
            e = BIN * low - LOW
            # both are rounded correctly
            out.append(float(n << e) if e >= 0 else n / (1 << -e))
        yield pa.RecordBatch.from_pydict({"i": batch.column(0), "y": pa.array(out, pa.float64())})


def total(parts: DataFrame) -> DataFrame:
    """i, y: the exact sum of the doubles p of each i, rounded once; partial sums are exact, so that a hot i is added up before the shuffle.

    NaN and infinite numbers raise; nulls count as 0.
    """
    shipping.shipped(parts.sparkSession)
    p = F.col("p")
    fine = F.when(F.isnan(p) | (F.abs(p) == float("inf")), F.raise_error(F.lit("a sum of a number that is not finite"))).otherwise(p)
    cut = parts.where("p != 0").select("i", _limbs(fine).alias("l")).select("i", "l.*")
    bins = cut.groupBy("i", "bin").agg(*(F.sum(c).alias(c) for c in ("l0", "l1", "l2")))
    return bins.groupBy("i").agg(F.collect_list(F.struct("bin", "l0", "l1", "l2")).alias("bins")).mapInArrow(_rounded, "i long, y double")


def multiply(coo: DataFrame, x: DataFrame, rows: DataFrame) -> DataFrame:
    """Each y is the double nearest to the exact sum of products, repeats of coordinates allowed; factors whose product lies beyond 2^LEAST to 2^MOST raise."""
    p, e = two_product(F.col("v"), F.col("x"))
    size = F.abs(p)
    fine = (p == 0) & ((F.col("v") == 0) | (F.col("x") == 0)) | size.between(2.0**LEAST, 2.0**MOST)
    checked = F.when(fine, F.array(p, e)).otherwise(F.raise_error(F.lit("a product beyond the range of exact ones")))
    met = coo.select("i", "j", F.col("v").cast("double").alias("v")).join(x.select("j", F.col("x").cast("double").alias("x")), "j").where("v IS NOT NULL AND x IS NOT NULL")
    return completed(total(met.select("i", F.explode(checked).alias("p"))), rows)
