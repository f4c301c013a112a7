"""Assignments of rows or entries to workers. Each is a column; the product does not depend on it."""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindle.sources import scratch

from . import matrix
from .order import numbered


def static(i: str, n_rows: int, workers: int) -> Column:
    return F.expr(f"{i} * {workers}L div {n_rows}")


def static_chunked(i: str, chunk: int, workers: int) -> Column:
    return F.expr(f"({i} div {chunk}) % {workers}")


def dynamic(i: str, chunk: int) -> Column:
    """The chunk; which worker takes it is up to the scheduler."""
    return F.expr(f"{i} div {chunk}")


def manual(i: str, n_rows: int, workers: int) -> Column:
    """Worker t has the rows from R*t/n up to R*(t+1)/n, both rounded down."""
    return F.expr(f"(({i} + 1) * {workers}L - 1) div {n_rows}")


def task(i: str) -> Column:
    return F.col(i)


def guided_bounds(n_rows: int, workers: int, least: int = 1) -> list[tuple[int, int]]:
    """lo, hi of each chunk: each takes ceil(remaining / workers), `least` at the least; about workers * log(n_rows / workers) of them."""
    out, lo = [], 0
    while lo < n_rows:
        hi = min(n_rows, lo + max(least, -(-(n_rows - lo) // workers)))
        out.append((lo, hi))
        lo = hi
    return out


def guided(spark: SparkSession, n_rows: int, workers: int, least: int = 1) -> DataFrame:
    """chunk, lo, hi of the guided schedule."""
    return spark.createDataFrame([(k, *b) for k, b in enumerate(guided_bounds(n_rows, workers, least))], "chunk long, lo long, hi long")


def guided_chunk(i: str, n_rows: int, workers: int, least: int = 1) -> Column:
    """The chunk of row i, by binary search in the sorted bounds."""
    lows = [lo for lo, _ in guided_bounds(n_rows, workers, least)] or [0]
    bounds, row = F.lit(lows), F.col(i)
    low = F.lit(0)
    step = 1 << (len(lows).bit_length() - 1)
    steps = [step >> k for k in range(step.bit_length())]
    # the greatest place whose bound is not above i, a bit at a time
    go = lambda at, s: F.when(F.coalesce(F.get(bounds, at + s) <= row, F.lit(False)), at + s).otherwise(at)
    return F.aggregate(F.lit(steps).cast("array<int>"), low, go).cast("long")


def merge_items(n_rows: int, nnz: int, workers: int) -> int:
    return max(1, -(-(n_rows + nnz) // workers))


def counted_domain(rows: DataFrame) -> int:
    """Number of rows; their ids must be 0 to that number less 1, as places on the merge path are made of them."""
    n, low, high, ids = rows.agg(F.count("i"), F.min("i"), F.max("i"), F.count("*")).first()
    if ids and (n != ids or low != 0 or high != ids - 1):
        raise ValueError(f"row ids of a merge path must be 0 to {ids - 1}, each once; found {low} to {high}")
    return ids


def merge_path(coo: DataFrame, rows: DataFrame, workers: int) -> DataFrame:
    """coo with part: entry k of row i stands at k + i on the merge path, cut into equal lengths."""
    placed, nnz = numbered(coo.select("i", "j", "v"), ["i", "j"], "k")
    items = merge_items(counted_domain(rows), nnz, workers)
    return placed.select("i", "j", "v", "k", F.expr(f"(k + i) div {items}").alias("part"))


def merge_coordinates(coo: DataFrame, rows: DataFrame, workers: int) -> DataFrame:
    """part, row, nz where each share starts, and where the last one ends.

    The end of row i stands at e = row_end + i; the rows of diagonal d are those
    with e < d. An index of two levels, over blocks of ROW_BLOCK rows and over as
    many of these, is searched for each diagonal; rows are counted only in the
    blocks that are found, at most one for each diagonal.
    """
    spark, size = rows.sparkSession, matrix.ROW_BLOCK
    n = counted_domain(rows)
    counts = coo.groupBy(F.expr(f"i div {size}").alias("block")).agg(F.count("*").alias("n"))
    known = spark.range(-(-n // size)).select(F.col("id").alias("block")).join(counts, "block", "left").select("block", F.coalesce("n", F.lit(0)).alias("n"))
    known = scratch.saved(known)
    last = F.least((F.col("block") + 1) * size, F.lit(n)) - 1
    index = scratch.saved(known.join(matrix.before(known, "block", "n", "before"), "block").select("block", F.expr(f"block div {size}").alias("outer"), "before", (F.col("before") + F.col("n") + last).alias("e")))
    scratch.dropped(known)
    top = sorted(map(tuple, index.groupBy("outer").agg(F.max("e")).collect()))  # a row for each 16 M rows of the matrix
    total = top[-1][1] + 1 if top else 0
    items = max(1, -(-total // workers))
    ends = [e for _, e in top]
    grid = [(p, min(p * items, total)) for p in range(workers + 1)]
    inside = [(p, d, top[bisect.bisect_left(ends, d)][0]) for p, d in grid if d < total]
    beyond = spark.createDataFrame([(p, n, d - n) for p, d in grid if d >= total], "part long, row long, nz long")
    if not inside:
        return beyond
    asked = spark.createDataFrame(inside, "part long, d long, outer long")
    found = index.join(F.broadcast(asked), "outer").where("e >= d").groupBy("part", "d").agg(F.min(F.struct("block", "before")).alias("b")).select("part", "d", "b.*")
    found = scratch.saved(found)
    wanted = F.broadcast(found.select("block").distinct())  # workers + 1 rows at most
    here = lambda df: df.withColumn("block", F.expr(f"i div {size}")).join(wanted, "block", "left_semi")
    own = here(rows.select("i")).join(here(coo.select("i")).groupBy("i").agg(F.count("*").alias("n")), "i", "left")
    order = Window.partitionBy("block").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = own.select("block", "i", (F.sum(F.coalesce("n", F.lit(0))).over(order) + F.col("i")).alias("own"))
    passed = found.join(upto, "block").groupBy("part", "d", "block").agg(F.count_if(F.col("before") + F.col("own") < F.col("d")).alias("k"))
    row = F.col("block") * size + F.col("k")
    return passed.select("part", row.alias("row"), (F.col("d") - row).alias("nz")).unionByName(beyond)


def balance(coo: DataFrame, rows: DataFrame, workers: int, n_rows: int) -> DataFrame:
    """scheme, part, n_rows, nnz, items of manual row ranges and of merge-path shares."""
    by_row = rows.select(manual("i", n_rows, workers).alias("part")).groupBy("part").agg(F.count("*").alias("n_rows"))
    by_entry = coo.select(manual("i", n_rows, workers).alias("part")).groupBy("part").agg(F.count("*").alias("nnz"))
    plain = by_row.join(by_entry, "part", "full").select(F.lit("manual").alias("scheme"), "part", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("nnz", F.lit(0)).alias("nnz"))
    at = merge_coordinates(coo, rows, workers)
    w = Window.orderBy("part")
    merge = at.select(F.lit("merge").alias("scheme"), "part", (F.lead("row").over(w) - F.col("row")).alias("n_rows"), (F.lead("nz").over(w) - F.col("nz")).alias("nnz")).where(F.col("part") < workers)
    return plain.unionByName(merge).withColumn("items", F.col("n_rows") + F.col("nnz"))
