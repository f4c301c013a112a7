"""Sparse matrix times dense vector, as join and aggregate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.sources import scratch, shipping

from . import matrix, schedule
from .order import numbered


def gather(coo: DataFrame, x: DataFrame) -> DataFrame:
    """Products by entry. Whether x is broadcast is left to the optimizer, which knows its size."""
    return coo.join(x, "j").select("i", "j", (F.col("v") * F.col("x")).alias("p"))


def completed(sums: DataFrame, rows: DataFrame) -> DataFrame:
    """y for every row of the domain, 0 for those without entries."""
    return rows.select("i").join(sums, "i", "left").select("i", F.coalesce("y", F.lit(0.0)).alias("y"))


def multiply(coo: DataFrame, x: DataFrame, rows: DataFrame) -> DataFrame:
    """From unsorted coordinates, repeats allowed: a product is linear, so nothing need be coalesced first."""
    return completed(gather(coo, x).groupBy("i").agg(F.sum("p").alias("y")), rows)


def multiply_nested(coo: DataFrame, x: DataFrame, rows: DataFrame) -> DataFrame:
    """Products gathered into the arrays of each row and block of columns, folded in column order, then added up by row."""
    block = F.expr(f"j div {matrix.COLUMN_BLOCK}").alias("block")
    placed = coo.join(x, "j").groupBy("i", block).agg(F.sort_array(F.collect_list(F.struct("j", "v", "x"))).alias("e"))
    fold = F.aggregate(F.zip_with(F.col("e.v"), F.col("e.x"), lambda v, w: v * w), F.lit(0.0), lambda a, p: a + p)
    return completed(placed.select("i", fold.alias("s")).groupBy("i").agg(F.sum("s").alias("y")), rows)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One share in the order of the merge path: products are added up until their row's end; what is left at last is the carry."""
    row, left, open_ = 0, 0.0, False
    for batch in batches:
        if not batch.num_rows:
            continue
        i, ends = batch.column(0).to_numpy(zero_copy_only=False), np.asarray(batch.column(1).is_null())
        p = np.where(ends, 0.0, batch.column(1).fill_null(0.0).to_numpy(zero_copy_only=False))
        at = np.flatnonzero(ends)
        if len(at):
            sums = np.add.reduceat(p[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
            sums[0] += left
            yield pa.RecordBatch.from_pydict({"i": pa.array(i[at], pa.int64()), "y": pa.array(sums, pa.float64()), "carry": pa.array(np.zeros(len(at), bool))})
            left, open_ = 0.0, False
        rest = p[at[-1] + 1 :] if len(at) else p
        if len(rest):
            row, left, open_ = int(i[-1]), left + float(rest.sum()), True
    if open_:
        yield pa.RecordBatch.from_pydict({"i": pa.array([row], pa.int64()), "y": pa.array([left], pa.float64()), "carry": pa.array([True])})


def merge_shares(coo: DataFrame, x: DataFrame, rows: DataFrame, workers: int) -> DataFrame:
    """part, i, y, carry of each share of the merge path, where a share is one task.

    Entry k of row i stands at k + i, the end of row i after its entries; equal
    lengths of that path are the shares. A share writes each row that ends in it,
    and carries out the sum of the row that goes on: one row a share at most.
    """
    shipping.shipped(coo.sparkSession)
    placed, nnz = numbered(coo.select("i", "j", "v"), ["i", "j"], "k")
    items = schedule.merge_items(schedule.counted_domain(rows), nnz, workers)
    entries = placed.join(x, "j").select("i", (F.col("v") * F.col("x")).cast("double").alias("p"), (F.col("k") + F.col("i")).alias("at"))
    ends = matrix.row_pointers(placed, rows).select("i", F.lit(None).cast("double").alias("p"), (F.col("row_end") + F.col("i")).alias("at"))
    share = entries.unionByName(ends).repartitionById(workers, F.expr(f"cast(at div {items} as int)")).sortWithinPartitions("at")
    return share.select("i", "p").mapInArrow(_walk, "i long, y double, carry boolean").withColumn("part", F.spark_partition_id())


def multiply_merge(coo: DataFrame, x: DataFrame, rows: DataFrame, workers: int) -> DataFrame:
    """Equal merge-path shares; a dense row spans several, whose carries (as many as workers at most) are added to it in the end."""
    sums = scratch.saved(merge_shares(coo, x, rows, workers))
    carried = sums.where("carry").groupBy("i").agg(F.sum("y").alias("c"))
    return sums.where("NOT carry").join(F.broadcast(carried), "i", "left").select("i", (F.col("y") + F.coalesce("c", F.lit(0.0))).alias("y"))


#: Numbers of a vector (8 MB) that are sent to every task at most.
SENT = 1 << 20


def multiply_dense(rows: DataFrame, x: DataFrame, width: int) -> DataFrame:
    """y of rows (i, a), a an array of `width` numbers; missing j of the vector (j, x) are 0.

    A vector of up to SENT numbers goes to all tasks as one array, and the matrix
    is not shuffled; for a longer one the rows are taken apart into entries.
    """
    if width > SENT:
        return multiply(rows.select("i", F.posexplode("a").alias("j", "v")), x, rows)
    own = F.array_sort(F.collect_list(F.struct("j", "x")))
    places = x.sparkSession.range(width).select(F.col("id").alias("j")).join(x, "j", "left").select("j", F.coalesce("x", F.lit(0.0)).alias("x"))
    whole = places.agg(own.alias("_e")).select(F.col("_e.x").alias("_x"))
    return rows.crossJoin(F.broadcast(whole)).select("i", F.aggregate(F.zip_with("a", "_x", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p).alias("y"))
