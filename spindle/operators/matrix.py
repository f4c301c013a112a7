"""Sparse matrices as DataFrames: coordinates (i, j, v) and compressed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindle.sources import scratch

from .order import numbered

#: Rows of one window of a scan, and columns of one array of a row: bounds what a task holds at once.
ROW_BLOCK, COLUMN_BLOCK = 4096, 1 << 16


def coalesced(coo: DataFrame) -> DataFrame:
    """Equal coordinates added up."""
    return coo.groupBy("i", "j").agg(F.sum("v").alias("v"))


def transposed(coo: DataFrame) -> DataFrame:
    return coo.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def distinct_nnz(coo: DataFrame) -> DataFrame:
    return coo.select("i", "j").distinct().agg(F.count("*").alias("nnz"))


def before(blocks: DataFrame, block: str, value: str, name: str) -> DataFrame:
    """Exclusive prefix sums over one row for each block, themselves taken in blocks of blocks."""
    outer = F.expr(f"{block} div {ROW_BLOCK}")
    totals = blocks.groupBy(outer.alias("_outer")).agg(F.sum(value).alias("_t"))
    first = totals.select("_outer", F.coalesce(F.sum("_t").over(Window.orderBy("_outer").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    inner = Window.partitionBy("_outer").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    here = blocks.withColumn("_outer", outer).withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return here.join(first, "_outer").select(block, (F.col("_first") + F.col("_in")).alias(name))


def row_pointers(coo: DataFrame, rows: DataFrame) -> DataFrame:
    """i, row_start, row_end of every row of the domain, empty ones included.

    A scan in two levels: counts by row, sums by block of rows, offsets of
    blocks; no window ever spans the whole matrix.
    """
    counts = coo.groupBy("i").agg(F.count("*").alias("n"))
    dense = rows.select("i").join(counts, "i", "left").select("i", F.coalesce("n", F.lit(0)).alias("n"), F.expr(f"i div {ROW_BLOCK}").alias("_block"))
    dense = scratch.saved(dense)
    offsets = before(dense.groupBy("_block").agg(F.sum("n").alias("_sum")), "_block", "_sum", "_offset")
    own = Window.partitionBy("_block").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = dense.join(offsets, "_block").withColumn("row_end", F.col("_offset") + F.sum("n").over(own))
    return ends.select("i", (F.col("row_end") - F.col("n")).alias("row_start"), "row_end")


def ordinals(coo: DataFrame) -> DataFrame:
    """coo with k: its place (from 0) in the order of (i, j). Dense rows are split, as any range of the order is."""
    return numbered(coo.select("i", "j", "v"), ["i", "j"], "k")[0]


def boundaries(coo: DataFrame) -> DataFrame:
    """i, j, new_row, new_col against the neighbour before in the order of (i, j), repeats included.

    Entries meet their neighbours by their places in the order, so that neither
    a dense row nor an entry repeated many times is one task's.
    """
    placed, _ = numbered(coo.select("i", "j"), ["i", "j"], "k")
    before = placed.select((F.col("k") + 1).alias("k"), F.col("i").alias("_i"), F.col("j").alias("_j"))
    own = placed.join(before, "k", "left").withColumn("new_row", F.col("_i").isNull() | (F.col("_i") != F.col("i")))
    return own.select("i", "j", "new_row", (F.col("new_row") | (F.col("_j") != F.col("j"))).alias("new_col"))


def nested_rows(coo: DataFrame) -> DataFrame:
    """i, block, cols, vals of the non-empty rows, in column order; a row has an array for each block of COLUMN_BLOCK columns."""
    block = F.expr(f"j div {COLUMN_BLOCK}").alias("block")
    rows = coo.groupBy("i", block).agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("_e"))
    return rows.select("i", "block", F.col("_e.j").alias("cols"), F.col("_e.v").alias("vals"))


def mirrored(coo: DataFrame, symmetry: str) -> DataFrame:
    """The full matrix of a stored triangle (i, j, v; complex: also im): hermitian halves are conjugates, skew ones negatives."""
    if symmetry == "general":
        return coo
    sign = -1.0 if symmetry == "skew-symmetric" else 1.0
    half = [(F.col("v") * sign).alias("v")]
    if "im" in coo.columns:
        half.append((F.col("im") * (sign if symmetry != "hermitian" else -1.0)).alias("im"))
    return coo.unionByName(coo.where("i != j").select(F.col("j").alias("i"), F.col("i").alias("j"), *half))


def uniform_vector(keys: DataFrame, seed: int = 0) -> DataFrame:
    """j and x, uniform in [-1, 1): a hash of seed and j, so that any partitioning gives the same vector."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("j").cast("string")).cast("binary"))
    return keys.select("j", (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 51) - 1).alias("x"))
