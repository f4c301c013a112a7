"""A matrix laid out once for many products: tiles of entries, bucketed by column block.

A tile has up to TILE_ENTRIES entries of one block of TILE_COLUMNS columns, by
rows, as arrays of row steps, places and values. Tiles are a bucketed table on
(column block, slot); a product then moves the vector, whose rows are blocks of
TILE_COLUMNS numbers, and partial sums, but never the matrix. A column block
with many entries has several slots, and the vector's block goes to each, so
that a hot column is no task's load. Slots are counted by entries, so that a
product's work grows with the entries and not with the blocks they lie in.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.sources import scratch, shipping

from .spmv import completed

#: Rows that share a slot, and columns of a block (a power of two).
TILE_ROWS, TILE_COLUMNS = 64, 4096
#: Entries of a tile at most, and entries that a task sorts at once, about.
TILE_ENTRIES, HELD = 1 << 16, 1 << 19
#: Entries of a slot, about, in sixteens: four for each number of the vector's block that the slot is sent.
SLOT = 1024

_TILE = "jb long, slot int, base long, rows array<long>, cols array<int>, vals array<double>"


@dataclass
class Tiles:
    """The bucketed table's name, the slots (jb, slots) of column blocks that have more than one, and the session."""

    spark: SparkSession
    name: str
    slots: DataFrame

    @property
    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _tiles(jb: np.ndarray, slot: np.ndarray, i: np.ndarray, c: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Tiles of entries in any order; equal coordinates are added up."""
    at = np.lexsort((c, i, slot, jb))
    jb, slot, i, c, v = jb[at], slot[at], i[at], c[at], v[at]
    moved = lambda *keys: np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    own = np.flatnonzero(moved(jb, slot, i, c))
    if len(own) < len(v):
        v, jb, slot, i, c = np.add.reduceat(v, own), jb[own], slot[own], i[own], c[own]
    at = np.arange(len(v))
    first = np.maximum.accumulate(np.where(moved(jb, slot), at, 0))
    starts = np.flatnonzero((at - first) % TILE_ENTRIES == 0)
    steps = np.diff(i, prepend=i[:1])
    steps[starts] = 0
    offsets = pa.array(np.append(starts, len(v)), pa.int32())
    arrays = [pa.ListArray.from_arrays(offsets, pa.array(a, kind)) for a, kind in ((steps, pa.int64()), (c, pa.int32()), (v, pa.float64()))]
    return pa.RecordBatch.from_arrays([pa.array(jb[starts], pa.int64()), pa.array(slot[starts], pa.int32()), pa.array(i[starts], pa.int64()), *arrays], ["jb", "slot", "base", "rows", "cols", "vals"])


def _held(batches: Iterator[pa.RecordBatch], entries: Callable[[pa.RecordBatch], list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Tiles of so many entries at a time as are held."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(entries(batch))
            n += len(held[-1][0])
        if n >= HELD:
            yield _tiles(*map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield _tiles(*map(np.concatenate, zip(*held)))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of a task as tiles, small ones too: what is shuffled is arrays and no row for each entry."""
    return _held(batches, lambda batch: [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)])


def _flat(c: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists of a column, and where each list begins and the last ends."""
    offsets = c.offsets.to_numpy()
    return c.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def _rows(base: np.ndarray, steps: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Row of each entry of tiles that begin at base."""
    i = np.cumsum(steps)
    return i + np.repeat(base - i[ends[:-1]], np.diff(ends))


def _entries(batch: pa.RecordBatch) -> list[np.ndarray]:
    (steps, ends), (c, _), (v, _) = (_flat(batch.column(k)) for k in (3, 4, 5))
    jb, slot, base = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
    return [np.repeat(jb, np.diff(ends)), np.repeat(slot, np.diff(ends)), _rows(base, steps, ends), c, v]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of one slot from many tasks as few large ones."""

    def cut() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, k = batch.column(5).offsets.to_numpy(), 0
            while k < batch.num_rows:
                n = max(1, int(np.searchsorted(ends, ends[k] + HELD, "right")) - 1 - k)
                yield batch.slice(k, n)
                k += n

    return _held(cut(), _entries)


def build(coo: DataFrame, buckets: int | None = None, slot: int = SLOT) -> Tiles:
    """Tiles of a matrix, whose equal coordinates add up; buckets: the session's shuffle partitions unless given.

    An entry's slot follows from its row and column alone, so that a task that
    runs again deals out the same entries. Entries with a null are none.
    """
    spark = coo.sparkSession
    shipping.shipped(spark)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    jb, place = F.shiftright("j", TILE_COLUMNS.bit_length() - 1), F.col("j").bitwiseAND(TILE_COLUMNS - 1).cast("int")
    own = coo.where("i IS NOT NULL AND j IS NOT NULL AND v IS NOT NULL").select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("v").cast("double")).withColumn("jb", jb)
    counts = own.groupBy("jb").agg(F.ceil(F.count("*") / (16 * slot)).alias("slots"))
    slots = scratch.saved(counts.where("slots > 1"))
    dealt = own.join(slots, "jb", "left").select("jb", F.expr(f"cast(pmod(xxhash64(i div {TILE_ROWS}), coalesce(slots, 1)) as int)").alias("slot"), "i", place.alias("c"), "v")
    laid = dealt.mapInArrow(_packed, _TILE).repartition(n, "jb", "slot").sortWithinPartitions("jb", "slot").mapInArrow(_merged, _TILE)
    name = f"spindle_tiles_{uuid.uuid4().hex}"
    laid.write.format("parquet").bucketBy(n, "jb", "slot").sortBy("jb", "slot").option("path", scratch.folder(spark)).saveAsTable(name)
    return Tiles(spark, name, slots)


def blocks(x: DataFrame, tiles: Tiles) -> DataFrame:
    """The vector (j, x) as rows of TILE_COLUMNS numbers: jb, slot, places, xs; a block goes to each of its slots."""
    place = F.struct(F.col("j").bitwiseAND(TILE_COLUMNS - 1).cast("int").alias("p"), F.col("x").cast("double").alias("x"))
    jb = F.shiftright(F.col("j").cast("long"), TILE_COLUMNS.bit_length() - 1).alias("jb")
    own = x.where("j IS NOT NULL AND x IS NOT NULL").groupBy(jb).agg(F.collect_list(place).alias("e"))
    spread = own.join(tiles.slots, "jb", "left").withColumn("slot", F.explode(F.sequence(F.lit(0), F.expr("cast(coalesce(slots, 1) as int) - 1"))))
    return spread.select("jb", "slot", F.col("e.p").alias("places"), F.col("e.x").alias("xs"))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums by row of each tile with its block of the vector; entries whose column the vector has not are left out."""
    for batch in batches:
        base = batch.column(0).to_numpy(zero_copy_only=False)
        (steps, ends), (cols, _), (vals, _), (places, at), (xs, _) = (_flat(batch.column(k)) for k in range(1, 6))
        for k in range(batch.num_rows):
            s, p = slice(ends[k], ends[k + 1]), slice(at[k], at[k + 1])
            i, c, v = base[k] + np.cumsum(steps[s]), cols[s], vals[s]
            has = np.bincount(places[p], minlength=TILE_COLUMNS) > 0
            if not has.all():
                i, c, v = (a[has[c]] for a in (i, c, v))
            if len(i):
                first = np.flatnonzero(np.diff(i, prepend=i[0] - 1))
                total = np.add.reduceat(v * np.bincount(places[p], xs[p], TILE_COLUMNS)[c], first)
                yield pa.RecordBatch.from_pydict({"i": pa.array(i[first], pa.int64()), "p": pa.array(total, pa.float64())})


def sums(tiles: Tiles, x: DataFrame) -> DataFrame:
    """i, y of the rows that have an entry in a column of the vector; the matrix is read bucket by bucket, where it lies."""
    shipping.shipped(tiles.spark)
    met = tiles.table.join(blocks(x, tiles).hint("shuffle_hash"), ["jb", "slot"]).select("base", "rows", "cols", "vals", "places", "xs")
    return met.mapInArrow(_products, "i long, p double").groupBy("i").agg(F.sum("p").alias("y"))


def multiply(tiles: Tiles, x: DataFrame, rows: DataFrame) -> DataFrame:
    """y of every row of the domain."""
    return completed(sums(tiles, x), rows)
