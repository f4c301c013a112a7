"""Tiles of very sparse matrices, of repeated and missing entries; the chained query on odd tables."""

import numpy as np
import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindle.jobs import catalogue
from spindle.operators import tiles

N = 40_000


def vector(spark, n):
    return spark.range(n).select(F.col("id").alias("j"), (F.col("id") % 10).cast("double").alias("x"))


@pytest.mark.parametrize("stride", [1, 64 * 1024])
def test_vector_numbers_grow_with_the_entries(spark, stride):
    """One entry in each of many rows: a block of the vector once for each few thousand entries, not for each 64 rows (before: 16,000 blocks and more)."""
    coo = spark.range(N).select((F.col("id") * stride).alias("i"), (F.col("id") * 7919 % 20_000).alias("j"), F.lit(2.0).alias("v"))
    own = tiles.build(coo, slot=256)
    try:
        sent = own.table.join(tiles.blocks(vector(spark, 20_000), own), ["jb", "slot"])
        assert sent.agg(F.sum(F.size("xs"))).first()[0] <= 4 * N
        # slots of rows far apart are used alike
        assert sent.select("jb", "slot").distinct().count() >= 10
        y = tiles.sums(own, vector(spark, 20_000))
        bad = y.where(F.col("y") != (F.expr(f"i div {stride}") * 7919 % 20_000 % 10) * 2)
        assert y.count() == N and bad.count() == 0
    finally:
        own.drop()


def test_repeats_nulls_and_missing_columns(spark):
    """Equal coordinates add up; an entry with a null, and one in a column without a number, count for nothing; nan and negative ids stay."""
    cells = [(0, 0, 1.0)] * 3000 + [(0, 0, None), (1, 5, 2.0), (1, 9000, 4.0), (2, 9000, 5.0), (3, 1, 1.0), (4, 7, float("inf")), (None, 0, 1.0), (5, None, 1.0), (6, 6, 1.0), (-9, -5, 3.0)]
    coo = spark.createDataFrame(cells, "i long, j long, v double").repartition(6)
    x = spark.createDataFrame([(0, 2.0), (5, 3.0), (1, float("nan")), (6, None), (-5, 7.0)], "j long, x double")
    own = tiles.build(coo)
    try:
        assert own.table.agg(F.sum(F.size("vals"))).first()[0] == 8
        got = {r.i: r.y for r in tiles.multiply(own, x, spark.createDataFrame([(k,) for k in (-9, 0, 1, 2, 3, 4, 5, 6)], "i long")).collect()}
        assert np.isnan(got.pop(3)) and got == {-9: 21.0, 0: 6000.0, 1: 6.0, 2: 0.0, 4: 0.0, 5: 0.0, 6: 0.0}
    finally:
        own.drop()


def test_tiles_from_many_tasks_are_merged(monkeypatch):
    """Whatever is held at once, and however small a tile may be, all entries come back, in few tiles; batches may be slices."""
    r = np.random.default_rng(1)
    n = 5000
    jb = np.sort(r.integers(-1, 3, n))
    i = r.integers(-(1 << 62), 1 << 62, 900)[r.integers(0, 900, n)]
    flat = [jb, np.abs(i) % 3, i, r.integers(0, 4096, n), r.integers(1, 9, n).astype(float)]
    want = {}
    for *at, v in zip(*(a.tolist() for a in flat)):
        want[tuple(at)] = want.get(tuple(at), 0) + v
    batch = pa.RecordBatch.from_arrays([pa.array(a) for a in flat], ["jb", "slot", "i", "c", "v"])
    for most, held in ((7, 100), (1000, 700), (1 << 16, 1 << 19)):
        monkeypatch.setattr(tiles, "TILE_ENTRIES", most)
        monkeypatch.setattr(tiles, "HELD", held)
        packs = list(tiles._packed(batch.slice(k, 450) for k in range(0, n, 450)))
        whole = pa.Table.from_batches(packs).combine_chunks().sort_by([("jb", "ascending"), ("slot", "ascending")]).to_batches()[0]
        out = list(tiles._merged(iter([whole.slice(0, 3), whole.slice(3), whole.slice(0, 0)])))
        got = {}
        for b in out:
            for *at, v in zip(*(a.tolist() for a in tiles._entries(b))):
                got[tuple(at)] = got.get(tuple(at), 0) + v
            assert max(len(v) for v in b.column("vals")) <= most
        assert got == want
    assert sum(b.num_rows for b in out) == 12


def test_chained_query_on_odd_tables(spark, tmp_path, monkeypatch):
    """Columns that part lacks count in A' y as in SQL; rows that orders lacks, nulls and repeats too."""
    lines = [(0, 0, 2.0), (0, 0, 3.0), (0, 9, 4.0), (1, 9, 5.0), (1, 1, None), (2, 1, 1.0), (7, 0, 6.0), (7, 9, 1.0), (None, 0, 1.0), (2, None, 1.0), (4, 9000, 1.0), (4, 0, 2.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(0,), (1,), (9000,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k,) for k in range(6)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(oracle, "TABLES", ["lineitem", "part", "orders"])
    assert oracle.compare(spark, "spmv_chained", catalogue.QUERIES["spmv_chained"], catalogue.ORACLE_SQL["spmv_chained"], str(tmp_path)) == 6
