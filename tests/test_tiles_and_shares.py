"""Merge-path shares as places, the indexed search of the path, guided lookups, and products of a matrix laid out once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.jobs import catalogue, sweep
from spindle.operators import matrix, schedule, spmv, tiles

SF = "/root/testdata/sf0.001"


def plan(df):
    text = df._jdf.queryExecution().toString()
    return text[text.index("== Physical Plan") :]


def dense_row(spark, n=400):
    """Row 7 has half of all entries; rows 0, 1 and the last are empty."""
    cells = [(7, j, float(j % 9)) for j in range(n)] + [(2 + k % 40, k % n, 1.0 + k % 3) for k in range(n)]
    a = np.zeros((50, n))
    for i, j, v in cells:
        a[i, j] += v
    coo = matrix.coalesced(spark.createDataFrame(cells, "i long, j long, v double").repartition(4))
    x = spark.range(n).select(F.col("id").alias("j"), (F.col("id") % 7).cast("double").alias("x"))
    return coo, x, spark.range(50).withColumnRenamed("id", "i"), a @ np.array([j % 7 for j in range(n)], float)


@pytest.mark.parametrize("workers", [1, 6, 64])
def test_a_dense_row_spreads_over_its_shares(spark, workers):
    coo, x, rows, want = dense_row(spark)
    got = spmv.merge_shares(coo, x, rows, workers).collect()
    carries = [r for r in got if r.carry]
    assert len(carries) <= workers and len({r.part for r in carries}) == len(carries)
    assert sorted(r.i for r in got if not r.carry) == list(range(50))
    if workers == 6:
        assert len({r.part for r in got if r.i == 7}) >= 3
    y = {r.i: r.y for r in spmv.multiply_merge(coo, x, rows, workers).collect()}
    assert [y[i] for i in range(50)] == want.tolist()


def test_shares_are_equal_lengths_of_the_path(spark):
    coo, x, rows, _ = dense_row(spark)
    n = coo.count()
    sizes = spmv.merge_shares(coo, x, rows, 6).groupBy("part").count().count()
    assert sizes == 6
    at = sorted(tuple(r) for r in schedule.merge_coordinates(coo, rows, 6).collect())
    items = -(-(n + 50) // 6)
    assert [row + nz for _, row, nz in at] == [min(p * items, n + 50) for p in range(7)]


@pytest.mark.parametrize("block", [1, 2, 7, 4096])
@pytest.mark.parametrize("workers", [1, 5, 200])
def test_search_of_the_merge_path(spark, monkeypatch, block, workers):
    """Against a plain two-pointer search, with index blocks of any size; empty rows at both ends."""
    monkeypatch.setattr(matrix, "ROW_BLOCK", block)
    coo, _, rows, _ = dense_row(spark)
    n = [0] * 50
    for r in coo.groupBy("i").count().collect():
        n[r.i] = r["count"]
    ends = np.cumsum(n) + np.arange(50)
    total = int(ends[-1]) + 1
    items = -(-total // workers)
    want = [(p, int((ends < d).sum()), int(d - (ends < d).sum())) for p, d in ((p, min(p * items, total)) for p in range(workers + 1))]
    assert sorted(map(tuple, schedule.merge_coordinates(coo, rows, workers).collect())) == want
    if block == 7:
        assert schedule.merge_coordinates(coo.limit(0), rows.limit(0), 2).collect() == [(0, 0, 0), (1, 0, 0), (2, 0, 0)]


def test_guided_chunks_are_looked_up(spark):
    for n, workers, least in ((1, 4, 1), (2, 1, 1), (1000, 7, 1), (1000, 3, 40), (5, 9, 1)):
        bounds = schedule.guided_bounds(n, workers, least)
        got = spark.range(n).select("id", schedule.guided_chunk("id", n, workers, least).alias("c")).collect()
        assert all(bounds[r.c][0] <= r.id < bounds[r.c][1] for r in got)
    assert "NestedLoop" not in plan(catalogue.QUERIES["part_guided"](spark, SF)) and "Cartesian" not in plan(catalogue.QUERIES["part_guided"](spark, SF))


def random_matrix(spark, n_rows, n_cols, n, hot=None):
    r = np.random.default_rng(n)
    i, j = r.integers(0, n_rows, n), r.integers(0, n_cols, n)
    if hot is not None:
        j[: n // 2] = hot
    cells = {(int(a), int(b)): float(v) for a, b, v in zip(i, j, r.integers(1, 9, n))}
    x = r.integers(0, 9, n_cols).astype(float)
    y = np.zeros(n_rows)
    for (a, b), v in cells.items():
        y[a] += v * x[b]
    coo = spark.createDataFrame([(a, b, v) for (a, b), v in cells.items()], "i long, j long, v double").repartition(5)
    return coo, spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "j long, x double"), spark.range(n_rows).withColumnRenamed("id", "i"), y


@pytest.mark.parametrize("hot, slot", [(None, 1024), (4100, 8)])
def test_products_of_tiles(spark, hot, slot):
    """Several blocks in both directions; a column with half of all entries has its block in several slots."""
    coo, x, rows, want = random_matrix(spark, 3000, 9000, 20_000, hot)
    own = tiles.build(coo, slot=slot)
    try:
        assert own.slots.count() == (0 if hot is None else own.slots.where("slots > 3").count()) and (hot is None or own.slots.count() > 0)
        y = tiles.multiply(own, x, rows)
        assert [r.y for r in y.orderBy("i").collect()] == want.tolist()
        most = own.table.select(F.size("vals").alias("n")).agg(F.max("n"), F.sum("n")).first()
        assert most[0] <= tiles.TILE_ROWS * tiles.TILE_COLUMNS and most[1] == coo.count()
        if hot is not None:
            block = own.table.where(f"jb = {hot // tiles.TILE_COLUMNS}")
            assert block.select("slot").distinct().count() > 3
    finally:
        own.drop()


def test_the_matrix_is_not_moved_again(spark):
    coo, x, rows, _ = random_matrix(spark, 3000, 9000, 20_000)
    own = tiles.build(coo)
    try:
        y = tiles.multiply(own, x, rows)
        y.collect()
        lines = y._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("\n")
        depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
        (scan,) = [k for k, line in enumerate(lines) if "Scan parquet" in line and own.name in line]
        assert "Bucketed: true" in lines[scan]
        # what stands above the scan, up to the join with the vector
        at, above = depth(lines[scan]), []
        for line in reversed(lines[:scan]):
            if depth(line) < at:
                at = depth(line)
                above.append(line)
                if "Join" in line:
                    break
        assert above and "Join" in above[-1] and not any("Exchange" in line for line in above)
    finally:
        own.drop()


def test_empty_tiles_and_timed_products(spark):
    coo, x, rows, _ = random_matrix(spark, 50, 90, 300)
    own = tiles.build(coo.limit(0))
    try:
        assert {r.y for r in tiles.multiply(own, x, rows).collect()} == {0.0}
        took = sweep.timed(lambda: tiles.multiply(own, x, rows), calls=3)
        assert [call for call, _ in took] == [1, 2, 3] and all(0 < s < 60 for _, s in took)
    finally:
        own.drop()
