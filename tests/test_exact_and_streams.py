"""Sums without error against fractions, streamed deltas over restarts, resumable sweeps."""

import os
import struct
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.jobs import sweep
from spindle.operators import exact, matrix
from spindle.sources import results
from spindle.streaming import deltas


def bits(y):
    return struct.pack("<d", y)


def fractions_of(cells, x, n):
    total = [Fraction(0)] * n
    for i, j, v in cells:
        total[i] += Fraction(v) * Fraction(x[j])
    return [float(t) for t in total]


def test_products_are_exact_whatever_the_schedule(spark):
    """Wide exponents, cancellation, repeats, ties between doubles, a hot row, zeros; bit for bit."""
    r = np.random.default_rng(3)
    x = [float(v) for v in r.normal(size=60) * 2.0 ** r.integers(-60, 60, 60)]
    x[0], x[1], x[2] = 1.0, 2.0**-53, 0.0
    cells = [(int(i), int(j), float(v)) for i, j, v in zip(r.integers(0, 12, 400), r.integers(0, 60, 400), r.normal(size=400) * 2.0 ** r.integers(-200, 200, 400))]
    cells += [(3, j, v) for _, j, v in cells[:150]] + [(3, j, -v) for _, j, v in cells[:149]]
    cells += [(12, 0, 1.0), (12, 1, 1.0), (13, 0, 1.0 + 2.0**-52), (13, 1, 1.0), (14, 0, 1.0), (14, 1, 1.0), (14, 1, 2.0**-60), (15, 2, 5.0), (16, 0, 0.0), (17, 0, 2.0**880), (17, 0, 2.0**-890), (17, 0, -(2.0**880))]
    want = fractions_of(cells, x, 19)
    rows = spark.range(19).withColumnRenamed("id", "i")
    vector = spark.createDataFrame(list(enumerate(x)), "j long, x double")
    df = spark.createDataFrame(cells, "i long, j long, v double")
    for own in (df, df.repartition(7), df.repartition(3, "j"), df.orderBy(F.col("v").desc()), df.coalesce(1)):
        got = {t.i: t.y for t in exact.multiply(own, vector, rows).collect()}
        assert [bits(got[i]) for i in range(19)] == [bits(w) for w in want]
    assert exact.multiply(df.limit(0), vector, rows).where("y != 0").count() == 0


def test_multiply_add_loses_nothing(spark):
    r = np.random.default_rng(5)
    rows = [tuple(map(float, r.normal(size=3) * 2.0 ** r.integers(-80, 80, 3))) for _ in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    for t in df.withColumn("p", exact.multiply_add(F.col("a"), F.col("b"), F.col("c"))).collect():
        assert sum(map(Fraction, t.p)) == Fraction(t.a) * Fraction(t.b) + Fraction(t.c)


@pytest.mark.parametrize("v", [float("nan"), float("inf"), 2.0**1000, 2.0**-1000])
def test_what_cannot_be_exact_raises(spark, v):
    df, x = spark.createDataFrame([(0, 0, v)], "i long, j long, v double"), spark.createDataFrame([(0, 1.5)], "j long, x double")
    with pytest.raises(Exception, match="exact|finite"):
        exact.multiply(df, x, spark.range(1).withColumnRenamed("id", "i")).collect()


def test_stream_over_restarts_and_a_repeated_batch(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("source", "out", "checkpoint"))
    r = np.random.default_rng(0)
    cells = [(int(i), int(j), float(v)) for i, j, v in r.integers(0, 7, (600, 3))]
    df = lambda part: spark.createDataFrame(part, deltas.SCHEMA).repartition(3)
    total = lambda part: sorted(map(tuple, matrix.coalesced(df(part)).collect()))
    df(cells[:200]).write.parquet(source)
    deltas.follow(spark, source, out, checkpoint, files=2).awaitTermination()
    assert sorted(map(tuple, deltas.state(spark, out).collect())) == total(cells[:200])
    df(cells[200:500]).write.mode("append").parquet(source)
    deltas.follow(spark, source, out, checkpoint, files=1).awaitTermination()
    # the last batch was written but, as after a loss, not committed: it runs again
    last = max(int(f) for f in os.listdir(f"{checkpoint}/commits") if f.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")
    df(cells[500:]).write.mode("append").parquet(source)
    deltas.follow(spark, source, out, checkpoint, files=2).awaitTermination()
    assert sorted(map(tuple, deltas.state(spark, out).collect())) == total(cells)
    assert len({f for f in os.listdir(out) if f.startswith("batch=")}) > 4


def uncommitted(checkpoint):
    """The last batch as after a loss: written, but not committed."""
    last = max(int(f) for f in os.listdir(f"{checkpoint}/commits") if f.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")


def test_compacted_batches_hold_the_same_state(spark, tmp_path, monkeypatch):
    source, out, checkpoint = (str(tmp_path / n) for n in ("source", "out", "checkpoint"))
    r = np.random.default_rng(1)
    # the last files touch few coordinates, so that most values stand in old batches only
    cells = [(int(i), int(j), float(v)) for i, j, v in r.integers(0, 9, (500, 3))] + [(1, 1, 1.0), (2, 2, 2.0), (1, 1, 3.0)]
    df = lambda part, n: spark.createDataFrame(part, deltas.SCHEMA).repartition(n)
    total = lambda part: sorted(map(tuple, matrix.coalesced(df(part, 2)).collect()))
    now = lambda: sorted(map(tuple, deltas.state(spark, out).collect()))
    folders = lambda: sorted(int(f[6:]) for f in os.listdir(out) if f.startswith("batch="))
    assert deltas.compact(spark, out) == 0
    for part, n in ((cells[:500], 4), (cells[500:501], 1), (cells[501:502], 1)):
        df(part, n).write.mode("append").parquet(source)
        deltas.follow(spark, source, out, checkpoint, files=1).awaitTermination()
    n = len(folders())
    assert n > 4
    # a break after the folded rows were added, before all old folders are gone
    with monkeypatch.context() as m:
        m.setattr(deltas, "opened", broken_after(deltas.opened, 2))
        with pytest.raises(OSError, match="lost"):
            deltas.compact(spark, out)
    assert now() == total(cells[:502])
    assert deltas.compact(spark, out) > 0
    assert len(folders()) == 2 and now() == total(cells[:502])
    held = sum(spark.read.parquet(f"{out}/batch={b}").count() for b in folders())
    assert held <= 3 * len(total(cells[:502]))
    # the last batch, which was left alone, runs again, and the next one comes
    uncommitted(checkpoint)
    df(cells[502:], 1).write.mode("append").parquet(source)
    deltas.follow(spark, source, out, checkpoint, files=1).awaitTermination()
    assert now() == total(cells)
    assert deltas.compact(spark, out) == 1 and now() == total(cells)
    assert deltas.compact(spark, out) == 0


def broken_after(call, n):
    left = [n]

    def run(*args):
        left[0] -= 1
        if left[0] < 0:
            raise OSError("lost")
        return call(*args)

    return run


def test_sweep_is_resumed(spark, tmp_path):
    """A run that breaks off in the middle of the plan: the next measures only what is missing, and the report has every cell once."""
    path = str(tmp_path / "results")
    numbers = lambda name, *v: spark.createDataFrame([(x,) for x in v], f"{name} long")
    kinds = spark.createDataFrame([("merge",), ("runtime_static",)], "executable string")
    plan = sweep.plan(spark.createDataFrame([("a",), ("b_chunk",)], "matrix string"), kinds, numbers("threads", 1, 2), numbers("run", 1, 2), numbers("chunk", 10, 100))
    asked = []

    def make(cell):
        asked.append(tuple(cell[c] for c in sweep.CELL))
        if len(asked) == 6:
            raise RuntimeError("lost")
        return spark.range(10)

    results.reset(spark, path)
    assert not results.any_file(spark, path) and not results.any_file(spark, f"{path}/none")
    with pytest.raises(RuntimeError):
        sweep.run(spark, plan, {"merge": make, "runtime_static": make}, path, "TESTBENCH9_RES")
    assert results.scan(spark, path).count() == 5
    assert sweep.run(spark, plan, {"merge": make, "runtime_static": make}, path, "TESTBENCH9_RES", most=4) == 4
    assert sweep.run(spark, plan, {"merge": make, "runtime_static": make}, path, "TESTBENCH9_RES") == plan.count() - 9
    assert sweep.run(spark, plan, {"merge": make, "runtime_static": make}, path, "TESTBENCH9_RES") == 0
    found = [(r.matrix, r.Executable, r.Threads, r.Run, r.ChunkSize) for r in results.scan(spark, path).collect()]
    assert len(found) == len(set(found)) == plan.count() == len(asked) - 1
    assert {(r.executable, r.threads) for r in sweep.report(spark, path).where("p90 > 0").collect()} == {(e, t) for e in ("merge", "runtime_static") for t in (1, 2)}
    results.reset(spark, path)
    assert not results.any_file(spark, path)
