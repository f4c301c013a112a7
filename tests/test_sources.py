"""Readers, writers and their errors on small files; statistics and schedules against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.functions.statistics import midpoint_percentile
from spindle.operators import matrix, order, schedule, spmv
from spindle.sources import mtx, results


def put(tmp_path, text):
    path = tmp_path / "m.mtx"
    path.write_text(text)
    return str(path)


def entries(spark, path, **options):
    meta, rows = mtx.read(spark, path, **options)
    return meta, sorted(map(tuple, rows.collect()))


HEAD = "%%MatrixMarket matrix coordinate real general\n"


def test_reads_as_many_entries_as_stated(spark, tmp_path):
    path = put(tmp_path, HEAD + "% note\n%\n\n  3 3 2\n\t1 1\t2.5\n 3 2 -1e-3 \n2 2 9\n% trailing\n")
    meta, rows = entries(spark, path)
    assert (meta.n_rows, meta.n_cols, meta.nnz) == (3, 3, 2)
    assert rows == [(0, 0, 2.5), (2, 1, -1e-3)]
    assert entries(spark, put(tmp_path, HEAD + "3 3 0\n"))[1] == []
    long = HEAD + "% c\n" * 2500 + "4 4 3000\n" + "".join(f"{k % 4 + 1} {k // 4 % 4 + 1} {k}\n" for k in range(3000))
    assert [v for *_, v in sorted(entries(spark, put(tmp_path, long))[1], key=lambda r: r[2])] == list(range(3000))


@pytest.mark.parametrize(
    "text, error",
    [
        ("", mtx.PrematureEof),
        ("%%MatrixMarket matrix coordinate real\n", mtx.PrematureEof),
        ("%MatrixMarket matrix coordinate real general\n1 1 0\n", mtx.NoHeader),
        ("%%MatrixMarket vector coordinate real general\n1 1 0\n", mtx.UnsupportedType),
        ("%%MatrixMarket matrix coordinate quaternion general\n1 1 0\n", mtx.UnsupportedType),
        (HEAD, mtx.PrematureEof),
        (HEAD + "% only\n", mtx.PrematureEof),
        (HEAD + "2 2\n", mtx.PrematureEof),
        (HEAD + "2 2 2\n1 1 1\n", mtx.PrematureEof),
        (HEAD + "2 2 2\n1 1 1\n2 2\n", mtx.PrematureEof),
        (HEAD + "2 2 2\n1 1 1\n2 x 3\n", mtx.PrematureEof),
        (HEAD + "2 2 2\n1 1 1\n% late\n2 2 1\n", mtx.PrematureEof),
        (HEAD.strip() + " " * 50 + "x" * 2000 + "\n1 1 0\n", mtx.LineTooLong),
    ],
)
def test_reader_errors(spark, tmp_path, text, error):
    with pytest.raises(error):
        entries(spark, put(tmp_path, text))


def test_other_errors(spark, tmp_path):
    with pytest.raises(mtx.CouldNotReadFile) as e:
        mtx.read(spark, str(tmp_path / "none.mtx"))
    assert e.value.code == 11
    dense = put(tmp_path, "%%MatrixMarket matrix array real general\n2 1\n1\n2\n")
    with pytest.raises(mtx.UnsupportedType):
        mtx.read(spark, dense, for_product=True)
    coo = spark.createDataFrame([(0, 0, 1.0)], "i long, j long, v double")
    with pytest.raises(mtx.UnsupportedType):
        mtx.write(coo, str(tmp_path / "o"), mtx.Meta("array", "pattern", "general", 1, 1, 1))
    with pytest.raises(mtx.CouldNotWriteFile) as e:
        mtx.write(coo, f"{dense}/under", mtx.Meta("coordinate", "real", "general", 1, 1, 1))
    assert e.value.code == 17
    with pytest.raises(FileNotFoundError):
        (tmp_path / "empty").mkdir()
        results.scan(spark, str(tmp_path / "empty"))


def test_arrays_and_complex_files(spark, tmp_path):
    dense = put(tmp_path, "%%MatrixMarket matrix array real general\n% by columns\n2 3\n1\n2\n3\n4\n5\n6\n7\n")
    meta, rows = entries(spark, dense)
    assert rows == [(i, j, 1.0 + i + 2 * j) for i in range(2) for j in range(3)]
    mtx.write(mtx.read(spark, dense)[1], str(tmp_path / "dense"), meta)
    assert entries(spark, str(tmp_path / "dense")) == (meta, rows)
    text = "%%MatrixMarket matrix coordinate complex {}\n3 3 3\n1 1 2 0\n2 1 1 4\n3 2 -1 0.5\n"
    want = {"hermitian": (1.0, -1.0), "symmetric": (1.0, 1.0), "skew-symmetric": (-1.0, -1.0)}
    for kind, (re, im) in want.items():
        got = entries(spark, put(tmp_path, text.format(kind)), expand_symmetry=True)[1]
        assert got == sorted([(0, 0, 2.0, 0.0), (1, 0, 1.0, 4.0), (2, 1, -1.0, 0.5), (0, 1, re, 4 * im), (1, 2, -re, 0.5 * im)])
    meta, rows = entries(spark, put(tmp_path, text.format("general")))
    mtx.write(mtx.read(spark, put(tmp_path, text.format("general")))[1], str(tmp_path / "complex"), meta)
    assert entries(spark, str(tmp_path / "complex")) == (meta, rows)


def test_timing_lines(spark):
    said = {"Elapsed time: 1.08033e-05 seconds": 1.08033e-05, "Elapsed time: 5e-06 seconds": 5e-06, "Elapsed time: 3 seconds": 3.0, "Elapsed time: 0.0000054": 0.0000054, "\tElapsed time:  0.25 seconds": 0.25, "Elapsed time:": None, "Elapsed time: soon": None, "run took 3": None, "": None}
    rows = spark.createDataFrame([*said.items(), (None, None)], "line string, want double")
    assert all(r.got == r.want for r in rows.withColumn("got", results.elapsed("line")).collect())


def midpoint(values, p):
    s = sorted(values)
    h = min(max(p * len(s) + 0.5, 1), len(s))
    k = math.floor(h)
    return s[k - 1] + (h - k) * (s[min(k, len(s) - 1)] - s[k - 1])


def test_percentile_with_outliers_and_repeats(spark):
    rng = np.random.default_rng(0)
    groups = {f"n{n}": rng.random(n).tolist() for n in (1, 2, 3, 5, 10, 14, 16, 25)}
    groups["outlier"] = [*rng.random(30_000).tolist(), 1e18]
    groups["repeats"] = [*[1.0] * 20_000, *rng.random(3_000).tolist(), *[2.0] * 9_000]
    groups["low"] = rng.normal(size=12_345).tolist()
    rows = spark.createDataFrame([(g, v) for g, own in groups.items() for v in own] + [("n1", None)], "g string, v double").repartition(5)
    for p in (0.9, 0.5):
        got = {r.g: r.x for r in midpoint_percentile(rows, ["g"], "v", p, "x").collect()}
        assert got.keys() == groups.keys()
        assert all(math.isclose(got[g], midpoint(own, p), rel_tol=1e-12) for g, own in groups.items()), p
    assert midpoint_percentile(rows.limit(0), ["g"], "v", 0.9, "x").count() == 0


def test_products_do_not_depend_on_the_schedule(spark):
    """Empty rows, a dense row, repeats, cancellation, workers beyond rows, and an empty matrix."""
    rng = np.random.default_rng(1)
    cells = [(3, int(j), 1.0) for j in range(40)] + [(int(i), int(j), float(v)) for i, j, v in rng.integers(0, 9, (60, 3))] + [(5, 1, 2.0), (5, 1, -2.0)]
    a = np.zeros((12, 40))
    for i, j, v in cells:
        a[i, j] += v
    coo = spark.createDataFrame(cells, "i long, j long, v double")
    x = matrix.uniform_vector(spark.range(40).withColumnRenamed("id", "j"), 3)
    assert all(-1 <= r.x < 1 for r in x.collect())
    b = np.array([r.x for r in x.orderBy("j").collect()])
    rows = spark.range(12).withColumnRenamed("id", "i")
    distinct = matrix.coalesced(coo)
    for y in (spmv.multiply(coo, x, rows), spmv.multiply_nested(distinct, x, rows), *(spmv.multiply_merge(distinct, x, rows, n) for n in (1, 3, 50))):
        got = [r.y for r in y.orderBy("i").collect()]
        assert np.allclose(got, a @ b, atol=1e-12)
    assert [r.y for r in spmv.multiply_merge(distinct.limit(0), x, rows, 4).collect()] == [0.0] * 12
    with pytest.raises(ValueError):
        schedule.merge_path(distinct, rows.where("i != 4"), 3)


def test_dense_rows_with_a_short_and_a_long_vector(spark, monkeypatch):
    rows = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [0.0, 0.0, 0.0]), (2, [4.0, 0.0, -1.0])], "i long, a array<double>")
    x = spark.createDataFrame([(0, 2.0), (2, 5.0)], "j long, x double")
    for sent in (spmv.SENT, 2):
        monkeypatch.setattr(spmv, "SENT", sent)
        assert sorted(map(tuple, spmv.multiply_dense(rows, x, 3).collect())) == [(0, 17.0), (1, 0.0), (2, 3.0)]


def test_numbers_and_neighbours_of_repeated_entries(spark):
    cells = [(0, 5)] * 30 + [(0, 6), (2, 1), (2, 1), (4, 0)]
    coo = spark.createDataFrame(cells, "i long, j long").repartition(4)
    got = sorted((r.i, r.j, not r.new_row, not r.new_col) for r in matrix.boundaries(coo).collect())
    want = [(*c, k > 0 and cells[k - 1][0] == c[0], k > 0 and cells[k - 1] == c) for k, c in enumerate(cells)]
    assert got == sorted(want)
    placed, n = order.numbered(coo, ["i", "j"])
    assert n == len(cells) and sorted(r.row_no for r in placed.collect()) == list(range(n))
    empty, none = order.numbered(coo.limit(0), ["i", "j"])
    assert none == 0 and empty.count() == 0
    assert matrix.nested_rows(coo.withColumn("v", F.lit(1.0))).count() == 3
