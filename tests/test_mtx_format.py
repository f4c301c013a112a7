"""The Matrix Market data source against plain files and the line reader."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.sources import mtx, mtx_format

HEAD = "%%MatrixMarket matrix coordinate real general\n"


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    mtx_format.register(spark)


def put(tmp_path, text, name="m.mtx"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("bytes_", [7, 16, 64, 1 << 20])
def test_ranges_find_their_own_line_starts(spark, tmp_path, monkeypatch, bytes_):
    """Whatever the cut: comments, blank lines, tabs, no last line feed, surplus lines; each line is one range's."""
    body = "".join(f"{k % 50 + 1}\t {k // 50 + 1}  {k}.5 \n" + "\n" * (k % 7 == 0) for k in range(300))
    path = put(tmp_path, HEAD + "% note\n%\n\n  50 6 300\n" + body + "9 9 9\n%late\n1 2 3")
    meta, at = mtx_format.header(path)
    reader = mtx_format.MtxReader(path, meta, at, True, None, False)
    monkeypatch.setattr(mtx_format, "RANGE", bytes_)
    monkeypatch.setattr(mtx_format, "BLOCK", max(3, bytes_ // 3))
    found = [r for part in reader.partitions() for b in reader.read(part) for r in zip(*(b.column(c).to_pylist() for c in range(3)))]
    assert found == [(k % 50, k // 50, k + 0.5) for k in range(300)]


def test_reads_as_the_line_reader_does(spark, tmp_path):
    for text in (
        HEAD + "3 3 2\n 1 1\t2.5\n3 2 -1e-3 extra\n2 2 9\n", HEAD + "3 3 0\n", "%%matrixmarket MATRIX".replace("matrixmarket", "MatrixMarket") + " Coordinate PATTERN Symmetric\n3 3 2\n2 1\n3 3\n", "%%MatrixMarket matrix coordinate integer general\n2 2 1\n+2 02 7\n",
        "%%MatrixMarket matrix array real general\n2 2\n1\n2\n3\n4\n5\n", "%%MatrixMarket matrix coordinate complex hermitian\n3 3 2\n1 1 2 0\n2 1 1 4\n",
    ):
        path = put(tmp_path, text)
        meta, want = mtx.read(spark, path)
        own, got = mtx_format.load(spark, path)
        assert own == meta and rows(got) == rows(want)
        assert rows(spark.read.format("mtx").load(path)) == rows(want)  # counted by the planner
        assert rows(mtx_format.load(spark, path, expand_symmetry=True)[1]) == rows(mtx.read(spark, path, expand_symmetry=True)[1])
        assert rows(mtx_format.load(spark, path, zero_based=False)[1]) == sorted((r[0] + 1, r[1] + 1, *r[2:]) for r in rows(want))


@pytest.mark.parametrize(
    "text, error",
    [
        ("", mtx.PrematureEof), ("%MatrixMarket matrix coordinate real general\n1 1 0\n", mtx.NoHeader), ("%%MatrixMarket vector coordinate real general\n1 1 0\n", mtx.UnsupportedType), (HEAD + "% only\n" * 50_000, mtx.PrematureEof),
        (HEAD + "2 2\n", mtx.PrematureEof), (HEAD + "2 2 2\n1 1 1\n", mtx.PrematureEof), (HEAD.strip() + " " * 50 + "x" * 2000 + "\n1 1 0\n", mtx.LineTooLong),
    ],
)
def test_errors(spark, tmp_path, text, error):
    with pytest.raises(error):
        mtx_format.load(spark, put(tmp_path, text))


def test_broken_entries_and_missing_files(spark, tmp_path):
    for body in ("1 1 1\n2 x 3\n", "1 1 1\n% late\n", "1 1 1\n2 2\n", "1 1 1\n1_0 1 1\n"):
        with pytest.raises(Exception, match="entry 2 is broken"):
            mtx_format.load(spark, put(tmp_path, HEAD + "20 20 2\n" + body))[1].collect()
    with pytest.raises(mtx.CouldNotReadFile):
        mtx_format.load(spark, str(tmp_path / "none"))
    assert rows(mtx_format.load(spark, put(tmp_path, HEAD + "2 2 1\n1 1 1\nbroken\n"))[1]) == [(0, 0, 1.0)]


def cells(spark, n, m):
    return spark.range(n * m).select(F.expr(f"id div {m}").alias("i"), F.expr(f"id % {m}").alias("j"), (F.col("id") * 0.1).alias("v"))


def test_round_trip_in_one_pass(spark, tmp_path, monkeypatch):
    """Every kind; the size line comes from the tasks' counts, the index from their marks, and the planner counts nothing."""
    want = rows(cells(spark, 40, 30))
    for matrix, field in (("coordinate", "real"), ("array", "real"), ("coordinate", "complex"), ("coordinate", "pattern"), ("coordinate", "integer")):
        path = str(tmp_path / f"{matrix}-{field}")
        df = cells(spark, 40, 30).withColumn("im", F.col("v") + 1) if field == "complex" else cells(spark, 40, 30)
        mtx_format.save(df, path, matrix=matrix, field=field)
        meta, at = mtx_format.header(path)
        assert (meta.n_rows, meta.n_cols, meta.nnz, meta.field) == (40, 30, 1200, field)
        value = {"pattern": lambda v: (1.0,), "complex": lambda v: (v, v + 1), "integer": lambda v: (float(int(v)),)}.get(field, lambda v: (v,))
        expected = [(i, j, *value(v)) for i, j, v in want]
        with monkeypatch.context() as m:
            m.setattr(mtx_format, "_tokens_by_line", None)
            reader = mtx_format.MtxReader(path, meta, at, True, None, False)
            assert sum(r.stop - r.start for r in reader.partitions()) == sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.startswith("part-") and f != mtx_format.HEAD)
        assert rows(spark.read.format("mtx").load(path)) == expected
        assert rows(mtx.read(spark, path)[1]) == expected  # as any Matrix Market text
    mtx_format.save(cells(spark, 3, 3).limit(0), path, rows=5, cols=6)
    assert mtx_format.header(path)[0] == mtx.Meta("coordinate", "real", "general", 5, 6, 0) and spark.read.format("mtx").load(path).count() == 0
    assert not [f for f in os.listdir(path) if "temporary" in f]


def test_pushed_filters_skip_ranges(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "sorted")
    monkeypatch.setattr(mtx_format, "RANGE", 400)
    cells(spark, 200, 5).coalesce(1).sortWithinPartitions("i", "j").write.format("mtx").mode("overwrite").save(path)
    with open(f"{path}/{mtx_format.INDEX}") as f:
        index = json.load(f)
    assert index["sorted"]
    marks = index["files"][0]["marks"]
    index["files"][0]["marks"] = [[0, 0, 0]]
    # ranges by rows, from the file itself
    with open(f"{path}/part-000001.mtx") as f:
        at = n = 0
        for line in f:
            i = int(line.split()[0]) - 1
            if n % 100 == 0 and n:
                index["files"][0]["marks"].append([at, n, i])
            at, n = at + len(line), n + 1
    assert marks[0] == [0, 0, 0]
    with open(f"{path}/{mtx_format.INDEX}", "w") as f:
        json.dump(index, f)
    meta, body = mtx_format.header(path)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

    for zero_based in (True, False):
        for filters, test in (([EqualTo(("i",), 33)], lambda i: i == 33), ([GreaterThan(("i",), 150)], lambda i: i > 150), ([In(("i",), (3, 160))], lambda i: i in (3, 160))):
            reader = mtx_format.PushingReader(path, meta, body, zero_based, None, False)
            assert list(reader.pushFilters([*filters, StringContains(("i",), "x")])) == [StringContains(("i",), "x")]
            parts = reader.partitions()
            found = [i for p in parts for b in reader.read(p) for i in b.column(0).to_pylist()]
            assert len(parts) < 6 and sorted(found) == [i for i in range(1 - zero_based, 201 - zero_based) if test(i) for _ in range(5)]


def test_pushdown_only_where_the_session_allows_it(spark, tmp_path):
    path = str(tmp_path / "pushed")
    mtx_format.save(cells(spark, 20, 5), path)
    for allowed in ("false", "true"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", allowed)
        try:
            got = mtx_format.load(spark, path)[1].where("i = 7 AND v > 3.6")
            assert rows(got) == [r for r in rows(cells(spark, 20, 5)) if r[0] == 7 and r[2] > 3.6]
        finally:
            spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_failed_jobs_leave_no_file(spark, tmp_path):
    path = str(tmp_path / "failed")
    bad = cells(spark, 50, 4).repartition(4).withColumn("v", F.when(F.col("i") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("mtx").mode("overwrite").save(path)
    assert not os.path.exists(path) or not os.listdir(path)
    # an overwrite that fails leaves what was there
    mtx_format.save(cells(spark, 5, 4), path)
    before = {f: os.path.getmtime(f"{path}/{f}") for f in os.listdir(path)}
    with pytest.raises(Exception, match="lost"):
        bad.write.format("mtx").mode("overwrite").save(path)
    with pytest.raises(Exception, match="cells of an array"):
        mtx_format.save(cells(spark, 5, 4).where("i + j > 0"), path, matrix="array")
    with pytest.raises(Exception, match="outside"):
        mtx_format.save(cells(spark, 5, 4), path, rows=3)
    with pytest.raises(Exception, match="null"):
        mtx_format.save(cells(spark, 5, 4).withColumn("v", F.lit(None).cast("double")), path)
    assert {f: os.path.getmtime(f"{path}/{f}") for f in os.listdir(path)} == before and rows(spark.read.format("mtx").load(path)) == rows(cells(spark, 5, 4))
    with pytest.raises(Exception, match="array pattern"):
        mtx_format.save(cells(spark, 2, 2), path, matrix="array", field="pattern")
    with pytest.raises(Exception):
        cells(spark, 2, 2).write.format("mtx").mode("append").save(path)
    file = put(tmp_path, "x")
    with pytest.raises(Exception, match="CouldNotWriteFile"):
        mtx_format.save(cells(spark, 2, 2), file)


def test_no_executor_counts_twice(spark, tmp_path):
    """Entries that come in any order are written as they come, and the index says that they are not sorted."""
    path = str(tmp_path / "mixed")
    r = np.random.default_rng(0)
    df = spark.createDataFrame([(int(i), int(j), float(v)) for i, j, v in r.integers(0, 99, (500, 3))], "i long, j long, v double").repartition(3)
    df.write.format("mtx").mode("overwrite").save(path)
    assert rows(spark.read.format("mtx").load(path)) == rows(df)
    with open(f"{path}/{mtx_format.INDEX}") as f:
        assert not json.load(f)["sorted"]


def test_heads_of_a_collection(spark, tmp_path):
    """Files and written folders, nested; each broken head has its code; bodies are not looked at."""
    root = tmp_path / "set"
    (root / "deep er").mkdir(parents=True)
    banner = "%%MatrixMarket matrix {}\n"
    texts = {
        "a.mtx": banner.format("coordinate real general") + "% c\n\n3 4 2\nno entry at all\n",
        "deep er/b 1%.mtx": banner.format("ARRAY complex Hermitian") + "2 2\n",
        "c.mtx": banner.format("array pattern general") + "2 5\n",
        "blank.mtx": "\n",
        "nobytes.mtx": "",
        "short.mtx": banner.format("coordinate real"),
        "nosize.mtx": banner.format("coordinate real general") + "% only\n",
        "prefix.mtx": "%MatrixMarket matrix coordinate real general\n1 1 0\n",
        "type.mtx": banner.format("coordinate octonion general") + "1 1 0\n",
        "long.mtx": banner.format("coordinate real general") + "1" + " " * 1100 + "1 0\n",
    }
    for name, text in texts.items():
        put(root, text, name)
    mtx_format.save(spark.createDataFrame([(0, 0, 1.0), (4, 6, 2.0)], "i long, j long, v double").repartition(2), str(root / "folder"), field="integer")
    found = {r["place"][len(str(root)) + 1 :]: tuple(r)[1:] for r in mtx_format.inventory(spark, str(root)).collect()}
    none = (None,) * 8
    assert found == {
        "a.mtx": (0, "coordinate", "real", "general", 3, 4, 2, True, True),
        "deep er/b 1%.mtx": (0, "array", "complex", "hermitian", 2, 2, 4, True, False),
        "c.mtx": (0, "array", "pattern", "general", 2, 5, 10, False, False),
        "folder": (0, "coordinate", "integer", "general", 5, 7, 2, True, True),
        "blank.mtx": (12, *none), "short.mtx": (12, *none), "nosize.mtx": (12, *none), "prefix.mtx": (14, *none), "type.mtx": (15, *none), "long.mtx": (16, *none),
    }
    with pytest.raises(mtx.CouldNotReadFile):
        mtx_format.inventory(spark, str(root / "missing"))
    (tmp_path / "none").mkdir()
    assert mtx_format.inventory(spark, str(tmp_path / "none")).count() == 0


def test_products_refuse_complex_and_dense_files(spark, tmp_path):
    body = {"coordinate complex general": "1 1 1\n1 1 2 3\n", "array real general": "1 1\n5\n", "coordinate real general": "1 1 1\n1 1 4\n"}
    for k, (kind, text) in enumerate(body.items()):
        path = put(tmp_path, f"%%MatrixMarket matrix {kind}\n{text}", f"{k}.mtx")
        if k < 2:
            with pytest.raises(mtx.UnsupportedType):
                mtx_format.load(spark, path, for_product=True)
        else:
            assert rows(mtx_format.load(spark, path, for_product=True)[1]) == [(0, 0, 4.0)]


def test_the_planner_counts_no_long_file(spark, tmp_path, monkeypatch):
    path = put(tmp_path, HEAD + "2 2 3\n1 1 1\n1 2 1\n2 2 1\n")
    meta, body = mtx_format.header(path)
    reader = lambda index=None: mtx_format.MtxReader(path, meta, body, True, index, False)
    index = mtx_format.indexed(spark, path)
    assert len(reader().partitions()) == 1
    monkeypatch.setattr(mtx_format, "COUNTED", 10)
    with pytest.raises(ValueError, match="without an index"):
        reader().partitions()
    assert len(reader(index).partitions()) == 1
