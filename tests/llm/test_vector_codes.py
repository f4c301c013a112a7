"""Vector codes against plain numpy, and the tree against a full search."""

import hashlib
import math

import numpy as np
import pytest

from oracle import compare
from spindle.llm import registry, vector_codes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n, width, spread", [(1, 3, 9), (16, 1, 4), (17, 2, 3), (256, 16, 300), (256, 16, 2), (900, 4, 10), (300, 8, 1 << 26)])
def test_tree_finds_the_lowest_of_the_nearest(n, width, spread):
    """Many ties and equal points, few and many points, the greatest numbers."""
    r = np.random.default_rng(n + width)
    points, queries = r.integers(-spread, spread + 1, (n, width)), r.integers(-spread, spread + 1, (700, width))
    queries[:50] = points[r.integers(0, n, 50)]
    d = vector_codes.squared(queries, points)
    tree = vector_codes.Gnat(points)
    index, best = tree.nearest(queries)
    assert (best == d.min(1)).all() and (index == d.argmin(1)).all()
    assert tree.nearest(queries[:0])[0].size == 0


def test_tree_prunes_whole_subtrees():
    """On clustered points most are never measured."""
    r = np.random.default_rng(0)
    centres = r.integers(-100_000, 100_000, (16, 8))
    points = np.concatenate([c + r.integers(-50, 50, (32, 8)) for c in centres])
    tree = vector_codes.Gnat(points)
    tree.nearest(points[r.integers(0, len(points), 1000)] + r.integers(-9, 9, (1000, 8)))
    assert tree.measured < 0.3 * 1000 * len(points)


def brute(rows, parts=4, entries=256, rounds=4):
    """{(id, label): sorted [(code, error, label_error)]} and the codebooks' digest."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    x = np.array([v for _, v, _ in kept]).reshape(len(kept), parts, width)
    books = [x[:entries, p].copy() for p in range(parts)]
    near = lambda p: ((x[:, p, None, :] - books[p][None]) ** 2).sum(2)
    for _ in range(rounds):
        for p in range(parts):
            code = near(p).argmin(1)
            for e in set(code.tolist()):
                own = x[code == e, p]
                books[p][e] = [int(s) // len(own) for s in own.sum(0)]
    codes, error = np.stack([near(p).argmin(1) for p in range(parts)], 1), sum(near(p).min(1) for p in range(parts))
    totals = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        totals[label] = totals.get(label, 0) + int(e)
    out = sorted(((i, label, "".join(f"{c:02x}" for c in code), int(e), totals[label]) for (i, _, label), code, e in zip(kept, codes.tolist(), error, strict=True)), key=str)
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


@pytest.mark.parametrize("entries", [5, 64, 256])
def test_compress(spark, entries):
    """Nulls in every column, non-finite components, ties, a third of all rows alike, a hot label, clashing names."""
    r = np.random.default_rng(entries)
    rows = [(int(i), [float(c) for c in r.normal(0, 0.2, 8)], int(r.integers(0, 4))) for i in r.permutation(150)]
    rows += [(900, [0.25] * 8, 1)] * 80 + [(None, [0.5] * 8, None), (901, None, 2), (902, [0.1] * 7 + [None], 2), (903, [float("nan")] + [0.1] * 7, 2), (904, [float("-inf")] * 8, 2), (5, [-0.00001] * 8, None)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<double>, label int, code int, `a.b` int").repartition(4)
    out, books = vector_codes.compress(df, entries=entries)
    want, sha = brute(rows, entries=entries)
    assert sorted((tuple(x) for x in out.select("_id", "_label", "code", "error", "label_error").collect()), key=str) == want
    assert vector_codes.digest(books) == sha


def test_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], schema))[0].count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1), (2, [None], 1)], schema))[0].count() == 0
    for bad in ([(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)], [(1, [1.0] * 6, 1)], [(1, [], 1)], [(1, [1e9] * 4, 1)]):
        with pytest.raises(ValueError):
            vector_codes.compress(spark.createDataFrame(bad, schema))


def test_query(spark):
    assert compare(spark, "op13_vector_codes", registry.QUERIES["op13_vector_codes"], registry.ORACLE_SQL["op13_vector_codes"], SF) > 100
