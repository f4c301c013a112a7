"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from oracle import compare
from spindle.llm import importance, registry

SF = "/root/testdata/sf0.001"


def plain_words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def runs(text, longest):
    w = plain_words(text)
    return [" ".join(w[k : k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


def brute(rows, target, percent, least, n_buckets=10_000, longest=1):
    """Sorted rows (id, n_features, weight, score, rank)."""
    bucket = lambda f: zlib.crc32(f.encode()) % n_buckets
    s, t = [0] * n_buckets, [0] * n_buckets
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for f in runs(text, longest):
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + n_buckets) / ((s[b] + 1.0) * (sum(t) + n_buckets)))) for b in range(n_buckets)]
    out = []
    for i, text in rows:
        own = runs(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in own)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(text)) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("longest, percent, least", [(1, 30, 3), (2, 100, 0), (1, 0, 3), (3, 7, 1)])
def test_resample(spark, longest, percent, least):
    """Nulls, empty and very long texts, ties, a third of all rows alike, clashing names."""
    r = np.random.default_rng(longest)
    rows = [(int(i), " ".join(r.choice(["The", "cat", "É", "x9", "naïve-", "日本", "Zoo_"], int(r.integers(0, 9))))) for i in r.permutation(120)]
    rows += [(500, "the cat sat")] * 70 + [(None, "null id here"), (None, None), (501, None), (502, ""), (503, "The long " * 30_000), (503, "other text of it")]
    target = ["the CAT", "x9 x9", None, ""]
    df = spark.createDataFrame([(*x, "a", 1, 2) for x in rows], "doc_id long, text string, score string, `a.b` int, _tie int").repartition(4)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    out = importance.resample(df, goal, percent=percent, least_words=least, longest=longest, n_buckets=997).collect()
    assert sorted((tuple(x) for x in out), key=str) == brute(rows, target, percent, least, 997, longest)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert importance.resample(none, one).count() == 0
    assert [tuple(r) for r in importance.resample(one, none, percent=100, least_words=1).collect()] == brute([(1, "a b c")], [], 100, 1)


def test_bisection_counts_exactly(spark):
    values = [-5] * 40 + [3, 3, 4, 10**15, -(10**15)]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    for n in (1, 2, 41, 42, 43, 44, 45):
        assert importance.least_reaching(df, "x", n) == sorted(values)[n - 1]


def test_query(spark):
    assert compare(spark, "op12_importance", registry.QUERIES["op12_importance"], registry.ORACLE_SQL["op12_importance"], SF) > 100
