"""Large families of near copies that share buckets: what meets, before any condition, grows in proportion."""

import random

import pytest
from pyspark.sql import functions as F

from spindle.llm import common, near_dedup
from test_operators import brute_classes


def families(copies, n_families=2, words=300, own=60, changed=1, seed=0):
    """(id, text): each family has its own words in one place, each copy another word or so changed."""
    r = random.Random(seed)
    base = [f"b{k}" for k in range(words)]
    out = []
    for f in range(n_families):
        mine = list(base)
        mine[20 : 20 + own] = [f"f{f}_{k}" for k in range(own)]
        for c in range(copies):
            text = list(mine)
            for _ in range(changed):
                text[r.randrange(words)] = f"c{f}_{c}_{r.random()}"
            out.append((len(out), " ".join(text)))
    return out


def meetings(spark, rows):
    """Rows of both joins of meetings(), before any condition."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    texts = df.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")
    held, roots, sets = near_dedup.led(texts)
    ranked = near_dedup.ranked_differences(held, roots)
    across, nodes, read = near_dedup.meetings(ranked)
    n = across.count(), nodes.count()
    common.dropped(held, roots, sets, ranked, *read)
    return n


def test_candidates_of_families_grow_in_proportion(spark):
    n = {copies: sum(meetings(spark, families(copies))) for copies in (40, 300, 1200, 3000)}
    assert n[3000] <= 15 * max(n[300], 1000) and n[3000] < 30 * 3000, n
    three = {copies: sum(meetings(spark, families(copies, n_families=3))) for copies in (300, 1200)}
    assert three[1200] <= 6 * max(three[300], 1000), three


@pytest.mark.parametrize("n_families, own, changed", [(2, 60, 1), (3, 30, 1), (4, 22, 2), (3, 26, 3)])
def test_classes_of_families_equal_brute_force(spark, n_families, own, changed):
    """Families far apart, and such that some of their members are similar and others not."""
    rows = families(25, n_families, 200, own, changed, seed=own)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r._id, r.class_id) for r in near_dedup.classes(df).collect())
    assert got == sorted(brute_classes(rows))
