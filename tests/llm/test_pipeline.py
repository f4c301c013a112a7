"""Each stage and the whole pipeline, against plain Python and on hard tables."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spindle.llm import pii, toxicity
from test_operators import PATTERNS, PROSE, brute_classes, holds

SF = "/root/testdata/sf0.001"
NAMES = "doc_id long, text string, lang string, source string, n_chars long, rate double, n_copies int, copy int, mix_key long, toxicity_score double, toxicity_predicted int, pii_base string, pii_added int, _row int, KEY string, `a.b` int, `c d` array<int>"
EXTRA = (0.5, 7, 1, 2, 0.25, 1, "own", 3, 4, "K", 5, [1, 2])
HARD = [
    (1, PROSE + " one@two.org", "en", "s0", 9),
    (2, PROSE + " one@two.org", None, "s0", None),
    (2, PROSE + " one@two.org", None, "s0", None),
    (3, "", "en", "s1", 0),
    (4, None, None, None, None),
    (None, "call +1 (234) 555-0199 " + PROSE.upper(), "de", "s1", 3),
    (5, ("long words go on and on " * 9000).strip(), "en", "s1", 9),
    (6, "x" * 60000, "en", "s1", 9),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(*r, *EXTRA) for r in HARD], NAMES).repartition(3)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_hard_tables(spark, hard, name, stage):
    out = stage(spark, hard, SF)
    rows = out.collect()
    assert stage(spark, hard.limit(0), SF).count() == 0
    if name == "byte-level BPE":
        assert len(rows) == len(HARD)
        return
    assert out.schema.simpleString() == hard.schema.simpleString()
    assert all(tuple(r)[5:] == EXTRA for r in rows)
    if name == "near duplicates":
        assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 3, 4, 5, 6]
    if name == "personal data":
        by = {(r.doc_id, r.text) for r in rows}
        assert (1, PROSE + " <EMAIL>") in by and (None, "call <PHONE> " + PROSE.upper()) in by and (4, None) in by and (3, "") in by
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def quantile(u, rate):
    n, below, p = 0, 0.0, math.exp(-rate)
    while True:
        below += p
        if below > u:
            return n
        n += 1
        p *= rate / n


def part(kind, key, digits):
    return int(hashlib.md5(f"{kind}:{key}".encode()).hexdigest()[:digits], 16)


def test_pipeline_equals_plain_python(spark):
    """Every stage again in Python over the whole table; the two fitted models and the spans that trees add are the library's own."""
    import public_tokenizers as P
    import tiktoken
    from spindle.llm.byte_bpe import ByteBPE

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    table = docs.collect()
    model = toxicity.train(docs, labels)
    scorer = None if "constant" in model else toxicity.Scorer(model["lexicon"])
    value = lambda t: model["constant"] if scorer is None else float(np.interp(model["trees"].margin(np.array([scorer.features(t)])), *model["knots"])[0])
    kept = [r for r in table if value(r.text) < 0.5]
    assert 0 < len(kept)
    first, out = set(), []
    classes = brute_classes([(r.doc_id, r.text) for r in kept])
    for r, (_, c) in sorted(zip(kept, classes), key=lambda x: x[0].doc_id):
        if c not in first:
            first.add(c)
            out.append(r)
    stayed = docs.join(spark.createDataFrame([(r.doc_id,) for r in out], "doc_id long"), "doc_id", "left_semi")
    added = {r.doc_id: r.pii_added for r in pii.find(stayed, pii.train(stayed)).collect()}
    clean = {}
    for r in out:
        t, at, parts = r.text or "", 0, []
        spans = [(m.start(), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, t) if holds(k, m[0])] + [(s["start"], s["end"], s["kind"]) for s in added[r.doc_id]]
        for start, end, kind in sorted(spans):
            if start >= at:
                parts += [t[at:start], f"<{kind.upper()}>"]
            at = max(at, end)
        clean[r.doc_id] = "".join(parts) + t[at:]
    n, rates = {}, {}
    for r in out:
        n[r.source] = n.get(r.source, 0) + 1
    for s, k in n.items():
        rates[s] = len(out) * math.sqrt(k) / sum(map(math.sqrt, n.values())) / k
    bpe = ByteBPE(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    want = []
    for r in out:
        ids = np.array(lib.encode_ordinary(clean[r.doc_id]), "<u4").tobytes()
        row = (r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(clean[r.doc_id].encode()).hexdigest())
        want += [row] * quantile(part("count", f"11:{r.doc_id}", 13) / 2**52, rates[r.source])
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()]
    assert len(got) > 50 and sorted(got) == sorted(want)


def test_mixing_is_in_global_hash_order(spark):
    from spindle.llm import mixing

    rows = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), size=5.0).withColumn("part", F.spark_partition_id()).collect()
    keys = [(r.mix_key, r.copy) for r in sorted(rows, key=lambda r: r.part)]
    assert len({r.part for r in rows}) > 3 and keys == sorted(keys)
    u = spark.createDataFrame([(0.0, 1.0), (0.3, 1.0), (0.999, 1.0), (0.5, 40.0), (0.25, 900.0), (0.7, 0.0)], "u double, rate double")
    got = [r.n for r in u.withColumn("n", mixing.poisson_quantile(F.col("u"), F.col("rate"))).collect()]
    assert got[:4] == [quantile(a, b) for a, b in [(0.0, 1.0), (0.3, 1.0), (0.999, 1.0), (0.5, 40.0)]] and got[5] == 0
    assert 870 < got[4] < 890
