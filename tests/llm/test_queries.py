"""Whole queries on sf0.001 against the public libraries or plain Python."""

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
from pyspark.sql import functions as F

from spindle.llm import language_id, registry, sharding, toxicity
from test_operators import PATTERNS, brute_classes, holds

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def found(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_op1(spark, table):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = found(spark, "op1_token_counts")
    assert got.keys() == table.keys()
    for i, r in table.items():
        n = len(lib.encode(r.text or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((r.text or "").encode()), n, n > 4096)


def test_op2(spark, table):
    got = found(spark, "op2_pii")
    assert got.keys() == table.keys()
    for i, r in table.items():
        spans = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, r.text or "") if holds(k, m[0])]
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in spans) for k in PATTERNS]
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[i].spans.startswith(said)
        assert got[i].n_spans == len(re.findall(r"\w+:\d+:\d+", got[i].spans)) == len(spans) + sum(got[i][f"n_{g}"] for g in ("secret", "number", "handle", "account"))


def test_op3(spark, table):
    got = found(spark, "op3_near_dedup")
    want = dict(brute_classes([(i, r.text) for i, r in table.items()]))
    assert {i: r.class_id for i, r in got.items()} == want
    sizes = {}
    for c in want.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert all(r.n_copies == sizes[r.class_id] for r in got.values())


def test_op4(spark, table):
    import base64

    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = found(spark, "op4_byte_bpe")
    assert got.keys() == table.keys()
    for i, r in table.items():
        ids = lib.encode_ordinary(r.text or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


def test_op6(spark, table):
    got = found(spark, "op6_sharding")
    assert {i: (r.size, r.text_crc32) for i, r in got.items()} == {i: (len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for i, r in table.items()}
    # rows in order of id get numbers; a shard and slot give the number back
    numbers = {i: n for n, i in enumerate(sorted(table))}
    for r in got.values():
        assert sharding.permute(np.array([r.slot * 40 + r.shard]), len(table), 20_240_601, inverse=True)[0] == numbers[r.doc_id]
    counts = [sum(r.shard == s for r in got.values()) for s in range(40)]
    assert max(counts) - min(counts) <= 1 and {r.law for r in got.values()} == {"rows"}


def test_op7(spark, table):
    got = found(spark, "op7_language_id")
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in table}
    langs, p = language_id.train(spark.read.parquet(f"{SF}/documents.parquet").where(~language_id.common.held_out()))
    pieces = language_id.Pieces(P.path("piece_bpe_32k.model"))
    place = {name: k for k, name in enumerate(pieces.names)}
    known = {}

    def word(w):
        if w not in known:
            m = language_id.MARK + w
            a = [np.ones(len(langs))]
            for end in range(1, len(m) + 1):
                a.append(sum((a[s] * p[place.get(m[s:end], -1)] for s in range(max(0, end - pieces.longest), end) if m[s:end] in place or end - s == 1), np.zeros(len(langs))))
            known[w] = np.log(a[-1])
        return known[w]

    for i, r in table.items():
        words = regex.findall(r"\p{L}+", (r.text or "").lower())
        assert got[i].held_out == held[i]
        if not words:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        log = sum(map(word, words)) / math.sqrt(len(words))
        share = np.exp(log - log.max())
        assert got[i].lang_pred == langs[int(share.argmax())] and math.isclose(got[i].score, share.max() / share.sum(), rel_tol=1e-6)


def test_op8(spark, table):
    got = found(spark, "op8_toxicity")
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where(~toxicity.common.held_out()))
    scorer = None if "constant" in model else toxicity.Scorer(model["lexicon"])
    for i, r in table.items():
        score = model["constant"] if scorer is None else float(np.interp(model["trees"].margin(np.array([scorer.features(r.text)])), *model["knots"])[0])
        assert math.isclose(got[i].score, score, abs_tol=1e-9) and got[i].predicted == (got[i].score >= 0.5) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_op9(spark):
    """The whole query on sf0.1 against all distances: recall, exact scores, order and ties."""
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in registry.QUERIES["op9_neighbours"](spark, d).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == [i for i in sorted(ids.tolist()) if i % 100 == 0]
    place, right = {int(i): k for k, i in enumerate(ids)}, 0
    for q, found in got.items():
        found.sort()
        dist = np.sqrt(((x - x[place[q]]) ** 2).sum(1))
        dist[place[q]] = np.inf
        assert [f[0] for f in found] == list(range(1, 11)) and [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        assert all(math.isclose(s, dist[place[v]], rel_tol=1e-12) for _, v, s in found)
        right += len({f[1] for f in found} & set(ids[np.lexsort((ids, dist))[:10]].tolist()))
    assert right / (10 * len(got)) >= 0.9


def test_toxicity_on_odd_tables(spark):
    """Nulls, very long and empty texts, repeated ids and rows, clashing names, too few labels."""
    rows = [(1, "you idiot scum " * 20000, 1, "x"), (1, "you idiot scum", 1, "x"), (2, "", 0, "y"), (3, None, 1, "z"), (None, "fine words", 0, None), (4, "fine words", None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, fold string").withColumns({"y": F.lit(1), "term": F.lit(2), "k0": F.lit(3), "a.b": F.lit(4)})
    model = toxicity.train(docs, docs)
    out = toxicity.score(docs, model)
    assert out.columns == [*docs.columns, "toxicity_score", "toxicity_predicted"]
    assert out.count() == len(rows) and out.where("toxicity_score IS NULL OR toxicity_score NOT BETWEEN 0 AND 1").count() == 0


def test_language_ties_long_words_and_odd_tables(spark):
    """Number signs are no letters; equal languages go to the first in order; a word of 20,000 letters is scored whole; extra columns of clashing names are not read."""
    rows = [(1, "the cat", "b"), (1, "the cat", "b"), (2, "the cat", "a"), (3, "x" * 20000, "a"), (3, "x" * 20000, "b"), (4, None, "a"), (None, "", None), (5, "1 2 ...", "a"), (6, "\u00bd \u00b2\u2460 \u2167 _", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"word": F.lit(1), "n": F.lit(2), "piece": F.lit(3), "lang_pred": F.lit("z"), "a.b": F.lit(4)})
    langs, p = language_id.train(docs.where("doc_id IS NULL OR doc_id < 5"))
    assert langs == ["a", "b"] and np.allclose(p[:, 0], p[:, 1])
    p[:, 1] = p[:, 0]
    got = [(r.doc_id, r.lang_pred, round(r.score, 6)) for r in language_id.identify(docs, (langs, p)).collect()]
    assert sorted(got, key=str) == sorted([(1, "a", 0.5), (1, "a", 0.5), (2, "a", 0.5), (3, "a", 0.5), (3, "a", 0.5), (4, "und", 0.0), (None, "und", 0.0), (5, "und", 0.0), (6, "und", 0.0)], key=str)


def test_sharding_of_rows_that_look_alike(spark):
    """A third of all rows alike, null ids, ids with two texts: counts at most one apart, slots gapless, sizes right."""
    rows = [(7, "same")] * 40 + [(None, "a"), (None, None), (7, "é"), (8, "")] + [(i, f"t{i}") for i in range(100, 170)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"size": F.lit(1), "_tie": F.lit(2), "row_no": F.lit(3), "_id": F.lit(4), "a.b": F.lit(5)}).repartition(4)
    got = sharding.shard_documents(docs, 6).collect()
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(6)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), len((t or "").encode()) + 16) for i, t in rows)
