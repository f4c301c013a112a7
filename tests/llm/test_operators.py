"""Operators on small tables with the hard cases, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from oracle import compare
from spindle.llm import byte_bpe, language_id, mixing, near_dedup, neighbours, pii, quality, registry, sharding, token_counts, toxicity

SF = "/root/testdata/sf0.001"
PROSE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twenty-one twenty-two"
ROWS = [
    (1, PROSE + " end", "en", "s0"),
    (2, PROSE + " fin", "en", "s0"),
    (3, PROSE + " end", None, None),
    (3, PROSE + " end", None, None),
    (4, "", "en", "s1"),
    (5, None, "en", "s1"),
    (None, "mail a@b.co, call +1 (234) 555-0199 or 10.0.0.256 10.0.0.255, 4111 1111 1111 1111", "de", "s1"),
    (7, "x" * 70000 + " \n" + "5" * 40000, "fr", ""),
]
CLASH = "doc_id long, text string, lang string, source string, n_tokens int, score string, `a.b` int, _key string, shard int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x", 2, "k", 3) for r in ROWS], CLASH).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


def test_map_operators_keep_every_row(docs, empty):
    for f in (token_counts.count_tokens, byte_bpe.encode_digest, byte_bpe.encode, quality.judge):
        assert f(docs).count() == len(ROWS)
        assert f(empty).count() == 0
    got = {r.doc_id: r for r in token_counts.count_tokens(docs).collect()}
    assert (got[5].n_bytes, got[5].n_tokens, got[7].over_limit) == (0, 0, True)
    e = {r.doc_id: r for r in byte_bpe.encode_digest(docs).collect()}
    assert e[5].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert all(e[r[0]].decoded_sha256 == hashlib.sha256((r[1] or "").encode()).hexdigest() for r in ROWS)


def test_sharding(docs, empty):
    rows = sharding.shard_documents(docs, 3).collect()
    assert sharding.shard_documents(empty).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(map(len, by.values())) == [2, 3, 3]
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    p = sharding.permute(np.array([r.row_no for r in rows]), len(rows), 20_240_601)
    assert [(r.shard, r.slot) for r in rows] == [(int(x) % 3, int(x) // 3) for x in p]


def test_near_dedup(docs, empty):
    got = sorted((r._id or 0, r.class_id, r.n_copies) for r in near_dedup.classes(docs).collect())
    assert got == [(0, None, 1), (1, 1, 4), (2, 1, 4), (3, 1, 4), (3, 1, 4), (4, 4, 1), (5, 5, 1), (7, 7, 1)]
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 7]
    assert near_dedup.classes(empty).count() == 0 and near_dedup.deduplicate(empty).count() == 0


def weighted(text):
    """The multiset of five-word shingles (all words, if fewer), by Python's own means."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    size = min(5, len(words))
    return Counter(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) if words else Counter()


def brute_classes(rows):
    """Least id of the class of every row (id, text), over all pairs of texts."""
    texts = sorted({t for _, t in rows if weighted(t)})
    sets = [weighted(t) for t in texts]
    sizes = [sum(s.values()) for s in sets]
    up = list(range(len(texts)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j]) and top(i) != top(j):
                both = sum(min(n, sets[j][e]) for e, n in sets[i].items() if e in sets[j])
                if both >= 0.8 * (sizes[i] + sizes[j] - both):
                    up[top(i)] = top(j)
    root = {t: top(k) for k, t in enumerate(texts)}
    least = {}
    for i, t in rows:
        if t in root and i is not None:
            least[root[t]] = min(i, least.get(root[t], i))
    return [(i, least.get(root[t]) if t in root else i) for i, t in rows]


def almost_copies(n, size, seed):
    """A group of n texts, most of them 0.6 to 0.9 similar to its first."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 400, size)]
    out = [" ".join(base)]
    for k in range(n - 1):
        words = list(base)
        for at in rng.integers(0, size, rng.integers(1, 4)):
            words[at] = f"x{seed}_{rng.integers(0, 40)}"
        if k % 5 == 0:
            words = words[: size - int(rng.integers(1, 8))]
        if k % 7 == 0:
            words += [f"y{k % 3}_{j}" for j in range(6)]
        out.append(" ".join(words))
    return out


def test_near_dedup_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for seed, (n, size) in enumerate([(120, 60), (80, 45), (60, 150)]):
        rows += [(10_000 * (seed + 1) + k, t) for k, t in enumerate(almost_copies(n, size, seed))]
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_classes(rows)
    assert sorted((r._id, r.class_id) for r in got) == sorted(want)
    assert len({c for i, c in want if i >= 10_000}) > 40


def test_near_dedup_ids_and_names(spark):
    """One id with two unrelated texts keeps both; copies of null ids keep one; columns named as the operator's own stay."""
    other = " ".join(f"word{k}" for k in range(40))
    rows = [(5, PROSE, 1), (5, other, 2), (None, other + " z", 3), (None, other + " z", 4), (None, "a b c", 5), (None, "a b c", 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, _row int").withColumn("class.id", F.lit("kept")).withColumn("KEY", F.lit(1))
    kept = near_dedup.deduplicate(table)
    assert kept.columns == table.columns
    assert sorted((r.doc_id or 0, r.text, r["class.id"]) for r in kept.collect()) == sorted([(5, PROSE, "kept"), (5, other, "kept"), (0, "a b c", "kept")])
    assert sorted(r._row for r in kept.collect()) == [1, 2, 5]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, m):
    d = re.sub(r"\D", "", m)
    luhn = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]


def test_pii_base_spans(spark, docs, empty):
    texts = [r[1] for r in ROWS] + ["a@b.c+d@e.f", "1.2.3.4.5", "\U0001f600é +1 (234) 555-0199 x", "a@b.co " * 300, "0" * 16]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.train(table)
    for r in pii.find(table, model).collect():
        want = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, r.text or "") if holds(k, m[0])]
        assert [tuple(s) for s in r.pii_base] == want
    assert pii.find(empty, model).count() == 0
    clean = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    assert clean[None] == "mail <EMAIL>, call <PHONE> or 10.0.0.256 <IP>, <CARD>" and clean[5] is None and clean[4] == ""


PLANTED = {
    "secret": ["use 9fK2mQ7xLw4Zt8Bv3Nc6Yp1R here", "with 5d8c0a7be14f92c36d0b8e7a51f4c29d now", 'api key: "Zk81mVq0Lr72TxB9cWn4"'],
    "number": ["call 0301 2345 6789 today", "phone (212) 555-0199 x", "fax: 089 1234 5678 bitte"],
    "handle": ["joe [at] example [dot] com", "write to ann.lee(at)mail(dot)org please", "contact: max [at] firma [dot] de"],
    "account": ["IBAN DE89 3704 0044 0532 0130 00 bitte", "pay NL91ABNA0417164300 now", "account FR14 2004 1010 0505 0001 3M02 606 x"],
}
PLAIN = ["look (at) this. But no", "order 4111111111111112 came", "the state-of-the-art-report-2024 is", "part AB12 3456 7890 fits", "on 2024-01-15 at"]


def test_pii_added_by_generator(spark):
    assert not {t for own in PLANTED.values() for t in own} & set(pii.SEEDS)
    model = pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = [(kind, t) for kind, own in PLANTED.items() for t in own] + [("none", t) for t in PLAIN]
    found = {kind: 0 for kind in PLANTED}
    for r in pii.find(spark.createDataFrame(rows, "kind string, text string"), model).collect():
        if r.kind == "none":
            assert not r.pii_added, r
        else:
            found[r.kind] += r.kind in {s.kind for s in r.pii_added}
    assert min(found.values()) >= 2, found


def test_language_id(spark, docs, empty):
    model = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()}
    assert got[4] == got[5] == ("und", 0.0) and got[1][0] in model[0]
    assert language_id.identify(docs, language_id.train(empty)).where("lang_pred != 'und'").count() == 0
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    model = language_id.train(table.where("not held"))
    right = language_id.identify(table.where("held"), model).join(table, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95


def test_language_id_learns_from_every_distinct_text(spark):
    """A language of two rows in 24,002, and a text that is a third of all rows, at a size where rows were once sampled."""
    rows = [(f"the cat sat on mat {i}", "en") for i in range(16000)] + [("zebra zebra zebra", "en")] * 8000
    table = spark.createDataFrame([*rows, ("der Hund schläft", "de"), ("und die Katze nicht", "de")], "text string, lang string").repartition(4)
    once = spark.createDataFrame([*dict.fromkeys(rows), ("der Hund schläft", "de"), ("und die Katze nicht", "de")], "text string, lang string")
    langs, p = language_id.train(table)
    assert langs == ["de", "en"]
    assert np.allclose(p, language_id.train(once)[1], rtol=1e-9)


def test_toxicity(spark, docs, empty):
    d = "/root/testdata/sf0.01"
    table, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.train(table, labels.where(~held))
    out = toxicity.score(table.where(held), model).join(labels, "doc_id")
    assert out.agg(F.avg((F.col("toxic") == F.col("toxicity_predicted")).cast("int"))).first()[0] > 0.9
    assert toxicity.score(docs, model).columns == [*docs.columns, "toxicity_score", "toxicity_predicted"]
    assert toxicity.score(docs, model).count() == len(ROWS) and toxicity.score(empty, model).count() == 0
    assert toxicity.train(table, labels.limit(0)) == {"constant": 0.0}


def size_class(n):
    return int(4 * math.log2(n)) if n else 0


def plain_bands(texts):
    """Length class -> band, from the texts that teach: the quantiles' values are those at ranks ceil(q n), one at the least."""
    by = {}
    for t in texts:
        raw = t.encode()
        by.setdefault(size_class(len(raw)), []).append(len(raw) / len(zstandard.ZstdCompressor(level=3).compress(raw)))
    out = {}
    for k, own in by.items():
        own.sort()
        n, (low, high) = len(own), next((lo, hi) for most, lo, hi in quality.BANDS if 2 ** (k / 4) < most)
        a, b = (own[max(1, math.ceil(q * n)) - 1] for q in (0.002, 0.998))
        out[k] = (max(low, a * (0.97 - 0.5 / n)), min(high, b * (1.03 + 0.5 / n)))
    return out


def plain_verdict(text, failed, bands):
    raw = text.encode()
    if not raw:
        return False, 0.0
    ratio = lambda x: len(x) / len(zstandard.ZstdCompressor(level=3).compress(x))
    low, high = next((lo, hi) for most, lo, hi in quality.BANDS if len(raw) < most)
    own = bands.get(size_class(len(raw)), (low, high))
    chunks = [raw[k : k + 4096] for k in range(0, len(raw), 4096)]
    if len(chunks) > 1 and len(chunks[-1]) < 2048:
        chunks[-2:] = [chunks[-2] + chunks[-1]]
    bad = sum(len(c) for c in chunks if not 1.7 <= ratio(c) <= 6.0) if len(raw) > 4096 else 0
    return not failed and max(low, own[0]) <= ratio(raw) <= min(high, own[1]) and bad <= 0.25 * len(raw), round(ratio(raw), 9)


def test_quality_bands_do_not_jump(spark):
    """One labelled text more moves a band by little, at every number of texts."""
    rows = [(k, " ".join(f"word{(k * 7 + j * j) % 997}" for j in range(70)), 1) for k in range(60)]
    last = None
    for n in (1, 2, 20, 49, 50, 51, 60):
        df = spark.createDataFrame(rows[:n], "doc_id long, text string, quality int")
        (band,) = set(quality.fit(df, df).values())
        fixed = quality.fixed_band(len(rows[0][1]))
        assert fixed[0] <= band[0] <= band[1] <= fixed[1]
        if last:
            assert all(abs(a - b) < (0.01 if n - last[0] == 1 and n > 40 else 1.5) for a, b in zip(band, last[1]))
        last = (n, band)


def test_quality_against_plain_counts(spark, docs, empty):
    """The whole query's base columns on sf0.001 by brute force, learned bands, and hard rows."""
    got = {r.doc_id: r for r in registry.QUERIES["op5_quality"](spark, SF).collect()}
    table = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(table)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1 and zlib.crc32(str(r.doc_id).encode()) % 5}
    bands = plain_bands([r.text for r in table if r.doc_id in good and r.text is not None and not got[r.doc_id].base_failed])
    for r in table:
        t, g = r.text or "", got[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        inside = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
            seen.add(line)
        failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(inside), failed)
        assert (g.kept, round(g.ratio, 9)) == plain_verdict(t, failed, bands), r.doc_id
    assert bands and quality.judge(empty).count() == 0 and quality.fit(docs, empty.select("doc_id", F.lit(1).alias("quality"))) == {}


def test_quality_learns_from_every_labelled_text(spark):
    """More labelled good texts than 20,000, the bound before: bands are the exact quantiles of all, in every class."""
    rng = np.random.default_rng(5)
    words = np.array([f"w{j:x}" for j in range(4000)])
    texts = [" ".join(words[rng.integers(0, rng.integers(30, 4000), 60 if k % 400 else 60 + 20 * (k // 400))]) for k in range(24_000)]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, quality int").repartition(8)
    want, got = plain_bands(texts), quality.fit(df, df)
    assert len(want) > 8 and sorted(got) == sorted(want)
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_learned_bands_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    table, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    bands = quality.fit(table, labels.where(~held))
    assert len(bands) > 8
    found = quality.judge(table.where(held), bands).join(labels, "doc_id").where("NOT base_failed")
    share = {r.quality: (r.n, r.kept) for r in found.groupBy("quality").agg(F.count("*").alias("n"), F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1][1] > 0.98 and share[0][1] < 0.5, share


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[5:60] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 16), (1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.search(table, table.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 900, 50))
    right = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        true = np.lexsort((np.arange(900), d))[:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert all(np.isclose(s, d[v], rtol=1e-12) for _, v, s in found)
        right += len(set(true) & {v for _, v, _ in found})
    assert right / (10 * len(got)) >= 0.9
    assert neighbours.search(table.limit(0), table.limit(0)).count() == 0
    assert neighbours.search(table, table.limit(0)).count() == 0
    clash = table.where("vec_id < 300 OR vec_id IS NULL").withColumns({"id": F.lit(1), "pivot": F.lit(2), "a.b": F.lit(3), "v": F.lit(4), "rank": F.lit(5)})
    assert neighbours.search(clash, clash.where("vec_id % 100 = 0")).count() == 30


def test_neighbours_of_few_and_of_many_copies(spark):
    """Fewer candidates than asked for; a vector with very many copies, repeated ids among them: exact, ties to the smaller id."""
    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, neighbours.search(few, few).collect()))
    want = [(q, k + 1, v, float(abs(q - v))) for q in range(5) for k, v in enumerate(sorted((v for v in range(5) if v != q), key=lambda v: (abs(q - v), v)))]
    assert got == want
    rng = np.random.default_rng(2)
    rows = [(i, [1.0] * 8) for i in range(500)] + [(0, [1.0] * 8)] * 40 + [(1000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 8)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(table, table.where("vec_id IN (0, 300, 1003)")).collect())
    assert [r[2:] for r in got[:10]] == [(v, 0.0) for v in range(1, 11)]
    assert [r[2:] for r in got[10:20]] == [(0, 0.0)] * 10
    assert len(got) == 30


@pytest.mark.parametrize("clusters", [40, 8])
def test_neighbours_in_clusters_read_few_files(spark, clusters):
    """Clustered vectors: under a third of the entries stand in files that are read, and nearly all true neighbours are found."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(clusters, 1, 16)) * 5 + rng.normal(size=(clusters, 4000 // clusters, 16)) / 4).reshape(-1, 16).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    rows = neighbours.usable(table, "vec_id", "embedding")
    ids, sample = neighbours.sampled(rows)
    p = neighbours.pivots(sample)
    index, reach = neighbours.blocks(neighbours.posted(rows, p, 3, 48, "<f4"), len(p), neighbours.BLOCK, "v")
    bound = (reach, lambda i, v: neighbours.within(i, v, ids, sample, 10))
    read = {b: neighbours.posted(rows.where("id % 50 = 0"), p, 80, 80, "<f4", own).groupBy("pivot").count() for b, own in ((True, bound), (False, None))}
    held = index.groupBy("pivot").agg(F.sum(F.octet_length("v_ids") / 8).alias("n"))
    looked = {b: r.join(held, "pivot").agg(F.sum(F.col("count") * F.col("n"))).first()[0] / (80 * 4000 * 3) for b, r in read.items()}
    assert looked[True] < 0.2 < 0.25 < looked[False], looked
    right = 0
    found = neighbours.search(table, table.where("vec_id % 50 = 0")).collect()
    for q in range(0, 4000, 50):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        assert all(neighbours.within(np.array([q]), x[q : q + 1].astype(float), ids, sample, 10) >= np.sort(d)[9])
        right += len(set(np.lexsort((np.arange(4000), d))[:10].tolist()) & {r.vec_id for r in found if r.query_id == q})
    assert right >= 0.97 * 800


def test_neighbours_beside_a_dense_cluster(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2400, 24)).astype(np.float32)
    x[:900] = x[0] + rng.normal(size=(900, 24)).astype(np.float32) / 50
    x[900:1200] = x[900]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    right, asked = 0, list(range(1200, 2400, 50))
    found = neighbours.search(table, table.where("vec_id >= 1200 AND vec_id % 50 = 0")).collect()
    for q in asked:
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        right += len(set(np.lexsort((np.arange(2400), d))[:10]) & {r.vec_id for r in found if r.query_id == q})
    assert right / (10 * len(asked)) >= 0.9


def test_mixing(spark, docs, empty):
    assert compare(spark, "op10_mixing", registry.QUERIES["op10_mixing"], registry.ORACLE_SQL["op10_mixing"], SF) > 0
    out = mixing.mix(docs, weights={"s0": 1.0}, size=40.0)
    assert {r.source for r in out.select("source").distinct().collect()} == {"s0"} and 200 < out.count() < 450
    assert mixing.mix(docs, size=20.0).where("source IS NULL").count() > 0
    # a null source has no weight, one that is given in vain changes nothing, none at all gives no rows
    named = mixing.mix(docs, weights={"s0": 1.0, "s1": 3.0, "": 0.5, "none": 9.0}, size=30.0)
    assert {r.source for r in named.select("source").distinct().collect()} == {"s0", "s1", ""}
    assert mixing.mix(docs, weights={}, size=30.0).count() == 0
    clash = docs.withColumns({"rate": F.lit("r"), "MIX_KEY": F.lit(1), "_source": F.lit(2)})
    assert sorted(mixing.mix(clash, weights={"s0": 1.0}, size=40.0, keep=clash.columns, added=()).columns) == sorted(clash.columns)
    assert mixing.mix(empty).count() == 0
    mixing.BROADCAST_CELLS, old = 0, mixing.BROADCAST_CELLS
    try:
        assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == sorted(map(tuple, _broadcast(docs, old)), key=str)
    finally:
        mixing.BROADCAST_CELLS = old


def _broadcast(docs, cells):
    low, mixing.BROADCAST_CELLS = mixing.BROADCAST_CELLS, cells
    try:
        return mixing.mix(docs).collect()
    finally:
        mixing.BROADCAST_CELLS = low
