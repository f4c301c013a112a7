"""Toxicity by gradient-boosted trees over dense features (operator 8).

The features of a text: density, count and variety of lexicon terms, their
nearness to second persons, capitals, punctuation, exclamation and obfuscation
rates. The lexicon is learned: whole words and word beginnings that occur in
many more toxic than clean training texts. Training rows are dealt to folds by
their text: a row's features come from the lexicon of the other folds, as a new
text's do, and isotonic regression calibrates the margins that trees of the
other folds give it.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boosting, common

#: Labelled rows that are learned from, at most (those with the smallest hashes of their ids).
TRAIN_ROWS = 20_000
LEXICON = 2000
LEAST_WEIGHT = 3.0
#: Twice the log likelihood ratio that a term needs: of thousands of terms, some stand in a few toxic texts by chance.
EVIDENCE = 20.0
FOLDS = 4
BEGINNINGS = (4, 5, 6)
REMEMBERED = 200_000
WORDS = re.compile(r"\w+")
HIDDEN = re.compile(r"\w[@$!|*.\-_0-9]+\w[\w@$!|*.\-]*")
LETTER_RUNS = re.compile(r"\b\w(?:[ .\-_*]\w){2,}\b")
MARKS = re.compile(r"[!?.,;:'\"()*#&%$-]")
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
#: Signs that stand for letters
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
N_FEATURES = 11


def _terms(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


class Scorer:
    """Features of texts for one lexicon (term -> weight)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.weight = lexicon, {}

    def of_word(self, word: str) -> float:
        w = self.weight.get(word)
        if w is None:
            if len(self.weight) >= REMEMBERED:
                self.weight.clear()
            w = self.weight[word] = max((self.lexicon.get(t, 0.0) for t in _terms(word)), default=0.0)
        return w

    def features(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * N_FEATURES
        low = text.lower()
        words = WORDS.findall(low)
        n = max(1, len(words))
        of = self.of_word
        weights = [of(w) for w in words]
        hits = [i for i, w in enumerate(weights) if w]
        near = 0
        if hits:
            person = [i for i, w in enumerate(words) if w in SECOND_PERSON]
            if person:
                at = np.array(person)
                own = np.array(hits)
                k = np.searchsorted(at, own)
                gap = np.minimum(np.abs(own - at[np.minimum(k, len(at) - 1)]), np.abs(own - at[np.maximum(k - 1, 0)]))
                near = int((gap <= 5).sum())
        hidden = 0
        masked = HIDDEN.findall(low)
        for m in masked:
            plain = m.translate(LEET)
            if of(re.sub(r"\W|_", "", plain)) or of(re.sub(r"[\W_\d]", "", m)):
                hidden += 1
        runs = LETTER_RUNS.findall(low)
        hidden += sum(bool(of(re.sub(r"[\W_]", "", r))) for r in runs)
        letters = max(1, sum(map(len, words)))
        capitals = sum(map(str.isupper, text)) if not text.islower() else 0
        total = sum(weights)
        return [
            total / n,
            float(len(hits)),
            float(len({words[i] for i in hits})),
            max(weights, default=0.0),
            near / max(1, len(hits)),
            capitals / letters,
            low.count("!") / n,
            len(MARKS.findall(low)) / n,
            len(masked) / n,
            float(hidden),
            math.log1p(n),
        ]


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """id, y, text, fold of up to so many labelled ids, saved; an id labelled twice counts as its greatest label, one with two texts has its least."""
    small = (
        labels.select(common.quoted(id_col).alias("id"), common.quoted(label_col).cast("int").alias("y"))
        .where("id IS NOT NULL AND y IS NOT NULL")
        .groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(rows)
    )
    joined = docs.select(common.quoted(id_col).alias("id"), common.quoted(text_col).alias("text")).join(F.broadcast(small), "id").where("text IS NOT NULL")
    one = joined.groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    return common.saved(one.withColumn("fold", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(FOLDS)).cast("int")))


def _lexicon(counts: DataFrame, sizes: dict, without: int | None) -> dict[str, float]:
    """term -> weight, from all folds but one."""
    own = [k for k in range(FOLDS) if k != without]
    n1, n0 = (sum(sizes.get((k, y), 0) for k in own) for y in (1, 0))
    if not n1 or not n0:
        return {}
    said = counts.select("term", *(sum((F.col(f"n{y}_{k}") for k in own), F.lit(0)).alias(f"n{y}") for y in (1, 0)))
    least = max(3, round(n1 * 0.004))
    weight = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
    part = lambda n, all_: F.when(n > 0, n * F.log(n / ((F.col("n1") + F.col("n0")) * float(all_ / (n1 + n0))))).otherwise(0.0)
    evidence = 2 * (part(F.col("n1"), n1) + part(F.col("n0"), n0))
    found = said.where(F.col("n1") >= least).withColumn("w", weight).where((F.col("w") >= LEAST_WEIGHT) & (evidence >= EVIDENCE)).orderBy(F.col("n1").desc(), "term").limit(LEXICON)
    return {r["term"]: float(r["w"]) for r in found.collect()}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> dict:
    """Lexicon, trees and calibration, learned from at most train_rows labelled ids.

    Null ids, texts and labels teach nothing; repeated ids teach once. Without
    both labels among the training rows the model gives their mean (0 if there
    are none). Only the named columns are read, so no other can clash.
    """
    rows = training_rows(docs, labels, id_col, text_col, label_col, train_rows)
    sizes = {(r["fold"], r["y"]): r["n"] for r in rows.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    labels_seen = {y for _, y in sizes}
    if labels_seen != {0, 1}:
        return {"constant": float(1 in labels_seen)}

    def terms(b: pa.RecordBatch) -> dict:
        found: Counter = Counter()
        for y, fold, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            words = set(WORDS.findall(text.lower()))
            found.update((t, y, fold) for t in {t for w in words for t in _terms(w)})
        keys = list(found)
        return {"term": pa.array([k[0] for k in keys], pa.string()), "y": pa.array([k[1] for k in keys], pa.int32()), "fold": pa.array([k[2] for k in keys], pa.int32()), "n": pa.array(list(found.values()), pa.int64())}

    in_cell = lambda y, k: F.sum(F.when((F.col("y") == y) & (F.col("fold") == k), F.col("n")).otherwise(0)).alias(f"n{y}_{k}")
    said = common.map_batches(rows.select("y", "fold", "text"), terms, "term string, y int, fold int, n long", whole=True)
    counts = common.saved(said.groupBy("term").agg(*(in_cell(y, k) for y in (0, 1) for k in range(FOLDS))).where(sum((F.col(f"n1_{k}") for k in range(FOLDS)), F.lit(0)) >= 3))
    lexicon = _lexicon(counts, sizes, None)
    others = [_lexicon(counts, sizes, k) for k in range(FOLDS)]

    def features(b: pa.RecordBatch) -> dict:
        scorers = [Scorer(x) for x in others]
        x = np.array([scorers[k].features(t) for k, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)])
        return {"y": b.column(0), "fold": b.column(1)} | {f"f{j}": pa.array(x[:, j]) for j in range(N_FEATURES)}

    table = common.map_batches(rows.select("y", "fold", "text"), features, "y int, fold int, " + ", ".join(f"f{j} double" for j in range(N_FEATURES))).toPandas()
    common.dropped(counts, rows)
    table = table.sort_values(list(table.columns))  # the trees don't depend on the order in which rows arrive
    x, y, fold = table[[f"f{j}" for j in range(N_FEATURES)]].to_numpy(), table["y"].to_numpy(float), table["fold"].to_numpy()
    margin = np.empty(len(y))
    for k in set(fold.tolist()):
        own = fold != k if (fold != k).any() else fold == k
        margin[fold == k] = boosting.fit(x[own], y[own], np.ones(own.sum())).margin(x[fold == k])
    return {"lexicon": lexicon, "trees": boosting.fit(x, y, np.ones(len(y))), "knots": boosting.isotonic(margin, y, np.ones(len(y)))}


def score(df: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("toxicity_score", "toxicity_predicted")) -> DataFrame:
    """df's columns `keep` (all, if not given) with a score in 0..1 and its prediction, named by `names`; map only.

    A null or empty text has all features 0 and is scored as such; a very long
    one is scored whole. Nulls in other columns, repeated rows and extra
    columns of any name pass through; columns named as the two results are
    replaced; ties do not arise; an empty table gives no rows.
    """
    keep = [c for c in keep or df.columns if c not in names]
    sent = [*keep, *([] if text_col in keep else [text_col])]  # the text goes to the workers once
    inner = df.select(*(common.quoted(c).alias(f"k{i}") for i, c in enumerate(sent)))
    at = sent.index(text_col)

    def run(b: pa.RecordBatch) -> dict:
        texts = b.column(at).to_pylist()
        if "constant" in model:
            s = np.full(len(texts), model["constant"])
        else:
            scorer = _scorer(model["lexicon"])
            s = np.interp(model["trees"].margin(np.array([scorer.features(t) for t in texts])), *model["knots"])
        return {f"k{i}": b.column(i) for i in range(len(keep))} | {"s": pa.array(s, pa.float64()), "p": pa.array((s >= 0.5).astype(np.int32), pa.int32())}

    schema = T.StructType([*inner.schema.fields[: len(keep)], T.StructField("s", T.DoubleType()), T.StructField("p", T.IntegerType())])
    out = common.map_batches(inner, run, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("s").alias(names[0]), F.col("p").alias(names[1]))


_memory: list = []


def _scorer(lexicon: dict[str, float]) -> Scorer:
    if not _memory or _memory[0].lexicon != lexicon:
        _memory[:] = [Scorer(lexicon)]
    return _memory[0]


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~common.held_out()))
    out = score(docs, model, keep=["doc_id"])
    return out.select("doc_id", common.held_out().alias("held_out"), F.col("toxicity_score").alias("score"), F.col("toxicity_predicted").alias("predicted"))
