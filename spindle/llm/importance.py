"""Importance resampling towards a target distribution (operator 12).

Hashed word features of all documents and of all target texts give each of a
fixed number of buckets a gain, the logarithm of how much more frequent it is in
the target. An array of gains scores a document by its buckets; with seeded
Gumbel noise added, the highest scores are a sample. The scores are persisted;
bisection finds the least score drawn, by jobs that count exactly how many
scores reach a number, then the greatest id drawn among ties. The drawn rows
are range-partitioned, which gives their ranks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.operators.order import numbered

from . import common

BUCKETS, SCALE, SEED = 10_000, 1000, 2024
#: Words that a document needs to be drawn, and the percentage of those that is.
LEAST_WORDS, PERCENT = 20, 10
#: Halvings of one counting job: it counts at 2^HALVINGS - 1 numbers.
HALVINGS = 4
_GREATEST = (1 << 63) - 1
#: A to Z to small letters; every sign of ASCII but digits and letters to a space. Bytes of other characters stay.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """UTF-8 bytes of the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text, A to Z lower-cased; null: none."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def features(text: str | None, longest: int = 1) -> list[bytes]:
    """All runs of 1 to `longest` consecutive words, joined by a space."""
    own = words(text)
    out = list(own)
    for n in range(2, longest + 1):
        out += map(b" ".join, zip(*(own[k:] for k in range(n)), strict=False))
    return out


def buckets(text: str | None, n_buckets: int = BUCKETS, longest: int = 1) -> np.ndarray:
    own = features(text, longest)
    return np.fromiter(map(zlib.crc32, own), np.int64, len(own)) % n_buckets


def counted(df: DataFrame, text_col: str = "text", n_buckets: int = BUCKETS, longest: int = 1) -> np.ndarray:
    """Features of all texts in each bucket: each task adds up its own, Spark the tasks'; the driver gets a row for each bucket."""
    common.ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for b in common.slices(batch):
                for text in b.column(0).to_pylist():
                    total += np.bincount(buckets(text, n_buckets, longest), minlength=n_buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    out = np.zeros(n_buckets, np.int64)
    for r in common.only(df, text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Of each bucket floor(scale * ln of its smoothed share in the target over that in the source)."""
    n = len(source)
    s, t = float(source.sum()), float(target.sum())
    return np.array([math.floor(scale * math.log((y + 1.0) * (s + n) / ((x + 1.0) * (t + n)))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(id_col: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """Gumbel noise from the id's digest, floor(scale * it); a null id counts as empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-float(scale) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def scored(df: DataFrame, table: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """_id, n_words, n_features, weight, score of every row; map only."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> dict:
        n_words, sizes, weights = [], [], []
        for text in b.column(1).to_pylist():
            own = buckets(text, len(table), longest)
            sizes.append(len(own))
            n_words.append(len(own) if longest == 1 else len(words(text)))
            weights.append(int(table[own].sum()))
        return {"_id": b.column(0), "n_words": pa.array(n_words, pa.int64()), "n_features": pa.array(sizes, pa.int64()), "weight": pa.array(weights, pa.int64())}

    out = common.map_batches(common.only(df, id_col, text_col), run, f"_id {kind}, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + noise(F.col("_id"), seed, scale))


def least_reaching(df: DataFrame, value: str, n: int) -> int:
    """The least number that n rows or more of df, which has as many, do not exceed: by bisection, each job counting exactly at several numbers."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    while low < high:
        steps = min(high - low, (1 << HALVINGS) - 1)
        at = sorted({low + (high - low) * k // (steps + 1) for k in range(1, steps + 1)} | {low})
        counts = df.agg(*(F.count_if(F.col(value) <= x).alias(f"n{k}") for k, x in enumerate(at))).first()
        enough = [x for x, c in zip(at, counts, strict=True) if c >= n]
        short = [x for x, c in zip(at, counts, strict=True) if c < n]
        high = enough[0] if enough else high
        low = short[-1] + 1 if short else low
    return low


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, n_buckets: int = BUCKETS, longest: int = 1, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """_id, n_features, weight, score and rank of every row; rank is null but for the drawn ones.

    Of the rows with least_words words or more the highest scores are drawn,
    floor(percent / 100 of them); ties go to the smaller id, null ids last; of rows
    alike in score and id it is open which are drawn, but as many as are due.
    Null and empty texts have no feature, weight 0, and are never drawn while
    least_words is above 0; very long ones are scored whole; repeated rows count each. An empty target gives gains all the same
    (smoothed), an empty table no rows. Only the named columns are read, so no
    other can clash. Ids are whole numbers.
    """
    table = gains(counted(df, text_col, n_buckets, longest), counted(target, target_col, n_buckets, longest), scale)
    all_rows = common.saved(scored(df, table, id_col, text_col, longest, seed, scale))
    able = all_rows.where(F.col("n_words") >= least_words).select((-F.col("score")).alias("falling"), F.coalesce(F.col("_id").cast("long"), F.lit(_GREATEST)).alias("id"))
    due = percent * able.count() // 100
    none = F.lit(None).cast("long").alias("rank")
    names = ("_id", "n_features", "weight", "score")
    if not due:
        return all_rows.select(*names, none)
    cut = -least_reaching(able, "falling", due)
    tied = able.where(F.col("falling") == -cut)
    above = able.where(F.col("falling") < -cut).count()
    last = least_reaching(tied, "id", due - above)
    key = F.coalesce(F.col("_id").cast("long"), F.lit(_GREATEST))
    drawn = (F.col("n_words") >= least_words) & ((F.col("score") > cut) | ((F.col("score") == cut) & (key <= last)))
    ranked, _ = numbered(all_rows.where(drawn).select(*names), [F.col("score").desc(), F.col("_id").asc_nulls_last()], "rank")
    # only rows alike in score and id can be more than are due
    ranked = ranked.select(*names, F.when(F.col("rank") < due, F.col("rank") + 1).alias("rank"))
    return ranked.unionByName(all_rows.where(~drawn).select(*names, none))


def op12_importance(spark, sf_dir: str) -> DataFrame:
    out = resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select(F.col("_id").alias("doc_id"), "n_features", "weight", "score", "rank")


# the CRC of a byte, by the reversed polynomial; words of both tables, each hashed once
_CRC = "WITH RECURSIVE z(b, n, c) AS (SELECT b, 0, CAST(b AS BIGINT) FROM range(256) r(b) UNION ALL SELECT b, n + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM z WHERE n < 8), crc AS (SELECT list(c ORDER BY b) AS tbl FROM z WHERE n = 8)"
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP12_SQL = rf"""{_CRC}, d AS (SELECT doc_id, {_WORDS} AS w FROM documents), q AS (SELECT {_WORDS} AS w FROM benchmark),
f AS (SELECT doc_id, unnest(w) AS w FROM d), g AS (SELECT unnest(w) AS w FROM q),
h AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM f UNION SELECT w FROM g)),
b AS (SELECT w, xor(list_reduce(list_transform(range(1, length(x) + 1, 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT)), lambda c, o: xor(c >> 8, tbl[CAST(xor(c & 255, o) AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % {BUCKETS} AS bucket FROM h, crc),
s AS (SELECT bucket, count(*) AS s FROM f JOIN b USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM g JOIN b USING (w) GROUP BY 1),
gain AS (SELECT r.bucket, CAST(floor({SCALE} * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM f) + {BUCKETS}.0::DOUBLE) / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM g) + {BUCKETS}.0::DOUBLE)))) AS BIGINT) AS gain FROM range({BUCKETS}) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
v AS (SELECT doc_id, sum(gain) AS weight FROM f JOIN b USING (w) JOIN gain USING (bucket) GROUP BY 1),
a AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN v USING (doc_id)),
c AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-{SCALE}.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM a),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM c WHERE n_features >= {LEAST_WORDS})
SELECT c.doc_id, n_features, weight, score, CAST(rank AS BIGINT) AS rank FROM c LEFT JOIN o ON c.doc_id = o.doc_id AND rank <= {PERCENT} * n // 100"""
