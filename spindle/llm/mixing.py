"""Mixing sources to target weights by Poisson replication (operator 10).

The rate of a source is its target number of rows over its rows. A document's
count is the Poisson quantile, at its source's rate, of a uniform number hashed
from seed and id: the first k whose distribution function exceeds it. Each
document is exploded by its count, and the copies are put in the order of a
second hash. As that is uniform, equal ranges of it are equal shares of the
output: each copy's partition is computed, no sample of the rows is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The rates are broadcast if they (a source's name and numbers) fill no more than so
#: many cells of 8 bytes (16 MB); else the documents are joined to them, salted.
BROADCAST_CELLS = 2_000_000
SALTS = 64
ALPHA = 0.5
#: Bits of mix_key.
ORDER_BITS = 60
ADDED = ("rate", "n_copies", "copy", "mix_key")


def _hex(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10)


def source_rates(df: DataFrame, source_col: str, weights: dict[str, float] | None, alpha: float, size: float) -> DataFrame:
    """_source, _null, _rate: one row for each source."""
    source = common.quoted(source_col)
    counts = df.groupBy(F.coalesce(source.cast("string"), F.lit("")).alias("_source"), source.isNull().alias("_null")).agg(F.count("*").alias("_n"))
    if weights is None:
        counts = counts.withColumn("_w", F.pow(F.col("_n").cast("double"), F.lit(float(alpha))))
    else:
        given = df.sparkSession.createDataFrame([(name, float(w)) for name, w in sorted(weights.items())], "_source string, _given double").withColumn("_null", F.lit(False))
        counts = counts.join(given, ["_source", "_null"], "left").select("_source", "_null", "_n", F.coalesce("_given", F.lit(0.0)).alias("_w"))
    counts = common.saved(counts)
    total = counts.agg(F.sum("_w").alias("_all_w"), F.sum("_n").alias("_all_n")).first()
    if not total["_all_w"]:
        return counts.select("_source", "_null", F.lit(0.0).alias("_rate"))
    rate = F.lit(total["_all_n"]) * float(size) * F.col("_w") / F.lit(total["_all_w"]) / F.col("_n")
    return counts.select("_source", "_null", rate.alias("_rate"))


def poisson_quantile(u: Column, rate: Column) -> Column:
    """The number of k whose distribution function at this rate is at most u; about `rate` steps, and nothing is kept of them."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.lit(0).alias("n"), (-rate).alias("log_p"), F.lit(0.0).alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.when(k > 0, F.log(rate / F.greatest(k, F.lit(1)))).otherwise(0.0)
        below = acc["sum"] + F.exp(log_p)
        # past the quantile the state stays as it is
        return F.when(acc["n"] < k, acc).otherwise(F.struct((acc["n"] + (below <= u).cast("int")).alias("n"), log_p.alias("log_p"), below.alias("sum")))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(0), last), start, step, lambda acc: acc["n"])).otherwise(0)


def mix(df: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, size: float = 1.0, seed: int = 11, id_col: str = "doc_id", source_col: str = "source", keep: list[str] | None = None, added: tuple[str, ...] = ADDED) -> DataFrame:
    """Each row repeated by its Poisson count, in a global hash order: partition after partition, sorted within.

    weights: target weight of each source (others 0); None: rows to the power
    alpha. size: expected rows of the result over those of df. Returns `keep`
    (id and source, if not given) and `added` of rate, n_copies, copy (from 0)
    and mix_key; where a kept column has the name of an added one, only the
    kept one is returned. A null source is a source of its own; a null id
    hashes as its own value; null, empty and very long texts are carried whole;
    rows of equal id get equal counts; copies of equal mix_key stand by copy;
    an empty table gives no rows.
    """
    spark = df.sparkSession
    keep = list(dict.fromkeys(keep or [id_col, source_col]))
    rates = common.saved(source_rates(df, source_col, weights, alpha, size))
    cells = rates.agg(F.sum(F.octet_length("_source") / 8 + 8)).first()[0] or 0
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(common.quoted(id_col).cast("string"), F.lit("null")))
    rows = df.select(
        *(common.quoted(c).alias(f"_k{i}") for i, c in enumerate(keep)),
        key.alias("_key"),
        F.coalesce(common.quoted(source_col).cast("string"), F.lit("")).alias("_source"),
        common.quoted(source_col).isNull().alias("_null"),
    )
    if cells <= BROADCAST_CELLS:
        joined = rows.join(F.broadcast(rates), ["_source", "_null"])
    else:
        salt = F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")
        copies = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("_salt", salt).join(copies, ["_source", "_null", "_salt"])
    u = _hex(F.concat_ws(":", F.lit("count"), "_key"), 13).cast("double") / float(1 << 52)
    counted = joined.withColumn("_u", u).withColumn("n_copies", poisson_quantile(F.col("_u"), F.col("_rate")))
    copies = counted.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    mixed = copies.withColumn("mix_key", _hex(F.concat_ws(":", F.lit("order"), "_key", F.col("copy").cast("string")), ORDER_BITS // 4).cast("long"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.col("mix_key") / (float(1 << ORDER_BITS) / parts)).cast("int")
    placed = mixed.withColumnRenamed("_rate", "rate").repartitionById(parts, F.least(part, F.lit(parts - 1))).sortWithinPartitions("mix_key", "copy")
    return placed.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), *(c for c in added if c not in keep))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 9))


OP10_SQL = """
WITH n AS (SELECT coalesce(source, '') AS s, source IS NULL AS z, count(*) AS n FROM documents GROUP BY 1, 2),
t AS (SELECT sum(sqrt(n)) AS w, sum(n) AS n FROM n),
r AS (SELECT s, z, t.n * sqrt(n.n) / t.w / n.n AS rate FROM n, t),
p AS (SELECT s, z, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY s, z ORDER BY k) AS f
      FROM (SELECT s, z, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM r)),
d AS (SELECT doc_id, source, coalesce(source, '') AS s, source IS NULL AS z, '11:' || coalesce(CAST(doc_id AS VARCHAR), 'null') AS key FROM documents),
u AS (SELECT *, CAST(('0x' || substr(md5('count:' || key), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u FROM d),
c AS (SELECT u.doc_id, u.source, u.key, p.rate, CAST(sum(CASE WHEN p.f <= u.u THEN 1 ELSE 0 END) AS INTEGER) AS n_copies
      FROM u JOIN p ON u.s = p.s AND u.z = p.z GROUP BY ALL),
e AS (SELECT doc_id, source, key, rate, n_copies, CAST(unnest(range(0, n_copies)) AS INTEGER) AS copy FROM c)
SELECT doc_id, source, round(rate, 9) AS rate, n_copies, copy,
       CAST(('0x' || substr(md5('order:' || key || ':' || CAST(copy AS VARCHAR)), 1, 15)) AS BIGINT) AS mix_key FROM e
"""
