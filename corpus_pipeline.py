"""A training corpus from documents: five stages, each over all that the one before kept.

toxicity -> near duplicates -> personal data -> mixing -> byte-level BPE. Each
stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm import byte_bpe, common, mixing, near_dedup, pii, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones, does not call toxic.

    Null and empty texts are scored by their features, all 0; nulls elsewhere
    and repeated rows pass through; columns of any name stay as they are; an
    empty table gives no rows.
    """
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    score, toxic = common.private(docs, "toxicity_score", "toxicity_predicted")
    scored = toxicity.score(docs, model, names=(score, toxic))
    return scored.where(F.col(toxic) == 0).select(*map(common.quoted, docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least id; see near_dedup.deduplicate() for nulls and ties."""
    return near_dedup.deduplicate(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found spans replaced by their kinds; n_chars as of the new text; see pii.redact() for nulls."""
    return pii.redact(docs, pii.train(docs), length_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson counts at their sources' rates, globally shuffled; see mixing.mix() for nulls and ties."""
    return mixing.mix(docs, keep=docs.columns, added=())


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of ids, and digests of ids and of what they decode to; see byte_bpe.encode() for nulls."""
    return byte_bpe.encode_digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("personal data", redact_personal_data),
    ("mixing", mix_sources),
    ("byte-level BPE", tokenize),
]

#: A classifier and a hash signature are among the stages: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir))
        if before is not None:
            common.dropped(before)
        before = docs
    return docs
