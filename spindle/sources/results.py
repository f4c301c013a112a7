"""Benchmark results as CSV: scan, append, and what log lines say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import opened

SCHEMA = "Executable string, Threads int, Run int, ChunkSize int, Time double"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All result files under path, with matrix, testbench and whether the file is a chunked one.

    A file is x.csv, or a folder of that name with part files, in a folder named
    as its testbench. No file at all raises FileNotFoundError.
    """
    rows = spark.read.schema(SCHEMA).option("header", True).option("nullValue", "NA").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
    if not rows.inputFiles():
        raise FileNotFoundError(f"no CSV file under {path}")
    file = F.col("_metadata.file_path")
    parts = r"(?:testbench=)?([^/]+)/(?:file=)?([^/]+?)(_chunked)?\.csv(?:/part-[^/]*)?$"
    return rows.select("*", F.regexp_extract(file, parts, 2).alias("matrix"), F.regexp_extract(file, parts, 1).alias("testbench"), (F.regexp_extract(file, parts, 3) != "").alias("chunked"))


def any_file(spark: SparkSession, path: str) -> bool:
    """Whether there is a result file under path."""
    place, store = opened(spark, path)
    if not store.exists(place):
        return False
    files = store.listFiles(place, True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(".csv"):
            return True
    return False


def reset(spark: SparkSession, path: str) -> None:
    """An empty folder for results, whatever was there."""
    place, store = opened(spark, path)
    store.delete(place, True)
    store.mkdirs(place)


def append_all(rows: DataFrame, path: str) -> None:
    """Rows of many files at once: testbench and file (as x.csv or x_chunked.csv) say where each belongs."""
    rows.write.mode("append").partitionBy("testbench", "file").option("header", True).option("nullValue", "NA").csv(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).option("nullValue", "NA").csv(path)


def elapsed(line: str) -> Column:
    """Seconds of a timing line (its third word, in any notation of a number), else null."""
    word = F.try_element_at(F.filter(F.split(line, r"\s+"), lambda w: w != ""), F.lit(3))
    return F.when(F.col(line).contains("Elapsed time"), word.try_cast("double"))
