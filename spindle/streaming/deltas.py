"""Coordinate deltas as a stream: entries that arrive in files, added up by coordinate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spindle.sources.scratch import opened

SCHEMA = "i long, j long, v double"


def follow(spark: SparkSession, source: str, out: str, checkpoint: str, files: int = 8) -> StreamingQuery:
    """Start a query that takes the Parquet files of (i, j, v) in the folder `source` that are new since its last run, and ends when there is none.

    Sums by coordinate are the state, kept at `checkpoint` with the files already
    taken; a run after a stop or a loss goes on from there. In update mode each
    batch writes the coordinates that it changed to its own folder under `out`,
    over what an earlier attempt of the same batch left, so that a batch counts
    once. The state has one row for each coordinate, whenever it came.
    """
    sums = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(source).groupBy("i", "j").agg(F.sum("v").alias("v"))

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return sums.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def state(spark: SparkSession, *out: str, base: str | None = None) -> DataFrame:
    """i, j, v as of the last batch that changed each coordinate; of some batches only, if their folders and the one above them are given."""
    reader = spark.read.schema(f"{SCHEMA}, batch long")
    changes = (reader.option("basePath", base) if base else reader).parquet(*out)
    return changes.groupBy("i", "j").agg(F.max_by("v", "batch").alias("v"))


def compact(spark: SparkSession, out: str) -> int:
    """Fold the batches under `out` into one, so that state() reads each coordinate about once; returns the number of folders gone.

    All but the last batch are folded, as a query that lost its executors may
    write the last one again. The folded rows are added to the newest of these
    folders, the older ones deleted after that: whatever a break leaves behind,
    state() is the same, for rows that stand twice hold the same value. The query
    may run on meanwhile, readers of state() may not.
    """
    place, store = opened(spark, out)
    if not store.exists(place):
        return 0
    names = (f.getPath().getName() for f in store.listStatus(place) if f.isDirectory())
    batches = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
    *old, newest = batches[:-1] or [None]
    if not old:
        return 0
    path = lambda b: f"{out}/batch={b}"
    folded = state(spark, *map(path, (*old, newest)), base=out)
    # what the newest folder holds itself need not be written again
    own = spark.read.schema(SCHEMA).parquet(path(newest)).select("i", "j")
    folded.join(own, ["i", "j"], "left_anti").select("i", "j", "v").write.mode("append").parquet(path(newest))
    for b in old:
        store.delete(opened(spark, path(b))[0], True)
    return len(old)
