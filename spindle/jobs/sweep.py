"""The cells of a benchmark sweep, and a harness that times them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.sources import results, scratch

from . import analytics


def plan(matrices: DataFrame, executables: DataFrame, threads: DataFrame, runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for each run: only executables with a run-time schedule meet the chunk sizes.

    The sides are saved first, so that Spark knows their sizes, sends the small
    ones around, and does not multiply the numbers of their partitions.
    """
    matrices, executables, threads, runs, chunks = map(scratch.saved, (matrices, executables, threads, runs, chunks))
    schedule = F.when(F.col("executable").endswith("_static"), "static").when(F.col("executable").endswith("_dynamic"), "dynamic").otherwise("guided")
    kinds = executables.withColumn("schedule", F.when(F.col("executable").startswith("runtime_"), schedule))
    cut = kinds.join(chunks, F.col("schedule").isNotNull(), "left")
    # every cell is wanted
    cells = matrices.crossJoin(cut).crossJoin(threads).crossJoin(runs)
    return cells.select("matrix", "executable", "threads", "run", "chunk", "schedule")


def timed(make: Callable[[], DataFrame], calls: int = 20) -> list[tuple[int, float]]:
    """(call, seconds) of so many whole runs into a sink that keeps nothing."""
    out = []
    for call in range(1, calls + 1):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        out.append((call, time.perf_counter() - began))
    return out


CELL = ("matrix", "executable", "threads", "run", "chunk")


def open_cells(spark: SparkSession, cells: DataFrame, path: str) -> DataFrame:
    """Those cells of a plan that no result file under path has yet."""
    if not results.any_file(spark, path):
        return cells
    have = results.scan(spark, path).select("matrix", F.col("Executable").alias("executable"), F.col("Threads").cast("long").alias("threads"), F.col("Run").cast("long").alias("run"), F.col("ChunkSize").cast("long").alias("chunk"))
    same = F.lit(True)
    for c in CELL:
        same &= cells[c].eqNullSafe(have[c])
    return cells.join(have, same, "left_anti")


def run(spark: SparkSession, cells: DataFrame, executables: dict[str, Callable[[dict], DataFrame]], path: str, testbench: str, calls: int = 1, most: int | None = None) -> int:
    """Time the plan's open cells one after the other, each by its executable; append each to the result files as soon as it is measured.

    An executable makes a DataFrame from a cell (matrix, threads, chunk ...). The
    time is the mean of so many calls. A run that breaks off, or ends after
    `most` cells, is resumed by the next. Returns the number of cells measured.
    The driver walks over the plan, as cells must not run at once.
    """
    done = 0
    order = [F.col(c).asc_nulls_first() for c in CELL]
    for cell in open_cells(spark, cells, path).orderBy(*order).toLocalIterator():
        if most is not None and done >= most:
            break
        cell = cell.asDict()
        took = timed(lambda c=cell: executables[c["executable"]](c), calls)
        row = (cell["executable"], cell["threads"], cell["run"], cell["chunk"], sum(s for _, s in took) / calls)
        file = f"{path}/{testbench}/{cell['matrix']}{'_chunked' * (cell['chunk'] is not None)}.csv"
        results.append(spark.createDataFrame([row], results.SCHEMA), file)
        done += 1
    return done


def report(spark: SparkSession, path: str) -> DataFrame:
    """executable, threads, p90 of the result files."""
    return analytics.p90(results.scan(spark, path).select(F.col("Executable").alias("executable"), F.col("Threads").alias("threads"), F.col("Time").alias("time")))
