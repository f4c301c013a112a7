"""What the operators of this subpackage share: tables, shipping, scratch tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spindle.sources.scratch import dropped, saved  # noqa: F401
from spindle.sources.shipping import shipped as ready

#: Rows and bytes of the slices in which tasks take an Arrow batch. Spark bounds the
#: batch itself (64 MB unless set otherwise); a session's own settings are left alone.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def private(df: DataFrame, *names: str) -> list[str]:
    """These names, each with underscores put before it until no column of df has it in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, so that extra columns cannot clash with the operator's own."""
    return df.select(*map(quoted, columns))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most SLICE_ROWS rows and about SLICE_BYTES (one row at least)."""
    step = max(1, min(SLICE_ROWS, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
    for k in range(0, batch.num_rows, step):
        yield batch.slice(k, step)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str | StructType, whole: bool = False) -> DataFrame:
    """mapInArrow with a function of one slice (or whole batch); it may return a dict of columns."""
    ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in [batch] if whole else slices(batch):
                if b.num_rows:
                    out = fn(b)
                    yield pa.RecordBatch.from_pydict(out) if isinstance(out, dict) else out

    return df.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """True where crc32 of the id as text leaves remainder 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == 0


def vocabulary(name: str, path: str | None) -> str:
    """The place of a public vocabulary file: the parameter, else the installed one."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)
