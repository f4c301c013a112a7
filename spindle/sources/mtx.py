"""Matrix Market text: banner and size line, entries, writers. Lines are read and parsed by Spark."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The words of a banner
BANNER = "%%MatrixMarket"
FORMATS = ("coordinate", "array")
FIELDS = ("real", "complex", "pattern", "integer")
SYMMETRIES = ("general", "symmetric", "hermitian", "skew-symmetric")
#: Fixed value: characters of a banner or size line at most
LONGEST_LINE = 1024
#: Lines that are looked at for the size line at first; ten times as many while all are comments.
HEADER_LINES = 1000
SPACE = r"[ \t\r\x0b\f]"


class MtxError(ValueError):
    code = 0


class CouldNotReadFile(MtxError):
    code = 11


class PrematureEof(MtxError):
    code = 12


class NotMtx(MtxError):
    code = 13


class NoHeader(MtxError):
    code = 14


class UnsupportedType(MtxError):
    code = 15


class LineTooLong(MtxError):
    code = 16


class CouldNotWriteFile(MtxError):
    code = 17


@dataclass(frozen=True)
class Meta:
    format: str
    field: str
    symmetry: str
    n_rows: int
    n_cols: int
    nnz: int


def valid(fmt: Column, field: Column, symmetry: Column) -> Column:
    """Not: dense pattern, real hermitian, pattern hermitian or skew."""
    dense_pattern = (fmt == "array") & (field == "pattern")
    real_hermitian = (field == "real") & (symmetry == "hermitian")
    odd_pattern = (field == "pattern") & symmetry.isin("hermitian", "skew-symmetric")
    return ~(dense_pattern | real_hermitian | odd_pattern)


def valid_meta(meta: Meta) -> bool:
    """The same of one file's type."""
    dense_pattern = meta.format == "array" and meta.field == "pattern"
    real_hermitian = meta.field == "real" and meta.symmetry == "hermitian"
    return not (dense_pattern or real_hermitian or (meta.field == "pattern" and meta.symmetry in ("hermitian", "skew-symmetric")))


def gate(meta: Meta) -> None:
    """Products take sparse files that are not complex."""
    if meta.field == "complex" or meta.format != "coordinate":
        raise UnsupportedType(f"{meta.format} {meta.field} in a product")


def type_text(fmt: Column, field: Column, symmetry: Column) -> Column:
    return F.concat_ws(" ", F.lit("matrix"), fmt, field, symmetry)


def banner(line: str | None) -> tuple[str, str, str]:
    """format, field, symmetry of a banner line."""
    words = (line or "").split()
    if len(words) < 5:
        raise PrematureEof(f"the banner has {len(words)} words of 5")
    if not words[0].startswith(BANNER):
        raise NoHeader(words[0])
    kind, *rest = (w.lower() for w in words[1:5])
    if kind != "matrix" or rest[0] not in FORMATS or rest[1] not in FIELDS or rest[2] not in SYMMETRIES:
        raise UnsupportedType(" ".join([kind, *rest]))
    return tuple(rest)


def banner_columns(line: Column) -> Column:
    """struct(code, format, field, symmetry) of a banner line: code 0, or the number of the error, with the rest null."""
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    word = lambda k: F.lower(F.get(words, F.lit(k)))
    fmt, field, symmetry = word(2), word(3), word(4)
    known = (word(1) == "matrix") & fmt.isin(*FORMATS) & field.isin(*FIELDS) & symmetry.isin(*SYMMETRIES)
    code = (
        F.when(line.isNull() | (F.size(words) < 5), PrematureEof.code)
        .when(~F.startswith(F.get(words, F.lit(0)), F.lit(BANNER)), NoHeader.code)
        .when(~known, UnsupportedType.code).otherwise(0)
    )
    return F.struct(code.alias("code"), *(F.when(code == 0, c).alias(n) for n, c in (("format", fmt), ("field", field), ("symmetry", symmetry))))


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """text, without white space at its ends, with block and at, which order the lines of one file, or of the part files of a folder by name."""
    try:
        raw = spark.read.text(path)
    except AnalysisException as e:
        raise CouldNotReadFile(str(path)) from e
    block = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return raw.select(F.regexp_replace("value", f"^{SPACE}+|{SPACE}+$", "").alias("text"), block.alias("block"), F.monotonically_increasing_id().alias("at"))


def _tokens(n: int, pattern: str = r"[-+]?\d+") -> str:
    return rf"^{pattern}(?:\s+{pattern}){{{n - 1}}}(?:\s|$)"


def header(spark: SparkSession, path: str) -> tuple[Meta, list[str]]:
    """The file's type and size, and its lines up to the size line; only the first lines are read.

    Of a folder, those of the part file that is first by name. Comments and
    blank lines may stand before the size line, any other line may not.
    """
    files = sorted(lines(spark, path).inputFiles(), key=_name)
    n = HEADER_LINES
    while True:
        found = lines(spark, files[0]).limit(n).collect() if files else []
        found = [r["text"] for r in sorted(found, key=lambda r: (r["block"]["start"], r["at"]))]
        own = [k for k, t in enumerate(found) if k and t and not t.startswith("%")]
        if own or len(found) < n:
            break
        n *= 10
    if found and len(found[0]) > LONGEST_LINE:
        raise LineTooLong("banner")
    fmt, field, symmetry = banner(found[0] if found else None)
    want = 3 if fmt == "coordinate" else 2
    if not own or not re.match(_tokens(want), found[own[0]]):
        raise PrematureEof("no size line")
    if len(found[own[0]]) > LONGEST_LINE:
        raise LineTooLong("size line")
    size = [int(x) for x in found[own[0]].split()[:want]]
    return Meta(fmt, field, symmetry, size[0], size[1], size[2] if want == 3 else size[0] * size[1]), found[: own[0] + 1]


def _name(file: str) -> str:
    return file.rsplit("/", 1)[-1]


def read(spark: SparkSession, path: str, zero_based: bool = True, expand_symmetry: bool = False, for_product: bool = False) -> tuple[Meta, DataFrame]:
    """The file's type and its entries (i, j, v; complex: also im): as many as the size line states, and no more.

    A pattern's values are 1. An array is read by columns. The stored triangle
    is returned as it is, unless expand_symmetry. Fewer entries than stated, or
    one among them that is broken, raise PrematureEof. for_product: complex and
    array raise. Besides the header there is one pass to check the file, which
    counts the entries of each block (128 MB of text, or so).
    """
    meta, head = header(spark, path)
    if for_product:
        gate(meta)
    rows = lines(spark, path)
    first = min(rows.inputFiles(), key=_name)
    t = F.split("text", r"\s+")
    number = lambda k: F.try_element_at(t, F.lit(k + 1))
    shift = 1 if zero_based else 0
    places = [number(k).try_cast("long") for k in (0, 1)] if meta.format == "coordinate" else []
    values = [number(len(places) + k).try_cast("double") for k in range({"pattern": 0, "complex": 2}.get(meta.field, 1))]
    broken = F.lit(False)
    for c in [*places, *values]:
        broken = broken | c.isNull()
    named = [v.alias(n) for v, n in zip(values or [F.lit(1.0)], ("v", "im"), strict=False)]
    own = rows.where(F.col("text") != "").select("block", "at", *(c.alias(n) for c, n in zip(places, "ij", strict=False)), *named, broken.alias("broken"))
    counts = own.groupBy("block").agg(F.count("*").alias("n"), F.count_if("broken").alias("bad"), F.min("at").alias("first")).collect()  # one row for each block of the file
    known = spark.createDataFrame([(x,) for x in head if x], "text string").agg(F.count("*"), F.count_if(broken)).first()
    blocks, total, bad = [], 0, False
    for b in sorted(counts, key=lambda b: (b["block"]["file"], b["block"]["start"])):
        start = b["block"]["file"] == _name(first).replace("%20", " ") and b["block"]["start"] == 0
        n, wrong = b["n"] - known[0] * start, b["bad"] - known[1] * start
        if total < meta.nnz:
            # the header's lines are the first of its block
            blocks.append((b["block"], total - known[0] * start))
            bad = bad or wrong > 0
        total += n
    if total < meta.nnz:
        raise PrematureEof(f"{total} entries of {meta.nnz}")
    offsets = spark.createDataFrame(blocks, "block struct<file:string,start:bigint>, before long")
    k = F.col("before") + F.row_number().over(Window.partitionBy("block").orderBy("at")) - 1
    used = own.join(F.broadcast(offsets), "block").withColumn("k", k).where((F.col("k") >= 0) & (F.col("k") < meta.nnz))
    if bad and used.where("broken").limit(1).count():
        raise PrematureEof("an entry is broken")
    if meta.format == "array":
        used = used.withColumns({"i": F.expr(f"k % {meta.n_rows}") + 1, "j": F.expr(f"k div {meta.n_rows}") + 1})
    out = used.select((F.col("i") - shift).alias("i"), (F.col("j") - shift).alias("j"), "v", *(["im"] if meta.field == "complex" else []))
    if expand_symmetry:
        from spindle.operators.matrix import mirrored

        out = mirrored(out, meta.symmetry)
    return meta, out


def write(entries: DataFrame, path: str, meta: Meta) -> None:
    """1-based text; header and entries, in this order, in one sorted file set.

    Coordinates by row and column; an array, of which entries has every cell,
    by column and row, values alone. Complex entries have v and im. The lines
    are range-partitioned, so that part files in name order are the file; the
    header stands before all. A folder that cannot be written raises CouldNotWriteFile.
    """
    numbers = {"pattern": [], "integer": [F.col("v").cast("long").cast("string")], "real": [F.col("v").cast("string")]}
    numbers["complex"] = [*numbers["real"], *([F.col("im").cast("string")] if "im" in entries.columns else [])]
    if not valid_meta(meta) or (meta.field == "complex") != ("im" in entries.columns):
        raise UnsupportedType(f"{meta.format} {meta.field} {meta.symmetry}")
    array = meta.format == "array"
    at = [] if array else [(F.col(c) + 1).cast("string") for c in ("i", "j")]
    order = ["j", "i"] if array else ["i", "j"]
    body = entries.select(F.lit(1).alias("o"), *order, F.concat_ws(" ", *at, *numbers[meta.field]).alias("value"))
    size = f"{meta.n_rows} {meta.n_cols}" + ("" if array else f" {meta.nnz}")
    head = [(0, -1, -1, f"{BANNER} matrix {meta.format} {meta.field} {meta.symmetry}\n{size}")]
    whole = entries.sparkSession.createDataFrame(head, f"o int, {order[0]} long, {order[1]} long, value string").unionByName(body)
    try:
        whole.repartitionByRange("o", *order).sortWithinPartitions("o", *order).select("value").write.mode("overwrite").text(path)
    except Exception as e:
        if not re.search(r"Mkdirs failed|Permission denied|Read-only|not a directory|ParentNotDirectory|FileAlreadyExists", str(e)):
            raise
        raise CouldNotWriteFile(path) from e
