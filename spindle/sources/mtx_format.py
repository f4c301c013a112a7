"""Matrix Market text as a Spark data source: spark.read.format("mtx") and df.write.format("mtx").

    mtx_format.register(spark)
    entries = spark.read.format("mtx").load(path)        # i, j, v (complex: also im), 0-based
    df.write.format("mtx").option("field", "integer").mode("overwrite").save(path)

A path is a file, or a folder of part files that are one file in the order of
their names. Tasks take byte ranges and find their own line starts. How many
entries stand before a range must be known, as a file's entries end with the
number that its size line states, and a dense array's places follow from it. A
folder made by this writer holds an index of that, so that its body is read in
one pass, and only ranges that can hold the rows asked for; the lines of any
other file are counted first, by Spark in indexed(), which load() asks, else by
the planner, which is one process and refuses files of more than COUNTED bytes.
inventory() reads the heads of all files of a collection, and no further.

The writer's tasks write into a temporary folder; the commit makes the size line
from what they report, moves their files and writes the header last. A failed
job leaves no file. Paths are those that pyarrow.fs opens (local, hdfs, s3 ...);
mtx.read() reads any store that Spark reads.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import astuple, dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from . import mtx, scratch, shipping

#: Bytes of a range, and of what a task parses at once.
RANGE, BLOCK = 32 << 20, 1 << 20
#: Bytes of a file without an index whose lines the planner counts itself.
COUNTED = 256 << 20
INDEX, HEAD = "_index", "part-000000-head.mtx"
PLAN_SCHEMA = "file string, start long, stop long, entries long"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def _files(path: str) -> tuple[fs.FileSystem, list[tuple[str, int]]]:
    """The file system, and place and size of the path's part files in order."""
    store, at = _opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return store, [(at, info.size)]
    if info.type != fs.FileType.Directory:
        raise mtx.CouldNotReadFile(path)
    found = [(f.path, f.size) for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    if not found:
        raise mtx.CouldNotReadFile(path)
    return store, sorted(found)


def header(path: str) -> tuple[mtx.Meta, int]:
    """Type and size of a file, and the byte after its size line; reads no further, and keeps no comment."""
    store, files = _files(path)
    with store.open_input_stream(files[0][0]) as stream:
        rest, at, kind = b"", 0, None
        while True:
            line, cut, after = rest.partition(b"\n")
            if not cut:
                more = stream.read(1 << 16)
                if more:
                    if len(rest) > mtx.LONGEST_LINE and not (kind and rest.lstrip().startswith(b"%")):
                        raise mtx.LineTooLong("banner" if kind is None else "size line")
                    rest += more
                    continue
            at += len(line) + len(cut)
            rest = after
            text = line.decode("utf-8", "replace").strip()
            if (kind is None or (text and not text.startswith("%"))) and len(text) > mtx.LONGEST_LINE:
                raise mtx.LineTooLong("banner" if kind is None else "size line")
            if kind is None:
                kind = mtx.banner(text)
            elif text and not text.startswith("%"):
                want = 3 if kind[0] == "coordinate" else 2
                if not re.match(mtx._tokens(want), text):
                    raise mtx.PrematureEof("no size line")
                size = [int(x) for x in text.split()[:want]]
                return mtx.Meta(*kind, size[0], size[1], size[2] if want == 3 else size[0] * size[1]), at
            if not cut:
                raise mtx.PrematureEof("no size line")


@dataclass
class Range(InputPartition):
    """Lines that begin from start up to stop; first: how many entries stand before."""

    file: str
    start: int
    stop: int
    first: int = 0
    base: int = 0
    value: object = field(default=None)


def _lines(store: fs.FileSystem, r: Range) -> Iterator[bytes]:
    """Whole lines that begin in the range, many at once."""
    with store.open_input_file(r.file) as f:
        at = r.start
        if at > r.base:
            f.seek(at - 1)
        else:
            f.seek(at)
        rest, skipping = b"", at > r.base
        place = at - 1 if skipping else at
        while True:
            block = f.read(BLOCK)
            end = not block
            rest += block
            if skipping:
                cut = rest.find(b"\n")
                if cut < 0 and not end:
                    place += len(rest)
                    rest = b""
                    continue
                place += cut + 1 if cut >= 0 else len(rest)
                rest = rest[cut + 1 :] if cut >= 0 else b""
                skipping = False
            if place >= r.stop:
                return
            if place + len(rest) >= r.stop:
                # the line that holds the byte before `stop` is the last
                last = rest.find(b"\n", r.stop - 1 - place)
                if last >= 0 or end:
                    yield rest[: last + 1] if last >= 0 else rest
                    return
            if end:
                if rest:
                    yield rest
                return
            last = rest.rfind(b"\n") + 1
            if last:
                yield rest[:last]
                place += last
                rest = rest[last:]


_SPACE = np.isin(np.arange(256), list(b" \t\r\x0b\x0c\n"))


def _tokens_by_line(block: bytes) -> np.ndarray:
    """Tokens of each line that has any."""
    b = np.frombuffer(block, np.uint8)
    space = _SPACE[b]
    starts = ~space & np.concatenate([[True], space[:-1]])
    line = np.cumsum(b == 10) - (b == 10)
    n = np.bincount(line[starts]) if starts.any() else np.zeros(0, np.int64)
    return n[n > 0]


def _parsed(block: bytes, n_places: int, n_values: int) -> tuple[list[np.ndarray], int | None]:
    """Columns of the block's entries, up to the first that is broken, whose number is the second result."""
    width, counts = n_places + n_values, _tokens_by_line(block)
    kinds = [np.int64] * n_places + [np.float64] * n_values
    try:
        if (counts == width).all() and b"_" not in block:
            words = block.split()
            return [np.array(words[k::width], dtype=bytes).astype(t) if words else np.zeros(0, t) for k, t in enumerate(kinds)], None
    except (ValueError, OverflowError):
        pass
    rows = []
    for line in block.split(b"\n"):
        words = line.split()
        if words:
            try:
                if len(words) < width or any(b"_" in w for w in words[:width]):
                    raise ValueError
                rows.append([*map(int, words[:n_places]), *map(float, words[n_places:width])])
            except ValueError:
                return [np.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], len(rows)
    return [np.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], None


class MtxReader(DataSourceReader):
    def __init__(self, path: str, meta: mtx.Meta, body: int, zero_based: bool, index: str | None, plan: bool):
        self.path, self.meta, self.body, self.shift, self.index, self.plan = path, meta, body, 1 if zero_based else 0, index, plan
        self.filters: list[tuple[str, str, object]] = []

    def _ranges(self) -> list[Range]:
        _, files = _files(self.path)
        out = []
        for k, (name, size) in enumerate(files):
            base = self.body if k == 0 else 0
            out += [Range(name, at, min(at + RANGE, size), base=base) for at in range(base, size, RANGE)]
        return out

    def _may(self, low: int, high: float) -> bool:
        """Whether rows (as the user counts them) from low to high can pass the filters."""
        ok = {"==": lambda v: low <= v <= high, ">": lambda v: high > v, ">=": lambda v: high >= v, "<": lambda v: low < v, "<=": lambda v: low <= v, "in": lambda v: any(low <= x <= high for x in v)}
        return all(ok[sign](value) for name, sign, value in self.filters if name == "i")

    def partitions(self) -> list[InputPartition]:
        ranges = self._ranges()
        if self.plan:
            return ranges or [Range("", 0, 0)]
        store, at = _opened(self.path)
        index = self.index or f"{self.path.rstrip('/')}/{INDEX}"
        held, place = _opened(index)
        if held.get_file_info(place).type == fs.FileType.File:
            with held.open_input_stream(place) as f:
                ranges = self._indexed(json.loads(f.read()))
        else:
            n = sum(r.stop - r.start for r in ranges)
            if n > COUNTED:
                raise ValueError(f"{n} bytes without an index: use mtx_format.load(), or give the option index=mtx_format.indexed(spark, path)")
            n = 0
            for r in ranges:
                r.first = n
                n += sum(len(_tokens_by_line(b)) for b in _lines(store, r))
            if n < self.meta.nnz:
                raise mtx.PrematureEof(f"{n} entries of {self.meta.nnz}")
        return [r for r in ranges if r.first < self.meta.nnz] or [Range("", 0, 0)]

    def _indexed(self, index: dict) -> list[Range]:
        _, files = _files(self.path)
        sizes, names = dict(files), {posixpath.basename(f): f for f, _ in files}
        out, n, body = [], 0, self.body
        for own in index["files"]:
            file = names.get(own["file"])
            if file is None or sizes[file] != own["size"]:
                raise mtx.PrematureEof(f"the index does not fit {own['file']}")
            marks = [*own["marks"], [own["size"], own["entries"], None]]
            for (start, before, row), (stop, _, after) in zip(marks, marks[1:], strict=False):
                # rows of a sorted file: from the mark's to the next mark's
                if not index.get("sorted") or row is None or self._may(row + 1 - self.shift, float("inf") if after is None else after + 1 - self.shift):
                    out.append(Range(file, start, stop, n + before, base=start if index.get("aligned") else body))
            n, body = n + own["entries"], 0
        if n < self.meta.nnz:
            raise mtx.PrematureEof(f"{n} entries of {self.meta.nnz}")
        return out

    def read(self, r: Range) -> Iterator[pa.RecordBatch]:
        if not r.file:
            return
        store, _ = _opened(self.path)
        if self.plan:
            n = sum(len(_tokens_by_line(b)) for b in _lines(store, r))
            yield pa.RecordBatch.from_pydict({"file": [posixpath.basename(r.file)], "start": [r.start], "stop": [r.stop], "entries": [n]}, schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("entries", pa.int64())]))
            return
        array, values = self.meta.format == "array", {"pattern": 0, "complex": 2}.get(self.meta.field, 1)
        k = r.first
        for block in _lines(store, r):
            columns, broken = _parsed(block, 0 if array else 2, values)
            n = min(len(columns[0]) if columns else 0, self.meta.nnz - k)
            if broken is not None and broken < self.meta.nnz - k:
                raise mtx.PrematureEof(f"entry {k + broken + 1} is broken")
            if array:
                at = np.arange(k, k + n)
                i, j, own = at % self.meta.n_rows + 1, at // self.meta.n_rows + 1, columns
            else:
                i, j, own = columns[0][:n], columns[1][:n], columns[2:]
            found = {"i": i - self.shift, "j": j - self.shift, "v": own[0][:n] if own else np.ones(n)} | ({"im": own[1][:n]} if self.meta.field == "complex" else {})
            stay = np.ones(n, bool)
            for name, sign, value in self.filters:
                c = found[name]
                stay &= np.isin(c, value) if sign == "in" else {"==": c == value, ">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value}[sign]
            if stay.any():
                yield pa.RecordBatch.from_pydict({name: pa.array(c[stay]) for name, c in found.items()})
            k += n
            if k >= self.meta.nnz:
                return


class PushingReader(MtxReader):
    """Spark takes such a reader only where spark.sql.python.filterPushdown.enabled is true."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of i or j with a number are applied here, the rest is Spark's."""
        signs = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            sign = signs.get(type(f))
            if sign and f.attribute in (("i",), ("j",)) and (sign != "in" or all(v is not None for v in f.value)):
                self.filters.append((f.attribute[0], sign, list(f.value) if sign == "in" else f.value))
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str
    size: int
    entries: int
    rows: int
    cols: int
    least: tuple[int, int] | None
    most: tuple[int, int] | None
    sorted: bool
    marks: list


class MtxWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.format, self.field, self.symmetry = options.get("matrix", "coordinate"), options.get("field", "real"), options.get("symmetry", "general")
        self.size = [int(options[k]) if k in options else None for k in ("rows", "cols")]
        self.shift = 1 if options.get("zerobased", "true").lower() == "true" else 0
        self.columns = ["i", "j"] + {"pattern": [], "complex": ["v", "im"]}.get(self.field, ["v"])
        if not mtx.valid_meta(mtx.Meta(self.format, self.field, self.symmetry, 0, 0, 0)) or self.format not in mtx.FORMATS or self.field not in mtx.FIELDS or self.symmetry not in mtx.SYMMETRIES:
            raise mtx.UnsupportedType(f"{self.format} {self.field} {self.symmetry}")
        if missing := set(self.columns) - set(schema.names):
            raise mtx.UnsupportedType(f"no column {', '.join(sorted(missing))}")
        self.job = uuid.uuid4().hex
        self.places = [schema.names.index(c) for c in self.columns]
        # made here and not by tasks, so that one that runs on after an abort finds no place to write
        store, folder = self._temporary()
        store.create_dir(folder, recursive=True)

    def _temporary(self) -> tuple[fs.FileSystem, str]:
        store, at = _opened(self.path)
        return store, f"{at}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, folder = self._temporary()
        partition, file = TaskContext.get().partitionId(), f"{folder}/{uuid.uuid4().hex}"
        array = self.format == "array"
        order = (lambda i, j: (j, i)) if array else (lambda i, j: (i, j))
        try:
            size = n = rows = cols = 0
            least = most = None
            marks, ordered = [], True
            with store.open_output_stream(file) as out:
                for batch in iterator:
                    own = [batch.column(p) for p in self.places]
                    if any(c.null_count for c in own):
                        raise ValueError("an entry is null")
                    if not batch.num_rows:
                        continue
                    i, j = (np.asarray(c.to_numpy(zero_copy_only=False), np.int64) for c in own[:2])
                    values = [map(str, c.cast(pa.int64(), safe=False).to_pylist()) if self.field == "integer" else map(repr, c.cast(pa.float64()).to_pylist()) for c in own[2:]]
                    at = [] if array else [map(str, (i + self.shift).tolist()), map(str, (j + self.shift).tolist())]
                    first, last = order(int(i[0]), int(j[0])), order(int(i[-1]), int(j[-1]))
                    a, b = order(i, j)
                    ordered &= (most is None or most <= first) and bool(((a[1:] > a[:-1]) | ((a[1:] == a[:-1]) & (b[1:] >= b[:-1]))).all())
                    least, most = least or first, last
                    if not marks or size >= marks[-1][0] + RANGE:
                        marks.append([size, n, None if array else int(i[0]) + self.shift - 1])
                    text = ("\n".join(map(" ".join, zip(*at, *values, strict=True))) + "\n").encode()
                    out.write(text)
                    size, n = size + len(text), n + batch.num_rows
                    rows, cols = max(rows, int(i.max()) + self.shift), max(cols, int(j.max()) + self.shift)
        except Exception:
            if store.get_file_info(file).type == fs.FileType.File:
                store.delete_file(file)
            raise
        return Written(partition, file, size, n, rows, cols, least, most, ordered, marks)

    def commit(self, messages: list[Written | None]) -> None:
        """The header from what the tasks report; files of other attempts go with the temporary folder."""
        store, folder = self._temporary()
        _, at = _opened(self.path)
        own = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        rows, cols = (s if s is not None else max([0, *seen]) for s, seen in zip(self.size, ([m.rows for m in own], [m.cols for m in own]), strict=True))
        entries = sum(m.entries for m in own)
        used = [m for m in own if m.entries]
        try:
            if used and (max(m.rows for m in used) > rows or max(m.cols for m in used) > cols):
                raise ValueError(f"entries outside {rows} rows and {cols} columns")
            ordered = all(m.sorted for m in used) and all(a.most <= b.least for a, b in zip(used, used[1:], strict=False))
            if self.format == "array" and (entries != rows * cols or not ordered):
                raise ValueError(f"{entries} cells of an array of {rows} by {cols}, or not by columns")
        except ValueError:
            self.abort(messages)
            raise
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(at)):
                if f.type == fs.FileType.File:
                    store.delete_file(f.path)
        index = []
        for k, m in enumerate(used):
            name = f"part-{k + 1:06d}.mtx"
            store.move(m.file, f"{at}/{name}")
            index.append({"file": name, "size": m.size, "entries": m.entries, "marks": m.marks})
        store.delete_dir(folder) if store.get_file_info(folder).type == fs.FileType.Directory else None
        size = f"{rows} {cols}" + ("" if self.format == "array" else f" {entries}")
        with store.open_output_stream(f"{at}/{INDEX}") as f:
            f.write(json.dumps({"aligned": True, "sorted": ordered and self.format == "coordinate", "files": index}).encode())
        with store.open_output_stream(f"{at}/{HEAD}") as f:
            f.write(f"{mtx.BANNER} matrix {self.format} {self.field} {self.symmetry}\n{size}\n".encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = self._temporary()
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)
        _, at = _opened(self.path)
        if not self.overwrite and not store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if store.get_file_info(at).type == fs.FileType.Directory:
                store.delete_dir(at)


class MtxDataSource(DataSource):
    """Options of a reader: zeroBased (true), index (place of an index), pushdown (false; needs the session's leave); of a writer: matrix (coordinate, array), field, symmetry, rows, cols (else as the entries need), zeroBased."""

    @classmethod
    def name(cls) -> str:
        return "mtx"

    def _plan(self) -> bool:
        return self.options.get("plan", "false").lower() == "true"

    def schema(self) -> str:
        if self._plan():
            return PLAN_SCHEMA
        meta, _ = header(self.options["path"])
        return "i long, j long, v double" + (", im double" if meta.field == "complex" else "")

    def reader(self, schema: StructType) -> MtxReader:
        meta, body = header(self.options["path"])
        kind = PushingReader if self.options.get("pushdown", "false").lower() == "true" else MtxReader
        return kind(self.options["path"], meta, body, self.options.get("zeroBased", "true").lower() == "true", self.options.get("index"), self._plan())

    def writer(self, schema: StructType, overwrite: bool) -> MtxWriter:
        path = self.options["path"]
        store, at = _opened(path)
        info = store.get_file_info(at)
        if info.type == fs.FileType.File or (info.type == fs.FileType.Directory and not overwrite and store.get_file_info(fs.FileSelector(at))):
            raise mtx.CouldNotWriteFile(path)
        return MtxWriter({k.lower(): v for k, v in self.options.items()}, schema, overwrite)


_registered: set[str] = set()


def register(spark: SparkSession) -> None:
    """Make the format known to the session's application, once."""
    app = spark.sparkContext.applicationId
    if app not in _registered:
        _registered.add(app)
        shipping.shipped(spark)
    spark.dataSource.register(MtxDataSource)


def indexed(spark: SparkSession, path: str) -> str:
    """Place of an index of the file: the folder's own, else one in the scratch folder, for which Spark's tasks count the lines of their ranges."""
    register(spark)
    store, at = _opened(path)
    own = f"{path.rstrip('/')}/{INDEX}"
    if store.get_file_info(_opened(own)[1]).type == fs.FileType.File:
        return own
    meta, _ = header(path)
    files: dict[str, dict] = {}
    sizes = {posixpath.basename(f): size for f, size in _files(path)[1]}
    for r in sorted(spark.read.format("mtx").option("plan", "true").load(path).collect()):  # a row for each 32 MB
        f = files.setdefault(r["file"], {"file": r["file"], "size": sizes[r["file"]], "entries": 0, "marks": []})
        f["marks"].append([r["start"], f["entries"], None])
        f["entries"] += r["entries"]
    if (n := sum(f["entries"] for f in files.values())) < meta.nnz:
        raise mtx.PrematureEof(f"{n} entries of {meta.nnz}")
    place = scratch.folder(spark)
    held, there = _opened(place)
    held.create_dir(there, recursive=True)
    with held.open_output_stream(f"{there}/{INDEX}") as f:
        f.write(json.dumps({"aligned": False, "sorted": False, "files": [files[k] for k in sorted(files)]}).encode())
    return f"{place}/{INDEX}"


HEADS = "place string, code int, format string, field string, symmetry string, n_rows long, n_cols long, nnz long"


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int32(), *[pa.string()] * 3, *[pa.int64()] * 3]
    names = [c.split()[0] for c in HEADS.split(", ")]
    for batch in batches:
        rows = []
        for place in batch.column(0).to_pylist():
            try:
                rows.append((place, 0, *astuple(header(place)[0])))
            except (mtx.MtxError, OSError) as e:
                rows.append((place, e.code if isinstance(e, mtx.MtxError) else mtx.CouldNotReadFile.code, *[None] * 6))
        yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, t, c in zip(names, kinds, zip(*rows, strict=True), strict=True)} if rows else {n: pa.array([], t) for n, t in zip(names, kinds, strict=True)})


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """place, code, format, field, symmetry, n_rows, n_cols, nnz, valid, in_product of every matrix under a folder.

    A matrix is a file, or a folder of part files. code is 0 or the number of
    the error that reading its head gives, with the rest null. valid: such a type
    may be; in_product: it is sparse and not complex, as products need. Files are
    listed by Spark, and tasks read each up to its size line only; no entry is looked at. Files of no bytes
    are passed over, as Spark does.
    """
    shipping.shipped(spark)
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    except AnalysisException as e:
        raise mtx.CouldNotReadFile(path) from e
    place = F.regexp_replace(F.regexp_replace("path", "/part-[^/]*$", ""), "^file:/+", "/").alias("place")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    heads = files.select(place).repartition(tasks, "place").distinct().mapInArrow(_heads, HEADS)
    known = F.col("code") == 0
    fits = (F.col("format") == "coordinate") & (F.col("field") != "complex")
    return heads.withColumns({"valid": F.when(known, mtx.valid(F.col("format"), F.col("field"), F.col("symmetry"))), "in_product": F.when(known, fits)})


def load(spark: SparkSession, path: str, zero_based: bool = True, expand_symmetry: bool = False, for_product: bool = False) -> tuple[mtx.Meta, DataFrame]:
    """Type and entries of a file through the data source; the stored triangle as it is, unless expand_symmetry. for_product: complex and array raise."""
    meta, _ = header(path)
    if for_product:
        mtx.gate(meta)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    out = spark.read.format("mtx").option("pushdown", pushdown).option("index", indexed(spark, path)).option("zeroBased", str(zero_based).lower()).load(path)
    if expand_symmetry:
        from spindle.operators.matrix import mirrored

        out = mirrored(out, meta.symmetry)
    return meta, out


def save(entries: DataFrame, path: str, matrix: str = "coordinate", field: str = "real", symmetry: str = "general", rows: int | None = None, cols: int | None = None) -> None:
    """Entries (i, j, v; complex: also im) written in order, by row and column, or an array's cells by column and row; one range shuffle."""
    register(entries.sparkSession)
    order = ["j", "i"] if matrix == "array" else ["i", "j"]
    out = entries.repartitionByRange(*order).sortWithinPartitions(*order).write.format("mtx").mode("overwrite").options(matrix=matrix, field=field, symmetry=symmetry)
    for name, n in (("rows", rows), ("cols", cols)):
        out = out if n is None else out.option(name, str(n))
    out.save(path)
