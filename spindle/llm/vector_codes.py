"""Vector codes by trained codebooks, nearest entries by a GNAT (operator 13).

Vectors become whole numbers, are cut into equal parts, and each part is named by
the nearest entry of its codebook; rounds of assigning and averaging train the
codebooks. Entries stand in a geometric near-neighbour access tree: split points
that lie apart, each with the entries nearest to it, and for every split point
the range of its distances to each child's entries. A query's distances to the
split points rule out a child when all its entries must be farther than the best
found. Distances are compared as whole squares; the ranges' roots are rounded
outward and rule out strictly, so that no entry as near as the best is lost, and
of those the lowest index is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Components of greater magnitude raise: their squared distances might not fit 64 bits.
MOST = 1 << 26
#: Split points of a node (chosen from thrice as many, so that few are outliers), entries of a leaf, and the outward rounding of roots.
DEGREE, LEAF, OUTWARD = 16, 32, 1e-12
#: Parts searched at once.
AT_ONCE = 4096


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all x (n, w) to all y (m, w): whole numbers, as floats where these hold every step exactly."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:
        x, y = x.astype(np.float64), y.astype(np.float64)
        return np.einsum("nw,nw->n", x, x)[:, None] + np.einsum("mw,mw->m", y, y) - 2 * (x @ y.T)
    d = x[:, None, :] - y[None, :, :]
    return np.einsum("nmw,nmw->nm", d, d)


class Gnat:
    """Nearest of some points of whole numbers; ties go to the lowest index."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE, leaf: int = LEAF):
        self.points, self.degree, self.leaf = points.astype(np.int64), degree, leaf
        self.root = self._built(np.arange(len(points)))
        #: distances computed so far
        self.measured = 0

    def _built(self, own: np.ndarray):
        """An array of indexes (a leaf), or (split indexes, low, high, children): ranges by split point and child."""
        if len(own) <= max(self.leaf, self.degree):
            return own
        some = own[np.linspace(0, len(own) - 1, min(len(own), 3 * self.degree)).astype(int)]
        splits = [int(some[0])]
        apart = squared(self.points[some], self.points[splits])[:, 0]
        while len(splits) < self.degree:
            splits.append(int(some[int(apart.argmax())]))
            apart = np.minimum(apart, squared(self.points[some], self.points[splits[-1:]])[:, 0])
        splits = np.unique(splits)
        rest = np.setdiff1d(own, splits)
        far = squared(self.points[splits], self.points[rest])
        child = far.argmin(0)
        low, high = np.full((len(splits), len(splits)), np.inf), np.full((len(splits), len(splits)), -np.inf)
        children = []
        for j in range(len(splits)):
            mine = child == j
            if mine.any():
                roots = np.sqrt(far[:, mine].astype(np.float64))
                low[:, j], high[:, j] = roots.min(1) * (1 - OUTWARD), roots.max(1) * (1 + OUTWARD)
            children.append(self._built(rest[mine]) if mine.any() else None)
        return splits, low, high, children

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each query's nearest point."""
        best, index = np.full(len(queries), np.iinfo(np.int64).max), np.full(len(queries), len(self.points))
        if len(queries):
            self._visit(self.root, np.arange(len(queries)), queries, best, index)
        return index, best

    def _measure(self, own: np.ndarray, rows: np.ndarray, queries: np.ndarray, best: np.ndarray, index: np.ndarray) -> np.ndarray:
        d = squared(queries[rows], self.points[own])
        self.measured += d.size
        at = d.argmin(1)  # the first of equals; own is in order
        near, who = d[np.arange(len(rows)), at], own[at]
        better = (near < best[rows]) | ((near == best[rows]) & (who < index[rows]))
        best[rows[better]], index[rows[better]] = near[better], who[better]
        return d

    def _visit(self, node, rows: np.ndarray, queries: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        if isinstance(node, np.ndarray):
            self._measure(node, rows, queries, best, index)
            return
        splits, low, high, children = node
        d = self._measure(splits, rows, queries, best, index)
        root = np.sqrt(d.astype(np.float64))
        least, most = root * (1 - OUTWARD), root * (1 + OUTWARD)
        home = d.argmin(1)
        # first the child of each query's nearest split point, which makes its reach short for the others
        for first in (True, False):
            for j, child in enumerate(children):
                mine = np.flatnonzero((home == j) == first)
                if child is None or not len(mine):
                    continue
                reach = (np.sqrt(best[rows[mine]].astype(np.float64)) * (1 + OUTWARD))[:, None]
                out = (least[mine] - reach > high[:, j]) | (most[mine] + reach < low[:, j])
                mine = mine[~out.any(1)]
                if len(mine):
                    self._visit(child, rows[mine], queries, best, index)


def whole_numbers(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """_id, _label and v, floor(scale * component) of the vectors that are not null and hold neither null nor non-finite components."""
    vec = common.quoted(vec_col).cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(vec.isNotNull() & fine).select(common.quoted(id_col).alias("_id"), common.quoted(label_col).alias("_label"), F.transform(vec, lambda x: F.floor(x * float(scale)).cast("long")).alias("v"))


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """(rows, parts, width of a part)"""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), parts, -1)


def _sums(vectors: DataFrame, books: np.ndarray) -> list:
    """part, entry, place, total of the parts assigned to each entry, by component, and at the place after these their number.

    Each task adds up its own parts; the driver gets a row for each component of the codebooks.
    """
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                x = _matrix(batch.column(0).slice(k, AT_ONCE), parts)
                for p in range(parts):
                    index, _ = trees[p].nearest(x[:, p])
                    np.add.at(total[p], index, np.append(x[:, p], np.ones((len(x), 1), np.int64), 1))
        part, entry = np.nonzero(total[:, :, -1])
        own = total[part, entry]
        offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * (width + 1))
        yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "sums": pa.ListArray.from_arrays(offsets, pa.array(own.ravel()))})

    found = vectors.select("v").mapInArrow(run, "part int, entry int, sums array<long>")
    return found.select("part", "entry", F.posexplode("sums").alias("place", "x")).groupBy("part", "entry", "place").agg(F.sum("x").alias("x")).collect()


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) of vectors (_id, v): they start as the parts of the least ids' vectors (equal ids by vector, null ids last)."""
    common.ready(vectors.sparkSession)
    first = vectors.orderBy(F.col("_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        total = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
        for r in _sums(vectors, books):
            total[r["part"], r["entry"], r["place"]] = r["x"]
        n = total[:, :, -1:]
        books = np.where(n > 0, total[:, :, :-1] // np.maximum(n, 1), books)
    return books


def encoded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """_id, _label, code (two hex digits a part), error (squared distances added up) of every vector; map only."""
    common.ready(vectors.sparkSession)
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("_id", "_label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                b = batch.slice(k, AT_ONCE)
                x = _matrix(b.column(2), len(trees))
                found = [t.nearest(x[:, p]) for p, t in enumerate(trees)]
                codes = np.stack([i for i, _ in found], 1)
                yield pa.RecordBatch.from_pydict({"_id": b.column(0), "_label": b.column(1), "code": pa.array(["".join(f"{c:02x}" for c in row) for row in codes.tolist()], pa.string()), "error": pa.array(sum(d for _, d in found), pa.int64())})

    return vectors.select("_id", "_label", "v").mapInArrow(run, f"_id {kinds['_id']}, _label {kinds['_label']}, code string, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray | None]:
    """_id, _label, code, error, label_error of every vector that can take part, and the codebooks (None if there is no vector).

    Vectors that are null or hold null or non-finite components are dropped. All
    others must be equally long, a multiple of `parts`, and within MOST once
    scaled, else ValueError. Repeated rows, null ids and null labels stay; null
    labels are one group. With fewer vectors than entries the codebooks are as
    short. Only the named columns are read, so no other can clash. An empty
    table gives no rows. entries is 256 at most, as a code has two hex digits.
    """
    if not 0 < entries <= 256:
        raise ValueError("1 to 256 entries")
    vectors = common.saved(whole_numbers(df, id_col, vec_col, label_col, scale))
    n, short, long, most = vectors.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v")), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()
    if not n:
        none = vectors.select("_id", "_label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none, None
    if short != long or not short or short % parts or most > MOST:
        raise ValueError(f"vectors of {short} to {long} components up to {most} cannot be cut into {parts} parts")
    books = train(vectors, parts, entries, rounds)
    codes = common.saved(encoded(vectors, books))
    common.dropped(vectors)
    totals = codes.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error"))
    # no hint: Spark broadcasts the totals if they are small, else it can split a hot label's rows
    out = codes.join(totals, F.col("_label").eqNullSafe(F.col("_of")), "left").select("_id", "_label", "code", "error", "label_error")
    return out, books


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    out, books = compress(common.table(spark, sf_dir, "embeddings"))
    return out.select(F.col("_id").alias("vec_id"), "code", "error", "label_error", F.lit("" if books is None else digest(books)).alias("codebooks_sha256"))


def _sql(width: int = 64) -> str:
    w = width // PARTS
    steps = [
        f"""WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT vec_id, part, v[part * {w} + 1 : part * {w} + {w}] AS x FROM v, range({PARTS}) r(part))",
        f"b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS e FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES}))",
    ]
    for k in range(ROUNDS + 1):
        # distance and entry in one number
        near = f"SELECT vec_id, part, any_value(x) AS x, min(list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 256 + entry) AS best FROM p JOIN b{k} USING (part) GROUP BY vec_id, part"
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, part, x, CAST(best // 256 AS BIGINT) AS d, CAST(best % 256 AS BIGINT) AS entry FROM ({near}))")
        if k < ROUNDS:
            steps.append(f"m{k} AS (SELECT part, entry, k, CAST(floor(sum(x[k]) / count(*)) AS BIGINT) AS c FROM a{k}, range(1, {w + 1}) r(k) GROUP BY ALL)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n, e) AS e FROM b{k} LEFT JOIN (SELECT part, entry, list(c ORDER BY k) AS n FROM m{k} GROUP BY ALL) USING (part, entry))")
    return f"""{", ".join(steps)}, c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY 1),
s AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS sha FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM c JOIN v USING (vec_id), s"""


OP13_SQL = _sql()
