"""Approximate nearest neighbours by a permutation index (operator 9).

Every vector is represented by its nearest pivots in order, and posted in the
inverted files of the nearest few. A query goes to the files of its own nearest
pivots only. There the entries are ranked by footrule distance between their
order of pivots and the query's; those of smallest footrule are reranked by exact
distance. Of an entry that stands in several of a query's files only the file
of the pivot nearest to the query looks at it. A file is not read if by its
reach, the greatest distance of an entry to its pivot, all of it must be farther
than the k-th nearest of a small sample. Files are split into blocks, so
that a dense cluster's pivot is many blocks and no task holds a whole file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from . import common

#: Pivots, chosen far apart among the vectors of smallest id hash, so many.
PIVOTS, PIVOT_SAMPLE = 256, 1024
#: Nearest pivots in whose files a vector is posted, and those whose files a query reads.
POSTED, PROBED = 3, 80
#: Nearest pivots of which footrule distances are made.
NEAREST = 48
#: Share of a block's entries that is reranked, and the least number of them.
RERANK, RERANK_LEAST = 0.3, 16
BLOCK, QUERY_BLOCK = 2048, 512


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v (array<double>) of the rows that take part: id and vector not null, components finite, not all zero."""
    v = common.quoted(vec_col).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(common.quoted(id_col).cast("long").alias("id"), v.alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(F.forall("v", fine), F.lit(False)) & F.exists("v", lambda x: x != 0))


def sampled(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of PIVOT_SAMPLE rows, those of the commonest length among them."""
    sample = rows.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(PIVOT_SAMPLE).collect()
    sizes = [len(r["v"]) for r in sample]
    if not sizes:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    dim = max(sorted(set(sizes)), key=sizes.count)
    own = [r for r in sample if len(r["v"]) == dim]
    return np.array([r["id"] for r in own], np.int64), np.array([r["v"] for r in own])


def pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """At most so many distinct vectors of the sample, each the farthest from those before it.

    Pivots drawn at random would crowd in a dense cluster, and the order among
    crowded pivots tells nothing about vectors elsewhere.
    """
    if not len(sample):
        return sample
    x = np.array(list(dict.fromkeys(map(tuple, sample.tolist()))))
    chosen, gap = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < most and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def within(ids: np.ndarray, x: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """A distance within which each row has k others at least, by the sample; infinite if that is too small to tell."""
    if len(sample) <= k:
        return np.full(len(x), np.inf)
    own, of = (x**2).sum(1), (sample**2).sum(1)
    d = own[:, None] + of - 2 * x @ sample.T
    d[ids[:, None] == sample_ids] = np.inf
    near = np.partition(d, k - 1, axis=1)[:, k - 1]
    # rounded up by more than the differences can be wrong by
    return np.sqrt(np.maximum(near, 0) + 1e-9 * (own + of.max()))


def places(x: np.ndarray, p: np.ndarray, nearest: int) -> np.ndarray:
    """The nearest pivots of each row in order."""
    d = (p**2).sum(1)[None, :] - 2 * x @ p.T
    return np.argsort(d, axis=1, kind="stable")[:, :nearest].astype(np.int16)


def few_copies(rows: DataFrame, k: int) -> DataFrame:
    """rows without those of which 2 k others with the same vector come before; no answer of k can hold them.

    k rows of an id and vector, then 2 k rows of a vector, by id: if k of these
    have a query's own id, k are left. Spark limits ranks before the shuffle, so
    that a vector which is a third of all rows is no hot key.
    """
    once = rows.withColumn("_r", F.row_number().over(Window.partitionBy("v", "id").orderBy("id"))).where(F.col("_r") <= k).drop("_r")
    return once.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_r") <= 2 * k).drop("_r")


def posted(rows: DataFrame, p: np.ndarray, files: int, keep: int, kind: str, bound=None) -> DataFrame:
    """A row (pivot, id, vector, order, far, part) for each of the nearest `files` pivots of each vector; order holds the nearest `keep`, far is the pivot's distance.

    bound: reach of each file, and a function of ids and vectors that gives the
    distance beyond which nothing is looked for; files wholly beyond it get no row.
    part is the share of the files that got one. Vectors are kept in the numbers they came in (kind <f4 or <f8), which lose nothing.
    """

    def run(b: pa.RecordBatch) -> dict:
        x = np.array(b.column(1).to_pylist(), np.float64)
        order = places(x, p, keep)
        home = order[:, :files]
        far = np.sqrt(((x[:, None, :] - p[home]) ** 2).sum(2))
        use = np.ones(home.shape, bool)
        if bound is not None:
            reach, limit = bound
            use = far * (1 - 1e-9) - reach[home] * (1 + 1e-9) <= limit(b.column(0).to_numpy(zero_copy_only=False), x)[:, None]
        each, part = np.nonzero(use)[0], use.mean(1)
        raw, nearest = [v.tobytes() for v in x.astype(kind)], [o.tobytes() for o in order]
        return {
            "pivot": pa.array(home[use].astype(np.int32)), "id": b.column(0).take(pa.array(each)),
            "vector": pa.array([raw[i] for i in each], pa.binary()), "order": pa.array([nearest[i] for i in each], pa.binary()), "far": pa.array(far[use]), "part": pa.array(part[each]),
        }

    return common.map_batches(rows.where(F.size("v") == p.shape[1]), run, "pivot int, id long, vector binary, order binary, far double, part double")


def blocks(entries: DataFrame, n_pivots: int, size: int, name: str) -> tuple[DataFrame, np.ndarray]:
    """pivot and up to `size` entries of its file in each row: ids, vectors, orders and parts as binaries; saved. And each file's reach.

    A pivot's entries are spread by hash over so many groups that each is about
    one block. The driver gets one count and reach for each pivot.
    """
    held = common.saved(entries)
    counts, reach = {}, np.zeros(n_pivots)
    for r in held.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        counts[r["pivot"]], reach[r["pivot"]] = r["n"], r["far"]
    groups = F.array(*(F.lit(-(-counts.get(k, 0) // size) or 1) for k in range(n_pivots)))
    group: Column = F.pmod(F.xxhash64("id", F.lit(9)), F.get(groups, "pivot")).alias("group")
    dealt = held.select("pivot", group, "id", "vector", "order", "part").repartition("pivot", "group").sortWithinPartitions("pivot", "group")

    def block(pivot: int, rows: list[tuple]) -> pa.RecordBatch:
        ids, vectors, orders, parts = zip(*rows, strict=True)
        columns = {"ids": np.array(ids, "<i8").tobytes(), "vectors": b"".join(vectors), "orders": b"".join(orders), "parts": np.array(parts, "<f8").tobytes()}
        return pa.RecordBatch.from_pydict({"pivot": pa.array([pivot], pa.int32())} | {f"{name}_{k}": pa.array([v], pa.binary()) for k, v in columns.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for b in batches:
            for pivot, g, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and ((pivot, g) != at or len(rows) == size):
                    yield block(at[0], rows)
                    rows = []
                at = (pivot, g)
                rows.append(row)
        if rows:
            yield block(at[0], rows)

    out = common.saved(dealt.mapInArrow(run, f"pivot int, {name}_ids binary, {name}_vectors binary, {name}_orders binary, {name}_parts binary"))
    common.dropped(held)
    return out, reach


def search_block(pivot: int, q_ids, q, asked, parts, ids, x, order, n_pivots: int, files: int, k: int, share: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: ids and distances of the nearest found among a block of one pivot's entries, by footrule, then exact.

    share: of the entries that is reranked by a query that reads all its files; one that reads a part of them reranks as much more of each.
    """
    n, nearest = len(ids), min(NEAREST, order.shape[1])
    # the block inverted: each pivot's place in each entry's order, `nearest` if it is not among those
    inverted = np.full((n_pivots, n), nearest, np.int16)
    inverted[order[:, :nearest].ravel(), np.repeat(np.arange(n), nearest)] = np.tile(np.arange(nearest, dtype=np.int16), n)
    at = np.arange(nearest, dtype=np.int16)[:, None]
    homes = order[:, :files]
    by_id = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    for i in range(len(q_ids)):
        place = np.full(n_pivots, n_pivots, np.int16)
        place[asked[i]] = np.arange(len(asked[i]), dtype=np.int16)
        # entries for which no other file nearer to the query is read
        own = np.flatnonzero((place[homes].min(1) == place[pivot]) & (ids != q_ids[i]))
        keep = max(RERANK_LEAST, k, int(np.ceil(min(1.0, share / parts[i]) * len(own))))
        if keep < len(own):
            # up to a constant: |place - at| of the query's pivots, and what the entry's other pivots lack to `nearest`
            read = inverted[asked[i][:nearest]][:, own]
            foot = (np.abs(read - at) + read).sum(0, dtype=np.int64)
            own = own[np.argpartition(foot * n + by_id[own], keep - 1)[:keep]]
        d = np.sqrt(((x[own] - q[i]) ** 2).sum(1))
        best = np.lexsort((ids[own], d))[:k]
        yield i, ids[own[best]], d[best]


def _met(index: DataFrame, asked: DataFrame, p: np.ndarray, files: int, k: int, share: float, kind: str) -> DataFrame:
    """query_id, vec_id, score of the nearest that each query finds in each block of the files it reads."""
    q, _ = blocks(asked, len(p), QUERY_BLOCK, "q")
    dim, n_pivots = p.shape[1], len(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                v_ids, v, v_orders, q_ids, qs, q_orders, parts = (np.frombuffer(b.column(j)[r].as_buffer(), t) for j, t in enumerate(("<i8", kind, "<i2", "<i8", kind, "<i2", "<f8"), 1))
                v, qs = v.astype(np.float64), qs.astype(np.float64)
                found = [
                    (np.full(len(i), q_ids[m]), i, d)
                    for m, i, d in search_block(b.column(0)[r].as_py(), q_ids, qs.reshape(-1, dim), q_orders.reshape(len(q_ids), -1), parts, v_ids, v.reshape(-1, dim), v_orders.reshape(len(v_ids), -1), n_pivots, files, k, share)
                ]
                a, i, d = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(d, pa.float64())})

    pairs = index.join(q, "pivot").select("pivot", "v_ids", "v_vectors", "v_orders", "q_ids", "q_vectors", "q_orders", "q_parts")
    return common.saved(pairs.mapInArrow(run, "query_id long, vec_id long, score double"))


def search(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", n_pivots: int = PIVOTS, n_posted: int = POSTED, n_probed: int = PROBED) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found, all candidates if fewer.

    Vectors null, zero, of another length than the pivots', or with null or
    non-finite components take no part, nor do null ids. A query's own id is
    not among its candidates; repeated ids are candidates of their own; a
    query id that occurs twice is asked once (its smallest vector). Ties go to
    the smaller id. Queries that find fewer than k in their files are asked
    again, exactly, in all files. Only the two named columns are read, so no
    other can clash. An empty table gives no rows.
    """
    spark = df.sparkSession
    common.ready(spark)
    rows = usable(df, id_col, vec_col)
    sample_ids, sample = sampled(rows)
    p = pivots(sample, n_pivots)
    if not len(p):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    files, probed, keep = min(n_posted, len(p)), min(n_probed, len(p)), min(NEAREST, len(p))
    kind = "<f4" if df.schema[vec_col].dataType == ArrayType(FloatType(), df.schema[vec_col].dataType.containsNull) else "<f8"
    index, reach = blocks(posted(few_copies(rows, k), p, files, max(keep, files), kind), len(p), BLOCK, "v")
    asked = usable(queries, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))
    bound = (reach, lambda ids, x: within(ids, x, sample_ids, sample, k))
    found = _met(index, posted(asked, p, probed, max(keep, probed), kind, bound), p, files, k, RERANK, kind)
    full = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= k).select("id")
    short = common.saved(asked.join(full, "id", "left_anti"))
    if short.limit(1).count():
        again = _met(index, posted(short, p, len(p), len(p), kind), p, files, k, 1.0, kind)
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").union(again)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 100 = 0"))
