"""Near-duplicate classes by DartMinHash (operator 3).

A text is a weighted set: its shingles of five words, weighted by how often they
occur. Darts are a Poisson process over element x weight x time, drawn from
hashes, so that every text sees the same darts. A text keeps the darts that hit
its own region (an element, a height below its weight) up to a time by which
every coordinate is likely hit; the earliest dart of each coordinate is the
signature. Two texts agree at a coordinate with the probability of their
weighted Jaccard similarity.

Bands of the signature are joined. Equal texts are one node from the start. In
each bucket every node is held against one leader (the node that shares the most
bucket places), which settles groups of near copies without their pairs. What is
left are nodes in another component than their leader's. With d(x) the symmetric
difference of x and the leader, two sets differ by |d(x)| + |d(y)| - 2 |d(x) n d(y)|,
so a node that is not similar to the leader can only be similar to a node whose
difference shares elements with its own. How many follows from the sizes; of the
elements that more than one component has the rarest of each difference, just
enough of them that one must be shared, are joined, components first and then
nodes of different ones. That finds every similar pair of a bucket and stays
small where many texts of a group are almost similar, as their differences are
their own, and where large groups of copies share a bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words are runs of bytes other than space and 0x09 to 0x0D; in UTF-8 no other character holds these bytes.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
DARTS = COORDINATES * math.log(COORDINATES) + 2 * COORDINATES
#: Factor of the bands of differences: somewhat over the 1.25 that similar nodes can be apart by.
BAND = 1.26
#: Parts of a leader's nodes.
SALTS = 16
#: Words hashed by one prefix sum, and bytes beyond which a word is hashed by itself.
WORDS_AT_ONCE, LONG_WORD = 65_536, 256
#: Elements handled at once: their arrays stay in a core's cache.
AT_ONCE = 65_536


def _mix(x: np.ndarray) -> np.ndarray:
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    y ^= y >> np.uint64(27)
    y *= np.uint64(0x94D049BB133111EB)
    y ^= y >> np.uint64(31)
    return y


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / 2**53


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, n.bit_length())
        both = [np.full(size, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 2**64))]
        for p in both:
            p[0] = 1
        _powers[:] = [np.cumprod(p) for p in both]
    return _powers[0][:n], _powers[1]


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the text's words in order: polynomials in their bytes, from prefix sums."""
    import xxhash

    raw = text.encode("utf-8", "surrogatepass") if text else b""
    b = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(SPACE[b], prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    for k in range(0, len(starts), WORDS_AT_ONCE):
        first, last = starts[k : k + WORDS_AT_ONCE], ends[k : k + WORDS_AT_ONCE]
        part = b[first[0] : last[-1]]
        powers, inverse = _powers_to(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * powers, out=sums[1:])
        at = first - first[0]
        out[k : k + WORDS_AT_ONCE] = (sums[last - first[0]] - sums[at]) * inverse[at]
    size = ends - starts
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]])
    return _mix(out + size.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def shingles(text: str | None) -> np.ndarray:
    """64-bit hashes of the text's shingles in order; under five words, one of all words; no word, none."""
    own = word_hashes(text)
    if not len(own):
        return own
    size = min(SHINGLE, len(own))
    out = np.full(len(own) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + own[k : k + len(out)]
    return _mix(out)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = COORDINATES, darts: float = DARTS) -> np.ndarray:
    """Signatures (sets x k) of weighted sets (elements, counts of 1 or more); each set not empty."""
    blocks, block, held = [], [], 0
    for s in sets:
        block.append(s)
        held += len(s[0])
        if held >= AT_ONCE:
            blocks.append(_signed(block, k, darts))
            block, held = [], 0
    if block:
        blocks.append(_signed(block, k, darts))
    return np.concatenate(blocks)


def _signed(sets: list[tuple[np.ndarray, np.ndarray]], k: int, darts: float) -> np.ndarray:
    sign = np.zeros((len(sets), k), np.uint64)
    todo, factor = np.arange(len(sets)), 1.0
    while len(todo):
        element = np.concatenate([sets[i][0] for i in todo])
        weight = np.concatenate([sets[i][1] for i in todo]).astype(np.float64)
        owner = np.repeat(np.arange(len(todo)), [len(sets[i][0]) for i in todo])
        until = darts * factor / np.bincount(owner, weight, len(todo))
        ids, owners, times = [], [], []
        low, high = 0.0, 1.0  # heights in strips 0..1, 1..2, 2..4, 4..8 ...
        while len(element):
            stream = _mix(element + np.uint64((0x9E3779B97F4A7C15 * int(high)) & (2**64 - 1)))
            own, w, now, n = owner, weight, np.zeros(len(element)), 0
            while len(stream):
                left = (until[own] - now) * (high - low)  # darts that a stream is likely to throw yet
                m = int(min(1 + left.mean(), max(1, 4 * AT_ONCE // len(stream))))
                number = np.arange(n + 1, n + m + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
                n += m
                dart = _mix(stream[:, None] + number)
                gap = np.log(_unit(dart)) / (low - high)
                gap[:, 0] += now
                then = np.cumsum(gap, 1)
                on = then <= until[own][:, None]
                dart, thrown = dart[on], np.repeat(own, on.sum(1))
                if high == 1.0:  # weights are counts: the first strip is inside every region
                    hit = slice(None)
                else:
                    hit = low + (high - low) * (1 - _unit(_mix(dart ^ np.uint64(0xA5A5A5A5A5A5A5A5)))) < np.repeat(w, on.sum(1))
                ids.append(dart[hit])
                owners.append(thrown[hit])
                times.append(then[on][hit])
                go = on[:, -1]
                stream, own, w, now = stream[go], own[go], w[go], then[go, -1]
            more = weight > high
            element, weight, owner = element[more], weight[more], owner[more]
            low, high = high, 2 * high
        ids, owners, times = np.concatenate(ids), np.concatenate(owners), np.concatenate(times)
        late = np.argsort(-times, kind="stable")  # the earliest is written last and stays
        ids, owners = ids[late], owners[late]
        cell = owners * k + (_mix(ids + np.uint64(0x632BE59BD9B4E019)) % np.uint64(k)).astype(np.int64)
        flat, hit = np.zeros(len(todo) * k, np.uint64), np.zeros(len(todo) * k, bool)
        flat[cell], hit[cell] = ids, True
        sign[todo] = flat.reshape(-1, k)
        todo, factor = todo[~hit.reshape(-1, k).all(1)], factor * 2
    return sign


def tokens(text: str | None) -> np.ndarray:
    """The text's weighted set as a sorted plain one: the n-th occurrence of a shingle is an element of its own."""
    s = np.sort(shingles(text))
    if not len(s):
        return s
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    nth = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
    return np.sort(np.where(nth == 0, s, _mix(s + nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))))


def _banded(b: pa.RecordBatch) -> dict:
    keys, sets, done = [], [], set()
    for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
        if key in done:
            continue
        done.add(key)
        s = shingles(text)
        if len(s):
            keys.append(key)
            sets.append(np.unique(s, return_counts=True))
    sign = signatures(sets) if sets else np.zeros((0, COORDINATES), np.uint64)
    hashes = np.zeros((len(keys), BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(len(keys), band + 1, np.uint64)
        for r in range(ROWS):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + sign[:, band * ROWS + r])
        hashes[:, band] = h
    offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS)
    return {"key": pa.array(keys, pa.binary()), "bands": pa.ListArray.from_arrays(offsets, pa.array(hashes.ravel().view(np.int64)))}


def _elements(b: pa.RecordBatch) -> dict:
    return {"key": b.column(0), "elements": pa.array([tokens(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())}


def similar(n_x: int, n_y: int, apart: int) -> bool:
    """Whether sets of these sizes, with so many elements in just one of them, have a Jaccard similarity of THRESHOLD or more."""
    return n_x + n_y - apart >= THRESHOLD * (n_x + n_y + apart)


def _differences(b: pa.RecordBatch) -> dict:
    """Of node and leader: whether they are similar, their sizes, and the elements that just one of them has."""
    near, sizes, of, apart = [], [], [], []
    for x, y in zip(b.column(2), b.column(3), strict=True):
        x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
        d = np.setxor1d(x, y, assume_unique=True)
        near.append(similar(len(x), len(y), len(d)))
        sizes.append(len(x))
        of.append(len(y))
        apart.append(d.view(np.int64))
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in apart])]).astype(np.int32)
    return {
        "key": b.column(0), "leader": b.column(1), "near": pa.array(near, pa.bool_()), "n": pa.array(sizes, pa.int64()), "n_leader": pa.array(of, pa.int64()),
        "apart": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(apart))),
    }


def element_sets(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """key and elements of the distinct texts with these keys, saved.

    Texts are shuffled rather than their sets, which are larger; copies of a
    text meet before the shuffle, so that a hot one is no task's load. The join is a
    merge join at every size: a broadcast of the keys would only hold for small inputs.
    """
    # an inner join, as a semi-join would be pushed below the grouping
    own = texts.groupBy("key").agg(F.first("text").alias("text")).join(keys.hint("merge"), "key")
    return common.saved(common.map_batches(own, _elements, "key binary, elements binary"))


def _held(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """_differences() of pairs (key, leader)."""
    joined = pairs.join(sets, "key").join(sets.select(F.col("key").alias("leader"), F.col("elements").alias("own")), "leader")
    return common.map_batches(joined.select("key", "leader", "elements", "own"), _differences, "key binary, leader binary, near boolean, n long, n_leader long, apart array<long>")


def components(edges: DataFrame) -> DataFrame:
    """key, root (the least key of its component) of every key in an edge (a, b); by label propagation with jumps."""
    both = common.saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = common.saved(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("m")).select("key", F.least("key", "m").alias("root")))
    while True:
        labels = now.select("key", "root")
        heard = both.join(labels.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("root").alias("heard"))
        step = labels.join(heard, "key").select("key", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        jump = labels.select(F.col("key").alias("root"), F.col("root").alias("further"))
        new = common.saved(step.join(jump, "root").select("key", "old", F.least("root", "further").alias("root")))
        changed = new.where("root != old").limit(1).count()
        common.dropped(now)
        now = new
        if not changed:
            common.dropped(both)
            return now


def _band(total: Column) -> Column:
    return F.floor(F.log(total) / math.log(BAND)).cast("int")


def ranked_differences(held: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes held against leaders that have a node of another component: leader, key, root, n, d, asks, rare, band.

    rare has the elements of the node's difference that nodes of two or more
    components have under this leader, the least frequent first: only such can be
    shared by a pair that is looked for. asks: the node is of another component
    than its leader. band: place of d + |leader| on a scale of factor BAND.
    """
    root = lambda key, name: roots.select(F.col("key").alias(key), F.col("root").alias(name))
    named = held.join(root("key", "root"), "key", "left").join(root("leader", "main"), "leader", "left")
    named = common.saved(named.select("leader", "key", "n", "n_leader", "apart", F.coalesce("root", "key").alias("root"), (F.coalesce("root", "key") != F.coalesce("main", "leader")).alias("asks")))
    open_ = named.groupBy("leader").agg(F.max("asks").alias("asked"), F.count("*").alias("nodes")).where("asked AND nodes > 1")
    # the nodes of a leader that many have are dealt over several tasks
    salted = named.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    own = salted.join(open_.select("leader", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")), ["leader", "_salt"]).drop("_salt").withColumn("d", F.size("apart").cast("long"))
    spread = common.saved(own.select("leader", "key", "root", F.explode("apart").alias("element")))
    shared = spread.groupBy("leader", "element").agg(F.count("*").alias("often"), F.min("root").alias("one"), F.max("root").alias("other")).where("one != other")
    placed = spread.join(shared, ["leader", "element"]).groupBy("leader", "key").agg(F.array_sort(F.collect_list(F.struct("often", "element"))).alias("rare"))
    out = common.saved(own.drop("apart").join(placed, ["leader", "key"]).withColumn("band", _band(F.col("d") + F.col("n_leader"))))
    common.dropped(named, spread)
    return out


def meetings(ranked: DataFrame) -> tuple[DataFrame, DataFrame, tuple[DataFrame, ...]]:
    """Pairs of components, and of their nodes, that meet at an element of a leader, before any condition; and the saved tables that both read.

    Nodes of another component than the leader's probe, all others answer. Of a
    prober x and any y similar to it at least (9 |d(x)| + 9 |d(y)| - |x| - |y|) / 18
    elements of d(x) are in d(y), by the definition of similarity; the bounds below
    follow from |d(y)| >= ||y| - |leader||, |y| <= 1.25 |x| and 9 |d(x)| > |x| + |leader|.
    As |d(x)| and |d(y)| differ by (|x| + |y|) / 9 at most, d + |leader| of the two differ
    by a factor of 1.25 at most: bands more than one apart never meet. Components
    meet before their nodes do, so that no two nodes of one component are ever paired.
    """
    m, d, n, of = F.size("rare"), F.col("d"), F.col("n"), F.col("n_leader")
    ask = F.greatest(F.lit(1), F.ceil((9 * d - n - of) / 18), F.ceil(d - n / 4))
    answer = F.greatest(F.lit(1), F.ceil((9 * d + of + 1 - n) / 18), F.ceil(d - n / 4), F.ceil((9 * (d + F.floor(F.pow(F.lit(BAND), F.col("at")) * (1 - 1e-9)) - of) - 2.25 * n) / 18))
    around = F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))).alias("at")

    def met(rows: DataFrame, least: Column, prefix: str) -> DataFrame:
        first = F.slice("rare", F.lit(1), F.greatest(F.lit(0), m - least + 1).cast("int"))
        rows = rows.withColumn("first", first).where(F.size("first") > 0)
        return common.saved(rows.select("leader", "at", F.explode(F.transform("first", lambda e: e["element"])).alias("element"), *(F.col(c).alias(f"{prefix}_{c}") for c in ("key", "root", "n", "d", "asks"))))

    place = ["leader", "element", "at"]
    asking = met(ranked.where("asks").withColumn("at", F.col("band")), ask, "x")
    answering = met(ranked.select("*", around), answer, "y")
    groups = lambda rows, root: rows.select(*place, root).distinct()
    across = groups(asking, "x_root").join(groups(answering, "y_root"), place)
    nodes = across.where("x_root != y_root").join(asking, [*place, "x_root"]).join(answering, [*place, "y_root"])
    return across, nodes, (asking, answering)


def close_pairs(held: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Similar pairs (a, b) of different components among the nodes held against one leader, none left out."""
    ranked = ranked_differences(held, roots)
    _, met, read = meetings(ranked)
    possible = F.expr("5 * x_n >= 4 * y_n AND 5 * y_n >= 4 * x_n AND 9 * abs(x_d - y_d) <= x_n + y_n AND (NOT y_asks OR x_key < y_key)")
    pairs = common.saved(met.where(possible).select(F.least("x_key", "y_key").alias("key"), F.greatest("x_key", "y_key").alias("leader")).distinct())
    out = common.saved(_held(pairs, sets).where("near").select(F.col("key").alias("a"), F.col("leader").alias("b")))
    common.dropped(ranked, pairs, *read)
    return out


def led(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The leader round over texts (key, text), each with a word: nodes held against their buckets' leaders, components of similar ones, sets; all saved."""
    sign = common.map_batches(texts, _banded, "key binary, bands array<long>").groupBy("key").agg(F.first("bands").alias("bands"))
    spread = common.saved(sign.select("key", F.explode("bands").alias("bucket")))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("places")).where("places > 1")
    live = common.saved(spread.join(sizes, "bucket"))
    common.dropped(spread)
    reach = live.groupBy("key").agg(F.sum("places").alias("reach"))
    leaders = live.join(reach, "key").groupBy("bucket").agg(F.max(F.struct("reach", "key")).alias("l")).select("bucket", F.col("l.key").alias("leader"))
    star = live.join(leaders, "bucket").where("key != leader").select("key", "leader").distinct()
    sets = element_sets(texts, live.select("key").distinct())
    held = common.saved(_held(star, sets))
    common.dropped(live)
    return held, components(held.where("near").select(F.col("key").alias("a"), F.col("leader").alias("b"))), sets


def node_roots(texts: DataFrame) -> DataFrame:
    """key, root of the keys (digests) of texts that have a near copy, saved; texts are (key, text), each with a word."""
    held, roots, sets = led(texts)
    more = close_pairs(held, roots, sets)
    common.dropped(held, sets)
    if not more.limit(1).count():
        common.dropped(more)
        return roots
    root = lambda side: roots.select(F.col("key").alias(side), F.col("root").alias(f"{side}_root"))
    ends = common.saved(more.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")))
    joined = components(ends)
    merged = joined.select(F.col("key").alias("old"), F.col("root").alias("new"))
    nodes = roots.select("key", "root").union(ends.select("a", "a").union(ends.select("b", "b"))).distinct()
    out = common.saved(nodes.join(merged, nodes["root"] == merged["old"], "left").select("key", F.coalesce("new", "root").alias("root")).distinct())
    common.dropped(more, ends, joined, roots)
    return out


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _key (digest of the text), _root (of the class), _blank, class_id and n_copies of every row.

    A class is a component of texts linked by a weighted Jaccard similarity of
    at least 0.8; class_id is the least id of its rows. Texts without a word
    (null, empty, white space) are alone: their class is their own id. Texts of
    under five words are similar only if they are the same words. Null ids are
    ignored for the least id; a class of null ids only has a null class_id. Where
    ids repeat with different texts, two classes can have the same class_id, but
    not the same _root. Repeated rows are copies. Very long texts are taken
    whole. An empty table gives no rows. Only the two named columns are read, so
    no other column can clash.
    """
    text = common.quoted(text_col)
    rows = df.select(common.quoted(id_col).alias("_id"), F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))
    texts = rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("key", "text")
    found = node_roots(texts)
    roots = found.select("key", "root")
    copies = rows.groupBy("key").agg(F.min("_id").alias("least"), F.count("*").alias("n"))
    known = common.saved(roots.join(copies, "key"))
    common.dropped(found)
    least = known.groupBy("root").agg(F.min("least").alias("class_least"), F.sum("n").alias("class_n"))
    named = known.join(least, "root").select("key", "root", "class_least", "class_n")
    whole = copies.join(named, "key", "left").select(F.col("key").alias("_key"), F.coalesce("root", "key").alias("_root"), F.coalesce("class_least", "least").alias("class_id"), F.coalesce("class_n", "n").alias("n_copies"))
    ids = rows.select("_id", F.col("key").alias("_key"), (F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("_blank"))
    # saved, so that both sides of the join are dealt anew and Spark can split the rows of a hot text
    whole = common.saved(whole)
    common.dropped(known)
    out = ids.join(whole.hint("merge"), "_key", "left")
    return out.select("_id", "_key", "_root", "_blank", F.when(F.col("_blank"), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(F.col("_blank"), F.lit(1).cast("long")).otherwise(F.col("n_copies")).alias("n_copies"))


def _row_digest(own_id: Column, key: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.concat(F.lit("="), own_id.cast("string")), F.lit("null")), F.coalesce(F.hex(key), F.lit("null"))).cast("binary")))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each class: that of the least id (null ids last), and of its least text digest.

    All columns are kept, whatever their names. Of rows with equal id and text
    one stays, any of them where other columns differ. Texts without a word
    stay, but for rows that repeat the same id and text. Null ids of one class
    count as one class like any other. An empty table gives no rows.
    """
    found = classes(df, id_col, text_col)
    group = F.when(F.col("_blank"), F.concat_ws("|", F.lit("blank"), F.coalesce(F.concat(F.lit("="), F.col("_id").cast("string")), F.lit("null")), F.coalesce(F.hex("_key"), F.lit("null")))).otherwise(F.hex("_root"))
    best = found.groupBy(group.alias("_group")).agg(F.min(F.struct(F.col("_id").isNull().alias("z"), "_id", "_key")).alias("m"))
    (mine,) = common.private(df, "_row")
    stay = common.saved(best.select(_row_digest(F.col("m._id"), F.col("m._key")).alias(mine)))
    keyed = df.withColumn(mine, _row_digest(common.quoted(id_col), F.unhex(F.md5(common.quoted(text_col).cast("binary")))))
    return keyed.join(stay, mine, "left_semi").dropDuplicates([mine]).drop(mine)


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents")).select(F.col("_id").alias("doc_id"), "class_id", "n_copies")
