"""Quality rules with compression bands (operator 5).

Besides word rules, the zstandard ratio (bytes over compressed bytes) of the
whole text and of its fixed chunks must lie inside bands: above them a text is
repetitive, below them it does not compress as prose does. Short texts compress
less, so each band holds for a range of lengths. Random letters and digits
(base64) have ratios of 1.05 to 1.25 below 1,024 bytes and about 1.31 above;
the least ratios of the fixed bands lie between those and prose. Ratios of
labelled good texts of about a text's length narrow
its band: what is stuffed with signs or fixed separators compresses
better than good texts as long. All labelled good texts teach, and the bands come
from their exact quantiles. The slack beyond their ratios falls steadily with
their number, so that no count of texts makes verdicts jump.

Every text is measured once; the bands and the verdicts are made from the measures.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.operators.order import numbered

from . import common

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 8
#: (bytes below which the band holds, least ratio, most ratio) of whole texts
BANDS = ((256, 0.0, 3.5), (512, 1.25, 4.0), (1024, 1.35, 4.5), (2048, 1.5, 5.0), (4096, 1.6, 5.0), (16384, 1.7, 6.0), (float("inf"), 1.7, 7.0))
#: A text fails if the chunks that leave this band hold more than this share of its bytes; a last chunk of under half a chunk belongs to the one before.
CHUNK, CHUNK_BAND, BAD_SHARE = 4096, (1.7, 6.0), 0.25
LEVEL = 3
#: Learned bands: length classes to a doubling, quantiles of their ratios, and the slack beyond these: SLACK, and SPREAD over the number of texts.
CLASSES, QUANTILES, SLACK, SPREAD = 4, (0.002, 0.998), 0.03, 0.5
Bands = dict[int, tuple[float, float]]
#: Counts of a text that judge() returns, with base_failed, kept and ratio.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_window_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows of so many words that occur twice or more, the first included."""
    n = len(words)
    m = n - window + 1
    if m < 2:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, n)
    h = np.zeros(m, np.uint64)
    for k in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + m]
    order = np.sort(h)
    if not (order[1:] == order[:-1]).any():
        return 0  # equal windows would hash alike
    # exact: name the windows of 1, 2, 4, 8 words by pairs of names
    name, span = ids.astype(np.int64), 1
    while span < window:
        pair = name[: len(name) - span] * np.int64(n) + name[span:]
        name = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        span *= 2
    twice = np.bincount(name)[name] > 1
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.nonzero(twice)[0], 1)
    np.add.at(edge, np.nonzero(twice)[0] + window, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    return sum(n - 1 for line, n in Counter(text.split("\n")).items() if n > 1 and WORDS.search(line))


def length_class(size: int) -> int:
    return int(CLASSES * math.log2(size)) if size else 0


def ratio_of(raw: bytes, compressor) -> float:
    return len(raw) / len(compressor.compress(raw)) if raw else 0.0


def fixed_band(size: int) -> tuple[float, float]:
    return next((low, high) for most, low, high in BANDS if size < most)


def bad_bytes(raw: bytes, compressor) -> int:
    """Bytes of the chunks that leave their band; a text of up to one chunk has none."""
    if len(raw) <= CHUNK:
        return 0
    bad = 0
    starts = range(0, len(raw) - CHUNK // 2 + 1, CHUNK)
    for k in starts:
        chunk = raw[k : k + CHUNK] if k < starts[-1] else raw[k:]
        if not CHUNK_BAND[0] <= ratio_of(chunk, compressor) <= CHUNK_BAND[1]:
            bad += len(chunk)
    return bad


def in_bands(size: int, ratio: float, bad: int, learned: Bands | None = None) -> bool:
    """Whether a text of so many bytes, this ratio and so many bytes in bad chunks lies in its bands."""
    if not size:
        return False
    low, high = fixed_band(size)
    own = (learned or {}).get(length_class(size), (low, high))
    return max(low, own[0]) <= ratio <= min(high, own[1]) and bad <= BAD_SHARE * size


def compression_verdict(raw: bytes, compressor, learned: Bands | None = None) -> tuple[float, bool]:
    """Ratio of the whole text, and whether it and the chunks of most of its bytes lie in their bands."""
    ratio = ratio_of(raw, compressor)
    return ratio, in_bands(len(raw), ratio, bad_bytes(raw, compressor), learned)


def fails_base(words: list[str], repeats: int) -> bool:
    return len(words) < 20 or 100 * repeats > 30 * len(words)


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, counts, base_failed, ratio, n_bytes, length_class and bad_bytes of every whole text; map only.

    A null or empty text has no words and fails. Null ids and repeated rows pass
    through; other columns are not read, so none can clash; an empty table gives no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> dict:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL)
        rows = []
        for t in b.column(1).to_pylist():
            t = t or ""
            words = WORDS.findall(t)
            repeats = repeated_window_words(words)
            raw = t.encode("utf-8", "surrogatepass")
            rows.append((len(words), sum(map(len, words)), len(SYMBOLS.findall(t)), duplicate_lines(t), repeats, fails_base(words, repeats), ratio_of(raw, compressor), len(raw), length_class(len(raw)), bad_bytes(raw, compressor)))
        columns = list(zip(*rows, strict=True))
        names = (*COUNTS, "base_failed", "ratio", "n_bytes", "length_class", "bad_bytes")
        kinds = (pa.int64(),) * 5 + (pa.bool_(), pa.float64(), pa.int64(), pa.int32(), pa.int64())
        return {"_id": b.column(0)} | {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)}

    counts = ", ".join(f"{c} long" for c in COUNTS)
    return common.map_batches(common.only(df, id_col, text_col), run, f"_id {kind}, {counts}, base_failed boolean, ratio double, n_bytes long, length_class int, bad_bytes long")


def learn(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Bands:
    """Length class -> least and most ratio, of all measured() rows labelled good that pass the word rules.

    A class of n such texts has the band of their quantiles (the values at ranks
    ceil(q n), one at the least, by exact row numbers) with a slack of SLACK +
    SPREAD / n, inside the fixed one. Null ids, labels and texts teach nothing, nor
    do ids labelled both ways. The driver gets one row and two ratios for each
    length class (under 150); without labelled texts, none. rows is read more than once.
    """
    good = (
        labels.select(common.quoted(id_col).alias("id"), common.quoted(label_col).cast("int").alias("y")).where("id IS NOT NULL")
        .groupBy("id").agg(F.min("y").alias("y")).where("y = 1").select("id")
    )
    teaching = rows.where("NOT base_failed").select(F.col("_id").alias("id"), F.col("length_class").alias("k"), "ratio").join(good, "id").select("k", "ratio")
    placed, _ = numbered(teaching, ["k", "ratio"], "at")
    classes = placed.groupBy("k").agg(F.min("at").alias("first"), F.count("*").alias("n")).collect()
    ends = {r["k"]: [r["first"] + max(1, math.ceil(q * r["n"])) - 1 for q in QUANTILES] for r in classes}
    at = {r["at"]: r["ratio"] for r in placed.where(F.col("at").isin([x for own in ends.values() for x in own])).select("at", "ratio").collect()}
    out = {}
    for r in classes:
        slack = SLACK + SPREAD / r["n"]
        low, high = fixed_band(2 ** (r["k"] / CLASSES))
        least, most = (at[x] for x in ends[r["k"]])
        out[r["k"]] = (max(low, least * (1 - slack)), min(high, most * (1 + slack)))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Bands:
    """learn() on the texts of docs; their measures are saved meanwhile."""
    rows = common.saved(measured(docs, id_col, text_col))
    try:
        return learn(rows, labels, id_col, label_col)
    finally:
        common.dropped(rows)


def judged(rows: DataFrame, learned: Bands | None = None, id_col: str = "doc_id") -> DataFrame:
    """The id, counts, base_failed, kept and ratio of measured() rows; map only.

    A text of a length that no labelled text taught is judged by the fixed band.
    """
    kind = rows.schema["_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)

    def run(b: pa.RecordBatch) -> dict:
        own = {id_col: b.column("_id")} | {n: b.column(n) for n in (*COUNTS, "base_failed")}
        verdicts = zip(*(b.column(n).to_pylist() for n in ("base_failed", "n_bytes", "ratio", "bad_bytes")), strict=True)
        kept = [not failed and in_bands(size, ratio, bad, learned) for failed, size, ratio, bad in verdicts]
        return own | {"kept": pa.array(kept, pa.bool_()), "ratio": b.column("ratio")}

    return common.map_batches(rows, run, f"`{id_col}` {kind}, {counts}, base_failed boolean, kept boolean, ratio double", whole=True)


def judge(df: DataFrame, learned: Bands | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base_failed, kept and ratio of every whole text: judged() of measured(); map only.

    A null or empty text has no words and fails; a very long one is judged
    whole. Null ids and repeated rows pass through; other columns are not read,
    so none can clash; an empty table gives no rows.
    """
    return judged(measured(df, id_col, text_col), learned, id_col)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    rows = common.saved(measured(docs))
    return judged(rows, learn(rows, labels.where(~common.held_out())))
