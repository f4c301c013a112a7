"""Byte-level BPE encoding and decoding on padded numpy matrices (operator 4).

The distinct pre-tokens of a batch that are not ids by themselves are laid out
as matrices of symbol ids, one matrix for each length bucket, padded at the
right. In each round every row merges its leftmost pair of minimum rank; pairs
are looked up in an open-addressing hash table, and rows are compacted by
shifting what stands right of the merge. Finished rows leave the matrix. A
pre-token of more than WIDTH bytes fills several rows of a matrix of its own: the
round's pair is the leftmost minimum over these rows, pairs reach across their
ends, and only the rows that a merge touches are compacted.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

NONE = np.int32(2**31 - 1)
#: Cells of one matrix at most; longer buckets are cut into several matrices.
CELLS = 1 << 20
#: Symbols of one row at most.
WIDTH = 1024
#: Bytes of remembered pre-tokens and ids beyond which a worker starts afresh.
REMEMBERED = 32 << 20


class PairTable:
    """(left id, right id) -> merged id, by hashing with linear probing."""

    def __init__(self, pairs: dict[int, int]):
        self.bits = max(8, int(len(pairs) * 3).bit_length())
        self.mask = np.uint64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):  # each free slot takes one of those that want it; the rest move on
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = keys[free]
            placed = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[placed]] = values[placed]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & int(self.mask)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        flat = key.ravel()
        slot = self._slot(flat)
        out = np.full(len(flat), NONE, np.int32)
        todo = np.nonzero(flat >= 0)[0]
        while len(todo):
            at = slot[todo]
            found = self.keys[at]
            hit = found == flat[todo]
            out[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit & (found != -1)]
            slot[todo] = (slot[todo] + 1) & int(self.mask)
        return out.reshape(key.shape)

    def one(self, left: int, right: int) -> int:
        key = (left << 32) | right
        at = ((key * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) >> (64 - self.bits)
        while (found := self.keys.item(at)) != key:
            if found == -1:
                return int(NONE)
            at = (at + 1) & int(self.mask)
        return self.values.item(at)


class ByteBPE:
    """The merges of a rank file, and what this worker has already encoded."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern)
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        size = max(self.ranks.values()) + 1
        self.token = [b""] * size
        pairs: dict[int, int] = {}
        for token, i in self.ranks.items():
            self.token[i] = token
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = i
        self.pair = PairTable(pairs)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.split.findall(t) for t in texts]
        if self.held > REMEMBERED:
            self.known.clear()
            self.held = 0
        known = self.known
        new = {p for own in pieces for p in own if p not in known}
        if new:
            self._learn(new)
            self.held += sum(len(p) + len(known[p]) + 150 for p in new)
        return [b"".join(map(known.__getitem__, own)) for own in pieces]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def _learn(self, new: set[str]) -> None:
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in new:
            raw = p.encode("utf-8", "surrogatepass")
            i = self.ranks.get(raw)
            if i is not None:
                self.known[p] = i.to_bytes(4, "little")
            else:
                buckets.setdefault(max(2, (len(raw) - 1).bit_length()), []).append((p, raw))
        for bits, rows in buckets.items():
            width = 1 << bits
            if width > WIDTH:
                for p, raw in rows:
                    self.known[p] = self._in_rows(raw)
                continue
            step = max(1, CELLS // width)
            for k in range(0, len(rows), step):
                own = rows[k : k + step]
                for (p, _), ids in zip(own, self._matrix([raw for _, raw in own], width), strict=True):
                    self.known[p] = ids

    def _matrix(self, raws: list[bytes], width: int) -> list[bytes]:
        n = len(raws)
        length = np.fromiter(map(len, raws), np.int64, n)
        padded = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raws), np.uint8).reshape(n, width)
        column = np.arange(width)
        ids = np.where(column < length[:, None], self.byte_id[padded], -1).astype(np.int32)
        best = self._pairs(ids)
        out: list[bytes] = [b""] * n
        row = np.arange(n)
        while len(row):
            at = best.argmin(axis=1)  # the leftmost of equal ranks
            k = np.arange(len(row))
            merged = best[k, at]
            over = merged == NONE
            if over.any():
                for r, own in zip(row[over].tolist(), ids[over], strict=True):
                    out[r] = own[own >= 0].astype("<u4").tobytes()
                row, ids, best, at, merged = row[~over], ids[~over], best[~over], at[~over], merged[~over]
                k = np.arange(len(row))
                if not len(row):
                    break
            # compaction: what stands right of the merged pair moves one to the left
            ids[k, at] = merged
            source = column[None, :] + (column[None, :] > at[:, None])
            pad = source >= width
            source[pad] = width - 1
            ids = np.take_along_axis(ids, source, 1)
            ids[pad] = -1
            best = np.take_along_axis(np.concatenate([best, np.full((len(row), 1), NONE, np.int32)], 1), np.minimum(source[:, :-1], width - 1), 1)
            here = np.minimum(at, width - 2)
            best[k, here] = self.pair(ids[k, here], ids[k, np.minimum(here + 1, width - 1)])
            left = np.maximum(at - 1, 0)
            best[k, left] = self.pair(ids[k, left], ids[k, left + 1])
        return out

    def _pairs(self, ids: np.ndarray) -> np.ndarray:
        return self.pair(ids[:, :-1], ids[:, 1:])

    def _in_rows(self, raw: bytes) -> bytes:
        """One pre-token over several rows: the leftmost pair of minimum rank each round, as in _matrix()."""
        n, rows = len(raw), -(-len(raw) // WIDTH)
        ids, best = np.full(rows * WIDTH, -1, np.int32), np.full(rows * WIDTH, NONE, np.int32)
        ids[:n] = self.byte_id[np.frombuffer(raw, np.uint8)]
        best[: n - 1] = self.pair(ids[: n - 1], ids[1:n])
        ids, best = ids.reshape(rows, WIDTH), best.reshape(rows, WIDTH)
        size = [WIDTH] * (rows - 1) + [n - (rows - 1) * WIDTH]
        before, after = list(range(-1, rows - 1)), list(range(1, rows + 1))  # of the rows that are not empty
        low = best.min(1)

        def drop(row: int, at: int) -> None:
            """Compaction: what stands right of `at` moves one to the left."""
            last = size[row] - 1
            ids[row, at:last], best[row, at:last] = ids[row, at + 1 : last + 1], best[row, at + 1 : last + 1]
            ids[row, last], best[row, last], size[row] = -1, NONE, last

        while True:
            row = int(low.argmin())
            rank = int(low[row])
            if rank == NONE:
                return ids[ids >= 0].astype("<u4").tobytes()
            at = int(best[row].argmin())
            if at + 1 < size[row]:
                drop(row, at + 1)
            else:
                other = after[row]
                drop(other, 0)
                low[other] = best[other].min()
                if not size[other]:
                    after[row] = after[other]
                    if after[other] < rows:
                        before[after[other]] = row
            ids[row, at] = rank
            right = ids.item(row, at + 1) if at + 1 < size[row] else ids.item(after[row], 0) if after[row] < rows else -1
            best[row, at] = self.pair.one(rank, right) if right >= 0 else NONE
            if at:
                best[row, at - 1] = self.pair.one(ids.item(row, at - 1), rank)
            elif (left := before[row]) >= 0:
                end = size[left] - 1
                best[left, end] = self.pair.one(ids.item(left, end), rank)
                low[left] = best[left].min()
            low[row] = best[row].min()


@lru_cache(maxsize=2)
def codec(path: str) -> ByteBPE:
    import public_tokenizers

    return ByteBPE(path, public_tokenizers.PATTERN)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """ids array<int> and decoded binary of every whole text; map only.

    A null text counts as empty (no ids). Null ids and repeated rows pass
    through; very long texts are encoded whole; ties go to the leftmost pair;
    other columns are not read, so none can clash; an empty table gives no rows.
    """
    place = common.vocabulary("byte_bpe_50k.tiktoken", path)
    kind = df.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> dict:
        bpe = codec(place)
        ids = bpe.encode([t or "" for t in b.column(1).to_pylist()])
        arrays = [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
        flat = pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32))
        return {id_col: b.column(0), "ids": pa.ListArray.from_arrays(pa.array(offsets), flat), "decoded": pa.array([bpe.decode(x) for x in ids], pa.binary())}

    return common.map_batches(common.only(df, id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def encode_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of every whole text, by the same encoder.

    The same rules for nulls, repeated rows and empty tables as encode(); the
    ids stay in the worker, so that only digests leave it.
    """
    place = common.vocabulary("byte_bpe_50k.tiktoken", path)
    kind = df.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> dict:
        bpe = codec(place)
        ids = bpe.encode([t or "" for t in b.column(1).to_pylist()])
        return {
            id_col: b.column(0),
            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
        }

    return common.map_batches(common.only(df, id_col, text_col), run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_digest(common.table(spark, sf_dir, "documents"))
