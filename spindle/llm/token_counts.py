"""Token counts by heap-and-linked-list byte-pair merging (operator 1).

Each text is split where no vocabulary piece can reach across (before a run of
word marks, and around line feeds); each distinct segment is merged once per
worker: the adjacent pair of best rank is popped from a heap, its two symbols
are joined in a linked list, and the new neighbours are pushed. The count is
the initial symbols less the merges; no identifiers are made.
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

MARK = "▁"
#: A worker remembers the distinct segments of the last one to two times so many bytes. Bounds memory only.
REMEMBERED = 32 << 20
_SEGMENTS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


class SegmentCounts(dict):
    """segment -> tokens, for the pieces of one sentencepiece BPE model."""

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        scores = sorted({sp.get_score(i) for i in plain}, reverse=True)
        place = {x: k for k, x in enumerate(scores)}
        #: piece -> rank; the smaller merges first
        self.rank = {sp.id_to_piece(i): place[sp.get_score(i)] for i in plain}
        self.singles = {p for p in self.rank if len(p) == 1}
        self.older: dict[str, int] = {}
        self.held = 0
        if any("\n" in p or MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece of this model reaches across words or lines")

    def __missing__(self, segment: str) -> int:
        n = self.older.get(segment)
        if n is None:
            n = self.merged(segment)
        if self.held >= REMEMBERED:
            self.older = dict(self)
            self.clear()
            self.held = 0
        self.held += 2 * len(segment) + 130
        self[segment] = n
        return n

    def merged(self, segment: str) -> int:
        """Symbols left of one segment after all merges.

        The heap holds rank * n + left for each adjacent pair whose union is a
        piece: the smallest is the best rank and, among equals, the leftmost. A
        popped entry counts only if that pair still stands at that rank. A
        symbol outside the vocabulary never merges; it falls back to one token
        per byte.
        """
        get, n = self.rank.get, len(segment)
        count = n
        if not self.singles.issuperset(segment):
            count += sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c in segment if c not in self.singles)
        heap = [r * n + i for i in range(n - 1) if (r := get(segment[i : i + 2])) is not None]
        if not heap:
            return count
        heapify(heap)
        symbol, before, after = list(segment), list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            r, a = divmod(heappop(heap), n)
            b = after[a]
            if b >= n:
                continue
            both = symbol[a] + symbol[b]
            if get(both) != r:
                continue
            symbol[a] = both
            count -= 1
            after[a] = c = after[b]
            after[b] = n  # b is gone
            if c < n:
                before[c] = a
                if (r := get(both + symbol[c])) is not None:
                    heappush(heap, r * n + a)
            if (c := before[a]) >= 0 and (r := get(symbol[c] + both)) is not None:
                heappush(heap, r * n + c)
        return count


@lru_cache(maxsize=2)
def _counts(path: str) -> SegmentCounts:
    return SegmentCounts(path)


def text_tokens(text: str | None, counts: SegmentCounts) -> int:
    if not text:
        return 0
    return sum(map(counts.__getitem__, _SEGMENTS.findall(MARK + text.replace(" ", MARK))))


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, model_path: str | None = None) -> DataFrame:
    """n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    A null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated
    rows; null ids pass through; other columns are not read; an empty table
    gives an empty result. Map only: nothing is shuffled or collected.
    """
    path = common.vocabulary("piece_bpe_32k.model", model_path)
    kind = df.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> dict:
        counts = _counts(path)
        texts = b.column(1).to_pylist()
        tokens = [text_tokens(t, counts) for t in texts]
        return {
            id_col: b.column(0),
            "n_bytes": pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], pa.int64()),
            "n_tokens": pa.array(tokens, pa.int64()),
            "over_limit": pa.array([n > limit for n in tokens], pa.bool_()),
        }

    return common.map_batches(common.only(df, id_col, text_col), run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"))
