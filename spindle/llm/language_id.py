"""Language identification by segmentation-marginalised unigrams (operator 7).

Each language has probabilities of the pieces of a fixed public vocabulary. The
probability of a word is the sum, over all its segmentations into pieces, of
the products of their probabilities (forward algorithm); a text's is the
product over its words. The probabilities are learned as expected counts over
all segmentations of the training words (forward-backward from equal
probabilities), smoothed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
LETTERS = regex.compile(r"\p{L}+")
#: Characters of the words that are scored at once, and after how many the forward sums are scaled.
AT_ONCE, SCALED = 1 << 17, 8
#: A character that no piece covers.
UNKNOWN = 1e-7
SMOOTH = 0.05
#: Bytes of remembered words beyond which a worker starts afresh.
REMEMBERED = 64 << 20
_BASE = np.uint64(0x100000001B3)


class Pieces:
    """Hash table of the vocabulary's pieces by a rolling hash of their characters."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
        self.names = sorted({sp.id_to_piece(i).lower() for i in plain})
        self.longest = max(map(len, self.names))
        keys = np.array([self._hash(p) for p in self.names], np.uint64)
        self.bits = 19
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.key = np.zeros(1 << self.bits, np.uint64)
        for i, (k, s) in enumerate(zip(keys, self._slot(keys).tolist(), strict=True)):
            while self.table[s] >= 0:
                s = (s + 1) & ((1 << self.bits) - 1)
            self.table[s], self.key[s] = i, k

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c)) & ((1 << 64) - 1)
        return h

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of the piece with this hash, or -1."""
        slot = self._slot(keys)
        out = self.table[slot]
        wrong = np.nonzero((out >= 0) & (self.key[slot] != keys))[0]
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            out[wrong] = self.table[slot[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.key[slot[wrong]] != keys[wrong])]
        return out

    def lattice(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of every piece in words of equal length, by end; piece -1: an unknown character."""
        n, size = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, size).astype(np.uint64)
        prefix = np.zeros((size + 1, n), np.uint64)
        for k in range(size):
            prefix[k + 1] = prefix[k] * _BASE + codes[:, k]
        found, power = [], 1
        for length in range(1, min(self.longest, size) + 1):
            power = (power * int(_BASE)) & ((1 << 64) - 1)
            own = self.find((prefix[length:] - prefix[:-length] * np.uint64(power)).ravel()).reshape(-1, n)
            found.append((own, (own >= 0).any(1).tolist()))
        every = np.arange(n)
        for end in range(1, size + 1):
            for length in range(min(len(found), end), 0, -1):
                own, any_ = found[length - 1]
                start = end - length
                if length == 1:
                    yield start, end, every, own[start]
                elif any_[start]:
                    rows = np.flatnonzero(own[start] >= 0)
                    yield start, end, rows, own[start][rows]

    def forward(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log probability of each word (of equal length) under each column of p; p's last row is the unknown character's."""
        alpha, log = np.zeros((len(words[0]) + 1, len(words), p.shape[1])), np.zeros((len(words), p.shape[1]))
        alpha[0] = 1
        for start, end, rows, piece in self.lattice(words):
            alpha[end][rows] += alpha[start][rows] * p[piece]
            if end - start == 1 and end % SCALED == 0:  # the last piece that ends here: scaled, long words don't underflow
                by = alpha[end].copy()
                alpha[max(0, end + 1 - self.longest) : end + 1] /= by
                log += np.log(by)
        return log + np.log(alpha[-1])

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected pieces of these words (of equal length), each so many times, from equal probabilities."""
        size, p = len(words[0]), np.append(np.full(len(self.names), 1 / len(self.names)), UNKNOWN)
        edges = list(self.lattice(words))
        # logarithms, each summed relative to its neighbour's: long words don't underflow
        alpha, beta = np.zeros((size + 1, len(words))), np.zeros((size + 1, len(words)))
        for end, own in groupby(edges, key=lambda e: e[1]):
            total = np.zeros(len(words))
            for start, _, rows, piece in own:
                total[rows] += np.exp(alpha[start][rows] - alpha[end - 1][rows]) * p[piece]
            alpha[end] = alpha[end - 1] + np.log(total)
        for start, own in groupby(sorted(edges, key=lambda e: -e[0]), key=lambda e: e[0]):
            total = np.zeros(len(words))
            for _, end, rows, piece in own:
                total[rows] += np.exp(beta[end][rows] - beta[start + 1][rows]) * p[piece]
            beta[start] = beta[start + 1] + np.log(total)
        out = np.zeros(len(self.names) + 1)
        for start, end, rows, piece in edges:
            np.add.at(out, piece, np.exp(alpha[start][rows] + beta[end][rows] - alpha[size][rows]) * p[piece] * counts[rows])
        return out


@lru_cache(maxsize=1)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def _by_length(words: list[str]) -> Iterator[list[int]]:
    """Places of the words by their lengths, AT_ONCE characters at most (one word at least)."""
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    for size, at in out.items():
        step = max(1, AT_ONCE // size)
        for k in range(0, len(at), step):
            yield at[k : k + step]


class WordScores:
    """log probability of words in each language; what it remembers is cleared by its user."""

    def __init__(self, pieces: Pieces, p: np.ndarray):
        self.pieces, self.p = pieces, p
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.log = np.zeros((1024, self.p.shape[1]))
        self.held = 0

    def __call__(self, words: list[str]) -> np.ndarray:
        """Row numbers of self.log."""
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if new:
            self._learn(new)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def _learn(self, new: list[str]) -> None:
        first = len(self.index)
        if first + len(new) > len(self.log):
            self.log = np.concatenate([self.log, np.zeros((max(len(self.log), len(new)), self.log.shape[1]))])
        self.index |= {w: first + k for k, w in enumerate(new)}
        self.held += sum(4 * len(w) + 150 for w in new)
        marked = [MARK + w for w in new]
        for at in _by_length(marked):
            self.log[first + np.array(at)] = self.pieces.forward([marked[i] for i in at], self.p)


def train(df: DataFrame, lang_col: str = "lang", text_col: str = "text", path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages in order, and piece probabilities (pieces and the unknown character x languages).

    Every row teaches, equal texts of a language once; rows with a null language
    or text teach nothing, and an empty table teaches no language. Word counts and expected pieces are summed by Spark;
    the driver gets at most one number for each language and piece.
    """
    place = common.vocabulary("piece_bpe_32k.model", path)
    rows = df.select(common.quoted(lang_col).cast("string").alias("lang"), common.quoted(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL").distinct()

    def count(b: pa.RecordBatch) -> dict:
        found: Counter = Counter()
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found.update((lang, w) for w in LETTERS.findall(text.lower()))
        keys = list(found)
        return {"lang": pa.array([k[0] for k in keys], pa.string()), "word": pa.array([k[1] for k in keys], pa.string()), "n": pa.array(list(found.values()), pa.int64())}

    words = common.map_batches(rows, count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def expect(b: pa.RecordBatch) -> dict:
        pieces = _pieces(place)
        langs, words, counts = np.array(b.column(0).to_pylist(), object), [MARK + w for w in b.column(1).to_pylist()], np.array(b.column(2).to_pylist(), float)
        out = {}
        for at in _by_length(words):
            for lang in dict.fromkeys(langs[at]):
                own = [i for i in at if langs[i] == lang]
                out[lang] = out.get(lang, 0) + pieces.expected([words[i] for i in own], counts[own])
        keys = [(lang, int(i)) for lang, v in out.items() for i in np.nonzero(v)[0]]
        return {"lang": pa.array([k[0] for k in keys], pa.string()), "piece": pa.array([k[1] for k in keys], pa.int32()), "n": pa.array([out[a][i] for a, i in keys], pa.float64())}

    sums = common.map_batches(words, expect, "lang string, piece int, n double", whole=True).groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in sums})
    total = np.zeros((len(_pieces(place).names) + 1, len(langs)))
    for r in sums:
        total[r["piece"], langs.index(r["lang"])] = r["n"]
    p = (total + SMOOTH) / (total + SMOOTH).sum(0, keepdims=True) if langs else total
    if langs:
        p[-1] = UNKNOWN
    return langs, p


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """lang_pred and score of every whole text; map only.

    `und` with score 0 where the text is null or has no letter, or nothing was
    learned. The score is the winner's share of the length-tempered
    probabilities. Ties go to the first language in order. Null ids and
    repeated rows pass through; texts and words are scored whole, however
    long; other columns are not read, so none can clash; an empty table gives
    no rows.
    """
    place = common.vocabulary("piece_bpe_32k.model", path)
    kind = df.schema[id_col].dataType.simpleString()
    langs, p = model

    def run(b: pa.RecordBatch) -> dict:
        words = [LETTERS.findall(t.lower()) if t and langs else [] for t in b.column(1).to_pylist()]
        pred, score = ["und"] * len(words), [0.0] * len(words)
        scores = _scores(place, p)
        if scores.held > REMEMBERED:
            scores.clear()
        flat = [w for own in words for w in own]
        if flat:
            rows = scores(flat)
            have = [i for i, own in enumerate(words) if own]
            starts = np.cumsum([0] + [len(words[i]) for i in have[:-1]])
            log = np.add.reduceat(scores.log[rows], starts, axis=0)
            log /= np.sqrt(np.array([len(words[i]) for i in have], float))[:, None]
            share = np.exp(log - log.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            for i, k, s in zip(have, share.argmax(1).tolist(), share.max(1).tolist(), strict=True):
                pred[i], score[i] = langs[k], min(1.0, s)
        return {id_col: b.column(0), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())}

    return common.map_batches(common.only(df, id_col, text_col), run, f"`{id_col}` {kind}, lang_pred string, score double")


_memory: dict = {}


def _scores(place: str, p: np.ndarray) -> WordScores:
    """This worker's scores for the model; another model replaces them."""
    key = (place, p.shape, hash(p.tobytes()))
    if key not in _memory:
        _memory.clear()
        _memory[key] = WordScores(_pieces(place), p)
    return _memory[key]


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs.where(~common.held_out()))
    return identify(docs, model).select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score")
