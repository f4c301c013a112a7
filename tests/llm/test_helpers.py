"""The parts that run inside tasks, against libraries and brute force."""

import math
import random
import re
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest

from spindle.llm import boosting, near_dedup, quality, sharding
from spindle.llm.byte_bpe import ByteBPE
from spindle.llm.language_id import Pieces
from spindle.llm.token_counts import SegmentCounts, text_tokens

random.seed(1)
SIGNS = "ab é▁ \n\t01.,<s>日本\U0001f600\x1c\x85\xa0 'sll"
TEXTS = ["".join(random.choice(SIGNS) for _ in range(random.randrange(60))) for _ in range(1500)]
TEXTS += ["".join(random.choice(letters) for _ in range(n)) for letters in ("ab", "aeinrst", "0123456789", "日本語あい") for n in (1023, 1024, 1025, 2500, 9000)]
TEXTS += ["", " ", "  a ", "a" * 5000, "ab" * 4000, "aaab" * 1500, "日本" * 1500, "<s></s>", "\0a\0", "<|endoftext|>", "x" * 30000]


def test_token_counts_equal_the_library():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    counts = SegmentCounts(path)
    lib = sentencepiece.SentencePieceProcessor(model_file=path).encode(TEXTS, num_threads=1)
    assert [text_tokens(t, counts) for t in TEXTS] == list(map(len, lib))
    assert text_tokens(None, counts) == 0


def test_byte_bpe_equals_the_library_and_round_trips():
    import tiktoken

    bpe = ByteBPE(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    ids = bpe.encode(TEXTS)
    assert all(np.frombuffer(i, "<u4").tolist() == lib.encode_ordinary(t) for i, t in zip(ids, TEXTS))
    assert all(bpe.decode(i) == t.encode() for i, t in zip(ids, TEXTS))


def slow_repeats(words, k=8):
    windows = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside.update(range(i, i + k))
    return len(inside)


def test_repeated_windows():
    for _ in range(60):
        words = [random.choice("abc") for _ in range(random.randrange(60))]
        assert quality.repeated_window_words(words) == slow_repeats(words)


def test_duplicate_lines_and_bands():
    import zstandard

    c = zstandard.ZstdCompressor(level=3)
    assert quality.duplicate_lines("a\nb\na\n\n\na") == 2
    assert not quality.compression_verdict(b"spam and eggs " * 2000, c)[1]
    assert not quality.compression_verdict(np.random.default_rng(0).bytes(9000), c)[1]
    assert quality.compression_verdict(b"", c) == (0.0, False)


def test_noise_beside_prose_fails():
    import base64

    import pyarrow.parquet as pq
    import zstandard

    c, rng = zstandard.ZstdCompressor(level=3), np.random.default_rng(0)
    tables = [pq.read_table(f"/root/testdata/sf0.01/{t}.parquet").to_pylist() for t in ("documents", "labels")]
    good = {r["doc_id"] for r in tables[1] if r["quality"] == 1}
    clean = [r["text"].encode() for r in tables[0] if r["doc_id"] in good and len(r["text"].split()) >= 20]
    assert len(clean) > 100 and all(quality.compression_verdict(t, c)[1] for t in clean)
    long = [t for t in clean if 4500 <= len(t) <= 13000]
    assert len(long) > 3
    for t in long:
        for share in (0.5, 0.7, 0.8, 1):
            size = int(len(t) * share / (1 - share)) if share < 1 else len(t)
            code = base64.b64encode(rng.bytes(size))
            noise = b"\n".join(code[k : k + 76] for k in range(0, size, 76))
            assert not quality.compression_verdict(noise if share == 1 else t + b"\n" + noise, c)[1]
            assert not quality.compression_verdict(noise[: max(size // 9, 300)], c)[1]


@pytest.mark.parametrize("n", [1, 2, 5, 40, 1000, 4097])
def test_feistel_is_a_bijection_and_inverts(n):
    p = sharding.permute(np.arange(n), n, 7)
    assert sorted(p.tolist()) == list(range(n))
    assert sharding.permute(p, n, 7, inverse=True).tolist() == list(range(n))
    assert n < 40 or p.tolist() != list(range(n))


def test_signatures_agree_as_the_weighted_similarity():
    rng = np.random.default_rng(0)
    a, w = rng.integers(0, 2**63, 300).astype(np.uint64), rng.integers(1, 9, 300)
    b, v = np.concatenate([a[:240], rng.integers(0, 2**63, 60).astype(np.uint64)]), np.concatenate([w[:240] + (rng.random(240) < 0.2), w[240:]])
    x, y = dict(zip(a.tolist(), w)), dict(zip(b.tolist(), v))
    every = set(x) | set(y)
    true = sum(min(x.get(e, 0), y.get(e, 0)) for e in every) / sum(max(x.get(e, 0), y.get(e, 0)) for e in every)
    k = 4000
    s = near_dedup.signatures([(a, w), (b, v)], k=k, darts=k * np.log(k) + 2 * k)
    assert abs((s[0] == s[1]).mean() - true) < 0.03
    one = near_dedup.signatures([(a[:1], w[:1])])
    assert (one != 0).all()


def all_segmentations(word, p):
    if not word:
        return 1.0
    return sum(p[word[:k]] * all_segmentations(word[k:], p) for k in range(1, len(word) + 1) if word[:k] in p)


def test_forward_sums_all_segmentations():
    pieces = Pieces(P.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(0)
    p = np.append(rng.random(len(pieces.names)), 1e-7)[:, None]
    table = dict(zip(pieces.names, p[:, 0]))
    for word in ("▁the", "▁straße", "▁queue", "▁tionment"):
        assert np.isclose(np.exp(pieces.forward([word], p)[0, 0]), all_segmentations(word, table))
    total = pieces.expected(["▁the"], np.array([3.0]))
    assert np.isclose(sum(n * len(name) for n, name in zip(total, pieces.names)), 3 * len("▁the"))


def test_forward_over_whole_long_words():
    """Words beyond any fixed length are summed over all segmentations: by exact fractions of a plain forward pass."""
    pieces = Pieces(P.path("piece_bpe_32k.model"))
    p = np.random.default_rng(0).random((len(pieces.names) + 1, 2)) / 40_000
    place = {name: k for k, name in enumerate(pieces.names)}
    for word in ("▁" + "donaudampfschifffahrtsgesellschaftskapitän" * 3, "▁" + "x" * 500):
        for lang in range(2):
            alpha = [Fraction(1)]
            for end in range(1, len(word) + 1):
                ways = ((s, place.get(word[s:end], -1 if end - s == 1 else None)) for s in range(max(0, end - pieces.longest), end))
                alpha.append(sum(alpha[s] * Fraction(float(p[k, lang])) for s, k in ways if k is not None))
            true = math.log(alpha[-1].numerator) - math.log(alpha[-1].denominator)
            assert math.isclose(pieces.forward([word, word], p)[1, lang], true, rel_tol=1e-9)
        total = pieces.expected([word], np.array([2.0]))
        assert np.isclose(sum(n * len(name) for n, name in zip(total, pieces.names)) + total[-1], 2 * len(word))


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3)).astype(float)
    m = boosting.fit(x, y, np.ones(2000)).margin(x)
    assert ((m > 0) == y).mean() > 0.98
    knots, p = boosting.isotonic(m, y, np.ones(2000))
    assert (np.diff(knots) >= 0).all() and (np.diff(p) >= 0).all()


def test_words_are_split_as_stated():
    assert quality.WORDS.findall("a\tb\x0bc\xa0d e") == ["a", "b", "c\xa0d", "e"]
    assert re.fullmatch(r"[^\x20\x09-\x0D]+", "c\xa0d")
