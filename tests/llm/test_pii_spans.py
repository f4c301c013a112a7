"""Added spans against a plain evaluation of generators, trees and limits; texts with very many spans."""

import math
import re
import time

import numpy as np
import pytest

from spindle.llm import pii
from test_operators import PATTERNS, PLAIN, PLANTED, holds

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def char_class(c):
    return 0 if c == "" else 1 if c in " \t\n\x0b\f\r" else 2 if c in "\"'`" else 3 if c in "=:" else 4 if re.fullmatch("[A-Za-z0-9]", c) else 5


def candidates(text):
    """(features in the order of pii.FEATURES, start, end)"""
    for gen, pattern in enumerate(pii.GENERATORS.values()):
        found = list(re.finditer(pattern, text))
        for k, m in enumerate(found):
            v, n = m[0], len(m[0])
            before = text[found[k - 1].end() if k else 0 : m.start()][-24:]
            after = text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)][:1]
            cue = 2 if re.search(pii.ASSIGNED, before) else 1 if re.search(pii.CUES, before) else 0
            share = lambda own: math.floor(8 * len(re.sub(own, "", v)) / n)
            f = (gen, min(n, 48) // 4, share("[^0-9]"), share("[^a-z]"), int(bool(re.fullmatch("[0-9a-fA-F]+", v))), min(len(re.sub("[A-Za-z0-9]", "", v)), 5), min(len(re.sub(r"[^()\[\]]", "", v)), 4), cue, char_class(before[-1:]), char_class(after))
            yield f, m.start(), m.end()


def plain(text, model):
    """(base spans, added spans) as (kind, start, end), pair by pair."""
    trees, limits = model
    base = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if holds(k, m[0])]
    meets = lambda a, b, s: a < s[2] and s[1] < b
    own = list(candidates(text))
    margins = trees.margin(np.array([f for f, _, _ in own], float)) if own else []
    chosen = [(f[0], a, b) for (f, a, b), m in zip(own, margins, strict=True) if m >= limits[f[0]] and not any(meets(a, b, s) for s in base)]
    names = list(pii.GENERATORS)
    return base, [(names[g], a, b) for g, a, b in chosen if not any(o[0] < g and meets(a, b, o) for o in chosen)]


def redacted(text, spans):
    out, at = "", 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= at:
            out += text[at:start] + f"<{kind.upper()}>"
        at = max(at, end)
    return out + text[at:]


def test_found_and_redacted_as_plain_python_does(spark, model):
    """All documents of sf0.001, planted texts, spans of several kinds over each other, cuts at the chunks' ends."""
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [t for own in PLANTED.values() for t in own] + PLAIN
    texts += ["call +49 89 1234 5678 9012 3456 and 4111 1111 1111 1111", "key: a9fK2mQ7xLw4Zt8Bv3Nc6@b.co ann(at)DE89370400440532013000.de", "é" * 1020 + " 10.0.0.1 " + "x" * 1013 + " 10.0.0.2", "y" * 1023 + " a@b.co", "a@b.co" + "\U0001f600" * 3000 + " a@b.co"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    found = {r.doc_id: r for r in pii.find(df, model).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(df, model).collect()}
    n = 0
    for k, t in enumerate(texts):
        base, added = plain(t or "", model)
        assert [tuple(s) for s in found[k].pii_base] == base and [tuple(s) for s in found[k].pii_added] == added, t
        assert clean[k] == (None if t is None else redacted(t, base + added))
        n += len(added)
    assert n >= 10


def many(n):
    return " ".join(f"mail{k}@ex{k}.com key: 9fK2mQ7xLw4Zt8Bv3Nc6Yp1R{k} word" if k % 2 else f"10.0.{k % 256}.1 joe{k} [at] example [dot] com é" for k in range(n // 2))


def test_time_of_one_text_is_in_proportion_to_its_spans(spark, model):
    took = {}
    for n in (1000, 16_000, 64_000):
        df = spark.createDataFrame([(1, many(n))], "doc_id long, text string")
        began = time.perf_counter()
        (r,) = pii.find(df, model).collect()
        (c,) = pii.redact(df, model).collect()
        took[n] = time.perf_counter() - began
        assert len(r.pii_base) + len(r.pii_added) == n == c.text.count("<")
    assert took[64_000] - took[1000] < 8 * max(took[16_000] - took[1000], 2), took
