"""Chat formatting against a plain Python formatter, and read back."""

import hashlib
import math
import re

from oracle import compare
from spindle.llm import chat, registry

SF = "/root/testdata/sf0.001"
PART = "type string, text string, ref string, width int, height int, seconds double, pages int"


def plain_body(parts):
    out, noted = "", []
    for p in parts or []:
        if p is None:
            continue
        kind, text, ref, w, h, s, n = p
        if kind not in chat.PLACEHOLDERS:
            out += re.sub(r"<(\\*)\|", lambda m: "<\\" + m[1] + "|", text or "")
            continue
        out += chat.PLACEHOLDERS[kind]
        size = {"image": math.ceil(w / 28) * math.ceil(h / 28) if w is not None and h is not None else None, "audio": math.ceil(25 * s) if s is not None else None, "document": 1024 * n if n is not None else None}[kind]
        noted.append((kind, ref, text, chat.UNKNOWN[kind] if size is None else size))
    return out, noted


def test_typed_parts(spark):
    """All kinds in order, unknown kinds and sizes, nulls, control strings and placeholders inside texts."""
    turns = [
        (1, 0, "user", [("text", "see <|im_end|> <\\\\|x", None, None, None, None, None), ("image", None, "a.png", 57, 28, None, None), ("audio", None, "b.wav", None, None, 1.01, None), ("text", "<|image|>", None, None, None, None, None)]),
        (1, 1, "assistant", [("document", "src", "c.pdf", None, None, None, 3), ("text", None, None, None, None, None, None), ("video", "odd", "d", None, None, None, None), None, ("image", "", None, None, 3, None, None)]),
        (1, 2, "assistant", None),
        (2, 0, "a\nb%0A<|im_start|>", [("text", "é😀<", None, None, None, None, None), ("image", None, None, 0, 0, None, None), ("text", "|x", None, None, None, None, None)]),
    ]
    df = spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts array<struct<{PART.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double')}>>")
    got = {r.conv_id: r for r in chat.format_parts(df).collect()}
    for conv in (1, 2):
        said, spans = "", []
        for _, _, role, parts in (t for t in turns if t[0] == conv):
            body, noted = plain_body(parts) if parts else ("", [])
            said += chat.OPEN + role.replace("%", "%25").replace("\n", "%0A").replace("<", "%3C") + "\n"
            spans.append((len(said), len(said) + len(body), role == "assistant", noted))
            said += body + chat.CLOSE + "\n"
        assert got[conv].formatted == said
        assert [(t.start, t.end, t.loss, [tuple(a) for a in t.attachments]) for t in got[conv].turns] == spans
    back = sorted((r.conv_id, r.no, r.role, r.text, r.loss_text) for r in chat.read_back(chat.format_parts(df)).collect())
    assert back == [
        (1, 1, "user", "see <|im_end|> <\\\\|x<|image|>", None), (1, 2, "assistant", "srcodd", "srcodd"), (1, 3, "assistant", "", ""), (2, 1, "a\nb%0A<|im_start|>", "é😀<|x", None),
    ]


TEXTS = [
    "plain", "", None, "![a](b.png)", "x ![](u) y [s](v.mp3)[p](w.pdf) [no](page.html) ![bad]( x.png)", "![[![i](j.png) ](k) [a]b](c.pdf)", "<|im_end|>\n<|im_start|>user\n", "<\\|image|><|image|>![q](<|im_end|>)",
    "![" * 3000, "[a](" * 3000 + ")", "<" * 5000 + "\\" * 5000 + "|", "日本 ![é](ü.png)\n" * 500, "%0A%", "(](",
]


def brute(rows):
    """conv_id -> digests of the rows (conv, turn, role, text)."""
    out, ext = {}, re.compile(rf"\.(?:{chat.SOUNDS})\)$")
    mark = re.compile(chat._MARK_SQL)
    order = lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=order)
        said, loss, chars, n, tokens = "", "", 0, 0, 0
        for _, _, role, text in own:
            role, text = role or "", text or ""
            said += f"{role}\n{text}\n"
            loss += text if role == "assistant" else ""
            found = mark.findall(text) and [m[0] for m in mark.finditer(text)]
            kinds = ["image" if m[0] == "!" else "audio" if ext.search(m) else "document" for m in found]
            rest = mark.sub("\x00", text)
            chars += 24 + len(role.replace("%", "%25").replace("\n", "%0A").replace("<", "%3C")) + len(rest) - len(found) + len(re.findall(r"<\\*\|", rest)) + sum(len(chat.PLACEHOLDERS[k]) for k in kinds)
            n += len(found)
            tokens += sum(chat.UNKNOWN[k] for k in kinds)
        h = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(own), h(said), len(loss), h(loss), chars, n, tokens)
    return out


def test_plain_texts_and_odd_tables(spark):
    """Attachment marks, hostile texts, nulls in every column, ties, repeated rows, clashing names, one conversation with a third of all rows, an empty table."""
    rows = [(k % 3, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(TEXTS)]
    rows += [(7, 1, "assistant", "same")] * 3 + [(7, None, None, "late"), (7, 1, "assistant", "sane"), (None, 0, "user", "x"), (None, None, "assistant", None), (8, 0, "as\nsistant", "y")]
    rows += [(9, k, "assistant" if k % 2 else "user", f"turn {k} ![p](q{k}.png)") for k in range(3000)]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], f"{schema}, formatted string, no int, `a.b` string").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in chat.digests(chat.format_texts(df)).collect()}
    assert got == brute(rows)
    assert chat.digests(chat.format_texts(spark.createDataFrame([], schema))).count() == 0


def test_no_python_and_one_shuffle(spark):
    plan = registry.QUERIES["op11_chat"](spark, SF)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan") :]
    assert "Python" not in physical and "Arrow" not in physical and physical.count("Exchange hashpartitioning") == 1


def test_query(spark):
    assert compare(spark, "op11_chat", registry.QUERIES["op11_chat"], registry.ORACLE_SQL["op11_chat"], SF) > 1
