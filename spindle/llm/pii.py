"""Personal data by boosted trees over candidate spans (operator 2), DataFrame functions only.

Four base kinds are found by pattern and check. Besides, high-recall generators
propose spans, which may overlap each other and the base: long mixed strings,
number groups, spelled-out addresses, account numbers. Boosted trees score each
candidate by its format and context; a calibrated threshold for each generator
selects those that are added. The trees learn from weak labels, one rule for
each generator, none of them a feature or dependent on the base: key shape or
randomness, digit grouping of a phone, grammar of a spelled-out address,
mod-97 of an account number. They are fitted on counts over the grid of binned
features, and become one expression. Besides the table's own texts, some
invented ones (SEEDS) teach, so that a kind which the table hardly has is
still learned.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting, common

PRECISION = 0.9
#: Array elements of a block of a scan, and code points of a chunk that texts are cut by.
BLOCK, CHUNK = 64, 1024
#: Base patterns in the form that Java's engine runs in linear time and without
#: recursion: a match cannot start inside a run whose start failed (\G: right
#: after the match before).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{20,}+",
    "number": r"(?<![0-9+(])\+?\(?[0-9](?:[ ().-]{0,2}[0-9]){6,}+",
    "handle": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++ ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z]{2,}+",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
ASSIGNED = r"(?i)(?:token|key|secret|passw(?:or)?d|pwd|bearer|auth)[\"']?\s*[:=]?\s*[\"']?$"
CUES = r"(?i)(?:tel|phone|call|fax|mobil|card|account|konto|cuenta|compte|iban|ssn|ip|mail|contact)[^A-Za-z]*$"
KEY = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_|sk[-_]|xox[abp]-|eyJ)"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
GROUPED = r"^\+?\(?[0-9]{1,4}\)?(?:[ .-]{1,2}\(?[0-9]{2,8}\)?){1,4}$"
FOUR_DOTTED = r"^[0-9]+(?:\.[0-9]+){3}"
PHONE_CUE = r"(?i)(?:tel(?:ephone|efono?)?|phone|call|fax|mobile?)[^A-Za-z]*$"
ADDRESS = r"^[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++ ?(?:\(dot\)|\[dot\]|\.(?! )) ?[a-z]{2,6}$"
FEATURES = ("gen", "length", "digits", "lower", "hex", "seps", "marks", "cue", "prev", "next")
CANDIDATE = "struct<gen:int,length:int,digits:int,lower:int,hex:int,seps:int,marks:int,cue:int,prev:int,next:int,start:bigint,end:bigint,y:int>"


def _before(steps: Column, fold, zero: Column) -> Column:
    """Exclusive prefix folds of an array, by blocks: n * BLOCK + (n / BLOCK)^2 steps, never n^2."""
    n = F.size(steps)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)), zero, fold))
    before = F.aggregate(
        blocks,
        F.struct(zero.alias("now"), F.filter(F.array(zero), lambda _: F.lit(False)).alias("out")),
        lambda acc, x: F.struct(fold(acc["now"], x).alias("now"), F.array_append(acc["out"], acc["now"]).alias("out")),
        lambda acc: acc["out"],
    )
    own = F.transform(F.array(before), lambda b: F.transform(steps, lambda _, i: fold(F.get(b, F.floor(i / BLOCK).cast("int")), F.aggregate(F.slice(steps, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK), zero, fold))))[0]
    return F.when(n > 0, own).otherwise(F.filter(F.array(zero), lambda _: F.lit(False)))


def _starts(steps: Column) -> Column:
    return _before(steps, lambda a, b: a + b, F.lit(0).cast("long"))


def _swept(df: DataFrame, spans: str, against: list, hits, out: str) -> DataFrame:
    """Adds `out`: those of the array `spans`, sorted by start, that hits(place, k -> true) does not call overlapped.

    against: tests of a span, each of which names a set of spans; a span is
    overlapped by a set if the greatest end of the set's spans before it lies
    behind its start, or the least start of those after it before its end.
    """
    low, high = F.lit(-1).cast("long"), F.lit(1 << 62).cast("long")
    both = lambda pick, at: F.struct(*(F.when(test(at), pick(at)).alias(f"s{k}") for k, test in enumerate(against)))
    each = lambda f, a, b: F.struct(*(f(a[f"s{k}"], b[f"s{k}"]).alias(f"s{k}") for k in range(len(against))))
    of = lambda value: F.struct(*(value.alias(f"s{k}") for k in range(len(against))))
    e, b, m, n = (f"_{c}_{out}" for c in "ebmn")
    filled = lambda x, value: F.transform(x, lambda s: F.struct(*(F.coalesce(s[f"s{k}"], value).alias(f"s{k}") for k in range(len(against)))))
    df = df.withColumn(e, filled(F.transform(spans, lambda s: both(lambda x: x["end"], s)), low)).withColumn(b, F.reverse(filled(F.transform(spans, lambda s: both(lambda x: x["start"], s)), high)))
    df = df.withColumn(m, _before(F.col(e), lambda x, y: each(F.greatest, x, y), of(low))).withColumn(n, F.reverse(_before(F.col(b), lambda x, y: each(F.least, x, y), of(high))))
    zipped = F.arrays_zip(F.col(spans).alias("s"), F.col(m).alias("m"), F.col(n).alias("n"))
    overlapped = lambda z, k: (z["m"][f"s{k}"] > z["s"]["start"]) | (z["n"][f"s{k}"] < z["s"]["end"])
    return df.withColumn(out, F.transform(F.filter(zipped, lambda z: ~hits(z["s"], lambda k: overlapped(z, k))), lambda z: z["s"])).drop(e, b, m, n)


def _matches(df: DataFrame, name: str, pattern: str, guard: Column) -> DataFrame:
    """Adds array `name` of struct(value, start, end, before, after), offsets in code points; not looked for where guard is false."""
    m, g = f"_m_{name}", f"_g_{name}"
    none = F.array().cast("array<string>")
    df = df.withColumn(m, F.when(guard, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(g, F.when(F.size(m) > 0, F.split("_text", pattern, -1)).otherwise(none))
    gaps = F.transform(F.col(m), lambda v, i: F.length(F.get(F.col(g), i)).cast("long"))
    df = df.withColumn(f"_s_{name}", F.zip_with(gaps, F.col(m), lambda a, v: a + F.length(v)))
    df = df.withColumn(f"_p_{name}", _starts(F.col(f"_s_{name}")))

    def span(v: Column, i: Column) -> Column:
        end = F.get(F.col(f"_p_{name}"), i) + F.get(F.col(f"_s_{name}"), i)
        return F.struct(v.alias("value"), (end - F.length(v)).alias("start"), end.alias("end"), F.right(F.get(F.col(g), i), F.lit(24)).alias("before"), F.left(F.get(F.col(g), i + 1), F.lit(1)).alias("after"))

    return df.withColumn(name, F.transform(F.col(m), span)).drop(m, g, f"_s_{name}", f"_p_{name}")


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[ -]", ""))
    even = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c, i: even(c.cast("int"), i)), F.lit(0), lambda a, b: a + b)
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)


def _octets(value: Column) -> Column:
    short = F.transform(F.split(value, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    return F.forall(short, lambda x: F.when(F.length(x) <= 3, x.cast("int") <= 255).otherwise(False))


def _phone(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)


def _random(value: Column) -> Column:
    """Of a known key's shape, or with many changes between digits and letters, few signs and at least 3 bits a character."""
    n = F.length(value)
    runs = F.length(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9]", ""), "[0-9]+|[a-z]+|[A-Z]+", "#"))
    signs = F.length(F.regexp_replace(value, "[A-Za-z0-9]", ""))
    share = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    bits = F.aggregate(F.filter(F.array_distinct(F.split(value, "")), lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return value.rlike(KEY) | (~value.rlike(UUID) & (4 * runs >= n) & (8 * signs <= n) & (bits >= 3))


def _dialled(value: Column, before: Column) -> Column:
    """Digits grouped as a phone's, after a word for it or beginning with +, 0 or a bracket."""
    return _phone(value) & value.rlike(GROUPED) & ~value.rlike(FOUR_DOTTED) & (before.rlike(PHONE_CUE) | value.rlike(r"^[+(0]"))


def _mod97(value: Column) -> Column:
    """The check of an account number: its first four signs moved to the end, letters as 10 to 35, leave 1."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    signs = F.filter(F.split(F.concat(F.substring(plain, 5, 99), F.left(plain, F.lit(4))), ""), lambda c: c != "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.length(plain).between(15, 34) & (F.aggregate(signs, F.lit(0), step) == 1)


def _seeds() -> list[str]:
    """Invented texts with candidates of each generator, right and wrong ones, with and without cues; always the same."""
    r = random.Random(7)
    digits = lambda n: "".join(r.choices("0123456789", k=n))
    word = lambda: "".join(r.choices("abcdefghilmnoprstu", k=r.randint(3, 8)))
    fours = lambda v: " ".join(v[k : k + 4] for k in range(0, len(v), 4))
    out = []
    for i in range(80):
        country, size = r.choice([("DE", 18), ("ES", 20), ("NL", 14), ("FR", 23), ("GB", 18), ("IT", 23)])
        own = ("".join(r.choices("ABCDEFGHKLMN", k=4)) if country in ("NL", "GB") else "") + digits(size)
        own = own[:size]
        check = 98 - int("".join(str(int(c, 36)) for c in own + country + "00")) % 97
        iban = f"{country}{check:02d}{own}"
        near, a, b = word(), r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), ("(at)", "."), ("[at]", ".")]), r.choice(["", " "])
        key = "".join(r.choices(r.choice(["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"]), k=r.choice([24, 32, 40, 48])))
        phone = r.choice([f"0{digits(2)} {digits(4)} {digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"0{digits(3)}-{digits(7)}", f"{digits(3)}-{digits(3)}-{digits(4)}"])
        out += [
            f"{near} {r.choice(['IBAN: ', 'account ', 'to ', 'pay '])}{r.choice([fours(iban), iban])} {word()}",
            f"{near} {r.choice(['part ', 'code ', 'see '])}{fours(''.join(r.choices('ABCDEFGHK', k=2)) + digits(10))} {word()}",
            f"{near} {r.choice(['mail ', 'write to ', 'contact: ', ''])}{word()}.{word()}{b}{a[0]}{b}{word()}{'' if a[1] == '.' else b}{a[1]}{'' if a[1] == '.' else b}{r.choice(['com', 'org', 'de', 'net'])} {word()}",
            f"{near} {word()} {a[0]} {word()}. {word().title()} {word()}",
            f"{near} {r.choice([f'token = {chr(34)}{key}{chr(34)}', f'key: {key}', f'with {key}', f'is {key},'])} {word()}",
            f"{near} {'-'.join(word() for _ in range(4))}-{digits(4)} {word()}/{word()}/{word()}_{digits(2)}/{word()}",
            f"{near} {r.choice(['tel. ', 'phone ', 'call ', 'fax: '])}{phone} {word()}",
            f"{near} {r.choice(['order ', 'no. ', 'in ', 'card '])}{r.choice([digits(16), digits(10), fours(digits(16)), '20' + digits(2) + '-01-1' + digits(1) + ' 10', '.'.join(digits(3) for _ in range(4))])} {word()}",
        ]
    return out


SEEDS = _seeds()


def _checked(spans: Column, check) -> Column:
    return F.filter(spans, lambda s: check(s["value"]))


def with_base(df: DataFrame, text_col: str) -> DataFrame:
    """df with _text and an array of struct(start, end) for each base kind."""
    df = df.withColumn("_text", F.coalesce(common.quoted(text_col), F.lit("")))
    digit = F.col("_text").rlike("[0-9]")
    guards = {"email": F.contains("_text", F.lit("@")), "ip": digit, "card": digit, "phone": F.contains("_text", F.lit("+")) & digit}
    checks = {"email": None, "ip": _octets, "card": _luhn, "phone": _phone}
    for kind, pattern in BASE.items():
        df = _matches(df, f"_{kind}", pattern, guards[kind])
        found = F.col(f"_{kind}")
        if checks[kind]:
            found = _checked(found, checks[kind])
        df = df.withColumn(f"_{kind}", F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return df


def with_candidates(df: DataFrame) -> DataFrame:
    """Adds _cand: candidates of all generators with binned features and weak label."""
    digit = F.col("_text").rlike("[0-9]")
    guards = {"secret": digit, "number": digit, "handle": F.contains("_text", F.lit("at)")) | F.contains("_text", F.lit("at]")), "account": digit}
    df = df.withColumn("_all_base", F.concat(*(F.col(f"_{k}") for k in BASE)))
    for name, pattern in GENERATORS.items():
        df = _matches(df, f"_{name}", pattern, guards[name])

    def char_class(c: Column) -> Column:
        return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.isin('"', "'", "`"), 2).when(c.isin("=", ":"), 3).when(c.rlike("[A-Za-z0-9]"), 4).otherwise(5)

    def features(s: Column, gen: int) -> Column:
        v, n = s["value"], F.length(s["value"])
        share = lambda pattern: F.floor(8 * F.length(F.regexp_replace(v, pattern, "")) / n).cast("int")
        assigned = s["before"].rlike(ASSIGNED)
        label = (_random(v), _dialled(v, s["before"]), v.rlike(ADDRESS), _mod97(v))[gen]
        return F.struct(
            F.lit(gen).alias("gen"), F.floor(F.least(n, F.lit(48)) / 4).cast("int").alias("length"), share("[^0-9]").alias("digits"), share("[^a-z]").alias("lower"),
            v.rlike("^[0-9a-fA-F]+$").cast("int").alias("hex"), F.least(F.length(F.regexp_replace(v, "[A-Za-z0-9]", "")), F.lit(5)).alias("seps"),
            F.least(F.length(F.regexp_replace(v, r"[^()\[\]]", "")), F.lit(4)).alias("marks"),
            F.when(assigned, 2).when(s["before"].rlike(CUES), 1).otherwise(0).alias("cue"), char_class(F.right(s["before"], F.lit(1))).alias("prev"), char_class(s["after"]).alias("next"),
            s["start"].alias("start"), s["end"].alias("end"), label.cast("int").alias("y"),
        )

    def described(name: str, gen: int) -> Column:
        return F.transform(F.col(f"_{name}"), lambda s: features(s, gen)).cast(f"array<{CANDIDATE}>")

    each = [described(name, g) for g, name in enumerate(GENERATORS)]
    return df.withColumn("_cand", F.concat(*each)).drop(*(f"_{name}" for name in GENERATORS))


def train(df: DataFrame, text_col: str = "text") -> tuple[boosting.Trees | None, list[float]]:
    """Trees, and the margin from which each generator's candidates are added (inf: never).

    Null and empty texts have no candidates; an empty table teaches by SEEDS alone.
    Spark counts the candidates of all texts (equal ones once) and of SEEDS by
    their binned features; the driver gets one row for each cell of the grid (13
    * 9 * 9 * 2 * 6 * 5 * 3 * 6 * 6 for each generator at most) and fold.
    """
    seeds = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, SEEDS))).alias("text"))
    rows = df.select(common.quoted(text_col).alias("text")).unionByName(seeds)
    found = with_candidates(with_base(rows, "text")).select(F.md5(F.col("_text").cast("binary")).alias("digest"), F.explode_outer("_cand").alias("c"))
    # explode_outer: from explode the optimizer infers a filter, which it then pushes through, and copies into, all of the above
    # equal texts teach once: their candidates are equal; these few rows are shuffled, not the texts
    cand = common.saved(found).where("c IS NOT NULL").distinct().withColumn("fold", F.pmod(F.xxhash64("digest"), F.lit(4)))
    cells = cand.groupBy(*(F.col(f"c.{f}").alias(f) for f in FEATURES), (F.col("fold") == 0).alias("held")).agg(F.sum("c.y").alias("pos"), F.count("*").alias("n")).orderBy(*FEATURES, "held").collect()
    never = [float("inf")] * len(GENERATORS)
    if not cells:
        return None, never
    x = np.array([[c[f] for f in FEATURES] for c in cells] * 2, float)
    y = np.repeat([1.0, 0.0], len(cells))
    w = np.array([c["pos"] for c in cells] + [c["n"] - c["pos"] for c in cells], float)
    held = np.array([c["held"] for c in cells] * 2)
    if not w[~held].any() or not w[held].any():
        held[:] = False
    own = ~held & (w > 0)
    trees = boosting.fit(x[own], y[own], w[own], n_trees=16, depth=3, rate=0.5)
    margin, limits = trees.margin(x), never
    test = held if held.any() else ~held
    for g in range(len(GENERATORS)):
        pick = test & (x[:, 0] == g) & (w > 0)
        if pick.any():
            knots, p = boosting.isotonic(margin[pick], y[pick], w[pick])
            if (p >= PRECISION).any():
                limits[g] = float(knots[np.argmax(p >= PRECISION)])
    return trees, limits


def _margin(trees: boosting.Trees, c: Column) -> Column:
    def node(feature, threshold, leaf, k: int) -> Column:
        if k >= len(feature):
            return F.lit(float(leaf[k - len(feature)]))
        if not np.isfinite(threshold[k]):
            return node(feature, threshold, leaf, 2 * k + 1)
        return F.when(c[FEATURES[feature[k]]] > float(threshold[k]), node(feature, threshold, leaf, 2 * k + 2)).otherwise(node(feature, threshold, leaf, 2 * k + 1))

    total = F.lit(trees.base)
    for feature, threshold, leaf in trees.trees:
        total = total + node(feature, threshold, leaf, 0)
    return total


def _found(df: DataFrame, model: tuple[boosting.Trees | None, list[float]], text_col: str) -> DataFrame:
    """df's columns as _k0, _k1 ... with _text, _base and _added: arrays of struct(kind, start, end)."""
    inner = df.select(*(common.quoted(c).alias(f"_k{i}") for i, c in enumerate(df.columns)), common.quoted(text_col).alias("_own"))
    out = with_candidates(with_base(inner, "_own"))
    trees, limits = model
    added = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    if trees is not None and min(limits) < float("inf"):
        place = "struct<start:bigint,end:bigint,gen:int>"
        chosen = F.filter("_cand", lambda c: _margin(trees, c) >= _limit(limits, c))
        picked = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["gen"].alias("gen")).cast(place))
        base = F.transform("_all_base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(-1).alias("gen")).cast(place))
        out = out.withColumn("_line", F.array_sort(F.concat(base, picked)))
        # clear of the base, then of those of an earlier generator that are
        out = _swept(out, "_line", [lambda s: s["gen"] < 0], lambda s, overlapped: (s["gen"] < 0) | overlapped(0), "_clear")
        earlier = [lambda s, k=k: s["gen"] <= k for k in range(len(GENERATORS) - 1)]

        def beaten(s: Column, overlapped) -> Column:
            test = F.lit(False)
            for k in range(len(earlier)):
                test = F.when(s["gen"] == k + 1, overlapped(k)).otherwise(test)
            return test

        out = _swept(out, "_clear", earlier, beaten, "_first")
        names = F.array(*map(F.lit, GENERATORS))
        ordered = F.array_sort(F.transform("_first", lambda c: F.struct(c["gen"].alias("gen"), c["start"].alias("start"), c["end"].alias("end"))))
        added = F.transform(ordered, lambda c: F.struct(F.get(names, c["gen"]).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return out.withColumns({"_base": F.concat(*map(_named, BASE)), "_added": added})


def find(df: DataFrame, model: tuple[boosting.Trees | None, list[float]], text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("pii_base", "pii_added")) -> DataFrame:
    """df's columns `keep` (all, if not given) with base and added spans, named by `names`: arrays of struct(kind, start, end).

    Offsets are code points, ends exclusive. A null or empty text has no span; a
    very long one is searched whole. Added spans overlap no base span and no
    added span of an earlier generator. Nulls elsewhere, repeated rows and
    extra columns of any name pass through; columns named as the two results
    are replaced; an empty table gives no rows.
    """
    at = {c: f"_k{i}" for i, c in enumerate(df.columns)}
    out = _found(df, model, text_col)
    return out.select(*(F.col(at[c]).alias(c) for c in keep or df.columns if c not in names), F.col("_base").alias(names[0]), F.col("_added").alias(names[1]))


def _named(kind: str) -> Column:
    return F.transform(F.col(f"_{kind}"), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _limit(limits: list[float], c: Column) -> Column:
    out = F.lit(float("inf"))
    for g, least in enumerate(limits):
        out = F.when(c["gen"] == g, float(least)).otherwise(out)
    return out


def redact(df: DataFrame, model: tuple[boosting.Trees | None, list[float]], text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """df with every found span of the text replaced by its kind in angle brackets; overlapping spans become one.

    length_col, if df has it, becomes the code points of the new text (null for
    a null text). A null text stays null, an empty one empty; nulls elsewhere,
    repeated rows and extra columns of any name pass through; an empty table
    gives no rows.
    """
    text = F.col("_own")
    spans = F.array_sort(F.transform(F.concat("_base", "_added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    out = _found(df, model, text_col).withColumn("_spans", spans)
    none = F.array().cast("array<string>")
    out = out.withColumns({"_chunks": F.when(F.size("_spans") > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).otherwise(none), "_ends": F.transform("_spans", lambda s: s["end"])})
    out = out.withColumn("_till", _before(F.col("_ends"), lambda a, b: F.greatest(a, b), F.lit(0).cast("long")))
    chunks = F.col("_chunks")

    def cut(start: Column, end: Column) -> Column:
        """Of the text, by its chunks, so that no cut counts from the text's beginning."""
        first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
        one = F.substring(F.get(chunks, first), (start % CHUNK + 1).cast("int"), (end - start).cast("int"))
        more = F.concat(F.substring(F.get(chunks, first), (start % CHUNK + 1).cast("int"), F.lit(CHUNK)), F.array_join(F.slice(chunks, first + 2, last - first - 1), ""), F.coalesce(F.substring(F.get(chunks, last), F.lit(1), (end % CHUNK).cast("int")), F.lit("")))
        return F.when(start >= end, "").when(first == last, one).otherwise(more)

    # a span that begins before an earlier one ends is part of it
    fresh = F.filter(F.arrays_zip(F.col("_spans").alias("s"), F.col("_till").alias("till")), lambda z: z["s"]["start"] >= z["till"])
    parts = F.transform(fresh, lambda z: F.concat(cut(z["till"], z["s"]["start"]), F.lit("<"), F.upper(z["s"]["kind"]), F.lit(">")))
    whole = F.concat(F.array_join(parts, ""), cut(F.array_max("_ends"), F.length(text).cast("long")))
    out = out.withColumn("_clean", F.when(F.size("_spans") > 0, whole).otherwise(text))
    new = {text_col: F.col("_clean")} | ({length_col: F.length("_clean").cast(df.schema[length_col].dataType)} if length_col in df.columns else {})
    return out.select(*(new.get(c, F.col(f"_k{i}")).alias(c) for i, c in enumerate(df.columns)))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, train(docs), keep=["doc_id"])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    each = [count("pii_base", k) for k in BASE] + [F.sha2(said(F.col("pii_base")).cast("binary"), 256).alias("base_sha256"), said(F.concat("pii_base", "pii_added")).alias("spans")]
    return found.select("doc_id", *each, *(count("pii_added", k) for k in GENERATORS), (F.size("pii_base") + F.size("pii_added")).cast("long").alias("n_spans"))
