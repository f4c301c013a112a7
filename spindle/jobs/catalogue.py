"""Registered queries over the driver's tables, with their SQL.

The matrix A is lineitem (row l_orderkey, column l_partkey, value the quantities
added up), x a formula over part, the row domain orders; timings are events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.jobs import analytics, sweep
from spindle.operators import exact, matrix, schedule, spmv, tiles, validate
from spindle.sources import mtx, mtx_format, results, scratch
from spindle.streaming import deltas

WORKERS, CHUNK = 8, 100
#: Components of a row of embeddings.
EMBEDDED = 64
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def entries(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))


def a_matrix(spark, d) -> DataFrame:
    return matrix.coalesced(entries(spark, d))


def vector(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("j"), ((F.col("p_partkey") * 7 + 3) % 10).cast("double").alias("x"))


def domain(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("i"))


def timings(spark, d) -> DataFrame:
    user = F.col("user_id")
    return table(spark, d, "events").select(F.col("event_type").alias("executable"), F.pow(F.lit(2.0), user % 4).cast("long").alias("threads"), F.expr("CASE user_id div 4 % 3 WHEN 0 THEN 10L WHEN 1 THEN 100L ELSE 1000L END").alias("chunk"), F.col("value").alias("time"))


def n_rows(spark, d) -> int:
    return table(spark, d, "orders").count()


COO = "coo AS (SELECT l_orderkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
X = "x AS (SELECT p_partkey AS j, CAST((p_partkey * 7 + 3) % 10 AS DOUBLE) AS x FROM part)"
Y = f"{COO}, {X}, y AS (SELECT o_orderkey AS i, coalesce(sum(v * x), 0.0) AS y FROM orders LEFT JOIN coo ON o_orderkey = i LEFT JOIN x USING (j) GROUP BY 1)"
SPMV = f"WITH {Y} SELECT i, y FROM y"
T = "t AS (SELECT event_type AS executable, CAST(1 << CAST(user_id % 4 AS INTEGER) AS BIGINT) AS threads, CAST(CASE user_id // 4 % 3 WHEN 0 THEN 10 WHEN 1 THEN 100 ELSE 1000 END AS BIGINT) AS chunk, value AS time FROM events)"


def p90_sql(keys: str, name: str) -> str:
    at = "CAST(floor(least(greatest(0.9 * len(s) + 0.5, 1), len(s))) AS BIGINT)"
    return f"{name} AS (SELECT {keys}, s[{at}] + (least(greatest(0.9 * len(s) + 0.5, 1), len(s)) - {at}) * (s[least({at} + 1, len(s))] - s[{at}]) AS p90 FROM (SELECT {keys}, list_sort(list(time)) AS s FROM t WHERE time IS NOT NULL GROUP BY ALL))"


P90 = f"{T}, {p90_sql('executable, threads', 'p')}"
P90C = f"{T}, {p90_sql('executable, threads, chunk', 'c')}"
PTR = f"{COO}, n AS (SELECT o_orderkey AS i, count(coo.i) AS n FROM orders LEFT JOIN coo ON o_orderkey = coo.i GROUP BY 1), p AS (SELECT i, CAST(sum(n) OVER (ORDER BY i) - n AS BIGINT) AS row_start, CAST(sum(n) OVER (ORDER BY i) AS BIGINT) AS row_end FROM n)"
MERGE = f"""{PTR}, e AS (SELECT row_end + i AS e FROM p), s AS (SELECT max(e) + 1 AS t, (max(e) + {WORKERS}) // {WORKERS} AS items FROM e),
g AS (SELECT CAST(part AS BIGINT) AS part, (SELECT count(*) FROM e WHERE e.e < part * items) AS row, least(part * items, t) AS d FROM s, range({WORKERS + 1}) r(part)), m AS (SELECT part, row, CAST(d - row AS BIGINT) AS nz FROM g)"""


@query(SPMV)
def spmv_csr(spark, d):
    """All rows of the domain; equal coordinates need not be added up first, as a product is linear."""
    return spmv.multiply(entries(spark, d), vector(spark, d), domain(spark, d))


@query(SPMV)
def spmv_coo(spark, d):
    return spmv.multiply(entries(spark, d), vector(spark, d), domain(spark, d))


@query(SPMV)
def spmv_csr_nested(spark, d):
    return spmv.multiply_nested(a_matrix(spark, d), vector(spark, d), domain(spark, d))


@query(SPMV)
def spmv_merge(spark, d):
    return spmv.multiply_merge(a_matrix(spark, d), vector(spark, d), domain(spark, d), WORKERS)


@query(f"WITH {Y}, z AS (SELECT j, sum(v * y) AS x FROM coo JOIN y USING (i) GROUP BY 1) SELECT o_orderkey AS i, coalesce(sum(v * x), 0.0) AS y FROM orders LEFT JOIN coo ON o_orderkey = i LEFT JOIN z USING (j) GROUP BY 1")
def spmv_chained(spark, d):
    """A (A' (A x)): A and its transpose are laid out once; no product moves them."""
    coo = entries(spark, d)
    a, at = tiles.build(coo), tiles.build(matrix.transposed(coo))
    y = tiles.multiply(a, vector(spark, d), domain(spark, d))
    z = tiles.sums(at, y.select(F.col("i").alias("j"), F.col("y").alias("x")))
    return tiles.multiply(a, z.select(F.col("i").alias("j"), F.col("y").alias("x")), domain(spark, d))


# the exact sum as a whole number of 2^-114, and its nearest double: 53 bits, ties to even
_EXACT = """WITH s AS (SELECT l_orderkey AS i, sum(CAST(l_discount * 576460752303423488.0::DOUBLE AS HUGEINT) * CAST(((p_partkey * 7 + 3) % 10) / 7.0::DOUBLE * 36028797018963968.0::DOUBLE AS HUGEINT)) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
k AS (SELECT i, s, CAST(len(list_filter(range(0, 74), lambda b: (s // CAST(pow(2, 53) AS HUGEINT)) >= CAST(pow(2, b) AS HUGEINT))) AS INTEGER) AS k FROM s),
q AS (SELECT i, k, s // CAST(pow(2, k) AS HUGEINT) AS q, 2 * (s % CAST(pow(2, k) AS HUGEINT)) AS r, CAST(pow(2, k) AS HUGEINT) AS unit FROM k)
SELECT o_orderkey AS i, coalesce(CAST(CAST(q + CASE WHEN r > unit OR (r = unit AND q % 2 = 1) THEN 1 ELSE 0 END AS BIGINT) AS DOUBLE) * pow(2.0, k - 114), 0.0) AS y FROM orders LEFT JOIN q ON o_orderkey = q.i"""


@query(_EXACT)
def spmv_exact(spark, d):
    """Fractions as they are: discounts times sevenths, added up without error and rounded once."""
    coo = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_discount").alias("v"))
    x = table(spark, d, "part").select(F.col("p_partkey").alias("j"), (((F.col("p_partkey") * 7 + 3) % 10) / F.lit(7.0)).alias("x"))
    return exact.multiply(coo, x, domain(spark, d))


@query(f"WITH {COO} SELECT i, j, v FROM coo")
def coo_stream(spark, d):
    """Entries arrive as files, in two halves; the stream stops between and goes on from its checkpoint."""
    source, out, checkpoint = (scratch.folder(spark) for _ in range(3))
    own = entries(spark, d).withColumn("half", F.col("i") % 2)
    for half in (0, 1):
        own.where(f"half = {half}").drop("half").write.mode("append").parquet(source)
        deltas.follow(spark, source, out, checkpoint).awaitTermination()
    return deltas.state(spark, out)


@query("SELECT vec_id AS i, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda k: CAST(embedding[k] AS DOUBLE) * (((k - 1) * 7 + 3) % 10))), 6) AS y FROM embeddings")
def spmv_dense(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("a"))
    x = spark.range(EMBEDDED).select(F.col("id").alias("j"), ((F.col("id") * 7 + 3) % 10).cast("double").alias("x"))
    return spmv.multiply_dense(rows, x, EMBEDDED).withColumn("y", F.round("y", 6))


@query(f"WITH {COO}, w AS (SELECT o_orderkey AS i, CAST((o_orderkey * 7 + 3) % 10 AS DOUBLE) AS x FROM orders) SELECT p_partkey AS j, coalesce(sum(v * x), 0.0) AS y FROM part LEFT JOIN coo ON p_partkey = j LEFT JOIN w USING (i) GROUP BY 1")
def spmv_transpose(spark, d):
    x = domain(spark, d).select(F.col("i").alias("j"), ((F.col("i") * 7 + 3) % 10).cast("double").alias("x"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("i"))
    return spmv.multiply(matrix.transposed(a_matrix(spark, d)), x, rows).withColumnRenamed("i", "j")


@query(f"WITH {COO} SELECT i, j, v FROM coo")
def coo_coalesce(spark, d):
    return a_matrix(spark, d)


@query(f"WITH {COO} SELECT count(*) AS nnz FROM coo")
def coo_distinct_nnz(spark, d):
    return matrix.distinct_nnz(entries(spark, d))


@query(f"WITH {COO} SELECT i, j, v FROM coo ORDER BY i, j")
def coo_sorted(spark, d):
    return a_matrix(spark, d).orderBy("i", "j")


@query(f"WITH {COO} SELECT i, j, v, CAST(row_number() OVER (ORDER BY i, j) - 1 AS BIGINT) AS k FROM coo")
def nnz_ordinal(spark, d):
    return matrix.ordinals(a_matrix(spark, d))


@query("WITH l AS (SELECT l_orderkey AS i, l_partkey AS j, lag(l_orderkey) OVER w AS pi, lag(l_partkey) OVER w AS pj FROM lineitem WINDOW w AS (ORDER BY l_orderkey, l_partkey)) SELECT i, j, pi IS NULL OR pi <> i AS new_row, pi IS NULL OR pi <> i OR pj <> j AS new_col FROM l")
def coo_boundaries(spark, d):
    return matrix.boundaries(entries(spark, d))


def row_ptr(spark, d):
    return matrix.row_pointers(a_matrix(spark, d), domain(spark, d))


query(f"WITH {PTR} SELECT i, row_start, row_end FROM p")(row_ptr)
query(f"WITH {PTR}, o AS (SELECT i, j, v, CAST(row_number() OVER (ORDER BY i, j) - 1 AS BIGINT) AS k FROM coo) SELECT k, o.i, j, v, row_start, row_end FROM o JOIN p USING (i)", "coo_to_csr")(
    lambda spark, d: matrix.ordinals(a_matrix(spark, d)).join(row_ptr(spark, d), "i").select("k", "i", "j", "v", "row_start", "row_end")
)


@query(f"WITH {COO} SELECT i, count(*) AS n, min(j) AS first_col, max(j) AS last_col, sum(v) AS total FROM coo GROUP BY i")
def csr_rows_nested(spark, d):
    rows = matrix.nested_rows(a_matrix(spark, d))
    total = F.aggregate("vals", F.lit(0.0), lambda a, v: a + v)
    return rows.groupBy("i").agg(F.sum(F.size("cols")).alias("n"), F.min(F.element_at("cols", 1)).alias("first_col"), F.max(F.element_at("cols", -1)).alias("last_col"), F.sum(total).alias("total"))


def _part_query(name: str, column, sql: str) -> None:
    def run(spark, d):
        rows = domain(spark, d)
        return rows.withColumn("part", column(n_rows(spark, d))).groupBy("part").agg(F.count("*").alias("n_rows"), F.min("i").alias("min_i"), F.max("i").alias("max_i"))

    query(f"SELECT CAST({sql} AS BIGINT) AS part, count(*) AS n_rows, min(o_orderkey) AS min_i, max(o_orderkey) AS max_i FROM orders, (SELECT count(*) AS r FROM orders) GROUP BY 1", name)(run)


_part_query("part_static", lambda r: schedule.static("i", r, WORKERS), f"o_orderkey * {WORKERS} // r")
_part_query("part_static_chunked", lambda r: schedule.static_chunked("i", CHUNK, WORKERS), f"(o_orderkey // {CHUNK}) % {WORKERS}")
_part_query("part_dynamic", lambda r: schedule.dynamic("i", CHUNK), f"o_orderkey // {CHUNK}")
_part_query("part_manual", lambda r: schedule.manual("i", r, WORKERS), f"((o_orderkey + 1) * {WORKERS} - 1) // r")
_part_query("part_task", lambda r: schedule.task("i"), "o_orderkey")


@query(f"WITH RECURSIVE g AS (SELECT CAST(0 AS BIGINT) AS chunk, CAST(0 AS BIGINT) AS lo, (r + {WORKERS - 1}) // {WORKERS} AS hi, r FROM (SELECT count(*) AS r FROM orders) UNION ALL SELECT chunk + 1, hi, hi + (r - hi + {WORKERS - 1}) // {WORKERS}, r FROM g WHERE hi < r) SELECT chunk, lo, hi, (SELECT count(*) FROM orders WHERE o_orderkey >= lo AND o_orderkey < hi) AS n_rows FROM g")
def part_guided(spark, d):
    n = n_rows(spark, d)
    counts = domain(spark, d).groupBy(schedule.guided_chunk("i", n, WORKERS).alias("chunk")).agg(F.count("*").alias("n_rows"))
    return schedule.guided(spark, n, WORKERS).join(counts, "chunk", "left").select("chunk", "lo", "hi", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


@query(f"WITH {MERGE} SELECT part, row, nz FROM m")
def merge_path_coords(spark, d):
    return schedule.merge_coordinates(a_matrix(spark, d), domain(spark, d), WORKERS)


@query(f"""WITH {MERGE}, b AS (SELECT part, lead(row) OVER (ORDER BY part) - row AS n_rows, lead(nz) OVER (ORDER BY part) - nz AS nnz FROM m),
q AS (SELECT i, ((i + 1) * {WORKERS} - 1) // (SELECT count(*) FROM orders) AS part, n FROM n)
SELECT 'merge' AS scheme, part, CAST(n_rows AS BIGINT) AS n_rows, CAST(nnz AS BIGINT) AS nnz, CAST(n_rows + nnz AS BIGINT) AS items FROM b WHERE part < {WORKERS}
UNION ALL SELECT 'manual', CAST(part AS BIGINT), count(*), CAST(sum(n) AS BIGINT), CAST(count(*) + sum(n) AS BIGINT) FROM q GROUP BY part""")
def part_balance(spark, d):
    return schedule.balance(a_matrix(spark, d), domain(spark, d), WORKERS, n_rows(spark, d))


def perturbed(y: DataFrame) -> DataFrame:
    return y.select("i", F.when(F.col("i") % 97 == 0, F.col("y") + 0.5).otherwise(F.col("y")).alias("y"))


BAD = f"WITH {Y}, m AS (SELECT i, y AS a, CASE WHEN i % 97 = 0 THEN y + 0.5 ELSE y END AS b FROM y)"
ABSOLUTE, MIXED = "abs(a - b) > 1e-12", "abs(a - b) > 1e-15 + 1e-12 * greatest(abs(a), abs(b))"


def _pairs(spark, d):
    y = spmv_csr(spark, d)
    return validate.paired(y, perturbed(spmv_merge(spark, d)))


@query(f"{BAD} SELECT count(*) AS mismatches FROM m WHERE {ABSOLUTE}")
def spmv_validate(spark, d):
    return validate.mismatches(_pairs(spark, d), validate.absolute())


@query(f"{BAD} SELECT count(*) AS mismatches FROM m WHERE {MIXED}")
def spmv_validate_rel(spark, d):
    return validate.mismatches(_pairs(spark, d), validate.mixed())


@query(f"{BAD} SELECT i, a, b FROM m WHERE {ABSOLUTE} ORDER BY i LIMIT {validate.LISTED}")
def spmv_mismatch_topk(spark, d):
    return validate.first_mismatches(_pairs(spark, d), validate.absolute())


@query(f"WITH {Y} SELECT i, y FROM y ORDER BY i LIMIT 10")
def spmv_head10(spark, d):
    return spmv_csr(spark, d).orderBy("i").limit(10)


@query(f"WITH {X} SELECT j, x FROM x")
def vec_gen(spark, d):
    return vector(spark, d)


@query("SELECT p_partkey AS j, CAST(('0x' || substr(md5('0:' || CAST(p_partkey AS VARCHAR)), 1, 13)) AS BIGINT) / CAST(2251799813685248 AS DOUBLE) - 1 AS x FROM part")
def vec_gen_uniform(spark, d):
    return matrix.uniform_vector(table(spark, d, "part").select(F.col("p_partkey").alias("j")))


# the words of a type follow from the key of an order
_WORDS = {"f": (mtx.FORMATS, 1), "d": (mtx.FIELDS, 2), "s": (mtx.SYMMETRIES, 8)}
_CASES = "SELECT o_orderkey AS k, " + ", ".join(f"(['{"', '".join(w)}'])[1 + (o_orderkey // {div}) % {len(w)}] AS {name}" for name, (w, div) in _WORDS.items()) + " FROM orders"


def _codes(spark, d):
    word = lambda words, div: F.get(F.array(*map(F.lit, words)), F.expr(f"o_orderkey div {div} % {len(words)}"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), *(word(*w).alias(name) for name, w in _WORDS.items()))


@query(f"SELECT k, f, d, s, NOT ((f = 'array' AND d = 'pattern') OR (d = 'real' AND s = 'hermitian') OR (d = 'pattern' AND s IN ('hermitian', 'skew-symmetric'))) AS valid FROM ({_CASES})")
def mm_valid(spark, d):
    return _codes(spark, d).withColumn("valid", mtx.valid(F.col("f"), F.col("d"), F.col("s")))


@query(f"SELECT k, 'matrix ' || f || ' ' || d || ' ' || s AS text FROM ({_CASES})")
def mm_type_text(spark, d):
    return _codes(spark, d).select("k", mtx.type_text(F.col("f"), F.col("d"), F.col("s")).alias("text"))


@query(f"SELECT k, f, d, s, f = 'coordinate' AS is_sparse, f = 'array' AS is_dense, d = 'complex' AS is_complex, d = 'real' AS is_real, d = 'pattern' AS is_pattern, d = 'integer' AS is_integer, s = 'general' AS is_general, s = 'symmetric' AS is_symmetric, s = 'hermitian' AS is_hermitian, s = 'skew-symmetric' AS is_skew FROM ({_CASES})")
def mm_type_flags(spark, d):
    flags = {"is_sparse": "f = 'coordinate'", "is_dense": "f = 'array'"} | {f"is_{w}": f"d = '{w}'" for w in mtx.FIELDS} | {f"is_{w.split('-')[0]}": f"s = '{w}'" for w in mtx.SYMMETRIES}
    order = ("is_sparse", "is_dense", "is_complex", "is_real", "is_pattern", "is_integer", "is_general", "is_symmetric", "is_hermitian", "is_skew")
    return _codes(spark, d).select("k", "f", "d", "s", *(F.expr(flags[n]).alias(n) for n in order))


@query(f"""SELECT k, CAST(CASE k % 5 WHEN 1 THEN 12 WHEN 2 THEN 14 WHEN 3 THEN 15 ELSE 0 END AS INTEGER) AS code,
CASE WHEN k % 5 IN (0, 4) THEN f END AS format, CASE WHEN k % 5 IN (0, 4) THEN d END AS field, CASE WHEN k % 5 IN (0, 4) THEN s END AS symmetry FROM ({_CASES})""")
def mm_banner(spark, d):
    """Of five banners in a row one lacks a word, one begins wrongly, one is of no known type, and one is in capitals with tabs."""
    c = lambda *parts: F.concat_ws(" ", *(p if not isinstance(p, str) else F.lit(p) for p in parts))
    f, w, s = F.col("f"), F.col("d"), F.col("s")
    line = (
        F.when(F.expr("k % 5 = 1"), c(mtx.BANNER, "matrix", f, w)).when(F.expr("k % 5 = 2"), c("%MatrixMarket", "matrix", f, w, s))
        .when(F.expr("k % 5 = 3"), c(mtx.BANNER, "matrix", f, "quaternion", s)).when(F.expr("k % 5 = 4"), F.concat_ws("\t", F.lit(mtx.BANNER), F.upper(F.lit("matrix")), F.upper(f), F.upper(w), F.upper(s)))
        .otherwise(c(mtx.BANNER, "matrix", f, w, s))
    )
    return _codes(spark, d).select("k", mtx.banner_columns(line).alias("b")).select("k", "b.code", "b.format", "b.field", "b.symmetry")


def _written(spark, d) -> str:
    """The matrix as Matrix Market text in the scratch folder that the cluster shares."""
    path = scratch.folder(spark)
    mtx_format.save(a_matrix(spark, d), path, field="integer", rows=n_rows(spark, d), cols=table(spark, d, "part").count())
    return path


def _typed(spark, head: str, body: DataFrame) -> str:
    """A file with comments, a blank line, tabs and white space, and a surplus entry: lines by their key `at`."""
    path = scratch.folder(spark)
    first = spark.createDataFrame([(-1, head)], "at long, value string")
    last = spark.createDataFrame([(1 << 62, "1 1 77")], "at long, value string")
    spaced = body.select("at", F.when(F.col("at") % 3 == 0, F.concat(F.lit("\t "), F.replace("value", F.lit(" "), F.lit("\t")), F.lit(" "))).otherwise(F.col("value")).alias("value"))
    first.union(spaced).union(last).repartitionByRange("at").sortWithinPartitions("at").select("value").write.text(path)
    return path


@query(f"WITH {COO} SELECT 'coordinate' AS format, 'integer' AS field, 'general' AS symmetry, (SELECT count(*) FROM orders) AS n_rows, (SELECT count(*) FROM part) AS n_cols, (SELECT count(*) FROM coo) AS nnz")
def mm_size(spark, d):
    meta, _ = mtx_format.header(_written(spark, d))
    return spark.createDataFrame([(meta.format, meta.field, meta.symmetry, meta.n_rows, meta.n_cols, meta.nnz)], "format string, field string, symmetry string, n_rows long, n_cols long, nnz long")


@query(f"WITH {COO} SELECT i + 1 AS i, j + 1 AS j, v FROM coo")
def mm_coo(spark, d):
    return mtx_format.load(spark, _written(spark, d), zero_based=False)[1]


@query(f"WITH {COO} SELECT i, j, v FROM coo")
def mm_coo_zero_based(spark, d):
    return mtx_format.load(spark, _written(spark, d))[1]


def _dense(spark, d) -> str:
    """The embeddings as a dense array: a column for each vector, as arrays are written by columns."""
    cells = table(spark, d, "embeddings").select(F.col("vec_id").alias("j"), F.posexplode("embedding").alias("i", "v")).select("i", "j", F.col("v").cast("double").alias("v"))
    path = scratch.folder(spark)
    mtx_format.save(cells, path, matrix="array", rows=EMBEDDED)
    return path


@query(f"SELECT 'array' AS format, CAST({EMBEDDED} AS BIGINT) AS n_rows, count(*) AS n_cols, {EMBEDDED} * count(*) AS cells FROM embeddings")
def mm_array_size(spark, d):
    meta, _ = mtx_format.header(_dense(spark, d))
    return spark.createDataFrame([(meta.format, meta.n_rows, meta.n_cols, meta.nnz)], "format string, n_rows long, n_cols long, cells long")


@query("SELECT CAST(unnest(range(0, len(embedding))) AS BIGINT) AS i, vec_id AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings")
def mm_array(spark, d):
    return mtx_format.load(spark, _dense(spark, d))[1]


# the lower triangle: of each coordinate the greater number first
LOWER = "low AS (SELECT greatest(i, j) AS i, least(i, j) AS j, sum(v) AS v FROM coo GROUP BY 1, 2)"


def _lower(spark, d) -> DataFrame:
    return entries(spark, d).select(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"), "v").groupBy("i", "j").agg(F.sum("v").alias("v"))


def _triangle(spark, d, kind: str, value: list) -> str:
    low = _lower(spark, d)
    size = n_rows(spark, d)
    at = (F.col("i") * size + F.col("j")).alias("at")
    body = low.select(at, F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), *value).alias("value"))
    return _typed(spark, f"{mtx.BANNER} matrix coordinate {kind}\n% a comment\n%\n\n{size} {size} {low.count()}", body)


@query(f"WITH {COO}, {LOWER} SELECT i, j, v FROM low UNION ALL SELECT j, i, v FROM low WHERE i <> j")
def mm_symmetric(spark, d):
    return mtx.read(spark, _triangle(spark, d, "real symmetric", [F.col("v").cast("string")]), expand_symmetry=True)[1]


@query(f"WITH {COO}, {LOWER} SELECT i, j, 1.0::DOUBLE AS v FROM low")
def mm_pattern(spark, d):
    return mtx_format.load(spark, _triangle(spark, d, "pattern symmetric", []))[1]


@query(f"WITH {COO}, {LOWER} SELECT i, j, v, v + 0.5 AS im FROM low UNION ALL SELECT j, i, v, -(v + 0.5) FROM low WHERE i <> j")
def mm_hermitian(spark, d):
    return mtx_format.load(spark, _triangle(spark, d, "complex hermitian", [F.col("v").cast("string"), (F.col("v") + 0.5).cast("string")]), expand_symmetry=True)[1]


# a matrix for each 200 orders; of seven heads in a row four are broken, one has comments and blank lines, one a line that is too long
_HEADS = _CASES.replace("o_orderkey", "m").replace("m AS k", "m AS k, n_rows, n_cols, nnz").replace("FROM orders", "FROM g")


@query(f"""WITH g AS (SELECT o_orderkey // 200 AS m, max(o_orderkey) + 1 AS n_rows, max(l_partkey) + 1 AS n_cols, count(*) AS nnz FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
h AS (SELECT *, CASE k % 7 WHEN 1 THEN 12 WHEN 2 THEN 14 WHEN 3 THEN 15 WHEN 4 THEN 12 WHEN 5 THEN 16 ELSE 0 END AS code FROM ({_HEADS})), fine AS (SELECT * FROM h WHERE code = 0)
SELECT h.k, CAST(h.code AS INTEGER) AS code, x.f AS format, x.d AS field, x.s AS symmetry, x.n_rows, x.n_cols, CASE x.f WHEN 'array' THEN x.n_rows * x.n_cols ELSE x.nnz END AS nnz,
NOT ((x.f = 'array' AND x.d = 'pattern') OR (x.d = 'real' AND x.s = 'hermitian') OR (x.d = 'pattern' AND x.s IN ('hermitian', 'skew-symmetric'))) AS valid, x.f = 'coordinate' AND x.d <> 'complex' AS in_product
FROM h LEFT JOIN fine x ON h.k = x.k""")
def mm_inventory(spark, d):
    """A collection of matrices is written, whole and broken ones; their heads are read, each up to its size line."""
    path = scratch.folder(spark)
    own = entries(spark, d).join(domain(spark, d), "i").withColumn("o_orderkey", F.expr("i div 200"))
    words = {name: F.get(F.array(*map(F.lit, w)), F.expr(f"o_orderkey div {div} % {len(w)}")) for name, (w, div) in _WORDS.items()}
    size = own.groupBy("o_orderkey").agg((F.max("i") + 1).alias("n_rows"), (F.max("j") + 1).alias("n_cols"), F.count("*").alias("nnz")).withColumns(words)
    broken = F.expr("o_orderkey % 7")
    kind = F.when(broken == 3, "quaternion").otherwise(F.col("d"))
    banner = F.concat_ws(" ", F.when(broken == 2, "%MatrixMarket").otherwise(mtx.BANNER), F.lit("matrix"), "f", kind, F.when(broken != 1, F.col("s")))
    text = lambda c: c.cast("string")
    numbers = F.concat_ws(" ", text(F.col("n_rows")), F.when(broken == 4, "x"), F.when(broken == 5, F.repeat(F.lit(" "), F.lit(mtx.LONGEST_LINE))), text(F.col("n_cols")), F.when(F.col("f") == "coordinate", text(F.col("nnz"))))
    head = size.select("o_orderkey", F.lit(-1).cast("long").alias("at"), F.concat(banner, F.lit("\n"), F.when(broken == 6, "% a comment\n\n  %\n").otherwise(""), numbers).alias("value"))
    body = own.select("o_orderkey", F.col("i").alias("at"), F.concat_ws(" ", text(F.col("i") + 1), text(F.col("j") + 1), text(F.col("v"))).alias("value"))
    lines = head.unionByName(body).repartition("o_orderkey").sortWithinPartitions("o_orderkey", "at")
    lines.select("value", F.col("o_orderkey").alias("k")).write.partitionBy("k").text(path)
    found = mtx_format.inventory(spark, path)
    return found.select(F.regexp_extract("place", "k=(\\d+)$", 1).cast("long").alias("k"), "code", "format", "field", "symmetry", "n_rows", "n_cols", "nnz", "valid", "in_product")


RESULTS = "SELECT event_id, user_id, ts, 'spmv_' || lower(event_type) AS \"Executable\", CAST(user_id % 8 + 1 AS INTEGER) AS \"Threads\", CAST(event_id % 10 + 1 AS INTEGER) AS \"Run\", CAST(10 * (event_id % 3 + 1) AS INTEGER) AS c, value AS \"Time\" FROM events"


@query(f"""WITH r AS ({RESULTS}) SELECT "Executable", "Threads", "Run", CASE WHEN event_id % 4 >= 2 THEN c END AS "ChunkSize", "Time", CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd_one' END AS matrix,
CASE WHEN event_id % 2 = 0 THEN 'TESTBENCH2_RES' ELSE 'TESTBENCH3_RES' END AS testbench, event_id % 4 >= 2 AS chunked FROM r""")
def results_scan(spark, d):
    """Written as result files of two testbenches, two matrices, plain and chunked, then scanned."""
    path = scratch.folder(spark)
    e = table(spark, d, "events")
    rows = e.select(
        "event_id", "user_id", F.concat(F.lit("spmv_"), F.lower("event_type")).alias("Executable"), (F.col("user_id") % 8 + 1).cast("int").alias("Threads"), (F.col("event_id") % 10 + 1).cast("int").alias("Run"),
        F.when(F.col("event_id") % 4 >= 2, (10 * (F.col("event_id") % 3 + 1)).cast("int")).alias("ChunkSize"), F.col("value").alias("Time"),
    )
    name = F.concat(F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd_one"), F.when(F.col("event_id") % 4 >= 2, "_chunked.csv").otherwise(".csv"))
    placed = rows.select("*", F.concat(F.lit("TESTBENCH"), (F.col("event_id") % 2 + 2).cast("string"), F.lit("_RES")).alias("testbench"), name.alias("file"))
    results.append_all(placed.drop("event_id", "user_id"), path)
    return results.scan(spark, path)


@query("SELECT event_type AS executable, count(*) AS n, CAST(count(DISTINCT user_id % 4) AS BIGINT) AS n_threads FROM events GROUP BY 1")
def bench_dims(spark, d):
    return timings(spark, d).groupBy("executable").agg(F.count("*").alias("n"), F.count_distinct("threads").alias("n_threads"))


@query(f"WITH {T} SELECT executable, threads, chunk, count(*) AS n, min(time) AS least, max(time) AS most FROM t GROUP BY ALL")
def bench_scan(spark, d):
    return timings(spark, d).groupBy("executable", "threads", "chunk").agg(F.count("*").alias("n"), F.min("time").alias("least"), F.max("time").alias("most"))


@query(f"WITH {P90} SELECT executable, threads, round(p90, 6) AS p90 FROM p")
def bench_p90(spark, d):
    return analytics.p90(timings(spark, d)).withColumn("p90", F.round("p90", 6))


@query(f"WITH {T} SELECT executable, threads, round(coalesce(stddev_samp(time), 0), 6) AS std FROM t GROUP BY ALL")
def bench_std(spark, d):
    return analytics.std(timings(spark, d)).withColumn("std", F.round("std", 6))


@query(f"WITH {T} SELECT executable, threads, round(avg(time), 6) AS mean FROM t GROUP BY ALL")
def bench_avg(spark, d):
    return analytics.mean(timings(spark, d)).withColumn("mean", F.round("mean", 6))


@query(f"WITH {P90C} SELECT executable, threads, chunk, round(p90, 6) AS p90 FROM c")
def bench_chunk_p90(spark, d):
    return analytics.chunk_p90(timings(spark, d)).withColumn("p90", F.round("p90", 6))


BASE = "CLICK"


@query(f"WITH {P90} SELECT round(avg(p90), 6) AS baseline FROM p WHERE executable = (SELECT min(executable) FROM p WHERE lower(executable) LIKE '%click%')")
def bench_baseline(spark, d):
    return analytics.baseline(analytics.p90(timings(spark, d)), BASE).withColumn("baseline", F.round("baseline", 6))


@query(f"""WITH {P90}, b AS (SELECT avg(p90) AS b FROM p WHERE executable = (SELECT min(executable) FROM p WHERE lower(executable) LIKE '%click%'))
SELECT executable, threads, round(b / (p90 * threads) * 100, 6) AS efficiency FROM p, b WHERE lower(executable) NOT LIKE '%click%' UNION ALL SELECT DISTINCT 'ideal', threads, 100.0 FROM p""")
def bench_efficiency(spark, d):
    return analytics.efficiency(scratch.saved(analytics.p90(timings(spark, d))), BASE).withColumn("efficiency", F.round("efficiency", 6))


@query(f"""WITH {P90}, x AS (SELECT *, dense_rank() OVER (ORDER BY threads) AS x FROM p), r AS (SELECT *, rank() OVER (PARTITION BY x ORDER BY p90) AS rank FROM x)
SELECT executable, x, round(p90, 6) AS y, rank, CASE WHEN rank % 2 = 0 THEN 'left' ELSE 'top' END AS side, CASE WHEN p90 >= 0.01 THEN printf('%.3f', p90) WHEN p90 >= 0.001 THEN printf('%.4f', p90) ELSE printf('%.2e', p90) END AS label FROM r""")
def bench_labels(spark, d):
    return analytics.labels(analytics.p90(timings(spark, d))).withColumn("y", F.round("y", 6))


@query(f"""WITH {P90}, b AS (SELECT avg(p90) AS b FROM p WHERE executable = (SELECT min(executable) FROM p WHERE lower(executable) LIKE '%click%')),
e AS (SELECT executable, threads, b / (p90 * threads) * 100 AS y FROM p, b WHERE lower(executable) NOT LIKE '%click%'), x AS (SELECT *, dense_rank() OVER (ORDER BY threads) AS x FROM e), r AS (SELECT *, rank() OVER (PARTITION BY x ORDER BY y) AS rank FROM x)
SELECT executable, x, round(y, 6) AS y, rank, CASE WHEN rank % 2 = 0 THEN 'left' ELSE 'top' END AS side, printf('%.1f', y) || '%' AS label FROM r""")
def bench_efficiency_labels(spark, d):
    return analytics.efficiency_labels(scratch.saved(analytics.p90(timings(spark, d))), BASE).withColumn("y", F.round("y", 6))


@query(f"WITH {P90}, {p90_sql('executable, threads, chunk', 'c')} SELECT 'default' AS bench, executable, threads, CAST(NULL AS BIGINT) AS chunk, round(p90, 6) AS p90 FROM p UNION ALL SELECT 'chunked', executable, threads, chunk, round(p90, 6) FROM c")
def bench_union(spark, d):
    t = timings(spark, d)
    plain = analytics.p90(t).select(F.lit("default").alias("bench"), "executable", "threads", F.lit(None).cast("long").alias("chunk"), F.round("p90", 6).alias("p90"))
    return plain.unionByName(analytics.chunk_p90(t).select(F.lit("chunked").alias("bench"), "executable", "threads", "chunk", F.round("p90", 6).alias("p90")))


@query(f"WITH {P90C} SELECT executable, chunk, " + ", ".join(f"round(max(CASE WHEN threads = {t} THEN p90 END), 6) AS t{t}" for t in (1, 2, 4, 8)) + " FROM c GROUP BY ALL")
def heat_pivot(spark, d):
    wide = analytics.heat(analytics.chunk_p90(timings(spark, d)), [1, 2, 4, 8])
    return wide.select("executable", "chunk", *(F.round(f"t{t}", 6).alias(f"t{t}") for t in (1, 2, 4, 8)))


@query(f"""WITH {P90C}, s AS (SELECT executable, min(p90) AS lo, max(p90) AS hi FROM c GROUP BY 1)
SELECT executable, threads, chunk, CAST(CASE WHEN hi = lo THEN 256 ELSE least(greatest(round((p90 - lo) / (hi - lo) * 255) + 1, 1), 256) END AS BIGINT) AS bin FROM c JOIN s USING (executable)""")
def heat_bins(spark, d):
    return analytics.bins(analytics.chunk_p90(timings(spark, d)))


@query("""WITH e AS (SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN 'runtime_static' WHEN 1 THEN 'runtime_dynamic' WHEN 2 THEN 'runtime_guided' ELSE 'merge' END AS executable FROM orders),
k AS (SELECT executable, CASE executable WHEN 'runtime_static' THEN 'static' WHEN 'runtime_dynamic' THEN 'dynamic' WHEN 'runtime_guided' THEN 'guided' END AS schedule FROM e)
SELECT s_name AS matrix, executable, CAST(t AS BIGINT) AS threads, CAST(run AS BIGINT) AS run, CAST(CASE WHEN schedule IS NULL THEN NULL ELSE chunk END AS BIGINT) AS chunk, schedule
FROM supplier, k, unnest([1, 2, 4, 8]) a(t), range(1, 4) b(run), unnest([10, 100, 1000, 10000]) c(chunk) WHERE schedule IS NOT NULL OR chunk = 10""")
def sweep_plan(spark, d):
    """A matrix for each supplier."""
    kind = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'runtime_static' WHEN 1 THEN 'runtime_dynamic' WHEN 2 THEN 'runtime_guided' ELSE 'merge' END")
    executables = table(spark, d, "orders").select(kind.alias("executable")).distinct()
    matrices = table(spark, d, "supplier").select(F.col("s_name").alias("matrix"))
    numbers = lambda name, values: spark.range(1).select(F.explode(F.array(*(F.lit(v).cast("long") for v in values))).alias(name))
    return sweep.plan(matrices, executables, numbers("threads", (1, 2, 4, 8)), numbers("run", (1, 2, 3)), numbers("chunk", (10, 100, 1000, 10000)))


@query("""SELECT s_nationkey AS matrix, executable, CAST(t AS BIGINT) AS threads, CAST(1 AS BIGINT) AS run, CAST(CASE WHEN executable = 'merge' THEN NULL ELSE 100 END AS BIGINT) AS chunk, true AS measured
FROM (SELECT DISTINCT CAST(s_nationkey % 2 AS VARCHAR) AS s_nationkey FROM supplier), unnest(['merge', 'runtime_static']) e(executable), unnest([1, 2]) a(t)""")
def sweep_cells(spark, d):
    """A plan over two halves of the matrix, run, broken off after three cells, and resumed; what the result files then hold."""
    own, path = scratch.saved(entries(spark, d)), scratch.folder(spark)
    rows = domain(spark, d)
    numbers = lambda name, *values: spark.range(1).select(F.explode(F.array(*(F.lit(v).cast("long") for v in values))).alias(name))
    matrices = table(spark, d, "supplier").select((F.col("s_nationkey") % 2).cast("string").alias("matrix")).distinct()
    kinds = spark.range(1).select(F.explode(F.array(F.lit("merge"), F.lit("runtime_static"))).alias("executable"))
    cells = sweep.plan(matrices, kinds, numbers("threads", 1, 2), numbers("run", 1), numbers("chunk", 100))

    def product(cell: dict) -> DataFrame:
        coo = own.where(F.expr("i % 2").cast("string") == cell["matrix"])
        return spmv.multiply(coo.repartition(cell["threads"], "i"), vector(spark, d), rows)

    results.reset(spark, path)
    for most in (3, None):
        sweep.run(spark, cells, {"merge": product, "runtime_static": product}, path, "TESTBENCH3_RES", most=most)
    found = results.scan(spark, path)
    return found.select("matrix", F.col("Executable").alias("executable"), F.col("Threads").cast("long").alias("threads"), F.col("Run").cast("long").alias("run"), F.col("ChunkSize").cast("long").alias("chunk"), (F.col("Time") > 0).alias("measured"))


# the notations in which programs print seconds, and lines that are no timing
_LINE = "CASE event_id % 4 WHEN 0 THEN 'Elapsed time: ' || {six} || ' seconds' WHEN 1 THEN 'Elapsed time: ' || {e} || ' seconds' WHEN 2 THEN '  Elapsed time: ' || {whole} ELSE 'run ' || {whole} || ' 3 done' END"


@query("WITH l AS (SELECT event_id, " + _LINE.format(six="printf('%.6f', value)", e="printf('%.5e', value / 1e6)", whole="CAST(event_id AS VARCHAR)") + " AS line FROM events) SELECT event_id, CASE WHEN contains(line, 'Elapsed time') THEN TRY_CAST(regexp_extract(line, '^\\s*\\S+\\s+\\S+\\s+(\\S+)', 1) AS DOUBLE) END AS seconds FROM l")
def parse_elapsed(spark, d):
    line = F.expr(_LINE.format(six="format_string('%.6f', value)", e="format_string('%.5e', value / 1e6D)", whole="CAST(event_id AS STRING)"))
    return table(spark, d, "events").select("event_id", line.alias("line")).select("event_id", results.elapsed("line").alias("seconds"))
