"""Vector functions, transforms, quantisers, codecs and losses as projections of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, losses
from ..functions import quantize as z
from ..functions import vectors as m
from ..operators import exact, statistics
from ..runtime import table
from .common import D, PARTS, Registry, asked, books, books_column, centroids, shown, sql, vectors

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
AB = "e JOIN c ON list_no = label"


def _with_centroid(v: DataFrame) -> DataFrame:
    return v.join(F.broadcast(centroids(v)), F.col("label") == F.col("list_no"))


@query(
    sql(
        "e c",
        f"""SELECT id, ROUND(LIST_INNER_PRODUCT(v, c), 6) AS ip, ROUND(POW(LIST_DISTANCE(v, c), 2), 6) AS l2, ROUND(LIST_SUM([ABS(v[i] - c[i]) FOR i IN RANGE(1, {D + 1})]), 6) AS l1,
ROUND(LIST_MAX([ABS(v[i] - c[i]) FOR i IN RANGE(1, {D + 1})]), 6) AS linf, ROUND(LIST_COSINE_SIMILARITY(v, c), 6) AS cosine, ROUND(SQRT(LIST_INNER_PRODUCT(c, c)), 6) AS norm,
ROUND(POW(LIST_DISTANCE(v, c), 2), 6) AS l2_of_ip FROM {AB}""",
    )
)
def vector_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector and the mean of its label, by all metrics."""
    return _with_centroid(vectors(spark, sf_dir)).select(
        "id", F.round(m.dot("vec", "c"), 6).alias("ip"), F.round(m.squared_l2("vec", "c"), 6).alias("l2"), F.round(m.l1("vec", "c"), 6).alias("l1"), F.round(m.linf("vec", "c"), 6).alias("linf"),
        F.round(m.cosine("vec", "c"), 6).alias("cosine"), F.round(m.norm("c"), 6).alias("norm"),
        F.round(m.l2_from_ip(m.squared_norm("vec"), m.squared_norm("c"), m.dot("vec", "c")), 6).alias("l2_of_ip"),
    )


@query(sql("e c", "SELECT id, list_no, ROUND(LIST_INNER_PRODUCT(v, c), 6) AS ip, ROUND(POW(LIST_DISTANCE(v, c), 2), 6) AS l2 FROM e, c"))
def one_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with all centroids."""
    v = vectors(spark, sf_dir)
    c = centroids(v).select("list_no", "c")
    ip, l2 = (exact.knn(v.select(F.col("id").alias("qid"), F.col("vec").alias("q")), c, 1 << 30, x, id="list_no", vec="c").select(F.col("qid").alias("id"), F.col("id").cast("int").alias("list_no"), F.round("score", 6).alias(x)) for x in ("ip", "l2"))
    return ip.join(l2, ["id", "list_no"])


@query(sql("e c", "SELECT id, ARG_MIN(list_no, (POW(LIST_DISTANCE(v, c), 2), list_no)) AS nearest, ROUND(MIN(POW(LIST_DISTANCE(v, c), 2)), 6) AS l2 FROM e, c GROUP BY id"))
def nearest_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    found = exact.knn(v, centroids(v), 1, "l2", "id", "vec", "list_no", "c")
    return found.select(F.col("qid").alias("id"), F.col("id").cast("int").alias("nearest"), F.round("score", 6).alias("l2"))


@query(sql("e a", "SELECT x.qid AS qid, y.qid AS id, ROUND(POW(LIST_DISTANCE(x.q, y.q), 2), 6) AS score FROM a x, a y"))
def pairwise_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of squared distances between all queries."""
    q = asked(vectors(spark, sf_dir))
    return shown(exact.knn(q, q, 1 << 30, "l2", id="qid", vec="q").drop("rank"))


@query(sql("e c", f"SELECT id, [ROUND(v[i] - c[i], 6) FOR i IN RANGE(1, {D + 1})] AS residual FROM {AB}"))
def residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_centroid(vectors(spark, sf_dir)).select("id", F.transform(m.subtract("vec", "c"), lambda x: F.round(x, 6)).alias("residual"))


@query(sql("e c", f"SELECT id, [ROUND((3 * x) / SQRT(LIST_INNER_PRODUCT([3 * y FOR y IN v], [3 * y FOR y IN v])), 6) FOR x IN v] AS unit, CAST([0, 0, 0] AS DOUBLE[]) AS zero FROM {AB}"))
def renorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tripled vectors back to unit length; zeros stay zeros."""
    tripled = F.transform("vec", lambda x: x * 3)
    zero = m.renormalised(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    return vectors(spark, sf_dir).select("id", F.transform(m.renormalised(tripled), lambda x: F.round(x, 6)).alias("unit"), zero.alias("zero"))


@query(
    sql(
        "e c",
        f"""SELECT id, ROUND(LIST_SUM([v[i] + c[i] FOR i IN RANGE(1, {D + 1})]), 6) AS added, ROUND(LIST_SUM([v[i] - c[i] FOR i IN RANGE(1, {D + 1})]), 6) AS taken, ROUND(LIST_SUM([x + 0.5 FOR x IN v]), 6) AS raised,
ROUND(LIST_SUM([v[i] + 2 * c[i] FOR i IN RANGE(1, {D + 1})]), 6) AS moved, CAST(LIST_POSITION([v[i] + 2 * c[i] FOR i IN RANGE(1, {D + 1})], LIST_MIN([v[i] + 2 * c[i] FOR i IN RANGE(1, {D + 1})])) - 1 AS INTEGER) AS least FROM {AB}""",
    )
)
def vector_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda x: F.round(m.total(x), 6)
    moved = m.multiply_add("vec", F.lit(2.0), "c")
    return _with_centroid(vectors(spark, sf_dir)).select("id", r(m.add("vec", "c")).alias("added"), r(m.subtract("vec", "c")).alias("taken"), r(m.add_scalar("vec", 0.5)).alias("raised"), r(moved).alias("moved"), m.arg_min(moved).alias("least"))


#: a rotation of each pair of neighbouring dimensions by one angle, then half of the dimensions
_C, _S = 0.6, 0.8
ROTATE = [[_C if j == i else (-_S if i % 2 == 0 else _S) if j == (i ^ 1) else 0.0 for j in range(D)] for i in range(D)]
_ROTATED = f"[CASE WHEN i % 2 = 1 THEN {_C} * v[i] - {_S} * v[i + 1] ELSE {_S} * v[i - 1] + {_C} * v[i] END + 0.25 FOR i IN RANGE(1, {D + 1})]"


@query(sql("e", f"SELECT id, [ROUND(x, 6) FOR x IN {_ROTATED}[1:32]] AS y FROM e"))
def linear_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = m.linear("vec", ROTATE[:32], [0.25] * 32)
    return vectors(spark, sf_dir).select("id", F.transform(y, lambda x: F.round(x, 6)).alias("y"))


@query(sql("e", f"SELECT id, [ROUND(2 * x - 1, 6) FOR x IN {_ROTATED}[1:16]] AS y FROM e"))
def transform_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    halved = [[2.0 if j == i else 0.0 for j in range(32)] for i in range(16)]
    y = m.chain("vec", [(ROTATE[:32], [0.25] * 32), (halved, [-1.0] * 16)])
    return vectors(spark, sf_dir).select("id", F.transform(y, lambda x: F.round(x, 6)).alias("y"))


@query(sql("e", "SELECT id, [ROUND(x, 6) FOR x IN v] AS x FROM e"))
def reverse_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There and back."""
    back = m.reverse_linear(m.linear("vec", ROTATE, [0.25] * D), ROTATE, [0.25] * D)
    return vectors(spark, sf_dir).select("id", F.transform(back, lambda x: F.round(x, 6) + F.lit(0.0)).alias("x"))


@query(sql("e", "SELECT id, v[1:24] AS x FROM e"))
def reduce_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", m.truncated("vec", 24).alias("x"))


@query(sql("e", "SELECT id, [CAST(GREATEST(LEAST(FLOOR(x * 127 + 128), 255), 0) AS INTEGER) FOR x IN v] AS code FROM e"))
def sq8_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", z.direct8("vec").alias("code"))


_RANGES = "j AS (SELECT j, MIN(x) AS low, MAX(x) - MIN(x) AS span FROM (SELECT UNNEST(v) AS x, UNNEST(RANGE(LEN(v))) AS j FROM e) GROUP BY j), r AS (SELECT LIST(low ORDER BY j) AS low, LIST(span ORDER BY j) AS span FROM j)"


def _sq(bits: int) -> str:
    top = (1 << bits) - 1
    return f"[CAST(FLOOR(GREATEST(LEAST((v[i] - low[i]) / span[i], 1.0), 0.0) * {top}) AS INTEGER) FOR i IN RANGE(1, {D + 1})]"


def _ranges(v: DataFrame) -> DataFrame:
    """One row with the ranges of all dimensions."""
    return statistics.per_dimension(v, "vec").agg(*[F.sort_array(F.collect_list(F.struct("j", c))).getField(c).alias(c) for c in ("low", "span")])


@query(sql("e", f"SELECT id, {_sq(8)} AS code8, {_sq(6)} AS code6, {_sq(4)} AS code4, [ROUND(low[i] + (CAST({_sq(4)}[i] AS DOUBLE) + 0.5) / 15 * span[i], 6) FOR i IN RANGE(1, {D + 1})] AS back4 FROM e, r").replace("\nSELECT", ",\n" + _RANGES + "\nSELECT", 1))
def sq_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar quantisation over the range of every dimension, in three widths, and back."""
    v = vectors(spark, sf_dir)
    rows = v.join(F.broadcast(_ranges(v)))
    coded = rows.select("id", "low", "span", *[z.scalar_encode("vec", F.col("low"), F.col("span"), b).alias(f"code{b}") for b in (8, 6, 4)])
    back = z.scalar_decode(F.col("code4"), F.col("low"), F.col("span"), 4)
    return coded.select("id", "code8", "code6", "code4", F.transform(back, lambda x: F.round(x, 6)).alias("back4"))


@query(sql("e", f"SELECT id, [CAST(FLOOR(GREATEST(LEAST((x - low) / span, 1.0), 0.0) * 255) AS INTEGER) FOR x IN v] AS code8, [CAST(FLOOR(GREATEST(LEAST((x - low) / span, 1.0), 0.0) * 15) AS INTEGER) FOR x IN v] AS code4 FROM e, (SELECT MIN(x) AS low, MAX(x) - MIN(x) AS span FROM (SELECT UNNEST(v) AS x FROM e))"))
def sq_uniform_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same range for all dimensions."""
    v = vectors(spark, sf_dir)
    one = statistics.per_dimension(v, "vec").agg(F.min("low").alias("low"), (F.max("high") - F.min("low")).alias("span"))
    same = lambda c: F.array_repeat(F.col(c), D)
    return v.join(F.broadcast(one)).select("id", *[z.scalar_encode("vec", same("low"), same("span"), b).alias(f"code{b}") for b in (8, 4)])


@query()
def sq_half_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-precision bit patterns and the greatest error they bring."""
    rows = vectors(spark, sf_dir).select("id", "vec", codecs.fp16_encode("vec").alias("code"))
    return rows.select("id", "code", F.round(m.linf("vec", codecs.fp16_decode("code")), 6).alias("error"))


@query(sql("e", "SELECT CAST(j AS INTEGER) AS j, ROUND(MIN(x), 6) AS low, ROUND(MAX(x), 6) AS high, ROUND(MAX(x) - MIN(x), 6) AS span, ROUND(AVG(x), 6) AS mean, ROUND(STDDEV_POP(x), 6) AS sd FROM (SELECT UNNEST(v) AS x, UNNEST(RANGE(LEN(v))) AS j FROM e) GROUP BY j"))
def sq_minmax_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges for scalar quantisation by extremes and by mean and deviation."""
    out = statistics.per_dimension(vectors(spark, sf_dir), "vec")
    return out.select("j", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("low", "high", "span", "mean", "sd")])


@query(sql("e", "SELECT CAST(j AS INTEGER) AS j, ROUND(QUANTILE_CONT(x, 0.05), 6) AS low, ROUND(QUANTILE_CONT(x, 0.95) - QUANTILE_CONT(x, 0.05), 6) AS span FROM (SELECT UNNEST(v) AS x, UNNEST(RANGE(LEN(v))) AS j FROM e) GROUP BY j"))
def sq_quantile_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.quantile_ranges(vectors(spark, sf_dir), "vec", 0.05)
    return out.select("j", F.round("low", 6).alias("low"), F.round("span", 6).alias("span"))


@query(sql("e w b k", "SELECT id, code FROM k"))
def pq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return v.select("id", z.pq_encode("vec", books_column(books(v)), PARTS).alias("code"))


@query(sql("e w b k ke", "SELECT id, FLATTEN(LIST([ROUND(x, 6) FOR x IN s] ORDER BY ke.m)) AS x FROM ke JOIN b ON ke.m = b.m AND ke.code = b.code GROUP BY id"))
def pq_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    book = books_column(books(v))
    back = z.pq_decode(z.pq_encode("vec", book, PARTS), book)
    return v.select("id", F.transform(back, lambda x: F.round(x, 6)).alias("x"))


@query(sql("e a w b ti", "SELECT qid, m, LIST(ROUND(x, 6) ORDER BY code) AS entries FROM ti GROUP BY qid, m"))
def adc_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    t = asked(v).select("qid", F.posexplode(z.adc_table("q", books_column(books(v)), PARTS, "ip")).alias("m", "e"))
    return t.select("qid", "m", F.transform("e", lambda x: F.round(x, 6)).alias("entries"))


@query(
    sql(
        "e a w b tl",
        """, s AS (SELECT qid, LEAST(255.0 / MAX(hi - lo), 65535.0 / SUM(hi - lo)) AS a, SUM(lo) AS b FROM (SELECT qid, m, MIN(x) AS lo, MAX(x) AS hi FROM tl GROUP BY qid, m) GROUP BY qid)
SELECT qid, ROUND(a, 4) AS a, ROUND(b, 6) AS b FROM s""",
    ).replace("\n, s AS", ",\ns AS")
)
def lut_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale and offset by which the table of every query becomes one of eight-bit entries."""
    v = vectors(spark, sf_dir)
    s = asked(v).select("qid", z.lut_scale(z.adc_table("q", books_column(books(v)), PARTS, "l2")).alias("s"))
    return s.select("qid", F.round("s.a", 4).alias("a"), F.round("s.b", 6).alias("b"))


@query(
    sql(
        "e w b k",
        """, d AS (SELECT x.m AS m, x.code AS p, y.code AS o, POW(LIST_DISTANCE(x.s, y.s), 2) AS g FROM b x JOIN b y USING (m)),
p AS (SELECT k.id AS id, z.id AS other, UNNEST(k.code) AS p, UNNEST(z.code) AS o, UNNEST(RANGE(LEN(k.code))) AS m FROM k JOIN k z ON z.id = k.id - k.id % 20)
SELECT id, other, ROUND(SUM(g), 6) AS score FROM p JOIN d USING (m, p, o) GROUP BY id, other""",
    ).replace("\n, d AS", ",\nd AS")
)
def sdc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric distances between the codes of every vector and of the query its id belongs to."""
    v = vectors(spark, sf_dir)
    book = books_column(books(v))
    k = v.select("id", z.pq_encode("vec", book, PARTS).alias("code"))
    other = k.select(F.col("id").alias("other"), F.col("code").alias("its"))
    pairs = k.withColumn("other", F.col("id") - F.col("id") % 20).join(other, "other")
    return pairs.select("id", "other", F.round(z.sdc_score(z.sdc_table(book), F.col("code"), F.col("its")), 6).alias("score"))


@query(sql("e", "SELECT id, HEX(CAST(id AS VARCHAR)) AS hexed, LPAD(HEX(id), 16, '0') AS xid, id AS back FROM e"))
def hex_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return v.select("id", codecs.to_hex(F.col("id").cast("string")).alias("hexed"), F.hex(codecs.xid_bytes("id")).alias("xid"), codecs.xid_number(codecs.xid_bytes("id")).alias("back"))


@query(sql("e", "SELECT id, [ROUND(x, 9) FOR x IN v] AS back, 512 AS digits FROM e"))
def float_hex_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as hexadecimal of their single-precision bytes, and back."""
    coded = vectors(spark, sf_dir).select("id", codecs.floats_to_hex(F.col("vec").cast("array<float>")).alias("h"))
    return coded.select("id", F.transform(codecs.floats_from_hex("h").cast("array<double>"), lambda x: F.round(x, 9)).alias("back"), F.length("h").alias("digits"))


@query("SELECT item_id, BASE64(ENCODE(passage)) AS coded, passage AS back FROM eval_item")
def base64_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "eval_item").select("item_id", codecs.to_base64(F.encode("passage", "utf-8")).alias("coded"))
    return rows.select("item_id", "coded", F.decode(codecs.from_base64("coded"), "utf-8").alias("back"))


@query("SELECT DISTINCT request_id, collection_name, n, d, k, nprobe, metric_type FROM search_request")
def json_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search requests as JSON messages and back."""
    fields = ["collection_name", "n", "d", "k", "nprobe", "k_factor", "metric_type"]
    sent = table(spark, sf_dir, "search_request").select("request_id", codecs.to_message(*fields).alias("j"))
    return sent.select("request_id", codecs.from_message("j", "search").alias("m")).select("request_id", "m.collection_name", "m.n", "m.d", "m.k", "m.nprobe", "m.metric_type").distinct()


@query(sql("e", "SELECT id, MD5(CAST(id AS VARCHAR)) AS md5, SHA256(CAST(id AS VARCHAR)) AS sha256 FROM e"))
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("id").cast("string")
    return vectors(spark, sf_dir).select("id", F.md5(key).alias("md5"), F.sha2(key, 256).alias("sha256"))


@query()
def random_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One random unit vector for every stored one, the same on every run: numbers follow from hashes of id and dimension."""
    bits = lambda j: (F.pmod(F.xxhash64(F.lit(11), F.col("id"), j), F.lit(1 << 53)) + F.lit(0.5)) / float(1 << 53)
    raw = F.transform(F.sequence(F.lit(0), F.lit(D - 1)), lambda j: F.sqrt(-2 * F.log(bits(j))) * F.cos(2 * 3.141592653589793 * bits(j + D)))
    return vectors(spark, sf_dir).select("id", raw.alias("raw")).select("id", F.transform(m.renormalised("raw"), lambda x: F.round(x, 6)).alias("vec"))


@query(
    sql(
        "e c",
        """, s AS (SELECT id, list_no, LIST_INNER_PRODUCT(v, c) AS x, -POW(LIST_DISTANCE(v, c), 2) AS y FROM e, c),
t AS (SELECT *, LN(SUM(EXP(x)) OVER (PARTITION BY id)) AS zx, LN(SUM(EXP(y)) OVER (PARTITION BY id)) AS zy FROM s)
SELECT id, ROUND(MAX(EXP(x - zx)), 6) AS top, ROUND(MIN(x - zx), 6) AS least_log, ROUND(SUM(EXP(x - zx) * (x - zx - y + zy)), 6) AS kl, ROUND(AVG(POW(x - y, 2)), 6) AS mse FROM t GROUP BY id""",
    ).replace("\n, s AS", ",\ns AS")
)
def score_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses between two score lists of every vector over the centroids."""
    v = vectors(spark, sf_dir)
    lists = one_to_many_lists(v)
    return lists.select(
        "id", F.round(F.array_max(losses.softmax("x")), 6).alias("top"), F.round(F.array_min(losses.log_softmax("x")), 6).alias("least_log"),
        F.round(losses.kl("x", "y"), 6).alias("kl"), F.round(losses.mse("x", "y"), 6).alias("mse"),
    )


def one_to_many_lists(v: DataFrame) -> DataFrame:
    """``id, x, y``: inner products and negated squared distances with all centroids, in the order of lists."""
    q = v.select(F.col("id").alias("qid"), F.col("vec").alias("q"))
    x, y = (exact.knn(q, centroids(v), 1 << 30, s, id="list_no", vec="c") for s in ("ip", "l2"))
    both = x.select("qid", "id", F.col("score").alias("x")).join(y.select("qid", "id", (-F.col("score")).alias("y")), ["qid", "id"])
    lists = both.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("id", "x", "y"))).alias("l"))
    return lists.select(F.col("qid").alias("id"), F.col("l.x").alias("x"), F.col("l.y").alias("y"))
