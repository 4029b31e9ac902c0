"""Queries over embeddings: codes, scans, nearest neighbours, reranking, clustering, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..operators import evaluate, graph, retrieve, scan, vectors
from ..session import ship

DIM = 64


def base(spark: SparkSession, sf: str) -> DataFrame:
    """idx, vec, label."""
    ship(spark)
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"), "label")


def coded(spark: SparkSession, sf: str, bits: int = codes.BITS) -> DataFrame:
    """base with code and its words lsh0, lsh1, ..."""
    df = base(spark, sf).withColumn("code", codes.simhash(F.col("vec"), DIM, bits))
    for w in range(bits // 64):
        df = df.withColumn(f"lsh{w}", F.get("code", w))
    return df.withColumn("hash", codes.content_hash(F.concat(F.lit("vec "), F.col("idx").cast("string"))))


def _sql_codes(bits: int = codes.BITS) -> str:
    rows = ", ".join(f"({b}, [{', '.join(repr(float(x)) for x in p)}]::DOUBLE[])" for b, p in enumerate(codes.planes(DIM, bits)))
    words = ", ".join(f"bit_or(CASE WHEN b // 64 = {w} AND list_dot_product(embedding::DOUBLE[], p) > 0 THEN 1::UBIGINT << (b % 64)::UBIGINT ELSE 0::UBIGINT END) AS u{w}" for w in range(bits // 64))
    return f"planes(b, p) AS (VALUES {rows}), codes AS (SELECT vec_id AS idx, any_value(label) AS label, {words} FROM embeddings, planes GROUP BY vec_id)"


CODES = _sql_codes()
DIST = "(bit_count(xor(a.u0, b.u0))::INTEGER + bit_count(xor(a.u1, b.u1))::INTEGER)"
COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
QUERIES: dict = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query(f"WITH {CODES} SELECT idx AS vec_id, lower(printf('%016x%016x', u0, u1)) AS code FROM codes")
def simhash_codes(spark: SparkSession, sf: str) -> DataFrame:
    return coded(spark, sf).select(F.col("idx").alias("vec_id"), codes.code_hex([F.col("lsh0"), F.col("lsh1")]).alias("code"))


@query(f"WITH {CODES}, q AS (SELECT * FROM codes WHERE idx = 0) SELECT b.idx AS vec_id, {DIST} AS distance FROM q a, codes b WHERE {DIST} <= 52 ORDER BY b.idx LIMIT 256")
def similar_to_record(spark: SparkSession, sf: str) -> DataFrame:
    return scan.neighbours(coded(spark, sf), 0, 52, 256).select(F.col("idx").alias("vec_id"), F.col("distance").cast("int"))


@query(f"WITH {CODES}, q AS (SELECT * FROM codes WHERE idx = 0), near AS (SELECT b.idx, {DIST} AS distance FROM q a, codes b WHERE {DIST} <= 56 ORDER BY b.idx LIMIT 256) SELECT idx AS vec_id, distance FROM near WHERE idx <> 0")
def neighbourhood_view(spark: SparkSession, sf: str) -> DataFrame:
    import hashlib

    return scan.neighbourhood(coded(spark, sf), hashlib.sha256(b"vec 0").hexdigest(), 56).select(F.col("idx").alias("vec_id"), F.col("distance").cast("int"))


@query(f"WITH {CODES}, q AS (SELECT * FROM codes WHERE idx = 7) SELECT b.idx AS vec_id, {DIST} AS distance FROM q a, codes b ORDER BY distance, b.idx LIMIT 25")
def nearest_records(spark: SparkSession, sf: str) -> DataFrame:
    df = coded(spark, sf)
    q = df.filter("idx = 7").select("lsh0", "lsh1").first()
    return scan.nearest(df, (q[0], q[1]), 25).select(F.col("idx").alias("vec_id"), F.col("distance").cast("int"))


@query(f"WITH {CODES}, q AS (SELECT * FROM codes WHERE idx = 3) SELECT b.idx AS vec_id FROM q a, codes b WHERE b.idx >= 100 AND b.idx < 400 AND {DIST} <= 60")
def ranged_scan(spark: SparkSession, sf: str) -> DataFrame:
    df = coded(spark, sf)
    q = df.filter("idx = 3").select("lsh0", "lsh1").first()
    return scan.similar(df, (q[0], q[1]), 60, 100, 400).select(F.col("idx").alias("vec_id"))


@query(f"WITH {CODES} SELECT a.idx AS a, b.idx AS b, {DIST} AS distance FROM codes a JOIN codes b ON a.idx < b.idx WHERE {DIST} <= 44")
def near_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.near_pairs(coded(spark, sf), 44).select("a", "b", F.col("distance").cast("int"))


@query(f"WITH {CODES} SELECT a.idx AS a, b.idx AS b, {DIST} AS distance FROM codes a JOIN codes b ON a.idx < b.idx WHERE {DIST} <= 31")
def near_pairs_banded(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.banded_pairs(coded(spark, sf), 31).select("a", "b", F.col("distance").cast("int"))


@query(f"WITH {CODES}, p AS (SELECT a.idx AS a, b.idx AS b, {DIST} AS distance FROM codes a JOIN codes b ON a.idx < b.idx WHERE {DIST} <= 50) SELECT a, b, distance FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS n FROM p) WHERE n <= 5")
def near_pairs_capped(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.nearest_pairs(coded(spark, sf), 50, 5)


_KNN_H = f"knn AS MATERIALIZED (SELECT * FROM (SELECT a.idx AS query, b.idx AS idx, {DIST} AS distance, row_number() OVER (PARTITION BY a.idx ORDER BY {DIST}, b.idx) AS rank FROM codes a JOIN codes b ON a.idx <> b.idx) WHERE rank <= 20)"
_KNN_C = f"knn AS MATERIALIZED (SELECT * FROM (SELECT a.vec_id AS query, b.vec_id AS idx, {COS} AS cosine, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 20)"


def _knn(spark: SparkSession, sf: str, metric: str, k: int = 20, bits: int = codes.BITS) -> DataFrame:
    df = coded(spark, sf, bits)
    return retrieve.knn(df, df, k, "vec" if metric == "cosine" else "code", metric)


@query(f"WITH {CODES}, {_KNN_H} SELECT query, idx, distance, rank::INTEGER AS rank FROM knn WHERE rank <= 5")
def knn_hamming(spark: SparkSession, sf: str) -> DataFrame:
    return _knn(spark, sf, "hamming", 5).select("query", "idx", F.col("score").cast("int").alias("distance"), "rank")


@query(f"WITH {_KNN_C} SELECT query, idx, round(cosine, 6) AS cosine, rank::INTEGER AS rank FROM knn WHERE rank <= 5")
def knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _knn(spark, sf, "cosine", 5).select("query", "idx", F.round("score", 6).alias("cosine"), "rank")


@query(f"WITH {_KNN_C} SELECT x.query AS a, x.idx AS b FROM knn x JOIN knn y ON x.query = y.idx AND x.idx = y.query WHERE x.query < x.idx AND x.rank <= 10 AND y.rank <= 10")
def mutual_knn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.mutual(_knn(spark, sf, "cosine", 10)).select("a", "b")


@query(f"WITH {CODES}, q AS (SELECT * FROM codes WHERE idx = 0), s AS (SELECT b.idx, row_number() OVER (ORDER BY b.idx) AS pos FROM q a, codes b WHERE {DIST} <= 56), v AS (SELECT s.idx, s.pos, CASE WHEN s.idx % 7 <> 3 THEN {COS.replace('a.', 'x.').replace('b.', 'y.')} END AS c FROM s, embeddings x, embeddings y WHERE x.vec_id = 0 AND y.vec_id = s.idx) SELECT idx AS vec_id, round(c, 6) AS cosine, row_number() OVER (ORDER BY c IS NULL, c DESC, pos)::INTEGER AS place FROM v")
def rerank_shortlist(spark: SparkSession, sf: str) -> DataFrame:
    """A record's neighbours by cosine; vectors of a seventh of the records are missing on purpose."""
    from pyspark.sql import Window

    df = coded(spark, sf)
    everything = Window.partitionBy(F.lit(0))  # a shortlist alone
    short = scan.neighbours(df, 0, 56).select("idx", F.row_number().over(everything.orderBy("idx")).alias("pos"))
    q = [float(x) for x in df.filter("idx = 0").select("vec").first()[0]]
    ranked = retrieve.rerank(short, df.filter("idx % 7 <> 3").select("idx", "vec"), q)
    place = F.row_number().over(everything.orderBy(F.col("cosine").isNull(), F.col("cosine").desc(), "pos"))
    return ranked.select(F.col("idx").alias("vec_id"), F.round("cosine", 6).alias("cosine"), place.alias("place"))


def _components_sql(edges: str) -> str:
    return f"e AS ({edges}), sym AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), reach(x, y) AS (SELECT x, x FROM sym UNION SELECT r.x, s.y FROM reach r JOIN sym s ON r.y = s.x), comp AS (SELECT x AS id, min(y) AS component FROM reach GROUP BY x)"


@query(f"WITH RECURSIVE {CODES}, {_components_sql(f'SELECT a.idx AS a, b.idx AS b FROM codes a JOIN codes b ON a.idx < b.idx WHERE {DIST} <= 36')} SELECT c.idx AS vec_id, coalesce(component, c.idx) AS component FROM codes c LEFT JOIN comp ON c.idx = comp.id")
def code_components(spark: SparkSession, sf: str) -> DataFrame:
    df = coded(spark, sf)
    return graph.labelled(df, retrieve.near_links(df, 36)).select(F.col("idx").alias("vec_id"), "component")


@query(f"WITH RECURSIVE {_KNN_C}, {_components_sql('SELECT x.query AS a, x.idx AS b FROM knn x JOIN knn y ON x.query = y.idx AND x.idx = y.query WHERE x.query < x.idx AND x.rank <= 2 AND y.rank <= 2')} SELECT c.vec_id, coalesce(component, c.vec_id) AS component FROM embeddings c LEFT JOIN comp ON c.vec_id = comp.id")
def knn_components(spark: SparkSession, sf: str) -> DataFrame:
    df = base(spark, sf)
    return graph.labelled(df, retrieve.mutual(_knn(spark, sf, "cosine", 2))).select(F.col("idx").alias("vec_id"), "component")


_SCORE_SQL = "cells AS (SELECT cluster, label, count(*) AS n FROM items GROUP BY ALL), k AS (SELECT sum(n * (n - 1) / 2.0) AS both_ FROM cells), c AS (SELECT sum(n * (n - 1) / 2.0) AS made, count(*) AS clusters, max(n) AS largest FROM (SELECT cluster, sum(n) AS n FROM cells GROUP BY cluster)), t AS (SELECT sum(n * (n - 1) / 2.0) AS true_ FROM (SELECT label, sum(n) AS n FROM cells GROUP BY label)), r AS (SELECT CASE WHEN true_ > 0 THEN both_ / true_ ELSE 0 END AS together, CASE WHEN made > 0 THEN both_ / made ELSE 0 END AS purity, clusters, largest FROM k, c, t) SELECT round(together, 6)::DOUBLE AS together, round(purity, 6)::DOUBLE AS purity, round(CASE WHEN together + purity > 0 THEN 2 * together * purity / (together + purity) ELSE 0 END, 6)::DOUBLE AS f1, clusters::BIGINT AS clusters, largest::BIGINT AS largest FROM r"


@query(f"WITH RECURSIVE {CODES}, {_components_sql(f'SELECT a.idx AS a, b.idx AS b FROM codes a JOIN codes b ON a.idx < b.idx WHERE {DIST} <= 38')}, items AS (SELECT label, coalesce(component, c.idx) AS cluster FROM codes c LEFT JOIN comp ON c.idx = comp.id), {_SCORE_SQL}")
def cluster_purity(spark: SparkSession, sf: str) -> DataFrame:
    df = coded(spark, sf)
    s = graph.cluster_score(graph.labelled(df, retrieve.near_links(df, 38)).withColumnRenamed("component", "cluster"))
    return s.select(*[F.round(c, 6).alias(c) for c in ("together", "purity", "f1")], "clusters", "largest")


@query(f"WITH {CODES} SELECT a.idx AS a, b.idx AS b FROM codes a JOIN codes b ON a.idx < b.idx AND a.label = b.label WHERE {DIST} <= 50")
def constrained_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Near pairs kept only within one asserted group: here, a label."""
    return retrieve.near_pairs(coded(spark, sf), 50, within="label").select("a", "b")


@query("SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id ")
def same_label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return graph.same_label_pairs(base(spark, sf))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COS} >= 0.4")
def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.cosine_pairs(base(spark, sf), 0.4).select("a", "b", F.round("cosine", 6).alias("cosine"))


def _recall_sql(cols: str = "'all' AS what", group: str = "") -> str:
    per = ", ".join(f"max(CASE WHEN rank <= {k} AND ql = il THEN 1 ELSE 0 END) AS h{k}" for k in evaluate.KS)
    avg = ", ".join(f"round(avg(h{k}), 6) AS recall_{k}" for k in evaluate.KS)
    return f"hit AS (SELECT knn.*, q.label AS ql, i.label AS il FROM knn JOIN embeddings q ON knn.query = q.vec_id JOIN embeddings i ON knn.idx = i.vec_id), per AS (SELECT query, any_value(ql) AS label, {per} FROM hit GROUP BY query) SELECT count(*) AS queries, {avg} FROM per"


def _rounded(r: DataFrame) -> DataFrame:
    return r.select(*[F.round(c, 6).alias(c) if c.startswith("recall") else F.col(c) for c in r.columns])


@query(f"WITH {_KNN_C}, {_recall_sql()}")
def recall_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate.recall_at(evaluate.hits(_knn(spark, sf, "cosine"), base(spark, sf))))


@query(f"WITH {CODES}, {_KNN_H}, {_recall_sql()}")
def recall_hamming(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate.recall_at(evaluate.hits(_knn(spark, sf, "hamming"), base(spark, sf))))


@query(f"WITH {_KNN_C}, {_recall_sql().replace('SELECT count(*)', 'SELECT label, count(*)')} GROUP BY label")
def recall_by_label(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    return _rounded(evaluate.recall_at(evaluate.hits(_knn(spark, sf, "cosine"), b).withColumn("label", F.col("ql")), by=["label"]))


@query("SELECT round(sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)), 9)::DOUBLE AS chance FROM (SELECT label, count(*)::DOUBLE AS n FROM embeddings GROUP BY label)")
def recall_chance(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.chance(base(spark, sf)).select(F.round("chance", 9).alias("chance"))


@query(f"WITH {_KNN_C}, hit AS (SELECT knn.*, q.label AS ql, i.label AS il FROM knn JOIN embeddings q ON knn.query = q.vec_id JOIN embeddings i ON knn.idx = i.vec_id), f AS (SELECT query, min(CASE WHEN ql = il THEN rank END) AS first FROM hit GROUP BY query) SELECT quantile_cont(first, 0.5)::DOUBLE AS median, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS first_1, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS first_10 FROM f")
def first_hit_ranks(spark: SparkSession, sf: str) -> DataFrame:
    d = evaluate.displacement(evaluate.first_hits(evaluate.hits(_knn(spark, sf, "cosine"), base(spark, sf))))
    return d.select("median", F.round("first_1", 6).alias("first_1"), F.round("first_10", 6).alias("first_10"))


def _width_sql(bits: int) -> str:
    d = "(" + " + ".join(f"bit_count(xor(a.u{w}, b.u{w}))::INTEGER" for w in range(bits // 64)) + ")::INTEGER"
    c = _sql_codes(bits).replace("planes", f"planes{bits}").replace("codes AS", f"codes{bits} AS")
    k = f"knn{bits} AS (SELECT * FROM (SELECT a.idx AS query, a.label AS ql, b.label AS il, row_number() OVER (PARTITION BY a.idx ORDER BY {d}, b.idx) AS rank FROM codes{bits} a JOIN codes{bits} b ON a.idx <> b.idx) WHERE rank <= 5)"
    return f"{c}, {k}, per{bits} AS (SELECT query, max(CASE WHEN rank <= 1 AND ql = il THEN 1 ELSE 0 END) AS h1, max(CASE WHEN ql = il THEN 1 ELSE 0 END) AS h5 FROM knn{bits} GROUP BY query)"


_WIDTHS = (128, 256, 512)


@query("WITH " + ", ".join(map(_width_sql, _WIDTHS)) + " " + " UNION ALL ".join(f"SELECT {b}::INTEGER AS bits, round(avg(h1), 6) AS recall_1, round(avg(h5), 6) AS recall_5 FROM per{b}" for b in _WIDTHS))
def width_sweep(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for bits in _WIDTHS:
        r = _rounded(evaluate.recall_at(evaluate.hits(_knn(spark, sf, "hamming", 5, bits), base(spark, sf)), (1, 5))).select(F.lit(bits).alias("bits"), "recall_1", "recall_5")
        out = r if out is None else out.unionByName(r)
    return out


_MEAN = "m AS (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label, i), p AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY label), c AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM p)"


@query(f"WITH {_MEAN} SELECT label, i::INTEGER AS place, round(v[i + 1], 6) AS value FROM c, range(64) t(i)")
def centroid_per_label(spark: SparkSession, sf: str) -> DataFrame:
    pooled = vectors.mean_pool(base(spark, sf).select("label", "vec"), ["label"])
    return pooled.select("label", F.posexplode("vec").alias("place", "x")).select("label", "place", F.round("x", 6).alias("value"))


@query(f"WITH {_MEAN}, s AS (SELECT vec_id, c.label, list_dot_product(embedding::DOUBLE[], v) AS d FROM embeddings, c) SELECT vec_id, arg_max(label, d) AS nearest FROM s GROUP BY vec_id")
def centroid_assign(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest label centroid of each vector; centroids are a row for each label."""
    b = base(spark, sf)
    c = vectors.mean_pool(b.select("label", "vec"), ["label"]).select(F.col("label").cast("long").alias("idx"), "vec")
    return retrieve.knn(b, c, 1, "vec", exclude_self=False).select(F.col("query").alias("vec_id"), F.col("idx").cast("int").alias("nearest"))


@query(f"WITH {CODES}, q AS (SELECT vec_id % 50 AS doc, embedding FROM embeddings), e0 AS (SELECT embedding FROM embeddings WHERE vec_id = 0), m AS (SELECT doc, i, avg(x::DOUBLE) AS x FROM (SELECT doc, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM q) GROUP BY doc, i), p AS (SELECT doc, list(x ORDER BY i) AS v FROM m GROUP BY doc) SELECT p.doc AS doc_id, round(list_cosine_similarity(v, e0.embedding::DOUBLE[]), 6) AS average, round(b.best, 6) AS max_paragraph FROM p, e0, (SELECT doc, max(list_cosine_similarity(q.embedding::DOUBLE[], e0.embedding::DOUBLE[])) AS best FROM q, e0 GROUP BY doc) b WHERE b.doc = p.doc")
def document_scores(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    q = F.array(*[F.lit(float(x)) for x in b.filter("idx = 0").select("vec").first()[0]])
    d = vectors.document_scores(b.select((F.col("idx") % 50).alias("doc_id"), "vec"), q)
    return d.select("doc_id", F.round("average", 6).alias("average"), F.round("max_paragraph", 6).alias("max_paragraph"))


@query(f"WITH {CODES} SELECT (a.label = b.label) AS same, round(avg({DIST}), 6) AS mean, min({DIST}) AS least, max({DIST}) AS greatest FROM codes a JOIN codes b ON b.idx = xor(a.idx, 1) AND a.idx < b.idx GROUP BY 1")
def pair_separation(spark: SparkSession, sf: str) -> DataFrame:
    """Distances of records 2i and 2i + 1, by whether they have one label."""
    df = coded(spark, sf)
    other = df.select(F.col("idx").bitwiseXOR(F.lit(1).cast("long")).alias("idx"), F.col("label").alias("l2"), F.col("lsh0").alias("m0"), F.col("lsh1").alias("m1"))
    p = df.join(other, "idx").filter("idx % 2 = 0").select((F.col("label") == F.col("l2")).alias("same"), codes.hamming([F.col("lsh0"), F.col("lsh1")], [F.col("m0"), F.col("m1")]).cast("int").alias("distance"))
    return evaluate.separation(p, kind="same").withColumn("mean", F.round("mean", 6))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'miss' ELSE 'hit' END AS cache FROM embeddings")
def vector_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Which vectors a cache of two thirds of them has."""
    df = coded(spark, sf).select("idx", "hash", F.col("vec").alias("v"))
    cache = df.filter("idx % 3 <> 0").select("hash", F.lit("m").alias("model"), F.col("v").alias("vec"))
    found, _ = vectors.cached(df.select("idx", "hash"), cache, "m", DIM)
    return found.select(F.col("idx").alias("vec_id"), F.when(F.col("vec").isNull(), "miss").otherwise("hit").alias("cache"))
