"""Queries over events, orders and literals: time and category scans, groups, caps, trits, formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, text
from ..operators import corpus, evaluate, graph, scan

QUERIES: dict = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("idx", F.col("event_id"))


@query("WITH b AS (SELECT min(ts) AS lo, min(ts) + INTERVAL 2 DAY AS hi FROM events) SELECT event_id, event_type FROM events, b WHERE ts BETWEEN lo AND hi")
def time_range(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    lo, hi = e.agg(F.min("ts"), F.expr("min(ts) + interval 2 days")).first()
    return scan.time_range(e, F.lit(lo), F.lit(hi), "ts").select("event_id", "event_type")


@query("SELECT event_id, user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def category_scan(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    return scan.category(e, e.agg(F.min("event_type")).first()[0], "event_type").select("event_id", "user_id")


@query("SELECT event_type AS subject, list_sort(list(DISTINCT user_id)) AS members, count(*) AS edges FROM events WHERE value IS NOT NULL GROUP BY event_type")
def subject_members(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).filter("value is not null")
    g = e.groupBy(F.col("event_type").alias("subject")).agg(F.array_sort(F.collect_set("user_id")).alias("members"), F.count("*").alias("edges"))
    return g


_EDGES = "e AS (SELECT user_id AS a, user_id + 1 + event_id % 5 AS b, list_sort(list(DISTINCT event_type)) AS subjects FROM events GROUP BY ALL HAVING count(*) >= 1)"


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    return e.groupBy(F.col("user_id").alias("a"), (F.col("user_id") + 1 + F.col("event_id") % 5).alias("b")).agg(F.array_sort(F.collect_set("event_type")).alias("subjects"))


@query(f"WITH {_EDGES}, x AS (SELECT a, b, unnest(subjects) AS subject FROM e), m AS (SELECT subject, unnest([a, b]) AS m FROM x) SELECT subject, list_sort(list(DISTINCT m)) AS members, any_value(edges) AS edges FROM m JOIN (SELECT subject, count(*) AS edges FROM x GROUP BY subject) USING (subject) GROUP BY subject")
def subject_groups(spark: SparkSession, sf: str) -> DataFrame:
    return graph.subject_groups(_edges(spark, sf)).select("subject", "members", "edges")


@query(f"WITH {_EDGES}, x AS (SELECT a, b, unnest(subjects) AS subject FROM e), m AS (SELECT subject, unnest([a, b]) AS m FROM x), g AS (SELECT subject, list(DISTINCT m) AS members FROM m GROUP BY subject), n AS (SELECT 'first' AS name, subject FROM (SELECT subject FROM g ORDER BY subject LIMIT 2)), t AS (SELECT name, flatten(list(members)) AS members FROM n JOIN g USING (subject) GROUP BY name UNION ALL SELECT subject, members FROM g WHERE len(members) >= 2 AND subject NOT IN (SELECT subject FROM n)) SELECT name, len(list_distinct(members))::INTEGER AS size FROM t")
def theme_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Two subjects made one theme, the rest standing for themselves."""
    g = graph.subject_groups(_edges(spark, sf))
    named = g.orderBy("subject").limit(2).agg(F.collect_list("subject").alias("subjects")).select(F.lit("first").alias("name"), "subjects")
    return graph.themes(g, named).select("name", "size")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 6")
def capped_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.at_most(_events(spark, sf), "user_id", [F.col("event_id")], 6).select("event_id", "user_id")


@query("SELECT event_id, CASE WHEN r <= n // 2 THEN 'query' ELSE 'index' END AS half FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)")
def halves(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.halves(_events(spark, sf), "user_id", "event_id").select("event_id", "half")


@query("WITH v AS (SELECT event_type AS verdict, count(*) AS n FROM events GROUP BY event_type) SELECT arg_max(verdict, (n, verdict)) AS verdict, round(max(n) / sum(n), 6)::DOUBLE AS share, (max(n) / sum(n) > 0.9) AS degenerate FROM v")
def one_sided_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.one_sided(_events(spark, sf).select(F.col("event_type").alias("verdict"))).withColumn("share", F.round("share", 6))


@query("WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM embeddings JOIN documents ON vec_id = doc_id), c AS (SELECT vec_id, w, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT vec_id, sum(n) AS n FROM c GROUP BY vec_id), m AS (SELECT a.vec_id AS a, sum(least(a.n, b.n)) AS k FROM c a JOIN c b ON a.w = b.w AND b.vec_id = a.vec_id + 1 GROUP BY a.vec_id) SELECT round(corr(m.k / (x.n + y.n - m.k), list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS pearson, count(*) AS pairs FROM m JOIN s x ON x.vec_id = m.a JOIN s y ON y.vec_id = m.a + 1 JOIN embeddings p ON p.vec_id = m.a JOIN embeddings q ON q.vec_id = m.a + 1")
def pearson(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation of the overlap of words and the cosine, over neighbouring documents."""
    d = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")), "doc_id")
    c = d.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    return evaluate.overlap_correlation(c, d.select("doc_id", "vec"))


@query("SELECT n::INTEGER AS packed, (n // 243 % 3 - 1)::INTEGER AS t0, (n // 81 % 3 - 1)::INTEGER AS t1, (n // 27 % 3 - 1)::INTEGER AS t2, (n // 9 % 3 - 1)::INTEGER AS t3, (n // 3 % 3 - 1)::INTEGER AS t4, (n % 3 - 1)::INTEGER AS t5 FROM range(729) t(n)")
def trit_codec(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.range(800).select(F.col("id").cast("int").alias("n"))
    d = df.filter(codes.trits_valid(F.col("n"))).select(*[c.alias(f"t{i}") for i, c in enumerate(codes.trits_unpack(F.col("n")))])
    return d.withColumn("packed", codes.trits_pack(*[F.col(f"t{i}") for i in range(6)]))


@query("SELECT * FROM (VALUES ('Dante Alighieri, 1265-1321', 1321), ('Bierce, Ambrose, 1842-1914?', 1914), ('A, 1814?-1884; B, 1900-1950', 1884), ('Living, 1960-', NULL), ('Anonymous', NULL)) t(authors, death_year)")
def death_years(spark: SparkSession, sf: str) -> DataFrame:
    rows = [("Dante Alighieri, 1265-1321",), ("Bierce, Ambrose, 1842-1914?",), ("A, 1814?-1884; B, 1900-1950",), ("Living, 1960-",), ("Anonymous",)]
    return spark.createDataFrame(rows, "authors string").select("authors", text.death_year(F.col("authors")).alias("death_year"))


_BOOKS = ["/1/6/0/1602.txt", "/1/2/8/2/12823/12823-0.txt", "/1/2/8/2/12823/12823-8.txt", "/1/2/8/2/12823/old/12823-0.txt", "/1007/old/old/3ddcc10.txt", "/none/readme.txt", "/5/5/55-5.txt", "/5/5/55.txt"]


@query("SELECT * FROM (VALUES ('1602', '/1/6/0/1602.txt'), ('12823', '/1/2/8/2/12823/12823-0.txt'), ('1007', '/1007/old/old/3ddcc10.txt'), (NULL, '/none/readme.txt'), ('55', '/5/5/55.txt')) t(book, path)")
def best_files(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.best_files(spark.createDataFrame([(p,) for p in _BOOKS], "path string")).select("book", "path")
