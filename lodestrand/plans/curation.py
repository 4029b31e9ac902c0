"""Queries over documents, pages and labels: digests, duplicates, envelopes, paragraphs, manifests, overlaps, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, raw, text
from ..operators import corpus, evaluate
from ..session import ship

QUERIES: dict = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/documents.parquet")


@query("SELECT doc_id, 'sha256:' || sha256(text) AS digest FROM documents")
def content_digest(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", codes.tagged_digest(F.col("text")).alias("digest"))


@query("SELECT 'sha256:' || sha256(text) AS digest, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.duplicate_digests(docs(spark, sf).select(codes.tagged_digest(F.col("text")).alias("digest")))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_best(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.best_by_digest(docs(spark, sf)).select("doc_id", "source")


@query("SELECT CASE WHEN regexp_full_match(text, '[\\x00-\\x7F]*') THEN 'ascii' ELSE 'utf-8' END AS encoding, count(*) AS files, sum((position(chr(13) IN text) > 0)::INTEGER)::BIGINT AS changed FROM documents GROUP BY 1")
def encoding_report(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select(text.encoding_class(F.encode("text", "UTF-8")).alias("encoding"), (F.instr("text", "\r") > 0).alias("changed"))
    return corpus.encoding_report(d)


_PARA = "joined AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents), p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n\\s*\\n')) AS x FROM joined), q AS (SELECT doc_id, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS x FROM p)"


@query(f"WITH {_PARA} SELECT doc_id, count(*)::INTEGER AS paras, sum(length(x))::BIGINT AS chars FROM q WHERE length(x) BETWEEN 40 AND 4000 GROUP BY doc_id")
def paragraphs_blankline(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of documents whose line ends are doubled."""
    p = docs(spark, sf).select("doc_id", F.explode(text.paragraphs(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))).alias("x"))
    return p.groupBy("doc_id").agg(F.count("*").cast("int").alias("paras"), F.sum(F.length("x")).alias("chars"))


@query(None)
def split_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraph spans of whole documents, in bytes."""
    d = docs(spark, sf).select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return d.select("doc_id", F.explode(raw.split_spans(F.col("data"))).alias("s")).select("doc_id", "s.para", "s.off", "s.len")


_START, _END = "*** START OF THE PROJECT GUTENBERG EBOOK X ***", "*** END OF THE PROJECT GUTENBERG EBOOK X ***"


@query("SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN 'head' || chr(10) || text ELSE text END AS body FROM (SELECT doc_id, trim(text, chr(10)) AS text FROM documents) WHERE length(text) > 0")
def strip_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents put into envelopes (a third with an opening mark alone, a third with none) and taken out again."""
    d = docs(spark, sf).select("doc_id", F.regexp_replace("text", r"^\n+|\n+\z", "").alias("t")).filter(F.length("t") > 0)
    k = F.col("doc_id") % 3
    wrapped = F.when(k == 0, F.concat(F.lit(f"head\n{_START}\n\n"), "t", F.lit(f"\n\n{_END}\ntail"))).when(k == 1, F.concat(F.lit(f"﻿ {_START}\n"), "t")).otherwise(F.concat(F.lit("head\n"), "t"))
    return d.select("doc_id", text.strip_envelope(wrapped).alias("body"))


@query("SELECT d.doc_id, quality, toxic, octet_length(encode(text))::INTEGER AS bytes FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def manifest_left_join(spark: SparkSession, sf: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return docs(spark, sf).join(labels, "doc_id", "left").select("doc_id", "quality", "toxic", F.octet_length("text").alias("bytes"))


@query("SELECT count(*) FILTER (lang = 'en' AND l.doc_id IS NOT NULL) AS kept, count(*) FILTER (l.doc_id IS NULL) AS unlabelled, count(*) FILTER (l.doc_id IS NOT NULL AND lang <> 'en') AS other_language FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def join_reasons(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id").distinct().join(docs(spark, sf).select("doc_id", "lang"), "doc_id")
    r = corpus.joined_reasons(docs(spark, sf).select(F.col("doc_id").alias("book")), c.select(F.col("doc_id").alias("book"), F.col("lang").alias("language")))
    return r.withColumnRenamed("uncatalogued", "unlabelled")


_SUMMARY = "m AS (SELECT sha256(text) AS digest, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query(f"WITH {_SUMMARY} SELECT count(*) AS rows, count(quality) AS titled, (count(*) - count(DISTINCT digest))::BIGINT AS duplicates FROM m")
def manifest_summary(spark: SparkSession, sf: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    m = docs(spark, sf).join(labels, "doc_id", "left").select(codes.content_hash(F.col("text")).alias("digest"), F.col("quality").alias("title"), F.lit(None).cast("int").alias("death_year"))
    return corpus.manifest_summary(m).select("rows", "titled", "duplicates")


_TOK = "regexp_extract_all(lower(text), '[a-z]+')"


@query(f"WITH d AS (SELECT doc_id AS a, t AS token, count(*) AS n FROM (SELECT doc_id, unnest({_TOK}) AS t FROM documents) GROUP BY ALL), i AS (SELECT item_id AS b, t AS token, count(*) AS n FROM (SELECT item_id, unnest({_TOK}) AS t FROM benchmark) GROUP BY ALL), c AS (SELECT a, b, sum(least(d.n, i.n)) AS c FROM d JOIN i USING (token) GROUP BY a, b) SELECT a, b, round(c.c / (ta.n + tb.n - c.c), 6)::DOUBLE AS jaccard FROM c JOIN (SELECT a, sum(n) AS n FROM d GROUP BY a) ta USING (a) JOIN (SELECT b, sum(n) AS n FROM i GROUP BY b) tb USING (b)")
def jaccard_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Multiset overlap of words of documents with benchmark items."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))
    d, b = docs(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    j = evaluate.text_jaccard(d.select(F.col("doc_id").alias("a"), "text"), b.select(F.col("item_id").alias("b"), "text"), words)
    return j.withColumn("jaccard", F.round("jaccard", 6))


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id || ',0'), doc_id) AS turn FROM documents) SELECT doc_id, source, turn::INTEGER AS turn FROM r ORDER BY turn, sha256(source || ',0'), source LIMIT 100")
def round_robin_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A hundred documents, taken from the sources in turn."""
    return evaluate.round_robin(docs(spark, sf).select("doc_id", "source"), "source", 100, idx="doc_id").select("doc_id", "source", "turn")


@query("SELECT doc_id FROM documents WHERE lang = 'en'")
def language_filter(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).filter("lang = 'en'").select("doc_id")


@query("WITH p AS (SELECT DISTINCT source, lang FROM documents), s AS (SELECT lang FROM p GROUP BY lang HAVING count(*) > 1) SELECT doc_id FROM documents WHERE source IN (SELECT source FROM p WHERE lang IN (SELECT lang FROM s))")
def scoreable(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.scoreable(docs(spark, sf).withColumn("facet", F.array("lang")), "source", "facet").select("doc_id")


@query("SELECT lower(coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1), ''), '')) AS host, count(*) AS pages, max(length(html))::BIGINT AS longest FROM pages GROUP BY 1")
def pages_by_host(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.groupBy(F.lower(F.coalesce(F.regexp_extract("url", "^[A-Za-z]+://([^/?#:]+)", 1), F.lit(""))).alias("host")).agg(F.count("*").alias("pages"), F.max(F.length("html")).cast("long").alias("longest"))


@query("SELECT count(*) AS files, count(*) FILTER (length(text) >= 200) AS written, count(*) FILTER (length(text) >= 90 AND length(text) < 200) AS skipped, count(*) FILTER (length(text) < 90) AS failed, (SELECT string_agg(p || ' of ' || n, ';' ORDER BY p) FROM (SELECT doc_id::VARCHAR AS p, length(text) AS n FROM documents WHERE length(text) < 90 ORDER BY p LIMIT 20)) AS errors FROM documents")
def pipeline_report(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by what became of documents, and the first errors by path."""
    n, path = F.length("text"), F.col("doc_id").cast("string")
    status = F.when(n >= 200, "written").when(n >= 90, "skipped").otherwise("error")
    r = docs(spark, sf).select(path.alias("path"), status.alias("status"), F.when(n < 90, F.concat(path, F.lit(" of "), n.cast("string"))).alias("error"))
    return corpus.pipeline_report(r).withColumn("errors", F.array_join(F.transform("errors", lambda e: e["error"]), ";"))
