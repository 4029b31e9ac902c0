"""Corpus curation: the best file of each book, duplicate digests, manifests, reports, resumable jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.codes import tagged_digest


def best_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Of files(path), one for each book: fewest old folders, best encoding, least path. No content is read.

    Files of no book stay, each for itself.
    """
    p = F.col(path)
    ranked = files.withColumn("book", T.book_id(p)).withColumn("_k", F.coalesce(F.col("book"), F.concat(F.lit("/"), p)))
    return ranked.groupBy("_k").agg(F.min_by(F.struct(*files.columns, "book"), F.struct(T.revision(p), T.encoding_rank(p), p)).alias("x")).select("x.*")


def jobs(chosen: DataFrame, src: str, dst: str, path: str = "path") -> DataFrame:
    """(src, dst, book) for files under src."""
    return chosen.select(F.col(path).alias("src"), F.concat(F.lit(dst.rstrip("/") + "/"), F.expr(f"substring({path}, {len(src.rstrip('/')) + 2})")).alias("dst"), "book")


def todo(sources: DataFrame, done: DataFrame) -> DataFrame:
    """Sources(path, mtime) not yet done at that time or later, in done(path, mtime)."""
    d = done.groupBy("path").agg(F.max("mtime").alias("done_at"))
    return sources.join(d, "path", "left").filter(F.col("done_at").isNull() | (F.col("done_at") < F.col("mtime"))).drop("done_at")


def duplicate_digests(rows: DataFrame, digest: str = "digest") -> DataFrame:
    return rows.groupBy(digest).agg(F.count("*").alias("copies")).filter("copies > 1")


def manifest(books: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Books(book, text, path, encoding) with digest, sizes and catalogue fields; uncatalogued ones stay. By book number."""
    own = books.select("book", tagged_digest(F.col("text")).alias("digest"), "path", "encoding", F.octet_length("text").alias("bytes"), F.size(T.paragraphs(F.col("text"))).alias("paras"))
    return own.join(catalogue, "book", "left").orderBy(F.col("book").cast("long").asc_nulls_last(), "book")


def catalogue_fields(raw: DataFrame) -> DataFrame:
    """A catalogue's texts: book and title, with class and death year derived."""
    c = F.col
    return raw.filter(c("Type") == "Text").select(c("`Text#`").cast("string").alias("book"), c("Title").alias("title"), c("Authors").alias("authors"), c("Language").alias("language"), c("Subjects").alias("subjects"), T.primary_class(c("LoCC")).alias("locc"), c("Bookshelves").alias("bookshelves"), T.death_year(c("Authors")).alias("death_year"), c("Issued").alias("issued"))


def catalogue_fields_plain(raw: DataFrame) -> DataFrame:
    """The variant that keeps the first class whole and takes a death year from a full lifespan alone."""
    c = F.col
    year = F.regexp_extract(F.coalesce("Authors", F.lit("")), r"\b\d{4}\s*-\s*(\d{4})\b", 1)
    return raw.filter(c("Type") == "Text").select(c("`Text#`").cast("string").alias("book"), c("Title").alias("title"), F.coalesce("Authors", F.lit("")).alias("author"), c("Language").alias("language"), F.trim(F.element_at(F.split(F.coalesce("LoCC", F.lit("")), ";"), 1)).alias("locc"), F.coalesce("Subjects", F.lit("")).alias("subjects"), F.when(year != "", year.cast("int")).alias("death_year"))


def joined_reasons(files: DataFrame, catalogue: DataFrame, language: str = "en") -> DataFrame:
    """One row: files kept, without catalogue entry, in another language."""
    j = files.join(catalogue.select("book", "language", F.lit(True).alias("known")), "book", "left")
    known, right = F.col("known").isNotNull(), F.col("language") == language
    return j.agg(F.count_if(known & right).alias("kept"), F.count_if(~known).alias("uncatalogued"), F.count_if(known & ~F.coalesce(right, F.lit(False))).alias("other_language"))


def encoding_report(results: DataFrame) -> DataFrame:
    """By encoding: files and how many changed."""
    return results.groupBy("encoding").agg(F.count("*").alias("files"), F.sum(F.col("changed").cast("int")).alias("changed"))


def errors(results: DataFrame) -> DataFrame:
    """path and error of the files that failed, in order of path."""
    return results.filter(F.col("error").isNotNull()).select("path", "error").orderBy("path")


def best_text_files(files: DataFrame, path: str = "path") -> DataFrame:
    """The variant that takes files named by a number, with a known suffix, alone, and never those below a folder named old."""
    p = F.col(path)
    name = F.element_at(F.split(p, "/"), -1)
    book, rank = F.regexp_extract(name, T.TEXT_FILE, 1), T.text_rank(name)
    kept = files.withColumn("book", book).withColumn("_r", rank).filter((book != "") & rank.isNotNull() & (T.revision(p) == 0))
    return kept.groupBy("book").agg(F.min_by(F.struct(*files.columns), F.struct("_r", p)).alias("x")).select("book", "x.*")


def manifest_summary(m: DataFrame) -> DataFrame:
    twice = m.groupBy("digest").count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count") - 1)), F.lit(0)).alias("duplicates"))
    return m.agg(F.count("*").alias("rows"), F.count_if(F.col("title").isNotNull()).alias("titled"), F.count_if(F.col("death_year").isNotNull()).alias("dated")).join(twice)


def pipeline_report(results: DataFrame, most_errors: int = 20) -> DataFrame:
    """files, written, skipped, failed and the first errors by path. The counts add up to the files."""
    first = results.filter(F.col("status") == "error").orderBy("path").limit(most_errors).agg(F.array_sort(F.collect_list(F.struct("path", "error"))).alias("errors"))
    n = lambda s: F.count_if(F.col("status") == s)
    return results.agg(F.count("*").alias("files"), n("written").alias("written"), n("skipped").alias("skipped"), n("error").alias("failed")).join(F.broadcast(first))  # a row each


def best_by_digest(docs: DataFrame) -> DataFrame:
    """The document of least id for each text."""
    # combined before the shuffle: a text that a third of all rows have is one row a task
    rest = [c for c in docs.columns if c != "text"]
    first = docs.withColumn("digest", tagged_digest(F.col("text"))).groupBy("digest").agg(F.min(F.struct("doc_id", *[c for c in rest if c != "doc_id"])).alias("x"))
    return first.select("digest", "x.*")


def shared_formulas(cells: DataFrame) -> DataFrame:
    """(hash, workbooks) of formulas that more than one workbook has."""
    return cells.filter(F.col("hash").isNotNull()).groupBy("hash").agg(F.countDistinct("workbook").alias("workbooks")).filter("workbooks > 1")


def formula_coverage(cells: DataFrame) -> DataFrame:
    """Cells, parsed, distinct hashes, and failures by reason, of cells(hash, canonical)."""
    bad = F.col("hash").isNull()
    return cells.agg(F.count("*").alias("cells"), F.count_if(~bad).alias("parsed"), F.countDistinct("hash").alias("distinct"), *[F.count_if(bad & (F.col("canonical") == r)).alias(r.replace("-", "_")) for r in ("not-a-formula", "unparsed", "empty")])
