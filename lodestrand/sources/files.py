"""Sources and sinks of files: folders, corpus and catalogue tables, workbooks, clean trees."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import raw
from ..functions import text as X

SUFFIXES = tuple("c go h html java json markdown md ml org py rs rst sh tex txt xml yaml yml".split())
MOST_BYTES, MOST_DEPTH = 32 << 20, 32


def folder(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES, most_bytes: int = MOST_BYTES, depth: int = MOST_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(files, counts) of a folder: path, mtime, length, content; and how many were indexed, empty, too large.

    Names that begin with a dot and folders deeper than `depth` are passed over. Length and path are tested before
    any content is read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.expr(f"substring(regexp_replace(path, '^file:/*', '/'), {len(root.rstrip('/')) + 2})")
    ok = X.is_text_file(F.col("path"), suffixes) & ~below.rlike(r"(^|/)\.") & (F.size(F.split(below, "/")) <= depth + 1)
    files = found.filter(ok)
    counts = files.select("length").agg(F.count_if(F.col("length").between(1, most_bytes)).alias("indexed"), F.count_if(F.col("length") == 0).alias("empty"), F.count_if(F.col("length") > most_bytes).alias("skipped"))
    return files.filter(F.col("length").between(1, most_bytes)).withColumnRenamed("modificationTime", "mtime"), counts


def paragraphs_of(files: DataFrame, content: str = "content") -> DataFrame:
    """A row for each paragraph: the other columns with para, off, len, bytes, text."""
    from ..session import ship

    ship(files.sparkSession)
    rest = [c for c in files.columns if c != content]
    rows = files.select(*rest, F.explode(raw.split_spans(F.col(content))).alias("s"))
    return rows.select(*rest, "s.para", "s.off", "s.len", "s.bytes", raw.clean_text(F.col("s.bytes")).alias("text"))


def corpus_csv(spark: SparkSession, path: str, least: int = raw.MIN) -> tuple[DataFrame, DataFrame]:
    """(rows, counts) of a corpus table with quoted line ends: columns by name, texts under `least` bytes counted and left out."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    counts = df.agg(F.count_if(size >= least).alias("kept"), F.count_if(size == 0).alias("empty"), F.count_if((size > 0) & (size < least)).alias("short"))
    return df.filter(size >= least).withColumn("timestamp", F.lit(1_700_000_000).cast("long") + F.col("text_id").cast("long")), counts


def catalogue_csv(spark: SparkSession, path: str) -> DataFrame:
    from ..operators.corpus import catalogue_fields

    return catalogue_fields(spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"'))


def write_paragraph_csv(books: DataFrame, catalogue: DataFrame, out: str, language: str = "en") -> None:
    """One row a paragraph of the books in a language, with catalogue fields."""
    j = books.join(catalogue.filter(F.col("language") == language), "book")
    paras = j.select(F.col("book").alias("text_id"), F.posexplode(X.paragraphs(X.strip_envelope(F.col("text")))).alias("p", "text"), "locc", "subjects", "death_year", "authors", "title")
    paras.select("text_id", (F.col("p") + 1).alias("para"), "locc", "subjects", "death_year", F.col("authors").alias("author"), "title", "text").write.csv(out, header=True, quote='"', escape='"', mode="overwrite")


def clean_tree(files: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """path, mtime, encoding, changed, text of files(path, mtime, content) that aren't done."""
    from ..operators.corpus import todo
    from ..session import ship

    ship(files.sparkSession)
    rest = files if done is None else todo(files, done)
    out = rest.withColumn("encoding", X.encoding_class(F.col("content"))).withColumn("text", raw.clean_text(F.col("content")))
    return out.withColumn("changed", F.encode("text", "UTF-8") != F.col("content")).drop("content")


def mirror_tree(cleaned: DataFrame, root: str, out: str) -> DataFrame:
    """Write clean_tree's texts under `out` at the places they have under `root`; (path, out, bytes) of what was written.

    Tasks write a file each under a temporary name and rename it, with the source's time, so that a run which
    stops halfway goes on where it was: todo finds those not done.
    """
    from ..session import ship

    ship(cleaned.sparkSession)
    names = [c for c in ("path", "mtime", "text") if c in cleaned.columns]
    base = re.sub("^file:/*", "/", root).rstrip("/")

    def write(batches):  # noqa: ANN001, ANN202
        import os
        import uuid

        import pyarrow as pa

        for b in batches:
            done = []
            for row in b.select(names).to_pylist():
                at = f"{out}/{os.path.relpath(re.sub('^file:/*', '/', row['path']), base)}"
                os.makedirs(os.path.dirname(at), exist_ok=True)
                temp, data = f"{at}.{uuid.uuid4().hex}.tmp", (row["text"] or "").encode("utf-8", "surrogatepass")
                with open(temp, "wb") as f:
                    f.write(data)
                if row.get("mtime") is not None:
                    os.utime(temp, (row["mtime"].timestamp(),) * 2)
                os.replace(temp, at)
                done.append((row["path"], at, len(data)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.string(), pa.int64()))] if done else [pa.array([], t) for t in (pa.string(), pa.string(), pa.int64())], names=["path", "out", "bytes"])

    return cleaned.select(*names).mapInArrow(write, "path string, out string, bytes long")


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELLS = T.ArrayType(T.StructType([T.StructField("sheet", T.StringType()), T.StructField("row", T.LongType()), T.StructField("col", T.LongType()), T.StructField("value", T.StringType()), T.StructField("formula", T.StringType())]))


def cells(data: bytes, most: int = 200_000) -> list[tuple[str, int, int, str | None, str | None]]:
    """(sheet, row, column, value, formula) of the text cells of a workbook, `most` at most; none where it isn't one."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        strings = [("".join(t.text or "" for t in si.iter(f"{_NS}t"))) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out: list = []
        for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
            target = rels[s.get(_REL)].lstrip("/")
            for c in ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_NS}c"):
                letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                col = 0
                for ch in letters:
                    col = 26 * col + ord(ch) - 64
                f, v = c.find(f"{_NS}f"), c.find(f"{_NS}v")
                inline = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                value = strings[int(v.text)] if c.get("t") == "s" and v is not None else inline or (v.text if v is not None else None)
                out.append((s.get("name"), int(row), col, value, f"={f.text}" if f is not None and f.text else None))
                if len(out) >= most:
                    return out
        return out
    except (zipfile.BadZipFile, KeyError, ET.ParseError, AttributeError, IndexError, ValueError):
        return []


@F.pandas_udf(CELLS)
def workbook_cells(data: pd.Series) -> pd.Series:
    return pd.Series([[] if x is None else [dict(zip(("sheet", "row", "col", "value", "formula"), c)) for c in cells(bytes(x))] for x in data], dtype=object)


def workbooks(files: DataFrame) -> DataFrame:
    """path, sheet, row, col, value, formula of files(path, content)."""
    from ..session import ship

    ship(files.sparkSession)
    return files.select("path", F.explode(workbook_cells(F.col("content"))).alias("c")).select("path", "c.*")


def label_groups(cells_: DataFrame, rows_least: int = 3, cols_least: int = 4, rows_most: int = 400, cols_most: int = 60, chars: int = 500) -> DataFrame:
    """(path, sheet, kind, position, text): sheet names that are labels, and the labels of rows with 3 or more and of
    columns with 4 or more, within a sheet's first rows and columns. Positions count from 0."""
    labels = cells_.filter(F.col("formula").isNull() & X.is_label(F.col("value")) & (F.col("row") <= rows_most) & (F.col("col") <= cols_most)).select("path", "sheet", "row", "col", F.trim("value").alias("v"))
    title = cells_.select("path", "sheet").distinct().filter(X.is_label(F.col("sheet"))).select("path", "sheet", F.lit("sheet").alias("kind"), F.lit(0).cast("long").alias("position"), F.trim("sheet").alias("text"))

    def lines(kind: str, position: str, other: str, least: int) -> DataFrame:
        g = labels.groupBy("path", "sheet", position).agg(F.array_sort(F.collect_list(F.struct(other, "v"))).alias("x")).filter(F.size("x") >= least)
        return g.select("path", "sheet", F.lit(kind).alias("kind"), (F.col(position) - 1).alias("position"), F.substring(F.array_join(F.transform("x", lambda s: s["v"]), " | "), 1, chars).alias("text"))

    return title.unionByName(lines("row", "row", "col", rows_least)).unionByName(lines("col", "col", "row", cols_least))


def pair_lines(lines: DataFrame, low: int = 20, high: int = 400) -> DataFrame:
    """Of pairs(a, b): those of different texts with lengths in bounds, as (2i, a), (2i+1, b) by order of their pair id."""
    ok = F.length("a").between(low, high) & F.length("b").between(low, high) & (F.col("a") != F.col("b"))
    kept = lines.filter(ok)
    return kept.select(F.posexplode(F.array("a", "b")).alias("side", "text"), "pair_id").select((F.col("pair_id") * 2 + F.col("side")).alias("idx"), "text")


def cited_often(contexts: DataFrame, least: int = 3, most: int = 6) -> DataFrame:
    """Contexts(work, text) of works cited `least` times or more, `most` of each."""
    from ..operators.evaluate import at_most

    works = contexts.groupBy("work").count().filter(F.col("count") >= least).select("work")
    return at_most(contexts.join(works, "work", "left_semi"), "work", [F.col("text")], most)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Judged edges, one JSON object a line: a, b, distance, subjects."""
    return spark.read.schema("a long, b long, distance int, subjects array<string>").json(path)


def write_themes(themes: DataFrame, path: str) -> None:
    themes.write.mode("overwrite").json(path)
