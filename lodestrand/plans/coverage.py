"""Queries on literals with their expected rows, and on whole tables: predicates, line formats, codecs, chunkers, formulas, edges."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, formula, raw, text
from ..operators import corpus, evaluate, graph, models, retrieve, scan, vectors
from ..session import ship
from ..sources import files
from .vectors import DIM, _recall_sql, _rounded, base

QUERIES: dict = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def values(columns: str, rows: list[tuple]) -> str:
    """SQL for rows of literals."""

    def one(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({columns})"


def frame(spark: SparkSession, schema: str, rows: list) -> DataFrame:
    ship(spark)
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


# predicates and fields

_PATHS = [("/a/b.TXT", True, True), ("/a/readme.txt", True, False), ("/a/LICENSE.txt", True, False), ("/a/x.md", True, True), ("/a/noext", False, True), ("/a/pnote.txt", True, False), ("/a/c.py", True, True), ("/a/d.pdf", False, True), ("/a/cd-dvd-readme.txt", True, False)]


@query(values("path, text_file, book_file", _PATHS))
def file_predicates(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    return frame(spark, "path string", [r[0] for r in _PATHS]).select("path", text.is_text_file(p, files.SUFFIXES).alias("text_file"), text.is_book_file(p).alias("book_file"))


_LABELS = [("Total sales", True), ("x", False), ("12,345", False), ("£3.50", False), ("=A1+B1", False), ("2020-01-05", False), ("3/4/21", False), ("a1", False), ("ab", True), ("Q1 revenue", True), ("a" * 201, False), ("  ok  ", True), ("50%", False), ("É è", False)]


@query(values("value, label", _LABELS))
def label_predicate(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, "value string", [r[0] for r in _LABELS]).select("value", text.is_label(F.col("value")).alias("label"))


@query(values("id, kept", [(1, "ships,weather,sea"), (2, ""), (3, "the sea")]))
def generic_subjects(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(1, [" 'Ships' ", "people", "*Weather*", "N/A", "sea."]), (2, ["", "things", "-"]), (3, ["The Sea"])]
    return frame(spark, "id int, subjects array<string>", rows).select("id", F.array_join(text.clean_subjects(F.col("subjects")), ",").alias("kept"))


_SHARED = [("SHARED: ships, the sea, people", "ships,the sea"), ("well\nshared: NONE", None), ("Shared: unrelated texts", None), ("no line", None), ("SHARED: people, things", None), ("x\n  SHARED: [war], 'peace'\nSHARED: more", "war,peace")]


@query(values("answer, subjects", _SHARED))
def shared_lines(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, "answer string", [r[0] for r in _SHARED]).select("answer", F.array_join(text.shared_subjects(F.col("answer")), ",").alias("subjects"))


@query(values("id, name, subjects", [(1, "sea travel", "ships,harbour"), (1, "war", "battle"), (2, "a", "b")]))
def theme_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(1, " Sea Travel | ships, Harbour\nTHEME: War | battle\nINCOHERENT: x\nTHEME: lost | y"), (2, "THEME: a | b"), (3, " x |"), (4, "INCOHERENT")]
    return frame(spark, "id int, answer string", rows).select("id", F.explode(text.theme_lines(F.col("answer"))).alias("t")).select("id", "t.name", F.array_join("t.subjects", ",").alias("subjects"))


_CATALOGUE = [("1", "Text", "2000", "T1", "en", "Dante, 1265-1321", "Poetry -- Italian -- Old; Hell", "PQ; B", "s"), ("2", "Sound", "2000", "T2", "en", "X", "", "M", ""), ("3", "Text", "2001", "T3", "fr", None, None, None, None), ("4", "Text", "2002", "T4", "en", "A, 1814?-1884; B, 1900-1950", "", "E201; JK", "")]
_RAW = "`Text#` string, Type string, Issued string, Title string, Language string, Authors string, Subjects string, LoCC string, Bookshelves string"


@query(values("book, title, language, locc, death_year, keys", [("1", "T1", "en", "PQ", 1321, "poetry -- italian;hell"), ("3", "T3", "fr", None, None, None), ("4", "T4", "en", "E", 1884, "")]))
def catalogue_texts(spark: SparkSession, sf: str) -> DataFrame:
    c = corpus.catalogue_fields(frame(spark, _RAW, _CATALOGUE))
    return c.select("book", "title", "language", "locc", "death_year", F.array_join(text.subject_keys(F.col("subjects")), ";").alias("keys"))


@query(values("book, author, locc, subjects, death_year", [("1", "Dante, 1265-1321", "PQ", "Poetry -- Italian -- Old; Hell", 1321), ("3", "", "", "", None), ("4", "A, 1814?-1884; B, 1900-1950", "E201", "", 1950)]))
def catalogue_plain(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.catalogue_fields_plain(frame(spark, _RAW, _CATALOGUE)).select("book", "author", "locc", "subjects", "death_year")


@query(values("book, path", [("1602", "/1/1602.txt"), ("12823", "/1/12823/12823-0.txt"), ("55", "/5/55-8.txt")]))
def best_text_files(spark: SparkSession, sf: str) -> DataFrame:
    paths = ["/1/1602.txt", "/1/1602-8.txt", "/1/12823/12823-0.txt", "/1/12823/12823-8.txt", "/1/12823/old/12823-0.txt", "/1/3ddcc10.txt", "/5/55-8.txt", "/5/55-5.txt", "/6/66-9.txt", "/5/old/55.txt"]
    return corpus.best_text_files(frame(spark, "path string", paths)).select("book", "path")


@query(values("name, owner", [("john_smith__budget.xlsx", "john_smith"), ("Budget.xlsx", None), ("a_b__x__y.xlsx", "a_b")]))
def workbook_owners(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, "name string", ["john_smith__budget.xlsx", "Budget.xlsx", "a_b__x__y.xlsx"]).select("name", text.owner(F.col("name")).alias("owner"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text END AS body FROM documents WHERE text NOT LIKE '%***%' AND text NOT LIKE '%' || chr(10) AND text NOT LIKE chr(10) || '%'")
def envelope_variant(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in whole envelopes, and with an opening mark alone, by the variant that wants both marks."""
    from .curation import _END, _START

    d = table(spark, sf, "documents").filter(~F.col("text").contains("***") & ~F.col("text").rlike(r"\A\n|\n\z"))
    wrapped = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(f"head\n{_START}\n"), "text", F.lit(f"\n{_END}\ntail"))).otherwise(F.concat(F.lit(f"{_START}\n"), "text"))
    return d.select("doc_id", text.strip_envelope_or_null(wrapped).alias("body"))


# codecs and hashes


@query("SELECT event_id, printf('%016x%016x', event_id::UBIGINT, 18446744073709551615::UBIGINT - event_id::UBIGINT) || sha256(event_id::VARCHAR) || printf('%08x%08x%04x%04x%08x', event_id % 1000, event_id * 7, user_id % 65536, event_id % 729, 0) AS record, event_id AS lsh0, -event_id - 1 AS lsh1, (event_id % 729)::BIGINT AS trits FROM events")
def record_codec(spark: SparkSession, sf: str) -> DataFrame:
    """Records to hex and back."""
    e, i = table(spark, sf, "events"), F.col("event_id")
    fields = {"lsh0": i, "lsh1": -i - 1, "hash": codes.content_hash(i.cast("string")), "para": i % 1000, "timestamp": i * 7, "category": F.col("user_id") % 65536, "trits": i % 729, "cluster": F.lit(0)}
    d = e.select("event_id", *[c.alias(k) for k, c in fields.items()])
    d = d.select("event_id", codes.record_hex({k: F.col(k) for k in fields}).alias("record"))
    back = codes.record_from_hex(F.upper("record"))
    return d.select("event_id", "record", back["lsh0"].alias("lsh0"), back["lsh1"].alias("lsh1"), back["trits"].alias("trits"))


_BYTES = "h AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::UBIGINT) AS b FROM documents)"


@query(
    f"WITH {_BYTES}, w AS (SELECT doc_id, unnest(CASE WHEN len(b) < 4 THEN b ELSE list_transform(range(1, len(b) - 2), lambda i: b[i] * 16777216 + b[i + 1] * 65536 + b[i + 2] * 256 + b[i + 3]) END) AS w, len(b) >= 4 AS long FROM h), "
    "x AS (SELECT doc_id, long, w, (xor(w, w >> 16) * 2146121005) % 4294967296 AS m FROM w), y AS (SELECT doc_id, (CASE WHEN long THEN xor(m, m >> 15) ELSE w END) % 128 AS bit FROM x), "
    "c AS (SELECT doc_id, bit_or(CASE WHEN bit < 64 THEN 1::UBIGINT << bit ELSE 0::UBIGINT END) AS lo, bit_or(CASE WHEN bit >= 64 THEN 1::UBIGINT << (bit - 64) ELSE 0::UBIGINT END) AS hi FROM (SELECT DISTINCT doc_id, bit FROM y) GROUP BY doc_id) "
    "SELECT d.doc_id, CASE WHEN text IS NOT NULL THEN printf('%016x%016x', coalesce(lo, 0::UBIGINT), coalesce(hi, 0::UBIGINT)) END AS code FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id"
)
def shingle_codes(spark: SparkSession, sf: str) -> DataFrame:
    """The byte-shingle code of whole documents."""
    d = table(spark, sf, "documents").select("doc_id", codes.shingle_lsh(F.encode("text", "UTF-8")).alias("c"))
    return d.select("doc_id", codes.code_hex([F.get("c", 0), F.get("c", 1)]).alias("code"))


@query("SELECT p_partkey, (CASE WHEN h >= 9223372036854775808 THEN h::HUGEINT - 18446744073709551616 ELSE h::HUGEINT END)::BIGINT AS h FROM (SELECT p_partkey, list_reduce(list_prepend(1469598103934665603::UBIGINT, list_transform(regexp_extract_all(hex(encode('/part/' || p_name || '/' || p_partkey)), '..'), lambda x: ('0x' || x)::UBIGINT)), lambda a, b: ((xor(a, b)::HUGEINT * 1099511628211) % 18446744073709551616)::UBIGINT) AS h FROM part)")
def path_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", codes.fnv1a(F.concat(F.lit("/part/"), "p_name", F.lit("/"), F.col("p_partkey").cast("string"))).alias("h"))


_FNV = "2166136261::UBIGINT"
for _i in range(1, 5):
    _FNV = f"(xor({_FNV}, ord(substr(p_name, {_i}, 1))::UBIGINT) * 16777619) % 4294967296"


@query(f"SELECT p_partkey, (({_FNV}) % 64)::INTEGER AS place, 1.0::DOUBLE AS value FROM part")
def stub_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """The test embedder through the embedder's interface: texts of four bytes have one place each."""
    v = table(spark, sf, "part").select("p_partkey", models.embedded(F.substring("p_name", 1, 4), models.HashEmbedder(64)).alias("v"))
    return v.select("p_partkey", F.posexplode("v").alias("place", "x")).filter("x > 0").select("p_partkey", "place", F.col("x").cast("double").alias("value"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'cp1252' WHEN 2 THEN 'latin-1' ELSE 'ascii' END AS encoding, p_name || CASE p_partkey % 4 WHEN 0 THEN ' é’' WHEN 1 THEN '’é' WHEN 2 THEN 'é' ELSE '' END AS text, p_partkey % 4 IN (0, 3) AS valid FROM part")
def encoding_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts in four encodings, classified and repaired."""
    p, k = table(spark, sf, "part").select("p_partkey", "p_name"), F.col("p_partkey") % 4
    plain = F.encode("p_name", "UTF-8")
    data = F.when(k == 0, F.encode(F.concat("p_name", F.lit(" é’")), "UTF-8")).when(k == 1, F.concat(plain, F.unhex(F.lit("92E9")))).when(k == 2, F.concat(plain, F.unhex(F.lit("E9")))).otherwise(plain)
    d = p.withColumn("data", data)
    return d.select("p_partkey", text.encoding_class(F.col("data")).alias("encoding"), raw.clean_text("data").alias("text"), text.valid_utf8(F.col("data")).alias("valid"))


_REPAIRS = [("EFBBBF61620D0A63", "ab\nc"), ("610D62", "a\nb"), ("610062", "ab"), ("E28099", "’"), ("C0AF", "À¯"), ("EDA080", "í €"), ("E282", "â‚"), ("81", "\x81"), ("F09F9880", "😀"), ("", "")]


@query(values("data, text", _REPAIRS))
def repair_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Overlong forms, surrogates, cut sequences, unassigned bytes, marks and line ends."""
    return frame(spark, "data string", [r[0] for r in _REPAIRS]).select("data", raw.clean_text(F.unhex("data")).alias("text"))


_SPLITS = [("a * 40", 1, "1:0:40"), ("a * 39", 0, ""), ("a * 4000", 1, "1:0:4000"), ("a * 4010", 1, "1:0:4000"), ("a * 4040", 2, "1:0:4000 2:4000:40"), ("a * 9000", 3, "1:0:4000 2:4000:4000 3:8000:1000"), ("x * 100 nl cr y * 100", 2, "1:0:100 2:102:100"), ("x * 100 nl nl y * 100", 2, "1:0:100 2:102:100")]


@query(values("name, chunks, spans", _SPLITS))
def split_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraph spans of the documented cases, and their number by the same splitter."""
    made = ["a" * 40, "a" * 39, "a" * 4000, "a" * 4010, "a" * 4040, "a" * 9000, "x" * 100 + "\n\r" + "y" * 100, "x" * 100 + "\n\n" + "y" * 100]
    d = frame(spark, "name string, t string", list(zip([r[0] for r in _SPLITS], made))).select("name", raw.split_spans(F.encode("t", "UTF-8")).alias("s"))
    return d.select("name", F.size("s").alias("chunks"), F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["para"].cast("string"), x["off"].cast("string"), x["len"].cast("string"))), " ").alias("spans"))


# chunkers and formulas

_TEXT = "One two.  Three four!\nFive six seven."


@query(values("kind, chunks", [("sentence", "One two. Three four!|Five six seven."), ("stop", "One two. Three four|Five six seven."), ("tokens", "One two. Three|four! Five six|seven."), ("hard", "aaaaaaaaaa|aaaaa bb"), ("short", "x y")]))
def chunkers(spark: SparkSession, sf: str) -> DataFrame:
    d = frame(spark, "t string", [_TEXT])
    rows = {"sentence": (raw.chunk_udf(raw.chunks_by_sentence, 20), _TEXT), "stop": (raw.chunk_udf(raw.chunks_by_stop, 20), _TEXT), "tokens": (raw.chunk_udf(raw.chunks_by_tokens, str.split, " ".join, 3), _TEXT), "hard": (raw.chunk_udf(raw.chunks_by_sentence, 10), "a" * 15 + " bb"), "short": (raw.chunk_udf(raw.chunks_by_stop, 20), " x  y ")}
    out = None
    for kind, (f, t) in rows.items():
        one = d.select(F.lit(kind).alias("kind"), F.array_join(f(F.lit(t)), "|").alias("chunks"))
        out = one if out is None else out.unionByName(one)
    return out


def _hashed(form: str) -> str:
    return hashlib.blake2b(form.encode(), digest_size=16).hexdigest()


_FORMS = [
    ("=SUM(A1,B1)", "SUM(ref:A1,ref:B1)"), ("=sum($B$1, A1)", "SUM(ref:A1,ref:B1)"), ("=A1+B1", "ref:A1op:+ref:B1"), ("=B1+A1", "ref:B1op:+ref:A1"), ('=IF(MAX(A1;2)>1,"x""y",Sheet1!C3)', 'IF(MAX(num:2,ref:A1)op:>num:1,str:"x""y",ref:SHEET1!C3)'),
    ("=VLOOKUP(B2,A1:C9,2)", "VLOOKUP(ref:B2,ref:A1:C9,num:2)"), ("=AND(MIN(B1,A1),1.5E3)", "AND(MIN(ref:A1,ref:B1),num:1.5E3)"),
]
_UNFORMED = [("=Ω", "unparsed"), ("text", "not-a-formula"), ("=", "empty")]


@query(values("formula, hash, canonical", [(f, _hashed(c), c) for f, c in _FORMS] + [(f, None, why) for f, why in _UNFORMED]))
def formula_identity(spark: SparkSession, sf: str) -> DataFrame:
    df = frame(spark, "formula string", [f for f, _ in _FORMS + _UNFORMED])
    return df.withColumn("h", formula.formula_hash("formula")).select("formula", "h.hash", "h.canonical")


_CELLS = [("w1", "=SUM(A1,B1)"), ("w2", "=SUM(B1,A1)"), ("w2", "=A1"), ("w3", "=A1+1"), ("w1", "=A1+1"), ("w1", "x"), ("w1", "=Ω"), ("w2", "=")]


def _cells(spark: SparkSession) -> DataFrame:
    return frame(spark, "workbook string, formula string", _CELLS).withColumn("h", formula.formula_hash("formula")).select("workbook", "formula", "h.*")


@query(values("hash, workbooks", [(_hashed("SUM(ref:A1,ref:B1)"), 2), (_hashed("ref:A1op:+num:1"), 2)]))
def shared_formulas(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.shared_formulas(_cells(spark)).select("hash", F.col("workbooks").cast("int"))


@query(values("cells, parsed, n_distinct, not_a_formula, unparsed, empty", [(8, 5, 3, 1, 1, 1)]))
def formula_coverage(spark: SparkSession, sf: str) -> DataFrame:
    c = corpus.formula_coverage(_cells(spark)).withColumnRenamed("distinct", "n_distinct")
    return c.select(*[F.col(x).cast("int") for x in c.columns])


@query(values("formula, reads", [("=SUM(A1:B2,C3)+A1", "A1:B2,C3,A1"), ("text", ""), ("=$D$4*D4", "D4"), (None, None)]))
def formula_references(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, "formula string", ["=SUM(A1:B2,C3)+A1", "text", "=$D$4*D4", None]).select("formula", F.array_join(formula.references("formula"), ",").alias("reads"))


_MATH = [("<math><apply><plus/><ci>b</ci><ci> a </ci></apply></math>", "apply(plus,ci(a),ci(b))"), ("<m:math xmlns:m='x'><m:apply><m:ci>+</m:ci><m:cn>2</m:cn><m:cn>1</m:cn></m:apply></m:math>", "apply(plus,cn(1),cn(2))"), ("<math><apply><minus/><ci>b</ci><ci>a</ci></apply></math>", "apply(minus,ci(b),ci(a))")]


@query(values("mathml, hash, canonical", [(m, _hashed(c), c) for m, c in _MATH] + [("<math><cerror/></math>", None, "cerror"), ("<math", None, None), ("<math/>", None, None)]))
def math_identity(spark: SparkSession, sf: str) -> DataFrame:
    df = frame(spark, "mathml string", [m for m, _ in _MATH] + ["<math><cerror/></math>", "<math", "<math/>"])
    return df.withColumn("h", formula.math_hash("mathml")).select("mathml", "h.hash", "h.canonical")


# vectors and evaluation

_TOKENS = "t AS (SELECT vec_id // 4 AS g, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY vec_id // 4 ORDER BY vec_id) AS r, count(*) OVER (PARTITION BY vec_id // 4) AS n FROM embeddings), x AS (SELECT g, r, n, unnest(e) AS x, unnest(range(64)) AS i FROM t)"


@query(
    f"WITH {_TOKENS} SELECT 'mean' AS kind, g, i::INTEGER AS place, round(avg(x), 6) AS value FROM x GROUP BY g, i UNION ALL SELECT 'max', g, i::INTEGER, round(max(x), 6) FROM x GROUP BY g, i UNION ALL SELECT 'cls', g, i::INTEGER, round(x, 6) FROM x WHERE r = 1 UNION ALL SELECT 'last', g, i::INTEGER, round(x, 6) FROM x WHERE r = n "
    "UNION ALL SELECT 'concat', g, i::INTEGER, round(x, 6) FROM x WHERE r = 1 UNION ALL SELECT 'concat', g, (i + 64)::INTEGER, round(x, 6) FROM x WHERE r = n UNION ALL SELECT 'weighted', g, i::INTEGER, round(sum(x * r) / any_value(n * (n + 1) / 2), 6) FROM x GROUP BY g, i"
)
def pooling(spark: SparkSession, sf: str) -> DataFrame:
    """Four vectors at a time as the tokens of a text, pooled in each way."""
    t = base(spark, sf).groupBy(F.floor(F.col("idx") / 4).alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "vec"))), lambda s: s["vec"]).alias("tokens"))
    out = None
    for mode in vectors.POOLS:
        one = t.select(F.lit(mode).alias("kind"), "g", F.posexplode(vectors.pool(F.col("tokens"), mode, renorm=False)).alias("place", "x")).select("kind", "g", "place", F.round("x", 6).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT count(*) FILTER (value >= 20 AND event_type = 'click') AS tp, count(*) FILTER (value >= 20 AND event_type <> 'click') AS fp, count(*) FILTER (value < 20 AND event_type = 'click') AS fn, count(*) FILTER (value < 20 AND event_type <> 'click') AS tn, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3 FROM events")
def confusion_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("value", (F.col("event_type") == "click").alias("click"))
    c = evaluate.confusion(e, "value", "click", 20.0)
    return c.select("tp", "fp", "fn", "tn", *[F.round(F.get("quartiles", i), 6).alias(f"q{i + 1}") for i in range(3)])


_COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_APART = f"knn AS MATERIALIZED (SELECT * FROM (SELECT a.vec_id AS query, b.vec_id AS idx, {_COSINE} AS cosine, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COSINE} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id % 40 <> b.vec_id % 40) WHERE rank <= 20)"


def _apart(spark: SparkSession, sf: str, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """Neighbours in other books than the query's: books are residues of the id."""
    b = base(spark, sf).withColumn("book", F.col("idx") % 40)
    return b, retrieve.knn(b, b, k, "vec", apart="book")


@query(f"WITH {_APART} SELECT query, idx, rank::INTEGER AS rank FROM knn WHERE rank <= 5")
def neighbours_in_other_books(spark: SparkSession, sf: str) -> DataFrame:
    return _apart(spark, sf, 5)[1].select("query", "idx", "rank")


@query(f"WITH {_APART}, {_recall_sql()}")
def recall_in_other_books(spark: SparkSession, sf: str) -> DataFrame:
    b, found = _apart(spark, sf)
    return _rounded(evaluate.recall_at(evaluate.hits(found, b)))


_AUTHORS = "w AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE vec_id % 9 END AS author FROM embeddings), h AS (SELECT query, rank, coalesce(q.author = i.author, FALSE) AS hit FROM knn JOIN w q ON query = q.vec_id JOIN w i ON idx = i.vec_id), p AS (SELECT query, " + ", ".join(f"max(CASE WHEN hit AND rank <= {k} THEN 1 ELSE 0 END) AS h{k}" for k in evaluate.KS) + " FROM h GROUP BY query)"


@query(f"WITH {_APART}, {_AUTHORS} SELECT count(*) AS queries, " + ", ".join(f"round(avg(h{k}), 6) AS author_{k}" for k in evaluate.KS) + " FROM p")
def same_author_control(spark: SparkSession, sf: str) -> DataFrame:
    b, found = _apart(spark, sf)
    items = b.select("idx", F.when(F.col("idx") % 7 == 0, "").otherwise((F.col("idx") % 9).cast("string")).alias("author"))
    c = evaluate.same_author(found, items)
    return c.select("queries", *[F.round(f"author_{k}", 6).alias(f"author_{k}") for k in evaluate.KS])


@query(f"WITH {_APART}, h AS (SELECT query, max(CASE WHEN rank <= 10 AND q.label = i.label THEN 1 ELSE 0 END) AS hit FROM knn JOIN embeddings q ON query = q.vec_id JOIN embeddings i ON idx = i.vec_id GROUP BY query) SELECT CASE WHEN query % 5 < 2 THEN 'named' ELSE 'other' END AS part, count(*) AS queries, round(avg(hit), 6) AS recall_10 FROM h WHERE query % 5 <> 4 GROUP BY 1")
def recall_by_class(spark: SparkSession, sf: str) -> DataFrame:
    """Recall apart for named classes, others, and none."""
    b, found = _apart(spark, sf)
    k = F.col("idx") % 5
    return _rounded(evaluate.by_class(evaluate.hits(found, b), b, F.when(k != 4, k < 2)))


@query("SELECT round(o1 - o0, 6)::DOUBLE AS before, round(s1 - s0, 6)::DOUBLE AS after, round((s1 - s0) - (o1 - o0), 6)::DOUBLE AS change FROM (SELECT avg(value) FILTER (event_type = 'click') AS o1, avg(value) FILTER (event_type <> 'click') AS o0, avg(value * value) FILTER (event_type = 'click') AS s1, avg(value * value) FILTER (event_type <> 'click') AS s0 FROM events)")
def separation_change(spark: SparkSession, sf: str) -> DataFrame:
    """How far same pairs and others lie apart in two measurements."""
    e = table(spark, sf, "events").select((F.col("event_type") == "click").alias("same"), F.col("value").alias("o"), (F.col("value") * F.col("value")).alias("s"))
    c = evaluate.separation_change(e, "o", "s")
    return c.select(*[F.round(x, 6).alias(x) for x in c.columns])


@query("SELECT round(a / b, 6)::DOUBLE AS kept_1, round(c / d, 6)::DOUBLE AS kept_5 FROM (SELECT avg((quality = 1)::INTEGER) AS a, avg((quality + toxic > 0)::INTEGER) AS b, avg((toxic = 1)::INTEGER) AS c, avg((quality >= 0)::INTEGER) AS d FROM labels)")
def retention(spark: SparkSession, sf: str) -> DataFrame:
    """What a code keeps of a ceiling, of two one-row tables of recall."""
    lab = table(spark, sf, "labels")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    q, t = F.col("quality"), F.col("toxic")
    code, ceiling = lab.agg(share(q == 1).alias("recall_1"), share(t == 1).alias("recall_5")), lab.agg(share(q + t > 0).alias("recall_1"), share(q >= 0).alias("recall_5"))
    r = evaluate.retention(code, ceiling, (1, 5))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice > 100000 DESC, o_orderkey)::INTEGER AS place FROM orders")
def judged_order(spark: SparkSession, sf: str) -> DataFrame:
    """A ranking with the related ones first, each part in its order."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("query"), "o_orderkey", (F.col("o_totalprice") > 100000).alias("related"), F.col("o_orderkey").alias("pos"))
    return evaluate.stable_judged(o).select("o_orderkey", F.col("pos").alias("place"))


# edges, groups, ranges

_OBSERVED = "e AS (SELECT DISTINCT o_custkey AS a, o_custkey + 1 + o_orderkey % 50 AS b FROM orders), o AS (SELECT a, b FROM e WHERE ('0x' || substr(sha256(a || ',' || b || ',0'), 1, 8))::BIGINT % 100 < 30)"


def _asserted(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_custkey")
    return table(spark, sf, "orders").select(k.alias("a"), (k + 1 + F.col("o_orderkey") % 50).alias("b")).distinct()


@query(f"WITH {_OBSERVED} SELECT a, b FROM o")
def observed_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.observed(_asserted(spark, sf), 30)


@query(f"WITH {_OBSERVED} SELECT a, b FROM o UNION SELECT a, b FROM e WHERE a % 10 = 0")
def united_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = _asserted(spark, sf)
    return graph.united(graph.observed(e, 30), e.filter("a % 10 = 0"))


@query("SELECT n_regionkey, sha256(array_to_string(list_sort(list(n_nationkey::VARCHAR)), ',')) AS cluster FROM nation GROUP BY n_regionkey")
def cluster_ids(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list("n_nationkey").alias("members"))
    return g.select("n_regionkey", graph.cluster_id().alias("cluster"))


@query("SELECT event_id FROM events WHERE event_type = 'click'")
def ranges_tile(spark: SparkSession, sf: str) -> DataFrame:
    """A scan over ranges that tile the store, put together."""
    e = table(spark, sf, "events").withColumn("idx", F.col("event_id"))
    out = None
    for lo, hi in ((None, 100), (100, 101), (101, 5000), (5000, None)):
        one = scan.category(e, "click", "event_type", lo, hi).select("event_id")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT * FROM (VALUES (128, 0.35, 44), (256, 0.35, 89), (512, 0.5, 256)) t(bits, share, n)")
def thresholds(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(b, s, scan.checked_threshold(scan.threshold(b, s))) for b, s in ((128, 0.35), (256, 0.35), (512, 0.5))]
    return frame(spark, "bits int, share decimal(3,2), n int", [(b, __import__("decimal").Decimal(str(s)), n) for b, s, n in rows])


@query("SELECT work, text FROM (SELECT o_custkey AS work, o_orderkey::VARCHAR AS text, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey::VARCHAR) AS r FROM orders) WHERE n >= 3 AND r <= 6")
def cited_often(spark: SparkSession, sf: str) -> DataFrame:
    return files.cited_often(table(spark, sf, "orders").select(F.col("o_custkey").alias("work"), F.col("o_orderkey").cast("string").alias("text"))).select("work", "text")


@query("SELECT (2 * o_orderkey + side)::BIGINT AS idx, text FROM (SELECT o_orderkey, side, CASE side WHEN 0 THEN a ELSE b END AS text FROM (SELECT o_orderkey, 'order number ' || o_orderkey || ' placed' AS a, 'customer ' || o_custkey || repeat(' x', (o_orderkey % 300)::INTEGER) AS b FROM orders), (VALUES (0), (1)) s(side) WHERE length(a) BETWEEN 20 AND 400 AND length(b) BETWEEN 20 AND 400 AND a <> b)")
def pair_lines(spark: SparkSession, sf: str) -> DataFrame:
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    p = o.select(k.alias("pair_id"), F.concat(F.lit("order number "), k.cast("string"), F.lit(" placed")).alias("a"), F.concat(F.lit("customer "), F.col("o_custkey").cast("string"), F.expr("repeat(' x', cast(o_orderkey % 300 as int))")).alias("b"))
    return files.pair_lines(p).select(F.col("idx").cast("long"), "text")


# model plug-ins


@query("SELECT p_partkey, part FROM (SELECT p_partkey, upper(p_name) AS part FROM part) WHERE part LIKE '%R%'")
def model_plug_ins(spark: SparkSession, sf: str) -> DataFrame:
    """A summariser and a scan's predicate that the caller brings."""
    p = table(spark, sf, "part").select("p_partkey", models.summarised(F.col("p_name"), str.upper).alias("part"))
    return models.where(p, lambda d: d["part"].str.contains("R"), ["part"])


@query(values("a, b, subjects", [(1, 2, "harbour,weather")]))
def judged_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that a judge finds to share subjects."""
    rows = [(1, 2, 5, "The weather at the harbour", "a harbour without weather"), (1, 3, 9, "The weather at sea", "nothing in common"), (2, 3, 7, "people people", "people")]
    e = graph.judged_edges(frame(spark, "a int, b int, distance int, text_a string, text_b string", rows), models.keyword_judge())
    return e.select("a", "b", F.array_join("subjects", ",").alias("subjects"))


@query(values("a, b, subjects", [(1, 2, "ships,wind")]))
def answered_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A judge that answers in text."""
    ship(spark)
    judge = models.answering_judge(lambda x, y: "SHARED: ships, wind" if "sail" in x and "sail" in y else "SHARED: NONE")
    rows = [(1, 2, 5, "they sail", "to sail"), (1, 3, 9, "they sail", "to walk")]
    return graph.judged_edges(frame(spark, "a int, b int, distance int, text_a string, text_b string", rows), judge).select("a", "b", F.array_join("subjects", ",").alias("subjects"))


@query("WITH g AS (SELECT event_type AS subject, count(DISTINCT user_id) AS n FROM events GROUP BY 1), r AS (SELECT subject, row_number() OVER (ORDER BY n DESC, subject) - 1 AS i FROM g WHERE n >= 2) SELECT 'batch of ' || count(*) AS name, string_agg(subject, ',' ORDER BY i) AS subjects FROM r GROUP BY i // 2")
def generated_themes(spark: SparkSession, sf: str) -> DataFrame:
    """Themes named by a model, batch by batch, of subjects with most members first."""
    g = table(spark, sf, "events").groupBy(F.col("event_type").alias("subject")).agg(F.collect_set("user_id").alias("members"))
    t = models.generated_themes(g, lambda s: f" batch of {len(s)} | {', '.join(s)}", batch=2)
    return t.select("name", F.array_join("subjects", ",").alias("subjects"))


@query(f"SELECT vec_id, round(x, 6)::DOUBLE AS first FROM (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN {DIM} ELSE embedding[1]::DOUBLE END AS x FROM embeddings)")
def cache_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors from the cache where it has one, else of the embedder."""

    class Fixed:
        name, dim = "m", DIM

        def embed_batch(self, texts: list[str]) -> list:
            return [[float(DIM)] * DIM for _ in texts]

    b = base(spark, sf).withColumn("hash", codes.content_hash(F.col("idx").cast("string")))
    cache = b.filter("idx % 3 <> 0").select("hash", F.lit("m").alias("model"), "vec")
    got = models.fill_cache(b.select("idx", "hash", F.col("idx").cast("string").alias("text")), cache, Fixed())
    return got.select(F.col("idx").alias("vec_id"), F.round(F.get("vec", 0).cast("double"), 6).alias("first"))


@query("SELECT count(*) FILTER (vec_id % 3 <> 0) AS hits, count(*) FILTER (vec_id % 3 = 0) AS misses FROM embeddings")
def cache_counts(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf).withColumn("hash", codes.content_hash(F.col("idx").cast("string")))
    return vectors.cache_counts(vectors.cached(b.select("hash"), b.filter("idx % 3 <> 0").select("hash", F.lit("m").alias("model"), "vec"), "m", DIM)[0])


@query("WITH s AS (SELECT source, list_sort(list(DISTINCT lang)) AS f FROM documents GROUP BY source) SELECT a.source AS a, b.source AS b, list_has_any(a.f, b.f) AS overlap, array_to_string(list_filter(a.f, lambda x: NOT list_contains(b.f, x)), ',') AS missing FROM s a JOIN s b ON a.source < b.source")
def facet_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Whether sources share a facet, and which the second lacks: a row for each source, compared in pairs."""
    s = table(spark, sf, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("f"))
    a, b = (s.select(F.col("source").alias(x), F.col("f").alias(f"f{x}")) for x in "ab")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.arrays_overlap("fa", "fb").alias("overlap"), F.array_join(F.array_sort(F.array_except("fa", "fb")), ",").alias("missing"))


@query("SELECT 'f' || doc_id AS path, 'no letter ' || doc_id AS error FROM documents WHERE length(text) < 40")
def encoding_errors(spark: SparkSession, sf: str) -> DataFrame:
    d, i = table(spark, sf, "documents"), F.col("doc_id").cast("string")
    return corpus.errors(d.select(F.concat(F.lit("f"), i).alias("path"), F.when(F.length("text") < 40, F.concat(F.lit("no letter "), i)).alias("error")))


