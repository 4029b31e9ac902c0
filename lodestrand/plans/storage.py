"""Queries that write stores, sidecars, caches and trees to the shared folder and read them back."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..index import Index
from ..operators import corpus, graph, models, scan
from ..session import shared_dir
from ..sources import files, store
from .coverage import _hashed, frame, table, values

QUERIES: dict = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def refused(f: Callable[[], object]) -> bool:
    try:
        f()
    except (store.Mismatch, FileNotFoundError, ValueError, KeyError):
        return True
    return False


def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """A paragraph for each part and brand: path is the brand."""
    p = table(spark, sf, "part")
    return p.select(F.col("p_brand").alias("path"), (F.col("p_partkey") + 1).alias("para"), (F.col("p_partkey") * 10).alias("off"), F.octet_length("p_name").cast("long").alias("len"), F.encode("p_name", "UTF-8").alias("bytes"), F.col("p_size").alias("category"), F.lit(1_700_000_000).alias("timestamp"))


_RECORDS = "SELECT row_number() OVER (ORDER BY p_brand, p_partkey) - 1 AS idx, p_brand AS path, p_partkey + 1 AS para, p_partkey * 10 AS off, strlen(p_name)::BIGINT AS len, sha256(p_name) AS hash, p_size AS category FROM part"


@query(_RECORDS)
def store_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Records of paragraphs, committed and opened with the same parameters."""
    at = place(spark, "store")
    store.save(store.records(paragraphs(spark, sf)), at, store.params())
    return store.opened(spark, at, store.params())[0].select("idx", "path", "para", "off", "len", "hash", "category")


@query(f"SELECT * FROM ({_RECORDS}) WHERE idx IN (SELECT min(idx) FROM ({_RECORDS}) GROUP BY hash) AND hash = sha256('red widget')")
def store_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The first record of a content hash."""
    r = store.records(paragraphs(spark, sf))
    return scan.by_hash(r, codes_of("red widget")).select("idx", "path", "para", "off", "len", "hash", "category")


def codes_of(t: str) -> str:
    import hashlib

    return hashlib.sha256(t.encode()).hexdigest()


@query("SELECT p_brand AS path, count(*) AS paras, min(p_partkey) * 10 AS off, max(p_partkey * 10 + strlen(p_name)) - min(p_partkey) * 10 AS len, sha256(string_agg(p_name, chr(10) || chr(10) ORDER BY p_partkey)) AS hash FROM part GROUP BY p_brand")
def document_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of whole documents beside those of their paragraphs."""
    r = store.records(paragraphs(spark, sf), documents=True)
    paras = r.filter("para > 0").groupBy("path").agg(F.count("*").alias("paras"))
    return r.filter("para = 0").join(paras, "path").select("path", "paras", "off", "len", "hash")


@query(values("what, refused", [("same", False), ("model", True), ("dim", True), ("bits", True), ("seed", True), ("no store", True), ("threshold", True), ("short hash", True), ("unknown hash", True), ("version before", False)]))
def store_refusals(spark: SparkSession, sf: str) -> DataFrame:
    """What is refused rather than answered wrongly; and a new version takes the old one's place whole."""
    at, r = place(spark, "store"), store.records(paragraphs(spark, sf))
    store.save(r.filter("idx < 5"), at, store.params())
    old = store.opened(spark, at)[0]
    store.save(r, at, store.params())
    cases = {
        "same": lambda: store.opened(spark, at, store.params()), "model": lambda: store.opened(spark, at, store.params("other")), "dim": lambda: store.opened(spark, at, store.params(dim=3)), "bits": lambda: store.opened(spark, at, store.params(bits=256)), "seed": lambda: store.opened(spark, at, store.params(seed=1)),
        "no store": lambda: store.opened(spark, f"{at}-none"), "threshold": lambda: scan.checked_threshold(513), "short hash": lambda: scan.neighbourhood(r, "ab", 3), "unknown hash": lambda: scan.neighbourhood(r, "0" * 64, 3),
        "version before": lambda: None if (old.count(), store.opened(spark, at)[0].count() > 5) == (5, True) else scan.checked_threshold(-1),
    }
    return frame(spark, "what string, refused boolean", [(k, refused(f)) for k, f in cases.items()])


@query("SELECT vec_id AS idx, round(embedding[1]::DOUBLE, 6) AS first, len(embedding)::INTEGER AS n FROM embeddings")
def sidecar_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors saved in two segments beside a store."""
    e, at = table(spark, sf, "embeddings"), place(spark, "sidecar")
    v = e.select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"))
    n = e.count()
    store.append_sidecar(v.filter("idx < 100"), at, "m", 100)
    store.append_sidecar(v.filter("idx >= 100"), at, "m", n)
    return store.open_sidecar(spark, at, n, "m").select("idx", F.round(F.get("vec", 0).cast("double"), 6).alias("first"), F.size("vec").alias("n"))


@query(values("what, refused", [("same", False), ("any model", False), ("other count", True), ("other model", True), ("missing", True), ("repeated index", True), ("index before", True), ("lengths", True), ("empty", False)]))
def sidecar_refusals(spark: SparkSession, sf: str) -> DataFrame:
    at = place(spark, "sidecar")
    rows = lambda *x: frame(spark, "idx long, vec array<float>", [(i, v) for i, v in x])
    store.save_sidecar(rows((10, [1.0, 2.0]), (20, [3.0, 4.0])), at, "m", 50)
    cases = {
        "same": lambda: store.open_sidecar(spark, at, 50, "m"), "any model": lambda: store.open_sidecar(spark, at, 50), "other count": lambda: store.open_sidecar(spark, at, 51, "m"), "other model": lambda: store.open_sidecar(spark, at, 50, "x"), "missing": lambda: store.open_sidecar(spark, f"{at}x", 50),
        "repeated index": lambda: store.save_sidecar(rows((1, [1.0]), (1, [2.0])), f"{at}y", "m", 50), "index before": lambda: store.append_sidecar(rows((15, [1.0, 2.0])), at, "m", 60), "lengths": lambda: store.save_sidecar(rows((1, [1.0]), (2, [2.0, 3.0])), f"{at}y", "m", 50), "empty": lambda: store.save_sidecar(rows(), f"{at}z", "m", 50),
    }
    return frame(spark, "what string, refused boolean", [(k, refused(f)) for k, f in cases.items()])


@query(values("hash, vec", [("aa" * 32, "1.0,-2.0"), ("bb" * 32, "0.5,4.0")]))
def cache_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON Lines cache with broken lines, other models, wrong lengths and repeated keys."""
    a, b = "aa" * 32, "BB" * 32
    lines = [f'{{"h":"{a}","m":"m","d":2,"v":"ADwAwA=="}}', f'{{"h":"{a}","m":"m","d":2,"v":"AAAAAA=="}}', f'{{"h":"{b}","m":"m","d":2,"v":"ADgARA=="}}', f'{{"h":"{"cc" * 32}","m":"other","d":2,"v":"ADwAwA=="}}', f'{{"h":"{"dd" * 32}","m":"m","d":3,"v":"ADwAwA=="}}', '{"h":"ee","m":"m","d":2,"v":"ADwAwA=="}', f'{{"h":"{"ff" * 32}","m":"m","d":2,"v":"ADw', "not json"]
    at = place(spark, "cache")
    frame(spark, "value string", lines).coalesce(1).write.text(at)
    return store.read_cache_lines(spark, at, "m").select("hash", F.array_join(F.col("vec").cast("array<string>"), ",").alias("vec"))


@query("SELECT sha256(event_id::VARCHAR) AS hash, (event_id % 2048)::DOUBLE AS a, -0.5::DOUBLE AS b FROM events WHERE event_id % 3 = 0 UNION ALL SELECT sha256(event_id::VARCHAR), 1.0, 2.0 FROM events WHERE event_id % 3 = 1")
def cache_append(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors put into a cache in two calls; what is there already stays."""
    e, at = table(spark, sf, "events"), place(spark, "cache")
    h, k = codes.content_hash(F.col("event_id").cast("string")).alias("hash"), F.col("event_id") % 3
    store.append_cache(e.filter(k == 0).select(h, F.array(F.col("event_id") % 2048, F.lit(-0.5)).cast("array<float>").alias("vec")), at, "m")
    store.append_cache(e.filter(k < 2).select(h, F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("vec")), at, "m")
    return store.read_cache_lines(spark, at, "m").select("hash", F.get("vec", 0).cast("double").alias("a"), F.get("vec", 1).cast("double").alias("b"))


@query("SELECT doc_id::VARCHAR AS book, 'sha256:' || sha256(text) AS digest, strlen(text)::INTEGER AS bytes, 'q' || quality AS title FROM documents d LEFT JOIN labels l USING (doc_id)")
def manifest_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest of all documents with a catalogue of some, saved and read again."""
    i = F.col("doc_id").cast("string")
    books = table(spark, sf, "documents").select(i.alias("book"), "text", F.concat(F.lit("f"), i).alias("path"), F.lit("utf-8").alias("encoding"))
    m = corpus.manifest(books, table(spark, sf, "labels").select(i.alias("book"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("title")))
    at = place(spark, "manifest")
    store.save_manifest(m, at)
    return store.open_manifest(spark, at).select("book", "digest", F.col("bytes").cast("int"), "title")


@query("WITH d AS (SELECT doc_id, length(text) AS n, strlen(text) AS b FROM documents) SELECT count(*) FILTER (b >= 40) AS kept, count(*) FILTER (b = 0) AS empty, count(*) FILTER (b > 0 AND b < 40) AS short, count(*) FILTER (b >= 40) AS records, count(*) FILTER (b >= 40) AS vectors FROM d")
def store_build(spark: SparkSession, sf: str) -> DataFrame:
    """A corpus table of all documents to a store and its vectors in one job."""
    d, csv, at = table(spark, sf, "documents"), place(spark, "csv"), place(spark, "built")
    d.select(F.col("doc_id").alias("text_id"), F.lit(1).alias("para"), F.lit("A").alias("locc"), F.lit("s").alias("subjects"), F.lit(1900).alias("death_year"), F.lit("x").alias("author"), F.lit("t").alias("title"), "text").write.csv(csv, header=True, quote='"', escape='"')

    class Lengths:
        name, dim = "lengths", 4

        def embed_batch(self, texts: list[str]) -> list:
            return [[1.0, len(t) % 7 - 3.0, len(t) % 5 - 2.0, len(t) % 3 - 1.0] for t in texts]

    counts = store.build(spark, csv, at, Lengths())
    n = store.open_sidecar(spark, f"{at}.vectors", counts["records"], "lengths").count()
    return frame(spark, "kept long, empty long, short long, records long, vectors long", [(counts["kept"], counts["empty"], counts["short"], counts["records"], n)])


@query("WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(trim(text, chr(10)), '\\n\\s*\\n')) AS x FROM documents WHERE lang = 'en'), q AS (SELECT doc_id, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS x FROM p) SELECT doc_id::VARCHAR AS text_id, count(*) AS paras, sum(length(x))::BIGINT AS chars FROM q WHERE length(x) BETWEEN 40 AND 4000 GROUP BY doc_id")
def paragraph_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The paragraphs of English documents written as a table and read again."""
    d, at = table(spark, sf, "documents"), place(spark, "csv")
    i = F.col("doc_id").cast("string")
    books = d.select(i.alias("book"), "text")
    catalogue = d.select(i.alias("book"), F.col("lang").alias("language"), F.lit("A").alias("locc"), F.lit("s").alias("subjects"), F.lit(1900).alias("death_year"), F.lit("x").alias("authors"), F.lit("t").alias("title"))
    files.write_paragraph_csv(books, catalogue, at)
    back = spark.read.csv(at, header=True, multiLine=True, quote='"', escape='"')
    return back.groupBy("text_id").agg(F.count("*").alias("paras"), F.sum(F.length("text")).alias("chars"))


@query("SELECT a, b, distance::INTEGER AS distance, array_to_string(subjects, ',') AS subjects FROM (SELECT user_id AS a, user_id + 1 + event_id % 5 AS b, count(*) AS distance, list_sort(list(DISTINCT event_type)) AS subjects FROM events GROUP BY 1, 2)")
def edges_json(spark: SparkSession, sf: str) -> DataFrame:
    """Judged edges written as lines of JSON and read again."""
    u, at = F.col("user_id"), place(spark, "edges")
    e = table(spark, sf, "events").groupBy(u.alias("a"), (u + 1 + F.col("event_id") % 5).alias("b")).agg(F.count("*").cast("int").alias("distance"), F.array_sort(F.collect_set("event_type")).alias("subjects"))
    files.write_themes(e, at)
    return files.read_edges(spark, at).select("a", "b", "distance", F.array_join("subjects", ",").alias("subjects"))


@query("SELECT event_type AS name, event_type AS subjects, count(DISTINCT user_id)::INTEGER AS size, list_sort(list(DISTINCT user_id)) AS members FROM events GROUP BY event_type HAVING count(DISTINCT user_id) >= 2")
def themes_json(spark: SparkSession, sf: str) -> DataFrame:
    """Themes with their members, written and read again."""
    g, at = table(spark, sf, "events").groupBy(F.col("event_type").alias("subject")).agg(F.array_sort(F.collect_set("user_id")).alias("members")), place(spark, "themes")
    files.write_themes(graph.themes(g, frame(spark, "name string, subjects array<string>", [("none", ["absent"])])), at)
    back = spark.read.schema("name string, subjects array<string>, members array<long>, size int").json(at)
    return back.select("name", F.array_join("subjects", ",").alias("subjects"), "size", "members")


def _folder(spark: SparkSession) -> str:
    """A small tree of text files, one of them empty, one hidden, one of another kind."""
    at = place(spark, "tree")
    fs, path = store._fs(spark, at)
    body = {"a/one.txt": "A paragraph about ships and weather at sea, long enough.\n\nAnother one about harbours and tides, also long.", "a/two.md": "A paragraph about ships and weather at sea, long enough.", "b/empty.txt": "", "b/.hidden.txt": "x" * 50, "b/c.bin": "y" * 50}
    for name, t in body.items():
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{name}"), True)
        out.write(bytearray(t.encode()))
        out.close()
    return at.removeprefix("file:").replace("//", "/")


@query(values("key, value", [("records", "3"), ("scans", "1"), ("threshold", "40"), ("indexed", "2"), ("skipped", "0"), ("near", "1"), ("text", "A paragraph about ships and weather at sea, long enough."), ("loaded", "3"), ("no mount", "True"), ("unknown verb", "True"), ("too few words", "True")]))
def index_verbs(spark: SparkSession, sf: str) -> DataFrame:
    """Mount, index, thresh, similar, commit as control lines; read-back, statistics and errors."""
    at, ix = place(spark, "index"), Index(spark)
    ix.control(f"# a comment\n\nmount books {_folder(spark)}\nindex books\nthresh 40\ncommit {at}")
    first = ix.records.filter("path like '%one.txt' and para = 1").first()
    near = ix.similar(first["hash"])
    twin = ix.read_back(ix.records.filter("path like '%two.md'")).first()
    rows = [(k, v) for k, v in ix.stats().collect() if k in ("records", "scans", "threshold", "indexed", "skipped")]
    rows += [("near", str(near.count())), ("text", twin["text"]), ("loaded", str(Index(spark).load(at).count()))]
    rows += [("no mount", str(refused(lambda: ix.build("none")))), ("unknown verb", str(refused(lambda: ix.control("drop all")))), ("too few words", str(refused(lambda: ix.control("mount x"))))]
    return frame(spark, "key string, value string", rows)


@query(values("name, length", [("one.txt", 106), ("two.md", 56)]))
def folder_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Text files of a folder, without hidden and empty ones and those of other kinds."""
    found, _ = files.folder(spark, _folder(spark))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").cast("int").alias("length"))


def _workbook(sheets: dict[str, list[tuple[str, str, str | None]]]) -> bytes:
    """A workbook with inline strings and formulas: (place, text, formula)."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i, _ in enumerate(sheets)) + "</Relationships>")
        for i, cells in enumerate(sheets.values()):
            body = "".join(f'<c r="{r}" t="inlineStr">' + (f"<f>{f}</f>" if f else "") + f"<is><t>{t}</t></is></c>" for r, t, f in cells)
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData><row>{body}</row></sheetData></worksheet>")
    return buf.getvalue()


_SHEETS = {"Sales plan": [(f"{c}1", t, None) for c, t in zip("ABCD", ("Region", "Quarter", "Total sales", "12"))] + [("A2", "North", None), ("A3", "South", None), ("A4", "West", None), ("B2", "5", "SUM(A1,B1)"), ("C2", "x", "SUM(B1,A1)")], "12": [("A1", "Note", None)]}


@query(values("sheet, kind, position, text", [("Sales plan", "sheet", 0, "Sales plan"), ("Sales plan", "row", 0, "Region | Quarter | Total sales"), ("Sales plan", "col", 0, "Region | North | South | West")]))
def workbook_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Label groups of a workbook, and a file that is none."""
    d = frame(spark, "path string, content binary", [("a_b__w.xlsx", bytearray(_workbook(_SHEETS))), ("bad.xlsx", bytearray(b"no"))])
    return files.label_groups(files.workbooks(d)).select("sheet", "kind", F.col("position").cast("int"), "text")


@query(values("formula, hash", [("=SUM(A1,B1)", _hashed("SUM(ref:A1,ref:B1)")), ("=SUM(B1,A1)", _hashed("SUM(ref:A1,ref:B1)"))]))
def workbook_formulas(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.formula import formula_hash

    c = files.workbooks(frame(spark, "path string, content binary", [("w.xlsx", bytearray(_workbook(_SHEETS)))])).filter("formula is not null")
    return c.withColumn("h", formula_hash("formula")).select("formula", "h.hash")


@query(values("path, encoding, changed, bytes", [("/t/a.txt", "utf-8", False, 6), ("/t/b/c.txt", "cp1252", True, 5), ("/t/b/d.txt", "ascii", True, 4)]))
def clean_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Files cleaned and written to a mirror tree; those done at their time or later are left."""
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [("/t/a.txt", t, bytearray("é’x".encode())), ("/t/b/c.txt", t, bytearray(b"ab\x92")), ("/t/b/d.txt", t, bytearray(b"a\r\nb\n")), ("/t/done.txt", t, bytearray(b"x")), ("/t/later.txt", t, bytearray(b"x"))]
    done = frame(spark, "path string, mtime timestamp", [("/t/done.txt", t), ("/t/later.txt", t + dt.timedelta(1)), ("/t/a.txt", t - dt.timedelta(1))])
    cleaned = files.clean_tree(frame(spark, "path string, mtime timestamp, content binary", rows), done)
    out = files.mirror_tree(cleaned, "/t", place(spark, "mirror").removeprefix("file:").replace("//", "/"))
    return cleaned.join(out, "path").select("path", "encoding", "changed", F.col("bytes").cast("int"))


@query("SELECT CASE WHEN i = 0 THEN event_type ELSE 'x' END AS src, '/out/' || event_type AS dst, 'b' AS book FROM (SELECT DISTINCT event_type FROM events), (VALUES (1)) t(i) WHERE FALSE UNION ALL SELECT '/in/' || event_type, '/out/' || event_type, event_type FROM (SELECT DISTINCT event_type FROM events)")
def planned_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Source and target of each file that is to be made."""
    e = table(spark, sf, "events").select(F.concat(F.lit("/in/"), "event_type").alias("path"), F.col("event_type").alias("book")).distinct()
    return corpus.jobs(e, "/in", "/out")


@query("SELECT idx, vec_id FROM (SELECT row_number() OVER (ORDER BY label, vec_id) - 1 AS idx, vec_id FROM embeddings)")
def numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Places in a total order without one task."""
    return store.with_index(table(spark, sf, "embeddings").select("label", "vec_id"), ["label", "vec_id"]).select("idx", "vec_id")


@query("SELECT count(*) AS records, count(DISTINCT sha256(p_name)) AS hashes, 64::INTEGER AS dim FROM part")
def semantic_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose codes are of an embedder's vectors, with the vectors beside them."""
    p = paragraphs(spark, sf).withColumn("text", F.decode("bytes", "UTF-8"))
    r, v, about = models.semantic_records(p, models.HashEmbedder(64))
    n = v.filter(F.size("vec") == about["dim"]).join(r.filter("lsh0 is not null"), "idx")
    return n.agg(F.count("*").alias("records"), F.countDistinct("hash").alias("hashes"), F.lit(about["dim"]).alias("dim"))


