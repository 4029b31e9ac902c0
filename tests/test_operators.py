import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.index import Index
from lodestrand.operators import corpus, evaluate, graph, models, retrieve, scan, vectors
from lodestrand.sources import files, store
from lodestrand.streaming import ingest


def records(spark, n=300):
    rng = np.random.default_rng(1)
    c = rng.integers(-(2**62), 2**62, (n, 2))
    c[1], c[2] = c[0], c[0] ^ 1
    return spark.createDataFrame([(i, [int(a), int(b)], int(a), int(b), f"{i:064x}", i % 7, i * 1000) for i, (a, b) in enumerate(c)], "idx long, code array<long>, lsh0 long, lsh1 long, hash string, category int, timestamp long"), c


def bits(x, y):
    return sum(bin((int(a) ^ int(b)) & (2**64 - 1)).count("1") for a, b in zip(x, y))


@pytest.mark.parametrize("radius", [0, 48, 64, 128])
def test_scan_equals_model(spark, radius):
    df, c = records(spark)
    got = [r.idx for r in scan.similar(df, (int(c[0][0]), int(c[0][1])), radius).orderBy("idx").collect()]
    assert got == [i for i in range(len(c)) if bits(c[0], c[i]) <= radius]


def test_scans(spark):
    df, c = records(spark)
    assert scan.time_range(df, 5000, 7000).count() == 3 and scan.time_range(df, 7, 5).count() == 0
    assert scan.category(df, 3, limit=5).count() == 5 and scan.category(df, 99).count() == 0
    tiles = [scan.similar(df, (0, 0), 64, lo, lo + 100).count() for lo in (0, 100, 200)]
    assert sum(tiles) == scan.similar(df, (0, 0), 64).count()
    assert [r.idx for r in scan.neighbours(df, 0, 2).collect()] == [0, 1, 2]
    assert [r.idx for r in scan.neighbourhood(df, "0" * 64, 2).collect()] == [1, 2]
    with pytest.raises(ValueError):
        scan.neighbourhood(df, "zz", 1)
    with pytest.raises(KeyError):
        scan.neighbourhood(df, "f" * 64, 1)
    with pytest.raises(ValueError):
        scan.checked_threshold(513)


def test_pairs_and_knn(spark):
    df, c = records(spark, 120)
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if bits(c[i], c[j]) <= 50}
    assert {(r.a, r.b) for r in retrieve.near_pairs(df, 50, block=32).collect()} == want
    assert {(r.a, r.b) for r in retrieve.banded_pairs(df, 7).collect()} == {(0, 1), (0, 2), (1, 2)}
    k = retrieve.knn(df, df, 3, "code", "hamming", block=50).filter("query = 5").orderBy("rank").collect()
    order = sorted((bits(c[5], c[j]), j) for j in range(120) if j != 5)[:3]
    assert [(int(r.score), r.idx) for r in k] == order


def test_components_of_chains_and_cycles(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cluster_score_and_themes(spark):
    s = graph.cluster_score(spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (2, "y")], "cluster int, label string")).first()
    assert (s.together, s.purity, s.clusters, s.largest) == (pytest.approx(1 / 3), 0.5, 2, 2)
    e = spark.createDataFrame([(1, 2, 3, ["sea", "ships"]), (2, 3, 4, ["sea"]), (4, 5, 1, ["war"])], "a long, b long, distance int, subjects array<string>")
    g = graph.subject_groups(e)
    top = g.first()
    assert top.subject == "sea" and top.members == [1, 2, 3] and top.subjects == {"sea": 2, "ships": 1}
    t = graph.themes(g, spark.createDataFrame([("Sailing", ["sea", "ships"])], "name string, subjects array<string>")).collect()
    assert [(r.name, r.size) for r in t] == [("Sailing", 3), ("war", 2)]


def test_rerank_keeps_missing_last(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (5, [0.6, 0.8])], "idx long, vec array<double>")
    s = spark.createDataFrame([(5, 0), (1, 1), (0, 2), (3, 3)], "idx long, pos int")
    assert [r.idx for r in retrieve.rerank(s, v, [1.0, 0.0]).collect()] == [0, 5, 1, 3]


def test_pooling(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [3.0, 2.0]],)], "t array<array<double>>")
    got = df.select(*[vectors.pool(F.col("t"), m, False).alias(m) for m in vectors.POOLS]).first()
    assert got["mean"] == [2, 1] and got["max"] == [3, 2] and got["cls"] == [1, 0] and got["last"] == [3, 2] and got["concat"] == [1, 0, 3, 2] and got["weighted"] == pytest.approx([7 / 3, 4 / 3])
    z = spark.range(1).select(vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("x")).first().x
    assert z == 0


def test_store_guards(spark, tmp_path):
    df, _ = records(spark, 20)
    p = str(tmp_path / "store")
    store.save(df, p, store.params())
    assert store.opened(spark, p, store.params())[0].count() == 20
    for other in (store.params(seed=1), store.params(bits=256), store.params(model="x"), store.params(dim=3)):
        with pytest.raises(store.Mismatch):
            store.opened(spark, p, other)
    v = spark.createDataFrame([(0, [1.0]), (2, [2.0])], "idx long, vec array<double>")
    store.save_sidecar(v, str(tmp_path / "side"), "m", 20)
    assert store.open_sidecar(spark, str(tmp_path / "side"), 20).count() == 2
    for count, model in ((21, None), (20, "other")):
        with pytest.raises(store.Mismatch):
            store.open_sidecar(spark, str(tmp_path / "side"), count, model)
    with pytest.raises(store.Mismatch):
        store.save_sidecar(v.union(v), str(tmp_path / "bad"), "m", 20)


def test_cache_lines(spark, tmp_path):
    import base64

    v = base64.b64encode(np.array([1, 0.5], "<f2").tobytes()).decode()
    line = lambda **x: json.dumps({"h": "A" * 64, "m": "m", "d": 2, "v": v} | x)
    p = tmp_path / "c.jsonl"
    p.write_text("\n".join([line(), line(v=base64.b64encode(b"\0" * 4).decode()), line(m="other"), line(h="ab"), line(d=3, h="b" * 64), line()[:40]]))
    got = store.read_cache_lines(spark, str(p), "m").collect()
    assert [(r.hash, r.vec) for r in got] == [("a" * 64, [1.0, 0.5])]


def test_index_verbs(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    para = "ships and weather at sea, a paragraph of more than forty bytes, number "
    (root / "a.txt").write_text("\n\n".join(para + str(i) for i in range(5)))
    (root / "b.bin").write_text(para)
    (root / ".hidden.txt").write_text(para)
    (root / "empty.txt").write_text("")
    ix = Index(spark)
    ix.control(f"# comment\n\nmount m {root}\nthresh 128\nindex m")
    assert [r.para for r in ix.records.orderBy("idx").collect()] == [1, 2, 3, 4, 5]
    near = ix.similar(ix.records.filter("idx = 0").first().hash)
    assert near.count() == 4 and ix.read_back(near).orderBy("idx").first().text == para + "1"
    ix.commit(str(tmp_path / "s"))
    assert Index(spark).load(str(tmp_path / "s")).count() == 5
    with pytest.raises(store.Mismatch):
        Index(spark, model="other").load(str(tmp_path / "s"))
    for bad in ("nonsense", "thresh 600", "index nowhere", "mount x"):
        with pytest.raises((ValueError, KeyError)):
            ix.control(bad)
    assert {r.key: r.value for r in ix.stats().collect()}["records"] == "5"


def test_corpus_functions(spark, tmp_path):
    p = tmp_path / "cat.csv"
    p.write_text('Text#,Type,Issued,Title,Language,Authors,Subjects,LoCC,Bookshelves\n1,Text,1999,"A, B",en,"X, 1814?-1884",S,PS; QA,\n2,Sound,,,,,,,\n')
    cat = files.catalogue_csv(spark, str(p))
    r = cat.collect()
    assert len(r) == 1 and r[0].title == "A, B" and r[0].death_year == 1884 and r[0].locc == "PS"
    books = spark.createDataFrame([("1", "text " * 20, "/1.txt", "ascii"), ("3", "x", "/3.txt", "ascii")], "book string, text string, path string, encoding string")
    m = corpus.manifest(books, cat).collect()
    assert [(x.book, x.title, x.paras) for x in m] == [("1", "A, B", 1), ("3", None, 0)]
    done = spark.createDataFrame([("a", 5), ("b", 1)], "path string, mtime int")
    src = spark.createDataFrame([("a", 5), ("b", 2), ("c", 0)], "path string, mtime int")
    assert sorted(x.path for x in corpus.todo(src, done).collect()) == ["b", "c"]
    c = tmp_path / "corpus.csv"
    c.write_text('text_id,para,text\n1,1,"' + "long, text\n" * 5 + '"\n1,2,short\n1,3,\n')
    rows, counts = files.corpus_csv(spark, str(c))
    assert rows.count() == 1 and counts.first().asDict() == {"kept": 1, "empty": 1, "short": 1}


def test_evaluation(spark):
    ranked = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 2, 1), (1, 0, 2)], "query long, idx long, rank int")
    truth = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")], "idx long, label string")
    r = evaluate.recall_at(evaluate.hits(ranked, truth), (1, 2)).first()
    assert (r.queries, r.recall_1, r.recall_2) == (2, 0.0, 0.5)
    assert evaluate.chance(truth).first().chance == pytest.approx(1 / 3)
    assert evaluate.round_robin(truth, "label", 2).select("label").distinct().count() == 2


def test_streaming_once_each(spark, tmp_path):
    rows = "array(named_struct('doc_id', 1L, 'text', 'a'), named_struct('doc_id', 2L, 'text', 'a'), named_struct('doc_id', 3L, 'text', 'b'))"
    spark.sql(f"select inline({rows})").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    q = ingest.append(ingest.once_each(ingest.arriving(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_models_plug_in(spark, tmp_path):
    e = models.HashEmbedder(16)
    para = "ships and weather at sea, paragraph number "
    rows = [("a", i, 0, 60, bytearray((para + str(i)).encode()), para + str(i)) for i in range(6)]
    paras = spark.createDataFrame(rows, "path string, para long, off long, len long, bytes binary, text string")
    records, side, about = models.semantic_records(paras, e)
    assert records.count() == side.count() == 6 and about["model"] == "hash-16" and records.filter("lsh0 is null").count() == 0
    texts = paras.select(F.sha2("text", 256).alias("hash"), "text")
    cache = texts.limit(2).select("hash", F.lit(e.name).alias("model"), F.array_repeat(F.lit(9.0), 16).alias("vec"))
    got = models.fill_cache(texts, cache, e).collect()
    assert len(got) == 6 and sum(r.vec[0] == 9.0 for r in got) == 2 and all(len(r.vec) == 16 for r in got)

    class Short(models.HashEmbedder):
        def embed_batch(self, texts):
            return super().embed_batch(texts)[1:]

    with pytest.raises(Exception, match="vectors"):
        texts.select(models.embedded(F.col("text"), Short(4))).collect()
    pairs = spark.createDataFrame([(0, 1, 3, "weather and harbours", "harbours in weather"), (0, 2, 4, "weather", "war")], "a long, b long, distance int, text_a string, text_b string")
    edges = graph.judged_edges(pairs, models.keyword_judge())
    assert [r.subjects for r in edges.collect()] == [["harbours", "weather"]]
    assert graph.judged_edges(pairs, models.answering_judge(lambda a, b: "SHARED: Sea" if "harbours" in b else "SHARED: none")).count() == 1
    named = models.generated_themes(graph.subject_groups(edges), lambda s: " Sea | " + ", ".join(s), batch=1)
    assert sorted((r.name, r.subjects) for r in named.collect()) == [("sea", ["harbours"]), ("sea", ["weather"])]
    files.write_themes(graph.themes(graph.subject_groups(edges), named), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).first()["size"] == 2
    edges.write.json(str(tmp_path / "e"))
    assert files.read_edges(spark, str(tmp_path / "e")).first().b == 1
    assert models.where(paras, lambda p: p["para"] > 3, ["para"]).count() == 2
    assert paras.select(models.summarised(F.col("text"), str.upper).alias("x")).first().x == (para + "0").upper()
