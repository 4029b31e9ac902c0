"""Steps over all pairs: what a task holds and what leaves it is bounded, and results are those of plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.operators import evaluate, graph, retrieve


def coded(spark, n=200, kinds=40):
    """Records with codes of which many are equal or at equal distances, and labels with nulls."""
    rng = np.random.default_rng(2)
    c = rng.integers(-(2**62), 2**62, (kinds, 2))[rng.integers(0, kinds, n)] ^ (1 << rng.integers(0, 12, (n, 2)))
    rows = [(int(i) * 3, [int(x) for x in w], None if i % 11 == 0 else "b" if i % 5 == 0 else "a") for i, w in enumerate(c)]
    return spark.createDataFrame(rows, "idx long, code array<long>, label string").repartition(3), {i: (w, k) for i, w, k in rows}


def far(x, y):
    return sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(x, y))


def near(rows, radius):
    return {(a, b, far(rows[a][0], rows[b][0])) for a in rows for b in rows if a < b and far(rows[a][0], rows[b][0]) <= radius}


def test_nearest_pairs_leave_a_tile_k_a_record(spark):
    df, rows = coded(spark)
    by = {}
    for a, b, d in sorted(near(rows, 60), key=lambda x: (x[0], x[2], x[1])):
        by.setdefault(a, []).append((a, b, d))
    want = {x for v in by.values() for x in v[:3]}
    assert {tuple(r) for r in retrieve.nearest_pairs(df, 60, 3, block=64).collect()} == want and len(want) < len(near(rows, 60)) / 4
    b = retrieve.Blocks(df, "idx", "code", "hamming", 64, None)
    assert retrieve._nearest(b, b, 3, "hamming", after=True, within=60).groupBy("query").count().agg(F.max("count")).first()[0] <= 3 * b.n


def test_pairs_within_a_label_are_tested_in_the_tile(spark):
    df, rows = coded(spark)
    want = {(a, b) for a, b, _ in near(rows, 64) if rows[a][1] is not None and rows[a][1] == rows[b][1]}
    got = retrieve.near_pairs(df, 64, block=64, within="label").select("a", "b")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    groups = df.select(F.col("idx").alias("id"), F.col("label").alias("component"))
    assert {tuple(r) for r in graph.within_groups(retrieve.near_pairs(df, 64, block=64), groups).collect()} == want


@pytest.mark.parametrize("words", [2, 4, 8])
def test_wide_codes_have_the_neighbours_of_plain_loops(spark, words):
    rng = np.random.default_rng(words)
    c = rng.integers(-(2**62), 2**62, (12, words))[rng.integers(0, 12, 90)] ^ (1 << rng.integers(0, 6, (90, words)))
    df = spark.createDataFrame([(i, [int(x) for x in w]) for i, w in enumerate(c)], "idx long, code array<long>")
    got = retrieve.knn(df, df, 4, "code", "hamming", block=16)
    want = {(i, j, d, n + 1) for i in range(90) for n, (d, j) in enumerate(sorted((far(map(int, c[i]), map(int, c[j])), j) for j in range(90) if j != i)[:4])}
    assert {(r.query, r.idx, int(r.score), r.rank) for r in got.collect()} == want


#: Queries whose blocks meet in tiles: none has a join of all with all in its plan.
TILED = ["near_pairs_capped", "constrained_edges", "width_sweep", "cosine_pairs", "knn_hamming", "mutual_knn_pairs", "recall_in_other_books", "near_pairs", "recall_by_label", "knn_cosine", "recall_hamming", "first_hit_ranks", "neighbours_in_other_books", "same_author_control"]


@pytest.mark.parametrize("name", TILED)
def test_no_join_of_blocks_with_blocks(spark, sf, name):
    from lodestrand.plans import registry

    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["cluster_purity", "code_components", "knn_components"])
def test_no_join_of_blocks_with_blocks_before_components(spark, sf, name, monkeypatch):
    from lodestrand.plans import registry

    seen, components = [], graph.components
    monkeypatch.setattr(graph, "components", lambda e, *a: (seen.append(e._jdf.queryExecution().executedPlan().toString()), components(e, *a))[1])
    registry.queries()[name](spark, sf)
    assert len(seen) == 1 and "Cartesian" not in seen[0] and "NestedLoop" not in seen[0]


def test_pairs_of_one_label_are_spread(spark):
    rows = [(i, None if i % 9 == 0 else "few" if i % 20 == 1 else "hot") for i in range(400)]
    df = spark.createDataFrame(rows, "idx long, label string")
    got = graph.same_label_pairs(df, chunk=20, each=2000)
    want = [(i, j) for i, k in rows for j, m in rows if i < j and k == m and k is not None]
    assert sorted(tuple(r) for r in got.collect()) == want
    most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < len(want) / 8


def test_a_tile_is_a_task_of_its_own(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((30, 8)).astype(np.float32)[rng.integers(0, 30, 300)]
    v[5] = 0
    df = spark.createDataFrame([(i, [float(x) for x in w]) for i, w in enumerate(v)], "idx long, vec array<float>")
    n = np.linalg.norm(v.astype(float), axis=1)
    cos = np.divide(v.astype(float) @ v.T.astype(float), np.outer(n, n), out=np.zeros((300, 300)), where=np.outer(n, n) > 0)
    got = retrieve.cosine_pairs(df, 0.4, block=32)
    assert {(r.a, r.b) for r in got.collect()} == {(i, j) for i in range(300) for j in range(i + 1, 300) if cos[i, j] >= 0.4}
    b = retrieve.Blocks(df, "idx", "vec", "cosine", 32, None)
    held = retrieve._tiles(b, b, lambda x, y: iter([([sum(len(d) for _, _, d in x + y)],)]), "rows long", False, half=True).collect()
    assert len(held) >= 36 and max(r.rows for r in held) <= 2 * -(-b.n // 8) * 64
    assert held and got.rdd.getNumPartitions() == len(held)


def test_links_join_what_pairs_join(spark):
    df, rows = coded(spark, 240, 12)
    for radius in (2, 8, 50):
        links = retrieve.near_links(df, radius, block=64)
        want, got = ({r.id: r.component for r in graph.components(e).collect()} for e in (retrieve.near_pairs(df, radius, block=64), links))
        assert got == want
    n = retrieve.Blocks(df, "idx", "code", "hamming", 64, None).n
    assert retrieve.near_links(df, 128, block=64).count() <= len(rows) * (n + 1) < len(near(rows, 128)) / 4


def test_documents_of_a_token_are_not_sent_by_token(spark):
    rng = np.random.default_rng(4)
    docs = [(int(i) // 2, " ".join(f"w{chr(97 + x)}" for x in rng.integers(0, 9, 12))) for i in range(40)]  # two rows an id
    items = [(i, " ".join(f"w{chr(97 + x)}" for x in rng.integers(0, 12, 6))) for i in range(7)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (9, "nothing like it")], "item_id long, text string")
    count = {}
    for side, rows in (("d", docs), ("i", items)):
        for i, t in rows:
            for w in t.split():
                count.setdefault((side, i), {}).setdefault(w, 0)
                count[side, i][w] += 1
    want = {}
    for i in {i for i, _ in docs}:
        for j, _ in items:
            x, y = count["d", i], count["i", j]
            if common := sum(min(n, y.get(w, 0)) for w, n in x.items()):
                want[i, j] = common / (sum(x.values()) + sum(y.values()) - common)
    words = F.regexp_extract_all("text", F.lit("([a-z]+)"), F.lit(1))
    for most in (200_000, 1):  # items whose lists are broadcast, and too many to be
        got = evaluate.text_jaccard(d.withColumnRenamed("doc_id", "a"), b.withColumnRenamed("item_id", "b"), words, each=10, max_rows=most)
        assert {(r.a, r.b): r.jaccard for r in got.collect()} == pytest.approx(want)
        plan = got._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[2]
        assert (plan.count("Exchange hashpartitioning") == 1) == (most > 1)


def test_texts_are_embedded_once(spark):
    from lodestrand.functions import raw
    from lodestrand.operators import models

    texts = ["", "abc", "abcd", "ships at sea", "é’x weather", "a" * 300, "xyz", "bcda"]
    assert [list(v) for v in raw.hash_embeddings(texts, 16)] == [list(raw.hash_embedding(t, 16)) for t in texts]
    assert raw.hash_embeddings(["ab", "cd", "ef"], 8).any() == False  # noqa: E712
    seen = spark.sparkContext.accumulator(0)

    class Counting(models.HashEmbedder):
        def embed_batch(self, part):
            seen.add(len(part))
            return super().embed_batch(part)

    rows = [("b" if i % 3 else "a", i, 0, 60, bytearray(t.encode()), t) for i, t in enumerate(f"number {j} of the texts" for j in range(50))]
    paras = spark.createDataFrame(rows, "path string, para long, off long, len long, bytes binary, text string").repartition(3)
    records, side, _ = models.semantic_records(paras, Counting(16))
    got = {r.para: (r.idx, r.vec) for r in side.join(records, "idx").collect()}
    assert seen.value == len(rows)
    order = sorted(range(50), key=lambda i: ("b" if i % 3 else "a", i))
    assert {i: got[i][0] for i in range(50)} == {i: n for n, i in enumerate(order)}
    assert all(got[i][1] == list(map(float, raw.hash_embedding(rows[i][5], 16))) for i in range(50))
