"""What op6 sends grows as the table: no key is repeated for salts, texts are sent only where wanted, a cluster has few groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_fixtures import brute

from lodestrand.llm import jaccard


def variants(rng, count: int, length: int, edits: int) -> list[str]:
    """Edited copies of one text; edits are of few words, so that some copies have an edit in common."""
    base = [f"w{i}" for i in range(length)]
    out = []
    for _ in range(count):
        u = list(base)
        for i in rng.integers(0, length, edits):
            u[i] = f"e{rng.integers(0, 3)}"
        out.append(" ".join(u))
    return out


@pytest.fixture
def cuts(monkeypatch):
    """The tables that are written between steps, by their columns, and their plans."""
    seen, plain = [], jaccard.cut

    def cut(df):
        out = plain(df)
        seen.append((tuple(df.columns), df._jdf.queryExecution().optimizedPlan().toString(), out))
        return out

    monkeypatch.setattr(jaccard, "cut", cut)
    return seen


def test_joins_beyond_a_broadcast_repeat_no_rows(spark, cuts):
    rng = np.random.default_rng(5)
    texts = [*variants(rng, 12, 120, 2), *variants(rng, 9, 60, 1), *[" ".join(f"x{j}" for j in rng.integers(0, 5000, 40)) for _ in range(60)], *["some text that is there again and again"] * 30]
    out = jaccard.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), max_broadcast=1)
    got = {r.doc_id: (r.n_shingles, r.n_similar, r.component_id) for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    assert not [c for c, plan, _ in cuts if "salt" in plan]
    assert "salt" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_hot_keys_are_joined_apart(spark):
    big = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2, 3, 4] + [5] * 9)], "k long, i long")
    small = spark.createDataFrame([(1, "a", 50), (2, "b", 1), (5, "c", 9)], "k long, v string, rows long")
    want = {(k, i): {1: "a", 2: "b", 5: "c"}.get(k) for k, i in big.collect()}
    for most, hot in ((10, 5), (1, 5), (1, 100), (1, 0)):
        assert {(r.k, r.i): r.v for r in jaccard._join(big, small, ["k"], "left", most, hot).collect()} == want
        assert {(r.k, r.i): r.v for r in jaccard._join(big, small, ["k"], "inner", most, hot).collect()} == {x: v for x, v in want.items() if v}


def test_only_wanted_texts_are_sent(spark):
    src = spark.createDataFrame([(i, f"t{i}") for i in range(-500, 500)] + [(None, "none")], "doc_id long, text string")
    wanted = spark.range(-3, 497, 50).select(F.col("id").alias("doc_id"), F.lit(1).alias("copies"), F.array(F.struct(F.lit(1).alias("g1"))).alias("at"))
    texts = jaccard._texts(src, wanted, 1)
    assert {(r.doc_id, r.text) for r in texts.collect()} == {(i, f"t{i}") for i in range(-3, 497, 50)}
    sent = jaccard._passing(src, jaccard._bloom(wanted))
    assert 10 <= sent.count() < 20 and sent.count() + jaccard._passing(src, jaccard._bloom(wanted), False).count() == src.count()


@pytest.mark.parametrize("most", [1000, 1])
def test_documents_are_split_by_ids(spark, most):
    """Rows of one id go together, null ids with the rest; the pipeline's stage of near copies sends no text that no id may be of."""
    rows = [*[(i, f"t{i}") for i in range(300)], (7, "again"), (8, "again"), (None, "none")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").select("text", "doc_id")
    found, rest = jaccard.split(docs, spark.range(0, 100, 7).select(F.col("id").cast("int").alias("doc_id")), most)
    assert found.columns == rest.columns == docs.columns
    inside = lambda i: i is not None and i < 100 and i % 7 == 0
    key = lambda r: (r[1] is None, r[1], r[0])
    assert sorted(map(tuple, found.collect()), key=key) == sorted([(t, i) for i, t in rows if inside(i)], key=key)
    assert sorted(map(tuple, rest.collect()), key=key) == sorted([(t, i) for i, t in rows if not inside(i)], key=key)
    assert "salt" not in rest._jdf.queryExecution().optimizedPlan().toString()


def test_a_cluster_has_few_pairs_of_groups(spark, cuts):
    texts = variants(np.random.default_rng(2), 240, 150, 3)
    out = jaccard.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    got = {r.doc_id: (r.n_shingles, r.n_similar, r.component_id) for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    pairs = next(t for c, _, t in cuts if c == ("g1", "g2"))
    assert pairs.count() < len(texts) / 4
