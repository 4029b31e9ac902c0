"""What a Python worker holds: a bounded part of the texts and words while scoring, no tokenizer and no workers without a use."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyspark
import pytest
import tokenizers
from pyspark.sql import functions as F
from test_fixtures import ids

from lodestrand.llm import packing, toxicity
from lodestrand.llm.common import running


def test_scoring_holds_a_bounded_part_of_the_texts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    letters = rng.choice(list("aeioustrnlm"), (250_000, 7))
    vocab = np.array(["".join(w) for w in letters])
    texts = [" ".join(vocab[rng.integers(0, len(vocab), 330)]) for _ in range(1500)]
    model = toxicity.train([("good nice fine " * 20) + "vilwort", "good nice fine " * 20] * 20, [1, 0] * 20, epochs=2, steps=2)
    tasks = []
    monkeypatch.setattr(toxicity, "sample_rows", lambda *_: ([], []))
    monkeypatch.setattr(toxicity, "train", lambda *_, **__: model)
    monkeypatch.setattr(toxicity, "arrow_map", lambda df, f, _: tasks.append(f) or df)
    toxicity.score(spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.range(1))
    batch = pa.record_batch({"doc_id": np.arange(1500), "held_out": np.zeros(1500, bool), "text": texts})
    tracemalloc.start()
    try:
        got = np.concatenate([b.column("score").to_numpy() for b in tasks[0](iter([batch, batch]))])
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    at = [0, 700, 1499]
    assert len(got) == 3000 and (got[:1500] == got[1500:]).all() and np.allclose(got[at], [model.score(model.look_up([texts[i]]))[0] for i in at], atol=1e-6)
    assert peak < 110, peak


def test_words_that_are_used_again_are_kept():
    m = toxicity.train([("good nice fine " * 20) + "vilwort", "good nice fine " * 20] * 20, [1, 0] * 20, epochs=2, steps=2)
    texts = [" ".join(["nice", "vilwort", "fine", *(f"w{i}x{k}" for k in range(50))]) for i in range(40)]
    plain = toxicity.Model(m.p, m.width)
    for i, t in enumerate(texts):
        assert np.allclose(m.score(m.look_up([t, t[:30]])), plain.score(plain.look_up([t, t[:30]])), atol=1e-6)
        m.forget(120)
        assert len(m.ids) <= 120 and len(m.rows) > len(m.ids)
    assert {"nice", "vilwort", "fine"} <= set(m.ids) and len(plain.ids) > 2000
    m.forget(0)
    assert not m.ids and m.score(m.look_up([texts[0]])) == plain.score(plain.look_up([texts[0]]))


def test_tokenizer_is_loaded_for_special_tokens_alone(monkeypatch):
    loaded, plain = [], tokenizers.Tokenizer

    class Counted:
        @staticmethod
        def from_file(at):
            loaded.append(at)
            return plain.from_file(at)

    monkeypatch.setattr(packing, "_ENCODER", {})
    monkeypatch.setattr(packing, "_CACHES", [])
    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    encode = packing.encoder()
    read = lambda t: [*np.frombuffer(encode(t), "<u4"), 1]
    plainly, special = ("", "some words", "two  spaces"), ("a <|endoftext|> b", "<|endoftext|>")
    got = [read(t) for t in plainly]
    assert not loaded
    got += [read(t) for t in special]
    assert len(loaded) == 1 and got == [ids(t) for t in plainly + special]


@pytest.mark.parametrize("rows", [0, 300])
def test_running_sums_start_no_workers_for_rows(spark, monkeypatch, rows):
    df = spark.range(rows).select((F.col("id") * 7 % 301).alias("k"), F.col("id"), (F.col("id") / 4).alias("x")).repartition(3)
    want, n, a, b = [], 0, 0, 0.0
    for k, i in sorted((i * 7 % 301, i) for i in range(rows)):
        want.append((k, i, i / 4, n, a, b))
        n, a, b = n + 1, a + i, b + i / 4
    monkeypatch.setattr(pyspark.SparkContext, "parallelize", lambda *_: pytest.fail("rows went through an RDD"))
    out, total = running(df, ["k"], "id", "x")
    assert sorted(map(tuple, out.collect())) == want and total == [n, a, b]
    assert [t for _, t in out.dtypes] == ["bigint", "bigint", "double", "bigint", "bigint", "double"]
