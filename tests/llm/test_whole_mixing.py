"""Targets of many sources against resharing, running sums, and independent draws."""

import numpy as np
import pytest

from lodestrand.llm import common, mixing
from test_fixtures import water


def test_targets_of_many_sources(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 300):
        names = [None, *[f"s{i}é" for i in range(n - 1)]]
        sizes = {s: int(x) for s, x in zip(names, rng.lognormal(3, 2, n).astype(int))}
        df = spark.createDataFrame([(s, k, 1) for s, k in sizes.items()], "source string, source_size long, n_docs long").repartition(3)
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(water(sizes))
    assert mixing.source_targets(df.limit(0)).count() == 0


def test_running_sums(spark):
    rows = [(int(x), i, float(i % 5)) for i, x in enumerate(np.random.default_rng(1).integers(0, 9, 200))]
    got, total = common.running(spark.createDataFrame(rows, "a int, b long, c double").repartition(5), ["a", "b"], "b", "c")
    want, at = {}, [0, 0.0]
    for k, (a, b, c) in enumerate(sorted(rows)):
        want[b] = (k, *at)
        at = [at[0] + b, at[1] + c]
    assert {r.b: (r.idx, r.before_b, r.before_c) for r in got.collect()} == want and total == [200, *at]


def test_copies_follow_their_expectation(spark):
    """Over many seeds a document's copies are those its rate asks for, and draws of levels differ."""
    rows = [(i, "w " * int(3 + i % 7), "a" if i < 30 else "b") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = df.withColumn("size", mixing.n_words(df["text"]))
    draws = np.array([tuple(r) for r in sized.select(*[mixing._chance(17, k) for k in (0, 1)]).collect()])
    assert abs(np.corrcoef(draws.T)[0, 1]) < 0.4 and draws.min() > 0 and draws.max() < 1
