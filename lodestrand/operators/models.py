"""Where models come in: embedders, judges, theme generators and summarisers are callables that the caller brings.

Nothing falls back silently: an embedder that fails, or gives vectors of another length, fails the job. The stubs
here are deterministic and for tests.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes, raw
from ..functions import text as X
from ..session import cut
from ..sources import store


class Embedder(Protocol):
    name: str
    dim: int

    def embed_batch(self, texts: list[str]) -> list: ...


class HashEmbedder:
    """Vectors by hashed bytes: the same for the same text, without meaning."""

    def __init__(self, dim: int = 64):
        self.name, self.dim = f"hash-{dim}", dim

    def embed_batch(self, texts: list[str]) -> list:
        return list(raw.hash_embeddings(texts, self.dim))


def embedded(texts: Column, embedder: Embedder, batch: int = 128) -> Column:
    """array<float> of the embedder's dimension for each text."""

    def checked(part: list[str]) -> list:
        got = embedder.embed_batch(part)
        if any(len(v) != embedder.dim for v in got):
            raise ValueError(f"{embedder.name} gave vectors of another length than {embedder.dim}")
        return got

    return raw.embed_udf(checked, batch)(texts)


def semantic_records(paragraphs: DataFrame, embedder: Embedder, seed: int = codes.SEED) -> tuple[DataFrame, DataFrame, dict]:
    """(records, sidecar vectors by idx, parameters) of paragraphs with text, off, len and bytes."""
    # written at once: the ranges of the order, the codes and the sidecar would each embed all texts again
    withvec = cut(paragraphs.withColumn("vec", embedded(F.col("text"), embedder)))
    coded = withvec.withColumn("code", codes.simhash(F.col("vec"), embedder.dim, seed=seed))
    both = store.records(coded, F.col("code"), keep=("vec",))
    return both.drop("vec"), both.select("idx", "vec"), store.params(embedder.name, embedder.dim, seed=seed)


def fill_cache(texts: DataFrame, cache: DataFrame, embedder: Embedder) -> DataFrame:
    """texts(hash, text) with vec: from the cache where it has one, else embedded, once for each hash."""
    from .vectors import cached

    known, missing = cached(texts, cache, embedder.name, embedder.dim)
    fresh = missing.dropDuplicates(["hash"]).select("hash", embedded(F.col("text"), embedder).alias("fresh"))
    return known.join(fresh, "hash", "left").select(*texts.columns, F.coalesce("vec", "fresh").alias("vec"))


def keyword_judge(least: int = 2) -> Callable[[Column, Column], Column]:
    """A stub of a judge: the long words that two texts share, or null where they are fewer than `least`."""

    def judge(a: Column, b: Column) -> Column:
        words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"([a-z]{6,})"), F.lit(1)))
        shared = F.array_sort(X.clean_subjects(F.array_intersect(words(a), words(b))))
        return F.when(F.size(shared) >= least, shared)

    return judge


def answering_judge(ask: Callable[[str, str], str]) -> Callable[[Column, Column], Column]:
    """A judge from a model that answers in text with a SHARED line."""

    @F.pandas_udf("string")
    def answers(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ask(x, y) for x, y in zip(a, b)])

    return lambda a, b: X.shared_subjects(answers(a, b))


def generated_themes(groups: DataFrame, generate: Callable[[list[str]], str], least: int = 2, batch: int = 60) -> DataFrame:
    """(name, subjects) of the themes that a model names for batches of subjects, largest groups first.

    The subjects are numbered in order and sent on in batches; each batch is one call, in a task of its own.
    """
    live = groups.filter(F.size("members") >= least).select("subject", F.size("members").alias("n"))
    placed = store.with_index(live.withColumn("down", -F.col("n")), ["down", "subject"])
    batches = placed.groupBy(F.floor(F.col("idx") / batch).alias("b")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "subject"))), lambda s: s["subject"]).alias("subjects"))

    @F.pandas_udf("string")
    def answers(lists: pd.Series) -> pd.Series:
        return pd.Series([generate([str(s) for s in np.asarray(x)]) for x in lists])

    return batches.select(F.explode(X.theme_lines(answers("subjects"))).alias("t")).select("t.name", "t.subjects")


def summarised(texts: Column, summarise: Callable[[str], str]) -> Column:
    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else summarise(x))

    return run(texts)


def where(records: DataFrame, test: Callable[[pd.DataFrame], pd.Series], columns: list[str]) -> DataFrame:
    """Records for which a function of some of their columns, batch by batch, says so: a scan by the caller's predicate."""

    @F.pandas_udf("boolean")
    def passes(part: pd.DataFrame) -> pd.Series:
        return test(part)

    return records.filter(passes(F.struct(*columns)))
