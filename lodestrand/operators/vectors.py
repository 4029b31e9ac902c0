"""Vector arithmetic in built-in functions, pooling, the vector cache and sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero, null where either is null."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def normalised(a: Column, least: float = 1e-12) -> Column:
    """Of length one; vectors under `least` as they are."""
    n = norm(a)
    return F.when(n < least, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def mean_pool(vectors: DataFrame, by: list[str], value: str = "vec", renorm: bool = True) -> DataFrame:
    """by, vec: the mean of each group's vectors, of length one. Sums are combined before the shuffle, one row a place."""
    parts = vectors.select(*by, F.posexplode(value).alias("i", "x")).groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    pooled = parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias(value))
    return pooled.withColumn(value, normalised(F.col(value))) if renorm else pooled


POOLS = ("mean", "cls", "max", "last", "concat", "weighted")


def pool(tokens: Column, mode: str, renorm: bool = True) -> Column:
    """One vector of an array of token vectors: mean, first, greatest, last, first and last together, or mean weighted by place."""
    place = lambda f: F.transform(F.sequence(F.lit(0), F.size(F.element_at(tokens, 1)) - 1), f)
    total = lambda i, w: F.aggregate(F.transform(tokens, lambda t, k: F.get(t, i).cast("double") * w(k)), F.lit(0.0), lambda s, x: s + x)
    n = F.size(tokens)
    doubles = lambda v: v.cast("array<double>")
    mean = place(lambda i: total(i, lambda k: F.lit(1.0)) / n)
    made = {
        "mean": lambda: mean, "cls": lambda: doubles(F.element_at(tokens, 1)), "last": lambda: doubles(F.element_at(tokens, -1)), "max": lambda: place(lambda i: F.array_max(F.transform(tokens, lambda t: F.get(t, i).cast("double")))),
        "concat": lambda: F.concat(doubles(F.element_at(tokens, 1)), doubles(F.element_at(tokens, -1))), "weighted": lambda: place(lambda i: total(i, lambda k: (k + 1).cast("double")) / (n * (n + 1) / 2)),
    }[mode]()
    return normalised(made) if renorm else made


def document_scores(paragraphs: DataFrame, query: Column, by: str = "doc_id") -> DataFrame:
    """Per document: cosine of the query with the mean of its paragraphs, and the greatest of theirs."""
    best = paragraphs.groupBy(by).agg(F.max(cosine(F.col("vec"), query)).alias("max_paragraph"))
    return mean_pool(paragraphs, [by]).select(by, cosine(F.col("vec"), query).alias("average")).join(best, by)


def cached(texts: DataFrame, cache: DataFrame, model: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(rows with a vector of this model and dimension in the cache or null, rows still to embed), by hash."""
    usable = cache.filter((F.col("model") == model) & (F.size("vec") == dim)).select("hash", "vec")
    first = usable.groupBy("hash").agg(F.first("vec").alias("vec"))
    return texts.join(first, "hash", "left"), texts.join(first, "hash", "left_anti")


def cache_counts(joined: DataFrame) -> DataFrame:
    return joined.agg(F.count_if(F.col("vec").isNotNull()).alias("hits"), F.count_if(F.col("vec").isNull()).alias("misses"))


def first_in_cache(lines: DataFrame) -> DataFrame:
    """Of lines (hash, model, dim, vec, line), the first for each key."""
    w = Window.partitionBy("hash", "model", "dim").orderBy("line")
    return lines.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
