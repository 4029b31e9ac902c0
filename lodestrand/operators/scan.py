"""Scans over records: by similarity, time and category, whole or over a range of indices; lookups and neighbourhoods.

A record's index is a column, `idx`; results are in its order and may be cut by a limit, as a scan's are.
Scans are filters: they prune columns, push down what Parquet can test, and shuffle nothing but an ordered limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import hamming

DEFAULT_SHARE, NEAR = 0.35, 256


def threshold(bits: int = 128, share: float = DEFAULT_SHARE) -> int:
    return int(bits * share)


def checked_threshold(n: int) -> int:
    if not 0 <= n <= 512:
        raise ValueError(f"a threshold of {n} bits")
    return n


def in_range(lo: int | None = None, hi: int | None = None) -> Column:
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (F.col("idx") >= lo)
    if hi is not None:
        ok = ok & (F.col("idx") < hi)
    return ok


def _scan(records: DataFrame, test: Column, lo: int | None, hi: int | None, limit: int | None) -> DataFrame:
    found = records.filter(in_range(lo, hi) & test)
    return found if limit is None else found.orderBy("idx").limit(limit)


def similar(records: DataFrame, code: tuple[int, ...], radius: int, lo: int | None = None, hi: int | None = None, limit: int | None = None) -> DataFrame:
    """Records whose code (columns lsh0, lsh1, ...) differs from the given words in at most radius bits, with distance."""
    distance = hamming([F.col(f"lsh{i}") for i in range(len(code))], [F.lit(w).cast("long") for w in code])
    return _scan(records.withColumn("distance", distance), F.col("distance") <= radius, lo, hi, limit)


def time_range(records: DataFrame, start: object, end: object, column: str = "timestamp", lo: int | None = None, hi: int | None = None, limit: int | None = None) -> DataFrame:
    """Both ends count; none where start is after end."""
    return _scan(records, F.col(column).between(start, end), lo, hi, limit)


def category(records: DataFrame, value: object, column: str = "category", lo: int | None = None, hi: int | None = None, limit: int | None = None) -> DataFrame:
    return _scan(records, F.col(column) == value, lo, hi, limit)


def by_hash(records: DataFrame, digest: str) -> DataFrame:
    """The first record with this content hash."""
    return records.filter(F.col("hash") == digest.lower()).orderBy("idx").limit(1)


def neighbours(records: DataFrame, idx: int, radius: int, limit: int | None = None) -> DataFrame:
    """Records near record idx, itself among them. Its code is one row, joined as such."""
    words = [c for c in records.columns if c.startswith("lsh")]
    one = records.filter(F.col("idx") == idx).limit(1).select(*[F.col(w).alias(f"q_{w}") for w in words])
    near = records.join(F.broadcast(one), hamming([F.col(w) for w in words], [F.col(f"q_{w}") for w in words]) <= radius)
    near = near.withColumn("distance", hamming([F.col(w) for w in words], [F.col(f"q_{w}") for w in words])).drop(*one.columns)
    return near if limit is None else near.orderBy("idx").limit(limit)


def neighbourhood(records: DataFrame, digest: str, radius: int, most: int = NEAR) -> DataFrame:
    """What a record's neighbourhood shows: the first `most` by index, without itself, one for each content hash."""
    if len(digest) != 64 or set(digest.lower()) - set("0123456789abcdef"):
        raise ValueError("a neighbourhood is named by 64 hex digits")
    first = by_hash(records, digest).select("idx").first()
    if first is None:
        raise KeyError(digest)
    near = neighbours(records, first[0], radius, most).filter(F.col("idx") != first[0])
    one = F.row_number().over(Window.partitionBy("hash").orderBy("idx"))
    return near.withColumn("_n", one).filter("_n = 1").drop("_n").orderBy("idx")


def nearest(records: DataFrame, code: tuple[int, ...], count: int) -> DataFrame:
    """The `count` records of least distance, ties by index: not the first within a radius."""
    distance = hamming([F.col(f"lsh{i}") for i in range(len(code))], [F.lit(w).cast("long") for w in code])
    return records.withColumn("distance", distance).orderBy("distance", "idx").limit(count)
