"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, join_small, shared_dir, ship  # noqa: F401


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


#: Called when a task of arrow_map ends: Python workers live on, and what an operator kept would be there in the next one's.
AT_END: list[Callable[[], None]] = []
#: Rows of an Arrow batch where the session names no number: documents are long.
BATCH_ROWS = 1500


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, with the package shipped to the workers first; memory is given back when a task ends."""
    spark = df.sparkSession
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # the default
        spark.conf.set(name, BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def release() -> None:
    for end in AT_END:
        end()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def hash_sample(df: DataFrame, most: int, *key: str) -> DataFrame:
    """At most `most` rows, those of least hash of the key: the same ones however the rows are spread.

    Rows are thinned by a bound on the hash first (to about twice as many), so that what tasks send on doesn't
    grow with the table.
    """
    n = df.count()
    h = F.xxhash64(*key)
    if n > 2 * most:
        df = df.filter(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * 2 * most / n))
    return df.orderBy(F.pmod(h, F.lit(1 << 40)), *key).limit(most)


def quantiles(df: DataFrame, name: str, rows: int, most: int = 100_000, each: int = 16) -> list:
    """Values that cut df into ranges of about `rows` rows, `most` ranges at most, whatever gaps the values have.

    They are quantiles of distinct values, those of least hash, `each` a range: they decide about balance alone, never
    about results. Null values have no part.
    """
    src = df.select(name).filter(F.col(name).isNotNull())
    n = src.count()
    parts = min(most, -(-n // rows))
    if parts < 2:
        return []
    wanted, h = parts * each, F.pmod(F.xxhash64(name), F.lit(1 << 40))
    seen = sorted(r[0] for r in src.filter(h < int((1 << 40) * min(1.0, 2 * wanted / n))).distinct().orderBy(h, name).limit(2 * wanted).collect())
    return sorted({seen[i * len(seen) // parts] for i in range(1, parts)}) if seen else []


def running(df: DataFrame, order: list[str], *sums: str) -> tuple[DataFrame, list]:
    """df with idx, its place in an order, and before_x, the sum of each column x (long or double) in the rows before; and the whole sums.

    Sorted over ranges; what is gathered is a row for each range, so that no task or window holds the table.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    per = sorted(tuple(r) for r in ranged.groupBy("_p").agg(F.count("*"), *[F.sum(c) for c in sums]).collect())
    kinds = ["long", *[dict(df.dtypes)[c] for c in sums]]
    starts, total = [], [0.0 if k == "double" else 0 for k in kinds]
    for p, *own in per:
        starts.append((p, *total))
        total = [a + b for a, b in zip(total, own)]
    names = ["idx", *[f"before_{c}" for c in sums]]
    # from Arrow: a list of rows would go through an RDD, whose Python workers stay beside the SQL ones
    types = {"_p": pa.int32()} | {f"_{n}": pa.float64() if k == "double" else pa.int64() for n, k in zip(names, kinds)}
    offsets = df.sparkSession.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(zip(*starts) if starts else [()] * len(types), types.values())], names=[*types]))
    up = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = {"idx": F.count("*").over(up) - 1} | {f"before_{c}": F.sum(c).over(up) - F.col(c) for c in sums}
    out = ranged.withColumns(own).join(F.broadcast(offsets), "_p")
    return out.withColumns({n: (F.col(n) + F.col(f"_{n}")).cast(k) for n, k in zip(names, kinds)}).select(*df.columns, *names), total


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of the text column (one row at least), to bound memory."""
    for b in batches:
        col = b.column(text)
        if b.nbytes <= most or b.num_rows <= 1:
            if b.num_rows:
                yield b
            continue
        sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield b.slice(start)
