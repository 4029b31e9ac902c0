"""Stores of records, sidecars and vector caches as Parquet with a parameters file that guards them."""

from __future__ import annotations

import json
import time
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codes

SCHEMA = T.StructType([T.StructField(n, t()) for n, t in (("idx", T.LongType), ("path", T.StringType), ("para", T.LongType), ("off", T.LongType), ("len", T.LongType), ("hash", T.StringType), ("algo", T.StringType), ("lsh0", T.LongType), ("lsh1", T.LongType), ("timestamp", T.LongType), ("category", T.IntegerType), ("trits", T.IntegerType), ("cluster", T.LongType))])
GUARDED = ("model", "dim", "bits", "seed")


class Mismatch(ValueError):
    """A store, sidecar or cache that was made with other parameters."""


def params(model: str = "shingles", dim: int = 0, bits: int = codes.BITS, seed: int = codes.SEED, **more: object) -> dict:
    return {"model": model, "dim": dim, "bits": bits, "seed": seed} | more


def check(found: dict, wanted: dict, keys: tuple[str, ...] = GUARDED) -> None:
    for k in keys:
        if found.get(k) != wanted.get(k):
            raise Mismatch(f"{k} is {found.get(k)!r}, not {wanted.get(k)!r}")


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Make `version` the current one: a small file is renamed over the one before, which is one step of the file system."""
    jvm, hadoop = spark._jvm, spark._jvm.org.apache.hadoop.fs
    fs, _ = _fs(spark, path)
    temp = hadoop.Path(f"{path}/CURRENT.{version}.tmp")
    out = fs.create(temp, True)
    out.write(version.encode())
    out.close()
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    base = fs.makeQualified(hadoop.Path(path))
    hadoop.FileContext.getFileContext(base.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(temp), hadoop.Path(base, "CURRENT"), how)


def save(df: DataFrame, path: str, about: dict) -> None:
    """Write a new version, parameters last, then let the store's pointer name it.

    A reader, or a writer that stops halfway, finds the whole store or the whole one before. The version before stays for
    readers that have begun; older ones go.
    """
    spark, version = df.sparkSession, f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{path}/{version}/rows")
    spark.createDataFrame([(json.dumps(about),)], "params string").coalesce(1).write.text(f"{path}/{version}/params")
    before = current(spark, path)
    _point(spark, path, version)
    fs, p = _fs(spark, path)
    for x in fs.listStatus(p):
        name = x.getPath().getName()
        if x.isDirectory() and name.startswith("v") and name < (before or "") and name != version:
            fs.delete(x.getPath(), True)


def current(spark: SparkSession, path: str) -> str | None:
    """The store's current version; None where there is no store."""
    fs, p = _fs(spark, f"{path}/CURRENT")
    return spark.read.text(f"{path}/CURRENT").first()[0] if fs.exists(p) else None


def opened(spark: SparkSession, path: str, wanted: dict | None = None, keys: tuple[str, ...] = GUARDED) -> tuple[DataFrame, dict]:
    """(rows, parameters); refuses parameters other than wanted before any row is read."""
    version = current(spark, path)
    if version is None:
        raise FileNotFoundError(path)
    about = json.loads(spark.read.text(f"{path}/{version}/params").first()[0])
    if wanted is not None:
        check(about, wanted, keys)
    return spark.read.parquet(f"{path}/{version}/rows"), about


def records(paragraphs: DataFrame, code: Column | None = None, order: tuple[str, ...] = ("path", "para"), documents: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of paragraphs(path, para, off, len, bytes, ...): hash of the bytes, code (shingles by default), metadata.

    idx is the place in the order of path and para. documents: with a record (para 0) for each path. keep: further columns
    of paragraphs to stay behind the records' own.
    """
    from ..session import ship

    ship(paragraphs.sparkSession)
    rows = paragraphs
    if documents:
        whole = rows.groupBy("path").agg(F.min("off").alias("off"), F.max(F.col("off") + F.col("len")).alias("stop"), F.array_sort(F.collect_list(F.struct("para", "bytes"))).alias("x"))
        whole = whole.select("path", F.lit(0).cast("long").alias("para"), "off", (F.col("stop") - F.col("off")).alias("len"), F.encode(F.array_join(F.transform("x", lambda s: F.decode(s["bytes"], "ISO-8859-1")), "\n\n"), "ISO-8859-1").alias("bytes"))
        rows = rows.select("path", "para", "off", "len", "bytes").unionByName(whole)
    has = lambda c, kind, default=None: (F.col(c) if c in rows.columns else F.lit(default)).cast(kind).alias(c)
    rows = rows.withColumn("_c", codes.shingle_lsh(F.col("bytes")) if code is None else code)
    # a number in a total order without one task: rank within ranges, plus the ranges before
    made = rows.select("path", "para", "off", "len", codes.content_hash(F.col("bytes")).alias("hash"), F.lit("sha256").alias("algo"), F.get("_c", 0).alias("lsh0"), F.get("_c", 1).alias("lsh1"), has("timestamp", "long", 0), has("category", "int", 0), has("trits", "int"), has("cluster", "long", 0), *keep)
    return with_index(made, list(order)).select(*SCHEMA.names, *keep)


def with_index(df: DataFrame, order: list[str]) -> DataFrame:
    """df with idx, its place in the order, from 0."""
    from pyspark.sql import Window

    from ..session import cut

    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy("_p").count().collect())
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    starts = df.sparkSession.createDataFrame(before or [(0, 0)], "_p int, _b long")
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_r", rank).join(F.broadcast(starts), "_p").withColumn("idx", F.col("_b") + F.col("_r") - 1).drop("_p", "_r", "_b")


def save_sidecar(vectors: DataFrame, path: str, model: str, base_count: int) -> None:
    """vectors(idx, vec): refuses repeated indices and vectors of different lengths."""
    n, distinct, low, high = vectors.agg(F.count("*"), F.countDistinct("idx"), F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if n != distinct or low != high:
        raise Mismatch(f"{n} vectors of {low} to {high} values for {distinct} records")
    save(vectors.select("idx", "vec").sort("idx"), path, {"model": model, "dim": low or 0, "base_count": base_count})


def append_sidecar(vectors: DataFrame, path: str, model: str, base_count: int) -> None:
    """Add segments to a sidecar: indices must come after those it has. It is saved whole, for the store's new size."""
    spark = vectors.sparkSession
    if current(spark, path) is None:
        return save_sidecar(vectors, path, model, base_count)
    old, about = opened(spark, path, {"model": model}, ("model",))
    last, first = old.agg(F.max("idx")).first()[0], vectors.agg(F.min("idx")).first()[0]
    if last is not None and first is not None and first <= last:
        raise Mismatch(f"index {first} isn't after {last}")
    return save_sidecar(old.unionByName(vectors.select("idx", F.col("vec").cast("array<float>").alias("vec"))), path, model, base_count)


def open_sidecar(spark: SparkSession, path: str, base_count: int, model: str | None = None) -> DataFrame:
    """Refuses a sidecar of a store of another size, or of another model (where one is named)."""
    wanted = {"base_count": base_count} | ({"model": model} if model else {})
    return opened(spark, path, wanted, tuple(wanted))[0]


def build(spark: SparkSession, csv: str, path: str, embedder: object | None = None) -> dict:
    """A corpus table to a store at `path`, and with an embedder its vectors beside it: codes are then of the vectors.

    Returns the counts of texts kept, empty and short, and of records. An embedder that fails ends the job.
    """
    from ..operators.models import semantic_records
    from .files import corpus_csv

    rows, counts = corpus_csv(spark, csv)
    paras = rows.select(F.concat(F.lit("book/"), F.col("text_id").cast("string")).alias("path"), F.col("para").cast("long").alias("para"), F.lit(0).cast("long").alias("off"), F.octet_length("text").cast("long").alias("len"), F.encode("text", "UTF-8").alias("bytes"), "text", "timestamp")
    if embedder is None:
        made, about = records(paras), params()
    else:
        made, vectors, about = semantic_records(paras, embedder)
    save(made, path, about)
    kept = opened(spark, path, about)[0]
    if embedder is not None:
        save_sidecar(vectors, f"{path}.vectors", embedder.name, kept.count())
    return counts.first().asDict() | {"records": kept.count()}


def _halves(v: object) -> bytes:
    return np.asarray(v, "<f2").tobytes()


@F.pandas_udf(T.BinaryType())
def half_bytes(vec: pd.Series) -> pd.Series:
    """Vectors as half floats, least byte first."""
    return vec.map(lambda v: None if v is None else _halves(v))


def read_cache_lines(spark: SparkSession, path: str, model: str) -> DataFrame:
    """(hash, model, dim, vec, line) of a JSON Lines cache h, m, d, v (base64 of half floats): lines that are broken,
    of another model, or whose hash or vector has the wrong length are left out; of a key, the first line stays."""
    from ..operators.vectors import first_in_cache

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def halves(b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or len(x) % 2 else np.frombuffer(bytes(x), "<f2").astype(np.float32).tolist() for x in b], dtype=object)

    # files in the order of their names, lines in that of the files
    raw = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line"))
    j = raw.select("line", F.from_json("value", "h string, m string, d int, v string").alias("j")).select("line", "j.*")
    ok = j.filter((F.col("m") == model) & F.col("h").rlike("^[0-9a-fA-F]{64}$") & F.col("v").rlike("^[A-Za-z0-9+/]*={0,2}$") & (F.length("v") % 4 == 0))
    got = ok.select(F.lower("h").alias("hash"), F.col("m").alias("model"), F.col("d").alias("dim"), halves(F.unbase64("v")).alias("vec"), "line")
    return first_in_cache(got.filter(F.size("vec") == F.col("dim")))


def append_cache(vectors: DataFrame, path: str, model: str) -> None:
    """Append vectors(hash, vec) to a JSON Lines cache, a line each; readers take the first of a key.

    Each call's files are named by the time, so that later lines come after earlier ones.
    """
    line = F.to_json(F.struct(F.col("hash").alias("h"), F.lit(model).alias("m"), F.size("vec").alias("d"), F.base64(half_bytes("vec")).alias("v")))
    temp, spark = f"{path}/_{uuid.uuid4().hex}", vectors.sparkSession
    vectors.select(line.alias("value")).write.text(temp)
    fs, p = _fs(spark, temp)
    stamp, hadoop = f"{time.time_ns():020d}", spark._jvm.org.apache.hadoop.fs
    for x in sorted((x.getPath() for x in fs.listStatus(p)), key=lambda x: x.getName()):
        if x.getName().startswith("part-"):
            fs.rename(x, hadoop.Path(f"{path}/{stamp}-{x.getName()}"))
    fs.delete(p, True)


def save_manifest(rows: DataFrame, path: str) -> None:
    """The manifest is written whole each time."""
    save(rows, path, {"kind": "manifest"})


def open_manifest(spark: SparkSession, path: str) -> DataFrame:
    return opened(spark, path, {"kind": "manifest"}, ("kind",))[0]
