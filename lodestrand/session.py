"""Session helpers: a local session for tests, shared-folder checkpoints, shipping this package to executors."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import io
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with UTC, AQE and few shuffle partitions; for tests and benches."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("lodestrand")
    base = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, on one machine (tests) a folder of our own, on a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lodestrand-")
        atexit.register(shutil.rmtree, at, True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and go on from the files; survives lost executors."""
    sc = df.sparkSession.sparkContext
    at = shared_dir(df.sparkSession)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(Path(root.name) / p.relative_to(root))), p.read_bytes())
    at = tempfile.mkdtemp(prefix="lodestrand-zip-")
    atexit.register(shutil.rmtree, at, True)
    path = os.path.join(at, "lodestrand.zip")
    Path(path).write_bytes(buf.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def trim() -> None:
    """Give memory back at the end of a task: Python workers live on, idle, beside those of the next step."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", max_rows: int = 200_000, salts: int = 64, max_bytes: int = 64 << 20) -> DataFrame:
    """Join a table with one row per key: broadcast when it is found to have at most max_rows and max_bytes, else salted.

    Rows and their bytes are counted first, so a broadcast never exceeds the bounds. Beyond it, rows of the big side
    get one of `salts` numbers and the small side is repeated for each, so a hot key spreads over
    `salts` partitions. Only 'left' and 'inner' are offered: the others would repeat unmatched rows.
    """
    from pyspark.sql import functions as F

    if how not in ("left", "inner"):
        raise ValueError(how)
    size = F.lit(8 * len(small.columns)).cast("long")
    for name, kind in small.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0))
    rows, width = small.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if rows <= max_rows and width <= max_bytes:
        return big.join(F.broadcast(small), on, how)
    salt = "__salt"
    big = big.withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in big.columns[:4]]), F.lit(salts)))
    small = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return big.join(small, [*on, salt], how).drop(salt)
