"""Deterministic sharded WARC writer and reader.

Records are sorted by page_id over ranges that quantiles of the ids give, so that gaps between ids don't matter and the
same rows make the same files on any cluster. A task writes its range into files rolled by compressed
size; headers (record id, date, lengths, block and payload digests) are made anew from the record,
never copied. Each file is written under a temporary name and renamed when whole; the list of files, with
their digests, is written last and renamed into place: a folder without that manifest was not
committed. Payloads that occur more than once are stored once, at the smallest page_id, and the others
are revisit records that refer to it.

Defined results: a null html is an empty payload; null page_ids sort first and are written without an id;
of equal payloads at the same page_id the first one written is the response; repeated rows are
records of their own; control characters of urls, which would end a header line, are percent-encoded, as are
signs in ids that are strings; an empty table commits an archive of no files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, join_small, quantiles, shared_dir, ship

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
FILES = "file string, records long, bytes long, sha256 string, first_id {id}, last_id {id}"


def opened(uri: str, mode: str):  # noqa: ANN201
    """A file by path or URI, in any file system that the workers share."""
    u = urlparse(uri)
    if u.scheme in ("", "file"):
        path = unquote(u.path)
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    fs, path = pa.fs.FileSystem.from_uri(uri)
    if mode == "wb":
        fs.create_dir(os.path.dirname(path))
        return fs.open_output_stream(path, compression=None)
    return fs.open_input_stream(path, compression=None)


def renamed(a: str, b: str) -> None:
    u, v = urlparse(a), urlparse(b)
    if u.scheme in ("", "file"):
        os.replace(unquote(u.path), unquote(v.path))
    else:
        fs, path = pa.fs.FileSystem.from_uri(a)
        fs.move(path, v.path if u.scheme in ("hdfs", "viewfs") else v.netloc + v.path)


def b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: object, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(repr((page_id, url, digest)).encode()).digest()[:16], version=5)}>"


_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def safe(url: str) -> str:
    """The url with control characters and spaces percent-encoded, so that it is one header value."""
    return _CONTROL.sub(lambda m: f"%{ord(m.group()):02X}", url)


def id_text(page_id: object) -> str:
    return quote(page_id, safe="") if isinstance(page_id, str) else str(page_id)


def record(page_id: object, url: str, payload: bytes, digest: str, refers: object = None, revisit: bool = False, date: str = DATE) -> bytes:
    """One WARC record, before compression. refers: (page_id, url) of the response that a revisit points to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {safe(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{b32(block)}", "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {id_text(page_id)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(*refers, digest)}", f"WARC-Refers-To-Target-URI: {safe(refers[1])}"] + [f"X-Refers-To-Page-ID: {id_text(refers[0])}"] * (refers[0] is not None)
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member with no time and no name: equal data, equal bytes."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def members(raw: Iterator[bytes]) -> Iterator[bytes]:
    """The decompressed members of a gzip stream, one at a time."""
    d, parts = zlib.decompressobj(31), []
    for chunk in raw:
        while chunk:
            parts.append(d.decompress(chunk))
            chunk = d.unused_data
            if d.eof:
                yield b"".join(parts)
                d, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends within a record")


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers, HTTP head, payload) of a record; raises if a length or digest doesn't hold."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not sep or not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or "sha1:" + b32(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields["WARC-Type"] == "response" and "sha1:" + b32(payload) != fields["WARC-Payload-Digest"]:
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
    return fields, http, payload


def write(pages: DataFrame, out: str, per_range: int = 8192, roll_bytes: int = 64 << 20, level: int = 4, min_revisit: int = 0) -> str:
    """Write pages(page_id, url, html) as archives under `out`; returns the manifest's path."""
    spark = pages.sparkSession
    kind = dict(pages.dtypes)["page_id"]
    src = pages.select("page_id", F.coalesce(pages["url"].cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(pages["html"].cast("string"), F.lit("")), "UTF-8").alias("html"))
    src = src.withColumn("sha", F.sha1("html"))
    # the first page of each payload that repeats: combined before the shuffle, then joined back to the few that need it
    firsts = src.filter(F.octet_length("html") >= min_revisit).groupBy("sha").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "first")
    bounds = quantiles(pages, "page_id", per_range)
    slot = F.coalesce(_slot(bounds, kind), F.lit(-1))
    rows = join_small(src, firsts, ["sha"], "left").withColumn("slot", slot.cast("int"))
    n = min(len(bounds) + 2, 100_000)  # a task for each range or two: tasks don't grow with the input
    rows = rows.repartitionById(n, F.col("slot") + 1).sortWithinPartitions("slot", "page_id", "url", "sha").select("slot", "page_id", "url", "html", "sha", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot_now, part, f, name, temp = None, 0, None, "", ""
        done: list[dict] = []
        state: dict = {}
        seen: tuple | None = None

        def close() -> None:
            nonlocal f
            if f is not None:
                f.close()
                renamed(temp, f"{out}/{name}")
                done.append({"file": name, "records": state["n"], "bytes": state["bytes"], "sha256": state["sha"].hexdigest(), "first_id": state["first"], "last_id": state["last"]})
                f = None

        for b in batches:
            for s, pid, url, html, sha, first in zip(*(c.to_pylist() for c in b.columns)):
                if s != slot_now:
                    close()
                    slot_now, part = s, 0
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                # repeated rows of the response itself are revisits of it
                is_first = first is None or ((first["page_id"], first["url"]) == (pid, url) and seen != (pid, url, sha))
                data = member(record(pid, url, html, digest, None if is_first else (first["page_id"], first["url"]), not is_first), level)
                seen = (pid, url, sha)
                if f is not None and state["bytes"] + len(data) > roll_bytes:
                    close()
                    part += 1
                if f is None:
                    name = f"part-{slot_now + 1:06d}-{part:04d}.warc.gz"
                    temp = f"{out}/_temporary/{name}.{uuid.uuid4().hex}"
                    f = opened(temp, "wb")
                    state = {"n": 0, "bytes": 0, "sha": hashlib.sha256(), "first": pid}
                f.write(data)
                state["n"] += 1
                state["bytes"] += len(data)
                state["sha"].update(data)
                state["last"] = pid
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_id", id_type), ("last_id", id_type)]))

    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    files = arrow_map(rows, run, FILES.format(id=kind))
    files.write.mode("overwrite").parquet(f"{out}/_manifest.tmp")
    hp = spark._jvm.org.apache.hadoop.fs.Path
    fs = hp(out).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(hp(f"{out}/_temporary"), True)
    if not fs.rename(hp(f"{out}/_manifest.tmp"), hp(f"{out}/manifest.parquet")):
        raise OSError(f"{out} could not be committed")
    return f"{out}/manifest.parquet"


def _slot(bounds: list, kind: str) -> Column:
    """Number of bounds at or below an id; null for a null one."""
    if len(bounds) < 50:
        at = F.array(*[F.lit(b).cast(kind) for b in bounds]) if bounds else F.array().cast(f"array<{kind}>")
        return F.when(F.col("page_id").isNotNull(), F.size(F.filter(at, lambda b: b <= F.col("page_id"))))

    @F.pandas_udf("int")
    def slot(ids: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else bisect_right(bounds, x) for x in ids], dtype="Int32")

    return slot(F.col("page_id").cast("string") if kind == "string" else F.col("page_id"))


def read(spark: SparkSession, out: str, id_type: str = "bigint") -> DataFrame:
    """The records of a committed archive: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    ship(spark)
    manifest = spark.read.parquet(f"{out}/manifest.parquet").select("file", "bytes", "sha256")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    as_id = int if id_type in ("bigint", "int") else unquote

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string())])
        for b in batches:
            for name, size, sha in zip(*(c.to_pylist() for c in b.columns)):
                whole, n = hashlib.sha256(), 0

                def chunks() -> Iterator[bytes]:
                    nonlocal n
                    with opened(f"{out}/{name}", "rb") as f:
                        while x := f.read(1 << 20):
                            whole.update(x)
                            n += len(x)
                            yield x

                rows, held = [], 0
                for data in members(chunks()):
                    h, http, payload = parse(data)
                    kind = h["WARC-Type"]
                    length = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                    rows.append({"page_id": as_id(h["X-Page-ID"]) if "X-Page-ID" in h else None, "url": h["WARC-Target-URI"], "payload": payload if kind == "response" else None, "payload_bytes": length, "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": kind, "refers_to": as_id(h["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in h else None})
                    held += len(payload)
                    if held > 8 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                if (n, whole.hexdigest()) != (size, sha):
                    raise ValueError(f"{name} isn't what the manifest names")

    return arrow_map(manifest.repartition(n), run, f"page_id {id_type}, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}")


def archive(pages: DataFrame) -> DataFrame:
    """Write pages under the shared folder and read them back."""
    spark = pages.sparkSession
    out = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, out)
    return read(spark, out, dict(pages.dtypes)["page_id"])


def manifest_json(spark: SparkSession, out: str) -> str:
    """The manifest as lines of JSON, for tools that read no Parquet."""
    return "\n".join(json.dumps(r.asDict()) for r in spark.read.parquet(f"{out}/manifest.parquet").orderBy("file").collect())
