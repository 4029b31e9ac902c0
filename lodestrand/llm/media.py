"""MPEG transport streams as a media column: a muxer, and a parser that trusts nothing.

A payload is carried as one private elementary stream. Access units of up to 8 x 576 bytes become PES
packets with a presentation time; every fourth unit is a random-access point, preceded by program
tables, flagged in its adaptation field and given a clock reference. The parser reads the association
and map sections of all programs, over as many packets as they take, with their CRC; of each elementary stream it checks
continuity counters, reassembles the packets by their declared lengths, and stores each unit's time, place, length and
random-access flag.

`store` writes the streams as Parquet, `index` reads stored streams back and parses them.

Defined results: null and empty texts are one unit of 576 padding bytes; equal payloads give equal
streams; a stream that breaks off, lost or repeated packets, units shorter or longer than they say and damaged tables are
counted, never raised; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, pieces, shared_dir, text_of

BLOCK, UNIT, GROUP = 576, 8, 4  # bytes of a block, blocks of an access unit, units between random-access points
PMT, ES, STREAM_ID, TICKS = 0x1000, 0x100, 0xBD, 3600


@cache
def _crc_table() -> list[int]:
    t = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        t.append(c & 0xFFFFFFFF)
    return t


@lru_cache(4096)
def crc_mpeg(data: bytes) -> int:
    c, t = 0xFFFFFFFF, _crc_table()
    for x in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ t[(c >> 24) ^ x]
    return c


def _section(pid: int, body: bytes) -> bytes:
    """A packet that holds one section."""
    s = body + crc_mpeg(body).to_bytes(4, "big")
    return (bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + s).ljust(188, b"\xff")


@cache
def tables() -> bytes:
    """The program association and program map packets, counters zero."""
    pat = bytes([0x00, 0xB0, 13, 0, 1, 0xC1, 0, 0, 0, 1, 0xE0 | PMT >> 8, PMT & 255])
    pmt = bytes([0x02, 0xB0, 18, 0, 1, 0xC1, 0, 0, 0xE0 | ES >> 8, ES & 255, 0xF0, 0, 0x06, 0xE0 | ES >> 8, ES & 255, 0xF0, 0])
    return _section(0, pat) + _section(PMT, pmt)


@cache
def _unit(size: int, rap: bool) -> tuple[bytes, list[int]]:
    """Packets of an access unit of `size` bytes with times and counters zero, and where its bytes go."""
    body = bytes([0, 0, 1, STREAM_ID]) + (size + 8).to_bytes(2, "big") + bytes([0x84, 0x80, 5, 0x21, 0, 1, 0, 1])
    out, places, left, first = bytearray(), [], len(body) + size, True
    while left:
        field = bytes([7, 0x10 | 0x40 * rap, 0, 0, 0, 0, 0x7E, 0]) if first else b""
        n = min(left, 184 - len(field))
        if n < 184 - len(field):  # stuffing
            if not field:
                field = bytes([0]) if n == 183 else bytes([183 - n, 0]).ljust(184 - n, b"\xff")
            else:
                field = bytes([183 - n]) + field[1:].ljust(183 - n, b"\xff")
        head = bytes([0x47, 0x40 * first | ES >> 8, ES & 255, 0x30 if field else 0x10]) + field
        taken = body[:n] if first else b""
        start = len(out) + len(head) + len(taken)
        out += head + taken + bytes(n - len(taken))
        places += range(start, start + n - len(taken))
        left, first = left - n, False
    return bytes(out), places


@cache
def _group(blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Up to GROUP units: bytes, payload places, packet places, first byte of each PTS, of each clock reference."""
    out, places, pts, pcr = bytearray(tables()), [], [], []
    for k in range(0, blocks, UNIT):
        data, at = _unit(BLOCK * min(UNIT, blocks - k), k == 0)
        places += [len(out) + p for p in at]
        pcr.append(len(out) + 6)
        pts.append(len(out) + 5 + data[4] + 9)
        out += data
    heads = np.arange(2 * 188, len(out), 188)
    return np.frombuffer(bytes(out), np.uint8), np.array(places), heads, np.array(pts), np.array(pcr)


def mux(payload: bytes) -> bytes:
    """A transport stream of a payload whose length is a positive multiple of BLOCK."""
    if not payload or len(payload) % BLOCK:
        raise ValueError("the payload must be blocks of 576 bytes")
    data, size = np.frombuffer(payload, np.uint8), BLOCK * UNIT * GROUP
    whole, parts, packets = len(data) // size, [], 0
    for m, blocks, at in ((whole, UNIT * GROUP, 0), (1, len(data) % size // BLOCK, whole * size)):
        if not (m and blocks):
            continue
        form, places, heads, pts, pcr = _group(blocks)
        out = np.empty((m, len(form)), np.uint8)
        out[:] = form
        out[:, places] = data[at : at + m * blocks * BLOCK].reshape(m, -1)
        g = np.arange(m)[:, None] + at // size
        out[:, [3, 191]] |= (g & 15).astype(np.uint8)
        out[:, heads + 3] |= ((packets + np.arange(m * len(heads)).reshape(m, -1)) & 15).astype(np.uint8)
        packets += m * len(heads)
        t = (g * GROUP + np.arange(len(pts))[None, :]) * TICKS
        for i, (shift, mask, low) in enumerate(((29, 0x0E, 0x21), (22, 0xFF, 0), (14, 0xFE, 1), (7, 0xFF, 0), (0, 0xFE, 1))):
            v = (t << 1 if shift == 0 else t >> shift) if shift in (0, 29, 22) else (t >> shift)
            out[:, pts + i] = ((v & mask) | low).astype(np.uint8)
        for i, shift in enumerate((25, 17, 9, 1)):
            out[:, pcr + i] = (t >> shift & 255).astype(np.uint8)
        out[:, pcr + 4] = ((t & 1) << 7 | 0x7E).astype(np.uint8)
        parts.append(out.reshape(-1))
    return b"".join(p.tobytes() for p in parts)


def _sections(p: np.ndarray, table_id: int) -> tuple[list[bytes], int]:
    """Distinct valid sections with this table id in the packets of one pid, and how many are damaged."""
    good: dict[bytes, int] = {}
    bad, held, seen = 0, None, {}

    def ended(s: bytes) -> bytes:
        """Takes the whole sections off the front; what is left may go on in the next packet."""
        nonlocal bad
        while len(s) >= 3 and s[0] != 0xFF:
            n = 3 + ((s[1] & 15) << 8 | s[2])
            if len(s) < n:
                return s
            if s[0] != table_id or n < 12 or crc_mpeg(s[:n]):
                bad += 1
            else:
                good[s[:n]] = 1
            s = s[n:]
        return s if s[:1] != b"\xff" else b""

    for x in p:
        raw = x.tobytes()
        if not raw[3] & 0x10:
            continue
        body = raw[5 + raw[4] :] if raw[3] & 0x20 else raw[4:]
        if raw[1] & 0x40:
            if held is None and raw[4:] in seen and not raw[3] & 0x20:  # a table repeated as it was, in one packet
                bad += seen[raw[4:]]
                continue
            first, before = not held, bad
            at = body[0] if body else 0
            if held:
                held = ended(held + body[1 : 1 + at])
                bad += bool(held)
            held = ended(body[1 + at :]) or None
            if first and held is None and not raw[3] & 0x20:
                seen[raw[4:]] = bad - before
        elif held is not None:
            held = ended(held + body) or None
    return sorted(good), bad + bool(held)


def _elementary(e: np.ndarray) -> dict:
    """Payload, units, clocks and counts of what is wrong, of the packets of one elementary stream."""
    control = e[:, 3] >> 4 & 3
    e, control = e[(control & 1) == 1], control[(control & 1) == 1]  # packets with payload
    cc = (e[:, 3] & 15).astype(np.int64)
    step = np.diff(cc) & 15
    same = np.zeros(len(e), bool)
    for i in np.flatnonzero(step == 0):
        same[i + 1] = (e[i + 1, 4:] == e[i, 4:]).all()
    out = {"repeated": int(same.sum())}
    e, control, cc = e[~same], control[~same], cc[~same]
    out["discontinuities"] = int(((np.diff(cc) & 15) != 1).sum())
    start = np.minimum(188, np.where(control == 3, 5 + e[:, 4].astype(np.int64), 4))
    pusi = np.flatnonzero(e[:, 1] & 0x40)
    flags = np.where((control == 3) & (e[:, 4] > 0), e[:, 5], 0)
    pusi = pusi[start[pusi] + 9 <= 188]
    wide = np.pad(e, ((0, 0), (0, 16)))
    byte = lambda i: wide[pusi, start[pusi] + i].astype(np.int64)
    if len(pusi):
        pusi = pusi[(byte(0) == 0) & (byte(1) == 0) & (byte(2) == 1)]
    h = start[pusi]
    has_time = (byte(7) & 0x80) > 0
    pts = np.where(has_time & (h + 14 <= 188), (byte(9) >> 1 & 7) << 30 | byte(10) << 22 | (byte(11) >> 1) << 15 | byte(12) << 7 | byte(13) >> 1, -1)
    declared = byte(4) << 8 | byte(5)  # 0: as far as the next one
    head = byte(8)
    start[pusi] = np.minimum(188, h + 9 + head)
    start[: pusi[0] if len(pusi) else len(start)] = 188  # packets before the first unit belong to none
    count = np.maximum(0, 188 - start)
    data = e[np.arange(188)[None, :] >= start[:, None]]
    before = np.concatenate([[0], np.cumsum(count)])
    offset = before[pusi]
    length = np.diff(np.concatenate([offset, before[-1:]])) if len(pusi) else np.zeros(0, np.int64)
    said = np.where(declared > 0, np.maximum(0, declared - 3 - head), length)
    out["short_units"], out["long_units"] = int((length < said).sum()), int((length > said).sum())
    if out["long_units"]:  # what goes beyond a unit's declared length isn't its
        keep = np.ones(len(data), bool)
        for o, n, k in zip(offset, length, said):
            keep[o + min(n, k) : o + n] = False
        data, length = data[keep], np.minimum(length, said)
        offset = np.concatenate([[0], np.cumsum(length)[:-1]])
    out["payload"] = data.tobytes()
    clocked = pusi[(flags[pusi] & 0x10) > 0]
    c = e[clocked, 6:11].astype(np.int64)
    out["clocks"] = c[:, 0] << 25 | c[:, 1] << 17 | c[:, 2] << 9 | c[:, 3] << 1 | c[:, 4] >> 7
    out["units"] = np.stack([pts, offset, length, (flags[pusi] >> 6 & 1).astype(np.int64)], axis=1)
    return out


NOTHING = {"payload": b"", "discontinuities": 0, "repeated": 0, "short_units": 0, "long_units": 0, "units": np.zeros((0, 4), np.int64), "clocks": np.zeros(0, np.int64)}


def demux_all(stream: bytes) -> dict:
    """Packets, lost_sync, bad_tables, and streams: (program, pid, type) -> payload, units, clocks and counts."""
    n = len(stream) // 188
    p = np.frombuffer(stream, np.uint8, n * 188).reshape(n, 188)
    lost_sync = int((p[:, 0] != 0x47).sum()) + (len(stream) % 188 > 0)
    p = p[p[:, 0] == 0x47]
    pid = (p[:, 1] & 31).astype(np.int64) << 8 | p[:, 2]
    pats, bad_tables = _sections(p[pid == 0], 0x00)
    programs = {(s[i] << 8 | s[i + 1], (s[i + 2] & 31) << 8 | s[i + 3]) for s in pats for i in range(8, len(s) - 4, 4)}
    streams: dict[tuple[int, int, int], dict] = {}
    for program, at in sorted(programs):
        if not program:  # the network's own table
            continue
        pmts, bad = _sections(p[pid == at], 0x02)
        bad_tables += bad
        for s in pmts:
            if (s[3] << 8 | s[4]) != program:
                continue
            i = 12 + ((s[10] & 15) << 8 | s[11])
            while i + 5 <= len(s) - 4:
                own = (s[i + 1] & 31) << 8 | s[i + 2]
                if (program, own, s[i]) not in streams:
                    streams[program, own, s[i]] = _elementary(p[pid == own])
                i += 5 + ((s[i + 3] & 15) << 8 | s[i + 4])
    return {"packets": n, "lost_sync": lost_sync, "bad_tables": bad_tables, "streams": streams}


def demux(stream: bytes) -> dict:
    """The first elementary stream of the first program, with counts of what is wrong with the whole stream."""
    d = demux_all(stream)
    key = min(d["streams"], default=None)
    own = d["streams"][key] if key else NOTHING
    return own | {"packets": d["packets"], "lost_sync": d["lost_sync"], "bad_tables": d["bad_tables"], "program": key and key[0], "pid": key and key[1], "streams": len(d["streams"])}


def feature(d: dict) -> str:
    """What was parsed, in one line; the index of units goes in as a checksum."""
    u = d["units"]
    return f"program={d['program']};pid={d['pid']};packets={d['packets']};units={len(u)};random_access={int(u[:, 3].sum())};pts={u[0, 0] if len(u) else -1}-{u[-1, 0] if len(u) else -1};clocks={len(d['clocks'])};discontinuities={d['discontinuities']};repeated={d['repeated']};short_units={d['short_units']};long_units={d['long_units']};bad_tables={d['bad_tables']};lost_sync={d['lost_sync']};index_crc32={zlib.crc32(np.ascontiguousarray(u).tobytes())}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media for each row of docs(doc_id, text): what is to be written."""
    kind = dict(docs.dtypes)["doc_id"]
    src = docs.select("doc_id", text_of(docs).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            media = [mux(t + b"\xff" * (-len(t) % BLOCK if t else BLOCK)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return arrow_map(src, run, f"doc_id {kind}, n_bytes long, media binary")


UNITS = pa.list_(pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("random_access", pa.int64())]))


def index(stored: DataFrame) -> DataFrame:
    """Stored(doc_id, n_bytes, media) parsed: digests of media and payload, feature, and units: time, place, length, random access."""
    kind = dict(stored.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "media"):
            rows, units, sizes = [], [], []
            for media in b.column("media").to_pylist():
                d = demux(media)
                back = d["payload"]
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(d)))
                units.append(d["units"])
                sizes.append(len(d["units"]))
            size, sha, tail, m_bytes, m_sha, feat = zip(*rows)
            flat = np.concatenate(units)
            of = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(4)], fields=list(UNITS.value_type))
            at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(size, pa.int64()), pa.array(sha), pa.array(tail, pa.int64()), pa.array(m_bytes, pa.int64()), pa.array(m_sha), pa.array(feat), pa.ListArray.from_arrays(at, of)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "units"])

    more = "units array<struct<pts:long,offset:long,length:long,random_access:long>>"
    return arrow_map(stored.select("doc_id", "n_bytes", "media"), run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, {more}")


def library(docs: DataFrame, at: str | None = None) -> DataFrame:
    """Write the streams of docs as Parquet under the shared folder (or `at`), and index what was written."""
    at = at or f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    store(docs).write.option("compression", "zstd").parquet(at)
    return index(docs.sparkSession.read.parquet(at))
