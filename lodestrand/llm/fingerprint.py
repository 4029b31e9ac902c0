"""Improbable-feature digests of documents.

Every 24-byte window of a text has an entropy. How often each entropy occurs is counted over all windows of all documents,
and the seldom ones have the lowest ranks (windows that are nearly constant are never chosen). In each run of 16
neighbouring windows the lowest rank is popular; windows that are popular often enough are the improbable features.
Each goes into a 2048-bit Bloom filter by five 11-bit hashes; a filter that holds 160 features is closed and chained
to a new one. Two digests are compared filter by filter: the bits they have in common, beyond what chance gives filters
of so many bits, normalised to 0..1; each filter of the shorter digest counts with its best partner.

Texts of all lengths have the same features, so likeness doesn't depend on where a length lies. Texts shorter than a
window, or without an eligible window, use one feature, the text itself. Digests are comparable if made with one
table of ranks: `ranked` counts it, `fingerprints` takes it.

Defined results: null texts are empty; the empty text has the digest of no filters, like only to
itself; equal texts have equal digests and likeness 1; ties of rank go to the leftmost window; repeated rows and
ids follow one another in the order of id and text; an empty table gives no rows; texts of any length are
digested whole, in blocks; ids of any type that can be ordered.
"""

from __future__ import annotations

import base64
import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pieces, quantiles, text_of

WINDOW, NEAR, POPULAR, FULL, BITS, HASHES = 24, 16, 4, 160, 2048, 5
#: c log2 c for counts in a window, in units of 2**-12, so that sums are exact
_CLOG = np.array([0] + [round(c * math.log2(c) * 4096) for c in range(1, WINDOW + 1)], np.int32)
_DIFF = np.diff(_CLOG, append=_CLOG[-1:])
_MIX = (np.arange(1, WINDOW + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Entropy classes from 0 to log2(WINDOW) bits, that under which windows make weak features (runs, rulers), the rank of none.
CLASSES, LEAST, NEVER = 1001, 250, 2000


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """The rank of each entropy class, given how many windows are of it: seldom ones first, ties by class."""
    out = np.full(CLASSES, NEVER, np.int32)
    order = np.argsort(counts[LEAST:], kind="stable")
    out[LEAST + order] = np.arange(len(order))
    return out


def _equal_near(t: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, how many of the window - 1 bytes before it, and after it, are equal to it."""
    n = len(t)
    order = np.argsort(t, kind="stable")
    # places, with a gap of a window between byte values, ascend; so equal bytes nearby are neighbours
    place = (order + t[order].astype(np.int64) * (n + window)).astype(np.int64 if n > 1 << 22 else np.int32)
    if n < 2000:
        count = np.arange(n) - np.searchsorted(place, place - (window - 1))
    else:
        count = np.zeros(n, np.int32)
        for d in range(1, window):
            hit = place[d:] - place[:-d] < window
            if not hit.any():
                break
            count[d:] += hit
    # entry k reaches down to k - count[k]; those that reach down to k or below are after it
    reach = np.cumsum(np.bincount(np.arange(n) - count, minlength=n)) - 1 - np.arange(n)
    before, after = np.empty(n, np.int32), np.empty(n, np.int32)
    before[order], after[order] = count, reach
    return before, after


def classes(t: np.ndarray) -> np.ndarray:
    """The entropy class of each window."""
    n = len(t)
    before, after = _equal_near(t)
    first = int(_CLOG[np.bincount(t[:WINDOW], minlength=256)].sum())
    # window i+1 loses byte i, of which it had after[i]+1, and gains byte i+WINDOW, of which it has before[i+WINDOW]
    step = _DIFF[before[WINDOW:]] - _DIFF[after[: n - WINDOW]]
    sums, top = np.concatenate([[first], first + np.cumsum(step)]), int(_CLOG[WINDOW])
    return (top - sums) * 1000 // top


def tallied(data: bytes, block: int = 1 << 17) -> np.ndarray:
    """How many windows of a text are of each class."""
    t, out = np.frombuffer(data, np.uint8), np.zeros(CLASSES, np.int64)
    n = len(t) - WINDOW + 1
    for a in range(0, n, block):
        out += np.bincount(classes(t[a : min(n, a + block) + WINDOW - 1]), minlength=CLASSES)
    return out


def ranked(docs: DataFrame) -> np.ndarray:
    """The table of ranks measured over every window of every text of docs(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for b in pieces(batches, "text"):
            for data in b.column("text").cast(pa.binary()).to_pylist():
                total += tallied(data)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["class", "n"])

    counts = np.zeros(CLASSES, np.int64)
    for c, n in arrow_map(docs.select(text_of(docs).alias("text")), run, "class int, n long").groupBy("class").agg(F.sum("n")).collect():  # a row a class
        counts[c] = n
    return ranks_of(counts)


def _popular(rank: np.ndarray) -> np.ndarray:
    """Starts of windows that hold the lowest rank, leftmost, in POPULAR or more runs of NEAR windows, a power of two."""
    m = len(rank)
    if m < NEAR:
        i = int(np.argmin(rank))
        return np.array([i] if rank[i] < NEVER else [], np.int64)
    key = rank.astype(np.int64) * (1 << 32) + np.arange(m)
    w = 1
    while w < NEAR:  # minimum over runs of 2, 4, ...
        key = np.minimum(key[:-w], key[w:])
        w *= 2
    key = key[key < NEVER << 32]
    at = key & 0xFFFFFFFF
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(at)))
    return at[new][count >= POPULAR]


def places(t: np.ndarray, a: int, b: int, ranks: np.ndarray) -> np.ndarray:
    """Starts in [a, b) of improbable features; what is further than a run and a window away has no part in it."""
    n = len(t) - WINDOW + 1
    lo, hi = max(0, min(a - NEAR, n - NEAR)), min(n, max(b + NEAR, NEAR))
    at = _popular(ranks[classes(t[lo : hi + WINDOW - 1])]) + lo
    return at[(at >= a) & (at < b)]


def _hashes(t: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = ((t[at[:, None] + np.arange(WINDOW)].astype(np.uint64) + np.uint64(1)) * _MIX).sum(axis=1, dtype=np.uint64)
    for shift, mul in ((29, 0xBF58476D1CE4E5B9), (32, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(mul)
    return h ^ (h >> np.uint64(31))


Found = tuple[np.ndarray, np.ndarray]


def located(data: bytes, ranks: np.ndarray, block: int = 1 << 17) -> Found:
    """Starts and 64-bit hashes of a text's improbable features, in order."""
    t = np.frombuffer(data, np.uint8)
    n = len(t) - WINDOW + 1
    parts = [(at, _hashes(t, at)) for a in range(0, n, block) for at in [places(t, a, min(n, a + block), ranks)]]
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _whole(data: bytes, h: np.ndarray) -> np.ndarray:
    """The features, or the text itself as the one feature."""
    return h if len(h) or not data else np.frombuffer(hashlib.blake2b(data, digest_size=8).digest(), np.uint64)


def features(data: bytes, ranks: np.ndarray) -> np.ndarray:
    return _whole(data, located(data, ranks)[1])


def spliced(data: bytes, cut: int, mine: Found, other: Found, ranks: np.ndarray) -> np.ndarray:
    """features(data), where data is the first `cut` bytes of a text and then the first bytes of another.

    Features far enough from the cut and the end are those of the two texts; the others are found anew.
    """
    t = np.frombuffer(data, np.uint8)
    n, far = len(t) - WINDOW + 1, WINDOW + NEAR
    left, right, stop = cut - far, cut + NEAR, len(t) - far
    if left <= 0 or n < far or right >= stop:
        return features(data, ranks)
    (p, h), (q, g) = mine, other
    keep, use = p < left, (q >= NEAR) & (q < stop - cut)
    a, b = places(t, left, right, ranks), places(t, stop, n, ranks)
    return _whole(data, np.concatenate([h[keep], _hashes(t, a), g[use], _hashes(t, b)]))


def filters(h: np.ndarray) -> np.ndarray:
    """The chained Bloom filters of feature hashes, as rows of 2048 bits. Repeated features count once in a filter."""
    if not len(h):
        return np.zeros((0, BITS), bool)
    _, first = np.unique(h, return_index=True)
    h = h[np.sort(first)]
    out = np.zeros((-(-len(h) // FULL), BITS), bool)
    row = np.arange(len(h)) // FULL
    for i in range(HASHES):
        out[row, (h >> np.uint64(11 * i) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return out


def digest(data: bytes, ranks: np.ndarray) -> np.ndarray:
    return filters(features(data, ranks))


def encode(f: np.ndarray) -> str:
    return f"{len(f)}:" + base64.b64encode(np.packbits(f, axis=1).tobytes()).decode()


def decode(s: str) -> np.ndarray:
    k, _, b = s.partition(":")
    return np.unpackbits(np.frombuffer(base64.b64decode(b), np.uint8)).astype(bool).reshape(int(k), BITS)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: how far the set bits of two digests coincide, beyond chance; 1 for equal digests."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    weight, score = a.sum(axis=1).astype(np.float32), np.zeros(len(a), np.float32)
    for i in range(0, len(a), 256):  # blocks, so that long digests need no matrix of all their filters
        x = a[i : i + 256].astype(np.float32)
        na = weight[i : i + 256, None]
        for j in range(0, len(b), 4096):
            y = b[j : j + 4096].astype(np.float32)
            nb = y.sum(axis=1)[None, :]
            chance = na * nb / BITS
            near = (x @ y.T - chance) / np.maximum(np.minimum(na, nb) - chance, 1e-6)
            np.maximum(score[i : i + 256], np.clip(near, 0, 1).max(axis=1), out=score[i : i + 256])
    # features that the longer digest has beyond the shorter one keep equal-sized texts apart, not a part and its whole
    return float((score * weight).sum() / weight.sum())


def edited(text: str, other: str) -> str:
    """The text with its last half replaced by as many first characters of the other, or all it has."""
    k = len(text) // 2
    return text[: len(text) - k] + other[:k]


def with_next(docs: DataFrame, rows: int = 2048) -> DataFrame:
    """Each row of docs(doc_id, text) with the next one's text by (doc_id, text), the first after the last.

    Ids are cut into ranges of about `rows` by quantiles; the first document of each is sent to the range before it as
    well. A range is read in order in one pass, with two documents in memory.
    """
    src = docs.select("doc_id", text_of(docs).alias("text"))
    at = quantiles(src, "doc_id", rows)
    last = len(at)
    # the least id at or above each bound; an id may repeat, so all its rows are sent and the first in order is taken
    least: dict[int, object] = {}
    if last:

        def first_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, object] = {}
            for b in batches:
                for v in b.column("doc_id").to_pylist():
                    k = bisect_right(at, v)
                    if k not in best or v < best[k]:
                        best[k] = v
                name_type = b.schema.field("doc_id").type
            if best:
                yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), name_type)], names=["slot", "first"])

        kind = dict(src.dtypes)["doc_id"]
        least = {r[0]: r[1] for r in arrow_map(src.select("doc_id").filter("doc_id is not null"), first_of, f"slot long, first {kind}").groupBy("slot").agg(F.min("first")).collect()}
    has_null = bool(src.filter("doc_id is null").limit(1).count())
    first_id = None if has_null else src.agg(F.min("doc_id")).first()[0]
    # the first of each range goes to the nearest range before it that has documents
    slots_used = sorted(least)
    before = {least[k]: slots_used[i - 1] if i else 0 for i, k in enumerate(slots_used) if i or (has_null and k)}
    end = slots_used[-1] if slots_used else 0

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, tail, slot = [], [], []
            for i, v in enumerate(b.column("doc_id").to_pylist()):
                s = 0 if v is None else bisect_right(at, v)
                take.append(i), tail.append(0), slot.append(s)
                if v is not None and s and v in before:
                    take.append(i), tail.append(1), slot.append(before[v])
                if v == first_id:
                    take.append(i), tail.append(2), slot.append(end)
            where = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(tail, pa.int32()), b.column("doc_id").take(where), b.column("text").take(where)], names=["slot", "tail", "doc_id", "text"])

    sent = arrow_map(src, copies, f"slot int, tail int, doc_id {dict(docs.dtypes)['doc_id']}, text string")
    return sent.repartitionById(min(last + 1, 100_000), "slot").sortWithinPartitions("slot", "tail", "doc_id", "text")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, text, next text) from with_next's rows."""
    held, slot_now = None, None
    for b in batches:
        for slot, tail, doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
            if slot != slot_now:
                held, slot_now = None, slot
            if held is not None:
                yield (*held, text)
            held = None if tail else (doc_id, text)


def fingerprints(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_chars, fingerprint of the text and of its edited form, and the likenesses to that and the next text's.

    ranks: a table of ranks, else that measured over docs.
    """
    kind = dict(docs.dtypes)["doc_id"]
    table = docs.sparkSession.sparkContext.broadcast(ranked(docs) if ranks is None else ranks)  # 1001 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        known: tuple = (None,)
        order, size, id_type = table.value, 0, None

        def read(x: str) -> tuple:
            data = x.encode("utf-8", "surrogatepass")
            found = located(data, order)
            return x, found, filters(_whole(data, found[1]))

        def batch() -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field("doc_id").type
                yield b

        for doc_id, text, other in _pairs(typed()):
            if known[0] != text:
                known = read(text)
            _, placed, mine = known
            known = read(other)
            _, placed_next, nxt = known
            e = edited(text, other).encode("utf-8", "surrogatepass")
            own = filters(spliced(e, len(text[: len(text) - len(text) // 2].encode("utf-8", "surrogatepass")), placed, placed_next, order))
            rows.append((doc_id, len(text), hashlib.sha256(e).hexdigest(), encode(mine), encode(own), likeness(mine, own), likeness(mine, nxt)))
            size += len(rows[-1][3]) + len(rows[-1][4])
            if len(rows) >= 1000 or size > 8 << 20:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    return arrow_map(with_next(docs), run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
