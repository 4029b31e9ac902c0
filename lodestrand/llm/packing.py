"""Cost-balanced packing of documents into training sequences.

A sequence of n tokens costs `linear * n + quadratic * n * n` for attention within its documents
(every piece attends to itself alone, so pieces' costs add up). Documents are cut into full
sequences and one remainder each; remainders, in descending order, go to the sequence of
lowest cost among all with enough room. Where no sequence has room, the remainder is cut over the
sequences with most room, so that all sequences of a block but the last are full.

Packing works on blocks of consecutive documents of a partition, each of `block_tokens` tokens, in one
streaming pass: no shuffle, memory bounded by the block, and padding of less than one sequence in
each block. Tokens are encoded exactly as the tokenizer file does: pieces between single spaces are
looked up in a cache of encodings, texts that can't be split there are encoded whole.

Defined results: null and empty texts have the end token alone; repeated rows are packed each; ties
keep the order of doc_id and start; an empty table gives no pieces; a text of any length is cut.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import AT_END, arrow_map, pieces, text_of

SPECIAL = "<|endoftext|>"
#: A space next to other white space: there the pieces between spaces aren't encoded independently.
_RUN = re.compile(r" \s|\s ")
_ENCODER: dict[tuple, Callable[[str], bytes]] = {}
_CACHES: list[dict] = []
AT_END.append(lambda: [c.clear() for c in _CACHES])


class Cache(dict):
    """piece -> its ids as little-endian 32-bit bytes; forgets all when full, which only costs time."""

    def __init__(self, encode: Callable[[str], list[int]], lead: str, most: int = 200_000):
        super().__init__()
        self.encode, self.lead, self.most = encode, lead, most

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encode(self.lead + piece), dtype="<u4").tobytes()
        if len(piece) < 40:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


def encoder(name: str = "byte_bpe_50k", folder: str | None = None) -> Callable[[str], bytes]:
    """text -> ids of the named vocabulary as bytes; folder: where its two files lie, else the installed one."""
    key = (name, folder)
    if key not in _ENCODER:
        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer

        at = (lambda f: f"{folder}/{f}") if folder else P.path
        with open(at(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        exact = cache(lambda: Tokenizer.from_file(at(f"{name}.json")))  # 28 MB that most tasks have no use for
        inner, first = Cache(fast, " "), Cache(fast, "", 20_000)
        _CACHES.extend([inner, first])

        def encode(text: str) -> bytes:
            if SPECIAL in text:
                return np.array(exact().encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            if _RUN.search(text):
                return np.array(fast(text), dtype="<u4").tobytes()
            head, *rest = text.split(" ")
            return first[head] + b"".join(map(inner.__getitem__, rest))

        _ENCODER[key] = encode
    return _ENCODER[key]


def assign(lengths: np.ndarray, size: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length), for documents of `lengths` tokens.

    All sequences but one are full. `lengths` are taken in descending order of what a document leaves
    beyond full sequences; ties keep the given order. Each goes to the sequence of lowest cost of all that have room for
    it, the first of equals; where none has, it is cut over those with most room, of these the one of lowest cost.
    """
    full = [[(int(d), int(k) * size, size)] for d in np.flatnonzero(lengths >= size) for k in range(lengths[d] // size)]
    rest = lengths % size
    order = np.argsort(-rest, kind="stable")
    order = order[: int((rest > 0).sum())]
    n = -(-int(rest.sum()) // size)
    room, cost = np.full(n, size, np.int64), np.zeros(n)
    bins: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    for d in order:
        left, at = int(rest[d]), int(lengths[d] - rest[d])
        while left:
            i = int(np.where(room >= left, cost, np.inf).argmin())
            if room[i] < left:
                i = int(np.where(room == room.max(), cost, np.inf).argmin())
            take = min(left, int(room[i]))
            bins[i].append((int(d), at, take))
            room[i] -= take
            cost[i] += linear * take + quadratic * take * take
            left, at = left - take, at + take
    return full + [b for b in bins if b]


def pack(docs: DataFrame, size: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1 / 2048, block_tokens: int = 6_000_000, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost."""
    kind = dict(docs.dtypes)["doc_id"]
    src = docs.select("doc_id", text_of(docs).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, folder)
        end = np.array([end_id], dtype="<u4").tobytes()
        part = TaskContext.get().partitionId() << 40
        ids: list[bytes] = []
        names: list = []
        seen, made = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            order = sorted(range(len(ids)), key=lambda i: (names[i] is not None, names[i], len(ids[i]), zlib.crc32(ids[i])))
            lengths = np.array([len(ids[i]) // 4 for i in order], dtype=np.int64)
            rows = []
            for b in assign(lengths, size, linear, quadratic):
                off, cost = 0, sum(linear * n + quadratic * n * n for _, _, n in b)
                for d, start, n in b:
                    i = order[d]
                    rows.append((names[i], start, n, zlib.crc32(memoryview(ids[i])[4 * start : 4 * (start + n)]), int(lengths[d]), part + made, off, cost))
                    off += n
                made += 1
            cols = list(zip(*rows))
            types = [name_type, *[pa.int64()] * 6, pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"])

        name_type = None
        for b in pieces(batches, "text"):
            name_type = b.schema.field("doc_id").type
            for name, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids.append(encode(text) + end)
                names.append(name)
                seen += len(ids[-1]) // 4
                if seen >= block_tokens:
                    yield flush()
                    ids, names, seen = [], [], 0
        if ids:
            yield flush()

    return arrow_map(src, run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double")
