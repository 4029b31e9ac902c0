"""Functions on bytes and sentences that need Python: paragraph spans, encoding repair, chunkers, test embedder."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN, MAX = 40, 4000
SPANS = T.ArrayType(T.StructType([T.StructField(c, T.BinaryType() if c == "bytes" else T.LongType()) for c in ("off", "len", "para", "bytes")]))
_BREAK, _LEAD = re.compile(rb"\n[\n\r]"), re.compile(rb"[\n\r \t]*")


def spans(data: bytes, low: int = MIN, high: int = MAX) -> Iterator[tuple[int, int, int]]:
    """(offset, length, number) of paragraphs, in bytes.

    A line end followed by another, with something after them or not, ends a paragraph; white space before one is passed
    over. Paragraphs over `high` are cut before the last
    full stop or line end of the second half of that many bytes; pieces under `low` are left out, and not numbered.
    """
    at, number, n = 0, 1, len(data)
    while at < n:
        at = _LEAD.match(data, at).end()
        if at >= n:
            return
        m = _BREAK.search(data, at)
        stop = m.start() if m else n
        start, size = at, stop - at
        while size > high:
            half = start + high // 2
            cut = max(data.rfind(b".", half + 1, start + high + 1), data.rfind(b"\n", half + 1, start + high + 1))
            if cut < 0:
                cut = start + high
            yield start, cut - start, number
            number += 1
            size -= cut - start
            start = cut
        if size >= low:
            yield start, size, number
            number += 1
        at = stop + 1


@F.pandas_udf(SPANS)
def split_spans(data: pd.Series) -> pd.Series:
    """Paragraphs of a binary column with their places; null has none."""
    return pd.Series([[] if x is None else [{"off": o, "len": k, "para": p, "bytes": bytes(x[o : o + k])} for o, k, p in spans(bytes(x))] for x in data], dtype=object)


_C1 = {i: bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(0x80, 0xA0)}


def repair(data: bytes) -> str:
    """Text of bytes: UTF-8 where they are, else Windows-1252, else Latin-1, byte by byte. Never fails."""

    def other(e: UnicodeDecodeError) -> tuple[str, int]:
        return "".join(_C1.get(b, chr(b)) for b in e.object[e.start : e.end]), e.end

    return data.decode("utf-8", _handler(other))


def _handler(f: Callable) -> str:
    import codecs

    codecs.register_error("lodestrand-repair", f)
    return "lodestrand-repair"


def clean(data: bytes) -> str:
    """repair, line ends as LF, no NUL, no byte order mark at the start."""
    t = re.sub(r"\r\n?", "\n", repair(data)).replace("\0", "")
    return t.removeprefix("﻿")


@F.pandas_udf(T.StringType())
def clean_text(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else clean(bytes(x)))


def _pack(pieces: Iterator[str], limit: int, glue: str) -> Iterator[str]:
    """Pieces joined as long as they fit."""
    held = ""
    for piece in pieces:
        joined = glue.join(x for x in (held, piece) if x)
        if len(joined) <= limit:
            held = joined
            continue
        if held:
            yield held
        held = piece
    if held:
        yield held


def chunks_by_sentence(text: str, limit: int = 800) -> list[str]:
    """Sentences packed into chunks of up to `limit` characters; of longer ones, parts are cut at a space of their
    second half and come at once, before what was being packed."""
    flat = " ".join(text.split())
    if len(flat) <= limit:
        return [flat]
    early: list[str] = []
    out: list[str] = []

    def sentences() -> Iterator[str]:
        for s in re.split(r"(?<=[.!?])\s+", flat):
            while len(s) > limit:
                at = s.rfind(" ", 0, limit)
                at = at if at >= limit // 2 else limit
                early.append(s[:at])
                s = s[at:].strip()
            out.extend(early)
            early.clear()
            yield s

    for chunk in _pack(sentences(), limit, " "):
        out.append(chunk)
    return out


def chunks_by_stop(text: str, limit: int = 600) -> list[str]:
    """Sentences, every mark at an end taken for a full stop, packed with full stops between; longer ones cut hard."""
    flat = " ".join(text.split())
    if len(flat) <= limit:
        return [flat]
    held, out = "", []
    for s in filter(None, map(str.strip, re.split(r"[.!?] ", flat))):
        joined = f"{held}. {s}" if held else s
        if len(joined) <= limit:
            held = joined
            continue
        out += [held] * bool(held)
        whole = (len(s) - 1) // limit
        out += [s[i * limit : (i + 1) * limit] for i in range(whole)]
        held = s[whole * limit :]
    return out + [held] * bool(held)


def chunks_by_tokens(text: str, encode: Callable[[str], list], decode: Callable[[list], str], limit: int = 254) -> list[str]:
    """Chunks of up to `limit` tokens of the tokenizer that the caller brings."""
    ids = encode(text)
    return [decode(ids[i : i + limit]) for i in range(0, len(ids), limit)]


def chunk_udf(f: Callable[..., list[str]], *args: object):  # noqa: ANN201
    """A chunker as an array<string> column function."""

    @F.pandas_udf("array<string>")
    def chunks(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else f(t, *args) for t in text], dtype=object)

    return chunks


def hash_embedding(text: str, dim: int = 64) -> np.ndarray:
    """A vector of a text by hashed 4-byte windows: deterministic, without meaning, for tests."""
    b = text.encode("utf-8", "surrogatepass")
    v = np.zeros(dim, np.float32)
    for i in range(len(b) - 3):
        h = 2166136261
        for x in b[i : i + 4]:
            h = (h ^ x) * 16777619 & 0xFFFFFFFF
        v[h % dim] += 1
    n = float(np.linalg.norm(v))
    return v / n if n > 1e-12 else v


def hash_embeddings(texts: list[str], dim: int = 64) -> np.ndarray:
    """hash_embedding of each text, all windows at once."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    b = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    v = np.zeros((len(parts), dim), np.float32)
    if len(b) > 3:
        h = np.full(len(b) - 3, 2166136261, np.uint32)
        for i in range(4):
            h = (h ^ b[i : len(b) - 3 + i]) * np.uint32(16777619)
        row = np.repeat(np.arange(len(parts)), sizes)
        whole = row[: len(h)] == row[3:]  # windows of one text alone
        v = np.bincount(row[: len(h)][whole] * dim + (h[whole] % dim).astype(np.int64), minlength=len(parts) * dim).reshape(-1, dim).astype(np.float32)
    n = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(n > 1e-12, n, 1)


def embed_udf(embed: Callable[[list[str]], list], batch: int = 128):  # noqa: ANN201
    """array<float> column from an embedder of lists of texts, `batch` at a time; fails rather than leaving texts out."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out: list = []
        for i in range(0, len(texts), batch):
            part = list(texts.iloc[i : i + batch])
            got = embed(part)
            if len(got) != len(part):
                raise ValueError(f"{len(part)} texts, {len(got)} vectors")
            out += [np.asarray(v, np.float32).tolist() for v in got]
        return pd.Series(out, dtype=object)

    return run
