"""Codes of records: hyperplanes, SimHash, byte-shingle codes, Hamming distance, trits, hex forms, content hashes."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED, BITS = 0x5191C0DE5191C0DE, 128
_M64 = (1 << 64) - 1


@cache
def planes(dim: int, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Gaussian hyperplanes (bits x dim), the same on every machine: splitmix64 and Box-Muller, kept as float32."""
    state = seed

    def uniform() -> float:
        nonlocal state
        state = (state + 0x9E3779B97F4A7C15) & _M64
        x = state
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ (x >> shift)) * factor) & _M64
        return ((x ^ (x >> 31)) >> 11) / 2.0**53

    def gaussian() -> float:
        while (a := uniform()) <= 1e-12:
            pass
        return math.sqrt(-2 * math.log(a)) * math.cos(2 * math.pi * uniform())

    return np.array([gaussian() for _ in range(bits * dim)], np.float32).reshape(bits, dim).astype(np.float64)


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """Rows of bits (multiples of 64) as signed 64-bit words; bit b is bit b % 64 of word b // 64."""
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def simhash(vec: Column, dim: int, bits: int = BITS, seed: int = SEED) -> Column:
    """array<long> of bits/64 words: which side of each plane a vector lies on. Null and zero vectors have no code."""
    p = planes(dim, bits, seed).T

    @F.pandas_udf("array<long>")
    def project(v: pd.Series) -> pd.Series:
        out: list = [None] * len(v)
        ok = np.flatnonzero(v.notna())
        for lo in range(0, len(ok), 2048):  # the products are as wide as the codes
            part = ok[lo : lo + 2048]
            m = np.stack(v.iloc[part].to_list()).astype(np.float64)
            for i, w, any_ in zip(part.tolist(), pack_bits(m @ p > 0).tolist(), m.any(axis=1).tolist()):
                out[i] = w if any_ else None
        return pd.Series(out, dtype=object)

    return project(vec)


def simhash_native(vec: Column, dim: int, bits: int = BITS, seed: int = SEED) -> Column:
    """The same by built-in functions alone: for plans that must not leave the JVM. Slower for wide codes."""
    p = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in planes(dim, bits, seed)])
    dots = F.transform(p, lambda row: F.aggregate(F.zip_with(vec, row, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x))
    word = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(F.when(F.element_at(dots, i + 64 * w + 1) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))
    return F.array(*[word(w) for w in range(bits // 64)])


def hamming(a: list[Column], b: list[Column]) -> Column:
    """Number of bits in which two codes differ, word by word."""
    total = F.lit(0)
    for x, y in zip(a, b, strict=True):
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total


def hamming_arrays(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def shingle_code(data: bytes) -> tuple[int, int]:
    """The code of a text by its bytes: every window of four sets a bit; shorter texts set a bit for each byte."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) >= 4:
        w = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
        w ^= w >> 16
        w *= np.uint32(0x7FEB352D)
        b = w ^ (w >> 15)
    bits = np.zeros(BITS, np.uint8)
    bits[b % BITS] = 1
    lo, hi = pack_bits(bits[None, :])[0]
    return int(lo), int(hi)


@F.pandas_udf(T.ArrayType(T.LongType()))
def shingle_lsh(data: pd.Series) -> pd.Series:
    """shingle_code of a binary column; null stays null."""
    return pd.Series([None if x is None else list(shingle_code(bytes(x))) for x in data], dtype=object)


def code_hex(words: list[Column]) -> Column:
    """16 lower-case digits a word, most significant first."""
    return F.concat(*[F.lower(F.lpad(F.hex(w), 16, "0")) for w in words])


def code_from_hex(text: Column, word: int) -> Column:
    """Word number `word` of a code's hex form, as a signed long; null where it isn't hex of whole words."""
    part = F.substring(text, 16 * word + 1, 16)
    high, low = (F.conv(F.substring(part, a, 8), 16, 10).cast("long") for a in (1, 9))
    signed = F.when(high >= 1 << 31, high - (1 << 32)).otherwise(high)
    whole = text.rlike("^([0-9A-Fa-f]{16})+$") & (F.length(text) >= 16 * (word + 1))
    return F.when(whole, signed * F.lit(1 << 32) + low)


def content_hash(data: Column) -> Column:
    """Identity of a text or of bytes: SHA-256 in hex."""
    return F.sha2(data.cast("binary"), 256)


@F.pandas_udf(T.LongType())
def fnv1a(data: pd.Series) -> pd.Series:
    """The 64-bit hash that paths are told apart by, as a signed long; of strings or bytes, null stays null."""

    def one(x: object) -> int | None:
        if x is None:
            return None
        h = 1469598103934665603
        for b in x.encode() if isinstance(x, str) else bytes(x):
            h = (h ^ b) * 1099511628211 & _M64
        return h - (1 << 64) if h >> 63 else h

    return pd.Series([one(x) for x in data], dtype="Int64")


def tagged_digest(text: Column) -> Column:
    """The hash with its algorithm, so that digests of different algorithms are never equal."""
    return F.concat(F.lit("sha256:"), content_hash(text))


def trits_pack(*digits: Column) -> Column:
    """Six digits -1, 0, 1, most significant first, as one number under 729; null where a digit is none."""
    value, ok = F.lit(0), F.lit(True)
    for d in digits:
        value, ok = value * 3 + d + 1, ok & d.between(-1, 1)
    return F.when(ok, value.cast("int"))


def trits_unpack(packed: Column, count: int = 6) -> list[Column]:
    ok = trits_valid(packed, count)
    return [F.when(ok, (F.floor(packed / 3 ** (count - 1 - i)) % 3 - 1).cast("int")) for i in range(count)]


def trits_valid(packed: Column, count: int = 6) -> Column:
    return packed.between(0, 3**count - 1)


RECORD = (("lsh0", 8), ("lsh1", 8), ("hash", 32), ("para", 4), ("timestamp", 4), ("category", 2), ("trits", 2), ("cluster", 4))


def record_hex(c: dict[str, Column]) -> Column:
    """A record's 64 bytes as 128 hex digits, fields in order, each most significant byte first."""
    part = lambda name, n: F.lower(F.col(name) if name == "hash" else F.substring(F.lpad(F.hex(c[name].cast("long")), 16, "0"), 17 - 2 * n, 2 * n))
    return F.concat(*[F.lower(c["hash"]) if name == "hash" else part(name, n) for name, n in RECORD])


def record_from_hex(text: Column) -> dict[str, Column]:
    """Fields of a record's hex form, either case; nulls where it isn't 128 digits."""
    ok, out, at = text.rlike("^[0-9A-Fa-f]{128}$"), {}, 1
    for name, n in RECORD:
        part = F.substring(text, at, 2 * n)
        at += 2 * n
        value = F.lower(part) if name == "hash" else code_from_hex(part, 0) if n == 8 else F.conv(part, 16, 10).cast("long")
        out[name] = F.when(ok, value)
    return out
