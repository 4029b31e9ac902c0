"""Digests against brute force, likeness over all lengths, and ids with gaps."""

import hashlib
import math
from collections import Counter

import numpy as np

from lodestrand.llm import fingerprint as f

RNG = np.random.default_rng(5)
WORDS = ["".join(RNG.choice(list("abcdefghijklmnoprstuvw"), RNG.integers(2, 9))) for _ in range(400)]


def text(n):
    return " ".join(WORDS[i] for i in RNG.integers(0, 400, n))


def entropy_class(window):
    top = round(f.WINDOW * math.log2(f.WINDOW) * 4096)
    return (top - sum(round(c * math.log2(c) * 4096) for c in Counter(window).values())) * 1000 // top


def brute_counts(texts):
    return Counter(entropy_class(t[i : i + f.WINDOW]) for t in texts for i in range(len(t) - f.WINDOW + 1))


def brute_ranks(counts):
    order = sorted(range(f.LEAST, f.CLASSES), key=lambda c: (counts[c], c))
    return {c: i for i, c in enumerate(order)}


def brute_digest(t, ranks):
    n = len(t) - f.WINDOW + 1
    rank = [ranks.get(entropy_class(t[i : i + f.WINDOW]), f.NEVER) for i in range(n)]
    popular = Counter()
    for a in range(max(1, n - f.NEAR + 1) if n > 0 else 0):
        i = min(range(a, min(n, a + f.NEAR)), key=lambda i: (rank[i], i))
        if rank[i] < f.NEVER:
            popular[i] += 1
    at = sorted(i for i, c in popular.items() if c >= f.POPULAR or n < f.NEAR)
    bits, seen = [], []
    hashes = f._hashes(np.frombuffer(t, np.uint8), np.array(at, np.int64)).tolist() if at else [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little")] * bool(t)
    for h in hashes:
        if h in seen:
            continue
        if len(seen) % f.FULL == 0:
            bits.append(set())
        seen.append(h)
        bits[-1] |= {h >> 11 * i & 2047 for i in range(f.HASHES)}
    return [sorted(b) for b in bits]


def test_digest_equals_brute_force(spark):
    texts = [text(int(n)).encode() for n in (1, 2, 3, 5, 9, 30, 200, 3000)] + [b"", b"aaaaaaaa" * 20, b"x" * 24, "é漢字 😀".encode() * 30]
    counts = brute_counts(texts)
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string").repartition(3)
    ranks = f.ranked(df)
    assert np.array_equal(ranks, f.ranks_of(np.array([counts[c] for c in range(f.CLASSES)])))
    want = brute_ranks(counts)
    for t in texts:
        got = [np.flatnonzero(r).tolist() for r in f.digest(t, ranks)]
        assert got == brute_digest(t, want), t[:40]


def test_likeness_has_no_steps(spark):
    long = text(4000).encode()
    ranks = f.ranks_of(sum(f.tallied(long[i : i + 5000]) for i in range(0, len(long), 5000)))
    d = lambda t: f.digest(t.encode(), ranks)
    a, b = text(900), text(900)
    for n in (200, 500, 1000, 1024, 1030, 1100, 2000, 4100):
        assert f.likeness(d(a[:n]), d(a[: n - 12])) > 0.8 and f.likeness(d(a[:n]), d(b[: n - 12])) < 0.3, n
    assert f.likeness(d(a[:90]), d(a[:4000])) > 0.6
    assert f.likeness(d(""), d(a)) == 0 and f.likeness(d("x" * 1030), d("y")) == 0 and f.likeness(d(""), d("")) == 1


def brute_next(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1] or ""))
    return Counter((i, hashlib.sha256(f.edited(t or "", order[(k + 1) % len(order)][1] or "").encode()).hexdigest()) for k, (i, t) in enumerate(order))


def test_next_documents_over_any_ids(spark):
    ids = [*range(40), 2**40, 2**40 + 1, -(2**63), 2**63 - 1, None, None, 7, 7]
    rows = [(i, text(3)) for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for n in (3, 8, 2048):
        got = f.with_next(df, n)
        assert n == 2048 or got.select("slot").distinct().count() > 4
        made = f.arrow_map(got, lambda it: (f.pa.RecordBatch.from_pylist([{"a": i, "t": hashlib.sha256(f.edited(t, o).encode()).hexdigest()} for i, t, o in f._pairs(it)] or [], schema=f.pa.schema([("a", f.pa.int64()), ("t", f.pa.string())])) for _ in (0,)), "a long, t string")
        assert Counter((r.a, r.t) for r in made.collect()) == brute_next(rows)
    for kind, cast in (("string", str), ("int", int), ("decimal(20,0)", int)):
        named = df.filter("doc_id between 0 and 39").withColumn("doc_id", df["doc_id"].cast(kind))
        assert f.fingerprints(named).count() == 42
