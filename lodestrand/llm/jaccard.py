"""Exact n-gram Jaccard self-join with a token-group matrix.

Tokens are 64-bit hashes of word n-grams. Texts with equal sets are one class. Classes are put into groups
of similar ones, each with the union of its members' tokens. A query meets a group only if
they share enough tokens of their prefixes (under one global order of tokens, a set's first
n - ceil(t n) + k tokens hold k of every set it can be linked to, k growing with n); then the group's union bounds the
overlap that any member can have with the query, and only groups whose bound reaches the threshold are
opened and their members compared.

The global order puts rare tokens first. It is (kind, document frequency, hash): of sets above `small` tokens
a fixed quarter of the hash space is counted exactly and comes first, others follow by hash, tokens that
a thousandth of all documents share come last. Tokens that only one class has can't link anything; a class
whose prefix holds nothing else is done after one shuffle. Frequencies saturate at `run` so that no
token's holders need to be in memory at once. Groups are split so that none holds more than `group_tokens`
tokens (or one class); pairs of groups are compared in tasks of bounded size, by matrix products.

Results are exact but for collisions of 64-bit hashes. Defined results: null text, or text of white
space: n_shingles 0, no links, its own component; fewer words than n: the sequence as the one token;
equal sets are linked with each other; repeated rows are documents of their own; null ids are kept and
never named as a component unless alone; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import AT_END, arrow_map, cut, pieces, text_of

U = np.uint64
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=U)
_BAND = U(0x5851F42D4C957F2D)


def least(n):  # noqa: ANN001, ANN201
    """How many tokens linked sets share at least within prefixes of n - ceil(t n) + least(n) tokens."""
    return 1 + n // 64


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(w)
        if len(self) > 200_000:
            self.clear()
        self[w] = h
        return h


_WORDS = _Words()
AT_END.append(_WORDS.clear)


def shingles(text: str, n: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII only, both
    if not words:
        return np.zeros(0, U)
    w = np.fromiter(map(_WORDS.__getitem__, words), U, len(words))
    k = min(n, len(w))
    m = len(w) - k + 1
    h = np.full(m, U(k * int(_MUL[7]) & (1 << 64) - 1))
    for i in range(k):
        h += w[i : i + m] * _MUL[i % 7] * U(2 * (i // 7) + 1)
    h ^= h >> U(31)
    h *= U(0x7FB5D329728EA185)
    h ^= h >> U(27)
    h *= U(0x81DADEF4BC2DD44D)
    h ^= h >> U(33)
    return np.unique(h)


def _name(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _key(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


def _profile(batches: Iterator[pa.RecordBatch], n: int, id_type: pa.DataType, block: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, name, n) of documents, and (token, count) of tokens that are frequent in a block of documents."""
    schema = pa.schema([("doc_id", id_type), ("name", pa.binary()), ("n", pa.int64()), ("token", pa.int64()), ("count", pa.int64())])
    held: list[np.ndarray] = []
    size = 0

    def frequent() -> pa.RecordBatch | None:
        t, c = np.unique(np.concatenate(held), return_counts=True)
        keep = c >= max(4, len(held) // 1000)
        k = int(keep.sum())
        return pa.RecordBatch.from_arrays([pa.nulls(k, id_type), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.array(t[keep].view(np.int64)), pa.array(c[keep].astype(np.int64))], schema=schema)

    for b in pieces(batches, "text"):
        names, sizes = [], []
        for text in b.column("text").to_pylist():
            h = shingles(text, n)
            names.append(_name(h))
            sizes.append(len(h))
            held.append(h)
            size += len(h)
            if size >= block:
                yield frequent()
                held, size = [], 0
        k = b.num_rows
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], schema=schema)
    if held:
        yield frequent()


def _emit(batches: Iterator[pa.RecordBatch], n: int, hot: np.ndarray, num: int, den: int, small: int, part: int) -> Iterator[pa.RecordBatch]:
    """Rows (token, key, meta) that may be in the prefix of a class; meta packs kind, band, set size and number counted."""
    seen: set[bytes] = set()
    for b in pieces(batches, "text"):
        toks, keys, metas, counts = [], [], [], []
        for text in b.column("text").to_pylist():
            h = shingles(text, n)
            if not len(h):
                continue
            name = _name(h)
            if name in seen:
                continue
            if len(seen) > 200_000:
                seen.clear()
            seen.add(name)
            size = len(h)
            prefix = size - -(-size * num // den) + least(size)
            at = np.minimum(np.searchsorted(hot, h), max(0, len(hot) - 1))
            is_hot = hot[at] == h if len(hot) else np.zeros(size, bool)
            for band in (0, 1):  # sets of up to `small` tokens meet in band 0, others and those they may be linked to in band 1
                if (size > small) if band == 0 else (size * den < small * num):
                    continue
                first = ~is_hot & ((h % U(part) == 0) | (band == 0))
                e = int(first.sum())
                kind = np.zeros(e, np.int64)
                t = h[first]
                if e < prefix:
                    more = h[~first & ~is_hot][: prefix - e]
                    last = h[is_hot][: max(0, prefix - e - len(more))]
                    t = np.concatenate([t, more, last])
                    kind = np.concatenate([kind, np.ones(len(more), np.int64), np.full(len(last), 2, np.int64)])
                toks.append(t ^ _BAND if band else t)
                metas.append(kind << 60 | band << 59 | size << 29 | min(e, (1 << 29) - 1))
                keys.append(_key(name))
                counts.append(len(t))
        if toks:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(toks).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), counts)), pa.array(np.concatenate(metas))], names=["token", "key", "meta"])


def _shared(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (token, key): those whose token two keys or more have, with their number if counted, `run` at most."""
    tok = key = meta = np.zeros(0, np.int64)
    full = None  # a token whose first `run` rows have gone out

    def out(sel: np.ndarray, t: np.ndarray, k: np.ndarray, m: np.ndarray, freq: np.ndarray) -> pa.RecordBatch:
        t, k, m = t[sel], k[sel], m[sel]
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(m), pa.array(np.where(m >> 60 == 0, freq[sel], 0)), pa.array(t)], names=["key", "meta", "freq", "token"])

    def done(t: np.ndarray, k: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
        t, k, m = t[new], k[new], m[new]
        start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        count = np.diff(np.append(start, len(t)))
        freq = np.repeat(np.minimum(count, run), count)
        return out(freq > 1, t, k, m, freq)

    for b in batches:
        t, k, m = (c.to_numpy() for c in b.columns)
        if full is not None and len(t):
            same = int(np.searchsorted(t, full, side="right")) if t[0] == full else 0
            if same:
                yield out(np.ones(same, bool), t[:same], k[:same], m[:same], np.full(same, run))
                t, k, m = t[same:], k[same:], m[same:]
            if len(t):
                full = None
        tok, key, meta = np.concatenate([tok, t]), np.concatenate([key, k]), np.concatenate([meta, m])
        if not len(tok):
            continue
        last = int(np.searchsorted(tok, tok[-1]))
        if last:
            yield done(tok[:last], key[:last], meta[:last])
            tok, key, meta = tok[last:], key[last:], meta[last:]
        if len(tok) >= run:
            yield out(np.ones(len(tok), bool), tok, key, meta, np.full(len(tok), run))
            full, tok, key, meta = tok[-1], tok[:0], key[:0], meta[:0]
    if len(tok):
        yield done(tok, key, meta)


def overlaps(a: list[np.ndarray], b: list[np.ndarray], num: int, den: int, above: int = 0, cells: int = 4_000_000) -> np.ndarray:
    """Which sets of a and b are linked, as a matrix; groups that their token unions rule out aren't opened.

    Of the two sets, one must have more than `above` tokens: pairs of small sets belong to the other band.
    """
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    union = np.unique(np.concatenate(b))
    # the bound: a query's tokens in the union of the group; a link needs num/den of the larger set
    at = [np.searchsorted(union, x) for x in a]
    inside = [y[union[np.minimum(y, len(union) - 1)] == x] for x, y in zip(a, at)]
    bound = np.array([len(x) for x in inside])
    open_ = np.flatnonzero(bound * den >= np.maximum(la, lb.min()) * num)
    linked = np.zeros((len(a), len(b)), bool)
    if not len(open_):
        return linked
    cols = [np.searchsorted(union, x) for x in b]
    common = np.zeros((len(open_), len(b)), np.float32)
    step = max(1, cells // (len(open_) + len(b)))
    for lo in range(0, len(union), step):
        hi = min(len(union), lo + step)
        p, q = np.zeros((len(open_), hi - lo), np.float32), np.zeros((len(b), hi - lo), np.float32)
        for r, i in enumerate(open_):
            x = inside[i]
            p[r, x[np.searchsorted(x, lo) : np.searchsorted(x, hi)] - lo] = 1
        for r, x in enumerate(cols):
            q[r, x[np.searchsorted(x, lo) : np.searchsorted(x, hi)] - lo] = 1
        common += p @ q.T
    c = common.astype(np.int64)
    linked[open_] = (c * den >= (la[open_][:, None] + lb[None, :] - c) * num) & (np.maximum(la[open_][:, None], lb[None, :]) > above)
    return linked


def _compare(batches: Iterator[pa.RecordBatch], num: int, den: int, small: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (group, slot, partner): a group's members, then those of each group it meets. Out: (cid, links, to): links to other classes, an edge or null."""
    task, other, band, rows = None, None, 0, ([], [])

    def ended() -> Iterator[pa.RecordBatch]:
        """What the group has with the one just read; the group with itself in its first slot alone."""
        left, right = rows
        if right or (task[1] == 0 and len(left) > 1 and other is None):
            yield result()

    def result() -> pa.RecordBatch:
        left, right = rows
        own = not right
        a = [np.frombuffer(x[2], U) for x in left]
        b = a if own else [np.frombuffer(x[2], U) for x in right]
        m = overlaps(a, b, num, den, small if band else 0)
        if own:
            np.fill_diagonal(m, False)
        wa, wb = np.array([x[1] for x in left]), np.array([x[1] for x in (left if own else right)])
        ids = [x[0] for x in left] + ([] if own else [x[0] for x in right])
        links = list(m @ wb) + ([] if own else list(wa @ m))
        # connected within this pair: one edge for each class, not one for each link
        root = list(range(len(ids)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        shift = 0 if own else len(left)
        for i, j in zip(*np.nonzero(m)):
            x, y = find(int(i)), find(int(j) + shift)
            if x != y:
                root[max(x, y)] = min(x, y)
        to = [ids[find(i)] if find(i) != i else None for i in range(len(ids))]
        keep = [i for i in range(len(ids)) if links[i]]
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], pa.int64()), pa.array([int(links[i]) for i in keep], pa.int64()), pa.array([to[i] for i in keep], pa.int64())], names=["cid", "links", "to"])

    for b in batches:
        for g1, slot, g2, which, cid, copies, blob in zip(*(c.to_pylist() for c in b.columns)):
            if (g1, slot) != task:
                if rows[0]:
                    yield from ended()
                task, other, band, rows = (g1, slot), None, which, ([], [])
            elif g2 != other:
                yield from ended()
                rows = (rows[0], [])
            other = g2
            side = rows[g2 is not None]
            if not side or side[-1][0] != cid:  # repeated rows of an id come one after another
                side.append((cid, copies, blob))
    if rows[0]:
        yield from ended()


def similar(docs: DataFrame, n: int = 5, percent: int = 80, small: int = 64, part: int = 4, run: int = 100_000, group_tokens: int = 250_000, partners: int = 32, hot_share: int = 1000, max_broadcast: int = 200_000) -> DataFrame:
    """doc_id, n_shingles, n_similar, component_id for each row of docs(doc_id, text), doc_id an integer."""
    spark = docs.sparkSession
    num, den = percent, 100
    kind = dict(docs.dtypes)["doc_id"]
    id_type = pa.int64()
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    profile = cut(arrow_map(src, lambda it: _profile(it, n, id_type), "doc_id long, name binary, n long, token long, count long"))
    rows = profile.filter("token is null").select("doc_id", "name", "n")
    total = rows.count()
    hot_rows = profile.filter("token is not null").groupBy("token").agg(F.sum("count").alias("c")).filter(F.col("c") >= max(64, total // hot_share))
    # at most hot_share x (mean set size) tokens; a million at most are told apart, which only orders tokens
    hot = np.sort(np.array([r[0] for r in hot_rows.orderBy(F.desc("c"), "token").limit(1_000_000).select("token").collect()], np.int64).view(U))
    classes = cut(rows.filter("n > 0").groupBy("name").agg(F.min("doc_id").alias("cid"), F.count("*").alias("copies")))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # each step ends in files of the shared folder; what it shuffled goes before the next one shuffles
    active = _freed(_active(src, n, hot, num, den, small, part, run, parts))
    grouped = _grouped(active, group_tokens, max_broadcast)
    pairs = _freed(_pairs(grouped, num, den))
    wanted = _wanted(grouped, pairs, classes, partners)
    work = _texts(src, wanted, max_broadcast).select("doc_id", "copies", "name", "at", "text")
    sets_of = arrow_map(work, lambda it: _blobs(it, n), "g1 long, slot long, g2 long, band int, cid long, copies long, blob binary")
    found = cut(arrow_map(sets_of.repartition(parts, "g1", "slot").sortWithinPartitions("g1", "slot", F.col("g2").asc_nulls_first(), "cid"), lambda it: _compare(it, num, den, small), "cid long, links long, to long"))
    del work, sets_of
    return _finish(rows, classes, _freed(found), kind, max_broadcast)


def _freed(df: DataFrame) -> DataFrame:
    """df, after shuffle files that nothing refers to are given up: Spark drops them when the driver collects its garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def _active(src: DataFrame, n: int, hot: np.ndarray, num: int, den: int, small: int, part: int, run: int, parts: int) -> DataFrame:
    """(key, band, n, seed, prefix) of the classes whose prefix holds enough tokens that others have."""
    hot_b = src.sparkSession.sparkContext.broadcast(hot)
    tokens = arrow_map(src.select("text"), lambda it: _emit(it, n, hot_b.value, num, den, small, part), "token long, key long, meta long")
    shared = arrow_map(tokens.repartition(parts, "token").sortWithinPartitions("token", "key"), lambda it: _shared(it, run), "key long, meta long, freq long, token long")
    # sent as they are: lists that tasks began would be longer, as most have one token
    field = lambda at, bits: F.shiftright("meta", at).bitwiseAND(F.lit((1 << bits) - 1))
    flat = shared.repartition("key").select("key", field(59, 1).cast("int").alias("band"), field(29, 30).alias("n"), field(0, 29).alias("e"), field(60, 2).cast("int").alias("kind"), "freq", "token")
    sets = flat.groupBy("key", "band").agg(F.first("n").alias("n"), F.first("e").alias("e"), F.collect_list(F.struct("kind", "freq", "token")).alias("t"))
    k = 1 + F.floor(F.col("n") / 64)  # least(n)
    prefix = F.col("n") - F.ceil(F.col("n") * num / den) + k
    unique = F.col("e") - F.size(F.filter("t", lambda x: x["kind"] == 0))
    return cut(sets.withColumn("need", (prefix - unique).cast("int")).filter((F.col("need") >= k) & (F.size("t") >= k)).select("key", "band", "n", _seed().alias("seed"), F.expr("transform(slice(array_sort(t), 1, need), x -> x.token)").alias("prefix")))


def _seed() -> Column:
    """The token that a class is grouped by, one that most texts similar to it have as well.

    Of a set that sends tokens all documents share, most are such: the first of them. Else the first of those that are
    about as frequent as the set's median token or more. Tokens of an edit that two texts happen to have in common would
    make a group for each, and all of these groups meet.
    """
    sign = -(1 << 63)
    at = F.when(F.col("band") == 1, F.lit(int((_BAND ^ U(1 << 63)).view(np.int64)))).otherwise(F.lit(sign))
    hot = F.array_min(F.transform(F.filter("t", lambda x: x["kind"] == 2), lambda x: x["token"].bitwiseXOR(at)))
    freq = F.array_sort(F.transform(F.filter("t", lambda x: x["kind"] == 0), lambda x: x["freq"]))
    median = F.try_element_at(freq, (F.size(freq) / 2).cast("int") + 1)
    once = F.array(F.struct(median.alias("median"), F.col("t")))  # within a lambda, it would be sorted for each token
    common = F.transform(once, lambda s: F.array_min(F.transform(F.filter(s["t"], lambda x: (x["kind"] == 0) & (x["freq"] * 2 >= s["median"])), lambda x: x["token"])))[0]
    return F.coalesce(hot, common, F.array_min(F.transform("t", lambda x: x["token"])))


def _grouped(active: DataFrame, group_tokens: int, max_broadcast: int) -> DataFrame:
    """(key, n, g, band, prefix): the classes of a seed, split into groups of about group_tokens tokens."""
    seeds = cut(active.groupBy("seed", "band").agg(F.ceil(F.sum("n") / group_tokens).alias("chunks"), F.count("*").alias("rows")))
    return cut(_join(active, seeds, ["seed", "band"], "inner", max_broadcast).select("key", "n", F.xxhash64("seed", "band", F.pmod("key", "chunks")).alias("g"), "band", "prefix"))


def _pairs(grouped: DataFrame, num: int, den: int) -> DataFrame:
    """(g1, g2): groups that share enough tokens of their prefixes, and groups of two classes or more with themselves."""
    # one shuffle by token does for the groups of a token and for their number
    by = grouped.select("g", "n", F.explode("prefix").alias("token")).repartition("token")
    matrix = by.groupBy("token", "g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    matrix = cut(matrix.withColumn("groups", F.count("*").over(Window.partitionBy("token"))).filter("groups > 1").drop("groups"))
    a, b = (matrix.select("token", *[F.col(c).alias(f"{c}{s}") for c in ("g", "lo", "hi")]) for s in "12")
    fits = (F.col("g1") < F.col("g2")) & (F.col("hi1") * den >= F.col("lo2") * num) & (F.col("hi2") * den >= F.col("lo1") * num)
    both = a.join(b, "token").filter(fits).groupBy("g1", "g2").agg(F.count("*").alias("common"), F.min(F.least("lo1", "lo2")).alias("lo"))
    pairs = both.filter(F.col("common") >= 1 + F.floor(F.col("lo") / 64)).select("g1", "g2")
    selves = grouped.groupBy("g").count().filter("count > 1").select(F.col("g").alias("g1"), F.col("g").alias("g2"))
    return cut(pairs.unionByName(selves))


def _wanted(grouped: DataFrame, pairs: DataFrame, classes: DataFrame, partners: int) -> DataFrame:
    """(doc_id, copies, name, at): the classes that some pair of groups needs, and the tasks that their sets are sent to."""
    # a task opens a group and all groups that it meets: its own members are sent once for `partners` of these
    slots = pairs.groupBy("g1").agg(F.ceil(F.count("*") / partners).alias("slots"))
    left = slots.select(F.col("g1").alias("g"), F.col("g1"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"), F.lit(None).cast("long").alias("g2"))
    right = pairs.filter("g1 <> g2").join(slots, "g1").select(F.col("g2").alias("g"), "g1", F.pmod(F.xxhash64("g2"), "slots").alias("slot"), "g2")
    tasks = left.unionByName(right)
    places = grouped.select("key", "g", "band").join(tasks, "g").groupBy("key").agg(F.collect_list(F.struct("g1", "slot", "g2", "band")).alias("at"))
    keyed = classes.withColumn("key", _key_udf()("name"))
    return cut(keyed.join(places, "key").select(F.col("cid").alias("doc_id"), "copies", "name", "at"))


def _join(big: DataFrame, small: DataFrame, on: list[str], how: str, most: int, hot: int = 10_000) -> DataFrame:
    """Join with a table of one row a key, whose column `rows` has the key's rows in big; 'left' or 'inner'.

    The table is broadcast if it has at most `most` rows. Else only keys of more than `hot` rows are (there are few, and no
    partition should get all rows of one), and the others are joined by a shuffle that sends every row once.
    """
    if small.limit(most + 1).count() <= most:
        return big.join(F.broadcast(small.drop("rows")), on, how)
    many = F.broadcast(small.filter(F.col("rows") > hot).drop("rows"))
    few = small.filter(F.col("rows") <= hot).drop("rows")
    return big.join(many, on, "inner").unionByName(big.join(many, on, "left_anti").join(few, on, how))


def _texts(src: DataFrame, wanted: DataFrame, most: int, max_bytes: int = 64 << 20) -> DataFrame:
    """wanted with the texts of its ids. Too large to broadcast, it is joined by a shuffle of those texts that pass a Bloom filter of its ids, not of all."""
    rows, width = wanted.agg(F.count("*"), F.coalesce(F.sum(48 + 32 * F.size("at")), F.lit(0))).first()
    if rows <= most and width <= max_bytes:
        return src.join(F.broadcast(wanted), "doc_id")
    return _passing(src.filter("doc_id is not null"), _bloom(wanted)).join(wanted, "doc_id")


def _bits(bits: int = 27) -> list[Column]:
    h = F.xxhash64(F.col("doc_id").cast("long"))
    return [F.shiftright(h, at).bitwiseAND(F.lit((1 << bits) - 1)) for at in (0, bits)]


def _bloom(ids: DataFrame, bits: int = 27) -> Broadcast:
    """A Bloom filter of ids(doc_id), of two bits each: 16 MB go to the tasks, however many ids there are."""
    word = F.expr("bit_or(shiftleft(1L, cast(b % 32 as int)))")
    ones = ids.select(F.explode(F.array(*_bits(bits))).alias("b")).groupBy((F.col("b") / 32).cast("int").alias("w")).agg(word.alias("v")).toArrow()
    words = np.zeros(1 << (bits - 5), np.int64)
    words[ones.column("w").to_numpy()] = ones.column("v").to_numpy()
    return ids.sparkSession.sparkContext.broadcast(words.astype(np.uint32))


def _passing(df: DataFrame, bloom: Broadcast, passing: bool = True) -> DataFrame:
    """Rows of df whose doc_id passes a Bloom filter, or those whose doc_id doesn't."""
    names = df.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bloom.value
        for b in batches:
            p, q = (b.column(c).to_numpy() for c in ("_p", "_q"))
            held = words[p >> 5] >> (p & 31).astype(np.uint32) & words[q >> 5] >> (q & 31).astype(np.uint32) & 1
            keep = (held == 1) == passing
            if keep.any():
                yield b.select(names).filter(pa.array(keep))

    p, q = _bits()
    return arrow_map(df.withColumns({"_p": p, "_q": q}), rows, df.schema)


def split(docs: DataFrame, ids: DataFrame, most: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """The rows of docs whose doc_id is in ids(doc_id), and the others, null ids among them.

    If ids are too many to broadcast, rows that a Bloom filter of them rules out aren't sent.
    """
    if ids.limit(most + 1).count() <= most:
        return tuple(docs.join(F.broadcast(ids), "doc_id", how).select(*docs.columns) for how in ("left_semi", "left_anti"))
    ids = cut(ids)
    bloom = _bloom(ids)
    maybe = _passing(docs, bloom)
    found, rest = (maybe.join(ids, "doc_id", how).select(*docs.columns) for how in ("left_semi", "left_anti"))
    return found, rest.unionByName(_passing(docs, bloom, False))


def _key_udf():  # noqa: ANN202
    @F.pandas_udf("long")
    def key(names: pd.Series) -> pd.Series:
        return pd.Series([_key(x) for x in names], dtype="int64")

    return key


def _blobs(batches: Iterator[pa.RecordBatch], n: int, most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """A row for each task that a class is sent to, in batches of about `most` bytes."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    rows, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["g1", "slot", "g2", "band", "cid", "copies", "blob"])

    for b in pieces(batches, "text"):
        for cid, copies, name, at, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "copies", "name", "at", "text"))):
            h = shingles(text, n)
            if _name(h) != name:  # an id may be repeated with another text
                continue
            blob = h.tobytes()
            for x in at:
                rows.append((x["g1"], x["slot"], x["g2"], x["band"], cid, copies, blob))
                size += len(blob)
                if size >= most:
                    yield out()
                    rows, size = [], 0
    if rows:
        yield out()


def _finish(rows: DataFrame, classes: DataFrame, found: DataFrame, kind: str, max_broadcast: int) -> DataFrame:
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comp = components(found.filter("to is not null").select(F.col("cid").alias("a"), F.col("to").alias("b"))).withColumnRenamed("id", "cid")
    # per class: its least id, links to other classes, component; classes of one document without links need no row
    info = classes.join(links, "cid", "left").join(comp, "cid", "left").filter("copies > 1 or links > 0")
    info = cut(info.select("name", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_similar"), F.coalesce("component", "cid").alias("component"), F.col("copies").alias("rows")))
    # a class goes by its least id, so the least label of a component is its least document id
    out = _join(rows, info, ["name"], "left", max_broadcast)
    return out.select(F.col("doc_id").cast(kind), F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), F.coalesce("component", "doc_id").cast(kind).alias("component_id"))
