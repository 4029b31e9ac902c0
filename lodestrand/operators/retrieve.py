"""Retrieval over all pairs without joining rows with rows: blocks of vectors or codes are compared as matrices.

Rows are packed into blocks of `block` rows, and blocks into stripes. Each pair of stripes is a tile, which is a task of its
own: it holds both stripes, of bounded size, and compares them by matrix products in single precision, for codes of
bits as +1 and -1 (exact) and for vectors of length one. Vectors that may qualify are few; their cosines are then taken
in double precision in the order of their places, the same for the same vectors wherever they lie.
What leaves a task is bounded: k rows a query and tile, or a row for each record, or the pairs that qualify.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship, trim

#: Rows of a product, at most: with a block of 4,096 it is 8 MB.
CHUNK = 512
#: Rows of a stripe of queries and of a stripe of either side of a half, at most, and bytes of a stripe of the base.
QUERIES, SIDE, STRIPE_BYTES = 16_384, 32_768, 64 << 20
#: Tiles, where there are as many blocks; rows of a batch that leaves a task, about.
LEAST_TILES, MOST_ROWS = 32, 1 << 18


class Blocks:
    """rows: (block, ids, data), n blocks of about `count` rows in all, written once; width: values or words of a row, of `dtype`."""

    def __init__(self, df: DataFrame, idx: str, value: str, metric: str, block: int, group: str | None):
        some = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull() if group else F.col(value).isNotNull())
        first = some.select(value).first()
        self.width = len(first[0]) if first else 1
        self.dtype = np.int64 if metric == "hamming" else np.float64 if "double" in dict(df.dtypes)[value] else np.float32
        self.count = some.count()
        self.n = max(1, -(-self.count // block))
        self.rows = cut(_packed(some, idx, value, self.n, self.width, self.dtype, group))

    @property
    def row_bytes(self) -> int:
        return self.width * np.dtype(self.dtype).itemsize + 16


def _packed(some: DataFrame, idx: str, value: str, n: int, width: int, dtype: type, group: str | None) -> DataFrame:
    """(block, ids, data): the rows of each of n blocks as two binaries. With group, the 64-bit hash of that column goes after the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        now = None

        def out() -> pa.RecordBatch:
            ids = [np.concatenate([h[i] for h in held]) for i in range(1 + bool(group))]
            data = np.concatenate([h[2] for h in held])
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.concatenate(ids).tobytes()]), pa.array([data.tobytes()])], names=["block", "ids", "data"])

        for b in batches:
            if not b.num_rows:
                continue
            k, i, g = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            v = b.column(3)
            if (np.diff(v.offsets.to_numpy()) != width).any():
                raise ValueError(f"vectors of other lengths than {width}")
            v = v.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, width)
            edges = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
            for lo, hi in zip(edges, edges[1:]):
                if held and k[lo] != now:
                    yield out()
                    held = []
                now = int(k[lo])
                held.append((i[lo:hi].astype(np.int64), g[lo:hi].astype(np.int64), v[lo:hi].copy()))
        if held:
            yield out()

    ship(some.sparkSession)
    rows = some.select(F.pmod(F.xxhash64(idx), F.lit(n)).alias("b"), F.col(idx).cast("long"), (F.xxhash64(group) if group else F.lit(0).cast("long")).alias("g"), value)
    return rows.repartition(min(n, 10_000), "b").sortWithinPartitions("b", idx).mapInArrow(run, "block long, ids binary, data binary")


Block = tuple[int, np.ndarray, np.ndarray]


def _tiles(a: Blocks, b: Blocks, f: Callable[[list[Block], list[Block]], Iterator[tuple]], schema: str, group: bool, half: bool = False) -> DataFrame:
    """f(blocks of a's stripe, blocks of b's stripe) over the tiles, whose arrays are of the schema; half: each unordered pair of stripes of a once.

    A block is its number, its ids (with group, ids and groups as two rows) and its data.
    """
    if half:
        gx = gy = min(a.n, max(8, -(-a.count // SIDE), -(-a.count * a.row_bytes // STRIPE_BYTES)))
    else:
        gy = min(b.n, max(1, -(-b.count * b.row_bytes // STRIPE_BYTES)))
        gx = min(a.n, max(-(-LEAST_TILES // gy), -(-a.count // QUERIES), -(-a.count * a.row_bytes // STRIPE_BYTES)))
    at = lambda n, g: F.floor(F.col("block") * g / n).cast("int")
    tile = (lambda x, y: x * (2 * gx - x - 1) / 2 + y) if half else (lambda x, y: x * gy + y)
    span = lambda lo, hi: F.explode(F.sequence(lo, hi).cast("array<int>"))
    zero, last = F.lit(0), F.lit(gy - 1)
    left = a.rows.withColumn("x", at(a.n, gx)).withColumn("y", span(F.col("x") if half else zero, last)).withColumn("side", F.lit(0))
    right = b.rows.withColumn("y", at(b.n, gy)).withColumn("x", span(zero, F.col("y") if half else F.lit(gx - 1))).withColumn("side", F.lit(1))
    cols = ["tile", "side", "block", "ids", "data"]
    both = [d.withColumn("tile", tile(F.col("x"), F.col("y")).cast("int")).select(*cols) for d in (left, right)]
    tiles = gx * (gx + 1) // 2 if half else gx * gy
    work = both[0].unionByName(both[1]).repartitionById(tiles, F.col("tile"))
    names, (wa, da), (wb, db) = [s.split()[0] for s in schema.split(", ")], (a.width, a.dtype), (b.width, b.dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list[Block], list[Block]] = [], []
        for batch in batches:
            for side, block, ids, data in zip(*(c.to_pylist() for c in batch.columns[1:])):
                i = np.frombuffer(ids, np.int64)
                sides[side].append((block, i.reshape(2, -1) if group else i, np.frombuffer(data, db if side else da).reshape(-1, wb if side else wa)))
        if sides[0] and sides[1]:
            for got in f(*(sorted(s, key=lambda x: x[0]) for s in sides)):
                if len(got[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=names)
        sides[0].clear(), sides[1].clear()
        trim()

    return work.mapInArrow(run, schema)


def _signs(words: np.ndarray) -> np.ndarray:
    """Codes of 64-bit words as +1 and -1: half of what the bits are more than a product is their distance."""
    out = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1).astype(np.float32)
    out *= 2
    out -= 1
    return out


def _units(v: np.ndarray) -> np.ndarray:
    """Vectors of length one in single precision; zero vectors stay."""
    v = v.astype(np.float64)
    n = np.sqrt((v * v).sum(axis=1))
    with np.errstate(invalid="ignore"):
        return (v / np.where(n == 0, 1, n)[:, None]).astype(np.float32)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows, summed place after place: equal vectors have equal ones. 0 where either is zero."""
    out = np.empty(len(a))
    for lo in range(0, len(a), 1 << 14):
        x, y = (np.ascontiguousarray(z[lo : lo + (1 << 14)].T, np.float64) for z in (a, b))
        dot, nx, ny = (np.zeros(x.shape[1]) for _ in range(3))
        for i in range(len(x)):
            dot += x[i] * y[i]
            nx += x[i] * x[i]
            ny += y[i] * y[i]
        scale = np.sqrt(nx * ny)
        with np.errstate(invalid="ignore"):
            out[lo : lo + (1 << 14)] = np.where(scale > 0, np.clip(dot / np.where(scale > 0, scale, 1), -1, 1), np.where(scale == 0, 0.0, np.nan))
    return out


def _off(width: int) -> float:
    """By how much a cosine in single precision may be off, of vectors of length one."""
    return max(1e-5, 1.5e-7 * width)


def _ready(metric: str) -> Callable[[np.ndarray], np.ndarray]:
    return _signs if metric == "hamming" else _units


def _cost(metric: str, x: np.ndarray, y: np.ndarray, near: np.ndarray, bits: int) -> np.ndarray:
    """What the nearest have least: distances, or cosines with the other sign; of rows with rows that have the products `near`."""
    return (bits - near.astype(np.float64)) / 2 if metric == "hamming" else -_cosine(x, y)


class _Best:
    """The k of least cost of each of some queries, ties by id, of blocks that come one after another."""

    def __init__(self, q: Block, k: int, metric: str, group: bool, own: bool, after: bool, within: float):
        _, ids, self.data = q
        self.ids, self.groups = (ids[0], ids[1]) if group else (ids, None)
        self.k, self.metric, self.own, self.after, self.within = k, metric, own, after, within
        self.side, self.bits, self.off = _ready(metric)(self.data), 64 * self.data.shape[1], _off(self.data.shape[1])
        self.cost = np.full((len(self.ids), k), np.inf)
        self.found = np.zeros((len(self.ids), k), np.int64)

    def _out(self, i: np.ndarray, g: np.ndarray | None, j: np.ndarray, h: np.ndarray | None) -> np.ndarray:
        """Where neither may be the other's neighbour."""
        bad = j <= i if self.after else j == i if self.own else np.zeros(np.broadcast(i, j).shape, bool)
        return bad if g is None else bad | (g == h)

    def _least(self, cost: np.ndarray) -> np.ndarray:
        """The product that a row must reach to cost no more than this."""
        return self.bits - 2 * cost if self.metric == "hamming" else -cost - self.off

    def add(self, ids: np.ndarray, groups: np.ndarray | None, data: np.ndarray, side: np.ndarray) -> None:
        k, g = self.k, self.groups
        for lo in range(0, len(self.ids), CHUNK):
            rows = slice(lo, lo + CHUNK)
            s = self.side[rows] @ side.T
            least = self._least(np.minimum(self.cost[rows, -1], self.within)).astype(np.float32)[:, None]
            may = s >= least
            if np.count_nonzero(may) > 4 * k * len(s):  # at first: what the kth of this block alone has is a bound
                t = np.where(may, s, -np.inf)
                t[self._out(self.ids[rows, None], None if g is None else g[rows, None], ids[None], None if g is None else groups[None])] = -np.inf
                if t.shape[1] > k:
                    kth = np.partition(t, t.shape[1] - k, axis=1)[:, t.shape[1] - k, None]
                    may = (t >= kth - (0 if self.metric == "hamming" else 2 * self.off)) & (t > -np.inf)
                else:
                    may = t > -np.inf
            flat = np.flatnonzero(may)
            if not len(flat):
                continue
            near, r, c = s.ravel()[flat], flat // s.shape[1] + lo, flat % s.shape[1]
            ok = ~self._out(self.ids[r], None if g is None else g[r], ids[c], None if g is None else groups[c])
            near, r, c = near[ok], r[ok], c[ok]
            cost = np.concatenate([_cost(self.metric, self.data[r[i : i + MOST_ROWS]], data[c[i : i + MOST_ROWS]], near[i : i + MOST_ROWS], self.bits) for i in range(0, len(r), MOST_ROWS)] or [np.zeros(0)])
            ok = cost <= np.minimum(self.cost[r, -1], self.within)  # not where it is no number
            self._merge(r[ok], cost[ok], ids[c[ok]])

    def _merge(self, r: np.ndarray, cost: np.ndarray, ids: np.ndarray) -> None:
        if not len(r):
            return
        own = np.unique(r)
        r, cost, ids = np.concatenate([np.repeat(own, self.k), r]), np.concatenate([self.cost[own].ravel(), cost]), np.concatenate([self.found[own].ravel(), ids])
        order = np.lexsort((ids, cost, r))
        r, cost, ids = r[order], cost[order], ids[order]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        keep = nth < self.k  # k of each at least: there were as many before
        self.cost[own], self.found[own] = cost[keep].reshape(-1, self.k), ids[keep].reshape(-1, self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, c = np.nonzero(np.isfinite(self.cost))
        cost = self.cost[r, c]
        return self.ids[r], self.found[r, c], cost if self.metric == "hamming" else -cost


def _nearest(a: Blocks, b: Blocks, k: int, metric: str, group: bool = False, own: bool = True, after: bool = False, within: float = np.inf) -> DataFrame:
    """(query, idx, score) of each query's k nearest of each tile."""
    ready = _ready(metric)

    def best(left: list[Block], right: list[Block]) -> Iterator[tuple]:
        held = [_Best(q, k, metric, group, own, after, within) for q in left]
        for _, ids, data in right:
            side = ready(data)
            for h in held:
                h.add(*((ids[0], ids[1]) if group else (ids, None)), data, side)
        for h in held:
            yield h.rows()

    return _tiles(a, b, best, "query long, idx long, score double", group)


def knn(queries: DataFrame, base: DataFrame, k: int, value: str, metric: str = "cosine", idx: str = "idx", exclude_self: bool = True, block: int = 2048, apart: str | None = None) -> DataFrame:
    """(query, idx, score, rank): the k nearest of each query, ties by idx. metric: cosine (of vectors) or hamming (of code words).

    apart: a column of both sides; rows of the query's own value (its book, its owner) aren't neighbours.
    """
    b = Blocks(base, idx, value, metric, block, apart)
    a = b if queries is base else Blocks(queries, idx, value, metric, block, apart)
    found = _nearest(a, b, k, metric, bool(apart), exclude_self)
    order = F.col("score").desc() if metric == "cosine" else F.col("score").asc()
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(order, "idx"))).filter(F.col("rank") <= k)


class Sets:
    """Disjoint sets of 0 to n - 1; root: a member of each one's set."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            x, y = self.root[x], self.root[y]
            apart = x != y
            if not apart.any():
                return
            x, y = x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def _near(left: list[Block], right: list[Block], metric: str, bound: float, group: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(x, y, r, c): rows r of left[x] and c of right[y] that may be at no more than a cost; each unordered pair of blocks once, a chunk at a time."""
    ready, sides = _ready(metric), [_ready(metric)(d) for _, _, d in left]
    for y, (n2, i2, d2) in enumerate(right):
        s2 = ready(d2)
        least = np.float32(64 * d2.shape[1] - 2 * bound if metric == "hamming" else -bound - _off(d2.shape[1]))
        for x, (n1, i1, _) in enumerate(left):
            if n1 > n2:
                continue
            for lo in range(0, len(sides[x]), CHUNK):
                may = sides[x][lo : lo + CHUNK] @ s2.T >= least
                if group:
                    may &= i1[1, lo : lo + CHUNK, None] == i2[1]
                flat = np.flatnonzero(may)
                for at in range(0, len(flat), MOST_ROWS):
                    r, c = np.divmod(flat[at : at + MOST_ROWS], len(s2))
                    yield x, y, r + lo, c


def _qualifying(left: list[Block], right: list[Block], metric: str, bound: float, group: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, cost) of pairs at no more than a cost, a < b."""
    for x, y, r, c in _near(left, right, metric, bound, group):
        (n1, i1, d1), (n2, i2, d2) = left[x], right[y]
        a, b = (i1[0][r], i2[0][c]) if group else (i1[r], i2[c])
        if n1 == n2:
            ok = a < b
            a, b, r, c = a[ok], b[ok], r[ok], c[ok]
        cost = -_cosine(d1[r], d2[c]) if metric == "cosine" else np.bitwise_count((d1[r] ^ d2[c]).view(np.uint64)).sum(axis=1, dtype=np.int32)
        if metric == "cosine":
            ok = cost <= bound
            a, b, cost = a[ok], b[ok], cost[ok]
        yield np.minimum(a, b), np.maximum(a, b), cost


def near_pairs(records: DataFrame, radius: int, words: int = 2, idx: str = "idx", value: str = "code", block: int = 2048, within: str | None = None) -> DataFrame:
    """(a, b, distance), a < b, of all pairs within radius bits. Exact at any radius.

    within: a column (a label); only pairs that have one value of it, and no null, are made.
    """

    def pairs(left: list[Block], right: list[Block]) -> Iterator[tuple]:
        return _qualifying(left, right, "hamming", radius, bool(within))

    blocks = Blocks(records, idx, value, "hamming", block, within)
    return _tiles(blocks, blocks, pairs, "a long, b long, distance int", bool(within), half=True)


def nearest_pairs(records: DataFrame, radius: int, most: int, idx: str = "idx", value: str = "code", block: int = 2048) -> DataFrame:
    """capped(near_pairs(...), most) of which no task keeps more than `most` a record: (a, b, distance)."""
    b = Blocks(records, idx, value, "hamming", block, None)
    found = _nearest(b, b, most, "hamming", after=True, within=radius)
    return capped(found.select(F.col("query").alias("a"), F.col("idx").alias("b"), F.col("score").cast("int").alias("distance")), most)


def near_links(records: DataFrame, radius: int, idx: str = "idx", value: str = "code", block: int = 2048) -> DataFrame:
    """(a, b) that join what near_pairs within the radius joins: from each tile a row at most for each of its records, to the least of its component."""

    def links(left: list[Block], right: list[Block]) -> Iterator[tuple]:
        ids = np.concatenate([i for _, i, _ in [*left, *right]])
        sets = Sets(len(ids))
        starts = np.cumsum([0, *(len(i) for _, i, _ in [*left, *right])])
        for x, y, r, c in _near(left, right, "hamming", radius):
            sets.join(starts[x] + r, starts[len(left) + y] + c)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, sets.root, ids)
        a, b = ids, least[sets.root]
        yield a[a != b], b[a != b]

    blocks = Blocks(records, idx, value, "hamming", block, None)
    return _tiles(blocks, blocks, links, "a long, b long", False, half=True)


def cosine_pairs(vectors: DataFrame, least: float, idx: str = "idx", value: str = "vec", block: int = 2048) -> DataFrame:
    """(a, b, cosine), a < b, of all pairs at or above a cosine."""

    def pairs(left: list[Block], right: list[Block]) -> Iterator[tuple]:
        return ((a, b, -c) for a, b, c in _qualifying(left, right, "cosine", -least))

    blocks = Blocks(vectors, idx, value, "cosine", block, None)
    return _tiles(blocks, blocks, pairs, "a long, b long, cosine double", False, half=True)


def banded_pairs(records: DataFrame, radius: int, words: int = 2, idx: str = "idx", bands: int | None = None) -> DataFrame:
    """(a, b, distance) within radius bits by bands that agree: an equi-join and a test.

    With radius + 1 bands (the default) one of them agrees for every pair, so nothing is missed; fewer bands
    are more selective and may miss pairs. For small radii; near_pairs is for the others.
    """
    bits = 64 * words
    n = bands or radius + 1
    edges = [round(i * bits / n) for i in range(n + 1)]
    cols = [F.col(f"lsh{i}") for i in range(words)]

    def band(lo: int, hi: int) -> Column:
        parts = []
        for w in range(words):
            a, b = max(lo, 64 * w), min(hi, 64 * w + 64)
            if a < b:
                shifted = F.shiftrightunsigned(cols[w], a - 64 * w)
                parts.append(shifted if b - a == 64 else shifted.bitwiseAND(F.lit((1 << (b - a)) - 1)))
        return F.hash(*parts) if len(parts) > 1 else parts[0].cast("long")

    keyed = records.select(F.col(idx).alias("id"), *cols, F.posexplode(F.array(*[band(edges[i], edges[i + 1]).cast("long") for i in range(n)])).alias("band", "key"))
    a, b = (keyed.select("band", "key", F.col("id").alias(s), *[c.alias(f"{s}{i}") for i, c in enumerate(cols)]) for s in "ab")
    d = lambda: sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(words)), F.lit(0))
    return a.join(b, ["band", "key"]).filter(F.col("a") < F.col("b")).withColumn("distance", d()).filter(F.col("distance") <= radius).groupBy("a", "b").agg(F.min("distance").alias("distance"))


def mutual(neighbours: DataFrame) -> DataFrame:
    """(a, b), a < b, of pairs that are each among the other's neighbours(query, idx)."""
    x = neighbours.select(F.col("query").alias("a"), F.col("idx").alias("b"))
    y = neighbours.select(F.col("idx").alias("a"), F.col("query").alias("b"))
    return x.join(y, ["a", "b"]).filter("a < b")


def rerank(shortlist: DataFrame, vectors: DataFrame, query: list[float], idx: str = "idx", pos: str = "pos") -> DataFrame:
    """A shortlist (idx, pos) by cosine with the query, descending; those without vector last, in their order."""
    from .vectors import cosine

    scored = shortlist.join(vectors.select(idx, "vec"), idx, "left").withColumn("cosine", cosine(F.col("vec"), F.array(*[F.lit(float(x)) for x in query])))
    return scored.drop("vec").orderBy(F.col("cosine").isNull(), F.col("cosine").desc(), pos)


def capped(pairs: DataFrame, most: int = 20) -> DataFrame:
    """Of the pairs of each first member, the `most` nearest, ties by id."""
    return pairs.withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))).filter(F.col("_n") <= most).drop("_n")
