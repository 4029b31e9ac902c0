"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target / source size. Its whole
part is taken outright. The fractional parts are rounded together: two documents are paired, and
words are moved between them at random, so that the words expected in total stay the same and
each document's expectation too, until one of the two is integral. The other one goes on to the next
pair. One residual per (source, salt) is left; residuals meet in a reduction tree (`fan_in` to one)
until each source has a single one, which goes to the nearer integer. As that may leave the
source off by half a long document, a last step flips at most one document per power-of-two size
class, largest first, where that brings the source closer to its target.

Defined results: null text and text of white space have size 0 and take nothing; a null source is a
source of its own, last in order; repeated rows are documents of their own; an empty table gives an
empty result; ties are ordered by id, size and hash; each level of the tree draws anew. Runs over the same rows agree, whatever their
partitioning, as salts, order and random numbers come from hashes of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_small, running, ship, text_of

ROW = "doc_id {id}, source string, size long, whole int, frac double, u double, salt long, copies int, rest double"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """(source, source_size, n_docs) -> with target: shares by weight, none above max_repeat times its size.

    The water level: sources in ascending order of cap/weight; the first k are at their caps, the others
    share the rest by weight. Places and sums in both orders are taken over ranges, however many sources there are.
    """
    named, _ = running(sizes.withColumn("last", F.col("source").isNull()), ["last", "source"])
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    t = named.withColumn("w", w).drop("idx").withColumn("cap", F.lit(float(max_repeat)) * F.col("source_size")).withColumn("at", F.col("cap") / F.col("w"))
    t, totals = running(t, ["at", "last", "source"], "cap", "w")
    if not totals[0]:
        return t.select("source", "source_size", "n_docs", F.col("cap").alias("target"))
    # the level if this source were the first one below its cap; that of the first such source in this order holds
    level = (totals[1] / max_repeat - F.col("before_cap")) / (totals[2] - F.col("before_w"))
    first = t.withColumn("level", level).filter(F.col("level") * F.col("w") <= F.col("cap")).agg(F.min(F.struct("idx", "level"))).first()[0]
    target = F.col("cap") if first is None else F.least(F.col("cap"), F.lit(first["level"]) * F.col("w"))
    return t.select("source", "source_size", "n_docs", target.alias("target"))


def pair(p: float, s: float, q: float, t: float, u: float) -> tuple[float, float]:
    """One pivotal step for documents of p of s and q of t words: new p and q, one of them 0 or 1."""
    a, b = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
    if u * (a + b) < b:
        return (1.0, q - a / t) if (1 - p) * s <= q * t else (p + a / s, 0.0)
    return (0.0, q + b / t) if p * s <= (1 - q) * t else (p - b / s, 1.0)


def _round(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (source, salt): each leaves with copies set, but one per group may keep `rest`."""
    EPS = 1e-9
    held: dict | None = None
    key: object = object()
    for d in batches:
        copies, rest = d["whole"].to_numpy().copy(), d["frac"].to_numpy(dtype=float).copy()
        size, u, salt = d["size"].to_numpy(), d["u"].to_numpy(), d["salt"].to_numpy()
        source = d["source"].where(d["source"].notna(), None).to_numpy()
        out_rest = [None] * len(d)
        late: list[dict] = []  # a row held over from an earlier batch
        cur = -1  # index of the row held in this batch
        for i in range(len(d)):
            k = (source[i], salt[i])
            if k != key:
                if cur >= 0:
                    out_rest[cur] = rest[cur]
                elif held is not None:
                    late.append(held)
                held, cur, key = None, -1, k
            if size[i] == 0 or rest[i] <= EPS or rest[i] >= 1 - EPS:
                copies[i] += int(size[i] > 0 and rest[i] >= 1 - EPS)
                continue
            if cur < 0 and held is None:
                cur = i
                continue
            p, s = (rest[cur], size[cur]) if cur >= 0 else (held["rest"], held["size"])
            p, q = pair(p, s, rest[i], size[i], u[i])
            first_done = p <= EPS or p >= 1 - EPS
            second_done = q <= EPS or q >= 1 - EPS
            if cur >= 0:
                rest[cur] = p
                copies[cur] += int(p >= 1 - EPS)
                if first_done:
                    cur = -1
            else:
                held["rest"] = p
                if first_done:
                    late.append(held | {"copies": held["copies"] + int(p >= 1 - EPS), "rest": None})
                    held = None
            if second_done:
                copies[i] += int(q >= 1 - EPS)
            else:
                rest[i] = q
                cur = i
        d = d.assign(copies=copies, rest=pd.Series(out_rest, index=d.index, dtype="float64"))
        if cur >= 0:
            held = d.iloc[cur].to_dict() | {"rest": float(rest[cur])}
            held["source"] = source[cur]
            d = d.drop(index=d.index[cur])
        yield d
        if late:
            yield pd.DataFrame(late, columns=d.columns).astype({"rest": "float64"})
    if held is not None:
        yield pd.DataFrame([held]).astype({"rest": "float64"})


def _level(rows: DataFrame, schema: str) -> DataFrame:
    """One level of the tree; durable, as its decided and its open rows go different ways."""
    by = ["source", "salt"]
    return cut(rows.repartition(*by).sortWithinPartitions(*by, "doc_id", "size", "u").mapInPandas(_round, schema))


def _chance(seed: int, level: int) -> Column:
    """A number between 0 and 1 for each row, another one at each level of the tree."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "size"), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, seed: int = 17, rows_per_salt: int = 20_000, fan_in: int = 32, max_sources: int = 200_000) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken for each row of docs(doc_id, text, source)."""
    spark = docs.sparkSession
    ship(spark)
    schema = ROW.format(id=dict(docs.dtypes)["doc_id"])
    # the text is read once; all that follows works on three narrow columns
    sized = cut(docs.select("doc_id", n_words(text_of(docs)).alias("size"), docs["source"].cast("string").alias("source")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = cut(source_targets(totals, weights, max_repeat))
    salts = F.ceil(F.col("n_docs") / F.lit(rows_per_salt)).cast("long")
    widest = targets.agg(F.max(salts)).first()[0] or 1
    keyed = targets.withColumnRenamed("source", "key").withColumn("key", F.struct("key"))
    joined = join_small(sized.withColumn("key", F.struct(F.col("source").alias("key"))), keyed, ["key"], "inner", max_sources)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    h = F.xxhash64("doc_id", "size", F.lit(seed))
    rows = joined.select(
        "doc_id", "source", "size", F.least(F.floor(rate), F.lit(max_repeat)).cast("int").alias("whole"), (rate - F.floor(rate)).alias("frac"),
        _chance(seed, 0).alias("u"), F.pmod(h, salts).alias("salt"),
        F.lit(0).alias("copies"), F.lit(None).cast("double").alias("rest"),
    )
    level = _level(rows, schema)
    decided, width = [level.filter("rest is null")], widest
    while width > 1:
        width = -(-width // fan_in)
        up = level.filter("rest is not null").withColumn("whole", F.col("copies")).withColumn("frac", F.col("rest")).withColumn("rest", F.lit(None).cast("double")).withColumn("u", _chance(seed, len(decided)))
        level = _level(up.withColumn("salt", F.floor(F.col("salt") / fan_in)), schema)
        decided.append(level.filter("rest is null"))
    last = level.filter("rest is not null").withColumn("copies", F.col("copies") + F.round("rest").cast("int"))
    out = decided[0]
    for d in [*decided[1:], last]:
        out = out.unionByName(d)
    out = cut(out.select("doc_id", "source", "size", "copies", "u"))
    fixed = _correct(out, targets, max_repeat)
    flips = fixed.select(F.struct(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("u").alias("r"), F.col("size").alias("n")).alias("id"), "flip")
    out = join_small(out.withColumn("id", F.struct(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("u").alias("r"), F.col("size").alias("n"))), flips, ["id"], "left", max_sources * 64)
    # of repeated rows one alone may flip
    nth = F.row_number().over(Window.partitionBy("id").orderBy("copies"))
    changed = out.filter("flip is not null").withColumn("n", nth).withColumn("copies", F.col("copies") + F.when(F.col("n") == 1, F.col("flip")).otherwise(0)).drop("n")
    out = out.filter("flip is null").unionByName(changed)
    out = join_small(out.withColumn("key", F.struct(F.col("source").alias("key"))), keyed, ["key"], "inner", max_sources)
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def _correct(out: DataFrame, targets: DataFrame, max_repeat: int) -> DataFrame:
    """(source, doc_id, u, size, flip): documents whose copies change by one to bring a source nearer its target.

    Candidates are aggregated first: one for each source, size class and direction, so a source has at
    most 2 x 63 of them however many rows it has.
    """
    row = F.struct("u", "doc_id", "size")
    up, down = F.col("copies") < max_repeat, F.col("copies") > 0
    bins = out.filter("size > 0").groupBy("source", F.floor(F.log2("size")).alias("bin")).agg(
        F.min(F.when(up, row)).alias("up"), F.min(F.when(down, F.struct((-F.col("u")).alias("m"), "u", "doc_id", "size"))).alias("down"), F.sum(F.col("copies") * F.col("size")).alias("taken"),
    )
    per = bins.groupBy("source").agg(F.sum("taken").alias("taken"), F.collect_list(F.struct("bin", "up.u", "up.doc_id", "up.size", F.col("down.u").alias("du"), F.col("down.doc_id").alias("did"), F.col("down.size").alias("dsize"))).alias("bins"))
    t = targets.select(F.col("source").alias("s2"), "target")
    per = per.join(t, per["source"].eqNullSafe(t["s2"])).withColumn("bins", F.reverse(F.array_sort("bins")))
    kind = dict(out.dtypes)["doc_id"]
    start = f"named_struct('gap', target - taken, 'flips', cast(array() as array<struct<u:double,doc_id:{kind},size:bigint,flip:int>>))"
    step = """(a, b) -> CASE
        WHEN a.gap > 0 AND b.size IS NOT NULL AND abs(a.gap - b.size) < a.gap THEN named_struct('gap', a.gap - b.size, 'flips', array_append(a.flips, named_struct('u', b.u, 'doc_id', b.doc_id, 'size', b.size, 'flip', 1)))
        WHEN a.gap < 0 AND b.dsize IS NOT NULL AND abs(a.gap + b.dsize) < -a.gap THEN named_struct('gap', a.gap + b.dsize, 'flips', array_append(a.flips, named_struct('u', b.du, 'doc_id', b.did, 'size', b.dsize, 'flip', -1)))
        ELSE a END"""
    done = per.withColumn("done", F.expr(f"aggregate(bins, {start}, {step})"))
    return done.select("source", F.explode("done.flips").alias("x")).select("source", "x.doc_id", "x.u", "x.size", "x.flip")
