"""Evaluation of retrieval: recall, chance, ranks of first hits, displacement, controls, samples, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

KS = (1, 5, 10, 20)


def hits(ranked: DataFrame, truth: DataFrame, label: str = "label") -> DataFrame:
    """ranked(query, idx, rank) with hit: whether both have the same label in truth(idx, label)."""
    q = truth.select(F.col("idx").alias("query"), F.col(label).alias("ql"))
    return ranked.join(q, "query").join(truth.select("idx", F.col(label).alias("il")), "idx").withColumn("hit", F.col("ql") == F.col("il"))


def same_author(ranked: DataFrame, items: DataFrame, ks: tuple[int, ...] = KS, author: str = "author") -> DataFrame:
    """The control: share of queries with a neighbour of their own author among their first k. No author is nobody's."""
    known = items.select("idx", F.nullif(F.col(author), F.lit("")).alias(author))
    h = hits(ranked, known, author).withColumn("hit", F.coalesce("hit", F.lit(False)))
    return recall_at(h, ks).select("queries", *[F.col(f"recall_{k}").alias(f"author_{k}") for k in ks])


def by_class(hit: DataFrame, items: DataFrame, named: Column, k: int = 10) -> DataFrame:
    """Recall at k apart for queries of the named classes and of others; queries without class have no part."""
    part = items.select(F.col("idx").alias("query"), F.when(named, "named").otherwise("other").alias("part")).filter(named.isNotNull())
    return recall_at(hit.join(part, "query"), (k,), ["part"])


def separation_change(pairs: DataFrame, before: str, after: str, same: str = "same") -> DataFrame:
    """How far means of same and other pairs lie apart in two measurements, and how that changed: summaries against originals."""
    mean = lambda c, s: F.avg(F.when(F.col(same) == F.lit(s), F.col(c)))
    one = pairs.agg(*[(mean(c, True) - mean(c, False)).alias(n) for c, n in ((before, "before"), (after, "after"))])
    return one.select("before", "after", (F.col("after") - F.col("before")).alias("change"))


def recall_at(hit: DataFrame, ks: tuple[int, ...] = KS, by: list[str] | None = None) -> DataFrame:
    """Share of queries with a hit among their first k, for each k; by: columns of hit to split on."""
    by = by or []
    per = hit.groupBy(*by, "query").agg(*[F.max(F.when((F.col("rank") <= k) & F.col("hit"), 1).otherwise(0)).alias(f"h{k}") for k in ks])
    return per.groupBy(*by).agg(F.count("*").alias("queries"), *[F.avg(f"h{k}").alias(f"recall_{k}") for k in ks])


def chance(truth: DataFrame, label: str = "label") -> DataFrame:
    """The chance that one other item has an item's label, averaged over items."""
    n = truth.groupBy(label).count()
    return n.agg((F.sum(F.col("count") * (F.col("count") - 1)) / (F.sum("count") * (F.sum("count") - 1))).alias("chance"))


def first_hits(hit: DataFrame) -> DataFrame:
    return hit.groupBy("query").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))


def displacement(first: DataFrame) -> DataFrame:
    """Median first hit, shares of first hits at 1, within 10 and within 50; queries without a hit count as none."""
    share = lambda k: F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0))
    return first.agg(F.percentile("first", 0.5).alias("median"), share(1).alias("first_1"), share(10).alias("first_10"), share(50).alias("first_50"))


def retention(code: DataFrame, ceiling: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """What share of the ceiling's recall a code keeps."""
    a, b = (d.select(*[F.col(f"recall_{k}").alias(f"{s}{k}") for k in ks]) for d, s in ((code, "c"), (ceiling, "t")))
    return a.join(b).select(*[F.when(F.col(f"t{k}") > 0, F.col(f"c{k}") / F.col(f"t{k}")).alias(f"kept_{k}") for k in ks])


def separation(pairs: DataFrame, value: str = "distance", kind: str = "kind") -> DataFrame:
    """Mean, least and greatest of a value for each kind of pair."""
    return pairs.groupBy(kind).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def round_robin(items: DataFrame, group: str, limit: int, seed: int = 0, idx: str = "idx") -> DataFrame:
    """Items taken from each group in turn, in an order fixed by the seed: that of hashes any system has."""
    key = lambda c: F.sha2(F.concat_ws(",", F.col(c).cast("string"), F.lit(seed)), 256)
    turn = F.row_number().over(Window.partitionBy(group).orderBy(key(idx), idx))
    return items.withColumn("turn", turn).orderBy("turn", key(group), group).limit(limit)


def at_most(items: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    return items.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def halves(items: DataFrame, by: str, order: str) -> DataFrame:
    """Each group's first half as queries (half = 'query'), the rest as index."""
    w = Window.partitionBy(by)
    n, r = F.count("*").over(w), F.row_number().over(w.orderBy(order))
    return items.withColumn("half", F.when(r <= F.floor(n / 2), "query").otherwise("index"))


def scoreable(items: DataFrame, group: str, facet: str) -> DataFrame:
    """Items of which another group shares a facet."""
    pairs = items.select(group, F.explode(facet).alias("f")).distinct()
    shared = pairs.groupBy("f").agg(F.count("*").alias("n")).filter("n > 1")
    return items.join(pairs.join(shared, "f", "left_semi").select(group).distinct(), group, "left_semi")


def multiset_jaccard(a: DataFrame, b: DataFrame, ids: tuple[str, str] = ("a", "b")) -> DataFrame:
    """(a, b, jaccard) of token counts a(a, token, n) and b(b, token, n), for pairs that share a token."""
    x, y = ids
    total = lambda d, k, s: d.groupBy(k).agg(F.sum("n").alias(s))
    common = a.withColumnRenamed("n", "na").join(b.withColumnRenamed("n", "nb"), "token").groupBy(x, y).agg(F.sum(F.least("na", "nb")).alias("common"))
    both = common.join(total(a, x, "ta"), x).join(total(b, y, "tb"), y)
    return both.select(x, y, (F.col("common") / (F.col("ta") + F.col("tb") - F.col("common"))).alias("jaccard"))


def text_jaccard(a: DataFrame, b: DataFrame, words: Column, ids: tuple[str, str] = ("a", "b"), text: str = "text", each: int = 5000, max_rows: int = 200_000, max_bytes: int = 64 << 20) -> DataFrame:
    """multiset_jaccard of the words of many texts a(a, text) with those of few texts b(b, text); rows of one id are one text.

    words: an array of a text's words, with repeats. A text of a is sent once, to its id's task, of about `each` texts. There a
    word is met by the list of those of b that have it, which is broadcast, so that all sums are taken where the text is; beyond the
    bounds, counts are joined by word.
    """
    x, y = ids
    count = lambda d, k: d.filter(F.col(k).isNotNull()).select(k, F.explode(words).alias("token")).groupBy(k, "token").agg(F.count("*").alias("n"))
    other = cut(count(b, y))
    rows, width = other.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("token") + 32), F.lit(0))).first()
    if rows > max_rows or width > max_bytes:
        return multiset_jaccard(count(a, x), other, ids)
    sized = other.join(other.groupBy(y).agg(F.sum("n").alias("t")), y)
    lists = cut(sized.groupBy("token").agg(F.collect_list(F.struct(F.col(y).alias("y"), "n", "t")).alias("at")))
    tasks = max(a.sparkSession.sparkContext.defaultParallelism, min(20_000, a.count() // each))
    met = count(a.select(x, text).repartition(tasks, x), x).join(F.broadcast(lists), "token", "left")
    # besides its matches, each word gives its number to the text's size, as that of no y
    none = F.struct(F.lit(None).cast(dict(b.dtypes)[y]).alias("y"), F.col("n"), F.lit(None).cast("long").alias("t"))
    hits = met.select(x, "n", F.explode(F.concat(F.coalesce("at", F.array()), F.array(none))).alias("o"))
    sums = hits.groupBy(x, F.col("o.y").alias("y")).agg(F.sum(F.least("n", "o.n")).alias("k"), F.max("o.t").alias("t"))
    whole = sums.groupBy(x).agg(F.max(F.when(F.col("y").isNull(), F.col("k"))).alias("own"), F.collect_list(F.when(F.col("y").isNotNull(), F.struct("y", "k", "t"))).alias("o"))
    return whole.select(x, "own", F.explode("o").alias("o")).select(x, F.col("o.y").alias(y), (F.col("o.k") / (F.col("own") + F.col("o.t") - F.col("o.k"))).alias("jaccard"))


def overlap_correlation(counts: DataFrame, vectors: DataFrame, idx: str = "doc_id") -> DataFrame:
    """(pearson, pairs): how multiset overlap of counts(idx, token, n) goes with cosine of vectors(idx, vec), over items and their next ones."""
    from .vectors import cosine

    total = counts.groupBy(idx).agg(F.sum("n").alias("t"))
    a, b = counts.select(F.col(idx).alias("a"), "token", F.col("n").alias("na")), counts.select((F.col(idx) - 1).alias("a"), "token", F.col("n").alias("nb"))
    common = a.join(b, ["a", "token"]).groupBy("a").agg(F.sum(F.least("na", "nb")).alias("k"))
    own, other = (total.select((F.col(idx) - s).alias("a"), F.col("t").alias(f"t{s}")) for s in (0, 1))
    v, w = (vectors.select((F.col(idx) - s).alias("a"), F.col("vec").alias(f"v{s}")) for s in (0, 1))
    j = common.join(own, "a").join(other, "a").join(v, "a").join(w, "a")
    return j.agg(F.round(F.corr(F.col("k") / (F.col("t0") + F.col("t1") - F.col("k")), cosine(F.col("v0"), F.col("v1"))), 6).alias("pearson"), F.count("*").alias("pairs"))


def confusion(scored: DataFrame, score: str, truth: str, threshold: float) -> DataFrame:
    yes = F.col(score) >= threshold
    n = lambda c: F.count_if(c)
    return scored.agg(n(yes & F.col(truth)).alias("tp"), n(yes & ~F.col(truth)).alias("fp"), n(~yes & F.col(truth)).alias("fn"), n(~yes & ~F.col(truth)).alias("tn"), F.percentile(score, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("quartiles"))


def one_sided(verdicts: DataFrame, verdict: str = "verdict", share: float = 0.9) -> DataFrame:
    """The commonest verdict, its share, and whether the judge is to be distrusted for it."""
    n = verdicts.groupBy(verdict).count()
    top = n.agg(F.max_by(verdict, F.struct("count", verdict)).alias(verdict), (F.max("count") / F.sum("count")).alias("share"))
    return top.withColumn("degenerate", F.col("share") > share)


def stable_judged(ranked: DataFrame, related: str = "related", pos: str = "pos") -> DataFrame:
    """Related items first, each part in the order it had."""
    return ranked.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy(F.col(related).desc(), pos)))
