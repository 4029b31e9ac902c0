"""Graphs of edges: components, groups by subject, themes, cluster scores, edges within asserted groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, join_small


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component): the least id reachable, by large and small stars; every round is written to the shared folder."""
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    e = cut(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    for _ in range(rounds):
        both = e.select(F.explode(F.array(pair(F.col("a"), F.col("b")), pair(F.col("b"), F.col("a")))).alias("x")).select("x.*")
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        up = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = up.groupBy("a").agg(F.min("b").alias("m"))
        new = cut(up.join(down, "a").select(F.explode(F.array(pair(F.col("b"), F.col("m")), pair(F.col("a"), F.col("m")))).alias("x")).select("x.*").filter("a <> b").distinct())
        mark = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark(new) == mark(e):
            ends = new.select(F.col("a").alias("id"), F.col("b").alias("component"))
            return ends.unionByName(ends.select(F.col("component").alias("id"), "component").distinct())
        e = new
    raise RuntimeError("components did not settle")


def labelled(nodes: DataFrame, edges: DataFrame, idx: str = "idx") -> DataFrame:
    """nodes with their component; a node without edges is its own."""
    found = components(edges).withColumnRenamed("id", idx)
    return nodes.join(found, idx, "left").withColumn("component", F.coalesce("component", idx))


def same_label_pairs(items: DataFrame, idx: str = "idx", label: str = "label", chunk: int = 1024, each: int = 20_000_000) -> DataFrame:
    """(a, b), a < b, with equal labels.

    The rows of a label lie in chunks of about `chunk`; pairs of chunks, not a label, are what tasks get: about `each` pairs a
    task, however many rows a label has.
    """
    known = items.select(F.col(idx).alias("i"), F.col(label).alias("k")).filter(F.col("k").isNotNull())
    sizes = cut(known.groupBy("k").agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n") / 2)).first()[0] or 0
    placed = join_small(known, sizes.select("k", F.ceil(F.col("n") / chunk).alias("n")), ["k"], "inner")
    chunks = cut(placed.groupBy("k", F.pmod(F.xxhash64("i"), F.col("n")).alias("c")).agg(F.collect_list("i").alias("ids")))
    x, y = (chunks.select("k", F.col("c").alias(f"c{s}"), F.col("ids").alias(f"i{s}")) for s in "ab")
    tasks = max(items.sparkSession.sparkContext.defaultParallelism, min(20_000, int(total // each)))
    work = x.join(y, "k").filter("ca <= cb").repartition(tasks, "k", "ca", "cb")
    pairs = work.select((F.col("ca") == F.col("cb")).alias("same"), F.explode("ia").alias("a"), "ib").select("same", "a", F.explode("ib").alias("b"))
    return pairs.filter(~F.col("same") | (F.col("a") < F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def observed(edges: DataFrame, percent: int, seed: int = 0) -> DataFrame:
    """A fixed share of the edges, by hash: the same ones in any system."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(",", "a", "b", F.lit(seed)), 256), 1, 8), 16, 10).cast("long")
    return edges.filter(h % 100 < percent)


def united(*edges: DataFrame) -> DataFrame:
    out = edges[0].select("a", "b")
    for e in edges[1:]:
        out = out.unionByName(e.select("a", "b"))
    return out.distinct()


def within_groups(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges (a, b) whose ends are in one group of groups(id, component)."""
    x = groups.select(F.col("id").alias("a"), F.col("component").alias("ga"))
    y = groups.select(F.col("id").alias("b"), F.col("component").alias("gb"))
    return edges.join(x, "a").join(y, "b").filter("ga = gb").select("a", "b")


def cluster_score(items: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """together (recall of same-label pairs), purity, f1, clusters, largest: from sizes of groups, not from pairs."""
    pairs = lambda n: n * (n - 1) / 2
    cells = items.groupBy(cluster, label).count()
    kept = cells.agg(F.sum(pairs(F.col("count"))).alias("both"))
    c = cells.groupBy(cluster).agg(F.sum("count").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("made"), F.count("*").alias("clusters"), F.max("n").alias("largest"))
    t = cells.groupBy(label).agg(F.sum("count").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("true"))
    one = kept.join(c).join(t)
    ratio = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(F.lit(0.0))
    one = one.select(ratio("both", "true").alias("together"), ratio("both", "made").alias("purity"), "clusters", "largest")
    f1 = F.when(F.col("together") + F.col("purity") > 0, 2 * F.col("together") * F.col("purity") / (F.col("together") + F.col("purity"))).otherwise(0.0)
    return one.select("together", "purity", f1.alias("f1"), "clusters", "largest")


def judged_edges(pairs: DataFrame, judge: Callable, text: str = "text") -> DataFrame:
    """(a, b, distance, subjects): pairs(a, b, distance, text_a, text_b) that a judge finds to share subjects.

    judge: a column function of two texts that gives array<string>, or null for unrelated.
    """
    return pairs.withColumn("subjects", judge(F.col(f"{text}_a"), F.col(f"{text}_b"))).filter(F.col("subjects").isNotNull()).select("a", "b", "distance", "subjects")


def subject_groups(edges: DataFrame) -> DataFrame:
    """(subject, members, subjects, edges) of edges(a, b, subjects): a member may be in many groups; subjects counts those seen with it."""
    each = edges.select("a", "b", "subjects", F.explode(F.array_distinct("subjects")).alias("subject"))
    members = each.select("subject", F.explode(F.array("a", "b")).alias("m")).distinct().groupBy("subject").agg(F.array_sort(F.collect_list("m")).alias("members"))
    count = each.groupBy("subject").agg(F.count("*").alias("edges"))
    seen = each.select("subject", F.explode("subjects").alias("s")).groupBy("subject", "s").count().groupBy("subject").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "count")))).alias("subjects"))
    return members.join(count, "subject").join(seen, "subject").orderBy(F.size("members").desc(), "subject")


def themes(groups: DataFrame, named: DataFrame, least: int = 2) -> DataFrame:
    """(name, subjects, members, size): named(name, subjects) over groups; groups that none claims stand for themselves."""
    live = groups.filter(F.size("members") >= least).select("subject", "members")
    claims = named.select("name", F.explode("subjects").alias("subject")).distinct().join(live, "subject")
    made = claims.groupBy("name").agg(F.array_sort(F.collect_set("subject")).alias("subjects"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("members"))
    rest = live.join(claims.select("subject").distinct(), "subject", "left_anti").select(F.col("subject").alias("name"), F.array("subject").alias("subjects"), F.array_sort("members").alias("members"))
    return made.unionByName(rest).withColumn("size", F.size("members")).orderBy(F.col("size").desc(), "name")


def cluster_id(members: str = "members"):  # noqa: ANN201
    """A cluster's identity: the hash of its members' codes in order."""
    return F.sha2(F.array_join(F.array_sort(F.col(members).cast("array<string>")), ","), 256)
