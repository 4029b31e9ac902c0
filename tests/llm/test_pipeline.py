"""The pipeline as a whole and each stage on its own input."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline as p
import numpy as np
from pyspark.sql import functions as F
from test_fixtures import brute, water
from test_fixtures import ids as encoded

from lodestrand.llm import jaccard, mixing, secrets, toxicity


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols, prev = docs.columns, docs
    kept = {}
    for i, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, prev, sf)
        out.write.parquet(str(tmp_path / str(i)))
        got = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(p.STAGES) - 1:
            assert got.columns == cols
        kept[name] = got
        prev_rows = prev
        if name == "toxicity":
            gone = {r.doc_id for r in toxicity.score(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("predicted = 1").collect()}
            assert {r.doc_id for r in got.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - gone
        if name == "near_duplicates":
            comp = {r.doc_id: r.component_id for r in jaccard.similar(prev_rows).collect()}
            assert {r.doc_id for r in got.collect()} == set(comp.values())
        if name == "secrets":
            assert got.count() == prev_rows.count()
            assert not any(k < 3 and "<secret>" not in r.text[a : b + 8] for r in got.collect() for a, k, b in secrets.scan(r.text or ""))
        prev = got
    mixed = kept["mixing"].groupBy("doc_id").count()
    assert mixed.agg(F.max("count")).first()[0] <= 3
    pieces = kept["packing"]
    want = {r.doc_id: r["count"] for r in mixed.collect()}
    sums = {r.doc_id: (r.s, r.t) for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("s"), F.first("doc_tokens").alias("t")).collect()}
    assert {k: v[0] // v[1] for k, v in sums.items()} == want


def test_stages_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    assert [stage(spark, docs, sf).count() for _, stage in p.STAGES] == [0] * 5


def words(rng, n):
    return " ".join("".join(rng.choice(list("aeioustrnlm"), rng.integers(2, 8))) for _ in range(n))


def mixed_by_hand(rows, weights=(1, 2, 3)):
    """Copies of (doc_id, size, source, u), as pivotal rounding in one pass a source gives them."""
    sizes, copies = defaultdict(int), {}
    for _, n, s, _ in rows:
        sizes[s] += n
    target = water(sizes, weights)
    for s in sizes:
        own = sorted((d, n, u) for d, n, t, u in rows if t == s)
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        held = None
        for d, n, u in own:
            copies[d] = min(3, int(rate)) if n else 0
            frac = rate - int(rate)
            if not n or frac <= 1e-9 or frac >= 1 - 1e-9:
                copies[d] += int(n > 0 and frac >= 1 - 1e-9)
                continue
            if held is None:
                held = [frac, n, d]
                continue
            p, q = mixing.pair(held[0], held[1], frac, n, u)
            for x, e in ((p, held[2]), (q, d)):
                copies[e] += int(x >= 1 - 1e-9)
            open_ = [[x, k, e] for x, k, e in ((p, held[1], held[2]), (q, n, d)) if 1e-9 < x < 1 - 1e-9]
            held = open_[0] if open_ else None
        if held is not None:
            copies[held[2]] += int(held[0] + 0.5)
        gap = target[s] - sum(copies[d] * n for d, n, _ in own)
        by = defaultdict(list)
        for d, n, u in own:
            if n:
                by[n.bit_length() - 1].append((u, d, n))
        for b in sorted(by, reverse=True):
            up, down = min([x for x in by[b] if copies[x[1]] < 3], default=None), max([x for x in by[b] if copies[x[1]] > 0], default=None)
            if gap > 0 and up and abs(gap - up[2]) < gap:
                copies[up[1]] += 1
                gap -= up[2]
            elif gap < 0 and down and abs(gap + down[2]) < -gap:
                copies[down[1]] -= 1
                gap += down[2]
    return copies


def test_run_equals_brute_force(spark, tmp_path):
    """run() over a small table against plain loops: every window scored, all pairs of sets, the patterns, one pass of rounding."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(160):
        t = words(rng, int(rng.integers(4, 90)))
        if i % 4 == 0:
            t = " ".join(x for w in t.split() for x in ([w, "vilwort"] if rng.random() < 0.2 else [w])) + " vilwort"
        elif i % 10 == 1 and i > 20:
            t = rows[i - 10][1] + ("" if i % 20 == 1 else " more")
        elif i % 10 == 2:
            t += f' password = "{"".join(rng.choice(list("ABCdefgh0123456789"), 14))}"'
        rows.append((i, t if i != 7 else None, "en", f"s{i % 3}", len(t)))
        labels.append((i, 1, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    lab = spark.read.parquet(f"{tmp_path}/labels.parquet")

    got = p.run(spark, str(tmp_path))
    model = toxicity.train(*toxicity.sample_rows(docs, lab, 1500, 20_000))
    left = {}
    for i, t, _, s, _ in rows:
        w = model.look_up([t or ""])[0]
        score = max([float(toxicity.sigmoid(toxicity.forward(model.p, model.rows[w[a : a + 32]][None], None)[0])[0]) for a in range(0, max(1, len(w) - 8), 24) if len(w)], default=0.0)
        if score < 0.7:
            left[i] = (t or "", s)
    assert 90 < len(left) < 150
    ids = sorted(left)
    comp = [ids[c] for _, _, c in brute([left[i][0] for i in ids])]
    left = {i: left[i] for i, c in zip(ids, comp) if i == c}
    for i, (t, s) in left.items():
        out, at = "", 0
        for a, _, b in secrets.scan(t):
            out += t[at:a] + "<secret>" if a >= at else ""
            at = max(at, b)
        left[i] = (out + t[at:], s)
    assert any("<secret>" in t for t, _ in left.values())
    sized = spark.createDataFrame([(i, len(t.split()), s) for i, (t, s) in left.items()], "doc_id long, size long, source string")
    drawn = [tuple(r) for r in sized.select("doc_id", "size", "source", mixing._chance(17, 0)).collect()]
    copies = mixed_by_hand(drawn)
    want = Counter()
    for i, (t, _) in left.items():
        n = len(t.split())
        x = encoded(t)
        if copies[i] if n else 1:
            want[i, len(x)] = (copies[i] if n else 1) * len(x)
    seen, sequences = Counter(), defaultdict(list)
    for r in got.collect():
        x = encoded(left[r.doc_id][0])
        assert r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes())
        seen[r.doc_id, r.doc_tokens] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert seen == want
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == list(np.cumsum([0, *[n for _, n in s]])[:-1]) and sum(n for _, n in s) <= 2048
