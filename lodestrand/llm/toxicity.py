"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its hashed embedding and its spelling: the greatest states of a small gated network that reads
its characters in both directions, each with a hashed embedding of the five that end there, so that unseen forms of a known
stem are known in part. A word of more than LONG bytes is cut
at its signs, and what is still longer into pieces that overlap; each is an input like a word, so that every letter is
read. Windows of `width` words, each overlapping the next, are read in both directions; attention pools the states into
one logit. A document's score is the greatest of all its windows'. Nothing but words and characters enters the network.

Labels are of documents, so training chooses windows. At first all windows of a toxic document stand for it, a few of
them in each pass; then those that the network itself finds highest. Of clean documents some are taken at random and
those that score highest. While training, words are exchanged for others' and joined with others' letters at random, so that what is learnt is what
they have in common, wherever in a word it stands; the first epochs learn from spelling alone.

Training takes at most `sample` rows of each label (by hash of the id, of texts up to `sample_chars`
characters), on the driver, and `most` windows of each; scoring reads every text whole. Nothing but the text enters a score.

Defined results: null, empty and wordless texts score 0; equal texts score equally; repeated rows are scored each;
with labels of one kind only, or none, the score is that share everywhere, 0 without labels; an empty
table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, hash_sample, pieces, text_of
from .nets import F32, Adam, gru, gru_back, sigmoid, uniform

#: Rows of the tables of words and of runs of characters, their width, states of a spelling in each direction, of a window in each direction, bytes of a word.
WORDS, GRAMS, DIM, CHARS, HIDDEN, LONG = 1 << 16, 1 << 16, 8, 8, 8, 22
INPUT = DIM + 2 * CHARS
#: Bytes of text that are split into words at a time, and words that may be kept from one such slice to the next: scores don't depend on either.
SLICE, KEPT = 500_000, 100_000
OVERLAP = 8
_PLAIN = re.compile(r"[\W_]+")


def _cut(word: str) -> list[str]:
    """The word, or if it has more than LONG bytes its runs between signs, and of longer runs pieces that overlap by about half."""
    low = word.lower()
    if len(_PLAIN.sub("", low).encode("utf-8", "surrogatepass")) <= LONG:
        return [word]
    if not low.isascii():  # vowel and tone marks are stripped as ever, but don't part a word
        low = "".join(c for c in low if unicodedata.category(c)[0] != "M")
    out = []
    for run in _PLAIN.split(low):
        raw = run.encode("utf-8", "surrogatepass")
        a = 0
        while len(raw) - a > LONG:
            b, step = a + LONG, a + LONG // 2
            while raw[b] & 0xC0 == 0x80:  # not within a character
                b -= 1
            while raw[step] & 0xC0 == 0x80:
                step -= 1
            out.append(raw[a:b].decode("utf-8", "surrogatepass"))
            a = step
        if raw:
            out.append(raw[a:].decode("utf-8", "surrogatepass"))
    return out


def words_of(text: str) -> list[str]:
    """The words of a text, long ones in pieces."""
    words = text.split()
    if all(len(w) <= LONG // 4 or (len(w) <= LONG and w.isascii()) for w in words):
        return words
    return [x for w in words for x in ((w,) if len(w) <= LONG // 4 or (len(w) <= LONG and w.isascii()) else _cut(w))]


def bare(words: list[str]) -> list[bytes]:
    """Words of words_of without case and signs."""
    return [(w if w.isalnum() else _PLAIN.sub("", w)).encode("utf-8", "surrogatepass") for w in map(str.lower, words)]


def marked(raw: list[bytes]) -> np.ndarray:
    """The bytes of words, ends marked, at the right of each row, 0 before."""
    wide = max(3, max(map(len, raw)) + 2)
    return np.frombuffer(b"".join((b"\x01%b\x02" % w).rjust(wide, b"\0") for w in raw), np.uint8).reshape(len(raw), wide)


def spelt(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the word table, and the bytes of words."""
    raw = bare(words)
    return np.fromiter((xxhash.xxh3_64_intdigest(w) % WORDS for w in raw), np.int64, len(raw)), marked(raw)


def runs(chars: np.ndarray) -> np.ndarray:
    """The row of the run table for the five bytes that end at each place."""
    n, wide = chars.shape
    c = np.zeros((n, wide + 4), np.uint32)
    c[:, 4:] = chars
    h = sum(c[:, k : k + wide] * np.uint32(pow(0x9E3779B1, k + 1, 1 << 32)) for k in range(5)) * np.uint32(0x85EBCA6B)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(16)).astype(np.int64)


def joined(words: list[bytes], others: list[bytes], share: float, rng: np.random.Generator) -> list[bytes]:
    """Words, a share of them within letters of others or any bytes, up to LONG bytes; b"" where a word stays."""
    out = [b""] * len(words)
    for i in np.flatnonzero(rng.random(len(words)) < share):
        free = LONG - len(words[i])
        if free > 0:
            fill = b"".join(others[k] for k in rng.integers(0, len(others), 4)) if rng.random() < 0.7 else rng.integers(97, 240, LONG).astype(np.uint8).tobytes()
            k = int(rng.integers(0, free + 1))
            out[i] = fill[:k] + words[i] + fill[k : free if rng.random() < 0.7 else k]
    return out


def spellings(p: dict, chars: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """The greatest states of the network over the characters, in both directions."""
    mask, at = (chars > 0).astype(F32), runs(chars)
    e = p["char"][chars] + p["run"][at]
    ends, past = [], []
    for step, k in ((1, "c"), (-1, "d")):
        h, states = gru(e[:, ::step] @ p[k + "w"] + p[k + "b"], p[k + "u"], mask[:, ::step], keep)
        h = np.where(mask[:, ::step, None] > 0, h, F32(-1))
        top = h.argmax(axis=1)
        ends.append(np.take_along_axis(h, top[:, None], 1)[:, 0])
        past.append((states, top))
    return np.concatenate(ends, axis=1), (chars, at, e, mask, past)


def spellings_back(p: dict, d: np.ndarray, state: tuple) -> tuple[dict, np.ndarray]:
    """Gradients of the weights, and of each character's embedding."""
    chars, at, e, mask, past = state
    g, de = {}, np.zeros_like(e)
    for i, (step, k) in enumerate(((1, "c"), (-1, "d"))):
        states, top = past[i]
        dout = np.zeros((*chars.shape, CHARS), F32)
        np.put_along_axis(dout, top[:, None], d[:, None, i * CHARS : (i + 1) * CHARS], 1)
        dx, g[k + "u"] = gru_back(dout, p[k + "u"], mask[:, ::step], states)
        flat = dx.reshape(-1, dx.shape[2])
        g[k + "w"], g[k + "b"] = e[:, ::step].reshape(-1, e.shape[2]).T @ flat, flat.sum(axis=0)
        de += (dx @ p[k + "w"].T)[:, ::step]
    g["char"] = added(chars.ravel(), de.reshape(-1, de.shape[2]), 256)
    return g, de


def inputs(p: dict, word: np.ndarray, chars: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """Input rows of words: embedding and spelling."""
    spelling, past = spellings(p, chars, keep)
    return np.concatenate([p["word"][word], spelling], axis=1), past


def added(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Rows of values summed by their places."""
    return np.stack([np.bincount(at, v, size) for v in values.T], axis=1).astype(F32)


class Model:
    """Parameters and the scoring of windows of word ids; words are kept with their projected inputs."""

    def __init__(self, p: dict[str, np.ndarray], width: int):
        self.p, self.width = p, width
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((1024, 6 * HIDDEN), F32)
        self.uses = np.zeros(1024, np.int64)

    def __getstate__(self) -> dict:
        return {"p": self.p, "width": self.width}

    def __setstate__(self, s: dict) -> None:
        self.__init__(s["p"], s["width"])

    def look_up(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of the texts' words; 0 is padding."""
        ids = self.ids
        split = [words_of(t) for t in texts]
        new = sorted({w for words in split for w in words if w not in ids}, key=len)  # by length, so that few characters are padding
        at = len(ids) + 1
        for i, w in enumerate(new):
            ids[w] = at + i
        if at + len(new) > len(self.rows):
            self._resize(np.arange(at), max(at + len(new), KEPT + 32_768))  # pages that no word reaches aren't touched
        for i in range(0, len(new), 2048):
            x = inputs(self.p, *spelt(new[i : i + 2048]))[0]
            self.rows[at + i : at + i + len(x)] = x @ self.p["w"] + self.p["b"]
        out = [np.fromiter(map(ids.__getitem__, words), np.int32, len(words)) for words in split]
        self.uses += np.bincount(np.concatenate([*out, np.zeros(0, np.int32)]), minlength=len(self.uses))
        return out

    def _resize(self, kept: np.ndarray, size: int) -> None:
        """Room for `size` words, those at `kept` first."""
        rows, uses = self.rows[kept], self.uses[kept]
        self.rows, self.uses = np.zeros((size, 6 * HIDDEN), F32), np.zeros(size, np.int64)
        self.rows[: len(kept)], self.uses[: len(kept)] = rows, uses

    def forget(self, most: int = KEPT) -> None:
        """Beyond `most` words, only those stay that were used again since the last time, half of `most` at most."""
        if len(self.ids) > most:
            again = self.uses > 1
            words = [w for w, i in self.ids.items() if again[i]][: most // 2]
            kept = np.array([0, *map(self.ids.__getitem__, words)])
            self.ids = {w: i for i, w in enumerate(words, 1)}
            self._resize(kept, KEPT + 32_768 if words else 1024)
            self.uses[:] = 0

    def windows(self, n: int) -> np.ndarray:
        """Starts of the windows of n words, each sharing OVERLAP words with the next, the last one reaching the end."""
        return np.arange(0, max(1, n - OVERLAP), self.width - OVERLAP)

    def score(self, docs: list[np.ndarray], batch: int = 1024) -> np.ndarray:
        """The greatest window score of each document, given its word ids."""
        starts = [self.windows(len(d)) if len(d) else np.zeros(0, np.int64) for d in docs]
        owner = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
        base = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        flat = np.concatenate([*docs, np.zeros(self.width, np.int32)])
        first = np.concatenate([*starts, np.zeros(0, np.int64)]).astype(np.int64) + base[owner]
        out = np.zeros(len(docs))
        for a in range(0, len(first), batch):
            f, o = first[a : a + batch], owner[a : a + batch]
            ids = flat[f[:, None] + np.arange(self.width)]
            full = base[o + 1] - f >= self.width
            mask = None
            if not full.all():
                mask = (np.arange(self.width) < (base[o + 1] - f)[:, None]).astype(F32)
                ids = ids * mask.astype(np.int32)
            np.maximum.at(out, o, sigmoid(forward(self.p, self.rows[ids], mask)[0]).astype(float))
        return out


def forward(p: dict, x: np.ndarray, mask: np.ndarray | None, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Logits of windows whose projected inputs are x (B, T, 6H)."""
    k = 3 * HIDDEN
    f, pf = gru(x[:, :, :k], p["uf"], mask, keep)
    b, pb = gru(x[:, ::-1, k:], p["ub"], None if mask is None else mask[:, ::-1], keep)
    h = np.concatenate([f, b[:, ::-1]], axis=2)
    q = np.tanh(h @ p["wa"] + p["ba"])
    e = q @ p["va"]
    if mask is not None:
        e = np.where(mask > 0, e, F32(-1e9))
    e = np.exp(e - e.max(axis=1, keepdims=True))
    alpha = e / e.sum(axis=1, keepdims=True)
    pooled = np.matmul(alpha[:, None, :], h)[:, 0]
    return pooled @ p["wo"] + p["bo"], (pf, pb, h, q, alpha, pooled)


def backward(p: dict, dlogit: np.ndarray, mask: np.ndarray, state: tuple) -> tuple[dict, np.ndarray]:
    pf, pb, h, q, alpha, pooled = state
    g = {"wo": pooled.T @ dlogit, "bo": dlogit.sum(keepdims=True)}
    dpool = dlogit[:, None] * p["wo"]
    dalpha = np.matmul(h, dpool[:, :, None])[:, :, 0]
    dh = alpha[:, :, None] * dpool[:, None, :]
    de = alpha * (dalpha - (alpha * dalpha).sum(axis=1, keepdims=True))
    dq = de[:, :, None] * p["va"] * (1 - q * q)
    g["va"] = np.einsum("btk,bt->k", q, de)
    g["wa"] = np.einsum("bth,btk->hk", h, dq)
    g["ba"] = dq.sum(axis=(0, 1))
    dh = dh + dq @ p["wa"].T
    dxf, g["uf"] = gru_back(dh[:, :, :HIDDEN], p["uf"], mask, pf)
    dxb, g["ub"] = gru_back(dh[:, ::-1, HIDDEN:], p["ub"], mask[:, ::-1], pb)
    return g, np.concatenate([dxf, dxb[:, ::-1]], axis=2)


def train(texts: list[str], labels: list[int], width: int = 32, epochs: int = 10, steps: int = 40, batch: int = 64, most: int = 8, swapped: float = 0.5, glue: float = 0.25, left_out: float = 0.5, spelling: int = 6, at: float = 0.7, alarms: float = 0.003, way: float = 0.3, seed: int = 11) -> Model | float:
    """A model, or a constant score where the labels are of one kind. steps: batches of an epoch; most: windows taken of a document; swapped, glue, left_out: shares of words exchanged, joined with letters, without embedding; spelling: epochs of spelling alone; at, alarms, way: where the score lies that hardly a clean document reaches."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return float(y.max()) if len(y) else 0.0
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab) + 1) for w in words_of(t)], np.int32) for t in texts]
    raw = bare(["", *vocab])
    word, chars = spelt(["", *vocab])
    lengths = np.array([len(x) for x in raw])
    seen = np.bincount(np.concatenate([np.unique(word[d]) for d in docs]).astype(np.int64), minlength=WORDS)
    p = {
        "word": np.zeros((WORDS, DIM), F32), "run": np.zeros((GRAMS, 8), F32), "char": uniform(rng, 256, 8) * 8, "w": uniform(rng, INPUT, 6 * HIDDEN), "b": np.zeros(6 * HIDDEN, F32), "uf": uniform(rng, HIDDEN, 3 * HIDDEN), "ub": uniform(rng, HIDDEN, 3 * HIDDEN),
        **{k + "w": uniform(rng, 8, 3 * CHARS) for k in "cd"}, **{k + "b": np.zeros(3 * CHARS, F32) for k in "cd"}, **{k + "u": uniform(rng, CHARS, 3 * CHARS) for k in "cd"},
        "wa": uniform(rng, 2 * HIDDEN, 8), "ba": np.zeros(8, F32), "va": uniform(rng, 8), "wo": uniform(rng, 2 * HIDDEN), "bo": np.zeros(1, F32),
    }
    p["w"][:DIM] *= 3
    adam = Adam({k: v for k, v in p.items() if k not in ("word", "run")}, rate=1e-2)
    speed, rate = {k: np.zeros_like(p[k]) for k in ("word", "run")}, 4.0
    model = Model(p, width)

    # a fifth of the clean documents aren't learnt from: the bias is set by them, by all of their windows
    apart = np.zeros(len(docs), bool)
    apart[rng.permutation(np.flatnonzero(y == 0))[: int((y == 0).sum()) // 5]] = True
    starts = [model.windows(len(d)) for d in docs]
    starts = [s if a or len(s) <= most else np.sort(rng.choice(s, most, replace=False)) for s, a in zip(starts, apart)]
    padded = [np.concatenate([d, np.zeros(width, np.int32)]) for d in docs]
    all_ids = np.concatenate([padded[i][s[:, None] + np.arange(width)] for i, s in enumerate(starts)])
    owner = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
    used = np.unique(all_ids)
    used = used[np.argsort(lengths[used], kind="stable")]
    toxic, clean = np.flatnonzero(y[owner] == 1), np.flatnonzero((y[owner] == 0) & ~apart[owner])
    filler = [raw[i] for d in docs for i in d[:20] if raw[i]] or [b"e"]
    others = np.concatenate([docs[i] for i in np.flatnonzero((y == 0) & ~apart)] + [np.zeros(1, np.int32)])

    def first(order: np.ndarray, most: int) -> np.ndarray:
        """Of windows in an order, at most `most` of each document."""
        o = owner[order]
        at = np.argsort(o, kind="stable")
        head = np.concatenate([[0], np.flatnonzero(np.diff(o[at])) + 1]) if len(at) else np.zeros(0, np.int64)
        nth = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
        return order[np.sort(at[nth < most])]

    def choose(rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Windows that stand for either label."""
        if rank is None:
            return first(rng.permutation(toxic), 6), clean
        pos = first(toxic[np.argsort(-rank[toxic], kind="stable")], 1)
        pos = pos[: max(1, int(0.8 * len(pos)))]  # labels are noisy: the fifth that least looks it tells nothing
        hard = clean[np.argsort(-rank[clean], kind="stable")[: max(200, len(pos) // 2)]]
        return pos, np.concatenate([np.repeat(hard, max(1, len(clean) // (3 * len(hard)))), clean])

    def projected() -> np.ndarray:
        """Projected inputs of all words, by length, so that few characters are padding."""
        rows = np.zeros((len(word), 6 * HIDDEN), F32)
        for a in range(0, len(used), 2048):
            i = used[a : a + 2048]
            c = chars[i]
            rows[i] = inputs(p, word[i], c[:, int((c == 0).all(axis=0).sum()) :])[0] @ p["w"] + p["b"]
        return rows

    def ranked(rows: np.ndarray) -> np.ndarray:
        """The network's own logit of every window."""
        return np.concatenate([forward(p, rows[i], (i > 0).astype(F32))[0] for a in range(0, len(all_ids), 1024) for i in [all_ids[a : a + 1024]]])

    alone = rng.random(len(word))
    for epoch in range(epochs):
        if epoch == epochs - 2:
            adam.rate /= 5
            rate /= 5
        if epoch % 2:
            rows = projected()
            alone = np.concatenate([forward(p, rows[a : a + 4096, None], None)[0] for a in range(0, len(rows), 4096)])
            alone[0] = -np.inf
        if epoch % 2 or epoch < epochs // 2:
            pos, neg = choose(None if epoch < epochs // 2 else ranked(rows))
        for _ in range(steps):
            half = batch // 2
            ids = all_ids[np.concatenate([rng.choice(pos, half), rng.choice(neg, batch - half)])]
            t = np.concatenate([np.ones(half, F32), np.zeros(batch - half, F32)])
            # words exchanged for others' of clean documents, but for that which the network alone finds most toxic: what
            # marks a window isn't its surroundings
            free = (ids > 0) & (np.arange(width) != alone[ids].argmax(axis=1)[:, None])
            ids = np.where((rng.random(ids.shape) < swapped * rng.random((batch, 1)) * 2) & free, others[rng.integers(0, len(others), ids.shape)], ids)
            mask = (ids > 0).astype(F32)
            u, back = np.unique(ids, return_inverse=True)
            back = back.reshape(ids.shape)
            # words of one document alone have no embedding
            known = ((seen[word[u]] > 1) & (rng.random(len(u)) >= (1 if epoch < spelling else left_out))).astype(F32)[:, None]
            words = [raw[i] for i in u]
            within = joined(words, filler, glue, rng)
            known[[i for i, w in enumerate(within) if w]] = 0
            words = [w or x for w, x in zip(within, words)]
            # short words and long ones apart, so that few characters are padding
            size = np.array([len(w) for w in words])
            parts = [i for i in (np.flatnonzero(size <= np.median(size)), np.flatnonzero(size > np.median(size))) if len(i)]
            x, pasts = np.empty((len(u), INPUT), F32), []
            for i in parts:
                x[i], past = inputs(p, word[u[i]], marked([words[k] for k in i]), keep=True)
                pasts.append(past)
            x[:, :DIM] *= known
            logit, state = forward(p, (x @ p["w"] + p["b"])[back], mask, keep=True)
            g, dx = backward(p, ((sigmoid(logit) - t) / batch).astype(F32), mask, state)
            drows = added(back.ravel(), dx.reshape(-1, dx.shape[2]), len(u))
            g["w"], g["b"] = x.T @ drows, drows.sum(axis=0)
            du = drows @ p["w"].T
            grads, asked = g, []
            for i, past in zip(parts, pasts):
                more, de = spellings_back(p, du[i, DIM:], past)
                grads = {k: grads.get(k, 0) + more[k] if k in more else v for k, v in (more | grads).items()}
                asked.append((past[1].ravel(), de.reshape(-1, 8) * past[3].reshape(-1, 1)))
            adam.step(grads)
            # plain steps: a row grows with the number of windows that ask for it
            for k, wants in (("word", [(word[u], du[:, :DIM] * known)]), ("run", asked)):
                speed[k] *= F32(0.9)
                for at_, d in wants:
                    np.add.at(speed[k], at_, d)
                p[k] -= F32(rate) * speed[k]
                p[k] *= F32(1 - 1e-4)
    # windows of both labels were trained on in equal number: the bias is lowered until `at` lies beyond what hardly a clean
    # document set apart reaches, by a share of the way from there to the middle toxic one
    highest = np.full(len(docs), -np.inf)
    np.maximum.at(highest, owner, ranked(projected()))
    clear = np.quantile(highest[apart if apart.sum() >= 20 else y == 0], 1 - alarms)
    beyond = max(0.5, way * (np.median(highest[y == 1]) - clear))
    p["bo"] -= F32(max(0.0, clear + beyond - np.log(at / (1 - at))))
    return model


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int, sample_chars: int) -> tuple[list[str], list[int]]:
    """At most `sample` rows of each label by hash of the id, of those that may be learnt from."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = hash_sample(known.filter("toxic = 1"), sample, "doc_id").unionByName(hash_sample(known.filter("toxic = 0"), sample, "doc_id"))
    rows = docs.select("doc_id", text_of(docs).alias("text")).filter(F.length("text") <= sample_chars).join(F.broadcast(ids), "doc_id")  # 2 x sample ids at most
    rows = sorted((r[0], r[1], r[2]) for r in rows.select("doc_id", "text", "toxic").collect())
    return [r[1] for r in rows], [r[2] for r in rows]


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = 1500, sample_chars: int = 20_000, width: int = 32, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text); keep: with all columns of docs."""
    model = train(*sample_rows(docs, labels, sample, sample_chars), width=width)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: the embeddings' tables and the weights
    held = F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit(""))) % 3 == 1
    src = docs.select(*([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if keep else []), "doc_id", held.alias("held_out"), text_of(docs).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in pieces(batches, "text", SLICE):
            if isinstance(m, float):
                s = np.full(b.num_rows, m)
            else:
                s = m.score(m.look_up(b.column("text").to_pylist()))
                m.forget()
            cols = [b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            names = ["doc_id", "held_out", "score", "predicted"]
            if keep:
                cols, names = [b.column("row"), *cols[2:]], ["row", *names[2:]]
            yield pa.RecordBatch.from_arrays(cols, names=names)
        if isinstance(m, Model):
            m.forget(0)

    if keep:
        return arrow_map(src, run, f"row {src.schema['row'].dataType.simpleString()}, score double, predicted int").select("row.*", "score", "predicted")
    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(src, run, f"doc_id {kind}, held_out boolean, score double, predicted int")
