"""Personal data by a character-level bidirectional LSTM with CRF transitions, trained in numpy.

Four kinds are marked with begin and inside labels: email, ip, card, phone. The network learns from
labelled spans: what the base patterns find in a bounded sample of documents, and made-up sentences
with the same kinds in forms that the patterns miss (spaced or spelled-out addresses, national numbers, cards
with other signs). Texts are cut into overlapping windows; each window is decoded by Viterbi's
algorithm, and the decodings are reconciled over the whole text: of two windows, each position
belongs to the one in whose middle it lies, and spans are read from the labels so joined, over the windows'
bounds. Base spans always stay; a decoded span is added where it overlaps none and has the digits of its kind.

Every kind needs a digit or an at sign, or for an email that the sign is spelled out (_AT). A span without these is
never kept, so windows are run through the network where one of these lies, and then those on either side
as far as a span goes on: the result is that of running all windows.

Training takes at most `sample` documents by hash of the id (of texts up to `sample_chars` characters), on
the driver; every text is searched whole. Defined results: null and empty texts have no spans; equal texts
have equal spans; repeated rows are searched each; ties can't occur, as spans of one kind don't overlap; an empty table
gives no rows (and trains on the made-up sentences alone).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, hash_sample, pieces, text_of
from .nets import F32, Adam, lstm, lstm_back, uniform

KINDS = ("email", "ip", "card", "phone")
WIDTH, SHARE, DIM, HIDDEN, LABELS = 96, 48, 8, 12, 1 + 2 * len(KINDS)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
#: An at sign spelled out, as a word of its own: 'jane (at) example.org', 'jane AT example dot com'.
_AT = re.compile(r"\uff20|(?<![^\W\d_])(?:at|arroba|\u00e4t)(?![^\W\d_])", re.I)
_DOT = re.compile(r"[.\uff0e](?=[^\W_])|(?<=\s)[.\uff0e]|(?<![^\W\d_])(?:dot|punto|punkt|point)(?![^\W\d_])", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and non-overlapping for each kind, sorted."""
    out = []
    if "@" in text:
        at, free = text.find("@"), 0
        while at >= 0:
            a = at  # the leftmost start, without running over the text for every start
            while a > free and text[a - 1] in _LOCAL:
                a -= 1
            m = _EMAIL.match(text, a) if a < at else None
            if m:
                out.append((0, a, m.end()))
                free = m.end()
            at = text.find("@", max(at + 1, free))
    if not _SIGN.search(text):
        return out
    if "." in text:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return sorted(out)


def codes(text: str) -> np.ndarray:
    """Classes of characters: ASCII as they are, letters of other scripts 1, spaces 32, all else 2."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if (c < 128).all():
        return c.astype(np.int16)
    out = np.where(c < 128, c, 1).astype(np.int16)
    for i in np.flatnonzero(c >= 128):
        ch = text[i]
        if not ch.isalpha():
            out[i] = 32 if ch.isspace() else 2
    return out


def made_up(rng: np.random.Generator, n: int, spelled: bool = False) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """Sentences with labelled spans in many forms, and others with numbers that are none of the kinds.

    spelled: all spans are emails whose at sign is spelled out, among prose that has the word `at` as well.
    """
    words = "the of and to in is on for with er ing tion that was are from le des que und der das los por para call mail write pay with number host server contact me at or id ref order page about".split()
    pick = lambda x: x[int(rng.integers(len(x)))]
    num = lambda k: "".join(str(int(rng.integers(10))) for _ in range(k))

    def card() -> str:
        d = pick("3456") + num(int(rng.integers(14, 17)))
        d += next(str(x) for x in range(10) if luhn(d + str(x)))
        s = pick(["", " ", "-", ".", "/"])
        return s.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        return pick([f"+{num(2)} {num(3)} {num(3)} {num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+1 ({num(3)}) 555-{num(4)}", f"0{num(2)}/{num(7)}", f"{num(3)}.{num(3)}.{num(4)}", f"00{num(2)} {num(3)} {num(6)}", f"+{num(11)}"])

    def email() -> str:
        name = pick(words) + pick(["", ".", "_", "-", "+"]) + pick(words) + pick(["", num(1), num(2)])
        host = pick(["mail", "example", pick(words), "mail" + num(1)]) + "." + pick(["com", "org", "net", "example.com", "co.uk"])
        return pick([f"{name}@{host}", f"{name}@{host}", f"{name} @ {host}", f"{name} (at) {host}{num(1)}", f"{name}@{host.replace('.', ' . ', 1)}", f"{name}[@]{host}", f"{name}@localhost"])

    def ip() -> str:
        p = [str(int(rng.integers(256))) for _ in range(4)]
        return pick([".".join(p), ".".join(p), " . ".join(p), "[.]".join(p)])

    def other() -> str:
        return pick([num(int(rng.integers(1, 7))), num(4) + "-" + num(2) + "-" + num(2), num(2) + ":" + num(2), num(1) + "." + num(2), "$" + num(3) + "." + num(2), num(16), num(20), "".join(pick("0123456789abcdef") for _ in range(40)), f"v{num(1)}.{num(1)}.{num(2)}", f"{num(1)},{num(3)},{num(3)}", f"@{pick(words)}", f"{pick(words)}{num(2)}", f"token = {num(3)}ab{num(5)}"])

    part = lambda: "".join(pick("bcdfghjklmnprstvwz") + pick("aeiou") + pick(["", "", pick("lnrst")]) for _ in range(int(rng.integers(1, 4))))

    def spelled_out() -> str:
        at = pick([" (at) ", "(at)", " [at] ", "[at]", " at ", " AT ", " (AT) ", "_at_", " <at> ", " {at} "])
        dot = pick([".", ".", " dot ", " [dot] ", " (dot) ", "[.]", " DOT ", "(dot)"])
        if at in (" at ", " AT "):
            dot = pick([".", " dot ", " [dot] ", " DOT "])
        name = pick([part(), pick(words)]) + pick(["", pick([".", "_", "-"]) + pick([part(), pick(words)])])
        if dot != "." and rng.random() < 0.3:
            name = name.replace(".", dot)
        host = pick([part(), part() + part(), "example", "mail", pick(words), part() + "-" + part()])
        return name + at + dot.join([*([part()] if rng.random() < 0.25 else []), host, pick(["com", "org", "net", "de", "edu", "info", "co.uk".replace(".", dot)])])

    def prose() -> str:
        return pick([part(), f"at {part()}", f"at the {part()}", f"{part()} at {pick(words)}. {part()}", f"looked at {part()}. The", f"{part()}.", f"the dot on {part()}", f"{part()} at home.", f"at {part()}.{part()}"[:12], f"(at {part()})", f"Meet at {part()}, {part()}"])

    texts, spans = [], []
    for _ in range(n if spelled else 0):
        t, s = "", []
        for _ in range(int(rng.integers(6, 24))):
            if rng.random() < 0.15:
                x = spelled_out()
                s.append((0, len(t), len(t) + len(x)))
            else:
                x = prose() if rng.random() < 0.4 else pick(words)
            t += x + pick([" ", " ", " ", ", ", ". ", "\n", "; "])
        texts.append(t)
        spans.append(s)
    for _ in range(0 if spelled else n):
        t, s = "", []
        for _ in range(int(rng.integers(6, 24))):
            r = rng.random()
            if r < 0.16:
                k = int(rng.integers(4))
                x = (email, ip, card, phone)[k]()
                s.append((k, len(t), len(t) + len(x)))
            else:
                x = other() if r < 0.3 else pick(words)
            t += x + pick([" ", " ", " ", ", ", ". ", "\n", "### ", "; "])
        texts.append(t)
        spans.append(s)
    return texts, spans


class Model:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    def emissions(self, ids: np.ndarray, keep: bool = False) -> tuple:
        p, k = self.p, 4 * HIDDEN
        table = p["char"] @ p["w"] + p["b"]
        x = table[ids]
        f, pf = lstm(x[:, :, :k], p["uf"], None, keep)
        b, pb = lstm(x[:, ::-1, k:], p["ub"], None, keep)
        h = np.concatenate([f, b[:, ::-1]], axis=2)
        return h @ p["wo"] + p["bo"], (pf, pb, h)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best labels of each window."""
        e, _ = self.emissions(ids)
        t = self.p["trans"] + _FORBID
        n, width, _ = e.shape
        score = e[:, 0] + _START
        back = np.empty((n, width, LABELS), np.int8)
        for i in range(1, width):
            x = score[:, :, None] + t
            back[:, i] = x.argmax(axis=1)
            score = x.max(axis=1) + e[:, i]
        out = np.empty((n, width), np.int8)
        out[:, -1] = score.argmax(axis=1)
        rows = np.arange(n)
        for i in range(width - 1, 0, -1):
            out[:, i - 1] = back[rows, i, out[:, i]]
        return out


#: An inside label follows its own kind's labels only. A window may begin within a span.
_FORBID = np.zeros((LABELS, LABELS), F32)
for _j in range(2, LABELS, 2):
    _FORBID[[i for i in range(LABELS) if i not in (_j - 1, _j)], _j] = -1e4
_START = np.zeros(LABELS, F32)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def crf_grads(e: np.ndarray, trans: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss a window, and gradients of emissions and transitions."""
    n, width, k = e.shape
    t = trans + _FORBID
    a, b = np.empty_like(e), np.zeros_like(e)
    a[:, 0] = e[:, 0]
    for i in range(1, width):
        a[:, i] = _logsumexp(a[:, i - 1, :, None] + t, 1) + e[:, i]
    for i in range(width - 2, -1, -1):
        b[:, i] = _logsumexp(t + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2)
    z = _logsumexp(a[:, -1], 1)
    de = np.exp(a + b - z[:, None, None])
    dt = np.zeros_like(trans)
    for i in range(1, width):
        dt += np.exp(a[:, i - 1, :, None] + t + (e[:, i] + b[:, i])[:, None, :] - z[:, None, None]).sum(axis=0)
    rows, cols = np.arange(n)[:, None], np.arange(width)[None, :]
    gold = e[rows, cols, y].sum() + t[y[:, :-1], y[:, 1:]].sum()
    de[rows, cols, y] -= 1
    np.add.at(dt, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
    return float((z.sum() - gold) / n), (de / n).astype(F32), (dt / n).astype(F32)


def labels_of(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for k, a, b in spans:
        y[a:b] = 2 + 2 * k
        y[a] = 1 + 2 * k
    return y


def train(texts: list[str], made: int = 1500, epochs: int = 7, batch: int = 64, seed: int = 5) -> Model:
    """Fit on what the base patterns find in texts and on made-up sentences."""
    rng = np.random.default_rng(seed)
    ids, ys = [], []

    def add(text: str, spans: list[tuple[int, int, int]], keep: float) -> None:
        c, y = np.pad(codes(text), (0, WIDTH), constant_values=32), np.pad(labels_of(len(text), spans), (0, WIDTH))
        for a in window_starts(len(text)):
            if y[a : a + WIDTH].any() or ((_SIGN.search(text, a, a + WIDTH) or _AT.search(text, a, a + WIDTH)) and rng.random() < keep):
                ids.append(c[a : a + WIDTH])
                ys.append(y[a : a + WIDTH])

    for t in texts:
        add(t, [s for s in base_spans(t)], 0.5)
    most = 3000
    if len(ids) > most:
        keep = rng.permutation(len(ids))[:most]
        ids, ys = [ids[i] for i in keep], [ys[i] for i in keep]
    for t, s in zip(*made_up(rng, made)):
        add(t, s, 0.5)
    for t, s in zip(*made_up(rng, made, spelled=True)):
        add(t, s, 0.5)
    x, y = np.array(ids), np.array(ys)
    p = {"char": uniform(rng, 128, DIM) * 4, "w": uniform(rng, DIM, 8 * HIDDEN), "b": np.zeros(8 * HIDDEN, F32), "uf": uniform(rng, HIDDEN, 4 * HIDDEN), "ub": uniform(rng, HIDDEN, 4 * HIDDEN), "wo": uniform(rng, 2 * HIDDEN, LABELS), "bo": np.zeros(LABELS, F32), "trans": np.zeros((LABELS, LABELS), F32)}
    for a in (0, 4 * HIDDEN):
        p["b"][a + HIDDEN : a + 2 * HIDDEN] = 1  # remember, at first
    model, adam = Model(p), Adam(p, rate=1e-2)
    for epoch in range(epochs):
        adam.rate = 1e-2 if epoch < epochs - 2 else 2e-3
        perm = rng.permutation(len(x))
        for a in range(0, len(perm), batch):
            i = perm[a : a + batch]
            e, (pf, pb, h) = model.emissions(x[i], keep=True)
            _, de, dt = crf_grads(e, p["trans"], y[i])
            g = {"trans": dt, "wo": np.einsum("bth,btk->hk", h, de), "bo": de.sum(axis=(0, 1))}
            dh = de @ p["wo"].T
            dxf, g["uf"] = lstm_back(np.ascontiguousarray(dh[:, :, :HIDDEN]), p["uf"], None, pf)
            dxb, g["ub"] = lstm_back(np.ascontiguousarray(dh[:, ::-1, HIDDEN:]), p["ub"], None, pb)
            dx = np.concatenate([dxf, dxb[:, ::-1]], axis=2).reshape(-1, 8 * HIDDEN)
            flat = x[i].ravel()
            dtable = np.stack([np.bincount(flat, v, 128) for v in dx.T], axis=1).astype(F32)
            g["w"], g["b"], g["char"] = p["char"].T @ dtable, dtable.sum(axis=0), dtable @ p["w"].T
            adam.step(g, clip=5.0)
    return model


def window_starts(n: int) -> range:
    """Starts of windows that share SHARE characters with the next; the last one reaches the end."""
    return range(0, max(1, n - SHARE), WIDTH - SHARE)


def plausible(kind: int, s: str) -> bool:
    d = sum("0" <= c <= "9" for c in s)
    if kind == 0:
        at = None if "@" in s or d > 0 else _AT.search(s, 1)
        return ("@" in s or d > 0 or (at is not None and _DOT.search(s, at.end()) is not None)) and sum(c.isalpha() for c in s) >= 4
    return (4 <= d <= 12, 15 <= d <= 19, 7 <= d <= 15)[kind - 1] and (kind != 1 or s.count(".") == 3)


def decoded(model: Model, texts: list[str], batch: int = 1024) -> list[list[tuple[int, int, int]]]:
    """Spans found by the network in each text, reconciled over its windows."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    step, half = WIDTH - SHARE, SHARE // 2
    known: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}  # padded codes, joined labels, last window
    todo, seen = [], set()

    def ask(d: int, k: int) -> None:
        if 0 <= k <= known[d][2] and (d, k) not in seen:
            seen.add((d, k))
            todo.append((d, k))

    for d, t in enumerate(texts):
        for sign in (_SIGN, _AT):
            for m in sign.finditer(t):
                if d not in known:
                    known[d] = np.pad(codes(t), (0, WIDTH), constant_values=32), np.zeros(len(t) + WIDTH, np.int8), len(window_starts(len(t))) - 1
                ask(d, min(max(0, (m.start() - half) // step), known[d][2]))  # the window that owns the place
    while todo:
        now, todo = todo[:batch], todo[batch:]
        y = model.decode(np.array([known[d][0][k * step : k * step + WIDTH] for d, k in now]))
        for row in np.flatnonzero(y.any(axis=1)):
            d, k = now[row]
            _, joined, end = known[d]
            # the window's own part: from the middle of what it shares with one neighbour to that with the other
            lo, hi = (0 if k == 0 else half), (WIDTH if k == end else WIDTH - half)
            joined[k * step + lo : k * step + hi] = y[row, lo:hi]
            if y[row, lo] and y[row, lo] % 2 == 0:  # within a span: it began before
                ask(d, k - 1)
            if y[row, hi - 1]:
                ask(d, k + 1)
    for d, (_, joined, _) in known.items():
        n = len(texts[d])
        for i in np.flatnonzero(joined[:n] % 2 == 1):
            j = int(i) + 1
            while j < n and joined[j] == joined[i] + 1:
                j += 1
            out[d].append(((int(joined[i]) - 1) // 2, int(i), j))
    return out


def find_all(model: Model, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and all spans of each text, sorted by kind, then start."""
    res = []
    for t, found in zip(texts, decoded(model, texts)):
        base = base_spans(t)
        spans = list(base)
        for k, a, b in sorted(found, key=lambda s: (s[1], s[0])):
            while b > a and t[b - 1].isspace():
                b -= 1
            if b > a and (_SIGN.search(t, a, b) or (k == 0 and _AT.search(t, a, b))) and plausible(k, t[a:b]) and not any(a < y and x < b for _, x, y in spans):
                spans.append((k, a, b))
        res.append((base, sorted(spans)))
    return res


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def sample_texts(docs: DataFrame, sample: int, sample_chars: int) -> list[str]:
    """At most `sample` texts with digits or at signs, by hash of the id."""
    src = docs.select("doc_id", text_of(docs).alias("text")).filter((F.length("text") <= sample_chars) & F.col("text").rlike("[0-9@]"))
    return [r[0] for r in hash_sample(src, sample, "doc_id", "text").select("text").collect()]


def find(docs: DataFrame, sample: int = 600, sample_chars: int = 8_000) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and spans for each row of docs(doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]
    model = train(sample_texts(docs, sample, sample_chars))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    src = docs.select("doc_id", text_of(docs).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            found = find_all(shared.value, b.column("text").to_pylist())
            count = lambda k: pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64())
            sha = [hashlib.sha256(digest(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(count, range(4)), pa.array(sha, pa.string()), pa.array([digest(s) for _, s in found], pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return arrow_map(src, run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
