"""Toxic words within long words."""

import numpy as np

from lodestrand.llm import toxicity


def test_toxicity_reads_long_words():
    rng = np.random.default_rng(1)
    fill = lambda n: "".join(rng.choice(list("aeioustrnlm"), n))
    m = toxicity.train([("good nice fine " * 20) + "vilwort", "good nice fine " * 20] * 20, [1, 0] * 20)
    clean = [fill(200), "/".join(fill(5) for _ in range(40)), "好" * 100]
    for t in clean:
        k = len(t) // 2
        with_sign = t[:k] + ("/vilwort/" if "/" in t else "vilwort") + t[k:]
        a, b, spaced = m.score(m.look_up([f"nice {with_sign} nice", f"nice {t} nice", f"nice {with_sign} nice".replace("/", " ")]))
        assert a > b + 0.2 and b < 0.7 and abs(a - spaced) < 1e-4, (t, a, b)
    for t in ("短" * 200, "a/b_" * 30, "é" * 12, "x" * 22, "ก็" * 40, "İ" * 30, "_" * 40, "\ud800" * 9 + "😀" * 9):
        parts = toxicity.words_of(t)
        assert all(len(toxicity._PLAIN.sub("", p.lower()).encode("utf-8", "surrogatepass")) <= toxicity.LONG for p in parts)
        if t.isalnum():
            plain = toxicity._PLAIN.sub("", t.lower())
            assert set(plain) <= set("".join(parts).lower()) and sum(map(len, parts)) >= len(plain)


def test_characters_reach_the_score():
    """Spelling and words enter the network alone: a word never seen scores by its spelling, and gradients of both are right."""
    rng = np.random.default_rng(4)
    n = len(toxicity.spelt(["ab", "abcdef"])[1])
    word, chars = toxicity.spelt(["Ab!", "ab", "abcdef", "é" * 11])
    assert n == 2 and word[0] == word[1] and chars.shape == (4, 24) and (chars[0] == chars[1]).all()
    assert bytes(chars[2, -8:]) == b"\x01abcdef\x02" and toxicity.runs(chars)[2, -2] == toxicity.runs(toxicity.marked([b"zzbcdef"]))[0, -2]
    m = toxicity.train([("good nice fine " * 20) + "vilwort", "good nice fine " * 20] * 20, [1, 0] * 20)
    p = {k: v.astype(np.float64) for k, v in m.p.items()}
    w = rng.normal(size=(4, 2 * toxicity.CHARS))
    _, past = toxicity.spellings(p, chars, keep=True)
    g, _ = toxicity.spellings_back(p, w.astype(np.float32), past)
    for k, at in (("char", (97, 2)), ("cw", (1, 3)), ("du", (2, 5)), ("db", (4,))):
        old, eps, out = p[k][at], 1e-3, []
        for x in (old + eps, old - eps):
            p[k][at] = x
            out.append((toxicity.spellings(p, chars)[0] * w).sum())
        p[k][at] = old
        assert abs(g[k][at] - (out[0] - out[1]) / (2 * eps)) < 0.05 * max(1, abs(g[k][at])), k
    a, b = m.score(m.look_up(["nice vilworts nice", "nice goodness nice"]))
    assert a > b + 0.2
