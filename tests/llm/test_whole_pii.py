"""Long spans over the bounds of windows, and addresses without an at sign."""

import numpy as np

from lodestrand.llm import pii


class Known:
    """In place of the network: E begins an email, e and @ go on with it."""

    def decode(self, ids):
        return np.where(ids == ord("E"), 1, np.where((ids == ord("e")) | (ids == ord("@")), 2, 0)).astype(np.int8)


def test_spans_over_window_bounds():
    for n in (5, 24, 30, 40, 60, 72, 80, 81, 120, 300, 500):
        for at in range(0, 160, 1 if n < 100 else 7):
            t = "." * at + "E" + "e" * (n - 2) + "@" + "." * 150
            assert pii.decoded(Known(), [t, "", t[:at + n]]) == [[(0, at, at + n)], [], [(0, at, at + n)]], (n, at)


def test_spelled_out_addresses():
    model = pii.train([])
    texts = ["Write to jane.doe (at) example.org for help.", "contact jane [at] example dot com today", "mail anna(at)web.de please", "mail me: robert_miller AT company DOT net"]
    want = ["jane.doe (at) example.org", "jane [at] example dot com", "anna(at)web.de", "robert_miller AT company DOT net"]
    found = [[t[a:b] for _, a, b in spans] for t, (_, spans) in zip(texts, pii.find_all(model, texts))]
    assert sum(w in f for w, f in zip(want, found)) >= 3, found
    assert [s for _, s in pii.find_all(model, ["We met at the market. Then we left at noon.", "no sign or number"])] == [[], []]
    texts, spans = pii.made_up(np.random.default_rng(99), 150, spelled=True)
    got = [s for _, s in pii.find_all(model, texts)]
    hit = sum(len(set(a) & set(b)) for a, b in zip(spans, got))
    assert hit > 0.8 * sum(map(len, spans)) and hit > 0.8 * sum(map(len, got))


def brute_spans(model, t):
    """Kept spans with every window decoded, and each character labelled by the window in whose middle it lies."""
    c, n = np.pad(pii.codes(t), (0, pii.WIDTH), constant_values=32), len(t)
    starts = list(pii.window_starts(n))
    y = model.decode(np.array([c[a : a + pii.WIDTH] for a in starts]))
    label = []
    for i in range(n):
        k = min(max(0, (i - pii.SHARE // 2) // (pii.WIDTH - pii.SHARE)), len(starts) - 1)
        label.append(int(y[k, i - starts[k]]))
    spans, i = list(pii.base_spans(t)), 0
    found = []
    while i < n:
        if label[i] % 2:
            j = i + 1
            while j < n and label[j] == label[i] + 1:
                j += 1
            found.append(((label[i] - 1) // 2, i, j))
            i = j
        else:
            i += 1
    for k, a, b in found:
        b = a + len(t[a:b].rstrip())
        signs = any(x.isdigit() and x.isascii() or x == "@" for x in t[a:b]) or (k == 0 and pii._AT.search(t[a:b], 0))
        if b > a and signs and pii.plausible(k, t[a:b]) and not any(a < y and x < b for _, x, y in spans):
            spans.append((k, a, b))
    return sorted(spans)


def test_added_spans_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    model = pii.train([])
    texts = [" ".join(pii.made_up(rng, 12, spelled=i % 2 == 0)[0]) for i in range(12)] + ["no sign in this text at all " * 20, "x", "firstname.lastname.of.a.very.long.name.indeed.that.goes.on @ mail.example.com.of.a.long.host.org " * 3]
    got = pii.find_all(model, texts)
    added = 0
    for t, (base, spans) in zip(texts, got):
        want = brute_spans(model, t)
        assert spans == want, t
        added += len(spans) - len(base)
    assert added > 20
