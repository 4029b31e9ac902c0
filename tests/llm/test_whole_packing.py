"""Assignment of remainders against a plain loop over all sequences."""

import numpy as np

from lodestrand.llm import packing


def brute(lengths, size, linear, quadratic):
    rest = sorted(((int(n) % size, -i) for i, n in enumerate(lengths) if n % size), reverse=True)
    bins = [[size, 0.0, []] for _ in range(-(-sum(r for r, _ in rest) // size))]
    for left, minus in rest:
        d = -minus
        at = int(lengths[d]) - left
        while left:
            able = [b for b in bins if b[0] >= left] or [b for b in bins if b[0] == max(x[0] for x in bins)]
            b = min(able, key=lambda b: b[1])
            take = min(left, b[0])
            b[0] -= take
            b[1] += linear * take + quadratic * take * take
            b[2].append((d, at, take))
            left, at = left - take, at + take
    return [b[2] for b in bins]


def test_assign_equals_brute_force():
    rng = np.random.default_rng(3)
    for size, most, n in ((64, 200, 300), (16, 15, 100), (100, 100, 50), (2048, 3000, 400)):
        lengths = rng.integers(1, most + 1, n)
        got = packing.assign(lengths, size, 1.0, 1 / size)
        whole = sum(int(x) // size for x in lengths)
        assert got[whole:] == brute(lengths, size, 1.0, 1 / size)
        assert len(got) == -(-int(lengths.sum()) // size)
    assert packing.assign(np.array([64, 128]), 64, 1.0, 1.0) == [[(0, 0, 64)], [(1, 0, 64)], [(1, 64, 64)]]
