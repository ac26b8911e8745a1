"""The sweep over cut pairs against every pair tried on its own."""

import numpy as np
import pytest

from marshgrid.operators import split as Sp

F3 = (0.70, 0.15, 0.15)


def brute(rows, cuts, buffer):
    """Best of all pairs, each counted over all footprints."""
    best = None
    for c1 in cuts:
        for c2 in cuts:
            if c2 <= c1 + buffer:
                continue
            n = [sum(e <= c1 for _, e in rows), sum(s >= c1 + buffer and e <= c2 for s, e in rows), sum(s >= c2 + buffer for s, _ in rows)]
            if min(n):
                k = sum(n)
                error = (abs(n[0] / k - F3[0]) + abs(n[1] / k - F3[1])) + abs(n[2] / k - F3[2])
                found = (error, len(rows) - k, c1, c2, *n)
                best = found if best is None or found < best else best
    return best


@pytest.mark.parametrize("seed", range(6))
def test_best_pair_of_mixed_sizes(seed):
    rng = np.random.default_rng(seed)
    rows = [(int(s), int(s + z)) for s, z in zip(rng.integers(-40, 60, 50), rng.choice([1, 4, 9, 30], 50))]
    pairs, n = np.unique(np.array(rows), axis=0, return_counts=True)
    cuts = np.unique(pairs[:, 1])
    for buffer in (0, 3, 17, 500):
        want = brute(rows, cuts.tolist(), buffer)
        for width in (len(cuts), 7, 1):  # slices of first cuts, each a task of its own
            found = [Sp.best_pair(pairs[:, 0], pairs[:, 1], n, cuts, buffer, F3, range(a, min(a + width, len(cuts)))) for a in range(0, len(cuts), width)]
            assert min((x for x in found if x is not None), default=None) == want


def test_thinned_cuts():
    cuts = np.arange(0, 1000, 3)
    want = cuts[[int(x) for x in np.linspace(0, len(cuts) - 1, 96)]]
    assert list(Sp.thinned(cuts, 96)) == list(want) and list(Sp.thinned(cuts, None)) == list(cuts)
    assert list(Sp.thinned(cuts[:5], 9)) == list(cuts[:5]) and list(Sp.thinned(cuts, 2)) == [0, 999]


def test_groups_and_five_thousand_ends(spark):
    """Many slices a group: 5,000 ends along one axis next to a group that admits no split."""
    n, side, buffer = 5000, 24, 40
    rows = [("long", 8 * k, 0, 8 * k + side, side) for k in range(n)] + [("small", 0, 0, 8, 8), ("small", 8, 0, 16, 8)]
    tiles = spark.createDataFrame(rows, "area string, top int, left int, bottom int, right int")
    got = {(r["area"], r["buffer"]): r for r in Sp.split_cuts(tiles, ["area"], [buffer, 0], seed=1).collect()}
    assert set(got) == {("long", buffer), ("long", 0)}
    start, end = np.arange(n) * 8, np.arange(n) * 8 + side
    for b in (buffer, 0):
        best = None
        train, test = np.searchsorted(end, end, "right"), n - np.searchsorted(start, end + b)
        for i in range(n):
            # All tiles are of one size: those ending by c2 less those starting before c1 + b.
            val = train - np.searchsorted(start, end[i] + b)
            ok = (end > end[i] + b) & (val > 0) & (test > 0)
            if ok.any():
                k = train[i] + val + test
                error = np.where(ok, (np.abs(train[i] / k - .7) + np.abs(val / k - .15)) + np.abs(test / k - .15), np.inf)
                j = min(np.flatnonzero(error == error.min()), key=lambda x: (n - k[x], x))
                found = (error[j], n - k[j], end[i], end[j])
                best = found if best is None or found < best else best
        r = got["long", b]
        assert (r["axis"], r["error"], r["waste"], r["c1"], r["c2"]) == (0, *best)
    with pytest.raises(ValueError):
        Sp.split_cuts(tiles, ["area"], [0], max_cuts=1)
