import numpy as np

from marshgrid.llm import embedding_dedup as E


def brute(rows, threshold=0.95):
    good = {k: (i, np.array(v, float)) for k, (i, v) in enumerate(rows)
            if v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {k: set() for k in range(len(rows))}
    for a, (_, x) in good.items():
        for b, (_, y) in good.items():
            if a != b and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                links[a].add(b)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        out.append((i, len(links[k]), min(rows[s][0] for s in seen)))
    return sorted(out)


def run(spark, rows):
    got = E.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rep", "2 as n"))
    return sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect() if r.kept == (r.vec_id == r.component_id))


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(E, "TILE", 24)
    monkeypatch.setattr(E, "TILES", 2)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    v = np.concatenate([centres[rng.integers(0, 12, 260)] + rng.normal(scale=0.22, size=(260, 8)), np.repeat(centres[:1], 70, 0), rng.normal(size=(60, 8))])
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    assert run(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0] + [0.0] * 7
    rows = [(1, None), (2, []), (3, [0.0] * 8), (4, [nan] * 8), (5, [inf] + one[1:]), (6, one), (7, one), (8, [2.0] + one[1:]), (9, [-0.0, 1.0] + one[2:]),
            (10, [0.0, 1.0] + one[2:]), (11, [1.0, 2.0]), (12, [None] + one[1:])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(1, None)]) == [(1, 0, 1)]


def test_bounds_never_drop_a_pair():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 40)) * np.geomspace(3, 0.01, 40)
    axes = np.linalg.eigh(E.unit_rows(x).T @ E.unit_rows(x))[1][:, ::-1]
    i, j = E.compare(x, x, axes, 0.9)
    cosine = E.unit_rows(x) @ E.unit_rows(x).T
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*map(list, np.nonzero(cosine >= 0.9))))


def test_every_width_is_compared(spark):
    rows = [(k, [1.0, float(k), 0.0, 0.0]) for k in range(5)] + [(10, [1.0, 2.0]), (11, [1.0, 2.0]), (12, [2.0, 4.1]), (13, [2.0, -1.0]), (14, [3.0]), (15, [5.0]), (16, [-5.0])]
    got = {i: (n, c) for i, n, c in run(spark, rows)}
    assert got[10] == got[11] == got[12] == (2, 10) and got[13] == (0, 13)
    assert got[14] == got[15] == (1, 14) and got[16] == (0, 16)
    alone = {i: (n, c) for i, n, c in run(spark, rows[:5])}
    assert all(got[k] == alone[k] for k in alone)


def test_vectors_without_an_id_stand_alone(spark):
    rows = [(1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.01])]
    got = sorted(map(tuple, E.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True)], key=str)
