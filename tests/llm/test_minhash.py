import random
from collections import Counter

import numpy as np

from conftest import prose
from marshgrid.llm import minhash as M


def weights(text):
    words = (text or "").encode().split()
    k = min(5, len(words))
    return Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if k else Counter()


def exact(x, y):
    # Items with equal pairs of weights add equal terms.
    pairs = Counter((x[d], y[d]) for d in x.keys() | y.keys())
    return sum(n / sum(m * max(p / a, q / b) for (p, q), m in pairs.items()) for (a, b), n in pairs.items() if a and b)


def classes(rows):
    root = {i: i for i, _ in rows}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    sets = [(i, weights(t)) for i, t in rows]
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and (i == j or exact(x, y) >= 0.8):
                r, s = find(i), find(j)
                root[max(r, s)] = min(r, s)
    return {i: find(i) for i, _ in rows}


def changed(text, k, seed):
    words, r = text.split(), random.Random(seed)
    for _ in range(k):
        words[r.randrange(len(words))] = f"new{r.random()}"
    return " ".join(words)


def test_classes_against_all_pairs(spark):
    rows, n = [], 0
    for g in range(8):
        base = prose(120, g)
        for k in range(12):
            rows.append((n, changed(base, k % 7, 100 * g + k)))
            n += 1
    rows += [(n + k, prose(90, 50 + k)) for k in range(20)] + [(900, "one two"), (901, "one two"), (902, "one two three")]
    got = {r.doc_id: r.class_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_large_bucket_in_blocks(spark, monkeypatch):
    """Many distinct near copies of one text, and a chain that only later steps can join."""
    monkeypatch.setattr(M, "BLOCK", 16)
    base = prose(200, 7)
    rows = [(k, changed(base, 1 + k % 6, k)) for k in range(90)]
    got = {r.doc_id: r.class_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_odd_rows(odd_docs, no_docs):
    out = M.near_duplicates(odd_docs).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(got) == 13
    assert got[2].class_id == 1 and not got[2].kept and got[1].kept
    assert all(got[i].kept and got[i].class_id == i for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert got[None].kept and got[None].class_id is None
    assert M.near_duplicates(no_docs).count() == 0


def test_register_agreement_estimates_similarity():
    a, b = weights(prose(400, 1)), weights(changed(prose(400, 1), 12, 3))
    items = {s: np.uint64(k * 2654435761 % (1 << 61) + 17) for k, s in enumerate(a.keys() | b.keys())}
    sides = [(np.array([items[s] for s in x]), np.array(list(x.values()), float)) for x in (a, b)]
    regs = M.sketch(np.concatenate([s[0] for s in sides]), np.concatenate([s[1] for s in sides]),
                    np.repeat([0, 1], [len(a), len(b)]), 2, m=4096)
    assert abs((regs[0] == regs[1]).mean() - exact(a, b)) < 0.04
