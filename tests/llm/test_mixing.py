from collections import defaultdict

from marshgrid.llm import mixing as M
from marshgrid.llm.mixing import mix, mixed_rows


def goals(sizes):
    """Water filling as the words of the contract say it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not full:
            target.update({s: left * weight[s] / total for s in open_})
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def test_targets_and_takes(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    rows = mix(docs)[0].collect()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
        assert r.taken <= 2 * r["size"] and r.taken == r.times * r["size"]
    want = goals(sizes)
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-6 * want[r.source] and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2
    again = mix(docs)[0].collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_draws_are_whole_and_disjoint(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    per_document, draws = mix(docs)
    got = draws.collect()
    assert all(r.shard is not None for r in got)
    times = {r.doc_id: r.times for r in per_document.collect()}
    count = defaultdict(list)
    for r in got:
        count[r.doc_id].append(r.epoch)
    assert all(sorted(count[d]) == list(range(t)) for d, t in times.items())
    shards = defaultdict(int)
    for r in got:
        shards[r.shard] += 1
    assert len(shards) == 16 and max(shards.values()) < 2 * len(got) / 16
    assert mixed_rows(docs).count() == len(got)


def test_odd_rows(odd_docs, no_docs):
    out = mix(odd_docs)[0]
    assert out.count() == odd_docs.count()
    rows = out.collect()
    assert all(r.taken <= 2 * r["size"] for r in rows)
    assert {r.source for r in rows} == {"a", "b", "c", "d", None}
    assert mixed_rows(odd_docs).columns == [*odd_docs.columns, "epoch", "shard", "place"]
    assert mixed_rows(odd_docs).count() > 0
    assert mix(no_docs)[0].count() == 0 and mixed_rows(no_docs).count() == 0


def test_taken_shows_draws_that_the_tree_loses(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert all(r.taken == r.times * r["size"] for r in mix(docs)[0].collect())
    split = M.split_quotas
    monkeypatch.setattr(M, "split_quotas", lambda *how: split(*how).where("shard <> 3"))
    rows = mix(docs)[0].collect()
    assert len(rows) == docs.count() and sum(r.taken for r in rows) < sum(r.times * r["size"] for r in rows)


def test_null_ids_are_drawn_like_others(spark):
    rows = [(None if k % 3 == 0 else k, f"{'a b c ' * (1 + k % 5)}t{k}", "ab"[k % 2]) for k in range(60)]
    rows += [(7, "same id and text", "a"), (7, "same id and text", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, got = defaultdict(int), defaultdict(int)
    for r in mix(docs)[0].collect():
        assert r.taken == r.times * r["size"]
        want[r.doc_id, r.source] += r.taken
    out = mixed_rows(docs).collect()
    for r in out:
        got[r.doc_id, r.source] += len(r.text.split())
    assert any(r.doc_id is None for r in out) and got == {k: n for k, n in want.items() if n}
    goal = goals({s: sum(len(t.split()) for _, t, o in rows if o == s) for s in "ab"})
    for s in "ab":
        assert abs(sum(n for (_, o), n in got.items() if o == s) - goal[s]) <= 8


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", "x", "y", "z") for i in range(30)], "doc_id long, text string, source string, shard string, place string, row string")
    got = M.mixed_rows(docs)
    assert got.columns.count("shard") == 1 and got.count() > 0 and {r["row"] for r in got.collect()} == {"z"}
