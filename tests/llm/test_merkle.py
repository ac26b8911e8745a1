import hashlib
import random

from pyspark.sql import functions as F

from marshgrid.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(row, add=0):
    chars = row["n_chars"] if row["n_chars"] is None else row["n_chars"] + add
    return sha(*(enc(x) for x in (row["doc_id"], row["source"], row["lang"], chars, row["text"])))


def tree(leaves, arity):
    """(root, siblings of every leaf as (before, after) by level)."""
    paths, at, now = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(now) > 1:
        runs = [now[i:i + arity] for i in range(0, len(now), arity)]
        for p, i in zip(paths, at):
            run = runs[i // arity]
            p.append(("".join(run[:i % arity]), "".join(run[i % arity + 1:])))
        at, now = [i // arity for i in at], [sha(*run) for run in runs]
    return now[0], paths


def brute(rows, arity=2):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: (sorted(groups[g]), *tree([x[2] for x in sorted(groups[g])], arity)) for g in order}
    root, over = tree([trees[g][1] for g in order], arity)
    out = []
    for g, up in zip(order, over):
        leaves, sub, paths = trees[g]
        for (known, doc_id, leaf), path in zip(leaves, paths):
            out.append((doc_id if known else None, leaf, sub, root, sha(*(a + b for a, b in path + up))))
    return sorted(out, key=str)


def rows_of(df):
    got = merkle.verified(df).collect()
    return got, sorted([(r["id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got], key=str)


def test_equals_brute_force_on_odd_rows(spark, odd_docs):
    docs = odd_docs.withColumns({"tree": F.lit("x"), "idx": F.lit(1), "n": F.lit(2), "digest": F.lit("y"), "_row": F.lit(7)})
    for arity in (2, 3):
        got, rows = rows_of(merkle.manifest(docs, arity=arity))
        assert rows == brute([r.asDict() for r in odd_docs.collect()], arity)
        assert all(r["verified"] and r["folded_root"] == r["root"] for r in got)


def test_large_levels_take_the_shuffle_joins(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SMALL_LEVEL", 10)
    r = random.Random(4)
    rows = [(i, f"text {r.random()}", r.choice(["en", "en", "en", "de", "", None]), "s", i % 5) for i in range(333)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert rows_of(merkle.manifest(docs))[1] == brute([x.asDict() for x in docs.collect()])
    assert rows_of(merkle.manifest(docs, arity=5))[1] == brute([x.asDict() for x in docs.collect()], 5)


def test_tampering_shows(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en" if i % 3 else "de", "s", None if i == 4 else i) for i in range(20)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.verified(merkle.manifest(docs, tampered={"n_chars": F.when(F.col("doc_id").isin(3, 4), F.col("n_chars") + 1).otherwise(F.col("n_chars"))})).collect()
    assert {r["id"] for r in got if not r["verified"]} == {3}  # a null stays null


def test_one_leaf_and_none(spark, no_docs):
    one = spark.createDataFrame([(1, "a", None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = merkle.verified(merkle.manifest(one)).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["verified"] and row["proof_sha256"] == sha("")
    assert merkle.verified(merkle.manifest(no_docs)).count() == 0
