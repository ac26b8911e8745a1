import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marshgrid.llm import common as C
from marshgrid.llm import substring as S


def brute(rows, window=20):
    """Words covered by a window seen earlier, in order of id and content."""
    keyed = sorted({(i if i is not None else 1 << 62, t) for i, t in rows}, key=lambda r: r[0])
    seen, gone = set(), {}
    for i, t in keyed:
        words = (t or "").encode().split()
        cut = set()
        for s in range(len(words) - window + 1):
            w = tuple(words[s:s + window])
            if w in seen:
                cut.update(range(s, s + window))
            seen.add(w)
        kept = b" ".join(w for k, w in enumerate(words) if k not in cut)
        gone[i, t] = (len(words), len(cut), hashlib.sha256(kept).hexdigest())
    return gone


def test_odd_rows(spark, odd_docs):
    docs = odd_docs.where("doc_id <> 12 or doc_id is null")
    out = S.remove_repeats(docs).collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert len(out) == docs.count()
    assert S.remove_repeats(docs).columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "n_removed", "kept_sha256"]
    keyed = {k[0]: v for k, v in want.items()}
    for r in out:
        assert (r.n_words, r.n_removed, r.kept_sha256) == keyed[r.doc_id if r.doc_id is not None else 1 << 62]
        assert hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == r.kept_sha256


def test_same_id_other_words(spark, odd_docs):
    assert {(r.n_words, r.n_removed) for r in S.remove_repeats(odd_docs.where("doc_id = 12")).collect()} == {(30, 0), (31, 0)}


def test_empty_table(no_docs):
    assert S.remove_repeats(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=20, max_size=120), st.integers(0, 60))
def test_equal_windows_take_equal_anchors(letters, at):
    """The same window inside two other texts has the same anchor, so no repeat is lost."""
    words = C.mix(np.array(letters, np.uint64) + np.uint64(5))
    at = min(at, len(words) - 20)
    other = np.concatenate([C.stream(9, 7), words[at:at + 20], C.stream(8, 11)])

    def anchor(w, i):
        best = S.parse(w, np.zeros(len(w), np.int64))
        return S._anchors(best, np.full(len(w), len(w)), 20, S.REACH)[0][i]
    inside = anchor(other, 7)
    if at and at + 20 < len(words):
        assert anchor(words, at) == inside
    taken = S._anchors(S.parse(words, np.zeros(len(words), np.int64)), np.full(len(words), len(words)), 20, S.REACH)
    used = set(taken[0][taken[1]].tolist()) - {0}
    assert used == set(S.parse(words, np.zeros(len(words), np.int64))[taken[2]].tolist())


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c " * 20, "x", "y", "z"), (2, "d", "p", "q", "r")], "doc_id long, text string, _key string, _starts string, c0 string")
    got = {r["doc_id"]: tuple(r)[2:5] for r in S.remove_repeats(docs).select(*docs.columns).collect()}
    assert got == {1: ("x", "y", "z"), 2: ("p", "q", "r")}
