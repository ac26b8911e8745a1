import math
import re
from collections import Counter

import pytest

from conftest import prose
from marshgrid.llm import quality as Q

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = SPLIT.findall(text)
    count = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    held = {i + k for i in range(len(words) - 4) if count[tuple(words[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(held)


def classes(text):
    import unicodedata
    out = [0] * 6
    for c in text:
        if unicodedata.category(c).startswith("L"):
            out[1 if unicodedata.category(c) == "Lu" else 0] += 1
        elif unicodedata.category(c).startswith("N"):
            out[2] += 1
        elif c in " \t\n\x0b\x0c\r":
            out[3] += 1
        elif c in ".,;:?'\"()-":
            out[4] += 1
        else:
            out[5] += 1
    return out


def distance(p, q):
    part = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0.0
    return math.sqrt(max(0.0, sum(part(a, b) + part(b, a) for a, b in zip(p, q)) / 2))


def brute(rows):
    """Verdict and distances of every row by plain Python over the whole table."""
    words = {i: SPLIT.findall(t or "") for i, (t, _) in enumerate(rows)}
    langs = Counter(lang for _, lang in rows if lang is not None)
    refs = {}
    for lang, n in langs.items():
        own = [i for i, r in enumerate(rows) if r[1] == lang]
        total = Counter(w for i in own for w in words[i])
        if n < Q.MIN_SHARE * sum(langs.values()) or not total:
            continue
        top = sorted(total.items(), key=lambda x: (-x[1], x[0].encode()))[:Q.COMMON_WORDS]
        every = sum(total.values())
        chars = [sum(c) for c in zip(*(classes(rows[i][0] or "") for i in own))]
        shares = [n / every for _, n in top]
        refs[lang] = ([c / sum(chars) for c in chars], [w for w, _ in top], shares + [max(0.0, 1 - sum(shares))])
    out = []
    for i, (t, _) in enumerate(rows):
        n, chars, symbols, dup, repeat = base(t)
        failed = n < 10 or 100 * repeat > 20 * n
        near = None
        if n and refs:
            mine, own = [c / len(t) for c in classes(t)], Counter(words[i])
            tries = []
            for lang, (cls, top, shares) in refs.items():
                s = [own[w] / n for w in top]
                tries.append((distance(mine, cls), distance(s + [1 - sum(s)], shares)))
            near = min(tries, key=sum)
        far = near and (len(t) >= Q.MIN_CHARS and near[0] > Q.MAX_CLASS_DISTANCE or n >= Q.MIN_WORDS_FOR_COMMON and near[1] > Q.MAX_WORD_DISTANCE)
        out.append((n, chars, symbols, dup, repeat, failed, bool(not failed and not far), near))
    return out


def compare(docs):
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))
    want = brute([(r.text, r.lang) for r in rows])
    got = Q.quality(docs).collect()
    assert len(got) == len(rows)
    mine = sorted(((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.class_distance, r.word_distance)
                   for r in got), key=str)
    theirs = sorted(((*w[:7], *(w[7] or (None, None))) for w in want), key=str)
    for a, b in zip(sorted(mine, key=lambda r: r[:7]), sorted(theirs, key=lambda r: r[:7])):
        assert a[:7] == b[:7]
    flat = lambda rows: sorted(x for r in rows for x in r[7:] if x is not None)
    assert flat(mine) == pytest.approx(flat(theirs), abs=1e-9)


def test_documents(spark, sf):
    compare(spark.read.parquet(f"{sf}/documents.parquet"))


def test_odd_rows(odd_docs, no_docs):
    compare(odd_docs)
    assert Q.quality(no_docs).count() == 0


def test_junk_goes_and_prose_stays(spark):
    rows = [(k, prose(200, k), "en") for k in range(30)] + [(100, " ".join(w + "%%%" for w in prose(200, 99).split()), None),
                                                        (101, prose(200, 98).upper().replace(" ", "!! "), None), (102, "buy now " * 100, "en")]
    got = {r.doc_id: r for r in Q.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[k].kept for k in range(30))
    assert not got[100].kept and not got[101].kept and not got[102].kept and not got[100].base_failed


def test_without_labels_the_base_decides(spark):
    docs = spark.createDataFrame([(1, prose(50), None), (2, "a b", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.kept for r in Q.quality(docs).collect()} == {1: True, 2: False}


def thai(n, seed):
    import random
    r = random.Random(seed)
    return " ".join("".join(r.choice("กขคงจชซญดตถทนบปผพมยรลวสหอ") + r.choice("ิีึืุู่้็์") for _ in range(r.randint(2, 5))) for _ in range(n))


@pytest.mark.parametrize("constant", [100, 1])
def test_rare_languages_are_not_held_against_others(spark, monkeypatch, constant):
    monkeypatch.setattr(Q, "CONSTANT_REFERENCES", constant)
    rows = [(k, prose(40, k), "en") for k in range(300)] + [(1000 + k, thai(600, k), "th") for k in range(2)]
    rows += [(2000 + k, prose(200, 50 + k).upper(), lang) for k, lang in enumerate(("lo", "en", "th", None))]
    got = {r.doc_id: r for r in Q.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1000].kept and got[1001].kept and {got[1000].nearest, got[1001].nearest} == {"th"}
    assert got[2000].kept and not any(got[k].kept or got[k].base_failed for k in (2001, 2002, 2003))
