"""The whole pipeline over a small table against plain Python, stage by stage."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
import test_minhash
import test_mixing
import test_quality
import test_substring
from conftest import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, shard string"


def fixture_rows():
    """Prose in two languages, junk, exact and near copies, shared passages, nulls; columns named like inner ones."""
    turned = " ".join(w[::-1] for w in prose(150, 900).split())
    texts = [(prose(120 + k, k), "en") for k in range(24)]
    texts += [(" ".join(w[::-1] for w in prose(130 + k, 100 + k).split()), "de") for k in range(12)]
    texts += [(prose(121, 1), "en"), (turned, "de"), (turned, None)]
    texts += [(test_minhash.changed(prose(140, 20), k % 3, k), "en") for k in range(5)]
    passage = prose(60, 700)
    texts += [(f"{prose(90, 300 + k)}\n{passage}\n{prose(90, 400 + k)}", "en") for k in range(4)] + [(passage, "en")]
    texts += [("x # $ 1 2 3 " * 60, "en"), ("two words", "de"), ("", "en"), (None, "en"), (None, None), ("01 23 45 67 89 ### %% " * 5 + prose(12, 5), None)]
    rows = [(k, t, lang, ("a", "b", "a", None, "c")[k % 5], len(t or ""), f"key{k}", "given") for k, (t, lang) in enumerate(texts)]
    return rows + [(None, prose(80, 950), "en", "b", None, None, "given")]


def plain(r):
    return tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars", "_key", "shard"))


def test_run_against_brute_force(spark, tmp_path, monkeypatch):
    rows = fixture_rows()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    paths, folder = [], corpus_pipeline.shared_folder
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda s, name: paths.append(folder(s, name)) or paths[-1])
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [p.rsplit("/", 1)[-1].split("-")[0] for p in paths] == ["quality", "near", "substring", "mixing"]
    good, apart, cut, mixed = ([plain(r) for r in spark.read.parquet(p).collect()] for p in paths)

    verdicts = test_quality.brute([(r[1], r[2]) for r in rows])
    want = [r for r, v in zip(rows, verdicts) if v[6]]
    assert Counter(good) == Counter(want) and 40 < len(want) < len(rows)

    classes = test_minhash.classes([(r[0], r[1]) for r in want if r[0] is not None])
    want = [r for r in want if r[0] is None or classes[r[0]] == r[0]]
    assert Counter(apart) == Counter(want) and len(want) <= len(good) - 5

    gone = test_substring.brute([(r[0], r[1]) for r in want])
    found = {r[0]: r for r in cut}
    assert len(found) == len(cut)
    for r in want:
        n, lost, digest = gone[r[0] if r[0] is not None else 1 << 62, r[1]]
        if lost == n:
            assert r[0] not in found
            continue
        got = found.pop(r[0])
        assert hashlib.sha256(b" ".join(got[1].encode().split())).hexdigest() == digest
        assert got[2:4] == r[2:4] and got[5:] == r[5:]
        assert got[4] == (len(got[1]) if lost else r[4]) and (lost or got[1] == r[1])
    assert not found and any(x[1] for x in gone.values())

    drawn, sizes, taken, largest = Counter(mixed), defaultdict(int), defaultdict(int), defaultdict(int)
    assert set(drawn) <= set(cut) and max(drawn.values()) <= 2
    for r in cut:
        words = len(r[1].encode().split())
        sizes[r[3]] += words
        taken[r[3]] += words * drawn[r]
        largest[r[3]] = max(largest[r[3]], words)
    for s, goal in test_mixing.goals(sizes).items():
        assert abs(taken[s] - goal) <= largest[s] / 2 + 1e-6

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = [library.encode(r[1]) for r in mixed]
    hashes = spark.createDataFrame([(k, x) for k, x in enumerate(ids)], "k long, ids array<int>").select("k", F.xxhash64("ids").alias("h")).collect()
    hashes = {r.k: r.h for r in hashes}
    want = Counter((r[0], r[3], len(x), hashes[k], hashlib.sha256(r[1].encode()).hexdigest(), library.decode(x) == r[1])
                   for k, (r, x) in enumerate(zip(mixed, ids)))
    assert Counter(tuple(r) for r in last) == want


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
