from pyspark.sql import functions as F

from marshgrid.llm.language import Identifier, features, identify, train


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet").withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    model = train(docs.where("not held"))
    assert set(model.families) == {"germanic", "romance"} and model.members["germanic"] == ["de", "en"]
    got = {r.id: r for r in identify(docs.where("held"), model).collect()}
    want = {r.doc_id: r.lang for r in docs.where("held").collect()}
    assert len(got) == len(want)
    assert sum(got[i].lang_pred == lang for i, lang in want.items()) >= 0.97 * len(want)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark, odd_docs, no_docs):
    model = train(odd_docs)
    rows = identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r.id in (3, 4, 5, 10):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "de", "fr")
    assert train(no_docs) is None
    assert {(r.lang_pred, r.score) for r in identify(odd_docs, None).collect()} == {("und", 0.0)}
    assert identify(no_docs, model).count() == 0


def test_one_language_and_pieces_of_long_texts(spark, monkeypatch):
    import numpy as np

    from marshgrid.llm import common as C
    raw = np.frombuffer(("Le été " * 300).encode(), np.uint8)
    whole, _ = features(raw, np.array([0, len(raw)]))
    monkeypatch.setattr(C, "SLICE_BYTES", 64)
    pieces, _ = features(raw, np.array([0, len(raw)]))
    assert np.allclose(whole, pieces)
    only = Identifier(whole, ["fr"], {})
    assert only.predict(whole)[0] == ["fr"] and 0 <= only.predict(whole)[1][0] <= 1


def test_rare_languages_are_learned(spark, monkeypatch):
    import random

    import numpy as np

    from marshgrid.llm import language as L
    r = random.Random(1)
    text = lambda letters: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(12))
    rows = [(k, text("etaoinsh"), "en") for k in range(1500)] + [(5000 + k, text("lrdcumwf"), "de") for k in range(900)]
    rows += [(9000 + k, text("zqxjkvbp"), "zz") for k in range(20)] + [(9500 + k, text("gy"), "yy") for k in range(19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs, per_language=60)
    assert model.families == ["germanic", "zz"]
    got = {x.id: x.lang_pred for x in identify(docs, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows if lang != "yy")
    monkeypatch.setattr(L, "DRIVER_LANGUAGES", 2)
    other = train(docs, per_language=60)
    assert (other.families, other.members) == (model.families, model.members) and other.machines.keys() == model.machines.keys()
    for node, machines in model.machines.items():
        assert machines.keys() == other.machines[node].keys()
        assert all(np.allclose(w, other.machines[node][pair]) for pair, w in machines.items())
