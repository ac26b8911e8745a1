import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from marshgrid.llm import sentencepiece as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = S.model(PATH)


def scanned(text, chunk):
    """All chunks of one text by the same functions that the Spark job runs."""
    text = MODEL.normal(text)
    n = -(-len(text) // chunk)
    parts, cells = [], []
    for c in range(n):
        lo, hi = c * chunk, min(len(text), (c + 1) * chunk)
        base = max(0, lo - MODEL.longest)
        part = text[base:min(len(text), hi + MODEL.longest)]
        got = MODEL.transfer(part, lo - base, hi - base, c == 0, c == n - 1)
        cells.append([((a + base, p), (b + base, q)) for (a, p), (b, q) in got])
        parts.append((part, base, lo - base, hi - base, c == n - 1))
    states = S._settle(cells, (0, ""), None)
    # The product of halves is the product of all.
    half = S._product(S.functools.reduce(S._product, cells[:n // 2 or 1]), S.functools.reduce(S._product, cells[n // 2 or 1:])) if n > 1 else cells[0]
    assert ((0, ""), states[-1]) in half
    out = b"".join(MODEL.walk(p, (e[0] - b, e[1]), (x[0] - b, x[1]), lo, hi, f)
                   for (p, b, lo, hi, f), e, x in zip(parts, states, states[1:]))
    return list(S.array("i", out))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab the ingon\n.é☃日本▁<s>", min_size=1, max_size=60), st.integers(1, 40))
def test_scan_equals_library(text, chunk):
    want = LIBRARY.encode(text)
    assert scanned(text, chunk) == want
    assert MODEL.encode(MODEL.normal(text)) == want
    if "▁" not in text:
        assert MODEL.decode(want) == text


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for chunk in (S.CHUNK, 500):
        rows = S.decode(S.encode(docs, PATH, chunk=chunk), PATH).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert list(r.ids) == LIBRARY.encode(r.text) and r.decoded == r.text


def test_odd_rows(odd_docs, no_docs):
    docs = odd_docs.withColumnRenamed("n_words", "ids")
    rows = S.decode(S.encode(docs, PATH, chunk=1000), PATH).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.decoded == r.text
        assert r.ids is None if r.text is None else list(r.ids) == LIBRARY.encode(r.text)
    assert S.decode(S.encode(no_docs, PATH), PATH).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two " * 3000, "a", "b", "c"), (2, "short", "d", "e", "f")], "doc_id long, text string, id string, states string, tkey string")
    got = {r["doc_id"]: r for r in S.encode(docs, PATH).collect()}
    assert [got[1][c] for c in ("id", "states", "tkey")] == ["a", "b", "c"] and len(got[1]["ids"]) > 3000 and got[2]["id"] == "d"


def test_decoded_beside_the_ids_equals_decoding_them(spark, odd_docs):
    docs = odd_docs.selectExpr("doc_id", "text", "source AS decoded")
    both = S.encode(docs, PATH, decoded=True)
    assert both.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted(map(str, both.collect())) == sorted(map(str, S.decode(S.encode(docs.drop("decoded"), PATH), PATH).collect()))
