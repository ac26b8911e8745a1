import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from marshgrid.llm import privacy as P
from marshgrid.llm.oracle import OP13

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 14 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def base(text):
    found = sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if valid(k, m[0]))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)


TRICKY = ["a@b.c_d@e.f g@h.i.@j.k x@y", "999.2.3.4.5.6.7.8 1.2.3.4.5 01.002.3.255 1.2.3.256", "4111 1111 1111 1111 4111-1111-1111-1111-1 5 4111111111111111",
          "5-4111111111111111 a4111111111111111b é4111111111111111 00000000000000", "+1 (743) 555-3824 44657 +12345678901234567 +1 2 +44-20-7946-0958.",
          "été x@y.zé +1 555 010 9999 über a.b@c.de", "\U0001f600 \U0001f600 q@w.er 1.1.1.1", "", None, "@ + 1.2 4111", "x@y.com" * 3, "1 " * 40]


def test_fixed_patterns_equal_plain_ones(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    for r in P.sanitised_spans(docs).collect():
        want = base(TRICKY[r["doc_id"]])
        assert r["spans"] == want and r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [want.count(k) for k in PLAIN]


def test_long_runs_need_no_stack_and_many_hits_are_placed(spark):
    # Plain patterns are quadratic on these: what they would find is known.
    n = 300000
    whole = {"x" * n: "", "1" * n: "", "1 " * n: "", "a@" * n: "", "+" + "1 " * n: "", "1." * n: ",".join(f"ip:{i}:{i + 7}" for i in range(0, 2 * n - 7, 8))}
    whole["q@w.er 10.0.0.1 " * 2000] = base("q@w.er 10.0.0.1 " * 2000)
    docs = spark.createDataFrame(list(enumerate(whole)), "doc_id long, text string")
    for r in P.sanitised_spans(docs).collect():
        assert r["spans"] == list(whole.values())[r["doc_id"]]


def corpus(spark):
    """One address always with the same nickname, some common words, and 150 other texts."""
    rows = [(i, f"Number {chr(97 + i % 20) * 4} says: write to Zorro, mail z{i % 2}.r@host.org now. Thanks and {'more ' * i}the end. ZORRO", f"t{i}") for i in range(10)]
    rows += [(100 + i, f"now more of the end of thanks and mail number {i} says write", "t") for i in range(150)]
    rows += [(400 + i, "copy only rareword near b@c.de", "c") for i in range(6)] + [(500, None, None), (None, "", "x"), (600, "the zorro alone", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, term string")


def test_disclosing_terms(spark):
    docs = corpus(spark)
    got = {r["doc_id"]: r for r in P.sanitised_spans(docs, generalise_at=0.7).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i in range(10):
        terms = [text[i][int(a):int(b)] for a, b in re.findall(r"term:(\d+):(\d+)", got[i]["spans"])]
        assert terms == ["Zorro", "ZORRO"] and got[i]["n_email"] == 1
    # Copies of one text prove nothing; a document without an entity stays as it is.
    assert all("term" not in got[400 + i]["spans"] for i in range(6)) and got[600]["spans"] == ""
    clean = {r["doc_id"]: r["clean_text"] for r in P.sanitise(docs, generalise_at=0.7).collect()}
    assert clean[0] == "Number aaaa says: write to <TERM>, mail <EMAIL> now. Thanks and the end. <TERM>" and clean[600] == text[600]
    gone = {r["doc_id"]: r["clean_text"] for r in P.sanitise(docs, generalise_at=0.7, remove_at=0.7).collect()}
    assert gone[0] == "Number aaaa says: write to , mail <EMAIL> now. Thanks and the end. "


def test_equals_sql_with_terms(spark):
    rows = [(i, f"call Zorro at 10.0.0.{i % 2 + 1} or {'x' * (i + 3)} twice Zorro", "") for i in range(8)] + [(50 + i, f"plain text {i} with words", "") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, term string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = sorted(con.execute(OP13).fetchall())
    got = sorted(tuple(r) for r in P.sanitised_spans(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect())
    assert got == want


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumns({"row": F.lit(1), "found": F.lit("x"), "pairs": F.lit("x"), "_all": F.lit(2), "_whole": F.lit("w")})
    assert P.sanitised_spans(docs).count() == odd_docs.count()
    clean = sorted(str(r["clean_text"]) for r in P.sanitise(docs).collect())
    assert clean == sorted(r["text"] or "" for r in odd_docs.collect())
    assert P.sanitised_spans(no_docs).count() == 0
