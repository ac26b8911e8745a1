r"""Personal data in texts and the terms that disclose it, on DataFrame functions only.

Fixed patterns find e-mail addresses, IPv4 addresses, payment cards (Luhn) and phone
numbers: the protected entities.  The corpus then tells which terms near an entity reveal
it.  With shares of documents, a term's pointwise mutual information with an entity,
log(p(e, t) / (p(e) p(t))), is at most the entity's information content, -log p(e); their
ratio is the disclosure, 1 where the term occurs with the entity only.  Terms at or above
``generalise_at`` are generalised, those at or above ``remove_at`` removed, in the documents
where they stand near the entity.  A pair counts from ``min_texts`` different texts on, so
copies of one text prove nothing.

Every pattern is written so that each start fails at once or consumes what it reads: long
runs of letters or digits cost linear time and no stack.

Defined results: a null text is empty; an empty one has no spans; a null id is kept; repeated rows
are judged one by one; on an empty table the result is empty; columns that are not named
are ignored.  Spans are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marshgrid.llm.common import fixed, let, saved

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: The fixed patterns.  Runs are possessive, and a run is entered at its beginning or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
#: Of the maximal runs of digits with single separators, those of 14 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A part of an address up to 255, leading zeros allowed.
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Terms are runs of letters; so many on either side of an entity, within so many characters, are its context.
WORD = r"[\p{L}\p{M}]{3,}"
CONTEXT_TERMS, CONTEXT_CHARS = 8, 160
MIN_TEXTS, GENERALISE_AT, REMOVE_AT = 3, 0.9, 0.99
_BLOCK = 256


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid Luhn sum."""
    def sum_of(d):
        doubled = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substr(d, F.length(d) + 1 - i, F.lit(1)).cast("int") * (2 - i % 2))
        return F.aggregate(doubled, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))
    return let(digits, lambda d: sum_of(d) % 10 == 0)


def running(values: Column) -> Column:
    """Sums of all earlier values of an int array, in blocks, so that long arrays are not copied for every element."""
    def exclusive(a):
        start = F.struct(F.lit(0).alias("sum"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(a, start, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out")))

    def blocks(v):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: exclusive(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))))

    def joined(parts):
        before = exclusive(F.transform(parts, lambda p: p["sum"]))["out"]
        return let(before, lambda at: F.flatten(F.transform(parts, lambda p, b: F.transform(p["out"], lambda x: x + F.get(at, b)))))
    return let(values, lambda v: F.when(F.size(v) > 0, let(blocks(v), joined)).otherwise(F.expr("cast(array() as array<int>)")))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(value, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    """What makes two mentions the same entity."""
    return F.concat(F.lit(kind + ":"), F.lower(value) if kind == "email" else value if kind == "ip" else _digits(value))


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _context(before: Column, after: Column) -> Column:
    """Terms next to a mention: the last of what stands before it and the first of what follows."""
    def near(text, cut):
        # A word that the cut may have split is left out, as is anything around an @.
        edge = r"^[\p{L}\p{M}]+" if cut is left else r"[\p{L}\p{M}]+\z"
        whole = F.when(F.length(text) > CONTEXT_CHARS, F.regexp_replace(cut, edge, "")).otherwise(cut)
        return terms_of(F.regexp_replace(whole, r"[^\x20\x09-\x0D@]*+@[^\x20\x09-\x0D]*+", " "))
    left = F.substring(before, -CONTEXT_CHARS, CONTEXT_CHARS)
    right = F.substring(after, 1, CONTEXT_CHARS)
    return F.concat(let(near(before, left), lambda w: F.slice(w, F.greatest(F.size(w) - CONTEXT_TERMS, F.lit(0)) + 1, F.lit(CONTEXT_TERMS))),
                    F.slice(near(after, right), 1, CONTEXT_TERMS))


def _pieces(text: Column, pattern: Column) -> Column:
    """(hits, gaps, starts) of a pattern: there is one gap more than hits."""
    def of(hits):
        gaps = F.when(F.size(hits) > 0, F.split(text, pattern, -1)).otherwise(F.expr("cast(array() as array<string>)"))

        def with_gaps(g):
            steps = F.transform(hits, lambda h, k: F.length(h) + F.length(F.get(g, k)))
            starts = let(running(steps), lambda at: F.transform(at, lambda x, k: x + F.length(F.get(g, k))))
            return F.struct(hits.alias("hits"), g.alias("gaps"), starts.alias("starts"))
        return let(gaps, with_gaps)
    return let(F.regexp_extract_all(text, pattern, F.lit(0)), of)


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its protected entities, written to the shared folder.

    Columns: row, doc_id, text_key, ``found`` (start, kind_no, end, entity) sorted, ``pairs``
    (entity, term) of the contexts without repeats, and text where there are pairs.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    # Cheap tests keep the patterns off texts that cannot match.
    tests = {"email": F.col("text").contains("@"), "ip": F.regexp_like("text", F.lit(r"[0-9]\.[0-9]")),
             "card": F.regexp_like("text", F.lit("[0-9][0-9\\x20-]{12}")), "phone": F.col("text").contains("+")}
    patterns = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE)))
    empty = F.expr("cast(named_struct('hits', array(), 'gaps', array(), 'starts', array()) as struct<hits:array<string>,gaps:array<string>,starts:array<int>>)")
    rows = fixed(rows, **{f"_{k}": F.when(tests[k], _pieces(F.col("text"), F.lit(patterns[k]))).otherwise(empty) for k in KINDS})
    def of_kind(no: int, kind: str) -> Column:
        p = F.col(f"_{kind}")
        one = F.transform(p["hits"], lambda h, k: F.struct(
            F.get(p["starts"], k).alias("start"), F.lit(no).alias("kind_no"), (F.get(p["starts"], k) + F.length(h)).alias("end"),
            F.when(_valid(kind, h), _entity(kind, h)).alias("entity"), k.alias("k")))
        return F.transform(F.filter(one, lambda x: x["entity"].isNotNull()), lambda x: F.struct(
            x["start"], x["kind_no"], x["end"], x["entity"], _context(F.get(p["gaps"], x["k"]), F.get(p["gaps"], x["k"] + 1)).alias("terms")))
    every = [of_kind(no, kind) for no, kind in enumerate(KINDS)]
    rows = fixed(rows, _all=F.array_sort(F.concat(*every)))
    # Joined strings compare as wholes, which keeps the removal of repeats linear.
    pairs = F.array_distinct(F.flatten(F.transform("_all", lambda m: F.transform(m["terms"], lambda t: F.concat(m["entity"], F.lit("\t"), t)))))
    rows = fixed(rows, pairs=pairs)
    return saved(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.when(F.size("_all") > 0, F.xxhash64("text")).alias("text_key"),
                             F.transform("_all", lambda m: F.struct(m["start"], m["kind_no"], m["end"], m["entity"])).alias("found"), "pairs",
                             F.when(F.size("pairs") > 0, F.col("text")).alias("text")), "mentions")


def disclosing(found: DataFrame, docs: DataFrame, text_col: str = "text", min_texts: int = MIN_TEXTS, generalise_at: float = GENERALISE_AT) -> DataFrame:
    """(pair, disclosure) of entities and terms at or above the threshold, by document counts over the whole corpus."""
    total = float(found.count())
    pairs = (found.select("text_key", F.explode("pairs").alias("pair")).groupBy("pair", "text_key").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("pair").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= min_texts))
    entities = (found.select(F.explode(F.array_distinct(F.transform("found", lambda m: m["entity"]))).alias("entity"))
                .groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")))
    terms = (docs.select(F.explode(F.array_distinct(terms_of(F.coalesce(F.col(text_col), F.lit(""))))).alias("term"))
             .groupBy("term").agg(F.count(F.lit(1)).alias("n_term")))
    split = F.split("pair", "\t")
    both = pairs.withColumns({"entity": split[0], "term": split[1]}).join(entities, "entity").join(terms, "term").where(F.col("n_entity") < total)
    shared = F.log2(F.lit(total) * F.col("n_both") / (F.col("n_entity").cast("double") * F.col("n_term")))
    content = F.log2(F.lit(total) / F.col("n_entity"))
    return saved(both.select("pair", "term", (shared / content).alias("disclosure")).where(F.col("disclosure") >= generalise_at), "disclosing")


def _joined_spans(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_texts: int = MIN_TEXTS,
                    generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts and digest of the fixed kinds, all spans, and what to do with them.

    ``actions`` lists (start, kind_no, end, removed) in order.  Texts move only where a term
    discloses an entity of its own document.
    """
    found = mentions(docs, id_col, text_col)
    flagged = disclosing(found, docs, text_col, min_texts, generalise_at)
    listed = (found.select("row", F.explode("pairs").alias("pair")).join(flagged, "pair").groupBy("row", "term").agg(F.max("disclosure").alias("d"))
              .groupBy("row").agg(F.array_sort(F.collect_list("term")).alias("_terms"),
                                  F.array_sort(F.collect_list(F.when(F.col("d") >= remove_at, F.col("term")))).alias("_removed")))
    # Addresses are matched beside the terms, so a term is not found inside one.
    edge = r"[\p{L}\p{M}]"
    pattern = F.concat(F.lit(rf"{EMAIL}|(?iu:(?<!{edge})(?:"), F.array_join("_terms", "|"), F.lit(rf")(?!{edge}))"))
    hit = fixed(found.join(listed, "row").select("row", "text", "_terms", "_removed").withColumn("_pattern", pattern), _at=_pieces(F.col("text"), F.col("_pattern")))
    spans = F.filter(F.transform(F.col("_at.hits"), lambda h, k: F.struct(
        F.get(F.col("_at.starts"), k).alias("start"), F.lit(len(KINDS)).alias("kind_no"), (F.get(F.col("_at.starts"), k) + F.length(h)).alias("end"),
        F.array_contains("_removed", F.lower(h)).alias("removed"), h.contains("@").alias("skip"))), lambda s: ~s["skip"])
    more = hit.select("row", F.transform(spans, lambda s: F.struct(s["start"], s["kind_no"], s["end"], s["removed"])).alias("_more"))
    base = F.transform("found", lambda m: F.struct(m["start"], m["kind_no"], m["end"], F.lit(False).alias("removed")))
    none = F.expr("cast(array() as array<struct<start:int,kind_no:int,end:int,removed:boolean>>)")
    out = fixed(found.drop("text", "pairs").join(more, "row", "left"), actions=F.array_sort(F.concat(base, F.coalesce("_more", none))))

    def count(no: int) -> Column:
        return F.size(F.filter("found", lambda m: m["kind_no"] == no)).cast("long").alias(f"n_{KINDS[no]}")
    return out.select("row", "doc_id", *map(count, range(len(KINDS))), F.sha2(_joined_spans(F.col("found")), 256).alias("base_sha256"),
                      _joined_spans(F.col("actions")).alias("spans"), "actions")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """(doc_id, clean_text): entities and generalised terms as ``<KIND>``, removed terms gone, one row per row."""
    # The row numbers that ``mentions`` gives depend on the scan, so the texts travel inside the id.
    carried = docs.withColumn("_whole", F.struct(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    acted = sanitised_spans(carried, "_whole", text_col, **limits).select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.text").alias("text"), "actions")
    # Of spans that overlap, the first stays; the others are cut to what is left of them.
    ends = F.aggregate("actions", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<a:int,b:int,s:string>>)").alias("out")),
                       lambda z, s: F.struct(F.greatest(z["at"], s["end"]).alias("at"), F.concat(z["out"], F.array(F.struct(
                           z["at"].alias("a"), F.greatest(z["at"], s["start"]).alias("b"),
                           F.when(s["end"] <= z["at"], "").when(s["removed"], "").otherwise(F.concat(F.lit("<"), F.upper(F.get(F.array(*[F.lit(k) for k in (*KINDS, TERM)]), s["kind_no"])), F.lit(">"))).alias("s")))).alias("out")))
    cut = fixed(acted, _z=ends)
    body = F.transform("_z.out", lambda p: F.concat(F.substr(F.col("text"), p["a"] + 1, p["b"] - p["a"]), p["s"]))
    return cut.select("doc_id", F.concat(F.array_join(body, ""), F.substr(F.col("text"), F.col("_z.at") + 1, F.length("text"))).alias("clean_text"))
