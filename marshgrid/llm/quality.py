"""Quality rules by distribution divergence, on DataFrame functions only.

Fixed rules count words, symbols, repeated lines and repeated windows.  Documents that
pass are compared with references learned from the whole corpus: per language the
distribution over character classes and over the language's most common words.  The
Jensen-Shannon distance to the nearest language decides.

Defined results: a null or blank text has no words, fails the base rules and is not kept;
a null language only keeps a document out of the references; a document of a language that
has too few labelled words for a reference is judged by the base rules alone; repeated rows
are judged one by one; without any labelled text there is no reference and the base rules decide alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marshgrid.llm.common import fixed, let, saved, words_of

#: Lower-case and caseless letters, capitals, digits, white space, prose punctuation, the rest.
CLASSES = ("letter", "capital", "digit", "space", "punct", "other")
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Common words of each language reference.
COMMON_WORDS = 24
#: A language gets a reference from so many labelled words on, in a small table from this share of the labelled documents on.
MIN_LABELLED_WORDS, MIN_SHARE = 1000, 0.01
#: More references than this are kept in a one-row table, not in the expression.
CONSTANT_REFERENCES = 100
#: Largest Jensen-Shannon distance (base 2, 0..1) of a kept document.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.45
#: A histogram of fewer characters or words says too little; the distance is not used.
MIN_CHARS, MIN_WORDS_FOR_COMMON = 300, 60


def _length_of(kept: str, text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kept}]+", ""))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep=()) -> DataFrame:
    """Base counts of each row: words, symbols, repeats and characters by class."""
    base = docs.select(F.col(id_col), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    base = fixed(base, _rest=F.regexp_replace("_text", r"[\p{L}&&[^\p{Lu}]]+", ""), _words=words_of(F.col("_text")),
                 _lines=F.filter(F.split("_text", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))))
    counted = fixed(
        base, n_words=F.size("_words").cast("long"),
        _chars=F.length("_text").cast("long"), _capital=_length_of(r"\p{Lu}", F.col("_rest")).cast("long"),
        _digit=_length_of(r"\p{N}", F.col("_rest")).cast("long"), _space=_length_of(r"\x20\x09-\x0D", F.col("_rest")).cast("long"),
        _punct=_length_of(r".,;:?'\"()-", F.col("_rest")).cast("long"),
        n_symbols=_length_of(r"#*$%&|<>", F.col("_rest")).cast("long"), _rest_chars=F.length("_rest").cast("long"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        n_repeat_words=repeated_words(F.col("_words")))
    letter = F.col("_chars") - F.col("_rest_chars")
    other = F.col("_rest_chars") - F.col("_capital") - F.col("_digit") - F.col("_space") - F.col("_punct")
    return counted.select(
        id_col, *keep, "n_words", (F.col("_chars") - F.col("_space")).alias("word_chars"), "n_symbols", "n_dup_lines",
        "n_repeat_words", F.array(letter, "_capital", "_digit", "_space", "_punct", other).alias("class_counts"), "_words")


def repeated_words(words: Column) -> Column:
    """Words that lie in a five-word window found at least twice in the array."""
    def covered(hashes):
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def spread(p):
            twice = F.filter(p, lambda x, k: F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False))
                             | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)))
            at = F.sort_array(F.transform(twice, lambda x: x["i"]))
            # Overlapping windows count their common words once.
            return F.aggregate(at, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
                               lambda a, x: F.struct((x + WINDOW).alias("end"),
                                                     (a["n"] + WINDOW - F.greatest(a["end"] - x, F.lit(0))).alias("n")))["n"]
        # Sorting is only for texts that do repeat a window.
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(placed, spread))

    def judge(w):
        return let(F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])), covered)
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(words, judge))


def _held_common(words: Column, listed: list[str]) -> Column:
    """(word, n) of the listed words in the array, in word order."""
    def runs(c):
        def count(d):
            nth = lambda i: F.array_position(c, F.get(d, i))
            return F.transform(d, lambda w, i: F.struct(
                w.alias("word"), (F.coalesce(nth(i + 1), F.size(c) + F.lit(1).cast("long")) - nth(i)).alias("n")))
        return let(F.array_distinct(c), count)
    return let(F.sort_array(F.filter(words, lambda w: w.isin(listed))), runs)


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = COMMON_WORDS,
                 min_share: float = MIN_SHARE, min_words: int = MIN_LABELLED_WORDS) -> list[tuple[str, str, int]]:
    """(lang, word, n) of the most common words of each language, counted over all rows.

    ``per_lang`` words of each language with enough labelled text come to the driver.
    """
    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = saved(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(words_of(F.col("text")))).alias("words")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    langs = [r[0] for r in sizes.where((F.col("n") >= min_share * total) | (F.col("words") >= min_words)).collect()]
    tally = (labelled.where(F.col("lang").isin(langs)).select("lang", F.explode(words_of(F.col("text"))).alias("word"))
             .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    top = tally.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
    return sorted(tuple(r) for r in top.where(F.col("rank") <= per_lang).select("lang", "word", "n").collect())


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance in base 2 of two arrays of shares."""
    def part(a, b):
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    total = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Measures, distances to the nearest language reference and the verdict for every row.

    Two passes over the texts: one counts each language's words (with map-side combine),
    one measures every document and lists its common words.  What is left is a narrow
    table.  The references, 6 + 24 shares a language, enter the last step as a constant, or
    as a broadcast row where they are many.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    top = common_words(docs)
    listed = sorted({w for _, w, _ in top})
    measured = measures(docs, keep=["lang"])
    held = _held_common(F.col("_words"), listed) if listed else F.expr("cast(array() as array<struct<word:string,n:bigint>>)")
    table = saved(measured.withColumn("common", held).drop("_words"), "measures")

    langs = sorted({lang for lang, _, _ in top})
    sums = (table.where(F.col("lang").isin(langs)).groupBy("lang")
            .agg(F.sum("n_words").alias("words"), *[F.sum(F.col("class_counts")[i]).alias(c) for i, c in enumerate(CLASSES)]).collect())
    refs = []
    for r in sorted(sums):
        chars = sum(r[c] for c in CLASSES)
        own = [(w, n / r["words"]) for lang, w, n in top if lang == r["lang"]]
        refs.append((r["lang"], [r[c] / chars for c in CLASSES], [w for w, _ in own], [*(s for _, s in own), max(0.0, 1 - sum(s for _, s in own))]))

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = table.withColumn("base_failed", failed)
    if refs:
        if len(refs) <= CONSTANT_REFERENCES:
            known = F.array(*[F.struct(F.lit(lang).alias("lang"), *[F.array(*[F.lit(x) for x in part]).alias(name)
                                                                    for name, part in (("classes", cls), ("words", own), ("shares", shares))])
                              for lang, cls, own, shares in refs])
        else:
            one = docs.sparkSession.createDataFrame([(refs,)], "_refs array<struct<lang:string,classes:array<double>,words:array<string>,shares:array<double>>>")
            out, known = out.crossJoin(F.broadcast(one)), F.col("_refs")
        chars = F.aggregate("class_counts", F.lit(0).cast("long"), lambda s, x: s + x)
        classes = F.transform("class_counts", lambda x: x / chars)
        words, counts = F.col("common.word"), F.col("common.n")

        def share(r):
            own = F.transform(r["words"], lambda w: F.coalesce(F.get(counts, (F.array_position(words, w) - 1).cast("int")), F.lit(0)) / F.col("n_words"))
            return F.concat(own, F.array(1 - F.aggregate(own, F.lit(0.0), lambda s, x: s + x)))

        def against(r):
            return F.struct(divergence(classes, r["classes"]).alias("class_distance"),
                            divergence(share(r), r["shares"]).alias("word_distance"), r["lang"].alias("lang"))
        near = F.array_min(F.transform(F.transform(known, against), lambda x: F.struct(
            (x["class_distance"] + x["word_distance"]).alias("both"), x["class_distance"], x["word_distance"], x["lang"].alias("nearest"))))
        out = fixed(out, _near=F.when(F.col("n_words") > 0, near), _chars=chars)
        out = out.select("*", F.col("_near.nearest"), F.col("_near.class_distance"), F.col("_near.word_distance"))
    else:
        out = out.select("*", F.lit(0).cast("long").alias("_chars"), F.lit(None).cast("string").alias("nearest"),
                         F.lit(None).cast("double").alias("class_distance"), F.lit(None).cast("double").alias("word_distance"))
    far = ((F.col("_chars") >= MIN_CHARS) & (F.col("class_distance") > max_class)) | \
          ((F.col("n_words") >= MIN_WORDS_FOR_COMMON) & (F.col("word_distance") > max_word))
    # What another language's reference says about a language without one is nothing.
    far = far & (F.col("lang").isNull() | F.col("lang").isin([r[0] for r in refs]))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"), "nearest", "class_distance", "word_distance")
