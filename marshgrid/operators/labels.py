"""Rule-based weak labels on a pixel table that carries the four indices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marshgrid import contract as C
from marshgrid.functions import pixels as P

NEEDED = ["ndvi", "ndwi", "ndre", "ndmi"]


def apply_priors(px: DataFrame, priors: DataFrame, by: list[str]) -> DataFrame:
    """Attach per-class bonuses from an external land-cover vote as ``prior_0..3``.

    ``priors`` is (by..., row, col, class_code, bonus).  Votes are pre-aggregated per
    pixel, so the join is one row to one row.
    """
    keys = [*by, "row", "col"]
    wide = priors.groupBy(*keys).agg(*[
        F.sum(F.when(F.col("class_code") == c, F.col("bonus"))).alias(f"prior_{c}")
        for c in range(len(C.CLASS_NAMES))])
    return px.join(wide, keys, "left")


def weak_label(px: DataFrame, drop_ambiguous: bool = True) -> DataFrame:
    """Label, confidence, margin and the three masks of every pixel.

    Uses ``valid`` when the table carries it, and ``prior_0..3`` when present.
    """
    missing = [n for n in NEEDED if n not in px.columns]
    if missing:
        raise ValueError(f"weak_label needs the indices {NEEDED}; missing {missing}")
    ndvi, ndwi, ndre, ndmi = (F.col(n) for n in NEEDED)
    scores = [P.water_score(ndvi, ndwi, ndre), P.crops_score(ndvi, ndwi, ndre),
              P.halophyte_score(ndvi, ndwi, ndre), P.reed_score(ndvi, ndwi, ndre, ndmi)]
    for c in range(len(scores)):
        if f"prior_{c}" in px.columns:
            bonus = F.coalesce(F.col(f"prior_{c}"), F.lit(0.0))
            scores[c] = P.clip(scores[c] + bonus)
    keep = [c for c in px.columns if not c.startswith("prior_") and c != "usable"]
    # A score is NULL exactly when an index is.
    usable = P.known(ndvi, ndwi, ndre, ndmi)
    if "valid" in px.columns:
        usable = F.coalesce(F.col("valid"), F.lit(False)) & usable
    # ``inline`` turns the scores into generated columns.  Later filters on a label then
    # stop here instead of being rewritten in terms of the bands, where the rule engine
    # would be spelled out once per comparison.
    named = px.select(*keep, F.inline(F.array(F.struct(
        usable.alias("usable"), *[s.alias(f"_s{i}") for i, s in enumerate(scores)]))))
    s = [F.col(f"_s{i}") for i in range(4)]
    ranked = named.select(*keep, "usable", *s, F.greatest(*s).alias("_top"),
                          F.greatest(F.least(s[0], s[1]), F.least(s[2], s[3]),
                                     F.least(F.greatest(s[0], s[1]), F.greatest(s[2], s[3]))).alias("_second"))
    top, second = F.col("_top"), F.col("_second")
    winner = F.when(s[0] == top, 0).when(s[1] == top, 1).when(s[2] == top, 2).otherwise(3)
    agree = sum(((x >= top - P.AGREEMENT_BAND).cast("int") for x in s[1:]),
                (s[0] >= top - P.AGREEMENT_BAND).cast("int"))
    step = ranked.select(*keep, "usable", *s, winner.alias("_winner"), top,
                         (top - second).alias("margin"), agree.alias("agree"))
    confident = (top >= P.REVIEW_CONFIDENCE) & (F.col("margin") >= P.TRAIN_MARGIN) \
        & (F.col("agree") <= P.MAX_AGREEING)
    ambiguous = (F.col("margin") < P.TRAIN_MARGIN) | (F.col("agree") > P.MAX_AGREEING)
    u = F.col("usable")
    return step.select(
        *keep, u, F.when(u, F.col("_winner")).otherwise(C.IGNORE).cast("int").alias("label"),
        F.when(u, top).alias("confidence"), F.when(u, F.col("margin")).alias("margin"),
        F.when(u, ambiguous).alias("ambiguous"),
        (u & (~confident | (F.col("_winner") == C.HALOPHYTE))).alias("review"),
        (u & ~ambiguous if drop_ambiguous else u).alias("trainable"),
        F.when(u, F.array(*s)).alias("scores"))


def label_statistics(labelled: DataFrame, by: list[str]) -> DataFrame:
    """Usable, trainable, dropped and review pixels plus class counts, one row per composite."""
    n = len(C.CLASS_NAMES)
    counts = labelled.groupBy(*by).agg(
        F.count_if("usable").alias("usable_px"), F.count_if("trainable").alias("trainable_px"),
        F.count_if("review").alias("review_px"), F.avg(F.when(F.col("usable"), F.col("confidence"))).alias("_conf"),
        *[F.count_if(F.col("usable") & (F.col("label") == c)).alias(f"class_{c}_px") for c in range(n)])
    some = F.col("usable_px") > 0
    dropped = F.col("usable_px") - F.col("trainable_px")
    # The empty case reports only its zeros; everything else stays NULL.
    ratio = lambda x: F.when(some, F.round(x / F.col("usable_px"), 5))
    return counts.select(
        *by, "usable_px", F.when(some, F.col("trainable_px")).alias("trainable_px"),
        F.when(some, dropped).alias("dropped_px"), ratio(dropped).alias("dropped_fraction"), "review_px",
        F.coalesce(ratio(F.col("review_px")), F.lit(0.0)).alias("review_fraction"),
        F.when(some, F.round("_conf", 4)).alias("mean_confidence"),
        *[F.col(f"class_{c}_px") for c in range(n)],
        *[ratio(F.col(f"class_{c}_px")).alias(f"class_{c}_fraction") for c in range(n)])
