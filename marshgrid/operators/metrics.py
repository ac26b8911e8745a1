"""Confusion counts, segmentation scores, target verdicts and assessments.

Everything after :func:`confusion` works on at most 16 rows per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marshgrid import contract as C
from marshgrid.operators.scale import rank_within, with_scalar

K = len(C.CLASS_NAMES)


def confusion(df: DataFrame, by: list[str] | None = None, ignore: int = C.IGNORE,
              weight: str | None = None) -> DataFrame:
    """Counts per (target, prediction); ignored and out-of-range codes are left out.

    ``weight`` counts a row several times (a pixel once per tile that covers it).
    """
    t, p = F.col("target"), F.col("prediction")
    ok = (t != ignore) & t.between(0, K - 1) & p.between(0, K - 1)
    return df.where(ok).groupBy(*(by or []), "target", "prediction").agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))


def merge_confusions(*parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Add confusion tables of separate batches."""
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total.groupBy(*(by or []), "target", "prediction").agg(F.sum("n").alias("n"))


def class_scores(conf: DataFrame, by: list[str] | None = None) -> DataFrame:
    """IoU, F1, support and predicted pixels per class; NULL where a class is absent."""
    by = by or []
    def tot(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    parts = []
    for c in range(K):
        t, p = F.col("target") == c, F.col("prediction") == c
        parts += [tot(t & p).alias(f"d{c}"), tot(t).alias(f"t{c}"), tot(p).alias(f"p{c}")]
    wide = conf.groupBy(*by).agg(*parts)
    rows = F.array(*[F.struct(F.lit(c).alias("class_code"), F.lit(C.CLASS_NAMES[c]).alias("class_name"),
                              F.col(f"d{c}").alias("hits"), F.col(f"t{c}").alias("support_px"),
                              F.col(f"p{c}").alias("predicted_px")) for c in range(K)])
    both = F.col("support_px") + F.col("predicted_px")
    return wide.select(*by, F.inline(rows)).select(
        *by, "class_code", "class_name", "support_px", "predicted_px", "hits",
        F.when(both > 0, F.col("hits") / (both - F.col("hits"))).alias("iou"),
        F.when(both > 0, 2 * F.col("hits") / both).alias("f1"))


def segmentation_report(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per group: mean IoU, accuracy, reed IoU and F1, and the per-class list."""
    by = by or []
    reed = F.col("class_code") == C.REED
    rows = F.array_sort(F.collect_list(F.struct(
        "class_code", "class_name", F.round("iou", 4).alias("iou"), F.round("f1", 4).alias("f1"), "support_px")))
    total = F.sum("support_px")
    return scores.groupBy(*by).agg(
        F.round(F.avg("iou"), 4).alias("mean_iou"),
        F.round(F.sum("hits") / F.nullif(total, F.lit(0)), 4).alias("pixel_accuracy"),
        F.round(F.max(F.when(reed, F.col("iou"))), 4).alias("reed_iou"),
        F.round(F.max(F.when(reed, F.col("f1"))), 4).alias("reed_f1"),
        total.alias("support_px"), rows.alias("per_class"))


def target_verdict(report: DataFrame, assessable: Column | bool = True, reason: Column | str | None = None,
                   iou: float = C.TARGET_IOU, f1: float = C.TARGET_F1) -> DataFrame:
    """Whether the reed targets are met; all flags NULL when the score is not assessable."""
    ok = F.lit(assessable) if isinstance(assessable, bool) else assessable
    iou_ok = F.coalesce(F.col("reed_iou") >= iou, F.lit(False))
    f1_ok = F.coalesce(F.col("reed_f1") >= f1, F.lit(False))
    why = F.lit(reason) if reason is None or isinstance(reason, str) else reason
    return report.select(
        "*", ok.alias("assessable"), F.lit(iou).alias("target_iou"), F.lit(f1).alias("target_f1"),
        F.when(ok, iou_ok).alias("iou_met"), F.when(ok, f1_ok).alias("f1_met"),
        F.when(ok, iou_ok & f1_ok).alias("both_met"), F.when(~ok, why.cast("string")).alias("reason"))


def tile_agreement(scored: DataFrame, tile: list[str], weight: str | None = None) -> DataFrame:
    """Labelled pixels and share predicted like the label, per annotated tile; ``weight`` counts a row several times."""
    n = F.lit(1) if weight is None else F.col(weight)
    same = F.col("prediction") == F.col("target")
    # A pixel without a prediction is labelled, and no part of the share.
    hits, judged = F.sum(F.when(same, n).when(~same, 0)), F.sum(F.when(same.isNotNull(), n))
    return scored.where(F.col("target").between(0, K - 1)).groupBy(*tile).agg(
        F.sum(n).alias("labelled_px"), F.round(hits / judged, 4).alias("agreement"))


def reed_overlap(scored: DataFrame, tile: list[str]) -> DataFrame:
    """Reed intersection, union, support and IoU per tile over supervised pixels."""
    seen = F.col("target") >= 0
    p, t = seen & (F.col("prediction") == C.REED), seen & (F.col("target") == C.REED)
    counts = scored.groupBy(*tile).agg(F.count_if(p & t).alias("inter"), F.count_if(p | t).alias("union_px"),
                                       F.count_if(t).alias("support"))
    return counts.withColumn("iou", F.when(F.col("union_px") > 0, F.col("inter") / F.col("union_px")))


def pooled_reed_iou(overlap: DataFrame) -> DataFrame:
    """Summed intersection over summed union."""
    return overlap.agg(F.sum("inter").alias("inter"), F.sum("union_px").alias("union_px"),
                       F.sum("support").alias("support"), F.count("iou").alias("tiles_with_reed")) \
                  .withColumn("pooled_iou", F.when(F.col("union_px") > 0, F.col("inter") / F.col("union_px")))


def representative_tile(tiles: DataFrame, key: list[str], min_water: float = 0.02, min_reed: float = 0.05,
                        max_reed: float = 0.60) -> DataFrame:
    """The median-agreeing tile showing both water and a reed stand.

    ``tiles`` carries ``iou``, ``fraction_0`` and ``fraction_3``.
    """
    fit = tiles.where(F.col("iou").isNotNull() & (F.col("fraction_0") >= min_water)
                      & F.col(f"fraction_{C.REED}").between(min_reed, max_reed))
    ranked = rank_within(fit, [], [F.col("iou").asc(), *[F.col(k).asc() for k in key]], "_rn")
    sized = with_scalar(ranked, ranked.agg(F.count(F.lit(1)).alias("_n")))
    return sized.where(F.col("_rn") == F.floor(F.col("_n") / 2) + 1).drop("_rn", "_n")


def assess(scores: DataFrame, independence: DataFrame) -> DataFrame:
    """Whether a score is a validation at all, and every reason it is not.

    ``scores`` is one run's :func:`class_scores`; ``independence`` is one row with
    ``status`` and ``detail``.
    """
    present, reed = F.col("support_px") > 0, F.col("class_code") == C.REED
    names = lambda cond: F.transform(F.array_sort(F.collect_list(
        F.when(cond, F.struct("class_code", "class_name")))), lambda s: s["class_name"])
    one = scores.agg(
        names(present).alias("classes_present"), names(~present).alias("classes_absent"),
        F.coalesce(F.sum(F.when(reed, F.col("support_px"))), F.lit(0)).alias("reed_support_px"),
        F.array_sort(F.collect_list(F.when(F.col("predicted_px") > 0, F.col("class_code")))).alias("predicted_classes"))
    one = with_scalar(one, independence.select("status", "detail"))
    n = F.size("classes_present")
    reasons = F.array(
        F.when(F.col("status") != "verified", F.col("detail")),
        F.when(n < 2, F.format_string("annotations cover %d class(es), so a constant prediction would look perfect", n)),
        F.when(F.col("reed_support_px") < C.MIN_REED_PIXELS,
               F.format_string("%d annotated reed pixels are fewer than the %d a reed IoU needs",
                               F.col("reed_support_px"), F.lit(C.MIN_REED_PIXELS))),
        F.when((F.size("predicted_classes") < 2) & (n >= 2), F.lit("the model predicted a single class everywhere")))
    out = one.withColumn("blocking_reasons", F.filter(reasons, lambda x: x.isNotNull()))
    ok = F.size("blocking_reasons") == 0
    verdict = F.when(ok, F.format_string("independent check over %d classes and %d reed pixels",
                                         n, F.col("reed_support_px"))) \
               .otherwise(F.concat(F.lit("not a validation: "), F.array_join("blocking_reasons", "; ")))
    return out.select(ok.alias("assessable"), verdict.alias("verdict"), "blocking_reasons", "classes_present",
                      "classes_absent", "reed_support_px", "predicted_classes", "status")


def classes_with_support(scores: DataFrame, present: bool = True) -> DataFrame:
    """Classes that have (or lack) labelled pixels."""
    have = F.col("support_px") > 0
    return scores.where(have if present else ~have).select("class_code", "class_name")
