"""Pixel classification: train on band columns, predict, score, compare arms.

Tiles decide which pixels are seen and how often, but pixels are never copied per
tile: a pixel carries the number of split tiles covering it as a weight, which gives
the same loss and the same confusion counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marshgrid import contract as C
from marshgrid.operators import annotate as A
from marshgrid.operators import metrics as M
from marshgrid.operators import split as Sp
from marshgrid.operators import tiles as T
from marshgrid.operators.scale import with_scalar
from marshgrid.session import materialise


@dataclass(frozen=True)
class PixelModel:
    """A fitted classifier with everything needed to check its use."""

    pipeline: PipelineModel
    bands: list[str]
    band_statistics: DataFrame
    class_weights: DataFrame
    provenance: DataFrame


def train_pixel_classifier(px: DataFrame, tiles: DataFrame, seen: DataFrame, bands: list[str], by: list[str],
                           size: int, stride: int, scheme: str = "inverse_frequency", sample_limit: int | None = None,
                           max_iter: int = 50) -> PixelModel:
    """Fit a four-class model on the train split only.

    ``tiles`` is (by..., top, left, key, split) and ``seen`` its :func:`~marshgrid.operators.tiles.split_pixels`, with
    ``bands`` or more; both are written or checkpointed beforehand so that every step reads one split and no step
    reads the pixels again.  Statistics and class weights come from train tiles alone; only ``sample_limit``, which
    takes the statistics from some of them, needs ``px``, the pixels with bands and usable.
    The optimiser starts from zero and sums gradients over all executors, so a run
    needs no seed beyond the split's.
    """
    train, inside = tiles.where(F.col("split") == "train"), seen.where(F.col("split") == "train")
    # A handful of rows each, kept with the model: computed once, not per use.
    stats = materialise(T.statistics_of_distinct(inside, train, bands) if sample_limit is None else
                        T.band_statistics(px, train, bands, by, size, stride, sample_limit))
    counts = inside.agg(*[F.sum(F.when(F.col("trainable") & (F.col("label") == c), F.col("n"))).alias(f"mask_{c}_px")
                          for c in range(len(C.CLASS_NAMES))])
    weights = materialise(T.class_weights(T.class_balance(counts), scheme))
    # Equal pixels have equal loss: each combination of bands and label is fitted once, with their number.  The
    # optimiser reads its input several times, so it is kept.
    seen = materialise(inside.where("trainable").groupBy("label", *bands).agg(F.sum("n").alias("n")))
    # A missing band counts as zero, as it does in prediction.
    filled = seen.withColumns({b: F.coalesce(b, F.lit(0.0)) for b in bands})
    scaled = T.standardise_bands(filled, stats, bands)
    # Four rows of weights.
    rows = scaled.join(F.broadcast(weights.withColumnRenamed("class_code", "label")), "label") \
                 .select(F.col("label").cast("double").alias("label"), (F.col("n") * F.col("weight")).alias("w"),
                         *bands)
    pipe = [VectorAssembler(inputCols=bands, outputCol="features"),
            LogisticRegression(family="multinomial", weightCol="w", maxIter=max_iter, regParam=1e-4)]
    assembled = pipe[0].transform(rows).select("features", "label", "w")
    model = PipelineModel(stages=[pipe[0], pipe[1].fit(assembled)])
    return PixelModel(model, list(bands), stats, weights, provenance(tiles))


def provenance(tiles: DataFrame) -> DataFrame:
    """Which tile went where, to be kept with the model."""
    return tiles.select("key", F.coalesce("split", F.lit("boundary")).alias("split"))


def predict_pixels(model: PixelModel, px: DataFrame, bands: list[str]) -> DataFrame:
    """Most likely class per pixel; the band order must be the training order."""
    if len(bands) != len(model.bands):
        raise ValueError(f"the model takes {len(model.bands)} bands, {len(bands)} were given")
    if list(bands) != model.bands:
        raise ValueError(f"the model was trained on {model.bands}, not {list(bands)}")
    filled = px.select(*[c for c in px.columns if c not in bands],
                       *[F.coalesce(b, F.lit(0.0)).alias(b) for b in bands])
    scaled = T.standardise_bands(filled, model.band_statistics, bands)
    return scaled.withColumn("prediction", most_likely(model)).select(
        *[c for c in filled.columns if c not in bands], *bands, "prediction")


def most_likely(model: PixelModel) -> Column:
    """Class of the greatest linear score, the first of equal ones, as the fitted model's ``transform`` finds it.

    Written as columns: the model's own functions build and take apart a vector object for every pixel.
    A band that is no number is an error, as it is in training.
    """
    lr = model.pipeline.stages[-1]
    checked = {b: F.when(F.isnan(b), F.raise_error(F.lit(f"{b} is not a number")).cast("double")).otherwise(F.col(b))
               for b in model.bands}
    scores = F.array(*[sum((checked[b] * float(w) for b, w in zip(model.bands, weights)), F.lit(float(start)))
                       for weights, start in zip(lr.coefficientMatrix.toArray(), lr.interceptVector.toArray())])
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def evaluate(model: PixelModel, seen: DataFrame, split: str) -> DataFrame:
    """Per-class scores on one split, each pixel counted once per covering tile.

    ``seen`` holds the split's :func:`~marshgrid.operators.tiles.split_pixels`: equal pixels get equal predictions,
    so each combination of bands and label is predicted once.
    """
    part = seen.where((F.col("split") == split) & F.col("trainable")).groupBy(
        F.col("label").alias("target"), *model.bands).agg(F.sum("n").alias("n"))
    pred = predict_pixels(model, part, model.bands)
    return M.class_scores(M.confusion(pred, weight="n"))


def compare_arms(multispectral: DataFrame, rgb: DataFrame) -> DataFrame:
    """Gain of the first report over the second; relative only above a meaningful baseline."""
    a = multispectral.select(F.col("mean_iou").alias("mean_iou_8"), F.col("reed_iou").alias("reed_iou_8"))
    b = rgb.select(F.col("mean_iou").alias("mean_iou_rgb"), F.col("reed_iou").alias("reed_iou_rgb"))
    both = with_scalar(a, b)
    gain = F.col("mean_iou_8") - F.col("mean_iou_rgb")
    return both.withColumn("absolute_gain", F.round(gain, 4)).withColumn(
        "relative_gain_pct", F.when(F.col("mean_iou_rgb") >= C.MIN_BASELINE_IOU,
                                    F.round(100 * gain / F.col("mean_iou_rgb"), 1)))


def run_metrics(model: PixelModel, tiles: DataFrame, report: DataFrame, reserved: int = 0) -> DataFrame:
    """One summary row of a training run; weak-label scores carry no verdict."""
    counts = tiles.agg(*[F.count_if(F.col("split") == s).alias(f"{s}_tiles") for s in Sp.SPLITS],
                       F.count_if(F.col("split").isNull()).alias("boundary_tiles_omitted"))
    weights = model.class_weights.agg(F.transform(
        F.array_sort(F.collect_list(F.struct("class_code", F.round("weight", 4).alias("w")))), lambda s: s["w"])
        .alias("class_weights"))
    stats = model.band_statistics.agg(F.to_json(F.array_sort(F.collect_list(
        F.struct("position", "band", "mean", "std")))).alias("band_statistics"))
    verdict = M.target_verdict(report, False, "scored against the rules that made the training labels")
    out = with_scalar(with_scalar(with_scalar(counts, weights), stats), verdict)
    return out.withColumns({"bands": F.array(*[F.lit(b) for b in model.bands]), "tiles_reserved": F.lit(reserved)})


def score_pack(predictions: DataFrame, labels: DataFrame, pack_tiles: DataFrame, provenance: DataFrame) -> dict:
    """Score predicted chip pixels against human labels.

    ``predictions`` and ``labels`` share (key, row, col).  Refuses ground the model was
    trained on, and a pack nobody has annotated; both checks read one row.
    """
    independence = A.check_independence(pack_tiles, provenance)
    status = independence.first()
    if status["status"] == "trained_on":
        raise ValueError(f"refusing to score: {status['detail']}")
    # Every score is a sum over these counts, a few rows a tile: the pixels are joined once.
    scored = materialise(A.join_predictions(predictions, labels, ["key"]).groupBy("key", "target", "prediction")
                         .agg(F.count(F.lit(1)).alias("n")))
    if scored.isEmpty():
        raise ValueError("nothing in the pack has been annotated yet")
    scores = M.class_scores(M.confusion(scored, weight="n"))
    report = M.segmentation_report(scores)
    assessment = M.assess(scores, independence)
    judged = with_scalar(report, assessment.select(F.col("assessable").alias("_ok"), F.col("verdict").alias("_why")))
    verdict = M.target_verdict(judged, F.col("_ok"), F.col("_why")).drop("_ok", "_why")
    return {"scores": scores, "report": verdict, "assessment": assessment,
            "per_tile": M.tile_agreement(scored, ["key"], "n"),
            "unlabelled": A.still_unlabelled(pack_tiles, labels, ["key"])}
