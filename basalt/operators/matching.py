"""Matches between predicted and true boxes, one to one and best first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .geometry import by_image, demo_boxes, iou


def candidates(predicted: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs (image, p, t, iou) of overlapping boxes: an equality join by image whose ranges are filtered before the ratio."""
    p, t = predicted.alias("p"), truth.alias("t")
    touch = (F.col("p.x1") < F.col("t.x2")) & (F.col("t.x1") < F.col("p.x2")) & (F.col("p.y1") < F.col("t.y2")) & (F.col("t.y1") < F.col("p.y2"))
    pairs = p.join(t, (F.col("p.image") == F.col("t.image")) & touch).select(F.col("p.image").alias("image"), F.col("p.id").alias("p"), F.col("t.id").alias("t"), iou("p.", "t.").alias("iou"))
    return pairs.where(F.col("iou") >= threshold)


def best_pairs(pairs: list[tuple]) -> list[tuple]:
    """Of (p, t, iou) of one image the best pair first, ties by the larger ids; every box at most once."""
    seen_p, seen_t, out = set(), set(), []
    for p, t, share in sorted(pairs, key=lambda x: (x[2], x[0].id, x[1].id), reverse=True):
        if p.id not in seen_p and t.id not in seen_t:
            seen_p.add(p.id)
            seen_t.add(t.id)
            out.append((p, t, share))
    return out


def greedy(pairs: DataFrame) -> DataFrame:
    """The best pair first, ties by the larger ids; every box at most once."""

    def run(rows: list) -> list:
        seen_p, seen_t, out = set(), set(), []
        for r in sorted(rows, key=lambda r: (r.iou, r.p, r.t), reverse=True):
            if r.p not in seen_p and r.t not in seen_t:
                seen_p.add(r.p)
                seen_t.add(r.t)
                out.append(r)
        return out

    return by_image(pairs.select("image", "p", "t", "iou"), run, "image long, p int, t int, iou double")


def match(predicted: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    return greedy(candidates(predicted, truth, threshold))


def counts(predicted: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A1 by image: true and false positives, false negatives and the scores; images without a prediction count."""
    found = match(predicted, truth, threshold).groupBy("image").agg(F.count(F.lit(1)).alias("tp"))
    both = predicted.groupBy("image").agg(F.count(F.lit(1)).alias("n_p")).join(truth.groupBy("image").agg(F.count(F.lit(1)).alias("n_t")), "image", "full").join(found, "image", "left").na.fill(0)
    out = both.select("image", "tp", (F.col("n_p") - F.col("tp")).alias("fp"), (F.col("n_t") - F.col("tp")).alias("fn"))
    return scored(out)


def scored(c: DataFrame) -> DataFrame:
    """A1: precision, recall, F2 and accuracy, 0 where a denominator is 0."""
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    c = c.withColumn("precision", safe(tp, tp + fp)).withColumn("recall", safe(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return c.withColumn("f2", safe(5 * p * r, 4 * p + r)).withColumn("accuracy", safe(tp, tp + fp + fn))


def _pair(spark, d):
    truth = demo_boxes(spark, d)
    moved = truth.where("id % 4 <> 0").withColumn("x1", F.col("x1") + F.col("id") * 2).withColumn("x2", F.col("x2") + F.col("id") * 2)
    return moved, truth


QUERIES = {
    "j6_greedy_box_match": lambda spark, d: match(*_pair(spark, d)).withColumn("iou", F.round("iou", 6)),
    "a1_detection_scores": lambda spark, d: counts(*_pair(spark, d)),
}

ORACLES: dict[str, str] = {}
