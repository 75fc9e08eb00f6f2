"""Approaches as plug-ins: functions over DataFrames, found by name, put together from a detector and identifiers.

A model is a column of its answers or a pandas UDF that the caller brings; nothing here calls one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]

STEP = "struct<stage:string,rows:bigint,note:string>"


@dataclass(frozen=True)
class Approach:
    """Detect: images (image, ...) to boxes; identify: boxes to boxes with product (nullable) and confidence; setup: what the gallery gives, once a run."""

    name: str
    detect: Stage
    identify: Stage
    tasks: tuple[str, ...] = ("detect_and_identify",)
    setup: Callable[[DataFrame], object] | None = None
    defaults: dict = field(default_factory=dict)

    def run(self, images: DataFrame) -> DataFrame:
        """Boxes with products of all images; an image without boxes has no row."""
        return self.identify(self.detect(images))


_KNOWN: dict[str, Approach] = {}


def register(approach: Approach) -> Approach:
    """A name can be taken once."""
    if approach.name in _KNOWN:
        raise ValueError(f"an approach named {approach.name} is registered")
    _KNOWN[approach.name] = approach
    return approach


def get(name: str) -> Approach:
    if name not in _KNOWN:
        raise KeyError(f"no approach {name}; known: {', '.join(sorted(_KNOWN)) or 'none'}")
    return _KNOWN[name]


def all_approaches(task: str | None = None) -> list[Approach]:
    return [a for _, a in sorted(_KNOWN.items()) if task is None or task in a.tasks]


def compose(name: str, detect: Stage, identifiers: list[Stage], least: float = 0.0) -> Approach:
    """Identifiers asked in turn; a later one sees only boxes that the earlier ones left without a product or below ``least`` confidence, and keeps what it
    cannot better. Boxes are told apart by image and id."""

    def identify(boxes: DataFrame) -> DataFrame:
        done = identifiers[0](boxes)
        for later in identifiers[1:]:
            open_ = F.col("product").isNull() | (F.coalesce("confidence", F.lit(0.0)) < least)
            again = later(done.where(open_).drop("product", "confidence")).select("image", "id", F.col("product").alias("next"), F.col("confidence").alias("sure"))
            better = F.col("next").isNotNull() & (F.col("product").isNull() | (F.col("sure") > F.coalesce("confidence", F.lit(0.0))))
            both = done.join(again, ["image", "id"], "left")
            done = both.withColumn("product", F.when(better, F.col("next")).otherwise(F.col("product"))).withColumn("confidence", F.when(better, F.col("sure")).otherwise(F.col("confidence"))).drop("next", "sure")
        return done

    return Approach(name, detect, identify)


def traced(trace: Column, stage: str, rows: Column, note: Column | None = None) -> Column:
    """A trace (array of steps, or null) with one more step."""
    step = F.struct(F.lit(stage).alias("stage"), rows.cast("long").alias("rows"), (note if note is not None else F.lit(None).cast("string")).alias("note")).cast(STEP)
    return F.concat(F.coalesce(trace, F.array().cast(f"array<{STEP}>")), F.array(step))


def billed(usage: Column, more: Column) -> Column:
    """Two maps of billed units added up; units in one of them stay."""
    none = F.create_map().cast("map<string,double>")
    return F.map_zip_with(F.coalesce(usage, none), F.coalesce(more, none), lambda k, a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
