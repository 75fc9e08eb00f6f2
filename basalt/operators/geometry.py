"""Boxes: expressions over (x1, y1, x2, y2) and operators whose steps depend on order within one image."""

from __future__ import annotations

from collections import namedtuple
from itertools import groupby
from math import exp
from statistics import fmean, median

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.sources import tables

#: Boxes of an image; one image is one shelf photo, so a group is small.
BOXES = "image long, id int, x1 double, y1 double, x2 double, y2 double, score double, label string"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def by_group(df: DataFrame, by: list[str], run, schema: str) -> DataFrame:
    """run(list of rows) for each group of the columns ``by``, giving tuples of schema; many groups share one call into Python.

    Rows come sorted by the columns; a task holds one Arrow batch and one group. A window brings them together, so that rows which
    already are dealt by the columns (after a window or a join) stay where they are.
    """
    names, fields = df.columns, [f.split() for f in schema.split(", ")]
    places = [names.index(c) for c in by]
    of = lambda r: tuple(r[i] for i in places)

    def built(found: list) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [[] for _ in fields]
        return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])

    def task(batches):
        row, held = namedtuple("Box", names), []
        for batch in batches:
            found = []
            for key, rows in groupby(zip(*(batch.column(c).to_pylist() for c in names), strict=True), key=of):
                if held and of(held[0]) != key:
                    found += run(held)
                    held = []
                held += map(row._make, rows)
            yield built(found)
        yield built(list(run(held)) if held else [])

    dealt = Window.partitionBy(*by).orderBy(*by)
    return df.withColumn("by__group", F.row_number().over(dealt)).mapInArrow(task, schema)


def by_image(df: DataFrame, run, schema: str) -> DataFrame:
    return by_group(df, ["image"], run, schema)


def area(b: str = "") -> Column:
    return F.greatest(F.col(f"{b}x2") - F.col(f"{b}x1"), F.lit(0.0)) * F.greatest(F.col(f"{b}y2") - F.col(f"{b}y1"), F.lit(0.0))


def intersection(a: str, b: str) -> Column:
    w = F.least(f"{a}x2", f"{b}x2") - F.greatest(f"{a}x1", f"{b}x1")
    h = F.least(f"{a}y2", f"{b}y2") - F.greatest(f"{a}y1", f"{b}y1")
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: str, b: str) -> Column:
    """G1: 0 for disjoint boxes and an empty union."""
    union = area(a) + area(b) - intersection(a, b)
    return F.when(union > 0, intersection(a, b) / union).otherwise(0.0)


def containment(a: str, b: str) -> Column:
    """The shared part of the smaller box."""
    small = F.least(area(a), area(b))
    return F.when(small > 0, intersection(a, b) / small).otherwise(0.0)


def demo_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as facings: place and quantity give x, the flag the row, the part the label."""
    li = tables.load(spark, sf_dir, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))
    li = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag").withColumn("place", place)  # dealt before columns are made
    x = F.col("l_linenumber") * 30.0 + F.col("l_quantity") % 7
    y = F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 60.0).otherwise(120.0) + F.col("l_quantity") % 5
    return li.select(
        F.col("l_orderkey").alias("image"), F.col("place").alias("id"), x.alias("x1"), y.alias("y1"), (x + 20 + F.col("l_quantity") % 25).alias("x2"), (y + 50).alias("y2"),
        F.col("l_extendedprice").cast("double").alias("score"), F.concat(F.lit("b"), F.col("l_partkey") % 5).alias("label"),
    )


def overlap(a, b) -> float:
    w, h = min(a.x2, b.x2) - max(a.x1, b.x1), min(a.y2, b.y2) - max(a.y1, b.y1)
    return w * h if w > 0 and h > 0 else 0.0


def size(a) -> float:
    return max(a.x2 - a.x1, 0.0) * max(a.y2 - a.y1, 0.0)


def ratio(a, b) -> float:
    both = overlap(a, b)
    union = size(a) + size(b) - both
    return both / union if union > 0 else 0.0


def nms(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Boxes that no better one of their image overlaps by more than the threshold; ties by id."""

    def run(rows: list) -> list:
        kept: list = []
        for r in sorted(rows, key=lambda r: (-r.score, r.id)):
            if all(ratio(r, k) <= threshold for k in kept):
                kept.append(r)
        return kept

    return by_image(boxes, run, BOXES)


def soft_nms(boxes: DataFrame, sigma: float = 0.5, gate: float = 0.55, drop: float = 0.65, least: float = 0.12, image_area: float = 0.0, small: float = 0.015, tall: float = 1.85, wide: float = 2.25) -> DataFrame:
    """Boxes that overlap a better one by ``drop`` go, and by ``gate`` too, unless the better box is small and thin:
    then their scores fall by a Gaussian of the overlap. Below ``least`` a box goes. image_area 0: every box is small."""

    def thin(r) -> bool:
        w, h = max(1.0, r.x2 - r.x1), max(1.0, r.y2 - r.y1)
        return (image_area <= 0 or w * h <= small * image_area) and (h >= tall * w or w >= wide * h)

    def run(rows: list) -> list:
        left, out = [r for r in rows if r.score >= least], []
        while left:
            best = min(left, key=lambda r: (-r.score, r.id))
            out.append(best)
            soft, rest = thin(best), []
            for r in left:
                if r is best or (o := ratio(best, r)) >= drop or o >= gate and not soft:
                    continue
                r = r._replace(score=r.score * exp(-o * o / max(0.1, sigma))) if o >= gate else r
                if r.score >= least:
                    rest.append(r)
            left = rest
        return out

    return by_image(boxes, run, BOXES)


def drop_containers(boxes: DataFrame, share: float = 0.65, slack: float = 8.0, tall: float = 0.72) -> DataFrame:
    """Boxes that hold a much smaller one (``slack`` pixels may stick out) go, unless they are tall and narrow; one join within images."""
    a, b = boxes.alias("a"), boxes.alias("b")
    inside = (F.col("b.x1") >= F.col("a.x1") - slack) & (F.col("b.y1") >= F.col("a.y1") - slack) & (F.col("b.x2") <= F.col("a.x2") + slack) & (F.col("b.y2") <= F.col("a.y2") + slack)
    broad = (F.col("a.x2") - F.col("a.x1")) > tall * (F.col("a.y2") - F.col("a.y1"))
    held = a.join(b, (F.col("a.image") == F.col("b.image")) & (F.col("a.id") != F.col("b.id")) & inside & broad & (area("b.") < share * area("a.")))
    return boxes.join(held.select(F.col("a.image").alias("image"), F.col("a.id").alias("id")).distinct(), ["image", "id"], "left_anti")


def drop_depth_ghosts(boxes: DataFrame, x_overlap: float = 0.55, centre: float = 0.65, share: float = 0.92) -> DataFrame:
    """From the front (lowest bottom, then largest, then smallest id) on, a smaller box that stands behind a kept one goes."""

    def behind(c, f) -> bool:
        narrow = min(c.x2 - c.x1, f.x2 - f.x1) or 1.0
        across = max(0.0, min(c.x2, f.x2) - max(c.x1, f.x1)) / narrow
        return across >= x_overlap and abs(c.y1 + c.y2 - f.y1 - f.y2) / 2 <= centre * (f.y2 - f.y1) and size(c) <= share * size(f)

    def run(rows: list) -> list:
        kept: list = []
        for c in sorted(rows, key=lambda r: (-r.y2, -size(r), r.id)):
            if not any(behind(c, f) for f in kept):
                kept.append(c)
        return kept

    return by_image(boxes, run, BOXES)


def dedup_same_label(boxes: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Of boxes of one label that overlap by more than the threshold the first by id stays."""

    def run(rows: list) -> list:
        kept: list = []
        for r in sorted(rows, key=lambda r: r.id):
            if all(k.label != r.label or ratio(r, k) <= threshold for k in kept):
                kept.append(r)
        return kept

    return by_image(boxes, run, BOXES)


def dedup_by_priority(boxes: DataFrame, overlap_at: float = 0.70, inside_at: float = 0.88, last: tuple[str, ...] = ()) -> DataFrame:
    """A box that overlaps a kept one, or holds or lies in one, goes; labels in ``last`` come last, then higher scores, larger areas, smaller ids come first."""

    def same(a, b) -> bool:
        both, x, y = overlap(a, b), max(1.0, size(a)), max(1.0, size(b))
        return both > 0 and (both >= overlap_at * (x + y - both) or both >= inside_at * min(x, y))

    def run(rows: list) -> list:
        kept: list = []
        for r in sorted(rows, key=lambda r: (r.label in last, -(r.score or 0.0), -size(r), r.id)):
            if not any(same(r, k) for k in kept):
                kept.append(r)
        return kept

    return by_image(boxes, run, BOXES)


#: overlap_at and near of ``planks``.
PLANK = (0.40, 0.50)


def plank_rows(rows: list, overlap_at: float = PLANK[0], near: float = PLANK[1]) -> list[list]:
    """The planks of one scope's boxes from the top, each from the left."""
    shelves: list[dict] = []
    for r in sorted(rows, key=lambda r: (r.y1 + r.y2, r.x1, r.id)):
        height, middle, best = max(1.0, r.y2 - r.y1), (r.y1 + r.y2) / 2, (-1.0, None)
        for s in shelves:
            tallest = max(height, s["height"])
            share = max(0.0, min(r.y2, s["bottom"]) - max(r.y1, s["top"])) / max(1.0, min(height, s["height"]))
            away = abs(middle - s["middle"])
            if (share >= overlap_at or away <= near * tallest) and share - away / tallest > best[0]:
                best = share - away / tallest, s
        s = best[1]
        if s is None:
            s = {"boxes": [], "top": r.y1, "bottom": r.y2}
            shelves.append(s)
        s["boxes"].append(r)
        s |= {"top": min(s["top"], r.y1), "bottom": max(s["bottom"], r.y2), "middle": median((k.y1 + k.y2) / 2 for k in s["boxes"]), "height": median(max(1.0, k.y2 - k.y1) for k in s["boxes"])}
    shelves.sort(key=lambda s: s["middle"])
    return [sorted(s["boxes"], key=lambda k: (k.x1, k.y1, k.id)) for s in shelves]


def planks(boxes: DataFrame, by: tuple[str, ...] = ("image",), overlap_at: float = PLANK[0], near: float = PLANK[1]) -> DataFrame:
    """Rows of boxes. From the top, a box may join a row whose span it overlaps by that share of the lesser height, or whose
    median centre is that near in heights; of several it joins the one with the largest overlap less distance, in heights.

    Returns the columns ``by`` (longs), id, plank (0 at the top) and slot (0 at the left); by x1, y1 and id in a row.
    """

    def run(rows: list) -> list:
        return [(*(getattr(k, c) for c in by), k.id, i, j) for i, row in enumerate(plank_rows(rows, overlap_at, near)) for j, k in enumerate(row)]

    schema = ", ".join(f"{c} long" for c in by) + ", id int, plank int, slot int"
    return by_group(boxes.select(*by, "id", "x1", "y1", "x2", "y2"), list(by), run, schema)


def bay_merge(full: DataFrame, crops: DataFrame, bays: DataFrame, duplicate: float = 0.45) -> DataFrame:
    """Boxes of the whole image, and of those found in a bay's crop (in order of id) the ones inside the bay that repeat none so far.

    crops have a column bay, bays (image, bay, x1, y1, x2, y2). Returns BOXES and added.
    """
    a, b = crops.alias("a"), bays.alias("b")
    inner = a.join(b, (F.col("a.image") == F.col("b.image")) & (F.col("a.bay") == F.col("b.bay")) & inside_bay("a.", "b.")).select("a.*").drop("bay")
    rows = full.withColumn("added", F.lit(False)).unionByName(inner.withColumn("added", F.lit(True)))

    def run(rows: list) -> list:
        kept = [r for r in rows if not r.added]
        for r in sorted((r for r in rows if r.added), key=lambda r: r.id):
            if all(ratio(r, k) < duplicate for k in kept):
                kept.append(r)
        return kept

    return by_image(rows, run, BOXES + ", added boolean")


def inside_bay(a: str, b: str, share: float = 0.45, base: float | None = 0.25) -> Column:
    """The box's centre lies in the bay, or that share of its area, or (if base is given) its bottom with that share."""
    x, y = (F.col(f"{a}x1") + F.col(f"{a}x2")) / 2, (F.col(f"{a}y1") + F.col(f"{a}y2")) / 2
    centre = x.between(F.col(f"{b}x1"), F.col(f"{b}x2")) & y.between(F.col(f"{b}y1"), F.col(f"{b}y2"))
    part = intersection(a, b) / F.greatest(F.lit(1.0), area(a))
    rests = F.col(f"{a}y2").between(F.col(f"{b}y1"), F.col(f"{b}y2")) & (part >= base) if base is not None else F.lit(False)
    return centre | (part >= share) | rests


def clutter(boxes: DataFrame, bays: DataFrame, width: float, height: float) -> DataFrame:
    """G12 without its pixel rule: BOXES and reason, null for those that stay; a speck or flat strip, a header board or a thin pillar at a bay's edge."""
    a, b = boxes.alias("a"), bays.alias("b")
    side = lambda t, k: F.greatest(F.lit(1.0), F.col(f"{t}{k}2") - F.col(f"{t}{k}1"))
    w, h, aw, ah = side("a.", "x"), side("a.", "y"), side("b.", "x"), side("b.", "y")
    x, y = (F.col("a.x1") + F.col("a.x2")) / 2, (F.col("a.y1") + F.col("a.y2")) / 2
    near = x.between(F.col("b.x1") - 0.02 * aw, F.col("b.x2") + 0.02 * aw) & y.between(F.col("b.y1") - 0.02 * ah, F.col("b.y2") + 0.02 * ah)
    header = (F.col("a.y2") <= F.col("b.y1") + 0.16 * ah) & (w >= 2.3 * h) & (w >= 0.42 * aw)
    edge = (x <= F.col("b.x1") + 0.045 * aw) | (x >= F.col("b.x2") - 0.045 * aw)
    pillar = edge & (h >= 0.55 * ah) & (w <= 0.17 * h)
    strip = (w * h < 0.0002 * width * height) | ((w >= 2.85 * h) & (h < 0.042 * height))
    rule = F.when(near & header, F.struct(F.col("b.bay").alias("bay"), F.lit("header_board").alias("reason"))).when(near & pillar, F.struct(F.col("b.bay").alias("bay"), F.lit("wing_pillar").alias("reason")))
    found = a.join(b, F.col("a.image") == F.col("b.image"), "left").groupBy(*(F.col(f"a.{c}").alias(c) for c in boxes.columns)).agg(F.min(rule)["reason"].alias("reason"))
    own = found.select(*boxes.columns, F.col("reason").alias("by_bay")).alias("a")
    return own.select(*(F.col(f"a.{c}") for c in boxes.columns), F.when(strip, "rail_strip").otherwise(F.col("by_bay")).alias("reason"))


def unsupported(boxes: DataFrame, bays: DataFrame) -> DataFrame:
    """Image, id and reason of boxes in a bay that rest on no plank of two (header or wing graphics), or show only as shoulders behind a taller front box.

    bays: image, bay, x1, y1, x2, y2; those that frame nothing (hangers) are left out by the caller. Bays are taken in order, a dropped box counts in no later one.
    """
    kinds = boxes.select("image", F.lit(0).alias("bay"), "id", "x1", "y1", "x2", "y2", F.lit(False).alias("frame"))
    rows = kinds.unionByName(bays.select("image", F.col("bay").cast("int").alias("bay"), F.lit(0).alias("id"), "x1", "y1", "x2", "y2", F.lit(True).alias("frame")))

    def shoulder(r, f, planked: bool) -> bool:
        w, h, fw, fh = max(1.0, r.x2 - r.x1), max(1.0, r.y2 - r.y1), max(1.0, f.x2 - f.x1), max(1.0, f.y2 - f.y1)
        across = max(0.0, min(r.x2, f.x2) - max(r.x1, f.x1)) / max(1.0, min(w, fw))
        return across >= 0.65 and h < 0.62 * fh and r.y1 < f.y1 - 0.02 * fh and f.y1 - 0.04 * fh <= r.y2 <= f.y1 + 0.42 * fh and (not planked or h < 0.42 * fh)

    def run(rows: list) -> list:
        frames, items, gone = sorted((r for r in rows if r.frame), key=lambda r: r.bay), sorted((r for r in rows if not r.frame), key=lambda r: r.id), {}
        for bay in frames:
            w, h = max(1.0, bay.x2 - bay.x1), max(1.0, bay.y2 - bay.y1)
            inner = [r for r in items if r.id not in gone and bay.x1 - 0.02 * w <= (r.x1 + r.x2) / 2 <= bay.x2 + 0.02 * w and bay.y1 - 0.02 * h <= (r.y1 + r.y2) / 2 <= bay.y2 + 0.02 * h]
            if len(inner) < 4:
                continue
            lines: list[list] = []
            for r in sorted(inner, key=lambda r: (r.y2, r.id)):
                line = next((k for k in lines if abs(r.y2 - median(x.y2 for x in k)) <= 0.065 * h), None)
                lines.append([r]) if line is None else line.append(r)
            lines = [k for k in lines if len(k) > 1]
            if not lines:
                continue
            heights, planked = [median(x.y2 for x in k) for k in lines], {x.id for k in lines for x in k}
            for r in inner:
                middle = (r.x1 + r.x2) / 2
                aside = r.y2 <= bay.y1 + 0.28 * h or middle <= bay.x1 + 0.075 * w or middle >= bay.x2 - 0.075 * w
                if aside and min(abs(r.y2 - y) for y in heights) > 0.085 * h:
                    gone[r.id] = "floating"
            standing = [r for r in inner if r.id not in gone]
            for r in standing:
                if any(f.id != r.id and f.id not in gone and shoulder(r, f, r.id in planked) for f in standing):
                    gone[r.id] = "shoulder"
        return [(rows[0].image, i, why) for i, why in gone.items()]

    return by_image(rows, run, "image long, id int, reason string")


def twin_groups(boxes: DataFrame, row: float = 0.85, step: float = 3.5, alike: float = 1.33, zone_at: float = 0.985, patch_at: float = 0.965) -> DataFrame:
    """Equal neighbours on a row share one representative. boxes have zone (a colour descriptor) and patch (a unit vector).

    From the left, a box opens a group and takes those near its row, near the group's last centre, of like size, colour and layout.
    Returns image, id, grp and medoid (the id in the group's middle).
    """

    def like(a, b) -> bool:
        if not a.zone or not b.zone or len(a.zone) != len(b.zone):
            return 0.5 >= zone_at
        away = (sum((x - y) ** 2 for x, y in zip(a.zone, b.zone, strict=True)) / (len(a.zone) / 3)) ** 0.5
        return exp(-away / 36) >= zone_at and sum(x * y for x, y in zip(a.patch, b.patch, strict=True)) >= patch_at

    def run(rows: list) -> list:
        left, out, n = sorted(rows, key=lambda r: (r.x1 + r.x2, r.id)), [], 0
        while left:
            first = left.pop(0)
            w, h, group, rest = max(1.0, first.x2 - first.x1), max(1.0, first.y2 - first.y1), [first], []
            for r in left:
                v, u, last = max(1.0, r.x2 - r.x1), max(1.0, r.y2 - r.y1), group[-1]
                near = abs(first.y1 + first.y2 - r.y1 - r.y2) / 2 <= row * max(h, u) and abs(r.x1 + r.x2 - last.x1 - last.x2) / 2 <= step * max(w, v)
                same = 0.75 <= v / w <= alike and 0.75 <= u / h <= alike and near and like(first, r)
                (group if same else rest).append(r)
            out += [(r.image, r.id, n, group[len(group) // 2].id) for r in group]
            left, n = rest, n + 1
        return out

    return by_image(boxes.select("image", "id", "x1", "y1", "x2", "y2", "zone", "patch"), run, "image long, id int, grp int, medoid int")


def uncertain_clusters(boxes: DataFrame, row: float = 0.55, cosine_at: float = 0.92) -> DataFrame:
    """Uncertain boxes of one row with the same first candidate (top, not null) and alike vectors: image, id and cluster (its first id).

    boxes: image, id, coordinates, top and unit (the unit vector). From the top, then the left, a box opens a cluster and takes those that match it.
    """

    def run(rows: list) -> list:
        left, out = sorted(rows, key=lambda r: (r.y1 + r.y2, r.x1, r.id)), []
        while left:
            first, rest = left.pop(0), []
            out.append((first.image, first.id, first.id))
            for r in left:
                level = abs(first.y1 + first.y2 - r.y1 - r.y2) / 2 <= row * max(1.0, first.y2 - first.y1, r.y2 - r.y1)
                if level and first.top is not None and first.top == r.top and sum(x * y for x, y in zip(first.unit, r.unit, strict=True)) >= cosine_at:
                    out.append((r.image, r.id, first.id))
                else:
                    rest.append(r)
            left = rest
        return out

    return by_image(boxes.select("image", "id", "x1", "y1", "x2", "y2", "top", "unit"), run, "image long, id int, cluster int")


def mean_rows(rows: list, near: float) -> list[list]:
    """From the top, a box joins the first row whose mean centre is that near in heights."""
    out: list[list] = []
    for r in sorted(rows, key=lambda r: (r.y1 + r.y2, r.id)):
        middle, height = (r.y1 + r.y2) / 2, max(1.0, r.y2 - r.y1)
        row = next((k for k in out if abs(middle - fmean((x.y1 + x.y2) / 2 for x in k)) <= near * max(height, fmean(max(1.0, x.y2 - x.y1) for x in k))), None)
        out.append([r]) if row is None else row.append(r)
    return [sorted(k, key=lambda r: (r.x1 + r.x2, r.id)) for k in out]


def smooth_rows(boxes: DataFrame, most: float = 0.40, gap: float = 0.85, cosine_at: float = 0.86, near: float = 0.45) -> DataFrame:
    """A weak answer (null, or below ``most`` and another) between two equal ones becomes theirs if gaps are small, vectors alike,
    the answer is in its shortlist and all three stand in one bay; from the left, later boxes see earlier edits.

    boxes: image, id, coordinates, answer, confidence, unit, shortlist and bay (null: the image has no bays). Returns image, id, answer, smoothed.
    """

    def run(rows: list) -> list:
        answer, changed = {r.id: r.answer for r in rows}, set()
        cosine = lambda a, b: sum(x * y for x, y in zip(a.unit, b.unit, strict=True))
        for row in mean_rows(rows, near) if len(rows) > 2 else []:
            for a, m, b in zip(row, row[1:], row[2:], strict=False):
                p, now = answer[a.id], answer[m.id]
                weak = now is None or (1.0 if m.confidence is None else m.confidence) < most and now != p
                if p is None or answer[b.id] != p or not weak or len({a.bay, m.bay, b.bay}) > 1:
                    continue
                most_gap = gap * (a.x2 - a.x1 + b.x2 - b.x1) / 2
                if max(m.x1 - a.x2, b.x1 - m.x2, 0.0) <= most_gap and min(cosine(m, a), cosine(m, b)) >= cosine_at and p in (m.shortlist or ()):
                    answer[m.id] = p
                    changed.add(m.id)
        return [(r.image, r.id, answer[r.id], r.id in changed) for r in rows]

    return by_image(boxes.select("image", "id", "x1", "y1", "x2", "y2", "answer", "confidence", "unit", "shortlist", "bay"), run, "image long, id int, answer long, smoothed boolean")


#: near, gap and pad of ``bands``.
BAND = (0.60, 1.25, 0.35)


def image_bands(rows: list, near: float, gap: float, pad: float) -> list:
    """The bands of one image's boxes."""

    def upper(values) -> float:
        values = sorted(max(1.0, v) for v in values)
        return values[len(values) // 2]

    out = []
    for row in mean_rows(rows, near):
        w, h = upper(r.x2 - r.x1 for r in row), upper(r.y2 - r.y1 for r in row)
        row = sorted(row, key=lambda r: (r.x1, r.id))
        segments, right = [[row[0]]], row[0].x2
        for r in row[1:]:
            if r.x1 - right <= gap * w:
                segments[-1].append(r)
                right = max(right, r.x2)
            else:
                segments.append([r])
                right = r.x2
        for g in segments:
            x1, y1, x2, y2 = min(k.x1 for k in g) - pad * w, min(k.y1 for k in g) - pad * h, max(k.x2 for k in g) + pad * w, max(k.y2 for k in g) + pad * h
            out.append((round(max(0.0, y1), 2), round(y2, 2), round(max(0.0, x1), 2), round(x2, 2), len(g)))
    return [(rows[0].image, i, x1, y1, x2, y2, n) for i, (y1, y2, x1, x2, n) in enumerate(sorted(out))]


def bands(boxes: DataFrame, near: float = BAND[0], gap: float = BAND[1], pad: float = BAND[2]) -> DataFrame:
    """Rows by running mean, cut where a gap is over ``gap`` median widths; each segment's box, padded by shares of the medians (the upper
    one of two) and clipped at 0, from the top: image, band, x1, y1, x2, y2, n."""
    return by_image(boxes.select("image", "id", "x1", "y1", "x2", "y2"), lambda rows: image_bands(rows, near, gap, pad), "image long, band int, x1 double, y1 double, x2 double, y2 double, n int")


def demo_bays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to two bays an image, on some images none."""
    o = tables.load(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0")
    bay = F.explode(F.sequence(F.lit(0), (F.col("o_orderkey") % 2).cast("int"))).alias("bay")
    rows = o.select(F.col("o_orderkey").cast("long").alias("image"), "o_custkey", bay)
    left = 20.0 + 120.0 * F.col("bay") + F.col("o_custkey") % 30
    return rows.select("image", "bay", left.alias("x1"), F.lit(10.0).alias("y1"), (left + 100).alias("x2"), (120.0 + F.col("o_custkey") % 60).alias("y2"))


def demo_vectors(boxes: DataFrame) -> DataFrame:
    """Boxes with an answer, a shortlist, a unit vector and colours that follow from their label."""
    k = F.substring("label", 2, 9).cast("int")
    angle = k * 0.1 + F.col("id") * 0.02
    unit = F.array(F.cos(angle), F.sin(angle))
    answer = F.when(F.col("id") % 4 != 2, k.cast("long"))
    return boxes.select(
        "image", "id", "x1", "y1", "x2", "y2", answer.alias("answer"), k.alias("top"), (F.col("score") % 100 / 100).alias("confidence"), unit.alias("unit"), unit.alias("patch"),
        F.array(*(F.lit(float(j)) + k for j in range(3))).alias("zone"), F.array(*((k + j).cast("long") for j in range(-2, 3))).alias("shortlist"), F.lit(None).cast("int").alias("bay"),
    )


def demo_clutter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of which some are flat strips and some thin pillars."""
    b, flat, thin = demo_boxes(spark, sf_dir), F.col("id") % 4 == 0, F.col("id") % 4 == 1
    pick = lambda c, f, t: F.when(flat, F.col(f"{c}1") + f).when(thin, F.col(f"{c}1") + t).otherwise(F.col(f"{c}2"))
    return b.withColumn("x2", pick("x", 60, 15)).withColumn("y2", pick("y", 15, 100))


def crops_of(spark, d):
    b = demo_boxes(spark, d)
    moved = b.where("id % 2 = 1").withColumn("x1", F.col("x1") + 9).withColumn("x2", F.col("x2") + 9).withColumn("id", F.col("id") + 100)
    return b, moved.withColumn("bay", F.lit(0)), demo_bays(spark, d)


QUERIES = {
    "g4_nms": lambda spark, d: nms(demo_boxes(spark, d)),
    "g5_soft_nms": lambda spark, d: soft_nms(demo_boxes(spark, d)).withColumn("score", F.round("score", 6)),
    "g6_drop_containers": lambda spark, d: drop_containers(demo_boxes(spark, d), slack=20.0),
    "g7_drop_depth_ghosts": lambda spark, d: drop_depth_ghosts(demo_boxes(spark, d)),
    "g8_band_segments": lambda spark, d: bands(demo_boxes(spark, d)),
    "g10_plank_clustering": lambda spark, d: planks(demo_boxes(spark, d)),
    "g11_plank_support": lambda spark, d: unsupported(demo_boxes(spark, d), demo_bays(spark, d)),
    "g12_clutter_rules": lambda spark, d: clutter(demo_clutter(spark, d), demo_bays(spark, d), 400.0, 400.0).where("reason IS NOT NULL").select("image", "id", "reason"),
    "g13_bay_crop_merge": lambda spark, d: bay_merge(*crops_of(spark, d)),
    "g14_twin_groups": lambda spark, d: twin_groups(demo_vectors(demo_boxes(spark, d))),
    "g15_uncertain_clusters": lambda spark, d: uncertain_clusters(demo_vectors(demo_boxes(spark, d))),
    "k13_dedup_same_label": lambda spark, d: dedup_same_label(demo_boxes(spark, d), 0.2),
    "k14_dedup_by_priority": lambda spark, d: dedup_by_priority(demo_boxes(spark, d), 0.3, 0.5, ("b0",)),
    "w7_row_smoothing": lambda spark, d: smooth_rows(demo_vectors(demo_boxes(spark, d))),
}

_DEMO = """
box AS (SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS id, CAST(l_linenumber * 30.0 + l_quantity % 7 AS DOUBLE) AS x1,
  CAST(CASE l_returnflag WHEN 'A' THEN 0.0 WHEN 'N' THEN 60.0 ELSE 120.0 END + l_quantity % 5 AS DOUBLE) AS y1, CAST(l_linenumber * 30.0 + l_quantity % 7 + 20 + l_quantity % 25 AS DOUBLE) AS x2, CAST(CASE l_returnflag WHEN 'A' THEN 0.0 WHEN 'N' THEN 60.0 ELSE 120.0 END + l_quantity % 5 + 50 AS DOUBLE) AS y2,
  CAST(l_extendedprice AS DOUBLE) AS score, concat('b', l_partkey % 5) AS label FROM lineitem),
bay AS (SELECT o_orderkey AS image, bay, CAST(20 + 120 * bay + o_custkey % 30 AS DOUBLE) AS x1, CAST(10 AS DOUBLE) AS y1, CAST(120 + 120 * bay + o_custkey % 30 AS DOUBLE) AS x2, CAST(120 + o_custkey % 60 AS DOUBLE) AS y2 FROM orders, range(0, 2) r(bay) WHERE o_orderkey % 3 <> 0 AND bay <= o_orderkey % 2)
"""
ORACLES = {
    "g6_drop_containers": f"WITH {_DEMO} SELECT image, CAST(id AS INTEGER) AS id, x1, y1, x2, y2, score, label FROM box a WHERE NOT EXISTS (SELECT 1 FROM box b WHERE a.image = b.image AND a.id <> b.id AND (b.x2 - b.x1) * (b.y2 - b.y1) < 0.65 * (a.x2 - a.x1) * (a.y2 - a.y1) AND b.x1 >= a.x1 - 20 AND b.y1 >= a.y1 - 20 AND b.x2 <= a.x2 + 20 AND b.y2 <= a.y2 + 20 AND a.x2 - a.x1 > 0.72 * (a.y2 - a.y1))",
    "g12_clutter_rules": f"""WITH {_DEMO}, odd AS (SELECT image, id, x1, y1, CASE id % 4 WHEN 0 THEN x1 + 60 WHEN 1 THEN x1 + 15 ELSE x2 END AS x2, CASE id % 4 WHEN 0 THEN y1 + 15 WHEN 1 THEN y1 + 100 ELSE y2 END AS y2 FROM box), r AS (SELECT a.*, b.bay, greatest(1.0, a.x2 - a.x1) AS w, greatest(1.0, a.y2 - a.y1) AS h, greatest(1.0, b.x2 - b.x1) AS aw, greatest(1.0, b.y2 - b.y1) AS ah, (a.x1 + a.x2) / 2 AS cx, (a.y1 + a.y2) / 2 AS cy, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2 FROM odd a LEFT JOIN bay b ON a.image = b.image),
m AS (SELECT *, CASE WHEN NOT (cx BETWEEN bx1 - 0.02 * aw AND bx2 + 0.02 * aw AND cy BETWEEN by1 - 0.02 * ah AND by2 + 0.02 * ah) THEN NULL WHEN y2 <= by1 + 0.16 * ah AND w >= 2.3 * h AND w >= 0.42 * aw THEN 'header_board' WHEN (cx <= bx1 + 0.045 * aw OR cx >= bx2 - 0.045 * aw) AND h >= 0.55 * ah AND w <= 0.17 * h THEN 'wing_pillar' END AS rule FROM r),
g AS (SELECT image, id, any_value(w) AS w, any_value(h) AS h, first(rule ORDER BY bay) FILTER (rule IS NOT NULL) AS rule FROM m GROUP BY image, id),
o AS (SELECT image, CAST(id AS INTEGER) AS id, CASE WHEN w * h < 0.0002 * 160000 OR (w >= 2.85 * h AND h < 0.042 * 400) THEN 'rail_strip' ELSE rule END AS reason FROM g) SELECT * FROM o WHERE reason IS NOT NULL""",
}
