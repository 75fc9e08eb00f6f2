"""Shelf and planogram evaluation: rows of facings, their voids, brand blocks, and scores by scope.

Facings are boxes (image, id, x1, y1, x2, y2) with ``brand`` (null: unidentified) and ``owner``. ``planks`` of ``geometry`` places them;
everything after it is windows and aggregates over (image, scope, plank). ``planogram``, which scores several scopes of an image, and ``tiers``
take an image's boxes at once instead.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from itertools import pairwise
from statistics import median

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.sources import tables
from basalt.sources.shared import written

from .geometry import BAND, by_group, demo_bays, demo_boxes, image_bands, inside_bay, overlap, plank_rows, planks, ratio, size
from .matching import best_pairs, counts, greedy, match, scored

SCOPE = ["image", "scope"]
ROW = ["image", "scope", "plank"]


def placed(boxes: DataFrame) -> DataFrame:
    """The boxes of each scope with plank and slot."""
    return boxes.join(planks(boxes, ("image", "scope")), [*SCOPE, "id"])


def row_purity(rows: DataFrame) -> DataFrame:
    """Of each row n, brands and purity: 1 less the share of neighbours that change brand oftener than the row's brands ask for; an
    unidentified facing is like no other, a row of them alone has purity 0."""
    order = Window.partitionBy(*ROW).orderBy("slot")
    token = F.coalesce(F.concat(F.lit("b:"), "brand"), F.concat(F.lit("u:"), F.col("slot").cast("string")))
    changes = rows.withColumn("token", token).withColumn("change", (F.lag("token").over(order) != F.col("token")).cast("int"))
    out = changes.groupBy(*ROW).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("brand").alias("brands"), F.coalesce(F.sum("change"), F.lit(0)).alias("changes"))
    extra = F.greatest(F.lit(0), F.col("changes") - F.col("brands") + 1)
    return out.select(*ROW, "n", "brands", F.when(F.col("brands") == 0, 0.0).when(F.col("n") == 1, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - extra / (F.col("n") - 1))).alias("purity"))


def alignment(rows: DataFrame, least: float = 0.30) -> DataFrame:
    """Of each scope the brands shared by rows one above the other (pairs), and those whose spans overlap by that share of the shorter (aligned)."""
    spans = rows.where("brand is not null").groupBy(*ROW, "brand").agg(F.min("x1").alias("lo"), F.max("x2").alias("hi"))
    below = spans.select(*SCOPE, (F.col("plank") - 1).alias("plank"), "brand", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    both = spans.join(below, [*ROW, "brand"])
    overlap = F.greatest(F.lit(0.0), F.least("hi", "hi2") - F.greatest("lo", "lo2"))
    span = F.greatest(F.lit(1.0), F.least(F.col("hi") - F.col("lo"), F.col("hi2") - F.col("lo2")))
    return both.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(overlap / span >= least).alias("aligned"))


def row_voids(rows: DataFrame, bounds: DataFrame | None = None, factor: float = 1.5) -> DataFrame:
    """Gaps of ``factor`` median widths or more in a row, and at the edges of its scope's bounds (image, scope, lo, hi): kind, x1, x2,
    y1, y2, missing (gap by median width, rounded half to even, 1 at least)."""
    width = F.greatest(F.lit(1.0), F.col("x2") - F.col("x1"))
    whole = rows.groupBy(*ROW).agg(F.percentile(width, 0.5).alias("median"), F.min("y1").alias("top"), F.max("y2").alias("bottom"), F.min_by("x1", "slot").alias("first"), F.max_by("x2", "slot").alias("last"))
    following = F.lead("x1").over(Window.partitionBy(*ROW).orderBy("slot"))
    gaps = rows.select(*ROW, F.lit("inter_pack").alias("kind"), F.col("x2").alias("a"), following.alias("b"))
    if bounds is not None:
        edge = whole.join(bounds, SCOPE)
        gaps = gaps.unionByName(edge.select(*ROW, F.lit("bay_edge").alias("kind"), F.col("lo").alias("a"), F.col("first").alias("b")))
        gaps = gaps.unionByName(edge.select(*ROW, F.lit("bay_edge").alias("kind"), F.col("last").alias("a"), F.col("hi").alias("b")))
    gap = F.col("b") - F.col("a")
    found = gaps.join(whole.select(*ROW, "median", "top", "bottom"), ROW).where(gap >= factor * F.col("median"))
    missing = F.greatest(F.lit(1.0), F.bround(gap / F.col("median"))).cast("int")
    return found.select(*ROW, "kind", F.round("a", 1).alias("x1"), F.round("top", 1).alias("y1"), F.round("b", 1).alias("x2"), F.round("bottom", 1).alias("y2"), missing.alias("missing"), gap.alias("gap"))


def evaluate(boxes: DataFrame, bounds: DataFrame | None = None, factor: float = 1.5) -> DataFrame:
    """Of each scope facings by owner, share, purity weighted by facings, alignment, planks, voids and the empty share of its rows.

    boxes: image, scope (a number), id, coordinates, brand, owner. bounds: of the scopes whose edges are walls.
    """
    return evaluate_rows(written(placed(boxes), "placed"), bounds, factor)  # placed once, read by every score


def evaluate_rows(rows: DataFrame, bounds: DataFrame | None = None, factor: float = 1.5) -> DataFrame:
    """G18 of facings that have their plank and slot."""
    known = F.col("brand").isNotNull()
    base = rows.groupBy(*SCOPE).agg(
        F.count(F.lit(1)).alias("facings"), F.count_if(known & F.col("owner")).alias("owner_facings"), F.count_if(known & ~F.col("owner")).alias("rival_facings"),
        F.count_if(~known).alias("unidentified"), F.count_distinct("brand").alias("brands"), F.count_distinct("plank").alias("planks"),
    )
    some = rows.groupBy("image").agg(F.max(known).alias("any_known"))
    purity = row_purity(rows).groupBy(*SCOPE).agg(F.round(F.sum(F.col("purity") * F.col("n")) / F.sum("n"), 4).alias("purity"))
    voids = row_voids(rows, bounds, factor).groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("voids"), F.sum("missing").cast("long").alias("missing"), F.sum("gap").alias("gap"))
    spans = rows.groupBy(*ROW).agg(F.min_by("x1", "slot").alias("a"), F.max_by("x2", "slot").alias("b"))
    if bounds is not None:
        spans = spans.join(bounds, SCOPE, "left").select(*ROW, F.coalesce("lo", "a").alias("a"), F.coalesce("hi", "b").alias("b"))
    length = spans.groupBy(*SCOPE).agg(F.sum(F.greatest(F.lit(1.0), F.col("b") - F.col("a"))).alias("length"))
    out = base.join(some, "image")
    for part in (purity, alignment(rows), voids, length):
        out = out.join(part, SCOPE, "left")
    out = out.fillna(0, ["voids", "missing", "gap", "pairs", "aligned"])
    aligned = F.when(~F.col("any_known"), 0.0).when(F.col("pairs") == 0, 1.0).otherwise(F.round(F.col("aligned") / F.greatest(F.lit(1), F.col("pairs")), 4))
    return out.select(
        *SCOPE, "facings", "owner_facings", "rival_facings", "unidentified", F.round(F.col("owner_facings") / F.col("facings"), 4).alias("owner_share"), "purity", aligned.alias("alignment"),
        "brands", "planks", "voids", "missing", F.round(F.least(F.lit(1.0), F.col("gap") / F.greatest(F.lit(1.0), F.col("length"))), 4).alias("empty_share"),
    )


#: Scopes of an image: the whole frame, all bays together, and from 0 on each bay.
FRAME, BAYS = -2, -1


def scoped(boxes: DataFrame, bays: DataFrame) -> DataFrame:
    """The boxes once for each scope that they stand in."""
    a, b = boxes.alias("a"), bays.alias("b")
    within = a.join(b, (F.col("a.image") == F.col("b.image")) & inside_bay("a.", "b.", 0.45, None)).select("a.*", F.col("b.bay").cast("int").alias("scope"))
    return boxes.withColumn("scope", F.lit(FRAME)).unionByName(within).unionByName(within.drop("scope").distinct().withColumn("scope", F.lit(BAYS)))


def intrusions(inner: DataFrame) -> DataFrame:
    """Of each scope the facings that are not the owner's; unidentified ones count."""
    out = inner.groupBy(*SCOPE).agg(F.count_if(~(F.coalesce("owner", F.lit(False)) & F.col("brand").isNotNull())).alias("intrusions"), F.count(F.lit(1)).alias("held"))
    return out.select(*SCOPE, "intrusions", F.round(1 - F.col("intrusions") / F.col("held"), 4).alias("bay_purity"))


def per_bay(boxes: DataFrame, bays: DataFrame, factor: float = 1.5) -> DataFrame:
    """G19, by bay: the bay's evaluation within its walls, intrusions and purity."""
    inner = scoped(boxes, bays).where(F.col("scope") >= 0)
    walls = bays.select("image", F.col("bay").cast("int").alias("scope"), F.col("x1").alias("lo"), F.col("x2").alias("hi"))
    return evaluate(inner, walls, factor).join(intrusions(inner), SCOPE).withColumnRenamed("scope", "bay")


def rounded(x: float) -> float:
    """To 4 digits, half up, as Spark rounds."""
    return float(Decimal(repr(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def scope_scores(items: list, walls: tuple | None, any_known: bool, factor: float) -> dict:
    """G18 of one scope's facings, as ``evaluate_rows`` gives it."""
    rows, brands = plank_rows(items), {r.brand for r in items} - {None}
    known = [r for r in items if r.brand is not None]
    voids = missing = pairs = aligned = 0
    pure = gap = length = 0.0
    spans: list[dict] = []
    for row in rows:
        here = {r.brand for r in row} - {None}
        changes = sum(a.brand is None or a.brand != b.brand for a, b in pairwise(row))
        pure += len(row) * (0.0 if not here else 1.0 if len(row) == 1 else max(0.0, 1 - max(0, changes - len(here) + 1) / (len(row) - 1)))
        middle = median(max(1.0, r.x2 - r.x1) for r in row)
        edges = [(walls[0], row[0].x1), (row[-1].x2, walls[1])] if walls else []
        for a, b in [(a.x2, b.x1) for a, b in pairwise(row)] + edges:
            if b - a >= factor * middle:
                voids, missing, gap = voids + 1, missing + max(1, round((b - a) / middle)), gap + b - a
        a, b = walls or (row[0].x1, row[-1].x2)
        length += max(1.0, b - a)
        spans.append({k: (min(r.x1 for r in row if r.brand == k), max(r.x2 for r in row if r.brand == k)) for k in here})
    for up, low in pairwise(spans):
        for (lo, hi), (lo2, hi2) in ((up[k], low[k]) for k in up.keys() & low.keys()):
            pairs += 1
            aligned += max(0.0, min(hi, hi2) - max(lo, lo2)) / max(1.0, min(hi - lo, hi2 - lo2)) >= 0.30
    owner = sum(r.owner is True for r in known)
    return {
        "facings": len(items), "owner_facings": owner, "rival_facings": sum(r.owner is False for r in known), "unidentified": len(items) - len(known), "owner_share": rounded(owner / len(items)),
        "purity": rounded(pure / len(items)), "alignment": 0.0 if not any_known else 1.0 if not pairs else rounded(aligned / pairs), "brands": len(brands), "planks": len(rows),
        "voids": voids, "missing": missing, "empty_share": rounded(min(1.0, gap / max(1.0, length))), "intrusions": len(items) - owner, "bay_purity": rounded(1 - (len(items) - owner) / len(items)),
    }


def planogram(boxes: DataFrame, bays: DataFrame, factor: float = 1.5) -> DataFrame:
    """G19, by image: scored inside its bays if any of them holds a facing (mode bay), else over the whole frame (mode frame).

    With several bays, voids are the sum over bays, each within its own walls, and the empty share their mean. An image's facings and bays meet once.
    """
    coordinates = ["x1", "y1", "x2", "y2"]
    rows = boxes.select("image", F.lit(None).cast("int").alias("bay"), "id", *coordinates, "brand", "owner")
    more = bays.select("image", F.col("bay").cast("int").alias("bay"), F.lit(None).cast(boxes.schema["id"].dataType).alias("id"), *coordinates)
    rows = rows.unionByName(more, allowMissingColumns=True)

    def inside(r, b) -> bool:
        centre = b.x1 <= (r.x1 + r.x2) / 2 <= b.x2 and b.y1 <= (r.y1 + r.y2) / 2 <= b.y2
        return centre or overlap(r, b) / max(1.0, size(r)) >= 0.45

    def run(rows: list) -> list:
        items, frames = [r for r in rows if r.bay is None], [r for r in rows if r.bay is not None]
        if not items:
            return []
        known = any(r.brand is not None for r in items)
        held = [[r for r in items if inside(r, b)] for b in frames]
        within = {r.id for some in held for r in some}
        if within:
            out = scope_scores([r for r in items if r.id in within], (frames[0].x1, frames[0].x2) if len(frames) == 1 else None, known, factor) | {"mode": "bay"}
            if len(frames) > 1:
                each = [scope_scores(some, (b.x1, b.x2), known, factor) for b, some in zip(frames, held, strict=True) if some]
                out |= {c: sum(e[c] for e in each) for c in ("voids", "missing")} | {"empty_share": rounded(sum(e["empty_share"] for e in each) / len(frames))}
        else:
            out = scope_scores(items, None, known, factor) | {"intrusions": 0, "bay_purity": 1.0, "mode": "frame"}
        return [(items[0].image, *out.values(), len(items), len(frames))]

    kinds = "facings long, owner_facings long, rival_facings long, unidentified long, owner_share double, purity double, alignment double, brands long, planks long"
    kinds += ", voids long, missing long, empty_share double, intrusions long, bay_purity double, mode string, frame_facings long, bays long"
    return by_group(rows, ["image"], run, "image long, " + kinds)


def totals(scores: DataFrame, by: Column) -> DataFrame:
    """Of each run (by) its images, mean purity and alignment, and voids, missing facings and intrusions in all."""
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return scores.groupBy(by.alias("run")).agg(F.count(F.lit(1)).alias("images"), mean("purity"), mean("alignment"), F.sum("voids").cast("long").alias("voids"), F.sum("missing").cast("long").alias("missing"), F.sum("intrusions").cast("long").alias("intrusions"))


def bay_or_frame(predicted: DataFrame, truth: DataFrame, bays: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F2 and accuracy by image, of the boxes in its bays where it has any, else of all its boxes."""

    def within(boxes: DataFrame) -> DataFrame:
        a, b = boxes.alias("a"), bays.alias("b")
        inner = a.join(b, (F.col("a.image") == F.col("b.image")) & inside_bay("a.", "b."), "left_semi").select("a.*")
        return inner.unionByName(boxes.join(bays.select("image").distinct(), "image", "left_anti").select(*boxes.columns))

    return counts(within(predicted), within(truth), threshold)


def pooled(predicted: DataFrame, truth: DataFrame, scopes: dict[str, Column], threshold: float = 0.5) -> DataFrame:
    """Tp, fp and fn of all images together for each named scope, a predicate over boxes."""
    out = None
    for name, scope in scopes.items():
        one = counts(predicted.where(scope), truth.where(scope), threshold).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn"))).select(F.lit(name).alias("scope"), "tp", "fp", "fn")
        out = one if out is None else out.unionByName(one)
    return out


def run_scores(tiers_: DataFrame, by: Column) -> DataFrame:
    """The tiers of a run's images summed, then scored: named accuracy, precision, recall and F2 in the bands, share of catch-alls upgraded."""
    sums = tiers_.groupBy(by.alias("run")).agg(F.count(F.lit(1)).alias("images"), *(F.sum(c).alias(c) for c in tiers_.columns if c != "image"))
    rows = sums.select("run", "images", "named", "named_hits", "others", "upgraded", "extra", F.col("band_hits").alias("tp"), (F.col("in_band") - F.col("band_hits")).alias("fp"), F.col("band_misses").alias("fn"))
    safe = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 4)
    return scored(rows).withColumn("named_accuracy", safe("named_hits", "named")).withColumn("upgraded_share", safe("upgraded", "others"))


def spec_violations(scores: DataFrame, specs: DataFrame) -> DataFrame:
    """What a shelf's scores break of its rules, six kinds: image, violations (empty: none, or no spec).

    scores: image, brands (array), owner_share, purity, intrusions, voids, row_brands (map of plank to array). specs: image, required_brands,
    least_share, least_purity, forbid_rivals, most_voids, required_rows (map of plank to array), any of them null.
    """
    none = F.array().cast("array<string>")
    one = lambda when, text: F.when(F.coalesce(when, F.lit(False)), F.array(text)).otherwise(none)
    lacking = lambda want, have: F.array_except(F.coalesce(want, none), F.coalesce(have, none))
    row = lambda e: F.transform(lacking(e["value"], F.element_at("row_brands", e["key"])), lambda b: F.concat(F.lit("row_"), e["key"].cast("string"), F.lit("_missing_brand:"), b))
    rows = F.coalesce(F.flatten(F.transform(F.array_sort(F.map_entries("required_rows")), row)), none)
    found = F.concat(
        F.transform(lacking(F.col("required_brands"), F.col("brands")), lambda b: F.concat(F.lit("missing_required_brand:"), b)),
        one(F.col("owner_share") < F.col("least_share"), F.format_string("owner_share_below_target:%.3f<%.3f", "owner_share", "least_share")),
        one(F.col("purity") < F.col("least_purity"), F.format_string("brand_block_purity_below_target:%.3f<%.3f", "purity", "least_purity")),
        one(F.col("forbid_rivals") & (F.col("intrusions") > 0), F.concat(F.lit("competitor_intrusion_in_bay:"), F.col("intrusions").cast("string"))),
        one(F.col("voids") > F.col("most_voids"), F.concat(F.lit("oos_voids_exceed_limit:"), F.col("voids").cast("string"), F.lit(">"), F.col("most_voids").cast("string"))),
        rows,
    )
    return scores.join(specs, "image", "left").select("image", found.alias("violations"))


def same_fields(predicted: str, truth: str, fields: tuple[str, ...]) -> Column:
    """All fields equal, null on either side is not."""
    out = F.lit(True)
    for f in fields:
        out &= F.coalesce(F.col(f"{predicted}.{f}") == F.col(f"{truth}.{f}"), F.lit(False))
    return out


def identified(predicted: DataFrame, truth: DataFrame, catalog: DataFrame | None = None, fields: tuple[str, ...] = ("label",), threshold: float = 0.5) -> DataFrame:
    """Of each image tp, fp, fn and found: a matched box counts if its product is the truth's, or the catalog's fields of its product are.

    Boxes have product (nullable), truth also the fields, catalog product and the fields.
    """
    pairs = match(predicted, truth, threshold)
    p, t = predicted.select("image", F.col("id").alias("p"), F.col("product").alias("answer")), truth.select("image", F.col("id").alias("t"), "product", F.struct(*fields).alias("want"))
    named = pairs.join(p, ["image", "p"]).join(t, ["image", "t"])
    hit = F.coalesce(F.col("answer") == F.col("product"), F.lit(False))
    if catalog is not None:
        named = named.join(catalog.select(F.col("product").alias("answer"), F.struct(*fields).alias("said")), "answer", "left")
        hit |= F.col("said").isNotNull() & same_fields("said", "want", fields)
    hits = named.groupBy("image").agg(F.count_if(hit).alias("tp"), F.count(F.lit(1)).alias("found"))
    sizes = predicted.groupBy("image").agg(F.count(F.lit(1)).alias("n_p")).join(truth.groupBy("image").agg(F.count(F.lit(1)).alias("n_t")), "image", "full")
    out = sizes.join(hits, "image", "left").na.fill(0)
    return out.select("image", "tp", (F.col("n_p") - F.col("tp")).alias("fp"), (F.col("n_t") - F.col("tp")).alias("fn"), "found")


def merge_seam(top: DataFrame, bottom: DataFrame, seams: DataFrame, x_overlap: float = 0.8, band: float = 0.015) -> DataFrame:
    """Pieces of boxes that a seam cuts, joined one to one, the widest overlap first (ties by larger ids): image, x1, y1, x2, y2, merged.

    seams: image, seam (its height in the image), height. A piece touches the seam within ``band`` heights, 8 pixels at least.
    """
    reach = F.greatest(F.lit(8.0), band * F.col("height"))
    near = lambda df, edge: df.join(seams, "image").where(F.abs(F.col(edge) - F.col("seam")) <= reach).select(*df.columns)
    a, b = near(top, "y2").alias("a"), near(bottom, "y1").alias("b")
    narrow = F.least(F.col("a.x2") - F.col("a.x1"), F.col("b.x2") - F.col("b.x1"))
    share = F.greatest(F.lit(0.0), F.least("a.x2", "b.x2") - F.greatest("a.x1", "b.x1")) / F.when(narrow == 0, 1.0).otherwise(narrow)
    pairs = a.join(b, F.col("a.image") == F.col("b.image")).select(F.col("a.image").alias("image"), F.col("a.id").alias("p"), F.col("b.id").alias("t"), share.alias("iou")).where(F.col("iou") >= x_overlap)
    best = greedy(pairs)
    xs = lambda df, k, s: df.select("image", F.col("id").alias(k), *(F.col(c).alias(f"{c}_{s}") for c in ("x1", "y1", "x2", "y2")))
    both = best.join(xs(top, "p", "a"), ["image", "p"]).join(xs(bottom, "t", "b"), ["image", "t"])
    out = both.select("image", F.least("x1_a", "x1_b").alias("x1"), F.col("y1_a").alias("y1"), F.greatest("x2_a", "x2_b").alias("x2"), F.col("y2_b").alias("y2"), F.lit(True).alias("merged"))
    for df, k in ((top, "p"), (bottom, "t")):
        out = out.unionByName(df.join(best.select("image", F.col(k).alias("id")), ["image", "id"], "left_anti").select("image", "x1", "y1", "x2", "y2", F.lit(False).alias("merged")))
    return out


def linked_crops(boxes: DataFrame, crops: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Boxes of a session linked to its crops: in order of id the unused crop that overlaps most (the first of equals), then, for boxes left, the
    crop of the same number or else the next, if unused: image, id, crop, how. crops: image, crop, number (nullable) and coordinates (nullable).
    """
    coordinates = ["x1", "y1", "x2", "y2"]
    rows = boxes.select("image", "id", F.lit(None).cast("long").alias("crop"), F.lit(None).cast("int").alias("number"), *coordinates)
    rows = rows.unionByName(crops.select("image", F.lit(None).cast("int").alias("id"), F.col("crop").cast("long").alias("crop"), F.col("number").cast("int").alias("number"), *coordinates))

    def run(rows: list) -> list:
        items, pool = sorted((r for r in rows if r.crop is None), key=lambda r: r.id), sorted((r for r in rows if r.crop is not None), key=lambda r: r.crop)
        used, out, left = set(), [], []
        for r in items:
            near = [(ratio(r, c), -c.crop) for c in pool if c.crop not in used and c.x1 is not None and ratio(r, c) >= threshold]
            if near:
                used.add(-max(near)[1])
                out.append((r.image, r.id, -max(near)[1], "overlap"))
            else:
                left.append(r)
        numbered = {c.number: c.crop for c in pool if c.crop not in used and c.number is not None}
        for r in left:
            crop = numbered.get(r.id, numbered.get(r.id + 1))
            if crop is not None and crop not in used:
                used.add(crop)
                out.append((r.image, r.id, crop, "number"))
        return out

    return by_group(rows, ["image"], run, "image long, id int, crop long, how string")


def tiers(predicted: DataFrame, truth: DataFrame, bands: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Of each image, what the annotators named (tier 1), what stands in their bands (tier 2) and what lies beyond (tier 3).

    predicted: boxes with product, brand (null: unidentified); truth: boxes with product, brand and others (a catch-all label); bands as ``geometry.bands``
    gives them, by default those of truth. An image's boxes meet once, for both matches and all counts.
    named, named_hits; in_band, band_hits, band_misses; others, upgraded (a named answer on a catch-all), extra, extra_products, extra_brands.
    """
    coordinates = ["x1", "y1", "x2", "y2"]
    kind = lambda df, k, *more: df.select("image", F.lit(k).alias("kind"), *(F.col(c) for c in coordinates), *more)
    of = lambda c: next(f.dataType for f in truth.schema if f.name == c)
    no = lambda c: F.lit(None).cast(of(c)).alias(c)
    rows = kind(predicted, "p", "id", F.col("product").cast(of("product")).alias("product"), "brand", no("others"))
    rows = rows.unionByName(kind(truth, "t", "id", "product", "brand", "others"))
    if bands is not None:
        rows = rows.unionByName(kind(bands, "b", no("id"), no("product"), no("brand"), no("others")))

    own, whole = bands is None, lambda r: None not in (r.x1, r.y1, r.x2, r.y2)

    def within(a, b) -> bool:
        if not whole(a):
            return False
        rise = max(0.0, min(a.y2, b[3]) - max(a.y1, b[1])) * max(0.0, min(a.x2, b[2]) - max(a.x1, b[0]))
        return b[0] <= (a.x1 + a.x2) / 2 <= b[2] and b[1] <= (a.y1 + a.y2) / 2 <= b[3] or rise >= 0.5 * (a.x2 - a.x1) * (a.y2 - a.y1)

    def run(rows: list) -> list:
        said, true = ([r for r in rows if r.kind == k] for k in "pt")
        if own:
            spans = [b[2:6] for b in image_bands(true, *BAND)] if true else []
        else:
            spans = [(r.x1, r.y1, r.x2, r.y2) for r in rows if r.kind == "b" and whole(r)]
        inner = [r for r in said if any(within(r, b) for b in spans)]
        held = {r.id for r in inner}
        extra = [r for r in said if r.id not in held]
        if not true and not extra:
            return []
        touching = [(r, t, ratio(r, t)) for r in said if whole(r) for t in true if whole(t) and overlap(r, t) > 0]
        pairs = [x for x in touching if x[2] >= threshold]
        best = best_pairs(pairs)
        named_hits = sum(t.others is False and r.product is not None and r.product == t.product for r, t, _ in best)
        upgraded = sum(t.others is True and r.brand is not None for r, t, _ in best)
        band_hits = len(best_pairs([x for x in pairs if x[0].id in held]))
        some = lambda c: len({getattr(r, c) for r in extra} - {None})
        n, named, others = len(true), sum(t.others is False for t in true), sum(t.others is True for t in true)
        return [(rows[0].image, named, named_hits, len(inner) if true else 0, band_hits, n - band_hits, others, upgraded, len(extra), some("product"), some("brand"))]

    names = "named, named_hits, in_band, band_hits, band_misses, others, upgraded, extra, extra_products, extra_brands"
    return by_group(rows, ["image"], run, "image long, " + ", ".join(f"{c} long" for c in names.split(", ")))


# stand-ins: boxes of ``demo_boxes``, their label as brand, one label unidentified, one the owner's


def _facings(spark, d) -> DataFrame:
    boxes = demo_boxes(spark, d)
    return boxes.select("image", "id", "x1", "y1", "x2", "y2", F.when(F.col("label") != "b4", F.col("label")).alias("brand"), (F.col("label") < "b2").alias("owner"))


def _rows(spark, d) -> DataFrame:
    """Facings placed by their flag instead of by clustering, so that SQL can say the same."""
    boxes = _facings(spark, d).withColumn("plank", F.when(F.col("y1") < 30, 0).when(F.col("y1") < 90, 1).otherwise(2)).withColumn("scope", F.lit(0))
    slot = F.row_number().over(Window.partitionBy("image", "plank").orderBy("x1", "y1", "id")) - 1
    return boxes.withColumn("slot", slot)


def _bounds(spark, d) -> DataFrame:
    return tables.load(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("long").alias("image"), F.lit(0).alias("scope"), F.lit(-40.0).alias("lo"), (F.lit(250.0) + F.col("o_custkey") % 90).alias("hi"))


def _products(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    truth = demo_boxes(spark, d).withColumn("product", F.col("score").cast("long") % 7).withColumn("others", F.col("id") % 6 == 5).withColumn("brand", F.col("label"))
    moved = truth.where("id % 4 <> 0").withColumn("x1", F.col("x1") + F.col("id") * 2).withColumn("x2", F.col("x2") + F.col("id") * 2).withColumn("product", F.when(F.col("id") % 5 != 0, (F.col("product") + (F.col("id") % 3 == 0).cast("int")) % 7))
    catalog = spark.range(7).select(F.col("id").alias("product"), F.concat(F.lit("b"), F.col("id") % 5).alias("label"))
    return moved, truth, catalog


def _seam(spark, d) -> DataFrame:
    boxes = demo_boxes(spark, d)
    seams = boxes.select("image").distinct().select("image", F.lit(85.0).alias("seam"), F.lit(400.0).alias("height"))
    return merge_seam(boxes.where("y2 < 115").withColumn("y2", F.least("y2", F.lit(85.0))), boxes.where("y1 > 55 and y1 < 90").withColumn("y1", F.lit(85.0)), seams)


def _links(spark, d) -> DataFrame:
    boxes = demo_boxes(spark, d)
    crops = boxes.where("id % 3 <> 0").select("image", (F.col("id") + 50).alias("crop"), F.col("id").alias("number"), *((F.when(F.col("id") % 2 == 0, F.col(c) + 4)).alias(c) for c in ("x1", "y1", "x2", "y2")))
    return linked_crops(boxes, crops)


def _tiers(spark, d) -> DataFrame:
    predicted, truth, _ = _products(spark, d)
    truth = truth.where(F.col("id").isin(1, 2, 3, 4))  # "id <= 4" would give its reading a rank limit of its own, and the lines would be dealt twice
    return tiers(predicted, truth)


def _specs(spark, d) -> DataFrame:
    rows = _rows(spark, d)
    planks_ = rows.where("brand is not null").groupBy("image", "plank").agg(F.array_sort(F.collect_set("brand")).alias("b")).groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct("plank", "b"))).alias("row_brands"))
    scores = rows.groupBy("image").agg(F.array_sort(F.collect_set("brand")).alias("brands"), F.avg((F.col("owner") & F.col("brand").isNotNull()).cast("double")).alias("owner_share"), F.count_if(~F.col("owner")).alias("intrusions"), F.count_if(F.col("brand").isNull()).alias("voids"), F.lit(0.8).alias("purity"))
    specs = scores.where("image % 2 = 0").select("image", F.array(F.lit("b0")).alias("required_brands"), F.lit(0.3).alias("least_share"), F.lit(0.75).alias("least_purity"), F.lit(True).alias("forbid_rivals"), F.lit(1).alias("most_voids"), F.create_map(F.lit(1), F.array(F.lit("b1"))).alias("required_rows"))
    return spec_violations(scores.join(planks_, "image", "left"), specs).select("image", F.array_join("violations", ";").alias("violations"))


def _totals(spark, d) -> DataFrame:
    rows = _rows(spark, d)
    return totals(evaluate_rows(rows, _bounds(spark, d)).join(intrusions(rows), SCOPE), F.col("image") % 7)


def _bay_or_frame(spark, d) -> DataFrame:
    predicted, truth, _ = _products(spark, d)
    return bay_or_frame(predicted, truth, demo_bays(spark, d))


QUERIES = {
    "a13_run_level_metrics": lambda spark, d: run_scores(_tiers(spark, d), F.col("image") % 5),
    "a15_bay_or_frame_score": _bay_or_frame,
    "a20_planogram_totals": _totals,
    "a22_pooled_scopes": lambda spark, d: pooled(*_products(spark, d)[:2], {"frame": F.lit(True), "left": F.col("x1") < 100, "even": F.col("id") % 2 == 0}),
    "w4_row_voids": lambda spark, d: row_voids(_rows(spark, d), _bounds(spark, d)).select("image", "plank", "kind", "x1", "y1", "x2", "y2", "missing"),
    "w5_row_brand_purity": lambda spark, d: row_purity(_rows(spark, d)).select("image", "plank", "n", "brands", F.round("purity", 6).alias("purity")),
    "w6_vertical_alignment": lambda spark, d: alignment(_rows(spark, d)).select("image", "pairs", "aligned"),
    "g18_scope_evaluation": lambda spark, d: evaluate(_facings(spark, d).withColumn("scope", F.lit(0))),
    "g19_planogram": lambda spark, d: planogram(_facings(spark, d), demo_bays(spark, d)),
    "g19_planogram_per_bay": lambda spark, d: per_bay(_facings(spark, d), demo_bays(spark, d)),
    "g20_spec_audit": _specs,
    "j7_identified_match": lambda spark, d: identified(*_products(spark, d)),
    "j9_linked_crops": _links,
    "j22_seam_merge": _seam,
    "a12_three_tier_metrics": _tiers,
}

_ROWS = """
box AS (SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS id, CAST(l_linenumber * 30.0 + l_quantity % 7 AS DOUBLE) AS x1,
  CAST(CASE l_returnflag WHEN 'A' THEN 0.0 WHEN 'N' THEN 60.0 ELSE 120.0 END + l_quantity % 5 AS DOUBLE) AS y1, CAST(l_linenumber * 30.0 + l_quantity % 7 + 20 + l_quantity % 25 AS DOUBLE) AS x2, CAST(CASE l_returnflag WHEN 'A' THEN 0.0 WHEN 'N' THEN 60.0 ELSE 120.0 END + l_quantity % 5 + 50 AS DOUBLE) AS y2,
  CASE WHEN l_partkey % 5 <> 4 THEN concat('b', l_partkey % 5) END AS brand, l_partkey % 5 < 2 AS owner, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS plank FROM lineitem),
rows AS (SELECT *, row_number() OVER (PARTITION BY image, plank ORDER BY x1, y1, id) - 1 AS slot FROM box)
"""
_VOIDS = """
whole AS (SELECT image, plank, quantile_cont(greatest(1.0, x2 - x1), 0.5) AS med, min(y1) AS top, max(y2) AS bottom, arg_min(x1, slot) AS first, arg_max(x2, slot) AS last FROM rows GROUP BY image, plank),
bounds AS (SELECT o_orderkey AS image, CAST(-40 AS DOUBLE) AS lo, CAST(250 + o_custkey % 90 AS DOUBLE) AS hi FROM orders WHERE o_orderkey % 2 = 0),
gaps AS (SELECT image, plank, 'inter_pack' AS kind, x2 AS a, lead(x1) OVER (PARTITION BY image, plank ORDER BY slot) AS b FROM rows UNION ALL SELECT w.image, plank, 'bay_edge', lo, first FROM whole w JOIN bounds USING (image) UNION ALL SELECT w.image, plank, 'bay_edge', last, hi FROM whole w JOIN bounds USING (image)),
voids AS (SELECT g.image, g.plank, kind, round(a, 1) AS x1, round(top, 1) AS y1, round(b, 1) AS x2, round(bottom, 1) AS y2, CAST(greatest(1.0, round_even((b - a) / med, 0)) AS INTEGER) AS missing FROM gaps g JOIN whole w ON g.image = w.image AND g.plank = w.plank WHERE b - a >= 1.5 * med)
"""
_PURITY = """
t AS (SELECT *, coalesce('b:' || brand, 'u:' || slot) AS token FROM rows), c AS (SELECT *, CASE WHEN lag(token) OVER (PARTITION BY image, plank ORDER BY slot) <> token THEN 1 ELSE 0 END AS change FROM t),
g AS (SELECT image, plank, count(*) AS n, count(DISTINCT brand) AS brands, sum(change) AS changes FROM c GROUP BY image, plank),
pure AS (SELECT image, plank, n, brands, CASE WHEN brands = 0 THEN 0.0 WHEN n = 1 THEN 1.0 ELSE greatest(0.0, 1 - greatest(0, changes - brands + 1) / CAST(n - 1 AS DOUBLE)) END AS purity FROM g)
"""
_ALIGNED = """
s AS (SELECT image, plank, brand, min(x1) AS lo, max(x2) AS hi FROM rows WHERE brand IS NOT NULL GROUP BY image, plank, brand),
al AS (SELECT a.image, count(*) AS pairs, count(*) FILTER (greatest(0.0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) / greatest(1.0, least(a.hi - a.lo, b.hi - b.lo)) >= 0.30) AS aligned FROM s a JOIN s b ON a.image = b.image AND a.brand = b.brand AND b.plank = a.plank + 1 GROUP BY a.image)
"""
ORACLES = {
    "w4_row_voids": f"WITH {_ROWS}, {_VOIDS} SELECT * FROM voids",
    "w5_row_brand_purity": f"WITH {_ROWS}, {_PURITY} SELECT image, plank, n, brands, round(purity, 6) AS purity FROM pure",
    "w6_vertical_alignment": f"WITH {_ROWS}, {_ALIGNED} SELECT * FROM al",
    "a20_planogram_totals": f"WITH {_ROWS}, {_VOIDS}, {_PURITY}, {_ALIGNED}, p AS (SELECT image, round(sum(purity * n) / sum(n), 4) AS purity, max(brands) AS known FROM pure GROUP BY image), v AS (SELECT image, count(*) AS voids, sum(missing) AS missing FROM voids GROUP BY image), r AS (SELECT image, count(*) FILTER (NOT (owner AND brand IS NOT NULL)) AS intrusions FROM rows GROUP BY image), i AS (SELECT p.image, purity, CASE WHEN known = 0 THEN 0.0 WHEN coalesce(pairs, 0) = 0 THEN 1.0 ELSE round(aligned / CAST(pairs AS DOUBLE), 4) END AS alignment, coalesce(voids, 0) AS voids, coalesce(missing, 0) AS missing, intrusions FROM p JOIN r USING (image) LEFT JOIN al USING (image) LEFT JOIN v USING (image)) SELECT image % 7 AS run, count(*) AS images, round(avg(purity), 6) AS purity, round(avg(alignment), 6) AS alignment, CAST(sum(voids) AS BIGINT) AS voids, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(intrusions) AS BIGINT) AS intrusions FROM i GROUP BY image % 7",
    "g20_spec_audit": f"""WITH {_ROWS}, s AS (SELECT image, bool_or(brand = 'b0') AS has, avg(CASE WHEN owner AND brand IS NOT NULL THEN 1.0 ELSE 0.0 END) AS share, count(*) FILTER (NOT owner) AS rivals, count(*) FILTER (brand IS NULL) AS voids, bool_or(plank = 1 AND brand = 'b1') AS row_has FROM rows GROUP BY image)
SELECT image, CASE WHEN image % 2 <> 0 THEN '' ELSE concat_ws(';', CASE WHEN NOT coalesce(has, false) THEN 'missing_required_brand:b0' END, CASE WHEN share < 0.3 THEN printf('owner_share_below_target:%.3f<0.300', share) END, CASE WHEN rivals > 0 THEN 'competitor_intrusion_in_bay:' || rivals END, CASE WHEN voids > 1 THEN 'oos_voids_exceed_limit:' || voids || '>1' END, CASE WHEN NOT coalesce(row_has, false) THEN 'row_1_missing_brand:b1' END) END AS violations FROM s""",
}
