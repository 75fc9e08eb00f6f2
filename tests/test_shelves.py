"""Hand numbers and naive re-tellings of the box, shelf, vector and record operators."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.operators import geometry, matching, records, shelves, vectors

BOX = "image long, id int, x1 double, y1 double, x2 double, y2 double"


def boxes(spark, rows):
    return spark.createDataFrame([(1, i, *map(float, r[:4]), float(r[4]) if len(r) > 4 else 0.0, r[5] if len(r) > 5 else "a") for i, r in enumerate(rows)], geometry.BOXES)


def ids(frame):
    return sorted(r.id for r in frame.collect())


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def test_greedy_order_equals_a_naive_retelling(spark):
    """NMS, same-label dedup and the one-to-one match on random boxes of several images, rows in any order."""
    draw, rows = random.Random(1), []
    for image in range(6):
        for i in range(40):
            x, y = draw.uniform(0, 200), draw.uniform(0, 60)
            rows.append((image, i, x, y, x + draw.uniform(10, 40), y + draw.uniform(10, 40), round(draw.random(), 2), draw.choice("ab")))
    frame = spark.createDataFrame(rows, geometry.BOXES)
    for again in (frame, frame.orderBy(F.rand(3)).repartition(5)):
        nms, dedup, pairs = set(), set(), set()
        for image in range(6):
            mine, kept, own = [r for r in rows if r[0] == image], [], []
            for r in sorted(mine, key=lambda r: (-r[6], r[1])):
                if all(iou(r[2:6], k[2:6]) <= 0.3 for k in kept):
                    kept.append(r)
            for r in mine:
                if all(k[7] != r[7] or iou(r[2:6], k[2:6]) <= 0.4 for k in own):
                    own.append(r)
            nms |= {(image, r[1]) for r in kept}
            dedup |= {(image, r[1]) for r in own}
            p, t = [r for r in mine if r[7] == "a"], [r for r in mine if r[7] == "b"]
            used = set()
            for v, i, j in sorted(((iou(a[2:6], b[2:6]), a[1], b[1]) for a in p for b in t if iou(a[2:6], b[2:6]) >= 0.2), reverse=True):
                if ("p", i) not in used and ("t", j) not in used:
                    used |= {("p", i), ("t", j)}
                    pairs.add((image, i, j))
        assert {(r.image, r.id) for r in geometry.nms(again, 0.3).collect()} == nms
        assert {(r.image, r.id) for r in geometry.dedup_same_label(again, 0.4).collect()} == dedup
        assert {(r.image, r.p, r.t) for r in matching.match(again.where("label = 'a'"), again.where("label = 'b'"), 0.2).collect()} == pairs


def test_soft_nms(spark):
    same = (0, 0, 100, 100)
    rows = [(*same, 0.9), (0, 0, 100, 62, 0.8), (0, 0, 100, 40, 0.7), (300, 0, 320, 100, 0.9), (300, 0, 320, 60, 0.5), (300, 0, 320, 20, 0.1)]
    got = {r.id: r.score for r in geometry.soft_nms(boxes(spark, rows)).collect()}
    assert set(got) == {0, 2, 3, 4}  # 0.62 of a broad box goes, of a thin one decays; below the least score goes
    assert got[2] == 0.7 and got[4] == pytest.approx(0.5 * math.exp(-0.36 / 0.5))
    assert 4 not in {r.id for r in geometry.soft_nms(boxes(spark, rows), image_area=1000.0).collect()}  # not small beside the image


def test_planks_ghosts_containers_and_priority(spark):
    rows = [(10, 10, 30, 60), (40, 12, 60, 58), (70, 100, 90, 150), (12, 108, 40, 149), (100, 55, 120, 105)]
    placed = {r.id: (r.plank, r.slot) for r in geometry.planks(boxes(spark, rows)).collect()}
    assert placed[0] == (0, 0) and placed[1] == (0, 1) and placed[3][1] == 0 and placed[2][1] == 1 and placed[2][0] == placed[3][0] > 0
    assert ids(geometry.drop_depth_ghosts(boxes(spark, [(0, 0, 40, 100), (5, -10, 35, 60), (5, -300, 35, -200)]))) == [0, 2]
    assert ids(geometry.drop_containers(boxes(spark, [(0, 0, 100, 50), (10, 10, 40, 40), (200, 0, 230, 100), (205, 10, 220, 40)]))) == [1, 2, 3]
    rows = [(0, 0, 100, 100, 0.5), (2, 2, 100, 100, 0.9), (10, 10, 30, 30, 0.1), (0, 0, 100, 100, 1.0, "others"), (500, 0, 510, 10)]
    assert ids(geometry.dedup_by_priority(boxes(spark, rows), last=("others",))) == [1, 4]


def test_twins_clusters_and_smoothing(spark):
    flat = [(i, 30.0 * i, 0.0, 30.0 * i + 25, 50.0) for i in range(5)]
    like = [[1.0, 0.0]] * 3 + [[0.0, 1.0], [1.0, 0.0]]
    frame = spark.createDataFrame([(1, *r, [1.0, 2.0, 3.0], u) for r, u in zip(flat, like, strict=True)], BOX + ", zone array<double>, patch array<double>")
    got = {r.id: r.grp for r in geometry.twin_groups(frame, step=2.0).collect()}
    assert got[0] == got[1] == got[2] != got[3]
    frame = spark.createDataFrame([(1, *r, t, u) for r, t, u in zip(flat, [7, 7, None, 7, 8], like, strict=True)], BOX + ", top int, unit array<double>")
    assert {r.id: r.cluster for r in geometry.uncertain_clusters(frame).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    schema = BOX + ", answer long, confidence double, unit array<double>, shortlist array<long>, bay int"
    near, all_ = [1.0, 0.0], [5, 6]
    rows = [(1, *flat[0], 5, 0.9, near, all_, 0), (1, *flat[1], None, 0.9, near, all_, 0), (1, *flat[2], 5, 0.9, near, all_, 0), (1, *flat[3], 6, 0.1, near, all_, 0), (1, *flat[4], 5, 0.9, near, all_, 0)]
    smooth = lambda rows: {r.id: r.answer for r in geometry.smooth_rows(spark.createDataFrame(rows, schema)).collect()}
    assert smooth(rows) == {0: 5, 1: 5, 2: 5, 3: 5, 4: 5}
    assert smooth([(*r[:7], 0.9, *r[8:]) if r[1] == 3 else r for r in rows])[3] == 6  # confident
    assert smooth([(*r[:10], 1) if r[1] == 2 else r for r in rows]) == {0: 5, 1: None, 2: 5, 3: 6, 4: 5}  # another bay
    assert smooth([(*r[:9], [9], 0) if r[1] == 1 else r for r in rows])[1] is None  # not in its shortlist


def test_bands_bay_merge_support(spark):
    got = geometry.bands(boxes(spark, [(10, 10, 30, 50), (35, 10, 55, 50), (200, 12, 220, 52), (10, 200, 30, 240)])).orderBy("band").collect()
    assert [(r.x1, r.y1, r.x2, r.y2, r.n) for r in got] == [(3.0, 0.0, 62.0, 64.0, 2), (193.0, 0.0, 227.0, 66.0, 1), (3.0, 186.0, 37.0, 254.0, 1)]
    bays = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 100.0)], "image long, bay int, x1 double, y1 double, x2 double, y2 double")
    crops = boxes(spark, [(11, 10, 31, 50), (60, 10, 80, 50), (62, 10, 82, 50), (300, 0, 320, 40)]).withColumn("bay", F.lit(0)).withColumn("id", F.col("id") + 10)
    assert ids(geometry.bay_merge(boxes(spark, [(10, 10, 30, 50)]), crops, bays)) == [0, 11]
    rows = [(20, 60, 40, 90), (45, 60, 65, 90), (70, 55, 90, 90), (2, 2, 10, 8), (48, 52, 62, 64)]
    got = {r.id: r.reason for r in geometry.unsupported(boxes(spark, rows), bays).collect()}
    assert got == {3: "floating", 4: "shoulder"}
    assert geometry.unsupported(boxes(spark, rows[:3]), bays).count() == 0


def test_seam_identity_and_links(spark):
    top, bottom = boxes(spark, [(0, 0, 20, 99), (30, 0, 50, 98), (60, 0, 80, 50)]), boxes(spark, [(1, 101, 21, 140), (29, 100, 51, 150), (90, 100, 99, 120)])
    got = shelves.merge_seam(top, bottom, spark.createDataFrame([(1, 100.0, 200.0)], "image long, seam double, height double")).collect()
    assert Counter((r.x1, r.y1, r.x2, r.y2, r.merged) for r in got) == Counter([(0, 0, 21, 140, True), (29, 0, 51, 150, True), (60, 0, 80, 50, False), (90, 100, 99, 120, False)])
    truth = boxes(spark, [(0, 0, 10, 10), (20, 0, 30, 10), (40, 0, 50, 10)]).withColumn("product", F.col("id").cast("long"))
    said = boxes(spark, [(0, 0, 10, 10), (20, 0, 30, 10), (90, 0, 99, 9)]).withColumn("product", F.when(F.col("id") == 0, F.lit(0)).otherwise(F.lit(9)).cast("long"))
    catalog = spark.createDataFrame([(9, "a")], "product long, label string")
    score = lambda c: tuple(shelves.identified(said, truth, c).first())[1:]
    assert score(None) == (1, 2, 2, 2) and score(catalog) == (2, 1, 1, 2)
    crops = spark.createDataFrame([(1, 70, 9, 21.0, 0.0, 31.0, 10.0), (1, 71, 0, None, None, None, None), (1, 72, 3, None, None, None, None)], "image long, crop long, number int, x1 double, y1 double, x2 double, y2 double")
    assert sorted((r.id, r.crop, r.how) for r in shelves.linked_crops(truth, crops).collect()) == [(0, 71, "number"), (1, 70, "overlap"), (2, 72, "number")]


def facings(spark, rows, image=1):
    return spark.createDataFrame([(image, i, *map(float, r[:4]), r[4], r[4] in ("own", "ours")) for i, r in enumerate(rows)], BOX + ", brand string, owner boolean")


def test_scope_evaluation_by_hand(spark):
    """Two rows of packs 20 wide: own own rival own with a gap of 40 (two packs), and below it own alone with an unidentified one."""
    top = [(0, 0, 20, 50, "own"), (20, 0, 40, 50, "own"), (40, 0, 60, 50, "rival"), (100, 0, 120, 50, "own")]
    low = [(0, 100, 20, 150, "own"), (20, 100, 40, 150, None)]
    frame = facings(spark, top + low)
    [r] = shelves.evaluate(frame.withColumn("scope", F.lit(0))).collect()
    # top: 2 changes, 1 needed, so 1 - 1/3; below: own, unidentified: one change, none needed: 0
    assert (r.facings, r.owner_facings, r.rival_facings, r.unidentified, r.brands, r.planks) == (6, 4, 1, 1, 2, 2)
    assert (r.owner_share, r.purity, r.alignment) == (round(4 / 6, 4), round((4 * 2 / 3 + 2 * 0) / 6, 4), 1.0)
    assert (r.voids, r.missing, r.empty_share) == (1, 2, round(40 / 160, 4))
    bays = spark.createDataFrame([(1, 0, -40.0, -10.0, 130.0, 60.0)], "image long, bay int, x1 double, y1 double, x2 double, y2 double")
    [p] = shelves.planogram(frame, bays).collect()
    assert (p["mode"], p.bays, p.facings, p.frame_facings, p.intrusions, p.bay_purity) == ("bay", 1, 4, 6, 1, 0.75)
    assert (p.voids, p.missing, p.empty_share) == (2, 4, round(80 / 170, 4))  # the left wall is 40 away
    [b] = shelves.per_bay(frame, bays).collect()
    assert (b.bay, b.facings, b.voids, b.purity) == (0, 4, 2, round(2 / 3, 4))
    far = bays.withColumn("x1", F.lit(900.0)).withColumn("x2", F.lit(990.0))
    [p] = shelves.planogram(frame, far).collect()
    assert (p["mode"], p.bays, p.facings, p.voids, p.intrusions) == ("frame", 1, 6, 1, 0)


def test_two_bays_add_their_voids(spark):
    frame = facings(spark, [(0, 0, 20, 50, "own"), (60, 0, 80, 50, "own"), (200, 0, 220, 50, None), (260, 0, 280, 50, "rival")])
    bays = spark.createDataFrame([(1, 0, 0.0, 0.0, 80.0, 50.0), (1, 1, 200.0, 0.0, 280.0, 50.0)], "image long, bay int, x1 double, y1 double, x2 double, y2 double")
    [p] = shelves.planogram(frame, bays).collect()
    assert (p.voids, p.missing, p.empty_share, p.intrusions) == (2, 4, 0.5, 2)


def test_tiers(spark):
    truth = boxes(spark, [(0, 0, 20, 50), (25, 0, 45, 50)]).withColumn("product", F.col("id").cast("long")).withColumn("others", F.col("id") == 1).withColumn("brand", F.lit("b"))
    said = boxes(spark, [(0, 0, 20, 50), (25, 0, 45, 50), (300, 300, 320, 350)]).withColumn("product", F.col("id").cast("long")).withColumn("brand", F.lit("b"))
    [r] = shelves.tiers(said, truth, geometry.bands(truth)).collect()
    assert tuple(r)[1:] == (1, 1, 2, 2, 0, 1, 1, 1, 1, 1)


def test_spec_rules(spark):
    scores = spark.createDataFrame([(1, ["x"], 0.25, 0.5, 2, 3, {0: ["x"]}), (2, ["y"], 0.9, 0.9, 0, 0, {0: ["y"]})], "image long, brands array<string>, owner_share double, purity double, intrusions long, voids long, row_brands map<int,array<string>>")
    specs = spark.createDataFrame([(1, ["x", "y"], 0.5, 0.6, True, 1, {0: ["y"], 4: ["x"]})], "image long, required_brands array<string>, least_share double, least_purity double, forbid_rivals boolean, most_voids int, required_rows map<int,array<string>>")
    got = {r.image: r.violations for r in shelves.spec_violations(scores, specs).collect()}
    assert got == {1: ["missing_required_brand:y", "owner_share_below_target:0.250<0.500", "brand_block_purity_below_target:0.500<0.600", "competitor_intrusion_in_bay:2", "oos_voids_exceed_limit:3>1", "row_0_missing_brand:y", "row_4_missing_brand:x"], 2: []}


def gallery(spark, classes=12, views=6, size=16):
    draw = np.random.default_rng(7)
    centre = draw.standard_normal((classes, size))
    rows = [(i * 100 + j, i, (centre[i] + 0.4 * draw.standard_normal(size)).tolist()) for i in range(classes) for j in range(views)]
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), rows


def test_vector_search_and_index(spark, monkeypatch):
    frame, rows = gallery(spark)
    monkeypatch.setattr(vectors, "BLOCK", 20)  # several blocks a side
    q, g = frame.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), frame.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    want = {i: sorted(unit, key=lambda k: (-round(float(unit[i] @ unit[k]), 6), k))[:4] for i in unit if i % 100 == 0}
    got = defaultdict(dict)
    for r in vectors.top_k(q, g, 4).collect():
        got[r.query][r.place] = r.key
    assert {i: [p[k] for k in (1, 2, 3, 4)] for i, p in got.items()} == want
    near = {(r.query, r.key) for r in vectors.indexed_neighbours(q, g, 4, bits=4, tables_=16, size=16).collect()}
    assert sum((i, k) in near for i, v in want.items() for k in v) >= 0.9 * 4 * len(want)


def test_promotion_calibration_and_adapter(spark):
    frame, rows = gallery(spark)
    items = spark.createDataFrame([(1, rows[0][2]), (2, [-x for x in rows[0][2]])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r["class"] for r in vectors.promoted(items, frame, 0.7, 0.04).collect()}
    assert got == {1: 0, 2: None}
    assert vectors.promoted(items, frame.where("label = 3"), -2.0).where("class = 3 and lead is null").count() == 2  # sole class
    with pytest.raises(ValueError, match="test"):
        vectors.calibration(frame, "test")
    few = vectors.calibration(frame.where("label < 3"))[0].first()
    assert tuple(few) == (28.0, 0.56, 0.86, 0.8)
    whole, classes = vectors.calibration(frame)
    assert classes.count() == 12 and 18 <= whole.first().inverse_temperature <= 44 and 0.82 <= whole.first().own_floor <= 0.92
    adapter = vectors.Adapter.fit(frame, hidden=24, epochs=3)
    out = adapter.transform(frame.unionByName(spark.createDataFrame([(-1, 0, None)], frame.schema))).collect()
    assert sum(r.embedding is None for r in out) == 1 and all(r.embedding is None or abs(np.linalg.norm(r.embedding) - 1) < 1e-9 for r in out)


def test_records(spark):
    rows = [("h1", "variant", 1, "x", "v", None, False), ("h1", "pack", 2, "x", "v", "p", False), ("h1", "brand", 3, "x", None, "p", False), ("h2", "variant", 4, "x", "v", None, False), ("h2", "pack", 5, "y", "v", None, False), ("h3", "brand", 6, "x", None, None, False), ("h3", "pack", 7, "x", None, None, True), ("h4", "variant", 8, "x", "v", None, False), ("h4", "brand", 9, "x", None, None, False)]
    frame = spark.createDataFrame(rows, "h string, silo string, uri long, brand string, variant string, pack string, copy boolean")
    joined = records.conflicts(records.observations(frame, records.SILOS), records.SILOS)
    link = spark.createDataFrame([("h4",)], "h string")
    got = {r.h: (r["mode"], r.confidence, r.reasons) for r in records.join_mode(joined, records.SILOS, link).collect()}
    assert got == {"h1": ("3way_variant_pack_brand", 1.0, []), "h2": ("2way_variant_pack", 0.0, ["brand_conflict"]), "h3": ("1way_brand", 0.95, []), "h4": ("2way_variant_brand", 0.985, [])}
    crops = [("s", 1, "a", True, "x", 10, 10, [1.0, 0.0]), ("s", 1, "b", False, "x", 10, 10, [1.0, 0.01]), ("s", 1, "c", False, "x", 10, 10, [0.0, 1.0]), ("s", 2, "d", True, "x", 10, 10, None), ("s", 2, "e", False, "x", 10, 11, None), ("s", 3, "f", False, "x", 1, 1, None), ("s", 3, "g", False, "x", 1, 1, None)]
    frame = spark.createDataFrame(crops, "session string, number int, h string, variant boolean, brand string, width int, height int, vector array<double>")
    assert [tuple(r) for r in records.relinked(frame).collect()] == [("b", "a")]
    assert records.evaluated_fields("cat, pack+brands/cat") == ("category", "packaging_type", "brand") and records.evaluated_fields("4")[1] == "base_variant"
    with pytest.raises(ValueError, match="names no field"):
        records.evaluated_fields(" , ")
    splits = spark.createDataFrame([("u", "train"), ("u", "test"), ("w", "val"), ("w", "val"), (None, "train"), (None, "val")], "uri string, split string")
    assert [tuple(r) for r in records.leaks(splits).collect()] == [("train", "test", 1)]


def test_scores_by_scope_and_run(spark):
    truth, said = boxes(spark, [(0, 0, 20, 50), (300, 0, 320, 50)]), boxes(spark, [(0, 0, 20, 50), (200, 0, 220, 50)])
    bays = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 100.0)], "image long, bay int, x1 double, y1 double, x2 double, y2 double")
    score = lambda b: tuple(shelves.bay_or_frame(said, truth, b).select("tp", "fp", "fn").first())
    assert score(bays) == (1, 0, 0) and score(bays.where("image = 2")) == (1, 1, 1)
    got = {r.scope: (r.tp, r.fp, r.fn) for r in shelves.pooled(said, truth, {"all": F.lit(True), "left": F.col("x1") < 100, "none": F.lit(False)}).collect()}
    assert got == {"all": (1, 1, 1), "left": (1, 0, 0), "none": (0, 0, 0)}
    tiers = spark.createDataFrame([(1, 4, 3, 5, 4, 1, 2, 1, 0, 0, 0), (3, 1, 0, 0, 0, 3, 0, 0, 2, 1, 1)], "image long, named long, named_hits long, in_band long, band_hits long, band_misses long, others long, upgraded long, extra long, extra_products long, extra_brands long")
    [r] = shelves.run_scores(tiers, F.col("image") % 2).collect()
    assert (r.images, r.tp, r.fp, r.fn, r.precision, r.recall, r.named_accuracy, r.upgraded_share, r.extra) == (2, 4, 1, 4, 0.8, 0.5, 0.6, 0.5, 2)


def test_triplets_sisters_and_digests(spark):
    from hashlib import sha256

    items = spark.createDataFrame([(1, "a", 1, 1, "x", 1), (2, "a", 1, 2, "x", 1), (3, "a", 2, 3, "x", 1), (4, "b", 1, 4, "x", 1), (5, "c", 9, 5, "y", 2)], "id long, class string, session int, hash int, brand string, pack int")
    got = {r.anchor: (r.positive, r.negative) for r in records.triplets(items).collect()}
    assert got == {1: (3, 4), 2: (3, 4), 3: (1, 4)}  # b and c have one item each
    catalog = spark.createDataFrame([(1, "x", "v", "Save 10"), (2, "x", "v", None), (3, "x", "w", None)], "id long, brand string, base string, promo string")
    assert {r.id: r.sister for r in records.sisters(catalog, F.lit("SAVE-10")).collect()} == {1: 1, 2: 1, 3: 3}
    rows = spark.createDataFrame([("s", "b"), ("s", "a"), ("t", "ü"), ("s", None)], "split string, uri string").repartition(3)
    assert {r.split: (r.digest, r.n) for r in records.set_digests(rows, "split", "uri").collect()} == {"s": (sha256(b"a\nb").hexdigest(), 2), "t": (sha256("ü".encode()).hexdigest(), 1)}
    folders = spark.createDataFrame([("h", "soap"), ("h", "soap promo"), ("h", "soap promo xl"), ("k", "soap"), ("k", "soapy"), ("m", "one")], "h string, folder string")
    assert [tuple(r) for r in records.twin_unions(folders, " promo| xl").collect()] == [("h", "soap", 3)]


@pytest.mark.parametrize(("name", "most"), [("a12_three_tier_metrics", 2), ("a13_run_level_metrics", 3), ("g19_planogram", 2)])
def test_an_images_boxes_are_dealt_once(spark, name, most):
    """The two readings of the boxes are dealt by image; what comes after stays where it is."""
    plan = shelves.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= most


@pytest.mark.parametrize("name", ["a12_three_tier_metrics", "a13_run_level_metrics"])
def test_said_and_true_boxes_share_one_dealing_of_the_lines(spark, name):
    df = shelves.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_nearest_neighbours_need_no_copies_of_vectors(spark, monkeypatch):
    """Packs of 8 and tasks of 16 queries: no vector is exploded, and ties and the mask are as by brute force."""
    monkeypatch.setattr(vectors, "PACK", 8)
    monkeypatch.setattr(vectors, "ASKED", 16)
    draw = np.random.default_rng(3)
    points = draw.integers(-2, 3, (70, 3)).astype(float)  # many equal cosines, some zero vectors
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "query long, vector array<double>").repartition(3)
    near = vectors.top_k(frame, frame.withColumnRenamed("query", "key"), 4, most=0.82)
    assert "explode" not in near._jdf.queryExecution().optimizedPlan().toString().lower()
    length = np.linalg.norm(points, axis=1, keepdims=True)
    units = np.divide(points, length, out=np.zeros_like(points), where=length > 0)
    cos = np.round(units @ units.T, 6)
    want = {(i, j, float(cos[i, j]), n + 1) for i in range(70) for n, j in enumerate(sorted((j for j in range(70) if j != i and cos[i, j] <= 0.82), key=lambda j: (-cos[i, j], j))[:4])}
    assert {tuple(r) for r in near.select("query", "key", "cos", "place").collect()} == want
