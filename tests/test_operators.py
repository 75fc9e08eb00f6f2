import re
from decimal import Decimal
from pathlib import Path

import pytest

from basalt.operators import geometry, matching
from basalt.plans import catalog

SF = "/root/testdata/sf0.001"


def boxes(spark, rows):
    return spark.createDataFrame([(1, i, *map(float, b), s, "a") for i, (b, s) in enumerate(rows)], geometry.BOXES)


def test_nms_keeps_the_best_of_overlapping_boxes(spark):
    got = geometry.nms(boxes(spark, [((0, 0, 10, 10), 0.5), ((1, 0, 11, 10), 0.9), ((50, 0, 60, 10), 0.1)])).collect()
    assert sorted(r.id for r in got) == [1, 2]


def test_planks_of_two_rows(spark):
    got = geometry.planks(boxes(spark, [((40, 60, 60, 100), 1.0), ((0, 0, 20, 40), 1.0), ((0, 60, 20, 100), 1.0), ((40, 0, 60, 40), 1.0)])).collect()
    assert {(r.plank, r.slot): r.id for r in got} == {(0, 0): 1, (0, 1): 3, (1, 0): 2, (1, 1): 0}


def test_greedy_match_takes_a_box_once(spark):
    truth = boxes(spark, [((0, 0, 10, 10), 1.0)])
    predicted = boxes(spark, [((0, 0, 10, 9), 1.0), ((0, 0, 10, 10), 1.0)])
    assert [(r.p, r.t) for r in matching.match(predicted, truth).collect()] == [(1, 0)]
    [row] = matching.counts(predicted, truth).collect()
    assert (row.tp, row.fp, row.fn, row.recall) == (1, 1, 0, 1.0)


def test_no_boxes(spark):
    none = boxes(spark, []) if False else spark.createDataFrame([], geometry.BOXES)
    assert geometry.nms(none).count() == geometry.planks(none).count() == matching.match(none, none).count() == 0


def normal(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (int, float, Decimal)):
        return round(float(v), 9) + 0.0
    return str(v)


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
def test_queries_equal_their_sql(spark):
    """Every query that has SQL, at the smallest size; the order of rows and columns does not matter."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    from basalt.sources import tables

    for t in tables.NAMES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    known, wrong = catalog.queries(), []
    for name, text in catalog.oracle_sql().items():
        ours = known[name](spark, SF)
        columns = sorted(ours.columns)
        theirs = con.execute(text)
        places = [d[0] for d in theirs.description]
        if sorted(places) != columns:
            wrong.append((name, "columns"))
            continue
        mine = sorted(repr([normal(r[c]) for c in columns]) for r in ours.collect())
        if mine != sorted(repr([normal(r[places.index(c)]) for c in columns]) for r in theirs.fetchall()):
            wrong.append((name, "rows"))
    assert not wrong


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
def test_the_callers_views_stay(spark):
    spark.range(3).createOrReplaceTempView("part")
    names = ("a11_parent_share_in_category", "a9_share_of_shelf")
    frames = [catalog.queries()[n](spark, SF) for n in names]
    assert spark.table("part").count() == 3 and not spark.catalog.tableExists("lineitem")
    assert all(f.count() > 3 for f in frames[:1]) and frames[1].count() > 0
    spark.catalog.dropTempView("part")


def test_compare_populations(spark):
    import numpy as np

    from __spark_entry__ import queries
    from basalt.operators import vectors

    draw = np.random.default_rng(3)
    v = draw.standard_normal((60, 64)) * draw.uniform(0.1, 9, (60, 1))
    v[:, :3] = 1.0  # the first components say nothing
    v[59] = v[0]
    label = [i % 3 for i in range(60)]
    rows = [(i, x.tolist(), k) for i, (x, k) in enumerate(zip(v, label, strict=True))] + [(3, v[4].tolist(), 2), (99, None, 1), (98, v[5].tolist(), None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {(r.one, r.two): r for r in vectors.compare_populations(frame).collect()}
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    sides = [[(i, np.array(x)) for i, x, k in rows if k == c and x] for c in range(3)]
    assert set(got) == {(0, 1), (0, 2), (1, 2)}
    for (a, b), r in got.items():
        x, y = (unit(np.stack([w for _, w in sides[c]])) for c in (a, b))
        assert abs(r.cos - unit(x.mean(axis=0)) @ unit(y.mean(axis=0))) < 1e-6 and abs(r.max_cos - (x @ y.T).max()) < 1e-6 and r.n == len(x) + len(y)
        assert r.shared_ids == len({i for i, _ in sides[a]} & {i for i, _ in sides[b]})
        assert r.shared_vectors == len({w.tobytes() for _, w in sides[a]} & {w.tobytes() for _, w in sides[b]})
    assert sum(r.shared_vectors for r in got.values()) == 2 and vectors.compare_populations(frame.limit(0)).count() == 0
    assert queries()["v9_population_compare"] is vectors.QUERIES["v9_population_compare"]


@pytest.mark.parametrize("name", ["j10_inside_bay", "j11_inside_bay_two_rules", "g9_box_in_band"])
def test_boxes_meet_bays_of_their_image_alone(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["j10_inside_bay", "j11_inside_bay_two_rules"])
def test_boxes_are_dealt_once_and_without_images_that_have_no_bay(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange ") == 2  # lines, bays
    assert re.search(r"\(l_orderkey#\d+L % 2\) = 0", plan)  # bays are of even images, and so are the lines that are dealt
