"""Queries of scores, joins, boxes and gates; see ``shelf_sql`` for the stand-ins.

``{seq}`` stands for the numbers 0 to 9,999 and ``{h}``...``{/h}`` for the first eight hex digits of an MD5 as a number.
"""

from __future__ import annotations

import re

from .shelf_sql import _FACING, portable

#: Boxes: an order is an image, its lines (numbered as ordered) are boxes on two shelves; bays are of even orders.
_BOXES = """
box AS (SELECT l_orderkey AS image, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS BIGINT) AS id, l_partkey AS sku, l_linenumber * 30.0D AS x1, CASE WHEN l_linenumber % 2 = 0 THEN 0.0D ELSE 60.0D END AS y1,
  l_linenumber * 30.0D + 20.0D + l_quantity % 25 AS x2, CASE WHEN l_linenumber % 2 = 0 THEN 40.0D ELSE 100.0D END + l_quantity % 7 AS y2 FROM lineitem),
bay AS (SELECT o_orderkey AS image, 20.0D AS x1, 0.0D AS y1, 60.0D + o_custkey % 90 AS x2, 50.0D AS y2 FROM orders WHERE o_orderkey % 2 = 0)
"""
_INTER = "greatest(0.0D, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0D, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_AREA = "(({t}.x2 - {t}.x1) * ({t}.y2 - {t}.y1))"
_A, _B = _AREA.format(t="a"), _AREA.format(t="b")
_CENTRE = "(a.x1 + a.x2) / 2.0D BETWEEN b.x1 AND b.x2 AND (a.y1 + a.y2) / 2.0D BETWEEN b.y1 AND b.y2"
_SCORES = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0D END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0D END AS r"
_SILO = "silo AS (SELECT md5(text) AS h, doc_id, lang, source, CASE WHEN source <= 'src12' THEN 1 WHEN source <= 'src3' THEN 2 ELSE 3 END AS silo FROM documents WHERE text IS NOT NULL)"
_OUTCOME = "count(*) AS n, CAST(sum(CASE WHEN pred = sku THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN pred IS NOT NULL AND pred <> sku THEN 1 ELSE 0 END) AS DOUBLE) AS fp, CAST(sum(CASE WHEN pred IS NULL OR pred <> sku THEN 1 ELSE 0 END) AS DOUBLE) AS fn"

_TEXTS: dict[str, str] = {
    # scores of runs
    "a16_bootstrap_interval": f"WITH {_FACING}, v AS (SELECT brand, avg(CASE WHEN pred = sku THEN 1.0D ELSE 0.0D END) AS x FROM named GROUP BY brand), i AS (SELECT x, row_number() OVER (ORDER BY brand) - 1 AS i, count(*) OVER () AS n FROM v), draws AS (SELECT s.id AS boot, {{h}}concat('42:', CAST(s.id AS VARCHAR(20)), ':', CAST(i.i AS VARCHAR(20))){{/h}} % i.n AS pick FROM ({{seq}}) s CROSS JOIN i WHERE s.id < 500), m AS (SELECT boot, avg(i.x) AS mean FROM draws JOIN i ON pick = i.i GROUP BY boot), o AS (SELECT mean, row_number() OVER (ORDER BY mean, boot) - 1 AS place FROM m) SELECT round(max(CASE WHEN place = 12 THEN mean END), 6) AS lo, round(max(CASE WHEN place = 487 THEN mean END), 6) AS hi FROM o",
    "a29_run_costs": "SELECT user_id % 10 AS run, round(sum(value) * 0.000024D, 6) AS compute, round(count(*) * 0.02D / 1024.0D, 6) AS storage, round(count(*) * 0.001D, 6) AS extra FROM events GROUP BY user_id % 10",
    "a30_usage_sum": "SELECT user_id % 10 AS run, event_type AS bucket, count(*) AS calls, round(sum(value), 4) AS tokens FROM events GROUP BY user_id % 10, event_type",
    "a31_usage_normal_form": "SELECT event_id, round(greatest(value - least(value, 20.0D), 0.0D), 6) AS fresh, least(value, 20.0D) AS cached, CASE WHEN event_type IN ('click', 'view') THEN 'image' ELSE 'text' END AS modality FROM events",
    "a32_cost_estimate": "WITH p AS (SELECT * FROM (VALUES ('1-URGENT', 1.8D), ('2-HIGH', 1.0D), ('3-MEDIUM', 1.0D), ('4-NOT SPECIFIED', 0.5D), ('5-LOW', 0.5D)) AS v(tier, rate)) SELECT o_orderpriority, round(count(*) * 0.000459D * max(rate), 6) AS usd FROM orders JOIN p ON o_orderpriority = tier GROUP BY o_orderpriority",
    "a35_majority_vote": "WITH v AS (SELECT p_brand, p_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY p_brand) AS total, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS place FROM part GROUP BY p_brand, p_type) SELECT p_brand, CASE WHEN n >= 0.65D * total THEN p_type END AS winner, n FROM v WHERE place = 1",
    "a39_low_similarity_rate": "SELECT l_returnflag, round(avg(CASE WHEN 0.5D + 4.0D * l_discount < 0.52D THEN 1.0D ELSE 0.0D END), 6) AS low FROM lineitem GROUP BY l_returnflag",
    "a47_hash_in_classes": f"WITH {_SILO} SELECT h, count(DISTINCT lang) AS classes, min(doc_id) AS first_id FROM silo GROUP BY h HAVING count(DISTINCT lang) > 1 OR count(DISTINCT source) > 1",
    # joins
    "j8_best_container": f"WITH {_BOXES}, r AS (SELECT a.image, a.id, b.id AS asset, {_INTER} / {_A} AS ratio FROM box a JOIN box b ON a.image = b.image AND a.id <> b.id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2), o AS (SELECT *, row_number() OVER (PARTITION BY image, id ORDER BY round(ratio, 9) DESC, asset) AS place FROM r) SELECT image, id, asset, round(ratio, 6) AS ratio, round(ratio, 9) >= 0.70D AS inside FROM o WHERE place = 1",
    "j10_inside_bay": f"WITH {_BOXES} SELECT image, id FROM box a WHERE EXISTS (SELECT 1 FROM bay b WHERE a.image = b.image AND ({_CENTRE} OR {_INTER} >= 0.45D * {_A} OR (a.y2 BETWEEN b.y1 AND b.y2 AND {_INTER} >= 0.25D * {_A})))",
    "j11_inside_bay_two_rules": f"WITH {_BOXES} SELECT image, id FROM box a WHERE EXISTS (SELECT 1 FROM bay b WHERE a.image = b.image AND ({_CENTRE} OR {_INTER} >= 0.5D * {_A}))",
    "j12_inside_bay_by_area": f"WITH {_BOXES} SELECT image, id FROM box a WHERE EXISTS (SELECT 1 FROM bay b WHERE a.image = b.image AND {_INTER} >= 0.5D * {_A})",
    "j13_bay_scope_or_all": f"WITH {_BOXES} SELECT a.image, a.id FROM box a LEFT JOIN bay b ON a.image = b.image WHERE b.image IS NULL OR {_INTER} >= 0.5D * {_A}",
    "j18_parent_resolution": "WITH reg AS (SELECT * FROM (VALUES ('brand#1', 'One'), ('brand#2', 'Two'), ('brand#13', 'Thirteen')) AS v(name, parent)), r AS (SELECT p_partkey, parent, row_number() OVER (PARTITION BY p_partkey ORDER BY length(name) DESC, name) AS place FROM part JOIN reg ON lower(p_brand) LIKE concat(name, '%')) SELECT p.p_partkey, coalesce(r.parent, 'Independent') AS parent FROM part p LEFT JOIN r ON p.p_partkey = r.p_partkey AND r.place = 1",
    "j25_template_match": "WITH codes AS (SELECT * FROM (VALUES ('bolt'), ('old bolt'), ('widget'), ('gear')) AS v(code)), r AS (SELECT p_partkey, code, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN p_name = code THEN 0 ELSE 1 END, length(code) DESC, code) AS place FROM part JOIN codes ON p_name LIKE concat('%', code, '%')) SELECT p_partkey, code FROM r WHERE place = 1",
    # geometry
    "g1_iou": f"WITH {_BOXES}, i AS (SELECT a.image, a.id AS one, b.id AS two, {_INTER} AS inter, {_A} + {_B} AS total FROM box a JOIN box b ON a.image = b.image AND a.id < b.id) SELECT image, one, two, round(CASE WHEN total - inter > 0 THEN inter / (total - inter) ELSE 0.0D END, 6) AS iou FROM i",
    "g3_containment_of_smaller": f"WITH {_BOXES} SELECT a.image, a.id AS one, b.id AS two, round({_INTER} / greatest(least({_A}, {_B}), 1.0D), 6) AS containment FROM box a JOIN box b ON a.image = b.image AND a.id < b.id",
    "g9_box_in_band": f"WITH {_BOXES} SELECT image, id FROM box a WHERE NOT EXISTS (SELECT 1 FROM bay b WHERE a.image = b.image) OR EXISTS (SELECT 1 FROM bay b WHERE a.image = b.image AND ((a.y1 + a.y2) / 2.0D BETWEEN b.y1 AND b.y2 OR greatest(0.0D, least(a.y2, b.y2) - greatest(a.y1, b.y1)) >= 0.5D * (a.y2 - a.y1)))",
    "g16_pixel_boxes": f"WITH {_BOXES} SELECT image, id, CAST(round(x1 / 400.0D * 1280.0D) AS BIGINT) AS px1, CAST(round(x2 / 400.0D * 1280.0D) AS BIGINT) AS px2, CAST(round(y1 / 110.0D * 720.0D) AS BIGINT) AS py1, CAST(round(y2 / 110.0D * 720.0D) AS BIGINT) AS py2 FROM box",
    "g17_padded_crops": f"WITH {_BOXES} SELECT image, id, greatest(0.0D, round(x1 - 0.05D * (x2 - x1), 4)) AS cx1, least(400.0D, round(x2 + 0.05D * (x2 - x1), 4)) AS cx2, greatest(0.0D, round(y1 - 0.05D * (y2 - y1), 4)) AS cy1, least(110.0D, round(y2 + 0.05D * (y2 - y1), 4)) AS cy2 FROM box",
    # gates
    "q7_box_bounds": f"WITH {_BOXES}, c AS (SELECT image, count(*) AS n, max(id) AS last FROM box GROUP BY image) SELECT box.image, id FROM box JOIN c ON box.image = c.image WHERE x1 < 0 OR y1 < 0 OR x2 > 250.0D OR x2 <= x1 OR y2 <= y1 OR n <> last",
    "q12_class_counts": "SELECT p_size % 3 AS split, count(*) AS n, count(*) >= 500 AS pass FROM part GROUP BY p_size % 3",
    "q15_failed_runs": "SELECT user_id % 20 AS run, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, min(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 1 AS all_failed FROM events GROUP BY user_id % 20 HAVING sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) > 0",
}


def _spark(s: str) -> str:
    # BETWEEN names its operand once: in a correlated subquery Spark then joins all distinct boxes with all bays before the image
    s = re.sub(r"(\(a\.\w+ \+ a\.\w+\) / 2\.0D|a\.y2) BETWEEN (b\.\w+) AND (b\.\w+)", r"(\1 >= \2 AND \1 <= \3)", s)
    # a semi join, which EXISTS becomes after that, passes the bays' images on to the scan of the boxes
    s = re.sub(r"WHERE EXISTS \(SELECT 1 FROM bay b WHERE (.*)\)$", r"LEFT SEMI JOIN bay b ON \1", s)
    # lines are dealt as they were read and become boxes after: narrower rows, and a join by image finds them dealt
    s = re.sub(r"CAST\((row_number\(\) OVER \([^)]*\)) AS BIGINT\) AS id(.*?)FROM lineitem", r"CAST(place AS BIGINT) AS id\2FROM (SELECT *, \1 AS place FROM lineitem)", s, flags=re.DOTALL)
    return re.sub(r"\{h\}(.*?)\{/h\}", r"CAST(conv(substr(md5(\1), 1, 8), 16, 10) AS BIGINT)", s).replace("{seq}", "SELECT id FROM range(0, 10000)")


def _duck(s: str) -> str:
    return portable(re.sub(r"\{h\}(.*?)\{/h\}", r"CAST('0x' || substr(md5(\1), 1, 8) AS BIGINT)", s).replace("{seq}", "SELECT range AS id FROM range(0, 10000)"))


QUERIES = {k: (_spark(s), _duck(s)) for k, s in _TEXTS.items()}
