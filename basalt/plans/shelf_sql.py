"""SQL of the analytics operators over the stand-in tables: name -> (Spark's text, DuckDB's text or None if equal).

Stand-ins: part is the catalog, a line item a facing (order: image, line number: slot, quantity: occurrences, extended price:
area), customer an outlet, event a run's row. An owner's facing has a part key divisible by 3; a prediction is the true key, or
one higher where key + slot is divisible by 5, or none where it is divisible by 11.
"""

from __future__ import annotations

import re


def portable(text: str) -> str:
    """DuckDB reads 1.0 as a decimal, and has no D suffix."""
    return re.sub(r"\b(\d+\.\d+)D\b", r"CAST(\1 AS DOUBLE)", text)


_FACING = """
facing AS (SELECT l_orderkey AS image, l_linenumber AS slot, l_partkey AS sku, l_quantity AS occ, CAST(l_extendedprice AS DOUBLE) AS area, l_shipdate AS seen,
  CASE WHEN (l_partkey + l_linenumber) % 11 = 0 THEN NULL WHEN (l_partkey + l_linenumber) % 5 = 0 THEN l_partkey + 1 ELSE l_partkey END AS pred FROM lineitem),
named AS (SELECT f.*, p.p_brand AS brand, p.p_type AS category, p.p_size AS psize, q.p_brand AS pred_brand, q.p_type AS pred_category, q.p_size AS pred_size
  FROM facing f JOIN part p ON f.sku = p.p_partkey LEFT JOIN part q ON f.pred = q.p_partkey)
"""

QUERIES: dict[str, tuple[str, str | None]] = {
    # aggregations
    "a3_nearest_rank_percentile": ("""
SELECT event_type, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, percentile_disc(0.99) WITHIN GROUP (ORDER BY value) AS p99 FROM events GROUP BY event_type""", None),
    "a4_field_accuracy": (f"""
WITH {_FACING} SELECT count(*) AS n, round(avg(CASE WHEN pred_brand = brand THEN 1.0D ELSE 0.0D END), 6) AS brand_acc, round(avg(CASE WHEN pred_category = category THEN 1.0D ELSE 0.0D END), 6) AS category_acc,
 round(avg(CASE WHEN pred_brand = brand AND pred_category = category AND pred_size = psize THEN 1.0D ELSE 0.0D END), 6) AS joint_acc FROM named""", None),
    "a5_hierarchy_tree_score": (f"""
WITH {_FACING}, l AS (SELECT category, CASE WHEN pred % 3 = 0 AND sku % 3 = 0 OR pred % 3 <> 0 AND sku % 3 <> 0 THEN 1 ELSE 0 END AS l1, CASE WHEN pred_category = category THEN 1 ELSE 0 END AS l2, CASE WHEN pred_brand = brand THEN 1 ELSE 0 END AS l3,
 CASE WHEN pred_size = psize THEN 1 ELSE 0 END AS l4, CASE WHEN pred = sku THEN 1 ELSE 0 END AS l5 FROM named)
SELECT category, count(*) AS n, round(avg(CAST(l1 AS DOUBLE)), 6) AS owner_acc, round(avg(CAST(l1 * l2 * l3 AS DOUBLE)), 6) AS compound3, round(avg(CAST(l1 * l2 * l3 * l4 * l5 AS DOUBLE)), 6) AS all5,
 round(avg(0.15D * l1 + 0.20D * l1 * l2 + 0.30D * l1 * l2 * l3 + 0.25D * l1 * l2 * l3 * l4 + 0.10D * l1 * l2 * l3 * l4 * l5), 6) AS tree FROM l GROUP BY category""", None),
    "a6_macro_accuracy": (f"""
WITH {_FACING}, b AS (SELECT brand, avg(CASE WHEN pred = sku THEN 1.0D ELSE 0.0D END) AS acc FROM named GROUP BY brand), v AS (SELECT brand, psize, avg(CASE WHEN pred = sku THEN 1.0D ELSE 0.0D END) AS acc FROM named GROUP BY brand, psize)
SELECT (SELECT round(avg(acc), 6) FROM b) AS macro_brand, (SELECT round(avg(acc), 6) FROM v) AS macro_variant""", None),
    "a7_owner_breakdown": (f"""
WITH {_FACING} SELECT sku % 3 = 0 AS owner, count(*) AS n, round(avg(CASE WHEN pred = sku THEN 1.0D ELSE 0.0D END), 6) AS acc, round(avg(CASE WHEN sku % 3 <> 0 AND pred % 3 = 0 THEN 1.0D ELSE 0.0D END), 6) AS false_owner FROM named GROUP BY sku % 3 = 0""", None),
    "a8_category_breakdown": (f"""
WITH {_FACING} SELECT category, count(*) AS n, count(DISTINCT sku) AS skus, round(avg(CASE WHEN pred = sku THEN 1.0D ELSE 0.0D END), 6) AS acc FROM named GROUP BY category""", None),
    "a9_share_of_shelf": (f"""
WITH {_FACING}, s AS (SELECT category, sum(CASE WHEN sku % 3 = 0 THEN 1.0D ELSE 0.0D END) / count(*) AS truth, sum(CASE WHEN pred % 3 = 0 THEN 1.0D ELSE 0.0D END) / count(*) AS predicted, sum(CASE WHEN sku % 3 = 0 THEN area ELSE 0.0D END) / sum(area) AS area_share,
 sum(CASE WHEN pred IS NULL THEN 1.0D ELSE 0.0D END) / count(*) AS abstained FROM named GROUP BY category)
SELECT category, round(truth, 6) AS truth, round(predicted, 6) AS predicted, round(abs(truth - predicted), 6) AS error, round(area_share, 6) AS area_share, round(abstained, 6) AS abstained FROM s""", None),
    "a11_parent_share_in_category": ("""
SELECT p_type, p_brand, count(*) AS n, round(100.0D * CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY p_type) AS DOUBLE), 2) AS pct FROM part GROUP BY p_type, p_brand""", None),
    "a33_shared_hash_folder_pairs": ("""
WITH h AS (SELECT DISTINCT md5(text) AS h, source FROM documents) SELECT a.source AS one, b.source AS two, count(*) AS n FROM h a JOIN h b ON a.h = b.h AND a.source < b.source GROUP BY a.source, b.source""", None),
    "a44_sole_variant_promotion": (f"""
WITH {_FACING}, w AS (SELECT image, slot, brand, CASE WHEN psize % 2 = 0 THEN psize END AS variant FROM named), m AS (SELECT *, min(variant) OVER (PARTITION BY image, brand) AS lo, max(variant) OVER (PARTITION BY image, brand) AS hi FROM w)
SELECT image, slot, brand, CASE WHEN variant IS NULL AND lo = hi THEN lo ELSE variant END AS variant FROM m""", None),
    "a46_cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    # joins
    "j14_share_rollup": ("""
WITH d AS (SELECT DISTINCT p_brand AS brand, CASE WHEN p_brand LIKE '%1' THEN 'parent one' END AS parent FROM part)
SELECT coalesce(parent, 'Other') AS parent, count(*) AS n FROM part LEFT JOIN d ON lower(p_brand) = lower(brand) GROUP BY coalesce(parent, 'Other')""", None),
    "j21_heldout_anti_join": ("SELECT d.doc_id FROM documents d LEFT ANTI JOIN benchmark b ON md5(d.text) = md5(b.text)", "SELECT d.doc_id FROM documents d ANTI JOIN benchmark b ON md5(d.text) = md5(b.text)"),
    "j23_combinations": ("SELECT r_name, n_name, mode FROM region JOIN nation ON n_regionkey = r_regionkey CROSS JOIN (SELECT 'batch' AS mode UNION ALL SELECT 'online') m WHERE NOT (mode = 'online' AND r_name = 'ASIA')", None),
    # windows
    "w8_relative_height": ("SELECT l_orderkey AS image, l_linenumber AS slot, round(l_quantity / avg(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS rel FROM lineitem", None),
    "w11_newest_per_group": ("WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey) AS place FROM orders) SELECT o_custkey, o_orderkey, o_orderdate FROM r WHERE place = 1", None),
    # top-k and sets
    "k8_set_operations": ("SELECT 'both' AS kind, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') a UNION ALL SELECT 'only' AS kind, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') b", None),
    "k10_dedup_keep_first": ("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) AS place FROM documents) SELECT doc_id, source FROM r WHERE place = 1", None),
    # filters
    # scalar functions
    "t10_session_parts": ("SELECT p_partkey, split_part(p_name, ' ', 1) AS head, lower(p_brand) AS brand FROM part", None),
    "t11_variant_tokens": ("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', ' '), ' +', ' ') AS tokens FROM part", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g') AS tokens FROM part"),
    "t24_pack_size_token": ("SELECT p_partkey, CASE WHEN p_size <= 10 THEN concat(CAST(p_size * 1000 AS STRING), 'g') ELSE concat(CAST(p_size AS STRING), 'g') END AS token FROM part", None),
    "t29_content_key": ("SELECT event_id, sha2(concat_ws('|', CAST(user_id AS STRING), event_type, props), 256) AS cache_key FROM events", "SELECT event_id, sha256(concat_ws('|', CAST(user_id AS STRING), event_type, props)) AS cache_key FROM events"),
    "t31_hash_bucket_split": (
        "WITH b AS (SELECT o_orderkey, CAST(conv(substr(sha1(concat('42:', CAST(o_orderkey AS STRING))), 1, 8), 16, 10) AS BIGINT) % 100 AS bucket FROM orders) SELECT o_orderkey, CAST(bucket AS BIGINT) AS bucket, CASE WHEN bucket < 80 THEN 'train' WHEN bucket < 90 THEN 'val' ELSE 'test' END AS split FROM b",
        "WITH b AS (SELECT o_orderkey, CAST('0x' || substr(sha1(concat('42:', CAST(o_orderkey AS STRING))), 1, 8) AS BIGINT) % 100 AS bucket FROM orders) SELECT o_orderkey, CAST(bucket AS BIGINT) AS bucket, CASE WHEN bucket < 80 THEN 'train' WHEN bucket < 90 THEN 'val' ELSE 'test' END AS split FROM b"),
    # association
    # gates
    "q3_class_key_collision": ("SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY p_brand, p_type, p_size HAVING count(*) > 1", None),
    "q4_shelf_diversity": ("WITH s AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_partkey) AS skus FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 4) SELECT round(avg(CASE WHEN skus > 1 THEN 1.0D ELSE 0.0D END), 6) AS diverse, avg(CASE WHEN skus > 1 THEN 1.0D ELSE 0.0D END) >= 0.7D AS pass FROM s", None),
    "q6_box_sizes": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 3 OR l_quantity > 49", None),
}
QUERIES = {k: (s, d if d is not None else portable(s)) for k, (s, d) in QUERIES.items()}
