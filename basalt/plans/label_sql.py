"""Queries of the text functions and predicates over the stand-in tables; see ``shelf_sql`` for the stand-ins."""

from __future__ import annotations

from basalt.functions import texts as t

from .shelf_sql import _FACING, portable

ALIASES = {"brand#13": "Brand Thirteen", "brand#5": "Brand Five"}


def _columns(named: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in named.items())


def texts(d: t.Dialect) -> dict[str, str]:
    crop = "concat('S', CAST(l_orderkey AS VARCHAR(20)), CASE WHEN l_linenumber % 3 = 0 THEN '-copy' ELSE '' END, '_crop', CAST(l_linenumber AS VARCHAR(20)), '_', CAST(l_linenumber * 30 AS VARCHAR(20)), '_0_', CAST(l_linenumber * 30 + 20 AS VARCHAR(20)), CASE WHEN l_linenumber = 7 THEN '' ELSE '_40' END, '.jpg')"
    shelf = "concat(CAST(o_custkey AS VARCHAR(20)), CASE WHEN o_orderkey % 9 = 0 THEN '-' ELSE '_' END, 'bay_', replace(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)), '-', ''), '_', CAST(1700000000000 + o_orderkey AS VARCHAR(20)), '.jpg')"
    label = "concat(p_brand, '|', p_name, '|', CAST(p_size AS VARCHAR(20)), CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '|pouch' END, '|', p_type)"
    folder = "concat(CASE WHEN p_partkey % 4 = 0 THEN 'Z_' ELSE '' END, CASE WHEN p_partkey % 11 = 0 THEN 'misc' ELSE p_brand END)"
    variant = "concat(p_name, CASE WHEN p_size % 2 = 0 THEN ' promo' ELSE '' END, CASE WHEN p_size % 3 = 0 THEN '_rs20' ELSE '' END, CASE WHEN p_size % 5 = 0 THEN ' art2' ELSE '' END)"
    size = "concat(p_name, ' ', CAST(p_size AS VARCHAR(20)), CASE p_partkey % 4 WHEN 0 THEN 'kg' WHEN 1 THEN ' gms' WHEN 2 THEN 'ml' ELSE ' pcs' END)"
    pack = "concat(p_name, ' ', CASE p_partkey % 5 WHEN 0 THEN 'Bottles' WHEN 1 THEN 'sachet' WHEN 2 THEN 'JAR' WHEN 3 THEN 'pouches' ELSE '(box)' END)"
    swapped = "concat(substr(p_name, 2, 1), substr(p_name, 1, 1), substr(p_name, 3))"
    matches = f"WITH {_FACING}, m AS (SELECT image, slot, pred, coalesce({t.canonical_brand('brand', d)} = {t.canonical_brand('pred_brand', d)}, false) AS brand_ok, coalesce(category = pred_category, false) AS category_ok, coalesce({t.tokens('CAST(psize AS VARCHAR(20))', d)} = {t.tokens('CAST(pred_size AS VARCHAR(20))', d)}, false) AS variant_ok FROM named)"
    return {
        "t1_brand_folder": f"SELECT p_partkey, {t.brand_folder(folder, ALIASES, d=d)} AS brand FROM part",
        "t2_canonical_brand": f"SELECT {t.canonical_brand('p_brand', d)} AS brand_key, count(*) AS n FROM part GROUP BY {t.canonical_brand('p_brand', d)}",
        "t3_variant_folder": f"WITH v AS (SELECT p_partkey, p_type, {variant} AS folder FROM part) SELECT p_partkey, {t.stripped_suffix('folder', d)} AS base, {d.has('folder', ' promo')} AS promo, {t.extract('folder', '_rs([0-9]+)')} AS price, {t.extract('folder', ' art([0-9]+)$')} AS artwork, {d.has('folder', '^(other|all) ')} AS catch_all, lower(p_type) AS category FROM v",
        "t4_shape_label": f"WITH l AS (SELECT p_partkey, {label} AS label FROM part) SELECT p_partkey, {_columns(t.class_label('label'))} FROM l",
        "t5_bay_brand": "SELECT p_partkey, " + t.ladder([("lower(p_name) LIKE '%widget%'", "'one'"), ("lower(p_name) LIKE '%bolt%'", "'two'"), ("lower(p_name) LIKE 'small%'", "'three'")], "'none'") + " AS bay_brand FROM part",
        "t6_pack_file_brand": f"WITH f AS (SELECT p_partkey, concat(p_brand, '-', p_name, '_pack', CAST(p_size AS VARCHAR(20))) AS f FROM part) SELECT p_partkey, {t.extract('f', '^([A-Za-z#0-9]+)-', 1)} AS brand, {t.extract('f', '-([a-z ]+)_pack', 1)} AS variant FROM f",
        "t7_crop_file_name": f"WITH f AS (SELECT {crop} AS f FROM lineitem) SELECT {_columns(t.crop_name('f'))} FROM f",
        "t8_shelf_file_name": f"WITH f AS (SELECT o_orderkey, {shelf} AS f FROM orders) SELECT o_orderkey, {_columns(t.shelf_name('f'))} FROM f",
        "t9_outlet_code": f"WITH f AS (SELECT o_orderkey, concat('visit-', CAST(o_custkey * 977 AS VARCHAR(20)), '-', CAST(o_orderkey AS VARCHAR(20))) AS f FROM orders) SELECT o_orderkey, {t.outlet_code('f')} AS outlet FROM f",
        "t12_category_normalise": "SELECT p_partkey, CASE lower(trim(p_type)) WHEN 'economy' THEN 'Home' WHEN 'promo' THEN 'Beauty' ELSE 'Foods' END AS category FROM part",
        "t13_default_category": "WITH n AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS place FROM n) SELECT p_brand, p_type AS category FROM r WHERE place = 1",
        "t14_near_spelling": f"WITH s AS (SELECT p_partkey, p_name AS a, CASE p_partkey % 3 WHEN 0 THEN {swapped} WHEN 1 THEN concat(p_name, 's') ELSE concat(p_name, 'xx') END AS b FROM part) SELECT p_partkey, {t.near_spelling('a', 'b', d=d)} AS near FROM s",
        "t15_packaging": f"WITH s AS (SELECT p_partkey, {pack} AS s FROM part) SELECT p_partkey, {t.packaging('s', d)} AS packaging FROM s",
        "t16_pack_folder": f"WITH s AS (SELECT p_partkey, concat(p_brand, '__', {pack}) AS s FROM part) SELECT p_partkey, split_part(s, '__', 1) AS brand, split_part(s, '__', 2) AS rest, {t.packaging('s', d)} AS packaging FROM s",
        "t17_valid_category_pack": f"WITH s AS (SELECT p_partkey, p_type, {t.packaging(pack, d)} AS kind FROM part), n AS (SELECT p_type, kind, count(*) AS n FROM s GROUP BY p_type, kind), best AS (SELECT p_type, kind, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, kind) AS place FROM n WHERE kind <> 'other') SELECT p_partkey, CASE WHEN s.kind <> 'other' THEN s.kind ELSE best.kind END AS kind FROM s LEFT JOIN best ON s.p_type = best.p_type AND best.place = 1",
        "t18_suffix_strip": f"WITH v AS (SELECT p_partkey, {variant} AS v FROM part) SELECT p_partkey, {t.stripped_suffix('v', d)} AS v FROM v",
        "t19_variant_token_match": f"WITH v AS (SELECT p_partkey, {d.words(t.tokens('p_name', d))} AS a, {d.words(t.tokens(variant, d))} AS b FROM part) SELECT p_partkey, a = b AS same, CAST({d.common('a', 'b')} AS BIGINT) AS common FROM v",
        "t20_brand_match": f"{matches} SELECT image, CAST(sum(CASE WHEN brand_ok THEN 1 ELSE 0 END) AS BIGINT) AS matched, count(*) AS n FROM m GROUP BY image",
        "t21_field_match": f"{matches} SELECT brand_ok, category_ok, variant_ok, count(*) AS n FROM m GROUP BY brand_ok, category_ok, variant_ok",
        "t22_product_match": f"{matches} SELECT CASE WHEN pred IS NULL THEN 'fn' WHEN brand_ok AND category_ok AND variant_ok THEN 'tp' ELSE 'fp_fn' END AS outcome, count(*) AS n FROM m GROUP BY CASE WHEN pred IS NULL THEN 'fn' WHEN brand_ok AND category_ok AND variant_ok THEN 'tp' ELSE 'fp_fn' END",
        "t23_owner_resolution": "WITH s AS (SELECT p_partkey, p_brand, CASE p_partkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'FALSE' WHEN 2 THEN 'competitor' END AS said FROM part) SELECT p_partkey, coalesce(CASE WHEN lower(said) IN ('yes', 'true', 'owner') THEN true WHEN lower(said) IN ('no', 'false', 'competitor') THEN false END, p_brand LIKE '%1') AS owner FROM s",
        "t25_size_normal_form": f"WITH s AS (SELECT p_partkey, {size} AS s FROM part) SELECT p_partkey, {t.size_token('s', d)} AS token FROM s",
        "t26_sub_category_lookup": "WITH m AS (SELECT * FROM (VALUES ('ECONOMY', 'basic'), ('PROMO', 'deal')) AS v(kind, sub)) SELECT p_partkey, coalesce(sub, 'general') AS sub FROM part LEFT JOIN m ON p_type = kind",
        "t27_json_status": f"WITH s AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN substr(props, 1, 5) ELSE props END AS s FROM events) SELECT event_id, CASE WHEN {d.has('s', '^[{].*[}]$')} THEN 'ok' ELSE 'truncated' END AS status, CAST({t.extract('s', '\"k\": ([0-9]+)')} AS BIGINT) AS k FROM s",
        "t28_untrusted_fence": f"SELECT doc_id, {d.sha256(t.fenced('text', d))} AS fenced FROM documents WHERE text IS NOT NULL",
        "t32_tier_maps": "SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 'large' WHEN o_totalprice >= 50000 THEN 'medium' ELSE 'small' END AS tier, CASE WHEN CAST(o_orderdate AS DATE) < DATE '1996-01-01' THEN 0.5D ELSE 0.0D END AS credit FROM orders",
        "t33_sku_description": "SELECT p_partkey, concat(p_brand, ' ', upper(substr(p_name, 1, 1)), substr(p_name, 2), ', ', CAST(p_size AS VARCHAR(20)), ' g (', lower(p_type), ')') AS description FROM part",
        "t34_legacy_mapping": "WITH m AS (SELECT p_brand, p_type, min(p_partkey) AS legacy FROM part GROUP BY p_brand, p_type) SELECT p.p_partkey, m.legacy, CAST(count(*) OVER (PARTITION BY m.legacy) AS BIGINT) AS members FROM part p JOIN m ON p.p_brand = m.p_brand AND p.p_type = m.p_type",
        "t35_legacy_merge": f"WITH {_FACING} SELECT image, slot, sku, coalesce(pred, CASE WHEN slot % 2 = 0 THEN sku END, -1) AS answer, CASE WHEN pred IS NOT NULL THEN 'new' WHEN slot % 2 = 0 THEN 'legacy' ELSE 'none' END AS origin FROM facing",
        "t36_legacy_dual_accept": f"WITH {_FACING}, m AS (SELECT p_brand, p_type, min(p_partkey) AS legacy FROM part GROUP BY p_brand, p_type), k AS (SELECT p_partkey, legacy FROM part p JOIN m ON p.p_brand = m.p_brand AND p.p_type = m.p_type) SELECT category, CAST(sum(CASE WHEN pred = sku THEN 1 ELSE 0 END) AS BIGINT) AS exact_n, CAST(sum(CASE WHEN pred = sku OR a.legacy = b.legacy THEN 1 ELSE 0 END) AS BIGINT) AS dual_n FROM named LEFT JOIN k a ON sku = a.p_partkey LEFT JOIN k b ON pred = b.p_partkey GROUP BY category",
        "t37_class_label_route": f"WITH l AS (SELECT p_partkey, {label} AS label FROM part), c AS (SELECT p_partkey, {_columns(t.class_label('label'))} FROM l) SELECT coalesce(CASE WHEN valid AND brand LIKE '%1' THEN 'owner' WHEN valid THEN 'competitor' END, 'invalid') AS role, count(*) AS n FROM c GROUP BY coalesce(CASE WHEN valid AND brand LIKE '%1' THEN 'owner' WHEN valid THEN 'competitor' END, 'invalid')",
        "t39_variant_snap": f"WITH v AS (SELECT p_partkey, p_brand, {t.tokens(t.stripped_suffix(variant, d), d)} AS v FROM part), c AS (SELECT p_brand, {t.tokens('p_name', d)} AS v, min(p_partkey) AS snap FROM part GROUP BY p_brand, {t.tokens('p_name', d)}) SELECT v.p_partkey, c.snap FROM v LEFT JOIN c ON v.p_brand = c.p_brand AND v.v = c.v",
        "t40_template_file_name": f"WITH f AS (SELECT s_suppkey, concat('plan_', s_name, '_v', CAST(s_suppkey % 5 AS VARCHAR(20)), '.xlsx') AS f FROM supplier) SELECT s_suppkey, {t.extract('f', '^plan_(.*)_v[0-9]+[.]', 1)} AS code, CAST({t.extract('f', '_v([0-9]+)[.]', 1)} AS BIGINT) AS version, split_part(f, '.', 2) AS kind FROM f",
        "t42_currency": "SELECT o_orderkey, round(o_totalprice / 83.5D, 4) AS usd FROM orders",
        # predicates
        "p1_flat_row": "SELECT p_partkey AS id, coalesce(nullif(trim(p_brand), ''), 'Unbranded') AS brand, coalesce(CAST(p_size AS DOUBLE), 0.0D) AS size_g, coalesce(p_type, 'Uncategorized') AS category FROM part",
        "p2_copy_names": f"WITH f AS (SELECT l_orderkey, l_linenumber, {crop} AS f FROM lineitem) SELECT l_orderkey, l_linenumber FROM f WHERE NOT {d.has('f', '-copy|_aug[0-9]*')}",
        "p16_clamped_confidence": "SELECT event_id, greatest(0.0D, least(1.0D, value / 100.0D)) AS confidence FROM events",
    }


_duck = texts(t.DUCK)
QUERIES = {k: (s, portable(_duck[k])) for k, s in texts(t.SPARK).items()}
