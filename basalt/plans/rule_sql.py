"""SQL of rules with several steps over the stand-in tables of ``shelf_sql``: name -> (Spark's text, DuckDB's)."""

from __future__ import annotations

from .choice_sql import _LID, _SHORT
from .shelf_sql import _FACING, portable

_SPLIT = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END"
_TRUTH = "CASE WHEN sku % 3 = 0 THEN 1.0D ELSE 0.0D END"
_SAID = "CASE WHEN pred % 3 = 0 THEN 1.0D ELSE 0.0D END"

_TEXTS: dict[str, str] = {
    "a2_run_summary": """
SELECT user_id % 10 AS run, count(*) AS n, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0D ELSE 0.0D END), 6) AS acc,
 round(avg(CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'purchase' THEN 1.0D ELSE 0.0D END), 6) AS valid_acc, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, round(avg(value) * 0.000459D, 9) AS mean_cost
FROM events GROUP BY user_id % 10""",
    "a10_share_by_union_of_categories": f"""
WITH {_FACING}, t AS (SELECT category, count(*) AS n, sum({_TRUTH}) AS own FROM named GROUP BY category), p AS (SELECT coalesce(pred_category, 'Uncategorized') AS category, count(*) AS n, sum({_SAID}) AS own FROM named GROUP BY coalesce(pred_category, 'Uncategorized')),
u AS (SELECT coalesce(t.category, p.category) AS category, coalesce(t.n, 0) AS truth_n, coalesce(p.n, 0) AS said_n, coalesce(t.own / t.n, 0.0D) AS truth, coalesce(p.own / p.n, 0.0D) AS said FROM t FULL OUTER JOIN p ON t.category = p.category)
SELECT category, truth_n, said_n, round(truth, 6) AS truth_share, round(said, 6) AS said_share, round(abs(truth - said), 6) AS error FROM u""",
    "a14_enrichment_buckets": f"""
WITH {_FACING} SELECT image, count(*) AS n, CAST(sum(CASE WHEN slot <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS in_band, CAST(sum(CASE WHEN slot > 3 THEN 1 ELSE 0 END) AS BIGINT) AS extra, count(DISTINCT CASE WHEN slot > 3 THEN pred END) AS extra_skus, count(DISTINCT CASE WHEN slot > 3 THEN pred_brand END) AS extra_brands,
 count(DISTINCT CASE WHEN slot > 3 THEN pred_category END) AS extra_categories, round(CAST(count(*) AS DOUBLE) / greatest(1.0D, sum(CASE WHEN slot <= 3 THEN 1.0D ELSE 0.0D END)), 2) AS multiplier FROM named GROUP BY image""",
    "a17_prevalence_correction": f"""
WITH {_FACING}, s AS (SELECT category, avg({_SAID}) AS p, CAST(count(*) AS DOUBLE) AS n FROM named GROUP BY category),
c AS (SELECT category, greatest(0.0D, least(1.0D, (p + 0.94D - 1.0D) / 0.90D)) AS prevalence, 1.96D * sqrt(p * (1.0D - p) / n) / 0.90D AS half FROM s)
SELECT category, round(prevalence, 6) AS prevalence, round(greatest(0.0D, prevalence - half), 6) AS lo, round(least(1.0D, prevalence + half), 6) AS hi FROM c""",
    "a28_token_cost": """
WITH sheet AS (SELECT * FROM (VALUES ('click', 0.5D, NULL), ('view', 0.1D, 0.3D), ('purchase', 2.0D, NULL), ('signup', 1.0D, NULL), ('error', 0.2D, NULL)) AS s(kind, usd, priority_usd)),
e AS (SELECT user_id % 10 AS run, value, event_id % 3 AS tier, event_id % 7 = 0 AS promo, usd, priority_usd FROM events LEFT JOIN sheet ON event_type = kind)
SELECT run, round(sum(CASE tier WHEN 2 THEN 0.0D WHEN 1 THEN value * coalesce(priority_usd, 1.8D * usd) ELSE value * usd END) / 1000000.0D, 9) AS gross, round(sum(CASE WHEN promo AND tier < 2 THEN value * usd ELSE 0.0D END) / 1000000.0D, 9) AS credit, CAST(sum(CASE WHEN usd IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unpriced FROM e GROUP BY run""",
    "a34_consensus_label": """
WITH v AS (SELECT md5(text) AS h, lang, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY md5(text), lang), t AS (SELECT *, sum(n) OVER (PARTITION BY h) AS total, row_number() OVER (PARTITION BY h ORDER BY n DESC, lang) AS place FROM v),
allowed AS (SELECT h, min(CASE WHEN lang IN ('en', 'de') THEN lang END) AS first_allowed, count(DISTINCT CASE WHEN lang IN ('en', 'de') THEN lang END) AS n_allowed FROM v GROUP BY h)
SELECT t.h, CASE WHEN n >= 0.8D * total THEN lang END AS consensus, CASE WHEN n < 0.8D * total THEN first_allowed END AS fallback, n_allowed, CAST(total AS BIGINT) AS votes FROM t JOIN allowed ON t.h = allowed.h WHERE place = 1""",
    "a40_leakage_counts": f"""
WITH s AS (SELECT md5(text) AS h, doc_id - doc_id % 4 AS session, {_SPLIT} AS split, source, doc_id % 7 = 0 AS copied FROM documents WHERE text IS NOT NULL)
SELECT (SELECT count(*) FROM (SELECT h FROM s GROUP BY h HAVING count(DISTINCT split) > 1) x) AS hashes, (SELECT count(*) FROM (SELECT session FROM s GROUP BY session HAVING count(DISTINCT split) > 1) x) AS sessions,
 (SELECT count(*) FROM (SELECT h FROM s GROUP BY h HAVING count(DISTINCT source) < 2) x) AS incomplete, (SELECT count(*) FROM s WHERE copied AND split <> 'train') AS copies_in_eval""",
    "a45_tail_promotion": f"""
WITH {_FACING}, seen AS (SELECT DISTINCT sku FROM facing WHERE image % 50 = 0), tail AS (SELECT f.sku, min(f.image) AS image FROM facing f LEFT JOIN seen s ON f.sku = s.sku WHERE s.sku IS NULL GROUP BY f.sku), moved AS (SELECT DISTINCT image FROM tail)
SELECT f.image, count(*) AS facings, count(DISTINCT f.sku) AS skus, 'gallery' AS split FROM facing f JOIN moved m ON f.image = m.image GROUP BY f.image""",
    "p4_box_validity": """
WITH b AS (SELECT l_orderkey AS image, l_linenumber AS slot, l_partkey AS sku, 15 + l_quantity % 40 AS w, 10 + (l_partkey % 60) AS h, (l_linenumber * 37) % 400 AS y1 FROM lineitem)
SELECT image, slot, sku FROM b WHERE w >= 20 AND h >= 24 AND CAST(w AS DOUBLE) / h BETWEEN 0.18D AND 2.6D AND NOT (y1 < 0.2D * 400 AND CAST(w AS DOUBLE) * h > 0.065D * 40000)""",
    "p10_interleaved_sample": """
WITH r AS (SELECT p_partkey, p_partkey % 3 = 0 AS owner, row_number() OVER (PARTITION BY p_partkey % 3 = 0 ORDER BY md5(concat('42:', CAST(p_partkey AS VARCHAR(20)))), p_partkey) AS turn FROM part), t AS (SELECT * FROM r WHERE turn <= 50)
SELECT p_partkey, owner, 2 * turn - CASE WHEN owner THEN 1 ELSE 0 END AS place FROM t""",
    "p15_split_disjointness": f"SELECT md5(text) AS h, count(DISTINCT {_SPLIT}) AS splits, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY md5(text) HAVING count(DISTINCT {_SPLIT}) > 1",
    "q1_catalog_parity": """
WITH said AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_orderkey % 13 = 0 THEN l_partkey + 1 ELSE l_partkey END AS shown FROM lineitem),
f AS (SELECT s.l_orderkey, s.l_linenumber, s.l_partkey, s.l_quantity, CASE WHEN a.p_partkey IS NULL THEN 'unlisted' END AS listed, CASE WHEN a.p_name IS DISTINCT FROM b.p_name THEN 'name' END AS f1, CASE WHEN a.p_brand IS DISTINCT FROM b.p_brand THEN 'brand' END AS f2, CASE WHEN a.p_type IS DISTINCT FROM b.p_type THEN 'type' END AS f3, CASE WHEN a.p_size IS DISTINCT FROM b.p_size THEN 'size' END AS f4, CASE WHEN a.p_retailprice IS DISTINCT FROM b.p_retailprice THEN 'price' END AS f5
 FROM said s LEFT JOIN part a ON a.p_partkey = s.l_partkey LEFT JOIN part b ON b.p_partkey = s.shown)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, concat_ws(',', listed, f1, f2, f3, f4, f5) AS differs FROM f WHERE coalesce(listed, f1, f2, f3, f4, f5) IS NOT NULL""",
    "q9_empty_gallery": "SELECT p.p_partkey FROM part p LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey % 50 = 0) g ON p.p_partkey = g.l_partkey WHERE g.l_partkey IS NULL",
    "q11_result_diversity": """
WITH r AS (SELECT user_id % 200 AS run, count(*) AS n, count(DISTINCT CAST(round(value / 60.0D) AS BIGINT)) AS answers, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS failed FROM events GROUP BY user_id % 200)
SELECT run, n, answers, CASE WHEN failed > n / 2.0D THEN 'incomplete' ELSE 'uniform' END AS fault FROM r WHERE failed > n / 2.0D OR (n >= 5 AND answers <= 3)""",
    "q13_outlet_leakage": """
WITH o AS (SELECT DISTINCT o_custkey AS k, CASE WHEN o_orderkey % 50 < 40 THEN 'train' WHEN o_orderkey % 50 < 45 THEN 'val' ELSE 'test' END AS split FROM orders), d AS (SELECT DISTINCT md5(text) AS k, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM documents WHERE text IS NOT NULL)
SELECT 'outlet' AS kind, CAST(k AS VARCHAR(40)) AS k, count(*) AS splits FROM o GROUP BY k HAVING count(*) > 1 UNION ALL SELECT 'hash' AS kind, k, count(*) AS splits FROM d GROUP BY k HAVING count(*) > 1""",
    "q16_gate_rollup": """
WITH v AS (SELECT 'class_key' AS gate, count(*) AS violations FROM (SELECT p_brand FROM part GROUP BY p_brand, p_type, p_size HAVING count(*) > 1) a
 UNION ALL SELECT 'catalog' AS gate, count(*) AS violations FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE p_partkey IS NULL
 UNION ALL SELECT 'box_size' AS gate, count(*) AS violations FROM lineitem WHERE l_quantity < 3 OR l_quantity > 49
 UNION ALL SELECT 'gallery' AS gate, count(*) AS violations FROM part p LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey % 50 = 0) g ON p.p_partkey = g.l_partkey WHERE g.l_partkey IS NULL
 UNION ALL SELECT 'errors' AS gate, count(*) AS violations FROM events WHERE event_type = 'error')
SELECT gate, violations, violations = 0 AS pass FROM v UNION ALL SELECT 'all' AS gate, CAST(sum(violations) AS BIGINT) AS violations, sum(violations) = 0 AS pass FROM v""",
    "w1_leaderboard": """
WITH s AS (SELECT event_type AS board, user_id % 20 AS run, round(avg(value), 6) AS score, round(avg(CASE WHEN value > 50 THEN 1.0D ELSE 0.0D END), 6) AS recall, round(sum(value) * 0.000459D / count(*), 6) AS cost FROM events GROUP BY event_type, user_id % 20)
SELECT board, run, score, recall, cost, CASE WHEN run % 4 = 0 THEN 'dev' ELSE CAST(row_number() OVER (PARTITION BY board, run % 4 = 0 ORDER BY score DESC, recall DESC, cost, run) AS VARCHAR(20)) END AS place FROM s""",
    "k11_prefer_originals": """
WITH r AS (SELECT doc_id, md5(text) AS h, concat('stem', CAST(doc_id - doc_id % 5 AS VARCHAR(20))) AS stem, doc_id % 5 AS copied FROM documents WHERE text IS NOT NULL), a AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY copied, doc_id) AS by_hash FROM r), b AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY copied, doc_id) AS by_stem FROM a WHERE by_hash = 1)
SELECT doc_id, h, stem FROM b WHERE by_stem = 1""",
    "j17_temporal_ownership": """
WITH reg AS (SELECT s_nationkey AS nk, CAST(s_suppkey AS BIGINT) AS parent, DATE '1992-01-01' + CAST(s_suppkey % 100 * 20 AS INT) AS day FROM supplier),
first_of AS (SELECT nk, CAST(min(day) AS DATE) AS first_day FROM reg GROUP BY nk),
u AS (SELECT nk, day, 0 AS kind, parent, CAST(NULL AS BIGINT) AS o FROM reg UNION ALL SELECT c_nationkey AS nk, CAST(o_orderdate AS DATE) AS day, 1 AS kind, CAST(NULL AS BIGINT) AS parent, CAST(o_orderkey AS BIGINT) AS o FROM orders JOIN customer ON o_custkey = c_custkey),
w AS (SELECT nk, kind, o, last_value(parent) IGNORE NULLS OVER (PARTITION BY nk ORDER BY day, kind, parent, o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner FROM u)
SELECT nk, CASE WHEN owner IS NULL THEN 'before_acquisition' WHEN owner % 9 = 0 THEN 'divested' ELSE 'owned' END AS state, owner, count(*) AS n FROM w WHERE kind = 1 GROUP BY nk, owner""",
    "j19_paired_run_join": """
WITH a AS (SELECT concat(CAST(l_orderkey AS VARCHAR(20)), '#', CAST(l_linenumber AS VARCHAR(20))) AS k, max(l_quantity) AS v FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey, l_linenumber), b AS (SELECT concat(CAST(l_orderkey AS VARCHAR(20)), '#', CAST(l_linenumber AS VARCHAR(20))) AS k, max(l_quantity) AS v FROM lineitem WHERE l_returnflag <> 'A' GROUP BY l_orderkey, l_linenumber)
SELECT a.k, CAST(a.v AS DOUBLE) AS one, CAST(b.v AS DOUBLE) AS two, CASE WHEN a.v > 25 AND b.v > 25 THEN 'both' WHEN a.v > 25 THEN 'first' WHEN b.v > 25 THEN 'second' ELSE 'neither' END AS outcome FROM a JOIN b ON a.k = b.k""",
    "j24_experiment_precedence": """
WITH by_id AS (SELECT s_suppkey AS k, s_name AS name FROM supplier WHERE s_suppkey % 4 = 0), by_pair AS (SELECT s_nationkey AS k, s_suppkey % 3 AS g, min(s_name) AS name FROM supplier WHERE s_suppkey % 4 = 1 GROUP BY s_nationkey, s_suppkey % 3), by_one AS (SELECT s_nationkey AS k, min(s_name) AS name FROM supplier WHERE s_suppkey % 4 > 1 GROUP BY s_nationkey)
SELECT c_custkey, coalesce(i.name, p.name, o.name) AS experiment, CASE WHEN i.name IS NOT NULL THEN 'id' WHEN p.name IS NOT NULL THEN 'approach_dataset' WHEN o.name IS NOT NULL THEN 'approach' END AS level FROM customer LEFT JOIN by_id i ON c_custkey = i.k LEFT JOIN by_pair p ON c_nationkey = p.k AND c_custkey % 3 = p.g LEFT JOIN by_one o ON c_nationkey = o.k""",
    "v12_softmax_with_dustbin": f"""
WITH {_SHORT}, f AS (SELECT crop, r, s, max(s) OVER (PARTITION BY crop) AS top, CAST(count(*) OVER (PARTITION BY crop) AS DOUBLE) AS n FROM short), x AS (SELECT crop, r, n, exp(greatest(-30.0D, least(30.0D, 28.0D * (s - top)))) AS e, exp(greatest(-30.0D, least(30.0D, 28.0D * (0.70D - top)))) AS dust FROM f),
z AS (SELECT crop, r, n, e / (sum(e) OVER (PARTITION BY crop) + dust) AS p FROM x)
SELECT crop, round(max(CASE WHEN r = 1 THEN p END), 4) AS top_p, round(CASE WHEN max(n) > 1 THEN greatest(0.0D, 1.0D + sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0.0D END) / ln(max(n))) ELSE 1.0D END, 4) AS conf FROM z GROUP BY crop""",
    "v32_fast_gates": f"""
WITH {_SHORT}, {_LID}, g AS (SELECT stat.crop, round(p1, 6) AS p, round(margin, 6) AS m, round(z, 6) AS z, round(lid, 6) AS lid, round(conf, 6) AS conf, coalesce(brand1 = brand2, false) AS family FROM stat JOIN lid ON stat.crop = lid.crop)
SELECT crop, round(p - 0.56D - CASE WHEN family THEN 0.09D ELSE 0.0D END, 6) >= 0.0D AS by_posterior, m >= CASE WHEN family THEN 0.025D ELSE 0.009D END AND p >= 0.30D AND z >= CASE WHEN family THEN 1.05D ELSE 0.80D END AND lid <= 9.5D AS by_margin, m >= 0.02D AND z >= 0.80D AND lid <= 9.5D AS by_zscore, m >= CASE WHEN family THEN 0.04D ELSE 0.02D END AND conf >= 0.35D AS by_entropy FROM g""",
    "v35_cold_start": f"""
WITH {_SHORT}, {_LID}, t AS (SELECT crop, sku, r, s, s2, row_number() OVER (PARTITION BY crop ORDER BY s2 DESC, r) AS by_text FROM short), n AS (SELECT stat.crop, s1, round(s1, 6) < 0.78D OR (round(lid, 6) > 9.5D AND round(z, 6) < 1.25D) AS novel FROM stat JOIN lid ON stat.crop = lid.crop),
h AS (SELECT t.crop, t.sku, t.r, CASE WHEN novel AND by_text = 1 THEN greatest(s1 + 0.015D, least(0.95D, 1.18D * s2)) ELSE s END AS score, novel AND by_text = 1 AS put FROM t JOIN n ON t.crop = n.crop)
SELECT crop, sku, put, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY crop ORDER BY CASE WHEN put THEN 0 ELSE 1 END, r) AS BIGINT) AS place FROM h""",
    "k1_best_reference_per_class": f"""
WITH {_SHORT}, allowed AS (SELECT DISTINCT crop FROM short WHERE category = 'ECONOMY'), f AS (SELECT short.crop, brand, s, sku FROM short LEFT JOIN allowed ON short.crop = allowed.crop WHERE allowed.crop IS NULL OR category = 'ECONOMY'), g AS (SELECT crop, brand, round(max(s), 6) AS best FROM f GROUP BY crop, brand)
SELECT crop, brand, best, CAST(row_number() OVER (PARTITION BY crop ORDER BY best DESC, brand) AS BIGINT) AS place FROM g""",
    "p6_label_validity": """
WITH l AS (SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN p_brand END AS brand, p_type AS category, CASE WHEN p_partkey % 5 > 0 THEN p_size END AS pack, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS variant, CASE WHEN p_partkey % 11 > 0 THEN p_retailprice END AS product FROM part), tax AS (SELECT p_type AS category, p_size AS pack FROM part GROUP BY p_type, p_size HAVING count(*) >= 2)
SELECT p_partkey, CASE WHEN variant IS NOT NULL AND product IS NOT NULL THEN 5 ELSE 3 END AS fields FROM l JOIN tax ON l.category = tax.category AND l.pack = tax.pack WHERE brand IS NOT NULL AND brand NOT IN ('Brand#1', 'Brand#2') AND (variant IS NULL OR variant NOT LIKE 'old %')""",
    "p8_category_scope": f"""
WITH {_FACING}, truth AS (SELECT image, category, slot % 2 AS band, CASE WHEN sku % 13 = 0 THEN 1 ELSE 0 END AS others FROM named WHERE slot <= 3), scope AS (SELECT DISTINCT image, category, band FROM truth), catch_all AS (SELECT image, max(others) AS others FROM truth GROUP BY image), banded AS (SELECT DISTINCT image, band FROM truth)
SELECT n.image, n.slot, n.sku, n.pred FROM named n JOIN banded b ON n.image = b.image AND n.slot % 2 = b.band LEFT JOIN scope s ON n.image = s.image AND n.pred_category = s.category AND n.slot % 2 = s.band JOIN catch_all c ON n.image = c.image
WHERE n.pred_category IS NULL OR s.category IS NOT NULL OR (n.pred % 3 <> 0 AND c.others = 1)""",
    "q2_domains": """
WITH l AS (SELECT p_partkey, p_brand, p_type, p_size, CASE p_partkey % 5 WHEN 0 THEN 'bottle' WHEN 1 THEN 'sachet' WHEN 2 THEN 'bar' ELSE 'pouch' END AS pack FROM part), f AS (SELECT p_partkey, CASE WHEN p_brand NOT LIKE 'Brand#%' THEN 'brand' END AS a, CASE WHEN p_type NOT IN ('ECONOMY', 'PROMO', 'STANDARD') THEN 'category' END AS b, CASE WHEN p_size NOT BETWEEN 1 AND 49 THEN 'size' END AS c, CASE WHEN pack = 'bottle' AND p_size < 5 THEN 'small_bottle' END AS d, CASE WHEN pack = 'sachet' AND p_size > 20 THEN 'large_sachet' END AS e, CASE WHEN pack = 'bar' AND p_type = 'ECONOMY' THEN 'form' END AS g FROM l)
SELECT p_partkey, concat_ws(',', a, b, c, d, e, g) AS faults FROM f WHERE coalesce(a, b, c, d, e, g) IS NOT NULL""",
    "g2_integer_containment": """
WITH box AS (SELECT l_orderkey AS image, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS BIGINT) AS id, CAST(l_linenumber * 30 AS BIGINT) AS x1, CAST(l_linenumber % 2 * 30 AS BIGINT) AS y1, CAST(floor(l_linenumber * 30 + 40 + l_quantity % 25) AS BIGINT) AS x2, CAST(floor(l_linenumber % 2 * 30 + 60 + l_quantity % 7) AS BIGINT) AS y2 FROM lineitem),
i AS (SELECT a.image, a.id AS one, b.id AS two, CAST(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS DOUBLE) AS inter, CAST((a.x2 - a.x1) * (a.y2 - a.y1) AS DOUBLE) AS s, CAST((b.x2 - b.x1) * (b.y2 - b.y1) AS DOUBLE) AS t FROM box a JOIN box b ON a.image = b.image AND a.id < b.id)
SELECT image, one, two, round(CASE WHEN s + t - inter > 0 THEN inter / (s + t - inter) ELSE 0.0D END, 6) AS iou, round(CASE WHEN least(s, t) > 0 THEN inter / least(s, t) ELSE 0.0D END, 6) AS containment FROM i WHERE inter > 0""",
}
QUERIES = {k: (s, portable(s).replace("last_value(parent) IGNORE NULLS", "last_value(parent IGNORE NULLS)")) for k, s in _TEXTS.items()}
#: Sessions of a user's events of one kind: a gap of over 300 seconds or another kind begins a new one.
QUERIES["w3_gap_sessions"] = (
    "WITH g AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_type, ts, event_id) AND unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(CAST(lag(ts) OVER (PARTITION BY user_id ORDER BY event_type, ts, event_id) AS TIMESTAMP)) <= 300000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, event_type, sum(new) OVER (PARTITION BY user_id ORDER BY event_type, ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, event_type, session, count(*) AS n FROM s GROUP BY user_id, event_type, session",
    "WITH g AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_type, ts, event_id) AND epoch_us(CAST(ts AS TIMESTAMP)) - epoch_us(CAST(lag(ts) OVER (PARTITION BY user_id ORDER BY event_type, ts, event_id) AS TIMESTAMP)) <= 300000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, event_type, sum(new) OVER (PARTITION BY user_id ORDER BY event_type, ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, event_type, CAST(session AS BIGINT) AS session, count(*) AS n FROM s GROUP BY user_id, event_type, session",
)
#: The first eight names of a brand, without gathering the others.
QUERIES["a43_registry_roll_up"] = (
    "WITH n AS (SELECT DISTINCT p_brand, p_name FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS k FROM n), f AS (SELECT p_brand, listagg(p_name, '|') WITHIN GROUP (ORDER BY p_name) AS samples FROM r WHERE k <= 8 GROUP BY p_brand), c AS (SELECT p_brand, count(*) AS skus, count(DISTINCT p_name) AS names FROM part GROUP BY p_brand) SELECT c.p_brand, skus, names, samples FROM c JOIN f ON c.p_brand = f.p_brand",
    "WITH n AS (SELECT DISTINCT p_brand, p_name FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS k FROM n), f AS (SELECT p_brand, string_agg(p_name, '|' ORDER BY p_name) AS samples FROM r WHERE k <= 8 GROUP BY p_brand), c AS (SELECT p_brand, count(*) AS skus, count(DISTINCT p_name) AS names FROM part GROUP BY p_brand) SELECT c.p_brand, skus, names, samples FROM c JOIN f ON c.p_brand = f.p_brand",
)
#: A missing category becomes the set of those that its image has.
_ALLOWED = "s AS (SELECT image, slot, sku, CASE WHEN slot % 3 <> 0 THEN category END AS category FROM named), d AS (SELECT DISTINCT image, category FROM s WHERE category IS NOT NULL), g AS (SELECT image, {list} AS allowed, count(*) AS n FROM d GROUP BY image) SELECT s.image, slot, sku, coalesce(category, allowed) AS category, category IS NULL AND n > 1 AS ambiguous FROM s LEFT JOIN g ON s.image = g.image"
QUERIES["a36_allowed_backfill"] = (
    f"WITH {_FACING}, " + _ALLOWED.format(list="listagg(category, '|') WITHIN GROUP (ORDER BY category)"),
    f"WITH {_FACING}, " + _ALLOWED.format(list="string_agg(category, '|' ORDER BY category)"),
)
#: Faults by the first rule that holds: the message, then the first contract error of the nested calls, truncation, the time limit.
_FAULT = "CASE WHEN message LIKE '%timed out%' THEN 'timeout' WHEN message LIKE '%quota%' THEN 'quota' WHEN message IS NOT NULL THEN 'runtime' WHEN contract IS NOT NULL THEN substr(contract, 10) WHEN truncated THEN 'truncated' WHEN value > 180 THEN 'sla' ELSE 'none' END"
_CALLS = "SELECT event_id, value, CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'the call timed out' WHEN 1 THEN 'over quota' ELSE 'boom' END END AS message, event_id % 13 = 0 AS truncated"
QUERIES["p13_error_ladder"] = (
    f"WITH c AS ({_CALLS}, try_element_at(filter(array('ok', CASE WHEN event_id % 5 = 0 THEN 'contract:schema' ELSE 'ok' END, CASE WHEN event_id % 7 = 0 THEN 'contract:range' ELSE 'ok' END), x -> x LIKE 'contract:%'), 1) AS contract FROM events) SELECT event_id, {_FAULT} AS kind FROM c",
    f"WITH c AS ({_CALLS}, list_filter(['ok', CASE WHEN event_id % 5 = 0 THEN 'contract:schema' ELSE 'ok' END, CASE WHEN event_id % 7 = 0 THEN 'contract:range' ELSE 'ok' END], lambda x: x LIKE 'contract:%')[1] AS contract FROM events) SELECT event_id, {_FAULT} AS kind FROM c",
)
#: A third source that is a list by slot: its element, or nothing beyond its end.
_THREE = "SELECT k.image, k.slot, coalesce(one = k.sku, false) AS one_ok, coalesce(two = k.sku, false) AS two_ok, coalesce({at} = k.sku, false) AS three_ok FROM k LEFT JOIN two ON k.image = two.image AND k.slot = two.slot LEFT JOIN three ON k.image = three.image"
_SOURCES = f"WITH {_FACING}, k AS (SELECT image, slot, min(sku) AS sku, min(pred) AS one FROM facing GROUP BY image, slot), two AS (SELECT image, slot, sku AS two FROM k WHERE slot % 2 = 0), "
QUERIES["j20_three_sources"] = (
    _SOURCES + "three AS (SELECT image, transform(array_sort(collect_list(struct(slot, sku))), x -> x.sku + x.slot % 2) AS answers FROM k WHERE slot <= 4 GROUP BY image) " + _THREE.format(at="try_element_at(answers, CAST(k.slot AS INT))"),
    portable(_SOURCES) + "three AS (SELECT image, list(sku + slot % 2 ORDER BY slot) AS answers FROM k WHERE slot <= 4 GROUP BY image) " + _THREE.format(at="answers[k.slot]"),
)
