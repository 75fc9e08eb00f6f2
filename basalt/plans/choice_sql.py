"""Queries that rank and choose: shortlists, votes, gates, rankings within rows and strata.

Stand-in shortlist: an order is a crop, its line items the candidates, their discount the similarity (0.5 to 0.9), ranked by it.
"""

from __future__ import annotations

from .shelf_sql import _FACING, portable

DUSTBIN = "exp((0.68D - 0.9D) / 0.05D)"
_SHORT = f"""
cand AS (SELECT l_orderkey AS crop, l_partkey AS sku, l_linenumber AS slot, l_quantity AS qty, CAST(0.5D + 4.0D * l_discount AS DOUBLE) AS s, CAST(0.5D + 4.0D * l_tax AS DOUBLE) AS s2,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_partkey, l_linenumber, l_extendedprice) AS BIGINT) AS r FROM lineitem),
short AS (SELECT c.*, p_brand AS brand, p_type AS category, p_size AS psize, exp((s - 0.9D) / 0.05D) AS e FROM cand c JOIN part ON sku = p_partkey WHERE r <= 6),
post AS (SELECT *, e / (sum(e) OVER (PARTITION BY crop) + {DUSTBIN}) AS p FROM short),
head AS (SELECT crop, max(CASE WHEN r = 1 THEN s END) AS s1, max(CASE WHEN r = 2 THEN s END) AS s2, avg(s) AS mean_s, sqrt(greatest(avg(s * s) - avg(s) * avg(s), 0.0D)) AS sd, count(*) AS n, max(CASE WHEN r = 1 THEN p END) AS p1,
  max(CASE WHEN r = 1 THEN brand END) AS brand1, max(CASE WHEN r = 2 THEN brand END) AS brand2, max(CASE WHEN r = 1 THEN sku END) AS sku1, max(CASE WHEN r = 2 THEN sku END) AS sku2, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0.0D END) AS h FROM post GROUP BY crop),
stat AS (SELECT *, s1 - coalesce(s2, 0.0D) AS margin, CASE WHEN sd > 0.000001D THEN (s1 - mean_s) / sd ELSE 0.0D END AS z, CASE WHEN n > 1 THEN greatest(0.0D, 1.0D - h / ln(CAST(n AS DOUBLE))) ELSE 1.0D END AS conf FROM head)
"""
_LID = "lid AS (SELECT crop, least(50.0D, 1.0D / greatest(avg(ln(1.0D / greatest((1.0D - s) / 0.5D, 0.0001D))), 0.0001D)) AS lid FROM short GROUP BY crop)"
_VOTES = """
mass AS (SELECT crop, field, value, sum(w) AS w FROM (SELECT crop, 'brand' AS field, brand AS value, p AS w FROM post UNION ALL SELECT crop, 'category' AS field, category AS value, p AS w FROM post) u GROUP BY crop, field, value),
votes AS (SELECT *, w / sum(w) OVER (PARTITION BY crop, field) AS share, row_number() OVER (PARTITION BY crop, field ORDER BY round(w, 9) DESC, value) AS place FROM mass),
won AS (SELECT crop, field, max(CASE WHEN place = 1 THEN value END) AS value, max(CASE WHEN place = 1 THEN share END) AS share, max(CASE WHEN place = 1 THEN share END) - coalesce(max(CASE WHEN place = 2 THEN share END), 0.0D) AS margin FROM votes GROUP BY crop, field)
"""
_LEVELS = f"""
{_FACING}, lv AS (SELECT 1 AS level, 0.3185D AS w UNION ALL SELECT 2 AS level, 0.6887D AS w UNION ALL SELECT 3 AS level, 0.4625D AS w),
sold AS (SELECT n.*, o_custkey % 50 AS outlet FROM named n JOIN orders ON image = o_orderkey),
occ AS (SELECT 1 AS level, category AS item, outlet, CAST(count(*) AS DOUBLE) AS n FROM sold GROUP BY category, outlet UNION ALL SELECT 2 AS level, brand AS item, outlet, CAST(count(*) AS DOUBLE) AS n FROM sold GROUP BY brand, outlet
  UNION ALL SELECT 3 AS level, CAST(psize AS VARCHAR(20)) AS item, outlet, CAST(count(*) AS DOUBLE) AS n FROM sold GROUP BY psize, outlet),
lens AS (SELECT level, item, sqrt(sum(n * n)) AS norm, sum(CASE WHEN n >= 2 THEN 1.0D ELSE 0.0D END) / count(*) AS own FROM occ GROUP BY level, item),
dots AS (SELECT a.level, a.item AS one, b.item AS two, sum(a.n * b.n) AS dot FROM occ a JOIN occ b ON a.level = b.level AND a.outlet = b.outlet AND a.item < b.item GROUP BY a.level, a.item, b.item),
sims AS (SELECT d.level, one, two, dot / (x.norm * y.norm) AS sim FROM dots d JOIN lens x ON d.level = x.level AND one = x.item JOIN lens y ON d.level = y.level AND two = y.item UNION ALL SELECT level, item AS one, item AS two, own AS sim FROM lens)
"""
#: Row of an image by slot parity, place by slot; repeated slots are told apart by their other columns.
_ROWS = f"{_FACING}, spots AS (SELECT image, slot % 2 AS shelf, sku, brand, category, slot * 30.0D AS x1, slot * 30.0D + 20.0D + occ % 25 AS x2, CAST(row_number() OVER (PARTITION BY image, slot % 2 ORDER BY slot, sku, occ, area) AS BIGINT) AS place FROM named)"

_TEXTS: dict[str, str] = {
    # association
    # vectors
    # posteriors, votes and gates over shortlists
    "v11_energy": f"WITH {_SHORT} SELECT crop, r, round(0.78D * (s - 0.5D * 0.1D) + 0.22D * s2 + 0.035D * (qty / 50.0D - 0.5D), 6) AS energy FROM short",
    "v13_entropy_confidence": f"WITH {_SHORT} SELECT crop, round(conf, 6) AS conf FROM stat",
    "v14_zscore_lid": f"WITH {_SHORT}, {_LID} SELECT stat.crop, round(z, 6) AS z, round(margin, 6) AS margin, round(lid, 6) AS lid FROM stat JOIN lid ON stat.crop = lid.crop",
    "v16_field_votes": f"WITH {_SHORT}, {_VOTES} SELECT crop, field, value, round(share, 6) AS share, round(margin, 6) AS margin FROM won",
    "v17_vote_shares": f"WITH {_SHORT}, {_VOTES} SELECT crop, field, value, round(share, 6) AS share FROM votes",
    "v18_field_confidence": f"WITH {_SHORT}, {_VOTES}, f AS (SELECT won.crop, field, share * (0.5D + 0.5D * won.margin) * (0.5D + 0.5D * conf) AS c FROM won JOIN stat ON won.crop = stat.crop) SELECT crop, round(min(c), 6) AS weakest, round(exp(sum(ln(greatest(c, 0.000001D)))), 6) AS joint FROM f GROUP BY crop",
    "v19_unsure_fields": f"WITH {_SHORT}, {_VOTES} SELECT crop, CAST(sum(CASE WHEN share < 0.6D OR margin < 0.2D THEN 1 ELSE 0 END) AS BIGINT) AS unsure, min(CASE WHEN share < 0.6D OR margin < 0.2D THEN field END) AS first_unsure FROM won GROUP BY crop",
    "v20_merged_answers": f"WITH {_SHORT}, {_VOTES}, b AS (SELECT crop, max(CASE WHEN r = 1 THEN brand END) AS brand, max(CASE WHEN r = 1 THEN category END) AS category FROM short GROUP BY crop) SELECT won.crop, field, CASE WHEN share >= 0.6D AND margin >= 0.2D THEN value WHEN field = 'brand' THEN b.brand ELSE b.category END AS value FROM won JOIN b ON won.crop = b.crop",
    "v21_taxonomy_projection": f"WITH {_SHORT}, {_VOTES}, a AS (SELECT crop, max(CASE WHEN field = 'brand' THEN value END) AS brand, max(CASE WHEN field = 'category' THEN value END) AS category FROM won GROUP BY crop), tax AS (SELECT p_brand, p_type, min(p_partkey) AS sku FROM part GROUP BY p_brand, p_type), any_of AS (SELECT p_brand, min(p_partkey) AS sku FROM part GROUP BY p_brand) SELECT crop, coalesce(tax.sku, any_of.sku) AS sku, tax.sku IS NULL AS projected FROM a LEFT JOIN tax ON a.brand = tax.p_brand AND a.category = tax.p_type LEFT JOIN any_of ON a.brand = any_of.p_brand",
    "v22_coarse_triage": f"WITH {_SHORT}, m AS (SELECT crop, category, sum(p) AS mass FROM post GROUP BY crop, category) SELECT crop, category, round(mass, 6) AS mass FROM m UNION ALL SELECT crop, 'dustbin' AS category, round(1.0D - sum(mass), 6) AS mass FROM m GROUP BY crop",
    "v23_pooled_confidence": f"WITH {_SHORT} SELECT stat.crop, round(sum(p), 6) AS pooled FROM post JOIN stat ON post.crop = stat.crop WHERE brand = brand1 GROUP BY stat.crop",
    "v24_product_of_experts": f"WITH {_SHORT}, two AS (SELECT crop, r, sku, p, exp((s2 - 0.9D) / 0.05D) / (sum(exp((s2 - 0.9D) / 0.05D)) OVER (PARTITION BY crop) + {DUSTBIN}) AS q FROM post), w AS (SELECT crop, max(p) AS c1, max(q) AS c2 FROM two GROUP BY crop), m AS (SELECT two.crop, r, sku, CASE WHEN c2 >= 0.35D AND c2 / (c1 + c2) >= 0.45D THEN q ELSE exp(c2 / (c1 + c2) * ln(greatest(q, 0.000000001D)) + c1 / (c1 + c2) * ln(greatest(p, 0.000000001D))) END AS f FROM two JOIN w ON two.crop = w.crop), o AS (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY round(f, 9) DESC, r) AS place FROM m) SELECT crop, sku, r, round(f, 6) AS score FROM o WHERE place = 1",
    "v25_choice_tiers": f"WITH {_SHORT} SELECT crop, CASE WHEN p1 >= 0.72D THEN sku1 WHEN p1 >= 0.45D AND margin >= 0.045D THEN sku1 WHEN s1 >= 0.45D THEN sku1 END AS sku, CASE WHEN p1 >= 0.72D THEN 'sure' WHEN p1 >= 0.45D AND margin >= 0.045D THEN 'likely' ELSE 'fallback' END AS tier FROM stat",
    "v26_slot_distributions": f"WITH {_SHORT}, l AS (SELECT crop, r, exp(-r * 0.9D) * 0.5D AS q FROM short) SELECT crop, r, round(q, 6) AS q FROM l UNION ALL SELECT crop, CAST(0 AS BIGINT) AS r, round(1.0D - sum(q), 6) AS q FROM l GROUP BY crop",
    "v27_sister_by_size": f"WITH {_SHORT}, f AS (SELECT * FROM short WHERE r = 1), s AS (SELECT f.crop, f.sku AS first, o.sku AS sister, row_number() OVER (PARTITION BY f.crop ORDER BY o.r) AS place FROM f JOIN short o ON f.crop = o.crop AND f.brand = o.brand AND o.r > 1 AND f.psize <> o.psize) SELECT f.crop, coalesce(s.sister, f.sku) AS sku FROM f LEFT JOIN s ON f.crop = s.crop AND s.place = 1",
    "v28_geometry_affinity": f"WITH {_SHORT} SELECT crop, r, CASE WHEN qty / 25.0D BETWEEN 0.8D AND 1.25D THEN 1.0D WHEN qty / 25.0D BETWEEN 0.5D AND 2.0D THEN 0.5D ELSE 0.0D END AS affinity, round(s + 0.02D * CASE WHEN qty / 25.0D BETWEEN 0.8D AND 1.25D THEN 1.0D ELSE 0.0D END, 6) AS score FROM short",
    "v29_lidstone_posterior": f"WITH {_SHORT} SELECT crop, category, round((sum(e) + 0.5D) / (max(total) + 0.5D * 6.0D), 6) AS p FROM (SELECT *, sum(e) OVER (PARTITION BY crop) AS total FROM short) t GROUP BY crop, category",
    "v30_brand_gate": f"WITH {_SHORT}, b AS (SELECT crop, brand, max(s) AS best, rank() OVER (PARTITION BY crop ORDER BY max(s) DESC) AS place FROM short GROUP BY crop, brand) SELECT DISTINCT short.crop, sku FROM short JOIN b ON short.crop = b.crop AND short.brand = b.brand WHERE b.place <= 2 OR r <= 2",
    "v31_cohort_scope": f"WITH {_SHORT}, scoped AS (SELECT crop, r, sku FROM short WHERE category IN ('ECONOMY', 'PROMO')), covered AS (SELECT DISTINCT crop FROM scoped) SELECT crop, r, sku FROM scoped UNION ALL SELECT s.crop, r, sku FROM short s LEFT JOIN covered c ON s.crop = c.crop WHERE c.crop IS NULL",
    "v33_zero_model_rank": f"WITH {_SHORT}, x AS (SELECT crop, sku, r, round(0.78D * s + 0.22D * s2, 6) AS energy FROM short) SELECT crop, sku, energy, CAST(row_number() OVER (PARTITION BY crop ORDER BY energy DESC, r) AS BIGINT) AS place FROM x",
    "v34_cross_modal_rank": f"WITH {_SHORT}, x AS (SELECT crop, sku, r, 0.55D * s + 0.30D * s2 + 0.15D * avg(s) OVER (PARTITION BY crop, brand) AS m FROM short) SELECT crop, sku, r, round(exp((m - 0.9D) / 0.05D) / (sum(exp((m - 0.9D) / 0.05D)) OVER (PARTITION BY crop) + {DUSTBIN}), 6) AS p FROM x",
    # ordered
    "w2_top_k_before_rank": "WITH r AS (SELECT p_partkey, p_type, rank() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC) AS place FROM part WHERE p_size > 10) SELECT p_partkey, p_type, CAST(place AS BIGINT) AS place FROM r WHERE place <= 20",
    "w9_row_majority": f"WITH {_ROWS}, c AS (SELECT image, shelf, category, count(*) AS n, sum(count(*)) OVER (PARTITION BY image, shelf) AS total FROM spots GROUP BY image, shelf, category) SELECT image, shelf, category FROM c WHERE total >= 3 AND n >= 0.65D * total",
    "w10_border_facings": f"WITH {_ROWS}, m AS (SELECT *, max(x2) OVER (PARTITION BY image) AS width FROM spots) SELECT image, CAST(sum(CASE WHEN (x1 + x2) / 2.0D < 0.12D * width OR (x1 + x2) / 2.0D > 0.88D * width THEN 1 ELSE 0 END) AS BIGINT) AS border FROM m GROUP BY image",
    # top-k
    "k2_head_re_sort": f"WITH {_SHORT} SELECT crop, sku, r, CAST(row_number() OVER (PARTITION BY crop ORDER BY CASE WHEN r <= 4 THEN 0 ELSE 1 END, CASE WHEN r <= 4 THEN -s2 ELSE 0.0D END, r) AS BIGINT) AS place FROM short",
    "k4_strided_gallery": "WITH r AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS i FROM part) SELECT p_partkey, p_type FROM r WHERE i % 3 = 0 AND i < 30",
}
QUERIES = {k: (s, portable(s)) for k, s in _TEXTS.items()}
