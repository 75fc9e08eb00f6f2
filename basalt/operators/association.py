"""Association of items over outlets: occurrence vectors, similarities by level, weighted scores of candidate pairs.

Facts have outlet, category, occurrence, seen (their order) and a column for each level, of which the first is the item. Dot products are made for the
pairs asked for, along one side's outlets, so an outlet that sells everything makes no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.sources import tables

LEVELS = ("item", "sub", "brand", "variant", "size", "pack")


def usable(facts: DataFrame, placeholders: tuple[str, ...]) -> DataFrame:
    """Facts of real brands and sub-categories."""
    return facts.where(~F.col("brand").isin(*placeholders) & ~F.col("sub").isin(*placeholders))


def occurrences(facts: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Level, value, outlet and n, the vectors in long form."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("value")) for c in levels))).alias("c")
    return facts.select("outlet", F.col("occurrence").cast("double").alias("occurrence"), cells).groupBy("c.level", "c.value", "outlet").agg(F.sum("occurrence").alias("n"))


def self_scores(vectors: DataFrame) -> DataFrame:
    """Level, value, score (outlets with two or more, of those with one or more) and norm."""
    one, two = F.count_if(F.col("n") >= 1), F.count_if(F.col("n") >= 2)
    return vectors.groupBy("level", "value").agg(F.when(one > 0, two / one).otherwise(0.0).alias("score"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))


def similarities(vectors: DataFrame, asked: DataFrame, placeholders: tuple[str, ...] = ()) -> DataFrame:
    """V2, V3: asked (level, a, b) with sim: 0 for placeholders, the self score of a value with itself, else the cosine over outlets."""
    own = self_scores(vectors)
    a = asked.where("a <> b").join(vectors.select("level", F.col("value").alias("a"), "outlet", F.col("n").alias("n_a")), ["level", "a"])
    dots = a.join(vectors.select("level", F.col("value").alias("b"), "outlet", F.col("n").alias("n_b")), ["level", "b", "outlet"]).groupBy("level", "a", "b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("dot"))
    side = lambda k: own.select("level", F.col("value").alias(k), F.col("norm").alias(f"norm_{k}"), F.col("score").alias(f"score_{k}"))
    out = asked.join(dots, ["level", "a", "b"], "left").join(side("a"), ["level", "a"], "left").join(side("b").drop("score_b"), ["level", "b"], "left")
    length = F.col("norm_a") * F.col("norm_b")
    sim = F.when(F.col("a").isin(*placeholders) | F.col("b").isin(*placeholders) | F.col("a").isNull() | F.col("b").isNull(), 0.0) if placeholders else F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0)
    sim = sim.when(F.col("a") == F.col("b"), F.coalesce("score_a", F.lit(0.0))).when(length > 0, F.coalesce("dot", F.lit(0.0)) / length).otherwise(0.0)
    return out.select("level", "a", "b", sim.alias("sim"))


def candidates(facts: DataFrame, levels: tuple[str, ...] = LEVELS, most: int = 25) -> DataFrame:
    """V5: pairs of the first items seen in each category, an item with itself too; every item with the category and levels of its first row: category, one, two (structs)."""
    first = facts.groupBy(levels[0]).agg(F.min_by(F.struct("category", "seen", *levels[1:]), "seen").alias("f"))
    items = first.select("f.category", F.struct(F.col(levels[0]).cast("string").alias(levels[0]), *(F.col(f"f.{c}").cast("string").alias(c) for c in levels[1:])).alias("x"), F.col("f.seen").alias("seen"))
    placed = items.withColumn("i", F.row_number().over(Window.partitionBy("category").orderBy("seen", f"x.{levels[0]}"))).where(F.col("i") <= most)
    a, b = placed.select("category", F.col("x").alias("one"), "i"), placed.select("category", F.col("x").alias("two"), F.col("i").alias("j"))
    return a.join(b, "category").where("i <= j").select("category", "i", "j", "one", "two")  # at most ``most`` items a category


def level_weights(table: DataFrame) -> DataFrame:
    """Category and w1 to w6; w1 is w4 times w5 in hundredths."""
    return table.select("category", F.round(F.col("w4") * F.col("w5") / 100, 4).alias("w1"), "w2", "w3", "w4", "w5", "w6")


def scores(facts: DataFrame, table: DataFrame, placeholders: tuple[str, ...] = (), levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """V4: category, one, two (items) and score, the weighted mean of the levels' similarities, 4 digits; facts of placeholders count nowhere."""
    kept = usable(facts, placeholders) if placeholders else facts
    pairs, vectors = candidates(kept, levels), occurrences(kept, levels)
    low, high = (lambda c: F.least(f"one.{c}", f"two.{c}")), (lambda c: F.greatest(f"one.{c}", f"two.{c}"))
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("level"), F.lit(k).alias("k"), low(c).alias("a"), high(c).alias("b")) for k, c in enumerate(levels, 1)))).alias("c")
    each = pairs.select("category", F.col(f"one.{levels[0]}").alias("one"), F.col(f"two.{levels[0]}").alias("two"), cells).select("category", "one", "two", "c.*")
    sims = similarities(vectors, each.select("level", "a", "b").distinct(), placeholders)
    weights = level_weights(table)
    weight = F.element_at(F.array(*(F.col(f"w{k}") for k in range(1, 7))), F.col("k"))
    out = each.join(sims, ["level", "a", "b"]).join(weights, "category").groupBy("category", "one", "two")
    return out.agg(F.round(F.sum(weight * F.col("sim")) / F.greatest(F.sum(weight), F.lit(1e-9)), 4).alias("score"))


def summary(facts: DataFrame, table: DataFrame, placeholders: tuple[str, ...]) -> DataFrame:
    """One row of a scenario: facings, kept and dropped, what they cover, mean weight and mean score of the pairs that have one."""
    gone = F.col("brand").isin(*placeholders) | F.col("sub").isin(*placeholders)
    kept = lambda c: F.count_distinct(F.when(~gone, F.col(c)))
    total = lambda when: F.sum(F.when(when, F.col("occurrence").cast("long")).otherwise(0))
    base = facts.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~gone).alias("kept_rows"), total(F.lit(True)).alias("facings"), total(~gone).alias("kept"), kept("outlet").alias("outlets"), kept("brand").alias("brands"), kept("item").alias("items"))
    found = scores(facts, table, placeholders)
    some = found.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("score") > 0).alias("nonzero"), F.round(F.avg(F.when(F.col("score") > 0, F.col("score"))), 4).alias("mean_score"))
    used = found.select("category").distinct().join(level_weights(table), "category").agg(F.round(F.avg("w1"), 2).alias("mean_w1"))
    return base.crossJoin(some).crossJoin(used).withColumn("kept_share", F.round(100.0 * F.col("kept") / F.greatest(F.lit(1), F.col("facings")), 2))  # three tables of one row


GONE = ("Brand#1", "Brand#2")


def _facts(spark, d) -> DataFrame:
    """Line items as facts: part keys modulo 60 are items, customers modulo 50 outlets."""
    li, p, o = (tables.load(spark, d, n) for n in ("lineitem", "part", "orders"))
    rows = li.join(p, li.l_partkey == p.p_partkey).join(o, li.l_orderkey == o.o_orderkey)
    size: Column = F.col("p_size")
    return rows.select((F.col("o_custkey") % 50).alias("outlet"), F.col("p_type").alias("category"), F.col("l_quantity").alias("occurrence"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("seen"), F.concat(F.lit("i"), F.col("l_partkey") % 60).alias("item"), F.concat(F.lit("s"), size % 9).alias("sub"), F.col("p_brand").alias("brand"), F.concat(F.lit("v"), size % 7).alias("variant"), F.concat(F.lit("z"), size % 5).alias("size"), F.concat(F.lit("k"), size % 3).alias("pack"))


def _table(spark, d) -> DataFrame:
    n = F.length("category").cast("double")
    return tables.load(spark, d, "part").select(F.col("p_type").alias("category")).distinct().select("category", (n + 30).alias("w2"), (n + 60).alias("w3"), (n + 65).alias("w4"), (n + 40).alias("w5"), (n + 10).alias("w6"))


def _similar(spark, d) -> DataFrame:
    kept = usable(_facts(spark, d), GONE)
    asked = candidates(kept).select(F.lit("item").alias("level"), F.least("one.item", "two.item").alias("a"), F.greatest("one.item", "two.item").alias("b")).distinct()
    return similarities(occurrences(kept), asked, ("i7",)).select("level", "a", "b", F.round("sim", 6).alias("sim"))


QUERIES = {
    "a24_occurrence_vectors": lambda spark, d: occurrences(usable(_facts(spark, d), GONE)),
    "a25_self_association": lambda spark, d: self_scores(occurrences(usable(_facts(spark, d), GONE))).select("level", "value", F.round("score", 6).alias("score")),
    "a26_scenario_summary": lambda spark, d: summary(_facts(spark, d), _table(spark, d), GONE),
    "a27_level_weights": lambda spark, d: level_weights(_table(spark, d)),
    "p9_placeholder_brands": lambda spark, d: usable(_facts(spark, d), (*GONE, "s3")).groupBy("brand", "sub").agg(F.count(F.lit(1)).alias("n")),
    "v2_sparse_cosine": lambda spark, d: _similar(spark, d).where("a <> b and a <> 'i7' and b <> 'i7'").drop("level"),
    "v3_level_similarity": _similar,
    "v4_association_score": lambda spark, d: scores(_facts(spark, d), _table(spark, d), GONE),
    "v5_candidate_pairs": lambda spark, d: candidates(usable(_facts(spark, d), GONE)).select("category", F.col("one.item").alias("one"), F.col("two.item").alias("two"), "i", "j"),
}

_FACTS = """
f AS (SELECT o_custkey % 50 AS outlet, p_type AS category, l_quantity AS occ, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS seen, 'i' || l_partkey % 60 AS item, 's' || p_size % 9 AS sub, p_brand AS brand, 'v' || p_size % 7 AS variant, 'z' || p_size % 5 AS size, 'k' || p_size % 3 AS pack FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
k AS (SELECT * FROM f WHERE brand NOT IN ('Brand#1', 'Brand#2')),
lv AS (SELECT outlet, occ, unnest(['item', 'sub', 'brand', 'variant', 'size', 'pack']) AS level, unnest([item, sub, brand, variant, size, pack]) AS value FROM k),
occ AS (SELECT level, value, outlet, sum(CAST(occ AS DOUBLE)) AS n FROM lv GROUP BY level, value, outlet),
own AS (SELECT level, value, count(*) FILTER (n >= 2) / CAST(greatest(1, count(*) FILTER (n >= 1)) AS DOUBLE) AS score, sqrt(sum(n * n)) AS norm FROM occ GROUP BY level, value),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY seen) AS t FROM k) WHERE t = 1),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY seen, item) AS i FROM first) WHERE i <= 25),
pairs AS (SELECT a.category, a.i, b.i AS j, a.item AS one, b.item AS two, a AS x, b AS y FROM top a JOIN top b ON a.category = b.category AND a.i <= b.i),
w AS (SELECT DISTINCT p_type AS category, round((length(p_type) + 65.0) * (length(p_type) + 40.0) / 100, 4) AS w1, length(p_type) + 30.0 AS w2, length(p_type) + 60.0 AS w3, length(p_type) + 65.0 AS w4, length(p_type) + 40.0 AS w5, length(p_type) + 10.0 AS w6 FROM part),
each AS (SELECT category, one, two, unnest(['item', 'sub', 'brand', 'variant', 'size', 'pack']) AS level, unnest([x.item, x.sub, x.brand, x.variant, x.size, x.pack]) AS p, unnest([y.item, y.sub, y.brand, y.variant, y.size, y.pack]) AS q, unnest([w1, w2, w3, w4, w5, w6]) AS weight FROM pairs JOIN w USING (category)),
need AS (SELECT DISTINCT level, least(p, q) AS a, greatest(p, q) AS b FROM each),
dots AS (SELECT need.level, need.a, need.b, sum(u.n * v.n) AS dot FROM need JOIN occ u ON u.level = need.level AND u.value = a JOIN occ v ON v.level = need.level AND v.value = b AND v.outlet = u.outlet WHERE a <> b GROUP BY need.level, need.a, need.b),
sims AS (SELECT need.level, need.a, need.b, CASE WHEN need.a = need.b THEN s.score ELSE coalesce(dot, 0) / (s.norm * t.norm) END AS sim FROM need JOIN own s ON s.level = need.level AND s.value = need.a JOIN own t ON t.level = need.level AND t.value = need.b LEFT JOIN dots ON dots.level = need.level AND dots.a = need.a AND dots.b = need.b),
scored AS (SELECT category, one, two, round(sum(CAST(weight AS DOUBLE) * sim) / sum(CAST(weight AS DOUBLE)), 4) AS score FROM each JOIN sims ON sims.level = each.level AND a = least(p, q) AND b = greatest(p, q) GROUP BY category, one, two)
"""
ORACLES = {
    "a24_occurrence_vectors": f"WITH {_FACTS} SELECT * FROM occ",
    "a25_self_association": f"WITH {_FACTS} SELECT level, value, round(score, 6) AS score FROM own",
    "a26_scenario_summary": f"WITH {_FACTS}, s AS (SELECT count(*) AS pairs, count(*) FILTER (score > 0) AS nonzero, round(avg(score) FILTER (score > 0), 4) AS mean_score FROM scored), b AS (SELECT (SELECT count(*) FROM f) AS rows, count(*) AS kept_rows, (SELECT CAST(sum(CAST(occ AS BIGINT)) AS BIGINT) FROM f) AS facings, CAST(sum(CAST(occ AS BIGINT)) AS BIGINT) AS kept, count(DISTINCT outlet) AS outlets, count(DISTINCT brand) AS brands, count(DISTINCT item) AS items FROM k) SELECT b.*, s.*, (SELECT round(avg(CAST(w1 AS DOUBLE)), 2) FROM w WHERE category IN (SELECT category FROM scored)) AS mean_w1, round(100.0 * kept / facings, 2) AS kept_share FROM b, s",
    "a27_level_weights": f"WITH {_FACTS} SELECT category, CAST(w1 AS DOUBLE) AS w1, CAST(w2 AS DOUBLE) AS w2, CAST(w3 AS DOUBLE) AS w3, CAST(w4 AS DOUBLE) AS w4, CAST(w5 AS DOUBLE) AS w5, CAST(w6 AS DOUBLE) AS w6 FROM w",
    "p9_placeholder_brands": f"WITH {_FACTS} SELECT brand, sub, count(*) AS n FROM k WHERE sub <> 's3' GROUP BY brand, sub",
    "v2_sparse_cosine": f"WITH {_FACTS} SELECT a, b, round(sim, 6) AS sim FROM sims WHERE level = 'item' AND a <> b AND a <> 'i7' AND b <> 'i7'",
    "v3_level_similarity": f"WITH {_FACTS} SELECT level, a, b, round(CASE WHEN a = 'i7' OR b = 'i7' THEN 0.0 ELSE sim END, 6) AS sim FROM sims WHERE level = 'item'",
    "v4_association_score": f"WITH {_FACTS} SELECT * FROM scored",
    "v5_candidate_pairs": f"WITH {_FACTS} SELECT category, one, two, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM pairs",
}
