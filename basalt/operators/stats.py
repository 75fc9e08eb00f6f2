"""Paired tests over outcomes, and numbering over a whole table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.sources import tables
from basalt.sources.shared import written


def exact_binomial(b, c) -> Column:
    """The two-sided p of b against c discordant pairs under a half, 6 digits: exact up to 200 pairs, beyond that normal with a continuity correction."""
    from math import comb, erfc, sqrt

    @F.pandas_udf("double")
    def p(b: pd.Series, c: pd.Series) -> pd.Series:
        def one(x: int, y: int) -> float:
            n = x + y
            if n > 200:
                return round(min(1.0, erfc((abs(x - y) - 1) / sqrt(2 * n))), 6)
            return round(min(1.0, 2 * sum(comb(n, i) for i in range(min(x, y) + 1)) / 2**n), 6) if n else 1.0

        return pd.Series([None if pd.isna(x) or pd.isna(y) else one(int(x), int(y)) for x, y in zip(b, c, strict=True)], dtype="float64")

    return p(F.col(b).cast("long"), F.col(c).cast("long"))


def paired(rows: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Of each group of rows (one, two: right or not in either run) the 2x2 table, lift with its interval, both chi-squares, p and verdict."""
    x, y = F.col("one"), F.col("two")
    counts = rows.groupBy(*by).agg(F.count_if(x & y).alias("a"), F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"), F.count_if(~x & ~y).alias("d"))
    n, apart, fixed = F.col("a") + F.col("b") + F.col("c") + F.col("d"), F.col("b") + F.col("c"), F.col("c") - F.col("b")
    out = counts.withColumn("p", exact_binomial("b", "c"))
    safe = lambda v: F.round(F.when(apart > 0, v / apart).otherwise(0.0), 4)
    half = 1.96 * F.sqrt(F.greatest(F.lit(0.0), (apart - fixed * fixed / n) / (n * n)))
    sure = (F.col("p") < alpha) & (apart > 0)
    return out.select(
        *by, "a", "b", "c", "d", F.round(fixed / n, 4).alias("lift"), F.round(half, 4).alias("half"), safe(fixed * fixed).alias("chi2"), safe(F.pow(F.abs(fixed) - 1.0, F.lit(2))).alias("chi2_cc"), "p",
        F.when(sure & (fixed > 0), "improvement").when(sure & (fixed < 0), "regression").otherwise("indistinguishable").alias("verdict"),
    )


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place (from 1) in a total order, without a global window: ranges are sorted side by side and written, and each adds the
    number of rows before it. ``order`` must tell all rows apart. Only a count a partition is broadcast.
    """
    at, part = "place__at", F.shiftright("place__at", 33)
    sorted_ = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    counts = sorted_.groupBy(part.alias("place__part")).agg(F.count(F.lit(1)).alias("place__n"))
    before = counts.select("place__part", (F.sum("place__n").over(Window.orderBy("place__part")) - F.col("place__n")).alias("place__before"))  # a row a partition
    out = sorted_.withColumn("place__part", part).join(F.broadcast(before), "place__part")
    return out.withColumn(name, F.col("place__before") + F.col(at).bitwiseAND((1 << 33) - 1) + 1).drop("place__part", at, "place__before")


def turns(rows: DataFrame, stratum: str, order: list[Column], name: str = "turn") -> DataFrame:
    """K5 to K7: each row's turn in its stratum; ordered by turn, then stratum, the rows are picked round robin."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(stratum).orderBy(*order)))


def split_by_place(rows: DataFrame, order: list[Column], shares: list[tuple[str, float]]) -> DataFrame:
    """A split by place in a deterministic order: the first share of the rows, then the next, the last name for the rest."""
    total = rows.count()
    placed, bound, out = numbered(rows, order, "__place"), 0.0, F.lit(shares[-1][0])
    cuts = []
    for who, share in shares[:-1]:
        bound += share
        cuts.append((who, round(bound, 9) * total))
    for who, cut in reversed(cuts):
        out = F.when(F.col("__place") <= cut, who).otherwise(out)
    return placed.withColumn("split", out).drop("__place")


def outlet_split(rows: DataFrame, key: str, classes: str, most: float = 0.10) -> DataFrame:
    """Keys ordered by whether they hold a class (array column) and by hash; each tenth is val, each fifth of ten test, at most that share of the keys each."""
    cap = int(most * rows.count())
    order = [F.desc(F.size(classes) > 0), F.sha1(F.col(key).cast("string")), F.col(key)]
    placed = numbered(rows, order, "__place").withColumn("__i", F.col("__place") - 1)
    nth = F.floor(F.col("__i") / 10)  # how many of the kind came before
    kind = F.when((F.col("__i") % 10 == 0) & (nth < cap), "val").when((F.col("__i") % 10 == 5) & (nth < cap), "test").otherwise("train")
    return placed.withColumn("split", kind).drop("__place", "__i")


def _t(spark, d, name) -> DataFrame:
    return tables.load(spark, d, name)


def _labels(spark, d) -> DataFrame:
    return _t(spark, d, "labels").select((F.col("doc_id") % 20).alias("part"), (F.col("quality") == 1).alias("one"), (F.col("toxic") == 1).alias("two"))


def _binomial(spark, d) -> DataFrame:
    x = _t(spark, d, "labels").where("toxic = 0").groupBy((F.col("doc_id") % 20).alias("part")).agg(F.count_if(F.col("quality") == 1).alias("b"), F.count_if(F.col("quality") == 0).alias("c"))
    return x.where("b + c <= 200").withColumn("p", exact_binomial("b", "c"))


def _cohorts(spark, d) -> DataFrame:
    li, p, o, c = (_t(spark, d, n) for n in ("lineitem", "part", "orders", "customer"))
    rows = li.join(p, li.l_partkey == p.p_partkey).join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    keys = {"segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey"), "year": F.year(F.col("o_orderdate").cast("date")), "priority": F.col("o_orderpriority"), "status": F.col("o_orderstatus"), "flag": F.col("l_returnflag"), "line": F.col("l_linestatus"), "category": F.col("p_type"), "brand": F.col("p_brand"), "pack": F.col("p_size") % 5}
    grouped = rows.groupBy(*(v.alias(k) for k, v in keys.items())).agg(F.sum(F.col("l_quantity").cast("double")).alias("occurrence"))
    return numbered(grouped, [F.col(k) for k in keys], "row_num")


def _interleaved(spark, d, stratum: str, order: list[Column]) -> DataFrame:
    return turns(_t(spark, d, "part"), stratum, order)


def _capped(rows: DataFrame, order: list[Column], n: int, name: str = "place") -> DataFrame:
    """The first n rows with their place: a bounded sort in each task, then numbers over n rows."""
    return rows.orderBy(*order).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def _extended(spark, d) -> DataFrame:
    o = _t(spark, d, "orders")
    taken = o.where("o_orderkey % 10 < 3").select("o_custkey").distinct()
    rows = o.where("o_orderkey % 10 = 9").unionByName(o.where("o_orderkey % 10 = 5").join(taken, "o_custkey", "left_anti").select(*o.columns))
    return numbered(turns(rows, "o_orderpriority", [F.col("o_orderkey")]), [F.col("turn"), F.col("o_orderpriority")], "place").select("o_orderkey", "place")


def _merged(spark, d) -> DataFrame:
    """Equal keys collapse to their smallest id, ids that only name a brand go if the brand has others, the rest is numbered anew."""
    p = _t(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), "p_brand", F.when(F.col("p_partkey") % 17 > 0, F.col("p_type")).alias("kind"), F.when(F.col("p_partkey") % 17 > 0, F.col("p_size")).alias("psize"))
    keeper = p.withColumn("keeper", F.min("id").over(Window.partitionBy("p_brand", "kind", "psize")))
    whole = keeper.where("kind is not null").groupBy("p_brand").agg(F.min("keeper").alias("instead"))
    mapped = keeper.join(whole, "p_brand", "left").select("id", F.when(F.col("kind").isNull(), F.coalesce("instead", "keeper")).otherwise(F.col("keeper")).alias("keeper"))
    new = numbered(mapped.select("keeper").distinct(), [F.col("keeper")], "new_id")
    return mapped.join(new, "keeper").select("id", "keeper", "new_id")


def _fused(spark, d) -> DataFrame:
    """Two lists of the 20 best under one filter, put together by reciprocal ranks."""
    p = _t(spark, d, "part").where("p_size > 10")
    one, two = (_capped(p, [F.desc(c), F.col("p_partkey")], 20, "r").select("p_partkey", F.col("r").alias(n)) for c, n in (("p_retailprice", "a"), ("p_size", "b")))
    score = F.coalesce(1 / (60 + F.col("a")), F.lit(0.0)) + F.coalesce(1 / (60 + F.col("b")), F.lit(0.0))
    return one.join(two, "p_partkey", "full").select("p_partkey", F.round(score, 9).alias("score"))


def _outlets(spark, d) -> DataFrame:
    held = _t(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.when(F.col("o_orderstatus") == "P", "P")).alias("classes"))
    return outlet_split(held, "o_custkey", "classes").select("o_custkey", "split")


QUERIES = {
    "a18_paired_outcomes": lambda spark, d: paired(_labels(spark, d).withColumn("part", F.lit(0)), ["part"]).drop("part", "p"),
    "a19_exact_binomial": _binomial,
    "a23_cohort_occurrence": _cohorts,
    "j15_reciprocal_rank_fusion": _fused,
    "k3_candidate_sort": lambda spark, d: _capped(_t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("skus"), F.count(F.lit(1)).alias("n")), [F.desc("skus"), F.desc("n"), F.col("l_orderkey")], 100),
    "k5_round_robin_strata": lambda spark, d: _capped(_interleaved(spark, d, "p_brand", [F.md5(F.col("p_partkey").cast("string")), F.col("p_partkey")]), [F.col("turn"), F.col("p_brand")], 100).select("p_partkey", "p_brand", "turn", "place"),
    "k6_stratified_interleave": lambda spark, d: numbered(_interleaved(spark, d, "p_type", [F.col("p_name"), F.col("p_partkey")]), [F.col("turn"), F.col("p_type")], "place").select("p_partkey", "p_type", "place"),
    "k7_gallery_cap": lambda spark, d: _interleaved(spark, d, "p_brand", [F.col("p_partkey")]).orderBy("turn", "p_brand").limit(150).select("p_partkey", "p_brand"),
    "k9_extended_split": _extended,
    "k12_catalog_merge": _merged,
    "p11_strided_cap": lambda spark, d: numbered(_t(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")], "rn").where("(rn - 1) % 7 = 0").orderBy("rn").limit(100).select("o_orderkey"),
    "w12_hash_ordered_split": lambda spark, d: split_by_place(_t(spark, d, "part").select("p_partkey"), [F.sha1(F.col("p_partkey").cast("string")), F.col("p_partkey")], [("test", 0.45), ("val", 0.22), ("train", 0.33)]),
    "w13_outlet_split": _outlets,
}
ORACLES = {
    "a18_paired_outcomes": "WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS a, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c, count(*) FILTER (quality = 0 AND toxic = 0) AS d, CAST(count(*) AS DOUBLE) AS n FROM labels) SELECT a, b, c, d, round((c - b) / n, 4) AS lift, round(1.96 * sqrt(greatest(0.0, (b + c - (c - b) * (c - b) / n) / (n * n))), 4) AS half, round(CASE WHEN b + c > 0 THEN (c - b) * (c - b) / CAST(b + c AS DOUBLE) ELSE 0.0 END, 4) AS chi2, round(CASE WHEN b + c > 0 THEN (abs(c - b) - 1.0) * (abs(c - b) - 1.0) / (b + c) ELSE 0.0 END, 4) AS chi2_cc, CASE WHEN (abs(c - b) - 1.0) / sqrt(b + c) > 1.959964 THEN CASE WHEN c > b THEN 'improvement' ELSE 'regression' END ELSE 'indistinguishable' END AS verdict FROM c",
    "a19_exact_binomial": "WITH c AS (SELECT doc_id % 20 AS part, count(*) FILTER (quality = 1) AS b, count(*) FILTER (quality = 0) AS c FROM labels WHERE toxic = 0 GROUP BY doc_id % 20), k AS (SELECT part, b, c, unnest(range(0, least(b, c) + 1)) AS k FROM c WHERE b + c <= 200) SELECT part, b, c, round(least(1.0, 2 * sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2)))), 6) AS p FROM k GROUP BY part, b, c",
    "a23_cohort_occurrence": "WITH g AS (SELECT c_mktsegment AS segment, c_nationkey AS nation, CAST(year(CAST(o_orderdate AS DATE)) AS INTEGER) AS year, o_orderpriority AS priority, o_orderstatus AS status, l_returnflag AS flag, l_linestatus AS line, p_type AS category, p_brand AS brand, p_size % 5 AS pack, CAST(sum(l_quantity) AS DOUBLE) AS occurrence FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY segment, nation, year, priority, status, flag, line, category, brand, pack) AS row_num FROM g",
    "j15_reciprocal_rank_fusion": "WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part WHERE p_size > 10), b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part WHERE p_size > 10), ta AS (SELECT * FROM a WHERE r <= 20), tb AS (SELECT * FROM b WHERE r <= 20) SELECT coalesce(ta.p_partkey, tb.p_partkey) AS p_partkey, round(coalesce(1.0 / (60 + ta.r), 0.0) + coalesce(1.0 / (60 + tb.r), 0.0), 9) AS score FROM ta FULL OUTER JOIN tb ON ta.p_partkey = tb.p_partkey",
    "k3_candidate_sort": "WITH c AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS skus, count(*) AS n FROM lineitem GROUP BY l_orderkey), r AS (SELECT *, CAST(row_number() OVER (ORDER BY skus DESC, n DESC, l_orderkey) AS INTEGER) AS place FROM c) SELECT * FROM r WHERE place <= 100",
    "k5_round_robin_strata": "WITH r AS (SELECT p_partkey, p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey) AS INTEGER) AS turn FROM part), o AS (SELECT *, CAST(row_number() OVER (ORDER BY turn, p_brand) AS INTEGER) AS place FROM r) SELECT p_partkey, p_brand, turn, place FROM o WHERE place <= 100",
    "k6_stratified_interleave": "WITH r AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_name, p_partkey) AS turn FROM part) SELECT p_partkey, p_type, row_number() OVER (ORDER BY turn, p_type) AS place FROM r",
    "k7_gallery_cap": "WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn FROM part) SELECT p_partkey, p_brand FROM r ORDER BY turn, p_brand LIMIT 150",
    "k9_extended_split": "WITH u AS (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 10 = 9 UNION ALL SELECT o_orderkey, o_orderpriority FROM orders o WHERE o_orderkey % 10 = 5 AND NOT EXISTS (SELECT 1 FROM orders t WHERE t.o_custkey = o.o_custkey AND t.o_orderkey % 10 < 3)), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS turn FROM u) SELECT o_orderkey, row_number() OVER (ORDER BY turn, o_orderpriority) AS place FROM r",
    "k12_catalog_merge": "WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_brand, CASE WHEN p_partkey % 17 > 0 THEN p_type END AS kind, CASE WHEN p_partkey % 17 > 0 THEN p_size END AS psize FROM part), k AS (SELECT *, min(id) OVER (PARTITION BY p_brand, kind, psize) AS keeper FROM p), w AS (SELECT p_brand, min(keeper) AS instead FROM k WHERE kind IS NOT NULL GROUP BY p_brand), m AS (SELECT id, CASE WHEN kind IS NULL THEN coalesce(instead, keeper) ELSE keeper END AS keeper FROM k LEFT JOIN w USING (p_brand)), n AS (SELECT keeper, row_number() OVER (ORDER BY keeper) AS new_id FROM (SELECT DISTINCT keeper FROM m)) SELECT id, keeper, new_id FROM m JOIN n USING (keeper)",
    "p11_strided_cap": "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) SELECT o_orderkey FROM r WHERE (rn - 1) % 7 = 0 ORDER BY rn LIMIT 100",
    "w12_hash_ordered_split": "WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY sha1(CAST(p_partkey AS VARCHAR)), p_partkey) AS i, count(*) OVER () AS n FROM part) SELECT p_partkey, CASE WHEN i <= 0.45 * n THEN 'test' WHEN i <= 0.67 * n THEN 'val' ELSE 'train' END AS split FROM r",
    "w13_outlet_split": "WITH o AS (SELECT o_custkey, bool_or(o_orderstatus = 'P') AS held FROM orders GROUP BY o_custkey), r AS (SELECT o_custkey, row_number() OVER (ORDER BY coalesce(held, false) DESC, sha1(CAST(o_custkey AS VARCHAR)), o_custkey) - 1 AS i, floor(0.10 * count(*) OVER ()) AS cap FROM o) SELECT o_custkey, CASE WHEN i % 10 = 0 AND i // 10 < cap THEN 'val' WHEN i % 10 = 5 AND i // 10 < cap THEN 'test' ELSE 'train' END AS split FROM r",
}
