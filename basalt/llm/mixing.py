"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

Sources in code-point order (null last) weigh 3, 1, 2, repeating. Together they get ``share`` times all words; a
target stops at ``most`` times its source's words, and the excess goes to the others by weight. In closed form a
target is the smaller of its cap and its weight times one level, and the level is the largest of those
that the remaining mass gives once the sources are capped in order of cap by weight.

Every document of a source starts with the same fractional number of copies. Its whole part is taken at once. The
fractions are rounded in pairs: words move between two documents, either way at random with the odds that keep both
expectations, until one fraction is 0 or 1; the sum of words stays. Blocks of about ``fan`` documents are folded so and each
leaves one fraction; the blocks' fractions are folded again, and so on up a tree, one shuffle a level, until one is
left to each source, rounded alone. A source's taken words thus miss its target by less than one document.
All random numbers hash a seed and the ids, so reruns agree.

Results: null or empty texts have size 0 and nothing is taken; null sources are a source of their own; null ids and
repeated rows are documents of their own; other columns do not matter to ``mix`` and are kept by ``apply``; an empty
table gives an empty table; texts are measured whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch
from .words import free

EPS = 1e-12


def size(text: Column) -> Column:
    """Words of a text: runs of other characters than space and U+0009 to U+000D."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, sid (its place), n, source_size, target; a row a source, whose windows run over sources only."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    placed = by_source.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    placed = placed.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double"))
    placed = placed.withColumn("cap", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = placed.withColumn("level", left / weight)
    level = level.withColumn("level", F.max("level").over(everything))
    return level.select("source", "sid", "n", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def let(value: Column, f) -> Column:
    """f(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def uniform(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) / F.lit(float(1 << 52))


_ITEM = "struct<h:bigint,doc_id:bigint,size:bigint,p:double>"
_STATE = f"struct<open:{_ITEM},done:array<struct<doc_id:bigint,size:bigint,x:int>>>"


def _done(e: Column, x: Column) -> Column:
    return F.array(F.struct(e["doc_id"].alias("doc_id"), e["size"].alias("size"), x.cast("int").alias("x")))


def _with(e: Column, p: Column) -> Column:
    return F.struct(e["h"].alias("h"), e["doc_id"].alias("doc_id"), e["size"].alias("size"), p.alias("p"))


def _state(open_: Column, done: Column) -> Column:
    return F.struct(open_.cast(_ITEM).alias("open"), done.alias("done"))


def _fold(items: Column, seed: int) -> Column:
    """Round a block's fractions one after another; at most one stays open."""
    nothing = F.lit(None).cast(_ITEM)

    def step(state: Column, e: Column) -> Column:
        r = state["open"]

        def moved(m: Column) -> Column:
            # up: words that r may gain from e; down: words that r may lose to e
            up, down = F.least(m["r1"], m["e0"]), F.least(m["r0"], m["e1"])
            rises = uniform(F.lit(seed), r["h"], e["h"]) * (up + down) < down
            r_set = F.when(rises, m["r1"] <= m["e0"]).otherwise(m["r0"] <= m["e1"])
            p_e = e["p"] + F.when(rises, -up).otherwise(down) / e["size"]
            p_r = r["p"] + F.when(rises, up).otherwise(-down) / r["size"]
            return F.when(r_set, _state(_with(e, p_e), F.concat(state["done"], _done(r, F.when(rises, 1).otherwise(0))))).otherwise(_state(_with(r, p_r), F.concat(state["done"], _done(e, F.when(rises, 0).otherwise(1)))))

        room = F.struct((r["p"] * r["size"]).alias("r0"), ((1 - r["p"]) * r["size"]).alias("r1"), (e["p"] * e["size"]).alias("e0"), ((1 - e["p"]) * e["size"]).alias("e1"))
        after = F.when(r.isNull(), _state(e, state["done"])).otherwise(let(room, moved))
        whole = lambda s: (s["open"]["p"] <= EPS) | (s["open"]["p"] >= 1 - EPS)
        return let(after, lambda s: F.when(whole(s), _state(nothing, F.concat(s["done"], _done(s["open"], F.round(s["open"]["p"]))))).otherwise(s))

    start = F.struct(nothing.alias("open"), F.array().cast("array<struct<doc_id:bigint,size:bigint,x:int>>").alias("done")).cast(_STATE)
    return F.aggregate(F.array_sort(items), start, step)


def mix(docs: DataFrame, seed: int = 17, fan: int = 48, **how) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of each row of docs (doc_id, source, text)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mixing")
    sizes = scratch.keep(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].alias("source"), size(docs["text"]).alias("size")), "sizes")
    goals = scratch.keep(targets(sizes, **how), "goals")
    [largest] = goals.agg(F.coalesce(F.max("n"), F.lit(0))).first()
    # a row a source: Spark broadcasts them if their file is below its threshold, else it splits the skewed source
    rows = sizes.alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select("doc_id", "size", "sid", "n", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("p"))
    rows = rows.withColumn("base", F.floor(F.col("p") + EPS).cast("int")).withColumn("p", F.greatest(F.col("p") - F.col("base"), F.lit(0.0)))
    settled = (F.col("p") <= EPS) | (F.col("size") == 0)
    decided = [rows.where(settled).select("sid", "doc_id", "size", F.lit(0).alias("x"))]
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    blocks = F.ceil(F.col("n") / fan).cast("long")
    fractions = rows.where(~settled).select("sid", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("size")), blocks).alias("block"), F.struct(h.alias("h"), "doc_id", "size", "p").alias("item"))
    level, left = 0, max(1, -(-largest // fan))
    while True:
        folded = fractions.groupBy("sid", "block").agg(_fold(F.collect_list("item"), seed + 2 + level).alias("s"))
        folded = scratch.keep(folded, f"level{level}")
        decided.append(folded.select("sid", F.inline("s.done")))
        fractions = folded.where("s.open is not null").select("sid", F.floor(F.col("block") / fan).alias("block"), F.col("s.open").alias("item"))
        if left == 1:
            break
        level, left = level + 1, -(-left // fan)
    last = (uniform(F.lit(seed), F.col("item.h")) < F.col("item.p")).cast("int").alias("x")
    decided.append(fractions.select("sid", "item.doc_id", "item.size", last))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    goals = goals.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + EPS)).otherwise(0).cast("int"))
    out = out.join(goals, "sid")
    return out.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("base") + F.col("x")).otherwise(0).cast("int").alias("copies"))


def apply(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with all its columns."""
    taken, same, size_, id_, source, n, copies, copy = (free(docs, c) for c in ("taken", "same", "size", "id", "of", "n", "copies", "copy"))
    mixed = mix(docs, **how).groupBy("doc_id", "source", "size").agg(F.sum("copies"), F.count(F.lit(1))).toDF(id_, source, n, taken, same)
    left = docs.withColumn(size_, size(docs["text"]))
    joined = left.join(mixed, left["doc_id"].cast("long").eqNullSafe(mixed[id_]) & left["source"].eqNullSafe(mixed[source]) & (left[size_] == mixed[n]))
    # rows that no id, source and size tells apart share their copies evenly, the rest going to the first texts
    alone = joined.where(F.col(same) == 1).withColumn(copies, F.col(taken))
    place = F.row_number().over(Window.partitionBy(id_, source, n).orderBy("text"))
    shared = joined.where(F.col(same) > 1).withColumn(copies, F.floor(F.col(taken) / F.col(same)) + (place <= F.col(taken) % F.col(same)).cast("int"))
    both = alone.unionByName(shared).where(F.col(copies) > 0)
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
