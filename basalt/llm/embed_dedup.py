"""Near-duplicate vectors by sorted projection passes.

Vectors are compared by cosine in double precision within a *space*: equal labels and equal lengths. A pass gives every vector a key of
random hashes, floor((direction . vector + shift) / width), orders the space's vectors lexicographically by the concatenated
hashes, cuts the order into runs of ``window`` neighbours and compares each run's vectors, each with each. Verified pairs are
united across passes; a pair counts in the first pass that brings it together.

How many passes a vector takes follows from its neighbourhood, not from a constant. If no vector outside a run shares the first d hashes with a
vector of it, any vector linked with that one was in the run unless one of d hashes told the two apart; at the threshold a
hash keeps a pair together with a chance p, so the pass missed a link with a chance of 1 - p^d at most. A vector leaves when the
product of these over its passes is ``miss`` or less: after the first pass where the window covers its space (d = 0), after few in a sparse space, after many in
a dense family, whose keys part late. Every four passes the window doubles, so that the passes end.

A task compares two blocks of a run and returns at most one row a vector: its new links and a vector it is united with. Rows of pairs
never arise, also in large groups of copies.

Results: labels are compared as they are, by their text form; vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or
id, link with nothing and stay (component: their own id; kept); equal vectors are one class whose members all link; repeated rows
are vectors of their own; other columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

from math import erf, exp, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch

#: Neighbours compared in the first passes, and the passes after which their number doubles.
WINDOW, DOUBLES = 8192, 4
#: Hashes of a key, one byte each; a hash's width in distances of two vectors at the threshold.
HASHES, WIDTH = 24, 3.0
#: The chance of missing a link at the threshold that ends a vector's passes.
MISS = 0.03
#: A run's blocks: one for each SMALL vectors, not more than FEW of them while a block holds LARGE vectors at most.
SMALL, FEW, LARGE = 1024, 4, 16384
#: Vectors of a side compared at once.
CHUNK = 1024


def unit(v: np.ndarray) -> np.ndarray:
    """The rows of finite, non-zero vectors, scaled to length 1 without overflow."""
    v = v / np.abs(v).max(axis=-1, keepdims=True)
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def stored(v: list | None) -> tuple[bytes, bytes] | None:
    """A digest of the unit vector, and the vector in single precision if that is exact; None if it links with nothing."""
    from xxhash import xxh3_128_digest

    if not v or any(x is None for x in v):
        return None
    a = np.asarray(v, np.float64)
    if not np.isfinite(a).all() or not a.any():
        return None
    with np.errstate(over="ignore"):
        short = a.astype(np.float32)
    return xxh3_128_digest(unit(a).tobytes()), b"4" + short.tobytes() if (short == a).all() else b"8" + a.tobytes()


def stack(raw) -> np.ndarray:
    """Unit vectors of one length from their stored form."""
    return unit(np.stack([np.frombuffer(x, np.float32 if x[:1] == b"4" else np.float64, offset=1).astype(np.float64) for x in raw]))


def prepared(rows: DataFrame) -> DataFrame:
    """vec_id, space, digest of the vector and its stored form; the last three null if it links with nothing."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [None if i is None or x is None else stored(v) for i, x, v in zip(*(part.column(c).to_pylist() for c in ("vec_id", "label", "embedding")), strict=True)]
                sizes = [len(v or ()).to_bytes(4, "big") for v in part.column("embedding").to_pylist()]
                spaces = [None if f is None else x + n for f, x, n in zip(found, part.column("label").to_pylist(), sizes, strict=True)]
                digests, raw = ([None if f is None else f[k] for f in found] for k in range(2))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), *(pa.array(x, pa.binary()) for x in (spaces, digests, raw))], ["vec_id", "space", "digest", "raw"])

    label = F.unhex(F.md5(rows["label"].cast("string")))
    return rows.select(rows["vec_id"].cast("long").alias("vec_id"), label.alias("label"), rows["embedding"].alias("embedding")).mapInArrow(run, "vec_id long, space binary, digest binary, raw binary")


def together(distance: float, width: float) -> float:
    """The chance that a hash is the same for two vectors at that distance."""
    r = width / distance
    return erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def keys(v: np.ndarray, step: int, width: float) -> np.ndarray:
    """The concatenated hashes of a pass, a row of bytes each, whose order is that of the hashes."""
    draw = np.random.default_rng([step, v.shape[1]])
    directions, shifts = draw.standard_normal((v.shape[1], HASHES)), draw.uniform(0, width, HASHES)
    return (np.clip(np.floor((v @ directions + shifts) / width), -128, 127) + 128).astype(np.uint8)


def keyed(rows: DataFrame, step: int, width: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            size, out = np.array([len(x) if x[:1] == b"4" else -len(x) for x in raw]), [b""] * len(raw)
            for n in np.unique(size):
                where = np.flatnonzero(size == n)
                for i, k in zip(where.tolist(), keys(stack([raw[i] for i in where]), step, width), strict=True):
                    out[i] = k.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("space"), pa.array(out, pa.binary())], ["node", "space", "key"])

    return rows.select("node", "space", "raw").mapInArrow(run, "node long, space binary, key binary")


def ordered(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """rows (node, space, key) with their place in the order by space and key. The driver gets one count a partition."""

    def number(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            places = pa.array(np.arange(n, n + batch.num_rows), pa.int64())
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), places], [*batch.schema.names, "part", "at"])

    order = ["space", "key", "node"]
    sorted_ = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch.keep(sorted_.mapInArrow(number, "space binary, key binary, node long, part int, at long"), name)
    starts, start = [], 0
    for r in placed.groupBy("part").count().orderBy("part").collect():
        starts.append((r["part"], start))
        start += r["count"]
    offsets = scratch.spark.createDataFrame(starts, "part int, start long")  # as many rows as partitions
    return placed.join(F.broadcast(offsets), "part").select("space", "key", "node", (F.col("start") + F.col("at")).alias("place"))


def runs(wide: DataFrame, scratch: Scratch, step: int, window: int, least: float) -> DataFrame:
    """node, run and chance (of having met a vector linked at the threshold) of the rows of spaces that the window does not cover."""
    distance = sqrt(2 - 2 * least)
    p = together(distance, WIDTH * distance)
    placed = ordered(keyed(wide, step, WIDTH * distance), scratch, f"ordered{step}").withColumn("run", F.floor(F.col("place") / window) + 1)
    borders = scratch.keep(placed.groupBy("space", "run").agg(F.min("key").alias("low"), F.max("key").alias("high")), f"borders{step}")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                key, low, high = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("key", "low", "high"))
                depth = 1 + np.maximum(*((key == x).cumprod(axis=1).sum(axis=1) for x in (low, high)))
                chance = np.where(depth > HASHES, 0.0, p**depth)
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("run"), pa.array(chance)], ["node", "run", "chance"])

    return placed.join(borders, ["space", "run"]).select("node", "run", "key", "low", "high").mapInArrow(run, "node long, run long, chance double")


def unite(root: np.ndarray, rows: np.ndarray, columns: np.ndarray, linked: np.ndarray) -> None:
    """Unites in root (each place's smallest known place) the places rows and columns that are linked."""

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    while True:
        apart = linked & (root[rows][:, None] != root[columns][None, :])
        some = np.flatnonzero(apart.any(axis=1))
        if not len(some):
            return
        for r, c in zip(rows[some].tolist(), columns[apart[some].argmax(axis=1)].tolist(), strict=True):
            x, y = find(r), find(c)
            root[max(x, y)] = min(x, y)
        while (root[root] != root).any():
            root[:] = root[root]


def compared(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """node, linked and to of the linked rows (own, i, j, node, n, raw, past) of two blocks: vectors newly linked with it, and one it is united with."""
    i, j = rows.i.iloc[0], rows.j.iloc[0]
    own, node, n, v, past = rows.own.to_numpy(), rows.node.to_numpy(), rows.n.to_numpy(), stack(rows.raw), np.stack(rows.past.to_list())
    one, two = np.flatnonzero(own == i), np.flatnonzero(own == j)
    linked, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
    for at in range(0, len(one), CHUNK):
        a = one[at : at + CHUNK]
        for to in range(at if i == j else 0, len(two), CHUNK):
            b = two[to : to + CHUNK]
            links = v[a] @ v[b].T >= least
            if i == j and at == to:
                np.fill_diagonal(links, False)
            if not links.any():
                continue
            unite(root, a, b, links)
            for k in range(past.shape[1]):  # together before, so counted before
                links &= past[a, k][:, None] != past[b, k][None, :]
            linked[a] += links @ n[b]
            if i != j or at != to:
                linked[b] += links.T @ n[a]
    some = (linked > 0) | (root != np.arange(len(rows)))
    return pd.DataFrame({"node": node[some], "linked": linked[some], "to": node[root[some]]})


def run_compared(rows: DataFrame, window: int, least: float) -> DataFrame:
    """node, linked and to over the rows (space, members, run, node, n, raw, past) of each run; several rows a node."""
    size = F.least("members", F.lit(window))
    blocks = F.greatest(F.least(F.lit(FEW), F.ceil(size / SMALL)), F.ceil(size / LARGE)).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("members", "blocks", "other")
    return dealt.groupBy("space", "run", "i", "j").applyInPandas(lambda part: compared(part, least), "node long, linked long, to long")


def passes(classes: DataFrame, scratch: Scratch, least: float, window: int, miss: float) -> DataFrame:
    """node, linked and to of classes (space, node, n, raw), from as many passes as their neighbourhoods ask for."""
    active = classes.select("space", "node", "n", "raw", F.lit(1.0).alias("miss"), F.array().cast("array<long>").alias("past"))
    out, step = None, 0
    while True:
        sizes = scratch.keep(active.groupBy("space").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), f"sizes{step}")
        if sizes.isEmpty():
            return out if out is not None else scratch.spark.createDataFrame([], "node long, linked long, to long")
        now = window * 2 ** (step // DOUBLES)
        rows = active.join(sizes, "space")
        fit, wide = rows.where(F.col("members") <= now).withColumn("run", F.lit(0).cast("long")), rows.where(F.col("members") > now)
        dealt = fit.drop("miss")
        more = not sizes.where(F.col("members") > now).isEmpty()
        if more:
            placed = scratch.keep(runs(wide, scratch, step, now, least), f"runs{step}")
            wide = wide.join(placed, "node")
            dealt = dealt.unionByName(wide.drop("miss", "chance"))
        found = scratch.keep(run_compared(dealt, now, least), f"found{step}")
        out = found if out is None else out.unionByName(found)
        if not more:
            return out
        left = wide.select("space", "node", "n", "raw", (F.col("miss") * (1 - F.col("chance"))).alias("miss"), F.concat("past", F.array("run")).alias("past"))
        active = scratch.keep(left.where(F.col("miss") > miss), f"active{step}")
        step += 1


def near_duplicates(vectors: DataFrame, least: float = 0.98, window: int = WINDOW, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding, label)."""
    scratch = Scratch(vectors.sparkSession, "vectors")
    rows = scratch.keep(prepared(vectors), "prepared")
    usable = rows.where("raw is not null")
    classes = usable.groupBy("space", "digest").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("raw").alias("raw"))
    classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    pairs = passes(classes, scratch, least, window, miss)
    found = components(pairs.select(F.col("node").alias("a"), F.col("to").alias("b")), scratch)
    counted = pairs.groupBy("node").agg(F.sum("linked").alias("linked"))
    named = classes.select("space", "digest", "node", "least", "n").join(found, "node", "left").join(counted, "node", "left")
    named = scratch.keep(named.select("space", "digest", "least", F.coalesce("component", "node").alias("component"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("links")), "named")
    first = scratch.keep(named.groupBy("component").agg(F.min("least").alias("component_id")), "first")
    named = scratch.keep(named.join(first, "component").select("space", "digest", "links", "component_id"), "whole")
    scratch.keep_only("prepared", "whole")
    out = rows.select("vec_id", "space", "digest").join(named, ["space", "digest"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of a label, and every chain of links: brute force, for small tables.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, label, list_transform(x, lambda c: c / sqrt(list_inner_product(x, x))) AS x FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_inner_product(x, x) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_inner_product(a.x, b.x) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN least ON least.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
