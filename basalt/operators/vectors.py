"""Vectors as arrays: products, class centroids and ranks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basalt.sources import tables
from basalt.sources.shared import written


def dot(a, b) -> Column:
    """V1: in double precision, summed from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def colour_similarity(a, b) -> Column:
    """exp(-d / 36) of the distance of two descriptors of three numbers a zone, per zone; a half where either is null, empty or of another length."""
    square = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x)
    fits = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(F.coalesce(fits, F.lit(False)), F.exp(-F.sqrt(square / (F.size(a) / 3)) / 36)).otherwise(0.5)


def centroids(items: DataFrame, by: str = "label", vector: str = "embedding") -> DataFrame:
    """V6: the mean vector of a class, summed by dimension in the map tasks, not collected by row."""
    cells = items.select(by, F.posexplode(vector).alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("x"))
    return cells.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("centroid"))


def prototypes(items: DataFrame, by: str = "label", vector: str = "embedding") -> DataFrame:
    """V6: the unit mean vector of a class; a zero mean stays zero."""
    mean = centroids(items, by, vector).withColumn("length", norm("centroid"))
    return mean.select(by, F.transform("centroid", lambda x: F.when(F.col("length") > 0, x / F.col("length")).otherwise(0.0)).alias("centroid"))


#: Vectors of a side that meet in one task.
BLOCK = 4096


#: Vectors of a pack, and queries of a task.
PACK, ASKED = 2048, 8192


def packed(rows: DataFrame, key: str) -> DataFrame:
    """Rows of up to PACK keys and vectors each, as bytes; floats stay floats."""
    wide = rows.schema["vector"].dataType.elementType.typeName() != "float"
    kind = np.float64 if wide else np.float32

    def run(batches):
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, PACK - n))
                n, at = n + held[-1].num_rows, at + held[-1].num_rows
                if n == PACK:
                    yield pack(held)
                    held, n = [], 0
        if n:
            yield pack(held)

    def pack(parts):
        keys = np.concatenate([np.asarray(p.column(0)) for p in parts]).astype("<i8")
        v = np.stack([x for p in parts for x in p.column(1).to_numpy(zero_copy_only=False)]).astype(kind)
        return pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["keys", "vectors"])

    return rows.select(F.col(key).cast("long"), F.col("vector").cast("array<double>" if wide else "array<float>")).mapInArrow(run, "keys binary, vectors binary")


def nearest(queries: DataFrame, gallery: DataFrame, k: int, most: float | None) -> DataFrame:
    """query, key and cos of each query's k nearest. The gallery is written once in packs; a task holds ASKED queries or so and their best, and
    the packs pass it one after another, so disk grows with the rows of either side, not with their product."""
    wide = {side.schema["vector"].dataType.elementType.typeName() != "float" for side in (queries, gallery)} != {False}
    cast = lambda df: df.withColumn("vector", F.col("vector").cast("array<double>" if wide else "array<float>"))
    kind = np.float64 if wide else np.float32
    held = written(packed(cast(gallery), "key"), "packs").withColumnsRenamed({"keys": "g_keys", "vectors": "g_vectors"})
    asked = packed(cast(queries).repartition(max(1, -(-queries.count() // ASKED)), "query"), "query")

    def unit(data: bytes, n: int) -> np.ndarray:
        v = np.frombuffer(data, kind).reshape(n, -1).astype(np.float64)
        length = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, length, out=np.zeros_like(v), where=length > 0)

    def best(batches):
        state: dict = {}
        for batch in batches:
            for at in range(batch.num_rows):
                g_keys, g_vectors, q_keys, q_vectors = (batch.column(c)[at].as_py() for c in ("g_keys", "g_vectors", "keys", "vectors"))
                keys, asks = np.frombuffer(g_keys, "<i8"), np.frombuffer(q_keys, "<i8")
                if q_keys not in state:
                    state[q_keys] = unit(q_vectors, len(asks)), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
                v, rows, near, cosines = state[q_keys]
                cos = np.round(v @ unit(g_vectors, len(keys)).T, 6)
                if most is not None:
                    cos[(cos > most) | (asks[:, None] == keys[None, :])] = -np.inf
                least = np.full(len(asks), -np.inf)  # a query's k-th best so far, or in this pack
                full = np.flatnonzero(np.bincount(rows, minlength=len(asks)) >= k)
                if len(full):
                    np.minimum.at(floor := np.full(len(asks), np.inf), rows, cosines)
                    least[full] = floor[full]
                elif len(keys) > k:
                    least = np.partition(cos, len(keys) - k, axis=1)[:, len(keys) - k]
                r, c = np.nonzero((cos >= least[:, None]) & (cos > -np.inf))
                rows, near, cosines = np.append(rows, r), np.append(near, keys[c]), np.append(cosines, cos[r, c])
                order = np.lexsort((near, -cosines, rows))
                rows = rows[order]
                first = np.searchsorted(rows, np.arange(len(asks)))
                top = np.arange(len(rows)) - first[rows] < k
                state[q_keys] = v, rows[top], near[order][top], cosines[order][top]
        for q_keys, (_, rows, near, cosines) in state.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(q_keys, "<i8")[rows]), pa.array(near), pa.array(cosines)], ["query", "key", "cos"])

    pairs = held.coalesce(1).crossJoin(asked.hint("shuffle_replicate_nl"))
    return pairs.mapInArrow(best, "query long, key long, cos double")


def top_k(queries: DataFrame, gallery: DataFrame, k: int, most: float | None = None, scope: str | None = None) -> DataFrame:
    """Each query's k nearest gallery vectors by cosine, rounded to 6 digits, ties by key: query, key, cos and place (from 1).

    queries (query, vector) and gallery (key, vector), both with the column ``scope`` if only equal scopes meet. most: only cosines up to it,
    of other keys than the query, count. No pair of vectors is a row. Without scopes each task reads the whole gallery by its queries, see ``nearest``;
    with them blocks of both sides are multiplied, each pair in a task that returns k rows a query.
    """
    if scope is None:
        near = nearest(queries, gallery, k, most)
        return near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cos"), "key"))).where(F.col("place") <= k)
    # a third of a block's size on average, whatever the skew of a scope: blocks are dealt by hash over all scopes
    n_q, n_g = (max(1, -(-df.count() // BLOCK)) for df in (queries, gallery))
    side = lambda df, key, n: df.select(F.col(key).cast("long").alias("key"), F.col("vector").cast("array<double>").alias("vector"), (F.col(scope).cast("string") if scope else F.lit("")).alias("scope"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("own"))
    q = side(queries, "query", n_q).select("*", F.lit(True).alias("asks"), F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n_g - 1))).alias("j")).drop("own")
    g = side(gallery, "key", n_g).select("*", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("i"), F.col("own").alias("j")).drop("own")

    def unit(rows: pd.Series) -> np.ndarray:
        v = np.stack(rows.to_list()).astype(np.float64)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, n, out=np.zeros_like(v), where=n > 0)

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.groupby("scope", dropna=False):
            asks, held = part[part.asks], part[~part.asks].sort_values("key")
            if not len(asks) or not len(held):
                continue
            keys, v = held.key.to_numpy(), unit(held.vector)
            for at in range(0, len(asks), 256):
                some = asks.iloc[at : at + 256]
                cos = np.round(unit(some.vector) @ v.T, 6)
                if most is not None:
                    cos[(cos > most) | (some.key.to_numpy()[:, None] == keys[None, :])] = -np.inf
                order = np.argsort(-cos, axis=1, kind="stable")[:, :k]  # equal cosines by key
                top = np.take_along_axis(cos, order, 1)
                found = pd.DataFrame({"query": np.repeat(some.key.to_numpy(), order.shape[1]), "key": keys[order].ravel(), "cos": top.ravel()})
                out.append(found[np.isfinite(found.cos)])
        return pd.concat(out) if out else pd.DataFrame({"query": [], "key": [], "cos": []})

    near = q.unionByName(g).groupBy("i", "j").applyInPandas(best, "query long, key long, cos double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cos"), "key"))
    return near.withColumn("place", place).where(F.col("place") <= k)


def _asked(items: DataFrame) -> DataFrame:
    return items.select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


def top_classes(items: DataFrame, k: int = 2) -> DataFrame:
    """Each vector's k nearest class prototypes: vec_id, label, class, cos and place."""
    near = top_k(_asked(items), prototypes(items).select(F.col("label").alias("key"), F.col("centroid").alias("vector")), k)
    return items.select("vec_id", "label").join(near, items["vec_id"] == near["query"]).select("vec_id", "label", F.col("key").cast(items.schema["label"].dataType).alias("class"), "cos", "place")


def promoted(items: DataFrame, gallery: DataFrame, least: float = 0.90, margin: float = 0.04, scope: str | None = None) -> DataFrame:
    """V7: items (vec_id, embedding) that take the class of the nearest prototype of gallery (label, embedding): its cosine is ``least`` or more
    and leads the second by ``margin``, or no second exists; with scope, only prototypes of the item's scope count. vec_id, class (null: none), cos and lead.
    """
    by = [scope] if scope else []
    protos = prototypes(gallery)
    protos = protos.join(gallery.groupBy("label").agg(F.min(scope).alias(scope)), "label") if scope else protos
    near = top_k(items.select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"), *by), protos.select(F.col("label").alias("key"), F.col("centroid").alias("vector"), *by), 2, scope=scope)
    one = near.groupBy("query").agg(F.max(F.when(F.col("place") == 1, F.col("key"))).alias("class"), F.max(F.when(F.col("place") == 1, F.col("cos"))).alias("cos"), F.max(F.when(F.col("place") == 2, F.col("cos"))).alias("second"))
    lead = F.round(F.col("cos") - F.col("second"), 6)
    return one.select(F.col("query").alias("vec_id"), F.when((F.col("cos") >= least) & (F.col("second").isNull() | (lead >= margin)), F.col("class")).alias("class"), "cos", lead.alias("lead"))


def cohesion(items: DataFrame) -> DataFrame:
    """V8: own against best rival prototype; a negative margin makes a vector suspect."""
    near = top_classes(items, 2)
    rival = near.where(F.col("class") != F.col("label")).groupBy("vec_id").agg(F.max("cos").alias("rival"))
    own = items.join(prototypes(items), "label").select("vec_id", F.round(cosine("embedding", "centroid"), 6).alias("own"))
    return own.join(rival, "vec_id", "left").select("vec_id", "own", "rival", (F.col("own") < F.col("rival")).alias("suspect"))


def hubness(gallery: DataFrame, k: int = 10, mask: float = 0.82) -> DataFrame:
    """vec_id and hub, the mean similarity of the k nearest others up to ``mask`` (missing ones count 0), less the gallery's mean, 0 at least."""
    n = gallery.count()
    near = top_k(_asked(gallery), gallery.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector")), k, most=mask)
    sums = near.groupBy("query").agg((F.sum("cos") / max(1, min(k, n - 1))).alias("mean"))
    each = gallery.select("vec_id").join(sums, gallery["vec_id"] == sums["query"], "left").select("vec_id", F.coalesce("mean", F.lit(0.0)).alias("mean"))
    return each.crossJoin(each.agg(F.avg("mean").alias("all"))).select("vec_id", F.round(F.greatest(F.lit(0.0), F.col("mean") - F.col("all")), 6).alias("hub"))  # the other side is one row


def calibration(gallery: DataFrame, split: str = "train", precision: float = 0.96) -> tuple[DataFrame, DataFrame]:
    """Gates from the gallery's geometry alone. One row (inverse_temperature, least_probability, own_floor, median_sibling) and a row
    a class (label, sibling, margin): its nearest other prototype's cosine and the lead that this asks for. Never from the test split.
    """
    if split == "test":
        raise ValueError("gates are not fitted on the test split")
    clip = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    protos = prototypes(gallery)
    near = top_k(protos.select(F.col("label").alias("query"), F.col("centroid").alias("vector")), protos.select(F.col("label").alias("key"), F.col("centroid").alias("vector")), 2).where("query <> key")
    sibling = near.groupBy("query").agg(F.max("cos").alias("cos")).select(F.col("query").alias("label"), clip(F.col("cos"), -1.0, 0.999).alias("sibling"))
    gap = F.greatest(F.lit(1e-3), 1 - F.col("sibling"))
    classes = sibling.select("label", F.round("sibling", 4).alias("sibling"), F.round(clip(0.35 * gap, 0.015, 0.055), 4).alias("margin"))
    middle = sibling.agg(F.percentile(gap, 0.5).alias("gap"), F.count(F.lit(1)).alias("classes"))
    middle = middle.select("classes", F.round(clip(1.40 / F.greatest(F.lit(1e-3), F.col("gap")), 18.0, 44.0), 2).alias("inverse_temperature"), F.round(1 - F.col("gap"), 4).alias("median_sibling"))
    # a view against the mean of its class's other views
    cells = gallery.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("x"))
    sums = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("sum"))
    views = gallery.groupBy("label").agg(F.count(F.lit(1)).alias("views")).where("views > 1")
    rest = F.zip_with("sum", "embedding", lambda s, x: s - x.cast("double"))
    lone = gallery.join(views, "label").join(sums, "label").join(classes, "label", "left").withColumn("rest", rest).withColumn("length", norm("rest")).where("length > 1e-8")
    lone = lone.crossJoin(F.broadcast(middle)).withColumn("own", dot("embedding", "rest") / F.col("length"))  # middle is one row
    logit = clip(F.col("inverse_temperature") * (F.col("own") - F.coalesce("sibling", "median_sibling")), -25.0, 25.0)
    alpha = max(0.01, min(0.25, 1 - precision))
    held = lone.agg(F.percentile("own", 0.15).alias("floor"), F.percentile(1 / (1 + F.exp(-logit)), alpha).alias("least"))
    few = F.col("classes") < 4  # too few classes to measure: stated defaults
    out = middle.crossJoin(held).select(
        F.when(few, 28.0).otherwise(F.col("inverse_temperature")).alias("inverse_temperature"),
        F.when(few | F.col("least").isNull(), 0.56).otherwise(F.round(clip(F.col("least"), 0.50, 0.72), 4)).alias("least_probability"),
        F.when(few | F.col("floor").isNull(), 0.86).otherwise(F.round(clip(F.col("floor"), 0.82, 0.92), 4)).alias("own_floor"),
        F.when(few, 0.80).otherwise(F.col("median_sibling")).alias("median_sibling"),
    )
    return out, classes


class Adapter:
    """A residual map, unit(x + share * relu(x W1) W2), fitted so that views of a class come together.

    Fitted on the driver on at most ``most_rows`` gallery rows, those of the smallest hashed ids: a bound, not a share of the gallery. Of several
    epochs the weights that find most of the held-out classes stay, at the start the identity.
    """

    def __init__(self, w1, w2, share: float = 0.22):
        self.w1, self.w2, self.share = w1, w2, share

    @classmethod
    def fit(cls, gallery: DataFrame, hidden: int = 192, share: float = 0.22, temperature: float = 0.05, epochs: int = 35, rate: float = 0.08, batch: int = 128, seed: int = 42, most_rows: int = 50_000) -> Adapter:
        rows = gallery.select("vec_id", "label", "embedding").where("label is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(most_rows).toPandas().sort_values("vec_id")
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
        relu = lambda x: np.maximum(x, 0)
        draw, size = np.random.default_rng(seed), len(rows.embedding.iloc[0]) if len(rows) else 1
        out = cls(draw.normal(0, size**-0.5, (size, hidden)), np.zeros((hidden, size)), share)
        views = {k: unit(np.stack(v.embedding.to_list()).astype(np.float64)) for k, v in rows.groupby("label")}
        many = [k for k, v in views.items() if len(v) > 1]
        if len(rows) < 16 or len(many) < 8:
            return out
        held = set(np.array(many)[draw.permutation(len(many))[: max(4, round(0.15 * len(many)))]].tolist())
        train = [k for k in many if k not in held] or many
        a, p = (np.concatenate([np.roll(views[k], -shift, axis=0) for k in train]) for shift in (0, 1))
        of = np.repeat(np.arange(len(train)), [len(views[k]) for k in train])
        names, first = list(views), np.stack([v[0] for v in views.values()])
        asked, wanted = np.stack([views[k][1] for k in held]), np.array([names.index(k) for k in held])
        right = lambda: float(((out.map(asked) @ out.map(first).T).argmax(axis=1) == wanted).mean())
        best, w1, w2 = (right(), out.w1, out.w2), out.w1.copy(), out.w2.copy()
        for _ in range(epochs):
            order = draw.permutation(len(a))
            for at in range(0, len(a), batch):
                i = order[at : at + batch]
                if len(i) < 4:
                    continue
                ha, hp = relu(a[i] @ w1), relu(p[i] @ w1)
                za, zp = unit(a[i] + share * ha @ w2), unit(p[i] + share * hp @ w2)
                logits = za @ zp.T / temperature
                logits[(of[i][:, None] == of[i][None, :]) & ~np.eye(len(i), dtype=bool)] = -1e9  # another view of the class is no negative
                odds = np.exp(logits - logits.max(axis=1, keepdims=True))
                slope = (odds / odds.sum(axis=1, keepdims=True) - np.eye(len(i))) / temperature / len(i)
                da, dp = slope @ zp, slope.T @ za
                da, dp = (d - z * (d * z).sum(axis=1, keepdims=True) for d, z in ((da, za), (dp, zp)))
                g1 = share * (a[i].T @ (da @ w2.T * (ha > 0)) + p[i].T @ (dp @ w2.T * (hp > 0)))
                w2 = w2 - rate * share * (ha.T @ da + hp.T @ dp)
                w1 = w1 - rate * g1
            out.w1, out.w2 = w1, w2
            if (now := right()) >= best[0]:
                best = now, w1, w2
        out.w1, out.w2 = best[1], best[2]
        return out

    def map(self, x):
        z = x + self.share * np.maximum(x @ self.w1, 0) @ self.w2
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-8)

    def transform(self, items: DataFrame, vector: str = "embedding") -> DataFrame:
        """items with the vector mapped, in Arrow batches; null vectors stay null."""
        shared = items.sparkSession.sparkContext.broadcast(self)  # two matrices of the vector's length by ``hidden``

        @F.pandas_udf("array<double>")
        def mapped(v: pd.Series) -> pd.Series:
            some = v.notna()
            out = pd.Series([None] * len(v), index=v.index, dtype=object)
            if some.any():
                out[some] = pd.Series(list(shared.value.map(np.stack(v[some].to_list()).astype(np.float64))), index=v.index[some])
            return out

        return items.withColumn(vector, mapped(F.col(vector)))


def buckets(vector, bits: int = 16, tables_: int = 8, seed: int = 7, size: int = 64) -> Column:
    """In place of a graph index, ``tables_`` keys of sign bits of seeded random directions; rows that share one are candidates."""
    draw = np.random.default_rng(seed)
    key = lambda t: F.concat_ws("", F.lit(f"{t}:"), *(F.when(dot(vector, F.array(*map(F.lit, draw.standard_normal(size).round(6).tolist()))) > 0, "1").otherwise("0") for _ in range(bits)))
    return F.array(*(key(t) for t in range(tables_)))


def indexed_neighbours(queries: DataFrame, gallery: DataFrame, k: int, bits: int = 6, tables_: int = 12, size: int = 64) -> DataFrame:
    """The k nearest gallery vectors among those that share a bucket, by exact cosine: query, key, cos, place. Every row is indexed."""
    q = queries.select("query", "vector", F.explode(buckets("vector", bits, tables_, size=size)).alias("bucket"))
    g = gallery.select("key", F.col("vector").alias("other"), F.explode(buckets("vector", bits, tables_, size=size)).alias("bucket"))
    pairs = q.join(g, "bucket").select("query", "key", "vector", "other").dropDuplicates(["query", "key"]).select("query", "key", F.round(cosine("vector", "other"), 6).alias("cos"))
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cos"), "key"))).where(F.col("place") <= k)


#: Vectors of a population compared with those of another at once.
SIDE = 4096


def compare_populations(items: DataFrame) -> DataFrame:
    """V9: for each two labels the cosine of their unit vectors' centroids, the vectors of both, the largest cosine of a pair, and shared ids and vectors.

    All components and all pairs count; a task compares two blocks of SIDE vectors and returns one row. Rows with a null label,
    null or empty vector or null component are in no population; a zero vector stays zero.
    """
    items = items.select("vec_id", "label", "embedding").where("label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null)").withColumn("length", norm("embedding"))
    unit = F.transform("embedding", lambda x: F.when(F.col("length") > 0, x.cast("double") / F.col("length")).otherwise(0.0))
    units = items.select("vec_id", "label", unit.alias("unit"))
    centres = centroids(units, vector="unit").join(units.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label")
    a, b = (centres.select(F.col("label").alias(x), F.col("centroid").alias(f"c_{x}"), F.col("n").alias(f"n_{x}")) for x in ("one", "two"))
    out = a.join(b, F.col("one") < F.col("two")).select("one", "two", F.round(cosine("c_one", "c_two"), 6).alias("cos"), (F.col("n_one") + F.col("n_two")).alias("n"))

    blocks = units.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("blocks"))
    dealt = units.join(blocks, "label").select("label", "unit", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("own"))
    each = blocks.select("label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    a, b = (each.select(F.col("label").alias(x), F.col("own").alias(y)) for x, y in (("one", "i"), ("two", "j")))
    grid = a.join(b, F.col("one") < F.col("two"))
    first = dealt.withColumnsRenamed({"label": "one", "own": "i"}).join(grid, ["one", "i"]).select("one", "i", "two", "j", F.lit(True).alias("first"), "unit")
    second = dealt.withColumnsRenamed({"label": "two", "own": "j"}).join(grid, ["two", "j"]).select("one", "i", "two", "j", F.lit(False).alias("first"), "unit")

    def largest(rows):
        x, y = (rows.loc[rows["first"] == k, "unit"] for k in (True, False))
        if not len(x) or not len(y):
            return pd.DataFrame({"one": [], "two": [], "most": []})
        x, y = np.stack(x.to_list()), np.stack(y.to_list())
        most = max(float((x[at : at + 512] @ y.T).max()) for at in range(0, len(x), 512))
        return pd.DataFrame({"one": [rows.one.iloc[0]], "two": [rows.two.iloc[0]], "most": [most]})

    kind = items.schema["label"].dataType.simpleString()
    most = first.unionByName(second).groupBy("one", "i", "two", "j").applyInPandas(largest, f"one {kind}, two {kind}, most double")
    most = most.groupBy("one", "two").agg(F.round(F.max("most"), 6).alias("max_cos"))

    def shared(what: Column, name: str) -> DataFrame:
        held = items.select("label", what.alias("what")).where("what is not null").distinct()
        a, b = (held.select("what", F.col("label").alias(x)) for x in ("one", "two"))
        return a.join(b, "what").where("one < two").groupBy("one", "two").agg(F.count(F.lit(1)).alias(name))

    vectors = F.md5(F.array_join(F.col("embedding").cast("array<string>"), ","))
    for found in (most, shared(F.col("vec_id"), "shared_ids"), shared(vectors, "shared_vectors")):
        out = out.join(found, ["one", "two"], "left")
    return out.fillna(0, ["shared_ids", "shared_vectors"])


def _load(spark, d) -> DataFrame:
    return tables.load(spark, d, "embeddings")


def _calibrated(spark, d) -> DataFrame:
    return calibration(_load(spark, d))[0]


def _colours(spark, d) -> DataFrame:
    zones = _load(spark, d).select("vec_id", F.when(F.col("vec_id") % 9 > 0, F.transform(F.slice("embedding", 1, 9), lambda x: x.cast("double") * 100)).alias("zone"))
    other = zones.select((F.col("vec_id") - 1).alias("vec_id"), F.col("zone").alias("next"))
    return zones.join(other, "vec_id").select("vec_id", F.round(colour_similarity("zone", "next"), 6).alias("sim"))


QUERIES = {
    "v6_prototypes": lambda spark, d: prototypes(_load(spark, d)).select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x")),
    "v7_prototype_promotion": lambda spark, d: promoted(_load(spark, d), _load(spark, d).where("vec_id % 3 <> 0"), 0.30, 0.05),
    "v8_cohesion_audit": lambda spark, d: cohesion(_load(spark, d)),
    "v9_population_compare": lambda spark, d: compare_populations(_load(spark, d)),
    "v37_colour_similarity": _colours,
    "v10_hubness": lambda spark, d: hubness(_load(spark, d)),
    "v15_gallery_calibration": _calibrated,
    "v15_sibling_margins": lambda spark, d: calibration(_load(spark, d))[1],
    "j16_vector_top_k": lambda spark, d: top_k(_asked(_load(spark, d)).where("query % 5 = 0"), _load(spark, d).where("vec_id % 5 <> 0").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector")), 3),
}

_UNIT = "list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))"


def _protos(where: str = "true") -> str:
    """The classes' unit means as DuckDB's text."""
    return f"""
cells AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) WHERE {where} GROUP BY label, i),
means AS (SELECT label AS class, list(x ORDER BY i) AS m FROM cells GROUP BY label),
centres AS (SELECT class, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS c FROM means),
unit AS (SELECT vec_id, label, {_UNIT} AS u FROM embeddings),
pairs AS (SELECT vec_id, label, class, round(list_inner_product(u, c), 6) AS cos FROM unit CROSS JOIN centres),
sib AS (SELECT a.class AS label, greatest(-1.0, least(0.999, max(round(list_inner_product(a.c, b.c), 6)))) AS sibling FROM centres a JOIN centres b ON a.class <> b.class GROUP BY a.class),
middle AS (SELECT quantile_cont(greatest(0.001, 1 - sibling), 0.5) AS gap FROM sib),
sums AS (SELECT label, list(x ORDER BY i) AS s FROM (SELECT label, i, sum(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label),
rest AS (SELECT e.label, list_transform(range(1, 65), lambda i: s[i] - CAST(embedding[i] AS DOUBLE)) AS r, CAST(embedding AS DOUBLE[]) AS v FROM embeddings e JOIN sums USING (label)),
own AS (SELECT label, list_inner_product(v, r) / sqrt(list_inner_product(r, r)) AS own FROM rest)
"""


ORACLES = {
    "v6_prototypes": f"WITH {_protos()} SELECT class AS label, CAST(i - 1 AS INTEGER) AS i, round(c[i], 6) AS x FROM centres, range(1, 65) r(i)",
    "v7_prototype_promotion": f"WITH {_protos('vec_id % 3 <> 0')}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, class) AS place FROM pairs), t AS (SELECT vec_id, max(class) FILTER (place = 1) AS class, max(cos) FILTER (place = 1) AS cos, max(cos) FILTER (place = 2) AS second FROM r WHERE place <= 2 GROUP BY vec_id) SELECT vec_id, CAST(CASE WHEN cos >= 0.30 AND (second IS NULL OR round(cos - second, 6) >= 0.05) THEN class END AS BIGINT) AS class, cos, round(cos - second, 6) AS lead FROM t",
    "v8_cohesion_audit": f"WITH {_protos()}, m AS (SELECT vec_id, max(cos) FILTER (class = label) AS own, max(cos) FILTER (class <> label) AS rival FROM pairs GROUP BY vec_id) SELECT *, own < rival AS suspect FROM m",
    "v9_population_compare": f"""
WITH unit AS (SELECT vec_id, label, embedding, {_UNIT} AS u FROM embeddings),
cells AS (SELECT label, i, avg(u[i]) AS x FROM unit, range(1, 65) r(i) GROUP BY label, i), centres AS (SELECT label, list(x ORDER BY i) AS c FROM cells GROUP BY label),
sizes AS (SELECT label, count(*) AS n FROM unit GROUP BY label),
most AS (SELECT a.label AS one, b.label AS two, round(max(list_inner_product(a.u, b.u)), 6) AS max_cos FROM unit a JOIN unit b ON a.label < b.label GROUP BY a.label, b.label),
ids AS (SELECT a.label AS one, b.label AS two, count(*) AS shared_ids FROM (SELECT DISTINCT label, vec_id FROM unit) a JOIN (SELECT DISTINCT label, vec_id FROM unit) b ON a.vec_id = b.vec_id AND a.label < b.label GROUP BY a.label, b.label),
vs AS (SELECT a.label AS one, b.label AS two, count(*) AS shared_vectors FROM (SELECT DISTINCT label, embedding FROM unit) a JOIN (SELECT DISTINCT label, embedding FROM unit) b ON a.embedding = b.embedding AND a.label < b.label GROUP BY a.label, b.label)
SELECT x.label AS one, y.label AS two, round(list_inner_product(x.c, y.c) / (sqrt(list_inner_product(x.c, x.c)) * sqrt(list_inner_product(y.c, y.c))), 6) AS cos, s.n + t.n AS n, max_cos, coalesce(shared_ids, 0) AS shared_ids, coalesce(shared_vectors, 0) AS shared_vectors
FROM centres x JOIN centres y ON x.label < y.label JOIN sizes s ON s.label = x.label JOIN sizes t ON t.label = y.label LEFT JOIN most ON most.one = x.label AND most.two = y.label LEFT JOIN ids ON ids.one = x.label AND ids.two = y.label LEFT JOIN vs ON vs.one = x.label AND vs.two = y.label""",
    "v37_colour_similarity": "WITH z AS (SELECT vec_id, CASE WHEN vec_id % 9 > 0 THEN list_transform(embedding[1:9], lambda x: CAST(x AS DOUBLE) * 100) END AS z FROM embeddings) SELECT a.vec_id, round(CASE WHEN a.z IS NULL OR b.z IS NULL THEN 0.5 ELSE exp(-list_distance(a.z, b.z) / sqrt(3) / 36) END, 6) AS sim FROM z a JOIN z b ON b.vec_id = a.vec_id + 1",
    "v10_hubness": f"WITH unit AS (SELECT vec_id, {_UNIT} AS u FROM embeddings), p AS (SELECT a.vec_id, round(list_inner_product(a.u, b.u), 6) AS cos FROM unit a JOIN unit b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC) AS place FROM p WHERE cos <= 0.82), m AS (SELECT u.vec_id, coalesce(sum(cos), 0.0) / least(10, (SELECT count(*) - 1 FROM unit)) AS mean FROM unit u LEFT JOIN r ON u.vec_id = r.vec_id AND place <= 10 GROUP BY u.vec_id) SELECT vec_id, round(greatest(0.0, mean - (SELECT avg(mean) FROM m)), 6) AS hub FROM m",
    "v15_gallery_calibration": f"WITH {_protos()}, t AS (SELECT round(greatest(18.0, least(44.0, 1.40 / greatest(0.001, gap))), 2) AS it, round(1 - gap, 4) AS ms FROM middle), h AS (SELECT quantile_cont(own, 0.15) AS fl, quantile_cont(1 / (1 + exp(-greatest(-25.0, least(25.0, it * (own - round(sibling, 4)))))), 0.04) AS le FROM own JOIN sib USING (label) CROSS JOIN t) SELECT it AS inverse_temperature, round(greatest(0.50, least(0.72, le)), 4) AS least_probability, round(greatest(0.82, least(0.92, fl)), 4) AS own_floor, ms AS median_sibling FROM t, h",
    "v15_sibling_margins": f"WITH {_protos()} SELECT CAST(label AS BIGINT) AS label, round(sibling, 4) AS sibling, round(greatest(0.015, least(0.055, 0.35 * greatest(0.001, 1 - sibling))), 4) AS margin FROM sib",
    "j16_vector_top_k": f"WITH unit AS (SELECT vec_id, {_UNIT} AS u FROM embeddings), p AS (SELECT a.vec_id AS query, b.vec_id AS key, round(list_inner_product(a.u, b.u), 6) AS cos FROM unit a JOIN unit b ON a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cos DESC, key) AS place FROM p) SELECT query, key, cos, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3",
}
