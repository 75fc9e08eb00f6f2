"""Records of crops and labels: silo joins, sample rows, training lines, keyword rank. Tables and taxonomies come from the caller."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.sources import tables

from .vectors import cosine


def observations(rows: DataFrame, silos: tuple[str, ...]) -> DataFrame:
    """One row a content hash with a list of observations (uri, brand, variant, pack) for each silo, in order of uri; synthetic copies are left out first.

    The union of the silos grouped by hash is their full outer join, with one shuffle. rows: h, silo, uri, brand, variant, pack, copy.
    """
    one = F.struct("uri", "brand", "variant", "pack")
    lists = [F.array_sort(F.collect_list(F.when(F.col("silo") == s, one))).alias(s) for s in silos]
    return rows.where("not copy and h is not null").groupBy("h").agg(*lists)


def conflicts(joined: DataFrame, silos: tuple[str, ...]) -> DataFrame:
    """With reasons, the fields on which the observations of a hash differ (null says nothing); any reason means quarantine."""
    every = F.concat(*silos)
    differ = lambda f: F.size(F.array_distinct(F.filter(F.transform(every, lambda o: o[f]), lambda v: v.isNotNull()))) > 1
    named = F.filter(F.array(*(F.when(differ(f), f"{f}_conflict") for f in ("brand", "variant", "pack"))), lambda r: r.isNotNull())
    return joined.withColumn("reasons", named)


def join_mode(joined: DataFrame, silos: tuple[str, ...], relinked: DataFrame | None = None) -> DataFrame:
    """With mode (how many silos hold the hash, and which), and confidence: 1.0 in all, .99 in two, .95 in one, .985 if a link of re-encoded
    crops (h of relinked) made the join, 0 with a conflict. Needs ``conflicts`` first."""
    held = F.filter(F.array(*(F.when(F.size(s) > 0, s) for s in silos)), lambda s: s.isNotNull())
    joined = joined.withColumn("mode", F.concat(F.size(held).cast("string"), F.lit("way_"), F.array_join(held, "_")))
    link = F.lit(False)
    if relinked is not None:
        joined = joined.join(relinked.select("h").distinct().withColumn("linked", F.lit(True)), "h", "left")
        link = F.coalesce("linked", F.lit(False))
    score = F.when(F.size("reasons") > 0, 0.0).when(F.size(held) == len(silos), 1.0).when(link, 0.985).when(F.size(held) > 1, 0.99).otherwise(0.95)
    return joined.withColumn("confidence", score).drop("linked")


def relinked(crops: DataFrame, cosine_at: float = 0.985) -> DataFrame:
    """H and variant_h of crops that re-encode the one variant crop of their (session, number): two or three hashes there, exactly one of them a variant entry, of equal
    brand and size, and alike where both have vectors.

    crops: session, number, h, variant (boolean), brand, width, height, vector (nullable).
    """
    rows = crops.dropDuplicates(["session", "number", "h"])
    groups = rows.groupBy("session", "number").agg(F.count(F.lit(1)).alias("hashes"), F.count_if("variant").alias("variants")).where("hashes between 2 and 3 and variants = 1").select("session", "number")
    one = rows.where("variant").join(groups, ["session", "number"]).select("session", "number", F.col("h").alias("variant_h"), *(F.col(c).alias(f"v_{c}") for c in ("brand", "width", "height", "vector")))
    both = rows.where("not variant").join(one, ["session", "number"])
    same = (F.col("brand") == F.col("v_brand")) & (F.col("width") == F.col("v_width")) & (F.col("height") == F.col("v_height"))
    return both.where(same & F.coalesce(cosine("vector", "v_vector") >= cosine_at, F.lit(True))).select("h", "variant_h")


def samples(rows: DataFrame, catalog: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row a box: image, place, product and fields; the catalog's value of a field overwrites the raw label's.

    rows: image, products (array), labels (array of structs of the fields; used alone without products). catalog: product and the fields.
    """
    many = F.size(F.coalesce("products", F.array().cast("array<long>"))) > 0
    at = F.when(many, F.transform("products", lambda p, i: F.struct(p.cast("long").alias("product"), F.get("labels", i).alias("raw")))).otherwise(F.transform("labels", lambda x: F.struct(F.lit(None).cast("long").alias("product"), x.alias("raw"))))
    boxes = rows.select("image", F.posexplode(at).alias("place", "b")).select("image", "place", "b.product", "b.raw")
    own = catalog.select("product", F.lit(True).alias("listed"), *(F.col(f).alias(f"c_{f}") for f in fields))
    out = boxes.join(own, "product", "left").where(F.col("listed") | F.col("raw").isNotNull())
    return out.select("image", "place", "product", *(F.coalesce(f"c_{f}", f"raw.{f}").alias(f) for f in fields))


def paired_files(names: DataFrame, image: str = "jpg", label: str = "txt") -> DataFrame:
    """Stem, image and label of the files (name) that have both extensions."""
    stem = names.select(F.regexp_extract("name", r"^(.*)\.([^.]+)$", 1).alias("stem"), F.lower(F.regexp_extract("name", r"^(.*)\.([^.]+)$", 2)).alias("kind"), "name")
    return stem.where(F.col("kind") == image).select("stem", F.col("name").alias("image")).join(stem.where(F.col("kind") == label).select("stem", F.col("name").alias("label")), "stem")


def chat_lines(items: DataFrame, system: str, ask: str, fields: tuple[str, ...]) -> DataFrame:
    """Split and line (JSON) of the items that may train: clean, no rendering; the gallery trains, val validates, test never shows.

    items: uri, split, status, render (boolean) and the fields; the answer holds the fields that are not null.
    """
    split = F.when(F.col("split") == "gallery", "train").when(F.col("split") == "val", "val")
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    line = F.to_json(F.struct(F.array(said("system", F.lit(system)), said("user", F.concat(F.lit(ask + " "), F.col("uri"))), said("assistant", F.to_json(F.struct(*fields)))).alias("messages")))
    return items.where((F.col("status") == "clean") & ~F.coalesce("render", F.lit(False))).select("uri", split.alias("split"), line.alias("line")).where("split is not null")


def embedded(items: DataFrame, keep: Column, embed, column: str = "embedding") -> DataFrame:
    """A predicate below a costly call: filtered first, in its own projection, so that no dropped row reaches ``embed`` (a pandas UDF over uri)."""
    return items.where(keep).withColumn(column, embed("uri"))


def keyword_rank(docs: DataFrame, query: str, k: int = 20) -> DataFrame:
    """Id, score and place of the k best texts by TF-IDF of the query's words (no stemming), ties by id. docs: id, text.

    Only the query's words are counted; k rows are ordered, not the table.
    """
    words = sorted(set(query.lower().split()))
    tokens = docs.select("id", F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w.isin(words))).alias("w"))
    tf = tokens.groupBy("id", "w").agg(F.count(F.lit(1)).alias("tf"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy("w").agg(F.count(F.lit(1)).alias("df")).crossJoin(n).select("w", F.log(1 + F.col("n") / F.col("df")).alias("idf"))  # n is one row, df one a word of the query
    scored = tf.join(F.broadcast(df), "w").groupBy("id").agg(F.round(F.sum(F.col("tf") * F.col("idf")), 6).alias("score"))
    best = scored.orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # over k rows


def retrieval_scores(answers: DataFrame, k: int = 5) -> DataFrame:
    """Over answers (truth, shortlist, gated, final): n, recall at 1 and k, mean reciprocal rank within k, gated share, and net gain (answers put right less those
    put wrong after retrieval)."""
    place = F.array_position(F.slice("shortlist", 1, k), F.col("truth"))
    first, last = F.coalesce(place == 1, F.lit(False)), F.coalesce(F.col("final") == F.col("truth"), F.lit(False))
    mean = lambda c: F.round(F.avg(c.cast("double")), 6)
    return answers.agg(
        F.count(F.lit(1)).alias("n"), mean(first).alias("recall_1"), mean(F.coalesce(place > 0, F.lit(False))).alias("recall_k"), mean(F.when(place > 0, 1 / place).otherwise(0.0)).alias("mrr"),
        mean(F.col("gated")).alias("gate_share"), (F.count_if(last & ~first) - F.count_if(first & ~last)).alias("net_gain"),
    )


def abstentions(answers: DataFrame, least_cosine: float = 0.52, least_confidence: float = 0.78, may_abstain: bool = False) -> DataFrame:
    """With reason (null: none), recommended and answer, which is nulled only if abstaining is allowed.

    answers: answer, gated, choice, cosine, confidence, advised, any of them null.
    """
    low = F.lit(f"confidence_below_threshold_{least_confidence:.2f}")
    reason = (
        F.when(F.col("answer").isNull(), "open_set_or_unreadable")
        .when(~F.col("gated") & (F.col("choice") == 0), "choice_0_no_match")
        .when(F.col("cosine") < least_cosine, "low_cosine_open_set")
        .when(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")) < least_confidence, low)
        .when(F.col("advised"), "low_calibrated_confidence")
    )
    out = answers.withColumn("reason", reason).withColumn("recommended", F.col("reason").isNotNull() | F.coalesce("advised", F.lit(False)))
    return out.withColumn("answer", F.when(F.col("recommended"), None).otherwise(F.col("answer"))) if may_abstain else out


def retried(rows: DataFrame, sla: float = 180.0) -> DataFrame:
    """With action and reason: a fault or a row over the time limit is quarantined for a retry and its payout kept, never zeroed. rows: error, contract_error, latency."""
    late = F.coalesce(F.col("latency"), F.lit(0.0)) > sla
    fault = F.col("error").isNotNull() | F.col("contract_error").isNotNull() | late
    reason = F.coalesce("contract_error", F.when(late, "sla_exceeded"), F.when(F.col("error").isNotNull(), "runtime_exception"), F.lit("ok"))
    return rows.withColumn("action", F.when(fault, "quarantine_retry_preserve_payout").otherwise("allow_payout_scoring")).withColumn("zero_payout_blocked", fault).withColumn("reason", reason)


def evaluated_fields(requested: str | None, preset: str = "3") -> tuple[str, ...]:
    """The fields to score, from a preset's number or names joined by comma, plus, slash or space; aliases are spelled out, repeats go."""
    presets = {"1": ("brand",), "2": ("brand", "packaging_type"), "3": ("brand", "packaging_type", "category"), "4": ("brand", "base_variant", "packaging_type", "category"), "5": ("product", "brand", "base_variant", "packaging_type", "category")}
    aliases = {"pack": "packaging_type", "pack_type": "packaging_type", "packtype": "packaging_type", "packaging": "packaging_type", "cat": "category", "brands": "brand"}
    if not requested:
        return presets[preset]
    if requested.strip() in presets:
        return presets[requested.strip()]
    names = [n.lower() for n in requested.replace(",", " ").replace("+", " ").replace("/", " ").split()]
    if not names:
        raise ValueError(f"{requested!r} names no field")
    return tuple(dict.fromkeys(aliases.get(n, n) for n in names))


def leaks(rows: DataFrame, pairs: tuple[tuple[str, str], ...] = (("train", "val"), ("train", "test"), ("val", "test"))) -> DataFrame:
    """Q8: one, two and n, the uris that two splits share; no row means no leak. rows: uri, split."""
    held = rows.where("uri is not null").groupBy("uri").agg(F.collect_set("split").alias("splits"))  # at most the number of splits
    each = F.filter(F.array(*(F.struct(F.lit(a).alias("one"), F.lit(b).alias("two")) for a, b in pairs)), lambda p: F.array_contains("splits", p["one"]) & F.array_contains("splits", p["two"]))
    return held.select(F.explode(each).alias("p")).groupBy("p.one", "p.two").agg(F.count(F.lit(1)).alias("n"))


def set_digests(rows: DataFrame, by: str, text: str, separator: str = "\n") -> DataFrame:
    """Of each group the SHA-256 of its sorted texts joined by the separator, and their number: by, digest, n.

    A digest is a sequence of bytes, so a group's texts pass through one task; they are sorted by the shuffle and fed to the digest batch by
    batch, never gathered.
    """
    from hashlib import sha256

    import pyarrow as pa

    key = rows.select(F.col(by).cast("string").alias("by"), F.col(text).alias("text")).where("text is not null")
    kind = rows.schema[by].dataType

    def run(batches):
        now, digest, n, out = None, None, 0, []
        for batch in batches:
            for k, t in zip(batch.column("by").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if digest is None or k != now:
                    if digest is not None:
                        out.append((now, digest.hexdigest(), n))
                    now, digest, n = k, sha256(), 0
                digest.update((separator if n else "").encode() + t.encode())
                n += 1
        if digest is not None:
            out.append((now, digest.hexdigest(), n))
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["by", "digest", "n"])

    done = key.repartition("by").sortWithinPartitions("by", "text").mapInArrow(run, "by string, digest string, n long")
    return done.select(F.col("by").cast(kind).alias(by), "digest", "n")


def fuzzy_matches(labels: DataFrame, catalog: DataFrame) -> DataFrame:
    """Of each label (id, product, brand, tokens, pack, category) the catalog entry: of its exact product key, else of its brand the one with the
    largest Jaccard of variant tokens, then equal pack, equal category, smallest id; catch_all if no token is shared: id, entry, jaccard, catch_all.

    Candidates share a token with the label: the join is by brand and token, not over a brand's pairs. Only labels without any fall back to the
    brand's best by pack and category, found by four grouped minima.
    """
    exact = labels.join(catalog.groupBy("product").agg(F.min("entry").alias("exact")), "product")
    left = labels.join(exact.select("id"), "id", "left_anti")
    words = lambda df, key: df.select(F.col(key).alias(key), "brand", F.explode(F.array_distinct("tokens")).alias("token"))
    shared = words(left, "id").join(words(catalog, "entry"), ["brand", "token"]).groupBy("id", "entry").agg(F.count(F.lit(1)).alias("both"))
    c = catalog.select("entry", F.size(F.array_distinct("tokens")).alias("m"), F.col("pack").alias("c_pack"), F.col("category").alias("c_category"))
    near = shared.join(left.select("id", F.size(F.array_distinct("tokens")).alias("n"), "pack", "category"), "id").join(c, "entry")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    jaccard = F.round(F.col("both") / (F.col("n") + F.col("m") - F.col("both")), 6)
    best = near.groupBy("id").agg(F.max(F.struct(jaccard.alias("jaccard"), same("pack", "c_pack").alias("p"), same("category", "c_category").alias("q"), (-F.col("entry")).alias("back"))).alias("b"))
    best = best.select("id", (-F.col("b.back")).alias("entry"), F.col("b.jaccard").alias("jaccard"), F.lit(False).alias("catch_all"))
    rest = left.join(best.select("id"), "id", "left_anti")
    for i, keys in enumerate((["brand", "pack", "category"], ["brand", "pack"], ["brand", "category"], ["brand"])):
        rest = rest.join(catalog.groupBy(*keys).agg(F.min("entry").alias(f"e{i}")), keys, "left")
    rest = rest.select("id", F.coalesce("e0", "e1", "e2", "e3").alias("entry"), F.lit(0.0).alias("jaccard"), F.lit(True).alias("catch_all"))
    return exact.select("id", F.col("exact").alias("entry"), F.lit(1.0).alias("jaccard"), F.lit(False).alias("catch_all")).unionByName(best).unionByName(rest.where("entry is not null"))


def twin_unions(folders: DataFrame, suffix: str) -> DataFrame:
    """Hashes that lie in several folders of which every longer name extends the shortest by suffixes alone (a pattern, repeated): h, base, n."""
    names = folders.dropDuplicates(["h", "folder"]).groupBy("h").agg(F.array_sort(F.collect_list(F.struct(F.length("folder").alias("size"), "folder"))).alias("f"))
    base = F.col("f")[0]["folder"]
    rest = F.transform(F.slice("f", 2, F.size("f")), lambda x: F.when(F.startswith(x["folder"], base), F.substring(x["folder"], F.length(base) + 1, F.length(x["folder"]))))
    fits = F.forall(rest, lambda r: F.coalesce(F.regexp_like(r, F.lit(f"^(?:{suffix})+$")), F.lit(False)))
    return names.where((F.size("f") > 1) & fits).select("h", base.alias("base"), F.size("f").cast("long").alias("n"))


def sisters(catalog: DataFrame, words: Column) -> DataFrame:
    """Of each entry the first (by id) of its brand and base variant whose normalised promo token is that of ``words``, else itself: id, sister.

    catalog: id, brand, base, promo (nullable). words is a column over it: the token that was read.
    """
    clean = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    first = catalog.groupBy("brand", "base", clean(F.col("promo")).alias("token")).agg(F.min("id").alias("sister"))
    read = catalog.select("id", "brand", "base", clean(words).alias("token"))
    return read.join(first, ["brand", "base", "token"], "left").select("id", F.coalesce("sister", "id").alias("sister"))


def completeness(joined: DataFrame) -> DataFrame:
    """Of each join mode (after ``join_mode``) its hashes, those with a conflict, by kind, and the mean confidence."""
    has = lambda r: F.count_if(F.array_contains("reasons", r))
    return joined.groupBy("mode").agg(F.count(F.lit(1)).alias("hashes"), F.count_if(F.size("reasons") > 0).alias("conflicted"), has("brand_conflict").alias("brand"), has("variant_conflict").alias("variant"), has("pack_conflict").alias("pack"), F.round(F.avg("confidence"), 6).alias("confidence"))


def stage_deltas(answers: DataFrame, by: list[str]) -> DataFrame:
    """Of each group what the second stage did with the answers that the gate let through to it: escalated, its rate, fixed, broken, and accuracy before and after."""
    first, last, up = F.coalesce(F.get("shortlist", F.lit(0)) == F.col("truth"), F.lit(False)), F.coalesce(F.col("final") == F.col("truth"), F.lit(False)), ~F.col("gated")
    after = F.when(up, last).otherwise(first)
    mean = lambda c: F.round(F.avg(c.cast("double")), 6)
    return answers.groupBy(*by).agg(F.count_if(up).alias("escalated"), mean(up).alias("rate"), F.count_if(up & last & ~first).alias("fixed"), F.count_if(up & first & ~last).alias("broken"), mean(first).alias("before"), mean(after).alias("after"))


def eligible(items: DataFrame, taken: DataFrame) -> DataFrame:
    """Items (uri, session, ambiguous) for the extended test: neither their uri nor their session is taken (uri, session of gallery, val and train), none ambiguous."""
    out = items.where(~F.coalesce("ambiguous", F.lit(False)))
    for c in ("uri", "session"):
        out = out.join(taken.select(c).where(F.col(c).isNotNull()).distinct(), c, "left_anti")
    return out.select(*items.columns)


def _first_other(items: DataFrame, group: list[str], apart: str) -> DataFrame:
    """Of each group the smallest id, the value of ``apart`` there, and the smallest id of another value: group, one, own, two."""
    least = items.groupBy(*group, apart).agg(F.min("id").alias("id"))
    one = least.groupBy(*group).agg(F.min(F.struct("id", apart)).alias("m"))
    rest = least.join(one, group) if group else least.crossJoin(one)  # one is a row a group
    two = rest.where(F.col(apart) != F.col(f"m.{apart}")).groupBy(*group).agg(F.min("id").alias("two"))
    head = one.select(*group, F.col("m.id").alias("one"), F.col(f"m.{apart}").alias("own"))
    return head.join(two, group, "left") if group else head.crossJoin(two)


def triplets(items: DataFrame) -> DataFrame:
    """Anchor, positive (its class, of another session, else of another hash) and negative (its brand and pack, another class, else any other class), the
    smallest ids; anchors without both are left out. items: id, class, session, hash, brand, pack.

    Two minima a group say which row is the first of another value, so no anchor meets its candidates.
    """
    out = items
    for k, (group, apart) in enumerate(((["class"], "session"), (["class"], "hash"), (["brand", "pack"], "class"))):
        side = _first_other(items, group, apart).toDF(*group, "one", "own", "two")
        out = out.join(side, group, "left").withColumn(f"pick{k}", F.when(F.col("own") != F.col(apart), F.col("one")).otherwise(F.col("two"))).drop("one", "own", "two")
    any_ = _first_other(items, [], "class").toDF("one", "own", "two")
    out = out.crossJoin(F.broadcast(any_)).withColumn("pick3", F.when(F.col("own") != F.col("class"), F.col("one")).otherwise(F.col("two")))  # one row
    return out.select(F.col("id").alias("anchor"), F.coalesce("pick0", "pick1").alias("positive"), F.coalesce("pick2", "pick3").alias("negative")).where("positive is not null and negative is not null")


def board_page(board: DataFrame, task: str | None, columns: list[str], n: int) -> DataFrame:
    """A filtered board, ordered by several columns (a minus before a name: descending), its first n rows."""
    rows = board.where(F.col("task") == task) if task else board
    return rows.orderBy(*(F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in columns)).limit(n)


# stand-ins


SILOS = ("variant", "pack", "brand")


def _observed(spark: SparkSession, d: str) -> DataFrame:
    """Documents as crops: their text's digest is the hash, their language the brand."""
    docs = tables.load(spark, d, "documents").where("text is not null")
    return docs.select(F.md5("text").alias("h"), F.when(F.col("source") <= "src12", "variant").when(F.col("source") <= "src3", "pack").otherwise("brand").alias("silo"), F.col("doc_id").alias("uri"), F.col("lang").alias("brand"), F.concat(F.lit("v"), F.col("doc_id") % 2).alias("variant"), F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("p"), F.col("doc_id") % 3)).alias("pack"), (F.col("doc_id") % 7 == 0).alias("copy"))


def _joined(spark, d) -> DataFrame:
    return join_mode(conflicts(observations(_observed(spark, d), SILOS), SILOS), SILOS)


def _crops(spark, d) -> DataFrame:
    e = tables.load(spark, d, "embeddings")
    return e.select((F.col("vec_id") - F.col("vec_id") % 3).alias("session"), F.lit(0).alias("number"), F.col("vec_id").alias("h"), (F.col("vec_id") % 3 == 0).alias("variant"), (F.col("label") % 2).alias("brand"), F.lit(10).alias("width"), (F.col("label") % 3).alias("height"), F.when(F.col("vec_id") % 4 > 0, F.col("embedding")).alias("vector"))


def _samples(spark, d) -> DataFrame:
    li = tables.load(spark, d, "lineitem")
    at = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_quantity")))
    rows = li.groupBy(F.col("l_orderkey").alias("image")).agg(at.alias("x"))
    labels = F.transform("x", lambda b: F.struct(b["l_returnflag"].alias("brand"), F.when(b["l_quantity"] > 10, b["l_linestatus"]).alias("category")))
    rows = rows.select("image", F.when(F.col("image") % 4 > 0, F.transform("x", lambda b: b["l_partkey"].cast("long"))).alias("products"), labels.alias("labels"))
    catalog = tables.load(spark, d, "part").where("p_partkey % 3 > 0").select(F.col("p_partkey").cast("long").alias("product"), F.col("p_brand").alias("brand"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("category"))
    return samples(rows, catalog, ("brand", "category"))


def _names(spark, d) -> DataFrame:
    o = tables.load(spark, d, "orders")
    jpg = o.where("o_orderkey % 2 = 0").select(F.concat(F.lit("shelf.v1_"), "o_orderkey", F.lit(".JPG")).alias("name"))
    return jpg.unionByName(o.where("o_orderkey % 3 = 0").select(F.concat(F.lit("shelf.v1_"), "o_orderkey", F.lit(".txt")).alias("name")))


def _items(spark, d) -> DataFrame:
    p = tables.load(spark, d, "part")
    return p.select(F.col("p_name").alias("uri"), F.when(F.col("p_partkey") % 4 == 0, "gallery").when(F.col("p_partkey") % 4 == 1, "val").otherwise("test").alias("split"), F.when(F.col("p_size") > 5, "clean").otherwise("conflict").alias("status"), (F.col("p_partkey") % 9 == 0).alias("render"), F.col("p_brand").alias("brand"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("category"), F.col("p_partkey").alias("id"))


def _filtered(spark, d) -> DataFrame:
    @F.pandas_udf("long")
    def vowels(uri: pd.Series) -> pd.Series:
        return uri.str.count("[aeiou]").astype("int64")

    return embedded(_items(spark, d), ~F.col("uri").rlike("widget|gear"), vowels).select("id", "embedding")


def _answers(spark, d) -> DataFrame:
    li = tables.load(spark, d, "lineitem")
    sku, n = F.col("l_partkey").cast("long"), F.col("l_linenumber")
    shortlist = F.when(n % 4 == 0, F.array(sku + 1, sku + 2, sku)).when(n % 4 == 1, F.array(sku, sku + 1)).when(n % 4 == 2, F.array(sku + 3, sku + 4)).otherwise(F.array(sku + 1, sku + 2, sku + 3, sku + 4, sku + 5, sku))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", sku.alias("truth"), shortlist.alias("shortlist"), (F.col("l_quantity") > 20).alias("gated"), F.when(n % 5 > 0, sku).otherwise(sku + 1).alias("final"), F.when(n % 6 > 0, sku).alias("answer"), (F.col("l_quantity") % 4).cast("int").alias("choice"), (0.4 + F.col("l_discount").cast("double") * 4).alias("cosine"), (0.6 + F.col("l_tax").cast("double") * 4).alias("confidence"), (F.col("l_linestatus") == "F").alias("advised"))


def _runs(spark, d) -> DataFrame:
    e = tables.load(spark, d, "events")
    return e.select("event_id", F.when(F.col("event_type") == "error", "boom").alias("error"), F.when(F.col("event_id") % 11 == 0, "quota").alias("contract_error"), F.col("value").alias("latency"))


def _splits(spark, d) -> DataFrame:
    k = F.col("l_orderkey") % 50
    return tables.load(spark, d, "lineitem").select(F.col("l_partkey").alias("uri"), F.when(k < 40, "train").when(k < 45, "val").otherwise("test").alias("split"))


def _board(spark, d) -> DataFrame:
    e = tables.load(spark, d, "events").groupBy(F.col("event_type").alias("task"), (F.col("user_id") % 20).alias("run")).agg(F.round(F.avg("value"), 4).alias("score"), F.count(F.lit(1)).alias("n"))
    return board_page(e, "click", ["-score", "-n", "run"], 10)


def _fuzzy(spark, d) -> DataFrame:
    p = tables.load(spark, d, "part")
    words = F.split("p_name", " ")
    catalog = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("long").alias("entry"), F.concat_ws("|", "p_brand", "p_name", F.col("p_size").cast("string")).alias("product"), F.col("p_brand").alias("brand"), words.alias("tokens"), (F.col("p_size") % 3).alias("pack"), F.col("p_type").alias("category"))
    labels = p.where("p_partkey % 3 > 0").select(F.col("p_partkey").cast("long").alias("id"), F.concat_ws("|", "p_brand", "p_name", F.col("p_size").cast("string")).alias("product"), F.col("p_brand").alias("brand"), F.when(F.col("p_partkey") % 5 > 0, words).otherwise(F.array(F.lit("odd"))).alias("tokens"), (F.col("p_size") % 3).alias("pack"), F.col("p_type").alias("category"))
    return fuzzy_matches(labels, catalog)


def _uris(spark, d) -> DataFrame:
    return tables.load(spark, d, "part").select((F.col("p_size") % 3).alias("split"), F.concat_ws("#", "p_name", F.col("p_partkey").cast("string")).alias("uri"))


def _entries(spark, d) -> DataFrame:
    return tables.load(spark, d, "part").select("p_type", F.concat_ws("|", F.lpad(F.col("p_partkey").cast("string"), 12, "0"), "p_brand", "p_name", F.col("p_size").cast("string")).alias("entry"))


def _folders(spark, d) -> DataFrame:
    p = tables.load(spark, d, "part")
    tail = F.when(F.col("p_size") % 4 == 0, " promo").when(F.col("p_size") % 4 == 1, "_rs20").when(F.col("p_size") % 4 == 2, " xl").otherwise("")
    return p.select(F.concat("p_name", F.col("p_partkey") % 9).alias("h"), F.concat("p_name", tail, F.when(F.col("p_partkey") % 5 == 0, " promo").otherwise("")).alias("folder"))


def _catalog(spark, d) -> DataFrame:
    return tables.load(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("base"), F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("Save-"), F.col("p_size") % 4)).alias("promo"))


def _triplets(spark, d) -> DataFrame:
    p = tables.load(spark, d, "part")
    return triplets(p.select(F.col("p_partkey").cast("long").alias("id"), F.concat_ws("/", "p_brand", "p_type").alias("class"), (F.col("p_partkey") % 3).alias("session"), (F.col("p_partkey") % 11).alias("hash"), F.col("p_brand").alias("brand"), (F.col("p_size") % 2).alias("pack")))


def _eligible(spark, d) -> DataFrame:
    o = tables.load(spark, d, "orders").select(F.col("o_orderkey").alias("uri"), F.col("o_custkey").alias("session"), (F.col("o_orderstatus") == "P").alias("ambiguous"))
    return eligible(o.where("uri % 10 = 9"), o.where("uri % 100 < 4"))


_text = lambda c: F.array_join(F.transform(c, lambda o: o["uri"].cast("string")), ",")
QUERIES = {
    "j1_three_silo_outer": lambda spark, d: observations(_observed(spark, d), SILOS).select("h", *(_text(s).alias(s) for s in SILOS)),
    "j3_re_encoded_link": lambda spark, d: relinked(_crops(spark, d), 0.0),
    "j4_join_tier": lambda spark, d: _joined(spark, d).select("h", "mode", "confidence"),
    "j5_silo_conflicts": lambda spark, d: _joined(spark, d).where(F.size("reasons") > 0).select("h", F.array_join("reasons", " ").alias("reasons")),
    "s6_row_samples": _samples,
    "s12_paired_files": lambda spark, d: paired_files(_names(spark, d)),
    "s23_chat_lines": lambda spark, d: chat_lines(_items(spark, d), "You name products.", "Which product is", ("brand", "category")),
    "p3_filter_below_call": _filtered,
    "t30_keyword_rank": lambda spark, d: keyword_rank(tables.load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), "old widget bolt", 25),
    "a21_retrieval_diagnostics": lambda spark, d: retrieval_scores(_answers(spark, d)),
    "p14_abstention_ladder": lambda spark, d: abstentions(_answers(spark, d), may_abstain=True).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "answer", "reason", "recommended"),
    "p12_outcome_gate": lambda spark, d: retried(_runs(spark, d)).select("event_id", "action", "zero_payout_blocked", "reason"),
    "q8_uri_leakage": lambda spark, d: leaks(_splits(spark, d)),
    "u11_board_page": _board,
    "j2_twin_union": lambda spark, d: twin_unions(_folders(spark, d), " promo|_rs[0-9]+"),
    "j26_sister_product": lambda spark, d: sisters(_catalog(spark, d), F.concat(F.lit("SAVE "), F.col("id") % 4)),
    "a41_join_completeness": lambda spark, d: completeness(_joined(spark, d)),
    "a42_stage_deltas": lambda spark, d: stage_deltas(_answers(spark, d), ["l_linenumber"]),
    "p7_extended_eligibility": _eligible,
    "v38_triplets": _triplets,
    "a37_split_hash": lambda spark, d: set_digests(_uris(spark, d), "split", "uri").select("split", F.substring("digest", 1, 16).alias("hash"), "n"),
    "a38_catalog_fingerprint": lambda spark, d: set_digests(_entries(spark, d), "p_type", "entry", ";").select("p_type", F.col("digest").alias("fingerprint")),
    "j27_fuzzy_catalog": _fuzzy,
}

_OBS = """
o AS (SELECT md5(text) AS h, CASE WHEN source <= 'src12' THEN 'variant' WHEN source <= 'src3' THEN 'pack' ELSE 'brand' END AS silo, doc_id, lang, doc_id % 2 AS v, CASE WHEN doc_id % 5 > 0 THEN doc_id % 3 END AS p FROM documents WHERE text IS NOT NULL AND doc_id % 7 <> 0),
j AS (SELECT h, coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (silo = 'variant'), '') AS variant, coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (silo = 'pack'), '') AS pack, coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (silo = 'brand'), '') AS brand,
  count(DISTINCT silo) AS ways, concat_ws(' ', CASE WHEN count(DISTINCT lang) > 1 THEN 'brand_conflict' END, CASE WHEN count(DISTINCT v) > 1 THEN 'variant_conflict' END, CASE WHEN count(DISTINCT p) > 1 THEN 'pack_conflict' END) AS reasons FROM o GROUP BY h)
"""
_ANSWERS = """
a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_partkey AS sku, CASE l_linenumber % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN NULL ELSE 6 END AS place, l_quantity > 20 AS gated, l_linenumber % 5 > 0 AS last_right, CASE WHEN l_linenumber % 6 > 0 THEN CAST(l_partkey AS BIGINT) END AS answer,
  CAST(l_quantity % 4 AS INTEGER) AS choice, CAST(0.4 AS DOUBLE) + CAST(l_discount AS DOUBLE) * 4 AS cosine, CAST(0.6 AS DOUBLE) + CAST(l_tax AS DOUBLE) * 4 AS confidence, l_linestatus = 'F' AS advised FROM lineitem)
"""
ORACLES = {
    "j1_three_silo_outer": f"WITH {_OBS} SELECT h, variant, pack, brand FROM j",
    "j3_re_encoded_link": "WITH c AS (SELECT vec_id - vec_id % 3 AS session, vec_id AS h, vec_id % 3 = 0 AS variant, label % 2 AS brand, label % 3 AS height, CASE WHEN vec_id % 4 > 0 THEN CAST(embedding AS DOUBLE[]) END AS v FROM embeddings), g AS (SELECT session FROM c GROUP BY session HAVING count(*) BETWEEN 2 AND 3 AND count(*) FILTER (variant) = 1) SELECT a.h, b.h AS variant_h FROM c a JOIN c b ON a.session = b.session AND NOT a.variant AND b.variant JOIN g ON g.session = a.session WHERE a.brand = b.brand AND a.height = b.height AND coalesce(list_inner_product(a.v, b.v) >= 0, true)",
    "j4_join_tier": f"WITH {_OBS} SELECT h, concat(ways, 'way_', concat_ws('_', CASE WHEN variant <> '' THEN 'variant' END, CASE WHEN pack <> '' THEN 'pack' END, CASE WHEN brand <> '' THEN 'brand' END)) AS mode, CAST(CASE WHEN reasons <> '' THEN 0.0 WHEN ways = 3 THEN 1.0 WHEN ways = 2 THEN 0.99 ELSE 0.95 END AS DOUBLE) AS confidence FROM j",
    "j5_silo_conflicts": f"WITH {_OBS} SELECT h, reasons FROM j WHERE reasons <> ''",
    "s6_row_samples": "WITH b AS (SELECT l_orderkey AS image, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus, l_quantity) - 1 AS INTEGER) AS place, CASE WHEN l_orderkey % 4 > 0 THEN CAST(l_partkey AS BIGINT) END AS product, l_returnflag AS rb, CASE WHEN l_quantity > 10 THEN l_linestatus END AS rc FROM lineitem) SELECT image, place, product, coalesce(p_brand, rb) AS brand, coalesce(CASE WHEN p_size > 25 THEN p_type END, rc) AS category FROM b LEFT JOIN part ON product = p_partkey AND p_partkey % 3 > 0",
    "s12_paired_files": "SELECT 'shelf.v1_' || o_orderkey AS stem, 'shelf.v1_' || o_orderkey || '.JPG' AS image, 'shelf.v1_' || o_orderkey || '.txt' AS label FROM orders WHERE o_orderkey % 6 = 0",
    "s23_chat_lines": r"""SELECT p_name AS uri, CASE p_partkey % 4 WHEN 0 THEN 'train' ELSE 'val' END AS split, '{"messages":[{"role":"system","content":"You name products."},{"role":"user","content":"Which product is ' || p_name || '"},{"role":"assistant","content":"{\"brand\":\"' || p_brand || '\"' || CASE WHEN p_size > 25 THEN ',\"category\":\"' || p_type || '\"' ELSE '' END || '}"}]}' AS line FROM part WHERE p_size > 5 AND p_partkey % 9 <> 0 AND p_partkey % 4 < 2""",
    "p3_filter_below_call": "SELECT p_partkey AS id, CAST(length(regexp_replace(p_name, '[^aeiou]', '', 'g')) AS BIGINT) AS embedding FROM part WHERE NOT regexp_matches(p_name, 'widget|gear')",
    "t30_keyword_rank": "WITH w AS (SELECT p_partkey AS id, unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS w FROM part), tf AS (SELECT id, w, count(*) AS tf FROM w WHERE w IN ('old', 'widget', 'bolt') GROUP BY id, w), f AS (SELECT w, ln(1 + CAST((SELECT count(*) FROM part) AS DOUBLE) / count(*)) AS idf FROM tf GROUP BY w), s AS (SELECT id, round(sum(tf * idf), 6) AS score FROM tf JOIN f USING (w) GROUP BY id), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM s) SELECT id, score, CAST(place AS INTEGER) AS place FROM r WHERE place <= 25",
    "a21_retrieval_diagnostics": f"WITH {_ANSWERS}, m AS (SELECT *, coalesce(place = 1, false) AS one, CASE WHEN place <= 5 THEN place END AS p5 FROM a) SELECT count(*) AS n, round(avg(CASE WHEN one THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN p5 IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS recall_k, round(avg(coalesce(1.0 / p5, 0.0)), 6) AS mrr, round(avg(CASE WHEN gated THEN 1.0 ELSE 0.0 END), 6) AS gate_share, count(*) FILTER (last_right AND NOT one) - count(*) FILTER (one AND NOT last_right) AS net_gain FROM m",
    "p14_abstention_ladder": f"WITH {_ANSWERS}, r AS (SELECT *, CASE WHEN answer IS NULL THEN 'open_set_or_unreadable' WHEN NOT gated AND choice = 0 THEN 'choice_0_no_match' WHEN cosine < 0.52 THEN 'low_cosine_open_set' WHEN least(1.0, confidence) < 0.78 THEN 'confidence_below_threshold_0.78' WHEN advised THEN 'low_calibrated_confidence' END AS reason FROM a) SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN reason IS NULL AND NOT advised THEN answer END AS answer, reason, reason IS NOT NULL OR advised AS recommended FROM r",
    "p12_outcome_gate": "WITH r AS (SELECT event_id, event_type = 'error' AS failed, event_id % 11 = 0 AS quota, value > 180 AS late FROM events) SELECT event_id, CASE WHEN failed OR quota OR late THEN 'quarantine_retry_preserve_payout' ELSE 'allow_payout_scoring' END AS action, failed OR quota OR late AS zero_payout_blocked, CASE WHEN quota THEN 'quota' WHEN late THEN 'sla_exceeded' WHEN failed THEN 'runtime_exception' ELSE 'ok' END AS reason FROM r",
    "q8_uri_leakage": "WITH s AS (SELECT DISTINCT l_partkey AS uri, CASE WHEN l_orderkey % 50 < 40 THEN 'train' WHEN l_orderkey % 50 < 45 THEN 'val' ELSE 'test' END AS split FROM lineitem), p AS (SELECT * FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) v(one, two)) SELECT one, two, count(*) AS n FROM p JOIN s a ON a.split = one JOIN s b ON b.split = two AND a.uri = b.uri GROUP BY one, two",
    "a37_split_hash": "SELECT p_size % 3 AS split, substr(sha256(string_agg(p_name || '#' || p_partkey, chr(10) ORDER BY p_name || '#' || p_partkey)), 1, 16) AS hash, count(*) AS n FROM part GROUP BY p_size % 3",
    "a38_catalog_fingerprint": "WITH r AS (SELECT p_type, concat_ws('|', lpad(CAST(p_partkey AS VARCHAR), 12, '0'), p_brand, p_name, CAST(p_size AS VARCHAR)) AS entry FROM part) SELECT p_type, sha256(string_agg(entry, ';' ORDER BY entry)) AS fingerprint FROM r GROUP BY p_type",
    "j27_fuzzy_catalog": """
WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS id, concat_ws('|', p_brand, p_name, p_size) AS product, p_brand AS brand, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 5 = 0 THEN ['odd'] ELSE list_distinct(string_split(p_name, ' ')) END AS t, p_size % 3 AS pack, p_type AS category FROM part),
x AS (SELECT a.id, min(b.id) AS entry FROM p a JOIN p b ON a.id % 3 > 0 AND b.id % 3 = 0 AND a.product = b.product GROUP BY a.id),
c AS (SELECT a.id, b.id AS entry, round(len(list_intersect(a.t, b.t)) / CAST(len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)) AS DOUBLE), 6) AS jaccard, a.pack = b.pack AS sp, a.category = b.category AS sc FROM p a JOIN p b ON a.id % 3 > 0 AND b.id % 3 = 0 AND a.brand = b.brand WHERE a.id NOT IN (SELECT id FROM x)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY jaccard DESC, sp DESC, sc DESC, entry) AS place FROM c)
SELECT id, entry, CAST(1 AS DOUBLE) AS jaccard, false AS catch_all FROM x UNION ALL SELECT id, entry, jaccard, jaccard = 0 AS catch_all FROM r WHERE place = 1""",
    "j2_twin_union": "WITH f AS (SELECT DISTINCT p_name || p_partkey % 9 AS h, p_name || CASE p_size % 4 WHEN 0 THEN ' promo' WHEN 1 THEN '_rs20' WHEN 2 THEN ' xl' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN ' promo' ELSE '' END AS folder FROM part), b AS (SELECT h, arg_min(folder, (length(folder), folder)) AS base, count(*) AS n FROM f GROUP BY h HAVING count(*) > 1) SELECT h, base, n FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.h = b.h AND f.folder <> b.base AND NOT (starts_with(f.folder, b.base) AND regexp_full_match(substr(f.folder, length(b.base) + 1), '( promo|_rs[0-9]+)+')))",
    "j26_sister_product": "WITH c AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_brand, p_type, CASE WHEN p_size % 3 > 0 THEN 'save' || p_size % 4 ELSE '' END AS token, 'save' || p_partkey % 4 AS want FROM part) SELECT a.id, coalesce(min(b.id), a.id) AS sister FROM c a LEFT JOIN c b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.want = b.token GROUP BY a.id",
    "a41_join_completeness": f"WITH {_OBS}, m AS (SELECT concat(ways, 'way_', concat_ws('_', CASE WHEN variant <> '' THEN 'variant' END, CASE WHEN pack <> '' THEN 'pack' END, CASE WHEN brand <> '' THEN 'brand' END)) AS mode, reasons, CAST(CASE WHEN reasons <> '' THEN 0.0 WHEN ways = 3 THEN 1.0 WHEN ways = 2 THEN 0.99 ELSE 0.95 END AS DOUBLE) AS confidence FROM j) SELECT mode, count(*) AS hashes, count(*) FILTER (reasons <> '') AS conflicted, count(*) FILTER (contains(reasons, 'brand_')) AS brand, count(*) FILTER (contains(reasons, 'variant_')) AS variant, count(*) FILTER (contains(reasons, 'pack_')) AS pack, round(avg(confidence), 6) AS confidence FROM m GROUP BY mode",
    "a42_stage_deltas": f"WITH {_ANSWERS}, m AS (SELECT *, coalesce(place = 1, false) AS one FROM a) SELECT l_linenumber, count(*) FILTER (NOT gated) AS escalated, round(avg(CASE WHEN NOT gated THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) FILTER (NOT gated AND last_right AND NOT one) AS fixed, count(*) FILTER (NOT gated AND one AND NOT last_right) AS broken, round(avg(CASE WHEN one THEN 1.0 ELSE 0.0 END), 6) AS before, round(avg(CASE WHEN CASE WHEN gated THEN one ELSE last_right END THEN 1.0 ELSE 0.0 END), 6) AS after FROM m GROUP BY l_linenumber",
    "p7_extended_eligibility": "SELECT o_orderkey AS uri, o_custkey AS session, o_orderstatus = 'P' AS ambiguous FROM orders o WHERE o_orderkey % 10 = 9 AND o_orderstatus <> 'P' AND NOT EXISTS (SELECT 1 FROM orders t WHERE t.o_orderkey % 100 < 4 AND (t.o_custkey = o.o_custkey OR t.o_orderkey = o.o_orderkey))",
    "v38_triplets": "WITH i AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_brand || '/' || p_type AS class, p_partkey % 3 AS session, p_partkey % 11 AS hash, p_brand AS brand, p_size % 2 AS pack FROM part), t AS (SELECT a.id AS anchor, coalesce(min(b.id) FILTER (b.class = a.class AND b.session <> a.session), min(b.id) FILTER (b.class = a.class AND b.hash <> a.hash)) AS positive, coalesce(min(b.id) FILTER (b.class <> a.class AND b.brand = a.brand AND b.pack = a.pack), min(b.id) FILTER (b.class <> a.class)) AS negative FROM i a CROSS JOIN i b GROUP BY a.id) SELECT * FROM t WHERE positive IS NOT NULL AND negative IS NOT NULL",
    "u11_board_page": "SELECT event_type AS task, user_id % 20 AS run, round(avg(value), 4) AS score, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY event_type, user_id % 20 ORDER BY score DESC, n DESC, run LIMIT 10",
}
