r"""Line dedup by a log-template tree of fixed depth. DataFrame functions only.

A line's tokens are its words with every run of digits as one 0. Its path in the tree is the number of tokens and the first
``depth`` of them; lines of one path meet in a leaf. In a group of token sequences, first a whole leaf, a position beyond the path
is *fixed* where one token holds in at least ``agree`` of the group's lines (a sequence counts once a document), else a variable
field. If at least ``agree`` of the positions beyond the path are fixed, the group has a template, and lines that have all its
fixed tokens are its instances. The group's other lines are split by their commonest token at a position where the group
differs, and the same holds for each part, ``levels`` times in all: the tree's depth is fixed. Any other line is its own template.

A template in at least ``least_docs`` documents recurs: its lines go from all documents but the one of the smallest id, so
the corpus keeps one copy. A line of at least ``long`` tokens besides its runs of digits recurs from two documents on; a variable
field shows only over ``least_docs``. Below ``least_docs`` documents a line stays in a document that shares nine tenths
of its tokens, in equal lines, with the line's first document: such copies stay whole for the near-duplicate operator. (Equal: of
equal tokens, each line once a document; runs of digits do not count as tokens here.)
Blank lines stay.

Results: null texts have no lines and stay null; rows with a null id are left alone and count for no template; rows of
one id are one document; other columns are kept by ``keep``, whatever their names; ties between a position's tokens go to the smaller hash;
an empty table gives an empty table; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import free

DEPTH, LEVELS, AGREE, LEAST_DOCS, LONG = 4, 4, 0.8, 5, 10


def masked(line: Column) -> Column:
    """The line's tokens joined by a space."""
    inner = F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")
    return F.btrim(F.regexp_replace(inner, "[0-9]+", "0"))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, sequence (a line's tokens, hashed), leaf, words (tokens less runs of digits) and line; each sequence once a row."""
    found = F.array_distinct(F.transform(F.split(docs["text"], "\n", -1), masked))
    rows = docs.where(docs["doc_id"].isNotNull() & docs["text"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), F.explode(found).alias("line")).where("line <> ''")
    tokens = F.split("line", " ")
    leaf = F.xxhash64(F.size(tokens), F.array_join(F.slice(tokens, 1, DEPTH), " "))
    words = F.size(tokens) - F.char_length("line") + F.char_length(F.replace("line", F.lit("0"), F.lit("")))
    return rows.select("doc_id", F.xxhash64("line").alias("sequence"), leaf.alias("leaf"), words.alias("words"), "line")


def templates(texts: DataFrame, scratch: Scratch, agree: float, least_docs: int, levels: int) -> DataFrame | None:
    """sequence and template of the instances among texts (leaf, sequence, tokens beyond the path, n)."""
    found = None
    rest = texts.select(F.col("leaf").alias("group"), "sequence", "tokens", "n")
    for level in range(levels):
        # a part that could recur and still has several sequences
        parts = rest.groupBy("group").agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("sequences")).where((F.col("lines") >= least_docs) & (F.col("sequences") > 1))
        parts = scratch.keep(parts.select("group", "lines"), f"parts{level}")
        if parts.isEmpty():
            return found
        rest = scratch.keep(rest.join(parts, "group"), f"rest{level}")
        cells = rest.select("group", "lines", "n", F.posexplode("tokens").alias("at", "token")).groupBy("group", "lines", "at", "token").agg(F.sum("n").alias("n"))
        cells = scratch.keep(cells, f"cells{level}")
        by_place = cells.groupBy("group", "lines", "at").agg(F.max(F.struct("n", F.bitwise_not("token").alias("back"))).alias("m"))
        fixed = F.when(F.col("m.n") >= agree * F.col("lines"), F.struct("at", F.bitwise_not("m.back").alias("token")))
        agreed = by_place.groupBy("group").agg(F.collect_list(fixed).alias("fixed"), F.count(F.lit(1)).alias("size"))
        agreed = scratch.keep(agreed.where(F.size("fixed") >= agree * F.col("size")).select("group", "fixed"), f"agreed{level}")
        has = F.forall("fixed", lambda f: F.get(F.col("tokens"), f["at"]) == f["token"])
        judged = scratch.keep(rest.join(agreed, "group", "left").select("group", "sequence", "tokens", "n", F.coalesce(has, F.lit(False)).alias("instance")), f"judged{level}")
        some = judged.where("instance").select("sequence", F.xxhash64("group", F.lit(level)).alias("template"))
        found = some if found is None else found.unionByName(some)
        if level + 1 < levels:
            left = judged.where("not instance").select("group", "sequence", "tokens", "n")
            each = left.select("group", "sequence", F.posexplode("tokens").alias("at", "token"))
            # only tokens of several lines can keep a part together
            shared = cells.where((F.col("n") < F.col("lines")) & (F.col("n") > 1)).select("group", "at", "token", F.col("n").alias("held"))
            anchor = each.join(shared, ["group", "at", "token"]).groupBy("group", "sequence").agg(F.max(F.struct("held", (-F.col("at")).alias("back"), "token")).alias("a"))
            rest = left.join(scratch.keep(anchor, f"anchor{level}"), ["group", "sequence"]).select(F.xxhash64("group", "a.back", "a.token").alias("group"), "sequence", "tokens", "n")
    return found


def copies(rows: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (doc_id, first) that share, in equal lines, nine tenths of the words of the two together."""
    ids = pairs.select("doc_id").unionByName(pairs.select(F.col("first").alias("doc_id"))).distinct()
    held = scratch.keep(rows.join(ids, "doc_id", "left_semi").select("doc_id", "sequence", "words").distinct(), "held")
    size = scratch.keep(held.groupBy("doc_id").agg(F.sum("words").alias("all")), "sizes")
    both = pairs.join(held, "doc_id").join(held.select(F.col("doc_id").alias("first"), "sequence"), ["first", "sequence"])
    both = both.groupBy("doc_id", "first").agg(F.sum("words").alias("both"))
    both = both.join(size, "doc_id").join(size.select(F.col("doc_id").alias("first"), F.col("all").alias("other")), "first")
    return both.where("10 * both >= 9 * (all + other - both)").select("doc_id", "first")


def long_recurring(rows: DataFrame, counted: DataFrame, scratch: Scratch, least_docs: int, long: int) -> DataFrame:
    """doc_id and sequence of the long lines that go though they stand in fewer than least_docs documents."""
    often = scratch.keep(counted.where((F.col("n") > 1) & (F.col("words") >= long)).select("sequence"), "often")
    held = scratch.keep(rows.select("doc_id", "sequence").join(often, "sequence", "left_semi").distinct(), "long")
    first = held.groupBy("sequence").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs").between(2, least_docs - 1))
    gone = scratch.keep(held.join(first.drop("docs"), "sequence").where("doc_id <> first").select("doc_id", "first", "sequence"), "long-gone")
    whole = copies(rows, scratch.keep(gone.select("doc_id", "first").distinct(), "pairs"), scratch)
    return gone.join(whole, ["doc_id", "first"], "left_anti").select("doc_id", "sequence")


def dropped(docs: DataFrame, scratch: Scratch, agree: float = AGREE, least_docs: int = LEAST_DOCS, long: int = LONG, levels: int = LEVELS) -> DataFrame:
    """doc_id and sequence of the lines that go."""
    rows = scratch.keep(lines(docs).drop("line"), "rows")
    # sequences of leaves that could recur: by hashes alone, pre-aggregated in the map tasks
    counted = scratch.keep(rows.groupBy("sequence", "leaf").agg(F.count(F.lit(1)).alias("n"), F.max("words").alias("words")), "counted")
    leaves = counted.groupBy("leaf").agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("n")).where(F.col("n") >= least_docs)
    leaves = scratch.keep(leaves, "leaves")
    small = rows.select("doc_id", "sequence", "leaf").join(leaves.select("leaf"), "leaf").select("doc_id", "sequence")
    small = scratch.keep(small.distinct(), "lines")
    # templates of leaves with several sequences
    several = leaves.where("sequences > 1").select("leaf")
    texts = lines(docs).join(several, "leaf", "left_semi").groupBy("leaf", "sequence").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("n"))
    tokens = F.split("line", " ")
    hashed = F.transform(F.slice(tokens, DEPTH + 1, F.size(tokens)), lambda t: F.xxhash64(t))
    texts = scratch.keep(texts.select("leaf", "sequence", hashed.alias("tokens"), "n"), "texts")
    instances = templates(texts, scratch, agree, least_docs, levels)
    named = small.withColumn("template", F.col("sequence"))
    if instances is not None:
        named = small.join(scratch.keep(instances, "instances"), "sequence", "left").select("doc_id", "sequence", F.coalesce("template", "sequence").alias("template"))
    first = named.select("doc_id", "template").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs") >= least_docs)
    first = scratch.keep(first.select("template", "first"), "recurring")
    gone = named.join(first, "template").where("doc_id <> first").select("doc_id", "sequence")
    return gone.unionByName(long_recurring(rows, counted, scratch, least_docs, long))


def cleaned(docs: DataFrame, **how) -> tuple[DataFrame, str, str]:
    """All columns of docs, their text without recurring lines, and the names of two more: the numbers of lines and of those gone."""
    scratch = Scratch(docs.sparkSession, "lines")
    id_, drop, stay, n_lines, n_gone = (free(docs, c) for c in ("id", "drop", "stay", "n_lines", "n_gone"))
    gone = dropped(docs, scratch, **how).groupBy("doc_id").agg(F.collect_set("sequence").alias(drop)).withColumnRenamed("doc_id", id_)
    gone = scratch.keep(gone, "gone")
    scratch.keep_only("gone")
    # one plan at every size: the dropped lines grow with the documents, so they are never broadcast
    joined = docs.join(gone.hint("merge"), docs["doc_id"].cast("long") == F.col(id_), "left")
    parts = F.split(docs["text"], "\n", -1)
    left = F.filter(parts, lambda x: ~F.array_contains(drop, F.xxhash64(masked(x))) | (masked(x) == ""))
    joined = joined.withColumn(stay, F.when(F.col(drop).isNull(), parts).otherwise(left))
    text = F.when(F.col(drop).isNull(), docs["text"]).otherwise(F.array_join(stay, "\n"))
    columns = [text.alias(c) if c == "text" else docs[f"`{c}`"] for c in docs.columns]
    out = joined.select(*columns, F.coalesce(F.size(parts), F.lit(0)).alias(n_lines), F.coalesce(F.size(parts) - F.size(stay), F.lit(0)).alias(n_gone))
    return out, n_lines, n_gone


def keep(docs: DataFrame, **how) -> DataFrame:
    """docs without recurring lines."""
    out, *more = cleaned(docs, **how)
    return out.drop(*more)


def query(spark, sf_dir: str) -> DataFrame:
    out, n_lines, n_gone = cleaned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda c: F.when(F.col("text").isNull(), 0).otherwise(F.col(c)).cast("long")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), of(n_lines).alias("n_lines"), of(n_gone).alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))
