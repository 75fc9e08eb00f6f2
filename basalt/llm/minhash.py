"""Near-duplicate documents by b-bit MinHash.

Words are runs of other characters than space and U+0009 to U+000D, A-Z lower-cased. A document's set is its distinct
shingles of ``k`` words; fewer words make one shingle. Equal sets are one class, so exact copies cost one comparison
however many they are.

``bands * rows`` minima sign a set. Groups of ``rows`` minima are band keys: at similarity 0.8, 24 bands of 4 miss a pair
with a chance of 3e-6. Of every minimum the lowest 4 bits are kept, packed; the share of equal ones, less
the 1/16 that agree by chance, estimates the similarity. Candidates estimated at 0.2 below the threshold or less (five
standard errors) are passed over. The others are estimated again by the minima of 512 bins of one permutation, 4 bits each too (0: an
empty bin), and passed over at 0.1 below the threshold or less, again five standard errors. What is left is confirmed on the full sets.

Candidates are not all pairs of a band's bucket. Each bucket's first member (one random order for all buckets, so a group
of copies meets the same centre) is compared with the others, and links are contracted to components. Only buckets
that still hold several components go on, in blocks of bounded size. A task takes two blocks: first by signatures, and
returns the members that have a likely partner in another component; then those alone, with their full sets, and
returns the confirmed links that join components, at most one less than its members. So every likely pair that could join two components is
confirmed or refuted, and no list of pairs is ever written.

Results: null texts and texts without words have an empty set and link with nothing; rows with a null id have no component
and are kept; repeated rows, and rows of one id whose sets are equal, are one document; rows of one id and different texts are judged each
by its own text and have the id's smallest component each; other columns do not matter; an empty table gives
an empty table; texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from .components import components, joined
from .scratch import Scratch
from .words import free, hashes_of, mix, slices, windows, word_hashes

BANDS, ROWS, BITS = 24, 4, 4
#: Members of a block, and shingles of a block (8 bytes each), that are compared with each other.
BLOCK, BLOCK_SHINGLES = 512, 4_000_000
#: How far below the threshold an estimate may lie: five standard errors at 0.8.
MARGIN = 0.2
#: The second signature's bins (a power of two), and how far below the threshold its estimate may lie: five standard errors at 0.8.
BINS, FINE_MARGIN = 512, 0.1

_random = np.random.default_rng(20240229)
_XOR = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_ODD = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def shingles(text: str | None, memo, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.encode().lower().split() if text else []  # bytes.lower() changes A-Z alone
    if not words:
        return np.empty(0, np.uint64)
    h = hashes_of(words, memo)
    return np.unique(windows(h, min(k, len(h))))


def minima(found: np.ndarray) -> np.ndarray:
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(out, ((x[None, at : at + 2048] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    rows = m.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        out = mix(out ^ rows[:, i])
    return out


def fine(found: np.ndarray) -> np.ndarray:
    """A code of 1 to 15 for the least hash of every bin of one permutation, 0 for an empty bin."""
    x = np.sort(mix(found ^ np.uint64(0x5851F42D4C957F2D)))
    at, first = np.unique(x >> np.uint64(64 - BINS.bit_length() + 1), return_index=True)
    out = np.zeros(BINS, np.uint8)
    out[at.astype(np.int64)] = x[first] % np.uint64(15) + np.uint64(1)
    return out


def nibbles(codes: np.ndarray) -> bytes:
    return (codes[0::2] | codes[1::2] << 4).tobytes()


def packed(m: np.ndarray, found: np.ndarray) -> bytes:
    """The low bits of the minima, then those of the bins."""
    return nibbles((m & np.uint32(15)).astype(np.uint8)) + nibbles(fine(found))


def coarse_estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities from the packed minima (bytes in the last axis), corrected for chance agreement of 1 in 16."""
    x = a ^ b
    same = ((x & 15) == 0).sum(-1, dtype=np.int32) + ((x >> 4) == 0).sum(-1, dtype=np.int32)
    return (same / (BANDS * ROWS) - 1 / 16) / (1 - 1 / 16)


def fine_estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities from the packed bins; of those filled on both sides, 1 in 15 agrees by chance."""
    same, both, either = 0, 0, 0
    for x, y in ((a & 15, b & 15), (a >> 4, b >> 4)):
        filled = (x > 0) & (y > 0)
        same = same + (filled & (x == y)).sum(-1, dtype=np.int32)
        both = both + filled.sum(-1, dtype=np.int32)
        either = either + ((x | y) > 0).sum(-1, dtype=np.int32)
    return (same - both / 15) / (1 - 1 / 15) / np.maximum(either, 1)


def likely_rows(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of signatures ``b`` beside ``a`` (one or as many) the places that both estimates let pass, and the finer estimates there."""
    n = BANDS * ROWS // 2
    at = np.nonzero(coarse_estimates(a[..., :n], b[:, :n]) >= least - MARGIN)[0]
    e = fine_estimates((a if a.ndim == 1 else a[at])[..., n:], b[at, n:])
    near = e >= least - FINE_MARGIN
    return at[near], e[near]


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, said (a hash of the text) and text."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("said"), docs["text"].alias("text"))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, said, n_shingles, digest of the set, band keys and packed signature of each row."""

    def run(batches):
        from xxhash import xxh3_128_digest

        memo = word_hashes()
        for batch in batches:
            for ids, said, texts in slices(batch, "doc_id", "said", "text"):
                out = []
                for text in texts:
                    found = shingles(text, memo, k)
                    if len(found):
                        m = minima(found)
                        out.append((len(found), xxh3_128_digest(found.tobytes()), band_keys(m).view(np.int64), packed(m, found)))
                    else:
                        out.append((0, None, None, None))
                n, digest, keys, sig = zip(*out, strict=True)
                columns = [pa.array(ids, pa.int64()), pa.array(said, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "said", "n_shingles", "digest", "keys", "sig"])

    return identified(docs).mapInArrow(run, "doc_id long, said long, n_shingles long, digest binary, keys array<long>, sig binary")


def sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node and its shingles (sorted hashes) of the classes wanted (node, least, digest), from a text of the id ``least``."""

    def run(batches):
        from xxhash import xxh3_128_digest

        memo = word_hashes()
        for batch in batches:
            for nodes, digests, texts in slices(batch, "node", "digest", "text"):
                found = [shingles(t, memo, k).tobytes() for t in texts]
                same = [i for i, x in enumerate(found) if xxh3_128_digest(x) == digests[i]]  # another text of the id is not meant
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in same], pa.int64()), pa.array([found[i] for i in same], pa.binary())], ["node", "shingles"])

    rows = identified(docs).select("doc_id", "text").join(wanted.select("node", F.col("least").alias("doc_id"), "digest"), "doc_id").select("node", "digest", "text")
    return rows.mapInArrow(run, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def likely(pairs: DataFrame, signed: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) those whose estimates are near ``least`` or above, with the estimate."""
    one = signed.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    two = signed.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                at, e = likely_rows(a, b, least)
                yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(at)), batch.column("b").take(pa.array(at)), pa.array(e, pa.float64())], ["a", "b", "estimate"])

    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long, estimate double")


def alike(both, n, m, percent: int):
    """Whether sets of n and m elements, ``both`` of them shared, reach the percentage."""
    return (both > 0) & (100 * both >= percent * (n + m - both))


def confirmed(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets, in known (node, shingles), share at least that percentage of their union."""

    def run(batches):
        for batch in batches:
            for a, b, x, y in slices(batch, "a", "b", "one", "two"):
                out = []
                for i, (one, two) in enumerate(zip(x, y, strict=True)):
                    one, two = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                    if alike(len(np.intersect1d(one, two, assume_unique=True)), len(one), len(two), percent):
                        out.append(i)
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in out], pa.int64()), pa.array([b[i] for i in out], pa.int64())], ["a", "b"])

    one = pairs.select("a", "b").join(known.select(F.col("node").alias("a"), F.col("shingles").alias("one")), "a")
    return one.join(known.select(F.col("node").alias("b"), F.col("shingles").alias("two")), "b").mapInArrow(run, "a long, b long")


def paired(rows: DataFrame, columns: list[str], judge, schema: str) -> DataFrame:
    """What judge makes of the rows (key, i, j, node, comp, own, ...) of each pair of blocks; a worker holds one pair at a time."""

    def run(batches):
        group, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, i, j = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j"))
            cuts = np.nonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0))[0] + 1
            for x, y in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if last != (key[x], i[x], j[x]):
                    if group:
                        yield from judge(pa.Table.from_batches(group), last)
                    group, last = [], (key[x], i[x], j[x])
                group.append(batch.slice(x, y - x))
        if group:
            yield from judge(pa.Table.from_batches(group), last)

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.select("key", "i", "j", "node", "comp", "own", *columns).mapInArrow(run, schema)


def with_partners(members: DataFrame, least: float) -> DataFrame:
    """The rows (key, i, j, node, comp, own) of members of pairs of blocks that have a likely partner in another component there."""

    def judge(rows: pa.Table, at):
        comp, own = (rows.column(c).to_numpy() for c in ("comp", "own"))
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(len(rows), -1)
        _, which, size = np.unique(comp, return_inverse=True, return_counts=True)
        order = np.lexsort((which, size[which]))  # the largest component comes last, so is never compared with itself
        which, own, sig = which[order], own[order], sig[order]
        ends, begin, some = np.append(np.nonzero(np.diff(which))[0] + 1, len(which)), 0, np.zeros(len(which), bool)
        for end in ends[:-1]:
            for r in range(begin, end):
                hit, _ = likely_rows(sig[r], sig[end:], least)
                hit = hit if at[1] == at[2] else hit[own[end:][hit] != own[r]]
                if len(hit):
                    some[r] = True
                    some[end + hit] = True
            begin = end
        if some.any():
            yield from rows.select(["key", "i", "j", "node", "comp", "own"]).take(pa.array(np.sort(order[some]))).combine_chunks().to_batches()

    return paired(members, ["sig"], judge, "key long, i int, j int, node long, comp long, own int")


def crossing(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of components, confirmed on the full sets: of every pair of blocks a spanning forest."""

    def judge(rows: pa.Table, at):
        comp, own = (rows.column(c).to_numpy() for c in ("comp", "own"))
        each = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        size = np.array([len(x) for x in each])
        start = np.concatenate([[0], np.cumsum(size)])
        vocabulary, ids = np.unique(np.concatenate(each), return_inverse=True)
        now, mark, links = comp.copy(), np.zeros(len(vocabulary), bool), []
        for r in range(len(each) - 1):
            apart = now[r + 1 :] != now[r]
            if at[1] != at[2]:
                apart &= own[r + 1 :] != own[r]
            if not apart.any():
                continue
            mark[ids[start[r] : start[r + 1]]] = True
            both = np.add.reduceat(mark[ids[start[r + 1] :]], start[r + 1 : -1] - start[r + 1], dtype=np.int64)
            mark[ids[start[r] : start[r + 1]]] = False
            for s in (r + 1 + np.flatnonzero(apart & alike(both, size[r], size[r + 1 :], percent))).tolist():
                if now[s] != now[r]:
                    links.append((comp[r], comp[s]))
                    now[now == now[s]] = now[r]
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return paired(members, ["shingles"], judge, "a long, b long")


def grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, said, n_shingles, digest, component (a number) and component_id (the smallest id that links reach) of each row; the last two null for sets that are empty or have no id."""
    scratch = Scratch(docs.sparkSession, "minhash")
    signed = scratch.keep(signatures(docs, k), "signatures")
    usable = signed.where("doc_id is not null and n_shingles > 0").groupBy("digest")
    classes = usable.agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    signs, threshold = classes.select("node", "sig"), percent / 100
    named = lambda nodes: classes.select("node", "least", "digest").join(nodes, "node", "left_semi")

    keyed = classes.select("node", "n", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min_by("node", F.xxhash64("node")).alias("centre")).where("members > 1")
    shared = scratch.keep(keyed.join(scratch.keep(buckets.select("key", "centre"), "buckets"), "key"), "shared")
    stars = shared.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    stars = scratch.keep(likely(stars, signs, threshold).select("a", "b"), "stars")
    in_stars = scratch.keep(sets(docs, named(stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()), k), "sets-of-stars")
    found = components(confirmed(stars, in_stars, percent), scratch, "found")

    held = shared.join(found, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("comp"))
    mixed = held.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("n")).where("x <> y")
    mixed = scratch.keep(mixed.select("key", F.ceil(F.greatest(F.col("members") / BLOCK, F.col("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "mixed")
    dealt = held.join(mixed, "key").join(signs, "node").withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    open_ = scratch.keep(with_partners(dealt, threshold), "open")
    in_blocks = scratch.keep(sets(docs, named(open_.select("node").distinct()), k), "sets-of-blocks")
    found = joined(found, crossing(open_.join(in_blocks, "node"), percent), scratch, "found-last")

    own = classes.select("digest", "node", "least").join(found, "node", "left").select("digest", "least", F.coalesce("component", "node").alias("component"))
    least = scratch.keep(own.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    own = scratch.keep(own.join(least, "component").select("digest", "component", "component_id"), "components")
    scratch.keep_only("signatures", "components")
    rows = signed.select("doc_id", "said", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    return rows.join(own, "digest", "left")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach) and kept of each row."""
    own = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    rows = grouped(docs, k, percent).select("doc_id", "n_shingles", own.alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: of the smallest id; of several texts of that id the first by
    digest. Rows with a null id or an empty set are no group; of rows of one id and text one stays, the first by a hash of all columns."""
    scratch = Scratch(docs.sparkSession, "minhash-keep")
    rows = scratch.keep(grouped(docs, k, percent).where("component is not null").select("doc_id", "said", "component", F.struct("doc_id", "digest", "said").alias("place")), "rows")
    first = scratch.keep(rows.groupBy("component").agg(F.min("place").alias("first")), "first")
    gone = rows.join(first, "component").where("place <> first").select("doc_id", "said").distinct()
    row, id_, said = (free(docs, c) for c in ("row", "id", "said"))
    whole = docs.where(docs["doc_id"].isNotNull()).select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias(row), docs["doc_id"].cast("long").alias(id_), F.xxhash64(docs["text"]).alias(said))
    stay = whole.join(gone.toDF(id_, said), [id_, said], "left_anti")
    order = F.xxhash64(*(F.col(f"{row}.`{f.name}`") for f in docs.schema if "map" not in f.dataType.simpleString()))
    once = stay.groupBy(id_, said).agg(F.min_by(row, order).alias(row))
    return once.select(f"{row}.*").unionByName(docs.where(docs["doc_id"].isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=80)


#: Every pair that shares a shingle, and every chain of links: brute force, for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS n, any_value(b.n) AS m FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM p WHERE 100 * common >= 80 * (n + m - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN least ON s.doc_id = least.doc_id
"""
