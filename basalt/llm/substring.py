"""Substring dedup with a log-structured fingerprint index.

A window is ``width`` consecutive words. A word goes if a window that covers it starts with the same word sequence
earlier: in a smaller doc_id, or in the same document further left. Windows are judged on the input.

Fingerprints are the windows' minimisers: of the hashes of all runs of ``gram`` words in a window the smallest, leftmost
first. Equal windows have equal minimisers, so a window whose minimiser occurs once occurs once, and one in seven words
gives a fingerprint. The index is a folder of *runs*, sorted immutable tables with one row a distinct fingerprint and list of the hashes, 48 bits each, of the
windows that share it. A manifest names the
runs; ``Index.open`` reads it in a later job. A batch reads its own texts alone, never the history's: its run's fingerprints
are merge-joined with those of each historical run; the fingerprints found there, and those that the batch
has twice, are *shared*. The batch's windows of shared fingerprints and the history's meet
in one task a fingerprint, are sorted by window hash and by document, and all but the first are repeats. Windows count as equal by 64 bits of a hash of ``gram``
of their words and 48 bits of another hash of all their words. Then the batch's run
joins the manifest. A batch that finds more than ``most_runs`` runs first compacts them into one.

Shared fingerprints reach the tasks as a filter of 2^27 bits (16 MB, whatever the input): one that it lets through by chance
costs rows, not results. A task sends only the first of equal windows of a slice into the shuffle and marks the others, so a
passage in a third of all documents sends one row a slice, not one a document.

Results: null texts have no words (digest of nothing); rows with a null id come after all others; rows of one id and
text are one document, rows of one id and different texts are ordered by a hash of the text; other columns do
not matter; an empty table gives an empty table; texts are read whole. A run without its line in the manifest (its job was lost)
is never read; a batch that is repeated after its line was written finds itself, so repeat from the manifest before it.
"""

from __future__ import annotations

import json
import uuid
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, freed
from .words import hashes_of, mix, windows, word_hashes

WIDTH, GRAM = 20, 8
FILTER_BITS = 27
#: Rows turned into Python objects at once; equal windows among them meet before the shuffle.
ROWS = 1024
LAST = (1 << 63) - 1
#: The place of the history: before every document.
PAST = -(1 << 63)
#: Bytes of a window's hash, and the bits they keep.
BYTES = 6
MASK = np.uint64((1 << 8 * BYTES) - 1)
RUN = "fingerprint long, keys binary, n int"
#: The query's batches: cuts of the documents by id, so that the third batch follows a compaction of the first two.
CUTS = (0.125, 0.25)


def minimisers(h: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint of each window, and where it lies."""
    grams = windows(h, gram)
    span = width - gram + 1
    if len(grams) < span:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(len(grams) - span + 1)
    return grams[at], at


def changes(where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rising places the first index of each, and how often it comes."""
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    return first, np.diff(np.append(first, len(where)))


def packed(keys: np.ndarray) -> np.ndarray:
    """The kept bytes of window hashes."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES]).ravel()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(data, np.uint8).reshape(-1, BYTES)
    return out.view("<u8").ravel()


def binaries(values: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def shifted(fingerprints: np.ndarray) -> np.ndarray:
    return (fingerprints >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def prepared(docs: DataFrame) -> DataFrame:
    """doc (the id, null last), salt (of the text, tells rows of one id apart), doc_id and text."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("doc"), F.shiftright(F.xxhash64(text), 32).cast("int").alias("salt"), docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))


def run_rows(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """The rows of a batch's run: fingerprint, its windows' hashes and how often a slice has them (2: twice or more)."""

    def run(batches):
        memo = word_hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                value, size, keys = [], [], []
                for text in batch.column("text").slice(at, ROWS).to_pylist():
                    h = hashes_of(text.encode().split(), memo)
                    v, where = minimisers(h, width, gram)
                    if len(v):
                        start, many = changes(where)
                        value.append(v[start])
                        size.append(many)
                        keys.append(windows(h, width))
                if not value:
                    continue
                value, size, keys = map(np.concatenate, (value, size, keys))
                ends = np.cumsum(size)
                # the first and the last window hold all words of a row, as it has no more windows than a window words
                first, last = keys[ends - size], keys[ends - 1]
                order = np.lexsort((size, last, first, value))
                same = [x[order][1:] == x[order][:-1] for x in (value, first, last, size)]
                new = np.flatnonzero(np.concatenate([[True], ~np.logical_and.reduce(same)]))
                many, one = np.diff(np.append(new, len(order))), order[new]
                yield pa.RecordBatch.from_arrays([pa.array(value[one].view(np.int64)), binaries(packed(keys), size * BYTES).take(pa.array(one)), pa.array(np.minimum(many, 2).astype(np.int32))], ["fingerprint", "keys", "n"])

    return docs.select("text").mapInArrow(run, RUN)


class Index:
    """Sorted immutable runs in a folder, named by the newest of its manifests."""

    def __init__(self, spark: SparkSession, folder: str, most_runs: int = 4, runs: list[str] | None = None, version: int = 0):
        self.spark, self.folder, self.most_runs, self.runs, self.version = spark, folder.rstrip("/"), most_runs, runs or [], version

    @classmethod
    def open(cls, spark: SparkSession, folder: str, most_runs: int = 4) -> Index:
        """The index that an earlier job left in the folder, or an empty one."""
        index = cls(spark, folder, most_runs)
        files, top = index._files()
        names = sorted(s.getPath().getName() for s in files.listStatus(top)) if files.exists(top) else []
        if manifests := [n for n in names if n.startswith("manifest-")]:
            told = json.loads(spark.read.text(f"{index.folder}/{manifests[-1]}", wholetext=True).first().value)
            index.runs, index.version = told["runs"], told["version"]
        return index

    def _files(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _commit(self, runs: list[str]) -> None:
        version = self.version + 1
        files, path = self._files(f"manifest-{version:08}")
        out = files.create(path, False)  # fails if another job wrote this version
        out.write(bytearray(json.dumps({"version": version, "runs": runs}).encode()))
        out.close()
        self.runs, self.version = runs, version

    def write(self, rows: DataFrame) -> str:
        """A run that no manifest names yet."""
        name = f"run-{uuid.uuid4().hex[:12]}"
        rows.sortWithinPartitions("fingerprint").write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return name

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(f"{self.folder}/{name}")

    def add(self, name: str) -> None:
        self._commit([*self.runs, name])

    def compact(self) -> None:
        """All runs merged into one, if there are more than most_runs."""
        if len(self.runs) <= self.most_runs:
            return
        merged = self.read(self.runs[0])
        for name in self.runs[1:]:
            merged = merged.unionByName(self.read(name))
        old, one = self.runs, self.write(merged.groupBy("fingerprint", "keys").agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n")))
        self._commit([one])
        for name in old:
            files, path = self._files(name)
            files.delete(path, True)


def shared_fingerprints(run: DataFrame, history: list[DataFrame]) -> DataFrame:
    """Fingerprints of a batch's run that it has twice or that a historical run has."""
    own = run.groupBy("fingerprint").agg(F.sum("n").alias("n"))
    out = own.where("n > 1").select("fingerprint")
    for old in history:
        out = out.unionByName(own.select("fingerprint").hint("merge").join(old.select("fingerprint").hint("merge"), "fingerprint", "left_semi"))
    return out


def bit_filter(shared: DataFrame) -> np.ndarray:
    """A bit for each value of the highest FILTER_BITS bits, set if a shared fingerprint has it: 2^27 bits whatever the input."""
    # Spark numbers buckets of 32,768 places from 1, the first of which holds places 1 to 32768
    place = (F.shiftrightunsigned("fingerprint", 64 - FILTER_BITS) + 1).alias("p")
    pieces = shared.select(place).groupBy(F.expr("bitmap_bucket_number(p)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in pieces.collect():
        out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def passes(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0


def repeats(docs: DataFrame, history: list[DataFrame], bits, width: int, gram: int) -> DataFrame:
    """doc, salt and runs of the windows whose sequence starts earlier in docs or is in the history: a run is its first start times 2^32 plus its number of windows."""

    def emit(batches):
        memo, found = word_hashes(), bits.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                cols = [[np.empty(0, np.int64)] for _ in range(5)]
                for i, text in enumerate(part.column("text").to_pylist()):
                    h = hashes_of(text.encode().split(), memo)
                    value, where = minimisers(h, width, gram)
                    if not len(value):
                        continue
                    one, many = changes(where)
                    start = np.flatnonzero(np.repeat(passes(found, shifted(value[one])), many))
                    if len(start):
                        for col, x in zip(cols, ((windows(h, width)[start] & MASK).view(np.int64), value[start].view(np.int64), where[start], np.full(len(start), i), start), strict=True):
                            col.append(x)
                key, value, where, row, start = map(np.concatenate, cols)
                if not len(key):
                    continue
                doc, salt = (np.asarray(part.column(c)) for c in ("doc", "salt"))
                order = np.lexsort((start, salt[row], doc[row], key, value))
                k, v, d, t, s = key[order], value[order], doc[row[order]], salt[row[order]], start[order]
                marked = np.zeros(len(key), bool)
                # not the first: an equal window of another place stands before it, be it of the same row read twice or not
                new = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])])
                head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
                marked[order] = (d != d[head]) | (t != t[head]) | (s != s[head])
                yield from segments(doc, salt, value, where, row, start, key, ~marked)
                yield from segments(doc, salt, mix(row.astype(np.uint64) + doc[row].view(np.uint64)).view(np.int64), row, row, start, None, marked)

    def segments(doc, salt, value, where, row, start, key, which):
        """A row for each run of windows of one document and minimiser, with their hashes or, marked ones, none."""
        value, where, row, start = (x[which] for x in (value, where, row, start))
        if not len(row):
            return
        cut = np.nonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (where[1:] != where[:-1]) | (start[1:] != start[:-1] + 1)]))[0]
        ends = np.append(cut, len(row)).astype(np.int32)
        hashes = pa.nulls(len(cut), pa.list_(pa.int64())) if key is None else pa.ListArray.from_arrays(pa.array(ends), pa.array(key[which]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(value[cut]), pa.array(doc[row[cut]]), pa.array(salt[row[cut]]), pa.array(start[cut].astype(np.int32)), pa.array(np.diff(ends).astype(np.int32)), hashes],
            ["fingerprint", "doc", "salt", "start", "n", "hashes"],
        )

    def recall(batches):
        """The history's windows of shared fingerprints."""
        found = bits.value
        for batch in batches:
            value = np.asarray(batch.column("fingerprint"))
            some = np.nonzero(passes(found, shifted(value.view(np.uint64))))[0]
            for at in range(0, len(some), 16 * ROWS):
                part = batch.take(pa.array(some[at : at + 16 * ROWS]))
                held = part.column("keys").to_pylist()
                key, zero = unpacked(b"".join(held)), np.zeros(part.num_rows, np.int32)
                ends = np.append(0, np.cumsum([len(x) // BYTES for x in held])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("fingerprint"), pa.array(np.full(part.num_rows, PAST)), pa.array(zero), pa.array(zero), pa.array(zero), pa.ListArray.from_arrays(pa.array(ends), pa.array(key.view(np.int64)))],
                    ["fingerprint", "doc", "salt", "start", "n", "hashes"],
                )

    def joined(doc, salt, start):
        """A row for each run of neighbouring starts, whatever else of a document comes to this task."""
        order = np.lexsort((start, salt, doc))
        doc, salt, start = doc[order], salt[order], start[order]
        cut = np.nonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (salt[1:] != salt[:-1]) | (start[1:] != start[:-1] + 1)]))[0]
        run = (start[cut].astype(np.int64) << 32) | np.diff(np.append(cut, len(doc)))
        return pa.RecordBatch.from_arrays([pa.array(doc[cut]), pa.array(salt[cut]), pa.array(run)], ["doc", "salt", "run"])

    def later(batches):
        """Rows come by key, document and start; what does not come first of its key is repeated."""
        last, held, n = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            plain = batch.column("key").is_null().to_numpy(zero_copy_only=False)
            if plain.any():  # marked windows come first, as runs
                doc, salt, start, size = (np.asarray(batch.column(c))[plain] for c in ("doc", "salt", "start", "n"))
                within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                held.append((np.repeat(doc, size), np.repeat(salt, size), (np.repeat(start, size) + within).astype(np.int32)))
                n += len(held[-1][0])
                batch = batch.filter(pa.array(~plain))
                if not batch.num_rows:
                    continue
            key, value, doc, salt, start = (np.asarray(batch.column(c)) for c in ("key", "fingerprint", "doc", "salt", "start"))
            new = np.concatenate([[last is None or key[0] != last[0] or value[0] != last[1]], (key[1:] != key[:-1]) | (value[1:] != value[:-1])])
            head = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            first = [np.where(head >= 0, x[head], f) for x, f in zip((doc, salt, start), last[2:] if last else (0, 0, 0), strict=True)]
            repeated = (doc > PAST) & ((doc != first[0]) | (salt != first[1]) | (start != first[2]))
            last = (key[-1], value[-1], first[0][-1], first[1][-1], first[2][-1])
            held.append((doc[repeated], salt[repeated], start[repeated]))
            n += len(held[-1][0])
            if n > 1_000_000:
                yield joined(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield joined(*map(np.concatenate, zip(*held, strict=True)))

    schema = "fingerprint long, doc long, salt int, start int, n int, hashes array<long>"
    rows = docs.mapInArrow(emit, schema)
    for old in history:
        rows = rows.unionByName(old.mapInArrow(recall, schema))
    # the hashes of a fingerprint meet in one task, are spread out and sorted there
    dealt = rows.repartition("fingerprint").select("fingerprint", "doc", "salt", F.col("start").alias("from"), "n", F.posexplode_outer("hashes").alias("i", "key"))
    place = F.col("from") + F.when(F.col("doc") > PAST, F.coalesce("i", F.lit(0))).otherwise(0)
    told = dealt.select("key", "fingerprint", "doc", "salt", place.alias("start"), "n").sortWithinPartitions("key", "fingerprint", "doc", "salt", "start")
    return told.mapInArrow(later, "doc long, salt int, run long").groupBy("doc", "salt").agg(F.collect_list("run").alias("runs"))


def covered(n_words: int, runs: list[int] | None, width: int) -> np.ndarray:
    gone = np.zeros(n_words + 1, np.int64)
    if runs is not None and len(runs):
        r = np.asarray(runs, np.int64)
        np.add.at(gone, r >> 32, 1)
        np.add.at(gone, np.minimum((r >> 32) + (r & 0xFFFFFFFF) - 1 + width, n_words), -1)
    return np.cumsum(gone)[:n_words] > 0


def kept_words(text: str, runs: list[int] | None, width: int) -> tuple[list[bytes], int]:
    words = text.encode().split()
    gone = covered(len(words), runs, width)
    return [w for w, g in zip(words, gone, strict=True) if not g], int(gone.sum())


def dedup_batch(batch: DataFrame, index: Index, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """The batch's rows (doc, salt, doc_id, text), as ``prepared`` gives them, with the runs of repeated windows; its run joins the index.

    Every document of the index comes before the batch.
    """
    spark = batch.sparkSession
    scratch = Scratch(spark, "substring")
    with freed(spark):
        index.compact()
        history = [index.read(name) for name in index.runs]
        name = index.write(run_rows(batch, width, gram))
        bits = spark.sparkContext.broadcast(bit_filter(shared_fingerprints(index.read(name), history)))
        found = scratch.keep(repeats(batch.select("doc", "salt", "text"), history, bits, width, gram), "repeats")  # before a later batch replaces the runs
    bits.destroy()
    index.add(name)
    return batch.join(found, ["doc", "salt"], "left")


def dedup(docs: DataFrame, batches: int | tuple[float, ...] = CUTS, index: Index | None = None, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc, salt, doc_id, text and runs of all rows, taken in batches of rising ids: so many of about one size, or cut at those shares of the rows.

    index: of earlier documents, else an empty one that goes after the last batch.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "index")
    index = index or Index(spark, f"{scratch.folder}/runs", most_runs=1)
    docs = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    shares = [k / batches for k in range(1, batches)] if isinstance(batches, int) else list(batches)
    with freed(spark):
        cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, 1000).alias("q")).first().q or [] if shares else []
    out, low = None, None
    for high in [*sorted(set(cuts)), None]:
        batch = docs
        if low is not None:
            batch = batch.where((F.col("doc_id") > low) | F.col("doc_id").isNull()) if high is None else batch.where(F.col("doc_id") > low)
        if high is not None:
            batch = batch.where(F.col("doc_id") <= high)
        done = dedup_batch(prepared(batch), index, width, gram)
        out, low = done if out is None else out.unionByName(done), high
    scratch.drop()  # the rows read the texts and the repeats alone
    return out


def digests(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for text, runs in zip(part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True):
                    words, gone = kept_words(text, runs, width)
                    out.append((len(words) + gone, gone, sha256(b" ".join(words)).hexdigest()))
                n, gone, digest = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.select("doc_id", "text", "runs").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: All windows of 20 words as texts: brute force, for small tables.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM w WHERE len(w) >= 20),
windows AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s : s + 19], ' ') ORDER BY doc_id, s) AS place FROM starts),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM windows WHERE place > 1),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
kept AS (SELECT words.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY words.i) FILTER (gone.i IS NULL) AS stay FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY words.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(stay, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
