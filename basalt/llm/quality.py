"""Quality rules: base counts of a text and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into 2^18 bins. Two multinomials over the bins are counted: *trusted* over documents
labelled quality 1 and not toxic, *raw* over all documents. A document's score is the mean, over its words and pairs, of
log(trusted share / raw share), so its length does not matter. One threshold, the one that parts labelled good
from labelled bad documents best, decides on every document. For the threshold a trusted document is scored without its own
trusted counts, as an unlabelled document of the same text would be.

Nothing is sampled: every labelled document fits the trusted multinomial and the threshold, and raw counts and decisions cover
all rows. Texts stay where they are and labels go to them, so ``fit`` reads the documents five times, once by ids alone; keep
as a table what is costly to work out again.

Results: a null text has no words, all counts 0, and fails the base rules; repeated rows count and are judged row by
row; rows with a null id have no label and are judged like others; extra columns are ignored by ``judge`` and kept by
``keep``; without labelled documents of both kinds the base rules alone decide; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import substring
from .scratch import Scratch
from .substring import bit_filter, passes
from .words import free, hashes_of, mix, slices, windows, word_hashes

BITS = 18
CHUNK = 1024
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def bins(h: np.ndarray) -> np.ndarray:
    """The bins of words and of pairs of neighbouring words."""
    shift = np.uint64(64 - BITS)
    return np.concatenate([mix(h) >> shift, windows(h, 2) >> shift]).astype(np.int64)


def repeated(h: np.ndarray, k: int = 3) -> int:
    """Words in windows of k words that the text has twice or more."""
    w = windows(h, k)
    if not len(w):
        return 0
    _, which, n = np.unique(w, return_inverse=True, return_counts=True)
    covered = np.zeros(len(h), bool)
    for i in range(k):
        covered[i : i + len(w)] |= n[which] > 1
    return int(covered.sum())


def measures(text: str | None, memo) -> tuple[tuple, np.ndarray]:
    text = text or ""
    h = hashes_of(text.encode().split(), memo)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    chars = len(text) - sum(map(text.count, SPACES))
    n_repeat = repeated(h)
    return (len(h), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), n_repeat, len(h) < 50 or 100 * n_repeat > 50 * len(h)), h


def score(h: np.ndarray, ratios: np.ndarray | None) -> float | None:
    return float(ratios[bins(h)].mean()) if ratios is not None and len(h) else None


class Model:
    """ratios: by bin, or None; threshold: the least score that is kept."""

    def __init__(self, ratios: np.ndarray | None, threshold: float | None):
        self.ratios, self.threshold = ratios, threshold

    def keeps(self, failed: bool, s: float | None) -> bool:
        return not failed and (s is None or self.threshold is None or s >= self.threshold)


def log_ratios(trusted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Of shares with one added to each bin."""
    return np.log((trusted + 1) / (trusted.sum() + len(trusted))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def held_out(h: np.ndarray, log_raw: np.ndarray, trusted: np.ndarray, own: bool) -> float | None:
    """The score; own: without the text's own counts among the trusted."""
    if not len(h):
        return None
    found, n = np.unique(bins(h), return_counts=True)
    less = n if own else 0
    share = np.log((trusted[found] - less + 1) / (trusted.sum() - np.sum(less) + len(trusted)))
    return float(((share - log_raw[found]) * n).sum() / n.sum())


def best_threshold(good: np.ndarray, bad: np.ndarray) -> float | None:
    """Where the share of good kept plus the share of bad rejected is largest: midway from the lowest score kept to the next below."""
    if not len(good) or not len(bad):
        return None
    good, bad = np.sort(good), np.sort(bad)
    at = np.unique(np.concatenate([good, bad]))
    gain = 1 - np.searchsorted(good, at) / len(good) + np.searchsorted(bad, at) / len(bad)
    best = int(np.argmax(np.round(gain, 12)))
    return float((at[max(0, best - 1)] + at[best]) / 2)


def count_bins(docs: DataFrame, those=lambda batches: batches) -> np.ndarray:
    """Counts by bin over all documents, or over those of each task's batches; tasks send dense chunks, which others add up."""
    size = 1 << BITS

    def count(batches):
        memo, total = word_hashes(), np.zeros(size, np.int64)
        for batch in those(batches):
            for (texts,) in slices(batch, "text"):
                found = [bins(hashes_of(t.encode().split(), memo)) for t in texts if t]
                if found:
                    total += np.bincount(np.concatenate(found), minlength=size)
        yield from chunks({c: total[c * CHUNK : (c + 1) * CHUNK] for c in range(size // CHUNK)})

    def chunks(parts):
        parts = {k: v for k, v in parts.items() if v.any()}
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([v.tolist() for v in parts.values()], pa.list_(pa.int64()))], ["chunk", "n"])

    def add(batches):
        total = {}
        for batch in batches:
            for chunk, n in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                at = total.setdefault(chunk, np.zeros(CHUNK, np.int64))
                at += np.asarray(n)
        yield from chunks(total)

    schema = "chunk int, n array<long>"
    out = np.zeros(size, np.int64)
    for row in docs.mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema).collect():  # at most 2^18 counts
        out[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] += np.asarray(row.n)
    return out


def where_set(docs: DataFrame, shared, columns: str, schema: str) -> DataFrame:
    """The columns of the rows whose place has its bit set in the broadcast filter."""
    names = columns.split()

    def some(batches):
        for batch in batches:
            yield batch.filter(pa.array(passes(shared.value, np.asarray(batch.column("place"))))).select(names)

    return docs.select(*names, "place").mapInArrow(some, schema)


def labelled(docs: DataFrame, sides: DataFrame, scratch: Scratch) -> tuple:
    """A frame, the function that makes of its batches good and text of every document in sides (doc_id, good), and the broadcast filters it reads.
    Callers run the function within their own: a second Python stage in a task would be a second worker.

    The sides go to the texts, as two filters of 2^27 bits whatever the labels. A place that both sides have, or a document
    without a label (found by ids alone), tells nothing: the texts at such places meet their sides by a join.
    """
    bits = lambda ids: bit_filter(ids.select(F.xxhash64("doc_id").alias("fingerprint")))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - substring.FILTER_BITS).alias("place")
    docs = docs.where("doc_id is not null").select("doc_id", "text", place)
    broadcast = docs.sparkSession.sparkContext.broadcast
    good, bad = bits(sides.where("good")), bits(sides.where("not good"))
    either = broadcast(good | bad)
    unsure = good & bad | bits(where_set(docs, either, "doc_id", "doc_id long").join(sides, "doc_id", "left_anti"))
    either.unpersist()
    shared = broadcast((good & ~unsure, bad & ~unsure))

    def told(batches):
        for batch in batches:
            fine, poor = (passes(x, np.asarray(batch.column("place"))) for x in shared.value)
            good = batch.column("good")
            met, side = (x.to_numpy(zero_copy_only=False) for x in (good.is_valid(), good.fill_null(False)))
            side, some = np.where(met, side, fine), met | fine | poor
            yield pa.RecordBatch.from_arrays([pa.array(side[some]), batch.column("text").filter(pa.array(some))], ["good", "text"])

    found = docs.select(F.lit(None).cast("boolean").alias("good"), "text", "place")
    if not unsure.any():
        return found, told, shared
    odd = broadcast(unsure)
    rest = scratch.keep(where_set(docs, odd, "doc_id text", "doc_id long, text string").join(sides, "doc_id").select("good", "text"), "unsure")
    odd.unpersist()
    return found.unionByName(rest.withColumn("place", F.lit(0).cast("long"))), told, shared


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    spark = docs.sparkSession
    sides = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    sides = sides.agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    sides = sides.where("quality = 1 and toxic = 0 or quality = 0").select("doc_id", (F.col("quality") == 1).alias("good"))
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    if sides.select("good").distinct().count() < 2:
        return Model(None, None)
    scratch = Scratch(spark, "quality")
    known, told, filters = labelled(docs, sides, scratch)
    trusted = count_bins(known, lambda batches: (b.filter(b.column("good")) for b in told(batches)))
    if not trusted.any():
        filters.unpersist()
        scratch.drop()
        return Model(None, None)
    raw = count_bins(docs.select("text"))
    shared = spark.sparkContext.broadcast((np.log((raw + 1) / (raw.sum() + len(raw))), trusted))

    def scored(batches):
        memo = word_hashes()
        for batch in told(batches):
            for side, texts in slices(batch, "good", "text"):
                found = [(g, s) for g, t in zip(side, texts, strict=True) if t and (s := held_out(hashes_of(t.encode().split(), memo), *shared.value, g)) is not None]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found]), pa.array([x for _, x in found], pa.float64())], ["good", "score"])

    # bins of a thousandth: their number is bounded by the range of a log ratio, and the driver gets counts only
    counts = known.mapInArrow(scored, "good boolean, score double").groupBy("good", F.floor(F.col("score") * 1000).alias("bin")).count().collect()
    filters.unpersist()
    scratch.drop()
    side = {k: np.repeat([r.bin / 1000 for r in counts if r.good == k], [r["count"] for r in counts if r.good == k]) for k in (True, False)}
    return Model(log_ratios(trusted, raw), best_threshold(side[True], side[False]))


def judge(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """doc_id and, of each row, the base counts, base_failed, score and kept; or the named columns of kept rows alone."""
    shared, whole = docs.sparkSession.sparkContext.broadcast(model), free(docs, "whole_text")

    def run(batches):
        memo = word_hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for text in part.column(whole).to_pylist():
                    found, h = measures(text, memo)
                    s = score(h, shared.value.ratios)
                    out.append((*found, s, shared.value.keeps(found[-1], s)))
                if columns is not None:
                    yield part.select(columns).filter(pa.array([x[-1] for x in out]))
                    continue
                types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True))], ["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))])

    text = docs["text"].alias(whole)
    if columns is not None:
        return docs.select(*(docs[f"`{c}`"] for c in columns), text).mapInArrow(run, docs.select(*(docs[f"`{c}`"] for c in columns)).schema)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text).mapInArrow(run, f"doc_id long, {COLUMNS}")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    return judge(docs, fit(docs, labels), docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
