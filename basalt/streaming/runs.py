"""Structured Streaming forms of the polling, resuming, retrying, session and cache behaviours.

Every stream reads files that arrive in a folder, keeps its progress under a checkpoint that the caller names (a folder that all
executors share), and may be started again at any time: what was done stays done.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basalt.operators.records import retried


def arriving(spark: SparkSession, folder: str, schema: str, kind: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    """Files of a folder as they arrive; with trigger(availableNow) a poll takes what is there and ends."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(folder)


def poll(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """One poll: rows that no earlier poll wrote are appended to ``out``; call it again, after a failure too."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_each(rows: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """R2: each key's first row; an item that is sent again within ``delay`` of its time is not repeated. State is dropped behind the watermark."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def with_retries(rows: DataFrame, done: str, again: str, checkpoint: str, sla: float = 180.0) -> StreamingQuery:
    """Rows (error, contract_error, latency, ...) split into those that count (``done``) and those to be tried again (``again``).

    Each batch writes folders of its own number, so a batch that is repeated overwrites what it wrote.
    """

    def split(batch: DataFrame, number: int) -> None:
        judged = retried(batch, sla)
        for folder, keep in ((done, ~F.col("zero_payout_blocked")), (again, F.col("zero_payout_blocked"))):
            judged.where(keep).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rows.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(rows: DataFrame, keys: list[str], time: str, gap_seconds: int = 300, delay: str = "1 hour") -> DataFrame:
    """Sessions of keys (a change of kind is a key) by a time gap: begin, last (the last row's time) and n; append mode gives a session once the watermark is past it.

    A session goes on over gaps of up to and including gap_seconds, so the window is a microsecond longer.
    """
    window = F.session_window(F.col(time), f"{gap_seconds} seconds 1 microsecond")
    out = rows.withWatermark(time, delay).groupBy(*keys, window).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("last"))
    return out.select(*keys, F.col("session_window.start").alias("begin"), "last", "n")


def content_key(*columns: str) -> Column:
    """The SHA-256 of the columns as canonical JSON, fields in order of name."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def cached(rows: DataFrame, columns: list[str], cache: str, answer, checkpoint: str) -> StreamingQuery:
    """Answers by content key: a batch asks only for keys that the cache folder lacks, each once, and adds them to it.

    answer(DataFrame of the columns and cache_key) -> with a column answer. The cache is a table of (cache_key, answer), one folder a batch.
    """

    def ask(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select(*columns, content_key(*columns).alias("cache_key")).dropDuplicates(["cache_key"])
        known = spark.read.schema("cache_key string, answer string, batch long").parquet(cache) if exists(spark, cache) else None
        if known is not None:
            new = new.join(known.where(F.col("batch") < number).select("cache_key"), "cache_key", "left_anti")
        answer(new).select("cache_key", F.col("answer").cast("string").alias("answer")).write.mode("overwrite").parquet(f"{cache}/batch={number}")

    return rows.writeStream.foreachBatch(ask).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


class Summary:
    """A result kept as a table and built anew when it is older than ``ttl`` seconds; readers see a whole version."""

    def __init__(self, spark: SparkSession, folder: str, ttl: float):
        self.spark, self.folder, self.ttl = spark, folder.rstrip("/"), ttl

    def _versions(self) -> list[tuple[float, str]]:
        if not exists(self.spark, self.folder):
            return []
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        return sorted((float(s.getPath().getName().split("-")[1]), s.getPath().getName()) for s in files if s.getPath().getName().startswith("version-"))

    def get(self, build, now: float) -> DataFrame:
        """The newest finished version, unless it is too old at ``now`` (seconds): then what build() gives, kept as a new one."""
        done = [(t, name) for t, name in self._versions() if exists(self.spark, f"{self.folder}/{name}/_SUCCESS")]
        if not done or now - done[-1][0] > self.ttl:
            name = f"version-{now:017.3f}-{uuid.uuid4().hex[:8]}"
            build().write.parquet(f"{self.folder}/{name}")
            done.append((now, name))
        return self.spark.read.parquet(f"{self.folder}/{done[-1][1]}")


# the same behaviours over the stand-in tables, as batches: SQL can compare them


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


QUERIES = {
    "r2_once_each": lambda spark, d: _events(spark, d).groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")),
    "r4_gap_sessions": lambda spark, d: sessions(_events(spark, d), ["user_id", "event_type"], "ts").select("user_id", "event_type", F.unix_micros("begin").alias("begin"), F.unix_micros("last").alias("last"), "n"),
    "r5_content_keys": lambda spark, d: _events(spark, d).select(content_key("user_id", "event_type").alias("cache_key"), "user_id", "event_type").groupBy("cache_key", "user_id", "event_type").agg(F.count(F.lit(1)).alias("n")),
}
ORACLES = {
    "r2_once_each": "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type",
    "r4_gap_sessions": "WITH g AS (SELECT *, CASE WHEN epoch_us(CAST(ts AS TIMESTAMP)) - lag(epoch_us(CAST(ts AS TIMESTAMP))) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 300000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, event_type, min(epoch_us(CAST(ts AS TIMESTAMP))) AS begin, max(epoch_us(CAST(ts AS TIMESTAMP))) AS last, count(*) AS n FROM s GROUP BY user_id, event_type, session",
    "r5_content_keys": """SELECT sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS cache_key, user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type""",
}
