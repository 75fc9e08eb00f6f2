"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where that is unset and Spark runs in one JVM."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="basalt-")
    return _FOLDERS[app]


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as an action ends, not when the driver happens to collect its garbage.

    It holds for frames made within; each must be run once, and there.
    """
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)


class Scratch:
    """Tables written once and reread, so that a lost executor repeats no finished stage.

    ``drop`` and ``keep_only`` remove tables that nothing reads any more; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _files(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def drop(self, *names: str) -> None:
        try:
            for path in [f"{self.folder}/{n}" for n in names] or [self.folder]:
                files, target = self._files(path)
                files.delete(target, True)
        except Exception:  # noqa: BLE001  the session is gone; the folder's owner clears it
            return

    def keep_only(self, *names: str) -> None:
        """Removes all tables but these, which what an operator returns still reads."""
        files, top = self._files(self.folder)
        held = [s.getPath().getName() for s in files.listStatus(top)] if files.exists(top) else []
        if gone := [n for n in held if n not in names]:
            self.drop(*gone)
