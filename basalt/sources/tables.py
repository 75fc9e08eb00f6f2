"""Readers and writers: typed scans whose filters and columns reach the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

ANNOTATION = "image string, x1 double, y1 double, x2 double, y2 double, class string, image_width int, image_height int"
BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def annotation_csv(spark: SparkSession, path: str) -> DataFrame:
    """One row an image, boxes in file order (files by name), size of the image's first row; rows with fewer than eight fields are left out.

    A row's place is its file, its split's offset there and its number within the split's task, so files stay splittable.
    """
    rows = spark.read.schema(ANNOTATION).option("mode", "DROPMALFORMED").csv(path).select("*", "_metadata.file_path", "_metadata.file_block_start")
    rows = rows.withColumn("line", F.monotonically_increasing_id()).where(F.col("image_height").isNotNull())
    place = F.struct("file_path", "file_block_start", "line")
    grouped = rows.groupBy("image").agg(F.min_by("image_width", place).alias("width"), F.min_by("image_height", place).alias("height"), F.array_sort(F.collect_list(F.struct(place.alias("place"), F.struct("x1", "y1", "x2", "y2", "class").alias("box")))).alias("at"))
    return grouped.select("image", "width", "height", F.transform("at", lambda x: x["box"]).alias("boxes"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a schema, blank lines skipped."""
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str, split: str | None = None) -> None:
    """A folder a split where a column names one."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(split) if split else writer).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def first_of(spark: SparkSession, paths: list[str], schema: str, split: str | None = None) -> DataFrame:
    """The rows of the first path that exists: JSON lines, or a manifest (.json) whose ``splits`` map has a list of rows for the split."""
    for p in paths:
        if exists(spark, p):
            if not p.endswith(".json"):
                return json_lines(spark, p, schema)
            manifest = spark.read.schema(f"splits map<string, array<struct<{schema}>>>").option("multiLine", True).json(p)
            return manifest.select(F.explode(F.element_at("splits", split)).alias("r")).select("r.*")
    raise FileNotFoundError(paths)


def map_rows(df: DataFrame, column: str, key: str = "id") -> DataFrame:
    """A map column as rows of a dimension."""
    return df.select(F.explode(F.map_entries(column)).alias("e")).select(F.col("e.key").cast("long").alias(key), "e.value.*")


def voc_xml(spark: SparkSession, path: str) -> DataFrame:
    """Objects of Pascal-VOC files."""
    box = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    return spark.read.format("xml").option("rowTag", "annotation").schema(f"filename string, size struct<width:int,height:int>, object array<struct<name:string,bndbox:{box}>>").load(path)


def yolo_boxes(text, width, height, decimals: int | None = None, classes: int | None = None):
    """Lines of class, centre and size, all shares of the image, as clipped pixel boxes; degenerate ones go.

    classes: how many there are; boxes of others go and a class is numbered from 1 on.
    """
    cells = F.transform(F.filter(F.split(text, "\n"), lambda s: F.size(F.split(F.btrim(s), r"\s+")) >= 5), lambda s: F.split(F.btrim(s), r"\s+"))
    number = lambda c, i: F.get(c, i).try_cast("double")
    cut = (lambda v: F.round(v, decimals)) if decimals is not None else (lambda v: F.floor(v).cast("double"))

    def box(c):
        x, y, w, h = (number(c, i) for i in range(1, 5))
        clip = lambda v, most: cut(F.greatest(F.lit(0.0), F.least(v, most.cast("double"))))
        return F.struct(
            F.get(c, 0).try_cast("int").alias("class"), clip((x - w / 2) * width, width).alias("x1"), clip((y - h / 2) * height, height).alias("y1"),
            clip((x + w / 2) * width, width).alias("x2"), clip((y + h / 2) * height, height).alias("y2"),
        )

    found = F.filter(F.transform(cells, box), lambda b: (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]))
    if classes is None:
        return found
    return F.transform(F.filter(found, lambda b: b["class"].between(0, classes - 1)), lambda b: b.withField("class", b["class"] + 1))


def labelme_boxes(shapes, width, height, least_width: float = 16, least_height: float = 20):
    """Shapes of two points as ordered boxes, clipped to the image, of a least size."""

    def box(s):
        a, b = s["points"][0], s["points"][1]
        clip = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most.cast("double")))
        return F.struct(s["label"].alias("label"), clip(F.least(a[0], b[0]), width).alias("x1"), clip(F.least(a[1], b[1]), height).alias("y1"), clip(F.greatest(a[0], b[0]), width).alias("x2"), clip(F.greatest(a[1], b[1]), height).alias("y2"))

    two = F.filter(shapes, lambda s: F.size(s["points"]) == 2)
    return F.filter(F.transform(two, box), lambda b: (b["x2"] - b["x1"] >= least_width) & (b["y2"] - b["y1"] >= least_height))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A header and a fixed order of columns."""
    df.select(*columns).write.mode("errorifexists").option("header", True).csv(path)


def drop(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_run(rows: DataFrame, summary: DataFrame, folder: str) -> None:
    """Rows first; the summary marks the run as complete, so a rerun takes the old one away before it touches the rows."""
    drop(rows.sparkSession, f"{folder}/summary")
    rows.write.mode("overwrite").parquet(f"{folder}/rows")
    summary.write.mode("overwrite").json(f"{folder}/summary")


def run_ids(spark: SparkSession, root: str) -> list[str]:
    """The finished runs below a folder, by name."""
    if not exists(spark, root):
        return []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(s.getPath().getName() for s in files)
    return [n for n in names if exists(spark, f"{root}/{n}/summary/_SUCCESS")]


def sync_runs(spark: SparkSession, source: str, target: str, prune: bool = False, overwrite: bool = False) -> dict[str, list[str]]:
    """Finished runs of source that target lacks (or all, to overwrite) are copied; with prune, runs that source lacks go from target."""
    here, there = run_ids(spark, source), run_ids(spark, target)
    copied = [n for n in here if overwrite or n not in there]
    for n in copied:
        write_run(spark.read.parquet(f"{source}/{n}/rows"), spark.read.json(f"{source}/{n}/summary"), f"{target}/{n}")
    gone = [n for n in there if n not in here] if prune else []
    for n in gone:
        drop(spark, f"{target}/{n}")
    return {"copied": copied, "pruned": gone}


def unfinished(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items without a finished row that has no error."""
    return items.join(done.where("error is null").select(key), key, "left_anti")


def write_guarded(df: DataFrame, folder: str, protected: tuple[str, ...]) -> None:
    """Never below a protected prefix, never over what exists."""
    if any(folder.startswith(p) for p in protected):
        raise ValueError(f"{folder} is protected")
    df.write.mode("errorifexists").parquet(folder)


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query's rows over JDBC; partitioned if the options say so."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def write_partitioned(df: DataFrame, table: str, partition: str, bucket: str, n: int, range_of: str | None = None, width: int = 1000) -> None:
    """A table partitioned by a column (with range_of, by its value in steps of width, as a column of that name) and bucketed by another."""
    if range_of:
        df = df.withColumn(partition, F.floor(F.col(range_of) / width) * width)
    df.write.mode("errorifexists").format("parquet").partitionBy(partition).bucketBy(n, bucket).sortBy(bucket).saveAsTable(table)


def zip_entries(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """File, name, size and offset of the members of zip archives, from their central directories; no member is unpacked.

    One archive is one task's value, so it must fit Spark's 2 GB limit; larger ones need a reader of byte ranges.
    """

    def run(batches):
        import io
        import zipfile

        import pandas as pd

        for batch in batches:
            found = [(p, m.filename, m.file_size, m.header_offset) for p, data in zip(batch.path, batch.content, strict=True) for m in zipfile.ZipFile(io.BytesIO(data)).infolist() if not m.is_dir() and m.file_size >= least]
            yield pd.DataFrame(found, columns=["file", "name", "size", "offset"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, name string, size long, offset long")


def select(spark: SparkSession, text: str, **named) -> DataFrame:
    """SQL with named parameters, bound as literals and never pasted into the text."""
    return spark.sql(text, args=named)
