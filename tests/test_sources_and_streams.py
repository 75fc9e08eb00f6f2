import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from basalt.sources import tables
from basalt.streaming import runs


def test_annotation_rows_in_file_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("b.jpg,9,9,20,20,x,100,50\nshort,1,2\nb.jpg,1,1,5,5,y,100,50\na.jpg,0,0,1,1,z,7,8\nb.jpg,3,3,4,4,x,100,50\n")
    got = {r.image: r for r in tables.annotation_csv(spark, str(tmp_path / "a.csv")).collect()}
    assert set(got) == {"a.jpg", "b.jpg"} and (got["a.jpg"].width, got["a.jpg"].height) == (7, 8)
    assert [b.x1 for b in got["b.jpg"].boxes] == [9, 1, 3]


def test_json_lines_splits_and_fallbacks(spark, tmp_path):
    schema = "image string, split string"
    rows = spark.createDataFrame([("é", "train"), ("b", "val")], schema)
    tables.write_json_lines(rows, f"{tmp_path}/out", "split")
    assert tables.json_lines(spark, f"{tmp_path}/out/split=train", "image string").first().image == "é"
    assert "é" in next((tmp_path / "out/split=train").glob("part-*")).read_text()
    (tmp_path / "m.json").write_text(json.dumps({"splits": {"val": [{"image": "m"}]}}))
    found = tables.first_of(spark, [f"{tmp_path}/none", f"{tmp_path}/m.json"], "image string", "val")
    assert [r.image for r in found.collect()] == ["m"]
    with pytest.raises(FileNotFoundError):
        tables.first_of(spark, [f"{tmp_path}/none"], "image string")


def test_voc_yolo_labelme(spark, tmp_path):
    (tmp_path / "v.xml").write_text("<annotation><filename>f.jpg</filename><size><width>5</width><height>6</height></size><object><name>n</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>")
    [r] = tables.voc_xml(spark, str(tmp_path / "v.xml")).collect()
    assert (r.filename, r.object[0].bndbox.xmax) == ("f.jpg", 3.0)
    text = "0 0.5 0.5 0.5 0.5\n7 0.5 0.5 0.2 0.2\n1 0.5 0.5 0 0\n0 0.1 0.1 0.333 0.4\n\nbad"
    frame = spark.createDataFrame([(text, 100, 200)], "t string, w int, h int")
    plain = frame.select(F.inline(tables.yolo_boxes(F.col("t"), F.col("w"), F.col("h")))).collect()
    assert [tuple(b) for b in plain] == [(0, 25, 50, 75, 150), (7, 40, 80, 60, 120), (0, 0, 0, 26, 60)]
    named = frame.select(F.inline(tables.yolo_boxes(F.col("t"), F.col("w"), F.col("h"), 1, 2))).collect()
    assert [b["class"] for b in named] == [1, 1] and named[1].x2 == 26.7
    shapes = [("p", [[50.0, 90.0], [10.0, -5.0]]), ("tiny", [[0.0, 0.0], [3.0, 3.0]]), ("three", [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]])]
    frame = spark.createDataFrame([(shapes, 40, 80)], "s array<struct<label:string,points:array<array<double>>>>, w int, h int")
    got = frame.select(F.inline(tables.labelme_boxes(F.col("s"), F.col("w"), F.col("h")))).collect()
    assert [tuple(b) for b in got] == [("p", 10.0, 0.0, 40.0, 80.0)]


def test_runs_are_marked_synced_and_guarded(spark, tmp_path):
    rows, summary = spark.createDataFrame([(1, None), (2, "e")], "id int, error string"), spark.createDataFrame([(2,)], "n int")
    tables.write_run(rows, summary, f"{tmp_path}/a/r1")
    rows.write.parquet(f"{tmp_path}/a/r2/rows")  # no summary: not finished
    tables.write_run(rows, summary, f"{tmp_path}/b/old")
    assert tables.sync_runs(spark, f"{tmp_path}/a", f"{tmp_path}/b", prune=True) == {"copied": ["r1"], "pruned": ["old"]}
    assert tables.run_ids(spark, f"{tmp_path}/b") == ["r1"] and tables.sync_runs(spark, f"{tmp_path}/a", f"{tmp_path}/b")["copied"] == []
    items = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert sorted(r.id for r in tables.unfinished(items, rows, "id").collect()) == [2, 3]
    with pytest.raises(ValueError, match="protected"):
        tables.write_guarded(rows, f"{tmp_path}/live/x", (f"{tmp_path}/live",))
    tables.write_csv(rows, f"{tmp_path}/csv", ["error", "id"])
    assert next((tmp_path / "csv").glob("part-*")).read_text().startswith("error,id\n")


def test_tables_archives_and_parameters(spark, tmp_path):
    tables.write_partitioned(spark.range(50), "basalt_parts", "step", "id", 4, "id", 20)
    assert spark.table("basalt_parts").where("step = 20").count() == 20
    assert "bucket" in spark.sql("DESCRIBE EXTENDED basalt_parts").where("col_name = 'Num Buckets'").first().col_name.lower()
    spark.sql("DROP TABLE basalt_parts")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/a.txt", "12345")
        z.writestr("b.txt", "")
    assert sorted((r.name, r["size"]) for r in tables.zip_entries(spark, str(tmp_path / "z.zip")).collect()) == [("b.txt", 0), ("d/a.txt", 5)]
    assert tables.select(spark, "SELECT :a AS a, :b AS b", a=1, b="x' OR 1").first().b == "x' OR 1"
    d = spark.createDataFrame([({"3": ("x",)},)], "m map<string,struct<name:string>>")
    assert tuple(tables.map_rows(d, "m").first()) == (3, "x")


SCHEMA = "id long, ts timestamp, user long, kind string, error string, contract_error string, latency double"


def event(i, second, **more):
    return (i, dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=second), 1, more.get("kind", "a"), more.get("error"), None, more.get("latency", 1.0))


def test_polls_resume_and_do_not_repeat(spark, tmp_path):
    write = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    write([event(1, 0), event(2, 10), event(1, 20)])
    stream = lambda: runs.once_each(runs.arriving(spark, f"{tmp_path}/in", SCHEMA), "id", "ts")
    runs.poll(stream(), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]
    write([event(2, 30), event(3, 40)])
    runs.poll(stream(), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    runs.poll(stream(), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]


def test_sessions_retries_and_caches(spark, tmp_path):
    rows = [event(1, 0), event(2, 300), event(3, 601), event(4, 610, kind="b"), event(5, 20_000, error="x"), event(6, 20_001, latency=500.0)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: runs.arriving(spark, f"{tmp_path}/in", SCHEMA)
    runs.poll(runs.sessions(stream(), ["user", "kind"], "ts"), f"{tmp_path}/sessions", f"{tmp_path}/c1").awaitTermination()
    got = sorted((r.kind, r.n) for r in spark.read.parquet(f"{tmp_path}/sessions").collect())
    assert got == [("a", 1), ("a", 2), ("b", 1)]  # the last session is still open: the watermark is not past it
    runs.with_retries(stream(), f"{tmp_path}/done", f"{tmp_path}/again", f"{tmp_path}/c2").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/done").collect()) == [1, 2, 3, 4]
    assert {r.id: r.reason for r in spark.read.parquet(f"{tmp_path}/again").collect()} == {5: "runtime_exception", 6: "sla_exceeded"}
    asked = []

    def answer(new):
        asked.append(new.count())
        return new.withColumn("answer", F.upper("kind"))

    for n in (1, 2):
        runs.cached(stream(), ["kind"], f"{tmp_path}/cache", answer, f"{tmp_path}/c3").awaitTermination()
        if n == 1:
            spark.createDataFrame([event(9, 5), event(10, 6, kind="c")], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert asked == [2, 1] and sorted(r.answer for r in spark.read.parquet(f"{tmp_path}/cache").collect()) == ["A", "B", "C"]


def test_summary_is_kept_until_it_is_old(spark, tmp_path):
    built, summary = [], runs.Summary(spark, f"{tmp_path}/s", ttl=60)
    build = lambda: built.append(1) or spark.range(len(built))
    assert [summary.get(build, now).count() for now in (1000.0, 1050.0, 1061.0)] == [1, 1, 2] and len(built) == 2
