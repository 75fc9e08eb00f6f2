import pytest
from pyspark.sql import functions as F

from basalt.operators import approaches


def test_registry_composition_and_traces(spark):
    images = spark.createDataFrame([(1,), (2,)], "image long")
    detect = lambda x: x.select("image", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("id"))
    first = lambda b: b.withColumn("product", F.when(F.col("id") == 0, 7).cast("long")).withColumn("confidence", F.when(F.col("id") == 0, 0.9))
    seen = []

    def second(b):
        seen.append(sorted((r.image, r.id) for r in b.collect()))
        return b.withColumn("product", F.when(F.col("id") == 1, 8).cast("long")).withColumn("confidence", F.lit(0.4))

    both = approaches.register(approaches.compose("two steps", detect, [first, second], 0.5))
    got = sorted((r.image, r.id, r.product, r.confidence) for r in approaches.get("two steps").run(images).collect())
    assert got == [(i, j, p, c) for i in (1, 2) for j, p, c in ((0, 7, 0.9), (1, 8, 0.4), (2, None, None))]
    assert seen[0] == [(1, 1), (1, 2), (2, 1), (2, 2)] and both in approaches.all_approaches("detect_and_identify")
    with pytest.raises(ValueError, match="registered"):
        approaches.register(both)
    with pytest.raises(KeyError, match="no approach"):
        approaches.get("other")
    row = images.limit(1).select(approaches.traced(approaches.traced(F.lit(None), "detect", F.lit(3)), "identify", F.lit(2), F.lit("slow")).alias("t"), approaches.billed(F.create_map(F.lit("in"), F.lit(2.0)), F.create_map(F.lit("in"), F.lit(1.0), F.lit("out"), F.lit(5.0))).alias("u")).first()
    assert [(s.stage, s["rows"], s.note) for s in row.t] == [("detect", 3, None), ("identify", 2, "slow")] and row.u == {"in": 3.0, "out": 5.0}
