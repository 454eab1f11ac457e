import json
import os

from pyspark.sql import functions as F

from lumenframe.operators import review
from lumenframe.streaming import landing, verdicts

EDITS = "key long, edit_id long, edit_ts timestamp, verdict string"


def write(path, case, ids, parent="aorta"):
    d = [{"instance_id": i, "parent_instance_id": "aorta", "ostium_xyz_mm": [1.0, 2.0, 3.0], "seed_xyz_mm": [1.0, 2.0, 8.0], "radius_mm": 1.0, "direction_xyz": [0.0, 0.0, 1.0]} for i in ids]
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        json.dump({"case_id": case, "parent": {"instance_id": parent}, "daughters": d}, f, indent=2)


def test_landing_splits_good_and_bad_and_continues(spark, folder):
    write(f"{folder}/in/a.json", "a", ["b1", "b2"])
    write(f"{folder}/in/b.json", "b", ["b1", "b1"])
    write(f"{folder}/in/c.json", "c", ["b1"], parent="other")
    landing.start_landing(spark, f"{folder}/in", f"{folder}/out", f"{folder}/ck").awaitTermination()
    write(f"{folder}/in/d.json", "d", ["b1"])
    landing.start_landing(spark, f"{folder}/in", f"{folder}/out", f"{folder}/ck").awaitTermination()
    good = spark.read.parquet(f"{folder}/out/landmarks")
    assert sorted((r.case_id, r.id) for r in good.collect()) == [("a", "b1"), ("a", "b2"), ("d", "b1")]
    bad = {(r.source_path[-6:], r.rule) for r in spark.read.parquet(f"{folder}/out/violations").collect()}
    assert bad == {("b.json", "duplicate_instance_id"), ("c.json", "parent_not_aorta")}


def test_verdict_stream_equals_the_batch_upsert(spark, folder):
    n = F.col("id")
    edits = spark.range(400).select(
        (n % 17).alias("key"), (n * 7 % 400).alias("edit_id"), F.timestamp_seconds(1_700_000_000 + (n * 13 % 97) * 60).alias("edit_ts"), F.concat(F.lit("v"), (n % 5).cast("string")).alias("verdict")
    )
    edits.repartition(5).write.parquet(f"{folder}/log")
    edits.limit(40).coalesce(1).write.mode("append").parquet(f"{folder}/log")  # delivered twice
    stream = spark.readStream.schema(EDITS).option("maxFilesPerTrigger", 2).parquet(f"{folder}/log")
    verdicts.start_verdicts(stream, f"{folder}/out", f"{folder}/ck").awaitTermination()
    want = review.current_verdicts(edits)
    got = verdicts.current(spark, f"{folder}/out")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert len(os.listdir(f"{folder}/out")) > 1
    small = verdicts.compact(spark, f"{folder}/out", f"{folder}/compact")
    later = spark.createDataFrame([(3, 999, None, "new")], EDITS).withColumn("edit_ts", F.timestamp_seconds(F.lit(1_800_000_000)))
    after = {r.key: r.verdict for r in review.current_verdicts(later, small).collect()}
    before = {r.key: r.verdict for r in want.collect()}
    assert after == {**before, 3: "new"}
