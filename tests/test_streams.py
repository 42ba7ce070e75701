from pyspark.sql import functions as F

from trackmill.operators import frames, fusion
from trackmill.sources import samples
from trackmill.streaming import live

FOLDER = "/root/testdata/sf0.001"


def split(spark, source, target, parts):
    """A sample table as several files, so that a stream needs several batches."""
    spark.read.parquet(f"{FOLDER}/{source}.parquet").repartition(parts).write.parquet(target)
    return live.file_stream(spark, target, "*.parquet", per_batch=1)


def test_live_totals_equal_the_batch_result(spark, tmp_path):
    orders = split(spark, "orders", f"{tmp_path}/orders", 3)
    lines = split(spark, "lineitem", f"{tmp_path}/lines", 4)
    got = live.live_run_totals(spark, samples.frames_from(orders), samples.detections_from(lines))
    want = frames.run_totals(samples.frames(spark, FOLDER), samples.detections(spark, FOLDER))
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())


def test_live_fusion_equals_the_batch_result(spark, tmp_path):
    messages = samples.messages_from(split(spark, "events", f"{tmp_path}/events", 3))
    rounded = [F.round(c, 6).alias(c) for c in ("fused_value", "confidence")]
    columns = ["fusion_id", *rounded, "sensor_count"]
    got = live.live_fusion(spark, messages).select(*columns)
    want = fusion.fuse(samples.sensor_messages(spark, FOLDER)).select(*columns)
    assert sorted(got.collect()) == sorted(want.collect())
