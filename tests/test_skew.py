"""The salted join: right rows, balanced tasks, few hot keys."""

from statistics import median

import pytest
from pyspark.sql import functions as F

from trackmill.functions.changes import METRIC_NAMES
from trackmill.operators import comparison, skew


@pytest.fixture
def settled(spark):
    """Partitions stay as the plan deals them, and no side is broadcast for being small."""
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "false")
    spark.conf.set(names[1], "-1")
    yield spark
    for name, value in before.items():
        spark.conf.set(name, value)


def pairs_of(spark, n):
    """A third of the pairs on one baseline, the others on many."""
    base = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 997 + 1)
    return spark.range(n).select(
        F.concat(F.lit("run-"), base.cast("string")).alias("baseline_run_id"),
        F.concat(F.lit("run-"), (F.col("id") + 5000).cast("string")).alias("candidate_run_id"),
    )


def metrics_of(spark, n):
    values = [(F.col("id") * (i + 1)).cast("double").alias(name) for i, name in enumerate(METRIC_NAMES)]
    return spark.range(n).select(F.concat(F.lit("run-"), F.col("id").cast("string")).alias("run_id"), *values)


def largest_and_median(rows):
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes), median(sizes)


def test_a_baseline_with_a_third_of_all_pairs_is_shared_by_the_tasks(settled):
    pairs, metrics = pairs_of(settled, 300_000), metrics_of(settled, 305_000)
    based = skew.salted_join(
        pairs, metrics.withColumnRenamed("run_id", "baseline_run_id"), "baseline_run_id", "candidate_run_id"
    )
    largest, middle = largest_and_median(based)
    assert largest < 2 * middle
    plain = pairs.join(metrics.withColumnRenamed("run_id", "baseline_run_id"), "baseline_run_id")
    assert largest_and_median(plain)[0] > 2 * largest_and_median(plain)[1]
    wide = comparison.pair_metrics(pairs, metrics)
    largest, middle = largest_and_median(wide)
    assert wide.count() == 300_000 and largest < 2 * middle


def test_result_equals_a_plain_join(spark):
    pairs, metrics = pairs_of(spark, 3000), metrics_of(spark, 4000).where("run_id <> 'run-17'")
    same = spark.createDataFrame([("run-1", "run-1"), (None, "run-2"), ("run-3", None), ("run-0", "run-2")], "baseline_run_id string, candidate_run_id string")
    pairs = pairs.unionByName(same).unionByName(same)
    b, c = (metrics.select(*[F.col(x).alias(f"{p}_{x}") for x in metrics.columns]) for p in "bc")
    plain = pairs.where("baseline_run_id <> candidate_run_id").join(b, F.col("baseline_run_id") == F.col("b_run_id"))
    plain = plain.join(c, F.col("candidate_run_id") == F.col("c_run_id")).drop("b_run_id", "c_run_id")
    wide = comparison.pair_metrics(pairs, metrics)
    assert sorted(wide.select(plain.columns).collect()) == sorted(plain.collect())
    assert comparison.pair_metrics(pairs.limit(0), metrics).collect() == []


def test_hot_keys_are_few_and_get_enough_salts(spark):
    keys = skew.hot_keys(pairs_of(spark, 30_000), "baseline_run_id", partitions=4).collect()
    assert [k.baseline_run_id for k in keys] == ["run-0"]
    assert keys[0].salts == -(-10_000 // -(-30_000 // 64))
    even = spark.range(5000).select((F.col("id") % 50).alias("k"))
    assert skew.hot_keys(even, "k", partitions=100).count() == 50 < skew.SHARE * 100
    assert skew.hot_keys(even.limit(0), "k").collect() == []
