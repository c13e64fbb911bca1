"""Compaction moves each row once, into its range."""

from pyspark.sql import functions as F

from groundset.session import scratch_path
from groundset.sinks import store as sink
from groundset.sources import store


def _rows(spark, rows):
    df = spark.createDataFrame(rows, "run_id string, n int, confidence double")
    return df.select(
        F.concat_ws("-", "run_id", "n").alias("record_id"), "run_id", F.create_map(F.lit("n"), F.col("n").cast("string")).alias("data"),
        F.lit("k").alias("dedupe_key"), "confidence", F.array(F.lit("f")).alias("flags"), F.current_timestamp().alias("created_at"),
    )


def _store(spark):
    """Three versions, the first two compacted: run a is large, b replaced, c emptied, d new; x has no place in the list."""
    root = scratch_path(spark, "store")
    first = _rows(spark, [("a", i, 0.0) for i in range(40)] + [("b", 1, 0.0), ("b", 1, 0.0), ("c", 1, 0.0), ("x", 1, 0.0), (None, 1, 0.0)])
    sink.replace_runs({"records": first}, root, first.filter("run_id <> 'x' or run_id is null"), 0)
    second = _rows(spark, [("b", 2, 1.0)])
    sink.replace_runs({"records": second}, root, spark.createDataFrame([("b",), ("c",)], "run_id string"), 1)
    return root


def _read(df):
    return sorted((r["record_id"], r["run_id"], r["confidence"]) for r in df.collect())


def test_rows_by_run_are_the_current_rows(spark):
    root = _store(spark)
    for version in (2, 3):
        want = _read(store.read_current(spark, root, "records"))
        for limit in (1_000_000, 7):
            assert _read(store.current_by_run(spark, root, "records", rows_per_task=limit)) == want
        sink.compact(spark, root, version - 1)
        assert _read(store.read_current(spark, root, "records")) == want
        new = _rows(spark, [("a", 1, 2.0), ("d", 1, 2.0), ("d", 1, 2.0)])
        sink.replace_runs({"records": new}, root, new, version)
    assert [r[0] for r in _read(store.read_current(spark, root, "records"))] == ["a-1", "b-2", "d-1", "d-1"]


def test_a_large_run_stands_in_several_partitions(spark):
    root = _store(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = store.current_by_run(spark, root, "records", rows_per_task=7).filter("run_id = 'a'").withColumn("p", F.spark_partition_id())
    places = [r["p"] for r in parts.collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(set(places)) > 1 and len(places) == 40


def test_rows_to_compact_are_moved_once(spark):
    root = _store(spark)
    plan = store.current_by_run(spark, root, "records")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan, plan
