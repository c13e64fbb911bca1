"""Evidence, which is as long as the pool, is never broadcast."""

from pyspark.sql import functions as F

from groundset.operators import clean
from groundset.plans.check_records import PART_SPEC
from groundset.session import cut_lineage


def test_evidence_is_not_broadcast(spark):
    """Guessed from its columns this pool is small enough to broadcast; as rows it may be any size."""
    pool = spark.range(50).select(
        F.lit(1).cast("bigint").alias("run_id"), F.col("id").alias("arrival"), F.lit("s").alias("source_id"), F.lit("e").alias("evidence"),
        F.concat(F.lit("n"), (F.col("id") % 5).cast("string")).alias("name"), F.lit("t").alias("type"), F.lit("b").alias("brand"),
        F.lit(1).cast("bigint").alias("size"), F.array().cast("array<string>").alias("flags"),
    )
    exact = clean.merge_exact(cut_lineage(pool), PART_SPEC)
    leaders = spark.createDataFrame([], "run_id long, dedupe_key string, leader_key string")
    merged = clean.merge_clusters(exact, leaders, PART_SPEC)
    plan = merged.evidence._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [run_id" in plan, plan
    assert merged.evidence.count() == 50
