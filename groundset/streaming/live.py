"""Live dataset: keep each run's records current while verified records keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from groundset.plans.dataset import as_store_records, build_dataset
from groundset.sinks.store import compact, event_rows, remove_superseded, replace_runs
from groundset.sources.store import table_path
from groundset.spec import TaskSpec


# Folders the pool is split into by run, so that a batch reads back only its own runs.
POOL_BUCKETS = 64


class LiveDataset:
    """Micro-batch sink that rebuilds the runs a batch touches and replaces them in the store.

    The pool of verified records is kept by batch, so a batch that runs twice overwrites its own
    rows; record ids depend on run and key only, so the rebuilt runs come out the same.

    With `compact_every` the store is compacted before each so-many-th batch, up to the batch before: that one
    is committed by then and never repeated. Folders of the last compaction but one then go.
    """

    def __init__(self, root: str, spec: TaskSpec, compact_every: int | None = None, **options):
        self.root, self.spec, self.options, self.compact_every = root, spec, options, compact_every
        self.pool_path = table_path(root, "pool")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if self.compact_every and batch_id and batch_id % self.compact_every == 0:
            # What the compaction before this one left behind; its readers have had that many batches.
            remove_superseded(spark, self.root)
            compact(spark, self.root, batch_id - 1)
        bucket = F.pmod(F.xxhash64(F.col("run_id").cast("string")), F.lit(POOL_BUCKETS)).cast("int")
        (
            batch.withColumn("batch_id", F.lit(batch_id))
            .withColumn("bucket", bucket)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket", "batch_id")
            .parquet(self.pool_path)
        )
        pool = spark.read.parquet(self.pool_path)
        touched = pool.filter(F.col("batch_id") == batch_id).select("bucket", "run_id").distinct()
        # A restarted query may find rows of batches it has yet to repeat; they are not in yet.
        # The bucket in the join keys lets Spark read only the folders of touched runs.
        current = pool.filter(F.col("batch_id") <= batch_id).join(touched, ["bucket", "run_id"], "left_semi")
        current = current.drop("batch_id", "bucket")
        dataset = build_dataset(current, self.spec, **self.options)
        records = as_store_records(dataset.records, self.spec)
        evidence = _full_position(dataset.evidence.withColumn("run_id", F.col("run_id").cast("string")))
        replace_runs({"records": records, "record_evidence": evidence}, self.root, touched, batch_id)
        self._announce(spark, touched, batch_id)

    def _announce(self, spark: SparkSession, touched: DataFrame, batch_id: int) -> None:
        written = spark.read.parquet(f"{table_path(self.root, 'records')}/version={batch_id}")
        counts = (
            touched.select(F.col("run_id").cast("string").alias("run_id"))
            .join(written.groupBy("run_id").agg(F.count(F.lit(1)).alias("count")), "run_id", "left")
            .withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))
        )
        events = event_rows(
            counts,
            F.lit(batch_id),
            F.col("run_id"),
            "info",
            "records_updated",
            F.concat(F.lit("Live update: "), F.col("count").cast("string"), F.lit(" records")),
            F.struct("count", F.lit(True).alias("provisional")),
        )
        (
            events.withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(table_path(self.root, "live_events"))
        )


def _full_position(evidence: DataFrame) -> DataFrame:
    """Evidence order with all four parts, whether or not similar records were merged."""
    names = evidence.schema["position"].dataType.fieldNames()
    if "absorbed" not in names:
        return evidence.withColumn(
            "position",
            F.struct(
                F.lit(0).alias("absorbed"), F.lit(0).cast("bigint").alias("first_arrival"),
                F.col("position.unfilled").alias("unfilled"), F.col("position.arrival").alias("arrival"),
            ),
        )
    return evidence


def run_live(verified: DataFrame, root: str, spec: TaskSpec, checkpoint: str, available_now: bool = True, **options) -> StreamingQuery:
    """Start the live dataset over a stream of verified records."""
    writer = verified.writeStream.foreachBatch(LiveDataset(root, spec, **options)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
