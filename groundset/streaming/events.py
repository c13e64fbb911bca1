"""Event-log streams: tail, running statistics, first-seen URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from groundset.operators.views import event_payload

# Run states after which no event follows.
TERMINAL = ("completed", "failed", "cancelled")


def tail(events: DataFrame, run_id=None, after: int = 0) -> DataFrame:
    """Payload rows after a cursor. On a stream the checkpoint is the cursor from then on."""
    rows = events.filter(F.col("id") > after)
    if run_id is not None:
        rows = rows.filter(F.col("run_id") == run_id)
    return event_payload(rows)


def done_rows(runs: DataFrame, asked: DataFrame, events: DataFrame) -> DataFrame:
    """Closing event of each asked run that is terminal, or deleted, with nothing after the cursor.

    `asked(run_id, after)`.
    """
    pending = asked.join(events.select("run_id", "id"), "run_id").filter(F.col("id") > F.col("after"))
    quiet = asked.join(pending.select("run_id").distinct().withColumn("_new", F.lit(True)), "run_id", "left")
    joined = quiet.join(runs.select("run_id", "status"), "run_id", "left")
    closed = F.col("status").isNull() | (F.col("status").isin(*TERMINAL) & F.col("_new").isNull())
    return joined.filter(closed).select(
        "run_id", F.lit("done").alias("event"), F.to_json(F.struct(F.coalesce("status", F.lit("deleted")).alias("status"))).alias("payload")
    )


def running_stats(stage_rows: DataFrame) -> DataFrame:
    """Running counts per run over page results `(run_id, raw, verified, hallucinated, nulled)`."""
    return stage_rows.groupBy("run_id").agg(
        F.sum("raw").alias("raw_count"), F.sum("verified").alias("verified_count"),
        F.sum("hallucinated").alias("hallucinated_count"), F.sum("nulled").alias("fields_nulled"),
        F.count(F.lit(1)).alias("pages"),
    )


def event_counts(events: DataFrame) -> DataFrame:
    """Running number of events per run and step."""
    return events.groupBy("run_id", "step").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id"))


def first_seen_stream(candidates: DataFrame, delay: str, time: str = "seen_at") -> DataFrame:
    """First sighting of each (run, URL) within `delay`; later ones pass again, as their state is gone by then."""
    return candidates.withWatermark(time, delay).dropDuplicatesWithinWatermark(["run_id", "url"])


def write_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Drain what is there into a Parquet folder and stop."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def write_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Keep the newest state of each key, by batch folders; read it with `read_latest`."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_id").parquet(path)

    return (
        stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .outputMode("update").trigger(availableNow=True).start()
    )


def read_latest(spark, path: str, keys: list[str]) -> DataFrame:
    """Last written row of each key."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in values])
