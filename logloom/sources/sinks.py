"""Sinks: the analytics table, dead letters, the review queue, exports. Append-only; the latest state is a view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from logloom.operators.canonical import EngineConfig, flat, needs_review
from logloom.operators.learn import latest
from logloom.sources.tables import checkpointed


def upsert(current: DataFrame, new: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Rows of both; of equal keys the one of the highest order stays."""
    return latest(current.unionByName(new), key, order)


def append_table(rows: DataFrame, path: str, day_col: str = "timestamp_epoch_us") -> None:
    """Parquet by event day, so that time filters prune folders."""
    day = F.to_date(F.timestamp_micros(F.col(day_col)))
    rows.withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)


def write_observed(events: DataFrame, table: str, dead: str, id_cols: tuple[str, ...] = (), config: EngineConfig | None = None) -> dict[str, float | int | None]:
    """Appends events to the table and those for review to the dead letters, and returns the table's metrics (those of
    analytics.metrics, and n_blank), which are counted while the table is written: no pass over the rows of their own.

    Sums over no rows are None.
    """
    config = config or EngineConfig()
    kept = checkpointed(events)
    seen = Observation()
    one = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    score = F.col("confidence_overall")
    observed = flat(kept, id_cols).observe(
        seen, F.count(F.lit(1)).alias("total_logs"), F.round(F.avg(score), 3).alias("avg_confidence"), F.round(F.avg("latency_us"), 1).alias("avg_latency_us"),
        one(F.col("inference_used"), "inference_count"), one(score >= config.auto_accept, "auto_accepted"), one(score < config.review_below, "needs_review"), one(F.col("raw_log") == "", "n_blank"),
    )
    append_table(observed, table)
    append_dead_letters(dead_letters(kept, config), dead)
    return seen.get


def dead_letters(events: DataFrame, config: EngineConfig | None = None, at: str | None = None) -> DataFrame:
    meta = "event.processing_metadata"
    return needs_review(events, config).select(
        F.lit(at).cast("string").alias("dead_letter_time"), F.md5(F.col("event.raw_log").cast("binary")).alias("event_id"), F.col(f"{meta}.error_codes").alias("reason_codes"),
        F.col(f"{meta}.confidence.overall_confidence").alias("confidence_score"), F.col(f"{meta}.extracted").alias("extracted_fields"), F.col(f"{meta}.warnings").alias("warnings"), F.col("event.raw_log").alias("raw_log"),
    )


def append_dead_letters(letters: DataFrame, path: str) -> None:
    letters.write.mode("append").json(path)


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("dead_letter_time string, event_id string, reason_codes array<string>, confidence_score double, extracted_fields map<string,string>, warnings array<string>, raw_log string").json(path)


def enqueue(queue: DataFrame, items: DataFrame, key: str = "event_id") -> DataFrame:
    """Items that the queue doesn't hold yet, one for each key, as PENDING: insert-or-ignore."""
    new = items.join(queue.select(key), key, "left_anti").dropDuplicates([key])
    return new.withColumn("status", F.lit("PENDING"))


def read_queue(spark: SparkSession, path: str, items: StructType, before: int | None = None) -> DataFrame:
    """The queue that streams.enqueue() writes of items of a schema: all batches, or those before one."""
    schema = StructType([*items.fields, StructField("status", StringType()), StructField("batch", LongType())])
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    queue = spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
    return (queue if before is None else queue.where(F.col("batch") < before)).drop("batch")


def export(table: DataFrame, path: str, kind: str = "csv", limit: int = 1000) -> None:
    """The first rows by id as CSV with a header or as JSON lines."""
    rows = table.orderBy("id").limit(limit).coalesce(1)
    (rows.write.mode("overwrite").option("header", True).csv if kind == "csv" else rows.write.mode("overwrite").json)(path)
