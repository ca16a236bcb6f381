"""Analytics over the flat table: metrics, distributions, searches, review queue, benchmark figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.operators.canonical import EngineConfig, route_badge


#: Values around a place that are put in order at last, and the accuracy of the sketches that narrow the range down to them.
SORTED, ACCURACY = 50_000, 10_000


def _n(condition: Column, name: str) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).alias(name)


def metrics(table: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """One row; sums and means of an empty table are null."""
    config = config or EngineConfig()
    return table.agg(
        F.count("*").alias("total_logs"), F.round(F.avg("confidence_overall"), 3).alias("avg_confidence"), F.round(F.avg("latency_us"), 1).alias("avg_latency_us"),
        _n(F.col("inference_used"), "inference_count"), _n(F.col("confidence_overall") >= config.auto_accept, "auto_accepted"), _n(F.col("confidence_overall") < config.review_below, "needs_review"),
    )


def distribution(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc_nulls_last(column))


def format_share(table: DataFrame) -> DataFrame:
    n = table.groupBy("format_detected").agg(F.count("*").alias("count"))
    return n.withColumn("share", F.round(F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy()), 2))


def holding(table: DataFrame, text: str) -> DataFrame:
    """Events whose line, format or source address holds a text in any case; it is matched literally."""
    low = F.lower(F.lit(text))
    return table.where(F.lower("raw_log").contains(low) | F.lower("format_detected").contains(low) | F.lower("src_ip").contains(low))


def recent(table: DataFrame, text: str = "", limit: int = 25) -> DataFrame:
    """The latest events that hold a text. search.candidates() gives the table without files that don't hold it."""
    found = holding(table, text) if text else table
    return found.orderBy(F.desc_nulls_last("created_time"), "id").select("created_time", "format_detected", "src_ip", "dst_ip", "dst_port", "action", "confidence_overall", "raw_log").limit(limit)


def top_denied(table: DataFrame, limit: int = 10) -> DataFrame:
    n = table.where("action = 'deny'").groupBy("src_ip", "dst_ip", "dst_port").agg(F.count("*").alias("count"))
    return n.orderBy(F.desc("count"), F.asc_nulls_last("src_ip"), F.asc_nulls_last("dst_ip"), F.asc_nulls_last("dst_port")).limit(limit)


def lateral_probes(table: DataFrame) -> DataFrame:
    found = table.where((F.col("network_direction") == "internal") & F.col("dst_port").isin(22, 3389, 445))
    return found.groupBy("src_ip", "dst_ip", "dst_port", "action").agg(F.count("*").alias("count"))


def techniques(table: DataFrame) -> DataFrame:
    return table.where("mitre_id is not null").groupBy("mitre_id", "risk_score", "action").agg(F.count("*").alias("count"))


def format_latency(table: DataFrame) -> DataFrame:
    return table.groupBy("format_detected").agg(F.count("*").alias("count"), F.round(F.avg("latency_us"), 1).alias("avg_latency_us"), F.round(F.avg("confidence_overall"), 2).alias("avg_confidence"))


def preview(table: DataFrame, limit: int = 15) -> DataFrame:
    return table.orderBy("id").limit(limit).select("id", F.format_string("%.1f%%", F.col("confidence_overall") * 100).alias("confidence"), F.coalesce("mitre_id", F.lit("N/A")).alias("mitre"))


def badges(table: DataFrame) -> DataFrame:
    # by plain columns first: Spark would build whole events for an expression of two of their fields
    n = table.groupBy("parser_used", "inference_used").agg(F.count("*").alias("n"))
    return n.groupBy(route_badge(F.col("parser_used"), F.col("inference_used")).alias("badge")).agg(F.sum("n").alias("count"))


def accuracy(table: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Shares in percent: accepted without review, parsed at all, and with a time and an address or a user. Null if empty."""
    config = config or EngineConfig()
    core = F.col("timestamp_epoch_us").isNotNull() & (F.col("src_ip").isNotNull() | F.col("dst_ip").isNotNull() | F.col("actor_user_name").isNotNull())
    share = lambda c, name: F.round(F.avg(F.when(c, 100.0).otherwise(0.0)), 2).alias(name)
    return table.agg(share(F.col("confidence_overall") >= config.auto_accept, "auto_accept_pct"), share(F.col("parser_used") != "NONE", "success_pct"), share(core, "core_field_pct"))


def latency_percentiles(values: DataFrame, column: str, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """min, avg, max and, for each share p, the value at place floor(n * p) of the sorted values, counted from 0.

    Nothing is put in one order as a whole: sketches give a narrow range around each place, exact counts confirm it, and
    again inside that range, until it holds one value or SORTED rows at most. A table without values gives nulls.
    """
    v = F.col("v")
    given = values.select(F.col(column).alias("v")).where("v is not null")
    n, least, most = given.agg(F.count("*"), F.min("v"), F.max("v")).first()
    place = [min(int(n * p), n - 1) for p in shares]
    #: first and last value of each place's range, values before it, values in it (0: the value is found)
    ranges = [(least, most, 0, n) for _ in shares]
    while wide := [i for i, r in enumerate(ranges) if r[3] > SORTED]:
        asked = []
        for i in wide:
            first, last, before, inside = ranges[i]
            at = (place[i] - before + 0.5) / inside
            asked.append(F.percentile_approx(F.when(v.between(first, last), v), [max(0.0, at - 2 / ACCURACY), min(1.0, at + 2 / ACCURACY)], ACCURACY))
        cuts = given.agg(*asked).first()
        count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
        exact = given.agg(*[F.struct(count(v < a), count(v <= a), count(v < b), count(v <= b), F.min(F.when((v > a) & (v < b), v)), F.max(F.when((v > a) & (v < b), v))) for a, b in cuts]).first()
        for i, (a, b), (below_a, upto_a, below_b, upto_b, after_a, before_b) in zip(wide, cuts, exact, strict=True):
            first, last, before, inside = ranges[i]
            if place[i] < below_a:
                ranges[i] = (first, a, before, upto_a - before)
            elif place[i] >= upto_b:
                ranges[i] = (b, last, below_b, before + inside - below_b)
            elif place[i] < upto_a:
                ranges[i] = (a, a, below_a, 0)
            elif place[i] >= below_b:
                ranges[i] = (b, b, below_b, 0)
            else:
                ranges[i] = (after_a, before_b, upto_a, below_b - upto_a)
    found = [given.where(v.between(a, b)).orderBy("v").offset(k - before).first()["v"] if inside else a for k, (a, b, before, inside) in zip(place, ranges, strict=True)]
    at = [F.lit(x).cast(given.schema["v"].dataType).alias(f"p{round(p * 100)}") for p, x in zip(shares, found, strict=True)]
    return given.agg(F.min("v").alias("min"), F.avg("v").alias("avg"), F.max("v").alias("max")).select("*", *at)


def pending(queue: DataFrame, limit: int = 50) -> DataFrame:
    """The newest pending review items; ties by event id."""
    return queue.where("status = 'PENDING'").orderBy(F.desc("created_at"), "event_id").limit(limit)


def explain(events: DataFrame, *keys: str) -> DataFrame:
    """Each event as JSON text with its confidence and warnings, beside its keys; reads only."""
    return events.select(*keys, F.to_json("event").alias("explanation"))


def query(spark: SparkSession, table: DataFrame, sql: str, args: dict | None = None) -> DataFrame:
    """Free SQL over the view normalized_logs, with bound parameters."""
    table.createOrReplaceTempView("normalized_logs")
    return spark.sql(sql, args=args)
