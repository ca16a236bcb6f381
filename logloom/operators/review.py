"""The review loop: status events, approvals that become rules, the rule log. All logs are append-only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.learn import RULES, Rule, fitting, latest, with_candidates

STATES = ("PENDING", "APPROVED", "REJECTED")


def mark(events: DataFrame, status: str, at: str) -> DataFrame:
    """Status events for the given event ids, to be appended to the queue's log."""
    if status not in STATES:
        raise ValueError(f"status must be one of {STATES}")
    return events.select("event_id", F.lit(status).alias("status"), F.lit(at).alias("created_at"))


def state(log: DataFrame) -> DataFrame:
    """The latest status of each event."""
    return latest(log, "event_id", "created_at")


def approve(signature: str, template: str, pattern: str, fields: tuple[str, ...], created: int) -> Rule:
    """A rule as an analyst wrote it: verified, with full score, not sent through the sandbox."""
    return Rule(signature, template, pattern, fields, 1.0, True, created)


def rule_log(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """A rule table of rules that were written by hand."""
    rows = [(r.signature, r.template, r.pattern, list(r.fields), r.score, r.verified, r.created) for r in rules]
    return spark.createDataFrame(rows, RULES)


def rules(log: DataFrame) -> DataFrame:
    """The latest version of each rule."""
    return latest(log, "signature", "created")


def listed(log: DataFrame) -> DataFrame:
    """The latest version of each rule, newest first."""
    return rules(log).orderBy(F.desc("created"), "signature")


def times_used(events: DataFrame, log: DataFrame) -> DataFrame:
    """Lines that each rule's pattern fits, learned rules being tried on the lines of their leaf; rules that fit none are left out."""
    met = with_candidates(events.select("raw"), "raw", rules(log), F.lit(True), F.lit(True))
    none = F.array().cast("array<string>")
    names = lambda c: F.coalesce(F.transform(fitting(F.col(c), F.col("raw")), lambda r: r["signature"]), none)
    return met.select(F.explode(F.concat(names("learned"), names("approved"))).alias("signature")).groupBy("signature").agg(F.count("*").alias("n"))


def append_rules(new: DataFrame, path: str, version: int) -> None:
    """One version of rules, or of their use, in a folder of its own: writing a version again replaces it."""
    new.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_rules(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The latest form of each rule among the versions before `before` (all, if none is given)."""
    log = _versions(spark, path, f"{RULES}, version bigint")
    return latest(log if before is None else log.where(F.col("version") < before), "signature", "created").drop("version")


def uses(spark: SparkSession, path: str) -> DataFrame:
    """Lines that each rule has read, over all versions."""
    return _versions(spark, path, "signature string, n bigint, version bigint").groupBy("signature").agg(F.sum("n").alias("n"))


def _versions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
