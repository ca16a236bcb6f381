"""Batch entries: a list of lines in, and the learning loop over lines that no parser takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import canonical as C
from logloom.operators import learn as L
from logloom.operators import multiline as M
from logloom.operators.parsers import Registry
from logloom.sources.tables import checkpointed, from_list


def ingest(spark: SparkSession, lines: list[str], multiline: bool = False, registry: Registry | None = None, config: C.EngineConfig | None = None) -> DataFrame:
    """Events of a list of lines; with multiline, continuation lines join the one before first."""
    given = from_list(spark, lines)
    return C.normalize(M.assemble(given) if multiline else given.withColumnRenamed("line", "raw"), registry, config)


def summary(events: DataFrame, config: C.EngineConfig | None = None) -> DataFrame:
    """One row: n_events, n_review (events that go to review), n_blank."""
    blank = F.col("event.raw_log") == ""
    review = ~blank & (F.col("event.processing_metadata.confidence.overall_confidence") < (config or C.EngineConfig()).review_below)
    return events.agg(F.count("*").alias("n_events"), F.count_if(review).alias("n_review"), F.count_if(blank).alias("n_blank"))


def learn_and_parse(lines: DataFrame, registry: Registry | None = None, config: C.EngineConfig | None = None, raw_col: str = "raw", at_least: int = 1, known: DataFrame | None = None, created: int = 0) -> tuple[DataFrame, DataFrame]:
    """(events, new rules): parse, mine what neither a parser nor a known rule took, keep the rules that pass the sandbox, read the
    unknown lines with them.

    Lines are parsed once. `known` is a rule table, as is what comes back; `created` is the version of the new rules. Rules
    that are known already are not new. Without unknown lines nothing is learned.
    """
    registry, config = registry or Registry(), config or C.EngineConfig()
    df, kept = C.given_lines(lines, raw_col)
    first = checkpointed(C.parsed_lines(df, registry))
    unknown = first.where(F.col("p").isNull() & (F.col("raw_log") != "")).select(F.col("raw_log").alias("raw"))
    if known is not None:
        met = L.with_candidates(unknown, "raw", known, F.lit(True), F.lit(True))
        fits = lambda c: F.coalesce(F.size(L.fitting(F.col(c), F.col("raw"))) > 0, F.lit(False))
        unknown = met.where(~fits("learned") & ~fits("approved")).select("raw")
    new = L.learn(unknown, at_least=at_least, created=created)
    new = checkpointed(new if known is None else new.join(known.select("signature"), "signature", "left_anti").select(*new.columns))
    return C.canonical(L.apply_rules(first, new if known is None else known.unionByName(new), registry.priorities()), kept, config), new
