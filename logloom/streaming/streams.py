"""Streams: multiline state by source, parsing, routed sinks and windowed counts. Extensions of the batch engine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from logloom.operators import canonical, review
from logloom.operators.multiline import CAP, starts_entry
from logloom.plans import batch as batches
from logloom.sources import sinks
from logloom.sources.tables import checkpointed

RECORD = "source string, line_no long, n_lines int, raw string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _state_store(spark: SparkSession) -> None:
    """State variables and timers need the RocksDB store."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class OpenRecord(StatefulProcessor):
    """The record of a source that still may grow: its first line number, lines, size and text, `cap` characters at most.

    idle_ms sets a timer at every batch of the source; when it goes off the record is given out. Timers count processing
    time, or event time (rows then carry `at`, and a record goes out once the watermark has passed it by idle_ms). Without
    it the last record of a source stays in the state, where open_records() finds it.
    """

    def __init__(self, cap: int, idle_ms: int | None, event_time: bool) -> None:
        self.cap, self.idle_ms, self.event_time = cap, idle_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "no long, n int, size long, text string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = pd.concat(list(rows)).sort_values("line_no", kind="stable")
        lines, numbers = own["line"].tolist(), own["line_no"].tolist()
        begins = np.flatnonzero(own["starts"].to_numpy())
        out, now = [], self.open.get() if self.open.exists() else None
        edges = [0, *[i for i in begins.tolist() if i], len(lines)]
        for a, b in zip(edges, edges[1:], strict=False):
            if now is not None and own["starts"].iloc[a]:
                out.append((key[0], *self._record(now)))
                now = None
            now = self._grown(now, numbers[a], lines[a:b])
        self.open.update(now)
        if self.idle_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            base = int(own["at"].max().timestamp() * 1000) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(base + self.idle_ms)
        yield pd.DataFrame(out, columns=["source", "line_no", "n_lines", "raw"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        if self.open.exists():
            out.append((key[0], *self._record(self.open.get())))
            self.open.clear()
        yield pd.DataFrame(out, columns=["source", "line_no", "n_lines", "raw"])

    def close(self) -> None:
        pass

    @staticmethod
    def _record(now: tuple) -> tuple:
        return now[0], now[1], now[3]

    def _grown(self, now: tuple | None, number: int, lines: list[str]) -> tuple:
        """The record with more lines; those that would bring it to the cap are left out, the first one excepted."""
        if now is None:
            now, lines = (int(number), 1, len(lines[0]), lines[0]), lines[1:]
        no, n, size, text = now
        kept = [text]
        if size + sum(map(len, lines)) + len(lines) < self.cap:
            kept += lines
            size += sum(map(len, lines)) + len(lines)
        else:
            for line in lines:
                if size + len(line) < self.cap:
                    kept.append(line)
                    size += len(line) + 1
        return no, n + len(lines), size, "\n".join(kept)


def assemble(lines: DataFrame, cap: int = CAP, idle_ms: int | None = 30_000, time_col: str | None = None) -> DataFrame:
    """As multiline.assemble(), on a stream of (source, line_no, line): a record is given out when the next one
    starts, or when its source has been idle. State is one open record a source, at most `cap` characters; a task holds
    one source's lines of one micro-batch, which the source's rate limit (maxFilesPerTrigger and the like) bounds.

    With time_col, which needs a watermark, idleness is measured in event time, and a run with the
    availableNow trigger ends by itself. Timers of processing time make Spark plan batches for ever: for a bounded run
    give idle_ms=None and take the last records from open_records(), or use assemble_all().
    """
    spark = lines.sparkSession
    _state_store(spark)
    marked = lines.where("line is not null and line <> ''").withColumn("line", F.regexp_replace("line", r"[\r\n]+$", "")).withColumn("starts", starts_entry(F.col("line")))
    at = [F.col(time_col).alias("at")] if time_col else []
    mode = "None" if idle_ms is None else "EventTime" if time_col else "ProcessingTime"
    grouped = marked.select("source", "line_no", "line", "starts", *at).groupBy("source")
    return grouped.transformWithStateInPandas(OpenRecord(cap, idle_ms, time_col is not None), RECORD, "Append", mode)


def open_records(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Records that still stand in the state of assemble(), after the last batch that its checkpoint folder knows."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "open").load()
    return state.select(F.col("key.source").alias("source"), F.col("value.no").alias("line_no"), F.col("value.n").alias("n_lines"), F.col("value.text").alias("raw"))


def assemble_all(lines: DataFrame, path: str, checkpoint: str, cap: int = CAP) -> DataFrame:
    """Runs a stream of lines to the end of what is there and returns all of its records.

    Whole records are appended to Parquet files at path, each batch once. What is open at the end is read from the
    state and comes on top, unwritten: a later run goes on from the state, so a record that grows then is not there twice.
    """
    written = assemble(lines, cap, None).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    written.trigger(availableNow=True).start().awaitTermination()
    spark = lines.sparkSession
    return spark.read.schema(RECORD).parquet(path).unionByName(open_records(spark, checkpoint))


def counts(events: DataFrame, time_col: str, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ("action",)) -> DataFrame:
    """Events by window and keys; what is later than the watermark is left out on a stream."""
    w = F.window(time_col, window, slide or window)
    return events.withWatermark(time_col, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "count")


def sessions(events: DataFrame, time_col: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = F.session_window(time_col, gap)
    return events.withWatermark(time_col, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "count")


def ingest(lines: DataFrame, table: str, dead: str, checkpoint: str, config: canonical.EngineConfig | None = None) -> StreamingQuery:
    """Parses a stream of raw lines and appends to the table and, below the review threshold, to the dead letters.

    A batch that is run again after a failure writes its rows again; their ids are the same, so the latest-by-id
    view of the table (sinks.upsert) holds each once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        events = canonical.normalize(batch, config=config).persist()
        sinks.append_table(canonical.flat(events), table)
        sinks.append_dead_letters(sinks.dead_letters(events, config), dead)
        events.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_learning(lines: DataFrame, table: str, rules: str, used: str, checkpoint: str, config: canonical.EngineConfig | None = None, at_least: int = 1) -> StreamingQuery:
    """Parses a stream of raw lines and learns from those that neither parser nor rule takes.

    Batch n reads the rules of the versions before n, and is parsed with those and with what it teaches itself; its new
    rules are version n of the rule log, and the lines that each rule reads version n of the log of uses. Events,
    rules and uses of a batch each stand in a folder of its number, so a batch that is run again after a failure
    replaces what it wrote, and sees the same rules again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = checkpointed(review.read_rules(spark, rules, batch_id))
        events, new = batches.learn_and_parse(batch, config=config, at_least=at_least, known=known, created=batch_id)
        events = checkpointed(events)
        canonical.flat(events).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        read = events.where("event.processing_metadata.parser_used = 'jit_inferred'").select(F.col("event.raw_log").alias("raw"))
        review.append_rules(review.times_used(read, known.unionByName(new)), used, batch_id)
        review.append_rules(new, rules, batch_id)

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def enqueue(items: DataFrame, path: str, checkpoint: str, key: str = "event_id") -> StreamingQuery:
    """Items of a stream that the review queue at path doesn't hold yet, one for each key, as PENDING: each once.

    Batch n is compared with the batches before n and stands in a folder of its number, so a batch that is run again after
    a failure replaces what it wrote. A queue has one checkpoint folder: with another one, numbers start anew. The keys of the
    whole queue are compared, which takes one column of it; a stream with a watermark may drop its own repeats before
    (dropDuplicatesWithinWatermark).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        held = sinks.read_queue(batch.sparkSession, path, batch.schema, batch_id)
        sinks.enqueue(held, batch, key).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
