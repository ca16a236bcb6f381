"""Line dedup across documents, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm import common

#: Shares that a repeated line's rows are cut into where repeated lines are too many to broadcast.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """line without ASCII white space at both ends, A-Z lower-cased and nothing else."""
    cut = F.btrim(line, F.lit(SPACE))
    return F.when(F.length(cut) == F.octet_length(cut), F.lower(cut)).otherwise(F.translate(cut, UPPER, LOWER))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with text_col rewritten, and n_lines and n_dropped (long) added.

    A key (line_key) of min_chars code points or more found in min_docs distinct ids or more loses its
    lines in every document but the largest id that holds it. A null or empty text is one empty line
    and comes back empty. Rows with a null id do not count as documents and keep nothing of such
    lines. Rows that repeat an id are one document. Columns n_lines and n_dropped of docs, if any, are
    replaced; all others pass through, whatever their names. An empty table gives an empty result.

    Plan: lines are exploded to (id, position, 128-bit hash of the key), so no text is shuffled for the
    counts. Distinct (hash, id) pairs are found before the count by hash, which spreads a line that is
    in every document. The repeated lines' hashes are broadcast if they are few; else both sides are salted, so
    that no line's rows meet in one task. Positions to drop meet their row by id and hash of the text, and the text is
    put together again from the positions left, in time linear in its lines.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    docs = docs.select(*names)
    text, row, own, same, lost = common.free(docs, "whole_text", "text_hash", "own_id", "own_hash", "lost")
    rows = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).withColumn(row, F.xxhash64(text))
    line = F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")
    keyed = rows.select(F.col(id_col).alias("id"), F.col(row).alias("row"), line).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    hashed = keyed.select("id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))
    seen = hashed.where("id is not null").select("h1", "h2", "id").distinct()
    repeated = common.checkpointed(seen.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs).drop("n"))
    if repeated.count() <= common.BROADCAST_ROWS:
        met = hashed.join(F.broadcast(repeated), ["h1", "h2"])
    else:
        salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = hashed.withColumn("salt", F.pmod(F.xxhash64("id", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["h1", "h2", "salt"])
    gone = met.where(~F.col("id").eqNullSafe(F.col("keeper")))
    spots = gone.groupBy(F.col("id").alias(own), F.col("row").alias(same)).agg(F.collect_set("pos").alias(lost))
    found = rows.join(spots, rows[id_col].eqNullSafe(F.col(own)) & (F.col(row) == F.col(same)), "left")
    n_lines = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"))) + 1
    out = {c: F.col(c) for c in names} | {
        text_col: F.when(F.col(lost).isNull(), F.col(text)).otherwise(without(F.col(text), F.col(lost))),
        "n_lines": n_lines.cast("long"),
        "n_dropped": F.coalesce(F.size(lost), F.lit(0)).cast("long"),
    }
    return found.select(*[v.alias(k) for k, v in out.items()])


def without(text: Column, lost: Column) -> Column:
    """text without the lines at the places (from 0) in lost. The lines are split once: they are bound to a lambda's
    variable, which Spark holds, while it would compute an expression in a lambda anew for each element."""

    def join(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    return F.get(F.transform(F.array(F.split(text, "\n", -1)), join), F.lit(0))
