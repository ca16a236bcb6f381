"""Multiline assembly: lines of a source become records, continuation lines being joined to the one before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.text import strip

CAP = 65536
#: Line numbers of a source that one task puts in order.
BLOCK = 65536
#: Starts of a record (on the stripped line), and continuations (on the raw line).
HEADERS = (
    r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}",
    r"^(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}",
    r"^<\d{1,3}>",
    r"^(?:CEF:\d+|LEEF:\d+)",
    r"^\[(?:\d{4}-\d{2}-\d{2}|\d{1,2}/[A-Za-z]{3}/\d{4})",
    r"^\{\s*\"",
    r"^type=[A-Z_]+",
)
CONTINUATIONS = (
    r"^\s+at\s+[a-zA-Z0-9_$./]+\(",
    r"^\s+Caused by:\s+",
    r"^\s+\.\.\.\s+\d+\s+more",
    r"^\s*Traceback \(most recent call last\):",
    r"^\s+File\s+\".*\",\s+line\s+\d+",
    r"^\s{2,}\S",
    r"^\t\S",
)


def starts_entry(line: Column) -> Column:
    """True if the line begins a record: blank lines, continuations and indented lines do not, all others do."""
    bare = strip(line)
    return (
        F.when(bare == "", False)
        .when(line.rlike("|".join(f"(?:{p})" for p in CONTINUATIONS)), False)
        .when(bare.rlike("|".join(f"(?:{p})" for p in HEADERS)), True)
        .otherwise(~(line.startswith(" ") | line.startswith("\t")))
    )


def joined(lines: Column, cap: int = CAP) -> Column:
    """Lines of one record, in order, joined by line ends; a line that would bring the record to `cap`
    characters or more is left out, a later shorter one may still fit. Joins add one each to the size."""
    start = F.struct(F.lit(-1).cast("long").alias("size"), F.array().cast("array<string>").alias("kept"))

    def add(state: Column, line: Column) -> Column:
        n = F.length(line).cast("long")
        first = state["size"] < 0
        fits = first | (state["size"] + n < cap)
        size = F.when(first, n).when(fits, state["size"] + n + 1).otherwise(state["size"])
        return F.struct(size.alias("size"), F.when(fits, F.concat(state["kept"], F.array(line))).otherwise(state["kept"]).alias("kept"))

    return F.aggregate(lines, start, add, lambda s: F.array_join(s["kept"], "\n"))


def assemble(lines: DataFrame, source: str = "source", order: str = "line_no", line: str = "line", cap: int = CAP) -> DataFrame:
    """(source, line_no of the first line, n_lines, raw) of each record; lines before a first start make a record too.

    Empty and null lines are skipped, line ends cut off; lines without a number are left out. `order` is a whole number. A
    source is cut into blocks of BLOCK such numbers: starts are counted inside each block, a block's total is carried to the
    next ones, so that no task gets a whole source. n_lines counts the lines that the cap leaves out as well, but their
    texts stay behind: once a line is left out, so are all later ones of its length, so that at most cap / (length + 1) + 1
    lines of a length can be of use. Others are told by their place among the record's lines of their length in a block, and
    by the lengths that earlier blocks have used up. A record brings together at most twice `cap` characters a length.
    """
    given = lines.where(F.col(line).isNotNull() & (F.col(line) != "")).withColumn(line, F.regexp_replace(line, r"[\r\n]+$", ""))
    # a struct, because the null source is a source too and structs of nulls are equal
    given = given.select(F.struct(F.col(source).alias("name")).alias("source"), F.col(order).alias("no"), F.col(line).alias("line"), F.floor(F.col(order) / BLOCK).alias("block"), starts_entry(F.col(line)).cast("long").alias("start"), F.length(line).alias("n"))
    given = given.where(F.col("block").isNotNull())
    block = Window.partitionBy("source", "block")
    useful = F.floor(F.lit(cap) / (F.col("n") + 1)) + 1

    here = given.withColumns({"own": F.sum("start").over(block.orderBy("no")), "least": F.min("no").over(block.orderBy("no"))})
    last = here.select("source", "block", "n", "own", F.sum("start").over(block).alias("starts")).where("own = starts")
    last = last.groupBy("source", "block", "n").agg(F.count("*").alias("held"), F.first("starts").alias("starts"))
    before = F.sum("starts").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    carried = last.groupBy("source", "block").agg(F.first("starts").alias("starts")).select("source", "block", F.coalesce(before, F.lit(0)).alias("before"))

    open_ = last.join(carried, ["source", "block"]).select("source", "block", "n", "held", (F.col("before") + F.col("starts")).alias("record"))
    upto = F.sum("held").over(Window.partitionBy("source", "record", "n").orderBy("block"))
    used = open_.withColumn("upto", upto).where(F.col("upto") >= useful).groupBy("source", "record", "n").agg(F.min("block").alias("block"))
    used = used.groupBy("source", F.col("record").alias("before")).agg(F.collect_list(F.struct("n", "block")).alias("used"))
    carried = carried.join(used, ["source", "before"], "left")

    place = F.row_number().over(Window.partitionBy("source", "block", "own", "n").orderBy("no", "line"))
    first = (F.col("start") == 1) | (F.col("no") == F.col("least"))
    numbered = here.withColumn("place", place).join(carried, ["source", "block"])
    shut = (F.col("own") == 0) & F.coalesce(F.exists("used", lambda u: (u["n"] == F.col("n")) & (u["block"] < F.col("block"))), F.lit(False))
    kept = F.when((F.col("place") <= useful) & (first | (F.col("n") < cap)) & ~shut, F.struct("no", "line"))
    grouped = numbered.groupBy("source", (F.col("own") + F.col("before")).alias("record")).agg(F.min("no").alias("no"), F.count("*").cast("int").alias("n_lines"), F.array_sort(F.collect_list(kept)).alias("kept"))
    return grouped.select(F.col("source.name").alias(source), F.col("no").alias(order), "n_lines", joined(F.transform("kept", lambda x: x["line"]), cap).alias("raw"))
