"""Plug-ins that give several records a line: table functions, in lateral joins and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession, name: str, split: str | type) -> None:
    """Registers a table function name(raw) of the rows (part int, record string) for SQL and records().

    split is an SQL expression over raw that gives an array of texts, which stays in Spark's own code, or a class whose
    eval(raw) yields (part, record), for what SQL cannot say; that runs in Python. A line of which nothing comes (a null
    one, too) is its own record, as part 0. A name that is taken is replaced.
    """
    if not name.isidentifier():
        raise ValueError("a table function's name is a word")
    spark.sql(f"drop temporary function if exists {name}")
    if isinstance(split, str):
        spark.sql(f"create temporary function {name}(raw string) returns table (part int, record string) return select pos, col from posexplode(if(size({split}) > 0, {split}, array(raw)))")
        return

    class Whole(split):
        def eval(self, raw):
            alone = True
            for found in super().eval(raw) or ():
                alone = False
                yield found
            if alone:
                yield 0, raw

    spark.udtf.register(name, F.udtf(Whole, returnType="part int, record string"))


def records(lines: DataFrame, name: str, raw_col: str = "raw") -> DataFrame:
    """Each line's records as rows: the line's columns, raw_col holding the record, and part, which replaces a column of
    that name."""
    quoted = lambda c: f"`{c.replace('`', '``')}`"
    kept = [f"l.{quoted(c)}" for c in lines.columns if c not in (raw_col, "part")]
    return lines.sparkSession.sql(f"select {', '.join([*kept, 'r.part', f'r.record as {quoted(raw_col)}'])} from {{lines}} l, lateral {name}(l.{quoted(raw_col)}) r", lines=lines)
