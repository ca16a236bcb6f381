"""Sources: text files, lists of lines, tables, and a seeded synthetic corpus."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, line_no, line) of text files; source is the file. Indentation is kept for multiline assembly.

    line_no grows along each file, with gaps: the start of the file's block plus the row's place in its task.
    """
    at = F.col("_metadata.file_block_start") + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), at.alias("line_no"), F.col("value").alias("line"))


def from_list(spark: SparkSession, lines: list[str], source: str = "api") -> DataFrame:
    return spark.createDataFrame([(source, i, x) for i, x in enumerate(lines)], "source string, line_no bigint, line string")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task at most, on average, where lines are parsed.
DEALT = 50_000


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt out to tasks of some DEALT rows, and to as many as there are cores at least. The number of a scan's tasks says
    nothing of their rows: a Parquet file is cut by bytes, but all rows of a row group go to one of its tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // DEALT)), *by)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    read = spark.readStream.schema(spark.read.parquet(path).schema)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    return read.parquet(path) if whole else read.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir. Only where that is unset and all runs in one process, a temporary
    folder becomes it."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written below spark.checkpoint.dir; lineage ends there."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(scratch(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)


def drawn(seed: str, i: Column, m: int) -> Column:
    """A whole number below m: the first eight hexadecimal digits of md5(seed:i), modulo m."""
    text = F.concat_ws(":", F.lit(seed), i.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(m))


def pick(values: tuple, seed: str, i: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), drawn(seed, i, len(values)).cast("int"))


def synthetic(ids: DataFrame, seed: int = 1, start: str = "2026-01-01 00:00:00") -> DataFrame:
    """(id, raw): a line for each whole number `id`, in one of eight formats, 50 ms apart, the same for the same seed."""
    i = F.col("id")
    num = lambda name, m: drawn(f"{seed}{name}", i, m)
    s = lambda c: c.cast("string")
    ip = lambda name, first: F.concat_ws(".", s(first), s(num(name + "b", 255)), s(num(name + "c", 255)), s(num(name + "d", 254) + 1))
    inner, outer = ip("in", F.lit(10)), ip("out", num("outa", 100) + 11)
    port = pick((22, 53, 80, 443, 8080, 8443, 3389, 5353, 9092), f"{seed}port", i)
    user = pick(("root", "admin", "analyst", "backup", "deployer"), f"{seed}user", i)
    ms = F.unix_millis(F.lit(start).cast("timestamp")) + i * 50
    iso = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    f = F.format_string
    kinds = [
        f("%%ASA-4-106023: %s tcp src outside:%s/%d dst inside:%s/%d by access-group 'EDGE'", pick(("Deny", "Built", "Teardown"), f"{seed}act", i), outer, num("sp", 60000) + 1024, inner, port),
        f('{"timestamp":"%s","level":"INFO","network":{"src_ip":"%s","dst_ip":"%s","dst_port":%d},"message":"connection","action":"allow"}', iso, inner, outer, port),
        f("CEF:0|Vendor|Vault|12.2|100|SecretRetrieved|5|src=%s dst=%s spt=%d dpt=%d act=%s rt=%d suser=%s", outer, inner, num("sp", 60000) + 1024, port, pick(("block", "drop", "permit"), f"{seed}act", i), ms, user),
        f("LEEF:2.0|Vendor|Product|10.1|THREAT|\tdevTime=%s\tsrc=%s\tdst=%s\tproto=tcp\tdstPort=443", iso, inner, outer),
        f('<165>1 %s gateway router 8941 MSG09 [sd@1 user="%s"] Session authentication accepted', iso, user),
        f('type=SYSCALL msg=audit(%s:%d): arch=c000003e syscall=59 success=yes pid=%d comm="ncat" exe="/usr/bin/ncat" src_ip=%s', f("%d.%03d", F.floor(ms / 1000).cast("long"), ms % 1000), num("aid", 9999), num("pid", 99999) + 1, inner),
        f('[SENSOR-V4] %s | NODE=N%d | LAT=32.%d | STATUS=LOCKED | LINK=%s->%s:8080 | MSG="beacon active"', iso, num("node", 16), num("lat", 9999), inner, outer),
        f('\x01 MALFORMED | ADDR=999.888.777.666 | TIME=BAD_DATE | MSG="Buffer underrun %d"', num("err", 10)),
    ]
    kind = num("kind", len(kinds))
    raw = F.lit(None).cast("string")
    for k, expression in enumerate(kinds):
        raw = F.when(kind == k, expression).otherwise(raw)
    return ids.select("id", raw.alias("raw"))
