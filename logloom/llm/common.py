"""Helpers that several operators share: materialising, hold-out, blocked self-joins, components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct members of one bucket that are paired by an ordinary join; larger buckets go through cells.
SMALL_BUCKET = 32
#: Rows of one side of a cell: a task holds two such chunks of a bucket at most.
CHUNK = 4096


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset and all runs in one process a temporary folder becomes it."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder; lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, folder: str) -> DataFrame:
    """df, computed once and written as compressed columns to a new folder below the shared one, for rows that take a
    fraction of the disk of a checkpoint so; whoever asks for it removes the folder."""
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.parquet(folder)


#: Rows of an Arrow batch where rows are whole texts.
TEXT_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Batches that Python workers get hold TEXT_ROWS rows at most from now on in this session: with Spark's ten thousand
    texts a batch, its copies in the JVM and in the worker take most of an executor's memory besides the heap."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= TEXT_ROWS:
        spark.conf.set(rows, TEXT_ROWS)


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder of intermediate rows, on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows up to which small() broadcasts.
BROADCAST_ROWS = 50_000


def small(df: DataFrame) -> DataFrame:
    """df, checkpointed, with a broadcast hint if it has BROADCAST_ROWS rows or fewer; else Spark joins it as it sees fit."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def is_held_out(doc_id: str) -> Column:
    """True if crc32 of the id as text leaves 0 modulo 5; a null id is held out, so nothing is learned from it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node in edges (a long, b long); root is the smallest node it reaches.

    Alternating large-star and small-star steps, each a pair of shuffles over the edges left; a
    round's edges are checkpointed, so a lost executor costs one round. Ends when a round changes
    nothing. Self-loops and edges with a null end are ignored, repeated edges count once.
    """
    now = checkpointed(_down(edges.where("a <> b").select("a", "b")))
    before = None
    while (state := now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()) != before:
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _down(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))))
        now = checkpointed(_down(small))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _down(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def large_bucket_cells(members: DataFrame, sizes: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Members of large buckets, dealt to cells that together hold every pair of a bucket once.

    A bucket of n members is cut by hash into s = ceil(n / CHUNK) chunks; cell (i, j), i <= j, gets
    chunks i and j. Adds `i`, `j` (a cell is keys, i and j) and `chunk`. Each cell is bounded whatever the bucket's size.
    """
    large = sizes.where(F.col("n") > SMALL_BUCKET).withColumn("s", F.ceil(F.col("n") / CHUNK).cast("int"))
    chunk = F.pmod(F.xxhash64(F.lit("chunk"), member), F.col("s")).cast("int")
    dealt = members.join(large, keys).withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    return dealt.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other")).drop("other", "s", "n")


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def per_group(df: DataFrame, by: list[str], work: Callable[[pd.DataFrame], Iterator[pd.DataFrame] | pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    return df.groupBy(*by).applyInPandas(work, schema)
