"""Search of a Parquet table's lines through an index of the trigrams that each file holds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.text import let

#: The columns that analytics.recent() searches.
SEARCHED = ("raw_log", "format_detected", "src_ip")


def grams(text: Column) -> Column:
    """Distinct trigrams of a text in lower case, in time linear in its length; none below three characters."""

    def of(chars: Column) -> Column:
        all_of = F.transform(chars, lambda c, i: F.concat(c, F.get(chars, i + 1), F.get(chars, i + 2)))
        return F.array_distinct(F.filter(all_of, lambda g: F.length(g) == 3))

    return let(F.split(F.lower(text), ""), of)


def _paths(spark: SparkSession, names: Iterable[str]) -> set[str]:
    """File names as paths: Spark gives them in two forms, with percent signs for odd characters, and reads them without."""
    jvm = spark._jvm
    return {jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(n)).toString() for n in names}


def _index(spark: SparkSession, index: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(index)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "gram string, file string")
    return spark.read.schema("gram string, file string").parquet(index)


def _known(spark: SparkSession, index: str) -> set[str]:
    return {r[0] for r in _index(spark, index).where("gram is null").select("file").collect()}


def index_table(spark: SparkSession, path: str, index: str) -> int:
    """Adds the files that the index doesn't know; returns their number.

    One row a trigram and file, in the order of the trigrams, so a search reads few row groups; a row without trigram says
    that the file is in, so files of empty lines count as well. Only names of files pass the driver.
    """
    new = sorted(_paths(spark, spark.read.parquet(path).inputFiles()) - _known(spark, index))
    if not new:
        return 0
    lines = spark.read.option("basePath", path).parquet(*new)
    held = lines.select(F.col("_metadata.file_path").alias("file"), F.explode(grams(F.concat_ws("\n", *SEARCHED))).alias("gram")).distinct()
    done = spark.createDataFrame([(None, f) for f in new], "gram string, file string")
    held.select("gram", "file").unionByName(done).repartitionByRange("gram", "file").sortWithinPartitions("gram", "file").write.mode("append").parquet(index)
    return len(new)


def candidates(spark: SparkSession, path: str, index: str, text: str) -> DataFrame:
    """The table without files that cannot hold the text: those of the index that lack one of its trigrams. Files that the
    index doesn't know stay, and all do if the text is shorter than three characters."""
    whole = spark.read.parquet(path)
    asked = spark.range(1).select(grams(F.lit(text))).first()[0]
    if not asked:
        return whole
    hits = _index(spark, index).where(F.col("gram").isin(asked)).groupBy("file").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(asked))
    there = _paths(spark, whole.inputFiles())
    files = (there - _known(spark, index)) | (there & _paths(spark, (r[0] for r in hits.select("file").collect())))
    return spark.read.schema(whole.schema).option("basePath", path).parquet(*sorted(files)) if files else whole.where("false")
