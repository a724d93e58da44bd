"""Sinks (A15, A17) and stored objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def packages(stable: DataFrame) -> DataFrame:
    """(document_id, n_formats, package): one nested JSON document of each document's formats."""
    listed = F.array_sort(F.collect_list(F.struct("format_type", "format_id", "status")))
    rows = stable.groupBy("document_id").agg(listed.alias("formats"))
    return rows.select("document_id", F.size("formats").alias("n_formats"), F.to_json(F.struct("document_id", "formats")).alias("package"))


def write_packages(stable: DataFrame, path: str) -> None:
    packages(stable).select("document_id", F.col("package").alias("value")).write.mode("overwrite").partitionBy("document_id").text(path)


def write_csv(rows: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header. ``single_file`` is for small reports only, as one task then writes all rows."""
    (rows.coalesce(1) if single_file else rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def stored_objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of an object, or of all below a folder, of any store that Spark reaches."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def delete_object(spark: SparkSession, path: str) -> bool:
    """Delete one object of any store that Spark reaches; False if there is none. A folder that is not empty is refused."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, False)
