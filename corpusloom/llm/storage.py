"""Shared storage: cutting lineage in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch between the JVM and Python; texts and archives are large, so the default would fill memory.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound of Arrow batches to BATCH_BYTES, if it is higher."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def shared_folder(spark: SparkSession) -> str:
    """Folder of spark.checkpoint.dir. Only a session of one machine, as in tests, gets a local one if it names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            folder = held.get()
        elif spark.sparkContext.master.startswith("local"):
            folder = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet in the shared folder and read them back: lost executors lose nothing of it."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` that no later step reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table, as JSON, that are broadcast; of a larger one each row goes to as many places as there are salts.
BROADCAST_BYTES, SALTS = 16 << 20, 32


def join_measured(rows: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows, of which any number can share a key, with a written table of one row a key: broadcast if its measured size is small, else salted."""
    size = other.agg(F.sum(F.octet_length(F.to_json(F.struct(*other.columns))))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(other), list(on), how)
    salted = other.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    place = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
    return rows.withColumn("__salt", place).join(salted, [*on, "__salt"], how).drop("__salt")
