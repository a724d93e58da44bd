"""Tables that cut lineage, in the folder that the cluster names, and joins whose broadcast side is measured."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table, as JSON, that are broadcast; of a larger one each row goes to as many places as there are salts.
BROADCAST_BYTES, SALTS = 16 << 20, 32


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


def staged(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet and read back: every reader sees the same ones, and lost executors lose none."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def join_measured(rows: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows, of which any number can share a key, with a table of one row a key: broadcast if its measured size is small, else salted."""
    size = other.agg(F.sum(F.octet_length(F.to_json(F.struct(*other.columns))))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(other), list(on), how)
    salted = other.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    place = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
    return rows.withColumn("__salt", place).join(salted, [*on, "__salt"], how).drop("__salt")
