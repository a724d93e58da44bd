"""Embeddings without a model, a chunk table that is merged by key and version, and the alignment re-ranker."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as t
from corpusloom.sources.staging import staged

#: Dimensions of a hashed embedding, and buckets of a chunk table.
WIDTH, BUCKETS = 256, 64
#: Share of coverage, of pairs in order and of their nearness in the score of an alignment.
COVERAGE, ORDER, NEARNESS = 1.0, 0.5, 0.5


def token_place(token: str, width: int = WIDTH) -> tuple[int, int]:
    """Dimension and sign of a token, from its MD5 so that any engine can tell them."""
    digest = hashlib.md5(token.encode("utf-8", "surrogatepass")).hexdigest()
    return int(digest[:8], 16) % width, 1 if int(digest[8], 16) % 2 else -1


def token_places(tokens: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """``token_place`` of many tokens; an empty one has sign 0."""
    known = tokens.cast(pa.binary()).to_pylist()
    digests = np.frombuffer(b"".join([hashlib.md5(token).digest() for token in known]), np.uint8).reshape(-1, 16)
    place = np.ascontiguousarray(digests[:, :4]).view(">u4").ravel().astype(np.int64) % width
    sign = np.where(digests[:, 4] >> 4 & 1, 1, -1)
    return place, np.where(np.asarray(pc.binary_length(tokens)) > 0, sign, 0)


def hashed_counts(rows: DataFrame, text: str = "text", width: int = WIDTH, digest: str | None = None) -> DataFrame:
    """The rows and ``counts``, the signed counts of their words by dimension; null and empty texts have zeros.

    Words are found in the JVM and go to Python as one text with spaces between them; each distinct word of a batch is
    hashed once, and the counts are array operations. ``digest`` names a column for the SHA-256 of the counts.
    """
    kept = [c for c in rows.columns if c not in ("counts", digest)]
    words = rows.select(*kept, t.spaced_words(F.coalesce(F.col(text), F.lit(""))).alias("__words"))
    more = [digest] if digest else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pc.split_pattern(batch.column("__words"), " ")
            coded = lists.flatten().dictionary_encode()
            # an empty part, before the first word or after the last, counts as nothing
            place, sign = token_places(coded.dictionary, width)
            sizes = np.diff(np.asarray(lists.offsets))
            at = np.repeat(np.arange(len(lists)), sizes) * width
            index = np.asarray(coded.indices)
            sums = np.bincount(at + place[index], sign[index], len(lists) * width).astype(np.int64)
            offsets = pa.array(np.arange(len(lists) + 1) * width, pa.int32())
            made = [pa.ListArray.from_arrays(offsets, pa.array(sums))]
            if digest:
                made.append(pa.array([hashlib.sha256(x).digest() for x in sums.reshape(-1, width)], pa.binary()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, "counts", *more])

    schema = rows.select(*kept).schema.add("counts", T.ArrayType(T.LongType()))
    return words.mapInArrow(run, schema.add(digest, T.BinaryType()) if digest else schema)


def feature_embeddings(rows: DataFrame, text: str = "text", width: int = WIDTH, digest: str | None = None) -> DataFrame:
    """Adds ``embedding``, the signed counts of the words in ``width`` dimensions at unit length; empty texts have zeros.

    ``digest`` names a column that is equal for equal counts, and so for embeddings of equal texts.
    """
    norm = F.sqrt(F.aggregate("counts", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    # bound first: within the lambda the length would be summed anew for every element
    counted = t.bind(hashed_counts(rows, text, width, digest), __norm=F.greatest(norm, F.lit(1.0)))  # of whole numbers: 0 or at least 1
    return counted.withColumn("embedding", F.transform("counts", lambda x: (x / F.col("__norm")).cast("float"))).drop("counts", "__norm")


def read_store(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of a chunk table; none if it has not been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def merge_chunks(changes: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame] = feature_embeddings, key: str = "chunk_id", version: str = "version", buckets: int = BUCKETS) -> int:
    """Embed changed chunks and merge them into the table at a path; the number of rows that were new or newer.

    The table is partitioned by a hash of the key. Of several versions of a key the greatest stands, and a change counts
    only if its version is greater than the stored one: a repeated or late delivery embeds and writes nothing. Only the
    buckets of keys that changed are written, by dynamic partition overwrite; the others keep their files. Rows without a
    key or version are refused with ValueError.
    """
    spark = changes.sparkSession
    rows = [c for c in changes.columns if c != key]
    newest = changes.groupBy(key).agg(F.max_by(F.struct(*rows), version).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rows])
    newest = staged(newest.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "changes")
    if not newest.where(F.col(key).isNull() | F.col(version).isNull()).isEmpty():
        raise ValueError("a chunk has no key or no version")
    schema = embed(newest.limit(0)).schema
    stored = read_store(spark, path, schema)
    # at most as many as there are buckets
    asked = [r["bucket"] for r in newest.select("bucket").distinct().collect()]
    known = stored.where(F.col("bucket").isin(asked)).select(key, F.col(version).alias("__stored"))
    newer = newest.join(known, key, "left").where(F.col("__stored").isNull() | (F.col(version) > F.col("__stored"))).drop("__stored")
    applied = staged(embed(newer), "embedded")
    count = applied.count()
    if count:
        touched = [r["bucket"] for r in applied.select("bucket").distinct().collect()]
        kept = stored.where(F.col("bucket").isin(touched)).join(applied.select(key), key, "left_anti")
        merged = kept.select(applied.columns).unionByName(applied).repartition(len(touched), "bucket")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return count


def alignment(query: list[str], text: list[str]) -> float:
    """Score of the words of one query in the words of one text, as ``alignment_scorer`` says."""
    if not len(query):
        return 0.0
    places: dict[str, list[int]] = {word: [] for word in query}
    for at, word in enumerate(text):
        if word in places:
            places[word].append(at)
    score = COVERAGE * sum(bool(places[word]) for word in query) / len(query)
    if len(query) == 1:
        return round(score, 6)
    gaps = []
    for first, second in zip(query, query[1:]):
        here, there = places[first], places[second]
        if here and there:
            after = np.searchsorted(there, here, side="right")
            found = after < len(there)
            if found.any():
                gaps.append(int((np.asarray(there)[after[found]] - np.asarray(here)[found]).min()))
    return round(score + (ORDER * len(gaps) + NEARNESS * sum(1 / g for g in gaps)) / (len(query) - 1), 6)


@F.pandas_udf(T.DoubleType())
def _aligned(query: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([alignment(q, t) for q, t in zip(query, text)], dtype="float64")


def alignment_scorer(query: Column, text: Column) -> Column:
    """How well the words of a query are found in a text in their order and close together; offline and deterministic.

    The share of the query's words that the text has, half the share of neighbouring words that it has in that order, and
    half the mean of one over their least distance. A query of one word has the first part only, one of none scores 0.
    Words are found in the JVM and go to Python in Arrow batches; a pair costs as much as its text is long.
    """
    return _aligned(t.words(F.coalesce(query, F.lit(""))), t.words(F.coalesce(text, F.lit(""))))
