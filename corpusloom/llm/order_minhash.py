"""Document fingerprints by order MinHash, sensitive to edit distance.

A k-mer is k consecutive words with the number of its occurrence in the text, so repetitions count. For each of the
sketch's hash functions the ``PICKED`` k-mers of least hash are taken, put back into the order they have in the text,
and hashed as a tuple; the tuples' hashes are the fingerprint. Two texts agree in a place with a probability that
falls with their edit distance, since both the k-mers and their order must survive; the likeness is the share of
places that agree.

Defined results: null and empty texts and texts without words have the fingerprint of the empty text, which is like
itself only; a text of fewer than k words is one k-mer; equal texts have equal fingerprints; repeated ids are put in
the order of their texts, rows with a null id come first; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import vectext
from corpusloom.llm.storage import table

KMER_WORDS = 3
#: Hash functions, that is, places of a fingerprint, of 16 bits each.
PLACES = 64
PICKED = 2
#: k-mers hashed at a time.
BLOCK = 1 << 14
#: Keys that are no numbers of which the ranges of documents are told; it changes no result.
SAMPLE_KEYS = 10_000

_seeds = vectext.mix(np.arange(1, 2 * PLACES + 1, dtype=np.uint64)).reshape(2, PLACES, 1)
_FACTORS, _SHIFTS = _seeds[0] | np.uint64(1), _seeds[1]
_TOP = np.uint64(2**64 - 1)


def _occurrences(h: np.ndarray) -> np.ndarray:
    """Number of earlier k-mers equal to each."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    heads = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    place = np.arange(len(h)) - np.repeat(heads, np.diff(np.append(heads, len(h))))
    out = np.empty(len(h), np.uint64)
    out[order] = place
    return out


def _sketch(kmers: np.ndarray) -> np.ndarray:
    """PLACES numbers of 16 bits for the k-mers of one text, in its order."""
    if not len(kmers):
        return np.zeros(PLACES, np.uint16)
    numbered = vectext.mix(kmers + _occurrences(kmers) * np.uint64(0x9E3779B97F4A7C15))
    best = np.full((PLACES, PICKED), _TOP)
    where = np.full((PLACES, PICKED), -1)
    rows = np.arange(PLACES)
    for first in range(0, len(numbered), BLOCK):
        values = numbered[None, first : first + BLOCK] * _FACTORS + _SHIFTS
        for _ in range(min(PICKED, values.shape[1])):
            at = values.argmin(axis=1)
            least = values[rows, at]
            values[rows, at] = _TOP
            worst = best.argmax(axis=1)
            better = least < best[rows, worst]
            best[rows[better], worst[better]] = least[better]
            where[rows[better], worst[better]] = first + at[better]
    where.sort(axis=1)
    out = _SHIFTS[:, 0].copy()
    for j in range(PICKED):
        out = vectext.mix(out + np.where(where[:, j] >= 0, numbered[where[:, j]], np.uint64(0)))
    return np.maximum((out >> np.uint64(48)).astype(np.uint16), np.uint16(1))


def sketches(texts: pa.Array) -> np.ndarray:
    """One row of PLACES numbers a text. The empty text's are 0; no other text has a 0."""
    out = np.zeros((len(texts), PLACES), np.uint16)
    at = 0
    for part in vectext.slices([pa.RecordBatch.from_arrays([texts], names=["text"])], "text"):
        raw, offsets = vectext.utf8(part.column("text"))
        starts, ends, words = vectext.words(raw, offsets, vectext.NON_SPACE)
        kmers, bounds = vectext.shingles(vectext.Hasher(raw).spans(starts, ends), words, KMER_WORDS)
        for first, last in zip(bounds[:-1], bounds[1:]):
            out[at] = _sketch(kmers[first:last])
            at += 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def shown(sketch: np.ndarray) -> str:
    return sketch.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The key columns and the fingerprint, 4 hexadecimal digits a place."""
    schema = docs.select(*keys).schema.add("fingerprint", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vectext.slices(batches, "__text"):
            found = [shown(s) for s in sketches(batch.column("__text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(found, pa.string())], names=[*keys, "fingerprint"])

    return docs.select(*keys, F.col(text).alias("__text")).mapInArrow(run, schema)


def in_sequence(docs: DataFrame, key: str, partitions: int) -> DataFrame:
    """(bucket, tail, key, text) sorted within partitions so that each row is followed by the next document.

    Keys are dealt into ranges by quantiles, those that are no numbers by about ``SAMPLE_KEYS`` of them; each bucket ends
    with a copy (tail) of the first document of the next one, the last with that of the first. Only the least key of each
    bucket and that sample reach the driver.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    named = rows.where("key is not null")
    if partitions < 2:
        dealt = rows.withColumn("bucket", F.lit(0))
    elif isinstance(docs.schema[key].dataType, T.NumericType):
        quantiles = named.agg(F.percentile_approx(F.col("key").cast("double"), [i / partitions for i in range(1, partitions)], 10_000)).first()[0]
        at = rows.withColumn("at", F.coalesce(F.col("key").cast("double"), F.lit(float("-inf"))))
        splits = [float("-inf"), *(sorted(set(quantiles or [])) or [0.0]), float("inf")]
        dealt = Bucketizer(splits=splits, inputCol="at", outputCol="bucket").transform(at).withColumn("bucket", F.col("bucket").cast("int")).drop("at")
    else:
        share = SAMPLE_KEYS / max(1, named.count())
        found = sorted({r[0] for r in named.where(F.expr("pmod(xxhash64(key), 1000000) / 1e6") < share).select("key").limit(4 * SAMPLE_KEYS).collect()})
        inner = sorted({found[len(found) * i // partitions] for i in range(1, partitions)}) if found else []
        kind = f"array<{docs.schema[key].dataType.simpleString()}>"
        dealt = rows.withColumn("bucket", F.coalesce(F.size(F.filter(F.lit(inner).cast(kind), lambda s: s <= F.col("key"))), F.lit(0))) if inner else rows.withColumn("bucket", F.lit(0))
        dealt = dealt.withColumn("bucket", F.when(F.col("key").isNull(), 0).otherwise(F.col("bucket")))
    dealt = dealt.withColumn("tail", F.lit(0))
    first = sorted((r["bucket"], r["some"], r["k"]) for r in dealt.groupBy("bucket").agg(F.max(F.col("key").isNull()).alias("some"), F.min("key").alias("k")).collect())
    if not first:
        return dealt
    before = [b for b, _, _ in first]
    before = dict(zip(before, [before[-1], *before[:-1]]))
    heads = F.col("key").isin([k for _, some, k in first if not some]) | F.col("key").isNull()
    to = F.create_map(*[F.lit(v) for b, p in before.items() for v in (b, p)])
    # of repeated keys the least text comes first
    tails = dealt.where(heads).groupBy("bucket").agg(F.min(F.struct("key", "text")).alias("h"))
    tails = tails.select("h.key", "h.text", to[F.col("bucket")].alias("bucket"), F.lit(1).alias("tail"))
    return dealt.unionByName(tails).repartition(partitions, "bucket").sortWithinPartitions("bucket", "tail", "key", "text")


def edits(docs: DataFrame, key: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """For each document its own and its edited text's fingerprints, and their likeness.

    The edited text has its last floor(n / 2) code points replaced by as many first ones of the next document.
    """
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in vectext.slices(batches, "text"):
            own = sketches(batch.column("text"))
            rows = list(zip(batch.column("tail").to_pylist(), batch.column("key").to_pylist(), batch.column("text").to_pylist(), own))
            pairs = [(a, b) for a, b in zip([held, *rows[:-1]], rows) if a is not None and not a[0]]
            held = rows[-1]
            edited = [a[2][: len(a[2]) - len(a[2]) // 2] + b[2][: len(a[2]) // 2] for a, b in pairs]
            changed = sketches(pa.array(edited, pa.large_string()))
            out = [
                (a[1], len(a[2]), hashlib.sha256(e.encode()).hexdigest(), shown(a[3]), shown(c), likeness(a[3], c), likeness(a[3], b[3]))
                for (a, b), e, c in zip(pairs, edited, changed)
            ]
            columns = list(zip(*out)) or [[]] * len(names)
            kinds = [batch.schema.field("key").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)

    return in_sequence(docs, key, partitions).select("tail", "key", "text").mapInArrow(run, schema).withColumnRenamed("key", key)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(table(spark, sf_dir, "documents"))
