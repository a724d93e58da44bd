"""From raw documents to token ids: five stages, each on all that its predecessor kept.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the docs of the next one. All stages but the last return the columns of ``documents``.

Every row is decided on by its own text, so rows without an id, and rows that share an id but not the text, have their
own fate. Defined results: nulls in any column and extra columns, whatever their names, are carried through; null and
empty texts have no language and go in the first stage; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, crf_language, jaccard_join, ordinal, positional_index
from corpusloom.llm.storage import cut, table

#: Share that the best of the learned languages must have; with three or fewer it always has. Texts in two stay.
LEAST_LANGUAGE_SHARE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters, and those of which no learned language has the least share.

    The share is the largest among the learned languages, so with three or fewer it is never below 1/3. It does not
    measure whether a text fits none of them: such a text stays.
    """
    model = crf_language.learned(docs)
    found = crf_language.predict(docs, model, prefix="__")
    return found.where((F.col("__lang_pred") != crf_language.UNKNOWN) & (F.col("__lang_score") >= LEAST_LANGUAGE_SHARE)).select(docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts that are not toxic."""
    model = ordinal.learned(docs, table(spark, sf_dir, "labels"))
    return ordinal.score(docs, model, prefix="__").where("NOT __toxic").select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents keep the one of least id; one without an id only if none has one.

    Texts without words stay, but for repeated rows; of rows of one id and text one stays.
    """
    key = F.struct(F.col("doc_id").isNull().alias("missing"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("text"))
    found = jaccard_join.near_duplicates(docs.select(key.alias("key"), "text"), "key")
    gone = found.where("key <> component").select("key").distinct()
    kept = docs.withColumn("__key", key).join(gone, F.col("__key") == gone["key"], "left_anti")
    return kept.dropDuplicates(["__key"]).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which 5 % or more of the words lie in a window of a benchmark item."""
    text = F.sha2("text", 256)
    found = positional_index.contamination(docs.select(text.alias("key"), "text"), table(spark, sf_dir, "benchmark"), "key")
    dirty = found.where("contaminated").select("key").distinct()
    return docs.withColumn("__key", text).join(dirty, F.col("__key") == dirty["key"], "left_anti").select(docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.round_trip(docs, bpe.tokenizer_path(), ["doc_id"]).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", language_stage),
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: SQL cannot express the learned stages; the tests run the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
