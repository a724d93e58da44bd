"""Sources (A1, A3-A6, A9-A11): documents by suffix, chunk CSV, retrieval batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.sources.pdf import read_pdf

KINDS = {".pdf": "pdf", ".md": "markdown", ".txt": "text"}
CHUNK_COLUMNS = ("chunk_id", "document_id", "chunk_text")
OPTIONAL_CHUNK_COLUMNS = ("categoria", "titulo_documento")
# Columns that are looked for, in their order.
CSV_TEXT_COLUMNS = "claim_text text content sentence summary key_point question answer explanation front back narration".split()
RESULT_SCHEMA = "array<struct<rank:int,chunk_id:string,document_id:string,score:double,text:string,metadata:map<string,string>>>"
PAYLOAD_SCHEMA = f"contract_version string, case_id string, query string, top_k int, score_type string, status string, results {RESULT_SCHEMA}, error struct<code:string,message:string>"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0))


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(document_id, source, page, file_type, text) of all files below a folder, and (path, reason) of the rejected ones.

    Markdown and text files are one page each, PDF files one row a page. Files of any other suffix, PDF files that cannot
    be read, and pages of which that is true are rejected with their reason.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[suffix(F.col("path"))]
    rows = files.withColumn("file_type", kind)
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]+)?$", 1)
    good = rows.where("file_type in ('markdown', 'text')").select(name.alias("document_id"), F.col("path").alias("source"), F.lit(1).alias("page"), "file_type", F.decode("content", "UTF-8").alias("text"))
    bad = rows.where("file_type is null").select("path", F.lit("unsupported suffix").alias("reason"))
    pages = read_pdf(spark, path)
    good = good.unionByName(pages.where("error is null").drop("error"))
    return good, bad.unionByName(pages.where("error is not null").select(F.col("source").alias("path"), F.col("error").alias("reason")))


def read_chunks_csv(spark: SparkSession, path: str) -> DataFrame:
    """A4: a chunk CSV with quoted line breaks and perhaps a byte-order mark; ValueError if a column is missing."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if missing := [c for c in CHUNK_COLUMNS if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    optional = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in OPTIONAL_CHUNK_COLUMNS]
    return df.select(*CHUNK_COLUMNS, *optional)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """A5: retrieval payloads of JSON files whose root is an array; ValueError if it is not."""
    raw = spark.read.text(path, wholetext=True)
    if not raw.where(~F.startswith(t.strip(F.col("value")), F.lit("["))).isEmpty():
        raise ValueError("the root of a batch must be an array")
    return raw.select(F.explode(F.from_json("value", f"array<struct<{PAYLOAD_SCHEMA.replace(' array', ':array').replace(' struct', ':struct').replace(' string', ':string').replace(' int', ':int')}>>")).alias("p")).select("p.*")


def text_columns(columns: list[str]) -> list[str]:
    """The known text columns, whatever their case, in their fixed order."""
    lower = {c.lower(): c for c in reversed(columns)}
    return [lower[c] for c in CSV_TEXT_COLUMNS if c in lower]


def first_column(columns: list[str], candidates: list[str]) -> str:
    """A10; KeyError if none is there."""
    for c in candidates:
        if c in columns:
            return c
    raise KeyError(f"none of {candidates}")


def domain_of(path: Column, root: str) -> Column:
    """The first folder below the root, else ``unclassified``."""
    below = F.regexp_extract(path, rf"{root.rstrip('/')}/+([^/]+)/", 1)
    return F.when(below == "", "unclassified").otherwise(below)
