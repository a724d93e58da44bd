"""The generation graph as a dataflow (W): context, fan-out over formats, provider, outcomes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUPPORTED = ("quiz", "flashcards", "tldr", "video_script")


def contexts(results: DataFrame) -> DataFrame:
    """(request_id, context, sources) of retrieved (request_id, rank, text); texts joined by blank lines."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "text")))
    rows = results.groupBy("request_id").agg(listed.alias("sources"))
    return rows.withColumn("context", F.array_join(F.transform("sources", lambda s: s.text), "\n\n"))


def add_evidence(context: DataFrame, more: DataFrame) -> DataFrame:
    """A second retrieval is appended as it is."""
    new = contexts(more).select("request_id", F.col("sources").alias("__s"), F.col("context").alias("__c"))
    rows = context.join(new, "request_id", "left")
    return rows.select("request_id", F.concat("sources", F.coalesce("__s", F.expr("slice(sources, 1, 0)"))).alias("sources"), F.concat_ws("\n\n", "context", "__c").alias("context"))


def needs_new_evidence(approved: Column, issues: Column) -> Column:
    """W4."""
    return ~approved & F.exists(issues, lambda i: F.lower(i).rlike("respaldo|contexto"))


def echo_provider(fmt: Column, context: Column) -> Column:
    """Offline provider: the content is the context."""
    return context


def fan_out(requests: DataFrame, context: DataFrame, provider: Callable[[Column, Column], Column] = echo_provider) -> DataFrame:
    """One row for each requested format, with content or the error that prevented it."""
    rows = requests.join(context.select("request_id", "context"), "request_id", "left").select("request_id", F.explode("formats_requested").alias("format"), "context")
    error = F.when(F.col("context").isNull(), "NO_CONTEXT").when(~F.col("format").isin(*SUPPORTED), "UNSUPPORTED_FORMAT")
    return rows.withColumn("error", error).withColumn("content", F.when(F.col("error").isNull(), provider(F.col("format"), F.col("context"))))


def outcomes(results: DataFrame) -> DataFrame:
    """Reducer and F22: counts, overall outcome and the trace of each request."""
    ok = F.col("error").isNull()
    trace = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "format", F.coalesce("error", F.lit("success"))))), ",")
    rows = results.groupBy("request_id").agg(F.count("*").alias("n_outcomes"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), trace.alias("trace"))
    return rows.withColumn("outcome", F.when(F.col("failed") == 0, "success").when(F.col("succeeded") > 0, "partial").otherwise("failed"))


def parse_json(raw: Column, schema: str) -> Column:
    """A model's answer without its code fence, to a typed value; null if it is no such JSON."""
    return F.from_json(F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*|\s*```$", ""), schema)
