"""Error catalogue of a batch of model calls (F23, F24) and the outcome of whole batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.operators.quality import overall_outcome

# Fixed values: (code, http status, retryable, provider), the most important cause first.
CATALOGUE = (
    ("RESOURCE_EXHAUSTED", 429, True, "gemini"),
    ("PROVIDER_UNAVAILABLE", 503, True, "gemini"),
    ("PROVIDER_TIMEOUT", 504, True, "gemini"),
    ("PROVIDER_ERROR", 502, True, "gemini"),
    ("INVALID_MODEL_OUTPUT", 502, True, "gemini"),
    ("PROVIDER_REJECTED_REQUEST", 502, False, "gemini"),
    ("PROVIDER_AUTH_ERROR", 500, False, "gemini"),
    ("MODEL_NOT_FOUND", 500, False, "gemini"),
    ("NO_CONTEXT", 404, False, "internal"),
    ("UNSUPPORTED_FORMAT", 422, False, "internal"),
    ("INTERNAL_ERROR", 500, False, "internal"),
)
UNKNOWN = CATALOGUE[-1]


def _looked_up(code: Column, field: int) -> Column:
    pairs = [F.lit(v) for entry in CATALOGUE for v in (entry[0], entry[field])]
    return F.coalesce(F.create_map(*pairs)[code], F.lit(UNKNOWN[field]))


def error_code(kind: Column, name: Column, upstream: Column, status: Column, message: Column) -> Column:
    """the cause of a failure; kind is ``output`` (unusable answer), ``api`` (answered with an error) or other."""
    status, name = F.upper(F.coalesce(status, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    key = F.coalesce(message.rlike("API_KEY_INVALID|API key not valid"), F.lit(False))
    is_ = lambda *codes: F.coalesce(upstream.isin(*codes), F.lit(False))
    answered = (
        F.when(is_(429) | (status == "RESOURCE_EXHAUSTED"), "RESOURCE_EXHAUSTED").when(is_(503) | (status == "UNAVAILABLE"), "PROVIDER_UNAVAILABLE")
        .when(is_(504) | (status == "DEADLINE_EXCEEDED"), "PROVIDER_TIMEOUT").when(is_(500, 502) | (status == "INTERNAL"), "PROVIDER_ERROR")
        .when(is_(401, 403) | key, "PROVIDER_AUTH_ERROR").when(is_(404), "MODEL_NOT_FOUND").otherwise("PROVIDER_REJECTED_REQUEST")
    )
    other = F.when(F.contains(name, F.lit("timeout")) | (name == "deadlineexceeded"), "PROVIDER_TIMEOUT").when(F.contains(name, F.lit("connect")), "PROVIDER_UNAVAILABLE").otherwise("INTERNAL_ERROR")
    return F.when(kind == "output", "INVALID_MODEL_OUTPUT").when(kind == "api", answered).otherwise(other)


def described(code: Column, message: Column, upstream: Column) -> Column:
    """The error as a struct; a code that is not in the catalogue becomes an internal one, the message is shortened."""
    known = F.when(code.isin(*[entry[0] for entry in CATALOGUE]), code).otherwise(UNKNOWN[0])
    return F.struct(
        known.alias("code"), t.shorten(message).alias("message"), _looked_up(code, 2).alias("retryable"), _looked_up(code, 1).alias("http_status"),
        upstream.alias("upstream_status"), _looked_up(code, 3).alias("provider"),
    )


def batch_outcomes(units: DataFrame, by: str) -> DataFrame:
    """(by, overall, total, succeeded, failed, http) of units (by, code), code being null for a success.

    http is that of the most important cause where all failed, else null.
    """
    place = F.coalesce(F.create_map(*[F.lit(v) for i, entry in enumerate(CATALOGUE) for v in (entry[0], i)])[F.col("code")], F.lit(len(CATALOGUE) - 1))
    counts = units.withColumn("__place", F.when(F.col("code").isNotNull(), place)).groupBy(by).agg(
        F.count("*").alias("total"), F.count_if(F.col("code").isNull()).alias("succeeded"), F.count("code").alias("failed"), F.min("__place").alias("__place")
    )
    http = F.get(F.array(*[F.lit(entry[1]) for entry in CATALOGUE]), F.col("__place"))
    overall = overall_outcome(F.col("succeeded"), F.col("failed"))
    return counts.select(by, overall.alias("overall"), "total", "succeeded", "failed", F.when(overall == "failed", http).alias("http"))
