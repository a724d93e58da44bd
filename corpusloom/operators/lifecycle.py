"""Keyed state and history of documents, formats and evaluations (J), on append-only rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.datasets import positions

BASELINE = ("quiz", "flashcards")
#: Rows that a task of the revision cycles gets, on average, and places that rows of one format go to.
TASK_ROWS, SALTS = 1 << 18, 32
#: Allowed next states of a document's indexing.
TRANSITIONS = {"stored": ("indexing",), "indexing": ("indexed", "failed"), "failed": ("indexing",), "indexed": ("indexing",)}


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. An aggregate with map-side combining, so a hot key is no hot task."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r"))
    return last.select("r.*")


def register(documents: DataFrame) -> DataFrame:
    """One document for each content hash, the first one, with the number of its registrations."""
    return documents.groupBy("sha256").agg(F.min_by("document_id", F.struct("created_at", "document_id")).alias("document_id"), F.min("created_at").alias("created_at"), F.count("*").alias("registrations"))


def current_formats(history: DataFrame) -> DataFrame:
    """The valid attempt of each document and type: one in process, else a success, else any; then the newest."""
    priority = F.when(F.col("status") == "processing", 2).when(F.col("status") == "success", 1).otherwise(0)
    return latest(history.withColumn("__p", priority), ["document_id", "format_type"], ["__p", "created_at", "updated_at", "format_id"]).drop("__p")


def stable_formats(history: DataFrame) -> DataFrame:
    """As above without attempts in process."""
    return current_formats(history.where("status <> 'processing'"))


def aggregate_status(current: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """The state of a document's formats; documents without any get theirs from their own status."""
    ok = F.col("status") == "success"
    good, tried = F.collect_set(F.when(ok, F.col("format_type"))), F.collect_set("format_type")
    state = (
        F.when(F.bool_or(F.col("status") == "processing"), "processing").when(F.size(good) == 0, "error")
        .when(F.size(F.array_except(F.array(*map(F.lit, BASELINE)), good)) > 0, "partial").when(F.size(good) != F.size(tried), "partial").otherwise("ready")
    )
    found = current.groupBy("document_id").agg(state.alias("state"))
    if documents is None:
        return found
    fallback = F.when(F.col("status").isin("failed", "deleted"), "error").otherwise("pending")
    return documents.join(found, "document_id", "left").select("document_id", F.coalesce("state", fallback).alias("state"))


def transition_violations(events: DataFrame, key: str, order: list[str], transitions: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows whose state may not follow the one before it."""
    before = F.lag("state").over(Window.partitionBy(key).orderBy(*order))
    allowed = F.create_map(*[x for k, v in transitions.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = events.withColumn("previous", before)
    return rows.where(F.col("previous").isNotNull() & ~F.coalesce(F.array_contains(allowed[F.col("previous")], F.col("state")), F.lit(False)))


def first_values(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Of each column the first value that is not empty."""
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.struct(*order))).alias(c)
    return rows.groupBy(key).agg(*map(first, columns))


def revision_violations(formats: DataFrame) -> DataFrame:
    """Revisions without a successful root of the same document and type, and roots with several."""
    roots = formats.where("revision_of is null").select(F.col("format_id").alias("revision_of"), F.col("document_id").alias("__d"), F.col("format_type").alias("__t"), F.col("status").alias("__s"))
    revisions = formats.where("revision_of is not null")
    bad = F.when(F.col("__d").isNull(), "orphan").when((F.col("__d") != F.col("document_id")) | (F.col("__t") != F.col("format_type")), "other document or type").when(F.col("__s") != "success", "root failed")
    single = revisions.join(roots, "revision_of", "left").withColumn("finding", bad).where("finding is not null").select("format_id", "finding")
    several = revisions.groupBy("revision_of").agg(F.count("*").alias("n")).where("n > 1").select(F.col("revision_of").alias("format_id"), F.lit("several revisions").alias("finding"))
    return single.unionByName(several)


def _newest_verdicts(evaluations: DataFrame, parts: int) -> DataFrame:
    """(format_id, verdict, evaluations): the newest verdict of each format, dealt out by format_id; a format of many rows goes to several tasks first."""
    order = ["created_at", "evaluation_id"]
    salted = evaluations.withColumn("__salt", F.pmod(F.xxhash64("evaluation_id"), F.lit(SALTS))).repartition(parts, "format_id", "__salt")
    some = salted.groupBy("format_id", "__salt").agg(F.max_by(F.struct(*order, "verdict"), F.struct(*order)).alias("__r"), F.count("*").alias("n"))
    newest = F.max_by("__r.verdict", F.struct(*[f"__r.{c}" for c in order]))
    return some.repartition(parts, "format_id").groupBy("format_id").agg(newest.alias("verdict"), F.sum("n").alias("evaluations"))


def revision_cycles(formats: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Each root with its revision and the newest evaluation of the revision, else of the root.

    Rows are dealt out to as many tasks as ``TASK_ROWS`` asks, so the memory of a task does not grow with the tables.
    Revisions meet their evaluations before the roots: no join has the roots without a revision under one empty key.
    """
    parts = max(formats.sparkSession.sparkContext.defaultParallelism, -(-(formats.count() + evaluations.count()) // TASK_ROWS))
    roots = formats.where("revision_of is null").select("document_id", "format_type", "format_id").repartition(parts, "format_id")
    newest = _newest_verdicts(evaluations, parts)
    revisions = formats.where("revision_of is not null").groupBy("revision_of").agg(F.min("format_id").alias("revision_id"), F.count("*").alias("revisions")).repartition(parts, "revision_id")
    judged = revisions.join(newest.select(F.col("format_id").alias("revision_id"), F.col("verdict").alias("__v"), F.col("evaluations").alias("__n")), "revision_id", "left")
    rows = roots.join(newest, "format_id", "left").join(judged.withColumnRenamed("revision_of", "format_id").repartition(parts, "format_id"), "format_id", "left")
    return rows.select("document_id", "format_type", "format_id", "revision_id", F.coalesce("revisions", F.lit(0)).alias("revisions"), F.coalesce("__v", "verdict").alias("verdict"), (F.coalesce("evaluations", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias("evaluations"))


def stale(formats: DataFrame, cutoff: Column) -> DataFrame:
    """Revisions in process that were not updated after the cutoff."""
    return formats.where((F.col("status") == "processing") & F.col("revision_of").isNotNull() & (F.col("updated_at") <= cutoff))


def fail_stale(formats: DataFrame, cutoff: Column, failed_at: Column, message: str) -> DataFrame:
    """All formats, with stale revisions closed as failed."""
    hit = (F.col("status") == "processing") & F.col("revision_of").isNotNull() & (F.col("updated_at") <= cutoff)
    return formats.withColumn("__hit", F.coalesce(hit, F.lit(False))).withColumns(
        {"status": F.when(F.col("__hit"), "failed").otherwise(F.col("status")), "updated_at": F.when(F.col("__hit"), failed_at).otherwise(F.col("updated_at")), "error_message": F.when(F.col("__hit"), message).otherwise(F.col("error_message"))}
    ).drop("__hit")


def accept_updates(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates whose target is unknown, no revision, or still in process; late answers are rejected."""
    target = current.select("format_id", F.col("status").alias("__s"), F.col("revision_of").alias("__r"))
    return updates.join(target, "format_id", "left").where("__s is null or __r is null or __s = 'processing'").drop("__s", "__r")


def request_mismatch(requested: Column, returned: Column) -> Column:
    """Differences of the requested and the returned set, in both directions, and repetitions."""
    return F.size(F.array_except(requested, returned)) + F.size(F.array_except(returned, requested)) + F.size(returned) - F.size(F.array_distinct(returned))


def in_requested_order(outcomes: DataFrame, requested: Column) -> DataFrame:
    """Outcomes with their place in the requested list; unknown ones come last."""
    at = F.array_position(requested, F.col("format"))
    return outcomes.withColumn("place", F.when(at > 0, at).otherwise(F.lit(2**31 - 1)))


def library_search(rows: DataFrame, query: str, fields: list[str], category: Column | None = None) -> DataFrame:
    """Rows of a category that hold the query in any field, whatever its case."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))), F.lit(query.lower()))
    return rows.where(hit if category is None else hit & category)


def timeline(evaluations: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Versions of each key in their order."""
    return evaluations.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def newest_first(documents: DataFrame) -> DataFrame:
    """Documents (document_id, created_at), the newest first; equals by id."""
    return documents.orderBy(F.desc("created_at"), "document_id")


def placed_newest_first(documents: DataFrame) -> DataFrame:
    """The documents with their ``place`` in that order, from 1; documents without a time come last. No task sorts all of them."""
    ordered = documents.withColumn("__age", F.coalesce(-F.unix_micros(F.col("created_at").cast("timestamp")), F.lit((1 << 63) - 1)))
    return positions(ordered, ["__age", "document_id"]).withColumn("place", F.col("position") + 1).drop("__age", "position")


def active_documents(documents: DataFrame) -> DataFrame:
    """Documents (status, is_active) that are stored and active."""
    return documents.where((F.col("status") == "stored") & F.coalesce("is_active", F.lit(False)))


def busy_formats(history: DataFrame, requested: DataFrame) -> DataFrame:
    """(document_id, formats): requested formats (document_id, format_type) with an attempt that is still processing.

    A new attempt may begin only for documents that are not among them; formats are sorted and joined by ", ".
    """
    active = history.where("status = 'processing'").select("document_id", "format_type").distinct()
    found = active.join(requested.select("document_id", "format_type"), ["document_id", "format_type"], "left_semi")
    return found.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("format_type")), ", ").alias("formats"))
