"""Building evaluation datasets (I): deduplication, overlap, stable sampling, partitions, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.sources.staging import join_measured, staged

#: Parts of a stratum that are cut to size on their own before they meet.
PARTS = 64


def stable_rank(*parts: Column, seed: str = "") -> Column:
    """A rank that depends on the seed and the values only; it stands in for generators that no engine shares."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]), 256)


def first_of_each(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Of the rows with an equal key that is not empty the first; copies are combined before the shuffle."""
    kept = rows.withColumn("__key", key).where("__key <> ''")
    first = kept.groupBy("__key").agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r"), F.count("*").alias("copies"))
    return first.select("r.*", "copies")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """I4: keys that occur more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def repeated_texts(rows: DataFrame, key: Column, id_column: str) -> DataFrame:
    """(norm, n, id) of the rows whose normalised text n rows share, one row each, so that a group has no bound."""
    named = rows.select(key.alias("norm"), F.col(id_column).alias("id"))
    many = named.groupBy("norm").agg(F.count("*").alias("n")).where("n > 1")
    return join_measured(named, staged(many, "repeated-texts"), ["norm"]).select("norm", "n", "id")


def without_overlap(candidates: DataFrame, previous: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The candidates whose key no previous row has, and the others."""
    used = previous.select(key).where(F.col(key).isNotNull()).distinct()
    return candidates.join(used, key, "left_anti"), candidates.join(used, key, "left_semi")


def union_keys(frames: list[DataFrame], key: str) -> DataFrame:
    """The distinct keys of several tables."""
    out = frames[0].select(key)
    for more in frames[1:]:
        out = out.unionByName(more.select(key))
    return out.distinct()


def stratified_sample(rows: DataFrame, stratum: str, id_column: str, n: int | Column, seed: str = "") -> DataFrame:
    """The n rows of least stable rank of each stratum; n may be a column, as for deficits.

    Parts of a stratum are cut to n rows each before they meet, so no task ranks a whole stratum.
    """
    order = [stable_rank(F.col(id_column), seed=seed), F.col(id_column)]
    part = F.pmod(F.xxhash64(id_column), F.lit(PARTS))
    cut = rows.withColumn("__part", part).withColumn("pick", F.row_number().over(Window.partitionBy(stratum, "__part").orderBy(*order))).where(F.col("pick") <= n).drop("__part", "pick")
    return cut.withColumn("pick", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("pick") <= n)


def round_robin_sample(rows: DataFrame, bucket: str, domain: str, id_column: str, n: int, seed: str = "") -> DataFrame:
    """N rows of each bucket, one of each domain in turn; domains that are used up are passed over."""
    h = stable_rank(F.col(id_column), seed=seed)
    turn = F.row_number().over(Window.partitionBy(bucket, domain).orderBy(h, id_column))
    rows = rows.withColumn("turn", turn).where(F.col("turn") <= n)
    return rows.withColumn("pick", F.row_number().over(Window.partitionBy(bucket).orderBy("turn", domain))).where(F.col("pick") <= n)


def effective_text(*columns: Column) -> Column:
    """The first that is not blank."""
    return F.coalesce(*[F.nullif(t.strip(c), F.lit("")) for c in columns])


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``position``, from 0, in a global order, which should have no ties.

    The rows are dealt into ranges once, sorted in them and written; the place in a range and the sizes of the ranges
    before it are both read from that table, so no task gets all rows and no other sampling of ranges can disagree.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    kept = staged(ranged, "positions")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = kept.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))
    # one row a range
    before = staged(sizes.withColumn("__before", F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).drop("__size"), "ranges")
    return join_measured(kept.withColumn("__part", part), before, ["__part"]).withColumn("position", F.col("__before") + place).drop("__part", "__before", "__at")


def numbered(rows: DataFrame, order: list[str], pattern: str) -> DataFrame:
    """Ids of a pattern by a global order."""
    return positions(rows, order).withColumn("candidate_id", F.format_string(pattern, F.col("position") + 1)).drop("position")


def target_balance(counts: DataFrame, target: int) -> DataFrame:
    """Deficit and surplus of (bucket, n) against the target."""
    return counts.select("*", F.greatest(F.lit(0), target - F.col("n")).alias("deficit"), F.greatest(F.lit(0), F.col("n") - target).alias("surplus"))


def batches(rows: DataFrame, group: str, id_column: str, size: int) -> DataFrame:
    """Sequential batches of a fixed size in each group, with their first and last id.

    A group begins at its least global position, so it is numbered in as many tasks as it fills.
    """
    placed = staged(positions(rows.select(group, id_column), [group, id_column]), "batches")
    begins = staged(placed.groupBy(group).agg(F.min("position").alias("__begin")), "group-begins").withColumnRenamed(group, "__group")
    same = placed.withColumn("__group", F.col(group))
    known = join_measured(same.where(F.col(group).isNotNull()), begins.where("__group IS NOT NULL"), ["__group"]).drop("__group")
    unnamed = same.where(F.col(group).isNull()).drop("__group").withColumn("__begin", F.lit(begins.where("__group IS NULL").agg(F.min("__begin")).first()[0]).cast("long"))
    numbered_rows = known.unionByName(unnamed).withColumn("batch", F.expr(f"(position - __begin) div {size} + 1"))
    return numbered_rows.groupBy(group, "batch").agg(F.min(id_column).alias("first_id"), F.max(id_column).alias("last_id"), F.count("*").alias("rows"))


def partition_integrity(source: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """(part, key, finding) where parts overlap, miss or exceed the source; empty if they are a partition."""
    tagged = None
    for name, part in parts.items():
        one = part.select(key, F.lit(name).alias("part"))
        tagged = one if tagged is None else tagged.unionByName(one)
    shared = tagged.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("part")), ",").alias("part"), F.count("*").alias("n")).where("n > 1").select(key, "part", F.lit("in several parts").alias("finding"))
    missing = source.select(key).join(tagged, key, "left_anti").select(key, F.lit("").alias("part"), F.lit("in no part").alias("finding"))
    extra = tagged.join(source.select(key), key, "left_anti").select(key, "part", F.lit("not in the source").alias("finding"))
    return shared.unionByName(missing).unionByName(extra)


def overlap_audit(rows: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, repeated keys, keys found before, status."""
    mine = rows.groupBy(key).agg(F.count("*").alias("n"))
    old = previous.select(key).distinct().withColumn("__old", F.lit(1))
    found = mine.join(old, key, "left").agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_keys"), F.sum(F.col("n") - 1).alias("repeated"), F.coalesce(F.sum("__old"), F.lit(0)).alias("overlapping"))
    return found.withColumn("status", F.when((F.col("repeated") == 0) & (F.col("overlapping") == 0), "pass").otherwise("review"))


def counts_by(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, rows) of several columns in one pass."""
    stacked = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    return stacked.groupBy("x.dimension", "x.value").agg(F.count("*").alias("rows"))


def build_manifest(raw: DataFrame, final: DataFrame, columns: list[str], config: dict[str, object]) -> DataFrame:
    """One row: raw_count, final_count, duplicate_count (raw rows that are not in the final ones), counts and run_config.

    ``counts`` is a JSON object of each dimension's values of the final rows, ``run_config`` the parameters of the run.
    """
    told = counts_by(final, columns).where("value IS NOT NULL").groupBy("dimension").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "rows")))).alias("values"))
    each = F.concat(F.lit('"'), "dimension", F.lit('":'), F.to_json("values"))  # one row a dimension
    counts = told.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(each)), ","), F.lit("}")).alias("counts"))
    sizes = raw.agg(F.count("*").alias("raw_count")).crossJoin(final.agg(F.count("*").alias("final_count"))).crossJoin(counts)  # one row each
    run_config = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(config.items())]))
    return sizes.select("raw_count", "final_count", (F.col("raw_count") - F.col("final_count")).alias("duplicate_count"), "counts", run_config.alias("run_config"))


def reference_check(truth: DataFrame, chunks: DataFrame, ids: str = "relevant", chunk: str = "chunk_id") -> DataFrame:
    """Ids of the truth that no chunk has."""
    return truth.select("case_id", F.explode(ids).alias(chunk)).join(chunks.select(chunk), chunk, "left_anti")


def quota_violations(rows: DataFrame, by: str, expected: int) -> DataFrame:
    """Groups that do not have exactly the expected number of rows."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") != expected)


def consolidation_findings(rows: DataFrame, buckets: list[str], size: int) -> DataFrame:
    """(claim_id, finding) of reviewed claims (claim_id, review_status, bucket, relation_subtype, text) that may not be merged.

    Nulls count as blank. Findings: unreviewed, bucket, subtype_missing, subtype_foreign, text, duplicated; and size,
    without a claim, if the rows are not as many as expected.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    relational = F.col("bucket").eqNullSafe("relational")
    rules = {
        "unreviewed": ~F.col("review_status").eqNullSafe("reviewed"), "bucket": ~F.coalesce(F.col("bucket").isin(*buckets), F.lit(False)), "subtype_missing": relational & blank("relation_subtype"),
        "subtype_foreign": ~relational & ~blank("relation_subtype"), "text": blank("text"),
    }
    found = rows.select("claim_id", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))).alias("finding")).distinct()
    twice = rows.groupBy("claim_id").count().where("count > 1").select("claim_id", F.lit("duplicated").alias("finding"))
    wrong = rows.agg(F.count("*").alias("n")).where(F.col("n") != size).select(F.lit(None).cast(rows.schema["claim_id"].dataType).alias("claim_id"), F.lit("size").alias("finding"))
    return found.unionByName(twice).unionByName(wrong)
