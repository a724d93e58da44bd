"""Conversations without quotations, linked to the messages they quote and put in reply order.

Only DataFrame and SQL functions are used. A line's quote level is the number of ``>`` signs before its text. Runs of
lines of one level that are not blank are passages; their text, lower-cased and with single spaces, is hashed, as is
each of their lines. The original of a hash is the first message of the conversation that holds it unquoted, so every
quoted passage joins one message at most, however many repeat it. A message replies to the original that covers most
of its passages of the least linked level (the later one of equals); threads follow replies up to their first message
by doubling steps.

Defined results: a null text is empty; a text of quotes only leaves an empty one; the line before a quotation that
announces it (``... wrote:``) goes with it; a passage without an earlier original is removed but not linked; messages
without a conversation id are not linked; repeated rows are kept, each with the same link, one after the other; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.storage import cut, discard, table

#: Line ends, quote marks, and the line that announces a quotation in English, French, German, Spanish.
LINE_END = r"\r\n|\n|\r"
QUOTE_MARK = r"^((?:[ \t]*>)*)"
ANNOUNCES = r"^.*(?:wrote|a écrit|schrieb|escribió)[ \t]*:$"

#: One fold over the lines (the blank line at the end closes the last passage), with what is kept of level 0.
PASSAGES = r"""
aggregate(lines, named_struct('out', cast(array() as array<struct<level:int,text:string>>), 'level', -1, 'text', ''),
  (s, x) -> CASE
    WHEN x.text <> '' AND x.level = s.level THEN named_struct('out', s.out, 'level', s.level, 'text', concat(s.text, '\n', x.text))
    ELSE named_struct(
      'out', CASE WHEN s.level >= 0 THEN concat(s.out, array(named_struct('level', s.level, 'text', s.text))) ELSE s.out END,
      'level', CASE WHEN x.text = '' THEN -1 ELSE x.level END, 'text', x.text) END,
  s -> s.out)
"""


def _normal(text: str) -> str:
    return f"sha2(trim(regexp_replace(lower({text}), '\\\\s+', ' ')), 256)"


def parse_quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, passages): the text without quotations, and all passages with their levels."""
    raw = F.split(F.coalesce(F.col("text"), F.lit("")), LINE_END)
    level = lambda line: F.length(F.regexp_replace(F.regexp_extract(line, QUOTE_MARK, 1), "[^>]", "")).cast("int")
    line = lambda x: F.struct(level(x).alias("level"), F.trim(F.regexp_replace(x, QUOTE_MARK, "")).alias("text"))
    rows = messages.select("conv_id", "turn", "role", F.transform(raw, line).alias("lines"), raw.alias("raw"))
    followed = F.expr("transform(lines, (x, i) -> named_struct('level', x.level, 'text', x.text, 'raw', raw[i], 'next', coalesce(get(lines, i + 1).level, 0)))")
    rows = rows.select("conv_id", "turn", "role", followed.alias("lines"))
    rows = rows.withColumn("lines", F.expr(f"filter(lines, x -> NOT (x.level = 0 AND x.next > 0 AND x.text rlike r'{ANNOUNCES}'))"))
    own = "trim(regexp_replace(array_join(transform(filter(lines, x -> x.level = 0), x -> x.raw), '\\n'), '^\\\\s+|\\\\s+$', ''))"
    rows = rows.withColumn("own", F.expr(own))
    closed = F.concat(F.expr("transform(lines, x -> named_struct('level', x.level, 'text', x.text))"), F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("text"))))
    return rows.withColumn("lines", closed).select("conv_id", "turn", "role", F.col("own").alias("text"), F.expr(PASSAGES).alias("passages"))


def _units(parsed: DataFrame, quoted: bool) -> DataFrame:
    """(conv_id, turn, level, hash, chars) of the passages, and of their lines where there are several."""
    kept = F.filter("passages", lambda p: (p.level > 0) if quoted else (p.level == 0))
    passages = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(kept).alias("p"))
    units = passages.select("conv_id", "turn", "p.level", F.explode(F.array_distinct(F.concat(F.array("p.text"), F.split("p.text", "\n")))).alias("unit"))
    return units.select("conv_id", "turn", "level", F.expr(_normal("unit")).alias("hash"), F.length("unit").alias("chars"))


def link_quotes(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_linked) of the messages that quote an earlier one."""
    originals = _units(parsed, False).groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    found = _units(parsed, True).join(originals, ["conv_id", "hash"]).where("original < turn")
    covered = found.groupBy("conv_id", "turn", "level", "original").agg(F.sum("chars").alias("chars"), F.countDistinct("hash").alias("linked"))
    best = covered.groupBy("conv_id", "turn", "level").agg(F.max(F.struct("chars", "original")).alias("b"), F.sum("linked").alias("linked"))
    return best.groupBy("conv_id", "turn").agg(F.min_by("b.original", "level").alias("reply_to"), F.sum("linked").alias("n_linked"))


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_linked, thread, depth): the first message of each reply's thread, and the steps to it."""
    links = cut(links.withColumn("thread", F.col("reply_to")).withColumn("depth", F.lit(1).cast("long")), "replies")
    before = None
    while True:
        above = links.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        if links.join(above, ["conv_id", "thread"], "left_semi").isEmpty():
            return links
        joined = links.join(above, ["conv_id", "thread"], "left")
        before, links = links, cut(joined.select("conv_id", "turn", "reply_to", "n_linked", F.coalesce("next", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "replies")
        discard(before)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows and their ``position`` in the order within their group; a group may lie in many tasks.

    Rows are dealt in ranges of the whole order, numbered in each range, and the rows of a group in earlier ranges are
    added. A group lies in neighbouring ranges, so the table of those in several ranges has two rows a range at most.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows.repartitionByRange(ranges, group, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    rows = rows.withColumn("__place", F.row_number().over(Window.partitionBy(group, "__range").orderBy(*order)).cast("long"))
    counts = rows.groupBy(group, "__range").agg(F.count("*").alias("__rows"))
    many = counts.groupBy(group).agg(F.collect_list(F.struct("__range", "__rows")).alias("__all")).where("size(__all) > 1")
    before = many.select(F.col(group).alias("__group"), F.explode("__all").alias("__own"), "__all").select(
        "__group", F.col("__own.__range").alias("__of"), F.expr("aggregate(filter(__all, x -> x.__range < __own.__range), 0L, (s, x) -> s + x.__rows)").alias("__before")
    )
    joined = rows.join(F.broadcast(before), F.col(group).eqNullSafe(F.col("__group")) & (F.col("__range") == F.col("__of")), "left")
    return joined.withColumn("position", F.col("__place") + F.coalesce("__before", F.lit(0))).drop("__range", "__place", "__group", "__of", "__before")


def reply_order(messages: DataFrame) -> DataFrame:
    """All messages without quotations: conv_id, turn, role, text, n_quotes, n_linked, reply_to, thread, depth, position."""
    parsed = cut(parse_quotes(messages), "parsed")
    found = threads(link_quotes(parsed))
    rows = parsed.select("conv_id", "turn", "role", "text", F.expr("size(filter(passages, p -> p.level > 0))").cast("long").alias("n_quotes"))
    rows = rows.join(found, ["conv_id", "turn"], "left")
    rows = rows.select(
        "conv_id", "turn", "role", "text", "n_quotes", F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), "reply_to",
        F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"),
    )
    return numbered(rows, "conv_id", ["thread", "turn", "role", "text"])


def op3_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(table(spark, sf_dir, "conversations"))


OP3_SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, string_split_regex(coalesce(text, ''), '\r\n|\n|\r') AS raw FROM conversations),
l AS (SELECT rid, conv_id, turn, role, unnest(raw) AS raw, generate_subscripts(raw, 1) AS i FROM m),
l2 AS (SELECT *, length(regexp_replace(regexp_extract(raw, '^((?:[ \t]*>)*)', 1), '[^>]', '', 'g')) AS level, trim(regexp_replace(raw, '^((?:[ \t]*>)*)', ''), ' ') AS line FROM l),
l3 AS (SELECT *, coalesce(lead(level) OVER (PARTITION BY rid ORDER BY i), 0) AS nxt FROM l2),
k AS (SELECT * FROM l3 WHERE NOT (level = 0 AND nxt > 0 AND regexp_matches(line, '^.*(?:wrote|a écrit|schrieb|escribió)[ \t]*:$'))),
g AS (SELECT *, CASE WHEN line = '' OR lag(line) OVER w IS NULL OR lag(line) OVER w = '' OR lag(level) OVER w <> level THEN 1 ELSE 0 END AS fresh FROM k WINDOW w AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run FROM g),
p AS (SELECT rid, conv_id, turn, run, level, string_agg(line, chr(10) ORDER BY i) AS text FROM r WHERE line <> '' GROUP BY ALL),
u AS (SELECT DISTINCT rid, conv_id, turn, run, level, unit FROM (SELECT *, unnest(list_append(string_split(text, chr(10)), text)) AS unit FROM p) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
h AS (SELECT conv_id, turn, level, sha256(trim(regexp_replace(lower(unit), '\s+', ' ', 'g'), ' ')) AS hash, length(unit) AS chars FROM u),
o AS (SELECT conv_id, hash, min(turn) AS original FROM h WHERE level = 0 GROUP BY ALL),
c AS (SELECT h.conv_id, h.turn, level, original, sum(chars) AS chars, count(DISTINCT hash) AS linked FROM h JOIN o USING (conv_id, hash) WHERE level > 0 AND original < h.turn GROUP BY ALL),
b AS (SELECT conv_id, turn, level, max(struct_pack(chars := chars, original := original)) AS best, sum(linked) AS linked FROM c GROUP BY ALL),
links AS (SELECT conv_id, turn, min_by(best.original, level) AS reply_to, sum(linked) AS n_linked FROM b GROUP BY ALL),
up AS (
  SELECT conv_id, turn, reply_to AS thread, 1 AS depth FROM links
  UNION ALL SELECT up.conv_id, up.turn, links.reply_to, up.depth + 1 FROM up JOIN links ON up.conv_id = links.conv_id AND up.thread = links.turn
),
top AS (SELECT conv_id, turn, min_by(thread, -depth) AS thread, max(depth) AS depth FROM up GROUP BY ALL),
t AS (SELECT m.rid, m.conv_id, m.turn, m.role, trim(regexp_replace(coalesce((SELECT string_agg(raw, chr(10) ORDER BY i) FROM k WHERE k.rid = m.rid AND level = 0), ''), '^\s+|\s+$', '', 'g'), ' ') AS text,
  (SELECT count(*) FROM p WHERE p.rid = m.rid AND level > 0) AS n_quotes FROM m)
SELECT t.conv_id, t.turn, t.role, t.text, n_quotes, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, reply_to, coalesce(thread, t.turn) AS thread, CAST(coalesce(depth, 0) AS BIGINT) AS depth,
  row_number() OVER (PARTITION BY t.conv_id ORDER BY coalesce(thread, t.turn) NULLS FIRST, t.turn NULLS FIRST, t.role NULLS FIRST, t.text) AS position
FROM t LEFT JOIN links USING (conv_id, turn) LEFT JOIN top USING (conv_id, turn)
"""
