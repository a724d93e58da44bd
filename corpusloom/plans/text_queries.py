"""Queries of the text functions (B) and chunkers (C) over ``documents`` and ``pages``, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.operators import chunking
from corpusloom.sources.tables import read_table


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text")))


def whitespace(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(t.clean_whitespace(F.col("text"))).alias("clean_md5"), F.md5(t.normalize_newlines(F.col("text"))).alias("newline_md5"))


WHITESPACE = r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(n, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS clean_md5, md5(n) AS newline_md5
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS n FROM documents)
"""


def noise_lines(spark, sf_dir):
    phrases = ("only", "sur", "von")
    return _docs(spark, sf_dir).select("doc_id", F.md5(t.remove_known_noise(F.col("text"), phrases)).alias("kept_md5"), F.md5(t.remove_known_noise(F.col("text"))).alias("default_md5"))


_NOISE = r"""regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)),
  lambda x: CASE WHEN trim(x, ' ' || chr(9)) = '' THEN '' ELSE x END), lambda x: {keep}), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""


def _noise(phrases) -> str:
    any_ = " OR ".join(f"contains(lower(x), '{p.lower()}')" for p in phrases)
    return _NOISE.format(keep=f"starts_with(trim(x), '```') OR starts_with(trim(x), '#') OR NOT ({any_})")


NOISE_LINES = f"SELECT doc_id, md5({_noise(('only', 'sur', 'von'))}) AS kept_md5, md5({_noise(t.NOISE_PHRASES)}) AS default_md5 FROM documents"


def markdown_plain(spark, sf_dir):
    """On texts to which Markdown signs are given by rule, as the tables hold none."""
    marked = F.concat(F.lit("## "), F.regexp_replace("text", r"\n", "\n- "), F.lit("\n> **"), F.col("source"), F.lit("** [link](http://x) `code`\n\n\n\n1. "), F.col("lang"))
    return _docs(spark, sf_dir, "doc_id", "text", "source", "lang").select("doc_id", F.md5(t.markdown_to_plain_text(marked)).alias("plain_md5"), F.md5(t.clean_markdown_line(F.concat(F.lit("# > - 1. [x] "), "source"))).alias("line_md5"))


MARKDOWN_PLAIN = r"""
WITH m AS (SELECT doc_id, source, '## ' || regexp_replace(text, '\n', chr(10) || '- ', 'g') || chr(10) || '> **' || source || '** [link](http://x) `code`' || repeat(chr(10), 4) || '1. ' || lang AS t FROM documents),
a AS (SELECT doc_id, source, regexp_replace(t, '\[([^\]]+)\]\([^)]+\)', '\1', 'g') AS t FROM m),
b AS (SELECT doc_id, source, regexp_replace(regexp_replace(t, '(?m)^\s{0,3}#{1,6}\s+', '', 'g'), '(?m)^\s*>\s?', '', 'g') AS t FROM a),
c AS (SELECT doc_id, source, regexp_replace(regexp_replace(t, '(?m)^\s*[-*+]\s+', '- ', 'g'), '(?m)^\s*(\d+)\.\s+', '\1. ', 'g') AS t FROM b),
d AS (SELECT doc_id, source, regexp_replace(regexp_replace(t, '\*\*(.*?)\*\*', '\1', 'g'), '__(.*?)__', '\1', 'g') AS t FROM c),
e AS (SELECT doc_id, source, regexp_replace(regexp_replace(t, '(^|[^*])\*([^*].*?)\*([^*]|$)', '\1\2\3', 'g'), '`([^`]+)`', '\1', 'g') AS t FROM d)
SELECT doc_id, md5(regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') || chr(10)) AS plain_md5, md5(source) AS line_md5 FROM e
"""


def line_kinds(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    count = lambda c, name: F.sum(c.cast("long")).alias(name)
    line = F.col("line")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), count(t.is_code(line), "n_code"), count(t.is_noise(line), "n_noise"), count(t.valid_length(line), "n_valid"))


LINE_KINDS = r"""
SELECT doc_id, count(*) AS n_lines,
  CAST(sum(CASE WHEN regexp_matches(trim(line), '^(def |class |import |from |return |SELECT |INSERT |UPDATE |DELETE |CREATE TABLE|console\.log\(|print\(|```|\{|\}|\[|\])') THEN 1 ELSE 0 END) AS BIGINT) AS n_code,
  CAST(sum(CASE WHEN trim(line) = '' OR regexp_matches(trim(line), '^[-=_#*`~\s]+$') OR regexp_matches(trim(line), '^(https?://|www\.)') THEN 1 ELSE 0 END) AS BIGINT) AS n_noise,
  CAST(sum(CASE WHEN length(trim(line)) BETWEEN 8 AND 600 THEN 1 ELSE 0 END) AS BIGINT) AS n_valid
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id
"""


def sentence_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(t.split_sentences(F.col("text"))).alias("n_sentences"), F.size(t.split_claims(F.col("text"))).alias("n_claims"))


_SQUEEZE = r"regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
SENTENCE_COUNTS = rf"""
SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace({_SQUEEZE}, '([.!?]) ([A-ZÁÉÍÓÚÑ¿¡0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '')) AS INT) AS n_sentences,
  CAST(len(list_filter(string_split(regexp_replace({_SQUEEZE}, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS INT) AS n_claims
FROM documents
"""


def text_keys(spark, sf_dir):
    c = F.col("text")
    keys = {"dedup": t.dedup_key, "overlap": t.overlap_key, "retrieval": t.retrieval_key, "diagnosis": t.diagnosis_key}
    return _docs(spark, sf_dir).select("doc_id", *[F.md5(f(c)).alias(f"{name}_md5") for name, f in keys.items()])


TEXT_KEYS = r"""
WITH k AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS low FROM documents)
SELECT doc_id, md5(trim(regexp_replace(strip_accents(low), '[^\p{L}\p{N}_\s]', '', 'g'))) AS dedup_md5,
  md5(regexp_replace(low, '\s+([,.;:!?])', '\1', 'g')) AS overlap_md5, md5(strip_accents(low)) AS retrieval_md5,
  md5(trim(regexp_replace(strip_accents(low), '[^a-z0-9_./@+-]+', ' ', 'g'))) AS diagnosis_md5
FROM k
"""


def tokenize_stats(spark, sf_dir):
    c = F.col("text")
    join = lambda x: F.md5(F.array_join(x, " "))
    rows = t.bind(_docs(spark, sf_dir), words=t.words(c), plain=t.plain_words(c), significant=t.significant_words(c))
    return rows.select(
        "doc_id", F.size("words").alias("n_words"), join("words").alias("words_md5"), join("plain").alias("plain_md5"), F.size("significant").alias("n_significant"),
        F.size(t.diagnosis_tokens(c)).alias("n_diagnosis"), join(t.singular_words(F.col("plain"))).alias("singular_md5"), join(t.normalize_terms(F.col("significant"))).alias("terms_md5"),
    )


_STEM = """CASE WHEN length(x) >= 8 AND regexp_matches(x, '(adas|ados|idos|idas)$') THEN left(x, -4) WHEN length(x) >= 7 AND regexp_matches(x, '(ada|ado|ida|ido)$') THEN left(x, -3)
  WHEN length(x) >= 6 AND regexp_matches(x, '(an|en)$') THEN left(x, -2) WHEN length(x) >= 8 AND regexp_matches(x, '(amos|emos|imos)$') THEN left(x, -4)
  WHEN length(x) >= 6 AND regexp_matches(x, '(ar|er|ir)$') THEN left(x, -2) WHEN length(x) >= 7 AND x LIKE '%es' THEN left(x, -2) WHEN length(x) >= 6 AND x LIKE '%s' THEN left(x, -1)
  WHEN length(x) >= 6 AND regexp_matches(x, '[ae]$') THEN left(x, -1) ELSE x END"""
TOKENIZE_STATS = rf"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS ws, regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}_]+') AS ps FROM documents),
s AS (SELECT *, list_filter(ps, lambda x: length(x) > 3 AND x NOT IN ({', '.join(f"'{x}'" for x in t.STOPWORDS)})) AS sig,
  list_filter(string_split(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9_./@+-]+', ' ', 'g')), ' '), lambda x: length(x) > 2 AND x NOT IN ({', '.join(f"'{x}'" for x in t.DIAGNOSIS_STOPWORDS)})) AS dt FROM w),
st AS (SELECT doc_id, string_agg(v, ' ' ORDER BY p) AS terms FROM (SELECT doc_id, v, min(i) AS p FROM (SELECT doc_id, {_STEM} AS v, i FROM (SELECT doc_id, unnest(sig) AS x, generate_subscripts(sig, 1) AS i FROM s) WHERE x NOT IN ('ademas', 'mediante')) GROUP BY ALL) GROUP BY doc_id)
SELECT s.doc_id, CAST(len(ws) AS INT) AS n_words, md5(array_to_string(ws, ' ')) AS words_md5, md5(array_to_string(ps, ' ')) AS plain_md5, CAST(len(sig) AS INT) AS n_significant,
  CAST(len(list_distinct(dt)) AS INT) AS n_diagnosis,
  md5(array_to_string(list_transform(list_transform(ps, lambda x: regexp_replace(x, '[^a-z0-9_áéíóúñü]+', '', 'g')), lambda x: CASE WHEN length(x) > 5 AND x LIKE '%es' THEN left(x, -2) WHEN length(x) > 4 AND x LIKE '%s' THEN left(x, -1) ELSE x END), ' ')) AS singular_md5,
  md5(coalesce(terms, '')) AS terms_md5
FROM s LEFT JOIN st USING (doc_id)
"""


def small_functions(spark, sf_dir):
    """B26, B27, B29-B34 on values made from the columns."""
    c = F.col
    rows = _docs(spark, sf_dir, "doc_id", "text", "source", "lang")
    ids = F.concat_ws(";", c("source"), F.lit(" "), c("lang"), c("source"))
    return rows.select(
        "doc_id",
        F.array_join(t.distinct_ignoring_case(F.array(c("source"), F.upper("source"), c("lang"), F.lit("  "))), ",").alias("distinct_items"),
        F.md5(t.shorten(c("text"))).alias("short_md5"),
        t.sanitize_filename(F.concat(F.lit("/a b/"), c("source"), F.lit(" ñ.md_"))).alias("file"),
        t.title_from_metadata(F.create_map(F.lit("file_name"), F.lit(""), F.lit("source"), F.concat(F.lit("C:\\x\\"), c("source")))).alias("title"),
        F.array_join(t.id_list(ids), "|").alias("ids"),
        F.array_join(t.id_list_or_literal(F.concat(F.lit("['"), c("source"), F.lit("', \""), c("lang"), F.lit("\"]"))), "|").alias("literal_ids"),
        t.is_fallback_query(c("text"), "The").alias("fallback"),
        t.as_bool(F.when(c("lang") == "en", " Yes ").otherwise(c("lang"))).alias("flag"),
        t.content_sha256(c("text")).alias("sha256"),
    )


SMALL_FUNCTIONS = rf"""
SELECT doc_id, source || ',' || lang AS distinct_items, md5(CASE WHEN length(sq) > 300 THEN left(sq, 297) || '...' ELSE sq END) AS short_md5,
  source || '_.md' AS file, source AS title, source || '|' || lang || '|' || source AS ids, source || '|' || lang AS literal_ids,
  contains(lower(text), 'the') AS fallback, lang = 'en' AS flag, sha256(text) AS sha256
FROM (SELECT *, {_SQUEEZE} AS sq FROM documents)
"""


def chunk_blocks(spark, sf_dir):
    """C2-C4 with lines made into blocks, deduplicated and numbered anew."""
    docs = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("document_id"), F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return chunking.renumber(chunking.build_chunks(docs)).select("document_id", "chunk_id", "chunk_index", "char_count", F.md5("chunk_text").alias("chunk_md5"))


CHUNK_BLOCKS = r"""
WITH RECURSIVE b AS (
  SELECT doc_id, block, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (
    SELECT doc_id, trim(x, ' ' || chr(9) || chr(13)) AS block, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE block <> ''
), f AS (
  SELECT doc_id, k, [block] AS cur, length(block) + 2 AS size, CAST(NULL AS VARCHAR) AS done FROM b WHERE k = 1
  UNION ALL
  SELECT f.doc_id, b.k,
    CASE WHEN f.size + length(block) + 2 > 800 THEN list_append(list_reverse(tail), block) ELSE list_append(cur, block) END,
    CASE WHEN f.size + length(block) + 2 > 800 THEN coalesce(list_sum(list_transform(tail, lambda x: length(x) + 2)), 0) ELSE f.size END + length(block) + 2,
    CASE WHEN f.size + length(block) + 2 > 800 THEN array_to_string(cur, chr(10) || chr(10)) END
  FROM (SELECT *, list_filter(list_reverse(cur), lambda x, i: list_sum(list_transform(list_reverse(cur)[1:i], lambda y: length(y) + 2)) - 2 <= 120) AS tail FROM f) f JOIN b ON b.doc_id = f.doc_id AND b.k = f.k + 1
), ends AS (
  SELECT doc_id, k, done AS chunk FROM f WHERE done IS NOT NULL
  UNION ALL SELECT doc_id, k + 1, array_to_string(cur, chr(10) || chr(10)) FROM f WHERE (doc_id, k) IN (SELECT (doc_id, max(k)) FROM b GROUP BY doc_id)
), first_of AS (SELECT doc_id, chunk, min(k) AS k FROM ends GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM first_of)
SELECT CAST(doc_id AS VARCHAR) AS document_id, format('{}_CH_{:03d}', doc_id, i) AS chunk_id, CAST(i AS INT) AS chunk_index, CAST(length(chunk) AS INT) AS char_count, md5(chunk) AS chunk_md5 FROM n
"""


def chunk_stats(spark, sf_dir):
    """Chunk statistics by source and language."""
    docs = _docs(spark, sf_dir, "doc_id", "text", "source", "lang")
    chunks = docs.select("source", "lang", F.explode(F.split("text", "\n")).alias("chunk_text"))
    return chunking.chunk_statistics(chunks, ["source", "lang"])


CHUNK_STATS = """
SELECT source, lang, count(*) AS chunks, min(length(c)) AS min_chunk_chars, max(length(c)) AS max_chunk_chars, round(avg(length(c)), 6) AS mean_chunk_chars, median(length(c)) AS median_chunk_chars
FROM (SELECT source, lang, unnest(string_split(text, chr(10))) AS c FROM documents) GROUP BY ALL
"""


def sentence_claims(spark, sf_dir):
    """Units of factual types with several sentences are split into claims."""
    units = _docs(spark, sf_dir, "doc_id", "text", "lang").select(F.concat(F.lit("U"), F.col("doc_id").cast("string")).alias("unit_id"), F.when(F.col("lang") == "en", "summary").when(F.col("lang") == "de", "front").otherwise("narration").alias("unit_type"), "text")
    return chunking.expand_claims(units).select("claim_id", "unit_type", F.md5("claim_text").alias("claim_md5"))


SENTENCE_CLAIMS = rf"""
WITH u AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'summary' WHEN 'de' THEN 'front' ELSE 'narration' END AS unit_type, text,
  list_filter(string_split(regexp_replace({_SQUEEZE}, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents),
p AS (SELECT doc_id, unit_type, CASE WHEN unit_type <> 'front' AND len(s) > 1 THEN s ELSE [text] END AS parts FROM u)
SELECT 'U' || doc_id || '_claim_' || i AS claim_id, unit_type, md5(c) AS claim_md5 FROM (SELECT doc_id, unit_type, unnest(parts) AS c, generate_subscripts(parts, 1) AS i FROM p)
"""


def literal_candidates(spark, sf_dir):
    """Claim candidates of lines, without noise and code, first of each normalised text."""
    lines = _docs(spark, sf_dir, "doc_id", "text", "source").select(F.col("source").alias("source_domain"), F.col("doc_id").alias("seq"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    found = chunking.literal_candidates(lines)
    return found.select("seq", "line_no", "sentence_no", "source_domain", F.md5("claim_text").alias("claim_md5"), "normalized_sha256")


LITERAL_CANDIDATES = r"""
WITH l AS (SELECT source AS source_domain, doc_id AS seq, i - 1 AS line_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(line), '^#{1,6}\s+', ''), '^>\s*', ''), '^[-*+]\s+', ''), '^\d+[.)]\s+', '') AS line
  FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
k AS (SELECT * FROM l WHERE trim(line) <> '' AND NOT regexp_matches(line, '^[-=_#*`~\s]+$') AND NOT regexp_matches(line, '^(https?://|www\.)') AND NOT regexp_matches(line, '^(def |class |import |from |return |SELECT |INSERT |UPDATE |DELETE |CREATE TABLE|console\.log\(|print\(|```|\{|\}|\[|\])')),
s AS (SELECT source_domain, seq, line_no, string_split(regexp_replace(regexp_replace(trim(line), '\s+', ' ', 'g'), '([.!?]) ([A-ZÁÉÍÓÚÑ¿¡0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM k),
c AS (SELECT source_domain, seq, line_no, unnest(parts) AS claim, generate_subscripts(parts, 1) - 1 AS sentence_no FROM s),
n AS (SELECT *, trim(regexp_replace(strip_accents(lower(claim)), '[^\p{L}\p{N}_\s]', '', 'g')) AS norm FROM c WHERE length(claim) BETWEEN 8 AND 600),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY seq, line_no, sentence_no) AS rn FROM n WHERE norm <> '')
SELECT seq, CAST(line_no AS INT) AS line_no, CAST(sentence_no AS INT) AS sentence_no, source_domain, md5(claim) AS claim_md5, sha256(norm) AS normalized_sha256 FROM r WHERE rn = 1
"""


def html_markdown(spark, sf_dir):
    """Pages as Markdown of their main element; checked by tests, as its parser is Python's."""
    from corpusloom.sources.html import html_to_markdown

    pages = read_table(spark, sf_dir, "pages")
    return html_to_markdown(pages).select("page_id", "markdown")


def recursive_chunks(spark, sf_dir):
    """C1; checked by tests against a plain version."""
    docs = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page"), "text")
    return chunking.recursive_chunks(docs).select("chunk_id", "document_id", "page", "chunk_index", F.md5("text").alias("chunk_md5"))


QUERIES = {
    "text_whitespace": (whitespace, WHITESPACE), "text_noise_lines": (noise_lines, NOISE_LINES), "text_markdown_plain": (markdown_plain, MARKDOWN_PLAIN), "text_line_kinds": (line_kinds, LINE_KINDS),
    "text_sentence_counts": (sentence_counts, SENTENCE_COUNTS), "text_keys": (text_keys, TEXT_KEYS), "text_tokenize_stats": (tokenize_stats, TOKENIZE_STATS), "text_small_functions": (small_functions, SMALL_FUNCTIONS),
    "chunk_blocks": (chunk_blocks, CHUNK_BLOCKS), "chunk_stats": (chunk_stats, CHUNK_STATS), "sentence_claims": (sentence_claims, SENTENCE_CLAIMS), "literal_candidates": (literal_candidates, LITERAL_CANDIDATES),
    "html_markdown": (html_markdown, None), "chunk_recursive": (recursive_chunks, None),
}
