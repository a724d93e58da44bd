"""Chunking (C) and the extraction of claim candidates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as t

CHUNK_SIZE, CHUNK_OVERLAP = 900, 150
BLOCK_CHUNK, BLOCK_OVERLAP = 800, 120
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", " ", "")
#: Unit types that are split into sentences.
SPLIT_TYPES = ("summary", "conclusion", "explanation", "narration", "back")


def pack_blocks(text: Column, size: int = BLOCK_CHUNK, overlap: int = BLOCK_OVERLAP) -> Column:
    """Blocks between blank lines, packed greedily; whole last blocks up to ``overlap`` begin the next chunk.

    One fold over the blocks inside Catalyst: state is (finished chunks, open blocks, their size).
    """
    blocks = F.filter(F.transform(F.split(t.strip(text), r"\n\s*\n"), t.strip), lambda b: b != "")
    total = lambda bs: F.aggregate(bs, F.lit(0), lambda n, b: n + F.length(b) + 2)
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.expr("cast(array() as array<string>)").alias("open"), F.lit(0).alias("n"))

    def last_blocks(open_: Column) -> Column:
        taken = F.aggregate(
            F.reverse(open_),
            F.struct(F.expr("cast(array() as array<string>)").alias("b"), F.lit(0).alias("n"), F.lit(True).alias("on")),
            lambda s, b: F.when(s.on & (s.n + F.length(b) <= overlap), F.struct(F.concat(F.array(b), s.b).alias("b"), (s.n + F.length(b) + 2).alias("n"), F.lit(True).alias("on"))).otherwise(
                F.struct(s.b.alias("b"), s.n.alias("n"), F.lit(False).alias("on"))
            ),
        )
        return taken.getField("b")

    def step(s: Column, b: Column) -> Column:
        full = (F.size(s.open) > 0) & (s.n + F.length(b) + 2 > size)
        rest = F.when(full, last_blocks(s.open)).otherwise(s.open)
        done = F.when(full, F.array_append(s.done, F.array_join(s.open, "\n\n"))).otherwise(s.done)
        return F.struct(done.alias("done"), F.array_append(rest, b).alias("open"), (F.when(full, total(rest)).otherwise(s.n) + F.length(b) + 2).alias("n"))

    return F.aggregate(blocks, start, step, lambda s: F.when(F.size(s.open) > 0, F.array_append(s.done, F.array_join(s.open, "\n\n"))).otherwise(s.done))


def build_chunks(docs: DataFrame, size: int = BLOCK_CHUNK, overlap: int = BLOCK_OVERLAP) -> DataFrame:
    """(document_id, chunk_id, chunk_index, char_count, chunk_text) of (document_id, text)."""
    rows = docs.select("document_id", F.posexplode(pack_blocks(F.col("text"), size, overlap)).alias("i", "chunk_text"))
    return rows.select("document_id", F.format_string("%s_CH_%03d", "document_id", F.col("i") + 1).alias("chunk_id"), (F.col("i") + 1).alias("chunk_index"), F.length("chunk_text").alias("char_count"), "chunk_text")


def renumber(chunks: DataFrame) -> DataFrame:
    """C4: the first of equal chunks of a document, numbered anew."""
    first = chunks.groupBy("document_id", "chunk_text").agg(F.min("chunk_index").alias("old"), F.first("char_count").alias("char_count"))
    index = F.row_number().over(Window.partitionBy("document_id").orderBy("old"))
    return first.withColumn("chunk_index", index).select("document_id", F.format_string("%s_CH_%03d", "document_id", "chunk_index").alias("chunk_id"), "chunk_index", "char_count", "chunk_text")


def chunk_statistics(chunks: DataFrame, by: list[str], text: str = "chunk_text") -> DataFrame:
    """Count, least, greatest, mean and exact median of the characters."""
    n = F.length(text)
    return chunks.groupBy(*by).agg(
        F.count("*").alias("chunks"), F.min(n).cast("long").alias("min_chunk_chars"), F.max(n).cast("long").alias("max_chunk_chars"), F.round(F.avg(n), 6).alias("mean_chunk_chars"), F.median(n).alias("median_chunk_chars")
    )


def structural_units(contents: DataFrame) -> DataFrame:
    """(content_id, unit_type, role, position, text) of generated contents with a ``format`` and nested fields.

    ``contents`` has content_id, format, and the columns quiz (questions), flashcards (cards), tldr, video_script
    (scenes), of which that named by ``format`` is not null. Titles and distractors are no units.
    """
    unit = lambda kind, role, c: F.struct(F.lit(kind).alias("unit_type"), F.lit(role).alias("role"), c.alias("text"))
    empty = F.expr("cast(array() as array<struct<unit_type:string,role:string,text:string>>)")
    parts = [
        F.flatten(F.transform("quiz.questions", lambda q: F.array(unit("question", "prompt", q.question), unit("correct_answer", "factual", q.correct_answer), unit("explanation", "factual", q.explanation)))),
        F.flatten(F.transform("flashcards.cards", lambda c: F.array(unit("front", "prompt", c.front), unit("back", "factual", c.back)))),
        F.concat(F.array(unit("summary", "factual", F.col("tldr.summary"))), F.transform("tldr.key_points", lambda p: unit("key_point", "factual", p)), F.array(unit("conclusion", "factual", F.col("tldr.conclusion")))),
        F.transform("video_script.scenes", lambda s: unit("narration", "factual", s.narration)),
    ]
    units = F.concat(*[F.coalesce(p, empty) for p in parts])
    return contents.select("content_id", F.posexplode(units).alias("position", "u")).select("content_id", "u.unit_type", "u.role", "position", "u.text")


def expand_claims(units: DataFrame) -> DataFrame:
    """(unit_id, unit_type, text) to claims; only some types with several sentences are split."""
    sentences = t.split_claims(F.col("text"))
    parts = F.when(F.col("unit_type").isin(*SPLIT_TYPES) & (F.size(sentences) > 1), sentences).otherwise(F.array("text"))
    rows = units.select("unit_id", "unit_type", F.posexplode(parts).alias("i", "claim_text"))
    return rows.select("unit_id", "unit_type", F.concat_ws("_claim_", "unit_id", (F.col("i") + 1).cast("string")).alias("claim_id"), "claim_text")


def literal_candidates(lines: DataFrame) -> DataFrame:
    """Sentences of clean lines (source_domain, seq, line_no, line), first of each normalised text."""
    clean = t.bind(lines, clean=t.clean_markdown_line(F.col("line"))).where(~t.is_noise(F.col("clean")) & ~t.is_code(F.col("clean")))
    rows = clean.select("source_domain", "seq", "line_no", F.posexplode(t.split_sentences(F.col("clean"))).alias("sentence_no", "claim_text"))
    rows = t.bind(rows.where(t.valid_length(F.col("claim_text"))), norm=t.dedup_key(F.col("claim_text"))).where("norm <> ''")
    # the first by an aggregate with map-side combining, not by a window that would hold every copy
    order = F.struct("seq", "line_no", "sentence_no")
    first = rows.groupBy("norm").agg(F.min(order).alias("o"), F.min_by(F.struct("source_domain", "claim_text"), order).alias("c"))
    return first.select("o.seq", "o.line_no", "o.sentence_no", "c.source_domain", "c.claim_text", t.content_sha256(F.col("norm")).alias("normalized_sha256"))


def csv_candidates(rows: DataFrame, columns: list[str], domain: str) -> DataFrame:
    """Sentences of the text columns of a table; here sentences are split before Markdown is cleaned."""
    stacked = rows.select(F.explode(F.array(*[F.struct(F.lit(f"literal_csv:{c}").alias("extraction_type"), F.col(c).alias("v")) for c in columns])).alias("x")).select("x.*")
    found = stacked.select("extraction_type", F.explode(t.split_sentences(F.col("v"))).alias("s")).withColumn("claim_text", t.clean_markdown_line(F.col("s")))
    good = ~t.is_noise(F.col("claim_text")) & ~t.is_code(F.col("claim_text")) & t.valid_length(F.col("claim_text"))
    return found.where(good).select("claim_text", F.lit(domain).alias("source_domain"), "extraction_type")


def split_recursively(text: str, size: int, overlap: int, separators=SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that the text has."""
    here = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(here) + 1 :] if here in separators else ()
    if here:
        parts = text.split(here)
        pieces = [p for p in [parts[0], *[here + x for x in parts[1:]]] if p]
    else:
        pieces = list(text)
    out, small = [], []

    def merged() -> None:
        held, n = [], 0
        for piece in small:
            if held and n + len(piece) > size:
                if joined := "".join(held).strip():
                    out.append(joined)
                while held and (n > overlap or n + len(piece) > size):
                    n -= len(held.pop(0))
            held.append(piece)
            n += len(piece)
        if joined := "".join(held).strip():
            out.append(joined)
        small.clear()

    for piece in pieces:
        if len(piece) < size:
            small.append(piece)
        else:
            merged()
            out += split_recursively(piece, size, overlap, finer) if finer else [piece]
    merged()
    return out


def recursive_chunks(pages: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks of (document_id, page, text); the index begins anew on every page."""
    if overlap >= size:
        raise ValueError("overlap must be less than the chunk size")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, p, i, chunk) for d, p, text in frame.itertuples(index=False) for i, chunk in enumerate(split_recursively(text or "", size, overlap))]
            yield pd.DataFrame(rows, columns=["document_id", "page", "chunk_index", "text"])

    made = pages.select("document_id", "page", "text").mapInPandas(run, "document_id string, page int, chunk_index int, text string")
    return made.select(F.concat_ws("_", "document_id", F.col("page").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "document_id", "page", "chunk_index", "text")


def manifest_chunks(files: DataFrame, manifest: DataFrame, fmt: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks of the files that a manifest (document_id, category, <fmt>_file) names for a format, with its metadata.

    files: (path, page, text), read by the sources. The join is on the path, so only named files are cleaned and
    chunked; see ``manifest_gaps`` for those that are not there.
    """
    named = manifest.select("document_id", "category", F.col(f"{fmt}_file").alias("path"))
    pages = files.join(named, "path").select("document_id", "page", t.clean_text(F.col("text")).alias("text"))
    about = manifest.select("document_id", "category", F.lit(fmt).alias("controlled_format"))
    return recursive_chunks(pages, size, overlap).join(about, "document_id")


def manifest_gaps(files: DataFrame, manifest: DataFrame, fmt: str) -> DataFrame:
    """(document_id, path) of the manifest for which there is no file; must be empty before a build."""
    named = manifest.select("document_id", F.col(f"{fmt}_file").alias("path"))
    return named.join(files.select("path").distinct(), "path", "left_anti").select("document_id", "path")
