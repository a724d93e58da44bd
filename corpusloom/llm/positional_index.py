"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: every row holds one segment of about 1 MB of text, with the sorted term
hashes, the posting list of word positions of each term, and where its documents begin. A document lies in one
segment, so a search moves no posting between machines; only the phrases, in blocks of a checked size, are sent to
the segments. A phrase is searched from its rarest term in the segment: its positions, less the term's offset in the
phrase, are the candidates, which are intersected with the offset-adjusted lists of the other terms, rarest first.

Defined results: null and empty texts have no words and no match; an item without words has no window; an item of
fewer words than a window is one window; repeated rows are each reported; repeated item ids count once; an empty
benchmark or corpus gives no match; null item ids are reported as the string ``null``. Columns other than the key
and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import vectext
from corpusloom.llm.storage import cut, table

SEGMENT_BYTES = 1 << 20
#: Bytes of phrase text in one broadcast block; a larger benchmark is searched in several blocks, one after the other.
BLOCK_BYTES = 16 << 20
#: Windows whose terms are looked up at a time.
WINDOWS_AT_ONCE = 1 << 16
WINDOW = 13


def term_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words and the word offsets of the documents."""
    low = vectext.LOWER[raw]
    starts, ends, at = vectext.words(low, offsets, vectext.ALNUM)
    return vectext.Hasher(low).spans(starts, ends), at


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of the index: segment, keys, doc_starts, n_words, terms, term_starts, postings.

    Positions number the words of a segment; one number is left out between documents, so no phrase crosses them.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"segment long, keys array<{kind}>, doc_starts array<long>, n_words array<long>, terms binary, term_starts binary, postings binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in vectext.slices(batches, text, SEGMENT_BYTES):
            hashes, at = term_hashes(*vectext.utf8(batch.column(text)))
            counts = np.diff(at)
            positions = np.arange(len(hashes), dtype=np.uint32) + np.repeat(np.arange(len(counts), dtype=np.uint32), counts)
            order = np.argsort(hashes, kind="stable")
            ranked = hashes[order]
            heads = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
            lists = np.append(heads, len(ranked)).astype(np.uint32)
            wrap = lambda x, kind: pa.array([x], kind)
            keys = batch.column(key)
            yield pa.RecordBatch.from_arrays(
                [
                    wrap(number, pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                    wrap((at[:-1] + np.arange(len(counts))).tolist(), pa.list_(pa.int64())),
                    wrap(counts.tolist(), pa.list_(pa.int64())),
                    wrap(ranked[heads].tobytes(), pa.binary()),
                    wrap(lists.tobytes(), pa.binary()),
                    wrap(positions[order].tobytes(), pa.binary()),
                ],
                names=["segment", "keys", "doc_starts", "n_words", "terms", "term_starts", "postings"],
            )
            number += 1

    return docs.select(key, text).mapInArrow(run, schema)


class Segment:
    """One row of the index, opened for search."""

    def __init__(self, terms: bytes, term_starts: bytes, postings: bytes):
        self.terms = np.frombuffer(terms, np.uint64)
        self.lists = np.frombuffer(term_starts, np.uint32).astype(np.int64)
        self.postings = np.frombuffer(postings, np.uint32).astype(np.int64)
        # (term, position) as one sorted number: one binary search tests any posting list
        self.entries = np.repeat(np.arange(len(self.terms), dtype=np.int64) << 32, np.diff(self.lists)) | self.postings

    def ranks(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each term in this segment, and the length of its list (0: not here)."""
        at = np.searchsorted(self.terms, hashes)
        near = np.minimum(at, max(0, len(self.terms) - 1))
        here = self.terms[near] == hashes if len(self.terms) else np.zeros(len(hashes), bool)
        return near, np.where(here, np.diff(self.lists)[near] if len(self.terms) else 0, 0)

    def lists_of(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the lists of the given terms, and for each position the index of its term in ``ranks``."""
        sizes = self.lists[ranks + 1] - self.lists[ranks]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.lists[ranks] - ends + sizes, sizes)
        return self.postings[at], np.repeat(np.arange(len(ranks)), sizes)

    def exact(self, ranks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of all occurrences of phrases of one length, given as rows of term ranks and list sizes."""
        alive = np.flatnonzero(sizes.min(axis=1) > 0)
        order = np.argsort(sizes[alive], axis=1, kind="stable")
        ranks = ranks[alive]
        rows = np.arange(len(alive))
        start, phrase = self.lists_of(ranks[rows, order[:, 0]])
        start = start - order[phrase, 0]
        kept = start >= 0
        start, phrase = start[kept], phrase[kept]
        for step in range(1, ranks.shape[1]):
            if not len(start):
                break
            offset = order[phrase, step]
            wanted = ranks[phrase, offset] << 32 | (start + offset)
            at = np.minimum(np.searchsorted(self.entries, wanted), len(self.entries) - 1)
            kept = self.entries[at] == wanted
            start, phrase = start[kept], phrase[kept]
        return alive[phrase], start

    def near(self, ranks: np.ndarray, slop: int, doc_starts: np.ndarray) -> list[tuple[int, int]]:
        """(start, end) of the ordered occurrences of one phrase with at most ``slop`` further words in between."""
        first = self.postings[self.lists[ranks[0]] : self.lists[ranks[0] + 1]]
        last = first
        for r in ranks[1:]:
            mine = self.postings[self.lists[r] : self.lists[r + 1]]
            at = np.searchsorted(mine, last, side="right")
            kept = at < len(mine)
            first, last = first[kept], mine[at[kept]]
        kept = (last - first < len(ranks) + slop) & (np.searchsorted(doc_starts, first, "right") == np.searchsorted(doc_starts, last, "right"))
        return list(zip(first[kept].tolist(), (last[kept] + 1).tolist()))


class Phrases:
    """A block of phrases: the terms of its words, and for each length of window where its windows begin and their items."""

    def __init__(self, items: list[str], texts: list[str | None], window: int):
        self.items = items
        raw, offsets = vectext.utf8(pa.array(["" if t is None else t for t in texts], pa.large_string()))
        hashes, at = term_hashes(raw, offsets)
        self.terms, codes = np.unique(hashes, return_inverse=True)
        self.codes = codes.astype(np.int32)
        found: dict[int, list] = {}
        for item, (first, last) in enumerate(zip(at[:-1], at[1:])):
            n = int(last - first)
            size = min(n, window) if window else n
            if n:
                begins = np.arange(first, last - size + 1, dtype=np.int32)
                found.setdefault(size, []).append((begins, np.full(len(begins), item, np.int32)))
        self.groups = {n: tuple(map(np.concatenate, zip(*x))) for n, x in found.items()}

    def windows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, terms of the windows, their items), a bounded number at a time."""
        for n, (begins, owners) in self.groups.items():
            for at in range(0, len(begins), WINDOWS_AT_ONCE):
                yield n, self.codes[begins[at : at + WINDOWS_AT_ONCE, None] + np.arange(n)], owners[at : at + WINDOWS_AT_ONCE]


def phrase_blocks(phrases: DataFrame, item: str, text: str, window: int) -> Iterator[tuple[int, Phrases]]:
    """The number of blocks, by the measured size, and each of them, of at most about BLOCK_BYTES of phrases."""
    rows = phrases.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"), F.col(text).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = -(-size // BLOCK_BYTES) or 1
    for block in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == block)
        got = part.toArrow()
        yield count, Phrases(got.column("i").to_pylist(), got.column("t").to_pylist(), window)


def find_phrases(index: DataFrame, phrases: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """Each document of the index with its matches: key, n_words, spans, items.

    ``spans`` are the word ranges (first, end) in which a window of a phrase occurs, ``items`` the ids of those
    phrases. With ``window`` 0 a phrase is searched whole. With ``slop`` matches are by proximity: the terms in their
    order, with at most so many other words in between.
    """
    kind = index.schema["keys"].dataType.elementType.simpleString()
    schema = f"segment long, ordinal int, key {kind}, n_words long, spans array<struct<first:long,end:long>>, items array<string>"

    def search(block: Phrases):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    segment = Segment(*(batch.column(c)[i].as_py() for c in ("terms", "term_starts", "postings")))
                    begins = np.array(batch.column("doc_starts")[i].as_py(), np.int64)
                    ranks, sizes = segment.ranks(block.terms)
                    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                    for n, codes, owners in block.windows():
                        if slop is None:
                            row, start = segment.exact(ranks[codes], sizes[codes])
                            hits.append((owners[row], start, start + n))
                        else:
                            for row in np.flatnonzero(sizes[codes].min(axis=1) > 0):
                                if found := segment.near(ranks[codes[row]], slop, begins):
                                    start, end = np.array(found).T
                                    hits.append((np.full(len(found), owners[row]), start, end))
                    spans: list[list] = [[] for _ in begins]
                    items: list[set] = [set() for _ in begins]
                    if hits:
                        owner, start, end = (np.concatenate(x) for x in zip(*hits))
                        doc = np.searchsorted(begins, start, side="right") - 1
                        triples = np.unique(np.stack((doc, start - begins[doc], end - begins[doc])), axis=1)
                        for d, a, b in triples.T.tolist():
                            if spans[d] and spans[d][-1]["end"] >= a:
                                spans[d][-1]["end"] = max(b, spans[d][-1]["end"])
                            else:
                                spans[d].append({"first": a, "end": b})
                        for d, o in np.unique(np.stack((doc, owner)), axis=1).T.tolist():
                            items[d].add(block.items[o])
                    keys = batch.column("keys")[i].values
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([batch.column("segment")[i].as_py()] * len(keys), pa.int64()),
                            pa.array(range(len(keys)), pa.int32()),
                            keys,
                            batch.column("n_words")[i].values,
                            pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                            pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                        ],
                        names=["segment", "ordinal", "key", "n_words", "spans", "items"],
                    )

        return index.mapInArrow(run, schema)

    union = None
    for count, block in phrase_blocks(phrases, item, text, window):
        if count == 1:
            return search(block).drop("segment", "ordinal")
        # written before the next block comes: the driver holds one at a time
        found = cut(search(block).where("size(spans) > 0" if union is not None else "true"), "matches")
        union = found if union is None else union.unionByName(found)
    return (
        union.groupBy("segment", "ordinal")
        .agg(F.first("key").alias("key"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        .drop("segment", "ordinal")
    )


def covered(spans: str = "spans"):
    """Number of words in at least one of the sorted spans, which may overlap."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda s, x: F.struct((s.n + F.greatest(F.lit(0), x.end - F.greatest(s.to, x.first))).alias("n"), F.greatest(s.to, x.end).alias("to")),
        lambda s: s.n,
    )


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """For each document: key, n_words, n_hit (words in an occurring window), items, contaminated (5 % hit or more)."""
    index = cut(build_index(docs, key, text), "postings")
    found = find_phrases(index, benchmark, window=window)
    return found.select(F.col("key").alias(key), "n_words", covered().alias("n_hit"), "items").withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, list_slice(w, p, p + n - 1) AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, p, list_slice(w, p, p + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n)
), hits AS (
  SELECT g.doc_id, g.n, g.p, x.item_id FROM grams g JOIN windows x ON g.n = x.n AND g.win = x.win
), words_hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
), item_hits AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN item_hits USING (doc_id)
"""
