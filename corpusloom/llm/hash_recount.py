"""How far the sources of a language differ in their words, by exact recount over minimal perfect hashes.

1. The first pass counts for each language in how many of its documents a term occurs; terms of fewer than
   ``LEAST_DOCUMENTS`` documents go. The counts are exact, and summed in tasks before they are shuffled.
2. The kept terms of a language are cut by hash into shards of about ``SHARD_TERMS``. Each shard gets a minimal perfect
   hash (levels of bits; a term that shares its bit with another goes on to the next level; the rank of its bit is its
   slot) and stores its terms in the order of their slots.
3. The shards are broadcast in blocks of a measured size. The second pass looks every distinct term of a slice of text up,
   compares it with the term stored in the slot, so that a term that was not kept is never counted, and adds to one dense
   array of slots a (language, source) group. A task that holds more than ``DENSE_BYTES`` of them hands its counts over
   and begins anew. A vocabulary of several blocks takes one pass a block.
4. The counts of one shard are compared densely, sources by sources, in tiles of about ``TILE_SOURCES`` of them.

All arithmetic is in integers: shares are in parts of 10^9, divided digit group by digit group so that counts up to 9e15
do not overflow.

Defined results: null text, language and source are empty strings; a group without terms, and a language without kept
terms, have their pairs; a source alone in its language has none; repeated rows are documents of their own. Only text, lang
and source are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm import vectext
from corpusloom.llm.storage import cut, join_measured, table

LEAST_DOCUMENTS, TOP_TERMS = 3, 200
#: Terms of a shard, and sources of a tile, about.
SHARD_TERMS, TILE_SOURCES = 1 << 14, 128
#: Bytes of text worked on at a time, of shards in one broadcast block, and of dense counts that a task holds.
SLICE_BYTES, BLOCK_BYTES, DENSE_BYTES = 2 << 20, 32 << 20, 48 << 20
#: Rows of one Arrow batch of counts.
ROWS_AT_ONCE = 1 << 16
#: Bits a term of a level, and levels; terms that are left share all their hashes and are found by their bytes.
ROOM, LEVELS = 2, 48
#: ASCII letters and every byte of a non-ASCII character.
LETTERS = vectext.word_table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of a slice of texts, and the term and the document of each occurrence."""
    words, code, at = vectext.distinct_words(*vectext.utf8(texts), LETTERS)
    return words, code, np.repeat(np.arange(len(at) - 1), np.diff(at))


def term_hashes(words: pa.Array) -> np.ndarray:
    raw, offsets = vectext.utf8(words)
    return vectext.Hasher(raw).spans(offsets[:-1], offsets[1:])


def shard_numbers(hashes: np.ndarray, shards: np.ndarray | int) -> np.ndarray:
    return (vectext.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) % np.asarray(shards).astype(np.uint64)).astype(np.int32)


def _places(hashes: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    return (vectext.mix(hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.asarray(size).astype(np.uint64)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct terms: bits of all levels in a row, and one more bit for each term that is left."""

    def __init__(self, words: pa.Array):
        hashes = term_hashes(words)
        left, levels, self.sizes = np.arange(len(words)), [], []
        place_of = np.zeros(len(words), np.int64)
        base = 0
        while len(left) and len(self.sizes) < LEVELS:
            size = ROOM * len(left)
            at = _places(hashes[left], len(self.sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            fits = alone[at]
            place_of[left[fits]] = base + at[fits]
            levels.append(alone)
            self.sizes.append(size)
            base += size
            left = left[~fits]
        place_of[left] = base + np.arange(len(left))
        self.left = len(left)
        self.bits = np.concatenate((*levels, np.ones(len(left), bool)))
        self.words = words.take(pa.array(np.argsort(place_of)))


def build_shards(vocabulary: DataFrame) -> DataFrame:
    """Rows (lang, shard, n, sizes, left, bits, words): the perfect hash of each shard of the kept terms (lang, term)."""
    size = vocabulary.groupBy("lang").agg(F.ceil(F.count("*") / SHARD_TERMS).cast("int").alias("shards"))
    rows = join_measured(vocabulary, cut(size, "shards-of-languages"), ["lang"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = shard_numbers(term_hashes(batch.column("term")), np.asarray(batch.column("shards")))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("term"), pa.array(shard, pa.int32()), batch.column("shards")], names=["lang", "term", "shard", "shards"])

    def build(group: pa.Table) -> pa.Table:
        words = group.column("term").combine_chunks()
        made = PerfectHash(words)
        row = {"lang": group.column("lang")[0].as_py(), "shard": group.column("shard")[0].as_py(), "shards": group.column("shards")[0].as_py(), "n": len(words)}
        row |= {"sizes": made.sizes, "left": made.left, "bits": np.packbits(made.bits).tobytes(), "words": made.words.to_pylist()}
        return pa.Table.from_pylist([row], schema=_SHARD)

    _SHARD = pa.schema(
        [("lang", pa.string()), ("shard", pa.int32()), ("shards", pa.int32()), ("n", pa.int32()), ("sizes", pa.list_(pa.int32())), ("left", pa.int32()), ("bits", pa.binary()), ("words", pa.list_(pa.string()))]
    )
    numbered = rows.select("lang", "term", "shards").mapInArrow(number, "lang string, term string, shard int, shards int")
    return numbered.groupBy("lang", "shard").applyInArrow(build, "lang string, shard int, shards int, n int, sizes array<int>, left int, bits binary, words array<string>")


class Block:
    """Some shards, opened for look-up: the bits of all of them in a row, whose ranks are the slots of the block."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("lang", "ascending"), ("shard", "ascending")])
        self.langs, self.shard = rows.column("lang").to_pylist(), np.asarray(rows.column("shard"))
        sizes = rows.column("sizes").to_pylist()
        self.left = np.asarray(rows.column("left")).astype(np.int64)
        depth = max(map(len, sizes), default=0)
        self.sizes = np.array([s + [0] * (depth - len(s)) for s in sizes], np.int64).reshape(len(sizes), depth)
        spans = self.sizes.sum(axis=1) + self.left
        self.base = np.concatenate(([0], np.cumsum(spans)))[:-1]
        self.bits = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=int(n)) for b, n in zip(rows.column("bits").to_pylist(), spans)] or [np.zeros(0, np.uint8)])
        self.ranks = np.concatenate(([0], np.cumsum(self.bits, dtype=np.int32)))
        self.words = rows.column("words").combine_chunks().flatten() if rows.num_rows else pa.array([], pa.string())
        self.first = np.concatenate(([0], np.cumsum(np.asarray(rows.column("n")).astype(np.int64))))
        # terms that only their bytes tell apart
        self.by_bytes = {}
        for row in np.flatnonzero(self.left):
            for slot in range(self.first[row + 1] - self.left[row], self.first[row + 1]):
                self.by_bytes[row, self.words[int(slot)].as_py()] = int(slot)
        # a language's rows, by shard: its number of shards, its first slot, and the row of each shard here
        self.of_lang: dict[str, tuple[int, np.ndarray, int, int]] = {}
        for lang, shards in dict(zip(self.langs, rows.column("shards").to_pylist())).items():
            mine = np.array([i for i, x in enumerate(self.langs) if x == lang])
            row_of = np.full(shards, -1)
            row_of[self.shard[mine]] = mine
            self.of_lang[lang] = shards, row_of, int(self.first[mine[0]]), int(self.first[mine[-1] + 1])

    def slots(self, lang: str, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The slot of each term in this block, or -1 where the stored term is another or there is none."""
        shards, row_of, *_ = self.of_lang[lang]
        rows = row_of[shard_numbers(hashes, shards)]
        slots = np.full(len(hashes), -1)
        open_ = np.flatnonzero(rows >= 0)
        base = self.base[rows]
        for level in range(self.sizes.shape[1]):
            size = self.sizes[rows[open_], level]
            open_, size = open_[size > 0], size[size > 0]
            if not len(open_):
                break
            at = base[open_] + _places(hashes[open_], level, size)
            hit = self.bits[at] == 1
            slots[open_[hit]] = self.ranks[at[hit]]
            base[open_] += size
            open_ = open_[~hit]
        found = np.flatnonzero(slots >= 0)
        same = np.asarray(pc.equal(self.words.take(pa.array(slots[found])), words.take(pa.array(found)))) if len(found) else np.zeros(0, bool)
        slots[found[~same]] = -1
        if self.by_bytes:
            for i in np.flatnonzero((slots < 0) & (rows >= 0)):
                slots[i] = self.by_bytes.get((rows[i], words[int(i)].as_py()), -1)
        return slots


def _groups(batch: pa.RecordBatch) -> tuple[list[tuple[str, str]], np.ndarray]:
    """The (lang, source) groups of a slice, and that of each document."""
    langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    both = np.asarray(langs.indices).astype(np.int64) * len(sources.dictionary) + np.asarray(sources.indices)
    codes, group = np.unique(both, return_inverse=True)
    lang, source = langs.dictionary.to_pylist(), sources.dictionary.to_pylist()
    return [(lang[c // len(source)], source[c % len(source)]) for c in codes.tolist()], group


def _pairs(first: np.ndarray, second: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of two codes, the second below size, and how often each occurs."""
    codes, counts = np.unique(first * size + second, return_counts=True)
    return codes // max(1, size), codes % max(1, size), counts


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def vocabulary(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term) of the terms in at least so many documents of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vectext.slices(batches, "text", SLICE_BYTES):
            words, code, doc = terms(batch.column("text"))
            langs = batch.column("lang").dictionary_encode()
            doc, code, _ = _pairs(doc, code, len(words))
            lang, code, counts = _pairs(np.asarray(langs.indices).astype(np.int64)[doc], code, len(words))
            for at in range(0, len(code), ROWS_AT_ONCE):
                part = slice(at, at + ROWS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[part])), words.take(pa.array(code[part])), pa.array(counts[part], pa.int64())], names=["lang", "term", "documents"])

    found = _texts(docs).select("lang", "text").mapInArrow(run, "lang string, term string, documents long")
    return found.groupBy("lang", "term").agg(F.sum("documents").alias("documents")).where(F.col("documents") >= least).select("lang", "term")


def recount(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """(lang, source, shard, slot, n): the occurrences of the kept terms in each group, where there are any."""
    schema = "lang string, source string, shard int, slot int, n long"

    def count(block: Block):
        def handed_over(dense: dict[tuple[str, str], np.ndarray]) -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in dense.items():
                slots = np.flatnonzero(counts)
                row = np.searchsorted(block.first, slots + block.of_lang[lang][2], side="right") - 1
                inner = slots + block.of_lang[lang][2] - block.first[row]
                for at in range(0, len(slots), ROWS_AT_ONCE):
                    part = slice(at, at + ROWS_AT_ONCE)
                    n = len(slots[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(pa.scalar(lang), n), pa.repeat(pa.scalar(source), n), pa.array(block.shard[row[part]], pa.int32()), pa.array(inner[part], pa.int32()), pa.array(counts[slots[part]])],
                        names=["lang", "source", "shard", "slot", "n"],
                    )
            dense.clear()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dense: dict[tuple[str, str], np.ndarray] = {}
            held = 0
            for batch in vectext.slices(batches, "text", SLICE_BYTES):
                words, code, doc = terms(batch.column("text"))
                hashes = term_hashes(words)
                names, group = _groups(batch)
                group, code, counts = _pairs(group[doc], code, len(words))
                for lang in {lang for lang, _ in names} & block.of_lang.keys():
                    in_lang = np.array([name[0] == lang for name in names])[group]
                    mine, of, times = code[in_lang], group[in_lang], counts[in_lang]
                    used, back = np.unique(mine, return_inverse=True)
                    slot = block.slots(lang, words.take(pa.array(used)), hashes[used])[back]
                    of, slot, times = of[slot >= 0], slot[slot >= 0], times[slot >= 0]
                    _, _, first, end = block.of_lang[lang]
                    cuts = np.flatnonzero(np.diff(of, prepend=-1))
                    for a, b in zip(cuts, np.append(cuts[1:], len(of))):
                        name = names[of[a]]
                        if name not in dense:
                            if held and held + 8 * (end - first) > DENSE_BYTES:
                                yield from handed_over(dense)
                                held = 0
                            dense[name] = np.zeros(end - first, np.int64)
                            held += 8 * (end - first)
                        dense[name][slot[a:b] - first] += times[a:b]
            yield from handed_over(dense)

        return _texts(docs).mapInArrow(run, schema)

    size = shards.agg(F.sum(F.octet_length("bits") + F.octet_length(F.array_join("words", "")))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    union = None
    for number in range(blocks):
        part = shards if blocks == 1 else shards.where(F.pmod(F.xxhash64("lang", "shard"), F.lit(blocks)) == number)
        found = count(Block(part.toArrow())).groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n"))
        # written before the next block comes: the driver holds one at a time
        found = cut(found, "recount")
        union = found if union is None else union.unionByName(found)
    return union


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 * counts / total), three digits at a time."""
    out, rest = np.divmod(counts, total)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return 1 + out


def tile_divergence(rows: pa.Table) -> pa.Table:
    """The pairs of two tiles of sources of one shard and, of a tile with itself, the greatest terms of its sources.

    Rows are of a side: 0 the language's sums, 1 and 2 the sources of the tiles, with their counts in the shard, their
    total and the language's kept terms.
    """
    side = np.asarray(rows.column("side"))
    width = max(rows.column("width").to_pylist())
    same = rows.column("a")[0].as_py() == rows.column("b")[0].as_py()
    names = rows.column("source").to_pylist()
    slots, counts = rows.column("slots").combine_chunks(), rows.column("counts").combine_chunks()

    def matrix(which: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        mine = np.flatnonzero(side == which)
        dense = np.zeros((len(mine), width), np.int64)
        for i, row in enumerate(mine.tolist()):
            dense[i, np.asarray(slots[row].values)] = np.asarray(counts[row].values)
        total = np.asarray(rows.column("total"))[mine] + np.asarray(rows.column("terms"))[mine]
        return [names[i] for i in mine], dense, shares(dense + 1, np.maximum(1, total)[:, None])

    left, seen, p = matrix(1)
    right, _, q = (left, seen, p) if same else matrix(2)
    out: list[tuple[str, str, str, int]] = []
    for i, name in enumerate(left):
        first = i + 1 if same else 0
        squares = np.square(p[i] - q[first:])
        there, back = (squares // q[first:]).sum(axis=1), (squares // p[i]).sum(axis=1)
        for other, x, y in zip(right[first:], there.tolist(), back.tolist()):
            out += [(name, "pair", other, x), (other, "pair", name, y)]
    if same and width:
        words = next(w for w in rows.column("words").to_pylist() if w is not None)
        order = np.empty(width, np.int64)
        order[np.argsort(np.array([w.encode("utf-8") for w in words], object))] = np.arange(width)
        _, _, whole = matrix(0)
        for i, name in enumerate(left):
            at = np.flatnonzero((seen[i] > 0) & (p[i] > whole[0]))
            value = np.square(p[i, at] - whole[0, at]) // whole[0, at]
            best = np.lexsort((order[at], -value))[:TOP_TERMS]
            out += [(name, "term", words[at[j]], int(value[j])) for j in best.tolist()]
    lang = rows.column("lang")[0].as_py()
    source, part, item, value = zip(*out) if out else ((), (), (), ())
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far other sources are from each source, and its terms above the language's share."""
    kept = cut(vocabulary(docs, least), "vocabulary")
    shards = cut(build_shards(kept), "perfect-hashes")
    counts = recount(docs, shards)
    groups = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cut(groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")), "groups")
    tiles = cut(groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE_SOURCES).cast("int").alias("tiles"), F.sum("total").alias("lang_total")), "languages")
    known = shards.groupBy("lang").agg(F.sum("n").alias("terms"))
    tiles = cut(tiles.join(known, "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0))), "languages")

    # every group has a row in every shard of its language; a language without kept terms has one shard without terms
    widths = tiles.select("lang", F.lit(0).alias("shard")).join(shards.select("lang", "shard", F.col("n").alias("width")), ["lang", "shard"], "full")
    widths = cut(widths.withColumn("width", F.coalesce("width", F.lit(0))), "widths")
    per_lang = cut(widths.groupBy("lang").agg(F.collect_list(F.struct("shard", "width")).alias("all")), "shards-of-languages")
    packed = lambda rows, *by: rows.groupBy(*by, "shard").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("counts"))
    grid = join_measured(join_measured(groups, tiles, ["lang"]), per_lang, ["lang"]).select("lang", "source", "total", "terms", "tiles", F.inline("all"))
    sources = grid.join(packed(counts, "lang", "source"), ["lang", "source", "shard"], "left").withColumn("tile", F.pmod(F.xxhash64("source"), "tiles").cast("int"))
    empty = {"slots": F.coalesce("slots", F.expr("cast(array() as array<int>)")), "counts": F.coalesce("counts", F.expr("cast(array() as array<bigint>)"))}
    common = ["lang", "shard", "width", "source", "total", "terms", "slots", "counts"]
    placed = sources.withColumns(empty).select(*common, "tile", F.expr("explode(sequence(0, tiles - 1))").alias("other"))
    none = F.lit(None).cast("array<string>").alias("words")
    placed = placed.select(
        *common, F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), F.when(F.col("tile") <= F.col("other"), 1).otherwise(2).alias("side"), none
    )
    whole = packed(counts.groupBy("lang", "shard", "slot").agg(F.sum("n").alias("n")), "lang")
    whole = join_measured(whole.join(shards.select("lang", "shard", F.col("n").alias("width"), "words"), ["lang", "shard"]), tiles, ["lang"])
    whole = whole.select(
        "lang", "shard", "width", F.lit("").alias("source"), F.col("lang_total").alias("total"), "terms", "slots", "counts", F.expr("explode(sequence(0, tiles - 1))").alias("a"), F.col("a").alias("b"), F.lit(0).alias("side"), "words"
    )
    found = placed.unionByName(whole).groupBy("lang", "shard", "a", "b").applyInArrow(tile_divergence, "lang string, source string, part string, item string, value long")
    found = cut(found, "divergence")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
n AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM groups LEFT JOIN c USING (lang, source) GROUP BY ALL),
q AS (
  SELECT lang, term, 1 + 1000000000 * (sum(c) + 1) // (sum(sum(c)) OVER (PARTITION BY lang) + any_value(v)) AS q FROM c JOIN v USING (lang) GROUP BY lang, term
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + 1000000000 * (coalesce(c, 0) + 1) // (n + v) AS p
  FROM groups AS g JOIN kept AS k USING (lang) JOIN v USING (lang) JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), best AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM best) QUALIFY part = 'pair' OR rank <= 200
"""
