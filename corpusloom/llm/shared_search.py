"""Ranked lexical search for many queries at once, which share their common parts.

1. The items of a group are mined for shared sets of terms: first the terms that occur in the same items throughout, then,
   greedily, the pair of sets that most items have in common. Each set is a node that sums its parts, a set may be part
   of several larger ones, and what is left of an item is the sum of its nodes: together a graph without cycles. The k-th
   occurrence of a term in an item is an element of its own, so repeats are shared like terms.
2. One pass over the documents writes the postings of the items' terms, a slice of documents a row, and the statistics of
   the corpus.
3. A second pass, over the postings, fills the accumulators of the terms for some documents at a time, then those of the
   nodes, every one once, level by level, and last those of the items. A task hands over the documents that can be among
   the best of an item: those that reach the k-th best score it has seen.

Items come in blocks of a measured size, and the graphs of a block in groups of about ``GROUP_BYTES`` of text; a larger
set of items takes one run of 2 and 3 a block.

Scores are in integers, and sums of parts in any order are equal. Documents of equal scores are ordered by their key, nulls
last. Defined results: null and empty texts have no terms; a document without terms has no score and counts in no
statistic; an item without terms, or of terms that no document has, has no rows; repeated items count once, and items that
share an id but not the text are ranked apart; repeated documents are each ranked; without documents there are no rows.
Only the keys and texts are read.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm import vectext
from corpusloom.llm.storage import cut, table

BEST = 10
#: Bytes of item text that are mined together, and whose graphs are broadcast together.
GROUP_BYTES, BLOCK_BYTES = 64 << 10, 1 << 20
#: Bytes of text of a slice, and of the accumulators of the documents worked on at a time.
SLICE_BYTES, HELD_BYTES = 2 << 20, 48 << 20
#: Nodes of an item, in the order of their numbers of items, among which pairs are sought. More shared sets, more mining.
NEIGHBOURS = 128
#: Saturation of repeated terms and weight of the length, as in the definition of the score.
MILLION_PARTS, LENGTH_PERCENT = 1_000_000_000, 75


def _bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


class Sharing:
    """Nodes of the sums that items share: the first are the terms, the others the sums of earlier ones."""

    def __init__(self, items: list[list[int]], terms: int):
        """items: the terms of each item, repeats included, as numbers below ``terms``."""
        self.terms, self.parts = terms, []
        holders: dict[tuple[int, int], int] = defaultdict(int)
        for i, item in enumerate(items):
            seen: dict[int, int] = defaultdict(int)
            for term in item:
                seen[term] += 1
                holders[term, seen[term]] |= 1 << i
        together: dict[int, list[int]] = defaultdict(list)
        for (term, _), mask in holders.items():
            together[mask].append(term)
        # (node, items that have it), of which one node can occur several times
        self.held: list[list] = []
        for mask, found in together.items():
            if len(found) > 1 and mask.bit_count() > 1:
                found = [self._sum(found)]
            self.held += [[node, mask] for node in found]
        self._share_pairs(len(items))
        self.items: list[list[int]] = [[] for _ in items]
        for node, mask in self.held:
            for i in _bits(mask):
                self.items[i].append(node)

    def _sum(self, parts: list[int]) -> int:
        self.parts.append(parts)
        return self.terms + len(self.parts) - 1

    def _share_pairs(self, items: int) -> None:
        held = self.held
        of_item: list[list[int]] = [[] for _ in range(items)]
        shared = [place for place, (_, mask) in enumerate(held) if mask.bit_count() > 1]
        for place in sorted(shared, key=lambda p: -held[p][1].bit_count()):
            for i in _bits(held[place][1]):
                of_item[i].append(place)
        near: dict[int, set[int]] = defaultdict(set)
        for places in of_item:
            for at in range(0, len(places), NEIGHBOURS):
                window = places[at : at + NEIGHBOURS]
                for place in window:
                    near[place].update(window)
        heap = [(-n, a, b) for a, others in near.items() for b in others if a < b and (n := (held[a][1] & held[b][1]).bit_count()) > 1]
        heapq.heapify(heap)
        while heap:
            least, a, b = heapq.heappop(heap)
            both = held[a][1] & held[b][1]
            if (n := both.bit_count()) < 2:
                continue
            if n < -least:  # some of those items have meanwhile been given another sum
                heapq.heappush(heap, (-n, a, b))
                continue
            new = len(held)
            held.append([self._sum([held[a][0], held[b][0]]), both])
            held[a][1] &= ~both
            held[b][1] &= ~both
            for other in (near[a] & near[b]) - {a, b}:
                if (n := (held[other][1] & both).bit_count()) > 1:
                    near[new].add(other)
                    near[other].add(new)
                    heapq.heappush(heap, (-n, other, new))

    def levels(self) -> list[int]:
        """For each sum, one more than the greatest level of its parts; terms have 0."""
        level = [0] * self.terms
        for parts in self.parts:
            level.append(1 + max(level[p] for p in parts))
        return level[self.terms :]

    def additions(self) -> tuple[int, int]:
        """Additions that the sums and items take, and that the items would take without sums."""
        flat = [1] * self.terms
        for parts in self.parts:
            flat.append(sum(flat[p] for p in parts))
        shared = sum(len(p) - 1 for p in self.parts) + sum(max(0, len(i) - 1) for i in self.items)
        return shared, sum(max(0, sum(flat[n] for n in i) - 1) for i in self.items)


_GRAPH = "block int, items array<{kind}>, texts array<long>, terms array<string>, parts array<array<int>>, levels array<int>, sums array<array<int>>"


def graphs(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """The graph of each group of items: block, items, texts (a hash of the text), terms, parts and levels of the sums, nodes of the items."""
    rows = items.select(F.col(item).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, blocks = -(-size // GROUP_BYTES) or 1, -(-size // BLOCK_BYTES) or 1
    kind = items.schema[item].dataType.simpleString()
    numbered = rows.withColumn("hash", F.xxhash64("text")).withColumn("group", F.pmod(F.xxhash64("item", "hash"), F.lit(groups)).cast("int"))

    def mine(group: pa.Table) -> pa.Table:
        words, code, at = vectext.distinct_words(*vectext.utf8(group.column("text").combine_chunks()), vectext.ALNUM)
        sharing = Sharing([code[a:b].tolist() for a, b in zip(at[:-1], at[1:])], len(words))
        block = group.column("group")[0].as_py() % blocks
        columns = [[block], [group.column("item").to_pylist()], [group.column("hash").to_pylist()], [words.to_pylist()], [sharing.parts], [sharing.levels()], [sharing.items]]
        lists = pa.list_(pa.list_(pa.int32()))
        kinds = [pa.int32(), pa.list_(group.schema.field("item").type), pa.list_(pa.int64()), pa.list_(pa.string()), lists, pa.list_(pa.int32()), lists]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "items", "texts", "terms", "parts", "levels", "sums"])

    return numbered.groupBy("group").applyInArrow(mine, _GRAPH.format(kind=kind))


class Plan:
    """The graphs of a block as one: numbers of terms first, then sums by level."""

    def __init__(self, rows: pa.Table):
        self.items = pa.concat_arrays([c.values for c in rows.column("items").combine_chunks()]) if rows.num_rows else None
        self.texts = [t for r in rows.column("texts").to_pylist() for t in r]
        names = rows.column("terms").to_pylist()
        self.terms = sorted({t for r in names for t in r})
        number = {t: i for i, t in enumerate(self.terms)}
        levels = rows.column("levels").to_pylist()
        places = sorted((level, row, i) for row, of in enumerate(levels) for i, level in enumerate(of))
        at = {(row, i): len(self.terms) + n for n, (_, row, i) in enumerate(places)}
        node = lambda row, n: number[names[row][n]] if n < len(names[row]) else at[row, n - len(names[row])]
        parts = rows.column("parts").to_pylist()
        self.nodes = len(self.terms) + len(places)
        #: Sums of one level: the first of them, the nodes they add up and where those of each begin.
        self.steps = []
        for level in sorted({p[0] for p in places}):
            mine = [p for p in places if p[0] == level]
            self.steps.append((at[mine[0][1:]], *_flat([[node(row, n) for n in parts[row][i]] for _, row, i in mine])))
        sums = [[node(row, n) for n in item] for row, of in enumerate(rows.column("sums").to_pylist()) for item in of]
        self.searched = [i for i, item in enumerate(sums) if item]
        self.results = _flat([sums[i] for i in self.searched])

    def scores(self, leaves: np.ndarray) -> np.ndarray:
        """Score of each searched item (row) and document (column), of the accumulators of all nodes, those of the terms filled."""
        for first, nodes, begins in self.steps:
            leaves[first : first + len(begins)] = np.add.reduceat(leaves[nodes], begins, axis=0)
        nodes, begins = self.results
        return np.add.reduceat(leaves[nodes], begins, axis=0)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.array([n for x in lists for n in x], np.int64), np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(np.int64)


def postings(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings of the given terms, a slice of documents a row, and a row a task of its documents, their terms and df.

    Rows are keys, lengths, doc, term, tf (of a slice, as arrays in binary form) or documents, total, df (the last ones).
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["keys", "lengths", "doc", "term", "tf", "documents", "total", "df"]

    def row(kinds: pa.DataType, *values) -> pa.RecordBatch:
        types = [pa.list_(kinds), *[pa.binary()] * 4, pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array([v], t) for v, t in zip(values, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(terms, pa.string())
        df, documents, total, kinds = np.zeros(len(terms), np.int64), 0, 0, None
        for batch in vectext.slices(batches, text, SLICE_BYTES):
            kinds = batch.column(key).type
            words, code, at = vectext.distinct_words(*vectext.utf8(batch.column(text)), vectext.ALNUM)
            lengths = np.diff(at)
            documents += int((lengths > 0).sum())
            total += int(lengths.sum())
            number = np.asarray(pc.fill_null(pc.index_in(words, value_set=wanted), -1)).astype(np.int64)[code]
            doc = np.repeat(np.arange(len(lengths)), lengths)[number >= 0]
            pairs, tf = np.unique(doc * max(1, len(terms)) + number[number >= 0], return_counts=True)
            doc, term = pairs // max(1, len(terms)), pairs % max(1, len(terms))
            df += np.bincount(term, minlength=len(terms))
            held, doc = np.unique(doc, return_inverse=True)
            if len(held):
                keys = batch.column(key).take(pa.array(held))
                keys = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
                yield row(kinds, keys, *(x.astype(t).tobytes() for x, t in ((lengths[held], np.int64), (doc, np.int32), (term, np.int32), (tf, np.int64))), None, None, None)
        if documents:
            yield row(kinds, None, None, None, None, None, documents, total, df.tolist())

    schema = f"keys array<{kind}>, lengths binary, doc binary, term binary, tf binary, documents long, total long, df array<long>"
    return docs.select(key, text).mapInArrow(run, schema)


def _search(index: DataFrame, plan: Plan, best: int, item: str, key: str) -> DataFrame:
    """(item, text, key, score) of the documents that can be among the best of each item of the plan."""
    told = index.where("df IS NOT NULL")
    documents, total = told.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    df = {r["pos"]: r["n"] for r in told.select(F.posexplode("df")).groupBy("pos").agg(F.sum("col").alias("n")).toLocalIterator()}
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(plan.terms))], np.int64)
    at_once = max(1, HELD_BYTES // (8 * max(1, plan.nodes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.ones(len(plan.searched), np.int64)
        searched = np.array(plan.searched, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                keys = batch.column("keys")[i].values
                lengths, tf = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("lengths", "tf"))
                doc, term = (np.frombuffer(batch.column(c)[i].as_py(), np.int32) for c in ("doc", "term"))
                place = np.empty(len(keys), np.int64)
                place[np.asarray(pc.sort_indices(keys))] = np.arange(len(keys))
                # in integers without a bound, as length times documents can exceed 64 bits
                norm = np.array([100 - LENGTH_PERCENT + LENGTH_PERCENT * n * documents // total for n in lengths.tolist()], np.int64)
                gain = weights[term] * (MILLION_PARTS * tf // (1000 * tf + 8 * norm[doc]))
                for first in range(0, len(keys), at_once):
                    last = min(len(keys), first + at_once)
                    part = slice(*np.searchsorted(doc, [first, last]))
                    held = np.zeros((plan.nodes, last - first), np.int64)
                    held[term[part], doc[part] - first] = gain[part]
                    scores = plan.scores(held)
                    if scores.shape[1] >= best:
                        least = np.maximum(least, np.partition(scores, -best, axis=1)[:, -best])
                    row, col = np.nonzero(scores >= least[:, None])
                    value = scores[row, col]
                    order = np.lexsort((place[first + col], -value, row))
                    row, col, value = row[order], col[order], value[order]
                    begins = np.searchsorted(row, np.arange(len(searched)))
                    kept = np.arange(len(row)) - begins[row] < best
                    row, col, value = row[kept], col[kept], value[kept]
                    named = pa.array(searched[row])
                    yield pa.RecordBatch.from_arrays(
                        [plan.items.take(named), pa.array([plan.texts[n] for n in searched[row].tolist()], pa.int64()), keys.take(pa.array(first + col)), pa.array(value)], names=["__item", "__text", "__key", "score"]
                    )

    kind = index.schema["keys"].dataType.elementType.simpleString()
    rows = index.where("df IS NULL").select("keys", "lengths", "doc", "term", "tf")
    return rows.mapInArrow(run, f"__item {item}, __text long, __key {kind}, score long")


def rank(docs: DataFrame, items: DataFrame, best: int = BEST, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, rank, key, score) of the ``best`` documents of each item."""
    found = cut(graphs(items, item, text), "query-graphs")
    kind = items.schema[item].dataType.simpleString()
    union = None
    for block in [r["block"] for r in found.select("block").distinct().toLocalIterator()]:
        plan = Plan(found.where(F.col("block") == block).toArrow())
        index = cut(postings(docs, plan.terms, key, text), "query-postings")
        rows = cut(_search(index, plan, best, kind, key), "query-candidates")
        union = rows if union is None else union.unionByName(rows)
    if union is None:
        key_kind = docs.schema[key].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"`{item}` {kind}, rank int, `{key}` {key_kind}, score long")
    order = Window.partitionBy("__item", "__text").orderBy(F.desc("score"), F.asc_nulls_last("__key"))
    ranked = union.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select(F.col("__item").alias(item), "rank", F.col("__key").alias(key), "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, term, count(*) AS k FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL
), sizes AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, sizes WHERE term IN (SELECT term FROM i) GROUP BY term),
m AS (SELECT r, doc_id, 100 - 75 + (75 * len(w) * n) // l AS m FROM d, sizes WHERE len(w) > 0),
s AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM tf JOIN w USING (term) JOIN i USING (term) JOIN m USING (r) GROUP BY item_id, r
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""
