"""Exact similarity join of documents in the Jaccard metric space of their word shingles.

The Jaccard distance d is a metric, and two documents link when d <= r (0.2 for a similarity of 0.8).

1. Documents with equal shingle sets are one point of the space; copies are never expanded into pairs.
2. Every point lies in the regions of a few shingles: of its |x| - ceil(0.8 |x|) + 1 first ones in an order that all
   points share. Linked points share a region, because two sets that agree in 80 % cannot miss each other in so many
   first shingles. Shingles that many documents share come last in the order, so regions stay small.
3. A region's pivots are its points of least hash. Distances of all other points to the pivots are computed in a
   contracted space: a point's profile counts its shingles in about |x| buckets, and the Jaccard distance D of two
   profiles as multisets is a metric as well and never above d. A pair with D > r cannot link. Every point is tested
   exactly, on the texts, against its nearest pivot, whose Voronoi cell it is in; pairs that are still apart follow.
4. Points that links join already need no further test. Pivot regions take the place of shingle regions: points that
   met in a shingle region meet in the region of its first pivot p. In a small region all pairs in different
   components are compared by D, unless sizes or the triangle inequality through p tell them apart.
5. A large region is joined recursively, in the space of differences from p. With r shingles of p that x misses and a
   ones that p misses, let g = (1 - c) r + c a and c = 0.8 / 1.8. Then x links to p exactly if g(x) <= (1 - 2c) |p|,
   and x and y link exactly if their differences from p share g(x) + g(y) - (1 - 2c) |p| shingles. So a point apart
   from p links only to points that share many of its differences, and all of a large group of loose copies falls
   apart into regions of few first differences, which get pivots of their own, and so on. No pair is left out, so the
   components are exact.

No group of points is ever held in one place: regions are read as sorted streams with the pivots of one region in
memory, and a large region that is left after the last level is compared in blocks of points, two at a time.

The result is the exact components only. Pairs whose points are already joined are skipped, so neither the links nor
the number of links of a document can be had from it.

Defined results: null and empty texts, and texts without words, have no shingles and no link, and are a component of
their own; a text of fewer than five words is one shingle of all its words; repeated rows are copies of one another;
a row without an id is linked as a copy only, and gives a component no name; an empty table gives an empty result. Columns
other than the key and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import vectext
from corpusloom.llm.components import connected_components
from corpusloom.llm.storage import cut, discard, table

SHINGLE_WORDS = 5
PERCENT = 80
#: Pivots of a region in one round.
PIVOTS = 4
#: Shingles that may be moved to the end of the common order; more would only make regions larger, never wrong.
FREQUENT = 1 << 17
#: Cells in which a task counts shingles to tell the frequent ones, of a byte each.
COUNTERS = 1 << 24
#: Points of a region whose pairs are compared directly, in array operations on at most a few MB of profiles.
SMALL = 4096
#: Pairs that are tested exactly at once.
TEST_AT_ONCE = 20_000
#: Levels of differences before the pairs of any region that is left are compared directly.
LEVELS = 4
#: Rows of a side that is broadcast, two numbers each; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows of one output batch.
OUT_ROWS = 50_000


def shingle_sets(batch: pa.RecordBatch, text: str, seed: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    raw, offsets = vectext.utf8(batch.column(text))
    low = vectext.LOWER[raw]
    starts, ends, at = vectext.words(low, offsets, vectext.NON_SPACE)
    hashes, out = vectext.shingles(vectext.Hasher(low, seed).spans(starts, ends), at, SHINGLE_WORDS)
    for first, last in zip(out[:-1], out[1:]):
        yield np.unique(hashes[first:last])


def point_of(shingles: np.ndarray) -> tuple[int, int]:
    """Two hashes of a whole set."""
    a = vectext.mix(np.array([vectext.mix(shingles).sum() + np.uint64(len(shingles))]))
    b = np.bitwise_xor.reduce(vectext.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)))
    return int(a.view(np.int64)[0]), int(np.array([b]).view(np.int64)[0])


def profile(shingles: np.ndarray) -> bytes | None:
    """Counts of the shingles in the least power of two of buckets above |x|, two to a byte; None if one exceeds 15."""
    size = 1 << max(3, len(shingles).bit_length())
    counts = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return (counts[0::2] | counts[1::2] << 4).astype(np.uint8).tobytes() if counts.max() < 16 else None


def _counts(packed: bytes, size: int) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8)
    counts = np.empty(2 * len(raw), np.int64)
    counts[0::2], counts[1::2] = raw & 15, raw >> 4
    return counts.reshape(-1, size).sum(axis=0)


def profile_distance(p: bytes | None, x: bytes | None, m: int, n: int) -> float | None:
    """D of a pivot of m and a point of n shingles, over half the pivot's buckets, which both profiles can be folded to."""
    if p is None or x is None or 2 * len(x) < len(p):
        return None
    common = int(np.minimum(_counts(p, len(p)), _counts(x, len(p))).sum())
    return 1 - common / (m + n - common)


def needed(m, n):
    """Least intersection with which sets of m and n shingles link."""
    return -(-PERCENT * (m + n) // (100 + PERCENT))


def _points(docs: DataFrame, seed: int) -> DataFrame:
    """(key, node, check, n, profile, frequent): the point of each document; shingles that are frequent in its task so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.uint8)
        for batch in vectext.slices(batches, "text"):
            sets = list(shingle_sets(batch, "text", seed))
            ids = [point_of(s) if len(s) else (None, None) for s in sets]
            once = {node: s for (node, _), s in zip(ids, sets) if node is not None}
            values, counts = np.unique(np.concatenate([*once.values(), np.zeros(0, np.uint64)]), return_counts=True)
            cells = (values >> np.uint64(8)) & np.uint64(COUNTERS - 1)
            seen[cells] = np.minimum(seen[cells] + counts, 255)
            often = seen[cells] >= 4
            frequent: list = [None] * len(sets)
            frequent[0] = [{"s": s, "c": c} for s, c in zip(values[often].view(np.int64).tolist(), counts[often].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array([i for i, _ in ids], pa.int64()),
                    pa.array([c for _, c in ids], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([profile(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array(frequent, pa.list_(pa.struct([("s", pa.int64()), ("c", pa.int64())]))),
                ],
                names=["key", "node", "check", "n", "profile", "frequent"],
            )

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, node long, check long, n long, profile binary, frequent array<struct<s:long,c:long>>")


def _ordered(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The common order: by hash, with the frequent shingles last, the most frequent at the end."""
    if not len(frequent):
        return shingles
    at = np.minimum(np.searchsorted(frequent["s"], shingles), len(frequent) - 1)
    weight = np.where(frequent["s"][at] == shingles, frequent["rank"][at], 0)
    return shingles[np.argsort(weight, kind="stable")]


#: A region's point may be the near one of a pair, the far one, or either.
NEAR, FAR, BOTH = 1, 2, 3
REGIONS = "shingle long, node long, size long, roles long"


def _regions(docs: DataFrame, seed: int, frequent: np.ndarray) -> DataFrame:
    """(shingle, node, size, roles): a point in each region it lies in. size: n * 2^32 + place of the shingle in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in vectext.slices(batches, "text"):
            parts = []
            for s in shingle_sets(batch, "text", seed):
                n = len(s)
                if not n or (node := point_of(s)[0]) in done:
                    continue  # a copy is the same point
                if len(done) < 1_000_000:
                    done.add(node)
                k = n - -(-PERCENT * n // 100) + 1
                parts.append((_ordered(s, frequent)[:k].view(np.int64), np.full(k, node), (n << 32) + np.arange(k), np.full(k, BOTH)))
            if parts:
                yield from _batch(dict(zip(("shingle", "node", "size", "roles"), (np.concatenate(x) for x in zip(*parts)))))

    return docs.select("text").mapInArrow(run, REGIONS)


def _batch(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for at in range(0, n, OUT_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + OUT_ROWS]) for c in columns.values()], names=list(columns))


def _to_pivots(regions: DataFrame) -> DataFrame:
    """(pivot, node, first, test): each point with the pivots of its shingle regions, near points of least hash.

    first: it lies in the pivot region (the first pivot of the shingle region; only where the region has more near
    points than pivots, and for points that are none of them); test: by sizes, places and roles they may link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4  # the first points of the region that is open, from earlier batches
        for batch in batches:
            new = [batch.column(c).to_numpy() for c in ("shingle", "node", "size", "roles")]
            if not len(new[0]):
                continue
            skip = len(held[0])
            s, node, size, roles = (np.concatenate(x) for x in zip(held, new))
            keep = np.concatenate(([True], (s[1:] != s[:-1]) | (node[1:] != node[:-1])))  # a point once a region
            fresh = (np.arange(len(s)) >= skip)[keep]
            s, node, size, roles = s[keep], node[keep], size[keep], roles[keep]
            heads = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            begin = np.repeat(heads, np.diff(np.append(heads, len(s))))
            place = np.arange(len(s)) - begin
            n, at = size >> 32, size & 0xFFFFFFFF
            crowded = roles[np.minimum(begin + PIVOTS, len(s) - 1)] & NEAR > 0
            made = []
            for j in range(PIVOTS):
                x = np.flatnonzero(fresh & (place > j))
                p = begin[x] + j
                least, most = np.minimum(n[x], n[p]), np.maximum(n[x], n[p])
                may = (100 * least >= PERCENT * most) & (np.minimum(n[x] - at[x], n[p] - at[p]) >= needed(n[x], n[p]))
                may &= (roles[x] & (roles[p] << 1) & FAR > 0) | (roles[p] & (roles[x] << 1) & FAR > 0)
                first = (place[x] >= PIVOTS) & crowded[x] & (j == 0)
                use = may | first
                made.append((node[p[use]], node[x[use]], first[use], may[use]))
            pivot, other, first, may = (np.concatenate(c) for c in zip(*made))
            if len(pivot):  # pairs that several regions of the batch give are given once
                order = np.lexsort((other, pivot))
                pivot, other = pivot[order], other[order]
                once = np.flatnonzero(np.concatenate(([True], (pivot[1:] != pivot[:-1]) | (other[1:] != other[:-1]))))
                yield from _batch({"pivot": pivot[once], "node": other[once], "first": np.logical_or.reduceat(first[order], once), "test": np.logical_or.reduceat(may[order], once)})
            last = heads[-1]
            kept = np.unique(np.append(np.arange(last, min(last + PIVOTS + 1, len(s))), len(s) - 1))  # the last: a copy may follow
            held = [c[kept] for c in (s, node, size, roles)]

    order = F.when(F.col("roles").bitwiseAND(NEAR) > 0, 0).otherwise(1)
    spread = regions.repartition("shingle").sortWithinPartitions("shingle", order, "node")
    found = spread.mapInArrow(run, "pivot long, node long, first boolean, test boolean")
    return found.groupBy("pivot", "node").agg(F.max("first").alias("first"), F.max("test").alias("test"))


def _profile_distances(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The columns of ``pairs`` (a, b, ...) and d, the distance D of the profiles, null where it isn't known."""
    one = points.select(F.col("node").alias("a"), F.col("profile").alias("__p"), F.col("n").alias("__m"))
    two = points.select(F.col("node").alias("b"), F.col("profile").alias("__x"), F.col("n").alias("__n"))
    rows = pairs.join(one, "a").join(two, "b").select(*pairs.columns, "__p", "__x", "__m", "__n")
    kept = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profile_distance(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("__p", "__x", "__m", "__n")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.float64())], names=[*kept, "d"])

    return rows.mapInArrow(run, pairs.schema.add("d", "double"))


def _with_texts(rows: DataFrame, texts: DataFrame, count: int) -> DataFrame:
    """Join the packed texts of points to rows (node, ...), of which there are at most ``count``."""
    return texts.join(F.broadcast(rows) if count <= BROADCAST_ROWS else rows, "node")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of a few packed texts at a time, unpacked."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for first in range(0, batch.num_rows, 64):
            part = batch.slice(first, 64)
            texts = pa.array([zlib.decompress(x.as_buffer()).decode() for x in part.column("text")], pa.large_string())
            columns = [texts if i == at else c for i, c in enumerate(part.columns)]
            yield from vectext.slices(iter([pa.RecordBatch.from_arrays(columns, names=part.schema.names)]), "text")


def _exact_links(pairs: DataFrame, texts: DataFrame, seed: int, count: int) -> DataFrame:
    """The pairs (a, b) that link, of at most ``count``. texts: (node, packed text) of all points.

    The texts of the points are sent to their partner ``a``; a stream sorted by ``a`` with its own text first holds
    one set at a time.
    """
    other = pairs.select("a", F.col("b").alias("node")).withColumn("own", F.lit(1))
    own = pairs.select("a").distinct().withColumn("node", F.col("a")).withColumn("own", F.lit(0))
    rows = _with_texts(other.union(own), texts, 2 * count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mine = None, np.zeros(0, np.uint64)
        for batch in _unpacked(batches):
            found = []
            a, b, own = (batch.column(c).to_pylist() for c in ("a", "node", "own"))
            for i, s in enumerate(shingle_sets(batch, "text", seed)):
                if own[i] == 0:
                    held, mine = a[i], s
                elif a[i] == held:
                    common = len(np.intersect1d(mine, s, assume_unique=True))
                    if 100 * common >= PERCENT * (len(mine) + len(s) - common):
                        found.append((a[i], b[i]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    spread = rows.repartition("a").sortWithinPartitions("a", "own")
    return spread.mapInArrow(run, "a long, b long")


def _apart(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """The pairs whose points are in different components."""
    one = components.select(F.col("node").alias("a"), F.col("component").alias("__a"))
    two = components.select(F.col("node").alias("b"), F.col("component").alias("__b"))
    named = pairs.join(one, "a", "left").join(two, "b", "left")
    return named.where("coalesce(__a, a) <> coalesce(__b, b)").drop("__a", "__b")


def _resolve(pairs: DataFrame, components: DataFrame | None, texts: DataFrame, seed: int) -> DataFrame:
    """The components (node, component) that follow from those known so far and the pairs (a, b, d).

    Many pairs are tested in two steps: first every b against its nearest a, then all pairs that are still in different
    components. So a group of copies needs about one test a point.
    """
    near = f"d is null or d <= {1 - PERCENT / 100 + 1e-9}"
    pairs = pairs.where(near).select("a", "b", F.coalesce("d", F.lit(0.0)).alias("d"))
    pairs = cut(pairs if components is None else _apart(pairs, components), "pairs")
    count = pairs.count()
    if not count and components is not None:
        return components
    two_steps = count > TEST_AT_ONCE
    chosen = pairs.groupBy("b").agg(F.min(F.struct("d", "a")).alias("m")).select("m.a", "b") if two_steps else pairs
    for last in (False, True):
        links = _exact_links(chosen.select("a", "b"), texts, seed, count)
        if components is not None:
            found = cut(links, "links")
            if found.isEmpty():
                break
            links = found.union(components.select("node", "component").where("node <> component"))
        components = cut(connected_components(links), "components")
        if last or not two_steps:
            break
        chosen = cut(_apart(pairs.select("a", "b"), components), "apart")
        if chosen.isEmpty():
            break
    discard(pairs)
    return components


def _in_blocks(points: DataFrame) -> DataFrame:
    """Large regions of points (region, node, points, ...) as one region for every two blocks of about ``SMALL`` points."""
    blocks = F.ceil(F.col("points") / SMALL).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    both = F.xxhash64("region", F.least("__own", "__other"), F.greatest("__own", "__other"))
    spread = points.withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return spread.withColumn("region", F.when(F.col("points") > SMALL, both).otherwise(F.col("region"))).drop("__own", "__other")


class _Held:
    """Points of a region that a stream has passed, in one table for each length of profile."""

    def __init__(self):
        self.groups: dict[int | None, dict] = {}

    def add(self, node: int, n: int, d: float, component: int, packed: bytes | None) -> None:
        key = None if packed is None else len(packed)
        g = self.groups.setdefault(key, {"size": 0, "rows": np.zeros((16, 2), np.int64), "d": np.zeros(16), "node": np.zeros(16, np.int64), "counts": np.zeros((16, key or 0), np.uint8)})
        i = g["size"]
        if i == len(g["node"]):
            for name in ("rows", "d", "node", "counts"):
                g[name] = np.concatenate((g[name], np.zeros((max(16, i), *g[name].shape[1:]), g[name].dtype)))
        g["rows"][i], g["d"][i], g["node"][i] = (n, component), d, node
        if key:
            g["counts"][i] = np.minimum(_counts(packed, key), 255)
        g["size"] = i + 1

    def drop_below(self, least: float) -> None:
        """Forget points that are too small for all that follow; they come in order of size."""
        for g in self.groups.values():
            first = int(np.searchsorted(g["rows"][: g["size"], 0], least))
            if first > g["size"] // 2 > 8:
                for name in ("rows", "d", "node", "counts"):
                    g[name] = g[name][first:].copy()
                g["size"] -= first

    def near(self, n: int, d: float, component: int, packed: bytes | None, radius: float) -> Iterator[tuple[np.ndarray, list]]:
        """Points of other components that size, triangle inequality and D let link, with D (None: not known)."""
        for key, g in self.groups.items():
            m, theirs = g["rows"][: g["size"]].T
            at = np.flatnonzero((theirs != component) & (100 * m >= PERCENT * n) & ~(np.abs(g["d"][: g["size"]] - d) > radius))
            if not len(at):
                continue
            if not key or packed is None or 2 * len(packed) < key:
                yield g["node"][at], [None] * len(at)
                continue
            own = np.minimum(_counts(packed, key), 255).astype(np.uint8)
            common = np.minimum(g["counts"][at], own).sum(axis=1, dtype=np.int64)
            distance = 1 - common / (m[at] + n - common)
            ok = distance <= radius
            yield g["node"][at[ok]], distance[ok].tolist()


def _pairs_within(points: DataFrame) -> DataFrame:
    """(a, b, d): the pairs of a region, in different components, that D, sizes and the triangle inequality let link.

    points: (region, node, n, d, component, profile), d being D to the region's pivot. A stream sorted by size holds
    the points that are large enough for the next one.
    """
    radius = 1 - PERCENT / 100 + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, held = None, _Held()
        for batch in batches:
            a, b, distances = [], [], []
            for row in zip(*(batch.column(c).to_pylist() for c in ("region", "node", "n", "d", "component", "profile"))):
                if row[0] != region:
                    region, held = row[0], _Held()
                _, node, n, d, component, own = row
                d = np.nan if d is None else d
                held.drop_below(PERCENT * n / 100)
                for numbers, found in held.near(n, d, component, own, radius):
                    a += np.minimum(numbers, node).tolist()
                    b += np.maximum(numbers, node).tolist()
                    distances += found
                held.add(node, n, d, component, own)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(distances, pa.float64())], names=["a", "b", "d"])

    spread = points.repartition("region").sortWithinPartitions("region", "n", "node").select("region", "node", "n", "d", "component", "profile")
    return spread.mapInArrow(run, "a long, b long, d double").groupBy("a", "b").agg(F.min("d").alias("d"))


def _differences(members: DataFrame, texts: DataFrame, seed: int, frequent: np.ndarray) -> DataFrame:
    """Regions (as of ``_regions``) of the first differences of points from the pivot of their region.

    members: (region, node). Differences that the pivot misses come before those that the point misses.
    """
    rows = members.select("region", "node").withColumn("own", F.lit(1)).union(members.select("region").distinct().select("region", F.col("region").alias("node"), F.lit(0)))
    rows = _with_texts(rows, texts, rows.count())
    c = PERCENT / (100 + PERCENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pivot = None, np.zeros(0, np.uint64)
        for batch in _unpacked(batches):
            region, node, own = (batch.column(x).to_pylist() for x in ("region", "node", "own"))
            parts = []
            for i, s in enumerate(shingle_sets(batch, "text", seed)):
                if own[i] == 0:
                    held, pivot = region[i], s
                    continue
                if region[i] != held:
                    continue
                missing, more = np.setdiff1d(pivot, s, assume_unique=True), np.setdiff1d(s, pivot, assume_unique=True)
                size, g, bound = len(missing) + len(more), (1 - c) * len(missing) + c * len(more), (1 - 2 * c) * len(pivot)
                near = size - max(int(np.ceil(2 * g - bound - 1e-6)), int(np.floor(g - 1e-6)) + 1, 1) + 1
                over = g - bound
                # the far point of a pair has the larger g, and the other one g >= over / (1 / c - 1)
                far = size - max(int(np.ceil(over + over / (1 / c - 1) - 1e-6)), 1) + 1 if over > -1e-6 else 0
                k = max(near, far, 0)
                if k:
                    order = np.concatenate((_ordered(more, frequent), _ordered(missing, frequent)))[:k]
                    block = vectext.mix(order + vectext.mix(np.array([held]).view(np.uint64))).view(np.int64)
                    roles = NEAR * (np.arange(k) < near) + FAR * (np.arange(k) < far)
                    parts.append((block, np.full(k, node[i]), np.full(k, len(s) << 32), roles))
            if parts:
                yield from _batch(dict(zip(("shingle", "node", "size", "roles"), (np.concatenate(x) for x in zip(*parts)))))

    spread = rows.repartition("region").sortWithinPartitions("region", "own")
    return spread.mapInArrow(run, REGIONS)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """(key, n, component) of every row: size of its shingle set, and least key of its component."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    while True:
        points = cut(_points(docs, seed), "points")
        if not points.where("node is not null").groupBy("node").agg(F.countDistinct("check", "n").alias("k")).where("k > 1").take(1):
            break
        seed += 1  # two different sets got one hash: other hashes
    counts = points.where("frequent is not null").select(F.explode("frequent").alias("f")).groupBy("f.s").agg(F.sum("f.c").alias("c"))
    top = counts.orderBy(F.desc("c"), "s").limit(FREQUENT).select("s").toArrow().column(0).to_numpy()
    frequent = np.zeros(len(top), dtype=[("s", np.uint64), ("rank", np.int64)])
    frequent["s"], frequent["rank"] = top.astype(np.int64).view(np.uint64), np.arange(len(top), 0, -1)
    frequent.sort(order="s")

    # a point that only rows without an id hold links to no other, so it must not become a pivot
    regions = _regions(docs.where("key is not null"), seed, frequent)
    near = cut(_to_pivots(regions), "near")
    involved = near.select("node").union(near.select("pivot")).distinct()
    classes = points.where("node is not null").groupBy("node").agg(F.min("key").alias("key"), F.max("n").alias("n"), F.first("profile").alias("profile"), F.count("*").alias("copies"))
    chosen = cut(classes.join(involved, "node").select("node", "key"), "chosen")
    chosen = _small(chosen)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vectext.slices(batches, "text"):
            mine = [len(s) > 0 and point_of(s)[0] == node for s, node in zip(shingle_sets(batch, "text", seed), batch.column("node").to_pylist())]
            kept = batch.filter(pa.array(mine))
            packed = [zlib.compress(t.encode(), 1) for t in kept.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([kept.column("node"), pa.array(packed, pa.binary())], names=["node", "text"])

    texts = cut(docs.join(chosen, "key").select("node", "text").mapInArrow(checked, "node long, text binary"), "texts")
    if not texts.groupBy("node").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["node"])  # repeated rows
    profiles = classes.join(involved, "node").select("node", "n", "profile")

    components = direct = None
    for level in range(LEVELS + 1):
        pairs = near.select(F.col("pivot").alias("a"), F.col("node").alias("b"), "first", "test")
        measured = cut(_profile_distances(pairs, profiles), "distances")
        tests = measured.where("test").select("a", "b", "d")
        components = _resolve(tests if direct is None else tests.union(direct), components, texts, seed)
        members = measured.where("first").select(F.col("a").alias("region"), F.col("b").alias("node"), "d")
        members = members.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        spans = members.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("points"))
        open_ = cut(members.join(spans.where("low < high").select("region", "points"), "region"), "open-regions")
        large = open_.where(f"points > {SMALL}")
        done = level == LEVELS or large.isEmpty()
        direct = _pairs_within((_in_blocks(open_) if done else open_.where(f"points <= {SMALL}")).join(profiles, "node"))
        if done:
            components = _resolve(direct, components, texts, seed)
            break
        near = cut(_to_pivots(_differences(large, texts, seed, frequent)), "near")
    # names of points that have copies or links; tables of their own, so that a join by a hot one can be split
    known = cut(classes.where("copies > 1").select("node", "key").join(components, "node", "full").join(classes.select("node", F.col("key").alias("own")), "node").select("node", F.coalesce("component", "node").alias("component"), "own"), "known")
    least = cut(known.groupBy("component").agg(F.min("own").alias("least")), "least")
    names = cut(known.join(_small(least), "component").select("node", "least"), "names")
    return points.join(_small(names), "node", "left").select(F.col("key").alias(key), "n", F.coalesce("least", "key").alias("component"))


def _small(table: DataFrame) -> DataFrame:
    """A written table of two numbers a row, broadcast if it has at most ``BROADCAST_ROWS``."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
