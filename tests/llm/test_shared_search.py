"""Ranked search: the shared sums, brute force over blocks and slices, edge cases."""

import math
import random
import re
from collections import Counter

import pytest

from corpusloom.llm import shared_search
from corpusloom.llm.shared_search import Sharing

DOCS = "doc_id {}, text string, score int, rank string, keys int, item_id int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x7f" else c for c in text or ""))


def plain(docs, items, best=10):
    """(item, rank, key, score) of each distinct item; docs: (key, text)."""
    found = [(key, Counter(words(text))) for key, text in docs]
    n = sum(1 for _, c in found if c)
    total = sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for key, c in found:
            if c:
                m = 25 + 75 * sum(c.values()) * n // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if c[t])
                if score > 0:
                    scored.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, key, -score) for i, (score, _, _, key) in enumerate(sorted(scored, key=lambda s: s[:3])[:best])]
    return out


def order(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("neighbours", [128, 3])
def test_sums_are_those_of_the_items(monkeypatch, neighbours):
    monkeypatch.setattr(shared_search, "NEIGHBOURS", neighbours)
    rng = random.Random(2)
    items = [[rng.randrange(12) for _ in range(rng.randrange(0, 30))] for _ in range(25)] + [[], [1], [1, 1, 1], [1, 1, 1]]
    sharing = Sharing(items, 12)
    expanded = [Counter({t: 1}) for t in range(12)]
    for parts in sharing.parts:
        expanded.append(sum((expanded[p] for p in parts), Counter()))
    assert [sum((expanded[n] for n in nodes), Counter()) for nodes in sharing.items] == [Counter(i) for i in items]
    assert all(level > max([0, *(sharing.levels()[p - 12] for p in parts if p >= 12)]) for level, parts in zip(sharing.levels(), sharing.parts))
    shared, plain_sum = sharing.additions()
    assert shared < plain_sum and plain_sum == sum(max(0, len(i) - 1) for i in items)


def made(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("the", "Of", "ça", "3", "日本") for b in "abcdef"]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.randrange(1, 31)]) + rng.choice(["", ",", "-"]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 40))) for i in range(90)]
    docs += [(200 + i, "the same copy") for i in range(15)] + [(None, None), (None, "thea thea ofb"), (300, ""), (301, "thea " * 30_000), (302, "thea"), (302, "thea"), (303, "...")]
    items = [(i, text(rng.randrange(1, 25))) for i in range(20)] + [(50, "same COPY"), (50, "same COPY"), (50, "thea thea thea ofb"), (51, ""), (52, None), (53, "absent terms"), (None, "thea ofa"), (54, "copy " * 3000 + "thea")]
    return docs, items


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("small", [False, True])
def test_rank_equals_brute_force(spark, monkeypatch, kind, small):
    if small:  # several groups, blocks, slices and parts of slices
        for name, value in {"GROUP_BYTES": 400, "BLOCK_BYTES": 9_000, "SLICE_BYTES": 300, "HELD_BYTES": 2_000}.items():
            monkeypatch.setattr(shared_search, name, value)
    docs, items = made()
    if kind == "string":
        docs = [(k if k is None else f"k{k}", t) for k, t in docs]
    rows = spark.createDataFrame([(*d, 1, "r", 2, 3) for d in docs], DOCS.format(kind)).repartition(3)
    asked = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id int, text string, doc_id string")
    got = shared_search.rank(rows, asked).select("item_id", "rank", "doc_id", "score").collect()
    assert order(map(tuple, got)) == order(plain([(k if k is None or kind == "long" else k, t) for k, t in docs], items))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert shared_search.rank(docs, items).collect() == []
    assert shared_search.rank(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).collect() == []
    assert shared_search.rank(docs, items).columns == shared_search.rank(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
