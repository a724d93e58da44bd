"""Source divergence: perfect hashes, exact shares, brute force over blocks, shards and tiles, edge cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import hash_recount
from corpusloom.llm.hash_recount import Block, PerfectHash, shares

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, shard int"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1, 2) for i, r in enumerate(rows)], SCHEMA)


def shard(words, lang="en", number=0, of=1):
    made = PerfectHash(pa.array(words, pa.string()))
    return {"lang": lang, "shard": number, "shards": of, "n": len(words), "sizes": made.sizes, "left": made.left, "bits": np.packbits(made.bits).tobytes(), "words": made.words.to_pylist()}


def test_the_hash_is_perfect_minimal_and_verified():
    words = [f"w{i}" for i in range(5000)] + ["é", "ü"]
    block = Block(pa.Table.from_pylist([shard(words)]))
    slots = block.slots("en", pa.array(words), hash_recount.term_hashes(pa.array(words)))
    assert sorted(slots) == list(range(len(words)))
    assert [block.words[int(s)].as_py() for s in slots] == words
    strange = pa.array([f"x{i}" for i in range(5000)])
    assert (block.slots("en", strange, hash_recount.term_hashes(strange)) == -1).all()


def test_terms_of_equal_hashes_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(hash_recount, "term_hashes", lambda words: np.full(len(words), 7, np.uint64))
    words = pa.array(["a", "b", "c"])
    block = Block(pa.Table.from_pylist([shard(words.to_pylist())]))
    asked = pa.array(["c", "d", "a", "b"])
    slots = block.slots("en", asked, hash_recount.term_hashes(asked))
    assert slots[1] == -1 and sorted(slots[[0, 2, 3]]) == [0, 1, 2] and [block.words[int(s)].as_py() for s in slots[[0, 2, 3]]] == ["c", "a", "b"]


def test_shares_are_exact():
    rng = random.Random(3)
    counts = [rng.randrange(1, 10 ** rng.randrange(1, 15)) for _ in range(300)] + [1, 8_999_999_999_999_999]
    totals = [c + rng.randrange(0, 10 ** rng.randrange(1, 15)) for c in counts[:-1]] + [9_000_000_000_000_000]
    assert shares(np.array(counts), np.array(totals)).tolist() == [1 + 10**9 * c // t for c, t in zip(counts, totals)]


def plain(rows, least=3, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x7f" else c for c in text or ""))) for text, lang, source in rows]
    df = Counter((lang, w) for lang, _, words in docs for w in set(words))
    kept = defaultdict(list)
    for (lang, w), n in df.items():
        if n >= least:
            kept[lang].append(w)
    counts, groups = Counter(), defaultdict(set)
    for lang, source, words in docs:
        groups[lang].add(source)
        counts.update((lang, source, w) for w in words if df[lang, w] >= least)
    out = []
    for lang, sources in groups.items():
        v = len(kept[lang])
        share = lambda of, w: 1 + 10**9 * (sum(counts[lang, s, w] for s in of) + 1) // max(1, sum(counts[lang, s, x] for s in of for x in kept[lang]) + v)
        p = {s: {w: share([s], w) for w in kept[lang]} for s in sources}
        q = {w: share(sources, w) for w in kept[lang]}
        for s in sources:
            pairs = [(-sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept[lang]), o.encode()) for o in sources - {s}]
            terms = [(-((p[s][w] - q[w]) ** 2 // q[w]), w.encode()) for w in kept[lang] if counts[lang, s, w] and p[s][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def made(seed=5, sources=7):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("the", "Of", "ça", "ü", "日本") for b in "abcdefgh"]
    rows = [(" ".join(rng.choice(words[: rng.randrange(1, 40)]) + rng.choice(["", ",", "1", "-x"]) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "en", "de", None]), rng.choice([f"s{i}" for i in range(sources)] + [None])) for _ in range(120)]
    # empty texts and languages, a group without terms, one without kept terms, a lone source, ties, repeated rows, a very long text
    rows += [(None, None, None), ("", "fr", "only"), ("...", "xx", "a"), ("unique words", "xx", "b"), ("tie one two", "yy", "a"), ("tie one two", "yy", "b"), ("tie one two", "yy", "c"), ("", "yy", "d")]
    return rows + [("repeated row", "zz", "a")] * 3 + [("repeated", "zz", "b"), ("long text " * 20_000, "en", "s1")]


@pytest.mark.parametrize("small", [False, True])
def test_divergence_equals_brute_force(spark, monkeypatch, small):
    if small:  # several shards, blocks and tiles, and dense counts handed over again and again
        for name, value in {"SHARD_TERMS": 5, "BLOCK_BYTES": 120, "TILE_SOURCES": 3, "DENSE_BYTES": 100, "SLICE_BYTES": 2_000, "ROWS_AT_ONCE": 3, "TOP_TERMS": 4}.items():
            monkeypatch.setattr(hash_recount, name, value)
    rows = made()
    got = hash_recount.divergence(rows_of(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, got)) == plain(rows, top=hash_recount.TOP_TERMS)


def test_no_documents(spark):
    assert hash_recount.divergence(rows_of(spark, [])).collect() == []
