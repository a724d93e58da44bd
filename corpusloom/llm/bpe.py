"""BPE encoding and decoding by speculation and verification.

A word is first cut greedily into the longest tokens. The cut is right exactly if every two neighbours are
compatible, that is, if the merges of their joined bytes give the same two tokens; all neighbours of all new words
of a slice are tested at once against a sorted table of known pairs. Only words with an incompatible pair are
merged exactly, rank by rank.

Defined results: a null text is encoded as an empty one (no ids); equal texts have equal ids; a very long text is
encoded whole; the strings of special tokens in a text give the ids of those tokens, as in the tokenizers library.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from corpusloom.llm import vectext
from corpusloom.llm.storage import table

#: Fixed value: the pattern by which byte-level BPE splits text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of the younger of the two generations in a worker's memory; beyond it the older one is dropped, results stay the same.
CACHE_WORDS = 250_000
_NO_RANK = 1 << 40


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


class SpeculativeBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        self.ids = {raw(token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        rules = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = raw(left), raw(right)
            rules.append((self.ids[a] << 32 | self.ids[b], rank, self.ids[a + b]))
        self.pair_codes, self.pair_ranks, self.pair_tokens = np.array(sorted(rules), np.int64).T.copy()
        self.bytes_of = {i: token for token, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        size = max(self.bytes_of) + 1
        texts = [self.bytes_of.get(i, b"") for i in range(size)]
        self.token_ends = np.cumsum([len(x) for x in texts])
        self.token_starts = self.token_ends - np.array([len(x) for x in texts])
        self.token_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.single = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], np.int64)
        reachable = {t: i for (t, i), found in zip(self.ids.items(), self.merge(list(self.ids))) if found == [i]}
        self.proposals = reachable
        self.reach: dict[bytes, int] = {}  # longest token by its first two bytes
        for t in reachable:
            self.reach[t[:2]] = max(self.reach.get(t[:2], 1), len(t))
        self.good = np.zeros(0, np.int64)
        self.bad = np.zeros(0, np.int64)
        self.splitter = regex.compile(WORD_PATTERN)
        self.special_splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words at once: in each round every word merges its pair of lowest rank, leftmost first."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        tokens = self.single[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        owner, tokens = owner[tokens >= 0], tokens[tokens >= 0]
        done_owner, done_tokens = [], []
        while len(tokens):
            code = np.append(np.where(owner[1:] == owner[:-1], tokens[:-1] << 32 | tokens[1:], -1), -1)
            at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
            rank = np.where(self.pair_codes[at] == code, self.pair_ranks[at], _NO_RANK)
            heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(owner))))
            ended = best == _NO_RANK
            done_owner.append(owner[ended])
            done_tokens.append(tokens[ended])
            chosen = np.flatnonzero((rank == best) & ~ended)
            run = np.flatnonzero(np.concatenate(([True], np.diff(chosen) != 1)))
            place = np.arange(len(chosen)) - np.repeat(run, np.diff(np.append(run, len(chosen))))
            chosen = chosen[place % 2 == 0]  # of overlapping pairs every second one
            tokens = tokens.copy()
            tokens[chosen] = self.pair_tokens[at[chosen]]
            left = ~ended
            left[chosen + 1] = False
            owner, tokens = owner[left], tokens[left]
        if not done_owner:
            return [[] for _ in words]
        owner, tokens = np.concatenate(done_owner), np.concatenate(done_tokens)
        order = np.argsort(owner, kind="stable")
        flat, ends = tokens[order].tolist(), np.cumsum(np.bincount(owner, minlength=len(words))).tolist()
        return [flat[i:j] for i, j in zip([0, *ends], ends)]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        found, at, end, proposals, reach = [], 0, len(word), self.proposals, self.reach
        while at < end:
            for stop in range(min(end, at + reach.get(word[at : at + 2], 1)), at + 1, -1):
                token = proposals.get(word[at:stop])
                if token is not None:
                    found.append(token)
                    at = stop
                    break
            else:
                if self.single[word[at]] >= 0:
                    found.append(int(self.single[word[at]]))
                at += 1
        return found

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair of neighbours (left * 2^32 + right) survives exact merging."""
        distinct, at = np.unique(pairs, return_inverse=True)
        unseen = distinct[~_among(distinct, self.good) & ~_among(distinct, self.bad)]
        if len(unseen):
            joined = [self.bytes_of[p >> 32] + self.bytes_of[p & 0xFFFFFFFF] for p in unseen.tolist()]
            verdict = np.array([found == [p >> 32, p & 0xFFFFFFFF] for p, found in zip(unseen.tolist(), self.merge(joined))])
            self.good = np.union1d(self.good, unseen[verdict])
            self.bad = np.union1d(self.bad, unseen[~verdict])
        return _among(distinct, self.good)[at]

    def learn(self, new: list[str]) -> None:
        """Encode words not seen before: propose all, test all neighbours at once, merge the failing ones."""
        raw = [w.encode() for w in new]
        proposed = [self.propose(w) for w in raw]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(new)), sizes)
        same = owner[1:] == owner[:-1]
        pairs = (flat[:-1] << 32 | flat[1:])[same]
        failing = np.unique(owner[1:][same][~self.compatible(pairs)]) if len(pairs) else []
        for i, exact in zip(failing, self.merge([raw[i] for i in failing])):
            proposed[i] = exact
        self.known.update(zip(new, map(tuple, proposed)))

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        split = self.splitter.findall
        pieces: list[list[str]] = []
        for text in texts:
            if self.special_splitter and any(s in text for s in self.special):
                parts = self.special_splitter.split(text)
                pieces.append([w for i, part in enumerate(parts) for w in ([("", part)] if i % 2 else split(part))])
            else:
                pieces.append(split(text))
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = set(chain.from_iterable(pieces)).difference(known)
        if older:
            kept = new & older.keys()
            known.update((w, older[w]) for w in kept)
            new -= kept
        for token, i in self.special.items():
            known[("", token)] = (i,)
            new.discard(("", token))
        if new:
            self.learn(list(new))
        return [list(chain.from_iterable(map(known.__getitem__, words))) for words in pieces]

    def rest(self) -> None:
        """Give memory back at the end of a task: the worker may next run something else."""
        self.older = {}
        pa.default_memory_pool().release_unused()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, gathered at once; special tokens are kept, unknown ids give nothing."""
        ids = ids[(ids >= 0) & (ids < len(self.token_ends))]
        starts, sizes = self.token_starts[ids], self.token_ends[ids] - self.token_starts[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)
        return self.token_bytes[at].tobytes()

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", errors="replace")


_encoders: dict[str, SpeculativeBpe] = {}


def encoder(path: str) -> SpeculativeBpe:
    """One encoder a worker process and file."""
    if path not in _encoders:
        _encoders[path] = SpeculativeBpe(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The columns of ``docs`` and the token ids of its text; a column named like ``ids`` is replaced."""
    kept = [c for c in docs.columns if c.lower() != ids.lower()]
    schema = docs.select(*kept).schema.add(ids, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in vectext.slices(batches, text):
            found = bpe.encode_batch(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names, ids])
        bpe.rest()

    return docs.select(*kept).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, keys: list[str], text: str = "text") -> DataFrame:
    """For each row: its keys, n_tokens, digests of its ids and of the text decoded from them, and that text's length."""
    schema = docs.select(*keys).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string").add("n_decoded", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        shown: dict[int, str] = {i: str(i) for i in bpe.bytes_of}
        for batch in vectext.slices(batches, text):
            counts, ids_sha, text_sha, length = [], [], [], []
            for ids in bpe.encode_batch(batch.column(text).to_pylist()):
                decoded = bpe.decode_bytes(np.array(ids, np.int64)).decode("utf-8", errors="replace")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(shown.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                length.append(len(decoded))
            columns = [batch.column(k) for k in keys] + [pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha), pa.array(length, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        bpe.rest()

    return docs.select(*keys, text).mapInArrow(run, schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), ["doc_id"]).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
