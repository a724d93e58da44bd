"""Language of words and texts by a linear-chain conditional random field.

Every word has hashed features: the word itself (lexicon), its beginnings and endings of 1 to 4 bytes (affixes) and
its byte trigrams. Their weights and the transitions between the languages of neighbouring words are learned together
by the gradient of the conditional likelihood; the training texts are cut into runs of words that are put together
anew, so the chain sees changes of language. Marginals come from forward-backward over the whole text: a text is cut
into chunks whose products of transition and emission matrices are computed side by side.

A text's language is that with the greatest expected number of its words; the score is that share.

Defined results: ``und`` and score 0 for null and empty texts and texts without a letter; texts whose words have no
letter are labelled by their other words only; without any training row every text is ``und``; null languages are not
learned; rows with a null id are held out; repeated rows get equal results. Only key and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import vectext
from corpusloom.llm.storage import table

#: Bounds of the training sample: expected number of rows of each language and of all, bytes of a text to be learned
#: from, and languages, those of the most rows; the chain works on products of as many by as many numbers.
SAMPLE_ROWS = 500
SAMPLE_ALL = 8000
SAMPLE_TEXT_BYTES = 1 << 16
#: Weights are held in a table of this many rows; training keeps their numbers in 16 bits.
BUCKETS = 1 << 16
AFFIXES = (1, 2, 3, 4)
CHUNK = 32
#: Bytes of text labelled at a time; forward-backward holds many numbers a word.
SLICE_BYTES = 1 << 20
#: Runs of words whose tables are held at once in training, and bytes of text whose words are hashed at once.
PIECE_RUNS = 50
PIECE_BYTES = 1 << 18
UNKNOWN = "und"


def _word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = vectext.LOWER[raw]
    starts, ends, at = vectext.words(low, offsets, vectext.ALNUM)
    return low, starts, ends, at, vectext.Hasher(low).spans(starts, ends)


def _features(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of all given words, and the word of each, in small types: they are many."""
    spans, n = vectext.Hasher(low), np.arange(len(starts), dtype=np.int32)
    bucket = lambda hashes: (hashes % np.uint64(BUCKETS)).astype(np.uint16)
    found, owner = [bucket(spans.spans(starts, ends))], [n]
    for size in AFFIXES:
        found.append(bucket(vectext.mix(spans.spans(starts, np.minimum(ends, starts + size)) + np.uint64(size))))
        found.append(bucket(vectext.mix(spans.spans(np.maximum(starts, ends - size), ends) + np.uint64(16 + size))))
        owner += [n, n]
    grams = np.maximum(0, ends - starts - 2)
    of = np.repeat(n, grams)
    at = starts[of] + np.arange(len(of)) - np.repeat(np.cumsum(grams) - grams, grams)
    found.append(bucket(vectext.mix(spans.spans(at, at + 3) + np.uint64(64))))
    owner.append(of)
    return np.concatenate(found), np.concatenate(owner)


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    transitions: np.ndarray  # log weights, from x to

    def emissions(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log weight of each language for each word; words without a letter have none."""
        buckets, owner = _features(low, starts, ends)
        found = np.column_stack([np.bincount(owner, self.weights[buckets, k], minlength=len(starts)) for k in range(len(self.languages))])
        letters = np.concatenate(([0], np.cumsum((low >= 97) | (low >= 128))))
        return found * (letters[ends] > letters[starts])[:, None]

    def marginals(self, emissions: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(language) of each word, and the expected number of each transition. at: word offsets of the texts."""
        k = len(self.languages)
        e = np.exp(np.maximum(emissions - emissions.max(axis=1, keepdims=True), -8.0)) if len(emissions) else emissions
        a = np.exp(self.transitions)
        counts = np.diff(at)
        chunks = -(-counts // CHUNK)
        first = np.concatenate(([0], np.cumsum(chunks)))
        doc = np.repeat(np.arange(len(counts)), chunks)
        begin = at[:-1][doc] + CHUNK * (np.arange(first[-1]) - first[doc])
        size = np.minimum(CHUNK, at[1:][doc] - begin)
        word = begin[:, None] + np.arange(CHUNK)
        real = np.arange(CHUNK) < size[:, None]
        ee = np.where(real[:, :, None], e[np.minimum(word, max(0, len(e) - 1))], 1.0)
        n = len(begin)
        # products over each chunk, for the state that enters it
        product = np.broadcast_to(np.eye(k), (n, k, k))
        for t in range(CHUNK):
            step = np.where(real[:, t, None, None], a * ee[:, t, None, :], np.eye(k))
            product = product @ step
            product = product / product.max(axis=(1, 2), keepdims=True)
        enter, leave = np.ones((n, k)), np.ones((n, k))
        longest = int(chunks.max()) if n else 0
        order = np.argsort(-chunks, kind="stable")
        alive = np.searchsorted(-chunks[order], -np.arange(longest), side="left")
        for c in range(1, longest):
            i = first[order[: alive[c]]] + c
            v = np.einsum("nj,njk->nk", enter[i - 1], product[i - 1])
            enter[i] = v / v.max(axis=1, keepdims=True)
        for c in range(1, longest):
            d = order[: alive[c]]
            i = first[d + 1] - 1 - c
            v = np.einsum("njk,nk->nj", product[i + 1], leave[i + 1])
            leave[i] = v / v.max(axis=1, keepdims=True)
        forward, state = np.empty((n, CHUNK, k)), enter
        for t in range(CHUNK):
            came = state @ a if t else np.where((np.arange(n) == first[doc])[:, None], 1.0, state @ a)
            new = came * ee[:, t]
            new = new / np.maximum(new.max(axis=1, keepdims=True), 1e-300)
            state = np.where(real[:, t, None], new, state)
            forward[:, t] = state
        backward, state = np.empty((n, CHUNK, k)), leave
        for t in range(CHUNK - 1, -1, -1):
            backward[:, t] = state
            new = (ee[:, t] * state) @ a.T
            state = np.where(real[:, t, None], new / new.max(axis=1, keepdims=True), state)
        p = (forward * backward)[real]
        p = p / p.sum(axis=1, keepdims=True)
        f, b = forward[real], backward[real]
        inside = np.ones(len(p), bool)
        inside[at[:-1][counts > 0]] = False
        i = np.flatnonzero(inside)
        joint = f[i - 1][:, :, None] * a * (e[i] * b[i])[:, None, :]
        return p, (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def in_pieces(model: Crf, emissions: np.ndarray, code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``marginals`` of the emissions of coded words, some runs at a time: each is on its own, and the tables of one piece are held."""
    p, moves = np.empty((len(code), len(model.languages))), np.zeros_like(model.transitions)
    for first in range(0, len(at) - 1, PIECE_RUNS):
        some = at[first : first + PIECE_RUNS + 1]
        p[some[0] : some[-1]], more = model.marginals(emissions[code[some[0] : some[-1]]], some - some[0])
        moves += more
    return p, moves


def _learned(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(buckets, word of each, distinct word of each word of the texts, its label, number of distinct words) of a slice.

    Words are hashed a piece at a time and only distinct ones are cut into features, as those of all slices are held
    at once.
    """
    lows, starts, sizes, hashes, labels, base = [], [], [], [], [], 0
    for piece in vectext.slices([part], "text", PIECE_BYTES):
        low, first, ends, at, found = _word_hashes(*vectext.utf8(piece.column("text")))
        lows.append(low)
        starts.append(first + base)
        sizes.append(ends - first)
        hashes.append(found)
        labels.append(np.repeat(piece.column("label").to_numpy().astype(np.int32), np.diff(at)))
        base += len(low)
    low, starts, sizes = np.concatenate(lows), np.concatenate(starts), np.concatenate(sizes)
    _, some, code = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    starts, sizes = starts[some], sizes[some]
    ends = np.cumsum(sizes)
    own = low[np.repeat(starts - (ends - sizes), sizes) + np.arange(sizes.sum())]
    buckets, owner = _features(own, ends - sizes, ends)
    return buckets, owner, code.astype(np.int32), np.concatenate(labels), len(some)


def fit_crf(texts: list[str], languages: list[str], epochs: int = 4, seed: int = 5) -> Crf:
    """Learn weights and transitions from whole texts with one language each."""
    names = sorted(set(languages))
    k = len(names)
    random = np.random.default_rng(seed)
    model = Crf(names, np.zeros((BUCKETS, k), np.float64), np.zeros((k, k)))
    if not texts:
        return model
    parts = []
    labels = np.searchsorted(names, languages)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string()), pa.array(labels)], names=["text", "label"])
    for part in vectext.slices([batch], "text"):
        parts.append(_learned(part))
    # start from the log odds of the features, then follow the gradient of the chain's likelihood
    table = np.full((BUCKETS, k), 0.5)
    for buckets, owner, code, label, n in parts:
        uses = np.zeros((n, k))
        np.add.at(uses, (code, label), 1)
        for y in range(k):
            table[:, y] += np.bincount(buckets, uses[owner, y], minlength=BUCKETS)
    odds = np.log(table / table.sum(axis=0))
    model.weights = (odds - odds.mean(axis=1, keepdims=True)) * 0.2
    model.transitions = np.where(np.eye(k) > 0, 0.0, -2.0)
    squares = [np.full((BUCKETS, k), 1e-6), np.full((k, k), 1e-6)]
    for _ in range(epochs):
        for buckets, owner, code, label, n in parts:
            # runs of 3 to 40 words of one text, put together anew
            cuts = np.cumsum(random.integers(3, 41, size=len(code) // 3 + 1))
            cuts = np.union1d(cuts[cuts < len(code)], np.flatnonzero(np.diff(label)) + 1)
            runs = np.split(np.arange(len(code)), cuts)
            mixed = np.concatenate([runs[i] for i in random.permutation(len(runs))])
            code_, label_ = code[mixed], label[mixed]
            at = np.append(np.arange(0, len(code), 400), len(code))
            emissions = np.column_stack([np.bincount(owner, model.weights[buckets, y], minlength=n) for y in range(k)])
            p, moves = in_pieces(model, emissions, code_, at)
            wrong = np.negative(p, out=p)
            wrong[np.arange(len(p)), label_] += 1
            per_word = np.column_stack([np.bincount(code_, wrong[:, y], minlength=n) for y in range(k)])
            inside = np.ones(len(code), bool)
            inside[at[:-1]] = False
            seen = np.zeros((k, k))
            i = np.flatnonzero(inside)
            np.add.at(seen, (label_[i - 1], label_[i]), 1)
            gradients = [np.column_stack([np.bincount(buckets, per_word[owner, y], minlength=BUCKETS) for y in range(k)]) - 0.1 * model.weights, seen - moves]
            for value, gradient, square in zip((model.weights, model.transitions), gradients, squares):
                square += gradient**2
                value += 0.1 * gradient / np.sqrt(square)
    return model


def training_sample(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, lang): whole texts of an expected ``sample_rows`` rows a language, chosen by a hash of the id.

    All languages are learned, from texts of at most ``SAMPLE_TEXT_BYTES``; of so many that ``SAMPLE_ALL`` rows do not
    suffice for all, each has its expected share of them.
    """
    learn = docs.where("lang is not null and text is not null").where(fold() != 1)
    sizes = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    wanted = min(sample_rows, SAMPLE_ALL / max(1, len(sizes)))
    share = F.create_map(*[F.lit(v) for name, n in sizes.items() for v in (name, min(1.0, wanted / n))]) if sizes else F.create_map(F.lit(""), F.lit(0.0))
    rows = learn.where(F.octet_length("text") <= SAMPLE_TEXT_BYTES).where(F.expr("pmod(xxhash64(doc_id, 'language'), 1000000) / 1e6") < share[F.col("lang")])
    return rows.select("doc_id", "text", "lang")


def training_rows(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], list[str]]:
    """Texts and languages of the sample, in the memory of the driver."""
    rows = training_sample(docs, sample_rows).select("text", "lang").toArrow()
    return rows.column("text").to_pylist(), rows.column("lang").to_pylist()


def learned(docs: DataFrame) -> Crf:
    """A model of the sample's texts, fitted in one task: the sample is bounded, and the driver gets only the model.

    The texts are learned from in the order of their ids, however the table is cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        model = fit_crf(*[[x for batch in rows for x in batch.column(c).to_pylist()] for c in ("text", "lang")])
        columns = [pa.array([model.languages], pa.list_(pa.string())), pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.transitions.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["languages", "weights", "transitions"])

    sample = training_sample(docs).repartition(1).sortWithinPartitions("doc_id", "lang", "text").select("text", "lang")
    found = sample.mapInArrow(run, "languages array<string>, weights binary, transitions binary").first()
    if found is None:
        return fit_crf([], [])
    k = len(found["languages"])
    return Crf(list(found["languages"]), np.frombuffer(found["weights"]).reshape(BUCKETS, k), np.frombuffer(found["transitions"]).reshape(k, k))


def fold(key: str = "doc_id"):
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(3))


def _label(model: Crf, batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, ...]:
    low, starts, ends, at, hashes = _word_hashes(*vectext.utf8(batch.column(text)))
    _, some, code = np.unique(hashes, return_index=True, return_inverse=True)
    p, _ = model.marginals(model.emissions(low, starts[some], ends[some])[code], at)
    letters = np.concatenate(([0], np.cumsum((low >= 97) & (low < 123) | (low >= 128))))
    return p, at, letters[ends] > letters[starts], low


def label_words(docs: DataFrame, model: Crf, keys: list[str], text: str = "text") -> DataFrame:
    """The key columns and ``runs``: the runs of words (first, end, by number) of one language, with their mean probability."""
    schema = docs.select(*keys).schema.add("runs", T.ArrayType(T.StructType().add("first", "integer").add("end", "integer").add("lang", "string").add("p", "double")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vectext.slices(batches, "__text", SLICE_BYTES):
            p, at, _, _ = _label(model, batch, "__text") if model.languages else (np.zeros((0, 1)), np.zeros(batch.num_rows + 1, int), None, None)
            best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
            rows = []
            for first, last in zip(at[:-1], at[1:]):
                heads = first + np.flatnonzero(np.concatenate(([True], np.diff(best[first:last]) != 0))) if last > first else []
                rows.append([{"first": int(i - first), "end": int(j - first), "lang": model.languages[best[i]], "p": float(p[i:j, best[i]].mean())} for i, j in zip(heads, [*heads[1:], last])])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(rows, kind)], names=[*keys, "runs"])

    return docs.select(*keys, F.col(text).alias("__text")).mapInArrow(run, schema)


def predict(docs: DataFrame, model: Crf, text: str = "text", prefix: str = "") -> DataFrame:
    """The columns of ``docs`` with lang_pred and lang_score, both with the prefix; columns of these names are replaced."""
    added = [prefix + "lang_pred", prefix + "lang_score"]
    kept = [c for c in docs.columns if c.lower() not in added]
    schema = docs.select(*kept).schema.add(added[0], "string").add(added[1], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vectext.slices(batches, "__text", SLICE_BYTES):
            n = batch.num_rows
            names, scores = [UNKNOWN] * n, np.zeros(n)
            if model.languages:
                p, at, lettered, low = _label(model, batch, "__text")
                doc = np.repeat(np.arange(n), np.diff(at))
                votes = np.column_stack([np.bincount(doc, p[:, y] * lettered, minlength=n) for y in range(len(model.languages))])
                total = votes.sum(axis=1)
                sure = np.bincount(doc, lettered, minlength=n) > 0
                ascii_letters = np.concatenate(([0], np.cumsum((low >= 97) & (low < 123))))
                _, offsets = vectext.utf8(batch.column("__text"))
                plain = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
                for i in np.flatnonzero(sure):
                    if plain[i] or any(c.isalpha() for c in batch.column("__text")[i].as_py()):
                        best = int(votes[i].argmax())
                        names[i], scores[i] = model.languages[best], votes[i, best] / total[i]
            columns = [c for c, name in zip(batch.columns, batch.schema.names) if name != "__text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, *added])

    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learned(docs)
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold() == 1, F.lit(True)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
