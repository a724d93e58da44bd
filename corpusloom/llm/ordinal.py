"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(severity > k) = sigmoid(w.x - t_k): the weights are shared by all ordered thresholds t_0 < t_1 < ... . Features are
the words of a text and their beginnings of 4 and 5 bytes, hashed; evidence only adds to severity, so weights are not
negative. A label is an interval of grades (0 not toxic, 1 mild, 2 marked, 3 severe), and the model maximises the
likelihood that the severities lie in their intervals. A table whose labels only tell toxic from not toxic is censored:
toxic means from 1 to 3. Its labels say nothing on the thresholds between the toxic grades, so these are put where the
toxic training rows fall into the grades in equal shares; where labels are grades they are learned like the first one.

Features are chosen by penalties that grow with the number of features tried: those are tried jointly whose own gain in
likelihood exceeds its risk inflation penalty, 2 ln p a feature, and those get a weight that a lasso at the universal
threshold keeps; their weights are then fitted without it.

Defined results: null and empty texts, and texts without a feature of the model, get the expected severity of a text
without features; without any toxic training row all texts get severity 0; labels that are null are no labels; of several
labels of one document the greatest counts; repeated rows get equal results. Only key and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import vectext
from corpusloom.llm.storage import table

GRADES = 4
#: Bounds of the training sample: expected number of labelled rows of each class, and bytes of a text to be learned from.
SAMPLE_ROWS = 2500
SAMPLE_TEXT_BYTES = 1 << 16
#: Bytes of text whose features are held at once in training.
PIECE_BYTES = 1 << 19
PREFIXES = (4, 5)
#: Weight of the ridge in the last fit.
RIDGE = 0.5
#: A text is toxic if its severity is above 0 with at least this probability.
TOXIC_CUT = 0.5


def word_features(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature hashes of the word, one row a word)."""
    raw, offsets = vectext.utf8(batch.column(text))
    low = vectext.LOWER[raw]
    starts, ends, at = vectext.words(low, offsets, vectext.ALNUM)
    spans = vectext.Hasher(low)
    columns = [spans.spans(starts, ends)]
    for n in PREFIXES:
        short = np.minimum(ends, starts + n)
        columns.append(vectext.mix(spans.spans(starts, short) + np.uint64(n)))
    return np.repeat(np.arange(len(offsets) - 1), np.diff(at)), np.stack(columns, axis=1)


@dataclass
class OrdinalModel:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def cells(self, doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, feature, log2(1 + count)) of the features with a weight."""
        at = np.minimum(np.searchsorted(self.features, hashes), len(self.features) - 1)
        here = self.features[at] == hashes
        found, counts = np.unique((doc[:, None] * len(self.features) + at)[here], return_counts=True)
        return found // len(self.features), found % len(self.features), np.log2(1 + counts)

    def values(self, doc: np.ndarray, hashes: np.ndarray, n_docs: int) -> np.ndarray:
        """w.x of each document, x being log2(1 + count) of a feature."""
        if not len(self.features):
            return np.zeros(n_docs)
        row, col, x = self.cells(doc, hashes)
        return np.bincount(row, x * self.weights[col], minlength=n_docs)

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(severity > k) for each document and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - z[:, None], -500, 500)))


def _presence(doc: np.ndarray, hashes: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, rows with it, toxic rows with it) of one slice."""
    flat, owner = hashes.ravel(), np.repeat(doc, hashes.shape[1])
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    once = np.concatenate(([True], (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])))
    flat, owner = flat[once], owner[once]
    heads = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    return flat[heads], np.diff(np.append(heads, len(flat))), np.add.reduceat(toxic[owner].astype(np.int64), heads)


def _gain(total: np.ndarray, in_toxic: np.ndarray, n: int, pos: int) -> np.ndarray:
    """Likelihood-ratio statistic of each feature whose presence goes with toxic rows; 0 for the others."""
    expected = total * (pos / n)
    part = lambda o, e: o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9))
    return np.where(in_toxic > expected, 2 * (part(in_toxic, expected) + part(total - in_toxic, total - expected)), 0)


def likelihood(z: np.ndarray, thresholds: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood that each severity lies in [low, high], and its gradients by z and by the thresholds."""
    above = 1 / (1 + np.exp(np.clip(np.concatenate(([-np.inf], thresholds, [np.inf])) - z[:, None], -500, 500)))
    above[:, 0], above[:, -1] = 1, 0
    rows, slope = np.arange(len(z)), above * (1 - above)
    inside = np.maximum(above[rows, low] - above[rows, high + 1], 1e-12)
    upper, lower = slope[rows, low] / inside, slope[rows, high + 1] / inside
    edges = np.bincount(high + 1, lower, minlength=above.shape[1]) - np.bincount(low, upper, minlength=above.shape[1])
    return float(np.log(inside).sum()), upper - lower, edges[1:-1]


def _ascend(cells: tuple, low: np.ndarray, high: np.ndarray, w: np.ndarray, t: np.ndarray, lasso: np.ndarray, ridge: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximise the penalised likelihood over weights of at least 0, by gradient steps of adapted length."""
    row, col, x = cells
    moments = [np.zeros(len(w) + len(t)), np.zeros(len(w) + len(t))]
    for step in range(1, rounds + 1):
        _, dz, dt = likelihood(np.bincount(row, x * w[col], minlength=len(low)), t, low, high)
        g = np.concatenate((np.bincount(col, x * dz[row], minlength=len(w)) - lasso - ridge * w, dt))
        moments = [0.9 * moments[0] + 0.1 * g, 0.99 * moments[1] + 0.01 * g * g]
        move = 0.05 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w, t = np.maximum(0, w + move[: len(w)]), np.maximum.accumulate(t + move[len(w) :])
    return w, t


def _shared_out(z: np.ndarray, t: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The thresholds; those that no label bounds are put where the toxic rows fall into the grades in equal shares."""
    t, toxic = t.copy(), z[low > 0]
    first = 1 / (1 + np.exp(t[0] - toxic))
    for k in range(1, len(t)):
        if not ((low == k + 1) | (high == k)).any():
            least, most = -100.0, 100.0
            for _ in range(60):
                middle = (least + most) / 2
                beyond = (1 / (1 + np.exp(np.clip(middle - toxic, -500, 500)))).sum() / first.sum()
                least, most = (middle, most) if beyond > 1 - k / len(t) else (least, middle)
            t[k] = least
    return np.maximum.accumulate(t)


def fit_ordinal(texts: list[str], low: np.ndarray, high: np.ndarray, rounds: int = 400) -> OrdinalModel:
    """Fit to texts whose grades lie in [low, high]; one slice of text in memory."""
    low, high = np.asarray(low, np.int64), np.asarray(high, np.int64)
    none, toxic = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, 20.0)), low > 0
    if not toxic.any():
        return none
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
    parts, base = [], 0
    for part in vectext.slices([batch], "text", PIECE_BYTES):
        parts.append((part, base))
        base += part.num_rows
    names, total, in_toxic = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    for part, base in parts:
        doc, hashes = word_features(part, "text")
        if len(doc):
            found = _presence(doc + base, hashes, toxic)
            names, at = np.unique(np.concatenate((names, found[0])), return_inverse=True)
            total, in_toxic = (np.bincount(at, np.concatenate(x)) for x in ((total, found[1]), (in_toxic, found[2])))
    tried = _gain(total, in_toxic, len(texts), int(toxic.sum())) > 2 * np.log(max(2, len(names)))
    if not tried.any():
        return none
    model = OrdinalModel(names[tried], np.zeros(tried.sum()), np.zeros(GRADES - 1))
    found = []
    for part, base in parts:
        row, col, x = model.cells(*word_features(part, "text"))
        found.append((row + base, col, x))
    cells = row, col, x = tuple(np.concatenate(c) for c in zip(*found))
    share = toxic.mean()
    lasso = np.sqrt(2 * np.log(len(names)) * share * (1 - share) * np.bincount(col, x * x, minlength=len(model.features)))
    start = np.log((1 - share + 1e-6) / share) + np.arange(GRADES - 1.0)
    w, _ = _ascend(cells, low, high, model.weights, start, lasso, 0.0, rounds)
    chosen = w > 1e-3
    if not chosen.any():
        return none
    here = chosen[col]
    cells = row[here], (np.cumsum(chosen) - 1)[col[here]], x[here]
    w, t = _ascend(cells, low, high, w[chosen], start, np.zeros(chosen.sum()), RIDGE, rounds)
    z = np.bincount(cells[0], cells[2] * w[cells[1]], minlength=len(texts))
    return OrdinalModel(model.features[chosen], w, _shared_out(z, t, low, high))


def training_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, bool]:
    """(doc_id, text, grade): texts of an expected ``sample_rows`` rows of each class, chosen by a hash of the document id, and whether grades are told apart.

    They are only where a label is above 1. Texts above ``SAMPLE_TEXT_BYTES`` are not learned from.
    """
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("grade"))
    marks = marks.select("doc_id", F.expr(f"cast(greatest(0, least({GRADES - 1}, ceil(grade))) as int)").alias("grade"))
    sizes = {r["grade"]: r["count"] for r in marks.groupBy("grade").count().collect()}
    toxic = sum(n for grade, n in sizes.items() if grade)
    chance = F.expr("pmod(xxhash64(doc_id, 'toxicity'), 1000000) / 1e6")
    chosen = marks.where(chance < F.when(F.col("grade") > 0, min(1.0, sample_rows / max(1, toxic))).otherwise(min(1.0, sample_rows / max(1, sizes.get(0, 0)))))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_TEXT_BYTES)
    return rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "grade"), max(sizes, default=0) > 1


def _bounds(grade: np.ndarray, graded: bool) -> tuple[np.ndarray, np.ndarray]:
    low = grade.astype(np.int64)
    return low, low if graded else np.where(low > 0, GRADES - 1, 0)


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts of the sample and the bounds of their grades, in the memory of the driver."""
    sample, graded = training_sample(docs, labels, sample_rows)
    rows = sample.select("text", "grade").toArrow()
    return rows.column("text").to_pylist(), *_bounds(rows.column("grade").to_numpy(), graded)


def learned(docs: DataFrame, labels: DataFrame) -> OrdinalModel:
    """A model of the sample's texts, in the order of their ids, fitted in one task: the sample is bounded, and the driver gets only the model."""
    sample, graded = training_sample(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        texts, grade = [[x for batch in rows for x in batch.column(c).to_pylist()] for c in ("text", "grade")]
        model = fit_ordinal(texts, *_bounds(np.array(grade, np.int64), graded))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (model.features, model.weights, model.thresholds)], names=["features", "weights", "thresholds"])

    rows = sample.repartition(1).sortWithinPartitions("doc_id", "grade", "text").select("text", "grade")
    found = rows.mapInArrow(run, "features binary, weights binary, thresholds binary").first()
    if found is None:
        return fit_ordinal([], np.zeros(0, np.int64), np.zeros(0, np.int64))
    return OrdinalModel(np.frombuffer(found["features"], np.uint64), np.frombuffer(found["weights"]), np.frombuffer(found["thresholds"]))


def score(docs: DataFrame, model: OrdinalModel, text: str = "text", prefix: str = "") -> DataFrame:
    """The columns of ``docs`` with severity (0 to 3, expected), grade (likeliest) and toxic (severity above 0 with a probability of TOXIC_CUT or more)."""
    added = [prefix + c for c in ("severity", "grade", "toxic")]
    kept = [c for c in docs.columns if c.lower() not in added]
    schema = docs.select(*kept).schema.add(added[0], "double").add(added[1], "integer").add(added[2], "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vectext.slices(batches, "__text"):
            z = model.values(*word_features(batch, "__text"), batch.num_rows)
            above = model.above(z)
            steps = np.concatenate((np.ones((len(z), 1)), above, np.zeros((len(z), 1))), axis=1)
            grade = np.argmax(steps[:, :-1] - steps[:, 1:], axis=1)
            columns = [c for c, n in zip(batch.columns, batch.schema.names) if n != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(above.sum(axis=1)), pa.array(grade, pa.int32()), pa.array(above[:, 0] >= TOXIC_CUT)], names=[*kept, *added]
            )

    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learned(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", "severity", "grade", "toxic")
