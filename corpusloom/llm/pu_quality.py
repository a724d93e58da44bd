"""Text quality by positive-unlabelled learning with the non-negative risk estimator.

The classifier g, a small network on measures of a text's form, minimises

    prior * E_positive[l(g, +1)] + max(0, E_unlabelled[l(g, -1)] - prior * E_positive[l(g, -1)])

with the logistic loss l. Positives are the rows labelled as good, unlabelled are any texts of the corpus; rows
labelled as bad are not used at all. The prior, the share of good rows among the unlabelled, is estimated from the two
samples: of two networks that tell positives from unlabelled each scores the half of the rows that it has not seen. If
u(c) of the unlabelled and p(c) of the positives score at least c, the prior is at most u(c) / p(c); the cut c is taken
where that bound is tightest with its sampling error.

Defined results: null and empty texts are scored as the text without words; without any positive training row all
texts get the score 0; null labels are no labels; several labels of a document count as good if all are; repeated rows
get equal scores; rows with a null id are held out. Only key and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import vectext
from corpusloom.llm.storage import table

#: Bound of the training sample: expected number of positive and of unlabelled rows.
SAMPLE_ROWS = 4000
HIDDEN = 16
CUT = 0.3
#: Signs whose share of a text is a measure of its own.
SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _measures(batch: pa.RecordBatch, text: str) -> np.ndarray:
    """One row of measures a document: shares of byte kinds and signs, and how its words repeat and look."""
    raw, offsets = vectext.utf8(batch.column(text))
    n_docs, size = len(offsets) - 1, np.maximum(1, np.diff(offsets))
    doc = np.repeat(np.arange(n_docs), np.diff(offsets))
    histogram = np.bincount(doc * 256 + raw, minlength=n_docs * 256).reshape(n_docs, 256)
    share = histogram / size[:, None]
    kinds = [share[:, 65:91].sum(1), share[:, 97:123].sum(1), share[:, 48:58].sum(1), share[:, 128:].sum(1), share[:, 32], share[:, 10]]
    signs = share[:, list(SIGNS)]
    low = vectext.LOWER[raw]
    starts, ends, at = vectext.words(low, offsets, vectext.NON_SPACE)
    hashes = vectext.Hasher(low).spans(starts, ends)
    of, counts = np.repeat(np.arange(n_docs), np.diff(at)), np.maximum(1, np.diff(at))
    sums = lambda x: np.bincount(of[: len(x)], x, minlength=n_docs)
    inside = of[1:] == of[:-1]
    repeated = np.bincount(of[1:], inside & (hashes[1:] == hashes[:-1]), minlength=n_docs) / counts
    pairs = np.unique(np.stack((of.astype(np.uint64), hashes)), axis=1)[0] if len(of) else np.zeros(0)
    distinct = np.bincount(pairs.astype(np.int64), minlength=n_docs) / np.sqrt(counts)
    letters = ends - starts
    edges = np.concatenate(([0], np.cumsum((raw >= 65) & (raw <= 90))))
    capital = (edges[ends] - edges[starts]) * 2 > letters
    odd = ~vectext.ALNUM[np.concatenate((raw, [32]))]
    marks = np.concatenate(([0], np.cumsum(odd[:-1])))
    marked = marks[ends] - marks[starts]
    columns = [*kinds, repeated, distinct / 10, sums(letters) / counts / 10, sums(capital) / counts, sums(marked >= 2) / counts, sums(marked == letters) / counts, np.log1p(np.diff(at)) / 10]
    return np.column_stack([np.sqrt(np.column_stack((signs, *columns[:6]))), *columns[6:]])


def measures(texts: list[str | None]) -> np.ndarray:
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
    found = [_measures(part, "text") for part in vectext.slices([batch], "text")]
    return np.concatenate(found) if found else np.zeros((0, len(SIGNS) + 13))


@dataclass
class PuModel:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    trained: bool = True

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.layers[0] + self.layers[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(self.hidden(x) @ self.layers[2] + self.layers[3][0], -500, 500)))


def pu_risk(g: np.ndarray, n: int, prior: float) -> tuple[float, float, np.ndarray]:
    """Both parts of the risk of scores g, the first n of positives, and the gradient of the step: of the risk, or where
    the second part is negative, against that part."""
    p, m = 1 / (1 + np.exp(-g)), len(g) - n
    loss_negative = np.logaddexp(0, g)
    first = prior * np.logaddexp(0, -g[:n]).mean()
    rest = loss_negative[n:].mean() - prior * loss_negative[:n].mean()
    d_rest = np.concatenate((-prior * p[:n] / n, p[n:] / m))
    d_first = np.concatenate((prior * (p[:n] - 1) / n, np.zeros(m)))
    return first, rest, d_first + d_rest if rest >= 0 else -d_rest


def tell_apart(g: np.ndarray, n: int, prior: float = 0.5) -> tuple[float, float, np.ndarray]:
    """The same for telling the first n from the rest, each half of the weight."""
    p, m = 1 / (1 + np.exp(-g)), len(g) - n
    return np.logaddexp(0, -g[:n]).mean() / 2, np.logaddexp(0, g[n:]).mean() / 2, np.concatenate(((p[:n] - 1) / n, p[n:] / m)) / 2


def _network(positive: np.ndarray, unlabelled: np.ndarray, risk: Callable, prior: float, steps: int, rate: float, seed: int) -> PuModel:
    random = np.random.default_rng(seed)
    width = positive.shape[1]
    scale = unlabelled.std(axis=0)
    model = PuModel(unlabelled.mean(axis=0), np.maximum(scale, 1e-3), [random.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)])
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in model.layers]
    standard = (np.concatenate((positive, unlabelled)) - model.mean) / model.scale
    for step in range(1, steps + 1):
        h = np.tanh(standard @ model.layers[0] + model.layers[1])
        _, _, d = risk(np.clip(h @ model.layers[2] + model.layers[3][0], -30, 30), len(positive), prior)
        dh = d[:, None] * model.layers[2] * (1 - h * h)
        for layer, gradient, m in zip(model.layers, (standard.T @ dh, dh.sum(0), h.T @ d, np.array([d.sum()])), moments):
            gradient = gradient + 1e-4 * layer
            m[0] = 0.9 * m[0] + 0.1 * gradient
            m[1] = 0.999 * m[1] + 0.001 * gradient**2
            layer -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return model


def tightest_bound(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior from scores of both samples: u(c) / p(c) at the cut where it and its sampling error are least."""
    cuts = np.unique(positive)
    p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    error = 0.5 / np.sqrt(len(positive)) + 0.5 / np.sqrt(len(unlabelled))
    best = np.argmin((u + error) / p)
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 60, rate: float = 0.01, seed: int = 3) -> float:
    """Share of positives among the unlabelled; the networks stop early, before they learn rows by heart."""
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    scores = []
    for half in (0, 1):
        model = _network(positive[half::2], unlabelled[half::2], tell_apart, 0.5, steps, rate, seed)
        scores.append((model.score(positive[1 - half :: 2]), model.score(unlabelled[1 - half :: 2])))
    return tightest_bound(*(np.concatenate(x) for x in zip(*scores)))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.01, seed: int = 7) -> PuModel:
    """Minimise the non-negative risk; where its second part turns negative, the step goes against it instead."""
    if not len(positive) or not len(unlabelled):
        return PuModel(np.zeros(1), np.ones(1), [], False)
    return _network(positive, unlabelled, pu_risk, prior, steps, rate, seed)


def fold(key: str = "doc_id"):
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(5))


def _measured(rows: DataFrame) -> np.ndarray:
    """The measures of a bounded number of texts, taken where the texts are: only numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vectext.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(_measures(batch, "text")), pa.list_(pa.float64()))], names=["doc_id", "x"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>").orderBy("doc_id", "x").select("x").toArrow().column(0)
    return np.array(found.to_pylist(), float).reshape(-1, len(SIGNS) + 13)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> PuModel:
    """Fit on a sample bounded by ``sample_rows``, chosen by a hash of the id, of rows that are not held out."""
    marks = labels.where("quality is not null").where(fold() != 0).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality > 0")
    good = marks.count()
    if not good:
        return fit_pu(np.zeros((0, 1)), np.zeros((0, 1)), 0.5)
    chance = lambda salt: F.expr(f"pmod(xxhash64(doc_id, '{salt}'), 1000000) / 1e6")
    chosen = marks.where(chance("positive") < min(1.0, sample_rows / good)).select("doc_id")
    rows = docs.select("doc_id", "text").where(fold() != 0)
    n_rows = rows.select("doc_id").count()
    positive = _measured(rows.join(F.broadcast(chosen), "doc_id", "left_semi"))
    unlabelled = _measured(rows.where(chance("unlabelled") < min(1.0, sample_rows / max(1, n_rows))))
    return fit_pu(positive, unlabelled, estimate_prior(positive, unlabelled))


def score(docs: DataFrame, model: PuModel, keys: list[str], text: str = "text") -> DataFrame:
    """The key columns and the score, from 0 to 1, higher for better texts."""
    schema = docs.select(*keys).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vectext.slices(batches, "__text"):
            found = model.score(_measures(batch, "__text"))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(found, pa.float64())], names=[*keys, "score"])

    return docs.select(*keys, F.col(text).alias("__text")).mapInArrow(run, schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    found = score(docs, model, ["doc_id"])
    return found.select("doc_id", F.coalesce(fold() == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
