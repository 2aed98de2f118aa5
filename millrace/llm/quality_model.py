"""Quality classifier: regularised quadratic discriminant over document statistics.

Each document becomes a short vector of transformed statistics. Of each class the mean and the covariance
are taken from sums that tasks send, and the covariance is shrunk towards its diagonal and the pooled
one. The score is the difference of the two log densities, from Mahalanobis distances through
Cholesky factors that are computed once, put on a scale from 0 to 1 by a logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import no_nulls, quoted, slices
from millrace.llm.training import class_counts, held_out, labelled

FOLDS, FOLD = 4, 2
THRESHOLD = 0.7
#: Labelled documents of each class that the model is fitted on, at most.
FIT_ROWS = 12_000
#: Shares of the pooled covariance and of the diagonal in each class's own.
POOLED, DIAGONAL = 0.02, 0.02
#: Standard deviations beyond which a statistic counts no further.
REACH = 12.0
_BYTES = np.arange(256)
_CLASS = {
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "sign": np.isin(_BYTES, list(b"#*$%&|<>{}[]\\~^_=+@")),
    "stop": np.isin(_BYTES, list(b".,;:!?")),
    "shout": np.isin(_BYTES, list(b"!?")),
}
_GROUPS = np.array([_CLASS[k] for k in _CLASS], float)
SIZE = 12


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text; those of an empty one are as of a text of no words."""
    data = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n = max(len(words), 1)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    digit, upper, lower, sign, stop, shout = _GROUPS @ counts
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    letters = max(upper + lower, 1)
    return [
        np.log1p(len(words)),
        np.log(max(sizes.mean(), 0.5)),
        np.log1p(sizes.std()),
        np.sqrt(sign / n),
        np.sqrt(upper / letters),
        np.log1p(stop / n),
        np.sqrt(shout / n),
        np.sqrt(digit / max(len(data), 1)),
        distinct / n,
        pairs / max(len(words) - 1, 1) if len(words) > 1 else 1.0,
        1.0 - len(set(lines)) / len(lines) if lines else 0.0,
        np.log1p(n / max(len(lines), 1)),
    ]


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and class: rows, sums and sums of products."""
    totals = {y: np.zeros(1 + SIZE + SIZE * SIZE) for y in (0, 1)}
    for batch in slices(batches):
        ys = batch.column(0).to_numpy(zero_copy_only=False)
        texts = no_nulls(batch.column(1)).to_pylist()
        x = np.array([statistics(t) for t in texts]).reshape(-1, SIZE)
        for y, total in totals.items():
            own = x[ys == y]
            total += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    rows = [(y, i, float(v)) for y, total in totals.items() for i, v in enumerate(total)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.float64()))], ["y", "i", "v"]
    )


@dataclass
class Model:
    """Class means and Cholesky factors over standardised statistics; ``constant`` if a class is missing."""

    constant: float | None
    centre: np.ndarray = None
    scale: np.ndarray = None
    means: np.ndarray = None
    factors: list = None
    log_dets: list = None
    log_prior: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.clip((x - self.centre) / self.scale, -REACH, REACH)
        dens = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets):
            solved = np.linalg.solve(factor, (z - mean).T)
            dens.append(-0.5 * (solved**2).sum(axis=0) - log_det)
        odds = np.clip(dens[1] - dens[0] + self.log_prior, -30, 30)
        return 1 / (1 + np.exp(-odds))


def fit_moments(moments: dict[int, np.ndarray], counts: dict[int, int]) -> Model:
    """The model of the sampled rows' ``moments``; how frequent each class is, is told by ``counts`` of all rows."""
    n = np.array([moments[y][0] for y in (0, 1)])
    every = np.array([counts[y] for y in (0, 1)], float)
    if min(n) < 2:
        return Model(constant=float((every[1] + 1) / (every.sum() + 2)))
    means = np.array([moments[y][1 : 1 + SIZE] / n[y] for y in (0, 1)])
    covs = [
        moments[y][1 + SIZE :].reshape(SIZE, SIZE) / n[y] - np.outer(means[y], means[y]) for y in (0, 1)
    ]
    # Standardised by the good class: the reach is then that of good documents.
    centre, scale = means[1], np.sqrt(np.maximum(np.diag(covs[1]), 1e-4))
    means = (means - centre) / scale
    covs = [c / np.outer(scale, scale) for c in covs]
    pooled = (covs[0] * every[0] + covs[1] * every[1]) / every.sum()
    factors = []
    for y, c in enumerate(covs):
        few = SIZE / (SIZE + n[y])  # small classes lean more on the pooled covariance
        c = (1 - POOLED - few * (1 - POOLED)) * c + (POOLED + few * (1 - POOLED)) * pooled
        c = (1 - DIAGONAL) * c + DIAGONAL * np.diag(np.diag(c)) + 0.05 * np.eye(SIZE)
        factors.append(np.linalg.cholesky(c))
    log_dets = [float(np.log(np.diag(f)).sum()) for f in factors]
    return Model(None, centre, scale, means, factors, log_dets, float(np.log(every[1] / every[0])))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """The model of ``docs(doc_id, text)`` and ``labels(doc_id, quality)``, held-out rows left aside."""
    known = labelled(docs, labels, "quality", FOLDS, FOLD, {0: rows, 1: rows})
    sums = known.mapInArrow(_moments, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v"))
    moments = {y: np.zeros(1 + SIZE + SIZE * SIZE) for y in (0, 1)}
    for r in sums.collect():  # two classes' sums
        moments[r["y"]][r["i"]] = r["v"]
    return fit_moments(moments, class_counts(docs, labels, "quality", FOLDS, FOLD))


def _score_texts(model: Model, texts: list[str]) -> np.ndarray:
    return model.scores(np.array([statistics(t) for t in texts]).reshape(-1, SIZE))


def _score_rows(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        scores = _score_texts(model, no_nulls(batch.column(1)).to_pylist())
        predicted = (scores >= THRESHOLD).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(scores), pa.array(predicted)],
            ["doc_id", "held_out", "score", "predicted"],
        )


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``.

    Null texts score as empty ones do. Without labels of both classes every score is the smoothed share
    of label 1. Repeated rows score alike; an empty table gives no rows.
    """
    model = fit(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"))
    return rows.mapInArrow(
        partial(_score_rows, model), f"doc_id {kind}, held_out boolean, score double, predicted int"
    )


def _filter_rows(model: Model, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        scores = _score_texts(model, no_nulls(batch.column(at)).to_pylist())
        yield batch.filter(pa.array(scores >= THRESHOLD))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model predicts as good, all columns as they are."""
    at = [c.lower() for c in docs.columns].index("text")
    return docs.select(*[quoted(c) for c in docs.columns]).mapInArrow(
        partial(_filter_rows, model, at), docs.schema
    )
