"""Toxicity by weak supervision.

Voters are words and beginnings of words that occur mostly in labelled toxic documents. A generative label
model takes the votes alone: each voter has an accuracy, the probability of the class when it fires, and voters that
fire together beyond what the class explains (their correlations) share their weight. Fitted by EM, it turns
votes into posterior labels, and a linear classifier is trained on those, over votes and their density.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import no_nulls, slices
from millrace.llm.training import class_counts, held_out, labelled
from millrace.session import store

FOLDS, FOLD = 3, 1
THRESHOLD = 0.7
#: Labelled documents of the toxic and of the other class that the models are fitted on, at most.
FIT_ROWS = {1: 4_000, 0: 8_000}
#: Patterns considered and voters chosen from them.
CANDIDATES, VOTERS = 1_500, 96
#: Lengths of word beginnings that may be voters.
BEGINNINGS = (3, 4, 5, 6)
#: How much a share of clean documents that a pattern hits counts against it, to one of toxic ones.
CAUTION = 12
ROUNDS = 30
_WORD = re.compile(r"\w+")


def patterns(text: str) -> set[str]:
    """The words of a text ("=word") and their beginnings ("part")."""
    words = set(_WORD.findall(text.lower()))
    found = {"=" + w for w in words if len(w) <= 30}
    for n in BEGINNINGS:
        found.update([w[:n] for w in words if len(w) >= n])
    return found


def _count_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1000):
        counts = {0: Counter(), 1: Counter()}
        for y, text in zip(batch.column(0).to_pylist(), no_nulls(batch.column(1)).to_pylist()):
            counts[y].update(patterns(text))
        keys = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), *(pa.array([counts[y][k] for k in keys], pa.int64()) for y in (0, 1))],
            ["pattern", "clean", "toxic"],
        )


def _vote_rows(chosen: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = {p: i for i, p in enumerate(chosen)}
    for batch in slices(batches, 1000):
        votes, sizes = [], []
        for text in no_nulls(batch.column(1)).to_pylist():
            own = patterns(text)
            bits = np.zeros(len(chosen), bool)
            bits[[index[p] for p in own & index.keys()]] = True
            votes.append(np.packbits(bits).tobytes())
            sizes.append(sum(p[0] == "=" for p in own))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(votes, pa.binary()), pa.array(sizes, pa.int64())], ["y", "votes", "words"]
        )


def choose_voters(votes: np.ndarray, y: np.ndarray, most: int = VOTERS) -> list[int]:
    """Columns of ``votes`` that tell the classes apart, none nearly the same as one chosen before it.

    Each next voter is the one that adds most: toxic documents count less the more voters they have."""
    toxic, clean = votes[y == 1].astype(float), votes[y == 0].astype(float)
    cost = clean.sum(axis=0) * (len(toxic) / max(len(clean), 1))
    need = np.ones(len(toxic))
    chosen: list[int] = []
    open_ = np.ones(votes.shape[1], bool)
    norms = np.sqrt(toxic.sum(axis=0))
    while len(chosen) < most and open_.any():
        gain = np.where(open_, need @ toxic - CAUTION * cost, -np.inf)
        best = int(np.argmax(gain))
        if gain[best] < max(1.0, 0.002 * len(toxic)):
            break
        alike = (toxic[:, best] @ toxic) / np.maximum(norms * norms[best], 1e-9) >= 0.97
        # Of patterns that find the same toxic documents, the one that hits fewest others.
        best = int(np.argmin(np.where(alike & open_, cost, np.inf)))
        chosen.append(best)
        open_ &= ~alike
        open_[best] = False
        need *= np.where(toxic[:, best] > 0, 0.6, 1.0)
    return chosen


@dataclass
class LabelModel:
    """How often each voter is right when it fires, and the weight its correlations leave it.

    A voter that does not fire abstains and says nothing: voters of other languages are no witnesses."""

    accuracies: np.ndarray
    weights: np.ndarray
    quiet: float  # share of toxic documents among those without a vote

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        base = np.log(self.quiet / (1 - self.quiet))
        each = (np.log(self.accuracies / (1 - self.accuracies)) - base) * self.weights
        # However many speak for one document, together they say at least what the best of them says.
        best = (votes * (each / self.weights)).max(axis=1, initial=0.0)
        odds = base + np.maximum(votes @ each, best)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit_label_model(
    votes: np.ndarray, start: np.ndarray, rounds: int = ROUNDS, stands_for: np.ndarray | None = None
) -> LabelModel:
    """EM over the votes from first guesses ``start`` of the labels; each row is as ``stands_for`` rows (1)."""
    votes, p = votes.astype(float), start.astype(float)
    of = np.ones(len(votes)) if stands_for is None else stands_for
    fired = of @ votes
    silent = votes.sum(axis=1) == 0
    model = None
    for _ in range(rounds):
        accuracies = (((p * of) @ votes + 1.0) / (fired + 2.0)).clip(0.02, 0.98)
        # Correlations given the class: what two voters share beyond their rates, by posterior weight.
        together = np.zeros((votes.shape[1],) * 2)
        for w in ((1 - p) * of, p * of):
            rest = votes - (w @ votes) / max(w.sum(), 1e-9)
            cov = (rest * w[:, None]).T @ rest / max(w.sum(), 1e-9)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            together += np.clip(cov / np.outer(sd, sd), 0, 1) * (w.sum() / of.sum())
        np.fill_diagonal(together, 0)
        weights = 1 / (1 + np.where(together > 0.1, together, 0).sum(axis=1))
        quiet = float(np.clip(np.average(p[silent], weights=of[silent]) if silent.any() else 0.01, 0.001, 0.05))
        model = LabelModel(accuracies, weights, quiet)
        new = model.posterior(votes)
        if np.abs(new - p).max() < 1e-4:
            break
        p = new
    return model


def fit_linear(
    x: np.ndarray, p: np.ndarray, ridge: float = 0.1, steps: int = 25, stands_for: np.ndarray | None = None
) -> np.ndarray:
    """Weights (the last is the constant) of a logistic model of the posteriors, by Newton's method; each row
    is as ``stands_for`` rows (1)."""
    of = np.ones(len(x)) if stands_for is None else stands_for
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (of * (q - p)) + penalty * w
        curve = (x * (of * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def features(votes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Votes, whether there is one, whether two, their number and that in view of the text's distinct words."""
    n = votes.sum(axis=1, keepdims=True)
    return np.hstack([votes, n > 0, n > 1, np.log1p(n), n / np.sqrt(np.maximum(words, 1))[:, None]])


@dataclass
class Model:
    constant: float | None
    voters: list[str] = field(default_factory=list)
    weights: np.ndarray = None

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        index = {p: i for i, p in enumerate(self.voters)}
        votes, words = np.zeros((len(texts), len(index))), np.zeros(len(texts))
        for row, text in enumerate(texts):
            own = patterns(text)
            votes[row, [index[p] for p in own & index.keys()]] = 1
            words[row] = sum(p[0] == "=" for p in own)
        x = features(votes, words)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, rows: dict[int, int] = FIT_ROWS) -> Model:
    """The classifier of ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, held-out rows left aside."""
    known = store(labelled(docs, labels, "toxic", FOLDS, FOLD, rows), "labelled")
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = n.get(0, 0), n.get(1, 0)
    every = class_counts(docs, labels, "toxic", FOLDS, FOLD)
    share_of_all = (every[1] + 1) / (every[0] + every[1] + 2) if every[0] + every[1] else 0.0
    if not n_clean or not n_toxic:
        return Model(constant=share_of_all)
    counted = (
        known.mapInArrow(_count_patterns, "pattern string, clean long, toxic long")
        .groupBy("pattern")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    share = lambda c, n: (F.col(c) + 0.5) / (n + 1.0)
    least = max(2, n_toxic // 500)
    best = (
        counted.filter((F.col("toxic") >= least) & (share("toxic", n_toxic) > 6 * share("clean", n_clean)))
        .orderBy(F.desc(share("toxic", n_toxic) - CAUTION * share("clean", n_clean)), F.length("pattern"), "pattern")
        .limit(CANDIDATES)
        .collect()
    )
    if not best:
        return Model(constant=share_of_all)
    chosen = [r["pattern"] for r in best]
    rows_ = known.mapInArrow(partial(_vote_rows, chosen), "y int, votes binary, words long").collect()
    y = np.array([r["y"] for r in rows_])
    words = np.array([r["words"] for r in rows_], float)
    votes = np.unpackbits(
        np.array([np.frombuffer(r["votes"], np.uint8) for r in rows_]), axis=1, count=len(chosen)
    ).astype(bool)
    own = choose_voters(votes, y)
    if not own:
        return Model(constant=share_of_all)
    votes = votes[:, own].astype(float)
    # First guess: how strongly the fired voters point at the class by their rates among labelled rows.
    lift = np.log((votes[y == 1].mean(axis=0) + 0.01) / (votes[y == 0].mean(axis=0) + 0.01))
    start = 1 / (1 + np.exp(-(votes @ lift - 2.0)))
    # The sample has at most so many rows of each class: each stands for its share of all the class's rows.
    stands_for = np.where(y == 1, every[1] / n_toxic, every[0] / n_clean)
    model = fit_label_model(votes, start, stands_for=stands_for)
    weights = fit_linear(features(votes, words), model.posterior(votes), stands_for=stands_for)
    return Model(None, [chosen[i] for i in own], weights)


def _score_rows(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        scores = model.scores(no_nulls(batch.column(1)).to_pylist())
        predicted = (scores >= THRESHOLD).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(scores), pa.array(predicted)],
            ["doc_id", "held_out", "score", "predicted"],
        )


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``.

    Null texts score as empty ones do. Without labels of both classes, or without a pattern that tells them
    apart, every score is the smoothed share of toxic labels (0 without labels). An empty table gives no rows.
    """
    model = fit(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"))
    return rows.mapInArrow(
        partial(_score_rows, model), f"doc_id {kind}, held_out boolean, score double, predicted int"
    )
