"""What the trained operators share: a bounded sample of labelled rows, and linear models in numpy."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most: those with the least hashes.
TRAIN_ROWS = 4_000


def crc(id_col: Column) -> Column:
    """CRC-32 of the id as text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))


def crc_of(doc_id: object) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], keep: Column | None = None, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text and the label columns of at most so many labelled rows, the same ones every time.

    Rows without any of the labels are left out; a row labelled more than once has its largest labels. Of
    rows that repeat a labelled id one text is taken, that with the least hash, so ``rows`` bounds the sample
    whatever the tables hold. The chosen labels have the same bound, so they are broadcast.
    """
    known = labels.where("doc_id is not null").where(" and ".join(f"{c} is not null" for c in columns))
    known = known.where(keep) if keep is not None else known
    known = known.groupBy("doc_id").agg(*(F.max(c).cast("int").alias(c) for c in columns))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", *columns).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", *columns)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Sparse:
    """Rows of present features, as flat feature numbers with the row of each."""

    def __init__(self, n: int, row: np.ndarray, feature: np.ndarray):
        self.n, self.row, self.feature = n, row, feature

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Sparse:
        return cls.flat(np.array([len(r) for r in rows], np.int64), np.concatenate(rows) if rows else np.empty(0, np.int32))

    @classmethod
    def flat(cls, sizes: np.ndarray, feature: np.ndarray) -> Sparse:
        return cls(len(sizes), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), feature.astype(np.int32))

    def common(self, least_rows: int) -> Sparse:
        """Without the features of fewer rows; it takes most of the memory that rare ones need."""
        if not len(self.feature):
            return self
        keep = np.bincount(self.feature)[self.feature] >= least_rows
        return Sparse(self.n, self.row[keep], self.feature[keep])

    def take(self, chosen: np.ndarray) -> Sparse:
        """The rows with these numbers, renumbered in order."""
        number = np.full(self.n, -1, np.int32)
        number[chosen] = np.arange(len(chosen))
        row = number[self.row]
        keep = row >= 0
        return Sparse(len(chosen), row[keep], self.feature[keep])

    def only(self, features: np.ndarray) -> Sparse:
        """These (sorted) features alone, renumbered in order."""
        at = np.minimum(np.searchsorted(features, self.feature), max(0, len(features) - 1))
        keep = features[at] == self.feature if len(features) else np.zeros(len(self.feature), bool)
        return Sparse(self.n, self.row[keep], at[keep])

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.feature], self.n)

    def transposed_times(self, values: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.feature, values[self.row], size)


def telling_features(x: Sparse, y: np.ndarray, most: int, least_rows: int = 3) -> np.ndarray:
    """The features, sorted, with the largest chi-squared statistic among those of enough rows."""
    if not len(x.feature):
        return np.empty(0, np.int64)
    size = int(x.feature.max()) + 1
    n1 = np.bincount(x.feature, y[x.row], size)
    n = np.bincount(x.feature, minlength=size)
    share = y.mean()
    expected = n * share
    score = np.where(n >= least_rows, (n1 - expected) ** 2 / np.maximum(expected * (1 - share), 1e-9), -1.0)
    best = np.argsort(-score, kind="stable")[:most]
    return np.sort(best[score[best] > 3.0])


class Logistic:
    """Logistic regression on present features and a few dense columns, with an L1 penalty (FISTA)."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, dense: np.ndarray, bias: float):
        self.features, self.weights, self.dense, self.bias = features, weights, dense, bias

    @classmethod
    def fit(cls, x: Sparse, extra: np.ndarray, y: np.ndarray, most: int = 4000, strength: float = 0.009, rounds: int = 300, settled: float = 2e-3) -> Logistic:
        """The penalty falls with the root of the number of rows, as the noise of a weight does. Ends after so many rounds, or when one moves the weights by no more than the share ``settled`` of their norm."""
        k = extra.shape[1]
        if not len(y) or y.min() == y.max():
            share = float(y.mean()) if len(y) else 0.0
            return cls(np.empty(0, np.int64), np.empty(0), np.zeros(k), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
        chosen = telling_features(x, y, most)
        part, m, n = x.only(chosen), len(chosen), len(y)
        penalty = strength / n**0.5
        w, bias = np.zeros(m + k), float(np.log(y.mean() / (1 - y.mean())))
        ahead, ahead_bias, t = w.copy(), bias, 1.0
        # the step is that of the largest row, found by a few power iterations
        v = np.ones(m + k)
        for _ in range(12):
            u = part.times(v[:m]) + extra @ v[m:]
            v = np.concatenate([part.transposed_times(u, m), extra.T @ u])
            size = np.linalg.norm(v)
            v /= max(size, 1e-12)
        step = 1 / max(0.25 * (size / n + 1), 1e-9)
        for _ in range(rounds):
            error = sigmoid(part.times(ahead[:m]) + extra @ ahead[m:] + ahead_bias) - y
            slope = np.concatenate([part.transposed_times(error, m), extra.T @ error]) / n
            moved = ahead - step * slope
            new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
            new_bias = ahead_bias - step * error.mean()
            t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
            ahead, ahead_bias = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
            moved_by, norm = np.linalg.norm(new - w) + abs(new_bias - bias), np.linalg.norm(new) + abs(new_bias)
            w, bias, t = new, new_bias, t_new
            if moved_by <= settled * norm:
                break
        used = w[:m] != 0
        return cls(chosen[used], w[:m][used], w[m:], bias)

    def scores(self, x: Sparse, extra: np.ndarray) -> np.ndarray:
        linear = x.only(self.features).times(self.weights) if len(self.features) else np.zeros(x.n)
        return sigmoid(linear + extra @ self.dense + self.bias)
