"""Document quality by a linear-chain conditional random field over lines.

Every line has features of its own and of the lines before and after it. The field labels each line
good or bad. Labels are known for documents only, so the lines' are latent: a document's label is
evidence for each of its lines, of a strength that lets features and neighbours overrule it. The field
is first fitted to lines that all have their document's label, then by expectation and maximisation:
the lines' and neighbouring pairs' marginals given the evidence are what the next gradient steps are
fitted to, so a good line of a bad document can become good, and the weights of neighbouring labels
learn how labels change. A document's quality is the mean of its lines' marginal probabilities of being
good, without any evidence, from the forward-backward recursion, weighted by their lengths and sharpened
by a logistic curve fitted on the same documents.

Cases: null and empty texts are one empty line. Lines end at \\n. Without labels of both kinds
every score is the share of good ones (0.5 without any). Repeated rows give a row each. An empty table
gives no rows. Other columns are not read. Memory: the line features of BLOCK lines, and a few numbers a
line of the documents whose recursions run together (CELLS lines with padding, or one longer document).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, shared_value
from .training import TRAIN_ROWS, labelled_sample, sigmoid

SLICE = 256
_WORD, _SYMBOL, _DIGIT, _UPPER, _LETTER = (re.compile(p) for p in (r"\S+", r"[^\w\s]", r"\d", r"[A-ZÀ-ÖØ-Þ]", r"[^\W\d_]"))
_STOPS, _MARKS = re.compile(r"[.!?…][\"')\]]*$"), re.compile(r"[!?]{2,}|[#$%&*|~^=<>{}\\]")
OWN = 12
BUCKETS = np.array([0.02, 0.1, 0.25, 0.5])


def line_values(line: str) -> list[float]:
    """Shares and rates of a line that don't depend on its language."""
    words = _WORD.findall(line)
    n, chars = max(1, len(words)), max(1, len(line))
    letters = max(1, len(_LETTER.findall(line)))
    same = sum(a == b for a, b in zip(words, words[1:]))
    return [
        min(1.0, len(line) / 400),
        min(1.0, len(words) / 60),
        len(_SYMBOL.findall(line)) / chars,
        min(1.0, len(_MARKS.findall(line)) / n),
        len(_DIGIT.findall(line)) / chars,
        len(_UPPER.findall(line)) / letters,
        same / n,
        1 - len(set(words)) / n,
        min(1.0, letters / n / 12),
        float(not _STOPS.search(line)),
        float(not words),
        sum(len(w) == 1 for w in words) / n,
    ]


def observed(lines: list[str], before: str | None = None, after: str | None = None) -> np.ndarray:
    """lines x features: the values, thresholds of them, and the values of the lines before and after.

    ``before`` and ``after`` are the lines around these, None at the document's ends.
    """
    around = [line_values(x) if x is not None else [0.0] * OWN for x in (before, after)]
    own = np.array([around[0], *(line_values(x) for x in lines), around[1]])
    left, own, right = own[:-2], own[1:-1], own[2:]
    steps = (own[:, :, None] > BUCKETS).reshape(len(lines), -1).astype(float)
    earlier = [before, *lines[:-1]]
    same = np.array([[float(x == y), float(y is None), float(after is None and i == len(lines) - 1)] for i, (x, y) in enumerate(zip(lines, earlier))])
    return np.hstack([own, steps, left, right, same, np.ones((len(lines), 1))])


FEATURES = OWN * (1 + len(BUCKETS) + 2) + 4
#: Lines whose features are held at once; padded lines of documents whose recursions run together.
BLOCK, CELLS = 4096, 1 << 17


def _odds(s: np.ndarray, real: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds of documents x places; s: the lines' own log-odds, real: which places are lines."""
    forward, backward = np.zeros(s.shape), np.zeros(s.shape)
    (t00, t01), (t10, t11) = step
    forward[:, 0] = s[:, 0]
    for i in range(1, s.shape[1]):
        f = forward[:, i - 1]
        forward[:, i] = np.where(real[:, i], s[:, i] + np.logaddexp(t01, f + t11) - np.logaddexp(t00, f + t10), 0.0)
    for i in range(s.shape[1] - 2, -1, -1):
        g = s[:, i + 1] + backward[:, i + 1]
        backward[:, i] = np.where(real[:, i + 1], np.logaddexp(t10, g + t11) - np.logaddexp(t00, g + t01), 0.0)
    return forward, backward


def _odds_of_one(s: list[float], step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one document, without arrays a place."""
    (t00, t01), (t10, t11) = np.exp(step).tolist()
    exp, log = math.exp, math.log

    def passed(f: float, a: float, b: float, c: float, d: float) -> float:
        if f > 0:
            e = exp(-f)
            return log((a * e + b) / (c * e + d))
        e = exp(f)
        return log((a + b * e) / (c + d * e))

    n = len(s)
    forward, backward = np.empty(n), np.zeros(n)
    f = forward[0] = s[0]
    for i in range(1, n):
        f = forward[i] = s[i] + passed(f, t01, t11, t00, t10)
    g = 0.0
    for i in range(n - 2, -1, -1):
        g = backward[i] = passed(s[i + 1] + g, t10, t11, t00, t01)
    return forward, backward


def recursions(score: np.ndarray, sizes: np.ndarray, step: np.ndarray, with_pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Every line's probability to be good and, if asked for, the summed marginals of neighbouring labels (2 x 2).

    ``score`` holds the lines' log-odds of being good. Documents are padded to one length within groups of
    similar ones that have CELLS lines together, so the loop runs over places; a longer one runs alone.
    """
    marginals, pairs = np.empty(len(score)), np.zeros((2, 2))
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    order, at = np.argsort(sizes, kind="stable"), 0
    while at < len(order):
        many = 1
        while at + many < len(order) and (many + 1) * int(sizes[order[at + many]]) <= CELLS:
            many += 1
        docs = order[at : at + many]
        at += many
        n, longest = sizes[docs], int(sizes[docs].max())
        if many < 8 and longest > 64:
            for d, k in zip(docs, n):
                s = score[start[d] : start[d] + k]
                f, g = _odds_of_one(s.tolist(), step)
                marginals[start[d] : start[d] + k] = sigmoid(f + g)
                if with_pairs and k > 1:
                    pairs += _pairs(f[None, :], (s + g)[None, :], np.ones((1, k), bool), step)
            continue
        place = np.arange(longest)
        line = np.minimum(start[docs][:, None] + place, len(score) - 1)
        real = place < n[:, None]
        s = np.where(real, score[line], 0.0)
        f, g = _odds(s, real, step)
        marginals[line[real]] = sigmoid(f + g)[real]
        if with_pairs and longest > 1:
            pairs += _pairs(f, s + g, real, step)
    return marginals, pairs if with_pairs else None


def _pairs(forward: np.ndarray, ahead: np.ndarray, real: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Marginals of neighbouring labels, summed; forward: of the first line, ahead: its own and backward of the second."""
    f, g = forward[:, :-1], ahead[:, 1:]
    q = np.stack([np.zeros_like(f) + step[0, 0], g + step[0, 1], f + step[1, 0], f + g + step[1, 1]])
    q = np.exp(q - q.max(axis=0))
    q = np.where(real[:, 1:], q / q.sum(axis=0), 0.0)
    return q.sum(axis=(1, 2)).reshape(2, 2)


#: Log-odds that a document's label gives each of its lines when the lines' labels are latent.
EVIDENCE = 2.0


class Field:
    """Weights of the lines' features and of neighbouring labels (bad, good), and the curve over documents."""

    def __init__(self, weights: np.ndarray, step: np.ndarray, curve: tuple[float, float] | None, share: float = 0.5):
        self.weights, self.step, self.curve, self.share = weights, step, curve, share

    @classmethod
    def fit(cls, x: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, good: np.ndarray, first: int = 60, turns: int = 3, rounds: int = 30, penalty: float = 1e-3, evidence: float = EVIDENCE) -> Field:
        """x: lines x features, lengths of lines, sizes and labels of documents (1 good).

        ``first`` gradient steps on the documents' labels, then ``turns`` times the expectations under the
        evidence and ``rounds`` steps towards them.
        """
        share = float(good.mean()) if len(good) else 0.5
        field = cls(np.zeros(x.shape[1]), np.zeros((2, 2)), None, share)
        if not len(good) or share in (0.0, 1.0):
            return field
        doc = np.repeat(np.arange(len(sizes)), sizes)
        label = good[doc].astype(float)
        truth, seen = label, np.zeros((2, 2))
        for k in (0, 1):
            seen[k, k] = (sizes[good == k] - 1).sum()
        # a line weighs so that every document counts the same
        weight = 1 / sizes[doc]
        m = [np.zeros_like(field.weights), np.zeros_like(field.step)]
        v = [np.zeros_like(field.weights), np.zeros_like(field.step)]
        t = 0
        for turn in range(turns + 1):
            if turn:
                truth, seen = recursions(x @ field.weights + evidence * (2 * label - 1), sizes, field.step, True)
            for _ in range(rounds if turn else first):
                t += 1
                p, pairs = recursions(x @ field.weights, sizes, field.step, True)
                slope = [((truth - p) * weight) @ x / len(sizes) - penalty * field.weights, (seen - pairs) / len(x) - penalty * field.step]
                for k, held in enumerate((field.weights, field.step)):
                    m[k] = 0.9 * m[k] + 0.1 * slope[k]
                    v[k] = 0.999 * v[k] + 0.001 * slope[k] ** 2
                    held += 0.1 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        field.curve = _curve(field.means(recursions(x @ field.weights, sizes, field.step)[0], sizes, lengths), good)
        return field

    def line_odds(self, lines: list[str]) -> np.ndarray:
        """The log-odds of a text's lines by their features, BLOCK lines at a time."""
        parts = []
        for i in range(0, len(lines), BLOCK):
            j = min(len(lines), i + BLOCK)
            x = observed(lines[i:j], lines[i - 1] if i else None, lines[j] if j < len(lines) else None)
            parts.append(x.astype(np.float32) @ self.weights)
        return np.concatenate(parts)

    def marginals(self, odds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The probability of every line to be good."""
        return recursions(odds, sizes, self.step)[0]

    @staticmethod
    def means(marginals: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Length-weighted means of the marginals by document."""
        doc = np.repeat(np.arange(len(sizes)), sizes)
        weight = lengths + 1.0
        return np.bincount(doc, marginals * weight, len(sizes)) / np.bincount(doc, weight, len(sizes))

    def scores(self, marginals: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(sizes), self.share)
        a, b = self.curve
        return sigmoid(a * self.means(marginals, sizes, lengths) + b)


def _curve(mean: np.ndarray, good: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and place of the logistic curve of the labels over the means (Newton steps, slightly penalised)."""
    x = np.column_stack([mean, np.ones(len(mean))])
    w, weight = np.zeros(2), np.where(good == 1, 0.5 / max(good.sum(), 1), 0.5 / max((1 - good).sum(), 1)) * len(good)
    for _ in range(rounds):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - good)) + 0.01 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        w -= np.linalg.solve(h, g)
    return float(max(w[0], 0.0)), float(w[1])


def read_lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def train(docs: DataFrame, labels: DataFrame, keep: Column | None = None, rows: int = TRAIN_ROWS) -> Field:
    """A field fitted on the driver on all lines of at most ``rows`` documents with labels.quality, of labels where ``keep`` holds."""
    sample = labelled_sample(docs, labels, ["quality"], keep, rows)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_lines(t) for t in batch.column("text").to_pylist()]
            x = [observed(x).astype(np.float32).tobytes() for x in found]
            lengths = [np.array([len(y) for y in x], np.float32).tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(x, pa.binary()), pa.array(lengths, pa.binary())], ["doc_id", "quality", "x", "lengths"])

    schema = T.StructType([sample.schema["doc_id"], T.StructField("quality", T.IntegerType()), T.StructField("x", T.BinaryType()), T.StructField("lengths", T.BinaryType())])
    got = mapped(sample, lines, schema).toArrow().sort_by("doc_id")
    x = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in got.column("x").to_pylist()]
    if not x:
        return Field.fit(np.zeros((0, FEATURES)), np.empty(0, int), np.empty(0), np.empty(0))
    lengths = np.concatenate([np.frombuffer(b, np.float32) for b in got.column("lengths").to_pylist()])
    return Field.fit(np.concatenate(x), np.array([len(a) for a in x]), lengths, got.column("quality").to_numpy().astype(float))


def quality(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and lines (the probability of each line to be good) of every row."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([read.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("lines", T.ArrayType(T.FloatType()))])
    shared = shared_value(docs.sparkSession, field)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Field = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                found = [read_lines(t) for t in part.column(1).to_pylist()]
                sizes = np.array([len(x) for x in found])
                lengths = np.array([len(y) for lines in found for y in lines], float)
                good = f.marginals(np.concatenate([f.line_odds(lines) for lines in found]), sizes)
                each = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(good.astype(np.float32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(f.scores(good, sizes, lengths)), each], schema.names)

    return mapped(read, scored, schema)
