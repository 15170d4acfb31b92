"""Toxicity by a classifier chain.

Categories are predicted one after the other. Each has a linear model on the words and word starts of
the text, and on the probabilities of the categories before it. A model is trained with out-of-fold
predictions of those, so it sees earlier probabilities of the quality it will see later. Copies and most
near copies fall into one fold, as folds depend on the least n-gram hash of a text. Features are hashed
and present or absent, so a long text isn't diluted; the L1 penalty keeps the few that tell.

Where the labels know toxic rows but not their kind, sub-categories are derived: the words and word
starts that mark toxic rows are gathered into terms, by the rows they occur in, and the terms are dealt
out to ``families``; a toxic row belongs to every family of which it holds a term. The chain then goes
from the families to the label itself.

Cases: null and empty texts have no features and get the models' base rates. A category with one value
gets that value's rate; without any labels all probabilities are 0. Repeated rows give a row each, ties
at the threshold are the caller's. An empty table gives no rows. Only the text is read by Python; other
columns stay as they are, whatever their names, but for columns of the names p_<category>, which are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, fresh, keeps_cache, mapped, shared_value, tidy
from .shingles import shingle_sets
from .training import TRAIN_ROWS, Logistic, Sparse, labelled_sample, telling_features

BITS = 20
FOLDS = 5
#: Lengths of the word starts that count beside the word.
STARTS = (3, 4, 5, 6)
#: Counts from which an occurrence is a feature of its own.
TIERS = (1, 2, 4)
SLICE, MEMO = 256, 100_000
_WORD = re.compile(r"\w+")
_MEMO: dict[str, tuple[int, ...]] = {}
keeps_cache("toxicity", _MEMO.clear)


def word_features(word: str) -> tuple[int, ...]:
    found = _MEMO.get(word)
    if found is None:
        if len(_MEMO) >= MEMO:
            _MEMO.clear()
        names = [f"={word}", *(f"^{word[:k]}" for k in STARTS if k <= len(word))]
        found = _MEMO[word] = tuple(xxhash.xxh32_intdigest(n) & ((1 << BITS) - 1) for n in names)
    return found


def features(text: str | None) -> np.ndarray:
    """The hashed features of a text, sorted: a word or word start that occurs, one that does so TIERS[1] times, and so on."""
    times = Counter(_WORD.findall((text or "").lower()))
    if not times:
        return np.empty(0, np.int64)
    each = list(map(word_features, times))
    found = np.fromiter(chain.from_iterable(each), np.int64)
    number = np.repeat(np.fromiter(times.values(), np.int64, len(times)), np.fromiter(map(len, each), np.int64, len(each)))
    order = np.argsort(found)
    found, number = found[order], number[order]
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    found, number = found[first] * len(TIERS), np.add.reduceat(number, first)
    return np.sort(np.concatenate([found[number >= least] + k for k, least in enumerate(TIERS)]))


def group_of(text: str | None) -> int:
    """The least hash of the text's n-grams: the same for copies, and for a pair of near copies as likely as they are similar."""
    grams = shingle_sets([text])[0]
    return int(grams[0] >> np.uint64(1)) if len(grams) else 0


def families(x: Sparse, y: np.ndarray, many: int, purity: float = 0.9, alike: float = 0.5, most: int = 512) -> np.ndarray:
    """rows x many: which derived sub-categories the rows with label 1 belong to.

    Features at least so pure are taken by falling number of rows; one whose rows are alike those of an
    earlier one is the same term, and each new term goes to the next family.
    """
    out = np.zeros((x.n, many))
    if not len(y) or not y.any():
        return out
    telling = telling_features(x, y, most)
    if not len(telling):
        return out
    part = x.only(telling)
    has = np.zeros((len(telling), x.n), bool)
    has[part.feature, part.row] = True
    n, good = has.sum(axis=1), has[:, y > 0].sum(axis=1)
    terms: list[np.ndarray] = []
    for k in np.lexsort((telling, -good)):
        if good[k] < purity * n[k]:
            continue
        rows = has[k]
        home = next((i for i, t in enumerate(terms) if (rows & t).sum() >= alike * (rows | t).sum()), None)
        if home is None:
            home = len(terms)
            terms.append(rows)
        out[rows & (y > 0), home % many] = 1
    return out


class Chain:
    """Models of categories in order, each fed the probabilities of those before it."""

    def __init__(self, categories: list[str], models: list[Logistic]):
        self.categories, self.models = categories, models

    @classmethod
    def fit(cls, categories: list[str], groups: np.ndarray, x: Sparse, y: np.ndarray, folds: int = FOLDS) -> Chain:
        """``groups``: a number for every row; rows of one are in one fold."""
        fold = np.asarray(groups, np.int64) % folds
        earlier, models = np.zeros((x.n, 0)), []
        for k in range(len(categories)):
            models.append(Logistic.fit(x, earlier, y[:, k]))
            if k + 1 < len(categories):
                outside = np.zeros(x.n)
                for f in range(folds):
                    inside, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
                    model = Logistic.fit(x.take(rest), earlier[rest], y[rest, k])
                    outside[inside] = model.scores(x.take(inside), earlier[inside])
                earlier = np.column_stack([earlier, outside])
        return cls(categories, models)

    def scores(self, x: Sparse) -> np.ndarray:
        earlier = np.zeros((x.n, 0))
        for model in self.models:
            earlier = np.column_stack([earlier, model.scores(x, earlier)])
        return earlier


def train(docs: DataFrame, labels: DataFrame, categories: list[str], rows: int = TRAIN_ROWS, derived: int = 0) -> Chain:
    """A chain of the label columns ``categories``, fitted on the driver on at most ``rows`` rows.

    With ``derived``, so many sub-categories of the last one are predicted before it, named after it.
    """
    sample = labelled_sample(docs, labels, categories, rows=rows)
    schema = T.StructType([sample.schema["doc_id"], *(sample.schema[c] for c in categories), T.StructField("group", T.LongType()), T.StructField("features", T.ArrayType(T.IntegerType()))])

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = pa.array([features(t) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in categories), pa.array([group_of(t) for t in texts], pa.int64()), found], schema.names)

    got = mapped(sample, featured, schema, "toxicity").toArrow().sort_by("doc_id").combine_chunks()
    names = [*categories[:-1], *(f"{categories[-1]}_{k + 1}" for k in range(derived)), categories[-1]]
    if not got.num_rows:
        return Chain.fit(names, np.empty(0), Sparse.of([]), np.zeros((0, len(names))))
    found = got.column("features").combine_chunks()
    x = Sparse.flat(pa.compute.list_value_length(found).to_numpy(zero_copy_only=False), found.flatten().to_numpy()).common(3)
    y = np.column_stack([got.column(c).to_numpy().astype(float) for c in categories])
    if derived:
        y = np.column_stack([y[:, :-1], families(x, y[:, -1], derived), y[:, -1:]])
    return Chain.fit(names, got.column("group").to_numpy(), x, y)


def probabilities(docs: DataFrame, model: Chain, text_col: str = "text") -> Column:
    """The probabilities of the chain's categories, in order, as an array. Only the text goes through Python."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = shared_value(spark, model)

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            for i in range(0, len(texts), SLICE):
                parts.append(shared.value.scores(Sparse.of([features(t) for t in texts[i : i + SLICE].to_pylist()])))
            scores = np.concatenate(parts) if parts else np.zeros((0, len(model.categories)))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * scores.shape[1], pa.int32()), pa.array(scores.ravel()))

    run = tidy(scored, "toxicity")

    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(batches)

    return F.arrow_udf(udf, T.ArrayType(T.DoubleType()))(docs[text_col])


def with_toxicity(docs: DataFrame, model: Chain, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, and a probability p_<category> for every category of the chain."""
    names = [f"p_{c}" for c in model.categories]
    read = docs.drop(*names)
    (p,) = fresh(read, "p")
    return read.withColumn(p, probabilities(read, model, text_col)).select(*read.columns, *(F.col(p)[k].alias(n) for k, n in enumerate(names)))


def toxicity(docs: DataFrame, model: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and a probability p_<category> for every category of the chain."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_toxicity(read, model).drop("text")
