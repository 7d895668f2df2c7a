"""Toxicity by a classifier chain of linear models on counts of words and word beginnings.

The categories are predicted in a given order. The model of a category sees the words of a document
(whole, and their first four and five characters, for languages that inflect or compound) and the
probabilities of all earlier categories. For training these come from models that have not
seen the document: the labelled rows are dealt into folds, and each fold is predicted by a model of the
others. When documents are scored the models of all labelled rows follow one another.

Models are fitted on a bounded sample of labelled documents (``SAMPLE``), whose words Spark counts; the
driver gets the counts of selected features only. Every document is scored whole.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quotewright.llm.store import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 6000  # labelled documents a chain is fitted on, at most
LEAST_CHI_SQUARE = 11.0  # a feature's association with a category; p = 0.001
LEAST_EFFECT = 1 / 120  # and its share of the number of documents, the squared phi coefficient
CACHED_WORDS = 200_000
FOLDS = 5
RIDGE = 0.03
STEPS = 300
THRESHOLD = 0.5
WORD = re.compile(r"\w+|[^\w\s]{2,}")


def parts(word: str) -> list[str]:
    """The features of a word: itself and its beginnings."""
    return [word, *("^" + word[:n] for n in (4, 5) if len(word) > n)]


@dataclass(frozen=True)
class Chain:
    """Linear models over ``words``: for each category its weights for the words, then for the
    probabilities of the categories before, then the intercept."""

    categories: tuple[str, ...]
    words: dict[str, int]
    weights: tuple[np.ndarray, ...]

    def features(self, text: str | None, seen: dict[str, tuple[int, ...]]) -> np.ndarray:
        """The features of a text; ``seen`` remembers those of words."""
        counts = [0] * len(self.words)
        if len(seen) > CACHED_WORDS:
            seen.clear()
        for word in WORD.findall(text.lower()) if text else ():
            columns = seen.get(word)
            if columns is None:
                columns = seen[word] = tuple(self.words[p] for p in parts(word) if p in self.words)
            for column in columns:
                counts[column] += 1
        return strength(np.array(counts, np.float64))

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """One row per row of word features, one column per category."""
        found = np.zeros((len(rows), 0))
        for w in self.weights:
            p = sigmoid(np.hstack([rows, found]) @ w[:-1] + w[-1])
            found = np.hstack([found, p[:, None]])
        return found


def strength(n):
    """The feature of a word that occurs ``n`` times."""
    return np.where(np.asarray(n) > 0, np.minimum(1 + np.log(np.maximum(n, 1)), 3.0), 0.0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: np.ndarray, labels: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Weights and intercept of a ridge logistic regression, by accelerated gradient descent.

    Each row of the rarer class weighs more, by the root of the ratio of the classes.
    With one class only, or no rows, the weights are 0 and the intercept gives the smoothed share.
    """
    kind = rows.dtype
    w = np.zeros(rows.shape[1] + 1, kind)
    n, positive = len(labels), labels.sum()
    w[-1] = np.log((positive + 0.5) / (n - positive + 0.5))
    if n == 0 or labels.min() == labels.max():
        return w
    y = labels.astype(kind)

    def forward(w: np.ndarray) -> np.ndarray:
        return rows @ w[:-1] + w[-1]

    def backward(r: np.ndarray) -> np.ndarray:
        return np.append(rows.T @ r, r.sum())

    ratio = (n - positive) / positive
    weight = np.where(y > 0, max(ratio, 1), max(1 / ratio, 1)).astype(kind) ** kind.type(0.5)
    # The largest eigenvalue of the weighted x'x (x: the rows and a column of ones), by power iteration, bounds the curvature.
    v = np.ones(len(w), kind)
    for _ in range(20):
        v = backward(weight * forward(v))
        size = np.linalg.norm(v)
        v /= size
    rate = kind.type(1 / (0.3 * size + ridge))
    penalty = np.full(len(w), ridge, kind)
    penalty[-1] = 0
    look, momentum = w.copy(), 1.0
    for _ in range(steps):
        gradient = backward(weight * (sigmoid(forward(look)) - y)) + penalty * look
        new = look - rate * gradient
        following = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        look = new + kind.type((momentum - 1) / following) * (new - w)
        w, momentum = new, following
    return w


def fit_chain(rows: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> tuple[np.ndarray, ...]:
    """The weights of each category (columns of ``labels``), with out-of-fold probabilities."""
    weights, seen = [], rows
    for category in labels.T:
        weights.append(fit(seen, category))
        outside = np.zeros(len(category), rows.dtype)
        for fold in np.unique(folds):
            held = folds == fold
            w = fit(seen[~held], category[~held])
            outside[held] = sigmoid(seen[held] @ w[:-1] + w[-1])
        seen = np.hstack([seen, outside[:, None]])
    return tuple(weights)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts: Counter = Counter({"": 0})  # so that texts without words are counted as documents
            for word, n in Counter(WORD.findall((text.as_py() or "").lower())).items():
                for part in parts(word):
                    counts[part] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(counts), pa.int64()), pa.array(list(counts), pa.string()),
                 pa.array(list(counts.values()), pa.int64())], ["_key", "word", "n"])


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], id_col: str = "doc_id",
          text_col: str = "text", sample: int = SAMPLE, least: float = LEAST_CHI_SQUARE) -> Chain:
    """A chain for the 0/1 columns ``categories`` of ``labels``, which also has ``id_col``.

    Rows with a NULL label or id are ignored; of repeated ids one row counts, the largest. The sample
    are the documents with the smallest hashes of their ids; those without words count as well. Features are all words
    and beginnings whose association with a category is significant (``least``) and not slight. Other columns are ignored.
    """
    label = F.struct(*[F.col(c).cast("int").alias(c) for c in categories])
    complete = labels.where(F.col(id_col).isNotNull()).dropna(subset=list(categories))
    drawn = (
        complete.groupBy(F.col(id_col).cast("long").alias("_key")).agg(F.max(label).alias("_label"))
        .orderBy(F.xxhash64("_key"), "_key").limit(sample)
    )
    drawn = stored(drawn.select("_key", "_label.*"), "sample")
    texts = docs.select(F.col(id_col).cast("long").alias("_key"), F.col(text_col).cast("string").alias("_text"))
    chosen = texts.join(F.broadcast(drawn.select("_key")), "_key")  # ``sample`` rows at most
    counted = stored(
        chosen.mapInArrow(_count, "_key long, word string, n long"), "counts")
    answers = drawn.join(counted.select("_key").distinct(), "_key", "left_semi").orderBy("_key").toPandas()
    words: dict[str, int] = {}
    marked = counted.select("_key", "word").distinct().join(F.broadcast(drawn), "_key")
    for category in categories:
        total, positive = len(answers), int(answers[category].sum())
        # The chi-square statistic of "has the word" against the label.
        a = F.sum(F.col(category))
        b = F.count(F.lit(1)) - a
        c, d = positive - a, (total - positive) - b
        statistic = total * (a * d - b * c) ** 2 / ((a + b) * (c + d + 1e-9) * (a + c + 1e-9) * (b + d + 1e-9))
        found = marked.groupBy("word").agg(statistic.cast("double").alias("s")).where(F.col("s") >= max(least, LEAST_EFFECT * total))
        for word in sorted(r["word"] for r in found.select("word").collect()):
            words.setdefault(word, len(words))
    index = docs.sparkSession.createDataFrame(list(words.items()) or [("", 0)], "word string, column int")
    cells = counted.join(F.broadcast(index), "word").groupBy("_key", "column").agg(F.sum("n").alias("n")).toPandas()
    rows = np.zeros((len(answers), len(words)), np.float32)
    place = {k: i for i, k in enumerate(answers["_key"])}
    if words:
        rows[cells["_key"].map(place), cells["column"]] = strength(cells["n"])
    folds = np.arange(len(answers)) * 2654435761 % (1 << 32) % FOLDS
    weights = fit_chain(rows, answers[list(categories)].to_numpy(np.float64).reshape(-1, len(categories)), folds)
    return Chain(tuple(categories), words, weights)


def _score(model, text_at: int, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(*model.value)
        seen: dict[str, tuple[int, ...]] = {}
        names = [f"p_{c}" for c in chain.categories]
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                rows = np.stack([chain.features(t.as_py(), seen) for t in some.column(text_at)])
                found = chain.probabilities(rows)
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(c) for c in kept), *(pa.array(p) for p in found.T)], [*kept, *names])

    return run


def predict(docs: DataFrame, chain: Chain, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with ``p_<category>`` for each category.

    Columns of these names are replaced. A NULL or empty text is judged by the intercepts. No row
    is lost or moved.
    """
    rows = docs.drop(*[f"p_{c}" for c in chain.categories])
    kept = rows.columns if keep is None else keep
    schema = StructType([*(rows.schema[c] for c in kept), *(StructField(f"p_{c}", DoubleType()) for c in chain.categories)])
    model = docs.sparkSession.sparkContext.broadcast((chain.categories, chain.words, chain.weights))
    return rows.mapInArrow(_score(model, rows.columns.index(text_col), kept), schema)


def drop_toxic(docs: DataFrame, chain: Chain, category: str, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose probability of ``category`` is at most ``threshold``."""
    return predict(docs, chain, text_col).where(F.col(f"p_{category}") <= threshold).select(*docs.columns)
