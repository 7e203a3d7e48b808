"""Toxicity by a classifier chain.

Categories are predicted one after the other; the probability of each earlier category is an input of the later linear
models. For training, those probabilities come from models that have not seen the row (out of fold), as at scoring.
A document is represented by the presence of its words and word beginnings, so one toxic word in a very long text
counts, and inflected or compounded forms of a word share its beginning. A model uses the features that are
significantly over-represented in its category; the weights are those of a ridge logistic regression.

The models are fitted in one task on a bounded sample of labelled documents; every whole text is scored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import textops as X
from lectern.llm.sampling import labelled_sample

#: Most labelled documents of either overall class in the sample that the chain is fitted on.
MAX_PER_CLASS = 4000
FOLDS = 5
#: Byte lengths of the word beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6, 7)
#: A feature must be this much more frequent in the category than outside, with this chi-square at least.
MIN_LIFT, MIN_CHI2, MAX_FEATURES = 5.0, 20.0, 256
RIDGE = 1e-4
THRESHOLD = 0.5
LANGUAGES = ("en", "de", "fr", "es")


def feature_hashes(texts: list[bytes], powers: X.Powers) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every word and word beginning, with repeats."""
    w = X.Words([t.translate(X.ALNUM_LOWER) for t in texts], X.SPACE, powers)
    docs, found = [w.doc], [w.word_hash()]
    length = w.end - w.start
    for k in BEGINNINGS:
        at = np.flatnonzero(length > k)
        docs.append(w.doc[at])
        found.append(X.mix(w.span_hash(w.start[at], w.start[at] + k) + np.uint64(k)))
    return np.concatenate(docs), np.concatenate(found)


@dataclass
class Link:
    """One model of the chain: its features, their weights, those of the earlier probabilities, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float


class Sparse:
    """Presence of features in documents, as sorted distinct (document, feature number) pairs."""

    def __init__(self, doc: np.ndarray, feature: np.ndarray, n: int) -> None:
        self.names, number = np.unique(feature, return_inverse=True)
        pairs = np.unique(doc.astype(np.int64) * len(self.names) + number) if len(doc) else np.zeros(0, np.int64)
        self.doc, self.feature = np.divmod(pairs, max(1, len(self.names)))
        self.n = n

    def fit(self, rows: np.ndarray, y: np.ndarray, earlier: np.ndarray) -> Link:
        """Fit a category ``y`` on the rows chosen by the mask ``rows``."""
        inside = rows[self.doc]
        doc, feature = self.doc[inside], self.feature[inside]
        n, n1 = int(rows.sum()), int(y[rows].sum())
        n0, size = n - n1, len(self.names)
        a = np.bincount(feature[y[doc]], minlength=size).astype(float)
        b = np.bincount(feature, minlength=size) - a
        with np.errstate(divide="ignore", invalid="ignore"):
            lift = (a / max(n1, 1)) / np.maximum(b / max(n0, 1), 0.5 / max(n0, 1))
            chi2 = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / ((a + b) * (n - a - b) * max(n1, 1) * max(n0, 1))
        good = np.flatnonzero((lift >= MIN_LIFT) & (np.nan_to_num(chi2, posinf=0) >= MIN_CHI2))
        # Ties between equally telling features go by hash, so that reruns agree.
        chosen = np.sort(good[np.lexsort((self.names[good], -chi2[good]))][:MAX_FEATURES])
        place = np.full(size, -1)
        place[chosen] = np.arange(len(chosen))
        at = np.flatnonzero(rows)
        row_of = np.full(self.n, -1)
        row_of[at] = np.arange(n)
        x = np.zeros((n, len(chosen) + earlier.shape[1] + 1))
        used = place[feature] >= 0
        x[row_of[doc[used]], place[feature[used]]] = 1
        x[:, len(chosen) : -1] = earlier[rows]
        x[:, -1] = 1
        weight = logistic(x, y[rows].astype(float))
        k = len(chosen)
        return Link(self.names[chosen], weight[:k], weight[k:-1], float(weight[-1]))

    def logits(self, link: Link, earlier: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.names, link.features)
        weight = np.zeros(len(self.names))
        weight[at] = link.weights
        return np.bincount(self.doc, weight[self.feature], self.n) + earlier @ link.earlier + link.bias


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the bias, last, is not shrunk."""
    w = np.zeros(x.shape[1])
    rate = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
    w[-1] = np.log(rate / (1 - rate))
    ridge = np.full(x.shape[1], RIDGE * max(1, len(y)))
    ridge[-1] = 1e-9
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_chain(texts: list[bytes], labels: np.ndarray, fold: np.ndarray) -> list[Link]:
    """One link per column of ``labels``; a category that does not occur is never predicted."""
    powers, docs, found = X.Powers(), [], []
    for lo, hi in X.chunks(texts):
        d, f = feature_hashes(texts[lo:hi], powers)
        pair = np.unique(np.stack([d.astype(np.uint64), f]), axis=1)
        docs.append(pair[0].astype(np.int64) + lo)
        found.append(pair[1])
    x = Sparse(np.concatenate(docs or [np.zeros(0, np.int64)]), np.concatenate(found or [np.zeros(0, np.uint64)]), len(texts))
    every, chain, seen = np.ones(len(texts), bool), [], np.zeros((len(texts), 0))
    for c in range(labels.shape[1]):
        y = labels[:, c]
        chain.append(x.fit(every, y, seen))
        out = np.zeros(len(texts))
        for k in range(FOLDS):
            held = fold == k
            if held.any():
                out[held] = sigmoid(x.logits(x.fit(~held, y, seen), seen))[held]
        seen = np.column_stack([seen, out])
    return chain


class Scorer:
    """Applies a chain to texts; only features that some link uses are looked up."""

    def __init__(self, chain: list[Link]) -> None:
        self.chain, self.powers = chain, X.Powers()
        self.names = np.unique(np.concatenate([c.features for c in chain] + [np.zeros(0, np.uint64)]))
        self.weights = np.zeros((len(chain), len(self.names)))
        for c, link in enumerate(chain):
            self.weights[c, np.searchsorted(self.names, link.features)] = link.weights
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.names & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of each category (columns) for each text."""
        out = np.zeros((len(texts), len(self.chain)))
        for lo, hi in X.chunks(texts):
            doc, feature = feature_hashes(texts[lo:hi], self.powers)
            near = np.flatnonzero(self.sieve[(feature & np.uint64((1 << 20) - 1)).astype(np.int64)])
            doc, feature = doc[near], feature[near]
            at = np.minimum(np.searchsorted(self.names, feature), max(0, len(self.names) - 1))
            hit = self.names[at] == feature if len(self.names) else np.zeros(0, bool)
            pairs = np.unique(doc[hit] * max(1, len(self.names)) + at[hit])
            doc, at = np.divmod(pairs, max(1, len(self.names)))
            for c, link in enumerate(self.chain):
                logit = np.bincount(doc, self.weights[c][at], hi - lo) + link.bias + out[lo:hi, :c] @ link.earlier
                out[lo:hi, c] = sigmoid(logit)
        return out


def train(docs: DataFrame, labels: DataFrame, categories: list[str], max_per_class: int = MAX_PER_CLASS) -> list[Link]:
    """Fit a chain over the 0/1 columns ``categories`` of ``labels`` (doc_id, ...); the last is the overall verdict."""
    rows = labelled_sample(docs.select("doc_id", "text"), labels.select("doc_id", *categories), F.col(categories[-1]) == 1, max_per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = pa.Table.from_batches(list(batches), schema).sort_by("doc_id")
        marks = np.column_stack([np.array([x == 1 for x in given[c].to_pylist()], bool) for c in categories])
        fold = np.array([hash_fold(i) for i in given["doc_id"].to_pylist()], np.int64)
        chain = fit_chain(X.texts_of(given["text"].combine_chunks()), marks.reshape(-1, len(categories)), fold)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps([astuple(link) for link in chain])])], ["chain"])

    rows = rows.select("doc_id", "text", *[F.col(c).cast("int").alias(c) for c in categories])
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), *[(c, pa.int32()) for c in categories]])
    fitted = rows.repartition(1).mapInArrow(run, "chain binary").first()
    if fitted is None:  # no labelled document: nothing is toxic
        return [Link(np.zeros(0, np.uint64), np.zeros(0), np.zeros(c), np.log(1e-4)) for c in range(len(categories))]
    return [Link(*parts) for parts in pickle.loads(fitted[0])]


def hash_fold(doc_id: int) -> int:
    return int(X.mix(np.array([doc_id], np.int64).view(np.uint64))[0] % np.uint64(FOLDS))


def score(docs: DataFrame, chain: list[Link], categories: list[str], keep_below: float | None = None) -> DataFrame:
    """The rows and columns of ``docs`` with ``toxicity``, an array of the probability of each category.

    Null and empty texts score as a text without features. Repeated rows score alike; an empty table gives no rows. A
    column of ``docs`` named ``toxicity`` is replaced. With ``keep_below`` only rows whose last probability is below
    it come back, without the new column.
    """
    docs = docs.drop("toxicity") if keep_below is None else docs
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(chain)
        for batch in batches:
            found = scorer.score(X.texts_of(batch.column(at)))
            if keep_below is not None:
                yield batch.filter(pa.array(found[:, -1] < keep_below))
            else:
                ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(categories))
                yield X.with_columns(batch, {"toxicity": pa.ListArray.from_arrays(ends, pa.array(found.ravel()))})

    schema = docs.schema if keep_below is not None else docs.select("*", F.array(F.lit(0.0)).alias("toxicity")).schema
    return docs.mapInArrow(run, schema)


CATEGORIES = [*[f"toxic_{lang}" for lang in LANGUAGES], "toxic"]


def categories_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels with the chain's categories: toxicity in each language, then toxicity at all.

    The tables know one toxicity label; what is toxic differs by language, so the languages are the earlier
    categories. The language marks a training category only and is never an input of a score.
    """
    marked = labels.filter("toxic is not null").join(docs.select("doc_id", "lang").dropDuplicates(["doc_id"]), "doc_id")
    each = [((F.col("toxic") == 1) & (F.col("lang") == lang)).cast("int").alias(f"toxic_{lang}") for lang in LANGUAGES]
    return marked.select("doc_id", *[F.coalesce(c, F.lit(0)).alias(n) for c, n in zip(each, CATEGORIES, strict=False)], "toxic")


def drop_toxic(docs: DataFrame, training_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that a chain trained on ``training_docs`` and ``labels`` does not reject."""
    chain = train(training_docs, categories_of(training_docs, labels), CATEGORIES)
    return score(docs, chain, CATEGORIES, keep_below=THRESHOLD)
