"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of a hundred words. Every passage is encoded by shares of character classes, repetition
and a projection of its hashed words, and then by a learned layer. A gated attention, learned from document labels
alone, weighs the passages; the score is a logistic function of the weighted sum of their representations.

The network is fitted in one task on a bounded sample of labelled documents; every whole text is scored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import textops as X
from lectern.llm.sampling import labelled_sample

#: Most labelled documents of either class in the sample that the network is fitted on.
MAX_PER_CLASS = 3000
PASSAGE_WORDS = 100
PROJECTED = 32
HIDDEN, ATTENTION = 24, 12
EPOCHS, BATCH, RATE, DECAY = 30, 64, 3e-3, 1e-4
THRESHOLD = 0.3
#: Character classes whose share of a passage is a measure, by byte.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"|", b"#*$%&<>", b",", b".", b"?;:'\"()-", b"@/_=+~^\\[]{}`", bytes(range(128, 256)), b"\n"]
MEASURES = len(CLASSES) + 6 + PROJECTED

Weights = dict[str, np.ndarray]


class Encoder:
    """Measures of every passage of a list of texts."""

    def __init__(self) -> None:
        self.powers = X.Powers()
        self.signs = np.random.default_rng(3).choice(np.array([-1, 1], np.float32), (1 << 12, PROJECTED))
        self.kind = np.zeros(256, np.int64)
        for i, members in enumerate(CLASSES, 1):
            self.kind[list(members)] = i

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(passages x measures, first passage of each text). A text without words is one passage of zeros."""
        w = X.Words(texts, X.SPACE, self.powers)
        per_text = np.maximum(1, -(-w.count // PASSAGE_WORDS))
        first = np.concatenate([[0], np.cumsum(per_text)])
        out = np.zeros((first[-1], MEASURES), np.float32)
        if not len(w.start):
            return out, first[:-1]
        passage = first[w.doc] + (np.arange(len(w.start)) - w.lo[w.doc]) // PASSAGE_WORDS
        used, at = np.unique(passage, return_index=True)
        n = np.diff(np.append(at, len(w.start)))
        begin, end = w.start[at], w.end[at + n - 1]
        size = (end - begin).astype(np.float32)
        for i in range(1, len(CLASSES) + 1):
            upto = np.concatenate([[0], np.cumsum(self.kind[w.buf] == i)])
            out[used, i - 1] = (upto[end] - upto[begin]) / size
        word = w.word_hash()
        length = (w.end - w.start).astype(np.float32)
        k = len(CLASSES)
        out[used, k] = np.add.reduceat(length, at) / n / 10
        out[used, k + 1] = np.add.reduceat((length == 1).astype(np.float32), at) / n
        out[used, k + 2] = np.add.reduceat((length > 15).astype(np.float32), at) / n
        out[used, k + 3] = np.log1p(n) / 5
        out[used, k + 4] = np.add.reduceat(self.seen_before(word, w.doc, 1), at) / n
        out[used, k + 5] = np.add.reduceat(self.seen_before(word, w.doc, 4), at) / n
        lowered = X.Words([t.translate(X.ALNUM_LOWER) for t in texts], X.SPACE, self.powers)
        slot = (lowered.word_hash() >> np.uint64(52)).astype(np.int64)
        # Words between separators differ in number from words of letters; each lies in the passage of its position.
        of = passage[np.maximum(0, np.searchsorted(w.start, lowered.start, "right") - 1)]
        if len(of):
            owner, at = np.unique(of, return_index=True)
            n = np.diff(np.append(at, len(of)))
            for lo in range(0, len(at), 512):
                stop = at[lo + 512] if lo + 512 < len(at) else len(of)
                part = np.add.reduceat(self.signs[slot[at[lo] : stop]], at[lo : lo + 512] - at[lo], axis=0)
                out[owner[lo : lo + 512], k + 6 :] = part / np.sqrt(n[lo : lo + 512, None])
        return out, first[:-1]

    @staticmethod
    def seen_before(word: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """1 for each word that starts an n-gram which the text already had."""
        out = np.zeros(len(word), np.float32)
        grams = X.gram_hash(word, n)
        inside = doc[: len(grams)] == doc[n - 1 : n - 1 + len(grams)]
        at = np.flatnonzero(inside)
        key = grams[at] ^ X.mix(doc[at].astype(np.uint64))
        order = np.lexsort((at, key))
        again = np.flatnonzero(key[order][1:] == key[order][:-1]) + 1
        out[at[order[again]]] = 1
        return out


def forward(x: np.ndarray, first: np.ndarray, m: Weights) -> dict[str, np.ndarray]:
    """All intermediate values of the network for bags that start at ``first``."""
    bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    h = np.maximum(x @ m["w1"] + m["b1"], 0)
    t = np.tanh(h @ m["v"])
    g = 1 / (1 + np.exp(-np.clip(h @ m["u"], -30, 30)))
    e = (t * g) @ m["a"]
    e = np.exp(e - np.maximum.reduceat(e, first)[bag])
    att = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(att[:, None] * h, first, axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["b"], -30, 30)))
    return {"bag": bag, "h": h, "t": t, "g": g, "att": att, "z": z, "p": p}


def gradients(x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, m: Weights) -> Weights:
    f = forward(x, first, m)
    bag, h, t, g, att = (f[k] for k in ("bag", "h", "t", "g", "att"))
    d = (f["p"] - y) * weight / weight.sum()
    dz = np.outer(d, m["c"])
    da = (h * dz[bag]).sum(1)
    de = att * (da - np.add.reduceat(att * da, first)[bag])
    dtg = np.outer(de, m["a"])
    dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    dh = (att[:, None] * dz[bag] + dt @ m["v"].T + dg @ m["u"].T) * (h > 0)
    return {
        "w1": x.T @ dh, "b1": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": f["z"].T @ d,
        "b": np.array([d.sum()]),
    }


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 5) -> Weights:
    """Adam on shuffled batches of bags. ``x`` is standardised here; the scale travels with the weights."""
    rng = np.random.default_rng(seed)
    mean, sd = x.mean(0), x.std(0) + 1e-3
    x = np.clip((x - mean) / sd, -8, 8).astype(np.float64)
    draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
    m = {
        "w1": draw(x.shape[1], HIDDEN), "b1": np.zeros(HIDDEN), "v": draw(HIDDEN, ATTENTION),
        "u": draw(HIDDEN, ATTENTION), "a": draw(ATTENTION), "c": draw(HIDDEN), "b": np.zeros(1),
    }
    one, two = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    end, step = np.append(first[1:], len(x)), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(first))
        for lo in range(0, len(order), BATCH):
            bags = order[lo : lo + BATCH]
            rows = np.concatenate([np.arange(first[i], end[i]) for i in bags])
            starts = np.concatenate([[0], np.cumsum(end[bags] - first[bags])[:-1]])
            step += 1
            for k, d in gradients(x[rows], starts, y[bags], weight[bags], m).items():
                d = d + DECAY * m[k]
                one[k] = 0.9 * one[k] + 0.1 * d
                two[k] = 0.999 * two[k] + 0.001 * d * d
                m[k] = m[k] - RATE * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return m | {"mean": mean, "sd": sd}


def encode_all(encoder: Encoder, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts, starts, total = [np.zeros((0, MEASURES), np.float32)], [np.zeros(0, np.int64)], 0
    for lo, hi in X.chunks(texts):
        x, first = encoder.encode(texts[lo:hi])
        parts.append(x)
        starts.append(first + total)
        total += len(x)
    return np.concatenate(parts), np.concatenate(starts)


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> Weights:
    """Fit the network to ``labels`` (doc_id, quality 0/1) of ``docs`` (doc_id, text).

    Labels that are null or without document do not count; without any label every score is one half. Classes are
    weighted back to their share among the labels, so that a score is a probability.
    """
    known = labels.filter("quality is not null").select("doc_id", "quality")
    share = {bool(r[0]): r[1] for r in known.groupBy(F.col("quality") == 1).count().collect()}
    rows = labelled_sample(docs.select("doc_id", "text"), known, F.col("quality") == 1, max_per_class)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("quality", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = pa.Table.from_batches(list(batches), schema).sort_by("doc_id")
        y = np.array([x == 1 for x in given["quality"].to_pylist()], float)
        x, first = encode_all(Encoder(), X.texts_of(given["text"].combine_chunks()))
        weight = np.ones(len(y))
        for side in (True, False):
            mine = (y == 1) == side
            weight[mine] = share.get(side, 0) / max(1, mine.sum())
        m = fit(x, first, y, weight / max(weight.mean(), 1e-9)) if len(y) else {}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(m)])], ["model"])

    rows = rows.select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    fitted = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(fitted[0]) if fitted else {}


def score(docs: DataFrame, m: Weights) -> DataFrame:
    """doc_id, score: one row per row of ``docs`` (doc_id, text), nothing else of which is read.

    The score is between 0 and 1, higher where quality 1 is likelier. Null and empty texts score as one empty passage.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for batch in batches:
            texts, out = X.texts_of(batch.column(1)), []
            for lo, hi in X.chunks(texts):
                x, first = encoder.encode(texts[lo:hi])
                scaled = np.clip((x - m["mean"]) / m["sd"], -8, 8) if m else x
                out.append(forward(scaled, first, m)["p"] if m else np.full(hi - lo, 0.5))
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores.astype(float))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def held_out(doc_id: Column) -> Column:
    """A fifth of the ids, by checksum; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
