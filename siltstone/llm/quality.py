"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words.  Each passage is encoded from its
bytes: frequencies of character classes and class pairs, hashed words, and how
varied and long its words are; a learned layer makes that an embedding h.  Gated
attention, a = softmax(w . (tanh(V h) * sigmoid(U h))), weighs the passages, and
a logistic layer scores the weighted mean of h.  Only document labels are known;
the weights are learned from them.

Fitting takes a bounded sample of labelled rows on the driver: ``max_documents``,
those with the least hash of doc_id, one row for each, and of each at most
``max_passages``, spread evenly over the whole text.  Scoring covers every passage
of every text, with running sums for the softmax, so memory doesn't follow text
length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import blocks, hash_words, row_of, tidied, utf8
from .scratch import refuse_clash

PASSAGE = 64
MAX_DOCUMENTS = 3000
MAX_PASSAGES = 256
HASHED = 64
BLOCK = 1 << 19

# Character classes: lower, upper, digit, space, newline, comma and stop, quotes and hyphen, !?, |, other symbols, not ASCII.
_CLASSES = 11
_CLASS = np.full(256, 9, np.uint8)
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\r\f\v", b"\n", b",.;:", b"'\"-()", b"!?", b"|")):
    _CLASS[list(_bytes)] = _k
_CLASS[128:] = 10
FEATURES = _CLASSES + _CLASSES * _CLASSES + HASHED + 4


def passages(data: np.ndarray, offsets: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (float32), and the row of each; a text without words is one passage of zeros."""
    rows = len(offsets) - 1
    hashes, first, last, index = hash_words(data, offsets)
    words = np.diff(index)
    count = np.maximum(1, -(-words // size))
    start = np.concatenate([[0], np.cumsum(count)])
    total = int(start[-1])
    out = np.zeros((total, FEATURES), np.float32)
    row = np.repeat(np.arange(rows), count)
    if not len(hashes):
        return out, row
    owner = row_of(index)
    passage = start[owner] + (np.arange(len(hashes)) - index[owner]) // size
    # Bytes belong to the passage of the word before or around them.
    begins = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    of_byte = np.full(len(data), -1, np.int32)
    ends = np.append(first[begins[1:]], len(data))
    stop = np.minimum(ends, offsets[row[passage[begins]] + 1])
    mark = np.zeros(len(data) + 1, np.int32)
    ids = passage[begins].astype(np.int32) + 1
    mark[first[begins]] += ids
    np.subtract.at(mark, stop, ids)
    of_byte = np.cumsum(mark[:-1], dtype=np.int32) - 1
    kind = _CLASS[data]
    inside = of_byte >= 0
    one = np.bincount(of_byte[inside] * _CLASSES + kind[inside], minlength=total * _CLASSES).reshape(total, _CLASSES)
    same = inside[:-1] & (of_byte[1:] == of_byte[:-1])
    pair = kind[:-1].astype(np.int64) * _CLASSES + kind[1:]
    two = np.bincount((of_byte[:-1].astype(np.int64) * _CLASSES**2 + pair)[same], minlength=total * _CLASSES**2).reshape(total, _CLASSES**2)
    n = np.bincount(passage, minlength=total)
    divide = np.maximum(n, 1)[:, None]
    length = np.maximum(one.sum(1), 1)[:, None]
    out[:, :_CLASSES] = np.sqrt(one / length)
    out[:, _CLASSES : _CLASSES + _CLASSES**2] = np.sqrt(two / length)
    sign = np.where(hashes & np.uint64(1), 1.0, -1.0)
    hashed = np.bincount(passage * HASHED + ((hashes >> np.uint64(8)) % np.uint64(HASHED)).astype(np.int64), weights=sign, minlength=total * HASHED)
    out[:, _CLASSES + _CLASSES**2 : -4] = hashed.reshape(total, HASHED) / divide * 2
    shift = np.uint64(max(1, int(total - 1).bit_length()))
    key = np.sort((passage.astype(np.uint64) << (np.uint64(64) - shift)) | (hashes >> shift))
    fresh = np.append(True, key[1:] != key[:-1])
    distinct = np.bincount((key[fresh] >> (np.uint64(64) - shift)).astype(np.int64), minlength=total)[:total]
    again = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    repeated = np.bincount(passage[1:][again], minlength=total)
    out[:, -4] = distinct / divide[:, 0]
    out[:, -3] = repeated / divide[:, 0]
    out[:, -2] = np.bincount(passage, weights=(last - first), minlength=total) / divide[:, 0] / 10
    out[:, -1] = np.log1p(n) / 5
    return out, row


@dataclass
class Model:
    encode: np.ndarray  # features+1 x hidden
    v: np.ndarray  # hidden x attention
    u: np.ndarray
    w: np.ndarray  # attention
    c: np.ndarray  # hidden
    b: float

    def embed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings and attention logits of passages."""
        h = np.tanh(x.astype(np.float64) @ self.encode[:-1] + self.encode[-1])
        return h, (np.tanh(h @ self.v) * _sigmoid(h @ self.u)) @ self.w

    def score(self, mean: np.ndarray) -> np.ndarray:
        """Rounded, so that equal texts score alike in batches of any shape."""
        return np.round(_sigmoid(mean @ self.c + self.b), 9)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(x: np.ndarray, row: np.ndarray, labels: np.ndarray, hidden: int = 24, attention: int = 12, epochs: int = 30, rate: float = 4e-3, seed: int = 5) -> Model:
    """Gradient descent (Adam) on the logistic loss of documents; rows of x are sorted by document.

    Without both labels the model is a constant: the share of label 1, or 0.5 without rows.
    """
    rng = np.random.default_rng(seed)
    f = x.shape[1]
    if len(labels) == 0 or labels.min() == labels.max():
        b = 0.0 if len(labels) == 0 else (12.0 if labels[0] else -12.0)
        return Model(np.zeros((f + 1, hidden)), np.zeros((hidden, attention)), np.zeros((hidden, attention)), np.zeros(attention), np.zeros(hidden), b)
    p = [
        rng.normal(0, 1 / np.sqrt(f), (f + 1, hidden)), rng.normal(0, 0.3, (hidden, attention)), rng.normal(0, 0.3, (hidden, attention)),
        rng.normal(0, 0.3, attention), rng.normal(0, 0.3, hidden), np.zeros(1),
    ]
    moment, square, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    start = np.concatenate([np.searchsorted(row, np.arange(len(labels))), [len(row)]])
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), 64):
            batch = np.sort(order[lo : lo + 64])
            sizes = start[batch + 1] - start[batch]
            take = np.concatenate([np.arange(start[k], start[k + 1]) for k in batch])
            bag = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            xb, y = x[take].astype(np.float64), labels[batch]
            encode, v, u, w, c, b = p
            h = np.tanh(xb @ encode[:-1] + encode[-1])
            t, g = np.tanh(h @ v), _sigmoid(h @ u)
            logit = (t * g) @ w
            logit -= np.repeat(np.maximum.reduceat(logit, bag), sizes)
            e = np.exp(logit)
            a = e / np.repeat(np.add.reduceat(e, bag), sizes)
            z = np.add.reduceat(a[:, None] * h, bag)
            miss = (_sigmoid(z @ c + b[0]) - y) / len(batch)
            dz = np.repeat(miss[:, None] * c, sizes, axis=0)
            da = (dz * h).sum(1)
            dl = a * (da - np.repeat(np.add.reduceat(a * da, bag), sizes))
            dt, dg = dl[:, None] * w * g * (1 - t * t), dl[:, None] * w * t * g * (1 - g)
            dh = (a[:, None] * dz + dt @ v.T + dg @ u.T) * (1 - h * h)
            grads = [np.vstack([xb.T @ dh, dh.sum(0)]), h.T @ dt, h.T @ dg, (t * g).T @ dl, z.T @ miss, np.array([miss.sum()])]
            step += 1
            for k, grad in enumerate(grads):
                grad = grad + 1e-4 * p[k]
                moment[k] = 0.9 * moment[k] + 0.1 * grad
                square[k] = 0.999 * square[k] + 0.001 * grad * grad
                p[k] = p[k] - rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    encode, v, u, w, c, b = p
    return Model(encode, v, u, w, c, float(b[0]))


def spread(n: int, most: int) -> np.ndarray:
    """At most ``most`` of the numbers 0 to n - 1, evenly spread, the first and the last among them."""
    return np.unique(np.linspace(0, n - 1, min(n, most)).round().astype(np.int64))


def sampled(data: np.ndarray, offsets: np.ndarray, most: int) -> list[np.ndarray]:
    """Features of ``spread`` passages of each row of a block; a long row is read in parts."""
    rows = len(offsets) - 1
    if rows > 1:
        x, row = passages(data, offsets)
        cut = np.searchsorted(row, np.arange(rows + 1))
        return [x[a:b][spread(b - a, most)] for a, b in zip(cut[:-1], cut[1:])]
    wanted = spread(max(1, -(-len(hash_words(data, offsets)[0]) // PASSAGE)), most)
    taken = [x[wanted[(wanted >= before) & (wanted < before + len(x))] - before] for x, _, before in _pieces(data, offsets)]
    return [np.concatenate(taken)]


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_documents: int = MAX_DOCUMENTS, max_passages: int = MAX_PASSAGES) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, quality); null labels and null ids teach nothing.

    Of a document with several labels the least counts, and of rows that share a
    doc_id the one of the least text hash.  Labels without a document, and other
    columns, are not used.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_q_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_documents)
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            blobs = []
            for i, j in blocks(offsets, BLOCK):
                blobs += [x.astype(np.float16).tobytes() for x in sampled(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], max_passages)]
            columns = [batch.column("doc_id"), batch.column("label"), batch.column("mark"), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "mark", "x"])

    # Passages, not texts, are grouped: one row of each id comes to the driver, however many share it.
    found = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", F.col("_q_label").cast("int").alias("label"), F.xxhash64("text").alias("mark"), "text")
        .mapInArrow(tidied(features), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, mark bigint, x binary")
    )
    rows = found.groupBy("doc_id").agg(F.min("label").alias("label"), F.min_by("x", "mark").alias("x")).toArrow()
    order = sorted(range(rows.num_rows), key=lambda k: (rows["doc_id"][k].as_py(), rows["x"][k].as_py()))
    mats = [np.frombuffer(rows["x"][k].as_py(), np.float16).reshape(-1, FEATURES) for k in order]
    x = np.concatenate(mats).astype(np.float32) if mats else np.zeros((0, FEATURES), np.float32)
    row = np.repeat(np.arange(len(mats)), [len(m) for m in mats]) if mats else np.zeros(0, int)
    return fit(x, row, np.array([rows["label"][k].as_py() for k in order], float))


def score(spark: SparkSession, docs: DataFrame, model: Model, keep: list[Column | str] | None = None) -> DataFrame:
    """Columns ``keep`` of docs with quality_score (0 to 1) and top_passage, the one with most attention.

    Null and empty texts are one empty passage.  Every row is scored by itself,
    whatever its doc_id; equal texts score alike.  ``keep`` may not have the
    result's names or _q_text; other columns of docs may.
    """
    refuse_clash(keep, "quality_score", "top_passage", "_q_text")
    kept = docs.select(*(keep or ["doc_id"]))
    names, text = kept.columns, "text"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    if not any(isinstance(c, str) and c == "text" for c in keep or ["doc_id"]):  # else the text goes to Python once
        text = "_q_text"
        kept = docs.select(*(keep or ["doc_id"]), F.col("text").alias(text))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            out, top = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, j in blocks(offsets, BLOCK):
                out[i:j], top[i:j] = _score_block(m, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(names))), pa.array(out), pa.array(top)], [*names, "quality_score", "top_passage"])

    return kept.mapInArrow(tidied(run), f"{schema}, quality_score double, top_passage bigint")


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """A block, or a long single text in parts of whole passages: (features, rows, passages before)."""
    if len(data) <= 2 * BLOCK or len(offsets) > 2:
        yield (*passages(data, offsets), 0)
        return
    _, first, _, _ = hash_words(data, offsets)
    step = PASSAGE * max(1, BLOCK // (PASSAGE * 6))
    cuts = [*first[::step].tolist(), len(data)] if len(first) else [0, len(data)]
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        yield (*passages(data[a:b], np.array([0, b - a])), k * step // PASSAGE)


def _score_block(m: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = len(offsets) - 1
    most, total, top = np.full(rows, -np.inf), np.zeros(rows), np.zeros(rows, np.int64)
    mean = np.zeros((rows, len(m.c)))
    for x, row, before in _pieces(data, offsets):
        h, logit = m.embed(x)
        first = np.searchsorted(row, np.arange(rows))
        peak = np.maximum.reduceat(logit, first)
        at = np.flatnonzero(logit == np.repeat(peak, np.diff(np.append(first, len(row)))))
        where = np.zeros(rows, np.int64)
        where[row[at[::-1]]] = at[::-1] - first[row[at[::-1]]]
        new = np.maximum(most, peak)
        top = np.where(peak > most, where + before, top)
        e = np.exp(logit - new[row])
        old = np.exp(most - new)
        total = total * old + np.add.reduceat(e, first)
        mean = mean * old[:, None] + np.add.reduceat(e[:, None] * h, first, axis=0)
        most = new
    return m.score(mean / total[:, None]), top
