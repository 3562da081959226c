"""Quality classifier: supervised subword embeddings.

Features of a text are hashed into ``2^BUCKET_BITS`` buckets: its words (cut at white
space, case kept), the character 3-, 4- and 5-grams of each word with its bounding space,
and its word bigrams (hashed by the difference of the words' hashes, so that any word
repeated at once is the same bigram). Every bucket has a learned vector; a document is the
average of its features' vectors (of the averages of the three kinds), followed by a
softmax layer. Training is stochastic
gradient descent in numpy with per-row step sizes.

The model is fitted on the driver on at most ``max_train_rows`` labelled rows, picked by
a hash of the doc_id over all labelled rows (the documented bound). Scoring folds the
vectors and the layer into one number per bucket, so the tasks hold 1 MB.

Defined cases: null and empty texts have no features and score the layer's bias; labels
other than 0 and 1 and rows without a doc_id are not learnt from; several labels of one
doc_id count as the highest; without labels of both kinds the score is the share of label
1 (0.5 without any); an empty table gives no rows; other columns are not looked at.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .frames import slim

BUCKET_BITS, DIM = 18, 16
GRAMS = (3, 4, 5)
_B = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.array([1, *[_B] * 8], np.uint64))
_SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x3000], np.uint32)
#: characters worked on at a time; only longer texts are cut (after white space)
_BLOCK = 1 << 19


def _bucket(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x + np.uint64(kind)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def blocks(texts: list[str]):
    """(indices, texts) of about ``_BLOCK`` characters; a longer text comes in pieces."""
    held, size = [], 0
    for i, t in enumerate(texts):
        while len(t) > _BLOCK:
            end = _BLOCK
            while end < len(t) and not t[end].isspace() and end < 2 * _BLOCK:
                end += 1
            yield [i], [t[:end]]
            t = t[end:]
        held.append((i, t))
        size += len(t)
        if size > _BLOCK:
            yield [x[0] for x in held], [x[1] for x in held]
            held, size = [], 0
    if held:
        yield [x[0] for x in held], [x[1] for x in held]


def features(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Buckets of the three kinds (character n-grams, words, bigrams), and for each the
    text it belongs to."""
    codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32)
    lengths = np.array([len(t) for t in texts])
    owner = np.concatenate([[0], np.repeat(np.arange(len(texts)), lengths + 1)])  # a text and the break after it
    space = np.isin(codes, _SPACES) if codes.max() > 127 else (codes == 32) | ((codes >= 9) & (codes <= 13))
    c = np.where(space, np.uint32(32), codes).astype(np.uint64) + np.uint64(1)
    n = len(c)
    grams, of_grams = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    run, inner = c[:n - 1] + c[1:] * _B, ~space[1:n - 1]
    for size in range(3, GRAMS[-1] + 1):  # inner: no space but at the two ends
        if n < size:
            break
        run = run[:n - size + 1] + c[size - 1:] * _POWERS[size - 1]
        inner = inner[:n - size + 1] if size == 3 else inner[:n - size + 1] & ~space[size - 2:n - 1]
        if size in GRAMS:
            at = np.flatnonzero(inner)
            grams.append(_bucket(run[at], size))
            of_grams.append(owner[at + 1])
    ids, of = [np.concatenate(grams)], [np.concatenate(of_grams)]
    word = ~space
    start = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    if len(start):
        length = np.flatnonzero(~word[1:] & word[:-1]) + 1 - start
        place = np.arange(length.sum()) - np.repeat(length.cumsum() - length, length)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(length.max()), _B)]).astype(np.uint64))
        h = np.add.reduceat(c[word] * powers[place], length.cumsum() - length)
        mine = owner[start]
        ids.append(_bucket(h, 1))
        of.append(mine)
        pair = np.flatnonzero(mine[1:] == mine[:-1])
        ids.append(_bucket(h[pair + 1] - h[pair], 2))
        of.append(mine[pair])
    return ids, of


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, weights) of each text; the weights of a kind add up to 1."""
    held: list[list[list[np.ndarray]]] = [[[], [], []] for _ in texts]
    for index, part in blocks(texts):
        for kind, (ids, of) in enumerate(zip(*features(part))):
            order = np.argsort(of, kind="stable")
            for k, x in enumerate(np.split(ids[order], np.searchsorted(of[order], np.arange(1, len(part))))):
                if len(x):
                    held[index[k]][kind].append(x)
    out = []
    for kinds in held:
        ids, weights = [np.empty(0, np.int32)], [np.empty(0)]
        for x in kinds:
            if x:
                i, n = np.unique(np.concatenate(x), return_counts=True)
                ids.append(i)
                weights.append(n / n.sum())
        out.append((np.concatenate(ids), np.concatenate(weights).astype(np.float32)))
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 5, rate: float = 0.3,
          dim: int = DIM, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weight per bucket, bias): the log-odds of label 1 are the bias plus the weighted
    sum over a text's bag. Folded from the learned vectors and the softmax layer."""
    labels = np.asarray(labels, np.int64)
    share = (labels.sum() + 0.5) / (len(labels) + 1.0)
    if len(np.unique(labels)) < 2:
        return np.zeros(1 << BUCKET_BITS, np.float32), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BUCKET_BITS, dim)).astype(np.float32)
    layer, bias = rng.uniform(-1 / dim, 1 / dim, (2, dim)).astype(np.float32), np.log(np.array([1 - share, share], np.float32))
    sq_v, sq_l, sq_b = np.full(1 << BUCKET_BITS, 1e-8, np.float32), np.full((2, dim), 1e-4, np.float32), np.full(2, 1.0, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(rows)):
            ids, weight = rows[k]
            if not len(ids):
                continue
            hidden = weight @ vectors[ids]
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = layer.T @ p
            grad = np.outer(p, hidden)
            sq_l += grad * grad
            layer -= step * grad / np.sqrt(sq_l)
            sq_b += p * p
            bias -= step * p / np.sqrt(sq_b)
            sq_v[ids] += weight * weight * float(back @ back)
            vectors[ids] -= (step * weight / np.sqrt(sq_v[ids]))[:, None] * back[None, :]
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def score(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 for each text."""
    total, n = np.zeros((3, len(texts))), np.zeros((3, len(texts)))
    for index, part in blocks(texts):
        for kind, (ids, of) in enumerate(zip(*features(part))):
            total[kind, index] += np.bincount(of, weights[ids], len(part))
            n[kind, index] += np.bincount(of, minlength=len(part))
    return 1 / (1 + np.exp(-(bias + (total / np.maximum(n, 1)).sum(axis=0))))


def held_out(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 5, is 0: never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, column: str, max_train_rows: int, label_id: str = "doc_id") -> DataFrame:
    """(label_id, text, label) of at most ``max_train_rows`` learnable rows, picked by hash."""
    rows = labels.select(F.col(f"`{label_id}`").alias("label_id"), F.col(f"`{column}`").alias("label")).where("label in (0, 1) and label_id is not null")
    rows = rows.where(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("label").alias("label"))
    rows = written(rows.orderBy(F.xxhash64("label_id"), "label_id").limit(max_train_rows), "labelled")
    first = docs.join(F.broadcast(rows), docs["doc_id"] == rows["label_id"])  # bounded by max_train_rows
    return first.groupBy("label_id", "label").agg(F.min("text").alias("text")).select("label_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", max_train_rows: int = 3000, max_train_bytes: int = 256 << 20) -> tuple[np.ndarray, float]:
    """Features in the tasks, gradient descent in one task over the sample; the driver gets
    the folded weights alone. ``docs`` is (doc_id, text). The sample is at most
    ``max_train_rows`` rows, in the order of a hash, and ``max_train_bytes`` of features."""
    def kernel(batches):
        for b in batches:
            got = bags(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0].astype("<i4").tobytes() for g in got], pa.binary()),
                                              pa.array([g[1].astype("<f4").tobytes() for g in got], pa.binary()), b.column(2).cast(pa.int32())], ["label_id", "ids", "weights", "label"])

    def descend(batches):
        rows, y = [], []
        for b in batches:
            for ids, weights, label in zip(*(b.column(i).to_pylist() for i in range(3))):
                rows.append((np.frombuffer(ids, "<i4"), np.frombuffer(weights, "<f4")))
                y.append(label)
        if rows:
            weights, bias = train(rows, np.array(y, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["weights", "bias"])
    sample = labelled(docs, labels, column, max_train_rows)
    kind = sample.schema["label_id"].dataType.simpleString()
    sample = written(sample.mapInArrow(kernel, f"label_id {kind}, ids binary, weights binary, label int"), "bags")
    order = [F.xxhash64("label_id"), F.col("label_id")]
    size = F.sum(F.octet_length("ids") + F.octet_length("weights")).over(Window.orderBy(*order))  # max_train_rows rows at most
    one = sample.withColumn("upto", size).where(F.col("upto") <= max_train_bytes).coalesce(1).sortWithinPartitions(*order)
    model = one.select("ids", "weights", "label").mapInArrow(descend, "weights binary, bias double").first()
    return (np.frombuffer(model["weights"], "<f4"), model["bias"]) if model else (np.zeros(1 << BUCKET_BITS, np.float32), 0.0)


def scored(docs: DataFrame, labels: DataFrame, column: str = "quality", threshold: float = 0.3, max_train_rows: int = 3000,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    d = slim(docs, id_col, text_col)
    weights, bias = fit(d, labels, column, max_train_rows)

    def kernel(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(b.column(1).to_pylist(), weights, bias))], ["doc_id", "score"])
    s = d.mapInArrow(kernel, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double")
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, column: str = "quality", threshold: float = 0.3, max_train_rows: int = 3000,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are predicted 1, all columns; each row has its own score, so
    rows pass or go where they are read."""
    weights, bias = fit(slim(docs, id_col, text_col), labels, column, max_train_rows)
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def kernel(batches):
        for b in batches:
            texts = [t or "" for t in b.column(at).cast(pa.string()).to_pylist()]
            yield b.filter(pa.array(score(texts, weights, bias) >= threshold))
    return docs.mapInArrow(kernel, docs.schema)
