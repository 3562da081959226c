"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

A text's features are its lower-cased words and the first bytes of longer words, hashed
into ``2^BUCKET_BITS`` buckets, with value 1 + log(count). One weight vector is shared by all thresholds:
P(grade <= k) = sigmoid(theta_k - x.w), theta increasing. It is fitted with
an L1 shrinkage that sets the weights of uninformative features to zero. The output is the expected severity, the sum over k of P(grade > k).

The labels only mark rows as toxic or not, so the query derives the grades: 0 for a row
that is not toxic; toxic rows are graded 1 to 3 by the terciles of their number of
telling features, which are those whose document frequency among toxic labelled rows is
at least ``lift`` times that among the others.

The model is fitted on the driver on at most ``max_train_rows`` labelled rows, picked by a
hash of the doc_id over all labelled rows (the documented bound). Defined cases: null and
wordless texts have no features and get the severity of x = 0; without rows of both kinds
every severity is 0; labels other than 0 and 1 are not learnt from; an empty table gives
no rows; repeated documents are each returned; other columns are not looked at.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .frames import raw_text, slices, slim
from .subword import held_out, labelled
from .winnowing import Words, mixed

BUCKET_BITS, GRADES = 20, 4
#: leading bytes of longer words that are features of their own
PREFIXES = (4, 6)


def sparse(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of every distinct bucket of every text."""
    w = Words(*raw_text(column))
    row = np.repeat(np.arange(len(column)), np.diff(w.first))
    rows, hashes = [row], [w.hash]
    for n in PREFIXES:
        long = np.flatnonzero(w.end - w.start > n)
        value = np.zeros(len(long), np.uint64)
        for j in range(n):
            value = value * np.uint64(256) + w.low[w.start[long] + j]
        rows.append(row[long])
        hashes.append(mixed(value + np.uint64(n << 56)))
    key = (np.concatenate(rows).astype(np.int64) << BUCKET_BITS) | (np.concatenate(hashes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    return key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1), count


def grades_of(row: np.ndarray, bucket: np.ndarray, count: np.ndarray, toxic: np.ndarray, lift: float = 4.0, least: int = 3) -> np.ndarray:
    """Severity grade 0..3 per row, from the toxic labels and the number of telling features."""
    n1, n0 = max(int(toxic.sum()), 1), max(int((1 - toxic).sum()), 1)
    df1 = np.bincount(bucket, toxic[row], 1 << BUCKET_BITS)
    df0 = np.bincount(bucket, 1 - toxic[row], 1 << BUCKET_BITS)
    telling = (df1 >= least) & ((df1 + 0.5) / n1 >= lift * (df0 + 0.5) / n0)
    n = np.bincount(row, telling[bucket], len(toxic))
    bad = toxic == 1
    cuts = np.quantile(n[bad], [1 / 3, 2 / 3]) if bad.any() else [0, 0]
    return np.where(bad, 1 + (n > cuts[0]) + (n > cuts[1]), 0).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_ordinal(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int = GRADES, z: float = 4.0,
                lift: float = 4.0, rounds: int = 600, shrink: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights per bucket, increasing thresholds) of the proportional-odds model, by
    accelerated proximal gradient steps on the whole sample with an L1 shrinkage. Only
    features that tell the other grades from grade 0 take part: their document frequency is
    ``lift`` times as high there, and the difference has a z-score of ``z`` at least."""
    n, above = len(grade), grades - 1
    share = np.clip(np.array([(grade <= k).mean() for k in range(above)]), 1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(above))
    weights = np.zeros(1 << BUCKET_BITS)
    if len(np.unique(grade)) < 2:
        return weights, np.full(above, 30.0)
    bad = grade > 0
    df1, df = np.bincount(bucket, bad[row], 1 << BUCKET_BITS), np.bincount(bucket, minlength=1 << BUCKET_BITS)
    p1, p0, p = df1 / bad.sum(), (df - df1) / (~bad).sum(), df / n
    apart = p1 - p0 >= z * np.sqrt(p * (1 - p) * (1 / bad.sum() + 1 / (~bad).sum()) + 1e-12)
    used = np.flatnonzero(apart & (p1 >= lift * p0))
    keep = np.isin(bucket, used)
    row, col, value = row[keep], np.searchsorted(used, bucket[keep]), value[keep]
    m = len(used)
    times = lambda w: np.bincount(row, w[col] * value, n)
    back = lambda r: np.bincount(col, r[row] * value, m)
    v = np.ones(m)
    for _ in range(12):  # largest curvature, by power iteration
        v = back(times(v)) / max(np.linalg.norm(v), 1e-12)
    step = 1 / (0.25 * np.linalg.norm(v) / n + 1.0)
    here, par = np.arange(n), np.concatenate([np.zeros(m), theta])
    ahead, speed = par.copy(), 1.0
    for _ in range(rounds):
        below = np.hstack([np.zeros((n, 1)), _sigmoid(ahead[None, m:] - times(ahead[:m])[:, None]), np.ones((n, 1))])
        slope = below * (1 - below)
        q = np.maximum(below[here, grade + 1] - below[here, grade], 1e-9)
        gx = back((slope[here, grade + 1] - slope[here, grade]) / q) / n  # d -log q / dx
        gt = [((slope[:, k + 1] / q)[grade == k + 1].sum() - (slope[:, k + 1] / q)[grade == k].sum()) / n for k in range(above)]
        new = ahead - step * np.concatenate([gx, gt])
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - step * shrink, 0)
        new[m:] = np.maximum.accumulate(new[m:])
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead, par, speed = new + (speed - 1) / faster * (new - par), new, faster
        ahead[m:] = np.maximum.accumulate(ahead[m:])
    weights[used] = par[:m]
    return weights, par[m:]


def grade_probabilities(column: pa.Array, weights: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """P(grade > k) per text, one column per threshold."""
    row, bucket, count = sparse(column)
    x = np.bincount(row, weights[bucket] * (1 + np.log(count)), len(column))
    return 1 - _sigmoid(theta[None, :] - x[:, None])


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", max_train_rows: int = 8000) -> tuple[np.ndarray, np.ndarray]:
    """Features in the tasks, the regression on the driver; ``docs`` is (doc_id, text)."""
    def kernel(batches):
        for b in (part for whole in batches for part in slices(whole, 0)):
            row, bucket, count = sparse(b.column(0))
            ends = np.searchsorted(row, np.arange(1, len(b)))
            yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i4").tobytes() for x in np.split(v, ends)], pa.binary()) for v in (bucket, count)]
                                             + [b.column(1).cast(pa.int32())], ["ids", "counts", "label"])
    sample = written(labelled(docs, labels, column, max_train_rows).select("text", "label").mapInArrow(kernel, "ids binary, counts binary, label int"), "words")
    ids, counts, toxic = [], [], []
    for r in sample.toLocalIterator():
        ids.append(np.frombuffer(r["ids"], "<i4"))
        counts.append(np.frombuffer(r["counts"], "<i4"))
        toxic.append(r["label"])
    if not toxic:
        return np.zeros(1 << BUCKET_BITS), np.full(GRADES - 1, 30.0)
    toxic, row = np.array(toxic), np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    bucket, count = np.concatenate(ids), np.concatenate(counts)
    return fit_ordinal(row, bucket, (1 + np.log(count)), grades_of(row, bucket, count, toxic))


def severities(docs: DataFrame, labels: DataFrame, column: str = "toxic", max_train_rows: int = 8000, threshold: float = 0.4,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, severity (expected grade, 0 to 3), grade (the
    likeliest), score (probability of grade 1 or more), toxic (score >= ``threshold``)."""
    d = slim(docs, id_col, text_col)
    weights, theta = fit(d, labels, column, max_train_rows)
    used = np.flatnonzero(weights)  # most are zero: ship the others
    values = weights[used]

    def kernel(batches):
        full = np.zeros(1 << BUCKET_BITS)
        full[used] = values
        for b in (part for whole in batches for part in slices(whole, 1)):
            above = grade_probabilities(b.column(1), full, theta)
            p = -np.diff(np.hstack([np.ones((len(b), 1)), above, np.zeros((len(b), 1))]), axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(above.sum(axis=1)), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0])],
                                             ["doc_id", "severity", "grade", "score"])
    s = d.mapInArrow(kernel, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, severity double, grade int, score double")
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "severity", "grade", "score", (F.col("score") >= threshold).alias("toxic"))
