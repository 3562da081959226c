"""Ranked lexical search: accumulator-limited term-at-a-time over blocks of postings.

Terms are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. One pass
over the documents keeps, per document, its number of terms and the (term, tf) pairs of
the query set's terms, and writes them; N, L and the df of each term are Spark
aggregations over that table. The second pass reads the table block by block. In a block,
every query takes its terms rarest first and adds each term's postings to accumulators.
Before a term it compares the sum of the bounds of the terms still to come (a bound is the
largest score that the term gives in the block) with the k-th best score known: of the
partial scores, or of what the same task has found before. Once the sum is lower, no
document without an accumulator can still be among the k best: no accumulator is created
any more, those that cannot reach the k-th score go, and the others are updated exactly.
The k best of all tasks are merged by a window over (query, score).

The query set is read in blocks of at most ``block_bytes`` of text (one item at least), so
what a task holds of it is bounded; each block is one pass over the documents. A task holds
one block of at most ``block_postings`` postings, or one document.

Weights and scores are those of the contract: w = floor(1000 ln((2N + 2) / (2 df + 1))) in
doubles, m = 100 - 25 + (25 n N) div L, and w * ((10^9 tf) div (1000 tf + 12 m)) summed over
the item's terms, repeats included, in 64-bit integers.

Defined cases: a null or termless text has no terms; it is not counted in N and never
found. A null or termless item finds nothing. Equal scores go by ascending doc_id, null
last, then by the order of rows. Rows that repeat a document are found each; rows that
repeat an item are searched each. Empty tables give no rows. Other columns of both tables
are not looked at.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import written
from .frames import raw_text, slices, slim
from .winnowing import Words


class QueryBlock:
    """Queries of one block: number, item id, and their distinct terms with repeats.
    ``hash``: the terms' hashes in ascending order, ``data``/``start``/``size`` their bytes."""

    def __init__(self, queries: list[tuple[int, str]]):
        counted = []
        for number, text in queries:
            raw = np.frombuffer(text.encode(), np.uint8)
            w = Words(raw, np.array([0, len(raw)], np.int64))
            names, times = np.unique(np.array([w.low[s:e].tobytes() for s, e in zip(w.start, w.end)], object), return_counts=True)
            first = dict(zip((w.low[s:e].tobytes() for s, e in zip(w.start, w.end)), w.hash.tolist()))
            counted.append((number, [(first[t], t, int(c)) for t, c in zip(names, times)]))
        terms = sorted({(h, t) for _, q in counted for h, t, _ in q})
        self.hash = np.array([h for h, _ in terms], np.uint64)
        if len(np.unique(self.hash)) < len(terms):
            raise ValueError("two query terms share a 64-bit hash")
        self.size = np.array([len(t) for _, t in terms], np.int64)
        self.start = self.size.cumsum() - self.size
        self.data = np.frombuffer(b"".join(t for _, t in terms), np.uint8)
        place = {t: i for i, (_, t) in enumerate(terms)}
        self.queries = [(n, np.array([place[t] for _, t, _ in q], np.int64), np.array([c for *_, c in q], np.int64)) for n, q in counted if q]

    def found(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that are terms of the block, and which: by hash, then byte by byte."""
        if not len(self.hash) or not len(w.hash):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.hash, w.hash), len(self.hash) - 1)
        word = np.flatnonzero(self.hash[at] == w.hash)
        term = at[word]
        same = (w.end - w.start)[word] == self.size[term]
        word, term = word[same], term[same]
        n = self.size[term]
        step = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
        equal = w.low[np.repeat(w.start[word], n) + step] == self.data[np.repeat(self.start[term], n) + step]
        same = np.logical_and.reduceat(equal, n.cumsum() - n) if len(n) else np.empty(0, bool)
        return word[same], term[same]


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))


def term_counts(docs: DataFrame, block: QueryBlock) -> DataFrame:
    """(doc_id, n, terms, tfs) per row of ``docs`` (doc_id, text) that has a term."""
    def kernel(batches):
        for b in (part for whole in batches for part in slices(whole, 1)):
            w = Words(*raw_text(b.column(1)))
            word, term = block.found(w)
            doc = np.searchsorted(w.first, word, "right") - 1
            pair, tf = np.unique(doc * np.int64(len(block.hash) + 1) + term, return_counts=True)
            doc, term = np.divmod(pair, np.int64(len(block.hash) + 1))
            ends = np.searchsorted(doc, np.arange(len(b) + 1))
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(w.first), pa.int64()), _lists(term, ends), _lists(tf, ends)],
                                             ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pc.greater(out.column(1), 0))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(kernel, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


class Shard:
    """Postings of some documents by term, with the score that each posting gives once."""

    def __init__(self, batch: pa.RecordBatch, weight: np.ndarray, n_docs: int, n_terms: int):
        n = batch.column(1).to_numpy(zero_copy_only=False)
        lists = batch.column(2)
        m = 75 + (25 * n * n_docs) // n_terms
        doc = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
        term, tf = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy().astype(np.int64)
        order = np.argsort(term, kind="stable")
        self.doc, term, tf = doc[order], term[order], tf[order]
        self.score = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[self.doc]))
        self.first = np.searchsorted(term, np.arange(len(weight) + 1))
        self.bound = np.zeros(len(weight), np.int64)
        there = np.flatnonzero(np.diff(self.first))
        if len(there):
            self.bound[there] = np.maximum.reduceat(self.score, self.first[there])
        self.total, self.open = np.zeros(len(batch), np.int64), np.zeros(len(batch), bool)

    def search(self, terms: np.ndarray, times: np.ndarray, k: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all documents that may be among the k best. ``terms`` are
        rarest first; ``known``: a score that k documents reach elsewhere, or 0."""
        use = self.bound[terms] > 0
        terms, times = terms[use], times[use]
        left = (self.bound[terms] * times)[::-1].cumsum()[::-1]  # bounds of this term and those to come
        held, limit, creating = np.empty(0, np.int64), known, True
        for i, t in enumerate(terms.tolist()):
            if creating:
                partial = self.total[held]
                if len(held) >= k:
                    limit = max(limit, int(np.partition(partial, len(held) - k)[len(held) - k]))
                if left[i] < limit:
                    creating = False
                    gone = partial + left[i] < limit
                    self._drop(held[gone])
                    held = held[~gone]
            doc, gain = self.doc[self.first[t]:self.first[t + 1]], self.score[self.first[t]:self.first[t + 1]] * times[i]
            if creating:
                new = doc[~self.open[doc]]
                self.open[new] = True
                held = np.concatenate([held, new])
            else:
                if not len(held):
                    break
                kept = self.open[doc]
                doc, gain = doc[kept], gain[kept]
            self.total[doc] += gain
        score = self.total[held]
        self._drop(held)
        return held, score

    def _drop(self, docs: np.ndarray) -> None:
        self.total[docs], self.open[docs] = 0, False


def _shards(batches, most: int):
    """Batches of term_counts joined until they hold ``most`` postings, and cut there."""
    held, size = [], 0
    for b in batches:
        ends = b.column(2).offsets.to_numpy()
        at = 0
        while at < len(b):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + most - size, "right")) - 1)
            part = b.slice(at, stop - at)
            held.append(part)
            size += int(ends[stop] - ends[at])
            at = stop
            if size >= most or at < len(b):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _best(docs: DataFrame, block: QueryBlock, weight: np.ndarray, df: np.ndarray, n_docs: int, n_terms: int, k: int, block_postings: int) -> DataFrame:
    """(query, doc_id, score, row) of each task's k best per query."""
    kind = docs.schema["doc_id"].dataType
    arrow_id = to_arrow_type(kind)
    queries = []
    for number, terms, times in block.queries:
        order = np.lexsort((terms, df[terms]))  # rarest first
        queries.append((number, terms[order], times[order]))

    def kernel(batches):
        best: dict[int, list] = {}
        rows = 0
        for b in _shards(batches, block_postings):
            shard = Shard(b, weight, n_docs, n_terms)
            ids = b.column(0)
            place = np.empty(len(b), np.int64)  # order of doc_ids, null last, rows in order
            place[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(b))
            for number, terms, times in queries:
                top = best.setdefault(number, [])
                docs, score = shard.search(terms, times, k, top[-1][0] if len(top) >= k else 0)
                if len(top) >= k:
                    use = score >= top[-1][0]
                    docs, score = docs[use], score[use]
                use = np.lexsort((place[docs], -score))[:k]
                use = use[score[use] > 0]
                top += [(int(s), ids[int(d)].as_py(), rows + int(d)) for d, s in zip(docs[use], score[use])]
                top.sort(key=lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1], x[2]))
                del top[k:]
            rows += len(b)
        found = [(q, *hit) for q, top in best.items() for hit in top]
        cols = list(zip(*found)) if found else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[2], arrow_id), pa.array(cols[1], pa.int64()), pa.array(cols[3], pa.int64())],
                                         ["query", "doc_id", "score", "row"])
    return docs.mapInArrow(kernel, f"query long, doc_id {kind.simpleString()}, score long, row long")


def _blocks(items: DataFrame, block_bytes: int):
    """The query set block by block: lists of (number, text) of about ``block_bytes``."""
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(-(-total // block_bytes), 1)
    for i in range(n):  # by a hash of the number: blocks of about equal size
        rows = items.where(F.pmod(F.xxhash64("number"), F.lit(n)) == i).select("number", "text").collect()
        if rows:
            yield [tuple(r) for r in rows]


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", block_bytes: int = 8 << 20, block_postings: int = 2_000_000) -> DataFrame:
    """The k best rows of ``docs`` per row of ``items``: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    d = slim(docs, id_col, text_col)
    asked = slim(items, item_col, item_text).withColumnRenamed("doc_id", "item_id")
    asked = written(asked.withColumn("number", F.monotonically_increasing_id()), "queries")
    found = None
    for queries in _blocks(asked, block_bytes):
        block = QueryBlock(queries)
        counts = written(term_counts(d, block), "term-counts", "zstd")
        n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs or not block.queries:
            continue
        df = np.zeros(len(block.hash), np.int64)
        for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a block's terms at most
            df[r["t"]] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        part = written(_best(counts, block, weight, df, n_docs, n_terms, k, block_postings), "best")
        found = part if found is None else found.unionByName(part)
    if found is None:
        kind = d.schema["doc_id"].dataType.simpleString()
        found = spark.createDataFrame([], f"query long, doc_id {kind}, score long, row long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row"))
    top = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(asked.select("number", "item_id"), top["query"] == F.col("number")).select("item_id", "rank", "doc_id", "score")
