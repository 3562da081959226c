"""Benchmark decontamination by winnowing.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. Of every
sliding window of ``window - k + 1`` consecutive k-grams the minimum hash is kept (the
rightmost of equals), in documents and in benchmark items alike, so two texts that share
``window`` consecutive words share a kept k-gram of that span. Kept hashes are joined,
each hit is compared word by word and extended to both sides, and it counts if at least
``window`` words agree. An item of fewer words is one window of its own length: documents
are probed with grams of exactly that length.

Scale: documents send only hashes that a bitmap of fixed size (2^24 bits, or-ed together
from all items) may know, so the join sees the hits and few others; items with the same
surroundings are one class before the join; a passage that many documents share is a hot
key of a plain equi-join, which the adaptive planner can split.

Defined cases: null or wordless texts have no words and no hits, null or wordless items
occur nowhere, an item without an id marks words as hit but is not counted; repeated
documents are each returned; repeated items count once by id; empty tables give no rows
or no hits; other columns are not looked at.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .frames import keep_rows, numbered, raw_text, slices, slim

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BITMAP = 24
_STEP = 1 << 22


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), base)]).astype(np.uint64))


def _pieces(low: np.ndarray, offsets: np.ndarray):
    """Byte ranges of about ``_STEP`` that cut no word."""
    at = 0
    while at < len(low):
        end = min(at + _STEP, len(low))
        doc = offsets[np.searchsorted(offsets, end, "right") - 1]
        if doc > at:
            end = int(doc)
        else:
            while end < len(low) and _WORD[low[end]] and end not in offsets:
                end += 1
        yield at, end
        at = end


class Words:
    """Words of a batch of texts as arrays: hash, first byte, end byte, and the number of
    the text's first word (``first``, one longer than the texts)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = _LOWER[data]
        hashes, starts, ends = [], [], []
        for a, b in _pieces(low, offsets):
            part = low[a:b]
            word = _WORD[part]
            cut = offsets[(offsets >= a) & (offsets < b)] - a
            before = np.concatenate([[False], word[:-1]])
            before[cut] = False
            after = np.concatenate([word[1:], [False]])
            after[cut[cut > 0] - 1] = False
            s, e = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
            n = e - s
            place = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
            power = _powers(_P, int(n.max(initial=0)) + 1)
            value = (part[word].astype(np.uint64) + np.uint64(1)) * power[place]
            hashes.append(mixed(np.add.reduceat(value, n.cumsum() - n)) if len(n) else np.empty(0, np.uint64))
            starts.append(s + a)
            ends.append(e + a)
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
        self.low, self.hash = low, join(hashes, np.uint64)
        self.start, self.end = join(starts, np.int64), join(ends, np.int64)
        self.first = np.searchsorted(self.start, offsets)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie in one text."""
        n = len(self.hash)
        total = np.zeros(n, np.uint64)
        for j, q in enumerate(_powers(_Q, k)):
            total[:n - j] += self.hash[j:] * q
        last = np.repeat(self.first[1:], np.diff(self.first))
        return mixed(total + np.uint64(k)), np.arange(n) + k <= last

    def kept(self, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and word numbers of the winnowed k-grams."""
        n, span = len(self.hash), window - k + 1
        if n < window:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        g, _ = self.grams(k)
        _, whole = self.grams(window)
        least = g[:n - span + 1].copy()
        at = np.zeros(n - span + 1, np.int64)
        for j in range(1, span):
            nxt = g[j:n - span + 1 + j]
            lower = nxt <= least
            least[lower] = nxt[lower]
            at[lower] = j
        places = np.unique((np.arange(n - span + 1) + at)[whole[:n - span + 1]])
        return g[places], places

    def text(self, i: int, j: int) -> list[str]:
        """Words i to j."""
        return [self.low[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(self.start[i:j], self.end[i:j])]


_HIT = "array<struct<hash:long,pos:long,core:string,left:array<string>,right:array<string>,whole:boolean>>"


def _hit(w: Words, h: int, place: int, k: int, first: int, last: int, reach: int, whole: bool = False) -> dict:
    """One k-gram with up to ``reach`` words to either side, nearest first; ``whole``: a
    short item's only window."""
    return {"whole": whole, "hash": int(np.uint64(h).view(np.int64)), "pos": int(place - first), "core": " ".join(w.text(place, place + k)),
            "left": w.text(max(first, place - reach), place)[::-1], "right": w.text(place + k, min(last, place + k + reach))}


def _known(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = (h >> np.uint64(64 - _BITMAP)).astype(np.int64)
    return (bitmap[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1


def _arrow(rows: list) -> pa.Array:
    fields = pa.struct([("hash", pa.int64()), ("pos", pa.int64()), ("core", pa.string()),
                        ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string())), ("whole", pa.bool_())])
    return pa.array(rows, pa.list_(fields))


def item_hits(items: DataFrame, k: int, window: int) -> DataFrame:
    """(item_id, n_words, hits) per item: its kept k-grams, or its one short window."""
    def kernel(batches):
        for b in (part for whole in batches for part in slices(whole, 1)):
            w, out, counts = Words(*raw_text(b.column(1))), [], []
            hashes, places = w.kept(k, window)
            for i, (first, last) in enumerate(zip(w.first[:-1], w.first[1:])):
                n = last - first
                if n >= window:
                    s, e = np.searchsorted(places, (first, last))
                    out.append([_hit(w, h, p, k, first, last, window - k) for h, p in zip(hashes[s:e], places[s:e])])
                elif n:
                    out.append([_hit(w, w.grams(int(n))[0][first], first, int(n), first, last, 0, True)])
                else:
                    out.append([])
                counts.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), _arrow(out)], ["item_id", "n_words", "hits"])
    return items.mapInArrow(kernel, f"item_id {items.schema[0].dataType.simpleString()}, n_words long, hits {_HIT}")


def _bitmap(hits: DataFrame) -> np.ndarray:
    """All items' hashes in 2^24 bits: at most 2^18 rows reach the driver."""
    place = F.shiftrightunsigned("hash", 64 - _BITMAP)
    rows = hits.select((place / 64).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - _BITMAP}) % 64 as int))").alias("bit")) \
        .groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()
    out = np.zeros(1 << (_BITMAP - 6), np.uint64)
    for r in rows:
        out[r["at"]] = np.int64(r["bits"]).view(np.uint64)
    return out


def document_hits(docs: DataFrame, bitmap: np.ndarray, k: int, window: int, short: list[int]) -> DataFrame:
    """(uid, doc_id, n_words, hits) per document; hits: what the bitmap may know."""
    def kernel(batches):
        for b in (part for whole in batches for part in slices(whole, 2)):
            w = Words(*raw_text(b.column(2)))
            found = [(*w.kept(k, window), k, window - k)]
            for m in short:
                g, whole = w.grams(m)
                found.append((g[whole], np.flatnonzero(whole), m, 0))
            out: list[list] = [[] for _ in range(len(b))]
            for hashes, places, size, reach in found:
                known = _known(bitmap, hashes)
                for h, p in zip(hashes[known], places[known]):
                    i = int(np.searchsorted(w.first, p, "right")) - 1
                    out[i].append(_hit(w, h, p, size, w.first[i], w.first[i + 1], reach))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(w.first), pa.int64()), _arrow(out)],
                                             ["uid", "doc_id", "n_words", "hits"])
    d = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    return d.mapInArrow(kernel, f"uid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, hits {_HIT}")


def _agree(a: Column, b: Column, most: int) -> Column:
    """How many leading words of two arrays are equal."""
    n = F.lit(0)
    for i in reversed(range(most)):
        n = F.when(F.coalesce(F.get(a, F.lit(i)) == F.get(b, F.lit(i)), F.lit(False)), n + 1).otherwise(0)
    return n


def hit_spans(docs: DataFrame, benchmark: DataFrame, k: int = 5, window: int = 10, id_col: str = "doc_id",
              text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: uid, doc_id, n_words, spans (array of struct(start, end), word
    numbers, may overlap) and items (ids of the items with a window in the document)."""
    items = written(item_hits(slim(benchmark, item_col, item_text).withColumnRenamed("doc_id", "item_id"), k, window), "items")
    short = [r[0] for r in items.where(f"n_words between 1 and {window - 1}").select("n_words").distinct().collect()]  # under `window` rows
    keys = items.select("item_id", F.explode("hits").alias("h"))
    bitmap = _bitmap(keys.select("h.hash"))
    base = written(document_hits(slim(docs, id_col, text_col), bitmap, k, window, short), "hits")
    classes = written(keys.groupBy("h.hash", "h.core", "h.left", "h.right", "h.whole").agg(F.collect_set("item_id").alias("items")), "classes")
    i, d = classes, base.select("uid", F.explode("hits").alias("h")).select("uid", "h.*")
    reach = window - k
    both = d.join(i, (d["hash"] == i["hash"]) & (d["core"] == i["core"])).select(
        "uid", "pos", "items", i["whole"], F.size(F.split(d["core"], " ")).alias("n"),
        _agree(d["left"], i["left"], reach).alias("l"), _agree(d["right"], i["right"], reach).alias("r"))
    spans = both.where((F.col("n") + F.col("l") + F.col("r") >= window) | F.col("whole"))
    spans = spans.groupBy("uid").agg(
        F.array_sort(F.collect_set(F.struct((F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("n") + F.col("r")).alias("end")))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return base.select("uid", "doc_id", "n_words").join(spans, "uid", "left")


def covered(spans: Column) -> Column:
    """Words in the union of sorted spans; null: none."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], acc["to"]))).alias("n"),
                                   F.greatest(acc["to"], s["end"]).alias("to"))
    return F.coalesce(F.aggregate(spans, zero, step, lambda acc: acc["n"]), F.lit(0).cast("long"))


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = 5, window: int = 10, **cols: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    s = hit_spans(docs, benchmark, k, window, **cols)
    ids = F.array_sort(F.coalesce(F.transform("items", lambda x: x.cast("string")), F.array().cast("array<string>")))
    return s.select("doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), ids.alias("ids")).select(
        "doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, window: int = 10, **cols: str) -> DataFrame:
    """The rows of ``docs`` without a benchmark window, all columns; each row by its own text."""
    rows, row = numbered(docs)
    clean = contamination(rows, benchmark, k, window, id_col=row, **cols).where("not contaminated")
    return keep_rows(rows, row, clean.select(F.col("doc_id").alias("kept_row")))
