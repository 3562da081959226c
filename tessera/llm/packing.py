"""Best-fit packing by minimum bin slack over the histogram of piece lengths.

Documents are token ids with an end id. A longer one is cut into pieces of the capacity,
its first piece taking the remainder. The packing depends on the lengths alone, so it is
planned on their histogram, which has at most ``capacity`` entries whatever the input:
per bin, a bitset subset-sum dynamic program over the available lengths finds the fullest
feasible combination (of equals, the one with the largest lengths), and it is removed.
The same combination stays the fullest as long as it is feasible, so it is removed as
often as the counts allow in one step. Both minimum-bin-slack forms are planned, free and
with the largest available length fixed in each bin; the one with fewer bins is used.

Scale: each piece needs its rank among the pieces of its length. Ranks are counted within
the tasks that write the pieces and shifted by prefix sums over (task, length) counts, so
no length is gathered in one place; the plan is a lookup of bounded size.

Defined cases: a null text is empty and gives the end id alone; rows that repeat a doc_id
are packed each; an empty table gives no rows; other columns are not looked at.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .frames import slices, slim
from .tokens import END_ID, encoder

CAPACITY = 2048


def _fullest(counts: dict[int, int], lengths: list[int], room: int, layers: list[int]) -> list[tuple[int, int]]:
    """[(length, times)] of the fullest sum within ``room``; ``layers[i]`` has bit s set
    if lengths[:i] (ascending, bounded by their counts) can add up to s."""
    target = (layers[len(lengths)] & ((1 << (room + 1)) - 1)).bit_length() - 1
    picks = []
    for i in range(len(lengths) - 1, -1, -1):
        if not target:
            break
        size = lengths[i]
        for times in range(min(counts[size], target // size), -1, -1):
            if (layers[i] >> (target - times * size)) & 1:
                break
        if times:
            picks.append((size, times))
            target -= times * size
    return picks


def _layers(counts: dict[int, int], lengths: list[int], capacity: int, layers: list[int], start: int) -> None:
    full = (1 << (capacity + 1)) - 1
    del layers[start + 1:]
    for size in lengths[start:]:
        reach, left, step = layers[-1], min(counts[size], capacity // size), 1
        while left:
            take = min(step, left)
            reach |= (reach << (take * size)) & full
            left -= take
            step *= 2
        layers.append(reach)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY, fixed: bool = False) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(bins, [(length, times), ...])]: how often each combination is used.

    ``fixed``: every bin holds the largest available length.
    """
    counts = {n: c for n, c in histogram.items() if c}
    lengths = sorted(counts)
    layers, plan = [1], []
    _layers(counts, lengths, capacity, layers, 0)
    while lengths:
        if fixed:
            top = lengths[-1]
            counts[top] -= 1
            _layers(counts, lengths, capacity, layers, len(lengths) - 1)
            picks = dict(_fullest(counts, lengths, capacity - top, layers))
            counts[top] += 1
            picks[top] = picks.get(top, 0) + 1
            picks = list(picks.items())
        else:
            picks = _fullest(counts, lengths, capacity, layers)
        bins = min(counts[n] // t for n, t in picks)
        plan.append((bins, sorted(picks, reverse=True)))
        changed = min(n for n, _ in picks)
        start = lengths.index(changed)
        for n, t in picks:
            counts[n] -= bins * t
        lengths = lengths[:start] + [n for n in lengths[start:] if counts[n]]
        _layers(counts, lengths, capacity, layers, start)
    return plan


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """The plan of fewer bins of the two forms."""
    return min((plan_bins(histogram, capacity, fixed) for fixed in (True, False)), key=lambda p: sum(b for b, _ in p))


class Places:
    """Sequence and offset of the r-th piece of each length, from a plan."""

    def __init__(self, plan: list[tuple[int, list[tuple[int, int]]]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        sequence = 0
        for bins, picks in plan:
            offset = 0
            for n, times in picks:
                at = taken.get(n, 0)
                rows.setdefault(n, []).append((at, sequence, times, offset))
                taken[n] = at + bins * times
                offset += n * times
            sequence += bins
        self.by_length = {n: np.array(r, np.int64).T for n, r in rows.items()}

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length):
            here = length == n
            at, first, times, start = self.by_length[int(n)]
            i = np.searchsorted(at, rank[here], "right") - 1
            r = rank[here] - at[i]
            sequence[here] = first[i] + r // times[i]
            offset[here] = start[i] + (r % times[i]) * n
        return sequence, offset


_PIECE = "piece int, start long, length long, ids_crc32 long, task int, in_task long"


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, in_task[, ids]) per piece; in_task
    is its rank among the pieces of its length that the same task wrote."""
    def kernel(batches):
        enc, end, seen = encoder(tokenizer), np.uint32(END_ID).tobytes(), {}
        for b in (part for whole in batches for part in slices(whole, 1)):
            rows = []
            for i, raw in enumerate(enc.encode_all(b.column(1).to_pylist())):
                raw += end
                n = len(raw) // 4
                at, size = 0, (n - 1) % capacity + 1
                for piece in range((n + capacity - 1) // capacity):
                    ids = raw[4 * at:4 * (at + size)]
                    seen[size] = seen.get(size, -1) + 1
                    rows.append((i, piece, at, size, zlib.crc32(ids), seen[size], ids if with_ids else None))
                    at, size = at + size, capacity
            i, piece, at, size, crc, rank, ids = zip(*rows) if rows else [()] * 7
            task = b.column(2).take(pa.array(i, pa.int64()))
            cols = [b.column(0).take(pa.array(i, pa.int64())), pa.array(piece, pa.int32()), pa.array(at, pa.int64()), pa.array(size, pa.int64()),
                    pa.array(crc, pa.int64()), task, pa.array(rank, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "in_task"]
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)
    d = slim(docs, id_col, text_col).withColumn("task", F.spark_partition_id())
    return d.mapInArrow(kernel, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {_PIECE}" + ", ids binary" * with_ids)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (from ``pieces``, written once) with sequence_id and offset."""
    sizes = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    place = Places(best_plan(histogram, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("task", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = cut.join(base, ["task", "length"]).withColumn("rank", F.col("before") + F.col("in_task")).drop("before", "task", "in_task")

    def kernel(batches):
        for b in batches:
            cols = {n: b.column(n) for n in b.schema.names if n != "rank"}
            s, o = place(cols["length"].to_numpy(zero_copy_only=False), b.column("rank").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_pydict({**cols, "sequence_id": pa.array(s), "offset": pa.array(o)})
    out = ranked.drop("rank").schema
    return ranked.mapInArrow(kernel, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out) + ", sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]."""
    cut = written(pieces(docs, tokenizer, capacity, id_col, text_col, with_ids), "pieces")
    out = pack(cut, capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) from ``packed(..., with_ids=True)``; a group is one
    sequence, so at most ``capacity`` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))")
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select("sequence_id", "n_tokens", joined.alias("ids"))
