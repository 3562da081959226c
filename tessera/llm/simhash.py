"""SimHash near-dedup with the generalised pigeonhole principle.

A text is lower-cased (A-Z), cut into words ``[^\\x20\\x09-\\x0D]+`` and 3-word shingles
(repeats included; fewer words: the whole sequence; none: fingerprint zero). A shingle's
hash is XXH64 of its UTF-8 bytes with seed 42, and a fingerprint bit is 1 if it is set in
over half of the hashes. Fingerprints link at ``distance`` or fewer differing bits.

Candidates: the 64 bits are grouped into partitions of correlated bits. By the general
pigeonhole principle, if the partitions' thresholds add up to distance - partitions + 1,
two linked fingerprints are within the threshold of at least one partition. A dynamic
program picks the thresholds (and the number of partitions) of least estimated cost from
counts over all fingerprints. A partition of threshold t is probed by masks that leave
out t of its bits; equal masked values are candidates, and all are verified.

Scale: only distinct fingerprints are probed. A bucket emits no pairs but a spanning
forest of its links. A bucket over ``cap`` is not collected: its members agree on the
mask, so it is cut again by three masks over the other bits, which loses no link and ends
because at most 2^r fingerprints differ in the last r bits.

Defined cases: a null text is empty and links like any other; every row is a node, so rows
without a doc_id link others (component_id is the least doc_id reached, null if there is
none) and texts that share a doc_id are not linked by it; rows that repeat a doc_id are
each returned; an empty table gives no rows; other columns are not looked at.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .components import components
from .frames import first_of, keep_rows, numbered, slim

BITS, SEED = 64, 42
_PARTS = (2, 3, 4)
#: cost of one index row, in verified pairs
_ROW_COST = 4.0


def _word_blocks(raw: bytes, block: int = 1 << 21) -> Iterator[list[bytes]]:
    """Words of a text in lists of about ``block`` bytes of text, cut at white space."""
    if len(raw) <= block:
        yield raw.split()
        return
    at = 0
    while at < len(raw):
        end = at + block
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield raw[at:end].split()
        at = end


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one UTF-8 text."""
    from xxhash import xxh64_intdigest as h64
    ones, n, tail = np.zeros(BITS, np.int64), 0, []
    for words in _word_blocks(raw.lower()):
        words = tail + words
        grams = [b" ".join(g) for g in zip(*(words[i:] for i in range(shingle)))]
        tail = words[1 - shingle:] if shingle > 1 else []
        for at in range(0, len(grams), 1 << 15):
            h = np.array([h64(g, SEED) for g in grams[at:at + (1 << 15)]], dtype=">u8")
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            n += len(h)
    if not n and tail:
        h = np.array([h64(b" ".join(tail), SEED)], dtype=">u8")
        ones, n = np.unpackbits(h.view(np.uint8)).astype(np.int64), 1
    return int(np.packbits(ones * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint's bit pattern as a signed long."""
    def kernel(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = [fingerprint(t.as_py(), shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])
    d = slim(docs, id_col, text_col)
    return d.mapInArrow(kernel, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def bit_counts(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints with both bits set (bit 0 is the highest)."""
    def kernel(batches):
        total = np.zeros((BITS, BITS))
        for b in batches:
            x = _bits(b.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            total += x.T @ x
        i, j = np.indices((BITS, BITS))
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (i.astype(np.int32), j.astype(np.int32), total)], ["i", "j", "n"])
    rows = fps.select("fp").mapInArrow(kernel, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((BITS, BITS))
    for r in rows:  # 64 x 64 numbers, whatever the input
        out[r["i"], r["j"]] = r["n"]
    return out


def group_bits(both: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """Partitions of equal size: each starts from the free bit of most correlation and
    takes the free bits most correlated with it."""
    p = both.diagonal() / max(total, 1)
    cov = both / max(total, 1) - np.outer(p, p)
    sd = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = (BITS * (k + 1)) // parts - (BITS * k) // parts
        part = [max(free, key=lambda b: corr[b, free].sum())]
        free.remove(part[0])
        while len(part) < size:
            b = max(free, key=lambda b: corr[b, part].sum())
            part.append(b)
            free.remove(b)
        out.append(sorted(part))
    return out


def mask_of(bits) -> int:
    return sum(1 << (BITS - 1 - b) for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def collisions(fps: DataFrame, masks: list[int]) -> list[int]:
    """Pairs of fingerprints that agree under each mask, counted over all of them."""
    rows = _keys(fps, masks).groupBy("mask", "key").count().groupBy("mask").agg(
        F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()
    got = {r["mask"]: r["pairs"] for r in rows}
    return [got.get(_signed(m), 0.0) for m in masks]


def allocate(parts: list[list[int]], pairs0: list[float], p: np.ndarray, total: int, distance: int) -> tuple[float, list[int]]:
    """Cost and thresholds (-1: not probed) of least cost that add up to
    distance - len(parts) + 1, by dynamic programming over the partitions."""
    odds = 2 * p * (1 - p) / np.clip(1 - 2 * p * (1 - p), 1e-9, None)

    def cost(i: int, t: int) -> float:
        if t < 0:
            return 0.0
        rows = sum(1 for _ in combinations(parts[i], t)) * total
        e, o = [1.0, 0.0, 0.0], odds[parts[i]]  # elementary symmetric sums of the odds
        for x in o:
            e = [e[0], e[1] + x * e[0], e[2] + x * e[1]]
        return _ROW_COST * rows + pairs0[i] * sum(e[:t + 1])

    best = {0: (0.0, [])}
    for i in range(len(parts)):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, min(distance, 2) + 1):
                got = (c + cost(i, t), [*ts, t])
                if used + t not in step or got[0] < step[used + t][0]:
                    step[used + t] = got
        best = step
    return best[distance - len(parts) + 1]


def probe_masks(parts: list[list[int]], thresholds: list[int]) -> list[int]:
    """The masks whose equality finds every pair within the thresholds."""
    return [mask_of(set(part) - set(out)) for part, t in zip(parts, thresholds) if t >= 0 for out in combinations(part, t)]


def plan_masks(fps: DataFrame, distance: int = 2) -> list[int]:
    """Partitions, thresholds and masks of least estimated cost for these fingerprints."""
    both = bit_counts(fps)
    total = fps.count()
    options = [(group_bits(both, total, m)) for m in _PARTS]
    counts = iter(collisions(fps, [mask_of(part) for parts in options for part in parts]))
    p = both.diagonal() / max(total, 1)
    plans = [(*allocate(parts, [next(counts) for _ in parts], p, total, distance), parts) for parts in options]
    _, thresholds, parts = min(plans, key=lambda x: x[0])
    return probe_masks(parts, thresholds)


def _keys(fps: DataFrame, masks: list[int]) -> DataFrame:
    """One row per fingerprint and mask."""
    return fps.withColumn("mask", F.explode(F.array(*[F.lit(_signed(m)) for m in masks]).cast("array<long>"))) \
        .withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def _forest(fps: np.ndarray, reps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member) for every linked component within one bucket."""
    if len(fps) == 2:
        if int(fps[0] ^ fps[1]).bit_count() <= distance:
            return np.array([max(reps)]), np.array([min(reps)])
        return reps[:0], reps[:0]
    todo, out_a, out_b = np.arange(len(fps)), [], []
    while len(todo) > 1:
        group, todo, edge = [todo[:1]], todo[1:], [todo[0]]
        while edge and len(todo):
            near = np.bitwise_count(fps[todo] ^ fps[edge.pop()]) <= distance
            if near.any():
                group.append(todo[near])
                edge.extend(todo[near])
                todo = todo[~near]
        r = reps[np.concatenate(group)]
        if len(r) > 1:
            out_a.append(r[r != r.min()])
            out_b.append(np.full(len(out_a[-1]), r.min()))
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (reps[:0], reps[:0])


def links(nodes: DataFrame, distance: int = 2, cap: int = 4096) -> DataFrame:
    """Edges (a, b) between node ids that span the components of the link graph.

    ``nodes``: distinct fingerprints (fp) with one id each (rep).
    """
    def kernel(batches):
        for b in batches:
            lists = b.column(0)
            flat, ends = lists.flatten(), np.diff(lists.offsets.to_numpy()).cumsum()
            fps, reps = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            got = [_forest(fps[s:e].view(np.uint64), reps[s:e], distance) for s, e in zip([0, *ends[:-1]], ends)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([g[k] for g in got]) if got else np.empty(0, np.int64), pa.int64()) for k in (0, 1)], ["a", "b"])

    spark = nodes.sparkSession
    masks = plan_masks(nodes, distance)
    rows, edges = _keys(nodes, masks), None
    while True:
        sizes = written(rows.groupBy("mask", "key").count().where("count > 1"), "sizes")
        cold = rows.join(sizes.where(F.col("count") <= cap), ["mask", "key"], "left_semi")
        found = cold.groupBy("mask", "key").agg(F.collect_list(F.struct("fp", "rep")).alias("members"))
        found = found.select("members").mapInArrow(kernel, "a long, b long")
        edges = written(found.distinct(), "links") if edges is None else edges.union(written(found.distinct(), "links"))
        hot = sizes.where(F.col("count") > cap)
        masks = [r["mask"] for r in hot.select("mask").distinct().collect()]  # a few per level
        if not masks:
            return edges
        finer = []
        for m in masks:
            rest = [b for b in range(BITS) if not (m >> (BITS - 1 - b)) & 1]
            finer += [(m, _signed((m % (1 << 64)) | mask_of(rest[k::distance + 1]))) for k in range(distance + 1)]
        finer = spark.createDataFrame(finer, "mask long, finer long")
        rows = rows.join(hot, ["mask", "key"], "left_semi").join(F.broadcast(finer), "mask").select(
            "fp", "rep", F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key")).distinct()
        rows = written(rows, "refined")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                distance: int = 2, cap: int = 4096) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the least
    doc_id of the rows linked to it, null if none has one). Rows are the nodes of the
    links, so rows without a doc_id link others and rows that share one are not linked by it."""
    fps = written(fingerprints(docs, id_col, text_col, shingle).withColumn("node", F.monotonically_increasing_id()), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("node").alias("rep"), F.min("doc_id").alias("least")), "nodes")
    roots = written(components(links(nodes.select("fp", "rep"), distance, cap)), "roots")
    named = written(nodes.join(roots, nodes["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("root"), "least"), "named")
    byfp = written(named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id"), "components")
    return fps.join(byfp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """One row of each group of linked texts stays: the smallest doc_id, null last. Every row
    is a node, so texts that share a doc_id are not linked by it. All columns."""
    rows, row = numbered(docs)
    groups = near_groups(rows, row, text_col, shingle, distance).select(F.col("doc_id").alias("node_row"), "component_id")
    places = rows.select(F.col(row).alias("place_row"), first_of(rows, id_col, row).alias("place"))
    kept = groups.join(places, groups["node_row"] == places["place_row"]).groupBy("component_id").agg(F.min("place").alias("best"))
    return keep_rows(rows, row, kept.select(F.col("best.row").alias("kept_row")))
