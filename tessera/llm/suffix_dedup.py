"""Suffix-array dedup by difference-cover blockwise construction.

A byte is removed if it lies in a string of ``length`` bytes that also starts anywhere else
in the table, the same document included. Texts are UTF-8 bytes; no string crosses two
documents; strings are judged on the input.

Buckets. Of the 16-byte grams of each ``length``-byte window the least hash names the
window's bucket, so equal windows meet in one bucket wherever they stand. Consecutive
windows with one such hash are a segment, sent as one piece of text instead of window by
window. Segments whose bucket no other segment names are dropped at once (their windows
are unique), segments whose whole text occurs twice are settled by a 128-bit BLAKE2 digest,
and of the rest each distinct text is sent to its bucket once.

Blocks. Partitions are sorted by bucket; whole buckets are taken until they fill a block of
``block_bytes``, and the suffixes that start a window of the block are sorted, one block at a
time. They are sorted by their first 64 bytes, eight at a time; what is still equal is
resolved by ranks of a difference-cover sample of the block (positions that are 0 to 7 or a
multiple of 8 modulo 64), computed before by prefix doubling over the sample: for any two
suffixes a shift under 64 takes both to sample positions, whose ranks order them. So a
comparison never reads more than 64 bytes however long the repeats are. Neighbours in the
order that agree in ``length`` bytes are repeats.

Hot buckets. A bucket with more than ``block_bytes`` of distinct text (say, the edge of a
passage that a third of all documents quote) is not sorted in one task: its windows are
dealt anew by the digest of the whole window and counted there. Nothing is dropped.

Scale: one pass cuts segments (one row per some 90 bytes without its text); joins on hash
and row are between written tables, which the adaptive planner can split; text is shuffled
for the segments that share a bucket and for the last step. Memory of a task is a block, a
batch of texts or one document's marks.

Defined cases: a null text is empty; a text shorter than ``length`` keeps all; every row is
a document of its own, rows that repeat one or lack a doc_id included; a removed run may
cut a character, so what is kept is bytes. An empty table gives no rows. Other columns of
the input are not looked at.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, written, written_alone
from .frames import raw_text, slices, slim
from .winnowing import mixed

LENGTH = 200
_GRAM = 16
_STEP = 4 << 20  # bytes of text handled at a time
_MOST = 4096  # windows of a segment
_PAD = 1024
_V = 64
_COVER = np.array([i < 8 or i % 8 == 0 for i in range(_V)])
#: least shift that takes positions of two residues into the cover
_SHIFT = np.argmax(np.stack([[[_COVER[(i + d) % _V] and _COVER[(j + d) % _V] for d in range(_V)] for j in range(_V)] for i in range(_V)]), axis=2).astype(np.int64)


# ---- segments ------------------------------------------------------------------------

def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` consecutive values."""
    n, done = len(x) - width + 1, 1
    while 2 * done <= width:
        x = pick(x[:len(x) - done], x[done:])
        done *= 2
    return pick(x[:n], x[width - done:width - done + n]) if done < width else x[:n]


def _at_every_byte(data: np.ndarray, order: str) -> np.ndarray:
    """Eight bytes from each position on as one number; ``data`` is padded by the caller."""
    return np.ndarray(len(data) - 7, f"{order}u8", np.ascontiguousarray(data), strides=(1,))


def _segments(data: np.ndarray, offsets: np.ndarray, length: int):
    """(text number, start, windows, hash, several) arrays of the segments of some texts;
    ``several``: the hash occurs more than once in the segment."""
    none = np.empty(0, np.int64)
    width, size = length - _GRAM + 1, np.diff(offsets)
    if not (size >= length).any():
        return none, none, none, np.empty(0, np.uint64), np.empty(0, bool)
    word = _at_every_byte(np.concatenate([data, np.zeros(_GRAM, np.uint8)]), "<")
    n = len(data) - _GRAM + 1
    gram = mixed(mixed(word[:n] + np.uint64(1)) + word[8:n + 8])
    least = _sliding(gram, width, np.minimum)
    edge = np.zeros(len(data) + 1, np.int8)
    long = np.flatnonzero(size >= length)
    edge[offsets[long]] += 1
    edge[offsets[long + 1] - length + 1] -= 1
    inside = edge.cumsum(dtype=np.int8)[:len(least)] > 0
    joined = inside[1:] & inside[:-1] & (least[1:] == least[:-1])
    start = np.flatnonzero(inside & np.concatenate([[True], ~joined]))
    windows = np.flatnonzero(inside & np.concatenate([~joined, [True]])) - start + 1
    parts = -(-windows // _MOST)  # cut the longest
    step = np.arange(parts.sum()) - np.repeat(parts.cumsum() - parts, parts)
    start, windows = np.repeat(start, parts) + step * _MOST, np.minimum(np.repeat(windows, parts) - step * _MOST, _MOST)
    value = least[start]
    # grams that are the least of some window, and how many of them a segment's hash names
    most = _sliding(np.concatenate([np.zeros(width - 1, np.uint64), np.where(inside, least, np.uint64(0)), np.zeros(width - 1, np.uint64)]), width, np.maximum)
    anchor = np.flatnonzero(most == gram)
    first, last = np.searchsorted(anchor, start), np.searchsorted(anchor, start + windows + width - 1)
    count = last - first
    each = np.repeat(first - (count.cumsum() - count), count) + np.arange(count.sum())
    hit = gram[anchor[each]] == np.repeat(value, count)
    total = np.concatenate([[0], hit.cumsum()])
    ends = count.cumsum()
    several = total[ends] - total[ends - count] > 1
    return np.searchsorted(offsets, start, "right") - 1, start, windows, value, several


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """(bytes before, data, offsets) of parts that hold whole windows: a very long text comes
    in parts that overlap by a window."""
    if len(data) <= 2 * _STEP or len(offsets) > 2:
        yield 0, data, offsets
        return
    for a in range(0, len(data) - length + 1, _STEP):
        part = data[a:a + _STEP + length - 1]
        yield a, part, np.array([0, len(part)], np.int64)


def segments(docs: DataFrame, length: int) -> DataFrame:
    """(row_id, start, windows, gram, d1, d2, several) per segment of ``docs`` (row_id, text)."""
    def kernel(batches):
        for b in (part for whole in batches for part in slices(whole, 1, _STEP)):
            rows = b.column(0).to_numpy()
            for before, data, offsets in _pieces(*raw_text(b.column(1)), length):
                text, start, windows, value, several = _segments(data, offsets, length)
                raw = memoryview(np.ascontiguousarray(data))
                digest = b"".join([hashlib.blake2b(raw[s:e], digest_size=16).digest()
                                   for s, e in zip(start.tolist(), (start + windows + length - 1).tolist())])
                d = np.frombuffer(digest, np.int64)
                cols = [rows[text], start - offsets[text] + before, windows, value.view(np.int64), d[::2], d[1::2], several]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
    names = ["row_id", "start", "windows", "gram", "d1", "d2", "several"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    return docs.select("row_id", "text").mapInArrow(kernel, "row_id long, start long, windows int, gram long, d1 long, d2 long, several boolean")


# ---- suffixes of one block -------------------------------------------------------------

def _refine(order: np.ndarray, new: np.ndarray, key_of) -> np.ndarray:
    """Sort each group of equals (``new`` marks the first of a group) by ``key_of(items)``,
    in place; the places that were still in groups."""
    tied = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
    if not len(tied):
        return tied
    items, head = order[tied], np.flatnonzero(new[tied])
    key = key_of(items)
    group = np.cumsum(new[tied]) - 1
    apart = np.logical_or.reduceat(key != key[head][group], head)[group]  # groups that this key splits
    if apart.any():
        place, items, key, group = tied[apart], items[apart], key[apart], group[apart]
        by = np.lexsort((key, group))
        items, key = items[by], key[by]
        order[place] = items
        new[place] = np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
    return tied


def _by_prefix(word: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of positions by their first _V bytes, and where a new prefix begins."""
    key = word[position].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    for at in range(8, _V, 8):
        if not len(_refine(order, new, lambda items: word[position[items] + at].astype(np.uint64))):
            break
    return order, new


def cover_ranks(word: np.ndarray, n: int) -> np.ndarray:
    """Rank of every suffix of the block that starts at a position of the cover."""
    position = np.flatnonzero(_COVER[np.arange(n) % _V])
    order, new = _by_prefix(word, position)
    rank = np.concatenate([np.zeros(n, np.int64), -1 - np.arange(_PAD)])  # of two ends the shorter is less
    places = np.arange(len(order))
    rank[position[order]] = np.maximum.accumulate(np.where(new, places, 0))
    reach = _V
    while reach < n:  # position + reach is of the cover too
        tied = _refine(order, new, lambda items: np.where(position[items] + reach < n, rank[np.minimum(position[items] + reach, n)], n - 1 - position[items] - reach))
        if not len(tied):
            break
        rank[position[order[tied]]] = np.maximum.accumulate(np.where(new, places, 0))[tied]
        reach *= 2
    return rank


def _merge_ties(position: np.ndarray, order: np.ndarray, new: np.ndarray, rank: np.ndarray) -> None:
    """Sort the groups of equal prefixes by ranks of the cover sample, in place: merge sort
    whose runs all merge at once, each item finding its place in its mate by bisection."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    heads = np.flatnonzero(new)
    size = np.diff(np.append(heads, len(new)))
    size = np.repeat(size, size)
    run = 1
    while run < size.max(initial=0):
        at = np.flatnonzero(size > run)
        x, start = position[order[at]], first[at]
        end, offset = start + size[at], at - first[at]
        mine = offset // run
        low0 = np.minimum(start + (mine ^ 1) * run, end)
        low, high = low0.copy(), np.minimum(low0 + run, end)
        right = (mine & 1).astype(bool)
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) >> 1
            y = position[order[mid]]
            d = _SHIFT[y % _V, x[live] % _V]
            ry, rx = rank[y + d], rank[x[live] + d]
            after = (ry < rx) | (right[live] & (ry == rx))
            low[live[after]] = mid[after] + 1
            high[live[~after]] = mid[~after]
            live = live[low[live] < high[live]]
        items = order[at]
        order[start + (mine & ~1) * run + offset % run + low - low0] = items
        run *= 2


def repeated(data: np.ndarray, position: np.ndarray, length: int) -> np.ndarray:
    """Which of the suffixes at ``position`` share ``length`` bytes with another one."""
    n = len(data)
    word = _at_every_byte(np.concatenate([data, np.zeros(_PAD, np.uint8)]), ">")
    order, new = _by_prefix(word, position)
    out = np.zeros(len(position), bool)
    if new.all():
        return out
    _merge_ties(position, order, new, cover_ranks(word, n))
    pair = np.flatnonzero(~new[1:])  # neighbours that agree in _V bytes
    a, b = position[order[pair]], position[order[pair + 1]]
    for at in [*range(_V, length - 8, 8), length - 8]:
        same = word[a + at] == word[b + at]
        pair, a, b = pair[same], a[same], b[same]
    out[order[pair]] = out[order[pair + 1]] = True
    return out


def _runs(flag: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and size of the runs of marked windows of one owner."""
    linked = flag[1:] & flag[:-1] & (owner[1:] == owner[:-1])
    first = np.flatnonzero(flag & np.concatenate([[True], ~linked]))
    last = np.flatnonzero(flag & np.concatenate([~linked, [True]]))
    return first, last - first + 1


_SPANS = "row_id long, start long, windows long"


def _span_batch(row: np.ndarray, start: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (row, start, windows)], ["row_id", "start", "windows"])


def _block_spans(table: pa.Table, length: int) -> pa.RecordBatch:
    """Spans of the repeated windows of one block's single segments."""
    rows, starts = table.column("row_id").to_numpy(), table.column("start").to_numpy()
    windows, single = table.column("windows").to_numpy().astype(np.int64), table.column("single").to_numpy()
    data = np.frombuffer(b"".join(table.column("piece").to_pylist()), np.uint8)
    size = windows + length - 1
    owner = np.repeat(np.arange(len(rows)), windows)
    inner = np.arange(len(owner)) - np.repeat(windows.cumsum() - windows, windows)
    flag = repeated(data, (size.cumsum() - size)[owner] + inner, length) & single[owner]
    first, count = _runs(flag, owner)
    return _span_batch(rows[owner[first]], starts[owner[first]] + inner[first], count)


def sorted_spans(pieces: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """Spans (row_id, start, windows) of repeated windows, from ``pieces`` (gram, row_id,
    start, windows, single, piece): one block of buckets after the other is sorted."""
    def kernel(batches):
        held, size = [], 0
        for b in batches:
            gram = b.column(0).to_numpy()
            ends = np.cumsum(b.column(3).to_numpy().astype(np.int64) + length - 1)
            at = 0
            for cut in [*(np.flatnonzero(gram[1:] != gram[:-1]) + 1).tolist(), len(b)]:
                if held and at == 0 and gram[0] != held[-1].column(0)[-1].as_py() and size >= block_bytes:
                    yield _block_spans(pa.Table.from_batches(held), length)
                    held, size = [], 0
                part = int(ends[cut - 1] - (ends[at - 1] if at else 0))
                if cut < len(b) and size + part >= block_bytes:  # the bucket ends here
                    held.append(b.slice(at, cut - at))
                    yield _block_spans(pa.Table.from_batches(held), length)
                    held, size, at = [], 0, cut
            if at < len(b):
                held.append(b.slice(at))
                size += int(ends[-1] - (ends[at - 1] if at else 0))
        if held:
            yield _block_spans(pa.Table.from_batches(held), length)
    p = pieces.select("gram", "row_id", "start", "windows", "single", "piece").repartition("gram").sortWithinPartitions("gram", "row_id", "start")
    return p.mapInArrow(kernel, _SPANS)


# ---- hot buckets -----------------------------------------------------------------------

_MARK = np.dtype([("d1", "<u8"), ("d2", "<u8"), ("row", "<i8"), ("start", "<i8"), ("single", "?")])


def dealt_spans(pieces: DataFrame, length: int, parts: int) -> DataFrame:
    """The same spans for hot buckets: windows are dealt by their own digest."""
    def deal(batches):
        for b in (s for whole in batches for s in (whole.slice(i, 2000) for i in range(0, len(whole), 2000))):
            rows, starts, windows, single = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4))
            marks = np.empty(int(windows.sum()), _MARK)
            digest = b"".join([hashlib.blake2b(piece[i:i + length], digest_size=16).digest()
                               for piece, n in zip(map(memoryview, b.column(5).to_pylist()), windows.tolist()) for i in range(n)])
            marks["d1"], marks["d2"] = np.frombuffer(digest, np.uint64).reshape(-1, 2).T
            owner = np.repeat(np.arange(len(b)), windows)
            marks["row"], marks["single"] = rows[owner], single[owner]
            marks["start"] = starts[owner] + np.arange(len(owner)) - np.repeat(windows.astype(np.int64).cumsum() - windows, windows)
            part = (marks["d1"] % np.uint64(parts)).astype(np.int64)
            marks, ends = marks[np.argsort(part, kind="stable")], np.searchsorted(np.sort(part), np.arange(parts + 1))
            some = np.flatnonzero(np.diff(ends))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([marks[ends[i]:ends[i + 1]].tobytes() for i in some], pa.binary())], ["part", "marks"])

    def count(raw: bytes) -> pa.RecordBatch:
        marks = np.frombuffer(raw, _MARK)
        order = np.lexsort((marks["d2"], marks["d1"]))
        marks = marks[order]
        new = np.concatenate([[True], (marks["d1"][1:] != marks["d1"][:-1]) | (marks["d2"][1:] != marks["d2"][:-1])])
        head = np.flatnonzero(new)
        weight = np.add.reduceat(np.where(marks["single"], 1, 2), head)[np.cumsum(new) - 1]
        marks = marks[(weight > 1) & marks["single"]]
        marks = marks[np.lexsort((marks["start"], marks["row"]))]
        near = np.concatenate([[False], (marks["row"][1:] == marks["row"][:-1]) & (marks["start"][1:] == marks["start"][:-1] + 1)]) if len(marks) else np.empty(0, bool)
        first = np.flatnonzero(~near)
        return _span_batch(marks["row"][first], marks["start"][first], np.diff(np.append(first, len(marks))))

    def gather(batches):
        part, held = None, []
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if p != part and held:
                    yield count(b"".join(held))
                    held = []
                part = p
                held.append(raw)
        if held:
            yield count(b"".join(held))

    dealt = pieces.select("gram", "row_id", "start", "windows", "single", "piece").mapInArrow(deal, "part long, marks binary")
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(gather, _SPANS)


# ---- the whole table -------------------------------------------------------------------

def repeated_windows(docs: DataFrame, length: int = LENGTH, block_bytes: int = 4 << 20) -> DataFrame:
    """Spans (row_id, start, windows) of ``docs`` (row_id, text): ``windows`` consecutive
    strings of ``length`` bytes from byte ``start`` on occur elsewhere too."""
    cut = written(segments(docs, length), "segments", "zstd")
    grams = cut.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("d1").alias("low"), F.max("d1").alias("high"), F.max("several").alias("several"))
    grams = written(grams.where("n > 1 or several").select("gram", F.expr("low < high or several").alias("mixed")), "grams")
    live = written(cut.join(grams, "gram"), "live", "zstd")
    discard(cut, grams)
    texts = live.groupBy("gram", "d1", "d2").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row_id", "start", "windows")).alias("at"), F.first("mixed").alias("mixed"))
    texts = written(texts, "texts", "zstd")
    copied = texts.where("copies > 1").select("gram", "d1", "d2")
    settled = live.join(copied, ["gram", "d1", "d2"], "left_semi").select("row_id", "start", F.col("windows").cast("long").alias("windows"))
    # buckets with a text that occurs once and may share windows with the others
    bytes_ = F.sum(F.col("at.windows") + (length - 1)).alias("bytes")
    unsettled = texts.where("mixed").groupBy("gram").agg(F.min("copies").alias("least"), bytes_, F.sum(F.col("at.windows").cast("long")).alias("all_windows")).where("least = 1")
    unsettled = written(unsettled.select("gram", "all_windows", (F.col("bytes") > block_bytes).alias("hot")), "unsettled")
    wanted = texts.join(unsettled, "gram").select("gram", "hot", (F.col("copies") == 1).alias("single"), "at.*")
    size = F.col("windows") + (length - 1)
    piece = F.expr("cast(text as binary)").substr(F.col("start").cast("int") + 1, size.cast("int"))
    pieces = written(docs.join(wanted, "row_id").select("gram", "hot", "row_id", "start", "windows", "single", piece.alias("piece")), "pieces", "zstd")
    found = sorted_spans(pieces.where("not hot"), length, block_bytes)
    hot = unsettled.where("hot").agg(F.sum("all_windows")).first()[0]
    if hot:
        found = found.unionByName(dealt_spans(pieces.where("hot"), length, -(-hot // (1 << 18))))
    return settled.unionByName(found)


def removed_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """(row_id, doc_id, text, spans) per row of ``docs``; spans: array of struct(start,
    windows), any order, null if nothing repeats."""
    rows = written(slim(docs, id_col, text_col).withColumn("row_id", F.monotonically_increasing_id()), "rows", "zstd")
    spans = written_alone(lambda: repeated_windows(rows, length, block_bytes), "spans")
    spans = spans.groupBy("row_id").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    return rows.join(spans, "row_id", "left")


def kept_bytes(docs: DataFrame, length: int = LENGTH, **cols) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (bytes), kept_sha256."""
    def kernel(batches):
        for b in (part for whole in batches for part in slices(whole, 1, _STEP)):
            data, offsets = raw_text(b.column(1))
            spans, out = b.column(2), []
            at, flat = spans.offsets.to_numpy() - spans.offsets[0].as_py(), spans.flatten()
            start, windows = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i in range(len(b)):
                text = data[offsets[i]:offsets[i + 1]]
                if at[i] == at[i + 1]:
                    kept, n, removed = text.tobytes(), 0, 0
                else:
                    edge = np.zeros(len(text) + 1, np.int32)
                    s = start[at[i]:at[i + 1]]
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + windows[at[i]:at[i + 1]] + length - 1, -1)
                    gone = edge.cumsum()[:-1] > 0
                    n = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    removed, kept = int(gone.sum()), text[~gone].tobytes()
                out.append((len(text), removed, n, kept, hashlib.sha256(kept).hexdigest()))
            cols = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])
    marked = removed_spans(docs, length, **cols)
    none = F.array().cast("array<struct<start:bigint,windows:bigint>>")
    marked = marked.select("doc_id", "text", F.coalesce("spans", none).alias("spans"))
    kind = marked.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(kernel, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def repeats_digest(docs: DataFrame, length: int = LENGTH, **cols) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return kept_bytes(docs, length, **cols).drop("kept")
