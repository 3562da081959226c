"""Line dedup with a segment-partition edit join.

Two lines are near duplicates if, after white space is trimmed and collapsed, they are within
``edits`` edits (insert, delete, substitute a code point) and the edits are at most a fifth of
the longer line's code points (a similarity of 0.8 or more). So two edits link lines from 10
code points on, one edit from 5 on, and shorter lines link to equal ones; every line takes
part. With t the edits that a length allows, a line is split into
``t + 1`` segments of even length; a line within ``t`` edits of it must hold one of
the segments unchanged. Every line goes into an index by (length, segment number, segment
hash) and probes the indexes of its own and the shorter lengths with the substrings at the
multi-match-aware start positions. Candidates are verified with a banded bit-parallel edit
distance. Classes are the connected components of the links; of a class the line that
comes first by (doc_id, line number) stays.

Blank lines are left alone.

Scale: equal lines are one before the join (two 64-bit hashes; a task emits the keys of a
line it has just seen once). Texts are fetched for lines with a candidate only. A bucket
(the lines that share a key) makes no rows per pair: it is verified in one call that skips
pairs already connected and returns a spanning forest. A bucket over ``cap`` lines is dealt
into blocks, and every two blocks are verified together, so no call holds more than two
blocks and no link is lost.

Defined cases: a null text has no lines; rows that repeat a doc_id repeat its lines, and
all of them are returned with the same decision; a null doc_id comes last; an empty table
gives no rows; other columns are not looked at.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .components import components
from .frames import numbered, slim
from .winnowing import mixed

EDITS, SHARE = 2, 5
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(base))]).astype(np.uint64))


def allowed(longer: int, edits: int) -> int:
    """Edits that link two lines, the longer of so many code points."""
    return min(edits, longer // SHARE)


def linked(a: str, b: str, edits: int = EDITS) -> bool:
    """Whether two different lines are near duplicates."""
    return within(a, b, t) if (t := allowed(max(len(a), len(b)), edits)) else False


class Substrings:
    """Hashes of any substrings of a batch of lines, by running sums of c * P^place."""

    def __init__(self, lines: list[str]):
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.length = np.array([len(x) for x in lines], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * _powers(_P, len(codes))[:len(codes)])])
        self.back = _powers(_INVERSE, len(codes))

    def __call__(self, line: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = self.first[line] + start
        return (self.sum[at + size] - self.sum[at]) * self.back[at]


def segment(length: np.ndarray, number: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment ``number`` (from 0) of an even split; the last segments
    take the remainder."""
    base, longer = length // parts, length % parts
    extra = np.maximum(0, number - (parts - longer))
    return number * base + extra, base + (number >= parts - longer)


def line_keys(lines: list[str], edits: int = EDITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, role, key) rows: role 0 are index entries, role 1 probes that differ from
    the line's own entries."""
    sub, parts = Substrings(lines), edits + 1
    every = np.arange(len(lines))
    out = []
    for shorter in range(parts):
        length = sub.length - shorter
        for i in range(parts):
            start, size = segment(length, i, parts)
            low = np.maximum(start - i, start + shorter - (edits - i))
            high = np.minimum(start + i, start + shorter + (edits - i))
            low, high = np.maximum(low, 0), np.minimum(high, sub.length - size)
            for shift in range(2 * edits + 1):
                at = low + shift
                ok = np.flatnonzero((at <= high) & (length >= parts))
                own = (at[ok] == start[ok]) if shorter == 0 else np.zeros(len(ok), bool)
                key = mixed(sub(ok, at[ok], size[ok]) + (length[ok] * parts + i).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                out.append((every[ok], (~own).astype(np.int8), key))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def within(a: str, b: str, edits: int = EDITS) -> bool:
    """Whether two lines are within ``edits`` edits: after the common ends are cut, a
    bit-parallel edit distance over the band of 2 * edits + 1 diagonals."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    n = len(a)
    start = next((i for i in range(n) if a[i] != b[i]), n)
    a, b = a[start:], b[start:]
    end = next((i for i in range(len(a)) if a[-1 - i] != b[-1 - i]), len(a))
    a, b = a[:len(a) - end], b[:len(b) - end]
    if not a:
        return len(b) <= edits
    # bit t of a column's words is row (column - edits + t); the band's last bit follows
    # the lowest diagonal until it meets the last row, and then walks back along that row
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    width = 2 * edits + 1
    full, last = (1 << width) - 1, 1 << (width - 1)
    score = min(edits, len(a))
    up, down, row = ((1 << (edits + 1)) - 1) << edits, 0, 1 << (score - 1 + edits)
    for j, c in enumerate(b):
        shift = j - edits
        match = places.get(c, 0)
        match = (match >> shift if shift >= 0 else match << -shift) & full
        same = ((((match & up) + up) ^ up) | match | down) & full
        right, left = (down | ~(same | up)) & full, same & up
        if j < len(a) - edits:
            score += not same & last
            if score > 2 * edits + len(b) - len(a):  # the last row cannot bring it back
                return False
        else:
            score += bool(right & row) - bool(left & row)
            row >>= 1
        up, down = (left | ~((same >> 1) | right)) & full, (same >> 1) & right
    return score <= edits


def split_lines(text: str) -> list[str]:
    """Lines with white space trimmed and collapsed; blank ones stay as empty strings."""
    return [" ".join(line.split()) for line in text.split("\n")]


def _hashes(line: str) -> tuple[int, int]:
    from xxhash import xxh3_128_intdigest
    h = xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
    return (h & (1 << 64) - 1) - (1 << 63), (h >> 64) - (1 << 63)


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line, h, g, n_chars) per line that is not blank."""
    def kernel(batches):
        for b in batches:
            rows = []
            for i, text in enumerate(b.column(1).to_pylist()):
                rows += [(i, k, *_hashes(x), len(x)) for k, x in enumerate(split_lines(text)) if x]
            i, k, h, g, n = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i, pa.int64())), pa.array(k, pa.int32()), *[pa.array(x, pa.int64()) for x in (h, g, n)]],
                                             ["doc_id", "line", "h", "g", "n_chars"])
    return docs.mapInArrow(kernel, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, line int, h long, g long, n_chars long")


def all_keys(lines: list[str], edits: int = EDITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``line_keys`` for every number of edits, over the lines whose partners allow it: for t
    edits the longer line of a pair has SHARE * t to SHARE * (t + 1) - 1 code points (no upper
    bound for the last), the shorter at most t less."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int8), np.empty(0, np.uint64))]
    for t in range(1, edits + 1):
        top = SHARE * (t + 1) - 1 if t < edits else 1 << 62
        some = [i for i, x in enumerate(lines) if SHARE * t - t <= len(x) <= top]
        if some:
            line, role, key = line_keys([lines[i] for i in some], t)
            out.append((np.array(some)[line], role, key))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def keys_of(docs: DataFrame, edits: int) -> DataFrame:
    """(key, role, h) of every line that may have a near duplicate."""
    def kernel(batches):
        seen: set[int] = set()  # of late, so that a line on every page is keyed a few times
        for b in batches:
            lines, ids = [], []
            for text in b.column(0).to_pylist():
                for x in split_lines(text):
                    if len(x) >= SHARE - 1 and (h := _hashes(x)[0]) not in seen:
                        seen.add(h)
                        lines.append(x)
                        ids.append(h)
            if len(seen) > 200_000:
                seen.clear()
            at = 0
            while at < len(lines):  # about a million characters at a time
                end, size = at, 0
                while end < len(lines) and size < 1 << 20:
                    size += len(lines[end])
                    end += 1
                line, role, key = all_keys(lines[at:end], edits)
                h = np.array(ids[at:end], np.int64)[line]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(role), pa.array(h)], ["key", "role", "h"])
                at = end
    return docs.select("text").mapInArrow(kernel, "key long, role byte, h long")


_BITS = 24


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, text) of the lines whose hash is in ``wanted``; a bitmap of fixed size keeps
    most others from leaving their task."""
    place = F.shiftrightunsigned("h", 64 - _BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - _BITS}) % 64 as int))")
    rows = wanted.select((place / 64).cast("int").alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()
    bitmap = np.zeros(1 << (_BITS - 6), np.uint64)
    for r in rows:  # at most 2^18 words
        bitmap[r["at"]] = np.int64(r["bits"]).view(np.uint64)

    def kernel(batches):
        for b in batches:
            lines = [x for text in b.column(0).to_pylist() for x in split_lines(text) if x]
            h = np.array([_hashes(x)[0] for x in lines], np.int64)
            p = h.view(np.uint64) >> np.uint64(64 - _BITS)
            ok = np.flatnonzero((bitmap[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1))
            got = {h[i]: lines[i] for i in ok}
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.string())], ["h", "text"])
    found = docs.select("text").mapInArrow(kernel, "h long, text string").join(wanted, "h", "left_semi")
    return found.groupBy("h").agg(F.first("text").alias("text"))


def _forest(members: list[dict], edits: int) -> list[tuple[int, int]]:
    """Links that span a bucket's components; a pair needs an index entry on one side."""
    root = list(range(len(members)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    out = []
    members.sort(key=lambda m: (m["role"], m["h"]))
    for i, a in enumerate(members):
        if a["role"]:
            break
        for j in range(i + 1, len(members)):
            b = members[j]
            if a["h"] != b["h"] and find(i) != find(j) and linked(a["text"], b["text"], edits):
                root[find(j)] = find(i)
                out.append((a["h"], b["h"]))
    return out


def line_links(docs: DataFrame, edits: int = EDITS, cap: int = 256) -> DataFrame:
    """(a, b): links between line hashes that span the components of all links."""
    def kernel(batches):
        for b in batches:
            links = [x for m in b.column(0).to_pylist() for x in _forest(m, edits)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])
    same = Window.partitionBy("key")
    keys = keys_of(docs, edits).repartition("key").groupBy("key", "h").agg(F.min("role").alias("role"))
    keys = keys.withColumn("n", F.count(F.lit(1)).over(same)).withColumn("entry", F.min("role").over(same))
    shared = written(keys.where("n > 1 and entry = 0").select("key", "h", "role", "n"), "buckets")
    texts = written(_texts(docs, shared.select("h").distinct()), "texts")
    blocks = F.ceil(F.col("n") / cap).cast("int")
    mine = F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")
    dealt = shared.withColumn("blocks", blocks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "h", "role", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))
    together = dealt.join(texts, "h").groupBy("key", "p", "q").agg(F.collect_list(F.struct("h", "role", "text")).alias("members"))
    return together.select("members").mapInArrow(kernel, "a long, b long").distinct()


def _classed(d: DataFrame, edits: int, order: DataFrame | None = None) -> DataFrame:
    """(doc_id, line, best, size) per line of ``d`` (doc_id, text); best: the place of the
    line that stays. ``order``: (doc_id, own_id), if lines are ordered by another id."""
    lines = lines_of(d) if order is None else lines_of(d).join(order, "doc_id")
    own = F.col("doc_id") if order is None else F.col("own_id")
    place = F.struct(own.isNull().alias("none"), own.alias("own"), "line", "doc_id")
    lines = written(lines, "lines")
    firsts = written(lines.groupBy("h", "g").agg(F.min(place).alias("place")), "firsts")
    roots = written(components(line_links(d, edits)), "roots")
    firsts = written(firsts.join(roots, firsts["h"] == roots["node"], "left").select("h", "g", "place", "root"), "rooted")
    together, alone = firsts.where("root is not null"), firsts.where("root is null")  # most lines are alone
    best = written(together.groupBy("root").agg(F.min("place").alias("best"), F.count(F.lit(1)).alias("size")), "best")
    of = together.join(best, "root").select("h", "g", "best", "size").union(alone.select("h", "g", "place", F.lit(1).cast("long")))
    return lines.join(written(of, "classes"), ["h", "g"]).select("doc_id", "line", "best", "size")


def line_classes(docs: DataFrame, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per line that is not blank: doc_id, line (from 0), class_doc and class_line (the
    line of its class that stays), class_size (different lines), kept."""
    return _classed(slim(docs, id_col, text_col), edits).select(
        "doc_id", "line", F.col("best.doc_id").alias("class_doc"), F.col("best.line").alias("class_line"), F.col("size").alias("class_size"),
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("line") == F.col("best.line"))).alias("kept"))


def drop_lines(docs: DataFrame, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that do not stay cut out of their texts, all columns. Every row
    has its own lines, also if rows share an id."""
    rows, row = numbered(docs)
    order = rows.select(F.col(row).alias("doc_id"), F.col(f"`{id_col}`").alias("own_id"))
    stays = (F.col("best.doc_id") == F.col("doc_id")) & (F.col("best.line") == F.col("line"))
    gone = _classed(slim(rows, row, text_col), edits, order).where(~stays).groupBy(F.col("doc_id").alias("gone_row")).agg(F.collect_set("line").alias("gone_lines"))
    both = rows.join(gone, rows[row] == gone["gone_row"], "left")
    text = rows[f"`{text_col}`"]
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(gone["gone_lines"], i)), "\n")
    return both.select(*[F.when(gone["gone_lines"].isNull(), text).otherwise(left).alias(c) if c == text_col else rows[f"`{c}`"] for c in docs.columns])
