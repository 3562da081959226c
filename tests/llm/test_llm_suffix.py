"""Suffix-array dedup against brute force, with edge rows."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffix_dedup

RNG = random.Random(5)


def prose(n):
    return " ".join("".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 9))) for _ in range(n))


PASSAGE = prose(60)


def corpus():
    """Copies, near copies, shared passages at any offset, repeats inside one text, runs of
    one byte, texts of the length itself, multi-byte characters, nulls, repeated rows."""
    rows = [(i, prose(RNG.randint(1, 200))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(6)] + [(110 + i, rows[10][1]) for i in range(12)]
    rows += [(130 + i, rows[20 + i][1].replace(" ", "  ", 1)) for i in range(10)]
    rows += [(150 + i, prose(RNG.randint(0, 30)) + " " + PASSAGE + " " + prose(RNG.randint(0, 30))) for i in range(40)]
    rows += [(200, "a" * 3000), (201, "ab" * 900), (202, "b" * 199), (203, "c" * 200), (204, "c" * 200), (205, "d" * 200), (206, "e" * 201)]
    rows += [(207, PASSAGE + PASSAGE), (208, "é" * 100 + PASSAGE[:150] + "ü" * 40), (209, PASSAGE[:150] + "ü" * 40)]
    rows += [(210, None), (211, ""), (None, rows[3][1]), (3, rows[3][1]), (212, "\0" * 300), (213, "x" + "\0" * 250)]
    rows += [(214, prose(9000)), (215, prose(40) + " " + PASSAGE[100:301])]
    return rows


ROWS = corpus()


def brute(rows, length=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p:p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in ROWS], "doc_id long, text string, row_id int, start string").repartition(3)


@pytest.mark.parametrize("block_bytes", [4 << 20, 3000])
def test_repeats_equal_brute_force(docs, block_bytes, monkeypatch):
    """A block of 3000 bytes makes many blocks and sends the passage's buckets the hot way."""
    got = sorted(map(tuple, suffix_dedup.repeats_digest(docs, block_bytes=block_bytes).collect()), key=str)
    assert got == brute(ROWS)


def test_very_long_texts_and_segments_are_cut(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_STEP", 700)
    monkeypatch.setattr(suffix_dedup, "_MOST", 50)
    rows = docs.selectExpr("monotonically_increasing_id() AS row_id", "coalesce(text, '') AS text").collect()
    spans = []
    for _, text in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        for before, data, offsets in suffix_dedup._pieces(raw, np.array([0, len(raw)]), 200):
            _, start, windows, *_ = suffix_dedup._segments(data, offsets, 200)
            spans += [(text, before + s + k) for s, w in zip(start.tolist(), windows.tolist()) for k in range(w)]
    assert Counter(spans) == Counter((t, p) for _, t in rows for p in range(len(t.encode()) - 199))  # each window once


def test_empty_table_text_ids_and_other_lengths(spark, docs):
    assert suffix_dedup.repeats_digest(docs.limit(0)).count() == 0
    named = docs.selectExpr("'d' || doc_id AS doc_id", "text")
    want = sorted((("d%s" % r[0] if r[0] is not None else None), *r[1:]) for r in brute([(i, t) for i, t in ROWS if i is not None], 100))
    assert sorted(map(tuple, suffix_dedup.repeats_digest(named.where("doc_id is not null"), 100).collect())) == want


def test_kept_bytes_and_order_of_the_cover(spark, docs):
    kept = {r["doc_id"]: r for r in suffix_dedup.kept_bytes(docs).collect()}
    assert bytes(kept[203]["kept"]) == b"" and kept[206]["n_removed"] == 201 and bytes(kept[205]["kept"]) == b"d" * 200
    data = np.frombuffer("".join(t or "" for _, t in ROWS[:40]).encode()[:6000] + b"ab" * 500 + b"\0" * 300, np.uint8)
    rank = suffix_dedup.cover_ranks(suffix_dedup._at_every_byte(np.concatenate([data, np.zeros(suffix_dedup._PAD, np.uint8)]), ">"), len(data))
    places = np.flatnonzero(suffix_dedup._COVER[np.arange(len(data)) % 64])
    raw = data.tobytes()
    assert places[np.argsort(rank[places])].tolist() == sorted(places.tolist(), key=lambda p: raw[p:])
    assert suffix_dedup._COVER[(np.arange(64)[:, None] + suffix_dedup._SHIFT) % 64].all()
