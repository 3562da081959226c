"""Prefix trie of rebuilt conversations against brute force, with edge rows."""
import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import prefix_trie

RNG = random.Random(9)
TEXTS = ["hi", "ok", "", None, "no", "yes, 5", "ö" * 3]


def corpus():
    """Shared openings, identical conversations, null and tied turns, a long one, missing bases."""
    rows = []
    for c in range(60):
        if c % 5 == 0 and c % 10:
            continue  # an absent base
        for t in range(RNG.randint(1, 9)):
            rows.append((c, t, ["user", "assistant"][t % 2], RNG.choice(TEXTS[:3]) if t < 3 else RNG.choice(TEXTS)))
    rows += [(70 + i, t, "user", "same") for i in range(25) for t in range(12)]  # identical
    rows += [(200, None, "user", "b"), (200, None, "user", "a"), (200, 1, None, "x"), (200, 1, "user", "x"), (200, 1, "user", "x")]
    rows += [(205, t, "user", str(t % 3)) for t in range(150)] + [(None, 1, "user", "lost")]
    return rows


ROWS = corpus()


def brute(rows, base_of, head_of):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    built = {c: own.get(base_of(c), [])[:head_of(c)] + v[head_of(c):] for c, v in own.items()}
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out = []
    for path, cs in members.items():
        below = [p for p in members if p[:len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(path))
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), sum(len(p) == len(path) + 1 for p in below),
                    len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, parts):
    return spark.createDataFrame([(c, t, r, x, 1, "y") for c, t, r, x in ROWS], "conv_id long, turn long, role string, text string, pos int, depth string").repartition(parts)


@pytest.mark.parametrize("parts", ["3", "40"])
def test_trie_of_rebuilt_conversations(spark, parts):
    """Over 40 shuffle partitions the long conversation spans several: products are carried."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        c = F.col("conv_id")
        got = prefix_trie.prefix_trie(table(spark, 3), base_of=c - c % 5, head_of=F.crc32(c.cast("string").cast("binary")) % 9)
        assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS, lambda c: c - c % 5, lambda c: zlib.crc32(str(c).encode()) % 9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_trie_of_stored_conversations_and_empty_table(spark):
    got = sorted(map(tuple, prefix_trie.prefix_trie(table(spark, 2)).collect()), key=str)
    assert got == brute(ROWS, lambda c: c, lambda c: 0)
    assert prefix_trie.prefix_trie(table(spark, 2).limit(0)).count() == 0


def test_turnless_conversations_are_members_of_the_root(spark):
    """Heads longer than the conversations of an absent base leave nothing."""
    rows = spark.createDataFrame([(1, 0, "u", "a"), (2, 0, "u", "b"), (7, 0, "u", "c")], "conv_id long, turn long, role string, text string")
    got = prefix_trie.prefix_trie(rows, base_of=F.lit(100).cast("long"), head_of=F.lit(4)).collect()
    assert [tuple(r) for r in got] == [(1, 0, None, 3, 0, 1, 0, hashlib.sha256(b"1,2,7").hexdigest())]


def test_products_compose():
    base, turns = 7919, [RNG.randrange(prefix_trie.PRIME) for _ in range(9)]
    whole = [(0, 1)]
    for t in turns:
        whole.append(prefix_trie.product(whole[-1], (t, base)))
    suffix = prefix_trie.between(whole[9], whole[4], pow(base, 5, prefix_trie.PRIME))
    assert prefix_trie.product(whole[4], suffix) == whole[9]
    a, b, c = whole[2], whole[5], suffix
    assert prefix_trie.product(prefix_trie.product(a, b), c) == prefix_trie.product(a, prefix_trie.product(b, c))


def test_a_clash_is_seen(spark):
    """Two turns of different content under one fingerprint fail the verification."""
    rows = [(1, 1, b"p", b"q", b"x", 1), (2, 1, b"p", b"q", b"y", 1), (3, 1, b"r", b"q", b"y", 1)]
    members = spark.createDataFrame(rows, "conv_id long, depth long, print binary, above binary, digest binary, size long")
    assert {r["conv_id"]: r["clash"] for r in prefix_trie._nodes(members).collect()} == {1: True, 3: False}
