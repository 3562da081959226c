"""Exact dedup, SimHash, line dedup and components against brute force, with edge rows."""
import hashlib
import random
import re
from functools import lru_cache

import pytest
import xxhash

from tessera.llm import components, exact_dedup, line_dedup, simhash
from tessera.session import shared_path

RNG = random.Random(11)
VOCAB = ["ka", "lo", "mi", "ne", "pu", "ra", "so", "ti", "vu", "za"]


def words(n):
    return " ".join("".join(RNG.choice(VOCAB) for _ in range(RNG.randint(1, 4))) for _ in range(n))


@lru_cache
def corpus():
    """Copies, near copies, white-space variants, nulls, empties, ties, a long text."""
    base = [words(60) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t.replace(" ", "  ")) for i, t in enumerate(base[:5])] + [(200 + i, t) for i, t in enumerate(base[:5])]
    rows += [(300 + i, re.sub(r"(\S+)$", "changed", t)) for i, t in enumerate(base[:8])]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "one"), (404, "One"), (405, "two words"), (406, words(30000)), (None, base[3])]
    rows += [(2, base[2]), (2, base[2])]  # rows written again
    return rows


SCHEMA = "doc_id long, text string, digest string, kept int, h string, fp int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 7, "y", 3) for i, t in corpus()], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def expected_exact():
    groups = {}
    for i, t in corpus():
        groups.setdefault(squeezed(t), []).append((-len(t or ""), i is None, i))
    return {k: (min(v)[2], len(v)) for k, v in groups.items()}


def test_exact_groups(spark, docs):
    want = expected_exact()
    got = sorted(map(tuple, exact_dedup.exact_groups(docs, buckets=4).collect()), key=str)
    exp = sorted(((i, *want[squeezed(t)], i == want[squeezed(t)][0], hashlib.sha256(squeezed(t).encode()).hexdigest()) for i, t in corpus()), key=str)
    assert got == exp


def test_exact_index_persists_and_appends(spark):
    path = shared_path(spark, "index")
    a = spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "ab"), (2, "d"), (3, "d ")], "doc_id long, text string")
    first = exact_dedup.DigestIndex(spark, path, "idx_one", 4)
    exact_dedup.exact_groups(a, first).collect()
    again = exact_dedup.DigestIndex(spark, path, "idx_two", 4)  # the same files under another name
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(b, again).collect()}
    assert got == {1: (5, 2, False), 2: (3, 2, False), 3: (3, 2, True)}
    assert spark.read.parquet(path).count() == 3
    plan = spark.table("idx_two").hint("merge").join(spark.table("idx_two").select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "Exchange" not in plan  # bucketed on both sides


def test_exact_drop_and_empty(spark, docs):
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns
    want = expected_exact()
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, _ in want.values())
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    assert exact_dedup.drop_exact(empty(spark)).count() == 0


def test_exact_groups_of_other_ids(spark):
    """Text ids sort as text; the least long is an id like any other."""
    rows = spark.createDataFrame([("b", "x y"), ("a", "xy "), (None, "x  y"), ("c", "z"), (None, None)], "doc_id string, text string")
    got = {(r["doc_id"], r["text_sha256"][:4]): (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(rows, buckets=2).collect()}
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()[:4]
    assert got[None, h("xy")] == (None, 3, True) and got["a", h("xy")] == (None, 3, False) and got["c", h("z")] == ("c", 1, True)
    low = -(1 << 63)
    rows = spark.createDataFrame([(low, "q"), (5, "q")], "doc_id long, text string")
    assert {r["keep_id"] for r in exact_dedup.exact_groups(rows, buckets=2).collect()} == {low}


def brute_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_components(rows, fps, distance=2):
    """Least doc_id of each row's component; every row is a node, with an id or without."""
    links = [(a, b) for a, x in enumerate(fps) for b, y in enumerate(fps[:a]) if bin(x ^ y).count("1") <= distance]
    roots = union(range(len(rows)), links)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[roots[n]] = min(i, least.get(roots[n], i))
    return [least.get(roots[n]) for n in range(len(rows))], roots


def test_simhash_matches_brute_force(spark, docs):
    rows = corpus()
    fps = [brute_fingerprint(t) for _, t in rows]
    least, roots = brute_components(rows, fps)
    want = sorted(((i, f"{fp:016x}", c) for (i, _), fp, c in zip(rows, fps, least)), key=str)
    assert sorted(map(tuple, simhash.near_groups(docs).collect()), key=str) == want
    kept = [r["doc_id"] for r in simhash.drop_near(docs).collect()]
    assert sorted(kept, key=str) == sorted({roots[n]: c for n, c in enumerate(least)}.values(), key=str)
    assert simhash.near_groups(empty(spark)).count() == 0


def test_simhash_rows_without_an_id_link_others(spark):
    base = words(400).split()
    first = brute_fingerprint(" ".join(base))
    chain, fp = [" ".join(base)], first
    while len(chain) < 3:  # each within two bits of the one before, the ends farther apart
        changed = " ".join(base[:RNG.randrange(300)] + [words(1)] + base[:RNG.randrange(300, 400)])
        other = brute_fingerprint(changed)
        if 0 < bin(other ^ fp).count("1") <= 2 and (len(chain) == 1 or bin(other ^ first).count("1") > 2):
            chain, fp, base = [*chain, changed], other, changed.split()
        elif RNG.random() < 0.5:
            tail = base[:-RNG.randrange(1, 4)] + [words(1)]
            other = brute_fingerprint(" ".join(tail))
            if 0 < bin(other ^ fp).count("1") <= 2 and (len(chain) == 1 or bin(other ^ first).count("1") > 2):
                chain, fp, base = [*chain, " ".join(tail)], other, tail
    rows = [(1, chain[0]), (None, chain[1]), (3, chain[2]), (7, "far"), (7, words(50))]
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i, f"{brute_fingerprint(t):016x}"] for i, t in rows] == [1, 1, 1, 7, 7]


@pytest.mark.parametrize("cap", [4096, 4])
def test_links_find_every_pair_also_in_hot_buckets(spark, cap):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:12]:  # chains and a dense ball
        for _ in range(6):
            f ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            fps.add(f)
    hot = rng.getrandbits(64)
    fps |= {hot ^ (1 << a) ^ (1 << b) for a in range(9) for b in range(9)}
    nodes = [(k, f) for k, f in enumerate(sorted(fps))]
    df = spark.createDataFrame([(simhash._signed(f), k) for k, f in nodes], "fp long, rep long")
    edges = [tuple(r) for r in simhash.links(df, 2, cap).collect()]
    assert all(bin(nodes[a][1] ^ nodes[b][1]).count("1") <= 2 or cap for a, b in edges)
    want = union(range(len(nodes)), [(a, b) for a, x in nodes for b, y in nodes[:a] if bin(x ^ y).count("1") <= 2])
    assert union(range(len(nodes)), edges) == want


def test_allocation_keeps_the_pigeonhole_sum():
    import numpy as np
    both = np.full((64, 64), 25.0) + np.diag(np.full(64, 25.0))
    for m in (2, 3, 4):
        parts = simhash.group_bits(both, 100, m)
        assert sorted(b for p in parts for b in p) == list(range(64))
        _, ts = simhash.allocate(parts, [10.0] * m, np.full(64, 0.5), 100, 2)
        assert sum(ts) == 2 - m + 1
        masks = simhash.probe_masks(parts, ts)
        rng = random.Random(m)
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            assert any(x & k == y & k for k in masks)


def test_components_chain_star_and_empty(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    df = spark.createDataFrame(edges, "x long, y long")
    got = dict(map(tuple, components.components(df).collect()))
    want = {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 200: 200, 201: 200}
    assert got == want
    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out) + 1)
        out[i:i + rng.randint(0, 1)] = [rng.choice("abé")] * rng.randint(0, 1)
    return "".join(out)


def test_banded_distance():
    rng = random.Random(2)
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        b = edited(rng, a + "x", rng.randint(0, 4))
        for k in (1, 2, 3):
            assert line_dedup.within(a, b, k) == (distance(a, b) <= k)


def test_keys_find_every_near_pair():
    rng = random.Random(8)
    for _ in range(300):
        a = "".join(rng.choice("ab ") for _ in range(rng.randint(12, 30)))
        b = edited(rng, a, 2)
        if distance(a, b) > 2 or len(b) < 3:
            continue
        line, role, key = line_dedup.line_keys([a, b])
        entry = [{int(k) for x, r, k in zip(line, role, key) if x == n and not r} for n in (0, 1)]
        every = [{int(k) for x, k in zip(line, key) if x == n} for n in (0, 1)]
        assert entry[0] & every[1] or entry[1] & every[0]


def line_corpus():
    rng = random.Random(21)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(40)).strip() + "é" for _ in range(30)]
    hot = base[0]
    docs = [(i, "\n".join([hot, base[i], edited(rng, base[(i + 3) % 30], 2), "short", " ", base[(i + 7) % 30].replace(" ", "   ")])) for i in range(30)]
    docs += [(50, None), (51, ""), (52, "\n\n"), (53, edited(rng, hot, 1)), (None, hot), (53, "again\nagain"), (54, "long " * 20000)]
    short = ["Read more >>", "Read more >", "Read more", "abc", "abd", "abcd", "abcde", "abcdf", "1", "2", "12", "10 items", "11 items", "page 10 of 99", "page 12 of 99"]
    short += ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 16))) for _ in range(150)]
    return docs + [(60 + i, x) for i, x in enumerate(short)]


@pytest.mark.parametrize("cap", [256, 3])
def test_line_classes_match_brute_force(spark, cap, monkeypatch):
    rows = line_corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, line int").repartition(4)
    if cap != 256:
        plain = line_dedup.line_links
        monkeypatch.setattr(line_dedup, "line_links", lambda d, e: plain(d, e, cap))
    got = sorted((tuple(r) for r in line_dedup.line_classes(df).collect()), key=str)
    first, every = {}, []
    for i, t in rows:
        for k, x in enumerate(line_dedup.split_lines(t or "")):
            if x:
                every.append((i, k, x))
                place = (i is None, i if i is not None else -1, k)
                first[x] = min(first.get(x, place), place)
    some = [x for x in first if len(x) < 1000]
    near = lambda a, b: distance(a, b) <= min(2, max(len(a), len(b)) // 5)
    links = [(a, b) for n, a in enumerate(some) for b in some[:n] if abs(len(a) - len(b)) <= 2 and near(a, b)]
    root = union(list(first), links)
    best, size = {}, {}
    for x, r in root.items():
        best[r] = min(best.get(r, first[x]), first[x])
        size[r] = size.get(r, 0) + 1
    want = []
    for i, k, x in every:
        none, doc, line = best[root[x]]
        doc = None if none else doc
        want.append((i, k, doc, line, size[root[x]], (i, k) == (doc, line)))
    assert got == sorted(want, key=str)


def test_drop_lines_and_empty(spark):
    df = spark.createDataFrame([(1, "the very same long line here\nonly in one of the documents", 5), (2, "x\nthe very same long lime here", 6), (3, None, 7)],
                               "doc_id long, text string, gone_lines int")
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(df).collect()}
    assert got == {1: "the very same long line here\nonly in one of the documents", 2: "x", 3: None}
    twins = spark.createDataFrame([(5, "first row's own line\nshared by both rows"), (5, "shared by both rows\nthe other row's line"), (None, "shared by both rows")], "doc_id long, text string")
    assert sorted(r["text"] for r in line_dedup.drop_lines(twins).collect()) in (
        ["", "first row's own line", "shared by both rows\nthe other row's line"], ["", "first row's own line\nshared by both rows", "the other row's line"])
    none = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.line_classes(none).count() == 0
    assert len({r["class_line"] for r in line_dedup.line_classes(spark.createDataFrame([(1, "Read more >>\nRead more >\nRead more")], "doc_id long, text string")).collect()}) == 1
