"""Ranked lexical search against brute force, with edge rows."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import lexical

RNG = random.Random(3)
VOCAB = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "été", "x9"] + [f"w{i}" for i in range(60)]
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def sentence(n):
    return " ".join(RNG.choice(VOCAB[:RNG.choice([5, 20, 70])]) for _ in range(n))


DOCS = [(i, sentence(RNG.randint(1, 80))) for i in range(300)]
DOCS += [(400 + i, DOCS[3][1]) for i in range(40)]  # ties beyond k
DOCS += [(3, DOCS[3][1]), (None, DOCS[3][1]), (500, None), (501, ""), (502, " ,;. "), (503, "Alpha-BETA alpha"), (504, "alpha " * 50000)]
ITEMS = [(i, sentence(RNG.randint(1, 12))) for i in range(25)] + [(7, DOCS[3][1]), (None, "alpha w1"), (90, None), (91, ""), (92, "unknown"), (93, "ÉTÉ été alpha alpha")]


def brute(docs, items, k):
    bags = [(i, r, Counter(terms(t)), len(terms(t))) for r, (i, t) in enumerate(docs)]
    bags = [b for b in bags if b[3]]
    n_docs, n_terms = len(bags), sum(b[3] for b in bags)
    df = Counter(t for *_, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scored = []
        for i, r, bag, n in bags:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms(text) if t in bag)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in DOCS], "doc_id long, text string, score int, terms string").repartition(3)
    return docs, spark.createDataFrame([(i, t, 5) for i, t in ITEMS], "item_id long, text string, rank int")


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 300, "block_postings": 150}])
def test_search_equals_brute_force(tables, sizes):
    got = sorted(map(tuple, lexical.search(*tables, k=20, **sizes).collect()), key=str)
    assert got == brute(DOCS, ITEMS, 20)


def test_search_of_empty_tables_and_text_ids(spark, tables):
    docs, items = tables
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    named = docs.selectExpr("'d' || doc_id AS doc_id", "text")
    assert lexical.search(named, items, k=1).where("item_id = 0").first()["doc_id"][0] == "d"


def test_accumulators_stop_and_stay_exact(monkeypatch):
    """Once the bounds of the terms to come are lower than the k-th partial score no document
    is added, and what is left has its full score."""
    import pyarrow as pa
    docs = 2000
    lists = [[0, 1] if i < 30 else [1] for i in range(docs)]  # term 0 rare, term 1 everywhere
    batch = pa.record_batch([pa.array(range(docs), pa.int64()), pa.array([50] * docs, pa.int64()), pa.array(lists, pa.list_(pa.int32())),
                             pa.array([[1] * len(x) for x in lists], pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])
    shard = lexical.Shard(batch, np.array([9000, 10]), docs, 50 * docs)
    held, score = shard.search(np.array([0, 1]), np.array([1, 2]), 20, 0)
    assert sorted(held) == list(range(30))
    assert set(score) == {9020 * (10**9 // (1000 + 1200))}
    assert not shard.open.any() and not shard.total.any()
