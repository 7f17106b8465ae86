import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import empty_documents, nasty_documents
from watchgrid.llm import best_position, queries

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=10):
    """Every document scored against every item, as the contract says it."""
    docs = [(d, Counter(_TERM.findall((t or "").translate(_LOWER)))) for d, t in docs]
    docs = [(d, c) for d, c in docs if c]
    n_docs, n_all = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        asked = set(_TERM.findall((text or "").translate(_LOWER)))
        found = []
        for d, c in docs:
            m = 10 + 90 * sum(c.values()) * n_docs // n_all
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in asked if c[t])
            if score > 0:
                found.append((-score, d is None, d))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(found[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_equals_scoring_everything(spark, sf):
    docs, items = (queries.table(spark, sf, t) for t in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(best_position.search(docs, items)) == want


def test_small_shards_blocks_and_ties(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["Ünder", "É", "x" * 80, "x" * 81]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(400)]
    docs += docs[:40] + [(None, "w1 w2 w3"), (None, "w1 w2 w3"), (7, None)]
    items = [(i, " ".join(rng.choices(words, k=4))) for i in range(25)] + [(3, "w1 w2"), (3, "w1 w2"), (None, "w5"), (99, None), (98, "..."), (97, "nowhere")]
    monkeypatch.setattr(best_position, "BLOCK", 60)
    monkeypatch.setattr(best_position, "SHARD", 100)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got(best_position.search(d, spark.createDataFrame(items, "item_id long, text string"))) == plain(docs, items)


@pytest.mark.parametrize("seed", range(20))
def test_stops_early_but_not_too_early(seed):
    rng = np.random.default_rng(seed)
    n_docs, n_terms = 3000, 6
    held = rng.random((n_docs, n_terms)) < 0.7
    term = np.nonzero(held)[1]
    impact = (rng.pareto(1.0, len(term)) * 20).astype(np.int64) % 5000 + 1
    offsets = np.concatenate([[0], np.cumsum(held.sum(1))])
    shard = best_position.Shard(np.arange(n_docs), np.zeros(n_docs, bool), offsets, term, impact, n_terms)
    scores = np.zeros(n_docs, np.int64)
    np.add.at(scores, np.repeat(np.arange(n_docs), held.sum(1)), impact)
    for step in (2, 32):  # nothing is left marked by the first search
        top = best_position.Top(10)
        depth = shard.search(np.arange(n_terms), top, step)
        order = np.lexsort((np.arange(n_docs), -scores))[:10]
        assert top.ids.tolist() == order.tolist() and top.scores.tolist() == scores[order].tolist()
        assert depth < n_docs / 2


def test_awkward_tables(spark):
    items = spark.createDataFrame([(1, "alpha BETA", 3), (2, "word17", 3), (3, None, 3), (4, "", 3)], "item_id long, text string, score int")
    docs = nasty_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(best_position.search(docs, items)) == plain(rows, [(r.item_id, r.text) for r in items.collect()])
    assert got(best_position.search(empty_documents(spark), items)) == []
    assert got(best_position.search(docs, items.where("1 = 0"))) == []
