import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import empty_documents, nasty_documents
from watchgrid.llm import queries, suffix_dedup
from watchgrid.llm.suffix_dedup import Repeats


def plain(texts, window):
    """(kept, n_bytes, n_removed, n_spans) of every text, all windows counted."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - window + 1):
            if seen[t[i:i + window]] > 1:
                gone[i:i + window] = True
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
        out.append((bytes(b for b, g in zip(t, gone) if not g), len(t), int(gone.sum()), spans))
    return out


def check(spark, rows, work):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.dedup_substrings(df, work=work).collect()
    want = [(d, *w) for (d, _), w in zip(rows, plain([t for _, t in rows], work.window))]
    assert Counter((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in got) == Counter(want)
    for r in got:
        spans = [tuple(map(int, s.split(":"))) for s in r.removed.split(",") if s]
        assert sum(b - a for a, b in spans) == r.n_removed and len(spans) == r.n_spans
    return sum(w[3] for w in want)


def test_equals_all_windows(spark, sf):
    docs = queries.table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert check(spark, rows, Repeats()) > 20


def mixed(seed):
    """Copies, passages in many contexts, repeats within one text, periodic texts."""
    rng = random.Random(seed)

    def words(n):
        return " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(n))

    passages = [words(rng.randint(5, 40)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice([words(8), words(3), rng.choice(passages), rng.choice(passages)]) for _ in range(rng.randint(0, 5))]
        rows.append((i, " ".join(parts)))
    for i, t in rows[:25]:
        at = rng.randrange(len(t) + 1)
        rows.append((100 + i, t[:at] + rng.choice(["", "x", "long insertion "]) + t[at + rng.choice([0, 1]):]))
    rows += [(300, "ab" * 100), (301, "a" * 90), (302, "ab" * 60 + "c"), (5, rows[5][1]), (None, rows[6][1]), (None, rows[7][1]), (None, None)]
    return rows


@pytest.mark.parametrize("work", [Repeats(30, 10), Repeats(30, 10, piece=64), Repeats(30, 10, sort=3), Repeats(21, 20, piece=40, sort=1), Repeats(40, 4)],
                         ids=["sorted", "pieces", "full", "tiny", "short-gram"])
def test_every_path(spark, work):
    assert check(spark, mixed(work.window + work.sort), work) > 30


def test_sorted_suffixes_and_a_hash_that_collides(monkeypatch):
    rng = random.Random(4)
    for collide in (False, True):
        if collide:  # equal hashes for all parts of one size
            monkeypatch.setattr(suffix_dedup.Prefixes, "part", lambda self, start, size: np.asarray(size) * 1)
        for _ in range(30):
            data = bytes(rng.choices(b"ab", k=400))
            n = rng.randint(2, 60)
            start = np.array([rng.randrange(300) for _ in range(n)])
            size = np.array([rng.randint(0, 100) for _ in range(n)])
            cut = sorted({0, *(rng.randrange(n) for _ in range(4))})
            count = np.diff([*cut, n])
            first, many = np.repeat(cut, count), np.repeat(count, count)
            order, shared = suffix_dedup.sorted_suffixes(np.frombuffer(data, np.uint8), start, size, first, many)
            text = [data[s:s + k] for s, k in zip(start, size)]
            assert [(first[i], text[i]) for i in order] == sorted((first[i], text[i]) for i in range(n))
            for a, b, k in zip(order, order[1:], shared[1:]):
                same = next((j for j, (x, y) in enumerate(zip(text[a], text[b])) if x != y), min(len(text[a]), len(text[b])))
                assert k == (same if first[a] == first[b] else -1)


def test_awkward_tables(spark):
    rows = [(r.doc_id, r.text) for r in nasty_documents(spark).collect()]
    check(spark, rows, Repeats())
    check(spark, rows, Repeats(20, 7))
    assert suffix_dedup.dedup_substrings(empty_documents(spark)).collect() == []
    got = suffix_dedup.dedup_substrings(nasty_documents(spark).withColumnsRenamed({"score": "gram", "rank": "__id", "source": "mark"})).count()
    assert got == len(rows)


def test_very_long_text(spark):
    rng = random.Random(8)
    text = "".join(rng.choices("abcdefgh ", k=2_300_000))
    rows = [(1, text), (2, text[1_048_000:1_049_500]), (3, "z" * 10 + text[-300:])]
    got = {r.doc_id: (r.n_removed, r.n_spans, r.removed) for r in suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1800, 2, "1048000:1049500,2299700:2300000"), 2: (1500, 1, "0:1500"), 3: (300, 1, "10:310")}
