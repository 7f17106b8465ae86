"""Near copies against all pairs, alignment against the full table, components against union-find."""

import random
from collections import Counter

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import empty_documents, nasty_documents
from watchgrid.llm import graph, order_minhash
from watchgrid.llm.text import WordHashes, shingles, words


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.sampled_from([0.0, 0.3, 0.6, 0.8, 1.0]))
def test_alignment_matches_full_table(a, b, threshold):
    longer = max(len(a), len(b))
    want = 1 - plain_distance(a, b) / longer if longer else 1.0
    got = order_minhash.aligned(a, b, threshold)
    assert abs(got - want) < 1e-9 if want >= threshold - 1e-12 and want > 0 else got == 0


def union(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 700)]
    got = graph.components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r["node"]: r["label"] for r in got.collect()} == {k: v for k, v in union([p for p in pairs if p[0] != p[1]]).items()}


def plain_classes(rows):
    hashes = WordHashes()
    runs = {i: shingles(hashes.of(words(t)), 5).tolist() for i, t in rows if i is not None and words(t)}
    ids = sorted(runs)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if order_minhash.aligned(runs[a], runs[b], 0.8) > 0]
    found = union(pairs)
    return {i: found.get(i, i) for i in runs}


def corpus():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, doc_id = [], 0
    shared = [rng.choice(vocabulary) for _ in range(60)]
    for group in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 60, 150, 400]))]
        if group % 4 == 0:
            base = base + shared
        for copy in range(rng.choice([1, 1, 2, 4, 12])):
            text = list(base)
            for _ in range(int(len(base) * rng.choice([0, 0.005, 0.01, 0.02])) if copy else 0):
                at = rng.randrange(len(text))
                text[at:at + 1] = rng.choice([[], ["new"], [text[at], "more"]])
            rows.append((doc_id, " ".join(text)))
            doc_id += 1
    rng.shuffle(rows)
    return rows


def test_classes_match_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.classes(df).collect()}
    assert got == plain_classes(rows)
    kept = order_minhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


def test_given_documents_match_all_pairs(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.classes(df).collect()}
    want = plain_classes([(r["doc_id"], r["text"]) for r in df.collect()])
    assert {k: got[k] for k in want} == want


def test_large_group_of_copies(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    rows = []
    for i in range(1500):
        text = list(base)
        text[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(text if i % 3 else base)))
    got = order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0}


def star(copies=300, length=204, changed=6):
    """Copies that align with the text of the largest id, hardly any two of them with each other."""
    rng = random.Random(13)
    centre = [f"w{rng.randrange(5000)}" for _ in range(length)]
    rows = []
    for i in range(copies):
        text = list(centre)
        for k in range(changed):
            text[rng.randrange(k * length // changed, (k + 1) * length // changed)] = f"x{i}-{k}"
        rows.append((i, " ".join(text)))
    return [*rows, (copies, " ".join(centre))]


def test_star_whose_centre_has_the_largest_id(spark):
    got = order_minhash.classes(spark.createDataFrame(star(), "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0}


def test_pairs_behind_an_unrelated_smaller_id(spark):
    rng = random.Random(17)
    shared = [f"s{i}" for i in range(300)]
    rows = [(0, " ".join([*shared, *(f"a{i}" for i in range(150))]))]
    for pair in range(1, 31):
        tail = [f"t{pair}-{i}" for i in range(150)]
        rows.append((pair, " ".join([*shared, *tail])))
        tail[rng.randrange(150)] = "other"
        rows.append((100 - pair, " ".join([*shared, *tail])))
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_classes(rows)
    assert len(set(got.values())) == 31


def test_cells_bound_what_is_in_common():
    rng = np.random.default_rng(3)
    for n in (1, 5, 200, 3000):
        a = rng.integers(0, 400, n).astype(np.uint64)
        b = np.where(rng.random(n) < 0.2, rng.integers(0, 400, n), a).astype(np.uint64)
        common = sum((Counter(a.tolist()) & Counter(b.tolist())).values())
        bound = order_minhash.in_common(pd.Series([order_minhash.cells(a)]), pd.Series([order_minhash.cells(b)]))[0]
        assert common <= bound <= n


def test_texts_that_align_share_a_rare_shingle():
    rng = np.random.default_rng(5)
    for n in (1, 4, 30, 200):
        for _ in range(40):
            a = rng.integers(0, 2 * n, n).astype(np.uint64)
            b = np.where(rng.random(n) < 0.15, rng.integers(0, 2 * n, n), a).astype(np.uint64)
            b = b[: n - int(rng.integers(0, n // 10 + 1))]
            frequent = np.unique(order_minhash.labelled(a))[::3]
            counts = rng.integers(2, 9, len(frequent))
            one, other = (order_minhash.rarest(x, frequent, counts, 0.8).tolist() for x in (a, b))
            assert len(one) == int(n * 0.2 + 1e-9) + 1
            if order_minhash.aligned(a.tolist(), b.tolist(), 0.8) > 0:
                assert set(one) & set(other)


def test_texts_around_a_common_passage_are_no_pairs(spark, monkeypatch):
    rng = random.Random(19)
    common = [f"c{i}" for i in range(110)]
    rows = [(i, " ".join([*common, *(f"w{rng.randrange(10_000)}" for _ in range(90))])) for i in range(300)]
    formed = []
    real = order_minhash._possible
    monkeypatch.setattr(order_minhash, "_possible", lambda pairs, *a: formed.append(pairs.count()) or real(pairs, *a))
    got = order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r["class_id"] for r in got}) == 300
    assert formed[-1] < 300  # of 44,850 pairs


def test_awkward_rows(spark):
    docs = nasty_documents(spark)
    got = sorted(((r["doc_id"], r["class_id"]) for r in order_minhash.classes(docs).collect()), key=repr)
    assert got == sorted([(1, 1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (None, None), (None, None)], key=repr)
    kept = order_minhash.keep_one(docs)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 2, 3, 4, 5, 6, None, None], key=repr)
    assert order_minhash.classes(empty_documents(spark)).count() == 0
    assert order_minhash.keep_one(empty_documents(spark)).count() == 0


def test_only_texts_that_share_a_sketch_are_read_again(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(5)]
    read = []
    real = order_minhash.verified
    monkeypatch.setattr(order_minhash, "verified", lambda pairs, texts, *a: read.append(texts.count()) or real(pairs, texts, *a))
    for sent in (order_minhash.SENT, 0):  # ids of the texts sent to every task, and dealt out
        monkeypatch.setattr(order_minhash, "SENT", sent)
        got = {r["doc_id"]: r["class_id"] for r in order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {i: i % 1000 if i >= 1000 else i for i, _ in rows}
    assert read and max(read) == 10
