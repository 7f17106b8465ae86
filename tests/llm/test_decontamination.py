"""Benchmark passages against a search of all passages without the latent space."""

import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import empty_documents, nasty_documents
from watchgrid.llm import decontaminate
from watchgrid.llm.text import words


def plain_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=20), st.lists(st.sampled_from("abcde"), max_size=30))
def test_common_subsequence(a, b):
    assert decontaminate.common_subsequence(a, b) == plain_subsequence(a, b)


def plain_leaks(docs, benchmark):
    out = set()
    block = decontaminate.Block([(i, t) for i, t in benchmark if words(t)], frozenset())
    for doc_id, text in docs:
        found = words(text)
        for j, item in enumerate(block.words):
            reach = len(item) // 2 + 4
            for begin in range(0, max(1, len(found)), decontaminate.STRIDE):
                region = found[max(0, begin - reach):begin + decontaminate.PASSAGE + reach]
                if len(Counter(item) & Counter(region)) and decontaminate.verified(item, block.answers[j], region)[2]:
                    out.add((doc_id, block.ids[j]))
    return out


def test_given_documents_match_plain_search(spark, sf):
    docs, benchmark = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert got == plain_leaks([(r[0], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in benchmark.collect()])


def test_planted_paraphrases(spark):
    rng = random.Random(3)
    rare = [f"rare{i}" for i in range(3000)]
    often = ["the", "of", "and", "to", "in", "is"]

    def prose(n):
        return [rng.choice(often) if rng.random() < 0.4 else rng.choice(rare) for _ in range(n)]

    benchmark = [(i, " ".join(prose(rng.randint(15, 60))) + " . " + " ".join(prose(4)) + ".") for i in range(300)]
    docs, want = [], set()
    for i in range(400):
        text = prose(rng.randint(20, 600))
        if i % 4 == 0:
            item = words(benchmark[i % 300][1])
            changed = [w for w in item if rng.random() > 0.1] if i % 8 else item
            if i % 8 and not all(w in changed for w in item[-4:]):
                changed = item
            at = rng.randrange(len(text))
            text[at:at] = changed
            want.add((i, i % 300))
        docs.append((i, " ".join(text)))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(benchmark, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


def test_blocks_are_bounded_within_a_text(spark):
    long = " ".join(f"w{i}" for i in range(decontaminate.PASSAGE * (2 * decontaminate.BLOCK + 9)))
    benchmark = spark.createDataFrame([(1, long), (2, "a short text")], "item_id long, text string")
    blocks = list(decontaminate.passages_of(benchmark, "text", "item_id"))
    assert max(map(len, blocks)) <= decontaminate.BLOCK
    assert sorted(x for block in blocks for k, t in block if k == 1 for x in t.split()) == sorted(long.split())


def test_awkward_rows(spark):
    docs = nasty_documents(spark)
    benchmark = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta", "q"), (2, None, None), (None, "", None),
                                       (3, "word7 word8 word9 word10 word11 word12 word13", "q"), (3, "??? !!!", "q")],
                                      "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert got == {(1, 1), (4, 3)}
    clean = decontaminate.keep_clean(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted((r["doc_id"] for r in clean.collect()), key=repr) == sorted([2, 3, 5, 6, None, None], key=repr)
    assert decontaminate.leaks(docs, benchmark.where("1 = 0")).count() == 0
    assert decontaminate.leaks(empty_documents(spark), benchmark).count() == 0


def test_passages_are_multiplied_by_their_pairs_of_words():
    rng = np.random.default_rng(3)
    for size in (1, 5, 300):
        row = np.sort(rng.integers(0, 40, 500))
        row, index, weight = decontaminate.weighted(row, rng.integers(0, size, 500), rng.random(size) + 0.5)
        basis = rng.standard_normal((size, 7)).astype(np.float32)
        dense = np.zeros((40, size))
        dense[row, index] = weight
        square = decontaminate.Square(size)
        for part in (row < 20, row >= 20):  # batches hold whole rows
            square.add(row[part], index[part], weight[part])
        plain = np.zeros((size, 7), dtype=np.float32)
        decontaminate._multiply(row, index, weight, basis, plain)
        want = dense.T @ (dense @ basis)
        scale = np.abs(want).max()
        assert np.allclose(square.times(basis), want, atol=1e-5 * scale) and np.allclose(plain, want, atol=1e-5 * scale)
