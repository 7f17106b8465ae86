"""Packing: exact round trip of all tokens, patterns against known optima."""

import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import empty_documents, nasty_documents
from watchgrid.llm import packing, queries


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(queries.TOKENIZER)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x120, exclude_categories=["Cs"]), max_size=40))
def test_ids_are_those_of_the_tokenizer(encoder, text):
    assert encoder.encode(text) == encoder.whole(text)
    assert encoder.encode("the " + text + "'s 12 \n\n x") == encoder.whole("the " + text + "'s 12 \n\n x")


def test_added_tokens_are_single_ids(encoder):
    plain = Tokenizer.from_file(queries.TOKENIZER)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "\u03b1 <|endoftext|> b", "<|endoftext|", "a b"):
        want = np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert encoder.encode(text) == want
    assert list(struct.unpack("<4I", encoder.encode("a <|endoftext|> b"))) == [64, 220, 50256, 275]


def check(rows, docs, encoder):
    """Every id of every document in one piece, every sequence gapless and within its length."""
    want = sorted((-1 if i is None else i, start, len(p) // 4, zlib.crc32(p), len(ids) // 4)
                  for i, t in docs for ids in [encoder.whole(t or "") + struct.pack("<I", 0)]
                  for start in range(0, len(ids) // 4, packing.CAPACITY) for p in [ids[4 * start:4 * (start + packing.CAPACITY)]])
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return sequences


def test_given_documents_round_trip(spark, encoder):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, queries.TOKENIZER).collect()
    sequences = check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], encoder)
    assert sum(r["length"] for r in rows) > 0.97 * packing.CAPACITY * len(sequences)


def test_awkward_rows(spark, encoder):
    docs = nasty_documents(spark)
    check(packing.pack(docs, queries.TOKENIZER).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], encoder)
    assert packing.pack(empty_documents(spark), queries.TOKENIZER).count() == 0


@pytest.mark.parametrize("histogram,least", [({512: 10}, 5), ({600: 3, 424: 3}, 3), ({1024: 4}, 4), ({1: 1024}, 1), ({341: 3, 342: 3}, 3), ({700: 2, 324: 1}, 2)])
def test_small_optima(spark, histogram, least):
    slots = packing.planned(spark.createDataFrame(list(histogram.items()), "length long, count long"))
    assert int((slots["sequence"] + -(-(slots["hi"] - slots["lo"]) // slots["each"])).max()) <= least


def test_linear_program_reaches_the_bound(spark):
    def solve(parts):  # in a task, where numpy runs on one thread
        list(parts)
        rng = np.random.default_rng(4)
        lengths = np.sort(rng.choice(np.arange(20, 400), 120, replace=False))
        counts = rng.integers(100, 4000, 120).astype(float)
        columns, uses = packing.patterns(lengths, counts, 1024, 0.002)
        good = (columns.T @ lengths <= 1024).all() and np.allclose(columns @ uses, counts, rtol=1e-3)
        yield pd.DataFrame([(float(uses.sum()), float(counts @ lengths) / 1024, bool(good))], columns=["used", "least", "good"])

    row = spark.range(1).coalesce(1).mapInPandas(solve, "used double, least double, good boolean").first()
    assert row["good"] and row["used"] <= 1.01 * row["least"]


def test_hot_length_is_ranked_once(spark):
    rows = [(i, i % 3 and 1000 or 24 + i % 7, 0, 0) for i in range(6000)]
    found = spark.createDataFrame(rows, "doc_id long, length long, start long, ids_crc32 long")
    out = packing.assign(found, packing.planned(found.groupBy("length").count())).select("length", "__place.sequence_id", "__place.offset").collect()
    taken = {(r["sequence_id"], r["offset"]) for r in out}
    assert len(taken) == len(rows)
