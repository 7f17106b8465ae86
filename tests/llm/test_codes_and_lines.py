"""One-bit codes against exact search, line deduplication against a plain loop."""

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import empty_documents, nasty_documents
from watchgrid.llm import binary_codes, line_dedup


def plain_nearest(rows, k):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows
            if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, v in good:
        if i % 100 == 0:
            near = sorted((float(np.sqrt(np.cumsum((w - v) ** 2)[-1])), j) for j, w in good if j != i and len(w) == len(v))
            out[i] = near[:k]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    return out


def test_given_vectors_have_full_recall(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = plain_nearest([(r["vec_id"], r["embedding"]) for r in df.collect()], 10)
    assert collected(binary_codes.nearest(df, F.col("vec_id") % 100 == 0)) == want


def test_blocks_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 12).astype(float).tolist(), "c") for i in range(1, 500)]
    rows += [(600, [0.0] * 12, "c"), (700, [float("nan")] * 12, "c"), (800, None, "c"), (900, [None] * 12, "c"), (None, [1.0] * 12, "c"),
             (1000, [1.0] * 5, "c"), (1001, [1.0] * 5, "c"), (1100, [], "c"), (1200, [float("inf")] * 12, "c")]
    rows += [(i, rows[99][1], "c") for i in range(2001, 2041)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    want = plain_nearest([r[:2] for r in rows], 10)
    for block in (1, 2, 100):
        assert collected(binary_codes.nearest(df, F.col("vec_id") % 100 == 0, block=block)) == want
    assert len(want[1000]) == 1
    assert binary_codes.nearest(df.where("1 = 0"), F.col("vec_id") % 100 == 0).count() == 0


def plain_lines(rows):
    first = {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for start, _, digest in line_dedup.units(text):
            first.setdefault(digest, (doc_id, start))
    out = []
    for doc_id, text in rows:
        gone = [(a, b) for a, b, d in line_dedup.units(text) if first[d] != (doc_id, a)]
        keep, at = "", 0
        for a, b in gone:
            keep += text[at:a]
            at = min(len(text), b + 1)
        out.append((doc_id, None if text is None else keep + text[at:], len(gone), ",".join(f"{a}:{b}" for a, b in gone)))
    return sorted(out, key=repr)


def test_lines_match_plain_loop(spark, sf):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), nasty_documents(spark), empty_documents(spark),
               spark.createDataFrame([(3, "A  b\nc\n\na B\n"), (1, "x\nc"), (2, "c\n\nx"), (None, "a b"), (4, "\u00e9\n\u00c9")], "doc_id long, text string")):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = sorted(((r["doc_id"], r["text"], r["n_removed"], r["removed"]) for r in line_dedup.dedup_lines(df).collect()), key=repr)
        assert got == plain_lines(rows)


def plain_repeats(rows, size):
    """What is left if every run of ``size`` words that an earlier place holds goes, in texts of one line."""
    first, out = {}, {}
    for doc_id, text in sorted(rows):
        words = text.split(" ")
        gone = set()
        for i in range(len(words) - size + 1):
            run = tuple(w.strip(".").lower() for w in words[i:i + size])
            if first.setdefault(run, (doc_id, i)) != (doc_id, i):
                gone.update(range(i, i + size))
        out[doc_id] = " ".join(w for i, w in enumerate(words) if i not in gone)
    return out


def test_passages_within_longer_lines(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    planted = [[str(w) for w in rng.choice(vocabulary, n)] for n in (49, 50, 60, 130)]
    rows = []
    for doc_id in range(60):
        words = [str(w) for w in rng.choice(vocabulary, int(rng.integers(1, 200)))]
        for passage in planted:
            if rng.random() < 0.4:
                at = int(rng.integers(0, len(words) + 1))
                words[at:at] = [*passage[:-1], passage[-1].upper() + "." * int(rng.integers(0, 2))]
        if doc_id % 9 == 0:
            words += ["on", "and"] * 40
        words.append(f"end{doc_id}")
        rows.append((doc_id, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_repeats(df).collect()}
    want = plain_repeats(rows, line_dedup.PASSAGE)
    assert {i: r["text"] for i, r in got.items()} == want
    assert sum(want[i] != t for i, t in rows) > 20
    for doc_id, text in rows:
        spans = [tuple(map(int, s.split(":"))) for s in got[doc_id]["removed"].split(",") if s]
        assert line_dedup.less(text, spans) == want[doc_id] and len(spans) == got[doc_id]["n_removed"]


def test_short_lines_stay_unless_their_run_is_long(spark):
    rows = [(1, "Yes.\none two three four five\nno\nalpha beta\ngamma delta epsilon"), (2, "Yes.\nfresh\nOne two  three four five\nend"),
            (3, "alpha beta\ngamma delta epsilon\n\nno\nlast"), (None, None), (4, "")]
    got = {r["doc_id"]: (r["text"], r["removed"]) for r in line_dedup.dedup_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], ""), 2: ("Yes.\nfresh\nend", "11:35"), 3: ("\nlast", "0:10,11:30,32:34"), None: (None, ""), 4: ("", "")}


def test_repeats_of_awkward_rows(spark):
    docs = nasty_documents(spark)
    got = line_dedup.dedup_repeats(docs).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    assert line_dedup.dedup_repeats(empty_documents(spark)).count() == 0


def test_texts_that_share_an_id_keep_their_own_lines(spark):
    line, other = "one line of five plain words", "another line of five new words"
    rows = [(i, t) for i in (None, 7) for t in (f"{line}\nrest {i}", f"{other} {i}\nmore {i}")] + [(9, f"{line}\nend")]
    got = line_dedup.dedup_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = {(r.doc_id, r.text) for r in got}
    assert {(7, f"{line}\nrest 7"), (7, f"{other} 7\nmore 7"), (None, f"{other} None\nmore None"), (None, "rest None"), (9, "end")} == kept
