"""Language labels: held-out accuracy, exact probabilities, awkward rows."""

import itertools
import zlib

import numpy as np

from tests.llm.helpers import empty_documents, nasty_documents
from watchgrid.llm import language_crf


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(2)
    n, k = 5, 3
    scores, step, start = rng.normal(size=(2, n, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    mask = np.ones((2, n), dtype=bool)
    mask[1, 3:] = False
    pairs = np.zeros((k, k))
    got = language_crf.marginals(scores.copy(), mask, step, start, pairs)
    want_pairs = np.zeros((k, k))
    for b, length in ((0, 5), (1, 3)):
        want, total = np.zeros((length, k)), 0.0
        links = np.zeros((k, k))
        for path in itertools.product(range(k), repeat=length):
            w = np.exp(start[path[0]] + sum(scores[b, t, y] for t, y in enumerate(path)) + sum(step[x, y] for x, y in zip(path, path[1:])))
            total += w
            for t, y in enumerate(path):
                want[t, y] += w
            for x, y in zip(path, path[1:]):
                links[x, y] += w
        want_pairs += links / total
        assert np.allclose(got[b, :length], want / total)
    assert np.allclose(pairs, want_pairs)


def test_code_switched_words_are_told_apart():
    passages = [("the house and the garden were very green in summer " * 3, "en"), ("der garten und das haus waren sehr gruen im sommer " * 3, "de")]
    model = language_crf.learn(passages * 10, epochs=6)
    found = language_crf.letter_words("the garden and the house der garten und das haus")
    scores = language_crf.scores_of(*language_crf.features(found), len(found), model.weights)[None]
    share = language_crf.marginals(scores, np.ones((1, len(found)), dtype=bool), model.transitions, model.start)[0]
    assert [model.labels[i] for i in share.argmax(1)] == ["en"] * 5 + ["de"] * 5


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_crf.identify(docs).collect()
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.collect()}
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    judged = [r for r in rows if r["held_out"] and truth[r["doc_id"]][0]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]][0] for r in judged]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_clean_code_switched_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    parts = {}
    for r in docs.orderBy("doc_id").collect():
        found = language_crf.letter_words(r["text"])
        if r["lang"] and len(found) >= 40 and len(parts.setdefault(r["lang"], [])) < 20:
            parts[r["lang"]].append(" ".join(found[:40]))
    one, two, three = (parts[lang] for lang in sorted(parts)[:3])
    mixed = [(1_000_000 + i, " ".join(x), None) for i, x in enumerate(zip(one, two, three))]
    mixed += [(2_000_000 + i, f"{x} {y}", None) for i, (x, y) in enumerate(zip(two, three))]
    both = docs.unionByName(spark.createDataFrame(mixed, docs.schema))
    kept = {r["doc_id"] for r in language_crf.keep_identified(both).select("doc_id").collect()}
    assert len(mixed) == 40 and {m[0] for m in mixed} <= kept
    known = {r["doc_id"]: r["lang_pred"] for r in language_crf.identify(both).collect()}
    assert {i for i in known if i not in kept} == {i for i, x in known.items() if x == language_crf.UNKNOWN}


def test_awkward_rows(spark):
    docs = nasty_documents(spark)
    rows = language_crf.identify(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] is not None}
    assert by[2] == by[3] == by[5] == by[6] == "und" and by[1] != "und"
    assert language_crf.identify(empty_documents(spark)).count() == 0
    nothing = docs.withColumn("lang", language_crf.F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_crf.identify(nothing).collect()} == {"und"}
    kept = language_crf.keep_identified(docs)
    assert kept.columns == docs.columns and all(r["text"] for r in kept.collect())


def test_ids_shared_by_whole_languages(spark):
    english, german = "the cat sat on the mat with the other", "der Hund und die Katze sind nicht hier"
    rows = [(11, f"{english} {i}", "en") for i in range(900)] + [(12, f"{german} {i}", "de") for i in range(900)] + [(13, "un solo texto", "es")]
    rows += [(20, "the mat and the cat", None), (21, "die Katze und der Hund", None), (22, "²½ ①", None), (23, "Ⅷ ³", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_crf.fit(docs)
    kept = {r.lang for r in docs.where(~language_crf.held_out(docs.doc_id)).select("lang").distinct().collect() if r.lang}
    assert set(model.labels) == kept
    got = {r.doc_id: r.lang_pred for r in language_crf.identify(docs).where("doc_id >= 20").collect()}
    assert got[22] == got[23] == "und"
    assert {got[20], got[21]} <= kept
