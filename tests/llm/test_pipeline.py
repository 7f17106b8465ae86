"""The pipeline's stages, each on what its predecessor wrote."""

import corpus_pipeline
from tests.llm.helpers import empty_documents, nasty_documents
from tests.llm.test_near_copies import plain_classes
from tests.llm.test_packing import check, encoder  # noqa: F401
from tests.llm.test_decontamination import plain_leaks
from tests.llm.test_spans import plain_pii
from watchgrid.llm import pii
from watchgrid.session import materialize


def test_stages_match_brute_force(spark, sf, encoder):  # noqa: F811
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        docs = materialize(stage(spark, docs, sf), f"test-{name}")
        after = [r.asDict() for r in docs.collect()]
        if name != "packing":
            assert docs.columns == columns
        if name == "language":
            assert all(r in before for r in after) and len(after) > 0.95 * len(before)
        elif name == "near_copies":
            classes = plain_classes([(r["doc_id"], r["text"]) for r in before])
            assert {r["doc_id"] for r in after} == set(classes.values())
        elif name == "decontamination":
            gone = {i for i, _ in plain_leaks([(r["doc_id"], r["text"]) for r in before], [(r["item_id"], r["text"]) for r in benchmark.collect()])}
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - gone
        elif name == "personal_data":
            was = {r["doc_id"]: r["text"] for r in before}
            assert len(after) == len(before)
            for r in after:
                assert plain_pii(r["text"]) == [] and r["n_chars"] == len(r["text"])
                assert (r["text"] == was[r["doc_id"]]) == (pii.find(was[r["doc_id"]]) == [])
        else:
            check(docs.collect(), [(r["doc_id"], r["text"]) for r in before], encoder)


def test_awkward_rows(spark, sf):
    for start in (nasty_documents(spark), empty_documents(spark)):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, sf), f"awkward-{name}")
        assert docs.columns[:2] == ["doc_id", "start"]


def test_clashing_columns_and_tables_without_overlap(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    clash = docs.withColumnsRenamed({"source": "__gone"}).withColumns({"__dirty": docs.doc_id, "__P": docs.doc_id})
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, clash, sf)
        assert out.columns == clash.columns and out.count() > 0, name
    far = spark.createDataFrame([(1, "zzz yyy xxx", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    assert corpus_pipeline.decontaminated(spark, far, sf).count() == 2
