"""A corpus on its way to training: language, near copies, benchmark leaks, personal data, packing.

Each stage reads what its predecessor wrote.  All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.llm import decontaminate, language_crf, order_minhash, packing, pii, queries
from watchgrid.session import shared_folder


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the others go.

    Null and empty texts and those without a letter have none.  Repeated rows stay or go together; an empty
    table stays empty.
    """
    return language_crf.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the smallest id.

    Null and empty texts are classes of their own, rows with a null id all stay, of rows with one id one
    stays.  An empty table stays empty.
    """
    return order_minhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage.

    Null and empty texts hold none; rows with a null id stay; rows that share an id go together.  An empty table
    stays empty.
    """
    return decontaminate.keep_clean(docs, queries.table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the new text.

    Null texts stay null, empty ones empty; repeated rows change alike.
    """
    out = docs.withColumn("text", pii.masked_text("text"))
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens; null and empty texts are one token, repeated rows come again."""
    return packing.pack(docs, queries.TOKENIZER)


STAGES = [
    ("language", identified),
    ("near_copies", near_copies),
    ("decontamination", decontaminated),
    ("personal_data", masked),
    ("packing", packed),
]

#: Learned models, alignments and tokens are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
