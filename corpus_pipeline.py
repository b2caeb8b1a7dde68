"""A corpus from raw documents to packed sequences: each stage writes Parquet that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import LOWEST, document_key, stored, text_keys
from weftline.llm.jaccard_join import ROW, similar_rows
from weftline.llm.langid import UNDETERMINED, held_out, identify, learn
from weftline.llm.line_dedup import dedup_lines
from weftline.llm.packing import pack_documents
from weftline.llm.pii import mask_pii
from weftline.llm.queries import tokenizer

LEAST_SCORE = 0.5


def _as_documents(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, ``n_chars`` being the length of the text as it is now."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, no letter, or no language with half of the score. A null ``lang`` gets the predicted one.

    The model is learnt from the stage's own labelled documents, less the held-out fifth. Where these teach no language (no labels, no ids),
    nothing can be rejected, and every document stays as it is.
    """
    model = learn(docs.filter(~held_out()))
    if not model.languages:
        return docs
    told = identify(docs, model)
    kept = told.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("lang_score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that five or more documents share out of all but the last of them. Every document stays."""
    return _as_documents(dedup_lines(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.75 similarity connect, the one with the smallest id stays (one without id if none has one).

    Documents are rows told apart by id and text: unlike texts under one id, or without one, all stay. Of rows with the same id and text, one stays.
    """
    rows = similar_rows(docs)
    first = F.min(F.struct((F.col("doc") == LOWEST).alias("unnamed"), *ROW)).alias("row")
    kept = rows.filter("node is not null").groupBy("node").agg(first).select("row.*").drop("unnamed")
    kept = kept.unionByName(rows.filter("node is null").select(*ROW).distinct())
    keys = [f"_key_{c}" for c in ROW]
    once = docs.withColumns(dict(zip(keys, [document_key(), *text_keys()]))).dropDuplicates(keys)
    return once.join(kept.toDF(*keys), keys, "left_semi").select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of each span of personal data in its place. Every document stays."""
    return _as_documents(mask_pii(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("pii", pii),
    ("packing", packing),
]

# SQL cannot express the learnt model, the similarity graph, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
