"""Cleaning a text corpus for training, stage by stage.

language -> toxicity -> near duplicates -> benchmark -> packing.  Every stage
reads the Parquet files that the stage before it wrote; all but the last
return the columns of ``documents``.
"""
from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from starloom.llm import decontamination, language_id, near_dup, packing, toxicity  # noqa: E402
from starloom.llm.common import fold_of, maybe_in, read_table, written  # noqa: E402

#: Least pooled probability of the predicted language; below it no language stands out.
MIN_LANGUAGE = 0.3


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row: a verdict's columns cannot clash with the row's."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language: null, empty or without a letter,
    or with no language of probability MIN_LANGUAGE.  A corpus without any
    language label has nothing to learn from and keeps every document."""
    net = language_id.fit(docs.filter(fold_of(F.col("doc_id"), 5) != 0))
    if not net.classes:
        return docs
    said = language_id.predict(_rows(docs), net, keep=("row",))
    return said.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE)).select("row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic; learned from the labelled ones that are left."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic").filter("toxic is not null")
    labelled = docs.select("doc_id", "text").join(labels, "doc_id").filter(fold_of(F.col("doc_id"), 4) != 2)
    return toxicity.score(_rows(docs), toxicity.fit(labelled), keep=("row",)).filter("predicted = 0").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies,
    once, of several texts under that id the first in their order (equal ones:
    by their other columns, as JSON); documents without an id belong to no
    group and stay.  Only documents that may have to go, or whose id repeats,
    are shuffled with their text; the others pass by a bit map of fixed size."""
    ids = docs.select("doc_id").filter("doc_id is not null")
    classes = near_dup.near_duplicates(docs)
    gone = classes.filter("class_id <> doc_id").select("doc_id", F.lit(True).alias("__gone"))
    twice = ids.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", F.lit(False).alias("__gone"))
    special = written(gone.unionByName(twice).groupBy("doc_id").agg(F.max("__gone").alias("__gone")), "dup-special")
    row = F.struct(*docs.columns).alias("row")
    marked = maybe_in(docs.select(row, "doc_id"), special, "doc_id")
    sure = marked.filter(~F.col("__maybe")).select("row.*")
    found = marked.filter("__maybe").join(special, "doc_id", "left")
    kept = found.filter("__gone is null").select("row.*")
    first = Window.partitionBy("doc_id").orderBy(F.col("row.text").isNull(), "row.text", F.to_json("row"))
    once = found.filter("not __gone").withColumn("__at", F.row_number().over(first)).filter("__at = 1").select("row.*")
    return sure.union(kept).union(once)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontamination.without_items(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in sequences of 4096 tokens."""
    import public_tokenizers

    cap = packing.Capacity()
    return packing.best_fit(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), max_tokens=cap.tokens), cap)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("packing", pack),
]

#: The stages learn models, draw signatures and tokenise: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
