"""A corpus from raw documents to packed sequences: each stage works on all that the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of ``documents``. Every decision is made for a row, told
by its place in the stage's input (``runtime.keyed``), and rejected rows are left out by an anti-join on that place, whose list is broadcast
only while it is small. So rows that share an id, or have none, are kept or dropped each on its own.

Null texts go in the first stage if anything could be learned; otherwise they count as empty, which is one group of exact copies. Of repeated rows
one stays. Empty tables pass as empty tables through every stage. Texts are read whole. Columns other than those of ``documents`` are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemap.llm import decontamination, exact_dedup, lang_id, ngram_join, packing
from stridemap.llm.batches import bounded
from stridemap.runtime import KEY, keyed, materialize, scratch_path, small_side, written_once

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(docs: DataFrame) -> DataFrame:
    """(id, text, KEY, COLUMNS) of a stage's input, a table just read."""
    return keyed(bounded(docs), *COLUMNS, F.col("doc_id").cast("long").alias("id"), scan=True)


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` without those whose KEY is in ``gone``."""
    gone = small_side(materialize(gone.select(*KEY).distinct(), "gone", few=True), 24)
    return rows.join(gone, KEY, "left_anti").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labels teach."""
    return lang_id.known_language(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the longest as written, then the one with the smallest id."""
    rows = _rows(docs)
    return _without(rows, exact_dedup.measured(rows.select("id", "text", *KEY)).where(~F.col("first")))


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    rows = _rows(docs)
    return _without(rows, ngram_join.labelled(rows.select("id", "text", *KEY)).where(~F.col("first")))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    rows, benchmark = _rows(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return _without(rows, decontamination.leaks(rows.select("id", "text", *KEY), items))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents."""
    return packing.packed(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Language identification, the n-gram join's components and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result but the last is written and read again, and what it needed besides is deleted then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with written_once(spark):
            docs = materialize(stage(spark, docs, sf_dir), name, path=path)
    return STAGES[-1][1](spark, docs, sf_dir)
