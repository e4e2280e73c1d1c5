"""From raw documents to packed training sequences: the stages in order, and the whole run."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.llm.importance import keep_drawn
from tabkit.llm.jaccard_join import jaccard_components
from tabkit.llm.line_dedup import dedup_lines
from tabkit.llm.packing import Limits, pack_documents
from tabkit.llm.quality_rules import keep_good
from tabkit.llm.staging import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the cutoffs of their language keep.

    Null and empty texts have no words and go. Repeated rows, and equal texts of a language, are judged alike; a null language is one of its own.
    Without labels the base rules alone decide. An empty table gives an empty one; further columns stay, whatever their names.
    """
    return keep_good(docs, _labels(spark, sf_dir))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance.

    Null and empty texts weigh nothing, so that their noise alone decides. Repeated rows are drawn alike, and so are equal keys at the border.
    Without labelled good documents all rows stay. An empty table gives an empty one; further columns stay, whatever their names.
    """
    return keep_drawn(docs, _labels(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that it shares with at least two others, but for the largest id; ``n_chars`` follows.

    A null text comes back empty. Every row stays; repeated rows count as one document and keep or lose the same lines. Rows without an id
    count as no document and lose the lines that others share. An empty table gives an empty one; further columns stay, whatever their names.
    """
    # dedup_lines adds two counts, which columns of these names in ``docs`` must outlive.
    clash = {c: f"__own_{c}" for c in docs.columns if c.lower() in ("n_lines", "n_dropped")}
    kept = dedup_lines(docs.withColumnsRenamed(clash)).withColumn("n_chars", F.char_length("text").cast("long"))
    return kept.select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, similarity 0.8 or more), the rows of the smallest id.

    Rows without an id come after all ids, those with equal texts as one document. Null texts and texts without words are like nothing and
    stay. Repeated rows share an id and stay or go together. An empty table gives an empty one; further columns stay, whatever their names.
    """
    key = "__id"
    while key.lower() in {c.lower() for c in docs.columns}:
        key = "_" + key
    # 2**62 and up: beyond the ids of documents.
    own_id = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62))
    keyed = docs.withColumn(key, own_id)
    found = jaccard_components(keyed, id_col=key, shingle=5, num=4, den=5)
    gone = found.where(F.col(key) != F.col("component_id")).select(key).distinct()
    return keyed.join(gone, key, "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 4096 tokens.

    A null or empty text is the end token alone; every row, repeated or without an id, is packed whole. An empty table gives no pieces;
    further columns are left out.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, limits=Limits(4096, 256, 4096))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]

#: A draw by a fitted model and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet in the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
