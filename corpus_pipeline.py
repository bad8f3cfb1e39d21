"""Corpus pipeline: quality classifier, line dedup, SimHash near-dedup, secret scans, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``, with n_chars following the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.common import cut_lineage, free_name, table
from waymark.llm.line_dedup import drop_frequent_lines
from waymark.llm.packing import pack_documents
from waymark.llm.quality import keep_good
from waymark.llm.queries import KEEP_FROM
from waymark.llm.secret_scan import hide_secrets
from waymark.llm.simhash import near_copies, word_key

#: Near duplicates here: five-word shingles, candidates with near fingerprints or an equal band, kept at an exact similarity of 0.8.
WORDS, RADIUS = 5, 3
MIN_DOCS = 10


def _as_documents(frame: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with n_chars of the text as it is now."""
    chars = F.length("text").cast(like.schema["n_chars"].dataType)
    return frame.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(chars)).select(*(F.col(f"`{c}`") for c in like.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"), KEEP_FROM)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ``MIN_DOCS`` documents or more go; documents stay, if only as empty texts."""
    return _as_documents(drop_frequent_lines(docs, MIN_DOCS, 1), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component stays: that of the least doc_id, once if it is there more often.

    Rows are told apart by their words, not by doc_id: unlike texts under one id are documents of their own.
    Documents without words and rows without an id say nothing about being copies, and stay.
    """
    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]") & F.col("doc_id").isNotNull()
    found = near_copies(docs.where(worded).select("doc_id", "text"), WORDS, RADIUS)
    node, rank = free_name("__node", docs.columns), free_name("__rank", docs.columns)
    stays = cut_lineage(found.where("node = kept").select(F.col("node").alias(node)))
    first = Window.partitionBy(node).orderBy("doc_id", "text", "source", "lang", "n_chars")
    single = docs.where(worded).withColumn(node, word_key(F.col("text"))).withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1)
    return single.join(stays.hint("merge"), node, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns)).union(docs.where(F.coalesce(~worded, F.lit(True))))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; documents stay."""
    return _as_documents(hide_secrets(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=0)


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("secret scans", secret_scan), ("best-fit packing", packing)]
#: No SQL: the classifier, the fingerprints, the forest and the tokenizer are not SQL's. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents. Each but the last is written once to the shared folder, so no later stage repeats it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
