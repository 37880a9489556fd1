"""Corpus pipeline: quality rules, line dedup, n-gram Jaccard join, suffix-array dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents; where a stage shortens a text,
n_chars follows it. Rows with null ids or texts pass like others: a null text has no words, so the quality
rules reject it.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import line_dedup, ngram_join, packing, quality_rules, suffix_dedup
from lexforge.llm.common import forget, materialize, release, stored, table


#: Tables that the last stage wrote on its way. Its result is written before the next stage is called.
_on_the_way: set[str] = set()


def _stage(f):
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget(_on_the_way)
        _on_the_way.clear()
        before = stored()
        out = f(spark, docs, sf_dir)
        _on_the_way.update(stored() - before)
        return out

    return run_stage


def _recount(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


@_stage
def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


@_stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that repeat earlier ones: of three lines, or of fewer with 50 words. A
    document that loses all its lines goes."""
    out, info = line_dedup.dedup_lines(docs, long_words=line_dedup.LONG_WORDS), line_dedup.info_name(docs)
    return _recount(out.filter((F.col(info)["n_removed"] < F.col(info)["n_lines"]) | (F.col(info)["n_lines"] == 0)).drop(info))


@_stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies: five-word shingles, similarity 0.8 or more."""
    linked = ngram_join.join_documents(docs, width=5, percent=80)
    keep = linked.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(keep.hint("merge"), docs["doc_id"].eqNullSafe(keep["_id"]), "left_semi")


@_stage
def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that documents with smaller ids have. One that loses all its bytes goes."""
    out = suffix_dedup.dedup_rows(docs)
    return _recount(out)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", filter_quality),
    ("line_dedup", dedup_lines),
    ("ngram_join", one_of_each_group),
    ("suffix_dedup", dedup_substrings),
    ("packing", pack),
]

#: Expectation-maximisation and tokenisation have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        new = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(docs)
        docs = new
    return docs
