"""Profiles from pieces against profiles of whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from lexforge.functions.pieces import analyze_files, analyze_pieces
from lexforge.functions.text import analyze
from lexforge.plans.queries import QUERIES

COLUMNS = ["lang", "chars_total", "chars_no_space", "words_cn", "words_en", "paragraphs", "sentences", "domain", "difficulty", "domain_scores"]


def texts():
    rng = random.Random(9)
    parts = ["contract", "liab", "ility", "data", "base", "合", "同", "患者", " ", "\n", "\n\n", "\t", "　", ".", "!?", "。", "；", "Word", "é", "\r\n", "API", "server"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["", None, "\n\n", " \n \n x", "x\n \t\n", "pharmaceutical", "a\n\n\nb" * 20]


def profiles(df):
    return {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


@pytest.mark.parametrize(("size", "fan_in"), [(1, 3), (2, 1000), (7, 2), (1000, 5)])
def test_pieces_of_every_size(spark, size, fan_in):
    all_texts = texts()
    docs = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string")
    pieces = [(i, k, t[k * size : (k + 1) * size]) for i, t in enumerate(all_texts) if t is not None for k in range(len(t) // size + 1)] + [(all_texts.index(None), 0, None)]
    random.Random(1).shuffle(pieces)
    got = analyze_pieces(spark.createDataFrame(pieces, "doc_id long, piece long, text string"), fan_in=fan_in)
    assert profiles(got) == profiles(analyze(docs))


def test_files(spark, tmp_path):
    some = [t for t in texts() if t]
    for k, t in enumerate(some):
        (tmp_path / f"{k:03}.txt").write_bytes(t.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")  # several splits a file
    try:
        got = analyze_files(spark, f"file://{tmp_path}", fan_in=2)
        have = profiles(got.withColumn("doc_id", F.regexp_extract("doc_id", r"(\d+)\.txt$", 1).cast("long")))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert have == profiles(analyze(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")))


def test_query_cuts_each_text_once(spark, tmp_path):
    """A text isn't repeated beside each of its pieces; nulls, empty texts and characters of four bytes stay whole."""
    some = ["x" * 98 + "contract 合同", "😀" * 250 + ".\n\nserver", "", None, "a" * 100, "b" * 95 + "audit" + "audit", "one\n \u3000\ntwo" * 40]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["analyze_pieces"](spark, str(tmp_path))
    assert "sequence(" not in got._jdf.queryExecution().optimizedPlan().toString()
    columns = got.columns
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in analyze(docs).select(*columns).collect()}
