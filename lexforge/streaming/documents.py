"""The document operators on streams: profiles are stateless projections; term counts use a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions.text import analyze
from lexforge.operators.terms import token_array


def read_document_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Whole text files as they arrive: doc_id, text, arrived."""
    s = spark.readStream.option("wholetext", True).text(folder)
    return s.select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"), F.current_timestamp().alias("arrived"))


def analyze_stream(docs: DataFrame) -> DataFrame:
    return analyze(docs)


def term_counts(docs: DataFrame, time_col: str = "arrived", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Tokens per time window; rows later than the watermark are not counted, so state stays bounded."""
    each = docs.withWatermark(time_col, late).select(time_col, F.explode(token_array(F.col("text"))).alias("token"))
    return each.groupBy(F.window(time_col, window).alias("w"), "token").agg(F.count("*").alias("n"))
