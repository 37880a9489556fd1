"""Schemas of the persistent tables and of lookup results."""

from pyspark.sql import types as T

TERMS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("word", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("translation", T.StringType()), T.StructField("domain", T.StringType()), T.StructField("status", T.StringType()), T.StructField("notes", T.StringType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()),
])
ASSOCIATIONS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("term_id", T.LongType()), T.StructField("related_word", T.StringType()),
    T.StructField("relation_type", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("source", T.StringType()),
])
LOOKUP = "query string, word string, type string, source string, score double, definition string, source_rank int, ordinal long"
#: Fields that an update or an import may set, with their defaults where a file has no such column.
EDITABLE = ["word", "lang", "type", "translation", "domain", "status", "notes"]
DEFAULTS = {"lang": "auto", "type": "", "translation": "", "domain": "", "status": "draft", "notes": ""}
EXPORTED = ["word", "translation", "type", "domain", "status", "lang", "notes"]
