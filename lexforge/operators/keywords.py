"""Texts against a table of keywords of any number: which keywords does each text contain?

Up to MOST_BYTES of keywords, they are broadcast: each Python worker builds one Aho-Corasick automaton and passes over
each text once, whatever the number of keywords. The size is checked first, by one aggregate over the distinct keywords.
Beyond it no keyword is broadcast: texts and keywords meet on q-grams. A keyword is asked under one of its grams, the one
that fewest texts have; the pairs that meet are verified by contains(). Both ways give the same rows. A gram costs the
same at any place of a text, and only grams of keywords are shuffled if those fit SMALL_BYTES.

Matching is by substring, case kept; fold() texts and keywords first where case must not matter. Null and empty
keywords match nothing, as do null texts; repeated keywords count once; rows of one id are matched row by row and
their keywords reported once for the id and row.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.domains import DOMAIN_KEYWORDS, DOMAINS
from lexforge.sources.shared import workers_import

#: Keywords are broadcast up to so many bytes of UTF-8, and as many of them at most.
MOST_BYTES, MOST_KEYWORDS = 16 << 20, 500_000
#: Characters of the grams on which texts and keywords meet beyond that; shorter keywords use shorter ones.
GRAM = 4
#: Texts are cut into so many characters for it.
PART = 200
#: The grams of so many bytes of keywords are broadcast to the texts.
SMALL_BYTES = 1 << 20


@functools.lru_cache(maxsize=1)
def _automaton(words: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, w in enumerate(words):
        a.add_word(w, k)
    if words:
        a.make_automaton()
    return a


def _scan(words):
    """For each text the numbers of the keywords it contains, each once, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tuple(words.value)
        a = _automaton(known)
        for batch in batches:
            found = []
            for t in batch.column(0).to_pylist():
                hits = sorted({k for _, k in a.iter(t)}) if t and known else []
                found.append([known[k] for k in hits])
            keys = batch.column(1)
            yield pa.RecordBatch.from_arrays([keys, pa.array(found, pa.list_(pa.string()))], names=["_key", "_found"])

    return run


def _keywords(table: DataFrame, column: str) -> DataFrame:
    return table.select(F.col(column).cast("string").alias("keyword")).filter("keyword <> ''").distinct()


def _by_automaton(texts: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """texts(text, key) with the keywords found. words has at most MOST_KEYWORDS rows, as checked."""
    spark = texts.sparkSession
    workers_import(spark)
    known = spark.sparkContext.broadcast([r["keyword"] for r in words.orderBy("keyword").collect()])
    kind = texts.schema[key].dataType.simpleString()
    got = texts.select(F.col("text"), F.col(key)).mapInArrow(_scan(known), f"_key {kind}, _found array<string>")
    return got.select(F.col("_key").alias(key), F.explode("_found").alias("keyword"))


def _text_grams(rows: DataFrame, key: str, sizes: list[int]) -> DataFrame:
    """key, _row and gram for every place of a text. Texts are cut first, with what the grams reach over, so that the
    work grows with their length."""
    parts = rows.select(key, "_row", F.explode(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{1,{PART + GRAM - 1}}})).{{1,{PART}}}"), 1)).alias("_part"))

    def of_size(n: int) -> Column:
        last = F.least(F.lit(PART), F.length("_part") - (n - 1))
        at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.substring("_part", i, F.lit(n)))

    return parts.select(key, "_row", F.explode(F.concat(*[of_size(n) for n in sizes])).alias("gram"))


def _by_grams(texts: DataFrame, words: DataFrame, key: str, sizes: list[int], small: bool) -> DataFrame:
    """The same pairs by a join on grams. texts may hold several rows of one key; they are told apart by their text.
    sizes are the lengths of the keywords' grams; if they are small, the grams asked for are broadcast."""
    rows = texts.filter(F.length("text") > 0).withColumn("_row", F.xxhash64(F.col(key), F.col("text")))
    n = F.least(F.length("keyword"), F.lit(GRAM))
    of = F.transform(F.sequence(F.lit(1), F.length("keyword") - n + 1), lambda i: F.substring("keyword", i, n))
    asked = words.select("keyword", F.explode(F.array_distinct(of)).alias("gram"))
    wanted = asked.select("gram").distinct()
    # most places are sorted out before anything travels; what is left is told once for each text
    index = _text_grams(rows, key, sizes).join(F.broadcast(wanted) if small else wanted, "gram", "left_semi").distinct()
    held = index.groupBy("gram").agg(F.count("*").alias("n"))
    w = Window.partitionBy("keyword").orderBy("n", "gram")
    one = asked.join(held, "gram").withColumn("_place", F.row_number().over(w)).filter("_place = 1").select("keyword", "gram")
    pairs = index.join(one, "gram").select(F.col(key).alias("_k"), F.col("_row").alias("_r"), "keyword")
    met = rows.join(pairs, rows[key].eqNullSafe(pairs["_k"]) & (rows["_row"] == pairs["_r"]))
    return met.filter(F.contains("text", "keyword")).select(key, "keyword")


def keyword_hits(docs: DataFrame, table: DataFrame, key: str = "doc_id", text_col: str = "text", keyword_col: str = "keyword", most_bytes: int = MOST_BYTES) -> DataFrame:
    """key and keyword for every keyword of the table that a text contains. Equal rows are reported once."""
    words = _keywords(table, keyword_col)
    texts = docs.select(F.col(text_col).cast("string").alias("text"), key).filter("text is not null")
    of = F.collect_set(F.least(F.length("keyword"), F.lit(GRAM)))
    size, n, sizes = words.agg(F.coalesce(F.sum(F.octet_length("keyword")), F.lit(0)), F.count("*"), of).head()
    if size <= most_bytes and n <= MOST_KEYWORDS:
        return _by_automaton(texts, words, key).distinct()
    return _by_grams(texts, words, key, sorted(sizes) or [GRAM], size <= SMALL_BYTES).distinct()


def keyword_scores(docs: DataFrame, table: DataFrame, key: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """key, domain, hits and score for each domain of table(domain, keyword) that a text has keywords of: distinct
    keywords in the lower-cased text, against a tenth of the domain's list (at least one); at most 1. A keyword with
    an upper-case letter can't match, but counts in its list's length."""
    lists = table.select("domain", "keyword").filter("domain is not null and keyword is not null").distinct()
    sizes = lists.groupBy("domain").agg(F.count("*").alias("_size"))
    low = docs.select(key, F.lower(F.col(text_col)).alias("text"))
    found = keyword_hits(low, lists, key, "text", "keyword", most_bytes)
    hits = found.join(lists, "keyword").groupBy(key, "domain").agg(F.count("*").alias("hits"))
    score = F.least(F.lit(1.0), F.col("hits").cast("double") / F.greatest(F.lit(1.0), F.col("_size") * F.lit(0.1)))
    return hits.join(sizes, "domain").select(key, "domain", "hits", score.alias("score"))


def domain_table(spark) -> DataFrame:
    """The built-in lists as a table: domain, keyword."""
    return spark.createDataFrame([(d, w) for d in DOMAINS for w in DOMAIN_KEYWORDS[d]], "domain string, keyword string")
