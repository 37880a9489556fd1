"""Text profile of a document as Column expressions: language, counters, domain, difficulty.

Every builder maps columns to a column, so the same code serves batch, SQL and streaming frames; a whole
profile is one projection without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions.domains import DOMAIN_KEYWORDS, DOMAINS

CJK = "一-鿿"


# counted by what is left without the rest: regexp_count() makes an array with a string for every character
def cjk_count(t: Column) -> Column:
    return F.length(F.regexp_replace(t, f"[^{CJK}]+", "")).cast("long")


def letter_count(t: Column) -> Column:
    return F.length(F.regexp_replace(t, "[^a-zA-Z]+", "")).cast("long")


def language(cn: Column, en: Column) -> Column:
    """unknown without letters; zh above 0.7 of Chinese characters, en below 0.3, else mixed."""
    ratio = F.try_divide(cn.cast("double"), (cn + en).cast("double"))
    return F.when(cn + en == 0, "unknown").when(ratio > F.lit(0.7), "zh").when(ratio < F.lit(0.3), "en").otherwise("mixed")


def chars_no_space(t: Column) -> Column:
    """Characters but U+0020 and line feeds; tabs and other spaces count."""
    return F.length(F.replace(F.replace(t, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))).cast("long")


def paragraphs(t: Column) -> Column:
    """Blocks between blank lines that hold anything but white space."""
    return F.size(F.filter(F.split(t, r"(?U)\n\s*\n", -1), lambda p: p.rlike(r"(?U)\S"))).cast("long")


def sentences(t: Column, lang: Column) -> Column:
    """Each full-width end mark in Chinese, runs of ASCII end marks elsewhere."""
    return F.when(lang == "zh", F.regexp_count(t, F.lit("[。？！；]"))).otherwise(F.regexp_count(t, F.lit("[.!?]+"))).cast("long")


def chinese_words(cn: Column) -> Column:
    """One word per 1.5 characters, at least one even without any."""
    return F.greatest(F.lit(1), (cn / F.lit(1.5)).cast("int")).cast("long")


def english_words(t: Column) -> Column:
    return F.regexp_count(t, F.lit("[a-zA-Z]+")).cast("long")


def domain_score(low: Column, domain: str, cn: Column) -> Column:
    """Distinct keywords found as substrings, against a tenth of the list's length; at most 1. Chinese keywords are
    sought only in texts with Chinese characters, of which cn is the number."""
    words = DOMAIN_KEYWORDS[domain]

    def found(some: list[str]) -> Column:
        return sum((F.contains(low, F.lit(w)).cast("int") for w in some), F.lit(0))

    chinese = [w for w in words if re.search(f"[{CJK}]", w)]
    hits = found([w for w in words if w not in chinese]) + F.when(cn > 0, found(chinese)).otherwise(0)
    return F.least(F.lit(1.0), hits.cast("double") / F.lit(max(1, len(words) * 0.1)).cast("double"))


def best_domain(scores: dict[str, Column]) -> Column:
    """The highest score, the first declared on ties; general below 0.1."""
    top = F.greatest(*scores.values())
    out = F.when(top < F.lit(0.1), "general")
    for d, s in scores.items():
        out = out.when(s == top, d)
    return out


def difficulty(no_space: Column, n_sentences: Column, lang: Column, domain: Column, n_words: Column) -> Column:
    avg = F.try_divide(no_space.cast("double"), n_sentences.cast("double"))
    points = F.when(avg > 80, 2).when(avg > 50, 1).otherwise(0)
    points = points + F.when(lang == "mixed", 1).otherwise(0) + F.when(domain.isin("general", ""), 0).otherwise(1)
    points = points + F.when(n_words > 5000, 2).when(n_words > 1000, 1).otherwise(0)
    return F.when(points >= 4, "hard").when(points >= 2, "medium").otherwise("easy")


def guess_language(word: Column) -> Column:
    """zh if the word has a Chinese character, else en."""
    return F.when(word.rlike(f"[{CJK}]"), "zh").otherwise("en")


COUNTERS = ["lang", "chars_total", "chars_no_space", "words_cn", "words_en", "paragraphs", "sentences"]


def analyze(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with lang, the counters, domain, domain_scores (map) and difficulty. A null text counts as empty."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.withColumn("_cn", cjk_count(t)).withColumn("_en", letter_count(t)).withColumn("_low", F.lower(t))
    scores = {d: F.col(f"_s_{d}") for d in DOMAINS}
    step = step.withColumns({f"_s_{d}": domain_score(F.col("_low"), d, F.col("_cn")) for d in DOMAINS})
    step = step.withColumn("lang", language(F.col("_cn"), F.col("_en")))
    step = step.withColumns({
        "chars_total": F.length(t).cast("long"), "chars_no_space": chars_no_space(t), "words_cn": chinese_words(F.col("_cn")),
        "words_en": english_words(t), "paragraphs": paragraphs(t), "sentences": sentences(t, F.col("lang")),
        "domain": best_domain(scores), "domain_scores": F.create_map(*[x for d in DOMAINS for x in (F.lit(d), scores[d])]),
    })
    step = step.withColumn("difficulty", difficulty(F.col("chars_no_space"), F.col("sentences"), F.col("lang"), F.col("domain"), F.col("words_cn") + F.col("words_en")))
    return step.drop("_cn", "_en", "_low", *[f"_s_{d}" for d in DOMAINS])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: doc_id (its path) and text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def summary(row) -> str:
    """Seven lines on one analyzed row."""
    return "\n".join([
        f"Language: {row['lang']}",
        f"Characters: {row['chars_total']} (no spaces: {row['chars_no_space']})",
        f"Words (estimated): {row['words_cn'] + row['words_en']} (CN: {row['words_cn']}, EN: {row['words_en']})",
        f"Paragraphs: {row['paragraphs']}",
        f"Sentences: {row['sentences']}",
        f"Domain: {row['domain']}",
        f"Difficulty: {row['difficulty']}",
    ])


def summary_text() -> Column:
    """summary() of an analyzed row as a column."""
    lines = [
        F.concat(F.lit("Language: "), "lang"),
        F.concat(F.lit("Characters: "), F.col("chars_total").cast("string"), F.lit(" (no spaces: "), F.col("chars_no_space").cast("string"), F.lit(")")),
        F.concat(F.lit("Words (estimated): "), (F.col("words_cn") + F.col("words_en")).cast("string"), F.lit(" (CN: "), F.col("words_cn").cast("string"), F.lit(", EN: "), F.col("words_en").cast("string"), F.lit(")")),
        F.concat(F.lit("Paragraphs: "), F.col("paragraphs").cast("string")),
        F.concat(F.lit("Sentences: "), F.col("sentences").cast("string")),
        F.concat(F.lit("Domain: "), "domain"),
        F.concat(F.lit("Difficulty: "), "difficulty"),
    ]
    return F.concat_ws("\n", *lines)


def register_functions(spark: SparkSession) -> None:
    """SQL functions detect_language(text), count_paragraphs(text), chinese_words(text) and guess_language(word)."""
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION detect_language(t STRING) RETURNS STRING RETURN
        CASE WHEN regexp_count(t, '[{CJK}a-zA-Z]') = 0 THEN 'unknown'
             WHEN regexp_count(t, '[{CJK}]') / regexp_count(t, '[{CJK}a-zA-Z]') > 0.7D THEN 'zh'
             WHEN regexp_count(t, '[{CJK}]') / regexp_count(t, '[{CJK}a-zA-Z]') < 0.3D THEN 'en' ELSE 'mixed' END""")
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION count_paragraphs(t STRING) RETURNS BIGINT RETURN
        size(filter(split(t, '(?U)\\n\\s*\\n', -1), p -> p rlike '(?U)\\S'))""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION chinese_words(t STRING) RETURNS BIGINT RETURN
        greatest(1, cast(regexp_count(t, '[{CJK}]') / 1.5D AS INT))""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION guess_language(w STRING) RETURNS STRING RETURN
        CASE WHEN w rlike '[{CJK}]' THEN 'zh' ELSE 'en' END""")
