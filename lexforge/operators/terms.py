"""Term extraction over a document collection: character n-grams, proper nouns, keywords, merge and rank.

Texts are shuffled by doc_id before they are exploded, so that grams are counted, summed up and ranked where they arise
and never travel. Every top-k has a total order, so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.text import CJK

PHRASE = r"(?U)\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"
IDENTIFIER = r"(?U)\b(?:[A-Z][a-z]+){2,}\b|\b[A-Z][a-zA-Z]*[a-z][A-Z][a-zA-Z]*\b"
ACRONYM = r"(?U)\b([A-Z]{2,5})\b"
#: Characters of the parts that texts are cut into for grams.
PART = 200
#: English words that the corpus strategy passes over.
STOPWORDS = "a an and are as at be by for from has have in is it its of on or that the this to was were will with".split()


def cjk_only(t: Column) -> Column:
    return F.regexp_replace(t, f"[^{CJK}]+", "")


def by_document(docs: DataFrame) -> DataFrame:
    """doc_id and text, the rows of a document in one partition. Their number is given, as adaptive execution would
    choose it by the size of the texts, of which each character becomes several rows."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.select("doc_id", "text").repartition(parts, "doc_id")


def grams(docs: DataFrame, sizes: list[int], chars: Column) -> DataFrame:
    """doc_id, n, gram, frequency, first_pos and total (of all grams of that n in the document)."""
    c = by_document(docs).select("doc_id", chars.alias("c"))
    whole = Window.partitionBy("doc_id")
    c = c.select("doc_id", "c", *[F.sum(F.greatest(F.lit(0), F.length("c") - (n - 1))).over(whole).alias(f"total_{n}") for n in sizes])
    # cut first, with what the grams reach over: a place costs the same anywhere in a text
    cut = f"(?s)(?=(.{{1,{PART + max(sizes) - 1}}})).{{1,{PART}}}"
    c = c.select("*", F.posexplode(F.regexp_extract_all("c", F.lit(cut), 1)).alias("k", "s"))
    parts = [F.expr(f"transform(case when length(s) >= {n} then sequence(1, least({PART}, length(s) - {n - 1})) else cast(array() as array<int>) end, i -> struct({n} as n, substring(s, i, {n}) as gram, k * {PART} + i as pos, total_{n} as total))") for n in sizes]
    rows = c.select("doc_id", F.explode(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("g"))
    return rows.groupBy("doc_id", "g.n", "g.gram").agg(F.count("*").alias("frequency"), F.min("g.pos").alias("first_pos"), F.max("g.total").alias("total"))


def _ranked(g: DataFrame, top_n: int) -> DataFrame:
    w = Window.partitionBy("doc_id", "n").orderBy(F.col("frequency").desc(), "first_pos")
    return g.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top_n)


def top_ngrams(docs: DataFrame, top_n: int = 30, sizes: tuple[int, ...] = (3, 4, 5), chars: Column | None = None) -> DataFrame:
    """The most frequent grams of each size that occur at least twice, weighted by length."""
    g = _ranked(grams(docs, list(sizes), cjk_only(F.col("text")) if chars is None else chars).filter("frequency >= 2"), top_n)
    score = (F.col("frequency") / F.col("total")) * (F.col("n") * F.lit(0.3))
    return g.select("doc_id", F.col("gram").alias("term"), "frequency", score.alias("score"), F.lit("ngram").alias("word_type"), F.col("n").cast("long").alias("n"), F.col("place").cast("long").alias("place"))


def top_bigrams(docs: DataFrame, top_n: int = 30, chars: Column | None = None) -> DataFrame:
    g = _ranked(grams(docs, [2], cjk_only(F.col("text")) if chars is None else chars), top_n)
    return g.select("doc_id", F.col("gram").alias("term"), "frequency", (F.col("frequency") / F.col("total")).alias("score"), F.lit("bigram").alias("word_type"), F.col("n").cast("long").alias("n"), F.col("place").cast("long").alias("place"))


def phrases(t: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(t, F.lit(PHRASE), 1))


def identifiers(t: Column) -> Column:
    return F.filter(F.array_distinct(F.regexp_extract_all(t, F.lit(IDENTIFIER), 0)), lambda x: F.length(x) > 4)


def acronyms(t: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(t, F.lit(ACRONYM), 1))


def proper_nouns(docs: DataFrame) -> DataFrame:
    """doc_id, term, kind (0 phrase, 1 identifier, 2 acronym): each kind's distinct finds."""
    t = F.col("text")

    def of(kind: int, found: Column) -> Column:
        return F.transform(found, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("term")))

    each = F.concat(of(0, phrases(t)), of(1, identifiers(t)), of(2, acronyms(t)))
    return docs.select("doc_id", F.explode(each).alias("p")).select("doc_id", "p.term", "p.kind")


def token_array(t: Column) -> Column:
    """Lower-case letter runs that are no stop words, and Chinese bigrams."""
    c = cjk_only(t)
    pairs = F.when(F.length(c) >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 1)), lambda i: F.substring(c, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    words = F.filter(F.regexp_extract_all(F.lower(t), F.lit("[a-z]+"), 0), lambda w: (F.length(w) >= 2) & ~w.isin(STOPWORDS))
    return F.concat(words, pairs)


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id and token, one row for each occurrence."""
    return docs.select("doc_id", F.explode(token_array(F.col("text"))).alias("token"))


def tfidf_keywords(docs: DataFrame, top_n: int = 30) -> DataFrame:
    """Term frequency by inverse document frequency over the collection, ln((N + 1) / (df + 1)) + 1. N is counted at
    once. A common token's rows are many, but equally long and independent, so adaptive execution can split them."""
    n = docs.count()
    tf = tokens(by_document(docs)).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))
    # both sides read one shuffle of texts, which are smaller than their counted tokens, and tell the tokens again
    df = tf.groupBy("token").agg(F.sum(F.when(F.col("tf") > 0, 1).otherwise(0)).alias("df"))
    s = tf.join(df, "token").withColumn("size", F.sum("tf").over(Window.partitionBy("doc_id")))
    s = s.withColumn("score", F.col("tf") / F.col("size") * (F.log(F.lit(n + 1) / (F.col("df") + 1)) + 1))
    # equal scores may differ in their last digits
    w = Window.partitionBy("doc_id").orderBy(F.round("score", 9).desc(), "token")
    best = s.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top_n)
    return best.select("doc_id", F.col("token").alias("term"), "tf", "score", "place")


def segmenter_keywords(docs: DataFrame, top_n: int = 30) -> DataFrame:
    """Keywords by an installed Chinese segmenter; raises ImportError without one."""
    import jieba.analyse  # noqa: F401

    def run(batches):
        import jieba.analyse as ja
        import pandas as pd

        for b in batches:
            rows = [(d, w, float(s), k) for d, t in zip(b["doc_id"], b["text"], strict=True) for k, (w, s) in enumerate(ja.extract_tags(t or "", topK=top_n, withWeight=True), 1) if len(w) >= 2]
            yield pd.DataFrame(rows, columns=["doc_id", "term", "score", "place"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, term string, score double, place int")


def candidates(docs: DataFrame, top_n: int = 30, strategy: str = "bigram") -> DataFrame:
    """All contributors before merging, with ord: keywords, then grams, then proper nouns."""
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if strategy == "bigram":
        first = top_bigrams(src, top_n).select("doc_id", "term", "frequency", "score", "word_type", (F.col("place")).cast("long").alias("ord"))
    elif strategy == "tfidf":
        first = tfidf_keywords(src, top_n).select("doc_id", "term", F.lit(1).cast("long").alias("frequency"), "score", F.lit("keyword").alias("word_type"), F.col("place").cast("long").alias("ord"))
    elif strategy == "newwords":
        from lexforge.operators.newwords import match_words, new_words

        own = match_words(src, new_words(src), top_n)
        first = own.select("doc_id", "term", "frequency", "score", F.lit("keyword").alias("word_type"), F.col("place").cast("long").alias("ord"))
    elif strategy == "segmenter":
        first = segmenter_keywords(src, top_n).select("doc_id", "term", F.lit(1).cast("long").alias("frequency"), "score", F.lit("keyword").alias("word_type"), F.col("place").cast("long").alias("ord"))
    else:
        raise ValueError(f"unknown keyword strategy: {strategy}")
    second = top_ngrams(src, top_n).select("doc_id", "term", "frequency", "score", "word_type", (F.col("n") * 1_000_000 + F.col("place")).cast("long").alias("ord"))
    third = proper_nouns(src).select("doc_id", "term", F.lit(1).cast("long").alias("frequency"), F.lit(0.0).alias("score"), F.lit("proper_noun").alias("word_type"), (F.lit(10_000_000) + F.col("kind")).cast("long").alias("ord"))
    return first.unionByName(second).unionByName(third)


def merge_and_rank(found: DataFrame, top_n: int = 30) -> DataFrame:
    """Contributors with one lower-cased term become one: scores and frequencies add up, spelling and type are
    the first contributor's. Ranked by score, then first contributor, then term."""
    one = F.struct("ord", "term", "word_type", "score", "frequency")
    g = found.groupBy("doc_id", F.lower("term").alias("key")).agg(F.sort_array(F.collect_list(one)).alias("p"))
    g = g.select("doc_id", F.expr("p[0].term").alias("term"), F.expr("aggregate(p, 0L, (a, x) -> a + x.frequency)").alias("frequency"), F.expr("aggregate(p, 0D, (a, x) -> a + x.score)").alias("score"), F.expr("p[0].word_type").alias("word_type"), F.expr("p[0].ord").alias("ord"))
    w = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "ord", "term")
    return g.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top_n).drop("ord")


def extract(docs: DataFrame, top_n: int = 30, strategy: str = "bigram") -> DataFrame:
    """doc_id, term, frequency, score, word_type, rank: the best top_n terms of every document."""
    return merge_and_rank(candidates(docs, top_n, strategy), top_n)


def terms_by_type(ranked: DataFrame, most: int = 10) -> DataFrame:
    """Per document and type, in order of first appearance, the first terms of the type."""
    g = ranked.groupBy("doc_id", "word_type").agg(F.min("rank").alias("first_rank"), F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("p"))
    return g.select("doc_id", "word_type", "first_rank", F.expr(f"array_join(transform(slice(p, 1, {most}), x -> x.term), ', ')").alias("terms"))


def frequency_table(rows) -> str:
    """Fixed-width table of collected terms."""
    lines = [f"{'Term':<20} {'Freq':>6} {'Score':>8} {'Type':>12}", "-" * 50]
    return "\n".join(lines + [f"{r['term']:<20} {r['frequency']:>6} {r['score']:>8.4f} {r['word_type']:>12}" for r in rows])
