"""Words of a corpus without a dictionary: character sequences that hold together and stand in many surroundings.

A sequence is a word when its characters come together more often than by chance (pointwise mutual information over
its weakest cut) and when what stands before and after it varies (entropy of its neighbours on either side). Runs of
the wanted characters are counted first, so a run that occurs a million times is taken apart once; what is shuffled
after it are partial counts by gram and neighbours. A gram's neighbours are as many as there are characters at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import CJK

#: Characters between which no word crosses are all but these.
CHINESE = f"[{CJK}]+"


def runs(docs: DataFrame, pattern: str, text: Column) -> DataFrame:
    """Distinct runs of the pattern and how often they occur."""
    each = docs.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), 0)).alias("run"))
    return each.groupBy("run").agg(F.count("*").alias("times"))


def gram_neighbours(found: DataFrame, longest: int) -> DataFrame:
    """gram, left and right (empty at a run's border) and their count, for grams of up to longest characters."""

    def of_size(n: int) -> Column:
        at = F.when(F.length("run") >= n, F.sequence(F.lit(1), F.length("run") - (n - 1))).otherwise(F.array().cast("array<int>"))
        left = lambda i: F.when(i > 1, F.substring("run", i - 1, F.lit(1))).otherwise("")
        return F.transform(at, lambda i: F.struct(F.substring(F.col("run"), i, F.lit(n)).alias("gram"), left(i).alias("left"), F.substring(F.col("run"), i + n, F.lit(1)).alias("right")))

    each = found.select("times", F.explode(F.concat(*[of_size(n) for n in range(1, longest + 1)])).alias("g"))
    return each.groupBy("g.gram", "g.left", "g.right").agg(F.sum("times").alias("n"))


def _entropy(counts: DataFrame, side: str) -> DataFrame:
    """Natural entropy of a gram's neighbours on one side."""
    by = counts.groupBy("gram", side).agg(F.sum("n").alias("n"))
    total = F.sum("n")
    h = F.log(total.cast("double")) - F.sum(F.col("n") * F.log(F.col("n").cast("double"))) / total
    return by.groupBy("gram").agg(h.alias(f"{side}_entropy"))


def new_words(docs: DataFrame, longest: int = 4, min_count: int = 5, min_pmi: float = 1.0, min_entropy: float = 0.5, pattern: str = CHINESE, text: Column | None = None) -> DataFrame:
    """word, frequency, pmi, left_entropy, right_entropy and score (pmi plus the smaller entropy) of the sequences of 2
    to longest characters that occur min_count times and pass both thresholds. A null text has none."""
    counts = gram_neighbours(runs(docs, pattern, F.col("text") if text is None else text), longest)
    totals = counts.groupBy(F.length("gram").alias("size")).agg(F.sum("n").alias("total"))  # a row for each size
    # parts of a frequent gram are as frequent, so the others can go
    grams = counts.groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    share = grams.join(F.broadcast(totals), F.length("gram") == F.col("size")).select("gram", "n", (F.col("n") / F.col("total")).alias("p"))
    long = share.filter(F.length("gram") > 1)
    cuts = F.transform(F.sequence(F.lit(1), F.length("gram") - 1), lambda k: F.struct(F.expr("gram").substr(F.lit(1), k).alias("a"), F.expr("gram").substr(k + 1, F.length("gram")).alias("b")))
    cut = long.select("gram", "p", F.explode(cuts).alias("c")).select("gram", "p", "c.a", "c.b")
    part = share.select(F.col("gram").alias("a"), F.col("p").alias("pa"))
    other = share.select(F.col("gram").alias("b"), F.col("p").alias("pb"))
    pmi = cut.join(part, "a").join(other, "b").groupBy("gram").agg(F.min(F.log(F.col("p") / (F.col("pa") * F.col("pb")))).alias("pmi"))
    held = pmi.filter(F.col("pmi") >= min_pmi)
    around = counts.join(held.select("gram"), "gram", "left_semi")
    out = held.join(long, "gram").join(_entropy(around, "left"), "gram").join(_entropy(around, "right"), "gram")
    least = F.least("left_entropy", "right_entropy")
    return out.filter(least >= min_entropy).select(F.col("gram").alias("word"), F.col("n").alias("frequency"), "pmi", "left_entropy", "right_entropy", (F.col("pmi") + least).alias("score"))


def match_words(docs: DataFrame, words: DataFrame, top_n: int = 30) -> DataFrame:
    """Keywords of each document among words(word, score): doc_id, term, frequency, score (times the word's own), place."""
    from lexforge.operators.keywords import keyword_hits

    hits = keyword_hits(docs, words.select(F.col("word").alias("keyword")))
    with_text = hits.join(docs.select("doc_id", "text"), "doc_id").join(words.select(F.col("word").alias("keyword"), F.col("score").alias("own")), "keyword")
    times = ((F.length("text") - F.length(F.replace("text", "keyword", F.lit("")))) / F.length("keyword")).cast("long")
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy(F.round("score", 9).desc(), "term")
    scored = with_text.select("doc_id", F.col("keyword").alias("term"), times.alias("frequency"), (times * F.col("own")).alias("score"))
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top_n)
