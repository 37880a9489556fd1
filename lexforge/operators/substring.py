"""Many substring searches at once: a gram index over words, joined on each pattern's rarest gram, then verified.

A single search is a scan (operators/termbase.like). For many patterns that would be patterns times words. Here every
distinct word is indexed by its grams of up to GRAM characters, each pattern is asked under one gram only, that which
fewest words have, and the pairs that meet there are verified by the same LIKE rule: ASCII case is folded, % and _ are
wildcards, a backslash is itself. A match holds all stretches of the pattern between wildcards, so all their grams;
no match is lost. Patterns whose stretches are shorter than GRAM are asked under a shorter gram. Patterns of
wildcards alone match by length; they are asked under the empty gram, which words have in SLOTS parts, so no part is
hot. Equal patterns, and equal words, are joined once and multiplied after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3
SLOTS = 64

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(col: Column) -> Column:
    return F.translate(col, _UP, _LOW)


def grams(col: Column, n: int) -> Column:
    """The distinct stretches of n characters of a string."""
    last = F.length(col) - (n - 1)
    at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(col, i, F.lit(n))))


def word_index(words: DataFrame) -> DataFrame:
    """gram and folded word of words(folded): all grams of up to GRAM characters, and the empty one with a slot."""
    every = F.concat(*[grams(F.col("folded"), n) for n in range(1, GRAM + 1)])
    slot = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("folded"), F.lit(SLOTS)).cast("string"))
    return words.select("folded", F.explode(F.concat(every, F.array(slot))).alias("gram"))


def pattern_grams(patterns: DataFrame) -> DataFrame:
    """pattern and gram of patterns(folded): the grams of its longest stretches, of GRAM characters if there are some."""
    parts = F.split(F.col("folded"), "[%_]+", -1)
    longest = F.array_max(F.transform(parts, F.length))

    def of_size(n: int) -> Column:
        return F.flatten(F.transform(parts, lambda p: grams(p, n)))

    of = F.when(longest >= GRAM, of_size(GRAM))
    for n in range(GRAM - 1, 0, -1):
        of = of.when(longest == n, of_size(n))
    slots = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.concat(F.lit("\x00"), i.cast("string")))
    return patterns.select(F.col("folded").alias("pattern"), (longest == 0).alias("every"), F.explode(F.array_distinct(of.otherwise(slots))).alias("gram"))


def matches(words: DataFrame, patterns: DataFrame) -> DataFrame:
    """The distinct pairs (pattern, folded) of patterns(folded) and words(folded) that match."""
    index = word_index(words)
    asked = pattern_grams(patterns)
    # how many words have each gram that is asked for; none: the pattern has no match
    held = index.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    best = Window.partitionBy("pattern").orderBy("n", "gram")
    known = asked.join(held, "gram")
    whole = F.size(F.collect_set("gram").over(Window.partitionBy("pattern")))
    asks = asked.groupBy("pattern").agg(F.count("*").alias("asks"))
    one = known.withColumn("place", F.row_number().over(best)).withColumn("met", whole).join(asks, "pattern")
    # a pattern one of whose grams no word has can't match; of wildcards alone, each slot is asked
    one = one.filter("every or (place = 1 and met = asks)").select("pattern", "gram")
    pairs = index.join(one, "gram")
    wild = F.col("pattern").contains("%") | F.col("pattern").contains("_")
    like = F.expr(r"folded like concat('%', replace(pattern, '\\', '\\\\'), '%')")
    return pairs.filter(F.when(wild, like).otherwise(F.contains("folded", "pattern"))).select("pattern", "folded")


def search_many(rows: DataFrame, column: str, patterns: DataFrame, pattern_col: str = "pattern") -> DataFrame:
    """rows with the distinct patterns that their column matches: a row for each. Null texts and patterns match nothing."""
    p = patterns.select(F.col(pattern_col).alias("pattern")).filter("pattern is not null").distinct().withColumn("folded", fold(F.col("pattern")))
    r = rows.filter(F.col(column).isNotNull()).withColumn("_folded", fold(F.col(column)))
    pairs = matches(r.select(F.col("_folded").alias("folded")).distinct(), p.select("folded").distinct())
    named = pairs.withColumnRenamed("pattern", "_of").join(p.withColumnRenamed("folded", "_of"), "_of").select("pattern", F.col("folded").alias("_folded"))
    return r.join(named, "_folded").drop("_folded")


def search_terms_many(terms: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """For each distinct query of queries(query) the terms whose word, translation or domain matches, last updated
    first: query, place and the term's columns."""
    cells = terms.select("id", F.explode(F.array("word", "translation", "domain")).alias("_cell")).filter("_cell is not null").distinct()
    hit = search_many(cells, "_cell", queries, "query").select(F.col("pattern").alias("query"), F.col("id").alias("_id")).distinct()
    w = Window.partitionBy("query").orderBy(F.col("updated_at").desc(), F.col("id").desc())
    found = hit.join(terms, hit["_id"] == terms["id"]).drop("_id")
    return found.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= limit)


def search_associations_many(terms: DataFrame, associations: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """For each distinct query of queries(query) the words related to the terms that match, best first: query, word,
    type, source, score, place."""
    hit = search_many(terms.select("id", "word"), "word", queries, "query").select(F.col("pattern").alias("query"), F.col("id").alias("term_id"))
    order = F.col("score").desc(), "word", "type", "source"
    # what isn't among a term's best can't be among a query's: a term's rows are cut before they are repeated for each query
    own = Window.partitionBy("term_id").orderBy(*order)
    rows = associations.filter("term_id is not null").select("term_id", F.col("related_word").alias("word"), F.col("relation_type").alias("type"), "source", "score")
    rows = rows.repartition("term_id")  # or tasks would sort all that they read before it is dealt out
    rows = rows.withColumn("place", F.row_number().over(own)).filter(F.col("place") <= limit).drop("place")
    rows = rows.join(hit, "term_id").select("query", "word", "type", "source", "score")
    w = Window.partitionBy("query").orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= limit)
