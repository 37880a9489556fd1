"""Profiles of texts that are too large for one row, from the states of their pieces.

A piece's state holds what the profile needs of it and what depends on its borders: whether it begins and ends within
a word or a run of end marks, the line feeds of the white space at its ends, its first and last characters (a
keyword may lie across borders). Two neighbouring states make the state of both together, by an operation that is
associative, so pieces are merged in a tree: groups of FAN_IN neighbours at a time, each group's states in order. The
result is the profile of the whole text, wherever it was cut.

read_pieces() reads files line by line, in parallel also within a file; no file is ever one row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import text as tx
from lexforge.functions.domains import DOMAIN_KEYWORDS, DOMAINS

FAN_IN = 1000
#: Characters at either end that a keyword across a border may reach into.
EDGE = max(len(w) for ws in DOMAIN_KEYWORDS.values() for w in ws) - 1

_SUMS = ("bytes", "cn", "en", "chars", "dense", "zh_marks")
_HITS = tuple(f"hits_{d}" for d in DOMAINS)
_STATE = (*_SUMS, "words", "word_first", "word_last", "marks", "mark_first", "mark_last", "has", "starts", "lead", "trail", "head", "tail", *_HITS)


def keyword_bits(low: Column, domain: str) -> Column:
    """The domain's keywords found in a lower-cased text, a bit for each; Chinese ones are sought only where there is
    a Chinese character."""
    bits = {w: F.when(F.contains(low, F.lit(w)), F.lit(1 << k)).otherwise(0) for k, w in enumerate(DOMAIN_KEYWORDS[domain])}
    chinese = [b for w, b in bits.items() if re.search(f"[{tx.CJK}]", w)]
    others = [b for w, b in bits.items() if not re.search(f"[{tx.CJK}]", w)]
    return (sum(others, F.lit(0)) + F.when(low.rlike(f"[{tx.CJK}]"), sum(chinese, F.lit(0))).otherwise(0)).cast("long")


def piece_state(t: Column) -> Column:
    """The state of a piece of text with at least one character."""
    low = F.lower(t)
    blank = ~t.rlike(r"(?U)\S")
    lines = F.contains(t, F.lit("\n"))  # most pieces have no line feed, so no blank lines either
    feeds = lambda s: F.length(F.regexp_extract(s, r"^((?U)\s*)", 1)) - F.length(F.translate(F.regexp_extract(s, r"^((?U)\s*)", 1), "\n", ""))
    fields = {
        "bytes": F.octet_length(t).cast("long"),
        "cn": tx.cjk_count(t),
        "en": tx.letter_count(t),
        "chars": F.length(t).cast("long"),
        "dense": tx.chars_no_space(t),
        "zh_marks": F.regexp_count(t, F.lit("[。？！；]")).cast("long"),
        "words": tx.english_words(t),
        "word_first": t.rlike("^[a-zA-Z]"),
        "word_last": F.substring(t, -1, 1).rlike("[a-zA-Z]"),
        "marks": F.regexp_count(t, F.lit("[.!?]+")).cast("long"),
        "mark_first": t.rlike("^[.!?]"),
        "mark_last": F.substring(t, -1, 1).rlike("[.!?]"),
        "has": ~blank,
        "starts": F.when(blank | ~lines, F.lit(0)).otherwise(tx.paragraphs(t) - 1).cast("long"),
        "lead": F.when(lines, feeds(t)).otherwise(0).cast("long"),
        "trail": F.when(blank | ~lines, F.lit(0)).otherwise(feeds(F.reverse(t))).cast("long"),
        "head": F.substring(low, 1, EDGE),
        "tail": F.right(low, F.lit(EDGE)),
        **{h: keyword_bits(low, d) for h, d in zip(_HITS, DOMAINS, strict=True)},
    }
    return F.struct(*[fields[n].alias(n) for n in _STATE])


def joined(a: Column, b: Column) -> Column:
    """The state of two neighbouring pieces together; a null one is no text."""
    border = F.concat(a["tail"], b["head"])
    apart = F.endswith(a["tail"], F.lit(" ")) | F.startswith(b["head"], F.lit(" "))  # no keyword has a space
    fields = {s: a[s] + b[s] for s in _SUMS}
    fields |= {
        "words": a["words"] + b["words"] - (a["word_last"] & b["word_first"]).cast("long"),
        "word_first": a["word_first"],
        "word_last": b["word_last"],
        "marks": a["marks"] + b["marks"] - (a["mark_last"] & b["mark_first"]).cast("long"),
        "mark_first": a["mark_first"],
        "mark_last": b["mark_last"],
        "has": a["has"] | b["has"],
        "starts": a["starts"] + b["starts"] + F.when(a["has"] & b["has"] & (a["trail"] + b["lead"] >= 2), 1).otherwise(0),
        "lead": F.when(a["has"], a["lead"]).otherwise(a["lead"] + b["lead"]),
        "trail": F.when(b["has"], b["trail"]).when(a["has"], a["trail"] + b["lead"]).otherwise(0).cast("long"),
        "head": F.substring(F.concat(a["head"], b["head"]), 1, EDGE),
        "tail": F.right(F.concat(a["tail"], b["tail"]), F.lit(EDGE)),
        # most borders hold no keyword, and all that were found in either piece stay
        **{h: a[h].bitwiseOR(b[h]).bitwiseOR(F.when(apart, 0).otherwise(keyword_bits(border, d)).cast("long")) for h, d in zip(_HITS, DOMAINS, strict=True)},
    }
    both = F.struct(*[fields[n].cast(_TYPES[n]).alias(n) for n in _STATE])
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


_TYPES = {n: "boolean" if n in ("word_first", "word_last", "mark_first", "mark_last", "has") else "string" if n in ("head", "tail") else "bigint" for n in _STATE}
_NONE = "cast(null as struct<" + ", ".join(f"{n}: {_TYPES[n]}" for n in _STATE) + ">)"


def merge_states(states: DataFrame, key: str = "doc_id", fan_in: int = FAN_IN) -> DataFrame:
    """key and the state of each whole text, of states(key, block, place, state): pieces are in order of block, then
    place. Neighbouring places of a block meet first, then what is left of the blocks."""

    def merged(df: DataFrame, *by: Column) -> DataFrame:
        """In each group the states in order, as one; the group stands where its first piece did."""
        one = F.struct("block", "place", "state")
        got = df.groupBy(key, *by).agg(F.sort_array(F.collect_list(one)).alias("p"))
        whole = F.aggregate("p", F.expr(_NONE), lambda a, x: joined(a, x["state"]))
        return got.select(key, F.col("p")[0]["block"].alias("block"), F.col("p")[0]["place"].alias("place"), whole.alias("state"))

    # at most fan_in states in a group, for up to fan_in ** 3 places of a block
    step = states
    for k in (1, 2):
        step = merged(step, F.col("block").alias("_b"), F.floor(F.col("place") / fan_in**k).alias("_g"))
    return merged(step).select(key, "state")


def profile_of(states: DataFrame, key: str = "doc_id") -> DataFrame:
    """The columns of analyze() for whole texts' states; a null state is an empty text."""
    s = {n: F.coalesce(F.col(f"state.{n}"), F.lit("" if _TYPES[n] == "string" else False if _TYPES[n] == "boolean" else 0)) for n in _STATE}
    lang = tx.language(s["cn"], s["en"])
    scores = {}
    for h, d in zip(_HITS, DOMAINS, strict=True):
        scores[d] = F.least(F.lit(1.0), F.bit_count(s[h]).cast("double") / F.lit(max(1, len(DOMAIN_KEYWORDS[d]) * 0.1)).cast("double"))
    counted = states.select(
        key,
        lang.alias("lang"),
        s["chars"].alias("chars_total"),
        s["dense"].alias("chars_no_space"),
        tx.chinese_words(s["cn"]).alias("words_cn"),
        s["words"].alias("words_en"),
        F.when(s["has"], s["starts"] + 1).otherwise(0).cast("long").alias("paragraphs"),
        F.when(lang == "zh", s["zh_marks"]).otherwise(s["marks"]).alias("sentences"),
        tx.best_domain(scores).alias("domain"),
        F.create_map(*[x for d in DOMAINS for x in (F.lit(d), scores[d])]).alias("domain_scores"),
    )
    hard = tx.difficulty(F.col("chars_no_space"), F.col("sentences"), F.col("lang"), F.col("domain"), F.col("words_cn") + F.col("words_en"))
    return counted.withColumn("difficulty", hard)


def analyze_pieces(pieces: DataFrame, key: str = "doc_id", place_col: str = "piece", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """analyze() of texts given as pieces(key, piece, text): pieces in order, from 0, are put together without anything
    between. Null and empty pieces are no text; a key with no others has the profile of an empty text."""
    t = F.col(text_col)
    rows = pieces.select(key, F.lit(0).cast("long").alias("block"), F.col(place_col).cast("long").alias("place"), F.when(F.length(t) > 0, piece_state(t)).alias("state"))
    return profile_of(merge_states(rows, key, fan_in), key)


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files: doc_id (the file), block (where in the file the task began to read), place (a rising number
    within the block), text (with its line feed), size (the file's bytes)."""
    lines = spark.read.option("lineSep", "\n").text(path)
    meta = F.col("_metadata")
    return lines.select(
        meta["file_path"].alias("doc_id"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.concat("value", F.lit("\n")).alias("text"), meta["file_size"].alias("size")
    ).withColumn("place", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))


def analyze_files(spark: SparkSession, path: str, fan_in: int = FAN_IN) -> DataFrame:
    """analyze() of whole files, a row for each, without reading one into one row. A last line without a line feed is
    told by the file's size. A file without any bytes gives no row."""
    lines = read_pieces(spark, path)
    states = lines.select("doc_id", "block", "place", piece_state(F.col("text")).alias("state"))
    sizes = lines.groupBy("doc_id").agg(F.first("size").alias("size"))
    whole = merge_states(states, "doc_id", fan_in).join(sizes, "doc_id")
    extra = F.col("state.bytes") - F.col("size")  # 1 where the last line has no line feed
    exact = F.col("state").withField("chars", F.col("state.chars") - extra)
    return profile_of(whole.select("doc_id", exact.alias("state")))
