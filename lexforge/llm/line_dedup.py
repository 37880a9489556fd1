"""Line dedup by winnowing, in DataFrame functions alone.

A document's lines (split at \\n) are hashed. Of every window of ``run_lines`` consecutive lines the line with the
smallest hash (the first of equal ones) is selected, and only selected lines travel, one row for each, with the
windows that selected them. Two documents that share a run of that many lines select the same line of it, so a
shared run always has a shared fingerprint. Fingerprints that occur at one place only are dropped; the positions
of the others are joined to the earliest position at which the fingerprint extends, up and down, to the same
window (a 128-bit hash of its lines). Matching windows that touch or overlap extend each other to maximal runs,
and the lines of every run that has an earlier equal are deleted. Order is (doc_id, hash of the text, line
number), so a run may also repeat an earlier one of its own document; the first occurrence stays.

With ``long_words``, runs of fewer lines count too if they hold that many words, also in documents of fewer
lines than ``run_lines``, and a run without any word stays. op7_line_dedup and the pipeline's stage ask for it.

Per key the corpus-wide step is a minimum, combined before the shuffle. The minima are written first and joined
from there, so both sides of a join are plain shuffles, which adaptive execution splits where a fingerprint is hot.

Cases: a null text has no lines and stays null; an empty text is one empty line; texts with fewer lines than
a run lose nothing (but see long_words); rows with the same id and text count as one document and get the same result each; an
empty table gives no rows; equal ids with other texts are ordered by their texts' hash; null ids sort first;
further columns of any name stay as they are, and the struct is named dedup with as many underscores after it as
it takes to differ from them (info_name()).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import free_name, materialize, release, table

RUN_LINES = 3
#: For long_words: a passage of so many words is worth deleting whatever its lines.
LONG_WORDS = 50
_WORDS = "size(filter(split(x, '[ \\\\t-\\\\r]+'), y -> y <> ''))"


def fingerprints(docs: DataFrame, run_lines: int, long_words: int | None = None) -> DataFrame:
    """One row per selected line: i (doc_id), t (hash of the text), at, fp (its hash) and w, the windows that
    selected it: at (first line), n (lines), any (has words), k1, k2 (hash of the lines). With long_words also
    those of windows of fewer lines with that many words."""
    src = docs.filter("text is not null").select(F.col("doc_id").alias("i"), F.xxhash64("text").alias("t"), F.split("text", "\n").alias("lines"))
    if long_words is None:
        src = src.filter(F.size("lines") >= run_lines)
    counts = F.expr(f"transform(lines, x -> {_WORDS})") if long_words is not None else F.lit(None).cast("array<int>")
    src = src.select("i", "t", F.expr("transform(lines, x -> xxhash64(x))").alias("h"), F.expr("transform(lines, x -> xxhash64(x, 1))").alias("g"), counts.alias("c"))
    words = lambda n: f"aggregate(slice(c, a + 1, {n}), 0, (s, x) -> s + x)"
    sizes = [run_lines] if long_words is None else list(range(1, run_lines + 1))

    def starts(n: int) -> str:
        every = f"sequence(0, size(h) - {n})"
        return f"case when size(h) >= {n} then {every if n == run_lines else f'filter({every}, a -> {words(n)} >= {long_words})'} else array() end"

    def picked(n: int) -> str:
        """The windows with one selected line are neighbours: from each that selects another than the one before."""
        has = "true" if long_words is None else f"{words(n)} > 0"
        keys = f"transform(slice(a{n}, b + 1, e - b), a -> named_struct('at', a, 'n', {n}, 'any', {has}, 'k1', xxhash64(slice(h, a + 1, {n})), 'k2', xxhash64(slice(g, a + 1, {n}), 2)))"
        return f"zip_with(s{n}, concat(slice(s{n}, 2, greatest(0, size(s{n}) - 1)), array(size(a{n}))), (b, e) -> case when b < e then named_struct('at', get(m{n}, b), 'fp', get(h, get(m{n}, b)), 'w', {keys}) end)"

    src = src.select("*", *[F.expr(starts(n)).alias(f"a{n}") for n in sizes])
    src = src.select("*", *[F.expr(f"transform(a{n}, a -> a + cast(array_position(slice(h, a + 1, {n}), array_min(slice(h, a + 1, {n}))) as int) - 1)").alias(f"m{n}") for n in sizes])
    src = src.select("*", *[F.expr(f"filter(sequence(0, greatest(0, size(m{n}) - 1)), k -> k < size(m{n}) and (k = 0 or get(m{n}, k) <> get(m{n}, k - 1)))").alias(f"s{n}") for n in sizes])
    each = f"filter(concat({', '.join(picked(n) for n in sizes)}), x -> x is not null)"
    return src.select("i", "t", F.explode(F.expr(each)).alias("f")).select("i", "t", "f.*")


def repeated_lines(docs: DataFrame, run_lines: int = RUN_LINES, long_words: int | None = None) -> DataFrame:
    """i, t and runs, the maximal runs (first line, lines) of each document that repeat earlier ones."""
    # identical rows are one document; their windows coincide
    selected = materialize(fingerprints(docs, run_lines, long_words), "lines")
    place = F.struct("i", "t", "at")
    shared = materialize(selected.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("fp"), "shared")
    met = selected.join(shared.hint("merge"), "fp", "left_semi").select("i", "t", F.explode("w").alias("w"))
    left = materialize(met.select("i", "t", "w.*"), "met")
    release(selected)
    release(shared)
    first = materialize(left.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").drop("last"), "first")
    hits = left.join(first.hint("merge"), ["k1", "k2"]).filter(place > F.col("first")).select("i", "t", "at", "n", "any")
    per_doc = hits.groupBy("i", "t").agg(F.collect_set(F.struct("at", "n")).alias("w"), F.collect_set(F.expr("case when any then at end")).alias("worded"))
    per_doc = per_doc.select("i", "t", "worded", F.expr("array_sort(array_distinct(flatten(transform(w, x -> sequence(x.at, x.at + x.n - 1)))))").alias("s"))
    # a run begins at a matching line that the one before doesn't touch, and ends where the next one begins anew
    begin = "filter(s, (x, k) -> k = 0 or get(s, k - 1) < x - 1)"
    end = "filter(s, (x, k) -> k = size(s) - 1 or get(s, k + 1) > x + 1)"
    runs = F.expr(f"zip_with({begin}, {end}, (b, e) -> named_struct('first', b, 'lines', e - b + 1))")
    if long_words is None:
        return per_doc.select("i", "t", runs.alias("runs"))
    per_doc = per_doc.select("i", "t", "worded", runs.alias("runs"))
    per_doc = per_doc.select("i", "t", F.expr("filter(runs, r -> exists(worded, a -> a between r.first and r.first + r.lines - 1))").alias("runs"))
    return per_doc.filter("size(runs) > 0")


def info_name(docs: DataFrame) -> str:
    """The name of the struct that dedup_lines() adds to docs' columns."""
    return free_name(docs, "dedup")


def dedup_lines(docs: DataFrame, run_lines: int = RUN_LINES, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = None) -> DataFrame:
    """docs' rows and columns with text_col shortened, plus a struct (n_lines, n_removed, runs) named info_name()."""
    names, info_col = docs.columns, info_name(docs)
    src = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    runs = materialize(repeated_lines(src, run_lines, long_words), "runs")
    # shuffled at every size: the documents with deletions grow with the input
    both = src.join(runs.hint("merge"), src["doc_id"].eqNullSafe(runs["i"]) & (F.xxhash64(src["text"]) == runs["t"]), "left").drop("i", "t")
    both = both.withColumn("lines", F.split("text", "\n"))
    gone = "flatten(transform(runs, r -> sequence(r.first, r.first + r.lines - 1)))"
    both = both.withColumn("kept", F.expr(f"case when runs is not null then array_except(sequence(0, size(lines) - 1), {gone}) end"))
    cut = F.expr("case when runs is null then text else array_join(transform(kept, k -> get(lines, k)), '\\n') end")
    info = F.struct(
        F.expr("cast(case when text is null then 0 else size(lines) end as bigint)").alias("n_lines"),
        F.expr("cast(case when runs is null then 0 else size(lines) - size(kept) end as bigint)").alias("n_removed"),
        F.expr("coalesce(runs, array())").alias("runs"),
    )
    both = both.select("row", cut.alias("cut"), info.alias("info"))
    return both.select(*[F.col("cut").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names], F.col("info").alias(info_col))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), long_words=LONG_WORDS)
    return out.select("doc_id", F.col("dedup.n_lines"), F.col("dedup.n_removed"), F.size("dedup.runs").cast("long").alias("n_runs"), F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
c AS (SELECT *, len(list_filter(regexp_split_to_array(line, '[ \x09-\x0D]+'), lambda x: x <> '')) AS words FROM l),
w AS (SELECT doc_id, pos, line, words, lead(pos, 1) OVER p AS p1, lead(pos, 2) OVER p AS p2,
        lead(line, 1) OVER p AS l1, lead(line, 2) OVER p AS l2, lead(words, 1) OVER p AS w1, lead(words, 2) OVER p AS w2
      FROM c WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT doc_id, pos, 1 AS n, [line] AS run, words FROM w WHERE words >= 50
      UNION ALL SELECT doc_id, pos, 2, [line, l1], words + w1 FROM w WHERE p1 IS NOT NULL AND words + w1 >= 50
      UNION ALL SELECT doc_id, pos, 3, [line, l1, l2], words + w1 + w2 FROM w WHERE p2 IS NOT NULL),
k AS (SELECT doc_id, pos, n, words, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS nth FROM g),
gone AS (SELECT doc_id, pos + o AS pos, max(words) AS words FROM k, (VALUES (0), (1), (2)) AS v(o) WHERE nth > 1 AND o < n GROUP BY 1, 2),
near AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM gone),
worded AS (SELECT doc_id, pos, max(words) OVER (PARTITION BY doc_id, block) > 0 AS cut FROM near),
flag AS (SELECT l.doc_id, l.pos, l.line, coalesce(worded.cut, false) AS cut FROM l LEFT JOIN worded ON l.doc_id = worded.doc_id AND l.pos = worded.pos),
starts AS (SELECT *, cut AND NOT coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY pos), false) AS begins FROM flag)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (cut) AS n_removed, count(*) FILTER (begins) AS n_runs,
  length(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT cut), '')) AS kept_chars,
  md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT cut), '')) AS kept_md5
FROM starts GROUP BY doc_id
"""
