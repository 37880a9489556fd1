"""Quality rules with weak supervision, in DataFrame functions alone.

One projection measures each whole text; each rule then votes good, bad or abstains. The votes of all
documents are counted by vote pattern (at most 3^rules rows, whatever the corpus), expectation-maximisation
over these counts estimates each rule's accuracy and the share of good documents, and a document is kept
when its posterior probability of being good is at least one half and the base rules don't fail it. Repeated 5-word
windows are told by 64-bit hashes. Estimation ends when all estimates have settled, or after ROUNDS rounds. The rules'
thresholds and their starting weights are hand-set, after common rules for web text.

Cases: a null text has no words; an empty text fails the base rules; very long texts are measured whole;
repeated rows are judged row by row and alike; an empty table gives no rows (estimates stay at their
pseudo-counts); columns of the input are never read but for id and text, so clashing names don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import UPPER, WORD_BREAKS, materialize, table

#: name, bad when, good when; else the rule abstains. Measures are those of measure(). Rules on single defects
#: never vote good: the absence of one defect says nothing about the others.
RULES: list[tuple[str, str, str]] = [
    ("symbols", "n_symbols > 0.02 * word_chars", "false"),
    ("symbol_runs", "n_runs > 0.02 * n_words", "false"),
    ("letters", "n_letters < 0.86 * word_chars", "n_letters >= 0.92 * word_chars"),
    ("capitals", "n_upper > 0.25 * word_chars", "false"),
    ("exclamations", "n_exclaim > 0.20 * n_words", "false"),
    ("dup_lines", "n_dup_lines > 0.30 * n_lines", "false"),
    ("repeats", "n_repeat_words > 0.12 * n_words", "false"),
    ("word_length", "word_chars < 2.5 * n_words or word_chars > 14 * n_words", "word_chars between 3 * n_words and 11 * n_words"),
    ("length", "n_words < 10", "n_words >= 20"),
    ("stops", "n_stops < 0.01 * n_words", "n_stops between 0.03 * n_words and 0.30 * n_words"),
]
#: Share of good documents before any are seen; pseudo-counts that keep every estimate off 0 and 1.
START_GOOD, PSEUDO = 0.9, 1.0
ROUNDS = 100


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a column m holding the measures of each text."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.length(t)
    # array_remove: a leading or trailing break gives an empty string
    step = docs.withColumn("_words", F.array_remove(F.split(t, "[ \\x09-\\x0D]+"), ""))
    step = step.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]")))
    step = step.withColumn("_n", F.size("_words").cast("long")).withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w))).drop("_words")
    window = "case when _n < 5 then cast(array() as array<bigint>) else transform(sequence(0, cast(_n as int) - 5), i -> xxhash64(get(_h, i), get(_h, i + 1), get(_h, i + 2), get(_h, i + 3), get(_h, i + 4))) end"
    step = step.withColumn("_g", F.expr(window)).drop("_h")
    step = step.withColumn("_repeats", F.size(F.array_distinct("_g")) < F.size("_g"))
    # positions of windows found twice or more: equal neighbours once sorted with their positions
    step = step.withColumn("_s", F.expr("case when _repeats then sort_array(transform(_g, (h, i) -> struct(h as h, i as i))) end")).drop("_g")
    step = step.withColumn("_p", F.expr("case when _repeats then sort_array(transform(filter(_s, (x, k) -> (k > 0 and get(_s, k - 1).h = x.h) or coalesce(get(_s, k + 1).h = x.h, false)), x -> x.i)) end")).drop("_s")
    step = step.withColumn("_rep", F.expr("case when _repeats then aggregate(transform(_p, (p, k) -> least(5, coalesce(get(_p, k + 1), p + 5) - p)), 0L, (a, x) -> a + x) else 0L end"))
    m = F.struct(
        F.col("_n").alias("n_words"),
        _without(t, WORD_BREAKS).cast("long").alias("word_chars"),
        (size - _without(t, "#*$%&|<>")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_rep").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count(t, F.lit("[#*$%&|<>]{2,}|!{2,}|(?<![^ \\x09-\\x0D])[|](?![^ \\x09-\\x0D])")).cast("long").alias("n_runs"),
        F.length(F.regexp_replace(t, "[^\\p{L}]+", "")).cast("long").alias("n_letters"),
        (size - _without(t, UPPER)).cast("long").alias("n_upper"),
        (size - _without(t, "!")).cast("long").alias("n_exclaim"),
        (size - _without(t, ".!?。！？")).cast("long").alias("n_stops"),
    )
    return step.withColumn("m", m).drop("_n", "_lines", "_repeats", "_p", "_rep")


def vote(measured: DataFrame) -> DataFrame:
    """measured with base_failed and votes, an array of 1 (good), -1 (bad) and 0 (abstains)."""
    names = [f for f in measured.schema["m"].dataType.fieldNames()]

    def sql(cond: str) -> str:
        for n in sorted(names, key=len, reverse=True):
            cond = cond.replace(n, f"m.{n}")
        return cond

    votes = F.array(*[F.expr(f"cast(case when {sql(bad)} then -1 when {sql(good)} then 1 else 0 end as tinyint)") for _, bad, good in RULES])
    base = F.expr("m.n_words < 10 or 100 * m.n_repeat_words > 20 * m.n_words")
    return measured.withColumn("base_failed", base).withColumn("votes", votes)


class Estimates:
    """share: of good documents. given_good, given_bad: for each rule, the probabilities of votes -1, 0, 1 in either class."""

    def __init__(self, share: float, given_good: list[list[float]], given_bad: list[list[float]]):
        self.share, self.given_good, self.given_bad = share, given_good, given_bad

    def weights(self) -> list[list[float]]:
        """Log-odds for good that each vote of each rule adds."""
        return [[math.log(g / b) for g, b in zip(gs, bs, strict=True)] for gs, bs in zip(self.given_good, self.given_bad, strict=True)]

    def posterior(self, pattern: tuple[int, ...]) -> float:
        z = math.log(self.share / (1 - self.share)) + sum(w[v + 1] for v, w in zip(pattern, self.weights(), strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

    def accuracies(self) -> list[float]:
        """The probability that a rule is right when it votes."""
        out = []
        for g, b in zip(self.given_good, self.given_bad, strict=True):
            right = self.share * g[2] + (1 - self.share) * b[0]
            out.append(right / (right + self.share * g[0] + (1 - self.share) * b[2]))
        return out


def estimate(counts: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = ROUNDS) -> Estimates:
    """Expectation-maximisation over the counts of vote patterns, for a good and a bad class in which rules vote
    independently. It starts from a majority of caution: patterns without a bad vote are taken as good. A vote
    never counts against its own direction."""
    start = {p: (0.97 if -1 not in p else 0.3 if p.count(-1) == 1 else 0.05) for p, _ in counts}
    est = None
    for _ in range(rounds + 1):
        good = [[PSEUDO * 0.1, PSEUDO * 0.2, PSEUDO * 0.7] for _ in range(n_rules)]
        bad = [[PSEUDO * 0.3, PSEUDO * 0.2, PSEUDO * 0.5] for _ in range(n_rules)]
        n_good, n_bad = PSEUDO * START_GOOD, PSEUDO * (1 - START_GOOD)
        for pattern, n in counts:
            p = start[pattern] if est is None else est.posterior(pattern)
            n_good += n * p
            n_bad += n * (1 - p)
            for j, v in enumerate(pattern):
                good[j][v + 1] += n * p
                bad[j][v + 1] += n * (1 - p)
        for j in range(n_rules):
            good[j] = [x / sum(good[j]) for x in good[j]]
            bad[j] = [x / sum(bad[j]) for x in bad[j]]
            for v, (hi, lo) in ((0, (bad, good)), (2, (good, bad))):
                if hi[j][v] < lo[j][v]:
                    hi[j][v] = lo[j][v] = (hi[j][v] + lo[j][v]) / 2
        new = Estimates(n_good / (n_good + n_bad), good, bad)
        flat = lambda e: [e.share, *(x for rule in [*e.given_good, *e.given_bad] for x in rule)]
        done = est is not None and max(abs(x - y) for x, y in zip(flat(new), flat(est), strict=True)) < 1e-10
        est = new
        if done:
            break
    return est


def learn(voted: DataFrame) -> Estimates:
    """Estimates over all rows of voted. The driver gets one row per vote pattern."""
    rows = voted.groupBy("votes").agg(F.count("*").alias("n")).collect()
    return estimate(sorted((tuple(r["votes"]), r["n"]) for r in rows), len(RULES))


def judge(voted: DataFrame, est: Estimates) -> DataFrame:
    """voted with quality_probability and kept."""
    z = F.lit(math.log(est.share / (1 - est.share)))
    for j, (against, abstain, favour) in enumerate(est.weights()):
        v = F.get("votes", F.lit(j))
        z = z + F.when(v == -1, F.lit(against)).when(v == 1, F.lit(favour)).otherwise(F.lit(abstain))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return voted.withColumn("quality_probability", p).withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= 0.5))


def rate_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measures, base_failed, kept, quality_probability and votes for every row."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    voted = materialize(vote(measure(src)).drop("text"), "votes")
    out = judge(voted, learn(voted))
    return out.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept", "quality_probability", "votes")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with docs' own columns."""
    names = docs.columns
    src = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), docs[text_col].alias("text"))
    voted = materialize(vote(measure(src)).select("_row", "votes", "base_failed"), "voted")
    return judge(voted, learn(voted)).filter("kept").select("_row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_documents(table(spark, sf_dir, "documents")).withColumn("votes", F.to_json("votes"))
