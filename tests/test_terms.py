"""Term extraction against a plain restatement."""

import random
import re
import time
from collections import Counter

from lexforge.operators import terms as tm


def grams(t: str, n: int, k: int) -> list[tuple[str, int, int]]:
    c = re.sub("[^一-鿿]", "", t)
    return [(g, x, max(1, len(c) - n + 1)) for g, x in Counter(c[i : i + n] for i in range(len(c) - n + 1)).most_common(k)]


def plain(t: str, k: int) -> list[tuple]:
    out = [(g, x, x / total, "bigram", i) for i, (g, x, total) in enumerate(grams(t, 2, k), 1)]
    for n in (3, 4, 5):
        out += [(g, x, (x / total) * (n * 0.3), "ngram", n * 1_000_000 + i) for i, (g, x, total) in enumerate(grams(t, n, k), 1) if x >= 2]
    kinds = [re.findall(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b", t), [p for p in re.findall(r"\b(?:[A-Z][a-z]+){2,}\b|\b[A-Z][a-zA-Z]*[a-z][A-Z][a-zA-Z]*\b", t) if len(p) > 4], re.findall(r"\b([A-Z]{2,5})\b", t)]
    out += [(p, 1, 0.0, "proper_noun", 10_000_000 + i) for i, ps in enumerate(kinds) for p in set(ps)]
    merged: dict = {}
    for term, x, s, kind, o in sorted(out, key=lambda v: (v[4], v[0])):
        m = merged.setdefault(term.lower(), [term, 0, 0.0, kind, o])
        m[1] += x
        m[2] += s
    return [(m[0], m[1], round(m[2], 9), m[3]) for m in sorted(merged.values(), key=lambda m: (-m[2], m[4], m[0]))[:k]]


def test_extract_random(spark):
    rng = random.Random(9)
    texts = ["", "no terms here", "使用AI辅助", "é AB C", "Visit New York City, WebApplicationFactory and NASA; nasa New  York"]
    texts += ["".join(rng.choices("数据库合同条款。 AB", k=rng.randint(1, 120))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got: dict = {}
    for r in tm.extract(docs, 12).orderBy("doc_id", "rank").collect():
        got.setdefault(r["doc_id"], []).append((r["term"], r["frequency"], round(r["score"], 9), r["word_type"]))
    for i, t in enumerate(texts):
        assert got.get(i, []) == plain(t, 12), t


def test_types_strategies_and_table(spark):
    docs = spark.createDataFrame([(1, "The patient and the patient data"), (2, None)], "doc_id long, text string")
    rows = tm.extract(docs, 5, "tfidf").orderBy("rank").collect()
    assert rows[0]["term"] == "patient" and {r["word_type"] for r in rows} == {"keyword"}
    assert tm.frequency_table(rows).splitlines()[1] == "-" * 50
    many = spark.createDataFrame([(1, "数据数据数据 New York and NASA")], "doc_id long, text string")
    by = {r["word_type"]: r["terms"] for r in tm.terms_by_type(tm.extract(many, 30)).collect()}
    assert set(by) == {"bigram", "ngram", "proper_noun"} and by["proper_noun"] == "New York, NASA"
    try:
        tm.extract(docs, 5, "other")
        raise AssertionError
    except ValueError:
        pass


def test_grams_dont_travel_and_long_texts_take_linear_time(spark):
    """One shuffle, of texts; grams across the borders of parts, and of rows with one doc_id together."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("数据库合同条款患", k=n)) for n in (150_000, 199, 200, 201, 204, 205, 3, 0)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(1, texts[2])], "doc_id long, text string")
    top = tm.top_ngrams(docs, 30)
    assert top._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    began = time.time()
    got: dict = {}
    for r in top.collect():
        got.setdefault((r["doc_id"], r["n"]), []).append((r["place"], r["term"], r["frequency"], round(r["score"], 9)))
    for i, t in enumerate(texts):
        for n in (3, 4, 5):
            if i != 1:
                want = [(k, g, x, round(x / total * (n * 0.3), 9)) for k, (g, x, total) in enumerate(grams(t or "", n, 30), 1) if x >= 2]
                assert sorted(got.get((i, n), [])) == want
    both = Counter(t[k : k + 3] for t in texts[1:3] for k in range(len(t) - 2))
    assert sorted(x for _, _, x, _ in got[1, 3]) == sorted(sorted((x for x in both.values() if x >= 2), reverse=True)[:30])
    assert all(round(x / sum(both.values()) * 0.9, 9) == s for _, _, x, s in got[1, 3])
    assert time.time() - began < 40


def test_tfidf_shuffles_texts_before_their_tokens(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (1, "beta gamma"), (2, "alpha"), (3, None), (None, "alpha delta")], "doc_id long, text string")
    got = tm.tfidf_keywords(docs, 5)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert {(r["doc_id"], r["term"]): r["tf"] for r in got.collect()} == {(1, "alpha"): 1, (1, "beta"): 3, (1, "gamma"): 1, (2, "alpha"): 1, (None, "alpha"): 1, (None, "delta"): 1}
