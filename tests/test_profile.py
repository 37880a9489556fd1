"""Document profiles against a plain restatement, on random Chinese and ASCII text."""

import random
import re

from pyspark.sql import functions as F

from lexforge.functions import text as tx
from lexforge.functions.domains import DOMAIN_KEYWORDS
from lexforge.functions.text import analyze, read_documents, register_functions, summary


def plain(t: str) -> dict:
    cn, en = len(re.findall("[一-鿿]", t)), len(re.findall("[a-zA-Z]", t))
    lang = "unknown" if cn + en == 0 else "zh" if cn / (cn + en) > 0.7 else "en" if cn / (cn + en) < 0.3 else "mixed"
    scores = {d: min(1.0, sum(w in t.lower() for w in ws) / max(1, len(ws) * 0.1)) for d, ws in DOMAIN_KEYWORDS.items()}
    best = max(scores, key=scores.get)
    domain = best if scores[best] >= 0.1 else "general"
    n = len(re.findall("[。？！；]", t)) if lang == "zh" else len(re.findall("[.!?]+", t))
    solid = len(t.replace(" ", "").replace("\n", ""))
    words_cn, words_en = max(1, int(cn / 1.5)), len(re.findall("[a-zA-Z]+", t))
    p = (2 if n and solid / n > 80 else 1 if n and solid / n > 50 else 0) + (lang == "mixed") + (domain != "general")
    p += 2 if words_cn + words_en > 5000 else 1 if words_cn + words_en > 1000 else 0
    return {
        "lang": lang, "chars_total": len(t), "chars_no_space": solid, "words_cn": words_cn, "words_en": words_en,
        "paragraphs": len([x for x in re.split(r"\n\s*\n", t.strip()) if x.strip()]), "sentences": n, "domain": domain,
        "domain_scores": scores, "difficulty": "hard" if p >= 4 else "medium" if p >= 2 else "easy",
    }


def test_random_texts(spark):
    rng = random.Random(5)
    parts = ["合同", "患者", "software", "API", "liability", " ", "\n", "\n\n", "\n \t\n", "。", "！", ". ", "?!", "é", "😀", "\t", "　", "中", "abc", "don't", "a1b2"]
    texts = ["", "   ", "\n\n"] + ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(300)] + ["word " * 1500, "字" * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in analyze(docs).collect():
        want = plain(r["text"])
        assert {k: r[k] for k in want} == want, r["text"]


def test_nulls_and_functions(spark):
    row = analyze(spark.createDataFrame([(1, None)], "doc_id long, text string")).head()
    assert (row["lang"], row["chars_total"], row["words_cn"], row["paragraphs"]) == ("unknown", 0, 1, 0)
    assert summary(row).splitlines()[0] == "Language: unknown"
    register_functions(spark)
    got = spark.sql("select detect_language('合同 ab'), count_paragraphs('a\\n \\nb'), chinese_words('一二三四'), guess_language('x字')").head()
    assert tuple(got) == ("mixed", 2, 2, "zh")


def test_file_source_and_plan(spark, tmp_path):
    (tmp_path / "a.txt").write_text("One contract.\n\nTwo.", encoding="utf-8")
    r = analyze(read_documents(spark, str(tmp_path))).head()
    assert (r["paragraphs"], r["sentences"], r["domain"]) == (2, 2, "legal")
    plan = analyze(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") <= 2


def test_counts_make_no_array_of_characters(spark):
    odd = ["", "\n \t\u3000", "a1b2-C", "合同abc患者", "😀é한K\u212a", "一鿿㐀", " liability 责任", None]
    got = tx.analyze(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any(f"[{x}], 0)" in plan for x in ("a-zA-Z", tx.CJK)) and "translate(" not in plan
    rows = {r["doc_id"]: r for r in got.select("*", tx.cjk_count(F.col("text")).alias("cn"), tx.letter_count(F.col("text")).alias("en")).collect()}
    for i, t in enumerate(odd):
        assert rows[i]["chars_no_space"] == len((t or "").replace(" ", "").replace("\n", ""))
        if t is not None:
            assert (rows[i]["cn"], rows[i]["en"]) == (sum("一" <= c <= "鿿" for c in t), sum(c.isascii() and c.isalpha() for c in t))
    assert rows[6]["domain_scores"]["legal"] == 2 / 2.2 and rows[7]["lang"] == "unknown"
