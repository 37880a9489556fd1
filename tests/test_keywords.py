"""Keyword tables: both ways against plain Python, and the built-in lists against the profile."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lexforge.functions.text import analyze
from lexforge.operators import keywords as kw


@pytest.mark.parametrize("most_bytes", [kw.MOST_BYTES, 0])
def test_hits(spark, most_bytes):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcé中 ", k=rng.randint(0, 40))) for _ in range(60)] + [None, "", "aaaa", "aaaa"]
    words = ["".join(rng.choices("abcé中", k=rng.randint(1, 6))) for _ in range(120)] + [None, "", "aa", "aa", "abcab"]
    ids = [None if i == 3 else i % 62 for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(ids), strict=True)), "doc_id long, text string, keyword string")
    got = [tuple(r) for r in kw.keyword_hits(docs, spark.createDataFrame([(w,) for w in words], "keyword string"), most_bytes=most_bytes).collect()]
    want = {(i, w) for i, t in zip(ids, texts, strict=True) for w in words if t and w and w in t}
    assert len(got) == len(set(got)) and set(got) == want
    none = spark.createDataFrame([], "keyword string")
    assert kw.keyword_hits(docs, none, most_bytes=most_bytes).count() == 0


@pytest.mark.parametrize("most_bytes", [kw.MOST_BYTES, 0])
def test_scores_are_those_of_the_profile(spark, most_bytes):
    texts = ["本合同由甲方签订，患者诊断", "the API server database software framework interface algorithm deployment", "liability audit", "", None, "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["domain"]): r["score"] for r in kw.keyword_scores(docs, kw.domain_table(spark), most_bytes=most_bytes).collect()}
    want = analyze(docs).select("doc_id", F.explode("domain_scores").alias("d", "s")).filter("s > 0").collect()
    assert got == {(r["doc_id"], r["d"]): r["s"] for r in want}


@pytest.mark.parametrize("small", [kw.SMALL_BYTES, 0])
def test_long_texts_on_grams(spark, monkeypatch, small):
    """Grams of one text of 60,000 characters, across the borders of its parts; distinct by comparing all with all
    took minutes."""
    monkeypatch.setattr(kw, "SMALL_BYTES", small)
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefgé中😀\n", k=n)) for n in (60_000, 199, 200, 201, 203, 204, 1)] + ["x" * 198 + "needle" + "y" * 300]
    words = ["needle", "é", "中a", "zz", "q"] + [texts[0][k : k + 5] for k in range(196, 206)] + [texts[0][-4:], texts[4][-3:], texts[5][197:204]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    got = [tuple(r) for r in kw.keyword_hits(docs, spark.createDataFrame([(w,) for w in words], "keyword string"), most_bytes=0).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, w) for i, t in enumerate(texts) for w in words if w in t}
    assert time.time() - began < 40
