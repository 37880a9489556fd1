"""New-word discovery against a plain computation on Chinese text."""

import math
import random
import re
from collections import Counter

import pytest

from lexforge.operators import newwords as nw
from lexforge.operators.terms import extract


def brute(texts, longest, least, pmi_at, h_at):
    count, left, right = Counter(), {}, {}
    for t in texts:
        for run in re.findall("[一-鿿]+", t or ""):
            for n in range(1, longest + 1):
                for i in range(len(run) - n + 1):
                    g = run[i : i + n]
                    count[g] += 1
                    left.setdefault(g, Counter())[run[i - 1] if i else ""] += 1
                    right.setdefault(g, Counter())[run[i + n : i + n + 1]] += 1
    total = Counter()
    for g, c in count.items():
        total[len(g)] += c
    p = lambda g: count[g] / total[len(g)]
    h = lambda c: -sum(x / sum(c.values()) * math.log(x / sum(c.values())) for x in c.values())
    out = {}
    for g, c in count.items():
        if len(g) > 1 and c >= least:
            pmi = min(math.log(p(g) / (p(g[:k]) * p(g[k:]))) for k in range(1, len(g)))
            hl, hr = h(left[g]), h(right[g])
            if pmi >= pmi_at and min(hl, hr) >= h_at:
                out[g] = (c, pmi, hl, hr)
    return out


def test_new_words(spark):
    rng = random.Random(6)
    vocabulary = ["合同", "数据库", "服务器", "的", "和", "在", "患者", "治疗方案"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice(["", "", "，", "。\n", " x "]) for _ in range(40)) for _ in range(20)] + [None, "", "plain text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["word"]: (r["frequency"], r["pmi"], r["left_entropy"], r["right_entropy"]) for r in nw.new_words(docs, 4, 5, 1.0, 0.5).collect()}
    want = brute(texts, 4, 5, 1.0, 0.5)
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], abs=1e-9) for g in want)
    assert {"合同", "数据库", "服务器", "患者", "治疗方案"} <= got.keys() and not {"据库", "数据", "务器"} & got.keys()
    words = nw.new_words(docs, 4, 5, 1.0, 0.5)
    top = nw.match_words(docs, words, 3).filter("doc_id = 0").collect()
    assert len(top) == 3 and all(r["frequency"] == texts[0].count(r["term"]) for r in top)
    assert nw.new_words(docs.limit(0)).count() == 0
    ranked = [r["term"] for r in extract(docs, 5, "newwords").filter("doc_id = 0").orderBy("rank").collect()]
    assert len(ranked) == 5 and top[0]["term"] in ranked
