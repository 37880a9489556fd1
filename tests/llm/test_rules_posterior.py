"""The quality rules' verdict as DataFrame columns against the posterior of the same estimates in plain Python."""

import random

import pytest

from lexforge.llm import quality_rules as qr


def test_verdicts_are_the_posterior(spark):
    rng = random.Random(7)
    words = "the of and to in quality text words that make sense together here".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) + rng.choice([".", "", "\n" * 4]) for _ in range(120)]
    texts += ["#$% | <> &" * rng.randint(1, 30) for _ in range(25)] + ["same line\n" * 30] * 5 + ["a b c d e f " * 40] * 5 + [None, "", "  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    voted = qr.vote(qr.measure(docs))
    est = qr.learn(voted)
    rows = qr.rate_documents(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        votes = tuple(r["votes"])
        assert set(votes) <= {-1, 0, 1} and len(votes) == len(qr.RULES)
        p = est.posterior(votes)
        assert r["quality_probability"] == pytest.approx(p, abs=1e-9)
        assert r["kept"] == (not r["base_failed"] and p >= 0.5)
    by = {tuple(r["votes"]) for r in voted.select("votes").collect()}
    assert len(by) > 5 and any(r["kept"] for r in rows) and not all(r["kept"] for r in rows)
    again = qr.estimate(sorted((v, sum(tuple(r["votes"]) == v for r in rows)) for v in by), len(qr.RULES))
    assert again.share == pytest.approx(est.share, abs=1e-9)
