"""Each pipeline stage against a brute-force version of it, on its own input."""

import itertools
import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from lexforge.llm import quality_rules  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_line_stage_drops_copies_of_one_line(spark):
    long = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate([long, long, "a\n" + long + "\nb"])], SCHEMA)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, "").collect()}
    assert got == {0: (long, len(long)), 2: ("a\nb", 3)}


def test_stages(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("aeioklmnrst", k=rng.randint(2, 8))) for _ in range(400)]
    sentence = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 14))).capitalize() + "."
    texts = ["\n".join(sentence() for _ in range(rng.randint(4, 9))) for _ in range(60)]
    texts += texts[:6]
    texts += [t.replace("a", "e", 1) for t in texts[6:12]]
    texts += ["\n".join([sentence(), *texts[20].split("\n")[:3], sentence(), sentence()])]
    texts += [" ".join(w.upper() + "!!" for w in sentence().split()) * 3 for _ in range(8)] + ["", None, "short"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "ngram_join", "suffix_dedup", "packing"]
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def step(name, df):
        out = stages[name](spark, df, "")
        assert out.columns == names or name == "packing"
        return spark.createDataFrame(out.collect(), out.schema)

    kept = step("quality_rules", docs)
    want = {r["doc_id"] for r in quality_rules.rate_documents(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want and not want & set(range(len(texts) - 11, len(texts)))
    assert len(want) >= 60

    lines = step("line_dedup", kept)
    seen, expect = set(), {}
    for r in sorted(kept.collect(), key=lambda r: r["doc_id"]):
        ls, gone = r["text"].split("\n"), set()
        for k in range(len(ls) - 2):
            g = tuple(ls[k : k + 3])
            gone |= {k, k + 1, k + 2} if g in seen else set()
            seen.add(g)
        if len(gone) < len(ls):
            expect[r["doc_id"]] = "\n".join(x for k, x in enumerate(ls) if k not in gone)
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == expect
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    near = step("ngram_join", lines)
    sets = {}
    for i, t in expect.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    drop: dict = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            drop = {k: drop[a] if v == drop[b] else v for k, v in drop.items()}
    assert {r["doc_id"] for r in near.collect()} == {i for i in sets if drop[i] == i}

    cut = step("suffix_dedup", near)
    first, want = {}, {}
    for r in sorted(near.collect(), key=lambda r: r["doc_id"]):
        b = r["text"].encode()
        m = bytearray(len(b))
        for s in range(len(b) - 49):
            if first.setdefault(b[s : s + 50], r["doc_id"]) < r["doc_id"]:
                m[s : s + 50] = b"\x01" * 50
        if sum(m) < len(b) or not b:
            want[r["doc_id"]] = bytes(x for x, y in zip(b, m, strict=True) if not y).decode()
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == want

    packed = stages["packing"](spark, cut, "").collect()
    assert {r["doc_id"] for r in packed} == set(want)
