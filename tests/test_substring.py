"""Batch substring search against SQLite's LIKE."""

import random
import sqlite3

from lexforge.operators import substring as sub


def test_pairs_match_sqlite(spark):
    rng = random.Random(8)
    con = sqlite3.connect(":memory:")
    words = ["".join(rng.choices("aAbBcé%_\\中 ", k=rng.randint(0, 9))) for _ in range(150)] + [None, "", "aa", "aa"]
    patterns = ["".join(rng.choices("aAbBé%_\\中", k=rng.randint(0, 5))) for _ in range(80)] + [None, "", "%", "_", "__", "%_%", "abc", "ABC", "\\"]
    rows = spark.createDataFrame(list(enumerate(words)), "id int, w string")
    got = sub.search_many(rows, "w", spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    want = {(i, p) for i, w in enumerate(words) for p in set(patterns) if w is not None and p is not None and con.execute("select ? like ?", (w, f"%{p}%")).fetchone()[0]}
    have = [(r["id"], r["pattern"]) for r in got.collect()]
    assert len(have) == len(set(have)) and set(have) == want


def test_no_nested_loop(spark):
    rows = spark.range(10).selectExpr("id", "concat('word', id) as w")
    plan = sub.search_many(rows, "w", rows.selectExpr("w as pattern"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_batches_keep_each_querys_best(spark):
    terms = spark.createDataFrame([(1, "server", "s", "it", 1), (2, "Service", None, "it", 2), (3, "cloud", "SERV", "", 2)], "id long, word string, translation string, domain string, updated_at int")
    assoc = spark.createDataFrame([(1, "host", "synonym", "m", 0.5), (2, "help", "synonym", "m", 0.9), (3, "sky", "x", "m", 1.0)], "term_id long, related_word string, relation_type string, source string, score double")
    asked = spark.createDataFrame([("serv",), ("serv",), ("IT",), ("none",)], "query string")
    got = {(r["query"], r["place"]): r["id"] for r in sub.search_terms_many(terms, asked, 2).collect()}
    assert got == {("serv", 1): 3, ("serv", 2): 2, ("IT", 1): 2, ("IT", 2): 1}
    got = {(r["query"], r["place"]): r["word"] for r in sub.search_associations_many(terms, assoc, asked, 5).collect()}
    assert got == {("serv", 1): "help", ("serv", 2): "host"}
    assert sub.search_terms_many(terms, asked.limit(0)).count() == 0 and sub.search_terms_many(terms.limit(0), asked).count() == 0


def test_associations_are_cut_by_term_before_the_join(spark):
    """A term's rows beyond its best limit aren't repeated for each query and sorted; what is found stays the same."""
    rng = random.Random(5)
    words = ["red ring", "red rod", "Ring", "bolt", "red ring", None]
    terms = spark.createDataFrame(list(enumerate(words)), "id long, word string")
    rows = [(rng.choice([0, 1, 2, 3, 4, 5, 9, None]), rng.choice("abc"), rng.choice("xy"), "m", rng.choice([0.1, 0.5, None])) for _ in range(300)]
    assoc = spark.createDataFrame(rows, "term_id long, related_word string, relation_type string, source string, score double")
    asked = ["ring", "RED", "r", "bolt", "zzz"]
    df = sub.search_associations_many(terms, assoc, spark.createDataFrame([(a,) for a in asked], "query string"), 4)
    got = sorted((r["query"], r["place"], r["word"], r["type"], r["score"]) for r in df.collect())
    want = []
    for a in asked:
        ids = [i for i, w in enumerate(words) if w and a.lower() in w.lower()]
        best = sorted((r for r in rows if r[0] in ids), key=lambda r: (r[4] is None, -(r[4] or 0), r[1], r[2]))[:4]
        want += [(a, k, r[1], r[2], r[4]) for k, r in enumerate(best, 1)]
    assert got == sorted(want)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit [term_id" in plan and plan.index("WindowGroupLimit [term_id") > plan.index("Join Inner")
