"""Dictionary sources: registry, kept dictionaries read through the data source, and kept responses."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from lexforge.sources import base, dictionary, lookup

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file

ROWS = [("alpha", '[{"shortdef": ["first letter"]}]'), ("beta", '[{"shortdef": ["second"]}]'), ("beta", '[{"shortdef": ["again"]}]'), ("über", "[]"), (None, "[]"), ("gamma", None)]


class Glossary(base.DictSource):
    name, rank, needs_key, pages = "glossary", 50, False, ("a", "b")

    def fetch(self, term, page=""):
        return json.dumps([term, page]) if term != "none" else None

    def flatten(self, raw, limit):
        d = raw.select("query", "lang", F.from_json("json", "array<string>").alias("x"))
        return base.rows(d, F.transform("x", lambda w: base.item(w, "gloss", self.name, 0.5, F.col("lang"))), self.rank, 0)


@pytest.fixture
def glossary():
    yield base.register(Glossary())
    base.unregister("glossary")


def test_registry(glossary, monkeypatch):
    assert [s.name for s in base.known()] == ["youdao", "webster", "wikipedia", "glossary"]
    assert glossary.available and glossary.endpoint("a") == "glossary-a"
    assert not base.source("webster").available
    monkeypatch.setenv("LEXFORGE_WEBSTER_KEY", "k")
    assert base.source("webster").available
    with pytest.raises(ValueError, match="unknown"):
        base.source("nothing")
    with pytest.raises(ValueError, match="name"):
        base.register(base.DictSource())


@pytest.fixture
def path(spark, tmp_path):
    at = f"file://{tmp_path}/dict"
    dictionary.write_dictionary(spark.createDataFrame(ROWS, "term string, json string"), at, "webster")
    dictionary.write_dictionary(spark.createDataFrame([("beta", '["x"]', "a"), ("z", '["y"]', "b")], "term string, json string, lang string"), at, "glossary")
    return at


@pytest.mark.parametrize("where", ["true", "term = 'beta'", "term in ('alpha', 'z', 'q')", "term > 'b' and term <= 'z'", "term like 'al%'", "term like '%a'", "source = 'glossary'", "source = 'glossary' and term = 'z'", "term < 'a'", "term = 'über'", "lang = 'a'", "term is not null", "term = 'a' or term = 'beta'"])
def test_data_source(spark, path, where):
    rows = [("webster", t, "", j) for t, j in ROWS if t and j] + [("glossary", "beta", "a", '["x"]'), ("glossary", "z", "b", '["y"]')]
    plain = spark.createDataFrame(rows, dictionary.SCHEMA)
    for pushdown in (True, False):
        got = dictionary.dictionary(spark, path, pushdown=pushdown).filter(where)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.filter(where).collect()))


def test_range_of_terms(spark, path):
    got = dictionary.dictionary(spark, path, ["webster"], ("alpha", "beta")).collect()
    assert sorted(r["term"] for r in got) == ["alpha", "beta", "beta"]


def test_filters_reach_the_reader(spark, path):
    r = dictionary.PushingReader({"path": path})
    assert len(r.partitions()) >= 2
    kept = list(r.pushFilters([ds.EqualTo(("term",), "z"), ds.In(("source",), ("glossary", None)), ds.EqualTo(("lang",), "b")]))
    assert len(kept) == 3  # Spark evaluates them all
    parts = r.partitions()
    assert {p.source for p in parts} == {"glossary"} and all(p.low <= "z" <= p.high for p in parts)
    assert [b.column(1).to_pylist() for p in parts for b in r.read(p)] == [["z"]]
    none = dictionary.PushingReader({"path": path})
    list(none.pushFilters([ds.EqualTo(("term",), "zz")]))
    assert [x for p in none.partitions() for x in none.read(p)] == []
    with pytest.raises(ValueError, match="path"):
        dictionary.Reader({})


def test_two_scans_of_one_dictionary_are_told_apart(spark, path):
    raw = dictionary.dictionary(spark, path)
    a, b = raw.filter("source = 'webster'"), raw.filter("source = 'glossary'")
    asked = spark.createDataFrame([("beta",)], "term string")
    both = a.join(asked.hint("merge"), "term").unionByName(b.join(asked.hint("merge"), "term"))
    assert sorted(r["source"] for r in both.collect()) == ["glossary", "webster", "webster"]


def test_a_new_source_is_looked_up(spark, path, glossary):
    asked = spark.createDataFrame([("beta",), ("beta",), ("none",)], "query string")
    got = dictionary.lookup_dictionary(asked, path, ["webster", "glossary"])
    assert sorted((r["source"], r["word"]) for r in got.collect()) == [("glossary", "x"), ("webster", "again"), ("webster", "second")]
    assert {r["source"] for r in dictionary.lookup_dictionary(asked, path).collect()} == {"webster", "glossary"}
    web = lookup.lookup(asked, lookup.http_fetch, 9, sources=[glossary])
    assert sorted((r["word"], r["definition"]) for r in web.collect()) == [("a", "a"), ("b", "b"), ("beta", "a"), ("beta", "b")]


def test_kept_responses(spark, tmp_path, glossary):
    at, log = f"file://{tmp_path}/kept", tmp_path / "log"

    def fetch(term, endpoint):
        with open(log, "a") as f:
            f.write(f"{term} {endpoint}\n")
        return json.dumps([term, endpoint]) if term != "none" else None

    def asked(*terms):
        return spark.createDataFrame([(t,) for t in terms], "query string")

    glossary.rate = 1e6
    first = lookup.lookup(asked("a", "none", None, "a"), fetch, 9, at, [glossary])
    assert first.count() == 4 and len(log.read_text().splitlines()) == 4
    again = lookup.lookup(asked("a", "none"), fetch, 9, at, [glossary])
    assert again.count() == 4 and first.count() == 4 and len(log.read_text().splitlines()) == 4  # none is known to have none
    assert lookup.lookup(asked("a", "b"), fetch, 9, at, [glossary]).count() == 8
    assert sorted(log.read_text().splitlines()[4:]) == ["b glossary-a", "b glossary-b"]
    assert lookup.ResponseCache(spark, at).rows().count() == 6


def test_rate_and_further_tries(spark, glossary):
    glossary.rate, glossary.tries = 200.0, 3

    def broken(term, endpoint):
        raise TimeoutError(term)

    rows = lookup.fetch_all(spark.createDataFrame([("a",)], "query string"), broken, [glossary]).collect()
    assert [r["json"] for r in rows] == [None, None]
