"""Buckets, deltas, commits of several writers, compaction, the catalog and streams into a termbase."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from lexforge.sources import store
from lexforge.sources.store import Termbase, list_termbases
from lexforge.streaming.intake import add_batch, add_stream, read_term_stream


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/bases"


def filled(spark, root, n=40, name="b"):
    base = Termbase.create(spark, root, name, buckets=4)
    ids = spark.range(1, n + 1)
    terms = ids.selectExpr("id", "concat('w', id) as word", "'en' as lang", "'' as type", "concat('t', id) as translation", "'it' as domain", "'draft' as status", "'' as notes", "timestamp '2024-01-01' as created_at", "timestamp '2024-01-01' as updated_at")
    assoc = ids.selectExpr("id", "id as term_id", "concat('r', id) as related_word", "'x' as relation_type", "1.0D as score", "'m' as source")
    base.load(terms, assoc)
    return base


def words(base):
    return {r["id"]: r["word"] for r in base.terms.collect()}


def test_an_update_writes_one_bucket(spark, root):
    base = filled(spark, root)
    before = base._state()
    base.update_term(6, word="six", nothing="x")
    after = base._state()
    assert after["number"] == before["number"] + 1 and after["touched"] == {"terms": ["2"]}
    assert {b for b in before["terms"] if before["terms"][b] != after["terms"][b]} == {"2"}
    rows = spark.read.parquet(*base._paths(after["terms"]["2"]["deltas"][0])).collect()
    assert [(r["id"], r["word"]) for r in rows] == [(6, "six")]
    assert words(base)[6] == "six" and len(words(base)) == 40 and base.get_term(6)["translation"] == "t6"
    base.update_term(6, word="VI")
    base.delete_term(10)
    base.update_term(10, word="gone")
    assert words(base)[6] == "VI" and 10 not in words(base) and base.get_term(10) is None and base.get_associations(10) == []
    assert len(base.get_associations(6)) == 1


def test_sets_of_rows(spark, root):
    base = filled(spark, root)
    base.update_where(F.col("id") % 5 == 0, F.expr("timestamp '2025-01-01'"), status="confirmed")
    base.delete_where(F.col("id") % 8 == 0)
    got = {r["id"]: (r["status"], r["updated_at"].year) for r in base.terms.collect()}
    assert got == {i: ("confirmed", 2025) if i % 5 == 0 else ("draft", 2024) for i in range(1, 41) if i % 8}
    assert sorted(r["term_id"] for r in base.associations.collect()) == sorted(got)
    state = base._state()
    assert all(b["deltas"] == [] for k, b in state["terms"].items() if k not in "0123")
    assert base.compact("terms") == 4 and base.compact("associations") > 0
    state = base._state()
    assert all(not b["deltas"] and len(b["rows"]) <= 1 for t in ("terms", "associations") for b in state[t].values())
    assert {r["id"]: (r["status"], r["updated_at"].year) for r in base.terms.collect()} == got
    folders = base.files.folders(base.path)
    assert base.vacuum(keep=1, older_than=0) > 0 and len(base.files.folders(base.path)) < len(folders)
    assert len(words(base)) == len(got) and len(base._numbers()) == 1


def test_many_deltas_are_compacted(spark, root, monkeypatch):
    monkeypatch.setattr(store, "MOST_DELTAS", 2)
    base = filled(spark, root, 8)
    for k in range(4):
        base.update_term(4, word=f"v{k}")
    assert len(base._state()["terms"]["0"]["deltas"]) < 3 and words(base)[4] == "v3"


def test_two_writers_both_land(spark, root):
    base = filled(spark, root)
    other = Termbase(spark, root, "b")
    meet = threading.Barrier(2)
    errors = []

    def run(b, change):
        try:
            meet.wait()
            change(b)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    for one, two in (
        (lambda b: b.add_term("one"), lambda b: b.add_term("two")),
        (lambda b: b.update_term(4, word="four"), lambda b: b.update_term(8, domain="law")),  # one bucket
        (lambda b: b.update_term(5, word="five"), lambda b: b.delete_term(6)),
        (lambda b: b.set_meta("a", "1"), lambda b: b.set_meta("b", "2")),
    ):
        threads = [threading.Thread(target=run, args=x) for x in ((base, one), (other, two))]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
    assert not errors
    got = {r["id"]: r for r in base.terms.collect()}
    assert {got[41]["word"], got[42]["word"]} == {"one", "two"} and got[4]["word"] == "four" and got[8]["domain"] == "law" and got[8]["word"] == "w8"
    assert got[5]["word"] == "five" and 6 not in got and base.get_meta("a") == "1" and base.get_meta("b") == "2"


def test_a_change_in_between_is_seen(spark, root, monkeypatch):
    """Another writer commits after a change was prepared: one that doesn't matter, then one that does."""
    base, other = filled(spark, root), Termbase(spark, root, "b")
    tried, true_commit = [], Termbase._commit

    def commit(self, based_on, change, reads=()):
        if self is base and "deltas" in change:
            tried.append(based_on)
            if len(tried) == 1:
                other.update_term(5, word="elsewhere")
                other.update_term(4, translation="mine")
        return true_commit(self, based_on, change, reads)

    monkeypatch.setattr(Termbase, "_commit", commit)
    base.update_term(4, word="four")
    got = {r["id"]: (r["word"], r["translation"]) for r in base.terms.collect()}
    assert got[4] == ("four", "mine") and got[5][0] == "elsewhere" and len(tried) == 2
    other.delete_term(12)
    with pytest.raises(ValueError, match="no term"):
        base.add_association(12, "x")


def test_a_commit_is_created_once(spark, root):
    base = filled(spark, root, 4)
    path = f"{base.path}/log/{base._state()['number'] + 1:020d}.json"
    done = []
    threads = [threading.Thread(target=lambda k=k: done.append(base.files.create(path, json.dumps(k).encode()))) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(done) == [False] * 5 + [True] and json.loads(base.files.read(path)) in range(6)
    assert [n for n in base.files.names(f"{base.path}/log") if n.endswith(".tmp")] == []


def test_catalog_of_many_bases(spark, root, tmp_path):
    for k in range(3):
        base = filled(spark, root, 4 + k, f"base {k}")
        base.delete_term(1)
        base.update_term(2, lang="fr")
    Termbase.create(spark, root, "none", "it")
    got = {b["name"]: (b["total_terms"], b["lang"], b["domain"]) for b in list_termbases(spark, root)}
    want = {"base 0": (3, "en, fr", ""), "base 1": (4, "en, fr", ""), "base 2": (5, "en, fr", ""), "none": (0, "", "it")}
    assert got == want
    (tmp_path / "bases/broken/log").mkdir(parents=True)
    (tmp_path / "bases/broken/log/00000000000000000000.json").write_text("{")
    state = base._state()
    part = state["terms"]["3"]["rows"][0]
    for f in (tmp_path / "bases/base 2" / part).glob("*.parquet"):
        f.write_bytes(b"no parquet")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    got = {b["name"]: b["total_terms"] for b in list_termbases(spark, root)}
    assert got == {"base 0": 3, "base 1": 4, "base 2": 0, "none": 0, "broken": 0}


def test_batches_are_added_once(spark, root):
    base = filled(spark, root, 2)
    rows = spark.createDataFrame([("w1", "t1"), ("new", "neu"), ("new", "neu")], "word string, translation string")
    assert add_batch(base, rows, "s", 0) == 1 and add_batch(base, rows, "s", 0) == 0
    state = base._state()
    assert add_batch(base, rows, "other", 0, dedup=False) == 3
    with_rows = base.terms.count()
    assert add_batch(base, rows, "other", 0, dedup=False) == 0 and base.terms.count() == with_rows
    # a run that another one of the same batch has overtaken: what it was based on has changed, and then it is there
    late = rows.selectExpr("word", "'' lang", "'' type", "translation", "'' domain", "'' status", "'' notes")
    with pytest.raises(store.Conflict):
        base.add_rows(late, ["word"], ("other", 0), state)
    with pytest.raises(store._Added):
        store._applied(base._state(), {"batch": ("other", 0)})


def test_stream_into_a_termbase(spark, root, tmp_path):
    base = filled(spark, root, 2)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("word,translation,domain\nsun,Sonne,\nw1,t1,it\n")
    go = lambda: add_stream(base, read_term_stream(spark, str(tmp_path / "in")), "csv", str(tmp_path / "cp")).awaitTermination()
    go()
    (tmp_path / "in/b.csv").write_text("word,translation,domain\nmoon,Mond,x\nsun,Sonne,\n")
    go()
    go()
    assert sorted(words(base).values()) == ["moon", "sun", "w1", "w2"] and base._state()["batches"] == {"csv": 1}
    # the checkpoint lost: batches that the termbase has are not added again
    add_stream(base, read_term_stream(spark, str(tmp_path / "in")), "csv", str(tmp_path / "cp2")).awaitTermination()
    assert len(words(base)) == 4
