"""Golden records against a plain fold over each cluster."""

import datetime as dt
import itertools
import math
import random

import pytest

from lexforge.llm import survivorship

SCHEMA = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
TRUST = {"crm": 0, "web": 1, "store": 2, "partner": 3}
T0 = dt.datetime(2024, 4, 1)


def blank(s):
    return None if s is None or not s.strip(" \t\n\x0b\x0c\r") else s


def last(x):
    return (x is None, 0 if x is None else x)


def brute(rows):
    out = {}
    key = lambda r: r["master_id"] if r["master_id"] is not None else r["client_id"]
    for cluster, group in itertools.groupby(sorted(rows, key=lambda r: last(key(r))), key=key):
        group = [dict(r) for r in group]
        for r in group:
            for c in ("name", "email", "city", "segment"):
                r[c] = blank(r[c])
            b = r["balance"]
            r["cents"] = None if b is None or math.isnan(b) or abs(b) >= 9e16 else math.floor(100 * b + 0.5)
            r["trust"] = TRUST.get(r["source"], 4)
        latest = max((r["updated_at"] for r in group if r["updated_at"]), default=None)

        def recent(r):
            when = (1, 0) if r["updated_at"] is None else (0, -(r["updated_at"] - T0) / dt.timedelta(microseconds=1))
            return when, r["trust"], *[last(r[c]) for c in ("client_id", "source", "name", "email", "city", "nation_id", "segment", "cents", "master_id")]

        def stale(r):
            return r["updated_at"] is None or latest - r["updated_at"] > dt.timedelta(hours=1440)

        def trusted(r):
            return stale(r), r["trust"], recent(r)

        def pick(field, order):
            some = [r for r in group if r[field] is not None]
            r = min(some, key=order, default={field: None, "client_id": None})
            return r[field], r["client_id"]

        seg = pick("segment", recent)
        name = pick("name", lambda r: (-len(r["name"]), trusted(r)))
        bal = pick("cents", lambda r: (r["segment"] != seg[0], recent(r)))
        at = min(group, key=lambda r: (-(r["city"] is not None) - (r["nation_id"] is not None), trusted(r)))
        email = pick("email", trusted)
        some = at["city"] is not None or at["nation_id"] is not None
        out[cluster] = (len(group), sum(map(stale, group)), name[0], email[0], seg[0], at["city"], at["nation_id"], bal[0], name[1], email[1], seg[1], bal[1], at["client_id"] if some else None)
    return out


def rows_of(seed, n, hot):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        when = rng.choice([None, *[T0 - dt.timedelta(days=rng.choice([0, 0, 1, 59, 60, 61, 90]), microseconds=rng.choice([0, 1]))] * 6])
        row = (
            rng.choice([i, i, i, None, 3]),
            rng.choice([7 if rng.random() < hot else rng.randint(0, n // 4), None]),
            rng.choice(["crm", "web", "store", "partner", "CRM", None]),
            when,
            rng.choice([None, "", " \t", "Ann", "Jö", "Anna B", " Bo "]),
            rng.choice([None, "\n", "a@b", "c@d"]),
            rng.choice([None, "", "Ulm", "Rom"]),
            rng.choice([None, 1, 2]),
            rng.choice([None, " ", "x", "y", "z"]),
            rng.choice([None, 1.005, -3.455, 0.125, float("nan"), 1e300, -0.0]),
        )
        rows += [row] * rng.choice([1, 1, 1, 4])
    return rows


def got(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.mark.parametrize(("seed", "slice_rows", "fan_in"), [(1, 10_000, 100), (2, 7, 3), (3, 30, 2), (4, 5, 200)])
def test_golden_records(spark, seed, slice_rows, fan_in):
    rows = rows_of(seed, 150, 0.6)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(survivorship.golden_records(df, slice_rows=slice_rows, fan_in=fan_in)) == brute([r.asDict() for r in df.collect()])


def test_one_cluster_without_segments(spark):
    rows = [(i, 1, None, None, None, None, None, None, None, None) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {1: (40, 40, *[None] * 11)}
    assert got(survivorship.golden_records(df, slice_rows=5, fan_in=3)) == want
    assert survivorship.golden_records(df.limit(0)).count() == 0


def test_clashing_columns_and_instants(spark):
    rows = [(i, None, "web", dt.datetime(2024, 1, 1), f"n{i}", None, None, None, None, 1.0, "x", 1) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA.replace("timestamp_ntz", "timestamp") + ", cluster string, place int")
    assert got(survivorship.golden_records(df))[3] == (1, 0, "n3", None, None, None, None, 100, 3, None, None, 3, None)
