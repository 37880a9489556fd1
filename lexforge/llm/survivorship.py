"""Golden records: one record per cluster of client rows, each field filled by an ignore-null first value.

Two orders of a cluster's records are shared by all fields. RECENT: latest updated_at (null last), higher trust of the
source, smaller client_id. TRUSTED: fresh before stale, higher trust, then RECENT. Segment is the first non-null one
in RECENT order, email in TRUSTED order, both over an unbounded frame; name (most code points) and address (most
non-nulls of city and nation) have orders of their own that end in the rank of TRUSTED, balance (records with the
chosen segment first) one that ends in the rank of RECENT.

A cluster may hold any share of the rows, so no window spans a whole one at first. Equal rows are counted before
they are shuffled. Rows are dealt to slices of their cluster by their hash, about SLICE_ROWS of one cluster in each.
Within each slice, the windows leave the few records that win a field; survivors of FAN_IN slices meet in the next
round under the same windows, until one slice a cluster is left. A cluster's winner of a field is the winner of the
slice that it lies in, so the result is that of windows over whole clusters. What the orders need to know of the
whole cluster (its latest updated_at, its chosen segment) comes from a first such tree, whose results go back to
the slices they came from, so no join has a key with many rows.

Cases: strings that are empty or hold only white space count as null; a source outside the list, or null, has the
least trust; a null updated_at is stale and the last; where all are null, all records are stale. Ties that the orders
leave (repeated client_ids, a null one, which comes last) go to the smaller source, name, email, city, nation, segment
and balance in turn, nulls last. Repeated rows count each in n_records. Rows with neither master_id nor client_id
form one cluster with a null id. A balance that is NaN or whose cents don't fit 64 bits counts as null. An empty table
gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.llm.common import WORD_BREAKS, table

TRUST = ("crm", "web", "store", "partner")
STALE_HOURS = 60 * 24
#: Rows of one cluster in a slice, about; and slices whose survivors meet in the next round.
SLICE_ROWS, FAN_IN = 500, 1000

_FIELDS = ("source", "name", "email", "city", "nation", "segment", "balance")


def _filled(c: str) -> Column:
    col = F.col(c).cast("string")
    return F.when(F.translate(col, WORD_BREAKS, "") != "", col)


def _asc(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_last() for n in names]


def _recent() -> list[Column]:
    return [F.col("updated").desc_nulls_last(), F.col("trust"), *_asc("client", *_FIELDS, "master")]


def _whole(keys: Sequence[str], order: list[Column]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _first(value: Column, where: Column, window) -> Column:
    """The first value in the window's order among rows for which where holds."""
    return F.first(F.when(where, value), ignorenulls=True).over(window)


def prepared(clients: DataFrame, trust: Sequence[str]) -> DataFrame:
    """Distinct rows under short names, with the number of times each occurs."""
    cents = F.floor(F.try_multiply(F.lit(100.0), F.col("balance").cast("double")) + F.lit(0.5))
    balance = F.when(~F.isnan(F.col("balance").cast("double")) & (F.abs(F.col("balance").cast("double")) < 9e16), cents)
    rank = F.lit(len(trust))
    for k, name in reversed(list(enumerate(trust))):
        rank = F.when(F.col("source") == name, k).otherwise(rank)
    rows = clients.select(
        F.coalesce(F.col("master_id"), F.col("client_id")).cast("long").alias("cluster"),
        F.col("master_id").cast("long").alias("master"),
        F.col("client_id").cast("long").alias("client"),
        F.col("updated_at").alias("updated"),
        F.coalesce(rank, F.lit(len(trust))).alias("trust"),
        F.col("source").cast("string").alias("source"),
        *[_filled(c).alias(c) for c in ("name", "email", "city", "segment")],
        F.col("nation_id").alias("nation"),
        balance.alias("balance"),
    )
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("times"))


_ORDER = ("updated", "trust", "client", *_FIELDS, "master")


def _heads(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group by keys: the latest update, and the first record with a segment in RECENT order, or the
    first one where none has; with what orders it, so that heads of groups can meet under the same order."""
    recent = _whole(keys, _recent())
    winner = F.struct(*_ORDER)
    picked = rows.withColumns(
        {
            "place": F.row_number().over(Window.partitionBy(*keys).orderBy(*_recent())),
            "latest": F.max("latest").over(Window.partitionBy(*keys)),
            "first": F.coalesce(_first(winner, F.col("segment").isNotNull(), recent), winner),
        }
    ).filter("place = 1")
    return picked.select(*keys, "latest", *[F.col(f"first.{c}").alias(c) for c in _ORDER])


def cluster_facts(rows: DataFrame, slices: int, fan_in: int) -> DataFrame:
    """(cluster, slice) with the cluster's latest update and chosen segment. Slices are summed up in a tree, and each
    round's answer goes back to the groups it came from."""
    heads = _heads(rows.select("cluster", "slice", "latest", *_ORDER), ["cluster", "slice"])
    if slices == 1:
        return heads.select("cluster", "slice", "latest", F.col("segment").alias("chosen"))
    above = F.floor(F.col("slice") / fan_in)
    facts = cluster_facts(heads.withColumn("slice", above), -(-slices // fan_in), fan_in)
    return _answer(heads.select("cluster", "slice", above.alias("above")), facts)


def _answer(groups: DataFrame, facts: DataFrame) -> DataFrame:
    """The facts of each group's upper group. A cluster has at most FAN_IN groups under one."""
    g, f = groups.alias("g"), facts.alias("f")
    joined = g.join(f, F.col("g.cluster").eqNullSafe(F.col("f.cluster")) & (F.col("g.above") == F.col("f.slice")))
    return joined.select("g.cluster", "g.slice", "f.latest", "f.chosen")


def fill(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds, for each group by keys, every field's winner in its order: a struct of the place of the record in the
    group and the record's client; and the counts of records."""
    by = Window.partitionBy(*keys)
    recent = _whole(keys, _recent())
    trusted = _whole(keys, [F.col("stale"), F.col("trust"), F.col("place")])
    ranked = rows.withColumn("place", F.row_number().over(by.orderBy(*_recent())))
    ranked = ranked.withColumn("rank", F.row_number().over(by.orderBy("stale", "trust", "place")))
    most_points = _whole(keys, [F.length("name").desc_nulls_last(), F.col("rank")])
    parts = F.col("city").isNotNull().cast("int") + F.col("nation").isNotNull().cast("int")
    most_parts = _whole(keys, [parts.desc(), F.col("rank")])
    same_segment = _whole(keys, [F.col("segment").eqNullSafe(F.col("chosen")).desc(), F.col("place")])
    this = F.struct("place", "client", "name", "email", "segment", "city", "nation", "balance")
    return ranked.withColumns(
        {
            "by_segment": _first(this, F.col("segment").isNotNull(), recent),
            "by_email": _first(this, F.col("email").isNotNull(), trusted),
            "by_name": _first(this, F.col("name").isNotNull(), most_points),
            "by_address": F.first(this).over(most_parts),
            "by_balance": _first(this, F.col("balance").isNotNull(), same_segment),
            "records": F.sum("records").over(by),
            "stales": F.sum("stales").over(by),
        }
    )


_WON = ("by_segment", "by_email", "by_name", "by_address", "by_balance")


def survivors(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The records that win a field of their group, and its first one, which carries the counts on."""
    won = F.col("place") == 1
    for w in _WON:
        won = won | F.coalesce(F.col("place") == F.col(f"{w}.place"), F.lit(False))
    once = [F.when(F.col("place") == 1, F.col(c)).otherwise(0).alias(c) for c in ("records", "stales")]
    return fill(rows, keys).filter(won).select(*[c for c in rows.columns if c not in ("records", "stales")], *once)


def golden_records(clients: DataFrame, trust: Sequence[str] = TRUST, stale_hours: int = STALE_HOURS, slice_rows: int = SLICE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """One record per cluster: cluster_id, n_records, n_stale, the fields, and the client that each comes from."""
    slices = max(1, -(-clients.count() // slice_rows))
    rows = prepared(clients, trust)
    rows = rows.withColumn("slice", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "times"]), F.lit(slices)))
    facts = cluster_facts(rows.withColumn("latest", F.col("updated")), slices, fan_in)
    r, f = rows.alias("r"), facts.alias("f")
    known = r.join(f, F.col("r.cluster").eqNullSafe(F.col("f.cluster")) & (F.col("r.slice") == F.col("f.slice"))).select("r.*", "f.latest", "f.chosen")
    late = F.col("updated") < F.col("latest") - F.make_dt_interval(hours=F.lit(stale_hours))
    known = known.withColumn("stale", F.coalesce(late, F.lit(True)).cast("int"))
    known = known.withColumn("records", F.col("times")).withColumn("stales", F.col("times") * F.col("stale"))
    while slices > 1:
        known = survivors(known, ["cluster", "slice"])
        known = known.withColumn("slice", F.floor(F.col("slice") / fan_in))
        slices = -(-slices // fan_in)
    done = fill(known, ["cluster"]).filter("place = 1")
    some = F.col("by_address.city").isNotNull() | F.col("by_address.nation").isNotNull()
    return done.select(
        F.col("cluster").alias("cluster_id"),
        F.col("records").cast("long").alias("n_records"),
        F.col("stales").cast("long").alias("n_stale"),
        F.col("by_name.name").alias("name"),
        F.col("by_email.email").alias("email"),
        F.col("by_segment.segment").alias("segment"),
        F.col("by_address.city").alias("city"),
        F.col("by_address.nation").alias("nation_id"),
        F.col("by_balance.balance").alias("balance_cents"),
        F.col("by_name.client").alias("name_from"),
        F.col("by_email.client").alias("email_from"),
        F.col("by_segment.client").alias("segment_from"),
        F.col("by_balance.client").alias("balance_from"),
        F.when(some, F.col("by_address.client")).alias("address_from"),
    )


def op13_golden_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden_records(table(spark, sf_dir, "clients"))


#: The same over whole clusters.
OP13_SQL = r"""
WITH a AS (
  SELECT coalesce(master_id, client_id) AS cl, master_id, client_id, updated_at, source, nation_id,
    CASE source WHEN 'crm' THEN 0 WHEN 'web' THEN 1 WHEN 'store' THEN 2 WHEN 'partner' THEN 3 ELSE 4 END AS trust,
    CASE WHEN regexp_matches(name, '[^\x20\x09-\x0D]') THEN name END AS name,
    CASE WHEN regexp_matches(email, '[^\x20\x09-\x0D]') THEN email END AS email,
    CASE WHEN regexp_matches(city, '[^\x20\x09-\x0D]') THEN city END AS city,
    CASE WHEN regexp_matches(segment, '[^\x20\x09-\x0D]') THEN segment END AS segment,
    CAST(floor(100 * balance + 0.5) AS BIGINT) AS cents
  FROM clients
), b AS (
  SELECT *, coalesce(updated_at < max(updated_at) OVER (PARTITION BY cl) - INTERVAL 1440 HOUR, true) AS stale FROM a
), c AS (
  SELECT *, row_number() OVER (PARTITION BY cl ORDER BY updated_at DESC NULLS LAST, trust, client_id NULLS LAST, source NULLS LAST,
    name NULLS LAST, email NULLS LAST, city NULLS LAST, nation_id NULLS LAST, segment NULLS LAST, cents NULLS LAST, master_id NULLS LAST) AS place
  FROM b
), d AS (
  SELECT *, row_number() OVER (PARTITION BY cl ORDER BY stale, trust, place) AS rnk,
    first_value(segment IGNORE NULLS) OVER (PARTITION BY cl ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS chosen
  FROM c
), e AS (
  SELECT cl, count(*) AS n_records, count(*) FILTER (WHERE stale) AS n_stale,
    arg_min({'v': name, 'c': client_id}, {'a': -length(name), 'b': rnk}) FILTER (WHERE name IS NOT NULL) AS nm,
    arg_min({'v': email, 'c': client_id}, rnk) FILTER (WHERE email IS NOT NULL) AS em,
    arg_min({'v': segment, 'c': client_id}, place) FILTER (WHERE segment IS NOT NULL) AS sg,
    arg_min({'v': cents, 'c': client_id}, {'a': CAST(segment IS DISTINCT FROM chosen AS INT), 'b': place}) FILTER (WHERE cents IS NOT NULL) AS ba,
    arg_min({'v': city, 'n': nation_id, 'c': client_id},
      {'a': -(CAST(city IS NOT NULL AS INT) + CAST(nation_id IS NOT NULL AS INT)), 'b': rnk}) AS ad
  FROM d GROUP BY cl
)
SELECT cl AS cluster_id, n_records, n_stale, nm.v AS name, em.v AS email, sg.v AS segment, ad.v AS city, ad.n AS nation_id, ba.v AS balance_cents,
  nm.c AS name_from, em.c AS email_from, sg.c AS segment_from, ba.c AS balance_from,
  CASE WHEN ad.v IS NOT NULL OR ad.n IS NOT NULL THEN ad.c END AS address_from
FROM e
"""
