"""Relational operators over termbase tables (terms, associations), as DataFrame to DataFrame functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.schemas import DEFAULTS, EDITABLE

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def like(col: Column, query: str) -> Column:
    """Substring match folding ASCII case only; % and _ in the query are wildcards, a backslash is itself."""
    pattern = "%" + query.translate(str.maketrans(_UP, _LOW)).replace("\\", "\\\\") + "%"
    return F.translate(col, _UP, _LOW).like(pattern)


def search_associations(terms: DataFrame, associations: DataFrame, query: str, limit: int | None = 20) -> DataFrame:
    """Words related to the terms that match: word, type, source, score, best first."""
    hit = terms.filter(like(F.col("word"), query)).select(F.col("id").alias("term_id"))
    out = associations.join(hit, "term_id").select(F.col("related_word").alias("word"), F.col("relation_type").alias("type"), "source", "score")
    out = out.orderBy(F.col("score").desc(), "word", "type", "source")
    return out if limit is None else out.limit(limit)


def search_terms(terms: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Terms whose word, translation or domain matches, last updated first."""
    match = reduce(lambda a, b: a | b, [F.coalesce(like(F.col(c), query), F.lit(False)) for c in ("word", "translation", "domain")])
    return terms.filter(match).orderBy(F.col("updated_at").desc(), F.col("id").desc()).limit(limit)


def filter_by(terms: DataFrame, column: str, value: str, limit: int = 100) -> DataFrame:
    """Terms with the value in domain or status (case matters), by word."""
    return terms.filter(F.col(column) == value).orderBy("word", "id").limit(limit)


def with_status(terms: DataFrame, status: str | None) -> DataFrame:
    """An empty status is no filter."""
    return terms.filter(F.col("status") == status) if status else terms


def get_term(terms: DataFrame, term_id: int) -> DataFrame:
    return terms.filter(F.col("id") == term_id)


def associations_of(associations: DataFrame, term_id: int) -> DataFrame:
    return associations.filter(F.col("term_id") == term_id).orderBy(F.col("score").desc(), "id", "related_word", "relation_type")


def recent(terms: DataFrame, n: int = 10) -> DataFrame:
    return terms.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n).select("word", "translation", "status", "created_at")


def counts_by(terms: DataFrame) -> DataFrame:
    """One pass over terms: kind (domain, status, lang, total, confirmed), value, n."""
    g = terms.groupingSets([[F.col("domain")], [F.col("status")], [F.col("lang")], []], F.col("domain"), F.col("status"), F.col("lang"))
    g = g.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.grouping_id().alias("gid"))
    by = g.select(F.when(F.col("gid") == 3, "domain").when(F.col("gid") == 5, "status").when(F.col("gid") == 6, "lang").otherwise("total").alias("kind"), F.when(F.col("gid") == 3, F.col("domain")).when(F.col("gid") == 5, F.col("status")).when(F.col("gid") == 6, F.col("lang")).alias("value"), "n", "confirmed")
    kinds = F.when(F.col("kind") == "total", F.array(F.struct(F.col("kind").alias("kind"), F.col("n").alias("n")), F.struct(F.lit("confirmed").alias("kind"), F.col("confirmed").alias("n")))).otherwise(F.array(F.struct(F.col("kind").alias("kind"), F.col("n").alias("n"))))
    return by.select(F.explode(kinds).alias("x"), "value").select("x.kind", "value", "x.n")


def stats(terms: DataFrame, associations: DataFrame, name: str = "terms", domain: str = "") -> dict:
    """Collected statistics of one termbase; every part is bounded by the number of distinct values."""
    rows = counts_by(terms).collect()

    def by(kind: str) -> dict:
        got = sorted(((r["value"], r["n"]) for r in rows if r["kind"] == kind), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))
        return dict(got)

    one = {r["kind"]: r["n"] for r in rows if r["kind"] in ("total", "confirmed")}
    return {
        "name": name, "domain": domain, "total_terms": one.get("total", 0), "confirmed": one.get("confirmed", 0), "associations": associations.count(),
        "by_domain": by("domain"), "by_status": by("status"), "by_lang": by("lang"), "recent": [r.asDict() for r in recent(terms).collect()],
    }


def catalog(bases: dict[str, DataFrame]) -> DataFrame:
    """base, total_terms and langs (values by falling count, comma-joined) of every termbase."""
    return catalog_of(reduce(lambda a, b: a.unionByName(b), [df.select(F.lit(n).alias("base"), "lang") for n, df in sorted(bases.items())]))


def catalog_of(terms: DataFrame) -> DataFrame:
    """The catalog of terms(base, lang)."""
    by_lang = terms.groupBy("base", "lang").agg(F.count("*").alias("n"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "lang"))).alias("p")
    g = by_lang.groupBy("base").agg(F.sum("n").alias("total_terms"), ordered)
    return g.select("base", "total_terms", F.expr("array_join(transform(p, x -> x.lang), ', ')").alias("langs"))


def key_match(base: DataFrame) -> DataFrame:
    """Keys that an insert can meet: a null translation is never equal to anything."""
    return base.filter("translation is not null").select("word", "translation").distinct()


def new_rows(base: DataFrame, other: DataFrame, order: list[str], dedup: bool = True) -> DataFrame:
    """Rows of other that merging adds: not in base and the first of their key in other. Rows without a
    translation are always new."""
    if not dedup:
        return other
    w = Window.partitionBy("word", "translation").orderBy(*order)
    first = other.filter("translation is not null").withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")
    return first.join(key_match(base), ["word", "translation"], "left_anti").select(*other.columns).unionByName(other.filter("translation is null"))


def merge_counts(base: DataFrame, other: DataFrame, order: list[str], dedup: bool = True) -> DataFrame:
    """added, skipped, total_other in one row."""
    added = new_rows(base, other, order, dedup).agg(F.count("*").alias("added"))
    return added.join(other.agg(F.count("*").alias("total_other"))).select("added", (F.col("total_other") - F.col("added")).alias("skipped"), "total_other")


def normalise_import(rows: DataFrame) -> DataFrame:
    """Imported rows: word and translation stripped, blank words dropped, missing columns defaulted; a present but
    empty cell stays empty."""
    have = rows.columns
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    cols = []
    for c in EDITABLE:
        if c in have:
            v = F.coalesce(F.col(c), F.lit("")) if c in ("word", "translation") else F.col(c)
            cols.append((strip(v) if c in ("word", "translation") else v).alias(c))
        else:
            cols.append(F.lit(DEFAULTS.get(c, "")).alias(c))
    return rows.select(*cols, *[c for c in have if c not in EDITABLE]).filter("word <> ''")


def update_terms(terms: DataFrame, condition: Column, now: Column, **values: str) -> DataFrame:
    """terms with the allowed values set where condition holds, and updated_at with them; no allowed value, no change."""
    allowed = {k: v for k, v in values.items() if k in EDITABLE}
    if not allowed:
        return terms
    sets = {k: F.when(condition, F.lit(v)).otherwise(F.col(k)) for k, v in allowed.items()}
    return terms.withColumns({**sets, "updated_at": F.when(condition, now).otherwise(F.col("updated_at"))})


def delete_terms(terms: DataFrame, associations: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Both tables without the terms where condition holds and what hangs on them."""
    gone = terms.filter(condition).select(F.col("id").alias("term_id"))
    keep = terms.filter(~F.coalesce(condition, F.lit(False)))
    return keep, associations.join(gone, "term_id", "left_anti").select(*associations.columns)


def export_rows(terms: DataFrame, status: str | None = None) -> DataFrame:
    return with_status(terms, status).select("id", "word", "translation", "type", "domain", "status", "lang", "notes").orderBy("word", "id")


def tbx_rows(terms: DataFrame) -> DataFrame:
    """Exported entries: entry id, source and target language, notes where they say something."""
    t = terms.filter("word <> ''")
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    source = F.when(F.coalesce("lang", F.lit("")) == "", "en").otherwise(F.col("lang"))
    target = F.when(F.coalesce("translation", F.lit("")) == "", None).when(F.coalesce("lang", F.lit("")).isin("en", "auto"), "zh").otherwise("en")
    return t.select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("entry"), source.alias("source_lang"), "word", blank("type").alias("part_of_speech"), blank("domain").alias("subject_field"), blank("status").alias("status"), target.alias("target_lang"), F.when(F.col("translation") != "", F.col("translation")).alias("translation"))
