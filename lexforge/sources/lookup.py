"""Dictionary lookups: raw JSON responses flattened by from_json, federated with local results.

Sources are DictSource objects (sources/base.py); the three built-in ones register themselves here. Responses come from
a fetcher (term, endpoint) -> JSON text or None. Fetching is off unless a fetcher is given; http_fetch asks the sources
themselves. Flattening is plain DataFrame work: one projection per block of a response. Results can be kept: with a
cache folder, only terms without a kept response are asked for again.
"""

from __future__ import annotations

import hashlib
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.schemas import LOOKUP
from lexforge.sources.base import DictSource, item, known, register, rows, source
from lexforge.sources.files import Files
from lexforge.sources.shared import scratch, workers_import

_YOUDAO = "errorCode string, query string, translation array<string>, basic struct<explains: array<string>, `us-phonetic`: string, `uk-phonetic`: string>, web array<struct<key: string, value: array<string>>>"
_WEBSTER = "shortdef array<string>, meta struct<stems: array<string>, syns: array<array<string>>>"
_WIKIPEDIA = "type string, title string, extract string"
_RANK = {"youdao": 1, "webster": 2, "wikipedia": 3}


def _rows(df: DataFrame, items, name: str, block: int) -> DataFrame:
    return rows(df, items, _RANK[name], block)


_item = item


def _first(arr, limit: int):
    return F.slice(F.coalesce(arr, F.array().cast("array<string>")), 1, limit)


def flatten_youdao(raw: DataFrame, limit: int = 10) -> DataFrame:
    """raw(query, json): translations, explanations, phonetics and collocations of error-free responses."""
    d = raw.select("query", F.from_json("json", _YOUDAO).alias("d")).filter("d.errorCode = '0'")
    blank = F.lit("")
    tr = _rows(d, F.transform(_first(F.col("d.translation"), limit), lambda w: _item(w, "translation", "youdao", 0.95, F.coalesce(F.col("d.query"), F.col("query")))), "youdao", 0)
    ex = _rows(d, F.transform(_first(F.col("d.basic.explains"), limit), lambda w: _item(w, "explanation", "youdao", 0.85, blank)), "youdao", 1)
    ph = F.filter(F.array(*[_item(F.coalesce(F.col("d.basic")[f"{k}-phonetic"], blank), "phonetic", "youdao", 0.7, F.lit(k.upper())) for k in ("us", "uk")]), lambda x: x["word"] != "")
    web = F.flatten(F.transform(F.slice(F.coalesce(F.col("d.web"), F.array().cast("array<struct<key:string,value:array<string>>>")), 1, limit), lambda i: F.transform(_first(i["value"], 3), lambda v: _item(F.coalesce(i["key"], blank), "collocation", "youdao", 0.7, v))))
    return tr.unionByName(ex).unionByName(_rows(d, ph, "youdao", 2)).unionByName(_rows(d, web, "youdao", 3))


def flatten_webster(raw: DataFrame, limit: int = 10) -> DataFrame:
    """Definitions, roots and synonyms of the first entry, if it is an object."""
    entry = F.get_json_object("json", "$[0]")
    d = raw.select("query", F.when(F.ltrim(entry).startswith("{"), F.from_json(entry, _WEBSTER)).alias("d")).filter("d is not null")
    blank = F.lit("")
    de = _rows(d, F.transform(_first(F.col("d.shortdef"), limit), lambda w: _item(w, "definition", "webster", 0.9, w)), "webster", 0)
    ro = _rows(d, F.transform(_first(F.col("d.meta.stems"), limit), lambda w: _item(w, "root", "webster", 0.6, blank)), "webster", 1)
    sy = F.flatten(F.transform(F.coalesce(F.col("d.meta.syns"), F.array().cast("array<array<string>>")), lambda g: F.transform(_first(g, limit), lambda w: _item(w, "synonym", "webster", 0.75, blank))))
    return de.unionByName(ro).unionByName(_rows(d, sy, "webster", 2))


def flatten_wikipedia(raw: DataFrame, limit: int = 10) -> DataFrame:
    """raw(query, lang, json): a concept per language, English first; no disambiguation pages or empty extracts."""
    d = raw.select("query", "lang", F.from_json("json", _WIKIPEDIA).alias("d")).filter("coalesce(d.type, '') <> 'disambiguation' and coalesce(d.extract, '') <> ''")
    order = F.when(F.col("lang") == "en", 0).otherwise(1)
    out = d.select("query", F.coalesce("d.title", "query").alias("word"), F.lit("concept").alias("type"), F.concat(F.lit("wikipedia-"), "lang").alias("source"), F.lit(0.8).alias("score"), F.col("d.extract").alias("definition"), F.lit(_RANK["wikipedia"]).alias("source_rank"), order.cast("long").alias("ordinal"))
    # the English page alone when one result is asked for and it exists
    best = out.groupBy("query").agg(F.min("ordinal").alias("_first"))
    return out.join(best, "query").filter(F.col("ordinal") < F.col("_first") + max(1, limit)).drop("_first") if limit < 2 else out


def source_limit(limit: int) -> int:
    """Results asked of each source."""
    return max(1, limit // max(1, len(known())))


def federate(local: DataFrame | None, web: DataFrame | None, limit: int = 20, query_col: str = "query") -> DataFrame:
    """Local and web results of every query, by falling score, then source, then place; the best limit of each."""
    from pyspark.sql import Window

    parts = [p for p in (local, web) if p is not None]
    if not parts:
        raise ValueError("nothing to federate")
    u = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    w = Window.partitionBy(query_col).orderBy(F.col("score").desc(), "source_rank", "ordinal")
    return u.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def local_results(terms: DataFrame, associations: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Associations of matching terms in the lookup shape."""
    from pyspark.sql import Window

    from lexforge.operators.termbase import search_associations

    got = search_associations(terms, associations, query, limit)
    w = Window.orderBy(F.col("score").desc(), "word", "type", "source")
    return got.select(F.lit(query).alias("query"), "word", "type", "source", "score", F.lit(None).cast("string").alias("definition"), F.lit(0).alias("source_rank"), F.row_number().over(w).cast("long").alias("ordinal"))


def local_results_many(terms: DataFrame, associations: DataFrame, asked: DataFrame, limit: int = 20) -> DataFrame:
    """local_results() of every distinct query of asked(query), by one join."""
    from lexforge.operators.substring import search_associations_many

    got = search_associations_many(terms, associations, asked, limit)
    none = F.lit(None).cast("string").alias("definition")
    return got.select("query", "word", "type", "source", "score", none, F.lit(0).alias("source_rank"), F.col("place").alias("ordinal"))


# fetching

Fetcher = Callable[[str, str], str | None]


def available(name: str) -> bool:
    """Whether a source can be asked: it has a key, or needs none."""
    return source(name).available


def youdao_signature(key: str, term: str, salt: str, now: str, secret: str) -> str:
    return hashlib.sha256((key + term + salt + now + secret).encode()).hexdigest()


def signature_column(key: Column, term: Column, salt: Column, now: Column, secret: Column) -> Column:
    """youdao_signature() as a column."""
    return F.sha2(F.concat(key, term, salt, now, secret), 256)


def _get(url: str, wait: float) -> str | None:
    """The body of a 200 response, None for another one; what a second try may mend is raised."""
    ask = urllib.request.Request(url, headers={"User-Agent": "lexforge/0.1"})
    try:
        with urllib.request.urlopen(ask, timeout=wait) as r:  # noqa: S310
            return r.read().decode("utf-8") if r.status == 200 else None
    except urllib.error.HTTPError as e:
        if e.code == 429 or e.code >= 500:
            raise
        return None


class Youdao(DictSource):
    name, rank = "youdao", _RANK["youdao"]

    def fetch(self, term: str, page: str = "") -> str | None:
        salt, now = str(uuid.uuid4()), str(int(time.time()))
        sign = youdao_signature(self.key, term, salt, now, self.secret)
        args = {"q": term, "from": "auto", "to": "auto", "appKey": self.key, "salt": salt, "sign": sign, "signType": "v3", "curtime": now}
        return _get("https://openapi.youdao.com/api?" + urllib.parse.urlencode(args), 10)

    def flatten(self, raw: DataFrame, limit: int) -> DataFrame:
        return flatten_youdao(raw, limit)


class Webster(DictSource):
    name, rank = "webster", _RANK["webster"]

    def fetch(self, term: str, page: str = "") -> str | None:
        return _get(f"https://www.dictionaryapi.com/api/v3/references/collegiate/json/{urllib.parse.quote(term)}?key={self.key}", 10)

    def flatten(self, raw: DataFrame, limit: int) -> DataFrame:
        return flatten_webster(raw, limit)


class Wikipedia(DictSource):
    name, rank, needs_key = "wikipedia", _RANK["wikipedia"], False
    pages = ("en", "zh")

    def fetch(self, term: str, page: str = "") -> str | None:
        return _get(f"https://{page}.wikipedia.org/api/rest_v1/page/summary/{urllib.parse.quote(term.strip())}", 8)

    def flatten(self, raw: DataFrame, limit: int) -> DataFrame:
        return flatten_wikipedia(raw, limit)


for _s in (Youdao(), Webster(), Wikipedia()):
    register(_s)


def http_fetch(term: str, endpoint: str) -> str | None:
    """The response of a registered source's endpoint; None where there is none."""
    name, _, page = endpoint.partition("-")
    return source(name).fetch(term, page)


def fetch_all(asked: DataFrame, fetch: Fetcher, sources: list[DictSource], seconds: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """query, source, lang, json: the response of every source's pages to every query of asked(query), null where
    there is none. A source's queries are dealt out apart from the other sources', so a slow one doesn't hold them up;
    a task keeps to the source's rate, and waits twice as long before each further try of a failed request."""
    workers_import(asked.sparkSession)
    ends = F.array(*[F.struct(F.lit(s.name).alias("source"), F.lit(p).alias("lang")) for s in sources for p in s.pages])
    by = {s.name: s for s in sources}
    own = fetch is http_fetch  # sources fetch by themselves, also those that a worker hasn't registered

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        last: dict[str, float] = {}

        def one(q: str, name: str, page: str) -> str | None:
            s = by[name]
            for k in range(s.tries):
                wait = max(0.0, last.get(name, -1e9) + (2**k) / s.rate - seconds())
                if wait:
                    sleep(wait)
                last[name] = seconds()
                try:
                    return s.fetch(q, page) if own else fetch(q, s.endpoint(page))
                except Exception:  # noqa: BLE001  a lookup that fails to the end is an empty one
                    continue
            return None

        for b in batches:
            yield pd.DataFrame({"query": b["query"], "source": b["source"], "lang": b["lang"], "json": [one(*x) for x in zip(b["query"], b["source"], b["lang"], strict=True)]})

    # a range of terms and a source to a task
    pairs = asked.select("query", F.explode(ends).alias("e")).select("query", "e.source", "e.lang").repartitionByRange("source", "query")
    return pairs.mapInPandas(run, "query string, source string, lang string, json string")


def lookup(terms: DataFrame, fetch: Fetcher | None, limit: int = 20, cache: str | None = None, sources: list[DictSource] | None = None) -> DataFrame:
    """Web results for every distinct query in terms(query), of the sources that can be asked. Without a fetcher there
    are none. cache: a folder of kept responses; a query and page found there isn't asked for again, new responses
    (also that there is none) are added, and all are read from there, so nothing is fetched twice by one result."""
    spark: SparkSession = terms.sparkSession
    if fetch is None:
        return spark.createDataFrame([], LOOKUP)
    ask = [s for s in (known() if sources is None else sources) if s.available]
    if not ask:
        return spark.createDataFrame([], LOOKUP)
    asked = terms.select("query").filter("query is not null").distinct()
    kept = ResponseCache(spark, cache or scratch(spark, "responses"))
    kept.add(asked, fetch, ask)
    raw = kept.rows().join(asked, "query", "left_semi").filter("json is not null")
    per = source_limit(limit)
    out = None
    for s in ask:
        one = s.flatten(raw.filter(F.col("source") == s.name).select("query", "lang", "json"), per)
        out = one if out is None else out.unionByName(one)
    return out


class ResponseCache:
    """Kept responses: query, source, lang, json and when they came, as Parquet by source. A pair of query and page is
    kept once; a run adds what is missing and never writes over what is there."""

    SCHEMA = "query string, lang string, json string, fetched_at timestamp, source string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self) -> DataFrame:
        if not Files(self.spark).folders(self.path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def add(self, asked: DataFrame, fetch: Fetcher, sources: list[DictSource]) -> None:
        """Fetch and keep what isn't there yet of every source's pages."""
        have = self.rows()
        for s in sources:
            # pages of a source that are all there leave no query to ask for
            of = have.filter(F.col("source") == s.name).groupBy("query").agg(F.count_distinct("lang").alias("n")).filter(F.col("n") >= len(s.pages))
            new = fetch_all(asked.join(of, "query", "left_anti"), fetch, [s]).withColumn("fetched_at", F.current_timestamp())
            new = new.join(have.select("query", "source", "lang"), ["query", "source", "lang"], "left_anti")
            new.select("query", "lang", "json", "fetched_at", "source").write.mode("append").partitionBy("source").parquet(self.path)
