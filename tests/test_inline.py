"""Operators on Chinese and mixed texts and on dictionary responses that the given tables don't have."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lexforge.functions import text as tx
from lexforge.operators import terms as tm
from lexforge.plans import queries as q
from lexforge.sources import lookup as lk

CJK_DOCS = [
    (1, "本合同由甲方和乙方签订。合同条款规定了双方的责任；如有争议，提交仲裁。合同条款不得更改！合同条款有效吗？"),
    (2, "患者的诊断和治疗需要临床数据。医院使用AI辅助诊断系统，AI系统分析患者的症状。\n\n患者的治疗方案由医生决定。\n \t\n诊断系统提高效率。"),
    (3, "The software framework uses a database server. WebApplicationFactory and IWebHostBuilder configure the API server. Visit New York City for NASA news."),
    (4, "数据库服务器 The party of the first part signs the contract 合同 pursuant to clause four. 软件 software 接口 interface 算法."),
    (5, ""),
    (6, "Revenue\tand equity　rose!!! The fiscal audit... done? é AB ÀÉ US Treasury Bond and US Treasury Bond."),
    (7, "研究方法研究方法研究方法分析结论，实验理论实证摘要。" * 12),
    (8, "hello world " * 400 + "Mixed 内容分析内容分析内容分析内容分析内容分析" + "中文" * 2000),
]
VALUES = "(VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{t}')" for i, t in CJK_DOCS) + ") AS v(doc_id, text)"

YOUDAO_JSON = [
    ("server", '{"errorCode": "0", "query": "server", "translation": ["服务器", "服务员"], "basic": {"explains": ["n. 服务器", "n. 侍者", "n. 发球员"], "us-phonetic": "sɜrvər", "uk-phonetic": ""}, "web": [{"key": "Server", "value": ["服务器", "服务端", "伺服器", "多余"]}, {"key": "Web Server", "value": ["网页服务器"]}]}'),
    ("bad", '{"errorCode": "108", "translation": ["不"]}'),
    ("bare", '{"errorCode": "0", "translation": ["光"]}'),
]
WEBSTER_JSON = [
    ("audit", '[{"shortdef": ["a formal examination", "a review"], "meta": {"stems": ["audit", "audits", "audited"], "syns": [["check", "examination", "inspection"], ["review"]]}}, {"shortdef": ["second entry"]}]'),
    ("typo", '["autid", "audio"]'),
    ("none", "[]"),
    ("plain", '[{"shortdef": ["only"]}]'),
]
WIKI_JSON = [
    ("audit", "en", '{"type": "standard", "title": "Audit", "extract": "An audit is an examination."}'),
    ("audit", "zh", '{"type": "standard", "title": "审计", "extract": "审计是检查。"}'),
    ("mercury", "en", '{"type": "disambiguation", "title": "Mercury", "extract": "Mercury may refer to"}'),
    ("mercury", "zh", '{"type": "standard", "extract": "水银。"}'),
    ("empty", "en", '{"type": "standard", "title": "Empty", "extract": ""}'),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(CJK_DOCS, "doc_id long, text string")


def same(df, sql):
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    assert got == sorted(duckdb.sql(f"select {', '.join(cols)} from ({sql})").fetchall(), key=str)


def test_profile(docs):
    same(q._profile(docs), f"SELECT {q._FIELDS} FROM ({q._analysis_sql(VALUES)})")
    same(tx.analyze(docs).select("doc_id", F.explode_outer("domain_scores").alias("domain", "score")), f"WITH a AS ({q._analysis_sql(VALUES)}) {q._LONG}")
    assert [r["g"] for r in docs.select(tx.guess_language(F.col("text")).alias("g")).collect()] == ["zh", "zh", "en", "zh", "en", "en", "zh", "zh"]


def test_grams_and_terms(docs):
    same(tm.top_ngrams(docs, 30).select(*q._PICK), q._grams_sql(VALUES, q._CN, 3, 5, 30, 2))
    same(tm.top_bigrams(docs, 30).select(*q._PICK), q._grams_sql(VALUES, q._CN, 2, 2, 30, 1))
    same(tm.extract(docs, 30).withColumn("score", F.round("score", 9)), f"{q._ROUND} ({q._extract_sql(VALUES, 30)})")
    for kind, expr in enumerate((q._PHRASES, q._IDENT, q._ACRO)):
        same(tm.proper_nouns(docs).filter(F.col("kind") == kind).select("doc_id", "term"), f"SELECT doc_id, unnest({expr}) AS term FROM {VALUES}")


def found(df):
    return sorted((r["query"], r["type"], r["word"], r["definition"], r["ordinal"] % 1_000_000) for r in df.collect())


def test_responses(spark):
    raw = spark.createDataFrame(YOUDAO_JSON, "query string, json string")
    assert found(lk.flatten_youdao(raw, 2)) == sorted([
        ("bare", "translation", "光", "bare", 0), ("server", "translation", "服务器", "server", 0), ("server", "translation", "服务员", "server", 1),
        ("server", "explanation", "n. 服务器", "", 0), ("server", "explanation", "n. 侍者", "", 1), ("server", "phonetic", "sɜrvər", "US", 0),
        ("server", "collocation", "Server", "服务器", 0), ("server", "collocation", "Server", "服务端", 1), ("server", "collocation", "Server", "伺服器", 2), ("server", "collocation", "Web Server", "网页服务器", 3),
    ])
    raw = spark.createDataFrame(WEBSTER_JSON, "query string, json string")
    assert found(lk.flatten_webster(raw, 2)) == sorted([
        ("audit", "definition", "a formal examination", "a formal examination", 0), ("audit", "definition", "a review", "a review", 1), ("plain", "definition", "only", "only", 0),
        ("audit", "root", "audit", "", 0), ("audit", "root", "audits", "", 1), ("audit", "synonym", "check", "", 0), ("audit", "synonym", "examination", "", 1), ("audit", "synonym", "review", "", 2),
    ])
    raw = spark.createDataFrame(WIKI_JSON, "query string, lang string, json string")
    assert found(lk.flatten_wikipedia(raw)) == [("audit", "concept", "Audit", "An audit is an examination.", 0), ("audit", "concept", "审计", "审计是检查。", 1), ("mercury", "concept", "mercury", "水银。", 1)]
