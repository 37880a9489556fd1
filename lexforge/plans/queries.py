"""The engine's queries over the driver's tables, each beside its DuckDB SQL.

There is no termbase among the tables: terms derive from part and associations from lineitem, by the same SQL
in both engines; so do imported rows and dictionary responses. The tables hold no Chinese text either: conversations
with their letters mapped to Chinese characters exercise those operators.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import text as tx
from lexforge.functions.domains import DOMAIN_KEYWORDS, DOMAINS
from lexforge.functions.pieces import analyze_files, analyze_pieces
from lexforge.operators import export as ex
from lexforge.operators import keywords as kw
from lexforge.operators import newwords as nw
from lexforge.operators import report as rp
from lexforge.operators import substring as sub
from lexforge.operators import termbase as tb
from lexforge.operators import terms as tm
from lexforge.pipeline import first_translations, hit_count, result_summary
from lexforge.schemas import EDITABLE, EXPORTED
from lexforge.sources import lookup as lk
from lexforge.sources.base import DictSource, item, rows
from lexforge.sources.dictionary import dictionary, lookup_dictionary, write_dictionary
from lexforge.sources.shared import scratch
from lexforge.sources.store import Termbase, all_terms
from lexforge.streaming.intake import add_batch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# inputs

TERMS_SQL = """SELECT p_partkey AS id, p_name AS word, 'auto' AS lang, p_type AS type,
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat('T-', p_brand) END AS translation,
  CASE p_partkey % 6 WHEN 0 THEN 'legal' WHEN 1 THEN 'medical' WHEN 2 THEN 'finance' WHEN 3 THEN 'it' WHEN 4 THEN 'academic' ELSE '' END AS domain,
  CASE p_partkey % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'confirmed' ELSE 'deprecated' END AS status, '' AS notes,
  TIMESTAMP '2024-01-01 00:00:00' + p_partkey * INTERVAL '1' SECOND AS created_at,
  TIMESTAMP '2024-01-01 00:00:00' + (p_partkey * 7919 % 100003) * INTERVAL '1' SECOND AS updated_at FROM part"""
ASSOC_SQL = """SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS term_id, concat(l_returnflag, l_linestatus, '-', CAST(l_suppkey AS VARCHAR(20))) AS related_word,
  CASE l_linenumber % 3 WHEN 0 THEN 'synonym' WHEN 1 THEN 'collocation' ELSE 'translation' END AS relation_type, 1.0 - l_discount AS score, 'manual' AS source FROM lineitem"""


def derived(spark: SparkSession, sf: str, sql: str, table: str) -> DataFrame:
    """The rows of sql, which reads one of the given tables."""
    plain = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(plain.replace(f"FROM {table}", f"FROM {{{table}}}"), **{table: read(spark, sf, table)})


def terms_of(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, TERMS_SQL, "part")


def assoc_of(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, ASSOC_SQL, "lineitem")


#: Letters, and the Chinese characters that take their place; many pairs are domain keywords.
_LETTERS, _HANZI = "etaonirshldcumfpgwybvkxjqz", "合同患者诊断资产软件研究方法条款责任临床收入系统算法"
#: All letters, vowels alone, or all letters with full-width marks, and blank lines after sentences, by turn.
CJK_SQL = f"""SELECT conv_id * 1000 + turn AS doc_id, CASE turn % 4
  WHEN 0 THEN translate(lower(text), '{_LETTERS}', '{_HANZI}')
  WHEN 1 THEN translate(text, 'aeiou', '患合断者方')
  WHEN 2 THEN replace(replace(translate(lower(text), '{_LETTERS}', '{_HANZI}'), '.', '。'), ',', '；')
  ELSE concat(replace(text, '. ', concat('.', chr(10), ' ', chr(10))), ' Chat', upper(substring(role, 1, 1)), substring(role, 2, 20), '.') END AS text FROM conversations"""
CJK_SOURCE = f"({CJK_SQL}) AS v"


def cjk_docs(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, CJK_SQL, "conversations")


# document profile (regular expressions in DuckDB's dialect; its \\s is ASCII)


def _analysis_sql(source: str) -> str:
    scores = {d: "least(1.0::DOUBLE, (" + " + ".join(f"contains(low, '{w}')::INT" for w in ws) + f")::DOUBLE / {max(1, len(ws) * 0.1)!r}::DOUBLE)" for d, ws in DOMAIN_KEYWORDS.items()}
    best = "CASE WHEN greatest(" + ", ".join(f"s_{d}" for d in DOMAINS) + ") < 0.1::DOUBLE THEN 'general' " + " ".join(f"WHEN s_{d} = greatest(" + ", ".join(f"s_{x}" for x in DOMAINS) + f") THEN '{d}'" for d in DOMAINS) + " END"
    return f"""SELECT *, CASE WHEN pts >= 4 THEN 'hard' WHEN pts >= 2 THEN 'medium' ELSE 'easy' END AS difficulty FROM (
  SELECT *, (CASE WHEN sentences > 0 AND chars_no_space / sentences::DOUBLE > 80 THEN 2 WHEN sentences > 0 AND chars_no_space / sentences::DOUBLE > 50 THEN 1 ELSE 0 END
    + CASE WHEN lang = 'mixed' THEN 1 ELSE 0 END + CASE WHEN domain = 'general' THEN 0 ELSE 1 END
    + CASE WHEN words_cn + words_en > 5000 THEN 2 WHEN words_cn + words_en > 1000 THEN 1 ELSE 0 END) AS pts FROM (
  SELECT *, {best} AS domain,
    CASE WHEN lang = 'zh' THEN len(regexp_extract_all(text, '[。？！；]')) ELSE len(regexp_extract_all(text, '[.!?]+')) END AS sentences FROM (
  SELECT *, CASE WHEN cn + en = 0 THEN 'unknown' WHEN cn / (cn + en)::DOUBLE > 0.7::DOUBLE THEN 'zh' WHEN cn / (cn + en)::DOUBLE < 0.3::DOUBLE THEN 'en' ELSE 'mixed' END AS lang,
    length(text) AS chars_total, length(replace(replace(text, ' ', ''), chr(10), '')) AS chars_no_space,
    greatest(1, trunc(cn / 1.5::DOUBLE)::BIGINT) AS words_cn, len(regexp_extract_all(text, '[a-zA-Z]+')) AS words_en,
    len(list_filter(regexp_split_to_array(text, '\\n[\\s\\p{{Z}}]*\\n'), lambda p: regexp_matches(p, '[^\\s\\p{{Z}}]'))) AS paragraphs,
    {", ".join(f"{x} AS s_{d}" for d, x in scores.items())} FROM (
  SELECT doc_id, text, lower(text) AS low, len(regexp_extract_all(text, '[一-鿿]')) AS cn, len(regexp_extract_all(text, '[a-zA-Z]')) AS en FROM {source}))))"""


_FIELDS = "doc_id, lang, chars_total, chars_no_space, words_cn, words_en, paragraphs, sentences, domain, difficulty"


def _profile(docs: DataFrame) -> DataFrame:
    return tx.analyze(docs.select("doc_id", "text")).select(*_FIELDS.split(", "))


@query("analyze_documents", f"SELECT {_FIELDS} FROM ({_analysis_sql('documents')})")
def _(spark, sf):
    return _profile(read(spark, sf, "documents"))


@query("analyze_inline", f"SELECT {_FIELDS} FROM ({_analysis_sql(CJK_SOURCE)})")
def _(spark, sf):
    return _profile(cjk_docs(spark, sf))


@query("analyze_conversations", f"SELECT {_FIELDS}, turn FROM (SELECT a.*, doc_id % 1000 AS turn FROM ({_analysis_sql('(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)')}) a)")
def _(spark, sf):
    docs = read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return _profile(docs).withColumn("turn", F.col("doc_id") % 1000)


@query("language_distribution", f"SELECT lang, count(*) AS n FROM ({_analysis_sql('documents')}) GROUP BY lang")
def _(spark, sf):
    return _profile(read(spark, sf, "documents")).groupBy("lang").agg(F.count("*").alias("n"))


@query("difficulty_distribution", f"SELECT domain, difficulty, count(*) AS n FROM ({_analysis_sql('documents')}) GROUP BY ALL")
def _(spark, sf):
    return _profile(read(spark, sf, "documents")).groupBy("domain", "difficulty").agg(F.count("*").alias("n"))


@query("analyze_pieces", f"SELECT {_FIELDS} FROM ({_analysis_sql('documents')})")
def _(spark, sf):
    """The same profiles from pieces of a hundred characters."""
    # a long text is neither copied nor passed over for each of its pieces
    cut = F.regexp_extract_all("text", F.lit("(?s).{1,100}"), 0)
    pieces = read(spark, sf, "documents").select("doc_id", F.posexplode_outer(cut).alias("piece", "text")).withColumn("piece", F.coalesce("piece", F.lit(0)))
    return analyze_pieces(pieces).select(*_FIELDS.split(", "))


_LONG = " UNION ALL ".join(f"SELECT doc_id, '{d}' AS domain, s_{d} AS score FROM a" for d in DOMAINS)


@query("domain_scores_long", f"WITH a AS ({_analysis_sql(CJK_SOURCE)}) {_LONG}")
def _(spark, sf):
    return tx.analyze(cjk_docs(spark, sf)).select("doc_id", F.explode_outer("domain_scores").alias("domain", "score"))


# explode_outer: explode would add a filter on the map's size, which repeats every keyword search
@query("domain_scores_documents", f"WITH a AS ({_analysis_sql('documents')}) {_LONG}")
def _(spark, sf):
    return tx.analyze(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.explode_outer("domain_scores").alias("domain", "score"))


@query("paragraph_sentence_counts", f"SELECT doc_id, paragraphs, sentences FROM ({_analysis_sql('documents')})")
def _(spark, sf):
    return _profile(read(spark, sf, "documents")).select("doc_id", "paragraphs", "sentences")


@query("word_counts", f"SELECT doc_id, words_cn, words_en FROM ({_analysis_sql('documents')})")
def _(spark, sf):
    return _profile(read(spark, sf, "documents")).select("doc_id", "words_cn", "words_en")


@query("chars_no_space", f"SELECT doc_id, chars_total, chars_no_space FROM ({_analysis_sql('documents')})")
def _(spark, sf):
    return _profile(read(spark, sf, "documents")).select("doc_id", "chars_total", "chars_no_space")


@query("guess_language", "SELECT doc_id, CASE WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' ELSE 'en' END AS guessed FROM " + CJK_SOURCE)
def _(spark, sf):
    return cjk_docs(spark, sf).select("doc_id", tx.guess_language(F.col("text")).alias("guessed"))


# keyword tables

_NAMES = "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS keyword FROM part"
_TYPES = "SELECT DISTINCT lower(p_type) AS domain, unnest(string_split(p_name, ' ')) AS keyword FROM part"


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("keyword")).distinct()


@query("keyword_table_hits", f"SELECT DISTINCT doc_id, keyword FROM documents JOIN ({_NAMES}) ON contains(text, keyword)")
def _(spark, sf):
    return kw.keyword_hits(read(spark, sf, "documents"), _names(spark, sf))


@query("keyword_table_joined", f"SELECT DISTINCT doc_id, keyword FROM (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations) JOIN ({_NAMES}) ON contains(text, keyword)")
def _(spark, sf):
    """By the join on grams, as for tables too large to broadcast."""
    docs = read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return kw.keyword_hits(docs, _names(spark, sf), most_bytes=0)


@query("keyword_table_scores", f"""SELECT doc_id, domain, count(*) AS hits, least(1.0::DOUBLE, count(*)::DOUBLE / greatest(1.0::DOUBLE, any_value(n) * 0.1::DOUBLE)) AS score
  FROM (SELECT DISTINCT doc_id, domain, keyword, n FROM documents JOIN (SELECT *, count(*) OVER (PARTITION BY domain) AS n FROM ({_TYPES})) ON contains(lower(text), keyword)) GROUP BY doc_id, domain""")
def _(spark, sf):
    lists = read(spark, sf, "part").select(F.lower("p_type").alias("domain"), F.explode(F.split("p_name", " ")).alias("keyword")).distinct()
    return kw.keyword_scores(read(spark, sf, "documents"), lists)


# proper nouns

_W = r"[^\p{L}\p{N}_]"
_PHRASES = rf"list_distinct(regexp_extract_all(regexp_replace(text, '([^\p{{L}}\p{{N}}_\s])', '\1\1', 'g'), '(?:^|{_W})([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)(?:{_W}|$)', 1))"
_IDENT = rf"list_distinct(list_filter(regexp_split_to_array(text, '{_W}+'), lambda w: regexp_full_match(w, '(?:[A-Z][a-z]+){{2,}}|[A-Z][a-zA-Z]*[a-z][A-Z][a-zA-Z]*') AND length(w) > 4))"
_ACRO = rf"list_distinct(list_filter(regexp_split_to_array(text, '{_W}+'), lambda w: regexp_full_match(w, '[A-Z]{{2,5}}')))"


def _nouns_sql(source: str) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, unnest({x}) AS term, {k} AS kind FROM {source}" for k, x in enumerate((_PHRASES, _IDENT, _ACRO)))


for _name, _kind, _expr in (("proper_noun_phrases", 0, _PHRASES), ("identifiers", 1, _IDENT), ("acronyms", 2, _ACRO)):
    _src = f"(SELECT doc_id, text FROM documents UNION ALL SELECT 10000000000 + doc_id, text FROM {CJK_SOURCE})"

    @query(_name, f"SELECT doc_id, unnest({_expr}) AS term FROM {_src}")
    def _(spark, sf, kind=_kind):
        docs = read(spark, sf, "documents").select("doc_id", "text").unionByName(cjk_docs(spark, sf).withColumn("doc_id", F.col("doc_id") + 10_000_000_000))
        return tm.proper_nouns(docs).filter(F.col("kind") == kind).select("doc_id", "term")


@query("proper_nouns_pages", f"SELECT doc_id, term, kind FROM ({_nouns_sql('(SELECT page_id AS doc_id, html AS text FROM pages)')})")
def _(spark, sf):
    return tm.proper_nouns(read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))


# n-grams


def _grams_sql(source: str, chars: str, lo: int, hi: int, k: int, least: int) -> str:
    return f"""SELECT doc_id, n, gram AS term, frequency, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY frequency DESC, first_pos) AS place FROM (
  SELECT doc_id, n, substring(c, pos, n) AS gram, count(*) AS frequency, min(pos) AS first_pos FROM (SELECT doc_id, {chars} AS c FROM {source}) s, range({lo}, {hi + 1}) r(n), LATERAL (SELECT unnest(range(1, length(c) - n + 2)) AS pos)
  GROUP BY doc_id, n, gram)) WHERE place <= {k} AND frequency >= {least}"""


_CN = "regexp_replace(text, '[^一-鿿]', '', 'g')"
_PICK = ["doc_id", "n", "term", "frequency", "place"]


@query("ngram_topn_cjk", _grams_sql(CJK_SOURCE, _CN, 3, 5, 30, 2))
def _(spark, sf):
    return tm.top_ngrams(cjk_docs(spark, sf), 30).select(*_PICK)


@query("bigram_topn_cjk", _grams_sql(CJK_SOURCE, _CN, 2, 2, 30, 1))
def _(spark, sf):
    return tm.top_bigrams(cjk_docs(spark, sf), 30).select(*_PICK)


@query("ngram_topn_generic", _grams_sql("(SELECT item_id AS doc_id, text FROM benchmark)", "regexp_replace(lower(text), '[^a-z]', '', 'g')", 3, 5, 30, 2))
def _(spark, sf):
    docs = read(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return tm.top_ngrams(docs, 30, chars=F.regexp_replace(F.lower("text"), "[^a-z]", "")).select(*_PICK)


# extraction


def _extract_sql(source: str, k: int) -> str:
    total = f"SELECT doc_id, n, greatest(0, length(c) - n + 1)::DOUBLE AS total FROM (SELECT doc_id, {_CN} AS c FROM {source}) s, range(2, 6) r(n)"
    return f"""WITH bi AS ({_grams_sql(source, _CN, 2, 2, k, 1)}), ng AS ({_grams_sql(source, _CN, 3, 5, k, 2)}), t AS ({total}),
u AS (SELECT bi.doc_id, term, frequency, frequency / total AS score, 'bigram' AS word_type, place AS ord FROM bi JOIN t ON bi.doc_id = t.doc_id AND bi.n = t.n
  UNION ALL SELECT ng.doc_id, term, frequency, (frequency / total) * (ng.n * 0.3::DOUBLE), 'ngram', ng.n * 1000000 + place FROM ng JOIN t ON ng.doc_id = t.doc_id AND ng.n = t.n
  UNION ALL SELECT doc_id, term, 1, 0.0::DOUBLE, 'proper_noun', 10000000 + kind FROM ({_nouns_sql(source)})),
g AS (SELECT doc_id, lower(term) AS key, list(struct_pack(ord := ord, term := term, word_type := word_type, score := score, frequency := frequency) ORDER BY ord, term) AS p FROM u GROUP BY ALL),
m AS (SELECT doc_id, p[1].term AS term, list_sum(list_transform(p, lambda x: x.frequency))::BIGINT AS frequency, list_sum(list_transform(p, lambda x: x.score)) AS score, p[1].word_type AS word_type, p[1].ord AS ord FROM g)
SELECT doc_id, term, frequency, score, word_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord, term) AS rank FROM m) WHERE rank <= {k}"""


_ROUND = "SELECT doc_id, term, frequency, round(score, 9) AS score, word_type, rank FROM"


@query("extract_terms", f"{_ROUND} ({_extract_sql(CJK_SOURCE, 30)})")
def _(spark, sf):
    return tm.extract(cjk_docs(spark, sf), 30).withColumn("score", F.round("score", 9))


@query("extract_terms_documents", f"{_ROUND} ({_extract_sql('documents', 30)})")
def _(spark, sf):
    return tm.extract(read(spark, sf, "documents"), 30).withColumn("score", F.round("score", 9))


@query("terms_by_type", f"SELECT doc_id, word_type, min(rank) AS first_rank, array_to_string(list(term ORDER BY rank)[1:10], ', ') AS terms FROM ({_extract_sql(CJK_SOURCE, 30)}) GROUP BY ALL")
def _(spark, sf):
    return tm.terms_by_type(tm.extract(cjk_docs(spark, sf), 30))


_TOKENS = f"""SELECT doc_id, unnest(list_concat(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 2 AND w NOT IN ({", ".join(f"'{w}'" for w in tm.STOPWORDS)})),
  CASE WHEN length({_CN}) >= 2 THEN list_transform(range(1, length({_CN})), lambda i: substring({_CN}, i, 2)) ELSE [] END)) AS token FROM documents"""


@query("tfidf_keywords", f"""WITH w AS ({_TOKENS}), tf AS (SELECT doc_id, token, count(*) AS tf FROM w GROUP BY ALL), z AS (SELECT doc_id, sum(tf) AS size FROM tf GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT doc_id, token, tf, tf / size::DOUBLE * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)::DOUBLE) + 1) AS score FROM tf JOIN z USING (doc_id) JOIN df USING (token))
SELECT doc_id, term, tf, round(score, 9) AS score FROM (SELECT doc_id, token AS term, tf, score, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, token) AS place FROM s) WHERE place <= 10""")
def _(spark, sf):
    return tm.tfidf_keywords(read(spark, sf, "documents").select("doc_id", "text"), 10).select("doc_id", "term", "tf", F.round("score", 9).alias("score"))


def _new_words_sql(source: str, pattern: str, text: str, longest: int, least: int, pmi: float, entropy: float) -> str:
    side = """SELECT gram, ln(sum(n)::DOUBLE) - sum(n * ln(n::DOUBLE)) / sum(n) AS h FROM (SELECT gram, {0}, sum(n) AS n FROM g GROUP BY ALL) GROUP BY gram"""
    return f"""WITH r AS (SELECT run, count(*) AS times FROM (SELECT unnest(regexp_extract_all({text}, '{pattern}')) AS run FROM {source}) GROUP BY run),
g AS (SELECT gram, l, r, sum(times) AS n FROM (SELECT times, substring(run, i, k) AS gram, CASE WHEN i > 1 THEN substring(run, i - 1, 1) ELSE '' END AS l, substring(run, i + k, 1) AS r
  FROM r, range(1, {longest + 1}) t(k), LATERAL (SELECT unnest(range(1, length(run) - k + 2)) AS i)) GROUP BY ALL),
z AS (SELECT length(gram) AS size, sum(n) AS total FROM g GROUP BY ALL),
c AS (SELECT gram, sum(n) AS n, sum(n) / any_value(total)::DOUBLE AS p FROM g JOIN z ON size = length(gram) GROUP BY gram HAVING sum(n) >= {least}),
m AS (SELECT c.gram, min(ln(c.p / (a.p * b.p))) AS pmi FROM c, range(1, {longest}) t(k) JOIN c a ON a.gram = substring(c.gram, 1, k) JOIN c b ON b.gram = substring(c.gram, k + 1) WHERE k < length(c.gram) GROUP BY c.gram)
SELECT m.gram AS word, c.n AS frequency, round(pmi, 6) AS pmi, round(x.h, 6) AS left_entropy, round(y.h, 6) AS right_entropy FROM m JOIN c ON c.gram = m.gram
  JOIN ({side.format("l")}) x ON x.gram = m.gram JOIN ({side.format("r")}) y ON y.gram = m.gram WHERE pmi >= {pmi} AND least(x.h, y.h) >= {entropy}"""


def _found_words(df: DataFrame) -> DataFrame:
    return df.select("word", F.col("frequency").cast("long").alias("frequency"), *[F.round(c, 6).alias(c) for c in ("pmi", "left_entropy", "right_entropy")])


@query("new_words", f"SELECT word, frequency::BIGINT AS frequency, pmi, left_entropy, right_entropy FROM ({_new_words_sql('documents', '[a-z]+', 'lower(text)', 4, 20, 1.0, 1.5)})")
def _(spark, sf):
    return _found_words(nw.new_words(read(spark, sf, "documents"), 4, 20, 1.0, 1.5, "[a-z]+", F.lower("text")))


@query("new_words_cjk", f"SELECT word, frequency::BIGINT AS frequency, pmi, left_entropy, right_entropy FROM ({_new_words_sql(CJK_SOURCE, '[一-鿿]+', 'text', 4, 5, 1.0, 0.5)})")
def _(spark, sf):
    return _found_words(nw.new_words(cjk_docs(spark, sf), 4, 5, 1.0, 0.5))


# termbase


def _like(col: str, q: str) -> str:
    # ASCII folding on both sides; no escape character
    low = q.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return f"translate({col}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%{low}%'"


_T, _A = f"({TERMS_SQL})", f"({ASSOC_SQL})"
_TS = "id, word, lang, type, translation, domain, status, notes, created_at, updated_at"


@query("term_search", f"SELECT related_word AS word, relation_type AS type, source, a.score FROM {_A} a JOIN {_T} t ON t.id = a.term_id WHERE {_like('t.word', 'A_e')} ORDER BY a.score DESC, word, type, source LIMIT 20")
def _(spark, sf):
    return tb.search_associations(terms_of(spark, sf), assoc_of(spark, sf), "A_e", 20)


@query("term_search_words", f"SELECT {_TS} FROM {_T} WHERE {_like('word', 'EGAL')} OR {_like('translation', 'EGAL')} OR {_like('domain', 'EGAL')} ORDER BY updated_at DESC, id DESC LIMIT 20")
def _(spark, sf):
    return tb.search_terms(terms_of(spark, sf), "EGAL", 20)


# many searches at once

_BENCH_WORDS = "SELECT DISTINCT unnest(regexp_split_to_array(text, '[^\\p{L}]+')) AS pattern FROM benchmark"
_KINDS = "SELECT DISTINCT unnest(string_split(lower(concat(p_name, ' ', p_type)), ' ')) AS query FROM part"


def _bench_words(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select(F.explode(F.split("text", "[^\\p{L}]+", -1)).alias("pattern")).distinct()


def _kinds(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("query")).distinct()


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HITS = f"{_FOLD.format('{0}')} LIKE concat('%', {_FOLD.format('{1}')}, '%')"


@query("substring_matches", f"SELECT pattern, p_name AS word, count(*) AS n FROM part JOIN ({_BENCH_WORDS}) ON {_HITS.format('p_name', 'pattern')} GROUP BY ALL")
def _(spark, sf):
    found = sub.search_many(read(spark, sf, "part").select("p_name"), "p_name", _bench_words(spark, sf))
    return found.groupBy("pattern", F.col("p_name").alias("word")).agg(F.count("*").alias("n"))


@query("substring_patterns", f"""SELECT pattern, word, count(*) AS n FROM (SELECT p_name AS word FROM part) JOIN (SELECT DISTINCT concat(upper(substring(p_name, 1, 2)), '_', substring(p_name, 4, 2), '%', right(p_name, 2)) AS pattern FROM part)
  ON {_HITS.format("word", "pattern")} GROUP BY ALL""")
def _(spark, sf):
    names = read(spark, sf, "part").select(F.col("p_name").alias("word"))
    wild = names.select(F.concat(F.upper(F.substring("word", 1, 2)), F.lit("_"), F.substring("word", 4, 2), F.lit("%"), F.expr("right(word, 2)")).alias("pattern"))
    return sub.search_many(names, "word", wild).groupBy("pattern", "word").agg(F.count("*").alias("n"))


@query("batch_term_search", f"""SELECT query, place, id, word FROM (SELECT query, id, word, row_number() OVER (PARTITION BY query ORDER BY updated_at DESC, id DESC) AS place
  FROM {_T} t JOIN ({_KINDS}) ON {_HITS.format("word", "query")} OR {_HITS.format("translation", "query")} OR {_HITS.format("domain", "query")}) WHERE place <= 20""")
def _(spark, sf):
    return sub.search_terms_many(terms_of(spark, sf), _kinds(spark, sf), 20).select("query", "place", "id", "word")


@query("batch_search", f"""SELECT query, word, type, source, score, place FROM (SELECT query, related_word AS word, relation_type AS type, source, a.score, row_number() OVER (PARTITION BY query ORDER BY a.score DESC, related_word, relation_type, source) AS place
  FROM {_A} a JOIN {_T} t ON t.id = a.term_id JOIN ({_KINDS}) ON {_HITS.format("t.word", "query")}) WHERE place <= 5""")
def _(spark, sf):
    return sub.search_associations_many(terms_of(spark, sf), assoc_of(spark, sf), _kinds(spark, sf), 5)


@query("filter_domain", f"SELECT {_TS} FROM {_T} WHERE domain = 'it' ORDER BY word, id LIMIT 100")
def _(spark, sf):
    return tb.filter_by(terms_of(spark, sf), "domain", "it", 100)


@query("filter_status", f"SELECT {_TS} FROM {_T} WHERE status = 'confirmed' ORDER BY word, id LIMIT 100")
def _(spark, sf):
    return tb.filter_by(terms_of(spark, sf), "status", "confirmed", 100)


@query("term_point_lookup", f"SELECT {_TS} FROM {_T} WHERE id = 42")
def _(spark, sf):
    return tb.get_term(terms_of(spark, sf), 42)


@query("associations_of_term", f"SELECT id, term_id, related_word, relation_type, score, source FROM {_A} WHERE term_id = 42")
def _(spark, sf):
    return tb.associations_of(assoc_of(spark, sf), 42)


for _kind in ("domain", "status", "lang"):

    @query(f"stats_by_{_kind}", f"SELECT {_kind} AS value, count(*) AS n FROM {_T} GROUP BY {_kind}")
    def _(spark, sf, kind=_kind):
        return tb.counts_by(terms_of(spark, sf)).filter(F.col("kind") == kind).select("value", "n")


@query("stats_totals", f"SELECT 'total' AS kind, count(*) AS n FROM {_T} UNION ALL SELECT 'confirmed', count(*) FROM {_T} WHERE status = 'confirmed' UNION ALL SELECT 'associations', count(*) FROM {_A}")
def _(spark, sf):
    one = tb.counts_by(terms_of(spark, sf)).filter(F.col("kind").isin("total", "confirmed")).select("kind", "n")
    return one.unionByName(assoc_of(spark, sf).agg(F.count("*").alias("n")).select(F.lit("associations").alias("kind"), "n"))


@query("recent_terms", f"SELECT word, translation, status, created_at FROM {_T} ORDER BY created_at DESC, id DESC LIMIT 10")
def _(spark, sf):
    return tb.recent(terms_of(spark, sf))


_BASES = f"(SELECT 'a' AS base, * FROM {_T} WHERE id % 3 <> 0 UNION ALL SELECT 'b', * FROM {_T} WHERE id % 2 = 0)"


def _two(spark, sf) -> tuple[DataFrame, DataFrame]:
    t = terms_of(spark, sf)
    return t.filter("id % 3 <> 0"), t.filter("id % 2 = 0")


@query("termbase_catalog", f"SELECT base, sum(n)::BIGINT AS total_terms, array_to_string(list(lang ORDER BY n DESC, lang), ', ') AS langs FROM (SELECT base, lang, count(*) AS n FROM {_BASES} GROUP BY ALL) GROUP BY base")
def _(spark, sf):
    a, b = _two(spark, sf)
    return tb.catalog({"a": a, "b": b})


_NEW = f"""SELECT id, word, translation, nth, EXISTS (SELECT 1 FROM {_T} a WHERE a.id % 3 <> 0 AND a.word = b.word AND a.translation = b.translation) AS known
  FROM (SELECT *, row_number() OVER (PARTITION BY word, translation ORDER BY id) AS nth FROM {_T} WHERE id % 2 = 0) b"""


@query("merge_anti", f"SELECT id, word, translation FROM ({_NEW}) WHERE nth = 1 AND NOT known")
def _(spark, sf):
    a, b = _two(spark, sf)
    return tb.new_rows(a, b, ["id"]).select("id", "word", "translation")


@query("merge_skipped", f"SELECT id, word, translation FROM ({_NEW}) WHERE nth > 1 OR known")
def _(spark, sf):
    a, b = _two(spark, sf)
    return b.join(tb.new_rows(a, b, ["id"]).select("id"), "id", "left_anti").select("id", "word", "translation")


@query("merge_counts", f"SELECT count(*) FILTER (nth = 1 AND NOT known) AS added, count(*) FILTER (nth > 1 OR known) AS skipped, count(*) AS total_other FROM ({_NEW})")
def _(spark, sf):
    a, b = _two(spark, sf)
    return tb.merge_counts(a, b, ["id"])


#: Rows as a file has them: white space around, blank words, missing translations and domains, repeated keys.
_IMPORT_SQL = """SELECT p_partkey AS line, CASE WHEN p_partkey % 50 = 0 THEN '   ' WHEN p_partkey % 4 = 0 THEN concat(' ', p_name, chr(9)) ELSE p_name END AS word,
  CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN concat(p_brand, '  ') ELSE p_brand END AS translation,
  CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_type END AS domain FROM part"""
_KNOWN_SQL = "SELECT p_name AS word, p_brand AS translation FROM part WHERE p_size < 10"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query("import_dedup", f"""SELECT word, translation, domain, 'auto' AS lang, 'draft' AS status, line FROM (
  SELECT *, row_number() OVER (PARTITION BY word, translation ORDER BY line) AS nth FROM (
    SELECT line, {_STRIP.format("word")} AS word, {_STRIP.format("coalesce(translation, '')")} AS translation, domain FROM ({_IMPORT_SQL})) WHERE word <> '') r
  WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM ({_KNOWN_SQL}) k WHERE k.word = r.word AND k.translation = r.translation)""")
def _(spark, sf):
    rows = tb.normalise_import(derived(spark, sf, _IMPORT_SQL, "part"))
    base = derived(spark, sf, _KNOWN_SQL, "part")
    return tb.new_rows(base, rows, ["line"]).select("word", "translation", "domain", "lang", "status", "line")


@query("delete_cascade", f"SELECT 'terms' AS part, count(*) AS n FROM {_T} WHERE id % 10 <> 0 UNION ALL SELECT 'associations', count(*) FROM {_A} WHERE term_id % 10 <> 0")
def _(spark, sf):
    t, a = tb.delete_terms(terms_of(spark, sf), assoc_of(spark, sf), F.col("id") % 10 == 0)
    return t.agg(F.count("*").alias("n")).select(F.lit("terms").alias("part"), "n").unionByName(a.agg(F.count("*").alias("n")).select(F.lit("associations").alias("part"), "n"))


@query("update_terms", f"SELECT id, word, CASE WHEN id % 5 = 0 THEN 'deprecated' ELSE status END AS status, CASE WHEN id % 5 = 0 THEN TIMESTAMP '2025-01-01 00:00:00' ELSE updated_at END AS updated_at FROM {_T}")
def _(spark, sf):
    return tb.update_terms(terms_of(spark, sf), F.col("id") % 5 == 0, F.expr("timestamp '2025-01-01 00:00:00'"), status="deprecated", no_such="x").select("id", "word", "status", "updated_at")


# exports


@query("export_rows", f"SELECT id, word, translation, type, domain, status, lang, notes FROM {_T} WHERE status = 'confirmed'")
def _(spark, sf):
    return tb.export_rows(terms_of(spark, sf), "confirmed")


@query("tbx_rows", f"SELECT concat('t', id) AS entry, lang AS source_lang, word, nullif(type, '') AS part_of_speech, nullif(domain, '') AS subject_field, nullif(status, '') AS status, CASE WHEN translation = '' THEN NULL WHEN lang IN ('en', 'auto') THEN 'zh' ELSE 'en' END AS target_lang, nullif(translation, '') AS translation FROM {_T} WHERE word <> ''")
def _(spark, sf):
    return tb.tbx_rows(terms_of(spark, sf))


_CELL = """CASE WHEN regexp_matches(coalesce({0}, ''), '[",\\r\\n]') THEN concat('"', replace({0}, '"', '""'), '"') ELSE coalesce({0}, '') END"""


@query("export_csv_lines", f"SELECT id, concat_ws(',', {', '.join(_CELL.format(c) for c in EXPORTED)}) AS line FROM {_T} WHERE status = 'confirmed'")
def _(spark, sf):
    return ex.csv_lines(terms_of(spark, sf), "confirmed")


_TIG = """concat(chr(10), '        <langSet xml:lang="', {0}, '">', chr(10), '          <tig>', chr(10), '            <term>', {1}, '</term>', {2}, chr(10), '          </tig>', chr(10), '        </langSet>')"""
_NOTE = """CASE WHEN {1} <> '' THEN concat(chr(10), '            <termNote type="{0}">', {1}, '</termNote>') ELSE '' END"""


@query("export_tbx_entries", f"""SELECT id, word, concat('      <termEntry id="t', id, '">', {_TIG.format("lang", "word", "concat(" + ", ".join(_NOTE.format(k, c) for k, c in (("partOfSpeech", "type"), ("subjectField", "domain"), ("status", "status"))) + ")")},
  CASE WHEN translation = '' THEN '' ELSE {_TIG.format("'zh'", "translation", "''")} END, chr(10), '      </termEntry>') AS line FROM {_T} WHERE word <> ''""")
def _(spark, sf):
    return ex.tbx_lines(terms_of(spark, sf))


@query("json_payload_stats", f"SELECT (SELECT count(*) FROM {_T} WHERE status = 'draft') AS total, (SELECT count(*) FROM {_T} WHERE status = 'confirmed') AS confirmed, (SELECT count(DISTINCT domain) FROM {_T}) AS domains, (SELECT count(DISTINCT status) FROM {_T}) AS statuses")
def _(spark, sf):
    t = terms_of(spark, sf)
    c = tb.counts_by(t)
    return c.agg(F.sum(F.when(F.col("kind") == "confirmed", F.col("n"))).alias("confirmed"), F.count_if(F.col("kind") == "domain").alias("domains"), F.count_if(F.col("kind") == "status").alias("statuses")).join(tb.export_rows(t, "draft").agg(F.count("*").alias("total")))


# lookups

_ID = "CAST(p_partkey AS VARCHAR(20))"
#: Responses in each service's form, with errors, missing blocks and more items than the limits.
YOUDAO_SQL = f"""SELECT concat(p_name, ' ', {_ID}) AS query, concat('{{"errorCode": "', CASE WHEN p_partkey % 9 = 0 THEN '108' ELSE '0' END, '"',
  CASE WHEN p_partkey % 2 = 0 THEN concat(', "query": "', p_name, '"') ELSE '' END,
  ', "translation": ["', p_brand, '", "', p_type, '", "third"]',
  CASE WHEN p_partkey % 3 <> 0 THEN concat(', "basic": {{"explains": ["n. ', p_name, '", "v. ', p_brand, '", "adj."], "us-phonetic": "',
    CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END, '", "uk-phonetic": "', p_brand, '"}}') ELSE '' END,
  CASE WHEN p_partkey % 4 <> 0 THEN concat(', "web": [{{"key": "', p_name, '", "value": ["', p_brand, '", "b", "c", "d"]}}, {{"key": "服务器", "value": ["', p_type, '"]}}, {{"key": "L", "value": ["z"]}}]') ELSE '' END,
  '}}') AS json FROM part"""
WEBSTER_SQL = f"""SELECT concat(p_name, ' ', {_ID}) AS query, CASE WHEN p_partkey % 11 = 0 THEN '[]' WHEN p_partkey % 7 = 0 THEN concat('["', p_name, '", "', p_brand, '"]')
  ELSE concat('[{{"shortdef": ["a ', p_name, '", "', p_type, '", "third"]', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(', "meta": {{"stems": ["', p_name, '", "', p_name, 's", "x"]',
    CASE WHEN p_partkey % 2 = 0 THEN '' ELSE concat(', "syns": [["', p_brand, '", "', p_type, '", "c"], ["', p_type, '"]]') END, '}}') END, '}}, {{"shortdef": ["second entry"]}}]') END AS json FROM part"""
_PAGE = f"""SELECT concat(p_name, ' ', {_ID}) AS query, '%s' AS lang, concat('{{"type": "', CASE WHEN p_partkey %% %d = 0 THEN 'disambiguation' ELSE 'standard' END, '"',
  CASE WHEN p_partkey %% 4 = 0 THEN '' ELSE concat(', "title": "', p_name, '"') END, ', "extract": "', CASE WHEN p_partkey %% 6 = 0 THEN '' ELSE concat('About ', p_type) END, '"}}') AS json FROM part"""
WIKI_SQL = _PAGE % ("en", 5) + " UNION ALL " + _PAGE % ("zh", 7)
_Y, _WB, _WK = f"({YOUDAO_SQL}) v", f"({WEBSTER_SQL}) v", f"({WIKI_SQL}) v"
_SHAPE = "query, word, type, source, score, definition, source_rank, ordinal"


def _strings(path: str, k: int) -> str:
    return f"list_slice(CAST(coalesce(json_extract(json, '{path}'), '[]') AS VARCHAR[]), 1, {k})"


def _block(src: str, arr: str, kind: str, name: str, score: float, definition: str, rank: int, block: int, where: str = "true") -> str:
    return f"SELECT query, w AS word, '{kind}' AS type, '{name}' AS source, {score}::DOUBLE AS score, {definition} AS definition, {rank} AS source_rank, ({block} * 1000000 + i - 1)::BIGINT AS ordinal FROM (SELECT query, json, unnest({arr}) AS w, generate_subscripts({arr}, 1) AS i FROM {src} WHERE {where})"


_OK = "json_extract_string(json, '$.errorCode') = '0'"
_PHON = f"""SELECT query, w AS word, 'phonetic' AS type, 'youdao' AS source, 0.7::DOUBLE AS score, d AS definition, 1 AS source_rank, (2000000 + row_number() OVER (PARTITION BY query ORDER BY o) - 1)::BIGINT AS ordinal FROM (
  SELECT query, json_extract_string(json, '$.basic."us-phonetic"') AS w, 'US' AS d, 0 AS o FROM {_Y} WHERE {_OK} UNION ALL SELECT query, json_extract_string(json, '$.basic."uk-phonetic"'), 'UK', 1 FROM {_Y} WHERE {_OK}) WHERE coalesce(w, '') <> ''"""
_WEBS = f"""SELECT query, k AS word, 'collocation' AS type, 'youdao' AS source, 0.7::DOUBLE AS score, v AS definition, 1 AS source_rank, (3000000 + row_number() OVER (PARTITION BY query ORDER BY i, j) - 1)::BIGINT AS ordinal FROM (
  SELECT query, i, json_extract_string(x, '$.key') AS k, unnest(list_slice(CAST(json_extract(x, '$.value') AS VARCHAR[]), 1, 3)) AS v, generate_subscripts(list_slice(CAST(json_extract(x, '$.value') AS VARCHAR[]), 1, 3), 1) AS j FROM (
  SELECT query, unnest(list_slice(CAST(coalesce(json_extract(json, '$.web'), '[]') AS JSON[]), 1, 2)) AS x, generate_subscripts(list_slice(CAST(coalesce(json_extract(json, '$.web'), '[]') AS JSON[]), 1, 2), 1) AS i FROM {_Y} WHERE {_OK}))"""
_YOUDAO_SQL = " UNION ALL ".join([_block(_Y, _strings("$.translation", 2), "translation", "youdao", 0.95, "coalesce(json_extract_string(json, '$.query'), query)", 1, 0, _OK), _block(_Y, _strings("$.basic.explains", 2), "explanation", "youdao", 0.85, "''", 1, 1, _OK), _PHON, _WEBS])


@query("lookup_flatten_youdao", f"SELECT {_SHAPE} FROM ({_YOUDAO_SQL})")
def _(spark, sf):
    return lk.flatten_youdao(derived(spark, sf, YOUDAO_SQL, "part"), 2)


_OBJ = "json_type(json, '$[0]') = 'OBJECT'"
_SYNS = f"""SELECT query, w AS word, 'synonym' AS type, 'webster' AS source, 0.75::DOUBLE AS score, '' AS definition, 2 AS source_rank, (2000000 + row_number() OVER (PARTITION BY query ORDER BY i, j) - 1)::BIGINT AS ordinal FROM (
  SELECT query, i, unnest(list_slice(g, 1, 2)) AS w, generate_subscripts(list_slice(g, 1, 2), 1) AS j FROM (SELECT query, unnest(CAST(coalesce(json_extract(json, '$[0].meta.syns'), '[]') AS VARCHAR[][])) AS g, generate_subscripts(CAST(coalesce(json_extract(json, '$[0].meta.syns'), '[]') AS VARCHAR[][]), 1) AS i FROM {_WB} WHERE {_OBJ}))"""


@query("lookup_flatten_webster", f"SELECT {_SHAPE} FROM (" + " UNION ALL ".join([_block(_WB, _strings("$[0].shortdef", 2), "definition", "webster", 0.9, "w", 2, 0, _OBJ), _block(_WB, _strings("$[0].meta.stems", 2), "root", "webster", 0.6, "''", 2, 1, _OBJ), _SYNS]) + ")")
def _(spark, sf):
    return lk.flatten_webster(derived(spark, sf, WEBSTER_SQL, "part"), 2)


_WIKI_SQL = f"SELECT query, coalesce(json_extract_string(json, '$.title'), query) AS word, 'concept' AS type, 'wikipedia-' || lang AS source, 0.8::DOUBLE AS score, json_extract_string(json, '$.extract') AS definition, 3 AS source_rank, CASE WHEN lang = 'en' THEN 0 ELSE 1 END::BIGINT AS ordinal FROM {_WK} WHERE coalesce(json_extract_string(json, '$.type'), '') <> 'disambiguation' AND coalesce(json_extract_string(json, '$.extract'), '') <> ''"


@query("lookup_flatten_wikipedia", _WIKI_SQL)
def _(spark, sf):
    return lk.flatten_wikipedia(derived(spark, sf, WIKI_SQL, "part"), 10)


_FED = f"""SELECT query, word, type, source, score, definition, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, source_rank, ordinal) AS place FROM (
  SELECT {_SHAPE} FROM ({_YOUDAO_SQL}) UNION ALL SELECT {_SHAPE} FROM ({_WIKI_SQL})
  UNION ALL SELECT 'server', word, type, source, score, NULL, 0, row_number() OVER (ORDER BY score DESC, word, type, source) FROM (SELECT related_word AS word, relation_type AS type, source, a.score FROM {_A} a JOIN {_T} t ON t.id = a.term_id WHERE {_like('t.word', 'al')} ORDER BY a.score DESC, word, type, source LIMIT 4))) WHERE place <= 6"""


@query("federated_search", _FED)
def _(spark, sf):
    local = lk.local_results(terms_of(spark, sf), assoc_of(spark, sf), "al", 4).withColumn("query", F.lit("server"))
    web = lk.flatten_youdao(derived(spark, sf, YOUDAO_SQL, "part"), 2).unionByName(lk.flatten_wikipedia(derived(spark, sf, WIKI_SQL, "part"), 10))
    return lk.federate(local, web, 6).select("query", "word", "type", "source", "score", "definition", F.col("place").cast("long").alias("place"))


# changes through the store


def _base(spark: SparkSession, sf: str, name: str = "base") -> Termbase:
    """A termbase with the derived terms and associations."""
    base = Termbase.create(spark, scratch(spark, "termbases"), name)
    base.load(terms_of(spark, sf), assoc_of(spark, sf))
    return base


@query("store_update", f"""SELECT id, CASE WHEN id = 42 THEN 'last word' WHEN id = 43 THEN 'other word' ELSE word END AS word, CASE WHEN id % 5 = 0 THEN 'deprecated' ELSE status END AS status,
  CASE WHEN id % 5 = 0 THEN TIMESTAMP '2025-01-01 00:00:00' WHEN id IN (42, 43) THEN NULL ELSE updated_at END AS updated_at FROM {_T}""")
def _(spark, sf):
    """A set of rows, then single ones, one of them twice: read through their deltas."""
    base = _base(spark, sf)
    base.update_where(F.col("id") % 5 == 0, F.expr("timestamp '2025-01-01 00:00:00'"), status="deprecated", no_such="x")
    base.update_term(42, word="first word")
    base.update_term(43, word="other word")
    base.update_term(42, word="last word")
    return base.terms.select("id", "word", "status", F.when(~F.col("id").isin(42, 43), F.col("updated_at")).alias("updated_at"))


@query("store_delete", f"SELECT 'terms' AS part, count(*) AS n, sum(id) AS ids FROM {_T} WHERE id % 10 <> 0 UNION ALL SELECT 'associations', count(*), sum(term_id) FROM {_A} WHERE term_id % 10 <> 0")
def _(spark, sf):
    """Terms and what hangs on them deleted; the terms then compacted, the associations read through their deltas."""
    base = _base(spark, sf)
    base.delete_where(F.col("id") % 10 == 0)
    base.compact("terms")
    t = base.terms.agg(F.count("*").alias("n"), F.sum("id").alias("ids")).select(F.lit("terms").alias("part"), "n", "ids")
    a = base.associations.agg(F.count("*").alias("n"), F.sum("term_id").alias("ids")).select(F.lit("associations").alias("part"), "n", "ids")
    return t.unionByName(a)


@query("store_catalog", f"SELECT base, sum(n)::BIGINT AS total_terms, array_to_string(list(lang ORDER BY n DESC, lang), ', ') AS langs FROM (SELECT concat('base-', id % 3) AS base, CASE WHEN id % 4 = 0 THEN 'en' ELSE lang END AS lang, count(*) AS n FROM {_T} WHERE id % 7 <> 0 GROUP BY ALL) GROUP BY base")
def _(spark, sf):
    """Three termbases, changed, counted by one read over all of them."""
    root, t = scratch(spark, "termbases"), terms_of(spark, sf)
    for k in range(3):
        base = Termbase.create(spark, root, f"base-{k}")
        base.load(t.filter(F.col("id") % 3 == k))
        base.update_where(F.col("id") % 4 == 0, lang="en")
        base.delete_where(F.col("id") % 7 == 0)
    return tb.catalog_of(all_terms(spark, root, {f"base-{k}": Termbase(spark, root, f"base-{k}")._state() for k in range(3)}))


@query("store_batches", f"SELECT word, translation, count(*) AS n FROM (SELECT DISTINCT word, translation FROM {_T}) GROUP BY ALL")
def _(spark, sf):
    """Batches of a stream, one of them delivered again: every pair of word and translation is there once."""
    base, rows = Termbase.create(spark, scratch(spark, "termbases"), "stream"), terms_of(spark, sf).select("word", "translation")
    for number in (0, 1, 1, 2, 0):
        add_batch(base, rows.filter(F.pmod(F.xxhash64("word"), F.lit(2)) == number % 2), "words", number)
    return base.terms.groupBy("word", "translation").agg(F.count("*").alias("n"))


# kept dictionaries and responses

USAGE_SQL = """SELECT l_partkey AS id, concat('{"count": ', CAST(count(*) AS VARCHAR(20)), ', "flags": ["', min(l_returnflag), '", "', max(l_returnflag), '"], "status": "', max(l_linestatus), '"}') AS json
  FROM lineitem GROUP BY l_partkey"""


class Usage(DictSource):
    """A source of our own: how often a term was used, and under which flags."""

    name, rank, needs_key = "usage", 7, False

    def flatten(self, raw: DataFrame, limit: int) -> DataFrame:
        d = raw.select("query", F.from_json("json", "count long, flags array<string>, status string").alias("d"))
        flags = F.transform(F.slice("d.flags", 1, limit), lambda x: item(x, "flag", self.name, 0.95, F.col("d.count").cast("string")))
        status = F.array(item(F.col("d.status"), "status", self.name, 0.4, F.lit("")))
        return rows(d, flags, self.rank, 0).unionByName(rows(d, status, self.rank, 1))


_PLACED = "row_number() OVER (PARTITION BY query ORDER BY score DESC, source_rank, ordinal)"
_USAGE = f"SELECT concat(p_name, ' ', {_ID}) AS query, json FROM ({USAGE_SQL}) u JOIN part ON p_partkey = id"
_USAGE_ROWS = f"""SELECT query, w AS word, 'flag' AS type, 'usage' AS source, 0.95::DOUBLE AS score, json_extract_string(json, '$.count') AS definition, 7 AS source_rank, (i - 1)::BIGINT AS ordinal
  FROM (SELECT query, json, unnest({_strings("$.flags", 2)}) AS w, generate_subscripts({_strings("$.flags", 2)}, 1) AS i FROM ({_USAGE}))
  UNION ALL SELECT query, json_extract_string(json, '$.status'), 'status', 'usage', 0.4::DOUBLE, '', 7, 1000000::BIGINT FROM ({_USAGE})"""
_WEBSTER_ROWS = " UNION ALL ".join([_block(_WB, _strings("$[0].shortdef", 2), "definition", "webster", 0.9, "w", 2, 0, _OBJ), _block(_WB, _strings("$[0].meta.stems", 2), "root", "webster", 0.6, "''", 2, 1, _OBJ), _SYNS])


def _dictionary(spark: SparkSession, sf: str) -> str:
    """Two sources' responses, kept as dictionaries in the shared folder."""
    path = scratch(spark, "dictionary")
    write_dictionary(derived(spark, sf, WEBSTER_SQL, "part").withColumnRenamed("query", "term"), path, "webster")
    part = read(spark, sf, "part").select(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("term"), F.col("p_partkey").alias("id"))
    write_dictionary(derived(spark, sf, USAGE_SQL, "lineitem").join(part, "id"), path, "usage")
    return path


@query("dictionary_lookup", f"SELECT query, word, type, source, score, definition, {_PLACED} AS place FROM ({_WEBSTER_ROWS} UNION ALL {_USAGE_ROWS}) QUALIFY place <= 4")
def _(spark, sf):
    terms = derived(spark, sf, YOUDAO_SQL, "part").select("query")
    found = lookup_dictionary(terms, _dictionary(spark, sf), ["webster", Usage()], 2)
    return lk.federate(None, found, 4).select("query", "word", "type", "source", "score", "definition", F.col("place").cast("long").alias("place"))


@query("dictionary_range", f"SELECT source, query AS term, json FROM (SELECT 'webster' AS source, query, json FROM {_WB} UNION ALL SELECT 'usage', query, json FROM ({_USAGE})) WHERE query LIKE 'hot %' AND query > 'hot g'")
def _(spark, sf):
    return dictionary(spark, _dictionary(spark, sf), pushdown=True).filter("term like 'hot %' and term > 'hot g'").select("source", "term", "json")


def _page_of(term: str, endpoint: str) -> str | None:
    return json.dumps({"type": "standard", "title": term.upper(), "extract": f"{endpoint}: {term}"}) if endpoint == "wikipedia-en" else None


def _no_page(term: str, endpoint: str) -> str | None:
    raise RuntimeError(f"{term} was kept already")


@query("kept_responses", "SELECT DISTINCT p_name AS query, upper(p_name) AS word, 'concept' AS type, 'wikipedia-en' AS source, concat('wikipedia-en: ', p_name) AS definition FROM part")
def _(spark, sf):
    """Looked up once; the second time all responses come from the kept ones."""
    asked, path, sources = read(spark, sf, "part").select(F.col("p_name").alias("query")), scratch(spark, "responses"), [lk.Wikipedia()]
    sources[0].rate = 1e6
    lk.lookup(asked, _page_of, 9, path, sources)
    return lk.lookup(asked, _no_page, 9, path, sources).select("query", "word", "type", "source", "definition")


_RES = "(SELECT t.word AS query, a.related_word AS word, a.relation_type AS type, a.score, row_number() OVER (PARTITION BY t.word ORDER BY a.score DESC, related_word, relation_type, a.id, t.id) AS place FROM " + f"{_A} a JOIN {_T} t ON t.id = a.term_id)"


def _results(spark, sf) -> DataFrame:
    t, a = terms_of(spark, sf).select("id", F.col("word").alias("query")), assoc_of(spark, sf).withColumnRenamed("id", "aid")
    j = a.join(t, a["term_id"] == t["id"])
    place = F.struct((-F.col("score")).alias("s"), "related_word", "relation_type", "aid", "id")
    return j.select("query", F.col("related_word").alias("word"), F.col("relation_type").alias("type"), "source", "score", place.alias("place"))


@query("pipeline_term_join", f"SELECT term, coalesce(n, 0) AS n_results, best FROM (SELECT DISTINCT word AS term FROM {_T} UNION ALL SELECT 'no such term') x LEFT JOIN (SELECT query, count(*) AS n, arg_min(word, place) AS best FROM {_RES} GROUP BY query) r ON r.query = x.term")
def _(spark, sf):
    terms = terms_of(spark, sf).select(F.col("word").alias("term")).distinct().unionByName(spark.createDataFrame([("no such term",)], "term string"))
    return result_summary(terms, _results(spark, sf)).select("term", "n_results", "best")


@query("first_translation", f"SELECT query, arg_min(word, place) AS translation FROM {_RES} WHERE type = 'translation' GROUP BY query")
def _(spark, sf):
    return first_translations(_results(spark, sf))


@query("search_hit_count", f"SELECT count(DISTINCT query) AS hits FROM {_RES}")
def _(spark, sf):
    terms = terms_of(spark, sf).select(F.col("word").alias("term")).distinct()
    return hit_count(terms, _results(spark, sf))


# reports, files and names

_LONG_PLACED = " UNION ALL ".join(f"SELECT doc_id, '{d}' AS domain, s_{d} AS score, {k} AS i FROM a" for k, d in enumerate(DOMAINS))


@query("report_domain_bars", f"""WITH a AS ({_analysis_sql(CJK_SOURCE)}) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS place, domain, score,
  concat(repeat('█', trunc(score * 20)::INT), repeat('░', 20 - trunc(score * 20)::INT)) AS bar FROM ({_LONG_PLACED})""")
def _(spark, sf):
    return rp.domain_bars(tx.analyze(cjk_docs(spark, sf)))


@query("document_summaries", f"""SELECT doc_id, concat('Language: ', lang, chr(10), 'Characters: ', chars_total, ' (no spaces: ', chars_no_space, ')', chr(10), 'Words (estimated): ', words_cn + words_en, ' (CN: ', words_cn, ', EN: ', words_en, ')', chr(10),
  'Paragraphs: ', paragraphs, chr(10), 'Sentences: ', sentences, chr(10), 'Domain: ', domain, chr(10), 'Difficulty: ', difficulty) AS summary FROM ({_analysis_sql('documents')})""")
def _(spark, sf):
    return tx.analyze(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", tx.summary_text().alias("summary"))


@query("analyze_text_files", f"SELECT {_FIELDS} FROM ({_analysis_sql('(SELECT item_id AS doc_id, concat(text, chr(10)) AS text FROM benchmark)')})")
def _(spark, sf):
    """A file for each benchmark text, profiled as whole files are."""
    path = scratch(spark, "texts")
    read(spark, sf, "benchmark").select("item_id", "text").filter("text is not null").repartition("item_id").write.partitionBy("item_id").text(path)
    got = analyze_files(spark, f"{path}/*/*.txt")
    return got.withColumn("doc_id", F.regexp_extract("doc_id", r"item_id=(\d+)/", 1).cast("long")).select(*_FIELDS.split(", "))


@query("csv_round_trip", f"SELECT word, lang, type, translation, domain, status, notes, count(*) AS n FROM {_T} GROUP BY ALL")
def _(spark, sf):
    """Exported to a single file, and imported into a new termbase."""
    root = scratch(spark, "termbases")
    ex.export_csv(terms_of(spark, sf), f"{root}/terms.csv")
    base = Termbase.create(spark, f"{root}/bases", "copy")
    base.import_csv(f"{root}/terms.csv", dedup=False)
    return base.terms.groupBy("word", "lang", "type", "translation", "domain", "status", "notes").agg(F.count("*").alias("n"))


@query("request_signatures", "SELECT p_partkey AS id, sha256(concat('key', p_name, p_brand, CAST(p_partkey AS VARCHAR(20)), 'secret')) AS sign FROM part")
def _(spark, sf):
    sign = lk.signature_column(F.lit("key"), F.col("p_name"), F.col("p_brand"), F.col("p_partkey").cast("string"), F.lit("secret"))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), sign.alias("sign"))


@query("terms_added", f"SELECT count(*) AS added, min(id) AS first_id, max(id) AS last_id FROM (SELECT row_number() OVER (ORDER BY min(id)) AS id FROM {_T} GROUP BY word, translation)")
def _(spark, sf):
    """The first of each word and translation, added to a termbase; ids without gaps."""
    base = Termbase.create(spark, scratch(spark, "termbases"), "added")
    base.add_rows(tb.new_rows(base.terms, terms_of(spark, sf), ["id"]).select("id", *EDITABLE), ["id"])
    return base.terms.agg(F.count("*").alias("added"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


_COUNTS = f"(SELECT count(*) AS total, count(*) FILTER (status = 'confirmed') AS confirmed FROM {_T}) c"


@query("recommendations", f"""SELECT doc_id, CASE WHEN codes = '' THEN 'none' ELSE codes END AS codes FROM (SELECT doc_id, concat_ws(',', CASE WHEN difficulty = 'hard' THEN 'hard' END, CASE WHEN lang = 'mixed' THEN 'mixed' END, CASE WHEN domain <> 'general' THEN 'domain' END,
  CASE WHEN confirmed < total * 0.5 THEN 'unconfirmed' END) AS codes FROM ({_analysis_sql(CJK_SOURCE)}) a, {_COUNTS})""")
def _(spark, sf):
    counts = terms_of(spark, sf).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "confirmed").alias("confirmed"))
    a = tx.analyze(cjk_docs(spark, sf)).join(F.broadcast(counts))  # one row
    codes = rp.recommendation_codes(F.col("lang"), F.col("domain"), F.col("difficulty"), F.col("confirmed"), F.col("total"))
    return a.select("doc_id", F.array_join(codes, ",").alias("codes"))
