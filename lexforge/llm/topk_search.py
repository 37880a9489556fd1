"""Exact BM25 top-k search: an inverted index per shard, pruned as in block-max WAND, merged exactly.

Every shard holds the postings of some millions of words. Document frequencies, the number of documents and
their mean length are taken over all shards (frequencies by hash bucket, sent back per shard), so a shard's
scores are global scores and the merge of the shards' best k is exact. A posting's impact is its BM25
contribution as an integer (IMPACT_UNIT parts of one), so scores don't depend on the order of summing.

Dynamic pruning makes WAND's tests on all documents of a shard at once, instead of moving a cursor per term.
Terms that many of a shard's documents have (one in DENSE) have small maxima; they take the place of the terms
before the pivot. Postings of the others are read; a document whose sum, with the block maxima of the
dense terms (of BLOCK documents), doesn't reach the threshold is out. What is left in any block is scored for a
batch of queries by one matrix product of the dense terms' impacts. That product is in 32 bits, so it only picks:
documents within its rounding error of the threshold are scored again in whole numbers.

The threshold is a query's k-th best score so far. Shards are dealt to levels by their number (odd
ones to level 0, those divisible by 2 alone to level 1, and so on), each about as large as all searched before it;
levels are searched in turn, and a level starts from the threshold that those before left. So
a shard returns few documents that the merge would drop: about k a query and level, not k a query and shard.
Queries come in groups of about GROUP, BATCH to a row, whose words are kept once. One task searches a cell of shards, one after another, for a group, so
that queries are copied once a cell, not once a shard.

Cases: null or empty texts are no hits and, as queries, have none; a document without a shared word is no hit,
so a query may have fewer than k; ties go to the smaller id, a null id last; repeated rows are separate hits
with equal scores, but one query; a null id is never a query; an empty table gives no rows; further columns are
ignored. A word is its 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.llm.common import give_back, materialize, ready, release, table
from lexforge.llm.hashing import hash_strings, split_words

K, K1, B = 10, 1.2, 0.75
IMPACT_UNIT = 10_000
SHARD_WORDS = 4_000_000
#: Documents of a shard fit 16-bit numbers.
SHARD_DOCS = 60_000
BLOCK = 16
#: A term that one in so many of a shard's documents have is dense, up to so many cells of a shard's matrix.
DENSE, DENSE_CELLS = 16, 16_000_000
GROUP = 10_000
#: Queries of a row, and numbers that a product of some of them may have.
BATCH, PRODUCT = 2000, 2_000_000
#: Shards that the first round searches at least, if there are as many; up to LEVELS rounds.
FIRST_SHARDS = 8
LEVELS = 24
#: Shards that share one copy of the queries in a round, once the round has CELLS cells.
CELL_SHARDS, CELLS = 8, 8
QUERY_STEP = 50


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, and where each text's words end."""
    distinct, word, ends = split_words(texts)
    return hash_strings(distinct)[word], ends


def counted(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (word, text) with their counts, by word and text."""
    doc = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(np.concatenate([[0], ends])))
    order = np.argsort(words, kind="stable")  # texts come in order already
    w, d = words[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (d[1:] != d[:-1])])) if len(w) else np.zeros(0, np.int64)
    return w[first], d[first], np.diff(np.append(first, len(w)))


def _narrow(n: np.ndarray) -> bytes:
    """Counts in 16 bits each, or in 32 if one doesn't fit."""
    return n.astype("<u2" if not len(n) or n.max() < 1 << 16 else "<u4").tobytes()


def _wide(raw: bytes, count: int) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if len(raw) == 4 * count else "<u2")


def _shards(shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pack_shards(batches, shard_words)

    return run


def _pack_shards(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    ids, null, words, ends, have, count = [], [], [], [], 0, 0

    def packed():
        w = np.concatenate(words)
        e = np.concatenate(ends)
        t, d, n = counted(w, e)
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
        length = np.diff(np.concatenate([[0], e]))
        row = (number, np.concatenate(ids).astype("<i8").tobytes(), np.concatenate(null).tobytes(), length.astype("<u4").tobytes(), t[first].astype("<u8").tobytes(), np.append(first, len(t)).astype("<u4").tobytes(), d.astype("<u2").tobytes(), _narrow(n), len(e), int(length.sum()))
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, [pa.int64(), *[pa.binary()] * 7, pa.int64(), pa.int64()], strict=True)], names=["shard", "ids", "nulls", "lens", "terms", "starts", "docs", "tfs", "n_docs", "n_words"])

    for batch in batches:
        step = min(1000, SHARD_DOCS, max(1, shard_words // 100))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            w, e = word_hashes(part.column(1))
            if ids and (have + len(w) > shard_words or count + part.num_rows > SHARD_DOCS):
                yield packed()
                number += 1
                ids, null, words, ends, have, count = [], [], [], [], 0, 0
            count += part.num_rows
            ids.append(pc.fill_null(part.column(0), 0).to_numpy(zero_copy_only=False))
            null.append(pc.is_null(part.column(0)).to_numpy(zero_copy_only=False))
            words.append(w)
            ends.append(e + have)
            have += len(w)
    if ids:
        yield packed()


def _queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of queries: their distinct words, most asked first, and each query's words as numbers of these. query * words
    + word rises, so its steps are small."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            t, d, n = counted(*word_hashes(part.column(1)))
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
            asked = np.diff(np.append(first, len(t)))
            order = np.argsort(-asked, kind="stable")
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            place = d * np.int64(len(order)) + np.repeat(number, asked)
            by = np.argsort(place)
            row = (part.column(0).to_numpy().astype("<i8").tobytes(), t[first][order].astype("<u8").tobytes(), _press(np.diff(place[by], prepend=0)), _press(n[by]), part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (*[pa.binary()] * 4, pa.int64()), strict=True)], names=["ids", "terms", "steps", "weights", "n"])


def _press(x: np.ndarray) -> bytes:
    """Numbers, their first bytes before their second ones and so on, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpress(raw: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _frequencies(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                shard, terms, starts = (batch.column(i)[r].as_py() for i in range(3))
                t, n = np.frombuffer(terms, "<u8"), np.diff(np.frombuffer(starts, "<u4").astype(np.int64))
                b = (t % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(b, kind="stable")
                groups = np.split(order, np.flatnonzero(np.diff(b[order])) + 1) if len(t) else []
                yield pa.RecordBatch.from_arrays([pa.array([int(b[g[0]]) for g in groups], pa.int64()), pa.array([shard] * len(groups), pa.int64()), pa.array([t[g].tobytes() for g in groups], pa.binary()), pa.array([n[g].astype("<u4").tobytes() for g in groups], pa.binary())], names=["bucket", "shard", "terms", "n"])

    return run


def _sum_frequencies(t: pa.Table) -> pa.Table:
    h = [np.frombuffer(x, "<u8") for x in t.column("terms").to_pylist()]
    n = np.concatenate([np.frombuffer(x, "<u4") for x in t.column("n").to_pylist()]).astype(np.int64)
    known, inverse = np.unique(np.concatenate(h), return_inverse=True)
    total = np.zeros(len(known), np.int64)
    np.add.at(total, inverse, n)
    back = np.split(total[inverse], np.cumsum([len(x) for x in h])[:-1])
    return pa.table({"shard": t.column("shard"), "bucket": t.column("bucket"), "df": pa.array([x.astype("<u4").tobytes() for x in back], pa.binary())})


class Shard:
    """An inverted index with impacts, block maxima and the terms of each document."""

    def __init__(self, r: dict, n_docs: int, mean: float, buckets: int):
        self.ids, self.null = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["nulls"], bool)
        lens = np.frombuffer(r["lens"], "<u4").astype(np.float64)
        self.terms = np.frombuffer(r["terms"], "<u8")
        self.starts = np.frombuffer(r["starts"], "<u4").astype(np.int64)
        self.docs = np.frombuffer(r["docs"], "<u2").astype(np.int32)
        tf = _wide(r["tfs"], len(self.docs)).astype(np.float64)
        df = np.zeros(len(self.terms), np.float64)
        b = (self.terms % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        for x in r["found"]:
            lo, hi = np.searchsorted(b[order], [x["bucket"], x["bucket"] + 1])
            df[order[lo:hi]] = np.frombuffer(x["df"], "<u4")
        idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        each = np.repeat(idf, np.diff(self.starts))
        # whole numbers below 2^24, which 32 bits hold exactly
        self.impact = np.floor(each * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[self.docs] / mean))) * IMPACT_UNIT + 0.5).astype(np.float32)
        del each, tf
        self.term_top = np.maximum.reduceat(self.impact, self.starts[:-1]) if len(self.terms) else self.impact
        # the dense terms' impacts by term and document, and their maxima by block
        n, size = len(self.ids), np.diff(self.starts)
        some = np.flatnonzero(size * DENSE >= n)
        some = some[np.argsort(-size[some], kind="stable")[: DENSE_CELLS // max(1, n)]]
        self.row = np.full(len(self.terms), -1, np.int32)
        self.row[some] = np.arange(len(some))
        self.dense = np.zeros((len(some), n), np.float32)
        p = _ranges(self.starts[some], self.starts[some + 1])
        self.dense[np.repeat(np.arange(len(some)), size[some]), self.docs[p]] = self.impact[p]
        self.block_top = np.maximum.reduceat(self.dense, np.arange(0, n, BLOCK), axis=1) if n else self.dense
        #: what 32-bit sums of numbers of one sign are off by at most, with room to spare
        self.off = (len(some) + 16) * 2.0**-22

    def _given(self, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What these terms give every document."""
        n = self.starts[t + 1] - self.starts[t]
        p = _ranges(self.starts[t], self.starts[t + 1])
        return np.bincount(self.docs[p], weights=self.impact[p] * np.repeat(w, n), minlength=len(self.ids))

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, theta: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the best k documents with a score of theta at least."""
        for _, docs, score in self.tops(terms, np.zeros(len(terms), np.int64), np.arange(len(terms)), weights, k, np.array([theta])):
            return docs, score
        return np.zeros(0, np.int64), np.zeros(0)

    def tops(self, terms: np.ndarray, query: np.ndarray, number: np.ndarray, weights: np.ndarray, k: int, theta: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The same for many queries: theirs, in order, are the terms of these numbers. Queries that find nothing are left out."""
        if not len(self.terms) or not len(terms):
            return
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        hit = (self.terms[at] == terms)[number]
        query, t, w = query[hit], at[number[hit]], weights[hit].astype(np.float64)
        most = np.bincount(query, weights=w * self.term_top[t], minlength=len(theta))
        open_ = (most > 0) & (most >= theta)
        row, n = self.row[t], len(self.ids)
        stop = np.searchsorted(query, np.arange(len(theta)), side="right")
        start = np.concatenate([[0], stop[:-1]])
        todo = np.flatnonzero(open_)
        step = max(1, min(256, PRODUCT // max(n, len(self.dense))))
        for a in range(0, len(todo), step):
            some = todo[a : a + step]
            least = (theta[some] * (1 - self.off))[:, None]
            by_row, given = np.zeros((len(some), len(self.dense)), np.float32), np.zeros((len(some), n))
            for i, q in enumerate(some.tolist()):
                own = slice(start[q], stop[q])
                r, few = row[own], row[own] < 0
                by_row[i, r[~few]] = w[own][~few]
                given[i] = self._given(t[own][few], w[own][few])
            cols, score = np.arange(n), given
            if len(self.dense):
                blocks = np.arange(0, n, BLOCK)
                live = (np.maximum.reduceat(given, blocks, axis=1) + by_row @ self.block_top >= least).any(0)
                if live.mean() < 0.7:
                    cols = np.flatnonzero(np.repeat(live, BLOCK)[:n])
                    score = given[:, cols] + by_row @ self.dense[:, cols]
                else:
                    score = given + by_row @ self.dense
            for i, q in enumerate(some.tolist()):
                near = np.flatnonzero((score[i] >= least[i]) & (score[i] > 0))
                if len(near) > 2 * k:  # below the k-th, by more than both may be off
                    s = score[i][near]
                    near = near[s >= np.partition(s, -k)[-k] * (1 - 3 * self.off)]
                docs, own = cols[near], slice(start[q], stop[q])
                r, many = row[own], row[own] >= 0
                whole = given[i, docs] + w[own][many] @ self.dense[np.ix_(r[many], docs)].astype(np.float64)
                docs, whole = docs[whole >= theta[q]], whole[whole >= theta[q]]
                best = np.lexsort((self.ids[docs], self.null[docs], -whole))[:k]
                if len(best):
                    yield q, docs[best], whole[best]


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [a, b), one range after another."""
    n = b - a
    upto = np.cumsum(n)
    return np.repeat(a - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)


def _search(n_docs: int, mean: float, buckets: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        shape = pa.schema([("batch", pa.int64()), ("query_id", pa.int64()), ("doc_id", pa.int64()), ("points", pa.int64())])
        out = []
        index = None
        found: dict[int, list[dict]] = {}
        here = left.column("df").is_valid()
        for x in left.filter(here).select(["shard", "bucket", "df"]).to_pylist():
            found.setdefault(x["shard"], []).append(x)
        for r in np.flatnonzero(~here.to_numpy()).tolist() if right.num_rows else ():
            del index  # one shard at a time, its memory given back before the next is built
            give_back()
            row = left.slice(r, 1).to_pylist()[0]
            index = Shard(row | {"found": found.get(row["shard"], [])}, n_docs, mean, buckets)
            for a in range(right.num_rows):
                batch, ids, terms, steps, weights, known = (right.column(c)[a].as_py() for c in ("batch", "ids", "terms", "steps", "weights", "known"))
                ids, terms = np.frombuffer(ids, "<i8"), np.frombuffer(terms, "<u8")
                query, number = np.divmod(np.cumsum(_unpress(steps)), max(1, len(terms)))
                theta = {x["query_id"]: float(x["points"]) for x in known or ()}
                for q, d, s in index.tops(terms, query, number, _unpress(weights), k, np.array([theta.get(i, 0.0) for i in ids.tolist()])):
                    out.append((np.full(len(d), batch), np.full(len(d), ids[q]), index.ids[d], s.astype(np.int64), index.null[d]))
        del index
        give_back()
        if not out:
            return shape.empty_table()
        batch, query, doc, points, null = (np.concatenate([o[i] for o in out]) for i in range(5))
        return pa.table([pa.array(batch), pa.array(query), pa.array(doc, mask=null), pa.array(points)], schema=shape)

    return run


def _rounds(counts: dict[int, int]) -> list[tuple[int, int, int]]:
    """Levels from the rarest on, as (first, last, shards): the first round takes levels until it has FIRST_SHARDS."""
    out, have, last = [], 0, LEVELS
    for level in range(LEVELS, -1, -1):
        have += counts.get(level, 0)
        if have and (out or have >= FIRST_SHARDS or level == 0):
            out.append((level, last, have))
            have, last = 0, level - 1
    return out


def search_documents(docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """query_id, doc_id, rank and score of the best k documents for every query."""
    spark = docs.sparkSession
    ready(spark)
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shards = pick(docs).mapInArrow(_shards(shard_words), "shard long, ids binary, nulls binary, lens binary, terms binary, starts binary, docs binary, tfs binary, n_docs long, n_words long")
    # the partition's number and the shard's within it: dense, so that levels and cells come out even
    place = F.shiftright("shard", 32) + F.col("shard").bitwiseAND((1 << 32) - 1)
    level = F.least(F.length(F.regexp_extract(F.bin(place), "0*$", 0)), F.lit(LEVELS)).cast("int")  # zeros at its end
    shards = materialize(shards.withColumn("level", level), "shards", parts="level")
    # an id asked twice is one query with the words of its different texts
    asks = pick(queries).filter("doc_id is not null").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("text")), " ").alias("text"))
    q = materialize(asks.mapInArrow(_queries, "ids binary, terms binary, steps binary, weights binary, n long").withColumn("batch", F.xxhash64("ids")), "queries")
    n_queries = q.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    totals = shards.groupBy("level").agg(F.count("*"), F.sum("n_docs"), F.sum("n_words")).collect()  # LEVELS + 1 rows at most
    n_shards, n_docs, n_words = (sum(r[i] for r in totals) for i in (1, 2, 3))
    mean = n_words / n_docs if n_words else 1.0
    buckets, groups = max(8, n_shards), max(1, -(-n_queries // GROUP))
    sums = shards.select("shard", "terms", "starts").mapInArrow(_frequencies(buckets), "bucket long, shard long, terms binary, n binary").groupBy("bucket").applyInArrow(_sum_frequencies, "shard long, bucket long, df binary")
    sums = materialize(sums.withColumn("level", level), "frequencies", parts="level")
    w = Window.partitionBy("query_id").orderBy(F.col("points").desc(), F.col("doc_id").asc_nulls_last())
    rows = "batch long, query_id long, doc_id long, points long"
    best = materialize(spark.createDataFrame([], rows).withColumn("rank", F.lit(1)), "best")
    for first, last, n in _rounds({r[0]: r[1] for r in totals}):
        cells = min(n, max(CELLS, -(-n // CELL_SHARDS)))
        # places of one level alone have a one before their zeros
        cell = F.pmod(F.shiftright(place, first + (first == last)), F.lit(cells)).cast("int")
        index = shards.unionByName(sums, allowMissingColumns=True).filter(F.col("level").between(first, last))
        index = index.drop("n_docs", "n_words", "level").withColumn("cell", cell).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        known = best.filter(F.col("rank") == k).groupBy("batch").agg(F.collect_list(F.struct("query_id", "points")).alias("known"))  # BATCH a batch at most
        asked = q.join(known, "batch", "left").withColumn("part", F.pmod("batch", F.lit(groups)).cast("int")).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
        hits = index.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInArrow(_search(n_docs, mean, buckets, k), rows)
        hits = best.drop("rank").unionByName(hits).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        new = materialize(hits, "best")
        release(best)
        best = new
    for done in (sums, shards, q):
        release(done)
    return best.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), (F.col("points") / F.lit(float(IMPACT_UNIT))).alias("score"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search_documents(docs, docs.filter(F.col("doc_id") % QUERY_STEP == 0))


OP3_SQL = r"""
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '')) AS t FROM documents),
p AS (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY doc_id, t),
l AS (SELECT doc_id, CAST(sum(tf) AS DOUBLE) AS dl FROM p GROUP BY doc_id),
g AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM w) / CAST((SELECT count(*) FROM documents) AS DOUBLE) AS mean),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
i AS (SELECT p.doc_id, p.t, p.tf, CAST(floor(ln(1 + (n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * (p.tf * CAST(2.2 AS DOUBLE) / (p.tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / mean))) * 10000 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS imp
      FROM p JOIN l USING (doc_id) JOIN f USING (t), g),
s AS (SELECT q.doc_id AS query_id, i.doc_id, sum(q.tf * i.imp) AS points FROM p q JOIN i USING (t) WHERE q.doc_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, rank, CAST(points AS DOUBLE) / CAST(10000 AS DOUBLE) AS score FROM r WHERE rank <= 10
"""
