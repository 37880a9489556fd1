"""LM scoring: a unigram base over words and a causal self-attention model over subword ids.

Documents are packed once into chunks: each word as an index into the chunk's distinct words (in the order of
their hashes), and each distinct word's subword ids. Word counts are summed by ranges of hashes and sent back per
chunk, so no table of words is ever gathered or broadcast. Counts of subword ids and of their pairs cover all
training documents; they are bounded by the vocabulary and become the model's starting point. The model then
trains in rounds over fixed shares of the training documents (SHARES). A round's documents are cut into spans of
SPAN tokens with the context before them, and dealt to groups of about GROUP_TOKENS by a hash of the text; every
group trains from the same weights, and the results are averaged by windows seen. Every training window is
trained on once, at every size, and the hash alone decides round, group and order, so scores don't depend on how
the input is partitioned. Scoring runs over whole texts in overlapping windows.

Cases: a null or empty text is the end token alone; repeated rows are scored alike and count in training each;
ties don't arise; without training documents the base is uniform (N = V = 0) and the model untrained; an empty
table gives no rows; further columns are ignored. A word is its 64-bit hash in the base counts. Subword ids are kept in
16 bits, so a tokenizer with more than 65,536 ids raises an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import attention_lm as lm
from lexforge.llm.common import crc_mod, give_back, materialize, ready, release, table
from lexforge.llm.hashing import mix, split_words
from lexforge.llm.packing import encoder

CHUNK_WORDS = 500_000
#: Chunks for each bucket of word counts.
BUCKET_CHUNKS = 4
#: Sixteenths of the training documents in each round: all of them together, at every size.
SHARES = (1, 2, 4, 9)
RATE = 0.03
#: Tokens of a span, whole windows; and of a group, which one task trains on.
SPAN, GROUP_TOKENS = 256 * lm.STRIDE, 1_000_000
#: Words, and parts of words, that a packing worker keeps.
KNOWN_WORDS, CACHE_WORDS = 300_000, 100_000

_CHUNK = "chunk long, docs array<long>, keys array<long>, heldout array<boolean>, ends array<long>, words binary, hashes binary, pool binary, sizes binary, tokens long, train_tokens long"


def _press(x: np.ndarray, kind: str) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.astype(kind).tobytes())


def _unpress(raw: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


class Packed:
    """A chunk's texts unpacked. word: the distinct word of each word; ends: where each document's words end;
    pool, sizes: the distinct words' subword ids one after another, if they were asked for."""

    def __init__(self, r: dict):
        self.heldout, self.ends = np.array(r["heldout"], bool), np.array(r["ends"], np.int64)
        self.length = np.diff(np.concatenate([[0], self.ends]))
        self.word = _unpress(r["words"], "<u4").astype(np.int64)
        if "pool" in r:
            self.pool, self.sizes = _unpress(r["pool"], "<u2"), _unpress(r["sizes"], "<u4").astype(np.int64)

    def only(self, pick: np.ndarray) -> Packed:
        """The picked documents alone."""
        self.word, self.ends = self.word[np.repeat(pick, self.length)], np.cumsum(self.length[pick])
        self.length, self.heldout = self.length[pick], self.heldout[pick]
        return self

    def tokens(self, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Subword ids of all documents, end_id after each; where documents start and end."""
        begin = np.cumsum(self.sizes) - self.sizes
        size = np.append(self.sizes, 1)
        pool = np.append(self.pool, end_id).astype(np.int64)
        begin = np.append(begin, len(pool) - 1)
        word = np.insert(self.word, self.ends, len(self.sizes))
        n = size[word]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(begin[word] - upto[:-1], n) + np.arange(upto[-1])]
        ends = upto[self.ends + np.arange(1, len(self.ends) + 1)]
        return ids, np.concatenate([[0], ends[:-1]]), ends


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    encoder.cache_clear()  # a worker that packed before needs its known words no more
    give_back()
    for batch in batches:
        for r in range(batch.num_rows):
            yield {n: batch.column(i)[r].as_py() for i, n in enumerate(batch.schema.names)}
    give_back()


def _text_keys(texts: pa.Array) -> list[int]:
    """A 64-bit hash of each text; a null is empty."""
    return [int.from_bytes(hashlib.blake2b(t or b"", digest_size=8).digest(), "little", signed=True) for t in texts.cast(pa.binary()).to_pylist()]


def _pack(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path, KNOWN_WORDS, CACHE_WORDS, letters=True)
        number = TaskContext.get().partitionId() << 24
        longs, types = pa.list_(pa.int64()), [*[pa.binary()] * 4, pa.int64(), pa.int64()]
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                # documents until the chunk has its words; one giant document makes a chunk of its own
                part = batch.slice(at, 2000)
                sizes = np.cumsum(pc.fill_null(pc.binary_length(part.column(1)), 0).to_numpy(zero_copy_only=False))
                k = max(1, int(np.searchsorted(sizes, 6 * CHUNK_WORDS)))
                part = part.slice(0, k)
                at += part.num_rows
                distinct, word, ends = split_words(part.column(1))
                hashes, begin, sizes = enc.words(distinct)
                order = np.argsort(hashes, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                n_tok = np.concatenate([[0], np.cumsum(sizes[word])])[ends]
                hashes, begin, sizes = hashes[order], begin[order], sizes[order]
                pool = enc.pool[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
                held = np.array(part.column(2).to_pylist(), bool)
                per_doc = np.diff(np.concatenate([[0], n_tok])) + 1
                row = (number, part.column(0).to_pylist(), _text_keys(part.column(1)), held.tolist(), ends.tolist(), _press(place[word], "<u4"), hashes.tobytes(), _press(pool, "<u2"), _press(sizes, "<u4"), int(per_doc.sum()), int(per_doc[~held].sum()))
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int64(), longs, longs, pa.list_(pa.bool_()), longs, *types], strict=True)], names=["chunk", "docs", "keys", "heldout", "ends", "words", "hashes", "pool", "sizes", "tokens", "train_tokens"])
        give_back()

    return run


def _word_counts(buckets: int):
    """Per chunk and range of hashes: the words' hashes and their counts in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _records(batches):
            c, hashes = Packed(r), np.frombuffer(r["hashes"], "<u8")
            count = np.bincount(c.word[np.repeat(~c.heldout, c.length)], minlength=len(hashes))
            b = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
            split = lambda x, cut=cut: np.split(x, cut[1:]) if len(cut) else []
            cols = (b[cut].astype(np.int64), np.full(len(cut), r["chunk"], np.int64), [x.tobytes() for x in split(hashes)], [_press(x, "<u8") for x in split(count)])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "chunk", "hashes", "counts"])

    return run


def _sum_counts(t: pa.Table) -> pa.Table:
    """Total counts of each chunk's words, in the order they came; distinct: trained words, on one row."""
    h = [np.frombuffer(x, "<u8") for x in t.column("hashes").to_pylist()]
    n = np.concatenate([_unpress(x, "<u8") for x in t.column("counts").to_pylist()]).astype(np.int64)
    known, inverse = np.unique(np.concatenate(h), return_inverse=True)
    total = np.zeros(len(known), np.int64)
    np.add.at(total, inverse, n)
    back = np.split(total[inverse], np.cumsum([len(x) for x in h])[:-1])
    distinct = np.zeros(len(h), np.int64)
    distinct[0] = np.count_nonzero(total)
    return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "totals": pa.array([_press(x, "<u8") for x in back], pa.binary()), "distinct": pa.array(distinct)})


def _pairs(symbol_of: np.ndarray | None, end_id: int):
    """Counts over training documents: of ids, or, given symbols, of pairs of symbols (first * SYMBOLS + second)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for r in _records(batches):
            c = Packed(r)
            # by distinct words: their inner ids or pairs, times their count; then what joins neighbouring words
            length = c.length
            train = np.repeat(~c.heldout, length)
            times = np.bincount(c.word[train], minlength=len(c.sizes))
            if symbol_of is None:
                part = np.bincount(c.pool, weights=np.repeat(times, c.sizes), minlength=1 << 16).astype(np.int64)
                part[end_id] += np.count_nonzero(~c.heldout)
            else:
                sym = symbol_of[c.pool]
                stop = np.cumsum(c.sizes)
                inner = np.ones(len(sym), bool)
                inner[(stop - c.sizes)[c.sizes > 0]] = False
                at = np.flatnonzero(inner)
                part = np.bincount(sym[at - 1] * lm.SYMBOLS + sym[at], weights=np.repeat(times, c.sizes)[at], minlength=lm.SYMBOLS**2).astype(np.int64)
                some = c.sizes > 0
                word = c.word[train & some[c.word]] if len(c.word) else c.word
                doc = np.repeat(np.arange(len(length)), length)[train & some[c.word]] if len(c.word) else c.word
                head, tail = np.zeros(len(c.sizes), np.int64), np.zeros(len(c.sizes), np.int64)
                head[some], tail[some] = sym[(stop - c.sizes)[some]], sym[stop[some] - 1]
                new = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
                before = np.where(new, 0, tail[np.concatenate([word[:1], word[:-1]])])
                part += np.bincount(before * lm.SYMBOLS + head[word], minlength=lm.SYMBOLS**2)
                last = np.flatnonzero(np.append(new[1:], True)) if len(doc) else np.zeros(0, np.int64)
                part += np.bincount(tail[word[last]] * lm.SYMBOLS, minlength=lm.SYMBOLS**2)
                part[0] += np.count_nonzero(~c.heldout) - len(last)
            total = part if total is None else total + part
        if total is not None:
            key = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(total[key].astype(np.int64))], names=["key", "n"])

    return run


class Model:
    """Everything that scoring needs; its size is set by the vocabulary."""

    def __init__(self, symbol_of: np.ndarray, rare: np.ndarray, bigram: tuple[np.ndarray, np.ndarray], weights: dict[str, np.ndarray]):
        self.symbol_of, self.rare, self.bigram, self.weights = symbol_of, rare, bigram, weights
        self.seen = 0  # windows trained on in the rounds

    def log10(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 probability of every document's ids."""
        lp = lm.score(self.weights, self.bigram, self.symbol_of[ids], starts, ends) + self.rare[ids]
        return np.add.reduceat(lp, starts) / np.log(10)


def _round_of(key: np.ndarray) -> np.ndarray:
    """The round that each text's hash puts it in."""
    return np.searchsorted(np.cumsum(SHARES), (mix(key) & np.uint64(15)).astype(np.int64), side="right")


def _spans(symbol_of: np.ndarray, k: int, groups: int, end_id: int):
    """Round k's training documents of a chunk as spans, a row for each group: each span's hash, its place in the
    document, its tokens, and how many of them are context (all that the document has, or OVERLAP + 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _records(batches):
            c = Packed(r)
            key = np.array(r["keys"], np.int64).view(np.uint64)
            pick = (_round_of(key) == k) & ~c.heldout
            if not pick.any():
                continue
            ids, starts, ends = c.only(pick).tokens(end_id)
            sym, key = symbol_of[ids], key[pick]
            n = -(-(ends - starts) // SPAN)
            doc = np.repeat(np.arange(len(n)), n)
            no = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            first = starts[doc] + no * SPAN
            begin, stop = np.maximum(first - lm.OVERLAP - 2, starts[doc]), np.minimum(first + SPAN, ends[doc])
            span = mix(key[doc] ^ mix(no.astype(np.uint64)))
            group = (span % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) > 0]))
            rows = []
            for part in np.split(order, cut[1:]):
                size = stop[part] - begin[part]
                flat = sym[np.repeat(begin[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                rows.append((int(group[part[0]]), span[part].tobytes(), _press(np.stack([no[part], size, first[part] - begin[part]]), "<i8"), _press(flat, "<u2")))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 3), strict=True)], names=["group", "spans", "shape", "sym"])

    return run


_SPANS = "group long, spans binary, shape binary, sym binary"
_WEIGHTS = "group long, seen long, weights binary"


def _train_group(model, k: int, rate: float):
    """Weights after training on a group's spans in the order of their hashes, times the windows seen."""

    def run(t: pa.Table) -> pa.Table:
        m = model.value
        span = np.concatenate([np.frombuffer(x, "<u8") for x in t.column("spans").to_pylist()])
        no, size, lead = np.concatenate([_unpress(x, "<i8").reshape(3, -1) for x in t.column("shape").to_pylist()], axis=1)
        sym = np.concatenate([_unpress(x, "<u2") for x in t.column("sym").to_pylist()]).astype(np.int64)
        order = np.lexsort((size, no, span))  # equal ones hold the same text
        at = (np.cumsum(size) - size)[order]
        no, size, lead = no[order], size[order], lead[order]
        stop = np.cumsum(size)
        sym = sym[np.repeat(at - (stop - size), size) + np.arange(len(sym))]
        group = t.column("group")[0].as_py()
        w, seen = lm.train({n: v.copy() for n, v in m.weights.items()}, m.bigram, sym, stop - size, stop, lead, no == 0, rate, [k, group])
        give_back()
        return pa.table({"group": pa.array([group], pa.int64()), "seen": pa.array([seen], pa.int64()), "weights": pa.array([(lm.flat(w) * seen).tobytes()], pa.binary())})

    return run


def _average(t: pa.Table) -> pa.Table:
    order = np.argsort(t.column("group").to_numpy())
    rows = t.column("weights").to_pylist()
    total = np.zeros(len(rows[0]) // 8)
    for i in order.tolist():
        total += np.frombuffer(rows[i], np.float64)
    return pa.table({"group": pa.array([int(t.column("group").to_numpy().min())], pa.int64()), "seen": pa.array([sum(t.column("seen").to_pylist())], pa.int64()), "weights": pa.array([total.tobytes()], pa.binary())})


def _averaged(each: DataFrame, groups: int) -> tuple[dict[str, np.ndarray] | None, int]:
    """The mean of the groups' weights by windows seen, and the windows seen in all. Sums are taken in a tree, no
    task adds more than a square root of them, and in the order of the groups."""
    each = materialize(each, "trained")
    width = max(1, int(groups**0.5))
    half = each.withColumn("part", F.col("group") % width).groupBy("part").applyInArrow(_average, _WEIGHTS)
    rows = half.withColumn("part", F.lit(0)).groupBy("part").applyInArrow(_average, _WEIGHTS).collect()
    release(each)
    return (lm.unflat(np.frombuffer(rows[0]["weights"], np.float64) / rows[0]["seen"]), rows[0]["seen"]) if rows else (None, 0)


def learn(chunks: DataFrame, tokens: int, end_id: int, vocabulary: int) -> Model:
    """Counts over all training documents, then the rounds of training."""
    pick = chunks.select("heldout", "ends", "words", "pool", "sizes")
    shape = "key long, n long"
    counts = np.zeros(1 << 16, np.int64)
    for r in pick.mapInArrow(_pairs(None, end_id), shape).groupBy("key").agg(F.sum("n").alias("n")).collect():  # at most one row an id
        counts[r["key"]] = r["n"]
    own = [i for i in np.argsort(-counts, kind="stable")[: lm.SYMBOLS - 1].tolist() if i != end_id][: lm.SYMBOLS - 2]
    symbol_of = np.full(1 << 16, lm.SYMBOLS - 1, np.int64)
    symbol_of[own] = np.arange(1, len(own) + 1)
    symbol_of[end_id] = 0
    rest = counts + 0.5
    rest[symbol_of != lm.SYMBOLS - 1] = 0
    rest[vocabulary:] = 0
    rare = np.where(rest > 0, np.log(np.maximum(rest, 1e-300) / rest.sum()), 0.0)
    pairs = pick.mapInArrow(_pairs(symbol_of, end_id), shape).groupBy("key").agg(F.sum("n").alias("n"))
    table_ = np.zeros(lm.SYMBOLS**2, np.int64)
    got = pairs.toArrow()  # at most SYMBOLS ** 2 rows
    table_[got.column("key").to_numpy()] = got.column("n").to_numpy()
    model = Model(symbol_of, rare, lm.bigram_logs(table_.reshape(lm.SYMBOLS, lm.SYMBOLS)), lm.start_weights())
    if not tokens:
        return model
    spark = chunks.sparkSession
    for k, share in enumerate(SHARES):
        groups = max(1, -(-tokens * share // (sum(SHARES) * GROUP_TOKENS)))
        tasks = min(groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
        known = spark.sparkContext.broadcast(model)
        spans = chunks.select("keys", "heldout", "ends", "words", "pool", "sizes").mapInArrow(_spans(symbol_of, k, groups, end_id), _SPANS)
        trained = spans.repartition(tasks, "group").groupBy("group").applyInArrow(_train_group(known, k, RATE * (1 - 0.9 * k / len(SHARES))), _WEIGHTS)
        new, seen = _averaged(trained, groups)
        known.unpersist()
        model.weights = new or model.weights
        model.seen += seen
    return model


def _scores(model, end_id: int, total: int, distinct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for r in _records(batches):
            c = Packed(r)
            # words come in the order of their hashes, and so do the ranges
            found = [_unpress(x["totals"], "<u8") for x in sorted(r["found"] or [], key=lambda x: x["bucket"])]
            count = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
            ends = c.ends
            each = np.log10((count + 1) / (total + distinct + 1))
            of = lambda v, w=c.word: np.diff(np.concatenate([[0], np.cumsum(v[w])])[np.concatenate([[0], ends])]) if len(v) else np.zeros(len(ends))
            end_count = r["end_count"]
            base = of(each) + np.log10((end_count + 1) / (total + distinct + 1))
            known = of((count > 0).astype(np.int64)).astype(np.int64) + (end_count > 0)
            ids, starts, stops = c.tokens(end_id)
            score = m.log10(ids, starts, stops)
            n = c.length + 1
            yield pa.RecordBatch.from_arrays([pa.array(r["docs"], pa.int64()), pa.array(c.heldout), pa.array(n), pa.array(known), pa.array(np.full(len(n), total)), pa.array(base), pa.array(score), pa.array(stops - starts)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_subwords"])

    return run


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_subwords long"


def score_documents(docs: DataFrame, held_out: Column, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, learning from those for which held_out is false (or null)."""
    spark = docs.sparkSession
    ready(spark)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path)
    vocabulary = tok.get_vocab_size()
    if vocabulary > 1 << 16:
        raise ValueError(f"the tokenizer has {vocabulary} ids; 65,536 are the most")
    end_id = vocabulary - 1  # the tokenizer's end-of-text id, which texts don't yield
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    chunks = materialize(src.mapInArrow(_pack(tokenizer_path), _CHUNK), "lm-chunks")
    n_chunks, tokens = chunks.agg(F.count("*"), F.coalesce(F.sum("train_tokens"), F.lit(0))).head()
    buckets = max(8, n_chunks // BUCKET_CHUNKS)
    counted = chunks.select("chunk", "heldout", "ends", "words", "hashes").mapInArrow(_word_counts(buckets), "bucket long, chunk long, hashes binary, counts binary")
    totals = materialize(counted.groupBy("bucket").applyInArrow(_sum_counts, "chunk long, bucket long, totals binary, distinct long"), "word-totals")
    trained = chunks.select(F.explode(F.arrays_zip(F.col("heldout").alias("h"), F.expr("transform(ends, (e, i) -> e - case when i = 0 then 0 else get(ends, i - 1) end)").alias("n"))).alias("d"))
    n_docs, n_words = trained.filter("not d.h").agg(F.count("*"), F.coalesce(F.sum("d.n"), F.lit(0))).head()
    distinct = (totals.agg(F.coalesce(F.sum("distinct"), F.lit(0))).head()[0]) + (n_docs > 0)
    model = learn(chunks, tokens, end_id, vocabulary)
    found = totals.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "totals")).alias("found"))
    both = chunks.drop("hashes", "keys").join(found, "chunk", "left").select("docs", "heldout", "ends", "words", "pool", "sizes", "found", F.lit(n_docs).cast("long").alias("end_count"))
    return both.mapInArrow(_scores(spark.sparkContext.broadcast(model), end_id, n_words + n_docs, distinct), _OUT)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score_documents(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2, public_tokenizers.path("word_bpe_49k.json"))
