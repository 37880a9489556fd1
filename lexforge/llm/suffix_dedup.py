"""Suffix-array dedup: bytes of strings of THRESHOLD bytes that also start in a document with a smaller id.

Prefix doubling with discarding, over the positions that sampling leaves. Ranking every byte position of the corpus
in each round would shuffle sixteen bytes and more per byte of text and round (README); instead

* positions are dealt by anchors. Every THRESHOLD-byte string has one: the smallest fingerprint (a hash) among its
  HALF + 1 prefixes of HALF bytes (THRESHOLD = 2 * HALF), which its bytes alone decide, so equal strings have equal
  anchors. Spark shuffles the anchors into buckets by fingerprint, and those of one document only are discarded.
  Fingerprints only deal positions out: a collision keeps a position that might have gone, and changes no result;
* the strings around the anchors that are left travel once per chunk of documents and distinct surrounding, with
  the smallest and largest document id in the chunk, so text shared by a third of all documents costs a row per
  chunk, whatever number of documents have it. Within a bucket, positions are ranked by their bytes and ranks
  doubled: pairs of ranks are sorted at growing offsets (OFFSETS) and ranked anew, and after each round positions
  whose prefix only one document has are discarded, until the threshold. Ranks come from the bytes themselves, so
  strings of equal rank are equal. Each gets the smallest document id it starts in.

The texts themselves are packed into compressed chunks once, in the shared folder; the answers go back to the
chunks, which apply them to their own occurrences. Nothing is gathered beyond a bucket, whose number grows with the
input.

Cases: a null text is empty; texts under THRESHOLD bytes lose nothing; rows with equal ids don't remove each
other's bytes; a null id neither removes nor loses; exact copies of an earlier text lose all of it; empty
tables give no rows; strings across documents don't exist; further columns of any name are ignored, and kept by
dedup_rows(). Exact copies are told by length and 128 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import few, forget, give_back, materialize, ready, release, stored, table
from lexforge.llm.hashing import hashes, mix, pack6, sums, unpack6

THRESHOLD = 50
HALF = THRESHOLD // 2
#: Bytes that the first ranks cover, and the offsets at which ranks are paired: 8, 16, 32 and THRESHOLD bytes.
FIRST, OFFSETS = 8, (8, 16, THRESHOLD - 32)
CHUNK_BYTES = 8 << 20
#: Bytes whose strings are ranked at a time, so a very long text needs no more memory.
PIECE = 1 << 20
#: Text bytes for each bucket of either round.
FIRST_BUCKET, SECOND_BUCKET = 16 << 20, 3 << 20
#: Ids of exact copies up to which their list is broadcast.
FEW = 1_000_000
#: In a sort key, the bits of the position; the rest is the hash.
PLACE_BITS = np.uint64(30)


def _piece(data: np.ndarray, a: int, b: int, starts: np.ndarray, ends: np.ndarray):
    """units() for the strings that begin in [a, b)."""
    part = data[a : b + THRESHOLD - 1]
    total = sums(part)
    n = len(part) - HALF + 1
    h = hashes(total, np.arange(n), HALF)
    low_bits = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    low, width = (h & ~low_bits) | np.arange(n, dtype=np.uint64), 1
    while 2 * width <= HALF + 1:  # minimum over HALF + 1 keys, by doubling widths
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    rest = HALF + 1 - width
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    lo, hi = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b)
    first = np.maximum(starts[lo:hi], a)
    count = np.maximum(0, np.minimum(ends[lo:hi] - THRESHOLD + 1, b) - first)
    doc = np.repeat(np.arange(lo, hi), count)
    s = np.repeat(first - a - (np.cumsum(count) - count), count) + np.arange(len(doc))
    p = (low[s] & low_bits).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])])) if len(s) else s
    times = np.diff(np.append(new, len(s)))
    # mixed again: minima crowd at the low end, buckets want them spread
    return s[new] + a, times, doc[new], mix(h[p[new]]), hashes(total, s[new], times + THRESHOLD - 1)


def units(data: np.ndarray, ends: np.ndarray, skip: np.ndarray) -> list[np.ndarray]:
    """Runs of THRESHOLD-byte strings with one anchor: first start, number of strings, document, the anchor's
    hash and the hash of all the bytes. Documents in skip have none."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    shut = np.where(skip, starts, ends)
    none = np.zeros(0, np.int64)
    found = [_piece(data, a, min(a + PIECE, len(data)), starts, shut) for a in range(0, len(data) - THRESHOLD + 1, PIECE)]
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [none, none, none, none.astype(np.uint64), none.astype(np.uint64)]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def short(h: np.ndarray) -> np.ndarray:
    """The 47 upper bits, shifted to leave room for a flag."""
    return (h >> np.uint64(17)) << np.uint64(1)


class Chunk:
    """Documents of a chunk, unpacked, with their units."""

    def __init__(self, docs: list, ends: list[int], blob: bytes):
        import zstandard

        self.docs = docs
        self.ends = np.array(ends, dtype=np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(1, ends[-1])) if ends[-1] else b"", np.uint8)
        self.skip = np.array([d is None for d in docs], dtype=bool)

    def anchors(self):
        self.start, self.count, self.doc, self.hash, self.same = units(self.data, self.ends, self.skip)
        self.kept, self.inverse = np.unique(short(self.hash), return_inverse=True)
        return self


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard
    from pyspark import TaskContext

    press = zstandard.ZstdCompressor(level=3)
    number = TaskContext.get().partitionId() << 24
    docs, marks, lens, parts, size = [], [], [], [], 0

    def packed():
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([marks], pa.list_(pa.int64())), pa.array([np.cumsum(lens).tolist()], pa.list_(pa.int64())), pa.array([press.compress(b"".join(parts))], pa.binary()), pa.array([size], pa.int64())], names=["chunk", "docs", "marks", "ends", "blob", "bytes"])

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for i, raw, h in zip(ids, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = raw or b""
            if docs and size + len(raw) > CHUNK_BYTES:
                yield packed()
                number += 1
                docs, marks, lens, parts, size = [], [], [], [], 0
            docs.append(i)
            marks.append(h)
            lens.append(len(raw))
            parts.append(raw)
            size += len(raw)
    if docs:
        yield packed()


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for r in range(batch.num_rows):
            yield tuple(c[r].as_py() for c in cols)


def _first_round(buckets: int):
    """Per chunk and bucket the distinct anchors' ranks; the flag tells that two documents of the chunk have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, docs, ends, blob in _rows(batches, "chunk", "docs", "ends", "blob"):
            c = Chunk(docs, ends, blob).anchors()
            low, high = np.full(len(c.kept), 1 << 62), np.full(len(c.kept), -1)
            np.minimum.at(low, c.inverse, c.doc)
            np.maximum.at(high, c.inverse, c.doc)
            value = c.kept | (low != high).astype(np.uint64)
            b = bucket_of(c.kept << np.uint64(16), buckets)
            cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
            raw = [pack6(x) for x in np.split(value, cut[1:])] if len(b) else []
            yield pa.RecordBatch.from_arrays([pa.array(b[cut].astype(np.int64)), pa.array(np.full(len(cut), chunk, np.int64)), pa.array(raw, pa.binary())], names=["bucket", "chunk", "ranks"])

    return run


def _discard(t: pa.Table) -> pa.Table:
    """Which ranks of each chunk occur in another document, a bit each."""
    value = [unpack6(r) for r in t.column("ranks").to_pylist()]
    every = np.concatenate(value)
    plain = every >> np.uint64(1)
    _, inverse = np.unique(plain, return_inverse=True)
    often = np.bincount(inverse) > 1
    often |= np.bincount(inverse, weights=(every & np.uint64(1)).astype(float)) > 0
    flags = np.split(often[inverse], np.cumsum([len(v) for v in value])[:-1])
    return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "bits": pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())})


class Around:
    """The surroundings of a chunk's surviving anchors by bucket: every occurrence's first start and document id,
    with equal ones together, and the distinct surroundings (index of the first occurrence, number of them)."""

    def __init__(self, c: Chunk, bits: list, first_buckets: int, buckets: int):
        b = bucket_of(c.kept << np.uint64(16), first_buckets)
        alive = np.zeros(len(c.kept), bool)
        for x in bits:
            lo, hi = np.searchsorted(b, [x["bucket"], x["bucket"] + 1])
            alive[lo:hi] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=hi - lo).astype(bool)
        take = np.flatnonzero(alive[c.inverse])
        where = bucket_of(c.kept[c.inverse[take]] << np.uint64(16), buckets)
        order = np.lexsort((c.start[take], c.same[take], where))
        take, where = take[order], where[order]
        self.start, self.count, same = c.start[take], c.count[take], c.same[take]
        self.ids = np.array([-1 if d is None else d for d in c.docs], np.int64)[c.doc[take]]
        self.first = np.flatnonzero(np.concatenate([[True], (same[1:] != same[:-1]) | (where[1:] != where[:-1])])) if len(take) else take
        self.times = np.diff(np.append(self.first, len(take)))
        self.where = where[self.first].astype(np.int64)
        self.cut = np.flatnonzero(np.concatenate([[True], self.where[1:] != self.where[:-1]])) if len(take) else take

    def buckets(self) -> Iterator[tuple[int, slice]]:
        """Each bucket and its distinct surroundings."""
        for a, b in zip(self.cut.tolist(), [*self.cut[1:].tolist(), len(self.first)], strict=True):
            yield int(self.where[a]), slice(a, b)


def _second_round(first_buckets: int, buckets: int):
    """The surroundings of the surviving anchors of a chunk, each distinct one once, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, docs, ends, blob, bits in _rows(batches, "chunk", "docs", "ends", "blob", "bits"):
            c = Chunk(docs, ends, blob).anchors()
            x = Around(c, bits, first_buckets, buckets)
            if not len(x.first):
                continue
            low, high = np.minimum.reduceat(x.ids, x.first), np.maximum.reduceat(x.ids, x.first)
            lens, start = x.count[x.first] + THRESHOLD - 1, x.start[x.first]
            out = []
            for bucket, u in x.buckets():
                n = lens[u]
                pos = np.repeat(start[u] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                out.append((bucket, chunk, c.data[pos].tobytes(), n.astype("<u2").tobytes(), low[u].astype("<i8").tobytes(), high[u].astype("<i8").tobytes()))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(x, pa.binary()) for x in cols[2:]]], names=["bucket", "chunk", "text", "lens", "low", "high"])
        give_back()

    return run


def dense(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks from 0 of the values, equal ones sharing theirs, and how many there are."""
    order = np.argsort(x)
    new = np.concatenate([[0], x[order][1:] != x[order][:-1]]) if len(x) else order
    rank = np.empty(len(x), np.int64)
    rank[order] = np.cumsum(new)
    return rank, int(rank[order[-1]]) + 1 if len(x) else 0


def smallest_ids(data: np.ndarray, s: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For the THRESHOLD-byte strings that begin at s, each in documents with ids from low to high: the smallest low of all
    equal strings. A string of one document may get its own low early, when its prefix has told so."""
    out = low.copy()
    if not len(s):
        return out
    padded = np.concatenate([data, np.zeros(FIRST, np.uint8)])
    words = np.zeros(len(data), np.uint64)
    for k in range(FIRST):
        words = (words << np.uint64(8)) | padded[k : k + len(data)]
    rank, kinds = dense(words)
    live = np.arange(len(s))
    for offset in (0, *OFFSETS):
        if offset:
            # pairs of ranks; beyond the end of data no string needs one
            later = np.concatenate([rank[offset:], np.zeros(min(offset, len(rank)), np.int64)])
            if offset != OFFSETS[-1]:
                rank, kinds = dense(rank * kinds + later)
                mine = rank[s[live]]
            else:
                mine, kinds = dense((rank * kinds + later)[s[live]])
        else:
            mine = rank[s[live]]
        least, most = np.full(kinds, np.iinfo(np.int64).max), np.full(kinds, np.iinfo(np.int64).min)
        np.minimum.at(least, mine, low[live])
        np.maximum.at(most, mine, high[live])
        shared = least[mine] != most[mine]
        live, mine = live[shared], mine[shared]
    out[live] = least[mine]
    return out


def _rank(t: pa.Table) -> pa.Table:
    """For each chunk with a string that a smaller document has: the smallest id of every string, in order."""
    import zstandard

    join = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()])
    data, lens = join("text", np.uint8), join("lens", "<u2").astype(np.int64)
    low, high = join("low", "<i8"), join("high", "<i8")
    # a surrounding that several chunks have is ranked once
    raw, end = data.tobytes(), np.cumsum(lens)
    index: dict[bytes, int] = {}
    of = np.fromiter((index.setdefault(raw[a:b], len(index)) for a, b in zip((end - lens).tolist(), end.tolist(), strict=True)), np.int64, len(lens))
    size = np.fromiter(map(len, index), np.int64, len(index))
    least_id, most_id = np.full(len(index), np.iinfo(np.int64).max), np.full(len(index), np.iinfo(np.int64).min)
    np.minimum.at(least_id, of, low)
    np.maximum.at(most_id, of, high)
    strings = size - THRESHOLD + 1
    begin = np.cumsum(strings) - strings
    s = np.repeat(np.cumsum(size) - size - begin, strings) + np.arange(strings.sum())
    ranked = smallest_ids(np.frombuffer(b"".join(index), np.uint8), s, np.repeat(least_id, strings), np.repeat(most_id, strings))
    count = strings[of]
    upto = np.cumsum(count)
    least = ranked[np.repeat(begin[of] - (upto - count), count) + np.arange(count.sum())]
    hit = least < np.repeat(high, count)
    stop = upto[np.cumsum([len(x) // 2 for x in t.column("lens").to_pylist()]) - 1].tolist()
    press, rows = zstandard.ZstdCompressor(level=1), []
    for chunk, bucket, a, b in zip(t.column("chunk").to_pylist(), t.column("bucket").to_pylist(), [0, *stop[:-1]], stop, strict=True):
        if hit[a:b].any():
            rows.append((chunk, bucket, press.compress(least[a:b].astype("<i8").tobytes())))
    cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
    give_back()
    return pa.table({"chunk": pa.array(cols[0], pa.int64()), "bucket": pa.array(cols[1], pa.int64()), "least": pa.array(cols[2], pa.binary())})


def _covered(c: Chunk, bits: list, found: list, first_buckets: int, buckets: int) -> np.ndarray:
    """Which bytes of a chunk strings of smaller documents cover, from the smallest ids of its strings."""
    import zstandard

    change = np.zeros(len(c.data) + 1, np.int32)
    x = Around(c.anchors(), bits, first_buckets, buckets)
    answers, press = {f["bucket"]: f["least"] for f in found}, zstandard.ZstdDecompressor()
    for bucket, u in x.buckets():
        if bucket not in answers:
            continue
        least = np.frombuffer(press.decompress(answers[bucket]), "<i8")
        first, times = x.first[u], x.times[u]
        n = x.count[first]
        # every occurrence of every surrounding
        occ = slice(int(first[0]), int(first[-1] + times[-1]))
        unit = np.repeat(np.arange(len(first)), times)
        m = n[unit]
        at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        gone = least[np.repeat((np.cumsum(n) - n)[unit], m) + at] < np.repeat(x.ids[occ], m)
        place = (np.repeat(x.start[occ], m) + at)[gone]
        np.add.at(change, place, 1)
        np.add.at(change, place + THRESHOLD, -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def _result(with_text: bool, first_buckets: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for docs, marks, ends, blob, bits, found in _rows(batches, "docs", "marks", "ends", "blob", "bits", "found"):
            c = Chunk(docs, ends, blob)
            gone = _covered(c, bits, found, first_buckets, buckets) if found else np.zeros(len(c.data), bool)
            out, a = [], 0
            for d, h, b in zip(docs, marks, ends, strict=True):
                g, raw = gone[a:b], c.data[a:b]
                kept = raw[~g].tobytes()
                spans = int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])) if len(g) else 0
                out.append((d, b - a, int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None, h))
                a = b
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in cols[:4]], pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.int64())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "source_hash"])
        give_back()

    return run


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, source_hash long"


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text and source_hash (xxhash64 of the text) of every row. kept_text, if asked for, drops
    characters that a removal cut through."""
    spark = docs.sparkSession
    ready(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sig = src.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"))
    sig = materialize(sig.filter((F.col("n") >= THRESHOLD) & F.col("doc_id").isNotNull()), "texts")
    first = materialize(sig.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first <> last").drop("last"), "first")
    copies = materialize(sig.join(first.hint("merge"), ["n", "h1", "h2"]).filter("doc_id > first").select("doc_id", "n", "h1"), "copies")
    release(sig)
    release(first)
    names = few(copies.select(F.col("doc_id").alias("i"), F.col("h1").alias("h")).distinct(), FEW)
    rest = src.join(names, (F.col("doc_id") == F.col("i")) & (F.xxhash64("text") == F.col("h")), "left_anti")
    packed = rest.select("doc_id", F.col("text").cast("binary").alias("raw"), F.xxhash64("text").alias("h")).mapInArrow(_chunks, "chunk long, docs array<long>, marks array<long>, ends array<long>, blob binary, bytes long")
    chunks = materialize(packed, "chunks")
    volume = chunks.agg(F.sum("bytes")).head()[0] or 0
    few_buckets, many_buckets = max(16, -(-volume // FIRST_BUCKET)), max(16, -(-volume // SECOND_BUCKET))
    ranks = chunks.mapInArrow(_first_round(few_buckets), "bucket long, chunk long, ranks binary")
    bits = ranks.groupBy("bucket").applyInArrow(_discard, "chunk long, bucket long, bits binary")
    bits = materialize(bits.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits")), "alive")
    around = chunks.join(bits, "chunk").select("chunk", "docs", "ends", "blob", "bits").mapInArrow(_second_round(few_buckets, many_buckets), "bucket long, chunk long, text binary, lens binary, low binary, high binary")
    answers = around.groupBy("bucket").applyInArrow(_rank, "chunk long, bucket long, least binary")
    found = materialize(answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "least")).alias("found")), "found")
    out = chunks.join(bits.join(found, "chunk"), "chunk", "left").select("docs", "marks", "ends", "blob", "bits", "found").mapInArrow(_result(with_text, few_buckets, many_buckets), _OUT)
    empty = hashlib.sha256(b"").hexdigest()
    whole = copies.select("doc_id", F.col("n").cast("long").alias("n_bytes"), F.col("n").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(empty).alias("kept_sha256"), F.lit("" if with_text else None).cast("string").alias("kept_text"), F.col("h1").alias("source_hash"))
    return out.unionByName(whole)


def dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' own rows and columns with text_col shortened; rows that lose all of a text go."""
    names = docs.columns
    keyed = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs[id_col].cast("long").alias("i"), F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("t"))
    before = stored()
    cut = dedup_substrings(docs, id_col, text_col, with_text=True)
    on_the_way = stored() - before
    cut = materialize(cut.filter("n_removed > 0").select("doc_id", "source_hash", "n_bytes", "n_removed", "kept_text").dropDuplicates(["doc_id", "source_hash"]), "shortened")
    forget(on_the_way)
    both = keyed.join(cut.hint("merge"), (keyed["i"] == cut["doc_id"]) & (keyed["t"] == cut["source_hash"]), "left")
    both = both.filter("n_removed is null or n_removed < n_bytes")
    return both.select(*[F.coalesce(cut["kept_text"], F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names])


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("kept_text", "source_hash")


#: Bytes as pairs of hex digits; for tables without null or repeated ids.
OP9_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, unnest(range(0, length(x) // 2 - 49)) AS s, x FROM d WHERE length(x) >= 100),
k AS (SELECT doc_id, s, md5(substr(x, 2 * s + 1, 100)) AS g FROM w),
m AS (SELECT g, min(doc_id) AS least FROM k GROUP BY g HAVING min(doc_id) <> max(doc_id)),
h AS (SELECT doc_id, s FROM k JOIN m USING (g) WHERE doc_id > least),
e AS (SELECT *, s - max(s) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM h),
r AS (SELECT doc_id, s, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM e),
z AS (SELECT doc_id, run, min(s) AS a, max(s) + 50 AS b FROM r GROUP BY doc_id, run),
p AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM z),
q AS (SELECT p.doc_id, sum(b - a) AS gone, count(*) AS spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept
      FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, length(d.x) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, d.x))) AS kept_sha256
FROM d LEFT JOIN q ON q.doc_id = d.doc_id
"""
