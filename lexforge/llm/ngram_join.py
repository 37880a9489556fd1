"""N-gram Jaccard join by vertical partitioning.

The global n-gram order is that of a 64-bit hash. Cutting it at fixed places cuts every document's set into
fragments. Two sets at or above the threshold differ in at most D = (na + nb)(1 - s)/(1 + s) n-grams, so of
D + 1 + R fragments at least R + 1 are equal in both: documents meet on hashes of whole fragments, and only if
they share R + 1 of theirs with others, so frequent n-grams or a common passage bring nobody together. The
number of fragments depends on the size class; a class is as wide as the threshold allows, so a set sends the
fragments of its own class and of the next.

Exact copies of a set are one node. Every chunk of documents sends its distinct keys once, by bucket, and gets
back which are shared, so a key costs a row per chunk at most. Nodes that share a fragment are compared with
the smallest node that has it, their leader: the overlap of each of PARTS fragments of the order is counted
separately and summed per pair, and what differs from the leader is kept by fragment. Nodes x, y of a leader's
family that are not in one component yet become candidates if they meet on the rarest n-grams of these short
differences, with prefix lengths from both sizes. Their overlap too is counted by fragment and summed per pair:
fragment f of x and y differs in |dx| + |dy| - 2 |dx & dy| n-grams, where dx and dy are what differs there from the
leader, so short lists give the count that the fragments would. So near copies that are not linked, however many,
hardly meet, and no group is expanded into its pairs.

Cases: a null or empty text, or one without words, has the empty set and is linked with nothing; fewer words
than a shingle make one shingle; repeated rows get the same component; rows with equal ids and other texts are
separate nodes that report that id; an empty table gives no rows; further columns are ignored. 64-bit n-gram
hashes are taken as the n-grams, their upper 48 bits within a compared pair; sets are equal when size and a
128-bit sum agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.llm.common import components, few, materialize, ready, release, table
from lexforge.llm.hashing import hash_strings, mix, pack6, split_words, unpack6

WIDTH, PERCENT = 3, 90
#: Vertical fragments in which a pair's overlap is counted.
PARTS = 4
#: Rows of longs up to which a table is broadcast.
FEW = 200_000
#: Keys for each bucket in which chunks' keys meet.
BUCKET_KEYS = 500_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    distinct, word, ends = split_words(texts)
    w = mix(hash_strings(distinct))[word]
    offsets = np.concatenate([[0], ends])
    n = len(w)
    with np.errstate(over="ignore"):
        whole = np.full(max(0, n - width + 1), np.uint64(width))
        for k in range(width):
            whole = mix(whole * _M1 + w[k : n - width + 1 + k])
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a >= width:
                u = np.unique(whole[a : b - width + 1])
            elif b > a:
                u = np.full(1, np.uint64(b - a))
                for k in range(a, b):
                    u = mix(u * _M1 + w[k : k + 1])
            else:
                u = whole[:0]
            out.append(u)
    return out


def classes(percent: int, most: int) -> np.ndarray:
    """First size of each size class, up to one beyond most: class k's largest partner lies in class k + 1."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // percent + 1)
    return np.array([*out, out[-1] * 100 // percent + 1, (out[-1] * 100 // percent + 1) * 100 // percent + 1])


def fragments(first: np.ndarray, k: int, percent: int) -> tuple[int, int]:
    """Number of fragments at level k, and how many of them a pair of its sizes has in common at least. D, the most
    n-grams in which such a pair may differ, and a reserve of a quarter of D make D + 1 + reserve fragments."""
    differ = int(2 * (first[k + 1] - 1) * (100 - percent) // (100 + percent))
    if not differ:
        return 1, 1
    reserve = -(-differ // 4) + 1
    return differ + 1 + reserve, reserve + 1


def fragment_keys(u: np.ndarray, first: np.ndarray, percent: int) -> list[tuple[np.ndarray, int, int]]:
    """At set u's own level and the next: hashes of its fragments, how many empty ones are left out, and how many
    fragments it shares with any partner. Empty fragments are left out unless they are as many as that."""
    k = int(np.searchsorted(first, len(u), side="right")) - 1
    out = []
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(u))])
    for level in (k, k + 1):
        m, least = fragments(first, level, percent)
        if m == 1:  # no two different sets of these sizes are linked
            out.append((u[:0], 0, 1))
            continue
        place = np.arange(m, dtype=np.uint64)
        # fragment f: hashes from f/m of the range on
        cuts = np.append(np.searchsorted(u, place * np.uint64((1 << 64) // m)), len(u))
        full = np.diff(cuts) > 0
        with np.errstate(over="ignore"):
            keys = mix(sums[cuts[1:]] - sums[cuts[:-1]] + mix(np.uint64(level << 32) + place))
        gaps = m - int(np.count_nonzero(full))
        out.append((keys, 0, least) if gaps >= least else (keys[full], gaps, least))
    return out


def _signature(u: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(u.sum(dtype=np.uint64).view(np.int64)), int(mix(u ^ _M2).sum(dtype=np.uint64).view(np.int64))


def _sets(width: int, percent: int):
    """Chunks of documents with their sets' sizes, signatures and fragment keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 20
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sets = shingle_sets(part.column(1), width)
                first = classes(percent, max(map(len, sets)))
                sig = [_signature(u) for u in sets]
                levels = [x for u in sets for x in fragment_keys(u, first, percent)]  # two a document
                flat = np.concatenate([x[0] for x in levels]) >> np.uint64(16)
                cols = ([chunk], [part.column(0).to_pylist()], [[len(u) for u in sets]], [[x[0] for x in sig]], [[x[1] for x in sig]], [pack6(flat)], [np.array([(len(x), gaps, least) for x, gaps, least in levels], "<u4").tobytes()], [len(flat)])
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), longs, longs, longs, longs, pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["chunk", "docs", "n", "s1", "s2", "keys", "counts", "total"])
                chunk += 1

    return run


def _keys_of(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk, without copies: the level (2 * document, + 1) of each key, the distinct keys, each key's place in
    them; and for every level its number of keys, of empty fragments left out, and of those that partners share."""
    k = unpack6(r["keys"])
    shape = np.frombuffer(r["counts"], "<u4").reshape(-1, 3).astype(np.int64)
    level = np.repeat(np.arange(len(shape)), shape[:, 0])
    if r["copies"]:
        keep = ~np.isin(level >> 1, r["copies"])
        k, level = k[keep], level[keep]
    known, inverse = np.unique(k, return_inverse=True)
    return level, known, inverse, shape


def _key_bucket(k: np.ndarray, buckets: int) -> np.ndarray:
    return (k * np.uint64(buckets)) >> np.uint64(48)


def _send_keys(buckets: int):
    """Per bucket the chunk's distinct keys; the lowest bit tells that two documents of the chunk have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                level, known, inverse, _ = _keys_of(r)
                if not len(known):
                    continue
                b = _key_bucket(known, buckets)
                cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
                flagged = known & ~np.uint64(1) | (np.bincount(inverse, minlength=len(known)) > 1).astype(np.uint64)
                # keys are sorted, so a bucket is a stretch of them
                rows = [(int(b[i]), r["chunk"], pack6(x)) for i, x in zip(cut, np.split(flagged, cut[1:]), strict=True)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "chunk", "keys"])

    return run


def _shared(t: pa.Table) -> pa.Table:
    """Which keys of each chunk two sets have, a bit each."""
    k = [unpack6(x) for x in t.column("keys").to_pylist()]
    every = np.concatenate(k)
    _, inverse = np.unique(every >> np.uint64(1), return_inverse=True)
    met = np.bincount(inverse) + np.bincount(inverse, weights=(every & np.uint64(1)).astype(float)) > 1
    bits = [np.packbits(m).tobytes() for m in np.split(met[inverse], np.cumsum([len(x) for x in k])[:-1])]
    return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "bits": pa.array(bits, pa.binary())})


def _members(buckets: int):
    """key, node and size for the shared keys of nodes that share as many as a partner would."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                level, known, inverse, shape = _keys_of(r)
                b = _key_bucket(known, buckets)
                met = np.zeros(len(known), bool)
                for x in r["found"]:
                    lo, hi = np.searchsorted(b, [x["bucket"], x["bucket"] + 1])
                    met[lo:hi] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=hi - lo).astype(bool)
                each = met[inverse]
                enough = np.bincount(level, weights=each, minlength=len(shape)) + shape[:, 1] >= shape[:, 2]
                take = each & enough[level]
                doc = level[take] >> 1
                n = np.array(r["n"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(known[inverse[take]].view(np.int64)), pa.array((r["chunk"] << 16) | doc), pa.array(n[doc])], names=["key", "rid", "n"])

    return run


def _parts(width: int, parts: int):
    """Signature and the set's fragments, for the sets that are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = []
                for u in shingle_sets(batch.slice(at, 2000).column(0), width):
                    cuts = [0, *np.searchsorted(u, np.array([(f << 64) // parts for f in range(1, parts)], dtype=np.uint64)).tolist(), len(u)]
                    rows.append((len(u), *_signature(u), [pack6(u[a:b] >> np.uint64(16)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.binary()))], names=["n", "s1", "s2", "frags"])

    return run


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one fragment of a pair: the overlap, the second one's n-grams, and those that only one of the two has."""
    for batch in batches:
        x, y = batch.column(5).to_pylist(), batch.column(6).to_pylist()
        n, own, rest = [], [], []
        for a, b in zip(x, y, strict=True):
            u, v = unpack6(a).view(np.int64), unpack6(b).view(np.int64)
            d = np.setxor1d(u, v, assume_unique=True)
            n.append((len(u) + len(v) - len(d)) // 2)
            own.append(len(v))
            rest.append(d)
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(n, pa.int64()), pa.array(own, pa.int64()), pa.array(rest, pa.list_(pa.int64()))], names=["a", "b", "na", "nb", "f", "part", "own", "rest"])


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb, f (a fragment), part (the overlap there), own (b's n-grams there) and rest (those that one of
    the two has) of every pair and fragment."""
    left, right = sets.select(F.col("node").alias("a"), "f", F.col("frag").alias("fa")), sets.select(F.col("node").alias("b"), "f", F.col("frag").alias("fb"))
    each = pairs.join(left, "a").join(right, ["b", "f"]).select("a", "b", "na", "nb", "f", "fa", "fb")
    return each.mapInArrow(_overlap, "a long, b long, na long, nb long, f int, part long, own long, rest array<long>")


def _linked(percent: int, both: str, n1: str, n2: str):
    return F.expr(f"100 * {both} >= {percent} * ({n1} + {n2} - {both})")


def _within_families(frags: DataFrame, pairs: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes of one leader's family that comp has in different components. frags: _compare() of
    the families; pairs: a, b, nb and m, the n-grams in which b differs from its leader a."""
    home = lambda df, node, name: df.join(comp.select(F.col("node").alias(node), F.col("comp").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))
    # by leader first, so that the many nodes of one can be split between tasks
    named = materialize(home(home(pairs.select("a", "b", "nb", "m"), "a", "ca"), "b", "cb"), "named")
    unsettled = materialize(named.groupBy("a").agg(F.max(F.col("ca") != F.col("cb")).alias("open")).filter("open").select("a"), "unsettled")
    fam = materialize(named.drop("ca").join(unsettled, "a", "left_semi"), "families")
    tok = frags.select("a", "b", "rest").join(fam.select("a", "b"), ["a", "b"]).select("a", "b", F.explode("rest").alias("t"))
    often = materialize(tok.groupBy("a", "t").agg(F.count("*").alias("df")).filter("df > 1"), "often")
    held = tok.join(often, ["a", "t"]).join(fam, ["a", "b"])
    # place of an n-gram in its node's difference, rarest first; those nobody else has come before all others
    w = Window.partitionBy("a", "b")
    held = held.withColumn("at", F.col("m") - F.count("*").over(w) + F.row_number().over(w.orderBy("df", "t")))
    most = f"cast(floor(nb * {100 - percent} / {percent}) as int) + 1"
    # a pair may meet in several families, at most as many as a node has fragments; it is taken in the first that
    # both belong to
    homes = fam.groupBy("b").agg(F.collect_set("a").alias("homes"))
    held = materialize(held.filter(f"at <= {most}").select("a", "t", "b", "nb", "m", "at", "cb").join(homes, "b"), "places")
    release(often)
    x, y = held.select("a", "t", *[F.col(c).alias(f"{c}1") for c in ("b", "nb", "m", "at", "cb", "homes")]), held.select("a", "t", *[F.col(c).alias(f"{c}2") for c in ("b", "nb", "m", "at", "cb", "homes")])
    differ = f"cast(floor((nb1 + nb2) * {100 - percent} / {100 + percent}) as int)"
    share = f"cast(ceil((m1 + m2 - {differ}) / 2) as int)"
    met = x.join(y, ["a", "t"]).filter(F.expr(f"b1 < b2 and cb1 <> cb2 and at1 <= m1 - {share} + 1 and at2 <= m2 - {share} + 1 and a = array_min(array_intersect(homes1, homes2))"))
    met = materialize(met.select("a", "b1", "b2").distinct(), "candidates")
    # the overlap of each fragment, summed per pair
    side = lambda k: frags.select("a", "f", F.col("b").alias(f"b{k}"), F.col("nb").alias(f"n{k}"), F.col("own").alias(f"own{k}"), F.col("rest").alias(f"rest{k}"))
    each = met.join(side(1), ["a", "b1"]).join(side(2), ["a", "b2", "f"])
    part = "own1 + own2 - size(rest1) - size(rest2) + 2 * size(array_intersect(rest1, rest2))"
    both = each.groupBy("b1", "b2", "n1", "n2").agg((F.sum(F.expr(part)) / 2).cast("long").alias("both"))
    out = materialize(both.filter(_linked(percent, "both", "n1", "n2")).select(F.col("b1").alias("a"), F.col("b2").alias("b")), "links2")
    for t in (named, unsettled, fam, held, met):
        release(t)
    return out


def join_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    ready(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chunks = materialize(src.mapInArrow(_sets(width, percent), "chunk long, docs array<long>, n array<long>, s1 array<long>, s2 array<long>, keys binary, counts binary, total long"), "sets")
    rows = materialize(chunks.select("chunk", F.posexplode(F.arrays_zip("docs", "n", "s1", "s2")).alias("at", "d")).select(F.expr("shiftleft(chunk, 16) + at").alias("rid"), F.col("d.docs").alias("doc_id"), "d.n", "d.s1", "d.s2"), "rows")
    same = ["n", "s1", "s2"]
    nodes = materialize(rows.filter("n > 0").groupBy(*same).agg(F.min("rid").alias("node"), F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "nodes")
    shared = nodes.filter("copies > 1").select(*same, "node")
    copies = rows.select("rid", *same).join(shared.hint("merge"), same).filter("rid <> node").select(F.expr("shiftright(rid, 16)").alias("chunk"), F.expr("cast(rid & 65535 as int)").alias("at"))
    copies = materialize(copies.groupBy("chunk").agg(F.collect_list("at").alias("copies")), "copies")  # at most a chunk's documents
    keyed = chunks.select("chunk", "n", "keys", "counts").join(copies, "chunk", "left")
    buckets = max(16, (chunks.agg(F.sum("total")).head()[0] or 0) // BUCKET_KEYS)
    sent = keyed.mapInArrow(_send_keys(buckets), "bucket long, chunk long, keys binary")
    met = sent.groupBy("bucket").applyInArrow(_shared, "chunk long, bucket long, bits binary")
    met = materialize(met.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("found")), "met")
    members = materialize(keyed.join(met, "chunk").mapInArrow(_members(buckets), "key long, rid long, n long"), "members")
    for t in (chunks, met, copies):
        release(t)
    own = F.struct(F.col("rid"), F.col("n"))
    leads = members.groupBy("key").agg(F.min(own).alias("lead"), F.max("rid").alias("last")).filter("lead.rid <> last").select("key", "lead")
    star = members.join(leads, "key").filter("rid <> lead.rid")
    first = materialize(star.select(F.col("lead.rid").alias("a"), F.col("rid").alias("b"), F.col("lead.n").alias("na"), F.col("n").alias("nb")).distinct(), "pairs")
    release(members)

    # the sets of all members, from their texts
    compared = first.select(F.col("a").alias("node")).unionByName(first.select(F.col("b").alias("node"))).distinct()
    who = materialize(compared.join(nodes.select("node", *same), "node").join(rows.select(F.col("rid").alias("node"), "doc_id"), "node"), "compared")
    texts = src.join(few(who.select("doc_id").distinct(), FEW), "doc_id", "left_semi").select("text")
    found = texts.mapInArrow(_parts(width, PARTS), "n long, s1 long, s2 long, frags array<binary>").join(who.select("node", *same), same).dropDuplicates(["node"])
    sets = materialize(found.select("node", F.posexplode("frags").alias("f", "frag")), "parts")

    frags = materialize(_compare(first, sets), "fragments")
    release(sets)
    pairs = materialize(frags.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"), F.sum(F.size("rest")).alias("m")), "overlaps")
    links = materialize(pairs.filter(_linked(percent, "both", "na", "nb")).select("a", "b"), "links")
    near = components(links, "near")
    more = _within_families(frags, pairs, near, percent)
    comp = components(links.unionByName(more), "near2")
    for t in (frags, pairs, links, near, more):
        release(t)

    named = nodes.join(comp, "node", "left").select(*same, "rep", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component"))
    by_set = materialize(named.join(least, "comp").select(*same, "component"), "components")
    out = rows.select("doc_id", *same).join(by_set, same, "left")
    for t in (first, who, nodes, comp):
        release(t)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 90 * (x.n + y.n - n_both)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
