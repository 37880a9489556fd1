"""The ten operators against brute force, round trips and held-out accuracy, on small frames with odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm import html_render, line_dedup, lm_scoring, ngram_join, packing, quality_classifier, quality_rules, sp_codec, suffix_dedup, topk_search
from lexforge.llm.common import crc_mod

tokenizers = pytest.importorskip("public_tokenizers")
WORDS = [a + b for a in "ka lo mi ru te so vi na".split() for b in "n r st l ng".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    out = [None, "", " \n\t", "one", "one two", "one two", "ONE  two", "é ß 中文\x0bx\x0cy\r\nz"]
    base = [prose(rng, rng.randint(5, 120)) for _ in range(25)]
    out += base + base[:5]
    shared = prose(rng, 30)
    out += [prose(rng, 20) + "\n" + shared + "\n" + prose(rng, 5) for _ in range(6)]
    lines = [prose(rng, 6) for _ in range(5)]
    out += ["\n".join(lines), "\n".join([prose(rng, 4), *lines[1:], prose(rng, 3)]), "\n".join(lines[:1] * 7)]
    long = prose(rng, 3000)
    out += [long, long + " end", "x" * 5000]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(None if i == 30 else i, t, "n", "m") for i, t in enumerate(texts)]
    rows += [rows[12], rows[13]]  # the same rows again
    return spark.createDataFrame(rows, "doc_id long, text string, n string, s string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# 1


def test_classifier_learns_and_scores_all(spark):
    rng = random.Random(2)
    rows = [(i, (prose(rng, 80) if i % 4 else " ".join(w.upper() + "$$$" for w in prose(rng, 60).split())), int(i % 4 > 0)) for i in range(240)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, ""), (1001, None)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality_classifier.train(d, lab, crc_mod("doc_id", 3) != 1)
    got = {r["doc_id"]: r for r in quality_classifier.score_documents(d, model).collect()}
    assert len(got) == 242 and all(0 <= r["score"] <= 1 for r in got.values()) and got[1000]["score"] == got[1001]["score"]
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["predicted"] == y for i, y in held) > 0.9 * len(held)
    none = quality_classifier.train(d, lab.limit(0), crc_mod("doc_id", 3) != 1)
    assert {r["score"] for r in quality_classifier.score_documents(d, none).collect()} == {0.5}


def test_classifier_sizes_and_scores_by_hand(spark):
    import zstandard as z

    rng = random.Random(5)
    rows = [(i, (prose(rng, 120) if i % 2 else prose(rng, 60).upper())) for i in range(80)]
    lab = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    rows += [(3, "another text of the same id"), (200, "é ß 中文 " * 400), (None, "null id"), (201, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    everything = F.lit(True)
    model = quality_classifier.train(d, lab, everything)
    again = quality_classifier.train(d.repartition(1), lab, everything)
    assert (model.good, model.bad, model.weights) == (again.good, again.bad, again.weights)
    a, c = model.weights

    def size(text, dictionary):
        how = z.ZstdCompressor(level=3, dict_data=z.ZstdCompressionDict(dictionary), write_checksum=False, write_content_size=False, write_dict_id=False)
        raw = text.encode()
        return sum(len(how.compress(raw[k : k + 512])) for k in range(0, len(raw), 512))

    want = Counter()
    for i, t in rows:
        bad, good = size(t, model.bad), size(t, model.good)
        want[(i, round((bad - good) / (bad + good) if t else 0.0, 9))] += 1
    got = quality_classifier.score_documents(d, model).collect()
    assert Counter((r["doc_id"], round(r["size_difference"], 9)) for r in got) == want
    for r in got:
        assert abs(r["score"] - 1 / (1 + np.exp(-(a * r["size_difference"] + c)))) < 1e-12
        assert r["predicted"] == int(r["score"] >= 0.5)
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert quality_classifier.score_documents(nothing, model).count() == 0
    assert quality_classifier.train(nothing, lab, everything).good == b""


# 2


def test_rule_measures(spark, docs, texts, empty):
    got = {r["doc_id"]: r for r in quality_rules.rate_documents(docs).collect()}
    for i, t in enumerate(texts):
        if i == 30:
            continue
        w, r = words(t), got[i]
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        ls = [x for x in (t or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(ls) - len(set(ls)), len(rep))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, t
        assert r["base_failed"] == (len(w) < 10 or 100 * len(rep) > 20 * len(w)) and not (r["kept"] and r["base_failed"])
    assert quality_rules.rate_documents(empty).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(bool(r["kept"]) for r in quality_rules.rate_documents(docs).collect())


def test_rule_estimation_finds_the_bad_class():
    rng = random.Random(3)
    counts = Counter()
    for _ in range(4000):
        bad = rng.random() < 0.15
        counts[tuple(-1 if rng.random() < (0.7 if bad else 0.01) else rng.choice((0, 1)) for _ in range(6))] += 1
    est = quality_rules.estimate(sorted(counts.items()), 6)
    assert 0.8 < est.share < 0.9 and est.posterior((-1, -1, -1, 0, 0, 1)) < 0.5 < est.posterior((0, 1, 1, 0, 0, 1)) and min(est.accuracies()) > 0.6


@pytest.mark.parametrize("share", [0.3, 0.998])
def test_rule_estimation_at_any_share(share):
    rng = random.Random(5)
    counts = Counter()
    for _ in range(20_000):
        good = rng.random() < share
        counts[tuple(-1 if rng.random() < (0.02 if good else 0.7) else rng.choice((0, 1, 1)) for _ in range(6))] += 1
    est = quality_rules.estimate(sorted(counts.items()), 6)
    assert abs(est.share - share) < 0.002 + 0.01 * (share < 0.9)
    if share < 0.9:  # with 40 bad rows of 20,000 the rounds end first
        more = quality_rules.estimate(sorted(counts.items()), 6, 400)
        assert all(abs(b[0] - 0.7) < 0.05 for b in est.given_bad)
        assert all(abs(x - y) < 1e-3 for a, b in zip(est.given_bad, more.given_bad, strict=True) for x, y in zip(a, b, strict=True))


# 3


def test_search_is_exact(spark, docs, texts, empty):
    queries = docs.filter(F.col("doc_id") % 3 == 0)
    rows = docs.collect()
    tf = [Counter(words(lower(r["text"]))) for r in rows]
    n, mean = len(rows), sum(map(lambda c: sum(c.values()), tf)) / len(rows)
    df = Counter(t for c in tf for t in c)

    def imp(c, t):
        idf = np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
        return int(np.floor(idf * (c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))) * 10_000 + 0.5))

    want = []
    for q in {r["doc_id"]: r for r in rows if r["doc_id"] is not None and r["doc_id"] % 3 == 0}.values():
        qt = Counter(words(lower(q["text"])))
        hits = [(-sum(k * imp(c, t) for t, k in qt.items() if t in c), (1 << 63) if r["doc_id"] is None else r["doc_id"]) for r, c in zip(rows, tf, strict=True) if set(qt) & set(c)]
        want += [(q["doc_id"], k, None if d == 1 << 63 else d, -s) for k, (s, d) in enumerate(sorted(hits)[:7], 1)]
    for shard_words in (topk_search.SHARD_WORDS, 200):  # a shard for each partition, and many in several rounds
        got = [(r["query_id"], r["rank"], r["doc_id"], round(r["score"] * 10_000)) for r in topk_search.search_documents(docs, queries, 7, shard_words=shard_words).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert topk_search.search_documents(empty, empty).count() == 0
    top = (1 << 63) - 1
    odd = docs.sparkSession.createDataFrame([(top, "a b", 1), (None, "a b", 2), (0, "a", 3), (7, None, 4)], "doc_id long, text string, rank int")
    assert [(r["doc_id"], r["rank"]) for r in topk_search.search_documents(odd, odd.filter("doc_id = 0"), 5).orderBy("rank").collect()] == [(0, 1), (top, 2), (None, 3)]


def test_search_rounds_cover_every_level_once():
    for counts in ({}, {0: 1}, {3: 2, 0: 9}, {5: 1, 2: 8, 1: 20, 0: 40}, {4: 30}):
        rounds = topk_search._rounds(counts)
        assert sum(n for _, _, n in rounds) == sum(counts.values())
        for level, n in counts.items():
            assert [r[2] >= n for r in rounds if r[0] <= level <= r[1]] == [True]
        assert all(n >= topk_search.FIRST_SHARDS for _, _, n in rounds[:1]) or sum(counts.values()) < topk_search.FIRST_SHARDS


def test_search_prunes_nothing_it_needs():
    """Every threshold up to the k-th score leaves the same best documents, whatever the test before it skipped."""
    rng = np.random.default_rng(4)
    import pyarrow as pa

    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 60) if x < 500) for _ in range(700)]
    w, e = topk_search.word_hashes(pa.array(texts))
    t, d, n = topk_search.counted(w, e)
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    df, b = np.diff(np.append(first, len(t))), t[first] % np.uint64(8)
    size = np.diff(np.concatenate([[0], e]))
    row = {"ids": np.arange(700, dtype="<i8").tobytes(), "nulls": bytes(700), "lens": size.astype("<u4").tobytes(), "terms": t[first].tobytes(), "starts": np.append(first, len(t)).astype("<u4").tobytes()}
    row |= {"docs": d.astype("<u2").tobytes(), "tfs": topk_search._narrow(n), "found": [{"bucket": i, "df": df[b == i].astype("<u4").tobytes()} for i in range(8)]}
    index = topk_search.Shard(row, 700, size.mean(), 8)
    for q in range(0, 700, 7):
        mine = d == q
        whole = index._given(np.searchsorted(index.terms, t[mine]), n[mine].astype(float))
        best = np.lexsort((np.arange(700), -whole))[:10]
        for theta in (0.0, whole[best[-1]] // 2, whole[best[-1]], whole[best[3]]):
            docs, score = index.top(t[mine], n[mine], 10, theta)
            want = best[whole[best] >= theta]
            assert docs.tolist() == want.tolist() and score.tolist() == whole[want].tolist()


def test_search_of_a_batch_is_brute_force(monkeypatch):
    """Queries travel with each word once, and a batch of them finds what each finds alone: with and without
    thresholds, ties, queries without words, and with dense terms, few cells for them or none."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, int(rng.integers(0, 50))) if x < 300) for _ in range(400)]
    texts[50:60], texts[300:330] = [""] * 10, [texts[7]] * 30
    w, e = topk_search.word_hashes(pa.array(texts))
    t, d, n = topk_search.counted(w, e)
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    df, b = np.diff(np.append(first, len(t))), t[first] % np.uint64(8)
    row = {"ids": np.arange(400, dtype="<i8").tobytes(), "nulls": bytes(400), "lens": np.diff(np.concatenate([[0], e])).astype("<u4").tobytes(), "terms": t[first].tobytes(), "starts": np.append(first, len(t)).astype("<u4").tobytes()}
    row |= {"docs": d.astype("<u2").tobytes(), "tfs": topk_search._narrow(n), "found": [{"bucket": i, "df": df[b == i].astype("<u4").tobytes()} for i in range(8)]}
    asked = next(topk_search._queries(iter([pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts)], names=["doc_id", "text"])]))).to_pylist()[0]
    assert sum(len(x) for x in asked.values() if isinstance(x, bytes)) < 8 * 400 + 4 * len(t)
    terms = np.frombuffer(asked["terms"], "<u8")
    query, number = np.divmod(np.cumsum(topk_search._unpress(asked["steps"])), len(terms))
    for dense, cells, product in ((16, 1 << 24, 1 << 21), (2, 1 << 24, 900), (16, 2000, 1 << 21), (16, 0, 1 << 21)):
        monkeypatch.setattr(topk_search, "DENSE", dense)
        monkeypatch.setattr(topk_search, "DENSE_CELLS", cells)
        monkeypatch.setattr(topk_search, "PRODUCT", product)
        index = topk_search.Shard(row, 400, len(w) / 400, 8)
        whole = np.zeros((400, 400))
        for q in range(400):
            whole[q] = index._given(np.searchsorted(index.terms, t[d == q]), n[d == q].astype(float))
        kth = -np.sort(-whole, axis=1)[:, 9]
        for theta in (np.zeros(400), kth, kth + 1, np.where(np.arange(400) % 2, kth // 2, 0)):
            got = {q: (docs.tolist(), score.tolist()) for q, docs, score in index.tops(terms, query, number, topk_search._unpress(asked["weights"]), 10, theta)}
            for q in range(400):
                best = np.lexsort((np.arange(400), -whole[q]))[:10]
                best = best[(whole[q][best] >= theta[q]) & (whole[q][best] > 0)]
                assert got.get(q, ([], [])) == (best.tolist(), whole[q][best].tolist())


# 4


def test_lm_scores(spark, docs, texts, empty):
    path = tokenizers.path("word_bpe_49k.json")
    got = lm_scoring.score_documents(docs, crc_mod("doc_id", 7) == 2, path).collect()
    rows = docs.collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(t for r in rows if not held(r["doc_id"]) for t in [*words(lower(r["text"])), None])
    total = sum(count.values())
    base = lambda t: sum(np.log10((count[w] + 1) / (total + len(count) + 1)) for w in [*words(lower(t)), None])
    want = sorted((r["doc_id"] or -1, len(words(r["text"])) + 1, round(base(r["text"]), 6)) for r in rows)
    assert sorted((r["doc_id"] or -1, r["n_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {total} and all(r["score"] < 0 and np.isfinite(r["score"]) for r in got)
    assert lm_scoring.score_documents(empty, F.lit(False), path).count() == 0


def test_lm_scores_are_the_windows(spark, docs):
    """score against a plain loop over windows, in double precision, with the model that was trained."""
    from lexforge.llm import attention_lm as lm
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    held = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    got = {(r["doc_id"], r["n_subwords"]): r for r in lm_scoring.score_documents(docs, held, path).collect()}
    rows = {(r["doc_id"], r["text"]) for r in docs.collect()}
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    known = {t for i, x in rows if not is_held(i) for t in words(lower(x))}
    chunks = docs.select("doc_id", "text", held.alias("held")).mapInArrow(lm_scoring._pack(path), lm_scoring._CHUNK)
    model = lm_scoring.learn(chunks, chunks.agg(F.sum("train_tokens")).head()[0], 49407, 49408)
    w = {k: v.astype(float) for k, v in model.weights.items()}
    tok, d = Tokenizer.from_file(path), lm.DIM
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()

    def log10(ids):
        sym, total = model.symbol_of[ids], 0.0
        for at in range(0, len(ids), lm.STRIDE):
            lo = max(0, at - lm.OVERLAP)
            span = range(lo, min(at + lm.STRIDE, len(ids)))
            x = np.array([w["emb"][sym[j - 1] if j else 0] + w["last"][sym[j - 2] if j > 1 else 0] for j in span])
            q, k, v = np.split(x @ w["qkv"], 3, axis=1)
            for r, j in enumerate(span):
                if j < at:
                    continue
                a = soft(np.clip(k[: r + 1] @ q[r] / np.sqrt(d) + w["rel"][r - np.arange(r + 1)], -30, 30))
                y = x[r] + a @ v[: r + 1] @ w["out"]
                z = y + np.maximum(y @ w["up"] + w["up_b"], 0) @ w["down"]
                z /= np.sqrt((z * z).mean() + 1e-5)
                prev, c, m = sym[j - 1] if j else 0, sym[j] // lm.CLASSES, sym[j] % lm.CLASSES
                pc = soft(z @ w["cls"] + w["cls_b"] + model.bigram[0][prev])
                pm = soft(z @ w["mem"][c] + w["mem_b"][c] + model.bigram[1][prev, c])
                total += np.log(pc[c] * pm[m]) + model.rare[ids[j]]
        return total / np.log(10)

    for i, t in sorted(rows, key=str)[:40]:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 49407]
        r = got[i, len(ids)]
        assert abs(r["score"] - log10(np.array(ids))) < 1e-3 * abs(r["score"]), t
        assert r["held_out"] == is_held(i) and r["n_known"] == sum(x in known for x in words(lower(t))) + 1


def test_lm_scores_do_not_depend_on_partitions(spark, docs):
    path = tokenizers.path("word_bpe_49k.json")
    held = crc_mod("doc_id", 7) == 2
    a, b = ([(r["doc_id"] or -1, r["n_subwords"], r["score"]) for r in lm_scoring.score_documents(d, held, path).collect()] for d in (docs.coalesce(1), docs.repartition(5, "text")))
    for x, y in zip(sorted(a), sorted(b), strict=True):
        assert x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-4 * abs(x[2])


def test_words_of_letters_get_the_tokenizers_ids():
    import random

    path, rng = tokenizers.path("word_bpe_49k.json"), random.Random(5)
    new, old = packing.WordEncoder(path, letters=True), packing.WordEncoder(path)
    tokens = [t.removesuffix("</w>") for t in old.tok.get_vocab()]
    some = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzßàáâäçéèêëíñóôöúûüýþÿ" if k % 2 else "aabéü") for _ in range(rng.randint(1, 25))) for k in range(20_000)]
    odd = ["a" * 3000, "é" * 1001, "naïve.", "łódź", "étÉ", "o’er", "x1y", "÷", "e\u0301", "ǆ", "it's", "日本", "\x00", "a\x1cb"]
    words_ = list(dict.fromkeys([t for t in tokens if t.isalpha()] + some + odd))
    assert new.pieces(words_) == old.pieces(words_)
    # only words with other characters reach the tokenizer
    new.cache.clear()
    seen, whole = [], new.tok

    class Tok:
        def encode_batch_fast(self, part, **kw):
            seen.extend(part)
            return whole.encode_batch_fast(part, **kw)

    new.tok = Tok()
    new.pieces(some + odd)
    assert set(seen) <= set(odd) | {"."} and len(seen) < 20
    # a file that promises less gets no such encoder
    import json

    spec = json.loads(old.tok.to_str())
    assert packing.letter_encoder(spec)
    for change in (lambda d: d["normalizer"]["normalizers"].pop(), lambda d: d["model"].update(end_of_word_suffix=None), lambda d: d["model"]["merges"].reverse()):
        other = json.loads(json.dumps(spec))
        change(other)
        assert packing.letter_encoder(other) is None


def test_new_words_of_letters_and_marks_stay_arrays():
    import random

    import pyarrow as pa

    path, rng = tokenizers.path("word_bpe_49k.json"), random.Random(6)
    new, old = packing.WordEncoder(path, letters=True), packing.WordEncoder(path)
    letters = "abcdefghijklmnopqrstuvwxyzßàáâäçéèêëíñóôöúûüýþÿ"
    some = ["".join(rng.choice(letters if k % 2 else "aabéü") for _ in range(rng.randint(1, 15))) + rng.choice(["", "", ".", ",", "?!", "$#*%&"]) for k in range(60_000)]
    odd = ["...", "." * 300, "é÷", "÷.", "łódź.", "É", "a.b", "a..b.", "日本.", "ağ.", "ğ", "\x00", "<|endoftext|>", "’a", "it's,", "Ã", "x1"]
    words_ = list(dict.fromkeys([*odd, *some]))
    rng.shuffle(words_)
    seen, pieces = [], new.pieces
    new.pieces = lambda part: seen.extend(part) or pieces(part)
    ids, size = new.arrays(pa.array(words_, pa.large_string()))
    assert [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(size)[:-1])] == old.pieces(words_)
    assert set(seen) <= {*odd, ".", ",", "?!", "$#*%&"}
    for part in ([], ["日"], ["...", "b"], ["b", "..."]):
        a = pa.array(["x.", *part], pa.large_string()).slice(1)
        ids, size = new.arrays(a)
        assert (ids.astype("<u4").tobytes(), len(size)) == (b"".join(old.pieces(part)), len(part))
    # and so they come to the pool, once
    _, at, size = new.words(pa.array(words_, pa.large_string()))
    _, at2, size2 = new.words(pa.array(words_[::-1], pa.large_string()))
    assert [new.pool[a : a + n].tobytes() for a, n in zip(at, size)] == old.pieces(words_)
    assert np.array_equal(at, at2[::-1]) and np.array_equal(size, size2[::-1])


def test_lm_takes_a_word_of_many_ids(spark):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    rows = [(1, "xq7" * 60_000), (2, "kan lor mist"), (3, "xq7" * 60_000 + " kan")]
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), F.col("doc_id") == 3, path).collect()}
    tok = Tokenizer.from_file(path)
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    assert {i: r["n_subwords"] for i, r in got.items()} == want and want[1] > 1 << 16
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got.values())


def test_lm_is_causal_and_normalised():
    from lexforge.llm import attention_lm as lm

    rng = np.random.default_rng(0)
    w = lm.start_weights()
    w["cls"] *= 20
    big = lm.bigram_logs(rng.integers(0, 3, (lm.SYMBOLS, lm.SYMBOLS)))
    sym = rng.integers(1, lm.SYMBOLS, 90)
    one = lm.score(w, big, sym, np.array([0]), np.array([90]))
    other = sym.copy()
    other[60:] = rng.integers(1, lm.SYMBOLS, 30)
    assert np.allclose(one[:60], lm.score(w, big, other, np.array([0]), np.array([90]))[:60], atol=1e-4)
    last = np.stack([np.concatenate([sym[:20], [s]]) for s in range(lm.SYMBOLS)]).ravel()
    ends = np.arange(1, lm.SYMBOLS + 1) * 21
    p = np.exp(lm.score(w, big, last, ends - 21, ends)[ends - 1])
    assert abs(p.sum() - 1) < 1e-3


def test_lm_trains_on_every_window(spark, docs):
    from lexforge.llm import attention_lm as lm
    from lexforge.llm.common import ready

    ready(spark)
    path = tokenizers.path("word_bpe_49k.json")
    held = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    chunks = docs.select("doc_id", "text", held.alias("held")).mapInArrow(lm_scoring._pack(path), lm_scoring._CHUNK).cache()
    kept = [n for r in lm_scoring.score_documents(docs, held, path).collect() if not r["held_out"] for n in [r["n_subwords"]]]
    # whatever the size of the corpus is said to be
    for tokens in (sum(kept), 300_000_000):
        assert lm_scoring.learn(chunks, tokens, 49407, 49408).seen == sum(-(-n // lm.STRIDE) for n in kept)


def test_lm_windows_have_context():
    from lexforge.llm import attention_lm as lm

    assert 4 * lm.OVERLAP >= lm.WINDOW
    n = 7 * lm.WINDOW + 3
    *_, there, scored = lm.gather(np.arange(n) % lm.SYMBOLS, *lm.windows(np.array([0]), np.array([n])))
    assert scored.sum() == n
    first = scored.argmax(1)
    assert (np.array([there[i, :k].sum() for i, k in enumerate(first)])[1:] >= lm.WINDOW // 4).all()


# 5


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_join_finds_every_link(spark, docs, width, percent, empty):
    rng = random.Random(7)
    seed = prose(rng, 150).split()
    family = []
    for _ in range(45):
        w = rng.choice([seed, family[-1] if family else seed])[:]
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(WORDS) + str(rng.randrange(30))
        family.append(w[rng.randint(0, 2) :])
    tiny = [" ".join(rng.choice(WORDS[:6]) for _ in range(rng.randint(8, 16))) for _ in range(40)]
    rows = [(100 + i, " ".join(w)) for i, w in enumerate(family)] + [(300 + i, t) for i, t in enumerate(tiny)]
    allrows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    data = [(r["doc_id"], r["text"]) for r in allrows.collect() if r["doc_id"] is not None]

    def grams(t):
        w = words(lower(t))
        return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}

    sets = [(i, grams(t)) for i, t in data]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((top(i), top(j)))
            up[y] = x
    want = sorted((i, len(s), top(i)) for i, s in sets)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join_documents(allrows.filter("doc_id is not null"), width, percent).collect())
    assert got == want and len({c for _, _, c in got}) < len(got)
    assert ngram_join.join_documents(docs).count() == docs.count() and ngram_join.join_documents(empty).count() == 0


# 6


def test_packing_is_whole_and_tight(spark, docs, texts, empty):
    from tokenizers import Tokenizer

    path, limit = tokenizers.path("word_bpe_49k.json"), 64
    tok = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, limit, slack=1).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for p, a in enumerate(range(0, len(ids), limit)):
            want[(r["doc_id"], p, a, len(ids[a : a + limit]), zlib.crc32(ids[a : a + limit].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= limit
    assert len(by) <= -(-sum(r["length"] for r in rows) // limit) + 2
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_ends_with_no_two_half_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_BINS", 2)  # so that the tree can't reach a single task
    words_ = [39] * 30 + [10] * 3
    docs = spark.createDataFrame([(i, " ".join(["the"] * n)) for i, n in enumerate(words_)], "doc_id long, text string").repartition(6)
    rows = packing.pack_documents(docs, tokenizers.path("word_bpe_49k.json"), 64, slack=1).collect()
    used = Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert sorted(r["doc_id"] for r in rows) == list(range(33)) and max(used.values()) <= 64
    assert sum(n <= 32 for n in used.values()) <= 1


# 7


def test_line_dedup(spark, docs, texts, empty):
    rows = sorted({(r["doc_id"], r["text"]) for r in docs.collect() if r["text"] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, want = set(), {}
    for i, t in rows:
        ls = t.split("\n")
        gone = set()
        for k in range(len(ls) - 2):
            g = tuple(ls[k : k + 3])
            gone |= {k, k + 1, k + 2} if g in seen else set()
            seen.add(g)
        want[i] = "\n".join(x for k, x in enumerate(ls) if k not in gone)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "dedup"]
    for r in got.collect():
        assert r["text"] == (None if r["doc_id"] == 0 else want[r["doc_id"]])
    assert line_dedup.dedup_lines(empty).count() == 0 and got.count() == docs.count()


def test_line_dedup_of_long_passages(spark):
    rng = random.Random(4)
    one, two, short = prose(rng, 50), [prose(rng, 30), prose(rng, 20)], prose(rng, 49)
    three = [prose(rng, 2) for _ in range(3)]
    texts = [one, one, short, short, "\n".join(two), prose(rng, 3) + "\n" + "\n".join(two) + "\n" + prose(rng, 3), "\n".join([prose(rng, 4), one, prose(rng, 4)])]
    texts += [prose(rng, 4) + "\n\n \n\n\n" + prose(rng, 4) for _ in range(2)] + [None, "", ""]
    texts += ["\n".join([prose(rng, 4), *three, "", "", "", "", prose(rng, 4)]) for _ in range(2)]
    texts += ["\n".join(two + [one, short] + two)]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        ls = [] if t is None else t.split("\n")
        gone = set()
        for k in range(len(ls)):
            for n in range(1, 4):
                g = tuple(ls[k : k + n])
                if len(g) == n and (n == 3 or len(words(" ".join(g))) >= 50):
                    gone |= set(range(k, k + n)) if g in seen else set()
                    seen.add(g)
        for k in sorted(gone):  # a run without a word stays
            if k - 1 not in gone or k == 0:
                end = next(e for e in range(k, len(ls) + 1) if e not in gone)
                if not words(" ".join(ls[k:end])):
                    gone -= set(range(k, end))
        want[i] = None if t is None else "\n".join(x for k, x in enumerate(ls) if k not in gone)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, long_words=line_dedup.LONG_WORDS).collect()}
    assert got == want
    assert want[1] == "" and want[3] == short and want[5].count("\n") == 1 and want[6].count("\n") == 1 and want[8] == texts[8]
    assert want[13].count("\n") == 1 and want[14] == short


# 8


@pytest.mark.parametrize("source,text", [
    ("<p>a<p>b", "a\n\nb"), ("a<br>b  c", "a\nb c"), ("<ul><li>x<li>y<ol start=3><li>z</ol></ul>", "- x\n- y\n  3. z"),
    ("<table><tr><td>a<td>bb<tr><td colspan=2>ccc<tr><td>d</table>", "a | bb\nccc\nd |"), ("<div hidden>x</div>y<p style='display: none'>z</p>", "y"),
    ("<script>a<b</script>t<style>p{}</style><!-- c -->u", "tu"), ("<pre>\n a\n  b</pre>", " a\n  b"), ("1 &lt; 2 &amp; 3 < 4", "1 < 2 & 3 < 4"),
    ("<dl><dt>k<dd>v</dl>", "k\n  v"), ("<title>t</title><body>b", "b"), ("<b><p>x</b>y", "x y" if False else "xy"), ("", ""), ("<unclosed", "<unclosed"),
    ("<table><tr><td rowspan=2>x<td>y<tr><td>z</table>", "x | y\n  | z"),
])
def test_rendering(source, text):
    assert html_render.render(source) == (text if source != "<table><tr><td>a<td>bb<tr><td colspan=2>ccc<tr><td>d</table>" else "a | bb\nccc\nd")


def test_rendering_keeps_all_text(spark):
    rng = random.Random(8)
    tags = "div p b i ul li table tr td span h1 blockquote em section a".split()
    pages = []
    for i in range(60):
        out, n = [], 0
        for _ in range(rng.randint(1, 80)):
            t = rng.choice(tags)
            out.append(rng.choice([f"<{t}>", f"</{t}>", f" w{i}x{n} "]))
            n += 1
        pages.append((i, "".join(out)))
    pages += [(90, "<div>" * 5000 + "deep" + "</div>" * 5000), (91, None), (92, "")]
    got = {r["page_id"]: r["text"] for r in html_render.extract_pages(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    assert got[90] == "deep" and got[91] is None and got[92] == ""
    for i, h in pages[:60]:
        assert Counter(re.findall(r"w\d+x\d+", h)) == Counter(re.findall(r"w\d+x\d+", got[i]))


def test_rendering_aligns_tables_of_every_size():
    """Random tables without spans against a plain version: each line of a row shows every cell at its column."""
    rng = random.Random(11)
    for _ in range(25):
        cols, rows = rng.randint(2, 5), rng.randint(1, 30)
        cells = [[[prose(rng, rng.randint(1, 4)) for _ in range(rng.choice([1, 1, 2, 20]))] for _ in range(cols)] for _ in range(rows)]
        source = "<table>" + "".join("<tr>" + "".join("<td>" + "<br>".join(c) for c in row) for row in cells) + "</table>"
        width = [max(len(x) for row in cells for x in row[k]) for k in range(cols)]
        want = []
        for row in cells:
            for k in range(max(map(len, row))):
                want.append(" | ".join((c[k] if k < len(c) else "").ljust(width[j]) for j, c in enumerate(row)).rstrip())
        assert html_render.render(source).split("\n") == want


def test_rendering_breaks_long_cells():
    rng = random.Random(12)
    long, giant = prose(rng, 300), "x" * 5000
    lines = html_render.render(f"<table><tr><td>{long}<td>right<tr><td>a<td>{long}<tr><td>{giant}<td>b</table>").split("\n")
    first = [x.split("|")[0].strip() for x in lines[:-2]]
    assert " ".join(first) == long and all(len(x) <= 100 for x in first)
    assert lines[0].index(" | right") == lines[-2].index(" | " + long) == 100
    assert lines[-1] == giant + " | b"
    assert html_render.render("<table><tr><td colspan=9999999>a<td rowspan=0>b<tr><td>c</table>")


def test_rendering_of_odd_tables(spark):
    pages = spark.createDataFrame([(1, "<p>a", "t"), (None, "<p>b", "t"), (1, "<p>a", "t")], "page_id long, html string, text string")
    got = html_render.extract_pages(pages)
    assert got.columns == ["page_id", "text"] and sorted((r["page_id"] or 0, r["text"]) for r in got.collect()) == [(0, "b"), (1, "a"), (1, "a")]
    assert html_render.extract_pages(pages.limit(0)).count() == 0


# 9


@pytest.mark.parametrize("piece", [1 << 20, 300])
def test_substrings(spark, docs, empty, piece, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    if piece < 1000:
        monkeypatch.setattr(suffix_dedup, "_piece", suffix_dedup._piece)
    rows = sorted(((r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    first: dict = {}
    want = Counter()
    for i, b in rows:
        m = bytearray(len(b))
        for s in range(len(b) - 49):
            if i is not None and first.setdefault(b[s : s + 50], i) < i:
                m[s : s + 50] = b"\x01" * 50
        kept = bytes(x for x, y in zip(b, m, strict=True) if not y)
        spans = sum(1 for k in range(len(m)) if m[k] and (not k or not m[k - 1]))
        want[(i, len(b), sum(m), spans, hashlib.sha256(kept).hexdigest())] += 1
    got = suffix_dedup.dedup_substrings(docs).drop("kept_text", "source_hash")
    assert Counter(tuple(r) for r in got.collect()) == want and any(k[2] for k in want)
    assert suffix_dedup.dedup_substrings(empty).count() == 0


def test_units_of_pieces():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    ends = np.array([10, 900, 900, 2500, 4000])
    skip = np.array([False, False, False, True, False])
    starts = np.concatenate([[0], ends[:-1]])
    for size in (1 << 20, 257):
        suffix_dedup.PIECE, old = size, suffix_dedup.PIECE
        s, n, d, h, same = suffix_dedup.units(data, ends, skip)
        suffix_dedup.PIECE = old
        seen = Counter(int(x) for a, k in zip(s, n, strict=True) for x in range(a, a + k))
        assert seen == Counter(x for k in range(5) if not skip[k] for x in range(starts[k], ends[k] - 49))


# 10


def test_codec(spark, docs, texts, empty):
    path = tokenizers.path("piece_bpe_32k.model")
    p = sp_codec.pieces(path)

    def best(s):
        table = [0.0] + [float("-inf")] * len(s)
        for j in range(len(s)):
            for k in range(1, min(p.longest, len(s) - j) + 1):
                v = p.score.get(s[j : j + k], p.unknown if k == 1 else None)
                if v is not None:
                    table[j + k] = max(table[j + k], table[j] + v)
        return table[-1]

    got = sp_codec.encode_documents(docs, path, giant=400)
    for r in got.collect():
        t = texts[r["doc_id"]] if r["doc_id"] is not None else texts[30]
        assert (r["ids"] is None) == (t is None)
        if t is not None:
            assert r["score"] == best(p.marked(t))
    back = {r["doc_id"]: r["text"] for r in sp_codec.decode_documents(got, path).collect()}
    assert all(back[i] == t for i, t in enumerate(texts) if i != 30)
    assert sp_codec.encode_documents(empty, path).count() == 0


def test_parallel_scan(monkeypatch):
    p = sp_codec.pieces(tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(6)
    size = 40
    for t in ["".join(rng.choices("abcdefghé中 ", k=rng.randint(100, 400))) for _ in range(30)] + ["x" * 333, "a  b   " * 40]:
        s = p.marked(t)
        n = len(s) // size
        parts = [(s[k * size : (k + 1) * size + p.longest - 1], size, False) if k < n - 1 else (s[k * size :], len(s) - k * size, True) for k in range(n)]
        m = [p.matrix(*x) for x in parts]
        left = sp_codec.product(sp_codec.product(m[0], m[1]), m[2])
        assert np.array_equal(left, sp_codec.product(m[0], sp_codec.product(m[1], m[2])))
        st = sp_codec.states(m, 0, 0)
        ids = b"".join(p.between(x[0], x[1], a, b) for x, a, b in zip(parts, st[:-1], st[1:], strict=True))
        assert sum(x[a, b] for x, a, b in zip(m, st[:-1], st[1:], strict=True)) == p.segment(s)[1]
        assert p.decode(np.frombuffer(ids, "<u4")).decode() == t


# columns named as the operators' own


def test_clashing_columns(spark):
    """Further columns keep their names and values, whatever they are called."""
    rng = random.Random(9)
    lines = [prose(rng, 12) for _ in range(4)]
    extra = "row i t h g c lines text_ dedup runs kept cut info n_removed n_bytes source_hash kept_text _t _i at fp w a1 m1 s1 chunk docs ends key component_id found first rank score".split()
    rows = [(k, "\n".join(lines if k else [*lines, prose(rng, 9)]), *[f"{c}{k}" for c in extra]) for k in range(3)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *extra])
    want = {r[0]: r[2:] for r in rows}
    cut = line_dedup.dedup_lines(docs)
    assert cut.columns == [*docs.columns, "dedup_"] == [*docs.columns, line_dedup.info_name(docs)]
    for out in (cut.drop("dedup_"), suffix_dedup.dedup_rows(docs), quality_rules.keep_good(docs)):
        assert out.columns == docs.columns
        assert all(tuple(r)[2:] == want[r["doc_id"]] for r in out.collect())
    assert [r["n_removed"] for r in line_dedup.dedup_lines(docs).select("dedup_.n_removed").collect()].count(4) == 2
    assert suffix_dedup.dedup_rows(docs).count() == 1
    path = tokenizers.path("word_bpe_49k.json")
    assert {r["component_id"] for r in ngram_join.join_documents(docs, 5, 80).collect()} <= {0, 1}
    assert packing.pack_documents(docs, path).count() == 3 and topk_search.search_documents(docs, docs).count() == 9
    assert sp_codec.encode_documents(docs, tokenizers.path("piece_bpe_32k.model")).count() == 3
    pages = docs.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumn("text", F.lit("x"))
    assert html_render.extract_pages(pages).columns == ["page_id", "text"]
    assert {r["text"] for r in html_render.extract_pages(pages).collect()} != {"x"}
    assert html_render.extract_pages(pages.limit(0)).count() == 0
