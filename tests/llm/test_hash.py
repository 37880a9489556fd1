"""Words that a polynomial hash modulo 2^64 can't tell apart, and words that share a hash, in every operator that hashes words."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexforge.llm import hashing, lm_scoring, ngram_join, packing, sp_codec, topk_search

tokenizers = pytest.importorskip("public_tokenizers")


def thue_morse(n):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


PAIR = thue_morse(2048)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate([*PAIR, PAIR[0] + " x", PAIR[1] + " x", "x"])), "doc_id long, text string").repartition(1)


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_hashes_differ(n):
    a, b = hashing.hash_strings(pa.array(thue_morse(n), pa.large_string()))
    assert a != b


def test_pool_tells_words_of_one_hash_apart(monkeypatch):
    monkeypatch.setattr(hashing, "hash_strings", lambda s: np.full(len(s), 7, np.uint64))
    pool = hashing.Pool(100)
    make = lambda ws: ([np.frombuffer(w.encode(), np.uint8).astype("<u4").tobytes() for w in ws], [float(len(w)) for w in ws])
    for some in (["ab", "ba", "", "abc"], ["ba", "ab"], ["abc", "x", "ab"]):
        _, at, size, value = pool.find(pa.array(some, pa.large_string()), make)
        assert ["".join(map(chr, pool.ids[a : a + n])) for a, n in zip(at, size, strict=True)] == some
        assert value.tolist() == [len(w) for w in some]


def test_packing(docs):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = {}
    for r in docs.collect():
        ids = [*tok.encode(r["text"], add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), 2048):
            want[r["doc_id"], p // 2048] = zlib.crc32(np.array(ids[p : p + 2048], "<u4").tobytes())
    assert {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in packing.pack_documents(docs, path).collect()} == want


def test_join(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_documents(docs).collect()}
    assert got == {i: (1, i) for i in range(5)}


def test_search(docs):
    got = {(r["query_id"], r["doc_id"]) for r in topk_search.search_documents(docs, docs.filter("doc_id < 2")).collect()}
    assert got == {(0, 0), (0, 2), (1, 1), (1, 3)}


def test_codec(docs):
    path = tokenizers.path("piece_bpe_32k.model")
    for giant in (400, 1 << 15):
        back = sp_codec.decode_documents(sp_codec.encode_documents(docs, path, giant=giant), path)
        assert {r["doc_id"]: r["text"] for r in back.collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}


def test_lm_base(docs):
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(docs, F.col("doc_id") == 1, tokenizers.path("word_bpe_49k.json")).collect()}
    # 0, 2, 3, 4 train: the second word is known by document 3 alone, the first by 0 and 2
    total, distinct = 2 + 1 + 3 + 4, 4
    log = lambda c: np.log10((c + 1) / (total + distinct + 1))
    assert got[0]["train_tokens"] == total
    assert got[0]["base_score"] == pytest.approx(log(2) + log(4))
    assert got[1]["base_score"] == pytest.approx(log(1) + log(4)) and got[1]["n_known"] == 2
