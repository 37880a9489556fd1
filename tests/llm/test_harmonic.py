"""Harmonic packing against the tokenizer itself and the rules of its bins."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lexforge.llm import harmonic

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("byte_bpe_50k.json")


def odd_texts():
    rng = random.Random(5)
    alphabet = ["a", "Zo", "été", "ß", "中文", "it's", "'s", "'", "don't", "7", "12", ".", ",", "!?", "...", "#*", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", " ", " ", "　", "﻿", "<|endoftext|>", "<|", "|>", "\U0001f600", "é", "ǅ", "ª", "²", "x."]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    out += ["".join(rng.choice(alphabet[:24]) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    return [None, "", " ", "\n", "a", " a", "a ", "  a  b\n", "<|endoftext|>", *out]


def test_encoder_equals_the_tokenizer():
    enc = harmonic.ByteEncoder(PATH)
    assert enc.fast is not None
    texts = odd_texts()
    for k in range(0, len(texts), 500):
        part = texts[k : k + 500]
        ids, ends = enc.encode(pa.array([*["skip me"], *part]).slice(1))
        got = [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == [[*enc.tok.encode(t or "", add_special_tokens=False).ids, 0] for t in part]


def test_encoder_equals_the_tokenizer_on_every_character():
    enc = harmonic.ByteEncoder(PATH)
    points = [*range(0x3100), *range(0x3100, 0xD800, 97), *range(0xE000, 0x110000, 997)]
    texts = [f"a{c}b {c} {c}{c}1{c}.{c} \n{c}" for c in map(chr, points)]
    got = [enc.fast(t) for t in texts]
    assert got == [e.ids for e in enc.tok.encode_batch_fast(texts, add_special_tokens=False)]


@pytest.mark.parametrize("text", [" " * 50_000, "\n" * 50_000 + "a", "x" * 50_000, "é" * 20_000, " a" * 50_000, "a\n\n" * 30_000])
def test_encoder_of_extreme_texts(text):
    enc = harmonic.ByteEncoder(PATH)
    assert enc.fast(text) == enc.tok.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_are_used_as_they_are():
    path = tokenizers.path("word_bpe_49k.json")
    enc = harmonic.ByteEncoder(path)
    assert enc.fast is None
    assert enc.ids("Some words, é") == enc.tok.encode("Some words, é", add_special_tokens=False).ids


@pytest.mark.parametrize("max_len", [2, 8, 1024])
def test_cut(max_len):
    lengths = np.array([1, 2, 3, 1023, 1024, 1025, 5000, 7])
    doc, start, length = harmonic.cut(lengths, max_len)
    for d, n in enumerate(lengths.tolist()):
        own = length[doc == d].tolist()
        assert start[doc == d].tolist() == [sum(own[:k]) for k in range(len(own))] and sum(own) == n
        assert all(x & (x - 1) == 0 and x <= max_len for x in own) and len(own) == n // max_len + (n % max_len).bit_count()


@pytest.mark.parametrize(("max_len", "parts"), [(1024, 1), (1024, 5), (16, 2)])
def test_packing_is_whole_and_without_padding(spark, max_len, parts):
    rng = random.Random(2)
    texts = [None, "", "one", *[" ".join(rng.choice(["ab", "Cd,", "e.", "été"]) for _ in range(rng.randint(1, 900))) for _ in range(60)], "long " * 9000]
    rows = [(None if i == 9 else i % 50, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int").repartition(parts)
    got = harmonic.pack_harmonic(df, PATH, max_len).collect()
    tok = harmonic.ByteEncoder(PATH).tok
    want = defaultdict(int)
    for i, t, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for n in [max_len] * (len(ids) // max_len) + [1 << b for b in range(max_len.bit_length(), -1, -1) if len(ids) % max_len >> b & 1]:
            want[i, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)] += 1
            at += n
    have = defaultdict(int)
    for r in got:
        have[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
    assert have == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at & (at - 1) == 0 and at <= max_len
        assert len({n for _, n in b}) == 1
    short = sum(sum(n for _, n in b) < max_len for b in bins.values())
    assert short <= parts * sum(range(max_len.bit_length()))


def test_empty_table_and_limits(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert harmonic.pack_harmonic(empty, PATH).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        harmonic.pack_harmonic(empty, PATH, 1000)
