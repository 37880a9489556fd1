"""Harmonic packing: documents cut into pieces of reciprocal-capacity classes, each class packed by counting.

A sequence of max_len tokens (a power of two) has the classes max_len / 1, max_len / 2, max_len / 4, ... 1: a bin of the
class max_len / k takes exactly k pieces. A document may be cut anywhere, so its length is written as whole bins and
then the powers of two that make up the rest, largest first: every piece fills its class's share of a bin exactly, and
a bin with its k pieces has no padding. Where a class ends with m < k pieces, they are dealt to bins by the powers of
two that make up m: these are shorter than max_len, but their lengths are powers of two, which aren't padded. So there
is no padding at all, in any number of partitions, and no partition needs to know of another: no shuffle, one pass.
Each partition leaves at most log2(max_len) short bins in each class, whatever its size.

A class's open bin is all that a task keeps of the pieces before: fewer than k rows for the class max_len / k.

Cases: a null or empty text is the single id 0; repeated doc_ids are packed as separate documents; equal lengths need
no tie rule, pieces come in the order of the rows; an empty table gives no rows; other columns are ignored. A very
long text is encoded at once and cut into as many pieces as it takes.
"""

from __future__ import annotations

import array
import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import give_back, ready, table

MAX_LEN = 1024
#: Texts that are encoded at a time.
ROWS = 500
#: How a byte-level tokenizer splits texts; fixed by the format, the order of the alternatives matters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def byte_names() -> dict[str, int]:
    """The bytes by the characters that name them in byte-level vocabularies: visible ones name themselves, the others
    are named from U+0100 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(rest)}


def fast_bpe(spec: dict):
    """The same merges in tiktoken, which takes a third of the time; None unless the file is a plain byte-level BPE
    whose ids follow the order of its merges, as that library asks."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    split = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if not (plain and split) or spec.get("normalizer"):
        return None
    try:
        import tiktoken
    except ImportError:
        return None
    vocab, names = model["vocab"], byte_names()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(pairs)):
        return None
    ranks = {bytes(map(names.__getitem__, t)): vocab[t] for t in [*names, *[a + b for a, b in pairs]]}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class ByteEncoder:
    """Ids of whole texts, as the tokenizer gives them. Texts that hold a special token's string, and all texts where
    fast_bpe() doesn't apply, go to the tokenizer itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.fast = fast_bpe(json.load(f))

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.tok.encode(text, add_special_tokens=False).ids
        return self.fast(text)

    def encode(self, texts: pa.Array, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, end after each; and where each text's ids end."""
        flat, ends = array.array("I"), []
        for t in texts.to_pylist():
            if t:
                flat.extend(self.ids(t))
            flat.append(end)
            ends.append(len(flat))
        return np.frombuffer(flat, np.uintc).astype("<u4"), np.array(ends, np.int64)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    """One encoder a worker process and path, loaded once."""
    return ByteEncoder(path)


def cut(lengths: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents of these lengths: each one's document, its start there, and its length: whole bins, then
    the powers of two of the rest, largest first."""
    rest = lengths % max_len
    bits = 1 << np.arange(max_len.bit_length() - 2, -1, -1)
    has = (rest[:, None] & bits) > 0
    sizes = np.concatenate([np.full((len(lengths), 1), max_len), np.broadcast_to(bits, has.shape)], axis=1)
    times = np.concatenate([(lengths // max_len)[:, None], has], axis=1).astype(np.int64)
    length = np.repeat(sizes.reshape(-1), times.reshape(-1))
    doc = np.repeat(np.arange(len(lengths)), times.sum(axis=1))
    begin = np.cumsum(length) - length
    return doc, begin - (np.cumsum(lengths) - lengths)[doc], length


class Classes:
    """Bins of each class, filled by counting; the pieces of a class's open bin wait for it to be full."""

    def __init__(self, max_len: int, first: int):
        self.max_len, self.next = max_len, first
        self.open: dict[int, np.ndarray] = {}

    def _bins(self, rows: np.ndarray, size: int, each: int) -> np.ndarray:
        """rows with a sequence of their own for every each of them."""
        k = np.arange(len(rows))
        out = np.column_stack([rows, self.next + k // each, k % each * size])
        self.next += len(rows) // each
        return out

    def put(self, rows: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        """The rows of the bins that these pieces fill."""
        done = []
        for size in np.unique(length).tolist():
            some = rows[length == size]
            if size in self.open:
                some = np.concatenate([self.open.pop(size), some])
            each = self.max_len // size
            full = len(some) // each * each
            if full:
                done.append(self._bins(some[:full], size, each))
            if full < len(some):
                self.open[size] = some[full:].copy()
        return done

    def close(self) -> list[np.ndarray]:
        """The rows of the open bins, in bins whose lengths are powers of two."""
        done = []
        for size, some in sorted(self.open.items()):
            each = 1 << (len(some).bit_length() - 1)
            while len(some):
                if len(some) & each:
                    done.append(self._bins(some[:each], size, each))
                    some = some[each:]
                each >>= 1
        self.open = {}
        return done


def _pack(path: str, max_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path)
        classes = Classes(max_len, TaskContext.get().partitionId() << 40)

        def out(done: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if done:
                t = np.concatenate(done)
                cols = [pa.array(t[:, 0], pa.int64(), mask=t[:, 1] > 0), *[pa.array(t[:, c], pa.int64()) for c in range(2, 8)]]
                yield pa.RecordBatch.from_arrays(cols, names=_NAMES)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, ends = enc.encode(part.column(1))
                lengths = np.diff(np.concatenate([[0], ends]))
                doc, start, length = cut(lengths, max_len)
                stops = 4 * np.cumsum(length)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip((stops - 4 * length).tolist(), stops.tolist(), strict=True)]
                ident = pc.fill_null(part.column(0), 0).to_numpy(zero_copy_only=False)
                none = pc.is_null(part.column(0)).to_numpy(zero_copy_only=False)
                rows = np.column_stack([ident[doc], none[doc], start, length, np.array(crcs, np.int64), lengths[doc]])
                yield from out(classes.put(rows, length))
        yield from out(classes.close())
        give_back()

    return run


def pack_harmonic(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if max_len < 2 or max_len & (max_len - 1):
        raise ValueError("max_len has to be a power of two")
    ready(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_pack(tokenizer_path, max_len), _OUT)


def op12_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_harmonic(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
