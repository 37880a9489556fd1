"""Best-fit packing: hierarchical residual packing of tokenised documents.

Every scan partition tokenises its documents, cuts only those above the limit, packs its pieces best-fit
in decreasing order and emits the bins that are nearly full. Underfull bins travel on as items: a tree
of rounds with a fan-in of FAN_IN merges them best-fit with other partitions' underfull bins. No text is
shuffled, and only underfull bins' piece records ever move. Rounds go on to a single task where the bins fit one
(TASK_BINS). Beyond that, once a round removes under 2 % of the bins, those of over half the limit stay as they are, since
no two of them fit together, and the others, of which best fit leaves at most one in each task, go on to the root.

Cases: a null or empty text is the single id 0; repeated doc_ids are packed as separate documents;
documents of equal length tie by doc_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import give_back, materialize, ready, table
from lexforge.llm.harmonic import byte_names
from lexforge.llm.hashing import Pool, gather, string_bytes

MAX_LEN = 2048
FAN_IN = 8
#: A bin with at most so many free places is emitted at once.
SLACK = 4
#: Most underfull bins that one merging task takes.
TASK_BINS = 50_000
#: Words, and parts of words, that a worker keeps; it forgets all beyond that.
KNOWN_WORDS, CACHE_WORDS = 1_000_000, 250_000
#: White-space-free ASCII marks that form a pre-token of their own after a letter.
MARKS = ".,;:!?$#*%&"

_BINS = "seq long, used int, done boolean, docs array<long>, pieces array<int>, starts array<long>, lens array<int>, crcs array<long>"


#: Lower-case letters of one byte, or of two that begin with C3, in UTF-8.
LETTERS = re.compile("[a-zß-öø-ÿ]+")
#: Bytes of LETTERS: UTF-8 has no other characters of them alone. And of MARKS.
_IS_LETTER, _IS_MARK = np.zeros((2, 256), bool)
_IS_LETTER[[*range(ord("a"), ord("z") + 1), 0xC3, *range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = True
_IS_MARK[list(MARKS.encode())] = True


class LetterEncoder:
    """Ids of words of LETTERS, by the same merges in tiktoken, in a fifth of the time. That library knows no symbols
    that end a word, so each byte, and each byte that ends a word, is written as an ASCII character of its own.

    tiktoken joins any two neighbours that make a token together, the tokenizer only those of its list of merges. They
    agree if each token's own characters are merged into it: merges within its stretch don't depend on what is around."""

    def __init__(self, ranks: dict[bytes, int], plain: np.ndarray, end: np.ndarray):
        import tiktoken

        self.plain, self.end, self.space = plain, end, 1 + max(ranks.values())
        self.encoding = tiktoken.Encoding("letters", pat_str="[^ ]+| ", mergeable_ranks=ranks | {b" ": self.space}, special_tokens={})

    def _ids(self, raw: np.ndarray) -> np.ndarray:
        """Ids of words in UTF-8, each with a space after it, as is each word's ids' self.space."""
        last = np.flatnonzero(raw == 32) - 1
        text = self.plain[raw]
        text[last] = self.end[raw[last]]
        return self.encoding.encode_to_numpy(text.tobytes().decode("ascii"), disallowed_special=())

    def __call__(self, words: list[str]) -> list[bytes]:
        ids = self._ids(np.frombuffer((" ".join(words) + " ").encode(), np.uint8))
        stop = np.flatnonzero(ids == self.space) * 4
        data = ids.astype("<u4").tobytes()
        return [data[a:b] for a, b in zip([0, *(stop[:-1] + 4).tolist()], stop.tolist(), strict=True)]

    def stretches(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words that begin in data and have so many bytes, one after another, and how many each has."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(size), 50_000):
            n = size[i : i + 50_000]
            raw = np.full(int(n.sum()) + len(n), 32, np.uint8)
            raw[gather(np.cumsum(n + 1) - n - 1, n)] = data[gather(begin[i : i + 50_000], n)]
            part = self._ids(raw)
            space = part == self.space
            sizes.append(np.diff(np.flatnonzero(space), prepend=-1) - 1)
            ids.append(part[~space].astype(np.uint32))
        return np.concatenate(ids), np.concatenate(sizes)


def letter_encoder(spec: dict) -> LetterEncoder | None:
    """None unless the file is a BPE over bytes with an end-of-word suffix and lower-casing, that takes a run of letters as one
    word, whose ids follow the order of its merges and each of whose tokens of LETTERS is what its characters are merged into."""
    model, end = spec["model"], spec["model"].get("end_of_word_suffix")
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    same = ["NFC", "Replace", "Lowercase"]
    norms = (spec.get("normalizer") or {}).get("normalizers") or []
    if model["type"] != "BPE" or not end or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges")):
        return None
    if [x["type"] for x in norms] != same or norms[1]["pattern"] != {"Regex": r"\s+"} or [x.get("type") for x in steps] != ["Split", "ByteLevel"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
        return None
    split = steps[0]
    if split["pattern"] != {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"} or split["behavior"] != "Removed" or not split["invert"]:
        return None
    vocab, names = model["vocab"], byte_names()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [vocab[a + b] for a, b in pairs]
    if any(x >= y for x, y in zip(order, order[1:], strict=False)):
        return None
    small, high = range(ord("a"), ord("z") + 1), [0xC3, *range(0x9F, 0xC0)]
    free = [c for c in range(128) if not chr(c).isalpha() and c != 32]
    plain, last = np.full(256, 32, np.uint8), np.full(256, 32, np.uint8)
    for b in small:
        plain[b], last[b] = b, b - 32
    for k, b in enumerate(high):
        plain[b], last[b] = free[2 * k], free[2 * k + 1]

    def written(token: str) -> bytes | None:
        ends = token.endswith(end)
        raw = [names.get(c) for c in (token[: -len(end)] if ends else token)]
        if not raw or any(b is None or plain[b] == 32 for b in raw):
            return None
        return bytes([*plain[raw[:-1]], (last if ends else plain)[raw[-1]]])

    own = {t: x for t in vocab if (x := written(t))}
    ranks = {own[t]: vocab[t] for c in names for t in (c, c + end) if t in own}
    if len(ranks) < 2 * (len(small) + len(high)):
        return None
    merges = {}
    for a, b in pairs:
        if a + b in own:
            ranks[own[a + b]] = merges[own[a], own[b]] = vocab[a + b]
    none = 1 << 62
    for t in ranks:
        parts = [t[i : i + 1] for i in range(len(t))]
        while len(parts) > 1:
            rank = [merges.get(p, none) for p in zip(parts, parts[1:], strict=False)]
            if (best := min(rank)) == none:
                return None
            i = rank.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
    try:
        return LetterEncoder(ranks, plain, last)
    except ImportError:
        return None


class WordEncoder:
    """Ids of whole texts, from the ids of their distinct white-space-free words.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids in
    order; only words that are new to the cache reach the tokenizer. letters: words of LETTERS go to a LetterEncoder
    where the tokenizer's file allows it.
    """

    def __init__(self, path: str, known_words: int = KNOWN_WORDS, cache_words: int = CACHE_WORDS, letters: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.lower = '"Lowercase"' in self.tok.to_str()
        self.cache: dict[str, bytes] = {}
        self.known, self.cache_words = Pool(known_words), cache_words
        self.letters = letter_encoder(json.loads(self.tok.to_str())) if letters else None

    @property
    def pool(self) -> np.ndarray:
        return self.known.ids[: self.known.used]

    def pieces(self, words: list[str]) -> list[bytes]:
        """Ids of each word. Marks at a word's end are a pre-token of their own when all before them is
        letters, so the letters and the marks are looked up apart."""
        cores = [w.rstrip(MARKS) for w in words]
        cut = [len(c) < len(w) and c.isalpha() for c, w in zip(cores, words, strict=True)]
        need = dict.fromkeys(c if k else w for c, w, k in zip(cores, words, cut, strict=True))
        need.update(dict.fromkeys(w[len(c) :] for c, w, k in zip(cores, words, cut, strict=True) if k))
        cache = self.cache
        new = [w for w in need if w not in cache]
        if len(cache) + len(new) > self.cache_words:
            cache.clear()
            new = list(need)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            if self.letters and (plain := [w for w in part if LETTERS.fullmatch(w)]):
                cache.update(zip(plain, self.letters(plain), strict=True))
                part = [w for w in part if w not in cache]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                cache[w] = np.array(e.ids, dtype="<u4").tobytes()
        return [cache[c] + cache[w[len(c) :]] if k else cache[w] for c, w, k in zip(cores, words, cut, strict=True)]

    def arrays(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As pieces(), of a large_string array: all ids one after another, and how many each word has. Words of LETTERS,
        with or without MARKS after them, are told by their bytes and never become Python objects."""
        data, lens = string_bytes(words)
        stop = np.cumsum(lens)
        begin = stop - lens
        # where each word would end without marks; one of marks alone would end before it begins
        core = np.append(np.maximum.accumulate(np.where(_IS_MARK[data], 0, np.arange(1, len(data) + 1))), 0)[stop - 1] - begin
        strange = np.concatenate([[0], np.cumsum(~_IS_LETTER[data])])
        core = np.where(core > 0, core, 0)
        plain = (core > 0) & (strange[begin + core] == strange[begin])
        other, tail = np.flatnonzero(~plain), np.flatnonzero(plain & (core < lens))
        plain = np.flatnonzero(plain)
        ids, n_core = self.letters.stretches(data, begin[plain], core[plain])
        # marks, of which there are few kinds
        n = lens[tail] - core[tail]
        marks = data[gather(begin[tail] + core[tail], n)]
        coded = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(marks))).dictionary_encode()
        rest = [np.frombuffer(x, "<u4") for x in self.pieces(coded.dictionary.to_pylist()) + self.pieces(words.take(pa.array(other)).to_pylist())]
        size = np.fromiter(map(len, rest), np.int64, len(rest))
        kinds = len(coded.dictionary)
        # a word's ids come from one or two stretches of all that is known
        known = np.concatenate([ids, *rest])
        at = len(ids) + np.cumsum(size) - size
        a, a_at, b, b_at = np.zeros((4, len(lens)), np.int64)
        a[plain], a_at[plain] = n_core, np.cumsum(n_core) - n_core
        a[other], a_at[other] = size[kinds:], at[kinds:]
        kind = coded.indices.to_numpy(zero_copy_only=False)
        b[tail], b_at[tail] = size[:kinds][kind], at[:kinds][kind]
        return known[gather(np.stack([a_at, b_at], 1).ravel(), np.stack([a, b], 1).ravel())], a + b

    def words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each distinct word, and where its ids begin in the pool and how many they are."""
        if self.letters:
            return self.known.find(distinct, lambda new: (self.arrays(new), 0.0), arrays=True)[:3]
        return self.known.find(distinct, lambda new: (self.pieces(new), 0.0))[:3]

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct words, the distinct word of each word, and where each text's words end."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        offsets = split.offsets.to_numpy().astype(np.int64)
        values = split.values
        if self.lower and not pc.any(pc.match_substring(values, "<|")).as_py():
            # the tokenizer lower-cases anyway; special tokens are matched before that, so not in their presence
            values = pc.ascii_lower(values)
        coded = values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), (offsets - offsets[0])[1:]

    def encode(self, texts: pa.Array, end: int | None = 0) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text ends. end: an id put after each text."""
        distinct, word, ends = self.split(texts)
        _, at, size = self.words(distinct)
        pool = self.pool
        if end is not None:
            word = np.insert(word, ends, len(at))
            ends = ends + np.arange(1, len(ends) + 1)
            at, size, pool = np.append(at, len(pool)), np.append(size, 1), np.append(pool, np.uint32(end))
        n = size[word]
        upto = np.concatenate([[0], np.cumsum(n)])
        return pool[np.repeat(at[word] - upto[:-1], n) + np.arange(upto[-1])], upto[ends]


@functools.lru_cache(maxsize=2)
def encoder(path: str, known_words: int = KNOWN_WORDS, cache_words: int = CACHE_WORDS, letters: bool = False) -> WordEncoder:
    """One encoder a worker process and path, so its cache outlives a task."""
    return WordEncoder(path, known_words, cache_words, letters)


def best_fit(sizes: list[int], limit: int) -> list[list[int]]:
    """Best-fit decreasing: the items of each bin, by index. Open bins are kept by their free places; a bit
    mask over 0..limit finds the smallest sufficient place in constant time."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(limit + 1)]
    mask = 0
    for i in order:
        s = sizes[i]
        above = mask >> s
        if above:
            free = s + (above & -above).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                mask ^= 1 << free
            bins[b].append(i)
        else:
            free, b = limit, len(bins)
            bins.append([i])
        left = free - s
        if left:
            by_free[left].append(b)
            mask |= 1 << left
    return bins


def _tokenise(path: str, limit: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path)
        docs, pieces, starts, lens, crcs = [], [], [], [], []
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids, ends = enc.encode(part.column(1))
                begin = 0
                raw = memoryview(np.ascontiguousarray(ids)).cast("B")
                for doc, stop in zip(part.column(0).to_pylist(), ends.tolist(), strict=True):
                    for p, a in enumerate(range(begin, stop, limit)):
                        b = min(a + limit, stop)
                        docs.append(doc)
                        pieces.append(p)
                        starts.append(a - begin)
                        lens.append(b - a)
                        crcs.append(zlib.crc32(raw[4 * a : 4 * b]))
                    begin = stop
        seq = TaskContext.get().partitionId() << 32
        items = [([docs[i]], [pieces[i]], [starts[i]], [lens[i]], [crcs[i]]) for i in range(len(docs))]
        yield from _emit(items, lens, limit, slack, seq)
        del items
        give_back()

    return run


def _merge(limit: int, slack: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        items, used = [], []
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("docs", "pieces", "starts", "lens", "crcs")]
            items += list(zip(*cols, strict=True))
            used += batch.column(batch.schema.get_field_index("used")).to_pylist()
        order = sorted(range(len(items)), key=lambda i: (items[i][0][0] if items[i][0][0] is not None else -1, items[i][1][0], items[i][4][0]))
        seq = (level << 56) | (TaskContext.get().partitionId() << 32)
        yield from _emit([items[i] for i in order], [used[i] for i in order], limit, slack, seq)

    return run


def _emit(items: list[tuple], used: list[int], limit: int, slack: int, seq: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("seq", pa.int64()), ("used", pa.int32()), ("done", pa.bool_()), ("docs", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("lens", pa.list_(pa.int32())), ("crcs", pa.list_(pa.int64()))])
    rows: list[tuple] = []
    bins = best_fit(used, limit)
    for k, members in enumerate(bins):
        total = sum(used[i] for i in members)
        rows.append((seq + k, total, total >= limit - slack, *([x for i in members for x in items[i][c]] for c in range(5))))
        if len(rows) == 2000 or k == len(bins) - 1:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows = []


def _merge_low(bins: DataFrame, max_len: int, slack: int, level: int) -> list[DataFrame]:
    """bins with those of half the limit or less merged by further rounds of the tree, up to its root. Each task leaves
    one such bin at most, so a round leaves no more of them than it has tasks."""
    low = ~F.col("done") & (F.col("used") * 2 <= max_len)
    out = []
    while True:
        out.append(bins.filter(~low))
        rest = bins.filter(low)
        tasks = max(1, -(-rest.count() // TASK_BINS))
        level += 1
        dealt = rest.repartition(tasks, F.xxhash64("seq")) if tasks > 1 else rest.repartition(1)
        bins = materialize(dealt.mapInArrow(_merge(max_len, slack, level), _BINS), f"pack{level}")
        if tasks == 1:
            return [*out, bins]


def pack_documents(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, id_col: str = "doc_id", text_col: str = "text", slack: int = SLACK) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    ready(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bins = materialize(src.mapInArrow(_tokenise(tokenizer_path, max_len, slack), _BINS), "pack0")
    emitted, level, before, tasks = [], 0, None, None
    while True:
        left = bins.filter(~F.col("done"))
        stat = bins.agg(F.sum(F.when(~F.col("done"), 1).otherwise(0)).alias("n"), F.count_distinct(F.expr("seq >> 32")).alias("p")).head()
        n = int(stat["n"] or 0)
        if tasks is None:  # later on those asked for: the tree narrows even where a session deals rows out wider
            tasks = int(stat["p"] or 0)
        to = max(-(-tasks // FAN_IN), -(-n // TASK_BINS), 1)
        if n <= 1 or (level and tasks <= 1):  # at the root
            emitted.append(bins)
            break
        if before is not None and n > TASK_BINS and n > 0.98 * before:
            emitted += _merge_low(bins, max_len, slack, level)
            break
        emitted.append(bins.filter(F.col("done")))
        level, before, tasks = level + 1, n, to
        dealt = left.repartition(to, F.xxhash64("seq")) if to > 1 else left.coalesce(1)
        bins = materialize(dealt.mapInArrow(_merge(max_len, slack, level), _BINS), f"pack{level}")
    out = emitted[0]
    for e in emitted[1:]:
        out = out.unionByName(e)
    with_offsets = out.withColumn("offs", F.expr("transform(aggregate(lens, named_struct('s', 0L, 'o', array_repeat(0L, 0)), (a, x) -> named_struct('s', a.s + x, 'o', concat(a.o, array(a.s)))).o, x -> x)"))
    rows = with_offsets.select("seq", F.explode(F.arrays_zip("docs", "pieces", "starts", "lens", "crcs", "offs")).alias("r"))
    return rows.select(
        F.col("r.docs").alias("doc_id"), F.col("r.pieces").alias("piece"), F.col("r.starts").alias("start"), F.col("r.lens").cast("long").alias("length"),
        F.col("r.crcs").alias("ids_crc32"), F.col("seq").alias("sequence_id"), F.col("r.offs").alias("offset"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
