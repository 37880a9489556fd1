"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text's segmentation maximises the sum of its pieces' scores (the unigram rule over the given model's pieces
and scores; characters that no piece covers cost the unknown penalty and become byte pieces). Texts up to
GIANT characters are segmented where they lie. A longer one is split into chunks of CHUNK characters. The
state at a chunk's boundary is the number of characters by which a piece reaches into the next chunk. Each
chunk yields the matrix of best scores from every entry state to every exit state; these combine
associatively in the max-plus semiring, by blocks of BLOCK chunks and then over the blocks, which gives the
best state at every boundary, and each chunk is backtraced by itself between its two states.

No piece holds a word mark after another character, so a text splits before every run of marks. Distinct words
are segmented together, by a walk through a trie of the pieces and a Viterbi pass over word positions, both on
arrays; a worker keeps a bounded number of them. Inside a chunk only the words at its two ends need the states.

Cases: a null text gives null ids, an empty one no ids; ties go to the longer last piece within a chunk and to
the smaller overhang at a boundary, with the same score either way; repeated ids are coded row by row; an
empty table gives no rows; further columns are ignored; a lone word mark in the text decodes as a space, as
in the public library.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import give_back, materialize, ready, release, table
from lexforge.llm.hashing import Pool

GIANT, CHUNK, BLOCK = 32_768, 8_192, 256
#: Words that a worker keeps from batch to batch, and characters of text that it segments at a time.
KNOWN_WORDS, BATCH_CHARS = 400_000, 4 << 20
#: Words of at most LONG_WORD characters are segmented together, WORDS_AT_ONCE at a time; longer ones one by one.
LONG_WORD, WORDS_AT_ONCE = 64, 16_384
MARK = "▁"
UNKNOWN_PENALTY = 10.0
_LOW = -np.inf


class Pieces:
    """The pieces of a model file as a scored vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        self.raw: list[bytes] = [b""] * n
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(p[3:5], 16)
                self.byte[value], self.raw[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.score[p], self.id[p], self.raw[i] = sp.get_score(i), i, p.replace(MARK, " ").encode()
        self.longest = max(map(len, self.score), default=1)
        self.unknown = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.splits = not any(MARK in p.lstrip(MARK) for p in self.score)
        # a line feed stands alone
        self.simple = self.splits and not any("\n" in p for p in self.score)
        self.known = Pool(KNOWN_WORDS)
        self.word = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if self.splits else re.compile(r"(?s).+")
        self.mark = re.compile(f"(?<=[^{MARK}]){MARK}")
        self._grow_trie()
        self.raw_size = np.array([len(r) for r in self.raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.raw_pool = np.frombuffer(b"".join(self.raw), np.uint8)

    def steps(self, s: str, j: int) -> list[tuple[int, float]]:
        """Lengths and scores of the pieces that begin at j; one unknown character if no piece of length 1 does."""
        get = self.score.get
        out = [(k, v) for k in range(1, min(self.longest, len(s) - j) + 1) if (v := get(s[j : j + k])) is not None]
        return out if out and out[0][0] == 1 else [(1, self.unknown), *out]

    def segment(self, s: str) -> tuple[bytes, float]:
        """Ids (little-endian 32-bit) and score of the best segmentation of s."""
        n = len(s)
        best, back = [_LOW] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for j in range(n):
            b = best[j]
            for k, v in self.steps(s, j):
                if b + v > best[j + k]:
                    best[j + k], back[j + k] = b + v, j
        return self.path(s, back, n), best[n]

    def path(self, s: str, back: list[int], at: int, stop: int = 0) -> bytes:
        out: list[int] = []
        while at > stop:
            j = back[at]
            i = self.id.get(s[j:at])
            out += [i] if i is not None else [self.byte[b] for b in reversed(s[j:at].encode("utf-8", "replace"))]
            at = j
        return np.array(out[::-1], "<u4").tobytes()

    def _grow_trie(self) -> None:
        """The pieces as a trie: sorted (node, character) keys with the node they lead to; each node's score and id."""
        edges: dict[int, int] = {}
        score, ids = [_LOW], [0]
        for piece, value in self.score.items():
            node = 0
            for ch in piece:
                key = node << 21 | ord(ch)
                if key not in edges:
                    edges[key] = len(score)
                    score.append(_LOW)
                    ids.append(0)
                node = edges[key]
            score[node], ids[node] = value, self.id[piece]
        self.edge = np.array(sorted(edges), np.int64)
        self.leads_to = np.array([edges[k] for k in self.edge.tolist()], np.int32)
        self.node_score, self.node_id = np.array(score), np.array(ids, np.uint32)

    def segment_words(self, words: list[str]) -> tuple[list[bytes], list[float]]:
        """segment() of every word. Words that hold a character without a piece, and long ones, go one by one."""
        out: list[tuple[bytes, float]] = [(b"", 0.0)] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        rest = np.flatnonzero((size > LONG_WORD) & (size > 0)).tolist()
        order = np.flatnonzero((size <= LONG_WORD) & (size > 0))
        order = order[np.argsort(-size[order], kind="stable")]  # the words that reach a place come first
        for at in range(0, len(order), WORDS_AT_ONCE):
            some = order[at : at + WORDS_AT_ONCE]
            for i, got in zip(some.tolist(), self._segment_at_once([words[i] for i in some.tolist()], size[some]), strict=True):
                if got is None:
                    rest.append(i)
                else:
                    out[i] = got
        for i in rest:
            out[i] = self.segment(words[i])
        return [o[0] for o in out], [o[1] for o in out]

    def _segment_at_once(self, words: list[str], size: np.ndarray) -> list[tuple[bytes, float] | None]:
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        start = np.cumsum(size) - size
        room = np.repeat(start + size, size) - np.arange(len(chars))
        longest = int(min(self.longest, size[0]))
        # the piece of k characters that begins at each place: its node, or 0
        found = np.zeros((longest + 1, len(chars)), np.int32)
        place, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        for k in range(1, longest + 1):
            key = node << 21 | chars[place + k - 1]
            at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            on = self.edge[at] == key
            place, node = place[on], self.leads_to[at[on]].astype(np.int64)
            found[k, place] = node
            on = room[place] > k
            place, node = place[on], node[on]
        gain = self.node_score[found]
        odd = np.logical_or.reduceat(gain[1] == _LOW, start)
        # best score up to each place of each word (one place more than characters), and the last piece's length
        slot = start + np.arange(len(size))
        best, last = np.full(len(chars) + len(size), _LOW), np.zeros(len(chars) + len(size), np.int8)
        best[slot] = 0.0
        reach = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
        for i in range(1, int(size[0]) + 1):
            n = reach[i - 1]
            top, by = np.full(n, _LOW), np.zeros(n, np.int8)
            for k in range(min(i, longest), 0, -1):  # the longer last piece wins a tie
                v = best[slot[:n] + i - k] + gain[k, start[:n] + i - k]
                more = v > top
                top[more], by[more] = v[more], k
            best[slot[:n] + i], last[slot[:n] + i] = top, by
        at, step = size.copy(), 0
        ids = np.zeros((int(size[0]), len(size)), np.uint32)
        count = np.zeros(len(size), np.int64)
        live = np.flatnonzero(~odd)
        while len(live):
            k = last[slot[live] + at[live]].astype(np.int64)
            at[live] -= k
            ids[step, live] = self.node_id[found[k, start[live] + at[live]]]
            count[live] += 1
            live, step = live[at[live] > 0], step + 1
        upto = np.cumsum(count)
        word = np.repeat(np.arange(len(size)), count)
        flat = ids[np.repeat(upto, count) - 1 - np.arange(len(word)), word]
        raw = memoryview(np.ascontiguousarray(flat.astype("<u4"))).cast("B")
        score = best[slot + size].tolist()
        return [None if o else (raw[4 * a : 4 * b].tobytes(), v) for o, a, b, v in zip(odd.tolist(), (upto - count).tolist(), upto.tolist(), score, strict=True)]

    def marked(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def encode(self, marked: str) -> tuple[bytes, float]:
        parts, scores = self.segment_words(self.word.findall(marked))
        return b"".join(parts), sum(scores, 0.0)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the texts one after another, where each text ends, and the scores. Where the vocabulary allows
        it, texts are cut at spaces and before line feeds, and their distinct words looked up at once; texts with
        empty words go one by one."""
        n = len(texts)
        plain = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARK, " ")
        lists = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        words = offsets - offsets[0]
        empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)
        odd = (np.add.reduceat(empty, words[:-1]) > 0) | (not self.simple) if n else np.zeros(0, bool)
        keep = ~np.repeat(odd, np.diff(words))
        coded = flat.filter(pa.array(keep)).dictionary_encode()
        words = np.concatenate([[0], np.cumsum(keep)])[words]
        _, at, size, score = self.known.find(coded.dictionary, self._words)
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        count = size[word]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.known.ids[np.repeat(at[word] - upto[:-1], count) + np.arange(upto[-1])]
        ends = upto[words]
        totals = np.diff(np.concatenate([[0.0], np.cumsum(score[word])])[words])
        if not odd.any():
            return ids, ends[1:], totals
        parts = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for k in np.flatnonzero(odd).tolist():
            raw, totals[k] = self.encode(self.marked(plain[k].as_py()))
            parts[k] = np.frombuffer(raw, "<u4")
        return np.concatenate(parts), np.cumsum([len(p) for p in parts]), totals

    def _words(self, new: list[str]) -> tuple[list[bytes], list[float]]:
        return self.segment_words([w if w[:1] == "\n" else MARK + w for w in new])

    def middles(self, chunks: list[tuple[str, int]]) -> list[tuple[np.ndarray, float]]:
        """Ids and score of each chunk's stretch between its cuts, all looked up at once."""
        cuts = [self.cuts(s, n) for s, n in chunks]
        at = [i for i, (a, b) in enumerate(cuts) if b > a]
        out = [(np.zeros(0, "<u4"), 0.0)] * len(chunks)
        if at:
            # a stretch begins with a mark, which encode_texts() adds
            ids, ends, score = self.encode_texts(pa.array([chunks[i][0][cuts[i][0] + 1 : cuts[i][1]] for i in at], pa.large_string()))
            for i, a, b, v in zip(at, [0, *ends[:-1].tolist()], ends.tolist(), score.tolist(), strict=True):
                out[i] = (ids[a:b], v)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.raw_size[ids]
        upto = np.cumsum(size)
        out = self.raw_pool[np.repeat(self.raw_at[ids] - (upto - size), size) + np.arange(upto[-1])].tobytes() if len(ids) else b""
        return out[1:] if out[:1] == b" " else out

    # chunks: s holds the chunk's n characters and up to longest - 1 of the next

    def cuts(self, s: str, n: int) -> tuple[int, int]:
        """First and last place in [0, n] where every segmentation has a boundary; (n + 1, -1) if there is none."""
        if not self.splits:
            return n + 1, -1
        first = self.mark.search(s, 0, n + 1)
        if first is None:
            return n + 1, -1
        last = s.rfind(MARK, 0, n + 1)
        while s[last - 1] == MARK:
            last -= 1
        return first.start(), last

    def forward(self, s: str, start: int, stop: int, width: int) -> np.ndarray:
        """Best scores [entry, place] from entry states start..start + width - 1 to the places of s, by pieces
        that begin before stop."""
        reach = min(len(s), stop + self.longest - 1)
        best = np.full((width, reach + 1), _LOW)
        for k in range(min(width, reach + 1 - start)):
            best[k, start + k] = 0.0
        for j in range(start, stop):
            col = best[:, j]
            if col.max() > _LOW:
                for k, v in self.steps(s, j):
                    np.maximum(best[:, j + k], col + v, out=best[:, j + k])
        return best

    def matrix(self, s: str, n: int, last: bool, middle: float | None = None) -> np.ndarray:
        """Best scores from entry to exit states. The first chunk is only entered in state 0, the last only left in it."""
        width = self.longest
        a, b = self.cuts(s, n)
        if b < 0:
            best = self.forward(s, 0, n, width)
            out = np.full((width, width), _LOW)
            m = min(width, best.shape[1] - n)
            out[:, :m] = best[:, n : n + m]
        else:
            head = self.forward(s[:a], 0, a, width)[:, a] if a else np.where(np.arange(width) == 0, 0.0, _LOW)
            middle = self.middles([(s, n)])[0][1] if middle is None else middle
            best = self.forward(s, b, n, 1)[0]
            tail = np.full(width, _LOW)
            m = min(width, len(best) - n)
            tail[:m] = best[n : n + m]
            out = head[:, None] + middle + tail[None, :]
        if last:
            out[:, 1:] = _LOW
        return out

    def between(self, s: str, n: int, enter: int, leave: int, middle: np.ndarray | None = None) -> bytes:
        """Ids of a chunk's pieces between its two states."""
        a, b = self.cuts(s, n)
        if b < 0:
            return self._trace(s, enter, n, n + leave)
        middle = self.middles([(s, n)])[0][0] if middle is None else middle
        return self._trace(s[:a], enter, a, a) + middle.astype("<u4").tobytes() + self._trace(s, b, n, n + leave)

    def _trace(self, s: str, start: int, stop: int, end: int) -> bytes:
        best, back = [_LOW] * (len(s) + 1), [start] * (len(s) + 1)
        best[start] = 0.0
        for j in range(start, stop):
            if best[j] > _LOW:
                for k, v in self.steps(s, j):
                    if best[j] + v > best[j + k]:
                        best[j + k], back[j + k] = best[j] + v, j
        return self.path(s, back, end, start)


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Max-plus matrix product."""
    return (x[:, :, None] + y[None, :, :]).max(axis=1)


def states(matrices: list[np.ndarray], enter: int, leave: int) -> list[int]:
    """Best state at every boundary of a row of chunks, from enter to leave."""
    alpha = [np.where(np.arange(len(matrices[0])) == enter, 0.0, _LOW)]
    for m in matrices:
        alpha.append((alpha[-1][:, None] + m).max(axis=0))
    out = [leave]
    for a, m in zip(reversed(alpha[:-1]), reversed(matrices), strict=True):
        out.append(int(np.argmax(a + m[:, out[-1]])))
    return out[::-1]


def _slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about most bytes in that column; a longer value makes one of its own."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def _short(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            for part in _slices(batch, 1, BATCH_CHARS):
                ids, ends, score = p.encode_texts(part.column(1))
                raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
                none = pc.is_null(part.column(1)).to_pylist()
                each = [None if x else raw[4 * a : 4 * b].tobytes() for x, a, b in zip(none, [0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(each, pa.binary()), pa.array(score, mask=np.array(none, bool))], names=["doc_id", "ids", "score"])
        p.known.forget()
        give_back()

    return run


def _cut(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p, uid = pieces(path), TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = p.marked(text)
                # a short rest joins the chunk before, so no piece reaches over a whole chunk
                count = max(1, len(s) // CHUNK)
                rows = [(uid, doc, k, k == count - 1, min(CHUNK, len(s)) if k < count - 1 else len(s) - k * CHUNK, s[k * CHUNK : (k + 1) * CHUNK + p.longest - 1] if k < count - 1 else s[k * CHUNK :]) for k in range(count)]
                uid += 1
                for i in range(0, len(rows), 500):
                    cols = list(zip(*rows[i : i + 500], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string()), strict=True)], names=["uid", "doc_id", "no", "last", "n", "s"])
        give_back()

    return run


def _matrices(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in (x for b in batches for x in _slices(b, 5, BATCH_CHARS)):
            r = batch.to_pydict()
            inner = p.middles(list(zip(r["s"], r["n"], strict=True)))
            m = [p.matrix(s, n, last, v).tobytes() for s, n, last, (_, v) in zip(r["s"], r["n"], r["last"], inner, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(m, pa.binary())], names=["uid", "no", "m"])
        p.known.forget()
        give_back()

    return run


def _square(raw: bytes) -> np.ndarray:
    m = np.frombuffer(raw, np.float64)
    return m.reshape(int(len(m) ** 0.5), -1)


def _block_product(t: pa.Table) -> pa.Table:
    rows = sorted(zip(t.column("no").to_pylist(), t.column("m").to_pylist(), strict=True))
    m = functools.reduce(product, (_square(x) for _, x in rows))
    return pa.table({"uid": t.column("uid").slice(0, 1), "block": t.column("block").slice(0, 1), "m": pa.array([m.tobytes()], pa.binary())})


def _block_states(t: pa.Table) -> pa.Table:
    """Entry and exit states of each block of a text."""
    rows = sorted(zip(t.column("block").to_pylist(), t.column("m").to_pylist(), strict=True))
    s = states([_square(x) for _, x in rows], 0, 0)
    return pa.table({"uid": pa.array([t.column("uid")[0].as_py()] * len(rows), pa.int64()), "block": pa.array([b for b, _ in rows], pa.int64()), "enter": pa.array(s[:-1], pa.int64()), "leave": pa.array(s[1:], pa.int64())})


def _chunk_states(t: pa.Table) -> pa.Table:
    rows = sorted(zip(t.column("no").to_pylist(), t.column("m").to_pylist(), strict=True))
    m = [_square(x) for _, x in rows]
    s = states(m, t.column("enter")[0].as_py(), t.column("leave")[0].as_py())
    score = [float(x[a, b]) for x, a, b in zip(m, s[:-1], s[1:], strict=True)]
    return pa.table({"uid": t.column("uid"), "no": pa.array([n for n, _ in rows], pa.int64()), "enter": pa.array(s[:-1], pa.int64()), "leave": pa.array(s[1:], pa.int64()), "score": pa.array(score)})


def _backtrace(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in (x for b in batches for x in _slices(b, 4, BATCH_CHARS)):
            r = batch.to_pydict()
            inner = p.middles(list(zip(r["s"], r["n"], strict=True)))
            ids = [p.between(s, n, a, b, x) for s, n, a, b, (x, _) in zip(r["s"], r["n"], r["enter"], r["leave"], inner, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(r["uid"], pa.int64()), pa.array(r["doc_id"], pa.int64()), pa.array(r["no"], pa.int64()), pa.array(ids, pa.binary()), pa.array(r["score"], pa.float64())], names=["uid", "doc_id", "no", "ids", "score"])
        p.known.forget()
        give_back()

    return run


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and score of every row."""
    ready(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    big = F.coalesce(F.length("text") > giant, F.lit(False))
    short = src.filter(~big).mapInArrow(_short(model_path), "doc_id long, ids binary, score double")
    chunks = materialize(src.filter(big).mapInArrow(_cut(model_path), "uid long, doc_id long, no long, last boolean, n long, s string"), "chunks")
    mats = materialize(chunks.mapInArrow(_matrices(model_path), "uid long, no long, m binary").withColumn("block", F.expr(f"no div {BLOCK}")), "matrices")
    blocks = mats.groupBy("uid", "block").applyInArrow(_block_product, "uid long, block long, m binary")
    ends = blocks.groupBy("uid").applyInArrow(_block_states, "uid long, block long, enter long, leave long")
    inner = mats.join(ends, ["uid", "block"]).groupBy("uid", "block").applyInArrow(_chunk_states, "uid long, no long, enter long, leave long, score double")
    traced = chunks.join(inner, ["uid", "no"]).select("uid", "doc_id", "no", "n", "s", "enter", "leave", "score").mapInArrow(_backtrace(model_path), "uid long, doc_id long, no long, ids binary, score double")
    # a document is one row here as in the input
    whole = traced.groupBy("uid", "doc_id").agg(F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("p"), F.sum("score").alias("score"))
    whole = whole.select("doc_id", F.expr("unhex(array_join(transform(p, x -> hex(x.ids)), ''))").alias("ids"), "score")
    return short.unionByName(whole)


def decode_documents(coded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text from doc_id and ids; bytes that are no UTF-8 become replacement characters."""
    ready(coded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model_path)
        for batch in batches:
            texts = [None if x is None else p.decode(np.frombuffer(x, "<u4")).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            rows = []
            for ids in batch.column(1).to_pylist():
                text = None if ids is None else p.decode(np.frombuffer(ids, "<u4"))
                rows.append((None, None, None) if ids is None else (len(ids) // 4, zlib.crc32(ids), zlib.crc32(text)))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols], batch.column(2)], names=["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "score"])
        give_back()

    return run


def op10_sp_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_ids, ids_crc32, score, and decoded_crc32, the crc32 of the text decoded from the ids."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return encode_documents(table(spark, sf_dir, "documents"), path).mapInArrow(_digest(path), "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, score double")
