"""Quality classifier: zstandard dictionaries of good and bad text, calibrated size difference.

Training takes a bounded sample of labelled rows (``per_class`` rows of each class in hash order, texts of
at most ``max_train_chars``). Half of it, by id hash, builds one dictionary per class; the other half fits
a logistic calibration. Scoring cuts every whole text into blocks, compresses each block with either
dictionary and turns the normalised difference of the summed sizes into a probability. Blocks keep the
dictionaries in play over all of a long text.

Cases: null or empty text scores as difference 0; repeated ids are scored row by row; labels without a
document, with a null id or a null label are ignored; an id with both labels counts as bad; without labels
of both classes every score is the smoothed share of good labels; an empty table gives no rows; other
columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import crc_mod, ready, table

PER_CLASS = 1500
MAX_TRAIN_CHARS = 20_000
DICT_BYTES = 32 * 1024
BLOCK = 512
LEVEL = 3


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


class CompressionModel:
    """Two dictionaries and the calibration; picklable."""

    def __init__(self, good: bytes, bad: bytes, weights: tuple[float, float], base_rate: float):
        self.good, self.bad, self.weights, self.base_rate = good, bad, weights, base_rate
        self._made = None

    def __getstate__(self):
        return {**self.__dict__, "_made": None}

    def difference(self, text: str | None) -> float:
        """(bytes with the bad dictionary - bytes with the good one) / their sum; 0 for an empty text."""
        if not text or not self.good:
            return 0.0
        if self._made is None:
            import zstandard as z

            # sizes alone matter: no checksum, content size or dictionary id in a frame
            self._made = [z.ZstdCompressor(level=LEVEL, dict_data=_prepared(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in (self.bad, self.good)]
        bad, good = self._made
        b = g = 0
        for part in blocks(text.encode("utf-8", "surrogatepass")):
            b += len(bad.compress(part))
            g += len(good.compress(part))
        return (b - g) / (b + g)

    def score(self, diff: np.ndarray) -> np.ndarray:
        if not self.good:
            return np.full(len(diff), self.base_rate)
        a, c = self.weights
        return 1 / (1 + np.exp(-np.clip(a * diff + c, -30, 30)))


def _prepared(data: bytes):
    import zstandard as z

    d = z.ZstdCompressionDict(data)
    d.precompute_compress(level=LEVEL)
    return d


def _dictionary(texts: list[str]) -> bytes:
    import zstandard as z

    samples = [b for t in texts for b in blocks(t.encode("utf-8", "surrogatepass"))]
    try:
        return z.train_dictionary(DICT_BYTES, samples).as_bytes()
    except z.ZstdError:  # too little text to train on: the text itself is the dictionary's content
        return b"".join(samples)[-DICT_BYTES:]


def _calibrate(diff: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the difference by Newton's method; a slight ridge keeps it finite."""
    scale = float(np.std(diff)) or 1.0
    x = np.stack([diff / scale, np.ones(len(diff))], axis=1)
    # classes weigh alike: the sample holds them in equal numbers, whatever their share in the corpus
    share = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum())) * len(label)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (label - p)) - 1e-2 * w
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def train(docs: DataFrame, labels: DataFrame, eligible: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, max_train_chars: int = MAX_TRAIN_CHARS) -> CompressionModel:
    """Learn from at most per_class labelled rows of each class for which eligible holds."""
    lab = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & eligible)
    lab = lab.groupBy(F.col(id_col).alias("i")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    n_good = lab.filter("y = 1").count()
    n_all = lab.count()
    rate = (n_good + 1) / (n_all + 2)
    ids: dict[int, int] = {}
    for y in (0, 1):
        ids |= {r["i"]: y for r in lab.filter(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(per_class).collect()}
    if len(set(ids.values())) < 2:
        return CompressionModel(b"", b"", (0.0, 0.0), rate)
    picked = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter(F.col("i").isin(list(ids)) & (F.length("t").between(1, max_train_chars)))
    rows = sorted((r["i"], r["t"]) for r in picked.groupBy("i").agg(F.min("t").alias("t")).collect())
    seen: set[str] = set()
    rows = [(i, t) for i, t in rows if not (t in seen or seen.add(t))]  # copies would sit in both halves
    half = np.random.default_rng(7).permutation(len(rows)) % 2
    first = {y: [t for (i, t), h in zip(rows, half, strict=True) if h == 0 and ids[i] == y] for y in (0, 1)}
    if not first[0] or not first[1]:
        return CompressionModel(b"", b"", (0.0, 0.0), rate)
    model = CompressionModel(_dictionary(first[1]), _dictionary(first[0]), (0.0, 0.0), rate)
    rest = [(model.difference(t), ids[i]) for (i, t), h in zip(rows, half, strict=True) if h == 1]
    y = np.array([r[1] for r in rest], dtype=float)
    if len(rest) and 0 < y.sum() < len(y):
        model.weights = _calibrate(np.array([r[0] for r in rest]), y)
    else:
        model.weights = (50.0, 0.0)
    return model


def score_documents(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size_difference, score, predicted for every row."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            diff = np.array([m.difference(t.as_py()) for t in batch.column(1)], dtype=float)
            s = m.score(diff)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(diff), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "size_difference", "score", "predicted"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, size_difference double, score double, predicted int")


def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    out = score_documents(docs, model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "size_difference")
