"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter's strongest response is kept
(max pooling) and a softmax layer names the language. Forward and backward passes are numpy. Training takes a bounded
sample of labelled rows (PER_LANGUAGE documents of each language, SAMPLE_WINDOWS windows spread over each whole text);
prediction reads every byte of every text in overlapping windows and averages the windows' probabilities by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sample import by_label

WINDOW = 128
WIDTHS = (2, 3, 4, 5)
FILTERS = 8
DIM = 8
PER_LANGUAGE = 800
SAMPLE_WINDOWS = 4
EPOCHS = 4
STRIDE = WINDOW - max(WIDTHS) + 1


def windows(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, zero-filled at its end, overlapping so that no filter misses a place; bytes new in each."""
    n = max(1, -(-(len(text) - WINDOW + STRIDE) // STRIDE))
    flat = np.zeros((n - 1) * STRIDE + WINDOW, np.uint8)
    flat[: len(text)] = np.frombuffer(text, np.uint8)
    weight = np.full(n, float(STRIDE))
    weight[-1] = max(1, len(text) - (n - 1) * STRIDE)
    return np.lib.stride_tricks.as_strided(flat, (n, WINDOW), (STRIDE, 1)), weight


class ByteNet:
    """The network. All widths share one matrix product: narrow filters have zeros in their last places."""

    def __init__(self, labels: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.labels, wide, n = labels, max(WIDTHS), FILTERS * len(WIDTHS)
        self.mask = np.repeat(np.stack([np.repeat(np.arange(wide) < w, DIM) for w in WIDTHS], axis=1), FILTERS, axis=1).astype(np.float32)
        self.embed = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.conv = (rng.normal(0, 0.2, (wide * DIM, n)) * self.mask).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.2, (n, len(labels))).astype(np.float32)
        self.last = np.zeros(len(labels), np.float32)

    def patches(self, x: np.ndarray) -> np.ndarray:
        e = self.embed[x].reshape(len(x), WINDOW * DIM)
        wide = max(WIDTHS) * DIM
        return np.lib.stride_tricks.as_strided(e, (len(x), STRIDE, wide), (e.strides[0], e.itemsize * DIM, e.itemsize)).reshape(-1, wide)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.patches(x)
        return p, (p @ self.conv).reshape(len(x), STRIDE, -1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.labels)))
        for at in range(0, len(x), 64):
            top = np.maximum(self.pooled(x[at : at + 64])[1].max(axis=1) + self.bias, 0)
            z = top @ self.out + self.last
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[at : at + 64] = z / z.sum(axis=1, keepdims=True)
        return out

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 5) -> "ByteNet":
        rng, names, step = np.random.default_rng(seed), ("embed", "conv", "bias", "out", "last"), 0
        first = {n: np.zeros_like(getattr(self, n)) for n in names}
        second = {n: np.zeros_like(getattr(self, n)) for n in names}
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 64):
                b, t = x[order[at : at + 64]], y[order[at : at + 64]]
                p, c = self.pooled(b)
                where = c.argmax(axis=1)
                raw = np.take_along_axis(c, where[:, None], axis=1)[:, 0] + self.bias
                top = np.maximum(raw, 0)
                z = top @ self.out + self.last
                z = np.exp(z - z.max(axis=1, keepdims=True))
                d = z / z.sum(axis=1, keepdims=True)
                d[np.arange(len(b)), t] -= 1
                d /= len(b)
                up = (d @ self.out.T) * (raw > 0)
                rows = np.arange(len(b))[:, None] * STRIDE + where  # the patch behind each filter's strongest response
                grad = {"out": top.T @ d, "last": d.sum(0), "bias": up.sum(0)}
                grad["conv"] = np.einsum("bfk,bf->kf", p[rows], up) * self.mask
                to_patch = np.einsum("bf,kf->bfk", up, self.conv).reshape(len(b), len(self.bias), -1, DIM)
                places = where[:, :, None] + np.arange(max(WIDTHS))
                grad["embed"] = np.zeros_like(self.embed)
                np.add.at(grad["embed"], b[np.arange(len(b))[:, None, None], places].ravel(), to_patch.reshape(-1, DIM))
                step += 1
                for n in names:
                    first[n] = 0.9 * first[n] + 0.1 * grad[n]
                    second[n] = 0.999 * second[n] + 0.001 * grad[n] ** 2
                    move = rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, n, (getattr(self, n) - move).astype(np.float32))
        return self


def fit(rows: DataFrame, id_col: str, text_col: str, label_col: str, per_language: int = PER_LANGUAGE) -> ByteNet | None:
    """The network learnt from labelled rows; None if there are none. Null labels and texts without letters are left out."""
    told = by_label(rows.where(F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")), id_col, label_col, per_language)
    spread = F.length(text_col) - WINDOW
    cut = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)), lambda i: F.substring(F.col(text_col), F.greatest(F.lit(1), F.floor(spread * i / (SAMPLE_WINDOWS - 1)) + 1).cast("int"), F.lit(WINDOW)))
    pieces = told.select(F.col(id_col).cast("string").alias("i"), F.col(label_col).alias("l"), F.explode(F.array_distinct(cut)).alias("w")).orderBy("l", "i", "w").toArrow().to_pydict()
    labels = sorted(set(pieces["l"]))
    if not labels:
        return None
    x = np.zeros((len(pieces["w"]), WINDOW), np.uint8)
    for row, w in zip(x, pieces["w"]):
        b = w.encode()[:WINDOW]
        row[: len(b)] = np.frombuffer(b, np.uint8)
    return ByteNet(labels).train(x, np.searchsorted(labels, pieces["l"]))


def predict(df: DataFrame, model: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for every row, over its whole text.

    Null texts and texts without letters are `und` with score 0, and so is every row if there is no model. Equal
    probabilities go to the first label in order. Repeated rows get the same answer; other columns are ignored.
    """
    kept = df.select(id_col, F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias(text_col))
    if model is None:
        return kept.select(id_col, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    net = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            best, score = [None] * b.num_rows, np.zeros(b.num_rows)
            held: list[tuple[int, np.ndarray, np.ndarray]] = []

            def flush() -> None:
                if held:
                    p = net.value.probabilities(np.concatenate([w for _, w, _ in held]))
                    weight = np.concatenate([w for _, _, w in held])
                    starts = np.cumsum([0, *(len(w) for _, w, _ in held)])[:-1]
                    mean = np.add.reduceat(p * weight[:, None], starts, axis=0) / np.add.reduceat(weight, starts)[:, None]
                    for (i, _, _), m in zip(held, mean):
                        best[i], score[i] = net.value.labels[int(m.argmax())], min(1.0, float(m.max()))
                    held.clear()

            size = 0
            for i in range(b.num_rows):
                if (t := texts[i].as_py()) is not None:
                    held.append((i, *windows(t.encode("utf-8", "surrogatepass"))))
                    size += len(held[-1][1])
                    if size > 4096:
                        flush()
                        size = 0
            flush()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x or "und" for x in best]), pa.array(score)], names=[id_col, "lang_pred", "score"])

    return kept.mapInArrow(run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, lang_pred string, score double")
