"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text. Expectation-maximisation over the counts of vote
patterns (all rows, at most 3^10 patterns) estimates how each labeller votes on good and on bad texts; the posterior of a
pattern is the label of its texts. Those labels train a linear scorer on hashed features (word shapes and repetition) by
logistic regression in numpy, on a bounded sample of SAMPLE rows. The scorer decides on every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

SAMPLE = 16_000
BUCKETS = 1 << 14
STRETCH = 1000
#: Frequent short words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "the of and to in is that it as for was with be by on not he his but at are this have from or had an they which one we all "
    "le la les de des du et un une est que qui dans pour pas sur par en au aux il elle ne se ce "
    "der die das und zu den von mit sich auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie "
    "el los las y que del se por con para una su al lo como no si".split()
)
SHAPES = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
RUNS = re.compile(rb"A{2,}|a{2,}|0{2,}")
SYMBOLS = re.compile(rb"[#$%&*+/<=>@\\^_`{|}~]")


def _vote(value: float, good: float, bad: float) -> int:
    """2 (good) up to `good`, 1 (bad) from `bad` on, otherwise 0 (nothing)."""
    return 2 if value <= good else 1 if value >= bad else 0


def _same(words: list[bytes]) -> float:
    """The share of words that equal the word before."""
    return sum(a == b for a, b in zip(words, words[1:])) / len(words)


def _again(words: list[bytes], counts: Counter) -> float:
    """The share of words that stand earlier in the same stretch of STRETCH words, so that a long text is judged like a short one."""
    n = len(words)
    distinct = len(counts) if n <= STRETCH else sum(len(set(words[at : at + STRETCH])) for at in range(0, n, STRETCH))
    return 1 - distinct / n


class Read:
    """What votes and features both need of a text, worked out once."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode("utf-8", "surrogatepass")
        self.words = self.raw.split()
        n = max(1, len(self.words))
        self.shape = self.raw.translate(SHAPES)
        self.up, self.low = self.shape.count(b"A"), self.shape.count(b"a")
        self.counts = Counter(self.words)
        self.symbols, self.bangs = len(SYMBOLS.findall(self.raw)) / n, self.raw.count(b"!") / n
        self.top = max(self.counts.values(), default=0) / n
        self.again, self.same = (_again(self.words, self.counts), _same(self.words)) if self.words else (0.0, 0.0)


def votes(t: Read) -> int:
    """The labellers' votes as base-3 digits. A text without words has no votes but that it is empty."""
    n = len(t.words)
    if not n:
        return 1
    raw, up, low, counts = t.raw, t.up, t.low, t.counts
    lines = [x for x in raw.split(b"\n") if x.strip()]
    stops = sum(c for w, c in counts.items() if w.lower().strip(b".,;:!?").decode("utf-8", "replace") in STOP_WORDS) / n
    repeats = Counter(lines)
    cast = [
        2,  # not empty
        _vote(up / max(1, up + low), 0.15, 0.4),
        _vote(t.symbols, 0.05, 0.15),
        _vote(t.bangs, 0.05, 0.15),
        _vote(-stops, -0.08, -0.02) if n >= 20 else 0,
        _vote(t.top, 0.15, 0.25) if n >= 20 else 0,
        _vote(t.again, 0.5, 0.7),
        _vote(1 - len(repeats) / len(lines), 0.1, 0.4) if len(lines) >= 5 else 0,
        _vote(abs(len(raw) / n - 6.5), 3.0, 8.0) if n >= 20 else 0,
        _vote(t.same, 0.04, 0.12) if n >= 8 else 0,
    ]
    return sum(v * 3**i for i, v in enumerate(cast))


LABELLERS = 10


def features(t: Read) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: each word shape's share of the words, and buckets of repetition."""
    n = len(t.words)
    if not n:
        return np.array([zlib.crc32(b"empty") % BUCKETS], np.int64), np.ones(1)
    shapes = Counter(RUNS.sub(lambda m: m[0][:2], t.shape).split())
    out = Counter()
    for w, c in shapes.items():
        out[zlib.crc32(b"shape " + w[:24]) % BUCKETS] += c / n
    rates = {"same": t.same * 4, "up": t.up / max(1, t.up + t.low), "symbol": t.symbols, "bang": t.bangs, "top": t.top if n >= 20 else 0, "again": t.again if n >= 20 else 0}
    for name, rate in rates.items():
        out[zlib.crc32(f"{name} {min(9, int(rate * 10))}".encode()) % BUCKETS] += 1
    out[zlib.crc32(b"one") % BUCKETS] += 1
    return np.fromiter(out, np.int64, len(out)), np.fromiter(out.values(), np.float64, len(out))


def posteriors(counts: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """P(good) of each vote pattern, by expectation-maximisation. Starts from the majority; labellers start better than chance."""
    codes = sorted(counts)
    if not codes:
        return {}
    digits = np.array([[c // 3**i % 3 for i in range(LABELLERS)] for c in codes])
    n = np.array([counts[c] for c in codes], np.float64)
    good = (digits == 2).sum(1) > 4 * (digits == 1).sum(1)
    p = np.where(good, 0.9, 0.1)
    onehot = (digits[:, :, None] == np.arange(1, 3)).astype(np.float64)  # no vote is no evidence
    for _ in range(rounds):
        prior = np.clip((n * p).sum() / n.sum(), 0.02, 0.98)
        told = np.zeros((2, LABELLERS, 2))
        for y, w in enumerate((n * (1 - p), n * p)):
            told[y] = np.einsum("r,rjv->jv", w, onehot) + 0.5
            told[y] /= told[y].sum(1, keepdims=True)
        log = np.log(told)
        z = np.log(prior / (1 - prior)) + np.einsum("rjv,jv->r", onehot, log[1] - log[0])
        new = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return dict(zip(codes, p.tolist()))


class Scorer:
    """Logistic regression on hashed features with soft labels, by full gradient steps (Adam)."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 300):
        self.weight = np.zeros(BUCKETS)
        if not rows:
            return
        row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
        col, val = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
        balance = np.where(target >= 0.5, 0.5 / max(1, (target >= 0.5).sum()), 0.5 / max(1, (target < 0.5).sum()))
        m, v = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for step in range(1, rounds + 1):
            p = 1 / (1 + np.exp(-np.bincount(row, val * self.weight[col], len(rows))))
            g = np.bincount(col, val * (balance * (p - target))[row], BUCKETS) + 1e-6 * self.weight
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            self.weight -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip((self.weight[index] * value).sum(), -50, 50))))


def _numbers(index: np.ndarray, value: np.ndarray) -> tuple[bytes, bytes]:
    return index.astype(np.int16).tobytes(), value.astype(np.float32).tobytes()


def _read_numbers(index: bytes, value: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(index, np.int16).astype(np.int64), np.frombuffer(value, np.float32).astype(np.float64)


def describe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_features: bool = True) -> DataFrame:
    """(id_col, pattern, index, value): the labellers' votes on every whole text, and its hashed features as packed numbers."""
    kept = df.select(id_col, F.col(text_col).cast("string"))
    names = [id_col, "pattern"] + ["index", "value"] * with_features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            patterns, found = [], ([], [])
            for t in b.column(1):
                r = Read(t.as_py())
                patterns.append(votes(r))
                for cells, cell in zip(found, _numbers(*features(r)) if with_features else ()):
                    cells.append(cell)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(patterns, pa.int32()), *(pa.array(c, pa.binary()) for c in found if with_features)], names=names)

    more = ", index binary, value binary" if with_features else ""
    return kept.mapInArrow(lean(run), f"`{id_col}` {kept.schema[0].dataType.simpleString()}, pattern int{more}")


def _drawn(df: DataFrame, id_col: str, sample: int, total: int) -> DataFrame:
    """About `sample` rows, drawn by a hash of the id."""
    return df.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) <= int(min(1.0, sample / max(1, total)) * (1 << 30)))


def _counts(described: DataFrame) -> dict[int, int]:
    return {r["pattern"]: r["count"] for r in described.groupBy("pattern").count().collect()}  # at most 3^10 rows


def _learnt(counts: dict[int, int], described: DataFrame, sample: int) -> tuple[dict[int, float], Scorer]:
    known, told = posteriors(counts), described.select("pattern", "index", "value").limit(2 * sample).toArrow().to_pydict()
    rows = [_read_numbers(*x) for x in zip(told["index"], told["value"])]
    return known, Scorer(rows, np.array([known.get(p, 0.5) for p in told["pattern"]]))


def learn(described: DataFrame, id_col: str = "doc_id", sample: int = SAMPLE) -> tuple[dict[int, float], Scorer]:
    """The patterns' posteriors over all rows of a written describe(), and the scorer learnt from about `sample` of them."""
    counts = _counts(described)
    return _learnt(counts, _drawn(described, id_col, sample, sum(counts.values())), sample)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[dict[int, float], Scorer]:
    """The same from texts, where features of the sample alone are wanted."""
    counts = _counts(describe(df, id_col, text_col, False))
    return _learnt(counts, describe(_drawn(df, id_col, sample, sum(counts.values())), id_col, text_col), sample)


def rate(described: DataFrame, model: tuple[dict[int, float], Scorer], id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """(id_col, posterior, score, keep) for every row of describe(): P(good) of its votes, the scorer's P(good), and score >= threshold. Texts without words have 0."""
    shared = described.sparkSession.sparkContext.broadcast(model)
    rows = described.select(id_col, "pattern", "index", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scorer = shared.value
        for b in batches:
            pattern = b.column(1).to_numpy(zero_copy_only=False)
            there = pattern != 1
            post = np.array([known.get(int(p), 0.5) for p in pattern]) * there
            score = np.array([scorer.score(*_read_numbers(i.as_py(), v.as_py())) for i, v in zip(b.column(2), b.column(3))]) * there
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(post, pa.float64()), pa.array(score, pa.float64()), pa.array(there & (score >= threshold), pa.bool_())], names=[id_col, "posterior", "score", "keep"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, posterior double, score double, keep boolean")


def classify(df: DataFrame, model: tuple[dict[int, float], Scorer], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """rate() of texts. Null and empty texts are rated as empty (never kept); repeated rows get the same answer; other columns are ignored."""
    return rate(describe(df, id_col, text_col), model, id_col, threshold)


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """df's rows whose texts the scorer rates good, all columns, judged in place (nothing is joined or shuffled)."""
    shared = df.sparkSession.sparkContext.broadcast(fit(df, id_col, text_col)[1])
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = (Read(t.as_py()) for t in b.column(at))
            yield b.filter(pa.array([bool(t.words) and shared.value.score(*features(t)) >= threshold for t in texts], pa.bool_()))

    return df.mapInArrow(lean(run), df.schema)
