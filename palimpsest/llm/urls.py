"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the URLs that no rule fits.

The trees are grown in numpy on histograms of a bounded sample of labelled URLs (PER_LABEL of each label). Features are
lengths, depth, digit ratio, entropy, parameter counts and suffix statistics: the smoothed block rate of the host's last
label and of its last two, learnt out of fold. A fold holds whole hosts and a host has no rate of its own, so nothing tells a
training row's label but how such URLs look: the trees judge hosts that they have not seen, which a list of hosts or words can't.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sample import by_label

PER_LABEL = 10_000
TREES, DEPTH, BINS, RATE = 60, 3, 32, 0.3
FEATURE_SHARE = 0.7
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
MAX_RULES = 1_000_000


def split(url: str | None) -> tuple[str, str]:
    """(host, path): host from after the first :// up to / ? # or the end, A-Z lowered; path from there up to ? or #."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1].split("#", 1)[0].split("?", 1)[0]
    at = rest.find("/")
    return (rest if at < 0 else rest[:at]).translate(LOWER), "" if at < 0 else rest[at:]


class Rules:
    """Rules (verdict, host/path): each fits its host and all subdomains where the path starts with the rule's."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        self.by_host: dict[str, list[tuple[str, str, str]]] = defaultdict(list)
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host[host.translate(LOWER)].append((slash + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, and its verdict."""
        best: tuple[int, str, str] | None = None
        while host:
            for prefix, rule, verdict in self.by_host.get(host, ()):
                if path.startswith(prefix) and (best is None or len(rule) > best[0]):
                    best = (len(rule), rule, verdict)
            host = host.partition(".")[2]
        return (best[1], best[2]) if best else (None, None)


def suffixes(url: str | None) -> tuple[str, str]:
    parts = split(url)[0].split(".")
    return parts[-1], ".".join(parts[-2:])


def lexical(url: str | None) -> list[float]:
    """Features of the string alone; a null or unreadable URL has zeros."""
    host, path = split(url)
    if not host and not path:
        return [0.0] * 16
    query = url.split("#", 1)[0].partition("?")[2]
    own = host.removeprefix("www.")
    n = len(url)
    entropy = lambda s: -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0
    vowels = sum(c in "aeiou" for c in host)
    return [
        n, len(host), len(path), path.count("/"), host.count("."), host.count("-"), sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in host),
        query.count("=") , len(query), entropy(url), entropy(own), vowels / max(1, len(host)), max((len(x) for x in own.split(".")), default=0), float("#" in url), float(url.startswith("https")),
    ]


class Trees:
    """Boosted regression trees of fixed depth for the logistic loss."""

    def __init__(self) -> None:
        self.base, self.edges, self.trees = 0.0, [], []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, share: float = 1.0) -> "Trees":
        """share: how many of the features each tree may cut at, drawn anew for each."""
        weight = np.ones(len(y)) if weight is None else weight
        weight = weight * np.where(y == 1, 0.5 / max(1e-9, weight[y == 1].sum()), 0.5 / max(1e-9, weight[y == 0].sum())) * len(y)  # both labels weigh the same
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b, score, rng = self.bins(x), np.zeros(len(y)), np.random.default_rng(3)
        for _ in range(TREES):
            open_to = np.sort(rng.permutation(b.shape[1])[: max(1, round(share * b.shape[1]))])
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            node, plan = np.zeros(len(y), np.int64), []
            for level in range(DEPTH):
                width = 1 << level
                feature, cut = np.zeros(width, np.int64), np.full(width, BINS)
                best = np.full(width, 1e-9)
                for j in open_to:
                    cell = node * (BINS + 1) + b[:, j]
                    gs, hs = (np.bincount(cell, v, width * (BINS + 1)).reshape(width, -1).cumsum(1) for v in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    at = gain.argmax(axis=1)
                    value = gain[np.arange(width), at]
                    up = value > best
                    best[up], feature[up], cut[up] = value[up], j, at[up]
                plan.append((feature, cut))
                node = 2 * node + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaf = RATE * np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + 1)
            score += leaf[node]
            self.trees.append((plan, leaf))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        b, score, rows = self.bins(x), np.zeros(len(x)), np.arange(len(x))
        for plan, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in plan:
                node = 2 * node + (b[rows, feature[node]] > cut[node])
            score += leaf[node]
        return 1 / (1 + np.exp(-score))


class UrlModel:
    """Trees and the suffix statistics they read."""

    SMOOTH = 20.0

    def __init__(self, urls: Sequence[str | None], blocked: Sequence[int]):
        y = np.asarray(blocked, np.int64)
        self.prior, self.rates, self.trees = float(y.mean()) if len(y) else 0.0, {}, None
        if len(set(blocked)) < 2:
            return
        keys = [suffixes(u) for u in urls]
        fold = np.array([zlib.crc32(split(u)[0].encode("utf-8", "surrogatepass")) % 2 for u in urls])
        x = np.array([lexical(u) for u in urls], np.float64)
        told = np.zeros((len(y), 2))
        for f in (0, 1):
            rates = self._rates([k for k, g in zip(keys, fold) if g != f], y[fold != f])
            told[fold == f] = np.array([[rates.get((i, s), self.prior) for i, s in enumerate(k)] for k, g in zip(keys, fold) if g == f]).reshape(-1, 2)
        self.rates = self._rates(keys, y)
        rows = Counter(split(u)[0] for u in urls)  # a large host weighs more than a small one, but not by all its rows
        self.trees = Trees().train(np.concatenate([x, told], axis=1), y, np.array([rows[split(u)[0]] ** -0.5 for u in urls]), FEATURE_SHARE)

    def _rates(self, keys: list[tuple[str, str]], y: np.ndarray) -> dict[tuple[int, str], float]:
        total, bad = Counter(), Counter()
        for k, v in zip(keys, y):
            for at in enumerate(k):
                total[at] += 1
                bad[at] += int(v)
        return {at: (bad[at] + self.SMOOTH * self.prior) / (n + self.SMOOTH) for at, n in total.items()}

    def probability(self, urls: Sequence[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(urls), self.prior)
        x = [[*lexical(u), *(self.rates.get(at, self.prior) for at in enumerate(suffixes(u)))] for u in urls]
        return self.trees.probability(np.array(x, np.float64)) if x else np.zeros(0)


def fit(labelled: DataFrame, url_col: str, label_col: str, per_label: int = PER_LABEL) -> UrlModel:
    """The model learnt from labelled URLs (label_col: 1 block, 0 allow; null labels and URLs are left out)."""
    told = by_label(labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull()), url_col, label_col, per_label)
    rows = told.select(url_col, label_col).distinct().orderBy(F.xxhash64(url_col), url_col, label_col).toArrow().to_pydict()
    return UrlModel(rows[url_col], [int(v) for v in rows[label_col]])


def judge(df: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """(id_col, host, path, rule, verdict, score) for every row.

    The longest rule that fits gives the verdict; where none fits the model does, with `block` from `threshold` on. A null URL or
    one without :// has an empty host and path, no rule and the features of an empty string. Repeated rows get the same
    answer; other columns are ignored; an empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast((model, Rules(rules)))
    kept = df.select(id_col, F.col(url_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, table = shared.value
        for b in batches:
            urls = b.column(1).to_pylist()
            parts = [split(u) for u in urls]
            found = [table.find(*p) for p in parts]
            score = net.probability(urls)
            verdict = [v or ("block" if s >= threshold else "allow") for (_, v), s in zip(found, score)]
            cols = [b.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array([r for r, _ in found], pa.string()), pa.array(verdict, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "host", "path", "rule", "verdict", "score"])

    return kept.mapInArrow(run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, host string, path string, rule string, verdict string, score double")
