"""Approximate nearest neighbours by balanced posting lists.

Centroids come from hierarchical, balanced k-means on a bounded sample (SAMPLE distinct vectors, MAX_LISTS centroids).
They are searched through an in-memory graph (each centroid's nearest centroids, both ways) with a batched beam; where an eighth of
all centroids or more are wanted, by products with all. Every vector goes to its nearest list, and a boundary vector also to other lists
whose centroid is almost as near (at most REPLICAS). A query reads the lists within a ratio of the nearest one's distance, at most so many.

Both limits are set when the index is fitted: TRIALS queries are answered exactly, by brute force over all rows in blocks, and the
ratio and the number of lists are those that find the share `recall` of their neighbours. So probing grows where the data ask for it.
Long lists are cut into blocks and many queries of one list into query blocks, so a hot list or vector spreads over tasks, whole.
Scores are exact cosines in double precision on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise
from .vectors import matrix, usable

SAMPLE = 65_536
MAX_LISTS = 16_384
LIST_ROWS = 160
REPLICAS = 8
CLOSURE = 1.15
RECALL, TRIALS = 0.98, 256
LEAST_WIDTH = 16
DEGREE = 16
BLOCK = 1024
QUERY_BLOCK = 1024


def tame(x: np.ndarray) -> np.ndarray:
    """Rows whose squares would leave the range of doubles, divided by their largest component: their cosines stay what they are."""
    most = np.abs(x).max(axis=1, initial=0)
    odd = (most > 1e100) | (most < 1e-100) & (most > 0)
    return np.where(odd[:, None], x / np.where(odd, most, 1)[:, None], x) if odd.any() else x


def unit(x: np.ndarray) -> np.ndarray:
    x = tame(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of up to `lists` balanced clusters: clusters are split, largest first come, until each is small."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    leaf = max(1, len(sample) / max(1, lists))
    out, todo = [], [np.arange(len(sample))]
    while todo:
        at = todo.pop()
        if len(at) <= 1.5 * leaf or len(at) < 2:
            mean = sample[at].mean(axis=0)
            out.append(mean if np.abs(mean).sum() > 1e-12 else sample[at[0]])
            continue
        k = int(min(16, max(2, round(len(at) / leaf))))
        x, centres = sample[at], sample[rng.choice(at, k, replace=False)]
        load = np.zeros(k)
        for _ in range(8):
            near = x @ centres.T - 0.05 * load / (len(at) / k)  # a full cluster is a little less near
            mine = near.argmax(axis=1)
            load = np.bincount(mine, minlength=k).astype(float)
            centres = np.stack([x[mine == j].mean(axis=0) if load[j] else x[rng.integers(len(x))] for j in range(k)])
        parts = [at[mine == j] for j in range(k)]
        todo += [p for p in parts if len(p)] if max(map(len, parts)) < len(at) else np.array_split(at, k)
    return unit(np.stack(out)).astype(np.float32) if out else np.zeros((0, sample.shape[1]), np.float32)


def link(centres: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """The graph: row i holds the centroids next to i, both ways; missing ones repeat i."""
    n = len(centres)
    near = np.zeros((n, min(degree, max(1, n - 1))), np.int64)
    for at in range(0, n, 2048):
        s = centres[at : at + 2048] @ centres.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -9
        near[at : at + 2048] = np.argpartition(-s, near.shape[1] - 1, axis=1)[:, : near.shape[1]] if n > 1 else 0
    out = np.repeat(np.arange(n)[:, None], 2 * near.shape[1], axis=1)
    out[:, : near.shape[1]] = near
    used = np.zeros(n, np.int64)
    for j in range(near.shape[1]):
        for i in range(n):
            if used[near[i, j]] < near.shape[1]:
                out[near[i, j], near.shape[1] + used[near[i, j]]] = i
                used[near[i, j]] += 1
    return out


def beam(x: np.ndarray, centres: np.ndarray, graph: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each unit row of x the `width` nearest centroids that the graph search meets, nearest first: ids, distances."""
    n, k = len(x), len(centres)
    width = min(width, k)
    rows = np.arange(n)[:, None]
    entries = np.unique(np.linspace(0, k - 1, min(k, max(width, 32))).astype(np.int64))
    ids = np.repeat(entries[None], n, axis=0)
    sims = x @ centres[entries].T
    seen = np.zeros((n, k), bool)
    seen[:, entries] = True
    order = np.argsort(-sims, axis=1)[:, :width]
    ids, sims = ids[rows, order], sims[rows, order]
    done = np.zeros(ids.shape, bool)
    while True:
        live = np.flatnonzero((~done).any(axis=1))
        if not len(live):
            return ids, np.sqrt(np.maximum(0, 2 - 2 * sims))
        r = live[:, None]
        take = np.argsort(done[live], axis=1, kind="stable")[:, :4]  # the best four not yet expanded
        fresh = ~done[r, take]
        done[r, take] = True
        near = np.where(fresh[:, :, None], graph[ids[r, take]], ids[r, take][:, :, None]).reshape(len(live), -1)
        near.sort(axis=1)
        new = ~seen[r, near]
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[r, near] = True
        s = np.full(near.shape, -9.0, np.float32)
        at = np.nonzero(new)
        s[at] = np.einsum("ij,ij->i", x[live[at[0]]], centres[near[at]])
        ids2, sims2, done2 = np.concatenate([ids[live], near], 1), np.concatenate([sims[live], s], 1), np.concatenate([done[live], ~new], 1)
        order = np.argsort(-sims2, axis=1, kind="stable")[:, :width]
        i = np.arange(len(live))[:, None]
        ids[live], sims[live], done[live] = ids2[i, order], sims2[i, order], done2[i, order]


def nearest(x: np.ndarray, model, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The `width` nearest centroids of unit rows, nearest first: ids, distances."""
    centres, graph, _ = model
    if 8 * width < len(centres):
        return beam(x, centres, graph, width)
    sims = x @ centres.T
    ids = np.argsort(-sims, axis=1, kind="stable")[:, :width]
    return ids, np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sims, ids, axis=1)))


def _chosen(vectors: np.ndarray, model, width: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, list): of the `width` nearest lists those within `ratio` of the nearest, or of the usual distance if a centroid is nearer than that."""
    centres, _, usual = model
    rows, lists = [], []
    x = unit(vectors).astype(np.float32)
    step = max(16, min(512, (1 << 23) // max(1, len(centres))))
    for at in range(0, len(x), step):
        ids, far = nearest(x[at : at + step], model, width)
        r, c = np.nonzero(far <= ratio * np.maximum(far[:, :1], usual))
        rows.append(r + at)
        lists.append(ids[r, c])
    return (np.concatenate(rows), np.concatenate(lists)) if rows else (np.zeros(0, np.int64),) * 2


def limits(model, queries: np.ndarray, asker: np.ndarray, neighbours: np.ndarray, recall: float) -> tuple[int, float]:
    """(lists, ratio) that find the share `recall` of the neighbours (vectors) of queries, each given by its place in `asker`."""
    centres, _, usual = model
    if not len(neighbours):
        return LEAST_WIDTH, CLOSURE
    row, of = _chosen(neighbours, model, REPLICAS, CLOSURE)
    x, width = unit(queries).astype(np.float32), LEAST_WIDTH
    most = min(1.0, recall + (1 - recall) / 4)  # each limit alone finds a little more than both together
    while True:
        ids, far = nearest(x, model, width)
        place = np.full((len(x), len(centres)), len(centres), np.int32)
        np.put_along_axis(place, ids, np.arange(ids.shape[1], dtype=np.int32)[None], axis=1)
        rank = np.full(len(neighbours), len(centres))
        np.minimum.at(rank, row, place[asker[row], of])
        if (rank < len(centres)).mean() >= most or width >= len(centres):
            break
        width *= 2
    rank = np.minimum(rank, ids.shape[1] - 1)
    need = far[asker, rank] / np.maximum(far[asker, 0], usual)
    take = lambda v: float(np.sort(v)[min(len(v) - 1, math.ceil(most * len(v)) - 1)])
    return int(take(rank)) + 1, max(1.0, take(need)) * (1 + 1e-6)


def _take(column: pa.Array, rows: np.ndarray) -> pa.Array:
    return column.take(pa.array(rows))


def _best(near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest values and what ties with them within rounding; -9 marks what is no candidate."""
    kth = np.partition(near, -k, axis=1)[:, -k][:, None] if near.shape[1] > k else np.full((len(near), 1), -8.0)
    return np.nonzero((near >= kth - 1e-9) & (near > -8))


def search(df: DataFrame, id_col: str, vec_col: str, is_query, k: int = 5, list_rows: int = LIST_ROWS, recall: float = RECALL, sample_rows: int = SAMPLE, max_lists: int = MAX_LISTS) -> DataFrame:
    """(query_id, rank, id, score): for each row for which the column `is_query` holds, the k nearest other rows found.

    Score: cosine in double precision on the original vectors; ties go to the smaller id. Vectors that are null, zero or
    hold null or non-finite components take no part; shorter ones are filled with zeros. Every other row is a candidate: rows that repeat an
    id stand for themselves, also as queries, and a null id is one like any other that loses all ties. No rows: no results. Other
    columns are ignored. Ids are integers. Bounds: sample_rows vectors are clustered on the driver into max_lists lists at most; beyond
    max_lists * list_rows rows lists grow with the table, so a table of billions asks for larger bounds.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = materialise(rows.where(usable("vec") & F.exists("vec", lambda x: x != 0)).withColumn("row", F.monotonically_increasing_id()), "ann-rows")
    total, asked, width = rows.agg(F.count(F.lit(1)), F.sum(F.col("q").cast("long")), F.max(F.size("vec"))).first()
    width = width or 0
    drawn = lambda some, share: some.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < int(min(1.0, share) * (1 << 20)) + 1)
    sample = drawn(rows, sample_rows / max(1, total)).select("vec").limit(sample_rows).toArrow()
    lists = max(1, min(max_lists, total // list_rows, sample_rows // 4))
    centres = fit(unit(matrix(sample["vec"], width)), lists) if total else np.zeros((0, 1), np.float32)
    graph = link(centres) if len(centres) else None
    usual = float(np.median(beam(unit(matrix(sample["vec"].slice(0, 2048), width)).astype(np.float32), centres, graph, 4)[1][:, 0])) if len(centres) else 0.0
    model = (centres, graph, usual)
    trial = drawn(rows.where("q"), TRIALS / max(1, asked or 0)).select("row", "vec").limit(2 * TRIALS).toArrow()
    tried = spark.sparkContext.broadcast((np.asarray(trial["row"], np.int64), matrix(trial["vec"], width)))
    vec_type = rows.schema["vec"].dataType.simpleString()

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The trial queries against a batch of rows, whole."""
        own, y = tried.value
        for b in batches if len(own) else ():
            x, me = unit(matrix(b.column(1), width)), b.column(0).to_numpy(zero_copy_only=False)
            near = unit(y) @ x.T
            near[own[:, None] == me[None]] = -9
            q, r = np.nonzero(near > -8) if near.shape[1] <= k else (np.repeat(np.arange(len(near)), k), np.argpartition(-near, k - 1, axis=1)[:, :k].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(q), _take(b.column(1), r), pa.array(near[q, r])], names=["asker", "vec", "score"])

    exact = rows.select("row", "vec").mapInArrow(truth, f"asker long, vec {vec_type}, score double").where("score > -8")
    exact = exact.withColumn("r", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score")))).where(F.col("r") <= k).select("asker", "vec").toArrow()
    probes_most, ratio = limits(model, tried.value[1], np.asarray(exact["asker"], np.int64), matrix(exact["vec"], width), recall) if len(centres) else (1, 1.0)
    shared = spark.sparkContext.broadcast(model)

    def spread(most: int, within: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    part = b.slice(at, 4096)
                    row, lists = _chosen(matrix(part.column(2), width), shared.value, most, within)
                    yield pa.RecordBatch.from_arrays([pa.array(lists), *(_take(c, row) for c in part.columns)], names=["list", "row", "id", "vec"])

        return run

    shape = f"list long, row long, id long, vec {vec_type}"
    postings = materialise(rows.select("row", "id", "vec").mapInArrow(spread(REPLICAS, CLOSURE), shape), "ann-postings")
    probes = materialise(rows.where("q").select("row", "id", "vec").mapInArrow(spread(probes_most, ratio), shape), "ann-probes")
    sizes = postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    wanted = probes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("asked"))
    plan = F.broadcast(sizes.join(wanted, "list"))  # a row for each list: at most max_lists

    def cut(part: DataFrame, own: str, other: str) -> DataFrame:
        return part.join(plan, "list").select("list", "row", "id", "vec", F.pmod(F.xxhash64("row"), F.col(own)).alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))

    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            x, y = tame(matrix(left["vec"], width)), tame(matrix(right["vec"], width))
            xi, yi = left["row"].to_numpy(), right["row"].to_numpy()
            xd, yd = (t["id"].combine_chunks() for t in (left, right))
            order_by = xd.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            xn, yn = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
            for at in range(0, len(y), 256):
                near = (y[at : at + 256] / yn[at : at + 256, None]) @ (x / xn[:, None]).T
                near[yi[at : at + 256, None] == xi[None]] = -9
                q, r = _best(near, k)  # then the same sum for every pair, so that copies tie
                s = (x[r] * y[at + q]).sum(axis=1) / (xn[r] * yn[at + q])
                order = np.lexsort((order_by[r], -s, q))
                q, r, s = q[order], r[order], s[order]
                keep = np.arange(len(q)) - np.searchsorted(q, np.arange(len(near)))[q] < k
                q, r = q[keep], r[keep]
                for a, v in zip(out, (pa.array(yi[at + q]), _take(yd, at + q), pa.array(xi[r]), _take(xd, r), pa.array(s[keep]))):
                    a.append(v)
        kinds = {"asker": pa.int64(), "query_id": pa.int64(), "row": pa.int64(), "id": pa.int64(), "score": pa.float64()}
        return pa.table({n: pa.chunked_array(a, t) for (n, t), a in zip(kinds.items(), out)})

    keys = ["list", "blocks", "asked"]
    found = cut(postings, "blocks", "asked").groupBy(*keys).cogroup(cut(probes, "asked", "blocks").groupBy(*keys)).applyInArrow(score, "asker long, query_id long, row long, id long, score double")
    best = Window.partitionBy("asker").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    top = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k * REPLICAS)  # each row at most REPLICAS times
    top = top.dropDuplicates(["asker", "row"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
    out = materialise(top, "ann")
    discard(rows, postings, probes)
    return out
