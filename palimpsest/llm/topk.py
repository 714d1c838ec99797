"""Exact top-k inner products by block-at-a-time pruning.

Rows are ordered by a locality key and cut into document-range blocks; each block keeps the largest and the smallest
value of every term (component). Blocks lie in superblocks, one binary row each: the forward index, written once, with the
superblocks' own maxima and minima as a small table. A query's bound on a block or superblock is the sum over its terms of the better of
weight times largest and weight times smallest.

A query's kth score starts from a bounded sample of rows, whose scores are real ones. It then goes to the superblock of its highest bound,
and with the kth score from there to the others whose bounds reach it: only such pairs are sent. In a superblock queries take blocks in the
order of bounds and score them from the forward index until no bound reaches the kth score so far. A superblock
meets up to SLAB queries in one task, so the index is sent once for each SLAB queries, and a query once for each superblock that it can't rule out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise
from .vectors import matrix, usable

BLOCK = 128
SUPER, LEAST_SUPER = 65_536, 4096
SLAB = 65_536
QUERIES = 256
GROUP = 16
SEED_ROWS = 1024
TOPS_BYTES = 1 << 26
PACKED = "n int, width int, own binary, ids binary, terms binary, high binary, low binary"
NO_ID, NO_FLOOR = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as integers; a term that no long holds is an error."""
    x = np.floor(x * scale)
    if len(x) and x.size and np.abs(x).max() >= 2.0**63:
        raise ValueError("a term leaves the range of a long")
    return x.astype(np.int64)


def small(terms: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest integer type that holds them."""
    for kind in (np.int8, np.int16, np.int32):
        if not terms.size or (terms.min() >= np.iinfo(kind).min and terms.max() <= np.iinfo(kind).max):
            return terms.astype(kind)
    return terms


def read(cells: list[bytes], rows: int, width: int) -> np.ndarray:
    """Rows of small() numbers as a matrix; a cell holds `rows` of them."""
    kinds = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}
    parts = [np.frombuffer(c, kinds[len(c) // (rows * width)] if rows * width else np.int8).reshape(rows, width) for c in cells]
    return np.concatenate(parts) if len(parts) != 1 else parts[0]


def kind_for(a: np.ndarray, b: np.ndarray):
    """In which numbers a sum of products is exact: doubles, longs, or whole numbers of any length."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    return np.float64 if most < 2**53 else np.int64 if most < 2**62 else object


def packed(rows: DataFrame, size: int, width: int, scale: float) -> DataFrame:
    """Rows (row, id, vec) as binary rows of up to `size` vectors, floor(scale * x) each, in the order they come."""

    def pack(own: np.ndarray, ids: np.ndarray, terms: np.ndarray) -> pa.RecordBatch:
        cells = [x.tobytes() for x in (own, ids, small(terms), terms.max(axis=0), terms.min(axis=0))]
        cols = [pa.array([len(ids)], pa.int32()), pa.array([width], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)]
        return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for b in batches:
            ids = b.column(1).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            held.append((b.column(0).to_numpy(zero_copy_only=False), ids, whole(matrix(b.column(2), width), scale)))
            n += b.num_rows
            if n >= size:
                own, ids, terms = (np.concatenate(x) for x in zip(*held))
                for at in range(0, n - n % size, size):
                    yield pack(own[at : at + size], ids[at : at + size], terms[at : at + size])
                held, n = [(own[n - n % size :], ids[n - n % size :], terms[n - n % size :])], n % size
        if n:
            yield pack(*(np.concatenate(x) for x in zip(*held)))

    return rows.select("row", "id", "vec").mapInArrow(run, PACKED)


def bounds_of(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """No score of a query with a row between low and high is larger. Infinite where doubles would not be exact."""
    if kind_for(queries, np.maximum(np.abs(high), np.abs(low))) is not np.float64:
        return np.full((len(queries), len(high)), np.inf)
    q = queries.astype(np.float64)
    return np.maximum(q, 0) @ high.T.astype(np.float64) + np.minimum(q, 0) @ low.T.astype(np.float64)


def best_rows(mine: np.ndarray, queries: np.ndarray, floors: np.ndarray, own: np.ndarray, ids: np.ndarray, terms: np.ndarray, k: int, block: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query (its place): the places and scores of its k best rows here that reach its floor, and the blocks scored.

    mine and own: numbers of the queries and rows; a row is no candidate of the query of its number. Ties go to the smaller id.
    """
    starts = np.arange(0, len(ids), block)
    ends = np.minimum(starts + block, len(ids))
    high, low = np.maximum.reduceat(terms, starts, axis=0).astype(np.int64), np.minimum.reduceat(terms, starts, axis=0).astype(np.int64)
    for at in range(0, len(queries), QUERIES):
        q, me, kth = queries[at : at + QUERIES], mine[at : at + QUERIES], floors[at : at + QUERIES].copy()
        kind = kind_for(q, terms)
        bounds, q = bounds_of(q, high, low), q.astype(kind)
        top = bounds.argmax(axis=1)  # each query's first block
        scored = np.zeros(len(q), np.int64)
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind))  # query, place, score; the k best of each

        def score(who: np.ndarray, which: np.ndarray, again: bool) -> None:
            """Queries `who` meet the blocks `which`; `again`: their first blocks have been scored."""
            nonlocal held
            rows = np.concatenate([np.arange(a, z) for a, z in zip(starts[which], ends[which])])
            got = q[who] @ terms[rows].T.astype(kind)
            new = (got >= kth[who, None]) & (own[rows][None] != me[who, None])
            if again:
                new &= (rows // block)[None] != top[who, None]
            i, j = np.nonzero(new)
            found = [np.concatenate(x) for x in zip(held, (who[i], rows[j], got[i, j]))]
            order = np.lexsort((ids[found[1]], -found[2], found[0]))
            found = [x[order] for x in found]
            place = np.arange(len(order)) - np.searchsorted(found[0], np.arange(len(q)))[found[0]]
            held = tuple(x[place < k] for x in found)
            if kind is object and any(not -(2**63) < x < 2**63 for x in held[2]):
                raise ValueError("a score leaves the range of a long")
            full = place == k - 1
            kth[found[0][full]] = np.maximum(kth[found[0][full]], found[2][full].astype(np.int64))
            scored[who] += len(which)

        for b in np.unique(top):
            if len(who := np.flatnonzero((top == b) & (bounds[:, b] >= kth))):
                score(who, np.array([b]), False)
        left = np.ones(bounds.shape, bool)
        left[np.arange(len(q)), top] = False
        order = np.argsort(-bounds.max(axis=0), kind="stable")
        for g in range(0, len(order), GROUP):
            some = order[g : g + GROUP]
            want = left[:, some] & (bounds[:, some] >= kth[:, None])
            if want.any():
                score(np.flatnonzero(want.any(axis=1)), some[want.any(axis=0)], True)
        cut = np.searchsorted(held[0], np.arange(len(q) + 1))
        for i in range(len(q)):
            yield at + i, held[1][cut[i] : cut[i + 1]], held[2][cut[i] : cut[i + 1]].astype(np.int64), int(scored[i])


def search_block(qids: np.ndarray, queries: np.ndarray, floors: np.ndarray, ids: np.ndarray, terms: np.ndarray, k: int, block: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """best_rows() for queries and rows that are told apart by their ids: ids in place of places; a floor of -inf is none."""
    floors = np.array([NO_FLOOR if f == -np.inf else int(f) for f in floors], np.int64)
    if len(ids):
        yield from ((int(qids[i]), ids[at], s, n) for i, at, s, n in best_rows(qids, queries, floors, ids, ids, terms, k, block))


def top_k(df: DataFrame, id_col: str, vec_col: str, is_query, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, id, score, blocks): for each row for which the column `is_query` holds, its k best other rows.

    Terms are floor(scale * x), x in double precision; the score is their integer inner product; ties go to the smaller
    id. Vectors that are null or hold null or non-finite components take no part; shorter ones are filled with zeros. Every other row is a
    candidate: rows that repeat an id stand for themselves, also as queries, and a null id is one like any other that loses all ties. A
    term or a score that leaves the range of a long is an error. No rows: no results. Other columns are ignored. Ids are integers.
    blocks: how many blocks were scored for the query in the superblock that the row came from.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("q")).where(usable("vec"))
    key = F.coalesce(F.array_position("vec", F.array_max("vec")) * 4096 + F.array_position("vec", F.array_min("vec")), F.lit(0))
    rows = materialise(rows.withColumns({"row": F.monotonically_increasing_id(), "key": key}), "topk-rows")
    total, asked, width = rows.agg(F.count(F.lit(1)), F.sum(F.col("q").cast("long")), F.max(F.size("vec"))).first()
    width = width or 0
    size = min(SUPER, max(LEAST_SUPER, math.ceil((total or 0) / (2 * spark.sparkContext.defaultParallelism))))
    ranged = rows.repartitionByRange(max(1, math.ceil((total or 0) / size)), "key", "id", "row").sortWithinPartitions("key", "id", "row")
    index = materialise(packed(ranged, size, width, scale).withColumn("part", F.monotonically_increasing_id()), "topk-index")
    sample = rows.where(F.pmod(F.xxhash64("row"), F.lit(max(1, (total or 0) // SEED_ROWS))) == 0).select("row", "vec").limit(2 * SEED_ROWS).toArrow()
    seed = spark.sparkContext.broadcast((np.asarray(sample["row"], np.int64), whole(matrix(sample["vec"], width), scale)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, terms = seed.value
        for b in batches:
            for at in range(0, b.num_rows, QUERIES):
                part = b.slice(at, QUERIES)
                me, q = part.column(0).to_numpy(zero_copy_only=False), whole(matrix(part.column(2), width), scale)
                kind = kind_for(q, terms)
                floors = np.full(len(q), NO_FLOOR)
                if len(own) > k and kind is not object:
                    got = (q.astype(kind) @ terms.T.astype(kind)).astype(np.int64)
                    got[own[None] == me[:, None]] = NO_FLOOR
                    floors = np.partition(got, -k, axis=1)[:, -k]
                cells = pa.array([x.tobytes() for x in small(q)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), cells, pa.array(floors)], names=["row", "id", "terms", "kth"])

    queries = materialise(rows.where("q").select("row", "id", "vec").mapInArrow(ask, "row long, id long, terms binary, kth long"), "topk-queries")
    parts = index.count()
    cuts = max(1, math.ceil(parts * 16 * width / TOPS_BYTES))  # the superblocks' maxima and minima go out in tables of a bounded size
    slabs = max(1, math.ceil((asked or 0) / SLAB))

    def pairs(asked: DataFrame, first: bool) -> DataFrame:
        """(row, id, terms, kth, part): each query with its first superblock, or with the others that its bounds don't rule out."""

        def one(cut: int) -> DataFrame:
            told = index.where(F.pmod(F.xxhash64("part"), F.lit(cuts)) == cut).orderBy("part").select("part", "high", "low").toArrow()
            tops = [np.frombuffer(b"".join(told[c].to_pylist()), np.int64).reshape(told.num_rows, width) for c in ("high", "low")]
            shared = spark.sparkContext.broadcast((np.asarray(told["part"], np.int64), *tops))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                numbers, high, low = shared.value
                for b in batches:
                    for at in range(0, b.num_rows if len(numbers) else 0, QUERIES):
                        some = b.slice(at, QUERIES)
                        q = np.concatenate([read([c], 1, width) for c in some.column(2).to_pylist()])
                        bounds = bounds_of(q, high, low)
                        want = bounds >= some.column(3).to_numpy(zero_copy_only=False)[:, None]
                        top = bounds.argmax(axis=1)
                        is_top = np.zeros(want.shape, bool)
                        is_top[np.arange(len(q)), top] = cut == 0
                        i, j = np.nonzero(want & (is_top if first else ~is_top))
                        yield pa.RecordBatch.from_arrays([*some.take(pa.array(i)).columns, pa.array(numbers[j])], names=["row", "id", "terms", "kth", "part"])

            return asked.select("row", "id", "terms", "kth").mapInArrow(run, "row long, id long, terms binary, kth long, part long")

        return reduce(DataFrame.unionByName, map(one, range(1 if first else cuts)))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(5)]
        if left.num_rows and right.num_rows:
            [r] = left.to_pylist()
            own, ids, terms = np.frombuffer(r["own"], np.int64), np.frombuffer(r["ids"], np.int64), read([r["terms"]], r["n"], width)
            me, qids = right["row"].to_numpy(), right["id"].to_pylist()
            q = np.concatenate([read([c], 1, width).astype(np.int64) for c in right["terms"].to_pylist()])
            for i, at, s, n in best_rows(me, q, right["kth"].to_numpy(), own, ids, terms, k):
                for o, v in zip(out, ([int(me[i])] * len(at), [qids[i]] * len(at), [None if x == NO_ID else int(x) for x in ids[at]], s.tolist(), [n] * len(at))):
                    o += v
        return pa.table({n: pa.array(o, pa.int64()) for n, o in zip(("row", "query_id", "id", "score", "blocks"), out)})

    def search(wanted: DataFrame, label: str) -> DataFrame:
        wanted = wanted.withColumn("slab", F.pmod(F.xxhash64("row"), F.lit(slabs)))
        kept = index.select("part", "n", "own", "ids", "terms", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slabs - 1).cast("long"))).alias("slab"))
        both = kept.groupBy("part", "slab").cogroup(wanted.groupBy("part", "slab"))
        return materialise(both.applyInArrow(lambda a, b: score(a, b), "row long, query_id long, id long, score long, blocks long"), label)

    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    early = search(pairs(queries, True), "topk-early")
    raised = early.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select(F.col("row").alias("r"), "least")
    later = queries.join(raised, F.col("row") == F.col("r"), "left").select("row", "id", "terms", F.greatest("kth", F.coalesce("least", "kth")).alias("kth"))
    found = early.unionByName(search(pairs(later, False), "topk-late"))
    out = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score", "blocks")
    out = materialise(out, "topk")
    discard(rows, index, queries, early)
    return out
