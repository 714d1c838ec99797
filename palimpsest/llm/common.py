"""Connected components; tables in the cluster's shared folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Scratch, discard, materialise, prefix, shared_dir

__all__ = ["Scratch", "connected_components", "discard", "lean", "materialise", "prefix", "shared_dir"]

Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A task's function that gives its worker's free memory back at the end: idle workers wait for more work and count against their executor."""

    def wrapped(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every node of the undirected edges (u, v); component is the smallest node reachable.

    Alternating large-star and small-star steps: each keeps at most as many edges as it was given, so hubs never
    square. Rounds grow with the logarithm of the longest chain; each is written to the shared folder. Nothing but
    a count and a checksum reaches the driver. The result reads a table, which is left to `scratch`. No edges: no rows. Loops (u = u) are ignored.
    """

    def large(e: DataFrame) -> tuple[DataFrame, DataFrame]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).select(F.col("u").alias("c"), "m")
        low = materialise(low, "low")  # a table on either side: a hub's rows can then be split in the join
        return both.join(low, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), low

    def small(e: DataFrame) -> tuple[DataFrame, DataFrame]:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        low = materialise(low, "low")
        rest = down.join(low, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return rest.unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v"))), low

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    def step(e: DataFrame, make) -> DataFrame:
        """The next edges, written; those that they came of go."""
        made, low = make(e)
        out = materialise(made.where("u <> v").distinct(), "stars")
        discard(e, low)
        return out

    now = materialise(edges.select("u", "v").where("u <> v").distinct(), "edges")
    seen = state(now)
    while seen[0]:
        now = step(step(now, large), small)
        if seen == (seen := state(now)):
            break
    if scratch:
        scratch.tables.append(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
