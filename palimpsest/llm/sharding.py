"""Sharding by extendible hashing, with DataFrame functions only.

A row's key is hashed to bits. The directory is indexed by the hash's first bits: a bucket that holds more than the byte
limit splits on one more bit, the others stay, until every shard fits. Buckets are split a few bits at a time from
partial sums over cells (rows of one hash prefix), so rows themselves are never gathered. Rows that share all 60 bits of
the key's hash (a hot key) split further on 60 bits of a row number's hash. A shard above the limit holds a single row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, discard, materialise, prefix

BITS = 60
ROUND = 4


def hash_bits(text: Column) -> Column:
    """The first 60 bits of a string's MD5 as a long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _directory(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """The directory within each outer bucket (one, but for hot keys)."""
    cell = F.expr(f"shiftright(h, {BITS - high})")
    cells = rows.groupBy("outer", cell.alias("c")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))
    paths = cells.select("outer", "c", "b", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn("prefix", F.expr(f"c div cast(pow(2, {high} - depth) as bigint)"))
    sums = paths.groupBy("outer", "depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    done = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)
    kept = sums.withColumn("fits", done).where(F.col("fits") | (F.col("depth") == high))
    found = paths.select("outer", "c", "depth", "prefix").join(kept, ["outer", "depth", "prefix"])
    return found.groupBy("outer", "c").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows", "fits")).alias("s")).select("outer", "c", "s.*")


def shards(df: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(id_col, n_bytes, depth, prefix, shard_bytes, shard_rows) for every row; (depth, prefix) names its shard. With row_col that column too, which tells rows apart.

    n_bytes: the text's UTF-8 bytes, null as 0. Depths above 60 count bits of the row number's hash; `prefix` then holds
    both parts, joined by a dot, otherwise the hash's first bits as a number. Repeated rows and rows whose id is null (one key)
    are spread like any hot key. An empty table gives no rows; other columns are ignored.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    scratch = Scratch()
    slim = scratch.keep(df.select(F.col(id_col).alias("id"), (F.col(row_col) if row_col else F.lit(0)).cast("long").alias("row"), size.alias("bytes"), hash_bits(F.coalesce(F.col(id_col).cast("string"), F.lit("\x00null"))).alias("h")), "shard-rows")
    total = slim.agg(F.sum("bytes")).first()[0] or 0
    low, high, out = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 3), []
    open_rows, word = slim.withColumn("outer", F.lit("")), 0
    while True:
        found = scratch.keep(_directory(open_rows, low, high, limit), "shard-directory")
        placed = open_rows.withColumn("cell", F.expr(f"shiftright(h, {BITS - high})")).join(found.withColumnRenamed("outer", "o"), (F.col("cell") == F.col("c")) & (F.col("outer") == F.col("o")))
        out.append(placed.where("fits").select("id", "row", "bytes", (F.col("depth") + word * BITS).alias("depth"), F.concat("outer", F.col("prefix").cast("string")).alias("prefix"), "shard_bytes", "shard_rows"))
        if found.where("not fits").isEmpty():
            break
        rest = placed.where("not fits")
        if high == BITS:
            rest = rest.select("id", "row", "bytes", hash_bits(F.monotonically_increasing_id().cast("string")).alias("h"), F.concat("outer", F.col("prefix").cast("string"), F.lit(".")).alias("outer"))
            low, high, word = 1, ROUND, word + 1
        else:
            rest = rest.select("id", "row", "bytes", "h", "outer")
            low, high = high + 1, min(BITS, high + ROUND)
        open_rows = scratch.keep(rest, "shard-open")
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    result = result.select(F.col("id").alias(id_col), *([F.col("row").alias(row_col)] if row_col else []), F.col("bytes").alias("n_bytes"), F.col("depth").cast("int").alias("depth"), "prefix", "shard_bytes", "shard_rows")
    return scratch.result(result, "shards")


def write_shards(df: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every row of df as Parquet with a folder for each shard, rows with null and repeated ids too; a column shard is replaced."""
    own = prefix(df, "__shard")
    row, named = f"{own}_row", f"{own}_named"
    rows = materialise(df.drop("shard").withColumn(row, F.monotonically_increasing_id()), "shard-texts")
    names = shards(rows, limit, id_col, text_col, row).select(F.col(row).alias(named), F.concat_ws("-", "depth", "prefix").alias("shard"))
    rows.join(names, F.col(row) == F.col(named)).drop(row, named).repartition("shard").write.partitionBy("shard").parquet(path)
    discard(rows)
