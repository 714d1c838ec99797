"""Writers and the documents they write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import category_rank


def detection_json(found: DataFrame, model: str) -> DataFrame:
    """(file, json): one document for each file of rows (file, type, value, occurrences), items in display order."""
    item = F.struct(category_rank(F.col("type")).alias("r"), "value", "type", "occurrences")
    body = found.groupBy("file").agg(F.count(F.lit(1)).alias("total_pii_detected"), F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["value"].alias("value"), x["type"].alias("type"), x["occurrences"].alias("occurrences"))).alias("pii"))
    return body.select("file", F.to_json(F.struct("file", F.lit(model).alias("model"), "total_pii_detected", "pii")).alias("json"))


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def rewrite(df: DataFrame, path: str) -> None:
    """Write df next to `path` and put it in its place; df may read from `path`."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = f"{path}.partial", f"{path}.old"
    df.write.mode("overwrite").json(new)
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    at = {p: jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, old)}
    if fs.exists(at[path]):
        fs.rename(at[path], at[old])
    fs.rename(at[new], at[path])
    fs.delete(at[old], True)


def chunk_dump(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, dump): all chunks of a document, each under a rule of 80 equals signs."""
    part = F.concat(F.lit("=" * 80 + "\n"), F.format_string("chunk %d (offset %d)\n", F.col("chunk_idx") + 1, "chunk_offset"), F.lit("=" * 80 + "\n"), F.col("chunk"))
    parts = F.array_sort(F.collect_list(F.struct("chunk_idx", part.alias("p"))))
    return chunks.groupBy(id_col).agg(F.array_join(F.transform(parts, lambda x: x["p"]), "\n").alias("dump"))


def ppm(width: Column, height: Column, pixels: Column) -> Column:
    """A page's RGB pixels as the bytes of a PPM file."""
    return F.concat(F.format_string("P6\n%d %d\n255\n", width, height).cast("binary"), pixels)
