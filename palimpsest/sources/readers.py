"""Readers with explicit schemas."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import IDENTIFIER_TYPES, blank_trim, custom_type

REQUEST = "cmd string, path string, output string, color string, selected array<string>, options struct<chunk_size: int, ocr_dpi: int, debug_full_text: boolean>"
SERVE_EVENT = (
    "cmd string, phase string, status string, kind string, message string, page int, total int, chunk int, page_num int, image_path string, "
    "item struct<type: string, value: string>, pii array<struct<type: string, value: string, occurrences: long>>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, raw) of text lines; line numbers count within a file's split."""
    rows = spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
    return rows.select("file", F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("raw"))


def without_blank(lines: DataFrame) -> DataFrame:
    return lines.where(blank_trim(F.col("raw")) != "")


def ndjson(lines: DataFrame, schema: str) -> DataFrame:
    """lines with `parsed` (null where a line is not a JSON object) and `diverted`."""
    parsed = F.from_json("raw", schema, {"mode": "PERMISSIVE"})
    shaped = blank_trim(F.col("raw")).rlike(r"(?s)^\{.*\}$") & F.get_json_object("raw", "$").isNotNull()
    return without_blank(lines).withColumn("parsed", F.when(shaped, parsed)).withColumn("diverted", F.col("parsed").isNull())


def requests(lines: DataFrame) -> DataFrame:
    """One row a request line: cmd, and `error` for broken lines and unknown commands; the loop goes on after those."""
    rows = ndjson(lines, REQUEST)
    known = F.coalesce(F.col("parsed.cmd").isin("detect", "scrub", "close"), F.lit(False))
    error = F.when(F.col("diverted"), "invalid JSON").when(~known, "unknown cmd")
    return rows.select("line_no", "parsed.cmd", "parsed.path", error.alias("error"))


def pdf_files(files: DataFrame, col: str = "path") -> DataFrame:
    """Picked or dropped files that end in .pdf, in any case."""
    return files.where(F.lower(col).endswith(".pdf"))


def read_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modificationTime, content) of a folder's PDF files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(folder)


SCANNED = "doc_id long, page_num int, line_no int, width int, height double, words array<string>, polygons array<array<struct<x: double, y: double>>>, score string"


def scan_pages(files: DataFrame, load: Callable[[], Callable[[bytes, float], Iterable[dict]]], dpi: float = 300.0) -> DataFrame:
    """The recognised lines (SCANNED) of files (doc_id, content), as ocr_words() takes them, from a renderer and recogniser of the caller's.

    `load` runs once in each Python worker. What it gives is called with a file's bytes and the scale dpi / 72 and yields one page after another:
    page_num, width, height, and lines of words, polygons and score. A page is passed on before the next is rendered.
    """
    names = [f.split()[0] for f in ("doc_id", "page_num", "line_no", "width", "height", "words", "polygons", "score")]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = load()
        for b in batches:
            for doc_id, content in zip(b["doc_id"], b["content"]):
                for page in read(bytes(content), dpi / 72.0):
                    rows = [(doc_id, page["page_num"], i, page["width"], page["height"], ln["words"], ln["polygons"], ln["score"]) for i, ln in enumerate(page["lines"])]
                    yield pd.DataFrame(rows, columns=names)

    return files.select("doc_id", "content").mapInPandas(run, SCANNED)


def identifiers(rows: DataFrame) -> DataFrame:
    """(row_id, seq, type, value) of saved identifier lists: `entries` holds strings or (type, value); blanks go, unknown types are `other`."""
    each = rows.select("row_id", F.posexplode("entries").alias("seq", "e"))
    value = blank_trim(F.col("e.value"))
    kind = F.when(F.col("e.type").isin(IDENTIFIER_TYPES), F.col("e.type")).otherwise("other")
    return each.select("row_id", "seq", kind.alias("type"), value.alias("value")).where("value <> ''")


def clean_custom(rows: DataFrame) -> DataFrame:
    """(value, type) of a request's custom list: trimmed, nulls and blanks dropped, types normalised."""
    return rows.select(blank_trim(F.col("value")).alias("value"), custom_type(F.col("type")).alias("type")).where("value <> ''")


def sampled(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows in a shuffled order, which is that of a hash of their key: the same rows on each run. Each task keeps its own first n; nothing is sorted as a whole."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)


#: The phase whose `done` ends each command.
TERMINAL_PHASE = {"detect": "analyze", "scrub": "redact"}


def terminal(cmd, phase, status):
    """Whether an event ends its command: an error, or done in the command's last phase."""
    last = F.lit(False)
    for c, p in TERMINAL_PHASE.items():
        last = last | ((cmd == c) & (phase == p))
    return F.coalesce((status == "error") | ((status == "done") & last), F.lit(False))


def progress(events: DataFrame) -> DataFrame:
    """(doc_id, phase, done, total): how far each document's phases have come."""
    return events.groupBy("doc_id", "phase").agg(F.max(F.coalesce("page", "chunk")).alias("done"), F.max("total").alias("total"))
