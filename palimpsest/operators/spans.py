"""Chunks, detectors, the indexed text and the way from text offsets to boxes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import blank_trim, category
from ..functions.text import valid_item

CHUNK = 1000
THRESHOLD = 0.3
PAD = 2.0

#: The rule detector's patterns; each is in the common subset of Java's and RE2's syntax.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "phone_number": r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "credit_card": r"\b[0-9]{16}\b",
    "ip_address": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
}


def chunks(df: DataFrame, size: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_idx, chunk_offset, chunk): overlapping pieces; neighbours share min(200, size // 10) characters.

    An empty text has one empty chunk; so has a null one.
    """
    step = size - min(200, size // 10)
    text = F.coalesce(F.col(text_col), F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    at = df.select(id_col, text.alias("t"), F.posexplode(starts).alias("chunk_idx", "chunk_offset"))
    return at.select(id_col, "chunk_idx", "chunk_offset", F.col("t").substr(F.col("chunk_offset") + 1, F.lit(size)).alias("chunk"))


#: A character that each match of a pattern holds: texts without it skip the pattern.
NEEDS = {PATTERNS["email"]: "@", PATTERNS["phone_number"]: "(", PATTERNS["ssn"]: "-", PATTERNS["ip_address"]: "."}


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of a pattern's matches: each starts behind all pieces and matches before it."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("hit"))
    found = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def step(acc: Column, x: Column) -> Column:  # carries the end of the last match
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("text")))).alias("found"))

    placed = F.aggregate(F.filter(both, lambda x: x["hit"].isNotNull()), F.struct(F.lit(0).alias("at"), found.alias("found")), step, lambda acc: acc["found"])
    there = text.rlike(pattern)
    return F.when(F.contains(text, F.lit(NEEDS[pattern])) & there if pattern in NEEDS else there, placed).otherwise(found)


def detect_rules(chunked: DataFrame, patterns: dict[str, str] = PATTERNS, id_col: str = "doc_id") -> DataFrame:
    """(id, chunk_idx, chunk_offset, ent_idx, start, end, label, text, score): rule matches, built-in functions only."""

    def labelled(label: str, pattern: str) -> Column:
        return F.transform(matches(F.col("chunk"), pattern), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(label).alias("label"), m["text"].alias("text")))

    ordered = F.array_sort(F.concat(*[labelled(label, p) for label, p in patterns.items()]))
    # the outer form: for the inner one a filter on the list's size is inferred, which would find all matches twice
    rows = chunked.select(id_col, "chunk_idx", "chunk_offset", F.posexplode_outer(ordered).alias("ent_idx", "e")).where("e is not null")
    return rows.select(id_col, "chunk_idx", "chunk_offset", "ent_idx", "e.*", F.lit(1.0).alias("score"))


def detect_model(chunked: DataFrame, load: Callable[[], Callable[[list[str]], list[list[dict]]]], id_col: str = "doc_id") -> DataFrame:
    """The same columns from a model: `load` runs once in each Python worker and gives a function from texts to entities."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            rows = []
            for key, found in zip(zip(b[id_col], b["chunk_idx"], b["chunk_offset"]), model(b["chunk"].tolist())):
                rows += [(*key, i, e.get("start"), e.get("end"), e.get("label"), e.get("text"), e.get("score")) for i, e in enumerate(found)]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_idx", "chunk_offset", "ent_idx", "start", "end", "label", "text", "score"])

    return chunked.mapInPandas(run, f"{id_col} {chunked.schema[id_col].dataType.simpleString()}, chunk_idx int, chunk_offset int, ent_idx int, start int, end int, label string, text string, score double")


def rebase(entities: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Document offsets g_start and g_end for complete entities that reach the threshold; label and text cleaned."""
    label, text = F.lower(blank_trim(F.coalesce("label", F.lit("")))), blank_trim(F.coalesce("text", F.lit("")))
    whole = entities.withColumns({"label": label, "text": text}).where("start is not null and end is not null and label <> '' and text <> ''")
    kept = whole.where((F.col("score") >= threshold) | F.col("score").isNull())
    return kept.withColumns({"g_start": F.col("chunk_offset") + F.col("start"), "g_end": F.col("chunk_offset") + F.col("end")})


def first_seen(entities: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each (g_start, g_end, label) of a document: the first by chunk, then by the detector's order.

    A partial aggregate, so repeats in chunk overlaps meet before the shuffle.
    """
    rest = [c for c in entities.columns if c not in (id_col, "g_start", "g_end", "label", "chunk_idx", "ent_idx")]
    first = F.min(F.struct("chunk_idx", "ent_idx", *rest)).alias("f")
    return entities.groupBy(id_col, "g_start", "g_end", "label").agg(first).select(id_col, "g_start", "g_end", "label", "f.*")


def entities(df: DataFrame, size: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return first_seen(rebase(detect_rules(chunks(df, size, id_col, text_col), id_col=id_col)), id_col)


def items(found: DataFrame) -> DataFrame:
    """type and value of entities that can be what they claim."""
    return found.withColumns({"type": category(F.col("label")), "value": F.col("text")}).where(valid_item(F.col("type"), F.col("value")))


# The synthetic layout: a document's lines are lines, its words stand in cells of 6 by 10 points, PAGE_LINES lines a page.
PAGE_LINES, CELL, LINE_HEIGHT, PAGE_WIDTH, PAGE_HEIGHT = 40, 6.0, 12.0, 612.0, 792.0


def layout_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, page_num, line_no, word_idx, text, x0, y0, x1, y1, line_idx, char_start, char_end) of plain texts, in their layout.

    Places are running sums over a text, which lies in one row: so they are made there, a batch of texts at a time in numpy,
    and no word is shuffled for them. index_words() gives the same offsets for words that come as rows. Null texts have no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = [t or "" for t in b.column(1).to_pylist()]
                yield _laid_out(b.column(0), texts, id_col)

    kept = df.select(id_col, F.col(text_col).cast("string"))
    ddl = f"`{id_col}` {kept.schema[0].dataType.simpleString()}, page_num int, line_no int, word_idx int, text string, x0 double, y0 double, x1 double, y1 double, line_idx int, char_start int, char_end int"
    return kept.mapInArrow(run, ddl)


def layout_pages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, page_num): the pages of layout_words(), from the texts' lines alone: a page is there if a line of it has a word."""
    # the outer form: for the inner one a filter on the list's size is inferred, which would split twice
    lines = df.select(id_col, F.posexplode_outer(F.split(F.col(text_col).cast("string"), "\n", -1)).alias("raw_line", "line")).where(F.trim("line") != "")
    return lines.select(id_col, (F.floor(F.col("raw_line") / PAGE_LINES) + 1).cast("int").alias("page_num")).distinct()


def _laid_out(ids: pa.Array, texts: list[str], id_col: str) -> pa.RecordBatch:
    raw = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass") + b"\n\x00\x00\x00", np.uint32)
    utf8 = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
    gap, newline = (raw == 32) | (raw == 10), raw == 10
    starts = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    length = np.flatnonzero(gap & ~np.r_[True, gap[:-1]]) - starts
    doc_start = np.cumsum([0, *(len(t) + 1 for t in texts)])
    doc = np.searchsorted(doc_start, starts, side="right") - 1
    lines = np.cumsum(newline)  # newlines up to and with each place
    line_begin = np.r_[0, np.flatnonzero(newline) + 1]
    line = lines[starts]
    col = starts - line_begin[line]
    raw_line = line - np.r_[0, lines][doc_start[doc]]
    new_doc = np.r_[True, doc[1:] != doc[:-1]][: len(doc)]
    new_line = new_doc | np.r_[True, line[1:] != line[:-1]][: len(doc)]
    page = raw_line // PAGE_LINES + 1
    new_page = new_doc | np.r_[True, page[1:] != page[:-1]][: len(doc)]
    header = 8 + np.floor(np.log10(page)).astype(np.int64) + 1
    before = np.where(new_doc, header, np.where(new_page, header + 2, 1))
    end = np.cumsum(before + length)
    place = np.arange(len(doc))
    first = lambda flag: np.maximum.accumulate(np.where(flag, place, 0))
    d = first(new_doc)
    char_end = end - (end[d] - (before + length)[d]) if len(doc) else end
    seen = np.cumsum(new_line)
    line_idx = seen - seen[d] if len(doc) else seen
    # the words' bytes are the text's bytes without the (one-byte) gaps
    size = np.where(raw < 0x80, 1, np.where(raw < 0x800, 2, np.where(raw < 0x10000, 3, 4)))
    ends = np.r_[0, np.cumsum(size)]
    offsets = np.r_[0, np.cumsum(ends[starts + length] - ends[starts])].astype(np.int32)
    data = utf8[(utf8 != 32) & (utf8 != 10)]
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))
    top = PAGE_HEIGHT - LINE_HEIGHT * (raw_line % PAGE_LINES)
    ints = lambda x: pa.array(x.astype(np.int32))
    cols = [ids.take(pa.array(doc)), ints(page), ints(raw_line % PAGE_LINES), ints(place - first(new_line)), words, pa.array(col * CELL), pa.array(top - 10.0), pa.array((col + length) * CELL), pa.array(top * 1.0), ints(line_idx), ints(char_end - length), ints(char_end)]
    return pa.RecordBatch.from_arrays(cols, names=[id_col, "page_num", "line_no", "word_idx", "text", "x0", "y0", "x1", "y1", "line_idx", "char_start", "char_end"])


def layout_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): what indexed_text() gives for the words of layout_words(), made from each text in place. Texts without words are left out."""

    def one(text: str) -> str:
        pages: dict[int, list[str]] = {}
        for i, line in enumerate(text.split("\n")):
            if words := [w for w in line.split(" ") if w]:
                pages.setdefault(i // PAGE_LINES + 1, []).append(" ".join(words))
        return "\n\n".join(f"[Page {n}]\n" + "\n".join(lines) for n, lines in pages.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = [one(t or "") for t in b.column(1).to_pylist()]
                made = pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])
                yield made.filter(pa.array([bool(t) for t in texts], pa.bool_()))

    kept = df.select(id_col, F.col(text_col).cast("string"))
    return kept.mapInArrow(run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, text string")


def index_words(words: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """words with line_idx (over all pages) and their half-open range [char_start, char_end) in the indexed text.

    The text has a `[Page N]` line before each page's lines and an empty line between pages; words are joined by a space.
    All windows are over one document in one order: a single shuffle by the document.
    """
    order = Window.partitionBy(id_col).orderBy("page_num", "line_no", "word_idx")
    page, line = (F.lag(c).over(order) for c in ("page_num", "line_no"))
    new_page = page.isNull() | (page != F.col("page_num"))
    new_line = new_page | (line != F.col("line_no"))
    header = F.length(F.concat(F.lit("[Page "), F.col("page_num").cast("string"), F.lit("]\n")))
    gap = F.when(new_page, header + F.when(page.isNull(), 0).otherwise(2)).otherwise(1)
    marked = words.withColumns({"gap": gap, "line_step": new_line.cast("int")})
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("text")).over(so_far)
    placed = marked.withColumns({"char_end": end.cast("int"), "line_idx": (F.sum("line_step").over(so_far) - 1).cast("int")})
    return placed.withColumn("char_start", F.col("char_end") - F.length("text")).drop("gap", "line_step")


def indexed_text(words: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text): the text that index_words() describes."""
    lines = words.groupBy(id_col, "page_num", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda w: w["text"]), " ").alias("line"))
    pages = lines.groupBy(id_col, "page_num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda w: w["line"]), "\n").alias("body"))
    body = F.concat(F.lit("[Page "), F.col("page_num").cast("string"), F.lit("]\n"), F.col("body"))
    whole = pages.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("page_num", body.alias("body")))).alias("p"))
    return whole.select(id_col, F.array_join(F.transform("p", lambda p: p["body"]), "\n\n").alias("text"))


REACH = 4096


def resolve(found: DataFrame, indexed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """found ⋈ words on overlapping ranges: one box for each entity and line.

    Partly covered words are cut in proportion to their characters; boxes are padded by PAD at the left and the right. Entities
    that touch no word are dropped. The keys are the document and a stretch of REACH characters; what overlaps in more stretches than one
    counts in that of the overlap's first character. So a long document's words meet the entities near them only.
    """
    stretches = lambda a, z: F.sequence(F.floor(F.col(a) / REACH), F.floor((F.col(z) - 1) / REACH))
    e = found.where("g_end > g_start").select(F.col(id_col).alias("e_id"), *[F.col(c) for c in ("g_start", "g_end", "label")], F.col("text").alias("value"), F.explode(stretches("g_start", "g_end")).alias("e_part"))
    words = indexed.where("char_end > char_start").withColumn("w_part", F.explode(stretches("char_start", "char_end")))
    near = e.join(words, (F.col("e_id") == F.col(id_col)) & (F.col("e_part") == F.col("w_part")) & (F.col("char_start") < F.col("g_end")) & (F.col("char_end") > F.col("g_start")))
    near = near.where(F.floor(F.greatest("g_start", "char_start") / REACH) == F.col("e_part"))
    n = F.col("char_end") - F.col("char_start")
    low = F.greatest("g_start", "char_start") - F.col("char_start")
    high = F.least("g_end", "char_end") - F.col("char_start")
    whole = (low == 0) & (high == n)
    width = F.col("x1") - F.col("x0")
    cut = near.withColumns({"sx0": F.when(whole, F.col("x0")).otherwise(F.col("x0") + low / n * width), "sx1": F.when(whole, F.col("x1")).otherwise(F.col("x0") + high / n * width)})
    boxes = cut.groupBy(id_col, "g_start", "g_end", "label", "value", "page_num", "line_idx").agg(
        (F.min("sx0") - PAD).alias("x0"), F.min("y0").alias("y0"), (F.max("sx1") + PAD).alias("x1"), F.max("y1").alias("y1")
    )
    return boxes
