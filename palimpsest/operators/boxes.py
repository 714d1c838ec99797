"""Suppression, dedupe, aggregation and redaction of located values."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import mostly_inside, pixels
from ..functions.labels import blank_trim, category_rank, display_type

BOX = ["x0", "y0", "x1", "y1"]


def suppress(hits: DataFrame, custom: DataFrame) -> DataFrame:
    """Hits that do not lie mostly in a custom box of the same page."""
    s = custom.select(F.col("doc_id").alias("s_doc"), F.col("page_num").alias("s_page"), *[F.col(c).alias(f"s_{c}") for c in BOX])
    inside = mostly_inside("", "s_")
    return hits.join(s, (F.col("doc_id") == F.col("s_doc")) & (F.col("page_num") == F.col("s_page")) & inside, "left_anti")


def tenths(c: str) -> Column:
    """A coordinate as whole tenths of a point, the key boxes are compared by."""
    return F.floor(F.col(c) * 10 + 0.5).cast("long")


def dedupe(boxes: DataFrame, order: list[str]) -> DataFrame:
    """The first box (by `order`) of each value, page and place to a tenth of a point; the type is no part of the key."""
    rest = [c for c in boxes.columns if c not in ("doc_id", "value", "page_num", *order)]
    keys = [tenths(c).alias(f"k_{c}") for c in BOX]
    first = boxes.groupBy("doc_id", "value", "page_num", *keys).agg(F.min(F.struct(*order, *rest)).alias("f"))
    return first.select("doc_id", "value", "page_num", "f.*").select(*boxes.columns)


def aggregate(items: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(type, value, occurrences) of items (type, value): blank values go, unknown types are `other`. `within`: columns to count apart, such as the document."""
    rows = items.select(*within, display_type(F.col("type")).alias("type"), blank_trim(F.coalesce("value", F.lit(""))).alias("value"))
    return rows.where("value <> ''").groupBy(*within, "type", "value").agg(F.count(F.lit(1)).alias("occurrences"))


def in_display_order(found: DataFrame) -> DataFrame:
    return found.orderBy(category_rank(F.col("type")), "value")


def attach_boxes(found: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each (doc_id, type, value) with all boxes of the value in its document, whatever their type, in reading order: a list bounded by the document."""
    per_value = boxes.groupBy("doc_id", "value").agg(F.array_sort(F.collect_list(F.struct("page_num", *BOX))).alias("bboxes"))
    return found.join(per_value, ["doc_id", "value"], "left").withColumn("bboxes", F.coalesce("bboxes", F.expr("filter(array(struct(0 AS page_num, 0D AS x0, 0D AS y0, 0D AS x1, 0D AS y1)), b -> false)")))


def rectangles(selected: DataFrame, boxes: DataFrame, scale: float, height: float) -> DataFrame:
    """Pixel rectangles of the selected values; a value selected twice is drawn twice."""
    chosen = selected.select(blank_trim(F.col("value")).alias("value")).where("value <> ''")
    return chosen.join(boxes, "value").select("doc_id", "page_num", "value", *pixels(scale, F.lit(height)))


def paint(pages: DataFrame, rects: DataFrame, color: str = "#000000") -> DataFrame:
    """pages with filled rectangles on their pixels, and `painted`, how many pixels those cover.

    pages: (doc_id, page_num, width, height, pixels), pixels being rows of RGB bytes; rects: (doc_id, page_num, x, y, w, h) in pixels. A
    rectangle covers the pixels of both its corners and what lies between. Pages without rectangles stay as they are, and no Python
    worker sees them; rectangles of unknown pages and parts outside the page go. Pages are painted one by one.
    """
    rgb = np.frombuffer(bytes.fromhex(color[1:]), np.uint8)
    ddl = "doc_id long, page_num int, width int, height int, pixels binary, painted long"
    shape = pa.schema([("doc_id", pa.int64()), ("page_num", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("painted", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                doc, page, width, height, pixels, marks = (c[i].as_py() for c in b.columns)
                image = np.frombuffer(pixels, np.uint8).reshape(height, width, 3).copy()
                covered = np.zeros(image.shape[:2], bool)
                for m in marks:
                    left, top, right, bottom = (max(0, math.floor(v)) for v in (m["x"], m["y"], m["x"] + m["w"] + 1, m["y"] + m["h"] + 1))
                    covered[top:bottom, left:right] = True
                image[covered] = rgb
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((doc, page, width, height, image.tobytes(), int(covered.sum())), shape)], schema=shape)

    marks = rects.groupBy(F.col("doc_id").alias("m_doc"), F.col("page_num").alias("m_page")).agg(F.collect_list(F.struct("x", "y", "w", "h")).alias("marks"))
    plain = pages.select(F.col("doc_id").cast("long"), F.col("page_num").cast("int"), F.col("width").cast("int"), F.col("height").cast("int"), "pixels")
    own = F.col("doc_id").eqNullSafe(F.col("m_doc")) & F.col("page_num").eqNullSafe(F.col("m_page"))
    painted = plain.join(marks, own).drop("m_doc", "m_page").mapInArrow(run, ddl)
    return painted.unionByName(plain.join(marks, own, "left_anti").withColumn("painted", F.lit(0).cast("long")))


def untouched(docs: DataFrame, rects: DataFrame) -> DataFrame:
    """Documents without rectangles, which pass through as they are."""
    return docs.join(rects.select("doc_id").distinct(), "doc_id", "left_anti")


def mask(text: Column, patterns: dict[str, str], how: str = "replace", token: str = "<ANONYMIZED>") -> Column:
    """Matches replaced by a token, masked by asterisks from the end (12 at most), redacted or hashed."""
    def cut(t: Column, p: str) -> Column:
        if how in ("replace", "redact"):
            return F.regexp_replace(t, p, token if how == "replace" else "")
        hit = lambda m: F.sha2(m, 256) if how == "hash" else F.concat(m.substr(F.lit(1), F.greatest(F.length(m) - 12, F.lit(0))), F.repeat(F.lit("*"), F.least(F.length(m), F.lit(12))))
        hits = F.transform(F.regexp_extract_all(t, F.lit(p), 0), hit)
        pieces = F.split(t, p, -1)
        joined = F.array_join(F.transform(F.arrays_zip(pieces.alias("piece"), hits.alias("hit")), lambda x: F.concat(x["piece"], F.coalesce(x["hit"], F.lit("")))), "")
        return F.when(t.rlike(p), joined).otherwise(t)

    for p in patterns.values():
        # bound in a lambda, so that each step's text is worked out once and not once for each use
        text = F.get(F.transform(F.array(text), _bind(cut, p)), 0)
    return text


def _bind(f, p: str):
    return lambda t: f(t, p)


def deny_list(text: Column, words: list[str], token: str = "") -> Column:
    """Whole words of a list replaced by a token."""
    escaped = "|".join(w.replace(".", r"\.") for w in sorted(words, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?<![A-Za-z0-9_])({escaped})(?![A-Za-z0-9_])", token)


def ui_groups(items: DataFrame) -> DataFrame:
    """(doc_id, type, place, value, count, n_items, total): each document's items by count then first seen within their type, one row each.

    items: (doc_id, type, value, count, seq). Nothing is gathered beyond one document's items of a type.
    """
    group = Window.partitionBy("doc_id", "type")
    place = F.row_number().over(group.orderBy(F.desc("count"), "seq", "value"))
    return items.select("doc_id", "type", place.alias("place"), "value", "count", F.count(F.lit(1)).over(group).alias("n_items"), F.sum("count").over(group).alias("total"))


def reading_order(boxes: DataFrame) -> DataFrame:
    """Boxes (doc_id, type, value, page_num, x, y, ...) with `place`: from page to page, top to bottom, left to right, within a document's value."""
    order = Window.partitionBy("doc_id", "type", "value").orderBy("page_num", "y", "x")
    return boxes.withColumn("place", F.row_number().over(order))
