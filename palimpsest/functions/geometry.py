"""Boxes as struct<x0, y0, x1, y1>, origin bottom left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mostly_inside(inner: str, outer: str, share: float = 0.5) -> Column:
    """Whether at least `share` of the inner box's area lies in the outer one; columns are <prefix>x0 and so on."""
    i, o = ({k: F.col(f"{p}{k}") for k in ("x0", "y0", "x1", "y1")} for p in (inner, outer))
    w = F.least(i["x1"], o["x1"]) - F.greatest(i["x0"], o["x0"])
    h = F.least(i["y1"], o["y1"]) - F.greatest(i["y0"], o["y0"])
    area = (i["x1"] - i["x0"]) * (i["y1"] - i["y0"])
    return (w > 0) & (h > 0) & (area > 0) & (w * h >= area * share)


def pixels(scale: float, height: Column) -> list[Column]:
    """x, y, w, h in pixels, origin top left."""
    c = F.col
    return [(c("x0") * scale).alias("x"), ((height - c("y1")) * scale).alias("y"), ((c("x1") - c("x0")) * scale).alias("w"), ((c("y1") - c("y0")) * scale).alias("h")]


def page_pixels(boxes: DataFrame, pages: DataFrame, scale: float) -> DataFrame:
    """boxes with x, y, w, h in pixels by the height of their own page; pages: (doc_id, page_num, height). Boxes of unknown pages go."""
    own = pages.select(F.col("doc_id").alias("p_doc"), F.col("page_num").alias("p_page"), F.col("height").alias("p_height"))
    both = boxes.join(own, (F.col("doc_id") == F.col("p_doc")) & (F.col("page_num") == F.col("p_page")))
    return both.select(*[F.col(c) for c in boxes.columns], *pixels(scale, F.col("p_height")))


def polygon_box(xs: Column, ys: Column, height: Column, scale: float) -> Column:
    """A word polygon's box: widened by a fifth of its height or 4 px each side, flipped, in points."""
    low, high = F.array_min(xs), F.array_max(xs)
    top, bottom = F.array_min(ys), F.array_max(ys)
    wide = F.greatest(F.lit(4.0), (bottom - top) * 0.2)
    return F.struct(((low - wide) / scale).alias("x0"), ((height - bottom) / scale).alias("y0"), ((high + wide) / scale).alias("x1"), ((height - top) / scale).alias("y1"))
