"""Visual lines from positioned words.

Clustering is greedy: each word joins the first line whose first word it overlaps, so every step depends on those before.
That is the one place that needs a Python function per page; a page is small.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OVERLAP, GAP_HEIGHTS, LEAST_GAP, LINE_SCORE = 0.5, 2.0, 15.0, 0.3


def rows_of(words: list[tuple[float, float, float, float, int]]) -> list[list[int]]:
    """The rows (lists of word numbers) of words (x0, y0, x1, y1, number): from the top, each word to the first row that fits."""
    heads: list[tuple[float, float]] = []
    rows: list[list[tuple[float, float, float, float, int]]] = []
    for w in sorted(words, key=lambda w: -w[3]):
        for head, row in zip(heads, rows):
            common = min(w[3], head[1]) - max(w[1], head[0])
            least = min(w[3] - w[1], head[1] - head[0])
            if least > 0 and common > OVERLAP * least:
                row.append(w)
                break
        else:
            heads.append((w[1], w[3]))
            rows.append([w])
    rows.sort(key=lambda r: -max(w[3] for w in r))
    return [[w[4] for w in sorted(r, key=lambda w: w[0])] for r in rows]


def cluster_lines(words: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_num")) -> DataFrame:
    """words (keys, word_seq, text, x0..y1) with line_idx and word_idx: rows from the top, cut where the gap is wide.

    The greedy part gives each word its row; the cut at wide gaps (twice the row's upper median height, at least 15) is a window.
    """

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("word_seq", kind="stable").reset_index(drop=True)
        row, place = [0] * len(page), [0] * len(page)
        for r, members in enumerate(rows_of(list(zip(page.x0, page.y0, page.x1, page.y1, range(len(page)))))):
            for i, w in enumerate(members):
                row[w], place[w] = r, i
        return page.assign(row=row, place=place)

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    placed = words.groupBy(*keys).applyInPandas(run, f"{ddl}, row int, place int")
    in_row = Window.partitionBy(*keys, "row")
    heights = F.array_sort(F.collect_list(F.col("y1") - F.col("y0")).over(in_row))
    median = F.get(heights, F.floor(F.size(heights) / 2).cast("int"))
    gap = F.col("x0") - F.lag("x1").over(in_row.orderBy("place"))
    cut = placed.withColumns({"wide": F.greatest(median * GAP_HEIGHTS, F.lit(LEAST_GAP)), "gap": gap}).withColumn("cut", ((F.col("place") == 0) | (F.col("gap") > F.col("wide"))).cast("int"))
    on_page = Window.partitionBy(*keys).orderBy("row", "place")
    lines = cut.withColumn("line_idx", (F.sum("cut").over(on_page.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    first = F.min("place").over(Window.partitionBy(*keys, "line_idx"))
    return lines.withColumn("word_idx", (F.col("place") - first).cast("int")).drop("row", "place", "wide", "gap", "cut")


def ocr_words(lines: DataFrame, dpi: float = 300.0) -> DataFrame:
    """(doc_id, page_num, word_seq, text, x0, y0, x1, y1) from recognised lines.

    lines: doc_id, page_num, line_no, height (px), words array<string>, polygons array<array<struct<x, y>>>, score (text). Lines
    whose score reads as a number under 0.3 go; a missing or unreadable score passes. Blank words go.
    """
    from ..functions.geometry import polygon_box
    from ..functions.labels import blank_trim

    kept = lines.where(F.coalesce(F.col("score").try_cast("double") >= LINE_SCORE, F.lit(True)))
    each = kept.select("doc_id", "page_num", "line_no", "height", F.posexplode(F.arrays_zip("words", "polygons")).alias("i", "w"))
    each = each.where(F.col("w.words").isNotNull() & F.col("w.polygons").isNotNull() & (blank_trim(F.col("w.words")) != ""))
    box = polygon_box(F.transform("w.polygons", lambda p: p["x"]), F.transform("w.polygons", lambda p: p["y"]), F.col("height"), dpi / 72.0)
    return each.select("doc_id", "page_num", (F.col("line_no") * 100_000 + F.col("i")).alias("word_seq"), F.col("w.words").alias("text"), box.alias("b")).select("doc_id", "page_num", "word_seq", "text", "b.*")
