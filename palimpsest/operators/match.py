"""User-given values: parsing, and finding them on pages by their letters and digits alone."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import accumulate
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import blank_trim, custom_type
from ..functions.text import norm

PAD = 2.0


def parse_custom(raw: DataFrame) -> DataFrame:
    """(value, type, seq) from rows (seq, value, type, line): user-given dictionary entries.

    An entry is either value and type as they are, or a line cut at commas and newlines into `value` or `type=value`. Blank values go.
    A value that comes more than once keeps its first type that isn't `other`.
    """
    parts = F.when(F.col("line").isNotNull(), F.split("line", "[\n,]", -1)).otherwise(F.array(F.lit(None).cast("string")))
    each = raw.select("seq", "value", "type", "line", F.posexplode(parts).alias("part_no", "part"))
    part = blank_trim(F.col("part"))
    at = F.instr(part, "=")
    value = F.when(F.col("line").isNull(), F.col("value")).when(at > 0, part.substr(at + 1, F.length(part))).otherwise(part)
    kind = F.when(F.col("line").isNull(), F.col("type")).when(at > 0, F.substring_index(part, "=", 1))
    rows = each.select("seq", "part_no", blank_trim(value).alias("value"), custom_type(kind).alias("type")).where("value <> ''")
    best = F.min_by("type", F.struct((F.col("type") == "other").alias("o"), "seq", "part_no"))
    return rows.groupBy("value").agg(best.alias("type"), F.min(F.struct("seq", "part_no"))["seq"].alias("seq"))


def runs_of(boxes: list[tuple[float, float, float, float]]) -> list[tuple[int, ...]]:
    """Each line with all later lines that share a column with it; equal runs once."""
    out: dict[tuple[int, ...], None] = {}
    for i, a in enumerate(boxes):
        out[(i, *(j for j in range(i + 1, len(boxes)) if min(a[2], boxes[j][2]) > max(a[0], boxes[j][0])))] = None
    return list(out)


def overlaps_itself(value: str) -> bool:
    """Whether some end of it is also a beginning of it, so that two finds can overlap."""
    fall = [0]
    for c in value[1:]:
        k = fall[-1]
        while k and c != value[k]:
            k = fall[k - 1]
        fall.append(k + (c == value[k]))
    return bool(value) and fall[-1] > 0


def finder(values: list[str]) -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """Automata of normalised values, all of them and those that overlap themselves: one walk along a text meets all, however many there are."""

    def made(some: list[str]) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_STRING)
        for v in some:
            found.add_word(v, v)
        found.make_automaton()
        return found

    values = [v for v in values if v]
    return made(values), made([v for v in values if overlaps_itself(v)])


def find_on_page(
    lines: list[list[tuple[str, float, float, float, float]]], values: tuple[ahocorasick.Automaton, ahocorasick.Automaton], letterless: bool = False
) -> Iterator[tuple[str, float, float, float, float]]:
    """(normalised value, x0, y0, x1, y1) for the values of finder() on a page of lines of (normalised word, box).

    A value's finds in one run don't overlap, the first comes first; equal boxes (to a tenth of a point, unpadded) of one value count once.
    A run that is another one without its first line holds nothing new but for values that overlap themselves.
    letterless: words without letters and digits that stand between a find's first and last character belong to its boxes, so those at
    the end or the beginning of a line widen them.
    """
    boxes = [(min(w[1] for w in ln), min(w[2] for w in ln), max(w[3] for w in ln), max(w[4] for w in ln)) if ln else (0.0, 0.0, 0.0, 0.0) for ln in lines]
    letters = ["".join(w[0] for w in ln) for ln in lines]
    places = [[(i, j, k) for j, w in enumerate(ln) for k in range(len(w[0]))] for i, ln in enumerate(lines)]
    # words without letters, each with the number of letters before it in its line
    bare = [[(k, j) for j, (w, k) in enumerate(zip(ln, accumulate((len(w[0]) for w in ln), initial=0))) if not w[0]] if letterless else [] for ln in lines]
    seen: set[tuple] = set()
    before: tuple[int, ...] = ()
    for run in runs_of(boxes):
        which, before = values[before[1:] == run], run
        if not len(which):
            continue
        where: list[tuple[int, int, int]] | None = None
        between: list[tuple[int, int, int]] = []
        behind: dict[str, int] = {}  # the end of a value's last find in this run
        for last, target in which.iter("".join(letters[i] for i in run)):
            at = last + 1 - len(target)
            if at < behind.get(target, 0):
                continue
            behind[target] = last + 1
            if where is None:
                where = [p for i in run for p in places[i]]
                begins = accumulate((len(letters[i]) for i in run), initial=0)
                between = [(begin + k, i, j) for begin, i in zip(begins, run) for k, j in bare[i]]
            edge: dict[int, list[float]] = {}
            words: dict[tuple[int, int], list[int]] = {}
            for i, j, k in where[at : last + 1]:
                words.setdefault((i, j), [k, k])[1] = k
            for _, i, j in between[bisect_right(between, at, key=itemgetter(0)) : bisect_right(between, last, key=itemgetter(0))]:
                words[i, j] = [0, -1]
            for (i, j), (low, high) in words.items():
                name, x0, y0, x1, y1 = lines[i][j]
                part = (x0, y0, x1, y1) if (low, high + 1) == (0, len(name)) else (x0 + low / len(name) * (x1 - x0), y0, x0 + (high + 1) / len(name) * (x1 - x0), y1)
                e = edge.setdefault(i, list(part))
                edge[i] = [min(e[0], part[0]), min(e[1], part[1]), max(e[2], part[2]), max(e[3], part[3])]
            for e in edge.values():
                if (key := (target, *(math.floor(v * 10 + 0.5) for v in e))) not in seen:
                    seen.add(key)
                    yield target, e[0] - PAD, e[1] - PAD, e[2] + PAD, e[3] + PAD


def _pages(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, list[list[tuple]]]]:
    """(doc_id, page_num, lines) of rows (doc_id, page_num, line_idx, word_idx, n, box) that come page by page."""
    held: list[pa.RecordBatch] = []

    def lines_of(rows: list[pa.RecordBatch]) -> tuple[int, int, list[list[tuple]]]:
        doc, page, line, word, *cells = (sum((b.column(i).to_pylist() for b in rows), []) for i in range(9))
        lines: dict[int, list[tuple]] = {}
        for at in sorted(range(len(line)), key=lambda i: (line[i], word[i])):
            lines.setdefault(line[at], []).append(tuple(c[at] for c in cells))
        return doc[0], page[0], list(lines.values())

    for b in batches:
        if not b.num_rows:
            continue
        doc, page = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (page[1:] != page[:-1])) + 1
        if held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (doc[0], page[0]):
            yield lines_of(held)
            held = []
        for a, z in zip([0, *cuts], [*cuts, len(doc)]):
            held.append(b.slice(a, z - a))
            if z < len(doc):
                yield lines_of(held)
                held = []
    if held:
        yield lines_of(held)


def match_custom(words: DataFrame, custom: DataFrame, most: int = 100_000, in_order: bool = False, letterless: bool = False) -> DataFrame:
    """(doc_id, page_num, value, type, x0, y0, x1, y1) of custom values on pages of words (with line_idx, word_idx).

    The dictionary (value, type) goes to the tasks as automata, so a page costs its letters and its finds and not its letters times
    the values. A dictionary of more than `most` values is cut by a hash into parts of about that many, and the pages meet part after part.
    in_order: the words come page by page, as layout_words() gives them, and are not shuffled. letterless: as in find_on_page().
    """
    given = custom.select("value", "type", norm(F.col("value")).alias("n")).where("n <> ''")
    parts = max(1, math.ceil(given.count() / most))
    sc = words.sparkSession.sparkContext
    kept = words.select("doc_id", "page_num", "line_idx", "word_idx", norm(F.col("text")).alias("n"), "x0", "y0", "x1", "y1")
    if not in_order:
        kept = kept.repartition("doc_id", "page_num").sortWithinPartitions("doc_id", "page_num")

    def search(part: int) -> DataFrame:
        rows = given.where(F.pmod(F.xxhash64("value"), F.lit(parts)) == part).collect()
        named: dict[str, list[tuple[str, str]]] = {}
        for r in rows:
            named.setdefault(r.n, []).append((r.value, r.type))
        shared = sc.broadcast((finder(sorted(named)), named))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values, names = shared.value
            out: list[tuple] = []
            for doc, page, lines in _pages(batches):
                out += [(doc, page, v, kind, *b) for n, *b in find_on_page(lines, values, letterless) for v, kind in names[n]]
                if len(out) > 10_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r)) for r in out], shape)
                    out = []
            yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r)) for r in out], shape)

        return kept.mapInArrow(run, "doc_id long, page_num int, value string, type string, x0 double, y0 double, x1 double, y1 double")

    shape = pa.schema([("doc_id", pa.int64()), ("page_num", pa.int32()), ("value", pa.string()), ("type", pa.string()), *((c, pa.float64()) for c in ("x0", "y0", "x1", "y1"))])
    return reduce(DataFrame.unionByName, map(search, range(parts)))


def emitted(found: DataFrame) -> DataFrame:
    """(doc_id, value, type, page_num): each custom value of a document once, with the first page it is found on."""
    return found.groupBy("doc_id", "value", "type").agg(F.min("page_num").alias("page_num"))


def all_items(custom: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, place, source, type, value): a document's emitted custom values by page and value, then its model items by offset and label.

    An item that a chunk's end cut short has the offset and label of the whole one; the value settles which comes first: the short one,
    whose chunk is the earlier.
    """
    first = custom.select("doc_id", F.lit(0).alias("s"), F.col("page_num").alias("a"), F.col("value").alias("b"), F.lit("custom").alias("source"), "type", "value")
    then = model.select("doc_id", F.lit(1).alias("s"), F.col("g_start").alias("a"), F.col("label").alias("b"), F.lit("model").alias("source"), "type", "value")
    order = Window.partitionBy("doc_id").orderBy("s", "a", "b", "value", "type")
    return first.unionByName(then).withColumn("place", F.row_number().over(order)).select("doc_id", "place", "source", "type", "value")
