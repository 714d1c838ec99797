"""Removal of long repeated byte strings by a run-length compressed Burrows-Wheeler index.

Every window of `length` bytes is given to one anchor: the leftmost of its grams (GRAM bytes) whose hash is the least. Equal
windows have equal anchors, so a repeated window lies in the segments of one repeated gram; all other text is never moved. A
segment is the text of the consecutive windows of one anchor (at most `length` + `length` - GRAM bytes); each
window lies in exactly one segment.

1. Grams are counted over all texts with partial sums. 2. Segments of repeated grams are hashed and counted the same way: where
a whole segment repeats, so do its windows. 3. Segments that share a gram but differ go to index shards, one of each
kind. A shard's text is suffix-sorted in numpy; its Burrows-Wheeler transform is reduced to runs; common prefix lengths are
computed at run ends only (the sampled run ends) and streamed through the text in order, since away from run ends a
position's length is that of the position before, less one. These matching statistics mark the windows that stand elsewhere too.
4. Grams whose different segments hold more than `hot` bytes skip the index: their windows are hashed and counted with partial sums.

Texts are told apart by 128 bits of hashes, and equal texts are found by them; so ids may be null or repeat.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, prefix

LENGTH, GRAM = 400, 200
PASSAGE, PASSAGE_GRAM, PASSAGE_WORDS = 200, 100, 50
BLOCK = 1 << 16
HOT_BYTES = 1 << 20
SHARD_BYTES = 1 << 19
BROADCAST_GRAMS = 4_000_000
ODD = 0x9E3779B97F4A7C15
SPANS = "array<struct<a: int, z: int>>"
OCCURRENCE = "h long, s long, c1 long, c2 long, lo int, n int, cnt int, part binary"


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, ODD, np.uint64), np.full(n, pow(ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least value of every `width` neighbours, by doubling."""
    reach = 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    more = width - reach
    return np.minimum(x[: len(x) - more], x[more:]) if more else x


def pieces(texts: Iterable[tuple[bytes, list | None]], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text's place, offset, bytes) of about BLOCK bytes: whole texts (spans None), or the stretches that ranges cover, cut where they are longer than BLOCK."""
    held, size = [], 0
    for i, (text, spans) in enumerate(texts):
        for a, z in [(0, len(text))] if spans is None else _spans(spans):
            for base in range(a, z - length + 1, BLOCK):
                part = text[base : min(z, base + BLOCK + length - 1)]
                if held and size + len(part) > BLOCK:
                    yield held
                    held, size = [], 0
                held.append((i, base, part))
                size += len(part)
    if held:
        yield held


def cut(group: list[tuple[int, int, bytes]], length: int, gram: int, salt: int = 0) -> tuple[np.ndarray, ...]:
    """Of a group's segments: the text's place, gram hash, content hash, start, bytes. All of a group is cut at once."""
    width = length - gram + 1
    up, down = _powers(BLOCK + 2 * length + 2)
    sizes = np.array([len(p) for _, _, p in group])
    begins = np.cumsum(np.r_[0, sizes[:-1]])
    a = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
    prefix = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(salt + 1)) * up[: len(a)], out=prefix[1:])
    grams = _mix((prefix[gram:] - prefix[:-gram]) * down[: len(a) - gram + 1])
    place = np.arange(len(grams), dtype=np.uint64)
    least = (_least((grams & ~np.uint64(0xFFFFF)) | place, width) & np.uint64(0xFFFFF)).astype(np.int64)
    inside = np.zeros(len(least) + 1, np.int8)  # windows that lie in one piece
    inside[begins] = 1
    inside[begins + sizes - length + 1] -= 1
    at = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    new = np.flatnonzero(np.r_[True, (least[at[1:]] != least[at[:-1]]) | (at[1:] != at[:-1] + 1)])
    first = at[new]
    n = np.diff(np.r_[new, len(at)]) + length - 1
    whole = (prefix[first + n] - prefix[first]) * down[first]
    content = _mix(_mix(whole) + n.astype(np.uint64) * np.uint64(0x94D049BB133111EB))
    mine = np.searchsorted(begins, first, side="right") - 1
    numbers, bases = np.array([i for i, _, _ in group]), np.array([base for _, base, _ in group])
    return numbers[mine], grams[least[first]], content, first - begins[mine] + bases[mine], n


def segments(text: bytes, length: int, gram: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's segments: gram hash, content hash, start, bytes."""
    parts = [cut(g, length, gram, salt)[1:] for g in pieces([(text, None)], length)]
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2


def suffix_ranks(text: np.ndarray, depth: int | None = None) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Ranks of all suffixes by their first 7, 21, 63, ... symbols until no two are equal (or until `depth`), and the suffix order.

    A rank is the place of the first suffix with that beginning. Each step puts three ranks into one key and sorts only
    what is still tied. Symbols take 9 bits (bytes plus one; 0 separates). Behind the end stand zeros. Matching statistics
    take no depth: the step from a position's match to the next one's holds only for the true suffix order, with nothing tied.
    """
    n = len(text)
    if n >= 1 << 21:
        raise ValueError("a shard's text is too long")
    pad = np.zeros(n + 7, np.int64)
    pad[:n] = text
    key = np.zeros(n, np.int64)
    for i in range(7):
        key = key << 9 | pad[i : i + n]
    order = np.argsort(key)
    rank = np.zeros(n, np.int64)
    ordered = key[order]
    rank[order] = np.maximum.accumulate(np.where(np.r_[True, ordered[1:] != ordered[:-1]], np.arange(n), 0))
    size, levels = 7, [(7, rank.astype(np.int32))]
    tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(tied) and (depth is None or size < depth):
        far = np.r_[rank + 1, 0]
        key = rank[tied] << 42 | far[np.minimum(tied + size, n)] << 21 | far[np.minimum(tied + 2 * size, n)]
        by = np.argsort(key)
        key, old = key[by], rank[tied[by]]
        at = np.arange(len(tied))
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
        inner = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], at, 0))
        rank[tied[by]] = old + inner - group
        size *= 3
        levels.append((size, rank.astype(np.int32)))
        tied = tied[np.bincount(rank, minlength=n)[rank[tied]] > 1]
    return levels, np.argsort(rank, kind="stable")


def _common(text: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the different suffixes at a and b, from the levels' ranks downwards."""
    n, got = len(text), np.zeros(len(a), np.int64)

    def same(values: np.ndarray) -> np.ndarray:
        x, y = a + got, b + got
        inside = (x < n) & (y < n)
        return inside & (values[np.minimum(x, n - 1)] == values[np.minimum(y, n - 1)])

    for size, rank in reversed(levels):
        for _ in range(2):
            got += size * same(rank)
    live = np.ones(len(a), bool)
    for _ in range(6):
        live &= same(text)
        got += live
    return got


def matching_statistics(text: np.ndarray, starts: np.ndarray, depth: int | None = None) -> np.ndarray:
    """For each position, how long the longest match with another position is, cut at `depth`.

    text: symbols, 0 between segments; starts: the segments' first places, where the stream is sampled afresh.
    """
    n = len(text)
    levels, order = suffix_ranks(text)
    before = text[order - 1]  # the transform; the first symbol's is the last one
    sampled = np.r_[True, before[1:] != before[:-1]]  # heads of runs; the place before each is a run's end
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    sampled[place[starts]] = True
    sampled[np.minimum(place[starts] + 1, n - 1)] = True
    at = np.flatnonzero(sampled)
    at = at[at > 0]
    common = _common(text, levels, order[at - 1], order[at])
    longest = np.zeros(n, np.int64)
    places = np.arange(n)
    for mine, edge in ((order[at], order[0]), (order[at - 1], order[-1])):
        value = np.full(n, -1)
        value[mine] = common
        value[edge] = 0
        last = np.maximum.accumulate(np.where(value >= 0, places, 0))  # the sample at or before each place
        longest = np.maximum(longest, np.maximum(value[last], 0) - (places - last))
    return longest if depth is None else np.minimum(longest, depth)


def index_matches(parts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each of the differing segments: the ranges covered by windows that stand elsewhere in them too."""
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(np.r_[0, sizes[:-1] + 1])
    text = np.zeros(int(sizes.sum()) + len(parts), np.int64)
    inside = np.ones(len(text), bool)
    inside[starts + sizes] = False
    text[inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(parts)), sizes + 1)
    rest = starts[owner] + sizes[owner] - np.arange(len(text))
    found = matching_statistics(text, starts)
    marked = np.flatnonzero((found >= length) & (rest >= length))
    out: list[list[tuple[int, int]]] = [[] for _ in parts]
    if len(marked):
        cut = np.flatnonzero(np.r_[True, (np.diff(marked) > length) | (np.diff(owner[marked]) > 0)])
        for a, b in zip(marked[cut], marked[np.r_[cut[1:] - 1, len(marked) - 1]]):
            o = int(owner[a])
            out[o].append((int(a - starts[o]), int(b - starts[o]) + length))
    return out


def _long(x) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False)


class _Finder:
    """within: (c1, c2, spans) of shorter repeats of the same texts; a longer one lies in one of their stretches, so no more is read."""

    def __init__(self, df: DataFrame, text_col: str, length: int, gram: int, hot: int, broadcast_grams: int, within: DataFrame | None = None):
        self.spark, self.length, self.gram, self.hot, self.most = df.sparkSession, length, gram, hot, broadcast_grams
        raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
        self.texts, self.scratch = df.select(raw.alias("raw"), *identity(text_col)).where(F.octet_length("raw") >= length), Scratch()
        if within is None:
            self.texts = self.texts.withColumn("spans", F.lit(None).cast(SPANS))
        else:
            near = within.select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), "spans")
            rows = self.texts.join(near, (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2"))).select("raw", "c1", "c2", "spans")
            self.texts = self.scratch.keep(rows, "dup-texts")

    def counts(self) -> DataFrame:
        """(h, mixed) of the grams that anchor more than one segment; mixed: the segments differ."""
        length, gram = self.length, self.gram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for group in pieces(((t.as_py(), v.as_py()) for t, v in zip(b.column(0), b.column(1))), length):
                    _, h, s, _, _ = cut(group, length, gram)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s.view(np.int64))], names=["h", "s"])

        rows = self.texts.select("raw", "spans").mapInArrow(lean(run), "h long, s long")
        grams = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("a"), F.max("s").alias("z")).where("n > 1")
        return self.scratch.keep(grams.select("h", (F.col("a") != F.col("z")).alias("mixed")), "dup-grams")

    def occurrences(self, grams: DataFrame) -> DataFrame:
        """The segments of repeated grams (one row for each kind of segment in a text, `cnt` times there), with the text
        (`part`) of those of mixed grams, at least once for each kind; rows with cnt 0 are spans known to repeat within a text."""
        if grams.count() <= self.most:  # a checked size; beyond it the grams are joined
            told = grams.toArrow().sort_by("h")
            known = self.spark.sparkContext.broadcast((_long(told["h"]), _long(told["mixed"])))
            return self.scratch.keep(self.texts.mapInArrow(self._scan(known, True), OCCURRENCE), "dup-segments")
        every = self.texts.mapInArrow(self._scan(None, False), OCCURRENCE)
        rows = self.scratch.keep(every.drop("part").join(grams, "h", "left").where("cnt = 0 or mixed is not null"), "dup-segments")
        wanted = rows.where("cnt > 0 and mixed").groupBy("h", "s").agg(F.min(F.struct("c1", "c2", "lo", "n")).alias("w")).select("h", "s", "w.*")
        wanted = wanted.groupBy("c1", "c2").agg(F.collect_list(F.struct("h", "s", "lo", "n")).alias("w")).select(F.col("c1").alias("d1"), F.col("c2").alias("d2"), "w")
        at = self.texts.join(wanted, (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2"))).select("raw", F.explode("w").alias("w"))
        parts = at.select("w.h", "w.s", F.expr("substring(raw, w.lo + 1, w.n)").alias("part"))
        none = [F.lit(0).cast(t).alias(c) for c, t in (("c1", "long"), ("c2", "long"), ("lo", "int"), ("n", "int"))]
        parts = parts.select("h", "s", *none, F.lit(-1).alias("cnt"), "part")
        return self.scratch.keep(rows.select("h", "s", "c1", "c2", "lo", "n", "cnt", F.lit(None).cast("binary").alias("part")).unionByName(parts), "dup-parts")

    def _scan(self, known, with_parts: bool):
        length, gram = self.length, self.gram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[tuple[int, int]] = set()
            cols: list[list] = [[] for _ in range(8)]

            def put(h, s, c1, c2, lo, n, cnt, parts) -> None:
                for c, v in zip(cols, (h.view(np.int64), s.view(np.int64), c1, c2, lo, n, cnt)):
                    c.append(v)
                cols[7].extend(parts)

            def flush() -> pa.RecordBatch:
                types = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32, np.int32)
                arrays = [pa.array(np.concatenate(c).astype(t)) for c, t in zip(cols, types)] + [pa.array(cols[7], pa.binary())]
                for c in cols:
                    c.clear()
                return pa.RecordBatch.from_arrays(arrays, names=["h", "s", "c1", "c2", "lo", "n", "cnt", "part"])

            for b in batches:
                c1, c2 = _long(b.column(1)), _long(b.column(2))
                for group in pieces(((t.as_py(), v.as_py()) for t, v in zip(b.column(0), b.column(3))), length):
                    no, h, s, lo, n = cut(group, length, gram)
                    mixed = np.zeros(len(h), bool)
                    if known is not None:
                        grams, mix = known.value
                        at = np.minimum(np.searchsorted(grams, h.view(np.int64)), max(0, len(grams) - 1))
                        keep = grams[at] == h.view(np.int64) if len(grams) else np.zeros(len(h), bool)
                        no, h, s, lo, n, mixed = no[keep], h[keep], s[keep], lo[keep], n[keep], (mix[at] if len(grams) else mixed)[keep]
                    if not len(h):
                        continue
                    order = np.lexsort((lo, s, h, no))
                    no, h, s, lo, n, mixed = no[order], h[order], s[order], lo[order], n[order], mixed[order]
                    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (s[1:] != s[:-1]) | (no[1:] != no[:-1])])
                    cnt = np.diff(np.r_[first, len(h)])
                    parts = [None] * len(first)
                    if with_parts and mixed.any():
                        of = [(i, base) for i, base, _ in group]
                        for i in np.flatnonzero(mixed[first]):
                            j = first[i]
                            if (key := (int(h[j]), int(s[j]))) not in seen:
                                if len(seen) > 200_000:
                                    seen.clear()
                                seen.add(key)
                                _, base, part = group[bisect.bisect_right(of, (int(no[j]), int(lo[j]))) - 1]
                                parts[i] = part[lo[j] - base : lo[j] - base + n[j]]
                    put(h[first], s[first], c1[no[first]], c2[no[first]], lo[first], n[first], cnt, parts)
                    if (cnt > 1).any():  # segments that repeat within the text: their union is known now
                        again = np.repeat(cnt > 1, cnt)
                        a, z = lo[again] + (no[again] << 33), (lo + n)[again] + (no[again] << 33)
                        order = np.argsort(a)
                        a, z = a[order], np.maximum.accumulate(z[order])
                        start = np.flatnonzero(np.r_[True, a[1:] > z[:-1]])
                        ends, a = z[np.r_[start[1:] - 1, len(z) - 1]], a[start]
                        zero, mine = np.zeros(len(a), np.uint64), a >> 33
                        put(zero, zero, c1[mine], c2[mine], a & ((1 << 33) - 1), ends - a, np.zeros(len(a), np.int64), [None] * len(a))
                    if len(cols[7]) > 20_000:
                        yield flush()
            if cols[7]:
                yield flush()

        return lean(run)

    def indexed(self, parts: DataFrame) -> DataFrame:
        """(h, s, a, z): ranges of segments that match other segments of their gram, by index shards."""
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[int, int, bytes]] = []
            size = begin = before = 0  # bytes held; where the last gram's segments begin, and the bytes before it

            def emit(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
                out = [(h, s, a, z) for (h, s, _), found in zip(rows, index_matches([p for _, _, p in rows], length)) for a, z in found]
                cols = list(zip(*out)) or [(), (), (), ()]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["h", "s", "a", "z"])

            for b in batches:
                for h, s, p in zip(_long(b.column(0)).tolist(), _long(b.column(1)).tolist(), b.column(2)):
                    if held and held[-1][:2] == (h, s):
                        continue
                    if held and held[-1][0] != h:
                        begin, before = len(held), size
                    held.append((h, s, p.as_py()))
                    size += len(held[-1][2]) + 1
                    if size >= SHARD_BYTES and begin:  # the grams before the last one are whole
                        yield emit(held[:begin])
                        held, size, begin, before = held[begin:], size - before, 0, 0
            if held:
                yield emit(held)

        ordered = parts.select("h", "s", "part").repartition(F.col("h")).sortWithinPartitions("h", "s")
        return ordered.mapInArrow(lean(run), "h long, s long, a int, z int")

    def counted(self, parts: DataFrame) -> DataFrame:
        """The same for grams with very many different segments: window hashes, counted with partial sums."""
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for h, s, p in zip(_long(b.column(0)).tolist(), _long(b.column(1)).tolist(), b.column(2)):
                    a = np.frombuffer(p.as_py(), np.uint8)
                    up, down = _powers(BLOCK + 2 * length + 2)
                    prefix = np.r_[np.uint64(0), np.cumsum((a.astype(np.uint64) + np.uint64(3)) * up[: len(a)], dtype=np.uint64)]
                    w = _mix((prefix[length:] - prefix[:-length]) * down[: len(a) - length + 1])
                    k = len(w)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, h)), pa.array(np.full(k, s)), pa.array(np.arange(k, dtype=np.int32)), pa.array(w.view(np.int64))], names=["h", "s", "a", "w"])

        one = parts.groupBy("h", "s").agg(F.first("part").alias("part"))
        windows = self.scratch.keep(one.mapInArrow(run, "h long, s long, a int, w long"), "dup-windows")
        again = self.scratch.keep(windows.groupBy("h", "w").count().where("count > 1").select(F.col("h").alias("h2"), F.col("w").alias("w2")), "dup-again")
        return windows.join(again, (F.col("h") == F.col("h2")) & (F.col("w") == F.col("w2"))).select("h", "s", "a", (F.col("a") + length).alias("z"))

    def spans(self) -> DataFrame:
        """(c1, c2, spans): the ranges to remove from each text that has some, in any order, overlaps left."""
        rows = self.occurrences(self.counts())
        kinds = self.scratch.keep(rows.where("cnt > 0").groupBy("h", "s").agg(F.sum("cnt").alias("total"), F.first("n").alias("n")), "dup-kinds")
        hot = self.scratch.keep(kinds.groupBy("h").agg(F.sum("n").alias("held"), F.count(F.lit(1)).alias("k")).where((F.col("k") > 1) & (F.col("held") > self.hot)).select("h"), "dup-hot")
        parts = rows.where("part is not null").select("h", "s", "part")
        whole = kinds.where("total > 1").select("h", "s", F.lit(0).alias("a"), F.col("n").alias("z"))
        found = whole.unionByName(self.indexed(parts.join(hot, "h", "left_anti")))
        if not hot.isEmpty():
            found = found.unionByName(self.counted(parts.join(hot, "h", "left_semi")))
        found = found.groupBy("h", "s").agg(F.collect_list(F.struct("a", "z")).alias("r"))
        found = self.scratch.keep(found.select(F.col("h").alias("h2"), F.col("s").alias("s2"), "r"), "dup-ranges")
        placed = rows.where("cnt > 0").select("h", "s", "c1", "c2", "lo").join(found, (F.col("h") == F.col("h2")) & (F.col("s") == F.col("s2")))
        spread = placed.select("c1", "c2", "lo", F.explode("r").alias("r")).select("c1", "c2", (F.col("lo") + F.col("r.a")).alias("a"), (F.col("lo") + F.col("r.z")).alias("z"))
        inner = rows.where("cnt = 0").select("c1", "c2", F.col("lo").alias("a"), (F.col("lo") + F.col("n")).alias("z"))
        every = spread.unionByName(inner).distinct().groupBy("c1", "c2").agg(F.collect_list(F.struct("a", "z")).alias("spans"))
        return self.scratch.result(every, "dup-spans")


def identity(text_col: str):
    """Two 64-bit hashes that tell texts apart."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("c1"), F.xxhash64(F.lit("second"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("c2")


def merged(spans: list[tuple[int, int]] | None) -> list[tuple[int, int]]:
    """Ranges in order, overlapping and touching ones joined."""
    out: list[list[int]] = []
    for a, z in sorted(spans or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def remainder(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside the (merged) spans."""
    kept, at = [], 0
    for a, z in spans:
        kept.append(text[at:a])
        at = z
    return b"".join([*kept, text[at:]])


def repeated_spans(df: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT_BYTES, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """df's columns and `dup_spans`: the byte ranges covered by `length`-byte strings that also start anywhere else.

    Matches lie within single texts and may lie within the same text. Null and short texts have no spans (null); rows with
    equal texts count as different places, so their texts are wholly covered if long enough. An empty table gives no
    rows. Ranges come in any order and may overlap: merged() puts them right. A column dup_spans that is already
    there is replaced.
    """
    return _attached(df, text_col, {"dup_spans": (length, gram)}, hot, broadcast_grams)


def nested_spans(df: DataFrame, text_col: str = "text", sizes: dict[str, tuple[int, int]] | None = None, hot: int = HOT_BYTES, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """repeated_spans() at several sizes, column: (length, gram), from the shortest length to the longest; by default passage_spans and dup_spans.

    What repeats at a longer length repeats at a shorter one, so each run reads only the stretches that the one before covered.
    """
    return _attached(df, text_col, sizes or {"passage_spans": (PASSAGE, PASSAGE_GRAM), "dup_spans": (LENGTH, GRAM)}, hot, broadcast_grams)


def _attached(df: DataFrame, text_col: str, sizes: dict[str, tuple[int, int]], hot: int, broadcast_grams: int) -> DataFrame:
    df, near, columns = df.drop(*sizes), None, []
    own, tables = prefix(df, "__dup"), None
    joined = df.withColumns({f"{own}_k{i}": c for i, c in enumerate(identity(text_col), 1)})
    for name, (length, gram) in sizes.items():
        if not 0 < gram < length or columns and length < sizes[columns[-1]][0]:
            raise ValueError("gram must be shorter than length, and lengths must grow")
        near = _Finder(df, text_col, length, gram, hot, broadcast_grams, near).spans()
        found = near.select(F.col("c1").alias(f"{own}_c1_{length}"), F.col("c2").alias(f"{own}_c2_{length}"), F.col("spans").alias(name))
        if tables is None:
            tables, k1, k2 = found, f"{own}_c1_{length}", f"{own}_c2_{length}"
        else:
            tables = tables.join(found, (F.col(k1) == F.col(f"{own}_c1_{length}")) & (F.col(k2) == F.col(f"{own}_c2_{length}")), "left")
        columns.append(name)
    joined = joined.join(tables.select(k1, k2, *columns), (F.col(f"{own}_k1") == F.col(k1)) & (F.col(f"{own}_k2") == F.col(k2)), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *columns)


def _spans(value) -> list[tuple[int, int]]:
    return merged([(x["a"], x["z"]) for x in value]) if value else []


def digest(spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", over: int = PASSAGE_WORDS) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256) of repeated_spans(): what stays when dup_spans go.

    Of nested_spans() also n_passages and `text`: the text without those of its passage_spans in which more than `over` whole words lie (null stays null).
    """
    cut = "passage_spans" in spans.columns
    rows = spans.select(id_col, F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("raw"), "dup_spans", *([F.col(text_col).isNull(), "passage_spans"] if cut else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                out = []
                for i, (t, v) in enumerate(zip(b.column(1), b.column(2))):
                    text, found = t.as_py(), _spans(v.as_py())
                    row = (len(text), sum(z - a for a, z in found), len(found), hashlib.sha256(remainder(text, found)).hexdigest())
                    if cut:
                        gone = passages(text, b.column(4)[i].as_py(), over)
                        row += (len(gone), None if b.column(3)[i].as_py() else remainder(text, gone).decode("utf-8", "ignore"))
                    out.append(row)
                cols = list(zip(*out)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds.values()))], names=[id_col, *kinds])

    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()} | ({"n_passages": pa.int64(), "text": pa.string()} if cut else {})
    return rows.mapInArrow(lean(run), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, " + ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in kinds.items()))


def whole_words(text: bytes, a: int, z: int) -> int:
    """How many words of the text lie wholly in [a, z)."""
    words = text[a:z].split()
    cut = (a > 0 and not text[a - 1 : a].isspace() and not text[a : a + 1].isspace()) + (z < len(text) and not text[z : z + 1].isspace() and not text[z - 1 : z].isspace())
    return max(0, len(words) - cut)


def passages(text: bytes, spans, over: int) -> list[tuple[int, int]]:
    """The merged ranges in which more than `over` whole words lie; with 0 all of them."""
    return [x for x in _spans(spans) if not over or whole_words(text, *x) > over]


def remove_repeats(df: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, over: int = 0) -> DataFrame:
    """df with the repeated strings cut out of its texts; characters of which only some bytes are left go too. Every row stays.

    With `over`, a span stays in its text unless more than so many whole words lie in it.
    """
    names = df.columns
    at = names.index(text_col)
    found = _attached(df, text_col, {prefix(df, "__cut"): (length, gram)}, HOT_BYTES, BROADCAST_GRAMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, v in enumerate(b.column(b.num_columns - 1)):
                if texts[i] is not None and v.is_valid:
                    raw = texts[i].encode("utf-8", "surrogatepass")
                    texts[i] = remainder(raw, passages(raw, v.as_py(), over)).decode("utf-8", "ignore")
            cols = b.columns[:-1]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return found.mapInArrow(lean(run), df.schema)
