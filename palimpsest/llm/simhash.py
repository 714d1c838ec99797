"""SimHash near-duplicates found by Golay-code fuzzy hashing.

Two fingerprints of 64 bits that differ in at most three bits agree wholly in one of four 16-bit blocks. Of the 48
other bits, two segments of 23 are taken: three errors leave one of them with at most one. A 23-bit word lies within
three bits of exactly one codeword of the perfect binary Golay code. Its keys are the indices of the codewords that
it and its 23 neighbours decode to: one key if the word is within two bits of its codeword, otherwise six. Words one
bit apart always share a key. So (block, 16 exact bits, segment, 12-bit codeword index) is a key that every linked
pair shares at least once. Candidates under a key are verified on all 64 bits.

A 16-bit block value that more than `hot` distinct fingerprints share gets longer keys: 12 more exact bits (one of
four, since three errors leave one of four blocks clean), then of the last 36 bits either the Golay keys of the
first 23 or the other 13 exactly (three errors cannot spoil both). Both members of a pair see the same block value, so
they get the same kind of key, and no link is lost. Under one key links come out as a spanning forest, never as all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, connected_components, lean, prefix

GENERATOR = 0b101011100011  # x^11+x^9+x^7+x^6+x^5+x+1, the Golay code's generator polynomial
MAX_BITS = 3
HOT = 4096
SMALL = 24
LONG_TEXT = 8_000_000
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def shingles(text: str | None, words: int) -> Iterator[list[bytes]]:
    """A text's word shingles, some at a time; fewer words make one shingle of all, none make none."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    held: list[bytes] = []
    if len(raw) <= LONG_TEXT:
        parts = iter([raw.split()])
    else:
        found = (m.group() for m in WORD.finditer(raw))
        parts = iter(lambda: list(islice(found, 1 << 17)), [])
    first = True
    for part in parts:
        held += part
        if len(held) >= words:
            yield [b" ".join(x) for x in zip(*(held[i:] for i in range(words)))]
            held, first = held[len(held) - words + 1 :], False
    if first and held:
        yield [b" ".join(held)]


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats counted; no words: 0. Null is an empty text."""
    ones, n = np.zeros(64, np.int64), 0
    for some in shingles(text, words):
        n += len(some)
        for at in range(0, len(some), 1 << 16):
            part = some[at : at + (1 << 16)]
            h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in part), np.uint64, len(part))
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id_col, fp): the fingerprint of each row's whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    kept = df.select(id_col, F.col(text_col).cast("string"))
    return kept.mapInArrow(lean(run), f"`{id_col}` {kept.schema[0].dataType.simpleString()}, fp long")


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each 12-bit message its 11 check bits; for each syndrome its error of at most three bits."""
    check = np.arange(1 << 12, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        check = np.where(check >> bit & 1, check ^ (GENERATOR << (bit - 11)), check)
    error = np.zeros(1 << 11, np.int64)
    for n in (1, 2, 3):
        for places in combinations(range(23), n):
            e = sum(1 << p for p in places)
            error[check[e >> 11] ^ (e & 0x7FF)] = e
    return check, error


def decode(w: np.ndarray) -> np.ndarray:
    """The index of the codeword within three bits of each 23-bit word."""
    check, error = tables()
    return (w ^ error[check[w >> 11] ^ (w & 0x7FF)]) >> 11


def golay_keys(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index): of each 23-bit word and its neighbours, each index once."""
    found = np.stack([decode(w), *(decode(w ^ (1 << i)) for i in range(23))], axis=1)
    found.sort(axis=1)
    fresh = np.ones(found.shape, bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(fresh)[0], found[fresh]


def _without(fp: np.ndarray, at: int, n: int) -> np.ndarray:
    """fp with the n bits from `at` on cut out."""
    low = fp & np.uint64((1 << at) - 1)
    return low | ((fp >> np.uint64(at + n)) << np.uint64(at))


def bucket_keys(fp: np.ndarray, hot: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of uint64 fingerprints; hot: for each 16-bit block the block values that get the longer keys.

    A key's kind and exact bits are packed, then mixed with the Golay index by a bijective step, so that keys of
    different kinds differ in their lowest bits and never need verification beyond the 64-bit comparison.
    """
    rows, keys = [], []

    def put(row: np.ndarray, kind: int, exact: np.ndarray, index: np.ndarray) -> None:
        rows.append(row)
        keys.append(((exact << np.uint64(13) | index.astype(np.uint64)) << np.uint64(7)) | np.uint64(kind))

    for block in range(4):
        value = (fp >> np.uint64(16 * block)) & np.uint64(0xFFFF)
        rest = _without(fp, 16 * block, 16)
        dense = np.isin(value, hot[block])
        at = np.nonzero(~dense)[0]
        for half in range(2):
            row, index = golay_keys(((rest[at] >> np.uint64(23 * half)) & np.uint64(0x7FFFFF)).astype(np.int64))
            put(at[row], block * 2 + half, value[at[row]], index)
        if len(at := np.nonzero(dense)[0]):
            for part in range(4):
                twelve = (rest[at] >> np.uint64(12 * part)) & np.uint64(0xFFF)
                exact = value[at] << np.uint64(12) | twelve
                last = _without(rest[at], 12 * part, 12)
                row, index = golay_keys((last & np.uint64(0x7FFFFF)).astype(np.int64))
                put(at[row], 8 + (block * 4 + part) * 2, exact[row], index)
                put(at, 9 + (block * 4 + part) * 2, exact, (last >> np.uint64(23)) & np.uint64(0x1FFF))
    return np.concatenate(rows), np.concatenate(keys)


def _forest(fp: np.ndarray, rep: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges that span the links among one bucket's fingerprints."""
    left = np.arange(len(fp))
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= MAX_BITS
            for x in left[near]:
                yield int(rep[at]), int(rep[x])
                todo.append(x)
            left = left[~near]


def _edges(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
    """Links under each key; the rows come sorted by key, with whole buckets."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    size_of = np.repeat(sizes, sizes)
    us, vs = [], []
    for step in range(1, SMALL):
        i = np.flatnonzero((key[step:] == key[:-step]) & (size_of[step:] <= SMALL))
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= MAX_BITS]
        us.append(rep[i])
        vs.append(rep[i + step])
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        pairs = np.array(list(_forest(fp[s : s + n], rep[s : s + n])), np.int64).reshape(-1, 2)
        us.append(pairs[:, 0])
        vs.append(pairs[:, 1])
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by the first one, cut so that rows of one key come together."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(now[0]):
            continue
        last = int(np.searchsorted(now[0], now[0][-1]))
        if last or held and held[-1][0][-1] != now[0][0]:
            yield [np.concatenate(x) for x in zip(*held, *([[x[:last] for x in now]] if last else []))]
            held = []
        held.append([x[last:] for x in now])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def link_edges(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """(u, v): links between the representatives of distinct fingerprints (fp, rep) that differ in at most three bits."""
    spark = distinct.sparkSession
    blocks = F.array(*[F.lit(b * 65536) + F.shiftrightunsigned("fp", 16 * b).bitwiseAND(0xFFFF) for b in range(4)])
    dense = distinct.select(F.explode(blocks).alias("b")).groupBy("b").count().where(F.col("count") > hot)
    found = [r.b for r in dense.select("b").collect()]  # at most 4 * 65,536 values
    values = spark.sparkContext.broadcast([np.array([x % 65536 for x in found if x // 65536 == b], np.uint64) for b in range(4)])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                part = b.slice(at, 8192)
                fp, rep = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
                row, key = bucket_keys(fp.view(np.uint64), values.value)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[row]), pa.array(rep[row])], names=["key", "fp", "rep"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp, rep in whole_buckets(batches):
            yield _edges(key, fp.view(np.uint64), rep)

    keyed = distinct.select("fp", "rep").mapInArrow(spread, "key long, fp long, rep long")
    return keyed.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(links, "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, hot: int = HOT) -> DataFrame:
    """(id_col, fp, component_id) for every row of df, other columns ignored.

    Fingerprints link at three or fewer differing bits; component_id is the smallest id reachable. Equal fingerprints
    are collapsed first (partial counts, so a hot one costs one row a task). Null and empty texts have fingerprint 0 and
    link like any other; ties and repeated rows are kept; rows whose id is null take part and keep a null id; an empty
    table gives no rows. Ids must be integers.
    """
    scratch = Scratch()
    fps = scratch.keep(fingerprints(df, id_col, text_col, words), "fp")
    distinct = scratch.keep(fps.groupBy("fp").agg(F.min(id_col).cast("long").alias("rep")), "fp-distinct")
    parts = connected_components(link_edges(distinct.where("rep is not null"), hot), scratch)
    classes = scratch.keep(distinct.join(parts, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("c_fp"), F.coalesce("component", "rep").alias("component_id")), "fp-class")
    return scratch.result(fps.join(classes, F.col("fp") == F.col("c_fp")).select(id_col, "fp", "component_id"), "fp-components")


# Groups by similarity of word shingles.
#
# Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 differ in about 15 % of the bits of a fingerprint of those
# shingles, far more than three of 64. Two changes bring them within reach. The fingerprint is taken over two-word
# shingles, of which an edit spoils fewer: about 9 % of the bits then differ (15 % where a text is cut short). And it is wider, WORDS words
# of 23 bits, with the Golay code as a quantiser: each word is decoded to its one nearest codeword, which noise of a few bits often leaves
# alone. Two codeword indices make a key of 24 bits; each word makes one with those STEPS further on. Texts that share a key and are near
# on the first 128 bits are candidates. Chains of candidates make crowds, and all texts of a crowd are compared exactly, by their sets of
# five-word shingles: nothing leaves a crowd on its fingerprint's word. A crowd of more than BLOCK texts first meets PIVOTS of
# its own, then the PIVOTS that most of those are linked to; if its texts aren't one group by then, blocks of it are compared two by two.

WORDS, STEPS = 48, (1, 5, 11, 17)
SKETCH = 2
WIDE = WORDS * 23
FEW = 8
NEAR = 32  # of 128 bits
BLOCK, BLOCK_BYTES = 128, 1 << 24
PIVOTS = 16
PAIRS = [(a, (a + step) % WORDS) for step in STEPS for a in range(WORDS)]


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order."""
    parts = [np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in some), np.uint64, len(some)) for some in shingles(text, words)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """WIDE bits (in whole 64-bit words): each the majority over the set of a bit of the rehashed shingles."""
    ones = np.zeros(-(-WIDE // 64) * 64, np.int64)
    salts = np.arange(len(ones) // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 2040):
        x = hashes[at : at + 2040, None] + salts
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1, bitorder="little")
        for row in range(0, len(bits), 255):  # sums of so many bits fit in a byte
            ones += np.add.reduce(bits[row : row + 255], axis=0, dtype=np.uint8)
    bits = 2 * ones > len(hashes)
    bits[WIDE:] = False
    return np.packbits(bits, bitorder="little").tobytes()


def wide_keys(fps: list[bytes]) -> np.ndarray:
    """Row by row the keys of wide fingerprints, one for each pair of words."""
    bits = np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")[:, :WIDE]
    index = decode((bits.reshape(-1, WORDS, 23).astype(np.int64) << np.arange(23)).sum(axis=2))
    return np.stack([(i << 24) | (index[:, a] << 12) | index[:, b] for i, (a, b) in enumerate(PAIRS)], axis=1)


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x[:, 0] ^ y[:, 0]).astype(np.int64) + np.bitwise_count(x[:, 1] ^ y[:, 1])


def _candidates(key: np.ndarray, low: np.ndarray, high: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
    """Near pairs (parent, child) under each key of rows that come sorted by key and rep, with whole buckets.

    Of large buckets a forest, which chains the same rows as all near pairs would. It grows from the smallest reps: the same
    group meets under many keys, and so gives the same pairs.
    """
    sketch = np.stack([low, high], axis=1).view(np.uint64)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    size_of = np.repeat(sizes, sizes)
    us, vs = [], []
    for step in range(1, FEW):
        i = np.flatnonzero((key[step:] == key[:-step]) & (size_of[step:] <= FEW))
        if not len(i):
            break
        i = i[_near(sketch[i], sketch[i + step]) <= NEAR]
        us.append(rep[i])
        vs.append(rep[i + step])
    for s, n in zip(starts[sizes > FEW], sizes[sizes > FEW]):
        left = np.arange(s, s + n)
        while len(left):
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                at = todo.pop()
                near = _near(sketch[left], sketch[[at]]) <= NEAR
                us.append(np.full(int(near.sum()), rep[at]))
                vs.append(rep[left[near]])
                todo += left[near].tolist()
                left = left[~near]
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def linked_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which sets (of distinct numbers) are at least so similar, each pair compared: a matrix, true on its diagonal."""
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times[column] > 1
    column, owner = (np.cumsum(times > 1) - 1)[column[often]], owner[often]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(sets), len(sets)))
    for at in range(0, int((times > 1).sum()), 4096):
        i = slice(*np.searchsorted(column, [at, at + 4096]))
        some = np.zeros((len(sets), 4096), np.float32)
        some[owner[i], column[i] - at] = 1
        both += some @ some.T
    linked = both >= similarity * (sizes[:, None] + sizes - both)
    np.fill_diagonal(linked, True)
    return linked


def _spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """A forest that spans the links."""
    left, out = np.arange(len(linked)), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = linked[at, left]
            out += [(at, x) for x in left[near]]
            todo += left[near].tolist()
            left = left[~near]
    return out


def similar_pairs(df: DataFrame, distinct: DataFrame, id_col: str, text_col: str, words: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(u, v): links that span the groups of representatives whose shingle sets are at least so similar, of distinct (fp, rep)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                fps = part.column(0).to_pylist()
                keys, n = wide_keys(fps), len(PAIRS)
                sketch = np.frombuffer(b"".join(f[:16] for f in fps), np.int64).reshape(-1, 2)
                cols = [keys.ravel(), np.repeat(sketch[:, 0], n), np.repeat(sketch[:, 1], n), np.repeat(part.column(1).to_numpy(zero_copy_only=False), n)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "low", "high", "rep"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_buckets(batches):
            yield _candidates(*columns)

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: set[tuple[int, int]] = set()
        for b in batches:
            fresh = {(u, v) for p in b.column(0).to_pylist() for v in (min(p),) for u in p if u != v} - said
            if len(said) > 1_000_000:
                said.clear()
            said |= fresh
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*fresh) if fresh else ((), ()))], names=["u", "v"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([shingle_hashes(t.as_py(), words).tobytes() for t in b.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], found], names=["id", "crowd", "shingles"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, vs = [], []
            for u, x, pivots in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                x = np.frombuffer(x.as_py(), np.uint64)
                for p in pivots:
                    y = np.frombuffer(p["shingles"].as_py(), np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both >= similarity * (len(x) + len(y) - both):
                        us.append(u)
                        vs.append(p["id"].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    def compare(part: pa.Table) -> pa.Table:
        ids = part["id"].to_numpy()
        found = _spanning(linked_sets([np.frombuffer(x, np.uint64) for x in part["shingles"].to_pylist()], similarity))
        at = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"u": pa.array(ids[at[:, 0]], pa.int64()), "v": pa.array(ids[at[:, 1]], pa.int64())})

    keyed = distinct.select("fp", "rep").mapInArrow(lean(spread), "key long, low long, high long, rep long")
    found = keyed.repartition(F.col("key")).sortWithinPartitions("key", "rep").mapInArrow(links, "u long, v long")
    # a child has few parents, at most FEW - 1 under a key: all of them are tied to the least, and what the children of a crowd say falls together
    ties = found.where("u <> v").groupBy("v").agg(F.collect_set("u").alias("p")).select(F.concat("p", F.array("v")).alias("p"))
    ties = ties.mapInArrow(tie, "u long, v long").distinct()
    crowds = scratch.keep(connected_components(scratch.keep(ties, "wide-pairs"), scratch), "wide-crowds")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    held = texts.join(crowds, F.col("id") == F.col("node")).select("id", F.col("component").alias("crowd"), "text").mapInArrow(lean(sets), "id long, crowd long, shingles binary")
    held = scratch.keep(held.dropDuplicates(["id"]), "wide-sets")
    sizes = held.groupBy("crowd").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.length("shingles")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    sizes = scratch.keep(sizes.select(F.col("crowd").alias("of"), F.greatest("blocks", F.lit(1)).alias("blocks")), "wide-sizes")
    large = scratch.keep(held.join(sizes.where("blocks > 1"), F.col("crowd") == F.col("of")).select("id", "crowd", "shingles"), "wide-large")

    def met(rank: DataFrame) -> DataFrame:
        """Links of all texts of large crowds to their crowd's pivots, the first of (id, crowd, score)."""
        first = rank.withColumn("place", F.row_number().over(Window.partitionBy("crowd").orderBy(F.desc("score"), F.xxhash64("id")))).where(F.col("place") <= PIVOTS)
        first = first.select(F.col("id").alias("pivot"))
        pivots = large.join(first, F.col("id") == F.col("pivot")).groupBy(F.col("crowd").alias("of")).agg(F.collect_list(F.struct("id", "shingles")).alias("pivots"))
        pivots = scratch.keep(pivots, "wide-pivots")
        rows = large.join(pivots, F.col("crowd") == F.col("of")).select("id", "shingles", "pivots")
        return scratch.keep(rows.mapInArrow(meet, "u long, v long").where("u <> v"), "wide-met")

    once = met(large.select("id", "crowd", F.lit(0).alias("score")))
    score = once.groupBy("u").agg(F.count(F.lit(1)).alias("score"))
    twice = once.unionByName(met(large.select("id", "crowd").join(score, F.col("id") == F.col("u"), "left").select("id", "crowd", F.coalesce("score", F.lit(0)).alias("score"))))
    parts = connected_components(twice, scratch).select("node", "component")
    state = large.select("id", "crowd").join(parts, F.col("id") == F.col("node"), "left").select("crowd", F.coalesce("component", "id").alias("part"))
    whole = state.groupBy("crowd").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least = most").select(F.col("crowd").alias("of"))
    todo = scratch.keep(sizes.join(whole, "of", "left_anti"), "wide-todo")
    cut = held.join(todo, F.col("crowd") == F.col("of")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("crowd", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "id", "shingles")
    return twice.unionByName(cut.groupBy("crowd", "a", "b").applyInArrow(compare, "u long, v long"))


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id_col, component_id) for every row: groups of texts whose word shingles are at least so similar.

    Candidates come from the wide fingerprint, so a pair just at the limit is found with a chance (about 0.9, more above it); a pair that
    is linked has been compared exactly. Equal fingerprints are one. Texts without words are one group. Rows with a null id keep a
    null component unless another row has their text's fingerprint. Ids must be integers; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([wide_fingerprint(shingle_hashes(t.as_py(), SKETCH)) for t in b.column(1)], pa.binary())], names=[id_col, "fp"])

    kept = df.select(id_col, F.col(text_col).cast("string"))
    scratch = Scratch()
    fps = scratch.keep(kept.mapInArrow(lean(run), f"`{id_col}` {kept.schema[0].dataType.simpleString()}, fp binary"), "wide")
    distinct = scratch.keep(fps.groupBy("fp").agg(F.min(id_col).cast("long").alias("rep")), "wide-distinct")
    parts = connected_components(similar_pairs(df, distinct.where("rep is not null"), id_col, text_col, words, similarity, scratch), scratch)
    classes = scratch.keep(distinct.join(parts, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("c_fp"), F.coalesce("component", "rep").alias("component_id")), "wide-class")
    return scratch.result(fps.join(classes, F.col("fp") == F.col("c_fp")).select(id_col, "component_id"), "wide-components")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """df with one row kept of each similar group: the one whose id is the smallest.

    Rows that share that id all stay. So do rows without an id, if the text of one of them is in no group that has an id.
    """
    groups = similar_groups(df, id_col, text_col, words, similarity)
    own = prefix(df, "__kept")
    kept = groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(own)).distinct()
    return df.join(kept, F.col(id_col).eqNullSafe(F.col(own)), "left_semi")
