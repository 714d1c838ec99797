"""SentencePiece encoding and decoding by batched numpy Viterbi.

A text is cut into units that no piece can cross: a run of spaces with the word behind it, and single characters that are
not in the vocabulary. Distinct units of equal length advance together: at every end position the hashes of the substrings that end
there (differences of prefix hashes) probe the sorted keys of the pieces, and a vectorised maximum over the candidates stores
the best path's piece as a backpointer.

What is maximised depends on the model file. Unigram: the sum of the pieces' scores; the longer piece wins a tie. BPE: the
scores are merge priorities, whose sum means nothing, but the encoding of a text's prefix ends in exactly one piece,
the longest one that merging leaves standing beside the piece before it; so a candidate counts only if it and the
backpointer at its start are such a pair, and the longest one is kept. The ids are those that the library gives for the
file (for unigram models: a path of the same total score, where several share it).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import lean

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
CACHE = 100_000
SLICE = 2_000_000
LONG = 512
UNKNOWN_PENALTY = 10.0


class Model:
    """Pieces, scores and flags of a model file, in plain arrays that can be broadcast (a vocabulary is bounded)."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models without text normalisation are supported")
        if proto.trainer_spec.model_type not in (1, 2) or not proto.trainer_spec.byte_fallback:
            raise ValueError("only unigram and BPE models with byte fallback are supported")
        kind = pb.ModelProto.SentencePiece
        self.bpe, self.prefix = proto.trainer_spec.model_type == 2, bool(proto.normalizer_spec.add_dummy_prefix)
        self.pieces = [p.piece for p in proto.pieces]
        self.byte_id = np.full(256, -1)
        normal = []
        for i, p in enumerate(proto.pieces):
            if p.type == kind.BYTE:
                self.byte_id[int(p.piece[1:-1], 16)] = i
            elif p.type == kind.NORMAL:
                normal.append(i)
            elif p.type == kind.USER_DEFINED:
                raise ValueError("user-defined pieces are not supported")
        self.control = {i for i, p in enumerate(proto.pieces) if p.type in (kind.CONTROL, kind.UNKNOWN)}
        self.ids = {self.pieces[i]: i for i in normal}
        self.scores = np.array([p.score for p in proto.pieces])
        self.known = {p for p in self.ids if len(p) == 1}
        if any(set(p) - self.known or SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces must be made of single-character pieces and must not cross spaces")
        self.longest = max(map(len, self.ids))
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        self.alone = "".join(c for c in "\t\n\x0b\x0c\r" if c not in joined)  # white space that no longer piece holds ends a unit
        by_length = defaultdict(list)
        for i in normal:
            by_length[len(self.pieces[i])].append(i)
        self.keys = {}
        for n, ids in by_length.items():
            key = _prefix_hashes(_codes([self.pieces[i] for i in ids], n))[:, -1]
            order = np.argsort(key)
            first_bits = np.zeros(1 << 16, bool)
            first_bits[key >> np.uint64(48)] = True
            self.keys[n] = key[order], np.array(ids)[order], first_bits
            if len(np.unique(key)) < len(key):
                raise ValueError("two pieces share a key")

        self.sizes = sorted(self.keys, reverse=True)
        if self.bpe:
            self._splits()

    def encoder(self) -> "Encoder":
        return Encoder(self)

    def _splits(self) -> None:
        """For each piece its last merge's parts and place in the order of merges; for pairs of pieces their union."""
        n, scores = len(self.pieces), self.scores
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        self.rank = np.full(n, -np.inf)  # single characters are there from the start
        self.made = np.zeros(n, bool)
        unions = []
        for piece, i in self.ids.items():
            for at in range(1, len(piece)):
                if (a := self.ids.get(piece[:at])) is not None and (b := self.ids.get(piece[at:])) is not None:
                    unions.append((a * n + b, i))
            if len(piece) == 1:
                self.made[i] = True
                continue
            symbols = list(piece)
            while len(symbols) > 2 and (at := self.best_pair(symbols)) >= 0:
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            if len(symbols) == 2 and symbols[0] in self.ids and symbols[1] in self.ids:
                self.made[i], self.rank[i] = True, -scores[i]
                self.left[i], self.right[i] = self.ids[symbols[0]], self.ids[symbols[1]]
                if max(self.rank[self.left[i]], self.rank[self.right[i]]) >= self.rank[i] and set(piece) != {SPACE}:
                    # parts come before the whole in any trained vocabulary; a piece that breaks this can't be placed
                    self.made[i] = False
        unions.sort()
        self.union_keys, self.union_ids = (np.array(x) for x in zip(*unions)) if unions else (np.zeros(0, np.int64),) * 2

    def best_pair(self, symbols: list[str]) -> int:
        """The place of the neighbours whose union has the highest score, the left one on a tie; -1 if none has one."""
        best, found = -np.inf, -1
        for i in range(len(symbols) - 1):
            p = self.ids.get(symbols[i] + symbols[i + 1])
            if p is not None and self.scores[p] > best:
                best, found = self.scores[p], i
        return found

    def side_by_side(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether no merge across the border of two pieces comes before the merges that make them.

        The merges along the border are undone, the latest first. Each pair of parts that so meet must not have a union
        whose turn would have come before the merge just undone.
        """
        good = self.made[after] & ((before < 0) | self.made[before])
        live = np.flatnonzero(good & (before >= 0))
        x, y, limit = before[live], after[live], np.full(len(live), np.inf)
        while len(live):
            key = x * len(self.pieces) + y
            at = np.minimum(np.searchsorted(self.union_keys, key), len(self.union_keys) - 1)
            crossing = (self.union_keys[at] == key) & (-self.scores[self.union_ids[at]] < limit)
            good[live[crossing]] = False
            last_left = self.rank[x] > self.rank[y]  # on a tie the right one was made later
            step = np.where(last_left, self.rank[x], self.rank[y])
            keep = ~crossing & (step > -np.inf)
            limit = np.where(last_left, step, np.nextafter(step, np.inf))  # a crossing union of equal rank lies further left than the right part's
            x, y = np.where(last_left, self.right[x], x), np.where(last_left, y, self.left[y])
            live, x, y, limit = live[keep], x[keep], y[keep], limit[keep]
        return good


def _codes(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Column i: the polynomial hash of the first i characters, modulo 2^64."""
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * BASE + x[:, i]
    return out


class Encoder:
    def __init__(self, model: Model):
        self.m, self.cache = model, {}
        alone = re.escape(model.alone)
        self.units = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))
        self.pair_keys, self.pair_good = np.full(1 << 20, -1), np.zeros(1 << 20, bool)
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(model.longest, BASE)], dtype=np.uint64)

    def stands(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether merging leaves the two pieces side by side; before -1: whether it makes the piece at all. Remembered in a table of fixed size."""
        key = (before + 1) * len(self.m.pieces) + after
        slot = (key * 0x9E3779B1) & (len(self.pair_keys) - 1)
        new = np.flatnonzero(self.pair_keys[slot] != key)
        good = self.pair_good[slot]
        if len(new):
            good[new] = self.m.side_by_side(before[new], after[new])
            self.pair_keys[slot[new]] = key[new]
            self.pair_good[slot[new]] = good[new]  # of two new pairs in one slot the last is kept, in both arrays
        return good

    def viterbi(self, words: list[str]) -> list[bytes]:
        """The ids of words of equal length whose characters are all known, as 32-bit integers."""
        n, m = len(words[0]), self.m
        h = _prefix_hashes(_codes(words, n))
        rows = np.arange(len(words))
        back = np.full((len(words), n + 1), -1)  # the piece that ends here on the best path
        length = np.zeros((len(words), n + 1), np.int64)
        best = np.zeros((len(words), n + 1))
        for end in range(1, n + 1):
            best[:, end] = -np.inf
            open_rows = rows
            for size in m.sizes:
                if size > end or not len(open_rows):
                    continue
                keys, ids, first_bits = m.keys[size]
                key = h[open_rows, end] - h[open_rows, end - size] * self.power[size]
                hit = np.flatnonzero(first_bits[key >> np.uint64(48)])  # most substrings are no piece: seen without a search
                if not len(hit):
                    continue
                at = np.minimum(np.searchsorted(keys, key[hit]), len(keys) - 1)
                same = keys[at] == key[hit]
                hit, at = hit[same], at[same]
                r, piece = open_rows[hit], ids[at]
                if m.bpe:
                    good = self.stands(back[r, end - size], piece)
                else:
                    score = best[r, end - size] + m.scores[piece]
                    good = score > best[r, end]
                    best[r[good], end] = score[good]
                back[r[good], end], length[r[good], end] = piece[good], size
                if m.bpe:
                    open_rows = np.delete(open_rows, hit[good])
        out, steps, at, live = np.zeros((len(words), n), np.int32), np.zeros(len(words), np.int64), np.full(len(words), n), rows
        while len(live):  # every live row yields one piece a step, from its end on
            out[live, n - 1 - steps[live]] = back[live, at[live]]
            steps[live] += 1
            at[live] -= length[live, at[live]]
            live = live[at[live] > 0]
        return [row[n - k :].tobytes() for row, k in zip(out, steps.tolist())]

    def learn(self, units: Iterable[str]) -> None:
        """Put the units' ids in the cache."""
        known, long_spaces, by_length, odd = self.m.known, SPACE * 3, defaultdict(set), {}
        for u in units:
            if known.issuperset(u):
                by_length[len(u)].add(u)
                continue
            odd[u] = runs = [""]
            for c in u:
                if c not in known:
                    runs += [c, ""]
                else:
                    runs[-1] += c
            for run in runs[::2]:
                by_length[len(run)].add(run)
        by_length.pop(0, None)
        for words in by_length.values():
            words = list(words)
            if self.m.bpe:  # merged one by one: very long words, and long runs of spaces, whose pieces share one score
                alone = {w for w in words if len(w) > LONG or long_spaces in w}
                self.cache.update((w, self.merge_long(w)) for w in alone)
                words = [w for w in words if w not in alone]
            for at in range(0, len(words), 8192):
                part = words[at : at + 8192]
                self.cache.update(zip(part, self.viterbi(part)))
        self.cache[""] = b""
        for u, runs in odd.items():
            self.cache[u] = b"".join(self.m.byte_id[list(r.encode("utf-8", "surrogatepass"))].astype(np.int32).tobytes() if i % 2 else self.cache[r] for i, r in enumerate(runs))

    def merge_long(self, word: str) -> bytes:
        """Merging with a heap: for words that are very long or have long runs of spaces."""
        import heapq

        ids, scores, n = self.m.ids, self.m.scores, len(word)
        text, left, right = list(word), list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (p := ids.get(text[a] + text[b])) is not None:
                heapq.heappush(heap, (-scores[p], a, b, text[a] + text[b]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, union = heapq.heappop(heap)
            if not text[a] or not text[b] or text[a] + text[b] != union or right[a] != b:
                continue
            text[a], text[b] = union, ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return np.array([ids[t] for t in text if t], np.int32).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit integers; null and empty texts have none."""
        cut = [self.units.findall(self.spaced(t)) if t and len(t) <= SLICE else [] for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        self.learn({u for units in cut for u in units if u not in self.cache})
        out = [b"".join(map(self.cache.__getitem__, units)) for units in cut]
        for i, t in enumerate(texts):
            if t and len(t) > SLICE:
                out[i] = self.encode_long(t)
        return out

    def spaced(self, text: str) -> str:
        return (SPACE if self.m.prefix else "") + text.replace(" ", SPACE)

    def encode_long(self, text: str) -> bytes:
        """One text's ids, a bounded number of units at a time."""
        found, out = (m.group() for m in self.units.finditer(self.spaced(text))), []
        while part := list(islice(found, 200_000)):
            if len(self.cache) > CACHE:
                self.cache.clear()
            self.learn({u for u in part if u not in self.cache})
            out.append(b"".join(map(self.cache.__getitem__, part)))
        return b"".join(out)


def decode(model: Model, ids: np.ndarray) -> str:
    """The text of ids: pieces joined, byte pieces read as UTF-8 (bytes that are none become U+FFFD), control pieces left out."""
    raw = b"".join(map(_table(model).__getitem__, ids.tolist()))
    text = raw.decode("utf-8", "replace") if b"\xed" not in raw else raw.decode("utf-8", "surrogatepass" if _surrogates(raw) else "replace")
    return text[1:] if model.prefix and text.startswith(" ") else text


def _surrogates(raw: bytes) -> bool:
    try:
        raw.decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return False
    return True


_TABLES: dict[int, list[bytes]] = {}


def _table(model: Model) -> list[bytes]:
    if id(model) not in _TABLES:
        _TABLES.clear()
        own = [b"" if i in model.control else p.replace(SPACE, " ").encode() for i, p in enumerate(model.pieces)]
        for byte, i in enumerate(model.byte_id):
            if i >= 0:
                own[i] = bytes([byte])
        _TABLES[id(model)] = own
    return _TABLES[id(model)]


def _slices(b: pa.RecordBatch, at: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about `size` bytes together, so that their units fit in memory; one row at least."""
    first, held = 0, 0
    for i, n in enumerate(pc.binary_length(b.column(at)).fill_null(0).to_numpy(zero_copy_only=False).tolist()):
        held += n
        if held >= size:
            yield b.slice(first, i + 1 - first)
            first, held = i + 1, 0
    if first < b.num_rows:
        yield b.slice(first)


def encode_column(df: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None, check_col: str | None = None) -> DataFrame:
    """df's columns (or those of `keep`) and the column ids_col, the ids of each whole text; null texts have null ids, empty ones none.

    check_col, if named, is a column that tells whether the ids decode to the text (for null texts: true). Columns of these names
    that are already there are replaced. Repeated rows get the same ids; an empty table gives no rows.
    """
    df = df.drop(*[c for c in (ids_col, check_col) if c])
    kept = [c for c in (keep or df.columns) if c in df.columns]
    df = df.select(*kept, *([] if text_col in kept else [text_col]))
    names = [*kept, ids_col, *([check_col] if check_col else [])]
    at, n, model = df.columns.index(text_col), len(kept), df.sparkSession.sparkContext.broadcast(Model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        encoder = own.encoder()
        for whole in batches:
            for b in _slices(whole, at):
                texts = b.column(at).to_pylist()
                found = encoder.encode(texts)
                offsets = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
                cols = [*b.columns[:n], pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)), mask=pa.array([t is None for t in texts]))]
                if check_col:
                    cols.append(pa.array([t is None or decode(own, np.frombuffer(x, np.int32)) == t.replace(SPACE, " ") for t, x in zip(texts, found)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(lean(run), f"{_ddl(df.select(*kept))}`{ids_col}` array<int>" + (f", `{check_col}` boolean" if check_col else ""))


def _ddl(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)


def decode_column(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df and the column text_col, the text of each row's ids; null ids have a null text. An old text_col is replaced."""
    df = df.drop(text_col)
    names = [*df.columns, text_col]
    at, model = names.index(ids_col), df.sparkSession.sparkContext.broadcast(Model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                b = whole.slice(first, 1024)
                texts = [None if not v.is_valid else decode(own, v.values.to_numpy(zero_copy_only=False)) for v in b.column(at)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=names)

    return df.mapInArrow(run, f"{_ddl(df)}`{text_col}` string")
