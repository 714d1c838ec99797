"""The ten operators against brute force, round trips, held-out accuracy and odd rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from palimpsest.llm import ann, common, langid, mixing, quality, sentencepiece, sharding, simhash, suffix_dedup, topk, urls
from palimpsest.llm.entry import BAD_HOST_WORDS, PIECE_MODEL, URL_RULES

from ..oracle import duck, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names used inside the operators.
CLASH = ["fp", "rep", "key", "h", "s", "part", "list", "vec", "id", "rank", "score", "ids", "copy_", "c1", "c2", "u", "v", "node", "cell", "depth", "q", "b", "kept_id", "mix_source", "mix_n", "copy", "shuffle_key", "dup_spans", "dup_k1", "shard", "outer", "raw", "sample", "wanted"]


def docs(spark, texts, **more):
    rows = [(i, t, more.get("lang", ["en"] * len(texts))[i], more.get("source", ["a"] * len(texts))[i], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(4)
    words = ["the", "of", "quay", "ship", "rain", "paper", "river", "stone", "and", "to", "in", "letter", "harbour", "wind", "a"]
    return lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "s", "ed"]) for _ in range(n))


@pytest.mark.parametrize("name", ["op2_shards", "op6_mix", "op8_topk"])
def test_equals_sql(spark, sf, name):
    same(entry.queries()[name](spark, sf), duck(sf), entry.oracle_sql()[name])


# shared


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(500, x) for x in range(200, 240)] + [(7, 7)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for p in pairs for x in p if p[0] != p[1]}


def test_components_of_nothing(spark):
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# 1 and 8: searches


def vectors(spark, n, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[n // 3 : n // 2] = x[0]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(n, None), (n + 1, [0.0] * dim), (n + 2, [math.nan] * dim), (n + 3, [None] + [1.0] * (dim - 1)), (n + 4, [math.inf] * dim)]
    return x.astype(np.float64), spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_topk_is_exact(spark):
    x, df = vectors(spark, 700)
    t = np.floor(256 * x).astype(np.int64)
    t = np.vstack([t, np.zeros((1, 16), np.int64)])
    ids = np.r_[np.arange(700), 701]
    got = {}
    for r in topk.top_k(clashing(df), "vec_id", "embedding", F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r["id"], r.score))
    for q in range(0, 700, 50):
        s = t @ t[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        assert sorted(got[q]) == [(k + 1, int(ids[i]), int(s[i])) for k, i in enumerate(order)]
    assert set(got) == set(range(0, 700, 50))


def test_topk_prunes():
    rng = np.random.default_rng(0)
    rows = np.repeat(rng.integers(-50, 50, (40, 16)) * 20, 128, axis=0) + rng.integers(-3, 4, (40 * 128, 16))
    q = rows[[5]]
    [(_, ids, scores, blocks)] = list(topk.search_block(np.array([-1]), q, np.array([-np.inf]), np.arange(len(rows)), rows, 5))
    want = np.lexsort((np.arange(len(rows)), -(rows @ q[0])))[:5]
    assert sorted(ids) == sorted(want) and blocks < 40


def test_large_integers_are_exact():
    rows = np.array([[2**40, 1], [2**40, 2]], np.int64)
    [(_, ids, scores, _)] = list(topk.search_block(np.array([9]), np.array([[2**20, 1]], np.int64), np.array([-np.inf]), np.arange(2), rows, 1))
    assert ids.tolist() == [1] and scores.tolist() == [2**60 + 2]


def test_ann_of_huge_and_tiny_components(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 1.1e-200]), (2, [1.0, 0.0]), (3, [3e-310, 3e-310]), (4, [1e300, -1e300])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["id"] for r in got] == [3, 1, 2, 4]
    assert all(abs(r.score - s) < 1e-9 for r, s in zip(got, (1.0, 2.1 / math.sqrt(2 * 2.21), math.sqrt(0.5), 0.0)))


def test_topk_of_huge_components(spark):
    schema = "vec_id long, embedding array<double>"
    search = lambda rows: topk.top_k(spark.createDataFrame(rows, schema), "vec_id", "embedding", F.lit(True)).orderBy("query_id", "rank").collect()
    with pytest.raises(Exception, match="range of a long"):
        search([(0, [1e30, 1.0]), (1, [1.0, 1.0])])
    with pytest.raises(Exception, match="range of a long"):  # each term fits, their product doesn't
        search([(0, [1e12, 1.0]), (1, [1e12, 1.0])])
    got = search([(0, [2.0**40, 1.0]), (1, [2.0**-4, 0.5]), (2, [2.0**-4, 1.0])])
    assert [(r.query_id, r["id"], r.score) for r in got if r.query_id == 0] == [(0, 2, 2**52 + 2**16), (0, 1, 2**52 + 2**15)]


@pytest.mark.parametrize("size,slab", [(64, 7), (500, 10**6)])
def test_topk_over_superblocks(spark, monkeypatch, size, slab):
    """Superblocks, slabs and bounds rule out nothing that counts."""
    monkeypatch.setattr(topk, "SUPER", size)
    monkeypatch.setattr(topk, "LEAST_SUPER", size)
    monkeypatch.setattr(topk, "SLAB", slab)
    monkeypatch.setattr(topk, "TOPS_BYTES", 2000)
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(30, 8)), 30, axis=0) * 3 + rng.normal(size=(900, 8)) * 0.1
    x[:300] = x[0]  # a third of the rows are one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r["id"], r.score))
    t = np.floor(256 * x).astype(np.int64)
    for q in range(0, 900, 20):
        s = t @ t[q]
        order = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:5]
        assert sorted(got[q]) == [(n + 1, int(i), int(s[i])) for n, i in enumerate(order)]


def test_ann_recall_and_scores(spark):
    x, df = vectors(spark, 3000)
    got = {}
    for r in ann.search(clashing(df), "vec_id", "embedding", F.col("vec_id") % 50 == 0, list_rows=50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["id"], r.score))
    hits = 0
    n = np.sqrt((x * x).sum(1))
    for q in range(0, 3000, 50):
        s = np.array([(x[i] * x[q]).sum() / (n[i] * n[q]) for i in range(3000)])
        order = [i for i in np.lexsort((np.arange(3000), -s.round(12))) if i != q][:5]
        hits += len(set(order) & {i for i, _ in got[q]})
        assert all(abs(v - s[i]) < 1e-12 for i, v in got[q]) and len(got[q]) == 5 and q not in dict(got[q])
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
    assert hits / (60 * 5) >= 0.9


@pytest.mark.parametrize("search", [lambda df: ann.search(df, "vec_id", "embedding", F.lit(True)), lambda df: topk.top_k(df, "vec_id", "embedding", F.lit(True))])
def test_search_small_and_empty(spark, search):
    schema = "vec_id long, embedding array<float>"
    assert search(spark.createDataFrame([], schema)).count() == 0
    assert search(spark.createDataFrame([(0, [1.0, 2.0])], schema)).count() == 0
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [1.0, 2.0]), (None, [1.0, 2.0])]  # every row but the query's own is a candidate
    got = search(spark.createDataFrame(rows, schema).repartition(3)).collect()
    want = {0: [50, 50, None], 50: [0, 50, None], None: [0, 50, 50]}
    assert sorted(map(repr, ((r.query_id, r["rank"], r["id"]) for r in got))) == sorted(map(repr, ((q, i + 1, x) for q in (0, 50, 50, None) for i, x in enumerate(want[q]))))


def test_graph_finds_nearest_centroids():
    rng = np.random.default_rng(2)
    c = ann.unit(rng.normal(size=(500, 16))).astype(np.float32)
    q = ann.unit(rng.normal(size=(50, 16))).astype(np.float32)
    ids, far = ann.beam(q, c, ann.link(c), 32)
    want = np.argsort(-(q @ c.T), axis=1)[:, :8]
    assert np.mean([len(set(a) & set(b[:8])) / 8 for a, b in zip(want, ids)]) > 0.9 and (np.diff(far, axis=1) >= -1e-5).all()


# 2: shards


def brute_shards(rows, limit):
    """(depth, prefix) of each row (id, bytes) by splitting buckets from the root."""
    h = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i, _ in rows}
    out, todo = {}, [(0, 0, rows)]
    while todo:
        d, p, mine = todo.pop()
        if sum(n for _, n in mine) <= limit or len(mine) == 1:
            out |= {i: (d, str(p)) for i, _ in mine}
        else:
            for bit in (0, 1):
                part = [r for r in mine if h[r[0]] >> (59 - d) & 1 == bit]
                if part:
                    todo.append((d + 1, 2 * p + bit, part))
    return out


@pytest.mark.parametrize("limit", [1, 40, 300, 10**6])
def test_shards(spark, limit):
    rng = random.Random(limit)
    texts = ["é" * rng.randrange(30) for _ in range(120)] + [None, "", "x" * 500]
    got = {r.doc_id: (r.depth, r.prefix) for r in sharding.shards(clashing(docs(spark, texts)), limit).collect()}
    assert got == brute_shards([(i, len((t or "").encode())) for i, t in enumerate(texts)], limit)


def test_hot_key_is_split(spark):
    df = spark.createDataFrame([(7, "x" * 10)] * 60 + [(None, "y" * 10)] * 30 + [(i, "z") for i in range(100, 130)], "doc_id long, text string")
    got = sharding.shards(df, 50).collect()
    assert len(got) == 120 and all(r.shard_bytes <= 50 for r in got)
    sizes = {}
    for r in got:
        sizes.setdefault((r.depth, r.prefix), []).append(r.n_bytes)
    assert all(sum(v) <= 50 for v in sizes.values()) and max(k[0] for k in sizes) > 60


def test_no_shards(spark):
    assert sharding.shards(docs(spark, []), 10).count() == 0


def test_write_shards_of_odd_ids(spark, tmp_path):
    df = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c" * 30), (1, "d"), (2, None)], "doc_id long, text string")
    sharding.write_shards(df, f"file://{tmp_path}/out", 4)
    assert sorted(map(repr, spark.read.parquet(f"file://{tmp_path}/out").select(*df.columns).collect())) == sorted(map(repr, df.collect()))


def test_write_shards(spark, tmp_path):
    sharding.write_shards(docs(spark, ["abc" * i for i in range(20)]), f"file://{tmp_path}/out", 60)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 20 and len(list((tmp_path / "out").glob("shard=*"))) > 5


# 3: pieces


@pytest.fixture(scope="module")
def encoder():
    return sentencepiece.Model(PIECE_MODEL).encoder()


@pytest.fixture(scope="module")
def library():
    import sentencepiece as lib

    return lib.SentencePieceProcessor(model_file=PIECE_MODEL)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdeth ion  \n\téß★漢😀.,1")) | st.characters(codec="utf-8"), max_size=60))
def test_ids_equal_the_library(encoder, library, t):
    ids = np.frombuffer(encoder.encode([t])[0], np.int32)
    assert ids.tolist() == library.encode(t)
    assert sentencepiece.decode(encoder.m, ids) == t.replace("▁", " ")


@pytest.mark.parametrize("t", ["", " ", " " * 70, "   a    b", "x" * 5000, "antidisestablishmentarianism" * 40, "\x00\x01", "naïve ▁ x"])
def test_odd_texts(encoder, library, t):
    ids = np.frombuffer(encoder.encode([t])[0], np.int32)
    assert ids.tolist() == library.encode(t) and sentencepiece.decode(encoder.m, ids) == t.replace("▁", " ")


def test_very_long_texts(encoder, library, monkeypatch):
    monkeypatch.setattr(sentencepiece, "SLICE", 1000)
    text = "the ship  and the harbour\n" * 300 + "x" * 3000
    assert np.frombuffer(encoder.encode([text, "a"])[0], np.int32).tolist() == library.encode(text)


def test_unigram_paths_are_the_best(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(PIECE_MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    own = sentencepiece.Model(str(path))

    def best(word):
        top = [0.0] + [-math.inf] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                if (i := own.ids.get(word[start:end])) is not None:
                    top[end] = max(top[end], top[start] + own.scores[i])
        return top[-1]

    for t in ["fox", "internationalization", "unbelievable words of the quay", "aaaaaaaaaaaa"]:
        [got] = own.encoder().encode([t])
        assert sum(own.scores[i] for i in np.frombuffer(got, np.int32)) == sum(best("▁" + w) for w in t.split(" "))
        assert sentencepiece.decode(own, np.frombuffer(got, np.int32)) == t


def test_columns(spark):
    df = clashing(docs(spark, ["hello world", None, "", "hello world"]))
    got = sentencepiece.decode_column(sentencepiece.encode_column(df, PIECE_MODEL, check_col="ok"), PIECE_MODEL).orderBy("doc_id").collect()
    assert [r.decoded for r in got] == ["hello world", None, "", "hello world"] and all(r.ok for r in got) and got[1].ids is None and got[2].ids == [] and got[0].ids == got[3].ids
    assert sentencepiece.encode_column(docs(spark, []), PIECE_MODEL).count() == 0


def test_query_round_trips(spark, sf, library):
    got = entry.queries()["op3_sentencepiece"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.round_trip and r.n_tokens == len(library.encode(texts[r.doc_id])) for r in got) and len(got) == len(texts)


# 4: repeated strings


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.fixture(scope="module")
def repetitive(prose):
    rng = random.Random(8)
    passage, line = prose(40), "all of the paper and the stone"
    texts = [prose(rng.randrange(5, 60)) for _ in range(40)]
    for i in range(20):
        at = rng.randrange(len(texts[i]))
        texts[i] = texts[i][:at] + " " + passage[rng.randrange(30) :] + " " + texts[i][at:]
    texts += [t + "\n" + line for t in texts[20:30]] + [texts[30]] * 5 + ["ab" * 150, "é" * 90, "x" * 100, None, "", "short", (prose(30) + " ") * 2, prose(300)]
    texts[35] = texts[36][:80] + texts[35][80:]
    return texts


@pytest.mark.parametrize("hot,most", [(4096, 10**6), (2, 10**6), (4096, 0)])
def test_repeats(spark, repetitive, hot, most):
    df = clashing(docs(spark, repetitive)).repartition(3)
    found = suffix_dedup.repeated_spans(df, "text", 60, 40, hot, most)
    assert found.columns == [*[c for c in df.columns if c != "dup_spans"], "dup_spans"]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(found).collect()}
    assert got == dict(enumerate(brute_repeats(repetitive, 60)))


def test_blocks_of_long_texts(monkeypatch, spark, prose):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    suffix_dedup._powers.cache_clear()
    text = prose(200).encode()
    cut = suffix_dedup.segments(text, 60, 40)
    suffix_dedup._powers.cache_clear()
    starts = sorted(p for lo, n in zip(cut[2], cut[3]) for p in range(lo, lo + n - 59))
    assert starts == list(range(len(text) - 59))  # every window lies in exactly one segment


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=8, max_size=40).map(lambda b: bytes(x % 2 for x in b)), min_size=1, max_size=6))
def test_matching_statistics(parts):
    text = np.array([c for p in parts for c in [*(x + 1 for x in p), 0]])
    starts = np.cumsum([0, *(len(p) + 1 for p in parts)])[:-1]
    got = suffix_dedup.matching_statistics(text, starts, 63)
    n = len(text)
    for i in range(n):
        best = 0
        for j in range(n):
            if j != i:
                k = 0
                while i + k < n and j + k < n and text[i + k] == text[j + k]:
                    k += 1
                best = max(best, k)
        most = 63 - (i - max(s for s in starts if s <= i))
        assert min(got[i], most) == min(best, most)


@pytest.mark.parametrize("gram,length,n", [(16, 20, 250), (45, 56, 150), (300, 400, 25)])
def test_index_misses_nothing(gram, length, n):
    """Distinct segments of random, near-constant and periodic text, and cuttings of one text."""
    rng = random.Random(length)

    def text(k):
        kind = rng.randrange(4)
        unit = bytes(rng.randrange(3) for _ in range((k, 1, rng.randrange(2, 9), k)[kind]))
        out = bytearray((unit * k)[:k])
        for _ in range(rng.randrange(3) if kind else 0):
            out[rng.randrange(k)] = 7
        return bytes(out)

    for _ in range(n):
        pool, parts = text(8 * length), set()
        for _ in range(rng.randrange(2, 30)):
            k = rng.randrange(length, 2 * length - gram + 1)
            at = rng.randrange(len(pool) - k)
            parts.add(pool[at : at + k] if rng.random() < 0.7 else text(k))
        parts = sorted(parts)
        count = {}
        for p in parts:
            for i in range(len(p) - length + 1):
                count[p[i : i + length]] = count.get(p[i : i + length], 0) + 1
        for p, found in zip(parts, suffix_dedup.index_matches(parts, length)):
            want, got = np.zeros(len(p), bool), np.zeros(len(p), bool)
            for i in range(len(p) - length + 1):
                want[i : i + length] |= count[p[i : i + length]] > 1
            for a, z in found:
                got[a:z] = True
            assert (got == want).all()


def test_index_is_run_compressed(prose):
    text = np.frombuffer((prose(400) * 4).encode(), np.uint8).astype(np.int64) + 1
    _, order = suffix_dedup.suffix_ranks(text, 400)
    before = text[order - 1]
    assert (before[1:] != before[:-1]).sum() < len(text) / 3


def test_remove_repeats_keeps_rows(spark, repetitive):
    df = docs(spark, repetitive)
    out = suffix_dedup.remove_repeats(df, "text", 60, 40)
    assert out.columns == df.columns and out.count() == len(repetitive)
    gone = {i: b for i, (_, b, _, _) in enumerate(brute_repeats(repetitive, 60))}
    for r in out.collect():
        assert (r.text is None) == (repetitive[r.doc_id] is None)
        if not gone[r.doc_id]:
            assert r.text == repetitive[r.doc_id]


def test_repeats_of_nothing(spark):
    assert suffix_dedup.digest(suffix_dedup.repeated_spans(docs(spark, []))).count() == 0


# 5: languages


def test_language_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in entry.queries()["op5_langid"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {r.doc_id for r in held} == {i for i, g in got.items() if g.held_out}
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= g.score <= 1 for g in got.values())


def test_language_is_brute_force(spark, sf):
    """The query against each window's filters, maxima and softmax worked out one by one, with the model that it learns."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    df = spark.createDataFrame([tuple(r) for r in rows if not held[r.doc_id]], "doc_id long, text string, lang string")
    net = langid.fit(df, "doc_id", "text", "lang")
    got = {r.doc_id: r for r in entry.queries()["op5_langid"](spark, sf).collect()}
    wide = max(langid.WIDTHS)
    for r in sorted(rows, key=lambda r: len(r.text or ""))[:60]:
        g, raw = got[r.doc_id], (r.text or "").encode()
        if not any(c.isalpha() for c in r.text or ""):
            assert (g.lang_pred, g.score) == ("und", 0.0)
            continue
        total, weight, at = np.zeros(len(net.labels)), 0, 0
        while True:
            piece = raw[at : at + langid.WINDOW].ljust(langid.WINDOW, b"\0")
            top = [max(0.0, max(float(sum(net.embed[piece[i + j]] @ net.conv[j * langid.DIM : (j + 1) * langid.DIM, f] for j in range(wide))) for i in range(langid.STRIDE)) + net.bias[f]) for f in range(len(net.bias))] if at < 2 * langid.STRIDE else np.maximum((net.pooled(np.frombuffer(piece, np.uint8)[None])[1]).max(axis=1)[0] + net.bias, 0)
            z = np.array(top) @ net.out + net.last
            z = np.exp(z - z.max())
            last = at + langid.WINDOW >= len(raw)
            new = max(1, len(raw) - at) if last else langid.STRIDE
            total, weight, at = total + new * z / z.sum(), weight + new, at + langid.STRIDE
            if last:
                break
        assert g.held_out == held[r.doc_id] and g.lang_pred == net.labels[int(total.argmax())] and abs(g.score - total.max() / weight) < 1e-3


def test_language_odd_rows(spark):
    texts = ["the ship and the harbour of the wind"] * 20 + ["das schiff und der hafen für den wind"] * 20
    df = docs(spark, texts, lang=["en"] * 20 + ["de"] * 20)
    model = langid.fit(df, "doc_id", "text", "lang")
    odd = docs(spark, [None, "", "123 !!", "и", "the wind and the ship " * 40_000, "the ship", "the ship"])
    got = [(r.lang_pred, r.score) for r in langid.predict(clashing(odd.drop("lang")), model).orderBy("doc_id").collect()]
    assert got[:3] == [("und", 0.0)] * 3 and got[3][0] in ("en", "de") and got[4][0] == "en" and got[5] == got[6]
    assert langid.predict(docs(spark, []), model).count() == 0
    assert langid.fit(docs(spark, []), "doc_id", "text", "lang") is None
    assert [r.lang_pred for r in langid.predict(docs(spark, ["a"]), None).collect()] == ["und"]


def test_windows_cover_every_byte():
    for n in (1, 127, 128, 129, 252, 253, 1000):
        w, weight = langid.windows(bytes(range(256))[:1] * n)
        assert weight.sum() == n and (w > -1).all() and (len(w) - 1) * langid.STRIDE + langid.WINDOW >= n


# 6: mixing


def test_mix_rates(spark):
    df = docs(spark, ["x" * 100] * 3000, source=["big"] * 2700 + ["small"] * 300)
    got = {r.source: r["count"] for r in mixing.mix(clashing(df), weights={"big": 1.0, "small": 1.0}).groupBy("source").count().collect()}
    assert abs(got["big"] - 1500) < 200 and abs(got["small"] - 1500) < 200


def test_mix_is_poisson(spark):
    df = docs(spark, ["x"] * 4000)
    n = np.array([r.n for r in mixing.mix(df, epochs=3.0).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()])
    n = np.r_[n, np.zeros(4000 - len(n), int)]
    assert abs(n.mean() - 3) < 0.15 and abs(n.var() - 3) < 0.35


def test_mix_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", None), (None, "abc", "s"), (None, "abc", "s"), (3, "abc" * 10_000, "s"), (3, "abc" * 10_000, "s")], "doc_id long, text string, source string")
    out = mixing.mix(df, epochs=4.0)
    assert out.columns == [*df.columns, "copy", "shuffle_key"] and mixing.mix(clashing(df)).count() >= 0
    again = sorted(map(repr, out.collect()))
    assert again == sorted(map(repr, mixing.mix(df, epochs=4.0).collect()))
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, ["a"]), weights={}).count() == 0


def test_mix_order_is_global(spark):
    keys = [r.shuffle_key for r in mixing.mix(docs(spark, ["x"] * 500)).collect()]
    assert keys == sorted(keys)


def test_large_rates(spark):
    [r] = spark.createDataFrame([(900.0,)], "r double").select(mixing.poisson_cdf(F.col("r")).alias("c")).collect()
    assert abs(r.c[-1] - 1) < 1e-9 and abs(r.c[900] - 0.5) < 0.02
    out = mixing.mix(docs(spark, ["a" * 100] * 300 + ["b"], source=["s"] * 300 + ["t"]), weights={"t": 1.0})
    assert 3 * mixing.MAX_RATE < 30_001 and abs(out.count() - 30_001) < 6 * math.sqrt(30_001) and out.where("source = 's'").isEmpty()


def test_mix_of_a_tiny_source(spark):
    text = "a" * 500_000
    out = mixing.mix(docs(spark, [text] * 1000 + ["b"], source=["s"] * 1000 + ["t"]))
    rate = (500_000_001 / (math.sqrt(500_000_000) + 1)) / 1
    assert rate > 2 * mixing.MAX_RATE
    got = out.where("source = 't'").agg(F.count(F.lit(1)), F.countDistinct("copy"), F.max("copy")).first()
    assert got[0] == got[1] == got[2] and abs(got[0] - rate) < 6 * math.sqrt(rate)


def test_mix_has_no_python(spark, sf):
    plan = entry.queries()["op6_mix"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# 7: URLs


def test_url_query(spark, sf):
    got = {r.page_id: r for r in entry.queries()["op7_urls"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect():
        g, host, path = got[r.page_id], "", ""
        if r.url and "://" in r.url:
            rest = r.url.split("://", 1)[1]
            end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
            path = rest[end:].split("?")[0].split("#")[0]
        fits = [(len(x), x, v) for v, x in URL_RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith(x[x.index("/") :])]
        want = max(fits, default=(0, None, None))
        assert (g.host, g.path, g.rule) == (host, path, want[1])
        assert g.verdict == want[2] if want[2] else g.verdict in ("allow", "block")
        if not want[2]:
            assert (g.verdict == "block") == any(w in host.replace("-", ".").split(".") for w in BAD_HOST_WORDS)


@pytest.mark.parametrize("url,want", [(None, ("", "")), ("no scheme/x", ("", "")), ("HTTP://A.Com", ("a.com", "")), ("x://H?q#f", ("h", "")), ("x://h#f/g", ("h", "")), ("x://É.Com/Pä?x=://y", ("É.com", "/Pä")), ("://", ("", "")), ("", ("", ""))])
def test_split(url, want):
    assert urls.split(url) == want


def test_url_odd_rows(spark):
    rows = [(i, f"http://good{i % 7}.example.com/a/{i}") for i in range(200)] + [(1000 + i, f"http://win-casino{i}.example.net/x?p={i}&q=1") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    model = urls.fit(df.withColumn("bad", F.col("url").contains("casino").cast("int")), "url", "bad")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x://"), (4, "http://win-casino99.example.net/x?p=1&q=1"), (5, "http://good1.example.com/a/7"), (5, "http://good1.example.com/a/7"), (6, "http://a/" + "b" * 200_000)], "page_id long, url string")
    got = sorted((r.page_id, r.verdict, r.rule) for r in urls.judge(clashing(odd), model, [("block", "a/")]).collect())
    assert got[3][1] == "block" and got[4] == got[5] == (5, "allow", None) and got[6] == (6, "block", "a/")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), model, []).count() == 0
    assert urls.fit(spark.createDataFrame([], "url string, bad int"), "url", "bad").probability(["http://x/"]).tolist() == [0.0]


def test_urls_of_hosts_never_seen():
    """Trained without a third of the hosts, the trees tell those hosts' URLs apart by their looks; a list of the hosts seen would tell none."""
    import pyarrow.parquet as pq

    rows = [u for u in pq.read_table("/root/testdata/sf0.1/pages.parquet", columns=["url"])["url"].to_pylist() if u]
    hosts = [urls.split(u)[0] for u in rows]
    bad = np.array([any(w in h.replace("-", ".").split(".") for w in BAD_HOST_WORDS) for h in hosts])
    found = []
    for salt in range(4):
        seen = np.array([zlib.crc32(f"{salt}{h}".encode()) % 3 != 0 for h in hosts])
        if bad[seen].any() and bad[~seen].any():
            model = urls.UrlModel([u for u, s in zip(rows, seen) if s], bad[seen].astype(int).tolist())
            got = model.probability([u for u, s in zip(rows, seen) if not s]) >= 0.5
            found.append((got[bad[~seen]].mean(), (~got[~bad[~seen]]).mean()))
    blocked, allowed = np.mean(found, axis=0)
    assert len(found) > 1 and blocked > 0.85 and allowed > 0.98


def test_trees_are_the_plain_ones():
    """The first tree's root is the best split of all, and a row's score is the sum of the leaves that it falls to."""
    rng = np.random.default_rng(2)
    x = np.stack([rng.integers(0, 6, 300), rng.integers(0, 9, 300), rng.integers(0, 3, 300)], axis=1).astype(float)
    y = ((x[:, 1] > 4) ^ (rng.random(300) < 0.1)).astype(int)
    t = urls.Trees().train(x, y)
    w = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * 300
    g, h = w * (y - 0.5), w * 0.25
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
    best = max(((gain(x[:, j] < e), j) for j in range(3) for e in t.edges[j]))
    feature, cut = t.trees[0][0][0]
    assert feature[0] == best[1] and abs(gain(x[:, feature[0]] < t.edges[feature[0]][cut[0]]) - best[0]) < 1e-9
    for row, p in zip(x, t.probability(x)):
        z = 0.0
        for plan, leaf in t.trees:
            node = 0
            for feature, cut in plan:
                j = feature[node]
                node = 2 * node + int(sum(row[j] >= e for e in t.edges[j]) > cut[node])
            z += leaf[node]
        assert abs(p - 1 / (1 + math.exp(-z))) < 1e-9


# 9: quality


def test_quality_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.keep for r in entry.queries()["op9_quality"](spark, sf).collect()}
    told = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good, bad = [got[r.doc_id] for r in told if r.quality == 1], [got[r.doc_id] for r in told if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05


def test_quality_is_brute_force(spark, sf):
    """The query against patterns, expectation-maximisation and scores worked out one by one."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    read = {r.doc_id: quality.Read(r.text) for r in rows}
    pattern = {i: quality.votes(t) for i, t in read.items()}
    digits = lambda c: [c // 3**j % 3 for j in range(quality.LABELLERS)]
    p = {c: 0.9 if digits(c).count(2) > 4 * digits(c).count(1) else 0.1 for c in set(pattern.values())}
    for _ in range(100):
        good = min(0.98, max(0.02, sum(p[c] for c in pattern.values()) / len(pattern)))
        told = [[[0.5, 0.5] for _ in range(quality.LABELLERS)] for _ in range(2)]
        for c in pattern.values():
            for j, v in enumerate(digits(c)):
                if v:
                    told[1][j][v - 1] += p[c]
                    told[0][j][v - 1] += 1 - p[c]
        odds = {c: math.log(good / (1 - good)) + sum(math.log(told[1][j][v - 1] / sum(told[1][j])) - math.log(told[0][j][v - 1] / sum(told[0][j])) for j, v in enumerate(digits(c)) if v) for c in p}
        new = {c: 1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) for c, z in odds.items()}
        done = max(abs(new[c] - p[c]) for c in p) < 1e-6
        if done:
            break
        p = new
    kept = [quality._read_numbers(*quality._numbers(*quality.features(read[r.doc_id]))) for r in rows]
    scorer = quality.Scorer(kept, np.array([p[pattern[r.doc_id]] for r in rows]))
    got = {r.doc_id: r for r in entry.queries()["op9_quality"](spark, sf).collect()}
    assert len(got) == len(rows)
    for r, (index, value) in zip(rows, kept):
        g, there = got[r.doc_id], bool(read[r.doc_id].words)
        score = 1 / (1 + math.exp(-sum(scorer.weight[i] * v for i, v in zip(index, value)))) if there else 0.0
        assert abs(g.posterior - p[pattern[r.doc_id]] * there) < 1e-3 and abs(g.score - score) < 1e-3 and g.keep == (g.score >= 0.5)


def test_quality_odd_rows(spark, prose):
    texts = [prose(60) for _ in range(80)] + ["BUY!! NOW!! CHEAP!! " * 20] * 10 + ["$$$ %%% &&& ### " * 20] * 10 + [None, "", "  \n"]
    df = docs(spark, texts)
    model = quality.fit(df)
    got = [r.keep for r in quality.classify(clashing(df), model).orderBy("doc_id").collect()]
    assert all(got[:80]) and not any(got[80:])
    kept = quality.keep_good(clashing(df))
    assert kept.count() == 80 and kept.columns == clashing(df).columns
    empty = quality.fit(docs(spark, []))
    assert quality.classify(docs(spark, []), empty).count() == 0


def test_em_finds_the_bad_labeller():
    rng = np.random.default_rng(0)
    counts = {}
    for _ in range(4000):
        y = rng.random() < 0.8
        v = [2 if (y if rng.random() < a else not y) else 1 for a in (0.95, 0.9, 0.9, 0.85, 0.5)] + [0] * 5
        code = sum(x * 3**i for i, x in enumerate(v))
        g = counts.setdefault(code, [0, 0])
        g[int(y)] += 1
    p = quality.posteriors({c: sum(g) for c, g in counts.items()})
    right = sum(g[int(p[c] > 0.5)] for c, g in counts.items()) / 4000
    assert right > 0.93
    assert quality.posteriors({}) == {}


# 10: near-duplicates


def brute_fingerprint(t, words=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("t", [None, "", " \t\n", "One", "One two", "ÀB\x0bc d\u00a0e f", "a b c a b c a b c", "the Quick brown fox " * 50])
def test_fingerprint(t):
    assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_fingerprint_of_a_long_text(monkeypatch, prose):
    text = prose(2000)
    want = simhash.fingerprint(text), simhash.shingle_hashes(text, 5).tolist()
    monkeypatch.setattr(simhash, "LONG_TEXT", 100)
    monkeypatch.setattr(simhash, "islice", lambda it, n: __import__("itertools").islice(it, 7))
    assert (simhash.fingerprint(text), simhash.shingle_hashes(text, 5).tolist()) == want
    assert simhash.fingerprint("a b" + " " * 200) == brute_fingerprint("a b")


def test_fingerprint_hash_is_the_engines(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_golay():
    check, error = simhash.tables()
    words = (np.arange(4096) << 11) | check
    weights = np.bitwise_count(words)
    assert weights[1:].min() == 7 and len(np.unique(error)) == 2048
    rng = np.random.default_rng(0)
    w = rng.integers(0, 1 << 23, 400)
    row, key = simhash.golay_keys(w)
    keys = [set(key[row == i]) for i in range(400)]
    assert {len(k) for k in keys} == {1, 6}
    for i in range(400):
        for bit in range(23):
            _, other = simhash.golay_keys(np.array([w[i] ^ (1 << bit)]))
            assert keys[i] & set(other)


def components(fps, ids):
    n = len(fps)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    low = {}
    for i in range(n):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low[find(i)] for i in range(n)]


@pytest.mark.parametrize("hot", [4096, 3])
def test_links_lose_nothing(spark, hot):
    rng = random.Random(hot)
    fps = []
    for _ in range(60):
        f = rng.getrandbits(64)
        fps.append(f)
        for _ in range(rng.randrange(6)):
            f = fps[-1]
            for _ in range(rng.randrange(1, 5)):
                f ^= 1 << rng.randrange(64)
            fps.append(f)
    base = rng.getrandbits(64)
    fps += [base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]  # a crowded neighbourhood
    fps = list(dict.fromkeys(fps))
    distinct = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    got = {r.node: r.component for r in common.connected_components(simhash.link_edges(distinct, hot)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == components(fps, list(range(len(fps))))


def test_near_duplicates(spark, prose):
    base = prose(400)
    texts = [base, base, base + " end", base.replace("quay", "key", 1), prose(300), None, "", "one", "ONE"] + [prose(30) for _ in range(20)]
    df = clashing(docs(spark, texts))
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert got == {i: (f, c) for i, (f, c) in enumerate(zip(fps, components(fps, list(range(len(fps))))))}
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_deduplicate_keeps_one_of_each(spark, prose):
    base = prose(400)
    df = docs(spark, [prose(200), base, base, prose(200), base])
    out = simhash.deduplicate(df)
    assert simhash.deduplicate(clashing(df)).count() == 3
    nameless = df.unionByName(spark.createDataFrame([(None, prose(150), None, None, None)], DOCS))
    assert simhash.deduplicate(nameless).count() == 4 and simhash.deduplicate(df.unionByName(spark.createDataFrame([(None, base, None, None, None)], DOCS))).count() == 3
    assert simhash.deduplicate(docs(spark, [])).count() == 0
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 3] and out.columns == df.columns


def test_wide_recall(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(3000)]
    texts, want = [], []
    for i in range(150):
        w = [rng.choice(vocab) for _ in range(300)]
        other = list(w)
        for at in rng.sample(range(300), rng.choice([1, 3, 5, 7])):
            other[at] = rng.choice(vocab)
        texts += [" ".join(w), " ".join(other)]
        x, y = (set(simhash.shingle_hashes(t, 5)) for t in texts[-2:])
        want.append(len(x & y) / len(x | y))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(clashing(docs(spark, texts))).collect()}
    linked = [got[2 * i + 1] == 2 * i for i in range(150)]
    assert not any(k and j < 0.8 for k, j in zip(linked, want))
    assert np.mean([k for k, j in zip(linked, want) if j >= 0.8]) > 0.95
    assert np.mean([k for k, j in zip(linked, want) if j >= 0.87]) > 0.98
    assert all(got[2 * i] == 2 * i for i in range(150))


def test_similar_groups_odd_rows(spark, prose):
    base = prose(400)
    texts = [base, base, base + " end", None, "", "one", "ONE", "two three"] + [prose(60) for _ in range(10)]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(clashing(docs(spark, texts))).collect()}
    assert got == {i: {1: 0, 2: 0, 4: 3, 6: 5}.get(i, i) for i in range(len(texts))}
    assert simhash.similar_groups(docs(spark, [])).count() == 0


def test_similar_groups_of_a_crowd(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(4000)}" for _ in range(250)]
    texts = []
    for i in range(120):
        w = list(base)
        w[rng.randrange(250)] = f"x{i}"
        texts.append(" ".join(w))
    got = simhash.similar_groups(docs(spark, texts + ["something else entirely of its own kind"])).collect()
    assert {r.component_id for r in got} == {0, 120}


def test_similar_groups_of_a_star(spark):
    """A base with a middle id, within 0.8 of every copy; most copies are not within 0.8 of each other."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(4000)}" for _ in range(300)]
    texts = []
    for i in range(200):
        w = list(base)
        for j in range(5):
            w[rng.randrange(60 * j, 60 * j + 56)] = f"x{i}.{j}"
        texts.append(" ".join(w))
    texts[100] = " ".join(base)
    sets = [set(simhash.shingle_hashes(t, 5)) for t in texts]
    near = [len(x & sets[100]) / len(x | sets[100]) >= 0.8 for x in sets]
    assert all(near) and sum(len(x & sets[0]) / len(x | sets[0]) < 0.8 for x in sets) > 150
    got = simhash.similar_groups(docs(spark, texts)).collect()
    assert {r.component_id for r in got} == {0}


def test_linked_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 12, rng.integers(0, 12))).astype(np.uint64) for _ in range(60)]
    want = [[len(set(x) & set(y)) >= 0.6 * len(set(x) | set(y)) for y in sets] for x in sets]
    assert (simhash.linked_sets(sets, 0.6) == np.array(want)).all()


@pytest.mark.parametrize("size", [3, 20, 500])
def test_crowds_of_near_copies(spark, size):
    """Copies of one text, its id in the middle, edited or cut short to about 0.8 and up: 0.9 of the links of brute force at least, and no other."""
    rng = random.Random(size)
    vocabulary = ["w%d" % i for i in range(3000)]
    groups = []
    for _ in range(max(1, 120 // size)):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(80, 200))]
        made = []
        for i in range(size - 1):
            words = list(base)
            if i % 3 == 0:
                words = words[: rng.randrange(int(0.82 * len(words)), len(words))]
            for _ in range(rng.randrange(1, 4) if i % 3 else 0):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            made.append(" ".join(words))
        made.insert(size // 2, " ".join(base))
        groups.append(made)
    texts = [t for g in groups for t in g]
    sets = [simhash.shingle_hashes(t, 5) for t in texts]
    want, start = {}, 0
    for g in groups:
        root = list(range(len(g)))
        for a, b in simhash._spanning(simhash.linked_sets(sets[start : start + len(g)], 0.8)):
            root = [root[a] if r == root[b] else r for r in root]
        want |= {start + i: start + min(j for j, r in enumerate(root) if r == root[i]) for i in range(len(g))}
        start += len(g)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs(spark, texts).repartition(5)).collect()}
    linked = [i for i in want if want[i] != i]
    assert np.mean([got[i] == want[i] for i in linked]) >= 0.9
    assert all(want[i] == want[got[i]] for i in got)


@pytest.mark.parametrize("hot,most", [(4096, 10**6), (2, 10**6), (4096, 0)])
def test_nested_repeats(spark, repetitive, hot, most):
    """The longer repeats are found in the stretches of the shorter ones as in whole texts; passages of over so many words go from the text."""
    df = clashing(docs(spark, repetitive)).repartition(3)
    found = suffix_dedup.nested_spans(df, "text", {"passage_spans": (30, 20), "dup_spans": (60, 40)}, hot, most)
    rows = {r.doc_id: r for r in suffix_dedup.digest(found, over=8).collect()}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in rows.items()} == dict(enumerate(brute_repeats(repetitive, 60)))
    count = {}
    for t in repetitive:
        b = (t or "").encode()
        for i in range(len(b) - 29):
            count[b[i : i + 30]] = count.get(b[i : i + 30], 0) + 1
    for i, t in enumerate(repetitive):
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 29):
            if count[b[k : k + 30]] > 1:
                gone[k : k + 30] = [True] * 30
        runs = suffix_dedup.merged([(k, k + 1) for k in range(len(b)) if gone[k]])
        runs = [x for x in runs if suffix_dedup.whole_words(b, *x) > 8]
        assert rows[i].n_passages == len(runs) and rows[i].text == (None if t is None else suffix_dedup.remainder(b, runs).decode("utf-8", "ignore"))
