"""The pipeline's stages against the operators' own brute-force versions, on a small table."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm.common import materialise


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    words = ["the", "of", "quay", "ship", "rain", "paper", "river", "stone", "and", "to", "in", "letter", "harbour", "wind"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))
    passage = prose(90)
    texts = [prose(120) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1]]
    texts += [prose(60) + " " + passage + " " + prose(60) for _ in range(3)]
    texts += ["BUY!! NOW!! " * 40, "$$$ %%% " * 60, None, ""]
    rows = [(i, t, "en", "a" if i % 3 else "b", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), texts, passage


def test_stages(spark, table):
    docs, texts, passage = table
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = materialise(stage(spark, docs, "unused"), name)
        steps[name] = docs
        assert name == "sentencepiece" or docs.columns == before
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in steps.items()}
    assert ids["quality"] == set(range(46))
    assert ids["near_dedup"] == set(range(40)) | {43, 44, 45}
    cut = {r.doc_id: r for r in steps["suffix_dedup"].collect()}
    assert set(cut) == ids["near_dedup"] and all(passage not in cut[i].text for i in (43, 44, 45))
    assert all(cut[i].text == texts[i] for i in range(40)) and all(r.n_chars == len(r.text) for r in cut.values())
    assert ids["mixing"] <= ids["near_dedup"] and steps["mixing"].groupBy("doc_id").count().agg(F.max("count")).first()[0] > 1
    last = steps["sentencepiece"].collect()
    assert len(last) == steps["mixing"].count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0 and got.where("not round_trip").count() == 0


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, "unused"), name)
        assert docs.count() == 0


def test_passage_of_51_words_is_cut(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(n))
    long, short = prose(51), prose(50)
    assert 250 < len(long) < 400 and len(short) >= 200
    texts = [f"{prose(80)} {p} {prose(80)}" for p in (long, long, short, short)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, "unused").collect()}
    assert all(long not in got[i] and len(got[i]) <= len(texts[i]) - len(long) for i in (0, 1))
    assert [got[2], got[3]] == texts[2:]


def test_odd_rows(spark, table):
    """Null and repeated ids, null, empty and very long texts, nulls in every column and columns whose names the operators use themselves."""
    docs, texts, passage = table
    odd = [(None, texts[3] + " and so on", None, None, None), (None, None, None, None, None), (5, texts[5], "en", "a", 1), (60, "the ship and the river of stone " * 60_000, None, "b", None), (61, "", "en", None, 0)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({c: F.lit("x") for c in ("fp", "spans", "c1", "row", "copy", "shuffle_key", "dup_spans", "pattern", "node", "__kept_id")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = materialise(stage(spark, docs, "unused"), name)
        assert made.columns == docs.columns
        if name == "near_dedup":
            kept = [r.doc_id for r in made.select("doc_id").collect()]
            assert kept.count(5) == 2 and set(range(40)) <= set(kept)  # rows of the id that stays all stay
        docs = made
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "unused")
    assert last.count() == docs.count() and last.where("not round_trip").isEmpty()
