import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from palimpsest import catalogue

from .oracle import duck, same


@pytest.fixture(scope="module")
def c(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, sf, c, name):
    same(catalogue.queries()[name](spark, sf), c, catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, sf, name):
    df = catalogue.queries()[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["type", "value", "occurrences"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_down_and_prune(spark, sf):
    plan = catalogue.queries()["hourly_runs"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz>" in plan
    plan = catalogue.queries()["purchased_total"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan


def made(spark, path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_custom_pii_match_is_brute_force(spark, tmp_path):
    texts = ["a Th Heing here", "a plain odd one is plain", "call 555-0100 or ann@example.com", "o f t he of", "078 05 1120 with no type", "nothing to see"]
    sf = made(spark, tmp_path, texts)
    letters = lambda t: re.sub("[^a-z0-9]", "", t.lower())
    values = [r.value for r in catalogue.queries()["custom_pii_parse"](spark, sf).collect()]
    want = Counter({(i, v): n for i, t in enumerate(texts) for v in values if letters(v) and (n := letters(t).count(letters(v)))})
    assert len({v for _, v in want}) > 5
    assert Counter((r.doc_id, r.value) for r in catalogue.queries()["custom_pii_match"](spark, sf).collect()) == want


def test_custom_pii_match_takes_letterless_words_between(spark, tmp_path):
    """At the ends of lines, as lines of their own, next to a find and not in it, on two pages, and in finds of one line."""
    long = "\n" * 39
    texts = ["xx a\n\u00f1 bx", "xx a \u00f1\nbx", "- xx a\n-\n. ! b -", "- a - b -", long + "a -\n- b", "- a=b\n- a=b -\n- a\n\u00e9 -- b --", "-\n-- plai\n- n -\n-", "of\n- the of -", "078 05\n- 1120 -\n-", None]
    sf = made(spark, tmp_path, texts)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    for name in ("custom_pii_match", "custom_emitted"):
        same(catalogue.queries()[name](spark, sf), c, catalogue.oracle_sql()[name])
    got = {(r.doc_id, r.value): (r.x0, r.x1) for r in catalogue.queries()["custom_pii_match"](spark, sf).where("doc_id < 2 and y1 < 790").collect()}
    assert got[0, "a=b"] == (-2.0, 20.0)


def test_boxes_of_a_number_with_two_spaces(spark, tmp_path):
    sf = made(spark, tmp_path, ["call (555)  555-0100 now", "nothing to see"])
    got = catalogue.queries()["resolve_entity_boxes"](spark, sf).collect()
    assert {(r.doc_id, r.value) for r in got} == {(0, "(555) 555-0100")}


def test_painted_pages_detects_once(spark, tmp_path):
    """The texts are read before the result is: nothing of it depends on them any more."""
    sf = made(spark, tmp_path, ["mail ann@example.com now", "ann@example.com\n" * 41, "nothing to see", None])
    got = catalogue.queries()["painted_pages"](spark, sf)
    assert not any("documents.parquet" in f for f in got.inputFiles())
    assert {(r.doc_id, r.page_num): r.painted > 0 for r in got.collect()} == {(0, 1): True, (1, 1): True, (1, 2): True, (2, 1): False}
