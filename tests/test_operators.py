"""Operators against hand-made cases and plain-Python versions written from their meaning."""

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import geometry, identity, labels, text
from palimpsest.operators import boxes, layout, ledger, match, spans
from palimpsest.plans import fixtures as fx
from palimpsest.sources import readers, sinks
from palimpsest.streaming import jobs


def one(spark, ddl, rows, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*cols).collect()]


def test_categories(spark):
    got = one(spark, "l string", [(" Full_Name ",), ("ssn",), ("zzz",), (None,)], labels.category(F.col("l")), labels.custom_type(F.col("l")), labels.display_type(F.col("l")))
    assert got == [("name", "other", "other"), ("ssn", "national_id", "other"), ("other", "other", "other"), ("other", "other", "other")]


def test_blank_trim_is_unicode(spark):
    assert one(spark, "s string", [(" \t x \n",)], labels.blank_trim(F.col("s"))) == [("x",)]


def test_valid_item(spark):
    rows = [("email", "a@b.c"), ("email", "[e |"), ("name", "x"), ("name", " "), ("Email ", "a@b")]
    assert [r[0] for r in one(spark, "t string, v string", rows, text.valid_item(F.col("t"), F.col("v")))] == [True, False, True, False, False]


@pytest.mark.parametrize("n", [0, 1, 900, 901, 950, 1000, 1001, 1900])
def test_chunks(spark, n):
    body = "".join(chr(97 + i % 26) for i in range(n))
    got = sorted(tuple(r) for r in spans.chunks(spark.createDataFrame([(1, body)], "doc_id long, text string")).select("chunk_offset", "chunk").collect())
    want = [(p, body[p : p + 1000]) for p in range(0, n, 900)] or [(0, "")]
    assert got == want


@settings(max_examples=20, deadline=None)
@given(st.integers(10, 3000), st.integers(0, 6000))
def test_chunks_cover(size, n):
    step = size - min(200, size // 10)
    covered = set()
    for p in range(0, max(n - 1, 0) + 1, step):
        covered |= set(range(p, min(n, p + size)))
    assert covered == set(range(n)) and step <= size


def test_chunks_of_null(spark):
    assert spans.chunks(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 1


def test_entities_across_chunk_overlap(spark):
    body = "x" * 895 + " ann@example.com " + "y" * 200 + " 192.0.2.7"
    found = [tuple(r) for r in spans.entities(spark.createDataFrame([(1, body)], "doc_id long, text string")).select("label", "text", "g_start", "g_end").collect()]
    assert sorted(found) == [("email", "ann@example.com", 896, 911), ("ip_address", "192.0.2.7", 1113, 1122)]


def test_threshold_and_incomplete(spark):
    rows = [(1, 0, 0, 0, 0, 3, "Name", "Ann", 0.3), (1, 0, 0, 1, 0, 3, "Name", "Bob", 0.29), (1, 0, 0, 2, None, 3, "Name", "Cy", 0.9), (1, 0, 0, 3, 0, 3, " ", "Di", 0.9)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_idx int, chunk_offset int, ent_idx int, start int, end int, label string, text string, score double")
    assert [(r.label, r.text) for r in spans.rebase(df).collect()] == [("name", "Ann")]


def test_model_slot(spark):
    def load():
        return lambda texts: [[{"start": 0, "end": 3, "label": "full_name", "text": t[:3], "score": 0.9}] for t in texts]

    got = spans.detect_model(spans.chunks(spark.createDataFrame([(1, "Ann was here")], "doc_id long, text string")), load).collect()
    assert [(r.doc_id, r.start, r.end, r.text) for r in got] == [(1, 0, 3, "Ann")]


def test_indexed_text_slices_back(spark):
    body = "one  two\n\nthree\n" + "\n".join(f"line {i}" for i in range(90))
    words = spans.layout_words(spark.createDataFrame([(1, body)], "doc_id long, text string"))
    whole = spans.indexed_text(words).first().text
    assert whole.startswith("[Page 1]\none two\nthree\n") and "\n\n[Page 2]\n" in whole
    for r in spans.index_words(words).collect():
        assert whole[r.char_start : r.char_end] == r.text


def test_resolve_cuts_words(spark):
    words = spark.createDataFrame([(1, 1, 0, 0, 9, 13, "abcd", 0.0, 0.0, 40.0, 10.0), (1, 1, 1, 0, 14, 16, "ef", 0.0, 20.0, 20.0, 30.0)], "doc_id long, page_num int, line_idx int, word_idx int, char_start int, char_end int, text string, x0 double, y0 double, x1 double, y1 double")
    ents = spark.createDataFrame([(1, 11, 16, "name", "cd ef"), (1, 0, 5, "name", "[Page"), (1, 9, 9, "name", "")], "doc_id long, g_start int, g_end int, label string, text string")
    got = sorted(tuple(r) for r in spans.resolve(ents, words).select("line_idx", "x0", "y0", "x1", "y1").collect())
    assert got == [(0, 18.0, 0.0, 42.0, 10.0), (1, -2.0, 20.0, 22.0, 30.0)]


@pytest.mark.parametrize("shift,gone", [(5.1, False), (5.0, True), (0.0, True)])
def test_mostly_inside(spark, shift, gone):
    hits = spark.createDataFrame([(1, 1, "v", 0.0, 0.0, 10.0, 10.0)], "doc_id long, page_num int, value string, x0 double, y0 double, x1 double, y1 double")
    custom = spark.createDataFrame([(1, 1, shift, 0.0, 50.0, 10.0), (1, 2, 0.0, 0.0, 10.0, 10.0)], "doc_id long, page_num int, x0 double, y0 double, x1 double, y1 double")
    assert boxes.suppress(hits, custom).isEmpty() == gone


def test_zero_area_is_never_inside(spark):
    hits = spark.createDataFrame([(1, 1, "v", 0.0, 0.0, 0.0, 10.0)], "doc_id long, page_num int, value string, x0 double, y0 double, x1 double, y1 double")
    assert boxes.suppress(hits, hits).count() == 1


def test_cluster_lines(spark):
    rows = [(1, 1, 0, "b", 30.0, 100.0, 50.0, 110.0), (1, 1, 1, "a", 0.0, 101.0, 20.0, 111.0), (1, 1, 2, "far", 200.0, 100.0, 220.0, 110.0), (1, 1, 3, "half", 0.0, 96.0, 20.0, 106.0), (1, 1, 4, "low", 0.0, 50.0, 20.0, 60.0), (1, 1, 5, "edge", 0.0, 45.0, 20.0, 55.0)]
    words = spark.createDataFrame(rows, "doc_id long, page_num int, word_seq long, text string, x0 double, y0 double, x1 double, y1 double")
    got = {r.text: (r.line_idx, r.word_idx) for r in layout.cluster_lines(words).collect()}
    # `half` overlaps `a`, the row's first word, by exactly half: a line of its own; so does `edge`
    assert got == {"a": (0, 0), "b": (0, 1), "far": (1, 0), "half": (2, 0), "low": (3, 0), "edge": (4, 0)}


def test_ocr_words(spark):
    poly = [[(10.0, 20.0), (30.0, 21.0), (30.0, 60.0), (10.0, 59.0)]]
    rows = [(1, 1, 0, 300.0, ["a"], poly, "0.29"), (1, 1, 1, 300.0, ["b"], poly, "x"), (1, 1, 2, 300.0, ["c", " "], poly * 2, None), (1, 1, 3, 300.0, ["d"], poly, "0.3")]
    lines = spark.createDataFrame(rows, "doc_id long, page_num int, line_no int, height double, words array<string>, polygons array<array<struct<x: double, y: double>>>, score string")
    got = {r.text: r for r in layout.ocr_words(lines, 72.0).collect()}
    assert set(got) == {"b", "c", "d"}
    assert (got["b"].x0, got["b"].x1, got["b"].y0, got["b"].y1) == (2.0, 38.0, 240.0, 280.0)


def brute_find(lines, value):
    """All boxes of a value on a page, straight from the rule."""
    norm = lambda s: "".join(c for c in s.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")
    target, out = norm(value), []
    box = lambda ws: (min(w[1] for w in ws), min(w[2] for w in ws), max(w[3] for w in ws), max(w[4] for w in ws))
    runs = []
    for i in range(len(lines)):
        run = [i] + [j for j in range(i + 1, len(lines)) if min(box(lines[i])[2], box(lines[j])[2]) > max(box(lines[i])[0], box(lines[j])[0])]
        if run not in runs:
            runs.append(run)
    seen = set()
    for run in runs:
        chars = [(i, w, k, len(norm(w[0])), c) for i in run for w in lines[i] for k, c in enumerate(norm(w[0]))]
        whole, at = "".join(c[-1] for c in chars), 0
        while target and (at := whole.find(target, at)) >= 0:
            hit, at = chars[at : at + len(target)], at + len(target)
            for i in dict.fromkeys(c[0] for c in hit):
                xs = []
                for w in dict.fromkeys(c[1] for c in hit if c[0] == i):
                    ks = [c[2] for c in hit if c[0] == i and c[1] == w]
                    n = len(norm(w[0]))
                    full = min(ks) == 0 and max(ks) + 1 == n
                    xs.append((w[1], w[2], w[3], w[4]) if full else (w[1] + min(ks) / n * (w[3] - w[1]), w[2], w[1] + (max(ks) + 1) / n * (w[3] - w[1]), w[4]))
                b = (min(x[0] for x in xs), min(x[1] for x in xs), max(x[2] for x in xs), max(x[3] for x in xs))
                if tuple(round(v, 1) for v in b) not in seen:
                    seen.add(tuple(round(v, 1) for v in b))
                    out.append((b[0] - 2, b[1] - 2, b[2] + 2, b[3] + 2))
    return sorted(out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("ab-", min_size=1, max_size=4), st.integers(0, 6)), min_size=1, max_size=3), min_size=1, max_size=5), st.lists(st.text("ab", min_size=1, max_size=4), min_size=1, max_size=4, unique=True))
def test_find_on_page_is_brute_force(lines, values):
    """Values that overlap themselves and runs that end others included."""
    page = [[(w, 10.0 * x, 50.0 - 10 * i, 10.0 * x + 8 * len(w), 58.0 - 10 * i) for w, x in ln] for i, ln in enumerate(lines)]
    clean = [[(w.replace("-", ""), *box) for w, *box in ln] for ln in page]
    got = {}
    for v, *box in match.find_on_page(clean, match.finder(values)):
        got.setdefault(v, []).append(tuple(box))
    for v in values:
        assert sorted(got.get(v, [])) == brute_find(page, v)


@pytest.mark.parametrize("value", ["Ann", "ann lee", "Lee 12", "!!", "Quay 12 Main", "nn L"])
def test_find_on_page(spark, value):
    lines = [[("Joanna", 0.0, 50.0, 60.0, 60.0), ("Lee", 65.0, 50.0, 90.0, 60.0)], [("12", 0.0, 30.0, 20.0, 40.0), ("Main", 22.0, 30.0, 60.0, 40.0)], [("Quay", 300.0, 30.0, 340.0, 40.0)], [("Ann", 0.0, 10.0, 30.0, 20.0), ("Lee", 35.0, 10.0, 60.0, 20.0)]]
    flat = [(1, 1, i, j, *w) for i, ln in enumerate(lines) for j, w in enumerate(ln)]
    words = spark.createDataFrame(flat, "doc_id long, page_num int, line_idx int, word_idx int, text string, x0 double, y0 double, x1 double, y1 double")
    got = match.match_custom(words, spark.createDataFrame([(value, "name")], "value string, type string"))
    assert sorted(tuple(r) for r in got.select("x0", "y0", "x1", "y1").collect()) == brute_find(lines, value)


def test_dictionary_in_parts(spark):
    words = spark.createDataFrame([(1, 1, 0, i, w, 10.0 * i, 0.0, 10.0 * i + 8, 1.0) for i, w in enumerate("the quay of the stone quay".split())], "doc_id long, page_num int, line_idx int, word_idx int, text string, x0 double, y0 double, x1 double, y1 double")
    given = spark.createDataFrame([(v, "other") for v in ("the", "Quay!", "quay", "of the", "eq", "", "!!", "absent")], "value string, type string")
    whole = sorted(map(repr, match.match_custom(words, given).collect()))
    assert len(whole) == 9 and whole == sorted(map(repr, match.match_custom(words, given, most=2).collect()))


def test_parse_custom(spark):
    got = {r.value: r.type for r in match.parse_custom(spark.createDataFrame(fx.CUSTOM, "seq long, value string, type string, line string")).collect()}
    assert got == {"Th Heing": "name", "ann@example.com": "email", "555-0100": "other", "078-05-1120": "national_id", "plain": "date_of_birth", "odd one": "other", "no type": "other", "the of": "other", "a=b": "email"}


def test_mask_variants(spark):
    rows = [("call (555) 555-0100 or ann@example.com",), (None,), ("",)]
    p = {k: spans.PATTERNS[k] for k in ("email", "phone_number")}
    got = one(spark, "t string", rows, *[boxes.mask(F.col("t"), p, how) for how in ("replace", "redact", "mask")])
    assert got[0] == ("call <ANONYMIZED> or <ANONYMIZED>", "call  or ", "call (5************ or ann************")
    assert got[1] == (None, None, None) and got[2] == ("", "", "")


def test_device_id(spark):
    import hashlib

    raw = "0123456789abcdef0123456789abcdef-"
    mixed = bytes(b ^ identity.PATTERN[i % 8] for i, b in enumerate(raw.encode()))
    want = hashlib.sha256(mixed[len(mixed) // 2 :] + mixed[: len(mixed) // 2]).hexdigest()
    assert one(spark, "m string", [(raw,)], identity.device_id(F.col("m"))) == [(want,)]


def test_geometry_pixels(spark):
    assert one(spark, "x0 double, y0 double, x1 double, y1 double", [(1.0, 2.0, 4.0, 8.0)], *geometry.pixels(2.0, F.lit(10.0))) == [(2.0, 4.0, 6.0, 12.0)]


# the ledger

T0 = datetime(2024, 1, 1, 8)


def events(spark, rows):
    full = [(r.get("account", "a"), r["ts"], i, r["kind"], r.get("pages"), r.get("order"), r.get("issued"), r.get("used")) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, ledger.EVENT)


def replayed(spark, rows):
    return ledger.replay(events(spark, rows)).orderBy("seq").collect()


def test_free_pages(spark):
    got = replayed(spark, [{"ts": T0, "kind": "consume", "pages": 5}, {"ts": T0, "kind": "consume", "pages": 17}, {"ts": T0, "kind": "consume", "pages": 16}, {"ts": T0 + timedelta(days=1), "kind": "consume", "pages": 1}, {"ts": T0 + timedelta(days=8), "kind": "consume", "pages": 2}])
    assert [(r.allow, r.from_daily, r.from_week1, r.from_prepaid) for r in got] == [(True, 1, 4, 0), (False, 0, 0, 0), (True, 0, 16, 0), (True, 1, 0, 0), (False, 0, 0, 0)]


def test_week_one_ends_after_its_last_moment(spark):
    end = T0 + timedelta(days=7)
    got = replayed(spark, [{"ts": T0, "kind": "balance"}, {"ts": end, "kind": "consume", "pages": 0}, {"ts": end, "kind": "balance"}, {"ts": end + timedelta(milliseconds=1), "kind": "balance"}])
    assert got[2].week1_left > 0 and got[3].week1_left == 0 and got[1].reason == "invalid_pages"


def test_grant_once(spark):
    got = replayed(spark, [{"ts": T0, "kind": "grant", "pages": 100, "order": "o"}, {"ts": T0, "kind": "grant", "pages": 100, "order": "o"}, {"ts": T0, "kind": "consume", "pages": 121}])
    assert [r.allow for r in got] == [True, False, True] and got[2].from_prepaid == 100 and got[2].prepaid_left == 0


def test_penalty_stays_when_the_request_is_denied(spark):
    got = replayed(spark, [{"ts": T0, "kind": "balance"}, {"ts": T0 + timedelta(hours=1), "kind": "consume", "pages": 50}, {"ts": T0 + timedelta(hours=2), "kind": "consume", "pages": 1}])
    assert got[0].lease_ceiling == 10 and (got[1].allow, got[1].charged, got[1].lease_ceiling) == (False, 10, None) and got[2].charged == 0
    assert got[1].daily_left + got[1].week1_left == 11


def test_reports(spark):
    t = T0 + timedelta(hours=1)
    got = replayed(spark, [{"ts": T0, "kind": "balance"}, {"ts": t, "kind": "consume", "pages": 1, "issued": T0, "used": 3}, {"ts": t, "kind": "consume", "pages": 1, "issued": T0, "used": 99}, {"ts": t, "kind": "consume", "pages": 1, "issued": T0 - timedelta(1), "used": 3}, {"ts": T0 + timedelta(days=1, seconds=1), "kind": "balance", "issued": T0, "used": 3}])
    assert [r.reconciled for r in got] == [0, 3, 10, 0, 0]  # a repeated report is charged again; stale and late ones are not
    assert got[4].lease_issued_at == T0 + timedelta(days=1, seconds=1)


def test_lease_rotates_at_half_time(spark):
    got = replayed(spark, [{"ts": T0, "kind": "balance"}, {"ts": T0 + timedelta(hours=11, minutes=59), "kind": "balance", "issued": T0, "used": 0}, {"ts": T0 + timedelta(hours=12), "kind": "balance", "issued": T0, "used": 0}])
    assert [r.lease_issued_at for r in got] == [T0, T0, T0 + timedelta(hours=12)]


def test_offline_part_without_prepaid_is_forgiven(spark):
    got = replayed(spark, [{"ts": T0, "kind": "consume", "pages": 15}, {"ts": T0, "kind": "balance"}, {"ts": T0 + timedelta(days=8), "kind": "balance"}])
    assert got[1].lease_ceiling == 6 and got[2].charged == 6 and got[2].prepaid_left == 0 and got[2].daily_left == 0


def test_accounts_do_not_mix(spark):
    rows = [{"account": a, "ts": T0 + timedelta(minutes=i), "kind": "consume", "pages": 7} for i in range(4) for a in "abc"]
    got = ledger.replay(events(spark, rows)).groupBy("account").agg(F.sum(F.col("allow").cast("int")).alias("n")).collect()
    assert {r.n for r in got} == {3}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(1, 30)), max_size=30))
def test_never_above_what_is_granted(steps):
    account, now = ledger.Account.opened(T0), T0
    for hours, pages in steps:
        now += timedelta(hours=hours)
        before = None
        got = account.step("consume", now, pages, None, None, None)
        if got["allow"]:
            assert got["from_daily"] + got["from_week1"] + got["from_prepaid"] == pages and got["from_prepaid"] == 0
        assert account.week_used <= ledger.WEEK_ONE_PAGES and account.daily_used <= account.daily_granted and before is None


def test_waterfall(spark):
    got = one(spark, "p long, d long, w long", [(5, 1, 2), (1, 1, 2), (0, 1, 2)], *ledger.waterfall(F.col("p"), F.col("d"), F.col("w")))
    assert got == [(1, 2, 2), (1, 0, 0), (0, 0, 0)]


def test_offline_consume(spark):
    rows = spark.createDataFrame(fx.OFFLINE, "client string, seq long, now string, pages long, expires_at string, ceiling long, used long").withColumns({"now": F.to_timestamp("now"), "expires_at": F.to_timestamp("expires_at")})
    got = {(r.client, r.seq): r.reason for r in ledger.offline_consume(rows).collect()}
    assert got == {("a", 1): None, ("a", 2): "offline_ceiling_reached", ("a", 3): None, ("a", 4): "offline_lease_expired", ("b", 1): "offline_ceiling_reached", ("c", 1): "offline_state_missing"}


def test_webhooks(spark):
    products = spark.createDataFrame(fx.PRODUCTS, "product_id string, tier string, pages long, price_cents long")
    paid = ledger.paid_orders(spark.createDataFrame(fx.ORDER_EVENTS, "seq long, body string"), products)
    assert sorted((r.order_id, r.tier, r.pages, r.amount_cents) for r in paid.collect()) == [("o1", "starter", 100, 900), ("o5", "pro", 500, 2100), ("o7", "max", 2000, 0)]
    total = ledger.grant(spark.createDataFrame(fx.BALANCES, "account_id string, granted long"), paid, spark.createDataFrame(fx.DONE_ORDERS, "order_id string"))
    assert {r.account_id[-1]: r.granted for r in total.collect()} == {"1": 200, "2": 500, "3": 500}


# sources, sinks and streams


def test_request_lines(spark):
    got = [tuple(r) for r in readers.requests(spark.createDataFrame(fx.REQUEST_LINES, "line_no long, raw string")).orderBy("line_no").collect()]
    assert got == [(1, "detect", "/in/a.pdf", None), (3, None, None, "invalid JSON"), (4, "fly", None, "unknown cmd"), (5, "scrub", None, None), (6, None, None, "invalid JSON"), (7, "close", None, None)]


def test_jsonl_and_rewrite(spark, tmp_path):
    path = f"file://{tmp_path}/rows"
    sinks.write_json_lines(spark.createDataFrame([(1,), (2,)], "a int"), path)
    assert readers.jsonl(spark, path).count() == 2
    sinks.rewrite(spark.read.schema("a int").json(path).where("a > 1"), path)
    assert [r.a for r in spark.read.schema("a int").json(path).collect()] == [2]


def test_pdf_reader(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.txt"):
        (tmp_path / name).write_bytes(b"%PDF")
    assert readers.read_pdfs(spark, f"file://{tmp_path}").count() == 2


def test_fold_over_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ddl = "doc_id long, seq long, kind string, status string, type string, value string"
    rows = [(1, 0, "pii", None, "name", "Ann"), (1, 1, "pii", None, "email", "a@b.c"), (1, 2, "pii", None, "name", "Ann"), (2, 3, "pii", None, "name", "Bob")]
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(1, 4, "end", "done", None, None)], ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.file_stream(spark, f"file://{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, files_per_trigger=1)
    got = jobs.run_once(jobs.fold_items(stream), "fold", f"file://{tmp_path}/state").collect()
    assert sorted((r.doc_id, r.type, r["count"]) for r in got if r.doc_id == 1)[:1] in ([(1, "email", 1)], [])


def test_synthetic_corpus(spark):
    from palimpsest.operators import corpus, synth

    df = synth.corpus(spark, 3000).cache()
    assert sorted(map(repr, df.collect())) == sorted(map(repr, synth.corpus(spark, 3000).repartition(5).collect()))
    total = sum(w for w, _ in synth.KINDS.values())
    n = {r.kind: r["count"] for r in df.groupBy("kind").count().collect()}
    assert all(abs(n[k] / 3000 - w / total) < 0.03 for k, (w, _) in synth.KINDS.items())
    missing = df.select(F.explode("pii").alias("p"), "ocr_text").where(F.size(corpus.missing_tokens(F.col("p.value"), F.col("ocr_text"))) > 0)
    assert missing.isEmpty()
    found = spans.items(spans.entities(df.select(F.col("row").alias("doc_id"), F.col("ocr_text").alias("text"))))
    told = {(r.doc_id, r.value) for r in found.select("doc_id", "value").collect()}
    assert {(r.row, p.value) for r in df.collect() for p in r.pii if p.type in ("email_address", "phone_number", "credit_card_number", "social_security_number", "other_pii")} == told


def test_formats(spark):
    rows = [(datetime(2024, 5, 6, 2, 30), 1572864), (datetime(2024, 12, 16, 12, 5), None)]
    got = one(spark, "t timestamp, n long", rows, text.acquired(F.col("t")), text.date_time(F.col("t")), text.megabytes(F.col("n")))
    assert got == [("May 6   2:30 AM", "5/6/2024, 2:30 AM", "1.5 MB"), ("Dec 16 12:05 PM", "12/16/2024, 12:05 PM", "")]


def test_terminal(spark):
    rows = [("detect", "analyze", "done"), ("detect", "ocr", "done"), ("scrub", "redact", "done"), ("scrub", "ocr", "error"), ("close", None, None)]
    assert [r[0] for r in one(spark, "c string, p string, s string", rows, readers.terminal(F.col("c"), F.col("p"), F.col("s")))] == [True, False, True, True, False]


def test_pages_without_rectangles_see_no_painter(spark):
    white = bytearray(b"\xff" * 12)
    pages = spark.createDataFrame([(1, 1, 2, 2, white), (1, 2, 2, 2, bytearray(b"as it is")), (None, 1, 2, 2, white)], "doc_id long, page_num int, width int, height int, pixels binary")
    rects = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.5, 0.0), (1, 1, 0.0, -9.0, 0.5, 0.0), (2, 1, 0.0, 0.0, 1.0, 1.0), (None, 1, 1.0, 1.0, 9.0, 9.0)], "doc_id long, page_num int, x double, y double, w double, h double")
    got = {(r.doc_id, r.page_num): (bytes(r.pixels), r.painted) for r in boxes.paint(pages, rects).collect()}
    assert got == {(1, 1): (b"\0\0\0" + b"\xff" * 9, 1), (1, 2): (b"as it is", 0), (None, 1): (b"\xff" * 9 + b"\0\0\0", 1)}


def test_layout_pages_are_those_of_the_words(spark):
    texts = ["a\nb", None, "", " \n  ", "\n" * 40 + "x", "x" + "\n" * 39 + " \n" + "\n" * 40 + "\t", " a", "a\r\n" * 41]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(r.doc_id, r.page_num) for r in spans.layout_words(docs).collect()}
    got = [tuple(r) for r in spans.layout_pages(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (5, 3) in want


def test_megabytes_round_halves_to_even(spark):
    sizes = [1310720, 1835008, 131072 * 104_858, -1310720, -20_000, 1, 52_428, 52_429, 9_437_184 * 104_858]
    got = [r[0] for r in one(spark, "n long", [(n,) for n in sizes], text.megabytes(F.col("n")))]
    assert got == ["%.1f MB" % (n / 1048576) for n in sizes] and got[:4] == ["1.2 MB", "1.8 MB", "13107.2 MB", "-1.2 MB"]


def test_all_items_order_is_total(spark):
    """An item that a chunk's end cut short comes before the whole one, in whatever order they are read."""
    custom = spark.createDataFrame([(1, "b", "other", 2), (1, "a", "other", 2), (1, "c", "other", 1)], "doc_id long, value string, type string, page_num int")
    model = [(1, 5, "email", "email", "ann@example.com"), (1, 5, "email", "email", "ann@example.co"), (1, 5, "email", "email", "ann@exampl"), (1, 0, "ssn", "ssn", "x")]
    for rows in (model, model[::-1]):
        given = spark.createDataFrame(rows, "doc_id long, g_start int, label string, type string, value string").coalesce(1)
        got = {r.place: r.value for r in match.all_items(custom, given).collect()}
        assert got == {1: "c", 2: "a", 3: "b", 4: "x", 5: "ann@exampl", 6: "ann@example.co", 7: "ann@example.com"}
