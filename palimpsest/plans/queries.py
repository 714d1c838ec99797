"""The registered queries: each operator applied to the driver's tables or to a small fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..functions import geometry, identity, labels, text
from ..operators import boxes, corpus, layout, ledger, match, metrics, spans, synth
from ..sources import readers, sinks
from ..sources.readers import table
from . import fixtures as fx

SCALE = 300.0 / 72.0
MASKED = {k: spans.PATTERNS[k] for k in ("email", "phone_number", "credit_card", "ip_address")}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


# text, chunks and detection


def chunk_documents(spark, sf_dir):
    return spans.chunks(_docs(spark, sf_dir)).select("doc_id", "chunk_idx", "chunk_offset", F.length("chunk").alias("n"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.norm(F.col("text")).cast("binary")).alias("norm_md5"))


def detect_regex_entities(spark, sf_dir):
    found = spans.rebase(spans.detect_rules(spans.chunks(_docs(spark, sf_dir))))
    return found.select("doc_id", "chunk_idx", "g_start", "g_end", "label", "text")


def dedupe_entities(spark, sf_dir):
    return spans.entities(_docs(spark, sf_dir)).select("doc_id", "g_start", "g_end", "label", "chunk_idx", "text")


def aggregate_pii(spark, sf_dir):
    return boxes.in_display_order(boxes.aggregate(spans.items(spans.entities(_docs(spark, sf_dir)))))


def conversation_pii(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 10_000 + F.col("turn")).alias("doc_id"), "text")
    return boxes.aggregate(spans.items(spans.entities(turns)))


# indexed text and boxes


def _words(spark, sf_dir):
    return spans.layout_words(_docs(spark, sf_dir))


def index_words(spark, sf_dir):
    return _words(spark, sf_dir).select("doc_id", "page_num", "line_idx", "word_idx", "char_start", "char_end", "text", "x0", "x1", "y0")


def index_word_rows(spark, sf_dir):
    """The same offsets by windows, for words that come as rows."""
    rows = spans.layout_words(_docs(spark, sf_dir)).select("doc_id", "page_num", "line_no", "word_idx", "text")
    return spans.index_words(rows).select("doc_id", "page_num", "line_idx", "word_idx", "char_start", "char_end")


def indexed_text(spark, sf_dir):
    return spans.indexed_text(spans.layout_words(_docs(spark, sf_dir))).select("doc_id", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def layout_text(spark, sf_dir):
    return spans.layout_text(_docs(spark, sf_dir)).select("doc_id", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _boxes(spark, sf_dir, keep=lambda df, label: df):
    """The boxes of all entities of the indexed texts; words are laid out for documents that have any. `keep` may write the entities, which are read twice."""
    docs = _docs(spark, sf_dir)
    found = keep(spans.items(spans.entities(spans.layout_text(docs))), "entities")
    hit = docs.join(found.select(F.col("doc_id").alias("hit_id")).distinct(), F.col("doc_id") == F.col("hit_id"), "left_semi")
    return spans.resolve(found, spans.layout_words(hit)).withColumn("type", labels.category(F.col("label")))


def resolve_entity_boxes(spark, sf_dir):
    return _boxes(spark, sf_dir).select("doc_id", "g_start", "label", "value", "page_num", "line_idx", "x0", "y0", "x1", "y1")


def pixel_boxes(spark, sf_dir):
    px = geometry.pixels(SCALE, F.lit(spans.PAGE_HEIGHT))
    rounded = [F.floor(c * 1000 + 0.5).cast("long").alias(n) for c, n in zip((F.col("x"), F.col("y"), F.col("w"), F.col("h")), "xywh")]
    return _boxes(spark, sf_dir).select("doc_id", "g_start", "value", "line_idx", *px).select("doc_id", "g_start", "value", "line_idx", *rounded)


def _custom(spark):
    return match.parse_custom(_rows(spark, fx.CUSTOM, "seq long, value string, type string, line string"))


def custom_pii_parse(spark, sf_dir):
    return _custom(spark).select("value", "type")


def custom_pii_match(spark, sf_dir):
    return match.match_custom(spans.layout_words(_docs(spark, sf_dir)), _custom(spark), in_order=True, letterless=True)


def custom_emitted(spark, sf_dir):
    return match.emitted(custom_pii_match(spark, sf_dir))


def _beside_custom(spark, sf_dir):
    """The detector's boxes that do not lie in the custom values' boxes, which are found first."""
    return boxes.suppress(_boxes(spark, sf_dir), custom_pii_match(spark, sf_dir))


def suppress_hits(spark, sf_dir):
    return _beside_custom(spark, sf_dir).select("doc_id", "g_start", "value", "page_num", "line_idx")


def all_items(spark, sf_dir):
    model = _beside_custom(spark, sf_dir).select("doc_id", "g_start", "label", "type", "value").distinct()
    return match.all_items(custom_emitted(spark, sf_dir), model)


def dedupe_boxes(spark, sf_dir):
    twice = _boxes(spark, sf_dir)
    twice = twice.withColumn("seq", F.col("g_start") * 2).unionByName(twice.withColumn("seq", F.col("g_start") * 2 + 1))
    return boxes.dedupe(twice, ["seq"]).select("doc_id", "value", "page_num", "seq", "label")


def attach_boxes(spark, sf_dir):
    found = _boxes(spark, sf_dir)
    whole = boxes.attach_boxes(boxes.aggregate(found.select("doc_id", "type", "value"), ("doc_id",)), found)
    first = lambda c: F.floor(F.col("bboxes")[0][c] * 1000 + 0.5).cast("long")
    return whole.select("doc_id", "type", "value", "occurrences", F.size("bboxes").alias("n_boxes"), F.col("bboxes")[0]["page_num"].alias("page_num"), first("x0").alias("x0"), first("y0").alias("y0"))


def page_pixel_boxes(spark, sf_dir):
    """Pixel boxes by each page's own height: even pages are longer."""
    pages = spans.layout_words(_docs(spark, sf_dir)).select("doc_id", "page_num").distinct().withColumn("height", F.when(F.col("page_num") % 2 == 0, 1008.0).otherwise(spans.PAGE_HEIGHT))
    rounded = [F.floor(F.col(c) * 1000 + 0.5).cast("long").alias(c) for c in "xywh"]
    return geometry.page_pixels(_boxes(spark, sf_dir), pages, SCALE).select("doc_id", "g_start", "value", "page_num", "line_idx", *rounded)


def _selected(found):
    return boxes.aggregate(found.select("type", "value")).where("type in ('email', 'ip_address')").select("value")


def redaction_rects(spark, sf_dir):
    found = _boxes(spark, sf_dir)
    rects = boxes.rectangles(_selected(found), found.select("doc_id", "page_num", "value", "x0", "y0", "x1", "y1"), SCALE, spans.PAGE_HEIGHT)
    return rects.select("doc_id", "page_num", "value", *[F.floor(F.col(c) * 1000 + 0.5).cast("long").alias(c) for c in "xywh"])


def unredacted_docs(spark, sf_dir):
    return boxes.untouched(_docs(spark, sf_dir).select("doc_id"), redaction_rects(spark, sf_dir))


def redaction_totals(spark, sf_dir):
    return redaction_rects(spark, sf_dir).agg(F.count(F.lit(1)).alias("rects"), F.countDistinct("doc_id", "page_num").alias("pages"))


def pages_to_draw(spark, sf_dir):
    pages = spans.layout_words(_docs(spark, sf_dir)).select("doc_id", "page_num").distinct()
    drawn = redaction_rects(spark, sf_dir).groupBy("doc_id", "page_num").agg(F.count(F.lit(1)).alias("n"))
    return pages.join(drawn, ["doc_id", "page_num"], "left").select("doc_id", "page_num", F.coalesce("n", F.lit(0)).alias("n_rects"))


def _masked(spark, sf_dir, how):
    out = boxes.mask(F.col("text"), MASKED, how)
    return _docs(spark, sf_dir).select("doc_id", F.md5(out.cast("binary")).alias("text_md5"), F.length(out).alias("n"))


def mask_text(spark, sf_dir):
    return _masked(spark, sf_dir, "replace")


def redact_text(spark, sf_dir):
    return _masked(spark, sf_dir, "redact")


def star_text(spark, sf_dir):
    return _masked(spark, sf_dir, "mask")


def hash_text(spark, sf_dir):
    return _masked(spark, sf_dir, "hash")


def deny_list(spark, sf_dir):
    out = boxes.deny_list(F.col("text"), ["the", "Of", "and"], "<X>")
    return _docs(spark, sf_dir).select("doc_id", F.length(out).alias("n"))


def cluster_lines(spark, sf_dir):
    flat = spans.layout_words(_docs(spark, sf_dir)).select("doc_id", "page_num", (F.col("line_no") * 100_000 + F.col("word_idx")).alias("word_seq"), "text", "x0", "y0", "x1", "y1")
    return layout.cluster_lines(flat).select("doc_id", "page_num", "word_seq", "line_idx", "word_idx")


def ocr_words(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    words = F.split("line", " ", -1)
    poly = lambda w, i: F.array(*[F.struct((i * 50.0 + dx).alias("x"), (F.col("line_no") * 40.0 + dy).alias("y")) for dx, dy in ((0, 0), (45, 2), (45, 30), (1, 29))])
    score = F.when(F.col("line_no") % 5 == 0, "0.2").when(F.col("line_no") % 5 == 1, "bad").when(F.col("line_no") % 5 == 2, F.lit(None)).otherwise("0.3")
    made = lines.select("doc_id", F.lit(1).alias("page_num"), "line_no", F.lit(3300.0).alias("height"), words.alias("words"), F.transform(words, poly).alias("polygons"), score.alias("score"))
    return layout.ocr_words(made).select("doc_id", "word_seq", "text", *[F.floor(F.col(c) * 1000 + 0.5).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])


def scanned_pages(spark, sf_dir):
    """Pages from a stand-in renderer, through the word extraction."""
    files = _docs(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    words = layout.ocr_words(readers.scan_pages(files, fx.load_reader))
    whole = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long")
    return words.groupBy("doc_id", "page_num").agg(F.count(F.lit(1)).alias("n_words"), F.max(whole("x1")).alias("right"), F.min(whole("y0")).alias("bottom"))


DRAWN = 0.1


def painted_pages(spark, sf_dir):
    """White pages with the selected values painted over."""
    wide, high = int(spans.PAGE_WIDTH * DRAWN), int(spans.PAGE_HEIGHT * DRAWN)
    scratch = shared.Scratch()
    pages = scratch.keep(spans.layout_pages(_docs(spark, sf_dir)), "pages")
    pages = pages.select("doc_id", "page_num", F.lit(wide).alias("width"), F.lit(high).alias("height"), F.lit(bytearray(b"\xff" * (3 * wide * high))).alias("pixels"))
    found = scratch.keep(_boxes(spark, sf_dir, scratch.keep), "boxes")
    rects = boxes.rectangles(_selected(found), found.select("doc_id", "page_num", "value", "x0", "y0", "x1", "y1"), DRAWN, spans.PAGE_HEIGHT)
    drawn = boxes.paint(pages, rects)
    return scratch.result(drawn.select("doc_id", "page_num", "painted", F.length(sinks.ppm(F.col("width"), F.col("height"), F.col("pixels"))).alias("n_bytes")), "painted")


# what the user sees


def _ui_items(spark, sf_dir):
    found = spans.items(spans.entities(_docs(spark, sf_dir)))
    return found.groupBy("type", "value").agg(F.count(F.lit(1)).alias("count"), F.min("doc_id").alias("seq"))


def ui_groups(spark, sf_dir):
    found = spans.items(spans.entities(_docs(spark, sf_dir)))
    return boxes.ui_groups(found.groupBy("doc_id", "type", "value").agg(F.count(F.lit(1)).alias("count"), F.min("g_start").alias("seq")))


def selected_by_type(spark, sf_dir):
    return _ui_items(spark, sf_dir).where(F.length("value") % 2 == 0).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def page_span(spark, sf_dir):
    return _boxes(spark, sf_dir).groupBy("type", "value").agg(F.countDistinct("doc_id", "page_num").alias("n_pages"), F.count(F.lit(1)).alias("n_boxes"))


def keep_checked(spark, sf_dir):
    items = _ui_items(spark, sf_dir)
    prior = items.where("seq % 2 = 0").select("type", "value", (F.col("seq") % 4 == 0).alias("checked"))
    return items.join(prior, ["type", "value"], "left").select("type", "value", "count", F.coalesce("checked", F.lit(True)).alias("checked"))


def selected_values(spark, sf_dir):
    return _ui_items(spark, sf_dir).select("value").distinct().orderBy("value")


def union_identifiers(spark, sf_dir):
    saved = _rows(spark, fx.IDENTIFIER_INPUTS[:6], "type string, raw string")
    return saved.unionByName(_rows(spark, fx.IDENTIFIER_INPUTS[4:], "type string, raw string"))


def detection_json(spark, sf_dir):
    found = spans.items(spans.entities(_docs(spark, sf_dir)))
    each = found.groupBy(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file"), "type", "value").agg(F.count(F.lit(1)).alias("occurrences"))
    return sinks.detection_json(each, "rules")


def chunk_dump(spark, sf_dir):
    return sinks.chunk_dump(spans.chunks(_docs(spark, sf_dir))).select("doc_id", F.length("dump").alias("n"), F.md5(F.col("dump").cast("binary")).alias("dump_md5"))


# scalar functions


def format_identifier(spark, sf_dir):
    made = text.format_identifier(F.col("type"), F.col("raw"))
    return _rows(spark, fx.IDENTIFIER_INPUTS, "type string, raw string").select("type", "raw", made.alias("formatted"), text.identifier_ok(F.col("type"), made).alias("ok"))


def ui_formats(spark, sf_dir):
    progress = _rows(spark, fx.PROGRESS, "a long, b long").select(F.lit("percent").alias("what"), F.concat_ws("/", "a", "b").alias("raw"), text.percent(F.col("a"), F.col("b")).cast("string").alias("shown"))
    prices = _rows(spark, fx.PRICES, "c long").select(F.lit("price").alias("what"), F.col("c").cast("string").alias("raw"), text.price(F.col("c")).alias("shown"))
    tiers = _rows(spark, fx.TIERS, "t string").select(F.lit("tier").alias("what"), F.col("t").alias("raw"), text.tier_name(F.col("t")).alias("shown"))
    types = _rows(spark, fx.TYPES, "t string").select(F.lit("type").alias("what"), F.col("t").alias("raw"), text.title_type(F.col("t")).alias("shown"))
    colors = _rows(spark, fx.COLORS, "t string").select(F.lit("color").alias("what"), F.col("t").alias("raw"), text.hex_color(F.col("t"), "#DC2626").alias("shown"))
    return progress.union(prices).union(tiers).union(types).union(colors)


def output_paths(spark, sf_dir):
    files = readers.pdf_files(_rows(spark, fx.FILES, "path string"))
    return files.select("path", text.suffixed_path(F.col("path"), "_scrubbed").alias("scrubbed"), text.suffixed_path(F.col("path"), "_fulltext", ".txt").alias("full_text"))


def redeem_status(spark, sf_dir):
    return _rows(spark, fx.REDEEM, "status int, message string").select("status", "message", text.redeem_status(F.col("status"), F.col("message")).alias("outcome"))


def tier_dimension(spark, sf_dir):
    return _rows(spark, fx.PRODUCTS, "product_id string, tier string, pages long, price_cents long")


def label_categories(spark, sf_dir):
    return labels.label_map(spark)


def device_id(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").select("c_custkey", identity.machine_id(F.concat(F.lit("  "), F.upper(F.md5(F.col("c_custkey").cast("string").cast("binary"))))).alias("machine_id"))
    return ids.select("c_custkey", "machine_id", identity.device_id(F.col("machine_id")).alias("device_id"))


def validate_ids(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    raw = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.sha2(F.col("c_name").cast("binary"), 256))
    pages = (F.col("c_custkey") * 7 % 12_000 - 100).cast("string")
    return c.select("c_custkey", identity.machine_id(raw).isNotNull().alias("machine_ok"), identity.device_id_ok(raw).alias("device_ok"), identity.pages_ok(F.when(F.col("c_custkey") % 5 == 0, F.lit("x")).otherwise(pages)).alias("pages_ok"))


def request_lines(spark, sf_dir):
    return readers.requests(_rows(spark, fx.REQUEST_LINES, "line_no long, raw string"))


def identifier_lists(spark, sf_dir):
    rows = _rows(spark, [(1, [("name", " Ann "), (None, "Bob"), ("ssn", " "), ("nick", "Z")]), (2, [])], "row_id long, entries array<struct<type: string, value: string>>")
    return readers.identifiers(rows)


def clean_custom(spark, sf_dir):
    return readers.clean_custom(_rows(spark, fx.CUSTOM, "seq long, value string, type string, line string"))


# metrics


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", F.create_map("event_type", F.col("event_id") % 4).alias("by_type"), F.col("event_id").alias("count"))


def hourly_rollup(spark, sf_dir):
    return metrics.by_hour(metrics.valid_events(_events(spark, sf_dir)))[0]


def hourly_runs(spark, sf_dir):
    return metrics.by_hour(_events(spark, sf_dir))[1]


def additive_upsert(spark, sf_dir):
    e = _events(spark, sf_dir)
    return metrics.merge_counts(metrics.by_hour(e.where("event_id % 2 = 0"))[0], metrics.by_hour(e.where("event_id % 2 = 1"))[0], ["hour", "pii_type"], "count")


def summary_totals(spark, sf_dir):
    return metrics.summary(*metrics.by_hour(_events(spark, sf_dir)))


def history_window(spark, sf_dir):
    return metrics.history(hourly_rollup(spark, sf_dir), F.to_timestamp(F.lit("2024-01-15 12:30:00")), 24).orderBy(F.desc("hour"), "pii_type")


# accounts


def _purchases(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("account_id"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 3 * 100 + 100).alias("quota_total"))


def recent_purchases(spark, sf_dir):
    return ledger.newest(_purchases(spark, sf_dir)).select("account_id", "id", "place")


def purchased_total(spark, sf_dir):
    return _purchases(spark, sf_dir).groupBy("account_id").agg(F.sum("quota_total").alias("total"))


def waterfall_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", *ledger.waterfall(1 + F.col("o_orderkey") % 25, F.col("o_orderkey") % 2, F.col("o_custkey") % 21))


def balance_pivot(spark, sf_dir):
    p = _purchases(spark, sf_dir).withColumn("sku", F.element_at(F.array(F.lit("free_daily"), F.lit("free_week1"), F.lit("prepaid")), (F.col("id") % 3 + 1).cast("int")))
    wide = p.groupBy("account_id").pivot("sku", ["free_daily", "free_week1", "prepaid"]).agg(F.sum("quota_total"))
    left = [ledger.remaining(F.col(c), F.lit(150)).cast("long") for c in ("free_daily", "free_week1", "prepaid")]
    return wide.select("account_id", *[v.alias(c) for v, c in zip(left, ("daily_left", "week1_left", "prepaid_left"))], (left[0] + left[1] + left[2]).alias("available"))


def _resolved(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.md5(F.col("c_custkey").cast("string").cast("binary")).alias("machine_id"))
    c = c.withColumn("device_id", identity.device_id(F.col("machine_id")))
    known = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 6 == 0, F.reverse("machine_id")).otherwise(F.col("machine_id")).alias("machine_id"), "device_id")
    asked = c.withColumn("device_id", F.when(F.col("c_custkey") % 7 == 0, F.reverse("device_id")).otherwise(F.col("device_id")))
    return ledger.resolve_accounts(asked, known, identity.device_id), known


def resolve_accounts(spark, sf_dir):
    return _resolved(spark, sf_dir)[0].select("c_custkey", "account_id", "outcome")


def opened_accounts(spark, sf_dir):
    return ledger.opened_accounts(_resolved(spark, sf_dir)[0], F.to_timestamp(F.lit("2024-03-05 14:30:00")))


def relinked_accounts(spark, sf_dir):
    return ledger.relinked(*_resolved(spark, sf_dir))


def grant_idempotent(spark, sf_dir):
    products = _rows(spark, fx.PRODUCTS, "product_id string, tier string, pages long, price_cents long")
    return ledger.paid_orders(_rows(spark, fx.ORDER_EVENTS, "seq long, body string"), products)


def grant_balances(spark, sf_dir):
    return ledger.grant(_rows(spark, fx.BALANCES, "account_id string, granted long"), grant_idempotent(spark, sf_dir), _rows(spark, fx.DONE_ORDERS, "order_id string"))


def migration_pending(spark, sf_dir):
    return ledger.pending_migrations(_rows(spark, fx.MIGRATIONS, "filename string"), _rows(spark, fx.APPLIED, "filename string"))


def _ledger_events(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    no_lease = [F.lit(None).cast("timestamp").alias("lease_issued_at"), F.lit(None).cast("long").alias("lease_used")]
    base = [F.col("o_custkey").cast("string").alias("account"), F.col("o_orderdate").cast("timestamp").alias("ts")]
    ask = o.select(*base, (F.col("o_orderkey") * 2 + 1).alias("seq"), F.lit("consume").alias("kind"), (F.col("o_orderkey") % 25 + 1).alias("pages"), F.lit(None).cast("string").alias("order_id"), *no_lease)
    buy = o.where("o_orderpriority like '1%'").select(*base, (F.col("o_orderkey") * 2).alias("seq"), F.lit("grant").alias("kind"), F.lit(100).cast("long").alias("pages"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("order_id"), *no_lease)
    return ask.unionByName(buy)


def ledger_replay(spark, sf_dir):
    return ledger.replay(_ledger_events(spark, sf_dir))


def lease_replay(spark, sf_dir):
    from pyspark.sql import Window

    e = _ledger_events(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "grant", "grant").when(F.col("seq") % 3 == 0, "balance").otherwise("consume"))
    before = Window.partitionBy("account").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") == "balance", F.col("ts")), True).over(before)
    told = (F.col("seq") % 5 < 4) & (F.col("kind") != "grant")
    return ledger.replay(e.withColumns({"lease_issued_at": F.when(told, last), "lease_used": F.when(told & last.isNotNull(), F.col("seq") % 12)}))


def offline_consume(spark, sf_dir):
    rows = _rows(spark, fx.OFFLINE, "client string, seq long, now string, pages long, expires_at string, ceiling long, used long")
    return ledger.offline_consume(rows.withColumns({"now": F.to_timestamp("now"), "expires_at": F.to_timestamp("expires_at")}))


def offline_overlay(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    now = F.to_timestamp(F.lit("2024-01-05 00:00:00"))
    states = c.select(k.alias("client"), now.alias("now"), (k % 11).alias("offline_used"), (k % 2).alias("daily_usage"), F.lit(1).cast("long").alias("daily_granted"), (k % 20).alias("week1_usage"), F.lit(20).cast("long").alias("week1_granted"), F.timestamp_add("DAY", (k % 3 - 1).cast("int"), now).alias("week1_expires_at"), (k % 9).alias("prepaid_usage"), F.when(k % 4 > 0, (k % 4) * 5).alias("prepaid_granted"))
    return ledger.overlay(states)


# labelled corpora


def _lines(spark):
    return _rows(spark, fx.SAMPLE_LINES, "line_no long, raw string")


def classify_samples(spark, sf_dir):
    return corpus.classify(_lines(spark)).select("line_no", "status", "token_errors")


def validate_samples(spark, sf_dir):
    return corpus.validate(_lines(spark))


def clean_samples(spark, sf_dir):
    return corpus.clean(_lines(spark)).select("line_no", F.md5(F.col("raw").cast("binary")).alias("raw_md5"))


def _audit(spark, rows):
    each = _rows(spark, rows, "sample_id long, seq long, type string, value string")
    return each.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "type", "value"))), lambda p: F.struct(p["type"].alias("type"), p["value"].alias("value"))).alias("pii"))


def audit_diff(spark, sf_dir):
    diff = corpus.audit_diff(_audit(spark, fx.AUDIT_OLD), _audit(spark, fx.AUDIT_NEW))
    shown = lambda c: F.array_join(F.transform(c, lambda p: F.concat(p["type"], F.lit("="), p["value"])), ";")
    return diff.select("sample_id", shown("added").alias("added"), shown("removed").alias("removed"))


def audit_applied(spark, sf_dir):
    fixed = corpus.apply_audit(_audit(spark, fx.AUDIT_OLD), _audit(spark, fx.AUDIT_NEW))
    return fixed.select("sample_id", F.array_join(F.transform(F.col("pii"), lambda p: F.concat(p["type"], F.lit("="), p["value"])), ";").alias("items"))


def concat_samples(spark, sf_dir):
    """Three lists one after another: 51, 9 and 60 samples."""
    parts = [synth.corpus(spark, n).select(F.lit(i).alias("part"), "row", "kind") for i, n in enumerate((51, 9, 60))]
    return parts[0].union(parts[1]).union(parts[2])


def audit_totals(spark, sf_dir):
    return corpus.audit_diff(_audit(spark, fx.AUDIT_OLD), _audit(spark, fx.AUDIT_NEW)).agg(F.count(F.lit(1)).alias("changed"), F.sum(F.size("added")).alias("added"))


def parity_diff(spark, sf_dir):
    ddl = "label string, text string, start int, score double"
    return corpus.parity(_rows(spark, fx.LEFT, ddl), _rows(spark, fx.RIGHT, ddl))


def parity_top(spark, sf_dir):
    return parity_diff(spark, sf_dir).where("side = 'both'").orderBy(F.desc("drift"), "label", "text").limit(5)


def length_profile(spark, sf_dir):
    return corpus.length_profile(_docs(spark, sf_dir), "text")


def label_census(spark, sf_dir):
    return corpus.label_census(_rows(spark, fx.SPAN_ROWS, "row_id long, text string, spans string"))


def pattern_census(spark, sf_dir):
    return corpus.pattern_census(_rows(spark, fx.SPAN_ROWS, "row_id long, text string, spans string"))


def pattern_hits(spark, sf_dir):
    return corpus.pattern_hits(_rows(spark, fx.SPAN_ROWS, "row_id long, text string, spans string"))


def quality_census(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


# streams


def _stream(spark, sf_dir, name, make, mode):
    from ..streaming import jobs

    return jobs.run_once(make(jobs), name, shared.new_path(spark, "stream"), mode)


def _event_stream(spark, sf_dir, jobs):
    schema = table(spark, sf_dir, "events").schema
    return jobs.file_stream(spark, f"{sf_dir}/events.parque[t]", schema)  # a pattern, so that a single file will do


def stream_rollup(spark, sf_dir):
    return _stream(spark, sf_dir, "rollup", lambda jobs: jobs.hourly(_event_stream(spark, sf_dir, jobs)), "complete")


def stream_grants(spark, sf_dir):
    def make(jobs):
        e = _event_stream(spark, sf_dir, jobs)
        key = F.col("event_id").cast("string")
        twice = e.select("ts", F.explode(F.array(key, key)).alias("order_id"))
        return jobs.grants(twice).select("order_id")

    return _stream(spark, sf_dir, "grants", make, "append")


def stream_ui_fold(spark, sf_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def make(jobs):
        e = _event_stream(spark, sf_dir, jobs)
        last = F.col("event_id") % 50 == 49
        shaped = e.select((F.col("user_id") % 20).alias("doc_id"), F.col("event_id").alias("seq"), F.when(last, "end").otherwise("pii").alias("kind"), F.when(last, "done").alias("status"), F.col("event_type").alias("type"), (F.col("event_id") % 3).cast("string").alias("value"))
        return jobs.fold_items(shaped)

    return _stream(spark, sf_dir, "items", make, "append")


# displays and odds


def acquired_stamps(spark, sf_dir):
    ts = F.timestamp_add("MINUTE", (F.col("o_orderkey") * 37).cast("int"), F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.acquired(ts).alias("stamp"), text.date_time(ts).alias("shown"), text.megabytes(F.col("o_orderkey") * 104_858).alias("size"))


def reading_order(spark, sf_dir):
    px = _boxes(spark, sf_dir).select("doc_id", "type", "value", "page_num", *geometry.pixels(SCALE, F.lit(spans.PAGE_HEIGHT)))
    return boxes.reading_order(px).select("doc_id", "type", "value", "place", "page_num", *[F.floor(F.col(c) * 10 + 0.5).cast("long").alias(c) for c in "xy"])


def download_totals(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 5).alias("file"), F.col("l_partkey").alias("size"))
    files = parts.groupBy("file").agg(F.max("size").alias("size"))
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("total"))


def command_outcomes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cmd = F.when(F.col("event_id") % 2 == 0, "detect").otherwise("scrub")
    phase = F.element_at(F.array(F.lit("ocr"), F.lit("analyze"), F.lit("redact")), (F.col("event_id") % 3 + 1).cast("int"))
    status = F.element_at(F.array(F.lit("started"), F.lit("in_progress"), F.lit("done"), F.lit("error")), (F.col("event_id") % 7 % 4 + 1).cast("int"))
    return e.select("event_id", readers.terminal(cmd, phase, status).alias("ends"))


def page_progress(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("doc_id"), F.when(F.col("event_id") % 2 == 0, "ocr").otherwise("analyze").alias("phase"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 97).alias("page"), F.when(F.col("event_id") % 2 == 1, F.col("event_id") % 89).alias("chunk"), F.lit(100).alias("total"))
    done = readers.progress(e)
    return done.select("doc_id", "phase", text.percent(F.col("done"), F.col("total")).alias("percent"))


def penalty_notices(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("client"), F.col("o_orderdate").alias("lease_issued_at"), (F.col("o_orderkey") % 4).alias("charged"), "o_orderkey")
    return ledger.penalty_notices(rows, rows.where("o_orderkey % 3 = 0")).select("client", "lease_issued_at", "charged")


def purchases_detected(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_custkey") % 50).alias("granted"), F.lit(10).cast("long").alias("usage"))
    polls = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("client"), F.col("o_orderdate").alias("at"), (F.col("o_orderkey") % 60).alias("granted"), F.lit(10).cast("long").alias("usage"))
    return ledger.purchases_detected(c, polls)


def sample_corpus(spark, sf_dir):
    return synth.corpus(spark, 5000).select("row", "kind", "ocr_text", F.to_json("pii").alias("pii"))


def sample_kinds(spark, sf_dir):
    return synth.corpus(spark, 5000).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def sampled_documents(spark, sf_dir):
    return readers.sampled(table(spark, sf_dir, "documents").select("doc_id", "lang"), 10_000, "doc_id")


def model_entities(spark, sf_dir):
    """The model slot with a stand-in model; low scores and incomplete finds go."""
    found = spans.detect_model(spans.chunks(_docs(spark, sf_dir)), fx.load_capitals)
    return spans.first_seen(spans.rebase(found)).select("doc_id", "g_start", "g_end", "label", "text", "score")


def jsonl_lines(spark, sf_dir):
    """Rows appended to a file of JSON lines twice, rewritten in place without some, and read again without blank lines."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    path = shared.new_path(spark, "lines")
    sinks.write_json_lines(rows.where("n_nationkey < 12"), path)
    sinks.write_json_lines(rows.where("n_nationkey >= 12"), path)
    sinks.rewrite(spark.read.schema("n_nationkey long, n_name string").json(path).where("n_nationkey % 5 <> 3"), path)
    return readers.without_blank(readers.jsonl(spark, path)).select("raw")


def stream_json_lines(spark, sf_dir):
    """Events as a stream of JSON lines, one object a line."""
    from ..streaming import jobs

    path = shared.new_path(spark, "emitted")
    shaped = _event_stream(spark, sf_dir, jobs).select(F.lit("detect").alias("cmd"), F.lit("pii").alias("kind"), F.struct(F.col("event_type").alias("type"), F.col("event_id").cast("string").alias("value")).alias("item"))
    jobs.emit(shaped, path, shared.new_path(spark, "stream"))
    return spark.read.text(path).select(F.col("value").alias("raw"))


def sample_batches(spark, sf_dir):
    return synth.first_batches(synth.corpus(spark, 5000)).select("row", "batch", "kind")


QUERIES = [
    scanned_pages, painted_pages, sampled_documents, model_entities, jsonl_lines, stream_json_lines, page_pixel_boxes, opened_accounts, relinked_accounts, audit_applied, concat_samples, sample_batches, acquired_stamps, reading_order, download_totals, command_outcomes, page_progress, penalty_notices, purchases_detected, sample_corpus, sample_kinds,
    chunk_documents, normalize_text, detect_regex_entities, dedupe_entities, aggregate_pii, conversation_pii, index_words, index_word_rows, indexed_text, layout_text, resolve_entity_boxes, pixel_boxes,
    custom_pii_parse, custom_pii_match, custom_emitted, all_items, suppress_hits, dedupe_boxes, attach_boxes, redaction_rects, unredacted_docs, redaction_totals, pages_to_draw, mask_text, redact_text,
    star_text, hash_text, deny_list, cluster_lines, ocr_words, ui_groups, selected_by_type, page_span, keep_checked, selected_values, union_identifiers, detection_json,
    chunk_dump, format_identifier, ui_formats, output_paths, redeem_status, tier_dimension, label_categories, device_id, validate_ids, request_lines, identifier_lists, clean_custom,
    hourly_rollup, hourly_runs, additive_upsert, summary_totals, history_window, recent_purchases, purchased_total, waterfall_split, balance_pivot, resolve_accounts,
    grant_idempotent, grant_balances, migration_pending, ledger_replay, lease_replay, offline_consume, offline_overlay, classify_samples, validate_samples, clean_samples,
    audit_diff, audit_totals, parity_diff, parity_top, length_profile, label_census, pattern_census, pattern_hits, quality_census, stream_rollup, stream_grants, stream_ui_fold,
]
