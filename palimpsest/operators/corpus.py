"""Labelled corpora: validation, cleaning, audits, profiles and comparison of detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import AUDITED_TYPES, blank_trim
from ..functions.text import strip_ellipsis

SAMPLE = "ocr_text string, pii array<struct<type: string, value: string>>"
LEAST, MOST, SHORT = 300, 500, 250


def parse(lines: DataFrame) -> DataFrame:
    """lines (line_no, raw) with `sample`, and `blank`."""
    return lines.withColumns({"blank": blank_trim(F.col("raw")) == "", "sample": F.from_json("raw", SAMPLE, {"mode": "PERMISSIVE"})})


def schema_ok(sample: Column) -> Column:
    """Text of 300 to 500 characters, a list of items, known types, no empty values."""
    text, pii = sample["ocr_text"], sample["pii"]
    item = lambda p: p["type"].isin(AUDITED_TYPES) & (F.length(p["value"]) >= 1)
    return F.coalesce(F.length(text).between(LEAST, MOST) & pii.isNotNull() & F.forall(pii, lambda p: F.coalesce(item(p), F.lit(False))), F.lit(False))


def missing_tokens(value: Column, text: Column) -> Column:
    return F.filter(F.split(blank_trim(value), r"(?U)\s+"), lambda t: (t != "") & ~F.contains(text, t))


def classify(lines: DataFrame) -> DataFrame:
    """(line_no, raw, status, token_errors): status is blank, schema_error, short, token_error or ok."""
    rows = parse(lines)
    text = strip_ellipsis(F.col("sample.ocr_text"))
    errors = F.size(F.filter("sample.pii", lambda p: F.size(missing_tokens(p["value"], text)) > 0))
    status = (
        F.when(F.col("blank"), "blank").when(~schema_ok(F.col("sample")), "schema_error").when(F.length(text) < SHORT, "short").when(errors > 0, "token_error").otherwise("ok")
    )
    return rows.select("line_no", "raw", status.alias("status"), F.when(~F.col("blank") & schema_ok(F.col("sample")), errors).otherwise(0).alias("token_errors"))


def validate(lines: DataFrame) -> DataFrame:
    """One row: lines read, schema errors, token errors."""
    c = classify(lines).where("status <> 'blank'")
    return c.agg(F.count(F.lit(1)).alias("n_lines"), F.coalesce(F.sum((F.col("status") == "schema_error").cast("long")), F.lit(0)).alias("schema_errors"), F.coalesce(F.sum("token_errors"), F.lit(0)).cast("long").alias("token_errors"))


def clean(lines: DataFrame) -> DataFrame:
    """Lines that stay: blank and unreadable ones too; short ones and those with missing tokens go."""
    return classify(lines).where("status not in ('short', 'token_error')")


def audit_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(sample_id, added, removed) for samples whose items differ, of (sample_id, pii)."""
    both = old.select("sample_id", F.col("pii").alias("was")).join(new.select("sample_id", F.col("pii").alias("now")), "sample_id")
    each = both.select("sample_id", F.array_sort(F.array_except("now", "was")).alias("added"), F.array_sort(F.array_except("was", "now")).alias("removed"))
    return each.where("size(added) > 0 or size(removed) > 0")


def apply_audit(old: DataFrame, new: DataFrame) -> DataFrame:
    """Samples with the audited items in place of the old ones."""
    return old.join(new.select("sample_id", F.col("pii").alias("audited")), "sample_id", "left").withColumn("pii", F.coalesce("audited", "pii")).drop("audited")


def length_profile(texts: DataFrame, text_col: str) -> DataFrame:
    """One row: n, least, p25 ... p99, most, where p is the value at place floor(n * p) - 1 (place -1 is the last).

    Lengths are counted first, so the one task that sorts and sums has a row for each distinct length, not for each text.
    """
    from pyspark.sql import Window

    counts = texts.select(F.length(text_col).alias("len")).where("len is not null").groupBy("len").agg(F.count(F.lit(1)).alias("c"))
    upto = counts.withColumns({"hi": F.sum("c").over(Window.orderBy("len")), "n": F.sum("c").over(Window.partitionBy())})
    upto = upto.withColumn("lo", F.col("hi") - F.col("c"))

    def at(p: float) -> Column:
        place = F.floor(F.col("n") * p) - 1
        place = F.when(place < 0, F.col("n") - 1).otherwise(place)
        return F.max(F.when((F.col("lo") <= place) & (place < F.col("hi")), F.col("len")))

    ps = {f"p{int(p * 100)}": at(p) for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)}
    return upto.agg(F.max("n").alias("n"), F.min("len").alias("least"), *[c.alias(k) for k, c in ps.items()], F.max("len").alias("most"))


SPANS = "array<struct<start: int, end: int, text: string, label: string>>"


def parse_spans(rows: DataFrame, col: str = "spans") -> DataFrame:
    """rows with `span_list` from a list literal of either quoting; unreadable ones are dropped."""
    # Spark's JSON reader takes single quotes; None and booleans of the literal are put into JSON first
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(col), r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    return rows.withColumn("span_list", F.from_json(text, SPANS, {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})).where("span_list is not null")


def label_census(rows: DataFrame) -> DataFrame:
    return parse_spans(rows).select(F.explode("span_list").alias("s")).where("s.label <> ''").groupBy(F.col("s.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


# The pattern of a post box.
PO_BOX = r"(?i)\b(P\.?\s*O\.?\s*Box|PO\s*Box|Post Office Box)\b"


def first_match(text: Column, pattern: str) -> Column:
    """The 0-based place of a pattern's first match; null without one."""
    return F.when(text.rlike(pattern), F.length(F.get(F.split(text, pattern, 2), F.lit(0))))


def pattern_census(rows: DataFrame, pattern: str = PO_BOX, near: int = 80, most: int = 5000, order: str = "row_id") -> DataFrame:
    """Labels of spans that start within `near` characters of a row's first match, over the first `most` matching rows."""
    found = rows.withColumn("at", first_match(F.col("text"), pattern)).where("at is not null").orderBy(order).limit(most)
    near_it = F.abs(F.coalesce(F.col("s.start"), F.lit(-999)) - F.col("at")) < near
    return parse_spans(found).select("at", F.explode("span_list").alias("s")).where(near_it).groupBy(F.col("s.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def pattern_hits(rows: DataFrame, pattern: str = PO_BOX, most: int = 20, order: str = "row_id") -> DataFrame:
    from ..functions.text import snippet

    found = rows.withColumn("at", first_match(F.col("text"), pattern)).where("at is not null").orderBy(order).limit(most)
    return found.select(order, "at", snippet(F.col("text"), F.col("at")).alias("context"))


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """(label, text, side, drift) of two detectors' entities: left, right or both, with the score's absolute change.

    Of entities with the same key the last (by start) counts.
    """
    last = lambda d, n: d.groupBy("label", "text").agg(F.max_by("score", F.struct("start", "score")).alias(n))
    both = last(left, "a").join(last(right, "b"), ["label", "text"], "full")
    side = F.when(F.col("b").isNull(), "left").when(F.col("a").isNull(), "right").otherwise("both")
    return both.select("label", "text", side.alias("side"), F.abs(F.col("b") - F.col("a")).alias("drift"))
