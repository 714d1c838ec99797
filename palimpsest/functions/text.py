"""Scalar text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import blank_trim

EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def norm(text: Column) -> Column:
    """Lower-cased, without all but a-z and 0-9."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def strip_ellipsis(text: Column) -> Column:
    """Without one leading `...` and the white space behind it."""
    return F.regexp_replace(text, r"(?U)^\.\.\.\s*", "")


def valid_item(kind: Column, value: Column) -> Column:
    """Whether a detected value can be what its type claims: not blank, e-mails in full."""
    v = blank_trim(F.coalesce(value, F.lit("")))
    return (v != "") & ((F.lower(blank_trim(F.coalesce(kind, F.lit("")))) != "email") | v.rlike(EMAIL))


def hex_color(value: Column, fallback: str) -> Column:
    """#RRGGBB, otherwise the fallback."""
    return F.when(value.rlike("^#[0-9A-Fa-f]{6}$"), value).otherwise(F.lit(fallback))


def format_identifier(kind: Column, raw: Column) -> Column:
    """ddd-dd-dddd and dd/dd/dddd as far as digits go; other types unchanged."""
    digits = F.regexp_replace(raw, r"[^0-9]", "")

    def spread(d: Column, cuts: tuple[int, int], sep: str) -> Column:
        a, b = cuts
        parts = [F.substring(d, 1, a), F.substring(d, a + 1, b - a), F.substring(d, b + 1, 9)]
        return F.concat_ws(sep, *[F.when(p != "", p) for p in parts])

    ssn, dob = F.substring(digits, 1, 9), F.substring(digits, 1, 8)
    return F.when(kind == "ssn", spread(ssn, (3, 5), "-")).when(kind == "dob", spread(dob, (2, 4), "/")).otherwise(raw)


def identifier_ok(kind: Column, value: Column) -> Column:
    v = blank_trim(F.coalesce(value, F.lit("")))
    rule = F.when(kind == "ssn", v.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")).when(kind == "dob", v.rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$")).when(kind == "email", v.rlike(EMAIL)).otherwise(F.lit(True))
    return (v != "") & rule


def title_type(kind: Column) -> Column:
    """snake_case as Title Words; only first letters change."""
    return F.array_join(F.transform(F.split(kind, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def percent(done: Column, total: Column) -> Column:
    """Rounded half up; 0 where the total is not positive."""
    return F.when(total > 0, F.floor(done / total * 100 + 0.5).cast("int")).otherwise(F.lit(0))


def price(cents: Column) -> Column:
    """Dollars, without decimals where there are none."""
    return F.when(cents % 100 == 0, F.format_string("$%d", (cents / 100).cast("long"))).otherwise(F.format_string("$%.2f", cents / 100))


def tier_name(tier: Column) -> Column:
    return F.when(tier.isNull() | (tier == ""), F.lit("Prepaid")).otherwise(F.concat(F.upper(F.substring(tier, 1, 1)), F.substring(tier, 2, 1 << 30)))


def snippet(text: Column, position: Column, before: int = 20, after: int = 80) -> Column:
    """The text around a 0-based position, newlines as spaces."""
    low = F.greatest(position - before, F.lit(0))
    return F.translate(text.substr(low + 1, position + after - low), "\n", " ")


def suffixed_path(path: Column, suffix: str, extension: str | None = None) -> Column:
    """A file path with a suffix before its extension, which may be replaced."""
    folder, stem, ext = (F.regexp_extract(path, r"^(.*/)?(.*?)(\.[^./]*)?$", i) for i in (1, 2, 3))
    return F.concat(folder, stem, F.lit(suffix), F.lit(extension) if extension else ext)


def redeem_status(status: Column, message: Column) -> Column:
    m = F.coalesce(message, F.lit(""))
    return (
        F.when(status == 200, "ok")
        .when((status == 400) & m.contains("no_account"), "no_account")
        .when(status == 400, "invalid_input")
        .when((status == 403) & m.contains("key_belongs_to_other_account"), "key_belongs_to_other_account")
        .when(status == 403, "invalid_key")
        .when((status == 409) & m.contains("already_applied"), "already_applied")
        .when(status == 429, "rate_limited")
        .when(status == 503, "validate_unavailable")
        .otherwise("network_error")
    )


def megabytes(size: Column) -> Column:
    """Bytes as MB with one decimal, a half going to the even digit (as C's printf has it, where Java's rounds up); nothing for none."""
    return F.when(F.coalesce(size, F.lit(0)) == 0, "").otherwise(F.format_string("%.1f MB", F.rint(size / (1024 * 1024) * 10) / 10))


def acquired(ts: Column, width: int = 15) -> Column:
    """`May 16  2:30 AM`: date to the left and time to the right of a fixed width."""
    date, time = F.date_format(ts, "MMM d"), F.date_format(ts, "h:mm a")
    return F.concat(date, F.repeat(F.lit(" "), F.greatest(F.lit(1), F.lit(width) - F.length(date) - F.length(time))), time)


def date_time(ts: Column) -> Column:
    return F.date_format(ts, "M/d/yyyy, h:mm a")
