"""Label vocabularies and the category rules over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The display categories in display order.
CATEGORIES = ["name", "date_of_birth", "email", "phone_number", "address", "passport_number", "national_id", "credit_card", "bank_account", "ip_address", "other"]

# Detector labels and the category each is shown under (ssn keeps a category of its own).
LABEL_CATEGORY = {
    "full_name": "name",
    "first_name": "name",
    "last_name": "name",
    "email": "email",
    "phone_number": "phone_number",
    "date_of_birth": "date_of_birth",
    "passport_number": "passport_number",
    "national_id": "national_id",
    "ssn": "ssn",
    "street_address": "address",
    "city": "address",
    "state": "address",
    "postcode": "address",
    "po_box": "address",
    "credit_card": "credit_card",
    "bank_account_number": "bank_account",
    "ip_address": "ip_address",
}

# Aliases of user-given types, the identifier types, and the audited types of labelled corpora.
CUSTOM_ALIASES = {"dob": "date_of_birth", "ssn": "national_id"}
IDENTIFIER_TYPES = ["name", "ssn", "dob", "email", "address", "other"]
AUDITED_TYPES = ["full_name", "address", "social_security_number", "date", "email_address", "phone_number", "credit_card_number", "account_id", "government_id", "other_pii"]


def blank_trim(text: Column) -> Column:
    """Without Unicode white space at both ends; null stays null."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def category(label: Column) -> Column:
    """A detector label's category: trimmed, lower-cased, `other` by default."""
    return F.coalesce(F.try_element_at(_map(LABEL_CATEGORY), F.lower(blank_trim(F.coalesce(label, F.lit(""))))), F.lit("other"))


def display_type(kind: Column) -> Column:
    """A type as the final list shows it: unknown ones are `other`."""
    low = F.lower(blank_trim(F.coalesce(kind, F.lit("other"))))
    return F.when(low.isin(CATEGORIES), low).otherwise(F.lit("other"))


def custom_type(kind: Column) -> Column:
    """A user-given type: aliases resolved, empty and unknown ones `other`."""
    low = F.lower(blank_trim(F.coalesce(kind, F.lit(""))))
    named = F.coalesce(F.try_element_at(_map(CUSTOM_ALIASES), low), low)
    return F.when(named.isin(CATEGORIES), named).otherwise(F.lit("other"))


def category_rank(kind: Column) -> Column:
    """A category's place in display order; unknown ones come last."""
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), kind)
    return F.when(place > 0, place - 1).otherwise(F.lit(99)).cast("int")


def label_map(spark: SparkSession) -> DataFrame:
    """The dimension (vocab, raw, category)."""
    rows = [("model", k, v) for k, v in LABEL_CATEGORY.items()]
    rows += [("display", c, c) for c in CATEGORIES]
    rows += [("identifier", t, CUSTOM_ALIASES.get(t, t)) for t in IDENTIFIER_TYPES]
    return spark.createDataFrame(rows, "vocab string, raw string, category string")
