"""A labelled synthetic corpus: notes of labelled sentences between plain ones, as column expressions.

Every random choice is a hash of (seed, row, purpose), so any row can be made anywhere, in any order, and again. A note's kind
says which values it holds; each value stands in a sentence of its own kind, and plain sentences stand between them. Values use
reserved ranges: example.com, 555-01xx, 192.0.2.x, test card numbers and social security numbers that are never issued.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How often each kind of note is drawn, and the values it holds: one or two of every pattern of the rule detector, and none.
KINDS: dict[str, tuple[int, list[str]]] = {
    "contact": (5, ["full_name", "email_address", "phone_number"]),
    "delivery": (4, ["full_name", "address", "phone_number"]),
    "payment": (4, ["full_name", "credit_card_number", "date"]),
    "payroll": (3, ["full_name", "social_security_number", "account_id"]),
    "border": (2, ["full_name", "government_id", "date"]),
    "sign_in": (2, ["email_address", "other_pii"]),
    "nothing": (3, []),
}
#: Sentences around a value; # is where it stands.
SENTENCES = {
    "full_name": ["The form was filled in by #.", "Please ask for #.", "# called this morning."],
    "email_address": ["Write to # with questions.", "The answer went to # yesterday."],
    "phone_number": ["Call # before noon.", "The number on file is #."],
    "address": ["It goes to # by van.", "The house is at #."],
    "credit_card_number": ["The card used was #.", "Charge # once more."],
    "social_security_number": ["The number # was checked twice.", "Tax papers carry #."],
    "date": ["It is dated #.", "The paper runs out on #."],
    "account_id": ["Money goes to account #.", "The books show account #."],
    "government_id": ["Document # was shown at the desk.", "The clerk noted #."],
    "other_pii": ["The request came from #.", "Somebody signed in from #."],
}
PLAIN = ["The lift is out of order again.", "Rain is expected by the weekend.", "Two copies were made.", "The meeting room is booked until four.", "Nobody answered the door.", "Stamps are in the second drawer."]
PLAIN_SHARE, BREAK_SHARE = 0.4, 0.25

FIRST = ["Ann", "Bob", "Cleo", "Dev", "Elif", "Femi", "Gita", "Hugo", "Ines", "Jo"]
LAST = ["Example", "Sample", "Tester", "Doe", "Quay", "Harbour", "Stone", "River"]
STREETS = ["Quay", "Mill", "Church", "Station", "Garden", "Bridge"]
TOWNS = ["Porthaven", "Eastwick", "Millford", "Lakeside"]


def uniform(seed: int, row: Column, *what: Column | str) -> Column:
    """A number in [0, 1) that depends on these alone: 52 bits of an MD5, so that any engine can make it."""
    parts = [F.lit(x) if isinstance(x, str) else x.cast("string") for x in what]
    text = F.concat_ws("|", F.lit(str(seed)), row.cast("string"), *parts)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def pick(values: list[str], u: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


def weighted(weights: dict[str, int], u: Column) -> Column:
    """A name, each as likely as its weight: the first whose running total passes u."""
    total, running, out = sum(weights.values()), 0, None
    for name, w in weights.items():
        running += w
        out = (F.when if out is None else out.when)(u * total < running, F.lit(name))
    return out


def value(kind: str, seed: int, row: Column) -> Column:
    """One value of a kind; a row's name and its e-mail address belong together."""
    u = lambda part: uniform(seed, row, kind, part)
    number = lambda part, low, high: (F.floor(u(part) * (high - low)) + low).cast("long")
    first, last = pick(FIRST, uniform(seed, row, "first")), pick(LAST, uniform(seed, row, "last"))
    return {
        "full_name": lambda: F.concat_ws(" ", first, last),
        "email_address": lambda: F.concat(F.lower(first), F.lit("."), F.lower(last), number("n", 1, 99).cast("string"), F.lit("@example.com")),
        "phone_number": lambda: F.format_string("(%d) 555-%04d", number("a", 201, 989), number("n", 100, 200)),
        "social_security_number": lambda: F.format_string("%d-%02d-%04d", number("a", 900, 1000), number("b", 1, 70), number("c", 0, 10_000)),
        "credit_card_number": lambda: F.format_string("411111111111%04d", number("n", 0, 10_000)),
        "address": lambda: F.concat_ws(" ", number("n", 1, 200).cast("string"), pick(STREETS, u("s")), F.lit("Street"), pick(TOWNS, u("t")), F.format_string("%05d", number("z", 1, 99_999))),
        "date": lambda: F.format_string("%02d/%02d/%d", number("m", 1, 13), number("d", 1, 29), number("y", 1940, 2006)),
        "account_id": lambda: F.format_string("%010d", number("n", 0, 10**10)),
        "government_id": lambda: F.format_string("X%08d", number("n", 0, 10**8)),
        "other_pii": lambda: F.format_string("192.0.2.%d", number("n", 1, 255)),
    }[kind]()


def scatter(sentences: Column, seed: int, row: Column, plain: float = PLAIN_SHARE, newline: float = BREAK_SHARE) -> Column:
    """A plain sentence first, then the given ones, each on a new line or not and with a plain one behind it or not."""

    def one(s: Column, i: Column) -> Column:
        gap = F.when(uniform(seed, row, "break", i) < newline, "\n").otherwise(" ")
        behind = F.when(uniform(seed, row, "plain", i) < plain, F.concat(F.lit(" "), pick(PLAIN, uniform(seed, row, "which", i)))).otherwise("")
        return F.concat(gap, s, behind)

    return F.concat(pick(PLAIN, uniform(seed, row, "opening")), F.array_join(F.transform(sentences, one), ""))


def corpus(spark: SparkSession, n: int, seed: int = 1337) -> DataFrame:
    """(row, kind, ocr_text, pii): n labelled notes. A value is never broken, so all its words stand in the text."""
    row = F.col("id")
    kind = weighted({k: w for k, (w, _) in KINDS.items()}, uniform(seed, row, "kind"))
    base = spark.range(n).select(row, kind.alias("kind"), *[value(f, seed, row).alias(f) for f in SENTENCES])
    said = {f: F.replace(pick(s, uniform(seed, row, f, "said")), F.lit("#"), F.col(f)) for f, s in SENTENCES.items()}
    text = pii = None
    for name, (_, fields) in KINDS.items():
        sentences = F.array(*[said[f] for f in fields]).cast("array<string>")
        items = F.array(*[F.struct(F.lit(f).alias("type"), F.col(f).alias("value")) for f in fields]).cast("array<struct<type:string,value:string>>")
        text = (F.when if text is None else text.when)(F.col("kind") == name, sentences)
        pii = (F.when if pii is None else pii.when)(F.col("kind") == name, items)
    return base.select(row.alias("row"), "kind", scatter(text, seed, row).alias("ocr_text"), pii.alias("pii"))


def first_batches(samples: DataFrame, size: int = 10, most: int = 5) -> DataFrame:
    """The first rows in batches of `size`, `most` batches at most: samples and `batch` (from 0)."""
    return samples.where(F.col("row") < size * most).withColumn("batch", F.floor(F.col("row") / size).cast("int"))
