"""Machine and device ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The byte pattern that device ids are derived with.
PATTERN = [0x5A, 0x3C, 0xA7, 0xE1, 0x18, 0x9F, 0x42, 0xB6]


def machine_id(raw: Column) -> Column:
    """Trimmed and lower-cased; null unless it is 32 to 64 hex digits or dashes."""
    v = F.lower(F.trim(raw))
    return F.when(v.rlike("^[0-9a-f-]{32,64}$"), v)


def device_id_ok(raw: Column) -> Column:
    return F.coalesce(raw.rlike("^[0-9a-f]{64}$"), F.lit(False))


def pages_ok(raw: Column, most: int = 10_000) -> Column:
    n = F.expr("try_cast(_p AS double)") if isinstance(raw, str) else raw.try_cast("double")
    return F.coalesce((n == F.floor(n)) & n.between(1, most), F.lit(False))


def shuffled_hex(raw: Column) -> Column:
    """The id's bytes XORed with the repeated pattern and rotated by half, as hex."""
    text = F.hex(F.encode(raw, "UTF-8"))
    n = (F.length(text) / 2).cast("int")
    pattern = F.array(*[F.lit(x) for x in PATTERN])
    mixed = F.transform(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.lpad(F.hex(F.conv(text.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("long").bitwiseXOR(F.get(pattern, i % len(PATTERN)).cast("long"))), 2, "0"),
    )
    half = F.floor(n / 2).cast("int")
    return F.array_join(F.concat(F.slice(mixed, half + 1, n), F.slice(mixed, 1, half)), "")


def device_id(raw: Column) -> Column:
    """The hex SHA-256 of the shuffled bytes."""
    return F.sha2(F.unhex(shuffled_hex(raw)), 256)
