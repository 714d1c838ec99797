"""Mixing sources to target weights by Poisson replication, with DataFrame and SQL functions only.

A source's mean repetition rate is its target share of the output over its share of the input. Each document's number of
copies is a Poisson variable with that mean: a uniform number from a seeded hash of its id is put through the inverse
distribution function, a short array for each source. A rate above MAX_RATE is a sum of equal parts, each drawn from a hash of its own:
the sum of independent Poisson variables is one too. Copies are exploded and all rows are put in the order of a second
hash, so neighbours come from all sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, prefix

BROADCAST_SOURCES = 100_000
MAX_RATE = 10_000.0
RUN = 10_000


def uniform(text: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a string's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until the rest is below what 52 bits can hit; in logarithms, so large rates work."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(rate) - F.log(k.cast("double"))
        total = acc["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["cdf"])).otherwise(F.array(F.lit(1.0)))


def rates(df: DataFrame, source_col: str, text_col: str, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, bytes, rate, parts, cdf) for each source, null included; cdf is that of one of the rate's equal parts.

    Target weights are given (sources left out have 0) or the source's bytes to the power alpha. A source without bytes has
    rate 0 if its weight is 0, otherwise `epochs`. No rate is too large: a target that asks for very many copies of each document gets them.
    """
    sizes = df.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0))).cast("double").alias("bytes"))
    if weights is None:
        weight = F.pow("bytes", F.lit(alpha))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.element_at(given, F.col("source").cast("string")).cast("double"), F.lit(0.0))
    sizes = materialise(sizes.withColumn("weight", weight), "mix-sizes")
    total, weigh = sizes.agg(F.sum("bytes"), F.sum("weight")).first()
    rate = F.when(F.col("bytes") > 0, F.lit(epochs * float(total or 0)) * F.col("weight") / F.lit(float(weigh or 1) or 1.0) / F.col("bytes")).when(F.col("weight") > 0, F.lit(epochs)).otherwise(0.0)
    parts = F.greatest(F.ceil(F.col("rate") / MAX_RATE), F.lit(1)).cast("int")
    return materialise(sizes.withColumn("rate", rate).withColumn("parts", parts).withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts"))), "mix-rates")


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: str = "mix") -> DataFrame:
    """df's columns, `copy` (from 1) and `shuffle_key`, in the global order of shuffle_key.

    Rows that repeat an id get the same number of copies; a null id is keyed by its text. Null and empty texts count no bytes
    and are drawn like the rest of their source. No rows: no rows. Columns copy and shuffle_key that are
    already there are replaced.
    """
    df = df.drop("copy", "shuffle_key")
    own = prefix(df, "__mix")
    source, parts, cdf, u, n, start = (f"{own}_{x}" for x in ("source", "parts", "cdf", "u", "n", "from"))
    found = rates(df, source_col, text_col, weights, alpha, epochs).select(F.col("source").alias(source), F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    found = F.broadcast(found) if found.count() <= BROADCAST_SOURCES else found  # beyond, a plain join that AQE splits where it is skewed
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    first = F.array(uniform(F.concat(F.lit(f"{seed}:"), key)))
    more = F.transform(F.sequence(F.lit(1), F.col(parts) - 1), lambda j: uniform(F.concat(F.lit(f"{seed}#"), j.cast("string"), F.lit(":"), key)))
    draws = F.when(F.col(parts) > 1, F.concat(first, more)).otherwise(first)
    drawn = df.join(found, F.col(source_col).eqNullSafe(F.col(source))).withColumn(u, draws)
    copies = F.aggregate(u, F.lit(0), lambda n, u: n + F.size(F.filter(cdf, lambda c: u >= c)))
    rows = drawn.withColumn(n, copies).where(F.col(n) > 0).drop(cdf, u, source, parts)
    rows = rows.withColumn(start, F.explode(F.sequence(F.lit(1), F.col(n), F.lit(RUN))))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col(start), F.least(n, F.col(start) + (RUN - 1))))).drop(n, start)
    return rows.withColumn("shuffle_key", F.md5(F.concat(F.lit(f"{seed}:"), key, F.lit(":"), F.col("copy").cast("string")).cast("binary"))).orderBy("shuffle_key")
