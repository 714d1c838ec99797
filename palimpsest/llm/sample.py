"""Bounded samples of labelled rows, drawn by a hash of the id, evenly by label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LABELS = 1024


def by_label(rows: DataFrame, id_col: str, label_col: str, per_label: int) -> DataFrame:
    """About `per_label` rows of each label (all, if fewer): those whose hashed id falls under the label's share.

    Labels are a closed vocabulary; more than MAX_LABELS of them is an error. The share follows from partial counts over
    all rows, so the sample's size doesn't grow with the table.
    """
    counts = rows.groupBy(label_col).count().limit(MAX_LABELS + 1).collect()
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels in {label_col}")
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30))
    pick = F.lit(False)
    for r in counts:
        if r[0] is not None:
            pick = pick | ((F.col(label_col) == F.lit(r[0])) & (place <= int(min(1.0, per_label / r["count"]) * (1 << 30))))
    return rows.where(pick)
