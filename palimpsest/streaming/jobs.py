"""Structured Streaming jobs. Each equals its batch form on the same input; state is bounded by watermarks or by the key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def hourly(events: DataFrame, ts: str = "ts", kind: str = "event_type", late: str = "2 hours") -> DataFrame:
    """(hour, pii_type, count) by tumbling event-time windows; state goes once the watermark has passed."""
    rows = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", "1 hour").alias("w"), F.col(kind).alias("pii_type")).agg(F.count(F.lit(1)).alias("count")).select(F.col("w.start").alias("hour"), "pii_type", "count")


def grants(orders: DataFrame, ts: str = "ts", late: str = "7 days") -> DataFrame:
    """Orders, each id once: what repeats within the watermark is dropped."""
    return orders.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["order_id"])


class ItemFold(StatefulProcessor):
    """A document's items from its event stream: hits count up in first-seen order; the final list replaces them and ends the state."""

    def init(self, handle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "type string, value string", "seq long, n long")
        self.next = handle.getValueState("next", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        # rows of a trigger come in no order; a trigger's size is bounded by its files
        for e in pd.concat(rows).sort_values("seq", kind="stable").itertuples(index=False):
            if e.kind == "pii":
                item = (e.type, e.value)
                if self.items.containsKey(item):
                    seq, n = self.items.getValue(item)
                    self.items.updateValue(item, (int(seq), int(n) + 1))
                else:
                    seq = int(self.next.get()[0]) if self.next.exists() else 0
                    self.items.updateValue(item, (seq, 1))
                    self.next.update((seq + 1,))
            elif e.status in ("done", "error"):
                held = sorted((int(v[0]), k[0], k[1], int(v[1])) for k, v in self.items.iterator())
                out += [(key[0], s, t, v, n, e.status) for s, t, v, n in held]
                self.items.clear()
                self.next.clear()
        yield pd.DataFrame(out, columns=["doc_id", "seq", "type", "value", "count", "status"])

    def close(self) -> None:
        pass


FOLDED = "doc_id long, seq long, type string, value string, count long, status string"


def fold_items(events: DataFrame) -> DataFrame:
    """FOLDED rows, given when a document's command ends; events: doc_id, seq, kind, status, type, value."""
    return events.groupBy("doc_id").transformWithStateInPandas(ItemFold(), FOLDED, "Append", "None")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all that is there, keep the result in a Parquet table under `checkpoint`, and read it back."""
    spark, out = stream.sparkSession, f"{checkpoint}/{name}-out"
    if mode == "complete":
        write = stream.writeStream.outputMode("complete").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(out))
    else:
        write = stream.writeStream.outputMode(mode).format("parquet").option("path", out)
    write.option("checkpointLocation", f"{checkpoint}/{name}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def emit(rows: DataFrame, path: str, checkpoint: str) -> None:
    """A stream's rows as JSON lines under `path`, until its input is read."""
    rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
