"""Streaming ingest: feed files as they arrive, through the batch operators, into a keyed table (operators.keyed)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.classify import Rules
from ..operators import ingest, keyed

KEYS = ["store", "product_name", "valid_from"]


def ingest_batch(raw: DataFrame, rules: Rules = ()) -> DataFrame:
    """Raw feed rows as stored deals, one a key; rules are the user's keywords."""
    valid, _ = ingest.split_valid(raw)
    kept = ingest.filter_grocery(valid).filter("grocery.keep").drop("grocery")
    rows = ingest.to_row(ingest.with_unit_price(ingest.categorised(kept, rules=rules)))
    return ingest.best_per_key(rows, KEYS, order="id")


def stream_feeds(spark: SparkSession, source: str, table: str, checkpoint: str, rules: Rules = ()) -> StreamingQuery:
    """Ingests new JSON files of source into table until they are used up. A replayed batch changes nothing: the merge is by key,
    and writes only the buckets of keys whose rows are new or differ."""

    def apply(batch: DataFrame, _: int) -> None:
        rows = ingest_batch(batch, rules)
        keyed.merge(rows, table) if keyed.exists(batch.sparkSession, table) else keyed.create(rows, table, KEYS)

    rows = spark.readStream.schema(ingest.RAW).option("multiLine", True).json(source)
    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(rows: DataFrame, event_time: str, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """The first of equal keys within the watermark."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(rows: DataFrame, event_time: str, key: str, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return rows.withWatermark(event_time, delay).groupBy(F.window(event_time, size), key).agg(F.count("*").alias("n"))
