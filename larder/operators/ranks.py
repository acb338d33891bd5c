"""Places in a total order, without one task that sorts all: ranges are sorted apart, and their sizes say where each begins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .steps import forget, step


def ranked(df: DataFrame, *order: Column, out: str = "place", within: str | None = None) -> DataFrame:
    """df with its place (long, from 1) in an order, which should be total. within: a column whose values are each numbered from 1.

    Rows are range-partitioned on the order (within first), sorted, and written; a few numbers for each range go to the driver, or, with
    within, for each range and value that meets it. Range partitioning reads its rows twice, so they are written first, unless they are a step's or were
    ranked before.
    """
    given = df if hasattr(df, "larder_path") else step(df, "to-rank")
    keys = ([F.asc(within)] if within else []) + list(order)
    sorted_rows = given.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    held = step(sorted_rows.withColumn("__part", F.spark_partition_id()).withColumn("__row", at), "ranked")
    group = F.col(within) if within else F.lit(None).cast("string")
    if given is not df:
        forget(given)
    counted = held.groupBy("__part", group.alias("__of")).agg(F.count("*").alias("n"), F.min("__row").alias("first"))
    seen: dict[object, int] = {}
    offsets = []
    for r in sorted(counted.collect(), key=lambda r: r["__part"]):  # a row a range and value
        offsets.append((r["__part"], r["__of"], seen.get(r["__of"], 0) - r["first"]))
        seen[r["__of"]] = seen.get(r["__of"], 0) + r["n"]
    kind = held.schema[within].dataType.simpleString() if within else "string"
    shift = df.sparkSession.createDataFrame(offsets, f"__p int, __of {kind}, __shift long")
    cond = (F.col("__part") == F.col("__p")) & (F.col(within).eqNullSafe(F.col("__of")) if within else F.lit(True))
    placed = held.join(F.broadcast(shift), cond).withColumn(out, F.col("__row") + F.col("__shift") + 1).select(*df.columns, out)
    placed.larder_path = held.larder_path
    return placed
