"""Stored deals laid out for the questions asked of them: folders by is_active, files and row groups by category and store, Bloom filters on ids.

What partial indexes do in a database, files that need not be read do here: a question about active deals lists one folder, one
about a category and store opens the row groups whose bounds hold them, one about an id those whose Bloom filter may have it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ("category", "store")


def write_deals(deals: DataFrame, path: str, id_col: str = "deal_id", order: tuple[str, ...] = ORDER, ids_a_group: int = 1 << 20, group_bytes: int = 128 << 20) -> None:
    """Rows of one (is_active, order) go to the same files, a frequent one to as many as its size asks for, and are sorted by it and the id within files.

    Partitions are rebalanced, not cut by range: for the bounds of ranges Spark makes all rows once more.
    """
    keys = ["is_active", *order]
    rows = deals.hint("rebalance", *(F.col(k) for k in keys)).sortWithinPartitions(*keys, id_col)
    out = rows.write.mode("overwrite").partitionBy("is_active").option(f"parquet.bloom.filter.enabled#{id_col}", "true").option(f"parquet.bloom.filter.expected.ndv#{id_col}", str(ids_a_group))
    out.option("parquet.block.size", str(group_bytes)).option("parquet.page.size", str(max(1024, group_bytes >> 6))).parquet(path)


def active_of(spark: SparkSession, path: str, category: str | None = None, store: str | None = None, ids: list[str] | None = None, id_col: str = "deal_id") -> DataFrame:
    """Active deals, of a category, a store, some ids: conditions that reach the files."""
    out = spark.read.parquet(path).filter(F.col("is_active") == "true").withColumn("is_active", F.lit(True))  # folders name it as text
    for column, value in (("category", category), ("store", store)):
        out = out if value is None else out.filter(F.col(column) == value)
    return out if ids is None else out.filter(F.col(id_col).isin(ids))


def scanned(df: DataFrame) -> tuple[int, int]:
    """Runs a frame and tells how many files its scans opened and how many rows they gave: those of the row groups that were not ruled out."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaves = plan.collectLeaves()
    metric = lambda name: sum(leaves.apply(k).metrics().apply(name).value() for k in range(leaves.size()))
    return metric("numFiles"), metric("numOutputRows")
