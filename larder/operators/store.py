"""Keyed tables: merges, expiry, backfills. Frames in, the table's next state out; write_table swaps it in."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.units import zurich_day


def on_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of source replace those of target with their keys, or are added; columns in keep stay as they were. One source row a key."""
    s = source.select(*(F.col(c).alias(f"__{c}") for c in source.columns), F.lit(True).alias("__new"))
    t = target.withColumn("__old", F.lit(True))
    j = t.join(s, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)), "full_outer")
    new = F.col("__new").isNotNull()
    pick = lambda c: F.coalesce(c, f"__{c}") if c in keys else F.when(new & ~(F.col("__old").isNotNull() & F.lit(c in keep)), F.col(f"__{c}")).otherwise(F.col(c))
    return j.select(*(pick(c).alias(c) if c in source.columns else F.col(c) for c in target.columns))


def touched(before: DataFrame, after: DataFrame, keys: list[str], now: str, column: str = "updated_at") -> DataFrame:
    """after, with column set to now on rows that were there before and differ in anything else."""
    other = [c for c in after.columns if c not in keys and c != column]
    b = before.select(*(F.col(c).alias(f"__{c}") for c in [*keys, *other]), F.lit(True).alias("__was"))
    j = after.join(b, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)), "left")
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in other), F.lit(True))
    stamp = F.lit(now).cast(after.schema[column].dataType)
    return j.withColumn(column, F.when(F.col("__was") & ~same, stamp).otherwise(F.col(column))).select(*after.columns)


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target and the rows of source whose keys it lacks; the first of equal keys, by all columns."""
    w = Window.partitionBy(*keys).orderBy(*([c for c in source.columns if c not in keys] or keys))
    first = source.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    held = target.select(*(F.col(k).alias(f"__{k}") for k in keys))
    return target.unionByName(first.join(held, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)), "left_anti"))


def expire(deals: DataFrame, now: str) -> DataFrame:
    """Active deals that ended before today in Zurich become inactive."""
    gone = F.col("is_active") & (F.col("valid_to") < zurich_day(F.lit(now).cast("timestamp")))
    return deals.withColumn("is_active", F.when(gone, False).otherwise(F.col("is_active")))


def purge_stale(deals: DataFrame, stores: list[str], started_at: str) -> DataFrame:
    """Active deals of successfully read stores that the run did not touch become inactive."""
    gone = F.col("is_active") & F.col("store").isin(*stores) & (F.col("updated_at") < F.lit(started_at).cast("timestamp_ntz"))
    return deals.withColumn("is_active", F.when(gone, False).otherwise(F.col("is_active")))


def backfill(target: DataFrame, lookup: DataFrame, keys: list[str], column: str) -> DataFrame:
    """column from lookup where it is null; lookup has one row a key."""
    found = lookup.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(column).alias("__v"))
    cond = reduce(lambda x, y: x & y, (target[k] == found[f"__{k}"] for k in keys))
    return target.join(found, cond, "left").withColumn(column, F.coalesce(column, "__v")).drop("__v", *(f"__{k}" for k in keys))


def retag(df: DataFrame, column: str, rules: list[tuple[Column, Column]]) -> DataFrame:
    """Rules applied one after the other: the last that matches decides."""
    out = F.col(column)
    for cond, value in rules:
        out = F.when(cond, value).otherwise(out)
    return df.withColumn(column, out)


def append_terms(df: DataFrame, column: str, terms: list[str], where: Column) -> DataFrame:
    more = F.concat(F.coalesce(column, F.array().cast("array<string>")), F.array(*(F.lit(t) for t in terms)))
    return df.withColumn(column, F.when(where, more).otherwise(F.col(column)))


def changed(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of after that differ from before in some column."""
    b = before.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in columns))
    j = after.join(b, after[key] == b["__k"])
    return j.filter(~reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns))).select(*after.columns)


def latest(df: DataFrame, keys: list[str], by: str, tie: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(by), tie)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def _pointers(spark: SparkSession, path: str):
    """The file system, and the names of the versions pointed at, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/pointers")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []


def write_table(df: DataFrame, path: str, keep: int = 2) -> None:
    """Writes a new version beside the old ones and points at it by one file that is renamed into place: a reader sees a whole
    version, always, and df may read the one before. Of old versions, keep - 1 stay."""
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    fs, old = _pointers(spark, path)
    number = int(old[-1].partition("-")[0]) + 1 if old else 0
    place = lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join((path, *parts)))
    fs.mkdirs(place("pointers"))
    fs.create(place(version, "pointer"), False).close()
    if not fs.rename(place(version, "pointer"), place("pointers", f"{number:012}-{version}")):
        raise RuntimeError(f"version {number} of {path} could not be pointed at")
    for name in old[: max(0, len(old) + 1 - keep)]:
        fs.delete(place("pointers", name), False)
        fs.delete(place(name.partition("-")[2]), True)


def has_table(spark: SparkSession, path: str) -> bool:
    return bool(_pointers(spark, path)[1])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{_pointers(spark, path)[1][-1].partition('-')[2]}")
