"""Helpers shared by the text operators.

Document key.  Operators that must come back to a document use the pair (id, xxhash64(text)), compared null-safely:
ids may be null or repeated, and repeated rows share one key and one outcome, so a join on the key never multiplies
rows as long as the other side has one row per key.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 19
#: Keys that join_crowded broadcasts at most.
HOT_KEYS = 10_000


def tune(spark: SparkSession) -> None:
    """Bounds the Arrow batches that go to Python workers: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir, or the session's checkpoint folder.

    Where neither is set: a folder of the warehouse, which drivers and executors share as they share tables.
    """
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/larder-scratch"
        spark.sparkContext.setCheckpointDir(base)
    return base


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there, and an executor's loss costs nothing.

    The files stay as long as the folder does, since the frames that read them are lazy.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.larder_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of materialized frames that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.larder_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_crowded(left: DataFrame, right: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """Inner join of left with right, which has one row per key and, in `rows`, how many rows of left have it.

    Keys that hold more than one in HOT_KEYS of left's rows, of which there are fewer than HOT_KEYS, come by broadcast, so
    their rows stay where they are; all others meet by a merge join. right is read twice: it should be materialized.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot = F.col(rows) * HOT_KEYS > total
    few = right.filter(hot).drop(rows)
    rest = left.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(right.filter(~hot).drop(rows).hint("merge"), keys)
    return left.join(F.broadcast(few), keys).select(*rest.columns).unionByName(rest)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished steps now, not at the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, made from the given ones."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def text_key(text: str | Column) -> Column:
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def blocks(sizes: Iterable[int], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes add up to at most limit, one row at least."""
    start, total, n = 0, 0, 0
    for n, size in enumerate(sizes, 1):
        if total and total + size > limit:
            yield start, n - 1
            start, total = n - 1, 0
        total += size
    if n > start:
        yield start, n
