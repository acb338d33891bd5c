"""Contiguous shards of nearly equal bytes, cut from a global prefix sum of sizes.

Order: texts are placed by (digest of the text, id), so equal texts stand together and the order does not depend on where
rows happen to be stored. The keys are range-partitioned and sorted, without the texts, and checkpointed; then each
partition's total, and the totals of its first and last group, go to the driver (a few numbers per partition), whose
running sums place every partition in the global order. A row goes to the shard in which its place falls when the whole
is cut at equal byte targets. A group of equal texts goes whole to the shard of its first byte, unless it is larger than
GROUP_SHARE of a shard's target: then it is cut like the rest, so that a hot group never unbalances the shards.

Null text counts as no bytes and shares the group of no other text than null. Null ids come first. Repeated rows get a
slot each. With no rows, the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_dir

#: Share of a shard's target up to which a group of equal texts is never cut.
GROUP_SHARE = 0.03


def shard_by_bytes(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text: str = "text", group_share: float = GROUP_SHARE) -> DataFrame:
    """id_col, size, text_crc32, law, shard, slot of every row. slot counts from 0 within a shard, without gaps."""
    scratch_dir(df.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    slim = df.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(body) + 1).cast("long").alias("_size"),
        F.crc32(body.cast("binary")).alias("_crc"),
        F.when(F.col(text).isNull(), F.lit("")).otherwise(F.md5(F.col(text).cast("binary"))).alias("_group"),
    )
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = slim.repartitionByRange(n, "_group", "_id").sortWithinPartitions("_group", "_id")
    placed = placed.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).checkpoint()

    ends = placed.groupBy("_part").agg(F.sum("_size").alias("total"), F.count("*").alias("rows"), F.min("_group").alias("first"), F.max("_group").alias("last"))
    edge = placed.join(F.broadcast(ends.select(F.col("_part").alias("_p"), "first", "last")), F.col("_part") == F.col("_p"))
    edge = edge.groupBy("_part").agg(
        F.sum(F.when(F.col("_group") == F.col("first"), F.col("_size")).otherwise(0)).alias("head"),
        F.sum(F.when(F.col("_group") == F.col("last"), F.col("_size")).otherwise(0)).alias("tail"),
    )
    parts = sorted(ends.join(edge, "_part").collect(), key=lambda r: r["_part"])  # one row per partition
    total = sum(r["total"] for r in parts)
    limit = group_share * total / shards
    # per partition: bytes before it, rows before it, and start and size of the groups that reach over its edges
    layout, spans, before, rows = {}, {}, 0, 0
    for r in parts:
        for name, start, size in {(r["first"], before, r["head"]), (r["last"], before + r["total"] - r["tail"], r["tail"])}:
            spans[name] = (spans[name][0], spans[name][1] + size) if name in spans else (start, size)
        layout[r["_part"]] = [before, rows, r["first"], r["last"]]
        before, rows = before + r["total"], rows + r["rows"]
    layout = {k: (b, n_rows, {g: spans[g] for g in (first, last)}) for k, (b, n_rows, first, last) in layout.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted input; a group that does not end with a batch is held back, unless it is an edge group, whose extent is known
        done, held = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            extents = layout[rows["_part"][0].as_py()][2]
            last = rows["_group"][len(rows) - 1].as_py()
            cut = len(rows) if last in extents else int(np.searchsorted(rows["_group"].to_numpy(), last, side="left"))
            held = rows.slice(cut) if cut < len(rows) else None
            if cut:
                yield from numbered(rows.slice(0, cut), done).to_batches()
                done += int(rows["_size"].to_numpy()[:cut].sum())
        if held is not None:
            yield from numbered(held, done).to_batches()

    def numbered(rows: pa.Table, done: int) -> pa.Table:
        base, row_base, extents = layout[rows["_part"][0].as_py()]
        size, group = rows["_size"].to_numpy(), rows["_group"].to_numpy()
        start = base + done + np.cumsum(size) - size
        new = np.append(True, group[1:] != group[:-1])
        run = np.cumsum(new) - 1
        g_start, g_size = start[new].astype(np.int64), np.bincount(run, weights=size).astype(np.int64)
        for k, name in enumerate(group[new]):
            if name in extents:
                g_start[k], g_size[k] = extents[name]
        at = np.where(g_size[run] <= limit, g_start[run], start)
        shard = np.minimum(shards - 1, at * shards // max(total, 1)).astype(np.int32)
        return rows.select(["_id", "_size", "_crc"]).append_column("_shard", pa.array(shard)).append_column("_place", pa.array(row_base + rows["_row"].to_numpy()))

    kind = slim.schema["_id"].dataType.simpleString()
    cut = placed.mapInArrow(assign, f"_id {kind}, _size long, _crc long, _shard int, _place long")
    firsts = cut.groupBy("_shard").agg(F.min("_place").alias("_first"))  # a row per shard at most
    return cut.join(F.broadcast(firsts), "_shard").select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), (F.col("_place") - F.col("_first")).alias("slot")
    )
