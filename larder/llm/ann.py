"""Nearest neighbours by inner product, on several shifted Hilbert curves.

Each of CURVES curves projects the vectors to DIMS dimensions of its own (random orthonormal, shifted) and orders them by
their key on a Hilbert curve; Spark range-partitions the keys, and running counts of the partitions give every row its place.
A query meets the rows whose place on some curve is within a half-width of its own; what it meets on all curves is merged
and ranked by the exact inner product of the original vectors, in double precision.

The half-width is measured, not guessed: a bounded sample of SAMPLE queries is compared with all rows, and the half-width is
the smallest that lets the share AIM of their true neighbours be met on one curve at least. Where vectors have structure it is
small; where they have none (in many dimensions, neighbours hardly nearer than the rest) it grows to a share of all rows, as
any ordering then must. Places are dealt to blocks of rows and to cells of queries; a block meets the cells whose windows
touch it, a task each, so both sides of a task are bounded whatever the width of the windows.

Of equal vectors, only the k + 1 of smallest ids can be in any answer (ties go to smaller ids), so only those are placed as
candidates: a hot vector is cut by a window group limit, before and after the shuffle. All are queries if asked for.

Null and zero vectors, those with null or non-finite components, and those of another length than most take no part. Rows
that repeat id and vector count once; rows of one id never answer each other. Fewer candidates than k: all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

CURVES, DIMS, BITS = 4, 6, 10
SAMPLE, AIM, FIT = 96, 0.96, 2000
#: Rows of a block, at least and at most, and places of a cell of queries, in blocks.
BLOCK_MIN, BLOCK_MAX, CELL = 256, 4096, 8


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of cells (n x dimensions, integers below 2**bits)."""
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    for b in range(bits - 1, 0, -1):  # turn the axes back, from the largest cubes to the smallest
        low = (1 << b) - 1
        for i in range(dims):
            upper = (x[:, i] >> b & 1).astype(bool)
            swap = np.where(upper, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(upper, low, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, -1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


def projections(vectors: np.ndarray, curves: int = CURVES, dims: int = DIMS, seed: int = 3) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per curve a projection, the corner of its grid and the width of a cell, fitted to a sample of vectors."""
    rng = np.random.default_rng(seed)
    d = vectors.shape[1]
    out = []
    for _ in range(curves):
        basis = np.linalg.qr(rng.normal(size=(max(d, dims), max(d, dims))))[0][:d, :dims]
        y = vectors @ basis
        spread = np.maximum(y.std(axis=0), 1e-9)
        out.append((basis, y.mean(axis=0) - spread * (4 + rng.random(dims)), 9 * spread / (1 << BITS)))
    return out


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def best(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its k best rows that are not its own."""
    out = []
    rough = q @ x.T
    for i in range(len(q)):
        s = np.where(ids == own[i], -np.inf, rough[i])
        bar = np.partition(s, -k)[-k] if len(s) > k else -np.inf
        near = np.flatnonzero((s >= bar - 1e-9 * max(1.0, abs(bar)) if np.isfinite(bar) else s > -np.inf))
        exact = (x[near] * q[i]).sum(axis=1)
        order = np.lexsort((ids[near], -exact))[:k]
        out.append((ids[near][order], exact[order]))
    return out


def usable(df: DataFrame, id_col: str, vec: str) -> tuple[DataFrame, int]:
    """Distinct (id, v) of the rows that take part, and their length."""
    v = F.col(vec)
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.filter(ok & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = common["n"] if common else 0
    return rows.filter(F.size("v") == dims).distinct(), dims


def neighbours(df: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank, id_col, score. query: which rows ask, as a column over id."""
    spark = df.sparkSession
    rows, dims = usable(df, id_col, vec)
    if not dims:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    order = Window.partitionBy("v").orderBy("id")
    answers = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).select("id", "v", F.lit(True).alias("answers"), F.lit(False).alias("asks"))
    asks = rows.filter(query).select("id", "v", F.lit(False).alias("answers"), F.lit(True).alias("asks"))
    known = materialize(answers.unionByName(asks).groupBy("id", "v").agg(F.max("answers").alias("answers"), F.max("asks").alias("asks")), "ann-rows")
    fit = known.filter("answers").orderBy(F.xxhash64("id"), "id").select("v").limit(FIT).collect()  # bounded by FIT
    grid = projections(np.array([r["v"] for r in fit]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch["v"], dims)
            for c, (basis, corner, width) in enumerate(grid):
                cells = np.clip((x @ basis - corner) / width, 0, (1 << BITS) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(x), pa.int32()), pa.array(hilbert_keys(cells, BITS)), batch["id"], batch["v"], batch["answers"], batch["asks"]], ["curve", "key", "id", "v", "answers", "asks"])

    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = "curve int, key long, id long, v array<double>, answers boolean, asks boolean"
    placed = known.mapInArrow(place, kind).repartitionByRange(n_parts, "curve", "key", "id").sortWithinPartitions("curve", "key", "id")
    placed = placed.select("curve", "id", "v", "answers", "asks", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row"))
    placed = materialize(placed, "ann-curves")
    # places: running counts over partitions and curves, a few numbers for each
    counts = sorted(placed.groupBy("part", "curve").agg(F.count("*").alias("n"), F.min("row").alias("first")).collect(), key=lambda r: (r["curve"], r["part"]))
    offsets, done = [], {}
    for r in counts:
        offsets.append((r["part"], r["curve"], done.get(r["curve"], 0) - r["first"]))
        done[r["curve"]] = done.get(r["curve"], 0) + r["n"]
    total = done[0]
    shift = F.broadcast(spark.createDataFrame(offsets, "part int, curve int, shift long"))
    placed = placed.join(shift, ["part", "curve"]).withColumn("pos", F.col("row") + F.col("shift")).drop("part", "row", "shift")

    half = min(total, half_width(known, placed, dims, k))
    block = int(min(BLOCK_MAX, max(BLOCK_MIN, -(-half // 4))))
    cell, reach, last = CELL * block, -(-half // block), (total - 1) // block
    at = F.floor(F.col("pos") / block)
    # a block goes to the cells that hold a place within reach of it, a query to the blocks within its reach
    cells = F.sequence(F.floor(F.greatest(at - reach, F.lit(0)) * block / cell), F.floor((F.least(at + reach, F.lit(last)) * block + block - 1) / cell))
    index = placed.filter("answers").select("curve", at.alias("block"), F.explode(cells).alias("cell"), "id", "v")
    near = F.sequence(F.greatest(at - reach, F.lit(0)), F.least(at + reach, F.lit(last)))
    asking = placed.filter("asks").select(F.col("curve").alias("qcurve"), F.explode(near).alias("qblock"), F.floor(F.col("pos") / cell).alias("qcell"), F.col("id").alias("qid"), F.col("v").alias("qv"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "ids": pd.Series([], dtype=object), "scores": pd.Series([], dtype=object)})
        x, ids = np.stack(left["v"].to_numpy()), left["id"].to_numpy()
        found = []
        for lo in range(0, len(right), 256):
            part = right.iloc[lo : lo + 256]
            found += best(np.stack(part["qv"].to_numpy()), part["qid"].to_numpy(), x, ids, k)
        return pd.DataFrame({"query_id": right["qid"].to_numpy(), "ids": [f[0] for f in found], "scores": [f[1] for f in found]})

    met = index.groupBy("curve", "block", "cell").cogroup(asking.groupBy("qcurve", "qblock", "qcell")).applyInPandas(meet, "query_id long, ids array<long>, scores array<double>")
    pairs = met.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("id"), F.col("x.scores").alias("score"))
    pairs = pairs.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def half_width(known: DataFrame, placed: DataFrame, dims: int, k: int) -> int:
    """The half-width that meets the share AIM of the true neighbours of a sample of queries."""
    asked = known.filter("asks").orderBy(F.xxhash64("id"), "id").select("id", "v").limit(SAMPLE).collect()  # bounded by SAMPLE
    if not asked:
        return 1
    q, own = np.array([r["v"] for r in asked]), np.array([r["id"] for r in asked])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = best(q, own, matrix(batch["v"], dims), batch["id"].to_numpy(), k)
            n = [len(f[0]) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, n)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], ["query_id", "id", "score"])

    true = known.filter("answers").mapInArrow(scan, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    pairs = true.withColumn("n", rank).filter(F.col("n") <= k).select("query_id", "id").collect()  # SAMPLE * k rows
    wanted = {r["id"] for r in pairs} | set(own.tolist())
    places = {(r["curve"], r["id"]): r["pos"] for r in placed.filter(F.col("id").isin(list(wanted))).select("curve", "id", "pos").collect()}
    curves = {c for c, _ in places}
    gaps = [min(abs(places[c, r["query_id"]] - places[c, r["id"]]) for c in curves) for r in pairs]
    return int(np.quantile(gaps, AIM)) + 1 if gaps else 1
