"""Importance resampling of documents towards a target distribution, over hashed features.

A document's features are its runs of consecutive words (lower-cased A-Z; a word is a run of digits, letters a-z and
characters beyond ASCII), each counted in the bucket that its crc32 names. The sparse matrix of documents by buckets is
written once, as blocks of compressed sparse rows: a table row holds some documents, their row bounds, columns and counts.
Everything else reads these blocks, not the texts: column sums give the distribution of the corpus, the same sums over the
target's texts give its distribution, and a sparse matrix-vector product with the gains of the buckets gives the weights.

What goes to the driver and by broadcast is one number a bucket, whatever the size of the corpus, and of the drawing the
number of documents a score (scores are whole numbers between fixed bounds: a few ten thousand differ) and a count a partition
of what is drawn. The drawn rows are range-partitioned on (score, id, place in the blocks), which no two rows share, so
neither a frequent score nor a frequent id makes a large partition; all others keep their place.

Text null, empty or without words: no features, weight 0. Null ids count as the empty text in the noise and come last among
ties. Rows that repeat id and text have one score and a rank each. Without rows the result is empty; without target texts all
gains follow from the corpus alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import blocks, discard, materialize
from .windows import binary

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
#: Bytes of texts in a block of the matrix, unless one text is longer.
CSR_BYTES = 1 << 22
#: Bytes up to which all runs are hashed together.
LONG = 64
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], dtype=np.uint8)


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_CRC = _crc_table()


def crc32(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The crc32 of each buf[start:end], a byte of all of them at a time, longest first."""
    n = ends - starts
    out = np.empty(len(n), dtype=np.uint32)
    for k in np.flatnonzero(n > LONG):
        out[k] = zlib.crc32(buf[starts[k] : ends[k]].tobytes())
    short = np.flatnonzero(n <= LONG)
    short = short[np.argsort(-n[short], kind="stable")]
    at, left = starts[short], n[short]
    c = np.full(len(short), 0xFFFFFFFF, dtype=np.uint32)
    for j in range(int(left[0]) if len(left) else 0):
        m = int(np.searchsorted(-left, -j, side="left"))
        c[:m] = _CRC[(c[:m] ^ buf[at[:m] + j]) & np.uint32(255)] ^ (c[:m] >> np.uint32(8))
    out[short] = c ^ np.uint32(0xFFFFFFFF)
    return out


def count(texts: list[bytes], buckets: int, runs: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and features of each text, and its rows of the matrix: bounds, columns in order, counts."""
    buf, at = K.pack(texts)
    buf = _FOLD[buf]
    starts, ends, bounds = K.words(buf, at)
    keep = buf != 32
    keep[ends] = True  # one space after each word
    buf = buf[keep]
    n = ends - starts
    starts = np.cumsum(n + 1) - (n + 1)
    ends = starts + n
    n_words = np.diff(bounds)
    last = np.repeat(bounds[1:], n_words)  # one past the last word of a word's text
    doc = np.repeat(np.arange(len(texts)), n_words)
    cells, n_features = [], np.zeros(len(texts), dtype=np.int64)
    for r in range(runs[0], runs[1] + 1):
        first = np.flatnonzero(np.arange(len(starts)) + r <= last)
        cells.append(doc[first] * buckets + crc32(buf, starts[first], ends[first + r - 1]) % np.uint32(buckets))
        n_features += np.bincount(doc[first], minlength=len(texts))
    cell, times = np.unique(np.concatenate(cells).astype(np.int64), return_counts=True)
    return n_words, n_features, np.searchsorted(cell, np.arange(len(texts) + 1) * buckets), cell % buckets, times


def count_matrix(df: DataFrame, text: str = "text", carry: tuple[str, ...] = (), buckets: int = BUCKETS, runs: tuple[int, int] = (1, 1)) -> DataFrame:
    """The blocks of the matrix, written to the shared folder: block, the carried columns as lists (c0, c1, ...), words, features, bounds, columns, counts."""
    slim = df.select(F.col(text).cast("string").alias("t"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(carry)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda a, kind: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, kind))
        for batch in batches:
            texts = binary(batch["t"])
            for lo, hi in blocks(map(len, texts), CSR_BYTES):
                words, features, bounds, columns, counts = count(texts[lo:hi], buckets, runs)
                own = [batch[f"c{k}"].slice(lo, hi - lo) for k in range(len(carry))]
                own = [pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), pa.concat_arrays([x])) for x in own]
                yield pa.RecordBatch.from_arrays([*own, one(words, pa.int64()), one(features, pa.int64()), one(bounds, pa.int32()), one(columns, pa.int32()), one(counts, pa.int32())], names)

    names = [*(f"c{k}" for k in range(len(carry))), "words", "features", "bounds", "columns", "counts"]
    kinds = [f"c{k} array<{slim.schema[f'c{k}'].dataType.simpleString()}>" for k in range(len(carry))]
    made = slim.mapInArrow(rows, ", ".join([*kinds, "words array<long>", "features array<long>", "bounds array<int>", "columns array<int>", "counts array<int>"]))
    return materialize(made.withColumn("block", F.monotonically_increasing_id()), "csr")


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket. Every partition sums its blocks first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch["columns"].flatten().to_numpy(), weights=batch["counts"].flatten().to_numpy(), minlength=buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in matrix.select("columns", "counts").mapInArrow(partial, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed distributions, floored."""
    t, s, b = target.astype(np.float64), source.astype(np.float64), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def weigh(matrix: DataFrame, gain: np.ndarray, carry: tuple[str, ...]) -> DataFrame:
    """A row per document: the carried columns, n_words, n_features, weight, block, row (its place in the block)."""
    shared = matrix.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = lambda name: batch[name].slice(k, 1).flatten()  # noqa: E731, B023
                bounds, n = one("bounds").to_numpy(), one("features").to_numpy()
                run = np.append(0, np.cumsum(one("counts").to_numpy().astype(np.int64) * shared.value[one("columns").to_numpy()]))
                weight = (run[bounds[1:]] - run[bounds[:-1]]) // np.maximum(n, 1)
                own = [one(f"c{j}") for j in range(len(carry))]
                place = np.arange(len(n), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*own, one("words"), one("features"), pa.array(weight), pa.array(np.full(len(n), batch["block"][k].as_py())), pa.array(place)], names)

    names = [*(f"c{k}" for k in range(len(carry))), "n_words", "n_features", "weight", "block", "row"]
    kinds = [f"c{k} {matrix.schema[f'c{k}'].dataType.elementType.simpleString()}" for k in range(len(carry))]
    return matrix.mapInArrow(product, ", ".join([*kinds, "n_words long", "n_features long", "weight long", "block long", "row int"]))


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from the digest of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(
    df: DataFrame, target: DataFrame, text: str = "text", id_col: str = "doc_id", target_text: str = "text", keep: tuple[str, ...] = (), percent: int = PERCENT, least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS, runs: tuple[int, int] = (1, 1), seed: int = SEED,
) -> DataFrame:
    """Every row's id and keep columns (which may hold the text), with n_words, n_features, weight, score, and rank of the drawn.

    percent of the rows with least_words words are drawn, by score. A kept column of an output's name gives way to the output.
    """
    outputs = ("n_words", "n_features", "weight", "score", "rank")
    carry = (id_col, *(c for c in keep if c != id_col and c.lower() not in outputs))
    matrix, wanted = count_matrix(df, text, carry, buckets, runs), count_matrix(target, target_text, (), buckets, runs)
    weighed = weigh(matrix, gains(column_sums(wanted, buckets), column_sums(matrix, buckets)), carry)
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise(F.col("c0"), seed)), "scored")
    discard(matrix, wanted)

    fit = F.col("n_words") >= least_words
    tally = sorted(((r["score"], r["n"]) for r in scored.filter(fit).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)  # a row a score
    drawn = percent * sum(n for _, n in tally) // 100
    lowest, above = None, 0
    for score, n in tally:
        if above >= drawn:
            break
        lowest, above = score, above + n
    names = [F.col(f"c{k}").alias(c) for k, c in enumerate(carry)]
    out = lambda rows, rank: rows.select(*names, "n_words", "n_features", "weight", "score", rank.cast("long").alias("rank"))
    if lowest is None:
        return out(scored, F.lit(None))
    may = F.coalesce(fit & (F.col("score") >= lowest), F.lit(False))
    order = [F.desc("score"), F.asc_nulls_last("c0"), F.asc("block"), F.asc("row")]
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = scored.filter(may).repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "drawn")
    before, offsets = 0, []
    for r in sorted(placed.groupBy("part").agg(F.count("*").alias("n")).collect(), key=lambda r: r["part"]):  # a count a partition
        offsets.append((r["part"], before))
        before += r["n"]
    shift = df.sparkSession.createDataFrame(offsets, "part int, before long")
    rank = F.col("before") + F.col("at") + 1
    ranked = placed.join(F.broadcast(shift), "part")
    return out(ranked, F.when(rank <= drawn, rank)).unionByName(out(scored.filter(~may), F.lit(None)))
