"""Compression of vectors to codes: whole-number components, a codebook for each of PARTS consecutive parts.

A component x becomes floor(256 x). Each part's codebook starts as that part of the first vectors by id; a round assigns every
part to its nearest entry (squared distance in whole numbers, ties to the lower index) and moves each entry to the floored
mean of its parts. Sums and counts of a round are made in the tasks and added by Spark; what goes to the driver and by
broadcast is the codebooks, whose size depends on the parameters only.

The nearest entry is found by segment-mean lower bounds. By parts of a segment of L components with sums s and residuals
about the mean r, the squared distance is at least (s1 - s2)^2 / L + (|r1| - |r2|)^2. The bound is taken for the whole part,
then for its halves, and so on; an entry whose bound exceeds the exact distance to the entry of the smallest bound cannot be
the nearest and goes. The bounds are in floating point, so they are lowered by more than their rounding; entries left over
receive exact distances in whole numbers, so the result is that of comparing all.

Rows whose vector is null, empty, or holds null or non-finite components take no part, nor do vectors of another length than
most (ties to the shorter). Repeated rows count each. Equal entries: the lower index takes all, the others stay as they are.
Components beyond +-LIMIT / 256 raise, as squared distances would not fit 64 bits. Without rows the result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_crowded, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 27
#: Rows whose bounds are held at once.
ROWS = 4096


def segments(x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: sums and residual norms of its segments of about that length, and the segments' lengths."""
    at = np.arange(0, x.shape[1], length)
    n = np.diff(np.append(at, x.shape[1]))
    sums = np.add.reduceat(x, at, axis=1)
    rest = x * np.repeat(n, n) - np.repeat(sums, n, axis=1)  # whole numbers: the residuals times the length
    norms = np.sqrt(np.add.reduceat(rest.astype(np.float64) ** 2, at, axis=1)) / n
    return sums, norms, n


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row and the squared distance to it; both are int64 matrices of the same width."""
    index, distance = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    length, levels = x.shape[1], []
    while length > 1 or not levels:
        levels.append((length, segments(book, length)))
        length = -(-length // 2)
    largest = float((book.astype(np.float64) ** 2).sum(axis=1).max())
    for lo in range(0, len(x), ROWS):
        part = x[lo : lo + ROWS]
        slack = 1e-9 * (1 + largest + (part.astype(np.float64) ** 2).sum(axis=1))
        row = entry = most = None
        for length, (sums, norms, n) in levels:
            s, r, _ = segments(part, length)
            if row is None:
                bound = (((s[:, None] - sums) ** 2 / n) + (r[:, None] - norms) ** 2).sum(axis=2)
                first = bound.argmin(axis=1)
                most = ((part - book[first]) ** 2).sum(axis=1) + slack
                row, entry = np.nonzero(bound <= most[:, None])
            else:
                bound = (((s[row] - sums[entry]) ** 2 / n) + (r[row] - norms[entry]) ** 2).sum(axis=1)
                left = bound <= most[row]
                row, entry = row[left], entry[left]
        exact = ((part[row] - book[entry]) ** 2).sum(axis=1)
        at = np.searchsorted(row, np.arange(len(part)))  # every row keeps the entry that gave its limit
        least = np.minimum.reduceat(exact, at)
        hit = np.flatnonzero(exact == least[row])
        index[lo : lo + ROWS] = entry[hit[np.searchsorted(row[hit], np.arange(len(part)))]]
        distance[lo : lo + ROWS] = least
    return index, distance


def whole(df: DataFrame, vec: str, **others: str) -> tuple[DataFrame, int]:
    """v (array<long>) and the other columns of the rows that take part, and the length of v."""
    v = F.col(vec)
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    fine = F.forall(v, lambda x: F.abs(x.cast("double")) < LIMIT / SCALE)
    number = F.when(fine, F.transform(v, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))).otherwise(F.raise_error(F.lit(f"a component is not within {LIMIT // SCALE}")))
    rows = df.filter(ok).select(*(F.col(c).alias(name) for name, c in others.items()), number.alias("v"))
    sizes = df.filter(ok).groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return (rows.filter(F.size("v") == sizes["n"]), sizes["n"]) if sizes else (rows, 0)


def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch["v"].flatten().to_numpy().reshape(-1, dims)


def train(rows: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook for each part, of rows (id, v)."""
    if dims % parts:
        raise ValueError(f"vectors of {dims} components have no {parts} equal parts")
    width = dims // parts
    first = rows.orderBy(F.asc_nulls_last("id"), "v").select("v").limit(entries).collect()  # as many rows as entries
    start = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), dims)
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    spark = rows.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            books = shared.value
            n, sums = np.zeros((parts, len(books[0])), dtype=np.int64), np.zeros((parts, len(books[0]), width), dtype=np.int64)
            for batch in batches:
                x = matrix(batch, dims)
                for p, book in enumerate(books):
                    own = x[:, p * width : (p + 1) * width]
                    index, _ = nearest(own, book)
                    n[p] += np.bincount(index, minlength=len(book))
                    np.add.at(sums[p], index, own)
            part, entry = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

        added = rows.select("v").mapInArrow(add, "part int, entry int, n long, sums array<long>").groupBy("part", "entry")
        books = [b.copy() for b in books]
        for r in added.agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width))).collect():  # a row an entry
            books[r["part"]][r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.reshape(-1).tolist()).encode()).hexdigest()


def encode(rows: DataFrame, dims: int, books: list[np.ndarray]) -> DataFrame:
    """rows (all columns but v) with code and error."""
    shared, others = rows.sparkSession.sparkContext.broadcast(books), [c for c in rows.columns if c != "v"]
    width = dims // len(books) if books else 0

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, dims)
            found = [nearest(x[:, p * width : (p + 1) * width], book) for p, book in enumerate(shared.value)]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in others), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(sum(f[1] for f in found))], [*others, "code", "error"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("v").schema]
    return rows.select(*others, "v").mapInArrow(assign, ", ".join([*kinds, "code string", "error long"]))


def decode(code: str, books: list[np.ndarray]) -> np.ndarray:
    """The vector that a code stands for, in the scale of the original."""
    return np.concatenate([book[k] for book, k in zip(books, bytes.fromhex(code))]) / SCALE


def compress(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """id_col, code, error, label_error, codebooks_sha256 of every row that takes part. At most 256 entries.

    label_error is the error summed over the rows whose labels are equal as text, nulls together; a label of very many rows
    is joined by broadcast, so its rows stay where they are.
    """
    rows, dims = whole(df, vec, id=id_col, label=label)
    if not dims:
        return rows.select(F.col("id").alias(id_col), *(F.lit(None).cast(kind).alias(name) for name, kind in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))))
    books = train(rows, dims, parts, entries, rounds)
    slim = rows.select("id", F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label"), "v")
    coded = materialize(encode(slim, dims, books), "codes")
    sums = materialize(coded.groupBy("none", "label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "code-labels")
    out = join_crowded(coded, sums, ["none", "label"], "n")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
