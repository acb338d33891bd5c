"""Spark plumbing of the two operators that look for repeated windows (of words, of bytes).

Equal windows have equal fingerprints (kernels.fingerprints), so it is enough to bring the windows of one fingerprint
together. A chunk is a run of windows of one text that share their fingerprint, with the text they cover; equal chunks form
a class, of which one copy is compared. A fingerprint of very many classes is crowded: its chunks do not meet, but each
window comes as a row of its own with a digest of its content, and Spark groups those, so no task holds the fingerprint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_crowded, materialize

#: Classes of a fingerprint that one task compares; with more it is crowded.
PIECE_CLASSES = 2048
#: Crowded fingerprints that are broadcast at most, eight bytes each; more are joined.
CROWD_ROWS = 1 << 20
#: Bytes of chunks compared at once in a task.
BATCH_BYTES = 1 << 21


def binary(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """A list of values for each of n owners; owner is sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def by_crowding(classes: DataFrame, undecided: str = "false") -> tuple[DataFrame, DataFrame]:
    """Classes (fp, cid, ...) of fingerprints that have several, sorted by fp within partitions; and those of crowded ones.

    undecided: which classes must be looked at even if they are their fingerprint's only one. The list of crowded fingerprints
    has at most a row for every PIECE_CLASSES classes; up to CROWD_ROWS it is broadcast, so their classes stay where they are.
    """
    sizes = classes.groupBy("fp").agg(F.count("*").alias("_m"), F.max(F.expr(undecided)).alias("_u"))
    crowd = materialize(sizes.filter(F.col("_m") > PIECE_CLASSES).select("fp"), "windows-crowd")
    crowd = F.broadcast(crowd) if crowd.count() <= CROWD_ROWS else crowd.hint("merge")
    few = classes.join(crowd, "fp", "left_anti").join(sizes.filter("_m > 1 or _u").select("fp"), "fp")
    return few.repartition("fp").sortWithinPartitions("fp"), classes.join(crowd, "fp", "left_semi")


def digest(window: bytes) -> bytes:
    return hashlib.md5(window, usedforsecurity=False).digest()


def grouped(batches: Iterable[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.Table]:
    """Tables of whole groups of a fingerprint, of about limit bytes of chunks or one group."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        held.append(rows)
        size += rows.nbytes
        if size < limit:
            continue
        whole = pa.concat_tables(held)
        fp = whole["fp"].to_numpy()
        change = np.flatnonzero(fp[1:] != fp[:-1])
        if len(change):
            cut = int(change[-1]) + 1
            yield whole.slice(0, cut)
            held = [whole.slice(cut)]
            size = held[0].nbytes
    if held:
        yield pa.concat_tables(held)


def spans_of(starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of intervals, owner by owner; owner is sorted, and starts and ends are within each owner."""
    if not len(starts):
        return starts, ends, owner
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (starts[1:] > ends[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:] - 1, len(starts) - 1)
    return starts[at], ends[last], owner[at]


def document_spans(places: DataFrame, spans: DataFrame) -> DataFrame:
    """Per document key the spans (array<struct<len, s, e>>) that its chunks cover.

    places: (fp, cid, _id, _h, p); spans: (fp, cid, n, of: array<struct<len, s, e>>), n counting a chunk's places.
    """
    at = join_crowded(places, spans, ["fp", "cid"], "n").select("_id", "_h", "p", F.explode("of").alias("x"))
    at = at.select("_id", "_h", F.struct(F.col("x.len").alias("len"), (F.col("p") + F.col("x.s")).alias("s"), (F.col("p") + F.col("x.e")).alias("e")).alias("x"))
    return at.groupBy("_id", "_h").agg(F.collect_set("x").alias("spans"))
