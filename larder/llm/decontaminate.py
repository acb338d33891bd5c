"""Documents that hold a benchmark item, with edits, found by the q-gram lemma and banded alignment.

Texts are compared in lower case, every run of white space as one space, as UTF-8 bytes. An item of m bytes may differ by
k = min(RATE * m, (m - Q) / Q) edits, rounded down. If a place of a document is within k edits of the item, the two share at least
m - Q + 1 - k * Q grams of Q bytes, on at most k + 1 neighbouring diagonals. So shared grams are counted in overlapping
bands, each 2 * (k + 1) diagonals wide and half over the next; bands that reach the bound are aligned, within the band, and
kept if the item fits with k edits or fewer. Items shorter than 2 * Q bytes match only a text that equals them.

The benchmark's index goes to the tasks as a broadcast; its size is checked first, as INDEX_RATE bytes for each byte of
items. A benchmark whose index would exceed INDEX_BYTES is dealt into slices, one pass over the documents each, so no
broadcast exceeds it however large the benchmark is. A gram of many items meets them PAIRS at a time.

Null and empty items are never found, null texts are empty; every row is judged by itself, so repeated rows give repeated
results, and repeated items a result each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import blocks
from .windows import binary

Q, RATE = 8, 0.10
INDEX_BYTES, INDEX_RATE, PAIRS = 128 << 20, 24, 1 << 22
BITS = 22


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "replace").split())


@dataclass
class Items:
    """An index of items: ids, texts, edit budgets, and where each gram occurs."""

    ids: list
    texts: list[bytes]
    budget: np.ndarray
    least: np.ndarray  # shared grams that a match has at least
    exact: dict[bytes, list[int]]
    grams: np.ndarray  # distinct, sorted
    first: np.ndarray  # of each gram's occurrences
    item: np.ndarray
    at: np.ndarray
    seen: np.ndarray  # whether a gram with these leading bits exists


def index(rows: list[tuple], q: int = Q, rate: float = RATE) -> Items:
    rows = [(i, t) for i, t in ((i, normal(t)) for i, t in rows) if t]
    texts = [t for _, t in rows]
    m = np.array([len(t) for t in texts], dtype=np.int64)
    budget = np.maximum(0, np.minimum((rate * m).astype(np.int64), (m - q) // q))
    exact: dict[bytes, list[int]] = {}
    grams, item, at = [], [], []
    for k, t in enumerate(texts):
        if len(t) < 2 * q:
            exact.setdefault(t, []).append(k)
            continue
        g = K.grams(np.frombuffer(t, dtype=np.uint8), q)
        grams.append(g)
        item.append(np.full(len(g), k))
        at.append(np.arange(len(g)))
    cat = lambda xs, kind: np.concatenate(xs).astype(kind) if xs else np.zeros(0, dtype=kind)
    grams, item, at = cat(grams, np.uint64), cat(item, np.int32), cat(at, np.int32)
    order = np.argsort(grams, kind="stable")
    grams, item, at = grams[order], item[order], at[order]
    distinct, first = np.unique(grams, return_index=True)
    seen = np.zeros(1 << BITS, dtype=bool)
    seen[(distinct >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return Items([i for i, _ in rows], texts, budget, m - q + 1 - budget * q, exact, distinct, np.append(first, len(grams)), item, at, seen)


def fit(item: bytes, region: bytes, budget: int) -> tuple[int, int] | None:
    """(edits, end) of the cheapest place of region that the item fits, first of equals, if within budget.

    The item's j-th byte may meet region[j : j + width], width being what region has over the item; the path stays in this band.
    """
    if (hit := region.find(item)) >= 0:
        return 0, hit + len(item)
    # the path may begin or turn up to budget bytes outside of what the item covers; bytes 1 stand for what lies beyond the region
    m = len(item)
    if m - len(region) > budget:
        return None
    width = max(0, len(region) - m) + 2 * budget
    text = np.frombuffer(b"\1" * budget + region + b"\1" * (m + width + 1), dtype=np.uint8)
    steps = np.arange(width + 1)
    cost = np.zeros(width + 1, dtype=np.int64)  # cost[d]: item[:j] against what ends before text[j + d]
    for j in range(m):
        now = cost + (text[j : j + width + 1] != item[j])
        now[:-1] = np.minimum(now[:-1], cost[1:] + 1)  # a byte of the item is missing
        now = np.minimum.accumulate(now - steps) + steps  # bytes of the text are too many
        cost = now
        if cost.min() > budget:
            return None
    d = int(cost.argmin())
    return int(cost[d]), min(len(region), m + d - budget)


def matches(texts: list[bytes], items: Items, q: int = Q) -> list[tuple[int, int, int, int]]:
    """(text, item, start, edits) of every item found in each text: its cheapest place, first of equals. Start is that of the aligned band."""
    out = [(k, i, 0, 0) for k, t in enumerate(texts) for i in items.exact.get(t, ())]
    if not len(items.grams):
        return out
    buf, at = K.pack(texts)
    g = K.grams(buf, q)
    pos = np.flatnonzero(items.seen[(g >> np.uint64(64 - BITS)).astype(np.int64)])
    where = np.minimum(np.searchsorted(items.grams, g[pos]), len(items.grams) - 1)
    ok = items.grams[where] == g[pos]
    pos, where = pos[ok], where[ok]
    doc = np.searchsorted(at, pos, side="right") - 1
    inside = pos + q < at[doc + 1]
    pos, where, doc = pos[inside], where[inside], doc[inside]
    n = items.first[where + 1] - items.first[where]

    def meet(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, item and diagonal of every shared gram of places lo to hi."""
        k = n[lo:hi]
        occ = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(items.first[where[lo:hi]], k)
        d, i = np.repeat(doc[lo:hi], k), items.item[occ].astype(np.int64)
        return d, i, np.repeat(pos[lo:hi], k) - at[d] - items.at[occ]

    # the bound on all of a text's grams first: most pairs end here
    total, parts = len(items.texts), list(blocks(n.tolist(), PAIRS))
    met = meet(*parts[0]) if len(parts) == 1 else None  # else twice, to hold only one part at a time
    counts = [np.unique(d * total + i, return_counts=True) for d, i, _ in ([met] if met else map(lambda x: meet(*x), parts))]
    pair, back = np.unique(np.concatenate([p for p, _ in counts]), return_inverse=True) if counts else (np.zeros(0, dtype=np.int64),) * 2
    shared = np.bincount(back, weights=np.concatenate([c for _, c in counts])) if counts else pair
    pair = pair[shared >= items.least[pair % total]]
    kept = [[x[np.isin(d * total + i, pair)] for x in (d, i, g)] for d, i, g in ([met] if met else map(lambda x: meet(*x), parts))]
    doc, item, diagonal = (np.concatenate([k[j] for k in kept]) for j in range(3)) if kept else (pair,) * 3
    half = items.budget[item] + 1
    band = diagonal // half
    key = np.stack([np.concatenate([doc, doc]), np.concatenate([item, item]), np.concatenate([band, band - 1])])
    order = np.lexsort(key[::-1])
    key = key[:, order]
    new = np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)) if key.shape[1] else np.zeros(0, dtype=bool)
    lo = np.flatnonzero(new)
    size = np.diff(np.append(lo, key.shape[1]))
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for k in lo[size >= items.least[key[1, lo]]].tolist() if len(lo) else ():
        d, i, b = key[:, k].tolist()
        item_text, budget = items.texts[i], int(items.budget[i])
        start = b * (budget + 1)
        region = texts[d][max(0, start) : max(0, start + 2 * (budget + 1) + len(item_text))]
        if (best.get((d, i), (1, 0))[0]) and (got := fit(item_text, region, budget)):
            edits, end = got
            found = (edits, max(0, max(0, start) + end - len(item_text)))
            best[d, i] = min(best.get((d, i), found), found)
    return out + [(d, i, start, edits) for (d, i), (edits, start) in best.items()]


def slices(benchmark: DataFrame, item_id: str, text: str, limit: int = INDEX_BYTES) -> Iterator[Items]:
    """Indexes of the benchmark, each of about limit bytes at most; items of one text are dealt by their ids."""
    total = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, -(-int(total) * INDEX_RATE * 5 // (4 * limit)))
    for k in range(n):
        part = benchmark.select(item_id, text)
        part = part.filter(F.pmod(F.xxhash64(text, item_id), F.lit(n)) == k) if n > 1 else part
        yield index(sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[1] or "", str(r[0]))))


def find(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = INDEX_BYTES) -> DataFrame:
    """id_col, item_id, start, edits, budget: a row for each document and item that it holds."""
    spark = df.sparkSession
    base = df.select(F.col(id_col).alias("_id"), F.col(text).alias("_t"))
    kind, item_kind = base.schema["_id"].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    item_type = pa.int64() if item_kind == "bigint" else pa.int32() if item_kind == "int" else pa.string()
    out = None
    for items in slices(benchmark, item_id, item_text, limit):
        shared = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                texts = [normal(t) for t in batch["_t"].to_pylist()]
                for lo, hi in blocks(map(len, texts)):
                    hits = sorted(matches(texts[lo:hi], items))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch["_id"].take(pa.array([lo + h[0] for h in hits], pa.int64())), pa.array([items.ids[h[1]] for h in hits], item_type),
                            pa.array([h[2] for h in hits], pa.int64()), pa.array([h[3] for h in hits], pa.int32()), pa.array([int(items.budget[h[1]]) for h in hits], pa.int32()),
                        ],
                        ["_id", "_item", "start", "edits", "budget"],
                    )

        part = base.mapInArrow(search, f"_id {kind}, _item {item_kind}, start long, edits int, budget int")
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"_id": id_col, "_item": item_id})


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = INDEX_BYTES) -> DataFrame:
    """The rows of df that hold no item, with all their columns."""
    for items in slices(benchmark, item_id, item_text, limit):
        shared = df.sparkSession.sparkContext.broadcast(items)

        @F.pandas_udf("boolean")
        def holds(column, shared=shared):
            import pandas as pd

            texts, found = [normal(t) for t in column], np.zeros(len(column), dtype=bool)
            for lo, hi in blocks(map(len, texts)):
                found[[lo + h[0] for h in matches(texts[lo:hi], shared.value)]] = True
            return pd.Series(found)

        df = df.filter(~holds(F.col(text)))
    return df
