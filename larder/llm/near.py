"""N-gram Jaccard self-join of documents, with Bayesian pruning on MinHash.

A text's set holds its runs of SHINGLE words (all its words as one run if it has fewer); words are bytes other than white
space, unchanged. Two different texts are linked if their sets' Jaccard similarity is THRESHOLD or more.

1. Equal texts form a class, of which one text goes on, so copies never multiply anything.
2. Each text's MinHash values are banded; texts that share a band's values share a bucket. At similarity 0.8 a pair misses
   all of 24 bands of 4 values with probability 3e-6, and less above.
3. Within buckets, pairs are compared on MinHash values a few at a time; a pair is dropped when, given the matches so far and
   an even prior, the probability that its similarity reaches the threshold falls below TOLERANCE. Of the pairs left,
   a spanning forest per bucket goes on. A large bucket is cut into blocks and each pair of blocks is a task of its own, so a
   hot bucket is spread and no pairs are written out.
4. The forests' components hold every pair that was left; each is (block by block) verified exactly, all pairs of it, by
   counting shared shingles. Links are counted per text, and forests of links give the final classes.

Texts without words (null, empty, white space) have no links and are no copies. Ids may be null or repeated: repeated rows
are copies. One row per input row comes out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import blocks, fresh, join_crowded, materialize
from .components import components
from .windows import binary

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS, STEP = 24, 4, 16
#: Texts of a block in buckets and in components; and cells of a dense product at once.
BUCKET_BLOCK, VERIFY_BLOCK, CELLS = 1024, 512, 1 << 22


@lru_cache
def least_matches(step: int, total: int, threshold: float, tolerance: float) -> tuple[int, ...]:
    """For step, 2 * step, ... values compared: fewer matches than this end the comparison."""
    s = (np.arange(20000) + 0.5) / 20000
    out = []
    for n in range(step, total + 1, step):
        m = np.arange(n + 1)
        log = m[:, None] * np.log(s) + (n - m)[:, None] * np.log1p(-s)
        like = np.exp(log - log.max(axis=1, keepdims=True))
        tail = like[:, s >= threshold].sum(axis=1) / like.sum(axis=1)
        out.append(int(np.argmax(tail >= tolerance)))
    return tuple(out)


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the distinct shingles of each text, sorted."""
    buf, at = K.pack(texts)
    starts, ends, bounds = K.words(buf, at)
    prefix = K.prefix_hashes(K.ranges(K.prefix_hashes(buf), starts, ends))
    size = np.diff(bounds)
    many = np.where(size > 0, np.maximum(1, size - n + 1), 0)
    owner = np.repeat(np.arange(len(texts)), many)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + bounds[owner]
    h = K.ranges(prefix, first, np.minimum(first + n, bounds[owner + 1]))
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new]


def signatures(owner: np.ndarray, h: np.ndarray, n: int, count: int = BANDS * ROWS) -> np.ndarray:
    """MinHash values (n x count) of texts that all have shingles."""
    rng = np.random.default_rng(11)
    factors = rng.integers(1, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    at = np.searchsorted(owner, np.arange(n))
    out = np.empty((n, count), dtype=np.uint32)
    for k, f in enumerate(factors):
        x = (low * f) ^ (high * (f ^ np.uint32(0x5BD1E994)))
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        out[:, k] = np.minimum.reduceat(x, at)
    return out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable vertex of each of n vertices."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def pruned(sig: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """Which pairs are left after comparing all values, a step at a time."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for k, least in enumerate(least_matches(STEP, sig.shape[1], threshold, tolerance)):
        cols = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (sig[a[alive], cols] == sig[b[alive], cols]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
    return alive


def block_pairs(df: DataFrame, key: str, vertex: str, size: str, block: int) -> DataFrame:
    """df, once for every pair of blocks of its group that holds its block: columns x <= y (blocks) and own."""
    n = F.ceil(F.col(size) / block).cast("int")
    own = df.withColumn("_n", n).withColumn("own", F.pmod(F.xxhash64(vertex), F.col("_n")).cast("int"))
    own = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return own.withColumn("x", F.least("own", "_o")).withColumn("y", F.greatest("own", "_o")).drop("_n", "_o", size)


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int) -> Iterator[pa.Table]:
    """Tables of whole groups of sorted rows, about limit rows or bytes at once."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        size += held[-1].nbytes
        if size < limit:
            continue
        whole = pa.concat_tables(held)
        change = np.zeros(len(whole) - 1, dtype=bool)
        for k in keys:
            col = whole[k].to_numpy()
            change |= col[1:] != col[:-1]
        if change.any():
            cut = int(np.flatnonzero(change)[-1]) + 1
            yield whole.slice(0, cut)
            held, size = [whole.slice(cut)], whole.slice(cut).nbytes
    if held:
        yield pa.concat_tables(held)


def group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.ones(len(table), dtype=bool)
    new[1:] = False
    for k in keys:
        col = table[k].to_numpy()
        new[1:] |= col[1:] != col[:-1]
    return np.append(np.flatnonzero(new), len(table))


def sign(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(_id, c, sig, bands) of each row: c names the text; null where it has no words."""
    base = df.select(F.col(id_col).alias("_id"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("_c"), F.col(text).alias("_t"))
    kind = base.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary(batch["_t"])
            for lo, hi in blocks(map(len, texts)):
                owner, h = shingle_sets(texts[lo:hi])
                some = np.unique(owner)
                sig = np.zeros((0, BANDS * ROWS), dtype=np.uint32) if not len(some) else signatures(np.searchsorted(some, owner), h, len(some))
                keys = np.zeros((len(some), BANDS), dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    keys = K.mix(keys * K.BASE + sig[:, r::ROWS].astype(np.uint64))
                small = sig.astype("<u2")
                place = {int(o): k for k, o in enumerate(some)}
                has = [place.get(k) for k in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["_id"].slice(lo, hi - lo), pa.array([c if p is not None else None for c, p in zip(batch["_c"].slice(lo, hi - lo).to_pylist(), has)], pa.binary()),
                        pa.array([small[p].tobytes() if p is not None else None for p in has], pa.binary()), pa.array([keys[p].view(np.int64) if p is not None else None for p in has], pa.list_(pa.int64())),
                    ],
                    ["_id", "c", "sig", "bands"],
                )

    return base.mapInArrow(run, f"_id {kind}, c binary, sig binary, bands array<long>")


def candidates(classes: DataFrame) -> DataFrame:
    """Edges (a, b) whose components hold every pair of texts that some bucket joins and pruning leaves."""
    rows = classes.select("c", F.explode("bands").alias("k"))
    crowded = rows.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialize(rows.join(crowded, "k"), "near-members")
    work = block_pairs(members, "k", "c", "n", BUCKET_BLOCK).join(classes.select("c", "sig"), "c")
    work = work.repartition("k", "x", "y").sortWithinPartitions("k", "x", "y")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches, ["k", "x", "y"], 1 << 20):
            bounds = group_bounds(rows, ["k", "x", "y"])
            sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), dtype="<u2").reshape(len(rows), -1)
            own, x, y = (rows[c].to_numpy() for c in ("own", "x", "y"))
            end = np.repeat(bounds[1:], np.diff(bounds))
            partners = end - np.arange(len(rows)) - 1
            left_a, left_b = [], []
            for lo, hi in blocks(partners.tolist(), 1 << 17):
                n = partners[lo:hi]
                a = np.repeat(np.arange(lo, hi), n)
                b = a + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                if (x[lo:hi] != y[lo:hi]).any():  # of two blocks only what crosses
                    keep = (x[a] == y[a]) | (own[a] != own[b])
                    a, b = a[keep], b[keep]
                alive = pruned(sig, a, b)
                left_a.append(a[alive])
                left_b.append(b[alive])
            label = forest(len(rows), np.concatenate(left_a), np.concatenate(left_b))
            child = np.flatnonzero(label != np.arange(len(rows)))
            names = rows["c"].combine_chunks()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(label[child])), names.take(pa.array(child))], ["a", "b"])

    return work.mapInArrow(prune, "a binary, b binary").distinct()


def block_links(texts: list[bytes], own: np.ndarray, crossing: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts (of different blocks only, if crossing) whose sets reach the threshold."""
    owner, h = shingle_sets(texts)
    size = np.bincount(owner, minlength=len(texts))
    _, col, df = np.unique(h, return_inverse=True, return_counts=True)
    keep = df[col] > 1
    owner, col = owner[keep], np.unique(col[keep], return_inverse=True)[1]
    n = len(texts)
    shared = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    width = max(1, CELLS // n)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, b = np.searchsorted(col, (lo, lo + width))
        part = np.zeros((n, min(width, int(col[b - 1]) - lo + 1)), dtype=np.float32)
        part[owner[a:b], col[a:b] - lo] = 1
        shared += part @ part.T
    both = size[:, None] + size[None, :] - shared
    hit = np.triu((shared >= threshold * both - 1e-6) & (both > 0), 1)
    if crossing:
        hit &= own[:, None] != own[None, :]
    return np.nonzero(hit)


def links(df: DataFrame, labels: DataFrame, id_col: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(c, parent, n): for each text of a component of candidates, links counted in one pair of blocks, and a forest of them.

    labels: (c, rep, label); rep is an id whose row holds the text.
    """
    sized = labels.join(labels.groupBy("label").agg(F.count("*").alias("n")), "label")
    base = df.select(F.col(id_col).alias("_id"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("_c"), F.col(text).alias("_t"))
    # a merge at every size: texts are shuffled once, however few the candidates of a small corpus are
    held = base.join(sized.hint("merge"), (base["_c"] == sized["c"]) & base["_id"].eqNullSafe(sized["rep"])).select("label", "c", "n", "_t")
    work = block_pairs(held, "label", "c", "n", VERIFY_BLOCK).withColumn("g", F.xxhash64("label"))
    work = work.repartition("g", "x", "y").sortWithinPartitions("g", "x", "y", "c")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches, ["g", "x", "y"], 1 << 20):
            bounds = group_bounds(rows, ["g", "x", "y"])
            names, bodies, own = rows["c"].to_pylist(), binary(rows["_t"]), rows["own"].to_numpy()
            x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
            child, parent, count = [], [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                once = [k for k in range(lo, hi) if k == lo or names[k] != names[k - 1]]  # repeated rows hold a text twice
                a, b = block_links([bodies[k] for k in once], own[once], bool(x[lo] != y[lo]), threshold)
                label = forest(len(once), a, b)
                n = np.bincount(a, minlength=len(once)) + np.bincount(b, minlength=len(once))
                for k in np.flatnonzero(n).tolist():
                    child.append(names[once[k]])
                    parent.append(names[once[label[k]]])
                    count.append(int(n[k]))
            yield pa.RecordBatch.from_arrays([pa.array(child, pa.binary()), pa.array(parent, pa.binary()), pa.array(count, pa.int64())], ["c", "parent", "n"])

    return work.select("g", "x", "y", "own", "c", "_t").mapInArrow(verify, "c binary, parent binary, n long")


def join(df: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id_col, class_id, n_copies, n_links, c (names the text) and label (names the class): one row per row of df.

    label: the smallest c of all texts that links and copies connect; class_id: their smallest id, which other classes may share. n_copies: rows of the same text.
    n_links: other texts that reach the threshold with this one.
    """
    prints = materialize(sign(df, id_col, text), "near-prints")
    classes = prints.filter("c is not null").groupBy("c").agg(F.min("_id").alias("rep"), F.count("*").alias("n_copies"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands"))
    classes = materialize(classes, "near-classes")
    near = components(candidates(classes))
    labels = materialize(near.join(classes.select("c", "rep"), near["v"] == classes["c"]).select("c", "rep", "label"), "near-labels")
    found = materialize(links(df, labels, id_col, text, threshold), "near-links")
    counts = found.groupBy("c").agg(F.sum("n").alias("n_links"))
    final = components(found.filter("c <> parent").select(F.col("parent").alias("a"), F.col("c").alias("b")))
    heads = final.join(classes.select("c", "rep"), final["v"] == classes["c"]).select("c", "label", "rep")
    heads = heads.join(heads.groupBy("label").agg(F.min("rep").alias("head")), "label").select("c", "label", "head")
    known = classes.select("c", "rep", "n_copies").join(counts, "c", "left").join(heads, "c", "left")
    known = known.select("c", F.coalesce("label", "c").alias("label"), F.coalesce("head", "rep").alias("class"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # rows come back to their text: a hot text's rows stay where they are
    known = materialize(known.withColumn("rows", F.col("n_copies")), "near-known")
    some = join_crowded(prints.filter("c is not null").select("_id", "c"), known, ["c"], "rows")
    out = some.unionByName(prints.filter("c is null").select("_id", "c"), allowMissingColumns=True)
    return out.select(
        F.col("_id").alias(id_col), F.when(F.col("c").isNull(), F.col("_id")).otherwise(F.col("class")).alias("class_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "c", "label"
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df that are the first of their class, all columns kept; rows of texts without words stay.

    The first has the smallest id (null only if all are), then the smallest digest of its text.
    """
    info = join(df, id_col, text, threshold).filter("c is not null").select("label", "c", "class_id", F.col(id_col).alias("id"))
    heads = info.filter("id <=> class_id").groupBy("label", "class_id", "c").agg(F.count("*").alias("n"))
    head, name, n, k = fresh(df, "__head", "__name", "__n", "__k")
    first = heads.groupBy("label", "class_id").agg(F.min(F.struct("c", "n")).alias("f")).select(F.col("class_id").alias(head), F.col("f.c").alias(name), F.col("f.n").alias(n))
    first = materialize(first, "near-first")
    wordless = F.trim(F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     ")) == ""
    named = df.withColumn(k, F.when(~wordless, F.unhex(F.md5(F.col(text).cast("binary")))))
    hit = named.join(first, named[id_col].eqNullSafe(first[head]) & (named[k] == first[name]), "left")
    # of repeated rows of the first, one stays
    once = hit.filter(F.col(k).isNull() | (F.col(n) == 1))
    return once.unionByName(hit.filter(F.col(n) > 1).dropDuplicates([id_col, k])).select(*df.columns)
