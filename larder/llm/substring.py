"""Incremental removal of word windows that an earlier document already has, on a log-structured fingerprint index.

A word is a run of bytes other than white space; a window is WINDOW consecutive words of one document. Its hash is that of
its smallest gram of GRAM words, so runs of neighbouring windows share one and the index holds one entry for such a run and
document instead of one per window.

The index is a list of immutable runs, each a table bucketed and sorted by hash. A batch of documents becomes a run; it is
merge-joined with itself and with each older run (bucket by bucket, no older run is shuffled), and hashes that two documents
share are written down. When FANOUT runs of a level have come together they are merged into one of the next level and
dropped, so that a batch meets few runs. What the index finds is then verified on the texts: chunks (windows.py) of equal
hashes are compared window by window, and a window goes only if the same words start in a document of a smaller id. Chunks
that agree in both of two 64-bit hashes, that of a gram and that of all their words, count as equal.

An index given by the caller outlives the call: it keeps its runs and the batch's texts (bucketed by id and text hash), against
which later batches are verified, bucket by bucket, without being shuffled. Rows of earlier batches are not judged again,
whatever ids come later.

Ids may be of any type with an order. A document is known by its id and the hash of its text, so that rows of one id with many
texts are looked at each for its own hashes. Null text has no words. Fewer than WINDOW words: nothing to remove. Null ids have no order: such documents neither lose
windows nor cost others any. Repeated rows have equal ids and don't affect each other. Batches may come in any order of ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import blocks, discard, fresh, join_crowded, materialize, release, text_key
from .windows import PIECE_CLASSES, binary, digest, grouped, spans_of

WINDOW, GRAM, FANOUT = 13, 5, 2


class FingerprintIndex:
    """Sorted immutable runs of (fp, id, h), newest last; h is the hash of the text."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = []  # level, table
        self.texts: list[str] = []  # tables (id, h, t) of earlier batches

    def remember(self, batch: DataFrame) -> None:
        """Keeps the texts of a batch (id, h, t)."""
        name = f"larder_texts_{uuid.uuid4().hex}"
        batch.repartition(self.buckets, "id", "h").write.bucketBy(self.buckets, "id", "h").sortBy("id", "h").option("compression", "zstd").format("parquet").saveAsTable(name)
        self.texts.append(name)

    def history(self) -> list[DataFrame]:
        """The texts of earlier batches, a bucketed table each."""
        return [self.spark.table(name) for name in self.texts]

    def _write(self, df: DataFrame) -> str:
        name = f"larder_run_{uuid.uuid4().hex}"
        df.repartition(self.buckets, "fp").sortWithinPartitions("fp").write.bucketBy(self.buckets, "fp").sortBy("fp").option("compression", "zstd").format("parquet").saveAsTable(name)
        release(self.spark)
        return name

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch of (fp, id, h), each once, as a run; returns the hashes it shares with an older run or within itself."""
        name = self._write(batch)
        new = self.spark.table(name)
        shared = new.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp")
        for _, old in self.runs:
            shared = shared.unionByName(new.select("fp").join(self.spark.table(old).select("fp"), "fp", "left_semi"))
        shared = materialize(shared.distinct(), "index-shared")
        self.runs.append((0, name))
        self.compact()
        return shared

    def compact(self) -> None:
        """Merges the newest runs while fanout of one level have come together."""
        while len(self.runs) >= self.fanout and len({level for level, _ in self.runs[-self.fanout :]}) == 1:
            level, last = self.runs[-1][0], self.runs[-self.fanout :]
            merged = self.spark.table(last[0][1])
            for _, name in last[1:]:
                merged = merged.unionByName(self.spark.table(name))
            self.runs[-self.fanout :] = [(level + 1, self._write(merged))]
            for _, name in last:
                self.spark.sql(f"DROP TABLE {name}")

    def entries(self, hashes: DataFrame) -> DataFrame:
        """The (fp, id, h) entries of the given hashes."""
        out = None
        for _, name in self.runs:
            part = self.spark.table(name).join(hashes, "fp", "left_semi")
            out = part if out is None else out.unionByName(part)
        return out

    def drop(self) -> None:
        for name in [*(name for _, name in self.runs), *self.texts]:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.runs, self.texts = [], []


def _hashed(texts: list[bytes], window: int, gram: int):
    buf, at = K.pack(texts)
    starts, ends, bounds = K.words(buf, at)
    h = K.grams(K.ranges(K.prefix_hashes(buf), starts, ends), gram)
    first = bounds[:-1]
    return buf, starts, ends, bounds, h, first, np.maximum(first, bounds[1:] - window + 1)


def batch_prints(df: DataFrame, id_col: str, text: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(fp, id, h) of a batch, each once per row."""
    base = df.filter(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), text_key(text).alias("h"), F.col(text).alias("_t"))
    kind = base.schema["id"].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary(batch["_t"])
            for lo, hi in blocks(map(len, texts)):
                _, _, _, _, h, first, last = _hashed(texts[lo:hi], window, gram)
                owner, fp = K.least_positions(h, window - gram + 1, first, last)
                order = np.lexsort((fp, owner))
                owner, fp = owner[order], fp[order]
                new = np.ones(len(fp), dtype=bool)
                new[1:] = (fp[1:] != fp[:-1]) | (owner[1:] != owner[:-1])
                pick = pa.array(owner[new] + lo)
                yield pa.RecordBatch.from_arrays([pa.array(fp[new]), batch["id"].take(pick), batch["h"].take(pick)], ["fp", "id", "h"])

    return base.mapInArrow(gather, f"fp long, id {kind}, h long")


def _ranks(values: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of the values."""
    if pa.types.is_integer(values.type):
        return values.to_numpy()
    return np.unique(np.array(values.to_pylist(), dtype=object), return_inverse=True)[1]


def verify(parts: list[DataFrame], found: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(_id, _h, spans of words) of the windows that start in a document of a smaller id.

    parts: frames (id, h, t) that together hold the documents; each meets what is looked for on its own, so bucketed ones stay where they
    are. found: (fp, id, h) to look at.

    First the chunks are named (fp, cid), without their words: a chunk that a smaller id has too goes whole. Only fingerprints
    with several different chunks need words; each of these comes once, from the document of its smallest id. Of crowded
    fingerprints each window comes as a row with its digest, and the smallest id of a digest is found by grouping.
    """
    width = window - gram + 1
    wanted = found.groupBy("id", "h").agg(F.collect_set("fp").alias("fps"))
    kind = parts[0].schema["id"].dataType.simpleString()
    met = lambda rows, *columns: reduce(DataFrame.unionByName, (p.join(rows.hint("merge"), ["id", "h"]).select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("t").alias("_t"), *columns) for p in parts))

    def chunks(texts: list[bytes]):
        buf, starts, ends, bounds, h, first, last = _hashed(texts, window, gram)
        owner, a, b, fp = K.fingerprints(h, width, first, last)
        cid = K.ranges(K.prefix_hashes(K.ranges(K.prefix_hashes(buf), starts, ends)), a, b - 1 + window).view(np.int64)
        return buf, starts, ends, bounds, owner, a, b, fp, cid

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary(batch["_t"])
            for lo, hi in blocks(map(len, texts)):
                _, _, _, bounds, owner, a, b, fp, cid = chunks(texts[lo:hi])
                want = batch["fps"].slice(lo, hi - lo)
                keep = K.member(owner, fp, np.repeat(np.arange(hi - lo), want.value_lengths().to_numpy()), want.flatten().to_numpy())
                owner, a, b, fp, cid = owner[keep], a[keep], b[keep], fp[keep], cid[keep]
                pick = pa.array(owner + lo)
                yield pa.RecordBatch.from_arrays([batch["_id"].take(pick), batch["_h"].take(pick), pa.array(fp), pa.array(cid), pa.array((a - bounds[owner]).astype(np.int32)), pa.array((b - a).astype(np.int32))], ["_id", "_h", "fp", "cid", "p", "core"])

    inst = materialize(met(wanted, "fps").mapInArrow(name, f"_id {kind}, _h long, fp long, cid long, p int, core int"), "substring-chunks")
    first = F.min(F.struct("_id", "_h"))
    classes = inst.groupBy("fp", "cid").agg(first.alias("first"), F.any_value("core").alias("core"), F.count("*").alias("n"))
    classes = materialize(classes.select("fp", "cid", F.col("first._id").alias("least"), F.col("first._h").alias("least_h"), "core", "n"), "substring-classes")

    sizes = classes.groupBy("fp").agg(F.count("*").alias("m")).filter("m > 1").select("fp", (F.col("m") > PIECE_CLASSES).alias("crowded"))
    several = classes.join(sizes, "fp").groupBy(F.col("least").alias("id"), F.col("least_h").alias("h")).agg(F.collect_list(F.struct("fp", "cid", "crowded")).alias("need"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary(batch["_t"])
            for lo, hi in blocks(map(len, texts)):
                buf, starts, ends, _, owner, a, b, fp, cid = chunks(texts[lo:hi])
                need = batch["need"].slice(lo, hi - lo)
                of, flat = np.repeat(np.arange(hi - lo), need.value_lengths().to_numpy()), need.flatten()
                asked = K.mix(flat.field("fp").to_numpy().view(np.uint64) ^ K.mix(flat.field("cid").to_numpy().view(np.uint64) ^ K.mix(of.astype(np.uint64))))
                mine = K.mix(fp.view(np.uint64) ^ K.mix(cid.view(np.uint64) ^ K.mix(owner.astype(np.uint64))))
                order = np.argsort(asked)
                at = np.minimum(np.searchsorted(asked[order], mine), max(0, len(asked) - 1))
                keep = np.flatnonzero(asked[order][at] == mine) if len(asked) else np.zeros(0, dtype=np.int64)
                keep = keep[np.unique(mine[keep], return_index=True)[1]]  # a text may have a chunk twice
                crowded = flat.field("crowded").to_numpy(zero_copy_only=False)[order][at[keep]].astype(bool)
                raw = buf.tobytes()
                spelled = lambda i, j: b" ".join(raw[starts[i] : ends[j]].split())
                # a row for each chunk, or for each window of a crowded one
                many = np.where(crowded, (b - a)[keep], 1)
                rep = np.repeat(np.arange(len(keep)), many)
                s = np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many)
                at, apart = keep[rep], crowded[rep]
                core = np.where(apart, 1, (b - a)[at])
                body = [spelled(i, i + c - 1 + window - 1) for i, c in zip((a[at] + s).tolist(), core.tolist())]
                chunk = pa.array([None if x else t for t, x in zip(body, apart.tolist())], pa.binary())
                w = pa.array([digest(t) if x else None for t, x in zip(body, apart.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(cid[at]), batch["_id"].take(pa.array(owner[at] + lo)), pa.array(core.astype(np.int32)), pa.array(s.astype(np.int32)), chunk, w], ["fp", "cid", "least", "core", "s", "chunk", "w"])

    spelled = materialize(met(several, "need").dropDuplicates(["_id", "_h"]).mapInArrow(spell, f"fp long, cid long, least {kind}, core int, s int, chunk binary, w binary"), "substring-spelled")
    meeting = spelled.filter("w is null").select("fp", "cid", "least", "core", "chunk").repartition("fp").sortWithinPartitions("fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches):
            bodies = binary(rows["chunk"])
            buf, at = K.pack(bodies)
            starts, ends, bounds = K.words(buf, at)
            cores, least = rows["core"].to_numpy(), _ranks(rows["least"])
            w = K.ranges(K.prefix_hashes(buf), starts, ends)
            h = K.grams(w, window)
            owner = np.repeat(np.arange(len(bodies)), cores)
            win = np.arange(len(owner)) - np.repeat(np.cumsum(cores) - cores, cores) + bounds[owner]
            order = np.lexsort((least[owner], h[win]))
            owner, win = owner[order], win[order]
            hh = h[win]
            new = np.append(True, hh[1:] != hh[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(hh)), 0))
            later = np.flatnonzero(least[owner] > least[owner[head]])
            raw = buf.tobytes()
            words_of = lambda i: raw[starts[i] : ends[i + window - 1]]
            good = [k for k in later.tolist() if words_of(win[k]) == words_of(win[head[k]])]
            if len(good) < len(later):  # different words of one hash: compare by words
                first: dict[bytes, int] = {}
                for k in range(len(win)):
                    first[words_of(win[k])] = min(first.get(words_of(win[k]), least[owner[k]]), least[owner[k]])
                good = [k for k in range(len(win)) if least[owner[k]] > first[words_of(win[k])]]
            good = np.array(good, dtype=np.int64)
            s, o = win[good] - bounds[owner[good]], owner[good]
            order = np.lexsort((s, o))
            s, e, o = spans_of(s[order], s[order] + window, o[order])
            table = rows.select(["fp", "cid", "least"]).take(pa.array(o)).combine_chunks()
            yield from table.append_column("s", pa.array(s.astype(np.int32))).append_column("e", pa.array(e.astype(np.int32))).to_batches()

    alone = spelled.filter("w is not null").select("fp", "w", "cid", "least", "s")
    heads = alone.groupBy("fp", "w").agg(F.min("least").alias("head"), F.count("*").alias("n")).filter("n > 1").select("fp", "w", "head")
    later = alone.join(heads, ["fp", "w"]).filter("least > head").select("fp", "cid", "least", "s", (F.col("s") + window).alias("e"))
    apart = materialize(meeting.mapInArrow(compare, f"fp long, cid long, least {kind}, s int, e int").unionByName(later), "substring-apart")
    named = (inst, classes, spelled, apart)
    inst = join_crowded(inst.select("fp", "cid", "_id", "_h", "p"), classes.select("fp", "cid", "least", (F.col("core") + window - 1).alias("n_words"), "n"), ["fp", "cid"], "n")
    copies = inst.filter("_id > least").select("_id", "_h", F.struct(F.col("p").alias("s"), (F.col("p") + F.col("n_words")).alias("e")).alias("x"))
    firsts = inst.filter("_id = least").select("fp", "cid", "_id", "_h", "p").join(apart.select("fp", "cid", "s", "e"), ["fp", "cid"])
    firsts = firsts.select("_id", "_h", F.struct((F.col("p") + F.col("s")).alias("s"), (F.col("p") + F.col("e")).alias("e")).alias("x"))
    spans = materialize(copies.unionByName(firsts).groupBy("_id", "_h").agg(F.collect_set("x").alias("spans")), "substring-spans")
    discard(*named)
    return spans


def _look_up(df: DataFrame, index: FingerprintIndex, id_col: str, text: str, batches: int, window: int) -> DataFrame:
    """The (fp, id, h) entries of all hashes that rows of df share with each other or with the index, to which they are added."""
    shared = None
    for k in range(batches):
        part = df.select(id_col, text).filter(F.pmod(F.xxhash64(id_col), F.lit(batches)) == k)
        got = index.add(batch_prints(part, id_col, text, window))
        shared = got if shared is None else shared.unionByName(got)
    return materialize(index.entries(shared.distinct()), "substring-found")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text: str = "text", batches: int = 2, window: int = WINDOW, kept: str = "kept", removed: str = "removed", index: FingerprintIndex | None = None) -> DataFrame:
    """df with n_words, the remaining words joined by one space, and the removed runs of words (array<struct<s, e>>).

    The rows come to the index in batches, by the hash of the id.
    """
    spark, own = df.sparkSession, index is None
    index = index or FingerprintIndex(spark)
    try:
        found, rows = _look_up(df, index, id_col, text, batches, window), df.select(F.col(id_col).alias("id"), text_key(text).alias("h"), F.col(text).alias("t"))
        parts = [rows]
        if not own:
            parts += index.history()
            index.remember(rows.filter("id is not null and t is not null"))
    finally:
        if own:
            index.drop()
    spans = verify(parts, found, window)
    discard(found)
    key, h, at, said = fresh(df, "__id", "__h", "__spans", "__said")
    spans = spans.select(F.col("_id").alias(key), F.col("_h").alias(h), F.col("spans").alias(at))
    joined = df.join(spans.hint("merge"), df[id_col].eqNullSafe(spans[key]) & (text_key(df[text]) == spans[h]), "left").drop(key, h)

    @F.pandas_udf("n_words long, kept string, removed array<struct<s:int,e:int>>")
    def finish(texts, spans):
        import pandas as pd

        out = []
        for t, xs in zip(texts, spans):
            parts = (t or "").encode().split()
            runs = []
            if xs is not None and len(xs):
                s, e = K.union(np.array([x["s"] for x in xs]), np.array([x["e"] for x in xs]))
                runs = [{"s": int(a), "e": int(b)} for a, b in zip(s, e)]
            left, at = [], 0
            for r in runs:
                left += parts[at : r["s"]]
                at = r["e"]
            out.append((len(parts), b" ".join(left + parts[at:]).decode(), runs))
        return pd.DataFrame(out, columns=["n_words", "kept", "removed"])

    out = joined.withColumn(said, finish(F.col(text), F.col(at))).drop(at)
    return out.withColumns({"n_words": F.col(said)["n_words"], kept: F.col(said)["kept"], removed: F.col(said)["removed"]}).drop(said)
