"""Removal of byte strings that occur more than once, by suffix sorting.

Which text is sorted.  A string of LENGTH bytes that occurs twice has a smallest gram (of GRAM bytes, by hash), the same in
both places. Pass one gathers these fingerprints and keeps those found at two places or more; pass two cuts the documents
that hold one into chunks (see windows.py) and brings equal fingerprints together. Fingerprints only say where to look:
what is removed is decided by suffix arrays of the chunks.

How it is sorted.  Two-stage sorting, to a depth of LENGTH bytes: only suffixes that are smaller than their successors are
sorted directly (by eight bytes, then, among equals, by comparing the rest); the others are induced from their successors by
one scan over the buckets of first bytes, in order. Then the common prefixes of neighbours in the array are computed: one of
LENGTH bytes marks both. Equal chunks enter the array once, known by 128 bits of their SHA-256. Fingerprints with too many
different chunks for one task are crowded (windows.py): their windows are compared by digests, as far as the smallest grams
of both sides of a window also come twice. Such windows in a row, that share the place of their left gram, are a run and
compared as one first: runs of the same text around that gram repeat all their windows, runs that differ in what every
window of theirs would share repeat none, and only of the others, one of each text, does each window come as a row.

Several lengths may be asked at once: fingerprints are those of the shortest, chunks reach as far as the longest, and one
array serves all. PASSAGE is the length of a short passage, fifty words of five bytes with their spaces.

Null text is empty. Texts shorter than the length keep everything. Equal texts, also of repeated rows, are copies of each
other. All occurrences are judged on the input and all are removed. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import blocks, discard, fresh, join_crowded, materialize, text_key
from .windows import binary, by_crowding, digest, document_spans, grouped, lists, spans_of

LENGTH, PASSAGE, GRAM = 400, 250, 32


def sort_direct(buf: np.ndarray, raw: bytes, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of buf[i:i+depth]."""
    eight = np.lib.stride_tricks.sliding_window_view(buf, 8)[at].copy().view(">u8").reshape(-1).astype(np.uint64)
    order = np.argsort(eight, kind="stable")
    at, eight = at[order], eight[order]
    new = np.append(True, eight[1:] != eight[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(at))
    out = at.tolist()
    for a, b in zip(lo[hi - lo > 1].tolist(), hi[hi - lo > 1].tolist()):
        out[a:b] = sorted(out[a:b], key=lambda i: raw[i + 8 : i + depth])
    return np.array(out, dtype=np.int64)


def suffix_array(buf: np.ndarray, core: np.ndarray, depth: int) -> np.ndarray:
    """The core positions of buf in the order of their suffixes, to the given depth.

    buf begins with a byte that is not core and ends with depth + 8 bytes that aren't.
    """
    n = len(buf)
    raw = buf.tobytes()
    here = np.arange(n)
    differs = np.append(buf[:-1] != buf[1:], True)
    turn = np.minimum.accumulate(np.where(differs, here, n - 1)[::-1])[::-1]
    small = buf[turn] < np.append(buf, 255)[turn + 1]  # smaller than its successor; the last one counts as such
    small[n - 1] = True
    # to induce a suffix its successor must be there, down to one that is sorted directly
    stop = np.minimum.accumulate(np.where(small, here, n - 1)[::-1])[::-1]
    cover = np.zeros(n + 1, dtype=np.int64)
    cover[:n] += core
    np.subtract.at(cover, stop[core] + 1, 1)
    need = np.cumsum(cover[:n]) > 0
    direct = sort_direct(buf, raw, np.flatnonzero(need & small), depth)
    edges = np.searchsorted(buf[direct], np.arange(257))
    large = need & ~small
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    none = np.zeros(0, dtype=np.int64)
    out = []
    for c in range(256):
        if not pending[c] and edges[c] == edges[c + 1]:
            continue
        rising = [now := np.concatenate(pending[c]) if pending[c] else none]
        while len(now):  # runs of one byte
            now = now[large[now - 1] & (buf[now - 1] == c)] - 1
            rising.append(now)
        bucket = np.concatenate([*rising, direct[edges[c] : edges[c + 1]]])
        out.append(bucket[core[bucket]])
        before = bucket[large[bucket - 1] & (buf[bucket - 1] > c)] - 1
        first = buf[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        values, at = np.unique(first, return_index=True)
        for v, part in zip(values.tolist(), np.split(before, at[1:])):
            pending[v].append(part)
    return np.concatenate(out) if out else none


def common_prefixes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of buf[a:] and buf[b:], up to depth. buf has depth + 8 bytes after the last of either."""
    eight = np.lib.stride_tricks.sliding_window_view(buf, 8)
    out = np.full(len(a), depth, dtype=np.int64)
    alive = np.arange(len(a))
    for off in range(0, depth, 8):
        differ = eight[a[alive] + off] != eight[b[alive] + off]
        end = differ.any(axis=1)
        out[alive[end]] = np.minimum(depth, off + differ[end].argmax(axis=1))
        alive = alive[~end]
        if not len(alive):
            break
    return out


def repeated(buf: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """The positions of a suffix array whose next length bytes also start at another of them, ascending."""
    a, b = sa[:-1], sa[1:]
    equal = common_prefixes(buf, a, b, length) >= length
    return np.unique(np.concatenate([a[equal], b[equal]]))


def _windows(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    buf, at = K.pack(texts)
    first = at[:-1]
    last = np.maximum(first, at[1:] - 1 - length + 1)
    return K.grams(buf, gram), first, last, at


def find_spans(df: DataFrame, id_col: str = "doc_id", text: str = "text", lengths: tuple[int, ...] = (LENGTH,), gram: int = GRAM) -> DataFrame:
    """(_id, _h, spans: array<struct<n, s, e>>) of the documents that repeat something: for each length n, what is covered, in bytes; overlapping."""
    least, most = min(lengths), max(lengths)
    gram = min(gram, least)
    width = least - gram + 1
    base = df.select(F.col(id_col).alias("_id"), text_key(text).alias("_h"), F.col(text).alias("_t"))
    kind = base.schema["_id"].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary(batch["_t"])
            for lo, hi in blocks(map(len, texts)):
                h, first, last, _ = _windows(texts[lo:hi], least, gram)
                owner, fp = K.least_positions(h, width, first, last)
                order = np.lexsort((fp, owner))
                owner, fp = owner[order], fp[order]
                third = np.zeros(len(fp), dtype=bool)  # twice is enough to know that a text repeats it
                third[2:] = (fp[2:] == fp[:-2]) & (owner[2:] == owner[:-2])
                owner, fp = owner[~third], fp[~third]
                rows = pa.RecordBatch.from_arrays([batch["_id"].slice(lo, hi - lo), batch["_h"].slice(lo, hi - lo), lists(owner, fp, hi - lo)], ["_id", "_h", "fps"])
                yield rows.filter(pa.array(np.isin(np.arange(hi - lo), owner)))

    seen = materialize(base.filter(F.octet_length("_t") >= least).mapInArrow(gather, f"_id {kind}, _h long, fps array<long>"), "suffix-prints")
    often = materialize(seen.select(F.explode("fps").alias("fp")).groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1"), "suffix-often")
    found = join_crowded(seen.select("_id", "_h", F.explode("fps").alias("fp")), often, ["fp"], "n").groupBy("_id", "_h").agg(F.collect_set("fp").alias("fps"))
    found = found.withColumnsRenamed({"_id": "_id2", "_h": "_h2"})
    hold = base.join(found.hint("merge"), base["_id"].eqNullSafe(found["_id2"]) & (base["_h"] == found["_h2"])).select("_id", "_h", "_t", "fps")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary(batch["_t"])
            for lo, hi in blocks(map(len, texts)):
                h, first, last, at = _windows(texts[lo:hi], least, gram)
                owner, start, end, fp = K.fingerprints(h, width, first, last)
                wanted = batch["fps"].slice(lo, hi - lo)
                keep = K.member(owner, fp, np.repeat(np.arange(hi - lo), wanted.value_lengths().to_numpy()), wanted.flatten().to_numpy())
                owner, start, end, fp = owner[keep], start[keep], end[keep], fp[keep]
                p = start - at[owner]
                core = end - start
                body = [texts[lo + k][a : a + c - 1 + most] for k, a, c in zip(owner.tolist(), p.tolist(), core.tolist())]
                pick = pa.array(owner + lo)
                yield pa.RecordBatch.from_arrays([batch["_id"].take(pick), batch["_h"].take(pick), pa.array(fp), pa.array(p.astype(np.int32)), pa.array(core.astype(np.int32)), pa.array(body, pa.binary())], ["_id", "_h", "fp", "p", "core", "chunk"])

    chunks = hold.mapInArrow(cut, f"_id {kind}, _h long, fp long, p int, core int, chunk binary").withColumn("cid", F.substring(F.unhex(F.sha2("chunk", 256)), 1, 16))
    chunks = materialize(chunks, "suffix-chunks")
    discard(seen, often)
    classes = materialize(chunks.groupBy("fp", "cid").agg(F.count("*").alias("n"), F.any_value("core").alias("core"), F.any_value("chunk").alias("chunk")), "suffix-classes")
    places = materialize(chunks.select("fp", "cid", "_id", "_h", "p"), "suffix-places")
    discard(chunks)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches):
            bodies = binary(rows["chunk"])
            size = np.array([len(b) for b in bodies])
            at = 1 + np.cumsum(size) - size
            buf = np.frombuffer(b"\0" + b"".join(bodies) + bytes(most + 8), dtype=np.uint8)
            cores = rows["core"].to_numpy()
            core = np.zeros(len(buf) + 1, dtype=np.int64)
            core[at] += 1
            core[at + cores] -= 1
            sa = suffix_array(buf, np.cumsum(core[:-1]) > 0, most)
            of = np.searchsorted(at, sa, side="right") - 1
            left = at[of] + size[of] - sa  # bytes of its own chunk from here on
            alone = rows["n"].to_numpy() == 1  # all of the others goes anyway
            for n in lengths:
                hits = repeated(buf, sa[left >= n], n)
                owner = np.searchsorted(at, hits, side="right") - 1
                hits, owner = hits[alone[owner]], owner[alone[owner]]
                s = hits - at[owner]
                s, e, owner = spans_of(s, s + n, owner)
                whole = rows.select(["fp", "cid"]).take(pa.array(owner)).combine_chunks()
                for name, x in (("len", np.full(len(s), n)), ("s", s), ("e", e)):
                    whole = whole.append_column(name, pa.array(x.astype(np.int32)))
                yield from whole.to_batches()

    def cut_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = max(1, width // 4)
        for batch in batches:
            bodies, cores = binary(batch["chunk"]), batch["core"].to_numpy()
            for lo, hi in blocks(map(len, bodies)):
                h, first, _, _ = _windows(bodies[lo:hi], least, gram)
                low = K.window_argmin(h, side)
                n = cores[lo:hi]
                owner = np.repeat(np.arange(hi - lo), n)
                s = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                win = first[owner] + s
                left = low[win]
                key = K.mix(h[left] ^ K.mix(h[low[win + width - side]]))
                new = np.ones(len(key), dtype=bool)
                new[1:] = (key[1:] != key[:-1]) | (left[1:] != left[:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(new)
                e = s[np.append(at[1:], len(s)) - 1] + 1
                pick = pa.array(owner[at] + lo)
                numbers = (pa.array(x.astype(np.int32)) for x in (s[at], e, left[at] - first[owner[at]]))
                yield pa.RecordBatch.from_arrays([batch["fp"].take(pick), batch["cid"].take(pick), pa.array(key[at].view(np.int64)), *numbers], ["fp", "cid", "key", "s", "e", "a"])

    def name_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = max(1, width // 4)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("fp", "cid", "n", "len", "s", "e", "inner", "outer")}
            for row in batch.to_pylist():
                body = row["chunk"]
                for run in row["runs"]:
                    s, a = run["s"], run["a"]
                    for n in lengths:
                        e = min(run["e"], len(body) - n + 1)
                        if e > s:  # windows begin at most side - 1 before a, so all of a's hold what inner has
                            inner, outer = digest(body[a : a - side + 1 + n]), digest(b"%d %d " % (a - s, a - e) + body[s : e - 1 + n])
                            for c, x in zip(out, (row["fp"], row["cid"], row["n"], n, s, e, inner, outer)):
                                out[c].append(x)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out.values(), kinds)], list(out))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                body = row["chunk"]
                s = [(run["len"], k, run["alone"]) for run in row["runs"] for k in range(run["s"], run["e"])]
                for lo in range(0, len(s), 4096):
                    part = s[lo : lo + 4096]
                    m = len(part)
                    w = [digest(body[k : k + n]) for n, k, _ in part]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["fp"]] * m, pa.int64()), pa.array([row["cid"]] * m, pa.binary()), pa.array([x for _, _, x in part], pa.bool_()),
                            pa.array([n for n, _, _ in part], pa.int32()), pa.array([k for _, k, _ in part], pa.int32()), pa.array(w, pa.binary()),
                        ],
                        ["fp", "cid", "alone", "len", "s", "w"],
                    )

    few, crowded = by_crowding(classes, "n = 1")
    apart = few.mapInArrow(compare, "fp long, cid binary, len int, s int, e int")
    # of crowded fingerprints: runs of windows alike at both sides, by digest; then the windows of runs that others may share in part
    runs = materialize(crowded.select("fp", "cid", "core", "chunk").mapInArrow(cut_again, "fp long, cid binary, key long, s int, e int, a int"), "suffix-runs")
    alike = materialize(runs.groupBy("fp", "key").agg(F.count("*").alias("m")).filter("m > 1"), "suffix-alike")
    twice = join_crowded(runs, alike, ["fp", "key"], "m")
    asked = twice.groupBy("fp", "cid").agg(F.collect_list(F.struct("s", "e", "a")).alias("runs"))
    named = crowded.select("fp", "cid", "n", "chunk").join(asked, ["fp", "cid"]).mapInArrow(name_runs, "fp long, cid binary, n long, len int, s int, e int, inner binary, outer binary")
    named = materialize(named, "suffix-named")
    texts = named.groupBy("fp", "len", "inner", "outer").agg(F.count("*").alias("m"), F.any_value(F.struct("cid", "s", "e", "n")).alias("one"))
    texts = materialize(texts, "suffix-texts")
    equal = join_crowded(named.filter("n = 1"), texts.filter("m > 1").select("fp", "len", "inner", "outer", "m"), ["fp", "len", "inner", "outer"], "m")
    equal = equal.select("fp", "cid", "len", "s", (F.col("e") - 1 + F.col("len")).alias("e"))
    several = materialize(texts.groupBy("fp", "len", "inner").agg(F.count("*").alias("k")).filter("k > 1"), "suffix-several")
    parts = join_crowded(texts, several, ["fp", "len", "inner"], "k").select("fp", "one.cid", F.struct("len", "one.s", "one.e", F.expr("m = 1 and one.n = 1").alias("alone")).alias("run"))
    asked = parts.groupBy("fp", "cid").agg(F.collect_list("run").alias("runs"))
    windows = crowded.select("fp", "cid", "chunk").join(asked, ["fp", "cid"]).mapInArrow(name, "fp long, cid binary, alone boolean, len int, s int, w binary")
    windows = materialize(windows, "suffix-windows")
    again = materialize(windows.groupBy("fp", "len", "w").agg(F.count("*").alias("m")).filter("m > 1"), "suffix-again")
    hits = join_crowded(windows.filter("alone"), again, ["fp", "len", "w"], "m").select("fp", "cid", "len", "s", (F.col("s") + F.col("len")).alias("e"))
    # a chunk of several places goes whole, as far as its windows of each length reach
    reach = F.least(F.octet_length("chunk"), F.col("core") - 1 + F.col("len")).cast("int")
    all_of = classes.filter("n > 1").select("*", F.explode(F.array(*(F.lit(n) for n in lengths))).alias("len")).filter(F.octet_length("chunk") >= F.col("len")).select("fp", "cid", "len", F.lit(0).alias("s"), reach.alias("e"))
    spans = apart.unionByName(equal).unionByName(hits).unionByName(all_of).groupBy("fp", "cid").agg(F.collect_list(F.struct("len", "s", "e")).alias("of"))
    spans = materialize(classes.select("fp", "cid", "n").join(spans, ["fp", "cid"]), "suffix-marked")
    out = materialize(document_spans(places, spans), "suffix-spans")
    discard(classes, places, runs, alike, named, texts, several, windows, again, spans)
    return out


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, kept: str = "kept", removed: str = "removed", passage: int | None = None, passages: str = "passages") -> DataFrame:
    """df with the remaining bytes of each text and the removed runs (array<struct<s, e>>, disjoint, in order).

    passage: another length, whose repeated runs are reported too, without removing them.
    """
    lengths = (length,) if passage is None else (length, passage)
    spans = find_spans(df, id_col, text, lengths)
    key, h, at = fresh(df, "__id", "__h", "__spans")
    spans = spans.select(F.col("_id").alias(key), F.col("_h").alias(h), F.col("spans").alias(at))
    joined = df.join(spans.hint("merge"), df[id_col].eqNullSafe(spans[key]) & (text_key(df[text]) == spans[h]), "left").drop(key, h)
    kind = "array<struct<s:int,e:int>>"

    @F.pandas_udf(kind)
    def tidy(column):
        import pandas as pd

        def one(xs):
            if xs is None or not len(xs):
                return []
            s, e = K.union(np.array([x["s"] for x in xs]), np.array([x["e"] for x in xs]))
            return [{"s": int(a), "e": int(b)} for a, b in zip(s, e)]

        return pd.Series([one(xs) for xs in column], dtype=object)

    def of(n: int):
        mine = F.transform(F.filter(at, lambda x: x["len"] == n), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
        return F.when(F.col(at).isNull(), F.array().cast(kind)).otherwise(tidy(mine))

    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    out = joined.withColumns({name: of(n) for name, n in zip((removed, passages), lengths)}).drop(at)
    # what stands before, between and after the removed runs
    n = F.size(removed)
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(removed, i - 1)["e"])
    end = lambda i: F.when(i == n, F.octet_length(body)).otherwise(F.get(removed, i)["s"])
    parts = F.transform(F.sequence(F.lit(0), n), lambda i: F.hex(F.substr(body, start(i) + 1, end(i) - start(i))))
    return out.withColumn(kept, F.when(n == 0, body).otherwise(F.unhex(F.array_join(parts, ""))))


def strip_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """df with its texts less the repeated bytes; a character that loses some of its bytes goes whole."""
    kept, removed = fresh(df, "__kept", "__removed")
    out = drop_repeats(df, id_col, text, length, kept, removed)
    cut = F.replace(F.make_valid_utf8(F.col(kept).cast("string")), F.lit("\ufffd"), F.lit(""))
    return out.withColumn(text, F.when(F.size(removed) > 0, cut).otherwise(F.col(text))).select(*df.columns)
