"""Keyed tables that are changed without being rewritten: rows lie in buckets by a hash of their key.

A table is a folder of Parquet parts, one folder a batch, in it one for each bucket the batch touched, and of numbered states. A
state says which parts hold each bucket. A merge reads and writes the buckets of its keys only; all other files stay as
they are and are shared by the states. A state appears whole or not at all (it is written aside and renamed, and never over
another: of two writers of one number the second fails), so a reader sees one state, and a batch that fails leaves nothing
that anyone reads. A state is as large as the number of buckets.

What changes little writes little. Where a merge only adds keys to a bucket, they become a further part of it (a small bucket, or
one of MOST parts, is written whole). update_later() writes no rows: the state holds the condition and values as SQL text, and
parts written before are read through them, until MOST wait for a bucket.

Buckets may go by some of the key's columns, so that rows with these in common lie together; a bucket that becomes large is
written by several tasks, as several files. changes() compares two states in what differs: rows of parts that both have are
not matched by key. refresh() keeps a view up to date with it: it reads the buckets of the groups that changed, and no others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .steps import forget, step
from .store import upsert

BUCKETS = 64
BUCKET = "__bucket"
#: Bytes up to which a bucket is written whole when it gains rows; how many parts a bucket has, and updates wait for it, at most.
SMALL, MOST = 1 << 20, 8
#: Rows of a batch up to which the hashes of its keys are broadcast, so that the table is not shuffled to find them (16 MB of hashes).
FEW = 1 << 21


@dataclass
class State:
    number: int
    keys: list[str]
    by: list[str]
    buckets: int
    schema: StructType
    parts: dict[int, list[tuple[str, int]]] = field(default_factory=dict)  # of each bucket that has rows: its parts, no key in two, and the first update to read each through
    later: dict[int, tuple[str, dict[str, str]]] = field(default_factory=dict)  # updates by number, conditions and values
    updates: int = 0  # the number of the next


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the table's states, ascending."""
    fs, folder = _files(spark, path), _path(spark, path, "states")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def exists(spark: SparkSession, path: str) -> bool:
    return bool(numbers(spark, path))


def state(spark: SparkSession, path: str, number: int | None = None) -> State:
    """The given state, or the last."""
    known = numbers(spark, path)
    if not known or number is not None and number not in known:
        raise ValueError(f"{path} has no state {'' if number is None else number}")
    number = known[-1] if number is None else number
    held = json.loads(spark.read.text(f"{path}/states/{number:012}.json", wholetext=True).first()[0])
    parts = {int(k): [(v, 0)] if isinstance(v, str) else [(p, n) for p, n in v] for k, v in held["parts"].items()}
    later = {int(k): (where, values) for k, (where, values) in held.get("later", {}).items()}
    return State(number, held["keys"], held["by"], held["buckets"], StructType.fromJson(held["schema"]), parts, later, held.get("updates", 0))


def _commit(spark: SparkSession, path: str, new: State) -> State:
    fs, aside, target = _files(spark, path), _path(spark, path, "states", f"{uuid.uuid4().hex}.new"), _path(spark, path, "states", f"{new.number:012}.json")
    text = json.dumps({"keys": new.keys, "by": new.by, "buckets": new.buckets, "schema": json.loads(new.schema.json()), "parts": new.parts, "later": new.later, "updates": new.updates})
    out = fs.create(aside, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise RuntimeError(f"state {new.number} of {path} was written by another")
    return new


def _bucket(s: State) -> Column:
    return F.pmod(F.xxhash64(*(F.col(k) for k in s.by)), F.lit(s.buckets)).cast("int")


def _buckets(rows: DataFrame, s: State) -> list[int]:
    """The buckets of rows; at most as many as the table has."""
    return sorted(r[0] for r in rows.select(_bucket(s)).distinct().collect())


def _set(rows: DataFrame, schema: StructType, where: Column, values: dict[str, Column]) -> DataFrame:
    """Columns set to values where the condition holds; all see the row as it was."""
    hit = F.coalesce(where, F.lit(False))
    return rows.withColumns({f.name: F.when(hit, values[f.name].cast(f.dataType)).otherwise(F.col(f"`{f.name}`")) for f in schema if f.name in values})


def _updated(rows: DataFrame, s: State, first: int, end: int) -> DataFrame:
    """Rows through the updates first to end - 1."""
    for n in range(first, end):
        where, values = s.later[n]
        rows = _set(rows, s.schema, F.expr(where), {c: F.expr(v) for c, v in values.items()})
    return rows


def _by_age(path: str, parts: dict[int, list[tuple[str, int]]]) -> list[tuple[int, list[str]]]:
    """Folders of parts by the first update to read them through; at most MOST and one different ones."""
    ages: dict[int, list[str]] = {}
    for b, own in parts.items():
        for part, first in own:
            ages.setdefault(first, []).append(f"{path}/{part}/{BUCKET}={b}")
    return sorted(ages.items())


def _read(spark: SparkSession, path: str, s: State, buckets: list[int] | None = None) -> DataFrame:
    held = _by_age(path, {b: s.parts[b] for b in (s.parts if buckets is None else buckets) if b in s.parts})
    scans = [_updated(spark.read.schema(s.schema).parquet(*folders), s, first, s.updates) for first, folders in held]
    return reduce(DataFrame.union, scans) if scans else spark.createDataFrame([], s.schema)


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    return _read(spark, path, state(spark, path, number))


def lookup(spark: SparkSession, path: str, of: DataFrame) -> DataFrame:
    """The buckets that may hold rows with these values of the columns that buckets go by."""
    s = state(spark, path)
    return _read(spark, path, s, _buckets(of, s))


def _write(rows: DataFrame, path: str, s: State) -> dict[int, str]:
    """Writes rows as a part and returns it for each bucket that has any."""
    spark, part = rows.sparkSession, f"parts/{uuid.uuid4().hex}"
    placed = rows.withColumn(BUCKET, _bucket(s)).hint("rebalance", F.col(BUCKET)).sortWithinPartitions(BUCKET, *s.keys)
    placed.write.partitionBy(BUCKET).parquet(f"{path}/{part}")
    return _named(spark, path, part)


def _named(spark: SparkSession, path: str, part: str) -> dict[int, str]:
    names = [f.getPath().getName() for f in _files(spark, path).listStatus(_path(spark, path, part))]
    return {int(n.partition("=")[2]): part for n in names if n.startswith(f"{BUCKET}=")}


def _rewrite(rows: DataFrame, path: str, s: State) -> dict[int, str]:
    """As _write, for rows that were read from the buckets that they stay in: they are not moved, each task sorts what it read."""
    spark, part = rows.sparkSession, f"parts/{uuid.uuid4().hex}"
    rows.withColumn(BUCKET, _bucket(s)).sortWithinPartitions(BUCKET, *s.keys).write.partitionBy(BUCKET).parquet(f"{path}/{part}")
    return _named(spark, path, part)


def create(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS, by: list[str] | None = None) -> State:
    """A new table of rows, one a key. by: some of the keys, by which buckets go."""
    s = State(0, keys, by or keys, buckets, rows.schema)
    return _commit(rows.sparkSession, path, replace(s, parts={b: [(p, 0)] for b, p in _write(rows, path, s).items()}))


def _equal(a: str, b: str, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns), F.lit(True))


def _next(spark: SparkSession, path: str, s: State, parts: dict[int, list[tuple[str, int]]]) -> State:
    """The state after s, with these parts and the updates that some of them need."""
    oldest = min((first for own in parts.values() for _, first in own), default=s.updates)
    return _commit(spark, path, replace(s, number=s.number + 1, parts=parts, later={n: u for n, u in s.later.items() if n >= oldest}))


def _replaced(path: str, s: State, touched: list[int], rows: DataFrame, write: Callable[[DataFrame, str, State], dict[int, str]] = _write) -> dict[int, list[tuple[str, int]]]:
    """The parts when rows are all there is in the touched buckets."""
    return {b: p for b, p in s.parts.items() if b not in set(touched)} | {b: [(p, s.updates)] for b, p in write(rows, path, s).items()}


def _small(spark: SparkSession, path: str, s: State, bucket: int) -> bool:
    """Whether a bucket is to be written whole when it gains rows."""
    fs, own = _files(spark, path), s.parts.get(bucket, [])
    return len(own) >= MOST or sum(fs.getContentSummary(_path(spark, path, part, f"{BUCKET}={bucket}")).getLength() for part, _ in own) <= SMALL


def _alike(rows: DataFrame, of: DataFrame, s: State) -> DataFrame:
    """Rows that may have a key of the given ones; all, if those are many."""
    if of.count() > FEW:
        return rows
    key = F.xxhash64(*(F.col(k) for k in s.keys)).alias("__key")
    return rows.join(F.broadcast(of.select(key)), key == F.col("__key"), "left_semi")


def merge(source: DataFrame, path: str, keep: tuple[str, ...] = ()) -> State:
    """Rows of source (one a key, columns of the table) replace those of their keys or are added; columns in keep stay as they were.

    Only buckets in which a row is new or differs are written, those that only gain rows without what they hold; if none is, there is no new state.
    """
    spark = source.sparkSession
    s = state(spark, path)
    new = step(source.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in s.schema if f.name in source.columns)), "merge")
    old = _alike(_read(spark, path, s, _buckets(new, s)), new, s).withColumn("__held", F.lit(True))
    both = new.alias("n").join(old.alias("o"), _equal("n", "o", s.keys), "left")
    differ = both.filter(F.col("o.__held").isNull() | ~_equal("n", "o", [c for c in new.columns if c not in keep and c not in s.keys]))
    differ = step(differ.select("n.*", F.col("o.__held").isNotNull().alias("__held")), "differ")
    touched = {r[0]: r[1] for r in differ.groupBy(_bucket(s)).agg(F.max("__held")).collect()}
    if touched:
        whole = [b for b, held in touched.items() if held or _small(spark, path, s, b)]
        parts = _replaced(path, s, whole, upsert(_read(spark, path, s, whole), new.filter(_bucket(s).isin(whole)), s.keys, keep)) if whole else dict(s.parts)
        if len(whole) < len(touched):
            more = differ.filter(~_bucket(s).isin(whole)).select(*(F.col(f"`{f.name}`") if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in s.schema))
            for b, part in _write(more, path, s).items():
                parts[b] = [*s.parts[b], (part, s.updates)]
        s = _next(spark, path, s, parts)
    forget(new, differ)
    return s


def update(spark: SparkSession, path: str, where: Column, values: dict[str, Column]) -> State:
    """Columns set to values in the rows where the condition holds; only their buckets are written."""
    s = state(spark, path)
    touched = _buckets(_read(spark, path, s).filter(F.coalesce(where, F.lit(False))), s)
    if not touched:
        return s
    # where no value goes into the bucket, rows stay in theirs
    return _next(spark, path, s, _replaced(path, s, touched, _set(_read(spark, path, s, touched), s.schema, where, values), _write if set(values) & set(s.by) else _rewrite))


def update_later(spark: SparkSession, path: str, where: str, values: dict[str, str]) -> State:
    """As update, but no rows are written: parts are read through the condition and values from here on.

    Both are SQL texts about the row alone, each read to give the same: no clock, no chance, nothing that hangs on a session's settings. Keys
    can't be set. Buckets for which MOST updates wait are written, this one among them; if no row is hit, there is no new state.
    """
    s = state(spark, path)
    if set(values) & set(s.keys):
        raise ValueError(f"keys of {path} can't be set later: {sorted(set(values) & set(s.keys))}")
    hit, columns = F.coalesce(F.expr(where), F.lit(False)), {c: F.expr(v) for c, v in values.items()}
    rows = _read(spark, path, s)
    if not _set(rows, s.schema, F.expr(where), columns)._jdf.queryExecution().analyzed().deterministic():
        raise ValueError(f"{where} or {values} gives other rows at each read")
    if rows.filter(hit).isEmpty():
        return s
    due = [b for b, own in s.parts.items() if s.updates - min(first for _, first in own) >= MOST]
    after = replace(s, later=s.later | {s.updates: (where, values)}, updates=s.updates + 1)
    return _next(spark, path, after, _replaced(path, after, due, _read(spark, path, after, due), _rewrite) if due else s.parts)


def remove(gone: DataFrame, path: str) -> State:
    """Rows whose keys are in gone go; keys without a row change nothing."""
    spark = gone.sparkSession
    s = state(spark, path)
    these = step(gone.select(*s.keys).distinct(), "gone")
    alike = lambda rows, how: rows.alias("h").join(these.alias("g"), _equal("h", "g", s.keys), how)
    touched = _buckets(alike(_read(spark, path, s, _buckets(these, s)), "left_semi"), s)
    if touched:
        s = _next(spark, path, s, _replaced(path, s, touched, alike(_read(spark, path, s, touched), "left_anti")))
    forget(these)
    return s


def expire(spark: SparkSession, path: str, today: str) -> State:
    """Active rows that ended before today become inactive."""
    return update_later(spark, path, f"is_active AND valid_to < DATE '{today}'", {"is_active": "false"})


def changes(spark: SparkSession, path: str, since: int, until: int | None = None) -> DataFrame:
    """(before, after), structs of the rows that differ between two states, null where there is none. Reads what differs.

    Buckets written between the two are compared by key. Of others, parts that one state lacks are its new (or gone) rows, and those
    of both states are read once, through the updates of one and then of the other.
    """
    a, b = state(spark, path, since), state(spark, path, until)
    known = sorted({*a.parts, *b.parts})
    own = {k: (a.parts.get(k, []), b.parts.get(k, [])) for k in known}
    grown = [k for k, (p, q) in own.items() if p[: len(q)] == q[: len(p)]]
    whole = sorted(set(known) - set(grown))
    row = lambda s: F.struct(*(F.col(f"`{c}`") for c in s.schema.names))
    before, after = (_read(spark, path, s, whole).select(row(s).alias(name)) for s, name in ((a, "before"), (b, "after")))
    both = before.join(after, _equal("before", "after", a.keys), "full_outer")
    out = both.filter(F.col("before").isNull() | F.col("after").isNull() | ~_equal("before", "after", a.schema.names))
    for s, name, k in ((a, "before", 0), (b, "after", 1)):
        extra = replace(s, parts={b: more for b in grown if (more := own[b][k][len(own[b][1 - k]) :])})
        if extra.parts:
            out = out.unionByName(_read(spark, path, extra).select(row(s).alias(name)), allowMissingColumns=True)
    low, high = sorted((a, b), key=lambda s: s.updates)
    values = sorted({c for n in range(low.updates, high.updates) for c in high.later.get(n, ("", {}))[1]})
    for first, folders in _by_age(path, {k: own[k][0][: len(own[k][1])] for k in grown}) if low.updates < high.updates else []:
        was = _updated(spark.read.schema(a.schema).parquet(*folders), high, first, low.updates).withColumn("__was", row(a))
        pair = _updated(was, high, low.updates, high.updates).select(F.col("__was").alias("before" if low is a else "after"), row(a).alias("after" if low is a else "before"))
        out = out.unionByName(pair.filter(~_equal("before", "after", values)))
    return out


@dataclass
class Refreshed:
    number: int  # state of the table that the view shows now
    groups: DataFrame  # those computed again
    read: list[int]  # buckets of the table that were read for them


def refresh(spark: SparkSession, view: str, table: str, groups: list[str], compute: Callable[[DataFrame], DataFrame], since: int | None = None) -> Refreshed:
    """Keeps a view of table, one row a group, up to date: only groups that a change since that state touches are computed again.

    compute: rows of whole groups -> the view's rows, groups among the columns; it may give a group none. Without since, the view is
    made anew. Where the table's buckets go by columns of the group, only the buckets of the touched groups are read.
    """
    now = state(spark, table)
    if since is None:
        create(compute(_read(spark, table, now)), view, groups)
        return Refreshed(now.number, read(spark, view).select(*groups), sorted(now.parts))
    diff = changes(spark, table, since, now.number)
    sides = [diff.filter(F.col(side).isNotNull()).select(*(F.col(f"{side}.{g}").alias(g) for g in groups)) for side in ("before", "after")]
    touched = step(sides[0].unionByName(sides[1]).distinct(), "touched")
    at = _buckets(touched, now) if set(now.by) <= set(groups) else sorted(now.parts)
    own = _read(spark, table, now, at).alias("r").join(touched.alias("t"), _equal("r", "t", groups), "left_semi")
    fresh = step(compute(own), "fresh")
    merge(fresh, view)
    remove(touched.alias("t").join(fresh.alias("f"), _equal("t", "f", groups), "left_anti"), view)
    forget(fresh)
    return Refreshed(now.number, touched, at)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes all but the last keep states, and what none of these reads; returns how many buckets of old parts went."""
    known, fs = numbers(spark, path), _files(spark, path)
    used = {f"{p}/{BUCKET}={b}" for n in known[-keep:] for b, own in state(spark, path, n).parts.items() for p, _ in own}
    for n in known[:-keep]:
        fs.delete(_path(spark, path, "states", f"{n:012}.json"), False)
    listed = lambda *at: [f.getPath().getName() for f in fs.listStatus(_path(spark, path, *at))]
    gone = 0
    for part in listed("parts"):
        held = [f"parts/{part}/{b}" for b in listed("parts", part) if b.startswith(BUCKET)]
        dead = [b for b in held if b not in used]
        gone += len(dead)
        for b in dead if len(dead) < len(held) else [f"parts/{part}"]:
            fs.delete(_path(spark, path, b), True)
    return gone
