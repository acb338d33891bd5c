"""Bucketed tables under changes of a few rows: what is written, and that states, differences and views are those of a plain table."""

import os
import random

import pytest
from pyspark.sql import functions as F

from larder.operators import keyed
from larder.plans import tables

ROW = "g long, k long, v long, on boolean"


def files(path):
    return {os.path.join(folder, n) for folder, _, names in os.walk(os.path.join(path, "parts")) for n in names if n.endswith(".parquet")}


def made(spark, rows):
    return spark.createDataFrame(sorted(rows, key=repr), ROW).coalesce(1)


def test_new_rows_leave_what_their_buckets_hold(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "SMALL", 0, raising=False)
    path, held, more = str(tmp_path / "t"), {(g, 0, 1, True) for g in range(300)}, {(g, 1, 2, None) for g in range(40)}
    keyed.create(made(spark, held), path, ["g", "k"], 4, by=["g"])
    before = files(path)
    s = keyed.merge(made(spark, more | {(5, 0, 1, True)}), path)  # one is there and the same
    written = spark.read.parquet(*(files(path) - before))
    assert before < files(path) and written.count() == 40 and set(map(len, s.parts.values())) == {2}
    assert set(map(tuple, keyed.read(spark, path).collect())) == held | more and keyed.merge(made(spark, more), path).number == s.number
    assert [r.before for r in keyed.changes(spark, path, 0).collect()] == [None] * 40 and [r.after for r in keyed.changes(spark, path, 1, 0).collect()] == [None] * 40
    keyed.merge(made(spark, {(5, 1, 9, None)}), path)  # one of the added differs
    assert set(map(tuple, keyed.read(spark, path).collect())) == (held | more) - {(5, 1, 2, None)} | {(5, 1, 9, None)}
    assert [(r.before.v, r.after.v) for r in keyed.changes(spark, path, 1).collect()] == [(2, 9)]


def test_an_added_row_lacks_columns_that_its_batch_lacks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "SMALL", 0, raising=False)
    path = str(tmp_path / "t")
    keyed.create(made(spark, {(1, 1, 1, True)}), path, ["g", "k"], 1, by=["g"])
    keyed.merge(spark.createDataFrame([(True, 2, 1), (None, 3, 1)], "on boolean, k int, g int"), path, keep=("on",))
    assert set(map(tuple, keyed.read(spark, path).collect())) == {(1, 1, 1, True), (1, 2, None, True), (1, 3, None, None)}


def test_a_later_update_writes_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.create(made(spark, {(g, 0, g, g % 2 == 0) for g in range(100)} | {(None, None, None, None)}), path, ["g", "k"], 4, by=["g"])
    before = files(path)
    s = keyed.update_later(spark, path, "on AND v < 50", {"on": "false", "v": "v + g"})
    assert s.number == 1 and files(path) == before
    want = {(g, 0, 2 * g, False) if g % 2 == 0 and g < 50 else (g, 0, g, g % 2 == 0) for g in range(100)} | {(None, None, None, None)}
    assert set(map(tuple, keyed.read(spark, path).collect())) == want and keyed.changes(spark, path, 0).count() == 25
    assert keyed.update_later(spark, path, "on AND v < 50", {"on": "false"}).number == 1  # a replay hits no row
    with pytest.raises(ValueError, match="other rows at each read"):
        keyed.update_later(spark, path, "rand() < 0.5", {"v": "1"})
    with pytest.raises(ValueError, match="can't be set later"):
        keyed.update_later(spark, path, "on", {"k": "1"})


@pytest.mark.parametrize("seed", range(3))
def test_random_changes(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(keyed, "MOST", 2)
    monkeypatch.setattr(keyed, "SMALL", 0 if seed else 900)  # bytes: some buckets are small
    monkeypatch.setattr(keyed, "FEW", 0 if seed == 2 else 1000)
    rng, path, view = random.Random(seed), str(tmp_path / "t"), str(tmp_path / "v")
    key = lambda: (rng.choice([None, *range(12)]), rng.randrange(6))
    row = lambda k: (*k, rng.randrange(5), rng.choice([True, False, None]))
    now = {k: row(k) for k in (key() for _ in range(30))}
    states = [dict(now)]
    keyed.create(made(spark, now.values()), path, ["g", "k"], 3, by=["g"])
    total = lambda own: own.filter("on").groupBy("g").agg(F.sum("v").alias("v"))
    done = keyed.refresh(spark, view, path, ["g"], total).number
    for _ in range(6):
        kind = rng.choice(["new", "merge", "later", "later", "update", "remove"])
        n = rng.randrange(4)
        if kind in ("new", "merge"):
            batch = {k: row(k) for k in (key() for _ in range(5)) if kind == "merge" or k not in now}
            number = keyed.merge(made(spark, batch.values()), path).number
            now |= batch
        elif kind == "remove":
            gone = {key() for _ in range(3)}
            number = keyed.remove(spark.createDataFrame(sorted(gone, key=repr), "g long, k long"), path).number
            now = {k: r for k, r in now.items() if k not in gone}
        else:
            if kind == "later":
                number = keyed.update_later(spark, path, f"on AND v > {n}", {"v": "v - 1", "on": "v <> 2"}).number
            else:
                number = keyed.update(spark, path, F.col("on") & (F.col("v") > n), {"v": F.col("v") - 1, "on": F.col("v") != 2}).number
            now = {k: (*k, v - 1, v != 2) if on and v > n else (*k, v, on) for k, (_, _, v, on) in now.items()}
        assert (number == len(states) - 1) == (now == states[-1])
        if now != states[-1]:
            states.append(dict(now))
        assert sorted(map(repr, map(tuple, keyed.read(spark, path).collect()))) == sorted(map(repr, now.values()))
        done = keyed.refresh(spark, view, path, ["g"], total, done).number
        assert sorted(map(repr, keyed.read(spark, view).collect())) == sorted(map(repr, total(made(spark, now.values())).collect()))
    tuples = lambda r: tuple(x and tuple(x) for x in r)
    for a, b in {(rng.randrange(len(states)), rng.randrange(len(states))) for _ in range(4)} | {(0, len(states) - 1), (len(states) - 1, 0)}:
        want = [(states[a].get(k), states[b].get(k)) for k in {*states[a], *states[b]} if states[a].get(k) != states[b].get(k)]
        assert sorted(map(repr, map(tuples, keyed.changes(spark, path, a, b).collect()))) == sorted(map(repr, want))
    keyed.vacuum(spark, path, 1)
    assert sorted(map(repr, map(tuple, keyed.read(spark, path).collect()))) == sorted(map(repr, now.values()))


def test_the_weekly_view_writes_each_deal_once(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "SMALL", 0, raising=False)
    monkeypatch.setattr(tables, "folder", lambda s, name: str(tmp_path / name))
    tables.u13_incremental_view(spark, sf_dir)
    table = str(tmp_path / "u13-deals")
    assert spark.read.parquet(*files(table)).count() == keyed.read(spark, table).count() > 5000
