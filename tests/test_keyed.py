"""Bucketed tables: which files a change touches, replays, odd keys, views kept up to date."""

import os
import random

import pytest
from pyspark.sql import functions as F

from larder.operators import keyed, suggest

ROW = "deal_id string, concept_id long, region string, sale_price double, is_active boolean, valid_to date"


def files(path):
    out = {}
    for folder, _, names in os.walk(os.path.join(path, "parts")):
        out |= {os.path.join(folder, n): os.stat(os.path.join(folder, n)).st_mtime_ns for n in names if n.endswith(".parquet")}
    return out


def table(spark, n=400):
    rng = random.Random(1)
    return spark.createDataFrame([(f"d{k}", rng.randrange(40) if k % 20 else None, rng.choice(["CH", "ZH", None]), float(rng.randint(1, 50)), k % 7 > 0, None) for k in range(n)], ROW)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_a_batch_touches_its_buckets_only(spark, tmp_path):
    path, df = str(tmp_path / "t"), table(spark)
    first = keyed.create(df, path, ["deal_id"], 16)
    before, old = files(path), keyed.read(spark, path)
    assert len(first.parts) == 16 and rows(old) == rows(df)
    change = spark.createDataFrame([("d5", 1, "CH", 0.5, True, None)], ROW)
    second = keyed.merge(change, path)
    after = files(path)
    assert {f: t for f, t in after.items() if f in before} == before and len(set(after) - set(before)) == 1  # one bucket, one file
    assert sum(first.parts[b] != second.parts[b] for b in first.parts) == 1
    assert rows(keyed.read(spark, path)) == rows(df.filter("deal_id <> 'd5'").unionByName(change))
    assert rows(old) == rows(df)  # the state before stays readable
    assert keyed.merge(change, path).number == second.number and files(path) == after  # a replay changes nothing
    assert keyed.merge(df.limit(0), path).number == second.number
    diff = keyed.changes(spark, path, 0)
    assert [(r.before.sale_price, r.after.sale_price) for r in diff.collect()] == [(df.filter("deal_id = 'd5'").first().sale_price, 0.5)]
    added = keyed.merge(spark.createDataFrame([("new", None, None, 1.0, True, None)], ROW), path)
    assert [r.before for r in keyed.changes(spark, path, 1, added.number).collect()] == [None]
    assert keyed.vacuum(spark, path, 1) == 2 and rows(keyed.read(spark, path, added.number)) == rows(keyed.read(spark, path))
    with pytest.raises(ValueError, match="no state"):
        keyed.read(spark, path, 0)


def test_odd_keys_and_kept_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    kind = "a string, b long, v string, made string"
    keyed.create(spark.createDataFrame([(None, 1, "x", "m"), ("", None, "y", "m"), (None, None, None, None)], kind), path, ["a", "b"], 4)
    s = keyed.merge(spark.createDataFrame([(None, 1, "X", "n"), (None, None, "z", "n"), ("new", 3, None, None)], kind), path, keep=("made",))
    want = {(None, 1, "X", "m"), ("", None, "y", "m"), (None, None, "z", None), ("new", 3, None, None)}
    assert set(map(tuple, keyed.read(spark, path).collect())) == want
    assert keyed.merge(spark.createDataFrame([(None, 1, "X", "other")], kind), path, keep=("made",)).number == s.number
    keyed.remove(spark.createDataFrame([(None, None), ("none", 9)], "a string, b long"), path)
    assert set(map(tuple, keyed.read(spark, path).collect())) == want - {(None, None, "z", None)}
    assert keyed.remove(spark.createDataFrame([("none", 9)], "a string, b long"), path).number == s.number + 1
    empty = str(tmp_path / "e")
    keyed.create(spark.createDataFrame([], kind), empty, ["a"])
    assert keyed.read(spark, empty).collect() == [] and keyed.read(spark, empty).columns == ["a", "b", "v", "made"]
    keyed.merge(spark.createDataFrame([("q", 1, "v", "w")], kind), empty)
    assert keyed.read(spark, empty).count() == 1 and not keyed.exists(spark, str(tmp_path / "nowhere"))


def test_of_two_writers_the_second_fails(spark, tmp_path, monkeypatch):
    path, df = str(tmp_path / "t"), table(spark, 20)
    first = keyed.create(df, path, ["deal_id"], 4)
    keyed.update(spark, path, F.col("deal_id") == "d1", {"sale_price": F.lit(9)})
    monkeypatch.setattr(keyed, "state", lambda *a: first)  # it began before the other ended
    with pytest.raises(RuntimeError, match="by another"):
        keyed.update(spark, path, F.col("deal_id") == "d2", {"sale_price": F.lit(8)})
    monkeypatch.undo()
    assert {r.deal_id: r.sale_price for r in keyed.read(spark, path).collect()}["d1"] == 9.0


def test_view_follows_the_table(spark, tmp_path):
    path, view = str(tmp_path / "t"), str(tmp_path / "v")
    keyed.create(table(spark).withColumn("valid_to", F.when(F.col("deal_id").isin("d8", "d9"), F.lit("2026-01-01").cast("date"))), path, ["concept_id", "deal_id"], 32, by=["concept_id"])

    def cheapest(deals):
        return suggest.cheapest_now(deals.withColumn("valid_to", F.lit("2099-01-01").cast("date")), "2026-02-01").select("concept_id", "region", "deal_id", "sale_price")

    done = keyed.refresh(spark, view, path, ["concept_id", "region"], cheapest).number
    sets = [
        lambda: keyed.merge(spark.createDataFrame([("in", 3, "CH", 0.1, True, None), ("out", None, None, 0.2, True, None), ("far", 99, "CH", 5.0, True, None)], ROW), path),  # inserts
        lambda: keyed.update(spark, path, F.col("deal_id").isin("in", "d4"), {"sale_price": F.lit(70)}),  # the price of the cheapest rises
        lambda: keyed.expire(spark, path, "2026-02-01"),
        lambda: keyed.update(spark, path, F.col("concept_id") == 99, {"is_active": F.lit(False)}),  # a group without a row
        lambda: keyed.remove(keyed.read(spark, path).filter("concept_id = 7"), path),
    ]
    for change in sets:
        change()
        files_before = files(view)
        out = keyed.refresh(spark, view, path, ["concept_id", "region"], cheapest, since=done)
        done = out.number
        assert rows(keyed.read(spark, view)) == rows(cheapest(keyed.read(spark, path)))
        assert 0 < out.groups.count() < 12 and len(out.read) < 32 and files_before.items() <= files(view).items()
    same = keyed.refresh(spark, view, path, ["concept_id", "region"], cheapest, since=done)
    assert same.groups.count() == 0 and same.read == []
