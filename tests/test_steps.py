"""Rows that are read more than once are written first."""

from pyspark.sql import functions as F

from larder.operators import keyed, ranks
from larder.plans import tables


def named(monkeypatch, module):
    names, real = [], module.step
    monkeypatch.setattr(module, "step", lambda df, name: (names.append(name), real(df, name))[1])
    return names


def test_ranked_writes_its_rows_before_it_splits_them(spark, monkeypatch):
    names = named(monkeypatch, ranks)
    once = ranks.ranked(spark.range(9).withColumn("g", F.col("id") % 2), F.desc("id"), out="a", within="g")
    twice = ranks.ranked(once, F.asc("id"), out="b")
    assert [(r.id, r.a, r.b) for r in twice.orderBy("id").collect()] == [(k, 5 - k // 2 - k % 2, k + 1) for k in range(9)]
    assert names == ["to-rank", "ranked", "ranked"]


def test_a_search_makes_its_deals_and_products_once(spark, sf_dir, monkeypatch):
    names = named(monkeypatch, tables)
    assert tables.j21_indexed_search(spark, sf_dir).count() > 0
    assert names == ["j21-deals", "j21-products"]


def test_an_update_in_place_moves_no_rows(spark, tmp_path, monkeypatch):
    path, write, written = str(tmp_path / "t"), keyed._write, []
    keyed.create(spark.range(500).select("id", (F.col("id") % 5).alias("g"), F.lit(1).alias("n")), path, ["id"], 8)
    monkeypatch.setattr(keyed, "_write", lambda *a: (written.append(1), write(*a))[1])
    keyed.update(spark, path, F.col("g") == 3, {"n": F.lit(2)})
    assert not written and keyed.lookup(spark, path, spark.range(7, 9)).filter("id in (7, 8)").count() == 2
    assert {(r.g, r.n): r["count"] for r in keyed.read(spark, path).groupBy("g", "n").count().collect()} == {(g, 2 if g == 3 else 1): 100 for g in range(5)}
    keyed.update(spark, path, F.col("id") == 7, {"id": F.lit(1007)})  # into another bucket
    assert keyed.lookup(spark, path, spark.range(1007, 1008)).filter("id = 1007").count() == 1 and keyed.read(spark, path).count() == 500
