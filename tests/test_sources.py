"""Feed files, regular prices and the concept layer on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from larder.operators import access, layer, prices, upkeep
from larder.sources import feeds


def test_feed_files_are_json_arrays(spark, tmp_path):
    path = str(tmp_path / "feeds")
    rows = [("coop-megastore", f'a "{k}"', float(k)) for k in range(20)] + [("lidl", "x\ny", 1.0), ("odd", "z", 1.0)]
    feeds.write_feed_files(spark.createDataFrame(rows, "store string, productName string, salePrice double"), path, 3)
    files = sorted((tmp_path / "feeds").rglob("*-deals.json"))
    assert {f.name for f in files} == {"coop-megastore-deals.json", "lidl-deals.json", "odd-deals.json"}
    assert sum(len(json.loads(f.read_text())) for f in files) == 22  # each a whole array
    got = sorted((r.store, r.productName, r.salePrice) for r in feeds.read_feeds(spark, path).collect())
    assert got == sorted(("coop" if s != "lidl" else s, n, p) for s, n, p in rows if s != "odd")
    feeds.write_feed_files(spark.createDataFrame([], "store string, productName string"), path)
    assert feeds.read_feeds(spark, path).collect() == []


def test_revealed_products(spark):
    groups = spark.createDataFrame([("g1", ["milch"], ["hafer"], "fresh", None), ("g2", ["milch", "x"], None, None, "drink"), ("butter-250g", ["anken"], None, "fresh", "raw"), ("g4", None, None, None, None)], "group_id string, search_keywords array<string>, exclude_keywords array<string>, category string, product_form string")
    products = spark.createDataFrame([("p1", "migros", "Vollmilch"), ("p2", "coop", "M-Budget Milch")], "id string, store string, source_name string")
    results = spark.createDataFrame(
        [(1, "milch", "Vollmilch", 2.0), (2, "milch", "Vollmilch", 1.5), (3, "milch", "M-Budget Milch", 1.0), (4, "milch", "bio  hafer drink", 3.0), (5, "milch", "M-Budget Milch", 0.5), (6, "nichts", "Butter", 4.0), (7, "nichts", "Schraube", 4.0)], "place int, keyword string, source_name string, regular_price double"
    )
    assert [tuple(r) for r in prices.refreshed(results, products, "migros").collect()] == [("p1", 1.5)]
    got = {r.source_name: r for r in prices.revealed(results, groups, products, "migros").collect()}
    assert (got["M-Budget Milch"].product_group, got["M-Budget Milch"].regular_price, got["M-Budget Milch"].brand, got["M-Budget Milch"].category) == ("g1", 1.0, "M-Budget", "fresh")
    oat = got["bio  hafer drink"]
    assert (oat.product_group, oat.category, oat.product_form, oat.is_organic, oat.canonical_name) == ("g2", "fresh", "drink", True, "Bio Hafer Drink")
    assert "Schraube" not in got and got.get("Butter") is not None and got["Butter"].product_group == "butter-250g"


def test_concept_layer(spark):
    kind = "deal_id string, store string, product_name string, sub_category string, category_slug string, original_price double, valid_from string, updated_at string"
    deals = spark.createDataFrame(
        [("1", "migros", "Milch 1l", "dairy", "fresh", 2.0, "a", "t1"), ("2", "migros", "Milch 1l", "dairy", "other", 3.0, "b", "t2"), ("3", "coop", "Käse", "dairy", None, None, "a", "t1"), ("4", "spar", "Brot", None, None, 1.0, "a", "t1"), ("5", "lidl", "Öl & Essig", "oil-vinegar", "x", 1.0, "a", "t1")], kind
    )
    rules = spark.createDataFrame([("r", "contains", "käse", 7, 1, True), ("s", "exact", "brot", 8, 1, True)], "id string, rule_type string, pattern string, concept_id long, priority int, is_active boolean")
    out = layer.populate(deals, rules, spark.createDataFrame([("dairy",)], "slug string"))
    assert sorted(tuple(r) for r in out.families.collect()) == [("dairy", "Dairy", "fresh", "dairy"), ("oil-vinegar", "Oil Vinegar", "x", None)]
    assert sorted(tuple(r) for r in out.concepts.collect()) == [("dairy-milch-1l", "Milch 1l", "dairy"), ("oil-vinegar-ol-essig", "Öl & Essig", "oil-vinegar")]
    units = {(r.concept, r.store, r.region): (r.regular_price, r.last_seen) for r in out.skus.collect()}
    assert units == {("dairy-milch-1l", "migros", "aare"): (3.0, "t2"), ("7", "coop", "all"): (None, "t1"), ("oil-vinegar-ol-essig", "lidl", "lidl-all"): (1.0, "t1")}
    linked = {r.deal_id: (r.concept, r.sku_id is None) for r in out.deals.collect()}
    assert linked == {"1": ("dairy-milch-1l", False), "2": ("dairy-milch-1l", False), "3": ("7", False), "4": (None, True), "5": ("oil-vinegar-ol-essig", False)}
    assert out.deals.filter(F.col("deal_id") == "1").first().sku_id == out.deals.filter(F.col("deal_id") == "2").first().sku_id


def test_policies(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "b", "z")], "id int, owner string, secret string")
    p = [access.Policy("anon", F.col("owner") == "a", ("id", "owner")), access.Policy("anon", F.col("id") == 3), access.Policy("mail", F.lit(True))]
    assert access.readable(df, "anon", p).columns == ["id", "owner"] and sorted(r.id for r in access.readable(df, "anon", p).collect()) == [1, 3]
    assert access.readable(df, access.SERVICE, p).count() == 3 and access.readable(df, "nobody", p).count() == 0 and access.readable(df, "mail", p).columns == df.columns
    assert access.of_token(df, "owner", "b").first().id == 3
    with pytest.raises(KeyError):
        access.of_token(df, "owner", "nope")
    assert [access.camel(c) for c in ("sub_category", "a", "is_active")] == ["subCategory", "a", "isActive"] and access.snake("subCategoryId") == "sub_category_id"


def test_migrations_run_once(spark, tmp_path):
    log = str(tmp_path / "log")
    one, two = ("001", "CREATE OR REPLACE TEMPORARY VIEW mig_a AS SELECT 1 AS x; CREATE OR REPLACE TEMPORARY VIEW mig_b AS SELECT x + 1 AS x FROM mig_a;"), ("002", "SELECT * FROM no_such_table")
    with pytest.raises(Exception, match="no_such_table"):
        upkeep.migrate(spark, [two, one], log, "2026-01-01")
    assert spark.table("mig_b").first().x == 2 and upkeep.applied(spark, log) == {"001"}
    assert upkeep.migrate(spark, [one, ("002", "SELECT 1")], log, "2026-01-02") == ["002"] and upkeep.migrate(spark, [one], log, "2026-01-03") == []


def test_others_hear_of_a_change(spark, tmp_path):
    heard = []
    assert upkeep.changed(spark, "deals", [str(tmp_path)], tell=heard.append) and heard == ["deals"]
    assert not upkeep.changed(spark, "deals") and not upkeep.changed(spark, "deals", tell=lambda tag: 1 / 0)
