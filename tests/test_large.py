"""What large tables showed: open ties, work done again for each row or each use, and their results on small tables."""

from collections import Counter

from pyspark.sql import functions as F

from larder.functions import text
from larder.operators import ingest, run, suggest


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_event_with_deals_of_one_score_gives_the_smaller_id(spark):
    rows = spark.createDataFrame([(1, 7, "b", 5.0), (1, 7, "a", 5.0), (1, 8, "c", 6.0)], "user_id long, event_id long, deal_id string, score double").coalesce(1)
    assert [r.deal_id for r in suggest.personal_all(rows, 2).orderBy("score").collect()] == ["a", "c"]
    assert [r.deal_id for r in suggest.personal(rows, 1, 2).collect()] == ["c", "a"]


def test_a_canonical_name_looks_for_its_brand_once(spark):
    names = spark.createDataFrame([("emmi joghurt nature",), ("emmi",), ("rüebli",), ("",), (None,)], "n string")
    out = names.select(text.canonical_name(F.col("n"), text.brand(F.col("n"))).alias("c"))
    assert [r.c for r in out.collect()] == ["Joghurt Nature", "Emmi", "Rüebli", "", None]
    assert plan(out.filter("length(c) > 0")).count(" zweifel ") <= 2  # the filter is a use of its own


def test_metadata_of_repeated_names(spark):
    names = spark.createDataFrame([("Emmi Milch 1 l",)] * 3 + [("bio rüebli",)] * 2 + [(None,)], "product_name string")
    out = ingest.metadata_summary(names)
    assert [tuple(r) for r in out.collect()] == [(6, 3, 3, 2)] and [tuple(r) for r in ingest.metadata_summary(names.limit(0)).collect()] == [(0, 0, 0, 0)]
    assert plan(out).count("Aggregate") == 2


def test_names_of_feed_rows_are_spelled_once_a_name(spark):
    raw = spark.createDataFrame([("coop", "Emmi  Milch 1 Liter", 1.0, "2026-04-01")] * 3 + [("coop", "emmi milch 1 l", 1.0, "2026-04-01"), ("coop", None, 1.0, "2026-04-01"), ("coop", " ", 1.0, "2026-04-01")], "store string, productName string, salePrice double, validFrom string")
    aliases = spark.createDataFrame([], "source_tag string, category_slug string, subcategory_slug string")
    out = run.classified(raw, (), aliases)
    assert Counter((r.productName, r.valid) for r in out.collect()) == {("emmi milch 1 l", True): 4, (None, False): 1, ("", False): 1}
    assert plan(out.select("productName", "said", "valid")).count("(?:stk|pcs)") == 1
