"""The index of word starts and ends: what a search finds and what it reads."""

import random

import pytest
from pyspark.sql import functions as F

from larder.functions import text
from larder.operators import index, keyed

from . import plain

WORDS = ["milch", "vollmilch", "Bio", "brot", "ruchbrot", "7up", "up", "käse", "1l", "500g", "6x", "Rioja,", "hell", "milchdrink", "(neu)", "a", "100"]


def names():
    rng = random.Random(5)
    return sorted({" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) for _ in range(300)}) + ["", "   ", "..."]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "names")
    df = spark.createDataFrame([(n,) for n in [*names(), *names()[:9], None]], "product_name string")
    index.build(df, path, buckets=32)
    return path


@pytest.mark.parametrize("query", ["milch", " Bio Milch", "brot", "7up", "100", "6", "käse hell", "nirgends", "rioja", "up"])
def test_search_finds_what_scoring_all_finds(spark, built, query):
    q, least = query.strip(), 2
    want = {n: r for n in names() if (r := plain.relevance(q, n)) >= least}
    assert {r.name: r.relevance for r in index.about(spark, built, query).collect()} == want
    want = {n: r for n in names() if n.strip() and (r := plain.relevance(n.strip(), q)) >= least and n == n.strip()}
    assert {r.name: r.relevance for r in index.named(spark, built, query).collect() if r.name.strip()} == want


def test_a_search_reads_the_bucket_of_its_term(spark, built):
    read = index.about(spark, built, "milch").inputFiles()
    assert len({f.rpartition("/")[0] for f in read}) == 1 and f"{keyed.BUCKET}=" in read[0] and len(keyed.state(spark, built).parts) > 25


def test_new_names_touch_their_buckets(spark, built):
    before = keyed.state(spark, built).parts
    index.add(spark.createDataFrame([("xyz",), ("milch",)], "product_name string"), built)
    after = keyed.state(spark, built).parts
    assert [r.name for r in index.about(spark, built, "xyz").collect()] == ["xyz"]
    assert 0 < sum(before.get(b) != p for b, p in after.items()) <= 6  # starts and ends of one word, and the empty term


def test_search_with_exclusions(spark, tmp_path):
    groups = spark.createDataFrame([("g1", "Milch", ["milch", "drink"], ["hafer"]), ("g2", "Brot", None, None), ("g3", "Drinks", ["hafermilch"], [""])], "group_id string, label string, search_keywords array<string>, exclude_keywords array<string>")
    products = spark.createDataFrame([("p1", "g1", "vollmilch 1l", 2.0), ("p2", "g1", "milch 1l", 1.0), ("p3", "g1", "rahm", None), ("p4", "g1", "quark", None)], "product_id string, product_group string, source_name string, regular_price double")
    deals = spark.createDataFrame([("d1", "p3", "rahm", "fresh", 20), ("d2", None, "milch hafer", "fresh", 10), ("d3", None, "milch bio", "fresh", 30), ("d4", None, "milch bio", "fresh", 40), ("d5", None, "milch seife", "non-food", 50)], "deal_id string, product_id string, product_name string, category string, discount_percent int")
    labels, offers = str(tmp_path / "l"), str(tmp_path / "n")
    index.build(groups.select(F.explode(F.concat(F.array("label"), F.coalesce("search_keywords", F.array().cast("array<string>")))).alias("w")), labels, "w", 8)
    index.build(deals, offers, buckets=8)
    find = lambda q: [(r.name, r.group_id, r.deal_id, r.relevance) for r in index.search(spark, q, groups, products, deals, labels, offers).collect()]
    assert find("Milch") == [("milch bio", None, "d4", 4), ("rahm", "g1", "d1", 4), ("Drinks", "g3", None, 4), ("milch 1l", "g1", None, 4), ("vollmilch 1l", "g1", None, 4)]
    assert find("brot") == [("Brot", "g2", None, 4)] and find("") == [] and find("hafer drink")[:1] != [("rahm", "g1", "d1", 4)]


def test_keys_agree_with_relevance(spark):
    pairs = spark.createDataFrame([(k, n) for k in WORDS + ["bio milch", "brot 500g"] for n in names()], "k string, n string")
    from larder.operators.terms import first_piece, piece_ends

    lost = pairs.filter((text.relevance(F.col("k"), F.col("n")) >= 2) & first_piece(F.col("k")).isNotNull() & ~F.array_contains(piece_ends(F.col("n")), first_piece(F.col("k"))))
    assert lost.count() == 0
