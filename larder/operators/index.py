"""Search by relevance with a stored index of word starts and ends.

A keyword that says much about a name (relevance 2 or more) has its first run of letters at the start or the end of a run of
letters of the name (see compare.name_keywords). So the index holds a row for each start and end of each such run of a
name, under that term, in a keyed table whose buckets go by the term. A search reads the buckets of its own terms: one to find the
names that it is about, one for each start and end of its own words to find the names that are about it. Names are scored after
that, so the work follows the names found, not the names there are. Every name also lies under the empty term; only
searches without a letter read that one. New names are merged in; names that are gone may stay, as what they find is joined with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import keyed
from .compare import first_by
from .terms import first_piece, piece_ends

BUCKETS = 256


def _rows(names: DataFrame, name: str) -> DataFrame:
    own = names.select(F.col(name).alias("name")).filter("name is not null").distinct()
    about = own.select(F.explode(F.concat(F.array(F.lit("")), piece_ends(F.col("name")))).alias("term"), F.lit("about").alias("side"), "name")
    return about.unionByName(own.select(F.coalesce(first_piece(F.col("name")), F.lit("")).alias("term"), F.lit("named").alias("side"), "name"))


def build(names: DataFrame, path: str, name: str = "product_name", buckets: int = BUCKETS) -> keyed.State:
    """A new index of the names in a column."""
    return keyed.create(_rows(names, name), path, ["term", "side", "name"], buckets, by=["term"])


def add(names: DataFrame, path: str, name: str = "product_name") -> keyed.State:
    """Adds names; buckets that have all of theirs already stay as they are."""
    return keyed.merge(_rows(names, name), path)


def _under(spark: SparkSession, path: str, asked: list[str], side: str) -> DataFrame:
    return keyed.lookup(spark, path, spark.createDataFrame([(t,) for t in asked], "term string")).filter(F.col("term").isin(asked) & (F.col("side") == side)).select("name").distinct()


def _of_query(spark: SparkSession, c: Column) -> list[str]:
    return spark.range(1).select(c.alias("t")).first()["t"]


def about(spark: SparkSession, path: str, query: str, least: int = 2) -> DataFrame:
    """(name, relevance) of the names that the query is about, from least on, which is 2 or more."""
    q = F.lit(query.strip())
    first = _of_query(spark, F.array(F.coalesce(first_piece(q), F.lit(""))))
    return _under(spark, path, first, "about").withColumn("relevance", text.relevance(q, F.col("name"))).filter(F.col("relevance") >= least)


def named(spark: SparkSession, path: str, query: str, least: int = 2) -> DataFrame:
    """(name, relevance) of the names that are, as keywords, about the query."""
    q = F.lit(query.strip())
    own = _of_query(spark, F.concat(F.array(F.lit("")), piece_ends(q)))
    return _under(spark, path, own, "named").withColumn("relevance", text.relevance(F.col("name"), q)).filter(F.col("relevance") >= least)


def search(spark: SparkSession, query: str, groups: DataFrame, products: DataFrame, deals: DataFrame, labels: str, names: str, top_groups: int = 5, per_group: int = 8, top: int = 20) -> DataFrame:
    """Product groups the query is about, their products, then deals of no such product: name, group_id, product_id, deal_id, relevance, place.

    groups: group_id, label, search_keywords, exclude_keywords; products: product_id, product_group, source_name, regular_price;
    deals: deal_id, product_id, product_name, category, discount_percent. labels is an index of the groups' labels and keywords, names of the
    deals' names. A group counts by its keywords, both ways, and by its label; not if the query has one of its excluded words. Its
    products with a deal come first, then the most relevant, then the cheapest, per_group of them; a group without any stands alone.
    Other deals need relevance 3, are no non-food, and show once a name; words that the first group excludes are out.
    """
    q = F.lit(query.strip().lower())
    if not query.strip():
        deals = deals.limit(0)
        groups = groups.limit(0)
    said = about(spark, labels, query).withColumn("keyword_only", F.lit(False)).unionByName(named(spark, labels, query).withColumn("keyword_only", F.lit(True)))
    words = groups.select("group_id", "label", "exclude_keywords", F.explode(F.concat(F.transform(F.coalesce("search_keywords", F.array().cast("array<string>")), lambda k: F.struct(k.alias("w"), F.lit(True).alias("kw"))), F.array(F.struct(F.col("label").alias("w"), F.lit(False).alias("kw"))))).alias("x"))
    met = words.join(said, (F.col("x.w") == F.col("name")) & (F.col("x.kw") | ~F.col("keyword_only")))
    best = met.groupBy("group_id", "label", "exclude_keywords").agg(F.max("relevance").alias("relevance"))
    kept = best.filter(~F.coalesce(F.exists("exclude_keywords", lambda e: (e != "") & F.contains(q, F.lower(e))), F.lit(False)))
    chosen = kept.orderBy(F.desc("relevance"), "group_id").limit(top_groups).collect()  # top_groups rows
    first = spark.createDataFrame([(r["group_id"], r["label"], r["relevance"]) for r in chosen], f"group_id {groups.schema['group_id'].dataType.simpleString()}, label string, group_relevance int")
    own = products.join(F.broadcast(first), F.col("product_group") == F.col("group_id"))
    deal = deals.filter("product_id is not null").groupBy("product_id").agg(F.min_by(F.struct("deal_id"), F.struct(-F.col("discount_percent"), "deal_id"))["deal_id"].alias("deal_id"))
    rows = own.join(deal, "product_id", "left").filter(F.col("regular_price").isNotNull() | F.col("deal_id").isNotNull())
    rows = rows.withColumn("score", text.relevance(q, F.col("source_name")))
    order = F.struct(F.col("deal_id").isNull(), -F.col("score"), F.coalesce("regular_price", F.lit(float("inf"))), "product_id")
    rows = first_by(rows.withColumn("o", order), ["group_id"], "o", n=per_group)
    shown = rows.select(F.col("source_name").alias("name"), "group_id", "product_id", "deal_id", F.col("group_relevance").alias("relevance"))
    bare = first.join(rows.select("group_id").distinct(), "group_id", "left_anti").select(F.col("label").alias("name"), "group_id", F.lit(None).cast("string").alias("product_id"), F.lit(None).cast("string").alias("deal_id"), F.col("group_relevance").alias("relevance"))
    found = about(spark, names, query, 3).withColumnRenamed("name", "product_name")
    rest = deals.join(found, "product_name").filter(F.col("category") != "non-food").join(own.select("product_id"), "product_id", "left_anti")
    out = [e for e in (chosen[0]["exclude_keywords"] or []) if e] if chosen else []
    rest = rest.filter(~text.any_term(F.col("product_name"), F.array(*(F.lit(e) for e in out)).cast("array<string>")))
    rest = first_by(rest, ["product_name"], F.desc("discount_percent"), "deal_id").select(F.col("product_name").alias("name"), F.lit(None).cast(groups.schema["group_id"].dataType).alias("group_id"), F.lit(None).cast("string").alias("product_id"), "deal_id", "relevance")
    every = shown.unionByName(bare).unionByName(rest).orderBy(F.desc("relevance"), F.col("deal_id").isNull(), "name", "deal_id", "product_id").limit(top)
    return every
