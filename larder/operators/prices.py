"""Regular prices: what searches by product group's keyword say about known products, and the products that they reveal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, text
from .compare import first_by

# Beginnings of names that are house brands, and words that make a product organic here.
HOUSE_BRANDS = {"m-budget": "M-Budget", "m-classic": "M-Classic", "aha!": "aha!"}
ORGANIC_WORDS = ("bio ", "naturaplan")


def keywords(groups: DataFrame) -> DataFrame:
    """(keyword, group_id): the first keyword of each group, which is the one that is searched for."""
    return groups.select(F.get("search_keywords", F.lit(0)).alias("keyword"), "group_id").filter("keyword is not null")


def refreshed(results: DataFrame, products: DataFrame, store: str) -> DataFrame:
    """(id, regular_price): for each product of the store that a result names, the least price found."""
    own = products.filter(F.col("store") == store).select("id", "source_name")
    return results.join(own, "source_name").groupBy("id").agg(F.min("regular_price").alias("regular_price"))


def revealed(results: DataFrame, groups: DataFrame, products: DataFrame, store: str) -> DataFrame:
    """New products of a store, one a name: results (place, keyword, source_name, regular_price) that no product has.

    A result goes to the first group (by id) of its keyword that does not exclude its name, else to the group that the name rules give it, if there
    is such a group; otherwise it is left out. The first result of a name that has a group decides.
    """
    known = products.filter(F.col("store") == store).select("source_name").distinct()
    new = results.join(known, "source_name", "left_anti")
    g = groups.select("group_id", "category", "product_form", "exclude_keywords")
    said = keywords(groups).join(g, "group_id")
    excluded = text.any_term(F.col("source_name"), F.filter("exclude_keywords", lambda e: e != ""))
    by_keyword = new.join(said, "keyword").filter(~excluded).groupBy("source_name", "place", "regular_price").agg(F.min_by(F.struct("group_id", "category", "product_form"), "group_id").alias("g"))
    rest = new.join(by_keyword.select("source_name", "place"), ["source_name", "place"], "left_anti")
    ruled = classify.over_distinct(rest, ["source_name"], "__rule", classify.group_of).join(g, F.col("__rule.group") == F.col("group_id"))
    by_rule = ruled.select("source_name", "place", "regular_price", F.struct("group_id", "category", "product_form").alias("g"))
    one = first_by(by_keyword.unionByName(by_rule), ["source_name"], "place")
    low = F.lower("source_name")
    brand = text.first_match([(F.startswith(low, F.lit(b)), F.lit(said)) for b, said in HOUSE_BRANDS.items()])
    return one.select(
        F.lit(store).alias("store"), "source_name", text.capitalise_words(text.squeeze(F.col("source_name"))).alias("canonical_name"), F.coalesce("g.category", F.lit("fresh")).alias("category"), F.col("g.group_id").alias("product_group"),
        F.coalesce("g.product_form", F.lit("raw")).alias("product_form"), "regular_price", brand.alias("brand"), text.any_contained(low, ORGANIC_WORDS).alias("is_organic"),
    )
