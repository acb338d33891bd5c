"""The concept layer in one go: rules, families, concepts, stock-keeping units, and the deals linked to them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .resolve import attach_skus, region_of, resolve_concepts, surrogate


@dataclass
class Layer:
    families: DataFrame  # slug, display_name, category_slug, subcategory_slug
    concepts: DataFrame  # concept, display_name, family: those that no rule gave
    skus: DataFrame  # sku_id, concept, store, region, product_name, regular_price, last_seen
    deals: DataFrame  # with concept and sku_id


def populate(deals: DataFrame, rules: DataFrame, known_subcategories: DataFrame) -> Layer:
    """Deals with a sub-category get the concept of the first rule that matches, else one of their own (sub-category and name); the others get none.

    rules: concept_resolver rows; known_subcategories: (slug). A family is a sub-category of which some deal has no rule, with the
    category of its first deal; its subcategory_slug is null if the taxonomy does not know it. A unit is a (concept, store, region,
    name); its regular price is that of its last deal. Two concepts of one store and name, which is how deals are linked, give the smaller id.
    """
    tagged = resolve_concepts(deals.filter("sub_category is not null and sub_category <> ''"), rules)
    own = text.slug(F.concat_ws("-", "sub_category", "product_name"))
    named = tagged.withColumn("region", region_of(F.col("store"))).withColumn("concept", F.coalesce(F.col("rule_concept").cast("string"), own))
    free = named.filter("rule_concept is null")
    first = F.struct("valid_from", "deal_id")
    families = free.groupBy(F.col("sub_category").alias("slug")).agg(F.min_by("category_slug", first).alias("category_slug"))
    known = known_subcategories.select(F.col("slug").alias("__k")).distinct()
    families = families.join(known, F.col("slug") == F.col("__k"), "left").select("slug", text.title_case(F.col("slug")).alias("display_name"), "category_slug", F.col("__k").alias("subcategory_slug"))
    concepts = free.groupBy("concept").agg(F.max_by("product_name", first).alias("display_name"), F.max_by("sub_category", first).alias("family"))
    keys = ["concept", "store", "region", "product_name"]
    skus = named.groupBy(*keys).agg(F.max_by("original_price", first).alias("regular_price"), F.max("updated_at").alias("last_seen")).withColumn("sku_id", surrogate(*keys))
    linked = attach_skus(named.drop("rule_concept"), skus)
    rest = deals.filter("sub_category is null or sub_category = ''")
    return Layer(families, concepts, skus, linked.unionByName(rest, allowMissingColumns=True))
