"""Lists, packs and labels: what users keep, and how it is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, units
from ..functions.values import CANONICAL_UNITS, DEFAULT_FORMATS
from .resolve import attach_skus, resolve_concepts, skus, surrogate
from .store import insert_ignore


# --- kept lists (list_id, item, ...)


def add(items: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("list_id", "item")) -> DataFrame:
    """Items not yet on their list are added; those on it stay as they are."""
    return insert_ignore(items, new, list(keys))


def remove(items: DataFrame, gone: DataFrame, keys: tuple[str, ...] = ("list_id", "item")) -> DataFrame:
    return items.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def replace_all(items: DataFrame, new: DataFrame) -> DataFrame:
    """The lists in new become what new says; others stay."""
    return items.join(new.select("list_id").distinct(), "list_id", "left_anti").unionByName(new.dropDuplicates(["list_id", "item"]))


def from_json(rows: DataFrame, column: str = "items") -> DataFrame:
    """Rows (list_id, JSON array of items) as one row an item, in order; empty texts and the text `null` are null."""
    kind = "array<struct<keyword:string,label:string,excludeTerms:array<string>,productGroupId:string>>"
    parsed = rows.select("list_id", F.posexplode(F.from_json(column, kind)).alias("pos", "i")).select("list_id", "pos", "i.*")
    clean = lambda c: F.when(~F.col(c).isin("", "null"), F.col(c))
    return parsed.select("list_id", "pos", F.col("keyword").alias("item"), clean("label").alias("label"), F.col("excludeTerms").alias("exclude"), clean("productGroupId").alias("product_group_id"))


def enrich_packs(packs: DataFrame, groups: DataFrame) -> DataFrame:
    """Packs (pack, items: array<struct<keyword, ...>>) with each item's product group from (keyword, group_id), in the old order."""
    one = packs.select("pack", F.posexplode("items").alias("pos", "item"))
    j = one.join(groups.select(F.col("keyword").alias("__k"), "group_id"), F.col("item.keyword") == F.col("__k"), "left")
    item = F.col("item").withField("product_group_id", F.col("group_id"))
    return j.groupBy("pack").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", item.alias("i")))), lambda x: x["i"]).alias("items"))


def by_category(items: DataFrame) -> DataFrame:
    return items.groupBy("category").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("item")).alias("items"))


def age_groups(hidden: DataFrame, at: str, as_of: str) -> DataFrame:
    """Rows by how many days ago: today, yesterday, week (6), month (30), older."""
    days = F.datediff(F.lit(as_of).cast("date"), F.col(at).cast("date"))
    return hidden.groupBy(F.when(days <= 0, "today").when(days == 1, "yesterday").when(days <= 6, "week").when(days <= 30, "month").otherwise("older").alias("age")).agg(F.count("*").alias("n"))


# --- what is shown


def display_name(source_name: Column, quantity: Column, product_name: Column, store: Column) -> Column:
    """The product's name, with its quantity unless it says so; else the deal's name without its store, in title case."""
    with_quantity = F.when(quantity.isNull() | F.contains(F.lower(source_name), F.lower(quantity)), source_name).otherwise(F.concat_ws(" ", source_name, quantity))
    bare = F.when(F.startswith(F.lower(product_name), F.concat(store, F.lit(" "))), F.substr(product_name, F.length(store) + 2)).otherwise(product_name)
    return F.when(source_name.isNotNull(), with_quantity).otherwise(text.title_case(bare))


def pack_text(pack: Column, unit_ml: Column, unit_g: Column) -> Column:
    """6 x 1.5 L, 500 ml, 250 g."""
    grams = F.concat(unit_g.cast("int").cast("string"), F.lit(" g"))
    one = F.when(unit_ml.isNotNull(), units.volume_text(unit_ml)).when(unit_g.isNotNull(), grams)
    return F.when(pack > 1, F.concat(pack.cast("string"), F.lit(" x "), one)).otherwise(one)


def per_unit_text(price: Column, unit: Column) -> Column:
    return F.concat(units.money(price), F.lit(" / "), unit)


def summary(verdicts: DataFrame) -> DataFrame:
    """One row: who wins what, in the categories' order, and the number of deals."""
    won = F.sort_array(F.collect_list(F.when(F.col("winner").isNotNull(), F.struct("category", "winner"))))
    return verdicts.agg(F.array_join(F.transform(won, lambda w: F.concat(w["category"], F.lit(": "), w["winner"])), " · ").alias("line"), F.sum("n").alias("deals"))


def labelled(df: DataFrame, key: str, labels: DataFrame, locale: str) -> DataFrame:
    """df with label: that of the key in a locale, else the key itself; labels: (key, locale, label)."""
    some = labels.filter(F.col("locale") == locale).select(F.col("key").alias("__k"), "label")
    return df.join(some, F.col(key) == F.col("__k"), "left").withColumn("label", F.coalesce("label", F.col(key))).drop("__k")


def format_chips(deals: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Allowed formats that occur, with their numbers."""
    return deals.filter(F.col("format").isin(*allowed)).groupBy("format").agg(F.count("*").alias("n"))


def schemas(df: DataFrame) -> DataFrame:
    """(sub_category, canonical_unit, default_format) of the sub-categories that have a schema."""
    rows = F.array(*(F.struct(F.lit(s).alias("sub_category"), F.lit(u).alias("canonical_unit"), F.lit(DEFAULT_FORMATS[s]).alias("default_format")) for s, u in CANONICAL_UNITS.items()))
    return df.sparkSession.range(1).select(F.inline(rows))


def variants(concepts: DataFrame, volume_ml: int | None = None, origin: str | None = None, **flags: bool) -> DataFrame:
    """Concepts that fit every chosen axis; flags such as is_organic=True."""
    out = concepts if volume_ml is None else concepts.filter(F.col("volume_ml") == volume_ml)
    out = out if origin is None else out.filter(F.col("origin") == origin)
    for name, on in flags.items():
        out = out.filter(F.col(name)) if on else out
    return out


def axis_values(concepts: DataFrame) -> DataFrame:
    """One row: the distinct volumes and origins, sorted."""
    return concepts.agg(F.sort_array(F.collect_set("volume_ml")).alias("volumes"), F.sort_array(F.collect_set("origin")).alias("origins"))


def browse_category(items: DataFrame, overrides: DataFrame, group_subs: DataFrame, keywords: DataFrame, labels: DataFrame, browse: DataFrame) -> DataFrame:
    """Items (item_id, keyword, category, product_group_id) with browse: an override of the item, else its group's sub-category, else its keyword's, else its category's."""
    subs = browse.select(F.col("category").alias("b"), F.explode("sub_categories").alias("sub"))
    by_group = group_subs.join(subs, F.col("sub_category") == F.col("sub")).select(F.col("group_id").alias("product_group_id"), F.col("b").alias("by_group"))
    j = items.join(overrides.select("item_id", F.col("browse").alias("by_item")), "item_id", "left").join(by_group, "product_group_id", "left")
    j = j.join(keywords.select("keyword", F.col("browse").alias("by_keyword")), "keyword", "left").join(labels.select("category", F.col("browse").alias("by_label")), "category", "left")
    return j.select("item_id", F.coalesce("by_item", "by_group", "by_keyword", "by_label").alias("browse"))


def fold_statuses(runs: DataFrame, stores: tuple[str, ...]) -> DataFrame:
    """Columns <store>_status and <store>_count as one map; no status: skipped, no count: 0."""
    entry = lambda s: F.struct(F.coalesce(f"{s}_status", F.lit("skipped")).alias("status"), F.coalesce(f"{s}_count", F.lit(0)).alias("count"))
    pairs = [x for s in stores for x in (F.lit(s), entry(s))]
    gone = [f"{s}_{c}" for s in stores for c in ("status", "count")]
    return runs.withColumn("store_results", F.create_map(*pairs)).drop(*gone)


# --- the concept layer in one go


def populate_concepts(deals: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(concepts, skus, deals with sku_id): concepts by rule, else by slug of the name; units and links follow."""
    named = resolve_concepts(deals.drop("concept_id"), rules)
    slug = text.slug(F.col("product_name"))
    named = named.withColumn("concept_id", F.coalesce(F.col("rule_concept").cast("string"), surrogate(slug))).drop("rule_concept")
    concepts = named.groupBy("concept_id").agg(F.min("product_name").alias("display_name"), F.min(slug).alias("slug"))
    unit = skus(named).withColumn("sku_id", surrogate("concept_id", "store", "region", "product_name"))
    return concepts, unit, attach_skus(named, unit)


def above_fold(suggestions: DataFrame, keys: list[str], order: str, n: int = 3) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order), "deal_id")
    return suggestions.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def by_display_name(concepts: DataFrame, group: str) -> DataFrame:
    """Concepts of each group with place, by name as the Unicode collation orders it (accents after their letter, capitals after small ones), then by id."""
    order = Window.partitionBy(group).orderBy(F.collate("display_name", "UNICODE"), "concept_id")
    return concepts.withColumn("place", F.row_number().over(order))


def in_order_of_creation(items: DataFrame) -> DataFrame:
    """Items of each list with place, the oldest first."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy("list_id").orderBy("created_at", "item")))
