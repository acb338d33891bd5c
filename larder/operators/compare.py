"""Baskets and comparisons across stores: best matches, comparison rows, bands, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.values import STORES
from .ranks import ranked
from .steps import forget, step
from .terms import containing, first_piece, piece_ends


def store_place(c: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in STORES)), c)


def first_by(df: DataFrame, keys: list[str], *order: Column | str, n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def name_keywords(names: DataFrame, keywords: DataFrame) -> DataFrame:
    """Pairs (product_name, keyword) that may be relevant at 2 or more.

    A keyword that is the start or the end of a word, or stands before a digit or a mark, has its first run of letters at the
    start or the end of a run of letters of the name. So both sides meet on that run, not all against all.
    Keywords without a letter meet names that contain them.
    """
    keyed = keywords.withColumn("key", first_piece(F.col("keyword")))
    tokens = names.select("product_name", F.explode(piece_ends(F.col("product_name"))).alias("key"))
    met = tokens.join(keyed.filter("key is not null"), "key").select("product_name", "keyword").distinct()
    odd = containing(names, keyed.filter("key is null").select("keyword", F.trim("keyword").alias("bare")), "product_name", "bare")
    odd = odd.join(keyed.select("keyword", F.trim("keyword").alias("bare")), "bare")
    return met.unionByName(odd.select("product_name", "keyword"))


def keyword_matches(items: DataFrame, deals: DataFrame, least: int = 2) -> DataFrame:
    """Items (keyword, exclude, prefer) with the discounted deals that are about them: relevance and weight. least: 2 or more."""
    names = deals.filter(F.coalesce(F.col("discount_percent"), F.lit(0)) > 0).select("product_name").distinct()
    kws = items.select("keyword").distinct().filter(F.trim("keyword") != "")
    rel = name_keywords(names, kws).withColumn("relevance", text.relevance(F.trim("keyword"), F.col("product_name"))).filter(F.col("relevance") >= least)
    out = items.join(rel, "keyword").filter(~text.any_term(F.col("product_name"), F.col("exclude")))
    short = (F.col("relevance") >= 3) & (F.size(text.words(F.col("product_name"))) <= 4)
    out = out.withColumn("preferred", text.any_term(F.col("product_name"), F.col("prefer")).cast("int")).withColumn("weight", F.col("relevance") + short.cast("int"))
    return out.join(deals.filter(F.col("discount_percent") > 0), "product_name")


def best_matches(items: DataFrame, deals: DataFrame) -> DataFrame:
    """Per item and store the best deal: preferred terms, then relevance and short names, then discount."""
    return first_by(keyword_matches(items, deals), ["item_id", "store"], F.desc("preferred"), F.desc("weight"), F.desc("discount_percent"), "deal_id")


def group_matches(items: DataFrame, deals: DataFrame, products: DataFrame) -> DataFrame:
    """Per item (with product_group) and store, the best discounted deal of the group's products."""
    grouped = deals.filter(F.col("discount_percent") > 0).join(products.select("product_id", F.col("product_group").alias("group")).distinct(), "product_id")
    j = items.join(grouped, items["product_group_id"] == grouped["group"])
    return first_by(j, ["item_id", "store"], F.desc("discount_percent"), "deal_id")


def regular_prices(products: DataFrame) -> DataFrame:
    """Per group and store the least regular price."""
    return products.filter(F.col("regular_price").isNotNull()).groupBy("product_group", "store").agg(F.min("regular_price").alias("regular_price"))


def match_basket(items: DataFrame, deals: DataFrame, products: DataFrame) -> DataFrame:
    """A row per item: its best store (none without deals; the first store in order on ties), that deal, and stores with deals.

    Items with a product group are matched by group only, others by keyword. show_regular: whether every store has a regular price.
    """
    cols = ["item_id", "store", "deal_id", "sale_price"]
    by_group = group_matches(items.filter("product_group_id is not null"), deals, products).select(*cols)
    hits = best_matches(items.filter("product_group_id is null"), deals).select(*cols).unionByName(by_group)
    best = hits.groupBy("item_id").agg(F.min_by(F.struct("store", "deal_id", "sale_price"), F.struct("sale_price", store_place(F.col("store")))).alias("b"), F.count("*").alias("stores"))
    full = regular_prices(products).groupBy(F.col("product_group").alias("product_group_id")).agg((F.countDistinct("store") == len(STORES)).alias("show_regular"))
    out = items.join(best, "item_id", "left").join(full, "product_group_id", "left")
    return out.select("item_id", F.coalesce("b.store", F.lit("none")).alias("best_store"), "b.deal_id", "b.sale_price", F.coalesce("stores", F.lit(0)).alias("stores"), F.coalesce("show_regular", F.lit(False)).alias("show_regular"))


def split_list(basket: DataFrame) -> DataFrame:
    """Items of match_basket by best store; those without one apart, under `none`."""
    return basket.groupBy("best_store").agg(F.sort_array(F.collect_list("item_id")).alias("items"), F.sum("sale_price").alias("total"))


def group_comparisons(deals: DataFrame, products: DataFrame, least_stores: int = 2) -> DataFrame:
    """Per product group with deals at two stores or more: each store's best deal, and who is cheapest (`tie` if two are)."""
    grouped = deals.join(products.select("product_id", F.col("product_group").alias("group")).filter("group is not null").distinct(), "product_id")
    best = first_by(grouped, ["group", "store"], F.desc("discount_percent"), "deal_id")
    w = Window.partitionBy("group")
    best = best.withColumn("stores", F.count("*").over(w)).filter(F.col("stores") >= least_stores).withColumn("low", F.min("sale_price").over(w))
    lowest = F.count_if(F.col("sale_price") == F.col("low")).over(w)
    winner = F.when(lowest > 1, "tie").otherwise(F.max(F.when(F.col("sale_price") == F.col("low"), F.col("store"))).over(w))
    return best.withColumn("best_store", winner).select("group", "store", "deal_id", "sale_price", "discount_percent", "stores", "best_store", (F.col("sale_price") == F.col("low")).alias("is_low"))


def standing_alone(low: Column) -> Column:
    """Every part of a name that a keyword of relevance 3 or 4 can be: from a word's start to before white space, a digit or the end; and starts and ends of the first two words."""
    at = F.sequence(F.lit(1), F.length(low))
    starts = F.filter(at, lambda k: (k == 1) | F.substr(low, k - 1, F.lit(1)).rlike(r"\s"))
    ends = F.filter(at, lambda k: (k == F.length(low)) | F.substr(low, k + 1, F.lit(1)).rlike(r"[\s\d]"))
    spans = F.flatten(F.transform(starts, lambda s: F.transform(F.filter(ends, lambda e: e >= s), lambda e: F.substr(low, s, e - s + 1))))
    edges = F.transform(F.slice(text.words(low), 1, 2), lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.length(w)), lambda n: F.array(F.left(w, n), F.right(w, n)))))
    return F.array_distinct(F.concat(spans, F.flatten(edges)))


def alike_names(names: DataFrame, least: int = 3) -> DataFrame:
    """(sub, a, b, score): names of a sub-category of which one is about the other (3 or more), both ways round.

    A name meets the names that equal one of its parts, so pairs number at most the parts of all names.
    """
    low = F.lower("name")
    parts = names.filter(F.length("name") > 0).select("sub", F.col("name").alias("b"), F.explode(standing_alone(low)).alias("key"))
    hit = parts.join(names.select("sub", F.col("name").alias("a"), low.alias("key")), ["sub", "key"])
    hit = hit.withColumn("score", text.relevance(F.col("a"), F.col("b"))).filter(F.col("score") >= least).select("sub", "a", "b", "score")
    back = hit.select("sub", F.col("b").alias("a"), F.col("a").alias("b"), "score")
    return hit.unionByName(back).groupBy("sub", "a", "b").agg(F.max("score").alias("score"))


def alike_offers(deals: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """The cheapest offer of each sub-category, store and name, as vertices (u: struct<place, deal_id>), and the links (u, v, score) of those of two stores whose names are alike, both ways."""
    known = deals.withColumn("place", store_place(F.col("store"))).filter("place > 0")
    sub = F.coalesce(F.concat(F.lit("="), "sub_category"), F.lit("")).alias("sub")
    one = first_by(known, ["sub_category", "store", "product_name"], "sale_price", "deal_id").select(sub, F.struct("place", "deal_id").alias("u"), "store", "product_name", "sale_price")
    pairs = alike_names(one.select("sub", F.col("product_name").alias("name")).distinct(), least)
    left = one.select("sub", F.col("product_name").alias("a"), "u").join(pairs, ["sub", "a"])
    links = left.join(one.select("sub", F.col("product_name").alias("b"), F.col("u").alias("v")), ["sub", "b"]).filter("u.place <> v.place")
    return one.drop("sub"), links.select("u", "v", "score")


def greedy_rounds(links: DataFrame) -> DataFrame:
    """(anchor, u) of the greedy matching of links (u, v, score), which hold both directions: in the order of u, each free offer with a free partner takes the best free partner of every other store.

    What an offer does depends on earlier ones only through offers that both are linked to, or their own link. So in a round every
    offer that is the first among those within two links acts at once, and what is used goes with its links; the first offer of all
    always acts, and the result is that of the loop. An offer without links left has had its turn and takes part no more.
    A round is three groupings and joins of the links that are left; only whether any are goes to the driver.
    """
    links, found = step(links, "links"), []
    empty = links.select(F.col("u").alias("anchor"), "u").limit(0)
    while not links.isEmpty():
        near = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        reach = links.join(near.withColumnsRenamed({"u": "v"}), "v").groupBy("u").agg(F.min("m").alias("m"))
        acting = reach.filter(F.col("m") == F.col("u")).select("u")
        best = F.min_by("v", F.struct(-F.col("score"), F.col("v.deal_id")))
        taken = step(links.join(acting, "u", "left_semi").groupBy("u", "v.place").agg(best.alias("v")).select(F.col("u").alias("anchor"), F.col("v").alias("u")), "taken")
        found.append(taken)
        used = taken.select("u").unionByName(taken.select(F.col("anchor").alias("u")).distinct())
        rest = step(links.join(used, "u", "left_anti").join(used.withColumnRenamed("u", "v"), "v", "left_anti").select("u", "v", "score"), "links")
        forget(links)
        links = rest
    both = reduce(DataFrame.unionByName, found, empty)
    return both.unionByName(both.select("anchor", F.col("anchor").alias("u")).distinct())


def similar_names(deals: DataFrame, least: int = 3) -> DataFrame:
    """Greedy comparisons by name within a sub-category (null is one of its own): match_id, deal_id, store, label, best_store.

    Stores come in their order, deals by id; each free deal takes, from every other store, the free deal whose name is most alike
    (either way round, the first of equals), and all of a match are used up. least: 3 or more.
    """
    one, links = alike_offers(deals, least)
    w = Window.partitionBy("anchor")
    rows = greedy_rounds(links).join(one, "u")
    low = rows.withColumn("low", F.min("sale_price").over(w) == F.col("sale_price"))
    winner = F.when(F.count_if("low").over(w) > 1, "tie").otherwise(F.max(F.when(F.col("low"), F.col("store"))).over(w))
    # the shortest name, the anchor's before others, then by store
    label = F.min(F.struct(F.length("product_name").alias("n"), (F.col("u") != F.col("anchor")).alias("other"), "u.place", "product_name")).over(w)["product_name"]
    return low.select(F.concat(F.lit("ns-"), "anchor.deal_id").alias("match_id"), "u.deal_id", "store", label.alias("label"), winner.alias("best_store"))


def in_order(comparisons: DataFrame) -> DataFrame:
    """Comparisons (group, kind, discount_percent a row per store's deal) with place: those by product group first, then by their best discount, then by name."""
    best = comparisons.groupBy("group", "kind").agg(F.max(F.coalesce("discount_percent", F.lit(0))).alias("best_discount"))
    return ranked(best, F.asc(F.col("kind") != "product-group"), F.desc("best_discount"), F.asc("group"), F.asc("kind"))


def rows_in_order(comparison: DataFrame) -> DataFrame:
    """Rows of each comparison with place: the best store's first (of a tie the first store in order), then by price, then by store order."""
    best = F.col("store") == F.col("best_store")
    w = Window.partitionBy("group").orderBy(F.desc(best), "sale_price", store_place(F.col("store")))
    return comparison.withColumn("place", F.row_number().over(w))


def bands(offers: DataFrame) -> DataFrame:
    """Per sub-category (none: other) and store one offer: the cheapest on promotion, else the cheapest regular. Place 1 leads its band."""
    o = offers.withColumn("band", F.coalesce("sub_category", F.lit("other")))
    best = first_by(o, ["band", "store"], F.desc("is_promo"), "sale_price", "deal_id")
    w = Window.partitionBy("band").orderBy(F.desc("is_promo"), "sale_price", "deal_id")
    return best.withColumn("place", F.row_number().over(w)).withColumn("promos", F.count_if("is_promo").over(Window.partitionBy("band")))


def band_winners(banded: DataFrame, top: int = 2) -> DataFrame:
    """Stores by the number of bands they lead with a promotion."""
    return banded.filter((F.col("place") == 1) & F.col("is_promo")).groupBy("store").agg(F.count("*").alias("won")).orderBy(F.desc("won"), "store").limit(top)


def by_category(items: DataFrame, browse: DataFrame, deals: DataFrame) -> DataFrame:
    """Items (item_id, category) through browse (category, sub_categories) to deals: the cheapest a store."""
    subs = browse.select("category", F.explode("sub_categories").alias("sub"))
    j = items.join(subs, "category").join(deals.drop("category"), F.col("sub") == F.col("sub_category"))
    return first_by(j, ["item_id", "store"], "sale_price", "deal_id").select("item_id", "store", "deal_id", "sale_price")


def keyword_for(deals: DataFrame, starters: DataFrame, least: int = 3) -> DataFrame:
    """Deals with the starter keyword of their category that says most about them; the name itself below least."""
    s = starters.select("category", "keyword", "ord")
    met = containing(deals, s, "product_name", "keyword").join(s, "keyword")
    names = deals.select("product_name", "category").distinct()
    hit = names.join(met, ["product_name", "category"]).withColumn("r", text.relevance(F.col("keyword"), F.col("product_name")))
    best = hit.filter(F.col("r") >= least).groupBy("product_name", "category").agg(F.min_by("keyword", F.struct(-F.col("r"), F.col("ord"))).alias("keyword"))
    return deals.join(best, ["product_name", "category"], "left").withColumn("keyword", F.coalesce("keyword", "product_name"))


def search_products(query: str, groups: DataFrame, products: DataFrame, deals: DataFrame, top_groups: int = 5, per_group: int = 8, top: int = 20) -> DataFrame:
    """Groups whose label is about the query (or the other way round), their products with or without a deal, then deals of no product."""
    q = F.lit(query.strip().lower())
    rel = lambda c: F.greatest(text.relevance(q, c), text.relevance(c, q))
    g = groups.withColumn("relevance", rel(F.col("label"))).filter("relevance >= 2").orderBy(F.desc("relevance"), "group_id").limit(top_groups)
    best = first_by(deals.filter("product_id is not null"), ["product_id"], F.desc("discount_percent"), "deal_id").select("product_id", "deal_id", "discount_percent")
    p = products.join(F.broadcast(g.select(F.col("group_id").alias("product_group"), "relevance")), "product_group").join(best, "product_id", "left")  # top_groups rows
    w = Window.partitionBy("product_group").orderBy(F.col("deal_id").isNull(), F.desc("discount_percent"), "product_id")
    p = p.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_group).select("product_id", F.col("source_name").alias("name"), "deal_id", "relevance")
    known = p.select(F.lower("name").alias("k")).distinct()
    rest = deals.join(products.select("product_id"), "product_id", "left_anti").filter(F.col("category") != "non-food").withColumn("relevance", text.relevance(q, F.col("product_name"))).filter("relevance >= 3")
    rest = first_by(rest.withColumn("k", F.lower("product_name")).join(known, "k", "left_anti"), ["k"], F.desc("discount_percent"), "deal_id")
    rows = p.unionByName(rest.select(F.lit(None).cast("string").alias("product_id"), F.col("product_name").alias("name"), "deal_id", "relevance"))
    return rows.orderBy(F.desc("relevance"), F.col("deal_id").isNull(), "name", "deal_id").limit(top)


def browse_counts(deals: DataFrame, browse: DataFrame) -> DataFrame:
    """Per browse category (else other-<category>) the number of deals."""
    b = browse.select(F.col("category").alias("browse"), F.explode("sub_categories").alias("sub_category"))
    first = b.groupBy("sub_category").agg(F.min("browse").alias("browse"))
    return deals.join(first, "sub_category", "left").groupBy(F.coalesce("browse", F.concat(F.lit("other-"), "category")).alias("browse")).agg(F.count("*").alias("n"))


def default_format(deals: DataFrame, schema_default: str | None) -> DataFrame:
    """Formats by number; first the schema's default if any deal has it, else the most frequent."""
    n = deals.filter(F.col("format").isNotNull()).groupBy("format").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc(F.col("format") == F.lit(schema_default or "")), F.desc("n"), "format").limit(1)


def hero_delta(banded: DataFrame) -> DataFrame:
    """Price a unit over that of the band's leader; only for equal units."""
    w = Window.partitionBy("band").orderBy("place")
    unit, price = F.first_value("canonical_unit").over(w), F.first_value("price_per_unit").over(w)
    return banded.withColumn("delta", F.when((unit == F.col("canonical_unit")) & (F.col("place") > 1), F.col("price_per_unit") - price))
