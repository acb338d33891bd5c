"""Products, taxonomy aliases, product groups, concepts and their stock-keeping units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from .terms import containing


def surrogate(*parts: str | Column) -> Column:
    """An id made from a natural key, so that an insert needs no answer from the table."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def resolve_products(deals: DataFrame, products: DataFrame) -> DataFrame:
    """Deals with product_id by (store, source_name); unknown names get the id their product will have, and is_new."""
    p = products.select(F.col("store").alias("__s"), F.col("source_name").alias("__n"), F.col("id").alias("__id"))
    j = deals.join(p, (deals["store"] == p["__s"]) & (deals["product_name"] == p["__n"]), "left")
    return j.withColumn("product_id", F.coalesce("__id", surrogate("store", "product_name"))).withColumn("is_new", F.col("__id").isNull()).drop("__s", "__n", "__id")


def new_products(resolved: DataFrame) -> DataFrame:
    """Products for the names that have none, from their first deal."""
    w = Window.partitionBy("store", "product_name").orderBy("deal_id")
    first = resolved.filter("is_new").withColumn("__n", F.row_number().over(w)).filter("__n = 1")
    b = text.brand(F.col("product_name"))
    return first.select(F.col("product_id").alias("id"), "store", F.col("product_name").alias("source_name"), b.alias("brand"), text.canonical_name(F.col("product_name"), b).alias("canonical_name"), text.organic(F.col("product_name")).alias("is_organic"), "category", "sub_category")


def alias_taxonomy(deals: DataFrame, aliases: DataFrame) -> DataFrame:
    """Deals with the category and sub-category that an alias of their tag names; aliases: (source_tag, category_slug, subcategory_slug), one a tag."""
    a = aliases.select(F.lower("source_tag").alias("__tag"), F.col("category_slug").alias("alias_category"), F.col("subcategory_slug").alias("alias_sub_category"))
    return deals.join(a, F.lower(deals["sub_category"]) == a["__tag"], "left").drop("__tag")


def unknown_tags(deals: DataFrame, aliases: DataFrame) -> DataFrame:
    """Tags without an alias, once a (tag, store), with the first example."""
    a = aliases.select(F.lower("source_tag").alias("tag")).distinct()
    d = deals.filter(F.col("sub_category").isNotNull()).select(F.lower("sub_category").alias("tag"), "store", "product_name", "deal_id").join(a, "tag", "left_anti")
    return d.groupBy("tag", "store").agg(F.min_by("product_name", "deal_id").alias("product_name"))


#: Characters that make a keyword a regular expression.
META = r"[\\.^$*+?()\[\]{}|]"
#: Edges of words, as letters, digits and underscores of any script make them.
WORD_START, WORD_END = r"(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])", r"(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])"


def group_by_keywords(products: DataFrame, groups: DataFrame, name: str = "name", substring: bool = False) -> DataFrame:
    """products with group_id and product_form (if groups have one); groups: (group_id, include, exclude, ...).

    A keyword is literal text, without regard to case, unless it has a character that means something in a regular expression: then it
    is one (and matches nothing if it is not sound). It stands as a whole word of the name, or starts it, or ends it; of the
    groups that have such a keyword, one with a keyword found only at the end comes first, then the one whose longest other
    keyword is longest, then the smallest id. A group with an exclusion (a regular expression) found in the name is out.
    substring: a keyword may stand anywhere, exclusions are literal text, and the smallest id decides.
    Products that have a group_id keep it. Names meet keywords by a join on grams (terms.containing); only expressions meet all names.
    """
    form = "product_form" if "product_form" in groups.columns else None
    kws = groups.select("group_id", F.explode("include").alias("kw"), "exclude", (F.col(form) if form else F.lit(None).cast("string")).alias("__form"))
    plain = kws if substring else kws.filter(~F.col("kw").rlike(META))
    met = containing(products, plain, name, "kw").join(plain, "kw").withColumnRenamed(name, "__name")
    n, kw = F.lower("__name"), F.lower("kw")
    quoted = F.concat(F.lit(r"\Q"), F.replace(kw, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    if substring:
        out = F.exists("exclude", lambda x: (x != "") & F.contains(n, F.lower(x)))
        rank = F.struct("group_id")
    else:
        front = F.startswith(n, kw) | F.regexp_like(n, F.concat(F.lit(WORD_START), quoted, F.lit(WORD_END)))
        met = met.withColumn("__front", front).filter(F.col("__front") | F.endswith(n, kw))
        names, p = products.select(F.col(name).alias("__name")).filter("__name is not null").distinct(), F.col("pattern")
        like = lambda *parts: F.regexp_like(F.col("__name"), F.concat(F.lit("(?iu)"), *parts))
        for part in sound_patterns(kws.filter(F.col("kw").rlike(META)).withColumnRenamed("kw", "pattern")):
            front = like(F.lit(WORD_START), p, F.lit(WORD_END)) | like(F.lit("^"), p)
            hit = names.join(F.broadcast(part), front | like(p, F.lit("$"))).withColumn("__front", front)
            met = met.unionByName(hit.withColumnRenamed("pattern", "kw").select(*met.columns))
        out = F.exists("exclude", lambda x: (x != "") & F.regexp_like(F.col("__name"), F.concat(F.lit("(?iu)"), x)))
        rank = F.struct(F.col("__long").isNotNull(), -F.coalesce("__long", F.lit(0)), "group_id")
    met = met.filter(~F.coalesce(out, F.lit(False)))
    longest = F.lit(0) if substring else F.max(F.when(F.col("__front"), F.length("kw")))
    each = met.groupBy("__name", "group_id").agg(longest.alias("__long"), F.min("__form").alias("__form"))
    best = each.groupBy("__name").agg(F.min_by(F.struct("group_id", "__form"), rank).alias("__g"))
    j = products.join(best, products[name] == best["__name"], "left")
    free = F.col("group_id").isNull() if "group_id" in products.columns else F.lit(True)
    old = lambda c: F.col(c) if c in products.columns else F.lit(None).cast("string")
    new = {"group_id": F.when(free, F.col("__g.group_id")).otherwise(old("group_id"))}
    if form:
        new["product_form"] = F.when(free & F.col("__g").isNotNull(), F.col("__g.__form")).otherwise(old("product_form"))
    return j.withColumns(new).drop("__name", "__g")


def backfill_groups(products: DataFrame, groups: DataFrame, name: str = "name") -> DataFrame:
    """The products that get a group now, as rows of a merge."""
    return group_by_keywords(products.filter("group_id is null"), groups, name).filter("group_id is not null")


def violates_group(products: DataFrame, groups: DataFrame, name: str = "name") -> DataFrame:
    """Products whose name holds an exclusion of their group."""
    return products.join(groups.select("group_id", "exclude"), "group_id").filter(text.any_term(F.col(name), F.col("exclude"))).drop("exclude")


#: A number, a times sign and a number: how many are in a pack.
MULTIPACK = r"(?<![A-Za-z0-9_])\d+\s*[x×]\s*\d"
#: Bytes of patterns that one pass over the names broadcasts.
RULE_BYTES = 1 << 20


def sound_patterns(rules: DataFrame) -> list[DataFrame]:
    """The rules whose pattern is a regular expression, in slices of at most RULE_BYTES; others match nothing. They are written by hand, so few."""
    spark, slices, size = rules.sparkSession, [[]], 0
    for r in rules.toLocalIterator():
        try:
            spark._jvm.java.util.regex.Pattern.compile(r["pattern"])
        except Exception:  # not a regular expression
            continue
        n = 64 + len(r["pattern"].encode())
        if size + n > RULE_BYTES and slices[-1]:
            slices.append([])
            size = 0
        slices[-1].append(tuple(r))
        size += n
    return [spark.createDataFrame(x, rules.schema) for x in slices if x]


def rule_matches(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(__name, rule_concept, priority, rule_id) of the rules that match, each kind in its way: equal names meet by a join, names that contain
    a pattern by a join on grams; only regular expressions meet all names. names: (__name), distinct; rules: (rule_id, rule_type, pattern, rule_concept, priority)."""
    low, out = F.lower("__name"), ["__name", "rule_concept", "priority", "rule_id"]
    exact = names.withColumn("__low", low).join(rules.filter("rule_type = 'exact'").withColumn("__low", F.lower("pattern")), "__low").select(*out)
    within = rules.filter("rule_type in ('contains', 'brand', 'multipack')")
    met = containing(names, within, "__name", "pattern").join(within, "pattern")
    # every name contains the empty pattern: of such rules of a kind the first is enough
    empty = within.filter("pattern = ''").groupBy("rule_type").agg(F.min(F.struct("priority", "rule_id", "rule_concept")).alias("__first")).select("rule_type", "__first.*")
    met = met.select("rule_type", *out).unionByName(names.crossJoin(F.broadcast(empty)).select("rule_type", *out))  # three rows at most
    met = met.filter((F.col("rule_type") != "multipack") | low.rlike(MULTIPACK)).select(*out)
    for part in sound_patterns(rules.filter("rule_type = 'regex'")):
        hit = F.regexp_like(F.col("__name"), F.concat(F.lit("(?i)"), F.col("pattern")))
        met = met.unionByName(names.join(F.broadcast(part), hit).select(*out))
    return exact.unionByName(met)


def resolve_concepts(deals: DataFrame, rules: DataFrame, name: str = "product_name") -> DataFrame:
    """Deals with rule_concept of the first active rule (priority, then id) that matches; rules without a concept, and patterns that are no regular expression, don't count."""
    live = rules.filter(F.col("is_active") & F.col("concept_id").isNotNull()).select(F.col("id").alias("rule_id"), "rule_type", "pattern", F.col("concept_id").alias("rule_concept"), "priority")
    names = deals.select(F.col(name).alias("__name")).filter("__name is not null").distinct()
    best = rule_matches(names, live).groupBy("__name").agg(F.min_by("rule_concept", F.struct("priority", "rule_id")).alias("rule_concept"))
    return deals.join(best, deals[name] == best["__name"], "left").drop("__name")


def region_of(store: Column) -> Column:
    return F.when(store == "migros", "aare").when(store == "coop", "all").otherwise(F.concat(store, F.lit("-all")))


def skus(deals: DataFrame) -> DataFrame:
    """One a (concept, store, region, name): when its deal was last seen, and the regular price of its first deal that has one."""
    keyed = deals.withColumn("region", region_of(F.col("store")))
    regular = F.when(F.col("original_price").isNotNull(), F.struct("valid_from", "deal_id"))
    return keyed.groupBy("concept_id", "store", "region", "product_name").agg(F.max("updated_at").alias("last_seen"), F.min_by("original_price", regular).alias("regular_price"))


def attach_skus(deals: DataFrame, sku: DataFrame) -> DataFrame:
    """Deals with sku_id by (store, region, product_name), region being the store's where deals have none; a sku_id that is there stays."""
    keys = ["store", "region", "product_name"]
    d = deals if "region" in deals.columns else deals.withColumn("region", region_of(F.col("store")))
    s = sku.groupBy(*keys).agg(F.min("sku_id").alias("__sku")).withColumnsRenamed({k: f"__{k}" for k in keys})
    cond = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    had = F.col("sku_id") if "sku_id" in deals.columns else F.lit(None).cast("string")
    return d.join(s, cond, "left").withColumn("sku_id", F.coalesce(had, "__sku")).select(*deals.columns, *([] if "sku_id" in deals.columns else ["sku_id"]))
