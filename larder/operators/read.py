"""Read side: snapshots, filters, facets, sections. DataFrame -> DataFrame; dates are parameters."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import CATEGORIES, STORES

ALIASES = {"long-life": "longlife", "non-food": "household"}


def active(deals: DataFrame, as_of: str, keep_open: bool = False) -> DataFrame:
    """Active and not expired on a day; deals without an end are dropped, or kept with keep_open."""
    day = F.lit(as_of).cast("date")
    until = F.col("valid_to") >= day
    return deals.filter(F.col("is_active") & (until | F.col("valid_to").isNull() if keep_open else until))


def valid_on(deals: DataFrame, day: str) -> DataFrame:
    """Whose interval holds the day, active or not."""
    d = F.lit(day).cast("date")
    return deals.filter((F.col("valid_from") <= d) & (F.col("valid_to").isNull() | (F.col("valid_to") >= d)))


def snapshot(deals: DataFrame, as_of: str, limit: int = 10_000) -> DataFrame:
    """The page's rows: active, categories under their short names, highest discount first."""
    known = active(deals, as_of).filter(F.col("store").isin(*STORES) & F.col("category").isin(*CATEGORIES))
    return known.replace(ALIASES, subset=["category"]).orderBy(F.desc("discount_percent"), "deal_id").limit(limit)


@dataclass
class Filters:
    """What a reader has chosen; type `all` and empty strings choose nothing."""

    type: str = "all"
    category: str = ""
    sub_category: str = ""
    stores: tuple[str, ...] = field(default=STORES)
    q: str = ""

    @classmethod
    def parse(cls, query: str) -> Filters:
        """Of a URL's query. An empty list of stores means all; a list of unknown ones means none."""
        raw = {k: v[0] for k, v in parse_qs(query, keep_blank_values=True).items()}
        kind = ALIASES.get(raw.get("type", ""), raw.get("type", ""))
        stores = tuple(s for s in raw["stores"].split(",") if s in STORES) if raw.get("stores") else STORES
        return cls(kind if kind in ("fresh", "longlife", "household") else "all", raw.get("category", ""), raw.get("sub", ""), stores, raw.get("q", ""))

    def serialize(self) -> str:
        said = {"type": self.type if self.type != "all" else "", "category": self.category, "sub": self.sub_category, "stores": "" if self.stores == STORES else ",".join(self.stores), "q": self.q}
        return urlencode({k: v for k, v in said.items() if v})

    def active_count(self) -> int:
        return sum((self.type != "all", bool(self.category), bool(self.sub_category), self.stores != STORES, bool(self.q.strip())))

    def is_default(self) -> bool:
        return self == Filters()

    def where(self, *parts: str) -> Column:
        """The conjunction of the named parts."""
        eq = lambda c, v: F.lower(F.coalesce(F.col(c), F.lit(""))) == v.lower()
        all_parts = {
            "type": F.lit(True) if self.type == "all" else F.col("category") == self.type,
            "category": eq("category_slug", self.category) if self.category else F.lit(True),
            "sub_category": eq("sub_category", self.sub_category) if self.sub_category else F.lit(True),
            "stores": F.col("store").isin(*self.stores) if self.stores else F.lit(False),
            "q": F.lower("product_name").contains(self.q.strip().lower()) if self.q.strip() else F.lit(True),
        }
        out = F.lit(True)
        for p in parts or all_parts:
            out = out & all_parts[p]
        return out


def filtered(deals: DataFrame, f: Filters) -> DataFrame:
    return deals.filter(f.where())


def dimension(df: DataFrame, name: str, values) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(F.array(*(F.lit(v) for v in values))).alias(name))


def store_counts(deals: DataFrame, f: Filters) -> DataFrame:
    """Per store, with every choice but that of stores."""
    return deals.filter(f.where("type", "category", "sub_category", "q")).groupBy("store").agg(F.count("*").alias("n"))


def facet(deals: DataFrame, f: Filters, key: str, universe: tuple[str, ...], counted: tuple[str, ...]) -> DataFrame:
    """Every key of the universe with the number of rows that the counted choices leave, zeros last."""
    k = F.trim(F.coalesce(F.col(key), F.lit("")))
    out = deals.filter(f.where(*universe)).filter(k != "").groupBy(k.alias("key")).agg(F.count_if(f.where(*counted)).alias("n"))
    return out.orderBy(F.col("n") == 0, F.desc("n"), "key")


def category_counts(deals: DataFrame, f: Filters) -> DataFrame:
    return facet(deals, f, "category_slug", ("type",), ("stores", "sub_category", "q"))


def sub_category_counts(deals: DataFrame, f: Filters) -> DataFrame:
    return facet(deals, f, "sub_category", ("type", "category"), ("stores", "q"))


def sections(deals: DataFrame, others: int | None = None) -> DataFrame:
    """Rows in sections by sub-category (none: Other): place 1 is the section's best discount; size is that of the whole section."""
    s = deals.withColumn("section", F.when(F.trim(F.coalesce(F.col("sub_category"), F.lit(""))) == "", "Other").otherwise(F.trim("sub_category")))
    order = Window.partitionBy("section").orderBy(F.desc("discount_percent"), "deal_id")
    if others is None:
        return s.withColumn("place", F.row_number().over(order)).withColumn("size", F.count("*").over(Window.partitionBy("section")))
    # sizes by aggregation; of the rows only the first of each section go through the shuffle
    first = s.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 1 + others)
    return first.join(s.groupBy("section").agg(F.count("*").alias("size")), "section").select(*s.columns, "place", "size")


def totals(deals: DataFrame) -> DataFrame:
    """Per store, also those without rows: rows and the latest update; and the same over all (store `*`)."""
    by = deals.groupBy("store").agg(F.count("*").alias("n"), F.max("updated_at").alias("updated_at"))
    each = dimension(deals, "store", STORES).join(by, "store", "left").select("store", F.coalesce("n", F.lit(0)).alias("n"), "updated_at")
    return each.unionByName(deals.agg(F.count("*").alias("n"), F.max("updated_at").alias("updated_at")).withColumn("store", F.lit("*")))


def type_counts(deals: DataFrame) -> DataFrame:
    """Per category, and `all`."""
    counted = deals.rollup("category").agg(F.grouping("category").alias("g"), F.count("*").alias("n"))
    return counted.select(F.when(F.col("g") == 1, "all").otherwise(F.col("category")).alias("category"), "n")


def search(deals: DataFrame, keyword: str, limit: int = 50, store: str | None = None) -> DataFrame:
    """Names that contain the keyword (taken literally), best discount first."""
    hit = deals.filter(F.lower("product_name").contains(keyword.strip().lower()))
    hit = hit.filter(F.col("store") == store) if store else hit
    return hit.orderBy(F.desc("discount_percent"), "deal_id").limit(limit)


def sort_keys(by: str) -> list[Column]:
    """Of unit_price (unknown last), discount or price; ids break ties."""
    keys = {"unit_price": F.asc_nulls_last("price_per_unit"), "discount": F.desc("discount_percent"), "price": F.asc("sale_price")}
    return [keys[by], F.asc("deal_id")]


def sort_deals(deals: DataFrame, by: str) -> DataFrame:
    return deals.orderBy(*sort_keys(by))


def page(deals: DataFrame, by: str, number: int, size: int = 50) -> DataFrame:
    """The number-th page (from 0) of sorted deals."""
    return sort_deals(deals, by).offset(number * size).limit(size)


CANTONS = ("ZH", "BE", "LU", "UR", "SZ", "OW", "NW", "GL", "ZG", "FR", "SO", "BS", "BL", "SH", "AR", "AI", "SG", "GR", "AG", "TG", "TI", "VD", "VS", "NE", "GE", "JU")


def valid_canton(c: Column) -> Column:
    """Whether it is a canton's code; null is none."""
    return F.coalesce(c.isin(*CANTONS), F.lit(False))


def guarded_stores(selected: Column, covered: Column) -> Column:
    """The selected stores that a region covers; if none is left, all that it covers."""
    both = F.array_intersect(F.coalesce(selected, F.array().cast("array<string>")), covered)
    return F.when(F.size(both) > 0, both).otherwise(covered)


def covered_stores(regions: DataFrame, canton: str) -> DataFrame:
    """Stores that cover a canton; regions: (store, cantons array); `all` means every store."""
    return regions.select("store") if canton == "all" else regions.filter(F.array_contains("cantons", canton)).select("store")


def other_than(deals: DataFrame, browse: DataFrame) -> DataFrame:
    """Rows whose sub-category is in no browse category (sub_category), null included."""
    return deals.join(browse.select("sub_category").distinct(), "sub_category", "left_anti")


def stale(ts: Column, as_of: Column, days: int = 9) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(ts)) > F.lit(days * 86400 * 1000000)


def availability(concepts: DataFrame, skus: DataFrame, deals: DataFrame, as_of: str) -> DataFrame:
    """Per concept and store: A an active deal (with its least price), B only known there, C not known. A by price, then B by recency, then C."""
    live = active(deals, as_of).groupBy("concept_id", "store").agg(F.min("sale_price").alias("price"))
    known = skus.groupBy("concept_id", "store").agg(F.max("last_seen").alias("last_seen"))
    grid = concepts.select("concept_id").distinct().crossJoin(F.broadcast(dimension(concepts, "store", STORES)))  # seven stores
    cells = grid.join(live, ["concept_id", "store"], "left").join(known, ["concept_id", "store"], "left")
    cells = cells.withColumn("state", F.when(F.col("price").isNotNull(), "A").when(F.col("last_seen").isNotNull(), "B").otherwise("C"))
    order = Window.partitionBy("concept_id").orderBy("state", F.asc_nulls_last(F.when(F.col("state") == "A", F.col("price"))), F.desc_nulls_last("last_seen"), "store")
    return cells.withColumn("place", F.row_number().over(order))


def default_tiles(tiles: DataFrame, runs: DataFrame, as_of: str) -> DataFrame:
    """One row: whether there are fewer than four tiles, or no run in the last two weeks."""
    last = runs.agg(F.max("started_at").alias("last"))
    return tiles.agg(F.count("*").alias("n")).crossJoin(F.broadcast(last)).select(((F.col("n") < 4) | F.col("last").isNull() | stale(F.col("last"), F.lit(as_of).cast("timestamp"), 14)).alias("use_defaults"))


def share_totals(items: DataFrame) -> DataFrame:
    """Per store of a list: items and the sum of their prices (null or not finite: 0), dearest first."""
    p = F.when(F.col("price").isNull() | F.isnan("price") | (F.abs("price") == float("inf")), 0.0).otherwise(F.col("price"))
    return items.groupBy("store").agg(F.count("*").alias("n"), F.sum(p).alias("total")).orderBy(F.desc("total"), "store")


def rehydrate(lists: DataFrame, deals: DataFrame) -> DataFrame:
    """Shared lists (array ids, and what names a list) joined to deals; unknown ids go, pos keeps the order."""
    names = [c for c in lists.columns if c != "ids"]
    return lists.select(*names, F.posexplode("ids").alias("pos", "deal_id")).join(deals, "deal_id")
