"""Ingest: validation, grocery filter, categories, dedupe, per-run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify, text, units
from ..functions.values import CONFIDENCE_GATE, STORES

RAW = """store string, productName string, originalPrice double, salePrice double, discountPercent double, validFrom string, validTo string, imageUrl string, sourceCategory string, sourceUrl string,
quantity double, quantityUnit string, quantityDisplay string, unitPriceAmount double, unitPricePerQty double, unitPriceUnit string, description string"""


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def iso_date(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def valid_entry() -> Column:
    """Whether a raw row has what it must have and, where given, sound optional values."""
    c = F.col
    ok = c("store").isin(*STORES) & (F.length("productName") > 0) & finite(c("salePrice")) & (c("salePrice") > 0) & iso_date(c("validFrom"))
    ok = ok & (c("originalPrice").isNull() | finite(c("originalPrice")))
    ok = ok & (c("discountPercent").isNull() | (finite(c("discountPercent")) & c("discountPercent").between(0, 100)))
    ok = ok & (c("validTo").isNull() | (iso_date(c("validTo")) & (c("validTo") >= c("validFrom"))))
    return F.coalesce(ok & (c("originalPrice").isNull() | (c("salePrice") <= c("originalPrice"))), F.lit(False))


def split_valid(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    return raw.filter(valid_entry()), raw.filter(~valid_entry())


def card_to_deal(cards: DataFrame, store: str, today: str, site: str = "") -> DataFrame:
    """Raw cards (see sources.cards) as feed rows; rows without a name or a positive price go. site stands before links."""
    c = F.col
    dates = units.date_range(c("date_text"))
    start = F.coalesce(dates["a"], c("valid_from_desc"), F.lit(today).cast("date"))
    original = F.when(c("original_price") > 0, c("original_price"))
    kept = cards.filter((F.length("name") > 0) & (c("sale_price") > 0))
    return kept.select(
        F.lit(store).alias("store"), text.feed_name(c("name")).alias("productName"), original.alias("originalPrice"), c("sale_price").alias("salePrice"), F.coalesce(c("discount_percent"), units.feed_discount(original, c("sale_price"))).cast("double").alias("discountPercent"),
        start.cast("string").alias("validFrom"), F.coalesce(dates["b"], c("valid_to_desc"), F.date_add(start, 7)).cast("string").alias("validTo"), c("image_url").alias("imageUrl"), F.lit(None).cast("string").alias("sourceCategory"),
        F.when(F.length("href") > 0, F.concat(F.lit(site), c("href"))).alias("sourceUrl"), c("quantity_info.quantity").alias("quantity"), c("quantity_info.unit").alias("quantityUnit"), c("quantity_info.display").alias("quantityDisplay"),
        c("unit_price_info.amount").alias("unitPriceAmount"), c("unit_price_info.per_quantity").alias("unitPricePerQty"), c("unit_price_info.per_unit").alias("unitPriceUnit"), F.nullif(c("description"), F.lit("")).alias("description"),
    )


def filter_grocery(df: DataFrame, name: str = "productName", label: str = "sourceCategory") -> DataFrame:
    """df with grocery: struct<keep, reason, matched>, evaluated per distinct name and label."""
    return classify.over_distinct(df, [name, label], "grocery", classify.grocery)


def rejections(df: DataFrame, top: int = 5) -> DataFrame:
    out = df.filter(~F.col("grocery.keep")).groupBy(F.concat_ws(":", "grocery.reason", "grocery.matched").alias("reason")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "reason").limit(top)


def categorised(df: DataFrame, name: str = "productName", label: str = "sourceCategory", rules: classify.Rules = ()) -> DataFrame:
    """df with category, sub_category, tier, confidence; less certain rows than the gate go. rules: the user's keywords; without, brands and labels decide."""
    out = classify.over_distinct(df, [name, label], "__c", lambda n, c: classify.categorise(n, c, rules))
    out = out.withColumns({k: F.col(f"__c.{k}") for k in ("category", "sub_category", "tier", "confidence")}).drop("__c")
    return out.filter(F.col("confidence") >= CONFIDENCE_GATE)


def with_unit_price(df: DataFrame, name: str = "productName", sale: str = "salePrice", sub: str = "sub_category") -> DataFrame:
    """df with format, container, pack and unit columns (units.unit_price). Texts are read once for each that is different; the price a unit is of each row."""
    said = [c for c in ("description", "quantity", "quantityUnit", "quantityDisplay") if c in df.columns]

    def read(n: Column, s: Column, *more: Column) -> Column:
        given = dict(zip(said, more))
        return units.unit_price(n, F.lit(1.0), s, *(given.get(c) for c in ("description", "quantity", "quantityUnit", "quantityDisplay")))

    out = classify.over_distinct(df, [name, sub, *said], "__u", read)
    price = units.cents(F.col(sale) / F.col("canonical_unit_value")).alias("price_per_unit")
    return out.select(*df.columns, "__u.*").withColumn("price_per_unit", price)


def to_row(df: DataFrame, *more: str) -> DataFrame:
    """Feed rows with categories and units as stored deals, with more of their columns if named."""
    c = F.col
    return df.select(
        F.sha2(F.concat_ws("|", "store", text.stored_name(c("productName")), "validFrom"), 256).alias("id"), "store", text.stored_name(c("productName")).alias("product_name"), "category", "sub_category", c("originalPrice").cast("decimal(10,2)").alias("original_price"),
        c("salePrice").cast("decimal(10,2)").alias("sale_price"), units.filled_discount(c("discountPercent"), c("originalPrice"), c("salePrice")).cast("int").alias("discount_percent"), c("validFrom").cast("date").alias("valid_from"), c("validTo").cast("date").alias("valid_to"),
        c("imageUrl").alias("image_url"), c("sourceCategory").alias("source_category"), c("sourceUrl").alias("source_url"), "format", "container", "pack_size", "unit_volume_ml", "unit_weight_g", "canonical_unit", "canonical_unit_value", "price_per_unit",
        c("confidence").alias("taxonomy_confidence"), F.lit(True).alias("is_active"), *more,
    )


def best_per_key(df: DataFrame, keys: list[str], discount: str = "discount_percent", order: str = "deal_id") -> DataFrame:
    """One row a key: the highest discount, the first by order on ties."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(discount), order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def metadata_summary(df: DataFrame, name: str = "product_name") -> DataFrame:
    """How many rows there are, and how many names say a brand, a quantity, that they are organic. Each different name is read once."""
    n = F.col(name)
    said = df.groupBy(n.alias(name)).agg(F.count("*").alias("__rows")).select("__rows", text.brand(n).isNotNull().alias("b"), units.name_quantity(n).isNotNull().alias("q"), text.organic(n).alias("o"))
    total = lambda flag: F.coalesce(F.sum(F.when(flag, F.col("__rows"))), F.lit(0).cast("long"))
    return said.agg(total(F.lit(True)).alias("n"), total(F.col("b")).alias("with_brand"), total(F.col("q")).alias("with_quantity"), total(F.col("o")).alias("organic"))


def with_metadata(df: DataFrame, rules: classify.Rules = (), name: str = "product_name", label: str = "source_category") -> DataFrame:
    """df with metadata: struct<brand, quantity, unit, organic, sub_category, form> of the name, evaluated once a distinct name and label."""

    def build(n: Column, c: Column) -> Column:
        q = units.name_quantity(n)
        return F.struct(text.brand(n).alias("brand"), q["quantity"].alias("quantity"), q["unit"].alias("unit"), text.organic(n).alias("organic"), classify.any_sub_category(n, c, rules).alias("sub_category"), units.product_form(n).alias("form"))

    return classify.over_distinct(df, [name, label], "metadata", build)


def recategorised(deals: DataFrame, rules: classify.Rules, name: str = "product_name", label: str = "source_category") -> DataFrame:
    """(deal_id, category, sub_category) of the active deals whose category or sub-category the rules now see otherwise."""
    live = deals.filter("is_active").select("deal_id", name, label, F.col("category").alias("__c"), F.col("sub_category").alias("__s"))
    out = classify.over_distinct(live, [name, label], "__x", lambda n, c: classify.categorise(n, c, rules))
    moved = out.filter(~F.col("__c").eqNullSafe(F.col("__x.category")) | ~F.col("__s").eqNullSafe(F.col("__x.sub_category")))
    return moved.select("deal_id", F.col("__x.category").alias("category"), F.col("__x.sub_category").alias("sub_category"))


def public_runs(runs: DataFrame) -> DataFrame:
    """What anyone may read of the runs: no errors."""
    return runs.select("id", "run_at", "store_results", "total_stored", "duration_ms")


def store_status(stored: DataFrame, stores=STORES) -> DataFrame:
    """Per store: success if any rows came, else failed; and their number."""
    from .read import dimension

    n = stored.groupBy("store").agg(F.count("*").alias("n"))
    return dimension(stored, "store", stores).join(n, "store", "left").select("store", F.when(F.col("n") > 0, "success").otherwise("failed").alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


def run_log(status: DataFrame, run_id: str, run_at: str) -> DataFrame:
    """The run's row: a map from store to struct<status, count>."""
    entry = F.struct("store", F.struct(F.col("status"), F.col("n").cast("int").alias("count")))
    return status.agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("store_results"), F.sum("n").cast("int").alias("total_stored")).select(F.lit(run_id).alias("id"), F.lit(run_at).cast("timestamp").alias("run_at"), "*")


def check_ratio(stored: int, resolved: int, least: float = 0.8) -> float:
    """Share of resolved rows that were stored; fails below least."""
    ratio = stored / resolved if resolved else 1.0
    if ratio < least:
        raise ValueError(f"only {ratio:.2f} of the resolved rows were stored; at least {least} are expected")
    return ratio
