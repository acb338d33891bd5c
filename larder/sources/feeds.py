"""Feed files: one JSON array per store, named <slug>-deals.json; and the nested card API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.units import half_up
from ..functions.values import STORES
from ..operators.ingest import RAW

FILE = r"([a-z][\w-]*)-deals\.json$"
# Slugs that aren't their store's name.
SLUGS = {"coop-megastore": "coop", "aldi-suisse": "aldi"}


def store_of_slug(slug: Column) -> Column:
    """The slug's store; null if unknown."""
    out = F.when(slug.isin(*STORES), slug)
    for s, store in SLUGS.items():
        out = out.when(slug == s, F.lit(store))
    return out


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all feed files below path, with the store their file belongs to; broken files give nothing, unknown stores are skipped."""
    rows = spark.read.schema(RAW).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*-deals.json").option("recursiveFileLookup", True).json(path)
    slug = F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), FILE, 1)
    routed = rows.withColumn("store", store_of_slug(slug))
    return routed.filter(F.col("store").isNotNull() & F.col("productName").isNotNull())


def write_feeds(deals: DataFrame, path: str) -> None:
    deals.write.mode("overwrite").partitionBy("store").json(path)


def write_feed_files(deals: DataFrame, path: str, shards: int = 1) -> None:
    """One JSON array a store, named <store>-deals.json, in `shards` folders (deals by their digest), each written by a task of its own.

    The rows go out as lines of text, the first with the opening bracket and a closing one after the last, so no task holds an array;
    then the files get their names: stores times shards renames.
    """
    spark, at = deals.sparkSession, ["shard", "store"]
    lines = deals.withColumn("value", F.to_json(F.struct(*deals.columns))).withColumn("shard", F.pmod(F.xxhash64("value"), F.lit(shards))).select(*at, "value", F.lit(0).alias("last"))
    lines = lines.unionByName(lines.select(*at).distinct().withColumns({"value": F.lit("]"), "last": F.lit(1)}))
    n = F.row_number().over(Window.partitionBy(*at).orderBy("last", "value"))
    text = lines.withColumn("n", n).withColumn("value", F.when(F.col("last") == 1, F.when(F.col("n") == 1, "[]").otherwise("]")).otherwise(F.concat(F.when(F.col("n") == 1, "[").otherwise(","), F.col("value"))))
    text.sortWithinPartitions(*at, "n").select(*at, "value").write.mode("overwrite").partitionBy(*at).text(path)
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for shard in fs.listStatus(place(path)):
        for folder in fs.listStatus(shard.getPath()) if shard.isDirectory() else ():
            store = folder.getPath().getName().removeprefix("store=")
            for f in fs.listStatus(folder.getPath()):
                if f.getPath().getName().startswith("part-"):
                    fs.rename(f.getPath(), place(shard.getPath(), f"{store}-deals.json"))
            fs.delete(folder.getPath(), True)


API_CARD = """uid bigint, name string, title string, offer struct<price:struct<advertisedValue:double,effectiveValue:double>,promotionPrice:struct<advertisedValue:double,effectiveValue:double>,
badges:array<struct<type:string,description:string>>,promotionDateRange:struct<startDate:string,endDate:string>>, imageTransparent struct<cdn:string,url:string>, images array<struct<cdn:string,url:string>>,
breadcrumb array<struct<id:string,name:string>>, productUrls string"""


def badge_discount(badges: Column) -> Column:
    """The number of the first percentage badge that has one."""
    some = F.filter(badges, lambda b: (b["type"] == "PERCENTAGE_PROMOTION") & b["description"].rlike(r"\d+"))
    return F.regexp_extract(F.get(some, F.lit(0))["description"], r"(\d+)", 1).try_cast("int")


def image_url(card_image: Column, images: Column, stack: str = "original") -> Column:
    url = F.coalesce(card_image["url"], card_image["cdn"], F.get(images, F.lit(0))["url"], F.get(images, F.lit(0))["cdn"])
    return F.replace(url, F.lit("{stack}"), F.lit(stack))


def api_deals(cards: DataFrame, store: str = "migros") -> DataFrame:
    """Nested API cards as feed rows: title over name, promotion over price, badge over computed discount."""
    o = F.col("offer")
    original = F.coalesce(o["price"]["effectiveValue"], o["price"]["advertisedValue"])
    sale = F.coalesce(o["promotionPrice"]["effectiveValue"], o["promotionPrice"]["advertisedValue"], original)
    computed = F.when((original > 0) & (sale < original), half_up((original - sale) / original * 100).cast("int"))
    out = cards.select(
        F.lit(store).alias("store"), F.coalesce(F.nullif("title", F.lit("")), "name").alias("productName"), original.alias("originalPrice"), sale.alias("salePrice"), F.coalesce(badge_discount(o["badges"]), computed).cast("double").alias("discountPercent"),
        F.left(o["promotionDateRange"]["startDate"], F.lit(10)).alias("validFrom"), F.left(o["promotionDateRange"]["endDate"], F.lit(10)).alias("validTo"), image_url(F.col("imageTransparent"), F.col("images")).alias("imageUrl"),
        F.get("breadcrumb", F.lit(0))["name"].alias("sourceCategory"), F.col("productUrls").alias("sourceUrl"),
    )
    return out.filter(F.col("salePrice") > 0)
