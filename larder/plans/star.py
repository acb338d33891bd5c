"""Views of the star-schema tables as promotion data, in DataFrames and as SQL text for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import half_up
from ..functions.values import STORES

AS_OF, WEEK, NOW = "2001-10-15", "1998-01-01", "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store_of(c):
    return F.element_at(F.array(*(F.lit(s) for s in STORES)), (c % len(STORES) + 1).cast("int"))


def deals(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """Line items as deals; repeated line items are one deal. placed: lines are moved first, so that a scan does not hold (and spill) all it read to find the few that repeat."""
    raw = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    # once over the columns themselves: filters on what is made of them go below, to the scan
    li, part = table(spark, sf_dir, "lineitem").select(*raw), table(spark, sf_dir, "part")
    li = (li.repartition(*raw) if placed else li).distinct()
    d = li.join(part, li["l_partkey"] == part["p_partkey"])
    whole = lambda c, k: half_up(F.col(c) * k).cast("long").cast("string")
    ident = F.md5(
        F.concat_ws(
            "|", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"), whole("l_quantity", 100), whole("l_extendedprice", 100),
            whole("l_discount", 100), whole("l_tax", 100), "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM-dd"),
        )
    )
    third = F.col("l_linenumber") % 3
    size = F.col("p_size").cast("string")
    day = F.col("l_shipdate").cast("date")
    return d.select(
        ident.alias("deal_id"), store_of(F.col("l_suppkey")).alias("store"),
        F.concat("p_name", F.lit(" "), F.when(third == 0, F.concat(size, F.lit("g"))).when(third == 1, F.concat(F.lit("6x"), size, F.lit("cl"))).otherwise(F.concat(size, F.lit(" pcs")))).alias("product_name"),
        "p_name", F.col("p_partkey").alias("concept_id"), F.col("l_suppkey").alias("supplier_id"), F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "fresh").when(F.col("p_type").isin("MEDIUM", "PROMO"), "long-life").otherwise("non-food").alias("category"),
        F.when(F.col("p_size") % 10 != 0, F.element_at(F.split("p_name", " "), 2)).alias("sub_category"), F.when(F.col("p_size") % 10 != 0, F.lower("p_brand")).alias("category_slug"), F.element_at(F.split("p_name", " "), 2).alias("product_group"),
        F.col("l_extendedprice").alias("original_price"), half_up(F.col("l_discount") * 500).cast("int").alias("discount_percent"), (half_up(F.col("l_extendedprice") * (1 - F.col("l_discount") * 5) * 100) / 100).alias("sale_price"),
        day.alias("valid_from"), F.when(F.col("l_linenumber") != 7, F.date_add(day, F.col("l_linenumber") + 7)).alias("valid_to"), (F.col("l_linestatus") == "O").alias("is_active"),
        (day + F.make_dt_interval(hours=F.col("l_linenumber"))).cast("timestamp_ntz").alias("updated_at"), F.col("l_linenumber").alias("line"),
    )


#: `deals AS (...)`, the same in DuckDB.
DEALS = """deals AS (SELECT DISTINCT ON (deal_id) * FROM (
  SELECT md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, floor(l_quantity * 100 + 0.5)::BIGINT, floor(l_extendedprice * 100 + 0.5)::BIGINT, floor(l_discount * 100 + 0.5)::BIGINT, floor(l_tax * 100 + 0.5)::BIGINT,
      l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d'))) AS deal_id,
    (['migros','coop','lidl','aldi','denner','spar','volg'])[(l_suppkey % 7 + 1)::INT] AS store,
    p_name || ' ' || CASE l_linenumber % 3 WHEN 0 THEN p_size || 'g' WHEN 1 THEN '6x' || p_size || 'cl' ELSE p_size || ' pcs' END AS product_name,
    p_name, p_partkey AS concept_id, l_suppkey AS supplier_id,
    CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'fresh' WHEN p_type IN ('MEDIUM', 'PROMO') THEN 'long-life' ELSE 'non-food' END AS category,
    CASE WHEN p_size % 10 <> 0 THEN string_split(p_name, ' ')[2] END AS sub_category, CASE WHEN p_size % 10 <> 0 THEN lower(p_brand) END AS category_slug, string_split(p_name, ' ')[2] AS product_group,
    l_extendedprice AS original_price, floor(l_discount * 500 + 0.5)::INT AS discount_percent, floor(l_extendedprice * (1 - l_discount * 5) * 100 + 0.5) / 100 AS sale_price,
    l_shipdate::DATE AS valid_from, CASE WHEN l_linenumber <> 7 THEN l_shipdate::DATE + (l_linenumber + 7)::INT END AS valid_to, l_linestatus = 'O' AS is_active,
    (l_shipdate::DATE + to_hours(l_linenumber))::TIMESTAMP AS updated_at, l_linenumber AS line
  FROM lineitem JOIN part ON l_partkey = p_partkey) ORDER BY deal_id)"""


def interests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as what users showed interest in."""
    e, n = table(spark, sf_dir, "events"), table(spark, sf_dir, "part").agg(F.count("*").alias("n_part"))
    signal = F.when(F.col("event_type") == "purchase", "added").when(F.col("event_type") == "signup", "favourited").when(F.col("event_type") == "error", "wanted_deal").otherwise("browsed")
    return e.crossJoin(F.broadcast(n)).select("event_id", "user_id", (F.col("event_id") % F.col("n_part")).alias("concept_id"), signal.alias("signal"), F.col("ts").alias("added_at"), F.when(F.col("value") < 10, F.col("ts")).alias("dismissed_at"))


INTERESTS = """interests AS (SELECT event_id, user_id, event_id % (SELECT count(*) FROM part) AS concept_id,
    CASE event_type WHEN 'purchase' THEN 'added' WHEN 'signup' THEN 'favourited' WHEN 'error' THEN 'wanted_deal' ELSE 'browsed' END AS signal, ts AS added_at, CASE WHEN value < 10 THEN ts END AS dismissed_at FROM events)"""
