"""A weekly ingest run, from raw feed rows to stored deals and a line in the log.

The rows are cleaned, classified and priced in one frame; what the run reports is observed on that frame while it is written, so
no row is read again to be counted. The frame is written aside first: a run whose numbers are not sound stores nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import classify, text, units
from ..functions.values import CONFIDENCE_GATE, STORES
from . import ingest, keyed, resolve
from .steps import forget, step
from .upkeep import changed

KEYS = ["store", "product_name", "valid_from"]


@dataclass
class Outcome:
    numbers: dict[str, int]  # read, valid, kept, brands, quantities, organic, categorised, mapped, stored; read_<store>
    stored: DataFrame  # the rows that were merged
    unknown: DataFrame  # tags without an alias
    state: int


def classified(raw: DataFrame, rules: classify.Rules, aliases: DataFrame) -> DataFrame:
    """All rows, with names in their stored spelling, whether they are valid, and what their names and labels say, found once for each of these."""

    def stored(raw_name, c):
        return text.let(text.stored_name(raw_name), lambda n: said(n, c))

    def said(n, c):
        return F.struct(n.alias("name"), classify.grocery(n, c)["keep"].alias("keep"), classify.categorise(n, c, rules).alias("c"), text.brand(n).alias("brand"), units.name_quantity(n).isNotNull().alias("quantity"), text.organic(n).alias("organic"))

    missing = {f.name: F.lit(None).cast(f.dataType) for f in raw.sparkSession.createDataFrame([], ingest.RAW).schema if f.name not in raw.columns}
    rows = classify.over_distinct(raw.withColumns(missing), ["productName", "sourceCategory"], "said", stored)
    rows = rows.withColumn("productName", F.col("said.name")).withColumn("valid", ingest.valid_entry())
    rows = rows.withColumns({k: F.col(f"said.c.{k}") for k in ("category", "sub_category", "tier", "confidence")})
    rows = rows.withColumn("kept", F.col("valid") & F.col("said.keep")).withColumn("taken", F.col("kept") & (F.col("confidence") >= CONFIDENCE_GATE))
    return resolve.alias_taxonomy(rows, aliases)


def weekly(raw: DataFrame, table: str, log: str, run_id: str, started_at: str, rules: classify.Rules, aliases: DataFrame, least: float = 0.8, stores: tuple[str, ...] = STORES, tell: Callable[[str], None] | None = None) -> Outcome:
    """Merges raw into the keyed table, retires what the run's stores no longer offer and what has ended, and appends a row to the log.

    raw: feed rows (ingest.RAW); aliases: (source_tag, category_slug, subcategory_slug), one a tag. stores: those expected; one without rows
    has failed, and its deals stay. Fails, with the log written, if less than the share least of the categorised rows were stored
    (rows of one key are stored once); without any rows at all it fails before it stores. tell: hears of the change once all is well.
    """
    spark, seen, c = raw.sparkSession, Observation("rows"), F.col
    if raw.isEmpty():
        raise ValueError("no rows came from any source")
    rows = classified(raw, rules, aliases).observe(
        seen, F.count("*").alias("read"), F.count_if("valid").alias("valid"), F.count_if("kept").alias("kept"), F.count_if(c("kept") & c("said.brand").isNotNull()).alias("brands"), F.count_if(c("kept") & c("said.quantity")).alias("quantities"),
        F.count_if(c("kept") & c("said.organic")).alias("organic"), F.count_if("taken").alias("categorised"), F.count_if(c("taken") & c("alias_category").isNotNull()).alias("mapped"), *(F.count_if(c("store") == s).alias(f"read_{s}") for s in stores),
    )
    # written before the units are read: these need the names twice, and what stands above must not be done twice
    taken = step(rows.filter("taken").withColumnRenamed("alias_category", "category_slug").drop("said", "alias_sub_category", "valid", "kept", "taken"), "taken")
    made = ingest.with_unit_price(taken)
    started = F.lit(started_at).cast("timestamp")
    deals = ingest.to_row(made, "category_slug").withColumns({"product_id": resolve.surrogate("store", "product_name"), "updated_at": started, "created_at": started})
    stored = step(ingest.best_per_key(deals, KEYS, order="id"), "run")
    forget(taken)
    numbers = {k: v or 0 for k, v in seen.get.items()} | {"stored": stored.count()}  # the count is in the files' footers
    state = keyed.merge(stored, table, keep=("created_at",)) if keyed.exists(spark, table) else keyed.create(stored, table, KEYS)
    fine = [s for s in stores if numbers[f"read_{s}"]]
    gone = (c("store").isin(fine) & (c("updated_at") < started)) | (c("valid_to") < units.zurich_day(started))
    state = keyed.update(spark, table, c("is_active") & gone, {"is_active": F.lit(False)})
    failed, short = [s for s in stores if s not in fine], numbers["categorised"] - numbers["stored"]
    errors = [f"Sources failed: {', '.join(failed)}"] * bool(failed) + [f"Storage: stored {numbers['stored']}/{numbers['categorised']} ({short} failed)"] * bool(short)
    results = {s: ("success" if s in fine else "failed", numbers[f"read_{s}"]) for s in stores}
    line = spark.createDataFrame([(run_id, results, numbers["stored"], "; ".join(errors) or None)], "id string, store_results map<string,struct<status:string,count:long>>, total_stored long, error_log string")
    line.withColumn("run_at", started).write.mode("append").parquet(log)
    ingest.check_ratio(numbers["stored"], numbers["categorised"], least)
    changed(spark, "deals", [table], tell=tell)
    tags = stored.select("sub_category", "store", "product_name", F.col("id").alias("deal_id"))
    return Outcome(numbers, stored, resolve.unknown_tags(tags, aliases), state.number)
