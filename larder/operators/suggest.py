"""Cheapest offers and suggestions that fade with time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.units import decay
from ..functions.values import CANDIDATE_DISCOUNT, COLD_START_SIGNALS, DECAY_DAYS, INTEREST_DAYS
from .read import active


def cheapest_now(deals: DataFrame, as_of: str, keys: tuple[str, ...] = ("concept_id", "region")) -> DataFrame:
    """The cheapest active deal of each key; the smaller id on ties."""
    w = Window.partitionBy(*keys).orderBy("sale_price", "deal_id")
    return active(deals, as_of).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def candidates(interests: DataFrame, cheapest: DataFrame, now: str) -> DataFrame:
    """Recent, undismissed interests whose concept has a discount of 30 or more, scored by age and discount."""
    t = F.lit(now).cast("timestamp")
    seen = F.col("added_at").cast("timestamp")
    live = interests.filter(F.col("dismissed_at").isNull() & (seen > t - F.make_dt_interval(F.lit(INTEREST_DAYS))))
    j = live.join(cheapest.filter(F.col("discount_percent") >= CANDIDATE_DISCOUNT), "concept_id")
    return j.withColumn("score", decay(seen, t, DECAY_DAYS) * F.col("discount_percent"))


def personal(cands: DataFrame, user: int, limit: int = 10) -> DataFrame:
    return cands.filter(F.col("user_id") == user).orderBy(F.desc("score"), "event_id", "deal_id").limit(limit)


def personal_all(cands: DataFrame, limit: int = 10) -> DataFrame:
    """The best of each user; an event that meets deals of several regions at one score gives the smaller deal_id first."""
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "event_id", "deal_id")
    return cands.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= limit).drop("__n")


def cold_start(deals: DataFrame, limit: int = 10) -> DataFrame:
    """Highest discounts among active deals, whatever their dates."""
    return deals.filter(F.col("is_active") & (F.col("discount_percent") >= CANDIDATE_DISCOUNT)).orderBy(F.desc("discount_percent"), "deal_id").limit(limit)


def modes(interests: DataFrame) -> DataFrame:
    """Per user, personal from five undismissed signals on, else cold-start."""
    n = F.count_if(F.col("dismissed_at").isNull())
    return interests.groupBy("user_id").agg(n.alias("signals"), F.when(n < COLD_START_SIGNALS, "cold-start").otherwise("personal").alias("mode"))


def hydrate(cands: DataFrame, concepts: DataFrame, deals: DataFrame) -> DataFrame:
    """Candidates with the concept's name (or a dash) and the deal's picture."""
    named = cands.join(concepts.select("concept_id", "display_name"), "concept_id", "left").withColumn("display_name", F.coalesce("display_name", F.lit("—")))
    return named.join(deals.select("deal_id", "image_url"), "deal_id", "left")
