"""Which store wins a category: by average discount, and by a weighted score. Two different rules, both wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.units import half_up
from ..functions.values import COUNT_WEIGHT, DISCOUNT_WEIGHT, MIN_DEALS_FOR_WINNER, STORES, TIE_POINTS, WEIGHTED_MIN_DEALS, WEIGHTED_TIE
from .read import dimension


def store_scores(deals: DataFrame, by: str = "category") -> DataFrame:
    """Per category and store: average discount and number; place 1 is the best."""
    s = deals.groupBy(by, "store").agg(F.avg("discount_percent").alias("avg_discount"), F.count("*").alias("n"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("avg_discount"), F.desc("n"), "store")))


def verdicts(deals: DataFrame, categories, by: str = "category") -> DataFrame:
    """A row per category, also without deals: state (no-data, single-store, tied, winner), winner, overall average, number.

    Tied: the best store has fewer than five deals, or leads by less than two points.
    """
    s = store_scores(deals, by)
    top = lambda c, k: F.max(F.when(F.col("place") == k, F.col(c)))
    v = s.groupBy(by).agg(
        F.count("*").alias("stores"), F.sum("n").alias("deals"), F.sum(F.col("avg_discount") * F.col("n")).alias("total"), top("store", 1).alias("best"), top("n", 1).alias("best_n"), (top("avg_discount", 1) - top("avg_discount", 2)).alias("lead")
    )
    v = dimension(deals, by, categories).join(v, by, "left")
    tied = (F.col("best_n") < MIN_DEALS_FOR_WINNER) | (F.col("lead") < TIE_POINTS)
    state = F.when(F.col("stores").isNull(), "no-data").when(F.col("stores") == 1, "single-store").when(tied, "tied").otherwise("winner")
    avg = F.coalesce(half_up(F.round(F.col("total") / F.col("deals"), 9) * 100) / 100, F.lit(0.0))
    return v.select(by, state.alias("state"), F.when(state == "winner", F.col("best")).alias("winner"), avg.alias("avg_discount"), F.coalesce("deals", F.lit(0)).alias("n"))


def average(c: Column) -> Column:
    """Mean in whole points, halves up; null counts as 0, nothing gives 0."""
    return F.coalesce(half_up(F.avg(F.coalesce(c, F.lit(0)))), F.lit(0))


def weighted_scores(deals: DataFrame, by: str = "category") -> DataFrame:
    """Per category and store with three deals or more: 100 * (0.4 * share of the most deals + 0.6 * share of the highest average)."""
    s = deals.groupBy(by, "store").agg(F.count("*").alias("n"), average(F.col("discount_percent")).alias("avg_discount"))
    s = s.filter(F.col("n") >= WEIGHTED_MIN_DEALS)
    w = Window.partitionBy(by)
    share = lambda c: F.when(F.max(c).over(w) > 0, F.col(c) / F.max(c).over(w)).otherwise(0.0)
    return s.withColumn("score", half_up(100 * (COUNT_WEIGHT * share("n") + DISCOUNT_WEIGHT * share("avg_discount"))))


def weighted_verdicts(deals: DataFrame, categories, by: str = "category") -> DataFrame:
    """A row per category: winner, or a tie where a second store is within five hundredths of the best score or fewer than two qualify."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "store"))
    s = weighted_scores(deals, by).withColumn("place", rank)
    top = lambda c, k: F.max(F.when(F.col("place") == k, F.col(c)))
    v = s.groupBy(by).agg(F.count("*").alias("stores"), top("store", 1).alias("best"), top("score", 1).alias("first"), top("score", 2).alias("second"))
    v = dimension(deals, by, categories).join(v, by, "left")
    tie = F.col("stores").isNull() | (F.col("stores") < 2) | (F.col("first") == 0) | ((F.col("first") - F.col("second")) / F.col("first") <= WEIGHTED_TIE)
    return v.select(by, F.when(tie, "tie").otherwise("winner").alias("state"), F.when(~tie, F.col("best")).alias("winner"), F.when(F.coalesce(F.col("stores"), F.lit(0)) >= 2, F.col("first")).alias("score"))


def freshness(deals: DataFrame) -> DataFrame:
    """One row: current with all stores, partial with some, stale with none."""
    n = F.countDistinct("store")
    return deals.agg(n.alias("stores"), F.when(n == 0, "stale").when(n < len(STORES), "partial").otherwise("current").alias("freshness"))


def banner(deals: DataFrame, by: str = "category") -> DataFrame:
    """Per store the mean of its categories' averages, not of its rows."""
    return deals.groupBy(by, "store").agg(F.avg("discount_percent").alias("a")).groupBy("store").agg(F.avg("a").alias("avg_of_categories"), F.count("*").alias("categories"))
