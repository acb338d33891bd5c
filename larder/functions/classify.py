"""Ordered classification rules as Columns: the first rule that matches decides."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .group_rules import GROUP_RULES
from .values import BLOCKERS, BRANDS, DEFAULT_CATEGORY, NON_GROCERY_BRANDS, NON_GROCERY_SOURCES, SOURCE_LABELS, TIER_CONFIDENCE, WHOLE_WORDS

#: Keyword rules in order: (category, sub-category, keywords in order). A table of the user: see sources.rules.
Rules = Sequence[tuple[str, str, Sequence[str]]]


def longest_first(terms) -> list[str]:
    return sorted(terms, key=len, reverse=True)  # stable: equal lengths keep their order


def table(rows: Sequence[Sequence], *names: str) -> Column:
    """Rows of constants as an array<struct>: a list of rules is one literal, not a branch each, so plans stay small."""
    return F.array(*(F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(names, row))) for row in rows))


def first_row(rules: Column, hit: Callable[[Column], Column], use: Callable[[Column], Column]) -> Column:
    """use(rule) of the first rule that hits, null without one. The search stands once in the plan, however often use names the rule."""
    return T.let(F.get(F.filter(rules, hit), F.lit(0)), lambda r: F.when(r.isNotNull(), use(r)))


def target(rule: Column) -> Column:
    return F.struct(rule["category"].alias("category"), rule["sub_category"].alias("sub_category"))


def brand_category(name: Column) -> Column:
    rules = table([(b, *BRANDS[b]) for b in longest_first(BRANDS)], "term", "category", "sub_category")
    return T.let(F.lower(name), lambda low: first_row(rules, lambda r: F.contains(low, r["term"]) & T.whole_word(low, r["term"]), target))


def source_category(label: Column) -> Column:
    rules = table([(k, *v) for k, v in SOURCE_LABELS.items()], "term", "category", "sub_category")
    return T.let(F.lower(label), lambda low: first_row(rules, lambda r: low == r["term"], target))


def keyword_category(name: Column, rules: Rules) -> Column:
    """The first keyword that is contained and not part of a word that means something else."""
    rows = table([(kw, category, sub, "1" if kw in WHOLE_WORDS else None, "|".join(BLOCKERS.get(kw, ())) or None) for category, sub, kws in rules for kw in kws], "term", "category", "sub_category", "whole", "blockers")
    blocked = lambda low, r: F.coalesce(F.exists(F.split(r["blockers"], "[|]"), lambda x: F.contains(low, x)), F.lit(False))
    return T.let(F.lower(name), lambda low: first_row(rows, lambda r: F.contains(low, r["term"]) & (r["whole"].isNull() | T.whole_word(low, r["term"])) & ~blocked(low, r), target))


def categorise(name: Column, label: Column, rules: Rules) -> Column:
    """struct<category, sub_category, tier, confidence>: by brand, else source label, else keywords, else the default."""
    tiers = [("brand", brand_category(name)), ("source", source_category(label)), *([("keyword", keyword_category(name, rules))] if rules else [])]

    def row(s: Column, tier: str) -> Column:
        return F.struct(s["category"].alias("category"), s["sub_category"].alias("sub_category"), F.lit(tier).alias("tier"), F.lit(TIER_CONFIDENCE[tier]).alias("confidence"))

    def found(s: Column, tier: str) -> Column:
        return T.let(s, lambda x: F.when(x.isNotNull(), row(x, tier)))

    none = F.struct(F.lit(DEFAULT_CATEGORY).alias("category"), F.lit(None).cast("string").alias("sub_category"))
    return F.coalesce(*(found(s, tier) for tier, s in tiers), row(none, "fallback"))


def any_sub_category(name: Column, label: Column, rules: Rules) -> Column:
    """The first rule with a keyword in name or label; words that mean something else are not looked at."""
    rows = table([(kw, sub) for _, sub, kws in rules if sub for kw in kws], "term", "sub_category")
    both = F.struct(F.lower(name).alias("n"), F.coalesce(F.lower(label), F.lit("")).alias("l"))
    return T.let(both, lambda x: first_row(rows, lambda r: F.contains(x["n"], r["term"]) | F.contains(x["l"], r["term"]), lambda r: r["sub_category"]))


def grocery(name: Column, label: Column) -> Column:
    """struct<keep, reason, matched>: blocked brands as whole words, longest first, then departments by substring."""
    rows = table([("brand-blocklist", b) for b in longest_first(NON_GROCERY_BRANDS)] + [("source-category-denylist", k) for k in NON_GROCERY_SOURCES], "reason", "matched")
    both = F.struct(F.lower(name).alias("n"), F.coalesce(F.lower(label), F.lit("")).alias("l"))
    hit = lambda x, r: F.when(r["reason"] == "brand-blocklist", F.contains(x["n"], r["matched"]) & T.whole_word(x["n"], r["matched"])).otherwise(F.contains(x["l"], r["matched"]))
    said = lambda r: F.struct(F.lit(False).alias("keep"), r["reason"].alias("reason"), r["matched"].alias("matched"))
    none = F.lit(None).cast("string")
    return T.let(both, lambda x: F.coalesce(first_row(rows, lambda r: hit(x, r), said), F.struct(F.lit(True).alias("keep"), none.alias("reason"), none.alias("matched"))))


def group_of(name: Column, rules: Sequence[tuple[str, str | None, Sequence[str], Sequence[str]]] = GROUP_RULES) -> Column:
    r"""struct<group, form> of the first rule (group, form, patterns that all match, patterns none of which matches); \b is an edge of ASCII words."""
    edged = lambda p: p.replace(r"\b", T.EDGE)

    def first(low: Column) -> Column:
        cases = []
        for group, form, must, never in rules:
            cond = F.lit(True)
            for p in must:
                cond = cond & low.rlike(edged(p))
            if never:
                cond = cond & ~low.rlike("|".join(f"(?:{edged(p)})" for p in never))
            cases.append((cond, F.struct(F.lit(group).alias("group"), F.lit(form).cast("string").alias("form"))))
        return T.first_match(cases)

    return T.let(F.lower(name), first)


def over_distinct(df: DataFrame, keys: Sequence[str], out: str, build: Callable[..., Column]) -> DataFrame:
    """df with column out = build(keys), evaluated once for each distinct key.

    Long rule lists cost per row, and names repeat: the distinct keys are classified and joined back (Spark broadcasts them
    if they are few). The aggregation keeps later filters on out from being pushed below it and evaluated per row.
    """
    some = df.groupBy(*keys).agg(F.count("*").alias("__rows")).select(*(F.col(k).alias(f"__{k}") for k in keys), build(*(F.col(k) for k in keys)).alias(out))
    cond = F.lit(True)
    for k in keys:
        cond = cond & df[k].eqNullSafe(some[f"__{k}"])
    return df.join(some, cond, "left").drop(*(f"__{k}" for k in keys))
