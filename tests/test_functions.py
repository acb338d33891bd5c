"""Strings, quantities, dates and rules on single values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larder.functions import classify, text, units
from larder.plans.queries import DEMO_RULES

from . import plain


def ask(spark, column, *values):
    """Values of column over rows x (and y, z)."""
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    names = ["x", "y", "z"][: len(rows[0])]
    kinds = ", ".join(f"{n} {'string' if all(isinstance(r[k], (str, type(None))) for r in rows) else 'double'}" for k, n in enumerate(names))
    return [r[0] for r in spark.createDataFrame(rows, kinds).select(column).collect()]


X, Y = F.col("x"), F.col("y")


def test_names(spark):
    assert ask(spark, text.feed_name(X), "  Peroni Bier Red 24 x 33 cl ", "Milch 1.5 L", None) == ["peroni bier red 24x33cl", "milch 1.5l", None]
    assert ask(spark, text.stored_name(X), "  Vollmilch   1 Liter  ", "Mehl 500gr", "Eier 6 Stk") == ["vollmilch 1 l", "mehl 500g", "eier 6 stück"]
    assert ask(spark, text.slug(X), "Crème brûlée & Co.", "-- A --", "Zürich ÄÖÜ") == ["creme-brulee-co", "a", "zurich-aou"]
    assert ask(spark, text.title_case(X), "m-budget milch", "coca-cola") == ["M Budget Milch", "Coca Cola"]
    assert ask(spark, text.brand(X), "M-Budget Milch", "emmentaler", "Coca-Cola Zero", "prix garantie reis") == ["M-Budget", None, "Coca-Cola", "Prix Garantie"]
    assert ask(spark, text.organic(X), "Bio Milch", "biotta", "naturaplan") == [True, False, True]
    assert ask(spark, text.canonical_name(X, text.brand(X)), "emmi joghurt nature", "emmi") == ["Joghurt Nature", "Emmi"]


@pytest.mark.parametrize(
    "kw, name, want",
    [("milch", "bio milch 1l", 4), ("milch", "milchdrink 500ml", 0), ("poulet", "swiss premium pouletbrust 500g", 2), ("milch", "vollmilch 1l", 4), ("milch", "schokolade milch nuss", 3), ("milch", "feine vollmilch 1l", 2), ("milch", "feine milchschokoladen", 2), ("tomaten", "tomatenpüree", 0), ("ilch", "die milchstrasse", 1), ("x", "abc", 0)],
)
def test_relevance(spark, kw, name, want):
    assert ask(spark, text.relevance(X, Y), (kw, name)) == [want] and plain.relevance(kw, name) == want


def test_whole_word_looks_at_the_first_place_only(spark):
    assert ask(spark, text.whole_word(X, "nestea"), "nestea-bar", "schweinesteak", "xnestea nestea", "nestea") == [True, False, False, True]
    assert ask(spark, text.whole_word(X, "rosé"), "rosé 75cl", "rosés") == [True, False]


def test_links(spark):
    assert ask(spark, text.encode_list(F.split(X, "[|]")), "a|b c|d,e") == ["a,b%20c,d%2Ce"]
    assert ask(spark, text.decode_list(X), "a,b%20c,d%2Ce,") == [["a", "b c", "d,e"]]


def test_prices(spark):
    assert ask(spark, units.price(X), "12.–", "CHF 3.50", "5.--", "gratis", None) == [12.0, 3.5, 5.0, None, None]
    assert ask(spark, units.percent(X), "-52%", "20 %", "keine") == [52, 20, None]
    assert ask(spark, units.feed_discount(X, Y), (10.0, 5.0), (200.0, 199.0), (200.0, 197.0), (5.0, 5.0), (None, 5.0)) == [50, 0, 2, None, None]
    assert ask(spark, units.filled_discount(F.lit(None), X, Y), (200.0, 199.0), (None, 1.0), (10.0, 12.0)) == [1, 0, -20]


def test_quantities(spark):
    q = lambda c: F.concat_ws(" ", c["quantity"], c["unit"])
    assert ask(spark, q(units.name_quantity(X)), "6x1.5l", "milch 500g", "2 x 250 ml", "10 Stück", "3x500g", "nichts") == ["9.0 l", "500.0 g", "500.0 ml", "10.0 pcs", "1.5 kg", ""]
    d = units.described_quantity(X)
    assert ask(spark, F.concat_ws("/", d["quantity"], d["unit"], d["display"]), "4 x 150 g", "3,6 Liter", "6 Stk", "-") == ["600.0/g/4 x 150 g", "3.6/l/3,6 Liter", "6.0/pcs/6 Stück", ""]
    u = units.described_unit_price(X)
    assert ask(spark, F.concat_ws("/", u["amount"], u["per_quantity"], u["per_unit"]), "100 g = 1.17", "100 ml = -.34", "1 l = 6,81") == ["1.17/100.0/g", "0.34/100.0/ml", "6.81/1.0/l"]


def test_unit_prices(spark):
    def one(name, sale, sub):
        u = units.unit_price(F.lit(name), F.lit(sale), F.lit(sub).cast("string"))
        return spark.range(1).select(u.alias("u")).first().u

    r = one("mineralwasser ohne kohlensäure 6 x 1.5 L pet", 2.60, "water")
    assert (r.pack_size, r.unit_volume_ml, r.canonical_unit_value, r.price_per_unit, r.format, r.container) == (6, 1500, 9, 0.29, "still", "pet")
    r = one("kaffee 250g", 4.99, "coffee")
    assert (r.canonical_unit, r.canonical_unit_value, r.price_per_unit) == ("100g", 2.5, 2.0)
    assert one("eier", 3.0, "eggs").price_per_unit == 3.0 and one("brot", 3.0, None).canonical_unit is None
    given = units.unit_price(F.lit("x"), F.lit(6.0), F.lit("water"), quantity=F.lit(9.0), unit=F.lit("l"), display=F.lit("6 x 1.5 L"))
    r = spark.range(1).select(given.alias("u")).first().u
    assert (r.pack_size, r.unit_volume_ml, r.canonical_unit_value) == (6, 1500, 9)


def test_dates(spark):
    a = units.date_range(X)
    assert ask(spark, F.concat_ws(" ", a["a"], a["b"]), "10.04.2026 - 15.04.2026", "31.02.2026 - 01.03.2026", "bald") == ["2026-04-10 2026-04-15", "", ""]
    b = units.described_range(X)
    assert ask(spark, F.concat_ws(" ", b["a"], b["b"]), "gilt vom 16.4. bis 22.4.2026", "vom 28.12. bis 3.1.2026", "vom 31.2. bis 3.3.2026") == ["2026-04-16 2026-04-22", "2025-12-28 2026-01-03", ""]
    assert ask(spark, units.last_thursday(X.cast("date")), "2026-04-16", "2026-04-15") == [dt.date(2026, 4, 16), dt.date(2026, 4, 9)]
    assert ask(spark, units.age_bucket(X), 0.2, 6.0, 8.0, 27.9, 40.0, 90.0) == ["1d", "6d", "1w", "3w", "1m", "3plus"]
    assert ask(spark, units.zurich_day(X.cast("timestamp")), "2026-04-15 22:30:00", "2026-01-15 22:30:00") == [dt.date(2026, 4, 16), dt.date(2026, 1, 15)]


@pytest.mark.parametrize(
    "name, label, want",
    [
        ("Vollmilch 1L", None, ("fresh", "dairy", "keyword", 0.70)), ("Lindt Lindor 200g", None, ("long-life", "chocolate", "brand", 0.95)), ("Poulet Brust", None, ("fresh", "poultry", "keyword", 0.70)), ("meridol mundspülung zahnfleischschutz", None, ("non-food", "personal-care", "brand", 0.95)),
        ("zahnfleisch mundspülung", None, ("non-food", "personal-care", "keyword", 0.70)), ("Irgendwas", "Butter & Margarine", ("fresh", "dairy", "source", 0.85)), ("Irgendwas", None, ("long-life", None, "fallback", 0.30)), ("Schweinesteak", None, ("fresh", "meat", "keyword", 0.70)),
        ("Olivenöl", None, ("long-life", "condiments", "keyword", 0.70)), ("Pilze", None, ("fresh", "vegetables", "keyword", 0.70)), ("Gala 3-Eier Spiralen", None, ("long-life", "pasta-rice", "brand", 0.95)),
    ],
)
def test_categories(spark, name, label, want):
    c = classify.categorise(F.lit(name), F.lit(label).cast("string"), DEMO_RULES)
    assert tuple(spark.range(1).select(c.alias("c")).first().c) == want


def test_grocery(spark):
    g = lambda n, lab: tuple(spark.range(1).select(classify.grocery(F.lit(n), F.lit(lab).cast("string")).alias("g")).first().g)
    assert g("Parkside Performance Akku", None) == (False, "brand-blocklist", "parkside performance") and g("parksider", None) == (True, None, None)
    assert g("Schaufel", "Garten & Balkon") == (False, "source-category-denylist", "garten")


def test_forms(spark):
    assert ask(spark, units.product_form(X), "Rösti", "Spinat tiefkühl", "Pelati", "Tomatenpüree", "Apfel") == ["ready-meal", "frozen", "canned", "processed", "raw"]
    assert ask(spark, units.meat_cut(X), "Pouletbrust", "Flügeli", "Filet") == ["breast", "wings", None]
    assert ask(spark, units.container_of(X), "petit beurre", "im Beutel", "lose") == ["pet", "pouch", None]
