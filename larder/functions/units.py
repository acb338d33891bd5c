"""Quantities, prices and dates. All are Column -> Column; what can't be read gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import EDGE, any_contained, first_match, let
from .values import CANONICAL_UNITS, CARD_PIECES, CARD_UNITS, CONTAINERS, CUTS, FORMATS, FORMS, NAME_PIECES, NAME_UNITS

NUMBER = r"(\d+(?:[.,]\d+)?)"


def group(c: Column, pattern: str, k: int) -> Column:
    """The k-th group of the first match; null without a match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, k))


def number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def half_up(c: Column) -> Column:
    """Rounding by adding a half and rounding down, as floats do it."""
    return F.floor(c + 0.5)


def cents(c: Column) -> Column:
    return half_up(c * 100) / 100


def price(c: Column) -> Column:
    """A price as shops print it: a trailing `.-` is dropped, then all but digits and points."""
    c = F.regexp_replace(F.replace(F.trim(c), F.lit("–"), F.lit("-")), r"\.\s*-+$", "")
    return F.regexp_replace(c, r"[^\d.]", "").try_cast("double")


def percent(c: Column) -> Column:
    return group(c, r"(\d+)\s*%", 1).try_cast("int")


def feed_discount(original: Column, sale: Column) -> Column:
    """Percent off, halves to even; null where there is none."""
    ok = (original > 0) & (sale > 0) & (sale < original)
    return F.when(ok, F.bround((original - sale) / original * 100, 0).cast("int"))


def filled_discount(discount: Column, original: Column, sale: Column) -> Column:
    """The given percent, else computed with halves up, else 0."""
    return F.coalesce(discount.cast("long"), F.when(original > 0, half_up((original - sale) / original * 100)), F.lit(0).cast("long"))


def unit_name(u: Column) -> Column:
    u = F.lower(u)
    return F.when(u.isin("liter", "litre"), "l").when(u == "gr", "g").when(u.isin("stück", "stücke", "stk", "rollen"), "pcs").otherwise(u)


def described_quantity(c: Column) -> Column:
    """struct<quantity, unit, display> of a description: a pack's total, a single amount, or pieces."""
    multi, single, piece = rf"(?i)(\d+)\s*x\s*{NUMBER}\s*({CARD_UNITS})(?![\p{{L}}\p{{N}}_])", rf"(?i){NUMBER}\s*({CARD_UNITS})(?![\p{{L}}\p{{N}}_])", rf"(?i)(\d+)\s*({CARD_PIECES})(?![\p{{L}}\p{{N}}_])"
    row = lambda q, u, d: F.struct(q.alias("quantity"), u.alias("unit"), d.alias("display"))
    g = lambda p, k: F.regexp_extract(c, p, k)
    return (
        F.when(c.rlike(multi), row(g(multi, 1).try_cast("double") * number(g(multi, 2)), unit_name(g(multi, 3)), F.concat(g(multi, 1).try_cast("long").cast("string"), F.lit(" x "), g(multi, 2), F.lit(" "), g(multi, 3))))
        .when(c.rlike(single), row(number(g(single, 1)), unit_name(g(single, 2)), F.concat_ws(" ", g(single, 1), g(single, 2))))
        .when(c.rlike(piece), row(g(piece, 1).try_cast("double"), F.lit("pcs"), F.concat(g(piece, 1).try_cast("long").cast("string"), F.lit(" Stück"))))
    )


def described_unit_price(c: Column) -> Column:
    """struct<amount, per_quantity, per_unit> of `100 g = 1.17`; `-.34` is 0.34."""
    p = r"(?i)(\d+)\s*(g|kg|ml|cl|l)\s*=\s*(-?\d*[.,]?\d+)"
    amount = F.abs(F.regexp_replace(F.replace(F.regexp_extract(c, p, 3), F.lit(","), F.lit(".")), r"^-\.", "0.").try_cast("double"))
    return F.when(c.rlike(p) & amount.isNotNull(), F.struct(amount.alias("amount"), F.regexp_extract(c, p, 1).try_cast("double").alias("per_quantity"), F.lower(F.regexp_extract(c, p, 2)).alias("per_unit")))


def name_quantity(c: Column) -> Column:
    """struct<quantity, unit> of a name: packs in base units, from a thousand on in l or kg; single amounts and pieces as they stand."""
    c = F.lower(c)
    multi, single, piece = rf"(\d+)\s*x\s*{NUMBER}\s*({NAME_UNITS})", rf"{NUMBER}\s*({NAME_UNITS}){EDGE}", rf"(\d+)\s*({NAME_PIECES}){EDGE}"
    # the alternatives stand in this order, so `liter` is read as `l` where no edge follows, as in packs
    g = lambda p, k: F.regexp_extract(c, p, k)
    unit = unit_name(g(multi, 3))
    total = g(multi, 1).try_cast("double") * number(g(multi, 2)) * factor(unit)
    base, large = F.when(unit.isin("g", "kg"), "g").otherwise("ml"), F.when(unit.isin("g", "kg"), "kg").otherwise("l")
    row = lambda q, u: F.struct(q.alias("quantity"), u.alias("unit"))
    return (
        F.when(c.rlike(multi), F.when(total >= 1000, row(total / 1000, large)).otherwise(row(total, base)))
        .when(c.rlike(single), row(number(g(single, 1)), unit_name(g(single, 2))))
        .when(c.rlike(piece), row(g(piece, 1).try_cast("double"), unit_name(g(piece, 2))))
    )


def factor(unit: Column) -> Column:
    """To ml or g."""
    return F.when(unit.isin("l", "kg"), 1000.0).when(unit == "dl", 100.0).when(unit == "cl", 10.0).when(unit.isin("ml", "g"), 1.0)


def to_ml(value: Column, unit: Column) -> Column:
    return F.when(unit.isin("l", "dl", "cl", "ml"), value * factor(unit))


def to_g(value: Column, unit: Column) -> Column:
    return F.when(unit.isin("kg", "g"), value * factor(unit))


def by_keywords(c: Column, rules, default: str | None = None) -> Column:
    low = F.lower(c)
    return first_match([(any_contained(low, kws), F.lit(v)) for v, kws in rules], F.lit(default) if default else None)


def format_of(c: Column) -> Column:
    return by_keywords(c, FORMATS)


def container_of(c: Column) -> Column:
    return by_keywords(c, CONTAINERS)


def product_form(c: Column) -> Column:
    return by_keywords(c, FORMS, "raw")


def meat_cut(c: Column) -> Column:
    return by_keywords(c, CUTS)


MULTI = rf"(?i)(\d+)\s*x\s*{NUMBER}\s*({CARD_UNITS})"
SINGLE = rf"(?i){NUMBER}\s*({CARD_UNITS}){EDGE}"


def unit_price(name: Column, sale: Column, sub_category: Column, description: Column | None = None, quantity: Column | None = None, unit: Column | None = None, display: Column | None = None) -> Column:
    """struct<format, container, pack_size, unit_volume_ml, unit_weight_g, canonical_unit, canonical_unit_value, price_per_unit>.

    A given quantity and unit decide; else the displayed quantity, then the name, are read.
    """
    nothing = F.lit(None)
    description, quantity, unit, display = (F.lit("") if description is None else F.coalesce(description, F.lit("")), nothing.cast("double") if quantity is None else quantity, nothing.cast("string") if unit is None else unit, nothing.cast("string") if display is None else display)
    text = F.lower(F.concat(name, F.lit(" "), description))
    given = quantity.isNotNull() & (F.coalesce(unit, F.lit("")) != "")
    raw = F.coalesce(display, name)
    schema = first_match([(sub_category == k, F.lit(v)) for k, v in CANONICAL_UNITS.items()])
    # each step is bound once: the next ones use its parts many times
    texts = F.struct(
        F.when(given, F.when(display.rlike(MULTI), display)).otherwise(F.when(raw.rlike(MULTI), raw).when(name.rlike(MULTI), name)).alias("pack"),
        F.when(~given, F.when(raw.rlike(SINGLE), raw).when(name.rlike(SINGLE), name)).alias("one"),
    )

    def parse(t: Column) -> Column:
        g = lambda k: F.regexp_extract(t["pack"], MULTI, k)
        q = lambda k: F.regexp_extract(t["one"], SINGLE, k)
        return F.struct(g(1).try_cast("int").alias("count"), number(g(2)).alias("per"), unit_name(g(3)).alias("per_unit"), number(q(1)).alias("one"), unit_name(q(2)).alias("one_unit"))

    def measure(r: Column) -> Column:
        multi, single = r["count"].isNotNull(), ~given & r["count"].isNull() & r["one"].isNotNull()
        each = lambda conv: F.when(multi, conv(r["per"], r["per_unit"])).when(given, conv(quantity, unit)).when(single, conv(r["one"], r["one_unit"]))
        total = lambda conv: F.when(given, conv(quantity, unit)).when(multi, conv(r["per"], r["per_unit"]) * r["count"]).when(single, conv(r["one"], r["one_unit"]))
        pack = F.when(multi, r["count"]).when(given | single, 1)
        return F.struct(pack.alias("pack"), each(to_ml).alias("each_ml"), each(to_g).alias("each_g"), total(to_ml).alias("ml"), total(to_g).alias("g"), schema.alias("schema"))

    def canonical(p: Column) -> Column:
        unit_of = F.coalesce(p["schema"], F.when(p["ml"].isNotNull(), "L").when(p["g"].isNotNull(), "kg"))
        return let(unit_of, lambda u: F.struct(p.alias("p"), u.alias("unit"), F.when(u == "L", p["ml"] / 1000).when(u == "kg", p["g"] / 1000).when(u == "100g", p["g"] / 100).when(u == "piece", F.coalesce(p["pack"], F.lit(1)).cast("double")).alias("value")))

    def row(c: Column) -> Column:
        value = F.when(c["value"] > 0, c["value"])
        p = c["p"]
        return F.struct(
            format_of(text).alias("format"), container_of(text).alias("container"), p["pack"].alias("pack_size"), p["each_ml"].alias("unit_volume_ml"), p["each_g"].alias("unit_weight_g"), c["unit"].alias("canonical_unit"), value.alias("canonical_unit_value"), cents(sale / value).alias("price_per_unit")
        )

    return let(let(let(let(texts, parse), measure), canonical), row)


def date_range(c: Column) -> Column:
    """struct<a, b> of `dd.MM.yyyy - dd.MM.yyyy`; both or none."""
    p = r"^(\d{2}\.\d{2}\.\d{4})\s*-\s*(\d{2}\.\d{2}\.\d{4})"
    day = lambda t, k: F.try_to_date(F.regexp_extract(t, p, k), "dd.MM.yyyy")
    both = let(F.trim(c), lambda t: F.struct(day(t, 1).alias("a"), day(t, 2).alias("b")))  # no match gives no text, and so no day
    return let(both, lambda r: F.when(r["a"].isNotNull() & r["b"].isNotNull(), r))


def described_range(c: Column) -> Column:
    """struct<a, b> of `vom d.M. bis d.M.yyyy`; it starts a year earlier if its month is later."""
    p = r"vom\s+(\d{1,2})\.(\d{1,2})\.\s*bis\s+(\d{1,2})\.(\d{1,2})\.(\d{4})"
    g = lambda k: F.regexp_extract(c, p, k).try_cast("int")
    day = lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    a, b = day(F.when(g(2) <= g(4), g(5)).otherwise(g(5) - 1), g(2), g(1)), day(g(5), g(4), g(3))
    return F.when(c.rlike(p) & a.isNotNull() & b.isNotNull(), F.struct(a.alias("a"), b.alias("b")))


def zurich_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "Europe/Zurich"))


def last_thursday(d: Column) -> Column:
    """The day itself if it is one."""
    return F.next_day(F.date_sub(d, 7), "THU")


def age_bucket(days: Column) -> Column:
    """`Nd` up to 6 days (1 at least), `Nw` up to 27, `Nm` up to 89, then `3plus`."""
    day = F.floor(days)
    return F.when(day <= 6, F.concat(F.greatest(F.lit(1), day).cast("string"), F.lit("d"))).when(day <= 27, F.concat(F.floor(day / 7).cast("string"), F.lit("w"))).when(day <= 89, F.concat(F.floor(day / 30).cast("string"), F.lit("m"))).otherwise("3plus")


def decay(seen: Column, as_of: Column, days: int = 30) -> Column:
    return F.exp(-(F.unix_micros(as_of) - F.unix_micros(seen)) / F.lit(1e6 * 86400 * days))


def money(c: Column) -> Column:
    return F.format_string("%.2f", c)


def volume_text(ml: Column) -> Column:
    """1 L, 1.5 L, 500 ml."""
    return F.when(ml >= 1000, F.concat(F.regexp_replace((ml / 1000).cast("string"), r"\.0$", ""), F.lit(" L"))).otherwise(F.concat(ml.cast("int").cast("string"), F.lit(" ml")))


def short_date(c: Column, pattern: str = "d. MMM") -> Column:
    """A text's date in a short form; what is no date gives its first ten characters."""
    day = F.try_to_date(F.left(c, F.lit(10)), "yyyy-MM-dd")
    return F.coalesce(F.date_format(day, pattern), F.left(c, F.lit(10)))
