"""Registered queries of the promotion operators, each with the SQL that DuckDB answers alike where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, text, units
from ..functions import values as V
from ..functions.group_rules import GROUP_RULES
from ..operators import compare, ingest, read, resolve, store, suggest, verdict
from ..operators.ranks import ranked
from ..sources import cards, feeds
from .star import AS_OF, DEALS, INTERESTS, NOW, WEEK, deals, interests, store_of, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SLIM = ("deal_id", "store", "product_name", "category", "discount_percent")
ACTIVE = f"live AS (SELECT * FROM deals WHERE is_active AND valid_to >= DATE '{AS_OF}')"
SHORT = "CASE category WHEN 'long-life' THEN 'longlife' WHEN 'non-food' THEN 'household' ELSE category END"
STORE_ROWS = "(VALUES ('migros'), ('coop'), ('lidl'), ('aldi'), ('denner'), ('spar'), ('volg')) s(store)"
CATEGORY_ROWS = "(VALUES ('fresh'), ('long-life'), ('non-food')) c(category)"


def register(sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {', '.join(ctes)} {sql}" if ctes else sql
        return f

    return keep


def r6(c):
    return units.half_up(c * 1e6) / 1e6


def live(s: SparkSession, d: str) -> DataFrame:
    return read.active(deals(s, d), AS_OF)


# --- verdicts


@register(
    f"""SELECT c.category, CASE WHEN n IS NULL THEN 'no-data' WHEN stores = 1 THEN 'single-store' WHEN best_n < 5 OR a1 - a2 < 2 THEN 'tied' ELSE 'winner' END AS state,
    CASE WHEN stores > 1 AND NOT (best_n < 5 OR a1 - a2 < 2) THEN best END AS winner, coalesce(floor(round(total / n, 9) * 100 + 0.5) / 100, 0.0) AS avg_discount, coalesce(n, 0)::BIGINT AS n
    FROM {CATEGORY_ROWS} LEFT JOIN (SELECT category, count(*) stores, sum(n) n, sum(a * n) total, max(CASE WHEN p = 1 THEN store END) best, max(CASE WHEN p = 1 THEN n END) best_n, max(CASE WHEN p = 1 THEN a END) a1, max(CASE WHEN p = 2 THEN a END) a2
      FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY a DESC, n DESC, store) p FROM (SELECT category, store, avg(discount_percent) a, count(*) n FROM live GROUP BY ALL)) GROUP BY category) v ON v.category = c.category""",
    DEALS, ACTIVE,
)
def a3_category_verdicts(s, d):
    return verdict.verdicts(live(s, d), V.CATEGORIES)


@register("SELECT sub_category, store, floor(a * 1e6 + 0.5) / 1e6 AS avg_discount, n, row_number() OVER (PARTITION BY sub_category ORDER BY a DESC, n DESC, store)::INT AS place FROM (SELECT sub_category, store, avg(discount_percent) a, count(*) n FROM live GROUP BY ALL)", DEALS, ACTIVE)
def a1_store_scores(s, d):
    return verdict.store_scores(live(s, d), "sub_category").withColumn("avg_discount", r6(F.col("avg_discount")))


WEIGHTED = """scores AS (SELECT *, floor(100 * (0.4 * CASE WHEN max(n) OVER w > 0 THEN n / max(n) OVER w ELSE 0.0 END + 0.6 * CASE WHEN max(a) OVER w > 0 THEN a / max(a) OVER w ELSE 0.0 END) + 0.5)::BIGINT AS score
  FROM (SELECT category, store, count(*) n, floor(avg(coalesce(discount_percent, 0)) + 0.5)::BIGINT a FROM live GROUP BY ALL HAVING count(*) >= 3) WINDOW w AS (PARTITION BY category))"""


@register("SELECT category, store, n, a AS avg_discount, score FROM scores", DEALS, ACTIVE, WEIGHTED)
def a5_weighted_scores(s, d):
    return verdict.weighted_scores(live(s, d))


@register(
    f"""SELECT c.category, CASE WHEN coalesce(stores, 0) < 2 OR s1 = 0 OR (s1 - s2) / s1 <= 0.05 THEN 'tie' ELSE 'winner' END AS state, CASE WHEN NOT (coalesce(stores, 0) < 2 OR s1 = 0 OR (s1 - s2) / s1 <= 0.05) THEN best END AS winner, CASE WHEN stores >= 2 THEN s1 END AS score
    FROM {CATEGORY_ROWS} LEFT JOIN (SELECT category, count(*) stores, max(CASE WHEN p = 1 THEN store END) best, max(CASE WHEN p = 1 THEN score END) s1, max(CASE WHEN p = 2 THEN score END) s2
      FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, store) p FROM scores) GROUP BY category) v ON v.category = c.category""",
    DEALS, ACTIVE, WEIGHTED,
)
def a6_weighted_verdicts(s, d):
    return verdict.weighted_verdicts(live(s, d), V.CATEGORIES)


@register("SELECT count(DISTINCT store) AS stores, CASE WHEN count(DISTINCT store) = 0 THEN 'stale' WHEN count(DISTINCT store) < 7 THEN 'partial' ELSE 'current' END AS freshness FROM live", DEALS, ACTIVE)
def a7_freshness(s, d):
    return verdict.freshness(live(s, d))


@register("SELECT store, floor(avg(a) * 1e6 + 0.5) / 1e6 AS avg_of_categories, count(*) AS categories FROM (SELECT category, store, avg(discount_percent) a FROM deals GROUP BY ALL) GROUP BY store", DEALS)
def a35_banner_average(s, d):
    return verdict.banner(deals(s, d)).withColumn("avg_of_categories", r6(F.col("avg_of_categories")))


# --- read side


@register(f"SELECT deal_id, store, product_name, {SHORT} AS category, discount_percent FROM live ORDER BY discount_percent DESC, deal_id LIMIT 10000", DEALS, ACTIVE)
def f6_snapshot(s, d):
    return read.snapshot(deals(s, d), AS_OF).select(*SLIM)


@register(f"SELECT deal_id, store, product_name, category, discount_percent FROM deals WHERE is_active AND (valid_to IS NULL OR valid_to >= DATE '{AS_OF}')", DEALS)
def f7_active_open_ended(s, d):
    return read.active(deals(s, d), AS_OF, keep_open=True).select(*SLIM)


@register(f"SELECT store, category, count(*) AS n, sum(discount_percent)::BIGINT AS points FROM deals WHERE valid_from <= DATE '{WEEK}' AND (valid_to IS NULL OR valid_to >= DATE '{WEEK}') GROUP BY ALL", DEALS)
def f8_week(s, d):
    return read.valid_on(deals(s, d), WEEK).groupBy("store", "category").agg(F.count("*").alias("n"), F.sum("discount_percent").alias("points"))


@register("SELECT store, count(*) AS n, min(sale_price) AS low FROM deals WHERE sub_category IN ('bolt', 'gear') GROUP BY store", DEALS)
def f9_by_sub_categories(s, d):
    return deals(s, d).filter(F.col("sub_category").isin("bolt", "gear")).groupBy("store").agg(F.count("*").alias("n"), F.min("sale_price").alias("low"))


@register("SELECT deal_id, store, product_name, category, discount_percent FROM deals WHERE contains(lower(product_name), 'widget 6x') ORDER BY discount_percent DESC, deal_id LIMIT 50", DEALS)
def f10_search(s, d):
    return read.search(deals(s, d), "  Widget 6x").select(*SLIM)


@register("SELECT deal_id, store, product_name, category, discount_percent FROM deals WHERE store = 'coop' AND contains(lower(product_name), 'gear') ORDER BY discount_percent DESC, deal_id LIMIT 1", DEALS)
def f11_best_deal_of_store(s, d):
    return read.search(deals(s, d), "gear", 1, "coop").select(*SLIM)


CHOICE = read.Filters.parse("type=fresh&stores=migros,coop,nowhere&q=%20BOLT")


@register("SELECT deal_id, store, product_name, category, discount_percent FROM deals WHERE category = 'fresh' AND store IN ('migros', 'coop') AND contains(lower(product_name), 'bolt')", DEALS)
def f12_filtered(s, d):
    return read.filtered(deals(s, d), CHOICE).select(*SLIM)


@register("SELECT store, count(*) AS n FROM deals WHERE category = 'fresh' AND contains(lower(product_name), 'bolt') GROUP BY store", DEALS)
def a11_store_counts(s, d):
    return read.store_counts(deals(s, d), CHOICE)


@register("SELECT trim(category_slug) AS key, count(*) FILTER (WHERE store IN ('migros', 'coop') AND contains(lower(product_name), 'bolt')) AS n FROM deals WHERE category = 'fresh' AND trim(coalesce(category_slug, '')) <> '' GROUP BY 1", DEALS)
def a12_category_counts(s, d):
    return read.category_counts(deals(s, d), CHOICE)


@register("SELECT trim(sub_category) AS key, count(*) FILTER (WHERE store IN ('migros', 'coop') AND contains(lower(product_name), 'bolt')) AS n FROM deals WHERE category = 'fresh' AND trim(coalesce(sub_category, '')) <> '' GROUP BY 1", DEALS)
def a13_sub_category_counts(s, d):
    return read.sub_category_counts(deals(s, d), CHOICE)


@register("SELECT count(*) AS n FROM deals WHERE category = 'fresh' AND store IN ('migros', 'coop') AND contains(lower(product_name), 'bolt')", DEALS)
def a14_count_matches(s, d):
    return read.filtered(deals(s, d), CHOICE).agg(F.count("*").alias("n"))


@register(
    """SELECT * FROM (SELECT section, deal_id, discount_percent, row_number() OVER (PARTITION BY section ORDER BY discount_percent DESC, deal_id)::INT AS place, count(*) OVER (PARTITION BY section) AS size
    FROM (SELECT *, CASE WHEN trim(coalesce(sub_category, '')) = '' THEN 'Other' ELSE trim(sub_category) END AS section FROM deals)) WHERE place <= 5""",
    DEALS,
)
def a15_sections(s, d):
    return read.sections(deals(s, d), 4).select("section", "deal_id", "discount_percent", "place", "size")


@register(f"SELECT s.store, coalesce(n, 0)::BIGINT AS n, u AS updated_at FROM {STORE_ROWS} LEFT JOIN (SELECT store, count(*) n, max(updated_at) u FROM live GROUP BY store) t ON t.store = s.store UNION ALL SELECT '*', count(*), max(updated_at) FROM live", DEALS, ACTIVE)
def a16_totals(s, d):
    return read.totals(live(s, d))


@register("SELECT category, count(*) AS n FROM deals GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM deals", DEALS)
def a17_type_counts(s, d):
    return read.type_counts(deals(s, d))


@register("SELECT store, count(*) AS n, floor(sum(sale_price) * 100 + 0.5) / 100 AS total FROM live GROUP BY store", DEALS, ACTIVE)
def a18_share_totals(s, d):
    items = live(s, d).select("store", F.col("sale_price").alias("price"))
    return read.share_totals(items).withColumn("total", units.cents(F.col("total")))


@register("SELECT list_id, (row_number() OVER (PARTITION BY list_id ORDER BY deal_id DESC) - 1)::INT AS pos, deal_id, store FROM (SELECT supplier_id AS list_id, * FROM live)", DEALS, ACTIVE)
def j9_rehydrate(s, d):
    al = live(s, d)
    lists = al.groupBy(F.col("supplier_id").alias("list_id")).agg(F.concat(F.reverse(F.array_sort(F.collect_list("deal_id"))), F.array(F.lit("unknown"))).alias("ids"))
    return read.rehydrate(lists, al).select("list_id", "pos", "deal_id", "store")


@register("SELECT category, count(*) AS n FROM deals WHERE sub_category IS NULL OR sub_category NOT IN ('bolt', 'gear', 'ring') GROUP BY category", DEALS)
def f25_other(s, d):
    browse = read.dimension(deals(s, d), "sub_category", ("bolt", "gear", "ring"))
    return read.other_than(deals(s, d), browse).groupBy("category").agg(F.count("*").alias("n"))


@register("SELECT store, count(*) AS n FROM deals WHERE store IN (SELECT (['migros','coop','lidl','aldi','denner','spar','volg'])[(s_suppkey % 7 + 1)::INT] FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1) GROUP BY store", DEALS)
def f21_covered_stores(s, d):
    regions = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(store_of(F.col("s_suppkey")).alias("store")).agg(F.collect_set(F.col("n_regionkey").cast("string")).alias("cantons"))
    return deals(s, d).join(read.covered_stores(regions, "1"), "store", "left_semi").groupBy("store").agg(F.count("*").alias("n"))


@register(f"SELECT store, count(*) FILTER (WHERE TIMESTAMP '{AS_OF}' - updated_at > INTERVAL 9 DAY) AS stale, count(*) AS n FROM deals GROUP BY store", DEALS)
def f27_stale(s, d):
    old = read.stale(F.col("updated_at").cast("timestamp"), F.lit(AS_OF).cast("timestamp"))
    return deals(s, d).groupBy("store").agg(F.count_if(old).alias("stale"), F.count("*").alias("n"))


@register("SELECT deal_id, store, row_number() OVER (PARTITION BY store ORDER BY price_per_unit NULLS LAST, deal_id)AS by_unit, row_number() OVER (PARTITION BY store ORDER BY discount_percent DESC, deal_id)AS by_discount, row_number() OVER (PARTITION BY store ORDER BY sale_price, deal_id)AS by_price FROM (SELECT *, CASE WHEN line % 3 < 2 THEN floor(sale_price) END AS price_per_unit FROM deals)", DEALS)
def o4_sorted_deals(s, d):
    al = deals(s, d).withColumn("price_per_unit", F.when(F.col("line") % 3 < 2, F.floor("sale_price")))
    # ids as bytes: in the order of their digits, and half as long in three sorts
    slim = al.select(F.unhex("deal_id").alias("deal_id"), "store", "price_per_unit", "discount_percent", "sale_price")
    for by, out, used in (("unit_price", "by_unit", "price_per_unit"), ("discount", "by_discount", "discount_percent"), ("price", "by_price", "sale_price")):
        slim = ranked(slim, *read.sort_keys(by), out=out, within="store").drop(used)
    return slim.select(F.lower(F.hex("deal_id")).alias("deal_id"), "store", "by_unit", "by_discount", "by_price")


@register(
    f"""SELECT concept_id, store, state, price, row_number() OVER (PARTITION BY concept_id ORDER BY state, CASE WHEN state = 'A' THEN price END NULLS LAST, last_seen DESC NULLS LAST, store)::INT AS place
    FROM (SELECT c.concept_id, s.store, a.price, b.last_seen, CASE WHEN a.price IS NOT NULL THEN 'A' WHEN b.last_seen IS NOT NULL THEN 'B' ELSE 'C' END AS state
      FROM (SELECT DISTINCT p_partkey AS concept_id FROM part) c CROSS JOIN {STORE_ROWS}
      LEFT JOIN (SELECT concept_id, store, min(sale_price) price FROM live GROUP BY ALL) a ON a.concept_id = c.concept_id AND a.store = s.store
      LEFT JOIN (SELECT concept_id, store, max(updated_at) last_seen FROM deals GROUP BY ALL) b ON b.concept_id = c.concept_id AND b.store = s.store)""",
    DEALS, ACTIVE,
)
def o5_availability(s, d):
    al = deals(s, d)
    concepts = table(s, d, "part").select(F.col("p_partkey").alias("concept_id"))
    return read.availability(concepts, resolve.skus(al), al, AS_OF).select("concept_id", "store", "state", "price", "place")


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
def o12_latest(s, d):
    return table(s, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(1).select("o_orderkey", "o_totalprice")


# --- names, quantities, dates


@register(
    r"""SELECT product_name, regexp_replace(regexp_replace(trim(regexp_replace(lower(product_name), '\s+', ' ', 'g')), '(\d+)\s*x\s*(\d)', '\1x\2', 'g'), '(\d)\s*(ml|cl|dl|l|g|kg)\b', '\1\2', 'g') AS feed,
    trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(product_name), '\s+', ' ', 'g')), '\b(liter|litre)\b', 'l', 'g'), '(\d)gr\b', '\1g', 'g'), '\b(stk|pcs)\b', 'stück', 'g')) AS stored,
    regexp_matches(lower(product_name), '\b(bio|naturaplan|demeter|knospe|organic)\b') AS organic FROM (SELECT DISTINCT product_name FROM deals)""",
    DEALS,
)
def st1_names(s, d):
    n = deals(s, d).select("product_name").distinct()
    return n.select("product_name", text.feed_name(F.col("product_name")).alias("feed"), text.stored_name(F.col("product_name")).alias("stored"), text.organic(F.col("product_name")).alias("organic"))


@register(
    r"""SELECT doc_id, left(regexp_replace(regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 200) AS slug FROM documents"""
)
def st5_slug(s, d):
    return table(s, d, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@register(
    """SELECT n_name, array_to_string(list_transform(list_filter(regexp_split_to_array(lower(n_name), '[-\\s]+'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') AS title,
    array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS words FROM nation""".replace("\\\\", "\\")
)
def st6_titles(s, d):
    return table(s, d, "nation").select("n_name", text.title_case(F.lower("n_name")).alias("title"), text.capitalise_words(F.col("n_name")).alias("words"))


KEYWORDS = ("bolt", "red", "gear", "small ring", "6x", "old", "widget")
def relevance_sql(*keywords: str) -> str:
    return r"""rel AS (SELECT *, CASE WHEN len(list_filter(ws, lambda w: starts_with(w, kw) AND list_contains(changing, substr(w, length(kw) + 1)))) > 0 THEN 0
    WHEN starts_with(w1, kw) OR ends_with(w1, kw) THEN 4 WHEN (starts_with(w2, kw) OR ends_with(w2, kw)) AND list_contains(qualifiers, w1) THEN 4
    WHEN regexp_matches(name, '(^|\s)' || kw || '(\s|\d|$)') THEN 3 WHEN regexp_matches(name, kw || '([\s\d,.)·;!?]|$)') THEN 2
    WHEN len(list_filter(ws, lambda w: starts_with(w, kw) AND length(w) > length(kw))) > 0 THEN 2 WHEN contains(name, kw) THEN 1 ELSE 0 END AS relevance
  FROM (SELECT *, coalesce(ws[1], '') AS w1, coalesce(ws[2], '') AS w2 FROM (SELECT k.kw, product_name, lower(product_name) AS name, list_filter(regexp_split_to_array(lower(product_name), '[\s·,]+'), lambda w: w <> '') AS ws,
    [{changing}] AS changing, [{qualifiers}] AS qualifiers FROM (SELECT DISTINCT product_name FROM deals), (VALUES {kws}) k(kw))))""".format(
        changing=", ".join(f"'{w}'" for w in V.FORM_CHANGING), qualifiers=", ".join(f"'{w}'" for w in V.QUALIFIERS), kws=", ".join(f"('{k}')" for k in keywords)
    )


RELEVANCE_SQL = relevance_sql(*KEYWORDS)


def basket(df: DataFrame) -> DataFrame:
    """Items: each keyword once; `bolt` excludes red ones and prefers small ones."""
    k = F.col("keyword")
    none = F.lit(None).cast("array<string>")
    items = read.dimension(df, "keyword", KEYWORDS)
    return items.select(
        k.alias("item_id"), "keyword", F.when(k == "bolt", F.array(F.lit("RED"))).otherwise(none).alias("exclude"), F.when(k == "bolt", F.array(F.lit("Small"))).otherwise(none).alias("prefer"), F.when(k == "gear", "gear").alias("product_group_id")
    )


@register("SELECT kw AS keyword, product_name, relevance::INT AS relevance FROM rel", DEALS, RELEVANCE_SQL)
def st8_relevance(s, d):
    names = deals(s, d).select("product_name").distinct()
    pairs = names.select("product_name", F.explode(F.array(*(F.lit(k) for k in KEYWORDS))).alias("keyword"))
    return pairs.select("keyword", "product_name", text.relevance(F.col("keyword"), F.col("product_name")).alias("relevance"))


@register(
    """SELECT item_id, store, deal_id, relevance::INT AS relevance FROM (SELECT kw AS item_id, d.store, d.deal_id, r.relevance, row_number() OVER (PARTITION BY kw, d.store
      ORDER BY (kw = 'bolt' AND contains(name, 'small')) DESC, relevance + (relevance >= 3 AND len(ws) <= 4)::INT DESC, discount_percent DESC, deal_id) p
    FROM rel r JOIN deals d USING (product_name) WHERE relevance >= 2 AND discount_percent > 0 AND NOT (kw = 'bolt' AND contains(name, 'red'))) WHERE p = 1""",
    DEALS, RELEVANCE_SQL,
)
def st11_best_matches(s, d):
    al = deals(s, d)
    return compare.best_matches(basket(al), al).select("item_id", "store", "deal_id", "relevance")


@register(
    r"""SELECT product_name, CASE WHEN regexp_matches(n, '(\d+)\s*x\s*(\d+)\s*cl') THEN CASE WHEN m >= 1000 THEN m / 1000 ELSE m END WHEN regexp_matches(n, '(\d+)\s*g\b') THEN regexp_extract(n, '(\d+)\s*g\b', 1)::DOUBLE ELSE regexp_extract(n, '(\d+)\s*pcs', 1)::DOUBLE END AS quantity,
    CASE WHEN regexp_matches(n, '(\d+)\s*x\s*(\d+)\s*cl') THEN CASE WHEN m >= 1000 THEN 'l' ELSE 'ml' END WHEN regexp_matches(n, '(\d+)\s*g\b') THEN 'g' ELSE 'pcs' END AS unit
    FROM (SELECT product_name, lower(product_name) n, TRY_CAST(regexp_extract(lower(product_name), '(\d+)x(\d+)cl', 1) AS DOUBLE) * TRY_CAST(regexp_extract(lower(product_name), '(\d+)x(\d+)cl', 2) AS DOUBLE) * 10 AS m FROM (SELECT DISTINCT product_name FROM deals))""",
    DEALS,
)
def n7_name_quantity(s, d):
    q = units.name_quantity(F.col("product_name"))
    return deals(s, d).select("product_name").distinct().select("product_name", q["quantity"].alias("quantity"), q["unit"].alias("unit"))


@register(
    """SELECT deal_id, CASE WHEN line % 3 = 0 THEN 1 WHEN line % 3 = 1 THEN 6 END AS pack_size, CASE line % 3 WHEN 0 THEN 'kg' WHEN 1 THEN 'L' END AS canonical_unit,
    CASE line % 3 WHEN 0 THEN k / 1000.0 WHEN 1 THEN (k * 10.0 * 6) / 1000.0 END AS canonical_unit_value,
    floor(sale_price / CASE line % 3 WHEN 0 THEN k / 1000.0 WHEN 1 THEN (k * 10.0 * 6) / 1000.0 END * 100 + 0.5) / 100 AS price_per_unit
    FROM (SELECT *, CASE line % 3 WHEN 1 THEN regexp_extract(product_name, '6x(\\d+)cl', 1) ELSE regexp_extract(product_name, '(\\d+)(g| pcs)$', 1) END::DOUBLE AS k FROM deals)""".replace("\\\\", "\\"),
    DEALS,
)
def n10_unit_price(s, d):
    out = ingest.with_unit_price(deals(s, d), "product_name", "sale_price", "sub_category")
    return out.select("deal_id", "pack_size", "canonical_unit", "canonical_unit_value", "price_per_unit")


@register(
    r"""SELECT o_orderkey, o_totalprice AS amount, floor(o_totalprice)::DOUBLE AS whole, (o_orderkey % 90 + 5)::INT AS percent, (o_orderkey % 97 + 1)::DOUBLE AS quantity, 'g' AS unit, (o_orderkey % 9 + 1) / 100.0 AS unit_amount FROM orders"""
)
def n1_parsed_prices(s, d):
    o = table(s, d, "orders")
    text_price = F.concat(F.lit("CHF "), F.format_string("%.2f", F.col("o_totalprice")))
    whole = F.concat(F.floor("o_totalprice").cast("string"), F.lit(".–"))
    pct = F.concat(F.lit("bis "), (F.col("o_orderkey") % 90 + 5).cast("string"), F.lit(" % Rabatt"))
    desc = F.concat((F.col("o_orderkey") % 97 + 1).cast("string"), F.lit(" G, 100 g = -.0"), (F.col("o_orderkey") % 9 + 1).cast("string"))
    q, u = units.described_quantity(desc), units.described_unit_price(desc)
    return o.select("o_orderkey", units.price(text_price).alias("amount"), units.price(whole).alias("whole"), units.percent(pct).alias("percent"), q["quantity"].alias("quantity"), q["unit"].alias("unit"), u["amount"].alias("unit_amount"))


@register("SELECT deal_id, CASE WHEN original_price > 0 AND sale_price > 0 AND sale_price < original_price THEN round_even((original_price - sale_price) / original_price * 100, 0)::INT END AS feed, coalesce(floor((original_price - sale_price) / original_price * 100 + 0.5), 0)::BIGINT AS filled FROM deals", DEALS)
def n3_discounts(s, d):
    o, p = F.col("original_price"), F.col("sale_price")
    return deals(s, d).select("deal_id", units.feed_discount(o, p).alias("feed"), units.filled_discount(F.lit(None).cast("double"), o, p).alias("filled"))


@register(
    """SELECT o_orderkey, d AS valid_from, d + 9 AS valid_to, d AS said_from, d + 9 AS said_to, (d - ((isodow(d) + 3) % 7)::INT) AS thursday,
    CASE WHEN o_orderkey % 120 <= 6 THEN greatest(1, o_orderkey % 120)::VARCHAR || 'd' WHEN o_orderkey % 120 <= 27 THEN (o_orderkey % 120 // 7)::VARCHAR || 'w' WHEN o_orderkey % 120 <= 89 THEN (o_orderkey % 120 // 30)::VARCHAR || 'm' ELSE '3plus' END AS age
    FROM (SELECT o_orderkey, o_orderdate::DATE d FROM orders)"""
)
def dt1_dates(s, d):
    day = F.col("o_orderdate").cast("date")
    end = F.date_add(day, 9)
    o = table(s, d, "orders").select("o_orderkey", day.alias("d"), F.concat(F.date_format(day, "dd.MM.yyyy"), F.lit(" - "), F.date_format(end, "dd.MM.yyyy")).alias("range"), F.concat(F.lit("Angebot gilt vom "), F.date_format(day, "d.M."), F.lit(" bis "), F.date_format(end, "d.M.yyyy")).alias("said"))
    a, b = units.date_range(F.col("range")), units.described_range(F.col("said"))
    return o.select("o_orderkey", a["a"].alias("valid_from"), a["b"].alias("valid_to"), b["a"].alias("said_from"), b["b"].alias("said_to"), units.last_thursday(F.col("d")).alias("thursday"), units.age_bucket(F.col("o_orderkey") % 120).alias("age"))


@register("SELECT event_id, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Zurich')::DATE AS day FROM events")
def dt4_zurich_day(s, d):
    return table(s, d, "events").select("event_id", units.zurich_day(F.col("ts").cast("timestamp")).alias("day"))


@register("SELECT event_id, string_split('a,b c,' || event_id, ',') AS ids, 'a,b%20c,' || event_id AS link FROM events")
def st14_share_links(s, d):
    e = table(s, d, "events").select("event_id", F.array(F.lit("a"), F.lit("b c"), F.col("event_id").cast("string")).alias("ids"))
    return e.select("event_id", text.decode_list(text.encode_list(F.col("ids"))).alias("ids"), text.encode_list(F.col("ids")).alias("link"))


# --- classification

SAMPLES = ("Lindt Lindor", "Vollmilch", "Poulet Brust", "Schweinesteak", "Emmi Joghurt", "Gala 3-Eier Hörnli", "Nestea-Bar Nestea", "Bärlauch Schnitzel", "Meridol Mundspülung Zahnfleisch", "Pilze", "Reis", "Preiselbeer", "Risotto Tomaten", "Parkside Performance Bohrer", "Crivit", "Papier", "Bier 6x33cl", "Tee", "Olivenöl", "Unbekannt")
#: A small table of keyword rules for these names; the real one is the user's (sources.rules).
DEMO_RULES = (
    ("fresh", "dairy", ("milch", "joghurt")), ("fresh", "poultry", ("poulet",)), ("fresh", "meat", ("steak", "schnitzel", "fleisch")), ("fresh", "vegetables", ("pilze", "tomaten", "lauch")), ("long-life", "pasta-rice", ("reis", "risotto", "hörnli")),
    ("long-life", "beer", ("bier",)), ("long-life", "wine", ("wein",)), ("long-life", "tea", ("tee", "tea")), ("long-life", "condiments", ("olivenöl",)), ("non-food", "personal-care", ("mundspülung", "zahnpasta")), ("non-food", "paper-goods", ("papier",)), ("non-food", "tools", ("gear", "bolt")),
)
LABELS = ("", "Baby", "Softdrinks", "Werkzeug", "Garten & Auto", "Waschen & Putzen")


def labelled(s: SparkSession, d: str) -> DataFrame:
    pick = lambda xs, k: F.element_at(F.array(*(F.lit(x) for x in xs)), (k + 1).cast("int"))
    p = F.col("p_partkey")
    return table(s, d, "part").select("p_partkey", F.concat(pick(SAMPLES, p % len(SAMPLES)), F.lit(" "), "p_name").alias("name"), F.nullif(pick(LABELS, p % len(LABELS)), F.lit("")).alias("label"))


def quoted(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def sql_whole(t: str, term: str) -> str:
    q, n = term.replace("'", "''"), len(term)
    letter = f"[{V.LETTERS}]"
    return f"(instr({t}, '{q}') > 0 AND NOT (instr({t}, '{q}') > 1 AND regexp_matches(substr({t}, instr({t}, '{q}') - 1, 1), '{letter}')) AND NOT regexp_matches(substr({t}, instr({t}, '{q}') + {n}, 1), '{letter}'))"


def sql_keyword(kw: str) -> str:
    hit = sql_whole("low", kw) if kw in V.WHOLE_WORDS else f"contains(low, '{kw}')"
    return " AND ".join([hit, *(f"NOT contains(low, '{b}')" for b in V.BLOCKERS.get(kw, ()))])


LABELLED = f"""labelled AS (SELECT *, lower(name) AS low, lower(label) AS lab FROM (SELECT p_partkey, ([{quoted(SAMPLES)}])[(p_partkey % {len(SAMPLES)} + 1)::INT] || ' ' || p_name AS name, nullif(([{quoted(LABELS)}])[(p_partkey % {len(LABELS)} + 1)::INT], '') AS label FROM part))"""


def sql_cases() -> str:
    cases = [(sql_whole("low", b), *V.BRANDS[b], "brand") for b in classify.longest_first(V.BRANDS)]
    cases += [(f"lab = '{k}'", *v, "source") for k, v in V.SOURCE_LABELS.items()]
    cases += [(" OR ".join(f"({sql_keyword(k)})" for k in kws), c, sub, "keyword") for c, sub, kws in DEMO_RULES]
    body = " ".join(f"WHEN {cond} THEN '{c}|{sub}|{tier}'" for cond, c, sub, tier in cases)
    return f"CASE {body} ELSE '{V.DEFAULT_CATEGORY}||fallback' END"


@register(f"SELECT p_partkey, string_split(x, '|')[1] AS category, nullif(string_split(x, '|')[2], '') AS sub_category, string_split(x, '|')[3] AS tier, CASE string_split(x, '|')[3] WHEN 'brand' THEN 0.95 WHEN 'source' THEN 0.85 WHEN 'keyword' THEN 0.7 ELSE 0.3 END::DOUBLE AS confidence FROM (SELECT p_partkey, {sql_cases()} AS x FROM labelled)", LABELLED)
def cl4_categorise(s, d):
    return ingest.categorised(labelled(s, d), "name", "label", DEMO_RULES).select("p_partkey", "category", "sub_category", "tier", "confidence")


def sql_grocery() -> str:
    cases = [(sql_whole("low", b), f"brand-blocklist:{b}") for b in classify.longest_first(V.NON_GROCERY_BRANDS)] + [(f"contains(lab, '{k}')", f"source-category-denylist:{k}") for k in V.NON_GROCERY_SOURCES]
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in cases) + " END"


@register(f"SELECT reason, count(*) AS n FROM (SELECT {sql_grocery()} AS reason FROM labelled) WHERE reason IS NOT NULL GROUP BY reason ORDER BY n DESC, reason LIMIT 5", LABELLED)
def f4_rejections(s, d):
    return ingest.rejections(ingest.filter_grocery(labelled(s, d), "name", "label"))


@register(f"SELECT p_partkey, reason IS NULL AS keep FROM (SELECT p_partkey, {sql_grocery()} AS reason FROM labelled)", LABELLED)
def f3_grocery(s, d):
    return ingest.filter_grocery(labelled(s, d), "name", "label").select("p_partkey", F.col("grocery.keep").alias("keep"))


def sql_lists(rules, default: str | None = None) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(low, {quoted([k])})''' for k in kws)} THEN '{v}'" for v, kws in rules) + (f" ELSE '{default}' END" if default else " END")


@register(f"SELECT p_partkey, {sql_lists(V.FORMS, 'raw')} AS form, {sql_lists(V.CUTS)} AS cut, {sql_lists(V.FORMATS)} AS format, {sql_lists(V.CONTAINERS)} AS container FROM labelled", LABELLED)
def cl9_forms(s, d):
    n = F.col("name")
    return labelled(s, d).select("p_partkey", units.product_form(n).alias("form"), units.meat_cut(n).alias("cut"), units.format_of(n).alias("format"), units.container_of(n).alias("container"))


def sql_any_sub() -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(low, '{k}') OR contains(coalesce(lab, ''), '{k}')''' for k in kws)} THEN '{sub}'" for _, sub, kws in DEMO_RULES) + " END"


@register(f"SELECT p_partkey, {sql_any_sub()} AS sub_category FROM labelled", LABELLED)
def cl8_any_sub_category(s, d):
    out = classify.over_distinct(labelled(s, d), ["name", "label"], "sub_category", lambda n, c: classify.any_sub_category(n, c, DEMO_RULES))
    return out.select("p_partkey", "sub_category")


GROUP_NAMES = ("Bio Vollmilch", "Hafermilch Drink", "Schokolade Milch", "Butter", "Käse", "Rispentomaten", "Tomatenpüree", "Kartoffel Gratin", "Pommes Frites", "Poulet Flügeli", "Pouletbrust", "Rotwein, Rioja", "Steinofen-Pizza", "Erdbeeren", "Erdbeeren Joghurt", "Müller-Thurgau", "Reis Milch", "WC-Papier", "Eier Nudeln", "Hackfleisch Burger")


def sql_groups() -> str:
    hit = lambda p: f"regexp_matches(n, {quoted([p])})"
    return "CASE " + " ".join("WHEN " + " AND ".join([*map(hit, must), *(f"NOT {hit(p)}" for p in never)]) + f" THEN '{g}|{form}'" for g, form, must, never in GROUP_RULES) + " END"


@register(f"SELECT p_partkey, split_part(x, '|', 1) AS product_group, split_part(x, '|', 2) AS product_form FROM (SELECT p_partkey, {sql_groups()} AS x FROM (SELECT p_partkey, lower(([{quoted(GROUP_NAMES)}])[(p_partkey % {len(GROUP_NAMES)} + 1)::INT] || ' ' || p_name) n FROM part))")
def cl7_product_group(s, d):
    pick = F.element_at(F.array(*(F.lit(x) for x in GROUP_NAMES)), (F.col("p_partkey") % len(GROUP_NAMES) + 1).cast("int"))
    named = table(s, d, "part").select("p_partkey", F.concat(pick, F.lit(" "), "p_name").alias("name"))
    return classify.over_distinct(named, ["name"], "g", classify.group_of).select("p_partkey", F.col("g.group").alias("product_group"), F.col("g.form").alias("product_form"))


RULES = "(VALUES ('r1', 'contains', 'BOLT', 11, 20, true), ('r2', 'exact', 'small ring 7 pcs', 12, 5, true), ('r3', 'regex', '^(red|hot) g', 13, 10, true), ('r4', 'multipack', 'widget', 14, 1, true), ('r5', 'brand', 'gear', NULL, 0, true), ('r6', 'contains', 'old', 16, 0, false)) r(id, rule_type, pattern, concept_id, priority, is_active)"


@register(
    f"""SELECT d.deal_id, rule_concept FROM deals d LEFT JOIN (SELECT product_name, min_by(concept_id, priority) AS rule_concept FROM (SELECT DISTINCT product_name FROM deals) n JOIN {RULES}
      ON is_active AND concept_id IS NOT NULL AND CASE rule_type WHEN 'exact' THEN lower(product_name) = lower(pattern) WHEN 'regex' THEN regexp_matches(product_name, '(?i)' || pattern) WHEN 'multipack' THEN contains(lower(product_name), lower(pattern)) AND regexp_matches(lower(product_name), '\\b\\d+\\s*[x×]\\s*\\d') ELSE contains(lower(product_name), lower(pattern)) END
      GROUP BY product_name) x ON x.product_name = d.product_name""".replace("\\\\", "\\"),
    DEALS,
)
def cl12_concept_rules(s, d):
    rules = s.sql(f"SELECT * FROM {RULES}")
    return resolve.resolve_concepts(deals(s, d), rules).select("deal_id", "rule_concept")


# --- ingest


def raw_rows(s: SparkSession, d: str) -> DataFrame:
    """Line items as raw feed rows, some of them broken in one way or other."""
    k = F.col("l_orderkey") % 11
    base = table(s, d, "lineitem")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return base.select(
        F.col("l_orderkey"), F.col("l_linenumber"), "l_partkey", F.when(k == 0, "nowhere").otherwise(store_of(F.col("l_suppkey"))).alias("store"), F.when(k == 1, "").otherwise("x").alias("productName"), F.when(k == 2, F.col("l_extendedprice") / 2).otherwise(F.col("l_extendedprice")).alias("originalPrice"),
        F.when(k == 3, 0.0).otherwise(F.col("l_extendedprice")).alias("salePrice"), F.when(k == 4, 101.0).when(k == 5, None).otherwise(F.col("l_discount") * 100).alias("discountPercent"), F.when(k == 6, "2024-02-31").otherwise(day).alias("validFrom"), F.when(k == 7, "1990-01-01").when(k == 8, None).otherwise(day).alias("validTo"),
    )


@register("SELECT l_orderkey % 11 AS kind, count(*) AS n, CASE WHEN l_orderkey % 11 IN (0, 1, 2, 3, 4, 6, 7) THEN 0 ELSE count(*) END AS valid FROM lineitem GROUP BY 1")
def f1_validation(s, d):
    return raw_rows(s, d).groupBy((F.col("l_orderkey") % 11).alias("kind")).agg(F.count("*").alias("n"), F.count_if(ingest.valid_entry()).alias("valid"))


@register("SELECT deal_id, store, p_name, discount_percent FROM (SELECT *, row_number() OVER (PARTITION BY store, p_name, date_trunc('month', valid_from) ORDER BY discount_percent DESC, deal_id) n FROM deals) WHERE n = 1", DEALS)
def a9_best_per_key(s, d):
    m = deals(s, d).withColumn("month", F.trunc("valid_from", "month"))
    return ingest.best_per_key(m, ["store", "p_name", "month"]).select("deal_id", "store", "p_name", "discount_percent")


@register("SELECT count(*) AS n, 0::BIGINT AS with_brand, count(*) AS with_quantity, 0::BIGINT AS organic FROM deals", DEALS)
def a27_metadata(s, d):
    return ingest.metadata_summary(deals(s, d))


@register(f"SELECT s.store, CASE WHEN n > 0 THEN 'success' ELSE 'failed' END AS status, coalesce(n, 0)::BIGINT AS n FROM {STORE_ROWS} LEFT JOIN (SELECT store, count(*) n FROM live WHERE store <> 'volg' GROUP BY store) t ON t.store = s.store", DEALS, ACTIVE)
def a28_store_status(s, d):
    return ingest.store_status(live(s, d).filter(F.col("store") != "volg"))


# --- keyed tables

TWO = "SELECT l_orderkey, l_linenumber, min(l_quantity) AS q, 'old' AS tag FROM lineitem WHERE l_orderkey % 3 < 2 GROUP BY ALL"
NEW = "SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, 'new' AS tag FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY ALL"


def two_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li = table(s, d, "lineitem")
    k = F.col("l_orderkey") % 3
    old = li.filter(k < 2).groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q")).withColumn("tag", F.lit("old"))
    return old, li.filter(k > 0).groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q")).withColumn("tag", F.lit("new"))


@register(f"SELECT coalesce(n.l_orderkey, o.l_orderkey) AS l_orderkey, coalesce(n.l_linenumber, o.l_linenumber) AS l_linenumber, coalesce(n.q, o.q) AS q, coalesce(n.tag, o.tag) AS tag FROM ({TWO}) o FULL JOIN ({NEW}) n ON n.l_orderkey = o.l_orderkey AND n.l_linenumber = o.l_linenumber")
def u1_upsert(s, d):
    return store.upsert(*two_tables(s, d), ["l_orderkey", "l_linenumber"])


@register(f"SELECT * FROM ({TWO}) UNION ALL SELECT * FROM ({NEW}) n WHERE NOT EXISTS (SELECT 1 FROM ({TWO}) o WHERE n.l_orderkey = o.l_orderkey AND n.l_linenumber = o.l_linenumber)")
def u2_insert_ignore(s, d):
    return store.insert_ignore(*two_tables(s, d), ["l_orderkey", "l_linenumber"])


@register(f"SELECT is_active AND NOT coalesce(valid_to < DATE '{AS_OF}', false) AS is_active, count(*) AS n FROM deals GROUP BY 1", DEALS)
def u4_expire(s, d):
    return store.expire(deals(s, d), f"{AS_OF} 12:00:00").groupBy("is_active").agg(F.count("*").alias("n"))


@register("SELECT store, count(*) AS n FROM deals WHERE is_active AND store IN ('migros', 'coop') AND updated_at < TIMESTAMP '2001-06-01' GROUP BY store", DEALS)
def u5_purge_stale(s, d):
    al = deals(s, d)
    after = store.purge_stale(al, ["migros", "coop"], "2001-06-01")
    return store.changed(al.select("deal_id", "is_active"), after, "deal_id", ["is_active"]).groupBy("store").agg(F.count("*").alias("n"))


@register("SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN ['x', 'y'] WHEN p_size % 2 = 0 THEN ['base'] END AS terms FROM part")
def u8_append_terms(s, d):
    p = table(s, d, "part").withColumn("terms", F.when((F.col("p_size") % 2 == 0) & ~F.col("p_name").contains("ring"), F.array(F.lit("base"))))
    return store.append_terms(p, "terms", ["x", "y"], F.col("p_name").contains("ring")).select("p_partkey", "terms")


@register("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' WHEN p_name LIKE '%bolt%' THEN 'bolt' WHEN p_name LIKE 'red%' THEN 'red' ELSE p_type END AS tag FROM part")
def u12_retag(s, d):
    n = F.col("p_name")
    p = table(s, d, "part").withColumn("tag", F.col("p_type"))
    return store.retag(p, "tag", [(n.startswith("red"), F.lit("red")), (n.contains("bolt"), F.lit("bolt")), (F.col("p_size") > 25, F.lit("large"))]).select("p_partkey", "tag")


@register("SELECT deal_id, coalesce(category_slug, (SELECT min(lower(p_brand)) FROM part q WHERE q.p_name = d.p_name)) AS category_slug FROM deals d", DEALS)
def j5_backfill(s, d):
    lookup = table(s, d, "part").groupBy("p_name").agg(F.min(F.lower("p_brand")).alias("category_slug"))
    return store.backfill(deals(s, d), lookup, ["p_name"], "category_slug").select("deal_id", "category_slug")


@register("SELECT store, p_name, deal_id, valid_from FROM (SELECT *, row_number() OVER (PARTITION BY store, p_name ORDER BY valid_from DESC, deal_id) n FROM deals WHERE is_active) WHERE n = 1", DEALS)
def j13_latest_offer(s, d):
    return store.latest(deals(s, d).filter("is_active"), ["store", "p_name"], "valid_from", "deal_id").select("store", "p_name", "deal_id", "valid_from")


# --- products, groups, concepts

KNOWN = "(SELECT DISTINCT store, product_name FROM deals WHERE category = 'fresh')"


@register(f"SELECT d.store, count(*) AS n, count(*) FILTER (WHERE k.store IS NULL) AS fresh_names FROM deals d LEFT JOIN {KNOWN} k ON k.store = d.store AND k.product_name = d.product_name GROUP BY 1", DEALS)
def j1_resolve_products(s, d):
    al = deals(s, d)
    known = al.filter("category = 'fresh'").select("store", F.col("product_name").alias("source_name")).distinct().withColumn("id", resolve.surrogate("store", "source_name"))
    return resolve.resolve_products(al, known).groupBy("store").agg(F.count("*").alias("n"), F.count_if("is_new").alias("fresh_names"))


ALIASES = "(VALUES ('BOLT', 'hardware', 'bolts'), ('gear', 'machines', NULL)) a(source_tag, category_slug, subcategory_slug)"


@register(f"SELECT alias_category, alias_sub_category, count(*) AS n FROM (SELECT a.category_slug AS alias_category, a.subcategory_slug AS alias_sub_category FROM deals d LEFT JOIN {ALIASES} ON lower(d.sub_category) = lower(a.source_tag)) GROUP BY ALL", DEALS)
def j3_alias_taxonomy(s, d):
    return resolve.alias_taxonomy(deals(s, d), s.sql(f"SELECT * FROM {ALIASES}")).groupBy("alias_category", "alias_sub_category").agg(F.count("*").alias("n"))


@register("SELECT lower(sub_category) AS tag, store, min_by(product_name, deal_id) AS product_name FROM deals WHERE sub_category IS NOT NULL AND lower(sub_category) NOT IN ('bolt', 'gear') GROUP BY ALL", DEALS)
def j4_unknown_tags(s, d):
    return resolve.unknown_tags(deals(s, d), s.sql(f"SELECT * FROM {ALIASES}"))


GROUPS = "(VALUES ('g1', array('bolt', 'small bolt'), array('red'), 'raw'), ('g2', array('ring', 'milch'), array('schoko.*', ''), 'raw'), ('g3', array('hot gear'), array('x'), 'frozen'), ('g4', array('voll', 'milchdrink', 'wein'), CAST(NULL AS array<string>), NULL)) g(group_id, include, exclude, product_form)"
GROUPS_SQL = "(VALUES ('g1', ['bolt', 'small bolt'], ['red'], 'raw'), ('g2', ['ring', 'milch'], ['schoko.*', ''], 'raw'), ('g3', ['hot gear'], ['x'], 'frozen'), ('g4', ['voll', 'milchdrink', 'wein'], NULL, NULL)) g(group_id, include, exclude, product_form)"
COMPOUNDS = ("", "Vollmilch, ", "Milchdrink ", "(Milch) ", "Schokomilch ", "Rotwein/", "Ringli ")
COMPOUND = f"SELECT p_partkey, ([{', '.join(repr(x) for x in COMPOUNDS)}])[(p_partkey % {len(COMPOUNDS)} + 1)::INT] || p_name || CASE WHEN p_partkey % 5 = 0 THEN ' Vollmilch' ELSE '' END AS name, CASE WHEN p_partkey % 11 = 0 THEN 'g9' END AS group_id FROM part"


def compounds(s: SparkSession, d: str) -> DataFrame:
    first = F.element_at(F.array(*(F.lit(x) for x in COMPOUNDS)), (F.col("p_partkey") % len(COMPOUNDS) + 1).cast("int"))
    p = F.col("p_partkey")
    return table(s, d, "part").select("p_partkey", F.concat(first, "p_name", F.when(p % 5 == 0, " Vollmilch").otherwise("")).alias("name"), F.when(p % 11 == 0, "g9").alias("group_id"))


@register(
    f"""WITH p AS ({COMPOUND}), hit AS (SELECT p_partkey, group_id, product_form, max(CASE WHEN front THEN length(kw) END) AS long FROM (
      SELECT p_partkey, g.group_id, product_form, kw, starts_with(lower(name), kw) OR regexp_matches(lower(name), '(^|[^a-z0-9_äöü])' || kw || '($|[^a-z0-9_äöü])') AS front, ends_with(lower(name), kw) AS tail
      FROM p, (SELECT group_id, unnest(include) AS kw, exclude, product_form FROM {GROUPS_SQL}) g WHERE len(list_filter(coalesce(exclude, []), lambda x: x <> '' AND regexp_matches(lower(name), x))) = 0)
      WHERE front OR tail GROUP BY ALL),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY long IS NOT NULL, long DESC, group_id) n FROM hit) WHERE n = 1)
    SELECT p.p_partkey, coalesce(p.group_id, best.group_id) AS group_id, CASE WHEN p.group_id IS NULL THEN best.product_form END AS product_form FROM p LEFT JOIN best USING (p_partkey)"""
)
def j10_group_by_keywords(s, d):
    return resolve.group_by_keywords(compounds(s, d), s.sql(f"SELECT * FROM {GROUPS}")).select("p_partkey", "group_id", "product_form")


@register(
    f"""WITH p AS ({COMPOUND}) SELECT p.p_partkey, coalesce(p.group_id, min(g.group_id)) AS group_id FROM p LEFT JOIN (SELECT group_id, unnest(include) AS kw, exclude FROM {GROUPS_SQL}) g
      ON contains(lower(name), kw) AND len(list_filter(coalesce(exclude, []), lambda x: x <> '' AND contains(lower(name), x))) = 0 GROUP BY p.p_partkey, p.group_id"""
)
def j11_group_by_substrings(s, d):
    return resolve.group_by_keywords(compounds(s, d), s.sql(f"SELECT * FROM {GROUPS}"), substring=True).select("p_partkey", "group_id")


@register(f"WITH p AS ({COMPOUND}) SELECT CASE WHEN contains(lower(name), 'wein') THEN 'g4' ELSE 'other' END AS kind, count(*) AS n FROM p WHERE group_id IS NULL AND contains(lower(name), 'rotwein') GROUP BY 1")
def u11_backfill_groups(s, d):
    """Of names with wine in them: `wein` only ends a word here, so the longest keyword of another group may win; counted by name."""
    got = resolve.backfill_groups(compounds(s, d).withColumn("name", F.when(F.lower("name").contains("rotwein"), F.concat("name", F.lit(" wein")))).filter("name is not null"), s.sql("SELECT * FROM (VALUES ('g4', array('wein'), CAST(NULL AS array<string>))) g(group_id, include, exclude)"))
    return got.groupBy(F.col("group_id").alias("kind")).agg(F.count("*").alias("n"))


@register("SELECT p_partkey FROM part WHERE p_name LIKE '%bolt%' AND p_name LIKE '%red%'")
def j12_violations(s, d):
    p = table(s, d, "part").filter(F.col("p_name").contains("bolt")).select("p_partkey", F.col("p_name").alias("name"), F.lit("g1").alias("group_id"))
    return resolve.violates_group(p, s.sql(f"SELECT * FROM {GROUPS}")).select("p_partkey")


REGION = "CASE store WHEN 'migros' THEN 'aare' WHEN 'coop' THEN 'all' ELSE store || '-all' END"


@register(f"SELECT concept_id, store, {REGION} AS region, product_name, max(updated_at) AS last_seen, min_by(original_price, (valid_from, deal_id)) AS regular_price FROM deals GROUP BY ALL", DEALS)
def a26_skus(s, d):
    return resolve.skus(deals(s, d))


CHEAPEST = f"cheapest AS (SELECT * FROM (SELECT *, {REGION} AS region, row_number() OVER (PARTITION BY concept_id, {REGION} ORDER BY sale_price, deal_id) n FROM live) WHERE n = 1)"


def cheapest(s: SparkSession, d: str) -> DataFrame:
    return suggest.cheapest_now(deals(s, d).withColumn("region", resolve.region_of(F.col("store"))), AS_OF)


@register("SELECT concept_id, region, deal_id, sale_price FROM cheapest", DEALS, ACTIVE, CHEAPEST)
def a8_cheapest_now(s, d):
    return cheapest(s, d).select("concept_id", "region", "deal_id", "sale_price")


@register(
    f"""SELECT event_id, user_id, c.concept_id, deal_id, floor(exp(-(epoch_us(TIMESTAMP '{NOW}') - epoch_us(added_at)) / 2592000000000.0) * discount_percent * 1e6 + 0.5) / 1e6 AS score
    FROM interests i JOIN cheapest c ON c.concept_id = i.concept_id WHERE dismissed_at IS NULL AND added_at > TIMESTAMP '{NOW}' - INTERVAL 90 DAY AND discount_percent >= 30""",
    DEALS, ACTIVE, CHEAPEST, INTERESTS,
)
def a10_candidates(s, d):
    c = suggest.candidates(interests(s, d), cheapest(s, d), NOW)
    return c.select("event_id", "user_id", "concept_id", "deal_id", r6(F.col("score")).alias("score"))


@register("SELECT deal_id, store, product_name, category, discount_percent FROM deals WHERE is_active AND discount_percent >= 30 ORDER BY discount_percent DESC, deal_id LIMIT 10", DEALS)
def o2_cold_start(s, d):
    return suggest.cold_start(deals(s, d)).select(*SLIM)


@register("SELECT user_id, count(*) FILTER (WHERE dismissed_at IS NULL) AS signals, CASE WHEN count(*) FILTER (WHERE dismissed_at IS NULL) < 5 THEN 'cold-start' ELSE 'personal' END AS mode FROM interests GROUP BY user_id", INTERESTS)
def f28_modes(s, d):
    return suggest.modes(interests(s, d))


@register("SELECT user_id, string_agg(concept_id::VARCHAR, ',' ORDER BY concept_id) AS concepts FROM (SELECT DISTINCT user_id, concept_id FROM interests WHERE signal = 'added') GROUP BY user_id", INTERESTS)
def aj2_ordered_lists(s, d):
    a = interests(s, d).filter("signal = 'added'").groupBy("user_id").agg(F.array_sort(F.collect_set("concept_id")).alias("ids"))
    return a.select("user_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("concepts"))


# --- comparisons

PRODUCTS = "products AS (SELECT DISTINCT store || '|' || p_name AS product_id, store, p_name AS source_name, product_group FROM deals)"
WITH_PRODUCT = "pd AS (SELECT *, store || '|' || p_name AS product_id FROM live)"


def with_products(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    al = deals(s, d).withColumn("product_id", F.concat_ws("|", "store", "p_name"))
    low = F.min("original_price").alias("regular_price")
    return read.active(al, AS_OF), al.groupBy("product_id", "store", F.col("p_name").alias("source_name"), "product_group").agg(low)


@register(
    """SELECT "group", store, deal_id, sale_price, stores, CASE WHEN lows > 1 THEN 'tie' ELSE low_store END AS best_store FROM (SELECT *, count(*) FILTER (WHERE sale_price = low) OVER w AS lows, max(CASE WHEN sale_price = low THEN store END) OVER w AS low_store
      FROM (SELECT *, count(*) OVER w AS stores, min(sale_price) OVER w AS low FROM (SELECT product_group AS "group", store, deal_id, sale_price, row_number() OVER (PARTITION BY product_group, store ORDER BY discount_percent DESC, deal_id) n FROM live) WHERE n = 1 WINDOW w AS (PARTITION BY "group"))
      WHERE stores >= 2 WINDOW w AS (PARTITION BY "group"))""",
    DEALS, ACTIVE,
)
def j17_group_comparisons(s, d):
    al, products = with_products(s, d)
    return compare.group_comparisons(al, products).select("group", "store", "deal_id", "sale_price", "stores", "best_store")


@register()
def j18_similar_names(s, d):
    return compare.similar_names(live(s, d))


MATCHED = """matched AS (SELECT k.kw AS item_id, coalesce(b.store, 'none') AS best_store, b.deal_id, b.sale_price, coalesce(b.stores, 0)::BIGINT AS stores,
      k.kw = 'gear' AND (SELECT count(DISTINCT store) = 7 FROM deals WHERE product_group = 'gear' AND original_price IS NOT NULL) AS show_regular FROM (VALUES {kws}) k(kw)
    LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY item_id) AS stores, row_number() OVER (PARTITION BY item_id ORDER BY sale_price, list_position(['migros','coop','lidl','aldi','denner','spar','volg'], store)) AS p FROM (
      SELECT item_id, store, deal_id, sale_price FROM (SELECT kw AS item_id, l.store, l.deal_id, l.sale_price, row_number() OVER (PARTITION BY kw, l.store ORDER BY (kw = 'bolt' AND contains(name, 'small')) DESC, relevance + (relevance >= 3 AND len(ws) <= 4)::INT DESC, discount_percent DESC, deal_id) n
        FROM rel JOIN live l USING (product_name) WHERE kw <> 'gear' AND relevance >= 2 AND discount_percent > 0 AND NOT (kw = 'bolt' AND contains(name, 'red'))) WHERE n = 1
      UNION ALL SELECT 'gear', store, deal_id, sale_price FROM (SELECT *, row_number() OVER (PARTITION BY store ORDER BY discount_percent DESC, deal_id) n FROM live WHERE product_group = 'gear' AND discount_percent > 0) WHERE n = 1)) b ON b.item_id = k.kw AND b.p = 1)""".format(kws=", ".join(f"('{k}')" for k in KEYWORDS))


@register("SELECT * FROM matched", DEALS, ACTIVE, RELEVANCE_SQL, MATCHED)
def j16_match_basket(s, d):
    al, products = with_products(s, d)
    return compare.match_basket(basket(al), al, products)


@register("SELECT best_store, list(item_id ORDER BY item_id) AS items, floor(sum(sale_price) * 100 + 0.5) / 100 AS total FROM matched GROUP BY best_store", DEALS, ACTIVE, RELEVANCE_SQL, MATCHED)
def a22_split_list(s, d):
    al, products = with_products(s, d)
    return compare.split_list(compare.match_basket(basket(al), al, products)).withColumn("total", units.cents(F.col("total")))


@register("SELECT product_group, store, min(original_price) AS regular_price FROM deals GROUP BY ALL", DEALS)
def a23_regular_prices(s, d):
    return compare.regular_prices(with_products(s, d)[1])


BANDS = """bands AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY is_promo DESC, sale_price, deal_id)::INT AS place, count(*) FILTER (WHERE is_promo) OVER (PARTITION BY band) AS promos FROM (SELECT *, row_number() OVER (PARTITION BY band, store ORDER BY is_promo DESC, sale_price, deal_id) n
    FROM (SELECT *, coalesce(sub_category, 'other') AS band, discount_percent > 0 AS is_promo FROM live)) WHERE n = 1)"""


def banded(s: SparkSession, d: str) -> DataFrame:
    return compare.bands(live(s, d).withColumn("is_promo", F.col("discount_percent") > 0))


@register("SELECT band, store, deal_id, place, promos FROM bands", DEALS, ACTIVE, BANDS)
def a19_bands(s, d):
    return banded(s, d).select("band", "store", "deal_id", "place", "promos")


@register("SELECT store, count(*) AS won FROM bands WHERE place = 1 AND is_promo GROUP BY store ORDER BY won DESC, store LIMIT 2", DEALS, ACTIVE, BANDS)
def a21_band_winners(s, d):
    return compare.band_winners(banded(s, d))


BROWSE = "(VALUES ('metal', array('bolt', 'gear')), ('round', array('ring', 'wheel'))) b(category, sub_categories)"


@register("SELECT CASE WHEN sub_category IN ('bolt', 'gear') THEN 'metal' WHEN sub_category IN ('ring', 'wheel') THEN 'round' ELSE 'other-' || category END AS browse, count(*) AS n FROM deals GROUP BY 1", DEALS)
def a31_browse_counts(s, d):
    return compare.browse_counts(deals(s, d), s.sql(f"SELECT * FROM {BROWSE}"))


@register(
    """SELECT item_id, store, deal_id, sale_price FROM (SELECT item_id, store, deal_id, sale_price, row_number() OVER (PARTITION BY item_id, store ORDER BY sale_price, deal_id) n FROM live
      JOIN (VALUES (1, 'bolt'), (1, 'gear'), (2, 'ring'), (2, 'wheel')) i(item_id, sub) ON sub = sub_category) WHERE n = 1""",
    DEALS, ACTIVE,
)
def j22_by_category(s, d):
    items = s.sql("SELECT * FROM (VALUES (1, 'metal'), (2, 'round')) i(item_id, category)")
    return compare.by_category(items, s.sql(f"SELECT * FROM {BROWSE}"), live(s, d))


STARTERS = "(VALUES ('fresh', 'bolt', 1), ('fresh', 'small', 2), ('long-life', 'ring', 3), ('non-food', 'gear', 4)) t(category, keyword, ord)"


@register(
    f"""SELECT deal_id, coalesce(k.keyword, l.product_name) AS keyword FROM live l LEFT JOIN (SELECT product_name, category, min_by(keyword, (-relevance, ord)) AS keyword FROM rel JOIN {STARTERS} ON keyword = kw WHERE relevance >= 3 GROUP BY ALL) k
    ON k.product_name = l.product_name AND k.category = l.category""",
    DEALS, ACTIVE, relevance_sql("bolt", "small", "ring", "gear"),
)
def j23_keyword_for_deal(s, d):
    return compare.keyword_for(live(s, d), s.sql(f"SELECT * FROM {STARTERS}")).select("deal_id", "keyword")


@register(
    """SELECT product_id, name, deal_id, 4 AS relevance FROM (SELECT p.product_id, p.name, b.deal_id, row_number() OVER (ORDER BY b.deal_id IS NULL, b.discount_percent DESC, p.product_id) n
      FROM (SELECT DISTINCT store || '|' || p_name AS product_id, p_name AS name FROM deals WHERE product_group = 'gear') p
      LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY discount_percent DESC, deal_id) r FROM (SELECT store || '|' || p_name AS product_id, * FROM live)) b ON b.product_id = p.product_id AND b.r = 1) WHERE n <= 8""",
    DEALS, ACTIVE,
)
def j21_search_products(s, d):
    al, products = with_products(s, d)
    groups = products.select(F.col("product_group").alias("group_id"), F.col("product_group").alias("label")).distinct()
    return compare.search_products("gear", groups, products, al)


@register("SELECT sub_category FROM deals WHERE sub_category IS NOT NULL GROUP BY 1", DEALS)
def a32_distinct_facets(s, d):
    return deals(s, d).filter("sub_category is not null").select("sub_category").distinct()


# --- sources


@register(
    "SELECT deal_id, product_name AS name, sale_price, original_price, discount_percent, valid_from, coalesce(valid_to, valid_from) AS valid_to FROM deals WHERE is_active AND line <> 7 AND sale_price > 0", DEALS
)
def s4_cards(s, d):
    al = deals(s, d).filter("is_active and line <> 7 and sale_price > 0")
    c = cards.cards(cards.to_html(al), "html", "deal_id")
    when = units.date_range(F.col("date_text"))
    return c.select("deal_id", "name", "sale_price", "original_price", "discount_percent", when["a"].alias("valid_from"), when["b"].alias("valid_to"))


@register("SELECT deal_id, product_name AS name, floor(original_price * 100 + 0.5) / 100 AS original, sale_price AS sale, discount_percent::DOUBLE AS discount, 'cat-' || store AS label FROM deals WHERE sale_price > 0", DEALS)
def s13_api_cards(s, d):
    """Deals folded into nested API cards and read back."""
    money = lambda c: F.struct(F.lit(None).cast("double").alias("advertisedValue"), c.alias("effectiveValue"))
    badges = F.array(F.struct(F.lit("NEW").alias("type"), F.lit("7").alias("description")), F.struct(F.lit("PERCENTAGE_PROMOTION").alias("type"), F.concat(F.col("discount_percent").cast("string"), F.lit("%")).alias("description")))
    img = F.struct(F.lit("c").alias("cdn"), F.lit("https://i/{stack}/x").alias("url"))
    c = deals(s, d).select(
        F.xxhash64("deal_id").alias("uid"), F.lit("untitled").alias("name"), F.col("product_name").alias("title"),
        F.struct(money(units.cents(F.col("original_price"))).alias("price"), money(F.col("sale_price")).alias("promotionPrice"), badges.alias("badges"), F.struct(F.col("valid_from").cast("string").alias("startDate"), F.col("valid_to").cast("string").alias("endDate")).alias("promotionDateRange")).alias("offer"),
        img.alias("imageTransparent"), F.array(img).alias("images"), F.array(F.struct(F.lit("1").alias("id"), F.concat(F.lit("cat-"), "store").alias("name"))).alias("breadcrumb"), F.col("deal_id").alias("productUrls"),
    )
    return feeds.api_deals(c).select(F.col("sourceUrl").alias("deal_id"), F.col("productName").alias("name"), F.col("originalPrice").alias("original"), F.col("salePrice").alias("sale"), F.col("discountPercent").alias("discount"), F.col("sourceCategory").alias("label"))


@register(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=')) AS links FROM pages")
def s1_page_titles(s, d):
    return table(s, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("links"))


@register("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'coop' WHEN 1 THEN 'aldi' WHEN 2 THEN 'lidl' END AS store FROM part")
def s7_slug_store(s, d):
    slugs = F.element_at(F.array(*(F.lit(x) for x in ("coop-megastore", "aldi-suisse", "lidl", "nowhere"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(s, d, "part").select("p_partkey", feeds.store_of_slug(slugs).alias("store"))
