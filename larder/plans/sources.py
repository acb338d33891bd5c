"""Registered queries of feeds, cards, filters, prices, metadata and the concept layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, text, units
from ..functions import values as V
from ..operators import access, ingest, layer, lists, prices, read, upkeep, verdict
from ..sources import cards, feeds
from .more import BRANDED
from .queries import ACTIVE, DEMO_RULES, LABELLED, RULES, labelled, live, quoted, r6, raw_rows, register, sql_any_sub, sql_cases, sql_lists
from .star import AS_OF, DEALS, deals, table
from .tables import folder


@register(f"SELECT store, product_name AS \"productName\", count(*) AS n, min(sale_price) AS low FROM live WHERE store <> 'volg' GROUP BY ALL", DEALS, ACTIVE)
def s5_feed_files(s, d):
    """Active deals written as feed files, a JSON array a store, found and read again; the file of a slug that is no store is skipped."""
    path = folder(s, "feeds")
    rows = live(s, d).select(F.when(F.col("store") == "coop", "coop-megastore").when(F.col("store") == "aldi", "aldi-suisse").when(F.col("store") == "volg", "nowhere").otherwise(F.col("store")).alias("store"), F.col("product_name").alias("productName"), F.col("sale_price").alias("salePrice"), F.col("deal_id").alias("sourceUrl"))
    feeds.write_feed_files(rows, path, 4)
    return feeds.read_feeds(s, path).groupBy("store", "productName").agg(F.count("*").alias("n"), F.min("salePrice").alias("low"))


@register(
    f"""SELECT '/d/' || deal_id AS "sourceUrl", 'coop' AS store, lower(product_name) AS "productName", CASE WHEN original_price > 0 THEN floor(original_price * 100 + 0.5) / 100 END AS "originalPrice", sale_price AS "salePrice", discount_percent::DOUBLE AS "discountPercent",
    CASE WHEN line % 2 = 0 THEN '{AS_OF}' ELSE valid_from::VARCHAR END AS "validFrom", CASE WHEN line % 2 = 0 THEN (DATE '{AS_OF}' + 7)::DATE::VARCHAR ELSE valid_to::VARCHAR END AS "validTo" FROM live WHERE sale_price > 0""",
    DEALS, ACTIVE,
)
def p1_card_rows(s, d):
    """Cards as feed rows; every other card has no dates, so it runs a week from today."""
    al = live(s, d).filter("sale_price > 0").withColumns({c: F.when(F.col("line") % 2 == 1, F.col(c)) for c in ("valid_from", "valid_to")})
    rows = ingest.card_to_deal(cards.cards(cards.to_html(al), "html"), "coop", AS_OF)
    return rows.select("sourceUrl", "store", "productName", "originalPrice", "salePrice", "discountPercent", "validFrom", "validTo")


@register("SELECT page_id, p_name AS name, floor(p_retailprice * 100 + 0.5) / 100 AS sale_price, p_size AS discount_percent, DATE '2001-01-01' + p_size AS valid_to FROM pages JOIN part ON p_partkey % 50 = page_id % 50 AND p_partkey <= 200")
def s1_cards_on_pages(s, d):
    """Offers set into the bodies of raw pages, found among their other markup."""
    day = F.lit("2001-01-01").cast("date")
    offers = table(s, d, "part").filter("p_partkey <= 200").select("p_partkey", F.col("p_partkey").cast("string").alias("deal_id"), F.col("p_name").alias("product_name"), units.cents(F.col("p_retailprice")).alias("sale_price"), F.lit(99999.0).alias("original_price"), F.col("p_size").alias("discount_percent"), day.alias("valid_from"), F.date_add(day, F.col("p_size")).alias("valid_to"))
    shown = cards.to_html(offers).withColumn("k", F.col("deal_id").cast("long") % 50).groupBy("k").agg(F.array_join(F.sort_array(F.collect_list("html")), "").alias("offers"))
    pages = table(s, d, "pages").withColumn("k", F.col("page_id") % 50).join(F.broadcast(shown), "k")  # fifty rows
    whole = pages.select("page_id", F.replace("html", F.lit("</article>"), F.concat("offers", F.lit("</article>"))).alias("html"))
    found = cards.cards(whole, "html", "page_id")
    return found.select("page_id", "name", "sale_price", "discount_percent", units.date_range(F.col("date_text"))["b"].alias("valid_to"))


@register(
    f"""SELECT l_orderkey, l_linenumber, store, name, valid_from, sale_price, discount_percent, category, confidence FROM (SELECT l_orderkey, l_linenumber, ([{quoted(V.STORES)}])[(l_suppkey % 7 + 1)::INT] AS store, low AS name, l_shipdate::DATE AS valid_from,
      floor(l_extendedprice * 100 + 0.5) / 100 AS sale_price, CASE WHEN l_orderkey % 11 = 5 THEN 0 ELSE floor(l_discount * 100 + 0.0000001)::INT END AS discount_percent, split_part(x, '|', 1) AS category,
      CASE split_part(x, '|', 3) WHEN 'brand' THEN 0.95 WHEN 'source' THEN 0.85 WHEN 'keyword' THEN 0.7 ELSE 0.3 END::DOUBLE AS confidence FROM lineitem JOIN (SELECT *, {sql_cases()} AS x FROM labelled) ON p_partkey = l_partkey WHERE l_orderkey % 11 NOT IN (0, 1, 2, 3, 4, 6, 7))""",
    LABELLED,
)
def p2_stored_rows(s, d):
    """Valid feed rows as stored deals."""
    named = labelled(s, d).withColumnRenamed("label", "sourceCategory")
    raw = raw_rows(s, d).filter(ingest.valid_entry()).drop("productName").join(named.withColumnRenamed("name", "productName"), F.col("l_partkey") == F.col("p_partkey")).withColumns({c: F.lit(None).cast("string") for c in ("imageUrl", "sourceUrl")})
    rows = ingest.to_row(ingest.with_unit_price(ingest.categorised(raw, rules=DEMO_RULES)), "l_orderkey", "l_linenumber")
    return rows.select("l_orderkey", "l_linenumber", "store", F.col("product_name").alias("name"), "valid_from", F.col("sale_price").cast("double").alias("sale_price"), "discount_percent", "category", F.col("taxonomy_confidence").alias("confidence"))


CHOSEN = "type=long-life&stores=coop,lidl,nowhere&q=%20Ring%20"


@register("SELECT deal_id, store, 3::BIGINT AS chosen, 'type=longlife&stores=coop%2Clidl&q=+Ring+' AS said FROM live WHERE category = 'long-life' AND store IN ('coop', 'lidl') AND contains(lower(product_name), 'ring')", DEALS, ACTIVE)
def f14_parsed_filters(s, d):
    """A choice read from a link, written back, read again, and applied; with how many parts of it are not the default."""
    f = read.Filters.parse(read.Filters.parse(CHOSEN).serialize())
    if f != read.Filters.parse(CHOSEN) or f.is_default():
        raise RuntimeError("a choice did not survive its link")
    rows = read.filtered(live(s, d).replace({"long-life": "longlife"}, subset=["category"]), f)
    return rows.select("deal_id", "store", F.lit(f.active_count()).cast("long").alias("chosen"), F.lit(f.serialize()).alias("said"))


@register("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'https://i/original/' || p_size WHEN 1 THEN 'cdn-' || p_size WHEN 2 THEN 'https://j/' || p_size END AS image FROM part")
def st16_image_urls(s, d):
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    pair = lambda cdn, url: F.struct(cdn.cast("string").alias("cdn"), url.cast("string").alias("url"))
    none = F.lit(None)
    main = F.when(k == 0, pair(F.lit("c"), F.concat(F.lit("https://i/{stack}/"), size))).when(k == 1, pair(F.concat(F.lit("cdn-"), size), none))
    images = F.when(k == 2, F.array(pair(F.lit("d"), F.concat(F.lit("https://j/"), size)), pair(F.lit("e"), F.lit("f")))).when(k == 3, F.array().cast("array<struct<cdn:string,url:string>>"))
    return table(s, d, "part").select("p_partkey", feeds.image_url(main, images).alias("image"))


BRAND_SQL = "CASE WHEN k = 0 THEN 'Emmi' WHEN k = 1 THEN 'Zweifel' WHEN k = 2 THEN 'Naturaplan' WHEN k = 4 THEN 'Thomy' WHEN k = 5 THEN 'M-Budget' END"
BRANDED_SQL = f"(SELECT *, p_partkey % {len(BRANDED)} AS k, ([{quoted(BRANDED)}])[(p_partkey % {len(BRANDED)} + 1)::INT] || ' ' || p_name || ' ' || p_size || CASE p_partkey % 3 WHEN 0 THEN 'g' WHEN 1 THEN ' Stück' ELSE '' END AS name FROM part)"


def branded(s, d):
    p = F.col("p_partkey")
    tail = F.when(p % 3 == 0, "g").when(p % 3 == 1, " Stück").otherwise("")
    return table(s, d, "part").select("*", F.concat(F.element_at(F.array(*(F.lit(b) for b in BRANDED)), (p % len(BRANDED) + 1).cast("int")), F.lit(" "), "p_name", F.lit(" "), F.col("p_size").cast("string"), tail).alias("name"))


@register(f"SELECT p_partkey, array_to_string(list_transform(string_split(CASE WHEN k IN (0, 4, 5) THEN substr(name, length({BRAND_SQL}) + 2) ELSE name END, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS canonical FROM {BRANDED_SQL}")
def p8_canonical_names(s, d):
    return branded(s, d).select("p_partkey", text.canonical_name(F.col("name"), text.brand(F.col("name"))).alias("canonical"))


@register(
    f"""SELECT p_partkey, {BRAND_SQL} AS brand, CASE WHEN p_partkey % 3 < 2 THEN p_size::DOUBLE END AS quantity, CASE p_partkey % 3 WHEN 0 THEN 'g' WHEN 1 THEN 'pcs' END AS unit, k IN (1, 2) AS organic, {sql_any_sub()} AS sub_category, {sql_lists(V.FORMS, 'raw')} AS form
    FROM (SELECT *, lower(name) AS low, lower(p_type) AS lab FROM {BRANDED_SQL})"""
)
def cl11_all_metadata(s, d):
    m = ingest.with_metadata(branded(s, d).withColumn("label", F.col("p_type")), DEMO_RULES, "name", "label")
    return m.select("p_partkey", *(f"metadata.{c}" for c in ("brand", "quantity", "unit", "organic", "sub_category", "form")))


@register(f"SELECT count(*) AS n, count({BRAND_SQL}) AS with_brand, count(*) FILTER (WHERE p_partkey % 3 < 2) AS with_quantity, count(*) FILTER (WHERE k IN (1, 2)) AS organic FROM {BRANDED_SQL}")
def a27_metadata_of_brands(s, d):
    return ingest.metadata_summary(branded(s, d), "name")


@register("SELECT category, floor(avg(discount_percent) + 0.5)::BIGINT AS points FROM live GROUP BY category", DEALS, ACTIVE)
def a4_average_discount(s, d):
    return live(s, d).groupBy("category").agg(verdict.average(F.col("discount_percent")).alias("points"))


@register("SELECT p_partkey, CASE WHEN p_size * 50 >= 1000 THEN CASE WHEN p_size % 20 = 0 THEN (p_size // 20)::VARCHAR ELSE (p_size / 20.0)::DOUBLE::VARCHAR END || ' L' ELSE (p_size * 50)::VARCHAR || ' ml' END AS volume FROM part")
def n14_volumes(s, d):
    return table(s, d, "part").select("p_partkey", units.volume_text(F.col("p_size").cast("double") * 50).alias("volume"))


# --- prices and the concept layer

SEARCHED = """groups AS (SELECT * FROM (VALUES ('g1', 'bolt', ['red']), ('g2', 'bolt', ['hot', '']), ('g3', 'gear', NULL)) g(group_id, keyword, excluded)),
results AS (SELECT p_partkey AS place, split_part(p_name, ' ', 2) AS keyword, p_name || ' ' || (p_partkey % 7) AS source_name, p_retailprice AS regular_price FROM part WHERE split_part(p_name, ' ', 2) IN ('bolt', 'gear')),
known AS (SELECT DISTINCT 'p-' || source_name AS id, source_name FROM results WHERE place % 7 < 3)"""


def searched(s, d):
    groups = s.sql("SELECT group_id, array(keyword, 'x') AS search_keywords, exclude_keywords, category, product_form FROM (VALUES ('g1', 'bolt', array('red'), 'fresh', 'raw'), ('g2', 'bolt', array('hot', ''), NULL, NULL), ('g3', 'gear', NULL, 'non-food', 'x')) g(group_id, keyword, exclude_keywords, category, product_form)")
    word, k = F.element_at(F.split("p_name", " "), 2), F.col("p_partkey") % 7
    results = table(s, d, "part").select(F.col("p_partkey").alias("place"), word.alias("keyword"), F.concat("p_name", F.lit(" "), k.cast("string")).alias("source_name"), F.col("p_retailprice").alias("regular_price")).filter(F.col("keyword").isin("bolt", "gear"))
    products = results.filter(F.col("place") % 7 < 3).select(F.concat(F.lit("p-"), "source_name").alias("id"), "source_name", F.lit("migros").alias("store")).distinct()
    return results, groups, products


@register("SELECT id, min(regular_price) AS regular_price FROM results JOIN known USING (source_name) GROUP BY id", SEARCHED)
def s14_refreshed_prices(s, d):
    results, _, products = searched(s, d)
    return prices.refreshed(results, products, "migros")


@register(
    """SELECT source_name, product_group, category, regular_price FROM (SELECT r.source_name, g.group_id AS product_group, CASE g.group_id WHEN 'g3' THEN 'non-food' ELSE 'fresh' END AS category, regular_price, row_number() OVER (PARTITION BY r.source_name ORDER BY place, g.group_id) n
    FROM results r JOIN groups g USING (keyword) WHERE r.source_name NOT IN (SELECT source_name FROM known) AND len(list_filter(coalesce(excluded, []), lambda e: e <> '' AND contains(lower(r.source_name), e))) = 0) WHERE n = 1""",
    SEARCHED,
)
def s14_revealed_products(s, d):
    results, groups, products = searched(s, d)
    return prices.revealed(results, groups, products, "migros").select("source_name", "product_group", "category", "regular_price")


RULED = f"""ruled AS (SELECT product_name, min_by(concept_id, priority) AS rule FROM (SELECT DISTINCT product_name FROM deals) n JOIN {RULES}
  ON is_active AND concept_id IS NOT NULL AND CASE rule_type WHEN 'exact' THEN lower(product_name) = lower(pattern) WHEN 'regex' THEN regexp_matches(product_name, '(?i)' || pattern) WHEN 'multipack' THEN contains(lower(product_name), lower(pattern)) AND regexp_matches(lower(product_name), '\\b\\d+\\s*[x×]\\s*\\d') ELSE contains(lower(product_name), lower(pattern)) END GROUP BY product_name),
tagged AS (SELECT l.*, CASE store WHEN 'migros' THEN 'aare' WHEN 'coop' THEN 'all' ELSE store || '-all' END AS region, rule, CASE WHEN l.sub_category IS NOT NULL THEN coalesce(rule::VARCHAR, regexp_replace(lower(l.sub_category || '-' || l.product_name), '[^a-z0-9]+', '-', 'g')) END AS concept
  FROM live l LEFT JOIN ruled r ON r.product_name = l.product_name)""".replace("\\\\", "\\")


def laid(s, d):
    return layer.populate(live(s, d).drop("concept_id"), s.sql(f"SELECT * FROM {RULES}"), s.sql("SELECT * FROM (VALUES ('ring'), ('gear')) t(slug)"))


@register("SELECT t.deal_id, t.concept, CASE WHEN t.concept IS NOT NULL THEN (SELECT min(sha256(concept || '|' || store || '|' || region || '|' || product_name)) FROM tagged u WHERE u.concept IS NOT NULL AND u.store = t.store AND u.product_name = t.product_name) END AS sku_id FROM tagged t", DEALS, ACTIVE, RULED)
def u17_linked_deals(s, d):
    return laid(s, d).deals.select("deal_id", "concept", "sku_id")


@register("SELECT sub_category AS slug, upper(sub_category[1]) || sub_category[2:] AS display_name, min_by(category_slug, (valid_from, deal_id)) AS category_slug, CASE WHEN sub_category IN ('ring', 'gear') THEN sub_category END AS subcategory_slug FROM tagged WHERE sub_category IS NOT NULL AND rule IS NULL GROUP BY sub_category", DEALS, ACTIVE, RULED)
def u17_families(s, d):
    return laid(s, d).families


@register("SELECT concept, store, region, product_name, max_by(floor(original_price * 1e6 + 0.5) / 1e6, (valid_from, deal_id)) AS regular_price, max(updated_at) AS last_seen FROM tagged WHERE concept IS NOT NULL GROUP BY ALL", DEALS, ACTIVE, RULED)
def u17_units(s, d):
    return laid(s, d).skus.drop("sku_id").withColumn("regular_price", r6(F.col("regular_price")))


@register("SELECT o_orderkey AS \"oOrderkey\", o_custkey AS \"oCustkey\", o_orderpriority AS \"oOrderpriority\" FROM orders")
def p4_camel_rows(s, d):
    """Rows with their columns as the other side writes them, there and back and there."""
    rows = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return access.renamed(access.renamed(access.renamed(rows, access.camel), access.snake), access.camel)


@register("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_nationkey = 3 OR c_mktsegment = 'BUILDING'")
def u15_readable_rows(s, d):
    """Customers as a role sees them: two conditions, and no balances."""
    seen = ("c_custkey", "c_name", "c_mktsegment")
    policies = [access.Policy("anon", F.col("c_nationkey") == 3, seen), access.Policy("anon", F.col("c_mktsegment") == "BUILDING"), access.Policy("other", F.lit(True))]
    return access.readable(table(s, d, "customer"), "anon", policies)


@register("SELECT r_regionkey, r_name || '!' AS r_name, count(n_nationkey) AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def s19_migrated(s, d):
    """Tables that scripts of statements make from the given ones, run twice; the second time none is left to run."""
    mark = folder(s, "m").rpartition("-")[2]
    for name in ("region", "nation"):
        table(s, d, name).createOrReplaceTempView(f"{name}_{mark}")
    log = folder(s, "migrations")
    scripts = [("002", f"CREATE OR REPLACE TEMPORARY VIEW named_{mark} AS SELECT r_regionkey, concat(r_name, '!') AS r_name FROM region_{mark}; CREATE OR REPLACE TEMPORARY VIEW result_{mark} AS SELECT r_regionkey, r_name, count(n_nationkey) AS nations FROM named_{mark} LEFT JOIN counted_{mark} ON n_regionkey = r_regionkey GROUP BY ALL;"), ("001", f"CREATE OR REPLACE TEMPORARY VIEW counted_{mark} AS SELECT n_nationkey, n_regionkey FROM nation_{mark}")]
    if upkeep.migrate(s, scripts, log, AS_OF) != ["001", "002"] or upkeep.migrate(s, scripts, log, AS_OF):
        raise RuntimeError("migrations did not run once each")
    return s.table(f"result_{mark}")


# --- the same operators on rows that vary

STORE_LIST = f"[{quoted(V.STORES)}]"


@register(f"SELECT p_partkey, x.sub_category, t.canonical_unit, t.default_format FROM (SELECT p_partkey, {sql_any_sub()} AS sub_category FROM labelled) x LEFT JOIN (VALUES ('water', 'L', 'still'), ('dairy', 'L', 'whole'), ('juice', 'L', '100pct'), ('bread', 'kg', 'loaf'), ('poultry', 'kg', 'fresh'), ('coffee', '100g', 'beans'), ('eggs', 'piece', 'medium')) t(sub_category, canonical_unit, default_format) ON t.sub_category = x.sub_category", LABELLED)
def cl17_schemas_of_names(s, d):
    """What the schema of each name's sub-category says."""
    named = classify.over_distinct(labelled(s, d), ["name", "label"], "sub_category", lambda n, c: classify.any_sub_category(n, c, DEMO_RULES))
    known = lists.schemas(named).select("sub_category", "canonical_unit", "default_format")
    return named.select("p_partkey", "sub_category").join(known, "sub_category", "left").select("p_partkey", "sub_category", "canonical_unit", "default_format")


@register(
    f"""SELECT c_custkey, array_to_string(CASE WHEN len(left_over) > 0 THEN left_over ELSE covered END, ',') AS stores FROM (SELECT c_custkey, covered, list_filter(coalesce(chosen, []), lambda x: list_contains(covered, x)) AS left_over FROM (SELECT c_custkey,
      CASE WHEN c_custkey % 5 > 0 THEN list_filter({STORE_LIST}, lambda x, i: (c_custkey // (2 ** i)::BIGINT) % 2 = 1) END AS chosen, list_filter({STORE_LIST}, lambda x, i: (c_nationkey + i) % 3 = 0) AS covered FROM customer))"""
)
def f22_guarded_stores(s, d):
    """Stores that customers chose, as far as their region has them."""
    every = F.array(*(F.lit(x) for x in V.STORES))
    place = lambda x: F.array_position(every, x)
    chosen = F.when(F.col("c_custkey") % 5 > 0, F.filter(every, lambda x: F.floor(F.col("c_custkey") / F.pow(F.lit(2.0), place(x).cast("double"))) % 2 == 1))
    covered = F.filter(every, lambda x: (F.col("c_nationkey") + place(x)) % 3 == 0)
    return table(s, d, "customer").select("c_custkey", F.array_join(read.guarded_stores(chosen, covered), ",").alias("stores"))


@register("SELECT store, CASE WHEN n > 0 THEN 'success' ELSE 'failed' END AS status, n, (SELECT count(*) FROM live WHERE category = 'fresh' AND store <> 'spar') AS total FROM (SELECT s.store, count(l.deal_id) AS n FROM (VALUES ('migros'), ('coop'), ('lidl'), ('aldi'), ('denner'), ('spar'), ('volg')) s(store) LEFT JOIN live l ON l.store = s.store AND category = 'fresh' AND l.store <> 'spar' GROUP BY s.store)", DEALS, ACTIVE)
def s9_run_log_of_stores(s, d):
    """The whole map of a run's row, a store a line."""
    log = ingest.run_log(ingest.store_status(live(s, d).filter("category = 'fresh' and store <> 'spar'")), "run", AS_OF)
    each = log.select(F.explode("store_results").alias("store", "x"), F.col("total_stored").cast("long").alias("total"))
    return each.select("store", "x.status", F.col("x.count").cast("long").alias("n"), "total")


@register("SELECT o_orderkey AS id, o_orderdate AS run_at, CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'success' END AS status, o_custkey AS n, o_custkey * 2 AS total_stored, o_orderkey % 1000 AS duration_ms FROM orders")
def p7_public_runs_of_orders(s, d):
    """Runs as anyone may read them: times, numbers, what each store gave, no errors."""
    result = F.create_map(F.lit("coop"), F.struct(F.when(F.col("o_orderstatus") == "F", "failed").otherwise("success").alias("status"), F.col("o_custkey").alias("count")))
    runs = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("run_at"), result.alias("store_results"), (F.col("o_custkey") * 2).alias("total_stored"), (F.col("o_orderkey") % 1000).alias("duration_ms"), F.col("o_orderpriority").alias("error_log"))
    seen = ingest.public_runs(runs)
    if "error_log" in seen.columns:
        raise RuntimeError("errors are not public")
    return seen.select("id", "run_at", F.col("store_results")["coop"]["status"].alias("status"), F.col("store_results")["coop"]["count"].alias("n"), "total_stored", "duration_ms")
