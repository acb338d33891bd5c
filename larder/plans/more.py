"""More registered queries: lists, packs, labels, the concept layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, units
from ..functions import values as V
from ..operators import compare, ingest, lists, read, resolve, store, suggest, verdict
from .queries import ACTIVE, CHEAPEST, DEMO_RULES, INTERESTS, LABELLED, basket, cheapest, labelled, live, quoted, r6, register, sql_any_sub, sql_cases, with_products
from .star import AS_OF, DEALS, NOW, WEEK, deals, interests, table


@register("SELECT user_id AS list_id, concept_id AS item FROM interests WHERE signal = 'added' GROUP BY ALL UNION SELECT user_id, concept_id FROM interests WHERE signal = 'browsed' GROUP BY ALL", INTERESTS)
def u14_list_add(s, d):
    of = lambda k: interests(s, d).filter(F.col("signal") == k).select(F.col("user_id").alias("list_id"), F.col("concept_id").alias("item")).distinct()
    return lists.add(of("added"), of("browsed"))


@register("SELECT DISTINCT user_id AS list_id, concept_id AS item FROM interests WHERE signal = 'added' AND (user_id, concept_id) NOT IN (SELECT (user_id, concept_id) FROM interests WHERE dismissed_at IS NOT NULL)", INTERESTS)
def u14_list_remove(s, d):
    rows = interests(s, d).select(F.col("user_id").alias("list_id"), F.col("concept_id").alias("item"), "signal", "dismissed_at")
    return lists.remove(rows.filter("signal = 'added'").select("list_id", "item").distinct(), rows.filter("dismissed_at is not null"))


@register("SELECT user_id AS list_id, concept_id AS item FROM interests WHERE signal = 'added' AND user_id % 2 = 1 GROUP BY ALL UNION ALL SELECT user_id, concept_id FROM interests WHERE signal = 'browsed' AND user_id % 2 = 0 GROUP BY ALL", INTERESTS)
def u16_replace_all(s, d):
    rows = interests(s, d).select(F.col("user_id").alias("list_id"), F.col("concept_id").alias("item"), "signal")
    old = rows.filter("signal = 'added'").select("list_id", "item").distinct()
    new = rows.filter("signal = 'browsed' and list_id % 2 = 0").select("list_id", "item")
    users = new.select("list_id").distinct()
    return lists.replace_all(old.filter("list_id % 2 = 1").unionByName(old.join(users, "list_id", "left_semi")), new)


@register("""SELECT event_id AS list_id, pos::INT AS pos, CASE pos WHEN 0 THEN event_type ELSE 'k' || event_id END AS item, CASE WHEN pos = 1 AND event_id % 2 = 0 THEN 'g' || event_id END AS product_group_id FROM events, (VALUES (0), (1)) p(pos)""")
def aj4_json_items(s, d):
    e = table(s, d, "events")
    item = F.concat(F.lit('[{"keyword":"'), "event_type", F.lit('","label":"","productGroupId":"null"},{"keyword":"k'), F.col("event_id").cast("string"), F.lit('","productGroupId":'), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"g'), F.col("event_id").cast("string"), F.lit('"'))).otherwise("null"), F.lit("}]"))
    return lists.from_json(e.select(F.col("event_id").alias("list_id"), item.alias("items"))).select("list_id", "pos", "item", "product_group_id")


@register("SELECT user_id AS pack, string_agg(event_type || ':' || CASE event_type WHEN 'click' THEN 'g1' WHEN 'view' THEN 'g2' ELSE '-' END, ' ' ORDER BY event_id) AS items FROM events GROUP BY user_id")
def j14_enrich_packs(s, d):
    e = table(s, d, "events").groupBy(F.col("user_id").alias("pack")).agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: F.struct(x["event_type"].alias("keyword"))).alias("items"))
    groups = s.sql("SELECT * FROM (VALUES ('click', 'g1'), ('view', 'g2')) g(keyword, group_id)")
    out = lists.enrich_packs(e, groups)
    return out.select("pack", F.array_join(F.transform("items", lambda i: F.concat(i["keyword"], F.lit(":"), F.coalesce(i["product_group_id"], F.lit("-")))), " ").alias("items"))


@register("SELECT signal AS category, count(*) AS n, count(DISTINCT concept_id) AS items FROM interests GROUP BY 1", INTERESTS)
def a36_by_category(s, d):
    out = lists.by_category(interests(s, d).select(F.col("signal").alias("category"), F.col("concept_id").alias("item")))
    return out.select("category", "n", F.size("items").cast("long").alias("items"))


@register(f"SELECT CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d <= 6 THEN 'week' WHEN d <= 30 THEN 'month' ELSE 'older' END AS age, count(*) AS n FROM (SELECT (DATE '{NOW[:10]}' - dismissed_at::DATE) AS d FROM interests WHERE dismissed_at IS NOT NULL) GROUP BY 1", INTERESTS)
def a37_age_groups(s, d):
    return lists.age_groups(interests(s, d).filter("dismissed_at is not null"), "dismissed_at", NOW[:10])


@register("SELECT deal_id, array_to_string(list_transform(string_split(product_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM live", DEALS, ACTIVE)
def st10_display_names(s, d):
    none = F.lit(None).cast("string")
    return live(s, d).select("deal_id", lists.display_name(none, none, F.concat("store", F.lit(" "), "product_name"), F.col("store")).alias("name"))


@register("SELECT deal_id, CASE line % 3 WHEN 0 THEN k || ' g' WHEN 1 THEN '6 x ' || (k::INT * 10) || ' ml' END AS pack, printf('%.2f', sale_price) || ' / x' AS price FROM (SELECT *, CASE line % 3 WHEN 1 THEN regexp_extract(product_name, '6x(\\d+)cl', 1) ELSE regexp_extract(product_name, '(\\d+)g$', 1) END AS k FROM live)".replace("\\\\", "\\"), DEALS, ACTIVE)
def n11_pack_texts(s, d):
    al = live(s, d)
    read_once = ingest.with_unit_price(al.select("product_name", F.lit(1.0).alias("p"), F.lit(None).cast("string").alias("none")).distinct(), "product_name", "p", "none")
    packs = read_once.groupBy("product_name").agg(*(F.first(c).alias(c) for c in ("pack_size", "unit_volume_ml", "unit_weight_g")))
    pack = lists.pack_text(F.col("pack_size"), F.col("unit_volume_ml"), F.col("unit_weight_g"))
    return al.join(packs, "product_name").select("deal_id", pack.alias("pack"), lists.per_unit_text(F.col("sale_price"), F.lit("x")).alias("price"))


@register(
    """SELECT coalesce(string_agg(category || ': ' || winner, ' · ' ORDER BY category), '') AS line, sum(n)::BIGINT AS deals FROM (SELECT category, sum(n) AS n, CASE WHEN count(*) > 1 AND NOT (max(CASE WHEN p = 1 THEN n END) < 5 OR max(CASE WHEN p = 1 THEN a END) - max(CASE WHEN p = 2 THEN a END) < 2) THEN max(CASE WHEN p = 1 THEN store END) END AS winner
      FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY a DESC, n DESC, store) p FROM (SELECT category, store, avg(discount_percent) a, count(*) n FROM live GROUP BY ALL)) GROUP BY category)""",
    DEALS, ACTIVE,
)
def st13_summary(s, d):
    return lists.summary(verdict.verdicts(live(s, d), V.CATEGORIES))


@register("SELECT deal_id, coalesce(CASE sub_category WHEN 'bolt' THEN 'Schraube' WHEN 'ring' THEN 'Ring' END, sub_category) AS label FROM live", DEALS, ACTIVE)
def st15_labels(s, d):
    labels = s.sql("SELECT * FROM (VALUES ('bolt', 'de', 'Schraube'), ('ring', 'de', 'Ring'), ('bolt', 'en', 'Bolt')) l(key, locale, label)")
    return lists.labelled(live(s, d), "sub_category", labels, "de").select("deal_id", "label")


@register("SELECT * FROM (VALUES ('water', 'L', 'still'), ('dairy', 'L', 'whole'), ('juice', 'L', '100pct'), ('bread', 'kg', 'loaf'), ('poultry', 'kg', 'fresh'), ('coffee', '100g', 'beans'), ('eggs', 'piece', 'medium')) t(sub_category, canonical_unit, default_format)")
def cl17_schemas(s, d):
    return lists.schemas(table(s, d, "region"))


@register("SELECT p_partkey FROM part WHERE p_size = 12")
def f24_variants(s, d):
    p = table(s, d, "part").select("p_partkey", F.col("p_size").alias("volume_ml"), F.col("p_brand").alias("origin"), (F.col("p_size") % 2 == 0).alias("is_organic"))
    return lists.variants(p, 12, is_organic=True).select("p_partkey")


@register("SELECT (SELECT string_agg(x::VARCHAR, ',' ORDER BY x) FROM (SELECT DISTINCT p_size AS x FROM part)) AS volumes, (SELECT count(DISTINCT p_brand) FROM part) AS origins")
def a32_axis_values(s, d):
    v = lists.axis_values(table(s, d, "part").select(F.col("p_size").alias("volume_ml"), F.col("p_brand").alias("origin")))
    return v.select(F.array_join(F.transform("volumes", lambda x: x.cast("string")), ",").alias("volumes"), F.size("origins").cast("long").alias("origins"))


@register("SELECT p_partkey AS item_id, CASE WHEN p_partkey % 50 = 0 THEN 'special' WHEN p_size % 2 = 0 AND split_part(p_name, ' ', 2) IN ('bolt', 'gear') THEN 'metal' WHEN split_part(p_name, ' ', 1) = 'red' THEN 'colour' WHEN p_type = 'SMALL' THEN 'small things' END AS browse FROM part")
def cl14_browse_category(s, d):
    p = table(s, d, "part")
    word = lambda k: F.element_at(F.split("p_name", " "), k)
    items = p.select(F.col("p_partkey").alias("item_id"), word(1).alias("keyword"), F.col("p_type").alias("category"), F.when(F.col("p_size") % 2 == 0, word(2)).alias("product_group_id"))
    special = items.filter("item_id % 50 = 0").select("item_id", F.lit("special").alias("browse"))
    groups = items.select(F.col("product_group_id").alias("group_id")).filter("group_id is not null").distinct().withColumn("sub_category", F.col("group_id"))
    sql = lambda q: s.sql(f"SELECT * FROM (VALUES {q}")
    return lists.browse_category(items, special, groups, sql("('red', 'colour')) k(keyword, browse)"), sql("('SMALL', 'small things')) l(category, browse)"), sql("('metal', array('bolt', 'gear'))) b(category, sub_categories)"))


@register("SELECT c_custkey, coalesce(CASE WHEN c_nationkey % 3 = 0 THEN 'success' END, 'skipped') AS migros, coalesce(CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey END, 0) AS coop FROM customer")
def u9_fold_statuses(s, d):
    n = F.col("c_nationkey")
    runs = table(s, d, "customer").select("c_custkey", F.when(n % 3 == 0, "success").alias("migros_status"), n.alias("migros_count"), F.lit("failed").alias("coop_status"), F.when(n % 2 == 0, n).alias("coop_count"))
    m = F.col("store_results")
    return lists.fold_statuses(runs, ("migros", "coop")).select("c_custkey", m["migros"]["status"].alias("migros"), m["coop"]["count"].alias("coop"))


@register("SELECT count(*) AS deals, count(DISTINCT product_name) AS concepts, (SELECT count(*) FROM (SELECT DISTINCT store, product_name FROM live)) AS skus FROM live", DEALS, ACTIVE)
def u17_concept_layer(s, d):
    rules = s.sql("SELECT CAST(NULL AS string) id, CAST(NULL AS string) rule_type, CAST(NULL AS string) pattern, CAST(NULL AS bigint) concept_id, 0 priority, false is_active WHERE false")
    concepts, unit, linked = lists.populate_concepts(live(s, d), rules)
    one = linked.filter("sku_id is not null").agg(F.count("*").alias("deals"))
    return one.crossJoin(F.broadcast(concepts.agg(F.count("*").alias("concepts")))).crossJoin(F.broadcast(unit.agg(F.count("*").alias("skus"))))


@register(f"SELECT deal_id, CASE WHEN d < 7 THEN 'this week' WHEN d < 28 THEN (d // 7) || CASE d // 7 WHEN 1 THEN ' week ago' ELSE ' weeks ago' END ELSE greatest(1, d // 30) || CASE WHEN d // 30 <= 1 THEN ' month ago' ELSE ' months ago' END END AS line FROM (SELECT deal_id, (DATE '{AS_OF}' - valid_from) AS d FROM live)", DEALS, ACTIVE)
def st12_signal_lines(s, d):
    days = F.datediff(F.lit(AS_OF).cast("date"), F.col("valid_from"))
    return live(s, d).select("deal_id", text.signal_line(days).alias("line"))


@register("SELECT user_id, event_id, deal_id FROM (SELECT user_id, event_id, deal_id, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, deal_id, event_id) n FROM (SELECT i.user_id, i.event_id, c.deal_id, c.discount_percent * 1000000 - i.event_id AS s FROM interests i JOIN cheapest c ON c.concept_id = i.concept_id)) WHERE n <= 3", DEALS, ACTIVE, CHEAPEST, INTERESTS)
def o10_above_fold(s, d):
    j = interests(s, d).join(cheapest(s, d), "concept_id").withColumn("s", F.col("discount_percent") * 1000000 - F.col("event_id"))
    return lists.above_fold(j, ["user_id"], "s").select("user_id", "event_id", "deal_id")


@register("SELECT event_id, c.deal_id, coalesce('P' || p_partkey, '—') AS display_name FROM interests i JOIN cheapest c ON c.concept_id = i.concept_id LEFT JOIN part ON p_partkey = i.concept_id AND p_size > 10", DEALS, ACTIVE, CHEAPEST, INTERESTS)
def j8_hydrate(s, d):
    c = interests(s, d).join(cheapest(s, d).select("concept_id", "deal_id"), "concept_id")
    names = table(s, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("concept_id"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("display_name"))
    return suggest.hydrate(c, names, deals(s, d).withColumn("image_url", F.lit(None).cast("string"))).select("event_id", "deal_id", "display_name")


@register("SELECT kw AS item_id, store, deal_id FROM (SELECT kw, store, deal_id, row_number() OVER (PARTITION BY kw, store ORDER BY discount_percent DESC, deal_id) n FROM live, (VALUES ('gear')) k(kw) WHERE product_group = kw AND discount_percent > 0) WHERE n = 1", DEALS, ACTIVE)
def j15_group_matches(s, d):
    al = live(s, d).withColumn("product_id", F.concat_ws("|", "store", "p_name"))
    products = deals(s, d).select(F.concat_ws("|", "store", "p_name").alias("product_id"), "product_group").distinct()
    items = basket(al).filter("product_group_id is not null").select("item_id", "product_group_id")
    return compare.group_matches(items, al, products.withColumn("product_group", F.col("product_group"))).select("item_id", "store", "deal_id")


@register(f"SELECT count(*) FILTER (WHERE valid_from <= DATE '{WEEK}') < 4 OR max(valid_from) FILTER (WHERE valid_from <= DATE '{WEEK}') IS NULL OR (SELECT TIMESTAMP '{AS_OF}' - max(o_orderdate) > INTERVAL 14 DAY FROM orders) AS use_defaults FROM deals", DEALS)
def f26_default_tiles(s, d):
    tiles = deals(s, d).filter(F.col("valid_from") <= F.lit(WEEK).cast("date"))
    runs = table(s, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("started_at"))
    return read.default_tiles(tiles, runs, AS_OF)


@register("SELECT deal_id, floor(CASE WHEN first_unit = canonical_unit AND place > 1 THEN price_per_unit - first_price END * 1e6 + 0.5) / 1e6 AS delta FROM (SELECT *, first_value(canonical_unit) OVER w AS first_unit, first_value(price_per_unit) OVER w AS first_price FROM (SELECT deal_id, place, band, CASE line % 3 WHEN 0 THEN 'kg' WHEN 1 THEN 'L' ELSE 'piece' END AS canonical_unit, sale_price AS price_per_unit FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY is_promo DESC, sale_price, deal_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY band, store ORDER BY is_promo DESC, sale_price, deal_id) n FROM (SELECT *, coalesce(sub_category, 'other') AS band, discount_percent > 0 AS is_promo FROM live)) WHERE n = 1)) WINDOW w AS (PARTITION BY band ORDER BY place))", DEALS, ACTIVE)
def n12_hero_delta(s, d):
    b = compare.bands(live(s, d).withColumn("is_promo", F.col("discount_percent") > 0))
    k = F.col("line") % 3
    b = b.withColumn("canonical_unit", F.when(k == 0, "kg").when(k == 1, "L").otherwise("piece")).withColumn("price_per_unit", F.col("sale_price"))
    return compare.hero_delta(b).select("deal_id", r6(F.col("delta")).alias("delta"))


@register("SELECT CASE line % 3 WHEN 0 THEN 'still' ELSE 'sparkling' END AS format, count(*) AS n FROM live WHERE line % 3 < 2 GROUP BY 1", DEALS, ACTIVE)
def a34_format_chips(s, d):
    k = F.col("line") % 3
    f = live(s, d).withColumn("format", F.when(k == 0, "still").when(k == 1, "sparkling").otherwise("odd"))
    return lists.format_chips(f, ("still", "sparkling", "lightly-sparkling"))


@register("SELECT CASE line % 3 WHEN 0 THEN 'still' WHEN 1 THEN 'sparkling' ELSE 'odd' END AS format, count(*) AS n FROM live GROUP BY 1 ORDER BY format = 'still' DESC, n DESC, format LIMIT 1", DEALS, ACTIVE)
def a33_default_format(s, d):
    k = F.col("line") % 3
    f = live(s, d).withColumn("format", F.when(k == 0, "still").when(k == 1, "sparkling").otherwise("odd"))
    return compare.default_format(f, "still")


@register("SELECT deal_id, md5(store || '|' || product_name) AS sku FROM live", DEALS, ACTIVE)
def j19_attach_skus(s, d):
    al = live(s, d)
    unit = resolve.skus(al).withColumn("sku_id", F.md5(F.concat_ws("|", "store", "product_name")))
    return resolve.attach_skus(al, unit).select("deal_id", F.col("sku_id").alias("sku"))


# --- orders, guards, stamps

COMPARED = """compared AS (SELECT *, CASE WHEN lows > 1 THEN 'tie' ELSE low_store END AS best_store FROM (SELECT *, count(*) FILTER (WHERE sale_price = low) OVER w AS lows, max(CASE WHEN sale_price = low THEN store END) OVER w AS low_store
  FROM (SELECT *, count(*) OVER w AS stores, min(sale_price) OVER w AS low FROM (SELECT product_group AS "group", store, deal_id, sale_price, discount_percent, row_number() OVER (PARTITION BY product_group, store ORDER BY discount_percent DESC, deal_id) n FROM live) WHERE n = 1 WINDOW w AS (PARTITION BY "group"))
  WHERE stores >= 2 WINDOW w AS (PARTITION BY "group")))"""
STORE_LIST = quoted(V.STORES)


@register(f"""SELECT "group", store, row_number() OVER (PARTITION BY "group" ORDER BY store = best_store DESC, sale_price, list_position([{STORE_LIST}], store))::INT AS place FROM compared""", DEALS, ACTIVE, COMPARED)
def o6_comparison_rows(s, d):
    return compare.rows_in_order(compare.group_comparisons(*with_products(s, d))).select("group", "store", "place")


@register(
    """SELECT "group", kind, best_discount, (row_number() OVER (ORDER BY kind = 'product-group' DESC, best_discount DESC, "group"))::INT AS place FROM (SELECT "group", 'product-group' AS kind, max(discount_percent) AS best_discount FROM compared GROUP BY 1
    UNION ALL SELECT 'ns-' || store, 'name-similarity', max(discount_percent) FROM live GROUP BY store)""",
    DEALS, ACTIVE, COMPARED,
)
def o7_comparison_list(s, d):
    groups = compare.group_comparisons(*with_products(s, d)).select("group", F.lit("product-group").alias("kind"), "discount_percent")
    names = live(s, d).select(F.concat(F.lit("ns-"), "store").alias("group"), F.lit("name-similarity").alias("kind"), "discount_percent")
    return compare.in_order(groups.unionByName(names)).withColumn("place", F.col("place").cast("int"))


@register("SELECT deal_id, discount_percent FROM live ORDER BY discount_percent DESC, deal_id LIMIT 50 OFFSET 50", DEALS, ACTIVE)
def o9_second_page(s, d):
    return read.page(live(s, d), "discount", 1).select("deal_id", "discount_percent")


@register("SELECT user_id AS list_id, event_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY added_at, event_id)::INT AS place FROM interests", INTERESTS)
def o13_items_in_order(s, d):
    items = interests(s, d).select(F.col("user_id").alias("list_id"), F.col("event_id").alias("item"), F.col("added_at").alias("created_at"))
    return lists.in_order_of_creation(items).select("list_id", "item", "place")


@register("SELECT p_partkey AS concept_id, p_name AS display_name, rank() OVER (PARTITION BY p_brand ORDER BY lower(p_name), p_name, p_partkey)::INT AS place FROM part")
def o11_concepts_by_name(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("display_name"), "p_brand")
    return lists.by_display_name(p, "p_brand").select("concept_id", "display_name", "place")


@register(f"SELECT user_id, event_id, deal_id FROM (SELECT user_id, event_id, deal_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) n FROM (SELECT *, exp(-(epoch_us(TIMESTAMP '{NOW}') - epoch_us(added_at)) / 2592000000000.0) * discount_percent AS score FROM interests i JOIN cheapest c ON c.concept_id = i.concept_id WHERE dismissed_at IS NULL AND added_at > TIMESTAMP '{NOW}' - INTERVAL 90 DAY AND discount_percent >= 30)) WHERE n <= 10", DEALS, ACTIVE, CHEAPEST, INTERESTS)
def o3_personal(s, d):
    return suggest.personal_all(suggest.candidates(interests(s, d), cheapest(s, d), NOW)).select("user_id", "event_id", "deal_id")


@register(f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ['coop', 'lidl'] WHEN c_custkey % 3 = 1 THEN ['lidl'] ELSE ['coop'] END AS stores, list_contains([{quoted(read.CANTONS)}], CASE WHEN c_nationkey % 2 = 0 THEN 'ZH' ELSE 'XX' END) AS known FROM customer")
def f22_region_guard(s, d):
    k, n = F.col("c_custkey") % 3, F.col("c_nationkey")
    a = lambda *xs: F.array(*(F.lit(x) for x in xs))
    chosen, covered = F.when(k == 0, a("migros")).when(k == 1, a("migros", "lidl")).otherwise(a("coop", "aldi")), a("coop", "lidl")
    return table(s, d, "customer").select("c_custkey", read.guarded_stores(chosen, covered).alias("stores"), read.valid_canton(F.when(n % 2 == 0, "ZH").otherwise("XX")).alias("known"))


@register("SELECT l_orderkey, l_linenumber, CASE WHEN even THEN high ELSE low END AS q, CASE WHEN even AND high <> low - (l_orderkey % 2 = 0)::INT THEN 'now' ELSE 'then' END AS updated_at FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS low, max(l_quantity) AS high, l_linenumber % 2 = 0 AS even FROM lineitem GROUP BY ALL)")
def u6_touched(s, d):
    """Even lines were there before, some with another quantity; odd ones are new."""
    g = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))
    even, then = F.col("l_linenumber") % 2 == 0, F.lit("then").alias("updated_at")
    after = g.select("l_orderkey", "l_linenumber", F.when(even, F.col("high")).otherwise(F.col("low")).alias("q"), then)
    before = g.filter(even).select("l_orderkey", "l_linenumber", (F.col("low") - F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(0)).alias("q"), then)
    return store.touched(before, after, ["l_orderkey", "l_linenumber"], "now")


@register(f"SELECT p_partkey::VARCHAR AS deal_id, split_part(x, '|', 1) AS category, nullif(split_part(x, '|', 2), '') AS sub_category FROM (SELECT *, {sql_cases()} AS x FROM labelled WHERE p_partkey % 3 > 0) WHERE split_part(x, '|', 1) <> 'fresh' OR nullif(split_part(x, '|', 2), '') IS DISTINCT FROM 'dairy'", LABELLED)
def u10_recategorised(s, d):
    p = F.col("p_partkey")
    held = labelled(s, d).select(p.cast("string").alias("deal_id"), F.col("name").alias("product_name"), F.col("label").alias("source_category"), F.lit("fresh").alias("category"), F.lit("dairy").alias("sub_category"), (p % 3 > 0).alias("is_active"))
    return ingest.recategorised(held, DEMO_RULES)


@register("SELECT c_custkey AS id, c_nationkey::BIGINT AS total_stored, c_custkey % 7 AS duration_ms FROM customer")
def p7_public_runs(s, d):
    runs = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(NOW).alias("run_at"), F.lit("x").alias("store_results"), F.col("c_nationkey").cast("long").alias("total_stored"), (F.col("c_custkey") % 7).alias("duration_ms"), F.lit("secret").alias("error_log"))
    return ingest.public_runs(runs).drop("run_at", "store_results")


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'next week!' ELSE strftime(o_orderdate, '%-d.%m.%y') END AS said FROM orders")
def dt7_short_dates(s, d):
    text_date = F.when(F.col("o_orderkey") % 7 == 0, "next week!").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(s, d, "orders").select("o_orderkey", units.short_date(text_date, "d.MM.yy").alias("said"))


BRANDED = ("Emmi", "bio zweifel", "coop naturaplan", "x-lindt", "Thomy senf", "M-Budget")


@register(f"SELECT p_partkey, CASE WHEN k = 0 THEN 'Emmi' WHEN k = 1 THEN 'Zweifel' WHEN k = 2 THEN 'Naturaplan' WHEN k = 4 THEN 'Thomy' WHEN k = 5 THEN 'M-Budget' END AS brand, ([{quoted(BRANDED)}])[(k + 1)::INT] || ' ' || p_name AS name FROM (SELECT *, p_partkey % {len(BRANDED)} AS k FROM part)")
def st3_brands(s, d):
    name = F.concat(F.element_at(F.array(*(F.lit(b) for b in BRANDED)), (F.col("p_partkey") % len(BRANDED) + 1).cast("int")), F.lit(" "), "p_name")
    return table(s, d, "part").select("p_partkey", text.brand(name).alias("brand"), name.alias("name"))


@register(f"SELECT p_partkey, regexp_matches(low, '(^|[^a-z0-9_])(bio|naturaplan|demeter|knospe|organic)($|[^a-z0-9_])') AS organic, {sql_any_sub()} AS sub_category FROM labelled", LABELLED)
def cl11_metadata(s, d):
    m = ingest.with_metadata(labelled(s, d), DEMO_RULES, "name", "label")
    return m.select("p_partkey", "metadata.organic", "metadata.sub_category")


@register("SELECT 'run' AS id, (SELECT count(*) FROM live)::INT AS total_stored, (SELECT count(*) FROM live WHERE store = 'coop')::INT AS coop", DEALS, ACTIVE)
def s9_run_log(s, d):
    log = ingest.run_log(ingest.store_status(live(s, d)), "run", NOW)
    return log.select("id", "total_stored", F.col("store_results")["coop"]["count"].alias("coop"))
