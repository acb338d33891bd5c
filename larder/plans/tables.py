"""Registered queries over stored tables: bucketed merges, views that follow them, indexed search, layouts, ingest runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import objects
from ..functions.values import STORES
from ..operators import index, keyed, read, resolve, run, suggest
from ..operators.steps import shared_folder, step
from ..sources import layout, paged
from .queries import ACTIVE, DEMO_RULES, LABELLED, NEW, REGION, TWO, labelled, live, quoted, raw_rows, register, relevance_sql, sql_cases, sql_grocery, two_tables
from .star import AS_OF, DEALS, deals, store_of, table


def folder(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


@register(f"SELECT coalesce(n.l_orderkey, o.l_orderkey) AS l_orderkey, coalesce(n.l_linenumber, o.l_linenumber) AS l_linenumber, coalesce(n.q, o.q) AS q, coalesce(n.tag, o.tag) AS tag FROM ({TWO}) o FULL JOIN ({NEW}) n ON n.l_orderkey = o.l_orderkey AND n.l_linenumber = o.l_linenumber")
def u1_bucketed_merge(s, d):
    """The merge of u1 into a stored table, twice: the second time nothing changes."""
    old, new = two_tables(s, d)
    path = folder(s, "u1")
    keyed.create(old, path, ["l_orderkey", "l_linenumber"], 16)
    if keyed.merge(new, path).number != keyed.merge(new, path).number:
        raise RuntimeError("a replay wrote a state")
    return keyed.read(s, path)


RUNS = ("2001-09-17", "2001-10-01", AS_OF)


def weekly(s: SparkSession, d: str) -> DataFrame:
    return deals(s, d, placed=True).select("concept_id", "deal_id", resolve.region_of(F.col("store")).alias("region"), "store", "sale_price", "is_active", "valid_from", "valid_to")


@register(
    f"""SELECT concept_id, region, deal_id, sale_price FROM (SELECT *, row_number() OVER (PARTITION BY concept_id, region ORDER BY sale_price, deal_id) n FROM (
      SELECT concept_id, {REGION} AS region, deal_id, sale_price * CASE WHEN store = 'spar' AND valid_from <= DATE '{RUNS[1]}' AND valid_to >= DATE '{RUNS[1]}' THEN 2 ELSE 1 END AS sale_price FROM live WHERE valid_from <= DATE '{RUNS[2]}')) WHERE n = 1""",
    DEALS, ACTIVE,
)
def u13_incremental_view(s, d):
    """The cheapest-now view after three weekly runs of inserts, a rise of prices and expiry, kept up to date by what changed."""
    rows, table, view = weekly(s, d), folder(s, "u13-deals"), folder(s, "u13-view")  # a run's days reach the scan, so no run makes the others' rows

    def cheapest(own: DataFrame) -> DataFrame:
        return suggest.cheapest_now(own.filter("valid_to is not null"), "1900-01-01").select("concept_id", "region", "deal_id", "sale_price")

    done = None
    for k, day in enumerate(RUNS):
        came = rows.filter(F.col("valid_from") <= F.lit(day).cast("date"))
        if k:
            keyed.merge(came.filter(F.col("valid_from") > F.lit(RUNS[k - 1]).cast("date")), table)
        else:
            keyed.create(came, table, ["concept_id", "deal_id"], 16, by=["concept_id"])
        if k == 1:
            keyed.update_later(s, table, f"store = 'spar' AND valid_to >= DATE '{day}'", {"sale_price": "sale_price * 2"})
        keyed.expire(s, table, day)
        done = keyed.refresh(s, view, table, ["concept_id", "region"], cheapest, done).number
    return keyed.read(s, view)


@register(
    """SELECT 'gear' AS query, name, product_id, deal_id, 4 AS relevance FROM (SELECT p.product_id, p.product_name AS name, b.deal_id, row_number() OVER (ORDER BY b.deal_id IS NULL, r.relevance DESC, p.regular_price, p.product_id) n
      FROM (SELECT store || '|' || product_name AS product_id, product_name, min(original_price) AS regular_price FROM deals WHERE product_group = 'gear' GROUP BY ALL) p JOIN rel r ON r.product_name = p.product_name AND r.kw = 'gear'
      LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY discount_percent DESC, deal_id) r FROM (SELECT store || '|' || product_name AS product_id, * FROM live)) b ON b.product_id = p.product_id AND b.r = 1) WHERE n <= 8
    UNION ALL SELECT * FROM (SELECT 'small', product_name, NULL, deal_id, relevance FROM (SELECT l.product_name, l.deal_id, r.relevance::INT AS relevance, row_number() OVER (PARTITION BY l.product_name ORDER BY discount_percent DESC, deal_id) n
      FROM live l JOIN rel r ON r.product_name = l.product_name AND r.kw = 'small' AND r.relevance >= 3 WHERE category <> 'non-food') WHERE n = 1 ORDER BY relevance DESC, product_name, deal_id LIMIT 20)""",
    DEALS, ACTIVE, relevance_sql("gear", "small"),
)
def j21_indexed_search(s, d):
    """Two searches on stored indexes: one finds a group and its products, the other deals of no group."""
    slim = deals(s, d).select("deal_id", "store", "product_name", "product_group", "category", "discount_percent", "original_price", "is_active", "valid_to")
    al = step(slim.withColumn("product_id", F.concat_ws("|", "store", "product_name")), "j21-deals")
    products = step(al.groupBy("product_id", F.col("product_name").alias("source_name"), "product_group").agg(F.min("original_price").alias("regular_price")), "j21-products")
    label = F.col("product_group").alias("label")
    groups = products.select(F.col("product_group").alias("group_id"), label).distinct().withColumns({"search_keywords": F.array("label"), "exclude_keywords": F.when(F.col("label") == "ring", F.array(F.lit("gear")))})
    labels, names, offers = folder(s, "labels"), folder(s, "names"), read.active(al, AS_OF)
    index.build(groups.select("label"), labels, "label", 16)
    index.build(products, names, "source_name", 32)
    found = [index.search(s, q, groups, products, offers, labels, names).select(F.lit(q).alias("query"), "name", "product_id", "deal_id", "relevance") for q in ("gear", "small")]
    return found[0].unionByName(found[1])


@register("SELECT deal_id, store, sale_price FROM deals WHERE is_active AND category = 'fresh' AND store = 'coop' UNION ALL SELECT deal_id, store, sale_price FROM (SELECT * FROM deals WHERE is_active ORDER BY deal_id LIMIT 3)", DEALS)
def u18_layout(s, d):
    """Active deals of a category and store, and three by id, read from files laid out for that."""
    path = folder(s, "u18")
    layout.write_deals(deals(s, d), path)
    three = [r["deal_id"] for r in layout.active_of(s, path).orderBy("deal_id").select("deal_id").limit(3).collect()]
    return layout.active_of(s, path, "fresh", "coop").unionByName(layout.active_of(s, path, ids=three)).select("deal_id", "store", "sale_price")


@register(
    f"""SELECT page_id, store, number FROM (SELECT *, min(CASE WHEN items = 0 THEN number END) OVER (PARTITION BY store) AS stop FROM (SELECT page_id, ([{quoted(STORES)}])[(page_id % 7 + 1)::INT] AS store, page_id // 7 + 1 AS number, len(regexp_extract_all(html, '<p>')) - 1 AS items FROM pages) WHERE number <= 60)
    WHERE stop IS NULL OR number < stop"""
)
def s2_pages_until_empty(s, d):
    """Pages as seven stores' listings, read up to each store's first page without a paragraph of its own."""
    pages = table(s, d, "pages").select("page_id", store_of(F.col("page_id")).alias("store"), (F.floor(F.col("page_id") / 7) + 1).alias("number"), "html")
    return paged.until_empty(pages, "store", "number", F.regexp_count("html", F.lit("<p>")) - 1).select("page_id", "store", "number")


@register("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08)")
def s12_details(s, d):
    ids = table(s, d, "lineitem").filter("l_discount > 0.08").select(F.col("l_partkey").alias("p_partkey"))
    return paged.wanted_details(ids, table(s, d, "part").select("p_partkey", "p_name"), "p_partkey")


RAW_FEED = f"""raw AS (SELECT l_orderkey % 11 AS kind, CASE WHEN l_orderkey % 11 = 0 THEN 'nowhere' ELSE ([{quoted(STORES)}])[(l_suppkey % 7 + 1)::INT] END AS store, CASE WHEN l_orderkey % 11 = 1 THEN '' ELSE name END AS name, label, l_shipdate::DATE AS day
  FROM lineitem JOIN (SELECT DISTINCT p_partkey, name, label FROM labelled) ON p_partkey = l_partkey),
judged AS (SELECT *, kind NOT IN (0, 1, 2, 3, 4, 6, 7) AS valid, {sql_grocery()} IS NULL AS keep, split_part({sql_cases()}, '|', 2) AS sub FROM (SELECT *, lower(name) AS low, lower(label) AS lab FROM raw))"""


@register(
    """SELECT count(*) AS read, count(*) FILTER (WHERE valid) AS valid, count(*) FILTER (WHERE valid AND keep) AS kept, count(*) FILTER (WHERE valid AND keep AND sub IN ('dairy', 'beer')) AS mapped, count(DISTINCT (store, low, day)) FILTER (WHERE valid AND keep) AS stored,
    count(*) FILTER (WHERE store = 'coop') AS read_coop, (SELECT count(DISTINCT (sub, store)) FROM judged WHERE valid AND keep AND sub <> '' AND sub NOT IN ('dairy', 'beer')) AS unknown, 'run' AS logged FROM judged""",
    LABELLED, RAW_FEED,
)
def f1_weekly_run(s, d):
    """A weekly ingest of line items as feed rows: what it observed while it wrote, and that its log has it."""
    named = labelled(s, d).distinct().withColumnRenamed("label", "sourceCategory")
    raw = raw_rows(s, d).join(named, F.col("l_partkey") == F.col("p_partkey")).withColumn("productName", F.when(F.col("productName") == "", "").otherwise(F.col("name")))
    aliases = s.sql("SELECT * FROM (VALUES ('DAIRY', 'milk', NULL), ('beer', 'drinks', NULL)) a(source_tag, category_slug, subcategory_slug)")
    log = folder(s, "runs")
    done = run.weekly(raw, folder(s, "deals"), log, "run", AS_OF + " 06:00:00", DEMO_RULES, aliases, least=0.0)
    n = {k: done.numbers[k] for k in ("read", "valid", "kept", "mapped", "stored", "read_coop")}
    logged = s.read.parquet(log).filter(F.col("total_stored") == n["stored"]).select(F.col("id").alias("logged"))
    return done.unknown.agg(F.count("*").alias("unknown")).crossJoin(F.broadcast(logged)).select(*(F.lit(v).cast("long").alias(k) for k, v in n.items()), "unknown", "logged")


@register(
    """SELECT event_id, CASE WHEN event_type <> 'signup' AND event_type <> 'purchase' AND event_type <> 'view' THEN json_extract_string(props, '$.k') END AS k, event_type = 'view' AS k_is_null, CASE WHEN event_type IN ('click', 'view', 'error') THEN true END AS has_k,
    CASE event_type WHEN 'click' THEN 'true' END AS deep, CASE event_type WHEN 'click' THEN '{"deep":{"a":[true],"b":null},"tag":"c"}' WHEN 'view' THEN '{}' WHEN 'error' THEN '{"new":[true]}' END AS left_json FROM events"""
)
def aj3_objects(s, d):
    """Documents of unlike shape merged, set by path, less a field: objects, JSON null, arrays, and texts that are no JSON."""
    kind = F.col("event_type")
    more = F.when(kind == "click", '{"tag":"c","deep":{"a":1,"b":null}}').when(kind == "view", '{"k":null}').when(kind == "error", "[1,2]").otherwise("no json")
    both = table(s, d, "events").select("event_id", kind, objects.merge(objects.parse(F.col("props")), objects.parse(more)).alias("v"))
    value, v = F.parse_json(F.lit("[true]")), F.col("v")
    changed = both.withColumn("w", F.when(kind == "error", objects.put(v, ["new"], value)).otherwise(objects.put(objects.put(v, ["deep", "a"], value), ["new"], value, create=False)))
    return changed.select("event_id", objects.text_at(v, "$.k").alias("k"), objects.json_null(v, "$.k").alias("k_is_null"), objects.present(v, "k").alias("has_k"), objects.text_at(F.col("w"), "$.deep.a[0]").alias("deep"), F.to_json(objects.without(F.col("w"), "k")).alias("left_json"))
