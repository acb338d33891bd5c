"""Frames in, frames out: small cases of every family."""

import datetime as dt
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from larder.functions.values import STORES
from larder.operators import compare, ingest, keyed, ranks, read, resolve, store, suggest, verdict
from larder.operators import terms as terms_in
from larder.sources import cards, feeds
from larder.sources import rules as keyword_rules
from larder.streaming import ingest as streaming

from . import plain

DEAL = "deal_id string, store string, product_name string, category string, sub_category string, category_slug string, discount_percent int, sale_price double, valid_from date, valid_to date, is_active boolean, updated_at timestamp_ntz, concept_id long"


def deals(spark, *rows):
    base = dict(store="migros", product_name="x", category="fresh", sub_category=None, category_slug=None, discount_percent=10, sale_price=1.0, valid_from=dt.date(2026, 4, 1), valid_to=dt.date(2026, 4, 30), is_active=True, updated_at=dt.datetime(2026, 4, 2), concept_id=1)
    names = [c.strip().split()[0] for c in DEAL.split(",")]
    return spark.createDataFrame([tuple((base | {"deal_id": str(k)} | r)[n] for n in names) for k, r in enumerate(rows)], DEAL)


def raw(**over):
    return dict(store="coop", productName="butter 250g", originalPrice=4.5, salePrice=2.95, discountPercent=34.0, validFrom="2026-04-07", validTo="2026-04-13") | over


@pytest.mark.parametrize(
    "over, ok",
    [
        ({}, True), ({"store": "nowhere"}, False), ({"store": None}, False), ({"productName": ""}, False), ({"salePrice": 0.0}, False), ({"salePrice": -1.0}, False), ({"salePrice": float("nan")}, False), ({"salePrice": float("inf")}, False), ({"salePrice": None}, False),
        ({"validFrom": "7.4.2026"}, False), ({"validFrom": None}, False), ({"validFrom": "2026-02-31"}, False), ({"validTo": None}, True), ({"validTo": "2026-04-01"}, False), ({"validTo": "x"}, False), ({"discountPercent": None}, True), ({"discountPercent": -1.0}, False), ({"discountPercent": 101.0}, False),
        ({"originalPrice": None}, True), ({"originalPrice": float("nan")}, False), ({"originalPrice": 2.0}, False), ({"originalPrice": 2.95}, True),
    ],
)
def test_validation(spark, over, ok):
    row = spark.createDataFrame([tuple(raw(**over).values())], "store string, productName string, originalPrice double, salePrice double, discountPercent double, validFrom string, validTo string")
    assert row.select(ingest.valid_entry().alias("v")).first().v is ok


def verdict_of(spark, *groups):
    rows = [dict(store=s, discount_percent=p) for s, n, p in groups for _ in range(n)]
    return {r.category: r for r in verdict.verdicts(deals(spark, *rows), ("fresh", "non-food")).collect()}


def test_verdict_states(spark):
    assert verdict_of(spark, ("migros", 6, 35), ("coop", 6, 20))["fresh"][1:3] == ("winner", "migros")
    assert verdict_of(spark, ("migros", 6, 25), ("coop", 6, 24))["fresh"].state == "tied"
    assert verdict_of(spark, ("migros", 2, 60), ("coop", 30, 20))["fresh"].state == "tied"
    one = verdict_of(spark, ("migros", 6, 35))
    assert one["fresh"].state == "single-store" and one["non-food"][1:] == ("no-data", None, 0.0, 0)


def test_weighted_verdict(spark):
    rows = lambda *g: deals(spark, *(dict(store=s, discount_percent=p) for s, n, p in g for _ in range(n)))
    first = lambda df: verdict.weighted_verdicts(df, ("fresh",)).first()
    assert first(rows(("migros", 5, 40), ("coop", 3, 20))).winner == "migros"
    assert first(rows(("migros", 5, 40), ("coop", 2, 60))).state == "tie" and first(rows(("migros", 5, 40), ("coop", 5, 39))).state == "tie"
    assert deals(spark, dict(discount_percent=10), dict(discount_percent=15)).agg(verdict.average(F.col("discount_percent")).alias("a")).first().a == 13


def test_facets(spark):
    d = deals(spark, dict(sub_category="Cheese", category_slug="dairy"), dict(sub_category="Apples", category_slug="fruit", store="coop"), dict(sub_category="Bread", store="coop"), dict(sub_category=" "))
    f = read.Filters.parse("stores=migros")
    assert [tuple(r) for r in read.sub_category_counts(d, f).collect()] == [("Cheese", 1), ("Apples", 0), ("Bread", 0)]
    assert [tuple(r) for r in read.category_counts(d, f).collect()] == [("dairy", 1), ("fruit", 0)]
    assert {tuple(r) for r in read.store_counts(d, f).collect()} == {("migros", 2), ("coop", 2)}
    assert {r.category: r.n for r in read.type_counts(d).collect()} == {"fresh": 4, "all": 4}


def test_filters_parse_and_serialize():
    f = read.Filters.parse("type=long-life&stores=migros,nowhere&q=milch")
    assert (f.type, f.stores, f.active_count(), f.is_default()) == ("longlife", ("migros",), 3, False)
    assert read.Filters.parse(f.serialize()) == f and read.Filters.parse("stores=") == read.Filters.parse("type=odd") == read.Filters()
    assert read.Filters.parse("stores=x").stores == () and read.Filters().serialize() == ""


def test_sections(spark):
    d = deals(spark, *(dict(sub_category="a", discount_percent=p) for p in (20, 50, 30)), dict())
    got = [(r.section, r.place, r.discount_percent, r.size) for r in read.sections(d, 1).orderBy("section", "place").collect()]
    assert got == [("Other", 1, 10, 1), ("a", 1, 50, 3), ("a", 2, 30, 3)]


def test_open_end_and_week(spark):
    d = deals(spark, dict(valid_to=None), dict(valid_to=dt.date(2026, 4, 2)), dict(is_active=False))
    ids = lambda df: sorted(r.deal_id for r in df.collect())
    assert ids(read.active(d, "2026-04-03")) == [] and ids(read.active(d, "2026-04-03", keep_open=True)) == ["0"] and ids(read.valid_on(d, "2026-04-02")) == ["0", "1", "2"]


def test_availability_and_totals(spark):
    d = deals(spark, dict(store="coop", sale_price=2.0), dict(store="migros", sale_price=1.0), dict(store="lidl", is_active=False))
    d = d.withColumn("original_price", F.col("sale_price"))
    cells = read.availability(d.select("concept_id"), resolve.skus(d), d, "2026-04-03").orderBy("place").collect()
    assert [(c.store, c.state) for c in cells[:3]] == [("migros", "A"), ("coop", "A"), ("lidl", "B")] and len(cells) == len(STORES) and cells[3].state == "C"
    assert {r.store: r.n for r in read.totals(d).collect()} == dict.fromkeys(STORES, 0) | {"coop": 1, "migros": 1, "lidl": 1, "*": 3}
    nan = spark.createDataFrame([("a", 1.5), ("a", float("nan")), ("b", None)], "store string, price double")
    assert [tuple(r) for r in read.share_totals(nan).collect()] == [("a", 2, 1.5), ("b", 1, 0.0)]


def test_upsert_is_idempotent(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 0)], "k int, v string, created int")
    s = spark.createDataFrame([(2, "B", 9), (3, "c", 3), (None, "N", 9)], "k int, v string, created int")
    once = store.upsert(t, s, ["k"], keep=("created",))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(once) == sorted([(1, "a", 1), (2, "B", 2), (3, "c", 3), (None, "N", 0)], key=str) == rows(store.upsert(once, s, ["k"], keep=("created",)))
    assert rows(store.insert_ignore(t, s, ["k"])) == sorted([(1, "a", 1), (2, "b", 2), (3, "c", 3), (None, "n", 0)], key=str)


def test_tables_are_swapped(spark, tmp_path):
    path = str(tmp_path / "t")
    store.write_table(spark.range(3).toDF("k"), path)
    store.write_table(store.read_table(spark, path).withColumn("k", F.col("k") + 1), path)
    assert sorted(r.k for r in store.read_table(spark, path).collect()) == [1, 2, 3]
    early = store.read_table(spark, path)
    store.write_table(spark.range(1).toDF("k"), path)
    assert early.count() == 3 and store.read_table(spark, path).count() == 1  # who reads the version before can go on
    for _ in range(2):
        store.write_table(spark.range(2).toDF("k"), path)
    assert len([p for p in os.listdir(path) if p.startswith("v-")]) == 2


def test_expiry_and_backfills(spark):
    d = deals(spark, dict(valid_to=dt.date(2026, 4, 15)), dict(valid_to=dt.date(2026, 4, 16)), dict(valid_to=None))
    gone = lambda now: [r.deal_id for r in store.expire(d, now).filter("not is_active").orderBy("deal_id").collect()]
    assert gone("2026-04-15 21:00:00") == [] and gone("2026-04-15 22:30:00") == ["0"]
    look = spark.createDataFrame([("x", "slug")], "product_name string, category_slug string")
    assert {r.category_slug for r in store.backfill(d, look, ["product_name"], "category_slug").collect()} == {"slug"}
    assert len(store.latest(d, ["store"], "valid_to", "deal_id").collect()) == 1
    with pytest.raises(ValueError):
        ingest.check_ratio(7, 10)
    assert ingest.check_ratio(8, 10) == 0.8


def test_products_and_aliases(spark):
    d = deals(spark, dict(product_name="emmi milch", sub_category="Milk"), dict(product_name="emmi milch", sub_category="milk"), dict(product_name="brot", sub_category="odd"))
    known = spark.createDataFrame([("p1", "migros", "brot")], "id string, store string, source_name string")
    out = resolve.resolve_products(d, known)
    assert {r.product_name: (r.is_new, r.product_id == "p1") for r in out.collect()} == {"emmi milch": (True, False), "brot": (False, True)}
    new = resolve.new_products(out).collect()
    assert len(new) == 1 and (new[0].brand, new[0].canonical_name) == ("Emmi", "Milch")
    alias = spark.createDataFrame([("MILK", "dairy", None)], "source_tag string, category_slug string, subcategory_slug string")
    assert {r.alias_category for r in resolve.alias_taxonomy(d, alias).collect()} == {"dairy", None}
    assert [tuple(r) for r in resolve.unknown_tags(d, alias).collect()] == [("odd", "migros", "brot")]


def test_concept_rules(spark):
    d = deals(spark, dict(product_name="Bio Milch 6x1L"), dict(product_name="brot"), dict(product_name="x"))
    rules = spark.createDataFrame([("a", "contains", "MILCH", 1, 5, True), ("b", "multipack", "milch", 2, 1, True), ("c", "regex", "^BR", 3, 1, True), ("d", "exact", "x", None, 0, True), ("e", "exact", "X", 5, 9, True)], "id string, rule_type string, pattern string, concept_id long, priority int, is_active boolean")
    want = {"0": 2, "1": 3, "2": 5}
    found = lambda more: {r.deal_id: r.rule_concept for r in resolve.resolve_concepts(d, rules.unionByName(spark.createDataFrame(more, rules.schema)) if more else rules).collect()}
    assert found([]) == want
    assert found([("f", "regex", "(", 9, 0, True), ("g", "odd", "x", 8, 0, True), ("h", "contains", "", 7, 8, True), ("i", "brand", "", 6, 8, True)]) == {"0": 2, "1": 3, "2": 7}
    resolve.RULE_BYTES, held = 1, resolve.RULE_BYTES  # a rule a slice
    assert found([("j", "regex", "milch", 10, 0, True), ("k", "regex", "^x$", 11, 0, True)]) == {"0": 10, "1": 3, "2": 11}
    resolve.RULE_BYTES = held
    plan = resolve.rule_matches(d.select(F.col("product_name").alias("__name")).distinct(), rules.filter("rule_type <> 'regex' and pattern <> ''").select(F.col("id").alias("rule_id"), "rule_type", "pattern", F.col("concept_id").alias("rule_concept"), "priority"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Cross") <= 1  # with rules of the empty pattern, a row a kind


def test_ranks(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 5), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(7)
    key = lambda r: (-r[1], r[2])
    assert {r.k: r.place for r in ranks.ranked(df, F.desc("v"), F.asc("k")).collect()} == {r[2]: n for n, r in enumerate(sorted(rows, key=key), 1)}
    want = {r[2]: n for g in ("a", "b", None) for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=key), 1)}
    assert {r.k: r.place for r in ranks.ranked(df, F.desc("v"), F.asc("k"), within="g").collect()} == want
    assert ranks.ranked(df.limit(0), F.asc("k")).collect() == []


def test_suggestions(spark):
    d = deals(spark, dict(sale_price=3.0, discount_percent=40), dict(sale_price=2.0, discount_percent=50)).withColumn("region", F.lit("r"))
    best = suggest.cheapest_now(d, "2026-04-03")
    assert [r.deal_id for r in best.collect()] == ["1"]
    t = dt.datetime(2026, 4, 1)
    seen = spark.createDataFrame([(1, 7, 1, "added", t, None), (2, 7, 1, "added", t, t), (3, 7, 1, "added", dt.datetime(2025, 1, 1), None)], "event_id long, user_id long, concept_id long, signal string, added_at timestamp, dismissed_at timestamp")
    c = suggest.candidates(seen, best, "2026-05-01 00:00:00").collect()
    assert [r.event_id for r in c] == [1] and c[0].score == pytest.approx(50 * 2.718281828 ** -1)
    assert suggest.modes(seen).first()["mode"] == "cold-start"
    named = suggest.hydrate(suggest.candidates(seen, best, "2026-05-01 00:00:00"), spark.createDataFrame([], "concept_id long, display_name string"), d.withColumn("image_url", F.lit("i")))
    assert named.first().display_name == "—" and named.first().image_url == "i"


def test_basket(spark):
    d = deals(spark, dict(product_name="bio milch 1l", sale_price=2.0), dict(product_name="vollmilch 1l", sale_price=1.5, store="coop"), dict(product_name="milchdrink", store="lidl"), dict(product_name="mandelmilch", store="coop", discount_percent=90), dict(product_name="milch", store="spar", discount_percent=0))
    d = d.withColumn("product_id", F.lit(None).cast("string"))
    items = spark.createDataFrame([(1, "milch", ["mandel"], None, None), (2, "brot", None, None, None)], "item_id int, keyword string, exclude array<string>, prefer array<string>, product_group_id string")
    products = spark.createDataFrame([], "product_id string, product_group string, store string, regular_price double")
    got = {r.item_id: (r.best_store, r.deal_id, r.stores) for r in compare.match_basket(items, d, products).collect()}
    assert got == {1: ("coop", "1", 2), 2: ("none", None, 0)}
    assert {r.best_store: r["items"] for r in compare.split_list(compare.match_basket(items, d, products)).collect()} == {"coop": [1], "none": [2]}


def plain_greedy(rows):
    """The same matching, one pair at a time."""
    used, out = set(), []
    for s in STORES:
        for a in sorted((r for r in rows if r["store"] == s), key=lambda r: r["deal_id"]):
            if a["deal_id"] in used:
                continue
            found = [a]
            for t in STORES:
                if t == s:
                    continue
                best, top = None, 0
                for c in sorted((r for r in rows if r["store"] == t and r["deal_id"] not in used), key=lambda r: r["deal_id"]):
                    n = max(plain.relevance(a["product_name"], c["product_name"]), plain.relevance(c["product_name"], a["product_name"]))
                    if c["sub_category"] == a["sub_category"] and n >= 3 and n > top:
                        best, top = c, n
                if best:
                    found.append(best)
            if len(found) > 1:
                used |= {f["deal_id"] for f in found}
                out += [(f"ns-{a['deal_id']}", f["deal_id"]) for f in found]
    return sorted(out)


def plain_outcome(rows):
    """Label and best store of each match of the plain matching."""
    by, out = {r["deal_id"]: r for r in rows}, {}
    for m, _ in plain_greedy(rows):
        own = [by[d] for x, d in plain_greedy(rows) if x == m] if m not in out else None
        if own:
            own.sort(key=lambda r: (f"ns-{r['deal_id']}" != m, STORES.index(r["store"])))
            low = [r["store"] for r in own if r["sale_price"] == min(x["sale_price"] for x in own)]
            out[m] = (min((r["product_name"] for r in own), key=len), low[0] if len(low) == 1 else "tie")
    return out


def once_a_name(rows):
    """The offers that take part: the cheapest of a store and name in a sub-category."""
    first = {}
    for r in sorted(rows, key=lambda r: (r["sale_price"], r["deal_id"])):
        first.setdefault((r["store"], r["product_name"], r["sub_category"]), r)
    return list(first.values())


def test_greedy_names(spark):
    names = ["milch 1l", "bio milch", "vollmilch", "brot", "ruchbrot hell", "brot hell", "käse", "milch", "bio brot", "hell", "1l", "bio"]
    rows = []
    for seed in range(20):  # a sub-category each, one of them null
        rng = random.Random(seed)
        size = rng.randint(2, 40)
        rows += [dict(deal_id=f"{rng.randrange(10**9):09}-{seed}-{k}", store=rng.choice(STORES), product_name=rng.choice(names[: rng.randint(2, 12)]), sale_price=float(rng.randint(1, 3)), sub_category=f"s{seed}" if seed else None) for k in range(size)]
    once = once_a_name(rows)
    got = compare.similar_names(deals(spark, *rows, dict(deal_id="x", store="nowhere", product_name="milch"))).collect()
    assert sorted((r.match_id, r.deal_id) for r in got) == plain_greedy(once) and len(got) > 100
    assert {r.match_id: (r.label, r.best_store) for r in got} == plain_outcome(once)
    assert compare.similar_names(deals(spark, *rows).limit(0)).collect() == []


def test_greedy_names_of_all_live_deals(spark):
    from larder.plans.queries import QUERIES, live

    sf = "/root/testdata/sf0.01"
    rows = [r.asDict() for r in live(spark, sf).select("deal_id", "store", "product_name", "sub_category", "sale_price").collect()]
    got = QUERIES["j18_similar_names"](spark, sf).collect()
    assert sorted((r.match_id, r.deal_id) for r in got) == plain_greedy(once_a_name(rows)) and len(got) > 20


def test_greedy_names_over_many_rounds(spark):
    """A chain of names, each about the next only, whose order lets one offer act at a time at first."""
    words = [f"w{chr(97 + k)}" for k in range(20)]
    rows = [dict(deal_id=f"{k:02}", store=STORES[k % 2], product_name=f"{words[k]} {words[k + 1]}" if k % 2 else words[k], sub_category="c") for k in range(19)]
    _, links = compare.alike_offers(deals(spark, *rows))
    taken = compare.greedy_rounds(links).select("anchor.deal_id", F.col("u.deal_id").alias("of")).collect()
    assert sorted((f"ns-{r.deal_id}", r.of) for r in taken) == plain_greedy(rows) and taken


def test_greedy_names_have_no_group_a_sub_category(spark):
    rows = [dict(deal_id=f"{k:03}", store=STORES[k % 7], product_name=f"milch {k % 40}", sub_category="one") for k in range(200)]
    df = compare.similar_names(deals(spark, *rows))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FlatMap" not in plan and "Python" not in plan
    assert sorted((r.match_id, r.deal_id) for r in df.collect()) == plain_greedy(once_a_name([dict(sale_price=1.0) | r for r in rows]))


def test_cards_round_trip(spark):
    html = """<ul><div class="card x dealtype-deal"><a href="/d/1"><div class="card-image"><img src="i.png"><br></div></a><h3 class="card-title">Peroni <b>Bier</b> &amp; Co 24 x 33 cl</h3><div class="card-description">statt 100 g = 1.17 vom 28.12. bis 3.1.2026</div>
    <span class="price-new">19.95</span><span class="price-old">42.–</span><span class="price-discount">-52%</span><div class="card-date">10.04.2026 - 15.04.2026</div></div>
    <div class="card dealtype-deal"><h3 class="card-title">Nur Text</h3><p class="card-description">2.50 statt 5.00, 4 x 150 g</p></div><div class="card dealtype-deal"><h3 class="card-title">Ohne Preis</h3></div><div class="card"><h3 class="card-title">Keine Karte</h3></div>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<div class='card dealtype-deal'><h3")], "page int, html string")
    rows = {r.name: r for r in cards.cards(pages, "html", "page").collect()}
    assert set(rows) == {"PeroniBier& Co 24 x 33 cl", "Nur Text"}
    first, second = rows["PeroniBier& Co 24 x 33 cl"], rows["Nur Text"]
    assert (first.sale_price, first.original_price, first.discount_percent, first.href, first.image_url, first.unit_price_info.amount) == (19.95, 42.0, 52, "/d/1", "i.png", 1.17)
    assert (second.sale_price, second.original_price, second.quantity_info.display) == (2.5, 5.0, "4 x 150 g")
    out = {r.productName: r for r in ingest.card_to_deal(cards.cards(pages), "coop", "2026-04-20").collect()}
    assert (out["nur text"].validFrom, out["nur text"].validTo, out["nur text"].discountPercent) == ("2026-04-20", "2026-04-27", 50)
    assert out["peronibier& co 24x33cl"].validFrom == "2026-04-10" and out["peronibier& co 24x33cl"].sourceUrl.endswith("/d/1")


def feed(path, name, rows):
    (path / name).write_text(json.dumps(rows))


def test_feeds_and_streaming(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    feed(src, "coop-megastore-deals.json", [raw(), raw(productName="Crivit Hose"), raw(salePrice=-1.0)])
    feed(src, "lidl-deals.json", [raw(store="lidl", productName="Butter 250g", discountPercent=None)])
    feed(src, "nowhere-deals.json", [raw()])
    (src / "aldi-suisse-deals.json").write_text("{broken")
    rows = feeds.read_feeds(spark, str(src))
    assert sorted(r.store for r in rows.collect()) == ["coop", "coop", "coop", "lidl"]
    rules = [("fresh", "dairy", ("butter",))]
    batch = streaming.ingest_batch(rows, rules)
    assert sorted((r.store, r.product_name, r.discount_percent, r.canonical_unit) for r in batch.collect()) == [("coop", "butter 250g", 34, "L"), ("lidl", "butter 250g", 34, "L")]
    for _ in range(2):
        streaming.stream_feeds(spark, str(src), str(tmp_path / "table"), str(tmp_path / "cp"), rules).awaitTermination()
    feed(src, "spar-deals.json", [raw(store="spar"), raw(store="spar", discountPercent=40.0)])
    streaming.stream_feeds(spark, str(src), str(tmp_path / "table"), str(tmp_path / "cp"), rules).awaitTermination()
    got = {(r.store, r.discount_percent) for r in keyed.read(spark, str(tmp_path / "table")).collect()}
    assert got == {("coop", 34), ("lidl", 34), ("spar", 40)}


def test_api_cards(spark):
    row = '{"uid": 1, "name": "n", "title": "T", "offer": {"price": {"advertisedValue": 4.0}, "promotionPrice": {"effectiveValue": 3.0}, "badges": [{"type": "X", "description": "9"}, {"type": "PERCENTAGE_PROMOTION", "description": "30%"}], "promotionDateRange": {"startDate": "2026-04-07T00:00", "endDate": null}}, "imageTransparent": {"url": "u/{stack}"}, "images": [], "breadcrumb": [{"id": "1", "name": "B"}]}'
    df = spark.createDataFrame([(row,)], "j string").select(F.from_json("j", feeds.API_CARD).alias("c")).select("c.*")
    r = feeds.api_deals(df).first()
    assert (r.productName, r.originalPrice, r.salePrice, r.discountPercent, r.validFrom, r.imageUrl, r.sourceCategory) == ("T", 4.0, 3.0, 30, "2026-04-07", "u/original", "B")


def test_run_log(spark):
    log = ingest.run_log(ingest.store_status(deals(spark, {}, dict(store="coop"), dict(store="coop"))), "r1", "2026-04-01 00:00:00").first()
    assert log.total_stored == 3 and log.store_results["coop"]["status"] == "success" and log.store_results["aldi"]["status"] == "failed"


def test_groups_by_keywords(spark):
    names = ["vollmilch 1l", "Milch, frisch", "bio milch", "milchdrink 500ml", "pouletbrustfilet", "(Rioja) rot", "x.milch.y", "buttermilch", "Schokomilch", "milch1", "mil", "", None]
    groups = [("g1", ["milch"], ["schoko."], "raw"), ("g2", ["milchdrink", "butter", "Pouletbrust"], None, None), ("g3", ["rioja", "a.b", ""], [""], "x"), ("g4", ["ro[tz]", "b.ttermil", "(", "m.*1l"], None, "re")]
    sound = lambda k: k and k != "("

    def plain_group(n, substring):
        best = None
        for g, include, exclude, form in groups:
            low = n.lower()
            if any(x and ((x.lower() in low) if substring else re.search(x, low)) for x in exclude or []):
                continue
            said = lambda k: k.lower() if re.search(r"[\\.^$*+?()\[\]{}|]", k) else re.escape(k.lower())  # noqa: E731  a keyword may be an expression
            front = [k for k in include if sound(k) and (re.search(f"^{said(k)}", low) or re.search(rf"(?<!\w)(?=\w){said(k)}(?<=\w)(?!\w)", low))]
            hit = [k for k in include if k and (k.lower() in low if substring else sound(k) and (re.search(f"{said(k)}$", low) or k in front))]
            rank = (g,) if substring else (bool(front), -max(map(len, front), default=0), g)
            if hit and (best is None or rank < best[0]):
                best = rank, g, form
        return best[1:] if best else (None, None)

    p = spark.createDataFrame([(n, None) for n in names] + [("milch", "mine")], "name string, group_id string")
    g = spark.createDataFrame(groups, "group_id string, include array<string>, exclude array<string>, product_form string")
    for substring in (False, True):
        got = {r.name: (r.group_id, r.product_form) for r in resolve.group_by_keywords(p.filter("group_id is null"), g, substring=substring).collect()}
        assert got == {n: plain_group(n, substring) if n else (None, None) for n in names}
    assert got["Milch, frisch"] == ("g1", "raw")
    assert resolve.group_by_keywords(p.filter("group_id = 'mine'"), g).first().group_id == "mine"
    assert {r.name for r in resolve.backfill_groups(p, g).collect()} == {n for n in names if n and plain_group(n, False)[0]}


def test_terms_in_names(spark):
    names, terms = ["Bio Milch", "öl", "a", "Käse-Mix", None, "aaa"], ["milch", "a", "AA", "öl", "se-m", "", "bio milch x", None]
    got = terms_in.containing(spark.createDataFrame([(n,) for n in names * 2], "n string"), spark.createDataFrame([(t,) for t in terms * 2], "t string"), "n", "t")
    assert sorted(map(tuple, got.collect())) == sorted((n, t) for n in names if n for t in terms if t and t.lower() in n.lower())


def test_keyword_rules_are_the_users(spark, tmp_path):
    (tmp_path / "rules.json").write_text('{"category": "fresh", "sub_category": "dairy", "keywords": ["Milch", ""]}\n\n{"category": "x", "keywords": []}\n{"category": "non-food", "keywords": ["milchkanne"]}\n')
    rules = keyword_rules.read_rules(spark, str(tmp_path / "rules.json"))
    assert rules == [("fresh", "dairy", ("milch",)), ("non-food", None, ("milchkanne",))]
    d = deals(spark, dict(product_name="Milchkanne", category="fresh", sub_category="dairy"), dict(product_name="Reis", category="fresh"), dict(product_name="alt", is_active=False)).withColumn("source_category", F.lit(None).cast("string"))
    assert [tuple(r) for r in ingest.recategorised(d, rules).collect()] == [("1", "long-life", None)]
    m = {r.product_name: r.metadata for r in ingest.with_metadata(d, rules).collect()}
    assert m["Milchkanne"]["sub_category"] == "dairy" and m["Reis"]["form"] == "raw"


def test_stamps_and_guards(spark):
    before = spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], "k int, v string, updated_at string")
    after = spark.createDataFrame([(1, "a", "old"), (2, "c", "old"), (3, "d", "old")], "k int, v string, updated_at string")
    assert {r.k: r.updated_at for r in store.touched(before, after, ["k"], "new").collect()} == {1: "old", 2: "new", 3: "old"}
    rows = spark.createDataFrame([(["a", "b"], ["b", "c"]), (["a"], ["c"]), (None, ["c"])], "s array<string>, c array<string>")
    assert [r[0] for r in rows.select(read.guarded_stores(F.col("s"), F.col("c"))).collect()] == [["b"], ["c"], ["c"]]
    c = spark.createDataFrame([("g", "product-group", 5), ("n", "name-similarity", 90), ("h", "product-group", 7)], "group string, kind string, discount_percent int")
    assert [r.group for r in compare.in_order(c).orderBy("place").collect()] == ["h", "g", "n"]
