"""The weekly run, the layout of stored deals, paged sources, JSON objects, names in order."""

import json
import random

import pytest
from pyspark.sql import functions as F

from larder.functions import objects
from larder.functions.values import STORES
from larder.operators import ingest, keyed, lists, run
from larder.sources import layout, paged

RULES = [("fresh", "dairy", ("butter", "milch")), ("fresh", "bread", ("brot",))]


def feed(spark, *rows):
    base = dict(store="coop", productName="Butter 250g", originalPrice=4.5, salePrice=2.95, discountPercent=34.0, validFrom="2026-04-07", validTo="2026-04-13", sourceCategory=None)
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], "store string, productName string, originalPrice double, salePrice double, discountPercent double, validFrom string, validTo string, sourceCategory string")


def aliases(spark):
    return spark.createDataFrame([("Dairy", "milk", None)], "source_tag string, category_slug string, subcategory_slug string")


def test_weekly_run(spark, tmp_path):
    table, log = str(tmp_path / "deals"), str(tmp_path / "runs")
    week = feed(
        spark, {}, {"store": "lidl"}, {"store": "lidl", "productName": "  BUTTER  250g", "discountPercent": 40.0}, {"store": "lidl", "productName": "Brot"}, {"store": "aldi", "productName": "Crivit Hose"}, {"salePrice": -1.0}, {"store": "spar", "productName": "Bio Milch", "validTo": "2026-04-30"}
    )
    done = run.weekly(week, table, log, "one", "2026-04-08 06:00:00", RULES, aliases(spark))
    n = done.numbers
    assert (n["read"], n["valid"], n["kept"], n["categorised"], n["mapped"], n["stored"], n["organic"]) == (7, 6, 5, 5, 4, 4, 1)
    # what was observed equals separate counts over the same frame
    again = run.classified(week, RULES, aliases(spark))
    assert {k: again.filter(c).count() for k, c in (("valid", "valid"), ("kept", "kept"), ("categorised", "taken"), ("brands", "kept and said.brand is not null"), ("quantities", "kept and said.quantity"), ("mapped", "taken and alias_category is not null"))} == {k: n[k] for k in ("valid", "kept", "categorised", "brands", "quantities", "mapped")}
    assert [r.tag for r in done.unknown.collect()] == ["bread"]
    rows = {(r.store, r.product_name): r for r in keyed.read(spark, table).collect()}
    assert len(rows) == 4 and all(r.is_active for r in rows.values()) and rows["lidl", "butter 250g"].discount_percent == 40 and rows["spar", "bio milch"].category_slug == "milk"
    line = spark.read.parquet(log).first()
    assert line.total_stored == 4 and line.store_results["coop"].status == "success" and line.store_results["denner"].status == "failed" and "Storage: stored 4/5 (1 failed)" in line.error_log
    # the week after: lidl brings less, spar nothing
    run.weekly(feed(spark, {"store": "lidl", "productName": "Brot", "validTo": "2026-04-30"}), table, log, "two", "2026-04-15 06:00:00", RULES, aliases(spark))
    rows = {(r.store, r.product_name): r for r in keyed.read(spark, table).collect()}
    assert {k for k, r in rows.items() if r.is_active} == {("lidl", "brot"), ("spar", "bio milch")}  # stale, ended, kept as its source failed
    assert str(rows["lidl", "brot"].created_at) == "2026-04-08 06:00:00" and str(rows["lidl", "brot"].updated_at) == "2026-04-15 06:00:00"
    assert spark.read.parquet(log).count() == 2


def test_gate_and_empty_run(spark, tmp_path):
    table, log = str(tmp_path / "deals"), str(tmp_path / "runs")
    with pytest.raises(ValueError, match="no rows"):
        run.weekly(feed(spark, {}).limit(0), table, log, "none", "2026-04-08 06:00:00", RULES, aliases(spark))
    assert not keyed.exists(spark, table)
    with pytest.raises(ValueError, match="only 0.25"):
        run.weekly(feed(spark, {}, {}, {}, {}), table, log, "short", "2026-04-08 06:00:00", RULES, aliases(spark))
    assert spark.read.parquet(log).first().error_log.endswith("Storage: stored 1/4 (3 failed)")


def test_layout_reads_what_it_must(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"{rng.getrandbits(64):016x}", rng.choice(["fresh", "long-life", "non-food"]), rng.choice(STORES), rng.random() < 0.5, "x" * 40) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "deal_id string, category string, store string, is_active boolean, note string")
    path = str(tmp_path / "deals")
    layout.write_deals(df, path, group_bytes=1 << 14)
    active = sum(r[3] for r in rows)
    some = layout.active_of(spark, path, "fresh", "coop")
    want = {r[0] for r in rows if r[1:4] == ("fresh", "coop", True)}
    assert {r.deal_id for r in some.collect()} == want and some.first().is_active is True
    files, read = layout.scanned(some)
    assert files < len(some.inputFiles())  # of the folders, the active one
    assert len(want) <= read < active / 5  # of 21 pairs, the groups of one and what borders on it
    one = next(r[0] for r in rows if r[3])
    assert [r.deal_id for r in layout.active_of(spark, path, ids=[one]).collect()] == [one]
    assert layout.scanned(layout.active_of(spark, path, ids=[one]))[1] < active / 10  # Bloom filters: ids are in no order across groups


def test_layout_makes_its_rows_once(spark, tmp_path):
    """Rows are not made a second time for the bounds of partitions; a frequent pair takes several files, each sorted, and a null is_active its own folder."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def ident(k):
        made.add(1)
        return f"{k * 7919 % 10007:08d}" + "y" * 100

    pair = F.when(F.col("id") % 10 == 0, F.lit("fresh")).otherwise("non-food")
    df = spark.range(0, 8000, 1, 8).select(ident("id").alias("deal_id"), pair.alias("category"), F.lit("coop").alias("store"), F.when(F.col("id") % 1000 != 1, F.col("id") % 4 != 0).alias("is_active"))
    path, size = str(tmp_path / "deals"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "20k")
    try:
        layout.write_deals(df, path)
    finally:
        spark.conf.set(size, before)
    assert made.value == 8000
    back = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    files, folders = {}, {}
    for r in back.orderBy("file", "at").collect():
        files.setdefault((str(r.is_active), r.file), []).append((r.category, r.store, r.deal_id))
    for (active, _), rows in files.items():
        folders.setdefault(active, []).append(rows)
        assert rows == sorted(rows)
    assert {k: sum(map(len, v)) for k, v in folders.items()} == {"None": 8, "true": 5992, "false": 2000}
    assert len({x for v in folders.values() for rows in v for x in rows}) == 8000
    assert sum(any(x[0] == "non-food" for x in rows) for rows in folders["true"]) > 1


def test_pages_until_empty(spark):
    pages = [("a", 1, 3), ("a", 2, 1), ("a", 3, 0), ("a", 4, 9), ("b", 1, 1), ("b", 3, 1), ("c", 2, 5), ("d", 1, None), *(("e", k, 1) for k in range(1, 70)), ("f", 1, 1), (None, 1, 1), ("g", 0, 1)]
    df = spark.createDataFrame(pages, "s string, n int, items int")
    got = paged.until_empty(df, "s", "n", F.col("items"), 60)
    assert sorted((r.s, r.n) for r in got.filter("s is not null").collect()) == [("a", 1), ("a", 2), ("b", 1), *(("e", k) for k in range(1, 61)), ("f", 1)]


def test_fetched_pages_and_details(spark):
    def fetch(store, page):
        if store == "broken" and page == 2:
            raise OSError("gone")
        return f"<li>{store} {page}</li>" if page <= {"a": 3, "b": 1, "broken": 9}.get(store, 0) else "<p>none</p>"

    df = paged.fetch_pages(spark, ["a", "b", "c", "broken"], fetch, lambda html: "<li>" in html, max_pages=2)
    assert df.rdd.getNumPartitions() == 4
    assert sorted((r.store, r.page) for r in df.collect()) == [("a", 1), ("a", 2), ("b", 1), ("broken", 1)]

    def details(ids):
        if 13 in ids:
            raise OSError("gone")
        return [json.dumps({"uid": k}) for k in ids if k % 10]

    ids = spark.createDataFrame([(k % 40,) for k in range(80)] + [(None,)], "uid long").coalesce(1)
    got = [json.loads(r.json)["uid"] for r in paged.fetch_details(ids, "uid", details, batch=8).collect()]
    assert len(got) == len(set(got)) and set(got) <= {k for k in range(40) if k % 10} and len(got) >= 40 - 4 - 8 * 1 and 13 not in got
    known = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (99, "z")], "uid long, v string")
    assert sorted(tuple(r) for r in paged.wanted_details(ids, known, "uid").collect()) == [(1, "x"), (2, "y")]


def test_objects(spark):
    docs = ['{"a":1,"b":{"c":null,"d":[1,{"e":2}]}}', '{"a":"x"}', "{}", "[1]", "null", "5", "no json", None, '{"":1,"ä":true}']
    df = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "k int, j string").withColumn("v", objects.parse(F.col("j")))
    v, lit = F.col("v"), lambda t: F.parse_json(F.lit(t))
    read = lambda c: {r.k: r[1] for r in df.select("k", c).collect()}
    shown = lambda c: {k: None if x is None else json.loads(x) for k, x in read(F.to_json(c)).items()}
    merged = shown(objects.merge(v, lit('{"a":null,"z":[0]}')))
    assert merged[0] == {"a": None, "b": {"c": None, "d": [1, {"e": 2}]}, "z": [0]} and merged[2] == merged[3] == merged[5] == {"a": None, "z": [0]} and merged[6] is None and merged[7] is None and merged[8] == {"": 1, "ä": True, "a": None, "z": [0]}
    assert shown(objects.put(v, ["b", "c"], lit("7")))[0]["b"] == {"c": 7, "d": [1, {"e": 2}]}
    assert shown(objects.put(v, ["b", "new"], lit("7"), create=False))[0] == json.loads(docs[0]) and shown(objects.put(v, ["q", "c"], lit("7")))[1] == {"a": "x"}
    assert shown(objects.put(v, ["a"], lit("[]")))[1] == {"a": []} and shown(objects.put(v, ["a"], lit("[]")))[3] == [1]
    assert shown(objects.without(v, "a", "nowhere"))[0] == {"b": {"c": None, "d": [1, {"e": 2}]}} and shown(objects.without(v, "a"))[1] == {}
    assert read(objects.text_at(v, "$.b.d[1].e"))[0] == "2" and read(objects.text_at(v, "$.b.c"))[0] is None
    null, there = read(objects.json_null(v, "$.b.c")), df.select("k", objects.present(v, "a").alias("p")).collect()
    assert [k for k, x in null.items() if x] == [0] and [r.k for r in there if r.p] == [0, 1] and {r.k for r in there if r.p is None} == {6, 7}


def test_names_in_unicode_order(spark):
    order = ["ananas", "apfel", "Apfel", "Äpfel", "Eclair", "éclair", "Öl", "Olive", "Zitrone", "zitronen"]
    rows = [(k, n, "g") for k, n in enumerate(random.Random(1).sample(order, len(order)))]
    out = lists.by_display_name(spark.createDataFrame(rows, "concept_id int, display_name string, g string"), "g")
    assert [r.display_name for r in out.orderBy("place").collect()] == order


def test_ratio():
    assert ingest.check_ratio(0, 0) == 1.0
