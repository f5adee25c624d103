"""Reference sheets on rows of their own."""

import pytest
from pyspark.sql import functions as F

from tenderflow.operators import reference

TIERS = "seq int, key string, name string, tier string, note string, multiplier double, categories map<string, double>, basis string, effective_date string"


@pytest.fixture(scope="module")
def tiers(spark):
    rows = [
        (1, "ives", "IVES", None, None, 0.45, None, None, "2024-01-01"), (2, "allegion", "Allegion Group", None, None, 0.9, {"door_closers": 0.4, "hinges": 0.5}, None, None), (3, "bobrick", "Bobrick", "Distributor Net Price List", None, 1.0, None, None, None),
        (4, "asi", "ASI", None, "flat net program", None, None, None, None), (5, "zero", "Zero", None, "network of dealers", None, None, None, None), (6, "stated", "Stated", None, None, None, None, "net", None), (7, "IVES", "Second", None, None, 0.1, None, None, None),
    ]
    return spark.createDataFrame(rows, TIERS)


def test_vendor_tiers(spark, tiers):
    asked = spark.createDataFrame([(1, " Ives ", None), (2, "ALLEGION GROUP", "Door Closers"), (3, "allegion", "door-closers"), (4, "allegion", "locks"), (5, "allegion", None), (6, "nobody", "hinges"), (7, None, None), (8, "ives", "hinges"), (9, "allegion", "")], "k int, vendor string, category string")
    rows = {r.k: (r.vendor_name, r.category_key, r.multiplier, r.available, r.tier_note) for r in reference.vendor_tiers(asked, "vendor", "category", tiers).collect()}
    assert rows == {
        1: ("IVES", None, 0.45, None, None), 2: ("Allegion Group", "door_closers", 0.4, None, None), 3: ("Allegion Group", "door_closers", 0.4, None, None), 4: ("Allegion Group", "locks", None, ["door_closers", "hinges"], "unknown category"),
        5: ("Allegion Group", None, 0.9, None, None), 6: (None, None, None, None, "unknown vendor"), 7: (None, None, None, None, "unknown vendor"), 8: ("IVES", None, 0.45, None, None), 9: ("Allegion Group", None, 0.9, None, None),
    }


def test_special_nets_and_stock(spark):
    items = spark.createDataFrame([(1, "BB1279", "X1", 10.0), (2, "X1", None, 20.0), (3, None, "", 30.0), (4, "bb1279", "X9", 40.0)], "seq int, part_number string, item_code string, net_price double")
    asked = spark.createDataFrame([(1, "HAGER", "bb1279-US26D"), (2, "hager", " x1 "), (3, "ives", "BB1279"), (4, "hager", None), (5, "hager", "-"), (6, "hager", "X9 left"), (7, "hager", "none")], "k int, vendor string, part string")
    assert {r.k: r.net_price for r in reference.special_nets(asked, "k", "vendor", "part", items).collect()} == {1: 10.0, 2: 10.0, 3: None, 4: None, 5: None, 6: 40.0, 7: None}
    lists = spark.createDataFrame([("Hager", "bb1279"), ("hager", None)], "vendor string, part_number string")
    assert {r.k: r.stock for r in reference.stock_parts(asked, "k", "vendor", "part", lists).collect()} == {1: True, 2: False, 3: None, 4: False, 5: False, 6: False, 7: False}


def test_price_basis(spark, tiers):
    kinds = spark.createDataFrame([("m.pdf", "multiplier_sheet"), ("p.pdf", "price_list")], "file string, kind string")
    asked = spark.createDataFrame([(1, "m.pdf", "ives"), (2, "p.pdf", "ives"), (3, None, "Allegion"), (4, "p.pdf", "bobrick"), (5, "p.pdf", "ASI"), (6, "p.pdf", "zero"), (7, "p.pdf", None), (8, "q.pdf", "stated")], "k int, file string, vendor string")
    found = {r.k: r.basis for r in reference.price_basis(asked, "file", "vendor", kinds, tiers).collect()}
    assert found == {1: "net", 2: "list", 3: "list", 4: "net", 5: "net", 6: "unknown", 7: "unknown", 8: "net"}


def test_cost_ladder(spark):
    schema = "k int, feed_cost double, feed_fresh boolean, net_price double, catalog_cost double, list_price double, multiplier double, basis string"
    rows = [(1, 9.0, True, 8.0, 7.0, 6.0, 0.5, "list"), (2, 9.0, False, 8.0, 7.0, 6.0, 0.5, "list"), (3, 9.0, None, None, 7.0, 6.0, 0.5, "list"), (4, None, True, None, None, 6.0, 0.5, "list"), (5, None, None, None, None, 6.0, None, "net"), (6, None, None, None, None, 6.0, 0.5, "unknown"), (7, None, None, None, None, 6.0, 1.5, "list")]
    found = {r.k: (r.cost_source, r.cost) for r in reference.cost_ladder(spark.createDataFrame(rows, schema), "basis").collect()}
    assert found == {1: ("P21_LAST_PO", 9.0), 2: ("SPECIAL_NET", 8.0), 3: ("CATALOG_BASELINE", 7.0), 4: ("LIST_X_MULTIPLIER", 3.0), 5: ("LIST_X_MULTIPLIER", 6.0), 6: ("MANUAL", None), 7: ("MANUAL", None)}


def test_customer_margins(spark):
    records = spark.createDataFrame([(2, "Acme", 0.3), (1, "ACME ", 0.2)], "seq int, name string, margin double")
    asked = spark.createDataFrame([(1, " acme"), (2, "other"), (3, None)], "k int, customer string")
    assert {r.k: r.special_margin for r in reference.customer_margins(asked, "customer", records).collect()} == {1: 0.2, 2: None, 3: None}


def test_priced_from_catalog(spark):
    lines = "p string, quantity double, margin double, division string, cost double, sale_ea double, ext_price double, cost_source string, list_price double, multiplier double, flags array<string>"
    rows = [("a", 2.0, None, "08", None, None, None, "MANUAL", None, None, ["manual_page_lookup_pending", "x"]), ("b", 0.0, 0.5, None, None, None, None, None, 99.0, None, None), ("c", 1.0, None, "10 28 13", None, None, None, None, None, None, None), ("d", 1.0, None, None, 5.0, 6.0, 6.0, "OLD", None, None, ["x"]), ("e", 1.0, None, None, 5.0, 6.0, 6.0, "OLD", None, None, None)]
    items = spark.createDataFrame([("a", 73.0, None, None, None, "08", None), ("b", None, 10.0, 0.5, "0.4", None, "BOBRICK"), ("c", None, 10.01, 0.5, "x", "", None), ("d", -1.0, 10.0, 0.5, None, None, None)], "p string, cost double, list_price double, multiplier double, default_margin string, division string, vendor string")
    found = {r.p: r for r in reference.priced_from_catalog(spark.createDataFrame(rows, lines), items, ["p"]).collect()}
    assert (found["a"].cost, found["a"].margin, found["a"].sale_ea, found["a"].ext_price, found["a"].flags) == (73.0, 0.27, 100.0, 200.0, ["x", "catalog_baseline_backfilled"])
    assert (found["b"].cost, found["b"].margin, found["b"].ext_price, found["b"].list_price, found["b"].multiplier) == (5.0, 0.5, 10.0, 99.0, 0.5)
    assert (found["c"].margin, found["c"].cost_source) == (0.56, "CATALOG_BASELINE") and found["c"].cost in (5.0, 5.01)
    assert (found["d"].cost, found["d"].cost_source, found["d"].flags, found["e"].cost) == (5.0, "OLD", ["x"], 5.0)
    vendor = reference.default_margin(F.lit(None).cast("string"), F.lit("bad"), F.lit(None).cast("string"), F.lit("GAMCO"))
    assert spark.range(1).select(vendor.alias("v")).first().v == 0.56
