"""Ordered and bag queries reach every row of their tables, not only the first ones."""

import os

import pytest

from plumbline.plans import catalogue

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize(("name", "least"), [("rounded_reading", 0.00499), ("column_existence_reading", float("-inf"))])
def test_positional_readings_see_the_last_row(spark, tmp_path, name, least):
    rows = [(i, 1000.0 + i) for i in range(250)]
    for held, agrees in ((rows, 1), ([*rows, (250, least)], 0)):
        folder = tmp_path / str(agrees)
        spark.createDataFrame(held, "o_orderkey long, o_totalprice double").write.parquet(f"{folder}/orders.parquet")
        assert [r["agrees"] for r in catalogue.queries()[name](spark, str(folder)).collect()] == [agrees]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_whole_queries_hold_all_rows(spark):
    run = lambda name: catalogue.queries()[name](spark, FOLDER)
    orders, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet").count() for t in ("orders", "lineitem"))
    assert orders > 200
    ordered, prefix, bag = (run(n).first() for n in ("ordered_verdict", "prefix_truncation", "bag_verdict"))
    assert (ordered["gold_rows"], ordered["second_rows"]) == (orders, orders)
    assert (prefix["prefix"], prefix["gold_rows"], prefix["second_rows"]) == (True, orders, 50)
    assert (bag["gold_rows"], bag["second_rows"], bag["equal"]) == (items, items, False)
    places = run("place_map").collect()
    assert sorted(r["gold_pos"] for r in places) == sorted(r["second_pos"] for r in places) == list(range(orders))
