"""Reads of another engine's tables, here the Derby that Spark ships."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from plumbline.plans import audit
from plumbline.sources import tables

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture(scope="module")
def url(spark, tmp_path_factory):
    address = f"jdbc:derby:{tmp_path_factory.mktemp('derby') / 'db'};create=true"
    spark.range(1000).select(F.col("id").alias("K"), F.when(F.col("id") % 9 != 0, F.col("id") * 2).alias("V"), F.expr("date_add(DATE '2020-01-01', CAST(id AS INT))").alias("D"), F.concat(F.lit("n"), F.col("id") % 7).alias("N")).write.option("createTableColumnTypes", "N VARCHAR(20)").jdbc(address, "T", properties={"driver": DRIVER})
    spark.range(0).select(F.col("id").alias("K")).write.jdbc(address, "E", properties={"driver": DRIVER})
    return address


def test_a_table_is_read_whole_by_several_tasks(spark, url):
    for column in ("K", "V", "D"):
        df = tables.read_jdbc_table(spark, url, "T", column, 4, driver=DRIVER)
        assert df.rdd.getNumPartitions() == 4 and df.count() == 1000 and df.select("K").distinct().count() == 1000
        assert df.where("V IS NULL").count() == 112 and df.agg(F.max("D")).first()[0] == date(2022, 9, 26)
        counts = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(counts) == 4 and max(counts) < 400
    # bounds that leave rows out on both sides leave none out of the result
    df = tables.read_jdbc_table(spark, url, "T", "K", 4, bounds=(300, 600), driver=DRIVER)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 1000


def test_filters_and_columns_go_to_the_other_engine(spark, url):
    df = tables.read_jdbc_table(spark, url, "T", "K", 3, driver=DRIVER).where("K > 990 AND N = 'n3'").select("K")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThan(K,990)" in plan and "EqualTo(N,n3)" in plan and "ReadSchema: struct<K:bigint>" in plan
    assert [r["K"] for r in df.collect()] == [k for k in range(991, 1000) if k % 7 == 3]


def test_tables_that_cannot_be_cut_and_addresses_that_are_refused(spark, url):
    assert tables.read_jdbc_table(spark, url, "E", "K", 4, driver=DRIVER).rdd.getNumPartitions() == 1
    assert tables.read_jdbc_table(spark, url, "T", "K", 1, driver=DRIVER).count() == 1000
    assert tables.read_jdbc(spark, url, "SELECT K FROM T WHERE K < 5", driver=DRIVER).count() == 5
    with pytest.raises(ValueError):
        tables.read_jdbc_table(spark, url, "T", "K", 0, driver=DRIVER)
    with pytest.raises(ValueError):
        tables.read_jdbc_table(spark, "jdbc:derby:x;password=y", "T", "K", 2)


def test_statements_are_audited_over_them(spark, url):
    held = tables.jdbc_tables(spark, url, {"T": ("K", 2)}, driver=DRIVER)
    asked = spark.createDataFrame([(1, "db", "Which?", "SELECT n FROM t WHERE v IS DISTINCT FROM 8 ORDER BY n LIMIT 3")], "question_id long, db_id string, question string, SQL string")
    row = audit.audit(spark, asked, held, asked.selectExpr("question_id", "'SELECT N FROM T ORDER BY N LIMIT 3' AS statement"), timeout=None).first()
    assert row["verdict"] == "EQUAL" and row["failed"] == []
