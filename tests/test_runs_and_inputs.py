"""Classes of rewrites, censuses, selections under two budgets, typed prediction files and remembered measurements."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from plumbline import __main__ as command
from plumbline.operators import fixture, runs
from plumbline.plans import audit
from plumbline.plans import statement as S
from plumbline.sources import demo, questions

BASE = "SELECT a, b FROM t JOIN u ON t.i = u.i WHERE a > 1 ORDER BY a LIMIT 3"
#: Pairs of each class, and a pair beside it that must not be of that class.
CLASSES = [
    ("projection", (BASE, BASE.replace("a, b", "a, c")), (BASE, BASE.replace("a, b", "b, a"))),
    ("distinct", (BASE, BASE.replace("SELECT", "SELECT DISTINCT")), ("SELECT count(DISTINCT a) FROM t", "SELECT count(a) FROM t")),
    ("from_tables", None, (BASE, BASE.replace("FROM t JOIN u", "FROM T JOIN U"))),
    ("join_condition", (BASE, BASE.replace("t.i = u.i", "t.i = u.j")), (BASE, BASE.replace("a > 1", "a > 2"))),
    ("where", (BASE, BASE.replace("a > 1", "a > 2")), ("SELECT a FROM (SELECT a FROM t WHERE a > 1) x", "SELECT a FROM (SELECT a FROM t WHERE a > 2) x")),
    ("group_by", ("SELECT max(a) FROM t GROUP BY b", "SELECT max(a) FROM t GROUP BY c"), ("SELECT max(a) FROM t GROUP BY b", "SELECT min(a) FROM t GROUP BY b")),
    ("having", ("SELECT b FROM t GROUP BY b HAVING b > 1", "SELECT b FROM t GROUP BY b HAVING b > 2"), ("SELECT b FROM t WHERE b > 1", "SELECT b FROM t WHERE b > 2")),
    ("order_by_key", (BASE, BASE.replace("ORDER BY a", "ORDER BY b")), (BASE, BASE.replace("ORDER BY a", "ORDER BY a DESC"))),
    ("order_by_direction_only", (BASE, BASE.replace("ORDER BY a", "ORDER BY a DESC")), (BASE, BASE.replace("ORDER BY a", "ORDER BY b DESC"))),
    ("limit_or_offset", (BASE, BASE.replace("LIMIT 3", "LIMIT 4")), (BASE, BASE.replace("ORDER BY a", "ORDER BY b"))),
    ("aggregate_function", ("SELECT a FROM t WHERE a > (SELECT max(b) FROM t)", "SELECT a FROM t WHERE a > (SELECT min(b) FROM t)"), ("SELECT upper(a) FROM t", "SELECT lower(a) FROM t")),
    ("cast_or_type", ("SELECT x.a FROM (SELECT CAST(a AS INT) AS a FROM t) x", "SELECT x.a FROM (SELECT CAST(a AS DATE) AS a FROM t) x"), ("SELECT x.a FROM (SELECT a + 1 AS a FROM t) x", "SELECT x.a FROM (SELECT a + 2 AS a FROM t) x")),
    ("subquery_or_cte_shape", ("WITH c AS (SELECT a FROM t WHERE a > 1) SELECT a FROM c", "WITH c AS (SELECT a FROM t WHERE a > 2) SELECT a FROM c"), (BASE, BASE.replace("a > 1", "a > 2"))),
    ("whole_rewrite", (BASE, BASE.replace("JOIN u ON t.i = u.i", "JOIN v ON t.i = v.i")), (BASE, BASE.replace("a > 1", "a > 2").replace("LIMIT 3", "LIMIT 4"))),
]


@pytest.mark.parametrize(("kind", "pair", "other"), CLASSES)
def test_each_class_of_a_rewrite(spark, kind, pair, other):
    if pair:
        touched, found = S.rewrite_class(spark, *pair)
        # what a clause of the whole statement says comes before what stands anywhere in it
        assert kind in touched and (found == kind or S.REWRITES.index(found) < S.REWRITES.index(kind) and kind == "aggregate_function")
    touched, found = S.rewrite_class(spark, *other)
    assert found != kind and (kind not in touched or kind == "from_tables")
    assert S.rewrite_class(spark, other[0], other[0]) == ([], None)


def test_a_rewrite_of_many_clauses_or_other_tables_is_whole(spark):
    many = BASE.replace("a, b", "a, c").replace("a > 1", "a > 2").replace("ORDER BY a", "ORDER BY b").replace("LIMIT 3", "LIMIT 4")
    assert S.rewrite_class(spark, BASE, many)[1] == "whole_rewrite"
    assert S.rewrite_class(spark, "SELECT a FROM t", "SELECT a FROM u") == (["from_tables", "whole_rewrite"], "whole_rewrite")
    assert S.rewrite_class(spark, "select  a from t -- x\n", "SELECT a FROM t") == ([], None)


def test_constructs_are_summed_over_a_question_file(spark):
    totals = S.construct_totals(spark, ["SELECT a FROM t ORDER BY a LIMIT 1", "SELECT DISTINCT a FROM t", "DROP TABLE t", "SELECT count(*) FROM t JOIN u ON t.i = u.i"])
    assert {k: totals[k] for k in ("refused", "sort", "limit", "distinct", "join", "aggregate", "call_count", "union")} == {"refused": 1, "sort": 1, "limit": 1, "distinct": 1, "join": 1, "aggregate": 1, "call_count": 1, "union": 0}
    assert S.construct_totals(spark, []) == {"refused": 0}


def test_a_selection_fits_both_of_its_budgets(spark):
    r = random.Random(11)
    for trial in range(4):
        rows = [(i, r.choice("abc"), r.randrange(10, 999), r.randrange(1, 9), i % 17 == 0) for i in range(60)]
        budget, most = r.randrange(9_000, 22_000), r.randrange(60, 250)
        kept = [x for x in rows if x[2] <= 900]
        shares = {b: sorted((x[2], x[0], x[3]) for x in kept if x[1] == b and not x[4]) for b in "abc"}
        size, files = sum(x[2] for x in kept), sum(x[3] for x in kept)
        while size > budget or files > most:
            b = min((k for k in shares if shares[k]), key=lambda k: (-len(shares[k]), k))
            gone = shares[b].pop()
            size, files = size - gone[0], files - gone[2]
        want = {i for s in shares.values() for _, i, _ in s} | {x[0] for x in kept if x[4]}
        df = spark.createDataFrame(rows, "question_id long, benchmark string, bytes long, files long, protected boolean")
        found = runs.trimmed(df, budget, page_limit=900, files=most)
        assert {x["question_id"] for x in found.collect()} == want, trial
        reasons = {x["question_id"]: x["reason"] for x in runs.reasons_left_out(df, found, 900).collect()}
        assert reasons == {x[0]: "over-page" if x[2] > 900 else "over-budget" for x in rows if x[0] not in want}
    with pytest.raises(runs.SelectionRefused, match="files"):
        runs.trimmed(df, 10**6, files=1)


def test_lengths_of_keys_beside_their_coverage(spark):
    parent = spark.createDataFrame([("a1",), ("a1",), ("bb2",)], "k string")
    child = spark.createDataFrame([("a1",), ("a1",), ("zz",), ("bb2",), (None,), ("long-key",)], "c string")
    assert sorted(map(tuple, runs.coverage_by_length(parent, child, "k", "c").collect())) == [(2, 3, 2, 2), (3, 1, 1, 1), (8, 1, 0, 1)]
    assert runs.coverage_by_length(parent, child.limit(0), "k", "c").count() == 0


def test_values_of_predictions_have_types(spark, tmp_path):
    def read(text):
        (tmp_path / "p.json").write_text(text)
        return {r["key"]: r["statement"] for r in questions.read_predictions(spark, str(tmp_path / "p.json")).collect()}

    assert read('{"0": "SELECT 1\\t----- bird -----\\tdb", "1": 0, "2": "", "3": "0", " 4 ": "  ", "-5": 0.0}') == {0: "SELECT 1", 1: None, 2: None, 3: "0", 4: None, -5: None}
    assert read("{}") == {}
    for bad in ('{"x": "SELECT 1"}', '{"1.5": "SELECT 1"}', '{"": "SELECT 1"}', '{"1": {"a": 1}}', '{"1": 7}', '{"1": true}', '{"1": false}', '{"1": null}', '{"1": ["SELECT 1"]}', '["SELECT 1"]', '"SELECT 1"', "not json", ""):
        with pytest.raises(questions.InputRefused):
            read(bad)


def test_a_bad_prediction_file_ends_the_command_line_with_a_line(spark, tmp_path, capsys):
    for name, df in demo.tables(spark).items():
        df.write.parquet(str(tmp_path / "tables" / f"{name}.parquet"))
    (tmp_path / "q.json").write_text(json.dumps(demo.QUESTIONS))
    (tmp_path / "p.json").write_text('{"x": "SELECT 1"}')
    assert command.main(["audit", "--questions", str(tmp_path / "q.json"), "--tables", str(tmp_path / "tables"), "--predictions", str(tmp_path / "p.json"), "--out", str(tmp_path / "out")], spark) == command.REFUSED
    assert "neither a question's id nor a place" in capsys.readouterr().err


def jobs(spark, action):
    """How many jobs an action starts."""
    group = f"counted-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        action()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_files_that_have_not_changed_are_measured_once(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(20).write.parquet(str(tmp_path / name))
    read = lambda: {n: spark.read.schema("id long").parquet(str(tmp_path / n)) for n in ("a", "b")}
    cache = fixture.Cache(str(tmp_path / "cache.json"))
    held = read()
    assert jobs(spark, lambda: fixture.measure(held, contents=True, cache=cache)) > 0
    first = fixture.measure(held, contents=True, cache=cache)
    again = read()
    assert jobs(spark, lambda: fixture.measure(again, contents=True, cache=cache)) == 0
    # another depth is measured by itself
    assert fixture.measure(again, cache=cache)["counts"] == {"a": 20, "b": 20}
    spark.range(5).write.mode("append").parquet(str(tmp_path / "b"))
    changed = read()
    counted = []
    original = fixture.row_counts
    fixture.row_counts = lambda tables: (counted.append(sorted(tables)), original(tables))[1]
    try:
        now = fixture.measure(changed, contents=True, cache=cache)
    finally:
        fixture.row_counts = original
    assert counted == [["b"]] and now["counts"] == {"a": 20, "b": 25} and now["contents"]["a"] == first["contents"]["a"] and now["contents"]["b"] != first["contents"]["b"]
    # rows that come from no file are never remembered
    assert fixture.content_signal(spark.range(3)) is None
    assert fixture.measure({"r": spark.range(3)}, cache=cache) == fixture.measure({"r": spark.range(3)})
    before, file = fixture.content_signal(read()["a"]), next(f for f in os.listdir(tmp_path / "a") if f.endswith(".parquet"))
    os.utime(tmp_path / "a" / file, (1, 1))
    assert fixture.content_signal(read()["a"]) != before


def test_a_summary_says_what_was_asked_and_of_what(spark):
    asked = spark.createDataFrame([(1, "db", "Who?", "SELECT name FROM mark ORDER BY score DESC LIMIT 1"), (2, "db", "Who?", "SELECT item FROM sale")], "question_id long, db_id string, question string, SQL string")
    held = fixture.measure(demo.tables(spark))
    judged = audit.audit(spark, asked, demo.tables(spark), timeout=None, measured=held)
    told = audit.summary(judged, engine={"engine": "spark"}, measured=held)
    by = told["probes_by_applicability"]
    assert by["arbitrary-cut"] == {"applicable": 1, "fired": 1, "failed": 0} and by["duplicate-full-row"] == {"applicable": 1, "fired": 1, "failed": 0}
    assert told["engine"] == {"engine": "spark"} and told["fixture"]["counts"] == held["counts"]
    assert judged.where(F.size("failed") > 0).count() == 0
