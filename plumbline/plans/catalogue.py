"""The registered queries and the SQL that each is held against.

Verdicts, differences and probes are ordinary rows here, over the given tables, so that another engine can say the
same in SQL. Statements that a run would audit are written as SQL; the operators compare their results.
"""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import keys
from plumbline.operators import fixture, multiset, ordered, probes, readings, runs, windows
from plumbline.operators.mechanism import mechanism
from plumbline.operators.order import with_pos
from plumbline.plans import audit
from plumbline.plans.session import Envelope
from plumbline.plans.statement import clause_difference, construct_census, ordered_as_number, parse, text_operands, token_difference, without_distinct
from plumbline.sources.tables import run, table

_queries: dict = {}
_oracles: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        _queries[name] = f
        if oracle:
            _oracles[name] = oracle
        return f

    return add


def passed_through(name: str, sql: str, oracle: str | None = None) -> None:
    """A statement that is run as it stands."""
    query(name, oracle or sql)(lambda spark, folder: run(spark, folder, sql))


# ---- statements that are compared ----

GOLD = "SELECT DISTINCT c_mktsegment FROM customer JOIN orders ON o_custkey = c_custkey"
SECOND = "SELECT c_mktsegment FROM customer JOIN orders ON o_custkey = c_custkey"
#: Both sides hold every row; the bags differ by a value.
ITEMS = "SELECT l_returnflag, l_linestatus, CAST(l_quantity AS INT) AS q FROM lineitem"
OTHER_ITEMS = "SELECT l_returnflag, l_linestatus, CAST(l_quantity AS INT) + CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS q FROM lineitem"
PRICED = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey"
PRICED_OTHERWISE = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY CASE WHEN o_totalprice < 400000 THEN 1 ELSE 0 END, o_orderkey"
#: A shorter second side, for the prefix.
SHORTER = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50"


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The commonest finding: a join that repeats rows, credited by set equality. The differing rows with the verdict."""
    gold, second = run(spark, folder, GOLD), run(spark, folder, SECOND)
    found = audit.compare(gold, second, "set").select("equal", "set_reading", "mechanism")
    return multiset.difference(gold, second).select("side", F.element_at("key", 1).alias("row"), "n").crossJoin(found)


def _two(spark, folder, a, b):
    return run(spark, folder, a), run(spark, folder, b)


@query("flagship", f"WITH g AS ({GOLD}), s AS ({SECOND}), d AS (SELECT c_mktsegment k, count(*) - 1 n FROM s GROUP BY 1) SELECT 'second' AS side, 'str:' || k AS \"row\", n, false AS equal, 1 AS set_reading, 'multiplicity' AS mechanism FROM d WHERE n > 0")
def _(spark, folder):
    return flagship(spark, folder)


_BAGS = f"WITH a AS (SELECT l_returnflag f, l_linestatus s, q, count(*) n FROM ({ITEMS}) GROUP BY 1, 2, 3), b AS (SELECT l_returnflag f, l_linestatus s, q, count(*) n FROM ({OTHER_ITEMS}) GROUP BY 1, 2, 3), j AS (SELECT coalesce(a.f, b.f) f, coalesce(a.s, b.s) s, coalesce(a.q, b.q) q, coalesce(a.n, 0) x, coalesce(b.n, 0) y FROM a FULL JOIN b ON a.f = b.f AND a.s = b.s AND a.q = b.q) "
_PLACED = "WITH a AS (SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 p, o_orderkey k FROM orders), b AS (SELECT row_number() OVER (ORDER BY CASE WHEN o_totalprice < 400000 THEN 1 ELSE 0 END, o_orderkey) - 1 p, o_orderkey k FROM orders) "


@query("bag_difference", _BAGS + "SELECT CASE WHEN x > y THEN 'gold' ELSE 'second' END AS side, 'str:' || f AS c0, 'str:' || s AS c1, 'int:' || q AS c2, abs(x - y) AS n FROM j WHERE x <> y")
def _(spark, folder):
    held = multiset.difference(*_two(spark, folder, ITEMS, OTHER_ITEMS))
    return held.select("side", *(F.element_at("key", i + 1).alias(f"c{i}") for i in range(3)), "n")


@query("bag_verdict", _BAGS + "SELECT true AS same_types, bool_and(x = y) AS same_bag, bool_and((x > 0) = (y > 0)) AS same_set, CAST(sum(x) AS BIGINT) AS gold_rows, CAST(sum(y) AS BIGINT) AS second_rows, count(*) FILTER (x > 0) AS gold_distinct, count(*) FILTER (y > 0) AS second_distinct, count(*) FILTER (x > 0 AND y > 0) AS shared_distinct, CAST(sum(greatest(x - y, 0)) AS BIGINT) AS gold_only_rows, CAST(sum(greatest(y - x, 0)) AS BIGINT) AS second_only_rows, bool_and(x = y) AS equal FROM j")
def _(spark, folder):
    return multiset.verdict(*_two(spark, folder, ITEMS, OTHER_ITEMS))


@query("shared_rows", _BAGS + "SELECT count(*) AS shared FROM j WHERE x > 0 AND y > 0")
def _(spark, folder):
    return multiset.shared_distinct(*_two(spark, folder, ITEMS, OTHER_ITEMS)).agg(F.count("*").alias("shared"))


@query("ordered_verdict", _PLACED + "SELECT count(*) FILTER (a.k IS DISTINCT FROM b.k) = 0 AS equal, min(a.p) FILTER (a.k IS DISTINCT FROM b.k) AS first_difference, count(a.k) AS gold_rows, count(b.k) AS second_rows FROM a FULL JOIN b ON a.p = b.p")
def _(spark, folder):
    a, b = _two(spark, folder, PRICED, PRICED_OTHERWISE)
    return ordered.verdict(with_pos(a), with_pos(b)).select("equal", "first_difference", "gold_rows", "second_rows")


@query("prefix_truncation", "SELECT true AS prefix, count(*) AS gold_rows, least(count(*), 50) AS second_rows FROM orders")
def _(spark, folder):
    a, b = _two(spark, folder, PRICED, SHORTER)
    return ordered.verdict(with_pos(a), with_pos(b)).select("prefix", "gold_rows", "second_rows")


@query("place_map", _PLACED + "SELECT a.p AS gold_pos, coalesce(b.p, -1) AS second_pos FROM a LEFT JOIN b ON a.k = b.k")
def _(spark, folder):
    a, b = _two(spark, folder, PRICED, PRICED_OTHERWISE)
    return ordered.place_map(with_pos(a), with_pos(b)).select("gold_pos", F.coalesce("second_pos", F.lit(-1)).cast("long").alias("second_pos"))


@query("mixed_tag_columns", "WITH t AS (SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 AND o_custkey IS NOT NULL THEN 'int' ELSE 'null' END AS t FROM orders) SELECT 1 AS place, string_agg(t, ',' ORDER BY t) AS tags FROM t HAVING count(*) > 1")
def _(spark, folder):
    df = run(spark, folder, "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS c, o_orderstatus FROM orders")
    return ordered.mixed_columns(df).select("place", F.array_join("tags", ",").alias("tags"))


@query("set_reading", f"WITH g AS ({GOLD}), s AS (SELECT DISTINCT * FROM ({SECOND})) SELECT 1 AS agrees, (SELECT count(*) FROM g) AS gold_distinct, (SELECT count(*) FROM s) AS second_distinct")
def _(spark, folder):
    return readings.set_reading(*_two(spark, folder, GOLD, SECOND))


@query("set_reading_numbers", "WITH a AS (SELECT DISTINCT CAST(l_quantity AS DOUBLE) v FROM lineitem), b AS (SELECT DISTINCT CAST(CAST(l_quantity AS INT) AS DOUBLE) v FROM lineitem) SELECT CAST((SELECT count(*) FROM a) = (SELECT count(*) FROM b) AND NOT EXISTS (SELECT * FROM a WHERE v NOT IN (SELECT v FROM b)) AS INT) AS agrees")
def _(spark, folder):
    return readings.set_reading(*_two(spark, folder, "SELECT l_quantity FROM lineitem", "SELECT CAST(l_quantity AS INT) FROM lineitem")).select("agrees")


def _same_bag(a: str, b: str) -> str:
    return f"(NOT EXISTS (({a}) EXCEPT ALL ({b})) AND NOT EXISTS (({b}) EXCEPT ALL ({a})))"


def _same_set(a: str, b: str) -> str:
    return f"(NOT EXISTS (({a}) EXCEPT ({b})) AND NOT EXISTS (({b}) EXCEPT ({a})))"


def _pairs(spark, folder, gold: str, seconds: dict[str, str], read) -> DataFrame:
    """read's row for each second statement, with the pair's name."""
    held = [read(*_two(spark, folder, gold, sql)).withColumn("pair", F.lit(name)) for name, sql in seconds.items()]
    return reduce(DataFrame.unionByName, held)


_HOME = "SELECT c_custkey, c_nationkey, c_name FROM customer"
_MOVED = "SELECT c_name, c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS n FROM customer"
_SWAPPED = "SELECT c_name, c_custkey, c_nationkey FROM customer"


def _permuted(second: str) -> str:
    """Bags under the two orders of columns that their types allow."""
    x = second.replace("c_nationkey FROM", "c_nationkey AS n FROM")
    return " OR ".join(_same_bag(_HOME, f"SELECT {order}, c_name FROM ({x})") for order in ("c_custkey, n", "n, c_custkey"))


@query("permuted_reading", f"SELECT 'swapped' AS pair, {_permuted(_SWAPPED)} AS agrees UNION ALL SELECT 'moved', {_permuted(_MOVED)}")
def _(spark, folder):
    read = lambda a, b: spark.createDataFrame([(readings.permuted_reading(a, b, ordered=False),)], "agrees boolean")
    return _pairs(spark, folder, _HOME, {"swapped": _SWAPPED, "moved": _MOVED}, read)


_STRIPPED = {"repeated": SECOND, "shorter": "SELECT DISTINCT c_mktsegment FROM customer"}
_BARE = {"gold": GOLD.replace("DISTINCT ", ""), "repeated": SECOND, "shorter": "SELECT c_mktsegment FROM customer"}


@query("distinct_stripped_reading", " UNION ALL ".join(f"SELECT '{n}' AS pair, CAST({_same_bag(GOLD, q)} AS INT) AS agrees, CAST({_same_bag(_BARE['gold'], _BARE[n])} AS INT) AS agrees_without_distinct" for n, q in _STRIPPED.items()))
def _(spark, folder):
    rows = []
    for name, sql in _STRIPPED.items():
        plain = readings.test_suite_reading(*_two(spark, folder, GOLD, sql), GOLD)
        bare = readings.test_suite_reading(*_two(spark, folder, without_distinct(GOLD), without_distinct(sql)), GOLD)
        rows.append((name, plain, bare))
    return spark.createDataFrame(rows, "pair string, agrees int, agrees_without_distinct int")


_DATES = {"repeated": "SELECT CAST(o_orderdate AS DATE) AS d FROM orders", "later": "SELECT CAST(o_orderdate AS DATE) + INTERVAL 1 DAY AS d FROM orders"}


@query("dates_reading", " UNION ALL ".join(f"SELECT '{n}' AS pair, CAST({_same_set('SELECT CAST(o_orderdate AS DATE) FROM orders', f'SELECT CAST(d AS DATE) FROM ({q})')} AND EXISTS (SELECT * FROM orders) AS INT) AS agrees" for n, q in _DATES.items()))
def _(spark, folder):
    return _pairs(spark, folder, "SELECT DISTINCT o_orderdate FROM orders", _DATES, readings.dates_as_text_reading)


@query("rounded_reading", "SELECT CAST(bool_and(round(o_totalprice, 2) = round(o_totalprice + 0.0001, 2)) AS INT) AS agrees FROM orders")
def _(spark, folder):
    a, b = _two(spark, folder, PRICED, "SELECT o_orderkey, o_totalprice + 0.0001 AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey")
    return readings.rounded_ordered_reading(with_pos(a), with_pos(b))


_NATIONS = {"swapped": "SELECT n_regionkey, n_name FROM nation", "changed": "SELECT n_regionkey + 1 AS n_regionkey, n_name FROM nation", "renamed": "SELECT n_regionkey, n_name AS name FROM nation"}


@query("named_columns_reading", " UNION ALL ".join([*(f"SELECT '{n}' AS pair, CAST({_same_set('SELECT n_regionkey, n_name FROM nation', _NATIONS[n])} AS INT) AS agrees" for n in ("swapped", "changed")), "SELECT 'renamed', 0"]))
def _(spark, folder):
    return _pairs(spark, folder, "SELECT n_name, n_regionkey FROM nation", _NATIONS, readings.named_columns_reading)


@query("column_existence_reading", "SELECT CAST(bool_and(abs(o_totalprice + 0.001 - o_totalprice) <= 0.01) AS INT) AS agrees FROM orders")
def _(spark, folder):
    a, b = _two(spark, folder, "SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey, o_totalprice + 0.001 AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey")
    return readings.column_existence_reading(with_pos(a), with_pos(b))


@query("mechanism_class", "SELECT o_orderkey AS pair, CASE WHEN o_orderkey % 2 = 0 THEN 'type' WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN 'order' ELSE 'other' END WHEN o_orderkey % 5 = 0 THEN 'multiplicity' WHEN o_orderkey % 11 = 0 THEN 'truncation' ELSE 'other' END AS mechanism FROM orders")
def _(spark, folder):
    o, k = table(spark, folder, "orders"), F.col("o_orderkey")
    return o.select(k.alias("pair"), mechanism(k % 2 != 0, k % 3 == 0, (k % 5 == 0) | (k % 3 == 0), k % 11 == 0, k % 7 == 0).alias("mechanism"))


@query("compare_statements", f"SELECT false AS equal, 1 AS set_reading, 'multiplicity' AS mechanism, (SELECT count(*) FROM ({GOLD})) AS gold_rows, (SELECT count(*) FROM ({SECOND})) AS second_rows")
def _(spark, folder):
    return audit.compare(*_two(spark, folder, GOLD, SECOND), "set").select("equal", "set_reading", "mechanism", "gold_rows", "second_rows")


# ---- probes ----


@query("tie_at_cut", "WITH p AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS pos FROM part), e AS (SELECT (SELECT p_size FROM p WHERE pos = 99) a, (SELECT p_size FROM p WHERE pos = 100) b) SELECT p_partkey, p_size, pos FROM p, e WHERE a = b AND p_size = a")
def _(spark, folder):
    df = with_pos(run(spark, folder, "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey"))
    return probes.tie_at_cut(df, ["p_size"], 100).select("p_partkey", "p_size", F.col("_pos").alias("pos"))


CUT = "SELECT p_partkey AS k FROM part WHERE p_brand IS DISTINCT FROM 'Brand#11' ORDER BY p_size DESC LIMIT 90 OFFSET 10"


@query("cut_probe", "WITH p AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size DESC) AS n FROM part WHERE p_brand IS DISTINCT FROM 'Brand#11'), e AS (SELECT min(p_size) AS a FROM p WHERE n IN (100, 101) HAVING min(p_size) = max(p_size)) SELECT p_partkey AS k, p_size AS edge, (SELECT count(*) FROM p, e WHERE p_size = a) AS tied, (SELECT count(DISTINCT p_partkey) FROM p, e WHERE p_size = a) AS answers FROM p, e WHERE p_size = a")
def _(spark, folder):
    """The rows that tie across a statement's cut, by its own rewrite and the edge's key, with the probe's counts."""
    envelope = Envelope.open(spark, {"part": table(spark, folder, "part")}, row_budget=None)
    every, top, names = probes.cut_parts(probes.Held(envelope, parse(envelope.spark, CUT)))
    tied = probes.with_keys_of(every, probes.tie_edge(top, names, 100), names)
    counted = probes.answers_of(tied, names).select(F.col("rows").alias("tied"), "answers")
    return tied.select("k", F.col(names[0]).alias("edge")).crossJoin(counted)  # one row


BY_TEXT = "SELECT k FROM sizes WHERE v IS DISTINCT FROM '7' ORDER BY v DESC NULLS LAST, k LIMIT 400"


@query("number_probe", "WITH s AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_size <> 7), a AS (SELECT k, row_number() OVER (ORDER BY CAST(v AS VARCHAR) DESC, k) - 1 AS pos FROM s), b AS (SELECT k, row_number() OVER (ORDER BY v DESC, k) - 1 AS pos FROM s) SELECT pos, a.k AS text_order, b.k AS number_order FROM a JOIN b USING (pos) WHERE pos < 400 AND a.k <> b.k")
def _(spark, folder):
    """Where a statement that orders by text differs from its rewrite that orders by number."""
    envelope = Envelope.open(spark, {"sizes": table(spark, folder, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("string").alias("v"))}, row_budget=None)
    held = probes.Held(envelope, parse(envelope.spark, BY_TEXT))
    a, b = with_pos(held["base"]), with_pos(held.run(ordered_as_number(held.statement, 0)))
    return a.join(b.withColumnRenamed("k", "number_order"), "_pos").where("k <> number_order").select(F.col("_pos").alias("pos"), F.col("k").alias("text_order"), "number_order")


@query("null_first_cut", "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey END AS k FROM orders), p AS (SELECT *, row_number() OVER (ORDER BY k NULLS FIRST, o_orderkey) - 1 AS pos FROM o) SELECT o_orderkey, pos FROM p WHERE pos < 20 AND k IS NULL")
def _(spark, folder):
    df = with_pos(run(spark, folder, "SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey END AS k FROM orders ORDER BY k NULLS FIRST, o_orderkey"))
    return probes.null_first_rows(df, ["k"], [True], 0, 20).select("o_orderkey", F.col("_pos").alias("pos"))


@query("numeric_text_census", "WITH t AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 10 = 1 THEN '' WHEN p_partkey % 10 = 2 THEN p_name WHEN p_partkey % 10 = 3 THEN p_size || 'e2' WHEN p_partkey % 10 = 4 THEN '+' || p_size WHEN p_partkey % 10 = 5 THEN ' ' || p_size WHEN p_partkey % 10 = 6 THEN '-' || p_size || '.50' ELSE CAST(p_size AS VARCHAR) END v, p_partkey % 10 AS kind FROM part) SELECT count(*) AS rows, count(*) FILTER (kind = 0) AS nulls, count(*) FILTER (kind = 1) AS empties, count(*) FILTER (kind IN (2, 3, 4, 5)) AS not_numbers FROM t")
def _(spark, folder):
    df = run(spark, folder, "SELECT CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 10 = 1 THEN '' WHEN p_partkey % 10 = 2 THEN p_name WHEN p_partkey % 10 = 3 THEN p_size || 'e2' WHEN p_partkey % 10 = 4 THEN '+' || p_size WHEN p_partkey % 10 = 5 THEN ' ' || p_size WHEN p_partkey % 10 = 6 THEN '-' || p_size || '.50' ELSE CAST(p_size AS STRING) END AS v FROM part")
    return probes.numeric_text_census(df, "v")


@query("numeric_text_order", "WITH a AS (SELECT p_partkey k, row_number() OVER (ORDER BY CAST(p_size AS VARCHAR), p_partkey) - 1 p FROM part), b AS (SELECT p_partkey k, row_number() OVER (ORDER BY p_size, p_partkey) - 1 p FROM part) SELECT a.p AS pos, 'int:' || a.k AS text_order, 'int:' || b.k AS number_order FROM a JOIN b ON a.p = b.p WHERE a.k <> b.k")
def _(spark, folder):
    a, b = _two(spark, folder, "SELECT p_partkey FROM part ORDER BY CAST(p_size AS STRING), p_partkey", "SELECT p_partkey FROM part ORDER BY try_cast(CAST(p_size AS STRING) AS DOUBLE), p_partkey")
    return ordered.compared(with_pos(a), with_pos(b)).where("gold_line <> second_line").select(F.col("_pos").alias("pos"), F.col("gold_line").alias("text_order"), F.col("second_line").alias("number_order"))


@query("duplicate_full_row", "WITH p AS (SELECT c_nationkey, c_mktsegment, row_number() OVER (ORDER BY c_custkey) - 1 pos FROM customer) SELECT 'int:' || c_nationkey AS nation, 'str:' || c_mktsegment AS segment, count(*) AS n, min(pos) AS first_pos FROM p GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 1")
def _(spark, folder):
    df = with_pos(run(spark, folder, "SELECT c_nationkey, c_mktsegment, c_custkey FROM customer ORDER BY c_custkey")).drop("c_custkey")
    return multiset.repeated(df, "_pos").select(F.element_at("key", 1).alias("nation"), F.element_at("key", 2).alias("segment"), "n", "first_pos")


@query("direction_against_question", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 2 = 1 WHEN p_partkey % 3 = 1 THEN p_partkey % 2 = 0 END AS against FROM part")
def _(spark, folder):
    k = F.col("p_partkey")
    question = F.when(k % 3 == 0, "Which part has the highest price?").when(k % 3 == 1, "Name the cheapest part.").otherwise("List parts.")
    return table(spark, folder, "part").select(k, probes.against_direction(question, k % 2 == 0).alias("against"))


@query("float_six_digits", "SELECT o_orderkey, o_orderkey % 2 = 0 OR o_totalprice = 0 AS same FROM orders")
def _(spark, folder):
    v = F.col("o_totalprice")
    other = v * F.when(F.col("o_orderkey") % 2 == 0, 1 + 1e-13).otherwise(1.01)
    return table(spark, folder, "orders").select("o_orderkey", (probes.six_digits(v) == probes.six_digits(other)).alias("same"))


@query("float_aggregate_order")
def _(spark, folder):
    a = run(spark, folder, "SELECT l_returnflag, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem GROUP BY 1 ORDER BY 1")
    b = run(spark, folder, "SELECT l_returnflag, sum(l_extendedprice * (1 - l_discount)) AS v FROM (SELECT * FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber) GROUP BY 1 ORDER BY 1")
    return probes.float_order_only(with_pos(a), with_pos(b))


@query("unordered_limit_shuffle")
def _(spark, folder):
    from plumbline.operators.shuffle import shuffled

    base = run(spark, folder, "SELECT n_name FROM nation LIMIT 5")
    again = shuffled(table(spark, folder, "nation"), "1").select("n_name").limit(5)
    return multiset.difference(base, again).select("side", F.element_at("key", 1).alias("row"), "n")


@query("demo_audit")
def _(spark, folder):
    from plumbline.sources import demo

    questions = spark.createDataFrame([(q["question_id"], q["db_id"], q["question"], q["SQL"]) for q in demo.QUESTIONS], "question_id long, db_id string, question string, SQL string")
    predictions = spark.createDataFrame(list(demo.PREDICTIONS.items()), "question_id long, statement string")
    return audit.audit(spark, questions, demo.tables(spark), predictions, timeout=None).select("question_id", "verdict", "mechanism", "set_reading", F.array_join("probes", ",").alias("probes"), "error_side")


# ---- statements' text ----

_STATEMENTS = [
    ("SELECT DISTINCT c.c_name FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey ORDER BY 1 LIMIT 5 OFFSET 2", "customer,orders", True, 5, 2, True, False),
    ("SELECT n_name FROM nation UNION SELECT r_name FROM region", "nation,region", False, -1, -1, False, True),
    ("WITH t AS (SELECT * FROM part) SELECT count(*) FROM t", "part", False, -1, -1, False, False),
    ("SELECT p_name FROM part WHERE p_size IN (SELECT p_size FROM part WHERE p_brand = 'x') ORDER BY p_size DESC", "part", True, -1, -1, False, False),
]


def _values(rows, names: str) -> str:
    cell = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({names})"


@query("statement_facts", _values([(i, *x[1:]) for i, x in enumerate(_STATEMENTS)], "statement, tables, ordered, bound, skipped, is_distinct, set_operation"))
def _(spark, folder):
    found = [parse(spark, x[0]) for x in _STATEMENTS]
    rows = [(i, ",".join(sorted(s.tables)), s.rule == "ordered", s.limit if s.limit_stated else -1, s.offset if s.offset_stated else -1, s.distinct, s.set_operation) for i, s in enumerate(found)]
    return spark.createDataFrame(rows, "statement int, tables string, ordered boolean, bound int, skipped int, is_distinct boolean, set_operation boolean")


_REWRITES = [
    ("SELECT a FROM t WHERE b = 1", "select a  from t where b = 1;", "", "same"),
    ("SELECT a FROM t WHERE b = 1", "SELECT a FROM t WHERE b = 2", "where", "where"),
    ("SELECT a FROM t ORDER BY a", "SELECT a FROM t ORDER BY a DESC", "order", "order"),
    ("SELECT a FROM t", "SELECT DISTINCT a FROM t", "distinct", "distinct"),
    ("SELECT a FROM t", "SELECT a FROM u", "tables", "whole_rewrite"),
]


@query("clause_difference", _values([(i, x[2], x[3]) for i, x in enumerate(_REWRITES)], "pair, clauses, class"))
def _(spark, folder):
    rows = [(i, ",".join(touched), kind) for i, (a, b, *_) in enumerate(_REWRITES) for touched, kind in [clause_difference(spark, a, b)]]
    return spark.createDataFrame(rows, "pair int, clauses string, class string")


@query("construct_census", _values([(0, "distinct,join,limit,offset,sort"), (1, "union"), (2, "aggregate,call_count,cte"), (3, "in_subquery,sort,where")], "statement, constructs"))
def _(spark, folder):
    rows = [(i, ",".join(sorted(k for k, v in construct_census(spark, x[0]).items() if v))) for i, x in enumerate(_STATEMENTS)]
    return spark.createDataFrame(rows, "statement int, constructs string")


_OPERANDS = [
    ("SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_name", "equal,order_by"),
    ("SELECT c_mktsegment, min(c_name) AS n FROM customer GROUP BY c_mktsegment", "group_by,min_max"),
    ("SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_brand > 'B' ORDER BY p_size", "less_or_more,like"),
    ("SELECT max(p_size) AS s FROM part WHERE p_size > 3 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')", "equal"),
    ("SELECT p_size, count(*) AS n FROM part WHERE p_size = 4 GROUP BY p_size ORDER BY n", ""),
]


@query("text_operands", _values([(i, x[1]) for i, x in enumerate(_OPERANDS)], "statement, operands"))
def _(spark, folder):
    rows = [(i, ",".join(sorted(k for k, v in text_operands(run(spark, folder, x[0])).items() if v))) for i, x in enumerate(_OPERANDS)]
    return spark.createDataFrame(rows, "statement int, operands string")


@query("token_difference", _values([("replace", "b", "c"), ("insert", "", "limit 1")], "kind, a, b"))
def _(spark, folder):
    held = token_difference("SELECT a, b FROM t", "SELECT a, c FROM t limit 1")
    return spark.createDataFrame([(k, " ".join(x), " ".join(y)) for k, x, y in held if k != "equal"], "kind string, a string, b string")


@query("record_round_trip", "SELECT true AS loads, true AS replays, false AS replays_other")
def _(spark, folder):
    from plumbline.plans import record
    from plumbline.plans.session import Envelope

    e = Envelope.open(spark, {"nation": table(spark, folder, "nation")})
    s = parse(spark, "SELECT n_name FROM nation ORDER BY n_nationkey DESC LIMIT 7")
    r = record.build(1, s, e, e.frame(s), fixture.measure({"nation": table(spark, folder, "nation")}))
    return spark.createDataFrame([(record.load(r.document()) == r, record.replay(r, e.frame(s)), record.replay(r, e.frame("SELECT n_name FROM nation ORDER BY n_nationkey")))], "loads boolean, replays boolean, replays_other boolean")


_RECORDED = {"same": GOLD, "repeated": SECOND, "fewer": "SELECT DISTINCT c_mktsegment FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment < 'F'"}


@query(
    "recorded_comparison",
    " UNION ALL ".join(f"SELECT '{n}' AS pair, {_same_bag(GOLD, q)} AS equal, (SELECT count(*) FROM ({GOLD})) AS gold_rows, (SELECT count(*) FROM ({q})) AS second_rows" for n, q in _RECORDED.items())
    + " UNION ALL SELECT 'other tables', NULL, NULL, NULL",
)
def _(spark, folder):
    """Records written with their rows, read again and compared; records over unlike tables are refused."""
    from plumbline.plans import record
    from plumbline.plans.session import Envelope
    from plumbline.sources.scratch import scratch_folder

    held = {t: table(spark, folder, t) for t in ("customer", "orders")}
    e, at = Envelope.open(spark, held, row_budget=None), scratch_folder(spark, "records")
    measured, gold = fixture.measure(held), parse(spark, GOLD)
    for name, sql in ({"gold": GOLD} | _RECORDED).items():
        df = e.result(sql)
        record.keep(record.build(1, gold, e, df, measured, sql), df, at, name)
    first = record.kept(spark, at, "gold")
    rows = []
    for name in _RECORDED:
        row = audit.compare_records(*first, *record.kept(spark, at, name)).first()
        rows.append((name, row["equal"], row["gold_rows"], row["second_rows"]))
    df = e.result(GOLD)
    try:
        audit.compare_records(*first, record.build(1, gold, e, df, fixture.measure({"customer": held["customer"]})), df)
    except audit.NotComparable:
        rows.append(("other tables", None, None, None))
    return spark.createDataFrame(rows, "pair string, equal boolean, gold_rows long, second_rows long")


@query("float_sum_orders")
def _(spark, folder):
    from plumbline.operators.shuffle import float_sums

    return float_sums(table(spark, folder, "customer"), "c_acctbal")


# ---- fixtures ----

_COUNTED = ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")


@query("row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in _COUNTED))
def _(spark, folder):
    return fixture.row_counts({t: table(spark, folder, t) for t in _COUNTED})


@query("schema_rows", "SELECT table_name, CAST(column_index - 1 AS BIGINT) AS place, column_name FROM duckdb_columns() WHERE table_name IN ('nation', 'region') AND schema_name = 'main'")
def _(spark, folder):
    rows = [(t, i, c) for t, i, c, _, _ in fixture.schema_rows({t: table(spark, folder, t) for t in ("nation", "region")})]
    return spark.createDataFrame(rows, "table_name string, place long, column_name string")


@query("content_rows", "SELECT count(*) AS rows, true AS order_free FROM orders")
def _(spark, folder):
    o = table(spark, folder, "orders")
    a, b = fixture.content_digest(o), fixture.content_digest(o.repartition(5, "o_custkey"))
    return a.crossJoin(b.toDF("r", "s", "x")).select("rows", ((F.col("sum") == F.col("s")) & (F.col("xor") == F.col("x"))).alias("order_free"))


@query("document_digest", "SELECT sha256(string_agg(line || chr(10), '' ORDER BY line)) AS digest FROM (SELECT 'int:' || n_nationkey || chr(9) || 'str:' || n_name || chr(9) || 'int:' || n_regionkey AS line FROM nation)")
def _(spark, folder):
    return spark.createDataFrame([(fixture.document_digest(table(spark, folder, "nation")),)], "digest string")


@query("canonical_lines", "SELECT 'int:' || o_orderkey || chr(9) || 'str:' || o_orderstatus || chr(9) || CASE WHEN o_custkey % 10 = 0 THEN 'null:NULL' ELSE 'int:' || o_custkey END AS line FROM orders")
def _(spark, folder):
    df = keys.by_place(run(spark, folder, "SELECT o_orderkey, o_orderstatus, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END FROM orders"))
    return df.select(keys.canonical_line(df).alias("line"))


@query("canonical_numbers", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(38, 6)) AS VARCHAR) AS text FROM lineitem")
def _(spark, folder):
    df = table(spark, folder, "lineitem")
    return df.select("l_orderkey", "l_linenumber", keys.rendered(F.col("l_extendedprice"), df.schema["l_extendedprice"].dataType).alias("text"))


_UP = "repeat('0', 40)"


@query("wide_numbers", f"SELECT l_orderkey, l_linenumber, l_linenumber || {_UP} || '.000000' AS huge, '-' || (l_orderkey + 1) || repeat('0', 25) || '.250000' AS wide, 'dec:' || (l_orderkey + 1) || repeat('0', 25) AS typed, true AS exact, false AS inexact FROM lineitem")
def _(spark, folder):
    """Doubles and decimals that no DECIMAL(38,6) holds: canonical text, typed key, and the set rule between the two."""
    df = table(spark, folder, "lineitem")
    order, line = (F.col("l_orderkey") + 1).cast("string"), F.col("l_linenumber").cast("string")
    huge, wide = F.concat(line, F.lit("e40")).cast("double"), F.concat(F.lit("-"), order, F.repeat(F.lit("0"), F.lit(25)), F.lit(".25")).cast("decimal(38,2)")
    double = T.DoubleType()
    same = lambda zeros: keys.set_reading_key(F.concat(line, F.lit(f"e{zeros}")).cast("double"), double) == keys.set_reading_key(F.concat(line, F.repeat(F.lit("0"), F.lit(zeros))).cast("decimal(38,0)"), T.DecimalType(38, 0))
    return df.select("l_orderkey", "l_linenumber", keys.rendered(huge, double).alias("huge"), keys.rendered(wide, T.DecimalType(38, 2)).alias("wide"), keys.cell_key(F.concat(order, F.lit("e25")).cast("double"), double).alias("typed"), same(20).alias("exact"), same(27).alias("inexact"))


@query("storage_class_census", "WITH t AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_partkey % 4 = 1 THEN p_size || '.5' WHEN p_partkey % 4 = 2 THEN p_name END v FROM part) SELECT 'v' AS column_name, count(*) FILTER (v IS NULL) AS nulls, count(*) FILTER (regexp_matches(v, '^\\s*[+-]?\\d+\\s*$')) AS integers, count(*) FILTER (regexp_matches(v, '^\\s*[+-]?(\\d+\\.\\d*|\\.\\d+|\\d+(\\.\\d*)?[eE][+-]?\\d+)\\s*$')) AS reals, count(*) FILTER (v IS NOT NULL AND NOT regexp_matches(v, '^\\s*[+-]?\\d+\\s*$') AND NOT regexp_matches(v, '^\\s*[+-]?(\\d+\\.\\d*|\\.\\d+|\\d+(\\.\\d*)?[eE][+-]?\\d+)\\s*$')) AS texts FROM t")
def _(spark, folder):
    df = run(spark, folder, "SELECT CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS STRING) WHEN p_partkey % 4 = 1 THEN p_size || '.5' WHEN p_partkey % 4 = 2 THEN p_name END AS v FROM part")
    return fixture.storage_class_census(df, ["v"])


@query("typing_census", "WITH a AS (SELECT DISTINCT CAST(l_quantity AS DOUBLE) v FROM lineitem), b AS (SELECT DISTINCT CAST(CAST(l_quantity AS INT) AS DOUBLE) v FROM lineitem) SELECT (SELECT count(*) FROM a) + (SELECT count(*) FROM b) AS typed, (SELECT count(*) FROM (SELECT v FROM a UNION SELECT v FROM b)) AS plain")
def _(spark, folder):
    return fixture.typing_census(*_two(spark, folder, "SELECT l_quantity FROM lineitem", "SELECT CAST(l_quantity AS INT) FROM lineitem"))


# ---- windows ----

CLOCK = datetime(1996, 7, 15, tzinfo=UTC)
_WINDOWS = {
    "last_30_days": ("last 30 days", "TIMESTAMP '1996-06-15'", "TIMESTAMP '1996-07-15'"),
    "last_month": ("last month", "TIMESTAMP '1996-06-01'", "TIMESTAMP '1996-07-01'"),
    "current_month": ("current month", "TIMESTAMP '1996-07-01'", "TIMESTAMP '1996-07-15'"),
    "last_quarter": ("last quarter", "TIMESTAMP '1996-04-01'", "TIMESTAMP '1996-07-01'"),
    "last_12_weeks": ("last 12 weeks", "TIMESTAMP '1996-04-22'", "TIMESTAMP '1996-07-15'"),
    "last_two_months": ("the last two months", "TIMESTAMP '1996-05-01'", "TIMESTAMP '1996-07-01'"),
    "last_year": ("the last year", "TIMESTAMP '1995-07-15'", "TIMESTAMP '1996-07-15'"),
    "last_12_complete_months": ("the last 12 complete months", "TIMESTAMP '1995-07-01'", "TIMESTAMP '1996-07-01'"),
}
for _name, (_phrase, _start, _end) in _WINDOWS.items():
    query(f"window_{_name}", f"SELECT count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= {_start} AND o_orderdate < {_end}")(
        lambda spark, folder, phrase=_phrase: windows.within(table(spark, folder, "orders"), "o_orderdate", windows.resolve(phrase, CLOCK)).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )


@query("trend_per_month", "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, count(*) AS rows FROM orders WHERE o_orderdate < TIMESTAMP '1996-07-01' GROUP BY 1")
def _(spark, folder):
    return windows.by_period(table(spark, folder, "orders"), "o_orderdate", windows.resolve("per month (trend)", CLOCK))


@query("window_periods", "SELECT CAST(s AS TIMESTAMP) AS period_start, CAST(s + INTERVAL 7 DAY AS TIMESTAMP) AS period_end FROM generate_series(TIMESTAMP '1996-04-22', TIMESTAMP '1996-07-08', INTERVAL 7 DAY) t(s)")
def _(spark, folder):
    return windows.period_table(spark, windows.resolve("last 12 weeks", CLOCK), "week")


# ---- runs ----

#: A run of judged questions, one for each order.
JUDGED = """
SELECT CAST(o_orderkey AS BIGINT) AS question_id, o_orderpriority AS benchmark, o_orderstatus AS model,
  CASE WHEN o_orderkey % 11 = 0 THEN 'ERROR' WHEN o_orderkey % 3 = 0 THEN 'NOT_EQUAL' ELSE 'EQUAL' END AS verdict,
  CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 3 = 0 THEN
    CASE WHEN o_orderkey % 5 = 0 THEN 'type' WHEN o_orderkey % 5 = 1 THEN 'order' WHEN o_orderkey % 5 = 2 THEN 'multiplicity' WHEN o_orderkey % 5 = 3 THEN 'truncation' ELSE 'other' END END AS mechanism,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS set_reading,
  CASE WHEN o_orderkey % 22 = 0 THEN 'gold' WHEN o_orderkey % 33 = 0 THEN 'second' END AS timed_out_side,
  CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS score, CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END AS other_score,
  o_orderkey % 17 = 0 AS cut, o_orderkey % 13 = 0 AS repeats, CAST(o_custkey AS BIGINT) AS place
FROM orders"""
_J = f"WITH j AS ({JUDGED}) "


def judged(spark: SparkSession, folder: str) -> DataFrame:
    df = run(spark, folder, JUDGED)
    probe = lambda c, n: F.when(F.col(c), F.array(F.lit(n))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("probes", F.concat(probe("cut", "arbitrary-cut"), probe("repeats", "duplicate-full-row")))


_FIXED = lambda names, of: f"(VALUES {', '.join(f'({n!r})' for n in names)}) f({of})"


@query("verdict_counts", _J + f"SELECT f.verdict, count(j.question_id) AS n FROM {_FIXED(runs.VERDICTS, 'verdict')} LEFT JOIN j ON j.verdict = f.verdict GROUP BY 1")
def _(spark, folder):
    return runs.verdict_counts(judged(spark, folder))


@query("probe_counts", _J + f"SELECT f.probe, count(j.p) AS n FROM {_FIXED(probes.NAMES, 'probe')} LEFT JOIN (SELECT 'arbitrary-cut' p FROM j WHERE cut UNION ALL SELECT 'duplicate-full-row' FROM j WHERE repeats) j ON j.p = f.probe GROUP BY 1")
def _(spark, folder):
    return runs.probe_counts(judged(spark, folder), probes.NAMES)


@query("credited_by_mechanism", _J + f"SELECT f.mechanism, count(j.question_id) AS n FROM {_FIXED(runs.MECHANISMS, 'mechanism')} LEFT JOIN (SELECT * FROM j WHERE set_reading = 1 AND verdict = 'NOT_EQUAL') j ON j.mechanism = f.mechanism GROUP BY 1")
def _(spark, folder):
    return runs.credited_by_mechanism(judged(spark, folder))


@query("credited_by_test_suite", _J + "SELECT mechanism, test_suite, count(*) AS n FROM (SELECT *, CASE WHEN question_id % 4 = 0 THEN NULL ELSE CAST(question_id % 4 = 1 AS INT) END AS test_suite FROM j WHERE set_reading = 1 AND verdict = 'NOT_EQUAL') GROUP BY 1, 2")
def _(spark, folder):
    k = F.col("question_id") % 4
    return runs.credited_split(judged(spark, folder).withColumn("test_suite", F.when(k != 0, (k == 1).cast("int"))))


@query("timed_out_by_side", _J + "SELECT timed_out_side AS side, count(*) AS n, sum(question_id)::BIGINT AS ids FROM j WHERE timed_out_side IS NOT NULL GROUP BY 1")
def _(spark, folder):
    return runs.errors_by_side(judged(spark, folder)).select("side", "n", F.aggregate("question_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))


@query("mechanism_counts", _J + "SELECT mechanism, count(*) AS n FROM j WHERE mechanism IS NOT NULL GROUP BY 1")
def _(spark, folder):
    return runs.mechanism_counts(judged(spark, folder))


@query("index_pages", _J + "SELECT 'verdict' AS kind, verdict AS name, count(*) AS n FROM j GROUP BY 2 UNION ALL SELECT 'mechanism', mechanism, count(*) FROM j WHERE mechanism IS NOT NULL GROUP BY 2 UNION ALL SELECT 'probe', 'arbitrary-cut', count(*) FROM j WHERE cut UNION ALL SELECT 'probe', 'duplicate-full-row', count(*) FROM j WHERE repeats")
def _(spark, folder):
    return runs.index_pages(judged(spark, folder))


@query("question_index", _J + "SELECT question_id, CASE WHEN verdict = 'ERROR' THEN 'error' ELSE 'page' END AS entry FROM j")
def _(spark, folder):
    j = judged(spark, folder)
    return runs.question_index(j.where("verdict <> 'ERROR'"), j.where("verdict = 'ERROR'"))


@query("reconcile", _J + "SELECT question_id, CASE WHEN question_id % 3 = 0 THEN 'missing' ELSE 'extra' END AS problem FROM j WHERE (question_id % 3 = 0) <> (question_id % 4 = 0) AND (question_id % 3 = 0 OR question_id % 4 = 0)")
def _(spark, folder):
    j = judged(spark, folder)
    return runs.reconcile(j.where("question_id % 3 = 0"), j.where("question_id % 4 = 0"))


@query("classification", _J + "SELECT question_id, verdict, CASE WHEN question_id % 9 = 0 THEN 'gold wrong' END AS hand FROM j")
def _(spark, folder):
    j = judged(spark, folder)
    by_hand = j.where("question_id % 9 = 0").select("question_id", F.lit("gold wrong").alias("hand"))
    return runs.with_classification(j, by_hand).select("question_id", "verdict", "hand")


@query("group_sums", _J + "SELECT benchmark, model, sum(score)::BIGINT AS score, sum(other_score)::BIGINT AS other_score FROM j GROUP BY 1, 2")
def _(spark, folder):
    return runs.group_sums(judged(spark, folder), ["benchmark", "model"], ["score", "other_score"])


@query("crosstab", _J + "SELECT mechanism, count(*) FILTER (model = 'F') AS \"F\", count(*) FILTER (model = 'O') AS \"O\", count(*) FILTER (model = 'P') AS \"P\", count(*) AS total FROM j WHERE mechanism IS NOT NULL GROUP BY 1")
def _(spark, folder):
    return runs.crosstab(judged(spark, folder).where("mechanism IS NOT NULL"), "mechanism", "model", ["F", "O", "P"])


@query("agreement", _J + "SELECT count(*) AS questions, count(*) FILTER (coalesce(set_reading, 0) = score) AS agree, count(*) FILTER (coalesce(set_reading, 0) = 1 AND score = 0) AS own_only, count(*) FILTER (coalesce(set_reading, 0) = 0 AND score = 1) AS official_only FROM j")
def _(spark, folder):
    j = judged(spark, folder)
    return runs.agreement(j, j.select("question_id", "score"))


@query("agreement_rows", _J + "SELECT question_id, CAST(coalesce(set_reading, 0) AS INT) AS own, score AS official, coalesce(set_reading, 0) = score AS agrees FROM j")
def _(spark, folder):
    j = judged(spark, folder)
    return runs.agreement_rows(j, j.select("question_id", "score"))


@query("crosstab_cells", _J + "SELECT mechanism, model, count(*) AS n, count(*) FILTER (cut) AS arbitrary_cut, count(*) FILTER (repeats) AS duplicate_full_row, min(question_id) AS first_id, max(question_id) AS last_id FROM j WHERE mechanism IS NOT NULL GROUP BY 1, 2")
def _(spark, folder):
    return runs.crosstab_cells(judged(spark, folder).where("mechanism IS NOT NULL"), "mechanism", "model", ("arbitrary-cut", "duplicate-full-row"))


@query("crosstab_ids", _J + "SELECT DISTINCT mechanism, model, question_id FROM j WHERE mechanism IS NOT NULL AND model IS NOT NULL")
def _(spark, folder):
    return runs.crosstab_ids(judged(spark, folder), "mechanism", "model")


_MEASURES = {"current": "cut", "combined": "cut OR repeats OR s", "increment repeats": "repeats AND NOT cut", "increment s": "s AND NOT (cut OR repeats)", "overlap cut repeats": "cut AND repeats", "overlap cut s": "cut AND s", "overlap repeats s": "repeats AND s"}


@query("candidate_checks", _J + ", k AS (SELECT *, score = 1 AS s FROM j) " + " UNION ALL ".join(f"SELECT '{n}' AS measure, count(*) FILTER ({c}) AS n FROM k" for n, c in _MEASURES.items()))
def _(spark, folder):
    return runs.candidate_checks(judged(spark, folder).withColumn("s", F.col("score") == 1), "cut", ["repeats", "s"])


@query("copy_delta", _J + ", b AS (SELECT question_id, CASE WHEN question_id % 23 = 0 THEN 'EQUAL' ELSE verdict END AS verdict, set_reading FROM j WHERE question_id % 19 <> 0) SELECT j.question_id, j.verdict AS a_verdict, j.set_reading AS a_reading, b.verdict AS b_verdict, b.set_reading AS b_reading FROM j LEFT JOIN b ON b.question_id = j.question_id WHERE b.question_id IS NULL OR j.verdict <> b.verdict")
def _(spark, folder):
    j = judged(spark, folder)
    other = j.where("question_id % 19 <> 0").withColumn("verdict", F.when(F.col("question_id") % 23 == 0, "EQUAL").otherwise(F.col("verdict")))
    return runs.copy_delta(j, other)


@query("recall_in_passes", _J + ", g AS (SELECT benchmark AS name, * FROM j UNION ALL SELECT 'all', * FROM j) SELECT name, count(*) AS size, count(*) FILTER (cut OR repeats) AS fired_before, round(count(*) FILTER (cut OR repeats) / count(*), 4) AS share_before, count(*) FILTER (cut) AS fired_after, round(count(*) FILTER (cut) / count(*), 4) AS share_after FROM g GROUP BY 1")
def _(spark, folder):
    j = judged(spark, folder)
    members = j.select(F.col("benchmark").alias("name"), "question_id").unionByName(j.select(F.lit("all").alias("name"), "question_id"))
    return runs.recall_in_passes(members, {"before": j, "after": j.withColumn("probes", F.array_remove("probes", "duplicate-full-row"))})


@query("strided_sample", _J + ", p AS (SELECT question_id, model, row_number() OVER (ORDER BY model, question_id) - 1 AS r, count(*) OVER () AS n FROM j) SELECT question_id, model FROM p WHERE n < 100 OR (r % greatest(n // 50, 1) = 0 AND r < 50 * greatest(n // 50, 1))")
def _(spark, folder):
    return runs.strided_sample(judged(spark, folder), ["model", "question_id"], 50).select("question_id", "model")


_ANSWERS = {"identical": "SELECT l_quantity FROM lineitem", "typed": "SELECT CAST(l_quantity AS INT) AS q FROM lineitem", "repeated": "SELECT l_quantity FROM lineitem UNION ALL SELECT max(l_quantity) FROM lineitem", "other": "SELECT l_quantity + 1 AS q FROM lineitem"}
_ANSWER = lambda n, q: f"SELECT '{n}' AS pair, CASE WHEN NOT {_same_set(_ANSWERS['identical'], q)} THEN 'different-rows' WHEN NOT {_same_bag(_ANSWERS['identical'], q)} THEN 'multiplicity' WHEN (SELECT min(typeof(v)) FROM ({q}) t(v)) <> (SELECT min(typeof(l_quantity)) FROM lineitem) THEN 'typed-only' ELSE 'identical' END AS class"


@query("answer_of", " UNION ALL ".join(_ANSWER(n, q) for n, q in _ANSWERS.items()))
def _(spark, folder):
    return _pairs(spark, folder, _ANSWERS["identical"], _ANSWERS, runs.answer_of).select("pair", "class")


@query("published", _J + ", f AS (SELECT 'credited' AS name, question_id FROM j WHERE set_reading = 1 AND verdict = 'NOT_EQUAL' UNION ALL SELECT 'timed out', question_id FROM j WHERE timed_out_side IS NOT NULL) SELECT name, count(*) AS value, count(*) FILTER (question_id % 3 <> 1) AS published FROM f GROUP BY 1")
def _(spark, folder):
    j = judged(spark, folder)
    found = j.where("set_reading = 1 AND verdict = 'NOT_EQUAL'").select(F.lit("credited").alias("name"), "question_id").unionByName(j.where("timed_out_side IS NOT NULL").select(F.lit("timed out").alias("name"), "question_id"))
    return runs.published(found, j.where("question_id % 3 <> 1"))


_COPY_CUSTOMER = "SELECT c_custkey, c_name, CASE WHEN c_custkey % 1000 = 1 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey FROM customer"


@query("two_copies", f"SELECT 'customer' AS table_name, (SELECT count(*) FROM customer) AS rows, (SELECT count(*) FROM customer) AS other_rows, {_same_bag('SELECT c_custkey, c_name, c_nationkey FROM customer', _COPY_CUSTOMER)} AS same UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), NULL, false UNION ALL SELECT 'part', (SELECT count(*) FROM part), (SELECT count(*) FROM part), true")
def _(spark, folder):
    customer, part = run(spark, folder, "SELECT c_custkey, c_name, c_nationkey FROM customer"), table(spark, folder, "part")
    return fixture.two_copies({"customer": customer, "nation": table(spark, folder, "nation"), "part": part}, {"customer": run(spark, folder, _COPY_CUSTOMER), "part": part.repartition(5, "p_size")})


@query("split_three_way", "SELECT p_partkey AS question_id, CASE WHEN p_partkey % 7 = 0 THEN 'only_second' WHEN p_partkey % 11 = 0 THEN 'only_first' WHEN p_partkey % 3 = 0 THEN 'unchanged' WHEN p_partkey % 3 = 1 THEN 'text_only' ELSE 'rewritten' END AS change FROM part")
def _(spark, folder):
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("question_id"), F.concat(F.lit("SELECT "), "p_name").alias("statement"))
    k = F.col("question_id") % 3
    q = p.withColumn("statement", F.when(k == 0, F.col("statement")).when(k == 1, F.concat(F.replace(F.upper("statement"), F.lit(" "), F.lit("  \n")), F.lit(" ;"))).otherwise(F.concat("statement", F.lit(" LIMIT 1"))))
    return runs.split_three_way(p.where("question_id % 7 <> 0"), q.where("question_id % 11 <> 0 OR question_id % 7 = 0"), runs.normalised_statement)


@query("probe_recall", _J + "SELECT benchmark, p AS probe, count(*) FILTER (fired) AS fired, count(*) AS size, round(count(*) FILTER (fired) / count(*), 3) AS rate FROM (SELECT benchmark, 'arbitrary-cut' p, cut fired FROM j UNION ALL SELECT benchmark, 'duplicate-full-row', repeats FROM j) GROUP BY 1, 2")
def _(spark, folder):
    return runs.recall(judged(spark, folder), "benchmark", ("arbitrary-cut", "duplicate-full-row"))


@query("overlap_matrix", "WITH m AS (SELECT DISTINCT l_orderkey i, l_returnflag || l_linestatus l FROM lineitem) SELECT a.l AS a, b.l AS b, count(*) AS shared FROM m a JOIN m b ON a.i = b.i AND a.l <= b.l GROUP BY 1, 2")
def _(spark, folder):
    m = table(spark, folder, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("name"))
    return runs.overlap_matrix(m, "l_orderkey", "name")


@query("systematic_sample", _J + "SELECT question_id, benchmark FROM (SELECT *, count(*) OVER (PARTITION BY benchmark) n, row_number() OVER (PARTITION BY benchmark ORDER BY question_id) r FROM j) WHERE (r - 1) % CAST(ceil(n / 8.0) AS BIGINT) = 0")
def _(spark, folder):
    return runs.systematic_sample(judged(spark, folder), "benchmark", "question_id", 8).select("question_id", "benchmark")


@query("seeded_sample")
def _(spark, folder):
    return runs.seeded_sample(judged(spark, folder), "question_id", 7, 30).select("question_id")


@query("credits_moved", _J + "SELECT question_id, CASE WHEN other_score = 1 THEN 'gained' ELSE 'lost' END AS change FROM j WHERE score <> other_score")
def _(spark, folder):
    j = judged(spark, folder)
    return runs.moved(j.where("score = 1"), j.where("other_score = 1"))


@query("score_flips", _J + "SELECT question_id, CASE WHEN score < other_score THEN 'up' ELSE 'down' END AS direction FROM j WHERE score <> other_score")
def _(spark, folder):
    j = judged(spark, folder)
    return runs.flips(j.select("question_id", "score"), j.select("question_id", F.col("other_score").alias("score")))


@query("answer_class", _J + "SELECT question_id, CASE WHEN question_id % 2 = 0 THEN 'different-rows' WHEN question_id % 3 = 0 THEN 'multiplicity' WHEN question_id % 5 = 0 THEN 'typed-only' ELSE 'identical' END AS class FROM j")
def _(spark, folder):
    k = F.col("question_id")
    return judged(spark, folder).select(k, runs.answer_class(k % 5 != 0, k % 3 != 0, k % 2 != 0).alias("class"))


@query("referential_coverage", "SELECT (SELECT count(*) FROM orders) AS children, (SELECT count(*) FROM orders WHERE EXISTS (SELECT * FROM customer WHERE c_custkey = o_custkey AND c_custkey % 5 <> 0)) AS found, (SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT * FROM customer WHERE c_custkey = o_custkey AND c_custkey % 5 <> 0)) AS orphans, (SELECT count(*) FROM customer WHERE c_custkey % 5 <> 0 AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey)) AS childless")
def _(spark, folder):
    return runs.coverage(table(spark, folder, "customer").where("c_custkey % 5 <> 0"), table(spark, folder, "orders"), "c_custkey", "o_custkey")


@query("coverage_by_length", "WITH p AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 5 <> 0) SELECT CAST(length(CAST(o_custkey AS VARCHAR)) AS INT) AS length, count(*) AS children, count(p.k) AS found, count(DISTINCT o_custkey) AS keys FROM orders LEFT JOIN p ON p.k = o_custkey WHERE o_custkey IS NOT NULL GROUP BY 1")
def _(spark, folder):
    return runs.coverage_by_length(table(spark, folder, "customer").where("c_custkey % 5 <> 0"), table(spark, folder, "orders"), "c_custkey", "o_custkey")


@query("precision", _J + "SELECT benchmark, count(*) AS rows, count(*) FILTER (cut) AS good, round(count(*) FILTER (cut) / count(*), 3) AS precision, count(DISTINCT question_id) AS questions FROM j GROUP BY 1")
def _(spark, folder):
    return runs.precision(judged(spark, folder), "benchmark", "cut")


@query("unjust_scores", _J + "SELECT question_id, CASE WHEN score = 0 THEN 'unjust_zero' ELSE 'unjust_one' END AS kind FROM j WHERE score <> other_score")
def _(spark, folder):
    j = judged(spark, folder)
    return runs.unjust(j.select("question_id", "score"), j.select("question_id", F.col("other_score").alias("score")))


@query("probe_differences", _J + "SELECT question_id, CASE WHEN cut THEN 'arbitrary-cut' ELSE '' END || CASE WHEN cut AND repeats THEN ',' ELSE '' END || CASE WHEN repeats THEN 'duplicate-full-row' ELSE '' END AS a FROM j WHERE cut OR repeats")
def _(spark, folder):
    j = judged(spark, folder)
    none = j.select("question_id", F.array().cast("array<string>").alias("probes"))
    return runs.probe_differences(j, none).select("question_id", F.array_join("a", ",").alias("a"))


@query("copy_coverage", _J + "SELECT question_id, CAST(CASE WHEN question_id % 2 = 0 THEN 2 WHEN question_id % 3 = 0 THEN 3 ELSE 1 END AS INT) AS named, CAST(CASE WHEN question_id % 2 = 0 THEN 1 WHEN question_id % 3 = 0 THEN 2 ELSE 0 END AS INT) AS copied FROM j")
def _(spark, folder):
    named = lambda *ts: F.array(*map(F.lit, ts))
    k = F.col("question_id")
    tables = F.when(k % 2 == 0, named("orders", "customer", "orders")).when(k % 3 == 0, named("part", "nation", "orders")).otherwise(named("part"))
    return runs.copy_coverage(judged(spark, folder).select(k, tables.alias("tables")), ["orders", "nation"])


@query("headline", _J + "SELECT count(*) AS whole, count(*) FILTER (cut) AS part, count(*) - count(*) FILTER (cut) AS rest FROM j")
def _(spark, folder):
    return runs.headline(judged(spark, folder), F.col("cut"))


@query("merge_runs", _J + "SELECT benchmark, sum(score)::BIGINT AS score, count(*) FILTER (verdict = 'ERROR') AS errors FROM j GROUP BY 1")
def _(spark, folder):
    j = judged(spark, folder).select("benchmark", "score", F.when(F.col("verdict") == "ERROR", F.array("question_id")).otherwise(F.array().cast("array<long>")).alias("errors"))
    merged = runs.merge_runs([j.where("score = 0"), j.where("score = 1")], ["benchmark"], ["score"], ["errors"])
    return merged.select("benchmark", "score", F.size("errors").cast("long").alias("errors"))


@query("trimmed_selection", _J + "SELECT question_id FROM (SELECT *, sum(place) OVER (PARTITION BY cut ORDER BY r, benchmark DESC, question_id ROWS UNBOUNDED PRECEDING) t FROM (SELECT *, row_number() OVER (PARTITION BY cut, benchmark ORDER BY place, question_id) r FROM j)) WHERE cut OR t + (SELECT sum(place) FROM j WHERE cut) <= (SELECT sum(place) * 0.6 FROM j)")
def _(spark, folder):
    j = judged(spark, folder).select("question_id", "benchmark", F.col("place").alias("bytes"), F.col("cut").alias("protected"))
    budget = int(j.agg((F.sum("bytes") * 0.6).alias("b")).first()["b"])
    return runs.trimmed(j, budget).select("question_id")


@query("trimmed_selection_left_out", _J + "SELECT benchmark, count(*) AS questions, CAST(sum(place) AS BIGINT) AS bytes FROM (SELECT *, sum(place) OVER (PARTITION BY cut ORDER BY r, benchmark DESC, question_id ROWS UNBOUNDED PRECEDING) t FROM (SELECT *, row_number() OVER (PARTITION BY cut, benchmark ORDER BY place, question_id) r FROM j)) WHERE NOT cut AND t + (SELECT sum(place) FROM j WHERE cut) > (SELECT sum(place) * 0.6 FROM j) GROUP BY 1")
def _(spark, folder):
    j = judged(spark, folder).select("question_id", "benchmark", F.col("place").alias("bytes"), F.col("cut").alias("protected"))
    budget = int(j.agg((F.sum("bytes") * 0.6).alias("b")).first()["b"])
    return runs.left_out(j, runs.trimmed(j, budget))


_FILED = "f AS (SELECT *, place % 7 + 1 AS files FROM j), k AS (SELECT *, sum(place) OVER w AS t, sum(files) OVER w AS u FROM (SELECT *, row_number() OVER (PARTITION BY cut, benchmark ORDER BY place, question_id) r FROM f) WINDOW w AS (PARTITION BY cut ORDER BY r, benchmark DESC, question_id ROWS UNBOUNDED PRECEDING))"


@query("trimmed_by_files", _J + f", {_FILED} SELECT question_id, CASE WHEN cut OR t + (SELECT sum(place) FROM f WHERE cut) <= (SELECT sum(place) * 0.8 FROM f) AND u + (SELECT sum(files) FROM f WHERE cut) <= (SELECT sum(files) // 2 FROM f) THEN 'kept' ELSE 'over-budget' END AS reason FROM k")
def _(spark, folder):
    """A selection under a budget of bytes and one of files, and why the rest was left out."""
    j = judged(spark, folder).select("question_id", "benchmark", F.col("place").alias("bytes"), (F.col("place") % 7 + 1).alias("files"), F.col("cut").alias("protected"))
    most = j.agg((F.sum("bytes") * 0.8).alias("bytes"), F.sum("files").alias("files")).first()
    kept = runs.trimmed(j, int(most["bytes"]), files=most["files"] // 2)
    return runs.reasons_left_out(j, kept).select("question_id", "reason").unionAll(kept.select("question_id", F.lit("kept")))


@query("directories_by_run", "SELECT o_orderstatus AS run, count(*) AS questions FROM orders GROUP BY 1")
def _(spark, folder):
    o = table(spark, folder, "orders")
    member = lambda f: o.select(F.concat(F.lit("runs/"), "o_orderstatus", F.lit("/q"), F.col("o_orderkey").cast("string"), F.lit(f"/{f}")).alias("path"))
    return runs.directories_by_run(member("gold.json").unionAll(member("smells.json")))


# ---- statements that are run as they stand ----

passed_through("sql_scan_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IS NOT NULL")
passed_through("sql_inner_join", "SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON o_custkey = c_custkey WHERE c_nationkey NOT IN (1, 2, 3)")
passed_through("sql_multi_join", "SELECT r_name, n_name, count(*) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name")
passed_through("sql_cross_join", "SELECT r.r_name, n.n_name FROM region r, nation n WHERE r.r_regionkey < 2")
passed_through("sql_or_join", "SELECT count(*) AS n FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey OR a.n_regionkey = b.n_nationkey")
passed_through("sql_left_join", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
passed_through("sql_right_join", "SELECT s_suppkey, n_name FROM nation RIGHT JOIN supplier ON n_nationkey = s_nationkey AND n_regionkey = 1")
passed_through("sql_full_join", "SELECT coalesce(a.n_nationkey, -1) AS a, coalesce(b.n_nationkey, -1) AS b FROM (SELECT * FROM nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT * FROM nation WHERE n_nationkey > 10) b ON a.n_nationkey = b.n_nationkey")
passed_through("sql_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
passed_through("sql_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
passed_through("sql_in_subquery", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
passed_through("sql_aggregates", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY l_returnflag")
passed_through("sql_filter_aggregate", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS big FROM orders GROUP BY o_orderstatus")
passed_through("sql_listagg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
passed_through("sql_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
passed_through("sql_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
passed_through("sql_window", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS place FROM orders")
passed_through("sql_running_sum", "SELECT o_orderkey, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM orders")
passed_through("sql_sort_limit_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey ASC NULLS FIRST LIMIT 10 OFFSET 5")
passed_through("sql_union", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
passed_through("sql_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
passed_through("sql_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
passed_through("sql_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
passed_through("sql_cte", "WITH big AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) SELECT c_name, top FROM big JOIN customer ON c_custkey = o_custkey WHERE top > 350000")
passed_through("sql_recursive_cte", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 20) SELECT n, f FROM t")
passed_through("sql_from_subquery", "SELECT o_orderstatus, max(n) AS most FROM (SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY o_orderstatus, o_custkey) x GROUP BY o_orderstatus")
passed_through("sql_strings", "SELECT p_partkey, substr(p_name, 1, 3) AS head, instr(p_name, 'a') AS at, p_brand || '/' || p_type AS both, upper(p_name) AS loud, length(p_name) AS n, trim('  x ') AS t FROM part WHERE p_name LIKE '%a%'")
passed_through("sql_conditions", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS size, nullif(o_orderstatus, 'O') AS s, coalesce(nullif(o_orderstatus, 'F'), 'done') AS t FROM orders")
passed_through("sql_if", "SELECT o_orderkey, if(o_custkey % 2 = 0, 'even', 'odd') AS parity FROM orders")
passed_through("sql_dates", "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(extract(month FROM o_orderdate) AS INT) AS m, date_format(o_orderdate, 'yyyy-MM') AS ym, CAST(datediff(DATE '1998-12-31', CAST(o_orderdate AS DATE)) AS BIGINT) AS days FROM orders", "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(extract(month FROM o_orderdate) AS INT) AS m, strftime(o_orderdate, '%Y-%m') AS ym, datediff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') AS days FROM orders")
passed_through("sql_math", "SELECT c_custkey, round(c_acctbal, 1) AS r, abs(c_acctbal) AS a, CAST(c_nationkey AS DOUBLE) / 4 AS q, c_custkey % 7 AS m FROM customer", "SELECT c_custkey, round(c_acctbal, 1) AS r, abs(c_acctbal) AS a, CAST(c_nationkey AS DOUBLE) / 4 AS q, c_custkey % 7 AS m FROM customer")
passed_through("sql_try_cast", "SELECT p_partkey, try_cast(substr(p_brand, 7) AS INT) AS n FROM part")
passed_through("sql_regex", "SELECT p_partkey FROM part WHERE p_name RLIKE '^[a-m].*e'", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^[a-m].*e')")
passed_through("sql_distinct_on", "SELECT o_custkey, min_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY o_custkey", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey AS first_order FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey")


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
