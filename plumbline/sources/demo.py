"""A small fixture with a question for each kind of finding, and statements to audit on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "shop": ("id BIGINT, name STRING", [(1, "north"), (2, "south"), (3, "east"), (4, "west")]),
    "sale": ("id BIGINT, shop_id BIGINT, item STRING, amount DOUBLE", [(i, i % 4 + 1, f"item {i % 3}", [1e16, 1.0, -1e16, 0.5][i % 4]) for i in range(16)]),
    "mark": ("name STRING, score INT", [("a", 99), ("b", 99), ("c", 99), ("d", 70), ("e", 65), ("f", 60)]),
    "lap": ("id BIGINT, driver STRING, speed STRING", [(1, "x", "88.4"), (2, "y", "204.25"), (3, "z", None), (4, "w", "117.9")]),
}
QUESTIONS = [
    {"question_id": 1, "db_id": "demo", "question": "Which shops have sold anything?", "SQL": "SELECT DISTINCT s.name FROM shop s JOIN sale a ON a.shop_id = s.id"},
    {"question_id": 2, "db_id": "demo", "question": "Who has the highest score?", "SQL": "SELECT name FROM mark ORDER BY score DESC LIMIT 1"},
    {"question_id": 3, "db_id": "demo", "question": "Which driver has the highest speed?", "SQL": "SELECT driver FROM lap ORDER BY speed DESC LIMIT 1"},
    {"question_id": 4, "db_id": "demo", "question": "List the items sold.", "SQL": "SELECT item FROM sale"},
    {"question_id": 5, "db_id": "demo", "question": "How many shops are there?", "SQL": "SELECT count(*) AS n FROM shop"},
]
PREDICTIONS = {1: "SELECT s.name FROM shop s JOIN sale a ON a.shop_id = s.id", 2: "SELECT name FROM mark ORDER BY score LIMIT 1", 5: "SELECT count(id) AS shops FROM shop"}


def tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame(rows, schema) for name, (schema, rows) in TABLES.items()}
