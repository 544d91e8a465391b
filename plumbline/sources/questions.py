"""Question and prediction files."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what ends a predicted statement and names its database.
DATABASE_MARK = "\t----- bird -----\t"
QUESTION = "question_id long, db_id string, difficulty string, question string, evidence string, SQL string, places array<long>"
#: Fixed value: the largest question id.
MOST_ID = 999_999_999


class InputRefused(ValueError):
    pass


def file_digest(path: str, block: int = 4 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while data := f.read(block):
            h.update(data)
    return h.hexdigest()


def write_json(path: str, document: object) -> None:
    """Written whole or not at all."""
    temporary = f"{path}.{os.getpid()}.part"
    try:
        with open(temporary, "w", encoding="utf-8") as f:
            f.write(json.dumps(document, sort_keys=True, indent=1, ensure_ascii=False) + "\n")
        os.replace(temporary, path)
    finally:
        Path(temporary).unlink(missing_ok=True)


def write_question(out: str, question_id: int, documents: dict[str, object]) -> str:
    """The folder of a question's documents."""
    at = Path(out) / f"q{question_id}"
    at.mkdir(parents=True, exist_ok=True)
    for name, document in documents.items():
        write_json(str(at / name), document)
    return str(at)


MARKER = ".plumbline-run"


def clear_output(out: str) -> None:
    """Makes a run's folder, without the questions of a run before. A folder that isn't a run's is left alone."""
    folder = Path(out)
    if folder.exists() and any(folder.iterdir()) and not (folder / MARKER).exists():
        raise InputRefused(f"{out} holds files of something else")
    folder.mkdir(parents=True, exist_ok=True)
    (folder / MARKER).touch()
    for q in folder.glob("q[0-9]*"):
        shutil.rmtree(q)


def read_questions(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """Questions of a JSON list, or of an object with a list `questions`. Fields aren't coerced: a wrong type, a
    missing text or an id out of range is refused. An id given twice must say the same, and counts once; places are those
    of its entries in the file, from 0."""
    whole = spark.read.option("wholetext", True).text(path).select(F.parse_json("value").alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$.questions", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    entries = whole.select(F.posexplode(listed).alias("place", "q"))
    kind = lambda f: F.schema_of_variant(F.try_variant_get("q", f"$.{f}", "variant"))
    get = lambda f, t: F.try_variant_get("q", f"$.{f}", t)
    required, optional = ("db_id", "question", "SQL"), ("difficulty", "evidence")
    bad = kind("question_id").isNull() | (kind("question_id") != "BIGINT") | ~get("question_id", "long").between(0, MOST_ID)
    for f in required:
        bad = bad | kind(f).isNull() | (kind(f) != "STRING")
    for f in optional:
        bad = bad | F.coalesce(~kind(f).isin("STRING", "VOID"), F.lit(False))
    held = entries.select(F.col("place").cast("long").alias("place"), get("question_id", "long").alias("question_id"), *(get(f, "string").alias(f) for f in ("db_id", "difficulty", "question", "evidence", "SQL")), F.coalesce(bad, F.lit(True)).alias("_bad"))
    checked = held.agg(F.count_if("_bad").alias("bad"), F.count("*").alias("n")).first()
    if checked["bad"]:
        raise InputRefused(f"{checked['bad']} of {checked['n']} questions have a missing or wrong field")
    own = [c for c in held.columns if c not in ("_bad", "place")]
    distinct = held.groupBy(*own).agg(F.array_sort(F.collect_list("place")).alias("places"))
    twice = distinct.groupBy("question_id").count().where("count > 1").orderBy("question_id").limit(5).collect()
    if twice:
        raise InputRefused(f"questions that are given twice and differ: {[r['question_id'] for r in twice]}")
    if ids is not None:
        known = {r["question_id"] for r in distinct.where(F.col("question_id").isin(ids)).select("question_id").collect()}
        if missing := sorted(set(ids) - known):
            raise InputRefused(f"no questions {missing}")
        distinct = distinct.where(F.col("question_id").isin(ids))
    return distinct


def _statement(raw):
    text = F.trim(F.split_part(raw, F.lit(DATABASE_MARK), F.lit(1)))
    return F.when(text != "", text)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(key, statement) of a JSON object of statements by id or place. The number 0 and an empty text are no statement;
    a text "0" is one. Refused: what is no object, a key that is no whole number, a value that is no text."""
    whole = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    if whole.where(F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False))).isEmpty():
        raise InputRefused(f"{path} holds no object of predictions")
    rows = whole.select(F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("name", "raw"))
    of = F.schema_of_variant("raw")
    zero = F.coalesce(of.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(of, F.lit("DECIMAL")), F.lit(False)) & (F.try_variant_get("raw", "$", "double") == 0)
    text = F.try_variant_get("raw", "$", "string")
    key = F.when(F.rlike("name", F.lit(r"^\s*[+-]?[0-9]+\s*\z")), F.trim("name").try_cast("long"))
    held = rows.select("name", key.alias("key"), F.coalesce(of, F.lit("VOID")).alias("kind"), F.coalesce(zero, F.lit(False)).alias("zero"), _statement(text).alias("statement"))
    for bad, why in ((F.col("key").isNull(), "a key that is neither a question's id nor a place"), (~F.col("zero") & (F.col("kind") != "STRING"), "a value that is no statement")):
        if (one := held.where(bad).orderBy("name").first()) is not None:
            raise InputRefused(f"{path} has {why}: {one['name']!r}" + ("" if "key" in why else f" ({one['kind'].split('<')[0].lower()})"))
    return held.select("key", F.when(~F.col("zero"), F.col("statement")).alias("statement"))


def read_prediction_lines(spark: SparkSession, path: str) -> DataFrame:
    """(key, statement) of a file with a statement in each line, by place from 0. Only line feeds end lines."""
    whole = spark.read.format("binaryFile").load(path).select(F.decode("content", "UTF-8").alias("value"))
    lines = whole.select(F.posexplode(F.split("value", "\n")).alias("key", "raw"), F.size(F.split("value", "\n")).alias("n"))
    kept = lines.where(~((F.col("key") == F.col("n") - 1) & (F.col("raw") == "")))
    return kept.select(F.col("key").cast("long").alias("key"), _statement(F.regexp_replace("raw", "\r$", "")).alias("statement"))


def resolve(questions: DataFrame, predictions: DataFrame, by: str = "id") -> tuple[DataFrame, DataFrame]:
    """(question_id, statement) and the predictions that weren't used. by: id, or place of the question's entry in the
    question file, in file order (questions.places); of several entries of one question the first place wins.

    Refused: a place that no entry has; by id, a key that no question has, and keys that are just the places of a file
    whose ids are others, as those would pair statements with the wrong questions."""
    places = questions.select("question_id", F.explode("places").alias("key")) if "places" in questions.columns else None
    if by == "id":
        ids = questions.select(F.col("question_id").alias("key"))
        if places is not None:
            off = predictions.select("key").join(places.select("key"), "key", "full_outer")
            as_places = predictions.select("key").distinct().count() == places.count() and off.count() == places.count()
            if as_places and not ids.join(predictions.select("key"), "key", "left_anti").isEmpty():
                raise InputRefused("the predictions' keys are the places of the questions, not their ids")
        unknown = predictions.join(ids, "key", "left_anti").orderBy("key").limit(5).collect()
        if unknown:
            raise InputRefused(f"predictions for unknown questions: {[r['key'] for r in unknown]}")
        paired = questions.select("question_id").join(predictions, F.col("question_id") == F.col("key"))
        return paired.select("question_id", "statement"), predictions.limit(0)
    if places is None:
        raise InputRefused("questions by place need the places of their entries")
    beyond = predictions.join(places, "key", "left_anti").orderBy("key").limit(5).collect()
    if beyond:
        raise InputRefused(f"no entry of the question file has the places {[r['key'] for r in beyond]}")
    paired = predictions.join(places, "key")
    first = paired.groupBy("question_id").agg(F.min_by(F.struct("key", "statement"), "key").alias("x"))
    used = first.select("question_id", "x.key", "x.statement")
    return used.select("question_id", "statement"), predictions.join(used.select("key"), "key", "left_anti")
