"""python -m plumbline: audit a question file, show a run's findings, compare two kept records, or run the demo."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from plumbline.operators import fixture
from plumbline.plans import audit as A
from plumbline.plans import record as R
from plumbline.plans.session import Envelope
from plumbline.sources import demo, questions, tables

#: Exit status of a run that couldn't begin.
REFUSED = 2


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plumbline", description="Audits statements by their results.")
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("audit", help="run a question file's statements, with predicted ones if given")
    run.add_argument("--questions", required=True, help="JSON file of questions")
    run.add_argument("--tables", required=True, help="folder of Parquet tables")
    given = run.add_mutually_exclusive_group()
    given.add_argument("--predictions", help="JSON object of statements by id or place")
    given.add_argument("--prediction-lines", help="file with a statement in each line, by place")
    run.add_argument("--by", choices=("id", "place"), help="what the keys of --predictions are (id unless given)")
    run.add_argument("--ids", type=int, nargs="+", help="only these questions")
    demonstration = commands.add_parser("demo", help="audit the statements of a small fixture")
    for c in (run, demonstration):
        c.add_argument("--out", required=True, help="folder for the run's documents, shared by driver and executors")
        c.add_argument("--seed", default="1", help="of the shuffled copies")
        c.add_argument("--timeout", type=float, default=30, help="seconds for each statement, comparison and probe; 0: none")
        c.add_argument("--row-budget", type=int, default=200_000, help="most rows of a result")
        c.add_argument("--direction", action="store_true", help="probe sort directions against the questions' words")
        c.add_argument("--plan-variant", action="store_true", help="probe statements under another physical plan too")
        c.add_argument("--keep-rows", action="store_true", help="keep result rows beside the records")
        c.add_argument("--cache", help="file that keeps the tables' measurements from run to run")
        c.add_argument("--fail-on-probe", action="store_true", help="exit status 1 if a probe fires")
    shown = commands.add_parser("report", help="print the findings of a run's folder")
    shown.add_argument("--out", required=True)
    pair = commands.add_parser("compare", help="compare two kept records, without running their statements")
    pair.add_argument("first", help="record, such as out/q1/gold.json")
    pair.add_argument("second")
    return top


def line(one: dict) -> str:
    """A question's line of output."""
    said = [f"q{one['question_id']}", one["verdict"], one["mechanism"], one["error"], "set reading credits it" if one["verdict"] == "NOT_EQUAL" and one["set_reading"] == 1 else None, ", ".join(one["probes"] or [])]
    return " | ".join(x for x in said if x)


def predictions_of(spark: SparkSession, asked: DataFrame, args: argparse.Namespace, file: DataFrame) -> DataFrame | None:
    """(question_id, statement) of the file that is named. file: the questions of the whole file, by whose ids and
    places statements are paired before some of them are chosen."""
    if args.predictions:
        read, by = questions.read_predictions(spark, args.predictions), args.by or "id"
    elif args.prediction_lines:
        if args.by == "id":
            raise questions.InputRefused("lines have places, not ids")
        read, by = questions.read_prediction_lines(spark, args.prediction_lines), "place"
    elif args.by:
        raise questions.InputRefused("--by needs predictions")
    else:
        return None
    used, left = questions.resolve(file, read, by=by)
    if n := left.count():
        print(f"{n} predictions aren't used", file=sys.stderr)
    return used.join(asked.select("question_id"), "question_id", "left_semi")


def finish(spark: SparkSession, asked: DataFrame, held: dict[str, DataFrame], given: DataFrame | None, args: argparse.Namespace, inputs: dict[str, str]) -> int:
    engine, measured = Envelope.open(spark).identity(), fixture.measure(held, cache=fixture.Cache(args.cache) if args.cache else None)
    judged = A.audit(spark, asked, held, given, seed=args.seed, timeout=args.timeout or None, row_budget=args.row_budget, direction=args.direction, plan_variant=args.plan_variant, keep_rows=args.keep_rows, out=args.out, measured=measured)
    rows = [json.loads(r) for r in judged.toJSON().collect()]  # a row a question
    rows = [{f: r.get(f) for f in judged.columns} for r in rows]
    told = A.summary(judged, args.fail_on_probe, engine, measured) | {"inputs": inputs, "seed": args.seed, "timeout": args.timeout, "row_budget": args.row_budget}
    questions.write_json(str(Path(args.out) / "questions.json"), rows)
    questions.write_json(str(Path(args.out) / "summary.json"), told)
    report(args.out)
    return told["exit_status"]


def report(out: str) -> int:
    """Prints what a run's folder holds; the run's exit status."""
    rows, told = (json.loads((Path(out) / f).read_text(encoding="utf-8")) for f in ("questions.json", "summary.json"))
    for one in sorted(rows, key=lambda r: r["question_id"]):
        print(line(one))
    for name in ("verdicts", "probes", "credited_but_not_equal"):
        print(f"{name}: " + ", ".join(f"{k} {v}" for k, v in sorted(told[name].items()) if v))
    print(f"{told['questions']} questions in {told['seconds'] or 0:.1f} s")
    return told["exit_status"]


def compare(spark: SparkSession, first: str, second: str) -> int:
    """Compares two kept records; 0 where they are equal, 1 where they aren't, 2 where they can't be compared."""
    (a, gold), (b, other) = (R.kept(spark, str(Path(f).parent), Path(f).stem) for f in (first, second))
    row = A.compare_records(a, gold, b, other).first()
    print("EQUAL" if row["equal"] else f"NOT_EQUAL | {row['mechanism']}")
    return int(not row["equal"])


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "report":
            return report(args.out)
        spark = spark or SparkSession.builder.appName("plumbline").getOrCreate()
        if args.command == "compare":
            return compare(spark, args.first, args.second)
        if args.command == "demo":
            asked = spark.createDataFrame([(q["question_id"], q["db_id"], q["question"], q["SQL"]) for q in demo.QUESTIONS], "question_id long, db_id string, question string, SQL string")
            given = spark.createDataFrame([(q["question_id"], demo.PREDICTIONS.get(q["question_id"], q["SQL"])) for q in demo.QUESTIONS], "question_id long, statement string")
            return finish(spark, asked, demo.tables(spark), given, args, {})
        file = questions.read_questions(spark, args.questions)
        asked = questions.read_questions(spark, args.questions, args.ids) if args.ids else file
        given = predictions_of(spark, asked, args, file)
        inputs = {f: questions.file_digest(f) for f in (args.questions, args.predictions, args.prediction_lines) if f}
        return finish(spark, asked, tables.folder_tables(spark, args.tables), given, args, inputs)
    except (questions.InputRefused, R.IncompleteEvidence, A.NotComparable, AnalysisException, OSError) as e:
        print(f"plumbline: {str(e).splitlines()[0]}", file=sys.stderr)
        return REFUSED


if __name__ == "__main__":
    sys.exit(main())
