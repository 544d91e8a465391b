"""A run: questions, their gold statements and, if given, predicted ones, through comparison and probes."""

from __future__ import annotations

import time
from contextlib import ExitStack, contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import fixture, multiset, ordered, probes, readings, runs, shuffle
from plumbline.operators.mechanism import mechanism
from plumbline.operators.order import with_pos
from plumbline.plans.record import Counterexample, Record, build, keep, mismatches
from plumbline.plans.session import Envelope, SideFailed, StatementTimedOut, sided
from plumbline.plans.statement import parse
from plumbline.sources import questions as Q
from plumbline.sources.scratch import unsettle


def compare(gold: DataFrame, second: DataFrame, rule: str) -> DataFrame:
    """One row: equal, set_reading, mechanism (null if equal), rows and distinct rows of each side. For the ordered
    rule both sides are given in order; under the set rule places mean nothing, and a head is a multiset of fewer rows
    within the other's.

    Both sides are read by the same aggregations, which Spark shares; each statement runs once for the multisets and the
    set reading, and once more for places if the rule asks for them."""
    both = multiset.verdict(gold, second)
    reading = readings.set_reading(gold, second).select(F.col("agrees").alias("set_reading"))
    one = both.crossJoin(reading)  # one row each
    if rule == "ordered":
        placed = ordered.verdict(with_pos(gold), with_pos(second)).select(F.col("equal").alias("in_order"), "prefix", "first_difference")
        one, equal = one.crossJoin(placed), F.col("in_order")
    else:
        shorter = F.least("gold_rows", "second_rows")
        within = F.when(F.col("gold_rows") < F.col("second_rows"), F.col("gold_only_rows")).otherwise(F.col("second_only_rows")) == 0
        one = one.withColumn("prefix", F.col("same_types") & (shorter > 0) & (F.col("gold_rows") != F.col("second_rows")) & within).withColumn("first_difference", F.lit(None).cast("long"))
        equal = F.col("equal")
    why = mechanism(F.col("same_types"), F.col("same_bag"), F.col("same_set"), F.col("prefix"), F.lit(rule == "ordered"))
    return one.select(equal.alias("equal"), "set_reading", F.when(~equal, why).alias("mechanism"), "gold_rows", "second_rows", "gold_distinct", "second_distinct", "shared_distinct", "first_difference")


class NotComparable(ValueError):
    """Two records differ in something that their results depend on."""


def compare_records(a: Record, gold: DataFrame, b: Record, second: DataFrame) -> DataFrame:
    """The comparison of two records' rows under the first one's rule; refused where their preconditions differ."""
    if named := mismatches(a, b):
        raise NotComparable(f"the records differ in {', '.join(named)}")
    return compare(gold, second, a.rule)


@dataclass
class Judged:
    question_id: int
    verdict: str
    mechanism: str | None = None
    set_reading: int | None = None
    test_suite: int | None = None
    probes: list[str] = field(default_factory=list)
    applicable: list[str] = field(default_factory=list)
    failed: list[str] = field(default_factory=list)
    error: str | None = None
    error_side: str | None = None
    timed_out_side: str | None = None
    seconds: float = 0.0
    phases: dict[str, float] = field(default_factory=dict)


@contextmanager
def spent(phases: dict[str, float], phase: str):
    """Adds the seconds that the block takes to a phase, also where it fails."""
    began = time.monotonic()
    try:
        yield
    finally:
        phases[phase] = phases.get(phase, 0.0) + time.monotonic() - began


JUDGED = "question_id long, verdict string, mechanism string, set_reading int, test_suite int, probes array<string>, applicable array<string>, failed array<string>, error string, error_side string, timed_out_side string, seconds double, phases map<string,double>"


def _one(envelope: Envelope, q, second_sql: str | None, copies, held: dict, direction: bool, out: str | None, phases: dict[str, float], variant: Envelope | None = None, keep_rows: bool = False) -> Judged:
    with ExitStack() as done:
        return _judge(done, envelope, q, second_sql, copies, held, direction, out, phases, variant, keep_rows)


def _judge(done: ExitStack, envelope: Envelope, q, second_sql, copies, held, direction, out, phases, variant, keep_rows) -> Judged:
    with sided("gold"), spent(phases, "gold"):
        gold_statement = parse(envelope.spark, q["SQL"])
        gold = envelope.result(gold_statement)
        done.callback(unsettle, gold)
        record = envelope.timed(lambda: build(q["question_id"], gold_statement, envelope, gold, held))
    judged = Judged(q["question_id"], "GOLD-ONLY")
    documents, kept = {"gold.json": record.document()}, [("gold", record, gold)]
    if second_sql is not None:
        with sided("second"), spent(phases, "second"):
            statement = parse(envelope.spark, second_sql)
            second = envelope.result(statement)
            done.callback(unsettle, second)
        with sided("run"), spent(phases, "comparison"):
            other = envelope.timed(lambda: build(q["question_id"], gold_statement, envelope, second, held, statement.sql))
            documents["second.json"] = other.document()
            kept.append(("second", other, second))
            try:
                row = envelope.timed(lambda: compare_records(record, gold, other, second).first())
            except NotComparable:
                judged.verdict = "NOT_COMPARABLE"
            else:
                judged.verdict, judged.mechanism, judged.set_reading = ("EQUAL" if row["equal"] else "NOT_EQUAL"), row["mechanism"], row["set_reading"]
                judged.test_suite = envelope.timed(lambda: readings.test_suite_reading(gold, second, gold_statement.sql))
                if not row["equal"]:
                    found = envelope.timed(lambda: Counterexample.of(q["question_id"], judged.verdict, judged.mechanism, judged.set_reading, gold, second, (record, other), judged.test_suite, row["first_difference"]))
                    documents["counterexample.json"] = asdict(found)
    with sided("gold"), spent(phases, "probes"):
        smells = probes.all_smells(envelope, gold_statement, copies, q["question"] or "", direction, variant, gold, q.get("evidence") or "")
    judged.probes = [s.name for s in smells if s.fired]
    judged.applicable = [s.name for s in smells if s.applicable]
    judged.failed = [s.name for s in smells if s.error]
    documents["smells.json"] = [s.document() for s in smells]
    if out and (judged.verdict == "NOT_EQUAL" or judged.probes):
        at = Q.write_question(out, q["question_id"], documents)
        for name, one, df in kept if keep_rows else ():
            keep(one, df, at, name)
    return judged


def audit(spark: SparkSession, questions: DataFrame, tables: dict[str, DataFrame], predictions: DataFrame | None = None, *, seed: str = "1", timeout: float | None = 30, row_budget: int | None = 200_000, direction: bool = False, plan_variant: bool = False, keep_rows: bool = False, out: str | None = None, measured: dict | None = None) -> DataFrame:
    """A row for each question (see JUDGED). Questions are statements and few; each runs as Spark jobs. A question
    that fails is an ERROR row that names the side, and the run goes on.

    timeout: seconds that each statement, the comparison, each reading and each probe may take. plan_variant: probe
    statements under another physical plan too. out: a folder for the documents of questions that disagree or that a
    probe fired on; keep_rows: with the rows of their results, for which driver and executors must share the folder.
    measured: what fixture.measure() says of the tables, if it is at hand."""
    envelope = Envelope.open(spark, tables, timeout=timeout, row_budget=row_budget)
    variant = Envelope.open(spark, tables, variant=True, timeout=timeout, row_budget=row_budget) if plan_variant else None
    if out:
        Q.clear_output(out)
    asked = [r.asDict() for r in questions.orderBy("question_id").toLocalIterator()]
    given = {r["question_id"]: r["statement"] for r in predictions.toLocalIterator()} if predictions is not None else None
    held = measured or fixture.measure(tables)
    copies = shuffle.prepare(envelope.spark, tuple(sorted(tables)), seed)
    judged = []
    try:
        for q in asked:
            began, phases = time.monotonic(), {}
            try:
                if given is not None and given.get(q["question_id"]) is None:
                    raise SideFailed("second", ValueError("no statement"))
                one = _one(envelope, q, given[q["question_id"]] if given is not None else None, copies, held, direction, out, phases, variant, keep_rows)
            except SideFailed as e:
                one = Judged(q["question_id"], "ERROR", error=str(e)[:500], error_side=e.side, timed_out_side=e.side if isinstance(e.cause, StatementTimedOut) else None)
            one.seconds, one.phases = time.monotonic() - began, phases
            judged.append(one)
    finally:
        copies.drop()
    return spark.createDataFrame([tuple(asdict(j).values()) for j in judged], JUDGED)


_ASKED = {"applicable": "applicable", "fired": "probes", "failed": "failed"}


def summary(judged: DataFrame, fail_on_smell: bool = False, engine: dict | None = None, measured: dict | None = None) -> dict:
    """A run's summary document. engine and measured: what the run's records say of the engine and of the tables."""
    count = lambda df, key: {r[key]: r["n"] for r in df.collect()}
    verdicts = count(runs.verdict_counts(judged), "verdict")
    fired = count(runs.probe_counts(judged, probes.NAMES), "probe")
    asked = judged.agg(*(F.count_if(F.array_contains(column, name)).alias(f"{kind} {name}") for name in probes.NAMES for kind, column in _ASKED.items())).first()
    total, split = sum(verdicts.values()), runs.credited_split(judged).collect()
    return {
        "questions": total,
        "verdicts": verdicts,
        "probes": fired,
        "probes_by_applicability": {name: {kind: asked[f"{kind} {name}"] for kind in _ASKED} for name in probes.NAMES},
        "engine": engine,
        "fixture": measured,
        "credited_but_not_equal": count(runs.credited_by_mechanism(judged), "mechanism"),
        "credited_by_test_suite": {m: {name: sum(r["n"] for r in split if r["mechanism"] == m and r["test_suite"] == v) for name, v in (("also", 1), ("not", 0), ("unknown", None))} for m in sorted({r["mechanism"] for r in split})},
        "timed_out": {r["side"]: r["question_ids"] for r in runs.errors_by_side(judged).collect()},
        "phases": {r["key"]: r["value"] for r in judged.select(F.explode("phases")).groupBy("key").agg(F.sum("value").alias("value")).collect()},
        "seconds": judged.agg(F.sum("seconds")).first()[0],
        "exit_status": runs.exit_status(total, verdicts["ERROR"], verdicts["NOT_EQUAL"], sum(fired.values()), fail_on_smell),
    }
