"""Evidence records: what ran, on what, under which settings, and what came out; and their comparison."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import keys
from plumbline.operators import fixture, multiset, ordered
from plumbline.operators.order import with_pos
from plumbline.sources.scratch import write_text

REQUIRED = ("question_id", "statement", "rule", "ordering", "fixture", "engine", "settings", "serialization", "columns", "types", "rows", "truncated", "result_digest", "parameters")


class IncompleteEvidence(ValueError):
    pass


@dataclass(frozen=True)
class Record:
    """No field has a default, so that none can be forgotten. An ordered record has an ordering, a set record none."""

    question_id: int
    statement: str
    rule: str
    ordering: tuple
    fixture: dict
    engine: dict
    settings: dict
    serialization: dict
    columns: tuple
    types: tuple
    rows: int
    truncated: bool
    result_digest: str
    parameters: tuple

    def __post_init__(self):
        if self.rule not in ("ordered", "set"):
            raise IncompleteEvidence(f"no rule {self.rule}")
        if (self.rule == "ordered") != bool(self.ordering):
            raise IncompleteEvidence("an ordered record has an ordering, a set record has none")
        if self.statement.count("?") and not self.parameters and "'" not in self.statement and '"' not in self.statement:
            raise IncompleteEvidence("the statement's placeholders have no parameters")

    def document(self) -> dict:
        body = json.loads(json.dumps(asdict(self)))
        return body | {"record_digest": digest_of(body)}


def digest_of(document: object) -> str:
    return hashlib.sha256(json.dumps(document, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def load(document: dict) -> Record:
    """The record of a document, after its digest is recomputed."""
    body = {k: v for k, v in document.items() if k != "record_digest"}
    if set(body) != set(REQUIRED):
        raise IncompleteEvidence(f"fields {sorted(set(REQUIRED) ^ set(body))} are missing or unknown")
    if digest_of(body) != document.get("record_digest"):
        raise IncompleteEvidence("the record's digest doesn't match")
    return Record(**{k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in body.items()})


def build(question_id: int, statement, envelope, df: DataFrame, held: dict, sql: str | None = None) -> Record:
    """A record of a statement's result. An ordered result is hashed in order, a set by a checksum of its rows. sql: the
    text that ran, where it is another than the statement whose rule and ordering it is held to."""
    if statement.rule == "ordered":
        found = ordered.digest(with_pos(df), df.columns)
        rows = df.count()
    else:
        content = fixture.content_digest(df).first().asDict()
        rows, found = content["rows"], digest_of([df.columns, keys.declared_types(df), content])
    return Record(question_id, sql or statement.sql, statement.rule, tuple((k.expression, k.descending, k.nulls_first) for k in statement.ordering), held, envelope.identity(), envelope.settings(), {"scale": keys.SCALE, "null": "NULL", "time_zone": "UTC"}, tuple(df.columns), tuple(keys.declared_types(df)), rows, False, found, ())


def mismatches(a: Record, b: Record) -> list[str]:
    """Preconditions in which two records differ, so that their results can't be compared. A different engine is
    named alone, as nothing else could be equal then."""
    if a.engine != b.engine:
        return ["engine"]
    out = [] if fixture.same_fixture(a.fixture, b.fixture) else ["fixture"]
    out += [k for k in a.settings if a.settings[k] != b.settings.get(k)]
    out += [name for name in ("rule", "serialization") if getattr(a, name) != getattr(b, name)]
    return out + (["ordering"] if a.rule == "ordered" == b.rule and a.ordering != b.ordering else [])


def replay(record: Record, df: DataFrame) -> bool:
    """Whether a result that is computed anew has the record's digest."""
    if record.rule == "ordered":
        return ordered.digest(with_pos(df), df.columns) == record.result_digest
    return digest_of([df.columns, keys.declared_types(df), fixture.content_digest(df).first().asDict()]) == record.result_digest


def keep(record: Record, df: DataFrame, folder: str, name: str) -> None:
    """Writes a record and its rows, with their places, to a folder that driver and executors share: name.json and the
    Parquet folder name.rows, whose columns are c0 and so on, as names may repeat."""
    own = keys.by_place(df)
    rows = with_pos(df.toDF(*own.columns))
    kinds = {f.name: f.dataType for f in own.schema.fields}
    rows.select("_pos", *(F.col(c).cast("string").alias(c) if isinstance(t, T.NullType) else F.col(c) for c, t in kinds.items())).write.mode("overwrite").parquet(f"{folder}/{name}.rows")
    write_text(df.sparkSession, f"{folder}/{name}.json", json.dumps(record.document(), sort_keys=True, indent=1, ensure_ascii=False) + "\n")


def kept(spark: SparkSession, folder: str, name: str) -> tuple[Record, DataFrame]:
    """A record and its rows, in their order; both are refused if the rows don't have the record's digest."""
    record = load(json.loads(spark.read.text(f"{folder}/{name}.json", wholetext=True).first()["value"]))
    rows = spark.read.parquet(f"{folder}/{name}.rows").orderBy("_pos")
    void = keys.declared_type(T.NullType())
    cells = [F.lit(None).alias(f"c{i}") if t == void else F.col(f"c{i}") for i, t in enumerate(record.types)]
    df = rows.select(*cells).toDF(*record.columns)
    if not replay(record, df):
        raise IncompleteEvidence(f"the rows of {name} don't have the record's digest")
    return record, df


def names_note(gold: DataFrame, second: DataFrame) -> dict[str, list[str]]:
    """Both results' column names where they differ, else nothing."""
    return {} if gold.columns == second.columns else {"gold": gold.columns, "second": second.columns}


@dataclass
class Counterexample:
    """What a reader needs to see and repeat a disagreement. gold and second: each side's statement, rows, distinct
    rows and digest; differing: the most frequent rows of the difference; differing_totals: how many there are."""

    question_id: int
    verdict: str
    mechanism: str | None
    set_reading: int
    differing: list = field(default_factory=list)
    names: dict = field(default_factory=dict)
    test_suite: int | None = None
    rule: str | None = None
    ordering: list = field(default_factory=list)
    fixture: dict = field(default_factory=dict)
    first_difference: int | None = None
    differing_totals: dict = field(default_factory=dict)
    gold: dict = field(default_factory=dict)
    second: dict = field(default_factory=dict)

    @classmethod
    def of(cls, question_id: int, verdict: str, mechanism: str | None, set_reading: int, gold: DataFrame, second: DataFrame, records: tuple[Record, Record] | None = None, test_suite: int | None = None, first_difference: int | None = None) -> Counterexample:
        rows = [r.asDict() for r in multiset.bounded_difference(gold, second).collect()]
        totals = {f"{r['side']}_rows": r["n"] for r in multiset.difference(gold, second).groupBy("side").agg(F.sum("n").alias("n")).collect()}
        one = cls(question_id, verdict, mechanism, set_reading, rows, names_note(gold, second), test_suite, first_difference=first_difference, differing_totals={"gold_rows": 0, "second_rows": 0} | totals)
        if records:
            side = lambda r: {"statement": r.statement, "rows": r.rows, "result_digest": r.result_digest, "types": list(r.types)}
            one.rule, one.ordering, one.fixture = records[0].rule, [list(k) for k in records[0].ordering], records[0].fixture
            one.gold, one.second = side(records[0]), side(records[1])
        return one
