"""A session in which statements are run for comparison: pinned settings, one SELECT, a time and a row budget."""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans.statement import Statement, parse
from plumbline.sources.scratch import settled, unsettle

#: Settings on which a result may depend; two records compare only if these agree.
PINNED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.caseSensitive": "false",
    "spark.sql.ansi.doubleQuotedIdentifiers": "false",
    "spark.sql.legacy.timeParserPolicy": "CORRECTED",
    "spark.sql.mapKeyDedupPolicy": "EXCEPTION",
    "spark.sql.storeAssignmentPolicy": "ANSI",
}
#: A plan that joins and aggregates otherwise; the same answer is expected of it.
VARIANT = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.join.preferSortMergeJoin": "false", "spark.sql.shuffle.partitions": "7"}


class SessionDrifted(RuntimeError):
    """A pinned setting no longer has its value."""


class StatementTimedOut(RuntimeError):
    pass


class RowBudgetExceeded(RuntimeError):
    """A result has more rows than allowed; it is refused, never cut."""


class SideFailed(RuntimeError):
    """An error, and whose it is: gold, second or run."""

    def __init__(self, side: str, cause: BaseException):
        super().__init__(f"{side}: {cause}")
        self.side, self.cause = side, cause


@contextmanager
def sided(side: str):
    """Names the side of errors raised within; the innermost name stays."""
    try:
        yield
    except SideFailed:
        raise
    except Exception as e:
        raise SideFailed(side, e) from e


def view(spark: SparkSession, df: DataFrame, name: str) -> None:
    """A temporary view of df, which may be of another session of the same application, in this one."""
    plan = df._jdf.queryExecution().analyzed()
    DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark).createOrReplaceTempView(name)


@dataclass
class Envelope:
    spark: SparkSession
    timeout: float | None = None
    row_budget: int | None = 200_000

    @classmethod
    def open(cls, spark: SparkSession, tables: dict[str, DataFrame] | None = None, variant: bool = False, **kwargs) -> Envelope:
        """A session of its own, whose settings and temporary views no other session sees."""
        own = spark.newSession()
        for k, v in (PINNED | (VARIANT if variant else {})).items():
            own.conf.set(k, v)
        for name, df in (tables or {}).items():
            view(own, df, name)
        return cls(own, **kwargs)

    def settings(self) -> dict[str, str]:
        return {k: self.spark.conf.get(k) for k in PINNED}

    def check(self) -> None:
        if drift := {k: v for k, v in self.settings().items() if v != PINNED[k]}:
            raise SessionDrifted(f"settings changed: {drift}")

    def identity(self) -> dict[str, str]:
        return {"engine": "spark", "version": self.spark.version, "user": self.spark.sql("SELECT current_user() AS u").first()["u"]}

    def frame(self, sql: str | Statement) -> DataFrame:
        """The result of one SELECT as a DataFrame; anything else is refused."""
        self.check()
        return self.spark.sql(sql.sql if isinstance(sql, Statement) else parse(self.spark, sql).sql)

    def result(self, sql: str | Statement) -> DataFrame:
        """A statement's result: run once, within the timeout, and held, with no more rows than allowed. One row more
        than that is read at most."""
        df = self.frame(sql)
        held = self.timed(lambda: settled(df if self.row_budget is None else df.limit(self.row_budget + 1)))
        if self.row_budget is not None and held.count() > self.row_budget:
            unsettle(held)
            raise RowBudgetExceeded(f"more than {self.row_budget} rows")
        return held

    def timed(self, action):
        """action(), whose jobs are cancelled once the timeout is over, those that it starts afterwards too."""
        if self.timeout is None:
            return action()
        context, tag = self.spark.sparkContext, f"plumbline-{uuid.uuid4().hex}"
        fired, done = threading.Event(), threading.Event()

        def watch():
            if not done.wait(self.timeout):
                fired.set()
                context.cancelJobsWithTag(tag)
                while not done.wait(0.1):
                    context.cancelJobsWithTag(tag)

        watcher = threading.Thread(target=watch, daemon=True)
        context.addJobTag(tag)
        watcher.start()
        try:
            found = action()
        except Exception as e:
            if fired.is_set():
                raise StatementTimedOut(f"stopped after {self.timeout} s") from e
            raise
        finally:
            done.set()
            watcher.join()
            context.removeJobTag(tag)
        if fired.is_set():
            raise StatementTimedOut(f"took more than {self.timeout} s")
        return found
