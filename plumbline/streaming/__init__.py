"""Auditing a result that grows: each micro-batch of rows is added to both sides and compared anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from plumbline.operators import multiset


def compare_each_batch(gold: DataFrame, report: Callable[[int, DataFrame], None]):
    """A function for foreachBatch that compares a batch's rows with gold as multisets and hands on the one-row verdict."""

    def step(batch: DataFrame, number: int) -> None:
        report(number, multiset.verdict(gold, batch))

    return step
