"""Why two results that aren't equal differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MECHANISMS = ("type", "order", "multiplicity", "truncation", "other")


def mechanism(same_types: Column, same_bag: Column, same_set: Column, prefix: Column, ordered: Column) -> Column:
    """The class of a disagreement, the first that holds: types differ; the rows are the same multiset (their order
    differs, if order counts); the same set; one side is the head of the other; other."""
    return (
        F.when(~same_types, "type")
        .when(same_bag, F.when(ordered, "order").otherwise("other"))
        .when(same_set, "multiplicity")
        .when(prefix, "truncation")
        .otherwise("other")
    )
