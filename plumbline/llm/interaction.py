"""Filter interaction audit: what each of a few filters removes, in every order that they could be applied in.

Every document gets a mask with a bit for each filter that it fails, so that a part of the corpus is at most 2**filters
cells of counts, however many documents it has. The orders are visited by adjacent transpositions: each differs from
the one before in two neighbouring steps, and only these are worked out anew from the cells. What a filter removes,
summed along the walk, is its Shapley value times the number of orders.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import materialise

#: Counts kept in a cell: documents, those labelled good, those labelled toxic.
COUNTS = ("n", "good", "toxic")
SPACE = r"[\x20\x09-\x0D]+"


def transpositions(n: int) -> Iterator[int]:
    """Places i at which swapping i and i + 1, one after the other, leads from one order of n things through all
    others: the largest thing sweeps through the order of the rest, which moves by one step at each end of a sweep."""
    if n < 2:
        return
    rest, down = transpositions(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        inner = next(rest, None)
        if inner is None:
            return
        # while the largest stands in front, the rest are one place further on
        yield inner + down
        down = not down


class Walk:
    """The orders of n filters over one part's cells, an array (counts, 2**n).

    lost[c, t] is what step t removes of count c; only the steps that a swap touches are summed anew."""

    def __init__(self, cells: np.ndarray, n: int):
        self.cells, self.masks = cells, np.arange(1 << n)
        self.order = list(range(n))
        self.failing = np.array([cells[0, self.masks >> f & 1 == 1].sum() for f in range(n)])
        self.alone = np.array([cells[0, 1 << f] for f in range(n)])
        self.lost = np.zeros((len(cells), n), np.int64)
        self.total = np.zeros(n, np.int64)
        for t in range(n):
            self._step(t)

    def _step(self, t: int) -> None:
        before, own = sum(1 << f for f in self.order[:t]), 1 << self.order[t]
        here = (self.masks & (before | own)) == own
        self.lost[:, t] = self.cells[:, here].sum(axis=1)

    def swap(self, t: int) -> None:
        self.order[t], self.order[t + 1] = self.order[t + 1], self.order[t]
        self._step(t)
        self._step(t + 1)

    def visit(self) -> tuple[tuple[int, ...], np.ndarray]:
        """The order as it stands and a copy of its steps' losses, which count towards the sums over orders."""
        self.total[self.order] += self.lost[0]
        return tuple(self.order), self.lost.copy()


def orders(cells: np.ndarray, names: Sequence[str]) -> dict[str, list]:
    """Columns of a row for each order and step of one part."""
    walk = Walk(cells, len(names))
    seen = [walk.visit()]
    for t in transpositions(len(names)):
        walk.swap(t)
        seen.append(walk.visit())
    everything = int(cells[0].sum())
    out: dict[str, list] = {k: [] for k in ("filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}
    for order, lost in seen:
        label, kept = "".join(names[f] for f in order), everything - np.cumsum(lost[0])
        for t, f in enumerate(order):
            for k, v in zip(out, (label, t + 1, kept[t], lost[0, t], walk.failing[f] - lost[0, t], walk.alone[f], lost[1, t], lost[2, t], walk.total[f]), strict=True):
                out[k].append(v if isinstance(v, str) else int(v))
    return out


def audit(flagged: DataFrame, names: Sequence[str]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for
    each part, order of all names and step, from rows (part, mask, good, toxic).

    mask has bit i where the row fails names[i]; good and toxic are booleans, null as false. A null part is its own. An
    empty table gives an empty result. n names make n! orders, so that they are 8 at most. Counts are summed before they
    are moved; a task holds one part's cells, 2**n at most, at a time.
    """
    if not 1 <= len(names) <= 8 or len({*names}) < len(names):
        raise ValueError("one to eight different names")
    cells = flagged.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))
    fields = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

    def enumerate_(batches):
        for batch in batches:
            for part, held in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                table = np.zeros((len(COUNTS), 1 << len(names)), np.int64)
                for c in held:
                    table[:, c["mask"]] = [c[k] for k in COUNTS]
                columns = orders(table, names)
                kinds = {"filter_order": pa.string(), "step": pa.int32()}
                rows = len(columns["step"])
                yield pa.RecordBatch.from_arrays([pa.array([part] * rows, pa.string()), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items())], ["part", *columns])

    return parts.mapInArrow(enumerate_, fields)


def text_failures(text: Column) -> list[Column]:
    """Whether a text has under 200 words; fewer than half of its words distinct; over 3 % of capitals A-Z; one of
    #$%&*|. Words are maximal runs without ASCII white space, and case counts."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 200, 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n.cast("long"), 100 * capitals.cast("long") > 3 * F.char_length(text).cast("long"), text.rlike(r"[#$%&*|]")]


#: The filters of flagged(), in the order of their bits.
NAMES = "ABCDE"


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of each row of docs, for audit(): A to D are text_failures(), E a text that a row with a
    smaller doc_id has too.

    A null text is the empty one; a null lang the part with the empty name. A null doc_id is larger than all others,
    and not smaller than itself; rows of one id and text aren't copies of each other. A document is good (toxic) if any
    of its labels has quality (toxic) 1; labels without id are nobody's. Other columns are ignored. Texts are read
    once and never moved: rows of id, part, checksum and mask are written to the shared folder, and equal texts meet
    by sha256.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_failures(F.col("text")))), F.lit(0))
    narrow = materialise(named.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"), bits.cast("int").alias("mask")), "masks")
    first = materialise(narrow.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("key", "first"), "first-of-text")
    known = materialise(labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")), "labels")
    copy = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    full = narrow.join(first, "key", "left").select("doc_id", "part", (F.col("mask") + F.when(copy, 1 << 4).otherwise(0)).alias("mask"))
    return full.join(known, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
