"""Filter interaction audit against each order applied to each row."""

import itertools
import random
import re

import numpy as np
import pytest

from plumbline.llm import interaction as I


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_single_swaps_visit_every_order_once(n):
    order, seen = list(range(n)), [tuple(range(n))]
    for t in I.transpositions(n):
        order[t], order[t + 1] = order[t + 1], order[t]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(itertools.permutations(range(n)))


def test_a_swap_sums_only_its_two_steps(monkeypatch):
    touched = []
    monkeypatch.setattr(I.Walk, "_step", lambda self, t, f=I.Walk._step: (touched.append(t), f(self, t)))
    I.orders(np.ones((3, 32), np.int64), "ABCDE")
    assert len(touched) == 5 + 2 * 119


def by_rows(rows, names):
    """rows (part, mask, good, toxic), filter by filter."""
    out = []
    for part in {r[0] for r in rows}:
        own, removed_of, lines = [r for r in rows if r[0] == part], dict.fromkeys(names, 0), []
        for order in itertools.permutations(names):
            left = own
            for step, f in enumerate(order, 1):
                bit = 1 << names.index(f)
                gone, kept = [r for r in left if r[1] & bit], [r for r in left if not r[1] & bit]
                failing = sum(1 for r in own if r[1] & bit)
                lines.append([part, "".join(order), step, len(kept), len(gone), failing - len(gone), sum(r[1] == bit for r in own), sum(bool(r[2]) for r in gone), sum(bool(r[3]) for r in gone)])
                removed_of[f] += len(gone)
                left = kept
        out += [(*x, removed_of[x[1][x[2] - 1]]) for x in lines]
    return sorted(out, key=repr)


@pytest.mark.parametrize("names", ["A", "XY", "ABCD"])
def test_counts_are_those_of_filtering_rows(spark, names):
    r = random.Random(len(names))
    rows = [(r.choice(["en", "", None, "de"]), r.randrange(1 << len(names)), r.choice([True, False, None]), r.random() < 0.2) for _ in range(300)]
    df = spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean")
    assert sorted(map(tuple, I.audit(df, names).collect()), key=repr) == by_rows(rows, names)


def test_names_are_few_and_different(spark):
    df = spark.createDataFrame([], "part string, mask int, good boolean, toxic boolean")
    assert I.audit(df, "AB").collect() == []
    for names in ("", "AA", "ABCDEFGHI"):
        with pytest.raises(ValueError):
            I.audit(df, names)


def masks(rows):
    out = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), any((b or "") == text and a is not None and (doc_id is None or a < doc_id) for a, b, _ in rows)]
        out.append((lang or "", sum(f << i for i, f in enumerate(fails))))
    return out


def test_the_five_filters_and_the_query_on_hard_rows(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, long, "en"), (2, long, "en"), (2, long, "de"), (None, long, None), (None, "only without ids", "en"), (None, "only without ids", "en"), (3, None, "en"), (4, "", "en"), (5, "a " * 400, "fr"), (6, long + " A", "en"), (7, long + " " + "B" * 40, ""), (8, long + " #", "en"), (9, " ".join(["x"] * 300), "en")]
    rows += [(10, "\t\n" + long + "\r", "en"), (11, "É" * 10, "fr"), (12, " ".join(["a", "b"] * 100), "en"), (13, " ".join(f"k{i}" for i in range(99)) + " k0" * 101, "en"), (14, " ".join(f"k{i}" for i in range(100)) + " k0" * 100, "en"), *((100 + i, "one text of many", "en") for i in range(40))]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, key string, mask int").repartition(3)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (8, None, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    good, toxic = {1, 2}, {2, 8}
    want = [(part, mask, doc_id in good, doc_id in toxic) for (doc_id, _, _), (part, mask) in zip(rows, masks(rows), strict=True)]
    held = I.flagged(docs, labels)
    assert sorted(map(tuple, held.collect())) == sorted(want)
    assert sorted(map(tuple, I.audit(held, I.NAMES).collect()), key=repr) == by_rows(want, I.NAMES)


def test_no_documents_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert I.audit(I.flagged(empty, none), I.NAMES).collect() == []
    one = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    assert I.audit(I.flagged(one, none), I.NAMES).count() == 600
