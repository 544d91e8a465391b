"""Fill-in-middle against units made one by one."""

import hashlib
import random
import re

import pytest

from plumbline.llm import fim

S = ("<P>", "<S>", "<M>")


def units(text):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", text)


def expected(doc_id, text):
    text = text or ""
    u = units(text)
    h = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in S) or h3 % 100 >= 90:
        return len(u), "plain", None, None, text
    if h4 % 100 < 20:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1 << 20])
def test_events_give_the_units_and_their_places(piece):
    r = random.Random(piece)
    for _ in range(400):
        text = "".join(r.choice(["a", "B", "z", " ", "é", "日", "<", "P", ">", "S", "<P>", "\n", "9", "\U0001f642", "ß", "\x00", "?"]) for _ in range(r.randrange(30)))
        u, found = units(text), fim.Units(text, S, piece)
        assert found.n == len(u) and found.marked == any(s in text for s in S)
        assert [found.place(k) for k in range(len(u) + 1)] == [len("".join(u[:k])) for k in range(len(u) + 1)]


def test_every_cut_is_rebuilt_also_beside_parts_of_sentinels():
    s = fim.Settings()
    for text in ("<", "a<P", "P><S", "<P <S <M", "><><P", "x<M<M"):
        for a in range(len(text) + 1):
            for b in range(a, len(text) + 1):
                for form in ("psm", "spm", "plain"):
                    assert fim.rebuild(fim.arrange(text, a, b, form, s), form, s) == text


@pytest.mark.parametrize("marks", [("<P>", "<S>", ">x"), ("aba", "<S>", "<M>"), ("", "<S>", "<M>"), ("<é>", "<S>", "<M>"), ("<?>", "<S>", "<M>"), ("x<S>", "<S>", "<M>")])
def test_sentinels_that_could_be_mistaken_are_refused(marks):
    with pytest.raises(ValueError):
        fim.Settings(*marks)


ROWS = [(None, "no id <S"), (1, None), (2, ""), (3, "<M> in it"), (4, "x"), (4, "another y 9"), (4, "x"), (5, "日本 é\U0001f642 ab"), (6, "word 12 " * 200_000), (7, "z" * 300_000), (8, "\n" * 70_000), *((i, f"text {i}, with some words") for i in range(10, 80))]


def test_transform_and_digest_are_those_of_brute_force(spark):
    docs = spark.createDataFrame([(*r, "keep", "old") for r in ROWS], "doc_id long, text string, h1 string, output string").repartition(3)
    made = fim.transform(docs)
    assert made.columns == ["doc_id", "h1", "n", "form", "prefix_chars", "middle_chars", "output"]
    key = lambda r: tuple(map(repr, r))
    want = sorted(((i, *expected(i, t)) for i, t in ROWS), key=key)
    got = fim.restore(fim.transform(docs, keep_text=True)).collect()
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=key) == want
    assert all(r["restored"] == (r["text"] or "") for r in got)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    hashed = sorted(((i, *expected(i, t)[:4], sha(expected(i, t)[4]), sha(t or "")) for i, t in ROWS), key=key)
    assert sorted(map(tuple, fim.digest(docs).collect()), key=key) == hashed
    assert {r[2] for r in hashed} == {"plain", "psm", "spm"}


def test_an_empty_table_and_null_outputs(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fim.digest(empty).collect() == []
    rows = spark.createDataFrame([(None, "psm"), ("x", None)], "output string, form string")
    assert [r["restored"] for r in fim.restore(rows).collect()] == [None, None]
