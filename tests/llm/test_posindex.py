import hashlib
import random
import re

import pytest

from plumbline.llm import kernel as K
from plumbline.llm import posindex as P


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    phrases = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            phrases.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if s := phrases.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= s
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def data():
    r = random.Random(9)
    say = lambda n: " ".join(r.choice(["Alpha", "beta", "gamma", "the", "of", "delta-x", "9", "é"]) for _ in range(n))
    items = [(i, say(r.choice([1, 3, 5, 12, 25]) + 2)) for i in range(12)] + [(50, items_text := "alpha beta"), (51, items_text)]
    docs = []
    for d in range(80):
        text = say(r.randrange(0, 60))
        if d % 3 == 0:
            text += ". " + r.choice(items)[1].upper() + "! " + say(5)
        docs.append((d, text))
    return docs, items


@pytest.mark.parametrize("settings", [P.Settings(window=4), P.Settings(window=10, block_terms=20, segment_bytes=200), P.Settings(window=3, segment_bytes=1)])
def test_hits_are_those_of_a_plain_scan(spark, settings):
    docs, items = data()
    out = P.digest(P.hits(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), settings)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in out} == brute(docs, items, settings.window)
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in out)


def test_proximity_finds_all_terms_within_a_span(spark):
    docs = [(0, "a x b x c"), (1, "c b a"), (2, "a x x x x x b c"), (3, "a b"), (4, "c x a x b x c")]
    (phrase,) = (K.word_hashes(*_raw("a b c"), K.ALNUM)[0],)
    phrases = P.phrases_of([("q", phrase)], 3)
    keyed = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(docs)], "row long, doc_id long, text string")
    segments = P.build(keyed, phrases.vocabulary, P.Settings()).collect()
    near = set()
    for row in segments:
        g = P.Segment(row.asDict(), phrases.vocabulary)
        near |= {int(g.ids[d]) for d in g.document(g.near(__import__("numpy").arange(3), 5))}
    assert near == {0, 1, 4}


def _raw(text):
    import numpy as np

    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def test_documents_with_a_phrase_go(spark):
    docs, items = data()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r["doc_id"] for r in P.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), P.Settings(window=4)).collect()}
    assert kept == {d for d, x in brute(docs, items, 4).items() if not x[1]}


def brute_near(docs, items, window, reach):
    out = {}
    for d, t in docs:
        w, near, found = words(t), set(), set()
        for i, text in items:
            of = words(text)
            n = min(window, len(of))
            for k in range(len(of) - n + 1 if n else 0):
                want = set(of[k : k + n])
                for a in range(len(w)):
                    if w[a] not in want:
                        continue
                    b = next((b for b in range(a, min(len(w), a + reach * n)) if want <= set(w[a : b + 1])), None)
                    if b is not None:
                        near.update(range(a, b + 1))
                        found.add(str(i))
        out[d] = (len(near), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


@pytest.mark.parametrize("settings", [P.Settings(window=4), P.Settings(window=10, block_terms=20, segment_bytes=200), P.Settings(window=3, segment_bytes=1, reach=600)])
def test_hits_hold_proximity_matches_apart_from_exact_ones(spark, settings):
    docs, items = data()
    docs += [(100, "one two x three four"), (101, "four three two one"), (102, "one two " + "x " * 9 + "three four"), (103, "one two"), (104, "three four")]
    items.append((60, "one two three four"))
    held = P.hits(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), settings, proximity=True)
    out = {r["doc_id"]: r for r in P.digest(held).collect()}
    assert {d: (r["n_near"], r["n_near_items"], r["near_items_sha256"]) for d, r in out.items()} == brute_near(docs, items, settings.window, settings.reach)
    assert {d: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for d, r in out.items()} == brute(docs, items, settings.window)
    assert all(r["n_near"] >= r["n_hit"] and r["contaminated"] == (r["n_hit"] > 0) for r in out.values())
    if settings.window == 4:
        assert [out[d]["n_near"] for d in range(100, 105)] == [5, 4, 0, 0, 0] and not out[100]["contaminated"]


def test_items_without_id_are_searched_and_left_out_of_the_list_of_ids(spark):
    docs = spark.createDataFrame([(1, "see one two three there"), (2, "one two and four five"), (3, "none of it")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two three"), (None, "one two"), (9, "four five")], "item_id long, text string")
    out = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in P.digest(P.hits(docs, items)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert out == {1: (3, 1, sha(""), True), 2: (4, 2, sha("9"), True), 3: (0, 0, sha(""), False)}
    assert [r["doc_id"] for r in P.decontaminate(docs, items).collect()] == [3]


def test_slices_of_candidates_change_nothing_and_bound_memory(spark, monkeypatch):
    import tracemalloc

    import numpy as np

    r = np.random.default_rng(4)
    text = " ".join(f"w{i}" for i in r.integers(0, 300, 200_000))
    keyed = spark.createDataFrame([(0, 7, text[:400_000]), (1, 8, text[400_000:])], "row long, doc_id long, text string")
    own = K.word_hashes(*_raw(text), K.ALNUM)[0]
    wanted = P.phrases_of([("q", own[i : i + 10]) for i in range(0, 190_000, 10)] + [("z", r.permutation(own)[:10]) for _ in range(1000)], 10)
    row = P.build(keyed.coalesce(1), None, P.Settings()).first().asDict()
    g = P.Segment(row, wanted.vocabulary)
    terms = np.searchsorted(wanted.vocabulary, wanted.terms)
    tracemalloc.start()
    which, start = g.phrases(terms, wanted.lengths)
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()
    assert len(which) >= 18_900
    few = (terms[:200], wanted.lengths[:200])
    whole, near = g.phrases(*few), g.stretches(*few, 2 * few[1])
    monkeypatch.setattr(P, "CANDIDATES", 1000)
    assert all((a == b).all() for a, b in zip(g.phrases(*few), whole, strict=True))
    assert sorted(zip(*(x.tolist() for x in g.stretches(*few, 2 * few[1])), strict=True)) == sorted(zip(*(x.tolist() for x in near), strict=True))


def test_an_index_of_all_terms_serves_any_test_set(spark):
    docs, items = data()
    keyed = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(docs)], "row long, doc_id long, text string").repartition(2)
    index = P.build(keyed, None, P.Settings(segment_bytes=500)).cache()
    for own in (items[:5], items[5:], []):
        phrases = P.phrases_of([(str(i), K.word_hashes(*_raw(t), K.ALNUM)[0]) for i, t in own], 4)
        out = {r["doc_id"]: (len(r["items"]), r["n_words"]) for r in P.search(index, phrases).collect()}
        assert out == {d: (x[2], x[0]) for d, x in brute(docs, own, 4).items()}


def test_texts_are_read_once_however_many_blocks_there_are(spark, monkeypatch):
    docs, items = data()
    built, build = [], P.build
    monkeypatch.setattr(P, "build", lambda docs, vocabulary, s: (built.append(vocabulary is None), build(docs, vocabulary, s))[1])
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    P.hits(a, b, P.Settings(block_terms=20)).count()
    assert built == [True]
    P.hits(a, b).count()
    assert built == [True, False]
