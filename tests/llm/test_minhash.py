import random
import re

import numpy as np
import pytest

from plumbline.llm import minhash as M
from plumbline.llm.components import connected_components


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute(rows, k, percent):
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, shingles(t, k)) for i, t in rows]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(a & b)
            if both and 100 * both >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i in up}


def corpus():
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 100
    for base in range(12):
        text = [r.choice(words) for _ in range(r.choice([6, 15, 60, 150]))]
        for _ in range(r.choice([1, 3, 20])):
            copy = list(text)
            for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
                copy[r.randrange(len(copy))] = r.choice(words)
            if r.random() < 0.3:
                text = copy  # chains: later copies are of a copy
            rows.append((n, " ".join(copy)))
            n += 1
        rows.append((n, " ".join(text[: len(text) // 2] + [r.choice(words) for _ in range(len(text))])))
        n += 1
    passage = " ".join(r.choice(words) for _ in range(60))
    for _ in range(60):  # a common passage and some words of each text's own: much alike, but not enough
        rows.append((n, passage + " " + " ".join(r.choice(words) for _ in range(r.choice([3, 8, 20])))))
        n += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_components_are_those_of_all_pairs(spark, k):
    rows = corpus()
    out = M.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), M.Settings(words=k, block=8)).collect()
    want = brute(rows, k, 80)
    assert {r["doc_id"]: r["component_id"] for r in out} == want
    assert {r["doc_id"]: r["n_shingles"] for r in out} == {i: len(shingles(t, k)) for i, t in rows}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_estimates_are_corrected_for_chance(bits):
    s = M.Settings(bits=bits, bands=256, rows=4)
    signer = M.Signer(s)
    r = np.random.default_rng(1)
    for share in (0.0, 0.5, 0.9):
        common = r.integers(0, 1 << 63, int(2000 * share), dtype=np.uint64)
        a, b = (np.unique(np.concatenate((common, r.integers(0, 1 << 63, 2000 - len(common), dtype=np.uint64)))) for _ in range(2))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = (M.unpack(np.frombuffer(signer.pack(signer.minima(v)), np.uint8).reshape(1, -1), bits) for v in (a, b))
        assert x.shape[1] == s.permutations
        assert abs(M.estimate(M.matches_with(x, y), s)[0] - true) < 0.08


def test_bands_find_pairs_at_the_threshold():
    s = M.Settings()
    assert (1 - 0.8**s.rows) ** s.bands < 1e-7
    signer, r, met = M.Signer(s), np.random.default_rng(2), 0
    for _ in range(50):
        common = r.integers(0, 1 << 63, 800, dtype=np.uint64)
        a, b = (np.concatenate((common, r.integers(0, 1 << 63, 100, dtype=np.uint64))) for _ in range(2))
        met += bool((signer.bands(signer.minima(a)) == signer.bands(signer.minima(b))).any())
    assert met == 50


def test_connected_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(300, 300), (None, 1)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(25)]
    out = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            for v in (a, b):
                up.setdefault(v, v)

            def root(v):
                while up[v] != v:
                    v = up[v]
                return v

            x, y = sorted((root(a), root(b)))
            up[y] = x
    assert out == {v: root(v) for v in up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_other_texts_of_a_repeated_id_are_linked_and_one_row_of_a_group_stays(spark):
    say = lambda *w: " ".join(w)
    a, b, c = ([f"{x}{i}" for i in range(40)] for x in "abc")
    rows = [(1, say(*a)), (5, say(*a)), (5, say(*b)), (7, say(*b, "more")), (8, say(*c)), (8, say(*c)), (None, say(*c)), (None, say("d", *a[::-1])), (None, say("d", *a[::-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    s = M.Settings(words=2)
    assert {r["component_id"] for r in M.components(docs, s).where("doc_id IN (1, 5, 7)").collect()} == {1}
    left = sorted(((r["doc_id"], r["text"]) for r in M.deduplicate(docs, s).collect()), key=str)
    assert left == sorted([rows[0], rows[2], rows[4], rows[7]], key=str)


def test_full_sets_are_made_only_of_what_the_packed_bits_leave(spark, monkeypatch):
    r = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base = [r.choice(words) for _ in range(300)]
    near, half = base[:290] + [r.choice(words) for _ in range(10)], base[:150] + [r.choice(words) for _ in range(150)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(half)), (4, " ".join(half)), (4, " ".join(near))]
    s = M.Settings(words=2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packs = {}
    for x in M.signatures(docs, s).collect():
        packs.setdefault(x["doc_id"], []).append(bytes(x["packed"]))
    assert M.may_reach(packs[1][0], packs[2][0], s) and not M.may_reach(packs[1][0], packs[3][0], s)
    assert M.may_reach(None, packs[1][0], s) and M.may_reach(packs[1][0], None, s)
    # an id of two texts has no signature of its own, and is held against full sets
    texts = spark.createDataFrame([(i, t, packs[i][0] if len(packs[i]) == 1 else None) for i, t in rows], "doc_id long, text string, packed binary")
    none = []
    asks = spark.createDataFrame([(9, 0, 1, 1, none, none), *((9, 1, i, i, [1], [1]) for i in (2, 3, 4))], M.ASKS)
    assert sorted((x["a"], x["b"]) for x in M.verified(asks, texts, s).collect()) == [(2, 1), (4, 1)]
    assert {x["doc_id"]: x["component_id"] for x in M.components(docs, s).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}


def test_estimates_lose_no_pair_at_the_threshold():
    """At similarity 0.8 the estimate of the packed bits lets a pair go in fewer than one of a million cases."""
    r, s = np.random.default_rng(5), M.Settings(words=2)
    signer, lost = M.Signer(s), 0
    for _ in range(300):
        both, own = r.integers(0, 1 << 62, 400, dtype=np.uint64), r.integers(0, 1 << 62, (2, 50), dtype=np.uint64)
        a, b = (signer.pack(signer.minima(np.concatenate((both, x)))) for x in own)
        lost += not M.may_reach(a, b, s)
    assert lost == 0
