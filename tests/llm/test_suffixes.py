"""Suffix arrays, common prefixes and the removal of repeated strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import suffixes as X


def as_bytes(t):
    return np.frombuffer(t, np.uint8)


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abc\0", bytes(range(256))])
def test_suffixes_are_sorted_and_prefixes_counted(alphabet):
    r = random.Random(len(alphabet))
    for _ in range(80):
        t = bytes(r.choice(alphabet) for _ in range(r.randrange(1, 200)))
        t = (t * 5)[:300] if r.random() < 0.5 else t
        sa, cap = X.suffix_array(as_bytes(t)), r.choice([3, 8, 20, 64])
        assert list(sa) == sorted(range(len(t)), key=lambda i: t[i:])
        want = [0] + [next((k for k in range(cap) if t[a + k : a + k + 1] != t[b + k : b + k + 1] or a + k >= len(t)), cap) for a, b in zip(sa, sa[1:], strict=False)]
        assert list(X.common_prefixes(as_bytes(t), sa, cap, stretch=r.choice([1, 3, 128]))) == want


def removed(texts, length):
    """The bytes taken from each text, string by string."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((bytes(x for x, g in zip(t, gone, strict=True) if not g), bytes(gone)))
    return out


def expected(rows, length):
    out = []
    for (doc_id, text), (kept, gone) in zip(rows, removed([t for _, t in rows], length), strict=True):
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len((text or "").encode()), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "piece"), [(8, 5), (20, 7), (21, 1 << 17)])
def test_every_window_is_in_one_context_and_equal_windows_share_anchors(monkeypatch, length, piece):
    monkeypatch.setattr(X, "PIECE", piece)
    X._powers.cache_clear()
    r, s = random.Random(length), X.Settings(length=length, gram=8)
    texts = ["".join(r.choice("abé") for _ in range(r.randrange(60))) for _ in range(30)] * 2
    held = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, held)])
    anchors, seen, whole = {}, Counter(), {}
    for of, lo, sizes, anchor, context in X.contexts(as_bytes(b"".join(held)), offsets, s):
        for i, a, n, h, c in zip(of, lo, sizes, anchor, context, strict=True):
            assert whole.setdefault((h, c), held[i][a : a + n + length - 1]) == held[i][a : a + n + length - 1]
            for p in range(a, a + n):
                seen[i, p] += 1
                anchors.setdefault(held[i][p : p + length], set()).add(h)
    assert seen == Counter({(i, p): 1 for i, t in enumerate(held) for p in range(len(t) - length + 1)})
    assert all(len(v) == 1 for v in anchors.values())
    X._powers.cache_clear()


@pytest.mark.parametrize("shard_bytes", [1, 60, 300, 1 << 20])
def test_shards_of_an_anchor_are_merged(shard_bytes):
    r = random.Random(shard_bytes)
    for length in (8, 11, 20):
        pieces = []
        for anchor in range(3):
            base = bytes(r.choice(b"ab") + 3 * anchor for _ in range(40))
            for _ in range(8):
                x = bytearray(base[r.randrange(5) :][: r.randrange(length, 34)])
                if r.random() < 0.6:
                    x[r.randrange(len(x))] = 50 + anchor
                pieces.append((anchor, bytes(x)))
        offsets = np.cumsum([0, *(len(p) for _, p in pieces)])
        found = X.repeats(np.array([a for a, _ in pieces]), as_bytes(b"".join(p for _, p in pieces)), offsets, X.Settings(length=length, gram=8, shard_bytes=shard_bytes))
        seen = Counter(p[i : i + length] for _, p in pieces for i in range(len(p) - length + 1))
        want = {(k, i) for k, (_, p) in enumerate(pieces) for i in range(len(p) - length + 1) if seen[p[i : i + length]] > 1}
        assert {(k, i) for k, a, b in zip(*found, strict=True) for i in range(a, b + 1)} == want


def corpus(r):
    words = ["alpha", "béta", "γ", "dd", "e", "日本", "\x00", "longer"]
    passage = " ".join(r.choice(words) for _ in range(14))
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(12)))) for i in range(60)]
    rows += [(100 + i, f"own{i * 7919} {passage} end{i * 104729}") for i in range(25)]
    rows += [(200 + i, passage[: r.randrange(30, 60)] + str(i)) for i in range(12)]
    copy = "an exact copy, of which there are several rows"
    return [*rows, *[(300 + i // 2, copy) for i in range(8)], (None, copy), (None, None), (1, None), (2, ""), (400, "ab" * 200), (401, "z" * 45), (402, passage * 3), (403, "just short of one"), (404, " ".join(f"unlike{i * i}" for i in range(3000)) + passage)]


@pytest.mark.parametrize("settings", [X.Settings(20, 8, 400, 4096), X.Settings(20, 16, 1 << 18, 3), X.Settings(33, 32, 150, 2)])
def test_what_is_kept_is_that_of_brute_force(spark, settings):
    rows = corpus(random.Random(settings.length))
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, anchor string, k1 int").repartition(5)
    assert sorted(map(tuple, X.digest(docs, settings).collect()), key=repr) == expected(rows, settings.length)


def test_the_runs_taken_away_and_the_bytes_kept(spark):
    rows = [(1, "0123456789" * 3 + "tail"), (2, "head" + "abcdefghij" * 2 + "x"), (3, "y" + "abcdefghij" * 2)]
    out = {r["doc_id"]: r for r in X.remove(spark.createDataFrame(rows, "doc_id long, text string"), X.Settings(20, 8)).collect()}
    assert [(x["begin"], x["end"]) for x in out[2]["removed"]] == [(4, 24)] and bytes(out[2]["kept"]) == b"headx"
    assert [(x["begin"], x["end"]) for x in out[1]["removed"]] == [(0, 30)] and bytes(out[1]["kept"]) == b"tail"


def test_an_empty_table_and_settings_that_make_no_sense(spark):
    assert X.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    for length, gram in ((7, 8), (200, 24), (200, 4)):
        with pytest.raises(ValueError):
            X.Settings(length, gram)
