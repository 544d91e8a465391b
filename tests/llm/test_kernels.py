import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import kernel as K
from plumbline.llm.pieces import PieceCache

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab AZ9é\t\n-_\x00日😀", max_size=30)), max_size=8)
PATTERNS = {"space": (K.BY_SPACE, r"[^\x20\x09-\x0D]+"), "alnum": (K.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@given(TEXTS, st.integers(1, 40))
@settings(deadline=None, max_examples=150)
def test_words_are_those_of_the_pattern(texts, limit):
    for classes, pattern in PATTERNS.values():
        seen = {}
        for first, end, data, offsets in K.chunks(pa.array(texts, pa.string()), limit):
            hashes, at = K.word_hashes(data, offsets, classes, segment=7)
            for i in range(end - first):
                words = re.findall(pattern, low(texts[first + i]))
                own = hashes[at[i] : at[i + 1]]
                assert len(own) == len(words)
                for w, h in zip(words, own.tolist(), strict=True):
                    assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_chunks_cover_all_rows_of_a_slice():
    column = pa.array(["a", None, "bcd", "", "e" * 50, "f"]).slice(1, 4)
    rows = [(a, b, bytes(t), o.tolist()) for a, b, t, o in K.chunks(column, 3)]
    assert [r[0] for r in rows][0] == 0 and rows[-1][1] == 4
    assert b"".join(r[2] for r in rows) == b"bcd" + b"e" * 50


def test_shingles():
    h, _ = K.word_hashes(np.frombuffer(b"a b a b c", np.uint8), np.array([0, 9]), K.BY_SPACE)
    assert len(K.shingle_set(h, 2)) == 3  # a-b, b-a, b-c
    assert len(K.shingle_set(h, 9)) == 1 and len(K.shingle_set(h[:0], 2)) == 0
    assert K.shingle_set(h[:1], 2)[0] != K.shingle_set(h[:2], 2)[0]


def test_grams_lie_inside_words():
    text = np.frombuffer("abcde xy abcdef".encode(), np.uint8)
    starts, ends = K.word_bounds(text, np.array([0, len(text)]), K.ALNUM[text])
    grams, at = K.gram_hashes(text, starts, ends, 5)
    assert at.tolist() == [0, 9, 10] and grams[0] == grams[1] != grams[2]


def test_the_piece_cache_gives_the_same_after_it_is_cleared():
    calls = []

    def encode(pieces):
        calls.append(len(pieces))
        return [[[len(p), 7] for p in pieces]]

    cache = PieceCache(encode, limit=2)
    for _ in range(3):
        counts, of, (ids,) = cache.look_up(["a", "bb", "a", "ccc"])
        assert counts.tolist() == [2] * 4 and ids.tolist() == [1, 7, 2, 7, 1, 7, 3, 7] and of.tolist() == [0, 0, 1, 1, 2, 2, 3, 3]
    assert calls == [3, 3, 3]
    assert cache.look_up([])[0].tolist() == []


def test_words_that_collide_under_a_polynomial_have_hashes_of_their_own():
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a  # of 2,048 bytes: every polynomial mod 2**64 gives both the same
    data = np.frombuffer(f"{a} {b}".encode(), np.uint8)
    hashes, _ = K.word_hashes(data, np.array([0, len(data)]), K.BY_SPACE)
    assert len(hashes) == 2 and hashes[0] != hashes[1]


@given(st.lists(st.text(alphabet="abA9é", min_size=1, max_size=90), min_size=1, max_size=30))
@settings(deadline=None, max_examples=80)
def test_a_word_has_one_hash_wherever_it_stands(words):
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    hashes, _ = K.word_hashes(data, np.array([0, len(data)]), K.BY_SPACE)
    for w, h in zip(words, hashes, strict=True):
        alone = np.frombuffer(w.encode(), np.uint8)
        assert K.word_hashes(alone, np.array([0, len(alone)]), K.BY_SPACE)[0][0] == h
    assert len(set(hashes.tolist())) == len({low(w) for w in words})
