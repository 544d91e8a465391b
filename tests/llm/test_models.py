"""Classifiers, tokens and spans against brute force, the libraries or held-out rows."""

import itertools
import random
import time

import numpy as np
import pytest

from plumbline.llm import attribution as A
from plumbline.llm import language as L
from plumbline.llm import sentencepieces as S
from plumbline.llm import toxicity as T

TEXTS = ["", "Hello there, world", "  two  spaces \n\n and lines\n", "▁marked ▁", "日本語 テキスト\tтекст\x00", "<s> not control </s><unk>", "a" * 2000, "\U0001f642 é́ é", "\r\n  x", "don't we'll I'VE", "1234 56 ½²", "ǅ ɐ ʰ \x1c"]


def test_nonnegative_pu_parts_what_labels_do_not():
    r = np.random.default_rng(0)
    n, d, prior = 4000, 12, 0.2
    y = r.random(n) < prior
    x = (r.random((n, d)) < np.where(y[:, None], 0.5, 0.05)).astype(np.float32)
    known = np.flatnonzero(y)[:300]
    w, b, risks = T.nonnegative_pu_fit(x[known], x, prior, T.Settings(epochs=200))
    said = T.sigmoid(x @ w + b) >= 0.5
    assert (said == y).mean() > 0.93 and min(risks) >= 0 and risks[-1] < risks[0]


def test_features_are_those_that_toxic_texts_have_more_often():
    df_p, df_u = np.array([50, 5, 0, 90]), np.array([60, 50, 500, 900])
    assert T.select_features(df_p, 100, df_u, 1000, 0.1, 10, 3.5).tolist() == [0]


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 6 == 0
        text = [r.choice(words) for _ in range(r.choice([5, 40, 200]))]
        if toxic:
            for _ in range(3):
                text.insert(r.randrange(len(text)), r.choice(["vile", "Vermin", "filthy", "scumbag"]))
        rows.append((i, " ".join(text)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = T.score(docs, T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 200
    assert sum((r["predicted"] == 1) == (r["doc_id"] % 6 == 0) for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and (r["predicted"] == 1) == (r["score"] >= 0.5) for r in out)


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_is_the_best_of_all_paths(seed):
    r = np.random.default_rng(seed)
    sizes = [0, 1, 5, 6, 3]
    at = np.concatenate(([0], np.cumsum(sizes)))
    scores = r.normal(0, 4, (at[-1], 3)).astype(np.float32)
    path = L.viterbi(scores, at, 2.5)

    def total(p, s):
        return sum(s[t, x] for t, x in enumerate(p)) - 2.5 * sum(a != b for a, b in itertools.pairwise(p))

    for a, b in itertools.pairwise(at):
        s = scores[a:b]
        best = max((total(p, s) for p in itertools.product(range(3), repeat=b - a)), default=0)
        assert total(path[a:b], s) == pytest.approx(best, abs=1e-4)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1024])
def test_blocks_of_long_texts_give_a_best_path(monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    r = np.random.default_rng(block)
    for _ in range(40):
        at = np.concatenate(([0], np.cumsum(r.integers(0, 40, r.integers(1, 6)))))
        scores = r.normal(0, 2, (at[-1], r.integers(1, 5))).astype(np.float32)
        path = L.viterbi(scores, at, 3.0)
        for a, b in itertools.pairwise(at.tolist()):
            if a == b:
                continue
            v = scores[a].astype(float)
            for t in range(a + 1, b):
                v = np.maximum(v, v.max() - 3.0) + scores[t]
            own = scores[np.arange(a, b), path[a:b]].astype(float).sum() - 3.0 * (path[a + 1 : b] != path[a : b - 1]).sum()
            assert abs(own - v.max()) < 1e-3


def test_a_long_text_takes_seconds():
    r, began = np.random.default_rng(1), time.monotonic()
    scores = r.normal(0, 2, (400_000, 4)).astype(np.float32)
    assert len(L.viterbi(scores, np.array([0, 400_000]), 3.0)) == 400_000 and time.monotonic() - began < 10


def test_languages_spans_and_scripts(spark):
    say = {"en": "the quick brown fox jumps over lazy dogs while children walk through nights", "de": "der schnelle braune fuchs springt über den faulen hund während kinder durch nächte gehen", "ru": "быстрая лиса прыгает через ленивую собаку пока дети идут домой"}
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(say[lang].split()) for _ in range(r.choice([2, 30]))), lang) for i, lang in enumerate(["en", "de", "ru"] * 100)]
    docs = spark.createDataFrame([*rows, (900, "123 ---", "en"), (901, "собака", None)], "doc_id long, text string, lang string")
    model = L.train(docs)
    out = {x["doc_id"]: x for x in L.predict(docs, model).collect()}
    held = [(out[i]["lang_pred"], lang) for i, _, lang in rows if out[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert out[900]["lang_pred"] == "und" and out[900]["score"] == 0 and out[901]["lang_pred"] == "ru"
    mixed = " ".join(say["en"].split()[:8] + say["ru"].split()[:6] + say["de"].split()[:8])
    assert L.spans(mixed, model) == [(0, 8, "en"), (8, 14, "ru"), (14, 22, "de")]
    assert L.script_of(np.array([ord(c) for c in "aéЖ日あ한ا1"])).tolist() == [L.SCRIPT_NAMES.index(x) for x in ("latin", "latin", "cyrillic", "han", "kana", "hangul", "arabic", "other")]


@pytest.fixture(scope="module")
def codec():
    return S.Codec(S.Model.load(S.default_model()))


def test_tokens_are_those_of_sentencepiece(codec):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=S.default_model())
    offsets, ids = codec.encode(TEXTS)
    for i, t in enumerate(TEXTS):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == sp.encode(t), t
    assert codec.decode(offsets, ids) == [sp.decode(sp.encode(t)) for t in TEXTS]
    whole = codec.core.encode_batch([codec.normalise(t) for t in TEXTS], add_special_tokens=False)
    assert [e.ids for e in whole] == [ids[a:b].tolist() for a, b in itertools.pairwise(offsets)]


def test_unigram_models_are_rebuilt():
    def field(n, kind, body):
        key = bytes([n << 3 | kind])
        return key + (bytes([len(body)]) + body if kind == 2 else body)

    import struct

    piece = lambda p, s, k: field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k])))
    data = piece("<unk>", 0.0, 2) + piece("▁ab", -1.0, 1) + piece("▁", -3.0, 1) + piece("a", -2.0, 1) + piece("b", -2.0, 1) + piece("c", -2.5, 1) + field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x00"))
    m = S.Model.parse(data)
    assert m.type == S.UNIGRAM and m.dummy_prefix and not m.squeeze
    codec = S.Codec(m)
    offsets, ids = codec.encode(["ab c", "zz", ""])
    assert ids[: offsets[1]].tolist() == [1, 2, 5] and codec.decode(offsets, ids)[0] == "ab c"


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_unigram_models_encode_as_the_library_does(byte_fallback):
    """A model of some thousand pieces, made here from the n-grams of a text with their log shares as scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    r = random.Random(12)
    stems = [f"{a}{b}{c}" for a in "bdfgklmnprstv" for b in ("a", "e", "i", "o", "u", "é", "ö") for c in ("", "n", "st", "ll", "日")]
    words = ["".join(r.choice(stems) for _ in range(r.randrange(1, 4))) for _ in range(800)]
    seen = {}
    for w in (f"▁{w}" for w in words):
        for i in range(len(w)):
            for n in range(1, 7):
                if i + n <= len(w):
                    seen[w[i : i + n]] = seen.get(w[i : i + n], 0) + 1
    proto = pb.ModelProto()
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    proto.trainer_spec.byte_fallback = byte_fallback
    proto.normalizer_spec.add_dummy_prefix = True
    proto.normalizer_spec.remove_extra_whitespaces = True
    proto.normalizer_spec.escape_whitespaces = True
    add = lambda p, score, kind: proto.pieces.add(piece=p, score=score, type=kind)
    add("<unk>", 0.0, S.UNKNOWN), add("<s>", 0.0, S.CONTROL), add("</s>", 0.0, S.CONTROL)
    if byte_fallback:
        for i in range(256):
            add(f"<0x{i:02X}>", 0.0, S.BYTE)
    total = sum(seen.values())
    for i, (p, n) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:4000]):
        add(p, float(np.log(n / total)) - i * 1e-5, S.NORMAL)
    data = proto.SerializeToString()
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    m = S.Model.parse(data)
    assert m.type == S.UNIGRAM and m.byte_fallback == byte_fallback and len(m.pieces) > 3000
    codec = S.Codec(m)
    texts = [" ".join(r.choice(words) + r.choice(["", "", "s", "x", "日", "🙂"]) for _ in range(r.randrange(0, 40))) for _ in range(150)] + ["", "  two  spaces ", "ñandú \x00 z", "zzzz" * 50]
    # texts that spell control, unknown and byte pieces, whole, in words and beside characters that no piece has
    texts += ["<s> hello </s>", "<0x41>", "<unk>", "ba<s>da", "<0x0A><0x41>日", "▁<s>▁", "< 0 x 4 1 >", "<s", " 0", " 1 2", "▁ 5", "<s>" * 30]
    offsets, ids = codec.encode(texts)
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(offsets)] == sp.encode(texts)
    assert codec.decode(offsets, ids) == sp.decode(sp.encode(texts))
    assert not {1, 2} & set(ids.tolist())


def test_unigram_pieces_that_are_not_used_are_never_found():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for p, score, kind in [("<unk>", 0.0, S.UNKNOWN), ("<s>", 0.0, S.CONTROL), ("▁", -2.0, S.NORMAL), ("<", -3.0, S.NORMAL), ("s", -3.0, S.NORMAL), (">", -3.0, S.NORMAL), ("ab", -0.1, S.UNUSED), ("a", -4.0, S.NORMAL), ("b", -4.0, S.NORMAL)]:
        proto.pieces.add(piece=p, score=score, type=kind)
    data = proto.SerializeToString()
    codec, sp = S.Codec(S.Model.parse(data)), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["<s>", "ab", "a<s>b ab", "q<s>q", "a b"]
    offsets, ids = codec.encode(texts)
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(offsets)] == sp.encode(texts)
    with pytest.raises(ValueError):
        m = S.Model.parse(data)
        m.escape = False
        m.core()


def test_models_that_cannot_be_rebuilt_are_refused():
    from sentencepiece import sentencepiece_model_pb2 as pb

    def model(**changes):
        proto = pb.ModelProto()
        proto.pieces.add(piece="<unk>", score=0, type=S.UNKNOWN)
        proto.pieces.add(piece="a", score=-1, type=changes.get("kind", S.NORMAL))
        proto.trainer_spec.model_type = changes.get("type", S.UNIGRAM)
        proto.trainer_spec.treat_whitespace_as_suffix = changes.get("suffix", False)
        if "map" in changes:
            proto.denormalizer_spec.precompiled_charsmap = changes["map"]
        proto.trainer_spec.unk_surface = "?"
        return S.Model.parse(proto.SerializeToString())

    assert model().unknown_surface == "?"
    for bad in ({"kind": S.USER_DEFINED}, {"suffix": True}, {"map": b"x"}, {"type": 3}):
        with pytest.raises(ValueError):
            model(**bad)


def test_other_kinds_of_vocabulary_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        A.Spans(public_tokenizers.path("word_bpe_49k.json"))


def test_an_encoded_table_decodes_to_its_texts(spark):
    plain = [t for t in TEXTS if "▁" not in t]
    df = spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string")
    out = S.decode(S.encode(df)).collect()
    assert {r["doc_id"]: r["decoded"] for r in out} == dict(enumerate(plain))


def test_tokens_with_spans_are_those_of_the_whole_text():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A.default_tokenizer())
    t.encode_special_tokens = True
    spans = A.Spans(A.default_tokenizer())
    offsets, ids, first, end = spans.of(TEXTS)
    for i, (text, e) in enumerate(zip(TEXTS, t.encode_batch(TEXTS, add_special_tokens=False), strict=True)):
        a, b = offsets[i], offsets[i + 1]
        assert ids[a:b].tolist() == e.ids, text
        assert (first[a:b] >= 0).all() and (end[a:b] <= len(text)).all()
        covered = np.zeros(len(text), bool)
        for x, y in zip(first[a:b], end[a:b], strict=True):
            covered[x:y] = True
        assert covered.all()


def test_rules_for_tokens_across_a_boundary():
    starts, ends, bounds = np.array([0, 3, 9]), np.array([3, 8, 10]), np.array([0, 4, 6, 10])
    got = {rule: A.allocate(starts, ends, bounds, rule)[0].tolist() for rule in A.RULES}
    assert got == {"start": [2, 0, 1], "end": [1, 0, 2], "majority": [1, 1, 1], "split": [1.2, 0.4, 1.4]}
    assert A.allocate(starts, ends, bounds, "end")[1] == 1
    with pytest.raises(ValueError):
        A.Settings(rule="none")


def test_section_counts_add_up(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for s in (A.Settings(), A.Settings(rule="split")):
        for r in A.by_section(df, s).collect():
            assert sum(r["section_tokens"]) == pytest.approx(r["n_tokens"]) and len(r["section_tokens"]) == r["n_sections"]
            assert r["n_chars"] == len(TEXTS[r["doc_id"]])
    row = A.by_field(spark.createDataFrame([(1, "ab", "cd ef")], "doc_id long, x string, y string"), ["x", "y"]).first()
    assert row["n_sections"] == 2 and row["n_chars"] == 8


def test_texts_in_several_languages_stay(spark):
    say = {"en": "the quick brown fox jumps over lazy dogs while children walk through nights", "el": "η γρήγορη αλεπού πηδάει πάνω από το σκυλί ενώ τα παιδιά πάνε", "ru": "быстрая лиса прыгает через ленивую собаку пока дети идут домой", "ar": "الثعلب السريع يقفز فوق الكلب الكسول بينما يمشي الأطفال"}
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(say[lang].split()) for _ in range(20)), lang) for i, lang in enumerate(["en", "el", "ru", "ar"] * 45)]
    mixed = " ".join(" ".join(say[x].split())[:40] for x in say)
    docs = spark.createDataFrame([*rows, (900, mixed, None), (901, "123 ---", "en")], "doc_id long, text string, lang string")
    assert {x["score"] < 0.4 for x in L.predict(docs, L.train(docs)).where("doc_id = 900").collect()} == {True}
    assert {x["doc_id"] for x in L.reject(docs).collect()} == {*range(180), 900}


def test_letters_are_code_points_and_unspaced_scripts_are_cut():
    s = L.Settings()

    def words(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        w = L.words_of(raw, np.array([0, len(raw)]), s)
        return [(text[a:b], int(n)) for a, b, n in zip(w.starts, w.ends, w.letters, strict=True)]

    assert words("ab é1c") == [("ab", 2), ("é", 1), ("c", 1)]
    assert words("日本語とabcЖук") == [("日", 1), ("本", 1), ("語", 1), ("と", 1), ("abc", 3), ("Жук", 3)]
    assert words("กำ e\u0301a ́x") == [("ก", 1), ("ำ", 1), ("e\u0301a", 2), ("x", 1)]
    assert words("") == [] and words("12 \u0301") == []


def test_words_of_a_chunk_are_those_of_its_texts():
    r = random.Random(3)
    texts = ["".join(r.choice("ab é日か Ж1\u0301ก.") for _ in range(r.randrange(0, 30))) for _ in range(200)]
    s = L.Settings()
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    every = L.words_of(np.frombuffer(b"".join(raw), np.uint8), offsets, s)
    begin = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    for i, t in enumerate(texts):
        data = np.frombuffer(raw[i], np.uint8)
        one = L.words_of(data, np.array([0, len(data)]), s)
        a, b = every.at[i], every.at[i + 1]
        assert (every.starts[a:b] - begin[i]).tolist() == one.starts.tolist() and (every.ends[a:b] - begin[i]).tolist() == one.ends.tolist()
        assert every.letters[a:b].tolist() == one.letters.tolist() and every.slot[begin[i] : begin[i + 1]].tolist() == one.slot.tolist()


def test_the_language_of_most_letters_wins_whatever_its_bytes(spark):
    say = {"en": "the quick brown fox jumps over lazy dogs while children walk through nights", "ru": "быстрая лиса прыгает через ленивую собаку пока дети идут домой", "ja": "私は毎朝公園まで歩いて新聞を読みますそれから仕事に行きます"}
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(say[lang].split()) for _ in range(20)) if lang != "ja" else "".join(r.choice(say["ja"]) for _ in range(40)), lang) for i, lang in enumerate(["en", "ru", "ja"] * 60)]
    latin = "the quick brown fox jumps over lazy dogs while children"  # 46 letters
    cyrillic = "быстрая лиса прыгает через ленивую соба"  # 34 letters, 68 bytes
    kana = "私は毎朝公園まで歩いて新聞を読みますそれから仕事に行きます"
    docs = spark.createDataFrame([*rows, (900, f"{latin} {cyrillic}", None), (901, f"{kana * 3} the quick brown fox", None)], "doc_id long, text string, lang string")
    out = {x["doc_id"]: x for x in L.predict(docs, L.train(docs)).collect()}
    assert out[900]["lang_pred"] == "en" and out[900]["score"] == pytest.approx(46 / 80)
    assert out[901]["lang_pred"] == "ja" and out[901]["score"] > 0.8


def test_one_text_of_many_rows_is_one_text_of_the_sample(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} calm words here {i}") for i in range(300)] + [(300 + i, f"vile vermin {i}") for i in range(60)] + [(7, "calm repeated text")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(0, 360, 2)], "doc_id long, toxic int")
    s = T.Settings(positives=20, unlabelled=200)
    m = T.train(docs, labels, s)
    again = T.train(docs.repartition(7), labels, s)
    assert len(m["slots"]) and m["weights"].tolist() == again["weights"].tolist()
    out = T.score(docs, m).where("held_out").collect()
    assert all((r["predicted"] == 1) == (r["doc_id"] >= 300) for r in out) and len(out) > 30
