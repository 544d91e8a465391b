"""Language of texts whose parts may be in several languages.

Letters are code points. A run of letters of one script is a word; in scripts that don't set words apart each letter
is one. Every word is scored for each language by its character trigrams, learned from labelled texts; only languages
that have been seen with the word's script are candidates. The best path of languages through a text's words, with a
penalty for each switch, gives spans of one language; the language of most letters is the text's.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import kernel as K
from plumbline.llm.store import free_names, in_training_folds


@dataclass(frozen=True)
class Settings:
    """switch: nats that a change of language costs. smoothing: added to each trigram's count."""

    switch: float = 8.0
    smoothing: float = 0.5
    slots_log2: int = 16
    batch_bytes: int = 8 << 20


#: First and last code point of the scripts told apart.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "indic": [(0xA00, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "georgian": [(0x10A0, 0x10FF)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
    "kana": [(0x3040, 0x30FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
SCRIPT_NAMES = ["other", *SCRIPTS]
_EDGES = np.array(sorted((low, high, SCRIPT_NAMES.index(name)) for name, ranges in SCRIPTS.items() for low, high in ranges))


#: Scripts in which a letter stands for a word, as spaces don't part words.
UNSPACED = [SCRIPT_NAMES.index(x) for x in ("thai", "lao", "tibetan", "khmer", "kana", "han")]


def script_of(points: np.ndarray) -> np.ndarray:
    at = np.searchsorted(_EDGES[:, 0], points, "right") - 1
    return np.where((at >= 0) & (points <= _EDGES[at, 1]), _EDGES[at, 2], 0)


#: Kinds of code points other than letters, whose kind is their script: marks, which are of the letter before, and the rest.
MARK, OTHER = 254, 255


@cache
def kinds() -> np.ndarray:
    """For each code point the script of a letter, MARK or OTHER."""
    out = script_of(np.arange(0x110000)).astype(np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind != "L":
            out[i] = MARK if kind == "M" else OTHER
    return out


@dataclass
class Words:
    """Of a chunk of texts: where words begin and end among code points, each word's script and letters, each letter's
    trigram slot (one beyond all for what is no letter), and the offsets of each text's words."""

    starts: np.ndarray
    ends: np.ndarray
    script: np.ndarray
    letters: np.ndarray
    slot: np.ndarray
    at: np.ndarray


def words_of(text: np.ndarray, offsets: np.ndarray, s: Settings) -> Words:
    """Words of texts given as UTF-8."""
    points = np.frombuffer(text.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first = (text & 0xC0) != 0x80  # bytes that begin a code point
    edges = np.concatenate(([0], np.cumsum(first)))[offsets]
    n = len(points)
    kind = kinds()[points]
    edge = np.zeros(n + 1, bool)
    edge[edges] = True
    # a mark is of the letter before it, if one is there in the same text
    marks = np.flatnonzero(kind == MARK)
    if len(marks):
        base = np.where(kind == MARK, -1, np.arange(n))
        base[edges[:-1][edges[:-1] < n]] = edges[:-1][edges[:-1] < n]
        base = np.maximum.accumulate(base)
        kind = kind[base]
        kind[kind == MARK] = OTHER
    letter = kind != OTHER
    before = np.zeros(n, bool)
    before[1:] = kind[1:] == kind[:-1]
    before[edge[:n]] = False  # in one run with the code point before
    single = np.isin(kind, UNSPACED)
    is_mark = np.zeros(n, bool)
    is_mark[marks] = letter[marks]
    begins = letter & (~before | single & ~is_mark)
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(begins | ~letter)
    after = np.searchsorted(stops, starts, "right")
    ends = np.append(stops, n)[after]
    ends = np.minimum(ends, edges[np.minimum(np.searchsorted(edges, starts, "right"), len(edges) - 1)]) if len(starts) else ends
    v = np.where(letter, points, 0).astype(np.uint64)
    left, right = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    left[1:] = np.where(before[1:], v[:-1], 0)
    right[:-1] = np.where(before[1:], v[1:], 0)
    slot = (K.mix(left << K.U64(42) | v << K.U64(21) | right) >> K.U64(64 - s.slots_log2)).astype(np.int64)
    slot[~letter] = 1 << s.slots_log2
    counted = np.concatenate(([0], np.cumsum(letter & ~is_mark)))
    return Words(starts, ends, kind[starts].astype(np.int64), counted[ends] - counted[starts], slot, np.searchsorted(starts, edges))


def lowered(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.lower(F.col("text").cast("string")).alias("text"), *more)


def train(docs: DataFrame, s: Settings = Settings()) -> dict:
    """Counts trigrams and scripts of all texts outside fold 0 whose lang isn't null; the model is what scores need.

    What the driver gathers is bounded by languages times slots, not by texts: 65,556 numbers a language.
    """
    spark = docs.sparkSession
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(in_training_folds(F.col("doc_id")))
    langs = sorted(r["lang"] for r in known.groupBy("lang").count().collect())
    if not langs:
        return {"langs": [], "table": np.zeros((1, 0), np.float32), "seen": np.zeros((len(SCRIPT_NAMES), 0), bool), "settings": s}
    sent, n_slots, n_scripts = spark.sparkContext.broadcast({x: i for i, x in enumerate(langs)}), (1 << s.slots_log2) + 1, len(SCRIPT_NAMES)

    def count(batches):
        number = sent.value
        grams, scripts = np.zeros((len(number), n_slots), np.int64), np.zeros((len(number), n_scripts), np.int64)
        for batch in batches:
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for first, end, text, offsets in K.chunks(K.text_column(batch)):
                w = words_of(text, offsets, s)
                word_lang = np.repeat(lang[first:end], np.diff(w.at))
                size = w.ends - w.starts
                letter_lang = np.repeat(word_lang, size)
                place = np.arange(len(letter_lang)) + np.repeat(w.starts - (np.cumsum(size) - size), size)
                for i in np.unique(lang[first:end]):
                    grams[i] += np.bincount(w.slot[place[letter_lang == i]], minlength=n_slots)
                    scripts[i] += np.bincount(w.script[word_lang == i], minlength=n_scripts)
        both = np.concatenate((grams, scripts), axis=1)
        i, j = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(both[i, j])], ["i", "j", "n"])

    counted = lowered(known, "lang").select("text", "lang").mapInArrow(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros((len(langs), n_slots + n_scripts), np.int64)
    both[counted["i"], counted["j"]] = counted["n"]
    grams, scripts = both[:, :n_slots], both[:, n_slots:]
    grams[:, -1] = 0
    used = np.flatnonzero(grams.sum(axis=0))
    p = np.log((grams + s.smoothing) / (grams.sum(axis=1, keepdims=True) + s.smoothing * max(1, len(used))))
    table = p.T.astype(np.float32)
    table[-1] = 0
    return {"langs": langs, "table": table, "seen": (scripts > 0).T, "settings": s}


def word_scores(text: np.ndarray, offsets: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of each word (row) for each language, letters of each word, and offsets of each text's words.

    Scripts narrow candidates: a language never seen with the word's script falls far behind those that were.
    """
    w = words_of(text, offsets, model["settings"])
    if not len(w.starts):
        return np.zeros((0, len(model["langs"])), np.float32), np.zeros(0, np.int64), w.at
    # letters alone, so that no word's sum runs on into what follows it
    size = w.ends - w.starts
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) + np.repeat(w.starts - begin, size)
    scores = np.add.reduceat(model["table"][w.slot[place]], begin, axis=0)
    scores -= scores.max(axis=1, keepdims=True)
    seen = model["seen"][w.script]
    scores[~seen & seen.any(axis=1, keepdims=True)] -= 50
    return scores, w.letters, w.at


#: Words of a block: longer texts are cut into such, which are gone through side by side.
BLOCK = 1024


def _paths(scores: np.ndarray, begin: np.ndarray, length: np.ndarray, v: np.ndarray, switch: float, carried: np.ndarray, final: np.ndarray | None, path: np.ndarray | None) -> np.ndarray:
    """Goes through stretches of words side by side, longest first, from the values v of each language before its first
    word (taken as a word's before it where carried), and returns the values behind its last. With path, the best
    languages are written there, those at the ends given by final, or the best where it has -1."""
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(longest), "left")  # stretches longer than t
    if path is not None:
        stay, best = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int16)
    v = v.astype(np.float64)
    for t in range(longest):
        k = active[t]
        rows, now = begin[:k] + t, v[:k]
        top = now.max(axis=1)
        held = now >= (top - switch)[:, None]
        if not t:
            held |= ~carried[:k, None]  # a text's first word comes from nowhere
        if path is not None:
            best[rows], stay[rows] = now.argmax(axis=1), held
        v[:k] = np.where(held, now, (top - switch)[:, None]) + scores[rows]
    if path is not None:
        state = v.argmax(axis=1) if len(length) else np.zeros(0, np.int64)
        if final is not None:
            state = np.where(final < 0, state, final)
        for t in range(longest - 1, -1, -1):
            k = active[t]
            rows = begin[:k] + t
            path[rows] = state[:k]
            if t:
                state[:k] = np.where(stay[rows, state[:k]], state[:k], best[rows])
    return v


def viterbi(scores: np.ndarray, at: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word, texts side by side, longest first. Ties go to staying, then to the first.

    A long text is cut into blocks. What each turns the values of the languages before it into is a max-plus matrix,
    found for all blocks side by side; their products along the text give the values and the best language at each cut,
    and the blocks' own paths are found side by side again."""
    n_langs, n = scores.shape[1], np.diff(at)
    cuts = [np.arange(a, b, BLOCK) if m > 2 * BLOCK else np.array([a]) for a, b, m in zip(at[:-1], at[1:], n, strict=True) if m]
    begin = np.concatenate(cuts) if cuts else np.zeros(0, np.int64)
    text_of = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
    ends = np.append(begin[1:], at[-1])
    length = ends - begin
    carried = np.zeros(len(begin), bool)
    carried[1:] = text_of[1:] == text_of[:-1]
    into, final = np.zeros((len(begin), n_langs)), None
    if carried.any():
        # all blocks of long texts, once for each language that the word before may have
        long = np.flatnonzero(carried | np.append(carried[1:], False))
        order = np.argsort(-np.repeat(length[long], n_langs), kind="stable")
        start = np.tile(np.where(np.eye(n_langs, dtype=bool), 0.0, -np.inf), (len(long), 1))
        out = np.empty_like(start)
        out[order] = _paths(scores, np.repeat(begin[long], n_langs)[order], np.repeat(length[long], n_langs)[order], start[order], switch, np.ones(len(order), bool), None, None)
        turns = dict(zip(long.tolist(), out.reshape(len(long), n_langs, n_langs), strict=True))
        final, values = np.full(len(begin), -1), {}
        # a text's first block comes from nowhere, so that each language begins with nothing
        heads = long[~carried[long]]
        heads = heads[np.argsort(-length[heads], kind="stable")]
        values |= zip(heads.tolist(), _paths(scores, begin[heads], length[heads], into[heads], switch, carried[heads], None, None), strict=True)
        for b in long.tolist():
            if carried[b]:
                values[b] = (into[b][:, None] + turns[b]).max(axis=0)
            if b + 1 < len(begin) and carried[b + 1]:
                into[b + 1] = values[b] - values[b].max()
        for b in reversed(long.tolist()):
            if b + 1 == len(begin) or not carried[b + 1]:
                final[b] = values[b].argmax()
            if carried[b]:
                come = into[b] + turns[b][:, final[b]]
                final[b - 1] = final[b] if come[final[b]] == come.max() else come.argmax()
    path = np.zeros(len(scores), np.int16)
    order = np.argsort(-length, kind="stable")
    _paths(scores, begin[order], length[order], into[order], switch, carried[order], None if final is None else final[order], path)
    return path


def decoded(text: np.ndarray, offsets: np.ndarray, model: dict, piece: int = 1 << 20):
    """Path, letters and offsets of the words of texts. Words are scored over a piece of the texts at a time, which
    bounds what scoring needs besides the scores; paths are then found for all texts side by side."""
    parts, row = [], 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + piece, "right")) - 1)
        parts.append(word_scores(text[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], model))
        row = end
    scores = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, len(model["langs"])), np.float32)
    size = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    at = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts])))) if parts else np.zeros(1, np.int64)
    return viterbi(scores, at, model["settings"].switch), size, at


def spans(text: str, model: dict) -> list[tuple[int, int, str]]:
    """Spans [first word, end word) of one language in a text."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    path, _, _ = decoded(raw, np.array([0, len(raw)]), model)
    cuts = np.flatnonzero(np.diff(path)) + 1
    edges = [0, *cuts.tolist(), len(path)] if len(path) else [0]
    return [(a, b, model["langs"][path[a]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def labelled(docs: DataFrame, model: dict) -> tuple[DataFrame, str, str, str]:
    """docs with three further columns, and their names: the language, the share of the text's letters in spans of it,
    and the number of spans. By a pass over the rows and without a join.

    A text without letters, or null, is und with share 0; so is every text if nothing was learned. Ties go to the
    language first in order."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    low, pred, share_, spans_ = free_names(["low", "lang_pred", "score", "n_spans"], docs)

    def apply(batches):
        m = sent.value
        n_langs = len(m["langs"])
        names = np.array([*m["langs"], "und"], object)
        limit = max(1 << 16, min(m["settings"].batch_bytes, (32 << 20) // max(1, n_langs)))
        for batch in batches:
            lang, score, n_spans = np.full(batch.num_rows, n_langs), np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for first, end, text, offsets in K.chunks(K.text_column(batch, low), limit) if n_langs else []:
                path, size, at = decoded(text, offsets, m)
                doc = np.repeat(np.arange(end - first), np.diff(at))
                share = np.bincount(doc * n_langs + path, size, (end - first) * n_langs).reshape(-1, n_langs)
                total = share.sum(axis=1)
                good = total > 0
                lang[first:end] = np.where(good, share.argmax(axis=1), n_langs)
                score[first:end] = np.where(good, share.max(axis=1) / np.maximum(total, 1), 0)
                turn = np.flatnonzero((path[1:] != path[:-1]) & (doc[1:] == doc[:-1]))
                n_spans[first:end] = np.where(good, np.bincount(doc[turn], minlength=end - first) + 1, 0)
            yield K.extended(batch, [low], {pred: pa.array(names[lang].tolist(), pa.string()), share_: pa.array(score), spans_: pa.array(n_spans)})

    schema = K.schema_with(docs, f"`{pred}` string, `{share_}` double, `{spans_}` long")
    return docs.withColumn(low, F.lower(F.col("text").cast("string"))).mapInArrow(apply, schema), pred, share_, spans_


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_spans) for each row of docs; see labelled()."""
    out, pred, share, spans_ = labelled(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return out.select("doc_id", (~in_training_folds(F.col("doc_id"))).alias("held_out"), F.col(pred).alias("lang_pred"), F.col(share).alias("score"), F.col(spans_).alias("n_spans"))


def reject(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs without the rows that have no letters; texts in several languages stay, whatever the share of each. A null
    lang becomes the predicted one. The columns of docs, in which other names are free; where nothing can be learned
    every row has no language, and all rows with letters stay."""
    model = train(docs, s)
    if not model["langs"]:
        return docs.where(F.coalesce(F.rlike(F.col("text").cast("string"), F.lit(r"\pL")), F.lit(False)))
    out, pred, *_ = labelled(docs, model)
    return out.where(F.col(pred) != "und").withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)
