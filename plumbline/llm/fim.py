"""Fill-in-middle transformation: a text's units are cut at two places, and the middle part is moved to the end.

A unit is a run of ASCII letters or any other single character. One Aho-Corasick automaton finds, in one scan, the
sentinels and the characters that end a run of letters. Between two such events are letters alone, so that the units
up to each event are known by arithmetic: one for each event, and one for each gap that isn't empty. The place of the
unit with a given rank is then looked up among the events; no unit is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import kernel as K
from plumbline.llm.store import free_names


@dataclass(frozen=True)
class Settings:
    """Sentinels of prefix, suffix and middle: ASCII without a question mark, no end of one beginning another. Of texts without them
    apply_percent are transformed, and of these spm_percent with the suffix first. seed goes before the id that the
    cuts are drawn from."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    apply_percent: int = 90
    spm_percent: int = 20
    seed: str = "1:"

    def __post_init__(self):
        marks = [self.prefix, self.suffix, self.middle]
        for a in marks:
            # rebuild() looks for the first one after a part without any; a border would let it begin within the part
            if not a.isascii() or not a or "?" in a or any(a[-k:] == b[:k] for b in marks for k in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError("sentinels must be ASCII without a question mark, and no end of one may begin another")


#: Characters scanned at a time.
PIECE = 1 << 20
#: The ASCII characters that end a run of letters, and are a unit each.
BREAKS = "".join(c for c in map(chr, range(128)) if not c.isalpha())


@lru_cache(maxsize=8)
def automaton(sentinels: tuple[str, ...]) -> ahocorasick.Automaton:
    """Ends at a sentinel with True, and at a character that ends a run of letters with False."""
    found = ahocorasick.Automaton()
    for c in BREAKS:
        found.add_word(c, False)
    for s in sentinels:
        found.add_word(s, True)
    found.make_automaton()
    return found


class Units:
    """The events of one text: n units, whether a sentinel is in it, and the place of any unit."""

    def __init__(self, text: str, sentinels: tuple[str, ...], piece: int = PIECE):
        # a character for each code point: one beyond ASCII becomes "?", which ends runs of letters and is in no sentinel
        flat = text.encode("ascii", "replace").decode("ascii")
        search, longest, self.marked, events = automaton(sentinels), max(map(len, sentinels)), False, []
        for begin in range(0, len(flat), piece):
            # a piece begins with the end of the one before, in which a sentinel may begin
            found = list(search.iter(flat, max(0, begin - longest + 1), min(len(flat), begin + piece)))
            self.marked = self.marked or any(s for _, s in found)
            breaks = np.array([end for end, sentinel in found if not sentinel], np.int64)
            events.append(breaks[np.searchsorted(breaks, begin) :])
        self.events = np.concatenate((*events, [len(flat)]))
        gaps = np.diff(self.events, prepend=-1) > 1
        # units before each event: the events before it, and the gaps up to it that hold letters
        self.before = np.arange(len(gaps)) + np.cumsum(gaps)
        self.n = int(self.before[-1])

    def place(self, rank: int) -> int:
        """Characters that the first rank units take."""
        i = int(np.searchsorted(self.before, rank))
        if self.before[i] == rank:
            return int(self.events[i])
        # the unit of this rank is the event before, and the gap after it the next
        return int(self.events[i - 1]) + 1 if i else 0


def arrange(text: str, first: int, second: int, form: str, s: Settings) -> str:
    """The text in a form, cut after first and second characters."""
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if form == "psm":
        return f"{s.prefix}{prefix}{s.suffix}{suffix}{s.middle}{middle}"
    return f"{s.suffix}{suffix}{s.prefix}{prefix}{s.middle}{middle}" if form == "spm" else text


def rebuild(output: str, form: str, s: Settings = Settings()) -> str:
    """The text that arrange() made output from; its parts hold no sentinel."""
    if form == "plain":
        return output
    one, two = (s.prefix, s.suffix) if form == "psm" else (s.suffix, s.prefix)
    a, rest = output[len(one) :].split(two, 1)
    b, middle = rest.split(s.middle, 1)
    return a + middle + b if form == "psm" else b + middle + a


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    for begin, end, _, _ in K.chunks(K.text_column(batch, column)):
        yield batch.slice(begin, end - begin)


def transform(docs: DataFrame, s: Settings = Settings(), keep_text: bool = False) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output; without text unless keep_text.

    h1 to h4 are the first four groups of eight hexadecimal digits of the sha256 of the seed and the decimal doc_id
    (nothing for a null id). The cuts are after h1 % (n + 1) and h2 % (n + 1) units. The form is plain, and the output
    the text, where the text is null or empty, holds a sentinel or h3 % 100 >= apply_percent; else spm if
    h4 % 100 < spm_percent, else psm; prefix_chars and middle_chars are code points, null if plain. A null text is the
    empty one. Columns of docs that are named like a new one give way to it. Rows of one id are cut by the same
    numbers. A text is scanned in pieces; a task holds a text or about a megabyte of them. No row is moved.
    """
    new = ["n", "form", "prefix_chars", "middle_chars", "output"]
    docs = docs.drop(*(c for c in docs.columns if c.lower() in new))
    digest = F.sha2(F.concat(F.lit(s.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    names = free_names(["h1", "h2", "h3", "h4"], docs)
    drawn = docs.withColumns({h: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i, h in enumerate(names)})
    sentinels = (s.prefix, s.suffix, s.middle)
    kept = docs if keep_text else docs.drop("text")

    def cut(batches):
        for whole in batches:
            for batch in _slices(whole, "text"):
                out: dict[str, list] = {k: [] for k in new}
                for text, h1, h2, h3, h4 in zip(K.text_column(batch).to_pylist(), *(batch.column(h).to_pylist() for h in names), strict=True):
                    text = text or ""
                    units = Units(text, sentinels)
                    plain = not text or units.marked or h3 % 100 >= s.apply_percent
                    form = "plain" if plain else "spm" if h4 % 100 < s.spm_percent else "psm"
                    first, second = (units.place(r) for r in sorted((h1 % (units.n + 1), h2 % (units.n + 1))))
                    for k, v in zip(new, (units.n, form, None if plain else first, None if plain else second - first, arrange(text, first, second, form, s)), strict=True):
                        out[k].append(v)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield K.extended(batch, [*names, *([] if keep_text else ["text"])], {k: pa.array(out[k], kind) for k, kind in zip(new, kinds, strict=True)})

    return drawn.mapInArrow(cut, K.schema_with(kept, "n long, form string, prefix_chars long, middle_chars long, output string"))


def restore(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """rows (output, form, ...) with restored, the text that transform() had, rebuilt from output and form alone. A null
    output or form gives a null."""
    rows = rows.drop(*(c for c in rows.columns if c.lower() == "restored"))

    def back(batches):
        for whole in batches:
            for batch in _slices(whole, "output"):
                texts = [None if o is None or f is None else rebuild(o, f, s) for o, f in zip(K.text_column(batch, "output").to_pylist(), K.text_column(batch, "form").to_pylist(), strict=True)]
                yield K.extended(batch, [], {"restored": pa.array(texts, pa.string())})

    return rows.mapInArrow(back, K.schema_with(rows, "restored string"))


def digest(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) for each row of docs: the rows of
    transform() and restore(), with hashes in place of their texts."""
    rows = restore(transform(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), s), s)
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))
