"""Token counts by field or section: a document is encoded once, whole, and each token's characters say whose it is.

A byte-level vocabulary encodes pre-tokens apart from each other, so that a whole text's tokens are those of its
pre-tokens in order. Those that a task has met before aren't encoded again. Vocabularies that do otherwise are refused.

Fields are rendered into one text, or a text is cut into its lines; either gives spans of characters that tile the
document. Tokens are joined to spans by their own character spans. A token that crosses a boundary goes by rule:

start     to the span of its first character
end       to the span of its last character
majority  to the span with most of its characters, the first of equals
split     to each span in proportion to its characters there
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import kernel as K
from plumbline.llm.pieces import PieceCache, slices

RULES = ("start", "end", "majority", "split")


@dataclass(frozen=True)
class Settings:
    rule: str = "majority"
    tokenizer: str | None = None

    def __post_init__(self):
        if self.rule not in RULES:
            raise ValueError(f"rule must be one of {RULES}")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Fixed value: the pre-token pattern of the byte-level vocabulary. The second form says the same of texts below U+0250.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
NARROW = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")
_WIDE_TEXT = re.compile("[ɐ-\U0010ffff\x1c-\x1f]")


#: Fixed value: what the file of a byte-level vocabulary says of its pre-tokens, which PATTERN repeats.
PRE_TOKENS = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def refuse_other(tokenizer) -> None:
    """Raises unless a vocabulary's tokens of a text are those of its pre-tokens by PATTERN."""
    says = json.loads(tokenizer.to_str())
    pre = says.get("pre_tokenizer") or {}
    if says.get("normalizer") is not None or {k: pre.get(k) for k in PRE_TOKENS} != PRE_TOKENS or says["model"]["type"] != "BPE" or says["model"].get("continuing_subword_prefix") or says["model"].get("end_of_word_suffix") or says["model"].get("dropout"):
        raise ValueError("only byte-level vocabularies without a normaliser, a prefix space or another pre-token pattern")
    if any(not t.get("special") for t in says.get("added_tokens", ())):
        raise ValueError("a vocabulary with added tokens that are matched across pre-tokens")


class Spans:
    """Tokens of whole texts with the characters that each covers."""

    def __init__(self, tokenizer: str, checked: bool = False):
        """checked: refuse_other has seen the vocabulary."""
        import regex
        from tokenizers import Tokenizer

        self.wide = regex.compile(PATTERN)
        self.tokenizer = Tokenizer.from_file(tokenizer)
        if not checked:
            refuse_other(self.tokenizer)
        self.tokenizer.encode_special_tokens = True
        self.cache = PieceCache(self._encode, 3, joined=True)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        counts, ids, spans = [], [], [np.zeros(0, np.int32)]
        for some in slices(pieces):
            encoded = self.tokenizer.encode_batch(some, add_special_tokens=False)
            counts += map(len, encoded)
            ids.append(np.fromiter(chain.from_iterable(e.ids for e in encoded), np.int32))
            spans.append(np.fromiter(chain.from_iterable(x for e in encoded for x in e.offsets), np.int32))
        n, size = np.array(counts, np.int64), np.fromiter(map(len, pieces), np.int32, len(pieces))
        starts, ends = np.concatenate(spans).reshape(-1, 2).T.copy()
        # a token of spaces alone is reported without its characters; spans here are of all characters
        starts[1:] = np.minimum(starts[1:], ends[:-1])
        some = n > 0
        last = np.cumsum(n)[some] - 1
        starts[last - n[some] + 1] = 0
        ends[last] = size[some]
        return n, [np.concatenate(ids), starts, ends]

    def pieces(self, text: str) -> list[str]:
        return (self.wide if _WIDE_TEXT.search(text) else NARROW).findall(text)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(offsets of each text's tokens, ids, first character, end character), characters counted in each text."""
        parts = [self.pieces(t) for t in texts]
        flat = [p for x in parts for p in x]
        size = np.fromiter(map(len, flat), np.int64, len(flat))
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(n)
        begin = np.cumsum(size) - size
        first = np.repeat(begin[np.minimum(ends - n, max(0, len(flat) - 1))] if len(flat) else np.zeros(len(parts), np.int64), n)
        counts, of, (ids, s, e) = self.cache.look_up(flat)
        base = (begin - first)[of] if len(flat) else np.zeros(0, np.int64)
        total = np.concatenate(([0], np.cumsum(counts)))
        return np.concatenate(([0], total[ends])).astype(np.int64), ids, base + s, base + e


def allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each span, and how many tokens cross a boundary. bounds: where spans begin, then where the last ends."""
    n = len(bounds) - 1
    if not len(starts):
        return np.zeros(n), 0
    a = np.clip(np.searchsorted(bounds, starts, "right") - 1, 0, n - 1)
    b = np.clip(np.searchsorted(bounds, np.maximum(ends - 1, starts), "right") - 1, 0, n - 1)
    crossing = np.flatnonzero(a != b)
    if rule == "start":
        return np.bincount(a, minlength=n).astype(float), len(crossing)
    if rule == "end":
        return np.bincount(b, minlength=n).astype(float), len(crossing)
    out = np.bincount(a[a == b], minlength=n).astype(float)
    for i in crossing:
        spans = np.arange(a[i], b[i] + 1)
        chars = np.minimum(ends[i], bounds[spans + 1]) - np.maximum(starts[i], bounds[spans])
        if rule == "majority":
            out[spans[chars.argmax()]] += 1
        else:
            out[spans] += chars / chars.sum()
    return out, len(crossing)


def line_bounds(text: str) -> np.ndarray:
    """Where the lines of a text begin, and where it ends; a line has its line feed."""
    ends = [m.end() for m in re.finditer("\n", text)]
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    return np.array([0, *ends], np.int64)


SCHEMA = "doc_id long, n_chars long, n_tokens long, n_sections long, n_crossing long, section_tokens array<double>"


def _attributed(rows: DataFrame, fields: list[str], s: Settings) -> DataFrame:
    path = s.tokenizer or default_tokenizer()
    Spans(path)  # refused here, once

    def run(batches):
        spans = Spans(path, checked=True)
        for batch in batches:
            columns = [K.text_column(batch, f) for f in fields]
            sizes = sum(np.diff(K.string_buffers(c)[1]) for c in columns)
            ends, at = np.cumsum(sizes), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
                values = [c.slice(at, to - at).fill_null("").to_pylist() for c in columns]
                texts = ["\n".join(v) for v in zip(*values, strict=True)]
                offsets, _, first, end = spans.of(texts)
                n_tokens, crossing, shares = np.diff(offsets), [], []
                bounds = [line_bounds(t) for t in texts] if len(fields) == 1 else [np.concatenate(([0], np.cumsum([len(x) + (i < len(v) - 1) for i, x in enumerate(v)]))) for v in zip(*values, strict=True)]
                for i, b in enumerate(bounds):
                    share, n = allocate(first[offsets[i] : offsets[i + 1]], end[offsets[i] : offsets[i + 1]], b, s.rule)
                    shares.append(share)
                    crossing.append(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, to - at), pa.array(list(map(len, texts)), pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([len(b) - 1 for b in bounds], pa.int64()), pa.array(crossing, pa.int64()), pa.array(shares, pa.list_(pa.float64()))],
                    ["doc_id", "n_chars", "n_tokens", "n_sections", "n_crossing", "section_tokens"],
                )
                at = to

    return rows.mapInArrow(run, SCHEMA)


def by_section(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """For each row of docs the tokens of its whole text and of each of its lines, in order; section_tokens sums to
    n_tokens. A null or empty text has one empty section and no tokens. Repeated rows each get their row."""
    return _attributed(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), ["text"], s)


def by_field(docs: DataFrame, fields: list[str], s: Settings = Settings()) -> DataFrame:
    """As by_section, of two or more columns rendered as text with a line feed after each but the last, which counts
    as the column's before it. A null column is rendered empty."""
    if len(fields) < 2:
        raise ValueError("two fields at least")
    named = docs.select(F.col("doc_id").cast("long"), *(F.col(f).cast("string").alias(f"_field_{i}") for i, f in enumerate(fields)))
    return _attributed(named, [f"_field_{i}" for i in range(len(fields))], s)
