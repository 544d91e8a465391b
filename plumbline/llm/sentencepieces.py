"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read here field by field; its normaliser, space marker, scores and byte fallback are rebuilt
as a tokenizers model (unigram, or byte-pair merges derived from the scores). Texts are cut at markers where no piece
can reach across, and the distinct cuts of a batch are encoded together on several threads.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import kernel as K
from plumbline.llm.pieces import PieceCache, slices

MARK = "▁"
#: Fixed values of the model format: kinds of pieces and of models, and what an unknown piece decodes to.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_SURFACE = " ⁇ "


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"a field of wire type {kind} can't be read")
        yield number, value


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    unknown_surface: str = UNKNOWN_SURFACE

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls()
        for number, value in fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in fields(value):
                    piece, score, kind = (v.decode(), score, kind) if n == 1 else (piece, struct.unpack("<f", v)[0], kind) if n == 2 else (piece, score, v) if n == 3 else (piece, score, kind)
                m.pieces.append(piece)
                m.scores.append(score)
                m.kinds.append(kind)
            elif number == 2:
                for n, v in fields(value):
                    if n == 3:
                        m.type = v
                    elif n == 35:
                        m.byte_fallback = bool(v)
                    elif n == 24 and v:
                        raise ValueError("models that treat white space as a suffix aren't rebuilt")
                    elif n == 44:
                        m.unknown_surface = v.decode()
            elif number == 3:
                for n, v in fields(value):
                    if n == 2:
                        m.charsmap = v
                    elif n == 3:
                        m.dummy_prefix = bool(v)
                    elif n == 4:
                        m.squeeze = bool(v)
                    elif n == 5:
                        m.escape = bool(v)
            elif number == 5 and any(n == 2 and v for n, v in fields(value)):
                raise ValueError("models with a denormaliser aren't rebuilt")
        if m.type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models can be rebuilt")
        if USER_DEFINED in m.kinds:
            raise ValueError("pieces that the user defined are matched before all others; models with them aren't rebuilt")
        return m

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    def merges(self) -> list[tuple[str, str]]:
        """Merges in the order in which a byte-pair model of these scores applies them."""
        ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (NORMAL, USER_DEFINED)}
        found = []
        for p, i in ids.items():
            for cut in range(1, len(p)):
                if (a := ids.get(p[:cut])) is not None and (b := ids.get(p[cut:])) is not None:
                    found.append((-self.scores[i], i, a, b))
        found.sort()
        return [(self.pieces[a], self.pieces[b]) for _, _, a, b in found]

    def core(self):
        """The tokenizers model alone, for text that is normalised already."""
        from tokenizers import Tokenizer, models

        unknown = self.kinds.index(UNKNOWN)
        if self.type == UNIGRAM:
            if not self.escape:
                raise ValueError("unigram models that keep white space as it is aren't rebuilt")
            # only normal pieces may match: others keep their ids under names with a space, which no normalised text
            # has, and the score of unknown characters, which the library takes from the lowest, stays that of normal ones
            lowest = min((s for s, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL), default=0.0)
            named = [(p, s) if k == NORMAL else (f" {i}", lowest) for i, (p, s, k) in enumerate(zip(self.pieces, self.scores, self.kinds, strict=True))]
            return Tokenizer(models.Unigram(named, unknown, False))
        return Tokenizer(models.BPE({p: i for i, p in enumerate(self.pieces)}, self.merges(), unk_token=self.pieces[unknown], fuse_unk=True, byte_fallback=self.byte_fallback))

    def normaliser(self):
        """The model's character map as a tokenizers normaliser, or None where it maps nothing."""
        from tokenizers import normalizers

        return normalizers.Precompiled(self.charsmap) if self.charsmap else None

    def cuts(self) -> re.Pattern | None:
        """What cuts a normalised text so that no piece spans two parts; None where pieces may."""
        usable = [p for p, k in zip(self.pieces, self.kinds, strict=True) if k in (NORMAL, USER_DEFINED)]
        if any(MARK in p.lstrip(MARK) for p in usable):
            return None
        line = "" if any("\n" in p for p in usable) else "\n"
        return re.compile(f"{line}+|{MARK}*[^{MARK}{line}]+|{MARK}+" if line else f"{MARK}*[^{MARK}]+|{MARK}+")


class Codec:
    """Encodes and decodes whole texts by a model."""

    def __init__(self, model: Model):
        self.model, self.core, self.normal, self.pattern = model, model.core(), model.normaliser(), model.cuts()
        self.cache = PieceCache(self._encode)
        self.unknown = model.kinds.index(UNKNOWN)
        self.of_byte = {int(p[3:-1], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == BYTE}
        raw = [self._surface(i) for i in range(len(model.pieces))]
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def _encode(self, pieces: list[str]) -> list[list[list[int]]]:
        """Ids of each piece of text, by the library in batches. Bytes of what a unigram model doesn't know are put in
        here, as the library would look for their names in the text too."""
        out = []
        for some in slices(pieces):
            for piece, e in zip(some, self.core.encode_batch(some, add_special_tokens=False), strict=True):
                ids = e.ids
                if self.model.type == UNIGRAM and self.model.byte_fallback and self.unknown in ids:
                    ids = [x for i, (a, b) in zip(ids, e.offsets, strict=True) for x in ((self.of_byte[c] for c in piece[a:b].encode()) if i == self.unknown else (i,))]
                out.append(ids)
        return [out]

    def _surface(self, i: int) -> bytes:
        piece, kind = self.model.pieces[i], self.model.kinds[i]
        if kind == BYTE:
            return bytes([int(piece[3:-1], 16)])
        if kind == CONTROL:
            return b""
        return self.model.unknown_surface.encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def normalise(self, text: str) -> str:
        m = self.model
        if self.normal:
            text = self.normal.normalize_str(text)
        if m.squeeze:
            text = re.sub(" {2,}", " ", text.strip(" "))
        if not text:
            return ""
        text = " " + text if m.dummy_prefix else text
        text = text.replace(" ", MARK) if m.escape else text
        # the library strips the end after it has put markers for spaces, so that markers of the text go too
        return text.rstrip(MARK) if m.escape and m.squeeze else text

    def pieces(self, text: str) -> list[str]:
        text = self.normalise(text)
        return self.pattern.findall(text) if self.pattern else [text] if text else []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the tokens of each text."""
        parts = [self.pieces(t) if t else [] for t in texts]
        counts, of, (ids,) = self.cache.look_up([p for x in parts for p in x])
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        total = np.concatenate(([0], np.cumsum(counts)))
        return np.concatenate(([0], total[ends])) if len(parts) else np.zeros(1, np.int64), ids

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """The text of each run of ids. Bytes that aren't UTF-8 become U+FFFD."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes)):
            raise ValueError("an id isn't in the model")
        size = self.sizes[ids]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(self.begins[ids], size)
        data = self.bytes[at].tobytes()
        edge = np.concatenate(([0], ends))[offsets]
        out = [data[a:b].decode(errors="replace") for a, b in zip(edge[:-1], edge[1:], strict=True)]
        if not self.model.squeeze:
            return [t[1:] if self.model.dummy_prefix and t.startswith(" ") else t for t in out]
        return [t[self._leading(ids[a:b]) :] if t.startswith(" ") else t for t, a, b in zip(out, offsets[:-1], offsets[1:], strict=True)]

    def _leading(self, ids: np.ndarray) -> int:
        """Spaces that a model which strips them leaves out in front: one of each token up to the first with more."""
        n = 0
        for i in ids:
            if i == self.unknown:  # its text begins with a space of its own
                break
            raw = self.bytes[self.begins[i] : self.begins[i] + self.sizes[i]].tobytes()
            n += raw.startswith(b" ")
            if raw not in (b"", b" "):
                break
        return n


def _slices(n: int, sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    ends, at = np.cumsum(sizes), 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield at, to
        at = to


def encode(docs: DataFrame, model_path: str | None = None, threads: int = 2, text: str = "text", out: str = "ids", round_trip: str | None = None) -> DataFrame:
    """docs with a column of token ids. A null or empty text has none. threads: of the library, per task. round_trip:
    a further column that says whether the ids decode to the text, null counting as the empty text. Repeated rows each
    get theirs, and an empty table gives an empty one; columns of docs that have one of the new names give way."""
    docs = docs.drop(out, *([round_trip] if round_trip else []))
    sent = docs.sparkSession.sparkContext.broadcast(_read(model_path))

    def run(batches):
        import os

        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        codec = Codec(Model.parse(sent.value))
        for batch in batches:
            column = K.text_column(batch, text)
            sizes = np.diff(K.string_buffers(column)[1])
            for a, b in _slices(batch.num_rows, sizes, 1 << 20):
                texts = column.slice(a, b - a).to_pylist()
                offsets, ids = codec.encode(texts)
                more = {out: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))}
                if round_trip:
                    more[round_trip] = pa.array([x == (t or "") for x, t in zip(codec.decode(offsets, ids), texts, strict=True)])
                yield K.extended(batch.slice(a, b - a), [], more)

    return docs.withColumn(text, F.col(text).cast("string")).mapInArrow(run, K.schema_with(docs.withColumn(text, F.col(text).cast("string")), f"{out} array<int>" + (f", {round_trip} boolean" if round_trip else "")))


def decode(rows: DataFrame, model_path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with a column of the text that their token ids say; no ids, or null, say the empty text. An id that isn't in
    the model is an error. A column of rows that has the new name gives way; an empty table gives an empty one."""
    rows = rows.drop(out)
    sent = rows.sparkSession.sparkContext.broadcast(_read(model_path))

    def run(batches):
        codec = Codec(Model.parse(sent.value))
        for batch in batches:
            column = batch.column(ids)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in _slices(batch.num_rows, sizes, 1 << 19):
                part = column.slice(a, b - a)
                offsets = np.concatenate(([0], np.cumsum(sizes[a:b]))).astype(np.int64)
                yield K.extended(batch.slice(a, b - a), [], {out: pa.array(codec.decode(offsets, part.flatten().to_numpy(zero_copy_only=False)), pa.string())})

    return rows.mapInArrow(run, K.schema_with(rows, f"{out} string"))


def _read(path: str | None) -> bytes:
    with open(path or default_model(), "rb") as f:
        return f.read()


def digest(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, n_chars, n_tokens, ids_hash, round_trip) for each row: ids_hash is xxhash64 of the ids, round_trip
    whether they decode to the text. Null counts as the empty text. Repeated rows each get their row."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # decoded in the task that encodes: a second Python pass in one task would hold a second worker's memory
    both = encode(narrow, model_path, round_trip="round_trip")
    return both.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "round_trip")
