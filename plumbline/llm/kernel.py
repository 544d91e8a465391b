"""Vectorised text kernels over Arrow string columns: word hashes, shingles, and chunked reading.

Texts are read as the bytes of an Arrow buffer. Words are hashed eight bytes at a time, all words of a chunk at once,
so no Python object is made per word; only words of more than LONG_WORD bytes are hashed one by one. Chunks bound the
memory that a batch needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20
#: Words of more bytes are hashed by blake2b.
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def class_table(separators: list[tuple[int, int]]) -> np.ndarray:
    """256 booleans: whether a byte belongs to a word."""
    table = np.ones(256, bool)
    for low, high in separators:
        table[low : high + 1] = False
    return table


#: Words [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after A-Z are lower-cased), as bytes of UTF-8.
BY_SPACE = class_table([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = class_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, where, data = column.buffers()
    if where is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    text = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return text, offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts of about limit bytes, one text at least."""
    text, offsets = string_buffers(column)
    n, at = len(column), 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, text[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_bounds(text: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; a word never spans two texts. word: a boolean for each byte."""
    n = len(text)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    if n:
        before[0], before[1:] = False, word[:-1]
        after[-1], after[:-1] = False, word[1:]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends


def _unaligned(text: np.ndarray) -> np.ndarray:
    """For each byte the 64-bit number of it and the next seven, zeros beyond the end."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    return np.ndarray((len(text) + 1,), "<u8", padded, 0, (1,))


_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def _hashed(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two mixes of a word's blocks of eight bytes run side by side and are joined at the end, so that blocks can't be
    solved for that make two words agree."""
    at = _unaligned(text)
    a = mix(sizes.astype(U64) + U64(0x9E3779B97F4A7C15))
    b = mix(sizes.astype(U64) + U64(0xD6E8FEB86659FD93))
    live = np.arange(len(starts))
    for begin in range(0, int(sizes.max(initial=0)), 8):
        if begin:
            live = np.flatnonzero(sizes > begin)
        block = at[starts[live] + begin] & _KEEP[np.minimum(sizes[live] - begin, 8)]
        a[live] = mix(a[live] * U64(0x9FB21C651E98DF25) + block)
        b[live] = mix((b[live] ^ block) * U64(0xC2B2AE3D27D4EB4F))
    return mix(a ^ (b << U64(29) | b >> U64(35)))


def word_hashes(text: np.ndarray, offsets: np.ndarray, classes: np.ndarray, segment: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z lower-cased, and the offsets of each text's words. segment: words hashed at a
    time."""
    text = LOWER[text]
    starts, ends = word_bounds(text, offsets, classes[text])
    sizes = ends - starts
    out = np.empty(len(starts), U64)
    for i in range(0, len(starts), segment):
        few = slice(i, i + segment)
        out[few] = _hashed(text, starts[few], np.where(sizes[few] > LONG_WORD, 0, sizes[few]))
    for i in np.flatnonzero(sizes > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(text[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out, np.searchsorted(starts, offsets).astype(np.int64)


def gram_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams of k bytes, 8 at most, that lie inside words, and each gram's place in text."""
    n = len(text)
    if n < k:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    inside = np.zeros(n + 1, np.int32)
    long = ends - starts >= k
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - k + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:n]) > 0)
    return mix((_unaligned(text)[at] & _KEEP[k]) * U64(0x9FB21C651E98DF25) + U64(k)), at


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of runs of k words; of fewer words, the whole sequence as one; of none, nothing."""
    n = len(words)
    if not n:
        return words
    take = min(k, n)
    h = np.full(n - take + 1, take * 0x2545F4914F6CDD1D & (1 << 64) - 1, U64)
    for i in range(take):
        h = mix(h * U64(0x9FB21C651E98DF25) + words[i : n - take + 1 + i])
    return np.unique(h)


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    column = batch.column(name)
    return column.cast(pa.string()) if pa.types.is_null(column.type) else column


def schema_with(docs, fields: str):
    """The schema of docs and further fields."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    return StructType([*docs.schema.fields, *_parse_datatype_string(fields).fields])


def extended(batch: pa.RecordBatch, without: list[str], columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """A batch without some columns and with others after the rest."""
    kept = [i for i, name in enumerate(batch.schema.names) if name not in without]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *columns.values()], [*(batch.schema.names[i] for i in kept), *columns])
