"""Exact substring deduplication over suffix arrays: bytes that lie in a string of `length` bytes found elsewhere too.

Every string of `length` bytes (a window) has an anchor: the gram in it with the smallest hash, the rightmost of equal
ones. Equal windows have equal anchors at equal offsets, so that only contexts of the same anchor (the windows that
have it, in one piece of text) can hold windows that repeat. First the anchors' hashes are counted over the corpus;
most occur once and are done with. Contexts that are equal as a whole count as one with a multiplicity. What differs
but shares an anchor is cut out of the texts and dealt, by anchor, into shards of bounded size. A shard gets its suffix
array by Larsson-Sadakane refinement: suffixes sorted by their first bytes, and then only groups that are not yet apart
sorted by the ranks of what follows at twice the distance. Kasai's walk gives the common prefixes, many stretches of
the text at a time. Windows that share `length` bytes with a neighbour in the array repeat. An anchor with more contexts
than a shard holds lies in several, whose arrays are merged by binary search of one's windows in the other's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import kernel as K
from plumbline.llm.store import drop_scratch, materialise, scratch_mark

U64 = np.uint64
_ODD = U64(0x9FB21C651E98DF25)
_BASE = 0xC2B2AE3D27D4EB4F
#: Windows handled at a time; places in such a piece take PLACE bits of a key.
PIECE, PLACE = 1 << 17, 24


@dataclass(frozen=True)
class Settings:
    """length: bytes of a string that must be found elsewhere. gram: bytes of an anchor, 8 times a power of two and at
    most length. shard_bytes: text of a shard, one context at least. heavy: contexts of an anchor beyond which they
    are compared window by window, over all tasks, by 128-bit hashes."""

    length: int = 200
    gram: int = 64
    shard_bytes: int = 1 << 18
    heavy: int = 4096

    def __post_init__(self):
        if self.gram < 8 or self.gram & self.gram - 1 or self.gram > self.length:
            raise ValueError("gram must be 8 times a power of two, and no longer than length")


# ---- anchors and contexts ----


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    both = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(n, b, U64)
        x[0] = 1
        both.append(np.cumprod(x))
    return both[0], both[1]


def _eights(text: np.ndarray) -> np.ndarray:
    """A hash of the eight bytes at each place."""
    return K.mix(K._unaligned(text)[: len(text) - 7] * _ODD + U64(1))


def _grams(eights: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all grams, doubled up from those of eight bytes."""
    h, width = eights, 8
    while width < gram:
        h = K.mix(h[:-width] * _ODD + h[width:])
        width *= 2
    return h


def _least(grams: np.ndarray, span: int) -> np.ndarray:
    """The place of the smallest of each span grams in a row, the rightmost of equal ones."""
    low = U64((1 << PLACE) - 1)
    m, width = (grams | low) - np.arange(len(grams), dtype=U64), 1
    while 2 * width <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < span:
        m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
    return (low - (m & low)).astype(np.int64)


def contexts(text: np.ndarray, offsets: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, ...]]:
    """(text's number, first window's place in it, windows, anchor's hash, hash of the context) of each context, in
    runs. A context that goes over the end of a piece is cut in two, which share no window."""
    power, inverse = _powers(PIECE + s.length)
    last = offsets[1:] - s.length + 1  # of each text the first place without a window
    for begin in range(0, len(text) - s.length + 1, PIECE):
        part = text[begin : begin + PIECE + s.length - 1]
        eights = _eights(part)
        grams = _grams(eights, s.gram)
        at = _least(grams, s.length - s.gram + 1)
        cuts = [np.zeros(1, np.int64), np.flatnonzero(at[1:] != at[:-1]) + 1]
        for edges in (offsets, last):
            own = edges - begin
            cuts.append(own[(own > 0) & (own < len(at))])
        starts = np.unique(np.concatenate(cuts))
        sizes = np.diff(starts, append=len(at))
        of = np.searchsorted(offsets, starts + begin, "right") - 1
        good = starts + begin < last[of]
        starts, sizes, of = starts[good], sizes[good], of[good]
        total = np.concatenate((np.zeros(1, U64), np.cumsum(eights * power[: len(eights)])))
        whole = (total[starts + sizes + s.length - 8] - total[starts]) * inverse[starts]
        yield of, starts + begin - offsets[of], sizes, grams[at[starts]], K.mix(whole ^ K.mix(sizes.astype(U64)))


def _distinct(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """One row of each text of a batch, and how many have it."""
    keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in ("k1", "k2")], 1)
    _, first, times = np.unique(keys, axis=0, return_index=True, return_counts=True)
    order = np.argsort(first)
    return (batch if len(first) == len(batch) else batch.take(pa.array(first[order]))), times[order]


# ---- suffix arrays ----


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes, sorted. Larsson-Sadakane: a suffix's rank is the place of its group, and groups of one
    are never touched again. The order is complete, as common_prefixes() needs."""
    n = len(text)
    key = K._unaligned(text)[:n].byteswap()
    sa = np.argsort(key)
    if n < 2:
        return sa
    held = key[sa]
    new = np.ones(n, bool)
    new[1:] = held[1:] != held[:-1]
    rank = np.empty(n, np.int64)
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[sa] = heads
    h = 8
    while True:
        last = np.append(new[1:], True)
        todo = np.flatnonzero(~(new & last))
        if not len(todo):
            break
        # beyond the end were zeros, which are no bytes: of such suffixes the shorter comes first
        ahead = sa[todo] + h
        follow = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], n - 1 - ahead)
        both = heads[todo] * (n + h + 1) + follow + h
        order = np.argsort(both)
        both = both[order]
        sa[todo] = sa[todo[order]]
        fresh = np.ones(len(todo), bool)
        fresh[1:] = both[1:] != both[:-1]
        new[todo] = fresh
        heads[todo] = np.maximum.accumulate(np.where(fresh, todo, 0))
        rank[sa[todo]] = heads[todo]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, cap: int, stretch: int = 128) -> np.ndarray:
    """Of each suffix in the array the bytes, cap at most, that it has in common with the one before it. Kasai: going
    through the text, the next suffix has at most one byte less in common; stretches of the text are gone through side
    by side, eight bytes being compared at a time."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = K._unaligned(np.concatenate((text, np.zeros(cap, np.uint8))))
    plcp = np.zeros(n, np.int64)
    begins = np.arange(0, n, stretch)
    h = np.zeros(len(begins), np.int64)
    for step in range(min(stretch, n)):
        i = begins + step
        if i[-1] >= n:
            i = i[:-1]
        j = before[i]
        h = np.maximum(h[: len(i)] - 1, 0)
        most = np.minimum(cap, n - np.maximum(i, j))
        most[j < 0] = 0
        live = np.flatnonzero(h < most)
        while len(live):
            x = at[i[live] + h[live]] ^ at[j[live] + h[live]]
            same = np.bitwise_count((x & (~x + U64(1))) - U64(1)).astype(np.int64) >> 3
            h[live] += same
            live = live[(same == 8) & (h[live] < most[live])]
        h = np.minimum(h, most)
        plcp[i] = h
    return plcp[sa]


class Shard:
    """Contexts laid end to end with their suffix array: classes of equal windows, in order."""

    def __init__(self, text: np.ndarray, offsets: np.ndarray, length: int):
        self.text, self.offsets, self.length = text, offsets, length
        valid = np.ones(len(text) + 1, bool)
        valid[len(text)] = False
        for back in range(1, length):
            valid[np.maximum(offsets[1:] - back, offsets[:-1])] = False
        sa = suffix_array(text)
        shared = common_prefixes(text, sa, length)
        kept = valid[sa]
        self.starts = sa[kept]
        classes = np.cumsum(shared < length)[kept]
        new = np.diff(classes, prepend=-1) != 0
        self.of = np.cumsum(new) - 1
        #: A window of each class, in order, and whether another one equals it.
        self.firsts = self.starts[new]
        self.repeated = np.bincount(self.of, minlength=len(self.firsts)) > 1
        padded = np.concatenate((text, np.zeros(8, np.uint8)))
        self.words = K._unaligned(padded)

    def merge(self, other: Shard, mine: np.ndarray, theirs: np.ndarray) -> None:
        """Marks the classes, of those numbered mine and theirs, that both shards have: binary search of the other's
        windows among this one's."""
        low, high, queries = np.zeros(len(theirs), np.int64), np.full(len(theirs), len(mine)), other.firsts[theirs]
        live = np.flatnonzero(low < high)
        while len(live):
            middle = low[live] + high[live] >> 1
            sign = _compare(self, self.firsts[mine[middle]], other, queries[live])
            found = sign == 0
            self.repeated[mine[middle[found]]] = True
            other.repeated[theirs[live[found]]] = True
            low[live] = np.where(sign < 0, middle + 1, low[live])
            high[live] = np.where(sign > 0, middle, high[live])
            high[live[found]] = low[live[found]]
            live = live[low[live] < high[live]]

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, first window, last window) of runs of windows that repeat."""
        at = np.sort(self.starts[self.repeated[self.of]])
        piece = np.searchsorted(self.offsets, at, "right") - 1
        cut = np.ones(len(at), bool)
        cut[1:] = (at[1:] != at[:-1] + 1) | (piece[1:] != piece[:-1])
        begins = np.flatnonzero(cut)
        ends = np.append(begins[1:], len(at)) - 1
        return piece[begins], at[begins] - self.offsets[piece[begins]], at[ends[: len(begins)]] - self.offsets[piece[begins]]


def _compare(a: Shard, at_a: np.ndarray, b: Shard, at_b: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as a's window at each place comes before, equals or follows b's."""
    sign = np.zeros(len(at_a), np.int8)
    live = np.arange(len(at_a))
    for step in range(0, a.length, 8):
        x, y = a.words[at_a[live] + step].byteswap(), b.words[at_b[live] + step].byteswap()
        if step + 8 > a.length:
            drop = U64(8 * (step + 8 - a.length))
            x, y = x >> drop, y >> drop
        sign[live] = np.where(x < y, -1, np.where(x > y, 1, 0))
        live = live[x == y]
        if not len(live):
            break
    return sign


def repeats(anchor: np.ndarray, text: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first window, last window) of the windows that repeat among contexts, which are sorted by anchor; in
    shards of bounded size, those of one anchor merged with each other."""
    shard_of = np.zeros(len(anchor), np.int64)
    if len(anchor):
        shard_of = (offsets[1:] - 1) // s.shard_bytes
        shard_of = np.cumsum(np.diff(shard_of, prepend=shard_of[0]) != 0)
    cuts = [*np.flatnonzero(np.diff(shard_of, prepend=-1)), len(anchor)]
    shards = [Shard(text[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], s.length) for a, b in zip(cuts, cuts[1:], strict=False)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        # shards behind this one that go on with its last anchor
        for m in range(k + 1, len(shards)):
            if anchor[cuts[m]] != anchor[b - 1]:
                break
            both = [np.flatnonzero(anchor[cuts[x] + np.searchsorted(shards[x].offsets, shards[x].firsts, "right") - 1] == anchor[b - 1]) for x in (k, m)]
            shards[k].merge(shards[m], *both)
    found = [x.spans() for x in shards]
    empty = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(empty + [f[i] + (cuts[k] if i == 0 else 0) for k, f in enumerate(found)]) for i in range(3))


# ---- jobs ----


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, k1, k2): the keys are those of the text, alike for equal texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")})


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchors(rows: DataFrame, s: Settings) -> DataFrame:
    """(k1, k2, lo, windows, times, anchor, context) of every context; texts that a batch has several times are one row
    with a multiplicity."""

    def find(batches):
        for whole in batches:
            batch, times = _distinct(whole)
            column, keys = K.text_column(batch), [batch.column(k).to_numpy(zero_copy_only=False) for k in ("k1", "k2")]
            for at, _, text, offsets in K.chunks(column):
                for of, lo, sizes, anchor, context in contexts(text, offsets, s):
                    row = of + at
                    yield pa.RecordBatch.from_arrays([pa.array(keys[0][row]), pa.array(keys[1][row]), pa.array(lo.astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(times[row].astype(np.int32)), _signed(anchor), _signed(context)], ["k1", "k2", "lo", "windows", "times", "anchor", "context"])

    return rows.where(F.octet_length("text") >= s.length).select("k1", "k2", "text").mapInArrow(find, "k1 long, k2 long, lo int, windows int, times int, anchor long, context long")


def _cut_out(joined: DataFrame, s: Settings) -> DataFrame:
    """(anchor, context, heavy, body) of the contexts that rows (k1, k2, text, wanted) ask for."""

    def cut(batches):
        for whole in batches:
            batch, _ = _distinct(whole)
            for begin, end, text, offsets in K.chunks(K.text_column(batch), 1 << 22):
                wanted = batch.column("wanted").slice(begin, end - begin)
                many, parts = pa.compute.list_value_length(wanted).to_numpy(zero_copy_only=False).astype(np.int64), wanted.flatten()
                field = lambda name: parts.field(name).to_numpy(zero_copy_only=False)  # noqa: E731, B023
                size = field("windows").astype(np.int64) + s.length - 1
                at = np.repeat(offsets[:-1], many) + field("lo")
                for a in range(0, len(at), 4096):
                    few = slice(a, a + 4096)
                    bounds = np.concatenate(([0], np.cumsum(size[few])))
                    body = text[np.arange(bounds[-1]) - np.repeat(bounds[:-1], size[few]) + np.repeat(at[few], size[few])]
                    held = pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(body)])
                    yield pa.RecordBatch.from_arrays([pa.array(field("anchor")[few]), pa.array(field("context")[few]), pa.array(field("heavy")[few]), held], ["anchor", "context", "heavy", "body"])

    return joined.mapInArrow(cut, "anchor long, context long, heavy boolean, body binary")


MARKS = "anchor long, context long, first int, last int"


def _marks_by_shards(pieces: DataFrame, s: Settings) -> DataFrame:
    """MARKS of runs of repeating windows; pieces must be dealt and sorted by anchor and context."""

    def work(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).combine_chunks()
        anchor, context = (table.column(k).to_numpy() for k in ("anchor", "context"))
        # a text of which several tasks had a row gives its contexts several times
        once = np.ones(len(anchor), bool)
        once[1:] = (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])
        body = table.column("body") if once.all() else table.column("body").filter(pa.array(once))
        anchor, context = anchor[once], context[once]
        text, offsets = K.string_buffers(body)
        which, first, last = repeats(anchor, text[offsets[0] : offsets[-1]], offsets - offsets[0], s)
        return pa.RecordBatch.from_arrays([pa.array(anchor[which]), pa.array(context[which]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["anchor", "context", "first", "last"])

    def mark(batches):
        held, size, open_ = [], 0, None
        for batch in batches:
            anchor = batch.column("anchor").to_numpy()
            heads = np.flatnonzero(np.diff(anchor, prepend=anchor[:1]) != 0)
            if held and anchor[0] != open_:
                heads = np.concatenate(([0], heads))
            begin = 0
            for head in heads:
                few = batch.slice(begin, head - begin)
                if head > begin:
                    held.append(few)
                    size += few.nbytes
                if size >= s.shard_bytes:
                    yield work(held)
                    held, size = [], 0
                begin = head
            rest = batch.slice(begin)
            held.append(rest)
            size += rest.nbytes
            open_ = anchor[-1]
        if held:
            yield work(held)

    return pieces.mapInArrow(mark, MARKS)


def _marks_by_window(pieces: DataFrame, s: Settings) -> DataFrame:
    """MARKS for anchors of very many contexts: each window by two 64-bit hashes, counted over all tasks."""

    def windows(batches):
        for batch in batches:
            anchor, context = (batch.column(k).to_numpy() for k in ("anchor", "context"))
            for begin, end, text, offsets in K.chunks(batch.column("body"), 1 << 18):
                sizes = np.diff(offsets) - s.length + 1
                of = np.repeat(np.arange(len(sizes)), sizes)
                at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                place, eights = offsets[of] + at, _eights(text)
                out = []
                for base in (_BASE, int(_ODD)):
                    h = np.zeros(len(place), U64)
                    for step in [*range(0, s.length - 8, 8), s.length - 8]:
                        h = K.mix(h * U64(base) + eights[place + step])
                    out.append(h)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[begin:end][of]), pa.array(context[begin:end][of]), pa.array(at.astype(np.int32)), *map(_signed, out)], ["anchor", "context", "first", "h1", "h2"])

    each = materialise(pieces.mapInArrow(windows, "anchor long, context long, first int, h1 long, h2 long").distinct(), "windows")
    often = materialise(each.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "windows-often")
    return each.join(often, ["h1", "h2"]).select("anchor", "context", "first", F.col("first").alias("last"))


def spans(rows: DataFrame, s: Settings) -> DataFrame:
    """(k1, k2, spans) of the texts of rows (k1, k2, text) in which something repeats: spans are (begin, end) in bytes,
    which may overlap or touch."""
    mark = scratch_mark()
    anchors = materialise(_anchors(rows, s), "anchors")
    often = materialise(anchors.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor"), "anchors-often")
    shared = materialise(anchors.join(often, "anchor"), "anchors-shared")
    drop_scratch(rows.sparkSession, mark, mark + 2)
    found = materialise(shared.groupBy("anchor", "context").agg(F.sum("times").alias("n"), F.max("windows").alias("windows"), F.min(F.struct("k1", "k2", "lo")).alias("at")), "contexts")
    crowd = materialise(found.groupBy("anchor").agg(F.count("*").alias("many")).where("many > 1"), "contexts-of-anchor")
    contested = found.join(crowd, "anchor").select("at.k1", "at.k2", F.struct("anchor", "context", F.col("at.lo").alias("lo"), "windows", (F.col("many") > s.heavy).alias("heavy")).alias("x"))
    wanted = materialise(contested.groupBy("k1", "k2").agg(F.collect_list("x").alias("wanted")), "contexts-wanted")
    pieces = materialise(_cut_out(rows.select("k1", "k2", "text").join(wanted, ["k1", "k2"]), s), "contexts-text")
    by_shards = _marks_by_shards(pieces.where("NOT heavy").select("anchor", "context", "body").repartition("anchor").sortWithinPartitions("anchor", "context"), s)
    by_window = _marks_by_window(pieces.where("heavy").select("anchor", "context", "body"), s)
    whole = found.where("n > 1").select("anchor", "context", F.lit(0).alias("first"), (F.col("windows") - 1).alias("last"))
    # a context that occurs several times repeats as a whole, and further runs in it add nothing
    marks = materialise(whole.unionByName(by_shards).unionByName(by_window), "marks")
    span = F.struct((F.col("lo") + F.col("first")).alias("begin"), (F.col("lo") + F.col("last") + s.length).alias("end"))
    return materialise(shared.join(marks, ["anchor", "context"]).groupBy("k1", "k2").agg(F.collect_set(span).alias("spans")), "spans")


def remove(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, removed, kept) for each row of docs: kept is the UTF-8 text, as binary,
    without each byte that lies in a string of s.length bytes which also begins anywhere else, in the same text or
    another; removed has the maximal runs (begin, end) taken away. Strings are judged on the input.

    A null text is empty. Equal texts repeat each other, rows of one doc_id included, and all their bytes go if there
    are s.length of them. Shorter texts stay. Other columns are ignored. An empty table gives an empty result.
    Equal anchors, contexts and texts are told by 64-bit hashes, each inside a group that another hash has made.
    """
    rows = _keyed(docs)
    found = spans(rows, s)

    def cut(batches):
        for whole in batches:
            for begin, end, text, offsets in K.chunks(K.text_column(whole)):
                batch = whole.slice(begin, end - begin)
                lists = batch.column("spans")
                some = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                removed, kept = [], []
                for i, many in enumerate(some):
                    own, runs, parts, at = text[offsets[i] : offsets[i + 1]], [], [], 0
                    if many:
                        values = lists[i].values
                        a, b = (values.field(k).to_numpy(zero_copy_only=False) for k in ("begin", "end"))
                        order = np.argsort(a, kind="stable")
                        a, b = a[order], np.maximum.accumulate(b[order])
                        head = np.ones(len(a), bool)
                        head[1:] = a[1:] > b[:-1]
                        heads = np.flatnonzero(head)
                        runs = list(zip(a[heads].tolist(), b[np.append(heads[1:], len(a)) - 1].tolist(), strict=True))
                    for a, b in runs:
                        parts.append(own[at:a])
                        at = b
                    removed.append([{"begin": a, "end": b} for a, b in runs])
                    kept.append(b"".join([x.tobytes() for x in (*parts, own[at:])]))
                gone = np.array([sum(r["end"] - r["begin"] for r in x) for x in removed], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(gone), pa.array(np.array([len(x) for x in removed], np.int64)), pa.array(removed, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept"])

    joined = rows.join(found, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, removed array<struct<begin: int, end: int>>, kept binary")


def digest(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): remove() with a hash of what is kept."""
    return remove(docs, s).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
