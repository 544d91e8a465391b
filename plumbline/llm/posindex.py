"""Distributed positional inverted index, and exact phrase and proximity search in it for benchmark decontamination.

The index is partitioned by document, as search engines partition theirs: a row is a segment, with the postings of
some thousand documents. Positions count the words of a segment's documents laid end to end with a gap between
documents, so that one sorted list of integers per term says both document and place, and no phrase crosses a gap.
Where one test set is asked for, only its terms are stored. It is taken in blocks of bounded size, one after the other;
for more than one block the index has all terms of the documents, and build() makes such an index to be kept for any
number of test sets. An item of more words than a block is in several, which share the words that a phrase across the
cut needs.

A phrase is looked up by intersecting its terms' lists, each shifted by the term's offset in the phrase, from the
rarest term of the segment on. All phrases of a block are intersected at once. For proximity the same lists are asked
for places near the rarest term's: a stretch of one document matches a phrase if it has all its terms, in any order
and with words between, within some times the phrase's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import kernel as K
from plumbline.llm.store import free_names, materialise, scratch_path

GAP = 1 << 10
#: Places of phrases' rarest terms that are taken up at a time; it bounds what a search holds, and changes no result.
CANDIDATES = 1 << 20


@dataclass(frozen=True)
class Settings:
    """window: words of a phrase taken from an item; a shorter item is one phrase. block_terms: words of test items
    in a block at most; it bounds what the driver holds and what is sent to executors. segment_bytes: text of a
    segment's documents, one document at least. reach: a proximity match is at most so many times a phrase's words
    long."""

    window: int = 10
    block_terms: int = 200_000
    segment_bytes: int = 4 << 20
    reach: int = 2


@dataclass
class Phrases:
    """Distinct phrases of a block: their terms, in order and padded, their lengths and the items that have each."""

    terms: np.ndarray
    lengths: np.ndarray
    items: list[list[str | None]]

    @property
    def vocabulary(self) -> np.ndarray:
        used = np.arange(self.terms.shape[1])[None, :] < self.lengths[:, None]
        return np.unique(self.terms[used])


def by_name(names) -> list[str | None]:
    """In order, None last."""
    return sorted(names, key=lambda x: (x is None, x or ""))


def phrases_of(items: list[tuple[str | None, np.ndarray]], window: int) -> Phrases:
    found: dict[bytes, set[str]] = {}
    for item, words in items:
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            found.setdefault(words[i : i + size].tobytes(), set()).add(item)
    lengths = np.array([len(k) // 8 for k in found], np.int64)
    terms = np.zeros((len(found), window), np.uint64)
    for row, k in enumerate(found):
        terms[row, : lengths[row]] = np.frombuffer(k, np.uint64)
    return Phrases(terms, lengths, [by_name(v) for v in found.values()])


def blocks_of(items: DataFrame, s: Settings) -> Iterator[list[tuple[str | None, np.ndarray]]]:
    """The test items' words in blocks of bounded size. Long items come in pieces that overlap by window - 1 words."""
    most, over = max(s.block_terms, s.window), s.window - 1

    def words(batches):
        for batch in batches:
            ids = batch.column("item_id").to_pylist()
            for first, _, text, offsets in K.chunks(K.text_column(batch)):
                hashes, at = K.word_hashes(text, offsets, K.ALNUM)
                for i in range(len(at) - 1):
                    own = hashes[at[i] : at[i + 1]]
                    pieces = [own[k : k + most].tobytes() for k in range(0, max(1, len(own) - over), max(1, most - over))] if len(own) else []
                    if pieces:
                        yield pa.RecordBatch.from_arrays([pa.array([ids[first + i]] * len(pieces), pa.string()), pa.array(pieces, pa.binary())], ["item_id", "words"])

    held, size = [], 0
    rows = materialise(items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(words, "item_id string, words binary"), "items")
    for row in rows.toLocalIterator():
        item = np.frombuffer(bytes(row["words"]), np.uint64)
        if held and size + len(item) > most:
            yield held
            held, size = [], 0
        held.append((row["item_id"], item))
        size += len(item)
    if held:
        yield held


SEGMENT = "rows binary, doc_ids binary, no_ids binary, begins binary, n_words binary, terms binary, lists binary, postings binary"


def build(docs: DataFrame, vocabulary: np.ndarray | None, s: Settings) -> DataFrame:
    """The index of docs for these terms, or for all that they have, one row per segment.

    rows: each document's row key, doc_ids: its id, begins and n_words: where its words begin and how many they are.
    terms: hashes of the terms that the segment has, sorted; lists: where the list of each begins in postings. A null
    doc_id is marked in no_ids; a null text has no words.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def index(batches):
        known = sent.value
        for batch in batches:
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            no_ids = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            for first, end, text, offsets in K.chunks(K.text_column(batch), s.segment_bytes):
                hashes, at = K.word_hashes(text, offsets, K.ALNUM)
                counts = np.diff(at)
                begins = at[:-1] + GAP * np.arange(len(counts))
                if known is None:
                    hit = np.arange(len(hashes))
                else:
                    place = np.searchsorted(known, hashes)
                    place[place == len(known)] = 0
                    hit = np.flatnonzero(known[place] == hashes) if len(known) else np.zeros(0, np.int64)
                doc = np.searchsorted(at, hit, "right") - 1
                term = hashes[hit]
                where = (hit + GAP * doc).astype(np.uint32 if len(hashes) + GAP * len(counts) < 1 << 32 else np.uint64)
                order = np.argsort(term, kind="stable")
                term, where = term[order], where[order]
                terms, lists = np.unique(term, return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes()], pa.binary()) for x in (rows[first:end].astype(np.int64), ids[first:end].astype(np.int64), no_ids[first:end], begins.astype(np.int64), counts.astype(np.int64), terms, np.append(lists, len(term)).astype(np.int64), where)],
                    ["rows", "doc_ids", "no_ids", "begins", "n_words", "terms", "lists", "postings"],
                )

    return docs.select("row", F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(index, SEGMENT)


class Segment:
    """One row of the index, for look-ups of the terms of a vocabulary, which go by their places in it."""

    def __init__(self, row: dict, vocabulary: np.ndarray):
        self.rows, self.ids, self.begins, self.n_words = (np.frombuffer(row[c], np.int64) for c in ("rows", "doc_ids", "begins", "n_words"))
        self.no_ids = np.frombuffer(row["no_ids"], np.uint8).astype(bool)
        hashes, lists = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["lists"], np.int64)
        total = int(lists[-1])
        postings = np.frombuffer(row["postings"], np.uint64 if total and len(row["postings"]) == 8 * total else np.uint32)
        terms = np.searchsorted(vocabulary, hashes)
        known = np.flatnonzero(vocabulary[np.minimum(terms, len(vocabulary) - 1)] == hashes) if len(vocabulary) else np.zeros(0, np.int64)
        terms, sizes = terms[known], np.diff(lists)[known]
        # the lists of these terms, end to end
        ends = np.cumsum(sizes)
        self.postings = postings if len(known) == len(hashes) else postings[np.arange(int(sizes.sum())) - np.repeat(ends - sizes, sizes) + np.repeat(lists[:-1][known], sizes)]
        self.df = np.zeros(len(vocabulary), np.int64)
        self.df[terms] = sizes
        self.begin = np.zeros(len(vocabulary), np.int64)
        self.begin[terms] = ends - sizes
        self.span = int(self.begins[-1] + self.n_words[-1] + GAP) if len(self.begins) else 1
        self.keys = np.repeat(terms.astype(np.int64), sizes) * self.span + self.postings.astype(np.int64)  # sorted: by term, then place

    def candidates(self, terms: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(phrases, their terms' order from the rarest on, phrase of each candidate, place of its rarest term) in slices
        of about CANDIDATES, one phrase's places at least. Phrases that lack a term here have none."""
        used = np.arange(terms.shape[1])[None, :] < lengths[:, None]
        df = np.where(used, self.df[terms], np.iinfo(np.int64).max) if len(self.df) else np.zeros(terms.shape, np.int64)
        alive = np.flatnonzero(df.min(axis=1, initial=np.iinfo(np.int64).max) > 0) if len(self.df) else np.zeros(0, np.int64)
        order = np.argsort(df[alive], axis=1, kind="stable")  # rarest first; padding last
        first = terms[alive, order[:, 0]]
        upto = np.cumsum(self.df[first])
        at = 0
        while at < len(alive):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CANDIDATES, "right")))
            many = self.df[first[at:to]]
            which = np.repeat(np.arange(to - at), many)
            within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield alive[at:to], order[at:to], which, self.postings[self.begin[first[at:to]][which] + within].astype(np.int64)
            at = to

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        want = term * self.span + place
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return (self.keys[at] == want) & (place >= 0) & (place < self.span) if len(self.keys) else np.zeros(len(want), bool)

    def phrases(self, terms: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All exact occurrences: (phrase, place of its first word). terms: places in the vocabulary."""
        found = [(np.zeros(0, np.int64),) * 2]
        for alive, order, which, place in self.candidates(terms, lengths):
            start = place - order[which, 0]
            for step in range(1, terms.shape[1]):
                if not len(which):
                    break
                more = lengths[alive[which]] > step
                offset = order[which, step]
                good = ~more | self.has(terms[alive[which], offset].astype(np.int64), start + offset)
                which, start = which[good], start[good]
            keep = start >= 0
            found.append((alive[which[keep]], start[keep]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Places that begin a stretch of span words within one document which has all terms, in any order.

        terms: distinct places in the vocabulary; a place is returned only if one of the terms stands there.
        """
        if not len(terms):
            return np.zeros(0, np.int64)
        return np.unique(self.stretches(np.asarray(terms)[None, :], np.array([len(terms)]), np.array([span]))[1])

    def following(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first place of each term from place on; self.span where there is none."""
        base = term * self.span
        at = np.searchsorted(self.keys, base + place)
        found = self.keys[np.minimum(at, len(self.keys) - 1)] - base
        return np.where((at < len(self.keys)) & (found < self.span), found, self.span)

    def stretches(self, terms: np.ndarray, lengths: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All proximity matches: (phrase, begin, end), for each place of one of a phrase's terms the shortest stretch
        from there that has all of them, if it is of at most reach words and within one document."""
        found = [(np.zeros(0, np.int64),) * 3]
        for part in self.candidates(terms, lengths):
            found += self._around(*part, terms, lengths, reach)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _around(self, alive, order, which, centre, terms, lengths, reach) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The stretches about candidates, those of one place of the rarest term each."""
        for step in range(1, terms.shape[1]):
            if not len(which):
                break
            phrase = alive[which]
            term = terms[phrase, order[which, step]].astype(np.int64)
            good = (lengths[phrase] <= step) | (self.following(term, np.maximum(centre - reach[phrase] + 1, 0)) < centre + reach[phrase])
            which, centre = which[good], centre[good]
        found = []
        back = np.arange(int(reach.max(initial=1)))
        slice_ = max(1, (1 << 20) // len(back))
        for a in range(0, len(which), slice_):
            phrase, place = alive[which[a : a + slice_]], centre[a : a + slice_]
            left = place[:, None] - back
            pairs = np.unique((phrase[:, None] * self.span + left)[(back < reach[phrase][:, None]) & (left >= 0)])
            phrase, left = pairs // self.span, pairs % self.span
            last, begins = left, np.zeros(len(left), bool)
            for step in range(terms.shape[1]):
                more = lengths[phrase] > step
                place = self.following(terms[phrase, step].astype(np.int64), left)
                last, begins = np.where(more, np.maximum(last, place), last), begins | more & (place == left)
            doc = self.document(left)
            good = begins & (last < np.minimum(left + reach[phrase], self.begins[doc] + self.n_words[doc]))
            found.append((phrase[good], left[good], last[good] + 1))
        return found

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, place, "right") - 1


HITS = "row long, doc_id long, n_words long, starts array<long>, ends array<long>, items array<string>"
NEAR = ", near_starts array<long>, near_ends array<long>, near_items array<string>"


def search(index: DataFrame, phrases: Phrases, reach: int = 0) -> DataFrame:
    """One row per document of the index: merged stretches of words [starts, ends) inside occurrences, and items; with
    reach, the same of proximity matches of at most so many times a phrase's words."""
    vocabulary = phrases.vocabulary
    sent = index.sparkSession.sparkContext.broadcast((np.searchsorted(vocabulary, phrases.terms).clip(max=max(0, len(vocabulary) - 1)), phrases.lengths, phrases.items, vocabulary))

    def look(batches):
        terms, lengths, items, vocabulary = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                g = Segment(row, vocabulary)
                which, start = g.phrases(terms, lengths)
                columns = by_document(g, which, start, start + lengths[which], items)
                if reach:
                    columns += by_document(g, *g.stretches(terms, lengths, reach * lengths), items)
                kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())] * (2 if reach else 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.rows), pa.array(g.ids, mask=g.no_ids), pa.array(g.n_words), *map(pa.array, columns, kinds)],
                    ["row", "doc_id", "n_words", "starts", "ends", "items", "near_starts", "near_ends", "near_items"][: 9 if reach else 6],
                )

    return index.mapInArrow(look, HITS + (NEAR if reach else ""))


def by_document(g: Segment, which: np.ndarray, start: np.ndarray, end: np.ndarray, items: list[list[str | None]]) -> list[list]:
    """[starts, ends, names]: for each document of g its merged stretches and the items of their phrases."""
    doc = g.document(start)
    order = np.lexsort((start, doc))
    which, start, end, doc = which[order], start[order], end[order], doc[order]
    bounds = np.searchsorted(doc, np.arange(len(g.rows) + 1))
    starts, ends, names = [], [], []
    for d in range(len(g.rows)):
        a, b = bounds[d], bounds[d + 1]
        if a == b:
            starts.append([]), ends.append([]), names.append([])
            continue
        s, e = merged(start[a:b] - g.begins[d], end[a:b] - g.begins[d])
        starts.append(s), ends.append(e), names.append(by_name({x for w in set(which[a:b].tolist()) for x in items[w]}))
    return [starts, ends, names]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """The union of intervals that are sorted by start."""
    out: list[list[int]] = []
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [s for s, _ in out], [e for _, e in out]


def found_in(keyed: DataFrame, items: DataFrame, s: Settings, proximity: bool) -> DataFrame:
    """For each row key of keyed (row, doc_id, text): n_words and what search() says over all blocks. keyed must give
    the same keys each time it is read. Blocks are searched one after the other; what one finds is written before the
    next is taken up. A single block's index has its terms alone; for more, one index of all terms is built, so that
    texts are read once however many blocks there are."""
    spark = keyed.sparkSession
    path, n = scratch_path(spark, "hits"), 0
    blocks = blocks_of(items, s)
    ahead = list(islice(blocks, 2))
    whole = materialise(build(keyed, None, s), "index") if len(ahead) > 1 else None
    for block in chain(ahead, blocks):
        phrases = phrases_of(block, s.window)
        index = whole if whole is not None else materialise(build(keyed, phrases.vocabulary, s), "index")
        part = search(index, phrases, s.reach if proximity else 0)
        # every row has its row in the first block's result, and in others' only where there is a match
        if n:
            part = part.where(" OR ".join(f"size({c}) > 0" for c in part.columns if c.endswith("items")))
        part.write.mode("append").parquet(path)
        n += 1
    if not n:
        none = phrases_of([], s.window)
        search(build(keyed, none.vocabulary, s), none, s.reach if proximity else 0).write.parquet(path)
    held = spark.read.parquet(path)
    return held.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in held.columns[3:]))


def keyed_rows(docs: DataFrame) -> DataFrame:
    """docs, written once with a key for each row in a column of a free name, the last."""
    (row,) = free_names(["row"], docs)
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")


def hits(docs: DataFrame, items: DataFrame, s: Settings = Settings(), proximity: bool = False) -> DataFrame:
    """One row for each row of docs: (doc_id, n_words, starts, ends, items): what search() says over all blocks; with
    proximity also (near_starts, near_ends, near_items).

    Words are runs of digits, lower-cased Latin letters and everything beyond ASCII. A null or empty text has no
    words; items without words are never found; those without id are found and counted as one item, a null in items;
    an empty table of items gives rows without hits, one of docs no rows. Repeated rows each get their own row, rows
    of one doc_id or without one included; other columns are ignored.
    """
    keyed = keyed_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return found_in(keyed.select(F.col(keyed.columns[-1]).alias("row"), "doc_id", "text"), items, s, proximity).drop("row")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of what hits() returns, and (n_near, n_near_items,
    near_items_sha256) where it has proximity matches, exact ones among them. Stretches of several blocks may overlap;
    a word counts once. Items without id count as one and are left out of the list that is hashed. contaminated is of exact matches only."""

    def of(prefix: str, n: str) -> list:
        stretches = F.array_sort(F.arrays_zip(F.col(f"{prefix}starts").alias("s"), F.col(f"{prefix}ends").alias("e")))
        none = F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n"))
        words = F.aggregate(stretches, none, lambda a, x: F.struct(F.greatest(a["to"], x["e"]).alias("to"), (a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(a["to"], x["s"]))).alias("n")), lambda a: a["n"])
        items = F.array_sort(F.array_distinct(f"{prefix}items"))
        return [words.alias(n), F.size(items).cast("long").alias(f"n_{prefix}items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias(f"{prefix}items_sha256")]

    near = of("near_", "n_near") if "near_items" in found.columns else []
    out = found.select("doc_id", "n_words", *of("", "n_hit"), *near)
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs without the rows whose text has any occurrence of a phrase of items. Each row goes or stays by its own text,
    whatever other rows have its doc_id; a null doc_id is like any other. The columns of docs, in which all other names
    are free; empty tables of either are fine."""
    keyed = keyed_rows(docs)
    row = keyed.columns[-1]
    found = found_in(keyed.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), items, s, False)
    # written first: its size is then known when the join is planned, which broadcasts it only if it is small
    gone = materialise(found.where(F.size("items") > 0).select(F.col("row").alias(row)), "contaminated")
    return keyed.join(gone, row, "left_anti").select(*docs.columns)
