"""b-bit MinHash near-duplicate detection.

Each text's set of word shingles gets a signature: the minima of many hash functions, of which only the low bits are
kept and packed. Bands of whole minima give candidates; the similarity of candidates is first estimated from the
packed bits, corrected for the chance that unequal minima agree in their low bits; what can reach the threshold is
confirmed on the full sets. Links then become components.

A bucket's members aren't paired with each other. Equal sets are one class. In a bucket every class is compared with
the smallest; the classes so linked are one component, and only members of different components are compared
further, first by packed bits, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import kernel as K
from plumbline.llm.components import connected_components
from plumbline.llm.store import free_names, materialise


@dataclass(frozen=True)
class Settings:
    """permutations = bands * rows. A pair at the threshold meets in no band with probability (1 - t**rows)**bands:
    5e-8 for 32 bands of 4 at 0.8. slack: standard deviations below the threshold at which an estimate rejects."""

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    bits: int = 8
    slack: float = 5.0
    seed: int = 7
    block: int = 512

    @property
    def permutations(self) -> int:
        return self.bands * self.rows

    @property
    def least_matches(self) -> int:
        """Equal packed values that a candidate needs at least. Chance agreement is 2**-bits."""
        chance = 2.0**-self.bits
        agree = chance + (1 - chance) * self.percent / 100
        return max(0, int(np.floor(self.permutations * agree - self.slack * np.sqrt(self.permutations * agree * (1 - agree)))))


def estimate(matches: np.ndarray, s: Settings) -> np.ndarray:
    """Similarity from the number of equal packed values, corrected for chance agreement."""
    chance = 2.0**-s.bits
    return np.clip((matches / s.permutations - chance) / (1 - chance), 0, 1)


class Signer:
    def __init__(self, s: Settings):
        if s.bits not in (1, 2, 4, 8):
            raise ValueError("bits must be 1, 2, 4 or 8")
        r = np.random.default_rng(s.seed)
        self.s = s
        self.a = r.integers(0, 1 << 63, s.permutations, dtype=np.uint64) * K.U64(2) + K.U64(1)
        self.b = r.integers(0, 1 << 63, s.permutations, dtype=np.uint64)
        self.mask = r.integers(0, 1 << 63, s.bands, dtype=np.uint64) * K.U64(2) + K.U64(1)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(self.s.permutations, 0xFFFFFFFF, np.uint64)
        for at in range(0, len(shingles), 1024):
            x = shingles[at : at + 1024]
            h = np.multiply.outer(self.a, x)
            h += self.b[:, None]
            h >>= K.U64(32)
            np.minimum(out, h.min(axis=1), out=out)
        return out

    def bands(self, minima: np.ndarray) -> np.ndarray:
        rows = minima.reshape(self.s.bands, self.s.rows)
        h = self.mask.copy()
        for i in range(self.s.rows):
            h = K.mix(h * K.U64(0x9FB21C651E98DF25) + rows[:, i])
        return h.view(np.int64)

    def pack(self, minima: np.ndarray) -> bytes:
        """The low bits of each minimum, in order, packed from the high end of each byte."""
        low = (minima & K.U64((1 << self.s.bits) - 1)).astype(np.uint8)
        per = 8 // self.s.bits
        low = low.reshape(-1, per)
        return reduce(lambda x, y: x << self.s.bits | y, (low[:, i] for i in range(per))).astype(np.uint8).tobytes()


def unpack(packed: np.ndarray, bits: int) -> np.ndarray:
    """Rows of packed bytes to rows of values."""
    if bits == 8:
        return packed
    parts = [(packed >> shift) & ((1 << bits) - 1) for shift in range(8 - bits, -1, -bits)]
    return np.stack(parts, axis=-1).reshape(len(packed), -1)


def sets_of(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    for _, _, text, offsets in K.chunks(column):
        hashes, at = K.word_hashes(text, offsets, K.BY_SPACE)
        for i in range(len(at) - 1):
            yield K.shingle_set(hashes[at[i] : at[i + 1]], words)


def signatures(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, bands, packed, tags): d1 and d2 are a digest of the set, tags the low 32 bits of each
    band's key. Empty sets have no bands."""

    def sign(batches):
        signer = Signer(s)
        for batch in batches:
            n, d1, d2, bands, packed, tags = [], [], [], [], [], []
            for x in sets_of(K.text_column(batch), s.words):
                n.append(len(x))
                with np.errstate(over="ignore"):
                    d1.append(int(x.sum(dtype=np.uint64).view(np.int64)) if len(x) else 0)
                    d2.append(int(np.bitwise_xor.reduce(K.mix(x + K.U64(1))).view(np.int64)) if len(x) else 0)
                minima = signer.minima(x) if len(x) else None
                bands.append(signer.bands(minima) if len(x) else np.zeros(0, np.int64))
                packed.append(signer.pack(minima) if len(x) else b"")
                tags.append(bands[-1].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(packed, pa.binary()), pa.array(tags, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "bands", "packed", "tags"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, packed binary, tags binary")


def matches_with(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Equal values between a signature and each of many."""
    return (many == one).sum(axis=1)


class Joined:
    """Components joined within a task, so that what is connected already isn't compared again."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.root(x)] = self.root(y)


ASKS = "task long, part int, id long, component long, anchors array<long>, components array<long>"


def may_reach(a: bytes | None, b: bytes | None, s: Settings) -> bool:
    """Whether the similarity estimated from two packed signatures, corrected for collisions, isn't so far below the
    threshold that the pair can be let go. Without a signature it may be anything."""
    if a is None or b is None:
        return True
    x, y = (unpack(np.frombuffer(p, np.uint8).reshape(1, -1), s.bits) for p in (a, b))
    return bool(estimate(matches_with(x, y), s)[0] >= estimate(np.array(s.least_matches), s))


def verified(asks: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) that full sets confirm, 100 * intersection >= percent * union, enough of them to connect all that
    the asked pairs connect.

    A row of asks is a task's anchor (part 0), of which it has s.block at most, or one of its members (part 1) with
    the anchors it is to be compared with and the component that each is known to be in. Members are streamed past,
    and only the anchors' sets are held. A pair is first estimated from the packed bits of both, and sets are made only
    of members with an anchor that the estimate leaves. A pair whose components the task has joined is skipped.

    texts: (doc_id, text, packed), packed null where a doc_id has several signatures.
    """
    asks = materialise(asks, "asks")
    rows = asks.join(texts.withColumnRenamed("doc_id", "id"), "id").repartition("task").sortWithinPartitions("task", "part")

    def confirm(batches):
        at, held, joined = None, {}, Joined()
        now, packs = None, {}
        for batch in batches:
            task, part, ids, comps = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("task", "part", "id", "component"))
            anchors, their, packed = (batch.column(c).to_pylist() for c in ("anchors", "components", "packed"))
            wanted = []
            for i in range(batch.num_rows):
                if task[i] != now:
                    now, packs = task[i], {}
                if part[i] == 0:
                    packs[int(ids[i])] = packed[i]
                    wanted.append(i)
                    continue
                left = [(a, c) for a, c in zip(anchors[i], their[i], strict=True) if may_reach(packed[i], packs.get(a), s)]
                if left:
                    anchors[i], their[i] = zip(*left, strict=True)
                    wanted.append(i)
            out_a, out_b = [], []
            for i, x in zip(wanted, sets_of(K.text_column(batch).take(pa.array(wanted, pa.int64())), s.words), strict=True):
                if task[i] != at:
                    at, held, joined = task[i], {}, Joined()
                if part[i] == 0:
                    held.setdefault(int(ids[i]), []).append(x)
                    continue
                for anchor, component in zip(anchors[i], their[i], strict=True):
                    if joined.root(component) == joined.root(int(comps[i])):
                        continue
                    for y in held.get(anchor, ()):
                        if s.percent * max(len(x), len(y)) > 100 * min(len(x), len(y)):
                            continue
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        if both and 100 * both >= s.percent * (len(x) + len(y) - both):
                            out_a.append(int(ids[i]))
                            out_b.append(anchor)
                            joined.join(component, int(comps[i]))
                            break
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(confirm, "a long, b long")


def to_centres(members: DataFrame, s: Settings) -> DataFrame:
    """Asks of every member of a bucket about the bucket's centre, once for each centre; a task has one centre and
    some thousand members, so that a centre with many is several tasks' work."""
    pairs = members.where("id <> centre").select("id", "centre").distinct()
    salted = pairs.join(pairs.groupBy("centre").agg(F.ceil(F.count("*") / (4 * s.block)).alias("salts")), "centre")
    salted = salted.select(F.xxhash64("centre", F.pmod(F.xxhash64("id"), "salts")).alias("task"), "id", "centre")
    asks = salted.select("task", F.lit(1).alias("part"), "id", F.col("id").alias("component"), F.array("centre").alias("anchors"), F.array("centre").alias("components"))
    none = F.array().cast("array<long>")
    return asks.unionAll(salted.select("task", F.lit(0), F.col("centre"), F.col("centre"), none, none).distinct())


def across(members: DataFrame, s: Settings) -> DataFrame:
    """Asks about pairs of different components that share a bucket and whose packed bits can reach the threshold.

    members: (band, key, id, component, packed, tags), tags being 32 bits of each band's key. In each bucket the
    members of the largest component are streamed past those of all others, which are split into blocks that a task
    holds. A pair that meets in several bands is asked about in the first of them.
    """
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("total"), F.max("n").alias("most"), F.count("*").alias("parts")).where("parts > 1")
    rows = members.join(main, "key").withColumn("blocks", F.ceil((F.col("total") - F.col("most")) / s.block)).withColumn("salts", F.ceil(F.col("total") / (4 * s.block)))
    held = ["band", "id", "component", "packed", "tags"]
    as_anchor = rows.where("component <> main").select("key", F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("part"), *held)
    streamed = rows.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id", F.lit(1)), "salts").alias("salt"), F.when(F.col("component") == F.col("main"), 1).otherwise(2).alias("part"), *held)
    dealt = as_anchor.unionByName(streamed).select(F.xxhash64("key", "block", "salt").alias("task"), "part", *held).repartition("task").sortWithinPartitions("task", "part")
    least = s.least_matches

    def compare(batches):
        at, held, ids, asked = None, [], None, set()
        comps = sigs = tags = None
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * 2

        def rows(columns):
            return pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(columns, kinds, strict=True)], ["task", "part", "id", "component", "anchors", "components"])

        def anchors_asked():
            found = [[at, 0, int(ids[k]), int(comps[k]), [], []] for k in sorted(asked)]
            asked.clear()
            return rows(list(zip(*found, strict=True)))

        for batch in batches:
            task, part, band, own, component = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("task", "part", "band", "id", "component"))
            packed, tagged = batch.column("packed").to_pylist(), batch.column("tags").to_pylist()
            out: list[list] = [[] for _ in range(6)]
            for i in range(batch.num_rows):
                if task[i] != at:
                    if asked:
                        yield anchors_asked()
                    at, held, ids = int(task[i]), [], None
                if part[i] == 0:
                    held.append((own[i], component[i], packed[i], tagged[i]))
                    continue
                if not held:
                    continue
                if ids is None:
                    ids, comps = (np.array([h[k] for h in held], np.int64) for k in (0, 1))
                    sigs = unpack(np.frombuffer(b"".join(h[2] for h in held), np.uint8).reshape(len(held), -1), s.bits)
                    tags = np.frombuffer(b"".join(h[3] for h in held), np.uint32).reshape(len(held), -1)
                mine = comps != component[i]
                if part[i] == 2:  # an anchor itself: of the two rows that see the pair one asks
                    mine &= ids < own[i]
                equal = matches_with(unpack(np.frombuffer(packed[i], np.uint8).reshape(1, -1), s.bits), sigs)
                near = np.flatnonzero(mine & (equal >= least))
                if len(near):
                    first = (tags[near] == np.frombuffer(tagged[i], np.uint32)).argmax(axis=1)
                    near = near[first == band[i]]
                if len(near):
                    near = near[np.argsort(-equal[near], kind="stable")]
                    asked.update(near.tolist())
                    for o, v in zip(out, (task[i], 1, own[i], component[i], ids[near], comps[near]), strict=True):
                        o.append(v)
            if out[0]:
                yield rows(out)
        if asked:
            yield anchors_asked()

    return dealt.mapInArrow(compare, ASKS)


#: What tells a set of shingles: its size and two digests.
SET = ["n_shingles", "d1", "d2"]


def equal_sets(rows: DataFrame, total: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, first) of documents whose set another document of a smaller doc_id has: first is
    one of those, and by way of firsts all come to the smallest.

    A set that a great part of all documents have is dealt over about sqrt(total) groups, each with a smallest of its
    own; of those the smallest is then found. So no task sees more than about sqrt(total) rows of one set.
    """
    groups = max(1, math.isqrt(total))
    dealt = rows.distinct().withColumn("_group", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    within = dealt.withColumn("_least", F.min("doc_id").over(Window.partitionBy(*SET, "_group")))
    held = materialise(within.drop("_group"), "sets")
    heads = held.where("doc_id = _least").drop("_least").withColumn("first", F.min("doc_id").over(Window.partitionBy(*SET)))
    others = held.where("doc_id <> _least").withColumnRenamed("_least", "first")
    return others.unionByName(heads.where("doc_id <> first"))


def components(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row for each row of docs: (doc_id, n_shingles, component_id, kept).

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the smallest
    doc_id that can be reached, and kept marks it. Null and empty texts have no shingles and are linked with nothing;
    equal texts are linked. Rows that share a doc_id are one node. A null doc_id stays alone: its component_id is
    null and it is kept. Other columns are ignored; an empty table gives an empty result.
    """
    signed = materialise(signatures(docs, s), "signatures")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    copies = materialise(equal_sets(full.select("doc_id", *SET), signed.count()), "copied")
    copied = copies.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    # a doc_id with several texts loses only those that are copies
    reps = full.join(copies.drop("first"), ["doc_id", *SET], "left_anti")

    banded = reps.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre < last").select("key", "centre")
    members = materialise(banded.join(shared, "key"), "members")
    sigs = full.select(F.col("doc_id").alias("id"), "n_shingles", "d1", "d2", "packed", "tags").dropDuplicates(["id", "n_shingles", "d1", "d2"]).select("id", "packed", "tags")
    alone = sigs.join(members.select("id").distinct(), "id").groupBy("id").agg(F.when(F.count("*") == 1, F.min("packed")).alias("packed"))
    texts = materialise(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(alone.withColumnRenamed("id", "doc_id"), "doc_id"), "texts")

    links = materialise(copied.union(verified(to_centres(members, s), texts, s)), "links")
    found = connected_components(links)
    labelled = members.select("band", "key", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select("band", "key", "id", F.coalesce("component", "id").alias("component"))
    labelled = materialise(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    more = verified(across(labelled.join(mixed, "key").distinct().join(sigs, "id"), s), texts, s)
    # components of components: what was found is one node each
    ends = [found.withColumnRenamed("node", c).withColumnRenamed("component", f"of_{c}") for c in ("a", "b")]
    more = more.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).distinct()
    merged = connected_components(more).select(F.col("node").alias("was"), F.col("component").alias("now"))
    return (
        signed.select("doc_id", "n_shingles")
        .join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("was"))
        .join(merged, "was", "left")
        .select("doc_id", "n_shingles", F.coalesce("now", "was").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def deduplicate(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row of each component, that of the smallest doc_id, a null one last. Each row is a node of its own here, so
    that rows of one doc_id or without one go if their texts are alike and stay if not. The columns of docs, in which
    all other names are free."""
    (row,) = free_names(["row"], docs)
    keyed = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    found = components(keyed.select(F.col(row).alias("doc_id"), "text"), s).select(F.col("doc_id").alias(row), "component_id")
    # only groups of two or more are looked at; most rows are alone
    alike = materialise(found.where(F.col(row) != F.col("component_id")).select(row, "component_id"), "alike")
    alike = alike.unionByName(alike.select(F.col("component_id").alias(row), "component_id").distinct())
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col(row).alias("row"))
    grouped = alike.join(keyed.select(row, "doc_id"), row)
    first = grouped.groupBy("component_id").agg(F.min(order).getField("row").alias(row))
    gone = materialise(alike.select(row).join(first.select(row), row, "left_anti"), "gone")
    return keyed.join(gone, row, "left_anti").select(*docs.columns)
