"""Winnowing fingerprints, in DataFrame functions alone.

A text's tokens are hashed; every k tokens in a row make a gram, whose hash is the polynomial of its tokens' hashes
that a rolling hash gives; as k is small each is worked out by itself, so that no step waits for the one before. Of
every w grams in a row the one with the smallest hash is chosen, the rightmost of equal ones. Any w + k - 1 tokens in
a row that two texts share give both a chosen gram in common, whose positions are kept. In runs without white space of
more than token_chars characters the tokens are characters, so that what is shared is found wherever the runs begin.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """k tokens of a gram and w grams of a window: what two texts share of k + w - 1 tokens in a row is found. Tokens
    are words of at most token_chars characters, lower-cased; of longer ones, and of scripts without spaces, each
    character is one. rows_per_bucket: rows that a task pairs with their next ones, up to most_buckets of them; beyond,
    buckets grow and are sorted by Spark, which spills."""

    k: int = 3
    w: int = 4
    token_chars: int = 12
    rows_per_bucket: int = 4000
    most_buckets: int = 32_768


#: Both are primes below 2**31; products of a residue and the base stay within a long.
PRIME = 2147483647
BASE = 1000003

_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"


def token_hashes(text: Column, s: Settings) -> Column:
    spaced = rf"[^\s{_UNSPACED}]"
    pattern = rf"(?<!{spaced}){spaced}{{1,{s.token_chars}}}(?!{spaced})|\S"
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)), lambda t: F.pmod(F.xxhash64(t), F.lit(PRIME)))


def _at(array: Column, i: Column, step: int) -> Column:
    return F.get(array, i + step)


def gram_hashes(tokens: Column, s: Settings) -> Column:
    """Hashes of k tokens in a row. Fewer tokens are one gram; none, no gram."""
    n = F.size(tokens)

    def gram(i):
        h = _at(tokens, i, 0)
        for step in range(1, s.k):
            h = (h * BASE + _at(tokens, i, step)) % PRIME
        return h

    whole = F.array(F.aggregate(tokens, F.lit(0).cast("long"), lambda h, t: (h * BASE + t) % PRIME))
    return F.when(n >= s.k, F.transform(F.sequence(F.lit(0), n - s.k), gram)).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))


def chosen(grams: Column, s: Settings) -> Column:
    """Distinct chosen grams in order, each as hash * 2**32 + position. With fewer grams than w, one window of all."""
    n = F.size(grams)
    # the smaller hash first, then the larger position: one number says both
    keyed = F.transform(grams, lambda h, i: h * (1 << 32) + (F.lit((1 << 32) - 1) - i))

    def windows(keys):
        def least(i):
            return F.least(*(_at(keys, i, step) for step in range(s.w))) if s.w > 1 else _at(keys, i, 0)

        return F.when(n >= s.w, F.array_distinct(F.transform(F.sequence(F.lit(0), n - s.w), least))).when(n > 0, F.array(F.array_min(keys))).otherwise(F.array().cast("array<bigint>"))

    # a transform over a single element binds the array, so that it isn't built again for each window
    picked = F.get(F.transform(F.array(keyed), windows), F.lit(0))
    return F.transform(picked, lambda x: x + (1 << 32) - 1 - 2 * x.bitwiseAND((1 << 32) - 1))


def bound(value: Column, of) -> Column:
    """of(value), where value is computed once however often `of` names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def fingerprint(text: Column, s: Settings = Settings()) -> Column:
    """The chosen grams of a text, an array of hash * 2**32 + position; empty for an empty or null text."""
    text = F.coalesce(text, F.lit(""))
    return bound(token_hashes(text, s), lambda t: bound(gram_hashes(t, s), lambda g: chosen(g, s)))


def hashes(prints: Column) -> Column:
    return F.array_distinct(F.transform(prints, lambda x: F.shiftright(x, 32)))


def likeness(a: Column, b: Column) -> Column:
    """Share of distinct hashes in common, of all of either; 1 if both have none. a and b: distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def as_string(prints: Column) -> Column:
    """hash:position pairs in hexadecimal, in order, comma-joined."""
    return F.array_join(F.transform(prints, lambda x: F.concat(F.hex(F.shiftright(x, 32)), F.lit(":"), F.hex(x.bitwiseAND((1 << 32) - 1)))), ",")


#: Hashes of texts are dealt by this many values, which come first in the order of rows of one id.
DEALT = 1 << 20


def buckets_of(docs: DataFrame, s: Settings):
    """A function from (doc_id, dealt hash of the text) to a row's bucket. Buckets follow the order of with_next and are
    of about equal size, by approximate quantiles of all ids; an id that many rows have, or a null one, has buckets of
    its own, by the text's hash."""
    total, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    wanted = max(1, min(s.most_buckets, total // s.rows_per_bucket))
    cut = docs.agg(F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)], 100 * wanted).alias("c")).first()["c"] if wanted > 1 else None
    times = Counter(cut or [])
    bounds = sorted(times)
    # an id at several cuts fills that many buckets; others go with the ids above them
    own = [times[b] if times[b] > 1 else 0 for b in bounds]
    begins, at = [0] * (len(bounds) + 1), 0
    for i in range(len(bounds), 0, -1):
        begins[i] = at
        at += 1 + own[i - 1]
    begins[0] = at
    of_null, null_width = at + 1, max(1, min(s.most_buckets, nulls // s.rows_per_bucket))
    step = max(1, int(len(bounds) ** 0.5))
    literal = lambda xs, kind: F.array(*(F.lit(x) for x in xs)).cast(f"array<{kind}>")
    rough, flat = literal(bounds[::step], "bigint"), literal(bounds, "bigint")
    fine = F.array(*(literal(bounds[i : i + step], "bigint") for i in range(0, len(bounds), step))).cast("array<array<bigint>>")

    def number(doc_id: Column, dealt: Column) -> Column:
        share = lambda width: F.floor(dealt * width / DEALT).cast("int")
        found = F.lit(begins[0])
        if bounds:
            coarse = F.size(F.filter(rough, lambda x: x <= doc_id))
            place = F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(F.get(fine, coarse - 1), lambda x: x <= doc_id)))
            width = F.when((place > 0) & (F.get(flat, place - 1) == doc_id), F.get(literal(own, "int"), place - 1)).otherwise(0)
            found = F.get(literal(begins, "int"), place) + F.when(width > 0, 1 + share(width)).otherwise(0)
        return F.when(doc_id.isNull(), of_null + share(F.lit(null_width))).otherwise(found).cast("int")

    return number


def with_next(docs: DataFrame, s: Settings) -> DataFrame:
    """docs (doc_id, text) with _bucket, _copy, _dealt and _hash: in the order in_bucket() each row of copy 0 is followed
    by the next row of all, ids from the largest down, nulls last, rows of one id by a hash of their texts; the first
    row follows the last.

    Rows are dealt into buckets; each also gets a copy of the first row of the next. So texts move once, and no task
    has to see all rows, those of one id included.
    """
    hashed = docs.withColumn("_hash", F.xxhash64("text")).withColumn("_dealt", F.pmod("_hash", F.lit(DEALT)))
    placed = hashed.withColumn("_bucket", buckets_of(docs, s)(F.col("doc_id"), F.col("_dealt")))
    first = F.min(F.struct((-F.col("doc_id")).alias("down"), "_dealt", "_hash")).alias("first")
    heads = sorted((r["_bucket"], r["first"]["down"], r["first"]["_hash"]) for r in placed.groupBy("_bucket").agg(first).collect())
    # one row for each bucket; the bucket before the first is the last
    known = docs.sparkSession.createDataFrame([(b, None if down is None else -down, h, heads[i - 1][0]) for i, (b, down, h) in enumerate(heads)], "_bucket int, _head_id long, _head_hash long, _to int")
    held = placed.join(F.broadcast(known), "_bucket").where(F.col("doc_id").eqNullSafe(F.col("_head_id")) & (F.col("_hash") == F.col("_head_hash")))
    copies = held.groupBy(F.col("_to").alias("_bucket")).agg(F.min("text").alias("text"), F.max("doc_id").alias("doc_id"), F.max("_hash").alias("_hash"), F.max("_dealt").alias("_dealt"))
    return placed.withColumn("_copy", F.lit(0)).unionByName(copies.withColumn("_copy", F.lit(1)))


def in_bucket() -> WindowSpec:
    return Window.partitionBy("_bucket").orderBy("_copy", F.desc_nulls_last("doc_id"), "_dealt", "_hash", "text")


def compare_with_next(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs.

    The edited text is the text with its last floor(n_chars / 3) characters replaced by as many of the next text's
    first, or all that it has. Null counts as the empty text. Rows of equal doc_id go by a hash of the text, then by the
    text; a null doc_id comes last. A table of one row is its own next. An empty table gives an empty result. Other
    columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = in_bucket()
    paired = with_next(rows, s).select("*", F.lead("text").over(order).alias("_next"))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), cut))
    printed = paired.select("doc_id", "_bucket", "_copy", "_dealt", "_hash", "text", n.cast("long").alias("n_chars"), edited.alias("_edited"))
    printed = printed.select("doc_id", "_bucket", "_copy", "_dealt", "_hash", "text", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("text"), s).alias("_own"), fingerprint(F.when(F.col("_copy") == 0, F.col("_edited")), s).alias("_changed"))
    ahead = printed.select("*", F.lead("_own").over(order).alias("_ahead")).where("_copy = 0")
    likened = F.transform(F.array(F.struct(hashes(F.col("_own")).alias("a"), hashes(F.col("_changed")).alias("b"), hashes(F.col("_ahead")).alias("c"))), lambda x: F.struct(likeness(x["a"], x["b"]).alias("edited"), likeness(x["a"], x["c"]).alias("next")))
    out = ahead.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("_own")).alias("fingerprint"), as_string(F.col("_changed")).alias("edited_fingerprint"), F.get(likened, F.lit(0)).alias("_like"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.col("_like.edited").alias("near_edited"), F.col("_like.next").alias("near_next"))
