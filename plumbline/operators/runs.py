"""Aggregations over the questions of one or more runs.

A run is a table of judged questions: question_id, verdict, mechanism, set_reading, probes, error_side and the like;
which columns an operator reads it names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import keys
from plumbline.operators.mechanism import MECHANISMS
from plumbline.operators.order import with_pos

VERDICTS = ("EQUAL", "NOT_EQUAL", "NOT_COMPARABLE", "GOLD-ONLY", "ERROR")


def zero_filled(df: DataFrame, key: str, names: tuple[str, ...], count: str = "n") -> DataFrame:
    """(key, count) with a row for each of a fixed list of names."""
    known = df.sparkSession.createDataFrame([(x,) for x in names], f"{key} string")
    held = df.groupBy(key).agg(F.count("*").alias(count))
    return F.broadcast(known).join(held, key, "left").select(key, F.coalesce(count, F.lit(0)).cast("long").alias(count))


def verdict_counts(run: DataFrame) -> DataFrame:
    return zero_filled(run, "verdict", VERDICTS)


def probe_counts(run: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return zero_filled(run.select(F.explode("probes").alias("probe")), "probe", names)


def credited(run: DataFrame) -> DataFrame:
    """Questions that plain set equality credits though the results aren't equal."""
    return run.where("set_reading = 1 AND verdict = 'NOT_EQUAL'")


def credited_by_mechanism(run: DataFrame) -> DataFrame:
    return zero_filled(credited(run), "mechanism", MECHANISMS)


def credited_split(run: DataFrame) -> DataFrame:
    """(mechanism, test_suite, n) of the questions that set equality credits: whether the test-suite reading credits
    them too (1), doesn't (0) or wasn't found out (null). Mechanisms without such questions have no row."""
    return credited(run).groupBy("mechanism", "test_suite").agg(F.count("*").alias("n"))


def errors_by_side(run: DataFrame) -> DataFrame:
    """(side, n, question_ids) of questions that timed out; both sides have a row."""
    sides = run.sparkSession.createDataFrame([("gold",), ("second",)], "side string")
    held = run.where("timed_out_side IS NOT NULL").groupBy(F.col("timed_out_side").alias("side")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("question_id")).alias("question_ids"))
    return F.broadcast(sides).join(held, "side", "left").select("side", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("question_ids", F.array().cast("array<long>")).alias("question_ids"))


def exit_status(questions: int, errors: int, not_equal: int, smells: int, fail_on_smell: bool = False) -> int:
    """2 if every question failed, 1 for a disagreement or, if asked, a smell, else 0."""
    if questions and errors == questions:
        return 2
    return int(not_equal > 0 or fail_on_smell and smells > 0)


def mechanism_counts(run: DataFrame) -> DataFrame:
    """(mechanism, n), most frequent first, then by name."""
    return run.where("mechanism IS NOT NULL").groupBy("mechanism").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "mechanism")


def index_pages(run: DataFrame) -> DataFrame:
    """(kind, name, n): an index page for each verdict, mechanism and probe that any question has."""
    entry = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    entries = F.concat(F.array(entry("verdict", F.col("verdict"))), F.when(F.col("mechanism").isNotNull(), F.array(entry("mechanism", F.col("mechanism")))).otherwise(F.array().cast("array<struct<kind:string,name:string>>")), F.transform("probes", lambda p: entry("probe", p)))
    return run.select(F.explode(entries).alias("e")).select("e.*").groupBy("kind", "name").agg(F.count("*").alias("n"))


def question_index(pages: DataFrame, errors: DataFrame) -> DataFrame:
    """All questions, those with a page and those that failed."""
    return pages.select("question_id", F.lit("page").alias("entry")).unionByName(errors.select("question_id", F.lit("error").alias("entry")))


def reconcile(expected: DataFrame, found: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, problem): missing of those expected, extra of those found."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("problem", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("problem", F.lit("extra")))


def with_classification(run: DataFrame, by_hand: DataFrame, *keys: str) -> DataFrame:
    """The run with the classes given by hand, null where none was."""
    return run.join(by_hand, list(keys or ("question_id",)), "left")


def group_sums(runs: DataFrame, groups: list[str], counts: list[str]) -> DataFrame:
    """Counts added up by group, over runs with questions of their own."""
    return runs.groupBy(*groups).agg(*(F.sum(c).cast("long").alias(c) for c in counts))


def crosstab(df: DataFrame, rows: str, column: str, names: list[str]) -> DataFrame:
    """Counts of one class against another, a column for each of the names."""
    return df.groupBy(rows).agg(*(F.count_if(F.col(column) == n).alias(n) for n in names), F.count("*").alias("total"))


def agreement(run: DataFrame, official: DataFrame) -> DataFrame:
    """One row: how often a run's set reading and official scores agree, over questions in both; an error counts 0."""
    both = run.select("question_id", F.coalesce("set_reading", F.lit(0)).alias("own")).join(official.select("question_id", "score"), "question_id")
    return both.agg(F.count("*").alias("questions"), F.count_if(F.col("own") == F.col("score")).alias("agree"), F.count_if((F.col("own") == 1) & (F.col("score") == 0)).alias("own_only"), F.count_if((F.col("own") == 0) & (F.col("score") == 1)).alias("official_only"))


def agreement_rows(run: DataFrame, official: DataFrame) -> DataFrame:
    """(question_id, own, official, agrees) of questions in both; an error counts 0."""
    both = run.select("question_id", F.coalesce("set_reading", F.lit(0)).alias("own")).join(official.select("question_id", F.col("score").alias("official")), "question_id")
    return both.select("question_id", "own", "official", (F.col("own") == F.col("official")).alias("agrees"))


def crosstab_cells(df: DataFrame, rows: str, column: str, names: tuple[str, ...]) -> DataFrame:
    """A row for each pair of classes: how many, those in which each named probe fired, and the smallest and the largest
    id. The ids themselves are the rows of df that have both classes."""
    fired = [F.count_if(F.array_contains("probes", n)).alias(n.replace("-", "_")) for n in names]
    return df.groupBy(rows, column).agg(F.count("*").alias("n"), *fired, F.min("question_id").alias("first_id"), F.max("question_id").alias("last_id"))


def crosstab_ids(df: DataFrame, rows: str, column: str) -> DataFrame:
    """The questions of each pair of classes, a row each. A cell's list is these rows; it is never held in one."""
    return df.where(F.col(rows).isNotNull() & F.col(column).isNotNull()).select(rows, column, "question_id").distinct()


def candidate_checks(df: DataFrame, current: str, candidates: list[str]) -> DataFrame:
    """(measure, n) of boolean columns: those of the current check, of any check, what each candidate adds to those
    before it, and what two checks share."""
    every = [current, *candidates]
    any_of = lambda names: reduce(Column.__or__, [F.coalesce(F.col(n), F.lit(False)) for n in names])
    counted = {"current": any_of([current]), "combined": any_of(every)}
    counted |= {f"increment {c}": any_of([c]) & ~any_of(every[: i + 1]) for i, c in enumerate(candidates)}
    counted |= {f"overlap {a} {b}": any_of([a]) & any_of([b]) for i, a in enumerate(every) for b in every[i + 1 :]}
    one = df.agg(*(F.count_if(c).alias(n) for n, c in counted.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), F.col(f"`{n}`").alias("n")) for n in counted))).alias("x")).select("x.*")


def copy_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """(question_id, a_verdict, a_reading, b_verdict, b_reading) where two copies of the gold give another verdict or
    set reading; a question that one of them lacks has nulls there."""
    x, y = (df.select("question_id", F.struct("verdict", "set_reading").alias(n)) for df, n in ((a, "a"), (b, "b")))
    both = x.join(y, "question_id", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("question_id", *(F.col(f"{n}.{f}").alias(f"{n}_{t}") for n in "ab" for f, t in (("verdict", "verdict"), ("set_reading", "reading"))))


def recall_in_passes(memberships: DataFrame, passes: dict[str, DataFrame]) -> DataFrame:
    """(name, size, and for each pass fired_ and share_) of each group of question ids: those with any probe fired.

    memberships: (name, question_id), each pair once; a question may be in several groups. Questions that a pass lacks
    have none fired."""
    held, out = memberships.distinct(), []
    for n, df in passes.items():
        held = held.join(df.where(F.size("probes") > 0).select("question_id").distinct().withColumn(n, F.lit(1)), "question_id", "left")
        out += [F.count(n).alias(f"fired_{n}"), F.round(F.count(n) / F.count("*"), 4).alias(f"share_{n}")]
    return held.groupBy("name").agg(F.count("*").alias("size"), *out)


def split_three_way(a: DataFrame, b: DataFrame, normalise) -> DataFrame:
    """(question_id, change) of statements in either: rewritten, text_only where normalisation makes them equal,
    unchanged, or only_first and only_second where the other has none."""
    both = a.select("question_id", F.col("statement").alias("x")).join(b.select("question_id", F.col("statement").alias("y")), "question_id", "full_outer")
    same = normalise(F.col("x")) == normalise(F.col("y"))
    return both.select("question_id", F.when(F.col("y").isNull(), "only_first").when(F.col("x").isNull(), "only_second").when(F.col("x") == F.col("y"), "unchanged").when(same, "text_only").otherwise("rewritten").alias("change"))


def normalised_statement(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.rtrim(F.regexp_replace(F.trim(c), ";+$", "")), r"\s+", " "))


def recall(run: DataFrame, group: str, names: tuple[str, ...]) -> DataFrame:
    """(group, probe, fired, size, rate) of each probe in each group."""
    return run.groupBy(group).agg(F.count("*").alias("size"), *(F.count_if(F.array_contains("probes", n)).alias(n) for n in names)).select(group, "size", F.explode(F.array(*(F.struct(F.lit(n).alias("probe"), F.col(n).alias("fired")) for n in names))).alias("x")).select(group, "x.probe", "x.fired", "size", F.round(F.col("x.fired") / F.col("size"), 3).alias("rate"))


def overlap_matrix(memberships: DataFrame, item: str, list_name: str) -> DataFrame:
    """(a, b, shared): items that two lists share. Lists are few, an item's own lists are paired within the item."""
    held = memberships.groupBy(item).agg(F.array_sort(F.collect_set(list_name)).alias("ls"))
    pairs = F.flatten(F.transform("ls", lambda x: F.transform(F.filter("ls", lambda y: y >= x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return held.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("shared")).select("a", "b", "shared")


def systematic_sample(df: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """Of each class every ceil(n / most)-th row, so at most `most`. A class is sorted by one task: classes are of
    questions, not of data."""
    n = F.count("*").over(W.partitionBy(by))
    rn = F.row_number().over(W.partitionBy(by).orderBy(order))
    placed = df.withColumn("_n", n).withColumn("_rn", rn)
    stride = F.ceil(F.col("_n") / most)
    return placed.where((F.col("_rn") - 1) % stride == 0).drop("_n", "_rn")


def strided_sample(df: DataFrame, order: list[str], size: int, least: int = 100) -> DataFrame:
    """Of all rows in order every (n // size)-th, the first `size` of those; all rows if there are fewer than `least`."""
    rows = with_pos(df.orderBy(*order))
    total = rows.agg(F.count("*").alias("_n"))
    step = F.greatest(F.floor(F.col("_n") / size), F.lit(1))
    chosen = (F.col("_n") < least) | ((F.col("_pos") % step == 0) & (F.col("_pos") < step * size))
    return rows.crossJoin(F.broadcast(total)).where(chosen).drop("_n", "_pos")  # one row


def seeded_sample(df: DataFrame, key: str, seed: int, size: int) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(size)


def moved(before: DataFrame, after: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, change): credits lost and gained between two sets of credited questions."""
    a, b = before.select(key).distinct().withColumn("_a", F.lit(1)), after.select(key).distinct().withColumn("_b", F.lit(1))
    return a.join(b, key, "full_outer").where("_a IS NULL OR _b IS NULL").select(key, F.when(F.col("_a").isNull(), "gained").otherwise("lost").alias("change"))


def flips(a: DataFrame, b: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, direction) of questions whose score differs between two runs."""
    both = a.select(key, F.col("score").alias("x")).join(b.select(key, F.col("score").alias("y")), key).where("x <> y")
    return both.select(key, F.when(F.col("x") < F.col("y"), "up").otherwise("down").alias("direction"))


def answer_class(identical: Column, same_bag: Column, same_set: Column) -> Column:
    """different-rows, multiplicity, typed-only or identical, the first that holds."""
    return F.when(~same_set, "different-rows").when(~same_bag, "multiplicity").when(~identical, "typed-only").otherwise("identical")


def answer_of(gold: DataFrame, second: DataFrame) -> DataFrame:
    """One row: the class of two results (see answer_class), plain values deciding between the first three, and as a
    witness the smallest plain row that makes it so; null if they are identical."""
    sides = [keys.by_place(df) for df in (gold, second)]
    rows = [df.select(keys.set_row_key(df).alias("plain"), keys.row_key(df).alias("typed"), F.lit(i).alias("side")) for i, df in enumerate(sides)]
    typed = rows[0].unionAll(rows[1]).groupBy("plain", "typed").agg(F.count_if(F.col("side") == 0).alias("g"), F.count_if(F.col("side") == 1).alias("s"))
    plain = typed.groupBy("plain").agg(F.sum("g").alias("g"), F.sum("s").alias("s"), F.bool_and(F.col("g") == F.col("s")).alias("typed"))
    facts = {"same_set": (F.col("g") > 0) == (F.col("s") > 0), "same_bag": F.col("g") == F.col("s"), "identical": F.col("typed")}
    seen = [x for n, c in facts.items() for x in (F.coalesce(F.bool_and(c), F.lit(True)).alias(n), F.min(F.when(~c, F.col("plain"))).alias(f"not_{n}"))]
    return plain.agg(*seen).select(answer_class(F.col("identical"), F.col("same_bag"), F.col("same_set")).alias("class"), F.coalesce("not_same_set", "not_same_bag", "not_identical").alias("witness"))


def coverage(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """One row: children, those whose key is in parent, those whose isn't, parents without children."""
    refs = child.where(F.col(child_key).isNotNull())
    by_key = refs.groupBy(F.col(child_key).alias("k")).agg(F.count("*").alias("n"))
    both = by_key.join(parent.select(F.col(parent_key).alias("k")).distinct().withColumn("_p", F.lit(1)), "k", "full_outer")
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("children"), F.coalesce(F.sum(F.when(F.col("_p").isNotNull(), F.col("n"))), F.lit(0)).cast("long").alias("found"), F.coalesce(F.sum(F.when(F.col("_p").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("orphans"), F.count_if(F.col("n").isNull()).alias("childless"))


def coverage_by_length(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """(length, children, found, keys): of children's keys of each length as text how many rows there are, how many of
    them have a parent, and how many different keys. Children are counted by key before they meet their parents."""
    by_key = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("k")).agg(F.count("*").alias("n"))
    known = parent.select(F.col(parent_key).alias("k")).distinct().withColumn("_p", F.lit(1))
    both = by_key.join(known, "k", "left")
    return both.groupBy(F.length(F.col("k").cast("string")).alias("length")).agg(F.sum("n").cast("long").alias("children"), F.coalesce(F.sum(F.when(F.col("_p") == 1, F.col("n"))), F.lit(0)).cast("long").alias("found"), F.count("*").alias("keys"))


def precision(classified: DataFrame, group: str, good: str) -> DataFrame:
    """(group, rows, good, precision, questions) of hand classes."""
    return classified.groupBy(group).agg(F.count("*").alias("rows"), F.count_if(F.col(good)).alias("good"), F.round(F.avg(F.col(good).cast("int")), 3).alias("precision"), F.count_distinct("question_id").alias("questions"))


def unjust(run: DataFrame, corrected: DataFrame) -> DataFrame:
    """(question_id, kind): a score of 0 that the corrected gold makes 1 (unjust_zero), or the reverse."""
    both = run.select("question_id", F.col("score").alias("x")).join(corrected.select("question_id", F.col("score").alias("y")), "question_id").where("x <> y")
    return both.select("question_id", F.when(F.col("x") == 0, "unjust_zero").otherwise("unjust_one").alias("kind"))


def probe_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(question_id, a, b) where two copies of the data make other probes fire."""
    x, y = (df.select("question_id", F.array_sort("probes").alias(n)) for df, n in ((a, "a"), (b, "b")))
    return x.join(y, "question_id", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))


def copy_coverage(statements: DataFrame, copied: list[str]) -> DataFrame:
    """(question_id, named, copied): tables that a statement names, and those of them with a shuffled copy."""
    known = F.array(*map(F.lit, copied)) if copied else F.array().cast("array<string>")
    return statements.select("question_id", F.size(F.array_distinct("tables")).alias("named"), F.size(F.array_intersect("tables", known)).alias("copied"))


def headline(df: DataFrame, part: Column) -> DataFrame:
    """One row: whole, part and rest."""
    return df.agg(F.count("*").alias("whole"), F.count_if(part).alias("part")).select("whole", "part", (F.col("whole") - F.col("part")).alias("rest"))


def merge_runs(runs: list[DataFrame], keys: list[str], counts: list[str], lists: list[str]) -> DataFrame:
    """Several runs' rows as one: counts added, lists joined."""
    every = reduce(DataFrame.unionByName, runs)
    return every.groupBy(*keys).agg(*(F.sum(c).cast("long").alias(c) for c in counts), *(F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in lists))


class SelectionRefused(ValueError):
    """Protected questions alone are over the budget."""


def trimmed(questions: DataFrame, budget: int, page_limit: int | None = None, files: int | None = None) -> DataFrame:
    """Questions kept within a budget of bytes and, if given, one of files (a column of that name). Those of more bytes
    than page_limit go first, protected or not. Then the largest of whichever benchmark holds most goes, until the rest
    fits both, so that benchmarks are left with as equal a number as can be; protected ones stay, and are refused if
    they don't fit alone.

    A question's rank in its benchmark, smallest first, says when it goes: the highest ranks first, of equal ones the
    last benchmark by name. Sums run over ranks, a row each, and within a rank over its benchmarks.
    """
    held = questions.where(F.col("bytes") <= page_limit) if page_limit is not None else questions
    limits = {"bytes": budget} | ({"files": files} if files is not None else {})
    fixed = held.where("protected").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in limits)).first()
    if over := [f"{fixed[c]} {c} of protected questions are over {most}" for c, most in limits.items() if fixed[c] > most]:
        raise SelectionRefused("; ".join(over))
    ranked = held.where("NOT protected").withColumn("_rank", F.row_number().over(W.partitionBy("benchmark").orderBy("bytes", "question_id")))
    levels = ranked.groupBy("_rank").agg(*(F.sum(c).alias(f"_level_{c}") for c in limits))
    below = levels.select("_rank", *((F.sum(f"_level_{c}").over(W.orderBy("_rank")) - F.col(f"_level_{c}")).alias(f"_below_{c}") for c in limits))
    in_rank = W.partitionBy("_rank").orderBy(F.desc("benchmark"), "question_id").rowsBetween(W.unboundedPreceding, 0)
    placed = ranked.withColumns({f"_own_{c}": F.sum(c).over(in_rank) for c in limits}).join(below, "_rank")
    # both sums only grow, so that what fits is all up to one place
    fits = placed.where(reduce(Column.__and__, [F.col(f"_below_{c}") + F.col(f"_own_{c}") + fixed[c] <= most for c, most in limits.items()]))
    return held.where("protected").unionByName(fits.select(*held.columns))


def reasons_left_out(questions: DataFrame, kept: DataFrame, page_limit: int | None = None) -> DataFrame:
    """(question_id, benchmark, reason) of those that a selection left out: over-page for more bytes than a page may
    have, over-budget for the rest."""
    gone = questions.join(kept.select("question_id"), "question_id", "left_anti")
    return gone.select("question_id", "benchmark", F.when(F.col("bytes") > F.lit(page_limit), "over-page").otherwise("over-budget").alias("reason"))


def left_out(questions: DataFrame, kept: DataFrame) -> DataFrame:
    """(benchmark, questions, bytes) of those that a selection left out."""
    gone = questions.join(kept.select("question_id"), "question_id", "left_anti")
    return gone.groupBy("benchmark").agg(F.count("*").alias("questions"), F.sum("bytes").cast("long").alias("bytes"))


def published(found: DataFrame, kept: DataFrame) -> DataFrame:
    """(name, value, published): findings under each name, and those of them whose question a selection kept."""
    held = kept.select("question_id").distinct().withColumn("_kept", F.lit(1))
    return found.join(held, "question_id", "left").groupBy("name").agg(F.count("*").alias("value"), F.count("_kept").alias("published"))


def directories_by_run(paths: DataFrame) -> DataFrame:
    """(run, questions) of archive members' paths: directories q<number>, each once."""
    found = paths.select(F.regexp_extract("path", r"^(?:.*/)?([^/]+)/q\d+/", 1).alias("run"), F.regexp_extract("path", r"/(q\d+)/", 1).alias("q")).where("run <> '' AND q <> ''")
    return found.distinct().groupBy("run").agg(F.count("*").alias("questions"))
