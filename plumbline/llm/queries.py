"""The queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import attribution, extract, fim, hilbert, interaction, language, licences, minhash, posindex, sentencepieces, suffixes, toxicity, winnow
from plumbline.llm.store import table


def op1_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.assign(table(spark, sf_dir, "documents"))


def op2_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.by_section(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(table(spark, sf_dir, "documents"), minhash.Settings(words=2))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digest(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).drop("detections")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posindex.digest(posindex.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posindex.digest(posindex.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), proximity=True))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_with_next(table(spark, sf_dir, "documents"))


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(table(spark, sf_dir, "documents"))


def op13_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(interaction.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), interaction.NAMES)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the top of the repository; it imports this subpackage's operators

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hilbert": op1_hilbert,
        "op2_token_attribution": op2_token_attribution,
        "op3_toxicity": op3_toxicity,
        "op4_main_text": op4_main_text,
        "op5_minhash": op5_minhash,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_language": op7_language,
        "op8_licences": op8_licences,
        "op9_decontamination": op9_decontamination,
        "op9_proximity": op9_proximity,
        "op10_winnowing": op10_winnowing,
        "op11_suffixes": op11_suffixes,
        "op12_fim": op12_fim,
        "op13_interaction": op13_interaction,
        "pipeline": pipeline,
    }


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs of texts that share a shingle, by their whole sets; components by all that can be reached.
OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m ON m.doc_id = d.doc_id"""

#: Every window of every item looked up among all runs of words of that length.
OP9 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS s FROM i, unnest(range(1, len(w) - least(len(w), 10) + 2)) t(p) WHERE len(w) > 0),
x AS (SELECT doc_id, p, l, array_to_string(w[p:p + l - 1], ' ') AS s FROM d, (SELECT DISTINCT l FROM v), unnest(range(1, greatest(len(w) - l + 2, 1))) t(p)),
h AS (SELECT doc_id, p, l, item_id FROM x JOIN v USING (l, s)),
k AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM h, unnest(range(p, p + l)) t(q) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)"""


#: Every string of 200 bytes, as 400 hexadecimal digits told by two hashes; a removed byte is one that any of the 200
#: strings over it repeats.
OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT r, unnest(range(0, len(x) // 2 - 199)) AS p, x FROM d WHERE len(x) >= 400),
k AS (SELECT r, p, hash(substr(x, 2 * p + 1, 400)) AS a, md5_number_lower(substr(x, 2 * p + 1, 400)) AS b FROM s),
m AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY a, b) AS n FROM k) WHERE n > 1),
g AS (SELECT r, p, CASE WHEN p <= lag(p) OVER w + 200 THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY r ORDER BY p)),
i AS (SELECT r, min(p) AS b, max(p) + 200 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY p) AS i FROM g) GROUP BY r, i),
j AS (SELECT d.r, i.b, i.e, substr(d.x, 2 * coalesce(lag(i.e) OVER (PARTITION BY d.r ORDER BY i.b), 0) + 1, 2 * (i.b - coalesce(lag(i.e) OVER (PARTITION BY d.r ORDER BY i.b), 0))) AS before FROM i JOIN d USING (r)),
t AS (SELECT r, count(*) AS n_spans, sum(e - b) AS n_removed, max(e) AS last, string_agg(before, '' ORDER BY b) AS kept FROM j GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (r)"""

#: Every unit made and counted.
OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM f"""

#: Every order as a string, and each of its steps over each cell of counts.
OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
e AS (SELECT *, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT e.part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN first IS NOT NULL AND (e.doc_id IS NULL OR e.doc_id > first) THEN 16 ELSE 0 END AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM e LEFT JOIN g ON g.doc_id = e.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, 1 << CAST(strpos('ABCDE', substr(filter_order, step, 1)) - 1 AS INT) AS bit,
    list_sum([0] || list_transform(range(1, step), lambda i: 1 << CAST(strpos('ABCDE', substr(filter_order, i, 1)) - 1 AS INT))) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, CAST(step AS INT) AS step, x,
    CAST(coalesce(sum(n) FILTER (mask & (CAST(earlier AS INT) | bit) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & CAST(earlier AS INT) = 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & CAST(earlier AS INT) > 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (mask & bit > 0 AND mask & CAST(earlier AS INT) = 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & CAST(earlier AS INT) = 0), 0) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r"""


def oracle_sql() -> dict[str, str]:
    """SQL for those whose result it can express; the others are tested against brute force or held-out rows."""
    return {"op5_minhash": OP5, "op9_decontamination": OP9, "op11_suffixes": OP11, "op12_fim": OP12, "op13_interaction": OP13}
