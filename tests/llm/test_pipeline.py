"""The corpus pipeline and the registered queries on a small folder of tables."""

import random

import pytest

import corpus_pipeline
from plumbline.llm import queries as Q

STEMS = {"en": "the of and river house walking green people morning quiet paper winter", "fr": "le la maison rivière avec matin peuple papier hiver très doux être"}


def sentence(r, lang, n):
    return " ".join(r.choice(STEMS[lang].split()) + r.choice(["", "s", "x", str(r.randrange(50))]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, out = random.Random(11), tmp_path_factory.mktemp("tables")
    item = sentence(r, "en", 30)
    rows, labels, kind = [], [], {}
    for i in range(400):
        lang = "en" if i % 3 else "fr"
        text = sentence(r, lang, r.choice([30, 80]))
        kind[i] = "clean"
        if i % 7 == 0:
            text, kind[i] = f"{text} you vile vermin {sentence(r, lang, 4)} filthy scum vile", "toxic"
        elif i % 40 == 1:
            text, kind[i] = f"{text}. {' '.join(item.upper().split()[4:18])}! more", "leak"
        elif i % 50 == 2:
            text, kind[i] = "123 456 --- !!!", "no letters"
        rows.append((i, text, lang if i % 5 else None, f"s{i % 4}", len(text)))
        if i % 2:
            labels.append((i, 1, int(i % 7 == 0)))
    for i in range(20):
        j = next(j for j in range(i * 15, 400) if kind[j] == "clean")
        text = rows[j][1] if i % 2 else f"{rows[j][1]} extra"
        rows.append((1000 + i, text, "en", "s9", len(text)))
        kind[1000 + i] = "copy"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(1, "u", "<p>x")], "page_id long, url string, html string").write.parquet(f"{out}/pages.parquet")
    return str(out), kind, rows


def test_stages_take_out_what_they_name_and_keep_the_rest(spark, folder):
    path, kind, rows = folder
    left = corpus_pipeline.run(spark, path).collect()
    kept = {r["doc_id"] for r in left}
    gone = {k: [i for i in kind if kind[i] == k and i in kept] for k in set(kind.values())}
    assert gone["leak"] == [] and gone["no letters"] == [] and gone["copy"] == []
    assert len(gone["toxic"]) <= 2
    clean = [i for i in kind if kind[i] == "clean"]
    assert len(gone["clean"]) >= 0.98 * len(clean)
    assert all(r["n_tokens"] == len(r["ids"]) > 0 and r["lang"] for r in left)


def test_there_are_five_stages_and_documents_keep_their_columns(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "tokens"]


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_queries_with_sql_give_its_rows(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    path = folder[0]
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    df = Q.queries()[name](spark, path)
    want = con.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_every_operator_has_its_query():
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in Q.queries())] == [] and "pipeline" in Q.queries()


def test_tokens_say_whether_they_decode_to_the_text(spark, folder):
    docs = spark.createDataFrame([(1, "plain words", "en", "s"), (2, None, "en", "s")], "doc_id long, text string, lang string, source string")
    assert [r["round_trip"] for r in corpus_pipeline.tokens(spark, docs, folder[0]).collect()] == [True, True]


def test_the_pipeline_takes_nulls_ties_clashing_names_and_empty_tables(spark, tmp_path):
    say = "the quick brown fox jumps over lazy dogs while children walk through long nights and days"
    rows = [(1, say, "en", "a", 5), (1, say, "en", "a", 5), (None, say, None, "b", None), (2, None, "en", None, 0), (3, "", None, "a", 0), (4, "x", "en", "c", 1), (None, f"{say} again quite another ending with more words", "en", "a", 9), (5, " ".join(f"word{i}" for i in range(20_000)), "en", "a", 1)]
    clash = ["_row", "_low", "_score", "_read", "_lang_pred", "row", "ids", "label", "h"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *(f"'extra' AS {c}" for c in clash))
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "quite another ending with more"), (None, None)], "item_id long, text string")
    none = lambda df: df.limit(0)
    for n, (d, la, it) in enumerate([(docs, labels, items), (docs, none(labels), none(items)), (none(docs), labels, items), (docs.withColumn("lang", docs["lang"].substr(9, 1)).replace("", None, ["lang"]), labels, items)]):
        folder = tmp_path / str(n)
        for name, df in (("documents", d), ("labels", la), ("benchmark", it)):
            df.write.parquet(f"{folder}/{name}.parquet")
        out = corpus_pipeline.run(spark, str(folder)).collect()
        left = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out)
        assert left == {0: [(False, 1), (False, 4), (False, 5)], 1: [(False, 1), (False, 4), (False, 5), (True, 0)], 2: [], 3: [(False, 1), (False, 4), (False, 5)]}[n]
        assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out)


def test_scratch_of_stages_is_deleted(spark, folder):
    import os

    from plumbline.llm.store import scratch_root

    corpus_pipeline.run(spark, folder[0]).count()
    root = scratch_root(spark).removeprefix("file:")
    held = [x for x in os.listdir(f"{root}/plumbline") if x.startswith("stage-")]
    assert held and all(x.startswith("stage-4-") for x in held)
