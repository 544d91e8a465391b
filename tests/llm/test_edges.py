"""Every operator on nulls, empty and long texts, repeated rows, extra columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from plumbline.llm import attribution, extract, fim, hilbert, language, licences, minhash, posindex, sentencepieces, store, suffixes, toxicity, winnow

LONG = " ".join(f"word{i % 97} zeta{i}" for i in range(30_000))
ROWS = [
    (1, "the cat sat on the mat and the dog looked on", "en", "a", 10),
    (1, "the cat sat on the mat and the dog looked on", "en", "a", 10),
    (2, "", None, None, 0),
    (3, None, "fr", "b", None),
    (None, "a text without an id", "en", None, 3),
    (4, "   \n\t ", "en", "a", 5),
    (5, "x", "de", "c", 1),
    (6, LONG, "en", "a", len(LONG)),
    (7, "é 日本 \U0001f642 ß", "fr", "d", 8),
]


CLASH = ["row", "_row", "ids", "_low", "_read", "_score", "_lang_pred", "_n_spans", "key", "component", "component_id", "task", "score", "predicted", "part", "label", "h", "x", "_hash", "_bucket", "_copy", "size", "hilbert", "item_id", "toxic"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit("extra").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, None, None), (None, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat"), (2, None), (None, "x"), (3, "")], "item_id long, text string")


def operators(docs, labels, items):
    return {
        "op1": lambda: hilbert.assign(docs),
        "op2": lambda: attribution.by_section(docs),
        "op2 fields": lambda: attribution.by_field(docs, ["source", "lang", "text"]),
        "op3": lambda: toxicity.score(docs, toxicity.train(docs, labels)),
        "op5": lambda: minhash.components(docs, minhash.Settings(words=2)),
        "op6": lambda: sentencepieces.digest(docs),
        "op7": lambda: language.predict(docs, language.train(docs)),
        "op8": lambda: licences.scan(docs),
        "op9": lambda: posindex.digest(posindex.hits(docs, items)),
        "op10": lambda: winnow.compare_with_next(docs),
        "op11": lambda: suffixes.digest(docs),
        "op12": lambda: fim.digest(docs),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op2 fields", "op3", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12"])
def test_each_row_has_its_row(docs, labels, items, name):
    out = operators(docs, labels, items)[name]().collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    of = {r["doc_id"]: r.asDict() for r in out}
    if name == "op5":
        assert of[2]["n_shingles"] == of[3]["n_shingles"] == of[4]["n_shingles"] == 0 and of[5]["n_shingles"] == 1
        assert of[None]["component_id"] is None and of[None]["kept"] and of[1]["component_id"] == 1 and of[1]["kept"]
    if name == "op7":
        assert of[2]["lang_pred"] == of[3]["lang_pred"] == of[4]["lang_pred"] == "und"
    if name == "op9":
        assert of[1]["n_hit"] == 6 and of[1]["n_items"] == 1 and of[3]["n_words"] == 0 and of[6]["n_words"] == 60_000
    if name == "op6":
        assert all(r["round_trip"] for r in out) and of[3]["n_tokens"] == 0
    if name == "op1":
        assert of[3]["size"] == 1 and of[2]["text_crc32"] == of[3]["text_crc32"] == 0
    if name == "op10":
        assert of[3]["n_chars"] == 0 and of[3]["fingerprint"] == "" and of[6]["n_chars"] == len(LONG)
    if name == "op8":
        assert of[3]["n_words"] == 0 and of[3]["labels"] == "" and of[3]["first_word"] is None


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12"])
def test_an_empty_table_gives_an_empty_result(docs, labels, items, name):
    none = docs.limit(0)
    assert operators(none, labels, items)[name]().count() == 0


def test_empty_side_tables(docs, labels, items):
    assert posindex.digest(posindex.hits(docs, items.limit(0))).where("contaminated").count() == 0
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0))).where("predicted = 1").count() == 0


def test_pages(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (3, "v", "<p>x" * 20_000), (None, "w", "<article><p>a &amp; b</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("extra"))
    out = extract.extract(pages).collect()
    assert len(out) == 5
    of = {r["page_id"]: r for r in out}
    assert of[1]["text"] == of[2]["text"] == "" and of[1]["n_chars"] == 0
    assert of[3]["text"] == "\n".join(["x"] * 20_000) and of[None]["text"] == "a & b"
    assert extract.extract(pages.limit(0)).count() == 0


def stages(docs, labels, items):
    return {
        "toxicity": lambda: toxicity.reject(docs, labels),
        "language": lambda: language.reject(docs),
        "near duplicates": lambda: minhash.deduplicate(docs),
        "decontamination": lambda: posindex.decontaminate(docs, items),
    }


@pytest.mark.parametrize("name", ["toxicity", "language", "near duplicates", "decontamination"])
def test_stages_keep_the_columns_of_documents(docs, labels, items, name):
    out = stages(docs, labels, items)[name]()
    assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    left = [r["doc_id"] for r in out.collect()]
    if name == "language":
        assert sorted(x for x in left if x is not None) == [1, 1, 5, 6, 7] and None in left
    if name == "near duplicates":
        assert sorted(x for x in left if x is not None) == [1, 2, 3, 4, 5, 6, 7] and None in left
    if name == "decontamination":
        # each row by its own text: both rows of id 1 hold the phrase, row 5 is the item without id
        assert sorted(x for x in left if x is not None) == [2, 3, 4, 6, 7] and None in left
    assert stages(docs.limit(0), labels, items)[name]().count() == 0


def test_rows_that_share_an_id_go_or_stay_by_their_own_text(spark):
    docs = spark.createDataFrame([(1, "a clean text here"), (1, "holds the secret phrase"), (None, "holds the secret phrase too"), (None, "clean as well")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the secret phrase")], "item_id long, text string")
    assert sorted((r["doc_id"] is None, r["text"]) for r in posindex.decontaminate(docs, items).collect()) == [(False, "a clean text here"), (True, "clean as well")]
    assert posindex.decontaminate(docs, items.limit(0)).count() == 4


def test_ids_of_another_type_and_one_text_in_many_rows(spark):
    docs = spark.createDataFrame([(1, "same text in all of them")] * 40 + [(2, "same text in all of them")] * 3, "doc_id int, text string")
    assert [r["doc_id"] for r in minhash.deduplicate(docs).collect()] == [1]
    assert {r["component_id"] for r in minhash.components(docs, minhash.Settings(words=2)).collect()} == {1}
    out = winnow.compare_with_next(docs, winnow.Settings(rows_per_bucket=4)).collect()
    assert len(out) == 43 and all(r["near_next"] == 1 for r in out)


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

        def getConf(self):
            return {}

    session = type("Session", (), {"conf": {}, "sparkContext": Context()})()
    with pytest.raises(RuntimeError):
        store.scratch_root(session)
