import random

import pytest
from pyspark.sql import functions as F

from sourcequarry.llm import language_id

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return language_id.fit(docs.where("doc_id % 2 = 0"), "lang", sample=100)


def test_held_out_accuracy_of_the_text_model(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 1")
    rows = language_id.identify(docs, model).select("lang", "text_language").collect()
    assert sum(r["lang"] == r["text_language"] for r in rows) / len(rows) > 0.97


def test_other_evidence_decides_where_the_text_is_weak(spark, model):
    plain = [(i, "El los que del para menteción", "es", "http://a.example.org/x") for i in range(40)]
    french = [(100 + i, "Le elle queque dans éaux mentre", "fr", "https://user@www.b.example.fr:80/?q") for i in range(40)]
    docs = spark.createDataFrame(
        [*plain, *french, (1, "la", "fr-CA", "http://www.b.example.fr/"), (2, "la", "es", None), (3, "la", None, "http://new.example.fr/")],
        "id int, text string, declared string, url string")
    found = {r["id"]: r for r in language_id.identify(
        docs, model, declared=F.col("declared"), host=language_id.host_of(F.col("url"))).where("text = 'la'").collect()}
    assert (found[1]["language"], found[2]["language"], found[3]["language"]) == ("fr", "es", "fr")
    assert found[1]["posterior"] > found[3]["posterior"]




def test_nulls_empty_texts_and_clashing_names(spark, model):
    docs = spark.createDataFrame(
        [(1, None, "x", 0.5, None), (2, "", "x", 0.5, "en"), (3, "12 %% 7", None, None, None), (4, "The and of that are here", "x", 0.5, None),
         (4, "The and of that are here", "x", 0.5, None), (None, "Le elle queque dans éaux mentre", None, None, None)],
        "doc_id int, text string, language string, scores double, said string").withColumns(
            {c: F.lit(1) for c in ("prior", "fused", "suffix_evidence", "declared_evidence", "n", "guess", "at", "domain")})
    for drop in (False, True):
        rows = language_id.identify(docs, model, declared=F.col("said"), drop_text=drop).collect()
        assert len(rows) == 6
        assert all(r["rejected"] and r["language"] == "und" for r in rows if r["doc_id"] in (1, 2, 3))
        assert [r["language"] for r in rows if r["doc_id"] == 4] == ["en", "en"]
        assert [r["language"] for r in rows if r["doc_id"] is None] == ["fr"]
        assert {"doc_id", "scores", "said", "language", "posterior", "text_language", "rejected"} <= set(rows[0].asDict())
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_very_long_text_and_no_labels(spark, model):
    docs = spark.createDataFrame([(1, "the and of that " * 200_000, None)], "doc_id int, text string, lang string")
    assert language_id.identify(docs, model).first()["language"] == "en"
    empty = language_id.fit(docs, "lang")
    assert empty.languages == []
    assert language_id.identify(docs, empty).first()["rejected"]


def test_host_of(spark):
    urls = ["http://u:p@A.Example.org:8080/x?y#z", "https://b.fr", "c.fr/x", None, ""]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(language_id.host_of(F.col("url"))).collect()] == ["a.example.org", "b.fr", None, None, None]


def test_every_label_is_a_language(spark):
    """More than 64 labels, one of them with two rows; text that fits none is still rejected."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def words(i, n):
        r = random.Random(i)
        own = ["".join(r.choice(letters) for _ in range(r.randrange(3, 8))) for _ in range(30)]
        pick = random.Random(n)
        return " ".join(pick.choice(own) for _ in range(80))

    rows = [(100 * i + n, words(i, n), f"l{i:03d}") for i in range(150) for n in range(8)]
    rows += [(90_000 + n, words(777, n), "rare-one") for n in range(2)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    model = language_id.fit(docs, "lang")
    assert model.languages == sorted({r[2] for r in rows})
    new = [(-i, words(i, 50), f"l{i:03d}") for i in range(1, 150)] + [(-777, words(777, 50), "rare-one")]
    new += [(-1000, "ыъ щэ юя ыщъ", None), (-1001, "ыъ щэ юя ыщъ " * 20, None)]
    both = docs.unionByName(spark.createDataFrame(new, "doc_id int, text string, lang string"))
    found = {r["doc_id"]: r["language"] for r in language_id.identify(both, model).collect()}
    assert [found[i] for i, _, _ in new] == [lang or "und" for _, _, lang in new]


def test_copies_of_one_text_are_one_text(spark, monkeypatch):
    """A label of thousands of copies is drawn whatever the hash, and outweighs no other."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where("lang IN ('en', 'de')").limit(300)
    for i in range(4):
        one = f"zorq blik{i * "k"} vunt wexil ypoq jarrub zikvo quxom blorp vynt fjuz"
        copies = spark.range(5000).selectExpr("-1 - id AS doc_id", f"'{one}' AS text", "'xx' AS lang")
        fitted = language_id.fit(docs.unionByName(copies), "lang", sample=20)
        assert fitted.languages == ["de", "en", "xx"]
        named = [r["language"] for r in language_id.identify(copies.limit(20), fitted).collect()]
        assert named == ["xx"] * 20
        rest = language_id.identify(docs, fitted).collect()
        assert sum(r["language"] == r["lang"] for r in rest) > 0.95 * len(rest)
