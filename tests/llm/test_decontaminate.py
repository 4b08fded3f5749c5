import random
import re

import pytest

from sourcequarry.llm import decontaminate

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, n):
    w, hit, ids = words(text), set(), set()
    for item_id, item in items:
        x = words(item)
        m = min(n, len(x))
        for i in range(len(x) - m + 1 if x else 0):
            for j in range(len(w) - m + 1):
                if w[j:j + m] == x[i:i + m]:
                    hit.update(range(j, j + m))
                    ids.add(item_id)
    return len(w), len(hit), sorted(i for i in ids if i is not None)


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(8)
    items = [(i, " ".join(r.choice("abcd") for _ in range(r.randrange(14)))) for i in range(6)]
    items += [(90, "É one"), (91, None), (92, ""), (93, "Z"), (None, "n n n n n"), (94, "É one"), (94, "É one")]
    docs = [(i, "".join(r.choice(["a", "b", "c", "D"]) + r.choice([" ", ", ", "\n"]) for _ in range(r.randrange(60)))) for i in range(40)]
    docs += [(50, None), (50, None), (51, ""), (52, "--É, ONE z"), (None, "é one"), (53, "n! n n N n"), (54, "n n n n " + "y " * 100_000)]
    return (spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, n_hit int, words string"),
            spark.createDataFrame(items, "item_id long, text string"), docs, items)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_equals_brute_force_both_ways(tables, limit):
    docs, benchmark, rows, items = tables
    found = decontaminate.find_hits(docs, benchmark, n=5, set_limit=limit)
    assert found.columns == ["doc_id", "text", "words", "n_words", "n_hit", "items", "spans"]
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["items"]) == brute(r["text"], items, 5)


@pytest.mark.parametrize("kind", ["string", "decimal(20,3)", "date", "int"])
def test_item_ids_keep_their_type_every_way(spark, tables, kind):
    docs, benchmark, rows, items = tables
    typed = {"string": "concat('item ', item_id)", "date": "date_add(DATE '2024-01-01', CAST(item_id AS int))"}.get(kind, f"CAST(item_id AS {kind})")
    benchmark = benchmark.selectExpr(f"{typed} AS item_id", "text")
    names = [r["item_id"] for r in benchmark.collect()]
    limits = ({}, {"set_limit": 0}, {"set_limit": 0, "hash_limit": 0})
    found = [decontaminate.find_hits(docs, benchmark, n=5, **limit) for limit in limits]
    assert all(dict(f.dtypes)["items"] == f"array<{kind}>" for f in found)
    for f in found:
        got = f.collect()
        assert len(got) == len(rows) and sum(r["n_hit"] > 0 for r in got) > 10
        for r in got:
            n_words, n_hit, ids = brute(r["text"], [(name, text) for name, (_, text) in zip(names, items)], 5)
            assert (r["n_words"], r["n_hit"], r["items"]) == (n_words, n_hit, ids)


def test_only_likely_windows_are_exploded(tables):
    docs, benchmark, _, _ = tables
    windows = decontaminate.benchmark_windows(benchmark, 5, "item_id", "text")
    hashes = windows.select("m", "h").distinct().collect()
    some = docs.select(decontaminate.words_of(docs["text"]).alias("w"))
    likely = some.select(decontaminate._likely(5, hashes, some["w"]).alias("x")).selectExpr("sum(size(x))").first()[0]
    every = some.select(decontaminate._likely(5, None, some["w"]).alias("x")).selectExpr("sum(size(x))").first()[0]
    assert 0 < likely < every / 50


def test_documents_and_spans_go(spark, tables):
    docs, benchmark, rows, items = tables
    kept = decontaminate.drop_documents(docs, benchmark, n=5)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()) == sorted((d or -1, t or "") for d, t in rows if not brute(t, items, 5)[1])
    cut = {r["doc_id"]: r for r in decontaminate.remove_spans(docs, benchmark, n=5).collect()}
    assert cut[52]["text"] == "--"
    assert cut[53]["text"] == "" and cut[50]["text"] is None and cut[52]["n_hit"] == 1
    assert cut[54]["text"] == rows[-1][1]


def test_empty_tables(tables):
    docs, benchmark, rows, _ = tables
    assert decontaminate.find_hits(docs.limit(0), benchmark).count() == 0
    assert decontaminate.drop_documents(docs, benchmark.limit(0)).count() == len(rows)
