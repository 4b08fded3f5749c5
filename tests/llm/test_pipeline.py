"""Every stage of the pipeline against brute force, on documents with planted cases."""

import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from sourcequarry.llm import queries
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_suffix_dedup import brute as without_repeats

SF = "/root/testdata/sf0.001"


def simhash_of(text, n):
    """The fingerprint of a text as a number, a bit at a time."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = next(r.text for r in items.collect() if len(r.text.split()) > 20)
    long = next(d[1] for d in docs if len(d[1].split()) > 150)
    near = long.split(" ")
    near[50:52] = ["other", "words"]
    longest = max((d[1] for d in docs), key=len)
    passage = "the passage that many of these documents share and that goes on for long enough to be found " * 2
    planted = [
        (9001, long, "en", "src0", 1), (9002, " ".join(near), "en", "src0", 1), (9003, docs[3][1] + " " + item, "en", "src1", 1),
        (9004, docs[4][1][:50] + passage, "en", "src1", 1), (9005, docs[5][1][:50] + passage + docs[5][1][50:90], "en", None, None),
        (9006, None, "en", "src1", 0), (9007, "", None, None, None), (9008, "12 34 %%", "de", "src2", 8), (9001, long, "en", "src0", 1),
        (None, "the and of that with no number", "en", "src1", 4)]
    spark.createDataFrame([*docs, *planted], spark.read.parquet(f"{SF}/documents.parquet").schema).write.parquet(f"{path}/documents.parquet")
    items.write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_equal_brute_force(spark, folder):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), name)
        kept.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    source = spark.read.parquet(f"{folder}/documents.parquet").collect()
    rows = [{(r["doc_id"], r["text"]) for r in some} for some in (source, *kept)]

    assert rows[0] - rows[1] == {(9006, None), (9007, ""), (9008, "12 34 %%")}

    some = sorted(rows[1], key=lambda r: (r[0] is None, r[0] or 0))
    prints = [simhash_of(t, 3) for _, t in some]
    group = list(range(len(some)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    assert rows[2] == {some[g] for g in set(group)} and len(kept[1]) == len(rows[2])
    assert not {9001, 9010} & {d for d, _ in rows[2]}

    want = without_repeats(list(rows[2]), 100)
    for r in kept[2]:
        cut = next(v for (d, t), v in want.items() if d == r["doc_id"])
        assert abs(len(r["text"].encode()) - len(cut[3])) <= 6 * cut[2]  # whole characters stay
        assert cut[1] or (r["doc_id"], r["text"]) in rows[2]

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    texts = [x for x in rows[3] if x[0] is None or x[0] % 7 == 0 or x[0] > 9000]
    assert {x for x in texts if not contaminated(x[1], items, 10)[1]} == {x for x in texts if x in rows[4]}
    assert 9003 not in {d for d, _ in rows[4]}

    library = tokenizers.Tokenizer.from_file(queries.vocabulary())
    for r in kept[4]:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert {(r["doc_id"], r["text"]) for r in kept[4]} == rows[4]


def test_run_is_its_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 100


def test_empty_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
