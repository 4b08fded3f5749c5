"""Registered queries against their SQL, or against plain Python where SQL has no words for them."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from sourcequarry.llm import queries
from tests.compare import connect, difference, plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    ours = plain(queries.QUERIES[name](spark, SF))
    assert difference(ours, connect(SF).execute(queries.ORACLE_SQL[name]).df()) is None


def by_id(spark, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF).collect()}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_op1_agrees_with_the_labels(spark, documents):
    found = by_id(spark, "op1_language_id")
    assert len(found) == len(documents)
    assert all(found[d["doc_id"]]["language"] == d["lang"] for d in documents)


def test_op2_phrases(spark, documents):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    found = by_id(spark, "op2_licenses")
    for d in documents:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(d["text"]))
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if tuple(words[i:i + len(p)]) == p]
        row = found[d["doc_id"]]
        starts = [i for i, _ in places]
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == (
            len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
        assert {x for _, x in places} <= set(row["labels"].split(",")) and 0 <= row["score"] <= 1


def test_op4_fingerprints_and_components(spark, documents):
    prints = {}
    for d in documents:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(d["text"]))
        shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[d["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    least = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints.items():
            for j, b in prints.items():
                if (a ^ b).bit_count() <= 2 and least[j] < least[i]:
                    least[i], changed = least[j], True
    found = by_id(spark, "op4_simhash")
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in found.items()} == {
        i: (f"{p:016x}", least[i]) for i, p in prints.items()}


def test_op5_equals_the_library(spark, documents):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(queries.vocabulary())
    found = by_id(spark, "op5_bpe")
    for d in documents:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        row = found[d["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op9_shards(spark, documents):
    found = by_id(spark, "op9_sharding")
    for d in documents:
        data, row = (d["text"] or "").encode(), found[d["doc_id"]]
        assert (row["size"], row["text_crc32"], row["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert row["grown_shard"] in (row["shard"], 16)
    slots = {}
    for row in found.values():
        slots.setdefault(row["shard"], []).append(row["slot"])
    assert all(sorted(some) == list(range(len(some))) for some in slots.values())
    assert set(slots) <= set(range(16))


def test_page_language_agrees_with_markup(spark):
    rows = queries.QUERIES["page_language"](spark, SF).collect()
    assert rows and all(r["language"] == r["markup"] for r in rows if not r["rejected"])
