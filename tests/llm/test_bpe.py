import random

import numpy as np
import pytest

from sourcequarry.llm import bpe, queries

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    path = queries.vocabulary()
    return bpe.Tokenizer(open(path).read()), tokenizers.Tokenizer.from_file(path)


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


def texts():
    r = random.Random(1)
    ranges = [(32, 127), (0x80, 0x530), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0x1F300, 0x1F600)]
    out = ["".join(chr(r.randrange(*r.choice(ranges))) for _ in range(r.randrange(60))) for _ in range(300)]
    out += ["".join(r.choice("abcdeth ") for _ in range(r.randrange(120))) for _ in range(300)]
    return out + [
        "", " ", "<|endoftext|>", "a<|startoftext|><|endoftext|> ΑΣ b", "it's we'LL I'D don't 12345", "İstanbul ΣΑΣ", "e\u0301 é",
        "x" * 5000, "ab" * 3000 + " c", "\x00\x1f\x85 \u2003|", "<|endoftext", "the" * 11, "a" * 33, "a" * 34, "ﬁ"]


def test_equals_the_library(both):
    mine, library = both
    some = texts()
    for text, packed in zip(some, mine.encode_all(some), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(packed) == want, text
        assert mine.decode(packed) == library.decode(want, skip_special_tokens=False)


def naive(ids, merges):
    ids = list(ids)
    while True:
        found = [(merges[a << 32 | b][0], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if a << 32 | b in merges]
        if not found:
            return ids
        i = min(found)[1]
        ids[i:i + 2] = [merges[ids[i] << 32 | ids[i + 1]][1]]


def test_segment_trees_merge_the_leftmost_lowest_rank():
    r = random.Random(7)
    for _ in range(200):
        merges = {}
        for rank in range(r.randrange(1, 12)):
            merges.setdefault(r.randrange(6) << 32 | r.randrange(6), (rank, r.randrange(6)))
        merges = {k: (i, v[1]) for i, (k, v) in enumerate(sorted(merges.items(), key=lambda x: x[1][0]))}
        words = [[r.randrange(6) for _ in range(r.randrange(1, 10))] for _ in range(20)]
        matrix = np.full((len(words), 9), -1)
        for row, word in zip(matrix, words, strict=True):
            row[:len(word)] = word
        bpe.merge_together(matrix, bpe.PairTable(merges))
        for row, word in zip(matrix, words, strict=True):
            assert [x for x in row if x >= 0] == naive(word, merges) == bpe.merge_pairs(list(word), merges)


def test_readable_text_comes_back(both):
    mine, _ = both
    assert mine.decode_text(mine.encode("Grüße, the WORLD!")) == "grüße , the world ! "


def test_nulls_long_texts_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, None, 5, "x"), (1, None, 5, "x"), (None, "", None, None), (2, "the " * 300_000, 1, "y")],
                                 "doc_id int, text string, ids int, decoded string")
    path = queries.vocabulary()
    rows = bpe.decode(bpe.encode(docs, path), path).select("*", bpe.token_count("ids").alias("n")).collect()
    assert sorted(r["n"] for r in rows) == [0, 0, 0, 300_000]
    assert [r["decoded"] for r in rows if r["n"] == 0] == [""] * 3
    assert set(rows[0].asDict()) == {"doc_id", "text", "ids", "decoded", "n"}
    assert bpe.encode(docs.limit(0), path).count() == 0
    with pytest.raises(Exception):
        bpe.Tokenizer("{}")


def test_every_character_is_split_as_by_the_library():
    """All of Unicode but private and planes without characters; of Han and Hangul a part."""
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(queries.vocabulary())
    own = bpe.Tokenizer(open(queries.vocabulary()).read())
    points = [*range(0x4E10), *range(0x9FF0, 0xAC10), *range(0xD7A0, 0xD800), *range(0xF900, 0x20010), *range(0x2A6D0, 0x40000), *range(0xE0000, 0xE0200)]
    for form in ("a{0}b 1{0}", "!{0}! {0}{0}1"):
        texts = [form.format(chr(c)) for c in points]
        ids = library.encode_batch(texts, add_special_tokens=False)
        assert [c for c, want, got in zip(points, ids, own.encode_all(texts)) if want.ids != np.frombuffer(got, "<u4").tolist()] == []
