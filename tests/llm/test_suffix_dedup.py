import random

import numpy as np
from pyspark.sql import functions as F

from sourcequarry.llm import suffix_dedup as sd


def brute(rows, length):
    """Documents in order; equal (id, text) rows are one document."""
    seen, out = {}, {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            part = data[i:i + length]
            if part in seen:
                gone[i:i + length] = b"\1" * length
            seen.setdefault(part, i)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc, text] = len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)
    return out


def corpus(seed):
    r = random.Random(seed)
    shared = ["".join(r.choice("ab cé") for _ in range(400)) for _ in range(4)]
    rows = []
    for i in range(60):
        kind, start = r.randrange(7), r.randrange(250)
        text = "".join(r.choice("abcdefgh ") for _ in range(r.randrange(300)))
        part = r.choice(shared)[start:start + r.randrange(20, 200)]
        if kind < 3:
            text = text[:50] + part + text[50:] + (part if kind == 2 else "")
        elif kind == 3 and rows:
            text = r.choice(rows)[1]
        elif kind == 4:
            text = "z" * r.randrange(300)
        elif kind == 5 and rows:
            other = r.choice(rows)[1] or ""
            cut = r.randrange(len(other) + 1)
            text = other[:cut] + "X" + other[cut:]
        rows.append((i, None if kind == 6 and i % 2 else text))
    return rows


def test_equals_brute_force_with_and_without_gathering(spark, monkeypatch):
    for seed, limit, block, hot in ((5, 100_000, 50_000, 100), (6, 1, 50_000, 100), (7, 100_000, 3, 1)):
        monkeypatch.setattr(sd, "BLOCK", block)
        monkeypatch.setattr(sd, "HOT_COPIES", hot)
        rows = corpus(seed)
        rows += [rows[9], rows[9], (None, rows[9][1]), (None, "n" * 120)]
        want = brute(rows, 100)
        docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, start string, leaders int, intervals int")
        found = sd.remove_repeats(docs, whole_characters=False, group_limit=limit)
        texts = {(d, len((t or "").encode())): t for d, t in rows}
        assert found.columns == ["doc_id", "text", "start", "leaders", "intervals", "n_bytes", "n_removed", "n_spans"]
        got = found.collect()
        assert len(got) == len(rows)
        for r in got:
            key = r["doc_id"], texts[r["doc_id"], r["n_bytes"]]
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["text"])) == want[key]


def test_whole_characters_and_long_texts(spark):
    passage = "é" * 80
    docs = spark.createDataFrame(
        [(1, "a" + passage), (2, "bc" + passage + "ü"), (3, None), (4, "x" * 100_000), (5, "the end")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in sd.remove_repeats(docs).collect()}
    assert rows[2]["text"] == "bcü" and rows[1]["text"] == "aé"  # the run of é repeats itself
    assert rows[3]["text"] is None and rows[5]["text"] == "the end"
    assert rows[4]["text"] == "x" and rows[4]["n_spans"] == 1
    assert sd.remove_repeats(docs.limit(0)).count() == 0


def test_sorting():
    r = random.Random(1)
    for _ in range(50):
        strings = ["".join(r.choice("ab") for _ in range(r.randrange(40))).encode() for _ in range(60)]
        strings += [b"ab" * 20 + s for s in strings[:30]]
        assert [strings[i] for i in sd.blind_trie_order(strings)] == sorted(strings)
        group = np.sort(np.array([r.randrange(4) for _ in strings]))
        order = sd.deep_shallow_order(group, strings, 80)
        assert [(group[i], strings[i]) for i in order] == sorted(zip(group, strings))


def test_texts_of_one_id_stay_apart(spark):
    """Different texts under one id, or under none, whose hashes agree in the upper 31 bits."""
    texts = spark.range(200_000).select(F.concat(*[F.sha2(F.concat(F.lit(s), F.col("id").cast("string")), 256) for s in "abc"]).alias("text"))
    some = texts.groupBy(F.shiftrightunsigned(F.xxhash64("text"), 33)).agg(F.sort_array(F.collect_list("text")).alias("t")).where(F.size("t") > 1)
    a, b = some.first()["t"][:2]
    for id_ in (7, None):
        rows = [(3, a[20:140]), (id_, a), (id_, b), (1, "q" + b[:30])]
        found = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), whole_characters=False).collect()
        want = brute(rows, 100)
        got = [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["text"])) for r in found if r["doc_id"] == id_]
        assert sorted(got) == sorted([want[id_, a], want[id_, b]]) and len(found) == 4


def test_anchors_do_not_depend_on_pieces():
    r = random.Random(3)
    texts = ["".join(r.choice("abc ") for _ in range(n)).encode() for n in (5, 99, 100, 101, 350, 1_000, 7_777)] + [b"", b"z" * 3_000]
    want = sd.anchors_of(texts, 100, 1 << 20)
    for piece in (1, 64, 130, 999):
        for a, b in zip(want, sd.anchors_of(texts, 100, piece), strict=True):
            assert np.array_equal(a, b)
    number, place, *_, before, after = want
    assert set(number.tolist()) == {2, 3, 4, 5, 6, 8}
    for i, at in zip(number.tolist(), place.tolist(), strict=True):
        assert 0 <= at <= len(texts[i]) - 32
    assert (before <= 68).all() and (after <= 68).all()


def test_contexts_are_handed_on_in_bounded_runs():
    import pyarrow as pa

    texts = [None, "é" + "a" * 40_000, "b" * 200]
    places = [[], [{"gram": i, "pos": i} for i in range(30_000)], [{"gram": -1, "pos": 5}]]
    kind = pa.list_(pa.struct([("gram", pa.int64()), ("pos", pa.int32())]))
    parts = list(sd.contexts_in(
        pa.array([7, 8, 9]), pa.array([1, 2, 3]), pa.array(texts), pa.array(places, kind), 68))
    assert max(p.num_rows for p in parts) <= sd.CONTEXTS
    rows = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    assert len(rows) == 30_001 and rows[-1] == (-1, 9, 3, 5, b"b" * 5, b"b" * 68)
    assert rows[3] == (3, 8, 2, 3, b"a" + "é".encode()[::-1], b"a" * 68)
