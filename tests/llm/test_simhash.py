import random

import numpy as np

from sourcequarry.llm import simhash
from sourcequarry.runtime import materialize


def test_tile_links_connect_what_is_near():
    r = np.random.default_rng(4)
    for bits, radius in ((64, 2), (256, 40)):
        base = r.integers(0, 2**63, (30, bits // 64), dtype=np.uint64)
        near = np.repeat(base, 4, 0)
        near[:, 0] ^= np.uint64(1) << r.integers(0, 64, len(near)).astype(np.uint64)
        rows = [x.astype("<u8").tobytes() for x in near]
        distance = lambda a, b: (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()

        def parts(edges):
            label = {x: x for x in rows}
            for _ in rows:
                for a, b in edges:
                    label[a] = label[b] = min(label[a], label[b])
            return label

        true = [(a, b) for a in rows for b in rows if distance(a, b) <= radius]
        found = list(simhash._tile_links(b"".join(rows), b"".join(rows), True, radius, bits))
        assert len(found) < len(rows) and parts(found) == parts(true)
        left, right = rows[:50], rows[50:]
        across = list(simhash._tile_links(b"".join(left), b"".join(right), False, radius, bits))
        true = [(a, b) for a in left for b in right if distance(a, b) <= radius]
        assert parts(across) == parts(true) and all(distance(a, b) <= radius for a, b in across)


def test_components_of_chains(spark):
    r = random.Random(2)
    nodes = [f"{i:04d}".encode() for i in range(200)]
    edges = [(nodes[i], nodes[i + 1]) for i in range(120)] + [(nodes[150], nodes[i]) for i in range(151, 180)] + [(nodes[190], nodes[185])]
    edges = [e if r.random() < 0.5 else e[::-1] for e in edges]
    stored = materialize(spark.createDataFrame(edges, "u binary, v binary"), "e")
    roots = {bytes(x["node"]): bytes(x["root"]) for x in simhash.connect(stored).collect()}
    want = {nodes[i]: nodes[0] for i in range(121)} | {nodes[i]: nodes[150] for i in range(150, 180)} | {nodes[190]: nodes[185], nodes[185]: nodes[185]}
    assert {**{n: n for n in want}, **roots} == want


TEXT = " ".join(f"word{i}" for i in range(300))


def near(*changed):
    words = TEXT.split()
    for i in changed:
        words[i] = "other"
    return " ".join(words)


def grouped(rows, n_words=3, bits=64, radius=2):
    """The group of every row, by comparing all fingerprints."""
    prints = [int.from_bytes(simhash.fingerprint(simhash.shingle_hashes(r[1], n_words), bits)) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def test_near_duplicates_stay_once_and_others_stay(spark):
    rows = [(5, TEXT, "a"), (3, TEXT + " more", "b"), (9, near(200, 20), None), (9, near(200, 20), None), (None, TEXT, "n"),
            (1, "quite another text of a few words", "c"), (2, None, "d"), (4, "", "e"), (4, "", "e"), (6, "one", "f"), (7, "two", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").selectExpr("*", "1 AS row_key", "2 AS node")
    group = grouped(rows)
    assert group[0] == group[1] == group[4] and group[6] == group[7]
    least = {g: min(r[0] for r, of in zip(rows, group) if of == g and r[0] is not None) for g in group}
    kept = simhash.keep_one_of_each(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())
    assert kept.columns == docs.columns
    found = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(found, key=str) == sorted([(r[0], least[g]) for r, g in zip(rows, group)], key=str)
    assert simhash.keep_one_of_each(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_very_long_and_repeated_texts(spark):
    docs = spark.createDataFrame([("1", "same " * 300_000), ("2", "same " * 299_999), ("3", TEXT)], "doc_id string, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_each(docs).collect()) == ["1", "3"]


def test_groups_of_near_copies_in_many_tiles(spark, monkeypatch):
    """Small tiles, so that a class fills many of them, and every way of meeting is taken."""
    monkeypatch.setattr(simhash, "TILE", 16)
    r = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    texts = [[r.choice(words) for _ in range(n)] for n in [*range(1, 30), 40, 80, 300, 900] for _ in range(4)]
    for base in texts[::2]:
        for changes in (0, 1, 1, 2):
            changed = list(base)
            for i in r.sample(range(len(base)), min(changes, len(base) // 4)):
                changed[i] = r.choice(words)
            texts.append(changed + [r.choice(words)] * (len(base) > 200))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for radius in (2, 6):
        group = grouped(rows, radius=radius)
        assert 20 < len(set(group)) < len(rows) - 20
        kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), radius=radius)
        assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(group))
