import math
import random

from pyspark.sql import functions as F

from sourcequarry.llm import vector_file
from sourcequarry.runtime import materialize


def brute(rows, k):
    vectors = []
    for vec_id, x in rows:
        if vec_id is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            vectors.append((vec_id, [math.floor(v) for v in x]))
    out = []
    for i, (q, a) in enumerate(vectors):
        if q % 5 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), v) for j, (v, b) in enumerate(vectors) if j != i)[:k]
            out += [(q, n + 1, v, -s) for n, (s, v) in enumerate(scored)]
    return sorted(out)


def search(spark, rows, k):
    table = spark.createDataFrame(rows, "vec_id long, x array<double>")
    vectors = materialize(vector_file.integer_vectors(table, F.col("x")), "v")
    found = vector_file.exact_top_k(vectors, vectors.where("vec_id % 5 = 0"), k)
    return sorted(tuple(r) for r in found.collect())


def test_equals_brute_force_with_ties_and_small_blocks(spark, monkeypatch):
    r = random.Random(1)
    rows = [(i, [float(r.randrange(-9, 9)) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, [3.0] * 6) for i in range(60)]  # one very common vector
    rows += [(7, [0.5] * 6), (7, [0.5] * 6), (None, [1.0] * 6), (300, None), (305, [1.0, None, 2.0]), (310, [math.inf] * 6), (315, [math.nan] * 6)]
    rows += [(320, [4.0, 5.0]), (325, []), (10, [9.0] * 6), (10, [9.0] * 6), (11, [8.0] * 6), (11, [-8.0] * 6)]
    for block, strip, queries in ((8192, 16, 1024), (20, 2, 7)):
        monkeypatch.setattr(vector_file, "BLOCK", block)
        monkeypatch.setattr(vector_file, "STRIP", strip)
        monkeypatch.setattr(vector_file, "QUERIES", queries)
        assert search(spark, rows, 5) == brute(rows, 5)
    assert search(spark, rows[:4], 20) == brute(rows[:4], 20)


def test_empty_table(spark):
    assert search(spark, [], 3) == []
    assert search(spark, [(5, [1.0])], 3) == []


def test_bounds_hold_every_score():
    import numpy as np

    r = np.random.default_rng(2)
    exact = r.integers(-50, 50, (200, 8))
    cells = vector_file.Cells(exact.min(0).tolist(), exact.max(0).tolist(), 4)
    low, high = cells.bounds(cells.of(exact).astype(np.int64))
    assert (low <= exact).all() and (exact <= high).all()
