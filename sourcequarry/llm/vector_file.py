"""Exact top-k search by inner product with a vector-approximation file.

Every component falls into one of a fixed number of equal cells between the least and the
greatest value of its dimension, which one aggregation finds. The file keeps, block by block,
ids, cells (a byte each) and exact vectors in columns of their own. A search takes a block of
queries against a strip of blocks: it scans the cells for a lower and an upper bound of every
score, then reads exact vectors in the order of their upper bounds until the next one is below
the k-th exact score, which then is certain. What is known of the k-th score goes on from block
to block of a strip; the strips of a query are merged by score.

Blocks and strips are dealt by a hash of the row's number, so equal or close vectors spread evenly, and
every group has a size that does not depend on the table.

Defined results: vectors that are null or hold a null or a component that is not finite take no
part, nor do rows without an id; rows of the same id each count, as candidates of each other
too; shorter vectors end in zeros; equal scores are ranked by smaller id; fewer than k candidates give fewer
rows; an empty table gives none. Scores must fit in 62 bits, or the search is refused.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sourcequarry.runtime import materialize

CELLS = 32
#: Vectors of a block, blocks of a strip, and queries that meet a strip at once.
BLOCK, STRIP, QUERIES = 8192, 16, 1024
#: Exact vectors that are read at a time.
STEP = 64

FILE = "block int, rows binary, ids binary, cells binary, vectors binary"
FOUND = "query_row bigint, query_id bigint, vec_id bigint, score bigint"


def integer_vectors(rows: DataFrame, vector: Column, id: str = "vec_id") -> DataFrame:  # noqa: A002
    """row (a number of its own), vec_id and vector (array of long) of every row whose vector is
    whole and finite. Store it before it is used: a row keeps its number only then."""
    whole = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(vector, lambda x: F.floor(x).cast("long"))
    return rows.where(F.col(id).isNotNull() & whole).select(
        F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("vec_id"), scaled.alias("vector"))


class Cells:
    """Equal cells between the least and the greatest value of each dimension."""

    def __init__(self, low: list[int], high: list[int], cells: int = CELLS):
        self.low, self.high = np.array(low, np.int64), np.array(high, np.int64)
        self.width = (self.high - self.low) // cells + 1

    @property
    def dimensions(self) -> int:
        return len(self.low)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.low) // self.width).astype(np.uint8)

    def bounds(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = self.low + cells * self.width
        return low, np.minimum(low + self.width - 1, self.high)


def find_cells(vectors: DataFrame, cells: int = CELLS) -> Cells:
    """``vectors``: as ``integer_vectors`` gives them."""
    n = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    at = [F.coalesce(F.get("vector", F.lit(i)), F.lit(0)) for i in range(n)]
    ends = vectors.agg(*[f(x) for x in at for f in (F.min, F.max)]).first() if n else []
    low, high = list(ends[0::2]), list(ends[1::2])
    if sum(max(abs(a), abs(b)) ** 2 for a, b in zip(low, high, strict=True)) >= 1 << 62:
        raise ValueError("scores would not fit in 62 bits")
    return Cells(low, high, cells)


def write_file(vectors: DataFrame, cells: Cells, n_vectors: int, label: str = "va-file") -> DataFrame:
    """The stored approximation file: one row for each block."""
    n_blocks = -(-n_vectors // BLOCK) or 1

    def pack(table: pa.Table) -> pa.Table:
        rows, ids, exact = _arrays(table, cells.dimensions)
        return _row([("block", table["block"][0].as_py(), pa.int32()), ("rows", rows.tobytes(), pa.binary()), ("ids", ids.tobytes(), pa.binary()),
                     ("cells", cells.of(exact).tobytes(), pa.binary()), ("vectors", exact.tobytes(), pa.binary())])

    blocks = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int"))
    return materialize(blocks.groupBy("block").applyInArrow(pack, FILE), label)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors`` for each of ``queries``, but its own
    row. ``vectors`` as ``integer_vectors`` gives them, stored; ``queries`` are some of their rows."""
    cells, n = find_cells(vectors.unionByName(queries)), vectors.count()
    file = write_file(vectors, cells, n)
    n_strips, n_parts = -(-n // (BLOCK * STRIP)) or 1, -(-queries.count() // QUERIES) or 1
    d = cells.dimensions

    def search(query_rows: pa.Table, file_rows: pa.Table) -> pa.Table:
        query_at, query_ids, wanted = _arrays(query_rows, d)
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in query_ids]
        for i in range(file_rows.num_rows):
            at, ids = (np.frombuffer(file_rows[c][i].as_py(), np.int64) for c in ("rows", "ids"))
            codes = np.frombuffer(file_rows["cells"][i].as_py(), np.uint8).reshape(-1, d)
            exact = np.frombuffer(file_rows["vectors"][i].as_py(), np.int64).reshape(-1, d)
            best = list(_search_block(cells, query_at, wanted, at, ids, codes, exact, best, k))
        found = [(r, q, v, s) for r, q, (scores, of) in zip(query_at.tolist(), query_ids.tolist(), best, strict=True)
                 for s, v in zip(scores.tolist(), of.tolist(), strict=True)]
        return pa.table({c: pa.array([f[i] for f in found], pa.int64()) for i, c in enumerate(("query_row", "query_id", "vec_id", "score"))})

    parts, strips = (F.sequence(F.lit(0), F.lit(x - 1)) for x in (n_parts, n_strips))
    asked = queries.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(n_parts)).cast("int")).withColumn("strip", F.explode(strips))
    held = file.withColumn("strip", F.col("block") % n_strips).withColumn("part", F.explode(parts))
    found = asked.groupBy("part", "strip").cogroup(held.groupBy("part", "strip")).applyInArrow(search, FOUND)
    ranked = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_block(cells, query_at, wanted, at, ids, codes, exact, best, k) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the k best so far (scores, ids), after this block."""
    low, high = (x.astype(np.float64) for x in cells.bounds(codes.astype(np.int64)))
    step = max(1, (1 << 21) // len(ids))
    for start in range(0, len(query_at), step):
        q = wanted[start:start + step].astype(np.float64)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
        slack = 1e-9 * np.maximum(np.abs(least), np.abs(most)) if np.abs(most).max(initial=0) >= 1 << 52 else 0
        least, most = least - slack, most + slack
        own = query_at[start:start + step, None] == at
        least[own] = most[own] = -np.inf
        certain = np.partition(least, -k, axis=1)[:, -k] if len(ids) >= k else np.full(len(q), -np.inf)
        for row, most_of in enumerate(most):
            scores, of = best[start + row]
            at_least = max(certain[row], scores[k - 1] if len(scores) >= k else -np.inf)
            likely = np.flatnonzero((most_of >= at_least) & (most_of > -np.inf))
            likely = likely[np.argsort(-most_of[likely], kind="stable")]
            for i in range(0, len(likely), STEP):
                some = likely[i:i + STEP]
                if len(scores) >= k and most_of[some[0]] < scores[k - 1]:
                    break  # the k-th result is certain
                scores = np.concatenate([scores, exact[some] @ wanted[start + row]])
                of = np.concatenate([of, ids[some]])
                order = np.lexsort((of, -scores))[:k]
                scores, of = scores[order], of[order]
            yield scores, of


def _arrays(table: pa.Table, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, ids = (table[c].to_numpy().astype(np.int64) if table.num_rows else np.empty(0, np.int64) for c in ("row", "vec_id"))
    exact = np.zeros((len(ids), dimensions), np.int64)
    vectors = table["vector"].combine_chunks() if table.num_rows else None
    if vectors is not None:
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        lengths = vectors.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(ids)), lengths)
        place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        exact[row, place] = vectors.flatten().to_numpy()
    return rows, ids, exact


def _row(values: list) -> pa.Table:
    return pa.table({name: pa.array([value], kind) for name, value, kind in values})
