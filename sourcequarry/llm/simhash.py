"""SimHash near-duplicates by exact tiled comparison.

Every document gets a fingerprint of the hashes of its word shingles. Equal fingerprints are
merged first, so copies cost nothing further. The different ones are packed into tiles by the
population counts of their halves; tiles are paired only with tiles whose counts differ by no
more than the radius, and a pair is compared completely: exclusive-or and bit counts over the
whole tile in numpy. A pair of tiles gives the edges of a spanning forest of its links, not the
links, so a large group of near copies stays linear. Components come from alternating stars,
with each round stored.

Every fingerprint meets every other one within reach: nothing is sampled and no group is
capped. What it costs grows with the square of the number of different fingerprints, divided by
what the counts rule out.

Defined results: null and empty texts have no words and fingerprint zero, and are linked like
any other; a text shorter than a shingle is one shingle; rows with equal ids stay separate rows;
null ids take part, and a component's id is its smallest id that is not null; an empty table
gives none.
"""

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sourcequarry.llm.common import fresh, slices
from sourcequarry.runtime import materialize

SEED = 42
#: Fingerprints of a tile, and cells of one comparison.
TILE, CELLS = 2048, 1 << 21

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def shingle_hashes(text: str | None, n_words: int) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = min(n_words, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - n + 1].tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[n - 1:].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray, bits: int = 64) -> bytes:
    """A bit is set if it is set in over half the hashes. Fingerprints beyond 64 bits take
    further words from each hash by mixing. Bytes run from the highest bit down."""
    if not len(hashes):
        return bytes(bits // 8)
    wide = _wide(hashes, bits)
    n_bytes = bits // 8
    each = wide.view(np.uint8).reshape(len(hashes), n_bytes) + 256 * np.arange(n_bytes)
    counts = np.bincount(each.ravel(), minlength=256 * n_bytes).reshape(n_bytes, 256) @ _BITS
    return np.packbits(2 * counts > len(hashes)).tobytes()


def _wide(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Each hash and the further words that are mixed from it."""
    wide = np.empty((len(hashes), bits // 64), ">u8")
    wide[:, 0] = hashes
    for i in range(1, bits // 64):
        x = hashes + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        wide[:, i] = x ^ (x >> np.uint64(31))
    return wide


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprints(
    docs: DataFrame, n_words: int, bits: int = 64, text: str = "text", out: str = "fingerprint", repeats: bool = True,
) -> DataFrame:
    """``docs`` without their text, with the fingerprint and the bit counts of its halves.
    Without ``repeats`` each different shingle counts once."""
    high, low = f"{out}_high", f"{out}_low"
    kept = [c for c in docs.columns if c.lower() not in (text.lower(), out, high, low)]
    rows = docs.select(*kept, text)
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField(out, T.BinaryType()),
                           T.StructField(high, T.IntegerType()), T.StructField(low, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            hashes = (shingle_hashes(t.as_py(), n_words) for t in part.column(len(kept)))
            prints = [fingerprint(h if repeats else np.unique(h), bits) for h in hashes]
            half = np.bitwise_count(np.frombuffer(b"".join(prints), np.uint8)).reshape(-1, 2, bits // 16).sum(2, dtype=np.int32)
            yield pa.record_batch(
                [*part.columns[:len(kept)], pa.array(prints, pa.binary()), pa.array(half[:, 0]), pa.array(half[:, 1])],
                names=[*kept, out, high, low])

    return rows.mapInArrow(run, schema)


def components(prints: DataFrame, radius: int, bits: int = 64, id: str = "doc_id", column: str = "fingerprint") -> DataFrame:  # noqa: A002
    """fingerprint, root (the least fingerprint of its component) and component_id (the smallest
    id) of every different fingerprint of ``prints``, as ``fingerprints`` gives and stores them."""
    different = prints.groupBy(F.col(column).alias("print"), F.col(f"{column}_high").alias("high"), F.col(f"{column}_low").alias("low")).agg(
        F.min(id).alias("first"))
    different = materialize(different, "fingerprints")
    edges = materialize(links(different, radius, bits), "links")
    roots = connect(edges)
    rooted = different.join(roots.select(F.col("node").alias("print"), "root"), "print", "left").select(
        "print", F.coalesce("root", "print").alias("root"), "first")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(smallest, "root").select(F.col("print").alias(column), "root", "component_id")


def near_duplicates(
    docs: DataFrame, n_words: int = 3, bits: int = 64, radius: int = 2, id: str = "doc_id", text: str = "text",  # noqa: A002
    repeats: bool = True,
) -> DataFrame:
    """``docs`` without their text, with ``fingerprint`` and ``component_id``. Without ``repeats``
    a shingle counts once however often it occurs."""
    prints = materialize(fingerprints(docs, n_words, bits, text, repeats=repeats), "prints")
    found = components(prints, radius, bits, id).select("fingerprint", "component_id")
    kept = [c for c in prints.columns if c not in ("fingerprint_high", "fingerprint_low", "component_id")]
    return prints.select(*kept).join(found, "fingerprint", "left").select(*kept, "component_id")


def keep_one_of_each(
    docs: DataFrame, n_words: int = 3, bits: int = 64, radius: int = 2, id: str = "doc_id", text: str = "text", repeats: bool = True,  # noqa: A002
) -> DataFrame:
    """One row of each component stays, that with the smallest id (null last, then by the text's
    hash), with all its columns. Only ids and hashes take part in the choice; whole texts move
    once, to meet the chosen ids, and rows alike in id and text are told there."""
    key, hashed = fresh(docs, "row_key", "text_hash")
    docs = docs.withColumns({
        key: F.when(F.col(id).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(id).cast("string"))),
        hashed: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    rows = docs.select(F.col(id).alias("id"), F.col(key).alias("key"), F.col(hashed).alias("hash"), F.col(text).alias("text"))
    prints = materialize(fingerprints(rows, n_words, bits, repeats=repeats), "prints")
    found = components(prints, radius, bits, "id").select("fingerprint", "root")
    first = F.min(F.struct(F.col("id").isNull(), "id", "key", "hash")).alias("best")
    each = prints.groupBy("fingerprint").agg(first)
    chosen = each.join(found, "fingerprint").groupBy("root").agg(F.min("best").alias("best")).select(
        F.col("best.key").alias(key), F.col("best.hash").alias(hashed))
    return docs.join(chosen, [key, hashed], "left_semi").dropDuplicates([key, hashed]).drop(key, hashed)


# --- links -----------------------------------------------------------------------------------

def links(different: DataFrame, radius: int, bits: int) -> DataFrame:
    """Edges (u, v) that connect what fingerprints within the radius connect."""
    width = max(1, radius)
    classed = different.select("print", F.floor(F.col("high") / width).cast("int").alias("x"), F.floor(F.col("low") / width).cast("int").alias("y"))
    sizes = materialize(classed.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")), "class-sizes")
    dealt = classed.join(sizes, ["x", "y"]).select(
        "x", "y", F.pmod(F.xxhash64("print"), F.ceil(F.col("n") / TILE)).cast("int").alias("part"), "print")
    tiles = materialize(
        dealt.repartition("x", "y", "part").sortWithinPartitions("x", "y", "part").mapInArrow(_pack, _TILES), "tiles")
    salts = max(1, math.isqrt(tiles.count()))  # the pairs of a class are dealt to a grid of salts
    steps = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]  # half of the neighbours: each pair of tiles once
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps]))
    left = (
        tiles.select("x", "y", F.col("tile").alias("tile_a"), F.col("prints").alias("prints_a"), near.alias("step"))
        .select((F.col("x") + F.col("step.a")).alias("x"), (F.col("y") + F.col("step.b")).alias("y"), "tile_a", "prints_a",
                ((F.col("step.a") == 0) & (F.col("step.b") == 0)).alias("own"))
        .join(sizes.select("x", "y"), ["x", "y"], "left_semi")  # neighbours that hold anything
        .withColumns({"row": _salt("tile_a", salts), "column": F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))}))
    right = tiles.select("x", "y", F.col("tile").alias("tile_b"), F.col("prints").alias("prints_b"), _salt("tile", salts).alias("column"),
                         F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("row"))
    pairs = left.join(right, ["x", "y", "row", "column"]).where(~F.col("own") | (F.col("tile_a") <= F.col("tile_b")))
    pairs = pairs.select("prints_a", "prints_b", (F.col("own") & (F.col("tile_a") == F.col("tile_b"))).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, same in zip(*batch.columns, strict=True):
                found = list(_tile_links(a.as_py(), b.as_py(), same.as_py(), radius, bits))
                yield pa.record_batch([pa.array([e[i] for e in found], pa.binary()) for i in (0, 1)], names=["u", "v"])

    return pairs.mapInArrow(run, "u binary, v binary").distinct()


_TILES = "x int, y int, tile string, prints binary"


def _salt(tile: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(tile), F.lit(salts)).cast("int")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (x, y, part) as tiles: one for each part, more where it came out large."""
    key, held = None, []

    def tile() -> pa.RecordBatch:
        return pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([uuid.uuid4().hex]),
                                pa.array([b"".join(held)], pa.binary())], names=["x", "y", "tile", "prints"])

    for batch in batches:
        for x, y, part, print_ in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "part", "print")), strict=True):
            if held and (key != (x, y, part) or len(held) == 2 * TILE):
                yield tile()
                held.clear()
            key = x, y, part
            held.append(print_)
    if held:
        yield tile()


def _tile_links(a: bytes, b: bytes, same: bool, radius: int, bits: int) -> Iterator[tuple[bytes, bytes]]:
    """Edges of a spanning forest of the links between two tiles, or within one."""
    n_words, size = bits // 64, bits // 8
    left, right = (np.frombuffer(x, "<u8").reshape(-1, n_words) for x in (a, b))
    if not same and _counts_apart(left, right) > radius:
        return
    label = np.arange(len(left) if same else len(left) + len(right))
    shift = 0 if same else len(left)
    step = max(1, CELLS // len(right))
    for start in range(0, len(left), step):
        part = left[start:start + step]
        distance = np.bitwise_count(part[:, None, 0] ^ right[None, :, 0])
        for w in range(1, min(2, n_words)):
            distance = distance + np.bitwise_count(part[:, None, w] ^ right[None, :, w])
        row, column = np.nonzero(distance <= radius)
        if n_words > 2 and len(row):  # the rest only where the first two words leave it open
            rest = np.bitwise_count(part[row, 2:] ^ right[column, 2:]).sum(1, dtype=np.int64) + distance[row, column]
            row, column = row[rest <= radius], column[rest <= radius]
        row = row + start
        if same:
            row, column = row[column > row], column[column > row]
        cuts = np.flatnonzero(np.diff(row)) + 1
        for i, others in zip(row[np.concatenate([[0], cuts])] if len(row) else [], np.split(column, cuts), strict=False):
            labels = label[others + shift]
            if (labels == label[i]).all():
                continue
            joined, at = np.unique(labels, return_index=True)
            for other_label, j in zip(joined.tolist(), others[at].tolist(), strict=True):
                if other_label != label[i]:
                    yield a[i * size:(i + 1) * size], b[j * size:(j + 1) * size]
            label[np.isin(label, joined)] = label[i]


def _counts_apart(left: np.ndarray, right: np.ndarray) -> int:
    """The least number of bits in which rows of the two can differ, by their counts alone."""
    halves = [np.bitwise_count(x.view(np.uint8).reshape(len(x), 4, -1)).sum(2, dtype=np.int64) for x in (left, right)]
    (low_a, high_a), (low_b, high_b) = ((h.min(0), h.max(0)) for h in halves)
    return int(np.maximum(0, np.maximum(low_a - high_b, low_b - high_a)).sum())


# --- components ------------------------------------------------------------------------------

def connect(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of all nodes of stored ``edges`` (u, v).

    Large and small stars in turn, each round stored, until no edge changes."""
    before = None
    while True:
        edges = materialize(_small_star(_large_star(edges)), "stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node points to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours point to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    met = edges.join(least, "u")
    moved = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
