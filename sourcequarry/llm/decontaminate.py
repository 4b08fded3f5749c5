"""Benchmark decontamination with column functions only.

The normalised n-grams of the benchmark become a hash set: an array of buckets, each a short
list of (hash, words, items). It reaches the executors inside the plan, as one constant, and
every document looks its own windows up where it lies: no row is exploded, nothing is
shuffled, and Python runs nowhere. A benchmark beyond ``set_limit`` windows goes another way:
document windows are joined to the benchmark's by hash, and the hits of a document come back
to it by its key. Both ways verify a hit by comparing words.

Defined results: a null or empty text has no words and no hits; an item without words gives
no window; an item with fewer than ``n`` words is one window of its own length; repeated
items and repeated documents each count by themselves; an empty benchmark leaves every
document clean; a null item id is left out of the list of items, its windows still hit;
columns of the input that carry a result's name are replaced, all others stay.
"""

import json

from pyspark.sql import Column, DataFrame, functions as F

from sourcequarry.llm.common import fresh, words_of

#: Distinct benchmark windows that go to every executor (about 200 bytes each).
SET_LIMIT = 100_000
#: Distinct benchmark windows whose hashes go to every executor (about 20 bytes each).
HASH_LIMIT = 2_000_000
#: Buckets for each window of the set: most lookups find an empty bucket.
BUCKETS_PER_WINDOW = 4

RESULT = ["n_words", "n_hit", "items", "spans"]


def benchmark_windows(benchmark: DataFrame, n: int, item_id: str, item_text: str) -> DataFrame:
    """Distinct windows: m (its number of words), h, words (space-joined), items (sorted)."""
    items = benchmark.select(F.col(item_id).alias("item"), words_of(F.col(item_text)).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("m", F.least(F.size("w"), F.lit(n)))
    places = F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)
    windows = items.select("item", "m", F.explode(F.transform(places, lambda i: F.slice("w", i, F.col("m")))).alias("w"))
    return windows.groupBy("m", F.array_join("w", " ").alias("words"), _window_hash(_word_hashes(F.col("w"))).alias("h")).agg(
        F.array_sort(F.collect_set("item")).alias("items"))


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    set_limit: int = SET_LIMIT,
    hash_limit: int = HASH_LIMIT,
) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside a hit), items (ids whose windows occur) and
    spans (merged runs of hit words, as [start, end) word positions)."""
    windows = benchmark_windows(benchmark, n, item_id, item_text)
    kind = windows.schema["items"].dataType.elementType
    small = windows.withColumn("items", F.col("items").cast("array<string>")).limit(set_limit + 1).collect()
    words, found = fresh(docs, "words", "found")
    docs = docs.withColumn(words, words_of(F.col(text)))
    if len(small) <= set_limit:
        hits = F.transform(_look_up(small, F.col(words)), lambda x: F.struct(
            x["start"].alias("start"), x["m"].alias("m"), F.transform(x["items"], lambda i: i.cast(kind)).alias("items")))
    else:
        hashes = windows.select("m", "h").distinct().limit(hash_limit + 1).collect()
        docs = _joined(docs, windows, key, text, words, found, hashes if len(hashes) <= hash_limit else None)
        hits = _verified(F.coalesce(F.col(found), F.array().cast(docs.schema[found].dataType)), F.col(words))
    docs = docs.withColumn(found, F.array_sort(hits))
    spans = _merged(F.col(found))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform(F.col(found), lambda x: x["items"]))))
    kept = [c for c in docs.columns if c not in (words, found) and c.lower() not in RESULT]
    return (
        docs.select(*kept, F.size(words).cast("long").alias("n_words"), ids.alias("items"), spans.alias("spans"))
        .withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + (s["end"] - s["start"])))
        .select(*kept, *RESULT))


def drop_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Only the documents without a hit, with their own columns."""
    names = fresh(docs, *[f"hit_{c}" for c in RESULT])
    hits = find_hits(_aside(docs, names), benchmark, **options).where(F.col("n_hit") == 0)
    return _restored(hits, docs, names)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """Every document, without the words of its hits and what stands between them."""
    names = fresh(docs, *[f"hit_{c}" for c in RESULT])
    hits = find_hits(_aside(docs, names), benchmark, text=text, **options)
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    first = F.when(F.col(text).rlike(r"^[\x00-\x2F\x3A-\x60\x7B-\x7F]"), 1).otherwise(0)
    inside = lambda i: F.exists("spans", lambda s: (i >= 2 * s["start"] + first) & (i <= 2 * (s["end"] - 1) + first))
    cleaned = F.array_join(F.filter(pieces, lambda p, i: ~inside(i)), "")
    return _restored(hits.withColumn(text, F.when(F.size("spans") > 0, cleaned).otherwise(F.col(text))), docs, names)


def _aside(docs: DataFrame, names: list[str]) -> DataFrame:
    """Columns that carry a result's name are renamed for the time being."""
    for column in docs.columns:
        if column.lower() in RESULT:
            docs = docs.withColumnRenamed(column, names[RESULT.index(column.lower())])
    return docs


def _restored(hits: DataFrame, docs: DataFrame, names: list[str]) -> DataFrame:
    return hits.select(*[
        F.col(names[RESULT.index(c.lower())]).alias(c) if c.lower() in RESULT else F.col(c) for c in docs.columns])


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _window_hash(word_hashes: Column) -> Column:
    return F.xxhash64(word_hashes)


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(words: Column, m: int) -> Column:
    """Starts of the windows of m words, from 0."""
    return F.when(F.size(words) >= m, F.sequence(F.lit(0), F.size(words) - m)).otherwise(F.array().cast("array<int>"))


def _at(words: Column, place: Column, m) -> Column:
    return F.array_join(F.slice(words, place + 1, m), " ")


def _look_up(windows: list, words: Column) -> Column:
    """Hits by lookup in the constant set: array of (start, m, items)."""
    parts = [F.array().cast("array<struct<start:int,m:int,items:array<string>>>")]
    for m in sorted({w["m"] for w in windows}):
        of_m = [w for w in windows if w["m"] == m]
        buckets = [[] for _ in range(BUCKETS_PER_WINDOW * len(of_m))]
        for w in of_m:
            buckets[w["h"] % len(buckets)].append({"h": w["h"], "words": w["words"], "items": w["items"]})
        held = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<h:bigint,words:string,items:array<string>>>>")
        parts.append(_let(words, lambda ws: _let(_word_hashes(ws), lambda hs: _let(
            held, lambda held_set: _hits_of_length(m, len(buckets), ws, hs, held_set)))))  # noqa: B023
    return F.concat(*parts)


def _hits_of_length(m: int, n_buckets: int, words: Column, hashes: Column, held: Column) -> Column:
    def bucket(h: Column) -> Column:
        return F.get(held, F.pmod(h, F.lit(n_buckets)).cast("int"))

    looked_up = F.transform(_places(words, m), lambda i: F.struct(
        i.alias("start"), _window_hash(F.slice(hashes, i + 1, m)).alias("h")))
    likely = F.filter(looked_up, lambda x: F.exists(bucket(x["h"]), lambda e: e["h"] == x["h"]))
    named = F.transform(likely, lambda x: F.struct(
        x["start"].alias("start"), F.lit(m).alias("m"),
        F.get(F.filter(bucket(x["h"]), lambda e: e["words"] == _at(words, x["start"], m)), F.lit(0))["items"].alias("items")))
    return F.filter(named, lambda x: x["items"].isNotNull())


def _likely(m: int, hashes: list | None, words: Column) -> Column:
    """(start, h) of a document's windows of m words, only of those in the set of hashes if one is given."""
    if hashes is None:
        chosen = lambda placed: placed
    else:
        of_m = [r["h"] for r in hashes if r["m"] == m]
        buckets = [[] for _ in range(BUCKETS_PER_WINDOW * len(of_m))]
        for h in of_m:
            buckets[h % len(buckets)].append(h)
        held = F.from_json(F.lit(json.dumps(buckets)), "array<array<bigint>>")
        chosen = lambda placed: _let(held, lambda h_set: F.filter(placed, lambda x: F.array_contains(
            F.get(h_set, F.pmod(x["h"], F.lit(len(buckets))).cast("int")), x["h"])))
    return _let(_word_hashes(words), lambda hs: chosen(F.transform(_places(words, m), lambda i: F.struct(
        i.alias("start"), _window_hash(F.slice(hs, i + 1, m)).alias("h")))))


def _joined(docs, windows, key, text, words, found, hashes) -> DataFrame:
    """``docs`` with the windows whose hash they share, for a benchmark of any size.

    Rows are told apart by key and text: rows alike in both have the same hits."""
    digest, place = fresh(docs, "digest", "place")
    docs = docs.withColumn(digest, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    lengths = [r["m"] for r in windows.select("m").distinct().collect()]  # n values at most
    seen = None
    for m in sorted(lengths):
        placed = _likely(m, hashes, F.col(words))
        at = docs.select(key, digest, F.explode(placed).alias(place))
        at = at.select(key, digest, F.col(place)["start"].alias("start"), F.lit(m).alias("m"), F.col(place)["h"].alias("h"))
        seen = at if seen is None else seen.unionByName(at)
    hits = seen.distinct().join(windows, ["m", "h"]).groupBy(key, digest).agg(
        F.collect_list(F.struct("start", "m", "items", F.col("words").alias("words"))).alias(found))
    rows, hits = docs.alias("d"), hits.alias("x")
    same = F.col(f"d.{key}").eqNullSafe(F.col(f"x.{key}")) & (F.col(f"d.{digest}") == F.col(f"x.{digest}"))
    return rows.join(hits, same, "left").select("d.*", f"x.{found}").drop(digest)


def _verified(found: Column, words: Column) -> Column:
    true = F.filter(found, lambda x: x["words"] == _at(words, x["start"], x["m"]))
    return F.transform(true, lambda x: F.struct(x["start"].alias("start"), x["m"].alias("m"), x["items"].alias("items")))


def _merged(hits: Column) -> Column:
    """Hits in order of start as disjoint runs of words."""
    kind = "array<struct<start:int,end:int>>"

    def add(runs: Column, x: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        end = x["start"] + x["m"]
        apart = F.concat(runs, F.array(F.struct(x["start"].alias("start"), end.alias("end"))))
        longer = F.concat(
            F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"))))
        return F.when((F.size(runs) == 0) | (x["start"] > last["end"]), apart).otherwise(longer).cast(kind)

    return F.aggregate(hits, F.array().cast(kind), add)
