"""Removal of repeated byte strings with sparse suffix arrays and deep-shallow sorting.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document
with a smaller id, or earlier in its own. Nothing is decided by a sample:

1. Every string of ``length`` bytes holds the leftmost least hash of its 32-byte grams, so equal
   strings share that gram at the same place. These anchors, about 3 in 100 bytes, stand for all
   suffixes. An anchor's context is all a string around it can hold.
2. Anchors are sorted by gram and context. Of equal contexts the first leads; the others are
   repeats as a whole. A gram with one context is done. Each task decides this for what it
   reads itself before anything is dealt, so a passage that every text shares stays no heavy key.
3. Leaders of grams with several contexts meet as text. What follows the gram and, read backwards,
   what precedes it is put in suffix order: multikey quicksort on eight-byte words down to a
   shallow depth, then a blind trie for each group that is still equal there. Adjacent common
   prefixes then give classes of equal strings at every offset, and all but the first of a class
   are repeats.
4. A gram with more than ``group_limit`` leaders is not gathered: its strings are grouped
   by hash with partial minima instead, for the same result.
5. Texts with very many copies leave before step 1: all copies but the first go whole.

Texts move twice at most, by key. Contexts are told apart by their gram and two 64-bit hashes, strings of
large grams by gram, offset and 128 bits.

Defined results: null texts are empty; texts shorter than ``length`` keep every byte; rows with
equal id and text are one document and get equal results; different texts under one id are
ordered by their 64-bit hash; null ids come last; an empty table stays empty; columns of the input that
carry a result's name are replaced, all others stay.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from sourcequarry.llm.common import fresh, slices
from sourcequarry.runtime import materialize

GRAM = 32
#: Bytes after the gram that the multikey quicksort orders; beyond them blind tries do.
SHALLOW_WORDS = 2
#: Leaders sorted together; leaders of one gram that are gathered; copies that make a text hot.
BLOCK, GROUP_LIMIT, HOT_COPIES = 50_000, 100_000, 100
#: Bytes of text that are hashed at once, and anchors whose repeats a task looks for before they are dealt.
PIECE, TOGETHER = 1 << 18, 100_000
#: Bytes of text whose leaders are cut out at once, and contexts that are handed on together.
CONTEXT_TEXT, CONTEXTS = 1 << 20, 10_000

_LAST = (1 << 63) - 1
_ANCHORS = "gram bigint, context bigint, other bigint, doc bigint, hash bigint, pos int, before int, after int, repeat boolean"
_FOUND = "gram bigint, doc bigint, hash bigint, start int, end int"
_CONTEXTS = "gram bigint, doc bigint, hash bigint, pos int, before binary, after binary"
_INTERVALS = "doc bigint, hash bigint, start int, end int"


def remove_repeats(
    docs: DataFrame, length: int = 100, id: str = "doc_id", text: str = "text", whole_characters: bool = True,  # noqa: A002
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """``docs`` with what remains of the text, and n_bytes, n_removed and n_spans.

    With ``whole_characters`` a character goes only if all its bytes do, and the text stays a
    string; without, it becomes the remaining bytes."""
    if length < GRAM + 8:
        raise ValueError(f"strings have {GRAM + 8} bytes at least")
    doc, hashed, whole = fresh(docs, "doc", "hash", "whole")
    content = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumn(doc, F.coalesce(F.col(id).cast("long"), F.lit(_LAST))).withColumn(
        hashed, F.xxhash64(content))
    digest, = fresh(keyed, "digest")
    hot = materialize(
        keyed.groupBy(F.sha2(content, 256).alias(digest)).agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct(doc, hashed)).alias("first")).where(F.col("n") > HOT_COPIES)
        .select(digest, F.col("first").getField(doc).alias("first_doc")), "hot-texts")
    marked = keyed.withColumn(digest, F.sha2(content, 256)).join(hot.withColumnRenamed("first_doc", whole), digest, "left").drop(digest)
    marked = marked.withColumn(whole, F.coalesce(F.col(whole) != F.col(doc), F.lit(False)) & (F.octet_length(content) >= length))

    anchors = marked.where(~F.col(whole)).select(F.col(doc).alias("doc"), F.col(hashed).alias("hash"), F.col(text).alias("text")).mapInArrow(
        _anchors_of(length), _ANCHORS)
    order = ["gram", "context", "other", "doc", "hash", "pos"]
    deal = F.when(F.col("repeat"), F.xxhash64("doc", "pos")).otherwise(F.col("gram"))
    found = materialize(
        anchors.withColumn("deal", deal).repartition("deal").sortWithinPartitions("repeat", *order).mapInArrow(_repeated, _FOUND), "anchors")
    at_home = marked.repartition(doc, hashed)
    contexts = _contexts(at_home, found.where("gram is not null"), doc, hashed, text, length)
    contexts = materialize(contexts, "contexts")
    intervals = found.where("gram is null").drop("gram").unionByName(_compare(contexts, length, group_limit))
    per_text = intervals.groupBy(F.col("doc").alias(doc), F.col("hash").alias(hashed)).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias(fresh(at_home, "intervals")[0]))
    return _cut(at_home, per_text, docs, doc, hashed, whole, text, whole_characters)


# --- anchors ---------------------------------------------------------------------------------

_MIX, _OTHER_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def anchors_of(texts: list[bytes], length: int, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """Of all anchors of the texts: number of the text, place, gram hash, both context hashes, and
    how many bytes of context stand before and after the gram.

    Short texts are read together, long ones in pieces that overlap, so that a text of any
    length needs the memory of one piece."""
    reach = length - GRAM
    found, together, held = [], [], 0
    for number, data in enumerate(texts):
        if len(data) < length:
            continue
        if len(data) > piece:
            for start in range(0, len(data) - length + 1, piece):
                begin = max(0, start - reach)
                found.append(_anchors_in([(number, data[begin:start + piece + length + reach], begin, start, start + piece, len(data))], length))
            continue
        if together and held + len(data) > piece:
            found.append(_anchors_in(together, length))
            together, held = [], 0
        together.append((number, data, 0, 0, len(data), len(data)))
        held += len(data)
    if together:
        found.append(_anchors_in(together, length))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(7))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    order = np.lexsort((columns[1], columns[0]))  # neighbouring pieces may share an anchor
    number, place = columns[0][order], columns[1][order]
    new = np.ones(len(order), bool)
    new[1:] = (number[1:] != number[:-1]) | (place[1:] != place[:-1])
    return tuple(c[order[new]] for c in columns)


def _anchors_in(pieces: list[tuple], length: int) -> tuple[np.ndarray, ...]:
    """The same for the strings that start in given places of pieces: number of the text, bytes,
    where they begin in the text, first and last place (exclusive), and bytes of the whole text.
    A piece holds ``length`` - ``GRAM`` bytes of context around all its strings."""
    reach = length - GRAM
    sizes = np.array([len(p[1]) for p in pieces], np.int64)
    numbers, begins, firsts, lasts, totals = (np.array([p[i] for p in pieces], np.int64) for i in (0, 2, 3, 4, 5))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = int(ends[-1])
    whole = np.frombuffer(bytes(reach + 8) + b"".join(p[1] for p in pieces) + bytes(length + 16), np.uint8)
    words = np.ndarray((len(whole) - 7,), "<u8", whole, strides=(1,))  # the eight bytes from each place on
    first = reach + 8
    grams = words[first:first + n] * _MIX
    for i in range(8, GRAM, 8):
        grams = ((grams ^ (grams >> np.uint64(29))) + words[first + i:first + i + n]) * _MIX
    grams ^= grams >> np.uint64(32)
    least, place, span = grams, np.arange(n, dtype=np.int32), 1
    while span < reach + 1:  # the leftmost least of span grams, then of twice as many
        step = min(span, reach + 1 - span)
        later = least[step:] < least[:-step]
        place = np.where(later, place[step:], place[:-step])
        least = np.where(later, least[step:], least[:-step])
        span += step
    edges = np.zeros(n + 1, np.int32)  # +1 where strings may start, -1 where they no longer may
    np.add.at(edges, starts + firsts - begins, 1)
    np.add.at(edges, starts + np.minimum(lasts - begins, sizes - length + 1), -1)
    place = np.unique(place[np.cumsum(edges)[:len(place)] > 0]).astype(np.int64)
    piece = np.searchsorted(ends, place, side="right")
    at = place - starts[piece] + begins[piece]
    before = np.minimum(at, reach)
    after = np.minimum(totals[piece] - at - GRAM, reach)
    context = (before * (1 << 20) + after).astype(np.uint64)
    other = ~context
    for i in range(-(-reach // 8) * -8, GRAM + reach, 8):
        word = words[place + first + i].view(np.uint8).reshape(-1, 8)
        offsets = np.arange(i, i + 8)
        inside = (offsets >= -before[:, None]) & (offsets < GRAM + after[:, None])
        word = np.where(inside, word, 0).astype(np.uint8).view("<u8").ravel()
        context = (context ^ word) * _MIX
        context ^= context >> np.uint64(31)
        other = (other + word) * _OTHER_MIX
        other ^= other >> np.uint64(33)
    return numbers[piece], at, grams[place].view(np.int64), context.view(np.int64), other.view(np.int64), before, after


def _anchors_of(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in slices(batch, 2 << 20):
                texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                number, *found = anchors_of(texts, length)
                held.append([*(part.column(c).to_numpy()[number] for c in ("doc", "hash")), *found])
                n += len(number)
                if n >= TOGETHER:
                    yield _anchor_rows(held)
                    held, n = [], 0
        if n:
            yield _anchor_rows(held)

    return run


def _anchor_rows(held: list[list[np.ndarray]]) -> pa.RecordBatch:
    doc, hashed, place, gram, context, other, before, after = (np.concatenate(c) for c in zip(*held, strict=True))
    repeat = _repeats_here(gram, context, other, doc, hashed, place)
    return pa.record_batch(
        [*[pa.array(x, pa.int64()) for x in (gram, context, other, doc, hashed)],
         *[pa.array(x.astype(np.int32)) for x in (place, before, after)], pa.array(repeat)],
        names=["gram", "context", "other", "doc", "hash", "pos", "before", "after", "repeat"])


def _repeats_here(gram, context, other, doc, hashed, pos) -> np.ndarray:
    """Whether an anchor has the gram and the context of an earlier one among these."""
    order = np.lexsort((pos, hashed, doc, other, context, gram))
    g, c, o, d, h, p = (x[order] for x in (gram, context, other, doc, hashed, pos))
    begins = np.ones(len(g), bool)
    begins[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1]) | (o[1:] != o[:-1])
    first = np.maximum.accumulate(np.where(begins, np.arange(len(g)), 0))
    out = np.zeros(len(g), bool)
    out[order] = (d != d[first]) | (h != h[first]) | (p != p[first])  # else the same row once more
    return out


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From anchors in order of gram, context and place: intervals of contexts that repeat whole
    (no gram), and leaders of grams with several contexts (start and end are the gram's place).

    Only the last row and a leader that waits for a second context are kept between batches."""
    last, waiting = None, None
    for batch in batches:
        known = batch.filter(batch.column("repeat"))
        doc, hashed, pos, before, after = (known.column(i).to_numpy() for i in range(3, 8))
        if len(doc):
            yield _intervals(None, doc, hashed, pos - before, pos + GRAM + after)
        batch = batch.filter(pc.invert(batch.column("repeat")))
        gram, context, other, doc, hashed, pos, before, after = (batch.column(i).to_numpy() for i in range(8))
        n = len(gram)
        if not n:
            continue
        new_gram, new_context, again = (np.ones(n, bool) for _ in range(3))
        new_gram[1:] = gram[1:] != gram[:-1]
        new_context[1:] = new_gram[1:] | (context[1:] != context[:-1]) | (other[1:] != other[:-1])
        again[1:] = (doc[1:] == doc[:-1]) & (hashed[1:] == hashed[:-1]) & (pos[1:] == pos[:-1])
        if last:
            new_gram[0] = gram[0] != last[0]
            new_context[0] = new_gram[0] or (context[0], other[0]) != last[1:3]
            again[0] = (doc[0], hashed[0], pos[0]) == last[3:]
        repeat = ~new_context & ~again
        run = np.cumsum(new_gram) - 1 + (0 if new_gram[0] else 1)  # run 0 goes on from the batch before
        contexts_in = np.bincount(run[new_context], minlength=run[-1] + 1)
        lead = new_context & (~new_gram | (contexts_in[run] > 1))
        rows = [(None, doc[repeat], hashed[repeat], pos[repeat] - before[repeat], pos[repeat] + GRAM + after[repeat]),
                (gram[lead], doc[lead], hashed[lead], pos[lead], pos[lead])]
        if waiting and not new_gram[0] and contexts_in[0]:
            rows.append(tuple(np.array([x]) for x in (*waiting, waiting[-1])))
            waiting = None
        if new_gram.any():
            at = int(np.flatnonzero(new_gram)[-1])
            waiting = None if lead[at] else (gram[at], doc[at], hashed[at], pos[at])
        last = gram[-1], context[-1], other[-1], doc[-1], hashed[-1], pos[-1]
        for row in rows:
            yield _intervals(*row)


def _intervals(gram: np.ndarray | None, doc: np.ndarray, hashed: np.ndarray, *others: np.ndarray) -> pa.RecordBatch:
    grams = pa.nulls(len(doc), pa.int64()) if gram is None else pa.array(gram, pa.int64())
    return pa.record_batch([grams, pa.array(doc, pa.int64()), pa.array(hashed, pa.int64()), *[pa.array(x.astype(np.int32), pa.int32()) for x in others]],
                           names=["gram", "doc", "hash", "start", "end"])


# --- contexts --------------------------------------------------------------------------------

def _contexts(at_home: DataFrame, leaders: DataFrame, doc: str, hashed: str, text: str, length: int) -> DataFrame:
    """Leaders with what stands before the gram, backwards, and after it."""
    held, = fresh(at_home, "leaders")
    wanted = leaders.groupBy(F.col("doc").alias(doc), F.col("hash").alias(hashed)).agg(
        F.collect_list(F.struct("gram", F.col("start").alias("pos"))).alias(held))
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, CONTEXT_TEXT):
                yield from contexts_in(*(part.column(c) for c in (doc, hashed, text, held)), reach)

    return at_home.join(wanted, [doc, hashed]).mapInArrow(run, _CONTEXTS)


def contexts_in(docs: pa.Array, hashes: pa.Array, texts: pa.Array, held: pa.Array, reach: int) -> Iterator[pa.RecordBatch]:
    """The leaders that texts hold, with what stands before each, backwards, and after it; at most
    ``CONTEXTS`` of them together, however many the texts have."""
    counts = pc.list_value_length(held).to_numpy()
    row = np.repeat(np.arange(len(counts)), counts)
    gram, pos = held.flatten().flatten()
    data, of = b"", -1
    for first in range(0, len(row), CONTEXTS):
        rows = row[first:first + CONTEXTS]
        before, after = [], []
        for r, p in zip(rows.tolist(), pos[first:first + CONTEXTS].to_pylist(), strict=True):
            if r != of:
                data, of = (texts[r].as_py() or "").encode(), r
            before.append(data[max(0, p - reach):p][::-1])
            after.append(data[p + GRAM:p + GRAM + reach])
        yield pa.record_batch(
            [gram[first:first + CONTEXTS], docs.take(pa.array(rows)), hashes.take(pa.array(rows)), pos[first:first + CONTEXTS],
             pa.array(before, pa.binary()), pa.array(after, pa.binary())],
            names=["gram", "doc", "hash", "pos", "before", "after"])


def _compare(contexts: DataFrame, length: int, group_limit: int) -> DataFrame:
    """Intervals of leaders that repeat an earlier leader in part."""
    large = materialize(contexts.groupBy("gram").count().where(F.col("count") > group_limit).select("gram"), "large-grams")
    order = ["gram", "doc", "hash", "pos"]
    usual = contexts.join(large, "gram", "left_anti").repartition("gram").sortWithinPartitions(*order).mapInArrow(
        _blocks(length), _INTERVALS)
    return usual.unionByName(_grouped(contexts.join(large, "gram", "left_semi"), length))


def _grouped(contexts: DataFrame, length: int) -> DataFrame:
    """The same for grams of any size: every string by hash, with partial minima."""
    reach = length - GRAM
    offset = F.col("offset")
    strings = contexts.select("gram", "doc", "hash", "pos", "before", "after", F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("offset"))
    strings = strings.where((F.octet_length("before") >= offset) & (F.octet_length("after") >= reach - offset)).select(
        "gram", "offset", F.unhex(F.md5(F.concat(F.substring("before", F.lit(1), offset), F.substring("after", F.lit(1), reach - offset)))).alias("string"),
        F.struct("doc", "hash", "pos").alias("at"))
    first = strings.groupBy("gram", "offset", "string").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = strings.join(first, ["gram", "offset", "string"]).where(F.col("at") != F.col("first"))
    return later.groupBy("at").agg(F.max("offset").alias("most"), F.min("offset").alias("least")).select(
        "at.doc", "at.hash", (F.col("at.pos") - F.col("most")).alias("start"), (F.col("at.pos") + length - F.col("least")).alias("end"))


def _blocks(length: int):
    """Leaders in order of gram and place, in blocks of whole grams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[-1][0] and len(held) >= BLOCK:
                    yield _block(held, length)
                    held = []
                if not held or row[:4] != held[-1][:4]:
                    held.append(row)
        if held:
            yield _block(held, length)

    return run


def _block(rows: list[tuple], length: int) -> pa.RecordBatch:
    group = np.unique([r[0] for r in rows], return_inverse=True)[1]
    least, most = repeats_in_block(group, [r[4] for r in rows], [r[5] for r in rows], length - GRAM)
    hit = np.flatnonzero(most >= 0)
    pos = np.array([r[3] for r in rows], np.int64)[hit]
    return pa.record_batch(
        [pa.array([rows[i][1] for i in hit], pa.int64()), pa.array([rows[i][2] for i in hit], pa.int64()),
         pa.array((pos - most[hit]).astype(np.int32)), pa.array((pos + length - least[hit]).astype(np.int32))],
        names=["doc", "hash", "start", "end"])


def repeats_in_block(group: np.ndarray, before: list[bytes], after: list[bytes], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each leader the least and the greatest offset (bytes before the gram) of its strings
    that an earlier leader of its group has too; -1 where there is none. Leaders come in order;
    all strings of one leader overlap in the gram, so the two ends tell which bytes go."""
    n = len(group)
    sides = []
    for strings in (before, after):
        order = deep_shallow_order(group, strings, reach)
        common = _common_prefixes(group, strings, order, reach)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        beside = np.maximum(common, np.append(common[1:], -1))[rank]  # longest prefix shared with any other
        sides.append((common, rank, beside))
    (common_b, rank_b, beside_b), (common_a, rank_a, beside_a) = sides
    least, most = np.full(n, -1), np.full(n, -1)
    for offset in range(reach + 1):
        open_ = np.flatnonzero((beside_b >= offset) & (beside_a >= reach - offset))
        if not len(open_):
            continue
        class_b = np.cumsum(common_b < offset)[rank_b[open_]]
        class_a = np.cumsum(common_a < reach - offset)[rank_a[open_]]
        _, first, of = np.unique(class_b * (n + 1) + class_a, return_index=True, return_inverse=True)
        repeated = open_[first[of] != np.arange(len(open_))]
        most[repeated] = offset
        least[repeated] = np.where(least[repeated] < 0, offset, least[repeated])
    return least, most


def _matrix(strings: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)


def _common_prefixes(group: np.ndarray, strings: list[bytes], order: np.ndarray, reach: int) -> np.ndarray:
    """Bytes that each string shares with the one before it in order; -1 where a group begins."""
    sizes = np.array([len(s) for s in strings])[order]
    rows = _matrix(strings, reach + 1)[order]
    out = np.full(len(order), -1, np.int64)
    differs = rows[1:] != rows[:-1]
    differs[:, -1] = True
    shared = np.minimum(differs.argmax(1), np.minimum(sizes[1:], sizes[:-1]))
    out[1:] = np.where(group[order][1:] == group[order][:-1], shared, -1)
    return out


# --- deep-shallow sorting --------------------------------------------------------------------

def deep_shallow_order(group: np.ndarray, strings: list[bytes], reach: int) -> np.ndarray:
    """Order of the strings within their groups, groups in order of their number."""
    width = max(8 * SHALLOW_WORDS, -(-reach // 8) * 8)
    words = _matrix(strings, width).view(">u8")[:, :SHALLOW_WORDS]
    keys = np.column_stack([group.astype(np.uint64), words.astype(np.uint64)])
    out: list[np.ndarray] = []
    for equal in multikey_quicksort(keys):
        if len(equal) > 1:
            equal = equal[blind_trie_order([strings[i] for i in equal.tolist()])]
        out.append(equal)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def multikey_quicksort(keys: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers in order of their keys, word by word, as groups of rows whose keys are equal.

    A part is split in three by one word of a middle row; the equal part goes on to the next word."""
    parts = [(np.arange(len(keys)), 0)] if len(keys) else []
    while parts:
        rows, word = parts.pop()
        if len(rows) == 1 or word == keys.shape[1]:
            yield rows
            continue
        key = keys[rows, word]
        pivot = key[len(key) // 2]
        less, more = key < pivot, key > pivot
        for some, next_word in ((rows[more], word), (rows[~(less | more)], word + 1), (rows[less], word)):
            if len(some):
                parts.append((some, next_word))


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Order of strings by a blind trie: inner nodes keep only where their strings part.

    A string goes down by the bytes at these places alone, meets some leaf, is compared with that
    leaf once, and is put in where the two part."""
    leaves: list[list[int]] = [[0]]  # strings that are equal
    root: object = 0  # a leaf's number, or [depth, {byte or -1 at the end: node}]
    for i in range(1, len(strings)):
        new, node = strings[i], root
        while isinstance(node, list):
            depth, children = node
            branch = new[depth] if depth < len(new) else -1
            node = children[branch] if branch in children else next(iter(children.values()))
        old = strings[leaves[node][0]]
        shared = _shared(new, old)
        if shared == len(new) == len(old):
            leaves[node].append(i)
            continue
        leaves.append([i])
        new_branch, old_branch = (s[shared] if shared < len(s) else -1 for s in (new, old))
        above, node = None, root
        while isinstance(node, list) and node[0] < shared:
            above, via = node, new[node[0]]
            node = node[1][via]
        if isinstance(node, list) and node[0] == shared:
            node[1][new_branch] = len(leaves) - 1
            continue
        inner = [shared, {old_branch: node, new_branch: len(leaves) - 1}]
        if above is None:
            root = inner
        else:
            above[1][via] = inner
    order, left = [], [root]
    while left:
        node = left.pop()
        if isinstance(node, list):
            left += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            order += leaves[node]
    return order


def _shared(a: bytes, b: bytes) -> int:
    """Bytes of the longest common prefix."""
    n = min(len(a), len(b))
    apart = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (apart.bit_length() + 7) // 8


# --- result ----------------------------------------------------------------------------------

def _cut(at_home, per_text, docs, doc, hashed, whole, text, whole_characters) -> DataFrame:
    results = ["n_bytes", "n_removed", "n_spans"]
    kept = [c for c in docs.columns if c != text and c.lower() not in results]
    joined = at_home.join(per_text, [doc, hashed], "left").select(*kept, F.col(text).alias("text of the row"), F.col(whole).alias("whole row"), per_text.columns[-1])
    kind, arrow_kind = (T.StringType(), pa.string()) if whole_characters else (T.BinaryType(), pa.binary())
    schema = T.StructType([*[joined.schema[c] for c in kept], T.StructField(text, kind), *[T.StructField(c, T.LongType()) for c in results]])
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [cut(value, gone, intervals, whole_characters)
                        for value, gone, intervals in zip(*(part.column(n + i).to_pylist() for i in range(3)), strict=True)]
                yield pa.record_batch(
                    [*part.columns[:n], pa.array([r[0] for r in rows], arrow_kind), *[pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)]],
                    names=[*kept, text, *results])

    names = [c for c in docs.columns if c in (*kept, text)]
    return joined.mapInArrow(run, schema).select(*names, *results)


def cut(value: str | None, gone: bool, intervals: list[dict] | None, whole_characters: bool) -> tuple:
    """What remains of a text, its bytes, the bytes removed and the runs they were in."""
    data = (value or "").encode()
    runs: list[list[int]] = [[0, len(data)]] if gone else []
    for interval in [] if gone else intervals or []:
        if runs and interval["start"] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], interval["end"])
        else:
            runs.append([interval["start"], interval["end"]])
    if whole_characters:
        for run in runs:
            for i, step in ((0, 1), (1, -1)):
                while 0 < run[i] < len(data) and data[run[i]] & 0xC0 == 0x80:
                    run[i] += step
        runs = [r for r in runs if r[0] < r[1]]
    kept, at = [], 0
    for start, end in runs:
        kept.append(data[at:start])
        at = end
    remains = b"".join([*kept, data[at:]])
    if whole_characters:
        remains = value if value is None else remains.decode()
    return remains, len(data), sum(e - s for s, e in runs), len(runs)
