"""Conversation structure repair by dynamic programming over a grammar.

A row of a conversation is one symbol: the class of its role and its fault. Edits keep a row, give
it another role, delete it or insert one, and take an automaton from state to state; the
cheapest edits of a run of rows are a matrix over these states whose product adds costs and
concatenates audits, and whose sum takes the lesser cost and, of equal costs, the lesser audit.
(Of two audits of one run with equal states and costs none begins the other, so the order of
their continuations is theirs.)

Conversations repeat each other, and repeat themselves. Equal runs are evaluated once; the
different ones are compressed by Re-Pair, the most frequent pair of symbols becoming a rule
until none occurs twice, and every rule gets one matrix, made of those of its two sides. Its
audits are ropes of theirs, so nothing is written out before the end.

A long conversation is cut into runs of ``RUN`` rows that are evaluated wherever they lie, and
meet as matrices. Rows are numbered in ranges, copies are told by the least number of their
digest, and all of that without texts. These move once, to be digested in order; a conversation's
running digest and its audit, one value, are the only things that one task makes alone.

Defined results: a null role or text is one space; a null turn comes first; rows of one turn come
by role and digest of the text; a null id is an id of its own; a role that begins otherwise than
with s, u or a cannot be kept; columns of any name pass, as only the named ones are read; an
empty table gives no rows, and a conversation without rows is no conversation.
"""

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sourcequarry.llm.common import slices
from sourcequarry.operators.skew import join_to_unique
from sourcequarry.runtime import materialize

#: Rows of a run, a power of two; symbols that are compressed together.
RUN, TOGETHER = 1 << 12, 1 << 16
#: Rows of one task beyond which equal keys are spread.
SPREAD = 1 << 14

_ROLES, _FAULTS = "sua", ("", "blank", "duplicate", "truncated")
KEEP, REROLE, DELETE, INSERT = "KRDI"
_COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}

# States: nothing yet, after system, after user, after assistant.
_STATES = 4
_NEXT = {0: 2, 1: 2, 2: 3, 3: 2}  # where a row of the wanted role leads
_MAY_KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_WANTED = {2: "user", 3: "assistant"}


# --- audits ----------------------------------------------------------------------------------

def _size(rope) -> int:
    return len(rope) if isinstance(rope, str) else rope[2]


def join(left, right):
    """A rope of two; short ones are written out."""
    n = _size(left) + _size(right)
    if not _size(left) or not _size(right):
        return left if _size(left) else right
    return left + right if n <= 32 and isinstance(left, str) and isinstance(right, str) else (left, right, n)


def text_of(rope) -> str:
    out, stack = [], [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            out.append(top)
        else:
            stack += [top[1], top[0]]
    return "".join(out)


def less(a, b) -> bool:
    """Whether one rope comes before another; what they share is skipped."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y:
            continue
        if isinstance(x, str) and isinstance(y, str):
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x[:n] < y[:n]
            left += [x[n:]] if len(x) > n else []
            right += [y[n:]] if len(y) > n else []
        elif isinstance(y, str) or not isinstance(x, str) and x[2] >= y[2]:
            left += [x[1], x[0]]
            right.append(y)
        else:
            left.append(x)
            right += [y[1], y[0]]
    return bool(right)


def better(a: tuple | None, b: tuple | None) -> tuple | None:
    """The lesser of two (cost, audit)."""
    if a is None or b is None:
        return b if a is None else a
    return b if b[0] < a[0] or b[0] == a[0] and less(b[1], a[1]) else a


def product(a: list, b: list) -> list:
    out = []
    for row in a:
        new = []
        for j in range(_STATES):
            best = None
            for k, first in enumerate(row):
                then = b[k][j]
                if first is not None and then is not None and (best is None or first[0] + then[0] <= best[0]):
                    best = better(best, (first[0] + then[0], join(first[1], then[1])))
            new.append(best)
        out.append(new)
    return out


def _inserts() -> list:
    """The cheapest insertions from each state to each other one."""
    out = [[None] * _STATES for _ in range(_STATES)]
    for i in range(_STATES):
        at, n = i, 0
        while out[i][at] is None:
            out[i][at] = n * _COST[INSERT], INSERT * n
            at, n = _NEXT[at], n + 1
    return out


INSERTS = _inserts()


def symbol_matrix(role: str, fault: str) -> list:
    """Insertions before a row, then the row."""
    out = [[None] * _STATES for _ in range(_STATES)]
    penalty = int(fault == "truncated")
    for i in range(_STATES):
        out[i][i] = _COST[DELETE], DELETE
        if fault not in ("blank", "duplicate"):
            for to, edit in ((_NEXT[i], REROLE), (_MAY_KEEP.get((i, role)), KEEP)):
                if to is not None:
                    out[i][to] = better(out[i][to], (_COST[edit] + penalty, edit))
    return product(INSERTS, out)


_SYMBOLS = {chr(65 + 4 * r + f): (role, fault) for r, role in enumerate(_ROLES + "?") for f, fault in enumerate(_FAULTS)}


# --- grammar ---------------------------------------------------------------------------------

def re_pair(runs: list[str], first: int = 128) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Rules, numbered from ``first``, and every run in terms of symbols and rules."""
    symbols, ahead, back = [-1], [1], [-1]
    for run in runs:
        symbols += [*map(ord, run), -1]
    ahead, back = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    places = defaultdict(set)
    for p in range(len(symbols) - 1):
        if symbols[p] >= 0 and symbols[p + 1] >= 0:
            places[symbols[p], symbols[p + 1]].add(p)
    heap = [(-len(some), pair) for pair, some in places.items() if len(some) > 1]
    heapq.heapify(heap)
    rules = []
    while heap:
        count, pair = heapq.heappop(heap)
        some = places.get(pair, ())
        if len(some) != -count:
            if len(some) > 1:
                heapq.heappush(heap, (-len(some), pair))
            continue
        del places[pair]
        new, changed = first + len(rules), set()
        rules.append(pair)
        for p in sorted(some):
            q = ahead[p]
            if symbols[p] != pair[0] or symbols[q] != pair[1]:
                continue  # an overlapping occurrence took its symbol
            before, after = back[p], ahead[q]
            if symbols[before] >= 0:
                places[symbols[before], pair[0]].discard(before)
                places[symbols[before], new].add(before)
                changed.add((symbols[before], new))
            if symbols[after] >= 0:
                places[pair[1], symbols[after]].discard(q)
                places[new, symbols[after]].add(p)
                changed.add((new, symbols[after]))
            symbols[p], symbols[q] = new, -2
            ahead[p], back[after] = after, p
        for other in changed:
            if len(places[other]) > 1:
                heapq.heappush(heap, (-len(places[other]), other))
    out, at = [], 0
    for run in runs:
        left, at = [], ahead[at]
        while symbols[at] != -1:
            left.append(symbols[at])
            at = ahead[at]
        out.append(left)
    return rules, out


def evaluate(runs: list[str]) -> list[list]:
    """The matrix of every run."""
    rules, compressed = re_pair(runs)
    matrices = {ord(c): symbol_matrix(*meaning) for c, meaning in _SYMBOLS.items()}
    for number, (a, b) in enumerate(rules, 128):
        matrices[number] = product(matrices[a], matrices[b])
    out = []
    for run in compressed:
        whole = matrices[run[0]]
        for symbol in run[1:]:
            whole = product(whole, matrices[symbol])
        out.append(whole)
    return out


# --- rows ------------------------------------------------------------------------------------

def _prepared(turns: DataFrame, id: str, turn: str, role: str, text: str) -> DataFrame:  # noqa: A002
    space = F.lit(" ")
    rows = turns.select(F.col(id).alias("id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), space).alias("role"),
                        F.coalesce(F.col(text), space).alias("text"))
    key = F.when(F.col("id").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("id").cast("string")))
    return rows.select(key.alias("key"), "id", F.col("turn").isNotNull().alias("has_turn"), "turn", "role", F.sha2("text", 256).alias("digest"), "text")


_ORDER = ["key", "has_turn", "turn", "role", "digest"]


def row_symbols(prepared: DataFrame) -> DataFrame:
    """key, at (a number that grows with the order of rows) and symbol of every row."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    own = F.when(last == "", 1).when(last.isin(".", "!", "?"), 0).otherwise(3)
    narrow = prepared.select(*_ORDER, own.alias("fault")).repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    rows = materialize(narrow.withColumn("at", F.monotonically_increasing_id()), "turn-order")
    seen = rows.groupBy("key", "role", "digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = join_to_unique(rows, seen, ["key", "role", "digest"], "left", ["at"], SPREAD)
    fault = F.when((F.col("fault") != 1) & (F.col("at") > F.col("first")), 2).otherwise(F.col("fault"))
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, _ROLES)), F.substring("role", 1, 1)), F.lit(0))
    kind = F.when(kind > 0, kind - 1).otherwise(len(_ROLES))
    return met.select("key", "at", F.char(65 + 4 * kind + fault).alias("symbol"))


def runs_of(symbols: DataFrame) -> DataFrame:
    """key, run and symbols: the rows of each conversation in runs of at most ``RUN``."""
    each = symbols.groupBy("key", F.shiftright("at", RUN.bit_length() - 1).alias("run")).agg(
        F.array_sort(F.collect_list(F.struct("at", "symbol"))).alias("rows"))
    return each.select("key", "run", F.array_join(F.transform("rows", lambda r: r["symbol"]), "").alias("symbols"))


_FACTS = "ends string, blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>"


def run_matrices(different: DataFrame) -> DataFrame:
    """What is to know of each of the different runs in ``symbols``: the role classes at its ends,
    its faults, and its matrix."""
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.string())]
    schema = T.StructType([different.schema["symbols"], *T._parse_datatype_string(_FACTS).fields])

    def facts(run: str, matrix: list) -> tuple:
        roles, faults = zip(*(_SYMBOLS[c] for c in run), strict=True)
        entries = [entry for row in matrix for entry in row]
        return (run, roles[0] + roles[-1], *[faults.count(f) for f in _FAULTS[1:]], sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])),
                [None if e is None else e[0] for e in entries], [None if e is None else text_of(e[1]) for e in entries])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, TOGETHER):
                runs = part.column(0).to_pylist()
                rows = [facts(*pair) for pair in zip(runs, evaluate(runs), strict=True)]
                for start in range(0, len(rows), 512):
                    some = rows[start:start + 512]
                    yield pa.record_batch([pa.array([r[i] for r in some], k) for i, k in enumerate(kinds)], names=schema.names)

    return different.select("symbols").mapInArrow(compute, schema)


_AUDIT = "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(prepared: DataFrame) -> DataFrame:
    """One row for each conversation: its faults, cost and audit."""
    runs = materialize(runs_of(row_symbols(prepared)), "turn-runs")
    known = materialize(run_matrices(runs.select("symbols").distinct()), "run-matrices")
    met = join_to_unique(runs, known, ["symbols"], "inner", ["key", "run"], SPREAD).drop("symbols")
    ordered = met.repartition("key").sortWithinPartitions("key", "run")
    schema = T._parse_datatype_string(_AUDIT)

    def start() -> list:
        return [None, [0, 0, 0, 0], [(0, ""), None, None, None], ""]

    def done(held: list) -> tuple:
        key, counts, states, _ = held
        best = None
        for state, entry in enumerate(states):
            if entry is not None:
                for to in (0, 3):
                    tail = INSERTS[state][to]
                    best = better(best, tail and (entry[0] + tail[0], join(entry[1], tail[1])))
        return key, *counts, best[0], text_of(best[1])

    def emit(rows: list) -> pa.RecordBatch:
        kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=schema.names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []
        for batch in batches:
            for part in slices(batch):
                for row in part.to_pylist():
                    if held is None or held[0] != row["key"]:
                        if held is not None:
                            out.append(done(held))
                        held = start()
                        held[0] = row["key"]
                    counts = held[1]
                    for i, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
                        counts[i] += row[name]
                    counts[3] += bool(held[3]) and held[3] + row["ends"][0] not in ("su", "ua", "au")
                    held[3] = row["ends"][1]
                    entries = [None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"], strict=True)]
                    held[2] = product([held[2]], [entries[i:i + _STATES] for i in range(0, len(entries), _STATES)])[0]
                if sum(len(r[-1]) for r in out) > 1 << 20 or len(out) > 1000:
                    yield emit(out)
                    out = []
        if held is not None:
            out.append(done(held))
        if out:
            yield emit(out)

    return ordered.mapInArrow(fold, schema)


# --- repaired conversations ------------------------------------------------------------------

def _walk(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conversation, role, text) of every repaired row, from rows in order, each conversation
    led by its audit; (conversation, None, None) at its end."""
    lead, audit, at, state = None, "", 0, 0

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == INSERT:
            at, state = at + 1, _NEXT[state]
            yield lead, _WANTED[state], ""

    for leads, role, text in rows:
        if leads is not None:
            if lead is not None:
                yield from inserted()
                yield lead, None, None
            lead, audit, at, state = leads, leads["audit"], 0, 0
            continue
        yield from inserted()
        edit, at = audit[at], at + 1
        if edit == KEEP:
            state = _MAY_KEEP[state, role[0]]
            yield lead, role, text
        elif edit == REROLE:
            state = _NEXT[state]
            yield lead, _WANTED[state], text
    if lead is not None:
        yield from inserted()
        yield lead, None, None


def _led(prepared: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of every conversation in order, each led by what was found for it."""
    facts = [c for c in found.columns if c != "key"]
    empty = F.lit(None).cast(T.StructType([found.schema[c] for c in facts]))
    rows = prepared.select(*_ORDER, "text", empty.alias("lead"))
    leads = found.select("key", F.lit(None).cast("boolean").alias("has_turn"), F.lit(None).cast(prepared.schema["turn"].dataType).alias("turn"),
                         *[F.lit(None).cast("string").alias(c) for c in ("role", "digest", "text")], F.struct(*facts).alias("lead"))
    return rows.unionByName(leads).repartition("key").sortWithinPartitions(*_ORDER).select("lead", "role", "text")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for part in slices(batch):
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def repair(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:  # noqa: A002
    """What was found for each conversation, stored: its id, gaps, faults, cost and audit; and its
    rows, each conversation led by that."""
    prepared = _prepared(turns, id, turn, role, text)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    seen = prepared.groupBy("key").agg(F.first("id").alias("id"), gaps.alias("gaps"))
    found = materialize(seen.join(audits(prepared), "key"), "audits")
    return found, _led(prepared, found)


def repaired_digests(led: DataFrame) -> DataFrame:
    """What was found for each conversation, with repaired_sha256 of its ``role:text`` lines."""
    facts = led.schema["lead"].dataType
    schema = T.StructType([*facts.fields, T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        kinds = [head.schema.field("lead").type.field(f.name).type for f in facts.fields]

        def emit(rows: list) -> pa.RecordBatch:
            columns = [pa.array([r[0][f.name] for r in rows], k) for f, k in zip(facts.fields, kinds, strict=True)]
            return pa.record_batch([*columns, pa.array([r[1] for r in rows])], names=schema.names)

        def chained():
            yield head
            yield from batches

        digest, begun, out = hashlib.sha256(), False, []
        for lead, role_, text_ in _walk(_rows(chained())):
            if role_ is not None:
                digest.update((("\n" if begun else "") + f"{role_}:{text_}").encode())
                begun = True
                continue
            out.append((lead, digest.hexdigest()))
            digest, begun = hashlib.sha256(), False
            if len(out) == 1000:
                yield emit(out)
                out = []
        if out:
            yield emit(out)

    return led.mapInArrow(run, schema)


def repaired_turns(led: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: id, place (from 0), role and text."""
    kind = led.schema["lead"].dataType["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("place", T.LongType()),
                           T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        kinds = [head.schema.field("lead").type.field("id").type, pa.int64(), pa.string(), pa.string()]

        def emit(rows: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=schema.names)

        def chained():
            yield head
            yield from batches

        place, held, out = 0, 0, []
        for lead, role_, text_ in _walk(_rows(chained())):
            if role_ is None:
                place = 0
                continue
            out.append((lead["id"], place, role_, text_))
            place, held = place + 1, held + len(text_)
            if held > 1 << 20 or len(out) == 1000:
                yield emit(out)
                held, out = 0, []
        if out:
            yield emit(out)

    return led.mapInArrow(run, schema)
