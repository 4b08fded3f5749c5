"""Cheapest repairs against an exhaustive search over edits."""

import hashlib
import heapq
import random
import re

import pytest

from sourcequarry.llm import conversation_repair as repair

FAULTS = ("", "blank", "duplicate", "truncated")
SYMBOL = {meaning: c for c, meaning in repair._SYMBOLS.items()}
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(rows, prune=False):
    """(cost, audit) by trying all edits in order of cost and audit. ``rows``: (role class, fault)."""
    heap, seen = [(0, "", 0, "")], set()
    while True:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit
        if prune and (i, state) in seen:
            continue
        seen.add((i, state))
        allowed = NEXT[state]
        if not audit.endswith("III"):
            heapq.heappush(heap, (cost + 2, audit + "I", i, allowed[-1]))
        if i < len(rows):
            role, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, allowed[-1]))
                if role in allowed:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role))


def solved(run):
    row = repair.evaluate([run])[0][0]
    best = None
    for state, entry in enumerate(row):
        for to in (0, 3):
            tail = repair.INSERTS[state][to]
            if entry and tail:
                best = repair.better(best, (entry[0] + tail[0], repair.join(entry[1], tail[1])))
    return best[0], repair.text_of(best[1])


def test_matrices_equal_exhaustive_search():
    rng = random.Random(3)
    for _ in range(150):
        rows = [(rng.choice("sua?"), rng.choice(FAULTS)) for _ in range(rng.randint(1, 4))]
        assert solved("".join(SYMBOL[r] for r in rows)) == cheapest(rows), rows
    for _ in range(20):
        rows = [(rng.choice("sua?"), rng.choice(FAULTS)) for _ in range(40)] * 3
        assert solved("".join(SYMBOL[r] for r in rows)) == cheapest(rows, prune=True)


def test_grammar_gives_back_its_runs():
    rng = random.Random(5)
    runs = ["".join(rng.choice("AEI") for _ in range(rng.randint(1, 60))) for _ in range(50)] + ["AAAAAAAAA", "AEAEAEAE", "A"]
    rules, compressed = repair.re_pair(runs)

    def text(symbol):
        return chr(symbol) if symbol < 128 else text(rules[symbol - 128][0]) + text(rules[symbol - 128][1])

    assert ["".join(map(text, c)) for c in compressed] == runs
    assert rules and sum(map(len, compressed)) < sum(map(len, runs)) / 2
    pairs = [p for c in compressed for p in set(zip(c, c[1:])) if p[0] != p[1]]
    assert len(pairs) == len(set(pairs))  # none is left that two runs share


def test_ropes_compare_as_their_texts():
    rng = random.Random(7)

    def rope(text):
        if len(text) < 3:
            return text
        cut = rng.randint(1, len(text) - 1)
        return rope(text[:cut]), rope(text[cut:]), len(text)

    for _ in range(300):
        a, b = ("".join(rng.choice("DK") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert repair.less(rope(a), rope(b)) == (a < b) and repair.text_of(rope(a)) == a


def brute(rows):
    """Expected row of one conversation from its (turn, role, text) rows."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, symbols = set(), []
    for _, role, text in rows:
        stripped = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        fault = "blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen else \
            "" if stripped[-1] in ".!?" else "truncated"
        seen.add((role, text))
        symbols.append((role[:1] if role[:1] in ("s", "u", "a") else "?", fault))
    cost, audit = cheapest(symbols, prune=True)
    out, state, left = [], "", iter(zip(rows, symbols))
    for edit in audit:
        (_, role, text), (initial, _) = next(left) if edit != "I" else ((None, "", ""), ("", None))
        if edit != "D":
            state = initial if edit == "K" else NEXT[state][-1]
            out.append((role if edit == "K" else {"u": "user", "a": "assistant"}[state], text))
    turns = {t for t, _, _ in rows if t is not None}
    count = [f for _, f in symbols].count
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "blank": count("blank"), "duplicate": count("duplicate"),
        "truncated": count("truncated"), "illegal": sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(symbols, symbols[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()}, out


ODD = [
    (1, None, "user", "a."), (1, 2, "assistant", None), (1, 2, "assistant", "b?\n"), (1, 2, "assistant", "b?\n"), (1, 9, "tool", "c!"),
    (2, 0, "system", "s."), (2, 0, "system", "s."), (2, 1, None, "x"), (2, 4, "", "y"), (3, 1, "user", "\t \n"), (3, 2, "user", ""),
    (None, 1, "assistant", "first."), (None, 0, "user", "then"), (None, None, "assistant", "first."), (4, 5, "user", "🧭 é."), (4, 5, "assistant", "x\0."),
    (5, None, "user", "q"), (5, None, "assistant", "q")]


def rows_of(conversations):
    return [(c, t, r, x) for c, some in conversations.items() for t, r, x in some]


def random_conversations(rng, n, length):
    words = ["yes.", "no", " ", "", None, "why?", "same text here."]
    return {i: [(rng.choice([None, *range(8)]), rng.choice(["system", "user", "assistant", "tool", None]), rng.choice(words))
                for _ in range(rng.randint(1, length))] for i in range(10, 10 + n)}


@pytest.mark.parametrize("run", [repair.RUN, 4])
def test_conversations_equal_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(repair, "RUN", run)  # with runs of four rows most conversations are cut
    conversations = random_conversations(random.Random(run), 60, 12)
    for c, t, r, x in ODD:
        conversations.setdefault(c, []).append((t, r, x))
    turns = spark.createDataFrame(rows_of(conversations), "conv_id long, turn long, role string, text string")
    _, led = repair.repair(turns)
    found = {r["id"]: r.asDict() for r in repair.repaired_digests(led).collect()}
    want = {c: brute(some) for c, some in conversations.items()}
    assert {c: {k: v for k, v in r.items() if k in want[c][0]} for c, r in found.items()} == {c: w[0] for c, w in want.items()}
    rows = {}
    for r in sorted(repair.repaired_turns(led).collect(), key=lambda r: r["place"]):
        rows.setdefault(r["id"], []).append((r["role"], r["text"]))
    assert rows == {c: w[1] for c, w in want.items() if w[1]}
    assert all(re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in some)) for some in rows.values())


def test_string_ids_clashing_columns_and_no_rows(spark):
    turns = spark.createDataFrame([("a", 1, "user", "x.", 5), ("b", 1, "user", "x.", 6)], "conv string, n int, who string, what string, at int")
    turns = turns.selectExpr("conv", "n", "who", "what", "at", "at AS key", "at AS digest", "at AS lead")
    _, led = repair.repair(turns, "conv", "n", "who", "what")
    assert {(r["id"], r["audit"], r["cost"]) for r in repair.repaired_digests(led).collect()} == {("a", "KI", 2), ("b", "KI", 2)}
    found, led = repair.repair(turns.limit(0), "conv", "n", "who", "what")
    assert found.count() == 0 and repair.repaired_digests(led).count() == 0 and repair.repaired_turns(led).count() == 0


def test_one_long_conversation(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"text {i}.") for i in range(20_000)]
    _, led = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    row = repair.repaired_digests(led).first()
    assert (row["audit"], row["cost"], row["gaps"]) == ("K" * 20_000, 0, 0)
    assert row["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in rows).encode()).hexdigest()
