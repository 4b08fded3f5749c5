"""The audit against applying the filters one after another, in every order."""

import re
from itertools import permutations

from sourcequarry.llm import filter_audit

LONG = " ".join(f"word{i}" for i in range(60))
ODD = [
    (1, None, None), (2, "", "a"), (3, LONG, "a"), (4, LONG, "a"), (4, LONG, "a"), (None, LONG, "a"), (None, "", "b"), (5, "A B C " + LONG, "b"),
    (6, "# " + LONG, ""), (7, "same " * 100, "b"), (8, "SAME " * 200, "c"), (9, "SAME " * 200, "c"), (10, "$ " + "SHOUT " * 10, None), (3, "other", "a"),
    (11, "x y z é " * 40, "c"), (12, "w" * 50_000 + " " + LONG, "c")]
LABELS = [(3, 1, 0), (4, 0, 1), (4, 1, None), (7, 1, 1), (8, None, None), (9, 1, 1), (None, 1, 1), (99, 1, 1)]


def brute(docs, labels):
    firsts = {}
    for doc, text, _ in docs:
        if doc is not None:
            firsts[text or ""] = min(doc, firsts.get(text or "", doc))
    failing = []
    for doc, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                 "D": bool(re.search("[#$%&*|]", text)), "E": doc is not None and doc > firsts[text]}
        said = [[x[i] == 1 for x in labels if x[0] == doc and doc is not None] for i in (1, 2)]
        failing.append((part or "", {f for f, bad in fails.items() if bad}, any(said[0]), any(said[1])))
    out = {}
    for order in map("".join, permutations("ABCDE")):
        left = failing
        for step, f in enumerate(order, 1):
            gone, stay = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
            for part in {x[0] for x in failing}:
                own = lambda some: [x for x in some if x[0] == part]  # noqa: E731, B023
                out[part, order, step] = [
                    len(own(stay)), len(own(gone)), sum(f in x[1] for x in own(failing)) - len(own(gone)), sum(x[1] == {f} for x in own(failing)),
                    sum(x[2] for x in own(gone)), sum(x[3] for x in own(gone))]
            left = stay
    for (part, order, step), row in out.items():
        row.append(sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == order[step - 1]))
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_brute_force(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, source string").selectExpr("*", "1 AS mask", "2 AS part", "3 AS digest")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rows = filter_audit.audit_documents(docs, labels).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in rows} == brute(ODD, LABELS) and len(rows) == 4 * 600


def test_string_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", LONG, "s"), ("a", LONG, "s")], "id string, body string, host string")
    labels = spark.createDataFrame([("b", 1, 0)], "id string, quality int, toxic int")
    rows = filter_audit.audit_documents(docs, labels, "id", "body", "host").where("filter_order = 'ABCDE' AND step = 5").collect()
    assert [tuple(r)[3:] for r in rows] == [(1, 1, 0, 1, 1, 0, 120)]
    assert filter_audit.audit_documents(docs.limit(0), labels, "id", "body", "host").count() == 0
    assert filter_audit.audit_documents(docs, labels.limit(0), "id", "body", "host").where("good_lost > 0").count() == 0


def test_removal_steps_are_minima_of_places():
    import numpy as np

    orders = np.array(list(permutations(range(3))))
    steps = filter_audit.removal_steps(3, orders)
    for o, order in enumerate(orders.tolist()):
        for mask in range(8):
            at = [i for i, f in enumerate(order, 1) if mask >> f & 1]
            assert steps[o, mask] == min(at, default=4)
