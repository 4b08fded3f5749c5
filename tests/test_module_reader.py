"""What is read from one source text."""

import ast
import random

import pytest

from sourcequarry.operators import module_reader
from sourcequarry.operators.extract import RECORDS
from sourcequarry.operators.module_reader import MODULE_SCOPE, read_module
from sourcequarry.schema import ENTITY, SCOPE

SAMPLE = """
from decimal import Decimal
import json, logging

def price(order: dict) -> Decimal:
    return Decimal(order["total"])

class Invoice:
    currency = "EUR"

    def render(self, indent: int = 2):
        return json.dumps(self.lines, indent=indent)

    def close(self):
        logging.info(self)
"""


def read(source, mode="intended", on_error="row", include_async=False, records=RECORDS):
    return read_module(source, records=set(records), mode=mode, on_error=on_error, include_async=include_async)


def scopes(source, **options):
    return {row[0]: dict(zip(SCOPE.names, row)) for row in read(source, **options).scopes}


def entities(source, **options):
    return [dict(zip(ENTITY.names, row)) for row in read(source, **options).entities]


def names(source, kind, **options):
    return [e["name"] for e in entities(source, **options) if e["entity_type"] == kind and e["is_latest"]]


def test_inheritance():
    assert scopes("class A:\n    pass\nclass B(A):\n    pass\n")["B"]["inherits_from"] == ["A"]


def test_dotted_bases_count_and_others_do_not():
    found = scopes("class C(a.B, Generic[T], f(), metaclass=M):\n    pass\n")["C"]
    assert found["inherits_from"] == ["a.B"]
    assert found["reads_from"] == ["Generic", "M", "T", "a", "f"]


def test_calls_and_type_hints():
    found = scopes("def foo():\n    pass\n\ndef bar(x: int) -> str:\n    return foo()\n")["bar"]
    assert found["calls"] == ["foo"]
    assert found["type_hints"] == [("return", "str"), ("x", "int")]


def test_call_targets():
    found = scopes("self.db.get()\nf().g()\nh()()\nt[0]()\n'x'.join(y)\n")[MODULE_SCOPE]
    assert found["calls"] == ["'x'.join", "f", "f().g", "h", "self.db.get"]


def test_class_decorators_are_calls():
    found = scopes("@plain\n@made(1)\n@dotted.name\nclass C:\n    pass\n")["C"]
    assert found["calls"] == ["made", "plain"]
    assert found["reads_from"] == ["dotted", "made", "plain"]


def test_imports():
    source = "import os\nfrom math import sqrt, pi\nfrom .x import y as z\nfrom . import w\nfrom m import *\n"
    assert scopes(source)[MODULE_SCOPE]["imports"] == [".w", "m.*", "math.pi", "math.sqrt", "os", "x.y"]
    assert read(source).imports[:2] == [("direct", "os", 0), ("from", "math.sqrt", 1)]


def test_reads_and_writes():
    found = scopes("x = 10\ny = x + 5\n")[MODULE_SCOPE]
    assert (found["writes_to"], found["reads_from"]) == (["x", "y"], ["x"])


def test_what_is_no_write():
    found = scopes("import a\ndel d\nobj.attr = 1\ntry:\n    pass\nexcept E as e:\n    pass\n")[MODULE_SCOPE]
    assert found["writes_to"] == []
    assert found["reads_from"] == ["E", "obj"]


def test_raise_and_catch():
    source = "try:\n    raise ValueError('x')\nexcept ValueError:\n    pass\n"
    found = scopes(source)[MODULE_SCOPE]
    assert (found["raises"], found["catches"], found["calls"]) == (["ValueError"], ["ValueError"], ["ValueError"])


def test_raise_and_catch_need_plain_names():
    source = "try:\n    raise m.E()\nexcept (A, B):\n    raise\nexcept m.E:\n    raise F\n"
    found = scopes(source)[MODULE_SCOPE]
    assert (found["raises"], found["catches"]) == (["F"], [])


def test_nested_scopes():
    found = scopes("class Tree:\n    def walk(self):\n        async def skip(): pass\n        def visit(node):\n            return node.kids\n")
    assert found["Tree.walk.visit"]["defined_in"] == "Tree.walk"
    assert found["Tree"]["defined_in"] == MODULE_SCOPE


def test_inner_classes_of_one_name_all_count():
    source = ("class A:\n    class Meta:\n        def a(self): pass\nclass B:\n    class Meta:\n        def b(self): pass\n"
              "class C:\n    class X:\n        def lost(self): pass\nclass C:\n    pass\n")
    assert names(source, "class") == ["Meta", "A", "Meta", "B", "C"]
    assert names(source, "method") == ["a", "b"]
    assert [e["owner_qualname"] for e in entities(source) if e["entity_type"] == "method"] == ["A.Meta", "B.Meta", "C.X"]

def test_redefinitions_add_facts_but_the_last_entity_counts():
    source = "def f(a: int):\n    g()\ndef f(b: str):\n    h()\n"
    assert scopes(source)["f"]["calls"] == ["g", "h"]
    assert scopes(source)["f"]["type_hints"] == [("a", "int"), ("b", "str")]
    assert [e["lineno"] for e in entities(source) if e["is_latest"]] == [3]


def test_inner_definition_is_stored_before_its_outer_one():
    source = "def f():\n    def f():\n        pass\n"
    assert [e["lineno"] for e in entities(source) if e["is_latest"]] == [1]


def test_methods_of_a_replaced_class_do_not_count():
    source = "class C:\n    def a(self): pass\nclass C:\n    def b(self): pass\n"
    assert names(source, "method") == ["b"]


def test_methods_and_nested_classes():
    source = "class C:\n    class D:\n        def d(self): pass\n    def m(self):\n        def inner(): pass\n"
    assert names(source, "class") == ["D", "C"]
    owners = {e["name"]: (e["owner_class"], e["qualname"]) for e in entities(source) if e["entity_type"] == "method"}
    assert owners == {"d": ("D", "C.D.d"), "m": ("C", "C.m"), "inner": ("C", "C.m.inner")}


def test_reference_mode_sees_nothing_inside_classes():
    assert names(SAMPLE, "method", mode="reference") == []
    assert names(SAMPLE, "class", mode="reference") == ["Invoice"]
    assert names(SAMPLE, "function", mode="reference") == ["price"]
    assert "Invoice.close" in scopes(SAMPLE, mode="reference")


def test_reference_mode_looks_records_up_by_bare_name():
    source = "def outer():\n    def inner():\n        f()\n"
    at = {e["name"]: e["scope_ix"] for e in entities(source, mode="reference")}
    assert at == {"inner": None, "outer": 1}
    assert {e["name"]: e["scope_ix"] for e in entities(source)} == {"inner": 2, "outer": 1}


def test_sample_module():
    assert names(SAMPLE, "class") == ["Invoice"]
    assert names(SAMPLE, "function") == ["price"]
    assert names(SAMPLE, "method") == ["render", "close"]


def test_parameters_and_defaults():
    source = "def f(p, /, a, b: int = 1, *rest, k=2, **kw) -> List[int]:\n    pass\n"
    function = entities(source)[0]
    assert function["parameters"] == [("a", None, None), ("b", "int", "1")]
    assert function["return_annotation"] == "List[int]"
    assert entities(source, mode="reference")[0]["parameters"] == [("a", None, None), ("b", "int", None)]
    assert entities("def f(a=x.y, b='s', c=None): pass")[0]["parameters"] == [
        ("a", None, "x.y"), ("b", None, "'s'"), ("c", None, "None")]


def test_async_functions_are_no_scopes_unless_asked_for():
    source = "async def a():\n    g()\n    def inner(): pass\n"
    assert names(source, "function") == ["inner"]
    assert scopes(source)[MODULE_SCOPE]["calls"] == ["g"]
    assert names(source, "function", include_async=True) == ["inner", "a"]
    assert scopes(source, include_async=True)["a"]["calls"] == ["g"]


def test_node_map_is_breadth_first_and_lists_names_of_imports():
    source = "class C:\n    def m(self):\n        import deep\nimport os, sys\nfrom a import b\ndef f(): pass\n"
    assert read(source).node_map == [
        ("ClassDef", 0, "C"), ("Import", 1, "os"), ("Import", 1, "sys"), ("ImportFrom", 2, "b"), ("FunctionDef", 3, "f"),
        ("FunctionDef", 4, "m"), ("Import", 5, "deep")]


def test_defs_under_module_level_blocks_are_found():
    source = "if x:\n    def f(): pass\ntry:\n    pass\nexcept E:\n    class C: pass\nelse:\n    def g(): pass\n"
    assert names(source, "function") == ["f", "g"]
    assert names(source, "class") == ["C"]
    assert [n for _, _, n in read(source, records=["node_map"]).node_map] == ["f", "g", "C"]


@pytest.mark.parametrize("records", [["entities"], ["node_map"], ["imports"], ["docstring"]])
def test_single_records_equal_the_whole_reading(records):
    whole, part = read(SAMPLE), read(SAMPLE, records=records)
    assert getattr(part, records[0]) == getattr(whole, records[0])


@pytest.mark.parametrize("records", [["entities"], ["scopes"], ["node_map"], ["imports"], ["counts"]])
def test_records_that_nobody_asked_for_are_not_made(records):
    part = read(SAMPLE, records=records)
    assert getattr(part, records[0])
    assert not any(getattr(part, r) for r in [*RECORDS, "counts"] if r not in records)


def test_facts_from_every_kind_of_place():
    source = """
@deco(k=opt)
def f(a: A, /, b: B = dflt, *args: C, kw: D = kwd, **rest: E) -> R:
    x: Ann = v1
    with ctx() as w, other:
        for i in it:
            y[i].z += v2
        else:
            del gone
    match subject:
        case Point(x=pat, y=[first, *_]) if guard(first):
            raise err.Bad from cause
        case {"k": got}:
            raise Plain
    try:
        pass
    except* (One, Two):
        pass
    except* Three:
        return lambda q=lq: (yield q if c1 < c2 else {**k1, k2: k3})
    assert [u async for u in s if u and f"{fmt!r:>{width}}"], not (n := m)
class K(Base, mod.Other, metaclass=Meta):
    attr = -sl[lo:hi, *st]
type Alias[T: Bound] = list[T]
"""
    found = scopes(source)
    assert found["f"]["reads_from"] == sorted(
        "deco opt A B dflt C D kwd E R Ann v1 ctx other it y i v2 subject Point guard first err cause Plain One Two Three "
        "lq q c1 c2 k1 k2 k3 u s fmt width m".split())
    assert found["f"]["writes_to"] == ["i", "n", "u", "w", "x"]
    assert found["f"]["calls"] == ["ctx", "deco", "guard"] and found["f"]["raises"] == ["Plain"] and found["f"]["catches"] == ["Three"]
    assert found["K"]["reads_from"] == ["Base", "Meta", "hi", "lo", "mod", "sl", "st"] and found["K"]["writes_to"] == ["attr"]
    assert found["K"]["inherits_from"] == ["Base", "mod.Other"]
    assert found[MODULE_SCOPE]["writes_to"] == ["Alias"] and found[MODULE_SCOPE]["reads_from"] == ["Bound", "T", "list"]


def test_errors_are_rows():
    reading = read("def (")
    assert "line 1" in reading.error and reading.entities == []
    assert read("x = 1\0").error is not None
    assert read(None).error == "ValueError: content is missing or not UTF-8"
    with pytest.raises(SyntaxError):
        read("def (", on_error="fail")


def test_sanitized_node_map():
    reading = read("def f(): pass\ndef (\nclass C: pass\n", on_error="sanitize")
    assert reading.error and reading.n_lines_removed == 1
    assert [n for _, _, n in reading.node_map] == ["f", "C"]
    assert reading.entities == []


def test_unreadable_f_string_has_an_empty_node_map():
    reading = read("f'{\\n}'", on_error="sanitize")
    assert reading.node_map == [] and reading.n_lines_removed == 1


def test_deep_nesting_is_no_problem():
    chain = "x = " + " + ".join(["a"] * 900)
    assert scopes(chain)[MODULE_SCOPE]["reads_from"] == ["a"]


def test_lone_surrogates_are_escaped():
    assert read("'\\ud800'\n").docstring == "\\ud800"


def line_by_line(source):
    lines = source.split("\n")
    while True:
        try:
            return ast.dump(ast.parse("\n".join(lines)), include_attributes=True)
        except SyntaxError as problem:
            if problem.lineno is None or not 1 <= problem.lineno <= len(lines):
                return None
            del lines[problem.lineno - 1]


def test_sanitizing_keeps_what_removing_line_by_line_keeps(monkeypatch):
    monkeypatch.setattr(module_reader, "LINES_SET_ASIDE", 2)
    r = random.Random(9)
    good = ["x = 1", "def f():\n    return (1,\n  2)", "class C:\n    @d\n    def m(self): pass", "if a:\n    b\nelse:\n    c", "'''doc\nmore'''",
            "@deco\ndef g(): pass", "try:\n    a\nexcept E:\n    b", "y = [\n1,\n]", "z = 1 + \\\n  2", "# note", ""]
    bad = ["def (", "x = = 1", "  indented", ")", "'open", "class", "else:", "a b c", "f(", "'''"]
    for _ in range(150):
        source = "\n".join(r.choice(good if r.random() < 0.8 else bad) for _ in range(r.randrange(1, 15)))
        want = line_by_line(source)
        try:
            tree, _ = module_reader._parse_what_is_left(source)
            got = ast.dump(tree, include_attributes=True)
        except SyntaxError:
            got = None
        assert got == want, source


def test_sanitizing_a_missing_text_gives_its_row():
    reading = read(None, on_error="sanitize")
    assert reading.error.startswith("ValueError") and reading.node_map == []
