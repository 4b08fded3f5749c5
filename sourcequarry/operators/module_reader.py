"""What one source text says about itself. The only place that touches Python's ``ast``.

One loop over the tree yields definitions, relationship facts, imports and the node map
together. The loop keeps its own stack, so deep nesting does not exhaust Python's.
"""

import ast
import gc
import operator
import re
import warnings
from contextlib import contextmanager
from dataclasses import dataclass, field

MODULE_SCOPE = "<module>"

UNREADABLE = (SyntaxError, ValueError, RecursionError, MemoryError)

STATEMENT_FIELDS = {"body", "orelse", "handlers", "finalbody", "cases"}


class Scope:
    """Facts of one scope; redefinitions of a scope add to the same record."""

    __slots__ = ("name", "defined_in", "calls", "imports", "inherits_from", "reads_from",
                 "writes_to", "raises", "catches", "type_hints")

    def __init__(self, name, with_facts=True):
        self.name, self.defined_in = name, None
        if not with_facts:
            return
        self.calls, self.imports, self.inherits_from = set(), set(), set()
        self.reads_from, self.writes_to = set(), set()
        self.raises, self.catches = set(), set()
        self.type_hints = {}

    def row(self):
        return (self.name, self.defined_in, sorted(self.calls), sorted(self.imports),
                sorted(self.inherits_from), sorted(self.reads_from), sorted(self.writes_to),
                sorted(self.raises), sorted(self.catches),
                [(name, self.type_hints[name]) for name in sorted(self.type_hints)])


class Definition:
    __slots__ = ("node", "entity_type", "owner", "qualname", "ordinal")

    def __init__(self, node, entity_type, owner, qualname):
        self.node, self.entity_type, self.owner, self.qualname = node, entity_type, owner, qualname


@dataclass
class ModuleReading:
    docstring: str | None = None
    error: str | None = None
    n_lines_removed: int = 0
    entities: list = field(default_factory=list)
    scopes: list = field(default_factory=list)
    imports: list = field(default_factory=list)
    node_map: list = field(default_factory=list)
    counts: tuple | None = None


def read_module(source: str | None, *, records: set, mode: str, on_error: str, include_async: bool) -> ModuleReading:
    """Read the chosen ``records`` of one source text; the others stay empty."""
    reading = ModuleReading()
    try:
        if source is None:
            raise ValueError("content is missing or not UTF-8")
        tree = ast.parse(source)
        _collect(tree, reading, records, mode, include_async)
    except UNREADABLE as problem:
        if on_error == "fail":
            raise
        reading = ModuleReading(error=_message(problem))
        if on_error == "sanitize" and source is not None:
            try:
                tree, reading.n_lines_removed = _parse_what_is_left(source)
                readable = ModuleReading()
                _collect(tree, readable, {"node_map"}, mode, include_async)
                reading.node_map = readable.node_map
            except UNREADABLE:
                pass
    return reading


@contextmanager
def quiet_and_quick():
    """For many readings in a row: no warnings about the sources, and no garbage collection
    in between (trees hold no cycles)."""
    collecting = gc.isenabled()
    gc.disable()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            yield
    finally:
        if collecting:
            gc.enable()


def _message(problem):
    return encodable(str(problem) if isinstance(problem, SyntaxError) else f"{type(problem).__name__}: {problem}")


def _parse_what_is_left(source):
    """Drop the line each syntax error points at until the rest parses.

    Whole statements above an error stay read: they are set aside, and only what follows is
    parsed again."""
    lines = source.split("\n")
    removed = 0
    bodies, done = [], 0
    while True:
        try:
            rest = ast.parse("\n".join(lines[done:]))
        except SyntaxError as problem:
            at = problem.lineno
            if at is None or not 1 <= at <= len(lines) - done:
                raise
            del lines[done + at - 1]
            removed += 1
            good = _whole_statements(lines, done, done + at - 1)
            if good:
                head, end = good
                bodies.append((done, head))
                done = end
            continue
        if not bodies:
            return rest, removed
        for offset, tree in [*bodies, (done, rest)]:
            if offset:
                ast.increment_lineno(tree, offset)
        rest.body = [node for _, tree in bodies for node in tree.body] + rest.body
        return rest, removed


#: So many lines above an error are worth setting aside; fewer are cheaper to parse again.
LINES_SET_ASIDE = 50
_GOES_ON = re.compile(r"[\s#)\]}]|(?:elif|else|except|finally|case)\b|$")


def _whole_statements(lines, start, end):
    """The tree of the lines from ``start`` up to the last one before ``end`` where a top-level
    statement begins, and that line; None where they do not parse by themselves."""
    at = end
    while at - start >= LINES_SET_ASIDE:
        begins = at < len(lines) and not _GOES_ON.match(lines[at]) and not lines[at - 1].endswith("\\") and not lines[at - 1].startswith("@")
        if begins:
            try:
                return ast.parse("\n".join(lines[start:at])), at
            except SyntaxError:
                return None
        at -= 1
    return None


def encodable(text):
    """Lone surrogates (possible in literals) have no UTF-8 form; write them as escapes."""
    if text is None or text.isascii():
        return text
    return text.encode("utf-8", "backslashreplace").decode("utf-8")


def source_text(node):
    """Normalised text of an expression; common shapes avoid the general printer."""
    if node is None:
        return None
    if node.__class__ is ast.Name:
        return node.id
    names = []
    part = node
    while isinstance(part, ast.Attribute):
        names.append(part.attr)
        part = part.value
    if isinstance(part, ast.Name):
        names.append(part.id)
        return ".".join(reversed(names))
    if isinstance(node, ast.Constant) and (node.value is None or type(node.value) in (bool, int)):
        return repr(node.value)
    return encodable(ast.unparse(node))


def _docstring(node):
    return encodable(ast.get_docstring(node))


# Nodes with nothing of interest inside.
LEAVES = {ast.Constant, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal}

# Fields that never hold a node of interest.
PLAIN_FIELDS = {"ctx", "op", "ops", "names", "kwd_attrs", "attr", "arg", "id", "module", "level", "kind", "rest", "simple",
                "is_async", "conversion", "type_comment", "type_ignores"}


def _block_fields():
    """Nodes that hold statements, or are imports, with the fields of their statements, last first
    (the stack reverses them)."""
    holders = [k for k in vars(ast).values()
               if isinstance(k, type) and issubclass(k, (ast.Module, ast.stmt, ast.excepthandler, ast.match_case))]
    fields = {k: tuple(f for f in reversed(k._fields) if f in STATEMENT_FIELDS) for k in holders}
    return {k: found for k, found in fields.items() if found or k in (ast.Import, ast.ImportFrom)}


BLOCK_FIELDS = _block_fields()


def _part_getters():
    """What gives the parts of a node that can lead to names, beside its statements: for nodes
    with one such field, and for nodes with several."""
    one, several = {}, {}
    for kind in vars(ast).values():
        if not isinstance(kind, type) or not issubclass(kind, ast.AST) or kind in LEAVES:
            continue
        skipped = {*PLAIN_FIELDS, *BLOCK_FIELDS.get(kind, ())}
        if kind is not ast.TypeAlias:       # the others have a text there
            skipped.add("name")
        fields = [f for f in getattr(kind, "_fields", ()) if f not in skipped]
        if fields:
            (several if len(fields) > 1 else one)[kind] = operator.attrgetter(*fields)
    return one, several


ONE_PART, SEVERAL_PARTS = _part_getters()


def _collect(tree, reading, records, mode, include_async):
    if "docstring" in records:
        reading.docstring = _docstring(tree)
        if len(records) == 1:
            return
    with_scopes, with_imports, with_nodes = (r in records for r in ("scopes", "imports", "node_map"))
    module = Scope(MODULE_SCOPE, with_scopes)
    scopes = {MODULE_SCOPE: module}
    definitions, found = [], []
    function_kinds = (ast.FunctionDef, ast.AsyncFunctionDef) if include_async else (ast.FunctionDef,)
    methods_count = mode == "intended"

    pending = [(tree, module, None, 0)]
    while pending:
        node, scope, owner, depth = pending.pop()
        kind = node.__class__
        if kind is Definition:              # everything inside it is done
            node.ordinal = len(definitions)
            definitions.append(node)
            continue

        if kind in function_kinds or kind is ast.ClassDef:
            is_class = kind is ast.ClassDef
            if with_nodes:
                found.append((depth, "ClassDef" if is_class else "FunctionDef", (node.name,)))
            name = node.name if scope is module else f"{scope.name}.{node.name}"
            inner = scopes.get(name)
            if inner is None:
                inner = scopes[name] = Scope(name, with_scopes)
            inner.defined_in = scope.name
            if with_scopes:
                (_class_facts if is_class else _function_facts)(node, inner)
            entity_type = "class" if is_class else "method" if owner else "function"
            definition = Definition(node, entity_type, owner, name)
            if methods_count or owner is None:
                pending.append((definition, None, None, 0))
            scope, owner = inner, definition if is_class else owner
        elif kind is ast.Import or kind is ast.ImportFrom:
            direct = kind is ast.Import
            if with_nodes:
                found.append((depth, "Import" if direct else "ImportFrom", [a.name for a in node.names]))
            if with_scopes or with_imports:
                for alias in node.names:
                    target = alias.name if direct else f"{node.module or ''}.{alias.name}"
                    if with_scopes:
                        scope.imports.add(target)
                    if with_imports:
                        reading.imports.append(("direct" if direct else "from", target, len(reading.imports)))
            continue
        elif with_scopes and kind is ast.ExceptHandler:
            if isinstance(node.type, ast.Name):
                scope.catches.add(node.type.id)

        # Statements inside are taken in order where they hold or define something; what is left
        # of them, and of the node, only adds to sets, so it is read here in any order.
        depth += 1
        parts = [node]
        for name in BLOCK_FIELDS[kind]:
            for child in reversed(getattr(node, name)):
                if child.__class__ in BLOCK_FIELDS:
                    pending.append((child, scope, owner, depth))
                elif with_scopes:
                    parts.append(child)
        if not with_scopes:
            continue
        reads, writes, calls = scope.reads_from, scope.writes_to, scope.calls
        while parts:
            node = parts.pop()
            kind = node.__class__
            if kind is ast.Name:            # most nodes are names or constants
                use = node.ctx.__class__
                if use is ast.Load:
                    reads.add(node.id)
                elif use is ast.Store:
                    writes.add(node.id)
            elif kind is list:
                parts += node
            elif kind is ast.Call:
                called = node.func
                if called.__class__ is ast.Name:
                    calls.add(called.id)
                    reads.add(called.id)
                else:
                    if called.__class__ is ast.Attribute:
                        calls.add(source_text(called))
                    parts.append(called)
                parts += node.args
                parts += node.keywords
            elif kind in LEAVES:
                pass
            elif kind in ONE_PART:
                if part := ONE_PART[kind](node):
                    parts.append(part)
            elif kind in SEVERAL_PARTS:
                if kind is ast.Raise:
                    raised = node.exc.func if isinstance(node.exc, ast.Call) else node.exc
                    if isinstance(raised, ast.Name):
                        scope.raises.add(raised.id)
                parts += filter(None, SEVERAL_PARTS[kind](node))

    position = {name: at for at, name in enumerate(scopes)}
    if with_scopes:
        reading.scopes = [s.row() for s in scopes.values()]
    if "counts" in records:
        kinds = [d.entity_type for d in filter(_counts(definitions), definitions)]
        reading.counts = tuple(kinds.count(kind) for kind in ("class", "function", "method"))
    if "entities" in records:
        reading.entities = _entity_rows(definitions, position, mode)
    if with_nodes:
        # `found` is in depth-first order; a stable sort by depth makes it breadth-first.
        found.sort(key=lambda entry: entry[0])
        reading.node_map = [(node_type, at, name) for at, (_, node_type, names) in enumerate(found) for name in names]


def _class_facts(node, scope):
    for base in node.bases:
        if isinstance(base, (ast.Name, ast.Attribute)):
            scope.inherits_from.add(source_text(base))
    for decorator in node.decorator_list:
        called = decorator.func if isinstance(decorator, ast.Call) else decorator
        if isinstance(called, ast.Name):
            scope.calls.add(called.id)


def _function_facts(node, scope):
    if node.returns:
        scope.type_hints["return"] = source_text(node.returns)
    for argument in node.args.args:
        if argument.annotation:
            scope.type_hints[argument.arg] = source_text(argument.annotation)


def _parameters(node, mode):
    """Plain parameters; defaults belong to the last ones."""
    plain = node.args.args
    defaults = node.args.defaults if mode == "intended" else []
    padding = [None] * (len(node.args.posonlyargs) + len(plain) - len(defaults))
    values = (padding + list(defaults))[len(node.args.posonlyargs):]
    return [(a.arg, source_text(a.annotation), source_text(v)) for a, v in zip(plain, values)]


def _counts(definitions):
    """Whether a definition counts: the last of a name within the same owner does, if its owner does."""
    last = {(d.entity_type == "class", d.owner, d.node.name): d for d in definitions}

    def counts(d):
        while d is not None:
            if last[d.entity_type == "class", d.owner, d.node.name] is not d:
                return False
            d = d.owner
        return True

    return counts


def _entity_rows(definitions, position, mode):
    counts = _counts(definitions)
    rows = []
    for d in definitions:
        node, is_class = d.node, d.entity_type == "class"
        rows.append((
            d.entity_type,
            d.owner.node.name if d.owner else None,
            node.name,
            d.qualname,
            d.ordinal,
            counts(d),
            node.lineno,
            node.end_lineno,
            _docstring(node),
            None if is_class else source_text(node.returns),
            [source_text(x) for x in node.decorator_list],
            [source_text(x) for x in node.bases] if is_class else [],
            [] if is_class else _parameters(node, mode),
            position.get(d.qualname if mode == "intended" else node.name),
            d.owner.qualname if d.owner else None,
        ))
    return rows
