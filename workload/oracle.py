"""The same answers as SQL over the given tables.

The SQL states what the derived source files contain (see FIXTURES.md) from the columns
they are built of; it never sees the files' text, except to compare or hash it.
"""

from sourcequarry.operators.prompts import INDENTED_SUMMARY, SYSTEM_TEXT
from sourcequarry.sources.templates import TEMPLATES

NL = "chr(10)"
SPACE_CLASS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{SPACE_CLASS}|{SPACE_CLASS}$', '', 'g')"


# --- derived source files -------------------------------------------------------------

# One row per module: key k, customer c, status s, priority p, and n step functions.
MODULES = """src AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderpriority AS p, 1 + o_orderkey % 4 AS n,
         'r' || (o_custkey % 25) AS repo_id, 'd' || (o_orderkey // 100) || '/o' || o_orderkey || '.py' AS rel_path,
         ['staticmethod', 'classmethod', 'property', 'helper'][1 + o_orderkey % 4] AS deco,
         'd' || ((o_orderkey + 1) // 100) || '.o' || (o_orderkey + 1) AS imp1,
         'd' || ((o_orderkey + 7) // 100) || '.o' || (o_orderkey + 7) AS imp2,
         'd' || ((o_orderkey + 2) // 100) || '.o' || (o_orderkey + 2) AS imp3
  FROM orders)"""

# One row per definition of a step function: the i-th, with name step_j.
STEPS = """stp AS (
  SELECT src.*, (i * c) % 3 AS j, 'step_' || ((i * c) % 3) AS name, 'part_' || ((k * i) % 1000) AS part
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM src) AS src)"""

# One row per step function: the last definition of its name.
LAST_STEPS = "lst AS (SELECT * FROM stp QUALIFY row_number() OVER (PARTITION BY k, j ORDER BY i DESC) = 1)"


def step_text(i: str, c: str = "c", k: str = "k", s: str = "s") -> str:
    lines = [
        f"'def step_' || (({i} * {c}) % 3) || '(qty: float) -> int:'",
        "'    if qty < 0:'",
        f"'        raise Err' || {i} || '(qty)'",
        "'    try:'",
        f"'        out = part_' || (({k} * {i}) % 1000) || '(qty)'",
        f"'    except Late' || {s} || ':'",
        f"'        out = supp_' || {i}",
        "'    return out'",
    ]
    return f"concat_ws({NL}, {', '.join(lines)})"


CLASS_LINES = [
    "'class Order' || k || '(Base' || s || '):'",
    "'    \"\"\"' || p || '\"\"\"'",
    "'    def total(self):'",
    "'        return helper(self)'",
    "'    @' || deco",
    "'    def rank(self, n=1, *rest):'",
    "'        return n'",
]
CLASS_TEXT = f"concat_ws({NL}, {', '.join(CLASS_LINES)})"
TOTAL_TEXT = f"concat_ws({NL}, {', '.join(CLASS_LINES[2:4])})"
RANK_TEXT = f"concat_ws({NL}, {', '.join(CLASS_LINES[5:7])})"

HEAD_LINES = [
    "'\"\"\"order ' || k || '\"\"\"'",
    "'import os'",
    "'import ' || imp1 || ', ' || imp2",
    "'from lib_' || s || ' import helper'",
    "'from ' || split_part(imp3, '.', 1) || ' import ' || split_part(imp3, '.', 2)",
]
STEP_TEXTS = f"array_to_string(list_transform(range(1, n + 1), lambda i: {step_text('i')}), {NL})"
CODE = f"concat_ws({NL}, {', '.join(HEAD_LINES)}, {CLASS_TEXT}, {STEP_TEXTS}, '')"

# Entities in order of definition: methods before their class, steps as they come.
ENTITIES = f"""ent AS (
  SELECT src.*, 'method' AS entity_type, 'Order' || k AS owner_class, 'total' AS name, 'Order' || k || '.total' AS qualname,
         0 AS ordinal, {TOTAL_TEXT} AS code FROM src
  UNION ALL SELECT src.*, 'method', 'Order' || k, 'rank', 'Order' || k || '.rank', 1, {RANK_TEXT} FROM src
  UNION ALL SELECT src.*, 'class', NULL, 'Order' || k, 'Order' || k, 2, {CLASS_TEXT} FROM src
  UNION ALL SELECT lst.* EXCLUDE (i, j, name, part), 'function', NULL, name, name, 2 + i, {step_text('i')} FROM lst)"""

# All relationship facts, with their scopes.
FACTS = """fct AS (
  SELECT DISTINCT * FROM (
    SELECT repo_id, rel_path, '<module>' AS scope, NULL AS defined_in,
           unnest([{'kind': 'imports', 'target': 'os'}, {'kind': 'imports', 'target': imp1},
                   {'kind': 'imports', 'target': imp2}, {'kind': 'imports', 'target': 'lib_' || s || '.helper'},
                   {'kind': 'imports', 'target': imp3}], recursive := true) FROM src
    UNION ALL
    SELECT repo_id, rel_path, 'Order' || k, '<module>',
           unnest([{'kind': 'inherits_from', 'target': 'Base' || s}, {'kind': 'reads_from', 'target': 'Base' || s}],
                  recursive := true) FROM src
    UNION ALL
    SELECT repo_id, rel_path, 'Order' || k || '.total', 'Order' || k,
           unnest([{'kind': 'calls', 'target': 'helper'}, {'kind': 'reads_from', 'target': 'helper'},
                   {'kind': 'reads_from', 'target': 'self'}], recursive := true) FROM src
    UNION ALL
    SELECT repo_id, rel_path, 'Order' || k || '.rank', 'Order' || k,
           unnest([{'kind': 'reads_from', 'target': 'n'}, {'kind': 'reads_from', 'target': deco}],
                  recursive := true) FROM src
    UNION ALL
    SELECT repo_id, rel_path, name, '<module>',
           unnest([{'kind': 'calls', 'target': 'Err' || i}, {'kind': 'calls', 'target': part},
                   {'kind': 'raises', 'target': 'Err' || i}, {'kind': 'catches', 'target': 'Late' || s},
                   {'kind': 'writes_to', 'target': 'out'}, {'kind': 'reads_from', 'target': 'qty'},
                   {'kind': 'reads_from', 'target': 'float'}, {'kind': 'reads_from', 'target': 'int'},
                   {'kind': 'reads_from', 'target': 'out'}, {'kind': 'reads_from', 'target': 'Err' || i},
                   {'kind': 'reads_from', 'target': part}, {'kind': 'reads_from', 'target': 'Late' || s},
                   {'kind': 'reads_from', 'target': 'supp_' || i}], recursive := true) FROM stp))"""

KINDS = ["calls", "imports", "inherits_from", "reads_from", "writes_to", "raises", "catches"]


def joined_sets(separator: str = "|", empty: str = "''") -> str:
    return ", ".join(
        f"coalesce(string_agg(target, '{separator}' ORDER BY target) FILTER (kind = '{kind}'), {empty}) AS {kind}"
        for kind in KINDS)


SETS = f"st AS (SELECT repo_id, rel_path, scope, defined_in, {joined_sets()} FROM fct GROUP BY ALL)"
SHOWN = f"shw AS (SELECT repo_id, rel_path, scope, defined_in, {joined_sets(', ', quoted('None'))} FROM fct GROUP BY ALL)"

NODES = """nod AS (
  SELECT repo_id, rel_path, k, s, imp1, imp2, imp3, n, u.* FROM (
    SELECT src.*, unnest(list_concat(
      [{'node_type': 'Import', 'node_ordinal': 0, 'name': 'os'}, {'node_type': 'Import', 'node_ordinal': 1, 'name': imp1},
       {'node_type': 'Import', 'node_ordinal': 1, 'name': imp2}, {'node_type': 'ImportFrom', 'node_ordinal': 2, 'name': 'helper'},
       {'node_type': 'ImportFrom', 'node_ordinal': 3, 'name': split_part(imp3, '.', 2)},
       {'node_type': 'ClassDef', 'node_ordinal': 4, 'name': 'Order' || k}],
      list_transform(range(1, n + 1), lambda i: {'node_type': 'FunctionDef', 'node_ordinal': (4 + i)::INTEGER, 'name': 'step_' || ((i * c) % 3)}),
      [{'node_type': 'FunctionDef', 'node_ordinal': (5 + n)::INTEGER, 'name': 'total'},
       {'node_type': 'FunctionDef', 'node_ordinal': (6 + n)::INTEGER, 'name': 'rank'}])) AS u FROM src) AS x)"""

NODE_TEXT = (
    "'{''Import'': [''os'', ''' || imp1 || ''', ''' || imp2 || '''], ''ImportFrom'': [''helper'', ''' || split_part(imp3, '.', 2)"
    " || '''], ''ClassDef'': [''Order' || k || '''], ''FunctionDef'': [' || array_to_string(list_transform(range(1, n + 1),"
    " lambda i: '''step_' || ((i * c) % 3) || ''''), ', ') || ', ''total'', ''rank'']}'")

TREE_LINES = """lin AS (
  SELECT repo_id, rel_path, '/base/' || rel_path AS line,
         row_number() OVER w AS line_no,
         sum(length(rel_path) + 7) OVER w - length(rel_path) - 7 AS start,
         count(*) OVER r AS tree_lines, sum(length(rel_path) + 7) OVER r - 1 AS tree_chars
  FROM src WINDOW w AS (PARTITION BY repo_id ORDER BY rel_path), r AS (PARTITION BY repo_id))"""


def around(whole: str, target: str, limit: int, name: str, source: str, keep: str, clean: bool = True) -> list[str]:
    """CTEs that shorten ``whole`` around ``target``; the last is called ``name``."""
    place = f"""{name}_a AS (SELECT {keep}, {whole} AS w, length({whole}) AS n, strpos({whole}, {target}) - 1 AS pos,
  length({target}) AS tl FROM {source})"""
    parts = f"""{name}_b AS (SELECT *, n - (pos + tl) AS ca, n - {limit} AS q,
  CAST(round_even(pos / n * (n - {limit}), 0) AS BIGINT) AS rb FROM {name}_a)"""
    cuts = f"""{name}_c AS (SELECT *,
  CASE WHEN pos > 0 THEN greatest(0, pos // 2 - rb // 2) ELSE 0 END AS su,
  CASE WHEN pos > 0 THEN least(pos, pos // 2 + rb // 2) ELSE 0 END AS eu,
  CASE WHEN ca > 0 THEN greatest(pos + tl, pos + tl + ca // 2 - (q - rb) // 2) ELSE n END AS sl,
  CASE WHEN ca > 0 THEN least(n, pos + tl + ca // 2 + (q - rb) // 2) ELSE n END AS el FROM {name}_b)"""
    pieces = f"""{name}_d AS (SELECT *, substring(w, 1, su) AS h, substring(w, eu + 1, greatest(sl - eu, 0)) AS m,
  substring(w, el + 1) AS t FROM {name}_c)"""
    if clean:
        edges = f"""{name}_e AS (SELECT * REPLACE (
  CASE WHEN strpos(h, {NL}) > 0 THEN substring(h, 1, length(h) - strpos(reverse(h), {NL}) + 1) ELSE '' END AS h,
  CASE WHEN strpos(m, {NL}) > 0
       THEN substring(m, strpos(m, {NL}), length(m) - strpos(reverse(m), {NL}) + 2 - strpos(m, {NL})) ELSE m END AS m,
  CASE WHEN strpos(t, {NL}) > 0 THEN substring(t, strpos(t, {NL})) ELSE '' END AS t) FROM {name}_d)"""
    else:
        edges = f"{name}_e AS (SELECT * FROM {name}_d)"
    mark = "'... TRUNCATED ...'"
    result = f"""{name} AS (SELECT {keep}, CASE WHEN n <= {limit} THEN w ELSE {strip(
        f"concat(h, CASE WHEN h <> '' THEN {mark} ELSE '' END, m, CASE WHEN t <> '' THEN {mark} ELSE '' END, t)")}
  END AS shortened FROM {name}_e)"""
    return [place, parts, cuts, pieces, edges, result]


EXCERPTS = [
    f"tre AS (SELECT repo_id, string_agg('/base/' || rel_path, {NL} ORDER BY rel_path) AS tree FROM src GROUP BY repo_id)",
    "wth AS (SELECT src.*, tree FROM src JOIN tre USING (repo_id))",
    *around("tree", "rel_path", 600, "exc", "wth", "repo_id, rel_path"),
]


def filled(template: str, values: dict[str, str]) -> str:
    """A template as an SQL concatenation."""
    import string

    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(quoted(literal).replace("\n", "' || chr(10) || '"))
        if name is not None:
            parts.append(f"({values[name]})")
    return " || ".join(parts)


def _prompt_ctes(mode: str) -> list[str]:
    """``prm``: one row per entity with its prompt."""
    shared = {"human_readable_tree": "shortened", "path": "rel_path", "node_map": NODE_TEXT}
    both = "', '"
    if mode == "intended":
        module = {
            "direct_imports": f"array_to_string(list_sort(['os', imp1, imp2]), {both})",
            "from_imports": f"array_to_string(list_sort(['lib_' || s || '.helper', imp3]), {both})",
            "classes": "'Order' || k",
            "functions": f"array_to_string(list_sort(list_distinct(list_transform(range(1, n + 1), lambda i: 'step_' || ((i * c) % 3)))), {both})",
            "constants": "'None'",
        }
        of_class = {"defined_in": "defined_in", "inherits": "inherits_from", "decorators": "'None'",
                    "contains": "'rank, total'", "imports": "imports"}
        place = "defined_in"
    else:
        module = {name: "'None'" for name in ("direct_imports", "from_imports", "classes", "functions", "constants")}
        of_class = {"defined_in": "'module'", **{name: "'None'" for name in ("inherits", "decorators", "contains", "imports")}}
        place = "''"
    of_function = {
        "defined_in": place, "calls": "calls", "reads": "reads_from", "writes": "writes_to", "raises": "raises",
        "catches": "catches",
        "type_hints": "CASE WHEN entity_type = 'function' THEN 'qty: float, return: int' ELSE 'None' END",
    }
    code = {"raw_code": "code"}
    entities = "SELECT * FROM ent" + ("" if mode == "intended" else " WHERE entity_type <> 'method'")
    prompt = f"""CASE entity_type
    WHEN 'class' THEN {filled(TEMPLATES['class'], shared | code | of_class)}
    WHEN 'method' THEN {filled(TEMPLATES['method'], shared | code | of_function)}
    ELSE {filled(TEMPLATES['function'], shared | code | of_function)} END"""
    return [
        MODULES, STEPS, LAST_STEPS, ENTITIES, FACTS, SHOWN, *EXCERPTS,
        f"""prm AS (
  SELECT repo_id, rel_path, 'module' AS entity_type, NULL AS owner_class, 'o' || k || '.py' AS name,
         {filled(TEMPLATES['module'], shared | {'raw_code': CODE} | module)} AS prompt
  FROM src JOIN exc USING (repo_id, rel_path)
  UNION ALL
  SELECT repo_id, rel_path, entity_type, owner_class, name, {prompt}
  FROM ({entities}) AS e JOIN exc USING (repo_id, rel_path)
  JOIN shw USING (repo_id, rel_path) WHERE shw.scope = e.qualname)""",
    ]


def answer(text: str) -> str:
    return f"'A:' || substring(sha256({text}), 1, 16)"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _source_statements() -> dict[str, str]:
    src, stp, lst = MODULES, STEPS, LAST_STEPS
    ent = (src, stp, lst, ENTITIES)
    fct = (src, stp, FACTS)
    sets = (*fct, SETS)
    on = "repo_id, rel_path"
    scope_sets = f"scope, defined_in, {', '.join(KINDS)}"
    prefixed = "CASE k % 10 WHEN 0 THEN '_' WHEN 1 THEN 'test_' ELSE '' END"
    abs_path = "['/srv/code', '/srv/code2', '/opt'][1 + length(rel_path) % 3] || '/' || repo_id || '/' || rel_path"
    edge = f"""edg AS (
  SELECT DISTINCT a.repo_id, a.rel_path AS src_path, b.rel_path AS dst_path
  FROM (SELECT {on}, unnest([imp1, imp2, imp3]) AS target FROM src) AS a
  JOIN src AS b ON a.repo_id = b.repo_id AND replace(a.target, '.', '/') || '.py' = b.rel_path)"""
    steps_per_module = "(SELECT k, count(DISTINCT j) AS n_steps FROM stp GROUP BY k)"

    statements = {
        "scan_source_files": with_ctes(src) + f"SELECT {on}, md5({CODE}) AS content_md5, length({CODE}) AS n_chars FROM src",
        "list_files": with_ctes(src) + f"SELECT {on} FROM src",
        "scan_folder": with_ctes(src) + f"SELECT {on}, md5({CODE}) AS content_md5, length({CODE}) AS n_chars FROM src",
        "list_folder": with_ctes(src) + f"SELECT {on} FROM src",
        "eligible_files": with_ctes(src) + f"""SELECT repo_id, 'd' || (k // 100) || '/' || {prefixed} || 'o' || k || '.py' AS rel_path
  FROM src WHERE k % 10 NOT IN (0, 1)""",
        "relative_path": with_ctes(src) + f"""SELECT path, CASE WHEN starts_with(path, '/srv/code/') THEN substring(path, 11) ELSE path END AS rel_path
  FROM (SELECT {abs_path} AS path FROM src)""",
        "extract_functions": with_ctes(src, stp, lst) + f"""SELECT {on}, name, CAST(2 + i AS INTEGER) AS ordinal,
  CAST(13 + 8 * (i - 1) AS INTEGER) AS lineno, CAST(12 + 8 * i AS INTEGER) AS end_lineno, CAST(NULL AS VARCHAR) AS docstring,
  'int' AS return_annotation, 1 AS n_parameters, '' AS decorators FROM lst""",
        "extract_classes": with_ctes(src) + f"""SELECT {on}, 'Order' || k AS name, 6 AS lineno, 12 AS end_lineno, p AS docstring,
  'Base' || s AS bases, '' AS decorators, md5({CLASS_TEXT}) AS code_md5 FROM src""",
        "extract_methods": with_ctes(src) + f"""SELECT {on}, 'Order' || k AS owner_class, 'total' AS name, 'Order' || k || '.total' AS qualname,
  8 AS lineno, 9 AS end_lineno, '' AS decorators FROM src
  UNION ALL SELECT {on}, 'Order' || k, 'rank', 'Order' || k || '.rank', 11, 12, deco FROM src""",
        "extract_modules": with_ctes(src) + f"""SELECT {on}, 'o' || k || '.py' AS file_name, 13 + 8 * n AS n_lines, 'order ' || k AS docstring,
  CAST(NULL AS VARCHAR) AS error, md5({CODE}) AS code_md5 FROM src""",
        "function_parameters": with_ctes(src, stp, lst) + f"""
  SELECT {on}, 'Order' || k AS owner_class, 'total' AS function, 'Order' || k || '.total' AS qualname, 0 AS position,
         'self' AS name, CAST(NULL AS VARCHAR) AS annotation, CAST(NULL AS VARCHAR) AS default_value FROM src
  UNION ALL SELECT {on}, 'Order' || k, 'rank', 'Order' || k || '.rank', 0, 'self', NULL, NULL FROM src
  UNION ALL SELECT {on}, 'Order' || k, 'rank', 'Order' || k || '.rank', 1, 'n', NULL, '1' FROM src
  UNION ALL SELECT {on}, NULL, name, name, 0, 'qty', 'float', NULL FROM lst""",
        "function_flags": with_ctes(src) + f"""SELECT {on}, 'Order' || k || '.total' AS qualname, false AS is_static, false AS is_class_method,
  false AS is_property FROM src
  UNION ALL SELECT {on}, 'Order' || k || '.rank', k % 4 = 0, k % 4 = 1, k % 4 = 2 FROM src""",
        "node_map_rows": with_ctes(src, NODES) + f"""SELECT {on}, CAST(row_number() OVER (PARTITION BY k ORDER BY node_ordinal, name = imp2) - 1 AS INTEGER) AS ordinal,
  node_type, node_ordinal, name FROM nod""",
        "node_map_limited": with_ctes(src, NODES) + f"""SELECT {on}, CAST(row_number() OVER (PARTITION BY k ORDER BY node_ordinal, name = imp2) - 1 AS INTEGER) AS ordinal,
  node_type, node_ordinal, name FROM nod WHERE node_ordinal <= 4""",
        "node_map": with_ctes(src) + f"SELECT {on}, {NODE_TEXT} AS node_map FROM src",
        "sanitized_node_map": with_ctes(src) + f"""SELECT {on}, CASE WHEN k % 97 = 0 THEN 1 ELSE 0 END AS n_lines_removed, k % 97 = 0 AS is_broken,
  {NODE_TEXT} AS node_map FROM src""",
        "parse_errors": with_ctes(src) + f"""SELECT {on}, 'invalid syntax (<unknown>, line ' || (13 + 8 * n) || ')' AS error
  FROM src WHERE k % 97 = 0""",
        "scopes": with_ctes(*fct) + f"SELECT DISTINCT {on}, scope, defined_in FROM fct WHERE defined_in IS NOT NULL",
        "imports": with_ctes(src) + f"""SELECT {on}, unnest([{{'import_type': 'direct', 'target': 'os', 'ordinal': 0}},
  {{'import_type': 'direct', 'target': imp1, 'ordinal': 1}}, {{'import_type': 'direct', 'target': imp2, 'ordinal': 2}},
  {{'import_type': 'from', 'target': 'lib_' || s || '.helper', 'ordinal': 3}},
  {{'import_type': 'from', 'target': imp3, 'ordinal': 4}}], recursive := true) FROM src""",
        "type_hints": with_ctes(src, stp, lst) + f"""SELECT {on}, name AS scope, 'qty' AS param, 'float' AS annotation FROM lst
  UNION ALL SELECT {on}, name, 'return', 'int' FROM lst""",
        "type_hint_map": with_ctes(src, stp, lst) + f"SELECT {on}, name AS scope, 'qty: float, return: int' AS type_hints FROM lst",
        "node_source": with_ctes(*ent) + f"SELECT {on}, qualname, md5(code) AS code_md5 FROM ent",
        "latest_definitions": with_ctes(*ent) + f"SELECT {on}, entity_type, owner_class, name, CAST(ordinal AS INTEGER) AS ordinal FROM ent",
        "relationship_sets": with_ctes(*sets) + f"SELECT {on}, {scope_sets} FROM st",
        "relationship_sets_from_rows": with_ctes(*sets) + f"SELECT {on}, scope, {', '.join(KINDS)} FROM st",
        "merge_relationships": with_ctes(*sets) + f"""SELECT {on}, {scope_sets},
  CASE WHEN starts_with(scope, 'step_') THEN 'qty: float, return: int' ELSE 'None' END AS type_hints FROM st""",
        "entity_relationships": with_ctes(*ent, FACTS, SETS) + f"""SELECT ent.repo_id, ent.rel_path, entity_type, qualname, defined_in, {', '.join(KINDS)}
  FROM ent JOIN st ON st.repo_id = ent.repo_id AND st.rel_path = ent.rel_path AND st.scope = ent.qualname""",
        "latest_definitions_from_rows": with_ctes(*ent) + f"SELECT {on}, entity_type, owner_class, name, CAST(ordinal AS INTEGER) AS ordinal FROM ent",
        "entity_relationships_from_rows": with_ctes(*ent, FACTS, SETS) + f"""SELECT ent.repo_id, ent.rel_path, entity_type, qualname, defined_in, {', '.join(KINDS)}
  FROM ent JOIN st ON st.repo_id = ent.repo_id AND st.rel_path = ent.rel_path AND st.scope = ent.qualname""",
        "dependency_graph": with_ctes(src, edge) + "SELECT * FROM edg",
        "dependency_sets": with_ctes(src, edge) + f"""SELECT src.repo_id, rel_path, coalesce(string_agg(dst_path, '|' ORDER BY dst_path), '') AS dependencies
  FROM src LEFT JOIN edg ON edg.repo_id = src.repo_id AND edg.src_path = src.rel_path GROUP BY src.repo_id, rel_path""",
        "module_statistics": with_ctes(src, stp) + f"""SELECT repo_id, count(*) AS total_modules, count(*) AS total_classes,
  CAST(sum(n_steps) AS BIGINT) AS total_functions, 2 * count(*) AS total_methods, CAST(sum(13 + 8 * n) AS BIGINT) AS total_lines
  FROM src JOIN {steps_per_module} USING (k) GROUP BY repo_id""",
        "run_summary": with_ctes(src, stp) + f"""SELECT count(*) AS files_analyzed, CAST(sum(n_steps + 2) AS BIGINT) AS functions_found,
  count(*) AS classes_found FROM src JOIN {steps_per_module} USING (k)""",
        "all_functions": with_ctes(*ent) + f"SELECT {on}, entity_type, owner_class, name FROM ent WHERE entity_type <> 'class'",
        "all_classes": with_ctes(*ent) + f"SELECT {on}, name FROM ent WHERE entity_type = 'class'",
        "file_tree": with_ctes(src, TREE_LINES) + f"""SELECT {on}, line, line_no, CAST(start AS BIGINT) AS start, tree_lines,
  CAST(tree_chars AS BIGINT) AS tree_chars FROM lin""",
        "prompt_context": with_ctes(src, *EXCERPTS) + f"SELECT {on}, {NODE_TEXT} AS overview, shortened AS tree_excerpt FROM exc JOIN src USING ({on})",
        "tree_excerpts_first_match": with_ctes(src, *EXCERPTS) + f"SELECT {on}, shortened AS tree_excerpt FROM exc",
        "render_prompts": with_ctes(*_prompt_ctes("intended")) + f"SELECT {on}, entity_type, owner_class, name, sha256(prompt) AS prompt_hash FROM prm",
        "render_prompts_reference": with_ctes(*_prompt_ctes("reference")) + f"SELECT {on}, entity_type, owner_class, name, sha256(prompt) AS prompt_hash FROM prm",
        "analyze_corpus": with_ctes(*_prompt_ctes("intended")) + f"""SELECT {on}, entity_type, owner_class, name, {answer('prompt')} AS initial_analysis,
  {answer(filled(TEMPLATES['summary'], {'entity_type': 'entity_type'}))} AS summary FROM prm""",
        "attach_analyses": with_ctes(*ent) + f"""SELECT {on}, entity_type, owner_class, name,
  CASE WHEN entity_type = 'function' THEN substring(md5(repo_id || '/' || rel_path || '/' || name), 1, 8) END AS initial_analysis,
  CASE WHEN entity_type = 'function' THEN 'short' END AS summary FROM ent""",
        "compact_report": with_ctes(*ent, FACTS, "jsn AS (SELECT repo_id, rel_path, scope, "
                                    + ", ".join(f"string_agg('\"' || target || '\"', ',' ORDER BY target) FILTER (kind = '{kind}') AS {kind}" for kind in KINDS)
                                    + " FROM fct GROUP BY ALL)") + f"""SELECT ent.repo_id, ent.rel_path, owner_class, name, '{{' || concat_ws(',',
    '"name":"' || name || '"',
    '"parameters":[' || CASE name WHEN 'total' THEN '{{"name":"self"}}' WHEN 'rank' THEN '{{"name":"self"}},{{"name":"n","default_value":"1"}}'
       ELSE '{{"name":"qty","annotation":"float"}}' END || ']',
    CASE WHEN entity_type = 'function' THEN '"return_annotation":"int"' END,
    CASE WHEN name = 'rank' THEN '"decorators":["' || deco || '"]' END,
    '"raw_code":' || to_json(code),
    CASE WHEN entity_type = 'method' THEN '"is_method":true' END,
    CASE WHEN name = 'rank' AND deco = 'staticmethod' THEN '"is_static":true'
         WHEN name = 'rank' AND deco = 'classmethod' THEN '"is_class_method":true'
         WHEN name = 'rank' AND deco = 'property' THEN '"is_property":true' END,
    '"calls":[' || calls || ']', '"assigns_to":[' || writes_to || ']', '"reads_from":[' || reads_from || ']') || '}}' AS report
  FROM ent JOIN jsn ON jsn.repo_id = ent.repo_id AND jsn.rel_path = ent.rel_path AND jsn.scope = ent.qualname
  WHERE entity_type <> 'class'""",
        "save_report": with_ctes(src) + f"""SELECT {on}, md5({CODE}) AS code_md5, 'classes|functions|imports|path|raw_code' AS keys,
  array_to_string(list_sort(list_distinct(list_transform(range(1, n + 1), lambda i: 'step_' || ((i * c) % 3)))), '|') AS functions,
  'Order' || k AS classes, '["os","' || imp1 || '","' || imp2 || '"]' AS direct_imports FROM src""",
        "answered_reports": with_ctes(src) + f"""SELECT {on}, path || name AS prompt, substring(md5(path || name), 1, 8) AS module_analysis,
  CASE WHEN one THEN path || 'step_1' END AS step_prompt, CASE WHEN one THEN substring(md5(path || 'step_1'), 1, 8) END AS step_analysis,
  CASE WHEN one THEN 'short' END AS step_summary, len(steps) + 2 AS n_functions, CAST(1 AS BIGINT) AS n_classes
  FROM (SELECT {on}, repo_id || '/' || rel_path || '/' AS path, 'o' || k || '.py' AS name, list_contains(steps, 1) AS one, steps
    FROM (SELECT *, list_distinct(list_transform(range(1, n + 1), lambda i: (i * c) % 3)) AS steps FROM src))""",
        "format_list": with_ctes(*fct, SHOWN) + f"SELECT {on}, scope, calls, reads_from AS reads FROM shw",
        "format_dict": with_ctes(*fct, SHOWN) + f"""SELECT {on}, scope,
  CASE WHEN starts_with(scope, 'step_') THEN 'qty: float, return: int' ELSE 'None' END AS type_hints FROM shw""",
        "parent_scope": with_ctes(*fct) + f"""SELECT DISTINCT {on}, scope,
  CASE WHEN scope LIKE '%.%' THEN 'Order' || regexp_extract(scope, '[0-9]+') ELSE '' END AS parent FROM fct""",
        "qualified_name": with_ctes(*fct) + f"SELECT DISTINCT {on}, scope, scope AS qualified FROM fct WHERE defined_in IS NOT NULL",
        "import_to_path": with_ctes(src) + f"""SELECT {on}, unnest(range(5))::INTEGER AS ordinal,
  unnest(['os.py', replace(imp1, '.', '/') || '.py', replace(imp2, '.', '/') || '.py', 'lib_' || s || '/helper.py',
          replace(imp3, '.', '/') || '.py']) AS path FROM src""",
    }
    for name, kind in [("inherits_edges", "inherits_from"), ("call_edges", "calls"), ("variable_reads", "reads_from"),
                       ("variable_writes", "writes_to"), ("raises", "raises"), ("catches", "catches")]:
        statements[name] = with_ctes(*fct) + f"SELECT {on}, scope, target FROM fct WHERE kind = '{kind}'"
    return statements


# --- cache and inference --------------------------------------------------------------

LOG = """lg AS (
  SELECT sha256(event_type || ':' || user_id) AS query_hash, event_type || ':' || user_id AS prompt,
         event_id::VARCHAR AS response, ts, props AS metadata, event_id AS seq, event_type FROM events)"""
CURRENT = "cur AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY query_hash ORDER BY ts DESC, seq DESC) = 1)"
REQUESTS = """req AS (
  SELECT event_id, event_type || ':' || (user_id + 75) AS prompt, sha256(event_type || ':' || (user_id + 75)) AS query_hash FROM events)"""


def _b64(expr: str) -> str:
    return f"base64(encode({expr}))"


def _cache_statements() -> dict[str, str]:
    stored = f"""query_hash, {_b64('prompt')} AS prompt_b64, {_b64('response')} AS response_b64, ts, metadata, seq,
  substring(query_hash, 1, 2) AS hash_prefix"""
    conversation = f"""cnv AS (
  SELECT conv_id, string_agg(role || ': ' || text, {NL} ORDER BY turn) AS key, arg_max(text, turn) AS last_text
  FROM conversations GROUP BY conv_id)"""
    return {
        "cache_scan": with_ctes(LOG) + "SELECT query_hash, prompt, response, ts, metadata FROM lg",
        "cache_decode": with_ctes(LOG) + "SELECT query_hash, prompt, response, metadata->>'$.k' AS k FROM lg",
        "cache_metadata": """SELECT event_id, '{"k":' || (props->'$.k') || '}' AS stored, CAST(NULL AS VARCHAR) AS emptied,
  props->>'$.k' AS k FROM events""",
        "cache_put": with_ctes(LOG) + f"SELECT {stored}, 'put' AS op FROM lg",
        "cache_current": with_ctes(LOG, CURRENT) + f"SELECT {stored} FROM cur",
        "cache_lookup": with_ctes(LOG, CURRENT, REQUESTS) + """SELECT event_id, req.prompt, req.query_hash, response, response IS NOT NULL AS cache_hit
  FROM req LEFT JOIN cur USING (query_hash)""",
        "cache_misses": with_ctes(LOG, CURRENT, REQUESTS) + """SELECT DISTINCT query_hash, prompt FROM req
  WHERE query_hash NOT IN (SELECT query_hash FROM cur)""",
        "cache_lookup_stored": with_ctes(LOG, CURRENT, REQUESTS) + """SELECT event_id, req.prompt, req.query_hash, response, response IS NOT NULL AS cache_hit
  FROM req LEFT JOIN cur USING (query_hash)""",
        "cache_misses_stored": with_ctes(LOG, CURRENT, REQUESTS) + """SELECT DISTINCT query_hash, prompt FROM req
  WHERE query_hash NOT IN (SELECT query_hash FROM cur)""",
        "cache_stats": with_ctes(LOG, CURRENT) + f"""SELECT count(*) AS total_entries, min(ts) AS oldest_entry, max(ts) AS newest_entry,
  CAST(coalesce(sum(length({_b64('prompt')}) + length({_b64('response')})), 0) AS BIGINT) AS total_size_bytes FROM cur""",
        "cache_invalidate": with_ctes(LOG, CURRENT) + "SELECT query_hash, ts FROM cur WHERE event_type <> 'click'",
        "cache_clear_all": with_ctes(LOG, CURRENT) + "SELECT count(*) AS n_removed, CAST(0 AS BIGINT) AS n_left FROM cur",
        "cache_clear_older": with_ctes(LOG, CURRENT) + "SELECT query_hash, ts FROM cur WHERE ts >= TIMESTAMP '2024-01-28'",
        "batch_query": f"SELECT doc_id AS entity_id, {answer('text')} AS response FROM documents",
        "batch_query_nocache": f"SELECT doc_id AS entity_id, {answer('text')} AS response FROM documents",
        "batch_query_multi_turn": with_ctes(conversation) + f"SELECT conv_id, {answer('last_text')} AS response FROM cnv",
        "two_stage_analysis": f"""SELECT doc_id AS entity_id, {answer('text')} AS initial_analysis,
  {answer(filled(TEMPLATES['summary'], {'entity_type': quoted('function')}))} AS summary FROM documents""",
        "conversation_key": with_ctes(conversation) + "SELECT conv_id, sha256(key) AS query_hash FROM cnv",
        "export_interactions": f"""SELECT sha256(text) AS query_hash, md5('PROMPT:' || {NL} || text || {NL} || {NL} || repeat('=', 80) || {NL}
  || 'RESPONSE:' || {NL} || repeat('=', 80) || {NL} || {NL} || substring(md5(text), 1, 8) || {NL}) AS document_md5 FROM documents""",
        "has_prompt": "SELECT doc_id FROM documents WHERE lang <> 'en' AND length(text) > 0",
        "summary_prompt": f"""SELECT doc_id, {filled(TEMPLATES['summary'], {'entity_type': 'lang'})} AS intended,
  {filled(INDENTED_SUMMARY, {'entity_type': 'lang'})} AS reference FROM documents""",
        "message_array": f"""SELECT doc_id AS entity_id, unnest(range(4))::INTEGER AS position,
  unnest(['system', 'user', 'assistant', 'user']) AS role,
  unnest([md5({quoted(SYSTEM_TEXT)}), md5(text), md5(substring(md5(text), 1, 8)), md5('Sum up.')]) AS content_md5 FROM documents""",
    }


# --- text functions -------------------------------------------------------------------

def _text_statements() -> dict[str, str]:
    n, limit = "length(text)", 1000
    excess = f"({n} - {limit})"
    start = f"({limit // 2} - {excess} // 2)"
    cut = f"greatest({start}, 0)"
    python_cut = f"CASE WHEN {start} >= 0 THEN {start} ELSE greatest({n} + {start}, 0) END"

    def middle(kept: str, end: str) -> str:
        missing = f"substring(text, ({kept}) + 1, greatest(({end}) - ({kept}), 0))"
        lines = f"(length({missing}) - length(replace({missing}, {NL}, '')))"
        return (f"CASE WHEN {n} <= {limit} THEN text ELSE substring(text, 1, {kept}) || ' ... TRUNCATED ' || {lines} || ' LINES AND '"
                f" || {excess} || ' CHARACTERS ... ' || substring(text, ({end}) + 1) END")

    target = "substring(text, length(text) // 2 + 1, 20)"
    return {
        "query_hash": "SELECT doc_id, sha256(text) AS query_hash FROM documents",
        "short_hash": "SELECT doc_id, substring(md5(text), 1, 8) AS short_hash FROM documents",
        "encode_base64": f"SELECT doc_id, {_b64('text')} AS encoded FROM documents",
        "decode_base64": "SELECT doc_id, text AS decoded, true AS damaged FROM documents",
        "truncate_middle": f"""SELECT doc_id, {middle(cut, f'{cut} + {excess}')} AS intended,
  {middle(python_cut, f'{start} + {excess}')} AS reference FROM documents""",
        "truncate_around": with_ctes(
            *around("text", target, 600, "a", "documents", "doc_id"),
            *around("text", target, 600, "b", "documents", "doc_id", clean=False),
        ) + "SELECT doc_id, a.shortened, b.shortened AS uncleaned FROM a JOIN b USING (doc_id)",
        "line_count": f"SELECT doc_id, length(text) - length(replace(text, {NL}, '')) + 1 AS n_lines FROM documents",
        "format_timestamp": "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS short, strftime(ts, '%Y%m%d_%H%M%S_%f') AS long FROM events",
        "iso_timestamp": """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S')
    || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS iso,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso_whole, true AS same FROM events""",
        "artifact_name": """SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') || '_query_' || substring(md5(props), 1, 8) || '_prompt.txt' AS log_name,
  'llm_interaction_' || strftime(ts, '%Y%m%d_%H%M%S_%f') || '.txt' AS interaction_name FROM events""",
    }


def statements() -> dict[str, str]:
    return _source_statements() | _cache_statements() | _text_statements()
