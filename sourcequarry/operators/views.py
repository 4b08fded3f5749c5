"""Flat tables and per-file questions over ``extract_facts``. All narrow: no shuffle."""

from pyspark.sql import Column, DataFrame, functions as F

from sourcequarry.functions import text
from sourcequarry.schema import FACT_KINDS

FILE = ["repo_id", "rel_path"]

# The node types of the node map.
NODE_TYPES = ["FunctionDef", "ClassDef", "Import", "ImportFrom"]


def modules(facts: DataFrame) -> DataFrame:
    return facts.select(
        *FILE, text.file_name("rel_path").alias("file_name"), "raw_code",
        text.line_count("raw_code").alias("n_lines"), "docstring", "error",
    )


def parse_errors(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("error").isNotNull()).select(*FILE, "error", "n_lines_removed")


def entities(facts: DataFrame, latest_only: bool = True, with_source: bool = False, mode: str = "intended") -> DataFrame:
    """Functions, methods and classes. Of several definitions of one name only the last
    counts, as in a dictionary; the job marks it, since a file's definitions are together."""
    rows = F.col("entities")
    if latest_only:
        rows = F.filter(rows, lambda e: e["is_latest"])
    keep = facts
    if with_source:
        keep = keep.withColumn("lines", text.source_lines("raw_code", mode))
        rows = F.transform(rows, lambda e: e.withField(
            "raw_code", text.node_source(F.col("lines"), e["lineno"], e["end_lineno"])))
    return keep.select(*FILE, F.inline(rows))


def functions(facts: DataFrame) -> DataFrame:
    return entities(facts).where(F.col("entity_type") == "function")


def methods(facts: DataFrame) -> DataFrame:
    return entities(facts).where(F.col("entity_type") == "method")


def classes(facts: DataFrame, with_source: bool = False) -> DataFrame:
    return entities(facts, with_source=with_source).where(F.col("entity_type") == "class")


def all_functions(facts: DataFrame) -> DataFrame:
    """Functions and methods of every file."""
    return entities(facts).where(F.col("entity_type") != "class")


def function_parameters(entity_rows: DataFrame) -> DataFrame:
    return entity_rows.select(
        *FILE, "owner_class", "name", "qualname", F.posexplode("parameters").alias("position", "parameter"),
    ).select(*FILE, "owner_class", F.col("name").alias("function"), "qualname", "position", "parameter.*")


def function_flags(decorators: Column | str, mode: str = "intended") -> dict[str, Column]:
    """Static / class method / property. The reference looks for names with ``@``, which
    decorator texts never have."""
    d = F.col(decorators) if isinstance(decorators, str) else decorators
    at = "@" if mode == "reference" else ""
    return {
        "is_static": F.array_contains(d, f"{at}staticmethod"),
        "is_class_method": F.array_contains(d, f"{at}classmethod"),
        "is_property": F.array_contains(d, f"{at}property"),
    }


def scopes(facts: DataFrame) -> DataFrame:
    """Every class and function scope with the scope it is defined in."""
    return relationship_sets(facts).where(F.col("defined_in").isNotNull()).select(*FILE, "scope", "defined_in")


def relationship_sets(facts: DataFrame) -> DataFrame:
    """One row per scope, one sorted set per kind. The job builds the sets of a file in one go."""
    return facts.select(*FILE, F.inline("scopes"))


def fact_rows(facts: DataFrame, kinds: list[str] = FACT_KINDS) -> DataFrame:
    """Long form: one row per (scope, kind, target), distinct within a file."""
    def tagged(kind: str) -> Column:
        return F.transform(F.col(kind), lambda target: F.struct(F.lit(kind).alias("kind"), target.alias("target")))

    parts = [tagged(kind) for kind in kinds]
    return relationship_sets(facts).select(
        *FILE, "scope", F.inline(F.concat(*parts) if len(parts) > 1 else parts[0]))


def type_hints(facts: DataFrame) -> DataFrame:
    return relationship_sets(facts).select(*FILE, "scope", F.inline("type_hints"))


def type_hint_map(facts: DataFrame) -> DataFrame:
    hints = relationship_sets(facts).where(F.size("type_hints") > 0)
    return hints.select(*FILE, "scope", F.map_from_entries("type_hints").alias("type_hints"))


def imports(facts: DataFrame) -> DataFrame:
    return facts.select(*FILE, F.inline("imports"))


def node_map_rows(facts: DataFrame) -> DataFrame:
    """Nodes breadth-first: their place among the nodes and among the names."""
    return facts.select(*FILE, F.posexplode("node_map").alias("ordinal", "node")).select(*FILE, "ordinal", "node.*")


def _first_seen(nodes: Column, node_type: str) -> Column:
    return F.array_min(F.transform(F.filter(nodes, lambda n: n["node_type"] == node_type), lambda n: n["node_ordinal"]))


def limited_node_map(nodes: Column | str, max_types: int = 3) -> Column:
    """The nodes up to the one that brings the ``max_types``-th node type."""
    n = F.col(nodes) if isinstance(nodes, str) else nodes
    firsts = F.array_sort(F.array_compact(F.array(*[_first_seen(n, t) for t in NODE_TYPES])))
    last = F.try_element_at(firsts, F.lit(max_types))
    # An array of one, so that the last place is looked for once a file and not again at each of its nodes.
    kept = F.transform(F.array(last), lambda at: F.filter(n, lambda node: at.isNull() | (node["node_ordinal"] <= at)))
    return F.get(kept, F.lit(0))


def node_map_text(nodes: Column | str) -> Column:
    """The node map as a dictionary's text: types as first seen, names breadth-first."""
    n = F.col(nodes) if isinstance(nodes, str) else nodes

    def entry(node_type: str) -> Column:
        names = F.transform(F.filter(n, lambda x: x["node_type"] == node_type),
                            lambda x: F.concat(F.lit("'"), x["name"], F.lit("'")))
        shown = F.concat(F.lit(f"'{node_type}': ["), F.array_join(names, ", "), F.lit("]"))
        return F.when(F.size(names) > 0, F.struct(_first_seen(n, node_type).alias("at"), shown.alias("shown")))

    ordered = F.array_sort(F.array_compact(F.array(*[entry(t) for t in NODE_TYPES])))
    return F.concat(F.lit("{"), F.array_join(F.transform(ordered, lambda e: e["shown"]), ", "), F.lit("}"))


def entity_relationships(facts: DataFrame) -> DataFrame:
    """Entities with the facts of their scope. Each entity knows the place of its record
    (by qualified name, or by bare name in reference mode), so nothing is joined."""
    entity = F.filter("entities", lambda e: e["is_latest"])
    paired = F.transform(entity, lambda e: F.struct(
        *[e[name].alias(name) for name in ("entity_type", "owner_class", "name", "qualname")],
        F.get("scopes", e["scope_ix"]).alias("found"),
    ))
    kinds = ["defined_in", *FACT_KINDS, "type_hints"]
    return facts.select(*FILE, F.inline(paired)).select(
        *FILE, "entity_type", "owner_class", "name", "qualname", *[F.col(f"found.{k}").alias(k) for k in kinds])
