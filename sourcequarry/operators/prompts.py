"""One prompt per entity, from its facts, its file's overview and its repository's tree."""

from pyspark.sql import Column, DataFrame, functions as F

from sourcequarry.functions import text
from sourcequarry.operators import tree, views
from sourcequarry.operators.views import FILE
from sourcequarry.schema import SCOPE
from sourcequarry.sources.templates import TEMPLATES

# Fixed values.
SYSTEM_TEXT = "You are a helpful coding assistant."
INDENTED_SUMMARY = """Excellent work. Please provide a succinct summary of this {entity_type} in the following format:
        SUMMARY: 3-sentence summary goes here
        NOTES: any other comments or notes go here"""

# Defaults; the cut is part of the prompts' definition, since answers are found by their hash.
OVERVIEW_CHARS = 600
MODULE_CODE_CHARS = 4000

PROMPT_KEY = [*FILE, "entity_type", "owner_class", "owner_qualname", "name"]


def with_tree_excerpts(
    files: DataFrame, max_chars: int = OVERVIEW_CHARS, mode: str = "intended", partitions: int | None = None,
    targets: DataFrame | None = None,
) -> DataFrame:
    """Source files with the excerpt of their repository's tree, in ``partitions`` tasks
    where given (the join's own shuffle makes them; reading is heavy per byte, so more
    tasks than sizes alone suggest can pay). ``targets`` are the files that are wanted,
    with their texts (all by default); trees list the other files of their repositories too.

    Keys are unique on both sides, so a shuffle by file is even. Where ``files`` is a table
    bucketed by file, only the excerpts move. The texts are never broadcast, however short they are
    thought to be: files would then be read in the few tasks that make the excerpts.
    """
    anchor = "first_match" if mode == "reference" else "own_line"
    excerpts = tree.tree_excerpts(files, targets, max_chars=max_chars, anchor=anchor)
    wanted = files if targets is None else targets
    placed = wanted.repartition(partitions, *FILE) if partitions else wanted
    return placed.join(excerpts.hint("merge"), FILE)


def prompt_context(facts: DataFrame, max_chars: int = OVERVIEW_CHARS, mode: str = "intended") -> DataFrame:
    """Facts, extracted with ``tree_excerpt`` carried along, plus the file's node map text.
    Both are made once per file and are bounded in size."""
    read = facts.where(F.col("error").isNull())
    overview = read.withColumn("overview", views.node_map_text("node_map"))
    return overview.withColumn("overview", text.truncate_middle("overview", max_chars, mode))


def render_prompts(
    context: DataFrame, templates: dict[str, str] = TEMPLATES, mode: str = "intended", max_code_chars: int = MODULE_CODE_CHARS,
) -> DataFrame:
    """All prompts of all files: ``PROMPT_KEY``, ``ordinal``, ``prompt`` and its hash.

    What an entity needs is picked inside its file's row, then rows are unfolded and the
    templates filled in by compiled expressions; nothing is joined.
    """
    shared = ["rel_path", "tree_excerpt", "overview"]
    with_lines = context.withColumn("lines", text.source_lines("raw_code", mode))
    subjects = F.concat(_module_subject(mode, max_code_chars), _entity_subjects(mode))
    rows = with_lines.select("repo_id", *shared, F.inline(subjects))
    prompt = F.when(F.col("entity_type") == "module", _filled(templates["module"], _module_values(mode)))
    prompt = prompt.when(F.col("entity_type") == "class", _filled(templates["class"], _class_values(mode)))
    prompt = prompt.when(F.col("entity_type") == "method", _filled(templates["method"], _function_values(mode)))
    prompt = prompt.otherwise(_filled(templates["function"], _function_values(mode)))
    return rows.select(*PROMPT_KEY, "ordinal", prompt.alias("prompt")).withColumn(
        "prompt_hash", text.query_hash("prompt"))


# What the templates of all entity types draw on, as (name, type).
_SUBJECT = [
    ("entity_type", "string"), ("owner_class", "string"), ("owner_qualname", "string"), ("name", "string"), ("ordinal", "int"), ("code", "string"),
    ("found", SCOPE.simpleString()), ("decorators", "array<string>"), ("contains", "array<string>"),
    ("direct_imports", "array<string>"), ("from_imports", "array<string>"),
    ("classes", "array<string>"), ("functions", "array<string>"),
]


def _subject(**values: Column) -> Column:
    return F.struct(*[
        values[name].alias(name) if name in values else F.lit(None).cast(kind).alias(name) for name, kind in _SUBJECT])


def _names(entities: Column | str, wanted) -> Column:
    return F.transform(F.filter(entities, wanted), lambda e: e["name"])


def _targets(import_type: str) -> Column:
    of_type = F.filter("imports", lambda i: i["import_type"] == import_type)
    return F.array_distinct(F.transform(of_type, lambda i: i["target"]))


def _module_subject(mode: str, max_code_chars: int) -> Column:
    values = {
        "entity_type": F.lit("module"), "name": text.file_name("rel_path"), "ordinal": F.lit(-1),
        "code": text.truncate_middle("raw_code", max_code_chars, mode),
    }
    if mode == "intended":
        values["direct_imports"] = _targets("direct")
        values["from_imports"] = _targets("from")
        values["classes"] = _names("entities", lambda e: e["is_latest"] & (e["entity_type"] == "class"))
        values["functions"] = _names("entities", lambda e: e["is_latest"] & (e["entity_type"] == "function"))
    return F.array(_subject(**values))


def _entity_subjects(mode: str) -> Column:
    def subject(e: Column) -> Column:
        values = {
            "code": text.node_source("lines", e["lineno"], e["end_lineno"]),
            "found": F.get("scopes", e["scope_ix"]), "decorators": e["decorators"],
            **{name: e[name] for name in ("entity_type", "owner_class", "owner_qualname", "name", "ordinal")},
        }
        if mode == "intended":
            values["contains"] = F.when(e["entity_type"] == "class", _names(
                "entities", lambda m: m["is_latest"] & (m["owner_qualname"] == e["qualname"]) & (m["entity_type"] == "method")))
        return _subject(**values)

    return F.transform(F.filter("entities", lambda e: e["is_latest"]), subject)


def _filled(template: str, values: dict[str, Column]) -> Column:
    shared = {
        "human_readable_tree": F.col("tree_excerpt"), "path": F.col("rel_path"), "node_map": F.col("overview"),
        "raw_code": F.col("code"),
    }
    return text.fill_template(template, shared | values)


def _module_values(mode: str) -> dict[str, Column]:
    listed = ("direct_imports", "from_imports", "classes", "functions")
    return {name: text.format_list(name) for name in listed} | {"constants": F.lit("None")}


def _class_values(mode: str) -> dict[str, Column]:
    if mode == "reference":
        none = F.lit("None")
        return {"defined_in": F.lit("module"), "inherits": none, "decorators": none, "contains": none, "imports": none}
    return {
        "defined_in": F.col("found.defined_in"),
        "inherits": text.format_list("found.inherits_from"),
        "decorators": text.format_list("decorators"),
        "contains": text.format_list("contains"),
        "imports": text.format_list("found.imports"),
    }


def _function_values(mode: str) -> dict[str, Column]:
    defined_in = F.col("found.defined_in")
    return {
        "defined_in": text.parent_scope(defined_in) if mode == "reference" else defined_in,
        "calls": text.format_list("found.calls"),
        "reads": text.format_list("found.reads_from"),
        "writes": text.format_list("found.writes_to"),
        "raises": text.format_list("found.raises"),
        "catches": text.format_list("found.catches"),
        "type_hints": text.format_pairs("found.type_hints", "param", "annotation"),
    }


def has_prompt(prompts: DataFrame) -> DataFrame:
    """Rows with a prompt. Where its hash (``prompt_hash``) is given that tells, so that who asks
    for hashes only need not read the texts."""
    if "prompt_hash" in prompts.columns:
        return prompts.where(F.col("prompt_hash") != text.query_hash(F.lit("")))
    return prompts.where(F.length("prompt") > 0)


def summary_prompt(entity_type: Column | str, mode: str = "intended") -> Column:
    """The second question. In reference mode its inner lines keep their indentation."""
    template = INDENTED_SUMMARY if mode == "reference" else TEMPLATES["summary"]
    kind = F.col(entity_type) if isinstance(entity_type, str) else entity_type
    return text.fill_template(template, {"entity_type": kind})


def single_turn(prompt: Column | str) -> Column:
    return F.array(text.message("system", F.lit(SYSTEM_TEXT)), text.message("user", prompt))


def two_stage_turns(prompt: Column | str, answer: Column | str, summary: Column | str) -> Column:
    return F.array(
        text.message("system", F.lit(SYSTEM_TEXT)), text.message("user", prompt),
        text.message("assistant", answer), text.message("user", summary))


def conversations(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rows ``(key, turn, role, text)`` to one message array per conversation, in turn
    order. A conversation is one request to a model, so it fits a task."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return messages.groupBy(key).agg(F.transform(ordered, lambda m: F.struct(
        m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))
