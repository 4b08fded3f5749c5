"""Every registered query: ``(spark, sf_dir) -> DataFrame`` with flat, named columns."""

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sourcequarry.functions import text
from sourcequarry.operators import cache, excerpt, extract, inference, prompts, report, rollups, tree, views
from sourcequarry.operators.views import FILE
from sourcequarry.plans import corpus
from sourcequarry.runtime import materialize, new_table_path
from sourcequarry.schema import FACT_KINDS
from sourcequarry.sources import cache_table, files as file_source, report_files
from workload import inputs

cloudpickle.register_pickle_by_value(inputs)

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _facts(spark, sf_dir, *records, with_source=False, broken=False, **options) -> DataFrame:
    """Facts of all source files, restricted to the records the query needs."""
    return extract.extract_facts(
        inputs.source_files(spark, sf_dir, broken), records=records, with_source=with_source, **options)


def _counted(spark, sf_dir) -> DataFrame:
    """Light facts for statistics: lines are counted before the texts are read, and no text
    comes back."""
    files = inputs.source_files(spark, sf_dir)
    return extract.extract_facts(files.withColumn("n_lines", text.line_count("content")), records=["counts"],
                                 with_source=False, carry=["n_lines"])


def _stored_files(spark, sf_dir) -> DataFrame:
    """The source files as the loader reads them from a table."""
    path = new_table_path(spark, "source-files")
    inputs.source_files(spark, sf_dir).write.parquet(path)
    return file_source.read_source_table(spark, path)


def _from_folders(spark, sf_dir, read: Callable[[str], DataFrame]) -> DataFrame:
    """What is read from every root of the source files; no more than one root is stored at once."""
    path = new_table_path(spark, "folder-rows")
    for root in inputs.source_folders(spark, sf_dir):
        rows = read(root)
        rows.write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _joined(name: str, separator: str = "|") -> Column:
    return F.array_join(name, separator).alias(name)


# --- sources --------------------------------------------------------------------------

@query
def scan_source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_files(spark, sf_dir).select(
        *FILE, F.md5("content").alias("content_md5"), F.length("content").cast("long").alias("n_chars"))


@query
def list_files(spark, sf_dir):
    return _stored_files(spark, sf_dir).select(*FILE)


@query
def scan_folder(spark, sf_dir):
    """The source files as the loader reads them from folders of files."""
    return _from_folders(spark, sf_dir, lambda root: file_source.scan_source_files(spark, root).select(
        *FILE, F.md5("content").alias("content_md5"), F.length("content").cast("long").alias("n_chars")))


@query
def list_folder(spark, sf_dir):
    return _from_folders(spark, sf_dir, lambda root: file_source.list_files(spark, root).select(*FILE))


@query
def eligible_files(spark, sf_dir):
    """File names get prefixes by the last digit of their key, so some are not eligible."""
    digit = F.regexp_extract("rel_path", r"(\d)\.py$", 1)
    prefix = F.when(digit == "0", F.lit("_")).when(digit == "1", F.lit("test_")).otherwise(F.lit(""))
    folder = F.substring_index("rel_path", "/", 1)
    renamed = F.concat(folder, F.lit("/"), prefix, text.file_name("rel_path"))
    files = inputs.source_files(spark, sf_dir).select("repo_id", renamed.alias("rel_path"))
    return file_source.eligible_files(files)


@query
def relative_path(spark, sf_dir):
    """Absolute paths below one of three roots; only the first root is the repository's."""
    where = F.element_at(F.array(F.lit("/srv/code"), F.lit("/srv/code2"), F.lit("/opt")),
                         (F.length("rel_path") % 3 + 1).cast("int"))
    paths = inputs.source_files(spark, sf_dir).select(F.concat(where, F.lit("/"), "repo_id", F.lit("/"), "rel_path").alias("path"))
    return paths.select("path", text.relative_path("path", F.lit("/srv/code/")).alias("rel_path"))


# --- extraction -----------------------------------------------------------------------

@query
def extract_functions(spark, sf_dir):
    return views.functions(_facts(spark, sf_dir, "entities")).select(
        *FILE, "name", "ordinal", "lineno", "end_lineno", "docstring", "return_annotation",
        F.size("parameters").alias("n_parameters"), _joined("decorators"))


@query
def extract_classes(spark, sf_dir):
    """Classes with everything that is recorded of them, their source too."""
    return views.classes(_facts(spark, sf_dir, "entities", with_source=True), with_source=True).select(
        *FILE, "name", "lineno", "end_lineno", "docstring", _joined("bases"), _joined("decorators"), F.md5("raw_code").alias("code_md5"))


@query
def extract_methods(spark, sf_dir):
    return views.methods(_facts(spark, sf_dir, "entities")).select(
        *FILE, "owner_class", "name", "qualname", "lineno", "end_lineno", _joined("decorators"))


@query
def extract_modules(spark, sf_dir):
    return views.modules(_facts(spark, sf_dir, "docstring", with_source=True)).select(
        *FILE, "file_name", "n_lines", "docstring", "error", F.md5("raw_code").alias("code_md5"))


@query
def function_parameters(spark, sf_dir):
    return views.function_parameters(views.all_functions(_facts(spark, sf_dir, "entities")))


@query
def function_flags(spark, sf_dir):
    rows = views.methods(_facts(spark, sf_dir, "entities"))
    return rows.select(*FILE, "qualname", *[c.alias(n) for n, c in views.function_flags("decorators").items()])


@query
def node_map_rows(spark, sf_dir):
    return views.node_map_rows(_facts(spark, sf_dir, "node_map"))


@query
def node_map_limited(spark, sf_dir):
    facts = _facts(spark, sf_dir, "node_map")
    return views.node_map_rows(facts.withColumn("node_map", views.limited_node_map("node_map", 3)))


@query
def node_map(spark, sf_dir):
    facts = _facts(spark, sf_dir, "node_map")
    texts = facts.select(*FILE, views.node_map_text("node_map").alias("node_map"))
    return texts.select(*FILE, text.truncate_middle("node_map", 600).alias("node_map"))


@query
def sanitized_node_map(spark, sf_dir):
    facts = _facts(spark, sf_dir, "node_map", broken=True, on_error="sanitize")
    return facts.select(*FILE, "n_lines_removed", F.col("error").isNotNull().alias("is_broken"),
                        views.node_map_text("node_map").alias("node_map"))


@query
def parse_errors(spark, sf_dir):
    return views.parse_errors(_facts(spark, sf_dir, "docstring", broken=True)).select(*FILE, "error")


@query
def scopes(spark, sf_dir):
    return views.scopes(_facts(spark, sf_dir, "scopes"))


def _fact_query(name: str, kind: str) -> None:
    def run(spark, sf_dir):
        return views.fact_rows(_facts(spark, sf_dir, "scopes"), [kind]).drop("kind")

    QUERIES[name] = run


for _name, _kind in [
    ("inherits_edges", "inherits_from"), ("call_edges", "calls"), ("variable_reads", "reads_from"),
    ("variable_writes", "writes_to"), ("raises", "raises"), ("catches", "catches"),
]:
    _fact_query(_name, _kind)


@query
def imports(spark, sf_dir):
    return views.imports(_facts(spark, sf_dir, "imports"))


@query
def type_hints(spark, sf_dir):
    return views.type_hints(_facts(spark, sf_dir, "scopes"))


@query
def type_hint_map(spark, sf_dir):
    hints = views.type_hint_map(_facts(spark, sf_dir, "scopes"))
    return hints.select(*FILE, "scope", text.format_dict("type_hints").alias("type_hints"))


@query
def node_source(spark, sf_dir):
    rows = views.entities(_facts(spark, sf_dir, "entities", with_source=True), with_source=True)
    return rows.select(*FILE, "qualname", F.md5("raw_code").alias("code_md5"))


# --- sets, unions, rollups ------------------------------------------------------------

@query
def latest_definitions(spark, sf_dir):
    facts = _facts(spark, sf_dir, "entities")
    return views.entities(facts).select(*FILE, "entity_type", "owner_class", "name", "ordinal")


@query
def relationship_sets(spark, sf_dir):
    sets = views.relationship_sets(_facts(spark, sf_dir, "scopes"))
    return sets.select(*FILE, "scope", "defined_in", *[_joined(kind) for kind in FACT_KINDS])


@query
def relationship_sets_from_rows(spark, sf_dir):
    """The same sets, from the long form."""
    sets = rollups.relationship_sets_from_rows(views.fact_rows(_facts(spark, sf_dir, "scopes")))
    return sets.select(*FILE, "scope", *[_joined(kind) for kind in FACT_KINDS])


@query
def merge_relationships(spark, sf_dir):
    """Left: targets of even length; right: all calls and targets of odd length. Merged,
    they are the whole again."""
    sets = materialize(views.relationship_sets(_facts(spark, sf_dir, "scopes")), "relationship-sets")

    def half(parity: int, whole: tuple[str, ...] = ()) -> DataFrame:
        kept = {k: F.filter(k, lambda t: F.length(t) % 2 == parity) for k in FACT_KINDS if k not in whole}
        return sets.withColumns(kept)

    merged = rollups.merge_relationships(half(0), half(1, ("calls",)))
    return merged.select(*FILE, "scope", "defined_in", *[_joined(kind) for kind in FACT_KINDS],
                         text.format_pairs("type_hints", "param", "annotation").alias("type_hints"))


@query
def entity_relationships(spark, sf_dir):
    rows = views.entity_relationships(_facts(spark, sf_dir, "entities", "scopes"))
    return rows.select(*FILE, "entity_type", "qualname", "defined_in", *[_joined(kind) for kind in FACT_KINDS])


@query
def latest_definitions_from_rows(spark, sf_dir):
    """The same definitions, told from a flat table of all of them."""
    rows = views.entities(_facts(spark, sf_dir, "entities"), latest_only=False)
    return rollups.latest_from_rows(rows).select(*FILE, "entity_type", "owner_class", "name", "ordinal")


@query
def entity_relationships_from_rows(spark, sf_dir):
    """Entities and relationship records as two flat tables, joined by scope."""
    facts = materialize(_facts(spark, sf_dir, "entities", "scopes"), "facts")
    rows = rollups.entity_relationships_from_rows(views.entities(facts), views.relationship_sets(facts))
    return rows.select(*FILE, "entity_type", "qualname", "defined_in", *[_joined(kind) for kind in FACT_KINDS])


def _edges(spark, sf_dir):
    rows = materialize(views.imports(_facts(spark, sf_dir, "imports")), "imports")
    return rollups.dependency_graph(rows, inputs.source_files(spark, sf_dir))


@query
def dependency_graph(spark, sf_dir):
    return _edges(spark, sf_dir)


@query
def dependency_sets(spark, sf_dir):
    return rollups.dependency_sets(_edges(spark, sf_dir), inputs.source_files(spark, sf_dir)).select(
        *FILE, _joined("dependencies"))


@query
def module_statistics(spark, sf_dir):
    return rollups.module_statistics(_counted(spark, sf_dir))


@query
def run_summary(spark, sf_dir):
    return rollups.run_summary(_counted(spark, sf_dir))


@query
def all_functions(spark, sf_dir):
    return views.all_functions(_facts(spark, sf_dir, "entities")).select(*FILE, "entity_type", "owner_class", "name")


@query
def all_classes(spark, sf_dir):
    return views.classes(_facts(spark, sf_dir, "entities")).select(*FILE, "name")


@query
def file_tree(spark, sf_dir):
    return tree.file_tree(inputs.source_files(spark, sf_dir))


# --- prompts --------------------------------------------------------------------------

def _context(spark, sf_dir, *records, mode="intended"):
    files = prompts.with_tree_excerpts(
        inputs.source_files(spark, sf_dir), mode=mode, partitions=inputs.tasks(spark))
    facts = extract.extract_facts(files, records=records or extract.RECORDS, mode=mode, carry=["tree_excerpt"])
    return prompts.prompt_context(facts, mode=mode)


@query
def prompt_context(spark, sf_dir):
    return _context(spark, sf_dir, "node_map").select(*FILE, "overview", "tree_excerpt")


@query
def tree_excerpts_first_match(spark, sf_dir):
    return tree.tree_excerpts(inputs.source_files(spark, sf_dir), anchor="first_match")


@query
def render_prompts(spark, sf_dir):
    return prompts.render_prompts(_context(spark, sf_dir)).select(*prompts.PROMPT_KEY, "prompt_hash").drop("owner_qualname")


@query
def render_prompts_reference(spark, sf_dir):
    rows = prompts.render_prompts(_context(spark, sf_dir, mode="reference"), mode="reference")
    return rows.select(*prompts.PROMPT_KEY, "prompt_hash").drop("owner_qualname")


@query
def has_prompt(spark, sf_dir):
    """Documents of one language have no prompt here; the others do."""
    blank = F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("text"))
    rows = inputs.table(spark, sf_dir, "documents").select("doc_id", blank.alias("prompt"))
    return prompts.has_prompt(rows).select("doc_id")


@query
def summary_prompt(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "documents")
    return rows.select("doc_id", prompts.summary_prompt("lang").alias("intended"),
                       prompts.summary_prompt("lang", "reference").alias("reference"))


@query
def message_array(spark, sf_dir):
    rows = inputs.prompts(spark, sf_dir)
    turns = prompts.two_stage_turns("prompt", text.short_hash("prompt"), F.lit("Sum up."))
    return rows.select("entity_id", F.posexplode(turns).alias("position", "m")).select(
        "entity_id", "position", "m.role", F.md5("m.content").alias("content_md5"))


@query
def conversation_key(spark, sf_dir):
    conversations = prompts.conversations(inputs.messages(spark, sf_dir))
    return conversations.select("conv_id", text.query_hash(text.conversation_text("messages")).alias("query_hash"))


# --- cache ----------------------------------------------------------------------------

@query
def cache_scan(spark, sf_dir):
    """The log is written to storage and read back."""
    path = new_table_path(spark, "cache")
    cache_table.append_cache_log(inputs.cache_log(spark, sf_dir), path)
    return cache_table.cache_scan(cache_table.read_cache_log(spark, path))


@query
def cache_decode(spark, sf_dir):
    rows = inputs.cache_log(spark, sf_dir)
    return cache_table.cache_scan(rows).select("query_hash", "prompt", "response", F.get_json_object("metadata", "$.k").alias("k"))


@query
def cache_metadata(spark, sf_dir):
    """Metadata to a map, to text and back."""
    rows = inputs.table(spark, sf_dir, "events").select("event_id", cache_table.metadata_value("props").alias("m"))
    texts = cache_table.metadata_map(F.to_json("m"))
    stored = rows.select("event_id", cache_table.metadata_json("m").alias("stored"),
                         cache_table.metadata_json(F.map_filter(texts, lambda k, v: F.lit(False))).alias("emptied"))
    return stored.select("event_id", "stored", "emptied",
                         F.variant_get(cache_table.metadata_value("stored"), "$.k", "string").alias("k"))


@query
def cache_put(spark, sf_dir):
    return inputs.cache_log(spark, sf_dir)


@query
def cache_current(spark, sf_dir):
    return cache.cache_current(inputs.cache_log(spark, sf_dir))


@query
def cache_lookup(spark, sf_dir):
    current = cache.cache_current(inputs.cache_log(spark, sf_dir))
    return cache.cache_lookup(inputs.cache_requests(spark, sf_dir), current, ["event_id"])


@query
def cache_misses(spark, sf_dir):
    current = cache.cache_current(inputs.cache_log(spark, sf_dir))
    return cache.cache_misses(inputs.cache_requests(spark, sf_dir), current, ["event_id"]).select("query_hash", "prompt")


def _stored_log(spark, sf_dir) -> tuple[DataFrame, int]:
    path = new_table_path(spark, "cache")
    cache_table.append_cache_log(inputs.cache_log(spark, sf_dir), path)
    return cache_table.read_cache_log(spark, path), cache_table.bucket_count(spark, path)


@query
def cache_lookup_stored(spark, sf_dir):
    """The same requests against the log on storage, which is not moved."""
    log, buckets = _stored_log(spark, sf_dir)
    requests = inputs.cache_requests(spark, sf_dir)
    return cache.cache_lookup(requests, cache.cache_entries(log, requests, buckets), ["event_id"])


@query
def cache_misses_stored(spark, sf_dir):
    log, buckets = _stored_log(spark, sf_dir)
    requests = inputs.cache_requests(spark, sf_dir)
    return cache.cache_misses(requests, cache.cache_entries(log, requests, buckets), ["event_id"]).select("query_hash", "prompt")


@query
def cache_stats(spark, sf_dir):
    return cache.cache_stats(cache.cache_current(inputs.cache_log(spark, sf_dir)))


def _deleted_at() -> Column:
    return F.lit("2100-01-01 00:00:00").cast("timestamp_ntz")


@query
def cache_invalidate(spark, sf_dir):
    """What is left after the prompts of one kind of event were invalidated."""
    log = inputs.cache_log(spark, sf_dir)
    clicks = inputs.table(spark, sf_dir, "events").where(F.col("event_type") == "click").select(
        F.concat("event_type", F.lit(":"), "user_id").alias("prompt"))
    removed = cache.cache_invalidate(cache.cache_current(log), clicks, _deleted_at())
    return cache.cache_current(log.unionByName(removed)).select("query_hash", "ts")


@query
def cache_clear_all(spark, sf_dir):
    """One row clears everything; the entries before and after are counted."""
    log = inputs.cache_log(spark, sf_dir)
    cleared = cache.cache_current(log.unionByName(cache.cache_clear_range(log, ts=_deleted_at())))
    both = cache.cache_current(log).select(F.lit(1).alias("before")).unionByName(cleared.select(F.lit(0).alias("before")))
    before, after = (F.count_if(F.col("before") == x) for x in (1, 0))
    return both.agg((before - after).alias("n_removed"), after.alias("n_left"))


@query
def cache_clear_older(spark, sf_dir):
    """One row clears what was written before the cutoff."""
    log = inputs.cache_log(spark, sf_dir)
    cutoff = F.lit("2024-01-28 00:00:00").cast("timestamp_ntz")
    return cache.cache_current(log.unionByName(cache.cache_clear_range(log, older_than=cutoff))).select("query_hash", "ts")


# --- inference ------------------------------------------------------------------------

@query
def batch_query(spark, sf_dir):
    path = new_table_path(spark, "cache")
    return inference.batch_query(
        inputs.prompts(spark, sf_dir), path, inputs.stub_model, id_columns=["entity_id"]).select("entity_id", "response")


@query
def batch_query_nocache(spark, sf_dir):
    return inference.batch_query(
        inputs.prompts(spark, sf_dir), "", inputs.stub_model, id_columns=["entity_id"], use_cache=False,
    ).select("entity_id", "response")


@query
def batch_query_multi_turn(spark, sf_dir):
    path = new_table_path(spark, "cache")
    conversations = prompts.conversations(inputs.messages(spark, sf_dir))
    return inference.batch_query(
        conversations, path, inputs.stub_model, id_columns=["conv_id"]).select("conv_id", "response")


@query
def two_stage_analysis(spark, sf_dir):
    path = new_table_path(spark, "cache")
    rows = inputs.prompts(spark, sf_dir).withColumn("entity_type", F.lit("function"))
    return inference.two_stage_analysis(
        rows, path, inputs.stub_model, id_columns=["entity_id"]).drop("entity_type")


@query
def export_interactions(spark, sf_dir):
    answered = inputs.prompts(spark, sf_dir).withColumn("response", text.short_hash("prompt"))
    path = new_table_path(spark, "interactions")
    report_files.export_interactions(answered, path)
    return spark.read.parquet(path).select("query_hash", F.md5("document").alias("document_md5"))


def _analysis(spark, sf_dir) -> corpus.CorpusAnalysis:
    return corpus.analyze_corpus(
        inputs.source_files(spark, sf_dir), new_table_path(spark, "cache"), inputs.stub_model,
        partitions=inputs.tasks(spark))


@query
def analyze_corpus(spark, sf_dir):
    return _analysis(spark, sf_dir).analyses.drop("owner_qualname")


@query
def attach_analyses(spark, sf_dir):
    """Every entity and its stub answer; answers exist for the functions only."""
    rows = views.entities(_facts(spark, sf_dir, "entities")).select(*FILE, "entity_type", "owner_class", "owner_qualname", "name")
    stored = materialize(rows, "entities")
    answer = text.short_hash(F.concat_ws("/", *FILE, "name"))
    answers = stored.where(F.col("entity_type") == "function").select(
        *stored.columns, answer.alias("initial_analysis"), F.lit("short").alias("summary"))
    return inference.attach_analyses(stored, answers).drop("owner_qualname")


# --- reports --------------------------------------------------------------------------

@query
def compact_report(spark, sf_dir):
    facts = _facts(spark, sf_dir, "entities", "scopes", with_source=True)
    return report.compact_functions(report.report_entities(facts))


@query
def save_report(spark, sf_dir):
    """Whole reports, written as JSON lines (compressed: they hold each text several times) and read back."""
    facts = _facts(spark, sf_dir, "entities", "scopes", "imports", with_source=True)
    path = new_table_path(spark, "report")
    report_files.save_reports(report.file_reports(facts), path, compression="gzip")
    line = spark.read.text(path)
    at = lambda p: F.get_json_object("value", p)
    return line.select(
        at("$.repo_id").alias("repo_id"), at("$.rel_path").alias("rel_path"),
        F.md5(at("$.report.raw_code")).alias("code_md5"),
        F.array_join(F.array_sort(F.json_object_keys(at("$.report"))), "|").alias("keys"),
        F.array_join(F.array_sort(F.json_object_keys(at("$.report.functions"))), "|").alias("functions"),
        F.array_join(F.array_sort(F.json_object_keys(at("$.report.classes"))), "|").alias("classes"),
        at("$.report.imports.direct").alias("direct_imports"),
    )


@query
def answered_reports(spark, sf_dir):
    """Reports with stub answers for modules and functions, which come to their files in one join."""
    facts = materialize(_facts(spark, sf_dir, "entities", "scopes", "imports", with_source=True), "facts")
    none = F.lit(None).cast("string")
    modules = facts.select(*FILE, F.lit("module").alias("entity_type"), none.alias("owner_qualname"), text.file_name("rel_path").alias("name"))
    entity_rows = views.entities(facts).select(*FILE, "entity_type", "owner_qualname", "name")
    asked = modules.unionByName(entity_rows).withColumn("prompt", F.concat_ws("/", *FILE, "name"))
    said = asked.where(F.col("entity_type").isin("module", "function")).drop("prompt").withColumns(
        {"initial_analysis": text.short_hash(F.concat_ws("/", *FILE, "name")), "summary": F.lit("short")})
    reports = report.file_reports(facts, report.nested_answers(asked, said))
    at = lambda p: F.get_json_object("report", p)
    return reports.select(
        *FILE, at("$.prompt").alias("prompt"), at("$.llm_analysis.initial_analysis").alias("module_analysis"),
        at("$.functions.step_1.prompt").alias("step_prompt"), at("$.functions.step_1.llm_analysis.initial_analysis").alias("step_analysis"),
        at("$.functions.step_1.llm_analysis.summary").alias("step_summary"),
        F.col("n_functions").cast("long").alias("n_functions"), F.col("n_classes").cast("long").alias("n_classes"))


# --- text functions -------------------------------------------------------------------

def _documents(spark, sf_dir, **columns: Column) -> DataFrame:
    return inputs.table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in columns.items()])


@query
def query_hash(spark, sf_dir):
    return _documents(spark, sf_dir, query_hash=text.query_hash("text"))


@query
def short_hash(spark, sf_dir):
    return _documents(spark, sf_dir, short_hash=text.short_hash("text"))


@query
def encode_base64(spark, sf_dir):
    return _documents(spark, sf_dir, encoded=text.encode_base64("text"))


@query
def decode_base64(spark, sf_dir):
    return _documents(spark, sf_dir, decoded=text.decode_base64(text.encode_base64("text")),
                      damaged=text.decode_base64(F.concat(F.lit("A"), text.encode_base64("text"))).isNull())


@query
def truncate_middle(spark, sf_dir):
    return _documents(spark, sf_dir, intended=text.truncate_middle("text", 1000),
                      reference=text.truncate_middle("text", 1000, "reference"))


@query
def truncate_around(spark, sf_dir):
    target = F.substring("text", F.floor(F.length("text") / 2).cast("int") + 1, F.lit(20))
    rows = inputs.table(spark, sf_dir, "documents").select("doc_id", "text", target.alias("target"))
    rows = excerpt.truncate_around(rows, "shortened", "text", "target", 600)
    rows = excerpt.truncate_around(rows, "uncleaned", "text", "target", 600, clean_cut_edges=False)
    return rows.select("doc_id", "shortened", "uncleaned")


@query
def line_count(spark, sf_dir):
    return _documents(spark, sf_dir, n_lines=text.line_count("text"))


@query
def format_list(spark, sf_dir):
    sets = views.relationship_sets(_facts(spark, sf_dir, "scopes"))
    return sets.select(*FILE, "scope", text.format_list("calls").alias("calls"), text.format_list("reads_from").alias("reads"))


@query
def format_dict(spark, sf_dir):
    hints = views.relationship_sets(_facts(spark, sf_dir, "scopes"))
    return hints.select(*FILE, "scope", text.format_dict(F.map_from_entries("type_hints")).alias("type_hints"))


@query
def format_timestamp(spark, sf_dir):
    return inputs.table(spark, sf_dir, "events").select(
        "event_id", text.format_timestamp("ts").alias("short"), text.format_timestamp("ts", True).alias("long"))


@query
def iso_timestamp(spark, sf_dir):
    """As stored, and cut to whole seconds; both read back."""
    rows = inputs.table(spark, sf_dir, "events").select(
        "event_id", "ts", text.iso_timestamp("ts").alias("iso"),
        text.iso_timestamp(F.date_trunc("second", "ts").cast("timestamp_ntz")).alias("iso_whole"))
    return rows.select("event_id", "iso", "iso_whole", (text.parse_iso_timestamp("iso") == F.col("ts")).alias("same"))


@query
def artifact_name(spark, sf_dir):
    return inputs.table(spark, sf_dir, "events").select(
        "event_id", text.log_name("ts", F.lit("query"), "props").alias("log_name"),
        text.interaction_name("ts").alias("interaction_name"))


@query
def parent_scope(spark, sf_dir):
    sets = views.relationship_sets(_facts(spark, sf_dir, "scopes"))
    return sets.select(*FILE, "scope", text.parent_scope("scope").alias("parent"))


@query
def qualified_name(spark, sf_dir):
    rows = views.scopes(_facts(spark, sf_dir, "scopes"))
    name = F.substring_index("scope", ".", -1)
    return rows.select(*FILE, "scope", text.qualified_name("defined_in", name).alias("qualified"))


@query
def import_to_path(spark, sf_dir):
    rows = views.imports(_facts(spark, sf_dir, "imports"))
    return rows.select(*FILE, "ordinal", text.import_to_path("target").alias("path"))
