"""Reading files, joins across files, and the shape of plans."""

import gc
import hashlib
import sys
import time

import pyarrow as pa
import pytest
from pyspark.sql import datasource, functions as F, types as T

import __spark_entry__ as entry
from sourcequarry.functions.compact import compact
from sourcequarry.operators import extract, prompts, report, rollups, skew, views
from sourcequarry.runtime import materialize, work_dir
from sourcequarry.sources import files as file_source, folder
from workload import inputs, queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_work_dir_is_the_session_s(spark):
    assert work_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_scanning_a_folder(spark, tmp_path):
    for path, content in {"r1/a.py": b"x = 1\r\ny = 2\r", "r1/d/b.py": "é\n".encode(), "r2/bad.py": b"\xff", "r2/c.txt": b"text", "r2/empty.py": b"", "r1/_d/b.py": b"1", "r1/.h.py": b"2", "r1/s p%20.py": b"3"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    for root in (str(tmp_path), f"file://{tmp_path}", f"file://{tmp_path}/"):
        got = {(r.repo_id, r.rel_path): r.content for r in file_source.scan_source_files(spark, root).collect()}
        assert got == {
            ("r1", "a.py"): "x = 1\ny = 2\n", ("r1", "d/b.py"): "é\n", ("r2", "bad.py"): None, ("r2", "empty.py"): "",
            ("r1", "_d/b.py"): "1", ("r1", ".h.py"): "2", ("r1", "s p%20.py"): "3"}
    listed = file_source.list_files(spark, str(tmp_path), repo_id="all")
    assert {tuple(r) for r in listed.collect()} == {("all", p) for p in (
        "r1/a.py", "r1/d/b.py", "r2/bad.py", "r2/c.txt", "r2/empty.py", "r1/_d/b.py", "r1/.h.py", "r1/s p%20.py")}
    assert "content" not in plan(listed).split("ReadSchema")[-1]


@pytest.fixture
def many_files(tmp_path):
    for i in range(300):
        path = tmp_path / "root" / f"r{i % 3}" / f"d{i % 20}" / f"{'.' * (i % 7 == 0)}f{i}{('.py', '.txt')[i % 5 == 0]}"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x" * (i * 40))
    return str(tmp_path / "root")


def test_folder_tasks_hold_about_equal_bytes(spark, many_files):
    rows = folder.read_folder(spark, many_files, suffix=".py", part_bytes=1 << 20)
    sizes = {r.p: r.s for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.length("content") + folder.OPENING).alias("s")).collect()}
    assert len(sizes) > 4 and max(sizes.values()) <= 1 << 20 and sorted(sizes.values())[1] > (1 << 20) * 0.9
    assert rows.count() == 240 and folder.read_folder(spark, many_files).rdd.getNumPartitions() == 1


@pytest.mark.parametrize("list_limit", [1, 30, 1_000_000])
def test_folders_beyond_the_limit_are_walked_by_tasks(spark, many_files, list_limit):
    rows = folder.read_folder(spark, many_files, list_limit=list_limit)
    assert rows.count() == rows.distinct().count() == 300
    listed = folder.read_folder(spark, many_files, content=False, list_limit=list_limit)
    assert {tuple(r) for r in listed.collect()} == {(r.repo_id, r.rel_path) for r in rows.collect()}


def test_listing_opens_no_file(spark, many_files, monkeypatch):
    reader = folder.FolderReader(["repo_id", "rel_path"], {"path": many_files})
    monkeypatch.setattr(folder, "_text", None)  # would fail
    assert sum(b.num_rows for part in reader.partitions() for b in reader.read(part)) == 300
    assert spark.read.format(folder.FORMAT).schema("rel_path string").load(many_files).columns == ["rel_path"]


def test_name_filters_reach_the_listing(spark, many_files):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:
        rows = file_source.list_files(spark, many_files).where("repo_id IN ('r1', 'r2') AND rel_path LIKE '%3.py' AND rel_path NOT LIKE 'd1/%'")
        found = {(r.repo_id, r.rel_path) for r in rows.collect()}
        shown = plan(rows)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert found == {(r.repo_id, r.rel_path) for r in file_source.list_files(spark, many_files).collect()
                     if r.repo_id != "r0" and r.rel_path.endswith("3.py") and not r.rel_path.startswith("d1/")}
    assert found and "IN (r1,r2)" not in shown.split("BatchScan")[0]
    reader = folder.FilteringReader(["repo_id", "rel_path"], {"path": many_files})
    odd = datasource.GreaterThan(("rel_path",), "d3")
    assert list(reader.pushFilters([datasource.EqualTo(("repo_id",), "r1"), odd, datasource.StringEndsWith(("rel_path",), ".txt")])) == [odd]
    assert sum(len(p.files) for p in reader.partitions()) == 20


def test_an_empty_folder_has_no_files(spark, tmp_path):
    assert file_source.scan_source_files(spark, str(tmp_path)).count() == 0


def test_tables_are_read_with_universal_newlines(spark, tmp_path):
    spark.createDataFrame([("r", "a.py", "x\r\ny\rz\n"), ("r", "b.py", None)], "repo_id string, rel_path string, content string").write.parquet(
        f"{tmp_path}/t")
    assert {r.rel_path: r.content for r in file_source.read_source_table(spark, f"{tmp_path}/t").collect()} == {"a.py": "x\ny\nz\n", "b.py": None}


def test_huge_files_of_one_folder_are_dealt_evenly(spark):
    """A tenth of the files hold nearly all bytes, and lie together."""
    size = F.when(F.col("id") < 40, 200_000).otherwise(50)
    files = spark.range(400).select(F.lit("r").alias("repo_id"), F.concat(F.when(F.col("id") < 40, F.lit("huge/f")).otherwise(F.lit("d/f")), "id").alias("rel_path"),
                                    F.repeat(F.lit("x"), size).alias("content"))
    dealt = file_source.spread_by_bytes(files, 8)
    sizes = [r.s for r in dealt.groupBy(F.spark_partition_id()).agg(F.sum(F.length("content")).alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) <= 1.25 * sum(sizes) / 8
    assert dealt.columns == files.columns and dealt.count() == dealt.distinct().count() == 400
    assert file_source.spread_by_bytes(files.limit(0), 8).count() == 0
    facts = extract.extract_facts(dealt.union(spark.createDataFrame([("r", "n.py", None)], "repo_id string, rel_path string, content string")))
    assert facts.count() == 401


def test_slices_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(extract, "TEXT_AT_A_TIME", 100)
    batch = pa.record_batch({"raw_code": ["x" * n for n in (10, 95, 200, 5, 5, 90, 1)] + [None]})
    assert [part.column(0).to_pylist() for part in extract._slices(batch)] == [
        ["x" * 10], ["x" * 95], ["x" * 200], ["x" * 5, "x" * 5, "x" * 90], ["x", None]]
    assert list(extract._slices(batch.slice(0, 0))) == []


@pytest.mark.parametrize("mode", ["intended", "reference"])
def test_relational_forms_equal_the_nested_ones(files_of, mode):
    texts = {
        "a.py": "class C:\n    def f(self): ...\n    def old(self): ...\n\nclass C:\n    def f(self): ...\n    def f(self, x): ...\n    class D:\n        def g(self): ...\n"
                "    class D:\n        def g(self): ...\n        class E:\n            def h(self): ...\n",
        "b.py": "def f(): ...\ndef f():\n    def inner(): ...\n    class L:\n        def m(self): ...\n    return inner\nclass f: ...\nasync def co():\n    def f(): raise X\n",
        "c.py": "if a:\n    class K:\n        @p.q\n        def v(self): return self.w\nelse:\n    class K(m.Base):\n        def u(self): g()\n", "d.py": "", "e.py": "def ("}
    for include_async in (False, True):
        facts = extract.extract_facts(files_of(texts), mode=mode, include_async=include_async)
        every = views.entities(facts, latest_only=False)
        want = sorted(map(str, views.entities(facts).collect()))
        assert sorted(map(str, rollups.latest_from_rows(every).collect())) == want and every.count() > len(want)
    if mode == "intended":
        joined = rollups.entity_relationships_from_rows(views.entities(facts), views.relationship_sets(facts))
        assert sorted(map(str, joined.collect())) == sorted(map(str, views.entity_relationships(facts).collect()))


def test_eligible_files(spark):
    paths = ["a.py", "tests/x.py", "conftest.py", ".h.py", "x_test.py", "_p/q.py", "d/__init__.py", "test_x.py", "_x.py", "a.txt"]
    rows = spark.createDataFrame([("r", p) for p in paths], "repo_id string, rel_path string")
    assert [r.rel_path for r in file_source.eligible_files(rows).collect()] == paths[:6]


def test_bucketed_texts_stay_where_they_are(spark):
    files = file_source.write_bucketed(inputs.source_files(spark, SF), "bucketed_files", 4)
    try:
        joined = prompts.with_tree_excerpts(files)
        shown = plan(joined)
        scan = shown.index("bucketed_files")
        above = shown[:scan].splitlines()
        join_at = max(i for i, line in enumerate(above) if "Join" in line)
        assert not any("Exchange" in line for line in above[join_at:])
        assert joined.count() == files.count()
    finally:
        spark.sql("DROP TABLE bucketed_files")


def test_files_keep_their_tasks_when_they_meet_their_excerpts(spark):
    files = inputs.source_files(spark, SF)  # few, so that a plan may think of broadcasting them
    placed = prompts.with_tree_excerpts(files, partitions=6, targets=file_source.eligible_files(files))
    first_join = next(line for line in plan(placed).splitlines() if "Join" in line)
    assert "SortMergeJoin" in first_join
    assert placed.rdd.getNumPartitions() == 6 and placed.count() == files.count()


def test_who_asks_for_hashes_of_prompts_reads_no_text(spark, tmp_path):
    rows = spark.createDataFrame([(1, "p"), (2, ""), (3, None)], "id int, prompt string").withColumn("prompt_hash", F.sha2("prompt", 256))
    rows.write.parquet(str(tmp_path / "prompts"))
    stored = spark.read.parquet(str(tmp_path / "prompts"))
    kept = prompts.has_prompt(stored).select("id")
    assert [r.id for r in kept.collect()] == [r.id for r in prompts.has_prompt(stored.drop("prompt_hash")).collect()] == [1]
    assert "prompt:string" not in plan(kept).split("ReadSchema")[-1]


def test_questions_about_single_files_do_not_shuffle(spark, files_of):
    facts = extract.extract_facts(files_of({"m.py": "def f(): g()\n"}))
    for df in (views.entities(facts, with_source=True), views.fact_rows(facts), views.entity_relationships(facts),
               views.type_hint_map(facts), views.node_map_rows(facts)):
        assert "Exchange" not in plan(df)


def test_statistics_need_one_shuffle_of_partial_sums(spark, files_of):
    shown = plan(rollups.module_statistics(extract.extract_facts(files_of({"m.py": ""}))))
    assert shown.count("Exchange") == 1 and "partial_sum" in shown and "Join" not in shown


def test_unwanted_columns_are_not_read(spark):
    listed = inputs.source_files(spark, SF).select("repo_id")
    assert "o_orderstatus" not in plan(listed).split("ReadSchema")[-1]


def test_unknown_options_are_refused(files_of):
    files = files_of({"m.py": ""})
    for options in ({"mode": "x"}, {"on_error": "x"}, {"records": ["x"]}):
        with pytest.raises(ValueError):
            extract.extract_facts(files, **options)


def test_failing_files_can_end_the_job(files_of):
    with pytest.raises(Exception, match="SyntaxError"):
        extract.extract_facts(files_of({"m.py": "def ("}), on_error="fail").collect()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("rows_per_task", [7, 1_000_000])
def test_hot_keys_join_like_any_other(spark, how, rows_per_task):
    many = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("k"), F.col("id") % 40)).alias("key"))
    unique = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("none", 4)], "key string, value int")
    got = skew.join_to_unique(many, unique, ["key"], how, ["id"], rows_per_task)
    want = many.join(unique, ["key"], how)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_hot_keys_are_spread(spark):
    many = spark.range(1000).select("id", F.lit("hot").alias("key"))
    unique = spark.createDataFrame([("hot", 1)], "key string, value int")
    shown = skew.join_to_unique(many, unique, ["key"], "inner", ["id"], 10)
    assert shown.count() == 1000
    assert "bucket" in plan(shown)


def test_dependencies(spark, files_of):
    texts = {
        "a.py": "import b\nimport pkg.c\nimport os\n", "b.py": "from pkg.c import thing\nfrom . import a\n",
        "pkg/c.py": "from pkg import d\n", "pkg/d.py": "",
    }
    files = files_of(texts)
    rows = views.imports(extract.extract_facts(files, records=["imports"]))

    def edges(**options):
        return sorted((r.src_path, r.dst_path) for r in rollups.dependency_graph(rows, files, **options).collect())

    assert edges() == [("a.py", "b.py"), ("a.py", "pkg/c.py"), ("pkg/c.py", "pkg/d.py")]
    assert ("b.py", "pkg/c.py") in edges(resolve_parent=True)
    sets = rollups.dependency_sets(rollups.dependency_graph(rows, files), files)
    assert {r.rel_path: r.dependencies for r in sets.collect()} == {
        "a.py": ["b.py", "pkg/c.py"], "b.py": [], "pkg/c.py": ["pkg/d.py"], "pkg/d.py": []}


def test_merged_records(spark, files_of):
    def sets(text):
        return views.relationship_sets(extract.extract_facts(files_of({"m.py": text})))

    left = sets("def f(a: int):\n    y = foo(x)\n")
    right = sets("def f(a: str, b: str):\n    bar(z)\ndef g():\n    pass\n")
    merged = {r.scope: r for r in rollups.merge_relationships(left, right).collect()}
    assert merged["f"].calls == ["bar", "foo"] and merged["f"].writes_to == ["y"]
    assert merged["f"].reads_from == ["bar", "foo", "int", "str", "x", "z"]
    assert [tuple(h) for h in merged["f"].type_hints] == [("a", "str"), ("b", "str")]
    assert merged["g"].defined_in == "<module>"


def test_function_flags_by_mode(spark):
    rows = spark.createDataFrame([(["staticmethod"],)], "decorators array<string>")
    for mode, expected in (("intended", True), ("reference", False)):
        assert rows.select(views.function_flags("decorators", mode)["is_static"]).first()[0] is expected


def test_reference_lines_break_at_form_feeds(spark, files_of):
    text = "x = 1 \x0c\ndef f():\n    pass\n"
    def source(mode):
        rows = views.entities(extract.extract_facts(files_of({"m.py": text})), with_source=True, mode=mode)
        return rows.first().raw_code

    assert source("intended") == "def f():\n    pass"
    assert source("reference") == "\n".join(text.splitlines()[1:3])


def test_node_map_limit(spark, files_of):
    facts = extract.extract_facts(files_of({"m.py": "import a\nimport b\nfrom c import d\ndef f(): pass\ndef g(): pass\nclass C: pass\n"}))
    shown = facts.select(*[views.node_map_text(views.limited_node_map("node_map", n)).alias(f"n{n}") for n in (1, 3, 9)]).first()
    assert shown.n1 == "{'Import': ['a']}"
    assert shown.n3 == "{'Import': ['a', 'b'], 'ImportFrom': ['d'], 'FunctionDef': ['f']}"
    assert shown.n9.endswith("'ClassDef': ['C']}")


def test_node_map_limit_is_looked_for_once_a_file(spark):
    """Looked for again at each node, ten thousand nodes take a minute."""
    node = lambda i: F.struct(
        F.when(i < 9_000, "Import").when(i < 9_500, "ImportFrom").when(i < 9_900, "FunctionDef").otherwise("ClassDef").alias("node_type"),
        i.alias("node_ordinal"), F.lit("n").alias("name"))
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(9_999)), node).alias("node_map"))
    rows = rows.unionByName(rows.select(F.lit(None).cast(rows.schema["node_map"].dataType).alias("node_map")))
    start = time.perf_counter()
    kept = rows.select(F.size(views.limited_node_map("node_map", 3)), F.size(views.limited_node_map("node_map", 5))).collect()
    assert [tuple(row) for row in kept] == [(9_501, 10_000), (None, None)]
    assert time.perf_counter() - start < 15


def test_reports_split_a_text_once(spark, files_of):
    """Split again for each function, a file of twelve thousand takes minutes."""
    n = 12_000
    facts = extract.extract_facts(files_of({"m.py": "".join(f"def f{i}():\n    return {i}\n" for i in range(n)), "none.py": None}))
    facts = materialize(facts, "facts")
    asked = facts.select(*views.FILE, F.lit("module").alias("entity_type"), F.lit(None).cast("string").alias("owner_qualname"),
                         F.col("rel_path").alias("name"), F.lit("?").alias("prompt"))
    said = asked.drop("prompt").withColumns({"initial_analysis": F.lit("!"), "summary": F.lit("s")})
    reports = report.file_reports(facts, report.nested_answers(asked, said))
    start = time.perf_counter()
    got = {r.rel_path: (r.n_functions, r.last, r.prompt) for r in reports.select(
        "rel_path", "n_functions", F.get_json_object("report", f"$.functions.f{n - 1}.raw_code").alias("last"),
        F.get_json_object("report", "$.prompt").alias("prompt")).collect()}
    assert got == {"m.py": (n, f"def f{n - 1}():\n    return {n - 1}", "?"), "none.py": (0, None, "?")}
    assert time.perf_counter() - start < 20


def test_nested_documents_are_made_once():
    whole = compact({"a": (F.upper("x"), T.StructType([])), "b": (F.lower("x"), T.StringType())})
    assert str(whole).count("upper") == 1


class Session:
    """As much of a session on a cluster as choosing a folder asks for."""

    def __init__(self, master, **conf):
        self.conf = self
        self.values, self.master, self.sparkContext = conf, master, self

    def getConf(self):
        return self

    def get(self, name, default=None):
        return self.values.get(name.replace(".", "_"), default)

    def getCheckpointDir(self):
        return None

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(Session("spark://host:7077", spark_sql_warehouse_dir="file:/home/me/spark-warehouse"))
    assert work_dir(Session("yarn", spark_sql_warehouse_dir="hdfs://n/w")) == "hdfs://n/w/_work"
    assert work_dir(Session("yarn", spark_checkpoint_dir="s3a://b/c", spark_sql_warehouse_dir="file:/w")) == "s3a://b/c"
    assert work_dir(Session("local[4]", spark_sql_warehouse_dir="file:/w")) == "file:/w/_work"


def test_a_folder_for_parts_of_the_files(spark, monkeypatch):
    from pathlib import Path

    from workload.queries import QUERIES

    expected = {(r.repo_id, r.rel_path): len(r.content) for r in inputs.source_files(spark, SF).collect()}
    monkeypatch.setattr(inputs, "FILES_AT_ONCE", 400)
    held, write = [], inputs.source_folder

    def counted(spark, sf_dir, root, orders):
        write(spark, sf_dir, root, orders)
        held.append(sum(1 for root in Path(work_dir(spark)).glob("source-folder-*") for _ in root.rglob("*.py")))
        return held[-1]

    monkeypatch.setattr(inputs, "source_folder", counted)
    before = set(Path(work_dir(spark)).glob("source-folder-*"))
    listed = QUERIES["list_folder"](spark, SF).collect()
    assert len(listed) == len(expected) and {tuple(r) for r in listed} == set(expected)
    assert len(held) > 2 and max(held) < len(expected) / 2
    scanned = QUERIES["scan_folder"](spark, SF).collect()
    assert {(r.repo_id, r.rel_path): r.n_chars for r in scanned} == expected and len(scanned) == len(expected)
    assert set(Path(work_dir(spark)).glob("source-folder-*")) == before


def test_a_worker_keeps_nothing_of_what_it_has_parsed(spark, files_of, monkeypatch):
    """Names that were parsed stay in their process; that must not be the worker's, which lives on."""
    files = files_of({"a.py": ""})
    monkeypatch.setattr(type(files), "mapInArrow", lambda rows, read, schema: read)
    read = extract.extract_facts(files, records=["entities"])
    batch = pa.record_batch([["r"] * 3000, [f"{i}.py" for i in range(3000)], [f"class Only{i}Here: pass" for i in range(3000)]],
                            names=["repo_id", "rel_path", "raw_code"])
    before = sys.getunicodeinternedsize()
    parts = list(read(iter([batch])))
    assert sum(p.num_rows for p in parts) == 3000 and sys.getunicodeinternedsize() - before < 1000
    assert [e[0]["name"] for p in parts for e in p.column("entities").to_pylist()] == [f"Only{i}Here" for i in range(3000)]


def test_an_error_of_the_reading_process_ends_the_job(spark, files_of):
    with pytest.raises(Exception, match="SyntaxError"):
        extract.extract_facts(files_of({"a.py": "def ("}), on_error="fail").collect()


def test_the_reading_process_does_not_look_through_what_the_worker_holds():
    def read(texts):
        yield pa.RecordBatch.from_arrays([pa.array([gc.isenabled()])], names=["collects"])

    found = list(extract._in_own_process(read, pa.RecordBatch.from_arrays([pa.array(["x = 1"])], names=["raw_code"])))
    assert [batch.to_pydict() for batch in found] == [{"collects": [False]}]
    assert gc.isenabled()


def test_classes_come_with_their_source(spark, files_of, tmp_path):
    text = "@seal\nclass A(B):\n    x = 1\n\n    class C:\n        pass\n\ny = 2\n"
    facts = extract.extract_facts(files_of({"a.py": text}), records=["entities"])
    got = {r.name: r.raw_code for r in views.classes(facts, with_source=True).collect()}
    assert got == {"A": "class A(B):\n    x = 1\n\n    class C:\n        pass", "C": "    class C:\n        pass"}

    orders = spark.createDataFrame([(7, 3, "O", "5-LOW"), (208, 12, "F", "1-URGENT")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    rows = entry.queries()["extract_classes"](spark, str(tmp_path)).collect()
    files = {r.rel_path: r.content.split("\n") for r in inputs.source_files(spark, str(tmp_path)).collect()}
    assert {r.rel_path: r.code_md5 for r in rows} == {
        path: hashlib.md5("\n".join(lines[5:12]).encode()).hexdigest() for path, lines in files.items()}


def test_stored_reports_take_less_disk_than_their_text(spark, tmp_path, monkeypatch):
    orders = [(k, k % 7, "O", "5-LOW") for k in range(300)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    paths = []
    monkeypatch.setattr(queries, "new_table_path", lambda spark, label: paths.append(str(tmp_path / label)) or paths[-1])
    assert entry.queries()["save_report"](spark, str(tmp_path)).count() == 300
    size = sum(p.stat().st_size for p in (tmp_path / "report").glob("part-*"))
    text = spark.read.text(paths[0]).agg(F.sum(F.length("value") + 1)).first()[0]
    assert paths == [str(tmp_path / "report")] and size < text / 2
