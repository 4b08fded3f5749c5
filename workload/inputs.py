"""Inputs derived from the given tables with column expressions only: no row is joined or
grouped, and every value is bounded by one input row. See FIXTURES.md for the shapes."""

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sourcequarry.operators import cache
from sourcequarry.runtime import new_table_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Even work for every core, however few files or row groups the table has. Only the
    narrow input columns move; what is built from them is built afterwards."""
    return rows.repartition(tasks(rows.sparkSession), key)


def tasks(spark: SparkSession) -> int:
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _module_path(key: Column, separator: str) -> Column:
    return _text("d", F.floor(key / 100).cast("long"), separator, "o", key)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


def source_files(spark: SparkSession, sf_dir: str, broken: bool = False, orders: DataFrame | None = None) -> DataFrame:
    """One Python module per order (of ``orders``, where given). ``broken`` adds a last line that
    does not parse to every 97th."""
    k, c, s, p = (F.col(n) for n in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
    decorator = F.element_at(
        F.array(*[F.lit(x) for x in ("staticmethod", "classmethod", "property", "helper")]), (k % 4 + 1).cast("int"))

    def step(i: Column) -> Column:
        return F.concat_ws(
            "\n",
            _text("def step_", (i * c) % 3, "(qty: float) -> int:"),
            F.lit("    if qty < 0:"),
            _text("        raise Err", i, "(qty)"),
            F.lit("    try:"),
            _text("        out = part_", (k * i) % 1000, "(qty)"),
            _text("    except Late", s, ":"),
            _text("        out = supp_", i),
            F.lit("    return out"),
        )

    steps = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), k % 4 + 1), step), "\n")
    lines = [
        _text('"""order ', k, '"""'),
        F.lit("import os"),
        _text("import ", _module_path(k + 1, "."), ", ", _module_path(k + 7, ".")),
        _text("from lib_", s, " import helper"),
        _text("from d", F.floor((k + 2) / 100).cast("long"), " import o", k + 2),
        _text("class Order", k, "(Base", s, "):"),
        _text('    """', p, '"""'),
        F.lit("    def total(self):"),
        F.lit("        return helper(self)"),
        _text("    @", decorator),
        F.lit("    def rank(self, n=1, *rest):"),
        F.lit("        return n"),
        steps,
    ]
    if broken:
        lines.append(F.when(k % 97 == 0, F.lit("def (")))
    return spread(_orders(spark, sf_dir) if orders is None else orders, "o_orderkey").select(
        _text("r", c % 25).alias("repo_id"),
        _text(_module_path(k, "/"), ".py").alias("rel_path"),
        F.concat_ws("\n", *lines, F.lit("")).alias("content"),
    )


#: Files that lie in a folder together, about: each takes a block of its store, however short it is.
FILES_AT_ONCE = 100_000


def source_folders(spark: SparkSession, sf_dir: str) -> Iterator[str]:
    """The same modules as files, a folder for each repository, in roots of about ``FILES_AT_ONCE``
    files. A root lasts until the next is asked for. Files of one folder lie below one root."""
    orders = _orders(spark, sf_dir)
    n_parts = -(-orders.count() // FILES_AT_ONCE)
    if n_parts > 1:
        path = new_table_path(spark, "folder-orders")
        part = F.pmod(F.xxhash64(F.floor(F.col("o_orderkey") / 100)), F.lit(n_parts)).alias("part")
        orders.select("*", part).repartition(n_parts, "part").write.partitionBy("part").parquet(path)
        stored = spark.read.schema(orders.select("*", part).schema).parquet(path)
        parts = (stored.where(F.col("part") == i).drop("part") for i in range(n_parts))
    else:
        parts = iter([orders])
    for rows in parts:
        root = new_table_path(spark, "source-folder")
        if source_folder(spark, sf_dir, root, rows) == 0 and n_parts > 1:
            continue
        try:
            yield root
        finally:
            delete_folder(spark, root)


def source_folder(spark: SparkSession, sf_dir: str, root: str, orders: DataFrame | None = None) -> int:
    """The same modules (of ``orders``, where given) as files below ``root``, a folder for each
    repository; how many there are."""
    def write(batches):
        import pyarrow as pa
        import pyarrow.fs

        store, base = pyarrow.fs.FileSystem.from_uri(root)
        made, n = set(), 0
        for batch in batches:
            for repo, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder = f"{base}/{repo}/{path}".rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{base}/{repo}/{path}", compression=None) as file:
                    file.write(content.encode())
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    files = source_files(spark, sf_dir, orders=orders)
    return files.mapInArrow(write, "n long").agg(F.sum("n")).collect()[0][0] or 0


def delete_folder(spark: SparkSession, root: str) -> None:
    """Delete what lies below ``root``, a task for each folder, and ``root``."""
    def drop(batches):
        import pyarrow.fs

        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                store, base = pyarrow.fs.FileSystem.from_uri(uri)
                store.delete_dir(base)
            yield batch

    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in store.listStatus(where) if s.isDirectory()]
    if names:
        rows = spark.createDataFrame([(i, f"{root}/{name}") for i, name in enumerate(names)], "i int, uri string")
        rows.repartitionById(len(names), "i").mapInArrow(drop, "i int, uri string").count()
    store.delete(where, True)


def cache_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cache write per event: few prompts, written again and again."""
    events = table(spark, sf_dir, "events").select(
        F.concat("event_type", F.lit(":"), "user_id").alias("prompt"),
        F.col("event_id").cast("string").alias("response"),
        "ts", F.col("props").alias("metadata"), F.col("event_id").alias("seq"))
    return cache.cache_put(events)


def cache_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per event; about half of the prompts were never stored."""
    prompt = F.concat("event_type", F.lit(":"), (F.col("user_id") + 75).cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id", prompt.alias("prompt"), F.sha2(prompt, 256).alias("query_hash"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), F.col("text").alias("prompt"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def stub_model(batches):
    """Stands in for a language model: the answer is a hash of the last message."""
    import hashlib

    import pandas as pd

    for conversations in batches:
        yield pd.Series([
            "A:" + hashlib.sha256(turns[-1]["content"].encode()).hexdigest()[:16] for turns in conversations])
