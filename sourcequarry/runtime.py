"""Where intermediate tables go, and how lineage is cut."""

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    ``spark.checkpoint.dir`` of the session names it. Where that is unset, a folder below
    the warehouse is used; on a cluster the warehouse must then be in a store that all
    machines share, and a local path is refused at once.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    folder = named or context.getCheckpointDir()
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        on_one_machine = context.master.startswith("local[") or context.master == "local"
        if not on_one_machine and (warehouse.startswith("file:") or "://" not in warehouse):
            raise ValueError(
                "set spark.checkpoint.dir to a folder that the driver and all executors share; "
                f"the warehouse {warehouse} is local to each machine")
        folder = f"{warehouse.rstrip('/')}/_work"
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def new_table_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: nothing upstream is computed again, and
    later readers still get column pruning and pushed filters."""
    spark = df.sparkSession
    path = new_table_path(spark, label)
    df.write.parquet(path)
    _remember(path)
    return spark.read.schema(df.schema).parquet(path)


_kept: list[list[str]] = []


def _remember(path: str) -> None:
    if _kept:
        _kept[-1].append(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Delete, at the end of the block, the tables that were stored inside it. Results that
    are read after the block must have been written elsewhere by then."""
    _kept.append([])
    try:
        yield
    finally:
        for path in _kept.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
