"""Runs registered queries and their SQL side by side."""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(df) -> pd.DataFrame:
    """Rows as a frame whose whole numbers stay whole beside nulls."""
    frame = df.toPandas()
    whole = [c for c, kind in df.dtypes if kind == "bigint" and frame[c].isna().any()]
    return frame.astype(dict.fromkeys(whole, "Int64"))


def normalized(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows in order, values as plain text."""
    frame = frame[sorted(frame.columns)]
    text = frame.map(lambda v: "<null>" if v is None or v is pd.NaT or v is pd.NA or v != v else str(v))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    a, b = normalized(spark_frame), normalized(sql_frame)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} != {list(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    kinds = {c: (spark_frame[c].dtype, sql_frame[c].dtype) for c in a.columns}
    other = {c: k for c, k in kinds.items() if k[0].kind != k[1].kind or k[0].kind in "iu" and k[0] != k[1]}
    if other and len(a):
        return f"types {other}"
    unequal = (a != b).any(axis=1)
    if unequal.any():
        at = unequal.idxmax()
        return f"{int(unequal.sum())} rows differ, first:\n  {a.loc[at].to_dict()}\n  {b.loc[at].to_dict()}"
    return None


def main(sf_dir: str, *names: str) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(sf_dir), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            ours = plain(run(spark, sf_dir))
            took = time.time() - start
            wrong = difference(ours, con.execute(sql[name]).df()) if name in sql else "no SQL"
        except Exception as problem:  # noqa: BLE001
            took, wrong, ours = time.time() - start, f"{type(problem).__name__}: {str(problem)[:700]}", []
        failed += wrong is not None
        print(f"{'ok  ' if wrong is None else 'FAIL'} {name:32s} {len(ours):8d} {took:6.1f}s {wrong or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
