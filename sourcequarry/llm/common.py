"""Small helpers of the operators."""

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sourcequarry.runtime import materialize

#: Words of ASCII letters and digits and of every character outside ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_shipped_to: list = []


def ship_package(spark) -> None:
    """Send this package to the executors once for each session, so that its functions run there
    whether or not it is installed on them."""
    context = spark.sparkContext
    if any(c is context for c in _shipped_to):
        return
    package = Path(__file__).resolve().parent.parent
    archive = f"{tempfile.mkdtemp()}/{package.name}.zip"  # read by the driver's own file server only
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    _shipped_to.append(context)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, _UPPER, _UPPER.lower())


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(lower_ascii(text), F.lit("")), SEPARATORS), lambda w: w != "")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, n_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about ``n_bytes``, so that what is made of them stays small."""
    rows = max(1, int(batch.num_rows * n_bytes / max(1, batch.nbytes)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def with_computed(
    df: DataFrame, source: str, name: str, kind: T.DataType, arrow_kind: pa.DataType,
    compute: Callable[[list], list], drop_source: bool = False,
) -> DataFrame:
    """``df`` with a column that Python computes from another one, a run of rows at a time."""
    kept = [c for c in df.columns if c.lower() != name.lower() and not (drop_source and c == source)]
    rows = df.select(*kept, F.col(source).alias(fresh(df, "source")[0]))
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values = pa.array(compute(part.column(len(kept)).to_pylist()), arrow_kind)
                yield pa.record_batch([*part.columns[:len(kept)], values], names=[*kept, name])

    return rows.mapInArrow(run, schema)


def running_sum(df: DataFrame, amount: str, out: str, order: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``out``, the sum of ``amount`` over a row and those before it in ``order``
    among the rows of equal ``by``.

    Rows are dealt in ranges of (by, order) and stored, so one key may fill many tasks; what
    crosses the ranges is one number for each key and range. ``by`` must not be null."""
    part, before = fresh(df, "range", "sum_before")
    ranged = materialize(df.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*by, part).agg(F.sum(amount).alias(before))
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, part, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    within = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (ranged.withColumn(out, F.sum(amount).over(within)).join(offsets, [*by, part])
            .withColumn(out, F.col(out) + F.col(before)).drop(part, before))
