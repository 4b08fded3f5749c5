"""Weighted rendezvous sharding with column functions.

Every shard scores every record from a hash of the record's stable key and the shard's own
number, ``-weight / ln(u)``, and the highest score wins. Nothing but the key and the shards
decides, so the assignment needs no shuffle and no state; one more shard wins only the records
it scores highest itself, and no other record moves.

Defined results: records with equal keys share a shard, null keys too (they hash alike);
equal scores go to the smaller shard; an empty table gives no rows; columns of the input that
carry a result's name are replaced, all others stay.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from sourcequarry.llm.common import fresh
from sourcequarry.runtime import materialize


def _best(key: list[str], weights: list[float]) -> Column:
    """(score, -shard) of the winning shard."""
    heavy = F.array(*[F.lit(float(w)) for w in weights])

    def scored(shard: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(*key, shard), 11)
        u = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((-F.get(heavy, shard) / F.ln(u)).alias("score"), (-shard).alias("minus"))

    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), scored))


def shard_of(key: list[str], weights: list[float]) -> Column:
    """The shard, from 0, of the record with this key. ``weights``: one for each shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above zero")
    return (-_best(key, weights)["minus"]).cast("int")


def assign_shards(
    records: DataFrame, key: list[str], weights: list[float], grown_by: list[float] = (),
) -> DataFrame:
    """``records`` with ``shard``, and with ``grown_shard`` if weights of further shards are given."""
    out = records.withColumn("shard", shard_of(key, list(weights)))
    if grown_by:
        out = out.withColumn("grown_shard", shard_of(key, [*weights, *grown_by]))
    return out


def number_slots(assigned: DataFrame, label: str = "sharded") -> DataFrame:
    """``assigned`` with ``slot``: 0, 1, 2, … without a gap within each shard.

    The rows are stored once with the part they were written by; a part counts its own rows
    of each shard, the counts of the earlier parts are its offset, and rows are numbered
    within part and shard. No task ever holds a whole shard, and a hot key is no hot task.
    """
    row, part, offset = fresh(assigned, "row", "part", "offset")
    stored = materialize(assigned.drop("slot").withColumn(row, F.monotonically_increasing_id()), label)
    stored = stored.withColumn(part, F.shiftright(row, 33))
    counts = stored.groupBy("shard", part).agg(F.count(F.lit(1)).alias(offset))
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", part, F.coalesce(F.sum(offset).over(before), F.lit(0)).alias(offset))
    within = Window.partitionBy(part, "shard").orderBy(row)
    numbered = stored.withColumn("slot", F.row_number().over(within).cast("long") - 1)
    return numbered.join(offsets, [part, "shard"]).withColumn("slot", F.col("slot") + F.col(offset)).drop(row, part, offset)


def write_shards(numbered: DataFrame, path: str) -> None:
    """One folder for each shard, in which files hold runs of slots in order."""
    numbered.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
