"""Joins that stay balanced when one key holds a large share of the rows."""

from pyspark.sql import DataFrame, functions as F

ROWS_PER_TASK = 1_000_000
#: Keys that are split at most: the list goes to every task. A key beyond them holds less than
#: one in so many of the rows.
MAX_HOT_KEYS = 10_000


def join_to_unique(
    many: DataFrame,
    unique: DataFrame,
    on: list[str],
    how: str,
    spread_by: list[str],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join ``many`` rows (any number per key) to at most one ``unique`` row per key.

    Keys with more than ``rows_per_task`` rows are counted (partial sums, key columns
    only); the ``MAX_HOT_KEYS`` largest are split, so the list that is broadcast has a fixed
    bound. Their rows are spread over enough buckets, by a hash of ``spread_by``
    so that a repeated task spreads them the same way; the one row on the other side is
    copied to each bucket. All other keys use bucket 0.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    hot = (
        many.groupBy(*on).agg(F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_rows") > rows_per_task).orderBy(F.desc("n_rows"), *on).limit(MAX_HOT_KEYS)
        .select(*on, F.ceil(F.col("n_rows") / rows_per_task).cast("int").alias("n_buckets"))
    )
    bucket = F.when(F.col("n_buckets").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*spread_by), "n_buckets"))
    buckets = F.sequence(F.lit(0), F.coalesce(F.col("n_buckets") - 1, F.lit(0)))
    spread = many.join(F.broadcast(hot), on, "left").withColumn("bucket", bucket.cast("int")).drop("n_buckets")
    copied = unique.join(F.broadcast(hot), on, "left").withColumn("bucket", F.explode(buckets)).drop("n_buckets")
    return spread.join(copied, [*on, "bucket"], how).drop("bucket")
