"""Cache operators: entries and log rows in, log rows out.

The current state is the last row per hash, unless a later row clears it. Counting the rows of a
result says how many entries an operation stored, rejected or removed.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sourcequarry import schema
from sourcequarry.functions import text
from sourcequarry.operators.skew import join_to_unique


def _valid() -> Column:
    return (F.length("prompt") > 0) & F.col("response").isNotNull()


def cache_rejects(entries: DataFrame) -> DataFrame:
    """Entries that may not be stored, with the reason."""
    reason = F.when(~F.coalesce(F.length("prompt") > 0, F.lit(False)), F.lit("Prompt cannot be empty.")).when(
        F.col("response").isNull(), F.lit("Response cannot be None."))
    return entries.withColumn("reason", reason).where(F.col("reason").isNotNull())


def cache_put(entries: DataFrame, on_invalid: str = "fail") -> DataFrame:
    """Log rows that store ``prompt, response`` and, where given, ``metadata`` (JSON text),
    ``ts`` and ``seq`` (the rows' own order where it is not). An empty response is fine; an empty prompt or a missing response
    ends the job or, with ``on_invalid="skip"``, is left out (see ``cache_rejects``)."""
    if on_invalid == "skip":
        entries = entries.where(_valid())
    elif on_invalid == "fail":
        checked = F.when(F.length("prompt") > 0, F.col("prompt")).otherwise(
            F.raise_error(F.lit("Prompt cannot be empty.")).cast("string"))
        response = F.coalesce("response", F.raise_error(F.lit("Response cannot be None.")).cast("string"))
        entries = entries.withColumns({"prompt": checked, "response": response})
    else:
        raise ValueError("on_invalid must be 'fail' or 'skip'")
    given = set(entries.columns)
    key = text.query_hash("prompt")
    ts = F.col("ts") if "ts" in given else F.localtimestamp()
    metadata = F.col("metadata") if "metadata" in given else F.lit(None).cast("string")
    seq = F.col("seq") if "seq" in given else F.monotonically_increasing_id()
    return entries.select(
        key.alias("query_hash"),
        text.encode_base64("prompt").alias("prompt_b64"),
        text.encode_base64("response").alias("response_b64"),
        ts.cast("timestamp_ntz").alias("ts"),
        F.when(~metadata.isin("", "{}", "null"), metadata).alias("metadata"),
        seq.cast("long").alias("seq"),
        F.lit("put").alias("op"),
        F.substring(key, 1, 2).alias("hash_prefix"),
    )


#: Requested hashes that are named in the plan, for each bucket of a log: beyond them all buckets are asked for.
NAMED_PER_BUCKET = 4


#: What an entry holds beside its hash, its time and its place in the order of writes.
TEXTS = ("prompt_b64", "response_b64", "metadata")


def cache_current(log: DataFrame) -> DataFrame:
    """The valid entry per hash: the last write wins, and of writes at one time and place in
    order the one whose response hashes highest, so the answer never depends on the run.
    Of a stored log the rows of a hash are reduced where they lie; of any other, per task before
    the shuffle. ``clear`` rows, few as they are, are one value that every row is compared with."""
    return _reduced(log, log)


def _reduced(log: DataFrame, asked: DataFrame, texts: Sequence[str] = TEXTS) -> DataFrame:
    """The current entries of the ``asked`` rows of a log, with the ``texts`` that are wanted."""
    cleared = log.where((F.col("query_hash") == "") & (F.col("op") == "clear")).agg(F.max(F.struct("ts", "seq"))).scalar()
    alive = F.coalesce(F.struct("ts", "seq") >= cleared, F.lit(True))
    last = F.max(F.struct("ts", "seq", "op", F.xxhash64("response_b64").alias("tie"), *texts)).alias("last")
    rows = asked.where((F.col("op") != "clear") & alive).groupBy("query_hash").agg(last)
    return rows.where(F.col("last.op") == "put").select(
        "query_hash", *[F.col(f"last.{c}").alias(c) for c in ("prompt_b64", "response_b64", "ts", "metadata", "seq") if c in (*texts, "ts", "seq")],
        F.substring("query_hash", 1, 2).alias("hash_prefix"))


def cache_entries(log: DataFrame, requests: DataFrame, buckets: int, texts: Sequence[str] = TEXTS) -> DataFrame:
    """The current entries that ``requests`` (with ``query_hash``) ask for. Of the log only the
    ``texts`` that are wanted are read: one that is left out is not there in the result.

    A log stored in ``buckets`` stays where it is: the different hashes come to its buckets, and
    where they are too few to ask for all of these, they are named, and the others are not read."""
    wanted = requests.select("query_hash").where(F.col("query_hash").isNotNull()).distinct()
    few = [r[0] for r in wanted.limit(NAMED_PER_BUCKET * buckets + 1).collect()]
    if len(few) <= NAMED_PER_BUCKET * buckets:
        return _reduced(log, log.where(F.col("query_hash").isin(few)), texts)
    return _reduced(log, log.join(wanted, "query_hash", "left_semi"), texts)


def cache_get(log: DataFrame, prompt: str) -> DataFrame:
    """The entry of one prompt: reads one bucket of a stored log."""
    return _reduced(log, log.where(F.col("query_hash") == F.sha2(F.lit(prompt), 256)))


def cache_lookup(requests: DataFrame, current: DataFrame, spread_by: list[str]) -> DataFrame:
    """Requests (with ``query_hash``) plus ``response`` and ``cache_hit``. A response that
    cannot be decoded is a miss. Repeated prompts may be any share of the requests."""
    known = current.select("query_hash", text.decode_base64("response_b64").alias("response"))
    found = join_to_unique(requests, known, ["query_hash"], "left", spread_by)
    return found.withColumn("cache_hit", F.col("response").isNotNull())


def cache_misses(requests: DataFrame, current: DataFrame, spread_by: list[str]) -> DataFrame:
    """One row per request hash without a usable answer. Hashes are compared first, so
    only the texts of misses move."""
    usable = current.where(text.decode_base64("response_b64").isNotNull()).select("query_hash")
    missing = requests.select("query_hash").distinct().join(usable, "query_hash", "left_anti")
    return join_to_unique(requests, missing, ["query_hash"], "left_semi", spread_by).dropDuplicates(["query_hash"])


def _tombstones(current: DataFrame, ts: Column | None) -> DataFrame:
    """Rows that delete the given entries; each sorts after the write it deletes."""
    no_text = F.lit(None).cast("string")
    when = F.greatest("ts", ts if ts is not None else F.localtimestamp())
    return current.select(
        "query_hash", no_text.alias("prompt_b64"), no_text.alias("response_b64"), when.alias("ts"),
        no_text.alias("metadata"), (F.col("seq") + 1).alias("seq"), F.lit("delete").alias("op"), "hash_prefix",
    ).select(*schema.CACHE_LOG.names)


def cache_invalidate(current: DataFrame, prompts: DataFrame, ts: Column | None = None) -> DataFrame:
    """Log rows that remove the entries of the given prompts; one row per removed entry."""
    keys = prompts.select(text.query_hash("prompt").alias("query_hash")).distinct()
    return _tombstones(current.join(keys, "query_hash", "left_semi"), ts)


def cache_clear(current: DataFrame, older_than: Column | None = None, ts: Column | None = None) -> DataFrame:
    """Log rows that remove all entries, or those written before ``older_than``."""
    return _tombstones(current if older_than is None else current.where(F.col("ts") < older_than), ts)


def cache_clear_range(log: DataFrame, older_than: Column | None = None, ts: Column | None = None) -> DataFrame:
    """One log row that clears everything written so far, or before ``older_than``. It holds the
    end of what it clears as its place in the order of writes; later writes count again."""
    if older_than is not None:
        ends = log.sparkSession.range(1).select(older_than.cast("timestamp_ntz").alias("ts"), F.lit(-(1 << 63)).cast("long").alias("seq"))
    else:
        when = (ts if ts is not None else F.localtimestamp()).cast("timestamp_ntz")
        last = log.where(F.col("op") != "clear").agg(F.max(F.struct("ts", "seq")).alias("last")).select("last.*")
        beyond = F.coalesce(F.col("ts") < when, F.lit(True))
        ends = last.select(F.when(beyond, when).otherwise(F.col("ts")).alias("ts"),
                           F.when(beyond, F.lit(-(1 << 63)).cast("long")).otherwise(F.col("seq") + 1).alias("seq"))
    no_text = F.lit(None).cast("string")
    return ends.select(
        F.lit("").alias("query_hash"), no_text.alias("prompt_b64"), no_text.alias("response_b64"), "ts", no_text.alias("metadata"), "seq",
        F.lit("clear").alias("op"), F.lit("").alias("hash_prefix"))


def cache_stats(current: DataFrame) -> DataFrame:
    size = F.length("prompt_b64") + F.length("response_b64")
    return current.agg(
        F.count(F.lit(1)).alias("total_entries"), F.min("ts").alias("oldest_entry"), F.max("ts").alias("newest_entry"),
        F.coalesce(F.sum(size), F.lit(0)).alias("total_size_bytes"))
