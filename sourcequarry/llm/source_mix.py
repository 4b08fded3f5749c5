"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, as many times over as its target asks
for. A document's virtual finish time is the number of tokens its queue has served by its end,
divided by the source's target. Sorted by that time, the queues are interleaved in proportion to
their targets at every place of the mix, and the mix ends where the total budget is spent. A
long document is served in pieces, as a network sends packets, so that it does not hold up the
others and the end falls near every target; only the piece in service at the end is cut.

Targets are shares of the budget by weight, but no more than a number of times the source's own
size; what is above goes to the others by weight until none is above.

A queue may hold a third of all rows: its running sums are taken in ranges of the shuffled order
(``common.running_sum``), and so are those of the whole mix. Only ids and sizes move, not texts.

Defined results: a null size is 0; documents of size 0 are part of no mix and take nothing; a
null source is a source of its own, after all others; null and repeated ids are rows of their
own, and rows that are alike in all of ``key`` may change places; a source of size 0 has target 0;
an empty table, or one of empty documents, has an empty mix. The shuffle is a digest of
``key``, the round and the seed, so a run repeats another whatever the partitions.
"""

from pyspark.sql import DataFrame, functions as F

from sourcequarry.llm.common import running_sum
from sourcequarry.operators.skew import join_to_unique
from sourcequarry.runtime import materialize

#: Tokens that are served at once.
PIECE = 128


def source_targets(rows: DataFrame, weights: list[int], share: float, most_times: int) -> DataFrame:
    """no_source, source, number (from 1, in order of code points, null last), source_size and
    target of every source of ``rows`` (no_source, source, size), stored."""
    sizes = rows.groupBy("no_source", "source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    numbered = running_sum(sizes, "one", "number", ["no_source", "source"]).drop("one")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    numbered = materialize(numbered.withColumn("weight", weight).withColumn("most", F.col("source_size") * most_times), "sources")
    total = numbered.agg(F.sum("source_size")).first()[0] or 0
    budget, level, before = total * share, 0.0, None
    while level != before:  # the level rises with every round until no further source is above
        before = level
        full = F.col("most") <= F.col("weight") * level
        spent, rest = numbered.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        level = (budget - (spent or 0)) / rest if rest else before
    # ``least`` of whole and fractional numbers is a fraction
    return materialize(numbered.withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * level)), "targets")


def queue(rows: DataFrame, targets: DataFrame, key: list[str], seed: int) -> DataFrame:
    """One row for every time a document may be served: row, size, number, target, and ``served``,
    the tokens of its source's queue until its end."""
    known = targets.where("target > 0").select(
        "no_source", "source", "number", "target", F.ceil(F.col("target") / F.col("source_size")).cast("int").alias("rounds"))
    offered = join_to_unique(rows.where("size > 0"), known, ["no_source", "source"], "inner", ["row"])
    offered = offered.withColumn("round", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
    parts = [F.col("round").cast("string"), F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]]
    shuffled = offered.select("row", "size", "number", "target", "round", F.md5(F.concat_ws(":", *parts)).alias("shuffle"))
    return running_sum(shuffled, "size", "served", ["round", "shuffle", "row"], by=("number",))


def mixed(queued: DataFrame, budget: int, piece: int = PIECE) -> DataFrame:
    """The mix: row, number, finish, place (tokens of the mix until the piece's end) and taken,
    for every piece that the budget reaches. ``finish, number, served`` is its order."""
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(piece).cast("long")))
    pieces = queued.withColumn("begins", begins).withColumn("words", F.least(F.lit(piece), F.col("size") - F.col("begins")))
    served = F.col("served") - F.col("size") + F.col("begins") + F.col("words")
    pieces = pieces.select("row", "number", "words", served.alias("served"), (served / F.col("target")).alias("finish"))
    placed = running_sum(pieces, "words", "place", ["finish", "number", "served"])
    before = F.col("place") - F.col("words")
    return placed.where(before < budget).select("row", "number", "finish", "served", "place", F.least("words", F.lit(budget) - before).alias("taken"))


def mix_sources(
    docs: DataFrame, weights: list[int], share: float, most_times: int, key: list[str], size: str = "size", source: str = "source", seed: int = 0,
) -> DataFrame:
    """``docs`` with source_size, target and taken: the tokens of a document that the mix takes,
    all its times together. ``weights`` repeat over the sources in order of code points; the mix
    holds ``share`` of all tokens, rounded down; ``key`` are columns that tell documents apart."""
    inner = ["row", "no_source", "source", "size"]
    held = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("held")
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(source).isNull().alias("no_source"), F.coalesce(F.col(source), F.lit("")).alias("source"),
        F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"), held)
    rows = materialize(rows, "mix-rows")
    targets = source_targets(rows, weights, share, most_times)
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    narrow = rows.select(*inner, *[F.col(f"held.{at[c]}").alias(f"key{i}") for i, c in enumerate(key)])
    queued = queue(narrow, targets, [f"key{i}" for i in range(len(key))], seed)
    taken = mixed(queued, int(total * share)).groupBy("row").agg(F.sum("taken").alias("taken"))
    whole = join_to_unique(rows, targets.select("no_source", "source", "source_size", "target"), ["no_source", "source"], "inner", ["row"])
    out = [c for c in docs.columns if c.lower() not in ("source_size", "target", "taken")]
    return whole.join(taken, "row", "left").select(
        *[F.col(f"held.{at[c]}").alias(c) for c in out], "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
