"""Which filter removes what, in every order in which the filters could be applied.

A document's failures are a mask, one bit for each filter. The audit needs no pass over documents
for each order: documents are counted by part and mask, and the rest is arithmetic on matrices.
A mask matrix holds 0 where a mask fails a filter and infinity elsewhere; a position matrix holds
the inverse of every permutation, the place of each filter in each order. Their product with
minimum for addition and addition for multiplication is the step at which an order removes a
mask. Counts are then scattered to those steps, weighted by the documents of the mask.

Texts are read once, for four numbers and a digest; only these move. Copies are told from the
first text by joining each digest's smallest id to the rows of that digest and id, so the rows of a
text that many documents share are spread by their ids.

Defined results: a null text is empty; a text of no words has no share of distinct words and
fails by its length; a null id is no one's first and has no smaller one, so it never fails as a
copy; rows of one id with one text are no copies of each other; repeated labels of one id count
once, if any of them says so; null labels say nothing; a null part is the empty one; columns of
any name pass, as only the named ones are read; an empty table has no parts and gives no rows.
"""

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sourcequarry.llm.common import slices
from sourcequarry.operators.skew import join_to_unique
from sourcequarry.runtime import materialize

COUNTS = ("n", "good", "toxic")
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, " \
    "good_lost long, toxic_lost long, shapley long"


def text_failures(text: Column) -> dict[str, Column]:
    """The four filters that look at one text: short, repetitive, shouting, symbols."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n_words = F.size(words).cast("long")
    n_chars = F.length(text).cast("long")
    capitals = n_chars - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n_words < 50,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < n_words * 65,
        "C": capitals * 100 > n_chars * 5,
        "D": text.rlike(r"[#$%&*|]"),
    }


def counted_masks(
    docs: DataFrame, labels: DataFrame, failures: dict[str, Column], id: str = "doc_id", text: str = "text", part: str = "source",  # noqa: A002
) -> DataFrame:
    """part, mask, n, good and toxic: the documents of every part and mask, and how many of
    them are labelled so. Bit i of a mask stands for the i-th of ``failures``, the highest for
    a text that some document of a smaller id has too."""
    bits = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(failures.values())), F.lit(0))
    read = docs.select(
        F.col(id).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), bits.cast("int").alias("mask"),
        F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"))
    rows = materialize(read, "masks").groupBy("digest", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    nameless = rows.where("id is null").select("part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    rows = rows.where("id is not null")
    firsts = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    says = {c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c) for c in ("quality", "toxic")}
    said = labels.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(says["quality"].alias("good"), says["toxic"])
    named = rows.join(firsts, ["digest", "id"], "left").select(
        "id", "digest", "part", "n", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + (1 << len(failures))).alias("mask"))
    named = join_to_unique(materialize(named, "named-masks"), said, ["id"], "left", ["digest", "part"]).select(
        "part", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return named.unionByName(nameless).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def removal_steps(n_filters: int, orders: np.ndarray) -> np.ndarray:
    """The step (from 1; beyond the last: never) at which each order removes each mask."""
    never = n_filters + 1
    masks = np.arange(1 << n_filters)
    fails = np.where(masks[:, None] >> np.arange(n_filters) & 1, 0, never)
    positions = np.argsort(orders, axis=1) + 1
    steps = np.full((len(orders), len(masks)), never)
    for j in range(n_filters):
        np.minimum(steps, positions[:, j, None] + fails[None, :, j], out=steps)
    return steps


def audit(counted: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """One row for every part, order of ``filters`` (at most six) and step."""
    n_filters = len(filters)
    if not 1 <= n_filters <= 6:
        raise ValueError("between one and six filters")
    each = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("masks"))  # at most 2 ** n_filters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = np.array(list(permutations(range(n_filters))))
        names = ["".join(filters[f] for f in order) for order in orders]
        step_of = removal_steps(n_filters, orders)[:, None, :]  # order, step, mask
        step = np.arange(1, n_filters + 1)[None, :, None]
        masks = np.arange(1 << n_filters)
        fails = (masks[None, :] >> np.arange(n_filters)[:, None] & 1).astype(bool)  # filter, mask
        here = step_of == step
        flat = lambda x: np.ascontiguousarray(x.reshape(-1, len(masks)).astype(np.int64).T)
        scatter = {"kept": flat(step_of > step), "removed": flat(here), "redundant": flat(fails[orders] & (step_of < step)),
                   "unique_fails": flat((masks == 1 << np.arange(n_filters)[:, None])[orders])}
        first = np.zeros((n_filters, len(masks)), np.int64)
        np.add.at(first, orders.ravel(), here.reshape(-1, len(masks)))
        scatter["shapley"] = flat(first[orders])
        for batch in batches:
            for few in slices(batch, 1 << 14):
                weights = np.zeros((len(COUNTS), few.num_rows, len(masks)), np.int64)
                for i, some in enumerate(few.column(1).to_pylist()):
                    for one in some:
                        weights[:, i, one["mask"]] += [one[c] for c in COUNTS]
                n, good, toxic = weights
                columns = {name: n @ matrix for name, matrix in scatter.items()}
                columns |= {"good_lost": good @ scatter["removed"], "toxic_lost": toxic @ scatter["removed"]}
                rows = len(orders) * n_filters
                yield pa.record_batch({
                    "part": few.column(0).take(pa.array(np.repeat(np.arange(few.num_rows), rows))),
                    "filter_order": pa.array(np.repeat(names, n_filters).tolist() * few.num_rows, pa.string()),
                    "step": pa.array(np.tile(np.arange(1, n_filters + 1, dtype=np.int32), len(orders) * few.num_rows)),
                    **{c: pa.array(columns[c].ravel()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}})

    return each.mapInArrow(run, RESULT)


def audit_documents(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:  # noqa: A002
    """The audit of the four text filters and of copies (E)."""
    failures = text_failures(F.col(text))
    return audit(counted_masks(docs, labels, failures, id, text, part), "".join(failures) + "E")
