"""Language identification by Bayesian evidence fusion.

For every language l and document

    P(l | all)  ~  P(text | l) * P(declared | l) * P(suffix | l) * P(l | host)

* **text**: letter trigrams under a multinomial model of each language, fitted on a bounded
  sample of different labelled texts (``SAMPLE`` expected for each language). Every label is a language,
  however many there are and however few rows one has; a document's scores are as many. The whole text is read; its
  mean log likelihood counts as that of at most ``GRAMS`` independent trigrams. One more
  hypothesis, "und", spreads evenly over all trigrams: text that fits no language better.
* **declared** (the language a page's markup names) and **suffix** (the last label of its
  address): how often each value goes with each language that the texts alone suggest.
* **host**: language shares of the host, smoothed towards those of its domain, these towards
  those of its suffix, these towards those of the whole table.

All counts are grouped aggregations over all documents; the tables are as long as there are
different hosts and values, and are joined, not collected.

Defined results: null and empty texts and texts without letters have no text evidence; the
other evidence then decides, and a document whose best language stays under ``min_posterior``
is "und" and rejected, as is one whose text is null or has no letters; null declared, address
or host gives no evidence of its kind; equal posteriors go to the language first in the
alphabet; without labelled rows everything is rejected; an empty table stays empty; columns of
the input that carry a result's name are replaced, all others stay.
"""

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sourcequarry.llm.common import fresh, slices, with_computed
from sourcequarry.runtime import materialize

#: Labelled texts of each language that the text model is fitted on, as expected.
SAMPLE = 2_000
#: Share of the usual weight of an unseen trigram in a language of which nothing was seen; it is
#: whole from ``BUCKETS`` trigrams on. Text that fits no language then stays so however few rows
#: the rarest label has.
UNSEEN = 0.125
#: Independent trigrams that a text counts as, at most.
GRAMS = 60
BUCKETS = 1 << 14
#: Languages whose counts a task holds before it hands them on.
HELD = 256
#: Weight, in documents, of the coarser level in every smoothed share.
SMOOTHING = 10.0
UNDETERMINED = "und"
UNDETERMINED_PRIOR = 1e-12

RESULT = ["language", "posterior", "text_language", "rejected"]


@dataclass(frozen=True)
class TextModel:
    """Log likelihoods less that of even spread: ``base`` of a trigram that a language was not
    seen with, and for each bucket the languages it was seen with and what these have above."""

    languages: list[str]
    base: np.ndarray  # language
    first: np.ndarray  # bucket, and the end
    language: np.ndarray
    above: np.ndarray

    def evidence(self, text: str | None) -> list[float] | None:
        """Log likelihood of the text under each language, less that of even spread."""
        grams = trigrams(text)
        if not len(grams):
            return None
        times = np.bincount(grams, minlength=BUCKETS)
        bucket = np.flatnonzero(times)
        sizes = self.first[bucket + 1] - self.first[bucket]
        at = np.arange(sizes.sum()) + np.repeat(self.first[bucket] - np.cumsum(sizes) + sizes, sizes)
        above = np.bincount(self.language[at], self.above[at] * np.repeat(times[bucket], sizes), len(self.languages))
        return ((self.base + above / len(grams)) * min(len(grams), GRAMS)).tolist()


def text_model(languages: list[str], language: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> TextModel:
    """The model of languages with ``n`` trigrams of each bucket, as rows in any order."""
    seen = np.bincount(language, n, len(languages))
    least = 0.5 * (UNSEEN + (1 - UNSEEN) * np.minimum(1.0, seen / BUCKETS))
    order = np.argsort(bucket, kind="stable")
    language, bucket, n = language[order].astype(np.int32), bucket[order], n[order]
    return TextModel(languages, np.log(least / (seen + 0.5 * BUCKETS)) + np.log(BUCKETS), np.searchsorted(bucket, np.arange(BUCKETS + 1)),
                     language, np.log(1 + n / least[language]).astype(np.float32))


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the trigrams whose middle is a letter; everything else counts as a blank."""
    if not text:
        return np.empty(0, np.int64)
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    letter = (codes >= 0xAA) | ((codes >= 97) & (codes <= 122))
    codes = np.where(letter, codes, 32)
    grams = codes[:-2] * 0x9E3779B1 ^ codes[1:-1] * 0x85EBCA77 ^ codes[2:] * 0xC2B2AE3D
    grams = (grams ^ (grams >> 15)) * 0x2C1B3C6D
    return ((grams >> 12) & (BUCKETS - 1))[letter[1:-1]]


def fit(docs: DataFrame, label: str, text: str = "text", sample: int = SAMPLE) -> TextModel:
    """The text model of all labels, from different labelled texts, drawn by their hash: all of a
    label that has few, however often each is repeated."""
    hashed, = fresh(docs, "text_hash")
    labelled = docs.where(F.col(label).isNotNull() & (F.col(label) != "")).withColumn(hashed, F.xxhash64(text, F.lit(1)))
    different = labelled.groupBy(F.col(label).alias("label"), hashed).agg(F.count(F.lit(1)).alias("n"))
    counted = different.groupBy("label").count().collect()
    languages = sorted(r["label"] for r in counted)
    number = {name: i for i, name in enumerate(languages)}
    shares = {r["label"]: sample / r["count"] for r in counted if r["count"] > sample}
    share = F.lit(1.0)
    if shares:
        share = F.coalesce(F.try_element_at(F.from_json(F.lit(json.dumps(shares)), "map<string,double>"), F.col(label)), share)
    drawn = labelled.where(F.pmod(F.col(hashed), F.lit(1_000_000)) < share * 1_000_000).groupBy(label, hashed).agg(F.first(text).alias(text))

    def counts_of(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
        found = {i: np.flatnonzero(t) for i, t in totals.items()}
        columns = [np.repeat(list(found), [len(b) for b in found.values()]), np.concatenate(list(found.values())),
                   np.concatenate([totals[i][b] for i, b in found.items()])]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int64()), strict=True)],
                               names=["language", "bucket", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                for name, value in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    found = np.bincount(trigrams(value), minlength=BUCKETS)
                    totals[number[name]] = totals.get(number[name], 0) + found
                    if len(totals) == HELD:
                        yield counts_of(totals)
                        totals = {}
        if totals:
            yield counts_of(totals)

    counts = drawn.select(label, text).mapInArrow(count, "language int, bucket int, n bigint")
    table = counts.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()  # as many rows as languages have trigrams
    return text_model(languages, *(table[c].to_numpy(np.int64) for c in ("language", "bucket", "n")))


def host_of(address: Column) -> Column:
    """The host of a URL in lower case, without user and port; null where there is none."""
    host = F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def identify(
    docs: DataFrame,
    model: TextModel,
    text: str = "text",
    declared: Column | None = None,
    host: Column | None = None,
    min_posterior: float = 0.5,
    drop_text: bool = False,
) -> DataFrame:
    """``docs`` with ``language``, its ``posterior``, ``text_language`` (by the text alone) and
    ``rejected``. ``declared`` and ``host`` are expressions over ``docs``."""
    said, at, scores, domain, suffix = fresh(docs, "said", "at", "scores", "domain", "suffix")
    prior, suffix_evidence, declared_evidence, fused = fresh(docs, "prior", "suffix_evidence", "declared_evidence", "fused")
    kept = [c for c in docs.columns if c.lower() not in RESULT and not (drop_text and c == text)]
    names = model.languages
    no_value = F.lit(None).cast("string")
    rows = (
        docs.withColumn(said, F.lower(F.substring_index(declared, "-", 1)) if declared is not None else no_value)
        .withColumn(at, host if host is not None else no_value)
        .withColumn(suffix, F.when(F.col(at).contains("."), F.substring_index(at, ".", -1)))
        .withColumn(domain, F.when(F.col(at).contains("."), F.substring_index(at, ".", -2))))
    scored = with_computed(rows, text, scores, T.ArrayType(T.DoubleType()), pa.list_(pa.float64()),
                           lambda texts: [model.evidence(t) for t in texts], drop_source=drop_text)
    if drop_text:
        scored = materialize(scored, "language-scores")
    if not names:
        return scored.select(*kept, F.lit(UNDETERMINED).alias("language"), F.lit(0.0).alias("posterior"),
                             F.lit(None).cast("string").alias("text_language"), F.lit(True).alias("rejected"))

    best = (F.array_position(F.col(scores), F.array_max(scores)) - 1).cast("int")
    guessed = scored.select(at, domain, suffix, said, F.when(F.array_max(scores) > 0, best).alias("guess"))
    cube = materialize(guessed.groupBy(at, domain, suffix, said, "guess").agg(F.count(F.lit(1)).cast("double").alias("n")), "language-counts")

    def counts_by(*keys: str) -> DataFrame:
        sums = cube.groupBy(*keys, "guess").agg(F.sum("n").alias("n"))
        listed = F.map_from_entries(F.collect_list(F.when(F.col("guess").isNotNull(), F.struct("guess", "n"))))
        each = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.coalesce(F.try_element_at("n", i), F.lit(0.0)))
        return sums.groupBy(*keys).agg(listed.alias("n")).select(*keys, each.alias("n"))

    found = {r["guess"]: r["n"] for r in cube.where("guess is not null").groupBy("guess").agg(F.sum("n").alias("n")).collect()}
    totals = [found.get(i, 0.0) for i in range(len(names))]
    whole = [(n + 1.0) / (sum(totals) + len(names)) for n in totals]
    by_suffix = counts_by(suffix).where(F.col(suffix).isNotNull()).select(suffix, F.col("n").alias("n_suffix"))
    by_domain = counts_by(domain, suffix).where(F.col(domain).isNotNull()).select(domain, F.col("n").alias("n_domain"))
    hosts = counts_by(at, domain, suffix).where(F.col(at).isNotNull()).join(by_domain, domain, "left").join(by_suffix, suffix, "left")
    levels = _constant(whole)
    for level in ("n_suffix", "n_domain", "n"):
        levels = F.coalesce(_smoothed(F.col(level), levels), levels)
    host_prior = hosts.select(at, F.transform(levels, F.ln).alias(prior), _likelihood(F.col("n_suffix"), totals).alias(suffix_evidence))
    by_said = counts_by(said).where(F.col(said).isNotNull()).select(said, _likelihood(F.col("n"), totals).alias(declared_evidence))

    joined = scored.join(host_prior, at, "left").join(by_said, said, "left")
    flat, no_evidence = _constant(np.log(whole).tolist()), F.array_repeat(F.lit(0.0), len(names))
    sums = F.coalesce(prior, flat)
    for evidence in (F.col(suffix_evidence), F.col(declared_evidence), F.col(scores)):
        sums = F.zip_with(sums, F.coalesce(evidence, no_evidence), lambda a, b: a + b)
    joined = joined.withColumn(fused, sums)
    top = F.array_max(fused)
    other = F.exp(F.lit(float(np.log(UNDETERMINED_PRIOR))) - top)
    posterior = 1.0 / (F.aggregate(fused, F.lit(0.0), lambda t, x: t + F.exp(x - top)) + other)
    named = _constant(names, "string")
    text_language = F.when(F.array_max(scores) > 0, F.get(named, (F.array_position(F.col(scores), F.array_max(scores)) - 1).cast("int")))
    rejected = (posterior < min_posterior) | F.col(scores).isNull()
    language = F.when(rejected, F.lit(UNDETERMINED)).otherwise(F.get(named, (F.array_position(F.col(fused), top) - 1).cast("int")))
    return joined.select(*kept, language.alias("language"), posterior.alias("posterior"), text_language.alias("text_language"), rejected.alias("rejected"))


def _constant(values: list, kind: str = "double") -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _smoothed(counts: Column, coarser: Column) -> Column:
    """Shares of one level, with ``SMOOTHING`` documents of the coarser one."""
    total = F.aggregate(counts, F.lit(0.0), lambda t, x: t + x)
    return F.zip_with(counts, coarser, lambda n, p: (n + SMOOTHING * p) / (total + SMOOTHING))


def _likelihood(counts: Column, totals: list[float]) -> Column:
    """Log of how much more often a value goes with each language than with all."""
    of_all = F.aggregate(counts, F.lit(0.0), lambda t, x: t + x) / float(sum(totals) + 1.0)
    each = _constant(totals)
    return F.zip_with(counts, each, lambda n, t: F.ln((n + SMOOTHING * of_all + 1e-9) / (t + SMOOTHING) / (of_all + 1e-9)))
