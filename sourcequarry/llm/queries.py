"""The operators' registered queries, ``(spark, sf_dir) -> DataFrame``, and their SQL."""

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from sourcequarry.llm import (
    bpe, chat, conversation_repair, decontaminate, filter_audit, language_id, license_scan, oracle, sharding, simhash, source_mix,
    suffix_dedup, vector_file, warc)
from sourcequarry.llm.common import ship_package, table
from sourcequarry.runtime import materialize

QUERIES = {}
ORACLE_SQL = oracle.STATEMENTS


def query(function):
    @functools.wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; its label is what markup would declare, its source the host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = language_id.fit(docs, "lang")
    return language_id.identify(docs, model, declared=F.col("lang"), host=F.col("source"), drop_text=True)


@query
def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every web page by its text, markup, address suffix and host."""
    declared = F.regexp_extract("html", r"(?i)<html[^>]*\slang=[\"']?([a-z]+)", 1)
    plain = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", plain.alias("text"), declared.alias("markup"))
    model = language_id.fit(pages, "markup")
    found = language_id.identify(pages, model, declared=F.when(F.col("markup") != "", F.col("markup")),
                                 host=language_id.host_of(F.col("url")), drop_text=True)
    return found.select("page_id", "url", "markup", *language_id.RESULT)


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and template spans of every document."""
    spans = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("license_spans", lambda s: s["phrase"])
    starts = F.transform(base, lambda s: s["first"])
    listed = lambda some: F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda s: s["label"]))), ",")
    return spans.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), listed(base).alias("base_labels"), listed(F.col("license_spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("license_spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"))


@query
def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all vectors for each twentieth vector."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * 64)
    vectors = materialize(vector_file.integer_vectors(table(spark, sf_dir, "embeddings"), scaled), "vectors")
    return vector_file.exact_top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, linked at two bits or fewer."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, n_words=3, bits=64, radius=2, repeats=True).select(
        "doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded from its ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, vocabulary(), drop_text=True)
    return bpe.decode(encoded, vocabulary()).select(
        "doc_id", bpe.token_count("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts look like the template's marks."""
    trap = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", trap), (-1, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.read_back(chat.format_conversations(turns))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived and read back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.read_archives(warc.write_archives(warc.plan_records(pages))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that also start earlier."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1_000)  # as the pipeline does: little is held beside them
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs, length=100, whole_characters=False).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 even shards, and where each would be in 17."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    assigned = sharding.assign_shards(docs, ["doc_id"], [1.0] * 16, grown_by=[1.0])
    return sharding.number_slots(assigned).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"), n=10)
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from every source, in all 120 orders."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.audit_documents(docs, table(spark, sf_dir, "labels"))


@query
def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by weights 5, 2, 1 to one and a half times their words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words.alias("size"), F.md5(text).alias("digest"))
    mix = source_mix.mix_sources(docs, [5, 2, 1], 1.5, 2, ["doc_id", "digest"])
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with one row in four spoilt: gone, emptied, without its ends, doubled, or all users."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *shown).cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    spoilt = turns.withColumn("damage", kind).where("damage <> 0").select(
        "conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.sequence(F.lit(0), F.when(F.col("damage") == 3, 1).otherwise(0))).alias("copy"))
    return spoilt.drop("copy")


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged, and the cheapest edits that make them well formed."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    _, led = conversation_repair.repair(damaged(turns))
    found = conversation_repair.repaired_digests(led)
    all_ids = turns.select("conv_id").distinct()
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_ids.join(found, all_ids["conv_id"].eqNullSafe(found["id"]), "left").select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
