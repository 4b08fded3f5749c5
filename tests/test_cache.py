"""The response cache as a table."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from sourcequarry.operators import cache
from sourcequarry.sources import cache_table

EARLY = dt.datetime(2024, 1, 1)
LATER = dt.datetime(2024, 6, 1)


@pytest.fixture
def entries(spark):
    def make(*rows):
        return spark.createDataFrame(list(rows), "prompt string, response string, metadata string, ts timestamp_ntz, seq long")

    return make


def decoded(log):
    rows = cache_table.cache_scan(cache.cache_current(log)).collect()
    return {r.prompt: (r.response, r.ts, r.metadata) for r in rows}


def test_put_get_and_invalidate(spark, entries):
    log = cache.cache_put(entries(("p", "r", '{"type": "test"}', EARLY, 0)))
    assert decoded(log) == {"p": ("r", EARLY, '{"type": "test"}')}
    gone = cache.cache_invalidate(cache.cache_current(log), spark.createDataFrame([("p",)], "prompt string"))
    assert gone.count() == 1
    log = log.unionByName(gone)
    assert decoded(log) == {}
    again = cache.cache_invalidate(cache.cache_current(log), spark.createDataFrame([("p",)], "prompt string"))
    assert again.count() == 0


def test_a_write_after_a_deletion_counts(spark, entries):
    log = cache.cache_put(entries(("p", "old", None, EARLY, 0)))
    log = log.unionByName(cache.cache_clear(cache.cache_current(log), ts=F.lit(EARLY).cast("timestamp_ntz")))
    assert decoded(log) == {}
    log = log.unionByName(cache.cache_put(entries(("p", "new", None, LATER, 0))))
    assert decoded(log)["p"][0] == "new"


def test_clear_counts_what_it_removes(spark, entries):
    log = cache.cache_put(entries(*[(f"p{i}", "r", None, EARLY, 0) for i in range(3)]))
    removed = cache.cache_clear(cache.cache_current(log))
    assert removed.count() == 3
    assert cache.cache_stats(cache.cache_current(log.unionByName(removed))).first().total_entries == 0


def test_clear_older_is_strict(spark, entries):
    log = cache.cache_put(entries(("old", "r", None, EARLY, 0), ("edge", "r", None, LATER, 0)))
    removed = cache.cache_clear(cache.cache_current(log), older_than=F.lit(LATER).cast("timestamp_ntz"))
    assert removed.count() == 1
    assert set(decoded(log.unionByName(removed))) == {"edge"}


def test_stats(spark, entries):
    empty = cache.cache_stats(cache.cache_current(cache.cache_put(entries()))).first()
    assert tuple(empty) == (0, None, None, 0)
    log = cache.cache_put(entries(("abc", "abc", None, EARLY, 0), ("abc", "abcd", None, LATER, 0)))
    assert tuple(cache.cache_stats(cache.cache_current(log)).first()) == (1, LATER, LATER, 4 + 8)


def test_second_writer_wins(spark, entries):
    log = cache.cache_put(entries(("p", "first", None, EARLY, 0), ("p", "second", None, EARLY, 1)))
    assert decoded(log)["p"][0] == "second"


def test_what_may_be_stored(spark, entries):
    assert decoded(cache.cache_put(entries(("p", "", None, EARLY, 0))))["p"][0] == ""
    with pytest.raises(Exception, match="Prompt cannot be empty"):
        cache.cache_put(entries(("", "r", None, EARLY, 0))).collect()
    with pytest.raises(Exception, match="Response cannot be None"):
        cache.cache_put(entries(("p", None, None, EARLY, 0))).collect()
    mixed = entries(("", "r", None, EARLY, 0), ("p", None, None, EARLY, 0), ("q", "r", None, EARLY, 0))
    assert set(decoded(cache.cache_put(mixed, on_invalid="skip"))) == {"q"}
    assert sorted(r.reason for r in cache.cache_rejects(mixed).collect()) == [
        "Prompt cannot be empty.", "Response cannot be None."]


def test_special_and_large_values_survive(spark, entries):
    odd, large = "tab\t, nul\0, line\r\n and 🧭", "x" * 1_000_000
    log = cache.cache_put(entries((odd, odd, None, EARLY, 0), (large, large, None, EARLY, 0)))
    assert {p: r for p, (r, _, _) in decoded(log).items()} == {odd: odd, large: large}


def test_empty_metadata_is_null(spark, entries):
    log = cache.cache_put(entries(("a", "r", "{}", EARLY, 0), ("b", "r", "", EARLY, 0), ("c", "r", None, EARLY, 0)))
    assert {m for _, _, m in decoded(log).values()} == {None}
    maps = spark.createDataFrame([({"a": "1"},), ({},), (None,)], "m map<string,string>")
    assert [r[0] for r in maps.select(cache_table.metadata_json("m")).collect()] == ['{"a":"1"}', None, None]


def test_lookup_and_misses(spark, entries):
    current = cache.cache_current(cache.cache_put(entries(("hit", "r", None, EARLY, 0))))
    broken = current.select(*[F.lit("####=").alias(c) if c == "response_b64" else
                              F.sha2(F.lit("broken"), 256).alias(c) if c == "query_hash" else F.col(c) for c in current.columns])
    current = current.unionByName(broken)
    asked = spark.createDataFrame([(1, "hit"), (2, "hit"), (3, "broken"), (4, "new"), (5, "new")], "id int, prompt string")
    asked = asked.withColumn("query_hash", F.sha2("prompt", 256))
    found = {r.id: (r.response, r.cache_hit) for r in cache.cache_lookup(asked, current, ["id"]).collect()}
    assert found == {1: ("r", True), 2: ("r", True), 3: (None, False), 4: (None, False), 5: (None, False)}
    assert sorted(r.prompt for r in cache.cache_misses(asked, current, ["id"]).collect()) == ["broken", "new"]


def test_storage_round_trip_and_compaction(spark, entries, tmp_path):
    path = str(tmp_path / "log")
    assert cache_table.read_cache_log(spark, path).count() == 0
    cache_table.append_cache_log(cache.cache_put(entries(*[(f"p{i}", "one", None, EARLY, 0) for i in range(50)])), path)
    cache_table.append_cache_log(cache.cache_put(entries(*[(f"p{i}", "two", None, LATER, 0) for i in range(20)])), path)
    log = cache_table.read_cache_log(spark, path)
    cache_table.append_cache_log(
        cache.cache_invalidate(cache.cache_current(log), spark.createDataFrame([("p49",)], "prompt string")), path)
    before = decoded(cache_table.read_cache_log(spark, path))
    assert len(before) == 49 and sum(r == "two" for r, _, _ in before.values()) == 20
    compacted = str(tmp_path / "compacted")
    cache_table.compact_cache(cache_table.read_cache_log(spark, path), compacted)
    rows = cache_table.read_cache_log(spark, compacted)
    assert rows.count() == 49 and decoded(rows) == before


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, entries, path, n=50):
    cache_table.append_cache_log(cache.cache_put(entries(*[(f"p{i}", str(i), None, EARLY, 0) for i in range(n)])), path)
    return cache_table.read_cache_log(spark, path)


def asked_for(spark, *prompts):
    return spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "id int, prompt string").withColumn("query_hash", F.sha2("prompt", 256))


def test_point_lookup_reads_one_bucket(spark, entries, tmp_path):
    one = cache.cache_get(stored(spark, entries, str(tmp_path / "log")), "p7")
    assert cache_table.cache_scan(one).first().response == "7"
    assert "SelectedBucketsCount: 1 out of 4" in plan_of(one)
    assert "EqualTo(query_hash" in plan_of(one)


def test_a_stored_log_is_not_moved(spark, entries, tmp_path):
    log = stored(spark, entries, str(tmp_path / "log"))
    assert "Exchange hash" not in plan_of(cache.cache_current(log))
    few = cache.cache_entries(log, asked_for(spark, "p7", "p7", "nowhere"), 4)
    assert "Exchange hash" not in plan_of(few) and re.search("SelectedBucketsCount: [12] out of 4", plan_of(few))
    assert [r.query_hash for r in few.collect()] == [r.query_hash for r in asked_for(spark, "p7").collect()]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        many = cache.cache_entries(log, asked_for(spark, *[f"p{i}" for i in range(20, 90)]), 4)
        plan = plan_of(many)
        scan = next(i for i, line in enumerate(plan.splitlines()) if "Bucketed: true" in line)
        depth = plan.splitlines()[scan].index("FileScan")
        above = [line for line in plan.splitlines()[:scan] if line.find(line.strip(" :+-")) < depth]
        assert "LeftSemi" in plan and not any("Exchange hash" in line for line in above)
        assert many.count() == 30
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_that_are_not_wanted_are_not_read(spark, entries, tmp_path):
    log = stored(spark, entries, str(tmp_path / "log"))
    for asked in (asked_for(spark, "p7", "p8", "nowhere"), asked_for(spark, *[f"p{i}" for i in range(20, 90)])):
        answers = cache.cache_entries(log, asked, 4, texts=("response_b64",))
        assert "response_b64:string" in plan_of(answers) and "prompt_b64" not in plan_of(answers)
        whole = cache.cache_entries(log, asked, 4)
        assert sorted(map(str, whole.select(answers.columns).collect())) == sorted(map(str, answers.collect()))


def test_appends_from_elsewhere_are_seen(spark, entries, tmp_path):
    path = str(tmp_path / "it's a log")
    stored(spark, entries, path, 5)
    other = spark.newSession()
    rows = cache.cache_put(other.createDataFrame([("new", "r", None, LATER, 9)], "prompt string, response string, metadata string, ts timestamp_ntz, seq long"))
    cache_table.append_cache_log(rows, path)
    assert cache_table.read_cache_log(spark, path).count() == 6
    with pytest.raises(ValueError, match="already"):
        cache_table.compact_cache(rows, path)


def test_one_row_clears_all_that_was_written(spark, entries, tmp_path):
    path = str(tmp_path / "log")
    log = stored(spark, entries, path, 20)
    assert cache.cache_clear_range(log).count() == 1
    cache_table.append_cache_log(cache.cache_clear_range(log, ts=F.lit(EARLY).cast("timestamp_ntz")), path)
    log = cache_table.read_cache_log(spark, path)
    assert decoded(log) == {} and cache.cache_get(log, "p7").count() == 0
    assert cache.cache_entries(log, asked_for(spark, "p1", "p2"), 4).count() == 0
    again = cache.cache_put(entries(("p3", "same moment", None, EARLY, 1), ("p4", "later", None, LATER, 0)))
    assert {p: r for p, (r, _, _) in decoded(log.unionByName(again)).items()} == {"p3": "same moment", "p4": "later"}
    nothing = cache.cache_put(entries())
    assert decoded(nothing.unionByName(cache.cache_clear_range(nothing))) == {}


def test_one_row_clears_what_is_older(spark, entries):
    log = cache.cache_put(entries(("old", "r", None, EARLY, 0), ("edge", "r", None, LATER, 0), ("edge", "r", None, EARLY, 0)))
    row = cache.cache_clear_range(log, older_than=F.lit(LATER).cast("timestamp_ntz"))
    earlier = cache.cache_clear_range(log, older_than=F.lit(EARLY).cast("timestamp_ntz"))
    assert row.count() == 1
    assert set(decoded(log.unionByName(row).unionByName(earlier))) == {"edge"}
    assert set(decoded(log.unionByName(earlier))) == {"old", "edge"}
