import math

import pytest
import xxhash

from sourcequarry.llm import sharding


def test_equals_plain_rendezvous_hashing(spark):
    weights = [1.0, 2.0, 0.5, 1.0]
    docs = spark.createDataFrame([(i, i % 3) for i in range(2000)], "doc_id long, shard int")
    found = sharding.assign_shards(docs, ["doc_id"], weights, grown_by=[1.0])

    def best(key, some):
        def score(s):
            h = xxhash.xxh64_intdigest(s.to_bytes(4, "little"), xxhash.xxh64_intdigest(key.to_bytes(8, "little"), 42))
            return -some[s] / math.log(((h >> 11) + 0.5) / (1 << 53))
        return max(range(len(some)), key=lambda s: (score(s), -s))

    rows = found.collect()
    assert all((r["shard"], r["grown_shard"]) == (best(r["doc_id"], weights), best(r["doc_id"], [*weights, 1.0])) for r in rows)
    assert all(r["grown_shard"] in (r["shard"], 4) for r in rows)
    share = sum(r["shard"] == 1 for r in rows) / len(rows)
    assert abs(share - 2 / 4.5) < 0.05


def test_slots_nulls_repeats_and_clashing_names(spark, tmp_path):
    rows = [(None, "a", 1)] * 50 + [(7, None, 2)] * 50 + [(i, "x", None) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, part string, slot int").repartition(5)
    numbered = sharding.number_slots(sharding.assign_shards(docs, ["doc_id"], [1.0] * 3))
    assert set(numbered.columns) == {"doc_id", "part", "slot", "shard"}
    slots = {}
    for r in numbered.collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sum(map(len, slots.values())) == len(rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in numbered.where("doc_id is null").collect()}) == 1
    sharding.write_shards(numbered, f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").count() == len(rows)
    assert sharding.number_slots(sharding.assign_shards(docs.limit(0), ["doc_id"], [1.0])).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of(["doc_id"], [1.0, 0.0])
