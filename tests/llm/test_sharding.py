import struct
from collections import Counter

import pytest
import xxhash

from payscope.llm import sharding as S
from tests.llm.frames import documents, empty


def brute(names, slots):
    import hashlib
    prefer = {}
    for n in names:
        d = hashlib.md5(n.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:], "big") % (slots - 1) + 1
        prefer[n] = [(offset + j * skip) % slots for j in range(slots)]
    owner = {}
    while len(owner) < slots:
        for n in sorted(names):
            if len(owner) < slots:
                owner[next(s for s in prefer[n] if s not in owner)] = n
    return [owner[s] for s in range(slots)]


def test_table_is_filled_in_turns_by_preference():
    names = [f"s{i}" for i in (3, 1, 4, 0, 5)]
    assert [names[k] for k in S.fill_table(dict.fromkeys(names, 1), 101)] == brute(names, 101)


def test_shares_differ_by_one_slot_and_weights_hold():
    counts = Counter(S.fill_table(S.default_shards()))
    assert max(counts.values()) - min(counts.values()) <= 1 and sum(counts.values()) == S.SLOTS
    heavy = Counter(S.fill_table({"a": 1, "b": 3}, 1009))
    assert abs(heavy[1] - 3 * heavy[0]) <= 4


def test_few_slots_move_when_a_shard_leaves():
    before = S.default_shards(16)
    after = {n: w for n, w in before.items() if n != "shard-007"}
    a, b = S.fill_table(before), S.fill_table(after)
    moved = sum(list(before)[x] != list(after)[y] for x, y in zip(a, b) if list(before)[x] != "shard-007")
    assert moved < 0.25 * S.SLOTS


def test_bad_parameters():
    for bad in (lambda: S.fill_table({"a": 1}, 100), lambda: S.fill_table({}, 101), lambda: S.fill_table({"a": 0}, 101)):
        with pytest.raises(ValueError):
            bad()


def test_placement_equals_brute_force(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    table = S.fill_table(S.default_shards())
    for r in S.place(df, ["doc_id"], S.default_shards()).collect():
        slot = xxhash.xxh64_intdigest(struct.pack("<q", r["doc_id"]), 42)
        slot = (slot - (1 << 64) if slot >> 63 else slot) % S.SLOTS
        assert (r["slot"], r["shard"]) == (slot, f"shard-{table[slot]:03d}")


def test_edge_rows_and_clashing_columns(spark):
    docs = documents(spark)
    out = S.place(docs, ["doc_id"], S.default_shards())
    assert out.columns == [*docs.columns, "slot_", "shard"] and out.count() == docs.count()
    assert out.where("shard is null").count() == 0
    assert S.place(empty(spark), ["doc_id"], S.default_shards()).count() == 0


def test_no_python_in_the_plan(spark):
    plan = S.place(documents(spark), ["doc_id"], S.default_shards())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def test_written_shards_hold_every_row(spark, tmp_path):
    df = spark.range(300).withColumnRenamed("id", "doc_id")
    S.write_shards(df, str(tmp_path / "out"), ["doc_id"], S.default_shards(4), slots=101, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 300 and back.select("shard").distinct().count() == 4
