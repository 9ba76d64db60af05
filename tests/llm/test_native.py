import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from plumeline.llm import exact_dedup, sharding

SCHEMA = "doc_id long, text string, keep_id string, hash string, n_chars long"
ROWS = [(1, "a  b", "x", "y", 1), (2, "a b", "x", "y", 1), (3, None, None, None, None), (4, "", "", "", 0), (5, "\t a\x0bb", "k", "h", 3), (6, " a b", "k", "h", 3), (None, "a b", "z", "z", 1), (8, "z" * 200_000, "l", "l", 9), (9, "u", "", "", 1), (9, "u", "", "", 1)]


def test_duplicate_table_and_forced_hash_collisions(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for hashed in (exact_dedup.content_hash, lambda body: F.substring(F.md5(body.cast("binary")), 1, 1)):
        got = exact_dedup.duplicate_table(df, hashed).collect()
        norm = {r[0]: re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in ROWS if r[0] is not None} | {None: "a b"}
        assert len(got) == len(ROWS)
        for r in got:
            same = [x[0] for x in ROWS if norm[x[0]] == norm[r.doc_id]]
            least = min(i for i in same if i is not None)
            assert (r.keep_id, r.group_size, r.kept) == (least, len(same), r.doc_id == least)
            assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()
    kept = exact_dedup.drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, "a  b"), (3, None), (5, "\t a\x0bb"), (8, "z" * 200_000), (9, "u")])


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.duplicate_table(df).collect() == []
    assert exact_dedup.drop_exact_duplicates(df).collect() == []
    assert sharding.assign(df).collect() == []


def test_shards_are_even_and_positions_gapless(spark):
    rng = random.Random(2)
    rows = [(i, "é" * int(rng.paretovariate(1.1) * 20), None, None, None) for i in range(3000)] + ROWS
    got = sharding.assign(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    loads, places = [0] * 16, {}
    for r in got:
        loads[r.shard] += r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert max(loads) - min(loads) <= max(r.size for r in got)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    text = {r[0]: r[1] for r in rows[:3000]}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id].encode()) + 1 for r in got if r.doc_id is not None and r.doc_id > 9)


def test_slot_map_versions(spark, tmp_path):
    weights = {s: (s * 7919) % 1000 + 1 for s in range(512)}
    first = sharding.SlotMap.even(4, 512)
    second = first.rebalanced(weights)
    assert second.version == 1 and second.moved < 200
    assert max(second.loads(weights)) - min(second.loads(weights)) <= 2
    third = second.grown(weights)
    assert {b for a, b in zip(second.owners, third.owners, strict=True) if a != b} == {4}
    for m in (first, second, third):
        m.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")) == third
    assert sharding.SlotMap.load(spark, str(tmp_path / "map"), 1).owners == second.owners


def test_repeated_ids_leave_the_same_row_in_any_order(spark):
    from plumeline.llm.exact_dedup import drop_exact_duplicates

    rows = [(1, "a b", i) for i in range(20)] + [(2, "a  b", 50)]
    schema = "doc_id long, text string, body int"
    got = {tuple(tuple(r) for r in drop_exact_duplicates(spark.createDataFrame(x, schema).repartition(n)).collect()) for x, n in ((rows, 1), (rows[::-1], 3), (rows[7:] + rows[:7], 5))}
    assert len(got) == 1
