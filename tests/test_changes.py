import random

from vecloom.operators.changes import BucketedTable, current_state

SCHEMA = "store_id bigint, id string, op int, epoch int, set_no bigint, pos_no int, level_no int"


def replayed(rows):
    last = {}
    for r in rows:
        last[r[0]] = max(last.get(r[0], 0), r[3])
    held = {}
    for store, id, op, *_, level in sorted({r for r in rows if r[3] == last[r[0]]}, key=lambda r: r[4:6]):
        key = store, id
        if op == 0 and key not in held or op == 2 and key in held:
            held[key] = level
        elif op == 1:
            held.pop(key, None)
    return sorted((*k, v) for k, v in held.items())


def test_late_and_repeated_batches_give_the_state_of_one(spark, tmp_path):
    rng = random.Random(4)
    rows = [(s, f"t{rng.randrange(12)}", rng.choice([0, 0, 1, 2]), 1 + n // (50 + 20 * s), n // 3, n % 3, rng.randrange(7)) for s in range(4) for n in range(120)]
    want = replayed(rows)
    mixed = rng.sample(rows, len(rows))
    batches = [mixed[k::4] for k in range(4)]
    built = BucketedTable(spark, str(tmp_path / "t"), 8)
    for b in [batches[2], batches[0], batches[2], batches[3], batches[1], batches[0]]:
        built.apply(spark.createDataFrame(b, SCHEMA))
    assert sorted(map(tuple, built.state().collect())) == want
    # a change of one key rewrites its bucket alone, and a dead one changes nothing
    files = built._newest()["files"]
    assert len(built.apply(spark.createDataFrame([(0, "new", 0, 9, 1, 0, 3)][:1], SCHEMA))) >= 1 and built.version == 7
    built.apply(spark.createDataFrame([(1, "late", 0, 0, 999, 0, 3)], SCHEMA))
    after = replayed([*rows, (0, "new", 0, 9, 1, 0, 3)])
    assert sorted(map(tuple, built.state().collect())) == after and files != built._newest()["files"]
    built.vacuum()
    assert sorted(map(tuple, built.state().collect())) == after
    assert sorted(map(tuple, current_state(spark.createDataFrame(rows, SCHEMA)).collect())) == want


def test_odd_rows_and_nothing_at_all(spark, tmp_path):
    rows = [(1, "a", None, 1, 1, 0, None), (1, "a", 2, 1, 2, 0, 4), (1, "b", 7, 1, 1, 0, 1), (None, "c", 0, 1, 1, 0, 1), (1, None, 0, 1, 1, 0, 1), (1, "d", 0, None, 1, 0, 1), (2, "x", 1, 1, 1, 0, 9), (2, "y", 2, 1, 1, 0, 9)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as bucket", "2 as at")
    assert sorted(map(tuple, current_state(df).collect())) == [(1, "a", 4)]
    none = BucketedTable(spark, str(tmp_path / "none"), 4)
    assert none.apply(df.limit(0)) == [] and none.version == 0 and none.state().count() == 0


def test_only_touched_buckets_are_read_and_rewritten(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), 16)
    t.apply(spark.createDataFrame([(1, f"t{k}", 0, 1, k, 0, 0) for k in range(100)], SCHEMA))
    before = t._newest()["files"]
    assert len(before) == 16
    one = t.apply(spark.createDataFrame([(1, "t5", 2, 1, 200, 0, 6), (1, "t5", 2, 1, 200, 0, 6)], SCHEMA))
    after = t._newest()["files"]
    assert len(one) == 1 and {b for b in before if before[b] != after[b]} == {str(one[0])}
    # a bucket holds one row for each key, sorted
    rows = [tuple(r) for r in spark.read.parquet(f"{t.path}/data/{after[str(one[0])]}").select("store_id", "id", "op").collect()]
    assert rows == sorted(rows) and sum(r[1] == "t5" for r in rows) == 2
    # a new epoch empties the store everywhere, though only one bucket is rewritten
    assert len(t.apply(spark.createDataFrame([(1, "new", 0, 2, 1, 0, 3)], SCHEMA))) == 1
    assert sorted(map(tuple, t.state().collect())) == [(1, "new", 3)]


def test_of_two_writers_one_commits(spark, tmp_path):
    import pytest

    t = BucketedTable(spark, str(tmp_path / "t"), 4)
    t.apply(spark.createDataFrame([(1, "a", 0, 1, 1, 0, 0)], SCHEMA))
    held = t._newest()
    t._commit(held | {"version": 2})
    with pytest.raises(RuntimeError):
        t._commit(held | {"version": 2})
    # a manifest whose writer hasn't finished isn't read, and nobody passes it
    (tmp_path / "t/manifest/000000000003.json").write_text("{\"version\":")
    assert t.version == 2
    with pytest.raises(RuntimeError):
        t.apply(spark.createDataFrame([(1, "b", 0, 1, 2, 0, 0)], SCHEMA))
