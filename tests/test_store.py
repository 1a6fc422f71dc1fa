import random

import pytest
from pyspark.sql import functions as F

from sediment.model import CommitConflict, CompactionConfig, DuplicateKeys, NilValue, NothingToWrite, StoreClosed, StoreConfig
from sediment.store import Store
from sediment.streaming import sink


def store(spark, path, **settings):
    compaction = CompactionConfig(**{k: settings.pop(k) for k in list(settings) if k in CompactionConfig.__dataclass_fields__})
    return Store(spark, StoreConfig(str(path), compaction=compaction, **settings))


def batch(spark, rows, schema="key string, value binary, tombstone boolean"):
    return spark.createDataFrame([(k, v, v is None) for k, v in rows.items()], schema)


def contents(s, version=None):
    return {r.key: bytes(r.value) for r in s.view(version).collect()}


def test_put_get_delete_and_reopen(spark, tmp_path):
    with store(spark, tmp_path) as s:
        s.put("a", b"1")
        s.put("b", b"")
        s.delete("nope")
        assert s.get("a") == (b"1", True) and s.get("b") == (b"", True) and s.get("nope") == (None, False)
        s.flush()
        s.delete("a")
        assert s.get("a") == (None, False)
        with pytest.raises(NilValue):
            s.put("c", None)
    s.close()
    assert s.get("b") == (b"", True)
    for write in (lambda: s.put("x", b"y"), lambda: s.delete("x"), lambda: s.put_df(batch(spark, {"x": b"y"}))):
        with pytest.raises(StoreClosed):
            write()
    again = store(spark, tmp_path)
    assert contents(again) == {"b": b""} and again.get("a") == (None, False)


def test_a_long_run_of_operations_agrees_with_a_dict(spark, tmp_path):
    rng = random.Random(7)
    s, want, versions = store(spark, tmp_path, l0_threshold=3, l1_max_bytes=3000, max_output_bytes=1500), {}, {}
    for step in range(4):
        rows = {"".join(rng.choices("abcdefgh", k=2)): rng.choice([None, b"v%d" % rng.randrange(99)]) for _ in range(25)}
        made = s.put_df(batch(spark, rows))
        want |= rows
        live = {k: v for k, v in want.items() if v is not None}
        versions[made.version] = live
        if step % 2:
            s.compact()
            assert s.due() == -1
        if step == 3:
            assert contents(s) == live
    v = min(versions)
    assert contents(s, v) == versions[v]
    for n in range(1, 7):
        f = s.log.snapshot().level(n)
        assert all(a.max_key < b.min_key for a, b in zip(f, f[1:]))
    assert s.vacuum(retain_hours=0)
    assert contents(s) == live


def test_ordered_scans_and_lookups(spark, tmp_path):
    s = store(spark, tmp_path)
    s.put_df(batch(spark, {f"k{i:03d}": b"%d" % i for i in range(50)}))
    s.delete_df(spark.createDataFrame([("k010",)], "key string"))
    assert [r.key for r in s.scan("k008", "k012").collect()] == ["k008", "k009", "k011", "k012"]
    assert [r.key for r in s.prefix("k04").collect()] == [f"k04{i}" for i in range(10)]
    asked = spark.createDataFrame([("k001",), ("k010",), ("none",)], "key string")
    assert [r.key for r in s.multi_get(asked).collect()] == ["k001"]
    s.delete_where("key < 'k040'")
    assert s.view().count() == 10


def test_files_beyond_the_bounds_are_not_read(spark, tmp_path):
    s = store(spark, tmp_path)
    s.put_df(batch(spark, {"a": b"1"}))
    s.put_df(batch(spark, {"z": b"1"}))
    assert len(s.changes(low="y").inputFiles()) == 1


def test_deletions_stay_above_deeper_files_and_go_at_the_bottom(spark, tmp_path):
    s = store(spark, tmp_path, l0_threshold=1)
    s.put_df(batch(spark, {"deep": b"v", "del": b"old"}))
    s.compact_level(0)
    s.compact_level(1)
    s.put_df(batch(spark, {"del": None, "keep": b"val"}))
    s.compact_level(0)
    assert s.changes().where("tombstone").count() == 1 and contents(s) == {"deep": b"v", "keep": b"val"}
    while s.log.snapshot().level(1):
        s.compact_level(1)
    assert s.changes().where("tombstone").count() == 0 and contents(s) == {"deep": b"v", "keep": b"val"}
    with pytest.raises(NothingToWrite):
        s.compact_level(1)


def test_batches_are_checked(spark, tmp_path):
    s = store(spark, tmp_path)
    twice = spark.createDataFrame([("a", b"1", 1), ("a", b"2", 2)], "key string, value binary, n int")
    with pytest.raises(DuplicateKeys):
        s.put_df(twice)
    with pytest.raises(NilValue):
        s.put_df(spark.createDataFrame([("a", None)], "key string, value binary"))
    s.put_df(twice, order="n")
    assert s.get("a") == (b"2", True)


def test_commits_beside_each_other(spark, tmp_path):
    a, b = store(spark, tmp_path), store(spark, tmp_path)
    a.put_df(batch(spark, {"x": b"a"}))
    b.put_df(batch(spark, {"x": b"b"}))
    assert a.get("x") == (b"b", True)
    files = list(a.log.snapshot().files)
    a.compact_level(0)
    with pytest.raises(CommitConflict):
        b.log.commit(lambda _: {"removed": files})


def test_buffer_rotation_and_oversize(spark, tmp_path):
    s = store(spark, tmp_path, max_mem_bytes=4)
    for k in "abc":
        s.put(k, b"1")
    assert len(s.log.snapshot().files) == 1 and s._active.items() == [("c", b"1")]
    s.put("big", b"x" * 100)
    assert not len(s._active) and s.get("big") == (b"x" * 100, True)


def test_stream_upserts_once(spark, tmp_path, sf):
    s = store(spark, tmp_path / "store", l0_threshold=2)
    source = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events*")
    gone = F.col("event_type") == "error"
    rows = source.select(F.col("user_id").cast("string").alias("key"), F.when(~gone, F.col("props").cast("binary")).alias("value"), gone.alias("tombstone"), "event_id")
    sink.upsert(rows, s, "event_id", name="events", checkpoint=str(tmp_path / "c"), availableNow=True).awaitTermination()
    want = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("t")).where("t <> 'error'").count()
    assert s.view().count() == want
    version = s.log.snapshot().version
    s.put_df(batch(spark, {"a": b"1"}), batch=("events", 0))
    assert s.log.snapshot().version == version
