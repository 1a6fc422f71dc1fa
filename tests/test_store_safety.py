"""Writers and readers beside each other, buffers, retention, checkpoints."""

import os
import subprocess
import sys
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from sediment.buffer import Buffer
from sediment.model import LARGE, BufferFrozen, BufferFull, CommitConflict, CompactionConfig, StoreConfig
from sediment.sources import log as log_module
from sediment.sources.files import Files
from sediment.sources.log import CommitLog, FileEntry
from sediment.store import Store


def rows(spark, n, value="v", low=0):
    return spark.range(low, low + n).select(F.format_string("k%06d", "id").alias("key"), F.lit(value).cast("binary").alias("value"))


def count(store):
    return store.view().count()


def test_defaults():
    c = CompactionConfig()
    assert (c.l0_threshold, c.multiplier, c.l1_max_bytes, c.max_output_bytes, c.max_levels) == (4, 10, 10 << 20, 2 << 20, 7)
    assert StoreConfig("/x").max_mem_bytes == 4 << 20 and LARGE.max_output_bytes == 256 << 20
    for bad in (dict(path=""), dict(path="x", max_mem_bytes=-1), dict(path="x", file_bytes=0)):
        with pytest.raises(ValueError):
            StoreConfig(**bad)


def test_a_name_is_published_once(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    files.make("f")

    def attempt(name, who):
        try:
            files.publish(f"f/{name}", f"{who}" * 500)
        except CommitConflict:
            return None
        return who

    with ThreadPoolExecutor(8) as pool:
        for name in range(40):
            won = [w for w in pool.map(lambda w: attempt(name, w), range(8)) if w is not None]
            assert len(won) == 1 and files.read(f"f/{name}") == f"{won[0]}" * 500
    assert [n for n in os.listdir(tmp_path / "f") if n.endswith(".tmp")] == []


def test_no_commit_of_eight_writers_is_lost(spark, tmp_path):
    entry = lambda w, i: FileEntry(f"{w}-{i}", 0, "", "", 1, 0)
    logs = [CommitLog(Files(spark, str(tmp_path))) for _ in range(8)]

    def write(w):
        for i in range(10):
            logs[w].commit(lambda now: {"added": [entry(w, i)]})

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(write, range(8)))
    now = CommitLog(Files(spark, str(tmp_path))).snapshot()
    assert now.version == 80 and set(now.files) == {f"{w}-{i}" for w in range(8) for i in range(10)}


PUBLISHER = """
import os, sys
folder, who = sys.argv[1:]
for v in range(30):
    own = os.path.join(folder, f".{who}-{v}")
    open(own, "w").write(who)
    try:
        os.link(own, os.path.join(folder, f"{v:020d}.json"))
        print(v)
    except FileExistsError:
        pass
"""


def test_processes_share_the_way_of_publishing(spark, tmp_path):
    """Another process that publishes by links to the same names, at the same time: one winner for each name."""
    files = Files(spark, str(tmp_path))
    files.make("_log")
    other = subprocess.Popen([sys.executable, "-c", PUBLISHER, str(tmp_path / "_log"), "other"], stdout=subprocess.PIPE, text=True)
    mine = []
    for v in range(30):
        try:
            files.publish(CommitLog.name(v), "mine")
            mine.append(v)
        except CommitConflict:
            continue
    theirs = [int(x) for x in other.communicate(timeout=60)[0].split()]
    assert sorted(mine + theirs) == list(range(30))
    assert all(files.read(CommitLog.name(v)) == ("mine" if v in mine else "other") for v in range(30))


def test_checkpoints_stand_for_the_edits_before_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log_module, "CHECKPOINT", 4)
    files = Files(spark, str(tmp_path))
    log = CommitLog(files)
    for i in range(10):
        log.commit(lambda now: {"added": [FileEntry(f"f{i}", 0, "", "", 1, now.next_seq)], "removed": [f"f{i - 3}"] if i >= 3 else [], "batch": ["b", i]})
    want = log.snapshot()
    for v in range(1, 9):  # what a checkpoint covers isn't needed to open the latest version
        os.unlink(tmp_path / CommitLog.name(v))
    again = CommitLog(files)
    assert again.snapshot() == want and set(want.files) == {"f7", "f8", "f9"} and want.batches == {"b": 9}
    log.commit(lambda now: {"added": [FileEntry("later", 0, "", "", 1, now.next_seq)]})
    assert "later" in again.snapshot().files


def test_old_versions_are_read_from_checkpoints_too(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log_module, "CHECKPOINT", 2)
    log = CommitLog(Files(spark, str(tmp_path)))
    for i in range(5):
        log.commit(lambda now: {"added": [FileEntry(f"f{i}", 0, "", "", 1, now.next_seq)]})
    assert [sorted(log.snapshot(v).files) for v in range(6)] == [[f"f{i}" for i in range(v)] for v in range(6)]
    with pytest.raises(ValueError):
        log.snapshot(6)


def test_vacuum_leaves_readers_and_uncommitted_writers_alone(spark, tmp_path):
    s = Store(spark, StoreConfig(str(tmp_path), compaction=CompactionConfig(l0_threshold=1)))
    s.put_df(rows(spark, 100, "old"))
    reader = s.view()
    uncommitted = s._write(rows(spark, 5, "new").withColumns({"tombstone": F.lit(False), "seq": F.lit(0).cast("long")}), 1, 5)
    s.put_df(rows(spark, 100, "new"))
    s.compact()
    assert s.vacuum() == []
    assert {bytes(r.value) for r in reader.collect()} == {b"old"}
    s._append(uncommitted, None)
    assert count(s) == 100
    time.sleep(0.05)
    s.compact()
    assert s.vacuum(retain_hours=0) and count(s) == 100


def test_bulk_writes_are_split_by_their_size_and_evaluated_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    s = Store(spark, StoreConfig(str(tmp_path), file_bytes=50_000))
    wide = rows(spark, 20_000).withColumn("value", F.sha2("key", 512).cast("binary")).mapInArrow(counted, "key string, value binary")
    made = s.put_df(wide)
    assert seen.value == 20_000
    files = made.level(0)
    assert len(files) > 4 and made.version == 1 and sum(f.rows for f in files) == 20_000
    files = sorted(files, key=lambda f: f.min_key)
    assert all(a.max_key < b.min_key for a, b in zip(files, files[1:])) and count(s) == 20_000
    assert os.listdir(tmp_path / "_staging") == [] and s.due() == -1


def test_reads_see_the_buffers_and_write_nothing(spark, tmp_path):
    s = Store(spark, StoreConfig(str(tmp_path)))
    s.put_df(rows(spark, 3))
    s.put("k000001", b"new")
    s.delete("k000002")
    s.put("z", b"1")
    for _ in range(2):
        assert {r.key: bytes(r.value) for r in s.view().collect()} == {"k000000": b"v", "k000001": b"new", "z": b"1"}
    assert [r.key for r in s.scan("k000001", "y").collect()] == ["k000001"]
    assert s.log.snapshot().version == 1 and s.view(version=1).count() == 3
    s.rotate()
    s.put("z", b"2")
    assert not s._active.frozen and len(s.frozen_buffers()) == 1
    assert s.get("z") == (b"2", True) and s.get("k000002") == (None, False) and count(s) == 3
    s.flush()
    assert s.frozen_buffers() == [] and not s.rotate() and s.get("z") == (b"2", True) and count(s) == 3


def test_buffer_limits():
    b = Buffer(4)
    b.set("a", b"1")
    b.set("b", b"2")
    assert b.full and b.size == 4 and len(b) == 2
    b.set("a", b"x")
    b.set("b", b"")
    with pytest.raises(BufferFull):
        b.set("a", b"toolong")
    with pytest.raises(BufferFull):
        b.set("c", b"3")
    assert b.items() == [("a", b"x"), ("b", b"")]
    b.freeze()
    with pytest.raises(BufferFrozen):
        b.set("a", b"y")
    with pytest.raises(BufferFull):
        Buffer(4).set("abc", b"de")
    Buffer(4).set("abc", b"de", alone=True)


def test_background_writes_and_compaction(spark, tmp_path):
    s = Store(spark, StoreConfig(str(tmp_path), max_mem_bytes=40, background=True, max_frozen=3, compaction=CompactionConfig(l0_threshold=3)))
    s.start_compaction(0.05)
    threads = [threading.Thread(target=lambda w=w: [s.put(f"w{w}-{i}", b"1234") for i in range(12)]) for w in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert s.get("w3-11") == (b"1234", True)
    s.close()
    again = Store(spark, StoreConfig(str(tmp_path), compaction=CompactionConfig(l0_threshold=3)))
    assert count(again) == 48 and s.frozen_buffers() == []
    again.compact()
    assert again.due() == -1 and count(again) == 48


def test_a_failure_in_the_background_is_raised_and_loses_nothing(spark, tmp_path, monkeypatch):
    s = Store(spark, StoreConfig(str(tmp_path), max_mem_bytes=10, background=True))
    whole = s._write
    monkeypatch.setattr(s, "_write", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    s.put("aaaa", b"1111")
    s.put("bbbb", b"2222")
    until = time.time() + 20
    while s._failure is None and time.time() < until:
        time.sleep(0.05)
    with pytest.raises(OSError):
        s.put("cccc", b"3333")
    monkeypatch.setattr(s, "_write", whole)
    s.put("cccc", b"3333")
    s.close()
    assert count(Store(spark, StoreConfig(str(tmp_path)))) == 3


def test_a_small_run_has_a_small_filter(spark, tmp_path):
    s = Store(spark, StoreConfig(str(tmp_path)))
    s.put("a", b"1")
    (f,) = s.flush().files.values()
    assert f.file_size < 3000


def test_a_level_is_brought_under_its_limit_in_one_step(spark, tmp_path):
    config = CompactionConfig(l0_threshold=1, l1_max_bytes=30_000, multiplier=4, max_output_bytes=40_000)
    s = Store(spark, StoreConfig(str(tmp_path), compaction=config))
    s.put_df(rows(spark, 4000).withColumn("value", F.sha2("key", 256).cast("binary")))
    steps = s.compact()
    assert steps <= config.max_levels and s.due() == -1 and count(s) == 4000
