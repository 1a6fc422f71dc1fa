"""A versioned key/value table: sorted runs in levels, a commit log, and a write buffer for single puts.

A run is a set of Parquet files, sorted by key. Runs of level 0 are commits, and
the rows of one commit share its sequence number; deeper levels hold disjoint
sorted files whose rows keep theirs. The latest row of a key is the one with the
greatest number. Readers see one version of the log throughout, and of the present
also what is still in this store's buffers; reading writes nothing. Files that no
version of the retained time needs go by ``vacuum``.

Single puts go to the active buffer. A full one is frozen and put in a queue, oldest
written first: at once, or by a thread of its own where the configuration says
``background``; then a put waits only while the queue is full.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.buffer import Buffer
from sediment.model import BufferFull, CommitConflict, DuplicateKeys, NilValue, NothingToWrite, StoreClosed, StoreConfig, entry_schema
from sediment.operators import changelog
from sediment.sources.files import Files
from sediment.sources.log import CommitLog, FileEntry, Snapshot

DATA, STAGING = "data", "_staging"


def _hex(key: str | bytes) -> str:
    return (key.encode() if isinstance(key, str) else bytes(key)).hex()


class Store:
    """Open with ``Store(spark, StoreConfig(path))``; key and value types are fixed by the caller."""

    def __init__(self, spark: SparkSession, config: StoreConfig, key: T.DataType | None = None, value: T.DataType | None = None):
        self.spark, self.config = spark, config
        self.schema = entry_schema(key, value)
        if not isinstance(self.schema["key"].dataType, (T.StringType, T.BinaryType)):
            raise ValueError("keys are strings or binaries")
        self.files = Files(spark, config.path)
        self.files.make(DATA)
        self.log = CommitLog(self.files)
        self._active = Buffer(config.max_mem_bytes)
        self._frozen: list[Buffer] = []
        self._closed = False
        self._changed = threading.Condition(threading.RLock())
        self._writing = threading.Lock()
        self._failure: Exception | None = None
        self._flusher = self._compactor = None
        if config.background:
            self._flusher = InheritableThread(target=self._flush_in_background, daemon=True)
            self._flusher.start()

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # -- buffers -----------------------------------------------------------------

    def frozen_buffers(self) -> list[Buffer]:
        """The buffers that are still to be written, oldest first."""
        with self._changed:
            return list(self._frozen)

    def rotate(self) -> bool:
        """Freeze the active buffer and begin a new one; nothing happens to an empty one."""
        with self._changed:
            if not len(self._active):
                return False
            self._active.freeze()
            self._frozen.append(self._active)
            self._active = Buffer(self.config.max_mem_bytes)
            self._changed.notify_all()
            return True

    def _set(self, key, value) -> None:
        with self._changed:
            self._raise_if_closed()
            try:
                self._active.set(key, value)
            except BufferFull:
                self._rotate_full()
                # an entry beyond the limit is a run of its own
                self._active.set(key, value, alone=True)
            if self._active.limit and self._active.size > self._active.limit:
                self._rotate_full()

    def _rotate_full(self) -> None:
        self.rotate()
        if self._flusher is None:
            self._write_frozen()
        while self._flusher is not None and len(self._frozen) >= self.config.max_frozen:
            self._changed.wait()
            self._raise_if_closed()

    def _raise_if_closed(self) -> None:
        if self._failure is not None:
            failure, self._failure = self._failure, None
            raise failure
        if self._closed:
            raise StoreClosed

    def _write_frozen(self) -> None:
        """Write the frozen buffers, oldest first. Each leaves the queue once its commit is made, so a reader always finds its rows."""
        with self._writing:
            while waiting := self.frozen_buffers():
                rows = [(k, v, v is None, 0) for k, v in waiting[0].items()]
                self._append(self._write(self.spark.createDataFrame(rows, self.schema), 1, len(rows)), None)
                with self._changed:
                    self._frozen = [b for b in self._frozen if b is not waiting[0]]
                    self._changed.notify_all()

    def _flush_in_background(self) -> None:
        while True:
            with self._changed:
                while not self._frozen and not self._closed:
                    self._changed.wait()
                if not self._frozen:
                    return
            try:
                self._write_frozen()
            except Exception as e:  # noqa: BLE001  the next write or close raises it; the buffers stay
                with self._changed:
                    self._failure = e
                    self._changed.notify_all()
                time.sleep(1)

    # -- writes ------------------------------------------------------------------

    def put(self, key, value) -> None:
        if value is None:
            raise StoreClosed if self._closed else NilValue
        self._set(key, value)

    def delete(self, key) -> None:
        """Also for keys that aren't there: a deletion is a row like others."""
        self._set(key, None)

    def put_df(self, df: DataFrame, *, order: str | Column | None = None, batch: tuple[str, int] | None = None) -> Snapshot:
        """Upsert (key, value, [tombstone]) in one commit.

        Without ``order`` a key may stand in one row only. With ``batch`` (name,
        number) a commit that was made already isn't made again.

        ``df`` is evaluated once, to a staged table whose rows are checked as they are
        written; its size says how many sorted files the commit has.
        """
        if self._closed:
            raise StoreClosed
        if batch and self.log.snapshot().batches.get(batch[0], -1) >= batch[1]:
            return self.log.snapshot()
        self.flush()
        gone = F.col("tombstone") if "tombstone" in df.columns else F.lit(False)
        kind = {f.name: f.dataType for f in self.schema}
        of_order = [(F.col(order) if isinstance(order, str) else order).alias("_order")] if order is not None else []
        rows = df.select(F.col("key").cast(kind["key"]).alias("key"), F.col("value").cast(kind["value"]).alias("value"), gone.alias("tombstone"), *of_order)
        latest = F.max_by(F.struct("value", "tombstone"), "_order") if of_order else F.first(F.struct("value", "tombstone"))
        latest = rows.groupBy("key").agg(latest.alias("_row"), F.count(F.lit(1)).alias("_n")).select("key", "_row.*", "_n")
        seen = Observation()
        nil = F.expr("key IS NULL OR (value IS NULL AND NOT tombstone)")
        staged = f"{STAGING}/{uuid.uuid4().hex}"
        try:
            latest.observe(seen, F.count(F.lit(1)).alias("rows"), F.max("_n").alias("most"), F.count_if(nil).alias("nil")).drop("_n").write.option("compression", "zstd").parquet(self.files.uri(staged))
            if not of_order and (seen.get["most"] or 0) > 1:
                raise DuplicateKeys("give a column that orders the rows of a key")
            if seen.get["nil"]:
                raise NilValue
            size = sum(n for _, n in self.files.list(staged))
            whole = self.spark.read.schema(self.schema).parquet(self.files.uri(staged)).withColumn("seq", F.lit(0).cast("long"))
            return self._append(self._write(whole, -(-size // self.config.file_bytes), seen.get["rows"]), batch)
        finally:
            self.files.delete(staged)

    def delete_df(self, keys: DataFrame) -> Snapshot:
        value = F.lit(None).cast(self.schema["value"].dataType)
        return self.put_df(keys.select("key").distinct().withColumns({"value": value, "tombstone": F.lit(True)}))

    def delete_where(self, condition: Column | str) -> Snapshot:
        """Delete the keys whose live row matches."""
        return self.delete_df(self.view().where(condition).select("key"))

    def _append(self, written: list[dict], batch: tuple[str, int] | None) -> Snapshot:
        def edit(now: Snapshot) -> dict | None:
            if batch and now.batches.get(batch[0], -1) >= batch[1]:
                return None
            return {"added": [FileEntry(**f, level=0, seq_num=now.next_seq) for f in written], "batch": list(batch) if batch else None}

        return self.log.commit(edit) if written or batch else self.log.snapshot()

    def flush(self) -> Snapshot:
        """Write all buffers."""
        self.rotate()
        self._write_frozen()
        return self.log.snapshot()

    def _write(self, rows: DataFrame, parts: int, count: int) -> list[dict]:
        """Sorted files with disjoint key ranges, and what the log says of each. ``count`` is how many rows there are at most."""
        folder = f"{DATA}/{uuid.uuid4().hex}"
        out = rows.select(*(F.col(c) for c in self.schema.names)).repartitionByRange(max(1, parts), "key").sortWithinPartitions("key")
        writer = out.write.option("compression", "zstd").option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(self.config.bloom_fpr))
        # a filter is as large as the keys of a file need
        writer.option("parquet.bloom.filter.expected.ndv#key", str(max(1, -(-count // max(1, parts))))).parquet(self.files.uri(folder))
        sizes = {name: size for name, size in self.files.list(folder) if name.endswith(".parquet")}
        # one row for each file, from the footers' columns
        stats = self._read_files([f"{folder}/{n}" for n in sizes]).groupBy(F.input_file_name().alias("f")).agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count(F.lit(1)).alias("n")).collect() if sizes else []
        return [{"path": f"{folder}/{(name := s.f.rsplit('/', 1)[1])}", "min_key": _hex(s.a), "max_key": _hex(s.b), "file_size": sizes[name], "rows": s.n} for s in stats]

    # -- reads -------------------------------------------------------------------

    def _read_files(self, paths: Iterable[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[self.files.uri(p) for p in paths])

    def _rows(self, files: list[FileEntry]) -> DataFrame:
        """Rows of these files; those of level 0 get their commit's number."""
        parts, deeper = [], [f.path for f in files if f.level]
        by_seq: dict[int, list[str]] = {}
        for f in files:
            if not f.level:
                by_seq.setdefault(f.seq_num, []).append(f.path)
        for seq, paths in sorted(by_seq.items()):
            parts.append(self._read_files(paths).withColumn("seq", F.lit(seq).cast("long")))
        if deeper:
            parts.append(self._read_files(deeper))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)

    def changes(self, version: int | None = None, low=None, high=None) -> DataFrame:
        """All rows that a version holds, deletions included, of the present with what is in the buffers.

        Files beyond [low, high] aren't opened.
        """
        # buffers first: what is committed meanwhile is then seen twice, not missed
        buffers = [*self.frozen_buffers(), self._active] if version is None else []
        now = self.log.snapshot(version)
        files = list(now.files.values())
        if low is not None:
            files = [f for f in files if f.max_key >= _hex(low)]
        if high is not None:
            files = [f for f in files if f.min_key <= _hex(high)]
        rows = self._rows(files)
        held = [(k, v, v is None, now.next_seq + i) for i, b in enumerate(buffers) for k, v in b.items()]
        if held:
            rows = rows.unionByName(self.spark.createDataFrame(held, self.schema))
        if low is not None:
            rows = rows.where(F.col("key") >= F.lit(low))
        if high is not None:
            rows = rows.where(F.col("key") <= F.lit(high))
        return rows

    def level_rows(self, level: int, version: int | None = None) -> DataFrame:
        """All rows of one level's files, deletions included."""
        return self._rows(self.log.snapshot(version).level(level))

    def view(self, version: int | None = None, low=None, high=None) -> DataFrame:
        """(key, value, seq): the live rows."""
        return changelog.live(self.changes(version, low, high), ["key"], ["seq"])

    def scan(self, low=None, high=None, version: int | None = None) -> DataFrame:
        """Live rows with low <= key <= high, in order of key."""
        return self.view(version, low, high).orderBy("key")

    def prefix(self, start: str | bytes, version: int | None = None) -> DataFrame:
        return self.view(version, low=start).where(F.col("key").startswith(F.lit(start))).orderBy("key")

    def get(self, key, version: int | None = None):
        """(value, True), or (None, False). Also after ``close``."""
        if version is None:
            for buffer in (self._active, *reversed(self.frozen_buffers())):
                if key in buffer:
                    value = buffer.get(key)
                    return (value, True) if value is not None else (None, False)
        found = changelog.latest_per_key(self.changes(version, key, key), ["key"], ["seq"]).collect()
        if not found or found[0].tombstone:
            return None, False
        value = found[0].value
        return bytes(value) if isinstance(value, bytearray) else value, True

    def multi_get(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """Live rows of the keys in ``keys`` (key). Spark broadcasts them if it knows that they are few."""
        return self.view(version).join(keys.select("key").distinct(), "key", "left_semi")

    # -- maintenance --------------------------------------------------------------

    def level_sizes(self, now: Snapshot | None = None) -> dict[int, int]:
        sizes: dict[int, int] = {}
        for f in (now or self.log.snapshot()).files.values():
            sizes[f.level] = sizes.get(f.level, 0) + f.file_size
        return sizes

    def due(self, now: Snapshot | None = None) -> int:
        """The level to compact, or -1."""
        now, c = now or self.log.snapshot(), self.config.compaction
        if len({f.seq_num for f in now.level(0)}) >= c.l0_threshold:
            return 0
        sizes = self.level_sizes(now)
        return next((n for n in range(1, c.max_levels - 1) if sizes.get(n, 0) > c.l1_max_bytes * c.multiplier ** (n - 1)), -1)

    def _picked(self, now: Snapshot, level: int) -> list[FileEntry]:
        """What a compaction of ``level`` takes: all files of level 0, else its oldest files, as many as it is too large by, one at least."""
        own, c = now.level(level), self.config.compaction
        if level == 0:
            return own
        excess = sum(f.file_size for f in own) - c.l1_max_bytes * c.multiplier ** (level - 1)
        taken: list[FileEntry] = []
        for f in sorted(own, key=lambda f: (f.seq_num, f.path)):
            if taken and excess <= 0:
                break
            taken.append(f)
            excess -= f.file_size
        return taken

    def compact_level(self, level: int) -> Snapshot:
        """Merge files of a level into the next, in one step however many they are."""
        now, c = self.log.snapshot(), self.config.compaction
        own = self._picked(now, level)
        if not own:
            raise NothingToWrite(f"level {level} has no files")
        spans = sorted((f.min_key, f.max_key) for f in own)
        low, high = spans[0][0], max(b for _, b in spans)
        taken = own + [f for f in now.level(level + 1) if f.min_key <= high and f.max_key >= low]
        # a deletion goes once nothing older can be below it
        bottom = not any(f.level > level + 1 for f in now.files.values())
        kept = changelog.compacted(self._rows(taken), ["key"], ["seq"], drop_tombstones=bottom)
        total = sum(f.file_size for f in taken)
        written = self._write(kept, -(-total // c.max_output_bytes) if c.max_output_bytes else 1, sum(f.rows for f in taken))
        return self.log.commit(lambda n: {"added": [FileEntry(**f, level=level + 1, seq_num=n.next_seq) for f in written], "removed": [f.path for f in taken]})

    def compact(self) -> int:
        """Compact until no level is due; the number of steps."""
        steps = 0
        while (level := self.due()) >= 0:
            self.compact_level(level)
            steps += 1
        return steps

    def start_compaction(self, every: float = 0.1) -> None:
        """Compact what is due in a thread of its own, every so many seconds, until ``stop_compaction`` or ``close``."""
        if self._compactor is not None:
            return
        stop = threading.Event()

        def run() -> None:
            while not stop.wait(every):
                try:
                    self.compact()
                except CommitConflict:  # another compaction was first: this round ends
                    continue

        self._compactor = (InheritableThread(target=run, daemon=True), stop)
        self._compactor[0].start()

    def stop_compaction(self) -> None:
        """Wait for the round that is being made, and make no other."""
        if self._compactor is not None:
            thread, stop = self._compactor
            stop.set()
            thread.join()
            self._compactor = None

    def vacuum(self, retain_hours: float = 7 * 24) -> list[str]:
        """Delete data that no version of the last ``retain_hours`` needs, what failed writers left included.

        Folders that changed in that time stay whatever the log says of them, so a
        writer that hasn't committed yet keeps its files if it needs less time, and
        so does a reader of a version of that time.
        """
        until = time.time() * 1000 - retain_hours * 3_600_000
        needed = set(self.log.snapshot().files)
        for edit in self.log.history():
            if edit["time"] < until:
                break
            needed.update(edit["removed"])
        gone = []
        for root in (DATA, STAGING):
            for folder, _, changed in self.files.entries(root):
                path = f"{root}/{folder}"
                inside = self.files.entries(path)
                if max([changed, *(t for *_, t in inside)]) <= until and not needed.intersection(f"{path}/{n}" for n, *_ in inside):
                    self.files.delete(path)
                    gone.append(path)
        return gone

    def close(self) -> None:
        """Flush and refuse further writes; closing again does nothing."""
        self.stop_compaction()
        with self._changed:
            closed, self._closed = self._closed, True
            self._changed.notify_all()
        if not closed:
            if self._flusher is not None:
                self._flusher.join()
                self._flusher = None
            self.flush()
