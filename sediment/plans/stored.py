"""Queries that go through a real store, its log, or ``.sst`` files, and the SQL that must agree.

Each query makes a store of its own in the shared folder; it is deleted when the
application ends, since what a query returns still reads it.
"""

from __future__ import annotations

import atexit
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.model import CompactionConfig, StoreConfig
from sediment.operators import changelog
from sediment.plans.catalog import CTES, events, live, query, runs, table
from sediment.sources import sst
from sediment.store import Store
from sediment.streaming import sink


def _folder(spark: SparkSession, kind: str) -> str:
    path = f"{sink.shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    atexit.register(sink._delete, spark, path)
    return path


def _opened(spark: SparkSession, path: str | None = None, **settings) -> Store:
    compaction = CompactionConfig(**{k: settings.pop(k) for k in list(settings) if k in CompactionConfig.__dataclass_fields__})
    return Store(spark, StoreConfig(path or _folder(spark, "store"), compaction=compaction, **settings), value=T.StringType())


def _changes(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("k").alias("key"), F.col("v").alias("value"), F.col("del").alias("tombstone"), "seq")


def _filled(spark: SparkSession, sf_dir: str, *, compact: bool = False, **settings) -> Store:
    """The changelog as three commits: the rows of level 2, then of level 1, then of level 0."""
    store, all_rows = _opened(spark, **settings), runs(spark, sf_dir)
    for level in (2, 1, 0):
        store.put_df(_changes(all_rows.where(F.col("level") == level)), order="seq")
        if compact:
            store.compact()
    return store


def _kv(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").alias("k"), F.col("value").alias("v"))


@query("SELECT k, v FROM live")
def store_live(spark, sf_dir):
    return _kv(_filled(spark, sf_dir).view())


@query("SELECT k, v FROM live")
def store_compacted(spark, sf_dir):
    """Levels small enough that every commit makes several of them due."""
    return _kv(_filled(spark, sf_dir, compact=True, l0_threshold=1, l1_max_bytes=4000, multiplier=3, max_output_bytes=4000).view())


@query("SELECT k, false AS del FROM live")
def store_bottom(spark, sf_dir):
    """All rows of the files once everything is in the deepest level: no deletions, no row that another one hides."""
    return _filled(spark, sf_dir, compact=True, l0_threshold=1).changes().select(F.col("key").alias("k"), F.col("tombstone").alias("del"))


@query("SELECT k, del FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM runs WHERE level < 2) WHERE n = 1")
def store_keeps_tombstones(spark, sf_dir):
    """The newer rows in level 1, above the oldest ones in level 2."""
    store, all_rows = _opened(spark), runs(spark, sf_dir)
    for level in (2, 1, 0):
        store.put_df(_changes(all_rows.where(F.col("level") == level)), order="seq")
        if level == 2:
            store.compact_level(0)
            while store.log.snapshot().level(1):
                store.compact_level(1)
                if store.log.snapshot().level(2):
                    break
    store.compact_level(0)
    return store.level_rows(1).select(F.col("key").alias("k"), F.col("tombstone").alias("del"))


@query("SELECT k, v FROM live WHERE v NOT LIKE 'click%'")
def store_reopened(spark, sf_dir):
    """Closed, opened, deletions by query, closed, opened."""
    store = _filled(spark, sf_dir)
    store.close()
    path = store.config.path
    with _opened(spark, path) as again:
        again.delete_where(F.col("value").startswith("click"))
    return _kv(_opened(spark, path).view())


@query("SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM runs WHERE level = 2) WHERE n = 1 AND NOT del")
def store_snapshot(spark, sf_dir):
    """The first version, read after all of it has been compacted."""
    store = _filled(spark, sf_dir)
    store.compact_level(0)
    return _kv(store.view(version=1))


@query("SELECT 'u' || lpad(i::VARCHAR, 6, '0') AS k, live.k IS NOT NULL AS found, live.v FROM range(1, 13) t(i) LEFT JOIN live ON live.k = 'u' || lpad(i::VARCHAR, 6, '0')")
def store_get(spark, sf_dir):
    """Single lookups, one after the other."""
    store = _filled(spark, sf_dir)
    found = [(k, *reversed(store.get(k))) for k in (f"u{i:06d}" for i in range(1, 13))]
    return spark.createDataFrame(found, "k string, found boolean, v string")


_ASKED = "(SELECT 'u' || lpad(c_custkey::VARCHAR, 6, '0') AS k FROM customer WHERE c_nationkey = 7)"


@query(f"SELECT k, v FROM live WHERE k IN {_ASKED}")
def store_multi_get(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").where("c_nationkey = 7").select(F.concat(F.lit("u"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("key"))
    return _kv(_filled(spark, sf_dir).multi_get(keys))


@query("SELECT k, v FROM live WHERE k BETWEEN 'u000020' AND 'u000060'")
def store_scan(spark, sf_dir):
    return _kv(_filled(spark, sf_dir).scan("u000020", "u000060"))


@query("SELECT k, v FROM live WHERE starts_with(k, 'u00001')")
def store_prefix(spark, sf_dir):
    return _kv(_filled(spark, sf_dir).prefix("u00001"))


@query(f"SELECT k, v FROM live WHERE k NOT IN {_ASKED}")
def store_delete_keys(spark, sf_dir):
    store = _filled(spark, sf_dir)
    store.delete_df(table(spark, sf_dir, "customer").where("c_nationkey = 7").select(F.concat(F.lit("u"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("key")))
    return _kv(store.view())


@query("SELECT k, v FROM live")
def store_vacuumed(spark, sf_dir):
    """What is left once everything that only older versions need has gone."""
    store = _filled(spark, sf_dir, compact=True, l0_threshold=2)
    store.vacuum(retain_hours=0)
    return _kv(store.view())


@query("SELECT k, v FROM live")
def store_retried(spark, sf_dir):
    """Each batch is put twice under its number, as a stream does after a failure; old rows that come again change nothing."""
    store, all_rows = _opened(spark), runs(spark, sf_dir)
    for number, level in enumerate((2, 1, 0)):
        for _ in range(2):
            store.put_df(_changes(all_rows.where(F.col("level") == level)), order="seq", batch=("events", number))
    store.put_df(_changes(all_rows.where("level = 2")), order="seq", batch=("events", 0))
    return _kv(store.view())


@query("SELECT c_name AS k, c_mktsegment AS v FROM customer")
def store_concurrent(spark, sf_dir):
    """Six writers, each with its own share of the keys."""
    path = _folder(spark, "store")
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: _opened(spark, path).put_df(rows.where(F.pmod(F.xxhash64("key"), F.lit(6)) == i)), range(6)))
    return _kv(_opened(spark, path).view())


@query("SELECT n_name AS k, CASE WHEN n_regionkey = 2 THEN 'new' ELSE n_regionkey::VARCHAR END AS v FROM nation WHERE n_regionkey <> 1")
def store_buffered(spark, sf_dir):
    """Single puts, updates and deletions that are still in the buffer when the view is made."""
    store = _opened(spark)
    nations = table(spark, sf_dir, "nation").collect()
    for r in nations:
        store.put(r.n_name, str(r.n_regionkey))
    for r in nations:
        if r.n_regionkey == 1:
            store.delete(r.n_name)
        elif r.n_regionkey == 2:
            store.put(r.n_name, "new")
    return _kv(store.view())


@query("WITH RECURSIVE e AS (SELECT n_name AS k, (octet_length(encode(n_name)) + 1)::BIGINT AS s, row_number() OVER (ORDER BY n_name) AS i FROM nation)"
       ", w AS (SELECT k, s, i, 1::BIGINT AS run, s AS held FROM e WHERE i = 1 UNION ALL"
       " SELECT e.k, e.s, e.i, CASE WHEN w.held + e.s > 40 THEN w.run + 1 ELSE w.run END, CASE WHEN w.held + e.s > 40 THEN e.s ELSE w.held + e.s END FROM w JOIN e ON e.i = w.i + 1)"
       " SELECT run, k FROM w")  # fmt: skip
def store_rotation(spark, sf_dir):
    """Which run each of a series of single puts is written to, with buffers of 40 bytes."""
    store = _opened(spark, max_mem_bytes=40)
    for r in table(spark, sf_dir, "nation").select("n_name").orderBy("n_name").collect():
        store.put(r.n_name, "x")
    store.flush()
    return store.changes().select(F.col("seq").alias("run"), F.col("key").alias("k"))


@query("SELECT 3 - level AS version, count(DISTINCT k) AS rows_added FROM runs GROUP BY level")
def store_log(spark, sf_dir):
    """What each version of the log added."""
    edits = [(e["version"], sum(f["rows"] for f in e["added"])) for e in _filled(spark, sf_dir).log.history()]
    return spark.createDataFrame(edits, "version long, rows_added long")


@query("SELECT 0::INTEGER AS level, min(k) AS min_key, max(k) AS max_key, count(DISTINCT k) AS n FROM runs WHERE level = 0 UNION ALL SELECT 1, min(k), max(k), count(DISTINCT k) FROM runs WHERE level > 0")
def store_levels(spark, sf_dir):
    """Bounds and rows of each level, from the log alone: the first two commits compacted, the third not."""
    store, all_rows = _opened(spark), runs(spark, sf_dir).withColumn("del", F.lit(False)).withColumn("v", F.coalesce("v", F.lit("")))
    for level in (2, 1, 0):
        store.put_df(_changes(all_rows.where(F.col("level") == level)), order="seq")
        if level == 1:
            store.compact_level(0)
    now = store.log.snapshot()
    of = [(n, f) for n in (0, 1) for f in now.level(n)]
    rows = [(n, bytes.fromhex(f.min_key).decode(), bytes.fromhex(f.max_key).decode(), f.rows) for n, f in of]
    each = spark.createDataFrame(rows, "level int, min_key string, max_key string, n long")
    return each.groupBy("level").agg(F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"), F.sum("n").alias("n"))


# -- sorted string tables -------------------------------------------------------


def _sst(spark: SparkSession, sf_dir: str, files: int) -> str:
    """The latest row of each key, deletions included, as so many files."""
    sst.register(spark)
    path = _folder(spark, "sst")
    rows = changelog.latest_per_key(events(spark, sf_dir), ["k"], ["seq"])
    rows = rows.select(F.col("k").cast("binary").alias("key"), F.col("v").cast("binary").alias("value"), F.col("del").alias("tombstone"), F.lit("").alias("file"))
    rows.repartitionByRange(files, "key").sortWithinPartitions("key").write.format("sst").mode("append").save(path)
    return path


@query("SELECT k, v, del FROM latest")
def sst_round_trip(spark, sf_dir):
    return spark.read.format("sst").load(_sst(spark, sf_dir, 4)).select(F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"), F.col("tombstone").alias("del"))


@query("SELECT k, v, del FROM latest WHERE k = 'u000007'")
def sst_search(spark, sf_dir):
    """A pushed lookup, which reads one block of a file at most."""
    found = spark.read.format("sst").load(_sst(spark, sf_dir, 4)).where(F.col("key") == F.lit(b"u000007"))
    return found.select(F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"), F.col("tombstone").alias("del"))


_ENTRIES = "e AS (SELECT k, del, (9 + octet_length(encode(k)) + coalesce(octet_length(encode(v)), 0))::BIGINT AS size, row_number() OVER (ORDER BY k) AS i FROM latest)"
_INDEX = (
    "WITH RECURSIVE" + CTES.strip().removeprefix("WITH") + ", " + _ENTRIES + """
, w AS (SELECT k, size, i, 0::BIGINT AS block, size AS held FROM e WHERE i = 1
  UNION ALL SELECT e.k, e.size, e.i, CASE WHEN w.held >= 4096 THEN w.block + 1 ELSE w.block END, CASE WHEN w.held >= 4096 THEN e.size ELSE w.held + e.size END FROM w JOIN e ON e.i = w.i + 1)
, b AS (SELECT block, min(k) AS first_key, sum(size)::BIGINT AS size FROM w GROUP BY block)
"""
)


def _path_of_one(spark: SparkSession, sf_dir: str) -> str:
    (only,) = sst.files(_sst(spark, sf_dir, 1).removeprefix("file://"))
    return only


@query(_INDEX + "SELECT first_key, (sum(size) OVER (ORDER BY block) - size)::BIGINT AS at, size FROM b")
def sst_index(spark, sf_dir):
    """First key, place and size of each data block, read from a file's index."""
    return spark.createDataFrame([(k.decode(), at, size) for k, at, size in sst.Table(_path_of_one(spark, sf_dir)).index], "first_key string, at long, size long")


@query(_INDEX + """
, n AS (SELECT count(*)::DOUBLE AS n, sum(size)::BIGINT AS data FROM e), m AS (SELECT *, greatest(ceil(-n * ln(0.01::DOUBLE) / (ln(2) * ln(2))), 64) AS m FROM n)
SELECT data AS index_at, (SELECT sum(16 + octet_length(encode(first_key))) FROM b)::BIGINT AS index_size, data + (SELECT sum(16 + octet_length(encode(first_key))) FROM b)::BIGINT AS bloom_at,
  (8 + 8 * ceil(m / 64))::BIGINT AS bloom_size FROM m""")
def sst_footer(spark, sf_dir):
    """What a file's footer says of its index and its bloom filter."""
    t = sst.Table(_path_of_one(spark, sf_dir))
    return spark.createDataFrame([t.footer], "index_at long, index_size long, bloom_at long, bloom_size long")


@query("SELECT k, true AS may_contain FROM latest")
def sst_bloom(spark, sf_dir):
    """Every key of a file passes the bloom filter that the file holds."""
    bloom = sst.Table(_path_of_one(spark, sf_dir)).bloom
    held = bloom.encode()

    @F.udf("boolean")
    def probe(key):
        return sst.Bloom.decode(held).may_contain(bytes(key))

    keys = changelog.latest_per_key(events(spark, sf_dir), ["k"], ["seq"]).select("k")
    return keys.select("k", probe(F.col("k").cast("binary")).alias("may_contain"))


_LE = "printf('%02x%02x%02x%02x', {n} % 256, {n} // 256 % 256, {n} // 65536 % 256, {n} // 16777216 % 256)"


@query("SELECT k, lower(" + _LE.format(n="octet_length(encode(k))") + " || hex(encode(k)) || CASE WHEN del THEN '01' ELSE '00' END || " + _LE.format(n="coalesce(octet_length(encode(v)), 0)") + " || coalesce(hex(encode(v)), '')) AS bytes FROM latest")
def entry_codec(spark, sf_dir):
    """Entries as bytes, encoded in Spark."""
    from sediment.functions import entries

    rows = changelog.latest_per_key(events(spark, sf_dir), ["k"], ["seq"])
    return rows.select("k", F.lower(F.hex(entries.encoded(F.col("k"), F.col("v"), F.col("del")))).alias("bytes"))


@query("SELECT k, seq, v FROM live")
def compact_then_read(spark, sf_dir):
    """What a reader sees once the upper levels have been compacted above the lowest."""
    r = runs(spark, sf_dir).withColumnRenamed("del", "tombstone").select("k", "seq", "tombstone", "v", "level")
    upper = changelog.compacted(r.where("level < 2"), ["k"], ["seq"], drop_tombstones=False)
    return changelog.live(upper.unionByName(r.where("level = 2")).drop("level"), ["k"], ["seq"])
