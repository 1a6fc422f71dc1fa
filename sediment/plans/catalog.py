"""The engine's queries over the driver's tables, and the SQL that must agree.

``events`` is the main changelog: key ``u`` and the padded user_id, order event_id,
a deletion where event_type is 'error'. Its rows are also laid out as ten runs of
equal spans of event_id, the oldest four at level 2, the next three at level 1, the
newest three at level 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.functions import entries
from sediment.model import CompactionConfig
from sediment.operators import bloom, changelog, levels, manifest, packing
from sediment.streaming import sink

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

#: Level limits that the synthetic runs exceed in part.
LEVELS = CompactionConfig(l0_threshold=3, multiplier=10, l1_max_bytes=100_000)
BITS, HASHES = 9600, 7


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = (CTES + sql) if not sql.lstrip().upper().startswith("WITH") else sql
        return f

    return register


def _registered() -> None:
    from sediment.plans import stored  # noqa: F401  registers its queries


def queries() -> dict[str, Query]:
    _registered()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _registered()
    return dict(_sql)


CTES = """
WITH ch AS (SELECT 'u' || lpad(user_id::VARCHAR, 6, '0') AS k, event_id AS seq, event_type = 'error' AS del,
  CASE WHEN event_type <> 'error' THEN event_type || ':' || props END AS v FROM events),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM ch) WHERE rn = 1),
live AS (SELECT k, seq, v FROM latest WHERE NOT del),
span AS (SELECT greatest((max(event_id) - min(event_id) + 10) // 10, 1) AS w, min(event_id) AS lo FROM events),
runs AS (SELECT ch.*, (seq - lo) // w AS file, CASE WHEN (seq - lo) // w < 4 THEN 2 WHEN (seq - lo) // w < 7 THEN 1 ELSE 0 END AS level FROM ch, span),
files AS (SELECT printf('sstable_%06d.sst', file + 1) AS path, level::INTEGER AS level, min(k) AS min_key, max(k) AS max_key,
  sum(9 + octet_length(encode(k)) + coalesce(octet_length(encode(v)), 0))::BIGINT AS file_size, file::BIGINT AS seq_num FROM runs GROUP BY file, level)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_changes(rows: DataFrame) -> DataFrame:
    deleted = F.col("event_type") == "error"
    return rows.select(
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("k"), F.col("event_id").alias("seq"), deleted.alias("del"),
        F.when(~deleted, F.concat("event_type", F.lit(":"), "props")).alias("v"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, seq, del, v)"""
    return as_changes(table(spark, sf_dir, "events"))


def latest(spark: SparkSession, sf_dir: str, *, window: bool = False) -> DataFrame:
    return changelog.latest_per_key(events(spark, sf_dir), ["k"], [F.desc("seq")] if window else ["seq"], window=window)


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.live(events(spark, sf_dir), ["k"], ["seq"], "del")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changelog with the run and level of each row; the bounds are one row, sent to every task."""
    span = table(spark, sf_dir, "events").agg(F.min("event_id").alias("lo"), F.greatest(F.floor((F.max("event_id") - F.min("event_id") + 10) / 10), F.lit(1)).alias("w"))
    file = F.floor((F.col("seq") - F.col("lo")) / F.col("w"))
    level = F.when(F.col("file") < 4, 2).when(F.col("file") < 7, 1).otherwise(0)
    return events(spark, sf_dir).crossJoin(F.broadcast(span)).withColumn("file", file).withColumn("level", level).drop("lo", "w")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        runs(spark, sf_dir).groupBy("file", "level")
        .agg(F.min("k").alias("min_key"), F.max("k").alias("max_key"), F.sum(entries.encoded_bytes(F.col("k"), F.col("v"))).cast("long").alias("file_size"))
        .select(entries.file_name(F.col("file") + 1).alias("path"), "level", "min_key", "max_key", "file_size", F.col("file").cast("long").alias("seq_num"))
    )


# -- reads ---------------------------------------------------------------------


@query("SELECT k, seq, v FROM live")
def live_events(spark, sf_dir):
    return live(spark, sf_dir)


@query("SELECT k, seq, v FROM live")
def live_events_window(spark, sf_dir):
    return latest(spark, sf_dir, window=True).where(~F.col("del")).drop("del")


@query("""
WITH o AS (SELECT o_custkey AS k, o_orderkey AS seq, o_orderstatus = 'F' AS del, o_orderpriority AS v FROM orders),
l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM o) SELECT k, seq, v FROM l WHERE rn = 1 AND NOT del""")
def live_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") == "F").alias("del"), F.col("o_orderpriority").alias("v"))
    return changelog.live(rows, ["k"], ["seq"], "del")


@query("SELECT k, seq, v FROM live WHERE k = 'u000007'")
def point_get(spark, sf_dir):
    return live(spark, sf_dir).where(F.col("k") == "u000007")


@query("SELECT q.k, live.k IS NOT NULL AS found, live.v FROM (VALUES ('u000007'), ('nobody')) q(k) LEFT JOIN live ON live.k = q.k")
def get_found_flag(spark, sf_dir):
    asked = spark.createDataFrame([("u000007",), ("nobody",)], "k string")
    return asked.join(live(spark, sf_dir), "k", "left").select("k", F.col("seq").isNotNull().alias("found"), "v")


@query("SELECT k, false AS found FROM latest WHERE del")
def get_deleted(spark, sf_dir):
    """Lookups of deleted keys stop at the deletion: none is found."""
    gone = latest(spark, sf_dir).where("del").select("k")
    return gone.join(live(spark, sf_dir).select("k", F.lit(True).alias("hit")), "k", "left").select("k", F.coalesce("hit", F.lit(False)).alias("found"))


def _asked(spark, sf_dir):
    """The keys of customers of one nation: a table of its own, whose size isn't known before."""
    c = table(spark, sf_dir, "customer").where("c_nationkey = 7")
    return c.select(F.concat(F.lit("u"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("k"))


_ASKED = "(SELECT 'u' || lpad(c_custkey::VARCHAR, 6, '0') AS k FROM customer WHERE c_nationkey = 7)"


@query(f"SELECT k, seq, v FROM live WHERE k IN {_ASKED}")
def multi_get(spark, sf_dir):
    return live(spark, sf_dir).join(_asked(spark, sf_dir), "k", "left_semi")


@query(f"SELECT k FROM {_ASKED} q WHERE k NOT IN (SELECT k FROM live)")
def anti_get(spark, sf_dir):
    return _asked(spark, sf_dir).join(live(spark, sf_dir), "k", "left_anti")


@query("SELECT k, seq, v FROM live ORDER BY k")
def scan_all(spark, sf_dir):
    return live(spark, sf_dir).orderBy("k")


@query("SELECT k, seq, v FROM live WHERE k >= 'u000020' AND k < 'u000060'")
def scan_range(spark, sf_dir):
    return live(spark, sf_dir).where((F.col("k") >= "u000020") & (F.col("k") < "u000060"))


@query("SELECT k, seq, v FROM live WHERE starts_with(k, 'u00001')")
def scan_prefix(spark, sf_dir):
    return live(spark, sf_dir).where(F.col("k").startswith("u00001"))


@query("SELECT k, seq, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM ch WHERE seq <= 500) WHERE n = 1 AND NOT del")
def snapshot_get(spark, sf_dir):
    """The live view as of a past sequence number."""
    return changelog.live(events(spark, sf_dir).where("seq <= 500"), ["k"], ["seq"], "del")


# -- writes, merge, compaction ----------------------------------------------------


@query("SELECT k, seq, del FROM latest UNION ALL SELECT 'x' || lpad(c_custkey::VARCHAR, 6, '0'), -1, true FROM customer WHERE c_nationkey = 3")
def delete_blind(spark, sf_dir):
    """Deletions of keys that were never written are rows like others."""
    unseen = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.concat(F.lit("x"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("k"), F.lit(-1).cast("long").alias("seq"), F.lit(True).alias("del"))
    return changelog.latest_per_key(events(spark, sf_dir).select("k", "seq", "del").unionByName(unseen), ["k"], ["seq"])


@query("SELECT k, seq, v FROM live WHERE v NOT LIKE 'click%'")
def delete_where(spark, sf_dir):
    """Delete by query: the keys whose live value matches get newer deletions."""
    rows = events(spark, sf_dir)
    matched = live(spark, sf_dir).where(F.col("v").startswith("click")).select("k", F.lit((1 << 62)).cast("long").alias("seq"), F.lit(True).alias("del"), F.lit(None).cast("string").alias("v"))
    return changelog.live(rows.unionByName(matched), ["k"], ["seq"], "del")


@query("SELECT k, seq FROM latest WHERE del")
def tombstones(spark, sf_dir):
    return latest(spark, sf_dir).where("del").select("k", "seq")


@query("SELECT k, count(*) - 1 AS superseded FROM ch GROUP BY k")
def superseded(spark, sf_dir):
    return changelog.superseded(events(spark, sf_dir), ["k"])


@query("SELECT k, seq, del, v FROM latest")
def merge_priority(spark, sf_dir):
    """Recency by place: lower levels first, within a level newer files, within a file newer rows."""
    order = [F.asc("level"), F.desc("file"), F.desc("seq")]
    return changelog.latest_per_key(runs(spark, sf_dir), ["k"], order, window=True).select("k", "seq", "del", "v")


@query("""
, per AS (SELECT k, level, max(seq) AS seq FROM runs GROUP BY k, level), top AS (SELECT k, min(level) AS level FROM per GROUP BY k)
SELECT r.k, r.seq, r.del, r.v FROM per JOIN top USING (k, level) JOIN runs r ON r.k = per.k AND r.seq = per.seq""")
def merge_sources(spark, sf_dir):
    """N-way merge: each level is a source with unique keys, the newest first."""
    r = runs(spark, sf_dir)
    sources = [changelog.latest_per_key(r.where(F.col("level") == n).select("k", "seq", "del", "v"), ["k"], ["seq"]) for n in (0, 1, 2)]
    return changelog.merge(sources, ["k"])


@query("SELECT k, seq, del, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM runs WHERE level < 2) WHERE n = 1")
def compact_keep_tombstones(spark, sf_dir):
    """Level 0 into level 1: level 2 has files, so deletions stay."""
    return changelog.compacted(runs(spark, sf_dir).where("level < 2").withColumnRenamed("del", "tombstone"), ["k"], ["seq"], drop_tombstones=False).select("k", "seq", F.col("tombstone").alias("del"), "v")


@query("SELECT k, seq, del, v FROM latest WHERE NOT del")
def compact_bottom(spark, sf_dir):
    return changelog.compacted(runs(spark, sf_dir).withColumnRenamed("del", "tombstone"), ["k"], ["seq"], drop_tombstones=True).select("k", "seq", F.col("tombstone").alias("del"), "v")


@query("SELECT 0::BIGINT AS differences")
def compact_invariant(spark, sf_dir):
    """Compacting the upper levels changes nothing that a reader sees."""
    r = runs(spark, sf_dir).withColumnRenamed("del", "tombstone").select("k", "seq", "tombstone", "v", "level")
    upper = changelog.compacted(r.where("level < 2"), ["k"], ["seq"], drop_tombstones=False)
    after = changelog.live(upper.unionByName(r.where("level = 2")).drop("level"), ["k"], ["seq"])
    before = changelog.live(r.drop("level"), ["k"], ["seq"])
    return before.exceptAll(after).unionByName(after.exceptAll(before)).agg(F.count(F.lit(1)).alias("differences"))


@query("SELECT k, seq, v FROM live")
def compact_then_read(spark, sf_dir):
    """What a reader sees once the upper levels are compacted, beside the deepest one as it was."""
    r = runs(spark, sf_dir).withColumnRenamed("del", "tombstone").select("k", "seq", "tombstone", "v", "level")
    upper = changelog.compacted(r.where("level < 2"), ["k"], ["seq"], drop_tombstones=False)
    return changelog.live(upper.unionByName(r.where("level = 2")).drop("level"), ["k"], ["seq"]).select("k", "seq", "v")


@query("SELECT k, seq, v FROM live WHERE k NOT IN (SELECT k FROM ch WHERE seq < 200)")
def physical_delete(spark, sf_dir):
    return changelog.delete_keys(live(spark, sf_dir), events(spark, sf_dir).where("seq < 200").select("k"), ["k"])


@query("""
, o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM o WHERE n = 1""")
def latest_lineitem(spark, sf_dir):
    """A changelog with a key of two columns and an order of several."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_extendedprice")
    return changelog.latest_per_key(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).drop("l_shipdate", "l_extendedprice")


# -- files and levels ---------------------------------------------------------------


@query("SELECT * FROM files")
def run_stats(spark, sf_dir):
    return files(spark, sf_dir)


@query("SELECT level, sum(file_size)::BIGINT AS level_size FROM files GROUP BY level")
def level_size(spark, sf_dir):
    return levels.level_size(files(spark, sf_dir))


@query("SELECT level, count(*) AS level_count FROM files GROUP BY level")
def level_count(spark, sf_dir):
    return levels.level_count(files(spark, sf_dir))


@query("SELECT i AS level, CASE WHEN i = 0 THEN 0 ELSE (10485760 * 10 ** (i - 1))::BIGINT END AS max_size FROM range(7) t(i)")
def level_limits(spark, sf_dir):
    return levels.level_limits(spark, CompactionConfig())


@query("""
, s AS (SELECT level, sum(file_size) AS s, count(*) AS n FROM files GROUP BY level)
SELECT coalesce(min(level), -1)::INTEGER AS level FROM s WHERE (level = 0 AND n >= 3) OR (level BETWEEN 1 AND 5 AND s > 100000 * 10 ** (level - 1))""")
def needs_compaction(spark, sf_dir):
    return levels.needs_compaction(files(spark, sf_dir), LEVELS)


@query("SELECT * FROM files WHERE level = 0")
def pick_input_level0(spark, sf_dir):
    return levels.pick_input(files(spark, sf_dir), 0)


@query("SELECT * FROM files WHERE level = 1 ORDER BY seq_num LIMIT 1")
def pick_input_level1(spark, sf_dir):
    return levels.pick_input(files(spark, sf_dir), 1)


@query("SELECT * FROM files WHERE min_key <= 'u000040' AND max_key >= 'u000030'")
def overlap_range(spark, sf_dir):
    return levels.overlapping(files(spark, sf_dir), "u000030", "u000040")


@query("SELECT a.path, b.path AS other FROM files a JOIN files b ON b.level = a.level + 1 AND a.min_key <= b.max_key AND a.max_key >= b.min_key")
def overlap_pairs(spark, sf_dir):
    return levels.overlaps(files(spark, sf_dir))


@query("SELECT i AS level, coalesce((SELECT bool_or(files.level > i) FROM files), false) AS has_below FROM range(7) t(i)")
def has_below(spark, sf_dir):
    return levels.has_below(files(spark, sf_dir), CompactionConfig())


@query("SELECT live.k AS key, count(*) AS files FROM live JOIN files ON live.k BETWEEN min_key AND max_key GROUP BY live.k")
def lookup_files(spark, sf_dir):
    """Read amplification: files that a lookup may have to open."""
    return levels.files_for_keys(live(spark, sf_dir).select(F.col("k").alias("key")), files(spark, sf_dir))


@query("SELECT path, row_number() OVER (ORDER BY seq_num DESC) AS position FROM files WHERE level = 0")
def level0_order(spark, sf_dir):
    """The order in which a lookup reads level 0; a level has few files, so one task orders them."""
    from pyspark.sql import Window as W

    return files(spark, sf_dir).where("level = 0").select("path", F.row_number().over(W.partitionBy("level").orderBy(F.desc("seq_num"))).cast("long").alias("position"))


@query("SELECT path FROM files WHERE seq_num NOT IN (2, 5) UNION ALL SELECT 'sstable_000050.sst'")
def manifest_replay(spark, sf_dir):
    """Ten edits add a file each; an eleventh removes two of them and an unknown one, and adds, removes and re-adds another."""
    f = files(spark, sf_dir)
    row = F.struct(*f.columns)
    none = F.array().cast(f"array<{f.select(row.alias('x')).schema['x'].dataType.simpleString()}>")
    adds = f.select(F.col("seq_num").alias("edit_no"), F.array(row).alias("added"), none.alias("removed"))
    swap = f.where("seq_num IN (2, 5)").agg(F.lit(100).cast("long").alias("edit_no"), F.collect_list(row).alias("removed"))
    renamed = F.transform("removed", lambda x: x.withField("path", F.lit("sstable_000050.sst")))
    swap = swap.select("edit_no", F.slice(renamed, 1, 1).alias("added"), F.concat("removed", F.slice(renamed, 1, 1)).alias("removed"))
    return manifest.fold(adds.unionByName(swap)).select("path")


@query("SELECT (max(seq_num) + 1)::BIGINT AS next_seq FROM files")
def next_sequence(spark, sf_dir):
    return manifest.next_numbers(files(spark, sf_dir))


@query("SELECT path, try_cast(regexp_extract(path, '(?:^|/)sstable_(\\d+)(?:\\.sst)?$', 1) AS BIGINT) AS number FROM (SELECT path FROM files UNION ALL VALUES ('d/sstable_12'), ('x_3.sst'), ('sstable_.sst'))")
def file_numbers(spark, sf_dir):
    other = spark.createDataFrame([("d/sstable_12",), ("x_3.sst",), ("sstable_.sst",)], "path string")
    return files(spark, sf_dir).select("path").unionByName(other).select("path", entries.file_number(F.col("path")).alias("number"))


@query("SELECT k, sum(octet_length(encode(k)) + coalesce(octet_length(encode(v)), 0))::BIGINT AS buffer_bytes, sum(9 + octet_length(encode(k)) + coalesce(octet_length(encode(v)), 0))::BIGINT AS file_bytes FROM ch GROUP BY k")
def entry_bytes(spark, sf_dir):
    k, v = F.col("k"), F.col("v")
    return events(spark, sf_dir).groupBy("k").agg(F.sum(entries.entry_bytes(k, v)).cast("long").alias("buffer_bytes"), F.sum(entries.encoded_bytes(k, v)).cast("long").alias("file_bytes"))


@query("""
, b AS (SELECT sum(file_size) AS written FROM files), c AS (SELECT sum(9 + octet_length(encode(k)) + octet_length(encode(v))) AS live_bytes FROM live)
SELECT written::BIGINT AS written_bytes, live_bytes::BIGINT AS live_bytes, (written * 1000 // live_bytes)::BIGINT AS space_amp_thousandths FROM b, c""")
def space_amplification(spark, sf_dir):
    written = files(spark, sf_dir).agg(F.sum("file_size").alias("written_bytes"))
    now = live(spark, sf_dir).agg(F.sum(entries.encoded_bytes(F.col("k"), F.col("v"))).cast("long").alias("live_bytes"))
    return written.crossJoin(now).withColumn("space_amp_thousandths", F.floor(F.col("written_bytes") * 1000 / F.col("live_bytes")).cast("long"))


@query("""
, w AS (SELECT sum(file_size) AS flushed FROM files), u AS (SELECT 9 + octet_length(encode(k)) + coalesce(octet_length(encode(v)), 0) AS s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM runs WHERE level < 2) WHERE n = 1)
SELECT flushed::BIGINT AS flushed_bytes, (SELECT sum(s) FROM u)::BIGINT AS compacted_bytes FROM w""")
def write_amplification(spark, sf_dir):
    """Bytes written by flushes, and again by a compaction of level 0 into level 1."""
    flushed = files(spark, sf_dir).agg(F.sum("file_size").alias("flushed_bytes"))
    again = changelog.latest_per_key(runs(spark, sf_dir).where("level < 2"), ["k"], ["seq"]).agg(F.sum(entries.encoded_bytes(F.col("k"), F.col("v"))).cast("long").alias("compacted_bytes"))
    return flushed.crossJoin(again)


# -- bloom filters ------------------------------------------------------------------

#: FNV-1a over ASCII keys in whole numbers of any size.
_FNV = """list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(length({k})), lambda i: ascii({k}[i + 1])::HUGEINT)),
  lambda h, b: ((h - h % 256 + xor((h % 256)::INTEGER, b::INTEGER)) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"""


def _positions(k: str) -> str:
    h = _FNV.format(k=k)
    return f"list_transform(range({HASHES}), lambda i: ((({h}) % 4294967296 + i * (({h}) // 4294967296)) % 4294967296 % {BITS})::BIGINT)"


@query("SELECT n::BIGINT AS n, p, ((ceil(greatest(ceil(-n * ln(q) / (ln(2) * ln(2))), 64) / 64)) * 64)::BIGINT AS num_bits, greatest(ceil(ceil(-n * ln(q) / (ln(2) * ln(2))) / n * ln(2)), 1)::BIGINT AS num_hash FROM (SELECT greatest(a, 1) AS n, p, CASE WHEN p > 0 AND p < 1 THEN p ELSE 0.01::DOUBLE END AS q FROM (VALUES (0, 0.01::DOUBLE), (1, 0.01), (1000, 0.01), (10000, 0.01), (1000, 0.5), (1000, 2.0)) t(a, p))")
def bloom_size(spark, sf_dir):
    asked = spark.createDataFrame([(0, 0.01), (1, 0.01), (1000, 0.01), (10000, 0.01), (1000, 0.5), (1000, 2.0)], "a long, p double").withColumn("n", F.greatest("a", F.lit(1)).cast("long"))
    return asked.select("n", "p", bloom.optimal_size(F.col("n"), F.col("p")).alias("s")).select("n", "p", "s.num_bits", "s.num_hash")


@query(
    "SELECT c_name, lower(lpad(to_base((h // 4294967296)::BIGINT, 16), 8, '0') || lpad(to_base((h % 4294967296)::BIGINT, 16), 8, '0')) AS fnv FROM (SELECT c_name, "
    + _FNV.format(k="c_name")
    + " AS h FROM customer)"
)
def fnv_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_name", F.lower(F.lpad(F.hex(entries.fnv1a(F.col("c_name"))), 16, "0")).alias("fnv"))


@query(f"SELECT c_name, unnest({_positions('c_name')}) AS bit FROM customer")
def bloom_positions(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_name", F.explode(bloom.positions(F.col("c_name"), BITS, HASHES)).alias("bit"))


#: The filter of all customers, sized for their number at a rate of 0.01, and the bits of any rows with a column ``key`` in it.
_SIZE_ALL = "(SELECT (ceil(greatest(m, 64) / 64) * 64)::BIGINT AS bits, greatest(ceil(m / n * ln(2)), 1)::BIGINT AS hashes FROM (SELECT n, ceil(-n * ln(0.01::DOUBLE) / (ln(2) * ln(2))) AS m FROM (SELECT greatest(count(*), 1)::DOUBLE AS n FROM customer)))"
_BITS_ALL = "SELECT DISTINCT key, unnest(list_transform(range(hashes), lambda i: ((h % 4294967296 + i * (h // 4294967296)) % 4294967296 % bits)::BIGINT)) AS bit FROM (SELECT key, bits, hashes, " + _FNV.format(k="key") + " AS h FROM {rows}, " + _SIZE_ALL + ")"
_BUILT_ALL = "(SELECT DISTINCT bit FROM (" + _BITS_ALL.format(rows="(SELECT c_name AS key FROM customer)") + "))"
_PROBED_ALL = "SELECT key, bool_and(bit IN (SELECT bit FROM " + _BUILT_ALL + ")) AS may_contain FROM (" + _BITS_ALL + ") GROUP BY key"


def _built_all(spark, sf_dir):
    """The filter of all customers, with its bits and hashes."""
    customer = table(spark, sf_dir, "customer")
    size = bloom.optimal(customer.count(), 0.01)
    return bloom.build(customer, "c_name", *size), *size


@query(f"SELECT bit FROM {_BUILT_ALL}")
def bloom_build_all(spark, sf_dir):
    return _built_all(spark, sf_dir)[0]


@query(_PROBED_ALL.format(rows="(SELECT c_name AS key FROM customer UNION SELECT p_name FROM part)"))
def bloom_probe_all(spark, sf_dir):
    """All customers, for which the filter says maybe, and the names of parts, which it doesn't hold."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_name").alias("key")).unionByName(table(spark, sf_dir, "part").select(F.col("p_name").alias("key")))
    return bloom.probe(keys, "key", *_built_all(spark, sf_dir))


@query("SELECT count(*) AS probes, coalesce(sum(may_contain::BIGINT), 0)::BIGINT AS false_positives FROM (" + _PROBED_ALL.format(rows="(SELECT DISTINCT p_name AS key FROM part)") + ")")
def bloom_fpr_all(spark, sf_dir):
    """Absent keys for which the filter of all customers says maybe."""
    probed = bloom.probe(table(spark, sf_dir, "part"), "p_name", *_built_all(spark, sf_dir))
    return probed.agg(F.count(F.lit(1)).alias("probes"), F.coalesce(F.count_if("may_contain"), F.lit(0)).alias("false_positives"))


# -- packing ------------------------------------------------------------------------


def _sized(spark, sf_dir):
    """The compacted rows of each level as the entries of one run."""
    per = changelog.latest_per_key(runs(spark, sf_dir).select("level", "k", "seq", "v"), ["level", "k"], ["seq"])
    return per.select("level", "k", entries.encoded_bytes(F.col("k"), F.col("v")).cast("long").alias("size"))


_SIZED = """
, per AS (SELECT level, k, v FROM (SELECT *, row_number() OVER (PARTITION BY level, k ORDER BY seq DESC) AS n FROM runs) WHERE n = 1),
e AS (SELECT level, k, (9 + octet_length(encode(k)) + coalesce(octet_length(encode(v)), 0))::BIGINT AS size, row_number() OVER (PARTITION BY level ORDER BY k) AS i FROM per)
"""
_WALK = "WITH RECURSIVE" + CTES.strip().removeprefix("WITH") + _SIZED


@query(_WALK + """
, w AS (SELECT level, k, size, i, 0::BIGINT AS block, size AS held FROM e WHERE i = 1
  UNION ALL SELECT e.level, e.k, e.size, e.i, CASE WHEN w.held >= 1024 THEN w.block + 1 ELSE w.block END, CASE WHEN w.held >= 1024 THEN e.size ELSE w.held + e.size END FROM w JOIN e ON e.level = w.level AND e.i = w.i + 1)
SELECT level, k, size, block FROM w""")
def block_index(spark, sf_dir):
    """Data blocks of about 1 KB, cut after the entry that fills them."""
    return packing.cut_blocks(_sized(spark, sf_dir), "level", ["k"], "size", 1024)


@query(_WALK + """
, w AS (SELECT level, k, size, i, 0::BIGINT AS file, size AS held FROM e WHERE i = 1
  UNION ALL SELECT e.level, e.k, e.size, e.i, CASE WHEN w.held + e.size > 2000 THEN w.file + 1 ELSE w.file END, CASE WHEN w.held + e.size > 2000 THEN e.size ELSE w.held + e.size END FROM w JOIN e ON e.level = w.level AND e.i = w.i + 1)
SELECT level, k, size, file FROM w""")
def output_split(spark, sf_dir):
    """Output files of at most 2000 bytes, cut before the entry that would exceed them."""
    return packing.split_output(_sized(spark, sf_dir), "level", ["k"], "size", 2000)


@query(
    "WITH RECURSIVE" + CTES.strip().removeprefix("WITH") + """
, e AS (SELECT file, k, seq, (octet_length(encode(k)) + coalesce(octet_length(encode(v)), 0))::BIGINT AS size, row_number() OVER (PARTITION BY file ORDER BY seq) AS i FROM runs)
, w AS (SELECT file::BIGINT AS file, k, seq, size, i, 0::BIGINT AS buffer, map([k], [size]) AS held, size AS total FROM e WHERE i = 1
  UNION ALL SELECT file, k, seq, size, i, CASE WHEN cut THEN buffer + 1 ELSE buffer END, CASE WHEN cut THEN map([k], [size]) ELSE map_concat(held, map([k], [size])) END, CASE WHEN cut THEN size ELSE grown END
  FROM (SELECT *, grown > 2000 AND size > coalesce(own, -1) AS cut FROM (SELECT e.file::BIGINT AS file, e.k, e.seq, e.size, e.i, w.buffer, w.held, w.held[e.k] AS own, w.total + e.size - coalesce(w.held[e.k], 0) AS grown FROM w JOIN e ON e.file = w.file AND e.i = w.i + 1)))
SELECT file, k, seq, size, buffer FROM w"""
)
def buffer_rotation(spark, sf_dir):
    """Which write buffer takes each write, run by run; updates change sizes in place."""
    rows = runs(spark, sf_dir).select("file", "k", "seq", entries.entry_bytes(F.col("k"), F.col("v")).cast("long").alias("size"))
    return packing.rotate_buffers(rows, "file", ["seq"], "k", "size", 2000)


# -- streams ------------------------------------------------------------------------


@query("SELECT k, seq, v FROM live")
def stream_live(spark, sf_dir):
    """The changelog read as a stream into a changelog table, and its live view."""
    stored = sink.replay(spark, f"{sf_dir}/events.parquet", as_changes)
    return changelog.live(stored, ["k"], ["seq"], "del")

