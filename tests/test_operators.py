"""Changelog, bloom, packing and metadata operators on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from sediment.functions import entries
from sediment.model import CompactionConfig, StoreConfig
from sediment.operators import bloom, changelog, levels, manifest, packing
from sediment.sources.sst import Bloom, fnv


def rows(spark, *r):
    return spark.createDataFrame(r, "key string, value string, tombstone boolean")


def test_merge_prefers_the_first_source_and_keeps_deletions(spark):
    new, old = rows(spark, ("a", "new", False), ("c", None, True)), rows(spark, ("a", "old", False), ("b", "b", False), ("c", "old", False))
    assert sorted(map(tuple, changelog.merge([new, old], ["key"]).collect())) == [("a", "new", False), ("b", "b", False), ("c", None, True)]


def test_merge_of_random_sources(spark):
    rng = random.Random(1)
    for _ in range(3):
        sources = [{"".join(rng.choices("abcde", k=rng.randint(1, 3))): rng.choice([None, "x", "y"]) for _ in range(rng.randint(0, 20))} for _ in range(rng.randint(1, 4))]
        want = {}
        for s in reversed(sources):
            want |= s
        frames = [spark.createDataFrame([(k, v, v is None) for k, v in s.items()], "key string, value string, tombstone boolean") for s in sources]
        assert {r.key: r.value for r in changelog.merge(frames, ["key"]).collect()} == want


def test_deletions_go_after_the_latest_row_is_found(spark):
    df = spark.createDataFrame([("a", "1", False, 1), ("a", None, True, 2), ("b", None, True, 1), ("b", "", False, 2)], "key string, value string, tombstone boolean, seq long")
    assert [tuple(r) for r in changelog.live(df, ["key"], ["seq"]).collect()] == [("b", "", 2)]


@pytest.mark.parametrize("key", ["", "a", "foobar", "é😀", "x" * 300])
def test_fnv(spark, key):
    got = spark.createDataFrame([(key,)], "k string").select(entries.fnv1a(F.col("k"))).first()[0]
    assert got % (1 << 64) == fnv(key.encode())
    known = {"": 0xCBF29CE484222325, "a": 0xAF63DC4C8601EC8C, "foobar": 0x85944171F73967E8}
    assert known.get(key, fnv(key.encode())) == fnv(key.encode())


def test_bloom_sizes():
    assert bloom.optimal(1000, 0.01) == (9600, 7)
    assert bloom.optimal(10000, 0.01) == (95872, 7)
    assert bloom.optimal(0, 5.0)[0] == 64 and bloom.clamped(1, 0) == (64, 1)


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    bits, hashes = bloom.optimal(1000, 0.01)
    present = spark.range(1000).select(F.concat(F.lit("in"), "id").alias("k"))
    absent = spark.range(20000).select(F.concat(F.lit("out"), "id").alias("k"))
    built = bloom.build(present, "k", bits, hashes)
    assert bloom.probe(present, "k", built, bits, hashes).where("NOT may_contain").count() == 0
    assert bloom.probe(absent, "k", built, bits, hashes).where("may_contain").count() <= 0.02 * 20000


def test_bloom_positions_are_those_of_the_file_format(spark):
    want = Bloom(9600, 7).positions(b"foobar")
    assert spark.range(1).select(bloom.positions(F.lit("foobar"), 9600, 7)).first()[0] == want


def test_packing_rules():
    assert packing.block_numbers([4000, 200, 10, 5000, 1]) == [0, 0, 1, 1, 2]
    assert packing.file_numbers([600, 100, 500, 400], 500) == [0, 1, 2, 3]
    assert packing.file_numbers([1, 2, 3], 0) == [0, 0, 0]
    assert packing.rotations(["a", "b", "c"], [2, 2, 2], 4) == [0, 0, 1]
    assert packing.rotations(["a", "b", "a", "b", "a"], [2, 2, 2, 1, 8], 4) == [0, 0, 0, 0, 1]
    assert packing.rotations(["a", "b"], [9, 1], 4) == [0, 1]


FILES = "path string, level int, min_key string, max_key string, file_size long, seq_num long"


def files(spark, *r):
    return spark.createDataFrame(r, FILES)


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_and_lookups_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("klmno", k=rng.randint(1, 4)))
    made = [(f"f{i}", rng.randint(0, 2), *sorted((word(), word())), 1, i) for i in range(90)]
    f = files(spark, *made)
    low, high = sorted((word(), word()))
    assert {r.path for r in levels.overlapping(f, low, high).collect()} == {p for p, _, a, b, *_ in made if not (b < low or a > high)}
    keys = sorted({word() for _ in range(60)})
    want = {k: n for k in keys if (n := sum(a <= k <= b for _, _, a, b, *_ in made))}
    assert {r.key: r.files for r in levels.files_for_keys(spark.createDataFrame([(k,) for k in keys], "key string"), f).collect()} == want
    assert levels.files_for_keys(spark.createDataFrame([("k",)], "key string"), f.limit(0)).count() == 0


def test_triggers(spark):
    c = CompactionConfig(l0_threshold=2, l1_max_bytes=100)
    assert levels.needs_compaction(files(spark), c).first()[0] == -1
    assert levels.needs_compaction(files(spark, ("1", 0, "a", "b", 1, 1), ("2", 0, "a", "b", 1, 2)), c).first()[0] == 0
    assert levels.needs_compaction(files(spark, ("1", 1, "a", "b", 120, 1)), c).first()[0] == 1
    assert levels.needs_compaction(files(spark, ("1", 6, "a", "b", 1 << 60, 1)), c).first()[0] == -1
    assert [r.max_size for r in levels.level_limits(spark, c).orderBy("level").take(4)] == [0, 100, 1000, 10000]


@pytest.mark.parametrize("seed", range(2))
def test_oldest_is_picked(spark, seed):
    numbers = random.Random(seed).sample(range(1000), 12)
    f = files(spark, *((f"f{n}", 1 + i % 2, "a", "b", 1, n) for i, n in enumerate(numbers)))
    assert levels.pick_input(f, 1).first().seq_num == min(numbers[::2])
    assert {r.seq_num for r in levels.pick_input(f.withColumn("level", F.lit(0)), 0).collect()} == set(numbers)


def test_fold(spark):
    one = lambda n, lv: (f"sstable_{n:06d}.sst", lv, "a", "b", 1, n)
    kind = "struct<" + FILES.replace(" ", ":").replace(",:", ",") + ">"
    edits = spark.createDataFrame(
        [(1, [one(1, 1), one(2, 1)], []), (2, [one(3, 2)], [one(1, 1)]), (3, [one(3, 3)], [one(3, 2), one(9, 1)])], f"edit_no long, added array<{kind}>, removed array<{kind}>"
    )
    got = manifest.fold(edits)
    assert sorted((r.path, r.level) for r in got.collect()) == [("sstable_000002.sst", 1), ("sstable_000003.sst", 3)]
    assert manifest.next_numbers(got).first()[0] == 4
    f = levels.remove_files(levels.add_files(got, files(spark, one(7, 0))), got)
    assert [r.path for r in f.collect()] == ["sstable_000007.sst"]


def test_settings_are_checked():
    for bad in (lambda: StoreConfig(), lambda: CompactionConfig(l0_threshold=0), lambda: CompactionConfig(max_levels=1)):
        with pytest.raises(ValueError):
            bad()


def test_whole_table_filter_holds_every_customer(spark):
    """More customers than the 1,000 that bloom_build takes; names of parts are absent."""
    from sediment.plans import catalog

    sf = "/root/testdata/sf0.01"
    customers = {r.c_name for r in spark.read.parquet(f"{sf}/customer.parquet").collect()}
    probed = {r.key: r.may_contain for r in catalog.queries()["bloom_probe_all"](spark, sf).collect()}
    assert len(customers) > 1000 and all(probed[c] for c in customers)
    absent = [k for k in probed if k not in customers]
    assert absent and sum(probed[k] for k in absent) <= 0.03 * len(absent)
