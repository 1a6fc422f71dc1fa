import random

import pytest

from sediment.operators.bloom import optimal
from sediment.model import CorruptFooter, InvalidMagic, NothingToWrite
from sediment.sources import sst


def write(path, entries):
    path.write_bytes(sst.encode_table(entries))
    return str(path)


def test_round_trip(tmp_path):
    rng = random.Random(3)
    data = {("k%05d" % rng.randrange(10**5)).encode(): rng.choice([None, b"", b"v" * rng.randrange(60)]) for _ in range(1000)}
    t = sst.Table(write(tmp_path / "a.sst", sorted(data.items())))
    assert list(t.entries()) == sorted(data.items()) and len(t.index) > 1
    for k, v in list(data.items())[:200]:
        assert list(t.search(k)) == [(k, v)]
    assert not any(list(t.search(b"K%d" % i)) for i in range(200))


def test_empty_key_and_large_entry(tmp_path):
    entries = [(b"", b"x"), (b"a", b"y" * 10000), (b"b", None)]
    assert list(sst.Table(write(tmp_path / "a.sst", entries)).entries()) == entries


def test_errors(tmp_path):
    with pytest.raises(NothingToWrite):
        sst.encode_table([])
    with pytest.raises(ValueError):
        sst.encode_table([(b"b", b""), (b"a", b"")])
    p = tmp_path / "a.sst"
    p.write_bytes(b"short")
    with pytest.raises(CorruptFooter):
        sst.Table(str(p))
    p.write_bytes(b"\0" * 100)
    with pytest.raises(InvalidMagic):
        sst.Table(str(p))
    with pytest.raises(CorruptFooter):
        list(sst.decode_entries(sst.encode_entry(b"key", b"value")[:-1]))


def test_data_source(spark, tmp_path):
    sst.register(spark)
    write(tmp_path / "sstable_000001.sst", [(b"a", b"1"), (b"b", None)])
    write(tmp_path / "sstable_000002.sst", [(b"a", b"2")])
    df = spark.read.format("sst").load(str(tmp_path))
    assert sorted((bytes(r.key), r.value and bytes(r.value), r.tombstone, r.file) for r in df.collect()) == [
        (b"a", b"1", False, "sstable_000001.sst"), (b"a", b"2", False, "sstable_000002.sst"), (b"b", None, True, "sstable_000001.sst")
    ]
    assert df.where("key = CAST('b' AS BINARY)").count() == 1


def test_data_source_writes(spark, tmp_path):
    sst.register(spark)
    rows = spark.range(100).selectExpr("CAST(format_string('k%03d', id) AS BINARY) AS key", "CAST(id AS STRING) AS v", "id % 10 = 0 AS tombstone")
    rows = rows.selectExpr("key", "CASE WHEN NOT tombstone THEN CAST(v AS BINARY) END AS value", "tombstone", "'' AS file")
    for _ in range(2):
        rows.repartitionByRange(3, "key").sortWithinPartitions("key").write.format("sst").mode("append").save(str(tmp_path))
    back = spark.read.format("sst").load(str(tmp_path))
    assert back.count() == 200 and back.where("tombstone").count() == 20 and back.select("file").distinct().count() == 6


def test_a_reset_filter_knows_no_key():
    b = sst.Bloom(*optimal(100, 0.01))
    for i in range(100):
        b.add(b"%d" % i)
    assert all(b.may_contain(b"%d" % i) for i in range(100))
    size = (b.bits, b.hashes)
    b.reset()
    assert not any(b.may_contain(b"%d" % i) for i in range(100)) and (b.bits, b.hashes) == size
