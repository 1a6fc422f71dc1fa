"""Media columns: lossless media payloads kept in a store of content-defined chunks.

Method: a rolling gear hash over the bytes of a media file cuts it into chunks;
chunks are told apart by their SHA-256 and stored once, in a table bucketed by
digest; a media is the ordered list of its chunks' digests. Reading back joins
the lists with the stored chunks, puts them in order, and checks the SHA-256 of
the whole against the one taken when it was stored; a difference raises.

The media form is a grey image (binary PGM, 8-bit samples, rows of 192): a short
header and the payload as it is. A payload is the UTF-8 text, followed by bytes
32 up to a positive multiple of 192.

Defined results
* null and empty texts: a payload of 192 bytes 32, n_bytes 0.
* equal texts have equal media, which are stored and put together once.
* rows that repeat a doc_id give a row each.
* an empty table gives an empty table; other columns take no part.

Scale: payloads move twice, compressed: once by digest on the way into the store,
with map-side combining so that a chunk shared by a third of all rows is at most
one row a task, and once by media on the way out. Each of the two steps frees its
shuffle files. The store isn't moved to be joined, as it is bucketed by the
join's key. The few chunks to which more than ``HEAVY`` of all references point
are at most 1/``HEAVY`` in number by arithmetic, so they are broadcast instead
of joined by shuffle.
"""

from __future__ import annotations

import bz2
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm import common

#: Samples in a row of the image, and the byte that pads the last row. Fixed values.
ROW, PAD = 192, 32
#: Chunk sizes in bytes: never under LEAST (but for a media's last), never over MOST, cut where MASK_BITS bits of the hash are zero.
LEAST, MOST, MASK_BITS = 1024, 32768, 12
#: Share of all references from which a chunk is heavy; so at most 1/HEAVY chunks are.
HEAVY = 0.01
#: Compression of a stored chunk: block sorting packs short texts a tenth smaller than dictionary methods do.
LEVEL = 9

#: The gear table: a 32-bit value a byte, from a rule.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], dtype=np.uint32)


def media_of(text: bytes | None) -> tuple[bytes, int]:
    """The media file of a text, and the length of its header."""
    text = text or b""
    size = max(1, -(-len(text) // ROW)) * ROW
    header = b"P5\n%d %d\n255\n" % (ROW, size // ROW)
    return header + text + bytes([PAD]) * (size - len(text)), len(header)


def payload_of(media: bytes) -> bytes:
    """The samples of a media file."""
    magic, size, most, payload = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or most != b"255" or width != ROW or len(payload) != width * height:
        raise ValueError("not a media of this form")
    return payload


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks: the gear hash of a place covers the 32 bytes before it, computed for all places at once."""
    n = len(data)
    if n <= LEAST:
        return [n]
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    places = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    ends, start, i = [], 0, 0
    while n - start > LEAST:
        i = int(np.searchsorted(places, start + LEAST))
        end = int(places[i]) if i < len(places) else n
        end = min(end, start + MOST, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunks(media: bytes) -> Iterator[bytes]:
    start = 0
    for end in cuts(media):
        yield media[start:end]
        start = end


_CHUNK = pa.schema([("digest", pa.binary()), ("packed", pa.binary())])
_LIST = pa.schema([("row_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.binary()), ("digests", pa.list_(pa.binary()))])


def _to_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for (text,) in common.rows_of(batches, "_media_text"):
            for c in chunks(media_of(text)[0]):
                yield hashlib.sha256(c).digest(), bz2.compress(c, LEVEL)

    yield from common.emit(rows(), _CHUNK, 4096, 8 << 20, lambda r: len(r[1]))


def _to_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, size, sha, lists = [], [], [], []
        for text in batch.column(batch.schema.get_field_index("_media_text")).to_pylist():
            media, _ = media_of(text)
            n.append(len(text or b""))
            size.append(len(media))
            sha.append(hashlib.sha256(media).digest())
            lists.append([hashlib.sha256(c).digest() for c in chunks(media)])
        kept = batch.drop_columns(["_media_text"])
        for name, values, kind in (("n_bytes", n, pa.int64()), ("media_bytes", size, pa.int64()), ("media_sha256", sha, pa.binary()), ("digests", lists, pa.list_(pa.binary()))):
            kept = kept.append_column(name, pa.array(values, kind))
        yield kept


class ChunkStore:
    """Chunks of media, each stored once, in a bucketed table."""

    def __init__(self, spark, name: str):
        self.spark, self.name = spark, name

    @classmethod
    def write(cls, docs: DataFrame) -> ChunkStore:
        spark = docs.sparkSession
        common.tune(spark)
        store = cls(spark, f"media_chunks_{uuid.uuid4().hex}")
        buckets = common.partitions(spark)
        chunk_rows = docs.select(F.col("text").cast("binary").alias("_media_text")).mapInArrow(_to_chunks, "digest binary, packed binary")
        (
            chunk_rows.groupBy("digest").agg(F.first("packed").alias("packed"))
            .write.option("compression", "uncompressed").bucketBy(buckets, "digest").saveAsTable(store.name)
        )
        return store

    def chunks(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def media_lists(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media_bytes, media_sha256, digests): the stored form of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("_media_text")).mapInArrow(
        _to_lists, f"doc_id {kind}, n_bytes long, media_bytes long, media_sha256 binary, digests array<binary>"
    )


def feature(payload: bytes) -> str:
    """Rows, mean sample (in thousandths), and a hash of 64 bits: which of 64 equal stretches are brighter than the mean."""
    x = np.frombuffer(payload, np.uint8)
    ends = np.arange(65) * len(x) // 64
    total = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
    sums = total[ends[1:]] - total[ends[:-1]]
    bright = sums * len(x) > int(total[-1]) * (ends[1:] - ends[:-1])
    return f"{len(x) // ROW}:{int(total[-1]) * 1000 // len(x)}:{np.packbits(bright).tobytes().hex()}"


_READ = "media_sha256 binary, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def _read_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks come sorted by media and ordinal; one media is held at a time."""
    schema = pa.schema([("media_sha256", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string())])

    def one(sha: bytes, parts: list[bytes]) -> tuple:
        media = b"".join(parts)
        if hashlib.sha256(media).digest() != sha:
            raise ValueError(f"media {sha.hex()} doesn't come back as it was stored")
        payload = payload_of(media)
        return sha, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), feature(payload)

    def rows():
        now, parts = None, []
        for sha, packed in common.rows_of(batches, "media_sha256", "packed"):
            if sha != now and now is not None:
                yield one(now, parts)
                parts = []
            now = sha
            parts.append(bz2.decompress(packed))
        if now is not None:
            yield one(now, parts)

    yield from common.emit(rows(), schema)


def read_back(lists: DataFrame, store: ChunkStore) -> DataFrame:
    """Features of each different media, from its stored chunks."""
    media = lists.groupBy("media_sha256").agg(F.first("digests").alias("digests"))
    refs = media.select("media_sha256", F.posexplode("digests").alias("ordinal", "digest"))
    total = refs.groupBy("digest").agg(F.count(F.lit(1)).alias("refs"))
    n = total.agg(F.sum("refs")).first()[0] or 0
    heavy = [bytes(r.digest) for r in total.where(F.col("refs") > max(HEAVY * n, 1000)).collect()]  # at most 1/HEAVY rows
    chunk = store.chunks()
    if heavy:
        of = lambda df: df.where(F.col("digest").isin(heavy))
        rest = lambda df: df.where(~F.col("digest").isin(heavy))
        joined = rest(refs).join(rest(chunk), "digest").unionByName(of(refs).join(F.broadcast(of(chunk)), "digest"))
    else:
        joined = refs.join(chunk, "digest")
    spark = lists.sparkSession
    return (
        joined.select("media_sha256", F.col("ordinal").cast("int").alias("ordinal"), "packed")
        .repartition(common.partitions(spark), "media_sha256")
        .sortWithinPartitions("media_sha256", "ordinal")
        .mapInArrow(_read_sorted, _READ)
    )


def media_columns(docs: DataFrame) -> DataFrame:
    """Store the documents as media, read the stored bytes back, and describe them.

    One row a document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, n_chunks.
    """
    spark = docs.sparkSession
    common.tune(spark)
    store = ChunkStore.write(docs)
    lists = common.materialise(media_lists(docs), "media-lists")
    found = common.materialise(read_back(lists, store), "media-read")
    store.drop()
    return lists.join(found, "media_sha256").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.lower(F.hex("media_sha256")).alias("media_sha256"), "feature", F.size("digests").alias("n_chunks")
    )
