"""BPE encoding and decoding through a table of distinct words.

Method: texts are split into words at ASCII white space, each distinct word is
encoded once, and its ids are joined back to the places where the word stands;
decoding joins ids with the pieces of the vocabulary.

The tokenizer drops white space and never merges across it, so a text's ids are
its words' ids in order. That needs a tokenizer of this kind, and is tested
against the library's own encoding of whole texts.

A row for each place of a word would move several times the text. So documents
are taken in blocks of about ``BLOCK_BYTES``; a block sends each of its distinct
words once (packed, by hash of the word) to where that word is encoded, and gets
words with ids back; there they meet the block's texts, and every word's ids go to
its places. A word's rows are as many as blocks it stands in, however often it
occurs, and they are dealt by hash, so frequent words aren't hot keys.

Defined results
* null text: like an empty one: no ids, an empty decoded text.
* rows that repeat a doc_id give a row each.
* a word that the table lacks (it can't, unless the input changes between two
  reads) is an error.
* an empty table gives an empty table; other columns take no part.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm import common

#: Text of a block, and words that an encoding task remembers, so that a word of many blocks is encoded once.
BLOCK_BYTES, REMEMBERED = 16 << 20, 1_000_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """The piece of every id: as long as the vocabulary, which the tokenizer's file fixes."""
    t = tokenizer(path)
    return [(t.id_to_token(i) or "").encode() for i in range(t.get_vocab_size(with_added_tokens=True))]


def encode_words(path: str, found: list[bytes]) -> list[np.ndarray]:
    encoded = tokenizer(path).encode_batch([w.decode("utf-8", "replace") for w in found], add_special_tokens=False)
    return [np.array(e.ids, "<u4") for e in encoded]


def _blocks(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[int, pa.RecordBatch, list[bytes]]]:
    """Rows with their block's number."""
    number, held = TaskContext.get().partitionId() << 24, 0
    for batch in batches:
        texts = [t or b"" for t in batch.column(name).to_pylist()]
        yield number, batch, texts
        held += sum(map(len, texts))
        if held >= BLOCK_BYTES:
            number, held = number + 1, 0


def _words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)

        def packed(block: int, found: set[bytes]) -> pa.RecordBatch:
            by_part: list[list[bytes]] = [[] for _ in range(parts)]
            for w in found:
                by_part[zlib.crc32(w) % parts].append(w)
            rows = [(block, p, pack.compress(b"\n".join(sorted(ws)))) for p, ws in enumerate(by_part) if ws]
            return common.batch_of(rows, pa.schema([("block", pa.int64()), ("part", pa.int32()), ("words", pa.binary())]))

        now, found = None, set()
        for block, _, texts in _blocks(batches, "_bpe_text"):
            if block != now and found:
                yield packed(now, found)
                found = set()
            now = block
            for t in texts:
                found.update(t.split())
        if found:
            yield packed(now, found)

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        known: dict[bytes, np.ndarray] = {}

        def rows():
            for block, packed in common.rows_of(batches, "block", "words"):
                found = unpack.decompress(packed).split(b"\n")
                if len(known) > REMEMBERED:
                    known.clear()
                new = [w for w in found if w not in known]
                known.update(zip(new, encode_words(path, new), strict=True))
                ids = [known[w] for w in found]
                lengths = np.array([len(i) for i in ids], "<u4").tobytes()
                yield block, packed, pack.compress(lengths + np.concatenate(ids).tobytes())

        yield from common.emit(rows(), pa.schema([("block", pa.int64()), ("words", pa.binary()), ("ids", pa.binary())]), 256, 4 << 20, lambda r: len(r[1]) + len(r[2]))

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for block, batch, texts in _blocks(batches, "_bpe_text"):
        out = batch.drop_columns(["_bpe_text"]).append_column("block", pa.array([block] * batch.num_rows, pa.int64()))
        yield out.append_column("packed", pa.array([pack.compress(t) for t in texts], pa.binary()))


def _joined(path: str):
    def run(texts: pa.Table, table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        piece = pieces(path)
        ids_of: dict[bytes, bytes] = {}
        piece_of: dict[bytes, bytes] = {}

        def learn(found: list[bytes], lengths: list[int], flat: np.ndarray) -> None:
            at = 0
            for w, n in zip(found, lengths, strict=True):
                ids = flat[at : at + n]
                at += n
                ids_of[w] = ids.tobytes()
                piece_of[w] = b" ".join([piece[i] for i in ids.tolist()])

        for words, packed in zip(table["words"].to_pylist(), table["ids"].to_pylist(), strict=True):
            found = unpack.decompress(words).split(b"\n")
            flat = np.frombuffer(unpack.decompress(packed), "<u4")
            learn(found, flat[: len(found)].tolist(), flat[len(found) :])
        n_tokens, ids, decoded = [], [], []
        for packed in texts["packed"].to_pylist():
            words = unpack.decompress(packed).split()
            if missing := next((w for w in words if w not in ids_of), None):
                raise ValueError(f"the table of words lacks {missing!r}: the input isn't the same at each read")
            ids.append(b"".join(map(ids_of.__getitem__, words)))
            # a word may have no ids (one of white space beyond ASCII), and then has no piece either
            decoded.append(b" ".join(filter(None, map(piece_of.__getitem__, words))))
            n_tokens.append(len(ids[-1]) // 4)
        out = texts.drop_columns(["block", "packed"])
        out = out.append_column("n_tokens", pa.array(n_tokens, pa.int64())).append_column("ids", pa.array(ids, pa.binary()))
        return out.append_column("decoded", pa.array(decoded, pa.binary()).cast(pa.string()))

    return run


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit numbers, and the text that they decode to."""
    spark = docs.sparkSession
    common.tune(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("_bpe_text"))
    parts = min(common.partitions(spark), 4096)
    words = texts.mapInArrow(_words(parts), "block long, part int, words binary")
    table = words.repartition(common.partitions(spark), "part").mapInArrow(_encoded(path), "block long, words binary, ids binary")
    packed = texts.mapInArrow(_texts, f"doc_id {kind}, block long, packed binary")
    return packed.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(_joined(path), f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) for a table (doc_id, ids array<int>) with distinct doc_id: a join of ids with pieces.

    Unknown ids are left out, as the library does; null ids give a null text.
    """
    spark = ids.sparkSession
    table = spark.createDataFrame([(i, p.decode()) for i, p in enumerate(pieces(path))], "id int, piece string")
    places = ids.select("doc_id", F.posexplode_outer("ids").alias("at", "id")).join(F.broadcast(table), "id", "left")
    gathered = places.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("at", "piece")))).alias("p"))
    known = ids.select("doc_id", F.col("ids").isNull().alias("none"))
    return gathered.join(known, "doc_id").select("doc_id", F.when(~F.col("none"), F.array_join(F.col("p.piece"), " ")).alias("decoded"))
