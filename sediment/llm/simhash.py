"""SimHash near-dedup by deletion-variant signatures.

Method: a document's fingerprint has a bit set where over half of its shingles'
hashes have it. Two fingerprints that differ in at most three of 64 bits are cut
into two halves; one of the halves then differs in at most one bit. So each
different fingerprint is posted under its two halves as they are, and under each
half with one bit taken out (two times 32 variants); fingerprints that share a
posting are compared in full. Linked documents form components.

A posting with few members is joined with itself (equality of keys, then the
check). One with many is cut into blocks of members, every two blocks meet in a
task of their own, and the task gives a spanning forest of the links it finds, so
a group of near copies never becomes all of its pairs and no link between
components is lost. Postings with a bit taken out only have to join what the
plain halves haven't joined yet.

Shingles: A-Z are lower-cased, words are runs of other than the bytes 32 and 9 to
13, shingles are three words joined by a space, repeats included; hashes are
XXH64 with seed 42.

Defined results
* a text of fewer than three words has one shingle, the whole sequence of words.
* null and empty texts, and those without words, have fingerprint zero and are
  linked like any other.
* exact copies share a fingerprint, which is posted once.
* rows that repeat a doc_id are one document each and fall together if linked; a
  null doc_id never names a component that has another id. near_dedup keeps one row of
  each component.
* an empty table gives an empty table; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sediment.llm import common
from sediment.llm.components import components, one_of_each, row_key

SHINGLE = 3
#: Fixed values of the fingerprint.
BITS, SEED, APART = 64, 42, 3
#: Members up to which a posting is joined with itself, and members of a block beyond that.
FEW, BLOCK = 32, 2048
#: Parts into which a fingerprint is cut here; n parts, one bit taken out of one, find all that differ in 2n - 1 bits.
PARTS = 2


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    return of_hashes(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64, n))


def of_hashes(h: np.ndarray) -> int:
    """The fingerprint of shingles that have these hashes."""
    n = len(h)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, shingle) for t in batch.column("_sh_text").to_pylist()), np.uint64, batch.num_rows)
            yield batch.drop_columns(["_sh_text"]).append_column("fp", pa.array(found.view(np.int64)))

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("_sh_text")).mapInArrow(_fingerprints(shingle), f"doc_id {kind}, fp long")


def _forest(group: pa.Table, apart: int = APART) -> pa.Table:
    """Links between the members of one pair of blocks that join different labels, as few as join all that can be."""
    fp, label = group["fp"].to_numpy().view(np.uint64), group["label"].to_numpy()
    kinds, number = np.unique(label, return_inverse=True)
    left, links = np.arange(len(fp)), []
    parent = list(range(len(kinds)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    # each member is taken up once and looks at those not yet reached
    todo: list[int] = []
    while len(left) or todo:
        if not todo:
            todo, left = [int(left[0])], left[1:]
        i = todo.pop()
        near = np.bitwise_count(fp[left] ^ fp[i]) <= apart
        for j in left[near]:
            a, b = root(int(number[i])), root(int(number[j]))
            if a != b:
                parent[a] = b
                links.append((i, int(j)))
        todo.extend(left[near].tolist())
        left = left[~near]
    a, b = (np.array([x[k] for x in links], np.int64) for k in (0, 1))
    signed = fp.view(np.int64)
    return pa.table({"a": pa.array(signed[a], pa.int64()), "b": pa.array(signed[b], pa.int64())})


def _posted(nodes: DataFrame, plain: bool, parts: int = PARTS) -> DataFrame:
    """(key, side, fp, label): a key is the posting's number and the part that its members share."""
    starts = [BITS * s // parts for s in range(parts + 1)]
    widths = [b - a for a, b in zip(starts, starts[1:])]
    part = lambda s: F.shiftrightunsigned("fp", starts[s]).bitwiseAND(F.lit((1 << widths[s]) - 1))
    if plain:
        each = [F.struct(F.lit(s).alias("kind"), part(s).alias("rest"), F.lit(0).cast("long").alias("side")) for s in range(parts)]
    else:
        each = [
            F.struct(F.lit(parts + starts[s] + p).alias("kind"), part(s).bitwiseAND(F.lit((1 << widths[s]) - 1 - (1 << p))).alias("rest"), F.shiftright(part(s), p).bitwiseAND(F.lit(1).cast("long")).alias("side"))
            for s in range(parts) for p in range(widths[s])
        ]
    # a node becomes many rows, so the nodes are spread first
    spread = nodes.select("fp", "label").repartition(common.partitions(nodes.sparkSession))
    rows = spread.select("fp", "label", F.explode(F.array(*each)).alias("k"))
    return rows.select((F.col("k.kind").cast("long") * (1 << max(widths)) + F.col("k.rest")).alias("key"), F.col("k.side").alias("side"), "fp", "label")


def links(nodes: DataFrame, plain: bool, parts: int = PARTS) -> DataFrame:
    """(a, b): links between ``nodes`` (fp, label) of different labels; enough of them to join all that the postings join."""
    rows, apart = _posted(nodes, plain, parts), 2 * parts - 1
    member = F.struct("fp", "label")
    found = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("side").alias("s0"), F.max("side").alias("s1"), F.min(member).alias("a"), F.max(member).alias("b"))
    # members that are all joined already, or all on one side of the bit that was taken out, have no link to give here
    found = common.materialise(found.where("n > 1 AND l0 <> l1" if plain else "n > 1 AND l0 <> l1 AND s0 <> s1").select("key", "n", "a", "b"), "postings")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= apart
    # the aggregate names both members of most postings; only the larger ones meet their members again
    two = found.where("n = 2").where(near("a.fp", "b.fp")).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    held = rows.join(found.where("n > 2").select("key", "n"), "key")
    few = held.where(F.col("n") <= FEW)
    one, other = (few.select("key", *(F.col(c).alias(f"{p}{c}") for c in ("fp", "label"))) for p in ("a", "b"))
    small = one.join(other, "key").where("afp < bfp AND alabel <> blabel").where(near("afp", "bfp")).select(F.col("afp").alias("a"), F.col("bfp").alias("b"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    many = held.where(F.col("n") > FEW).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    met = many.select("key", "fp", "label", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "label"
    )
    large = met.groupBy("key", "i", "j").applyInArrow(lambda group: _forest(group, apart), "a long, b long")
    return two.unionByName(small).unionByName(large)


def _labelled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return nodes.select("fp").join(found.select(F.col("node").alias("fp"), F.col("label").alias("_l")), "fp", "left").select("fp", F.coalesce("_l", "fp").alias("label"))


def forest(nodes: DataFrame, parts: int) -> DataFrame:
    """(a, b): links that join all ``nodes`` (fp, label) that chains of fingerprints 2 * ``parts`` - 1 bits apart or less join."""
    near = common.materialise(links(nodes, True, parts), "links")
    joined = common.materialise(_labelled(nodes, components(near, "a", "b")), "nodes")
    return near.unionByName(links(joined, False, parts))


def near_components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that can be reached over links, the document's own included."""
    common.tune(docs.sparkSession)
    prints = common.materialise(fingerprints(docs, shingle), "fingerprints")
    nodes = common.materialise(prints.select("fp").distinct().withColumn("label", F.col("fp")), "nodes")
    first = components(links(nodes, plain=True), "a", "b")
    joined = common.materialise(_labelled(nodes, first), "nodes")
    # what the plain halves join is one vertex from here on
    further = links(joined, plain=False)
    of = lambda side: joined.select(F.col("fp").alias(side), F.col("label").alias(f"{side}_label"))
    edges = further.join(of("a"), "a").join(of("b"), "b").select("a_label", "b_label")
    second = components(edges, "a_label", "b_label")
    whole = joined.join(second.select(F.col("node").alias("label"), F.col("label").alias("_l")), "label", "left").select("fp", F.coalesce("_l", "label").alias("label"))
    named = prints.join(whole, "fp").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return prints.join(whole.join(named, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` of each group of near copies: that of the smallest doc_id."""
    rows = docs.select("doc_id", "text", row_key().alias("row"))
    found = near_components(rows.select(F.col("row").alias("doc_id"), "text"), shingle).select(F.col("doc_id").alias("row"), F.col("component_id").alias("label")).distinct()
    return one_of_each(docs, rows.select("doc_id", "row").join(found, "row"))
