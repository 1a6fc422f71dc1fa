"""Cases that every operator has to answer, and brute force for the registered queries."""

import math
import random
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from sediment.llm import bpe, catalog, chat_format, common, html_text, media, near_copies, packing, simhash, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_bpe_of_repeated_ids_clashing_columns_and_a_long_text(spark):
    import public_tokenizers

    path = public_tokenizers.path(catalog.VOCABULARY)
    long = " ".join(f"word{i % 977} Ünï{i % 31}" for i in range(60_000))
    rows = [(1, "a b", 1, "x"), (1, "c", 2, "y"), (None, "a b", 3, "z"), (2, long, 4, ""), (3, None, 5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int, words string")
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.encode_and_decode(df, path).collect())
    t = bpe.tokenizer(path)
    want = Counter()
    for d, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[d, len(ids), np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    assert bpe.encode_and_decode(df.limit(0), path).count() == 0


def test_html_of_an_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "<p>a", "t"), (1, "<p>a", "t"), (None, None, "u")], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in html_text.html_text(df).collect() if r.text) == [(1, "a"), (1, "a")]
    assert html_text.html_text(df).count() == 3 and html_text.html_text(df.limit(0)).count() == 0


class Plain(HTMLParser):
    """Text in the order of the source, and nothing of layout."""

    def __init__(self):
        super().__init__()
        self.found = []

    def handle_data(self, data):
        self.found += data.split()


def page(rng, depth=0):
    word = lambda: rng.choice(["alpha", "beta", "gamma", "x&amp;y", "1&lt;2", "ünï"]) + str(rng.randrange(1000))
    if depth > 4 or rng.random() < 0.3:
        return " ".join(word() for _ in range(rng.randint(1, 5))) + " "
    inner = lambda: "".join(page(rng, depth + 1) for _ in range(rng.randint(1, 3)))
    kind = rng.choice(["div", "p", "ul", "ol", "blockquote", "table", "b", "section", "h2"])
    if kind in ("ul", "ol"):
        return f"<{kind}>" + "".join(f"<li>{page(rng, depth + 1)}" for _ in range(rng.randint(1, 3))) + f"</{kind}>"
    if kind == "table":
        return "<table>" + "".join("<tr>" + "".join(f"<td>{word()}" for _ in range(3)) for _ in range(rng.randint(1, 3))) + "</table>"
    if kind in ("p", "h2", "b"):
        return f"<{kind}>{word()} </{kind}>"
    return f"<{kind}>{inner()}</{kind}>"


@pytest.mark.parametrize("seed", range(60))
def test_html_keeps_all_text_in_order(seed):
    source = page(random.Random(seed))
    plain = Plain()
    plain.feed(source)
    got = [w for line in html_text.render(source).split("\n") for w in re.sub(r"^[\s]*((-|\d+\.)\s+)*", "", line).split()]
    assert got == plain.found


def test_html_aligns_every_column():
    rng = random.Random(2)
    cells = [["c" * rng.randint(1, 9) for _ in range(4)] for _ in range(6)]
    lines = html_text.render("<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in cells) + "</table>").split("\n")
    starts = [[m.start() for m in re.finditer(r"\S+", line)] for line in lines]
    assert len(lines) == 6 and all(s == starts[0] for s in starts)
    assert starts[0] == [sum(max(len(r[k]) for r in cells) + 2 for k in range(c)) for c in range(4)]


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<input value=v><input type=search placeholder=find><input type=hidden value=no><input type=password value=no><input type=submit value=go>", "vfindgo"),
        ("<table><tr><td rowspan=0>a<td>1<tr><td>2<tr><td>3</table>", "a  1\n   2\n   3"),
        ("<ol><li>a" * 40 + "<li>last", None),
    ],
)
def test_html_of_fields_spans_and_depth(source, text):
    got = html_text.render(source)
    assert got == text if text is not None else got.count("1.") == 40 and got.endswith("2. last")


def test_simhash_query_against_brute_force(spark, sf):
    rows = common.table(spark, sf, "documents").select("doc_id", "text").collect()
    ids = np.array([r.doc_id for r in rows])
    prints = np.array([simhash.fingerprint((r.text or "").encode()) for r in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    label = ids.copy()
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in catalog.op5_simhash(spark, sf).collect()}
    assert got == {int(d): (f"{int(p):016x}", int(c)) for d, p, c in zip(ids, prints, label)}


def test_simhash_components_of_many_postings(spark, monkeypatch):
    """Chains and clusters of fingerprints at up to three bits, in postings beyond a block, against brute force."""
    monkeypatch.setattr(simhash, "FEW", 4)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(11)
    prints = {0}
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(25):
            prints.add(p)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                p ^= 1 << b
    prints = np.array(sorted(prints), np.uint64)
    nodes = spark.createDataFrame([(int(p), int(p)) for p in prints.view(np.int64)], "fp long, label long")
    joined = {}
    first = simhash.components(simhash.links(nodes, plain=True), "a", "b")
    labelled = common.materialise(simhash._labelled(nodes, first), "nodes")
    of = lambda s: labelled.select(F.col("fp").alias(s), F.col("label").alias(f"{s}_label"))
    second = simhash.components(simhash.links(labelled, plain=False).join(of("a"), "a").join(of("b"), "b"), "a_label", "b_label")
    further = {r.node: r.label for r in second.collect()}
    joined = {r.fp: further.get(r.label, r.label) for r in labelled.collect()}
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    label = np.arange(len(prints))
    for _ in range(len(prints)):
        label = np.array([label[near[i]].min() for i in range(len(prints))])
    groups = defaultdict(set)
    for p, c in zip(prints.view(np.int64), label):
        groups[c].add(int(p))
    found = defaultdict(set)
    for p, c in joined.items():
        found[c].add(p)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))


def test_simhash_of_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(5, text, "x"), (5, text + " more", "y"), (9, text, "z"), (None, text, "n"), (7, "other words entirely here", "o")], "doc_id long, text string, fp string")
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_components(df).collect())
    assert got[5, 5] == 2 and got[9, 5] == 1 and got[None, 5] == 1 and got[7, 7] == 1


def test_packing_query_covers_the_table_and_clashing_columns(spark, sf):
    docs = common.table(spark, sf, "documents")
    words = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.select("doc_id", "text").collect()}
    rows = catalog.op6_best_fit_packing(spark, sf).collect()
    total, bins = Counter(), defaultdict(list)
    for r in rows:
        total[r.doc_id] += r.length
        if r.bin_id:
            bins[r.bin_id].append(r)
    assert {d: total[d] for d in words} == words
    # what plain best fit in bins of the largest size alone needs
    room, single = [], 0
    for n in sorted((n % 4096 for n in words.values() if n % 4096), reverse=True):
        fits = [i for i, x in enumerate(room) if x >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(4096 - n)
            single += 4096
    packed = sum(b[0].bin_size for b in bins.values()) - sum(4096 * (n // 4096) for n in words.values())
    assert sum(words.values()) <= sum(b[0].bin_size for b in bins.values()) and packed <= single
    clash = docs.select("doc_id", "text", F.lit("x").alias("tokens"), F.lit(1).alias("piece"), F.lit(2).alias("length"))
    assert packing.best_fit_packing(clash).count() == len(rows)


def test_ann_query_recall_on_the_table(spark, sf):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in common.table(spark, sf, "embeddings").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got = defaultdict(list)
    for r in catalog.op7_ann(spark, sf).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    recall = []
    for q in ids[ids % 20 == 0]:
        score = x @ x[ids == q][0]
        best = [i for i in ids[np.lexsort((ids, -score))] if i != q][:20]
        assert [k for k, *_ in sorted(got[q])] == list(range(1, len(best) + 1))
        recall.append(len({v for _, v, _ in got[q]} & set(best)) / len(best))
    assert np.mean(recall) >= 0.9 and set(got) == {int(i) for i in ids[ids % 20 == 0]}


def brute_models(texts, labels):
    """Interpolated Kneser-Ney by the book, with dictionaries: (pairs, continuation counts, contexts) of each class."""
    words = {d: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower()) for d, t in texts.items()}
    shared = Counter(w for ws in words.values() for w in set(ws))
    classes = []
    for t in (0, 1):
        pairs = Counter(p for d, ws in words.items() if labels.get(d) == t for p in zip([None, *ws], ws))
        before, kinds, after = Counter(), Counter(), Counter()
        for (v, w), n in pairs.items():
            before[v] += n
            kinds[v] += 1
            after[w] += 1
        classes.append((pairs, before, kinds, after))
    n_shared = sum(shared.values())

    def lower(t, w):
        after = classes[t][3]
        n = sum(after.values())
        freed = min(toxicity.DISCOUNT_WORD * len(after) / n, 1.0)
        return max(after[w] - toxicity.DISCOUNT_WORD, 0) / n + freed * shared[w] / n_shared

    def p(t, v, w):
        pairs, before, kinds, _ = classes[t]
        if not before[v]:
            return lower(t, w)
        return max(pairs[v, w] - toxicity.DISCOUNT_PAIR, 0) / before[v] + toxicity.DISCOUNT_PAIR * kinds[v] / before[v] * lower(t, w)

    return words, shared, p


def test_toxicity_models_against_brute_force(spark, docs):
    rng = random.Random(1)
    texts = {d: " ".join(rng.choices(["one", "two", "three", "four", "bad", "worse"], [5, 4, 3, 2, 1 + 3 * (d % 3 == 0), 1], k=rng.randint(1, 30))) for d in range(80)}
    texts |= {100: "only here", 101: "nobody labels five"}
    labels = {d: int(d % 3 == 0) for d in range(80)}
    model = toxicity.fit(docs(list(texts.items())), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    words, shared, p = brute_models(texts, labels)
    for t in (0, 1):  # what follows a word sums to one, whether the class has seen the word or not
        for v in ("one", "bad", None, "nobody"):
            assert math.isclose(sum(p(t, v, w) for w in shared), 1, rel_tol=1e-9)
    import pyarrow as pa

    from sediment.llm import words as places

    for d in list(range(10)) + [101]:
        data, begins = places.bytes_of(pa.array([texts[d].encode()], pa.binary()))
        starts, ends, first = places.spans(data, begins, places.LETTERS)
        got, _ = model.differences(places.hashes(data, starts, ends), first)
        seen = [w if w in {x for k in range(80) for x in words[k]} else None for w in words[d]]
        want = [math.log(p(1, v, w)) - math.log(p(0, v, w)) for v, w, s in zip([None, *words[d]], words[d], seen) if s]
        assert np.allclose([g for g, s in zip(got, seen) if s], want)


def test_toxicity_of_repeated_rows_and_a_very_long_text(spark, docs):
    texts = [(d, "good plain words here" if d % 2 else "slur insult words here") for d in range(60)]
    label = spark.createDataFrame([(d, int(d % 2 == 0)) for d in range(60)], "doc_id long, toxic int")
    long = "good plain words here " * 100_000
    df = docs([*texts, texts[0], texts[0], (70, long), (71, long + "slur insult")])
    model = toxicity.fit(df, label)
    got = defaultdict(list)
    for r in toxicity.toxicity(df, model).collect():
        got[r.doc_id].append(r.toxicity)
    assert len(got[0]) == 3 and len(set(got[0])) == 1 and got[0][0] > 0.7 > got[1][0]
    assert len(got[70]) == 1 and got[70][0] < 0.7 and got[71][0] >= got[70][0]


def test_chat_of_a_long_conversation(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    shorter = rows.where(f"turn < {n - 1}").withColumn("conv_id", F.lit(2).cast("long"))
    (only,) = chat_format.maximal(rows.unionByName(shorter)).select("conv_id", "n_turns", F.size("turns").alias("size")).collect()
    assert tuple(only) == (1, n, n)


def test_media_of_clashing_columns(spark):
    df = spark.createDataFrame([(1, "abc", 7, "f"), (1, None, 8, "g")], "doc_id long, text string, n_bytes int, feature string")
    assert sorted((r.doc_id, r.n_bytes, r.payload_bytes) for r in media.media_columns(df).collect()) == [(1, 0, 192), (1, 3, 192)]


def test_pipeline_carries_all_columns_and_odd_rows(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    text = "\n".join(f"line {i} of a text that stands here twice" for i in range(12))
    rows = [(1, text, "mine", 7, "x"), (2, text, "yours", 8, "y"), (3, None, None, None, None), (None, "", "", 0, ""), (4, "short one", "a", 1, "b"), (4, "another with that id", "c", 2, "d")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, n_removed int, toxicity string").withColumn("n_words", F.lit("w"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema], name
        kept = {(r.doc_id, r.n_lines, r.n_removed, r.toxicity, r.n_words) for r in out.collect()}
        assert kept <= {(d, a, b, c, "w") for d, _, a, b, c in rows}, name
        assert len(kept) == (4 if name == "simhash" else 6), name
        assert stage(spark, odd.limit(0), sf).count() == 0
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, odd, sf).collect()} == {1, 2, 3, 4, None}


def test_pipeline_runs_over_the_whole_table(spark, sf):
    """What is packed are the words of the documents that brute force keeps, stage by stage."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    packed = Counter()
    for r in corpus_pipeline.run(spark, sf).collect():
        packed[r.doc_id] += r.length
    docs = common.table(spark, sf, "documents")
    score = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    lines = corpus_pipeline.STAGES[1][1](spark, score, sf)
    one = near_copies.near_dedup(lines.select("doc_id", "text"))
    cut = corpus_pipeline.STAGES[3][1](spark, one, sf)
    assert packed == Counter({r.doc_id: len(WORD.findall(r.text or "")) for r in cut.collect()})
