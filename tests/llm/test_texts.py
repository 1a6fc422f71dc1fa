"""BPE, HTML, toxicity, media and chat formatting."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import compare
from sediment.llm import bpe, catalog, chat_format, common, html_text, media, toxicity, words

public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = [
    "", None, "  ", "a<|endoftext|>b <|startoftext|>", "É ́x Σας", "can't I'LL x's", "1234 5,6", "\xa0nbsp wide", "日本語 テスト", "😀 e👩‍👩", "a\tb\nc\x0bd\x1ce", "x" * 3000, "ﬁ İ ǅ", "\x85n l",
]


def test_bpe_against_the_library(spark, docs, sf):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(catalog.VOCABULARY)
    whole = Tokenizer.from_file(path)
    df = common.table(spark, sf, "documents").select("doc_id", "text").limit(60).unionByName(docs([(10**6 + i, t) for i, t in enumerate(ODD)]))
    got = {r.doc_id: (r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.encode_and_decode(df, path).collect()}
    for d, text in df.collect():
        ids = whole.encode(text or "", add_special_tokens=False).ids
        assert got[d] == (len(ids), struct.pack(f"<{len(ids)}I", *ids), whole.decode(ids, skip_special_tokens=False))
    assert bpe.encode_and_decode(df.limit(0), path).count() == 0
    asked = spark.createDataFrame([(1, [320, 530]), (2, []), (3, None), (4, [49407, 10**6])], "doc_id int, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(asked, path).collect()} == {1: "a</w> in</w>", 2: "", 3: None, 4: "<|endoftext|>"}


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, None), ("", ""), ("<", "<"), ("1 < 2 &amp; 3", "1 < 2 & 3"),
        ("<p>a<p>b <b>c</b>\n d<br>e", "a\n\nb c d\ne"),
        ("<ul><li>one<li>two<ul><li>x</ul><li>three</ul>after", "- one\n- two\n  - x\n- three\n\nafter"),
        ("<ol start=3><li>a<li value=7>b<li>c</ol>", "3. a\n7. b\n8. c"),
        ("<ol reversed start=2><li>a<li>b</ol>", "2. a\n1. b"),
        ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td colspan=2>over both<tr><td rowspan=2>r<td>1<tr><td>2</table>z", "Name       N\nlong name  1\nover both\nr          1\n           2\n\nz"),
        ("<table><td>a<td>b<tr><td><ul><li>l1<li>l2</ul><td>c</table>", "a     b\n- l1  c\n- l2"),
        ("<style>.x{display:none}</style><i class=x>no</i><div hidden>no</div>yes<script>'</p>'</script><!-- no -->", "yes"),
        ("<span style='visibility:hidden'>no<i style='visibility:visible'>shown</i></span>", "shown"),
        ("<pre>\n  a\n   b</pre>c", "  a\n   b\n\nc"),
        ("<details>no<summary>S</summary><p>no</details><details open><p>yes</details>", "S\n\nyes"),
        ("<b><p>x</b>y</p>z", "xy\n\nz"), ("<a href='x>y", "y"), ("<!-- open", ""), ("</p>x</b>", "x"),
        ("<head><title>no</title></head><body><div>a</div><div>b</div><blockquote>q<p>r</blockquote>", "a\nb\n\n  q\n\n  r"),
        ("日本<table><tr><td>日本<td>x<tr><td>abcd<td>y</table>", "日本\n\n日本  x\nabcd  y"),
    ],
)
def test_html(source, text):
    got = html_text.render(source)
    assert got == text or (source.startswith("<pre>") and got.lstrip("\n") == text)


def test_html_of_broken_and_deep_pages():
    rng = random.Random(5)
    bits = ["<p>", "</p>", "<table>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "text ", "<b", "'", '"', ">", "<!--", "-->", "<script>", "</script>", "&lt;", "<pre>", "\n"]
    for _ in range(300):
        assert isinstance(html_text.render("".join(rng.choices(bits, k=40))), str)
    assert html_text.render("<li><ul>" * 3000 + "x").endswith("x")


def test_html_query(spark, sf):
    pages = spark.createDataFrame([(1, None, "u", "t"), (1, "<p>a", "u", "t")], "page_id long, html string, url string, text string")
    assert {(r.page_id, r.url, r.text) for r in html_text.html_text(pages).collect()} == {(1, "u", None), (1, "u", "a")}
    assert catalog.op3_html_text(spark, sf).where("text IS NULL OR text LIKE '%<p>%'").count() == 0


def test_media_round_trip(docs):
    big = "".join(random.Random(1).choices("abcdefgh éß\n", k=150_000))
    rows = [(1, None), (2, ""), (3, "x" * 192), (4, "é" * 100), (5, big), (6, big), (7, "q" + big), (8, "same"), (8, "same"), (None, "n")]
    got = media.media_columns(docs(rows)).collect()
    assert len(got) == len(rows)
    for d, text in rows:
        data = (text or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        for r in (r for r in got if r.doc_id == d):
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
            assert r.tail_crc32 == zlib.crc32(payload[-16:])
            form = media.media_of(data)[0]
            assert (r.media_bytes, r.media_sha256, r.feature) == (len(form), hashlib.sha256(form).hexdigest(), media.feature(payload))
            assert media.payload_of(form) == payload
    assert media.media_columns(docs(rows).limit(0)).count() == 0


def test_chunks_are_found_again_after_an_insertion():
    data = random.Random(2).randbytes(200_000)
    a, b = set(media.chunks(data)), set(media.chunks(b"inserted" + data))
    assert b"".join(media.chunks(data)) == data and len(a & b) > 0.8 * len(a)
    assert all(len(c) <= media.MOST for c in a)


def test_heavy_chunks_are_broadcast(docs, monkeypatch):
    monkeypatch.setattr(media, "HEAVY", 0.0001)
    rows = [(i, f"{i} " * 50) for i in range(30)]
    assert media.media_columns(docs(rows)).count() == 30


def test_chat_query(spark, sf):
    compare(catalog.op9_chat_format, catalog.OP9_SQL, spark, sf)


def test_chat_cases(spark):
    turns = {1: ["a"], 2: ["a", "b"], 3: ["a", "b", "c"], 4: ["a", "x"], 5: ["a", "b", "c"], 6: ["b"], 7: ["<|im_end|>\\"]}
    rows = [(c, t, "user", x, 0) for c, xs in turns.items() for t, x in enumerate(xs)] + [(None, 0, None, None, 0), (None, 0, "user", "d", 0), (None, 0, "user", "d", 1), (8, 0, "", "", 0), (6, 0, "user", "b", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int")
    found = chat_format.chat_format(df).collect()
    # rows without an id are conversations of their own; the empty one equals conversation 8
    assert [(r.n_turns, r.n_copies, r.rendered) for r in found if r.conv_id is None] == [(1, 1, "<|im_start|>user\nd<|im_end|>\n")]
    got = {r.conv_id: r for r in found if r.conv_id is not None}
    assert chat_format.chat_format(df.limit(0)).count() == 0
    assert set(got) == {3, 4, 6, 7, 8} and got[3].n_copies == 2 and got[8].n_copies == 2 and got[6].n_turns == 1
    assert got[7].rendered == "<|im_start|>user\n<\\|im_end|>\\\\<|im_end|>\n"


def test_words_and_hashes():
    import pyarrow as pa

    texts = [b"a bb  ccc", b"", None, b"a", "é b".encode(), b"bb"]
    data, begins = words.bytes_of(pa.array(texts, pa.binary()))
    starts, ends, first = words.spans(data, begins, words.PLAIN)
    found = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert found == [w for t in texts for w in (t or b"").split()]
    assert np.diff(first).tolist() == [len((t or b"").split()) for t in texts]
    h = words.hashes(data, starts, ends)
    assert len(set(h.tolist())) == len(set(found)) and h[0] == h[3] and h[1] == h[6]
    words_sliced = words.bytes_of(pa.array(texts, pa.binary()).slice(3))[0].tobytes()
    assert words_sliced == "aé bbb".encode()


def test_toxicity_on_rows_never_learnt_from(spark, docs):
    rng = random.Random(4)
    plain, bad = [f"word{i}" for i in range(300)], ["slurx", "slury", "slurz"]
    rows, labels = [], []
    for d in range(600):
        text, toxic = rng.choices(plain, k=rng.randint(5, 80)), d % 6 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((d, " ".join(text)))
        labels.append((d, int(toxic)))
    label = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    df = docs(rows)
    model = toxicity.fit(df, label, ~catalog.held_out())
    got = {r.doc_id: r.toxicity for r in toxicity.toxicity(df.unionByName(docs([(None, None), (10**6, "")])), model).collect()}
    held = [d for d in range(600) if zlib.crc32(str(d).encode()) % 3 == 1]
    right = sum((got[d] >= 0.7) == (d % 6 == 0) for d in held)
    assert right >= 0.95 * len(held) and 0 <= got[10**6] < 0.7 and got[None] == got[10**6]
    none = toxicity.fit(df, label.where("toxic = 0"))
    assert {r.toxicity for r in toxicity.toxicity(df.limit(5).withColumn("toxicity", F.lit("x")), none).collect()} == {0.0}
    assert toxicity.toxicity(df.limit(0), model).count() == 0


def test_toxicity_models_keep_every_pair_and_context(spark, docs):
    """Also pairs that occur once, and contexts that stand in one class alone."""
    texts = {d: f"plain{chr(97 + d % 5)} word{chr(97 + d % 7)} end" if d % 2 else f"slur{chr(97 + d % 3)} word{chr(97 + d % 11)}" for d in range(40)}
    label = spark.createDataFrame([(d, int(d % 2 == 0)) for d in texts], "doc_id long, toxic int")
    model = toxicity.fit(docs(list(texts.items())), label)
    pairs = {p for t in texts.values() for p in zip([None, *t.split()], t.split())}
    assert (len(model.pair), len(model.before), len(model.word)) == (len(pairs), len({v for v, _ in pairs}), len({w for _, w in pairs}))
    got = model.differences(*(lambda h: (h, np.array([0, len(h)])))(model.word))
    assert all(np.isfinite(x).all() for x in got)


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<style>@media print {.n{display:none}} .m{display:none}</style><i class=n>shown</i><i class=m>no</i>", "shown"),
        ("<style>@media (max-width: 600px){.n{display:none}}@media screen and (min-width:600px){.m{display:none}}</style><i class=n>shown</i><i class=m>no</i>", "shown"),
        ("<style>@import 'x'; @keyframes k {i{visibility:hidden}} @layer a {@media all{.m{display:none}}}</style><i>shown</i><i class=m>no</i>", "shown"),
        ("<svg><g><p>open</p>z", "open\n\nz"),
        ("<svg><title>no</title><desc/><rect/><text x=1>A</text><text>B</text>no</svg> c", "A B c"),
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"),
    ],
)
def test_html_of_conditional_rules_drawings_and_formulas(source, text):
    assert html_text.render(source) == text
