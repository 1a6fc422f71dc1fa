"""Line dedup, SimHash near-dedup and substring dedup against brute force."""

import random
import re

import pytest
import xxhash

from oracle import compare
from sediment.llm import catalog, line_dedup, simhash, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_line_dedup_query(spark, sf):
    compare(catalog.op1_line_dedup, catalog.OP1_SQL, spark, sf)


def test_line_dedup_cases(docs):
    rows = [
        (1, "a\nb\nc\nd"), (2, "x\nb\nc\nd\ny"), (3, None), (4, ""), (5, "a\nb"), (6, "r\nr\nr\nr\nr"), (7, "\n\n\n\n"), (8, "\n\n\n\n"),
        (9, "same\none\ntwo"), (9, "same\none\ntwo"), (None, "q\nw\ne"), (10, "q\nw\ne"), (11, "a\nb\nc\nd\n" + "\n".join(map(str, range(3000)))),
    ]
    df = docs([(*r, 1, "z") for r in rows], "doc_id long, text string, pos int, n_lines string")
    got = {}
    for r in line_dedup.line_dedup(df).collect():
        got.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.n_removed))
    assert got[1] == [("a\nb\nc\nd", 4, 0)] and got[2] == [("x\ny", 5, 3)]
    assert got[3] == [(None, 0, 0)] and got[4] == [("", 1, 0)] and got[5] == [("a\nb", 2, 0)]
    assert got[6] == [("r\nr\nr", 5, 2)] and got[7] == got[8] == [("\n\n\n\n", 5, 0)]
    assert got[9] == [("same\none\ntwo", 3, 0)] * 2
    assert got[None] == [("q\nw\ne", 3, 0)] and got[10] == [("", 3, 3)]
    assert got[11][0][2] == 4
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def brute_fingerprint(text, k=3):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


@pytest.mark.parametrize("text", ["", None, "one", "One TWO", "a b c", "a b c d É\x85f \x1cx", "x " * 70000, "\x0b\x0c"])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def brute_components(ids, prints):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def nodes_of(spark, prints):
    return spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()], "doc_id long, fp long")


@pytest.mark.parametrize("few", [32, 2])
def test_components_of_fingerprints(spark, monkeypatch, few):
    """Clouds around a few centres, so that postings are large, and pairs that differ in each possible place."""
    rng = random.Random(few)
    centres = [rng.getrandbits(64) for _ in range(4)]
    values = [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(60)]
    values += [0, 1, (1 << 63) | 7, 0xFFFFFFFF00000000, 0xFFFFFFFF00000003]
    prints = dict(enumerate(values))
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: nodes_of(spark, prints))
    got = {r.doc_id: r.component_id for r in simhash.near_components(spark.createDataFrame([(1, "")], "doc_id long, text string")).collect()}
    assert got == brute_components(sorted(prints), prints)


def test_near_dedup_cases(docs):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text), (3, text + " more"), (8, None), (9, ""), (2, "quite another text than those"), (None, text), (4, " \n")]
    df = docs([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    assert sorted(r.doc_id for r in simhash.near_dedup(df).collect()) == [2, 3, 4]
    assert simhash.near_dedup(df.limit(0)).count() == 0


def brute_substring(rows):
    seen, out = {}, {}
    for d, text in sorted(rows):
        words = WORD.findall(text or "")
        keys = [tuple(words[i : i + 50]) for i in range(len(words) - 49)]
        gone = {j for i, k in enumerate(keys) if seen.get(k, d) < d for j in range(i, i + 50)}
        for k in keys:
            seen.setdefault(k, d)
        out[d] = (len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone))
    return out


def passages(seed):
    rng = random.Random(seed)
    some = [[f"p{p}w{rng.randrange(30)}" for _ in range(rng.randint(40, 130))] for p in range(6)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [f"d{d}x{rng.randrange(9)}" for _ in range(rng.randint(0, 30))]
            p = list(rng.choice(some))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "edited"
            words += p[rng.randrange(3) :]
        rows.append((d, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(100 + d, "same " * 120) for d in range(3)] + [(110, "a b " * 60), (111, "a b " * 70), (112, ""), (113, "é " * 49)]
    return rows


@pytest.mark.parametrize("batches", [1, 4])
def test_substring_dedup(docs, batches):
    rows = passages(batches)
    got = substring_dedup.substring_dedup(docs(rows), batches=batches).collect()
    want = brute_substring(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, " ".join(WORD.findall(r.text))) for r in got} == want
    unchanged = {d: t for d, t in rows if not want[d][1]}
    assert {r.doc_id: r.text for r in got if r.doc_id in unchanged} == unchanged


def test_substring_query(spark, sf):
    compare(catalog.op4_substring_dedup, catalog.OP4_SQL, spark, sf)


def test_substring_dedup_cases(docs):
    text = " ".join(f"w{i}" for i in range(60))
    df = docs([(None, text, 1), (1, text, 2), (2, None, 3), (3, text, 4), (3, text, 5)], "doc_id long, text string, start int")
    got = sorted((r.doc_id or 0, r.text, r.n_removed, r.start) for r in substring_dedup.substring_dedup(df).collect() if r.text is not None)
    assert got == [(0, text, 0, 1), (1, "", 60, 2), (3, "", 60, 4), (3, "", 60, 5)]
    assert substring_dedup.substring_dedup(df.limit(0)).count() == 0


def test_substring_index_is_compacted(spark, docs):
    index = substring_dedup.FingerprintIndex(spark, fan_in=3)
    rows = passages(9)
    for k in range(2):
        part = docs(rows[k * 20 : k * 20 + 20])
        substring_dedup.ingest(index, part, docs(rows[: k * 20 + 20]))
    assert len(index.runs(0)) == 2
    before = {(r.anchor, r.c1, r.c2): r.d for n in index.runs() for r in index.run(n).collect()}
    index.fan_in = 2
    index.compact()
    assert index.runs(0) == [] and len(index.runs(1)) == 1
    assert {(r.anchor, r.c1, r.c2): r.d for r in index.run(index.runs()[0]).collect()} == before
    index.drop()


def test_two_jobs_with_one_index_cut_what_one_job_cuts(spark, docs, tmp_path):
    rows = sorted((d, t) for d, t in passages(5))
    first, whole = docs(rows[:35]), docs(rows)
    index = substring_dedup.FingerprintIndex(spark, f"file://{tmp_path}/index")
    got = substring_dedup.dedup_batch(index, first, first).collect()
    for name in index.runs():  # another application knows no table of the runs
        spark.sql(f"DROP TABLE {name}")
    again = substring_dedup.FingerprintIndex(spark.newSession(), f"file://{tmp_path}/index")
    got += substring_dedup.dedup_batch(again, docs(rows[35:]), whole).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, " ".join(WORD.findall(r.text))) for r in got} == brute_substring(rows)
    assert len(again.runs()) == 2 and "Sort [anchor" not in again.matching(again.run(again.runs()[0]))._jdf.queryExecution().executedPlan().toString()


def test_substring_dedup_takes_whole_numbers_alone(docs):
    with pytest.raises(TypeError):
        substring_dedup.substring_dedup(docs([("a", "b")], "doc_id string, text string"))


def brute_near(rows):
    """The doc_ids that stay where five-word sets with a Jaccard similarity of 0.8 or more are linked."""
    sets = {}
    for d, text in rows:
        words = WORD.findall(text.lower())
        sets[d] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}
    name = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and name[a] != name[b]:
                low, high = sorted((name[a], name[b]))
                name = {d: low if n == high else n for d, n in name.items()}
    return sorted(set(name.values()))


def test_pipeline_stage_links_near_copies_by_jaccard(spark, docs):
    """Copies with a few words changed, of many lengths, some just above 0.8 and some just below, beside a common passage."""
    import corpus_pipeline

    rng, rows = random.Random(3), []
    common_lines = [f"licence{i}" for i in range(30)]
    for base in range(30):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 6, 12, 40, 90, 300]))] + (common_lines if base % 3 == 0 else [])
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), rng.choice([" ", "\n"]).join(copy)))
    got = sorted(r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs(rows), "").collect())
    assert got == brute_near(rows)
    three_bits = {r.doc_id for r in simhash.near_dedup(docs(rows)).collect()}
    assert three_bits != set(got)


@pytest.mark.parametrize("module", ["simhash", "near_copies"])
def test_one_row_of_each_component_where_ids_repeat(docs, module):
    """Copies under one id or none, and an id that stands in two components and names one of them."""
    from sediment.llm import near_copies

    near_dedup = {"simhash": simhash, "near_copies": near_copies}[module].near_dedup
    a, b, c = (" ".join(f"{x}{i}" for i in range(200)) for x in "abc")
    rows = [(5, a), (5, a), (5, a + " more"), (1, b), (5, b), (None, c), (None, c), (7, a)]
    got = sorted((r.doc_id or 0, r.text[0]) for r in near_dedup(docs([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, k int")).collect())
    assert got == [(0, "c"), (1, "b"), (5, "a")]


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup_of_different_texts_under_one_id(docs, batches):
    """What repeats in one text is cut out of that only, whether its context is settled as a whole or window by window."""
    a, b = (" ".join(f"{x}{i}" for i in range(120)) for x in "ab")
    tail = " ".join(f"t{i}" for i in range(30))
    edited = a.replace("a90", "edited")
    rows = [(1, a), (2, a), (2, b), (2, tail + " " + a), (3, b), (3, edited), (4, b + " " + tail), (None, tail)]
    got = sorted((r.doc_id or 0, r.n_removed, r.n_words, " ".join(r.text.split())) for r in substring_dedup.substring_dedup(docs(rows), batches=batches).collect())
    want = [(0, 0, 30, tail), (1, 0, 120, a), (2, 120, 120, ""), (2, 0, 120, b), (2, 120, 150, tail), (3, 120, 120, ""), (3, 90, 120, " ".join(["edited", *(f"a{i}" for i in range(91, 120))])), (4, 120, 150, tail)]
    assert got == sorted(want)


def edited(seed, groups, copies, lengths=(40, 90, 300), every=25):
    """Copies of a few texts, one word in ``every`` changed at most: some just above a similarity of 0.8, some below."""
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice(lengths))]
        for _ in range(copies):
            copy = list(words)
            for _ in range(rng.randint(0, len(words) // every)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("parts", [2, 3, 4])
def test_signatures_join_what_lies_within_their_distance(spark, parts):
    rng, prints = random.Random(parts), set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(6):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))))
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    want = {p: p for p in prints}
    got = dict(want)

    def join(name, a, b):
        low, high = sorted((name[a], name[b]))
        for p in prints:
            name[p] = low if name[p] == high else name[p]

    for a in prints:
        for b in prints:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2 * parts - 1:
                join(want, a, b)
    for r in simhash.forest(spark.createDataFrame([(p, p) for p in prints], "fp long, label long"), parts).collect():
        assert ((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 2 * parts - 1
        join(got, r.a, r.b)
    assert got == want and len(set(want.values())) < len(prints)


def test_pipeline_stage_links_by_fingerprints_first(spark, docs, monkeypatch):
    """Of what the stage links, signatures give some and the sets the rest; together they are the brute force's."""
    import corpus_pipeline
    from sediment.llm import near_copies

    given, verified = [], near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, sets: given.append(verified(pairs, sets).collect()) or verified(pairs, sets))
    rows = edited(8, groups=20, copies=4)
    got = sorted(r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs(rows), "").collect())
    assert got == brute_near(rows)
    prints = {r.node: r.text for r in docs(rows).select(near_copies._node().alias("node"), "text").collect()}
    bits = [(simhash.fingerprint(prints[r.a].encode(), 5) ^ simhash.fingerprint(prints[r.b].encode(), 5)).bit_count() for r in given[0]]
    assert len(given) == 1 and 0 < len(bits) < len({t for _, t in rows}) - len(got) and max(bits) <= 5


@pytest.mark.parametrize("block", [None, 7])
def test_large_group_of_near_copies_never_becomes_its_pairs(spark, docs, monkeypatch, block):
    """Many texts about a similarity of 0.8 from each other, in one block and in many."""
    from sediment.llm import common, near_copies

    if block:
        for name, value in {"FEW": 3, "BLOCK": block, "LEAST": block, "SPREAD": 1, "MOST": block}.items():
            monkeypatch.setattr(near_copies, name, value)
    rows = edited(4, groups=2, copies=150, lengths=(150,))
    sizes, materialise = {}, common.materialise

    def counted(df, name, **k):
        sizes.setdefault(name, []).append((out := materialise(df, name, **k)).count())
        return out

    monkeypatch.setattr(common, "materialise", counted)
    got = sorted(r.doc_id for r in near_copies.near_dedup(docs(rows)).collect())
    assert got == brute_near(rows) and 2 < len(got)
    blocks = -(-len(rows) // block) if block else 1
    assert sizes["candidates"][0] > 0 and max(sizes["pairs"][0], sizes["candidates"][0], sizes["edges"][-1]) <= len(rows) * blocks
