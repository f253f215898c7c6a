import hashlib
import random

import pyarrow as pa
import pytest
from brute import SF, lines, near, near_by_prefixes, shingle_set, substring
from corvane.llm import exact_dedup, line_dedup, near_dedup, substring_dedup


def corpus(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def text(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def planted(spark, seed=5):
    """Shared passages, copies, texts that repeat themselves, one word over and over, short, empty and null texts."""
    rng = random.Random(seed)
    passages = [text(rng, n) for n in (20, 21, 35, 60, 200)]
    rows = []
    for i in range(120):
        parts = [text(rng, rng.randrange(0, 90)) for _ in range(3)]
        for _ in range(rng.randrange(0, 3)):
            parts.insert(rng.randrange(3), rng.choice(passages))
        rows.append((i, rng.choice([" ", "\n", "\t \n"]).join(parts)))
    rows += [(200, "a " * 70), (201, "a " * 45 + "b"), (202, "a b " * 40), (203, ""), (204, None), (205, "  \n "), (206, rows[3][1]), (207, rows[3][1]), (208, text(rng, 19)), (209, passages[0])]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string")


# ---------------------------------------------------------------- substrings


@pytest.mark.parametrize("make", [planted, corpus])
def test_substring_dedup_equals_brute_force(spark, make):
    docs = make(spark)
    expected = substring(rows_of(docs))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.substring_dedup(docs, digest=True).collect()}
    assert {k: v for k, v in got.items() if v != expected[k]} == {} and got.keys() == expected.keys()


def test_substring_dedup_does_not_depend_on_batches(spark):
    docs = planted(spark, 9)
    want = sorted(map(tuple, substring_dedup.substring_dedup(docs).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert sorted(map(tuple, substring_dedup.substring_dedup(docs.repartition(7)).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_substring_dedup_odd_rows(spark):
    t = text(random.Random(1), 30)
    docs = spark.createDataFrame([(None, t, "x"), (1, t, "y"), (1, t, "z"), (2, t, None)], "doc_id long, text string, n_words string")
    got = sorted(((r["doc_id"] or 0), r["n_removed"]) for r in substring_dedup.substring_dedup(docs).collect())
    assert got == [(0, 0), (1, 30), (1, 30), (2, 30)]
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0


def thue_morse(n=1024):
    """Two words of n letters that a polynomial modulo 2**64 can't tell apart, whatever its base."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse_stay_apart(spark):
    x, y = thue_morse()
    shared = " ".join(f"w{k}" for k in range(19))
    rows = [(1, f"{shared} {x}"), (2, f"{shared} {y}"), (3, f"p q {x}"), (4, f"p q {y}"), (5, f"z {shared} {y}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: n for i, (_, n, _) in substring(rows).items()}
    assert want == {1: 0, 2: 0, 3: 0, 4: 0, 5: 20}
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(docs).collect()} == want
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(docs).collect()}
    assert got[3] == 3 and got[4] == 4 and got == {i: c for i, (_, c) in near(rows, 80).items()}


def test_crowded_anchors_open_alike(spark):
    """One frequent run of words in very many contexts, a few of them equal."""
    rng = random.Random(12)
    hot = "h1 h2 h3 h4 h5 h6 h7 h8"
    rows = [(i, f"{text(rng, 14)} {hot} {text(rng, 14)}") for i in range(200)]
    rows += [(200 + i, rows[i][1]) for i in range(0, 60, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {i: v[1] for i, v in substring(rows).items()}
    assert sum(map(bool, want.values())) == 20
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(docs).collect()} == want


def test_nonbranching_paths_are_compacted(spark):
    runs = [(9, 5, 3, 1, 0), (9, 8, 4, 1, 3), (9, 12, 2, 1, 50), (8, 0, 7, 1, 0), (7, 0, 3, 1, 47), (7, 3, 5, 1, 50), (6, 0, 2, 2, 0), (6, 2, 2, 2, 2)]
    spans = [tuple(r) for r in substring_dedup.compacted(spark.createDataFrame(runs * 2, "_id long, start int, n int, src_id long, src_start int")).collect()]
    got = sorted(r for r in spans if r[3] is not None)
    assert {r[:3] for r in spans if r[3] is None} == {(r[3], r[4], r[2]) for r in got}
    # the jump from (1, 6) to (1, 50) cuts the path that goes straight through (1, 50), and would cut one through (1, 7)
    assert got == [(6, 0, 4, 2, 0), (7, 0, 3, 1, 47), (7, 3, 5, 1, 50), (8, 0, 7, 1, 0), (9, 5, 7, 1, 0), (9, 12, 2, 1, 50)]


def test_paths_do_not_depend_on_batches(spark):
    rng = random.Random(3)
    runs = []
    for i in range(40):
        at = 0
        while at < 900:
            n, src = rng.randrange(1, 60), rng.choice([1, 1, 1, 2])
            runs.append((100 + i, at, n, src, at if rng.random() < 0.9 else at + rng.randrange(1, 700)))
            at += n + rng.choice([0, 0, 0, 5])
    frame = spark.createDataFrame(runs, "_id long, start int, n int, src_id long, src_start int")
    want = sorted(tuple(r) for r in substring_dedup.compacted(frame).collect() if r[3] is not None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(tuple(r) for r in substring_dedup.compacted(frame).collect() if r[3] is not None) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    places = lambda rows: {(i, s + k, j, t + k) for i, s, n, j, t in rows for k in range(n)}
    assert places(want) == places(runs)
    begins, ends = {(j, t) for _, _, _, j, t in want}, {(j, t + n) for _, _, n, j, t in want}
    by = {}
    for i, s, n, j, t in sorted(runs):
        if (i, s) in by and by[i, s] != (j, t):  # a jump: no path goes through either place
            for c in (by[i, s], (j, t)):
                assert not any(x == c[0] and a < c[1] < a + m for _, _, m, x, a in want)
        by[i, s + n] = (j, t + n)
    assert begins and ends


def test_spans_of_other_words_are_not_verified(spark):
    t = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, t), (2, t), (3, t + " x")], "doc_id long, text string")
    spans = [(2, 0, 11, 1, 0), (3, 1, 11, 1, 0), (3, 11, 1, 1, 10), (3, 2, 3, 1, 2), (1, 0, 11, None, None), (1, 10, 1, None, None), (1, 2, 3, None, None)]
    got = substring_dedup.verified(spark.createDataFrame(spans, "_id long, start int, n int, src_id long, src_start int"), docs)
    assert sorted(map(tuple, got.collect())) == [(2, 0, 11, 1, 0), (3, 2, 3, 1, 2)]


# ---------------------------------------------------------------- lines


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice(["", "p", "q", "r", "s", " ", "t u"]) for _ in range(rng.randrange(0, 14)))) for i in range(60)] + [(100, None), (101, ""), (102, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == lines(rows)


def test_fewer_lines_travel_than_runs(spark):
    docs = corpus(spark)
    places = line_dedup.fingerprints(docs).selectExpr("_id", "pos", "runs").collect()
    runs = {(r["_id"], x["at"]): r["pos"] for r in places for x in r["runs"] if x["n"] == 3}
    sizes = {i: len([x for x in (t or "").split("\n") if x.strip(" \t\r\f\v")]) for i, t in rows_of(docs)}
    assert runs.keys() == {(i, at) for i, n in sizes.items() for at in range(n - 2)}
    assert all(at <= pos < at + 3 for (_, at), pos in runs.items())
    short = line_dedup.fingerprints(docs, long=10**6).count()
    assert short < 0.7 * len(runs) and len(places) <= sum(sizes.values())


def test_repeats_of_one_or_two_long_lines_go(spark):
    rng = random.Random(11)
    words = lambda n: " ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(10**6)) for _ in range(n))
    passage, left, right, almost = words(50), words(30), words(20), words(49)
    rows = [(1, f"one\n{passage}\ntwo"), (2, passage), (3, f"x\n{left}\n{right}\ny"), (4, f"{left}\n\n{right}"), (5, f"p\n{almost}"), (6, f"{almost}\nq"), (7, f"{left}\nz\n{right}"), (8, passage + "\u00a0more"), (9, f"\t{passage}"), (10, f"{passage}\n{passage}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == lines(rows)
    assert [i for i, t in rows if got[i] != t] == [2, 4, 10] and got[2] == got[10] == got[4] == ""


def test_line_dedup_of_random_line_lengths_equals_brute_force(spark):
    rng = random.Random(12)
    pool = [" ".join(f"{k}w{j}" for j in range(n)) for k, n in enumerate((1, 5, 24, 25, 26, 49, 50, 51, 80))] + ["", " \t"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.4 else f"own {i} {k} " + "v " * rng.choice((1, 20, 60)) for k in range(rng.randrange(0, 12)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for long in (50, 30):
        assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, long=long).collect()} == lines(rows, long=long)


def test_line_dedup_odd_rows(spark):
    t = "a\nb\nc\nd"
    docs = spark.createDataFrame([(None, t, "x"), (1, t, "y"), (1, t, "y"), (2, "z", None)], "doc_id long, text string, _fp string")
    got = sorted((r["doc_id"] or 0, r["text"], r["_n_removed"]) for r in line_dedup.dedup_lines(docs).collect())
    assert got == [(0, t, 0), (1, "", 4), (1, "", 4), (2, "z", 0)]
    same = docs.filter("doc_id = 1")
    assert [r["text"] for r in line_dedup.dedup_lines(same).collect()] == [t, t]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- near copies


def test_near_dedup_finds_every_link_among_ten_thousand_documents(spark):
    rng = random.Random(13)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    for i, text in [(i, t) for i, t in rows if t and i % 10 == 3]:  # variants on both sides of the threshold
        words = text.split()
        for at in rng.sample(range(len(words)), int(rng.uniform(0.005, 0.018) * len(words))):
            words[at] = f"changed{rng.randrange(10**9)}"
        rows.append((10**6 + i, " ".join(words)))
    want, links = near_by_prefixes(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(docs, percent=85).collect()}
    lost = {i: (got[i], want[i]) for i in want if got[i] != want[i]}
    print("links", links, "lost", len(lost))
    assert not lost and got.keys() == want.keys() and links > 300, (len(lost), links)


def family(rng, n, words=80, changes=2):
    base = text(rng, words, 5000).split()
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(changes + 1)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def near_rows(seed=4):
    rng = random.Random(seed)
    texts = [t for n in (2, 2, 3, 5, 8, 40) for t in family(rng, n)] + [text(rng, 60, 5000) for _ in range(60)] + ["", None, " \n", "one two", "ONE two", "one two three four five", "İx a b c d", "i̇x a b c d"]
    texts += texts[:6]
    rng.shuffle(texts)
    return [*enumerate(texts)]


def test_near_dedup_equals_brute_force(spark):
    for rows in (near_rows(), rows_of(corpus(spark))):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
        expected = {i: (n, c, c == i) for i, (n, c) in near(rows).items()}
        assert {i: (v, expected[i]) for i, v in got.items() if v != expected[i]} == {} and len(got) == len(expected)


def test_crowded_regions_keep_their_links(spark):
    rng = random.Random(2)
    rows = [*enumerate(family(rng, 150, 90, 1) + family(rng, 30, 90, 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(docs, percent=85, region=8).collect()}
    assert got == {i: c for i, (_, c) in near(rows).items()}


def star(rng, n, words=200, changes=3):
    """A text and n variants of it, each with changed words of its own: near to the text, not to each other."""
    base = text(rng, words, 5000).split()
    out = [" ".join(base)]
    for k in range(n):
        own = list(base)
        for at in rng.sample(range(5, words - 5, 5), changes):
            own[at] = f"y{k}x{at}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("n", [100, 3000])
def test_variants_of_one_text_are_joined_to_it(spark, n):
    rng = random.Random(n)
    texts = star(rng, n)
    sets = [shingle_set(t) for t in texts]
    assert all(100 * len(s & sets[0]) >= 85 * len(s | sets[0]) for s in sets) and 100 * len(sets[1] & sets[2]) < 85 * len(sets[1] | sets[2])
    rows = [*enumerate(texts + [text(rng, 60, 5000) for _ in range(20)])]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    assert got == {i: 0 if i <= n else i for i, _ in rows}
    if n == 100:
        assert got == {i: c for i, (_, c) in near(rows).items()}


def test_blocks_of_a_region_meet(spark):
    rng = random.Random(7)
    rows = [*enumerate(star(rng, 60) + star(rng, 40))]
    texts = near_dedup.keyed_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = texts.mapInArrow(near_dedup._sets(5, near_dedup.TREES, near_dedup.DEPTH), near_dedup._SETS)
    links = near_dedup.across(sets, spark.createDataFrame([], "node long, root long"), texts, percent=85, docs=8)
    assert {r["node"]: r["root"] for r in near_dedup.components(links).collect()} == {i: 0 if i < 61 else 61 for i in range(102) if i not in (0, 61)}


def test_partners_of_a_hub_are_dealt_out(spark):
    rng = random.Random(5)
    rows = [*enumerate(star(rng, 70))]
    docs = near_dedup.keyed_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    pairs = [(0, k) for k in range(1, 71)] + [(1, 2), (3, 9)]
    found = near_dedup.confirmed(spark.createDataFrame(pairs, "x long, y long"), docs, percent=85, slot=8)
    assert sorted(map(tuple, found.collect())) == pairs[:70]


def test_near_dedup_odd_rows(spark):
    t = text(random.Random(1), 30)
    docs = spark.createDataFrame([(None, t, "x"), (5, t, "y"), (5, t, "y"), (6, None, "z")], "doc_id long, text string, n string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_dedup.near_dedup(docs).collect())
    assert got == [(0, 0, True), (5, 0, False), (5, 0, False), (6, 6, True)]
    assert near_dedup.near_dedup(docs.limit(0)).count() == 0


def test_shingles_are_counted_like_sets():
    for t in ("a b c d e a b c d e f", "A b C d e", "x", "", "é È b c d e"):
        assert [len(x) for x in near_dedup.shingle_sets(pa.array(["", t, "q"]))] == [0, len(shingle_set(t)), 1]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95)], "x long, y long")
    got = {r["node"]: r["root"] for r in near_dedup.components(links).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {100: 90, 95: 90}


# ---------------------------------------------------------------- exact copies


def exact_rows():
    rng = random.Random(6)
    long = text(rng, 9000)
    return [(1, long), (2, long), (3, long[:-1]), (4, "a"), (5, "a"), (6, ""), (7, None), (8, "a "), (9, "x" * 70_000), (10, "x" * 70_000), (11, "x" * 70_001), (4, "a")]


def test_exact_dedup_equals_grouping_by_text(spark):
    rows = exact_rows()
    docs = spark.createDataFrame([(*r, "c") for r in rows] + [(None, "a", "c")], "doc_id long, text string, recipe string")
    groups = {}
    for i, t in [*rows, (None, "a")]:
        groups.setdefault(t or "", []).append(i)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows) + 1
    shas = {hashlib.sha256(t.encode()).hexdigest(): own for t, own in groups.items()}
    for r in got:
        own = shas[r["text_sha256"]]
        keep = max(x for x in own if x is not None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(own), r["doc_id"] == keep)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_cuts_follow_the_content():
    rng = random.Random(3)
    data = bytes(rng.randrange(256) for _ in range(60_000))
    one, two = exact_dedup.cut_points(data), exact_dedup.cut_points(b"some bytes before" + data)
    assert len({x + 17 for x in one} & {*two}) > len(one) // 2
    sizes = [b - a for a, b in zip([0, *one], one, strict=False)]
    assert one[-1] == len(data) and max(sizes) <= exact_dedup.MAX_CHUNK and min(sizes[:-1]) >= exact_dedup.MIN_CHUNK


def test_a_clash_of_identifiers_does_not_join_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa")], "doc_id long, text string")
    clash = spark.createDataFrame([(exact_dedup._signed64(exact_dedup.xxhash.xxh3_64_intdigest(x)), 2, x, 1) for x in (b"aa",)] + [(exact_dedup._signed64(exact_dedup.xxhash.xxh3_64_intdigest(b"aa")), 2, b"zz", 1)], "h long, n int, chunk binary, sent long")
    monkeypatch.setattr(exact_dedup, "chunk_store", lambda _: clash)
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(docs).collect()} == {1: 3, 2: 2, 3: 3}
