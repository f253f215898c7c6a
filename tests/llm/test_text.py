import random

import pyarrow as pa
from brute import SF, distance
from corvane.llm import decontaminate, html_text, quality
from hypothesis import given, settings
from hypothesis import strategies as st

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><article>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad 6 --><div class="ad">Buy</div><article><h1>Head &amp; tail</h1><p><b>One  two<br><p>Three&nbsp;four
 five</p><div class="share-box">Share</div><aside>More</aside><ul><li>x<li>y</ul><form><p>Mail</p></form><table><tr><td>1<td>2<tr><td>3</table><pre>a   b</pre>tail</article>
<section id="comments"><p>First!</p></section><footer>&copy; me</footer></body>"""


def test_article_of_a_marked_page():
    assert html_text.extract([PAGE]) == ["Head & tail\nOne two\nThree four five\nx\ny\n1\n2\n3\na b\ntail"]


def test_odd_pages():
    assert html_text.extract(["", "<article></article>", "<article>a<!-- b", "<p>un&lt;closed", "<article><p>x</article", "<article>a < b &#233; &bogus; <3</article>"]) == ["", "", "a", "un<closed", "x", "a < b é &bogus; <3"]


def test_unmarked_pages_are_induced():
    def page(k):
        story = "".join(f"<p>Story {k} part {j} {'word ' * 20}</p>" for j in range(3 + k % 3))
        return f"<html><body><div><p>Welcome to the site</p></div><div class=x><div><h2>Title {k}</h2>{story}<p>All rights kept</p></div></div><div class=sidebar>Hot {k}</div></body></html>"

    got = html_text.extract([page(k) for k in range(8)])
    for k, t in enumerate(got):
        rows = t.split("\n")
        assert rows[0] == f"Title {k}" and len(rows) >= 4 + k % 3 and "Welcome" not in t and "Hot" not in t


def test_sibling_regions_of_unmarked_pages_stay():
    def page(k):
        story = "".join(f"<p>Story {k} part {j} {'word ' * 20}</p>" for j in range(5))
        return f"<html><body><h3>Welcome to the site</h3><section><p>Lead {k}</p></section><div class=main>{story}</div><section><p>More {k}</p></section></body></html>"

    for k, t in enumerate(html_text.extract([page(k) for k in range(8)])):
        assert t.split("\n") == [f"Lead {k}", *[f"Story {k} part {j} {'word ' * 20}".strip() for j in range(5)], f"More {k}"]


def test_template_inside_marked_articles_goes():
    pages = [f"<html><body><article><h1>Title {k}</h1><p>Story {k} {'word ' * 20}</p><h4>Read us daily</h4></article></body></html>" for k in range(8)]
    assert html_text.extract(pages) == [f"Title {k}\n" + f"Story {k} {'word ' * 20}".strip() for k in range(8)]


def test_page_query(spark):
    import re

    got = {r["page_id"]: r for r in html_text.op5_html_text(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = r["html"].split("<article>")[1].split("</article>")[0]
        rows = [" ".join(html_text.entities.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r["page_id"]]["text"].replace(" ", "") == "\n".join(x for x in rows if x).replace(" ", "")
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]


def test_the_wrapper_reads_every_page(spark):
    got = html_text.op5_html_text(spark, SF).collect()
    pages = spark.read.parquet(f"{SF}/pages.parquet").count()
    assert sum(r["n_slots"] > 0 and r["n_chars"] > 0 for r in got) == len(got) == pages


def test_deep_pages_give_text(spark):
    deep = "<div>" * 10_000 + "<p>deep &amp; far</p>" + "</div>" * 10_000
    wide = "".join(f"<div><p>{k}</p></div></b></i>" for k in range(3000))
    assert html_text.extract([deep, deep + "<p>x</p>", f"<ul>{wide}</ul>", "<b>" * 10_000 + "y"])[0] == "deep & far"
    pages = spark.createDataFrame([(1, "http://h.org/a", deep), (2, "http://h.org/b", deep + "<p>x</p>"), (3, "http://h.org/c", "<p>flat</p>")], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.page_texts(pages).collect()} == {1: "deep & far", 2: "deep & far\nx", 3: "flat"}


def test_a_host_shares_its_template_between_cohorts(spark):
    page = lambda k: f"<html><body><div><h4>Read us daily</h4></div><div><h2>Title {k}</h2><p>Story {k}</p></div></body></html>"
    pages = spark.createDataFrame([(k, "http://h.org/a", page(k)) for k in range(9)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.page_texts(pages, cohort=2).collect()} == {k: f"Title {k}\nStory {k}" for k in range(9)}


def test_page_odd_rows(spark):
    pages = spark.createDataFrame([(None, None, None, "x"), (1, "no host", "", "y"), (2, "http://h.org/a", PAGE, None), (2, "http://h.org/a", PAGE, None)], "page_id long, url string, html string, text string")
    got = html_text.page_texts(pages).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got)[:2] == [(0, 0), (1, 0)] and len(got) == 4
    assert html_text.page_texts(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- benchmark passages


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=20), st.text("abcd", max_size=40))
def test_myers_equals_dynamic_programming(pattern, text):
    assert decontaminate.Myers(pattern).best(text) == distance(pattern, text)


def edited(rng, text, edits):
    own = list(text)
    for _ in range(edits):
        k, kind = rng.randrange(len(own)), rng.randrange(3)
        if kind == 0:
            own[k] = "q"
        elif kind == 1:
            del own[k]
        else:
            own.insert(k, "é")
    return "".join(own)


def test_every_passage_within_budget_is_found():
    rng = random.Random(11)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    items = [(i, decontaminate.normalise(say(rng.randrange(4, 40)))) for i in range(30)]
    index = decontaminate.PieceIndex(items, 0.1)
    for i, t in items:
        for edits in (0, 1, decontaminate.budget(t), decontaminate.budget(t) + 12):
            text = decontaminate.normalise(say(30) + " " + edited(rng, t, edits) + " ñ " + say(5))
            d = distance(t, text)
            assert index.search(text).get(i) == (d if d <= decontaminate.budget(t) else None)


def test_leaks_of_the_corpus(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.op6_decontamination(spark, SF).collect()}
    texts = {r["doc_id"]: decontaminate.normalise(r["text"]) for r in docs.collect()}
    items = {r["item_id"]: decontaminate.normalise(r["text"]) for r in bench.collect()}
    exact = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    assert exact and {k for k, v in got.items() if v == 0} == exact
    for (d, i), v in got.items():
        assert distance(items[i], texts[d]) == v
    # near hits both ways, by dynamic programming over every pair of a text and an item that share a run of characters as long as a piece must be
    for d, t in list(texts.items())[:60]:
        for i, x in items.items():
            if len(t) < 4000 and any(x[a:z] in t for a, z in ((len(x) * k // 10, len(x) * (k + 1) // 10) for k in range(10))):
                assert ((d, i) in got) == (distance(x, t) <= decontaminate.budget(x))
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.leaks(docs, bench, block_chars=2000).collect()} == got
    kept = {r["doc_id"] for r in decontaminate.decontaminate(docs, bench, block_chars=2000).collect()}
    assert kept == texts.keys() - {d for d, _ in got}


def test_leaks_odd_rows(spark):
    item = "some benchmark question that is long enough"
    docs = spark.createDataFrame([(None, "x " + item.upper() + " y", 1), (1, None, 2), (2, "", 3), (3, "a" * 3_000_000 + item, 4)], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(7, item), (8, None), (9, " "), (None, item)], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"] or 0, r["distance"]) for r in decontaminate.leaks(docs, bench).collect())
    assert got == [(0, 0, 0), (0, 7, 0), (3, 0, 0), (3, 7, 0)]
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 4 and decontaminate.decontaminate(docs, bench).columns == docs.columns


# ---------------------------------------------------------------- quality


def test_quality_holds_out_and_learns(spark):
    sf = "/root/testdata/sf0.01"
    import zlib

    got = {r["doc_id"]: r for r in quality.op8_quality_classifier(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    held = [i for i in labels if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == labels[i] for i in held) / len(held) > 0.93
    good, bad = ([got[i]["score"] for i in held if labels[i] == y] for y in (1, 0))
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.95  # area under the curve


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(None, "x", 1.0), (1, None, 2.0), (2, "", 3.0), (3, "a" * 2_500_000, 4.0), (3, "b", 5.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 0), (4, 1), (5, 7)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == 5 and all(r["score"] is not None and r["held_out"] is not None for r in got)
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert quality.quality_scores(docs, labels.limit(0)).count() == 5


def test_training_separates_words():
    import numpy as np

    rng = np.random.default_rng(0)
    texts = [(" ".join(rng.choice(["good", "fine", "nice"] if y else ["bad", "junk", "spam"], 20)), y) for y in rng.integers(0, 2, 200)]
    bags = [(*own, int(y)) for own, (_, y) in zip(quality.bags(pa.array([t for t, _ in texts])), texts, strict=True)]
    model = quality.train(bags)
    assert model.score("good nice fine") > 0.9 > 0.1 > model.score("junk spam bad")


def test_scores_are_means_of_the_bag():
    import numpy as np

    texts = ["", "a", "née née née née", "漢字 x y x y 😀", "one two\nthree", " pad  "]
    model = quality.QualityModel(np.random.default_rng(1).normal(size=1 << quality.BITS).astype(np.float32), 0.3)
    got = model.scores(pa.array(texts))
    for t, score, (idx, cnt) in zip(texts, got, quality.bags(pa.array(texts)), strict=True):
        margin = 0.3 + float((model.weights[idx].astype(float) * cnt).sum()) / (cnt.sum() + quality.PRIOR)
        assert abs(score - 1 / (1 + np.exp(-margin))) < 1e-9 and model.score(t) == score
        n = t.split()
        grams = sum(max(len(w) + 3 - g, 0) for w in n for g in quality.GRAMS)
        assert cnt.sum() == len(n) + grams + max(len(n) - 1, 0) + max(len(n) - 3, 0)


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(k, f"w{k} " * (k % 7 + 1)) for k in range(60)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    held = []
    train, quality.train = quality.train, lambda rows, **_: held.append(rows) or quality.QualityModel(np_zeros(), 0.0)
    try:
        for options in ({}, {"sample": 10}, {"pairs": 200}, {"pairs": 3}):
            quality.fit_quality(docs, labels, **options)
    finally:
        quality.train = train
    assert len(held[0]) > 60 and len(held[1]) == 10 and 0 < sum(len(i) for i, _, _ in held[2]) <= 200 and not held[3]


def np_zeros():
    import numpy as np

    return np.zeros(1 << quality.BITS, np.float32)


# ---------------------------------------------------------------- wrappers


def story(k, n=4):
    return "".join(f"<p>Story {k} part {j} {'word ' * 20}</p>" for j in range(n))


def told(k, n=4):
    return "\n".join(f"Story {k} part {j} {'word ' * 20}".strip() for j in range(n))


def test_an_article_that_many_pages_share_stays():
    menu = lambda k: f"<nav><ul><li><a href=/{k}>Menu {k}</a></li></ul></nav><div class=side><a href=/x{k}>Hot story {k}</a></div>"
    for tag in ("article", "div"):
        for extra in ("", "<div>Sponsored text {k}</div>"):
            pages = [f"<html><body>{menu(k)}<{tag}><h1>One title</h1>{story(0)}</{tag}>{extra.format(k=k)}<footer>me</footer></body></html>" for k in range(6)]
            assert html_text.extract(pages) == [f"One title\n{told(0)}"] * 6


def test_headings_and_opening_paragraphs_that_a_series_shares_stay():
    for tag in ("article", "div"):
        pages = [f"<html><body><nav><a href=/>Home</a></nav><{tag}><h1>Title {k}</h1><p>This is our weekly series.</p><h2>Summary</h2>{story(k)}<h2>Details</h2>{story(k + 50, 2)}</{tag}><div><p>About this site</p></div></body></html>" for k in range(8)]
        assert html_text.extract(pages) == [f"Title {k}\nThis is our weekly series.\nSummary\n{told(k)}\nDetails\n{told(k + 50, 2)}" for k in range(8)]


def test_words_in_classes_do_not_cut_the_article():
    inner = '<p class="share-price">Up 3</p><div class="notice-board"><p>On the board</p></div><section id="search-engines"><h3>Engines</h3><p>They search</p></section>'
    pages = [f"<html><body><article><h1>Title {k}</h1>{inner}{story(k)}</article></body></html>" for k in range(6)]
    want = [f"Title {k}\nUp 3\nOn the board\nEngines\nThey search\n{told(k)}" for k in range(6)]
    assert html_text.extract(pages) == want and html_text.extract(pages[:1]) == want[:1]


def test_boxes_that_a_host_marks_on_most_pages_go():
    pages = [f"<html><body><article><h1>Title {k}</h1>{story(k)}<div class='ad'>Buy {k}</div><section class='post-comments'><p>Reader {k} says</p></section></article></body></html>" for k in range(6)]
    pages.append(f"<html><body><article><h1>Title 9</h1><aside class=x>gone</aside><div class='notice'><section><p>Once only</p></section></div>{story(9)}</article></body></html>")
    assert html_text.extract(pages) == [f"Title {k}\n{told(k)}" for k in range(6)] + [f"Title 9\nOnce only\n{told(9)}"]


def test_boxes_beside_the_main_region():
    """Unmarked: a bare advert, a menu without its element and recommendations of links go, a lead and a large second part stay."""
    def page(k):
        return f"<html><body><div><ul><li><a href=/a{k}>Section {k}</a></li><li><a href=/b>More</a></li></ul></div><div>Buy this now {k}</div><div class=lead>In short, {k}</div><div><h1>Title {k}</h1>{story(k)}</div><section><div><p>Second part {k} {'word ' * 30}</p></div></section><div class=recommended><a href=/r{k}>Read on {k}</a></div><div>&copy; me</div></body></html>"

    assert html_text.extract([page(k) for k in range(6)]) == [f"In short, {k}\nTitle {k}\n{told(k)}\nSecond part {k} {'word ' * 30}".strip() for k in range(6)]


def test_the_wrapper_decides_without_marks(spark, monkeypatch):
    """Article elements renamed and all mark words emptied, the texts of the table are the same."""
    from collections import defaultdict

    monkeypatch.setattr(html_text, "_MARKS", set())
    monkeypatch.setattr(html_text, "_ROLES", set())
    hosts = defaultdict(list)
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        hosts[r["url"].split("/")[2]].append(r["html"])
    renamed = lambda p: p.replace("<article>", "<div>").replace("</article>", "</div>").replace("<main>", "<div>").replace("</main>", "</div>")
    right = total = 0
    for own in hosts.values():
        for page, got in zip(own, html_text.extract([renamed(p) for p in own])):
            alone = html_text.extract(["<html><body><article>" + page.split("<article>")[1].split("</article>")[0] + "</article></body></html>"])[0]
            right, total = right + (got == alone), total + 1
    assert right == total == 250


def test_long_pages_take_little_time():
    import time

    pages = ["<html><body><article>" + "".join(f"<h2>Head {k} {j}</h2><p>Part {k} {j}</p>" for j in range(1000)) + "</article></body></html>" for k in range(2)]
    pages += ["<html><body>" + "".join(f"<div><p>{k} {j}</p></div><section><p>{j}</p></section>" for j in range(1000)) + "</body></html>" for k in range(2)]
    began = time.process_time()
    got = html_text.extract(pages)
    assert time.process_time() - began < 4 and [t.count("\n") for t in got] == [1999] * 4


def test_the_driver_gets_no_more_than_the_sample_of_a_row_that_repeats(spark, monkeypatch):
    """A labelled row with 10,000 copies: what reaches the driver keeps its bound, and the copies are samples like others."""
    from corvane.llm import quality
    from pyspark.sql.classic.dataframe import DataFrame

    rows = [(k, f"good word{k} fine text of {k}" if k % 2 else f"bad junk{k} junk {k}", None) for k in range(1, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string")
    many = docs.unionByName(spark.range(10_000).selectExpr("31L AS doc_id", "'good copies of one text' AS text", "null AS x"))
    labels = spark.createDataFrame([(r[0], r[0] % 2, 0) for r in rows], "doc_id long, quality int, toxic int")
    most, collect = [], DataFrame.collect

    def counted(self):
        out = collect(self)
        most.append(len(out))
        return out

    monkeypatch.setattr(DataFrame, "collect", counted)
    model = quality.fit_quality(many, labels, sample=50, epochs=2)
    assert max(most) <= 50 and 0 <= model.score("good") <= 1
