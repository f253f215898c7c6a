"""The pipeline's stages on nulls, empty and repeated rows, empty tables and clashing columns; the first and fourth against plain versions."""

import corpus_pipeline
import numpy as np
from brute import SF, distance
from corvane.llm import decontaminate, quality


def odd(spark):
    t = spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", 1.0) for r in t]
    rows += [(None, t[0]["text"], None, None, None, None, None), (7, None, "en", "s", None, "y", 2.0), (9001, "", "en", "s", 0, "y", 2.0), (9002, "short one", "en", "s", 9, None, 0.0), rows[3], rows[3]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string, _score double")


def test_stages_take_odd_rows_and_empty_tables(spark):
    docs = odd(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    name, last = corpus_pipeline.STAGES[-1]
    out = last(spark, docs, SF)
    assert out.count() == docs.count() and last(spark, docs.limit(0), SF).count() == 0


def features(text):
    """Counts of all features of a text, by their names."""
    words, out = text.split(), {}
    add = lambda k: out.__setitem__(k, out.get(k, 0) + 1)
    for w in words:
        add(("word", w))
        for g in quality.GRAMS:
            for i in range(len(w) + 3 - g):
                add(("gram", f"<{w}>"[i : i + g]))
    for a, b in zip(words, words[1:]):
        add(("pair", a, b))
    for i in range(len(words) - quality.SHAPE + 1):
        own = words[i : i + quality.SHAPE]
        add(("shape", tuple(own.index(w) for w in own)))
    return out


def test_buckets_count_the_named_features():
    import pyarrow as pa

    texts = ["a b a b", "née née née née née", "one two three", "", "漢字 x"]
    named, seen = [features(t) for t in texts], {}
    for t, own, (idx, cnt) in zip(texts, named, quality.bags(pa.array(texts), bits=24)):
        assert sorted(own.values()) == sorted(cnt.tolist()), t  # 24 bits: these few features don't share buckets
        for text, (i, c) in ((t, (idx, cnt)),):
            seen[text] = dict(zip(i.tolist(), c.tolist()))
    shared = set(seen["a b a b"]) & set(seen["née née née née née"])
    assert not shared  # other words, other shapes


def test_leaks_stage_equals_dynamic_programming(spark):
    items = [decontaminate.normalise(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:12]
    rng = np.random.default_rng(4)
    texts = []
    for k, item in enumerate(items):
        own = list(item)
        for at in rng.choice(len(own), size=int(len(own) * (0.04 if k % 2 else 0.2)), replace=False):
            own[at] = "#"
        texts.append("before it " + "".join(own) + " after it")
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    want = {k for k, t in enumerate(texts) if all(distance(i, decontaminate.normalise(t)) > len(i) // 10 for i in items)}
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()} == want and 0 < len(want) < len(items)
