import corpus_pipeline
from brute import SF, lines, near
from corvane.llm import bpe, decontaminate, quality


def test_every_stage_equals_a_plain_version_of_itself(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, spark.createDataFrame([tuple(r) for r in before.values()], docs.schema), SF)
        after = {r["doc_id"]: r for r in frame.collect()}
        texts = [(i, r["text"]) for i, r in before.items()]
        if name == "quality":
            model = quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert after.keys() == {i for i, t in texts if model.score(t) >= 0.3}
        elif name == "lines":
            kept = lines(texts)
            assert {i: r["text"] for i, r in after.items()} == {i: t for i, t in kept.items() if t.strip()}
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif name == "near":
            assert after.keys() == {i for i, (_, c) in near(texts, 80).items() if c == i}
        elif name == "leaks":
            items = [decontaminate.normalise(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            index = decontaminate.PieceIndex([*enumerate(items)], decontaminate.ERROR_RATE)
            assert after.keys() == {i for i, t in texts if not index.search(decontaminate.normalise(t))}
        else:
            own = bpe.load(bpe.default_path())
            assert {i: own.decode(r["ids"]).decode() for i, r in after.items()} == dict(texts)
            continue
        assert frame.columns == columns and 0 < len(after) <= len(before)
        before = after
    assert corpus_pipeline.run(spark, SF).count() == len(after)
