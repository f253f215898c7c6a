"""Quality classifier: supervised subword embeddings.

Every document is a bag of hashed features of four families: words, character n-grams of words (Unicode characters,
with marks at both ends of the word), pairs of consecutive words, and shapes of SHAPE consecutive words (which of them
are equal, not what they are).  All share one table of buckets and all are learned alike.  Each bucket has a learned
vector; a document is the sum of its features' vectors over their number plus PRIOR, a mean that a very short text
can't sway far, and a softmax layer on top gives two class probabilities.  Training is plain numpy stochastic gradient
descent on a bounded sample of labelled rows (SAMPLE rows, SAMPLE_PAIRS bucket counts); the executors turn those rows into bucket
counts, so the driver never holds their texts.  For scoring, the softmax of two classes needs only the difference of
two products, so each bucket's vector folds into one number and a document's score is the mean of those numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import id_column, keyed_texts, mix, read_table, restore_id, runs_of, slices, split_words, stage_table, words_in

#: Labelled rows that a model may be trained on, at most: those with the smallest hash of their doc_id; and the bucket
#: counts of those rows together, at most (6 bytes each, or 8), which keeps the driver's memory bounded whatever their length.
SAMPLE, SAMPLE_PAIRS = 4000, 16_000_000
BITS, DIM, EPOCHS, RATE, SEED = 17, 12, 8, 0.6, 7
#: Characters of an n-gram, and words of a shape.
GRAMS, SHAPE = (3, 4), 4
FAMILIES = ("words", "grams", "pairs", "shapes")
#: Added to the number of features of a text when their vectors are averaged.
PRIOR = 40
THRESHOLD = 0.3
#: Bytes of texts whose features are held at once, about.
HELD = 1 << 22
_GRAM = np.uint64(0x9E3779B97F4A7C15)


class Features:
    """Buckets of several texts: those of each different word, and those of each run of words."""

    def __init__(self, texts: pa.Array, bits: int = BITS, families: tuple[str, ...] = FAMILIES):
        coded, self.bounds = split_words(texts)
        words, shift = words_in(coded, self.bounds), np.uint64(64 - bits)
        self.word, n = coded.indices.to_numpy(), len(coded.dictionary)
        owners, buckets = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        if "words" in families and n:
            first = np.zeros(n, np.uint64)
            first[self.word] = words.lo
            owners.append(np.arange(n))
            buckets.append((mix(first) >> shift).astype(np.int32))
        if "grams" in families and n:
            sizes = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False) + 2
            chars = np.frombuffer(("<" + "><".join(coded.dictionary.to_pylist()) + ">").encode("utf-32-le"), np.uint32).astype(np.uint64)
            owner = np.repeat(np.arange(n), sizes)
            for g in GRAMS:
                inside = owner[: max(len(owner) - g + 1, 0)] == owner[g - 1 :]
                owners.append(owner[: len(inside)][inside])
                buckets.append((runs_of(chars, g)[inside] * _GRAM >> shift).astype(np.int32))
        order = np.argsort(np.concatenate(owners), kind="stable")
        self.buckets, self.count = np.concatenate(buckets)[order], np.bincount(np.concatenate(owners), minlength=n)
        self.begin = np.cumsum(self.count) - self.count
        self.runs: list[tuple[int, np.ndarray]] = []  # words of a run, bucket of the run from each word on
        if "pairs" in families:
            self.runs.append((2, (runs_of(words.lo, 2) >> shift).astype(np.int32)))
        if "shapes" in families:
            m = max(len(words.lo) - SHAPE + 1, 0)
            shape = np.zeros(m, np.uint64)
            for j in range(1, SHAPE):  # the first word that each is equal to
                equal = np.full(m, j, np.uint64)
                for i in reversed(range(j)):
                    equal[words.lo[i : i + m] == words.lo[j : j + m]] = i
                shape = shape * np.uint64(SHAPE) + equal
            self.runs.append((SHAPE, (mix(shape + np.uint64(1 << 32)) >> shift).astype(np.int32)))

    def bag(self, k: int) -> np.ndarray:
        """Buckets of all features of text k."""
        a, z = self.bounds[k], self.bounds[k + 1]
        own = self.word[a:z]
        parts = [np.concatenate([self.buckets[self.begin[w] : self.begin[w] + self.count[w]] for w in own.tolist()])] if z > a else [self.buckets[:0]]
        return np.concatenate([*parts, *(run[a : max(z - size + 1, a)] for size, run in self.runs)])

    def totals(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of weights, number) of the features of every text."""
        owner = np.repeat(np.arange(len(self.count)), self.count)
        value = np.bincount(owner, weights=weights[self.buckets].astype(np.float64), minlength=len(self.count))
        total, n = _summed(value[self.word], self.bounds[:-1], self.bounds[1:]), _summed(self.count[self.word], self.bounds[:-1], self.bounds[1:])
        for size, run in self.runs:
            ends = np.maximum(self.bounds[1:] - size + 1, self.bounds[:-1])
            total = total + _summed(weights[run].astype(np.float64), self.bounds[:-1], ends)
            n = n + (ends - self.bounds[:-1])
        return total, n


def _summed(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end], each by itself, so that they don't depend on the other texts."""
    out, full = np.zeros(len(starts), values.dtype), starts < ends
    if full.any():
        edges = np.stack([starts[full], ends[full]], axis=1).reshape(-1)
        out[full] = np.add.reduceat(np.append(values, values.dtype.type(0)), edges)[::2]
    return out


@dataclass
class QualityModel:
    weights: np.ndarray  # of each bucket, float32
    bias: float
    families: tuple[str, ...] = FAMILIES

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 of every text."""
        out, bits = [np.zeros(0)], int(np.log2(len(self.weights)))
        for _, part in slices(texts, HELD):
            total, n = Features(part, bits, self.families).totals(self.weights)
            out.append(1 / (1 + np.exp(-np.clip(self.bias + total / (n + PRIOR), -60, 60))))
        return np.concatenate(out)

    def score(self, text: str) -> float:
        return float(self.scores(pa.array([text]))[0])


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> QualityModel:
    """samples: (buckets, counts, label).  With no sample, or labels of one class only, the score is a constant."""
    labels = np.array([y for _, _, y in samples])
    if not len(labels) or labels.min() == labels.max():
        return QualityModel(np.zeros(1 << bits, np.float32), 0.0 if not len(labels) else 6.0 * (2 * int(labels[0]) - 1))
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out = rng.uniform(-1 / dim, 1 / dim, (dim, 2)).astype(np.float32)
    bias, steps, done = np.zeros(2, np.float32), epochs * len(samples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            idx, cnt, y = samples[i]
            lr = rate * (1 - done / steps)
            done += 1
            if not len(idx):
                continue
            share = (cnt / (cnt.sum() + PRIOR)).astype(np.float32)
            rows = emb[idx]
            hidden = share @ rows
            logits = hidden @ out + bias
            grad = np.exp(logits - logits.max())
            grad /= grad.sum()
            grad[y] -= 1
            back = out @ grad
            out -= lr * np.outer(hidden, grad)
            bias -= lr * 0.1 * grad
            emb[idx] = rows - lr * np.outer(share / np.sqrt((share**2).sum()), back)  # a step of the same length for short and long texts
    return QualityModel((emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def bags(texts: pa.Array, bits: int = BITS, families: tuple[str, ...] = FAMILIES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of every text."""
    for _, part in slices(texts, HELD):
        own = Features(part, bits, families)
        for k in range(len(part)):
            yield np.unique(own.bag(k), return_counts=True)


def _bags(bits: int, families: tuple[str, ...]):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            found = [*bags(b.column("text"), bits, families)]
            packed = {"idx": pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary()), "cnt": pa.array([c.astype(np.uint16 if c.max(initial=0) < 1 << 16 else np.uint32).tobytes() for _, c in found], pa.binary())}
            yield pa.record_batch({"_id": b.column("_id"), "_tx": b.column("_tx"), "label": b.column("label"), "pairs": pa.array([len(i) for i, _ in found], pa.int64())} | packed)

    return run


def labelled_bags(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, folds: int = 5, bits: int = BITS, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """Bucket counts of at most `sample` labelled ids outside fold 0; rows with a null id, label or other value than 0 and 1 teach nothing."""
    usable = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (F.crc32(F.col("_id").cast("string")) % folds != 0))
    chosen = usable.groupBy("_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = keyed_texts(docs.filter(F.col("doc_id").isNotNull())).withColumn("_tx", F.xxhash64("text"))
    # `chosen` has at most `sample` rows of two numbers
    return texts.join(F.broadcast(chosen), "_id").mapInArrow(_bags(bits, families), "_id long, _tx long, label int, pairs long, idx binary, cnt binary")


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pairs: int = SAMPLE_PAIRS, bits: int = BITS, families: tuple[str, ...] = FAMILIES, **options) -> QualityModel:
    """A model of at most `sample` rows with at most `pairs` bucket counts together: the first in the order of a hash of their ids."""
    place = F.struct(F.xxhash64("_id"), "_id", "_tx")
    held = stage_table(labelled_bags(docs, labels, sample=sample, bits=bits, families=families), "bags").withColumn("place", place)
    sizes = held.select("place", "pairs").orderBy("place").limit(sample).collect()  # two small columns of `sample` rows
    fits = int(np.searchsorted(np.cumsum([r["pairs"] for r in sizes]), pairs, "right")) if sizes else 0
    last = held.sparkSession.createDataFrame([(tuple(sizes[fits - 1]["place"]),)], held.select("place").schema) if fits else None
    rows = held.join(F.broadcast(last.withColumnRenamed("place", "last")), F.col("place") <= F.col("last")).select("place", "label", "idx", "cnt") if fits else []
    # rows of one place are equal, so any `fits` first ones are the same; however often one repeats, no more reach the driver
    rows = rows.orderBy("place").limit(fits).collect() if fits else []
    model = train([(np.frombuffer(r["idx"], np.int32), np.frombuffer(r["cnt"], f"u{4 * len(r['cnt']) // max(len(r['idx']), 1) or 2}"), r["label"]) for r in rows], bits=bits, **options)
    model.families = families
    return model


def add_scores(docs: DataFrame, model: QualityModel, name: str = "_score") -> DataFrame:
    """docs with a score between 0 and 1 (higher: label 1 likelier) from the whole text; null and empty texts get the bias alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats, whatever the input

    def run(texts: Iterator) -> Iterator:
        for own in texts:
            yield pa.array(held.value.scores(own.cast(pa.string())))

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(name, F.arrow_udf(run, "double")(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = THRESHOLD, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; repeated rows get the same score, extra columns are ignored, an empty table gives no rows."""
    model = fit_quality(docs, labels, **options)
    own = docs.select(id_column().alias("_id"), "text")
    return add_scores(own, model).select(
        restore_id("_id").alias("doc_id"), F.coalesce(F.crc32(restore_id("_id").cast("string")) % folds == 0, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted")
    )


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, as quality_scores gives them: null and empty texts get the score of no evidence."""
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


SQL: dict[str, str] = {}
