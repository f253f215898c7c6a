"""MinHash near-dedup with an LSH forest.

Every document becomes the set of hashes of its SHINGLE-word shingles.  Documents with equal sets are one class; only
the first of a class goes on.  A signature has TREES rows of DEPTH minhash values.  In each tree the documents are
sorted by their row, so neighbours in that order have the longest common prefixes; a document's candidates are its
NEIGHBOURS next ones while the common prefix is at least LEAST_PREFIX values long.  A region of the tree (documents
with one prefix) that holds more than REGION documents is sorted by itself at a deeper prefix, and so on to DEPTH:
the depth adapts to how crowded a region is, and no region is ever expanded into all its pairs.

Every candidate pair is confirmed on the full sets of both texts, exactly, with integers.  Components of the confirmed
links come from alternating large-star and small-star steps, each written to a shared table.

Neighbours don't reach every pair of a region.  Regions of DEEP values that hold more documents than they reach, of more
than one component, are therefore compared in full: their members are dealt into salted blocks, and every two
blocks are joined exactly, with the sizes of the sets and a prefix filter as bounds.  Only links between components are
given, a spanning forest of each two blocks, so the rows grow with the documents and not with their pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import fresh, id_column, keyed_texts, read_table, restore_id, runs_of, slices, stage_table, words_of

SHINGLE = 5
TREES, DEPTH, LEAST_PREFIX, NEIGHBOURS, REGION = 24, 8, 3, 3, 512
#: 100 * intersection / union of a link, at least.
PERCENT = 80
#: Values of the prefix of a region whose documents are compared in full, if the neighbours don't reach them all.
DEEP = 5
#: Bytes of a value.
WIDTH = 2
SEED = 20240611
#: Documents and shingles of a block of a region that is compared in full, about.
BLOCK_DOCS, BLOCK_SHINGLES = 2048, 500_000
#: Candidates of one document that are confirmed in one task, about.
SLOT = 256


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct 64-bit keys of its shingles; of a shorter text the whole sequence is one; of no words, none."""
    for _, part in slices(texts):
        words = words_of(pc.ascii_lower(part))
        grams = runs_of(words.lo, size)
        for a, z in zip(words.bounds.tolist(), words.bounds[1:].tolist()):
            yield np.unique(grams[a : z - size + 1] if z - a >= size else runs_of(words.lo[a:z], z - a) if z > a else words.lo[:0])


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, n, np.uint64) << np.uint64(1) | np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of every hash function a*x + b over the set, top 16 bits."""
    low = np.full(len(a), (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(low, (hashes[at : at + 2048, None] * a + b).min(axis=0), out=low)
    return (low >> np.uint64(48)).astype(np.uint16)


_SETS = "_id long, n long, s1 long, s2 long, sig binary"


def _sets(size: int, trees: int, depth: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _constants(trees * depth)
        for batch in rows:
            n, keys, sig = [], [], []
            for found in shingle_sets(batch.column("text"), size):
                n.append(len(found))
                keys.append(np.frombuffer(hashlib.md5(found.tobytes()).digest(), np.int64))
                sig.append(signature(found, a, b).astype(">u2").tobytes() if len(found) else None)
            keys_ = np.array(keys, np.int64).reshape(-1, 2)
            yield pa.record_batch({"_id": batch.column("_id"), "n": pa.array(n, pa.int64()), "s1": pa.array(keys_[:, 0]), "s2": pa.array(keys_[:, 1]), "sig": pa.array(sig, pa.binary())})

    return run


def _rows(sets: DataFrame, trees: int, depth: int) -> DataFrame:
    """(_id, n, tree, row): a document's rows of minhash values, one for each tree, by cutting its signature."""
    cut = [F.substring("sig", 1 + WIDTH * depth * t, WIDTH * depth) for t in range(trees)]
    return sets.select("_id", "n", F.posexplode(F.array(*cut)).alias("tree", "row"))


def _prefix(level: int):
    return F.xxhash64("tree", F.substring("row", 1, WIDTH * level))


def regions(rows: DataFrame, depth: int, least: int, region: int) -> DataFrame:
    """rows with the key of their region: the shortest prefix, of `least` values or more, that at most `region` documents share.

    Only the keys of crowded regions are kept between levels, and there is at most one of them for every `region` rows.
    A crowd that agrees to the last level is cut into stretches, others in each tree, by a hash of the ids; `crowd` is its key there.
    """
    keyed = rows.withColumn("key", _prefix(least)).withColumn("crowd", F.lit(None).cast("long"))
    for level in range(least, depth + 1, 2):
        last = level + 2 > depth
        crowded = stage_table(keyed.filter("crowd IS NULL" if level == least else "deep").groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > region).select(F.col("key").alias("k"), "c"), "crowded")
        joined = keyed.drop("deep").join(crowded, F.col("key") == F.col("k"), "left")
        deep = F.col("k").isNotNull()
        deeper = F.xxhash64("key", F.pmod(F.xxhash64("tree", "_id"), F.ceil(F.col("c") / region))) if last else _prefix(level + 2)
        keyed = joined.select("_id", "n", "tree", "row", F.when(deep, deeper).otherwise(F.col("key")).alias("key"), F.when(deep & F.lit(last), F.col("k")).alias("crowd"), deep.alias("deep"))
    return keyed.drop("deep")


def candidates(sets: DataFrame, percent: int = PERCENT, trees: int = TREES, depth: int = DEPTH, least: int = LEAST_PREFIX, neighbours: int = NEIGHBOURS, region: int = REGION) -> DataFrame:
    """(x, y), x < y: pairs that are near in some tree and whose set sizes allow the similarity."""
    placed = regions(_rows(sets, trees, depth), depth, least, region)
    order = Window.partitionBy("key").orderBy("row", "_id")
    leads = [F.lead(F.struct("_id", "n"), k).over(order).alias(f"m{k}") for k in range(1, neighbours + 1)]
    near = placed.select("_id", "n", *leads).filter("m1 IS NOT NULL").select("_id", "n", F.explode(F.array(*[f"m{k}" for k in range(1, neighbours + 1)])).alias("m"))
    crowds = placed.filter("crowd IS NOT NULL")
    heads = crowds.groupBy("crowd").agg(F.min(F.struct("_id", "n")).alias("m"))
    near = near.unionByName(crowds.join(heads, "crowd").select("_id", "n", "m"))  # stretches of a crowd hang together by its first document
    found = near.filter("m IS NOT NULL AND m._id <> _id").filter(100 * F.least("n", "m.n") >= percent * F.greatest("n", "m.n"))
    return found.select(F.least("_id", "m._id").alias("x"), F.greatest("_id", "m._id").alias("y")).distinct()


def _confirm(size: int, percent: int):
    """Over the rows of one x after another, its own text (y null) first: the pairs whose sets are near enough."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, np.uint64)
        for b in rows:
            ok = []
            for x, y, other in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), shingle_sets(b.column("text"), size), strict=True):
                if y is None:
                    last, own = x, other
                    ok.append(False)
                    continue
                both = len(np.intersect1d(own, other, assume_unique=True)) if x == last else 0
                ok.append(100 * both >= percent * (len(own) + len(other) - both) and both > 0)
            keep = pa.array(ok, pa.bool_())
            yield pa.record_batch({"x": b.column("x").filter(keep), "y": b.column("y").filter(keep)})

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, slot: int = SLOT) -> DataFrame:
    """The pairs whose full sets meet 100 * intersection >= percent * union.

    The text of y travels to x once for each pair; the text of x once for each slot of about `slot` pairs, so neither many
    partners of one text meet in one task nor is that text copied for each of them.
    """
    many = stage_table(pairs.groupBy("x").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > slot).select(F.col("x").alias("hub"), "c"), "hubs")
    dealt = pairs.join(many, F.col("x") == F.col("hub"), "left").select("x", "y", F.coalesce(F.pmod(F.xxhash64("y"), F.ceil(F.col("c") / slot)), F.lit(0)).alias("slot"))
    dealt = stage_table(dealt, "dealt")
    # texts are dealt by their ids once, for both joins
    own = dealt.select("x", "slot").distinct().hint("merge").join(docs, F.col("x") == F.col("_id")).select("x", F.lit(None).cast("long").alias("y"), "slot", "text")
    others = dealt.hint("merge").join(docs, F.col("y") == F.col("_id")).select("x", "y", "slot", "text")
    met = own.unionByName(others).repartition("x", "slot").sortWithinPartitions("x", "slot", F.col("y").asc_nulls_first())
    return met.mapInArrow(_confirm(size, percent), "x long, y long").distinct()


def forest_links(ids: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, slots: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links that join documents of different labels: a spanning forest of all of them.

    Exact: a pair with 100 * intersection >= percent * union shares a shingle among the rarest n - ceil(percent * n / 100) + 1
    of each set, and its sizes n differ by no more than percent.  With slots, only documents of different slots are compared.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    token = rank[token]
    token = token[np.lexsort((token, owner))]  # a document's shingles, rarest first
    begin = np.concatenate([[0], np.cumsum(sizes)])
    prefix = sizes - (percent * sizes + 99) // 100 + 1
    inside = np.flatnonzero(np.arange(len(token)) - begin[owner] < prefix[owner])
    by = inside[np.argsort(token[inside], kind="stable")]
    post, post_at = owner[by], np.searchsorted(token[by], np.arange(len(df) + 1))
    labels, mark, out = np.unique(labels, return_inverse=True)[1], np.zeros(len(df), bool), []

    def ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)

    for i in range(len(sets)):
        rare = token[begin[i] : begin[i] + prefix[i]]
        near = np.unique(post[ranges(post_at[rare], post_at[rare + 1] - post_at[rare])])
        near = near[(near < i) & (labels[near] != labels[i])]
        near = near[100 * np.minimum(sizes[near], sizes[i]) >= percent * np.maximum(sizes[near], sizes[i])]
        if slots is not None:
            near = near[slots[near] != slots[i]]
        if not len(near):
            continue
        own = token[begin[i] : begin[i + 1]]
        mark[own] = True
        for part in np.array_split(near, -(-int(sizes[near].sum()) // 4_000_000)):
            both = np.add.reduceat(mark[token[ranges(begin[part], sizes[part])]].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[part])[:-1]]))
            for j in part[100 * both >= percent * (sizes[part] + sizes[i] - both)]:
                if labels[j] != labels[i]:
                    out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
                    labels[labels == labels[j]] = labels[i]
        mark[own] = False
    return out


def _grams(size: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            yield pa.record_batch({"_id": b.column("_id"), "grams": pa.array([x.tobytes() for x in shingle_sets(b.column("text"), size)], pa.binary())})

    return run


def _across(percent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[frame["grams"].str.len() > 0]
        links = []
        if frame["root"].nunique() > 1:
            sets = [np.frombuffer(g, np.uint64) for g in frame["grams"]]
            links = forest_links(frame["_id"].to_numpy(), sets, frame["root"].to_numpy(), frame["slot"].to_numpy() if frame["a"].iloc[0] != frame["b"].iloc[0] else None, percent)
        return pd.DataFrame({"x": [x for x, _ in links], "y": [y for _, y in links]}, dtype="int64")

    return run


def across(sets: DataFrame, roots: DataFrame, texts: DataFrame, size: int = SHINGLE, percent: int = PERCENT, trees: int = TREES, depth: int = DEPTH, least: int = LEAST_PREFIX, neighbours: int = NEIGHBOURS, region: int = REGION, deep: int = DEEP, docs: int = BLOCK_DOCS, grams: int = BLOCK_SHINGLES) -> DataFrame | None:
    """(x, y): links between components in regions whose pairs the neighbours don't all reach; null if there is no such region.

    Regions of equal members in several trees are compared once.
    """
    own = sets.join(roots, F.col("_id") == F.col("node"), "left").select("_id", "n", F.coalesce("root", "_id").alias("root"), "sig")
    keys = F.array(*[F.xxhash64(F.lit(t), F.substring("sig", 1 + WIDTH * depth * t, WIDTH * deep)) for t in range(trees)])
    placed = own.select("_id", "n", "root", F.xxhash64("_id", "sig").alias("h"), F.explode(keys).alias("key"))
    mixed = placed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    mixed = stage_table(mixed.filter((F.col("c") > min(neighbours + 1, region)) & (F.col("lo") < F.col("hi"))).select("key"), "mixed")
    if not mixed.limit(1).count():
        return None
    members = stage_table(placed.join(mixed, "key"), "members")
    whole = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"), F.bit_xor("h").alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "h")).alias("h2"))
    once = whole.groupBy("c", "n", "h1", "h2").agg(F.min("key").alias("key")).select("key", F.greatest(F.ceil(F.col("c") / docs), F.ceil(F.col("n") / grams)).cast("int").alias("blocks"))
    dealt = members.drop("n", "h").join(stage_table(once, "regions"), "key").withColumn("slot", F.pmod(F.xxhash64("_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("_id", "root", "key", "slot", F.least("slot", "other").alias("a"), F.greatest("slot", "other").alias("b")).distinct()
    held = texts.join(members.select("_id").distinct().hint("merge"), "_id", "left_semi").mapInArrow(_grams(size), "_id long, grams binary")
    return stage_table(dealt.join(held, "_id").groupBy("key", "a", "b").applyInPandas(_across(percent), "x long, y long").distinct(), "across")


def rooted(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of roots and further links together."""
    low = roots.select("node", "root")
    one = links.join(low, F.col("x") == F.col("node"), "left").select(F.coalesce("root", "x").alias("x"), "y")
    both = one.join(low, F.col("y") == F.col("node"), "left").select("x", F.coalesce("root", "y").alias("y"))
    upper = components(both).select(F.col("node").alias("up"), F.col("root").alias("top"))
    moved = roots.join(upper, F.col("root") == F.col("up"), "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(upper.select(F.col("up").alias("node"), F.col("top").alias("root")))


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root): the least node that each linked node reaches (alternating large-star and small-star)."""
    edges = stage_table(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct(), "links")
    for _ in range(rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # rebalanced, so that the join deals both sides itself and Spark can split a hub's links
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")).hint("rebalance")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(down.hint("rebalance"), "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        new = stage_table(small, "links")
        changed = new.join(edges, ["u", "v"], "left_anti").limit(1).count() or edges.join(new, ["u", "v"], "left_anti").limit(1).count()
        edges = new
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_groups(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, **forest) -> DataFrame:
    """(_id, n_shingles, rep, root) of every row: its class (least id with the same set) and the least id it reaches."""
    texts = keyed_texts(docs)
    sets = stage_table(texts.mapInArrow(_sets(size, forest.get("trees", TREES), forest.get("depth", DEPTH)), _SETS), "sets")
    # classes of one document need no row; the others go through a table, so that Spark can split the join of a large class
    keys = sets.select("_id", "n", "s1", "s2")
    classes = stage_table(keys.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"), "classes")
    own = keys.join(classes, ["s1", "s2", "n"], "left").withColumn("rep", F.coalesce("rep", "_id"))
    copies = own.filter("_id <> rep").select("_id", "s1", "s2").distinct()
    reps = stage_table(sets.filter("n > 0").join(copies.hint("merge"), ["_id", "s1", "s2"], "left_anti").dropDuplicates(["_id", "s1", "s2"]).select("_id", "n", "sig"), "reps")
    pairs = stage_table(candidates(reps, percent, **forest), "pairs")
    links = confirmed(pairs, texts, size, percent)
    roots = components(links)
    more = across(reps, roots, texts, size, percent, **forest)
    if more is not None:
        roots = rooted(roots, more)
    return own.select("_id", "n", "s1", "s2", "rep").join(roots, own["rep"] == roots["node"], "left").select("_id", F.col("n").alias("n_shingles"), "rep", F.coalesce("root", "rep").alias("root"), "s1", "s2")


def near_dedup(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, **forest) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Null and empty texts, and texts of white space, have the empty set and are linked with nothing; a text of fewer words
    than a shingle has one shingle.  kept marks the least doc_id of a component; a null doc_id counts as the least
    and stays null.  Rows that repeat a doc_id are one document in links: they share the component of any of them
    and are all marked alike.  Extra columns are ignored; an empty table gives no rows.
    """
    found = near_groups(docs, percent, size, **forest)
    return found.select(restore_id("_id").alias("doc_id"), "n_shingles", restore_id("root").alias("component_id"), (F.col("_id") == F.col("root")).alias("kept"))


def drop_near_copies(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, **forest) -> DataFrame:
    """docs without the documents that are linked, over any number of steps, to one of a smaller doc_id; all columns stay."""
    kept = near_groups(docs, percent, size, **forest).filter("_id = root").select("_id").distinct()
    key = fresh(docs.columns, "_id")
    return docs.withColumn(key, id_column()).join(kept.withColumnRenamed("_id", key), key, "left_semi").select(*docs.columns)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document at 85 percent, as near_dedup gives them: null and empty texts have the empty set and are alone."""
    return near_dedup(read_table(spark, sf_dir, "documents"), percent=85)


SQL: dict[str, str] = {}
