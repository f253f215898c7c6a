"""Line dedup by winnowing, in DataFrame operations only.

A run is RUN consecutive non-blank lines of a document, or fewer that have LONG words together.  Of every run the line with
the least hash is selected, so two equal runs select the same line: its hash is a guaranteed fingerprint, and only selected
lines travel, about half of the short ones.  A selected line carries the hashes of the lines that a run through it can reach
on both sides.  Fingerprints of one place
are dropped; at the others the match is extended both ways from the selected line, by 128-bit keys of the runs through
it.  The first place of a run is the smallest (doc_id, position); all lines of a run at a later place are deleted, and
runs that overlap or follow each other delete their union, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import fresh, id_column, read_table, restore_id, stage_table

#: Lines of the shortest repeated run that is deleted.
RUN = 3
#: Words that fewer lines than RUN need together, so that a repeated long paragraph is deleted by itself.
LONG = 50
#: Pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"


def _numbered(text: Column) -> Column:
    """Non-blank lines with their positions among all lines."""
    lines = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    return F.filter(lines, lambda x: F.trim(x["line"], F.lit(" \t\r\f\x0b")) != "")


def fingerprints(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """(_id, _tx, fp, pos, runs, base, near): the selected lines of every document.

    pos is the line's number among the non-blank ones, runs the starts and lengths (at, n) of the runs that selected it, near
    the lines from number base on that those runs can reach.
    """
    line = lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["line"]).alias("a"), F.xxhash64(F.lit(run), x["line"]).alias("b"), F.regexp_count(x["line"], F.lit(WORD)).alias("w"))
    hashed = (
        docs.filter(F.col("text").isNotNull())
        .select(id_column().alias("_id"), F.xxhash64("text").alias("_tx"), F.transform(_numbered(F.col("text")), line).alias("h"))
        .filter(F.size("h") > 0)
        .withColumn("a", F.col("h.a"))
        .withColumn("w", F.col("h.w"))
    )

    def chosen(at: Column) -> Column:
        """(at, n, pos) of every run that starts at a line."""

        def of(n: int) -> Column:
            own = F.slice("a", at + 1, n)
            enough = F.lit(True) if n == run else F.aggregate(F.slice("w", at + 1, n), F.lit(0), lambda x, y: x + y) >= long
            pos = (at + F.array_position(own, F.array_min(own)) - 1).cast("int")
            return F.when((F.size("a") - at >= n) & enough, F.struct(at.alias("at"), F.lit(n).alias("n"), pos.alias("pos")))

        return F.array_compact(F.array(*[of(n) for n in range(1, run + 1)]))

    selected = hashed.withColumn("sel", F.transform(F.sequence(F.lit(0), F.size("h") - 1), chosen))

    def place(p: Column) -> Column:
        base = F.greatest(p - run + 1, F.lit(0))
        reach = F.filter(F.flatten(F.slice("sel", base + 1, p - base + 1)), lambda r: r["pos"] == p)
        runs = F.transform(reach, lambda r: F.struct(r["at"].alias("at"), r["n"].alias("n")))
        near = F.transform(F.slice("h", base + 1, 2 * run - 1), lambda x: F.struct(x["i"].alias("i"), x["a"].alias("a"), x["b"].alias("b")))
        return F.struct(p.alias("pos"), runs.alias("runs"), base.alias("base"), near.alias("near"))

    places = F.array_distinct(F.transform(F.flatten("sel"), lambda r: r["pos"]))
    rows = selected.select("_id", "_tx", "a", F.explode(F.transform(places, place)).alias("p"))
    return rows.select("_id", "_tx", F.get("a", F.col("p.pos")).alias("fp"), "p.*")


def repeated_runs(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """(_id, _tx, lines): runs that also start earlier, at a smaller doc_id or earlier in the same document."""
    places = stage_table(fingerprints(docs, run, long), "places")
    # rebalanced, so that the join deals both sides itself and Spark can split the places of a very common line
    shared = places.groupBy("fp").agg(F.count(F.lit(1)).alias("places")).filter("places > 1").select("fp").hint("rebalance")
    met = places.join(shared, "fp", "left_semi").withColumn("_run", F.explode("runs")).withColumn("at", F.col("_run.at"))
    own = F.slice("near", F.col("at") - F.col("base") + 1, F.col("_run.n"))
    keys = [F.xxhash64(F.col("_run.n"), F.transform(own, lambda x: x[half])).alias(f"k{n}") for n, half in ((1, "a"), (2, "b"))]
    found = stage_table(met.select("_id", "_tx", "at", *keys, F.transform(own, lambda x: x["i"]).alias("lines")), "runs")
    first = stage_table(found.groupBy("k1", "k2").agg(F.min(F.struct("_id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("k1", "k2", "first"), "first")
    return found.join(first, ["k1", "k2"]).filter(F.struct("_id", "at") != F.col("first")).select("_id", "_tx", "lines")


def dedup_lines(docs: DataFrame, run: int = RUN, long: int = LONG, n_lines: str = "_n_lines", n_removed: str = "_n_removed") -> DataFrame:
    """docs with `text` replaced by its kept lines, and with n_lines and n_removed added; no row is dropped.

    Nulls: a null text stays null (no lines); a null doc_id counts as the smallest id.  An empty text has one blank
    line.  Blank lines are never matched and always kept.  Of equal runs the one with the smallest (doc_id,
    position) stays, whole; rows that repeat a doc_id with the same text are the same place, so they don't delete each
    other.  Other columns pass through; an empty table gives an empty result.
    """
    gone = repeated_runs(docs, run, long).groupBy("_id", "_tx").agg(F.collect_set("lines").alias("_runs"))
    key, tx, lines, cut = (fresh(docs.columns, c) for c in ("_id", "_tx", "_lines", "_gone"))
    gone = gone.select(F.col("_id").alias(key), F.col("_tx").alias(tx), F.array_distinct(F.flatten("_runs")).alias(cut))
    others = [c for c in docs.columns if c != "text"]
    keyed = docs.select(*others, id_column().alias(key), F.xxhash64("text").alias(tx), F.split("text", "\n", -1).alias(lines))
    joined = keyed.join(gone.hint("shuffle_hash"), [key, tx], "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(cut))
    kept = F.transform(left, lambda i: F.get(lines, i))
    text = F.when(F.col(lines).isNull(), None).when(F.col(cut).isNull(), F.concat_ws("\n", lines)).otherwise(F.concat_ws("\n", kept))
    counts = {n_lines: F.when(F.col(lines).isNull(), 0).otherwise(F.size(lines)).cast("long"), n_removed: F.when(F.col(cut).isNull(), 0).otherwise(F.size(cut)).cast("long")}
    return joined.withColumns({"text": text} | counts).select(*docs.columns, *counts)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(restore_id("doc_id").alias("doc_id"), F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The same rows without fingerprints: every run of three non-blank lines, or of one or two with 50 words, by its text.
LINES_SQL = r"""
    all_lines AS (
        SELECT doc_id, i - 1 AS i, lines[i] AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM {docs} WHERE text IS NOT NULL), unnest(range(1, len(lines) + 1)) AS r(i)),
    full_lines AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM all_lines
        WHERE trim(line, chr(32) || chr(9) || chr(13) || chr(12) || chr(11)) <> ''),
    runs AS (
        SELECT a.doc_id, a.k, 3 AS n, a.line AS l1, b.line AS l2, c.line AS l3
        FROM full_lines a JOIN full_lines b ON a.doc_id = b.doc_id AND b.k = a.k + 1 JOIN full_lines c ON a.doc_id = c.doc_id AND c.k = a.k + 2
        UNION ALL
        SELECT a.doc_id, a.k, 2, a.line, b.line, NULL FROM full_lines a JOIN full_lines b ON a.doc_id = b.doc_id AND b.k = a.k + 1 WHERE a.w + b.w >= 50
        UNION ALL
        SELECT doc_id, k, 1, line, NULL, NULL FROM full_lines WHERE w >= 50),
    later AS (
        SELECT doc_id, k, n FROM (SELECT *, row_number() OVER (PARTITION BY n, l1, l2, l3 ORDER BY doc_id, k) AS nth FROM runs) WHERE nth > 1),
    gone AS (SELECT DISTINCT l.doc_id, l.k + d AS k FROM later l, (SELECT unnest([0, 1, 2]) AS d) WHERE d < n),
    gone_lines AS (SELECT f.doc_id, f.i FROM full_lines f JOIN gone g ON f.doc_id = g.doc_id AND f.k = g.k),
    kept_texts AS (
        SELECT a.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
               coalesce(string_agg(a.line, chr(10) ORDER BY a.i) FILTER (WHERE g.i IS NULL), '') AS text
        FROM all_lines a LEFT JOIN gone_lines g ON a.doc_id = g.doc_id AND a.i = g.i GROUP BY a.doc_id)"""

SQL = {
    "op3_line_dedup": "WITH "
    + LINES_SQL.format(docs="documents")
    + """
    SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
    FROM documents d LEFT JOIN kept_texts k ON d.doc_id = k.doc_id"""
}
