"""A corpus pipeline in five stages, each a function (spark, docs, sf_dir) -> DataFrame.

A stage's result is written as Parquet and read again as the next one's docs.  The first four return the columns of
`documents`; the last returns token ids.  SQL can't express the trained classifier of the first stage, so ORACLE_SQL is
None and the tests compare every stage with a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.bpe import bpe_encode
from corvane.llm.common import fresh, read_table, stage_table
from corvane.llm.decontaminate import decontaminate
from corvane.llm.line_dedup import dedup_lines
from corvane.llm.near_dedup import drop_near_copies
from corvane.llm.quality import THRESHOLD, add_scores, fit_quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Every row is judged by its own text, so repeated rows share the decision; null and empty texts get the score of no
    evidence, and a score at the threshold stays.  Other columns, whatever their names, pass through; an empty table stays empty.
    """
    model, score = fit_quality(docs, read_table(spark, sf_dir, "labels")), fresh(docs.columns, "_score")
    return add_scores(docs, model, score).filter(F.col(score) >= THRESHOLD).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go; a document of which nothing but blanks is left goes with them; n_chars follows the text.

    Nulls, ties, repeated rows and empty tables as dedup_lines says: a null text has no lines and stays, rows that repeat
    an id with the same text don't delete each other.
    """
    n, gone = fresh(docs.columns, "_n_lines"), fresh(docs.columns, "_n_removed")
    done = dedup_lines(docs, n_lines=n, n_removed=gone)
    done = done.filter((F.col(gone) == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return done.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near copies the document with the least doc_id stays.

    Null and empty texts are linked with nothing and stay; rows that repeat an id stay or go together; a null id is the least.
    """
    return drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none, repeated rows share the decision, an empty benchmark takes nothing."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of every row; a null text counts as empty and has no tokens, repeated rows repeat."""
    ids = fresh(docs.columns, "_ids")
    return bpe_encode(docs, name=ids).select("doc_id", "lang", "source", F.size(ids).cast("long").alias("n_tokens"), F.col(ids).alias("ids"))


STAGES = [("quality", keep_quality), ("lines", drop_lines), ("near", drop_near), ("leaks", drop_leaks), ("tokens", to_tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage_table(docs, name)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
