"""The corpus pipeline: quality rules, line dedup, near-duplicate join, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet
and read again as the next stage's documents.  All but the last keep the columns of
`documents`.

Defined cases, for every stage: null and empty texts fail the quality rules and so go first;
a later stage that is given them keeps them as they are.  Very long texts are taken whole.
Repeated rows are judged each by itself, and one of them stays after the join.  Columns
beside doc_id, text and source may have any names and are kept as they are (the last stage
leaves them); a null doc_id or source is one like any other.  An empty table gives an
empty table.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import bpe, decontaminate, jaccard, linededup, quality
from driftline.llm.common import delete, intermediate, new_path, stage_tables, table, written


def stage(f):
    """A stage; the tables that its operator writes go when the next stage is called."""

    @wraps(f)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with stage_tables(spark, docs):
            return f(spark, docs, sf_dir)

    return call


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's verdict reject go."""
    return quality.kept_documents(docs)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents of which nothing is left; n_chars follows the text."""
    out = linededup.removed(docs).where("n_removed = 0 or n_removed < n_lines")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None
    new = {"text": F.col("text"), "n_chars": n_chars}
    return out.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


@stage
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the least id."""
    return jaccard.one_of_each(docs)


@stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and digests of the ids and of the decoded bytes."""
    return bpe.encode(docs, *bpe.vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", benchmark_decontamination),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; only the last stage's table stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, step in STAGES:
        path = new_path(spark)
        with intermediate(spark):
            docs = written(step(spark, docs, sf_dir), path=path)
        if before:
            delete(spark, before)
        before = path
    return docs


#: The last stage's token ids are beyond SQL.
ORACLE_SQL = None
