"""From raw documents to packed training sequences: five stages, each one operator of ``drovera.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``documents``.
Decisions are made row by row, so rows that share an id, or have none, are judged apart. Empty
tables give empty results, repeated rows are copies like others, null and empty texts are texts
without words, and texts are read whole whatever their length. What a stage keeps on disk is deleted
when the next one begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drovera.llm import decontam, linededup, packing, quality, queries, simhash
from drovera.llm.store import chained, stage

#: The number of a row, beside the columns of ``documents``.
ROW = "__row"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut; all labels are learnt from."""
    labels = queries.table(spark, sf_dir, "labels")
    ranking = quality.fit_ranking(*quality.training_rows(docs, labels, "quality", lambda i: F.lit(True)))
    return docs.where(quality.scorer(ranking)(F.col("text")) >= quality.CUT)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand in many documents; ``n_chars`` follows, null texts become empty."""
    columns = [F.col("kept_text").alias("text") if c == "text" else
               F.char_length("kept_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c)
               for c in docs.columns]
    return linededup.drop_common_lines(docs).select(*columns)


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest id, null last, then the first row.

    Groups come from the SimHash search, with an exact check, and from buckets for what it does not reach.
    """
    # The number of a row follows from its file and place in it, the same in every reading of ``docs``.
    numbered = docs.withColumn(ROW, F.monotonically_increasing_id())
    groups = simhash.near_duplicates(numbered, id_col=ROW).select(F.col("doc_id").alias(ROW), "keeper")
    several = groups.groupBy("keeper").count().where("count > 1").select("keeper")
    alike = numbered.select(ROW, F.col("doc_id").alias("id")).join(groups.join(several, "keeper"), ROW)
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", ROW))[ROW]
    kept = alike.groupBy("keeper").agg(first.alias("kept"))
    gone = alike.join(kept, "keeper").where(F.col(ROW) != F.col("kept")).select(ROW)
    return numbered.join(gone, ROW, "left_anti").drop(ROW)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return docs.where(~decontam.contaminated(queries.table(spark, sf_dir, "benchmark"), F.col("text")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences."""
    return packing.pack_documents(docs, queries.vocabulary())


STAGES = [
    ("quality_classifier", chained(good_quality)),
    ("line_dedup", chained(unique_lines)),
    ("simhash_near_dedup", chained(unique_documents)),
    ("benchmark_decontamination", chained(clean_of_benchmark)),
    ("best_fit_packing", chained(packed)),
]

#: Model scores, fingerprints, edit distances and packing are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
