"""The corpus pipeline: each stage reads what its predecessor kept and returns the rows that stay.

Stages on word shingles take five words and a similarity of 0.8. All columns of
documents pass through; the last stage returns token ids. Rows, not doc_ids, are dropped:
where doc_ids repeat or are null the rows are numbered first, so no row
shares the fate of another text with its id, and of equal rows one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.bpe_stream import encode
from loomspan.llm.common import Scratch, table
from loomspan.llm.decontaminate import hits
from loomspan.llm.exact_dedup import exact_dedup
from loomspan.llm.neardup import near_duplicates
from loomspan.llm.queries import vocabulary
from loomspan.llm.toxicity import fit, keep_clean


def _numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str, bool]:
    """``docs`` with a column that no two rows share, its name, and whether it is other than doc_id."""
    taken = {c.lower() for c in docs.columns}
    name = next(n for k in range(len(taken) + 1) if (n := f"_row{k}") not in taken)
    counts = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if counts.where("n > 1 or doc_id is null").isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long")), name, False
    return scratch.save(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name, True


def _keys(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.col(name).alias("doc_id"), "text")


def _keep_one(rows: DataFrame, name: str, numbered: bool, found: DataFrame, group: str, largest: bool) -> DataFrame:
    """``rows`` less those of each group of ``found`` but the one with the largest or smallest doc_id; null ids lose."""
    if not numbered:
        lost = found.where("not kept").select(F.col("doc_id").alias(name))
    else:
        id_ = rows.select(F.col(name).alias("doc_id"), F.col("doc_id").cast("long").alias("given"))
        placed = found.select("doc_id", F.col(group).alias("group")).join(id_, "doc_id")
        rank = F.struct(F.col("given").isNotNull(), F.col("given"), "doc_id") if largest else F.struct(F.col("given").isNull(), F.col("given"), "doc_id")
        best = placed.groupBy("group").agg((F.max(rank) if largest else F.min(rank)).alias("best"))
        lost = placed.join(best, "group").where("doc_id <> best.doc_id").select(F.col("doc_id").alias(name))
    return rows.join(lost, name, "left_anti").drop(name)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the model is fitted on the training labels of this input.

    Null texts count as empty; equal texts share a verdict; an empty table stays empty.
    """
    return keep_clean(docs, fit(docs, table(spark, sf_dir, "labels"), Scratch(spark, "toxic")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; null texts count as empty, null ids lose."""
    rows, name, numbered = _numbered(docs, Scratch(spark, "exact"))
    return _keep_one(rows, name, numbered, exact_dedup(_keys(rows, name)), "keep_id", True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest doc_id stays; texts without words are in none."""
    scratch = Scratch(spark, "near")
    rows, name, numbered = _numbered(docs, scratch)
    return _keep_one(rows, name, numbered, near_duplicates(_keys(rows, name), scratch, width=5, percent=80), "component_id", False)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null texts hold none."""
    rows, name, _ = _numbered(docs, Scratch(spark, "leaks"))
    found = hits(_keys(rows, name), table(spark, sf_dir, "benchmark"))
    return rows.join(found.select(F.col("doc_id").alias(name)), name, "left_anti").drop(name)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, with digests of the ids and of the text decoded from them; null texts have none."""
    return encode(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: The fitted classifier of the first stage has no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written and read again before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
