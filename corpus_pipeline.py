"""The corpus pipeline: documents that are good, single, clean of the benchmark, and packed for training.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the columns of documents; the
last returns packed pieces with their token ids. Stages are written as Parquet and read again, so a lost executor costs
at most one stage's tasks. What a stage stored for itself, and its input, are deleted when its output is written.

Cases, in all stages: a null text counts as an empty one and is judged as such (each stage says how); very long texts are
read whole; columns beside doc_id and text, whatever their names, are passed on unchanged (the last stage leaves them);
an empty table gives no rows. doc_id is an integer; null ids are allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medcorpus.llm.common import scratch, stored, table
from medcorpus.llm.op01_packing import pack_documents
from medcorpus.llm.op02_quality import THRESHOLD, is_held_out, quality_score, train_quality
from medcorpus.llm.op03_near import near_duplicates
from medcorpus.llm.op06_decontam import drop_contaminated
from medcorpus.llm.op10_exact import drop_exact_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, learnt from the labels that are not held out.

    Rows are judged one by one: repeated rows and rows with one doc_id stay or go by their own text, a null doc_id too. Texts with
    the same features tie at one score; a score of just THRESHOLD stays. An empty text has a score like any other.
    """
    labels = table(spark, sf_dir, "labels")
    model = train_quality(docs, labels.filter(~is_held_out(F.col("doc_id"))))
    return docs.filter(quality_score(F.col("text"), model) >= THRESHOLD)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest doc_id (null is the smallest).

    Null and empty texts are one group. Of repeated rows with that doc_id the one with the largest hash of all columns stays.
    """
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): that with the smallest doc_id.

    Texts without words are linked with nothing and stay, as do rows with a null doc_id. Rows with one doc_id are one document: they
    stay or go together.
    """
    dropped = stored(near_duplicates(docs).filter("not kept").select("doc_id").distinct())
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs. Rows are judged one by one; those without text stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences. A text without words is a piece of one id, the end mark; repeated rows are packed once each."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("packing", packing)]
#: Tokens, signatures and learnt tables are beyond SQL; tests/llm/test_pipeline.py has the stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as paths:
            docs = stored(stage(spark, docs, sf_dir))
            own = paths.pop()  # the stage's output is needed by the next one, its input no longer
            if before:
                paths.append(before)
            before = own
    return STAGES[-1][1](spark, docs, sf_dir)
