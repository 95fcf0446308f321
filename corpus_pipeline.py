"""The corpus pipeline: documents through five stages of the training-data operators.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents; the
last returns token ids.  Stages are written as Parquet in between.  All columns may be null, other columns are dropped
whatever their names, an empty table stays empty, and texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, line_dedup, near_dedup, sentencepiece_codec, toxicity
from siltstone.llm.common import broadcast_if_small, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows of docs whose doc_id isn't among ids; the ids are sent to the texts while they are few."""
    return docs.join(broadcast_if_small(written(ids, name), 16), "doc_id", "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go: those with a score of 0.7 or more, that score itself included.  Labels of held-out rows are not
    learned from.  Null and empty texts have no toxic passage and stay, as do rows without a doc_id; of rows that repeat a
    doc_id all go if one of them is toxic; without labels nothing goes."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return _without(docs, toxicity.toxic_passages(docs, model).filter("score >= 0.7").select("doc_id").distinct(), "toxic-ids")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources have go; every row stays, n_chars is counted anew.  A null source is a source; null texts become
    empty ones; a text of nothing but such lines stays whole; rows that repeat are treated alike."""
    return line_dedup.remove_boilerplate(docs, keep=["lang", "source"]).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def _one_of_repeated_rows(docs: DataFrame) -> DataFrame:
    """One row of each doc_id and text, that with the least other columns; rows without a doc_id stay.  Only the texts of
    doc_ids that occur more than once are grouped."""
    ids = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    ids = written(ids, "repeated-ids")
    if ids.isEmpty():
        return docs
    ids = broadcast_if_small(ids, 16)
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    one = docs.join(ids, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("row"))
    return docs.join(ids, "doc_id", "left_anti").select(*COLUMNS).unionByName(one.select("doc_id", "text", "row.*"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five words, 0.8): that with the smallest doc_id.  Of rows that
    repeat its doc_id and text one stays; rows with its doc_id and another text are the same document and stay as well, and so
    do rows without a doc_id.  Null and empty texts are nobody's duplicates."""
    return _one_of_repeated_rows(_without(docs, near_dedup.near_duplicates(docs).filter("not kept").select("doc_id"), "duplicate-ids"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item (80 % of its five-word shingles or more) go.  Null and empty texts and rows
    without a doc_id stay; of rows that repeat a doc_id all go if they contain an item together; without items nothing goes."""
    return _without(docs, decontaminate.contained_items(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaked-ids")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of what is left, with the round trip's outcome, a row for each row; null and empty texts have none."""
    return sentencepiece_codec.round_trip(docs, sentencepiece_codec.default_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", tokenize),
]

#: Learned scores and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
