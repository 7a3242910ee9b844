"""Corpus pipeline: quality, near duplicates, source mix and packing over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
back as the next one's ``docs``. Documents are handled as alerts: doc_id is the alert id, text the
message, source the area of interest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landpulse.llm import mixing, near_messages, packing, resampling, storage
from landpulse.llm.queries import MIX, labels_of
from landpulse.llm.tokens import public_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws.

    A NULL or empty text has the log ratio 0 and is drawn as such; very long texts are scored whole. Ties
    with the last one drawn are kept, rows that repeat an id share their draw. An empty table stays empty;
    columns named like an alert's give way inside and come back untouched.
    """
    drawn = resampling.resample_by_quality(_as_alerts(docs), labels_of(spark, sf_dir))
    return _documents(drawn.where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-equal ones: the one with the smallest id (of equal ids, with the
    smallest digest of its text).

    Documents are told apart by id and text: of rows that repeat both, one stays, and an id with several
    texts keeps each that is no near copy of another document's or of its own. Documents without an id
    cannot be grouped and stay. Texts without words are equal to their like only; a NULL text is empty.
    Very long texts are compared whole. An empty table stays empty; other columns do not matter.
    """
    alerts = _as_alerts(docs)
    linked = near_messages.near_messages(alerts).where("alert_id IS NOT NULL")
    kept = linked.groupBy("class_text").agg(F.min(F.struct("alert_id", "text")).alias("_kept")).select(
        F.col("_kept.alert_id").alias("_kept_id"), F.col("_kept.text").alias("_kept_text"))
    marked = alerts.where("alert_id IS NOT NULL").withColumn("_digest", near_messages.text_digest(F.coalesce("message_body", F.lit(""))))
    chosen = marked.join(kept, (F.col("alert_id") == F.col("_kept_id")) & (F.col("_digest") == F.col("_kept_text")), "left_semi")
    again = Window.partitionBy("alert_id", "_digest").orderBy(F.lit(0))
    single = chosen.withColumn("_again", F.row_number().over(again)).where("_again = 1").drop("_again", "_digest")
    return _documents(single.unionByName(alerts.where("alert_id IS NULL")), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in random order.

    A NULL source is a source of its own; texts are not looked at, so NULL, empty and very long ones are
    copied as they are. Rows that repeat an id and source get the same number of copies, and copies that
    tie in the order stand in any order. An empty table stays empty.
    """
    return _documents(mixing.replicate_to_weights(_as_alerts(docs), **MIX), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences.

    A NULL or empty text is one piece, its end id; a very long one is cut into whole sequences and a rest.
    Rows with NULL or repeated ids are packed one by one, pieces of equal length change places freely. An
    empty table gives no pieces; columns other than id and text are not used.
    """
    pieces = packing.message_pieces(_as_alerts(docs), public_path("word_bpe_49k.json"))
    return packing.pack_pieces(pieces).withColumnRenamed("alert_id", "doc_id")


NAMES = {"doc_id": "alert_id", "text": "message_body", "source": "aoi_name"}


def _alert_column(column: str) -> str:
    """Documents as alerts; further columns travel under names that clash with nothing."""
    return NAMES.get(column, f"_doc_{column}")


def _as_alerts(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`").alias(_alert_column(c)) for c in docs.columns])


def _documents(alerts: DataFrame, docs: DataFrame) -> DataFrame:
    return alerts.select(*[F.col(f"`{_alert_column(c)}`").alias(c) for c in docs.columns])


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("packing", packed)]

# Neither the hashed n-gram models, the whole-text similarity join nor the packing can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = storage.stored(stage(spark, docs, sf_dir), name)
    return docs
