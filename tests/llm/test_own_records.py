import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from landpulse.llm import archives, boundaries, katz, merkle, mixing, near_messages, packing, storage, token_counts
from landpulse.llm.tokens import public_path

BYTE, WORD = public_path("byte_bpe_50k.json"), public_path("word_bpe_49k.json")
NAMES = "doc_id bigint, text string, source string, lang string, alert_id string, message_body string, aoi_name int, _digest int, _mix_source int"


@pytest.fixture(scope="module")
def text_alerts(spark):
    base = "Flood alert for the river basin: water covers forty hectares near the old bridge and rises on. "
    rows = [("FLOOD_ALERT_TILE1_2022_ab12", base * 3), ("FLOOD_ALERT_TILE2_2022_cd34", base * 3 + "New reading at noon."), ("ALERT_HOLD_Sindh 1", base * 3),
            ("ALERT_HOLD_Ä\"2", None), ("FLOOD_ALERT_TILE9_2022_ef", "A different message about dry soil in another place altogether."), (None, "no id"), ("FLOOD_ALERT_TILE9_2022_ef", "again")]
    return spark.createDataFrame([(a, m, "Sindh", 1, "x") for a, m in rows], "alert_id string, message_body string, aoi_name string, text int, digest string")


def test_text_ids(spark, text_alerts):
    """Every operator keeps ids of any type as they are."""
    ids = sorted((r[0] or "") for r in text_alerts.select("alert_id").collect())
    got = lambda df, c="alert_id": sorted((r[c] or "") for r in df.collect())
    assert got(near_messages.near_messages(text_alerts)) == ids
    near = {r["alert_id"]: r for r in near_messages.near_messages(text_alerts).where("alert_id NOT LIKE '%TILE9%'").collect()}
    assert near["ALERT_HOLD_Sindh 1"]["class_id"] == near["FLOOD_ALERT_TILE2_2022_cd34"]["class_id"] == "ALERT_HOLD_Sindh 1"
    assert got(merkle.compare_with_successor(text_alerts, buckets=3)) == ids
    assert got(packing.pack_pieces(packing.message_pieces(text_alerts, WORD))) == ids
    assert got(token_counts.count_message_tokens(text_alerts, BYTE)) == ids
    assert got(katz.katz_scores(text_alerts, F.lit(False))) == ids
    assert set(got(mixing.replicate_to_weights(text_alerts, epochs=30.0))) == set(ids)
    files = boundaries.write_message_ids(text_alerts, storage.new_folder(spark, "ids"), BYTE)
    back = boundaries.read_message_ids(files, "string")
    assert got(back) == ids and [r["alert_id"] for r in back.orderBy("start").collect()] == sorted((r[0] for r in text_alerts.select("alert_id").collect()), key=lambda i: (i is not None, (i or "").encode()))
    scenes = text_alerts.select(F.col("alert_id").alias("scene_id"), F.col("message_body").alias("content"))
    read = archives.read_archives(archives.write_archives(scenes, storage.new_folder(spark, "warc")), "string").collect()
    assert sorted(r["scene_id"] or "" for r in read) == ids
    assert {(r["scene_id"], r["refers_to"]) for r in read if r["refers_to"]} == {("FLOOD_ALERT_TILE1_2022_ab12", "ALERT_HOLD_Sindh 1")}


def test_successor_of_text_ids(spark):
    rows = [(f"S1A_{i:03d}", f"message {i}. " * (i % 5)) for i in range(80)]
    random.Random(3).shuffle(rows)
    got = {r["alert_id"]: r["edited_sha256"] for r in merkle.compare_with_successor(spark.createDataFrame(rows, "alert_id string, message_body string"), buckets=7).collect()}
    text = dict(rows)
    order = sorted(text, reverse=True)
    for i, a in enumerate(order):
        m, after = text[a], text[order[(i + 1) % 80]]
        assert got[a] == hashlib.sha256((m[:len(m) - len(m) // 3] + after[:len(m) // 3]).encode()).hexdigest()


# --- pipeline stages --------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def odd_docs(spark):
    """Repeated ids and rows, NULLs, empty and long texts, and columns named like an alert's."""
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, base, "a"), (2, base, "a"), (2, "a text of its own that nothing else in here resembles at all", "a"), (3, "equal rows " * 9, "b"), (3, "equal rows " * 9, "b"),
            (4, None, None), (5, "", "b"), (6, base + " end", "a"), (None, base, "a"), (None, None, "b"), (7, "long " * 60_000, "b"), (8, "one", "b"), (9, "One", "b"),
            (10, base + " more than that", None), (10, base + " less than that", None)]
    return spark.createDataFrame([(i, t, s, "en", "other", "clash", 3, 4, 5) for i, t, s in rows], NAMES)


def test_near_duplicates_by_id_and_text(spark, odd_docs):
    out = corpus_pipeline.near_duplicates(spark, odd_docs, "unused")
    assert out.columns == odd_docs.columns and {r["alert_id"] for r in out.collect()} == {"other"}
    kept = sorted((r["doc_id"] or 0, (r["text"] or "")[:12]) for r in out.collect())
    assert kept == sorted([(1, "word0 word1 "), (2, "a text of it"), (3, "equal rows e"), (4, ""), (0, "word0 word1 "), (0, ""), (7, "long long lo"), (8, "one")])  # 9 differs from 8 by a capital only


def test_near_duplicates_of_one_id(spark):
    """Two near texts of one id: one stays."""
    base = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(10, base + " more than that"), (10, base + " less than that"), (11, "else")], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "unused").collect()) == [10, 11]


def test_other_stages_keep_columns(spark, odd_docs, sf):
    drawn = corpus_pipeline.quality(spark, odd_docs, sf)
    assert drawn.columns == odd_docs.columns and drawn.count() <= odd_docs.count()
    mixed = corpus_pipeline.source_mix(spark, odd_docs, sf)
    assert mixed.columns == odd_docs.columns and {r["_mix_source"] for r in mixed.collect()} <= {5}
    pieces = corpus_pipeline.packed(spark, odd_docs, sf).collect()
    assert sorted({(r["doc_id"] or 0) for r in pieces}) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10] and all(1 <= r["length"] <= 2048 for r in pieces)
    assert max(r["piece"] for r in pieces if r["doc_id"] == 7) == len([r for r in pieces if r["doc_id"] == 7]) - 1


def test_stages_of_an_empty_table(spark, odd_docs, sf):
    none = odd_docs.where("doc_id = -5")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
