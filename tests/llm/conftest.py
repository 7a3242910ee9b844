import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from landpulse.llm import storage  # noqa: E402


@pytest.fixture(scope="session")
def alerts(spark):
    """Alerts with NULL columns, an empty and a long message, ties, repeated rows and clashing names."""
    long = "Water rose. " * 4000 + "\n\n" + "No all-clear. " * 50
    base = "Flood alert for the river basin: water covers forty hectares near the old bridge and rises on. "
    rows = [(1, base * 3, "delta"), (2, base * 3 + "New reading at noon.", "delta"), (3, base * 3, "coast"), (4, None, None), (5, "", "coast"),
            (6, long, "delta"), (None, "no id at all", "delta"), (8, "water <|endoftext|> 'll rise\t\n\n  ÉTÉ été 12 345", "coast"), (9, "one", None),
            (9, "one", None), (10, "A different message without any copy in this table, about dry soil.", "coast")]
    return spark.createDataFrame([(i, m, a, "x", 1.5, 7, 8) for i, m, a in rows],
                                 "alert_id long, message_body string, aoi_name string, text string, log_ratio double, _bucket int, mix_copy int")


@pytest.fixture
def empty(alerts):
    return alerts.where("alert_id = -1")


@pytest.fixture
def folder(spark):
    return storage.new_folder(spark, "test")
