"""Katz backoff: n-grams that one batch can count are not sent, and no order's counts are made or dealt twice."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from landpulse.llm import katz, storage

PARTS = 3


def _grouped(tables, column):
    table = pa.concat_tables(tables)
    keys = table[column].to_numpy()
    return {int(k): table.filter(pa.array(keys == k)) for k in np.unique(keys)}


@pytest.mark.parametrize("hot", [400_000, 3])
def test_own_grams_stay(monkeypatch, hot):
    monkeypatch.setattr(katz, "HOT", hot)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(9))), i % 4 == 0, rng.randrange(PARTS)) for i in range(60)]
    ids, texts, held, batch = zip(*rows)
    dealt = next(katz._deal([pa.record_batch({"alert_id": ids, "message_body": texts, "held_out": held, "digest": ids,
                                              "batch": pa.array(batch, pa.int32())})]))
    texts_of, key = _grouped([pa.Table.from_batches([dealt])], "batch"), lambda k: (pa.scalar(k),)
    asked = [katz._ask(PARTS)(key(b), t) for b, t in texts_of.items()]
    told = [katz._count_words(key(p), t) for p, t in _grouped(asked, "part").items()]
    for order in (2, 3):
        of_batch = _grouped(told, "batch")
        sent = {b: katz._send(PARTS, order, 3)(key(b), t, of_batch[b]) for b, t in texts_of.items()}
        told += [katz._count_grams(order, order == 3)(key(p), t) for p, t in _grouped(list(sent.values()), "part").items()]
    found = pa.concat_tables([katz._evaluate(PARTS, 3)(key(b), texts_of[b], t) for b, t in _grouped(told, "batch").items()])

    grams, asks, places, counts, has = defaultdict(set), set(), defaultdict(set), Counter(), Counter()
    for _, text, is_held, b in rows:
        words = ["", "", *text.split(), "</s>"]
        for j in range(2, len(words)):
            h, g = tuple(words[j - 2:j]), tuple(words[j - 2:j + 1])
            grams[b].add(g)
            if is_held:
                asks.add(h)
            else:
                places[h].add(b)
                counts[g] += 1
                has[g[1:]] += 1  # words without the bigram go as one
    start = ("", "")
    for b, table in sent.items():
        kept = {g for g in grams[b] if g[:2] != start and g[:2] not in asks and places[g[:2]] == {b}}
        want = {(g[:2], g[2] if has[g[1:]] else None) for g in grams[b] - kept if places[g[:2]] or g[:2] == start}
        assert kept
        assert sum(len(katz._unpack(x)["train"]) for x in table["blob"].to_pylist()) == len(want)
    total = [r["sums"] for r in found.to_pylist() if r["kind"] == katz.COUNTS and r["ord"] == 3]
    for r in range(1, 7):
        assert sum(s[katz.SUMS.index(f"n{r}")] for s in total) == sum(c == r for c in counts.values())
    assert sum(s[katz.SUMS.index("total")] for s in total) == sum(counts.values())


def test_orders_are_counted_once(spark, monkeypatch):
    monkeypatch.setattr(katz, "BATCH_BYTES", 100)
    plans = []

    def collected(df, label):
        if label == "n-gram-sums":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        return storage_stored(df, label)

    storage_stored = storage.stored
    monkeypatch.setattr(storage, "stored", collected)
    df = spark.createDataFrame([(i, f"water rises at g{i % 7} noon") for i in range(40)], "alert_id long, message_body string")
    assert katz.katz_scores(df, F.col("alert_id") % 5 == 0).count() == 40
    assert plans[0].count("FlatMapGroupsInArrow") == 4  # one for asking, one an order


@pytest.mark.parametrize("bits", [3, 31, 45, 63])
def test_ascending(bits):
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, 2 ** b, 500, np.int64) // 5 * 5 for b in (3, bits, 7)]
    for chosen in (keys, keys[1:], keys[1:2], [k[:0] for k in keys], [k * 0 for k in keys]):
        assert katz._ascending(*chosen).tolist() == np.lexsort(chosen).tolist()
