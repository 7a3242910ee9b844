import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from landpulse.llm import queries, ranked_search, repeated_passages, target_draw
from landpulse.llm.interning import InternTable, word_runs, xxhash64_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def flood_alerts(spark):
    """Alerts with text ids, copies, repeated rows, NULLs, an empty and a long message, clashing names."""
    hold = "Satellite observation unavailable or obscured. Current alert state held safely without clearance."
    long = "The gauge at Sukkur rose by ten centimetres. " * 3000 + hold
    rows = [("FLOOD_ALERT_T1_2022-08-30", hold + " Tile one: 12 ha, 3 events, basin flooded since the morning pass of the radar."),
            ("FLOOD_ALERT_T2_2022-08-30", hold + " Tile two: 90 ha, 7 events."), ("FLOOD_ALERT_T3_2022-08-30", hold + " Tile two: 90 ha, 7 events."),
            ("ALERT_HOLD_T4", None), ("ALERT_HOLD_T5", ""), ("FLOOD_ALERT_T6", long), (None, "an alert without id " * 9), (None, "another one without id " * 9),
            ("FLOOD_ALERT_T8", "one"), ("FLOOD_ALERT_T8", "one"), ("FLOOD_ALERT_T9", "ÉTÉ été " + "x" * 90 + " Ünder wässer 日本 12-ha"), ("FLOOD_ALERT_T9", "." * 700 + "ab" * 300)]
    return spark.createDataFrame([(a, m, "x", 1, 2.5, "y") for a, m in rows],
                                 "alert_id string, message_body string, rank string, segment int, score double, tie string")


# --- interning ------------------------------------------------------------------------------------

def test_intern_table_verifies_bytes():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé日") for _ in range(rng.randrange(1, 70))).encode() for _ in range(3000)]
    data = np.frombuffer(b" ".join(words) + b" " * 16, np.uint8)
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes + 1) - sizes - 1
    keys = xxhash64_spans(data, starts, starts + sizes)
    assert keys.tolist() == [xxhash.xxh64_intdigest(w) for w in words]
    for given in (keys, keys % np.uint64(7), np.zeros_like(keys)):  # also with colliding keys
        table = InternTable(data, starts, starts + sizes, given)
        of_slot = dict(zip(table.used.tolist(), table.spans(data)))
        assert [of_slot[s] for s in table.slot.tolist()] == words
        assert {of_slot[s]: int(table.count[s]) for s in of_slot} == Counter(words)


def test_word_runs_keep_messages_apart():
    texts = ["Ab-cd", None, "", "ef", "GH ij", "--", "é1 É1", "z" * 300]
    got = []
    for run in word_runs(pa.array(texts, pa.string()), limit=8):
        words = [bytes(run.data[a:b]).decode() for a, b in zip(run.starts, run.ends)]
        cuts = np.cumsum(run.counts)
        got += [words[b - n:b] for b, n in zip(cuts, run.counts)]
        pairs = run.ngrams(2)
        assert [bytes(run.data[a:b]).decode() for a, b in zip(*pairs[:2])] == [f"{x} {y}" for w in got[run.begin:run.end] for x, y in zip(w, w[1:])]
    assert got == [words_of(t) for t in texts]


# --- draw like a target -----------------------------------------------------------------------------

def brute_draw(alerts, targets, percent, least, seed):
    def features(text):
        w = words_of(text)
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    raw, target = Counter(), Counter()
    for texts, counts in ((alerts, raw), (targets, target)):
        for _, text in texts:
            counts.update(zlib.crc32(f.encode()) % 10_000 for f in features(text))
    s_all, t_all = sum(raw.values()), sum(target.values())
    gain = lambda b: math.floor(1000 * math.log((target[b] + 1) * (s_all + 10_000) / ((raw[b] + 1) * (t_all + 10_000))))
    out = []
    for i, text in alerts:
        f = features(text)
        weight = sum(gain(zlib.crc32(x.encode()) % 10_000) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or ""))
    drawn = {id(r): k + 1 for k, r in enumerate(able[:percent * len(able) // 100])}
    return [(*r[:4], drawn.get(id(r))) for r in out]


@pytest.mark.parametrize("percent,least", [(25, 3), (60, 1), (100, 0)])
def test_draw_like_target(spark, flood_alerts, percent, least):
    rng = random.Random(percent)
    more = [(f"FLOOD_ALERT_{i:03d}", " ".join(rng.choice(["water", "rose", "gauge", "dam", "é", "12"]) for _ in range(rng.randrange(40)))) for i in range(600)]
    df = flood_alerts.unionByName(spark.createDataFrame(more, "alert_id string, message_body string"), allowMissingColumns=True)
    verified = [("V1", "water rose at the gauge"), ("V2", None), ("V3", "water rose")]
    targets = spark.createDataFrame(verified, "alert_id string, message_body string")
    got = target_draw.draw_like_target(df, targets, percent=percent, min_words=least).collect()
    want = brute_draw([(r["alert_id"], r["message_body"]) for r in df.collect()], verified, percent, least, "7")
    key = lambda r: tuple((x is not None, x or 0) if k else (x is not None, x or "") for k, x in enumerate(r))
    tied = {"FLOOD_ALERT_T8", "FLOOD_ALERT_T9", None}  # rows that repeat an id may change places
    assert sorted((tuple(r) for r in got if r["alert_id"] not in tied), key=key) == sorted((r for r in want if r[0] not in tied), key=key)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted((r[:4] for r in want), key=key)
    assert sorted(r["rank"] for r in got if r["rank"]) == sorted(r[4] for r in want if r[4])


def test_draw_from_empty_tables(flood_alerts):
    none = flood_alerts.where("alert_id = 'none'")
    assert target_draw.draw_like_target(none, flood_alerts).count() == 0
    assert target_draw.draw_like_target(flood_alerts, none).count() == 12


# --- repeated passages ------------------------------------------------------------------------------

def brute_cut(rows, length):
    """Removed spans and kept bytes per (id, message), ids in ascending order, each id with one message."""
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        body = (text or "").encode()
        gone = bytearray(len(body) + 1)
        for p in range(len(body) - length + 1):
            if body[p:p + length] in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(body[p:p + length])
        turns = [p for p in range(len(body) + 1) if gone[p] != (gone[p - 1] if p else 0)]
        out[i] = (len(body), list(zip(turns[::2], turns[1::2])), bytes(b for b, g in zip(body, gone) if not g))
    return out


def passages(seed, name):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["water", "rose", "é", "gauge", "日本", "x", "0", "  ", "dam", "flood "]) for _ in range(n))
    common = [text(rng.randrange(10, 80)) for _ in range(6)]
    rows = [" ".join(rng.choice(common) if rng.random() < 0.5 else text(rng.randrange(1, 60)) for _ in range(rng.randrange(6))) for _ in range(120)]
    line = "This line of the bulletin is the same in every alert of the table and long enough by a hair"
    rows += [text(20) + line + text(20) for _ in range(80)] + [rows[3]] * 30
    rows += ["ab" * 400 + "x" + "." * 700 + "abc" * 200, "." * 350 + "ab" * 90, common[0] * 40, None, ""]
    rows = [(name(i), t) for i, t in enumerate(rows)] + [(None, common[1] * 3)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,length,bucket_rows,piece_bytes,text_ids", [
    (1, 100, 50, 1000, False), (2, 100, 10**6, 10**6, False), (3, 60, 20, 700, True), (4, 101, 30, 300, False)])
def test_remove_repeated_passages(spark, seed, length, bucket_rows, piece_bytes, text_ids):
    """Small buckets cut groups at many splitters, small pieces cut long messages."""
    rows = passages(seed, (lambda i: f"FLOOD_ALERT_{i:04d}") if text_ids else int)
    df = spark.createDataFrame(rows, f"alert_id {'string' if text_ids else 'long'}, message_body string").withColumn("tie", F.lit("x"))
    cut = repeated_passages.remove_repeated_passages(df, length, bucket_rows, piece_bytes).collect()
    got = {r["alert_id"]: (r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept_body"])) for r in cut}
    assert len(cut) == len(rows) and got == brute_cut(rows, length)


def test_passages_of_repeated_ids(flood_alerts):
    rows = [(r["alert_id"], r["message_body"]) for r in flood_alerts.collect()]
    cut = [(r["alert_id"], bytes(r["kept_body"]), r["n_bytes"]) for r in repeated_passages.remove_repeated_passages(flood_alerts).collect()]
    assert Counter((i, n) for i, _, n in cut) == Counter((i, len((m or "").encode())) for i, m in rows)
    kept = dict((i, b) for i, b, _ in cut)
    hold = rows[0][1][:96].encode()
    # ids in order: T1 keeps its hold line, T2 shares 96 bytes with it and a whole text with T3
    assert kept["FLOOD_ALERT_T1_2022-08-30"].startswith(hold) and kept["FLOOD_ALERT_T3_2022-08-30"] == b""
    assert kept["FLOOD_ALERT_T8"] == b"one" and len(kept["FLOOD_ALERT_T6"]) < 300
    assert sorted(b for i, b, _ in cut if i is None and b.startswith(b"an "))  # NULL ids are records of their own
    assert repeated_passages.remove_repeated_passages(flood_alerts.where("alert_id = 'none'")).count() == 0
    with pytest.raises(ValueError):
        repeated_passages.remove_repeated_passages(flood_alerts, length=10)


def test_multikey_quicksort():
    rng = np.random.default_rng(2)
    columns = [rng.integers(0, 4, 3000).astype(np.uint64) for _ in range(5)]
    order, tied = repeated_passages.multikey_quicksort(3000, lambda k, at: columns[k][at], 5)
    rows = list(zip(*(c[order].tolist() for c in columns)))
    assert rows == sorted(rows) and tied.tolist() == [False] + [a == b for a, b in zip(rows, rows[1:])]


# --- ranked search ------------------------------------------------------------------------------------

def brute_search(alerts, titles, k):
    docs = [(i, Counter(words_of(m))) for i, m in alerts]
    n_docs, n_terms = sum(1 for _, c in docs if c), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = set()
    asked = {}
    for i, t in set(titles):
        asked.setdefault(i, Counter()).update(words_of(t))
    for i, terms in asked.items():
        scored = []
        for a, c in docs:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, n in terms.items() if c[t])
            if score > 0:
                scored.append((-score, a is not None, a or "", a))
        out |= {(i, rank + 1, a, -s) for rank, (s, _, _, a) in enumerate(sorted(scored)[:k])}
    return out


def some_alerts(flood_alerts, spark, seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    body = lambda: " ".join(vocabulary[min(int(rng.expovariate(0.02)), 299)] for _ in range(rng.randrange(60)))
    more = [(f"FLOOD_ALERT_{i:05d}", body()) for i in range(n)]
    more += [(f"FLOOD_COPY_{i:03d}", more[5][1]) for i in range(30)]
    titles = [(f"Q{i}", body() + " flood Gauge rose") for i in range(25)] + [("Q1", "rose rose observation"), ("Q1", "rose rose observation"), (None, "tile two"), ("E", ""), ("N", None)]
    plain = flood_alerts.select("alert_id", "message_body").distinct()
    return (plain.unionByName(spark.createDataFrame(more, "alert_id string, message_body string")).withColumn("segment", F.lit(1)),
            spark.createDataFrame(titles, "alert_id string, message_title string").withColumn("term", F.lit("x")))


@pytest.mark.parametrize("small,block", [(True, 50_000), (False, 200)])
def test_rank_alerts(spark, flood_alerts, monkeypatch, small, block):
    if not small:  # index every word, several blocks of titles, salted join
        monkeypatch.setattr(ranked_search, "SMALL_TERMS", 10)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", block)
    alerts, titles = some_alerts(flood_alerts, spark, 3, 1500)
    got = {tuple(r) for r in ranked_search.rank_alerts(alerts, titles, k=7).collect()}
    assert got == brute_search([tuple(r)[:2] for r in alerts.collect()], [tuple(r)[:2] for r in titles.collect()], 7)


def test_search_of_empty_tables(spark, flood_alerts):
    alerts, titles = some_alerts(flood_alerts, spark, 4, 20)
    assert ranked_search.rank_alerts(alerts.where("alert_id = 'none'"), titles).count() == 0
    assert ranked_search.rank_alerts(alerts, titles.where("alert_id = 'none'")).count() == 0


def test_best_places_skips_exactly():
    rng = np.random.default_rng(5)
    for size in (40, 5000):
        for _ in range(60):
            lists = []
            for _ in range(rng.integers(0, 9)):
                places = np.flatnonzero(rng.random(size) < rng.choice([0.002, 0.05, 0.6]))
                lists.append((places, rng.integers(0, int(rng.choice([3, 10**6])), len(places))))
            total = np.zeros(size, np.int64)
            for places, gains in lists:
                total[places] += gains
            want = [p for p in np.lexsort((np.arange(size), -total))[:10].tolist() if total[p] > 0]
            places, scores = ranked_search.best_places(lists, size, 10)
            assert places.tolist() == want and scores.tolist() == total[want].tolist()


def test_new_queries_cover_whole_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op11_target_draw", "op12_suffix_dedup"):
        assert queries.QUERIES[name](spark, sf).count() == docs and name in queries.ORACLES
    items = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    assert queries.QUERIES["op13_ranked_search"](spark, sf).select("item_id").distinct().count() == items
