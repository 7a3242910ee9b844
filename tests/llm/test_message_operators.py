import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from landpulse.llm import (archives, boundaries, katz, lexing, merkle, mixing, multi_index, near_messages, packing, queries, resampling, token_counts)
from landpulse.llm.tokens import encoder, public_path
from landpulse.llm.words import hashed_words

BYTE, WORD = public_path("byte_bpe_50k.json"), public_path("word_bpe_49k.json")


def messages(alerts):
    return [(r["alert_id"], r["message_body"] or "") for r in alerts.collect()]


def word_list(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ")


def words_of(text):
    return [w for w in word_list(text) if w]


# --- tokens ------------------------------------------------------------------------------------

PIECES = ["'s", "'re", "'rx", "'ll", "'lx", " ", "  ", "\n", "\t", " ", "a", "E", "é", "1", "²", "!", "--", "'", " '", "<|endoftext|>",
          "<|startoftext|>", "Σ", "İ", "日本", "é", "\r\n", "😀", "\x1c", "\x85", "ﬁ", "<|", "\0"]


@pytest.mark.parametrize("path,kind", [(BYTE, "byte_level"), (WORD, "word")])
def test_encoder_equals_library(path, kind):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(50))) for _ in range(1500)] + ["", "a" * 3000, " " * 900, "'" * 600]
    got = []
    for _, _, flat, sizes in encoder(path, kind).encode(texts):
        got += [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]
    assert got == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_transducer_counts_and_small_tables():
    rng = random.Random(4)
    texts = ["".join(rng.choice(PIECES + ["water", "hectares", "tion"]) for _ in range(40)) for _ in range(400)]
    want = [len(e.ids) for e in Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)]
    small = token_counts.MessageCounter(BYTE, slots=64)
    small.merges.max_states = 50  # dropped again and again
    assert small.count(texts).tolist() == want


def test_state_maps_compose_like_a_serial_run():
    lexer = lexing.Lexer("byte_level")
    codes = np.frombuffer(("ab 'll  x\n\n''re 12 " * 200).encode("utf-32-le"), "<u4")
    starts, _ = lexer.cut(codes)
    state, flags = 0, []
    for c in lexing.Lexer._classes[codes]:
        at = state * len(lexing.CLASSES) + int(c)
        flags.append(int(lexer.flag[at]))
        state = int(lexer.move[at])
    serial = [i for i in range(len(flags)) if flags[i] & 1 or i + 1 < len(flags) and flags[i + 1] & 2]
    assert starts.tolist() == serial


def test_count_message_tokens(alerts, empty):
    got = sorted((r["alert_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_message_tokens(alerts, BYTE).collect())
    tok = Tokenizer.from_file(BYTE)
    want = sorted((i or 0, len(m.encode()), n := len(tok.encode(m, add_special_tokens=False).ids), n > 512) for i, m in messages(alerts))
    assert got == want and token_counts.count_message_tokens(empty, BYTE).count() == 0


# --- boundaries ----------------------------------------------------------------------------------

@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], list(range(0, 9000, 7)), [0, 1 << 40, 1 << 62], sorted(random.Random(1).choices(range(10**6), k=5000))])
def test_elias_fano_select(values):
    coded = boundaries.EliasFano.read(io.BytesIO(boundaries.EliasFano.of(np.array(values, np.uint64)).to_bytes()))
    assert coded.select(0, len(values)).tolist() == values
    for i in range(0, len(values), max(1, len(values) // 37)):
        assert coded.select(i, i + 1).tolist() == [values[i]]


def test_elias_fano_space():
    ends = np.cumsum(np.full(20_000, 500))
    assert len(boundaries.EliasFano.of(ends).to_bytes()) < 20_000 * 12 / 8


def test_message_ids_round_trip(alerts, empty, folder):
    files = boundaries.write_message_ids(alerts, folder, BYTE)
    rows = sorted(boundaries.read_message_ids(files).collect(), key=lambda r: r["start"])
    tok = Tokenizer.from_file(BYTE)
    want = Counter((i, tuple(tok.encode(m, add_special_tokens=False).ids + [2])) for i, m in messages(alerts))
    assert Counter((r["alert_id"], tuple(r["token_ids"])) for r in rows) == want
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    keys = [r["alert_id"] for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["token_ids"], "<u4").tobytes()) for r in rows)
    assert boundaries.read_message_ids(boundaries.write_message_ids(empty, folder + "-e", BYTE)).count() == 0


# --- packing -------------------------------------------------------------------------------------

def test_fullest_is_the_best_subset_sum():
    rng = random.Random(5)
    for _ in range(200):
        have = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 6))}
        room = rng.randint(0, 60)
        reach = {0}
        for k, n in have.items():
            reach = {s + k * t for s in reach for t in range(n + 1) if s + k * t <= room}
        chosen = packing.fullest(have, room)
        assert sum(k * n for k, n in chosen.items()) == max(reach) and all(n <= have[k] for k, n in chosen.items())


def test_pack_pieces(alerts, empty):
    pieces = packing.message_pieces(alerts, WORD, capacity=64)
    rows = packing.pack_pieces(pieces, 64).collect()
    tok = Tokenizer.from_file(WORD)
    assert sum(r["length"] for r in rows) == sum(len(tok.encode(m, add_special_tokens=False).ids) + 1 for _, m in messages(alerts))
    bins = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert r["offset"] == bins.get(r["sequence_id"], 0)
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values()) <= 64 and len(bins) <= -(-sum(bins.values()) // 64) + 1
    assert packing.pack_pieces(packing.message_pieces(empty, WORD)).count() == 0


# --- mixing --------------------------------------------------------------------------------------

@pytest.mark.parametrize("mean", [0.01, 0.7, 3.0, 900.0])
def test_poisson_table(mean):
    table = mixing.poisson_table(mean)
    for k in (0, 1, int(mean), int(mean) + 5):
        want = math.fsum(math.exp(j * math.log(mean) - mean - math.lgamma(j + 1)) for j in range(k + 1))
        assert table[min(k, len(table) - 1)] == pytest.approx(want, abs=1e-12)


def test_mixing(spark, alerts, empty):
    rows = mixing.replicate_to_weights(alerts, targets={"delta": 3.0, "coast": 1.0}, epochs=20.0).collect()
    assert {r["aoi_name"] for r in rows} == {"delta", "coast"} and all(0 <= r["mix_copy"] < r["mix_copies"] for r in rows)
    assert [r["mix_order"] for r in rows] == sorted(r["mix_order"] for r in rows)
    big = spark.range(20_000).select(F.col("id").alias("alert_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("aoi_name"))
    share = {r["aoi_name"]: r["count"] / 20_000 for r in mixing.replicate_to_weights(big, {"a": 0.75, "b": 0.25}).groupBy("aoi_name").count().collect()}
    assert share["a"] == pytest.approx(0.75, abs=0.03) and share["b"] == pytest.approx(0.25, abs=0.03)
    assert mixing.replicate_to_weights(empty).count() == 0


# --- archives ------------------------------------------------------------------------------------

def test_archives_round_trip(spark, folder):
    body = "<p>" + "scene metadata " * 20
    rows = [(i, f"https://scenes/{i} x", body + str(i % 7) if i % 5 else "short") for i in range(1, 400)] + [(500, None, None), (501, "u", "")]
    scenes = spark.createDataFrame(rows, "scene_id long, href string, content string").withColumn("_digest", F.lit(1))
    read = {r["scene_id"]: r for r in archives.read_archives(archives.write_archives(scenes, folder)).collect()}
    first = {}
    for i, _, c in rows:
        data = (c or "").encode()
        r, refers = read[i], None
        if len(data) >= 100:
            first.setdefault(data, i)
            refers = first[data] if first[data] != i else None
        assert (r["payload_bytes"], r["payload_digest"], r["refers_to"]) == (len(data), hashlib.sha256(data).hexdigest(), refers)
        assert r["record_type"] == ("revisit" if refers else "response") and r["payload"] == (None if refers else data)
    nothing = archives.write_archives(scenes.where("scene_id < 0"), folder + "-e")
    assert archives.read_archives(nothing).count() == 0


def test_archive_checks():
    import zstandard as zstd

    good = archives.record_bytes(1, "u", b"payload" * 30, None)
    samples = [b"water level %d at gauge %d, " % (i, i * 7) * 40 for i in range(400)]
    dictionary = archives.train_dictionary(samples)
    assert dictionary
    pack = zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(dictionary), write_checksum=True).compress
    whole = archives.dictionary_frame(dictionary) + pack(good) + pack(archives.record_bytes(2, "u", b"", None))
    assert [r["payload"] for r in archives.read_archive(io.BytesIO(whole))] == [b"payload" * 30, b""]
    for bad in (whole[:-3], archives.dictionary_frame(dictionary) + pack(good[:-4]), archives.dictionary_frame(dictionary) + pack(good.replace(b"payload", b"payloaf", 1)),
                archives.dictionary_frame(dictionary) + pack(good.replace(b"WARC-Date", b"WARC-Dat")), b"junk" * 9, pack(good) + archives.dictionary_frame(dictionary)):
        with pytest.raises((archives.ArchiveError, zstd.ZstdError)):
            list(archives.read_archive(io.BytesIO(bad)))


# --- Merkle trees --------------------------------------------------------------------------------

def test_merkle(alerts, empty):
    rows = {r["alert_id"]: r for r in merkle.compare_with_successor(alerts, buckets=5).where("alert_id IS NOT NULL AND alert_id <> 9").collect()}
    texts = {i: m for i, m in messages(alerts)}
    following = {10: "one", 8: texts[6], 6: "", 5: "", 4: texts[3], 3: texts[2], 2: texts[1], 1: texts[None]}
    for i, after in following.items():
        m = texts[i]
        edited = m[:len(m) - len(m) // 3] + after[:len(m) // 3]
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows[i]["n_chars"] == len(m)
        assert 0 <= rows[i]["near_next"] <= 1 and (rows[i]["fingerprint"] == rows[i]["edited_fingerprint"]) == (edited == m)
    assert rows[1]["fingerprint"] == rows[3]["fingerprint"] != rows[2]["fingerprint"]
    assert 0.4 < rows[10]["near_edited"] < 0.8 and rows[2]["near_next"] > 0.8
    assert merkle.compare_with_successor(empty).count() == 0 and len(merkle.fingerprint_messages(alerts).collect()) == 11


def hand_cut(text):
    """Sections of paragraphs of leaves: (text, place), sentences of 32 code points at most."""
    cuts = [0, *(n for n in range(2, len(text)) if text[n - 2:n] == "\n\n"), len(text)]
    sections = []
    for i, section in enumerate(text[a:b] for a, b in zip(cuts, cuts[1:]) if a < b):
        paragraphs = []
        for j, paragraph in enumerate(re.findall(r"[^\n]*\n|[^\n]+\Z", section)):
            leaves, leaf = [], ""
            for n, c in enumerate(paragraph):
                leaf += c
                if n + 1 == len(paragraph) or re.search(r"[.!?] \Z", paragraph[:n + 1]) or len(leaf) == 32:
                    leaves.append((leaf, (i, j, len(leaves))))
                    leaf = ""
            paragraphs.append(leaves)
        sections.append(paragraphs)
    return sections


def placed_leaves(text):
    return [x for s in hand_cut(text) for p in s for x in p]


def brute_edits(a, b):
    def words(item):
        return item[0] if isinstance(item, tuple) else [words(x) for x in item]

    left, right = hand_cut(a), hand_cut(b)
    for level in range(3):  # sections, paragraphs, leaves
        while left and right and words(left[0]) == words(right[0]):
            left, right = left[1:], right[1:]
        while left and right and words(left[-1]) == words(right[-1]):
            left, right = left[:-1], right[:-1]
        if level < 2:
            left, right = [x for s in left for x in s], [x for s in right for x in s]
    spare = {}
    for n, (x, _) in enumerate(right):
        spare.setdefault(x, []).append(n)
    pairs = [(m, spare[x].pop(0)) if spare.get(x) else (m, None) for m, (x, _) in enumerate(left)]
    there = [(m, n) for m, n in pairs if n is not None]
    rank = {n: j for j, n in enumerate(sorted(n for _, n in there))}
    shift = [rank[n] - i for i, (_, n) in enumerate(there)]
    runs = [0] + [i for i in range(1, len(shift)) if shift[i] != shift[i - 1]] + [len(shift)]
    size, start = max(((b - a, -a) for a, b in zip(runs, runs[1:])), default=(0, 0))
    taken = {n for _, n in there}
    return ([("removed", left[m][1], None) for m, n in pairs if n is None] + [("added", None, at) for n, (_, at) in enumerate(right) if n not in taken]
            + [("moved", left[m][1], right[n][1]) for i, (m, n) in enumerate(there) if not -start <= i < size - start])


def edits_of(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    found = df.select("i", merkle.changed_branches(merkle.merkle_tree(F.col("a")), merkle.merkle_tree(F.col("b"))).alias("e")).collect()
    return [[(e["kind"], *(tuple(e[s]) if e[s] else None for s in ("before", "after"))) for e in r["e"]] for r in sorted(found, key=lambda r: r["i"])]


def test_merkle_locates_edits(spark):
    text = "Head one.\nHead two.\n\nBody one. Body two. Body three. Body four.\nLast."
    swap, twice = text.replace("Body two. Body three.", "Body three. Body two."), text.replace("Body two. ", "Body two. Body two. ")
    got = edits_of(spark, [(text, text), (text, text.replace("Body two. ", "")), (text, swap), (text, twice), (text, text.replace("Body two", "Body 2")), ("", ""), ("", "New.")])
    assert got == [[], [("removed", (1, 0, 1), None)], [("moved", (1, 0, 2), (1, 0, 1))], [("added", None, (1, 0, 2))],
                   [("removed", (1, 0, 1), None), ("added", None, (1, 0, 1))], [], [("added", None, (0, 0, 0))]]


def test_merkle_edits_equal_brute_force(spark):
    rng = random.Random(9)
    piece = lambda: rng.choice(["Rain. ", "Gauge up! ", "Is it? ", "a", "the river ran high and higher all night long ", "x\n", "\n\n", "é. "])
    pairs = []
    for _ in range(150):
        a = [piece() for _ in range(rng.randrange(25))]
        b = list(a)
        for _ in range(rng.randrange(4)):
            at, to = rng.randrange(len(b) + 1), rng.randrange(len(b) + 1)
            b[at:at + rng.randrange(3)] = [piece() for _ in range(rng.randrange(3))]
            if b and rng.random() < 0.4:
                b.insert(to % len(b), b.pop(at % len(b)))
        pairs.append(("".join(a), "".join(b)))
    for (a, b), got in zip(pairs, edits_of(spark, pairs)):
        assert got == brute_edits(a, b), (a, b)
        assert bool(got) == (a != b)


def test_merkle_query_returns_every_edit_and_likeness(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    order = sorted(docs, reverse=True)
    compared = queries.QUERIES["op6_merkle"](spark, sf)
    assert not re.search("Python|Arrow|Pandas", compared._jdf.queryExecution().executedPlan().toString())

    def likeness(a, b):
        a, b = {x for x, _ in placed_leaves(a)}, {x for x, _ in placed_leaves(b)}
        size = lambda leaves: sum(map(len, leaves))
        return 2 * size(a & b) / (size(a) + size(b)) if a | b else 1.0

    rows = {r["doc_id"]: r for r in compared.collect()}
    assert set(rows) == set(docs)
    for i, d in enumerate(order):
        text, after = docs[d], docs[order[(i + 1) % len(order)]]
        edited = text[:len(text) - len(text) // 3] + after[:len(text) // 3]
        found = [(e["kind"], *(tuple(e[s]) if e[s] else None for s in ("before", "after"))) for e in rows[d]["edit_places"]]
        assert found == brute_edits(text, edited)
        assert rows[d]["near_edited"] == pytest.approx(likeness(text, edited)) and rows[d]["near_next"] == pytest.approx(likeness(text, after))


# --- multi-index ---------------------------------------------------------------------------------

def test_traverse_by_summed_distance():
    rng = np.random.default_rng(0)
    a, b, counts = rng.random(7), rng.random(9), rng.integers(0, 3, (7, 9))
    cells = multi_index.traverse(a, b, counts, 10**9)
    sums = [a[c // 9] + b[c % 9] for c in cells]
    assert sums == sorted(sums) and sorted(cells) == np.flatnonzero(counts.ravel()).tolist()


def test_nearest_signatures(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(1000 + i, [1.0] * 8) for i in range(60)]
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] + [1.0] * 7), (2003, [None] + [1.0] * 7), (2004, [float("inf")] * 8), (2005, [1.0]), (None, [1.0] * 8)]
    tiles = spark.createDataFrame(rows, "tile_id long, signature array<double>").withColumn("members", F.lit(0))
    got = {}
    for r in multi_index.nearest_signatures(tiles, F.col("tile_id") % 20 == 0, k=20, recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["tile_id"], r["score"]))
    valid = {i: np.array(v) for i, v in rows if i is not None and (i < 2000)}
    hits = 0
    for q, found in got.items():
        want = sorted(((-float(valid[q] @ v), i) for i, v in valid.items() if i != q))[:20]
        hits += len({i for i, _ in found} & {i for _, i in want})
        assert len(found) == 20 and all(s == pytest.approx(float(valid[q] @ valid[i])) for i, s in found)
    assert set(got) == {i for i in valid if i % 20 == 0} and hits >= 0.9 * 20 * len(got)
    assert [i for i, _ in got[1000]] == list(range(1001, 1021))  # equal signatures: smaller ids first
    assert multi_index.nearest_signatures(tiles.where("tile_id < 0"), F.lit(True)).count() == 0


# --- near messages -------------------------------------------------------------------------------

def brute_links(texts, n=5, t=0.8):
    sets = {}
    for x in set(texts):
        w = words_of(x)
        sets[x] = {tuple(w)} if 0 < len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
    return {x: {y for y in sets if y != x and sets[x] and len(sets[x] & sets[y]) >= t * len(sets[x] | sets[y])} for x in sets}


def test_near_messages(spark, alerts, empty, monkeypatch):
    rng = random.Random(2)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    group = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        group.append((100 + i, " ".join(w), "delta"))
    df = alerts.select("alert_id", "message_body", "aoi_name").unionByName(spark.createDataFrame(group, "alert_id long, message_body string, aoi_name string"))
    monkeypatch.setattr(near_messages, "BLOCK", 16)  # several blocks per band
    rows = near_messages.near_messages(df).collect()
    assert len(rows) == df.count()
    known = [(i, m) for i, m in messages(df) if i is not None]
    links, first = brute_links([m for _, m in known]), {}
    for i, m in known:
        first[m] = min(first.get(m, i), i)
    parent = {m: {m} for m in links}
    for m in links:
        seen, todo = {m}, [m]
        while todo:
            for y in links[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        parent[m] = seen
    text = dict(known)
    for r in rows:
        if r["alert_id"] is None:
            assert r["class_id"] is None
            continue
        m = text[r["alert_id"]]
        assert (r["text_id"], r["n_links"], r["class_id"]) == (first[m], len(links[m]), min(first[y] for y in parent[m]))
    assert near_messages.near_messages(empty).count() == 0


def test_pruning_bound():
    for n, need in near_messages.fewest_matches(0.8, 1e-6):
        lost = sum(math.comb(n, m) * 0.8 ** m * 0.2 ** (n - m) for m in range(need))
        assert lost < 1e-5


# --- resampling ----------------------------------------------------------------------------------

def test_resampling(spark, alerts, empty):
    good = [(i, f"the water level at gauge {i % 17} rose and the basin was full by noon") for i in range(300)]
    junk = [(1000 + i, " ".join(f"zz{(i * k) % 997}$$$" for k in range(14))) for i in range(100)]
    df = spark.createDataFrame(good + junk, "alert_id long, message_body string").withColumn("kept", F.lit("x"))
    labels = spark.createDataFrame([(i, 1) for i in range(0, 300, 2)] + [(1000 + i, 0) for i in range(0, 100, 2)] + [(3, None)], "alert_id long, quality int")
    rows = resampling.resample_by_quality(df, labels).collect()
    assert len(rows) == 400
    assert sum(r["kept"] for r in rows if r["alert_id"] < 1000) >= 294 and not any(r["kept"] for r in rows if r["alert_id"] >= 1000)
    ten = resampling.resample_by_quality(df, labels, k=10).collect()
    top = sorted(ten, key=lambda r: -r["gumbel_key"])[:10]
    assert {r["alert_id"] for r in ten if r["kept"]} == {r["alert_id"] for r in top}
    assert resampling.resample_by_quality(alerts, labels.where("quality = 5")).where("kept").count() == 11
    assert resampling.resample_by_quality(empty, labels).count() == 0


def test_kth_largest(spark):
    values = [random.Random(8).choice([0.5, random.random(), -3.0, 1e9]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 700, 1500, 2999):
        assert resampling.kth_largest(df, "v", k, bins=16) == ordered[k - 1]


# --- Katz backoff --------------------------------------------------------------------------------

@pytest.mark.parametrize("batch,hot,order", [(12 << 20, 400_000, 3), (3000, 40, 3), (3000, 40, 2), (3000, 15, 4)])
def test_katz(spark, alerts, empty, monkeypatch, batch, hot, order):
    monkeypatch.setattr(katz, "BATCH_BYTES", batch)
    monkeypatch.setattr(katz, "HOT", hot)
    rng = random.Random(6)
    more = [(50 + i, " ".join(rng.choice(["water", "rises", "at", "noon", f"g{rng.randrange(40)}"]) for _ in range(rng.randrange(30)))) for i in range(150)]
    df = alerts.select("alert_id", "message_body").unionByName(spark.createDataFrame(more, "alert_id long, message_body string"))
    rows = katz.katz_scores(df, F.col("alert_id") % 5 == 0, order=order).collect()
    data = [(i, words_of(m) + ["</s>"], i is not None and i % 5 == 0) for i, m in messages(df)]

    def grams(t, k):
        padded = ("<s>",) * (k - 1) + tuple(t)
        return [padded[j:j + k] for j in range(len(t))]

    counts = {k: Counter(g for _, t, held in data if not held for g in grams(t, k)) for k in range(1, order + 1)}
    seen = {k: Counter() for k in counts}  # how often a history of k - 1 words was followed
    for k, c in counts.items():
        for g, r in c.items():
            seen[k][g[:-1]] += r
    total, kinds = seen[1][()], {k: Counter(c.values()) for k, c in counts.items()}
    cut = {k: katz.discounts([kinds[k][r] for r in range(1, 7)]) for k in counts}
    rest = sum((1 - cut[1][r - 1]) * r * kinds[1][r] for r in range(1, 6))

    def share(g):  # of an n-gram that training text has
        k, r, c = len(g), counts[len(g)][g], seen[len(g)][g[:-1]]
        return cut[k][r - 1] * r / c if r <= 5 else r / (c + (k > 1))

    used, mass = Counter(), Counter()
    for k in range(2, order + 1):
        for g in counts[k]:
            used[g[:-1]] += share(g)
            mass[g[:-1]] += share(g[1:])

    def chance(g):
        if counts[len(g)][g]:
            return share(g)
        if len(g) == 1:
            return rest / total
        h = g[:-1]
        return chance(g[1:]) * ((1 - used[h]) / (1 - mass[h]) if seen[len(g)][h] else 1)

    for k in range(1, order + 1):  # every history sums to 1, words outside the training text included
        for h in list(seen[k])[:15]:
            assert sum(chance(h + w) for w in counts[1]) + chance(h + ("outside",)) == pytest.approx(1.0)
    want = Counter()
    for i, t, held in data:
        score = sum(math.log10(chance(g)) for g in grams(t, order))
        base = sum(math.log10((counts[1][w,] + 0.1) / (total + 0.1 * (len(counts[1]) + 1))) for w in t)
        want[i, held, len(t), sum(counts[1][w,] > 0 for w in t), total, round(base, 6), round(score, 6)] += 1
    got = Counter((r["alert_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in rows)
    assert got == want
    assert katz.katz_scores(empty, F.lit(False)).count() == 0


# --- words, queries and pipeline -----------------------------------------------------------------

def test_words_split_like_text():
    import pyarrow as pa

    texts = ["Ab cd\tab", None, "", " x\n", "AB", "ab" * 900 + " é"]
    seen = {}
    for begin, end, hashes, counts in hashed_words(pa.array(texts, pa.string()).slice(0)):
        at = 0
        for text, n in zip(texts[begin:end], counts):
            for word, value in zip(words_of(text or ""), hashes[at:at + n]):
                assert seen.setdefault(word, value) == value
            assert n == len(words_of(text or ""))
            at += n
    assert len(set(seen.values())) == len(seen)


def test_queries_and_pipeline(spark, sf):
    import corpus_pipeline

    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, sf)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    alone = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert alone.columns == docs.columns and alone.select("text").distinct().count() == alone.count()
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "piece", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
