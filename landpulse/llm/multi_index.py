"""Nearest tile signatures by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landpulse.llm import storage

BLOCK = 2048


def usable(signature: Column) -> Column:
    """Whether a signature takes part: not NULL, empty or zero, no NULL or non-finite component."""
    bad = F.exists(signature, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(signature.isNotNull() & (F.size(signature) > 0) & ~bad & F.exists(signature, lambda x: x != 0), F.lit(False))


def codebook(half: np.ndarray, centroids: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of one half by k-means (squared distance) over a bounded sample."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(half, axis=0)
    centre = distinct[rng.choice(len(distinct), min(centroids, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = nearest_centroid(half, centre)
        for c in range(len(centre)):
            mine = half[near == c]
            if len(mine):
                centre[c] = mine.mean(axis=0)
    return centre


def nearest_centroid(half: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argmin((centre ** 2).sum(axis=1) - 2.0 * half @ centre.T, axis=1)


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, goal: int) -> list[int]:
    """Cells (pairs of centroids) by ascending summed distance until they hold ``goal`` entries.

    ``first`` and ``second`` are a query's distances to both codebooks, ``counts`` the entries per
    pair. A heap holds the frontier: behind a pair wait its successors in either half. Cells without
    entries are passed over; if the goal is not met, every cell with entries is returned.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    da, db = first[a].tolist(), second[b].tolist()
    heap, reached, cells, held = [(da[0] + db[0], 0, 0)], [0] * len(da), [], 0
    table = counts[np.ix_(a, b)]
    while heap and held < goal:
        _, i, j = heapq.heappop(heap)
        if table[i, j]:
            cells.append(int(a[i]) * len(db) + int(b[j]))
            held += int(table[i, j])
        reached[i] = j + 1
        if j == 0 and i + 1 < len(da):
            heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
        if j + 1 < len(db):
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
    return cells


def visited_share(sample: np.ndarray, cut: int, left: np.ndarray, right: np.ndarray, k: float, recall: float, asks: int = 150) -> float:
    """Share of the entries to visit so that the ``k`` best of the sample are found with ``recall``,
    measured on up to ``asks`` of its rows against all others."""
    k = max(1, round(k))
    cell = nearest_centroid(sample[:, :cut], left) * len(right) + nearest_centroid(sample[:, cut:], right)
    counts = np.bincount(cell, minlength=len(left) * len(right))
    need = []
    for i in np.linspace(0, len(sample) - 1, min(asks, len(sample))).astype(int):
        scores = sample @ sample[i]
        scores[i] = -np.inf
        order = np.argsort((-sample[i, :cut] @ left.T)[:, None].repeat(len(right), 1).ravel() + np.tile(-sample[i, cut:] @ right.T, len(left)))
        before = np.empty(len(counts), np.int64)
        before[order] = np.cumsum(counts[order])
        need.append(before[cell[np.argsort(-scores)[:k]]] / len(sample))
    return float(np.quantile(np.concatenate(need), recall))


def sample_bounds(vectors: np.ndarray, sample: np.ndarray, n: int) -> np.ndarray:
    """The n-th best score of each vector in the sample (-inf in a smaller one): entries below it are
    not worth passing on, as the sample alone has n better ones."""
    bounds = np.full(len(vectors), -np.inf)
    for begin in range(0, len(vectors) if len(sample) >= n else 0, 256):
        bounds[begin:begin + 256] = np.partition(vectors[begin:begin + 256] @ sample.T, -n, axis=1)[:, -n]
    return bounds


def least_quota(sizes: list[int], wanted: int) -> int:
    """Smallest q such that groups of these sizes give ``wanted`` entries (or all) at q each."""
    wanted, q = min(wanted, sum(sizes)), 1
    while sum(min(n, q) for n in sizes) < wanted:
        q += 1
    return q


def bundles(counts: np.ndarray) -> np.ndarray:
    """Group of each cell: runs of neighbouring cells of about ``BLOCK`` entries together, so that
    small cells are scored in few groups; a larger cell is a group of its own."""
    out, number, held = np.zeros(len(counts), np.int32), 0, 0
    for cell, n in enumerate(counts.tolist()):
        if held and held + n > BLOCK:
            number, held = number + 1, 0
        out[cell] = number
        held += n
    return out


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def nearest_signatures(tiles: DataFrame, is_query: Column, k: int = 20, centroids: int = 128, recall: float = 0.96,
                       sample: int = 20_000, id_column: str = "tile_id", signature: str = "signature") -> DataFrame:
    """The ``k`` signatures of largest inner product for each query tile, itself excepted:
    (query_id, rank from 1, tile_id, score).

    Index: the signature's halves are quantised separately to ``centroids`` each, fitted on at most
    ``sample`` signatures (those with the smallest hash of their id); every signature is entered in
    its cell, a pair of centroids. Search: the distance of a half to a centroid is their negated
    inner product, so a pair's summed distance estimates the score; cells are visited in that order,
    by a heap, until they hold the share of all entries at which the sample's own neighbours are found
    with ``recall`` (little for clustered signatures, much for shapeless ones), and entries of these
    cells are reranked by the exact inner product in double precision. At least k + 1 entries are
    visited if there are so many, so a query gets min(k, others) rows.

    Equal signatures form one entry with its k + 1 smallest ids, which is all a ranking of k with
    ties to smaller ids can use, so a signature that many tiles share costs one entry. Cells are
    scored in blocks of at most about 2048 entries by 2048 queries, counted beforehand. Cell counts
    (at most centroids squared) and codebooks are what passes through the driver. Signatures that are
    NULL, zero or hold NULL or non-finite components take no part, nor do those whose length differs
    from the most common one of the sample; a repeated id ranks once per distinct signature. Other columns are ignored;
    an empty table stays empty.
    """
    spark = tiles.sparkSession
    rows = (tiles.select(F.col(id_column).cast("long").alias("tile_id"), F.col(signature).cast("array<double>").alias("vector"), is_query.alias("asks"))
            .where(usable(F.col("vector")) & F.col("tile_id").isNotNull()))
    within = Window.partitionBy("vector").orderBy("tile_id")
    few = rows.select("tile_id", "vector").withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= k + 1)
    entries = storage.stored(few.groupBy("vector").agg(F.array_sort(F.collect_list("tile_id")).alias("members"), F.min("tile_id").alias("entry")), "signatures")
    asking = storage.stored(rows.where("asks").select(F.col("tile_id").alias("query_id"), "vector")
                            .join(entries.select("vector", "entry"), "vector").select("query_id", "entry"), "queries")
    picked = [r["vector"] for r in entries.orderBy(F.xxhash64("entry")).limit(sample).select("vector").collect()]  # at most `sample`
    if not picked:
        return spark.createDataFrame([], "query_id long, rank int, tile_id long, score double")
    sizes = [len(v) for v in picked]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s))
    matrix = np.array([v for v in picked if len(v) == size])
    cut = (size + 1) // 2
    centroids = max(1, min(centroids, len(matrix) // 16))
    left = codebook(matrix[:, :cut], centroids)
    right = codebook(matrix[:, cut:], centroids) if size > 1 else np.zeros((1, 0))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vector"))
            if len(vectors):
                cell = nearest_centroid(vectors[:, :cut], left) * len(right) + nearest_centroid(vectors[:, cut:], right)
                yield batch.append_column("cell", pa.array(cell, pa.int32()))

    entered = entries.where(F.size("vector") == size).select("entry", "vector")
    indexed = storage.stored(entered.mapInArrow(enter, "entry long, vector array<double>, cell int"), "multi-index")
    counts = np.zeros((len(left), len(right)), np.int64)
    for r in indexed.groupBy("cell").count().collect():  # at most centroids squared
        counts.flat[r["cell"]] = r["count"]

    share = visited_share(matrix, cut, left, right, k * min(1.0, len(matrix) / max(1, counts.sum())), recall)
    goal = max(k + 1, int(np.ceil(share * counts.sum())))
    bundle_of = bundles(counts.ravel())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, owner, bundle, visited, quotas = _matrix(batch.column("vector")), [], [], [], []
            if not len(vectors):
                continue
            first, second = -vectors[:, :cut] @ left.T, -vectors[:, cut:] @ right.T
            for i in range(len(vectors)):
                cells = np.sort(traverse(first[i], second[i], counts, goal))
                ends = np.flatnonzero(np.diff(bundle_of[cells], append=-1)) + 1
                parts = np.split(cells, ends[:-1])
                quota = least_quota([int(counts.ravel()[p].sum()) for p in parts], k + 1)
                for part in parts:
                    owner.append(i)
                    quotas.append(quota)
                    bundle.append(bundle_of[part[0]])
                    visited.append(part)
            rows = pa.array(owner, pa.int64())
            bounds = sample_bounds(vectors, matrix, 2 * (k + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("entry").take(rows), batch.column("vector").take(rows), pa.array(bundle, pa.int32()), pa.array(visited, pa.list_(pa.int32())),
                 pa.array(bounds[owner]), pa.array(quotas, pa.int32())], ["entry", "vector", "bundle", "cells", "bound", "quota"])

    queries = indexed.join(asking.select("entry").distinct(), "entry", "left_semi").select("entry", "vector")
    probes = storage.stored(queries.mapInArrow(probe, "entry long, vector array<double>, bundle int, cells array<int>, bound double, quota int"), "probes")

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("bundle", pa.array(bundle_of[batch.column("cell").to_numpy()], pa.int32()))

    held = indexed.mapInArrow(bundled, "entry long, vector array<double>, cell int, bundle int")
    load = probes.groupBy("bundle").agg(F.count(F.lit(1)).alias("_q")).join(held.groupBy("bundle").agg(F.count(F.lit(1)).alias("_e")), "bundle")
    load = storage.stored(load.select("bundle", F.ceil(F.col("_q") / BLOCK).cast("int").alias("_qb"), F.ceil(F.col("_e") / (2 * BLOCK)).cast("int").alias("_eb")), "load")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("entry"), F.col(n)).cast("int")
    ask_side = probes.join(load, "bundle").select("bundle", part("_qb").alias("qb"), every("_eb").alias("eb"), "entry", "vector", "cells", "bound", "quota")
    entry_side = held.join(load, "bundle").select("bundle", every("_qb").alias("qb"), part("_eb").alias("eb"), "entry", "vector", "cell")

    def rank_block(asks: pa.Table, entries: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        who, what = [none], [none]
        if len(asks) and len(entries):
            q, e = _matrix(asks["vector"]), _matrix(entries["vector"])
            names, ids, cells = asks["entry"].to_numpy(), entries["entry"].to_numpy(), entries["cell"].to_numpy()
            wanted, bound, quota = asks["cells"].combine_chunks(), asks["bound"].to_numpy(), asks["quota"].to_numpy()
            asked = np.repeat(np.arange(len(q)), np.diff(wanted.offsets.to_numpy()))
            asked_cells = wanted.flatten().to_numpy()
            known, at = np.unique(cells, return_inverse=True)
            place = np.minimum(np.searchsorted(known, asked_cells), len(known) - 1)
            met = known[place] == asked_cells
            visited = np.zeros((len(q), len(known)), bool)
            visited[asked[met], place[met]] = True
            for begin in range(0, len(q), 512):
                some = slice(begin, begin + 512)
                found = np.where(visited[some][:, at], q[some] @ e.T, -np.inf)
                keep = min(k + 1, len(e))
                top = -np.sort(-np.partition(found, -keep, axis=1)[:, -keep:], axis=1)
                own = top[np.arange(len(top)), np.minimum(quota[some], keep) - 1]
                least = np.maximum(top[:, -1], np.minimum(bound[some], own))
                row, column = np.nonzero((found >= least[:, None]) & np.isfinite(found))  # ties with the last stay in
                who.append(row + begin)
                what.append(column)
            who, what = np.concatenate(who), np.concatenate(what)
            return pa.table({"query": names[who], "entry": ids[what], "score": np.einsum("ij,ij->i", q[who], e[what])})
        return pa.table({"query": none, "entry": none, "score": np.zeros(0)})

    block = ["bundle", "qb", "eb"]
    scored = ask_side.groupBy(*block).cogroup(entry_side.groupBy(*block)).applyInArrow(rank_block, "query long, entry long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    top = scored.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
    named = top.join(entries.select("entry", "members"), "entry").select("query", "score", F.explode("members").alias("tile_id"))
    by_class = Window.partitionBy("query").orderBy(F.desc("score"), "tile_id")
    named = named.withColumn("_n", F.row_number().over(by_class)).where(F.col("_n") <= k + 1).drop("_n")
    answers = asking.join(named, asking["entry"] == named["query"]).where("query_id <> tile_id").select("query_id", "tile_id", "score")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "tile_id")
    return answers.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "tile_id", "score")
