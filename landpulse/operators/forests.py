"""Random forests over many rows. A row is coded once, to the bins of its features and its label in one
number; every task gets all coded rows and grows whole trees, so no statistics of open nodes are sent."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN_BITS, COPY_BITS = 5, 4  # bins of a feature (32, as many as the library's); copies of a row in a bag
BINS, COPIES = 1 << BIN_BITS, 1 << COPY_BITS
SKETCH = 2048  # weighted values of a feature in a sketch
CHUNK = 1 << 15  # rows at a time, so that they stay in the processor's cache
SMALL = 1 << 12  # nodes of fewer rows are handled many at a time
TOGETHER = 512  # nodes at a time
FULL = 4  # counts over all features are kept where these are at most so many times those that a node tries
BLOCK_ROWS = 1 << 17  # coded rows that are sent as one
SKETCH_ROWS = 1 << 20  # rows of a sketch
HELD_ROWS = 1 << 24  # more coded rows than this lie in a file instead of the memory of a task

MIXED = 0x1E3779B97F4A7C15  # any odd number that spreads low bits, and its inverse
UNMIXED = pow(MIXED, -1, 1 << 64) - (1 << 64 if pow(MIXED, -1, 1 << 64) >> 63 else 0)
NODE_COLUMNS, NODE_TYPES = ["tree", "feature", "cut", "first", "stats"], [pa.int32(), pa.int32(), pa.int32(), pa.int64()]


class Layout:
    """Bits of a coded row: its copies in the bag, its label, then the bin of each feature. Where one
    number does not hold all features there are several, each with copies and label."""

    def __init__(self, n_features: int, n_labels: int):
        self.labels = 1 << max(1, (n_labels - 1).bit_length())
        self.low = COPY_BITS + self.labels.bit_length() - 1
        fit = (63 - self.low) // BIN_BITS
        self.word, self.shift = np.arange(n_features) // fit, BIN_BITS * (np.arange(n_features) % fit)
        self.words = int(self.word[-1]) + 1

    def coded(self, codes: Sequence[np.ndarray], label: np.ndarray) -> np.ndarray:
        out = np.repeat((label.astype(np.int64) << COPY_BITS)[None], self.words, axis=0)
        for code, word, shift in zip(codes, self.word, self.shift):
            out[word] |= code.astype(np.int64) << (self.low + shift)
        return out


def cut_points(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """At most 31 cut points between weighted values, by the library's rule: all midpoints if they are few,
    else those next to equal shares of the weight."""
    values, place = np.unique(values, return_inverse=True)
    weights = np.bincount(place, weights=weights)
    middle = (values[:-1] + values[1:]) / 2.0
    if len(middle) < BINS:
        return middle
    running, stride, cuts = np.cumsum(weights), weights.sum() / BINS, []
    target = stride
    for i in range(len(middle)):
        if abs(running[i] - target) < abs(running[i + 1] - target):
            cuts.append(middle[i])
            target += stride
    return np.array(cuts[:BINS - 1])


def _sketched(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values and their numbers; of more than ``SKETCH`` those at equal steps of the rows."""
    values, numbers = np.unique(values, return_counts=True)
    if len(values) <= SKETCH:
        return values, numbers
    running = np.cumsum(numbers)
    at = np.unique(np.searchsorted(running, np.arange(1, SKETCH + 1) * running[-1] // SKETCH))
    return values[at], np.diff(running[at], prepend=0)


def _space(words: int, rows: int) -> np.ndarray:
    """Room for coded rows, in a file that goes with it if they are many."""
    if rows <= HELD_ROWS:
        return np.empty((words, rows), np.int64)
    return np.asarray(np.memmap(tempfile.TemporaryFile(), np.int64, "w+", shape=(words, rows)))


def _order(rows: np.ndarray) -> None:
    """Brings coded rows into an order that depends on them alone and leaves no long runs of one bin, which
    are slow to count: that of their products with an odd number."""
    rows *= MIXED
    if len(rows) == 1:
        rows[0].sort()
    else:
        rows[:] = rows[:, np.lexsort(rows)]
    rows *= UNMIXED


def _copies() -> tuple[np.ndarray, np.ndarray]:
    """Poisson(1) by 16 bits: the number of copies, or COPIES where further bits have to decide; and the distribution."""
    mass = np.cumsum(np.exp(-1.0) / np.cumprod(np.maximum(np.arange(COPIES), 1)))
    step = np.arange(1 << 16) / 65536.0
    low, high = np.searchsorted(mass, step, side="right"), np.searchsorted(mass, step + 1 / 65536.0, side="left")
    return np.where(low == high, low, COPIES).astype(np.uint8), mass


def _drawn(rng: np.random.Generator, rows: int, table: np.ndarray, mass: np.ndarray) -> np.ndarray:
    first = rng.integers(0, 1 << 16, rows, np.uint16)
    out = table.take(first, mode="clip")
    open_ = np.flatnonzero(out == COPIES)
    out[open_] = np.minimum(np.searchsorted(mass, (first[open_] + rng.random(len(open_))) / 65536.0, side="right"), COPIES - 1)
    return out


def _counts(rows: np.ndarray, layout: Layout, features: np.ndarray) -> np.ndarray:
    """Bagged rows of one node by (feature, bin, label)."""
    size = BINS << layout.low
    out = np.zeros((len(features), size), np.int64)
    for begin in range(0, rows.shape[1], CHUNK):
        x = rows[:, begin:begin + CHUNK]
        low = x[0] & ((1 << layout.low) - 1)
        for of, f in zip(out, features):
            key = x[layout.word[f]] >> layout.shift[f]
            key &= (BINS - 1) << layout.low
            key |= low
            of += np.bincount(key, minlength=size)
    return (out.reshape(-1, COPIES) @ np.arange(COPIES)).reshape(len(features), BINS, layout.labels)


def _counts_of_many(x: np.ndarray, node: np.ndarray, nodes: int, layout: Layout, features: np.ndarray) -> np.ndarray:
    """Bagged rows of many nodes by (node, feature, bin, label)."""
    copies, label = (x[0] & (COPIES - 1)).astype(np.float64), (x[0] >> COPY_BITS) & (layout.labels - 1)
    out = np.empty((nodes, features.shape[1], BINS, layout.labels), np.int64)
    for j in range(features.shape[1]):
        code = _bins(x, features[node, j], layout)
        key = (node * BINS + code) * layout.labels + label
        out[:, j] = np.bincount(key, weights=copies, minlength=nodes * BINS * layout.labels).reshape(nodes, BINS, layout.labels)
    return out


def _bins(x: np.ndarray, feature: np.ndarray, layout: Layout) -> np.ndarray:
    word = x[0] if layout.words == 1 else x[layout.word[feature], np.arange(x.shape[1])]
    return (word >> (layout.low + layout.shift[feature])) & (BINS - 1)


def _gini(stats: np.ndarray) -> np.ndarray:
    total = stats.sum(axis=-1)
    return 1.0 - (stats * stats).sum(axis=-1) / np.where(total > 0, total * total, 1.0)


def _best(counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gain, place among the node's features, bin, counts on the left, counts in all) of each node's best split."""
    left = counts.cumsum(axis=2)
    total = left[:, :1, -1:]
    left = left[:, :, :-1]
    right = total - left
    l, r, t = left * weights, right * weights, total * weights
    share = lambda s: s.sum(axis=-1) / t.sum(axis=-1)
    gain = _gini(t) - share(l) * _gini(l) - share(r) * _gini(r)
    gain = np.where((left.sum(axis=-1) > 0) & (right.sum(axis=-1) > 0), gain, -1.0).reshape(len(counts), -1)
    at, node = gain.argmax(axis=1), np.arange(len(counts))
    place, cut = np.divmod(at, BINS - 1)
    return gain[node, at], place, cut, left[node, place, cut], total[:, 0, 0]


def grow(rows: np.ndarray, space: Sequence[np.ndarray], layout: Layout, weights: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """(feature, bin, first child, counts) of the nodes of one tree; the second child follows the first,
    a leaf has -1. ``space`` is room for two sets of the rows. Nodes split by the Gini index among as many
    features as the root of their number; sibling leaves of one class are joined, as the library does.

    The rows of a node lie together; they are dealt to its children level by level.
    """
    n_features, n = len(layout.word), rows.shape[1]
    tried = math.ceil(math.sqrt(n_features))
    draw = lambda nodes: rng.random((nodes, n_features)).argsort(axis=1)[:, :tried]
    weights = np.concatenate([weights, np.zeros(layout.labels - len(weights))])
    now, then = space
    table, mass = _copies()

    chosen = draw(1)
    counted = np.arange(n_features) if n_features <= FULL * tried else chosen[0]
    filled = 0
    for begin in range(0, n, CHUNK):
        x = rows[:, begin:begin + CHUNK]
        copies = _drawn(rng, x.shape[1], table, mass)
        kept = np.flatnonzero(copies)
        x = x.take(kept, axis=1, mode="clip") + copies.take(kept)
        now[:, filled:filled + len(kept)] = x
        filled += len(kept)
    if filled == 0:  # an empty bag says nothing
        return np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, -1), np.zeros((1, layout.labels), np.int64)

    counts = _counts(now[:, :filled], layout, counted)
    full = counts if n_features <= FULL * tried else None
    gain, place, at, left, total = _best((counts if full is None else counts[chosen[0]])[None], weights)
    opened = (np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, filled), chosen[[0], place], at, left, total)
    opened, fulls = tuple(c[gain > 0] for c in opened), [full]
    feature, cut, first, stats = np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, -1), [total]
    for level in range(depth):
        node, start, end, by, at, left, total = opened
        k, made = len(node), len(first)
        if k == 0:
            break
        child = np.stack([left, total - left], axis=1).reshape(2 * k, -1)
        feature[node], cut[node], first[node] = by, at, made + 2 * np.arange(k)
        feature, cut, first = (np.concatenate([c, np.full(2 * k, new)]) for c, new in ((feature, 0), (cut, 0), (first, -1)))
        stats.append(child)
        if level + 1 == depth:
            break
        going = _gini(child * weights) >= np.finfo(np.float64).eps  # the others are of one class
        opened, fulls = _opened(now, then, layout, weights, opened, fulls, draw(2 * k), going, made)
        now, then = then, now
    stats = np.concatenate(stats)
    best = (stats * weights).argmax(axis=1)
    for i in np.flatnonzero(first >= 0)[::-1]:
        a = first[i]
        if first[a] < 0 and first[a + 1] < 0 and best[a] == best[a + 1]:
            first[i] = -1
    return feature, cut, first, stats


def _opened(now, then, layout, weights, opened, fulls, chosen, going, made) -> tuple[tuple, list]:
    """Deals the rows of the split nodes from ``now`` to their children in ``then``. Gives those children
    that split again, as (node, start, end, feature, bin, counts on the left, counts), and their counts over all
    features. Where a node has these, only its smaller child is counted, the other one has the rest."""
    node, start, end, by, at, left, total = opened
    k, places, found, kept, held = len(node), np.zeros((2 * len(node), 2), np.int64), [], [], []

    def settle(least: int) -> None:
        if held and sum(len(c) for c, _, _ in held) >= least:
            which = np.concatenate([w for _, w, _ in held])
            gain, place, bin_, left, total = _best(np.concatenate([c for c, _, _ in held]), weights)
            good = gain > 0
            found.append((which[good], chosen[which[good], place[good]], bin_[good], left[good], total[good]))
            kept.extend(f for f, split in zip((f for _, _, of in held for f in of), good) if split)
            held.clear()

    i = 0
    while i < k:
        if end[i] - start[i] >= SMALL:
            children, of = np.arange(2 * i, 2 * i + 2), [None, None]
            places[children] = _dealt(now, then, layout, start[i], end[i], by[i], at[i], going[children])
            rows = [then[:, a:b] for a, b in places[children]]
            if fulls[i] is not None and going[children].any():
                smaller = int(2 * left[i].sum() > total[i].sum())
                of[smaller] = _counts(rows[smaller], layout, np.arange(len(layout.word)))
                of[1 - smaller] = fulls[i] - of[smaller]
            for side, child in enumerate(children):
                if going[child]:
                    counts = _counts(rows[side], layout, chosen[child]) if fulls[i] is None else of[side][chosen[child]]
                    held.append((counts[None], children[side:side + 1], [of[side] if rows[side].shape[1] >= SMALL else None]))
            i += 1
        else:
            last, rows = i, 0
            while last < k and last - i < TOGETHER and end[last] - start[last] < SMALL and rows < CHUNK:
                last, rows = last + 1, rows + end[last] - start[last]
            some = slice(2 * i, 2 * last)
            places[some], counts = _dealt_many(now, then, layout, start[i:last], end[i:last], by[i:last], at[i:last], chosen[some])
            on = np.flatnonzero(going[some])
            held.append((counts[on], 2 * i + on, [None] * len(on)))
            i = last
        settle(TOGETHER)
    settle(1)
    if not found:
        return (*[np.zeros(0, np.int64)] * 5, *[np.zeros((0, layout.labels), np.int64)] * 2), []
    which, by, at, left, total = (np.concatenate(c) for c in zip(*found))
    return (made + which, places[which, 0], places[which, 1], by, at, left, total), kept


def _dealt(now, then, layout, start, end, by, at, going) -> np.ndarray:
    """One node's rows, the left ones from the start of its place, the right ones from the end; none if no
    child is split again."""
    word, shift = layout.word[by], layout.low + layout.shift[by]
    field, most, low, high = (BINS - 1) << shift, at << shift, start, end
    for begin in range(start, end if going.any() else start, CHUNK):
        x = now[:, begin:min(begin + CHUNK, end)]
        left = (x[word] & field) <= most
        part = x.take(np.flatnonzero(left), axis=1, mode="clip")
        then[:, low:low + part.shape[1]] = part
        low += part.shape[1]
        part = x.take(np.flatnonzero(~left), axis=1, mode="clip")
        then[:, high - part.shape[1]:high] = part
        high -= part.shape[1]
    return np.array([[start, low], [high, end]])


def _dealt_many(now, then, layout, start, end, by, at, chosen) -> tuple[np.ndarray, np.ndarray]:
    """The same for many nodes of few rows."""
    size, k = end - start, len(start)
    slot = np.repeat(np.arange(k), size)
    place = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
    x = now[:, place]
    child = (2 * slot + (_bins(x, by[slot], layout) > at[slot])).astype(np.int16)
    order = np.argsort(child, kind="stable")
    x, child = x[:, order], child[order].astype(np.int64)
    then[:, place] = x
    left = np.bincount(child, minlength=2 * k)[::2]
    middle = start + left
    return np.stack([start, middle, middle, end], axis=1).reshape(2 * k, 2), _counts_of_many(x, child, 2 * k, layout, chosen)


def _columns(batch: pa.RecordBatch, n_features: int) -> tuple[list[np.ndarray], np.ndarray]:
    values = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_features)]
    if any(np.isnan(v).any() for v in values):
        raise ValueError("Every feature of a training row must be present.")
    return values, batch.column(n_features).to_numpy(zero_copy_only=False)


def _sketches(rows: DataFrame, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weighted values of each feature over all rows."""
    n_features = len(rows.columns) - 1

    def report(held: list) -> pa.RecordBatch:
        label, found = np.concatenate([x[-1] for x in held]), []
        for i in range(n_features):
            of = np.concatenate([x[0][i] for x in held])
            for k in np.unique(label):
                values, numbers = _sketched(of[label == k])
                found.append((i, values, numbers * weights[k]))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())))], ["feature", "value", "weight"])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(_columns(batch, n_features))
            n += batch.num_rows
            if n >= SKETCH_ROWS:
                yield report(held)
                held, n = [], 0
        if n:
            yield report(held)

    table = rows.mapInArrow(sketch, "feature int, value array<double>, weight array<double>").toArrow()
    out = []
    for i in range(n_features):
        part = table.filter(pa.compute.equal(table.column("feature"), i))
        out.append(tuple(pa.concat_arrays([c.flatten() for c in part.column(k).chunks]).to_numpy() for k in ("value", "weight")))
    return out


def train(df: DataFrame, features: Sequence[str], label: str, counts: dict[str, int], weights: dict[str, float], trees: int, depth: int, seed: int) -> list[tuple]:
    """(feature, threshold, first child, class shares, depth) of each tree of a forest over all rows with a
    label; ``counts`` and ``weights`` hold the rows of each label and the weight of one, in the labels' order.

    Features are cut into 32 bins, a bag draws each row Poisson(1) times and every node tries as many features
    as the root of their number, as in the library. The trees depend on the seed and the rows, not on the rows'
    order. A task holds the rows and twice the bag of a tree, 8 bytes a row each (of bags, two thirds are
    used), in files from ``HELD_ROWS`` rows on.
    """
    n_features, total, labels, parts = len(features), sum(counts.values()), list(counts), min(trees, df.sparkSession.sparkContext.defaultParallelism)
    layout, weight = Layout(n_features, len(labels)), np.array([weights[x] for x in labels])
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label).cast("string")) - 1
    rows = df.where(F.col(label).isNotNull()).select(*[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)], place.cast("int").alias("_label"))
    cuts = [cut_points(*sketch) for sketch in _sketches(rows, weight)]

    def block(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(held, axis=1).tobytes()], pa.binary())], ["rows"])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            values, of = _columns(batch, n_features)
            held.append(layout.coded([np.searchsorted(c, v) for c, v in zip(cuts, values)], of))
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)

    def grow_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, filled, held = None, 0, _space(layout.words, total)
        for batch in batches:
            for part, sent in zip(batch.column("part").to_pylist(), batch.column("rows")):
                x = np.frombuffer(sent.as_buffer(), np.int64).reshape(layout.words, -1)
                held[:, filled:filled + x.shape[1]] = x
                filled += x.shape[1]
        if part is None:
            return
        if filled != total:
            raise ValueError("The training rows changed between two passes over them.")
        _order(held)
        space = [_space(layout.words, total) for _ in range(2)]
        for tree in range(part, trees, parts):
            feature, cut, first, stats = grow(held, space, layout, weight, depth, np.random.Generator(np.random.SFC64([seed, tree])))
            yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), *(pa.array([x], pa.list_(t)) for x, t in zip((feature, cut, first, stats.ravel()), NODE_TYPES))], NODE_COLUMNS)

    sent = rows.mapInArrow(code, "rows binary").select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "rows")
    grown = sent.repartitionById(parts, "part").mapInArrow(grow_part, "tree int, feature array<int>, cut array<int>, first array<int>, stats array<bigint>").toArrow()
    values = lambda c: [x.values.to_numpy() for x in grown.column(c)]
    found = sorted(zip(grown.column("tree").to_pylist(), *(values(c) for c in NODE_COLUMNS[1:])), key=lambda x: x[0])
    return [_flat(cuts, weight, feature, cut, first, stats.reshape(len(first), -1)[:, :len(labels)]) for _, feature, cut, first, stats in found]


def _flat(cuts: Sequence[np.ndarray], weights: np.ndarray, feature: np.ndarray, cut: np.ndarray, first: np.ndarray, counts: np.ndarray) -> tuple:
    threshold, stats = np.full(len(first), np.inf), counts * weights
    for f, points in enumerate(cuts):
        own = (first >= 0) & (feature == f)
        threshold[own] = points[cut[own]]
    total = stats.sum(axis=1, keepdims=True)
    depth, level = 0, np.zeros(1, np.int64)
    while len(level := first[level][first[level] >= 0]):
        level, depth = np.concatenate([level, level + 1]), depth + 1
    return feature.astype(np.int64), threshold, first.astype(np.int64), np.divide(stats, total, out=np.zeros_like(stats), where=total != 0), depth
