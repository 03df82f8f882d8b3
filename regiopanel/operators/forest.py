"""Regression forests of all groups at once, level by level.

The trees of every group grow together. A level is one distributed aggregate over all groups: the rows, dealt to *blocks* of at most
``BLOCK`` rows of a group, meet their group's splits so far, each block finds the node of its rows in each tree and sums
weights and labels per (tree, node, feature, bin); the sums of all blocks are added, a running sum over the bins gives every possible split of
every node, and the best one of each node is the next level. So the number of jobs follows the depth, not the groups, and a group that holds a
third of all rows is spread over many blocks. A group that one block holds has all its sums in one place: its task goes through the levels by
itself, with the same arithmetic.

Everything is determined by the data and the seed, whatever the partitioning: bins are quantiles of the group's training rows; a
row's bootstrap weight in a tree (Poisson with mean 1) and a node's choice of features are hashes; labels are
fixed-point numbers of ``BITS`` bits between the group's least and largest label, whose sums are exact in any order.

As in Spark's forests, a node looks at a third of the features (all of them in a forest of one tree, which has no bootstrap either), a
split needs a gain above zero and a row on both sides, and the forest's prediction is the mean over its trees (those that
drew a row, should a group be so small that some drew none; the mean label, if all did). A value goes left if it
is at most the threshold, which is one of the group's own values. Quantiles are exact up to ``ACCURACY`` rows of a group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regiopanel.session import materialize
from regiopanel.shipping import ship

#: Rows of a block, bins of a feature, bits of a label, trees that a task works on at a time, and the accuracy of quantiles.
BLOCK, BINS, BITS, TREES, ACCURACY = 4096, 32, 30, 50, 10_000

#: A gain counts from this share of the node's own sum on: below it, it is rounding.
LEAST_GAIN = 1e-12

_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def spread(h: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def bootstrap(rows: np.ndarray, trees: np.ndarray, seed: int, alone: bool = False) -> np.ndarray:
    """The weight of each row (by its hash) in each tree."""
    if alone:
        return np.ones((len(rows), len(trees)), np.int64)
    h = spread(rows.view(np.uint64)[:, None] + spread((trees.astype(np.uint64) << np.uint64(20)) + np.uint64(seed + 1))[None, :])
    return np.searchsorted(_POISSON, (h >> np.uint64(11)) * 2.0 ** -53, "right")


def chosen(trees: np.ndarray, nodes: np.ndarray, n_features: int, n_chosen: int, seed: int) -> np.ndarray:
    """Which features each (tree, node) looks at: a row of ``n_chosen`` numbers for each."""
    base = spread(trees.astype(np.uint64) * np.uint64(1 << 32) + nodes.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    h = spread(base[:, None] + np.arange(1, n_features + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03))
    return np.argsort(h, axis=1, kind="stable")[:, :n_chosen]


def walk(bins: np.ndarray, splits: tuple, trees: np.ndarray, depth: int, stay: bool = False) -> np.ndarray:
    """The node of each row (``bins``: rows x features) in each tree after ``depth`` levels; -1 beneath a leaf, or the leaf with ``stay``.

    ``splits`` are the arrays tree, node, feature and bin; the root is node 1 and node k has the children 2k and 2k + 1.
    """
    at = np.ones((len(bins), len(trees)), np.int64)
    if not depth:
        return at
    tree, node, feature, cut = splits
    size = 1 << depth
    table_feature = np.full((len(trees), size), -1, np.int64)
    table_cut = np.zeros((len(trees), size), np.int64)
    place = np.searchsorted(trees, tree)
    own = (place < len(trees)) & (node < size)
    own[own] = trees[place[own]] == tree[own]
    table_feature[place[own], node[own]] = feature[own]
    table_cut[place[own], node[own]] = cut[own]
    row, col = np.arange(len(bins))[:, None], np.arange(len(trees))[None, :]
    for _ in range(depth):
        f = np.where(at > 0, table_feature[col, np.maximum(at, 0)], -1)
        right = bins[row, np.maximum(f, 0)] > table_cut[col, np.maximum(at, 0)]
        at = np.where(f >= 0, 2 * at + right, at if stay else -1)
    return at


def _lists(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name))[i].values.to_numpy(zero_copy_only=False)


def _splits(batch: pa.RecordBatch, i: int) -> tuple:
    whole = batch.column(batch.schema.get_field_index("splits"))[i].values
    if whole is None or not len(whole):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.asarray(whole.field(k)).astype(np.int64) for k in range(4))


class _Block:
    """The rows of a block, with their weights in the trees from ``first`` on."""

    def __init__(self, batch: pa.RecordBatch, i: int, features: int, trees: int, seed: int):
        self.group = batch.column(batch.schema.get_field_index("group"))[i]
        first = batch.column(batch.schema.get_field_index("first"))[i].as_py()
        self.label = _lists(batch, "labels", i)
        self.bins = _lists(batch, "bins", i).reshape(len(self.label), features)
        self.trees = np.arange(first, min(first + TREES, trees))
        self.weight = bootstrap(_lists(batch, "rows", i).astype(np.int64), self.trees, seed, trees == 1)
        self.features, self.seed = features, seed
        self.n_chosen = features if trees == 1 else math.ceil(features / 3)

    def cells(self, splits: tuple, depth: int, last: bool) -> list[np.ndarray]:
        """Arrays tree, node, feature, bin, w and s of the nodes at this depth, in this order (at the last one feature and bin 0 only)."""
        at = walk(self.bins, splits, self.trees, depth)
        row, col = np.nonzero((at > 0) & (self.weight > 0))
        node, w = at[row, col], self.weight[row, col]
        size = 1 << (depth + 1)
        if last:
            look = np.zeros((len(node), 1), np.int64)
        else:
            pairs, which = np.unique(col * size + node, return_inverse=True)
            look = chosen(self.trees[pairs // size], pairs % size, self.features, self.n_chosen, self.seed)[which]
        feature = look.ravel()
        row, col, node, w = (np.repeat(x, look.shape[1]) for x in (row, col, node, w))
        cut = np.zeros(len(row), np.int64) if last else self.bins[row, feature].astype(np.int64)
        key = ((col * size + node) * self.features + feature) * (BINS + 1) + cut
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        w = w[order]
        sum_w, sum_s = (np.add.reduceat(x, heads) if len(heads) else x for x in (w, w * self.label[row[order]]))
        rest, cut = key[heads] // (BINS + 1), key[heads] % (BINS + 1)
        rest, feature = rest // self.features, rest % self.features
        return [self.trees[rest // size], rest % size, feature, cut, sum_w, sum_s]


def _histograms(blocks: DataFrame, depth: int, last: bool, features: int, trees: int, seed: int) -> DataFrame:
    """``group, tree, node, feature, bin, w, s`` of each block's rows at this depth."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch, i, features, trees, seed)
                *places, w, s = block.cells(_splits(batch, i), depth, last)
                yield pa.RecordBatch.from_arrays([pa.repeat(block.group, len(w)), *(pa.array(x, pa.int32()) for x in places), pa.array(w), pa.array(s)],
                                                 ["group", "tree", "node", "feature", "bin", "w", "s"])

    return blocks.mapInArrow(run, "group string, tree int, node int, feature int, bin int, w long, s long")


def best_splits(tree, node, feature, cut, w, s) -> list[np.ndarray]:
    """What :func:`_best` does, for cells in order of tree, node, feature and bin: arrays tree, node, feature (-1: a leaf), bin, w and s."""
    if not len(w):
        return [np.zeros(0, np.int64)] * 6
    new_node = np.concatenate([[True], (tree[1:] != tree[:-1]) | (node[1:] != node[:-1])])
    new_side = new_node | np.concatenate([[True], feature[1:] != feature[:-1]])
    side = np.flatnonzero(new_side)
    counts = np.diff(np.append(side, len(w)))
    upto, total = [], []
    for x in (w, s):
        running = np.cumsum(x)
        upto.append(running - np.repeat(running[side] - x[side], counts))
        total.append(np.repeat(np.add.reduceat(x, side), counts))
    (wl, sl), (wn, sn) = upto, total
    wr, sr = wn - wl, sn - sl
    square = lambda a, b: a.astype(float) * a.astype(float) / np.maximum(b, 1)
    whole = square(sn, wn)
    gain = square(sl, wl) + square(sr, wr) - whole
    gain = np.where((wl > 0) & (wr > 0) & (gain > whole * LEAST_GAIN), gain, -1.0)
    heads = np.flatnonzero(new_node)
    most = np.maximum.reduceat(gain, heads)
    at_most = np.flatnonzero(gain == np.repeat(most, np.diff(np.append(heads, len(w)))))
    first = at_most[np.searchsorted(at_most, heads)]  # of equal gains the smallest feature and bin
    leaf = most <= 0
    return [tree[heads], node[heads], np.where(leaf, -1, feature[first]), np.where(leaf, -1, cut[first]), wn[heads], sn[heads]]


def _grown_alone(blocks: DataFrame, features: int, trees: int, depth: int, seed: int) -> DataFrame:
    """All nodes of the groups that one block holds: its task has all their sums, so it goes through the levels by itself."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch, i, features, trees, seed)
                splits, found = tuple(np.zeros(0, np.int64) for _ in range(4)), []
                for d in range(depth + 1):
                    cells = block.cells(splits, d, d == depth)
                    if d == depth:
                        nodes = [*cells[:2], np.full(len(cells[0]), -1), np.full(len(cells[0]), -1), *cells[4:]]
                    else:
                        nodes = best_splits(*cells)
                        inner = nodes[2] >= 0
                        splits = tuple(np.concatenate([a, b[inner]]) for a, b in zip(splits, nodes))
                    found.append(nodes)
                    if not len(nodes[0]):
                        break
                tree, node, feature, cut, w, s = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([
                    pa.repeat(block.group, len(w)), pa.array(tree, pa.int32()), pa.array(node, pa.int32()), pa.array(feature, pa.int32(), mask=feature < 0),
                    pa.array(cut, pa.int32(), mask=feature < 0), pa.array(w), pa.array(s)], ["group", "tree", "node", "feature", "bin", "w", "s"])

    return blocks.mapInArrow(run, "group string, tree int, node int, feature int, bin int, w long, s long")


def _best(cells: DataFrame) -> DataFrame:
    """``group, tree, node, feature, bin, w, s``: each node with its sums and its best split (feature null: a leaf)."""
    side = Window.partitionBy("group", "tree", "node", "feature")
    upto = side.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.select("*", F.sum("w").over(upto).alias("wl"), F.sum("s").over(upto).alias("sl"),
                         F.sum("w").over(side).alias("wn"), F.sum("s").over(side).alias("sn"))
    square = lambda s, w: F.col(s).cast("double") * F.col(s).cast("double") / F.col(w)
    cells = cells.withColumn("wr", F.col("wn") - F.col("wl")).withColumn("sr", F.col("sn") - F.col("sl"))
    gain = F.when((F.col("wl") > 0) & (F.col("wr") > 0), square("sl", "wl") + square("sr", "wr") - square("sn", "wn"))
    cells = cells.withColumn("gain", F.when(gain > square("sn", "wn") * LEAST_GAIN, gain))
    best = F.max(F.when(F.col("gain").isNotNull(), F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))))
    nodes = cells.groupBy("group", "tree", "node").agg(best.alias("best"), F.max("wn").alias("w"), F.max("sn").alias("s"))
    return nodes.select("group", "tree", "node", (-F.col("best.f")).alias("feature"), (-F.col("best.b")).alias("bin"), "w", "s")


def grow(train: DataFrame, features: int, trees: int, depth: int, seed: int) -> list[DataFrame]:
    """The nodes of all trees (``group, tree, node, feature, bin, w, s``), in one or more tables, of the blocks
    ``group, n_blocks, labels, bins, rows``."""
    spark = train.sparkSession
    ship(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts = F.array(*[F.lit(i) for i in range(0, trees, TREES)])
    alone = train.where("n_blocks = 1").withColumn("first", F.explode(firsts)).repartition(tasks)
    done_alone = materialize(_grown_alone(alone, features, trees, depth, seed), "forest-small")
    train = train.where("n_blocks > 1")
    if train.isEmpty():
        return [done_alone]
    levels: list[DataFrame] = []
    for d in range(depth + 1):
        blocks = train
        if levels:
            done = levels[0]
            for nodes in levels[1:]:
                done = done.unionByName(nodes)
            splits = done.where("feature is not null").groupBy("group").agg(F.collect_list(F.struct("tree", "node", "feature", "bin")).alias("splits"))
            blocks = blocks.join(splits, "group")
        else:
            blocks = blocks.withColumn("splits", F.lit(None).cast("array<struct<tree:int,node:int,feature:int,bin:int>>"))
        blocks = blocks.withColumn("first", F.explode(firsts)).repartition(tasks)
        cells = _histograms(blocks, d, d == depth, features, trees, seed)
        # One exchange by node serves the sums, the running sums and the choice; blocks have combined their rows already.
        cells = cells.repartition("group", "tree", "node").groupBy("group", "tree", "node", "feature", "bin").agg(
            F.sum("w").alias("w"), F.sum("s").alias("s"))
        if d == depth:
            none = F.lit(None).cast("int")
            levels.append(materialize(cells.select("group", "tree", "node", none.alias("feature"), none.alias("bin"), "w", "s"), f"forest-level-{d}"))
        else:
            levels.append(materialize(_best(cells), f"forest-level-{d}"))
    return [done_alone, *levels]


def blocks_of(rows: DataFrame, sizes: DataFrame, extra=()) -> DataFrame:
    """Rows (``group, label, bins, row`` and ``extra`` columns) as blocks of at most about ``BLOCK`` of them, a row each."""
    dealt = rows.join(sizes.select("group", F.greatest(F.lit(1), F.ceil(2 * F.col("n") / BLOCK)).alias("blocks")), "group")
    # Which block a row is in changes no result; equal rows, however many, are dealt too.
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("row", F.monotonically_increasing_id()), F.col("blocks")))
    one = F.sort_array(F.collect_list(F.struct("row", "label", "bins", *extra))).alias("all")
    packed = dealt.groupBy("group", "block").agg(one, F.first("blocks").alias("n_blocks"))
    return packed.select("group", "n_blocks", F.col("all.row").alias("rows"), F.col("all.label").alias("labels"), F.flatten("all.bins").alias("bins"),
                         *[F.col(f"all.{c}").alias(c) for c in extra])


def fit_predict(rows: DataFrame, label: str, features, trees: int, depth: int, seed: int, keep=()) -> tuple[DataFrame, list[DataFrame]]:
    """Forests of all groups, and their predictions.

    ``rows`` has ``group`` (text), ``is_train``, the label and the features, none of them null or NaN. Returns the rows that aren't for
    training (``group, label, predicted`` and the columns of ``keep``) of the groups that have rows for training, and the levels of the forests.
    """
    features = list(features)
    x = [F.col(f"`{f}`").cast("double") for f in features]
    probs = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    train = F.col("is_train")
    bounds = materialize(rows.where(train).groupBy("group").agg(
        F.count("*").alias("n"), F.min(F.col(label).cast("double")).alias("lo"), F.max(F.col(label).cast("double")).alias("hi"),
        F.avg(F.col(label).cast("double")).alias("mean"),
        F.array(*[F.array_distinct(F.percentile_approx(c, probs, ACCURACY)) for c in x]).alias("cuts")), "forest-bounds")
    scale = F.lit(float(1 << BITS))
    fixed = F.round((F.col(label).cast("double") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * scale).cast("long")
    below = lambda cuts, c: F.size(F.filter(cuts, lambda t: t < c))
    bins = F.array(*[below(F.col("cuts")[i], c) for i, c in enumerate(x)])
    ready = rows.join(bounds, "group").select("group", "is_train", fixed.alias("label"), bins.alias("bins"), F.col(label).cast("double").alias("actual"),
                                             F.xxhash64(F.lit(seed), label, *features, *keep).alias("row"), *keep, "lo", "hi")
    ready = materialize(ready, "forest-rows")
    packed = materialize(blocks_of(ready.where(train), bounds), "forest-blocks")
    levels = grow(packed, len(features), trees, depth, seed)

    held = ready.where(~train)
    sizes = held.groupBy("group").agg(F.count("*").alias("n"))
    test = blocks_of(held, sizes, extra=("actual", *keep)).join(bounds.select("group", "lo", "hi", "mean"), "group")
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    mean = F.when(F.col("feature").isNull(), F.col("s") / F.col("w"))
    nodes = nodes.groupBy("group").agg(F.collect_list(F.struct("tree", "node", F.coalesce("feature", F.lit(-1)).alias("feature"),
                                                               F.coalesce("bin", F.lit(-1)).alias("bin"), mean.alias("mean"))).alias("splits"))
    scored = _scored(test.join(nodes, "group", "left"), len(features), trees, depth, [(c, dict(rows.dtypes)[c]) for c in keep])
    return scored, levels


def _scored(blocks: DataFrame, features: int, trees: int, depth: int, keep) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, i=i, batch=batch: batch.column(batch.schema.get_field_index(name))[i]
                n = len(get("rows").values)
                bins = get("bins").values.to_numpy(zero_copy_only=False).reshape(n, features)
                tree, node, feature, cut = _splits(batch, i)
                value = np.asarray(get("splits").values.field(4).fill_null(0.0)) if len(tree) else np.zeros(0)
                leaf = feature < 0
                total, drawn = np.zeros(n), 0
                for first in range(0, trees, TREES):
                    some = np.arange(first, min(first + TREES, trees))
                    place = np.full((len(some), 2 << depth), np.nan)
                    own = leaf & (tree >= first) & (tree < first + len(some))
                    place[tree[own] - first, node[own]] = value[own]
                    at = walk(bins, (tree[~leaf], node[~leaf], feature[~leaf], cut[~leaf]), some, depth, stay=True)
                    value_of = place[np.arange(len(some))[None, :], at]
                    total += np.nansum(value_of, axis=1)
                    drawn += int((~np.isnan(value_of[:1])).sum())
                lo, hi = get("lo").as_py(), get("hi").as_py()
                predicted = lo + total / drawn / float(1 << BITS) * (hi - lo) if drawn else np.full(n, get("mean").as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(get("group"), n), get("actual").values, pa.array(predicted), *(get(c).values for c, _ in keep)],
                    ["group", "actual", "predicted", *(c for c, _ in keep)])

    kinds = "".join(f", `{c}` {k}" for c, k in keep)
    return blocks.mapInArrow(run, f"group string, actual double, predicted double{kinds}")
