"""Gradient boosting for two classes on binned features.

Trees grow best first: of all leaves the one whose split gains most is split next, until there are
`max_leaves` leaves or none gains. Sums by leaf, feature and bin are taken for the smaller child of a
split only; its sibling is the parent less that child. Gradients and second derivatives are rounded to
multiples of 2**-24, so sums are exact and the model does not depend on the order or partitions of rows.

Large tables are summed by Spark, a job for all splits that are likely next. Rows are kept as blocks of
bins, one feature after the other; each task adds up its blocks, and the few sums of the tasks are added
up on the driver, or by Spark where there are many. Where the bins of all rows are at most
`local_cells`, the rounds run in one task; the trees are the same.
"""

import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Estimator
from pyspark.sql import functions as F

from ebbtide.operators.forest import MOST_FEATURES, TooManyFeatures, TreesModel, as_matrix, dense, value_ranges
from ebbtide.operators.trees import LEAF, Nodes, between, joined
from ebbtide.session import drop_path, new_path

SCALE = 2.0**24
LOCAL_CELLS = 1 << 23
CELLS_AT_ONCE = 1 << 18
LEAST_SECOND = 1e-3
REFRESH = 5
NODES = "parts array<binary>"
BLOCKS = "y binary, codes binary"

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Rules:
    """How a tree grows. "second" gains by sums of gradients over sums of second derivatives plus `l2`;
    "friedman" by the difference of mean gradients."""
    rate: float = 0.05
    max_leaves: int = 15
    max_depth: int | None = None
    min_leaf: int = 10
    min_split: int = 2
    l2: float = 1.0
    criterion: str = "second"

    def value(self, g, h):
        return -self.rate * (g / SCALE) / max(h / SCALE + self.l2, 1e-12)

    def best(self, sums):
        """(gain, feature, bin) of the best split of a leaf with sums (rows, gradients, second
        derivatives) by feature and bin; gain 0 if none gains. Ties go to the first feature and bin."""
        left = sums.cumsum(axis=2)
        right = left[:, :, -1:] - left
        (n, g, h), (rn, rg, rh) = left / np.array([1, SCALE, SCALE])[:, None, None], right / np.array([1, SCALE, SCALE])[:, None, None]
        fits = (n >= self.min_leaf) & (rn >= self.min_leaf) & (sums[0] > 0)
        if self.criterion == "second":
            fits &= (h >= LEAST_SECOND) & (rh >= LEAST_SECOND)

            def part(a, b):
                return a * a / np.maximum(b + self.l2, 1e-12)
            gain = part(g, h) + part(rg, rh) - part(g + rg, h + rh)
        else:
            m, rm = np.maximum(n, 1), np.maximum(rn, 1)
            gain = n * rn / np.maximum(n + rn, 1) * (g / m - rg / rm) ** 2
        gain = np.where(fits, gain, 0.0)
        f, b = np.unravel_index(gain.argmax(), gain.shape)
        return max(float(gain[f, b]), 0.0), int(f), int(b)


@dataclass
class Leaf:
    node: int
    depth: int
    totals: tuple
    sums: np.ndarray | None = None
    split: tuple = (0.0, 0, 0)
    children: list = field(default_factory=list)


def derivatives(raw, y):
    p = 1 / (1 + np.exp(-raw))
    return np.rint((p - y) * SCALE).astype(np.int64), np.rint(p * (1 - p) * SCALE).astype(np.int64)


def binned(codes, g, h, bins):
    """Sums (3, features, bins) of codes (features x rows); exact in doubles, as a task holds less than
    2**29 rows."""
    out = np.empty((3, len(codes), bins), np.int64)
    for f, own in enumerate(codes):
        own = own.astype(np.intp)
        for k, weight in enumerate((None, g, h)):
            out[k, f] = np.bincount(own, weight, bins)
    return out


class Tree:
    """A tree under growth; thresholds are bins."""

    def __init__(self):
        self.feature, self.bin, self.left, self.right, self.value = [LEAF], [0], [LEAF], [LEAF], [0.0]

    def split(self, node, f, b):
        first = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.right[node] = f, b, first, first + 1
        for column, entry in ((self.feature, LEAF), (self.bin, 0), (self.left, LEAF), (self.right, LEAF), (self.value, 0.0)):
            column += [entry, entry]
        return first, first + 1

    def nodes(self):
        columns = (self.feature, self.bin, self.left, self.right, self.value, [0])
        return Nodes(*(np.array(c, k) for c, k in zip(columns, Nodes.KINDS)))


def grow_tree(rows, rules):
    """One tree. `rows` gives sums: rows.sums(tree, [(node, feature, bin, left side?)]) of the rows of
    a leaf on one side of a split, or of all rows for None."""
    tree = Tree()
    root = Leaf(0, 0, None, rows.sums(tree, None)[0])
    root.totals = tuple(root.sums[:, 0].sum(axis=1))
    root.split = rules.best(root.sums)
    leaves = [root]

    def deep(leaf):
        n = leaf.totals[0]
        return (rules.max_depth is not None and leaf.depth >= rules.max_depth) or n < max(2 * rules.min_leaf, rules.min_split)

    def opened(leaf):
        """The children of a leaf with what its sums tell of them."""
        _, f, b = leaf.split
        below = leaf.sums[:, f, :b + 1].sum(axis=1)
        return [Leaf(-1, leaf.depth + 1, tuple(below)), Leaf(-1, leaf.depth + 1, tuple(np.array(leaf.totals) - below))]

    def learn(wanted):
        """Sums of the children of several leaves."""
        asked = []
        for leaf in wanted:
            leaf.children = opened(leaf)
            left, right = leaf.children
            if not (deep(left) and deep(right)):
                asked.append((leaf, left.totals[0] <= right.totals[0]))
        found = rows.sums(tree, [(leaf.node, *leaf.split[1:], side) for leaf, side in asked]) if asked else []
        for (leaf, side), sums in zip(asked, found):
            small, large = leaf.children if side else leaf.children[::-1]
            small.sums, large.sums = sums, leaf.sums - sums
            for child in leaf.children:
                child.split = (0.0, 0, 0) if deep(child) else rules.best(child.sums)
    while len(leaves) < rules.max_leaves:
        pending = sorted((x for x in leaves if x.split[0] > 0 and not (x is root and deep(x))), key=lambda x: (-x.split[0], x.node))
        if not pending:
            break
        best = pending[0]
        if not best.children:
            if len(leaves) + 1 == rules.max_leaves:
                best.children = opened(best)  # the last split: nothing below it is needed
            else:
                learn([x for x in pending[:rules.max_leaves - len(leaves) if rows.ahead else 1] if not x.children])
        for child, node in zip(best.children, tree.split(best.node, *best.split[1:])):
            child.node = node
        rows.split(tree, best.node)
        at = leaves.index(best)
        leaves[at:at + 1] = best.children
    for leaf in leaves:
        tree.value[leaf.node] = rules.value(*leaf.totals[1:])
    return tree.nodes()


class LocalRows:
    """All rows in one task; codes are features x rows."""
    ahead = False

    def __init__(self, codes, y, start, bins):
        self.codes, self.y, self.bins = np.ascontiguousarray(codes), y, bins
        self.raw = np.full(len(y), start)

    def begin(self):
        self.g, self.h = (d.astype(np.float64) for d in derivatives(self.raw, self.y))
        self.members = {0: np.arange(len(self.y))}

    def sums(self, tree, asked):
        if asked is None:
            return [binned(self.codes, self.g, self.h, self.bins)]
        out = []
        for node, f, b, side in asked:
            own = self.members[node]
            own = own[(self.codes[f][own] <= b) == side]
            out.append(binned([c[own] for c in self.codes], self.g[own], self.h[own], self.bins))
        return out

    def split(self, tree, node):
        own = self.members.pop(node)
        below = self.codes[tree.feature[node]][own] <= tree.bin[node]
        self.members[tree.left[node]], self.members[tree.right[node]] = own[below], own[~below]

    def end(self, nodes):
        for node, own in self.members.items():
            self.raw[own] += nodes.value[node]


class SparkRows:
    """Rows in a table of blocks (y, codes, raw): a job for each request. Raw scores are written anew
    every `REFRESH` trees; the trees since then are applied where they are needed."""
    ahead = True

    def __init__(self, table, start, width, bins):
        self.spark, self.width, self.bins = table.sparkSession, width, bins
        self.recent, self.path, self.table = [], None, None

        def run(batches):
            for y, codes in blocks(batches, width):
                yield block(y, codes, np.full(len(y), float(start)))
        self._write(table.mapInArrow(run, f"{BLOCKS}, raw binary"))

    def _write(self, rows):
        path = new_path(self.spark, "boosting")
        rows.write.parquet(path)
        old, self.path = self.path, path
        self.table = self.spark.read.schema(rows.schema).parquet(path)
        if old:
            drop_path(self.spark, old)

    def begin(self):
        if len(self.recent) < REFRESH:
            return
        shared, width = self.spark.sparkContext.broadcast([t.packed() for t in self.recent]), self.width

        def run(batches):
            trees = [Nodes.unpacked(t) for t in shared.value]
            for y, codes, raw in blocks(batches, width):
                yield block(y, codes, raised(codes, raw, trees))
        self.recent = []
        self._write(self.table.mapInArrow(run, self.table.schema))

    def sums(self, tree, asked):
        shared = self.spark.sparkContext.broadcast(
            ([t.packed() for t in self.recent], tree.nodes().packed(), asked))
        width, bins = self.width, self.bins
        asks = len(asked or [0])

        def run(batches):
            recent, now, wanted = shared.value
            recent, now = [Nodes.unpacked(t) for t in recent], Nodes.unpacked(now)
            out = np.zeros((asks, 3, width, bins), np.int64)
            for y, codes, raw in blocks(batches, width):
                g, h = (d.astype(np.float64) for d in derivatives(raised(codes, raw, recent), y))
                node = now.at(0, codes.T)
                for k, ask in enumerate(wanted or [None]):
                    if ask is None:
                        out[k] += binned(codes, g, h, bins)
                        continue
                    own = np.flatnonzero((node == ask[0]) & ((codes[ask[1]] <= ask[2]) == ask[3]))
                    out[k] += binned([c[own] for c in codes], g[own], h[own], bins)
            full = np.flatnonzero(out.any(axis=1))
            per = [out[:, k].ravel()[full] for k in range(3)] if len(full) else [np.empty(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(full), *map(pa.array, per)], ["cell", "n", "g", "h"])
        parts = self.table.mapInArrow(run, "cell long, n long, g long, h long")
        if asks * width * bins > CELLS_AT_ONCE:
            parts = parts.groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ngh"])
        found = np.zeros((3, asks * width * bins), np.int64)
        for batch in parts.toArrow().to_batches():
            cell = batch.column(0).to_numpy()
            for k in range(3):
                np.add.at(found[k], cell, batch.column(k + 1).to_numpy())
        shared.unpersist()
        return list(found.reshape(3, asks, width, bins).swapaxes(0, 1))

    def split(self, tree, node):
        pass

    def end(self, nodes):
        self.recent.append(nodes)

    def drop(self):
        drop_path(self.spark, self.path)


def block(y, codes, *raw):
    """A record batch of one block: labels, codes (features x rows) and raw scores."""
    arrays = [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (y, codes, *raw)]
    return pa.RecordBatch.from_arrays(arrays, ["y", "codes", "raw"][:len(arrays)])


def blocks(batches, width):
    """What `block` has packed."""
    for batch in batches:
        for y, codes, *raw in zip(*(c.to_pylist() for c in batch.columns)):
            yield np.frombuffer(y), np.frombuffer(codes, np.uint8).reshape(width, -1), *map(np.frombuffer, raw)


def raised(codes, raw, trees):
    """Raw scores with the trees applied in order."""
    raw = raw.copy()
    for tree in trees:
        raw += tree.value[tree.at(0, codes.T)]
    return raw


def boosted(rows, rounds, rules):
    out = []
    for _ in range(rounds):
        rows.begin()
        tree = grow_tree(rows, rules)
        rows.end(tree)
        out.append(tree)
    return joined(out)


class Boosting(Estimator):
    """Boosting by `rounds` trees. Features are cut at up to `bins` - 1 borders."""

    def __init__(self, rounds=200, rules=Rules(), bins=255, local_cells=LOCAL_CELLS):
        super().__init__()
        self.rounds, self.rules, self.bins, self.local_cells = rounds, rules, bins, local_cells

    def _fit(self, dataset):
        rows = dense(dataset)
        n, ones, width = rows.agg(F.count("*"), F.sum("y"), F.max(F.size("x"))).first()
        if not n:
            raise ValueError("no rows to learn from")
        if width > MOST_FEATURES:
            raise TooManyFeatures(f"{width} features; boosting takes at most {MOST_FEATURES}")
        share = min(max(ones / n, 1e-12), 1 - 1e-12)
        start = float(np.log(share / (1 - share)))
        borders = value_ranges(rows, width, self.bins)
        last, bins = [v for _, v in borders], max(len(v) for _, v in borders)

        def code(batches):
            for batch in batches:
                x = as_matrix(batch.column(1))
                codes = np.stack([np.searchsorted(v, x[:, f]) for f, v in enumerate(last)]).astype(np.uint8)
                yield block(batch.column(0).to_numpy(), codes)
        spread = rows.select(F.col("y").cast("double"), "x")
        if n * width > self.local_cells:  # all cores share the rounds
            spread = spread.repartition(rows.sparkSession.sparkContext.defaultParallelism)
        coded = spread.mapInArrow(code, BLOCKS)
        if n * width <= self.local_cells:
            nodes = self._in_one_task(coded, start, width, bins)
        else:
            table = SparkRows(coded, start, width, bins)
            nodes = boosted(table, self.rounds, self.rules)
            table.drop()
        # A border lies between the last value of its bin and the first of the next.
        cuts = [np.append(between(v[:-1], first[1:]), v[-1]) for first, v in borders]
        inner = np.flatnonzero(nodes.feature != LEAF)
        threshold = nodes.threshold.copy()
        threshold[inner] = [cuts[f][int(b)] for f, b in zip(nodes.feature[inner], threshold[inner])]
        return TreesModel(Nodes(nodes.feature, threshold, nodes.left, nodes.right, nodes.value, nodes.roots), "logit", start)

    def _in_one_task(self, coded, start, width, bins):
        """The rounds over at most `local_cells` bytes."""
        rounds, rules = self.rounds, self.rules

        def run(table):
            y, codes = zip(*blocks([table], width))
            found = boosted(LocalRows(np.concatenate(codes, axis=1), np.concatenate(y), start, bins), rounds, rules)
            return pa.table({"parts": [found.packed()]}, schema=pa.schema([("parts", pa.list_(pa.binary()))]))
        return Nodes.unpacked(coded.groupBy().applyInArrow(run, NODES).first().parts)
