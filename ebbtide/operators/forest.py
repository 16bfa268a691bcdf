"""Forests grown in two phases.

The upper levels are grown by passes over all rows: each task counts classes by node, feature and
range of values (or side of a random threshold), Spark adds the counts up, and one aggregate serves the
nodes of all trees. Once a node holds fewer rows than a bound, its rows go to one task, which grows the
rest of that tree exactly and without a limit of depth. The bound is a number of cells (rows times
features), so it holds whatever the table; a smaller table starts with the second phase.

Both phases find the same splits. Where a feature has more than `ranges` different values, the upper levels
count the rows between borders that cut them into about equal parts. What the best threshold between two
borders can be worth is bounded by the counts on both sides (the purity of a split is convex in its counts);
the rows of the parts that may hold a better threshold than the best border are dealt to tasks in groups
of bounded size, which try every value. Features are counted as they are drawn.

A fitted forest of at most `MOST_NODES` nodes is held whole by the tasks that score. A larger one stays a
table of its lower trees: the rows to be scored are dealt to these trees as the training rows were, and
what the trees say of a row is added up. Rows are dense here: a vector longer than `MOST_FEATURES` is refused.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ebbtide.operators import trees as growing
from ebbtide.operators.features import LABEL, ROW_ID, SEED
from ebbtide.operators.rank import average_ranks
from ebbtide.operators.trees import LEAF, Growth, Nodes, bag_counts, between, child_keys, firsts, grown_columns, tree_keys
from ebbtide.session import materialize

CELLS = 1 << 21
COUNTERS = 1 << 20
VALUES_AT_ONCE = 50_000
#: Rows of a group of ranges whose values are tried in one task; rows that a task holds before it deals them.
GROUP_ROWS, DEALT_AT_ONCE = 250_000, 1 << 20
MORE = 2
MOST_NODES, MOST_FEATURES = 8_000_000, 16_384
OPEN, SMALL, DONE = 0, 1, 2
#: Leaf values are added up as multiples of 2**-48 where the order of trees is open: sums are exact.
UNIT = 2.0**48

# Workers get these functions with the task, so the package needs no installation on executors.
for module in (growing, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(module)


class TooManyFeatures(ValueError):
    """The feature vector is too long to be held as a dense row."""


def dense(matrix):
    """(id, y, x): x as an array. Rows without an id are told apart by what they hold."""
    x = vector_to_array("features")
    row_id = F.col(ROW_ID) if ROW_ID in matrix.columns else F.xxhash64(x, F.col(LABEL))
    return matrix.select(row_id.cast("long").alias("id"), F.col(LABEL).cast("int").alias("y"), x.alias("x"))


def as_matrix(lists):
    """Rows of an Arrow list column whose lists are equally long."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _counted(batches):
    """How often each feature has each value, by batch."""
    for batch in batches:
        for f, own in enumerate(as_matrix(batch.column(2)).T):
            values, n = np.unique(own, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), f, np.int32)), pa.array(values), pa.array(n)],
                                             ["feature", "value", "n"])


def value_ranges(rows, width, ranges):
    """For each feature (first, last) of consecutive ranges: every value of its own where there are
    at most `ranges`, else ranges that hold about equally many rows; `first` is then the border below."""
    counts = materialize(rows.mapInArrow(_counted, "feature int, value double, n long")
                         .groupBy("feature", "value").agg(F.sum("n").alias("n")), "values")
    finite = F.abs("value") < float("inf")
    sizes = {r.feature: r for r in counts.groupBy("feature").agg(
        F.count("*").alias("values"), F.count_if(finite).alias("finite"), F.sum("n").alias("n")).collect()}
    many = [f for f in range(width) if f not in sizes or sizes[f]["values"] > ranges]
    found = {f: [] for f in range(width)}
    for r in counts.where(~F.col("feature").isin(many)).collect():  # at most `ranges` values of each
        found[r.feature].append(r.value)
    if many:
        n = max((s["n"] for s in sizes.values()), default=0)  # each row has one value of each feature
        wanted = F.lit(sorted({max(1, round(n * j / ranges)) for j in range(1, ranges + 1)}))
        past = average_ranks(counts.where(F.col("feature").isin(many) & finite), VALUES_AT_ONCE,
                             sum(sizes[f]["finite"] for f in many if f in sizes))
        hit = F.exists(wanted, lambda k: (F.col("below") < k) & (k <= F.col("below") + F.col("n")))
        for r in past.where(hit).select("feature", "value").collect():
            found[r.feature].append(r.value)
    last = [np.unique(np.array(found[f], float)) for f in range(width)]
    return [(np.concatenate([v[:1], v[:-1]]) if f in many else v, v) for f, v in enumerate(last)]


class Upper:
    """The upper levels of all trees, on the driver; one entry for each node. flat: features known to hold one value."""

    def __init__(self, keys):
        n = len(keys)
        self.tree, self.key, self.depth, self.state = list(range(n)), list(keys), [0] * n, [OPEN] * n
        self.feature, self.threshold, self.left, self.right, self.value = [LEAF] * n, [0.0] * n, [LEAF] * n, [LEAF] * n, [0.0] * n
        self.trees, self.flat = n, [frozenset()] * n

    def split(self, node, feature, threshold):
        first = len(self.tree)
        self.feature[node], self.threshold[node], self.left[node], self.right[node] = feature, threshold, first, first + 1
        self.state[node] = DONE
        for right in (False, True):
            for column, entry in ((self.tree, self.tree[node]), (self.depth, self.depth[node] + 1), (self.state, OPEN),
                                  (self.key, child_keys(np.array([self.key[node]]), right)[0]), (self.feature, LEAF),
                                  (self.threshold, 0.0), (self.left, LEAF), (self.right, LEAF), (self.value, 0.0), (self.flat, self.flat[node])):
                column.append(entry)
        return first, first + 1

    def close(self, node, value):
        self.state[node], self.value[node] = DONE, value

    def nodes(self):
        columns = (self.feature, self.threshold, self.left, self.right, self.value, range(self.trees))
        return Nodes(*(np.array(c, k) for c, k in zip(columns, Nodes.KINDS)))

    def slots(self, nodes):
        """Number of each of the given nodes (others -1), and the trees that hold them."""
        slot = np.full(len(self.tree), -1)
        slot[nodes] = np.arange(len(nodes))
        return slot, sorted({self.tree[k] for k in nodes})


def members(state, batch):
    """For each tree: the rows of its bag that lie in wanted nodes. Yields (tree, slot of each, rows of x,
    labels, times in the bag)."""
    nodes, ids, y = Nodes.unpacked(state["nodes"]), batch.column(0).to_numpy(), batch.column(1).to_numpy()
    x = as_matrix(batch.column(2))
    for tree in state["trees"]:
        times = bag_counts(state["keys"][tree], ids) if state["bootstrap"] else np.ones(len(ids), np.int64)
        own = np.flatnonzero(times > 0)
        slot = state["slot"][nodes.at(tree, x, own)]
        rows = own[slot >= 0]
        if len(rows):
            yield tree, slot[slot >= 0], x, rows, y[rows], times[rows]


def asked_of(state, columns, at, slot):
    """For each place among the features asked of a node: (place, which of the rows `at` it is asked of or None for
    all, their slots, features and values, and their cells, numbered by slot, place and code). columns: values and,
    if ranges are asked for, codes of a batch, features by rows."""
    values, codes = columns
    for j in range(state["ask"].shape[1]):
        f, rows, own, some = state["ask"][slot, j], at, slot, None
        if f.min() < 0:
            some = np.flatnonzero(f >= 0)
            f, rows, own = f[some], at[some], slot[some]
        if len(f):
            where = f * values.shape[1] + rows
            value = values.ravel()[where]
            code = codes.ravel()[where] if codes is not None else value > state["cuts"][own, j] if "cuts" in state else 0
            yield j, some, own, f, value, (own * state["ask"].shape[1] + j) * state["codes"] + code


def columns_of(state, x):
    """The values of a batch and, where ranges are asked for, the range of each, features by rows."""
    values = np.ascontiguousarray(x.T)
    return values, np.stack([np.searchsorted(last, v) for last, v in zip(state["last"], values)]) if "last" in state else None


def cell_facts(rows, shared, slots, asked, codes):
    """Rows, class 0 and class 1 (3 x slots x asked x codes), least and greatest value (slots x asked x codes) by cell:
    each task adds up its own counters, of bounded number, and Spark those of the tasks. Extremes are those of
    features marked in `many`; with one code to a cell, only the first feature of a node counts its rows."""
    size = slots * asked * codes

    def run(batches):
        state, sums = shared.value, np.zeros((3, size), np.int64)
        low, high = np.full(size, np.inf), np.full(size, -np.inf)
        for batch in batches:
            columns = columns_of(state, as_matrix(batch.column(2)))
            for _, slot, _, at, y, times in members(state, batch):
                first, past = slot.min() * asked * codes, (slot.max() + 1) * asked * codes
                classes = times * np.where(y == 0, 1.0, 2.0**26)  # both in one sum: a batch has less than 2**22 rows
                for j, some, own, f, value, cell in asked_of(state, columns, at, slot):
                    if codes == 1:
                        order = np.argsort(own, kind="stable")
                        starts = np.flatnonzero(np.diff(own[order], prepend=-1))
                        place, value = cell[order[starts]], value[order]
                        low[place] = np.minimum(low[place], np.minimum.reduceat(value, starts))
                        high[place] = np.maximum(high[place], np.maximum.reduceat(value, starts))
                        if j:
                            continue
                    elif state["many"].any():
                        wide = np.flatnonzero(state["many"][f])
                        np.minimum.at(low, cell[wide], value[wide])
                        np.maximum.at(high, cell[wide], value[wide])
                    cell = cell - first
                    found = np.bincount(cell, classes if some is None else classes[some], past - first)
                    n1 = np.floor(found / 2.0**26)
                    n0 = found - n1 * 2.0**26
                    n = np.bincount(cell, minlength=past - first) if state["bootstrap"] else n0 + n1
                    for into, counted in zip(sums, (n, n0, n1)):
                        into[first:past] += counted.astype(np.int64)
        full = np.flatnonzero((sums[0] > 0) | (low <= high))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (full, *(k[full] for k in (*sums, low, high)))],
                                         ["cell", "n", "n0", "n1", "low", "high"])
    parts = rows.mapInArrow(run, "cell long, n long, n0 long, n1 long, low double, high double")
    sums, low, high = np.zeros((3, size), np.int64), np.full(size, np.inf), np.full(size, -np.inf)
    for r in parts.groupBy("cell").agg(F.sum("n"), F.sum("n0"), F.sum("n1"), F.min("low"), F.max("high")).toLocalIterator():
        sums[:, r[0]], low[r[0]], high[r[0]] = r[1:4], r[4], r[5]
    shape = (slots, asked, codes)
    return sums.reshape(3, *shape), low.reshape(shape), high.reshape(shape)


def inner_splits(rows, shared, spread, growth, asked):
    """The best split between two values inside each of the wanted cells, by (slot, feature asked): rows (place, gain,
    cut, rows on its left). `spread`: see Forest._inner. Groups of cells are tried in one task each."""
    def deal(batches):
        state, cells = shared.value, spread.value
        for batch in batches:
            columns, found = columns_of(state, as_matrix(batch.column(2))), []

            def dealt():
                group, cell, value, times = (np.concatenate(c) for c in zip(*found))
                found.clear()
                order = np.argsort(group, kind="stable")
                starts = np.flatnonzero(np.diff(group[order], prepend=-1))
                out = [pa.array(group[order][starts])]
                for values in (cell, value, times):
                    ends = np.append(starts, len(order)).astype(np.int32) * values.itemsize
                    out.append(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(values[order])]))
                return pa.RecordBatch.from_arrays(out, ["group", "cell", "value", "times"])
            for _, slot, _, at, y, times in members(state, batch):
                each = (2 * times + y).astype(np.uint8)
                for _, some, _, _, value, cell in asked_of(state, columns, at, slot):
                    group = cells["group"][cell]
                    wanted = np.flatnonzero((group >= 0) & (value < cells["high"][cell]))
                    if len(wanted):
                        found.append((group[wanted], cell[wanted].astype(np.int32), value[wanted],
                                      each[wanted if some is None else some[wanted]]))
                if sum(len(c[0]) for c in found) > DEALT_AT_ONCE:
                    yield dealt()
            if found:
                yield dealt()

    def tried(table):
        cells = spread.value
        cell, value, times = (np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in
                              (("cell", np.int32), ("value", np.float64), ("times", np.uint8)))
        order = np.lexsort((value, cell))
        cell, value, times = cell[order], value[order], times[order].astype(np.int64)
        own = np.flatnonzero(np.diff(cell, prepend=-1))
        node = np.repeat(np.arange(len(own)), np.diff([*own, len(cell)]))
        past = np.stack([np.arange(1, len(cell) + 1), np.cumsum(np.where(times % 2 == 0, times // 2, 0)), np.cumsum(np.where(times % 2 == 1, times // 2, 0))])
        before = np.concatenate([np.zeros((3, 1), np.int64), past], axis=1)[:, own]
        after = np.append(value[1:], 0.0)
        ends = np.append(own[1:], len(cell)) - 1
        after[ends] = cells["high"][cell[ends]]
        base = np.stack([cells["before"][k][cell] for k in range(3)])
        left = base + past - before[:, node]
        slot = cell // (asked * cells["codes"])
        whole = cells["totals"][:, slot]
        fits = (value < after) & growth.fits(left[0], whole[0])
        gain = np.where(fits, growth.purity(left[1:], whole[1:]), -np.inf)
        best = firsts(gain, node)
        return pa.table({"place": cell[best].astype(np.int64) // cells["codes"], "gain": gain[best],
                         "cut": between(value[best], after[best]), "n": left[0][best]})
    found = rows.mapInArrow(deal, "group long, cell binary, value binary, times binary")
    each = found.groupBy("group").applyInArrow(tried, "place long, gain double, cut double, n long")
    return each.groupBy("place").agg(F.max(F.struct("gain", (-F.col("cut")).alias("back"), "n")).alias("best")).select(
        "place", "best.gain", (-F.col("best.back")).alias("cut"), "best.n").toLocalIterator()


class Candidates:
    """What is known of the splits of some nodes: per feature and node, whether it varies there, the gain of its best
    threshold, that threshold and the rows on its left; per node, its rows and classes."""

    def __init__(self, width, slots):
        self.varies, self.gain = np.zeros((width, slots), bool), np.full((width, slots), -np.inf)
        self.cut, self.left, self.totals = np.zeros((width, slots)), np.zeros((width, slots), np.int64), np.zeros((3, slots), np.int64)


class Forest(Estimator):
    """Random forest, or extremely randomized trees: random_thresholds without bootstrap.
    `balanced` gives both classes the same total weight. One of `features` (by default the square root of
    their number) features that vary in a node parts it, or the first of the others that can."""

    def __init__(self, trees=300, max_depth=None, min_leaf=2, min_split=2, bootstrap=True, random_thresholds=False,
                 balanced=True, seed=SEED, ranges=64, cells=CELLS, features=None):
        super().__init__()
        self.features = features
        self.trees, self.bootstrap, self.balanced, self.seed = trees, bootstrap, balanced, seed
        self.ranges, self.cells = ranges, cells
        self.limits = {"max_depth": max_depth, "min_leaf": min_leaf, "min_split": min_split,
                       "random_thresholds": random_thresholds}

    def _fit(self, dataset):
        rows = dense(dataset)
        first = rows.select(F.size("x")).first()
        if first is None:
            raise ValueError("no rows to learn from")
        width = first[0]
        if width > MOST_FEATURES:
            raise TooManyFeatures(f"{width} features; a forest takes at most {MOST_FEATURES}")
        sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        n = sum(sizes.values())
        weights = tuple(n / (2 * sizes[c]) if self.balanced and sizes.get(c) else 1.0 for c in (0, 1))
        growth = Growth(self.features or max(1, int(width**0.5)), weights, **self.limits)
        keys = tree_keys(self.seed, range(self.trees))
        bound = max(256, self.cells // width)
        upper = Upper(keys)
        if n < bound:
            upper.state = [SMALL] * self.trees
            rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)  # all cores deal rows to trees
        else:
            self._grow_upper(rows, upper, growth, keys, width, bound, n)
        return self._grow_rest(rows, upper, growth, keys, width)

    def _state(self, rows, upper, nodes, keys, **more):
        slot, trees = upper.slots(nodes)
        return rows.sparkSession.sparkContext.broadcast(
            {"nodes": upper.nodes().packed(), "slot": slot, "trees": trees, "keys": keys, "bootstrap": self.bootstrap, **more})

    def _grow_upper(self, rows, upper, growth, keys, width, bound, n):
        random, ranges = growth.random_thresholds, max(self.ranges, -(-n // VALUES_AT_ONCE))
        borders = None if random else value_ranges(rows, width, ranges)
        codes = 2 if random else 1 + max(len(last) for _, last in borders)
        at_once = max(1, COUNTERS // (min(width, growth.features + MORE) * codes))
        while True:
            open_ = [k for k, s in enumerate(upper.state) if s == OPEN]
            if not open_:
                return
            for at in range(0, len(open_), at_once):
                self._split(rows, upper, open_[at:at + at_once], growth, keys, width, codes, borders, bound)

    def _split(self, rows, upper, nodes, growth, keys, width, codes, borders, bound):
        own = np.array([upper.key[k] for k in nodes], np.uint64)
        deep = np.array([growth.max_depth is not None and upper.depth[k] >= growth.max_depth for k in nodes])
        flat = np.zeros((len(nodes), width), bool)
        for s, node in enumerate(nodes):
            flat[s, list(upper.flat[node])] = True
        order, found = growth.order(own, width), Candidates(width, len(nodes))
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(flat, order, axis=1), axis=1, kind="stable"), axis=1)
        past = np.maximum(1, width - flat.sum(axis=1))
        place, need, todo = np.zeros(len(nodes), int), np.full(len(nodes), growth.features), np.arange(len(nodes))
        while len(todo):
            # Features that vary, as drawn (some may not: MORE are asked at once); then, where none of these parts the
            # node, the others one after the other.
            take = np.minimum(np.where(need[todo] > 0, need[todo], growth.features) + MORE, past[todo] - place[todo])
            take[deep[todo]] = 1  # only counted
            at = place[todo, None] + np.arange(take.max())
            ask = np.where(at < (place[todo] + take)[:, None], order[todo[:, None], np.minimum(at, width - 1)], LEAF)
            ended = deep[todo]
            self._ask(rows, upper, [nodes[s] for s in todo], growth, keys, own, todo, ask, np.maximum(need[todo], 0), ended, codes, borders, found)
            place[todo] += take
            need[todo] -= np.where(ask >= 0, found.varies[ask, todo[:, None]], False).sum(axis=1)
            more = growth.splittable(*found.totals[:, todo]) & ~ended & (place[todo] < past[todo])
            todo = todo[more & ((need[todo] > 0) | ~np.isfinite(found.gain[:, todo]).any(axis=0))]
        picked = growth.chosen(own, found.gain, found.varies)
        for s, node in enumerate(nodes):
            n, n0, n1 = found.totals[:, s]
            f = picked[s]
            if deep[s] or f == LEAF or not growth.splittable(n, n0, n1):
                upper.close(node, float(growth.value(n0, n1)))
                continue
            left = found.left[f, s]
            upper.flat[node] |= {int(k) for k in order[s, :place[s]] if not found.varies[k, s]}
            for child, size in zip(upper.split(node, int(f), float(found.cut[f, s])), (left, n - left)):
                if size < bound:
                    upper.state[child] = SMALL

    def _ask(self, rows, upper, nodes, growth, keys, own, slots, ask, need, ended, codes, borders, found):
        """Tries the features asked of each of the nodes (nodes x asked, -1: none), of which the first `need` that vary
        are drawn; `slots`: the nodes' places in found."""
        width, shape, asked = len(found.gain), ask.shape, ask >= 0
        f, column = np.maximum(ask, 0), slots[:, None]

        def counted(many, codes, **more):
            shared = self._state(rows, upper, nodes, keys, ask=ask, many=many, codes=codes, **more)
            return shared, cell_facts(rows, shared, *shape, codes)
        if borders is None:
            _, (counts, low, high) = counted(np.ones(width, bool), 1)
            totals, varies = counts.max(axis=(2, 3)), asked & (low < high)[:, :, 0]
            ends = np.zeros((2, width, len(own)))
            ends[:, f[asked], np.broadcast_to(column, shape)[asked]] = np.stack([low, high])[:, :, :, 0][:, asked]
            cut = growth.thresholds(own, *ends)[f, column]
            _, (counts, _, _) = counted(np.zeros(width, bool), 2, cuts=cut)
            left = counts[:, :, :, 0]
            fits = varies & (left[0] > 0) & growth.fits(left[0], totals[0][:, None])
            gain = np.where(fits, growth.purity(left[1:], totals[1:][:, :, None]), -np.inf)
            self._note(found, f, column, asked, varies, gain, cut, left[0], totals, slots)
            return
        many = np.array([not np.array_equal(*b) for b in borders])
        last = [last for _, last in borders]
        shared, (counts, low, high) = counted(many, codes, last=last)
        values = np.full((width, codes), np.inf)
        for k, own_values in enumerate(last):
            values[k, :len(own_values)] = own_values
        full, few = counts[0] > 0, ~many[f][:, :, None]
        low, high = np.where(full & few, values[f], low), np.where(full & few, values[f], high)
        totals, past = counts.sum(axis=3).max(axis=2), counts.cumsum(axis=3)
        varies, whole = asked & (low.min(axis=2) < high.max(axis=2)), totals[:, :, None, None]
        fits = full & growth.fits(past[0], whole[0])
        worth = np.where(fits, growth.purity(past[1:], whole[1:]), -np.inf)
        r = worth.argmax(axis=2)[:, :, None]
        after = np.minimum.accumulate(low[:, :, ::-1], axis=2)[:, :, ::-1]
        after = np.concatenate([after[:, :, 1:], np.full((*shape, 1), np.inf)], axis=2)
        gain, left, a, b = (np.take_along_axis(k, r, axis=2)[:, :, 0] for k in (worth, past[0], high, after))
        usable = np.isfinite(gain)
        cut = np.where(usable, between(np.where(usable, a, 0.0), np.where(usable, b, 0.0)), 0.0)
        # What a threshold inside a range can be worth at most, against the best border of the features drawn or its own.
        most, before = worth, past - counts
        for corner in ((before[1], past[2]), (past[1], before[2]), before[1:], past[1:]):
            most = np.maximum(most, growth.purity(corner, whole[1:]))
        own_best = np.where(varies, gain, -np.inf)
        first = varies & (varies.cumsum(axis=1) <= need[:, None])
        floor = np.where(first, np.where(first, own_best, -np.inf).max(axis=1, keepdims=True), own_best)
        floor = np.where(np.isfinite(floor), floor * (1 - 1e-9), -np.inf)[:, :, None]
        open_ = growth.splittable(*totals) & ~ended
        spare = ~first & first.any(axis=1, keepdims=True) & np.isfinite(floor.max(axis=1))  # asked, but not drawn
        inside = full & (low < high) & (most >= floor) & (open_[:, None] & ~spare)[:, :, None]
        for r in self._inner(rows, shared, growth, inside, counts, before, high, totals):
            s, j = divmod(r.place, shape[1])
            if (r.gain, -r.cut) > (gain[s, j], -cut[s, j]):
                gain[s, j], cut[s, j], left[s, j] = r.gain, r.cut, r.n
        self._note(found, f, column, asked, varies, np.where(varies, gain, -np.inf), cut, left, totals, slots)

    @staticmethod
    def _note(found, f, column, asked, varies, gain, cut, left, totals, slots):
        at = f[asked], np.broadcast_to(column, asked.shape)[asked]
        for into, values in ((found.varies, varies), (found.gain, gain), (found.cut, cut), (found.left, left)):
            into[at] = values[asked]
        found.totals[:, slots] = totals

    @staticmethod
    def _inner(rows, shared, growth, inside, counts, before, high, totals):
        """The best splits inside the ranges marked. Ranges are tried in groups of at most about GROUP_ROWS rows; a
        value that fills a range is its border, so that few rows of a range lie inside."""
        cells = np.flatnonzero(inside)
        if not len(cells):
            return []
        group = np.full(inside.size, -1, np.int64)
        group[cells] = np.cumsum(counts[0].ravel()[cells]) // GROUP_ROWS
        facts = {"group": group, "high": high.ravel(), "before": before.reshape(3, -1), "totals": totals,
                 "codes": inside.shape[2]}
        return inner_splits(rows, shared, rows.sparkSession.sparkContext.broadcast(facts), growth, inside.shape[1])

    def _grow_rest(self, rows, upper, growth, keys, width):
        small = [k for k, s in enumerate(upper.state) if s == SMALL]
        shared = self._state(rows, upper, small, keys)
        ids, depths, node_keys = np.array(small, np.int64), np.array(upper.depth), np.array(upper.key, np.uint64)

        def deal(batches):
            for batch in batches:
                records, facts = as_records(as_matrix(batch.column(2)))
                for _, slot, _, at, y, times in members(shared.value, batch):
                    order = np.argsort(slot, kind="stable")
                    starts = np.flatnonzero(np.diff(slot[order], prepend=-1))
                    columns = [pa.array(ids[slot[order][starts]]), pa.array([facts] * len(starts), pa.binary())]
                    for own in (records[at[order]], (2 * times + y)[order].astype(np.uint8)):
                        ends = np.append(starts, len(order)).astype(np.int32) * (own.nbytes // len(order))
                        columns.append(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(own)]))
                    yield pa.RecordBatch.from_arrays(columns, ["node", "facts", "x", "times"])

        def grow(table):
            node, facts = table.column("node")[0].as_py(), table.column("facts").to_pylist()
            times = np.frombuffer(b"".join(table.column("times").to_pylist()), np.uint8).astype(np.int64)
            x, at = np.empty((width, len(times))), 0
            for own, blob in zip(facts, table.column("x")):
                part = from_records(np.frombuffer(blob.as_buffer(), np.uint8), own, width)
                x[:, at:at + part.shape[1]] = part
                at += part.shape[1]
            n0, n1 = (np.where(times % 2 == y, times // 2, 0) for y in (0, 1))
            found = grown_columns(x, n0, n1, node_keys[node:node + 1], growth, int(depths[node]))
            return pa.table({"node": [node], "parts": [found.packed()]},
                            schema=pa.schema([("node", pa.int64()), ("parts", pa.list_(pa.binary()))]))
        dealt = rows.mapInArrow(deal, "node long, facts binary, x binary, times binary")
        grown_trees = materialize(dealt.groupBy("node").applyInArrow(grow, "node long, parts array<binary>"), "trees")
        size = grown_trees.agg(F.sum(F.octet_length(F.col("parts")[0]))).first()[0] or 0
        if size // 4 + len(upper.tree) > MOST_NODES:
            return TreesModel(upper.nodes(), "mean", below=grown_trees)
        return TreesModel(grafted(upper.nodes(), {r.node: Nodes.unpacked(r.parts) for r in grown_trees.toLocalIterator()}), "mean")


def grafted(upper, below):
    """The upper levels with a grown tree in place of each small node."""
    base, columns = len(upper.feature), [[np.array(c)] for c in upper.parts()[:5]]
    for node in sorted(below):
        tree = below[node]
        shifted = [np.where(c == LEAF, LEAF, c + base) if k in (2, 3) else c for k, c in enumerate(tree.parts()[:5])]
        for column, values in zip(columns, shifted):
            column[0][node] = values[0]
            column.append(values)
        base += len(tree.feature)
    return Nodes(*(np.concatenate(c).astype(k) for c, k in zip(columns, Nodes.KINDS)), upper.roots)


def as_bits(x):
    """Least and greatest value of every column, and which columns hold no others."""
    low, high = x.min(axis=0), x.max(axis=0)
    return low, high, ((x == low) | (x == high)).all(axis=0)


def packed_rows(x, low, high, two):
    """Rows as bytes: columns of two values as bits, the others one after the other."""
    bits = np.packbits(x[:, two] > low[two], axis=0)
    return b"".join((two.tobytes(), low[two].tobytes(), high[two].tobytes(), bits.tobytes(), np.ascontiguousarray(x[:, ~two].T).tobytes()))


def unpacked_rows(data, n, width):
    """The rows of `packed_rows`."""
    two, x = np.frombuffer(data, bool, width), np.empty((n, width))
    k, at = int(two.sum()), width
    low, high = np.frombuffer(data, np.float64, 2 * k, at).reshape(2, k)
    at += 16 * k
    bits = np.frombuffer(data, np.uint8, -(-n // 8) * k, at).reshape(-(-n // 8), k)
    x[:, two] = np.where(np.unpackbits(bits, axis=0, count=n), high, low)
    x[:, ~two] = np.frombuffer(data, np.float64, offset=at + bits.size).reshape(width - k, n).T
    return x


def as_records(x):
    """(rows as bytes of equal length, facts to read them): columns of two values are bits, the others follow."""
    low, high, two = as_bits(x)
    rest = np.ascontiguousarray(x[:, ~two]).view(np.uint8).reshape(len(x), -1)
    bits = np.packbits(x[:, two] > low[two], axis=1)
    return np.concatenate([bits, rest], axis=1), b"".join((two.tobytes(), low[two].tobytes(), high[two].tobytes()))


def from_records(data, facts, width):
    """The rows of `as_records`, as features by rows."""
    two = np.frombuffer(facts, bool, width)
    k = int(two.sum())
    low, high = np.frombuffer(facts, np.float64, 2 * k, width).reshape(2, k, 1)
    flags = -(-k // 8)
    records = data.reshape(-1, flags + 8 * (width - k))
    x = np.empty((width, len(records)))
    x[two] = np.where(np.unpackbits(records[:, :flags], axis=1, count=k).T, high, low)
    x[~two] = np.ascontiguousarray(records[:, flags:]).view(np.float64).reshape(len(records), width - k).T
    return x


def units(values):
    return np.rint(values * UNIT).astype(np.int64)


def table_totals(rows, upper, below):
    """(id, total): sum of the leaf values of all trees in units, for rows (id, x) whose ids differ. `below`
    (node, parts) holds the trees below some leaves of `upper`. Rows travel in blocks; a task
    holds one lower tree at a time, and one block adds up what its rows were given."""
    small = np.zeros(len(upper.feature), bool)
    for r in below.select("node").toLocalIterator():
        small[r.node] = True
    shared = rows.sparkSession.sparkContext.broadcast((upper.packed(), small))
    names = ["node", "block", "ids", "at", "x"]

    def deal(batches):
        state, small = shared.value
        nodes = Nodes.unpacked(state)
        for batch in (b for b in batches if b.num_rows):
            ids, x = batch.column(0).to_numpy(), as_matrix(batch.column(1))
            block, facts, known = int(ids[0]), as_bits(x), np.zeros(len(ids), np.int64)
            for root in nodes.roots:
                leaf = nodes.at(root, x)
                known += np.where(small[leaf], 0, units(nodes.value[leaf]))
                order = np.argsort(leaf, kind="stable")
                parts = [p for p in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1) if small[leaf[p[0]]]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(leaf[p[0]]) for p in parts], pa.int64()), pa.array([block] * len(parts), pa.int64()),
                    pa.nulls(len(parts), pa.binary()), pa.array([p.astype(np.int32).tobytes() for p in parts], pa.binary()),
                    pa.array([packed_rows(x[p], *facts) for p in parts], pa.binary())], names)
            # The ids of the block and what the upper levels say of its rows; no tree is waiting for it.
            yield pa.RecordBatch.from_arrays([pa.array([-1 - block]), pa.array([block]), pa.array([ids.tobytes()], pa.binary()),
                                              pa.array([known.tobytes()], pa.binary()), pa.nulls(1, pa.binary())], names)

    def score(batches):
        held, tree = None, None
        for batch in batches:
            found = []
            for node, block, ids, at, x, parts in zip(*(c.to_pylist() for c in batch.columns)):
                if parts is not None:
                    held, tree = node, Nodes.unpacked(parts)
                elif ids is not None:
                    found.append((block, ids, None, at))
                else:
                    if node != held:
                        raise ValueError(f"no tree below node {node}")
                    n = len(at) // 4
                    leaf = tree.at(0, unpacked_rows(x, n, width))
                    found.append((block, None, at, units(tree.value[leaf]).tobytes()))
            columns = zip(*found) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), *[pa.binary()] * 3))],
                                             ["block", "ids", "at", "value"])

    def add(table):
        ids, total = None, None
        columns = [table.column(c) for c in ("ids", "at", "value")]
        for own, _, value in zip(*columns):
            if own.is_valid:
                ids, total = np.frombuffer(own.as_py(), np.int64), np.frombuffer(value.as_py(), np.int64).copy()
        for _, at, value in zip(*columns):
            if at.is_valid:
                total[np.frombuffer(at.as_py(), np.int32)] += np.frombuffer(value.as_py(), np.int64)
        return pa.table({"id": ids, "total": total})
    first = rows.select(F.size("x")).first()
    width = first[0] if first else 0
    dealt = rows.mapInArrow(deal, "node long, block long, ids binary, at binary, x binary")
    both = dealt.unionByName(below, allowMissingColumns=True)
    scored = (both.repartition("node").sortWithinPartitions("node", F.col("block").asc_nulls_first())
              .mapInArrow(score, "block long, ids binary, at binary, value binary"))
    return scored.groupBy("block").applyInArrow(add, "id long, total long")


class TreesModel(Model, MLWritable, MLReadable):
    """Scores by trees: the mean of their leaf values as probability ("mean"), or the logistic function
    of `start` plus their sum ("logit"). Where `below` is given, it is a table of the trees below some
    leaves of `nodes`; scoring then writes the rows once and takes a batch table."""

    def __init__(self, nodes=None, link="mean", start=0.0, below=None):
        super().__init__()
        self.nodes, self.link, self.start, self.below = nodes, link, start, below

    def _transform(self, dataset):
        if self.below is not None:
            return self._by_table(dataset)
        session = dataset.sparkSession
        shared = session.sparkContext.broadcast(self.nodes.packed())

        @F.arrow_udf("double")
        def total(rows: pa.Array) -> pa.Array:
            return pa.array(Nodes.unpacked(shared.value).total(as_matrix(rows)))
        found = total(vector_to_array("features"))
        return self._scored(dataset, found)

    def _by_table(self, dataset):
        if dataset.isStreaming:
            raise ValueError("this forest is kept in a table and scores batch tables; use foreachBatch")
        rows = materialize(dataset.withColumn("__at", F.monotonically_increasing_id()), "to-score")
        totals = table_totals(rows.select(F.col("__at").alias("id"), vector_to_array("features").alias("x")), self.nodes, self.below)
        both = rows.join(totals.select(F.col("id").alias("__at"), F.col("total").alias("__total")), "__at")
        return self._scored(both, F.col("__total") / UNIT).select(
            *dataset.columns, "__vector", "__prediction")

    def _scored(self, dataset, found):
        p = (found / len(self.nodes.roots) if self.link == "mean"
             else 1 / (1 + F.exp(-(F.lit(float(self.start)) + found))))
        return dataset.withColumn("__p", p).withColumns({
            "__vector": array_to_vector(F.array(1 - F.col("__p"), F.col("__p"))),
            "__prediction": (F.col("__p") > 0.5).cast("double")}).drop("__p")

    def write(self):
        return TreesWriter(self)

    @classmethod
    def read(cls):
        return TreesReader()


class TreesWriter(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path):
        spark, model = SparkSession.active(), self.model
        facts = {"link": model.link, "start": model.start, "below": model.below is not None}
        DefaultParamsWriter.saveMetadata(model, path, spark, facts)
        spark.createDataFrame([(model.nodes.packed(),)], "parts array<binary>").write.parquet(f"{path}/trees")
        if model.below is not None:
            model.below.write.parquet(f"{path}/below")


class TreesReader(MLReader):
    def load(self, path):
        spark = SparkSession.active()
        facts = DefaultParamsReader.loadMetadata(path, spark)
        parts = spark.read.parquet(f"{path}/trees").first().parts
        below = spark.read.parquet(f"{path}/below") if facts.get("below") else None
        return TreesModel(Nodes.unpacked(parts), facts["link"], facts["start"], below)
