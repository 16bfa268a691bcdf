"""Binary trees as flat arrays, and the growth of a classification tree in one task.

Draws (bags, features, thresholds) come from hashes of the seed, the tree, the path to the node and the
feature; class counts are whole numbers. A tree therefore depends on the rows alone, not on their order
or on how they are partitioned.
"""

from dataclasses import dataclass

import numpy as np

STEP = np.uint64(0x9E3779B97F4A7C15)
FACTORS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
LEAF = -1
#: P(count <= k) of a Poisson variable of mean 1: how often a row is in a bag.
POISSON = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 16)]))


def mixed(x):
    """Scrambled 64-bit values; products wrap around."""
    with np.errstate(over="ignore"):
        x = x + STEP
        x = (x ^ (x >> np.uint64(30))) * FACTORS[0]
        x = (x ^ (x >> np.uint64(27))) * FACTORS[1]
    return x ^ (x >> np.uint64(31))


def uniform(x):
    """Numbers in [0, 1) from hashes."""
    return (mixed(x) >> np.uint64(11)) * 2.0**-53


def as_keys(values):
    return np.atleast_1d(np.asarray(values)).astype(np.int64).view(np.uint64)


def tree_keys(seed, trees):
    """Key of each tree's root."""
    return mixed(as_keys(trees) ^ mixed(as_keys(seed)))


def child_keys(keys, right):
    return mixed(np.left_shift(keys, np.uint64(1)) + np.uint64(bool(right)) ^ keys >> np.uint64(63))


def bag_counts(root_key, ids):
    """How often each row is in the bag of a tree."""
    return np.searchsorted(POISSON, uniform(as_keys(ids) ^ mixed(root_key)), side="right")


@dataclass
class Nodes:
    """Trees of any number. Node k tests x[feature[k]] <= threshold[k] and goes to left[k] or
    right[k]; leaves have feature -1 and a value."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    KINDS = (np.int32, np.float64, np.int32, np.int32, np.float64, np.int32)

    def parts(self):
        return self.feature, self.threshold, self.left, self.right, self.value, self.roots

    def packed(self):
        return [np.asarray(p, k).tobytes() for p, k in zip(self.parts(), self.KINDS)]

    @classmethod
    def unpacked(cls, parts):
        return cls(*(np.frombuffer(p, k) for p, k in zip(parts, cls.KINDS)))

    def at(self, root, x, rows=None):
        """Leaf of each row of x (or of the given ones) below the node `root`."""
        rows = np.arange(len(x)) if rows is None else rows
        now = np.full(len(rows), root, np.int64)
        todo = np.flatnonzero(self.feature[now] != LEAF)
        while len(todo):
            here = now[todo]
            below = x[rows[todo], self.feature[here]] <= self.threshold[here]
            now[todo] = np.where(below, self.left[here], self.right[here])
            todo = todo[self.feature[now[todo]] != LEAF]
        return now

    def total(self, x):
        """Sum of the leaf values of all trees."""
        out = np.zeros(len(x))
        for root in self.roots:
            out += self.value[self.at(root, x)]
        return out


def joined(parts):
    """One Nodes of several, in order."""
    out, base = [[] for _ in range(6)], 0
    for p in parts:
        shift = (0, 0, base, base, 0, base)
        for column, values, by in zip(out, p.parts(), shift):
            column.append(np.where(values == LEAF, LEAF, values + by) if by else values)
        base += len(p.feature)
    return Nodes(*(np.concatenate([np.empty(0, k), *c]).astype(k) for c, k in zip(out, Nodes.KINDS)))


@dataclass(frozen=True)
class Growth:
    """How classification trees grow. Weights are those of classes 0 and 1; `features` are tried in a
    node (those that vary there, and more if none of them parts it); random thresholds are drawn
    between the least and the greatest value in the node, others are the best of all."""
    features: int
    weights: tuple
    min_leaf: int = 1
    min_split: int = 2
    max_depth: int | None = None
    random_thresholds: bool = False

    def splittable(self, rows, n0, n1):
        return (n0 > 0) & (n1 > 0) & (rows >= max(self.min_split, 2 * self.min_leaf))

    def value(self, n0, n1):
        """Share of class 1 by weight."""
        a, b = self.weights[0] * n0, self.weights[1] * n1
        return b / np.maximum(a + b, 1e-300)

    def purity(self, left, node):
        """What a split is chosen by: the greater, the lower the weighted Gini impurity."""
        out = 0
        for n0, n1 in ((left[0], left[1]), (node[0] - left[0], node[1] - left[1])):
            a, b = self.weights[0] * n0, self.weights[1] * n1
            out = out + (a * a + b * b) / np.maximum(a + b, 1e-300)
        return out

    def fits(self, left_rows, rows):
        return (left_rows >= self.min_leaf) & (rows - left_rows >= self.min_leaf)

    def thresholds(self, keys, low, high):
        """Random thresholds (features x nodes)."""
        order = mixed(np.arange(len(low), dtype=np.uint64) + np.uint64(1))
        found = low + uniform(keys[None, :] ^ mixed(order)[:, None]) * (high - low)
        return np.where(found >= high, low, found)

    def order(self, keys, width):
        """The features of each node (nodes x features) as they are drawn."""
        order = mixed(np.arange(width, dtype=np.uint64) + np.uint64(1))
        return np.argsort(mixed(keys[:, None] ^ order[None, :]) >> np.uint64(1), axis=1, kind="stable")

    def ranks(self, keys, varies):
        """Order (features x nodes) in which the features of each node are drawn, those that vary first."""
        order = mixed(np.arange(len(varies), dtype=np.uint64) + np.uint64(1))
        drawn = np.where(varies, mixed(keys[None, :] ^ order[:, None]) >> np.uint64(1), np.uint64(2**63))
        return np.argsort(np.argsort(drawn, axis=0, kind="stable"), axis=0, kind="stable")

    def chosen(self, keys, gain, varies):
        """Feature of each node, -1 if none parts it. gain: best per feature and node, -inf where a
        feature cannot part the node; varies: features that hold two values in the node."""
        rank = self.ranks(keys, varies)
        valid = varies & np.isfinite(gain)
        tried = valid & (rank < self.features)
        later = np.where(valid, rank, len(gain))
        tried |= valid & ~tried.any(axis=0) & (later == later.min(axis=0))
        best = np.where(tried, gain, -np.inf)
        return np.where(tried.any(axis=0), best.argmax(axis=0), LEAF)


def between(a, b):
    """A threshold with a on its left and b on its right."""
    middle = a / 2 + b / 2
    return np.where(middle >= b, a, np.maximum(middle, a))


def both(n0, n1):
    """Counts of two classes as one whole number each, so that one sum serves both; a sum stays below 2**32."""
    return n0.astype(np.int64) + (n1.astype(np.int64) << 32)


def parted(sums):
    return sums & 0xFFFFFFFF, sums >> 32


def firsts(gain, own):
    """Place of the first of the greatest gains of each group; groups lie one after the other."""
    _, at = np.unique(own, return_index=True)
    hit = np.flatnonzero(gain == np.repeat(np.maximum.reduceat(gain, at), np.diff([*at, len(own)])))
    return hit[np.unique(own[hit], return_index=True)[1]]


class Flags:
    """Features of at most two values as bits, 64 to a word. x: features by rows."""

    def __init__(self, x, low, high, two):
        self.two, self.low, self.high, self.words = two, low[two, None], high[two, None], []
        for k in range(0, len(two), 64):
            self.words.append(np.zeros(x.shape[1], np.uint64))
            for bit, f in enumerate(two[k:k + 64]):
                self.words[-1] |= (x[f] > low[f]).astype(np.uint64) << np.uint64(bit)

    def extremes(self, order, starts):
        """Least and greatest value of each feature (features by nodes)."""
        some, every = [], []
        for word in self.words:
            own = word[order]
            bits = np.arange(64, dtype=np.uint64)[:, None]
            for out, ufunc in ((some, np.bitwise_or), (every, np.bitwise_and)):
                out.append(ufunc.reduceat(own, starts) >> bits & np.uint64(1))
        some, every = (np.concatenate(k)[:len(self.two)] > 0 for k in (some, every))
        return np.where(every, self.high, self.low), np.where(some, self.high, self.low)


class Level:
    """The rows of all open nodes: `order` by node, `ordered` by node and value for each feature whose
    thresholds are sought among many. x: features by rows; counts: of both classes."""

    def __init__(self, x, flags, counts, order, ordered, at, nodes):
        self.x, self.flags, self.counts, self.order, self.ordered = x, flags, counts, order, ordered
        self.sizes = np.bincount(at[order], minlength=nodes)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.node = np.repeat(np.arange(nodes), self.sizes)
        self.own = counts[order]

    def totals(self):
        return parted(np.add.reduceat(self.own, self.starts))

    def extremes(self):
        out = np.empty((2, len(self.x), len(self.sizes)))
        if len(self.flags.two):
            out[:, self.flags.two] = self.flags.extremes(self.order, self.starts)
        for f in np.setdiff1d(np.arange(len(self.x)), self.flags.two):
            if f in self.ordered:
                out[:, f] = self.x[f][self.ordered[f][self.starts]], self.x[f][self.ordered[f][self.starts + self.sizes - 1]]
            else:
                own = self.x[f][self.order]
                out[:, f] = np.minimum.reduceat(own, self.starts), np.maximum.reduceat(own, self.starts)
        return out

    def part(self, nodes):
        """Which of the rows lie in the given nodes, and there the first row of each node and the node of each row."""
        if len(nodes) == len(self.sizes):
            return slice(None), self.sizes, self.starts, self.node
        wanted, sizes = np.zeros(len(self.sizes), bool), self.sizes[nodes]
        wanted[nodes] = True
        return (np.flatnonzero(wanted[self.node]), sizes, np.concatenate([[0], np.cumsum(sizes)[:-1]]),
                np.repeat(np.arange(len(nodes)), sizes))

    def best(self, growth, totals, wanted, cuts):
        """(best gain, its threshold) per feature and node, where wanted; gain -inf where nothing parts the
        node. Features that are not ordered are parted at `cuts`, one of each node at a time."""
        top, cuts, todo, flat = np.full(wanted.shape, -np.inf), cuts.copy(), wanted.copy(), self.x.ravel()
        todo[list(self.ordered)] = False
        while todo.any():
            nodes = np.flatnonzero(todo.any(axis=0))
            f = todo[:, nodes].argmax(axis=0)
            todo[f, nodes] = False
            at, sizes, starts, node = self.part(nodes)
            below = flat[(f * self.x.shape[1])[node] + self.order[at]] <= cuts[f, nodes][node]
            rows = np.add.reduceat(below, starts, dtype=np.int64)
            left = parted(np.add.reduceat(self.own[at] * below, starts))
            gain = growth.purity(left, [t[nodes] for t in totals])
            top[f, nodes] = np.where(growth.fits(rows, sizes), gain, -np.inf)
        for f in self.ordered:
            nodes = np.flatnonzero(wanted[f])
            if not len(nodes):
                continue
            at, sizes, starts, node = self.part(nodes)
            order = self.ordered[f][at]
            values = self.x[f][order]
            last = np.flatnonzero((values[:-1] < values[1:]) & (node[:-1] == node[1:]))
            last = last[growth.fits(last - starts[node[last]] + 1, sizes[node[last]])]
            if not len(last):
                continue
            own, here = node[last], self.counts[order]
            past = np.cumsum(here)
            left = parted(past[last] - (past[starts] - here[starts])[own])
            gain = growth.purity(left, [t[nodes][own] for t in totals])
            first = firsts(gain, own)
            top[f, nodes[own[first]]] = gain[first]
            cuts[f, nodes[own[first]]] = between(values[last[first]], values[last[first] + 1])
        return top, cuts

    def splits(self, growth, totals, keys, open_):
        """(feature, threshold) of each node. Only the drawn features are tried; all that vary where none
        of these parts the node."""
        low, high = self.extremes()
        varies = low < high
        cuts = growth.thresholds(keys, low, high) if growth.random_thresholds else between(low, high)
        drawn = varies & open_ & (growth.ranks(keys, varies) < growth.features)
        gain, found = self.best(growth, totals, drawn, cuts)
        none = open_ & ~np.isfinite(gain).any(axis=0)
        rest = varies & none & ~drawn
        if rest.any():
            more, at = self.best(growth, totals, rest, cuts)
            gain, found = np.where(rest, more, gain), np.where(rest, at, found)
        picked = np.where(open_, growth.chosen(keys, gain, varies), LEAF)
        return picked, found[np.maximum(picked, 0), np.arange(len(keys))]


def grown(x, n0, n1, key, growth, depth=0):
    """The tree below a node with the given key. x: rows by features; n0, n1: how often each
    row counts as class 0 and as class 1."""
    return grown_columns(np.ascontiguousarray(x.T), n0, n1, key, growth, depth)


def grown_columns(x, n0, n1, key, growth, depth=0):
    """`grown` of rows that are given as features by rows."""
    keys, counts, at, order = np.atleast_1d(key), both(n0, n1), np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
    # Random thresholds and features of two values need no order of values.
    low, high = x.min(axis=1), x.max(axis=1)
    two = np.array([((own == a) | (own == b)).all() for own, a, b in zip(x, low, high)])
    many = [] if growth.random_thresholds else np.flatnonzero(~two).tolist()
    flags, ordered = Flags(x, low, high, np.flatnonzero(two)), {f: np.argsort(x[f], kind="stable") for f in many}
    levels, base = [], 0
    while len(keys):
        level = Level(x, flags, counts, order, ordered, at, len(keys))
        totals, blank = level.totals(), np.full(len(keys), LEAF)
        node = [blank, np.zeros(len(keys)), blank.copy(), blank.copy(), growth.value(*totals)]
        levels.append(node)
        open_ = growth.splittable(level.sizes, *totals)
        if growth.max_depth is not None and depth >= growth.max_depth or not open_.any():
            break
        picked, cuts = level.splits(growth, totals, keys, open_)
        going = np.flatnonzero(picked != LEAF)
        if not len(going):
            break
        base += len(keys)
        new = np.full(len(keys), LEAF)
        new[going] = 2 * np.arange(len(going))
        node[0], node[1], node[2] = picked, np.where(picked == LEAF, 0.0, cuts), np.where(new == LEAF, LEAF, base + new)
        node[3] = np.where(new == LEAF, LEAF, base + new + 1)
        keys = np.stack([child_keys(keys[going], False), child_keys(keys[going], True)], axis=1).ravel()
        above = x.ravel()[(np.maximum(picked, 0) * x.shape[1])[level.node] + order] > cuts[level.node]
        at[order] = np.where(new[level.node] == LEAF, LEAF, new[level.node] + above)
        kind = np.uint16 if len(keys) < 2**16 else np.int64  # short integers are sorted by counting

        def dealt(rows):
            side = at[rows]
            rows, side = rows[side != LEAF], side[side != LEAF]
            return rows[np.argsort(side.astype(kind), kind="stable")]
        order, ordered, depth = dealt(order), {f: dealt(rows) for f, rows in ordered.items()}, depth + 1
    return Nodes(*(np.concatenate(c).astype(k) for c, k in zip(zip(*levels), Nodes.KINDS)), np.zeros(1, np.int32))
