"""Minimal acyclic transducer from byte strings to id sequences.

Built from sorted words by incremental minimisation: outputs are pushed towards the start as far as
they are certain, so equal endings of different words share their states. The finished automaton
is one flat block of integers that is memory-mapped where it is used.
"""

import mmap

import numpy as np


class State:
    __slots__ = ("arcs", "final", "tail")

    def __init__(self):
        self.arcs, self.final, self.tail = {}, False, ()

    def signature(self):
        return self.final, self.tail, tuple((c, id(s), out) for c, (s, out) in self.arcs.items())


def shared(a, b):
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


def build(pairs):
    """Root of the minimal transducer for (word, ids) pairs in ascending order of distinct words."""
    known, path, last = {}, [State()], b""

    def frozen(state):
        return known.setdefault(state.signature(), state)

    def close(upto):
        for at in range(len(last), upto, -1):
            _, out = path[at - 1].arcs[last[at - 1]]
            path[at - 1].arcs[last[at - 1]] = (frozen(path[at]), out)

    for word, ids in pairs:
        same, out = shared(word, last), tuple(ids)
        close(same)
        del path[same + 1:]
        for c in word[same:]:
            state = State()
            path[-1].arcs[c] = (state, ())
            path.append(state)
        path[-1].final = True
        for at in range(same):
            state, old = path[at].arcs[word[at]]
            n = shared(old, out)
            if n < len(old):
                path[at].arcs[word[at]] = (state, old[:n])
                state.arcs = {c: (s, old[n:] + o) for c, (s, o) in state.arcs.items()}
                state.tail = old[n:] + state.tail if state.final else state.tail
            out = out[n:]
        if same < len(word):
            path[same].arcs[word[same]] = (path[same + 1], out)
        else:
            path[same].tail = out
        last = word
    close(0)
    return path[0]


def packed(root):
    """The automaton as bytes: lengths, then int32 arrays of the symbol of each byte (0: none), the
    arc of each state and symbol (0: none), arc targets, ends of final outputs (-1: not final),
    places of arc outputs and of final outputs, and outputs."""
    order, at = [root], {id(root): 0}
    for state in order:
        for target, _ in state.arcs.values():
            if id(target) not in at:
                at[id(target)] = len(order)
                order.append(target)
    used = sorted({c for state in order for c in state.arcs})
    symbols = np.zeros(256, np.int32)
    symbols[used] = np.arange(1, len(used) + 1)
    width = len(used) + 1
    table, targets, places, pool, seen = np.zeros(len(order) * width, np.int32), [0], [0, 0], [], {(): (0, 0)}

    def place(out):
        if out not in seen:
            seen[out] = (len(pool), len(pool) + len(out))
            pool.extend(out)
        return seen[out]
    for k, state in enumerate(order):
        for c, (target, out) in state.arcs.items():
            table[k * width + symbols[c]] = len(targets)
            targets.append(at[id(target)] * width)
            places.extend(place(out))
    tails = np.full(2 * len(order), -1, np.int32)
    for k, state in enumerate(order):
        if state.final:
            tails[2 * k:2 * k + 2] = place(state.tail)
    parts = [symbols, table, targets, places, tails, pool]
    head = [width, *(len(p) for p in parts)]
    return np.concatenate([np.asarray(p, np.int32) for p in (head, *parts)]).tobytes()


class Transducer:
    """A packed automaton, read through a memory map. States are numbered in steps of the row width."""

    def __init__(self, path):
        with open(path, "rb") as file:
            self.data = memoryview(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)).cast("i")
        self.width, *lengths = self.data[:7]
        at, parts = 7, []
        for n in lengths:
            parts.append(self.data[at:at + n])
            at += n
        self.symbols, self.table, self.targets, self.places, self.tails, self.pool = parts
        self.pool = self.pool.cast("B") if len(self.pool) else b""

    def get(self, word):
        """Ids of the word as bytes of int32, None if it is not in the lexicon."""
        symbols, table, targets, places, out, state = self.symbols, self.table, self.targets, self.places, b"", 0
        for c in word:
            arc = table[state + symbols[c]]
            if not arc:
                return None
            first, past = places[2 * arc], places[2 * arc + 1]
            if first != past:
                out += self.pool[4 * first:4 * past]
            state = targets[arc]
        row = 2 * (state // self.width)
        past = self.tails[row + 1]
        return None if past < 0 else out + bytes(self.pool[4 * self.tails[row]:4 * past])
