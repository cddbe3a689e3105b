"""Variable-order Markov models of several classes in one joint tree of byte contexts, scored for all positions at once.

A node is a byte string read backwards from a position: the byte there, then the one before, and so on. For a position,
its deepest node gives the byte in its longest known context, and the deepest node of the position before gives the
longest known context. In each class the log-probability is a number of the first plus a number of the second, because
what backing off costs depends on contexts alone; so scoring is table look-ups without any search per class.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Symbol 0 stands for bytes that training has not seen, 1 for the start of a text.
OTHER, START = 0, 1
#: Classes whose numbers are worked out at a time, in doubles; the tree itself holds single precision.
CLASSES = 4


@dataclass
class ContextTree:
    """symbol: byte -> symbol; child[node, symbol]; value and cost: [node, class]; depth and shorter: per node."""

    order: int
    classes: list
    symbol: np.ndarray
    child: np.ndarray
    shorter: np.ndarray
    depth: np.ndarray
    value: np.ndarray
    cost: np.ndarray

    def _deepest(self, x: np.ndarray) -> np.ndarray:
        none, last = len(self.value) - 1, len(self.child) - 1  # the node that stands for none; the row without children
        deep = at = np.zeros(len(x), dtype=np.int32)
        for k in range(self.order + 1):
            back = x if not k else np.concatenate([np.full(k, START, dtype=x.dtype), x[:-k]])[: len(x)]
            at = self.child[np.minimum(at, last), back]
            deep = np.where(at == none, deep, at)
        return deep

    def log_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """[text, class]: the natural logarithm of each text's probability in each class."""
        out = np.zeros((len(texts), len(self.classes)))
        some = [i for i, t in enumerate(texts) if t]
        if not some:
            return out
        raw = np.frombuffer(b"".join(b"\0" + texts[i] for i in some), dtype=np.uint8)
        sizes = np.array([len(texts[i]) + 1 for i in some])
        first = np.cumsum(sizes) - sizes
        x = self.symbol[raw]
        x[first] = START
        deep = self._deepest(x)
        context = np.concatenate([[0], deep[:-1]])
        context = np.where(self.depth[context] > self.order, self.shorter[context], context)
        each = self.value[deep] + self.cost[context]
        each[first] = 0
        out[some] = np.add.reduceat(each, first, axis=0, dtype=np.float64)
        return out


def _numbers(counts: np.ndarray, context: np.ndarray, parent: np.ndarray, levels: list[np.ndarray], interpolate: bool) -> tuple[np.ndarray, np.ndarray]:
    """(value, cost) of all nodes for some classes, from their counts. levels: the nodes of each depth."""
    total, n_classes = counts.shape
    sums, kinds = np.zeros((total, n_classes)), np.zeros((total, n_classes))
    np.add.at(sums, context[1:], counts[1:])
    np.add.at(kinds, context[1:], counts[1:] > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = np.where(sums > 0, np.log(kinds / (sums + kinds)), 0.0)
        cost = np.zeros((total, n_classes))
        cost[0] = escape[0]
        chance = np.full((total, n_classes), 1 / 256)
        value = np.full((total, n_classes), np.log(1 / 256))
        for at in levels[1:]:
            cost[at] = cost[parent[at]] + escape[at]
        for at in levels[1:]:
            up, s = parent[at], context[at]
            if interpolate:
                known = sums[s] > 0
                chance[at] = np.where(known, (counts[at] + kinds[s] * chance[up]) / (sums[s] + kinds[s]), chance[up])
                value[at] = np.log(chance[at]) - cost[s]
            else:
                value[at] = np.where(counts[at] > 0, np.log(counts[at] / (sums[s] + kinds[s])) - cost[s], value[up])
    return value, cost


def train(texts: list[bytes], labels: np.ndarray, classes: list, order: int, least: int = 2, interpolate: bool = False) -> ContextTree:
    """A tree from texts with labels (indexes of classes).

    Strings that occur fewer than least times are left out. Without interpolate, prediction by partial matching: a seen
    byte has n / (total + distinct), and distinct / (total + distinct) escapes to the shorter context (method C), at last
    to 1 / 256. With interpolate, Witten-Bell smoothing: that share is spread by the shorter context instead.
    """
    n_classes = len(classes)
    raw = np.frombuffer(b"".join(b"\0" + t for t in texts), dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    seen = np.bincount(raw, minlength=256)
    seen[0] -= len(texts)
    symbol = np.zeros(256, dtype=np.uint8 if (seen > 0).sum() < 250 else np.int16)
    symbol[np.flatnonzero(seen > 0)] = np.arange(2, 2 + (seen > 0).sum())
    width = int((seen > 0).sum()) + 2
    x = symbol[raw].astype(np.int64)
    x[first] = START
    label = np.repeat(labels, sizes)
    start = np.zeros(len(x), dtype=bool)
    start[first] = True
    # Level by level: node of each position, -1 where the string is too rare or would reach beyond the text's start.
    nodes, total = [np.zeros(len(x), dtype=np.int64)], 1
    older, counts, context_of, parent_of, depths = [np.zeros(1, np.int64)], [np.zeros((1, n_classes), np.int32)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    open_ = np.ones(len(x), dtype=bool)
    for k in range(order + 1):
        back = np.arange(len(x)) - k
        ok = open_ & (back >= 0)
        at = np.flatnonzero(ok)
        key = nodes[k][at] * width + x[at - k]
        names, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        both = np.bincount(inverse * n_classes + label[at], minlength=len(names) * n_classes).reshape(-1, n_classes)
        keep = (both.sum(1) >= least) | ((k == 0) & (names % width == START))
        ids = np.where(keep, np.cumsum(keep) - 1 + total, -1)
        node = np.full(len(x), -1, dtype=np.int64)
        node[at] = ids[inverse]
        example = at[where[keep]]
        older.append(names[keep] % width)
        counts.append(both[keep].astype(np.int32))
        parent_of.append(names[keep] // width)
        context_of.append(np.where(example > 0, nodes[k][example - 1], 0))
        depths.append(np.full(int(keep.sum()), k + 1))
        total += int(keep.sum())
        nodes.append(node)
        open_ = ok & (node >= 0) & ~start[np.maximum(back, 0)]
    return _assembled(order, classes, symbol, *(np.concatenate(v) for v in (counts, context_of, parent_of, depths, older)), interpolate)


def _assembled(order: int, classes: list, symbol: np.ndarray, counts: np.ndarray, context: np.ndarray, parent: np.ndarray, depth: np.ndarray, older: np.ndarray, interpolate: bool) -> ContextTree:
    """The tree of nodes numbered by depth, the root first. older: the symbol of each that its parent lacks."""
    total, n_classes = counts.shape
    inner = int((depth <= order).sum())  # nodes are numbered by depth, so those that may have children come first
    child = np.full((inner + 1, int(symbol.max(initial=1)) + 1), total, dtype=np.int32)
    child[parent[1:], older[1:]] = np.arange(1, total)
    # The start of a text is a context but is never predicted.
    counts[(depth == 1) & (older == START)] = 0
    value, cost = np.zeros((total + 1, n_classes), np.float32), np.zeros((total + 1, n_classes), np.float32)
    levels = [np.flatnonzero(depth == d) for d in range(order + 2)]
    for c in range(0, n_classes, CLASSES):
        block = slice(c, c + CLASSES)
        value[:total, block], cost[:total, block] = _numbers(counts[:, block].astype(np.float64), context, parent, levels, interpolate)
    return ContextTree(order, classes, symbol, child, np.append(parent, 0), np.append(depth, 0), value, cost)


#: Strings as numbers: BITS a byte, the last one lowest; bytes count from 1, and AHEAD stands for the start of a text.
BITS, AHEAD = 9, 257


def counted(texts: list[bytes], labels: np.ndarray, n_classes: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the strings of up to order + 1 bytes in texts, [string, class]: how often each occurs). order: 6 at most."""
    raw = np.frombuffer(b"".join(b"\0" + t for t in texts), dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    x = raw.astype(np.int64) + 1
    x[first] = AHEAD
    label, place = np.repeat(labels, sizes), np.arange(len(x)) - np.repeat(first, sizes)
    key, keys, own = np.zeros(len(x), dtype=np.int64), [], []
    for k in range(order + 1):
        at = np.flatnonzero(place >= k) if k else np.arange(len(x))
        key[at] += x[at - k] << (BITS * k)
        keys.append(key[at])
        own.append(label[at])
    names, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return names, np.bincount(inverse * n_classes + np.concatenate(own), minlength=len(names) * n_classes).reshape(-1, n_classes)


def grown(keys: np.ndarray, counts: np.ndarray, classes: list, order: int, least: int, interpolate: bool) -> ContextTree:
    """The tree that train makes, from the strings of all texts and their counts (as counted gives them, each string once)."""
    keep = (counts.sum(1) >= least) | (keys == AHEAD)
    keys, counts = keys[keep], counts[keep]
    depth = sum((keys >> (BITS * k) > 0).astype(np.int64) for k in range(order + 1))
    by = np.lexsort((keys, depth))
    keys, counts, depth = keys[by], counts[by], depth[by]
    starts = np.searchsorted(depth, np.arange(order + 3))
    parent, context = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for d in range(2, order + 2):
        level, above = slice(starts[d], starts[d + 1]), slice(starts[d - 1], starts[d])
        parent[level] = np.searchsorted(keys[above], keys[level] & ((1 << (BITS * (d - 1))) - 1)) + starts[d - 1] + 1
        context[level] = np.searchsorted(keys[above], keys[level] >> BITS) + starts[d - 1] + 1
    single = keys[starts[1] : starts[2]]
    known = single[single < AHEAD] - 1
    symbol = np.zeros(256, dtype=np.uint8 if len(known) < 250 else np.int16)
    symbol[known] = np.arange(2, 2 + len(known))
    oldest = keys >> (BITS * (depth - 1))
    older = np.where(oldest == AHEAD, START, symbol[np.minimum(oldest, 256) - 1])
    root = np.zeros(1, np.int64)
    return _assembled(order, classes, symbol, np.vstack([np.zeros((1, len(classes)), counts.dtype), counts]), *(np.concatenate([root, v]) for v in (context, parent, depth, older)), interpolate)
