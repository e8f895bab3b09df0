"""Cover tree over unit vectors and the dual traversal of two trees, in numpy.

Levels are nested nets with halving radii: a node's children are centres more than the next
radius apart (its own centre first), every point of the node belongs to a child whose centre is
within that radius, and levels that would not split a node are skipped.  A node keeps the
greatest distance from its centre to its points, which is at most its level's radius.

The traversal looks at pairs of nodes.  By the triangle inequality a pair whose centres are farther
apart than both covering radii and the threshold holds no link and is pruned; one whose points
must all be within the threshold is taken whole; others are split into their children.
Distances are chords, so cosine >= c is chord <= sqrt(2 - 2c).  Every single link is
decided by the cosine in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_SLACK = 1e-9
_STRIP = 1024
_PAIRS = 1 << 16


@dataclass
class CoverTree:
    points: np.ndarray  # unit vectors, reordered so that each node covers a range
    order: np.ndarray  # original number of each point
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray
    child: np.ndarray  # first child of each node
    children: np.ndarray  # number of children

    @classmethod
    def build(cls, points: np.ndarray) -> CoverTree:
        n = len(points)
        order = np.arange(n)
        nodes: list[list] = []  # centre, radius, first, last, child, children

        def chord(c: int, idx: np.ndarray) -> np.ndarray:
            gap = points[idx] - points[c]
            return np.sqrt(np.einsum("ij,ij->i", gap, gap))

        def add(centre: int, dist: np.ndarray, first: int, last: int) -> None:
            nodes.append([centre, float(dist.max()) if len(dist) else 0.0, first, last, 0, 0])

        if n:
            add(0, chord(0, order), 0, n)
        todo = [0] if n else []
        while todo:
            at = todo.pop()
            centre, radius, first, last, *_ = nodes[at]
            if radius == 0.0:
                continue
            level = 2.0
            while level >= radius:  # levels that cover the node in one child
                level /= 2
            left, c, groups = order[first:last].copy(), centre, []
            there, x = np.ones(len(left), bool), points[left]
            while c >= 0:
                near = there & (2 - 2 * (x @ points[c]) <= level * level)
                near[left == c] = True
                groups.append((c, left[near], chord(c, left[near])))
                there &= ~near
                if 2 * there.sum() < len(left):
                    left, x = left[there], x[there]
                    there = np.ones(len(left), bool)
                c = int(left[there.argmax()]) if there.any() else -1
            nodes[at][4:] = len(nodes), len(groups)
            for c, idx, dist in groups:
                order[first : first + len(idx)] = idx
                todo.append(len(nodes))
                add(c, dist, first, first + len(idx))
                first += len(idx)
        table = np.array(nodes, float).reshape(-1, 6)
        whole = table[:, [0, 2, 3, 4, 5]].astype(np.int64)
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        return cls(points[order], order, back[whole[:, 0]] if n else whole[:, 0], table[:, 1], *whole[:, 1:].T)

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """Children of the nodes; a node without children stands for itself."""
        k = np.maximum(self.children[nodes], 1)
        start = np.where(self.children[nodes] > 0, self.child[nodes], nodes)
        return np.repeat(start - np.cumsum(k) + k, k) + np.arange(int(k.sum()))


def _chords(a: CoverTree, p: np.ndarray, b: CoverTree, q: np.ndarray) -> np.ndarray:
    out = np.empty(len(p))
    for k in range(0, len(p), _PAIRS):
        gap = a.points[a.centre[p[k : k + _PAIRS]]] - b.points[b.centre[q[k : k + _PAIRS]]]
        out[k : k + _PAIRS] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def _close(a: CoverTree, s: np.ndarray, b: CoverTree, t: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two sets of nodes that a matrix of cosines does not rule out by the covering bound."""
    found = []
    # Points without extent are most of the nodes; apart from the others their bound is tighter.
    for leaf_s in (True, False):
        for leaf_t in (True, False):
            p, q = s[(a.radius[s] == 0) == leaf_s], t[(b.radius[t] == 0) == leaf_t]
            if not len(p) or not len(q):
                continue
            y = b.points[b.centre[q]].astype(np.float32)
            for k in range(0, len(p), _STRIP):
                x = a.points[a.centre[p[k : k + _STRIP]]].astype(np.float32)
                reach = np.float32(limit)
                if not (leaf_s and leaf_t):
                    reach = reach + a.radius[p[k : k + _STRIP], None].astype(np.float32) + b.radius[q].astype(np.float32)
                least = 1 - np.minimum(reach, 2) ** 2 / 2 - np.float32(1e-4)  # float32 only for the first sieve
                i, j = np.nonzero(x @ y.T >= least)
                found.append((p[k + i], q[j]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none)


def _split(tree: CoverTree, nodes: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node's children, with the other node of the pair repeated for them."""
    return tree.below(nodes), np.repeat(other, np.maximum(tree.children[nodes], 1))


def _narrow(tree: CoverTree, nodes: np.ndarray, limit: float) -> np.ndarray:
    """The nodes with those split whose radius is so large that no pair of such nodes can be pruned."""
    while (tree.radius[nodes] > (2 - limit) / 2).any():
        wide = tree.radius[nodes] > (2 - limit) / 2
        nodes = np.concatenate((nodes[~wide], tree.below(nodes[wide])))
    return nodes


def linked_nodes(a: CoverTree, b: CoverTree, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Node pairs whose points are all linked; together they hold every linked pair of points once.

    ``same``: both are one tree; each unordered pair is then found once, and a node paired with
    itself stands for the pairs inside it."""
    limit = float(np.sqrt(2 - 2 * cosine))
    none = np.zeros(0, np.int64)
    if not len(a.centre) or not len(b.centre):
        return none, none
    out: list[tuple[np.ndarray, np.ndarray]] = []
    root = np.zeros(1, np.int64)
    wide = [(_narrow(a, root, limit), _narrow(b, root, limit), same)]  # sets of nodes, all against all
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    while wide or pairs:
        if pairs:
            p, q = pairs.pop()
            own = False
            if len(p) > _PAIRS:
                pairs.append((p[_PAIRS:], q[_PAIRS:]))
                p, q = p[:_PAIRS], q[:_PAIRS]
        else:
            s, t, own = wide.pop()
            p, q = _close(a, s, b, t, limit)
            if own:
                p, q = p[p <= q], q[p <= q]
        chord = _chords(a, p, b, q)
        both = (p == q) if own else np.zeros(len(p), bool)
        span = np.where(both, 2 * a.radius[p], chord + a.radius[p] + b.radius[q])
        keep = chord <= a.radius[p] + b.radius[q] + limit + _SLACK
        points = (a.radius[p] == 0) & (b.radius[q] == 0)
        whole = span <= limit - _SLACK
        exact = np.einsum("ij,ij->i", a.points[a.centre[p[points]]], b.points[b.centre[q[points]]]) >= cosine
        whole[points] = exact | both[points]
        out.append((p[whole], q[whole]))
        rest = keep & ~whole & ~points
        for x in p[rest & both].tolist():
            inner = a.below(np.array([x]))
            wide.append((inner, inner, True))
        p, q = p[rest & ~both], q[rest & ~both]
        larger = a.radius[p] >= b.radius[q]
        if larger.any():
            pairs.append(_split(a, p[larger], q[larger]))
        if not larger.all():
            pairs.append(_split(b, q[~larger], p[~larger])[::-1])
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _range_sums(size: int, first: np.ndarray, last: np.ndarray, value: np.ndarray) -> np.ndarray:
    steps = np.zeros(size + 1)
    np.add.at(steps, first, value)
    np.add.at(steps, last, -value)
    return np.rint(np.cumsum(steps[:-1])).astype(np.int64)


def links_and_roots(
    a: CoverTree, wa: np.ndarray, b: CoverTree, wb: np.ndarray, cosine: float, same: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Of the points of ``a`` then ``b`` (of ``a`` alone if ``same``), in tree order: the weight linked
    to each, and the number of a point that stands for its connected points."""
    p, q = linked_nodes(a, b, cosine, same)
    na, nb = len(a.order), 0 if same else len(b.order)
    sum_a, sum_b = (np.concatenate(([0], np.cumsum(w))) for w in (wa, wb))
    weight_p = sum_a[a.last[p]] - sum_a[a.first[p]]
    weight_q = sum_b[b.last[q]] - sum_b[b.first[q]]
    own = (p == q) if same else np.zeros(len(p), bool)
    links = _range_sums(na, a.first[p], a.last[p], weight_q)
    if same:
        links -= wa * (_range_sums(na, a.first[p[own]], a.last[p[own]], np.ones(int(own.sum()))) > 0)
        links += _range_sums(na, a.first[q[~own]], a.last[q[~own]], weight_p[~own])
    else:
        links = np.concatenate((links, _range_sums(nb, b.first[q], b.last[q], weight_p)))
    # Points of a node that is linked whole are connected through the other node.
    ends = [(a, np.unique(p), 0), (b, np.unique(q), 0 if same else na)]
    u, v = [a.first[p]], [b.first[q] + (0 if same else na)]
    for tree, nodes, shift in ends:
        k = tree.last[nodes] - tree.first[nodes]
        start = np.repeat(tree.first[nodes], k)
        u.append(start + shift)
        v.append(start + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + shift)
    u, v = np.concatenate(u), np.concatenate(v)
    root = np.arange(na + nb)
    while True:
        least = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], least)
        np.minimum.at(root, root[v], least)
        root = root[root]
        if np.array_equal(before, root):
            return links, root
