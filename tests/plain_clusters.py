"""Clusters by one search after the other in plain Python, to hold the distributed search against."""

import numpy as np


class _Graph:
    def __init__(self, src, dst, sign):
        nodes = sorted(set(src) | set(dst))
        self.nodes = nodes
        self.plus = {n: set() for n in nodes}
        self.minus = {n: set() for n in nodes}
        for a, b, s in zip(src, dst, sign, strict=True):
            side = self.plus if s > 0 else self.minus
            side[a].add(b)
            side[b].add(a)

    def similarity(self, a, b) -> int:
        """Common neighbours."""
        return len(self.plus[a] & self.plus[b])

    def gain(self, node, members: set, penalty: float) -> float:
        """Change of the total score if node joins members: its edges into them no longer leave, repulsion counts."""
        return penalty * len(self.minus[node] & members) - 2 * len(self.plus[node] & members)

    def total(self, cuts: list[set], penalty: float) -> float:
        where = {n: k for k, c in enumerate(cuts) for n in c}
        leave = sum(where.get(a, -1 - a) != where.get(b, -1 - b) for a in self.nodes for b in self.plus[a] if a < b)
        inside = sum(len(self.minus[n] & c) for c in cuts for n in c) // 2
        return 2 * leave + penalty * inside


def _grow(g: _Graph, rng: np.random.Generator, penalty: float, min_common: int) -> list[set]:
    """Clusters grown from random seeds that no cluster has yet: a neighbour joins if it has enough common neighbours and the score
    falls. Clusters may overlap."""
    seen, cuts = set(), []
    for seed in rng.permutation(g.nodes).tolist():
        if seed in seen:
            continue
        cut, queue = {seed}, [seed]
        while queue:
            at = queue.pop(int(rng.integers(len(queue))))
            for n in sorted(g.plus[at] - cut):
                if g.similarity(n, at) >= min_common and g.gain(n, cut, penalty) < 0:
                    cut.add(n)
                    queue.append(n)
        seen |= cut
        cuts.append(cut)
    return cuts


def merge_reciprocal(cuts: list[set], ratio: float = 0.75) -> list[set]:
    """Clusters of which two with more than a share of both in common are one; the first takes in every later one that fits it as it is
    by then."""
    out: list[set] = []
    rest = [set(c) for c in cuts]
    while rest:
        first, others = rest[0], []
        for c in rest[1:]:
            common = len(first & c)
            if common > ratio * len(first) and common > ratio * len(c):
                first |= c
            else:
                others.append(c)
        out.append(first)
        rest = others
    return out


def unique_members(g: _Graph, cuts: list[set], penalty: float) -> list[set]:
    """Nodes of several clusters stay in the one whose own score is lowest without them, the first among equals."""

    def score(cut: set) -> float:
        return sum(len(g.plus[n] - cut) for n in cut) + penalty * sum(len(g.minus[n] & cut) for n in cut) / 2

    cuts = [set(c) for c in cuts]
    for n in g.nodes:
        own = [k for k, c in enumerate(cuts) if n in c]
        if len(own) > 1:
            keep = min(own, key=lambda k: (score(cuts[k] - {n}), k))
            for k in own:
                if k != keep:
                    cuts[k].discard(n)
    return [c for c in cuts if c]


def _merge(g: _Graph, cuts: list[set], penalty: float) -> list[set]:
    """Joins the pair of clusters that lowers the score most, as long as one does. Only pairs with an edge between them can, and joining
    two adds up what each has towards the others, so that pairs are counted once."""
    where = {n: k for k, c in enumerate(cuts) for n in c}
    delta: dict[int, dict[int, float]] = {k: {} for k in range(len(cuts))}
    for side, cost in ((g.plus, -2.0), (g.minus, penalty)):
        for n in where:
            for m in side[n]:
                a, b = where[n], where.get(m)
                if b is not None and a != b:
                    delta[a][b] = delta[a].get(b, 0.0) + cost
    alive = {k: set(c) for k, c in enumerate(cuts)}
    while True:
        best = min(((d, a, b) for a, near in delta.items() for b, d in near.items() if a < b and d < 0), default=None)
        if best is None:
            return [alive[k] for k in sorted(alive)]
        _, a, b = best
        alive[a] |= alive.pop(b)
        for c, d in delta.pop(b).items():
            delta[c].pop(b)
            if c != a:
                delta[a][c] = delta[c][a] = delta[a].get(c, 0.0) + d


def _swap(g: _Graph, cuts: list[set], penalty: float, rounds: int, min_gain: float = 0.0, min_similar: int = 0) -> list[set]:
    """Moves single nodes to the cluster where they cost least, if that gains more than min_gain and some neighbour there has at least
    min_similar neighbours in common with the node."""
    for _ in range(rounds):
        moved = False
        where = {n: k for k, c in enumerate(cuts) for n in c}
        for n in g.nodes:
            if n not in where:
                continue
            here = where[n]
            fits = {where[m] for m in g.plus[n] if m in where and g.similarity(n, m) >= min_similar}
            cost = {k: g.gain(n, cuts[k] - {n}, penalty) for k in sorted(fits | {here})}
            k = min(cost, key=lambda k: (cost[k], k != here))
            if k != here and cost[here] - cost[k] > min_gain:
                cuts[here].discard(n)
                cuts[k].add(n)
                where[n] = k
                moved = True
        if not moved:
            break
    return [c for c in cuts if c]


def clusters(src, dst, sign, seed, penalty=5.0, min_common=3, overlap=0.75, rounds=20, min_gain=10.0, min_similar=3):
    """Score and clusters of one component from one start."""
    g = _Graph(src, dst, sign)
    rng = np.random.default_rng(seed)
    cuts = unique_members(g, merge_reciprocal(_grow(g, rng, penalty, min_common), overlap), penalty)
    cuts = _swap(g, _merge(g, cuts, penalty), penalty, rounds, min_gain, min_similar)
    return g.total(cuts, penalty), cuts
