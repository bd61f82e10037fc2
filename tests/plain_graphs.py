"""Plain one-machine versions of graph metrics, to compare with."""

import heapq

import numpy as np


class Graph:
    """A weighted undirected graph as compressed rows, nodes numbered in the order of their names; weights serve as distances."""

    def __init__(self, names: list[str], src: np.ndarray, dst: np.ndarray, weight: np.ndarray):
        self.names, self.n = names, len(names)
        ends, other, both = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([weight, weight])
        order = np.argsort(ends, kind="stable")
        self.to, self.weight = other[order], both[order]
        self.starts = np.searchsorted(ends[order], np.arange(self.n + 1))

    def near(self, u: int) -> tuple[list[int], list[float]]:
        cut = slice(self.starts[u], self.starts[u + 1])
        return self.to[cut].tolist(), self.weight[cut].tolist()

    def largest(self) -> np.ndarray:
        """Which nodes are in the largest component; of equal ones, that of the first node."""
        label = np.full(self.n, -1)
        for start in range(self.n):
            if label[start] < 0:
                label[start], stack = start, [start]
                while stack:
                    for v in self.near(stack.pop())[0]:
                        if label[v] < 0:
                            label[v] = start
                            stack.append(v)
        return label == np.bincount(label).argmax() if self.n else label == 0

    def paths_from(self, source: int) -> tuple[dict[int, float], dict[int, float]]:
        """Distances from a node, and what it adds to the betweenness of every other node it reaches."""
        best, dist, order = {source: 0.0}, {}, []
        ways, before = {source: 1}, {source: []}
        heap = [(0.0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if u in dist:
                continue
            dist[u] = d
            order.append(u)
            for v, w in zip(*self.near(u), strict=True):
                if v in dist:
                    continue
                new = d + w
                old = best.get(v)
                if old is None or new < old - 1e-12:
                    best[v], ways[v], before[v] = new, ways[u], [u]
                    heapq.heappush(heap, (new, v))
                elif abs(new - old) <= 1e-12:
                    ways[v] += ways[u]
                    before[v].append(u)
        share = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in before[v]:
                share[u] += ways[u] / ways[v] * (1 + share[v])
        share.pop(source)
        return dist, share

    def eigenvector(self, rounds: int = 1000, tolerance: float = 1e-3) -> np.ndarray | None:
        """Eigenvector centrality of the largest component by power iteration, NaN elsewhere; None without convergence."""
        inside = self.largest()
        size = int(inside.sum())
        if size < 2:
            return None
        x = np.where(inside, 1.0 / size, 0.0)
        row = np.repeat(np.arange(self.n), np.diff(self.starts))
        for _ in range(rounds):
            new = x + np.bincount(row, self.weight * x[self.to], self.n)
            new /= np.sqrt(new @ new) or 1.0
            if np.abs(new - x).sum() < size * tolerance:
                return np.where(inside, new, np.nan)
            x = new
        return None


def communities(near: list[dict[int, float]], seed: int) -> list[int]:
    """Greedy modularity by rounds of moving nodes and merging clusters; self-weights sit at near[u][u], counted twice."""
    rng = np.random.default_rng(seed)
    member = list(range(len(near)))
    while True:
        n = len(near)
        strength = [sum(w for w in x.values()) for x in near]
        total = sum(strength) or 1.0
        home, weight = list(range(n)), list(strength)
        moved_any = False
        moved = True
        while moved:
            moved = False
            for u in rng.permutation(n).tolist():
                links: dict[int, float] = {}
                for v, w in near[u].items():
                    if v != u:
                        links[home[v]] = links.get(home[v], 0.0) + w
                old = home[u]
                weight[old] -= strength[u]
                gain = lambda c, links=links, u=u: links.get(c, 0.0) - strength[u] * weight[c] / total
                best = max(sorted(links), key=gain, default=old)
                if gain(best) <= gain(old) + 1e-12:
                    best = old
                weight[best] += strength[u]
                if best != old:
                    home[u], moved, moved_any = best, True, True
        names = {c: k for k, c in enumerate(dict.fromkeys(home))}
        member = [names[home[m]] for m in member]
        if not moved_any:
            return member
        merged: list[dict[int, float]] = [{} for _ in names]
        for u, x in enumerate(near):
            a = names[home[u]]
            for v, w in x.items():
                b = names[home[v]]
                merged[a][b] = merged[a].get(b, 0.0) + w
        near = merged
