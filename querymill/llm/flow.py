"""A small min-cost flow solver (successive shortest paths) and the allocation of bundles of sets to splits."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass
from heapq import heappop, heappush

from querymill.operators.ranking import largest_remainder

INF = 1 << 62


class FlowNetwork:
    """Integer capacities and costs >= 0 per unit."""

    def __init__(self) -> None:
        self.graph: list[list[int]] = []
        self.ends: list[list[int]] = []  # [to, capacity left, cost]

    def node(self) -> int:
        self.graph.append([])
        return len(self.graph) - 1

    def arc(self, a: int, b: int, capacity: int, cost: int = 0) -> int:
        self.graph[a].append(len(self.ends))
        self.ends.append([b, capacity, cost])
        self.graph[b].append(len(self.ends))
        self.ends.append([a, 0, -cost])
        return len(self.ends) - 2

    def flow(self, arc: int) -> int:
        return self.ends[arc ^ 1][1]

    def solve(self, source: int, sink: int) -> int:
        """Sends all it can, cheapest first; returns the cost. Primal-dual: shortest distances by Dijkstra's algorithm on
        reduced costs, then blocking flows over the arcs of reduced cost 0, for each different path cost once."""
        n, total = len(self.graph), 0
        price = [0] * n
        while True:
            dist = [INF] * n
            dist[source], heap = 0, [(0, source)]
            while heap:
                d, u = heappop(heap)
                if d > dist[u]:
                    continue
                for e in self.graph[u]:
                    v, cap, cost = self.ends[e]
                    if cap and d + cost + price[u] - price[v] < dist[v]:
                        dist[v] = d + cost + price[u] - price[v]
                        heappush(heap, (dist[v], v))
            if dist[sink] >= INF:
                return total
            far = max(d for d in dist if d < INF)
            price = [p + min(d, far) for p, d in zip(price, dist)]
            while amount := self._blocking(source, sink, price):
                total += amount * (price[sink] - price[source])

    def _blocking(self, source: int, sink: int, price: list[int]) -> int:
        """One blocking flow over the shortest paths (in arcs) of reduced cost 0; returns its amount."""
        tight = lambda u, e: self.ends[e][1] and self.ends[e][2] + price[u] == price[self.ends[e][0]]
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for e in self.graph[u]:
                v = self.ends[e][0]
                if v not in level and tight(u, e):
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return 0
        sent, tried, path = 0, dict.fromkeys(level, 0), []
        u = source
        while True:
            if u == sink:
                amount = min(self.ends[e][1] for e in path)
                for e in path:
                    self.ends[e][1] -= amount
                    self.ends[e ^ 1][1] += amount
                sent += amount
                cut = next(i for i, e in enumerate(path) if not self.ends[e][1])
                u = self.ends[path[cut] ^ 1][0]
                del path[cut:]
                continue
            arcs = self.graph[u]
            while tried[u] < len(arcs):
                e = arcs[tried[u]]
                if level.get(self.ends[e][0]) == level[u] + 1 and tight(u, e):
                    break
                tried[u] += 1
            if tried[u] < len(arcs):
                path.append(e)
                u = self.ends[e][0]
            elif path:
                u = self.ends[path.pop() ^ 1][0]
                tried[u] += 1
            else:
                return sent


@dataclass(frozen=True)
class Bundle:
    """count sets alike: rows of each label in one of them."""

    key: str
    count: int
    profile: dict[str, int]

    @property
    def size(self) -> int:
        return sum(self.profile.values())


def allocate(bundles: Sequence[Bundle], shares: Sequence[float], taken: dict[tuple[str, int], int] | None = None) -> dict[str, list[int]]:
    """Sets of each bundle for each split, so that rows of every label come near the shares. taken: rows that the splits
    already hold, by (label, split).

    The network, in rows: bundle and label -> label within split, up to its quota free and beyond it at a cost -> split, the
    same. A bundle sends whole sets up to its even share free, more at a small cost, so it spreads over the splits
    unless a quota asks otherwise; a set larger than a split's quota pays for the part that will not fit. The flow gives every
    bundle's sets per split. They are made whole from the largest set down, what rounding leaves being carried on to the
    next smaller sets.
    """
    k, deviation, taken = len(shares), 1000, taken or {}
    labels = sorted({f for b in bundles for f in b.profile} | {f for f, _ in taken})
    held = {f: [taken.get((f, j), 0) for j in range(k)] for f in labels}
    rows = {f: sum(b.count * b.profile.get(f, 0) for b in bundles) + sum(held[f]) for f in labels}
    whole = largest_remainder(list(shares), sum(rows.values()))
    quota = [max(0, q - sum(held[f][j] for f in labels)) for j, q in enumerate(whole)]
    net = FlowNetwork()
    source, sink = net.node(), net.node()
    split_nodes = [net.node() for _ in range(k)]
    for s, q in zip(split_nodes, quota):
        net.arc(s, sink, q)
        net.arc(s, sink, INF, deviation)
    cells = {}
    for f in labels:
        for j, q in enumerate(largest_remainder(list(shares), rows[f])):
            cells[f, j] = net.node()
            net.arc(cells[f, j], split_nodes[j], max(0, q - held[f][j]))
            net.arc(cells[f, j], split_nodes[j], INF, deviation)
    arcs: dict[tuple[str, str, int], list[int]] = {}
    for b in bundles:
        for f, n in b.profile.items():
            node = net.node()
            net.arc(source, node, n * b.count)
            for j in range(k):
                dear = deviation * max(0, b.size - whole[j]) // max(1, b.size) * 2
                even = int(shares[j] * b.count)
                arcs[b.key, f, j] = [net.arc(node, cells[f, j], even * n, dear), net.arc(node, cells[f, j], n, 1 + dear), net.arc(node, cells[f, j], INF, 3 + dear)]
    net.solve(source, sink)
    carry = dict.fromkeys(cells, 0)
    out: dict[str, list[int]] = {}
    for b in sorted(bundles, key=lambda b: (-b.size, b.key)):
        sent = {(f, j): sum(net.flow(e) for e in arcs[b.key, f, j]) for f in b.profile for j in range(k)}
        want = [max(0.0, sum(sent[f, j] + carry[f, j] for f in b.profile) / b.size) for j in range(k)]
        take = largest_remainder(want if sum(want) > 0 else list(shares), b.count)
        for f, n in b.profile.items():
            for j in range(k):
                carry[f, j] += sent[f, j] - take[j] * n
        out[b.key] = take
    return out
