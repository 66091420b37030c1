"""Min-cost flow on small graphs (shards, or source patterns): successive
shortest paths with integer capacities. Sizes come from Spark aggregates; the
graph has one node per shard, pattern or source, never one per row."""

from __future__ import annotations

from collections import deque


class Network:
    def __init__(self):
        self.adj: dict = {}
        self.edges: list[list] = []   # [to, residual capacity, cost]

    def add(self, u, v, capacity: int, cost: int = 0) -> int:
        """Add an arc and its reverse; returns the arc's number."""
        k = len(self.edges)
        self.edges += [[v, int(capacity), cost], [u, 0, -cost]]
        self.adj.setdefault(u, []).append(k)
        self.adj.setdefault(v, []).append(k + 1)
        return k

    def flow_on(self, k: int) -> int:
        return self.edges[k ^ 1][1]

    def solve(self, s, t) -> tuple[int, int]:
        """Largest flow from s to t of least cost: (flow, cost)."""
        total = cost = 0
        while s in self.adj and t in self.adj:
            dist, via, queue, queued = {s: 0}, {}, deque([s]), {s}
            while queue:
                u = queue.popleft()
                queued.discard(u)
                for k in self.adj[u]:
                    v, cap, c = self.edges[k]
                    if cap > 0 and dist[u] + c < dist.get(v, float("inf")):
                        dist[v], via[v] = dist[u] + c, k
                        if v not in queued:
                            queued.add(v)
                            queue.append(v)
            if t not in via:
                break
            path, v = [], t
            while v != s:
                path.append(via[v])
                v = self.edges[via[v] ^ 1][0]
            push = min(self.edges[k][1] for k in path)
            for k in path:
                self.edges[k][1] -= push
                self.edges[k ^ 1][1] += push
            total += push
            cost += push * dist[t]
        return total, cost
