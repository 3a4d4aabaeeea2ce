"""Minimum-cost flow by successive shortest paths, for graphs that are small whatever the corpus holds."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field


@dataclass
class Network:
    """Arcs are kept in pairs: arc i ^ 1 takes back what arc i carries."""

    n: int
    to: list[int] = field(default_factory=list)
    room: list[int] = field(default_factory=list)
    cost: list[float] = field(default_factory=list)

    def __post_init__(self):
        self.arcs: list[list[int]] = [[] for _ in range(self.n)]

    def add(self, a: int, b: int, room: int, cost: float) -> int:
        arc = len(self.to)
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return arc

    def flow(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def _shortest(self, source: int, sink: int) -> list[int] | None:
        best, via = {source: 0.0}, {}
        queue, queued = deque([source]), {source}
        while queue:
            x = queue.popleft()
            queued.discard(x)
            for arc in self.arcs[x]:
                y = self.to[arc]
                if self.room[arc] > 0 and best[x] + self.cost[arc] < best.get(y, float("inf")) - 1e-9:
                    best[y], via[y] = best[x] + self.cost[arc], arc
                    if y not in queued:
                        queue.append(y)
                        queued.add(y)
        if sink not in via:
            return None
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = self.to[via[x] ^ 1]
        return path

    def solve(self, source: int, sink: int) -> int:
        """Send as much as fits from source to sink at the least cost; returns how much that is."""
        sent = 0
        while path := self._shortest(source, sink):
            most = min(self.room[a] for a in path)
            for a in path:
                self.room[a] -= most
                self.room[a ^ 1] += most
            sent += most
        return sent
