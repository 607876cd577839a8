"""Minimum-cost flow on a small integer network (source quotas, not documents)."""

from __future__ import annotations

import heapq


class Network:
    """Directed arcs with capacities and costs of at least 0; primal-dual with blocking flows."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int = 0) -> int:
        e = len(self.to)
        self.to += [b, a]
        self.room += [room, 0]
        self.cost += [cost, -cost]
        self.out[a].append(e)
        self.out[b].append(e + 1)
        return e

    def flow(self, e: int) -> int:
        return self.room[e ^ 1]

    def solve(self, s: int, t: int) -> int:
        """Send as much as fits from s to t at least cost; the amount sent."""
        sent, price = 0, [0] * len(self.out)
        while True:
            far = [None] * len(self.out)
            far[s], heap = 0, [(0, s)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for e in self.out[a]:
                    if self.room[e] > 0:
                        b = self.to[e]
                        nd = d + self.cost[e] + price[a] - price[b]
                        if far[b] is None or nd < far[b]:
                            far[b] = nd
                            heapq.heappush(heap, (nd, b))
            if far[t] is None:
                return sent
            price = [p + (far[t] if d is None else min(d, far[t]))
                     for p, d in zip(price, far, strict=True)]
            sent += self._fill(s, t, price)

    def _level(self, s: int, t: int, price: list[int]) -> list[int]:
        level = [-1] * len(self.out)
        level[s], queue = 0, [s]
        for a in queue:
            for e in self.out[a]:
                b = self.to[e]
                if self.room[e] > 0 and level[b] < 0 and not self.cost[e] + price[a] - price[b]:
                    level[b] = level[a] + 1
                    queue.append(b)
        return level

    def _fill(self, s: int, t: int, price: list[int]) -> int:
        """Maximum flow over the arcs of reduced cost 0."""
        total = 0
        while (level := self._level(s, t, price))[t] >= 0:
            nxt, path, a = [0] * len(self.out), [], s
            while True:
                if a == t:
                    send = min(self.room[e] for e in path)
                    total += send
                    for e in path:
                        self.room[e] -= send
                        self.room[e ^ 1] += send
                    k = next(i for i, e in enumerate(path) if not self.room[e])
                    a = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                step = None
                while nxt[a] < len(self.out[a]):
                    e = self.out[a][nxt[a]]
                    b = self.to[e]
                    if (self.room[e] > 0 and level[b] == level[a] + 1
                            and not self.cost[e] + price[a] - price[b]):
                        step = e
                        break
                    nxt[a] += 1
                if step is not None:
                    path.append(step)
                    a = self.to[step]
                elif path:
                    a = self.to[path.pop() ^ 1]
                    nxt[a] += 1
                else:
                    break
        return total
