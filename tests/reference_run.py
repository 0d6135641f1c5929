"""The method in plain Python over dictionaries, written from its formulas, to hold both engines against."""

from __future__ import annotations

import math


class Plain:
    def __init__(self, pairs):
        self.edges = sorted({(max(p), min(p)) for p in pairs if p[0] != p[1]})
        self.ids = sorted({x for p in pairs for x in p})
        self.near = {x: set() for x in self.ids}
        for u, v in self.edges:
            self.near[u].add(v)
            self.near[v].add(u)

    def jaccard(self):
        closed = {x: n | {x} for x, n in self.near.items()}
        return {(u, v): 1 - len(closed[u] & closed[v]) / len(closed[u] | closed[v]) for u, v in self.edges}

    def parts(self, d, lam, counted=None):
        """{edge: (di, ci, ei)} of active edges."""
        at = lambda x, y: d[max(x, y), min(x, y)]
        k = {x: len(n) for x, n in self.near.items()}
        total = {x: math.fsum(1 - at(x, y) for y in n if counted is None or counted[max(x, y), min(x, y)]) for x, n in self.near.items()}

        def rho(a, b):
            theta = math.fsum(2 - at(a, c) - at(b, c) for c in self.near[a] & self.near[b]) / (total[a] + total[b])
            return theta if theta >= lam - 1e-12 else theta - lam

        out = {}
        for u, v in self.edges:
            if not 0 < d[u, v] < 1:
                continue
            di = -math.sin(1 - d[u, v]) * (1 / k[u] + 1 / k[v])
            ci = -math.fsum((1 - at(v, c)) * math.sin(1 - at(u, c)) / k[u] + (1 - at(u, c)) * math.sin(1 - at(v, c)) / k[v] for c in self.near[u] & self.near[v])
            ei = -math.fsum(rho(x, v) * math.sin(1 - at(x, u)) / k[u] for x in self.near[u] - self.near[v] - {v})
            ei -= math.fsum(rho(y, u) * math.sin(1 - at(y, v)) / k[v] for y in self.near[v] - self.near[u] - {u})
            out[u, v] = (di, ci, ei)
        return out

    def run(self, lam, window, tau, gamma, single, max_iter=200):
        """Final distances."""
        d, step, live = self.jaccard(), 0, None
        ring = {e: [0] * max(0, window) for e in self.edges}
        while not single and step < max_iter:
            parts = self.parts(d, lam)
            new = {}
            for e in self.edges:
                if e not in parts:
                    new[e], ring[e] = d[e], [0] * max(0, window)
                    continue
                delta = sum(parts[e])
                if window > 0:
                    ring[e] = list(ring[e])
                    bit = ring[e][step % window] = int(delta >= 0)
                    if step >= window - 1 and sum(ring[e]) > tau * window:
                        delta = 2 if bit else -2
                new[e] = min(1.0, max(0.0, d[e] + delta))
            d = new
            live = sum(0 < x < 1 for x in d.values())
            if live == 0 or live < gamma:
                break
            step += 1
        if not (single or live < gamma):
            return d
        if step == 0:
            ring = {e: [0] * max(0, window) for e in self.edges}
        slots, counted, count = [dict(d), dict.fromkeys(d, 0.0)], dict.fromkeys(d, True), dict.fromkeys(d, step)
        for _ in range(max_iter):
            now, then = slots
            parts, moved, inside = self.parts(now, lam, counted), False, {}
            for e in self.edges:
                inside[e] = True
                if e not in parts:
                    then[e] = now[e]
                    continue
                delta = sum(parts[e])
                if abs(delta) <= 1e-7:
                    inside[e] = False
                    continue
                if window > 0:
                    ring[e][count[e] % window] = int(delta >= 0)
                    if count[e] >= window - 1:
                        delta = 2 if ring[e][count[e] % window] else -2
                    count[e] += 1
                x = now[e] + delta
                then[e] = 1.0 if x > 1 - 1e-7 else 0.0 if x < 1e-7 else x
                moved = True
            slots, counted = [then, now], inside
            if not moved:
                break
        return slots[0]

    def communities(self, d):
        """{vertex: number}, numbered by the smallest vertex."""
        number, n = {}, 0
        for x in self.ids:
            if x in number:
                continue
            n += 1
            todo = [x]
            while todo:
                y = todo.pop()
                if y not in number:
                    number[y] = n
                    todo += [z for z in self.near[y] if d[max(y, z), min(y, z)] < 1]
        return number
