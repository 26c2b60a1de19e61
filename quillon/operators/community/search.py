"""Community search on one component in arrays: local moving, refinement, aggregation (Traag, Waltman and van Eck 2019)."""

from __future__ import annotations

import math
import random
from collections import deque

import numpy as np

Adjacency = list[dict[int, float]]


def number(labels: list[int]) -> list[int]:
    seen: dict[int, int] = {}
    return [seen.setdefault(x, len(seen)) for x in labels]


class Level:
    """A graph of nodes with sizes and strengths; adj has neighbours without loops."""

    def __init__(self, adj: Adjacency, loops: list[float], sizes: list[float]):
        self.adj, self.loops, self.sizes = adj, loops, sizes
        self.strength = [sum(a.values()) + 2 * w for a, w in zip(adj, loops, strict=True)]

    def __len__(self) -> int:
        return len(self.adj)


def move(g: Level, member: list[int], objective, two_m: float, rng: random.Random) -> list[int]:
    """Nodes from a queue go to the community of the largest gain, an empty one included; neighbours outside it queue."""
    n = len(g)
    k, size, count = [0.0] * n, [0.0] * n, [0] * n
    for u, c in enumerate(member):
        k[c] += g.strength[u]
        size[c] += g.sizes[u]
        count[c] += 1
    free = [c for c in range(n) if not count[c]]
    order = list(range(n))
    rng.shuffle(order)
    queue, waiting = deque(order), [True] * n
    while queue:
        u = queue.popleft()
        waiting[u] = False
        old, ku, su = member[u], g.strength[u], g.sizes[u]
        to: dict[int, float] = {}
        for v, w in g.adj[u].items():
            c = member[v]
            to[c] = to.get(c, 0.0) + w
        k[old] -= ku
        size[old] -= su
        count[old] -= 1
        if not count[old]:
            free.append(old)
        best, best_gain = old, objective.gain(to.get(old, 0.0), ku, su, k[old], size[old], two_m)
        for c, w in to.items():
            if c != old:
                gain = objective.gain(w, ku, su, k[c], size[c], two_m)
                if gain > best_gain + 1e-12:
                    best, best_gain = c, gain
        if best_gain < -1e-12 and count[old]:
            while count[free[-1]]:
                free.pop()
            best = free[-1]
        member[u] = best
        k[best] += ku
        size[best] += su
        count[best] += 1
        if best != old:
            for v in g.adj[u]:
                if member[v] != best and not waiting[v]:
                    waiting[v] = True
                    queue.append(v)
    return member


def refine(g: Level, outer: list[int], objective, two_m: float, rng: random.Random, randomness: float) -> list[int]:
    """Inside each community, nodes that are well connected to it join parts that are, at random with odds that rise with
    the gain; only nodes still alone move."""
    n = len(g)
    part = list(range(n))
    k, size, count = g.strength[:], g.sizes[:], [1] * n
    big_k, big_n = [0.0] * n, [0.0] * n
    members: dict[int, list[int]] = {}
    for u, c in enumerate(outer):
        big_k[c] += g.strength[u]
        big_n[c] += g.sizes[u]
        members.setdefault(c, []).append(u)
    cut = [sum(w for v, w in g.adj[u].items() if outer[v] == outer[u]) for u in range(n)]  # of a part to the rest
    for c, us in members.items():
        if len(us) < 2:
            continue
        rng.shuffle(us)
        for u in us:
            if count[part[u]] != 1 or part[u] != u:
                continue
            ku, su = g.strength[u], g.sizes[u]
            if cut[u] < objective.threshold(ku, su, big_k[c] - ku, big_n[c] - su, two_m) - 1e-12:
                continue
            to: dict[int, float] = {}
            for v, w in g.adj[u].items():
                if outer[v] == c and v != u:
                    to[part[v]] = to.get(part[v], 0.0) + w
            options, gains = [u], [0.0]
            for p, w in to.items():
                if p == u or cut[p] < objective.threshold(k[p], size[p], big_k[c] - k[p], big_n[c] - size[p], two_m) - 1e-12:
                    continue
                gain = objective.gain(w, ku, su, k[p], size[p], two_m)
                if gain >= 0:
                    options.append(p)
                    gains.append(gain)
            top = max(gains)
            if top <= 0 and len(options) == 1:
                continue
            if top > 0:
                odds = [math.exp((x - top) / (randomness * top)) for x in gains]
                pick = rng.choices(options, odds)[0]
            else:
                pick = rng.choice(options)
            if pick == u:
                continue
            cut[pick] += cut[u] - 2 * to[pick]
            part[u] = pick
            k[pick] += ku
            size[pick] += su
            count[pick] += 1
            count[u] = 0
    return part


def collapse(g: Level, part: list[int], outer: list[int]) -> tuple[Level, list[int]]:
    """The graph of parts, and the community of each."""
    n = max(part) + 1
    adj: Adjacency = [{} for _ in range(n)]
    loops, sizes, member = [0.0] * n, [0.0] * n, [0] * n
    for u, a in enumerate(g.adj):
        p = part[u]
        loops[p] += g.loops[u]
        sizes[p] += g.sizes[u]
        member[p] = outer[u]
        for v, w in a.items():
            q = part[v]
            if p == q:
                loops[p] += w / 2
            else:
                adj[p][q] = adj[p].get(q, 0.0) + w
    return Level(adj, loops, sizes), number(member)


def split(adj: Adjacency, member: list[int]) -> list[int]:
    """Communities that aren't connected, taken apart."""
    out = [-1] * len(member)
    n = 0
    for root in range(len(member)):
        if out[root] >= 0:
            continue
        out[root], work = n, [root]
        while work:
            u = work.pop()
            for v in adj[u]:
                if out[v] < 0 and member[v] == member[u]:
                    out[v] = n
                    work.append(v)
        n += 1
    return number(out)


def worth(g: Level, member: list[int], objective, two_m: float) -> float:
    """How much better than single nodes a membership is: the gains of its nodes, joined one after another."""
    k, size, total = [0.0] * len(g), [0.0] * len(g), 0.0
    for u, c in enumerate(member):
        if size[c]:
            total += objective.gain(sum(w for v, w in g.adj[u].items() if v < u and member[v] == c), g.strength[u], g.sizes[u], k[c], size[c], two_m)
        k[c] += g.strength[u]
        size[c] += g.sizes[u]
    return total


def leiden(
    order: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, objective, two_m: float, seed: int, randomness: float, max_iterations: int, iterations: int, initial: list[int] | None = None, starts: int = 1
) -> tuple[list[int], list[tuple[int, int, int, int]]]:
    """Membership from undirected edges, each once, the best after any pass of any start; and the last pass's trace of (level,
    nodes, communities, refined)."""
    adj: Adjacency = [{} for _ in range(order)]
    loops = [0.0] * order
    for u, v, w in zip(src.tolist(), dst.tolist(), weight.tolist(), strict=True):
        if u == v:
            loops[u] += w
        else:
            adj[u][v] = adj[u].get(v, 0.0) + w
            adj[v][u] = adj[v].get(u, 0.0) + w
    base = Level(adj, loops, [1.0] * order)
    top: tuple[float, list[int]] | None = None
    trace: list[tuple[int, int, int, int]] = []
    for start in range(starts):
        rng = random.Random(seed + 1_000_003 * start)
        held: list[int] | None = None if initial is None else number(initial)
        for _ in range(iterations):
            member = list(range(order)) if held is None else held[:]
            g, at, trace = base, list(range(order)), []
            for level in range(max_iterations):
                member = number(move(g, member, objective, two_m, rng))
                k = max(member) + 1 if member else 0
                if k == len(g):
                    break
                part = number(refine(g, member, objective, two_m, rng, randomness))
                parts = max(part) + 1
                trace.append((level, len(g), k, parts))
                if parts == len(g):  # refining merged nothing: whole communities become the next level's nodes
                    part = member
                g, member = collapse(g, part, member)
                at = [part[x] for x in at]
            new = split(adj, number([member[x] for x in at]))
            value = worth(base, new, objective, two_m)
            if top is None or value > top[0] + 1e-12:
                top = value, new
            if held is not None and new == held:
                break
            held = new
    return top[1] if top else [], trace


def propagate(order: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, seed: int, max_iterations: int) -> list[int]:
    """Asynchronous label propagation: each node takes the label of the largest weight around it, keeping its own among
    equals. Loops don't count."""
    adj: Adjacency = [{} for _ in range(order)]
    for u, v, w in zip(src.tolist(), dst.tolist(), weight.tolist(), strict=True):
        if u != v:
            adj[u][v] = adj[u].get(v, 0.0) + w
            adj[v][u] = adj[v].get(u, 0.0) + w
    rng, label, nodes = random.Random(seed), list(range(order)), [u for u in range(order) if adj[u]]
    for _ in range(max_iterations):
        rng.shuffle(nodes)
        changed = False
        for u in nodes:
            sums: dict[int, float] = {}
            for v, w in adj[u].items():
                sums[label[v]] = sums.get(label[v], 0.0) + w
            top = max(sums.values())
            heavy = sorted(x for x, w in sums.items() if w >= top - 1e-12 * abs(top))
            if label[u] not in heavy:
                label[u] = rng.choice(heavy)
                changed = True
        if not changed:
            break
    return number(label)
