"""Straightforward answers for small graphs, to check the distributed ones."""

from __future__ import annotations

from collections import defaultdict, deque
from itertools import combinations


def neighbours(edges):
    out = defaultdict(set)
    for a, b, *_ in edges:
        out[a].add(b)
        out[b].add(a)
    return out


def hops_from(adj, start, limit=None):
    dist = {start: 0}
    queue = deque([start])
    while queue:
        v = queue.popleft()
        if limit is not None and dist[v] == limit:
            continue
        for w in adj[v]:
            if w not in dist:
                dist[w] = dist[v] + 1
                queue.append(w)
    return dist


def khop_degrees(edges, hops):
    adj = neighbours(edges)
    counts = {v: len(hops_from(adj, v, hops)) - 1 for v in adj}
    return {v: n for v, n in counts.items() if n}


def khop_pairs(edges, hops):
    """Pairs joined by a walk of 1 to ``hops`` steps."""
    adj = neighbours(edges)
    pairs = set()
    for v in adj:
        last, seen = {v}, set()
        for _ in range(hops):
            last = {w for x in last for w in adj[x]}
            seen |= last
        pairs |= {(v, w) for w in seen}
    return pairs


def top(adj, n, keep=lambda v: True):
    return sorted((v for v in adj if keep(v)), key=lambda v: (-len(adj[v]), v))[:n]


def core(edges, k):
    adj = {v: set(ws) for v, ws in neighbours(edges).items()}
    while True:
        low = [v for v, ws in adj.items() if len(ws) < k]
        if not low:
            return adj
        for v in low:
            for w in adj.pop(v):
                if w in adj:
                    adj[w].discard(v)


def triangles(edges):
    adj = {v: ws - {v} for v, ws in neighbours(edges).items()}
    return {v: sum(b in adj[a] for a, b in combinations(sorted(ws), 2)) for v, ws in adj.items()}


def page_rank(edges, iterations):
    ids = {v for a, b, *_ in edges for v in (a, b)}
    out = defaultdict(int)
    for a, *_ in edges:
        out[a] += 1
    rank = dict.fromkeys(ids, 1.0)
    for _ in range(iterations):
        income = defaultdict(float)
        for a, b, *_ in edges:
            income[b] += rank[a] / out[a]
        rank = {v: 0.15 + 0.85 * income[v] for v in ids}
    scale = len(ids) / sum(rank.values())
    return {v: r * scale for v, r in rank.items()}


def egos(edges, n):
    adj = defaultdict(set)
    for a, b, score, *_ in edges:
        adj[a].add((b, score))
        adj[b].add((a, score))
    out = {}
    for hub in top(adj, n):
        inside = {hub} | {w for w, _ in adj[hub]}
        scores = [s for v in inside for w, s in adj[v] if w in inside]
        out[hub] = (len(inside), len(scores), sum(scores) / len(scores), min(scores), max(scores))
    return out
