"""Reference implementations in plain Python, for small graphs."""

from __future__ import annotations

from collections import deque
from itertools import combinations


def adjacency(edges):
    a = {}
    for u, v in edges:
        a.setdefault(u, set()).add(v)
        a.setdefault(v, set()).add(u)
    return a


def bfs(a, s):
    dist, q = {s: 0}, deque([s])
    while q:
        x = q.popleft()
        for y in a[x]:
            if y not in dist:
                dist[y] = dist[x] + 1
                q.append(y)
    return dist


def betweenness(a):
    out = dict.fromkeys(a, 0.0)
    for s in a:
        stack, pred, sigma, dist, q = [], {v: [] for v in a}, dict.fromkeys(a, 0.0), {s: 0}, deque([s])
        sigma[s] = 1.0
        while q:
            v = q.popleft()
            stack.append(v)
            for w in a[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    pred[w].append(v)
        delta = dict.fromkeys(a, 0.0)
        for w in reversed(stack):
            for v in pred[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                out[w] += delta[w]
    n = len(a)
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v, x in out.items()}


def closeness(a):
    n, out = len(a), {}
    for s in a:
        d = bfs(a, s)
        t = sum(d.values())
        out[s] = (len(d) - 1) / t * (len(d) - 1) / (n - 1) if t else 0.0
    return out


def cores(a):
    a = {v: set(x) for v, x in a.items()}
    core, k = {}, 0
    while a:
        low = [v for v in a if len(a[v]) <= k]
        if not low:
            k += 1
            continue
        for v in low:
            core[v] = k
            for w in a.pop(v):
                if w in a:
                    a[w].discard(v)
    return core


def triangles(a):
    return sum(1 for x, y, z in combinations(sorted(a), 3) if y in a[x] and z in a[x] and z in a[y])


def components(a):
    seen, out = set(), {}
    for s in sorted(a):
        if s not in seen:
            c = bfs(a, s)
            seen |= set(c)
            out |= {v: (s, len(c)) for v in c}
    return out
