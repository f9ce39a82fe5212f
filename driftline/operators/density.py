"""Clustering of one bounded set of vectors: density hierarchy, average linkage, spectral.

These run inside grouped pandas functions, a group being one stream's points; their
distance matrix takes 8 n**2 bytes, so MOST bounds n.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MOST = 20_000


def distances(x: np.ndarray, metric: str) -> np.ndarray:
    if len(x) > MOST:
        raise ValueError(f"{len(x)} points; a group has {MOST} at most")
    x = x.astype(float)
    c = 1 - np.clip(x @ x.T, -1, 1)
    d = c if metric == "cosine" else np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T))
    np.fill_diagonal(d, 0)
    return d


def spanning_tree(d: np.ndarray, k: int) -> np.ndarray:
    """Rows (a, b, w), rising, of a minimum spanning tree under mutual reachability with the k-th other point."""
    n = len(d)
    core = np.partition(d, min(k, n - 1), axis=1)[:, min(k, n - 1)]
    near, link, at, out = np.full(n, np.inf), np.zeros(n, int), 0, []
    ahead = core.copy()  # infinite where a point is in the tree
    for _ in range(n - 1):
        ahead[at] = near[at] = np.inf
        w = np.maximum(d[at], ahead)
        np.maximum(w, core[at], out=w)
        link[w < near] = at
        np.minimum(near, w, out=near)
        nxt = int(near.argmin())
        out.append((link[nxt], nxt, near[nxt]))
        at = nxt
    edges = np.array(out).reshape(-1, 3)
    return edges[np.argsort(edges[:, 2], kind="stable")]


def extract(edges: np.ndarray, n: int, least: int) -> np.ndarray:
    """Labels by excess of mass over the condensed tree of a spanning tree; the root is no cluster."""
    root = list(range(2 * n - 1))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kids, dist, size = {}, {}, [1] * n + [0] * (n - 1)
    for k, (a, b, w) in enumerate(edges):
        a, b, node = find(int(a)), find(int(b)), n + k
        root[a] = root[b] = node
        kids[node], dist[node], size[node] = (a, b), w, size[a] + size[b]

    def leaves(node):
        stack, out = [node], []
        while stack:
            x = stack.pop()
            stack.extend(kids[x]) if x in kids else out.append(x)
        return out

    birth, parent, mass, points = [0.0], [-1], [0.0], [[]]
    stack = [(2 * n - 2, 0)]
    while stack:
        node, c = stack.pop()
        lam = 1 / max(dist[node], 1e-12) if node in kids else np.inf
        if node not in kids:
            continue
        big = [x for x in kids[node] if size[x] >= least]
        if len(big) == 2:
            mass[c] += size[node] * (lam - birth[c])
            for x in big:
                birth.append(lam), parent.append(c), mass.append(0.0), points.append([])
                stack.append((x, len(birth) - 1))
            continue
        for x in kids[node]:
            if x not in big:
                fell = leaves(x)
                points[c] += fell
                mass[c] += len(fell) * (lam - birth[c])
        for x in big:
            if x in kids:
                stack.append((x, c))
            else:
                points[c].append(x)
    m = len(birth)
    below, chosen = [0.0] * m, [False] * m
    for c in range(m - 1, 0, -1):
        chosen[c] = mass[c] >= below[c]
        below[parent[c]] += max(mass[c], below[c])
    labels, names = np.full(n, -1), {}
    owner = [-1] * m
    for c in range(1, m):
        up = owner[parent[c]]
        owner[c] = up if up >= 0 else (c if chosen[c] else -1)
        if owner[c] >= 0:
            labels[points[c]] = names.setdefault(owner[c], len(names))
    return labels


def density(x: np.ndarray, least: int = 4, k: int = 2, metric: str = "euclidean") -> np.ndarray:
    if len(x) < max(2, least):
        return np.full(len(x), -1)
    return extract(spanning_tree(distances(x, metric), k), len(x), least)


def average_linkage(x: np.ndarray, threshold: float | None = 0.70, clusters: int = 1) -> np.ndarray:
    """Average linkage on cosine distance, cut at a distance or at a number of clusters."""
    n = len(x)
    d = distances(x, "cosine")
    np.fill_diagonal(d, np.inf)
    size, into, alive = [1.0] * n, list(range(n)), n
    # bounds of each row's least distance from below, and the first column that had it: a merge brings no cluster nearer but by
    # rounding, so a row is searched again only when its bound is the least of all and no longer its distance
    near = d.argmin(1) if n else np.zeros(0, int)
    low = d[np.arange(n), near]
    while alive > clusters:
        i = int(low.argmin())
        j = int(near[i])
        if d[i, j] != low[i]:
            near[i] = j = int(d[i].argmin())
            low[i] = d[i, j]
            continue
        if threshold is not None and low[i] >= threshold:
            break
        i, j = min(i, j), max(i, j)
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        row[i] = row[j] = np.inf
        d[i] = d[:, i] = row
        d[j] = d[:, j] = np.inf
        low[j] = np.inf
        size[i] += size[j]
        into[j] = i
        alive -= 1
        closer = row <= low
        closer[i] = closer[j] = False
        if closer.any():
            near[closer], low[closer] = np.minimum(near[closer], i), row[closer]
    label = np.arange(n)
    for j in range(n):
        label[j] = label[into[j]]
    return np.unique(label, return_inverse=True)[1]


def spectral(x: np.ndarray, share: float = 0.20, most: int = 8, seed: int = 0) -> np.ndarray:
    """Pruned-affinity spectral clustering with the largest eigengap, k-means on the leading vectors."""
    n = len(x)
    if n < 3:
        return np.full(n, -1)
    a = np.clip((2 - distances(x, "cosine")) / 2, 0, 1)
    np.fill_diagonal(a, 0)
    keep = max(1, int(np.ceil(share * (n - 1))))
    cut = np.zeros_like(a)
    rows = np.arange(n)[:, None]
    top = np.argsort(-a, axis=1, kind="stable")[:, :keep]
    cut[rows, top] = a[rows, top]
    a = np.maximum(cut, cut.T)
    s = 1 / np.sqrt(np.maximum(a.sum(1), 1e-12))
    value, vector = np.linalg.eigh(np.eye(n) - s[:, None] * a * s)
    most = min(most, n - 1)
    k = int(np.clip(np.diff(value[: most + 1]).argmax() + 1, 2, most))
    return kmeans(vector[:, :k] * s[:, None], k, seed)


def kmeans(x: np.ndarray, k: int, seed: int, starts: int = 10) -> np.ndarray:
    rng, best, out = np.random.default_rng(seed), np.inf, np.zeros(len(x), int)
    for _ in range(starts):
        c = x[[rng.integers(len(x))]]
        while len(c) < k:
            d = ((x[:, None] - c) ** 2).sum(2).min(1)
            c = np.vstack((c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]))
        for _ in range(100):
            of = ((x[:, None] - c) ** 2).sum(2).argmin(1)
            new = np.array([x[of == i].mean(0) if (of == i).any() else c[i] for i in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = ((x - c[of]) ** 2).sum()
        if cost < best:
            best, out = cost, of
    return out


BACKENDS = {"hdbscan": density, "fast_hdbscan": density, "fishdbc": lambda x, least=4, k=2: density(x, least, k, "cosine"), "ahc": lambda x, least=4, k=2: average_linkage(x), "sc_pna": lambda x, least=4, k=2: spectral(x)}


def cluster(x: np.ndarray, backend: str, least: int = 4, k: int = 2) -> np.ndarray:
    """Labels by a backend; all noise below max(2, least) points."""
    return np.full(len(x), -1) if len(x) < max(2, least) else BACKENDS[backend](x, least, k)


def cluster_streams(points: DataFrame, backend: str, least: int = 4, k: int = 2) -> DataFrame:
    """stream_id, seq, label, pred: each stream's points clustered in one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        return pd.DataFrame({"stream_id": pdf["stream_id"], "seq": pdf["seq"], "label": pdf["label"], "pred": cluster(np.stack(pdf["embedding"].to_list()), backend, least, k)})

    return points.select("stream_id", "seq", "embedding", "label").groupBy("stream_id").applyInPandas(run, "stream_id string, seq long, label long, pred long")
