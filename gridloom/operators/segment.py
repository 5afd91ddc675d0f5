"""Segmentation of one image's feature grid: kernels in numpy, applied to each image by itself.

Every kernel takes an image's nodes in the order of their ids (feat: n x c, y, x) and gives a label for each. Algorithms
that grow, merge or cut step by step are sequential within an image; images are independent and spread over tasks.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.suppress import bucketed, in_groups
from gridloom.sources.storage import materialized

EXTRACTORS: dict[str, Callable] = {}


def register_extractor(name: str):
    """Decorator: (feat, y, x, **options) -> labels becomes available to ``segment`` as ``name``."""

    def add(f):
        EXTRACTORS[name] = f
        return f

    return add


def segment(grid: DataFrame, extractor: str | Callable, **options) -> DataFrame:
    """(image, node, label) by an extractor, for each image."""
    f = EXTRACTORS[extractor] if isinstance(extractor, str) else extractor

    def many(t: pa.Table) -> pa.Table:
        t, starts = in_groups(t, ["image"], [("node", True)])
        y, x = t.column("y").to_numpy(), t.column("x").to_numpy()
        labels = []
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            feat = np.array(t.column("feat").slice(i, j - i).to_pylist(), np.float64)
            labels.append(np.asarray(f(feat, y[i:j], x[i:j], **options), np.int64))
        return t.select(["image", "node"]).append_column("label", pa.array(np.concatenate(labels)))

    rows = bucketed(grid.select(F.col("image").cast("long").alias("image"), F.col("node").cast("long").alias("node"), "y", "x", "feat"), "image")
    return rows.groupBy("_bucket").applyInArrow(many, "image long, node long, label long")


def linked_labels(links: DataFrame) -> DataFrame:
    """(image, label, least): the least label that each label of an image is connected to by links (image, a, b)."""

    def many(t: pa.Table) -> pa.Table:
        t, starts = in_groups(t, ["image"], [("a", True)])
        a, b, out = t.column("a").to_numpy(), t.column("b").to_numpy(), []
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            names, at = np.unique(np.concatenate([a[i:j], b[i:j]]), return_inverse=True)
            least = components(len(names), at.reshape(2, -1).T)
            out.append(pa.table({"image": t.column("image").slice(i, 1).take(pa.array(np.zeros(len(names), np.int64))), "label": names, "least": names[least]}))
        return pa.concat_tables(out)

    long = lambda c: F.col(c).cast("long").alias(c)
    return bucketed(links.select(long("image"), long("a"), long("b")), "image").groupBy("_bucket").applyInArrow(many, "image long, label long, least long")


def cut_levels(grid: DataFrame, cuts: list[float], min_size: int = 2) -> DataFrame:
    """(image, cut, node, label, masks, dropped): the cut graph at several radii, with how many labels each has and how many cells belong to none."""
    levels = [segment(grid, "cut_graph", cut=c, min_size=min_size).withColumn("cut", F.lit(c)) for c in cuts]
    rows = functools.reduce(DataFrame.unionByName, levels)
    facts = rows.groupBy("image", "cut").agg(F.max("label").alias("masks"), F.count(F.when(F.col("label") == 0, 1)).alias("dropped"))
    return rows.join(facts, ["image", "cut"]).select("image", "cut", "node", "label", "masks", "dropped")


class Forest:
    """Disjoint sets with path halving; the smaller set joins the larger."""

    def __init__(self, n: int):
        self.parent, self.size = list(range(n)), [1] * n

    def find(self, a: int) -> int:
        p = self.parent
        while p[a] != a:
            p[a] = a = p[p[a]]
        return a

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            if self.size[a] < self.size[b]:
                a, b = b, a
            self.parent[b] = a
            self.size[a] += self.size[b]


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-8)


def edges_of(y: np.ndarray, x: np.ndarray, connectivity: int = 4) -> np.ndarray:
    """Pairs of neighbouring nodes (i < j by place), in the order of the first."""
    at = {(int(a), int(b)): i for i, (a, b) in enumerate(zip(y, x, strict=True))}
    moves = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    out = [(i, at[a + dy, b + dx]) for (a, b), i in at.items() for dy, dx in moves if (a + dy, b + dx) in at]
    return np.array(out, np.int64).reshape(-1, 2)


def neighbours_of(edges: np.ndarray, n: int) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b in edges.tolist():
        out[a].append(b)
        out[b].append(a)
    return out


def components(n: int, edges: np.ndarray) -> np.ndarray:
    """Least node of each node's component."""
    f = Forest(n)
    for a, b in edges.tolist():
        f.union(a, b)
    roots = np.array([f.find(i) for i in range(n)])
    least = np.full(n, n)
    np.minimum.at(least, roots, np.arange(n))
    return least[roots]


def by_size(labels: np.ndarray, min_size: int = 0) -> np.ndarray:
    """Renumbered by falling size, first seen first: from 1 with 0 for small ones, or from 0 where min_size is 0. Labels under 0 become 0 or stay apart."""
    out = np.zeros(len(labels), np.int64)
    names, first, n = np.unique(labels, return_index=True, return_counts=True)
    order = sorted((k for k in range(len(names)) if names[k] >= 0 and n[k] >= min_size), key=lambda k: (-n[k], first[k]))
    for new, k in enumerate(order, 1 if min_size else 0):
        out[labels == names[k]] = new
    return out


def _cosines(feat: np.ndarray, edges: np.ndarray) -> np.ndarray:
    u = unit(feat)
    return np.round((u[edges[:, 0]] * u[edges[:, 1]]).sum(1), 9) if len(edges) else np.zeros(0)


@register_extractor("greedy_graph")
def greedy_graph(feat, y, x, q: float | None = 0.6, threshold: float | None = None, connectivity: int = 4, min_size: int = 0) -> np.ndarray:
    """Components of the neighbour edges whose cosine is at least the threshold, given or a quantile."""
    e = edges_of(y, x, connectivity)
    s = _cosines(feat, e)
    t = threshold if threshold is not None else (round(float(np.quantile(s, q)), 9) if len(s) else 0.0)
    return by_size(components(len(feat), e[s >= t]), min_size)


@register_extractor("cut_graph")
def cut_graph(feat, y, x, cut: float = 0.95, min_size: int = 0) -> np.ndarray:
    """Components of the neighbour edges whose cosine distance is at most the cut; the grid does not wrap."""
    e = edges_of(y, x)
    return by_size(components(len(feat), e[1 - _cosines(feat, e) <= cut]), min_size)


def grow(seed: np.ndarray, value: np.ndarray, blocked: np.ndarray, near: list[list[int]], delta: float) -> np.ndarray:
    """Region growing: whole frontiers at a time, cells whose value drops by at most ``delta`` from their best neighbour inside."""
    inside = seed.copy()
    while True:
        frontier = {j for i in np.flatnonzero(inside) for j in near[i] if not inside[j] and not blocked[j]}
        new = [j for j in frontier if max(value[i] for i in near[j] if inside[i]) - value[j] <= delta]
        if not new:
            return inside
        inside[new] = True


def stretched(v: np.ndarray) -> np.ndarray:
    lo, hi = np.quantile(v, [0.02, 0.98])
    return np.clip((v - lo) / (hi - lo + 1e-8), 0, 1)


@register_extractor("frontier_grow")
def frontier_grow(feat, y, x, q: float = 0.8, delta: float = 0.1, min_size: int = 2) -> np.ndarray:
    """Seeds from tight components, larger first; each grows over its map of similarity to its mean, and cells go to who comes first."""
    e, n, u = edges_of(y, x), len(feat), unit(feat)
    near, seeds = neighbours_of(e, n), greedy_graph(feat, y, x, q=q, min_size=min_size)
    labels, owned = np.zeros(n, np.int64), np.zeros(n, bool)
    for k in range(1, seeds.max(initial=0) + 1):
        seed = (seeds == k) & ~owned
        if seed.any():
            got = grow(seed, stretched(u @ unit(feat[seed].mean(0))), owned, near, delta)
            labels[got] = k
            owned |= got
    return labels


@register_extractor("sequential_grow")
def sequential_grow(feat, y, x, q: float = 0.8, delta: float = 0.1, min_size: int = 2, min_consistency: float = 0.0, most: int = 50) -> np.ndarray:
    """Repeatedly the most consistent candidate among free cells grows and is taken out; consistency first, then size."""
    n, u = len(feat), unit(feat)
    e = edges_of(y, x)
    s, near = _cosines(feat, e), neighbours_of(e, n)
    labels = np.zeros(n, np.int64)
    for k in range(1, most + 1):
        free = labels == 0
        inner = free[e].all(1)
        if not inner.any():
            break
        part = components(n, e[inner & (s >= np.quantile(s[inner], q))])
        found = []
        for c in np.unique(part[free]):
            m = free & (part == c)
            if m.sum() >= min_size:
                p = unit(feat[m].mean(0))
                found.append((round(float((u[m] @ p).mean()), 9), int(m.sum()), -int(c)))
        found = [f for f in found if f[0] >= min_consistency]
        if not found:
            break
        c = -max(found)[2]
        m = free & (part == c)
        labels[grow(m, stretched(u @ unit(feat[m].mean(0))), ~free, near, delta)] = k
    return labels


def distribute(feat: np.ndarray, labels: np.ndarray, y: np.ndarray, x: np.ndarray, least: float = -2.0) -> np.ndarray:
    """Free cells (label 0) go, best first, to the touching label whose prototype they resemble most; ties by row, column, label.

    Every cell's likeness to every label is known from the start, so all claims are ranked once; what is open is a queue
    of ranks.
    """
    names = np.unique(labels[labels > 0])
    if not len(names):
        return labels.copy()
    near, k = neighbours_of(edges_of(y, x), len(feat)), len(names)
    score = np.round(unit(feat) @ unit(np.stack([feat[labels == n].mean(0) for n in names])).T, 9).ravel()
    cell, of = np.divmod(np.arange(len(score)), k)
    claims = np.lexsort((of, x[cell], y[cell], -score))
    rank = np.empty(len(claims), np.int64)
    rank[claims] = np.arange(len(claims))
    owner = np.where(labels > 0, np.searchsorted(names, labels), -1)

    def opened(i: int) -> list[int]:
        return [int(rank[c]) for j in near[i] if owner[j] < 0 and score[c := j * k + owner[i]] >= least]

    queue = [r for i in np.flatnonzero(owner >= 0).tolist() for r in opened(i)]
    heapq.heapify(queue)
    while queue:
        j, n = divmod(int(claims[heapq.heappop(queue)]), k)
        if owner[j] < 0:
            owner[j] = n
            for r in opened(j):
                heapq.heappush(queue, r)
    return np.where(owner >= 0, names[owner], 0)


def merge_similar(feat: np.ndarray, labels: np.ndarray, threshold: float, pairs: set[tuple[int, int]] | None = None) -> np.ndarray:
    """Labels over 0 whose prototypes' cosine is at least the threshold become one (the least), of all pairs or of the given ones, transitively."""
    names, at = np.unique(labels, return_inverse=True)
    real = names > 0
    if not real.any():
        return labels
    proto = unit(np.stack([feat[labels == k].mean(0) for k in names[real]]))
    alike = np.argwhere(np.triu(np.round(proto @ proto.T, 9) >= threshold, 1)) + np.flatnonzero(real)[0]
    if pairs is not None:
        alike = np.array([p for p in alike.tolist() if (int(names[p[0]]), int(names[p[1]])) in pairs], np.int64).reshape(-1, 2)
    return names[components(len(names), alike)][at]


@register_extractor("grow_and_merge")
def grow_and_merge(feat, y, x, q: float = 0.8, delta: float = 0.1, merge: float | None = None, merge_q: float = 0.9) -> np.ndarray:
    """Grown regions, then those whose prototypes are alike merged: by a threshold, given or a quantile of all candidates' similarities (none: no merge)."""
    labels = frontier_grow(feat, y, x, q=q, delta=delta)
    names = np.unique(labels[labels > 0])
    if merge is None:
        proto = unit(np.stack([feat[labels == k].mean(0) for k in names])) if len(names) else np.zeros((0, feat.shape[1]))
        found = (proto @ proto.T)[np.triu_indices(len(names), 1)]
        merge = round(float(np.quantile(found, merge_q)), 9) if len(found) else np.inf
    return merge_similar(feat, labels, merge)


def touching_pairs(labels: np.ndarray, y: np.ndarray, x: np.ndarray) -> set[tuple[int, int]]:
    e = edges_of(y, x)
    return {(int(min(p)), int(max(p))) for p in labels[e].tolist() if p[0] != p[1]}


@register_extractor("multistage")
def multistage(feat, y, x, q: float = 0.7, min_size: int = 2, min_consistency: float = 0.2, merge: float = 0.5, adjacent: bool = False, region: np.ndarray | None = None) -> np.ndarray:
    """Cut, drop inconsistent pieces, distribute free cells best first, merge alike prototypes (or only touching ones).

    With a ``region`` (a truth value for each cell) all this happens within it: the quantile is that of its own edges, and
    cells outside keep label 0.
    """
    if region is not None:
        out, at = np.zeros(len(feat), np.int64), np.flatnonzero(region)
        if len(at):
            out[at] = multistage(feat[at], y[at], x[at], q, min_size, min_consistency, merge, adjacent)
        return out
    labels, u = greedy_graph(feat, y, x, q=q, min_size=min_size), unit(feat)
    for k in range(1, labels.max(initial=0) + 1):
        m = labels == k
        if (u[m] @ unit(feat[m].mean(0))).mean() < min_consistency:
            labels[m] = 0
    labels = distribute(feat, labels, y, x)
    return by_size(np.where(labels > 0, merge_similar(feat, labels, merge, touching_pairs(labels, y, x) if adjacent else None), -1), 1)


@register_extractor("seam_merge")
def seam_merge(feat, y, x, q: float = 0.7, threshold: float = 0.4, thickness: int = 1) -> np.ndarray:
    """Labels that touch are merged when the bands along their seam, ``thickness`` cells deep, are alike."""
    labels = greedy_graph(feat, y, x, q=q, min_size=1)
    e = edges_of(y, x)
    near = neighbours_of(e, len(feat))
    f = Forest(int(labels.max(initial=0)) + 1)

    along: dict[tuple[int, int], set[int]] = {}
    for i, j in np.concatenate([e, e[:, ::-1]]).tolist():
        if labels[i] != labels[j]:
            along.setdefault((int(labels[i]), int(labels[j])), set()).add(i)

    def band(a: int, b: int) -> np.ndarray:
        inside = along[a, b]
        for _ in range(thickness - 1):
            inside = inside | {j for i in inside for j in near[i] if labels[j] == a}
        return unit(feat[sorted(inside)].mean(0))

    for a, b in sorted(touching_pairs(labels, y, x)):
        if round(float(band(a, b) @ band(b, a)), 9) >= threshold:
            f.union(a, b)
    return by_size(np.array([f.find(int(k)) for k in labels]), 1)


def agglomerate(feat: np.ndarray, y: np.ndarray, x: np.ndarray, thresholds: list[float], min_size: int = 1) -> dict[float, np.ndarray]:
    """Merges the most similar pair of touching clusters while it is at least the threshold; one labelling for each threshold, falling.

    Similarity is the cosine of the clusters' sums. Among equals the pair that came up first is taken. Levels go on from
    each other; a level at which only one cluster is left has no labelling.
    """
    n = len(feat)
    total = np.concatenate([feat, np.zeros_like(feat[:-1])]).astype(float)  # of every cluster that may come up
    unit_of = unit(total)
    members = {i: [i] for i in range(n)}
    edges = edges_of(y, x)
    near = {i: set(v) for i, v in enumerate(neighbours_of(edges, n))}
    came = iter(range(10**12))
    # entries of clusters that have been merged since are dropped when they come up
    heap = [(-float(unit_of[a] @ unit_of[b]), next(came), min(a, b), max(a, b)) for a, b in edges.tolist()]
    heapq.heapify(heap)
    out, fresh = {}, n
    for t in thresholds:
        while heap:
            s, _, a, b = heap[0]
            if a not in near or b not in near:
                heapq.heappop(heap)
                continue
            if -s < t:
                break
            total[fresh] = total[a] + total[b]
            unit_of[fresh] = unit(total[fresh])
            few, many = sorted((members.pop(a), members.pop(b)), key=len)
            many += few
            members[fresh] = many
            few, around = sorted((near.pop(a), near.pop(b)), key=len)
            around |= few
            around -= {a, b}
            for c in sorted(around):
                near[c] -= {a, b}
                near[c].add(fresh)
                heapq.heappush(heap, (-float(unit_of[fresh] @ unit_of[c]), next(came), c, fresh))
            near[fresh] = around
            fresh += 1
        if heap:
            labels = np.full(n, -1)
            for k, m in members.items():
                if len(m) >= min_size:
                    labels[m] = k
            out[t] = by_size(labels, 1)
    return out


def agglomerated(grid: DataFrame, thresholds: list[float], min_size: int = 1) -> DataFrame:
    """(image, node, threshold, label): ``agglomerate`` for each image, merged once for all thresholds."""

    def many(t: pa.Table) -> pa.Table:
        t, starts = in_groups(t, ["image"], [("node", True)])
        y, x, out = t.column("y").to_numpy(), t.column("x").to_numpy(), []
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            rows = t.slice(i, j - i)
            feat = np.array(rows.column("feat").to_pylist(), np.float64)
            for level, labels in agglomerate(feat, y[i:j], x[i:j], thresholds, min_size).items():
                out.append(rows.select(["image", "node"]).append_column("threshold", pa.array(np.full(j - i, level))).append_column("label", pa.array(labels.astype(np.int64))))
        return pa.concat_tables(out) if out else pa.table({"image": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "threshold": pa.array([], pa.float64()), "label": pa.array([], pa.int64())})

    rows = bucketed(grid.select(F.col("image").cast("long").alias("image"), F.col("node").cast("long").alias("node"), "y", "x", "feat"), "image")
    return rows.groupBy("_bucket").applyInArrow(many, "image long, node long, threshold double, label long")


@register_extractor("agglomerative")
def agglomerative(feat, y, x, threshold: float = 0.2, min_size: int = 1) -> np.ndarray:
    return agglomerate(feat, y, x, [threshold], min_size).get(threshold, np.zeros(len(feat), np.int64))


def fiedler(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and the second eigenvector of the normalized Laplacian; its first non-zero entry is positive."""
    d = w.sum(1)
    s = 1 / np.sqrt(np.maximum(d, 1e-12))
    values, vectors = np.linalg.eigh(np.eye(len(w)) - s[:, None] * w * s[None])
    v = vectors[:, 1] * s if len(w) > 1 else vectors[:, 0]
    big = np.flatnonzero(np.abs(v) > 1e-9)
    return values, -v if len(big) and v[big[0]] < 0 else v


def affinity_matrix(feat: np.ndarray, tau: float, floor: float = 1e-5) -> np.ndarray:
    u = unit(feat)
    return np.where(u @ u.T > tau, 1.0, floor)


class SparseAffinity:
    """The affinity of ``affinity_matrix`` as its pattern: 1 for alike cells and ``floor`` for all other pairs, without an n x n matrix.

    Painted cells are alike to none, themselves included.
    """

    def __init__(self, feat: np.ndarray, tau: float, floor: float = 1e-5):
        u, self.n, self.floor = unit(feat), len(feat), floor
        step = max(1, (1 << 24) // self.n)
        parts = [np.nonzero(u[k : k + step] @ u.T > tau) for k in range(0, self.n, step)]
        self.row = np.concatenate([r + k * step for k, (r, _) in enumerate(parts)])
        self.col = np.concatenate([c for _, c in parts]).astype(np.int32)

    def painted_out(self, done: np.ndarray) -> SparseAffinity:
        out = object.__new__(SparseAffinity)
        keep = ~done[self.row] & ~done[self.col]
        out.n, out.floor, out.row, out.col = self.n, self.floor, self.row[keep], self.col[keep]
        return out

    def times(self, v: np.ndarray) -> np.ndarray:
        """The affinity times each column of ``v``."""
        alike = np.stack([np.bincount(self.row, c[self.col], self.n) for c in v.T], 1)
        return (1 - self.floor) * alike + self.floor * v.sum(0)

    def fiedler(self, tol: float = 1e-10, block: int = 3, room: int = 60, most: int = 200) -> tuple[np.ndarray, np.ndarray]:
        """The three least eigenvalues of the normalized Laplacian and its second eigenvector, as ``fiedler`` gives them.

        A block Lanczos iteration with full orthogonalisation, so that equal eigenvalues are seen, and restarts from its best
        vectors; the first eigenvector is known and kept out.
        """
        s = 1 / np.sqrt(np.maximum(self.times(np.ones((self.n, 1)))[:, 0], 1e-12))
        top = (1 / s)[:, None]
        top /= np.linalg.norm(top)
        step = lambda v: s[:, None] * self.times(s[:, None] * v)
        basis, image = np.zeros((self.n, 0)), np.zeros((self.n, 0))
        new = np.random.default_rng(0).normal(size=(self.n, block))
        for _ in range(most):
            for _ in range(2):  # twice is enough
                new -= top @ (top.T @ new)
                new -= basis @ (basis.T @ new)
            new, size = np.linalg.qr(new)
            new = new[:, np.abs(np.diag(size)) > 1e-12]
            if not new.shape[1]:
                break
            basis = np.concatenate([basis, new], 1)
            image = np.concatenate([image, step(new)], 1)
            values, mix = np.linalg.eigh(basis.T @ image)
            lead = mix[:, ::-1][:, : 2 * block]
            rest = image @ lead[:, :2] - basis @ lead[:, :2] * values[::-1][:2]
            rest = np.linalg.norm(rest, axis=0)
            if rest[0] < tol and (rest[-1] < tol or values[-1] - values[-2] > 10 * rest[-1]):
                break  # the third need only be told from the second
            if basis.shape[1] >= room:
                basis, image = basis @ lead, image @ lead
                new = (image - basis * values[::-1][: lead.shape[1]])[:, :block]
            else:
                new = image[:, -new.shape[1] :].copy()
        values, mix = np.linalg.eigh(basis.T @ image)
        v = (basis @ mix[:, -1]) * s
        big = np.flatnonzero(np.abs(v) > 1e-9)
        return np.array([0.0, *(1 - values[::-1][:2])]), -v if len(big) and v[big[0]] < 0 else v


MOST_DENSE = 400  # cells; the affinity of larger regions is kept sparse


@register_extractor("normalized_cut")
def normalized_cut(feat, y, x, tau: float = 0.15, most: int = 3, most_share: float = 1.0, most_overlap: float = 1.0) -> np.ndarray:
    """Repeated bipartition: the side of the strongest cell, its component there, is one object and is painted out.

    The search ends early at an object of more than ``most_share`` of all cells, which repeats what it was cut from, or one
    that with the painted cells on its side overlaps an earlier object by an IoU of more than ``most_overlap``, and where no
    bipartition is the best alone (equal eigenvalues, as without any similar cells).
    """
    labels, near = np.zeros(len(feat), np.int64), neighbours_of(edges_of(y, x), len(feat))
    corner = {(int(y.min()), int(x.min())), (int(y.min()), int(x.max())), (int(y.max()), int(x.min())), (int(y.max()), int(x.max()))}
    is_corner = np.array([(int(a), int(b)) in corner for a, b in zip(y, x, strict=True)])

    def reached(seed: int, free: np.ndarray) -> np.ndarray:
        todo, got = [seed], np.zeros(len(feat), bool)
        while todo:
            i = todo.pop()
            if free[i] and not got[i]:
                got[i] = True
                todo += near[i]
        return got

    sparse = SparseAffinity(feat, tau) if len(feat) > MOST_DENSE else None
    for k in range(1, most + 1):
        done = labels > 0
        if sparse is not None:
            values, v = sparse.painted_out(done).fiedler()
        else:
            w = affinity_matrix(feat, tau)
            w[done], w[:, done] = 1e-5, 1e-5
            values, v = fiedler(w)
        if len(values) > 2 and values[2] - values[1] < 1e-9:
            break
        v = np.round(v, 7)  # so that ties are ties
        side, seed = v > round(float(v.mean()), 7), int(np.argmax(np.abs(v)))
        if not side[seed] or (side & is_corner).sum() >= 3:
            side = ~side
            seed = int(np.argmax(np.where(side, np.abs(v), -1)))
        got, whole = reached(seed, side & ~done), reached(seed, side)
        overlap = max(((whole & (labels == j)).sum() / (whole | (labels == j)).sum() for j in range(1, k)), default=0.0)
        if not got.any() or got.sum() > most_share * len(feat) or overlap > most_overlap:
            break
        labels[got] = k
    return labels


@register_extractor("kmeans")
def kmeans(feat, y, x, k: int = 4, seed: int = 0, steps: int = 50) -> np.ndarray:
    """k-means from k-means++ starts with a fixed seed; an empty cluster keeps its centre."""
    rng, k = np.random.default_rng(seed), min(k, len(feat))
    centres = [feat[rng.integers(len(feat))]]
    while len(centres) < k:
        d = np.min([((feat - c) ** 2).sum(1) for c in centres], 0)
        centres.append(feat[rng.choice(len(feat), p=d / d.sum())] if d.sum() > 0 else feat[0])
    c = np.stack(centres)
    for _ in range(steps):
        own = ((feat[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.stack([feat[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return own


def pca(feat: np.ndarray, k: int, whiten: bool = False) -> np.ndarray:
    """Centred data on its k main axes (each axis' largest entry positive), to unit spread where asked."""
    z = feat - feat.mean(0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    vt = vt[:k] * np.sign(vt[:k][np.arange(min(k, len(vt))), np.abs(vt[:k]).argmax(1)])[:, None]
    out = z @ vt.T
    return out / np.maximum(out.std(0), 1e-8) if whiten else out


def eigengap(values: np.ndarray) -> int:
    """Number of clusters by the largest gap of consecutive eigenvalues, the first gap left out; 2 at least."""
    gaps = np.diff(np.sort(values))[1:]
    return max(2, int(np.argmax(gaps)) + 2) if len(gaps) else 2


def clean_regions(mask: np.ndarray, least: int, fill: bool, connectivity: int = 8) -> np.ndarray:
    """Fills holes or drops islands of fewer than ``least`` cells; if every island is small, the largest stays."""
    work = ~mask if fill else mask
    yy, xx = np.nonzero(work)
    if not len(yy):
        return mask
    part = components(len(yy), edges_of(yy, xx, connectivity))
    names, n = np.unique(part, return_counts=True)
    keep = names[n >= least]
    if not len(keep) and not fill:
        keep = names[[n.argmax()]]
    out = work.copy()
    gone = ~np.isin(part, keep)
    out[yy[gone], xx[gone]] = False
    return ~out if fill else out


def mean_field(unary: np.ndarray, guide: np.ndarray, radius: int = 1, steps: int = 3, eps: float = 1e-2, weight: float = 1.0) -> np.ndarray:
    """Label scores (h x w x k) smoothed by a guided filter and renormalized, a few times over."""

    def box(a: np.ndarray) -> np.ndarray:
        p = np.pad(a, [(radius, radius)] * 2 + [(0, 0)] * (a.ndim - 2), mode="edge")
        return np.mean([p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(2 * radius + 1) for j in range(2 * radius + 1)], 0)

    soft = lambda s: np.exp(s - s.max(-1, keepdims=True)) / np.exp(s - s.max(-1, keepdims=True)).sum(-1, keepdims=True)
    g, q = guide[..., None], soft(unary)
    for _ in range(steps):
        mg, mq = box(g), box(q)
        a = (box(g * q) - mg * mq) / (box(g * g) - mg * mg + eps)
        q = soft(unary + weight * (box(a) * g + box(mq - a * mg)))
    return q


def spectral_tree(grid: DataFrame, taus: list[float], most: int = 3, least_share: float = 0.0, most_overlap: float = 0.9) -> DataFrame:
    """(image, level, parent, child, node): the objects of each image by normalized cuts, and within each object's box again, level by level.

    Level 1 cuts whole images with the first threshold. Every deeper level takes the objects of the one before as a list of
    work: a row (image, level, box) each, which meets the cells of its box, so that regions, not images, are dealt
    to tasks. A box has all its cells, those between and around the object among them. Objects of an image and level are
    numbered from 0 by (parent, child) and are the parents of the next level's; level 1 has parent -1. An object of less
    than ``least_share`` of its region's cells ends its region's search, as do the rules of ``normalized_cut``.
    """
    long = lambda c: F.col(c).cast("long").alias(c)
    cells = materialized(grid.select(long("image"), long("node"), long("y"), long("x"), "feat"))
    box = [F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")]
    work = cells.groupBy("image").agg(*box).withColumn("parent", F.lit(-1).cast("long"))
    found = []

    def cut(tau: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def region(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("node")
            y, x, feat = part["y"].to_numpy(), part["x"].to_numpy(), np.stack(part["feat"].to_numpy()).astype(float)
            labels = normalized_cut(feat, y, x, tau=tau, most=most, most_overlap=most_overlap) if len(part) > 2 else np.zeros(len(part), np.int64)
            small = [k for k in range(1, labels.max(initial=0) + 1) if (labels == k).sum() < max(1, int(least_share * len(part)))]
            last = small[0] if small else labels.max(initial=0) + 1
            at = (labels > 0) & (labels < last)
            return pd.DataFrame({"image": part["image"][at], "parent": part["parent"][at], "child": labels[at] - 1, "node": part["node"][at], "y": y[at], "x": x[at]})

        return region

    for level, tau in enumerate(taus, 1):
        inside = F.col("y").between(F.col("y0"), F.col("y1")) & F.col("x").between(F.col("x0"), F.col("x1"))
        regions = cells.join(work, "image").where(inside).select("image", "parent", "node", "y", "x", "feat")
        objects = materialized(regions.groupBy("image", "parent").applyInPandas(cut(tau), "image long, parent long, child long, node long, y long, x long"))
        found.append(objects.select("image", F.lit(level).alias("level"), "parent", "child", "node"))
        boxes = objects.groupBy("image", "parent", "child").agg(*box)
        number = F.row_number().over(Window.partitionBy("image").orderBy("parent", "child")) - 1
        work = materialized(boxes.select("image", "y0", "y1", "x0", "x1", number.cast("long").alias("parent")))
    return functools.reduce(DataFrame.unionByName, found)


def nearest_labels(labels: np.ndarray, height: int, width: int) -> np.ndarray:
    """A label map of another size: each cell takes the label at its place, rounded down."""
    h, w = labels.shape
    return labels[(np.arange(height) * h // height)[:, None], (np.arange(width) * w // width)[None]]


def bilinear_mask(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """A mask of another size: values between cell centres, and True where they are over half of the largest."""

    def taps(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
        lo = np.floor(at).astype(int)
        return lo, np.minimum(lo + 1, size - 1), at - lo

    (a, b, u), (c, d, v) = taps(height, mask.shape[0]), taps(width, mask.shape[1])
    rows = mask[a] * (1 - u)[:, None] + mask[b] * u[:, None]
    out = rows[:, c] * (1 - v) + rows[:, d] * v
    return out > out.max() / 2 if out.size else out.astype(bool)


def pooled(feat: np.ndarray, y: np.ndarray, x: np.ndarray, factor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means of ``factor`` x ``factor`` cells, with their places, in the order of rows and columns."""
    cell = (y // factor) * (int(x.max()) // factor + 1) + x // factor
    names, at = np.unique(cell, return_inverse=True)
    n = np.bincount(at)[:, None]
    mean = np.stack([np.bincount(at, feat[:, k], len(names)) for k in range(feat.shape[1])], 1) / n
    return mean, names // (int(x.max()) // factor + 1), names % (int(x.max()) // factor + 1)


@register_extractor("hierarchical")
def hierarchical(feat, y, x, coarse: float = 0.6, fine: float = 0.8, min_size: int = 2, factor: int = 2, parents: bool = False) -> np.ndarray:
    """Coarse pieces of a grid ``factor`` times smaller, brought to full size; each is cut again with a stricter quantile within itself.

    Cells left over in a piece get an id of their own. Ids are those of the fine pieces, from 1; with ``parents`` the
    coarse piece of each cell instead.
    """
    small, ys, xs = pooled(feat, y, x, factor)
    grid_of = np.zeros((int(ys.max()) + 1, int(xs.max()) + 1), np.int64)
    grid_of[ys, xs] = greedy_graph(small, ys, xs, q=coarse, min_size=min_size)
    top = grid_of[y // factor, x // factor]
    if parents:
        return top
    out, n = np.zeros(len(feat), np.int64), 0
    for k in range(0, top.max(initial=0) + 1):
        at = np.flatnonzero(top == k)
        if len(at):
            sub = greedy_graph(feat[at], y[at], x[at], q=fine, min_size=min_size)
            for s in np.unique(sub):
                n += 1
                out[at[sub == s]] = n
    return out


def pca_rgb(feat: np.ndarray, low: float = 0.02, high: float = 0.98) -> np.ndarray:
    """Three main axes as colours (n x 3, 0 to 255), each stretched between its quantiles."""
    z = pca(feat, 3)
    z = np.pad(z, ((0, 0), (0, 3 - z.shape[1])))
    lo, hi = np.quantile(z, [low, high], axis=0)
    return np.round(np.clip((z - lo) / (hi - lo + 1e-8), 0, 1) * 255).astype(np.int64)


@register_extractor("spectral_levels")
def spectral_levels(feat, y, x, taus: tuple[float, ...] = (0.1, 0.25), most: int = 3, most_overlap: float = 0.9) -> np.ndarray:
    """Objects by normalized cuts, then within each object again with a stricter threshold; ids are of the lowest level."""
    labels = normalized_cut(feat, y, x, tau=taus[0], most=most, most_overlap=most_overlap)
    for tau in taus[1:]:
        new, n = np.zeros(len(feat), np.int64), 0
        for k in np.unique(labels):
            at = np.flatnonzero(labels == k)
            sub = normalized_cut(feat[at], y[at], x[at], tau=tau, most=most, most_overlap=most_overlap) if len(at) > 2 else np.zeros(len(at), np.int64)
            for s in np.unique(sub):
                n += 1
                new[at[sub == s]] = n
        labels = new
    return labels
