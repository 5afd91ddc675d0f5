"""The sequential kernels against brute force written for these tests."""

import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.operators import match as M
from gridloom.operators import segment as X
from gridloom.operators import suppress as D
from gridloom.operators import temporal as T


@given(st.integers(1, 5), st.integers(1, 6), st.integers(0, 999))
@settings(max_examples=60, deadline=None)
def test_assignment_is_optimal(n, m, seed):
    cost = np.random.default_rng(seed).integers(0, 20, (n, m)).astype(float)
    got = M.assign(cost)
    assert len(got) == min(n, m) and len({a for a, _ in got}) == len(got) == len({b for _, b in got})
    small, big = (range(n), range(m)) if n <= m else (range(m), range(n))
    best = min(sum(cost[(i, j) if n <= m else (j, i)] for i, j in zip(small, p, strict=True)) for p in itertools.permutations(big, len(small)))
    assert sum(cost[a, b] for a, b in got) == best


def test_windowed_rule_differs_from_full_rule():
    iou = np.zeros((7, 7))
    for i in range(2):  # 0 ~ 1 ~ 2 in a chain, and 6 repeats 0 more than four ranks away
        iou[i, i + 1] = iou[i + 1, i] = 0.9
    iou[0, 6] = iou[6, 0] = 1.0
    band = np.array([[iou[i, i + k] if i + k < 7 else 0 for i in range(7)] for k in range(1, 5)])
    assert D.keep_windowed(band, 0.5).tolist() == [True, False, True, True, True, True, True]
    assert D.keep_full(iou, 0.5).tolist() == [True, False, True, True, True, True, False]


def test_equal_overlap_takes_the_later_truth_and_crowds_are_reused():
    box = np.array([[0, 0, 10, 10.0]])
    got, skip = M.evaluate_image(np.repeat(box, 3, 0), np.repeat(box, 2, 0), np.array([False, True]), np.array([False, True]), np.array([0.5]))
    assert got.tolist() == [[0, 1, 1]] and skip.tolist() == [[False, True, True]]
    got, _ = M.evaluate_image(box, np.repeat(box, 2, 0), np.zeros(2, bool), np.zeros(2, bool), np.array([1.0]))
    assert got.tolist() == [[1]]


def test_greedy_pairs_go_by_overlap():
    assert M.greedy_pairs(np.array([[0.5, 0.9], [0.4, 0.8]]), 0.3) == [(0, 1), (1, 0)]
    assert [p[:2] for p in M.best_covered(np.array([[0.5, 0.9], [0.4, 0.8]]))] == [(0, 1), (1, 0)]


@given(st.integers(2, 30), st.integers(0, 999))
@settings(max_examples=40, deadline=None)
def test_components_do_not_depend_on_edge_order(n, seed):
    rng = np.random.default_rng(seed)
    e = rng.integers(0, n, (n, 2))
    a, b = X.components(n, e), X.components(n, e[rng.permutation(len(e))])
    assert (a == b).all() and all(a[i] == a[j] for i, j in e)


def test_relabel_has_no_background_without_a_size():
    labels = np.array([5, 5, 3, 3, 3, 9])
    assert X.by_size(labels).tolist() == [1, 1, 0, 0, 0, 2]
    assert X.by_size(labels, 2).tolist() == [2, 2, 1, 1, 1, 0]


def grid(h, w):
    y, x = np.divmod(np.arange(h * w), w)
    return y, x


def test_two_regions_are_found_by_each_extractor():
    y, x = grid(3, 6)
    feat = np.where((x < 3)[:, None], [1.0, 0.0], [0.0, 1.0])
    for name in ("cut_graph", "agglomerative"):
        labels = X.EXTRACTORS[name](feat, y, x, **({"cut": 0.5} if name == "cut_graph" else {"threshold": 0.5}))
        assert len({*labels[x < 3]}) == len({*labels[x >= 3]}) == 1 and labels[0] != labels[-1]
    assert len(set(X.kmeans(feat, y, x, k=2))) == 2
    w = X.affinity_matrix(feat, 0.5)
    side = X.fiedler(w)[1] > 0
    assert len({*side[x < 3]}) == 1 and side[0] != side[-1]
    assert X.eigengap(X.fiedler(w)[0]) == 2


def test_last_cluster_gives_no_level():
    y, x = grid(1, 4)
    feat = np.array([[1.0, 0], [1, 0.1], [0, 1], [0.1, 1]])
    assert sorted(X.agglomerate(feat, y, x, [0.9, -1.0])) == [0.9]


def test_small_regions():
    m = np.ones((6, 6), bool)
    m[2, 2] = False
    assert X.clean_regions(m, 3, True).all()
    m = np.zeros((6, 6), bool)
    m[0, 0] = m[4, 4] = m[4, 5] = True
    assert X.clean_regions(m, 2, False).sum() == 2
    assert X.clean_regions(m, 9, False).sum() == 2


def test_transport_has_uniform_margins_and_follows_features():
    a = np.eye(4)
    plan = T.transport_plan(a, a[::-1], 0.1, 500)
    assert np.allclose(plan.sum(1), 0.25, atol=1e-3) and np.allclose(plan.sum(0), 0.25, atol=1e-6)
    assert T.push_mass(np.array([1.0, 0, 0, 0]), plan).argmax() == 3


def test_track_that_misses_a_frame_ends():
    box = np.array([[0, 0, 10, 10.0]])
    got, active, fresh = T.advance({}, box, 0.5, 0, True)
    assert got == [0]
    got, active, fresh = T.advance(active, np.zeros((0, 4)), 0.5, fresh, False)
    got, active, fresh = T.advance(active, box, 0.5, fresh, False)
    assert got == [-1]


def test_correction_click():
    truth, pred = np.zeros((7, 7), bool), np.zeros((7, 7), bool)
    truth[1:6, 1:6] = True
    assert T.correction_click(truth, pred) == (3, 3, 1)
    assert T.correction_click(truth, truth) is None
    assert D.spaced_peaks(np.arange(9).reshape(3, 3), 2, 1) == [(2, 2), (2, 0)]
