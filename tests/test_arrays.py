import numpy as np

from caselattice.operators import arrays


def _links(seed, n, m):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, n, (2, m))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
    return pairs, rng.integers(-(1 << 60), 1 << 60, n)


def test_rounds_of_mergers_sort_moved_links_only(monkeypatch):
    """All links are put in order once; later rounds touch those of communities that moved."""
    pairs, mix = _links(5, 3_000, 7_500)
    sorted_links = []
    added = arrays._added
    monkeypatch.setattr(arrays, "_added", lambda x, y, w, n: (sorted_links.append(len(x)), added(x, y, w, n))[1])
    x, y = np.concatenate(pairs), np.concatenate(pairs[::-1])
    home = arrays.mergers(x, y, np.ones(len(x), np.int64), np.bincount(x, minlength=3_000), mix, pairs.shape[1])
    assert len(sorted_links) > 30
    assert sum(sorted_links[1:]) < 0.3 * len(sorted_links) * len(x)
    assert max(sorted_links[20:]) < 0.25 * len(x)


def _brute(pairs, n):
    """What shortest paths from every node add to each, the distances and the nodes reached, one source at a time."""
    near = [[] for _ in range(n)]
    for a, b in pairs.T:
        near[a].append(b)
        near[b].append(a)
    total, far, reached = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for s in range(n):
        hops, ways, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for u in near[v]:
                if u not in hops:
                    hops[u], ways[u] = hops[v] + 1, 0.0
                    order.append(u)
                if hops[u] == hops[v] + 1:
                    ways[u] += ways[v]
        credit = dict.fromkeys(order, 0.0)
        for v in reversed(order[1:]):
            total[v] += credit[v]
            for u in near[v]:
                if hops[u] == hops[v] - 1:
                    credit[u] += ways[u] / ways[v] * (1 + credit[v])
        far[s], reached[s] = sum(hops.values()), len(order)
    return total, far, reached


def test_paths_of_trees_follow_from_their_sizes(monkeypatch):
    """Nodes of hanging trees are no sources, and all figures are those of every node as a source."""
    sources = []
    count = arrays.Levels.count
    monkeypatch.setattr(arrays.Levels, "count", lambda self, some, *args: (sources.extend(some[self.degree[some] > 0]), count(self, some, *args))[1])
    for seed, n, m in ((1, 40, 30), (2, 60, 70), (3, 60, 200)):
        pairs = _links(seed, n, m)[0].astype(np.int32)
        expected = _brute(pairs, n)
        sources.clear()
        got = [sum(c) for c in zip(*(arrays._paths(pairs, n, np.arange(n, dtype=np.int32), True, part, 3) for part in range(3)), strict=True)]
        linked = np.count_nonzero(np.bincount(pairs.ravel(), minlength=n))
        assert len(set(sources)) == len(sources) <= linked and (seed == 3 or len(sources) < linked)
        np.testing.assert_allclose(got[0], expected[0], atol=1e-9)
        assert (got[1] == expected[1]).all() and (got[2] == expected[2]).all()


def test_paths_of_a_long_tree():
    n = 3_000
    line = np.stack([np.arange(n - 1), np.arange(1, n)]).astype(np.int32)
    total, far, near = arrays._paths(line, n, np.arange(n, dtype=np.int32), True)
    at = np.arange(n)
    assert (total == 2 * at * (n - 1 - at)).all() and (near == n).all()
    assert (far == at * (at + 1) // 2 + (n - 1 - at) * (n - at) // 2).all()
