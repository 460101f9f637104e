"""Graph algorithms over arrays, for graphs (or what is left of one) that one task can hold.

Graphs come as whole numbers: nodes are their places in the order of names. Each function is the body of a ``mapInArrow`` on
the executors; the callers in ``graph`` take the distributed form of the same algorithm for anything larger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Cells of a (nodes x sources) table, of which some six are held; sources beside each other, and rows that are added up at once.
CELLS, WIDTH, ROWS = 10_000_000, 64, 1_024


def mergers(x: np.ndarray, y: np.ndarray, w: np.ndarray, ends: np.ndarray, mix: np.ndarray, m: int) -> np.ndarray:
    """The community each node ends in, by the rounds of ``graph.communities``; links come both ways, ``ends`` and ``mix`` by node."""
    n = len(ends)
    ends, home = ends.copy(), np.arange(n)
    x, y, w = _added(x, y, w, n)
    while len(x):
        first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        k = np.diff(np.r_[first, len(x)])
        gain = 2 * m * w - ends[x] * ends[y]
        best = np.maximum.reduceat(gain, first)
        # ties are looked at among the best links only, which are few
        at = np.flatnonzero(gain == np.repeat(best, k))
        tie = mix[x[at]] ^ mix[y[at]]
        at = at[np.lexsort((y[at], tie, x[at]))]
        at = at[np.r_[x[at[1:]] != x[at[:-1]], True]]
        keep = best > 0
        if not keep.any():
            break
        px, py, pw, k = x[at][keep], y[at][keep], w[at][keep], k[keep]
        pick = np.full(n, -1)
        pick[px] = py
        mutual = pick[py] == px
        to, held = np.arange(n), ends.copy()
        low, high = px[mutual & (px < py)], py[mutual & (px < py)]
        to[high] = low
        held[low] = held[high] = ends[low] + ends[high]
        alone = (k == 1) & ~mutual
        ax, aw, into = px[alone], pw[alone], to[py[alone]]
        more = np.zeros(n, np.int64)
        np.add.at(more, into, ends[ax])
        gains = 2 * m * aw - ends[ax] * (held[py[alone]] + more[into] - ends[ax]) > 0
        to[ax[gains]] = into[gains]
        gone = np.flatnonzero(to != np.arange(n))
        np.add.at(ends, to[gone], ends[gone])
        ends[gone] = 0
        home = to[home]
        x, y, w = _renamed(x, y, w, to, n)
    return home


def _added(x: np.ndarray, y: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links in order, repeated ones added up."""
    key = x * n + y
    order = np.argsort(key, kind="stable")
    key, w = key[order], w[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first] // n, key[first] % n, np.add.reduceat(w, first) if len(first) else w


def _renamed(x: np.ndarray, y: np.ndarray, w: np.ndarray, to: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links in order after their communities moved to ``to``: only links of those that moved are sorted, into the others."""
    moved = to != np.arange(n)
    other = moved[x] | moved[y]
    a, b = to[x[other]], to[y[other]]
    a, b, c = _added(*(v[a != b] for v in (a, b, w[other])), n)
    x, y, w = x[~other], y[~other], w[~other]
    key, new = x * n + y, a * n + b
    at = np.searchsorted(key, new)
    known = at < len(key)
    known[known] = key[at[known]] == new[known]
    w[at[known]] += c[known]
    at, own = at[~known], ~known
    return np.insert(x, at, a[own]), np.insert(y, at, b[own]), np.insert(w, at, c[own])


def merging(m: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``x, y, w, mix``: links, and nodes (``y`` null) with their ends as ``w``; gives ``x, to`` of nodes that move."""

    def run(batches):
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got)
        node = table.column("y").is_null().to_numpy()
        x, y, w, mix = (table.column(c).fill_null(0).to_numpy() for c in ("x", "y", "w", "mix"))
        names, x_ = np.unique(x, return_inverse=True)
        ends, mixed = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        ends[x_[node]], mixed[x_[node]] = w[node], mix[node]
        home = mergers(x_[~node], np.searchsorted(names, y[~node]), w[~node], ends, mixed, m)
        moved = np.flatnonzero(home != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[home[moved]])], ["x", "to"])

    return run


def pack_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``a, b`` and sources (``b`` null) as one row of two arrays of bytes."""
    a, b, s = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for batch in batches:
        source = batch.column("b").is_null().to_numpy(zero_copy_only=False)
        first = batch.column("a").to_numpy()
        s.append(first[source].astype(np.int32))
        a.append(first[~source].astype(np.int32))
        b.append(batch.column("b").fill_null(0).to_numpy()[~source].astype(np.int32))
    parts = [np.concatenate([*a, *b]).tobytes(), np.sort(np.concatenate(s)).tobytes()]
    yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], ["pairs", "sources"])


def path_counts(n: int, parts: int, every: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``part, pairs, sources``; gives ``id, b, far, near`` over the part's share of the sources.

    ``b`` is what shortest paths add to a node; ``far`` and ``near`` are the sum of distances and the number of nodes reached: from the node when
    ``every`` node is a source, else to the node.
    """

    def run(batches):
        for batch in batches:
            for part, pairs, sources in zip(*(batch.column(c).to_pylist() for c in ("part", "pairs", "sources")), strict=True):
                b, far, near = _paths(np.frombuffer(pairs, np.int32).reshape(2, -1), n, np.frombuffer(sources, np.int32), every, part, parts)
                some = np.flatnonzero((near > 0) | (b > 0))
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(b[some]), pa.array(far[some]), pa.array(near[some])], ["id", "b", "far", "near"])

    return run


def _paths(pairs: np.ndarray, n: int, sources: np.ndarray, every: bool, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shortest paths of the part's share of the sources, some at a time, level by level, and their credits back."""
    tree = Trees(pairs, n) if every else None
    graph = Levels(pairs[:, ~tree.cut[pairs].any(axis=0)] if every else pairs, n)
    weight = np.ones(n)
    if every:
        weight[graph.place] = tree.size
        sources = np.flatnonzero(~tree.cut)
    total, far, near = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    own = np.array_split(graph.order[np.isin(graph.order, graph.place[sources])], parts)[part]
    for low in range(0, len(own), graph.width):
        graph.count(own[low : low + graph.width], weight, every, total, far, near)
    total, far, near = total[graph.place], far[graph.place], near[graph.place]
    if every:
        here = np.zeros(n, bool)
        here[own] = True
        tree.hang(here[graph.place], graph.part_of[graph.place], total, far, near)
    return total, far, near


class Trees:
    """Trees that hang from the rest of a graph, by a single link each: what they add follows from their sizes.

    ``cut`` are the nodes of trees without the roots that the rest keeps; ``size`` is the number of nodes a node holds, itself included.
    """

    def __init__(self, pairs: np.ndarray, n: int) -> None:
        a, b = pairs.astype(np.int64)
        degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        link = np.zeros(n, np.int64)  # the sum of the neighbours left, so that of a last one its number
        np.add.at(link, a, b)
        np.add.at(link, b, a)
        self.cut, self.up, self.size = np.zeros(n, bool), np.arange(n), np.ones(n, np.int64)
        self.depths, self.squares = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.layers = []
        leaves = np.flatnonzero(degree == 1)
        while len(leaves):
            leaves = leaves[(degree[link[leaves]] > 1) | (leaves > link[leaves])]  # of two last ones, one is kept
            up = link[leaves]
            self.cut[leaves], self.up[leaves] = True, up
            size = self.size[leaves]
            np.add.at(self.depths, up, self.depths[leaves] + size)
            np.add.at(self.squares, up, size * size)
            np.add.at(self.size, up, size)
            np.subtract.at(degree, up, 1)
            np.subtract.at(link, up, leaves)
            degree[leaves] = 0
            self.layers.append(leaves)
            leaves = np.unique(up)
            leaves = leaves[degree[leaves] == 1]

    def hang(self, here: np.ndarray, part_of: np.ndarray, total: np.ndarray, far: np.ndarray, near: np.ndarray) -> None:
        """Add to the figures of the roots ``here`` what the trees do, and give those of their nodes; ``part_of`` are components."""
        kept = ~self.cut
        nodes = np.bincount(part_of[kept], weights=self.size[kept]).astype(np.int64)
        depths = np.bincount(part_of[kept], weights=self.depths[kept]).astype(np.int64)
        here = here & kept
        near[here] = nodes[part_of[here]]
        far[here] += depths[part_of[here]]
        for layer in reversed(self.layers):
            leaves = layer[here[self.up[layer]]]
            up = self.up[leaves]
            here[leaves], near[leaves] = True, near[up]
            far[leaves] = far[up] + near[up] - 2 * self.size[leaves]
        below = self.size[here] - 1
        total[here] += 2 * below * (near[here] - self.size[here]) + below * below - self.squares[here]


class Levels:
    """Tables of (node x source), ``width`` sources beside each other: a node's row is added to a neighbour's as a whole.

    Nodes are numbered by falling degree. Sources next to each other in ``order`` are near in the graph, so that a node is on few levels of them.
    """

    def __init__(self, pairs: np.ndarray, n: int) -> None:
        ends, others = np.concatenate([pairs[0], pairs[1]]), np.concatenate([pairs[1], pairs[0]])
        degree = np.bincount(ends, minlength=n)
        by = np.argsort(-degree, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[by] = np.arange(n)
        self.degree = degree[by]
        self.begin = np.cumsum(self.degree) - self.degree
        self.others = self.place[others][np.argsort(self.place[ends], kind="stable")]
        self.n = int(np.count_nonzero(degree))  # those after have no links
        self.part_of = np.arange(n)
        self.order = np.concatenate([self._order(), np.arange(self.n, n)])
        width = min(WIDTH, max(1, CELLS // max(1, self.n)))
        self.width = width // 8 * 8 if width > 8 else width
        self.front, self.next = np.zeros((2, self.n, self.width))
        self.seen = np.zeros((self.n, self.width), bool)
        self.sums, self.more = np.empty((2, ROWS, self.width))
        self.kept = np.empty((4 * self.n, self.width))  # memory in use is not asked for again

    def _order(self) -> np.ndarray:
        """Linked nodes in the order a search over breadth meets them; ``part_of`` is the first of each component."""
        seen, found = np.zeros(self.n, bool), [np.zeros(0, np.int64)]
        for start in range(self.n):
            if seen[start]:
                continue
            front = np.array([start])
            while len(front):
                seen[front], self.part_of[front] = True, start
                found.append(front)
                _, to = self._ways(front)
                met, first = np.unique(to[~seen[to]], return_index=True)
                front = met[np.argsort(first)]
        return np.concatenate(found)

    def _ways(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of some nodes: the place in ``rows`` and the other end."""
        k = self.degree[rows]
        up = np.repeat(np.arange(len(rows)), k)
        return up, self.others[np.arange(len(up)) + (self.begin[rows] - (np.cumsum(k) - k))[up]]

    def _added(self, table: np.ndarray, up: np.ndarray, to: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For the ``n`` places in ``up`` (in order), some at a time: the places, and the sums of their rows ``to`` of ``table``."""
        k = np.bincount(up, minlength=n)
        first, many = np.cumsum(k) - k, np.argsort(-k, kind="stable")
        for low in range(0, n, ROWS):
            at = many[low : low + ROWS]
            less, sums = -k[at], self.sums[: len(at)]
            stops = np.searchsorted(less, -np.arange(-less[0]))
            if not len(stops) or stops[0] < len(at):
                sums.fill(0)
            for j, stop in enumerate(stops):
                rows = to[first[at[:stop]] + j]
                if j or stop < len(at):
                    np.take(table, rows, axis=0, out=self.more[:stop], mode="clip")
                    sums[:stop] += self.more[:stop]
                else:
                    np.take(table, rows, axis=0, out=sums, mode="clip")
            yield at, sums

    def _any(self, marks: np.ndarray) -> np.ndarray:
        return (marks.view(np.int64) if self.width % 8 == 0 else marks).any(axis=1)

    def count(self, sources: np.ndarray, weight: np.ndarray, every: bool, total: np.ndarray, far: np.ndarray, near: np.ndarray) -> None:
        """Add what nodes of a ``weight`` give from some sources: distances to a source if ``every`` (not how many), else from the sources."""
        near[sources] += 1
        sources = sources[sources < self.n]
        if not len(sources):
            return
        columns, shares = np.arange(len(sources)), np.zeros(self.width)
        shares[columns] = weight[sources] if every else 1.0
        self.seen.fill(False)
        self.seen[:, len(sources) :] = True
        self.seen[sources, columns] = True
        front, next_ = self.front, self.next
        front[sources, columns] = 1.0
        rows = np.sort(sources)
        levels, held = [(rows, front[rows])], 0
        on, open_ = np.zeros(self.n, bool), np.ones(self.n, bool)
        while True:
            rows = levels[-1][0]
            if self.degree[rows].sum() < 0.1 * len(self.others):
                up, met = self._ways(rows)
                up, met = up[open_[met]], met[open_[met]]
                by = np.argsort(met, kind="stable")
                to, met = rows[up[by]], met[by]
                start = np.flatnonzero(np.r_[True, met[1:] != met[:-1]]) if len(met) else met
                reached = met[start]
                up = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(met)]))
            else:
                on[rows] = True
                reached = np.flatnonzero(open_)
                up, to = self._ways(reached)
                keep = on[to]
                up, to = up[keep], to[keep]
                k = np.bincount(up, minlength=len(reached)) > 0
                reached, up = reached[k], (np.cumsum(k) - 1)[up]
                on[rows] = False
            found, counts = [], np.zeros(self.width)
            values = self.kept[held : held + len(reached)] if held + len(reached) <= len(self.kept) else np.empty((len(reached), self.width))
            size = 0
            for at, ways in self._added(front, up, to, len(reached)):
                node = reached[at]
                seen = self.seen[node]
                new = (ways > 0) > seen
                some = self._any(new)
                ways *= new
                seen |= new
                self.seen[node] = seen
                open_[node] = self._any(~seen)
                if not some.all():
                    node, ways, new = node[some], ways[some], new[some]
                values[size : size + len(node)] = ways
                size += len(node)
                next_[node] = ways
                found.append(node)
                if every:
                    counts += weight[node] @ new
                else:
                    c = np.count_nonzero(new, axis=1)
                    near[node] += c
                    far[node] += len(levels) * c
            front[rows] = 0
            if not size:
                break
            if every:
                far[sources] += len(levels) * counts[: len(sources)].astype(np.int64)
            levels.append((np.concatenate(found), values[:size]))
            held += size
            front, next_ = next_, front
        # front and next_ are zero again; credits flow back
        below = None
        while len(levels) > 1:
            rows, values = levels.pop()
            if below is None:
                up = to = np.zeros(0, np.int64)
            else:
                on[below] = True
                up, to = self._ways(rows)
                up, to = up[on[to]], to[on[to]]
                on[below] = False
            for at, credit in self._added(front, up, to, len(rows)):
                ways, node = values[at], rows[at]
                credit *= ways
                total[node] += credit @ shares
                away = ways == 0
                credit += weight[node, None]
                credit *= ~away
                ways += away
                credit /= ways
                next_[node] = credit
            if below is not None:
                front[below] = 0
            front, next_, below = next_, front, rows
        if below is not None:
            front[below] = 0
