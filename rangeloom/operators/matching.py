"""Edge exclusivity: greedy and optimal choice of pairs that share no node.

A node is a residue's edge: the residue and the edge letter of the pair's class, whichever
side of the pair it stands on.  Both choices run per structure, which bounds a group by a
structure's pairs; several structures are handled in one Python call.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edge_nodes(family: str, left: list[str], right: list[str]) -> tuple[Column, Column]:
    """The two nodes of a pair: edge letter (upper case) and residue, as text; null if a part is.

    ``family`` is a class name such as cWH; a leading n and what follows the two edges do
    not count.  Variant columns are not part of a residue: all its variants are one node.
    """
    edges = F.regexp_extract(F.col(family), "^n?[ctCT]([WHSBwhsb])([WHSBwhsb])", 0)
    letter = lambda i: F.upper(F.substring(edges, i, 1))
    node = lambda i, cols: F.when(F.length(edges) > 0, F.concat_ws("|", letter(i), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))
    return node(-2, left), node(-1, right)


def greedy(edges: list[tuple], scores: list[float]) -> list[bool]:
    """Ascending score; an edge stays if neither of its nodes is taken.  Ties in input order."""
    used: set = set()
    keep = [False] * len(edges)
    for i in sorted(range(len(edges)), key=lambda i: (scores[i], i)):
        a, b = edges[i]
        if a not in used and b not in used and a != b:
            used |= {a, b}
            keep[i] = True
    return keep


def max_weight_matching(edges: list[tuple], weights: list[float]) -> list[bool]:
    """Exact maximum-weight matching of a general graph, component by component.

    Of parallel edges the heaviest counts (ties: the first); loops and edges without a
    positive weight are never taken.  Polynomial: augmenting paths with blossoms and dual
    variables, cubic in a component's nodes at worst.
    """
    keep = [False] * len(edges)
    best: dict[tuple, int] = {}
    for i, (a, b) in enumerate(edges):
        if a != b and weights[i] > 0:
            pair = (a, b) if (str(a), repr(a)) <= (str(b), repr(b)) else (b, a)
            if pair not in best or weights[i] > weights[best[pair]]:
                best[pair] = i
    near: dict = {}
    for pair, i in best.items():
        for n in pair:
            near.setdefault(n, []).append(i)
    seen: set = set()
    for root in near:
        if root in seen:
            continue
        nodes, todo = [], [root]
        seen.add(root)
        while todo:
            n = todo.pop()
            nodes.append(n)
            for i in near[n]:
                for m in edges[i]:
                    if m not in seen:
                        seen.add(m)
                        todo.append(m)
        mine = sorted({i for n in nodes for i in near[n]})
        index = {n: k for k, n in enumerate(nodes)}
        if len(mine) == len(nodes) - 1:
            chosen = _tree([(index[edges[i][0]], index[edges[i][1]]) for i in mine], [weights[i] for i in mine], len(nodes))
        else:
            chosen = _Blossom(len(nodes), [(index[edges[i][0]], index[edges[i][1]], weights[i]) for i in mine]).solve()
        for k in chosen:
            keep[mine[k]] = True
    return keep


def _tree(edges: list[tuple[int, int]], weights: list[float], n: int) -> list[int]:
    """Best matching of a tree, by sums over subtrees: the usual case, linear."""
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for i, (a, b) in enumerate(edges):
        near[a].append((b, i))
        near[b].append((a, i))
    order, parent = [0], {0: (-1, -1)}
    for v in order:
        for w, i in near[v]:
            if w != parent[v][0]:
                parent[w] = (v, i)
                order.append(w)
    free, best, pick = [0.0] * n, [0.0] * n, [-1] * n
    for v in reversed(order):
        children = [(w, i) for w, i in near[v] if parent[w][0] == v]
        free[v] = sum(best[w] for w, _ in children)
        best[v] = free[v]
        for w, i in children:
            value = free[v] - best[w] + free[w] + weights[i]
            if value > best[v] + 1e-12:
                best[v], pick[v] = value, i
    chosen, todo = [], [(0, False)]
    while todo:
        v, taken = todo.pop()
        mine = -1 if taken else pick[v]
        if mine >= 0:
            chosen.append(mine)
        todo += [(w, i == mine) for w, i in near[v] if parent[w][0] == v]
    return chosen


class _Blossom:
    """Maximum-weight matching by the primal-dual method.

    Vertices are numbered from 1, blossoms after them; ``top`` names the outermost blossom of
    each.  Weights are scaled to even integers, so that dual steps stay whole.
    """

    SCALE = 1 << 40

    def __init__(self, n: int, edges: list[tuple[int, int, float]]):
        self.n, self.size = n, n
        most = max(w for *_, w in edges)
        self.weight: dict[tuple[int, int], int] = {}
        self.index: dict[tuple[int, int], int] = {}
        self.near: list[list[int]] = [[] for _ in range(n + 1)]
        for i, (a, b, w) in enumerate(edges):
            whole = 2 * max(1, round(w / most * self.SCALE))
            self.weight[a + 1, b + 1] = self.weight[b + 1, a + 1] = whole
            self.index[a + 1, b + 1] = self.index[b + 1, a + 1] = i
            self.near[a + 1].append(b + 1)
            self.near[b + 1].append(a + 1)
        room = 2 * n + 2
        self.mate = [0] * room  # for a top: the vertex on the other end of its matched edge
        self.top = list(range(room))
        self.parts: list[list[int]] = [[] for _ in range(room)]
        self.dual = [0] * room
        self.side = [-1] * room  # 0: even, 1: odd, -1: not reached
        self.parent: list[tuple[int, int]] = [(0, 0)] * room  # edge (outer vertex, own vertex) that reached a top
        self.slack: list[tuple[int, int]] = [(0, 0)] * room  # tightest edge from an even vertex
        self.free = list(range(room - 1, n, -1))
        self.link: list[dict[int, tuple[int, int]]] = [{} for _ in range(room)]  # top -> other top -> edge between them

    def gap(self, u: int, v: int) -> int:
        return self.dual[u] + self.dual[v] - self.weight[u, v]

    def vertices(self, b: int) -> list[int]:
        out, todo = [], [b]
        while todo:
            x = todo.pop()
            if x <= self.n:
                out.append(x)
            else:
                todo += self.parts[x]
        return out

    def tops(self) -> list[int]:
        return sorted({self.top[v] for v in range(1, self.n + 1)})

    def offer(self, u: int, t: int, v: int) -> None:
        """Edge u-v from an even vertex to a vertex of top t."""
        if self.slack[t] == (0, 0) or self.gap(u, v) < self.gap(*self.slack[t]):
            self.slack[t] = (u, v)

    def find_slack(self, t: int) -> None:
        self.slack[t] = (0, 0)
        for v in self.vertices(t):
            for u in self.near[v]:
                if self.top[u] != t and self.side[self.top[u]] == 0:
                    self.offer(u, t, v)

    def push(self, t: int) -> None:
        self.queue += self.vertices(t)

    def base_path(self, t: int, v: int) -> list[int]:
        """Parts of blossom t from its base to the part that holds v, along an even number of edges."""
        parts = self.parts[t]
        at = next(i for i, p in enumerate(parts) if v in set(self.vertices(p)))
        if at % 2:
            self.parts[t] = parts = [parts[0], *reversed(parts[1:])]
            self.ring[t] = [(b, a) for a, b in reversed(self.ring[t])]
            at = len(parts) - at
        return parts[: at + 1]

    def set_mate(self, t: int, own: int, other: int) -> None:
        """Match top t by its vertex ``own`` to ``other``, turning the blossoms inside."""
        todo = [(t, own, other)]
        while todo:
            t, own, other = todo.pop()
            self.mate[t] = other
            if t <= self.n:
                continue
            path = self.base_path(t, own)
            ring, parts = self.ring[t], self.parts[t]
            for i in range(0, len(path) - 1, 2):  # from the base on, pairs of parts change partners
                a, b = ring[i]
                todo.append((path[i], a, b))
                todo.append((path[i + 1], b, a))
            last = len(path) - 1
            todo.append((path[last], own, other))
            self.parts[t] = parts[last:] + parts[:last]
            self.ring[t] = ring[last:] + ring[:last]
        # Parts are matched before their blossom is used again, so the order does not matter.

    def augment(self, t: int, own: int, other: int) -> None:
        """Match along the tree from top t, whose vertex ``own`` is matched to ``other``."""
        while True:
            before = self.mate[t]
            self.set_mate(t, own, other)
            if not before:
                return
            odd = self.top[before]
            u, v = self.parent[odd]  # u in the even top around, v in the odd one
            self.set_mate(odd, v, u)
            t, own, other = self.top[u], u, v

    def root_path(self, t: int) -> list[int]:
        path = [t]
        while self.mate[t]:
            odd = self.top[self.mate[t]]
            t = self.top[self.parent[odd][0]]
            path += [odd, t]
        return path

    def tree_edge(self, a: int, b: int) -> tuple[int, int]:
        """The edge between neighbouring tops of a tree path, from a to b."""
        if self.side[a] == 0:  # b is the odd top matched to a
            other = self.mate[a]
            return self.mate[self.top[other]], other
        u, v = self.parent[a]
        return v, u

    def shrink(self, u: int, v: int, left: list[int], right: list[int], lca: int) -> None:
        """A new blossom from edge u-v and the tree paths of both ends up to ``lca``."""
        left, right = left[: left.index(lca) + 1], right[: right.index(lca) + 1]
        b = self.free.pop()
        self.dual[b] = 0
        self.side[b] = 0
        down = list(reversed(left))  # lca ... top(u)
        parts = down + right[:-1]
        ring = []
        for x, y in zip(down, down[1:], strict=False):
            p, q = self.tree_edge(y, x)
            ring.append((q, p))
        ring.append((u, v))
        ring += [self.tree_edge(x, y) for x, y in zip(right, right[1:], strict=False)]
        self.parts[b], self.ring[b] = parts, ring
        self.mate[b] = self.mate[lca]
        fresh = [p for p in parts if self.side[p] == 1]
        for p in parts:
            for x in self.vertices(p):
                self.top[x] = b
        for p in fresh:
            self.push(p)
        self.top[b] = b
        for t in self.tops():
            if self.side[t] != 0:
                self.find_slack(t)

    def expand(self, b: int) -> None:
        """Undo an odd blossom of dual 0; the tree keeps the even way through it."""
        parts = self.parts[b]
        for p in parts:
            for x in self.vertices(p):
                self.top[x] = p
            self.top[p] = p
        u, v = self.parent[b]
        path = self.base_path(b, v)  # base ... the part that was reached
        ring = self.ring[b]
        on = set(path)
        for p in self.parts[b]:
            if p not in on:
                self.side[p] = -1
                self.find_slack(p)
        reached = (u, v)
        for i in range(len(path) - 1, -1, -1):
            p = path[i]
            if (len(path) - 1 - i) % 2 == 0:
                self.side[p], self.parent[p] = 1, reached
                self.slack[p] = (0, 0)
            else:
                self.side[p] = 0
                self.push(p)
                x, y = ring[i - 1]
                reached = (y, x)
        self.parts[b], self.ring[b] = [], []
        self.side[b] = -1
        self.mate[b] = 0
        self.free.append(b)

    def meet(self, u: int, v: int) -> bool:
        """A tight edge from an even vertex; True if it augmented the matching."""
        s, t = self.top[u], self.top[v]
        if self.side[t] == -1:
            self.side[t], self.parent[t] = 1, (u, v)
            even = self.top[self.mate[t]]
            self.side[even] = 0
            self.slack[t] = self.slack[even] = (0, 0)
            self.push(even)
        elif self.side[t] == 0:
            left, right = self.root_path(s), self.root_path(t)
            shared = set(left) & set(right)
            if not shared:
                self.augment(s, u, v)
                self.augment(t, v, u)
                return True
            self.shrink(u, v, left, right, next(x for x in left if x in shared))
        return False

    def stage(self) -> bool:
        """Grow trees from all free tops until one path augments; False if the optimum is reached."""
        tops = self.tops()
        for t in tops:
            self.side[t], self.slack[t] = -1, (0, 0)
        self.queue: list[int] = []
        for t in tops:
            if not self.mate[t]:
                self.side[t] = 0
                self.push(t)
        if not self.queue:
            return False
        while True:
            while self.queue:
                u = self.queue.pop()
                if self.side[self.top[u]] != 0:
                    continue
                for v in self.near[u]:
                    t = self.top[v]
                    if t == self.top[u]:
                        continue
                    if self.gap(u, v) == 0:
                        if self.meet(u, v):
                            return True
                    elif self.side[t] == -1:
                        self.offer(u, t, v)
            tops = self.tops()
            step = min((self.dual[v] for v in range(1, self.n + 1) if self.side[self.top[v]] == 0), default=0)
            ends = step
            for t in tops:
                if t > self.n and self.side[t] == 1:
                    step = min(step, self.dual[t] // 2)
                if self.side[t] == -1 and self.slack[t] != (0, 0):
                    step = min(step, self.gap(*self.slack[t]))
            for u in range(1, self.n + 1):
                if self.side[self.top[u]] == 0:
                    for v in self.near[u]:
                        if u < v and self.side[self.top[v]] == 0 and self.top[v] != self.top[u]:
                            step = min(step, self.gap(u, v) // 2)
            for v in range(1, self.n + 1):
                self.dual[v] += {0: -step, 1: step}.get(self.side[self.top[v]], 0)
            for t in tops:
                if t > self.n:
                    self.dual[t] += {0: 2 * step, 1: -2 * step}.get(self.side[t], 0)
            if step == ends:
                return False
            for t in tops:
                if self.side[t] == -1 and self.slack[t] != (0, 0) and self.top[t] == t and self.gap(*self.slack[t]) == 0:
                    if self.meet(*self.slack[t]):
                        return True
            for u in range(1, self.n + 1):
                if self.side[self.top[u]] == 0:
                    for v in self.near[u]:
                        if self.side[self.top[v]] == 0 and self.top[v] != self.top[u] and self.gap(u, v) == 0:
                            if self.meet(u, v):
                                return True
            for t in self.tops():
                if t > self.n and self.side[t] == 1 and self.dual[t] == 0:
                    self.expand(t)

    def solve(self) -> list[int]:
        """Positions of the chosen edges."""
        self.ring: list[list[tuple[int, int]]] = [[] for _ in range(2 * self.n + 2)]
        highest = max(self.weight.values())
        for v in range(1, self.n + 1):
            self.dual[v] = highest // 2
        while self.stage():
            pass
        return sorted({self.index[v, self.mate[v]] for v in range(1, self.n + 1) if self.mate[v]})


def exclusive_edges(df: DataFrame, structure: str, a: str, b: str, score: str, optimal: bool = False, accepted: str = "accepted", ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``accepted``: pairs chosen so that no node is in two of one structure.

    ``a`` and ``b`` name the nodes of the two sides (see ``edge_nodes``); a value is the same
    node on either side.  Greedy takes ascending ``score``; optimal maximises the sum of
    max(0.01, 2 - score).  Null nodes or scores and pairs of a node with itself are never
    accepted; repeated rows are edges of their own, of which one at most is accepted.
    """

    names = [c for c in df.columns if c != accepted]

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        out = [False] * len(part)
        structures = part[structure].tolist()
        rows = list(zip(part[a].tolist(), part[b].tolist(), part[score].astype(float).tolist(), strict=True))
        start = 0
        for stop in range(1, len(rows) + 1):
            if stop < len(rows) and structures[stop] == structures[start]:
                continue
            use = [i for i in range(start, stop) if not any(v is None or v != v for v in rows[i])]
            edges = [rows[i][:2] for i in use]
            values = [rows[i][2] for i in use]
            kept = max_weight_matching(edges, [max(0.01, 2 - v) for v in values]) if optimal else greedy(edges, values)
            for i, k in zip(use, kept, strict=True):
                out[i] = k
            start = stop
        return part.assign(**{accepted: out})

    def run(batches):
        held: list[pd.DataFrame] = []
        for batch in batches:
            if len(batch) == 0:
                continue
            codes = batch[structure]
            last = codes.iloc[-1]
            open_ = (codes.isna() if last is None or last != last else codes == last).to_numpy()
            first = 0 if open_.all() else int(np.flatnonzero(open_)[0])
            goes_on = bool(held) and (held[0][structure].iloc[0] == codes.iloc[0] or pd.isna(held[0][structure].iloc[0]) and pd.isna(codes.iloc[0]))
            if first or (held and not goes_on):
                yield choose(pd.concat([*held, batch[:first]], ignore_index=True))
                held = []
            held.append(batch[first:])
        if held:
            yield choose(pd.concat(held, ignore_index=True))

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != accepted)
    placed = df.select(*names).repartition(structure).sortWithinPartitions(structure, score, *ties, a, b)
    return placed.mapInPandas(run, f"{kind}, {accepted} boolean")
