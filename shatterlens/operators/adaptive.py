"""Removal orders in which each choice depends on the removals before it.

Such an order is sequential within a graph, so each (graph, method) is one task of a grouped map
and many run side by side. A kernel sees a graph as neighbour sets over node numbers, which
follow ``ord``, and the labels for its tie rule. After the budget the rest follows in ``ord``.
"""

from __future__ import annotations

import heapq
import math
import multiprocessing
import signal
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, functions as F

from shatterlens.operators.fragmentation import STATES, state_rows
from shatterlens.sources.graphs import _labels


class Graph:
    """A graph within a task: neighbour sets by node number, labels by node number."""

    def __init__(self, labels: Iterable[int], pairs: Iterable[tuple[int, int]]):
        self.labels = [int(x) for x in labels]
        at = {x: i for i, x in enumerate(self.labels)}
        self.near: list[dict[int, None]] = [{} for _ in self.labels]  # keeps the order of insertion
        for u, v in pairs:
            a, b = at[int(u)], at[int(v)]
            if a != b:
                self.near[a][b] = self.near[b][a] = None

    def __len__(self) -> int:
        return len(self.labels)

    def sets(self) -> list[set[int]]:
        return [set(x) for x in self.near]

    def places(self, key: Callable[[int], object], largest: bool) -> list[int]:
        """Place of each node among all by its label's key: the lowest place wins a tie."""
        out = [0] * len(self)
        for place, i in enumerate(sorted(range(len(self)), key=lambda i: key(self.labels[i]), reverse=largest)):
            out[i] = place
        return out


def budget_of(n: int, rate: float | None) -> int:
    return n if rate is None else max(1, min(n, round(n * rate)))


TIES: dict[str, tuple[Callable[[int], object], bool]] = {"largest text": (str, True), "smallest text": (str, False), "largest number": (int, True), "smallest number": (int, False)}


def highest_degree(g: Graph, steps: int, tie: str) -> list[int]:
    """Remove a node of highest residual degree, again and again."""
    return _by_degree(g.sets(), g.places(*TIES[tie]), steps)


def _by_degree(near: list[set[int]], place: list[int], steps: int) -> list[int]:
    """Nodes of highest residual degree in turn, the lowest place first; takes the sets apart."""
    n = len(near)
    at, gone = _inverse(place), [False] * n
    heap = [place[i] - n * len(x) for i, x in enumerate(near)]  # one number: least for the highest degree, then by place
    heapq.heapify(heap)
    out: list[int] = []
    while heap and len(out) < steps:
        d, spot = divmod(heapq.heappop(heap), n)
        i = at[spot]
        if gone[i] or -d != len(near[i]):
            continue  # an older entry of this node
        gone[i] = True
        out.append(i)
        for j in near[i]:
            near[j].discard(i)
            heapq.heappush(heap, place[j] - n * len(near[j]))
        near[i] = set()
    return out


def _inverse(place: list[int]) -> list[int]:
    out = [0] * len(place)
    for i, spot in enumerate(place):
        out[spot] = i
    return out


class _Core:
    """The 2-core of a shrinking graph, kept up to date."""

    def __init__(self, near: list[set[int]]):
        self.near, self.member = near, [True] * len(near)
        self.degree = [len(x) for x in near]
        self.size = len(near)
        self.peel([i for i, d in enumerate(self.degree) if d < 2])

    def drop(self, i: int) -> list[int]:
        """Take a node out of the core; its core neighbours."""
        if not self.member[i]:
            return []
        self.member[i] = False
        self.size -= 1
        hit = [j for j in self.near[i] if self.member[j]]
        for j in hit:
            self.degree[j] -= 1
        return hit

    def peel(self, todo: list[int]) -> set[int]:
        """Drop nodes below degree 2 and what then falls below it; the core nodes that lost a neighbour."""
        touched = set()
        while todo:
            i = todo.pop()
            if self.member[i] and self.degree[i] < 2:
                hit = self.drop(i)
                touched.update(hit)
                todo += hit
        return {j for j in touched if self.member[j]}


def core_first(g: Graph, steps: int, tie: str, within: bool) -> list[int]:
    """Remove the node of the 2-core with the highest degree ``within`` it (else: left in the graph); of the graph once there is no core."""
    near, place = g.sets(), g.places(*TIES[tie])
    n, at = len(near), _inverse(place)
    core = _Core(near)
    member = core.member
    value = lambda i: core.degree[i] if within else len(near[i])
    inner = [place[i] - n * value(i) for i in range(n) if member[i]]  # as in _by_degree
    heapq.heapify(inner)
    out: list[int] = []
    while core.size and len(out) < steps:
        d, spot = divmod(heapq.heappop(inner), n)
        i = at[spot]
        if not member[i] or -d != value(i):
            continue
        out.append(i)
        hit = core.drop(i)
        lost = list(near[i])
        for j in lost:
            near[j].discard(i)
        near[i] = set()
        changed = core.peel(list(hit)) | {j for j in (hit if within else lost) if member[j]}
        for j in changed:
            heapq.heappush(inner, place[j] - n * value(j))
    if len(out) < min(steps, n):  # a core that is gone stays so
        taken = set(out)
        rest = [i for i in at if i not in taken]
        number = {i: k for k, i in enumerate(rest)}
        left = _by_degree([{number[j] for j in near[i]} for i in rest], list(range(len(rest))), steps - len(out))
        out += [rest[k] for k in left]
    return out


def _component(near: list[set[int]], start: int) -> set[int]:
    seen, todo = {start}, [start]
    while todo:
        for j in near[todo.pop()]:
            if j not in seen:
                seen.add(j)
                todo.append(j)
    return seen


class _Parts:
    """The components of a shrinking graph: part of each node, size and least label of each part.

    When a node goes, searches start from its neighbours in turn and join where they meet; once one is left, the
    others that ran out are the new parts. So a step costs about the size of what breaks off.
    """

    def __init__(self, g: Graph):
        self.near, self.label = g.sets(), g.labels
        self.part_of, self.everywhere = [-1] * len(self.near), [True] * len(self.near)
        self.size: list[int] = []
        self.labels: list[list[tuple[int, int]]] = []  # heaps of (label, node)
        self.largest: list[tuple[int, int, int]] = []  # heap of (-size, -least label, part)
        for i in range(len(self.near)):
            if self.part_of[i] < 0:
                self._add(list(_component(self.near, i)))

    def _add(self, nodes: list[int]) -> int:
        part = len(self.size)
        for i in nodes:
            self.part_of[i] = part
        self.size.append(len(nodes))
        self.labels.append(sorted((self.label[i], i) for i in nodes))
        self._rank(part)
        return part

    def _rank(self, part: int) -> None:
        if self.size[part]:
            heapq.heappush(self.largest, (-self.size[part], -self.first(part)[0], part))

    def first(self, part: int) -> tuple[int, int]:
        """Least label of a part, and its node."""
        heap = self.labels[part]
        while self.part_of[heap[0][1]] != part:
            heapq.heappop(heap)
        return heap[0]

    def top(self) -> int:
        """The largest part; of equal ones the one with the larger least label; -1 without nodes."""
        while self.largest:
            size, least, part = self.largest[0]
            if -size == self.size[part] and -least == self.first(part)[0]:
                return part
            heapq.heappop(self.largest)
        return -1

    def remove(self, i: int, whole: list[bool] | None = None, core: list[bool] | None = None, heads: list[int] | None = None) -> list[int]:
        """Take a node out; the new parts. Neighbours that are ``whole`` are known to stay together, apart from the others.

        With ``core``, the 2-core that i was in, only paths within it are looked at: the other neighbours are trees of their own.
        With ``heads`` nothing is looked for: what breaks off are the pieces of these nodes.
        """
        part, near = self.part_of[i], self.near
        ends = list(near[i])
        for j in ends:
            near[j].discard(i)
        near[i] = set()
        self.part_of[i] = -1
        self.size[part] -= 1
        new = []
        if whole is not None:
            found = self._broken([j for j in ends if not whole[j]])
        elif heads is not None:
            found = self._broken(heads)
        elif core is not None:
            heads = [nodes[0] for nodes in self._pieces([j for j in ends if core[j]], core)]
            found = self._broken(heads + [j for j in ends if not core[j]])
        else:
            found = self._pieces(ends)
        for nodes in found:
            self.size[part] -= len(nodes)
            new.append(self._add(nodes))
        self._rank(part)
        return new

    def _broken(self, ends: list[int]) -> list[list[int]]:
        """Nodes of all pieces that hold one of ``ends``."""
        seen, out = set(), []
        for j in ends:
            if j not in seen:
                seen |= (piece := _component(self.near, j))
                out.append(list(piece))
        return out

    def _pieces(self, ends: list[int], inside: list[bool] | None = None) -> list[list[int]]:
        """Nodes of all pieces that hold one of ``ends``, but for one piece that may be the rest; only of those ``inside``."""
        near = self.near
        inside = inside or self.everywhere
        found = {j: k for k, j in enumerate(ends)}
        above = list(range(len(ends)))
        nodes = [[j] for j in ends]
        queue = [deque([j]) for j in ends]
        active, done = list(range(len(ends))), []

        def root(k: int) -> int:
            while above[k] != k:
                above[k] = above[above[k]]
                k = above[k]
            return k

        while len(active) > 1:
            for k in active:
                if above[k] != k:
                    continue
                if not queue[k]:
                    done.append(nodes[k])
                    above[k] = -1
                    break
                me = k
                for j in near[queue[k].popleft()]:
                    other = found.get(j)
                    if other is None:
                        if not inside[j]:
                            continue
                        found[j] = me
                        nodes[me].append(j)
                        queue[me].append(j)
                    elif (other := root(other)) != me:
                        if len(nodes[other]) > len(nodes[me]):
                            me, other = other, me
                        above[other] = me
                        nodes[me] += nodes[other]
                        queue[me] += queue[other]
                        nodes[other], queue[other] = [], deque()
            active = [k for k in active if above[k] == k]
        return done


class _Rooted:
    """Proof that the 2-core of a part stays in one piece as nodes go, without a search at each.

    A root of the part has the lowest place, and every other node of the core a neighbour in it with a lower place, so that a way
    leads down to the root. When nodes go, those that lost the last lower neighbour, and those that then have none, are placed
    again above neighbours that kept theirs; what cannot be placed is cut off from the root.
    """

    #: Parts of fewer nodes are searched.
    LEAST = 500

    def __init__(self, near: list[set[int]], core: _Core):
        self.near, self.core, self.place = near, core, [0] * len(near)
        self.root: dict[int, int] = {}  # by part

    def open(self, part: int, nodes: set[int], label: list[int]) -> None:
        """Places of a part's core by distance from a root that should stay long: neither removed early nor peeled off soon."""
        near, member, place = self.near, self.core.member, self.place
        root = min(nodes, key=lambda i: (abs(self.core.degree[i] - 4), label[i]))
        self.root[part], place[root] = root, 0
        seen, queue = {root}, deque([root])
        while queue:
            i = queue.popleft()
            for j in near[i]:
                if member[j] and j not in seen:
                    seen.add(j)
                    place[j] = place[i] + 1
                    queue.append(j)

    def cut_off(self, root: int, todo: list[int]) -> list[int]:
        """Nodes of the core that are no longer connected with the root, after the nodes of ``todo`` lost neighbours in it."""
        near, member, place = self.near, self.core.member, self.place
        loose: set[int] = set()
        while todo:
            j = todo.pop()
            if member[j] and j != root and j not in loose:
                at = place[j]
                for k in near[j]:
                    if place[k] < at and member[k] and k not in loose:
                        break
                else:
                    loose.add(j)
                    todo += [k for k in near[j] if member[k] and place[k] > at]
        heap = [(place[k] + 1, j) for j in loose for k in near[j] if member[k] and k not in loose]
        heapq.heapify(heap)
        while heap and loose:
            at, j = heapq.heappop(heap)
            if j in loose:
                loose.discard(j)
                place[j] = at
                for k in near[j]:
                    if k in loose:
                        heapq.heappush(heap, (at + 1, k))
        return list(loose)

    def hangs(self, start: int, gone: int) -> bool:
        """Whether a node outside the core is connected with it, but for ways over ``gone``."""
        seen, todo = {gone, start}, [start]
        while todo:
            for j in self.near[todo.pop()]:
                if self.core.member[j]:
                    return True
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return False


def decycling(g: Graph, steps: int) -> list[int]:
    """Highest degree within the 2-core of the largest component, or within it if it is a tree; largest label wins."""
    parts = _Parts(g)
    near, label, part_of = parts.near, parts.label, parts.part_of
    core = _Core(near)
    rooted = _Rooted(near, core)
    n, place = len(near), g.places(int, True)
    at = _inverse(place)
    inner: list[list[int]] = []  # of each part: heaps as in _by_degree within the core, and in all once it is a tree
    outer: list[list[int] | None] = []

    def open_part(nodes: Iterable[int]) -> None:
        inner.append(sorted(place[i] - n * core.degree[i] for i in nodes if core.member[i]))
        outer.append(None)

    members: dict[int, list[int]] = {}
    for i, part in enumerate(part_of):
        members.setdefault(part, []).append(i)
    for part in range(len(parts.size)):
        open_part(members[part])
    out: list[int] = []
    while len(out) < steps and (part := parts.top()) >= 0:
        heap = inner[part]
        while heap:
            d, spot = divmod(heap[0], n)
            i = at[spot]
            if core.member[i] and part_of[i] == part and -d == core.degree[i]:
                break
            heapq.heappop(heap)
        if not heap:
            heap = outer[part]
            if heap is None:
                heap = outer[part] = sorted(place[j] - n * len(near[j]) for _, j in parts.labels[part] if part_of[j] == part)
            while True:
                d, spot = divmod(heap[0], n)
                i = at[spot]
                if part_of[i] == part and -d == len(near[i]):
                    break
                heapq.heappop(heap)
        elif part not in rooted.root and parts.size[part] >= rooted.LEAST:
            rooted.open(part, {j for j in (at[x % n] for x in heap) if core.member[j] and part_of[j] == part}, label)
        out.append(i)
        lost, hit, root = list(near[i]), core.drop(i), rooted.root.get(part, i)
        if root == i:
            rooted.root.pop(part, None)
            broken = parts.remove(i, core=core.member if hit else None)
            changed = core.peel(list(hit)) | {j for j in hit if core.member[j]}
        else:
            changed = core.peel(list(hit)) | {j for j in hit if core.member[j]}
            if core.member[root]:
                trees = set(lost).difference(hit).union(j for j in hit if not core.member[j] and not rooted.hangs(j, i))
                broken = parts.remove(i, heads=rooted.cut_off(root, list(changed)) + list(trees))
            else:
                del rooted.root[part]
                broken = parts.remove(i)
        for new in broken:
            open_part([j for _, j in parts.labels[new]])
        for j in changed:
            heapq.heappush(inner[part_of[j]], place[j] - n * core.degree[j])
        for j in lost:
            if (heap := outer[part_of[j]]) is not None:
                heapq.heappush(heap, place[j] - n * len(near[j]))
    return out


def split_sizes(near: list[set[int]], part: Iterable[int]) -> dict[int, int]:
    """Largest piece left by each articulation point of a connected part: one depth-first walk."""
    root = next(iter(part))
    n = len(near)
    entry, low, size, cut, worst = [0] * n, [0] * n, [1] * n, [0] * n, [0] * n
    entry[root] = low[root] = clock = 1
    stack, above, walks = [root], [-1] * n, [iter(near[root])]
    branches, points = 0, []
    while stack:
        i = stack[-1]
        up, least = above[i], low[i]
        for j in walks[-1]:
            seen = entry[j]
            if not seen:
                clock += 1
                entry[j] = low[j] = clock
                above[j] = i
                low[i] = least
                stack.append(j)
                walks.append(iter(near[j]))
                break
            if seen < least and j != up:
                least = seen
        else:
            low[i] = least
            stack.pop()
            walks.pop()
            if up < 0:
                break
            if least < low[up]:
                low[up] = least
            size[up] += size[i]
            branches += up == root
            if least >= entry[up]:
                if not worst[up]:
                    points.append(up)
                cut[up] += size[i]
                worst[up] = max(worst[up], size[i])
    return {i: max(worst[i], clock - 1 - cut[i]) for i in points if i != root or branches > 1}


def brandes(near: list[set[int]], sources: Iterable[int], nodes: Iterable[int]) -> dict[int, float]:
    """Sum over ``sources`` of the share of shortest paths through each node (both directions count)."""
    total = dict.fromkeys(nodes, 0.0)
    for s in sources:
        far, paths, order, before = {s: 0}, {s: 1.0}, [], {s: []}
        todo = deque([s])
        while todo:
            i = todo.popleft()
            order.append(i)
            for j in near[i]:
                if j not in far:
                    far[j], paths[j], before[j] = far[i] + 1, 0.0, []
                    todo.append(j)
                if far[j] == far[i] + 1:
                    paths[j] += paths[i]
                    before[j].append(i)
        share = dict.fromkeys(order, 0.0)
        for i in reversed(order):
            for j in before[i]:
                share[j] += paths[j] / paths[i] * (1 + share[i])
            if i != s:
                total[i] += share[i]
    return total


@dataclass
class _Block:
    """The block kept of a component: what hangs from its nodes as a heap of (-hang, label, node), its two poles, its size at first."""

    heap: list[tuple[int, int, int]]
    poles: tuple[int, int]
    size: int


class _Cuts:
    """The best cuts of the components of a shrinking graph, without a walk through all of a component for each.

    Of a component a block is kept (connected without any one of its nodes) none of whose nodes cuts off more than half from it. Then
    the node that cuts off most is in the block, and leaves the smallest largest piece. Places prove a block: its poles are
    adjacent, every other node has a neighbour in it with a lower place and one with a higher place. When a node goes, those that lost
    the last of either are placed again on paths between two nodes of the block; what has only one way into it hangs from there.
    """

    #: Blocks of fewer nodes are not kept.
    LEAST = 9

    def __init__(self, near: list[set[int]], label: list[int]):
        n = len(near)
        self.near, self.label = near, label
        self.kept: dict[int, _Block] = {}  # by part
        self.inside, self.place, self.hang = [False] * n, [0.0] * n, [0] * n
        self.entry, self.low, self.size, self.cut, self.worst, self.above = ([0] * n for _ in range(6))

    def best(self, part: int, start: int, total: int) -> int:
        """The node of a part of ``total`` nodes, one of them ``start``, that leaves the smallest largest piece, the smallest label first; -1 if none cuts it."""
        block = self.kept.get(part)
        if block is None or 2 * self._most(block) >= total:
            self.kept.pop(part, None)
            found, block = self._walk(start)
            if block is None:
                return found
            self.kept[part] = block
        return block.heap[0][2] if self._most(block) else -1

    def _most(self, block: _Block) -> int:
        heap = block.heap
        while heap and not (self.inside[heap[0][2]] and -heap[0][0] == self.hang[heap[0][2]]):
            heapq.heappop(heap)
        return -heap[0][0] if heap else 0

    def _walk(self, root: int) -> tuple[int, _Block | None]:
        """The best cut of the component of ``root`` by a depth-first walk, and the block to keep of it."""
        near, entry, low, size, cut, worst, above = self.near, self.entry, self.low, self.size, self.cut, self.worst, self.above
        order, blocks = self._visit(root, near), []
        total, inside = len(order), self.inside
        for i in order:
            inside[i], size[i], cut[i], worst[i] = False, 1, 0, 0
        open_nodes: dict[int, list[int]] = {}  # of a node: those below it in its own block
        for i in reversed(order[1:]):
            up = above[i]
            size[up] += size[i]
            members = open_nodes.pop(i, [])
            members.append(i)
            if low[i] >= entry[up]:
                cut[up] += size[i]
                worst[up] = max(worst[up], size[i])
                blocks.append((up, size[i], members))
            elif up in open_nodes:
                few, many = sorted((open_nodes[up], members), key=len)
                many += few
                open_nodes[up] = many
            else:
                open_nodes[up] = members
        for i in order:
            entry[i] = 0
        central, most = None, total
        for up, below, members in blocks:
            if len(members) + 1 >= self.LEAST and (hung := max(total - 1 - below, max(cut[i] for i in members))) < most:
                central, most = (up, below, members), hung
        if central is None or 2 * most >= total:
            points = {up for up, _, _ in blocks if up != root or worst[up] < total - 1}
            return min(points, key=lambda i: (max(worst[i], total - 1 - cut[i]), self.label[i]), default=-1), None
        up, below, members = central
        for i in members:
            inside[i], self.hang[i] = True, cut[i]
        inside[up], self.hang[up] = True, total - 1 - below
        members.append(up)
        return -1, self._placed(members)

    def _visit(self, root: int, near: list[set[int]] | dict[int, list[int]]) -> list[int]:
        """The nodes reached, in the order of a depth-first walk; fills entry (from 1), low and above."""
        entry, low, above = self.entry, self.low, self.above
        entry[root] = low[root] = 1
        above[root] = -1
        order, stack, walks = [root], [root], [iter(near[root])]
        while stack:
            i = stack[-1]
            up, least = above[i], low[i]
            for j in walks[-1]:
                seen = entry[j]
                if not seen:
                    order.append(j)
                    entry[j] = low[j] = len(order)
                    above[j] = i
                    low[i] = least
                    stack.append(j)
                    walks.append(iter(near[j]))
                    break
                if seen < least and j != up:
                    least = seen
            else:
                low[i] = least
                stack.pop()
                walks.pop()
                if up >= 0 and least < low[up]:
                    low[up] = least
        return order

    def _placed(self, members: list[int]) -> _Block:
        """Places of a block's nodes: each is put beside its parent in a depth-first walk, on the side of the node it leads back to (Tarjan's st-numbering)."""
        hang, inside, label = self.hang, self.inside, self.label
        near = {i: [j for j in self.near[i] if inside[j]] for i in members}
        least = lambda i: (hang[i], -len(near[i]), label[i])  # noqa: E731  # poles should stay long
        s = min(members, key=least)
        t = min(near[s], key=least)
        near[s].sort(key=lambda j: j != t)
        order = self._visit(s, near)
        entry, low, above = self.entry, self.low, self.above
        after, before, minus = {s: t}, {t: s}, {s: True}
        for i in order[2:]:
            up = above[i]
            if minus.get(order[low[i] - 1], False):
                a, b = before[up], up
                minus[up] = False
            else:
                a, b = up, after[up]
                minus[up] = True
            after[a], before[i], after[i], before[b] = i, a, b, i
        for i in order:
            entry[i] = 0
        i = s
        for k in range(len(order)):
            self.place[i] = float(k)
            i = after.get(i, -1)
        heap = [(-hang[i], label[i], i) for i in members if hang[i]]
        heapq.heapify(heap)
        return _Block(heap, (s, t), len(members))

    def removed(self, i: int, ends: list[int], block: _Block, part_of: list[int]) -> None:
        """Keep the block without a node that is gone, the neighbours of which were ``ends``, as long as its poles stay and its places can be mended."""
        self.inside[i] = False
        if i not in block.poles and self._mend(block, [j for j in ends if self.inside[j]]):
            self.kept[part_of[block.poles[0]]] = block

    def _mend(self, block: _Block, todo: list[int]) -> bool:
        near, inside, place, hang = self.near, self.inside, self.place, self.hang
        loose = []
        while todo:
            j = todo.pop()
            if not inside[j] or j in block.poles:
                continue
            at, lower, higher = place[j], False, False
            for k in near[j]:
                if inside[k]:
                    if place[k] < at:
                        lower = True
                    elif place[k] > at:
                        higher = True
                    if lower and higher:
                        break
            else:
                inside[j] = False
                loose.append(j)
                todo += [k for k in near[j] if inside[k]]
        if len(loose) > 64 + block.size // 16:
            return False  # a new walk is cheaper
        left = set(loose)
        while loose:
            start = loose[-1]
            if start not in left:
                loose.pop()
                continue
            # A search through loose nodes for two ways into the block; it ends where the second is met.
            came, queue, ends = {start: -1}, deque([start]), []
            while queue:
                j = queue.popleft()
                ways = [k for k in near[j] if inside[k]]
                if ways:
                    if not ends:
                        ends.append((ways[0], j))
                    if other := [k for k in ways if k != ends[0][0]]:
                        ends.append((other[0], j))
                        break
                for k in near[j]:
                    if k in left and k not in came:
                        came[k] = j
                        queue.append(k)
            if len(ends) == 1:
                top = ends[0][0]
                hang[top] += sum(hang[k] + 1 for k in came)
                heapq.heappush(block.heap, (-hang[top], self.label[top], top))
                left.difference_update(came)
                continue
            (low, first), (high, last) = ends
            path, back = [first], [last]
            while came[path[-1]] >= 0:
                path.append(came[path[-1]])
            while came[back[-1]] >= 0:
                back.append(came[back[-1]])
            while len(path) > 1 and len(back) > 1 and path[-2] == back[-2]:
                path.pop()
                back.pop()
            path += back[-2::-1]
            if place[low] > place[high]:
                low, high = high, low
                path.reverse()
            at, step = place[low], (place[high] - place[low]) / (len(path) + 1)
            for k, j in enumerate(path, 1):
                place[j], before = place[low] + k * step, at
                at = place[j]
                if not before < at < place[high]:
                    return False  # numbers are not fine enough
                inside[j] = True
            left.difference_update(path)
        return True


def articulation_first(g: Graph, steps: int) -> list[int]:
    """The articulation point of the largest component that leaves the smallest largest piece; highest betweenness where there is none. Smallest label wins."""
    parts = _Parts(g)
    near, label = parts.near, parts.label
    cuts = _Cuts(near, label)
    out: list[int] = []
    while len(out) < steps and (part := parts.top()) >= 0:
        start = parts.first(part)[1]
        i = cuts.best(part, start, parts.size[part]) if parts.size[part] > 1 else start
        if i < 0:
            nodes = _component(near, start)
            between = brandes(near, nodes, nodes)
            i = min(nodes, key=lambda i: (-round(between[i], 9), label[i]))
        out.append(i)
        ends, block = list(near[i]), cuts.kept.pop(part, None)
        parts.remove(i, cuts.inside if block else None)
        if block:
            cuts.removed(i, ends, block, parts.part_of)
    return out


def core_numbers(g: Graph) -> list[int]:
    """Core number of each node."""
    near = g.near
    degree = [len(x) for x in near]
    heap = [(d, i) for i, d in enumerate(degree)]
    heapq.heapify(heap)
    core, level = [-1] * len(near), 0
    while heap:
        d, i = heapq.heappop(heap)
        if core[i] >= 0 or d != degree[i]:
            continue
        level = max(level, d)
        core[i] = level
        for j in near[i]:
            if core[j] < 0:
                degree[j] -= 1
                heapq.heappush(heap, (degree[j], j))
    return core


@dataclass(frozen=True)
class Blend:
    """Weights of the parametric score and how far a removal refreshes it."""

    clade: str = "degree_core"
    w_split: float = 1.0
    w_bridge_mult: float = 1.0
    w_degree: float = 1.0
    w_nds: float = 0.0
    w_core: float = 0.0
    w_comp: float = 0.0
    w_bridge_edges: float = 0.0
    split_power: float = 1.0
    degree_power: float = 1.0
    nds_power: float = 1.0
    core_power: float = 0.5
    update_radius: int = 1
    use_component: bool = False
    comp_refresh: int = 25
    tie_degree: bool = True


#: The published reference blend, and the plain degree root.
REFERENCE_BLEND = Blend(clade="reference", w_split=2.10, w_bridge_mult=2.20, w_degree=0.75, w_nds=0.45, w_core=0.18, update_radius=2)
ROOT_BLEND = Blend(clade="hda_root", w_split=0.0, w_bridge_mult=0.0, w_degree=1.0, update_radius=0)


def softened(value: float, power: float) -> float:
    value = max(0.0, value)
    if power == 0.5:
        return math.sqrt(value + 1)
    return math.log1p(value if power == 1 else value**power)


class _Blended:
    """State of the parametric solver; sums of nodes that a removal does not touch stay as they were."""

    def __init__(self, g: Graph, blend: Blend):
        self.near, self.blend, n = g.sets(), blend, len(g)
        self.core = core_numbers(g)
        self.sum = [sum(len(self.near[j]) for j in x) for x in self.near]
        self.triangles = [sum(len(x & self.near[j]) for j in x) // 2 for x in self.near]
        self.part = [n] * n
        self.bridges = [self._bridges(i) for i in range(n)] if blend.w_bridge_edges else [0] * n
        self.gone = [False] * n
        self.measure()

    def _bridges(self, i: int) -> int:
        return sum(not self.near[i] & self.near[j] for j in self.near[i])

    def measure(self) -> None:
        """Sizes of the components as they are now."""
        if self.blend.use_component:
            seen: set[int] = set()
            for i in range(len(self.near)):
                if i not in seen and not self.gone[i]:
                    part = _component(self.near, i)
                    seen |= part
                    for j in part:
                        self.part[j] = len(part)

    def score(self, i: int) -> float:
        b, d = self.blend, len(self.near[i])
        if d == 0:
            return -1e30
        pairs = d * (d - 1) / 2
        closed = min(self.triangles[i], pairs)
        openness = 1 - closed / pairs if pairs else 0.0
        value = b.w_split * math.log1p((pairs - closed) ** b.split_power * (1 + b.w_bridge_mult * openness))
        value += b.w_degree * softened(d, b.degree_power) + b.w_nds * softened(self.sum[i], b.nds_power)
        value += b.w_core * (self.core[i] + 1.0) ** b.core_power + b.w_bridge_edges * math.log1p(self.bridges[i])
        return value + (b.w_comp * math.log1p(self.part[i]) if b.use_component else 0.0)

    def remove(self, i: int) -> set[int]:
        """Take a node out; the nodes to score again."""
        hit, total, lost = self.near[i], self.sum, len(self.near[i])
        for j in hit:
            self.triangles[j] = max(0, self.triangles[j] - len(self.near[j] & hit))
        for j in hit:
            self.near[j].discard(i)
        self.near[i], self.gone[i] = set(), True
        again = set(hit)
        if self.blend.update_radius >= 2:
            for j in hit:
                again |= self.near[j]
                total[j] -= lost
                for k in self.near[j]:
                    total[k] -= 1  # j is of one degree less
        else:
            for j in again:
                total[j] = sum(len(self.near[k]) for k in self.near[j])
        if self.blend.w_bridge_edges:
            for j in again:
                self.bridges[j] = self._bridges(j)
        return again


def blended(g: Graph, steps: int, blend: Blend) -> list[int]:
    """Remove the node of highest blended score; ties by degree, then by least number."""
    if blend.w_degree > 0 and blend.degree_power == 1 and not (blend.w_split or blend.w_nds or blend.w_core or blend.w_comp or blend.w_bridge_edges):
        return _by_degree(g.sets(), list(range(len(g))), steps)  # the score rises with the degree and with nothing else
    s = _Blended(g, blend)
    latest = [0] * len(g)
    entry = lambda i, by_degree: (-s.score(i), -len(s.near[i]) if by_degree else 0, i, latest[i])
    heap = [entry(i, blend.tie_degree) for i in range(len(g))]
    heapq.heapify(heap)
    out: list[int] = []
    while len(out) < steps:
        if blend.use_component and out and len(out) % max(1, blend.comp_refresh) == 0:
            s.measure()
            for i in range(len(g)):
                if not s.gone[i]:
                    latest[i] += 1
                    heapq.heappush(heap, entry(i, True))
        i = -1
        while heap:
            *_, i, version = heapq.heappop(heap)
            if not s.gone[i] and version == latest[i]:
                break
        out.append(i)
        for j in s.remove(i):
            latest[j] += 1
            heapq.heappush(heap, entry(j, blend.tie_degree))
    return out


@dataclass(frozen=True)
class Proxy:
    """A program of the proxy family: weights, caps on scans (-1 for none) and whether components are counted."""

    neighbour: float
    weak: float
    boundary: float
    redundancy: float
    phase: float
    cap_neighbours: int
    cap_two_hop: int
    rescan: bool
    valid: bool = True
    group: str = ""
    index: int = 0
    family: str = field(default="")


PROXY_FAMILIES = {"R/GCC-only": "degree-backbone", "Absolute-cNBI": "free-boundary-scan", "Relative-Free": "free-boundary-scan", "Relative-Delta-cNBI": "relative-local-mix", "CostAware-Free": "relative-local-mix", "Bounded-Guided": "bounded-local-policy"}
#: Places of programs that are no valid candidate.
INVALID_PROXIES = {"Relative-Free": {7, 29, 53, 71, 89}, "CostAware-Free": {31, 77}}


def proxies(group: str, n: int) -> list[Proxy]:
    """The ``n`` programs of a group; parameters cycle with period 25."""
    family = PROXY_FAMILIES[group]
    # Parameters of the published families by the place r in the cycle.
    out = []
    for i in range(n):
        r = i % 25
        if family == "degree-backbone":
            p = Proxy(0.005 * (r % 5), 0.0, 0.0, 0.0, 0.05 * (r % 3), 8 + 4 * (r % 5), 0, False)
        elif family == "free-boundary-scan":
            p = Proxy(0.02 + 0.01 * (r % 5), 0.10 + 0.05 * (r % 4), 0.0015 + 0.0005 * (r % 6), 0.0 if r % 3 else 0.02, 0.15 * (r % 4), 64 if r % 2 else -1, 32 if r % 4 else -1, r % 10 == 0)
        elif family == "relative-local-mix":
            p = Proxy(0.015 + 0.006 * (r % 5), 0.08 + 0.04 * (r % 4), 0.0008 + 0.0004 * (r % 5), 0.03 + 0.01 * (r % 4), 0.10 * (r % 4), 16 + 8 * (r % 4), 12 + 8 * (r % 4), r % 18 == 0)
        else:
            p = Proxy(0.010 + 0.004 * (r % 5), 0.06 + 0.03 * (r % 4), 0.0005 + 0.0002 * (r % 5), 0.04 + 0.01 * (r % 5), 0.06 * (r % 4), 8 + 4 * (r % 4), 6 + 4 * (r % 4), False)
        out.append(replace(p, valid=i not in INVALID_PROXIES.get(group, ()), group=group, index=i, family=family))
    return out


def proxy_order(g: Graph, steps: int, p: Proxy) -> list[int]:
    """Rescan all nodes at each step; caps cut lists in the order edges were inserted; largest text wins ties."""
    near = [dict(x) for x in g.near]
    left = set(range(len(near)))
    text = [str(x) for x in g.labels]
    out: list[int] = []
    while left and len(out) < steps:
        count = 0
        if p.rescan:
            rest = set(left)
            while rest:
                rest -= _component([set(x) for x in near], next(iter(rest)))
                count += 1
        phase = 1 + p.phase * len(out) / max(1, len(near))

        def value(i: int, phase: float = phase, count: int = count) -> float:
            scan = list(near[i])[: p.cap_neighbours if p.cap_neighbours >= 0 else None]
            around = sum(len(near[j]) for j in scan)
            weak = sum(len(near[j]) <= 2 for j in scan)
            boundary = 0
            for j in scan:
                others = [k for k in near[j] if k != i]
                boundary += sum(len(near[k]) for k in (others if p.cap_two_hop < 0 else others[: max(1, p.cap_two_hop)]))
            closed = sum(scan[b] in near[scan[a]] for a in range(len(scan)) for b in range(a + 1, len(scan)))
            return phase * len(near[i]) + p.neighbour * around + p.weak * weak + p.boundary * boundary - p.redundancy * closed + 0.01 * count

        best = max(left, key=lambda i: (value(i), text[i]))
        out.append(best)
        left.discard(best)
        for j in near[best]:
            near[j].pop(best, None)
        near[best] = {}
    return out


#: Adaptive methods by name: kernel(graph, steps).
METHODS: dict[str, Callable[[Graph, int], list[int]]] = {
    "hda_original": lambda g, k: highest_degree(g, k, "largest text"),
    "hda_fast": lambda g, k: highest_degree(g, k, "smallest text"),
    "hda_number": lambda g, k: highest_degree(g, k, "largest number"),
    "corehd_original": lambda g, k: core_first(g, k, "largest number", within=True),
    "corehd_fast": lambda g, k: core_first(g, k, "smallest text", within=False),
    "decycling": decycling,
    "articulation": articulation_first,
    "blend_reference": lambda g, k: blended(g, k, REFERENCE_BLEND),
    "blend_root": lambda g, k: blended(g, k, ROOT_BLEND),
}


def register(name: str, kernel: Callable[[Graph, int], list[int]]) -> None:
    """Add a method of your own to the allow-list; text is never run as a program."""
    if not name.isidentifier():
        raise ValueError(f"{name!r} is no identifier")
    METHODS[name] = kernel


@contextmanager
def deadline(seconds: float | None) -> Iterator[None]:
    """Raise TimeoutError in the block after so many seconds; None for no limit."""

    def stop(*_):
        raise TimeoutError(f"after {seconds:g} s")

    if seconds:
        before = signal.signal(signal.SIGALRM, stop)
        signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        if seconds:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)


def isolated(kernel: Callable[[Graph, int], list[int]], g: Graph, steps: int, limit_s: float | None) -> list[int]:
    """The kernel's order from a process of its own: native code is stopped at the limit too, and a crash is an error and not the worker's end.

    TimeoutError after ``limit_s``, RuntimeError if the process died or raised.
    """
    context = multiprocessing.get_context("fork")  # the kernel need not be picklable
    ours, theirs = context.Pipe(duplex=False)

    def work() -> None:
        ours.close()
        try:
            theirs.send((True, [int(i) for i in kernel(g, steps)]))
        except BaseException as e:  # all of it is the program's
            theirs.send((False, f"{type(e).__name__}: {e}"))

    process = context.Process(target=work, daemon=True)
    process.start()
    theirs.close()
    try:
        if not ours.poll(limit_s):
            raise TimeoutError(f"after {limit_s:g} s")
        fine, found = ours.recv()
    except EOFError:
        process.join(1)
        raise RuntimeError(f"the process died with code {process.exitcode}") from None
    finally:
        process.kill()
        process.join()
        ours.close()
    if not fine:
        raise RuntimeError(found)
    return found


def _arrange(pdf: pd.DataFrame) -> Graph:
    nodes = pdf[pdf["v"].isna()].sort_values("ord")
    edges = pdf[pdf["v"].notna()].sort_values(["ord", "u", "v"])
    return Graph(nodes["u"], zip(edges["u"], edges["v"].astype("int64")))


def adaptive_orders(edges: DataFrame, nodes: DataFrame, methods: dict[str, Callable[[Graph, int], list[int]]], rate: float | None, timed: bool = False, limit_s: float | None = None, apart: bool = False) -> DataFrame:
    """(graph, method, step, node[, seconds, error]) of each method on each graph; one task per pair.

    With ``apart`` each pair runs in a process of its own.

    A method that fails, or takes more than ``limit_s``, gives one row with step 0 and its error, if ``timed``; else it raises.
    Nodes that a method leaves out follow in ``ord``; unknown and repeated ones are dropped.
    ``seconds`` is the time of the order alone.
    """

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        graph, method = pdf["graph"].iat[0], pdf["method"].iat[0]
        g = _arrange(pdf)
        started, error = time.perf_counter(), None
        try:
            if apart:
                chosen = isolated(methods[method], g, budget_of(len(g), rate), limit_s)
            else:
                with deadline(limit_s):
                    chosen = methods[method](g, budget_of(len(g), rate))
        except Exception as e:  # the row says so
            if not timed:
                raise
            chosen, error = [], f"{type(e).__name__}: {e}"
        seconds = time.perf_counter() - started
        order = _permutation(chosen, len(g)) if error is None else []
        out = pd.DataFrame({"graph": graph, "method": method, "step": np.arange(1, len(order) + 1, dtype=np.int32), "node": np.array([g.labels[i] for i in order], dtype=np.int64)})
        if timed:
            out = out.assign(seconds=seconds, error=None)
            if error:
                out = pd.DataFrame([(graph, method, 0, None, seconds, error)], columns=["graph", "method", "step", "node", "seconds", "error"])
        return out

    schema = "graph string, method string, step int, node bigint" + (", seconds double, error string" if timed else "")
    return _for_methods(edges, nodes, methods).applyInPandas(kernel, schema)


def adaptive_states(edges: DataFrame, nodes: DataFrame, methods: dict[str, Callable[[Graph, int], list[int]]], rate: float | None) -> DataFrame:
    """``trajectories`` of ``adaptive_orders``, each worked out in the task of its order: orders are neither written nor joined with the edges again."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        graph, method = pdf["graph"].iat[0], pdf["method"].iat[0]
        g = _arrange(pdf)
        n, most = len(g), budget_of(len(g), rate)
        place = np.empty(n, dtype=np.int64)
        place[_permutation(methods[method](g, most), n)] = np.arange(1, n + 1)
        labels, real = np.array(g.labels), pdf[pdf["v"].notna()]
        by_label = np.argsort(labels)
        a, b = (place[by_label[np.searchsorted(labels, real[c].to_numpy(np.int64), sorter=by_label)]] for c in ("u", "v"))
        return state_rows(graph, method, n, most, np.minimum(a, b), np.maximum(a, b))

    return _for_methods(edges, nodes, methods).applyInPandas(kernel, STATES)


def _permutation(chosen: Iterable[int], n: int) -> list[int]:
    """All node numbers: the known ones of ``chosen`` once each, then the others."""
    return list(dict.fromkeys([*[i for i in chosen if 0 <= i < n], *range(n)]))


def _for_methods(edges: DataFrame, nodes: DataFrame, methods: dict) -> GroupedData:
    """The rows that ``_arrange`` takes, grouped by graph and method."""
    both = nodes.select("graph", F.col("node").alias("u"), F.lit(None).cast("bigint").alias("v"), "ord").unionByName(
        edges.join(nodes.select("graph", F.col("node").alias("u"), "ord"), ["graph", "u"]).select("graph", "u", "v", "ord")
    )
    names = F.explode(F.array(*[F.lit(m) for m in methods]))
    # A number of partitions that is asked for stays: small tasks would be joined to one that works off all methods in turn.
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * len(methods))
    return both.withColumn("method", names).repartition(tasks, "graph", "method").groupBy("graph", "method")


def shortest_path_shares(start: np.ndarray, near: np.ndarray, sources: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """``brandes`` for many sources at once: neighbours of node i are near[start[i] : start[i + 1]]; one array operation per distance.

    With ``weight`` node i stands for so many ends of paths.
    """
    n, b = len(start) - 1, len(sources)
    weight = np.ones(n) if weight is None else weight
    home = np.arange(b) * n + sources
    paths, seen = np.zeros(b * n), np.zeros(b * n, dtype=bool)
    paths[home], seen[home] = 1.0, True
    front, steps = home, []
    while len(front):
        node = front % n
        count = start[node + 1] - start[node]
        upto = np.cumsum(count)
        tail = np.repeat(front, count)
        head = np.repeat(front - node, count) + near[np.arange(len(tail)) + np.repeat(start[node] - (upto - count), count)]
        fresh = ~seen[head]
        tail, head = tail[fresh], head[fresh]
        paths += np.bincount(head, weights=paths[tail], minlength=b * n)
        before, seen[head] = seen.copy(), True
        steps.append((tail, head))
        front = np.flatnonzero(seen ^ before)
    share = np.zeros(b * n)
    for tail, head in reversed(steps):
        share += np.bincount(tail, weights=paths[tail] / paths[head] * (weight[head % n] + share[head]), minlength=b * n)
    share[home] = 0.0
    return weight[sources] @ share.reshape(b, n)


def hanging_trees(n: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(core, hanging, squares) of each node of simple edges: whether it is in the 2-core, how many nodes hang from it in trees, and the sum of their branches' squared sizes.

    Leaves are taken off round by round; of a component without a 2-core one node is left, from which all others hang.
    """
    degree, other = np.bincount(ends.ravel(), minlength=n), np.zeros(n, dtype=np.int64)
    np.bitwise_xor.at(other, ends[:, 0], ends[:, 1])
    np.bitwise_xor.at(other, ends[:, 1], ends[:, 0])  # of a leaf: its neighbour
    hanging, squares = np.zeros(n, dtype=np.int64), np.zeros(n)
    leaves = np.flatnonzero(degree == 1)
    while len(leaves):
        up = other[leaves]
        kept = (degree[up] > 1) | (leaves < up)  # of two last nodes one stays
        leaves, up = leaves[kept], up[kept]
        size = hanging[leaves] + 1
        degree[leaves] = 0
        np.subtract.at(degree, up, 1)
        np.bitwise_xor.at(other, up, leaves)
        np.add.at(hanging, up, size)
        np.add.at(squares, up, size.astype(float) ** 2)
        up = np.unique(up)
        leaves = up[degree[up] == 1]
    return degree > 1, hanging, squares


def largest_pieces(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph, node, piece): for every articulation point the largest piece that its removal leaves of its component; one task per graph."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        g = _arrange(pdf)
        near, left, found = g.sets(), set(range(len(g))), {}
        while left:
            part = _component(near, next(iter(left)))
            left -= part
            found |= split_sizes(near, part)
        return pd.DataFrame({"graph": pdf["graph"].iat[0], "node": np.array([g.labels[i] for i in found], dtype=np.int64), "piece": np.array(list(found.values()), dtype=np.int64)})

    both = nodes.select("graph", F.col("node").alias("u"), F.lit(None).cast("bigint").alias("v"), "ord").unionByName(
        edges.join(nodes.select("graph", F.col("node").alias("u"), "ord"), ["graph", "u"]).select("graph", "u", "v", "ord")
    )
    return both.groupBy("graph").applyInPandas(kernel, "graph string, node bigint, piece bigint")


#: Sources worked on at once: so many that their arrays hold about this many numbers.
BATCH_NUMBERS = 1 << 20


def path_shares(ends: np.ndarray, n: int, block: int, blocks: int) -> np.ndarray:
    """What the sources of one of ``blocks`` blocks add to ``brandes`` over all nodes of a graph of edges ``ends``.

    Pairs with an end in a tree that hangs from the 2-core are counted from sizes (in block 0); searches run within the 2-core of
    each component, where a node stands for itself and what hangs from it.
    """
    core, hanging, squares = hanging_trees(n, ends)
    label = _labels(n, ends)
    others = np.bincount(label, minlength=n)[label] - 1.0
    total = others**2 - (others - hanging) ** 2 - squares if block == 0 else np.zeros(n)
    members = np.flatnonzero(core)
    members = members[np.argsort(label[members], kind="stable")]  # component by component
    place = np.full(n, -1)
    place[members] = np.arange(len(members))
    inner = place[ends[core[ends].all(axis=1)]]
    src, dst = np.concatenate([inner[:, 0], inner[:, 1]]), np.concatenate([inner[:, 1], inner[:, 0]])
    near = dst[np.argsort(src, kind="stable")]
    start = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(members)))])
    weight = hanging[members] + 1.0
    edge = np.flatnonzero(np.diff(label[members], prepend=-1, append=-1)) if len(members) else []
    for a, b in zip(edge[:-1], edge[1:]):
        own, first = start[a : b + 1] - start[a], near[start[a] : start[b]] - a
        sources = np.arange((block - a) % blocks, b - a, blocks)
        size = max(1, BATCH_NUMBERS // int(b - a))
        for at in range(0, len(sources), size):
            total[members[a:b]] += shortest_path_shares(own, first, sources[at : at + size], weight[a:b])
    return total


def betweenness(edges: DataFrame, nodes: DataFrame, blocks: int | None = None) -> DataFrame:
    """(graph, node, score): normalised betweenness; the sources of a graph are spread over ``blocks`` tasks (else as many as a shuffle has).

    Every task holds the graph's edges and works off its sources in batches; nodes in trees are no sources of their own.
    """
    blocks = blocks or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iat[0])
        names, flat = np.unique(pdf[["u", "v"]].to_numpy(), return_inverse=True)
        n = len(names)
        total = path_shares(flat.reshape(-1, 2), n, block, blocks)
        scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
        return pd.DataFrame({"graph": pdf["graph"].iat[0], "node": names, "score": total * scale})

    spread = edges.select("graph", "u", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    part = spread.groupBy("graph", "block").applyInPandas(kernel, "graph string, node bigint, score double").groupBy("graph", "node").agg(F.sum("score").alias("score"))
    return nodes.select("graph", "node").join(part, ["graph", "node"], "left").select("graph", "node", F.coalesce("score", F.lit(0.0)).alias("score"))
