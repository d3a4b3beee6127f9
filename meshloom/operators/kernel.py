"""Sequential graph algorithms for one bounded graph in memory: growth, moves with rollback, k-means, repair, multilevel.

Only graphs of at most plans.small.MOST_VERTICES vertices come here: coarsest levels, or small inputs.
"""

from __future__ import annotations

import heapq
import random
from collections import deque
from dataclasses import dataclass

import numpy as np


@dataclass
class Graph:
    """near[v]: neighbour -> weight. Vertices are 0 to n - 1."""

    near: list[dict[int, int]]
    weight: list[int]
    size: list[int]
    xyz: np.ndarray

    @property
    def n(self) -> int:
        return len(self.near)

    @property
    def total(self) -> int:
        return sum(self.weight)

    def cut(self, where: list[int]) -> int:
        return sum(w for v, row in enumerate(self.near) for u, w in row.items() if u > v and where[u] != where[v])

    def volume(self, where: list[int]) -> int:
        return sum(self.size[v] for v, row in enumerate(self.near) if any(where[u] != where[v] for u in row))

    def loads(self, where: list[int], k: int) -> list[int]:
        out = [0] * k
        for v, p in enumerate(where):
            out[p] += self.weight[v]
        return out

    def imbalance(self, where: list[int], k: int) -> float:
        ideal = self.total / k
        return max((abs(x / ideal - 1) for x in self.loads(where, k)), default=0.0) if ideal else 0.0

    def sub(self, keep: list[int]) -> Graph:
        at = {v: i for i, v in enumerate(keep)}
        return Graph([{at[u]: w for u, w in self.near[v].items() if u in at} for v in keep], [self.weight[v] for v in keep], [self.size[v] for v in keep], self.xyz[keep])


def capacity(total: int, k: int, ub: float) -> int:
    return int(ub * total / k + 0.5)


def _floor(total: int, k: int, ub: float) -> int:
    """The least weight of a part that counts as balanced."""
    return -int(-(2 - ub) * total / k // 1)


# --- growth and bisection ----------------------------------------------------------------------------


def grow(g: Graph, r: random.Random, targets: tuple[int, int]) -> list[int]:
    """Two breadth-first fronts that take turns; a front rests once its side has its target. What neither reaches goes to the
    side that lacks more of its target."""
    where = [-1] * g.n
    load = [0, 0]
    fronts = [deque(), deque()]
    for side, v in enumerate(r.sample(range(g.n), 2)):
        where[v] = side
        load[side] += g.weight[v]
        fronts[side].append(v)
    while fronts[0] or fronts[1]:
        for side, front in enumerate(fronts):
            if not front:
                continue
            for u in g.near[front.popleft()]:
                if where[u] < 0 and load[side] < targets[side]:
                    where[u] = side
                    load[side] += g.weight[u]
                    front.append(u)
    for v in range(g.n):
        if where[v] < 0:
            lack = [(t - x) / max(t, 1) for t, x in zip(targets, load, strict=True)]
            where[v] = int(lack[1] > lack[0])
            load[where[v]] += g.weight[v]
    return where


def bisect(g: Graph, targets: tuple[int, int], trials: int, passes: int, ub: float, seed: int) -> list[int]:
    """The best of `trials` grown and refined bisections: within ub of the targets first, then of least cut."""
    if g.n < 2:
        return [0] * g.n
    caps = [int(ub * t + 0.5) for t in targets]
    best: tuple | None = None
    for t in range(trials):
        where = grow(g, random.Random(f"{seed}-{t}"), targets)
        for _ in range(passes):
            if improve(g, where, caps) <= 0:
                break
        if _over(g, where, targets) > ub:
            even_out(g, where, 2, caps, [0, 0])
            improve(g, where, caps)
        found = (_over(g, where, targets) > ub, g.cut(where), t, where)
        best = found if best is None or found[:3] < best[:3] else best
    return best[3]


def _over(g: Graph, where: list[int], targets: tuple[int, int]) -> float:
    return max(x / t if t > 0 else 1.0 for x, t in zip(g.loads(where, 2), targets, strict=True))


def recursive_bisection(g: Graph, k: int, trials: int, passes: int, ub: float, seed: int) -> list[int]:
    """k parts by halving part numbers; a side's target is its share of the parts, at least 1."""
    where = [0] * g.n
    todo = deque([(list(range(g.n)), 0, k)])
    while todo:
        keep, first, parts = todo.popleft()
        if parts == 1 or len(keep) < 2:
            for v in keep:
                where[v] = first
            continue
        sub = g.sub(keep)
        left = parts // 2
        t0 = max(1, int(left / parts * sub.total + 0.5))
        side = bisect(sub, (t0, max(1, sub.total - t0)), trials, passes, ub, seed * 31 + first * 7 + parts)
        todo.append(([v for v, s in zip(keep, side, strict=True) if s == 0], first, left))
        todo.append(([v for v, s in zip(keep, side, strict=True) if s == 1], first + left, parts - left))
    return where


# --- moves with rollback -----------------------------------------------------------------------------


class _Centres:
    """Weighted centres of parts, kept up to date as vertices move."""

    def __init__(self, g: Graph, where: list[int], k: int):
        self.g, self.sum, self.w = g, np.zeros((k, 3)), np.zeros(k)
        for v, p in enumerate(where):
            self.sum[p] += g.weight[v] * g.xyz[v]
            self.w[p] += g.weight[v]
        self.at = (self.sum / np.maximum(self.w, 1e-300)[:, None]).tolist()
        self.points = g.xyz.tolist()

    def gain(self, v: int, src: int, dst: int) -> float:
        x, y, z = self.points[v]
        a, b = self.at[src], self.at[dst]
        return (x - a[0]) ** 2 + (y - a[1]) ** 2 + (z - a[2]) ** 2 - (x - b[0]) ** 2 - (y - b[1]) ** 2 - (z - b[2]) ** 2

    def move(self, v: int, src: int, dst: int) -> None:
        w = self.g.weight[v]
        for p, s in ((src, -w), (dst, w)):
            self.sum[p] += s * self.g.xyz[v]
            self.w[p] += s
            if self.w[p] > 0:
                self.at[p] = (self.sum[p] / self.w[p]).tolist()


def improve(g: Graph, where: list[int], caps: list[int], alpha: float = 1.0, beta: float | None = None, volume: bool = False, floor: int = 0) -> float:
    """One pass: best moves first, each vertex at most once, worse ones too; then back to the best point. Returns the gain there.

    A move goes to a part that the vertex touches and that stays within its cap, and leaves its part at `floor` at least. Gain: alpha * topological +
    (1 - alpha) * beta * how much nearer, in squared distance, the new centre is. Topological: edge weight won less lost; or the
    boundary size that the move frees, fixed when the pass begins.
    """
    k = len(caps)
    load = g.loads(where, k)
    links = [_links(g, where, v) for v in range(g.n)]
    centres = _Centres(g, where, k) if alpha < 1 else None
    freed = _freed(g, where, links) if volume else None

    def topo(v: int, p: int) -> int:
        return freed[v].get(p, 0) if freed is not None else links[v].get(p, 0) - links[v].get(where[v], 0)

    if centres is not None and beta is None:
        t2 = g2 = 0.0
        for v in range(g.n):
            for p in links[v]:
                if p != where[v]:
                    t2 += topo(v, p) ** 2
                    g2 += centres.gain(v, where[v], p) ** 2
        beta = (t2 / g2) ** 0.5 if g2 >= 1e-12 else 1.0

    def best(v: int) -> tuple[float, int] | None:
        src, found = where[v], None
        if load[src] - g.weight[v] < floor:
            return None
        for p in links[v]:
            if p != src and load[p] + g.weight[v] <= caps[p]:
                gain = float(topo(v, p)) if centres is None else alpha * topo(v, p) + (1 - alpha) * beta * centres.gain(v, src, p)
                if found is None or gain > found[0] or (gain == found[0] and p < found[1]):
                    found = (gain, p)
        return found

    heap: list[tuple[float, int, int]] = []
    for v in range(g.n):
        if len(links[v]) > (where[v] in links[v]) and (b := best(v)):
            heap.append((-b[0], v, b[1]))
    heapq.heapify(heap)
    locked = [False] * g.n
    done: list[tuple[int, int]] = []
    total = top = 0.0
    keep = 0
    patience = max(64, g.n // 12)
    while heap and len(done) - keep < patience:
        minus, v, p = heapq.heappop(heap)
        if locked[v]:
            continue
        now = best(v)
        if now is None:
            continue
        if now[1] != p or now[0] < -minus - 1e-9:  # what was queued is out of date
            heapq.heappush(heap, (-now[0], v, now[1]))
            continue
        gain, src = now[0], where[v]
        locked[v] = True
        load[src] -= g.weight[v]
        load[p] += g.weight[v]
        where[v] = p
        if centres is not None:
            centres.move(v, src, p)
        for u, w in g.near[v].items():
            row = links[u]
            row[src] -= w
            if not row[src]:
                del row[src]
            row[p] = row.get(p, 0) + w
            if not locked[u] and (b := best(u)):
                heapq.heappush(heap, (-b[0], u, b[1]))
        done.append((v, src))
        total += gain
        if total > top + 1e-9:
            top, keep = total, len(done)
    for v, src in reversed(done[keep:]):
        where[v] = src
    return top


def _links(g: Graph, where: list[int], v: int) -> dict[int, int]:
    out: dict[int, int] = {}
    for u, w in g.near[v].items():
        out[where[u]] = out.get(where[u], 0) + w
    return out


def _freed(g: Graph, where: list[int], links: list[dict[int, int]]) -> list[dict[int, int]]:
    """For each vertex and other part: size that leaves the boundary if it moves there."""
    outside = [sum(w for p, w in row.items() if p != where[v]) for v, row in enumerate(links)]
    out: list[dict[int, int]] = []
    for v, row in enumerate(links):
        alone = g.size[v] if not row.get(where[v]) else 0
        mine = {p: alone for p in row if p != where[v]}
        for u, w in g.near[v].items():
            if where[u] != where[v] and outside[u] == w:
                mine[where[u]] += g.size[u]
        out.append(mine)
    return out


def refine(g: Graph, where: list[int], k: int, ub: float, passes: int, alpha: float = 1.0, beta: float | None = None, volume: bool = False) -> None:
    """Passes while they gain. In volume mode a pass that doesn't lower the boundary volume is taken back."""
    caps, floor = [capacity(g.total, k, ub)] * k, max(0, _floor(g.total, k, ub))
    for _ in range(passes):
        before, value = list(where), g.volume(where) if volume else 0
        if improve(g, where, caps, alpha, beta, volume, floor) <= 1e-9:
            break
        if volume and g.volume(where) >= value:
            where[:] = before
            break


# --- balance and connectivity -------------------------------------------------------------------------


def even_out(g: Graph, where: list[int], k: int, caps: list[int], floors: list[int]) -> int:
    """Moves boundary vertices out of the heaviest part over its cap, or into the lightest under its floor, best score first. Where no
    boundary vertex can go, vertices without any edge do, which costs no cut.

    A heap a part has its vertices' scores as they were when pushed. What is popped is scored anew and goes back if it has got worse; a move
    pushes its neighbours again.
    """
    load = g.loads(where, k)
    ideal = g.total / k
    heaps: dict[int, list[tuple[float, int]]] = {}
    fronts: dict[int, set[int]] = {}  # vertices beside a part

    def best_move(v: int) -> tuple[float, int] | None:
        src, links = where[v], _links(g, where, v)
        able = [(w - links.get(src, 0) + 0.5 * (ideal - load[p]) / (ideal + 1), -p) for p, w in links.items() if p != src and load[p] + g.weight[v] <= max(caps[p], load[src] - g.weight[v])]
        return (max(able)[0], -max(able)[1]) if able else None

    def heap_of(part: int) -> list[tuple[float, int]]:
        out = [(-m[0], v) for v in range(g.n) if where[v] == part and (m := best_move(v))]
        heapq.heapify(out)
        return out

    def popped(part: int) -> tuple[int, int] | None:
        heap = heaps[part]
        while heap:
            score, v = heapq.heappop(heap)
            now = best_move(v) if where[v] == part else None
            if now and now[0] >= -score - 1e-9:
                return v, now[1]
            if now:
                heapq.heappush(heap, (-now[0], v))
        return None

    def lifted(light: int) -> tuple[int, int] | None:
        """The vertex beside `light` whose part is the heaviest that can spare it."""
        if light not in fronts:
            fronts[light] = {v for u in range(g.n) if where[u] == light for v in g.near[u] if where[v] != light}
        able = [v for v in fronts[light] if load[where[v]] - g.weight[v] >= floors[where[v]] and load[light] + g.weight[v] <= caps[light]]
        return (max(able, key=lambda v: (load[where[v]], -v)), light) if able else None

    loose: dict[int, list[int]] = {}  # vertices without an edge, the heaviest last
    for v in sorted((v for v in range(g.n) if not g.near[v] and g.weight[v] > 0), key=lambda v: g.weight[v]):
        loose.setdefault(where[v], []).append(v)

    def dealt(src: int, dst: int) -> tuple[int, int] | None:
        """The heaviest loose vertex of src by whose move the two parts get closer."""
        mine = loose.get(src, [])
        for i in range(len(mine) - 1, -1, -1):
            if load[dst] + g.weight[mine[i]] < load[src]:
                loose.setdefault(dst, []).append(mine[i])
                return mine.pop(i), dst
        return None

    moves, dry = 0, set()  # dry: parts without an able boundary vertex, as far as moves along edges go
    while moves < g.n:
        heavy = max((p for p in range(k) if load[p] > caps[p]), key=lambda p: load[p], default=None)
        light = min((p for p in range(k) if load[p] < floors[p]), key=lambda p: load[p], default=None)
        step = None
        if heavy is not None:
            step = popped(heavy) if heavy in heaps else None
            if step is None and heavy not in dry:  # none that was pushed is able: others may have become so
                heaps[heavy] = heap_of(heavy)
                step = popped(heavy)
                if step is None:
                    dry.add(heavy)
        if step is None and light is not None:
            step = lifted(light)
        if step is not None:
            dry.clear()
        if step is None and (heavy is not None or light is not None):
            least = min(range(k), key=lambda p: load[p])
            step = next((x for p in sorted(range(k), key=lambda p: -load[p]) if p != least and (x := dealt(p, least))), None)
        if step is None:
            break
        v, p = step
        load[where[v]] -= g.weight[v]
        load[p] += g.weight[v]
        where[v] = p
        for q, front in fronts.items():
            front.discard(v)
            if q != p and any(where[u] == q for u in g.near[v]):
                front.add(v)
            for u in g.near[v]:
                if where[u] != q and (q == p or any(where[x] == q for x in g.near[u])):
                    front.add(u)
                else:
                    front.discard(u)
        for u in (v, *g.near[v]):
            if where[u] in heaps and (m := best_move(u)):
                heapq.heappush(heaps[where[u]], (-m[0], u))
        moves += 1
    return moves


def balance(g: Graph, where: list[int], k: int, ub: float) -> int:
    return even_out(g, where, k, [capacity(g.total, k, ub)] * k, [_floor(g.total, k, ub)] * k)


def pieces(g: Graph, where: list[int]) -> list[tuple[int, list[int], int]]:
    """(part, vertices, weight) of each connected piece of each part."""
    seen, out = [False] * g.n, []
    for s in range(g.n):
        if seen[s]:
            continue
        seen[s] = True
        piece, todo = [], [s]
        while todo:
            v = todo.pop()
            piece.append(v)
            for u in g.near[v]:
                if not seen[u] and where[u] == where[s]:
                    seen[u] = True
                    todo.append(u)
        out.append((where[s], piece, sum(g.weight[v] for v in piece)))
    return out


def connect(g: Graph, where: list[int], k: int, ub: float, keep_largest: float = 0.95) -> int:
    """Moves each part's lesser pieces whole to the part they touch most that stays within ub, else to the one they touch most."""
    limit, count = capacity(g.total, k, ub), 0
    for _ in range(k):
        by: dict[int, list[tuple[list[int], int]]] = {}
        for p, piece, w in pieces(g, where):
            by.setdefault(p, []).append((piece, w))
        load = g.loads(where, k)
        moved = False
        for p in sorted(by):
            main = max(by[p], key=lambda x: x[1])
            for piece, w in by[p]:
                if piece is main[0] or (w / max(main[1], 1) > 1 - keep_largest and main[1] >= keep_largest * load[p]):
                    continue
                touch: dict[int, int] = {}
                for v in piece:
                    for q, x in _links(g, where, v).items():
                        if q != p:
                            touch[q] = touch.get(q, 0) + x
                if not touch:
                    continue
                to = max(touch, key=lambda q: (load[q] + w <= limit, touch[q], -q))
                for v in piece:
                    where[v] = to
                load[p] -= w
                load[to] += w
                count += len(piece)
                moved = True
        if not moved:
            break
    return count


# --- geometry -----------------------------------------------------------------------------------------


def seed_centres(xyz: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: the first at random, the next in proportion to the squared distance from those there are."""
    centres = [xyz[rng.integers(len(xyz))]]
    near = ((xyz - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        total = near.sum()
        at = int(np.searchsorted(near.cumsum(), rng.random() * total, "right")) if total > 0 else int(rng.integers(len(xyz)))
        centres.append(xyz[min(at, len(xyz) - 1)])
        near = np.minimum(near, ((xyz - centres[-1]) ** 2).sum(1))
    return np.array(centres)


def expand(g: Graph, centres: np.ndarray) -> list[int]:
    """Breadth-first from the vertex nearest to each centre; the lightest part below 1.05 of its share goes next, else any."""
    k = len(centres)
    far = ((g.xyz[:, None, :] - centres[None]) ** 2).sum(2)
    where, load, fronts = [-1] * g.n, [0] * k, [deque() for _ in range(k)]
    for p in range(k):
        for v in np.argsort(far[:, p], kind="stable"):
            if where[v] < 0:
                where[v] = p
                load[p] += g.weight[v]
                fronts[p].append(int(v))
                break
    share = 1.05 * g.total / k
    while any(fronts):
        open_ = [p for p in range(k) if fronts[p]]
        p = min(open_, key=lambda p: (load[p] >= share, load[p] if load[p] < share else p))
        for u in g.near[fronts[p].popleft()]:
            if where[u] < 0:
                where[u] = p
                load[p] += g.weight[u]
                fronts[p].append(u)
    return [p if p >= 0 else int(far[v].argmin()) for v, p in enumerate(where)]


def grown(g: Graph, k: int, seed: int) -> list[int]:
    """Regions grown from k-means++ seeds."""
    return expand(g, seed_centres(g.xyz, k, np.random.default_rng(seed)))


def kmeans(g: Graph, k: int, seed: int, iterations: int, tol: float = 1e-4, bfs: bool = True) -> tuple[list[int], float]:
    """Labels and inertia of Lloyd's iterations from grown seeds; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    w = np.array(g.weight, float)
    centres = seed_centres(g.xyz, k, rng)
    if bfs:
        label = np.array(expand(g, centres))
        centres = _means(g.xyz, w, label, centres)
    label, inertia = np.full(g.n, -1), 0.0
    for _ in range(iterations):
        far = ((g.xyz[:, None, :] - centres[None]) ** 2).sum(2)
        new = far.argmin(1)
        inertia = float(far[np.arange(g.n), new].sum())
        still = bool((new == label).all())
        label = new
        moved = _means(g.xyz, w, label, centres)
        shift = float(np.sqrt(((moved - centres) ** 2).sum(1)).max())
        centres = moved
        if still or shift < tol:
            break
    return label.tolist(), inertia


def _means(xyz: np.ndarray, w: np.ndarray, label: np.ndarray, old: np.ndarray) -> np.ndarray:
    total = np.bincount(label, w, len(old))
    sums = np.stack([np.bincount(label, w * xyz[:, d], len(old)) for d in range(3)], 1)
    return np.where(total[:, None] > 0, sums / np.maximum(total, 1e-300)[:, None], old)


def geometric_balance(g: Graph, where: list[int], k: int, ub: float) -> None:
    """Boundary vertices of overweight parts go to the nearest other centre with room up to 1.05 * ub."""
    centres, load = _Centres(g, where, k), g.loads(where, k)
    most = ub * g.total / k
    for _ in range(g.n):
        moved = False
        for v in range(g.n):
            src = where[v]
            if load[src] <= most or all(where[u] == src for u in g.near[v]):
                continue
            able = [p for p in range(k) if p != src and load[p] + g.weight[v] <= 1.05 * most]
            if able:
                p = max(able, key=lambda p: (centres.gain(v, src, p), -p))
                centres.move(v, src, p)
                load[src] -= g.weight[v]
                load[p] += g.weight[v]
                where[v] = p
                moved = True
        if not moved:
            break


# --- multilevel ---------------------------------------------------------------------------------------


def coarser(g: Graph, r: random.Random, lam: float, cap: int) -> tuple[Graph, list[int]]:
    """One level: light vertices first, each matched with its free neighbour of the best score; and the map to the new vertices."""
    top = max((w for row in g.near for w in row.values()), default=1)
    points = g.xyz.tolist()
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(points[a], points[b], strict=True))
    if lam < 1:
        some = [dist(v, u) for v in range(min(g.n, 2000)) for u in g.near[v]]
        ref = sum(some) / len(some) if some and sum(some) / len(some) >= 1e-20 else 1.0
    mate = [-1] * g.n
    order = list(range(g.n))
    r.shuffle(order)
    order.sort(key=lambda v: g.weight[v])
    for v in order:
        if mate[v] >= 0:
            continue
        best, of = -1.0, v
        for u, w in g.near[v].items():
            if mate[u] < 0 and u != v and (not cap or g.weight[u] + g.weight[v] <= cap):
                score = w / top if lam >= 1 else lam * w / top + (1 - lam) / (1 + dist(v, u) / ref)
                if score > best:
                    best, of = score, u
        mate[v], mate[of] = of, v
    cmap, n = [-1] * g.n, 0
    for v in range(g.n):
        if cmap[v] < 0:
            cmap[v] = cmap[mate[v]] = n
            n += 1
    near: list[dict[int, int]] = [{} for _ in range(n)]
    weight, size = [0] * n, [0] * n
    moment, plain, members = np.zeros((n, 3)), np.zeros((n, 3)), [0] * n
    for v in range(g.n):
        c = cmap[v]
        weight[c] += g.weight[v]
        size[c] += g.size[v]
        members[c] += 1
        moment[c] += g.weight[v] * g.xyz[v]
        plain[c] += g.xyz[v]
        for u, w in g.near[v].items():
            if cmap[u] != c:
                near[c][cmap[u]] = near[c].get(cmap[u], 0) + w
    w = np.array(weight, float)[:, None]
    return Graph(near, weight, size, np.where(w > 0, moment / np.maximum(w, 1e-300), plain / np.array(members)[:, None])), cmap


def multilevel(
    g: Graph, k: int, seed: int, ub: float, passes: int, *, lam: float = 1.0, alpha: float = 1.0, cap_factor: float = 0.0, init: str = "rb", coarse_limit: int = 20, ratio: float = 0.75,
    trials: int = 5, iterations: int = 100, bfs: bool = True, topo_balance: bool = True, connectivity: bool = False, volume: bool = False, beta: float | None = None,
) -> tuple[list[int], float]:
    """Coarsen, partition the coarsest graph in several trials, project and refine; labels and the k-means inertia."""
    if k == 1 or g.n == 0:
        return [0] * g.n, 0.0
    if g.n <= k:
        return list(range(g.n)), 0.0
    r = random.Random(seed)
    cap = int(g.total / k * cap_factor + 0.5) if cap_factor > 0 else 0
    levels: list[tuple[Graph, list[int]]] = []
    now = g
    while now.n > max(coarse_limit * k, 40):
        nxt, cmap = coarser(now, r, lam, cap)
        if nxt.n >= now.n or (levels and nxt.n / now.n >= ratio):
            break
        levels.append((now, cmap))
        now = nxt
    best, inertia = None, 0.0
    for t in range(trials):
        s = seed * 1009 + t
        value = 0.0
        if init == "rb":
            where = recursive_bisection(now, k, 8, 6, ub, s)
        else:
            where, value = kmeans(now, k, s, iterations, bfs=bfs)
            balance(now, where, k, ub * 1.07) if topo_balance else geometric_balance(now, where, k, ub * 1.07)
            if connectivity:
                connect(now, where, k, ub)
            if init == "hybrid":
                refine(now, where, k, ub, 3)
        refine(now, where, k, max(ub, 1.10), passes, alpha, beta, volume)
        key = (now.imbalance(where, k) > 1.5 * ub - 1, now.cut(where), value)
        if best is None or key < best[0]:
            best, inertia = (key, where), value
    where = best[1]
    for fine, cmap in reversed(levels):
        where = [where[c] for c in cmap]
        balance(fine, where, k, ub)
        refine(fine, where, k, ub, passes, alpha, beta, volume)
    balance(g, where, k, ub)
    refine(g, where, k, ub, passes, alpha, beta, volume)
    if connectivity:
        for _ in range(3):
            moved = connect(g, where, k, ub * 1.10) + balance(g, where, k, ub)
            if not moved:
                break
            refine(g, where, k, ub, max(2, passes // 2))
        connect(g, where, k, ub * 1.10)
    return where, inertia
