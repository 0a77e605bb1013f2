"""Models of path texts, a batch of texts at a time: parsed, placed, joined, collided and walked in one task.

A text says all about its model and the catalogue is held by each task, so nothing is shuffled and nothing but the result
leaves the task. The rows are those of the operators that work on tables (grammar.trees, walks.poses, assembly.graph_edges,
collision.colliding_pairs, walks.walked, grammar.serialized); lines are looked up by what stands behind their label, all
else is numpy over the texts of a slice, except the walks themselves.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ARITY, AXLE_MATES, FAMILY_RANK, LETTERS, STUD_MATES
from ..tables import spread
from .assembly import AXIS, AXLE_AXIS, AXLE_RADIUS, FIXED_AXIS, FIXED_TRACE, HOLDING, ORIENTED, OVERLAP, REACH, SLACK
from .collision import MESH, Boxes, mesh_of, meshes_cross, parted
from .walks import relative

#: Characters of the texts that are worked on together, unless one text alone has more.
SLICE = 300_000
#: Kinds of lines that a worker remembers.
REMEMBERED = 100_000
#: Pairs looked at in one go.
CHUNK = 250_000
FAMILIES = tuple(FAMILY_RANK)
KINDS = ("stud", "hole", "axle", "hinge", "ball", "fixed")
_ID, _INT = re.compile(rf"[a-z]{{1,{LETTERS}}}"), re.compile(r"0|-?[1-9][0-9]{0,17}")


def number(letters: str) -> int:
    """The number that letters stand for; -1 for anything else."""
    if not _ID.fullmatch(letters):
        return -1
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 96
    return n - 1


def letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(97 + n % 26) + out, n // 26 - 1
    return out


def _degree(word: str) -> int:
    return int(word) if _INT.fullmatch(word) and 0 <= int(word) < 360 else -1


class _Looked(dict):
    """What a function gives, remembered."""

    def __init__(self, f: Callable):
        super().__init__()
        self.f = f

    def __missing__(self, k):
        self[k] = v = self.f(k)
        return v


class Catalogue:
    """Parts, colours and connectors as arrays; parts are numbered in the order of their ids, connectors by part and kind."""

    def __init__(self, parts: list, colors: list, connectors: list):
        self.part_ids = np.array(sorted({r["part_id"] for r in parts} | {r["part_id"] for r in connectors}), dtype=np.int64)
        at = {p: k for k, p in enumerate(self.part_ids.tolist())}
        self.part_names = {at[r["part_id"]]: r["name"] for r in parts}
        self.part_of = {}
        for r in sorted(parts, key=lambda r: r["part_id"]):
            self.part_of[r["name"]] = at[r["part_id"]]
        self.color_of, self.color_names = {}, {}
        for r in sorted(colors, key=lambda r: r["ord"]):
            self.color_of[r["name"]] = r["code"]
            self.color_names[r["code"]] = r["name"]
        kind = {k: n for n, k in enumerate(KINDS)}
        rows = sorted(connectors, key=lambda r: (at[r["part_id"]], kind.get(r["kind"], len(KINDS)), r["conn_idx"]))
        n = len(rows)
        self.part = np.array([at[r["part_id"]] for r in rows], dtype=np.int64)
        self.kind = np.array([kind.get(r["kind"], len(KINDS)) for r in rows], dtype=np.int64)
        self.conn_idx = np.array([r["conn_idx"] for r in rows], dtype=np.int64)
        self.subgroup = [r["subgroup_idx"] for r in rows]
        self.sub, self.pol = [r["sub"] for r in rows], [r["pol"] for r in rows]
        self.frame = np.array([r["frame"] for r in rows], dtype=float).reshape(n, 16)
        self.origin = [np.ascontiguousarray(self.frame[:, 4 * k + 3]) for k in range(3)]
        self.radius = np.array([max(r["length"] or 0.0, AXLE_RADIUS) for r in rows], dtype=float)
        self.longest = max((r["length"] or 0.0 for r in rows), default=0.0)
        # the connectors of a part and kind lie together
        key = self.part * (len(KINDS) + 1) + self.kind
        cells = np.arange(len(self.part_ids) * (len(KINDS) + 1) + 1)
        self.bounds = np.searchsorted(key, cells)
        self.group_of = {g: k for k, g in enumerate(dict.fromkeys((s, p or "") for s, p in zip(self.sub, self.pol)))}
        self.group = np.array([self.group_of[s, p or ""] for s, p in zip(self.sub, self.pol)], dtype=np.int64)
        # how many connectors a part has of each subtype and polarity, and which is the one of a number
        wide = max(len(self.group_of), 1)
        self.count = np.bincount(self.part * wide + self.group, minlength=len(self.part_ids) * wide).reshape(-1, wide) if n else np.zeros((len(self.part_ids), wide), dtype=np.int64)
        self.row = np.full((len(self.part_ids), wide, int(self.count.max(initial=0)) + 1), -1, dtype=np.int64)
        for k, s in enumerate(self.subgroup):
            if s is not None and 0 <= s < self.row.shape[2]:
                self.row[self.part[k], self.group[k], s] = k
        coded = lambda values: np.array([{v: k for k, v in enumerate(dict.fromkeys(values))}[v] for v in values], dtype=np.int64)
        self.kind_sub = coded(list(zip(self.kind.tolist(), self.sub))) if n else self.part
        self.subs = list(dict.fromkeys(self.sub))
        self.sub_code = np.array([self.subs.index(s) for s in self.sub], dtype=np.int64)
        fits = lambda pairs: np.array([[tuple(sorted((a, b))) in pairs for b in self.subs] for a in self.subs], dtype=bool).reshape(len(self.subs), len(self.subs))
        self.stud_fits, self.axle_fits = fits(STUD_MATES), fits(AXLE_MATES)
        self.holding = np.array([s in HOLDING for s in self.sub], dtype=bool)
        self.oriented = np.array([s in ORIENTED for s in self.sub], dtype=bool)
        # how connectors are written: of studs and axles, of the parent's side of others, of the child's
        self.at = [letters(k) for k in self.subgroup]
        self.named = [f"{s} {a}" for s, a in zip(self.sub, self.at)]
        self.sided = [f"{letters(int(s))} {p} {a}" if p is not None and re.fullmatch("[0-9]+", s) else None for s, p, a in zip(self.sub, self.pol, self.at)]
        self.inner, self.outer = (np.array([p == w for p in self.pol], dtype=bool) for w in ("in", "on"))

    def node(self, rest: str) -> tuple[int, int] | None:
        """Part and colour of a node line, by what stands behind its label."""
        if rest.startswith("| "):
            name, color = "", rest[2:]
        else:
            name, bar, color = rest.partition(" | ")
            if not bar:
                return None
        p, c = self.part_of.get(name), self.color_of.get(color)
        return None if p is None or c is None else (p, c)

    def edge(self, rest: str) -> tuple | None:
        """(family, groups of both sides, connectors of both, flip, yaw, slide, rx, ry, rz, polarity on) of an edge line."""
        t = rest.split(" ")
        family = t[0]
        if family not in ARITY or len(t) + 1 != ARITY[family]:
            return None
        flip, yaw, slide, angles = -1, 0, 0, (0, 0, 0)
        if family in ("stud", "axle"):
            sides, conns = ((t[1], ""), (t[3], "")), (number(t[2]), number(t[4]))
            if tuple(sorted((t[1], t[3]))) not in (STUD_MATES if family == "stud" else AXLE_MATES):
                return None
        else:
            sub = number(t[1])
            if sub < 0 or t[2] not in ("in", "on"):
                return None
            sides, conns = ((str(sub), t[2]), (str(sub), "on" if t[2] == "in" else "in")), (number(t[3]), number(t[4]))
        if family in ("axle", "hinge"):
            flip = {"flip": 1, "regular": 0}.get(t[5], -1)
            if flip < 0:
                return None
        if family in ("stud", "axle", "hinge"):
            yaw = _degree(t[5] if family == "stud" else t[6])
        if family == "axle":
            if not _INT.fullmatch(t[7]):
                return None
            slide = int(t[7])
        if family == "ball":
            angles = tuple(map(_degree, t[5:8]))
        groups = [self.group_of.get(s, -1) for s in sides]
        if min(*conns, *groups, yaw, *angles) < 0:
            return None
        return (FAMILY_RANK[family], *groups, *conns, max(flip, 0), yaw, slide, *angles, int(sides[0][1] == "on"))


def held(parts: DataFrame, colors: DataFrame, connectors: DataFrame):
    """The catalogue, broadcast."""
    rows = lambda df, *names: list(df.select(*names).toLocalIterator())
    c = Catalogue(rows(parts, "part_id", "name"), rows(colors, "code", "name", "ord"), rows(connectors, "part_id", "conn_idx", "kind", "sub", "pol", "length", "frame", "subgroup_idx"))
    return parts.sparkSession.sparkContext.broadcast(c)


class Reader:
    """Reads texts; lines that it has seen are looked up."""

    def __init__(self, cat: Catalogue):
        self.cat = cat
        self.label, self.degree = _Looked(number), _Looked(_degree)
        self._forget()

    def _forget(self) -> None:
        self.nodes, self.edges = [(0, 0)], [(0,) * 12]  # number 0: wrong
        self.node, self.edge, self.head = _Looked(self._node), _Looked(self._edge), _Looked(lambda head: self.cat.edge(f"{head} 0"))
        self.tables = [np.zeros((0, 2), dtype=np.int64), np.zeros((0, 12), dtype=np.int64)]

    def _fields(self, k: int, numbers: list[int]) -> np.ndarray:
        """The fields of node (0) or edge (1) lines by their numbers."""
        seen, table = (self.nodes, self.edges)[k], self.tables[k]
        if len(seen) > len(table):
            table = self.tables[k] = np.concatenate((table, np.array(seen[len(table) :], dtype=np.int64)))
        return table[numbers]

    def _node(self, rest: str) -> int:
        got = self.cat.node(rest)
        self.nodes += [got] if got else []
        return len(self.nodes) - 1 if got else 0

    def _edge(self, rest: str) -> int:
        head, _, last = rest.rpartition(" ")
        if head.startswith("stud ") and (got := self.head[head]):  # the same but for the angle
            yaw = self.degree[last]
            got = (*got[:6], yaw, *got[7:]) if yaw >= 0 else None
        else:
            got = self.cat.edge(rest)
        self.edges += [got] if got else []
        return len(self.edges) - 1 if got else 0

    def read(self, texts: list[str]) -> Trees:
        if len(self.edge) + len(self.node) + len(self.label) + len(self.degree) + len(self.head) > REMEMBERED:
            self._forget()
            self.label.clear()
            self.degree.clear()
        label, node_of, edge_of = self.label, self.node, self.edge
        pairs, node_lines, edge_lines = [], [], []
        for t in texts:
            ls = (t[:-1] if t.endswith("\n") else t).split("\n")
            n = (len(ls) + 1) // 2
            pairs.append(n)
            node_lines.append(ls[0])
            node_lines += ls[1 : 2 * n - 1 : 2]
            edge_lines.append("")
            edge_lines += ls[2 : 2 * n : 2]
        words = [x.partition(" ") for x in node_lines]
        nodes = [node_of[rest] if blank else 0 for _, blank, rest in words]
        # a node's label is any number of small letters
        named = [label[a] >= 0 or bool(re.fullmatch("[a-z]+", a)) for a, _, _ in words]
        words = [x.partition(" ") for x in edge_lines]
        parents, edges = [label[a] for a, _, _ in words], [edge_of[rest] if blank else 0 for _, blank, rest in words]
        return Trees(self.cat, np.array(pairs, dtype=np.int64), self._fields(0, nodes), (np.array(nodes, dtype=np.int64) > 0) & np.array(named, dtype=bool), np.array(parents, dtype=np.int64), self._fields(1, edges), np.array(edges, dtype=np.int64) > 0)


class Trees:
    """The trees of texts up to their first wrong pair, a row a node, texts end to end: text (its number), pos, part (its
    number), color, parent (a row; -1 for a root) and the fields of the edge to it; sizes by text."""

    def __init__(self, cat: Catalogue, pairs: np.ndarray, nodes: np.ndarray, right_node: np.ndarray, parents: np.ndarray, e: np.ndarray, right_edge: np.ndarray):
        self.cat = cat
        text = np.repeat(np.arange(len(pairs)), pairs)
        first = np.cumsum(pairs) - pairs
        pos = np.arange(len(text)) - first[text]
        root = pos == 0
        part = nodes[:, 0]
        up = np.where((parents >= 0) & (parents < pos), parents, 0) + first[text]
        ok = right_edge & (parents >= 0) & (parents < pos) & (e[:, 3] < cat.count[part[up], e[:, 1]]) & (e[:, 4] < cat.count[part, e[:, 2]])
        ok = right_node & (ok | root)
        bad = pairs.copy()
        np.minimum.at(bad, text[~ok], pos[~ok])
        keep = pos < bad[text]
        moved = np.cumsum(keep) - 1
        self.text, self.pos, self.part, self.color = text[keep], pos[keep], part[keep], nodes[keep, 1]
        self.parent = np.where(root, -1, moved[up])[keep]
        self.e, self.sizes = e[keep], bad

    def poses(self) -> np.ndarray:
        """Where each part lies: the root at the origin, each child where its edge puts it relative to its parent."""
        cat, out = self.cat, np.tile(np.eye(4), (len(self.text), 1, 1))
        at = np.flatnonzero(self.parent >= 0)
        deepest = cat.row.shape[2] - 1
        rows = [cat.row[self.part[n], self.e[at, 1 + s], np.minimum(self.e[at, 3 + s], deepest)] for s, n in ((0, self.parent[at]), (1, at))]
        there = (rows[0] >= 0) & (rows[1] >= 0)
        at, rows = at[there], [r[there] for r in rows]
        if not len(at):
            return out
        e = self.e[at]
        family = np.array(FAMILIES)[e[:, 0]]
        axle, back = family == "axle", (family == "ball") & (e[:, 11] == 1)
        yaw = np.where(axle, e[:, 7].astype(float), np.radians(e[:, 6].astype(float)))
        rot = np.radians(e[:, 8:11].astype(float))
        rot[axle, 0] = np.radians(e[axle, 6].astype(float))
        # a ball's edge runs from the side with polarity in
        m = relative(family, yaw, e[:, 5].astype(bool), rot, cat.frame[np.where(back, rows[1], rows[0])], cat.frame[np.where(back, rows[0], rows[1])])
        m[back] = np.linalg.inv(m[back])
        # all trees at once, one level of depth after the other
        depth = [0] * len(out)
        for p, q in zip(at.tolist(), self.parent[at].tolist()):
            depth[p] = depth[q] + 1
        deep = np.array(depth)[at]
        order = np.argsort(deep, kind="stable")
        cuts = np.searchsorted(deep[order], np.arange(1, int(deep.max()) + 2))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            w = order[lo:hi]
            out[at[w]] = out[self.parent[at[w]]] @ m[w]
        return out


def close_pairs(xg: np.ndarray, xp: np.ndarray, yg: np.ndarray, yp: np.ndarray, reach: float, coarse: float = 8.0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of x, rows of y) of one group whose points may lie within reach, none twice: as spatial.near, y lies in one
    cell and x goes to those that its cube of reach touches."""
    if not len(xg) or not len(yg):
        return
    size = coarse * reach
    cell = lambda v: np.floor(v / size).astype(np.int64)
    lo, hi, own = cell(xp - reach), cell(xp + reach), cell(yp)
    times = (hi - lo + 1).prod(axis=1)
    x = np.repeat(np.arange(len(xg)), times)
    k = np.arange(len(x)) - np.repeat(np.cumsum(times) - times, times)
    kx, ky, most = xg[x], yg, int(max(xg.max(), yg.max())) + 1
    for i in range(3):
        wide = (hi[:, i] - lo[:, i] + 1)[x]
        c = lo[x, i] + k % wide
        k = k // wide
        low = own[:, i].min()
        span = int(own[:, i].max()) - int(low) + 1
        keep = (c >= low) & (c < int(low) + span)
        x, k, c, kx = x[keep], k[keep], c[keep], kx[keep]
        if most * span >= 1 << 62:  # numbers too large are ranked
            for ranked in (True, False):
                if ranked:
                    u, ky = np.unique(ky, return_inverse=True)
                    r = np.minimum(np.searchsorted(u, kx), len(u) - 1)
                    keep, kx = u[r] == kx, r
                    most, cy = len(u), own[:, i]
                else:
                    u, cy = np.unique(own[:, i], return_inverse=True)
                    r = np.minimum(np.searchsorted(u, c), len(u) - 1)
                    keep, c, low, span = u[r] == c, r, 0, len(u)
                x, k, c, kx = x[keep], k[keep], c[keep], kx[keep]
        else:
            cy = own[:, i]
        kx, ky, most = kx * span + (c - low), ky * span + (cy - low), most * span
    order = np.argsort(ky, kind="stable")
    ky = ky[order]
    start = np.flatnonzero(np.concatenate(([True], ky[1:] != ky[:-1])))
    cells, count = ky[start], np.diff(np.append(start, len(ky)))
    at = np.minimum(np.searchsorted(cells, kx), len(cells) - 1)
    w = np.flatnonzero(cells[at] == kx)
    x, begin, many = x[w], start[at[w]], count[at[w]]
    yield from ((x[i], order[j]) for i, j in _expanded(begin, many))


def _expanded(begin: np.ndarray, many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, begin[i] + 0 ... many[i] - 1) for all i, about CHUNK at a time."""
    total = np.concatenate(([0], np.cumsum(many)))
    lo = 0
    while lo < len(many):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + CHUNK, side="right")) - 1)
        if hi == lo + 1:  # one alone may have more than a chunk
            for at in range(0, int(many[lo]), CHUNK):
                j = np.arange(at, min(at + CHUNK, int(many[lo])))
                yield np.full(len(j), lo), begin[lo] + j
        else:
            m = many[lo:hi]
            i = np.repeat(np.arange(lo, hi), m)
            yield i, begin[i] + np.arange(len(i)) - np.repeat(total[lo:hi] - total[lo], m)
        lo = hi


class Side:
    """Placed connectors: their node (row of the trees) and catalogue row; places are worked out at once, frames when
    they're wanted. Sums are in the order of the column expressions, so the values are the same."""

    def __init__(self, cat: Catalogue, node: np.ndarray, row: np.ndarray, xf: np.ndarray):
        self.cat, self.node, self.row, self.xf, self.both = cat, node, row, xf, None
        f, self.p = [cat.origin[k][row] for k in range(3)], np.empty((len(node), 3))
        for i in range(3):
            m = [np.ascontiguousarray(xf[:, i, k])[node] for k in range(4)]
            self.p[:, i] = m[0] * f[0] + m[1] * f[1] + m[2] * f[2] + m[3]

    def where(self, keep: np.ndarray) -> Side:
        out = object.__new__(Side)
        out.cat, out.node, out.row, out.xf, out.p, out.both = self.cat, self.node[keep], self.row[keep], self.xf, self.p[keep], None
        return out

    def turn(self, j: int) -> list[np.ndarray]:
        """A column of the frames' rotations."""
        if self.both is None:
            self.both = self.xf[self.node], self.cat.frame[self.row]
        m, f = self.both
        return [m[:, i, 0] * f[:, j] + m[:, i, 1] * f[:, 4 + j] + m[:, i, 2] * f[:, 8 + j] for i in range(3)]


def _dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _axis(col: list[np.ndarray]) -> list[np.ndarray]:
    n = np.sqrt(col[0] * col[0] + col[1] * col[1] + col[2] * col[2])
    n = np.where(n == 0, 1.0, n)
    return [-c / n for c in col]


def joints_of(t: Trees, xf: np.ndarray) -> dict[str, np.ndarray]:
    """All joints between the parts of each text: family, a and b (rows of the trees), a_row and b_row (of the
    catalogue), yaw, flip, rot; as assembly.graph_edges has them."""
    cat = t.cat

    def side(kind: str) -> Side:
        cell = t.part * (len(KINDS) + 1) + KINDS.index(kind)
        begin, many = cat.bounds[cell], cat.bounds[cell + 1] - cat.bounds[cell]
        node = np.repeat(np.arange(len(t.part)), many)
        return Side(cat, node, np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(len(node)), xf)

    out: dict[str, list] = {k: [] for k in ("family", "a", "b", "a_row", "b_row", "yaw", "flip", "rot")}

    def met(x: Side, y: Side, group: Callable[[Side], np.ndarray], reach: float = REACH, coarse: float = 8.0):
        for i, j in close_pairs(group(x), x.p, group(y), y.p, reach, coarse):
            keep = x.node[i] != y.node[j]
            i, j = i[keep], j[keep]
            gap = [x.p[i, k] - y.p[j, k] for k in range(3)]
            d2 = gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]
            yield i, j, d2

    def found(family: str, a: Side, b: Side, ya: list[np.ndarray], yb: list[np.ndarray]) -> None:
        n, f = len(a.node), FAMILY_RANK[family]
        yaw, flip, rot = np.zeros(n), np.zeros(n, dtype=bool), np.zeros((n, 3))
        if family in ("stud", "hinge", "axle"):
            xa, za, xb = a.turn(0), a.turn(2), b.turn(0)
            turned = np.arctan2(-_dot(za, xb), _dot(xa, xb))
            if family == "axle":
                ax = _axis(ya)
                yaw, rot[:, 0] = _dot([b.p[:, k] - a.p[:, k] for k in range(3)], ax), turned
            else:
                yaw = turned
            if family != "stud":
                flip = _dot(ya, yb) < 0
        elif family == "ball":
            ca, cb = [a.turn(k) for k in range(3)], [b.turn(k) for k in range(3)]
            r = lambda i, j: _dot(ca[i], cb[j])
            down = np.clip(-r(2, 0), -1.0, 1.0)
            locked = np.abs(down) > 1 - 1e-12
            rot[:, 0] = np.where(locked, np.arctan2(np.sign(down) * r(0, 1), r(1, 1)), np.arctan2(r(2, 1), r(2, 2)))
            rot[:, 1], rot[:, 2] = np.arcsin(down), np.where(locked, 0.0, np.arctan2(r(1, 0), r(0, 0)))
        for k, v in (("family", np.full(n, f)), ("a", a.node), ("b", b.node), ("a_row", a.row), ("b_row", b.row), ("yaw", yaw), ("flip", flip), ("rot", rot)):
            out[k].append(v)

    text = lambda s: t.text[s.node]
    x, y = side("stud"), side("hole")
    for i, j, d2 in met(x, y, text):
        near = (d2 <= REACH**2) & cat.stud_fits[cat.sub_code[x.row[i]], cat.sub_code[y.row[j]]]
        a, b = x.where(i[near]), y.where(j[near])
        ya, yb = a.turn(1), b.turn(1)
        ok = _dot(_axis(ya), _axis(yb)) >= AXIS
        found("stud", a.where(ok), b.where(ok), [c[ok] for c in ya], [c[ok] for c in yb])
    kinds = int(cat.kind_sub.max(initial=0)) + 1
    for family in ("hinge", "ball", "fixed"):
        s = side(family)
        x, y = s.where(cat.inner[s.row]), s.where(cat.outer[s.row])
        for i, j, d2 in met(x, y, lambda s: t.text[s.node] * kinds + cat.kind_sub[s.row]):
            near = d2 <= REACH**2
            a, b = x.where(i[near]), y.where(j[near])
            ya, yb = a.turn(1), b.turn(1)
            along = _dot(_axis(ya), _axis(yb))
            ok = np.ones(len(along), dtype=bool)
            if family == "hinge":
                ok = np.abs(along) >= AXIS
            elif family == "fixed":
                ca, cb, trace = [a.turn(k) for k in range(3)], [b.turn(k) for k in range(3)], np.zeros(len(along))
                for r in range(3):
                    for c in range(3):
                        trace = trace + ca[c][r] * cb[c][r]
                ok = ~cat.oriented[a.row] | (along >= FIXED_AXIS) & (trace >= FIXED_TRACE)
            found(family, a.where(ok), b.where(ok), [c[ok] for c in ya], [c[ok] for c in yb])
    s = side("axle")
    x, y = s.where(cat.holding[s.row]), s.where(~cat.holding[s.row])
    for i, j, d2 in met(x, y, text, 2 * max(cat.longest, AXLE_RADIUS) + REACH, 2.0):
        fits = cat.axle_fits[cat.sub_code[x.row[i]], cat.sub_code[y.row[j]]]
        a, b, d2 = x.where(i[fits]), y.where(j[fits]), d2[fits]
        ya, yb = a.turn(1), b.turn(1)
        ax = _axis(yb)
        proj = _dot([b.p[:, k] - a.p[:, k] for k in range(3)], ax)
        off2 = d2 - proj * proj
        over = cat.radius[a.row] + cat.radius[b.row] - np.abs(proj)
        room = np.sqrt(np.maximum(0.0, REACH**2 - np.maximum(off2, 0.0)))
        ok = (np.abs(_dot(_axis(ya), ax)) >= AXLE_AXIS) & (off2 <= REACH**2) & ((over >= OVERLAP) | (room >= OVERLAP - over - SLACK))
        found("axle", a.where(ok), b.where(ok), [c[ok] for c in ya], [c[ok] for c in yb])
    shape = {"rot": (0, 3)}
    return {k: np.concatenate(v) if v else np.zeros(shape.get(k, (0,)), dtype=float if k in ("yaw", "rot") else bool if k == "flip" else np.int64) for k, v in out.items()}


def _degrees(radians: np.ndarray) -> np.ndarray:
    return np.mod(np.rint(np.degrees(radians)).astype(np.int64), 360)


def whole_numbers(e: dict[str, np.ndarray], forward: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """yaw, slide, angles of joints walked in a direction, as assembly.tree_edge has them."""
    f = e["family"]
    axle, turning = f == FAMILY_RANK["axle"], (f == FAMILY_RANK["axle"]) | (f == FAMILY_RANK["hinge"])
    sign = np.where(forward | turning & e["flip"], 1.0, -1.0)
    return _degrees(sign * np.where(axle, e["rot"][:, 0], e["yaw"])), np.rint(np.where(axle, sign * e["yaw"], 0.0)).astype(np.int64), _degrees(e["rot"])


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """(keys, texts) of about SLICE characters each."""
    texts, begin, chars = batch.column(1).to_pylist(), 0, 0
    for end in range(1, len(texts) + 1):
        chars += len(texts[end - 1])
        if chars >= SLICE or end == len(texts):
            yield batch.column(0).slice(begin, end - begin), texts[begin:end]
            begin, chars = end, 0


def _mapped(df: DataFrame, key: str, text: str, cat, work: Callable[[Reader, pa.Array, list[str]], pa.RecordBatch], schema: str) -> DataFrame:
    x = spread(df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")))
    kind = x.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(cat.value)
        for b in batches:
            for keys, texts in _slices(b):
                yield work(reader, keys, texts)

    return x.mapInArrow(run, f"key {kind}, {schema}")


def text_joints(df: DataFrame, key: str, text: str, parts: DataFrame, colors: DataFrame, connectors: DataFrame) -> DataFrame:
    """key, family, a, a_conn, b, b_conn, degrees, turned, slide: all joints between the placed parts of each text."""

    def work(reader: Reader, keys: pa.Array, texts: list[str]) -> pa.RecordBatch:
        t, cat = reader.read(texts), reader.cat
        e = joints_of(t, t.poses())
        yaw, slide, _ = whole_numbers(e, np.True_)
        f = e["family"]
        axle, hinge, stud = (f == FAMILY_RANK[k] for k in ("axle", "hinge", "stud"))
        i32 = lambda v, null=None: pa.array(v.astype(np.int32), mask=null)
        return pa.RecordBatch.from_arrays(
            [
                keys.take(pa.array(t.text[e["a"]])), pa.array(FAMILIES).take(pa.array(f)), i32(t.pos[e["a"]]), i32(cat.conn_idx[e["a_row"]]), i32(t.pos[e["b"]]), i32(cat.conn_idx[e["b_row"]]),
                i32(yaw, ~(axle | hinge | stud)), pa.array(e["flip"], mask=~(axle | hinge)), pa.array(slide, mask=~axle),
            ],
            names=["key", "family", "a", "a_conn", "b", "b_conn", "degrees", "turned", "slide"],
        )

    return _mapped(df, key, text, held(parts, colors, connectors), work, "family string, a int, a_conn int, b int, b_conn int, degrees int, turned boolean, slide bigint")


def _world(lo: np.ndarray, hi: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As affine.world_box."""
    low, high = [], []
    for i in range(3):
        a = b = m[:, i, 3]
        for j in range(3):
            p, q = m[:, i, j] * lo[:, j], m[:, i, j] * hi[:, j]
            a, b = a + np.minimum(p, q), b + np.maximum(p, q)
        low.append(a)
        high.append(b)
    return np.stack(low, axis=1), np.stack(high, axis=1)


def overlaps(text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows a < b of one text whose closed boxes overlap: in the order of their lower x, those that begin before a box
    ends are compared with it."""
    rank = np.empty(len(text), dtype=np.int64)
    order = np.lexsort((lo[:, 0], text))
    rank[order] = np.arange(len(order))
    # the rows of a text lie together in either order
    ends = np.searchsorted(text, text, side="right")
    x, end = lo[order, 0], ends[order]
    values = np.unique(np.concatenate((x, hi[:, 0])))
    wide = len(values) + 1
    line = text[order] * wide + np.searchsorted(values, x)
    behind = np.minimum(np.searchsorted(line, text[order] * wide + np.searchsorted(values, hi[order, 0]), side="right"), end)
    begin = np.arange(1, len(order) + 1)
    for i, j in _expanded(begin, np.maximum(behind - begin, 0)):
        i, j = order[i], order[j]
        ok = (lo[i, 1] <= hi[j, 1]) & (lo[j, 1] <= hi[i, 1]) & (lo[i, 2] <= hi[j, 2]) & (lo[j, 2] <= hi[i, 2])
        i, j = i[ok], j[ok]
        yield np.minimum(i, j), np.maximum(i, j)


def text_collisions(df: DataFrame, key: str, text: str, parts: DataFrame, colors: DataFrame, connectors: DataFrame, meshes: DataFrame) -> DataFrame:
    """key, collisions, first: what each placement in turn hits, as collision.collisions with the fixed joints of the
    texts. The meshes are held by each task. A part without a mesh fails the job."""
    shapes = df.sparkSession.sparkContext.broadcast({r["part_id"]: mesh_of(r) for r in meshes.select("part_id", *MESH).toLocalIterator()})

    def work(reader: Reader, keys: pa.Array, texts: list[str]) -> pa.RecordBatch:
        t, cat = reader.read(texts), reader.cat
        xf = t.poses()
        ids = cat.part_ids[t.part]
        mesh = {p: shapes.value.get(p) for p in np.unique(ids).tolist()}
        for p, m in mesh.items():
            if m is None:
                raise FileNotFoundError(f"no mesh for part {p}")
        ids = ids.tolist()
        lo, hi = (np.array([getattr(mesh[p], n) for p in ids], dtype=float).reshape(-1, 3) for n in ("lo", "hi"))
        fixed = np.where(t.e[:, 0] == FAMILY_RANK["fixed"], t.parent, -1)
        bad = np.zeros(len(ids), dtype=bool)
        for a, b in overlaps(t.text, *_world(lo, hi, xf)):
            keep = fixed[b] != a
            a, b = a[keep], b[keep]
            keep = ~parted(Boxes(lo[a], hi[a], xf[a]), Boxes(lo[b], hi[b], xf[b]))
            a, b = a[keep], b[keep]
            # of each part first the nearest, then the next two, four ...; what is known to hit is looked at no more
            gap = ((xf[a, :3, 3] - xf[b, :3, 3]) ** 2).sum(axis=1)
            order = np.lexsort((gap, b))
            a, b = a[order], b[order]
            rank, most = np.arange(len(b)) - np.searchsorted(b, b), 1
            while len(b):
                k = (rank < most) & ~bad[b]
                hit = meshes_cross([mesh[ids[i]] for i in a[k].tolist()], [mesh[ids[i]] for i in b[k].tolist()], np.linalg.inv(xf[a[k]]) @ xf[b[k]])
                bad[b[k][hit]] = True
                later = (rank >= most) & ~bad[b]
                a, b, rank, most = a[later], b[later], rank[later], 2 * most + 1
        # equal poses are equal bit by bit
        seen = set()
        for k, one in enumerate(zip(t.text.tolist(), ids, map(bytes, xf.reshape(-1, 16).view(np.uint8).reshape(-1, 128)))):
            if one in seen:
                bad[k] = True
            seen.add(one)
        at = np.flatnonzero(bad)
        many = np.bincount(t.text[at], minlength=len(texts))
        first, begin = t.sizes.copy(), np.cumsum(many) - many
        first[many > 0] = t.pos[at][begin[many > 0]]
        all_ = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))), pa.int32()), pa.array(t.pos[at], pa.int32()))
        there = pa.array(np.flatnonzero(t.sizes > 0))
        return pa.RecordBatch.from_arrays([keys.take(there), all_.take(there), pa.array(first, pa.int32()).take(there)], names=["key", "collisions", "first"])

    return _mapped(df, key, text, held(parts, colors, connectors), work, "collisions array<int>, first int")


def _lowest(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lowest node of each node's component: lower labels go over the edges and are followed, until none changes."""
    low = np.arange(nodes)
    while len(a):
        u, v = low[a], low[b]
        apart = u != v
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(low, np.maximum(u, v), np.minimum(u, v))
        while (low[low] != low).any():
            low = low[low]
    return low


def _breadth_first(to: list[int], bounds: list[int], base: int, seen: list[bool], nodes: list[int], seed: int | None) -> tuple[list[int], list[int], list[int]]:
    """Nodes, places of their parents and ways (numbers in `to`) in the order of the walk, as walks.breadth_first. The
    ways of node v lead from bounds[base + v] on to the nodes `to`."""
    if seed is not None and seed not in nodes:
        raise ValueError(f"node {seed} is not in the component")
    root = nodes[0] if seed is None else seed
    seen[root] = True
    out, parents, ways = [root], [-1], [-1]
    for place, u in enumerate(out):  # it grows
        for k in range(bounds[base + u], bounds[base + u + 1]):
            v = to[k]
            if not seen[v]:
                seen[v] = True
                out.append(v)
                parents.append(place)
                ways.append(k)
    return out, parents, ways


@functools.lru_cache(maxsize=4)
def _generator(seed: int) -> tuple[np.random.Generator, dict]:
    """A generator and the state that it begins in: setting that is sooner done than seeding."""
    g = np.random.default_rng(seed)
    return g, g.bit_generator.state


def _depth_first(to: list[int], bounds: list[int], base: int, seen: list[bool], nodes: list[int], seed: int) -> tuple[list[int], list[int], list[int]]:
    """The same as walks.depth_first."""
    generator, state = _generator(seed)
    generator.bit_generator.state, draw = state, generator.integers
    root = nodes[int(draw(len(nodes)))]
    seen[root] = True
    out, parents, ways = [root], [-1], [-1]
    stack = [(0, range(bounds[base + root], bounds[base + root + 1]))]
    while stack:
        place, left = stack[-1]
        left = [k for k in left if not seen[to[k]]]
        if not left:
            stack.pop()
            continue
        stack[-1] = place, left
        k = left[int(draw(len(left)))] if len(left) > 1 else left[0]  # of one nothing is drawn
        v = to[k]
        seen[v] = True
        stack.append((len(out), range(bounds[base + v], bounds[base + v + 1])))
        out.append(v)
        parents.append(place)
        ways.append(k)
    return out, parents, ways


def text_walks(df: DataFrame, key: str, text: str, parts: DataFrame, colors: DataFrame, connectors: DataFrame, method: str, seed: int | None) -> DataFrame:
    """key, component_index, text: each text's model walked again over all its joints, a walk for each component of two
    parts or more, and written; as walks.walked and grammar.serialized. The seed is every walk's; for bfs null is the lowest
    node, for random it must be given."""
    go = _breadth_first if method == "bfs" else _depth_first

    def work(reader: Reader, keys: pa.Array, texts: list[str]) -> pa.RecordBatch:
        t, cat = reader.read(texts), reader.cat
        e = joints_of(t, t.poses())
        n = len(e["a"])
        # both directions of each joint by node, in canonical order
        node, other = np.concatenate((e["a"], e["b"])), np.concatenate((e["b"], e["a"]))
        twice = lambda v: np.concatenate((v, v))
        order = np.lexsort((twice(cat.conn_idx[e["b_row"]]), twice(cat.conn_idx[e["a_row"]]), twice(e["family"]), other, node))
        bounds = np.searchsorted(node[order], np.arange(len(t.text) + 1)).tolist()
        to = t.pos[other[order]].tolist()
        low = t.pos[_lowest(len(t.text), e["a"], e["b"])]
        first = np.cumsum(t.sizes) - t.sizes
        whole = np.bincount(t.text, low > 0, minlength=len(texts)) == 0  # of one component
        low = low.tolist()
        at, index, ends, nodes, parents, ways = [], [], [0], [], [], []
        for k, (size, base, one) in enumerate(zip(t.sizes.tolist(), first.tolist(), whole.tolist())):
            if size < 2:
                continue
            comps = [list(range(size))]
            if not one:
                by: dict[int, list[int]] = {}
                for v in range(size):
                    by.setdefault(low[base + v], []).append(v)
                comps = sorted((c for c in by.values() if len(c) > 1), key=lambda c: (-len(c), c[0]))
            seen = [False] * size
            for c, own in enumerate(comps):
                v, u, w = go(to, bounds, base, seen, own, seed)
                nodes += [base + x for x in v]
                parents += u
                ways += w
                at.append(k)
                index.append(c)
                ends.append(len(nodes))
        lines = _written(cat, t, e, order, n, nodes, parents, ways)
        said = []
        for lo, hi in zip(ends, ends[1:]):
            own = lines[2 * lo : 2 * hi]
            del own[1]  # a root has no edge
            said.append(None if None in own else "\n".join(own) + "\n")
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(index, pa.int32()), pa.array(said, pa.string())], names=["key", "component_index", "text"])

    return _mapped(df, key, text, held(parts, colors, connectors), work, "component_index int, text string")


def _written(cat: Catalogue, t: Trees, e: dict[str, np.ndarray], order: np.ndarray, n: int, nodes: list[int], parents: list[int], ways: list[int]) -> list[str | None]:
    """The node line and the edge line of each visit, one after the other (a root's edge line is of no use); null where
    the catalogue lacks what they name."""
    part, color = t.part[nodes].tolist(), t.color[nodes].tolist()
    what = {pc: f" {cat.part_names[pc[0]]} | {cat.color_names[pc[1]]}" if cat.part_names.get(pc[0]) is not None and cat.color_names.get(pc[1]) is not None else None for pc in set(zip(part, color))}
    label = [letters(i) for i in range(int(t.sizes.max(initial=0)))]
    first, places = 0, []
    for i, u in enumerate(parents):
        if u < 0:
            first = i
        places.append(i - first)
    rows: list[str | None] = [None] * (2 * len(nodes))
    rows[::2] = [None if (x := what[pc]) is None else label[i] + x for i, pc in zip(places, zip(part, color))]
    at = np.flatnonzero(np.array(ways, dtype=np.int64) >= 0)
    way = order[np.array(ways, dtype=np.int64)[at]]
    back = way >= n
    j = {k: v[way - n * back] for k, v in e.items()}
    yaw, slide, angles = (v.tolist() for v in whole_numbers(j, ~back))
    p, c = np.where(back, j["b_row"], j["a_row"]).tolist(), np.where(back, j["a_row"], j["b_row"]).tolist()
    up = [label[u] for u in parents if u >= 0]
    turned = [("regular", "flip")[x] for x in j["flip"].tolist()]
    named, sided, last = cat.named, cat.sided, cat.at
    stud, axle, hinge, ball = (FAMILY_RANK[k] for k in ("stud", "axle", "hinge", "ball"))
    out = []
    for i, f in enumerate(j["family"].tolist()):
        if f == stud:
            out.append(f"{up[i]} stud {named[p[i]]} {named[c[i]]} {yaw[i]}")
        elif f == axle:
            out.append(f"{up[i]} axle {named[p[i]]} {named[c[i]]} {turned[i]} {yaw[i]} {slide[i]}")
        elif sided[p[i]] is None:
            out.append(None)
        else:
            tail = f" {turned[i]} {yaw[i]}" if f == hinge else " {} {} {}".format(*angles[i]) if f == ball else ""
            out.append(f"{up[i]} {FAMILIES[f]} {sided[p[i]]} {last[c[i]]}{tail}")
    for i, line in zip(at.tolist(), out):
        rows[2 * i + 1] = line
    return rows
