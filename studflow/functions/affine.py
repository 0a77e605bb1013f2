"""Row-major 4x4 affine matrices as array<double> of 16, worked on by Column expressions.

Pass columns (not long expressions) so that Catalyst evaluates each input once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(m: Column, i: int, j: int) -> Column:
    return F.get(m, F.lit(4 * i + j))


def _matrix(rows: list[list[Column]]) -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(*[x for r in rows for x in r], zero, zero, zero, one)


def product(a: Column, b: Column) -> Column:
    rows = []
    for i in range(3):
        row = []
        for j in range(4):
            x = _at(a, i, 0) * _at(b, 0, j) + _at(a, i, 1) * _at(b, 1, j) + _at(a, i, 2) * _at(b, 2, j)
            row.append(x + _at(a, i, 3) if j == 3 else x)
        rows.append(row)
    return _matrix(rows)


def inverse(m: Column) -> Column:
    """The inverse of any affine matrix (by cofactors, so not only of rotations); null if it has none."""
    a = [[_at(m, i, j) for j in range(3)] for i in range(3)]
    cof = [[a[(j + 1) % 3][(i + 1) % 3] * a[(j + 2) % 3][(i + 2) % 3] - a[(j + 1) % 3][(i + 2) % 3] * a[(j + 2) % 3][(i + 1) % 3] for j in range(3)] for i in range(3)]
    det = a[0][0] * cof[0][0] + a[0][1] * cof[1][0] + a[0][2] * cof[2][0]
    inv = [[c / F.nullif(det, F.lit(0.0)) for c in row] for row in cof]
    return F.when(det != 0, _matrix([[*row, -(row[0] * _at(m, 0, 3) + row[1] * _at(m, 1, 3) + row[2] * _at(m, 2, 3))] for row in inv]))


def frame(x: Column, y: Column, z: Column, pitch: Column, roll: Column, yaw: Column) -> Column:
    """A connector's frame: T(x,y,z) Ry(yaw) Rx(pitch) Rz(roll), degrees."""
    p, r, w = F.radians(pitch), F.radians(roll), F.radians(yaw)
    cx, sx, cz, sz, cy, sy = F.cos(p), F.sin(p), F.cos(r), F.sin(r), F.cos(w), F.sin(w)
    # columns of Rx Rz, turned about y
    u = (cz, cx * sz, sx * sz)
    v = (-sz, cx * cz, sx * cz)
    n = (F.lit(0.0), -sx, cx)
    turned = [(cy * c[0] + sy * c[2], c[1], cy * c[2] - sy * c[0]) for c in (u, v, n)]
    return _matrix([[turned[0][i], turned[1][i], turned[2][i], (x, y, z)[i]] for i in range(3)])


def turn(radians: Column) -> Column:
    """Rotation about y."""
    c, s, o, e = F.cos(radians), F.sin(radians), F.lit(0.0), F.lit(1.0)
    return _matrix([[c, o, s, o], [o, e, o, o], [-s, o, c, o]])


def axis(m: Column) -> Column:
    """The mating axis: the negated, normalised second column (zeros stay zeros)."""
    col = [_at(m, i, 1) for i in range(3)]
    n = F.sqrt(col[0] * col[0] + col[1] * col[1] + col[2] * col[2])
    return F.array(*[-c / F.when(n == 0, 1.0).otherwise(n) for c in col])


def column(m: Column, j: int) -> Column:
    return F.array(*[_at(m, i, j) for i in range(3)])


def dot(a: Column, b: Column) -> Column:
    return F.get(a, F.lit(0)) * F.get(b, F.lit(0)) + F.get(a, F.lit(1)) * F.get(b, F.lit(1)) + F.get(a, F.lit(2)) * F.get(b, F.lit(2))


def minus(a: Column, b: Column) -> Column:
    return F.array(*[F.get(a, F.lit(i)) - F.get(b, F.lit(i)) for i in range(3)])


def frame_trace(a: Column, b: Column) -> Column:
    """Trace of Ra' Rb: 3 for equal rotations."""
    out = None
    for i in range(3):
        for j in range(3):
            t = _at(a, i, j) * _at(b, i, j)
            out = t if out is None else out + t
    return out


def euler_xyz(a: Column, b: Column) -> Column:
    """Angles (x, y, z) with Rz Ry Rx = Ra' Rb. Where y is a right angle, x is measured and z is 0."""
    r = lambda i, j: _at(a, 0, i) * _at(b, 0, j) + _at(a, 1, i) * _at(b, 1, j) + _at(a, 2, i) * _at(b, 2, j)
    down = F.least(F.greatest(-r(2, 0), F.lit(-1.0)), F.lit(1.0))
    locked = F.abs(down) > 1 - 1e-12
    return F.array(
        F.when(locked, F.atan2(F.signum(down) * r(0, 1), r(1, 1))).otherwise(F.atan2(r(2, 1), r(2, 2))),
        F.asin(down),
        F.when(locked, 0.0).otherwise(F.atan2(r(1, 0), r(0, 0))),
    )


def world_box(lo: Column, hi: Column, m: Column) -> tuple[Column, Column]:
    """Lowest and highest corner of a box (arrays of three) after a transform."""
    low, high = [], []
    for i in range(3):
        a = b = _at(m, i, 3)
        for j in range(3):
            p, q = _at(m, i, j) * F.get(lo, F.lit(j)), _at(m, i, j) * F.get(hi, F.lit(j))
            a, b = a + F.least(p, q), b + F.greatest(p, q)
        low.append(a)
        high.append(b)
    return F.array(*low), F.array(*high)
