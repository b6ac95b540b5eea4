"""Exact integer columns with a known bound: plans that could overflow do not build.

``Exact`` carries a Spark column and the signed bits that hold every value it can take.  Up to 63 bits the
column is BIGINT (whole-stage codegen on primitives), up to 127 DECIMAL(38, 0); an expression beyond that raises
``WidthError`` when the plan is built, which is where callers switch to the big-integer kernels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_BITS, DECIMAL_BITS = 63, 127
DECIMAL = "decimal(38,0)"


class WidthError(ValueError):
    """The bound of an exact expression exceeds what a Spark decimal holds."""


@dataclass(frozen=True)
class Exact:
    col: Column
    bits: int

    def __post_init__(self):
        if self.bits > DECIMAL_BITS:
            raise WidthError(f"{self.bits} bits do not fit decimal(38,0)")

    @property
    def small(self) -> bool:
        return self.bits <= LONG_BITS

    def at(self, bits: int) -> Column:
        """The column in the type that ``bits`` asks for."""
        return self.col.cast("bigint") if bits <= LONG_BITS else self.col.cast(DECIMAL)

    def _with(self, other, bits: int, op) -> Exact:
        other = as_exact(other)
        if bits > DECIMAL_BITS:
            raise WidthError(f"{bits} bits do not fit decimal(38,0)")
        out = op(self.at(bits), other.at(bits))
        return Exact(out if bits <= LONG_BITS else out.cast(DECIMAL), bits)

    def __add__(self, other):
        other = as_exact(other)
        return self._with(other, max(self.bits, other.bits) + 1, lambda a, b: a + b)

    def __sub__(self, other):
        other = as_exact(other)
        return self._with(other, max(self.bits, other.bits) + 1, lambda a, b: a - b)

    def __mul__(self, other):
        other = as_exact(other)
        return self._with(other, self.bits + other.bits, lambda a, b: a * b)

    def __neg__(self):
        return Exact(-self.at(self.bits), min(self.bits + 1, DECIMAL_BITS))

    def sign(self) -> Column:
        """-1, 0 or 1 as INT (not the double of ``sign``)."""
        zero = F.lit(0).cast("bigint" if self.small else DECIMAL)
        c = self.at(self.bits)
        return F.when(c > zero, 1).when(c < zero, -1).otherwise(F.when(c.isNull(), F.lit(None).cast("int")).otherwise(0))

    def is_zero(self) -> Column:
        return self.at(self.bits) == F.lit(0)

    def compare(self, other) -> Column:
        """Sign of the difference: -1, 0 or 1."""
        return (self - other).sign()

    def within(self, bits: int) -> Exact:
        """Narrow to ``bits``; a value outside raises when it is met."""
        lo, hi = F.lit(str(-(1 << (bits - 1)))).cast(DECIMAL), F.lit(str((1 << (bits - 1)) - 1)).cast(DECIMAL)
        c = self.at(self.bits)
        ok = (c.cast(DECIMAL) >= lo) & (c.cast(DECIMAL) <= hi)
        return Exact(F.when(c.isNull() | ok, Exact(c, bits).at(bits)).otherwise(F.raise_error(F.lit(f"value needs more than {bits} bits"))), bits)

    def shift_left(self, s: int) -> Exact:
        return self * Exact(F.lit(str(1 << s)).cast(DECIMAL if s >= 62 else "bigint"), s + 2) if s else self

    def shift_right(self, s: int) -> Exact:
        """Floor division by 2**s."""
        c = self.at(self.bits)
        if self.small:
            return Exact(F.shiftright(c, min(s, 63)), max(self.bits - s, 1))
        by = F.lit(str(1 << s)).cast(DECIMAL)
        down = F.floor(c / by)
        q = ((c - F.pmod(c, by)) / by).cast(DECIMAL)
        del down
        return Exact(q, max(self.bits - s, 2))

    def min_bits(self) -> Column:
        """Signed bits that the value itself needs; BIGINT columns only."""
        if not self.small:
            raise WidthError("min_bits of a decimal column is a kernel function")
        c = self.at(self.bits)
        flipped = F.when(c < 0, -(c + 1)).otherwise(c)
        return F.when(flipped == 0, 1).otherwise(F.length(F.bin(flipped)) + 1)


def as_exact(x) -> Exact:
    if isinstance(x, Exact):
        return x
    if isinstance(x, int):
        bits = x.bit_length() + 1
        return Exact(F.lit(x).cast("bigint") if bits <= LONG_BITS else F.lit(str(x)).cast(DECIMAL), bits)
    raise TypeError(f"{x!r} has no known bound")


def coordinate(name: str | Column, b: int) -> Exact:
    """A grid coordinate in [-2^(b-1), 2^(b-1))."""
    return Exact(F.col(name) if isinstance(name, str) else name, b)


def point(x, y, z, b: int) -> tuple[Exact, Exact, Exact]:
    return coordinate(x, b), coordinate(y, b), coordinate(z, b)


def det2(a, b, c, d) -> Exact:
    return a * d - b * c


def cross(u, v) -> tuple[Exact, Exact, Exact]:
    return det2(u[1], u[2], v[1], v[2]), det2(u[2], u[0], v[2], v[0]), det2(u[0], u[1], v[0], v[1])


def dot(u, v) -> Exact:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def det3(u, v, w) -> Exact:
    return dot(u, cross(v, w))


def minus(u, v) -> tuple[Exact, ...]:
    return tuple(a - b for a, b in zip(u, v, strict=True))


# -- planes: (a, b, c, d) with a x + b y + c z + d = 0 --------------------------------------------------------


def plane_of(p, q, r) -> tuple[Exact, ...]:
    """Plane through three points, normal (q - p) x (r - p)."""
    n = cross(minus(q, p), minus(r, p))
    return (*n, -dot(n, p))


def axis_plane(axis: int, at: Exact) -> tuple[Exact, ...]:
    one, zero = as_exact(1), as_exact(0)
    return (*(one if k == axis else zero for k in range(3)), -at)


def edge_plane(p, q, support) -> tuple[tuple[Exact, ...], Column]:
    """A plane through edge p to q and parallel to an axis, neither empty nor parallel to the support; and the axis chosen.

    Candidates in the order X, Y, Z.
    """
    dx, dy, dz = minus(q, p)
    zero = as_exact(0)
    choices = ((zero, dz, -dy), (-dz, zero, dx), (dy, -dx, zero))
    axis = F.lit(None).cast("int")
    for k in (2, 1, 0):
        n = choices[k]
        parallel = cross(n, support[:3])
        good = ~(n[0].is_zero() & n[1].is_zero() & n[2].is_zero()) & ~(parallel[0].is_zero() & parallel[1].is_zero() & parallel[2].is_zero())
        axis = F.when(good, k).otherwise(axis)
    bits = max(c.bits for n in choices for c in n)
    normal = tuple(Exact(F.when(axis == 0, choices[0][k].at(bits)).when(axis == 1, choices[1][k].at(bits)).when(axis == 2, choices[2][k].at(bits)), bits) for k in range(3))
    return (*normal, -dot(normal, p)), axis


def plane_sum(p, q, sign: int = 1) -> tuple[Exact, ...]:
    return tuple(a + b if sign > 0 else a - b for a, b in zip(p, q, strict=True))


def is_degenerate(plane) -> Column:
    return plane[0].is_zero() & plane[1].is_zero() & plane[2].is_zero()


def is_null(plane) -> Column:
    return is_degenerate(plane) & plane[3].is_zero()


def side_value(plane, p) -> Exact:
    return dot(plane[:3], p) + plane[3]


def side(plane, p) -> Column:
    return side_value(plane, p).sign()


def leading_negative(plane) -> Column:
    """Whether the first non-zero coefficient is negative: the plane is stored flipped."""
    s = [c.sign() for c in plane]
    return F.coalesce(*[F.when(x != 0, x < 0) for x in s], F.lit(False))


def gcd(values: list[Exact]) -> Column:
    """Greatest common divisor of the absolute values by Euclid's steps, as DECIMAL(38, 0)."""
    bits = max(v.bits for v in values)
    kind = "bigint" if bits <= LONG_BITS else DECIMAL
    steps = int(bits * 1.45) + 3
    zero = F.lit(0).cast(kind)

    def two(a: Column, b: Column) -> Column:
        start = F.struct(a.cast(kind).alias("a"), b.cast(kind).alias("b"))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: F.when(s["b"] == zero, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == zero, F.lit(1).cast(kind)).otherwise(s["b"])).cast(kind).alias("b"))))
        return end["a"]

    out = F.abs(values[0].at(bits))
    for v in values[1:]:
        out = two(out, F.abs(v.at(bits)))
    return out


def plane_minor(p, q, i: int, j: int) -> Exact:
    return p[i] * q[j] - p[j] * q[i]


def plane_same(p, q) -> Column:
    """Proportional in either orientation."""
    out = F.lit(True)
    for i in range(4):
        for j in range(i + 1, 4):
            out = out & plane_minor(p, q, i, j).is_zero()
    return out


# -- predicates ----------------------------------------------------------------------------------------------


def orient3d_value(a, b, c, d) -> Exact:
    return det3(minus(a, d), minus(b, d), minus(c, d))


def orient3d(a, b, c, d) -> Column:
    return orient3d_value(a, b, c, d).sign()


PROJECT = ((1, 2), (2, 0), (0, 1))


def orient2d_value(a, b, c, axis: int) -> Exact:
    """Orientation of c against a to b, seen along an axis: X as (y, z), Y as (z, x), Z as (x, y)."""
    u, v = PROJECT[axis]
    return det2(b[u] - a[u], b[v] - a[v], c[u] - a[u], c[v] - a[v])


def orient2d(a, b, c, axis: int) -> Column:
    return orient2d_value(a, b, c, axis).sign()


def ray_orient(a, b, p, axis: int) -> Column:
    """orient2d of p against the edge, never 0: the ray's origin is moved by (e, e*e) in the projection."""
    u, v = PROJECT[axis]
    tie = F.when((a[v] - b[v]).sign() != 0, (a[v] - b[v]).sign()).otherwise(F.when((b[u] - a[u]).sign() > 0, 1).otherwise(-1))
    s = orient2d(a, b, p, axis)
    return F.when(s != 0, s).otherwise(tie)


def crossing(tri, p, axis: int, plane=None) -> Column:
    """+1 or -1 where the ray from p along +axis crosses the triangle (the sign of its normal), else 0."""
    plane = plane or plane_of(*tri)
    n = plane[axis].sign()
    o = [ray_orient(tri[k], tri[(k + 1) % 3], p, axis) for k in range(3)]
    hit = (n != 0) & (o[0] == o[1]) & (o[1] == o[2]) & (side(plane, p) != n)
    return F.when(hit, n).otherwise(0)


def tetra_volume6(a, b, c) -> Exact:
    return det3(a, b, c)


def box_value(plane, box, high: bool) -> Exact:
    """The largest (or smallest) of N.p + d over the corners of a box ((lo), (hi))."""
    out = plane[3]
    for k in range(3):
        lo, hi = plane[k] * box[0][k], plane[k] * box[1][k]
        bits = max(lo.bits, hi.bits)
        out = out + Exact((F.greatest if high else F.least)(lo.at(bits), hi.at(bits)), bits)
    return out


def plane_crosses_box(plane, box) -> Column:
    """Whether the closed box touches the plane."""
    return (box_value(plane, box, False).sign() <= 0) & (box_value(plane, box, True).sign() >= 0)


def on_surface(tri, p, plane=None) -> Column:
    """Whether p lies on the closed, non-degenerate triangle."""
    plane = plane or plane_of(*tri)
    on = F.lit(False)
    for axis in (2, 1, 0):
        o = [orient2d(tri[k], tri[(k + 1) % 3], p, axis) for k in range(3)]
        inside = ~(F.least(*o) < 0) | ~(F.greatest(*o) > 0)
        on = F.when(plane[axis].sign() != 0, inside).otherwise(on)
    return (side(plane, p) == 0) & ~is_degenerate(plane) & on


# -- rational points (x, y, z, w) ----------------------------------------------------------------------------


def homogeneous(p) -> tuple[Exact, ...]:
    return (*p, as_exact(1))


def meet3(p, q, r) -> tuple[Exact, ...]:
    """The point of three planes by Cramer's rule; w = 0 where they have no single point."""
    w = det3(p[:3], q[:3], r[:3])
    rhs = [-s[3] for s in (p, q, r)]
    cols = list(zip(p[:3], q[:3], r[:3], strict=True))
    out = []
    for k in range(3):
        m = [list(c) for c in cols]
        m[k] = rhs
        out.append(dot(m[0], cross(m[1], m[2])))
    return (*out, w)


def side_h(plane, p) -> Column:
    """Side of a rational point."""
    value = plane[0] * p[0] + plane[1] * p[1] + plane[2] * p[2] + plane[3] * p[3]
    return value.sign() * p[3].sign()


def compare_h(p, q, axis: int) -> Column:
    """Sign of p[axis]/p.w - q[axis]/q.w."""
    return (p[axis] * q[3] - q[axis] * p[3]).sign() * p[3].sign() * q[3].sign()


def compare_h_int(p, axis: int, value: Exact) -> Column:
    return (p[axis] - value * p[3]).sign() * p[3].sign()


def equal_h(p, q) -> Column:
    return (compare_h(p, q, 0) == 0) & (compare_h(p, q, 1) == 0) & (compare_h(p, q, 2) == 0)


def orient2d_h(a, b, p, axis: int) -> Column:
    """Orientation of a rational point against an integer edge."""
    u, v = PROJECT[axis]
    value = (b[u] - a[u]) * (p[v] - a[v] * p[3]) - (b[v] - a[v]) * (p[u] - a[u] * p[3])
    return value.sign() * p[3].sign()


# -- planes around a common line -------------------------------------------------------------------------------


def radial_direction(p, q) -> tuple[Exact, ...]:
    return cross(p[:3], q[:3])


def radial_det(p, d, q) -> Column:
    return det3(p[:3], d, q[:3]).sign()


def radial_dot(p, q) -> Column:
    return dot(p[:3], q[:3]).sign()
