"""Quaternions [w, x, y, z] and 4x4 row-major transforms as array<double> columns, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import bound, col, dot, norm, scale

#: Nearly parallel quaternions are interpolated linearly; sines this close to one count as gimbal lock.
PARALLEL, GIMBAL = 0.9995, 0.99999


def quat(w, x, y, z) -> Column:
    return F.array(*[col(c).cast("double") for c in (w, x, y, z)])


def conjugate(q: Column | str) -> Column:

    def body(q: Column) -> Column:
        return F.array(q[0], -q[1], -q[2], -q[3])

    return bound(q, body)


def inverse(q: Column | str) -> Column:
    """Null for a zero quaternion."""
    return bound(q, lambda a: bound(dot(a, a), lambda d: F.when(d > 0, scale(conjugate(a), 1 / d))))


def normalised(q: Column | str) -> Column:
    """Null for a zero quaternion."""
    return bound(q, lambda a: bound(norm(a), lambda n: F.when(n > 0, scale(a, 1 / n))))


def product(p: Column | str, q: Column | str) -> Column:
    """Hamilton product."""

    def body(a: Column, b: Column) -> Column:
        pw, px, py, pz = (a[i] for i in range(4))
        qw, qx, qy, qz = (b[i] for i in range(4))
        return F.array(
            pw * qw - px * qx - py * qy - pz * qz,
            pw * qx + px * qw + py * qz - pz * qy,
            pw * qy - px * qz + py * qw + pz * qx,
            pw * qz + px * qy - py * qx + pz * qw,
        )

    return bound(p, lambda a: bound(q, lambda b: body(a, b)))


def exponential(q: Column | str) -> Column:

    def body(q: Column) -> Column:
        v = F.sqrt(q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
        f = F.exp(q[0]) * F.when(v == 0, F.lit(1.0)).otherwise(F.sin(v) / v)
        return F.array(F.exp(q[0]) * F.cos(v), f * q[1], f * q[2], f * q[3])

    return bound(q, body)


def logarithm(q: Column | str) -> Column:
    """Natural logarithm; a negative real has the imaginary part (pi, 0, 0)."""

    def body(q: Column) -> Column:
        v = F.sqrt(q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
        angle = F.atan2(v, q[0])
        part = lambda c, real: F.when(v == 0, F.when((q[0] < 0) & F.lit(real), F.pi()).otherwise(F.lit(0.0))).otherwise(angle * c / v)
        return F.array(F.log(norm(q)), part(q[1], True), part(q[2], False), part(q[3], False))

    return bound(q, body)


def power(q: Column | str, exponent: Column | float) -> Column:
    return exponential(scale(logarithm(q), exponent if isinstance(exponent, Column) else F.lit(float(exponent))))


def equivalent(q: Column | str, tolerance: float = 1e-12) -> tuple:
    """Canonical sign: the first component over the tolerance is positive."""

    def body(q: Column) -> Column:
        sign = F.coalesce(*[F.when(F.abs(q[i]) > tolerance, F.signum(q[i])) for i in range(4)], F.lit(1.0))
        return scale(q, sign)

    return bound(q, body)


def slerp(p: Column | str, q: Column | str, t: Column, parallel: float = PARALLEL, half_turn: float = 0.0) -> Column:
    """Unit quaternion at share t of the shorter arc from p to q; dot products below `half_turn` go by -q."""
    return bound(p, lambda a: bound(q, lambda b: _slerp(a, b, t, parallel, half_turn)))


def _slerp(p: Column, q: Column, t: Column, parallel: float, half_turn: float) -> Column:
    c = dot(p, q)
    near = F.least(F.abs(c), F.lit(1.0))
    to = scale(q, F.when(c < half_turn, F.lit(-1.0)).otherwise(F.lit(1.0)))
    theta = F.acos(near)
    a = F.when(near > parallel, 1 - t).otherwise(F.sin((1 - t) * theta) / F.sin(theta))
    b = F.when(near > parallel, t).otherwise(F.sin(t * theta) / F.sin(theta))
    return normalised(F.zip_with(scale(p, a), scale(to, b), lambda x, y: x + y))


def angle_degrees(p: Column | str, q: Column | str) -> Column:
    """Rotation angle between two unit quaternions, whatever their signs."""
    return 2 * F.degrees(F.acos(F.least(F.abs(dot(p, q)), F.lit(1.0))))


def rotation(q: Column | str) -> Column:
    """3x3 rotation matrix, row by row in one array, of a unit quaternion."""

    def body(q: Column) -> Column:
        w, x, y, z = (q[i] for i in range(4))
        return F.array(
            1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
            2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
            2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
        )

    return bound(q, body)


def rotate(q: Column | str, v: Column | str) -> Column:
    return apply3(rotation(q), v)


def apply3(m: Column, v: Column | str) -> Column:
    """3x3 matrix times vector."""
    return bound(m, lambda a: bound(v, lambda b: _apply3(a, b)))


def _apply3(m: Column, v: Column) -> Column:
    return F.array(*[m[3 * i] * v[0] + m[3 * i + 1] * v[1] + m[3 * i + 2] * v[2] for i in range(3)])


def from_rotation(m: Column | str) -> Column:
    """Unit quaternion of a row-major 3x3 matrix, by the largest of the four squared components."""

    def body(m: Column) -> Column:
        trace = m[0] + m[4] + m[8]
        s0, s1 = F.sqrt(1 + trace) * 2, F.sqrt(1 + m[0] - m[4] - m[8]) * 2
        s2, s3 = F.sqrt(1 + m[4] - m[0] - m[8]) * 2, F.sqrt(1 + m[8] - m[0] - m[4]) * 2
        q = F.when(trace > 0, F.array(s0 / 4, (m[7] - m[5]) / s0, (m[2] - m[6]) / s0, (m[3] - m[1]) / s0))
        q = q.when((m[0] > m[4]) & (m[0] > m[8]), F.array((m[7] - m[5]) / s1, s1 / 4, (m[1] + m[3]) / s1, (m[2] + m[6]) / s1))
        q = q.when(m[4] > m[8], F.array((m[2] - m[6]) / s2, (m[1] + m[3]) / s2, s2 / 4, (m[5] + m[7]) / s2))
        return normalised(q.otherwise(F.array((m[3] - m[1]) / s3, (m[2] + m[6]) / s3, (m[5] + m[7]) / s3, s3 / 4)))

    return bound(m, body)


def euler_fixed_xyz(q: Column | str) -> Column:
    """Roll, pitch, yaw in degrees about fixed axes; at gimbal lock the roll is zero."""
    return bound(rotation(q), _euler)


def _euler(m: Column) -> Column:
    up = -m[6]
    locked = F.abs(up) > GIMBAL
    pitch = F.when(locked, F.signum(up) * F.pi() / 2).otherwise(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), up))))
    roll = F.when(locked, F.lit(0.0)).otherwise(F.atan2(m[7], m[8]))
    yaw = F.when(locked, F.atan2(-m[1], m[4])).otherwise(F.atan2(m[3], m[0]))
    return F.array(F.degrees(roll), F.degrees(pitch), F.degrees(yaw))


def from_axis_angle(axis: Column | str, angle: Column) -> Column:
    """Null for an axis without direction."""
    a, n = col(axis), norm(axis)
    s = F.when(n > 0, F.sin(angle / 2) / n)
    return F.when(s.isNotNull(), F.array(F.cos(angle / 2), s * a[0], s * a[1], s * a[2]))


def axis_angle(q: Column | str) -> Column:
    """[ax, ay, az, angle]; the axis points so that at least two of its components are not negative."""

    def body(q: Column) -> Column:
        v = F.sqrt(q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
        axis = F.when(v == 0, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(q[1] / v, q[2] / v, q[3] / v))
        negatives = F.size(F.filter(axis, lambda x: x < 0))
        sign = F.when(negatives >= 2, F.lit(-1.0)).otherwise(F.lit(1.0))
        return F.concat(scale(axis, sign), F.array(sign * 2 * F.atan2(v, q[0])))

    return bound(q, body)


def rodrigues(q: Column | str, modified: bool = False) -> Column:
    """Rodrigues vector tan(angle/2) axis, or the modified one tan(angle/4) axis; null where that is infinite (a half or a whole turn)."""

    def body(q: Column) -> Column:
        d = 1 + q[0] if modified else q[0]
        return F.when(d != 0, F.array(q[1] / d, q[2] / d, q[3] / d))

    return bound(q, body)


#: Quarter turn about x from the tracker's frame.
_QUARTER = (0.5**0.5, -(0.5**0.5), 0.0, 0.0)


def tracker_to_instrument(q: Column | str) -> Column:
    """A tracker orientation in the instrument's frame: a quarter turn about x, then axes renamed."""
    turned = product(F.array(*[F.lit(c) for c in _QUARTER]), q)
    return normalised(bound(turned, lambda r: F.array(-r[0], -r[2], -r[3], r[1])))


def homogeneous(q: Column | str, p: Column | str) -> Column:
    """Row-major 4x4 transform of a unit quaternion and a position."""
    return bound(rotation(q), lambda m: bound(p, lambda v: _homogeneous(m, v)))


def _homogeneous(m: Column, p: Column) -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(m[0], m[1], m[2], p[0], m[3], m[4], m[5], p[1], m[6], m[7], m[8], p[2], zero, zero, zero, one)


def matmul4(a: Column | str, b: Column | str) -> Column:
    return bound(a, lambda x: bound(b, lambda y: _matmul4(x, y)))


def _matmul4(a: Column, b: Column) -> Column:
    return F.array(*[sum((a[4 * i + k] * b[4 * k + j] for k in range(1, 4)), a[4 * i] * b[j]) for i in range(4) for j in range(4)])


def rotation_part(t: Column | str) -> Column:

    def body(t: Column) -> Column:
        return F.array(*[t[4 * i + j] for i in range(3) for j in range(3)])

    return bound(t, body)


def position_part(t: Column | str) -> Column:

    def body(t: Column) -> Column:
        return F.array(t[3], t[7], t[11])

    return bound(t, body)


def apply_offset(q: Column | str, p: Column | str, offset: Column | str) -> tuple[Column, Column, Column]:
    """(position, roll-pitch-yaw, quaternion) of a pose followed by a fixed offset transform."""
    t = matmul4(homogeneous(q, p), offset)
    turned = from_rotation(rotation_part(t))
    return position_part(t), euler_fixed_xyz(turned), turned


def transform_point(t: Column | str, p: Column | str) -> Column:
    return bound(t, lambda m: bound(p, lambda v: _transform_point(m, v)))


def _transform_point(t: Column, p: Column) -> Column:
    return F.array(*[t[4 * i] * p[0] + t[4 * i + 1] * p[1] + t[4 * i + 2] * p[2] + t[4 * i + 3] for i in range(3)])


def transform_quaternion(t: Column | str, q: Column | str) -> Column:
    return normalised(product(from_rotation(rotation_part(t)), q))


def from_vectors(u: Column | str, v: Column | str) -> Column:
    """Shortest rotation that turns u to the direction of v; opposite vectors turn about an axis normal to u."""
    return bound(u, lambda a: bound(v, lambda b: _from_vectors(a, b)))


def _from_vectors(u: Column, v: Column) -> Column:
    size = F.nullif(norm(u) * norm(v), F.lit(0.0))
    c = dot(u, v) / size
    cross = F.array(u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    normal = F.when(F.abs(u[0]) < 0.9 * norm(u), F.array(F.lit(0.0), u[2], -u[1])).otherwise(F.array(-u[2], F.lit(0.0), u[0]))
    turned = normalised(F.concat(F.array(1 + c), scale(cross, 1 / size)))
    half_turn = normalised(F.concat(F.array(F.lit(0.0)), normal))
    return F.when(c > -1 + 1e-12, turned).otherwise(half_turn)


def from_euler(order: str, angles: Column | str) -> Column:
    """Quaternion of three successive turns (radians) about the moving axes named by order, such as 'XYZ' or 'ZXZ'."""

    def about(axis: str, angle: Column) -> Column:
        half = angle / 2
        return F.array(F.cos(half), *[F.sin(half) if a == axis else F.lit(0.0) for a in "XYZ"])

    a, b, c = order.upper()
    return bound(angles, lambda t: product(product(about(a, t[0]), about(b, t[1])), about(c, t[2])))


def to_euler(order: str, q: Column | str) -> Column:
    """The three angles (radians) of from_euler, after Bernardes and Viollet (2022); where only a sum or difference is
    determined, the first angle is 0."""
    i, j, k = ("XYZ".index(a) for a in reversed(order.upper()))
    proper = i == k
    if proper:
        k = 3 - i - j
    sign = float((i - j) * (j - k) * (k - i) // 2)

    def body(p: Column) -> Column:
        w, x, y, z = p[0], p[i + 1], p[j + 1], p[k + 1] * sign
        a, b, c, d = (w, x, y, z) if proper else (w - y, x + z, y + w, z - x)
        middle = 2 * F.atan2(F.hypot(c, d), F.hypot(a, b))
        plus, minus = F.atan2(b, a), F.atan2(d, c)
        flat, steep = middle < 1e-7, F.abs(middle - F.pi()) < 1e-7
        last = F.when(flat, 2 * plus).when(steep, -2 * minus).otherwise(plus - minus)
        first = F.when(flat | steep, F.lit(0.0)).otherwise(plus + minus)
        if not proper:
            first, middle = first * sign, middle - F.pi() / 2
        wrap = lambda t: F.when(t > F.pi(), t - 2 * F.pi()).when(t < -F.pi(), t + 2 * F.pi()).otherwise(t)
        return F.array(wrap(first), middle, wrap(last))

    return bound(q, body)


def complex_matrix(q: Column | str) -> Column:
    """The 2x2 complex matrix [[w + ix, y + iz], [-y + iz, w - ix]], row by row, each entry as real and imaginary part."""
    return bound(q, lambda p: F.array(p[0], p[1], p[2], p[3], -p[2], p[3], p[0], -p[1]))


def from_complex_matrix(m: Column | str) -> Column:
    """The quaternion of complex_matrix(), from the means of the entries that say the same."""
    return bound(m, lambda c: F.array((c[0] + c[6]) / 2, (c[1] - c[7]) / 2, (c[2] - c[4]) / 2, (c[3] + c[5]) / 2))


def rotate_tensor(q: Column | str, tensor: Column | str) -> Column:
    """R T R' for a row-by-row 3x3 tensor and the rotation R of a unit quaternion."""

    def body(m: Column, t: Column) -> Column:
        left = lambda i, k: m[3 * i] * t[k] + m[3 * i + 1] * t[3 + k] + m[3 * i + 2] * t[6 + k]
        return bound(F.array(*[left(i, k) for i in range(3) for k in range(3)]), lambda a: F.array(*[a[3 * i] * m[3 * j] + a[3 * i + 1] * m[3 * j + 1] + a[3 * i + 2] * m[3 * j + 2] for i in range(3) for j in range(3)]))

    return bound(rotation(q), lambda m: bound(tensor, lambda t: body(m, t)))


def turned_by_angles(q: Column | str, matrix: Column, calibration: Column | str, reference: Column | str) -> Column:
    """An orientation whose XYZ angles are mapped by a 3x3 matrix (angles as a row times it), followed by a calibration
    quaternion, with the sign that is nearer to a reference. Null if an input has no direction."""
    angles = bound(to_euler("XYZ", normalised(q)), lambda e: bound(matrix, lambda m: F.array(*[e[0] * m[j] + e[1] * m[3 + j] + e[2] * m[6 + j] for j in range(3)])))
    turned = normalised(product(from_euler("XYZ", angles), calibration))
    return bound(turned, lambda t: bound(reference, lambda f: F.when(dot(t, f) < 0, F.transform(t, lambda x: -x)).otherwise(t)))


def derivative(q: Column | str, rate: Column | str) -> Column:
    """Time derivative of an orientation that turns with an angular rate given in its own frame."""
    return scale(product(q, F.concat(F.array(F.lit(0.0)), col(rate))), F.lit(0.5))
