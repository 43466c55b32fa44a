"""Calibrations: pixels to physical coordinates and back, optical lines, stereo."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SimpleCalibration:
    """A pixel size from two points (row, column) a known distance apart."""

    point0: tuple[float, float]
    point1: tuple[float, float]
    distance: float
    aspect_ratio: float = 1.0
    origin: tuple[float, float] = (0.0, 0.0)
    origin_phys: tuple[float, float] = (0.0, 0.0)

    @property
    def size_x(self) -> float:
        d0, d1 = self.point1[0] - self.point0[0], self.point1[1] - self.point0[1]
        return self.distance / math.sqrt(d0**2 + (self.aspect_ratio * d1) ** 2)

    @property
    def size_y(self) -> float:
        return self.aspect_ratio * self.size_x

    def to_phys(self, table: DataFrame, ix: str = "ix", iy: str = "iy") -> DataFrame:
        """Add x_phys and y_phys."""
        x = self.origin_phys[1] + self.size_x * (F.col(ix) - self.origin[1])
        y = self.origin_phys[0] + self.size_y * (F.col(iy) - self.origin[0])
        return table.withColumn("x_phys", x).withColumn("y_phys", y)

    def displacement_to_phys(self, table: DataFrame, dx: str = "dx", dy: str = "dy") -> DataFrame:
        """Add dx_phys and dy_phys as well."""
        return self.to_phys(table).withColumn("dx_phys", self.size_x * F.col(dx)).withColumn("dy_phys", self.size_y * F.col(dy))


@dataclass(frozen=True)
class Tsai:
    """A pinhole camera with radial distortion; lengths in centimetres, the rotation row by row.

    ``slices`` are points (x, y, z) of the light sheets, ``angles`` their rotation vectors in degrees; ``interface`` is the
    height of a horizontal interface below which light is refracted by ``index``.
    """

    f: tuple[float, float]
    c: tuple[float, float]
    kc: float
    t: tuple[float, float, float]
    r: tuple[float, ...]
    slices: tuple[tuple[float, float, float], ...]
    angles: tuple[tuple[float, float, float], ...] | None = None
    interface: float | None = None
    index: float = 1.0

    def _plane(self, level: int) -> tuple[float, float, float, bool]:
        """(z at the origin, slopes along x and y, whether it is tilted) of a light sheet."""
        point = np.array(self.slices[level])
        turn = np.array(self.angles[level] if self.angles else (0.0, 0.0, 0.0), float)
        size = np.linalg.norm(turn)
        if not size:
            return float(point[2]), 0.0, 0.0, False
        axis, angle = turn / size, math.radians(size)
        # the rotated vertical: Rodrigues' formula for (0, 0, 1)
        normal = axis * axis[2] * (1 - math.cos(angle)) + np.array([axis[1], -axis[0], 0.0]) * math.sin(angle) + np.array([0.0, 0.0, math.cos(angle)])
        return float(normal @ point / normal[2]), float(-normal[0] / normal[2]), float(-normal[1] / normal[2]), True

    def _seen(self, z: float) -> float:
        """Height at which a point below the interface seems to be."""
        return self.interface - (self.interface - z) / self.index if self.interface is not None and self.interface > z else z

    def to_phys(self, table: DataFrame, level: int, height: int, ix: str = "ix", iy: str = "iy") -> DataFrame:
        """Add x_phys, y_phys and z_phys in metres: where the line of sight through a pixel meets the sheet; rows count from the top.

        The camera's equations are linear in (x, y) once the pixel is undistorted and z is a plane; they are solved by Cramer's rule.
        """
        z0, a, b, tilted = self._plane(level)
        seen = self._seen(z0)
        bent = self.index if tilted and seen != z0 else 1.0
        rows = np.array(self.r, float).reshape(3, 3)
        in_x, in_y = rows[:, 0] + a / bent * rows[:, 2], rows[:, 1] + b / bent * rows[:, 2]
        fixed = rows[:, 2] * seen + np.array(self.t)
        u, v = (F.col(ix) - self.c[0]) / self.f[0], (F.lit(height) - F.col(iy) - self.c[1]) / self.f[1]
        bend = 1 + self.kc * (u * u + v * v)
        u, v = u / bend, v / bend
        # (in_x[0] - u in_x[2]) x + (in_y[0] - u in_y[2]) y = u fixed[2] - fixed[0], the same for v
        p = [float(in_x[k]) for k in range(3)]
        q = [float(in_y[k]) for k in range(3)]
        g = [float(fixed[k]) for k in range(3)]
        a11, a12, a21, a22 = p[0] - u * p[2], q[0] - u * q[2], p[1] - v * p[2], q[1] - v * q[2]
        c1, c2 = u * g[2] - g[0], v * g[2] - g[1]
        det = a11 * a22 - a12 * a21
        x, y = (c1 * a22 - a12 * c2) / det, (a11 * c2 - c1 * a21) / det
        return table.withColumn("x_phys", x / 100).withColumn("y_phys", y / 100).withColumn("z_phys", F.lit(z0) / 100 + a / bent * F.col("x_phys") + b / bent * F.col("y_phys"))

    def displacement_to_phys(self, table: DataFrame, level: int, height: int) -> DataFrame:
        """Add the physical displacement: the difference between both ends of (dx, dy) around the pixel."""
        out = self.to_phys(table, level, height)
        for sign, name in ((0.5, "b"), (-0.5, "a")):
            end = out.withColumn("_ix", F.col("ix") + sign * F.col("dx")).withColumn("_iy", F.col("iy") + sign * F.col("dy"))
            keep = out.columns
            moved = self.to_phys(end.withColumnsRenamed({"x_phys": "_x0", "y_phys": "_y0", "z_phys": "_z0"}), level, height, "_ix", "_iy")
            out = moved.withColumnsRenamed({"x_phys": f"_x{name}", "y_phys": f"_y{name}", "z_phys": f"_z{name}"}).withColumnsRenamed({"_x0": "x_phys", "_y0": "y_phys", "_z0": "z_phys"}).select(*keep, f"_x{name}", f"_y{name}", f"_z{name}")
        for axis in "xyz":
            out = out.withColumn(f"d{axis}_phys", F.col(f"_{axis}b") - F.col(f"_{axis}a")).drop(f"_{axis}a", f"_{axis}b")
        return out

    def to_pixels(self, table: DataFrame, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
        """Add px and py: where a point in metres is seen."""
        xs, ys, zs = (F.col(c) * 100 for c in (x, y, z))
        if self.interface is not None:
            zs = F.when(zs < self.interface, self.interface - (self.interface - zs) / self.index).otherwise(zs)
        r, t = [float(v) for v in self.r], [float(v) for v in self.t]
        across, down, ahead = (r[3 * k] * xs + r[3 * k + 1] * ys + r[3 * k + 2] * zs + t[k] for k in range(3))
        u, v = across / ahead, down / ahead
        bend = 1 + self.kc * (u * u + v * v)
        return table.withColumn("px", self.f[0] * u * bend + self.c[0]).withColumn("py", self.f[1] * v * bend + self.c[1])


def plane_equation(z0: float, alpha: float, beta: float) -> tuple[float, float, float, float]:
    """(a, b, c, d) of a plane through (0, 0, z0) turned around one of the axes x (alpha) and y (beta)."""
    if alpha and beta:
        raise ValueError("only one angle may differ from 0")
    c = math.cos(alpha) * math.cos(beta)
    return math.sin(beta), -math.sin(alpha) * math.cos(beta), c, -c * z0


def plane_base(nx: float, ny: float, nz: float) -> tuple[np.ndarray, np.ndarray]:
    """Base of a plane with a nearly vertical normal, first vector without a y part, and its inverse."""
    ez = np.array([nx, ny, nz]) / np.linalg.norm([nx, ny, nz])
    ex = np.array([1.0, 0.0, -nx / nz])
    ex /= np.linalg.norm(ex)
    base = np.stack([ex, np.cross(ez, ex), ez], 1)
    return base, np.linalg.inv(base)


def meet_plane(lines: DataFrame, plane: tuple[float, float, float, float]) -> DataFrame:
    """Add X, Y, Z: where the lines (x0, y0, z0) + t (dx, dy, dz) meet a plane; null for parallel ones."""
    a, b, c, d = plane
    over = a * F.col("x0") + b * F.col("y0") + c * F.col("z0") + d
    t = F.try_divide(-over, a * F.col("dx") + b * F.col("dy") + c * F.col("dz"))
    return lines.withColumn("X", F.col("x0") + t * F.col("dx")).withColumn("Y", F.col("y0") + t * F.col("dy")).withColumn("Z", F.col("z0") + t * F.col("dz"))


def fit_lines(points: DataFrame) -> DataFrame:
    """The optical line of each pixel (ix, iy) through its points (X, Y, Z) on the planes: mean point and main direction upwards.

    A pixel has a point per plane; the direction is the largest singular vector of the centred points.
    """

    def fit(t):
        import pandas as pd

        p = t[["X", "Y", "Z"]].to_numpy(float)
        p = p[np.argsort(p[:, 2])]
        mean = p.mean(axis=0)
        direction = np.linalg.svd(p - mean)[2][0]
        direction = direction if direction[2] >= 0 else -direction
        return pd.DataFrame([(t["ix"].iloc[0], t["iy"].iloc[0], *mean, *direction)], columns=["ix", "iy", "x0", "y0", "z0", "dx", "dy", "dz"])

    return points.groupBy("ix", "iy").applyInPandas(fit, "ix double, iy double, x0 double, y0 double, z0 double, dx double, dy double, dz double")


def camera_base(lines: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The base normal to the mean direction of lines."""
    row = lines.agg(F.avg("dx").alias("x"), F.avg("dy").alias("y"), F.avg("dz").alias("z")).first()
    return plane_base(row["x"], row["y"], row["z"])


def to_camera(table: DataFrame, inverse: np.ndarray, columns: tuple[str, str, str], names: tuple[str, str]) -> DataFrame:
    """Components of a displacement along the first two vectors of a base."""
    for k, name in enumerate(names):
        table = table.withColumn(name, sum((float(inverse[k, m]) * F.col(c) for m, c in enumerate(columns)), F.lit(0.0)))
    return table


#: Cosine above which two cameras' axes count as the same one.
SAME_AXIS = math.cos(math.radians(10))


def stereo_solutions(base0: np.ndarray, base1: np.ndarray) -> list[tuple[tuple[str, str, str], np.ndarray]]:
    """The choices of three of the four camera components, each with the matrix that gives the displacement.

    Two components along nearly the same direction aren't used together; cameras with no usable choice raise.
    """
    axes = {"d0x": base0[:, 0], "d0y": base0[:, 1], "d1x": base1[:, 0], "d1y": base1[:, 1]}
    found = []
    for chosen in (("d0x", "d0y", "d1x"), ("d0x", "d1x", "d1y"), ("d0x", "d0y", "d1y"), ("d0y", "d1x", "d1y")):
        across = [abs(float(axes[p] @ axes[q])) for p in chosen for q in chosen if p[:2] == "d0" and q[:2] == "d1"]
        if max(across) < SAME_AXIS:
            found.append((chosen, np.linalg.inv(np.stack([axes[c] for c in chosen]))))
    if not found:
        raise ValueError("the cameras look from the same side")
    return found


def _squared_from(column: str):
    return lambda v: (v - F.col(column)) * (v - F.col(column))


def stereo_reconstruct(table: DataFrame, base0: np.ndarray, base1: np.ndarray) -> DataFrame:
    """Displacement in space from both cameras' components (d0x, d0y, d1x, d1y): mean and spread over all usable choices."""
    solutions = stereo_solutions(base0, base1)
    out = table
    for k, axis in enumerate("XYZ"):
        values = F.array(*[sum((float(m[k, j]) * F.col(c) for j, c in enumerate(chosen)), F.lit(0.0)) for chosen, m in solutions])
        known = F.filter(values, lambda v: v.isNotNull())
        mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known))
        out = out.withColumn(f"d{axis}", mean)
        out = out.withColumn(f"error_{axis}", F.sqrt(F.aggregate(F.transform(known, _squared_from(f"d{axis}")), F.lit(0.0), lambda a, v: a + v) / F.size(known)))
    return out


def common_view(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rectangle (x_min, x_max, y_min, y_max) that two clouds of points share."""
    box = lambda t, s: t.agg(*[f(c).alias(f"{c}_{n}{s}") for c in "xy" for f, n in ((F.min, "min"), (F.max, "max"))])
    both = box(a, 0).crossJoin(box(b, 1))  # a row each
    return both.select(*[(F.greatest if n == "min" else F.least)(f"{c}_{n}0", f"{c}_{n}1").alias(f"{c}_{n}") for c in "xy" for n in ("min", "max")])


def rodrigues(vector: tuple[float, float, float]) -> np.ndarray:
    """The matrix of a rotation vector."""
    angle = float(np.linalg.norm(vector))
    if not angle:
        return np.eye(3)
    x, y, z = np.array(vector) / angle
    cross = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + math.sin(angle) * cross + (1 - math.cos(angle)) * cross @ cross


def between(z: float, zs: list[float], values: list[np.ndarray]) -> np.ndarray:
    """Rotation or translation vectors at a height, linear between known ones."""
    table = np.array(values, float)
    return np.array([np.interp(z, zs, table[:, k]) for k in range(table.shape[1])])


def pinhole(table: DataFrame, rotation: np.ndarray, shift: np.ndarray, matrix: np.ndarray, distortion: tuple[float, ...] = (0.0,) * 5, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Add px and py: points projected by a camera with radial (k1, k2, k3) and tangential (p1, p2) distortion."""
    c = [sum((float(rotation[k, m]) * F.col(n) for m, n in enumerate((x, y, z))), F.lit(float(shift[k]))) for k in range(3)]
    u, v = c[0] / c[2], c[1] / c[2]
    k1, k2, p1, p2, k3 = distortion
    r2 = u * u + v * v
    radial = 1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
    ud = u * radial + 2 * p1 * u * v + p2 * (r2 + 2 * u * u)
    vd = v * radial + p1 * (r2 + 2 * v * v) + 2 * p2 * u * v
    return table.withColumn("px", float(matrix[0, 0]) * ud + float(matrix[0, 2])).withColumn("py", float(matrix[1, 1]) * vd + float(matrix[1, 2]))


def object_points(nx: int, ny: int, z: float, ds: float) -> list[tuple[float, float, float]]:
    """A centred target grid at a height; the numbers of points must be odd."""
    if nx % 2 == 0 or ny % 2 == 0:
        raise ValueError("a centred grid needs odd numbers of points")
    return [((k - nx // 2) * ds, (m - ny // 2) * ds, z) for m in range(ny) for k in range(nx)]


def sort_to_grid(points: DataFrame, ds: float) -> DataFrame:
    """Number detected points row by row: k by rounded y, then x."""
    from pyspark.sql import Window as W

    return points.withColumn("k", F.row_number().over(W.orderBy(F.bround(F.col("y") / ds), F.bround(F.col("x") / ds))) - 1)  # the few points of one target


def as_column(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
