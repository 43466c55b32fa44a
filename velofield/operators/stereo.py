"""Two cameras: calibration by targets on planes, and both cameras' displacements on one grid."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from velofield.functions.kernels import griddata
from velofield.operators.calibration import plane_base


@dataclass
class DirectCalibration:
    """Optical lines (x0, y0, z0, dx, dy, dz) on a regular grid of pixels, interpolated between them; nothing outside it."""

    xs: np.ndarray
    ys: np.ndarray
    lines: np.ndarray  # len(ys) x len(xs) x 6

    @classmethod
    def fit(cls, points: np.ndarray, shape: tuple[int, int], nx: int, ny: int) -> DirectCalibration:
        """From a target's points (X, Y, Z, x, y) seen on several planes Z, in an image of (height, width).

        On each plane a pixel's place is interpolated over triangles of the target's points; a line goes through a pixel's
        places, of which there must be two. Pixels that see fewer take the lines of their neighbours.
        """
        xs, ys = np.linspace(0, shape[1] - 1, nx), np.linspace(0, shape[0] - 1, ny)
        pixels = np.stack(np.meshgrid(xs, ys), -1).reshape(-1, 2)
        places = []
        for z in np.unique(points[:, 2]):
            own = points[points[:, 2] == z]
            places.append(np.stack([griddata(own[:, 3:5], own[:, 0], pixels, False), griddata(own[:, 3:5], own[:, 1], pixels, False), np.full(len(pixels), z)], 1))
        lines = np.full((len(pixels), 6), np.nan)
        for k, seen in enumerate(np.stack(places, 1)):
            seen = seen[~np.isnan(seen).any(axis=1)]
            if len(seen) > 1:
                mean = seen.mean(axis=0)
                direction = np.linalg.svd(seen - mean)[2][0]
                lines[k] = *mean, *(direction if direction[2] >= 0 else -direction)
        known = ~np.isnan(lines[:, 0])
        if not known.any():
            raise ValueError("no pixel sees the target on two planes")
        for c in range(6):
            lines[~known, c] = griddata(pixels[known], lines[known, c], pixels[~known])
        return cls(xs, ys, lines.reshape(ny, nx, 6))

    def at(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The lines of pixels (n x 6), NaN outside the grid."""
        i = np.clip(np.searchsorted(self.xs, x, side="right") - 1, 0, len(self.xs) - 2)
        j = np.clip(np.searchsorted(self.ys, y, side="right") - 1, 0, len(self.ys) - 2)
        u, v = (x - self.xs[i]) / (self.xs[i + 1] - self.xs[i]), (y - self.ys[j]) / (self.ys[j + 1] - self.ys[j])
        out = sum((np.abs(1 - a - u) * np.abs(1 - b - v))[:, None] * self.lines[j + b, i + a] for a in (0, 1) for b in (0, 1))
        out[(u < 0) | (u > 1) | (v < 0) | (v > 1)] = np.nan
        return out

    def on_plane(self, x: np.ndarray, y: np.ndarray, plane: tuple[float, float, float, float]) -> np.ndarray:
        """Where the lines of pixels meet the plane a X + b Y + c Z + d = 0 (n x 3)."""
        line, normal = self.at(x, y), np.array(plane[:3])
        t = -(line[:, :3] @ normal + plane[3]) / (line[:, 3:] @ normal)
        return line[:, :3] + t[:, None] * line[:, 3:]

    def base(self) -> tuple[np.ndarray, np.ndarray]:
        """The base normal to the mean line, and its inverse."""
        return plane_base(*self.lines[..., 3:].reshape(-1, 3).mean(axis=0))

    def to_json(self) -> str:
        return json.dumps({"xs": self.xs.tolist(), "ys": self.ys.tolist(), "lines": self.lines.tolist()})

    @classmethod
    def from_json(cls, text: str) -> DirectCalibration:
        return cls(**{k: np.array(v) for k, v in json.loads(text).items()})


def apply_direct(vectors: DataFrame, camera: DirectCalibration, plane: tuple[float, float, float, float], x: str = "x", y: str = "y", dx: str = "dx", dy: str = "dy") -> DataFrame:
    """Add x_phys, y_phys, z_phys, where pixels see the plane, and dx_phys, dy_phys, dz_phys, their displacement on it; null
    outside the calibration."""
    added = [f"{d}{c}_phys" for d in ("", "d") for c in "xyz"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in parts:
            px, py, u, v = (t[c].to_numpy(float) for c in (x, y, dx, dy))
            place = camera.on_plane(px, py, plane)
            moved = camera.on_plane(px + u / 2, py + v / 2, plane) - camera.on_plane(px - u / 2, py - v / 2, plane)
            yield t.assign(**{n: np.where(np.isnan(c), None, c) for n, c in zip(added, np.hstack([place, moved]).T, strict=True)})

    return vectors.mapInPandas(run, StructType([*vectors.schema, *(StructField(n, DoubleType()) for n in added)]))


def join_cameras(a: DataFrame, b: DataFrame, base0: tuple, base1: tuple, xs: list[float], ys: list[float], key: str = "key") -> DataFrame:
    """Both cameras' components (d0x, d0y, d1x, d1y) of each key's displacements, at the nodes (X, Y) of one grid.

    A camera's displacements lie at places of its own; each key's are interpolated over triangles, and nodes outside them
    have nulls. A task holds one key's vectors of both cameras.
    """
    nodes = np.stack(np.meshgrid(xs, ys), -1).reshape(-1, 2)

    def meet(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        first = one if len(one) else other
        out = {key: first[key].iloc[0], "X": nodes[:, 0], "Y": nodes[:, 1]}
        for t, inverse, names in ((one, base0[1], ("d0x", "d0y")), (other, base1[1], ("d1x", "d1y"))):
            known = t[["x_phys", "y_phys", "dx_phys", "dy_phys", "dz_phys"]].astype(float).dropna().to_numpy()
            along = known[:, 2:] @ inverse[:2].T
            for k, n in enumerate(names):
                value = griddata(known[:, :2], along[:, k], nodes, False) if len(known) else np.full(len(nodes), np.nan)
                out[n] = np.where(np.isnan(value), None, value)
        return pd.DataFrame(out)

    kind = a.schema[key].dataType.simpleString()
    return a.groupBy(key).cogroup(b.groupBy(key)).applyInPandas(meet, f"{key} {kind}, X double, Y double, d0x double, d0y double, d1x double, d1y double")


#: Pixels a metre, and the middle of the image, of the cameras that ``target_points`` and ``seen_by`` stand for.
SCALE, MIDDLE = 600.0, (100.0, 80.0)


def target_points(angle: float, planes: tuple[float, ...] = (-0.05, 0.0, 0.05)) -> np.ndarray:
    """A made target (X, Y, Z, x, y) on planes, as a far camera at an angle around the y axis sees it."""
    side = np.linspace(-0.25, 0.35, 7)
    X, Y, Z = (v.ravel() for v in np.meshgrid(side, side, planes))
    return np.stack([X, Y, Z, SCALE * (X * math.cos(angle) - Z * math.sin(angle)) + MIDDLE[0], SCALE * Y + MIDDLE[1]], 1)


def seen_by(points: DataFrame, angle: float) -> DataFrame:
    """Points (x0, y0) of the plane Z = 0 and their displacements (vx, vy, vz), in millimetres, as that camera's pixels and
    displacements in pixels, kept as they are by key columns."""
    c, s = math.cos(angle), math.sin(angle)
    along = SCALE * (F.col("vx") * c - F.col("vz") * s) / 1000
    keep = [n for n in points.columns if n not in ("x0", "y0", "vx", "vy", "vz")]
    return points.select(*keep, (SCALE * c * F.col("x0") + MIDDLE[0]).alias("x"), (SCALE * F.col("y0") + MIDDLE[1]).alias("y"), along.alias("dx"), (SCALE * F.col("vy") / 1000).alias("dy"))
