"""NumPy kernels for windows and images too large for column functions: correlation, peaks, interpolation, optical flow."""

from __future__ import annotations

import math

import numpy as np

from velofield.operators.grids import nodes


class PIVError(Exception):
    """A vector that can't be found; the message says why."""


def crops(image: np.ndarray, ys: np.ndarray, xs: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Windows around centres (windows x rows x columns)."""
    rows = np.asarray(ys)[:, None] - size[0] // 2 + np.arange(size[0])
    columns = np.asarray(xs)[:, None] - size[1] // 2 + np.arange(size[1])
    return image[rows[:, :, None], columns[:, None, :]]


def correlate_fft(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised circular cross-correlation of many centred windows at once, in the layout of ``functions.correlation``."""
    n0, n1 = a.shape[1:]
    a = a - a.mean(axis=(1, 2), keepdims=True)
    b = b - b.mean(axis=(1, 2), keepdims=True)
    c = np.fft.irfft2(np.conj(np.fft.rfft2(a)) * np.fft.rfft2(b), s=(n0, n1))
    norm = np.sqrt((a * a).sum(axis=(1, 2)) * (b * b).sum(axis=(1, 2)))
    iy, ix = (n0 // 2 - 1 - np.arange(n0)) % n0, (n1 // 2 - 1 - np.arange(n1)) % n1
    out = c[:, iy][:, :, ix]
    return np.divide(out, norm[:, None, None], out=np.zeros_like(out), where=norm[:, None, None] > 0)


def correlate_direct(a: np.ndarray, b: np.ndarray, disp_max: int) -> np.ndarray:
    """Mean product over the overlap for displacements up to ``disp_max``, normalised by the windows' mean squares."""
    a = a - a.mean(axis=(1, 2), keepdims=True)
    b = b - b.mean(axis=(1, 2), keepdims=True)
    n0, n1 = a.shape[1:]
    side = 2 * disp_max + 1
    out = np.zeros((len(a), side, side))
    for iy in range(side):
        for ix in range(side):
            dy, dx = disp_max - iy, disp_max - ix
            p = a[:, max(0, -dy) : n0 - max(0, dy), max(0, -dx) : n1 - max(0, dx)]
            q = b[:, max(0, dy) : n0 + min(0, dy), max(0, dx) : n1 + min(0, dx)]
            out[:, iy, ix] = (p * q).sum(axis=(1, 2)) / (p.shape[1] * p.shape[2])
    norm = np.sqrt((a * a).mean(axis=(1, 2)) * (b * b).mean(axis=(1, 2)))
    return np.divide(out, norm[:, None, None], out=np.zeros_like(out), where=norm[:, None, None] > 0)


def correlate_valid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of larger windows ``a`` with smaller ones ``b`` at all places where b lies inside, normalised there.

    The middle place is no displacement; a place further right or down is a displacement to the left or up.
    """
    m0, m1 = b.shape[1:]
    view = np.lib.stride_tricks.sliding_window_view(a, (m0, m1), axis=(1, 2))
    b = b - b.mean(axis=(1, 2), keepdims=True)
    mean = view.mean(axis=(3, 4))
    out = np.einsum("nyxij,nij->nyx", view, b)
    square = np.einsum("nyxij,nyxij->nyx", view, view) - mean**2 * (m0 * m1)
    norm = np.sqrt(np.maximum(square, 0) * (b * b).sum(axis=(1, 2))[:, None, None])
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


METHODS = {"fft": correlate_fft}


def find_peak(c: np.ndarray, allowed: np.ndarray | None = None) -> tuple[int, int, float]:
    """The highest point of a map, the last of equal ones; missing points are skipped."""
    values = np.where(np.isnan(c) if allowed is None else np.isnan(c) | ~allowed, -np.inf, c)
    at = values.size - 1 - int(np.argmax(values.ravel()[::-1]))
    iy, ix = divmod(at, c.shape[1])
    if not np.isfinite(values[iy, ix]):
        raise PIVError("no correlation")
    return iy, ix, float(c[iy, ix])


def check_peak(c: np.ndarray, iy: int, ix: int) -> None:
    if iy in (0, c.shape[0] - 1) or ix in (0, c.shape[1] - 1):
        raise PIVError("Correlation peak touching boundary.")
    if np.isnan(c[iy - 1 : iy + 2, ix - 1 : ix + 2]).any():
        raise PIVError("Correlation peak touching nan.")


def blank(allowed: np.ndarray, iy: int, ix: int, radius: int) -> np.ndarray:
    """Places away from a peak."""
    out = allowed.copy()
    out[max(0, iy - radius) : iy + radius + 1, max(0, ix - radius) : ix + radius + 1] = False
    return out


def peaks(c: np.ndarray, allowed: np.ndarray, number: int, radius: int) -> tuple[tuple, list[tuple], str | None]:
    """(first peak, further peaks, error): a first peak on the border gets a second chance away from it."""
    first = find_peak(c, allowed)
    error = None
    try:
        check_peak(c, *first[:2])
        best = first
    except PIVError as wrong:
        error, best = str(wrong), first
        try:
            other = find_peak(c, blank(allowed, *first[:2], radius))
            check_peak(c, *other[:2])
            best, error = other, None
        except PIVError:
            pass
    others, left, at = [], allowed, best
    for _ in range(number - 1):
        left = blank(left, *at[:2], radius)
        try:
            at = find_peak(c, left)
            check_peak(c, *at[:2])
        except PIVError:
            break
        others.append(at)
    return best, others, error


def subpixel(c: np.ndarray, iy: int, ix: int, method: str = "2d_gaussian2", n: int = 1) -> tuple[float, float]:
    """(x, y) of a peak with a fraction of a pixel."""
    if iy - n < 0 or ix - n < 0 or iy + n >= c.shape[0] or ix + n >= c.shape[1]:
        raise PIVError("close boundary")
    if method == "no_subpix":
        return float(ix), float(iy)
    near = c[iy - n : iy + n + 1, ix - n : ix + n + 1].astype(float)
    r = np.arange(-n, n + 1.0)
    found = None
    if method == "2d_gaussian2":
        v = c[iy - 1 : iy + 2, ix - 1 : ix + 2].astype(float)
        v = v - v.min()
        if v.max() > 0:
            v /= v.max()
            v[v == 0] = 1e-8
            logs, s = np.log(v), np.arange(-1, 2.0)
            c10, c01 = (logs * s[None]).sum() / 6, (logs * s[:, None]).sum() / 6
            c11 = (logs * s[None] * s[:, None]).sum() / 4
            c20, c02 = (logs * (3 * s[None] ** 2 - 2)).sum() / 6, (logs * (3 * s[:, None] ** 2 - 2)).sum() / 6
            down = 4 * c20 * c02 - c11**2
            if down:
                found = (c11 * c01 - 2 * c10 * c02) / down, (c11 * c10 - 2 * c01 * c20) / down
    elif method == "2d_gaussian":
        x, y = (v.ravel() for v in np.meshgrid(r, r))
        a, b, cx, cy, _ = np.linalg.lstsq(np.stack([x * x, y * y, x, y, np.ones(len(x))], 1), np.log(np.maximum(near, 1e-6)).ravel(), rcond=None)[0]
        if a < 0 and b < 0:
            found = -cx / (2 * a), -cy / (2 * b)
    near_enough = lambda p: p is not None and np.isfinite(p).all() and p[0] ** 2 + p[1] ** 2 <= 2 * (0.5 + n) ** 2
    if not near_enough(found):
        mass = near.sum()
        found = ((near * r[None]).sum() / mass, (near * r[:, None]).sum() / mass) if mass else None
    if not near_enough(found):
        raise PIVError("wrong subpix")
    return float(ix + found[0]), float(iy + found[1])


# --- interpolation ----------------------------------------------------------------------------------------------------


def nearest(points: np.ndarray, values: np.ndarray, wanted: np.ndarray, block: int = 4096) -> np.ndarray:
    """The value of the nearest point for each wanted position."""
    out = np.empty(len(wanted))
    for a in range(0, len(wanted), block):
        d = ((wanted[a : a + block, None] - points[None]) ** 2).sum(axis=2)
        out[a : a + block] = values[d.argmin(axis=1)]
    return out


def triangulate(points: np.ndarray) -> np.ndarray:
    """Delaunay triangles (by point numbers) by inserting point after point."""
    n = len(points)
    low, high = points.min(axis=0), points.max(axis=0)
    middle, reach = (low + high) / 2, float((high - low).max() or 1.0) * 1e3
    p = np.vstack([points, middle + reach * np.array([[-3.0, -1.0], [3.0, -1.0], [0.0, 3.0]])])
    triangles = {(n, n + 1, n + 2): _circle(p, n, n + 1, n + 2)}
    for k in np.lexsort((points[:, 1], points[:, 0])):
        x, y = p[k]
        bad = [t for t, (cx, cy, r2) in triangles.items() if (x - cx) ** 2 + (y - cy) ** 2 < r2 * (1 + 1e-12)]
        edges: dict[tuple[int, int], int] = {}
        for t in bad:
            del triangles[t]
            for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                edges[(min(a, b), max(a, b))] = edges.get((min(a, b), max(a, b)), 0) + 1
        for (a, b), times in edges.items():
            if times == 1 and (circle := _circle(p, a, b, int(k))) is not None:
                triangles[(a, b, int(k))] = circle
    return np.array([t for t in triangles if max(t) < n], int).reshape(-1, 3)


def _circle(p: np.ndarray, a: int, b: int, c: int) -> tuple[float, float, float] | None:
    (ax, ay), (bx, by), (cx, cy) = p[a], p[b], p[c]
    d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    if abs(d) < 1e-12:
        return None
    sa, sb, sc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    x, y = (sa * (by - cy) + sb * (cy - ay) + sc * (ay - by)) / d, (sa * (cx - bx) + sb * (ax - cx) + sc * (bx - ax)) / d
    return x, y, (ax - x) ** 2 + (ay - y) ** 2


def griddata(points: np.ndarray, values: np.ndarray, wanted: np.ndarray, extend: bool = True) -> np.ndarray:
    """Linear interpolation over triangles; outside them, or where points don't make any, the nearest value or, not to be
    extended, NaN."""
    out = np.full(len(wanted), np.nan)
    if len(points) >= 3:
        for a, b, c in triangulate(points):
            edge1, edge2, d = points[b] - points[a], points[c] - points[a], wanted - points[a]
            det = edge1[0] * edge2[1] - edge1[1] * edge2[0]
            if abs(det) < 1e-12:
                continue
            u, v = (d[:, 0] * edge2[1] - d[:, 1] * edge2[0]) / det, (edge1[0] * d[:, 1] - edge1[1] * d[:, 0]) / det
            inside = (u >= -1e-9) & (v >= -1e-9) & (u + v <= 1 + 1e-9) & np.isnan(out)
            out[inside] = values[a] + u[inside] * (values[b] - values[a]) + v[inside] * (values[c] - values[a])
    left = np.isnan(out)
    if extend and left.any():
        out[left] = nearest(points, values, wanted[left])
    return out


def _radial(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    r2 = ((points[:, None] - centers[None]) ** 2).sum(axis=2)
    return np.where(r2 > 0, r2 * np.log(np.where(r2 > 0, r2, 1)) / 2, 0.0)


def tps_weights(centers: np.ndarray, values: np.ndarray, smoothing: float) -> tuple[np.ndarray, np.ndarray]:
    """(smoothed values at the centres, weights) of a thin plate spline; collinear centres raise."""
    n, d = centers.shape
    flat = np.hstack([np.ones((n, 1)), centers])
    if np.linalg.matrix_rank(flat) < d + 1:
        raise np.linalg.LinAlgError("the centres lie on a line")
    system = np.block([[_radial(centers, centers) + smoothing * np.eye(n), flat], [flat.T, np.zeros((d + 1, d + 1))]])
    weights = np.linalg.solve(system, np.concatenate([values, np.zeros(d + 1)]))
    return tps_values(centers, centers, weights), weights


def tps_values(points: np.ndarray, centers: np.ndarray, weights: np.ndarray) -> np.ndarray:
    n = len(centers)
    return _radial(points, centers) @ weights[:n] + weights[n] + points @ weights[n + 1 :]


def tps_gradient(points: np.ndarray, centers: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Derivatives (points x dimensions)."""
    n = len(centers)
    difference = points[:, None] - centers[None]
    r2 = (difference**2).sum(axis=2)
    slope = np.where(r2 > 0, np.log(np.where(r2 > 0, r2, 1)) + 1, 0.0)
    return np.einsum("pnd,pn,n->pd", difference, slope, weights[:n]) + weights[n + 1 :]


def tps_weights_robust(centers: np.ndarray, values: np.ndarray, smoothing: float, threshold: float, rounds: int = 10) -> tuple[np.ndarray, np.ndarray, int]:
    """A spline whose outliers (further than the threshold from it) are replaced by its values, again and again."""
    values = values.copy()
    for n in range(rounds + 1):
        smooth, weights = tps_weights(centers, values, smoothing)
        far = np.abs(smooth - values) > threshold
        if not far.any() or n == rounds:
            break
        values[far] = smooth[far]
    return smooth, weights, n


class Subdomains:
    """Overlapping rectangles of about ``size`` centres, each with a spline; results are blended by weights that fall to the sides."""

    def __init__(self, centers: np.ndarray, size: int, share: float = 0.2):
        self.centers = centers
        low, high = centers.min(axis=0), centers.max(axis=0)
        extent = np.maximum(high - low, 1e-9)
        per_axis = np.sqrt(len(centers) / size * extent / extent[::-1])
        self.counts = np.maximum(1, [math.floor(per_axis[0]), math.ceil(per_axis[1])])
        step = extent / self.counts
        # smoothing by the distance of neighbours: the same whatever the size of rectangles
        self.spacing = math.sqrt(step.prod() * self.counts.prod() / len(centers))
        self.boxes = []
        for a in range(self.counts[0]):
            for b in range(self.counts[1]):
                corner = low + step * np.array([a, b])
                self.boxes.append((corner - share * step, corner + (1 + share) * step))

    @staticmethod
    def inside(points: np.ndarray, box: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return np.flatnonzero(((points >= box[0]) & (points < box[1])).all(axis=1))

    @staticmethod
    def weight(points: np.ndarray, box: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        unit = (points - (box[0] + box[1]) / 2) / ((box[1] - box[0]) / 2)
        return (1 - unit[:, 0] ** 2) * (1 - unit[:, 1] ** 2) + 0.001

    def fit(self, values: np.ndarray, smoothing: float, threshold: float, least: int = 6) -> np.ndarray:
        """Smoothed values at the centres."""
        self.parts = []
        total, norm = np.zeros(len(values)), np.zeros(len(values))
        for box in self.boxes:
            own = self.inside(self.centers, box)
            grow = box
            while len(own) < min(least, len(self.centers)):
                half = (grow[1] - grow[0]) / 2
                grow = (grow[0] - half, grow[1] + half)
                own = self.inside(self.centers, grow)
            smooth, weights, _ = tps_weights_robust(self.centers[own], values[own], smoothing * self.spacing, threshold)
            self.parts.append((box, self.centers[own], weights))
            here = ((self.centers[own] >= box[0]) & (self.centers[own] < box[1])).all(axis=1)
            w = self.weight(self.centers[own[here]], box)
            total[own[here]] += w * smooth[here]
            norm[own[here]] += w
        return np.where(norm > 0, total / np.where(norm > 0, norm, 1), values)

    def summary(self) -> dict[str, int]:
        """How many rectangles there are along both axes and in all, and the least and most centres of one."""
        sizes = [len(self.inside(self.centers, box)) for box in self.boxes]
        return {"n_x": int(self.counts[0]), "n_y": int(self.counts[1]), "n": len(sizes), "least": min(sizes), "most": max(sizes)}

    def at(self, points: np.ndarray) -> np.ndarray:
        """Values at other points; points outside all rectangles take the nearest rectangle's spline."""
        total, norm = np.zeros(len(points)), np.zeros(len(points))
        for box, centers, weights in self.parts:
            own = self.inside(points, box)
            if len(own):
                w = self.weight(points[own], box)
                total[own] += w * tps_values(points[own], centers, weights)
                norm[own] += w
        out = np.divide(total, norm, out=np.zeros(len(points)), where=norm > 0)
        for k in np.flatnonzero(norm == 0):
            box, centers, weights = min(self.parts, key=lambda part: float((np.maximum(np.maximum(part[0][0] - points[k], points[k] - part[0][1]), 0) ** 2).sum()))
            out[k] = tps_values(points[k : k + 1], centers, weights)[0]
        return out


def interpolate(points: np.ndarray, values: list[np.ndarray], wanted: np.ndarray, tps: bool, size: int, smoothing: float, threshold: float) -> list[np.ndarray]:
    """Both components at the wanted positions: splines, or linear where these aren't asked for or can't be solved."""
    if tps:
        try:
            domains = Subdomains(points, size)
            out = []
            for v in values:
                domains.fit(v, smoothing, threshold)
                out.append(domains.at(wanted))
            return out
        except np.linalg.LinAlgError:
            pass
    return [griddata(points, v, wanted) for v in values]


# --- one pair ---------------------------------------------------------------------------------------------------------


def _neighbour_mean(values: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Mean over the good ones of the eight neighbours on a grid."""
    total, count = np.zeros(values.shape), np.zeros(values.shape)
    padded, ok = np.pad(np.where(good, values, 0.0), 1), np.pad(good, 1)
    for a in (0, 1, 2):
        for b in (0, 1, 2):
            if (a, b) != (1, 1):
                part = np.s_[a : a + values.shape[0], b : b + values.shape[1]]
                total += padded[part]
                count += ok[part]
    return np.divide(total, count, out=np.full(values.shape, np.nan), where=count > 0)


def one_pass(im0: np.ndarray, im1: np.ndarray, grid: tuple[np.ndarray, np.ndarray], size: tuple[int, int], moved: tuple[np.ndarray, np.ndarray] | None, params, last: bool) -> list[dict]:
    """Vectors of one pass: correlate all windows at once, then find each one's peaks."""
    ys, xs = grid
    iy, ix = (v.ravel() for v in np.meshgrid(ys, xs, indexing="ij"))
    dx_in, dy_in = moved if moved is not None else (np.zeros(len(ix), int), np.zeros(len(iy), int))
    places = []
    for node, d, length in ((iy, dy_in, im0.shape[0]), (ix, dx_in, im0.shape[1])):
        first = node - np.floor_divide(d, 2)
        second = first + d
        out1, out0 = (second > length) | (second < 0), (first > length) | (first < 0)
        first = np.where(out1, node - d, np.where(out0, node, first))
        places.append((first, first + d))
    (y0, y1), (x0, x1) = places
    size1 = params.shape_crop_im1 if params.shape_crop_im1 is not None else size
    size1 = (size1, size1) if isinstance(size1, int) else tuple(size1)
    size1 = tuple(min(a, b) for a, b in zip(size1, size, strict=True))
    npad = max(size) + int(max(np.abs(dx_in).max(initial=0), np.abs(dy_in).max(initial=0)))
    padded = [np.pad(im - im.min(), npad) for im in (im0, im1)]
    a, b = crops(padded[0], y0 + npad, x0 + npad, size), crops(padded[1], y1 + npad, x1 + npad, size1)
    if size1 != size:
        maps = correlate_valid(a, b)
    elif params.method_correl == "direct":
        maps = correlate_direct(a, b, min(size) // 2 - 1)
    else:
        maps = METHODS[params.method_correl](a, b)
    n0, n1 = maps.shape[1:]
    centre = (n0 // 2 - (size1 == size and params.method_correl != "direct"), n1 // 2 - (size1 == size and params.method_correl != "direct"))
    allowed = np.ones((n0, n1), bool)
    limit = params.displacement_max
    if isinstance(limit, str):
        limit = float(limit.rstrip("% ")) / 100 * max(size)
    if limit is not None:
        allowed = np.hypot(centre[0] - np.arange(n0)[:, None], centre[1] - np.arange(n1)[None]) <= limit
    rows = []
    for k in range(len(ix)):
        row = {"ivec": k, "ixvec": int(ix[k]), "iyvec": int(iy[k]), "x": (x0[k] + x1[k]) / 2, "y": (y0[k] + y1[k]) / 2, "dx": None, "dy": None, "correl_max": None, "dx_input": int(dx_in[k]), "dy_input": int(dy_in[k]), "errors": None, "secondary_peaks": []}
        try:
            best, others, row["errors"] = peaks(maps[k], allowed, params.nb_peaks_to_search, params.particle_radius)
            where = (float(best[1]), float(best[0]))
            if row["errors"] is None and last:
                where = subpixel(maps[k], best[0], best[1], params.method_subpix, params.nsubpix or 1)
            row |= {"dx": float(dx_in[k] + centre[1] - where[0]), "dy": float(dy_in[k] + centre[0] - where[1]), "correl_max": best[2]}
            for p in others:
                sub = subpixel(maps[k], p[0], p[1], params.method_subpix, params.nsubpix or 1)
                row["secondary_peaks"].append({"dx": float(dx_in[k] + centre[1] - sub[0]), "dy": float(dy_in[k] + centre[0] - sub[1]), "correl": p[2]})
        except PIVError as wrong:
            row["errors"] = str(wrong) if row["errors"] is None else row["errors"]
            if row["dx"] is None and len(row["secondary_peaks"]) == 0 and row["errors"] == "wrong subpix":
                row |= {"dx": float(dx_in[k] + centre[1] - best[1]), "dy": float(dy_in[k] + centre[0] - best[0]), "correl_max": best[2]}
        rows.append(row)
    return rows


def fix_vectors(rows: list[dict], shape: tuple[int, int], rules) -> None:
    """Take out false vectors in place (see ``operators.velocimetry.fix``); a good secondary peak may replace one."""
    limit2 = None if rules.displacement_max is None else rules.displacement_max**2
    for r in rows:
        r["dx_wrong"] = r["dy_wrong"] = None
        reasons = [r["errors"]] if r["errors"] else []
        if r["correl_max"] is not None and r["correl_max"] < rules.correl_min:
            reasons.append("correl < correl_min")
        if limit2 is not None and r["dx"] is not None and r["dx"] ** 2 + r["dy"] ** 2 > limit2:
            reasons.append("delta2 < displacement_max2")
        r["errors"] = " + ".join(reasons) or None
    good = np.array([r["errors"] is None and r["dx"] is not None for r in rows]).reshape(shape)
    dx, dy = (np.array([np.nan if r[c] is None else r[c] for r in rows], float).reshape(shape) for c in ("dx", "dy"))
    mean_x, mean_y = (_neighbour_mean(v, good).ravel() for v in (dx, dy))
    distance = np.hypot(dx.ravel() - mean_x, dy.ravel() - mean_y)
    for k, r in enumerate(rows):
        far = rules.threshold_diff_neighbour is not None and good.ravel()[k] and distance[k] > rules.threshold_diff_neighbour
        if far:
            r["errors"] = f"diff neighbour too large (diff = {distance[k]:.2f})"
        if r["errors"] is None:
            continue
        r["dx_wrong"], r["dy_wrong"] = r["dx"], r["dy"]
        r["dx"] = r["dy"] = None
        choices = [p for p in r["secondary_peaks"] if r["correl_max"] and p["correl"] / r["correl_max"] > 0.6 and p["correl"] > rules.correl_min]
        choices = [p for p in choices if limit2 is None or p["dx"] ** 2 + p["dy"] ** 2 <= limit2]
        if choices and np.isfinite(mean_x[k]):
            best = min(choices, key=lambda p: (p["dx"] - mean_x[k]) ** 2 + (p["dy"] - mean_y[k]) ** 2)
            if rules.threshold_diff_neighbour is None or np.hypot(best["dx"] - mean_x[k], best["dy"] - mean_y[k]) <= rules.threshold_diff_neighbour:
                r |= {"dx": best["dx"], "dy": best["dy"], "correl_max": best["correl"], "errors": None}


def velocimetry(im0: np.ndarray, im1: np.ndarray, params) -> list[dict]:
    """All passes over one pair: rows of vectors, with ``dx_final`` and ``dy_final`` interpolated on each pass's grid."""
    from velofield.operators.grids import crop_sizes
    from velofield.operators.velocimetry_codes import code_of

    sizes = crop_sizes(params.piv0.shape_crop_im0, params.multipass.coeff_zoom, params.multipass.number)
    found, known = [], None
    for n, size in enumerate(sizes):
        last = n + 1 == len(sizes)
        grid = tuple(np.array(nodes(length, s, params.piv0.grid.overlap)) for length, s in zip(im0.shape, size, strict=True))
        if not len(grid[0]) or not len(grid[1]):
            raise PIVError("the image is smaller than a window")
        moved = None
        if known is not None and len(known[0]):
            iy, ix = (v.ravel() for v in np.meshgrid(*grid, indexing="ij"))
            guess = _guess(known, np.stack([ix, iy], 1).astype(float), params.multipass, params.multipass.use_tps is True)
            moved = tuple(np.rint(v).astype(int) for v in guess)
        rows = one_pass(im0, im1, grid, size, moved, params.piv0, last)
        fix_vectors(rows, (len(grid[0]), len(grid[1])), params.fix)
        good = [r for r in rows if r["dx"] is not None]
        known = (np.array([[r["x"], r["y"]] for r in good]).reshape(-1, 2), [np.array([r[c] for r in good]) for c in ("dx", "dy")])
        if len(good):
            wanted = np.array([[r["ixvec"], r["iyvec"]] for r in rows], float)
            final = _guess(known, wanted, params.multipass, params.multipass.use_tps is True or (last and params.multipass.use_tps == "last"))
        for k, r in enumerate(rows):
            r |= {"pass": n, "error_code": code_of(r["errors"]), "dx_final": float(final[0][k]) if len(good) else None, "dy_final": float(final[1][k]) if len(good) else None}
        found += rows
    return found


def _guess(known: tuple, wanted: np.ndarray, multipass, tps: bool) -> list[np.ndarray]:
    return interpolate(known[0], known[1], wanted, tps and len(known[0]) >= 6, multipass.subdom_size, multipass.smoothing_coef, multipass.threshold_tps)


# --- optical flow -----------------------------------------------------------------------------------------------------


def _gradients(im: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    padded = np.pad(im, 1, mode="edge")
    gx = (padded[:, 2:] - padded[:, :-2])[1:-1] / 2
    gy = (padded[2:] - padded[:-2])[:, 1:-1] / 2
    return gx, gy


def _box(im: np.ndarray, size: int) -> np.ndarray:
    """Sums over windows of ``size`` around each pixel."""
    sums = np.pad(np.cumsum(np.cumsum(np.pad(im, ((size // 2, size - 1 - size // 2),) * 2), axis=0), axis=1), ((1, 0), (1, 0)))
    return sums[size:, size:] - sums[:-size, size:] - sums[size:, :-size] + sums[:-size, :-size]


def corners(im: np.ndarray, most: int, quality: float, distance: float, block: int) -> np.ndarray:
    """Strongest places (x, y) by the least eigenvalue of the gradients' covariance, at least ``distance`` apart."""
    gx, gy = _gradients(im.astype(float))
    a, b, c = _box(gx * gx, block), _box(gx * gy, block), _box(gy * gy, block)
    score = (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b**2)
    padded = np.pad(score, 1, constant_values=-np.inf)
    top = np.max([padded[i : i + score.shape[0], j : j + score.shape[1]] for i in range(3) for j in range(3)], axis=0)
    ys, xs = np.nonzero((score == top) & (score > quality * score.max()) & (score > 0))
    order = np.argsort(-score[ys, xs], kind="stable")
    taken: dict[tuple[int, int], list[tuple[int, int]]] = {}
    chosen, cell = [], max(distance, 1.0)
    for k in order:
        y, x = int(ys[k]), int(xs[k])
        cy, cx = int(y // cell), int(x // cell)
        near = (p for i in (-1, 0, 1) for j in (-1, 0, 1) for p in taken.get((cy + i, cx + j), ()))
        if all((y - q) ** 2 + (x - p) ** 2 >= distance**2 for q, p in near):
            chosen.append((x, y))
            taken.setdefault((cy, cx), []).append((y, x))
            if len(chosen) == most:
                break
    return np.array(chosen, float).reshape(-1, 2)


def _sampled(im: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values, the border's outside."""
    y, x = np.clip(y, 0, im.shape[0] - 1), np.clip(x, 0, im.shape[1] - 1)
    y0, x0 = np.minimum(y.astype(int), max(im.shape[0] - 2, 0)), np.minimum(x.astype(int), max(im.shape[1] - 2, 0))
    fy, fx = y - y0, x - x0
    y1, x1 = np.minimum(y0 + 1, im.shape[0] - 1), np.minimum(x0 + 1, im.shape[1] - 1)
    return (1 - fy) * ((1 - fx) * im[y0, x0] + fx * im[y0, x1]) + fy * ((1 - fx) * im[y1, x0] + fx * im[y1, x1])


def _halved(im: np.ndarray) -> np.ndarray:
    w = np.array([1, 4, 6, 4, 1]) / 16
    padded = np.pad(im, 2, mode="reflect" if min(im.shape) > 2 else "edge")
    rows = sum(w[k] * padded[k : k + im.shape[0]] for k in range(5))
    return sum(w[k] * rows[:, k : k + im.shape[1]] for k in range(5))[::2, ::2]


def track(im0: np.ndarray, im1: np.ndarray, points: np.ndarray, window: int, levels: int, count: int, epsilon: float) -> np.ndarray:
    """Where points of the first image are in the second: Lucas and Kanade's steps on a pyramid, all points at once."""
    pyramid = [(im0.astype(float), im1.astype(float))]
    while len(pyramid) <= levels and min(pyramid[-1][0].shape) >= 2 * window:
        pyramid.append(tuple(_halved(im) for im in pyramid[-1]))
    r = np.arange(window) - (window - 1) / 2
    wy, wx = np.meshgrid(r, r, indexing="ij")
    move = np.zeros_like(points)
    for level in range(len(pyramid) - 1, -1, -1):
        a, b = pyramid[level]
        gx, gy = _gradients(a)
        at = points / 2**level
        y, x = at[:, 1, None, None] + wy, at[:, 0, None, None] + wx
        patch, px, py = (_sampled(im, y, x) for im in (a, gx, gy))
        xx, xy, yy = ((p * q).sum(axis=(1, 2)) for p, q in ((px, px), (px, py), (py, py)))
        det = xx * yy - xy * xy
        move = move * 2 if level < len(pyramid) - 1 else move
        live = det > 1e-12
        for _ in range(count):
            error = patch - _sampled(b, y + move[:, 1, None, None], x + move[:, 0, None, None])
            bx, by = (error * px).sum(axis=(1, 2)), (error * py).sum(axis=(1, 2))
            step = np.where(live, np.array([yy * bx - xy * by, xx * by - xy * bx]) / np.where(det > 1e-12, det, 1), 0).T
            move = move + step
            live &= np.hypot(*step.T) > epsilon
            if not live.any():
                break
    return points + move


def optical_flow(im0: np.ndarray, im1: np.ndarray, params) -> list[dict]:
    """Displacements of corners that go there and back: the round trip must end near its start, the length lie between the limits."""
    f = params.features
    start = corners(im0, f.max_corners, f.quality_level, f.min_distance, f.block_size)
    if not len(start):
        return []
    args = (params.win_size, params.max_level, params.max_count, params.epsilon)
    there = track(im0, im1, start, *args)
    back = track(im1, im0, there, *args)
    size = np.hypot(*(there - start).T)
    good = (np.abs(back - start).max(axis=1) < params.threshold_diff_ab_ba) & (size > params.displacement_min) & (size < params.displacement_max)
    return [{"ivec": k, "x": float(p[0]), "y": float(p[1]), "dx": float(q[0] - p[0]), "dy": float(q[1] - p[1])} for k, (p, q) in enumerate(zip(start[good], there[good], strict=True))]
