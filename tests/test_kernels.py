"""NumPy kernels against analytic results and plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from velofield.functions import kernels as K
from velofield.params import Features, FirstPass, Flow, Multipass, Piv
from velofield.sources.frames import particle_pair


@pytest.mark.parametrize("shape", [(32, 32), (64, 32), (33, 48)])
def test_correlation_of_equal_images_is_one_at_zero(shape):
    a, _ = particle_pair((0, 0), shape[0] * shape[1] // 16, shape, seed=3)
    c = K.correlate_fft(a[None], a[None])[0]
    iy, ix, value = K.find_peak(c)
    assert (iy, ix) == (shape[0] // 2 - 1, shape[1] // 2 - 1)
    assert value == pytest.approx(1.0, abs=1e-9)


@pytest.mark.parametrize("shape", [(32, 32), (64, 32)])
def test_displacement_is_found(shape):
    a, b = particle_pair((3.3, 5.8), shape[0] * shape[1] // 16, shape, seed=1)
    c = K.correlate_fft(a[None], b[None])[0]
    best, _, error = K.peaks(c, np.ones(c.shape, bool), 1, 3)
    x, y = K.subpixel(c, *best[:2])
    assert error is None
    assert abs(shape[1] // 2 - 1 - x - 3.3) < 0.8 and abs(shape[0] // 2 - 1 - y - 5.8) < 0.8


def test_smaller_second_window():
    a, b = particle_pair((3.3, 2.8), 96 * 48 // 16, (96, 48), (64, 32), seed=5)
    c = K.correlate_valid(a[None], b[None])[0]
    iy, ix, _ = K.find_peak(c)
    assert abs(c.shape[1] // 2 - ix - 3.3) < 1.5 and abs(c.shape[0] // 2 - iy - 2.8) < 1.5


def test_direct_correlation_matches_a_loop():
    r = np.random.default_rng(0)
    a, b = r.random((1, 6, 7)), r.random((1, 6, 7))
    got = K.correlate_direct(a, b, 2)[0]
    x, y = a[0] - a.mean(), b[0] - b.mean()
    norm = np.sqrt((x * x).mean() * (y * y).mean())
    for iy in range(5):
        for ix in range(5):
            dy, dx = 2 - iy, 2 - ix
            cells = [(x[p, q] * y[p + dy, q + dx]) for p in range(6) for q in range(7) if 0 <= p + dy < 6 and 0 <= q + dx < 7]
            assert got[iy, ix] == pytest.approx(np.mean(cells) / norm)


def test_last_of_equal_peaks_wins_and_missing_values_are_skipped():
    c = np.zeros((5, 5))
    c[1, 1] = c[3, 2] = 1.0
    c[4, 4] = np.nan
    assert K.find_peak(c)[:2] == (3, 2)


def test_border_peak_gets_a_second_chance():
    c = np.zeros((11, 11))
    c[0, 0], c[6, 6] = 1.0, 0.9
    best, _, error = K.peaks(c, np.ones(c.shape, bool), 1, 2)
    assert best[:2] == (6, 6) and error is None
    c[6, 6] = 0
    c[0, 10] = 0.8
    best, _, error = K.peaks(c, np.ones(c.shape, bool), 1, 2)
    assert best[:2] == (0, 0) and error.startswith("Correlation peak touching")


@pytest.mark.parametrize("method", ["2d_gaussian", "2d_gaussian2", "centroid", "no_subpix"])
def test_subpixel_of_a_symmetric_peak_is_its_place(method):
    y, x = np.mgrid[-4:5, -4:5]
    assert K.subpixel(np.exp(-(x**2 + y**2) / 3.0), 4, 4, method) == pytest.approx((4, 4), abs=1e-6)


@given(dx=st.floats(-0.4, 0.4), dy=st.floats(-0.4, 0.4))
@settings(max_examples=25, deadline=None)
def test_gaussian_fit_is_exact_on_a_gaussian(dx, dy):
    y, x = np.mgrid[-4:5, -4:5]
    got = K.subpixel(np.exp(-((x - dx) ** 2 + (y - dy) ** 2) / 4.0), 4, 4, "2d_gaussian")
    assert got == pytest.approx((4 + dx, 4 + dy), abs=1e-6)


@pytest.mark.parametrize(("passes", "tps"), [(1, "last"), (2, "last"), (2, True), (2, False)])
def test_multipass_finds_a_uniform_displacement(passes, tps):
    a, b = particle_pair((3.3, 2.8), 96 * 96 // 16, (96, 96), seed=0)
    rows = K.velocimetry(a, b, Piv(piv0=FirstPass(shape_crop_im0=32, nb_peaks_to_search=2), multipass=Multipass(number=passes, use_tps=tps)))
    last = [r for r in rows if r["pass"] == passes - 1]
    assert np.nanmedian([r["dx_final"] for r in last]) == pytest.approx(3.3, abs=0.15)
    assert np.nanmedian([r["dy_final"] for r in last]) == pytest.approx(2.8, abs=0.15)


def test_optical_flow():
    a, b = particle_pair((2.3, 1.8), 96 * 96 // 16, (96, 96), seed=0)
    rows = K.optical_flow(a, b, Flow(win_size=16, features=Features(max_corners=500, block_size=7)))
    assert len(rows) > 20
    assert np.median([r["dx"] for r in rows]) == pytest.approx(2.3, abs=0.2)
    assert np.median([r["dy"] for r in rows]) == pytest.approx(1.8, abs=0.2)


def test_interpolation_of_a_plane_is_exact():
    r = np.random.default_rng(0)
    p, w = r.uniform(0, 10, (40, 2)), r.uniform(2, 8, (10, 2))
    f = lambda q: q[:, 0] * 2 + q[:, 1]
    assert K.griddata(p, f(p), w) == pytest.approx(f(w))
    _, weights = K.tps_weights(p, f(p), 0.0)
    assert K.tps_values(w, p, weights) == pytest.approx(f(w))
    assert K.tps_gradient(w, p, weights) == pytest.approx(np.tile([2.0, 1.0], (10, 1)))
    domains = K.Subdomains(p, 15)
    domains.fit(f(p), 0.01, 10.0)
    assert domains.at(w) == pytest.approx(f(w), abs=1e-3)


def test_collinear_centres_fall_back():
    p = np.stack([np.arange(8.0), np.zeros(8)], 1)
    with pytest.raises(np.linalg.LinAlgError):
        K.tps_weights(p, p[:, 0], 1.0)
    assert K.interpolate(p, [p[:, 0]], np.array([[2.2, 0.0]]), True, 10, 1.0, 1.0)[0] == pytest.approx([2.0])


def test_spline_iteration_replaces_outliers():
    p = np.random.default_rng(1).uniform(0, 10, (50, 2))
    v = p[:, 0].copy()
    v[7] += 50
    smooth, _, _ = K.tps_weights_robust(p, v, 0.5, 1.5)
    assert abs(smooth[7] - p[7, 0]) < 25
