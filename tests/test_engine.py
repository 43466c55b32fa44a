"""Operators against analytic results."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from velofield.operators import calibration as C
from velofield.operators import fields, filters, grids, pairing, surface, tomography, velocimetry
from velofield.plans import pipelines
from velofield.sources.frames import frames_from_vectors


@pytest.fixture(scope="module")
def frames(spark):
    r = np.random.default_rng(0)
    return frames_from_vectors(spark.createDataFrame([(k, [float(v) for v in r.random(64)]) for k in range(5)], "vec_id long, embedding array<double>"))


def test_grid_nodes():
    assert grids.nodes(100, 32) == [16, 32, 48, 64, 80, 84][:5] + ([84] if 84 - 80 > 16 // 2.5 else [])
    assert grids.nodes(100, 48) == [24, 48, 72]
    with pytest.raises(ValueError):
        grids.nodes(100, 4, 1.0)


def test_split():
    assert [len(range(*r)) for r in pairing.split_ranges(9, 1, 55, 2)] == [3] * 9
    assert sum(len(range(*r)) for r in pairing.split_ranges(3, 0, 10)) == 10
    assert pairing.split_list(list(range(3)), 4) == [[0], [1], [2]] and pairing.split_list([], 2) == [[], []]


def test_curl_and_divergence_of_a_linear_field(spark):
    t = spark.range(48).select(F.lit(0).cast("long").alias("field_id"), F.floor(F.col("id") / 8).cast("int").alias("iy"), (F.col("id") % 8).cast("int").alias("ix"))
    t = t.withColumn("x", F.col("ix") * 0.5).withColumn("y", F.col("iy") * 2.0).withColumn("vx", F.col("x")).withColumn("vy", F.col("y"))
    assert {round(r["rotz"], 9) for r in fields.curl(t, 0.5, 2.0).collect()} == {0.0}
    assert {round(r["divh"], 9) for r in fields.divergence(t, 0.5, 2.0).collect()} == {2.0}


def test_spectra_keep_the_energy(spark):
    r = np.random.default_rng(0)
    v = [float(x) for x in r.standard_normal(48)]
    t = spark.createDataFrame([(v,)], "v array<double>")
    one = fields.spectrum_1d(t, "v", 0.25).agg(F.sum("psd")).first()[0] * 2 * math.pi / (48 * 0.25)
    assert one == pytest.approx(np.mean(np.square(v)) / 2)
    two = fields.spectrum_2d(t, "v", 6, 8, 0.5, 2.0).agg(F.sum("psd")).first()[0] * (2 * math.pi / 4) * (2 * math.pi / 12)
    assert two == pytest.approx(np.mean(np.square(v)) / 2)


def test_field_algebra(spark):
    rows = [(0, 0, k, float(k), 0.0, k + 1.0, 2.0 * k) for k in range(4)]
    t = spark.createDataFrame(rows, "field_id long, iy int, ix int, x double, y double, vx double, vy double")
    assert [r["vy"] for r in fields.divide(t, t).orderBy("ix").collect()] == [None, 1.0, 1.0, 1.0]
    assert [r["vx"] for r in fields.add(fields.multiply(t, 2), t).orderBy("ix").collect()] == [3.0, 6.0, 9.0, 12.0]
    assert fields.append(t, t.withColumn("field_id", F.lit(1).cast("long"))).count() == 8


def test_tsai_there_and_back(spark):
    r = C.rodrigues((0.1, -0.05, 0.02))
    for angles in (None, ((0.0, 8.0, 0.0),)):
        tsai = C.Tsai((900.0, 900.0), (320.0, 240.0), 0.0, (1.0, -2.0, 80.0), tuple(float(v) for v in r.ravel()), ((0.0, 0.0, 2.0),), angles)
        t = spark.createDataFrame([(100.0, 50.0), (320.0, 240.0), (600.0, 400.0)], "ix double, iy double")
        there = tsai.to_phys(t, 0, 480)
        back = tsai.to_pixels(there, "x_phys", "y_phys", "z_phys").collect()
        for row in back:
            assert row["px"] == pytest.approx(row["ix"], abs=1e-6) and 480 - row["py"] == pytest.approx(row["iy"], abs=1e-6)


def test_stereo_recovers_a_displacement(spark):
    base0, inverse0 = C.plane_base(0.3, 0.1, 0.9)
    base1, inverse1 = C.plane_base(-0.35, 0.05, 0.95)
    t = spark.createDataFrame([(0.1, -0.2, 0.3)], "dX double, dY double, dZ double")
    for n, inverse in enumerate((inverse0, inverse1)):
        t = C.to_camera(t, inverse, ("dX", "dY", "dZ"), (f"d{n}x", f"d{n}y"))
    row = C.stereo_reconstruct(t.drop("dX", "dY", "dZ"), base0, base1).first()
    assert (row["dX"], row["dY"], row["dZ"]) == pytest.approx((0.1, -0.2, 0.3))
    assert row["error_X"] == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError):
        C.stereo_solutions(base0, base0)


def test_lines_through_points_meet_planes(spark):
    points = [(0.0, 0.0, 1.0 + 2 * z, 2.0 - z, float(z)) for z in (-1, 0, 1, 2)]
    lines = C.fit_lines(spark.createDataFrame(points, "ix double, iy double, X double, Y double, Z double"))
    row = C.meet_plane(lines, C.plane_equation(0.5, 0.0, 0.0)).first()
    assert (row["X"], row["Y"], row["Z"]) == pytest.approx((2.0, 1.5, 0.5))


def test_reconstruction_is_the_geometric_mean(spark):
    voxels = tomography.reset(tomography.voxel_grid(spark, (0, 1, 2), (0, 1, 2), (0, 1, 2)))
    a = voxels.select("ivox", F.lit(4.0).alias("v"))
    b = voxels.select("ivox", F.when(F.col("ivox") == 0, 0.0).otherwise(9.0).alias("v"))
    assert [round(r["intensity"], 9) for r in tomography.mlos(voxels, [a, b]).orderBy("ivox").collect()] == [0.0] + [6.0] * 7


def test_blobs_and_camera():
    image = np.zeros((30, 30))
    image[4:8, 5:9] = image[20:23, 12:16] = 1
    assert tomography.blobs(image, 0.5).tolist() == [[6.5, 5.5], [13.5, 21.0]]
    r = np.random.default_rng(0)
    matrix = np.array([[500, 0, 320, 10], [0, 500, 240, 20], [0, 0, 1, 1.0]])
    points = r.uniform(1, 3, (20, 3))
    h = np.hstack([points, np.ones((20, 1))]) @ matrix.T
    assert tomography.calibrate_camera(points, h[:, :2] / h[:, 2:]) == pytest.approx(matrix, rel=1e-5, abs=1e-6)


def test_phases(spark):
    t = spark.createDataFrame([(k, 1.3 * k) for k in range(30)], "t long, real double")
    wrapped = t.withColumn("phase", F.atan2(F.sin("real"), F.cos("real")))
    for row in surface.continuous(wrapped).collect():
        assert row["corrected"] == pytest.approx(row["real"])
    line = spark.createDataFrame([([math.atan2(math.sin(v), math.cos(v)) for v in np.arange(0, 20, 0.7)],)], "v array<double>")
    assert line.select(surface.unwrapped(F.col("v"))).first()[0] == pytest.approx(np.arange(0, 20, 0.7))


def test_surface_frames(spark, frames):
    y, x = np.mgrid[0:16, 0:32]
    rows = [(k, [float(v) for v in (2 + np.cos(2 * np.pi * 4 * x / 32 + 0.3 * k)).ravel()]) for k in range(3)]
    made = frames_from_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 16, 32)
    phases = {r["i"]: r["pixels"] for r in surface.process_frames(made, 4.0).collect()}
    assert np.median(np.array(phases[2]) - np.array(phases[0])) == pytest.approx(0.6, abs=0.05)


def test_filters_of_a_constant_frame(spark):
    flat = frames_from_vectors(spark.createDataFrame([(0, [3.0] * 64)], "vec_id long, embedding array<double>"))
    for name in ("sliding_median", "sliding_minima", "sliding_percentile"):
        assert set(filters.TOOLS[name](flat, window_size=5).first()["pixels"]) == {0.0}
    assert filters.gaussian_filter(flat, 1.0).first()["pixels"] == pytest.approx([3.0] * 64)
    assert set(filters.rescale_intensity(flat).first()["pixels"]) == {0.0}
    assert set(filters.equalize_global(flat, 8).first()["pixels"]) == {1.0}
    assert set(filters.equalize_adaptive(flat).first()["pixels"]) == {3.0}


def test_tools_chain(frames):
    made = filters.preprocess(frames, [("sliding_median", {"window_size": 3}), ("rescale_intensity", {"maxima": 10.0}), ("sharpen", {"sigma1": 1.0, "alpha": 1.0})])
    assert made.count() == 5 and len(made.first()["pixels"]) == 64
    with pytest.raises(AttributeError):
        filters.preprocess(frames, [("nothing", {})])
    with pytest.raises(ValueError):
        filters.window_shape(1, 5)
    assert filters.default_params("gamma_correction") == {"gamma": 1.0, "gain": 1.0, "scale": 1.0}


def test_user_functions(frames):
    made = pipelines.image_to_image(frames, lambda image: image[:, ::-1])
    a, b = frames.orderBy("i").first()["pixels"], made.orderBy("i").first()["pixels"]
    assert (np.array(a).reshape(8, 8)[:, ::-1].ravel() == b).all()
    failed = pipelines.image_to_image(frames, lambda image: 1 / 0)
    assert {r["error"].split(":")[0] for r in failed.collect()} == {"ZeroDivisionError"}


def test_kernel_and_columns_agree(frames):
    """The column functions and the NumPy kernel give the same correlation."""
    from velofield.functions import correlation, kernels

    row = pairing.make_couples(frames).select("px0", "px1", correlation.circular(correlation.centred(F.col("px0")), correlation.centred(F.col("px1")), 8, 8).alias("c")).first()
    a, b = (np.array(row[k]).reshape(1, 8, 8) for k in ("px0", "px1"))
    assert np.array(row["c"]).reshape(8, 8) == pytest.approx(kernels.correlate_fft(a, b)[0], abs=1e-6)


def test_fix_takes_out_and_explains(spark):
    rows = [(0, k, k // 3, k % 3, 9.0 if k == 4 else 1.0, 1.0, 0.1 if k == 8 else 0.9, None) for k in range(9)]
    t = spark.createDataFrame(rows, "key long, ivec int, iy int, ix int, dx double, dy double, correl_max double, errors string")
    out = {r["ivec"]: r for r in velocimetry.fix(t, 0.2, 3.0).collect()}
    assert out[4]["dx"] is None and out[4]["error_code"] == 4 and out[4]["dx_wrong"] == 9.0 and "8.00" in out[4]["errors"]
    assert out[8]["error_code"] == 2 and out[0]["errors"] is None


def test_pipeline_graph():
    p = pipelines.Pipeline("piv").add("read", lambda t: t).add("couples", lambda t: t)
    assert '"read" -> "couples"' in p.describe()


def test_exact_median(spark):
    from velofield.operators.statistics import exact_median

    r = np.random.default_rng(0)
    for v in (r.standard_normal(2001), np.round(r.standard_normal(1000), 1), np.full(7, 3.0), np.array([1e300, -1e300, 5.0, 5.0]), np.array([5e-324, 0.0])):
        assert exact_median(spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double"), "v", 16) == np.median(v)
    assert exact_median(spark.createDataFrame([], "v double"), "v") is None


def test_direct_calibration_is_kept():
    from velofield.operators import stereo

    cam = stereo.DirectCalibration.fit(stereo.target_points(0.4), (160, 200), 6, 5)
    again = stereo.DirectCalibration.from_json(cam.to_json())
    x, y = np.array([20.0, 101.5, 300.0]), np.array([33.0, 80.0, 80.0])
    place = again.on_plane(x, y, (0.0, 0.0, 1.0, -0.02))
    assert np.allclose(place[:2, 0], ((x[:2] - stereo.MIDDLE[0]) / stereo.SCALE + 0.02 * np.sin(0.4)) / np.cos(0.4)) and np.allclose(place[:2, 2], 0.02)
    assert np.isnan(place[2]).all()


def test_process_arrays_and_parts_of_a_series(spark):
    from velofield import params as P
    from velofield.plans import pipelines
    from velofield.sources import frames as S

    pairs = S.synthetic_pairs(spark, 1, (2.0, 1.0), (48, 48))
    row = pairs.first()
    a, b = (np.array(row[c]).reshape(48, 48) for c in ("px0", "px1"))
    params = P.Piv(piv0=P.FirstPass(shape_crop_im0=16))
    found, want = (t.orderBy("ivec").collect() for t in (pipelines.process_arrays(spark, a, b, params), pipelines.piv(pairs, params)))
    assert found == want and len(found) == 25 and found[0]["key"] == 0
    with pytest.raises(ValueError, match="shape"):
        pipelines.process_arrays(spark, a, b[:-1])


def test_splines_smooth_alike_in_small_and_large_rectangles():
    from velofield.functions.kernels import Subdomains

    r = np.random.default_rng(2)
    points = r.random((400, 2)) * [8, 5]
    values = np.sin(points[:, 0]) * points[:, 1] + 0.05 * r.standard_normal(400)
    small, large = Subdomains(points, 50), Subdomains(points, 400)
    a, b = (d.fit(values, 0.5, 10.0) for d in (small, large))
    assert small.summary()["n"] > large.summary()["n"] == 1 and small.summary()["least"] > 10
    assert abs(small.spacing - large.spacing) < 1e-9 and np.abs(a - b).max() < 0.1
