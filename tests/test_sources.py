"""Images, series, XML, logs, sinks and parameters."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from velofield import params as P
from velofield.operators import pairing
from velofield.plans import cli, pipelines
from velofield.sources import frames as S
from velofield.sources import logs, sinks, xml


@pytest.mark.parametrize("most", [255, 60_000])
def test_images_round_trip(most):
    image = np.random.default_rng(0).integers(0, most, (7, 5))
    image[0, 0] = most
    for encode in (S.encode_pgm, S.encode_png):
        assert (S.decode(encode(image)) == image).all()


def test_bmp_and_text_pgm():
    rows = np.arange(12, dtype=np.uint8).reshape(3, 4)
    palette = b"".join(bytes([k, k, k, 0]) for k in range(256))
    head = b"BM" + struct.pack("<IHHI", 54 + 1024 + 12, 0, 0, 54 + 1024) + struct.pack("<IiiHHIIiiII", 40, 4, 3, 1, 8, 0, 12, 0, 0, 256, 0)
    assert (S.decode(head + palette + rows[::-1].tobytes()) == rows).all()
    assert (S.decode(b"P2\n# note\n2 2\n255\n1 2\n3 4\n") == [[1, 2], [3, 4]]).all()
    with pytest.raises(ValueError):
        S.decode(b"nothing")


@pytest.fixture
def folder(tmp_path):
    for k in range(1, 5):
        (tmp_path / f"im_{k:02d}.png").write_bytes(S.encode_png(np.full((4, 8), k)))
    (tmp_path / "im_05.png").write_bytes(b"broken")
    return tmp_path


def test_read_images_keeps_failures_as_values(spark, folder):
    rows = {r["i"]: r for r in S.read_images(spark, f"{folder}/*.png").collect()}
    assert len(rows) == 5 and rows[5]["pixels"] is None and "im_05.png" in rows[5]["error"]
    assert rows[3]["pixels"] == [3.0] * 32 and (rows[3]["height"], rows[3]["width"]) == (4, 8)
    assert rows[2]["series_id"] == "im_"


def test_mean_of_constant_images(spark, tmp_path):
    for k in range(19):
        (tmp_path / f"im{k:03d}.png").write_bytes(S.encode_png(np.full((4, 8), k)))
    for n in (1, 2, 7):
        frames = S.read_images(spark, f"{tmp_path}/*.png").repartition(n)
        assert pipelines.mean_image(frames, 4, 8).first()["pixels"] == [9.0] * 32


def _series(spark, names):
    return S.with_indices(spark.createDataFrame([(f"/d/{n}",) for n in names], "path string"))


@pytest.mark.parametrize(
    ("names", "subset", "step", "keys"),
    [
        (["wake_01.bmp", "wake_02.bmp", "wake_03.bmp", "wake_04.bmp"], "pairs", 1, [1, 2, 3]),
        (["c060a.png", "c060b.png", "c061a.png", "c061b.png"], "pairs", 1, [60, 61]),
        (["c060a.png", "c060b.png", "c061a.png", "c061b.png"], "i:i+2,1", 1, [60]),
        (["a1.png", "a2.png", "a3.png"], "all1by1", 1, [1, 2, 3]),
        (["a1.png", "a2.png", "a3.png", "a4.png", "a5.png"], "i:i+3:2", 2, [1, 3]),
        (["a1.png", "a2.png", "a4.png", "a5.png"], "i+1:i+2", 1, [1, 4]),
    ],
)
def test_subsets(spark, names, subset, step, keys):
    groups = S.subsets(_series(spark, names), subset, step=step)
    assert sorted({r["key"] for r in groups.collect()}) == keys


def test_groups_are_joined_to_their_frames(spark, folder):
    frames = S.read_images(spark, f"{folder}/*.png")
    rows = pairing.make_groups(S.subsets(frames, "pairs"), frames).orderBy("key").collect()
    assert [r["names"] for r in rows] == [[f"im_{k:02d}.png", f"im_{k + 1:02d}.png"] for k in range(1, 5)]
    assert rows[0]["stack"][1] == [2.0] * 32 and rows[3]["error"] is not None


def test_only_missing_results_are_computed(spark, tmp_path):
    params = P.Piv(piv0=P.FirstPass(shape_crop_im0=16))
    pairs = S.synthetic_pairs(spark, 3, (2.0, 1.0), (40, 40))
    path = str(tmp_path / "piv")
    sinks.write_vectors(pipelines.piv(pairs, params), path)
    done = spark.read.parquet(path).where("key <> 1").select("key").distinct()
    rest = S.missing(pairs, done, "key")
    assert [r["key"] for r in rest.select("key").collect()] == [1]
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_vectors(pipelines.piv(rest, params), path)
    sinks.write_vectors(pipelines.piv(rest, params), path, "complete")
    assert sinks.read_pass(spark.read.parquet(path)).count() == pipelines.piv(pairs, params).count() + pipelines.piv(rest, params).count()


def test_partitions_do_not_change_results(spark):
    params = P.Piv(piv0=P.FirstPass(shape_crop_im0=16))
    pairs = S.synthetic_pairs(spark, 3, (2.0, 1.0), (40, 40))
    got = [sorted((r["key"], r["ivec"], r["dx"]) for r in pipelines.piv(pairs.repartition(n), params).collect()) for n in (1, 2, 7)]
    assert got[0] == got[1] == got[2]


def test_failures_go_on_as_values(spark):
    pairs = S.synthetic_pairs(spark, 2, (2.0, 1.0), (40, 40)).withColumn("height", F.when(F.col("key") == 1, 7).otherwise(F.col("height")))
    rows = pipelines.piv(pairs, P.Piv(piv0=P.FirstPass(shape_crop_im0=16))).collect()
    assert len([r for r in rows if r["key"] == 1]) == 1 and all(r["errors"] for r in rows if r["key"] == 1)
    assert any(r["dx"] is not None for r in rows if r["key"] == 0)
    with pytest.raises(Exception, match="reshape"):
        pipelines.piv(pairs, P.Piv(piv0=P.FirstPass(shape_crop_im0=16)), stop_if_error=True).collect()  # the other pair is right


def test_pair_names(spark):
    t = spark.createDataFrame([(1, None, 2, None), (60, "a", 60, "b")], "i long, a string, j long, b string")
    got = [r[0] for r in t.select(sinks.pair_name(F.col("i"), F.col("a"), F.col("j"), F.col("b"))).collect()]
    assert got == ["piv_01-02", "piv_60ab"]


def test_points_and_cameras_from_xml(spark, tmp_path):
    (tmp_path / "img_0.xml").write_text("<G><GeometryCalib><SourceCalib><PointCoord_1>100 200 50 12.5 7</PointCoord_1><PointCoord_2>1\t2\t3\t4\t5</PointCoord_2></SourceCalib></GeometryCalib></G>")
    rows = xml.read_points(spark, f"{tmp_path}/*.xml").orderBy("i").collect()
    assert (rows[0]["X"], rows[0]["Z"], rows[0]["x"], rows[1]["y"]) == (1.0, 0.5, 12.5, 5.0)
    tsai = xml.read_tsai("<C><fx_fy>9 8</fx_fy><Cx__Cy>1 2</Cx__Cy><kc>0.1</kc><Tx_Ty_Tz>1 2 3</Tx_Ty_Tz><R_1>1 0 0</R_1><R_2>0 1 0</R_2><R_3>0 0 1</R_3><SliceCoord_1>0 0 5</SliceCoord_1></C>")
    assert tsai.f == (9.0, 8.0) and tsai.r == (1, 0, 0, 0, 1, 0, 0, 0, 1) and tsai.slices == ((0.0, 0.0, 5.0),)


def test_instructions():
    found = xml.read_instructions("<Series><InputTable>/d &amp; /s &amp; Images &amp; im &amp; .png</InputTable><IndexRange><first_i>1</first_i><last_i>4</last_i></IndexRange><ActionInput><PairIndices><ListPairCiv1>x</ListPairCiv1></PairIndices><Civ1><CorrBoxSize>31 21</CorrBoxSize></Civ1><CheckCiv2>1</CheckCiv2></ActionInput></Series>")
    assert found["crop"] == (22, 32) and found["passes"] == 2 and found["first_i"] == "1"
    assert xml.pair_subset("Di= 0|1 :dt= 1") == "i+0:i+2:1"
    assert xml.pair_subset("j= a-b") == "i,0:2"


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("1.5 read k1 start\nnoise\n2.5 read k1 end\n3 read k2 start\n")
    from velofield.operators.statistics import log_durations

    e = logs.read_logs(spark, str(tmp_path))
    rows = {r["key"]: r for r in log_durations(e.where("event = 'start'"), e.where("event = 'end'")).collect()}
    assert rows["k1"]["duration"] == 1.0 and rows["k2"]["t_end"] is None
    t = spark.createDataFrame([(25.5,), (3725.0,)], "s double")
    assert [r[0] for r in t.select(logs.duration_text(F.col("s"))).collect()] == ["25.50 s", "01:02:05"]


def test_params_round_trip():
    p = P.Piv(piv0=P.FirstPass(shape_crop_im0=(32, 48), displacement_max="50%"), multipass=P.Multipass(number=2))
    assert P.from_json(P.Piv, P.to_json(p)) == p and P.from_xml(P.Piv, P.to_xml(p)) == p
    with pytest.raises(AttributeError):
        P.from_dict(P.Piv, {"piv0": {"shape": 3}})


def test_command_line(spark, folder, tmp_path):
    (folder / "im_05.png").unlink()
    cli.main(["mean", "--images", f"{folder}/*.png", "-o", str(tmp_path / "mean")])
    assert spark.read.parquet(str(tmp_path / "mean")).first()["pixels"] == [2.5] * 32


def test_saved_images_read_back(spark, folder, tmp_path):
    frames = S.read_images(spark, f"{folder}/*.png")
    for r in sinks.save_images(frames, "out").collect():
        assert (S.decode(bytes(r["content"])) == int(r["name"][-6:-4])).all()
