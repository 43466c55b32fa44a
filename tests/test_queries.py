"""Registered queries against DuckDB, the streams, and the library without its optional part."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from conftest import assert_same

from velofield.plans.queries import QUERIES, SQL
from velofield.streaming import frames as streaming

SOME = ["frames_scan", "crop_mask", "vector_grid", "window_positions", "make_subsets", "bos_reference_join", "missing_results", "mean_image", "neighbor_mean", "sliding_median", "temporal_percentile", "rescale_tanh", "equalize_global", "correlate_circular", "peak_topk", "subpix_gaussian2", "fix_vectors", "piv_pass0", "field_curl", "dft_1d", "calib_tsai", "stereo_reconstruct", "mlos", "phase_chain", "failure_propagation", "worker_timeline", "surface_merge", "describe_values", "field_slice", "field_grid", "field_storage", "stereo_direct", "stream_couples"]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, sf, duck, name):
    assert_same(QUERIES[name](spark, sf), duck, SQL[name])


def test_streams(spark, sf, duck):
    assert_same(QUERIES["stream_mean"](spark, sf), duck, SQL["stream_mean"])
    assert_same(QUERIES["stream_events"](spark, sf), duck, SQL["stream_events"])


def test_couples_meet_in_a_stream(spark, tmp_path):
    path = str(tmp_path / "frames")
    for k in (2, 0, 3, 1):
        spark.createDataFrame([(k, [float(k), 1.0])], "i long, pixels array<double>").coalesce(1).write.mode("append").parquet(path)
    made = streaming.finished(streaming.couples(streaming.read(spark, path)), str(tmp_path / "state"), "append")
    assert (tmp_path / "state" / "checkpoint").exists()
    assert sorted((r["key"], r["product"]) for r in made.collect()) == [(0, 1.0), (1, 3.0), (2, 7.0)]


def test_imports_without_the_optional_part(tmp_path):
    root = Path(__file__).resolve().parent.parent
    for name in ("velofield", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(root / name)
    code = "import sys; sys.modules['velofield.llm'] = None; import importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n.startswith('velofield.llm') else f(n, *a); import __spark_entry__ as e; q = e.queries(); assert 'piv_pass0' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": "/tmp"})


@pytest.fixture(scope="module")
def dealt(sf, duck, tmp_path_factory):
    """Tables as folders of several files, as large tables are stored."""
    folder = tmp_path_factory.mktemp("dealt")
    for name, key in (("embeddings", "vec_id"), ("events", "event_id")):
        (folder / f"{name}.parquet").mkdir()
        for k in range(4):
            duck.execute(f"copy (select * from {name} where {key} % 4 = {k}) to '{folder}/{name}.parquet/part-{k}.parquet' (format parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["stream_couples", "stream_mean", "stream_events"])
def test_streams_over_tables_of_many_files(spark, dealt, duck, name):
    assert_same(QUERIES[name](spark, dealt), duck, SQL[name])


def test_a_stream_reads_one_file_and_no_other_of_its_name(spark, tmp_path):
    for k, path in enumerate(("frames.parquet", "old/frames.parquet")):
        (tmp_path / path).parent.mkdir(exist_ok=True)
        made = str(tmp_path / f"made{k}")
        spark.createDataFrame([(k, [1.0])], "i long, pixels array<double>").coalesce(1).write.parquet(made)
        next(Path(made).glob("*.parquet")).rename(tmp_path / path)
    for path in (f"{tmp_path}/frames.parquet", f"file://{tmp_path}/frames.parquet"):
        found = streaming.finished(streaming.read(spark, path), mode="append")
        assert [r["i"] for r in found.collect()] == [0]


@pytest.mark.parametrize("vector", ["case when vec_id % 7 > 0 then embedding end", "case vec_id % 7 when 0 then embedding[1:20] when 1 then list_concat(embedding, embedding) when 2 then [] else embedding end", "list_transform(embedding, lambda v, k: case when (k + vec_id) % 5 > 0 and k <> 3 then v end)", "cast(null as float[])"])
def test_the_mean_in_a_stream_counts_odd_vectors_as_its_sql(spark, sf, tmp_path, vector):
    path = str(tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"copy (select vec_id, {vector} as embedding, label from '{sf}/embeddings.parquet') to '{path}' (format parquet)")
    con.execute(f"create view embeddings as select * from '{path}'")
    assert_same(QUERIES["stream_mean"](spark, str(tmp_path)), con, SQL["stream_mean"])


def test_a_running_mean_leaves_null_pixels_out(spark, tmp_path):
    path = str(tmp_path / "frames")
    spark.createDataFrame([([1.0, None],), ([3.0, None],), ([None, 4.0],), (None,)], "pixels array<double>").write.parquet(path)
    found = streaming.finished(streaming.running_mean(streaming.read(spark, path)))
    assert sorted((r["pos"], r["total"] / r["n"], r["frames"]) for r in found.collect()) == [(0, 2.0, 3), (1, 4.0, 3)]
