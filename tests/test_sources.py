"""Readers and writers on small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.sources import cameras, frames, lists, npy, obj, sinks, solver_text

CUBE = np.array([[x, y, z] for x in (-0.5, 0.5) for y in (-0.5, 0.5) for z in (-0.5, 0.5)])


def stretched():
    return np.stack([CUBE, CUBE * [1.2, 1, 1], CUBE * [1, 0.8, 1.3]])


def test_obj_reader(spark, tmp_path):
    d = tmp_path / "walk"
    d.mkdir()
    (d / "b.obj").write_text("# c\nv 1 2 3\nv 4 5 6\nvn 0 0 1\nv 7 8 9\nv 1 1 1\nf 1/1/1 2/2/2 3/3/3\nf 1 2 3 4\n")
    (d / "a.obj").write_text("v 0 0 0 0.5 0.5 0.5\nv 1 0 0\nv 0 1 0\nf -3 -2 -1\n")
    listing, pts, faces = obj.read_obj_frames(spark, str(tmp_path))
    assert {(r.seq_id, r.name, r.frame_id) for r in listing.collect()} == {("walk", "a", 0), ("walk", "b", 1)}
    assert [(r.x, r.y, r.z) for r in pts.where("frame_id = 1").orderBy("vertex_id").collect()] == [(1, 2, 3), (4, 5, 6), (7, 8, 9), (1, 1, 1)]
    tri = [(r.frame_id, r.face_id, r.v0, r.v1, r.v2) for r in faces.orderBy("frame_id", "face_id").collect()]
    assert tri == [(0, 0, 0, 1, 2), (1, 0, 0, 1, 2), (1, 1, 0, 1, 2), (1, 2, 0, 2, 3)]


def test_obj_file_of_several_blocks(spark, tmp_path):
    """A file read by blocks of 4 kB gives what it gives as one row, and so does one beside it that is small."""
    rng = np.random.default_rng(3)
    d = tmp_path / "seq"
    d.mkdir()
    lines = [f"v {x:.6f} {y:.6f} {z:.6f}" if i % 3 else f"f {i % 9 + 1}/2 -1 {i % 5 + 1}//3" + " 4" * (i % 3 + i % 2) for i, (x, y, z) in enumerate(rng.normal(size=(4000, 3)))]
    lines[50:50] = ["# note", "", "vn 0 0 1", "  v\t7  8 9 ", "f 1 2"]
    (d / "big.obj").write_text("\n".join(lines))
    (d / "a.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1 2 3\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        names, points, faces = obj.read_obj_frames(spark, str(tmp_path), whole=1000)
        assert spark.read.text(str(tmp_path), recursiveFileLookup=True).rdd.getNumPartitions() > 10
        got = [sorted(map(tuple, df.collect())) for df in (names, points, faces)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [sorted(map(tuple, df.collect())) for df in obj.read_obj_frames(spark, str(tmp_path))]
    assert len(got[1]) > 2000


def test_obj_writer(spark, cloud, tmp_path):
    faces = spark.createDataFrame([("s", f, 0, 0, 1, 2) for f in range(3)], "seq_id string, frame_id long, face_id long, v0 long, v1 long, v2 long")
    obj.write_obj_frames(cloud(stretched()), faces, str(tmp_path / "o"))
    text = [p.read_text() for p in (tmp_path / "o" / "seq_id=s" / "frame_id=1").glob("*.txt")]
    lines = "".join(text).splitlines()
    assert lines[0] == "v -0.6 -0.5 -0.5" and lines[-1] == "f 1 2 3" and len(lines) == 9


def test_npy(spark, tmp_path):
    arr = np.random.default_rng(0).normal(size=(4, 5, 6)).astype(np.float32)
    d = tmp_path / "data" / "subj" / "ep"
    d.mkdir(parents=True)
    np.save(d / "run_points.npy", arr)
    j = tmp_path / "joints"
    j.mkdir()
    np.save(j / "run_joints.npy", arr[:, :2, :3])
    df = npy.read_npy_sequences(spark, str(tmp_path / "data"), ("subject", "episode"))
    rows = df.orderBy("frame_id", "vertex_id").collect()
    assert (rows[0].seq_id, rows[0].subject, rows[0].episode) == ("subj/ep/run_points", "subj", "ep")
    assert np.allclose(np.array([[r.x, r.y, r.z] for r in rows]), arr[..., :3].reshape(-1, 3))
    joints = npy.pair_joints(df, npy.read_npy_joints(spark, str(j)), r"^.*/(.*)_points$", "$1_joints")
    assert joints.count() == 8 and joints.first().seq_id == "subj/ep/run_points"


def test_lists(spark, tmp_path):
    (tmp_path / "train.txt").write_text("a\nb\n\n")
    members = lists.read_split_list(spark, str(tmp_path / "train.txt"), "train")
    seqs = spark.createDataFrame([("a",), ("c",)], "seq_id string")
    assert {(r.seq_id, r.split) for r in lists.assign_split(seqs, members).collect()} == {("a", "train"), ("c", None)}
    (tmp_path / "s.txt").write_text("01 (male)\nwalk\nrun\n\n02 (female)\njump\n")
    rows = lists.read_sectioned_list(spark, str(tmp_path / "s.txt")).collect()
    assert [tuple(r) for r in rows] == [("01", "male", "walk"), ("01", "male", "run"), ("02", "female", "jump")]


def test_camera(spark, tmp_path):
    ext = [float(i) for i in range(16)]
    (tmp_path / "c.json").write_text(json.dumps({"class_name": "P", "extrinsic": ext, "intrinsic": {
        "height": 958, "width": 1025, "intrinsic_matrix": [829.65, 0, 0, 0, 829.65, 0, 512, 478.5, 1]}, "version_major": 1, "version_minor": 0}))
    r = cameras.read_camera_json(spark, str(tmp_path / "c.json")).first()
    assert (r.tx, r.ty, r.tz) == (12, 13, 14) and r.r == [0, 4, 8, 1, 5, 9, 2, 6, 10]
    assert (r.intrinsic.width, r.fx, r.cx, r.cy) == (1025, 829.65, 512, 478.5)


def test_solver_text(spark, cloud, tmp_path):
    bones = spark.createDataFrame([(0, -1), (1, 0)], "k long, parent long")
    solver_text.write_solver_text(cloud(stretched()), bones, str(tmp_path / "t"))
    files = sorted((tmp_path / "t" / "seq_id=s").glob("*.txt"))
    lines = "".join(f.read_text() for f in files).splitlines()
    assert lines[:4] == ["nV 8", "nB 2", "nF 2", "nS 1"] and "parent 1 0" in lines
    assert [s for s in lines if s[:2] in ("v ", "a ")][0] == "v -0.500000 -0.500000 -0.500000"
    assert sum(s.startswith("a ") for s in lines) == 16


def test_weight_text(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# weights\n\nw 0.8 0.2\nw 3 1\nw 0.5\nw 0 0\n")
    rows = {(r.vertex_id, r.k): r.w for r in solver_text.read_weight_text(spark, str(tmp_path / "w.txt"), 2).collect()}
    assert rows == pytest.approx({(0, 0): 0.8, (0, 1): 0.2, (1, 0): 0.75, (1, 1): 0.25})


def test_frame_cache_and_selection(spark, cloud, tmp_path):
    p = cloud(stretched())
    path = str(tmp_path / "cache")
    assert frames.materialize_frames(p.where("frame_id < 2"), path).count() == 16
    assert frames.materialize_frames(p, path).count() == 24
    listing = frames.number_frames(spark.createDataFrame([("s", "f_b"), ("s", "f_a")], "seq_id string, name string"))
    assert frames.resolve_frame(listing, "1").first().name == "f_a"
    assert frames.resolve_frame(listing, "f_b").first().number == 2
    with pytest.raises(Exception, match="not found"):
        frames.resolve_frame(listing, "9").collect()


def test_sinks(spark, cloud, tmp_path):
    pairs = spark.createDataFrame([("s", 0, 1)], "seq_id string, frame_a long, frame_b long")
    sinks.write_interpolation(cloud(stretched()), pairs, "direct", 2, str(tmp_path / "r"))
    names = {r.file for r in spark.read.parquet(str(tmp_path / "r" / "manifest")).collect()}
    assert names == {"interpolated_000_t0.000.obj", "interpolated_001_t0.500.obj", "interpolated_002_t1.000.obj"}
    sinks.write_metric_csv(spark.createDataFrame([(0.5,)], "v double"), str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m")).first()[0] == "0.5"
    kinds = {r.kind: r.files for r in sinks.count_files(spark, str(tmp_path / "r")).collect()}
    assert kinds[".parquet"] >= 2
