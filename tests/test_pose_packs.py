"""Poses of many frames share files, whose number does not grow with the frames."""

import glob

from evidex.plans import sources
from evidex.sources import readers as rd

SF_DIR = "/root/testdata/sf0.001"
GOOD = "1 0 0 0.5\n0 1 0 0\r\n0 0 1 -2\n\n0 0 0 1"


def test_packs_hold_what_single_files_hold(spark, tmp_path):
    texts = [(1, GOOD), (2, "1 0 0\n0 1"), (3, GOOD.replace("-2", "nan")), (4, ""), (5, GOOD.replace("0 0 0 1", "0 0 0 2")), (6, GOOD.replace("0.5", "x"))]
    poses = spark.createDataFrame(texts, "name long, value string")
    rd.write_pose_packs(poses.coalesce(1), str(tmp_path / "packs"))
    poses.where("value <> ''").withColumnRenamed("name", "step").write.partitionBy("step").text(str(tmp_path / "files"))
    columns = ["rule", "rotation", "translation"]
    packed = {int(r.name): tuple(r)[1:] for r in rd.read_pose_packs(spark, str(tmp_path / "packs")).select("name", *columns).collect()}
    single = {r.step: tuple(r)[1:] for r in rd.read_poses(spark, str(tmp_path / "files")).select("step", *columns).collect()}
    assert packed.pop(4)[0] == "shape" and packed == single and single[1][0] is None and single[1][2] == [0.5, 0.0, -2.0]


def test_a_pose_scan_makes_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "scratch_path", lambda spark, name: str(tmp_path / name))
    frames = sources.a05(spark, SF_DIR).count()
    files = glob.glob(f"{tmp_path}/**/part-*", recursive=True)
    assert 0 < len(files) < frames / 2
