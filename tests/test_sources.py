"""Files read in parts: splits, blocks and streams give what the whole files hold."""

import hashlib
import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitspark import errors
from orbitspark.sources import checksums, ply, sparse_model, streams


def cloud_file(path, n, run="r"):
    rng = np.random.default_rng(n)
    rows = np.zeros(n, ply.ROW)
    for c in "xyz":
        rows[c] = rng.normal(size=n)
    for c in "rgb":
        rows[c] = rng.integers(0, 256, n)
    path.write_bytes(ply.header(n, {"run_id": run, "note": "x" * 5000}) + rows.tobytes())
    return rows


@pytest.mark.parametrize("split", [1, 7, 15, 1000, 4096, 1 << 20])
def test_ply_in_any_number_of_splits(spark, tmp_path, split):
    n = 40 if split < 100 else 3000
    rows = cloud_file(tmp_path / "a.ply", n)
    cloud_file(tmp_path / "empty.ply", 0)
    if split < 100:
        reader = ply.PlyReader({"path": f"file://{tmp_path}", "split": str(split)})
        parts = [b for p in reader.partitions() for b in reader.read(p)]
        got = [(i, x) for b in parts for i, x in zip(b["point_id"].to_pylist(), b["x"].to_pylist())]
        assert len(reader.partitions()) > 100 and sorted(got) == [(i, float(x)) for i, x in enumerate(rows["x"])]
        return
    df = ply.read_ply(spark, f"file://{tmp_path}", split)
    assert df.rdd.getNumPartitions() == sum(-(-f.stat().st_size // split) for f in tmp_path.glob("*.ply"))
    got = df.where("file like '%a.ply'").orderBy("point_id").collect()
    assert [r["point_id"] for r in got] == list(range(n)) and [(r["x"], r["g"]) for r in got] == [(float(a), int(g)) for a, g in zip(rows["x"], rows["g"])] and got[0]["run_id"] == "r"


def test_reader_holds_a_block_and_keeps_strict_length(tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "BLOCK", 1500)
    rows = cloud_file(tmp_path / "a.ply", 1000)
    reader = ply.PlyReader({"path": f"file://{tmp_path}"})
    (whole,) = reader.partitions()
    sizes = [b.num_rows for b in reader.read(whole)]
    assert sum(sizes) == 1000 and max(sizes) == 100
    for content in ((tmp_path / "a.ply").read_bytes()[:-1], (tmp_path / "a.ply").read_bytes() + b"\0"):
        (tmp_path / "a.ply").write_bytes(content)
        for part in ply.PlyReader({"path": f"file://{tmp_path}", "split": "6000"}).partitions():
            with pytest.raises(errors.MissingOrForeign, match="length"):
                list(reader.read(part))
    assert rows is not None


def test_broken_file_is_refused_by_its_task(spark, tmp_path):
    (tmp_path / "a.ply").write_bytes(b"ply\nformat ascii 1.0\nend_header\n")
    with pytest.raises(Exception, match="MissingOrForeign"):
        ply.read_ply(spark, f"file://{tmp_path}").collect()
    assert ply.read_ply(spark, str(tmp_path / "none")).count() == 0


def points_file(n, seed=1):
    rng = np.random.default_rng(seed)
    out, want = [struct.pack("<Q", n)], []
    for i in range(n):
        k, error = int(rng.integers(0, 9)), float(rng.choice([-1.0, 0.5]))
        out.append(struct.pack("<Q3d3BdQ", i, i, 0.5, -1, i % 256, 8, 7, error, k) + b"\7" * 8 * k)
        want.append((i, float(i), i % 256, None if error < 0 else error, k))
    return b"".join(out), want


@pytest.mark.parametrize("block", [60, 200, 1 << 20])
def test_points_in_blocks(block):
    data, want = points_file(500)
    got = []
    for columns in sparse_model.parse(io.BytesIO(data), "points3D.bin", block):
        b = sparse_model.to_batch(columns, "points3D.bin", "f")
        got += list(zip(*(b[c].to_pylist() for c in ("point_id", "x", "r", "error", "track_length"))))
        assert b.num_rows * 51 <= 2 * max(block, 123)
    assert got == want
    for cut in (1, 30, len(data) - 9):
        with pytest.raises(ValueError):
            list(sparse_model.parse(io.BytesIO(data[:-cut]), "points3D.bin", block))


def test_images_in_blocks():
    data = struct.pack("<Q", 40)
    for i in range(40):
        data += struct.pack("<I7dI", i, 1, 0, 0, 0, 0.5, 0, i, 1) + f"images/{'n' * i}.jpg".encode() + b"\0" + struct.pack("<Q", i) + b"\1" * 24 * i
    for block in (65, 1 << 16):
        batches = [sparse_model.to_batch(c, "images.bin", "f") for c in sparse_model.parse(io.BytesIO(data), "images.bin", block)]
        rows = [r for b in batches for r in b.to_pylist()]
        assert [(r["image_id"], r["name"], r["n_points2d"], r["t"][2]) for r in rows] == [(i, f"images/{'n' * i}.jpg", i, float(i)) for i in range(40)]


def test_model_files_of_many_folders(spark, tmp_path):
    for k in (1, 2, 3):
        (tmp_path / f"run{k}").mkdir()
        (tmp_path / f"run{k}" / "points3D.bin").write_bytes(points_file(k * 10, k)[0])
    got = {r["folder"].rsplit("/", 1)[1]: r["n"] for r in sparse_model.read_points(spark, str(tmp_path)).groupBy("folder").agg(F.count("*").alias("n")).collect()}
    assert got == {"run1": 10, "run2": 20, "run3": 30}


def test_files_are_hashed_a_block_at_a_time(spark, tmp_path, monkeypatch):
    (tmp_path / "sub").mkdir()
    data = {"a.bin": b"", "sub/b.bin": bytes(range(256)) * 100_000, "sub/c d.txt": "é".encode()}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    for folder in (str(tmp_path), f"file://{tmp_path}/"):
        got = {r["path"]: (r["length"], r["sha256"]) for r in checksums.list_folder(spark, folder).collect()}
        assert got == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in data.items()}
    few = checksums.ChecksumReader({"path": f"file://{tmp_path}", "number": "1"})
    assert [len(p.files) for p in few.partitions()] == [1, 1, 1]
    monkeypatch.setattr(streams, "readable", lambda uri: False)
    assert {r["path"]: r["sha256"] for r in checksums.list_folder(spark, str(tmp_path)).collect()} == {k: hashlib.sha256(v).hexdigest() for k, v in data.items() if v}
