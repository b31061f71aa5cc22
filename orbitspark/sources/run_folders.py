"""Run folders and what lies in them: strict JSON documents, packages of selected frames, exports and web clouds."""

from __future__ import annotations

import json
import math
import subprocess
import uuid
from hashlib import sha256

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from orbitspark.errors import AlreadyThere, InputUnusable, MissingOrForeign, ResultEmpty
from orbitspark.operators import cloud as cl
from orbitspark.operators import results as rs
from orbitspark.sources import checksums, ply

#: The documents of a run and the parts of a result that are taken over.
MANIFEST, STATUS, CAMERAS, DIAGNOSTICS = "manifest.json", "normalized/status.json", "normalized/cameras.json", "normalized/diagnostics.json"
RESULT_PARTS = r"(^|/)sparse/|(^|/)points\.ply$|\.log$"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """One small file; AlreadyThere if there is one and it may not be replaced.

    The file system itself refuses a file that is there: nobody looks first, so of two writers at the same time one is refused.
    """
    p, fs = _path(spark, path)
    if not overwrite and p.toUri().getScheme() in (None, "file") and fs.getUri().getScheme() == "file":
        place = p.toUri().getPath()
        fs.mkdirs(p.getParent())
        try:
            with open(place, "x", encoding="utf-8", newline="") as f:
                f.write(text)
        except FileExistsError as e:
            raise AlreadyThere(f"already there: {path}") from e
        return
    try:
        out = fs.create(p, overwrite)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise AlreadyThere(f"already there: {path}") from e
        raise
    out.write(bytearray(text.encode()))
    out.close()


def finite_only(value, at: str = "$") -> None:
    """ValueError for a number that JSON has no text for."""
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError(f"{at} is not finite")
    for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, (list, tuple)) else ():
        finite_only(v, f"{at}.{k}")


def canonical(value) -> str:
    """The one JSON text of a value: sorted keys, no spaces, characters as they are."""
    finite_only(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def write_json(spark: SparkSession, path: str, value: dict, overwrite: bool = False) -> None:
    finite_only(value)
    write_text(spark, path, json.dumps(value, indent=2, ensure_ascii=False, allow_nan=False) + "\n", overwrite)


def read_json(spark: SparkSession, path: str) -> dict:
    """A document; MissingOrForeign if it is not there or not strict JSON."""

    def refuse(name: str):
        raise ValueError(f"{name} is not JSON")

    try:
        text = spark.read.text(path, wholetext=True).first()[0]
        return json.loads(text, parse_constant=refuse)
    except (AnalysisException, TypeError) as e:
        raise MissingOrForeign(f"no such document: {path}") from e
    except ValueError as e:
        raise MissingOrForeign(f"{path} is not strict JSON: {e}") from e


def require_same_run(run_id: str, **documents: dict) -> None:
    """MissingOrForeign, naming every document without a run id or with another one."""
    bad = [f"{name} {'has no run id' if d.get('run_id') is None else 'is of run ' + str(d['run_id'])}" for name, d in documents.items() if d.get("run_id") != run_id]
    if bad:
        raise MissingOrForeign(f"not of run {run_id}: " + ", ".join(bad))


def create_run(spark: SparkSession, base: str, run_id: str) -> str:
    """The folder of a new run; AlreadyThere if it exists."""
    folder = f"{base.rstrip('/')}/{run_id}"
    p, fs = _path(spark, folder)
    if fs.exists(p):
        raise AlreadyThere(f"there is a run folder {folder}")
    fs.mkdirs(p)
    return folder


def find_run(spark: SparkSession, folder: str) -> dict:
    """The manifest of a run folder; MissingOrForeign without one."""
    manifest = read_json(spark, f"{folder}/{MANIFEST}")
    if "run_id" not in manifest:
        raise MissingOrForeign(f"{folder}/{MANIFEST} has no run id")
    return manifest


def code_id(folder: str) -> str:
    """The commit of a checked-out folder, with ``+dirty`` and a digest of what was changed; a digest of its Python files where there is no repository."""
    git = ["git", "-c", "safe.directory=*", "-C", folder]
    try:
        commit = subprocess.run([*git, "rev-parse", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
        changed = subprocess.run([*git, "status", "--porcelain"], capture_output=True, text=True, check=True).stdout
        diff = subprocess.run([*git, "diff", "HEAD"], capture_output=True, text=True, check=True).stdout if changed else ""
        return commit + (f"+dirty-{sha256((changed + diff).encode()).hexdigest()[:8]}" if changed else "")
    except (OSError, subprocess.CalledProcessError):
        from pathlib import Path

        digest = sha256()
        for f in sorted(Path(folder).rglob("*.py")):
            digest.update(f.relative_to(folder).as_posix().encode() + b"\0" + f.read_bytes())
        return "files-" + digest.hexdigest()[:12]


def copy_files(files: DataFrame, folder: str) -> DataFrame:
    """Copies files (columns ``source``, ``target`` below ``folder``) on the executors; path, length and sha256 of each.

    A task that runs again replaces its own files with the same bytes.
    """
    spark = files.sparkSession
    sources = [r[0] for r in files.select("source").distinct().limit(1).collect()]
    if not sources:
        return spark.createDataFrame([], "path string, length long, sha256 string")

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            rows = []
            for source, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                inp, path = fs.FileSystem.from_uri(source if "://" in source else f"file://{source}")
                out, base = fs.FileSystem.from_uri(folder)
                out.create_dir(f"{base}/{target}".rsplit("/", 1)[0], recursive=True)
                digest, size = sha256(), 0
                with inp.open_input_stream(path) as f, out.open_output_stream(f"{base}/{target}") as g:
                    while data := f.read(1 << 20):
                        digest.update(data)
                        size += len(data)
                        g.write(data)
                rows.append((target, size, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["path", "length", "sha256"])

    done = files.select("source", "target").mapInArrow(run, "path string, length long, sha256 string").collect()
    return spark.createDataFrame(done, "path string, length long, sha256 string")


def package_plan(frames: DataFrame, files: DataFrame) -> DataFrame:
    """Selected frames with the source of each by ``src_index``, and by ``run_id`` where both have it; ``source`` is null where there is no file. frames: frame_id, src_index, selected."""
    key = [c for c in ("run_id", "src_index") if c in frames.columns and c in files.columns]
    return frames.where("selected").select("frame_id", *key).join(files.select(*key, F.col("path").alias("source")), key, "left").withColumn("target", F.concat(F.lit("images/"), "frame_id", F.lit(".jpg")))


def build_package(frames: DataFrame, files: DataFrame, folder: str, manifest: dict) -> dict:
    """Copies the selected frames as images/<frame_id>.jpg, and writes the manifest and the checksum list; returns the totals.

    InputUnusable if a frame has no source or several; AlreadyThere if the folder holds anything. The same input gives the same sums.
    """
    spark = frames.sparkSession
    p, fs = _path(spark, folder)
    if fs.exists(p) and len(fs.listStatus(p)):
        raise AlreadyThere(f"{folder} is not empty")
    plan = package_plan(frames, files)
    lost = [r[0] for r in plan.where("source is null").select("frame_id").orderBy("frame_id").limit(6).collect()]
    if lost:
        raise InputUnusable("no source for " + ", ".join(lost[:5]) + (" and more" if len(lost) > 5 else ""))
    twice = [r[0] for r in plan.groupBy("frame_id").count().where("count > 1").select("frame_id").orderBy("frame_id").limit(5).collect()]
    if twice:
        raise InputUnusable("several sources for " + ", ".join(twice))
    copied = copy_files(plan, folder)
    text = canonical(manifest) + "\n"
    write_text(spark, f"{folder}/{MANIFEST}", text)
    own = spark.createDataFrame([(MANIFEST, len(text.encode()), sha256(text.encode()).hexdigest())], copied.schema)
    listing = copied.unionByName(own)
    write_text(spark, f"{folder}/SHA256SUMS", "".join(r[0] + "\n" for r in checksums.lines(listing).collect()))
    row = listing.agg(F.count("*"), F.sum("length"), F.count_if(F.col("path").startswith("images/"))).first()
    return {"file_count": row[0], "total_bytes": row[1], "image_count": row[2]}


def copy_result(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """Takes over a result's sparse model, point cloud and logs, and nothing else."""
    listing = checksums.list_folder(spark, source).select("path").where(F.col("path").rlike(RESULT_PARTS))
    return copy_files(listing.select(F.concat(F.lit(source.rstrip("/") + "/"), "path").alias("source"), F.col("path").alias("target")), folder)


def summary(points: int, cameras: int, state: str, scale: str, reason: str | None) -> dict[str, str]:
    """Header comments of an export."""
    out = {"export_of": "normalized/points.ply", "points": str(points), "cameras": str(cameras), "status": state, "scale_status": scale, "note": "as displayed, nothing filtered"}
    return out | ({"unusable": "true", "unusable_reason": reason} if reason else {})


def export_cloud(spark: SparkSession, run: str, target: str | None = None, force: bool = False) -> str:
    """Writes the displayed cloud of a run as it is; returns the folder of the PLY files.

    ResultEmpty for an unusable status unless forced (the folder's name then says so), and for an empty cloud always;
    AlreadyThere for an earlier export unless forced; MissingOrForeign for an unknown status, a missing document or one of another run.
    """
    from orbitspark.operators import runs as rn

    run_id = find_run(spark, run)["run_id"]
    status, cameras = read_json(spark, f"{run}/{STATUS}"), read_json(spark, f"{run}/{CAMERAS}")
    state = status.get("status")
    if state not in rn.BANNERS:
        raise MissingOrForeign(f"unknown status {state!r}")
    if not isinstance(cameras.get("cameras"), list):
        raise MissingOrForeign(f"{CAMERAS} has no list of cameras")
    points = ply.read_ply(spark, f"{run}/normalized")
    ids = [r[0] for r in points.select("run_id").distinct().limit(2).collect()]
    require_same_run(run_id, **{"the status": status, "the cameras": cameras}, **({f"cloud {i}": {"run_id": x} for i, x in enumerate(ids)}))
    wanted = target or f"{run}/export/object.ply"
    n = points.count()
    lit = spark.range(1)
    there = lambda path: exists(spark, path)
    at = lit.select(rs.export_guard(F.lit(state), F.lit(n), F.lit(False), F.lit(force), F.lit(wanted))["target"]).first()[0]
    code = lit.select(rs.export_guard(F.lit(state), F.lit(n), F.lit(there(at)), F.lit(force), F.lit(wanted))["exit_code"]).first()[0]
    if code == AlreadyThere.exit_code:
        raise AlreadyThere(f"there is an export {at}")
    if code:
        raise ResultEmpty("the cloud has no points" if not n else f"the status is {state}")
    usable = state in ("success", "partial")
    scale = str((cameras.get("conventions") or {}).get("scale_status", "not_determined"))
    p, fs = _path(spark, at)
    if fs.exists(p) and not fs.getFileStatus(p).isDirectory():
        raise AlreadyThere(f"{at} is a file")
    # The new cloud is whole before the old one goes, and of the target folder only PLY files are replaced.
    beside = f"{at.rstrip('/')}.new-{uuid.uuid4().hex}"
    done = ply.write_ply(points, beside, run_id, summary(n, len(cameras["cameras"]), state, scale, None if usable else f"status {state}, written because it was forced"), ply.parts_for(n))
    if done.agg(F.sum("n_points")).first()[0] != n:
        fs.delete(_path(spark, beside)[0], True)
        raise ResultEmpty("the export has fewer points than the cloud")
    fs.mkdirs(p)
    for old in list(fs.listStatus(p)):
        if old.isFile() and old.getPath().getName().endswith(".ply"):
            fs.delete(old.getPath(), False)
    for new in list(fs.listStatus(_path(spark, beside)[0])):
        if new.getPath().getName().endswith(".ply"):
            fs.rename(new.getPath(), _path(spark, f"{at}/{new.getPath().getName()}")[0])
    fs.delete(_path(spark, beside)[0], True)
    return at


def write_web_cloud(spark: SparkSession, source: str, folder: str, target: int = 40_000, axes: str = "y up") -> str:
    """A light copy of a cloud, at most ``target`` of its points, with its run id; returns how many of how many."""
    points = ply.read_ply(spark, source)
    total, run_id = points.agg(F.count("*"), F.first("run_id")).first()
    if not total:
        raise ResultEmpty("the cloud has no points")
    kept, size = cl.voxel_decimate(points, target)
    done = ply.write_ply(kept, folder, run_id or "", {"axes": axes, "voxel_size": "none" if size is None else f"{size:.9g}"})
    return cl.count_label(done.agg(F.sum("n_points")).first()[0], total)


def camera_poses(spark: SparkSession, document: dict) -> DataFrame:
    """The poses of a camera document as a table: frame_id, r00..r22, t0..t2. Cameras without a pose are left out."""
    from orbitspark.operators import cameras as cam

    rows = [(c.get("frame_id"), *(float(x) for line in c["R"] for x in line), *map(float, c["t"])) for c in document.get("cameras") or [] if c.get("R") and c.get("t")]
    return spark.createDataFrame(rows, "frame_id string, " + ", ".join(f"{c} double" for c in cam.R + cam.T))
