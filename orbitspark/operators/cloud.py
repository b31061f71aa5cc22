"""Point clouds: validity, outliers, extents, voxels, pixels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orbitspark.functions import linalg as la
from orbitspark.functions.measures import finite
from orbitspark.operators.quantiles import group_quantiles, quantile_row
from orbitspark.storage import written

AXES = ("x", "y", "z")


def is_valid_point() -> Column:
    return finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z"))


def with_row(points: DataFrame, one: DataFrame, run: str | None) -> DataFrame:
    """Points with the columns of ``one``: a single row, broadcast, or with ``run`` a row a run (null is a run).

    The rows of a run are few beside its points; whether they are broadcast is left to their size at run time, and
    a run that holds most points is split there.
    """
    if run is None:
        return points.crossJoin(F.broadcast(one))
    return points.join(one.withColumnRenamed(run, "_run"), F.col(run).eqNullSafe(F.col("_run"))).drop("_run")


def quantiles(points: DataFrame, columns: list[str], fractions: list[float], run: str | None) -> DataFrame:
    return quantile_row(points.select(*columns), columns, fractions) if run is None else group_quantiles(points.select(run, *columns), run, columns, fractions)


def iqr_bounds(points: DataFrame, k: float = 3.0, run: str | None = None) -> DataFrame:
    """Per axis the bounds k inter-quartile ranges outside the quartiles, of finite points only: one row, or with ``run`` one a run.

    Quartiles are exact and interpolated. Bounds are null for a cloud without finite points; such a run has no row.
    """
    quartiles = quantiles(points.where(is_valid_point()), list(AXES), [0.25, 0.75], run)
    out = [] if run is None else [run]
    for c in AXES:
        low, high = F.get(c, F.lit(0)), F.get(c, F.lit(1))
        out += [(low - k * (high - low)).alias(f"lo_{c}"), (high + k * (high - low)).alias(f"hi_{c}")]
    return quartiles.select(*out)


def within() -> Column:
    inside = is_valid_point()
    for c in AXES:
        inside = inside & F.col(c).between(F.col(f"lo_{c}"), F.col(f"hi_{c}"))
    return inside


def filter_outliers(points: DataFrame, k: float = 3.0, run: str | None = None) -> DataFrame:
    """Finite points within the bounds of all three axes (of their run), bounds included."""
    return with_row(points.where(is_valid_point()), iqr_bounds(points, k, run), run).where(within()).select(*points.columns)


def outlier_info(points: DataFrame, k: float = 3.0, run: str | None = None) -> DataFrame:
    """Points, finite points, points kept, and the bounds: one row, or one a run."""
    bounds = iqr_bounds(points, k, run)
    counted = (F.count("*").alias("n_total"), F.count_if(is_valid_point()).alias("n_finite"), F.count_if(within()).alias("n_kept"))
    if run is None:
        return with_row(points, bounds, None).agg(*counted).crossJoin(F.broadcast(bounds))
    met = points.join(bounds.withColumnRenamed(run, "_run"), F.col(run).eqNullSafe(F.col("_run")), "left")
    return met.groupBy(run).agg(*counted, *(F.first(c).alias(c) for c in bounds.columns if c != run))


def bounding_box(points: DataFrame, run: str | None = None) -> DataFrame:
    """Least and greatest finite coordinates, with a reason where there is none: one row, or one a run."""
    ok = is_valid_point()
    box = points.groupBy(*([] if run is None else [run])).agg(F.count_if(ok).alias("n_points"), *(f(F.when(ok, F.col(c))).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in AXES))
    return box.withColumn("reason", F.when(F.col("n_points") == 0, "no finite points"))


def medians(points: DataFrame, run: str | None = None) -> DataFrame:
    row = quantiles(points.where(is_valid_point()), list(AXES), [0.5], run)
    return row.select(*([] if run is None else [run]), *(F.get(c, F.lit(0)).alias(f"m{c}") for c in AXES))


def robust_extent(points: DataFrame, percent: float = 98.0, run: str | None = None) -> DataFrame:
    """Median centre and the radius that holds ``percent`` of the points: one row, or one a run; (0, 0, 0) and 1 for none."""
    key = [] if run is None else [run]
    middle = written(medians(points, run), "medians")
    away = la.norm(la.sub(la.vec(*AXES), la.vec("mx", "my", "mz")))
    centred = with_row(points.where(is_valid_point()), middle, run).select(*key, away.alias("away"))
    reach = quantiles(centred, ["away"], [percent / 100], run).select(*key, F.get("away", F.lit(0)).alias("r"))
    if run is None:
        row = middle.crossJoin(reach)
    else:
        row = points.select(run).distinct()
        for part in (middle, reach):
            row = row.join(part.withColumnRenamed(run, "_run"), F.col(run).eqNullSafe(F.col("_run")), "left").drop("_run")
    return row.select(*key, *(F.coalesce(f"m{c}", F.lit(0.0)).alias(f"c{c}") for c in AXES), F.when(F.col("r").isNull(), 1.0).otherwise(F.greatest("r", F.lit(1e-6))).alias("radius"))


def with_voxels(points: DataFrame, size: float | Column) -> DataFrame:
    """Finite points with their voxel (i, j, k), counted from the least coordinates, and distance to its centre."""
    size = F.lit(size) if isinstance(size, float) else size
    low = points.where(is_valid_point()).agg(*(F.min(c).alias(f"low_{c}") for c in AXES))
    out = points.where(is_valid_point()).crossJoin(F.broadcast(low))
    for name, c in zip("ijk", AXES):
        out = out.withColumn(name, F.floor((F.col(c) - F.col(f"low_{c}")) / size))
    gap = lambda name, c: F.col(c) - F.col(f"low_{c}") - (F.col(name) + 0.5) * size
    d = sum((gap(n, c) * gap(n, c) for n, c in zip("ijk", AXES)), F.lit(0.0))
    return out.withColumn("dist2", d).drop(*(f"low_{c}" for c in AXES))


def voxel_representatives(points: DataFrame, size: float | Column, index: str = "point_id") -> DataFrame:
    """The point nearest to each occupied voxel's centre, of equals the one of the smallest index."""
    rows = with_voxels(points, size)
    best = rows.groupBy("i", "j", "k").agg(F.min_by(F.struct(*points.columns), F.struct("dist2", index)).alias("p"), F.count("*").alias("n_in_voxel"))
    return best.select("p.*", "i", "j", "k", "n_in_voxel")


def voxel_counts(points: DataFrame, sizes: list[float]) -> dict[float, int]:
    """Occupied voxels for each edge length, all lengths in one job."""
    low = points.agg(*(F.min(c).alias(f"low_{c}") for c in AXES))
    cells = points.crossJoin(F.broadcast(low)).withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    keys = [F.floor((F.col(c) - F.col(f"low_{c}")) / F.col("size")) for c in AXES]
    found = cells.select("size", *(k.alias(n) for k, n in zip(keys, "ijk"))).distinct().groupBy("size").count()
    return {r["size"]: r["count"] for r in found.collect()}


#: Size of the sketches of occupied voxels, and the share by which a count may be off before it is counted: six deviations.
SKETCH_LOG2, DOUBT = 16, 0.025


def voxel_estimates(points: DataFrame, sizes: list[float]) -> dict[float, float]:
    """About how many voxels are occupied for each edge length: one pass, a sketch a length a task, no row dealt anew."""
    low = points.agg(*(F.min(c).alias(f"low_{c}") for c in AXES))
    cell = lambda s: F.xxhash64(*(F.floor((F.col(c) - F.col(f"low_{c}")) / s) for c in AXES))
    row = points.crossJoin(F.broadcast(low)).agg(*(F.hll_sketch_estimate(F.hll_sketch_agg(cell(s), F.lit(SKETCH_LOG2))).alias(f"s{i}") for i, s in enumerate(sizes))).first()
    return {s: float(row[f"s{i}"] or 0) for i, s in enumerate(sizes)}


def find_voxel_size(points: DataFrame, target: int, rounds: int = 4, probes: int = 16) -> float | None:
    """An edge length whose occupied voxels come close to ``target`` from below.

    None if the cloud has no more points than that; 0.0 if all points coincide. Each round tries a geometric grid of
    lengths and goes on between the two that hold the target. Sketches tell lengths that are clearly too short or
    long enough; only those near the target are counted, of which each task sends little more than ``target`` cells.
    """
    points = points.where(is_valid_point())
    box = points.agg(F.count("*"), *(F.max(c) - F.min(c) for c in AXES)).first()
    n, spans = box[0], box[1:]
    if n <= target:
        return None
    diagonal = sum(s * s for s in spans) ** 0.5
    if diagonal == 0:
        return 0.0
    guess = diagonal / target ** (1 / 3)
    low, high, best = guess / 1000, guess * 1000, diagonal * 2
    for _ in range(rounds):
        sizes = [low * (high / low) ** (i / (probes - 1)) for i in range(probes)]
        about = voxel_estimates(points, sizes)
        near = [s for s in sizes if abs(about[s] - target) <= DOUBT * target + 2]
        counts = about | (voxel_counts(points, near) if near else {})
        fits = [s for s in sizes if counts[s] <= target]
        if not fits:
            break
        best = min(fits)
        at = sizes.index(best)
        low, high = sizes[max(0, at - 1)], best
        if counts[best] == target or at == 0:
            break
    return best


def voxel_decimate(points: DataFrame, target: int, index: str = "point_id") -> tuple[DataFrame, float | None]:
    """At most ``target`` points, each an original one, and the edge length used."""
    size = find_voxel_size(points, target)
    valid = points.where(is_valid_point())
    if size is None:
        return valid, None
    if size == 0.0:
        return valid.orderBy(index).limit(1), 0.0
    return voxel_representatives(points, size, index).select(*points.columns), size


def count_label(kept: int, total: int) -> str:
    return f"{kept:,} of {total:,} points"


def disk_offsets(radius: float) -> Column:
    """Array of the (dx, dy) of a disk of pixels."""
    r = max(radius, 0.5)
    span = int(-(-r // 1))
    line = F.sequence(F.lit(-span), F.lit(span))
    grid = F.flatten(F.transform(line, lambda y: F.transform(line, lambda x: F.struct(x.alias("dx"), y.alias("dy")))))
    return F.filter(grid, lambda o: o["dx"] * o["dx"] + o["dy"] * o["dy"] <= r * r + 1e-9)


def shade_by_depth(seen: DataFrame, amount: float = 0.35, view: str | None = None) -> DataFrame:
    """Adds ``shade``, the light left by depth between the exact 2nd and 98th percentile of ``depth`` (of a view)."""
    ends = quantiles(seen, ["depth"], [0.02, 0.98], view).select(*([] if view is None else [view]), F.col("depth").alias("e"))
    near, far = F.get("e", F.lit(0)), F.get("e", F.lit(1))
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("depth") - near) / F.greatest(far - near, F.lit(1e-9))))
    return with_row(seen, ends, view).withColumn("shade", 1 - amount * part).drop("e")


#: Rows that a task gathers before it reduces them to the nearest, and that it holds after that.
MOST_HELD = 1 << 20


def codes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, int]:
    """Numbers from 0 that tell the values of a column apart, and their bound."""
    if pa.types.is_integer(column.type) and not column.null_count:
        v = column.to_numpy()
        low, high = int(v.min()), int(v.max())
        if high - low < 1 << 40:
            return v.astype("i8") - low, high - low + 1
    values = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return values.indices.to_numpy().astype("i8"), len(values.dictionary)


def sort_keys(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Keys for lexsort that order a column as Spark does, null first and NaN last."""
    if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
        return [column.fill_null(0).to_numpy(), *([column.is_valid().to_numpy()] if column.null_count else [])]
    return [pc.rank(column.combine_chunks(), null_placement="at_start", tiebreaker="dense").to_numpy()]


def nearest_rows(table: pa.Table, keys: list[str], index: str) -> pa.Table:
    """Of the rows of equal ``keys`` that of least depth, of equals the one of the smallest index."""
    cell, bound = np.zeros(len(table), "i8"), 1
    for k in keys:
        codes, n = codes_of(table[k])
        if bound * n >= 1 << 62:
            cell = np.unique(cell, return_inverse=True)[1]
            bound = len(table)
        cell, bound = cell * n + codes, bound * n
    order = np.lexsort((*sort_keys(table[index]), *sort_keys(table["depth"]), cell))
    cell = cell[order]
    return table.take(pa.array(order[np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))]))


def nearest_in_tasks(rows: DataFrame, keys: list[str], index: str = "point_id", made: Callable[[pa.RecordBatch], list[pa.RecordBatch]] | None = None, schema: StructType | None = None, most: int = MOST_HELD) -> DataFrame:
    """Those rows that are nearest among the rows of a task: a few for each of ``keys`` instead of all. With ``made`` of the rows, of ``schema``, that it makes of a batch.

    Spark would sort all rows before it aggregates the first of them, as the state of ``min_by`` over structs can't be held in its hash
    table. A task gathers ``most`` rows, reduces them, and passes on what it holds when that is more than ``most`` itself.
    """

    def run(batches):
        held, n, limit = [], 0, most
        for batch in batches:
            for part in made(batch) if made else [batch]:
                held.append(part)
                n += part.num_rows
            if n >= limit:
                found = nearest_rows(pa.Table.from_batches(held), keys, index)
                if len(found) > most:
                    yield from found.to_batches(max_chunksize=1 << 14)
                    found = found.slice(0, 0)
                held, n, limit = found.to_batches(), len(found), len(found) + most
        if n:
            yield from nearest_rows(pa.Table.from_batches(held), keys, index).to_batches(max_chunksize=1 << 14)

    return rows.mapInArrow(run, schema or rows.schema)


def nearest(some: DataFrame, keys: list[str], index: str = "point_id") -> DataFrame:
    """Of the rows of equal ``keys`` the one of least depth, of equals the smallest index."""
    rest = [c for c in some.columns if c not in keys]
    return some.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("depth", index)).alias("s")).select(*keys, "s.*")


def nearest_per_pixel(splats: DataFrame, index: str = "point_id") -> DataFrame:
    """z-buffer: of the splats on a pixel the one of least depth, of equals the smallest index."""
    return nearest(splats, ["px", "py"], index)
