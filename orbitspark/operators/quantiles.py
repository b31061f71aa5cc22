"""Exact, interpolated quantiles of the columns of every group, whatever its length.

A wanted order statistic lies in a range of values; first that is the whole column of the group. A round
cuts every open range into bins, counts them, and goes on with those bins that hold a wanted rank, with
their least and greatest value as the new ends. A range of one value is an answer, however often the
value comes; a range of few values is sorted. No group and no column is ever collected: a round is one
aggregation of at most ``BINS`` rows a range, and its state is a row a wanted range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitspark.storage import hinted, written

FEW, BINS = 20_000, 4096
#: Rows up to which all groups are left to Spark's own exact percentile, which keeps the distinct values of a group at once.
AT_ONCE = 200_000


def bin_of(v: Column, lo: Column, hi: Column) -> Column:
    """A bin that never falls as ``v`` rises: even steps, plus powers of two of the distance from ``lo``, plus powers of two of the size below and above zero.

    The last two are for ranges with values of very unlike size. The greatest value is in a bin of its own if it is the
    only one there, and never in that of the least, so each round narrows every range.
    """
    octaves = lambda x: F.greatest(1 + F.log2(x) / 1075, F.lit(0.0))
    part = F.coalesce(F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2), F.lit(0.0))
    beyond = F.when(part > 0, octaves(part)).otherwise(0.0)
    size = F.when(v > 0, 0.5 + octaves(v) / 2).when(v < 0, 0.5 - octaves(-v) / 2).otherwise(0.5)
    return F.when(v == hi, BINS - 1).otherwise(F.floor((part + beyond + F.least(size, F.lit(1.0))) / 3 * (BINS - 1)).cast("int"))


def ranges(sizes: DataFrame, columns: list[str], fractions: list[float]) -> DataFrame:
    """The whole column of each group as a range (g, c, lo, hi, n, below) with its wanted ranks (f, high, k)."""
    at = [F.lit(f) * (F.col("n") - 1) for f in fractions]
    wants = F.array(*(F.struct(F.lit(i).alias("f"), F.lit(high).alias("high"), F.least(F.floor(a) + int(high), F.col("n") - 1).alias("k")) for i, a in enumerate(at) for high in (False, True)))
    each = F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi")) for c in columns))
    return sizes.select("g", "n", each.alias("each"), wants.alias("wants")).select("g", "n", F.explode("each").alias("e"), "wants").select("g", F.col("e.c").alias("c"), F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi"), "n", F.lit(0).cast("long").alias("below"), "wants")


def narrowed(long: DataFrame, open_: DataFrame, rows: int) -> DataFrame:
    """The bins of open ranges that hold a wanted rank, as ranges."""
    held = long.join(hinted(open_.select("g", "c", "lo", "hi"), rows), ["g", "c"]).where(F.col("v").between(F.col("lo"), F.col("hi")))
    bins = held.groupBy("g", "c", F.col("lo").alias("of"), bin_of(F.col("v"), F.col("lo"), F.col("hi")).alias("bin")).agg(F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # A bin a row: at most BINS of a range are ordered in a task.
    before = F.sum("m").over(Window.partitionBy("g", "c", "of").orderBy("bin")) - F.col("m")
    bins = bins.withColumn("before", before).join(open_.select("g", "c", F.col("lo").alias("of"), "below", "wants"), ["g", "c", "of"])
    start = F.col("below") + F.col("before")
    bins = bins.withColumn("_start", start).withColumn("_end", start + F.col("m"))
    held = F.filter("wants", lambda w: (w["k"] >= F.col("_start")) & (w["k"] < F.col("_end")))
    bins = bins.select("g", "c", "lo", "hi", F.col("m").alias("n"), F.col("_start").alias("below"), held.alias("wants"))
    return bins.where(F.size("wants") > 0)


def order_statistics(long: DataFrame, first: DataFrame, few: int) -> DataFrame:
    """Values (g, c, f, high, value) of the wanted ranks of ``long`` (g, c, v)."""
    one = lambda df: df.select("g", "c", F.explode("wants").alias("w"), F.col("lo").alias("value")).select("g", "c", "w.f", "w.high", "value")
    found, small = [], []
    state = first
    while True:
        state = written(state, "ranges")
        single = F.col("lo") == F.col("hi")
        n_single, n_small, n_open = state.agg(F.count_if(single), F.count_if(~single & (F.col("n") <= few)), F.count_if(~single & (F.col("n") > few))).first()
        found += [one(state.where(single))] if n_single else []
        small += [(state.where(~single & (F.col("n") <= few)), n_small)] if n_small else []
        if not n_open:
            break
        state = narrowed(long, state.where(~single & (F.col("n") > few)), n_open)
    for part, rows in small:
        met = long.join(hinted(part.select("g", "c", "lo", "hi"), rows), ["g", "c"]).where(F.col("v").between(F.col("lo"), F.col("hi")))
        values = met.groupBy("g", "c", "lo").agg(F.array_sort(F.collect_list("v")).alias("vs")).join(part.select("g", "c", "lo", "below", "wants"), ["g", "c", "lo"])
        values = values.select("g", "c", "vs", "below", F.explode("wants").alias("w"))
        found.append(values.select("g", "c", "w.f", "w.high", F.get("vs", (F.col("w.k") - F.col("below")).cast("int")).alias("value")))
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def group_quantiles(df: DataFrame, group: str, columns: list[str], fractions: list[float], few: int = FEW, at_once: int = AT_ONCE) -> DataFrame:
    """Per group: for each column an array of its exact quantiles, in the order of ``fractions``. Non-null, finite values only.

    Groups are as many and as long as they come. A null group is a group. Groups without rows have none in the result.
    """
    kind = df.schema[group].dataType
    plain = df.select(F.struct(F.col(group).alias("of")).alias("g"), *(F.col(c).cast("double").alias(c) for c in columns))
    sizes = written(plain.groupBy("g").agg(F.count("*").alias("n"), *(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max)))), "sizes")
    groups, longest = sizes.agg(F.count("*"), F.max("n")).first()
    if not groups:
        return df.sparkSession.createDataFrame([], "g int").select(F.lit(None).cast(kind).alias(group), *(F.lit(None).cast("array<double>").alias(c) for c in columns))
    if longest <= at_once:
        return plain.groupBy("g").agg(*(F.percentile(c, F.array(*map(F.lit, fractions))).alias(c) for c in columns)).select(F.col("g.of").alias(group), *columns)
    long = plain.select("g", F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns))).alias("e")).select("g", "e.c", "e.v")
    values = order_statistics(long, ranges(sizes, columns, fractions), few)
    pick = lambda c, i, high: F.max(F.when((F.col("c") == c) & (F.col("f") == i) & (F.col("high") == high), F.col("value")))
    wide = values.groupBy("g").agg(*(pick(c, i, high).alias(f"{c}_{i}_{int(high)}") for c in columns for i in range(len(fractions)) for high in (False, True)))
    wide = wide.join(hinted(sizes.select("g", "n"), groups), "g")

    def between(c: str, i: int) -> Column:
        at = F.lit(fractions[i]) * (F.col("n") - 1)
        low, high = F.col(f"{c}_{i}_0"), F.col(f"{c}_{i}_1")
        return low + (high - low) * (at - F.floor(at))

    return wide.select(F.col("g.of").alias(group), *(F.array(*(between(c, i) for i in range(len(fractions)))).alias(c) for c in columns))


def quantile_row(df: DataFrame, columns: list[str], fractions: list[float], few: int = FEW, at_once: int = AT_ONCE) -> DataFrame:
    """One row: for each column an array of its exact quantiles, null for a column without values. Non-null, finite values only."""
    out = group_quantiles(df.select(F.lit(0).alias("g"), *columns), "g", columns, fractions, few, at_once).select(*columns)
    return df.sparkSession.range(1).join(out, F.lit(True), "left").select(*columns)
