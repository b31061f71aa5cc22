"""Sharding by histogram sort, with DataFrame operations only.

Rows are ordered by a 64-bit hash of their text and then by id, so equal texts lie together. For
every wanted boundary the driver keeps one range of keys that holds it. Each round counts the exact
bytes and rows below equally spaced probe keys inside all open ranges, over all partitions, and
closes a range when a probe meets the tolerance or when a single key is left. Only then do rows
move: one exchange puts each row into its cell, several cells to a shard, and numbers it there.
A text so common that no boundary between texts is near enough is cut by id.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitspark.llm.common import stash, whole_text

LOW, HIGH = -(1 << 63), (1 << 63) - 1
FIRST_BITS, MOST_BINS = 12, 1 << 18


@dataclass
class Open:
    """A key range that holds a boundary: keys with this prefix at this shift, after ``bytes`` and ``rows`` of others."""

    targets: list = field(default_factory=list)  # (number of the boundary, wanted bytes, tolerance)
    bytes: int = 0
    rows: int = 0


def settle(targets: list, bins: list, before: Open, shift: int, lead: tuple, found: dict, more: dict) -> None:
    """Put each boundary on the edge of a bin if one is near enough, else into the bin that holds it.

    bins: (prefix, bytes, rows, least, greatest key) in order. lead: () for the hash, (hash,) for the id.
    """
    edges_bytes, edges_rows = [before.bytes], [before.rows]
    for _, size, rows, _, _ in bins:
        edges_bytes.append(edges_bytes[-1] + size)
        edges_rows.append(edges_rows[-1] + rows)

    def edge(i: int) -> tuple:
        """The key at the lower edge of bin i, and the bytes and rows below it."""
        if i == len(bins):
            prefix = bins[-1][0] + 1
            key = prefix << shift
            at = lead + (key,) if key <= HIGH else ((lead[0] + 1,) if lead and lead[0] < HIGH else (HIGH, HIGH))
        else:
            at = lead + (bins[i][0] << shift,)
        return (at + (LOW,))[:2], edges_bytes[i], edges_rows[i]

    for number, want, tolerance in targets:
        i = max(1, min(bisect_left(edges_bytes, want), len(bins)))
        low, high = want - edges_bytes[i - 1], edges_bytes[i] - want
        nearest = i - 1 if abs(low) <= abs(high) else i
        prefix, _, rows, least, greatest = bins[i - 1]
        single = least == greatest
        if min(abs(low), abs(high)) <= tolerance or (single and (lead or rows == 1)):
            found[number] = edge(nearest)
        else:
            key = (least,) if single else (prefix,)
            more.setdefault((lead, "id" if single else "key", key[0]), Open(bytes=edges_bytes[i - 1], rows=edges_rows[i - 1])).targets.append((number, want, tolerance))


def histogram(rows: DataFrame, column: str, shift: int, opens: list, old_shift: int | None, by_hash: bool) -> dict:
    """Exact bytes and rows of the bins of ``column`` inside the open ranges (``opens``: lead and prefix)."""
    spark = rows.sparkSession
    if old_shift is not None or by_hash:
        ranges = F.broadcast(spark.createDataFrame([((lead or (0,))[0], prefix) for lead, prefix in opens], "_lead long, _prefix long"))
        near = F.lit(True) if old_shift is None else F.shiftright(column, old_shift) == F.col("_prefix")
        rows = rows.join(ranges, near & (F.col("h") == F.col("_lead") if by_hash else F.lit(True)), "left_semi")
    keys = ([F.col("h").alias("lead")] if by_hash else [F.lit(0).cast("long").alias("lead")]) + [F.shiftright(column, shift).cast("long").alias("bin")]
    out: dict = {}
    for r in rows.groupBy(*keys).agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect():
        out.setdefault(r["lead"], []).append((r["bin"], r["b"], r["n"], r["lo"], r["hi"]))
    return {k: sorted(v) for k, v in out.items()}


def find_splitters(rows: DataFrame, wants: list, total: int) -> list:
    """For each (bytes, tolerance): the boundary key (hash, id), and exact bytes and rows below it.

    A round collects one number a probe, at most ``MOST_BINS`` in all however large the table.
    """
    found: dict = {}
    targets = [(i, want, tolerance) for i, (want, tolerance) in enumerate(wants)]
    jobs = {((), "h", None, 64): {None: Open(targets)}}
    while jobs:
        (level, opens) = jobs.popitem()
        _, column, _, old = level
        by_hash = column == "id"
        bits = FIRST_BITS if old == 64 and not by_hash else max(2, min(FIRST_BITS, (MOST_BINS // max(1, len(opens))).bit_length() - 1))
        shift = max(0, old - bits)
        listed = [((k[0] if by_hash else ()), (k[1] if k else 0)) for k in opens] if opens.keys() != {None} else []
        bins_of = histogram(rows, column, shift, listed, None if old == 64 else old, by_hash)
        nxt: dict = {}
        for k, state in opens.items():
            lead, prefix = k if k else ((), None)
            bins = bins_of.get(lead[0] if by_hash else 0, [])
            if prefix is not None:
                bins = [b for b in bins if b[0] >> (old - shift) == prefix]
            more: dict = {}
            settle(state.targets, bins, state, shift, lead if by_hash else (), found, more)
            for (_, kind, key), o in more.items():
                if kind == "id" and not by_hash:
                    nxt.setdefault(((), "id", None, 64), {})[((key,), None)] = o
                else:
                    nxt.setdefault(((), column, None, shift), {})[(lead, key if kind == "key" else key >> shift)] = o
        for level, opens in nxt.items():
            jobs.setdefault(level, {}).update(opens)
    return [found[i] for i in range(len(wants))]


def histogram_shards(docs: DataFrame, shards: int = 8, tolerance: float = 0.001, rows_a_cell: int = 250_000, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the columns of ``keep``, size, text_crc32, shard and slot; shards hold near equal bytes.

    ``size`` is the text's UTF-8 bytes plus 1; null text has no bytes and goes with the empty ones. Every
    boundary lies within ``tolerance`` of a shard's share of the bytes, or at the nearest edge of a row.
    Rows that agree in id and text can't be told apart and stay together. An empty table gives none.
    Columns of ``docs`` beyond those named are ignored; ``keep`` carries some through the exchange.
    """
    spark = docs.sparkSession
    text = whole_text(text_col)
    keyed = docs.select(
        F.col(id_col).alias("orig"), F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)).alias("id"), F.xxhash64(text).alias("h"),
        (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("crc"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)),
    )
    rows = stash(keyed, "shard-keys")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    cells = max(4, min(512, -(-n // (shards * rows_a_cell))))
    share = total / (shards * cells)
    wants = [(round(j * share), tolerance * share * cells if j % cells == 0 else 0.3 * share) for j in range(1, shards * cells)]
    splitters = sorted(find_splitters(rows, wants, total)) if n else []
    keys = [s[0] for s in splitters]
    below = [0] + [s[2] for s in splitters]

    # First-level bins: the cell of the lower edge, and the boundaries inside. At most 4096 rows and all boundaries.
    shift, table = 64 - FIRST_BITS, []
    inside: dict = {}
    for k in keys:
        inside.setdefault(k[0] >> shift, []).append(k)
    for b in range(-(1 << FIRST_BITS - 1), 1 << FIRST_BITS - 1):
        table.append((b, bisect_left(keys, (b << shift, LOW)), inside.get(b, [])))
    bins = spark.createDataFrame(table, "bin long, base int, cuts array<struct<h:long,id:long>>")
    first = spark.createDataFrame([(c, c // cells, below[c] - below[c // cells * cells]) for c in range(len(below))], "cell int, shard int, first long")
    passed = F.size(F.filter("cuts", lambda s: (s["h"] < F.col("h")) | ((s["h"] == F.col("h")) & (s["id"] <= F.col("id")))))
    placed = rows.withColumn("bin", F.shiftright("h", shift).cast("long")).join(F.broadcast(bins), "bin").withColumn("cell", F.col("base") + passed)
    number = F.row_number().over(Window.partitionBy("cell").orderBy("h", "id"))
    out = placed.withColumn("number", number).join(F.broadcast(first), "cell")
    return out.select(F.col("orig").alias(id_col), *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("first") + F.col("number") - 1).cast("long").alias("slot"))


def op2(docs: DataFrame) -> DataFrame:
    placed = histogram_shards(docs)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
