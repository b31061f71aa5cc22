"""Near-duplicate detection: MinHash signatures and a multi-index Hamming join.

A document's set holds its distinct word shingles. ``k`` MinHash values are cut to ``BITS`` bits each
and packed four to a chunk. Two documents whose sets have Jaccard similarity s differ in about
(1 - s) k symbols; ``k`` is chosen so that a pair at the threshold differs in fewer than two symbols
a chunk on average but with probability ``MISS``. By pigeonhole some chunk of such a pair then
differs in one symbol at most. Each chunk is indexed under its four keys with one symbol left out
(the allowed chunk errors), so every pair within the signature distance shares a key.

Links are confirmed on whole sets. Copies with equal sets are one class. Of the classes that share a
bucket with another, shingles that no other of them holds are counted: they can be in no
intersection, so they bound the similarity of a class to any other, and most classes of a large group
whose edits are their own drop out by that bound. In each bucket every class is compared with the one
of the fewest such shingles, its leader, which for edited copies is their original. Classes of one
leader that are then still in different components share no more than what they have in common with
the leader and the shingles beside it; only pairs that may reach the threshold by that are compared on
whole sets. So no link between components is lost and no group is expanded into all its pairs.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitspark.llm.common import Scratch, hinted, join_groups, whole_text
from orbitspark.llm.components import connected_components
from orbitspark.llm.vocab import ChunkTable, cut_words, slices, trim

U = np.uint64
#: Bytes of text whose sets a task makes at once, and of an Arrow batch.
SLICE, BATCH = 3_000_000, 12_000_000
#: Classes of a leader, and pairs of one class, that meet in one task.
SPLIT = 500
#: Bits of a symbol; four symbols, each with a free bit above it, make a chunk of 60 bits.
BITS, PER_CHUNK, MISS = 14, 4, 1e-5
LANES = sum(((1 << BITS) - 1) << (BITS + 1) * i for i in range(PER_CHUNK))
TOPS = sum(1 << BITS << (BITS + 1) * i for i in range(PER_CHUNK))


def chunks_for(threshold: float) -> int:
    """Fewest chunks for which a pair at the threshold exceeds the allowed distance with probability ``MISS`` at most."""
    for m in range(2, 64):
        k, most = PER_CHUNK * m, 2 * m - 1
        tail = sum(comb(k, d) * (1 - threshold) ** d * threshold ** (k - d) for d in range(most + 1, k + 1))
        if tail <= MISS:
            return m
    raise ValueError("the threshold is too low for this index")


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts."""

    def __init__(self, width: int = 5):
        import xxhash

        self.width = width
        self.odd = [U(2 * x + 1) for x in np.random.default_rng(7).integers(1, 1 << 62, width).tolist()]
        self.table = ChunkTable(lambda words: (np.array([xxhash.xxh64_intdigest(w) for w in words], U), np.ones(len(words), np.int64)), np.uint64, 250_000)

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        cut = cut_words(texts, lower=True)
        h, out, at = self.table.single(cut), [], 0
        for size in cut.counts.tolist():
            x, at = h[at : at + size], at + size
            wide = min(size, self.width)
            if size < 1:
                out.append(np.zeros(0, U))
                continue
            total = np.full(size - wide + 1, U(wide))
            for k in range(wide):
                total += x[k : size - wide + 1 + k] * self.odd[k]
            out.append(np.unique(mixed(total)))
        return out


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Packed chunks of each non-empty set, one row a set."""
    rng = np.random.default_rng(11)
    flat = np.concatenate(sets)
    lens = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(lens) - lens
    out = np.zeros((len(sets), m), U)
    for i in range(m * PER_CHUNK):
        seed, odd = U(int(rng.integers(1, 1 << 63))), U(int(rng.integers(1, 1 << 62)) * 2 + 1)
        least = np.minimum.reduceat((flat ^ seed) * odd, starts)
        symbol = mixed(least) >> U(64 - BITS)
        out[:, i // PER_CHUNK] |= symbol << U((BITS + 1) * (i % PER_CHUNK))
    return out


_SHINGLERS: dict = {}


def shingler(width: int) -> Shingler:
    if width not in _SHINGLERS:
        _SHINGLERS[width] = Shingler(width)
    return _SHINGLERS[width]


def signature_table(docs: DataFrame, m: int, width: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """Per row: rid, id, n (set size), key (of the set), text hash, sig (m chunks; empty for an empty set)."""
    import xxhash

    def run(batches):
        from pyspark import TaskContext

        rid, shingles = TaskContext.get().partitionId() << 33, shingler(width)
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts, SLICE):
                sets = shingles.sets(texts[a:b])
                full = [i for i, s in enumerate(sets) if len(s)]
                sigs: list = [[]] * len(sets)
                if full:
                    for i, row in zip(full, signatures([sets[i] for i in full], m).astype(np.int64).tolist()):
                        sigs[i] = row
                keys = [xxhash.xxh128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(rid, rid + b - a)), batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))],
                    names=["rid", "id", "h", "n", "key", "sig"],
                )
                rid += b - a
        trim()

    text = whole_text(text_col)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    return scratch.stash(plain.mapInArrow(run, "rid long, id long, h long, n long, key binary, sig array<long>"), "signatures", BATCH)


def index_keys(sig: Column, m: int) -> Column:
    """All index keys of a signature: each chunk with each one of its symbols left out."""
    keys = []
    for i in range(m):
        for left_out in range(PER_CHUNK):
            keep = LANES & ~(((1 << BITS + 1) - 1) << (BITS + 1) * left_out)
            keys.append(F.xxhash64(sig[i].bitwiseAND(F.lit(keep)), F.lit(i * PER_CHUNK + left_out)))
    return F.array(*keys)


def distance(a: Column, b: Column, m: int) -> Column:
    """Symbols in which two signatures differ."""
    total = F.lit(0)
    for i in range(m):
        total = total + F.bit_count((a[i].bitwiseXOR(b[i]) + F.lit(LANES)).bitwiseAND(F.lit(TOPS)))
    return total


def without_lone(sets: DataFrame, percent: int) -> DataFrame:
    """Classes (cid, n, m) of which m shingles are held by another one too, without those that m rules out."""
    held = sets.select("cid", F.explode("set").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("cid").alias("cid"))
    lone = held.where("c = 1").groupBy("cid").agg(F.count("*").alias("lone"))
    out = sets.select("cid", F.size("set").cast("long").alias("n")).join(lone, "cid", "left").withColumn("m", F.col("n") - F.coalesce("lone", F.lit(0)))
    return out.where(F.lit(100) * F.col("m") >= F.lit(percent) * F.col("n")).select("cid", "n", "m")


def set_table(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """Whole shingle sets of the wanted classes (cid, id, h), one row a class."""

    def run(batches):
        shingles = shingler(width)
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts, SLICE):
                sets = shingles.sets(texts[a:b])
                ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["cid", "set"])
        trim()

    wanted = scratch.stash(wanted.distinct(), "wanted")
    text = whole_text(text_col)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    w = hinted(wanted).alias("w")
    met = plain.join(w, F.col("w.id").eqNullSafe(plain["id"]) & (F.col("w.h") == plain["h"])).select("w.cid", plain["text"])
    return scratch.stash(met.mapInArrow(run, "cid long, set array<long>").dropDuplicates(["cid"]), "sets", BATCH)


def with_sets(pairs: DataFrame, sets: DataFrame, total: int) -> DataFrame:
    """The pairs (a, b, ...) with the whole sets x of a and y of b. The set of a class in many pairs goes to several tasks."""
    often = pairs.groupBy("a").agg(F.count("*").alias("pairs"))
    salts = F.ceil(F.col("pairs") / SPLIT).cast("long")
    dealt = join_groups(pairs, often, "a", "pairs", total, inner=True).withColumn("salt", F.pmod(F.xxhash64("b"), salts))
    x = sets.join(often, F.col("cid") == F.col("a")).select(F.col("a").alias("_a"), F.col("set").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("_salt"))
    return dealt.join(x, (F.col("a") == F.col("_a")) & (F.col("salt") == F.col("_salt"))).join(sets.select(F.col("cid").alias("b"), F.col("set").alias("y")), "b")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, total: int) -> DataFrame:
    """The pairs (a, b, a_n, b_n) whose whole sets are similar enough."""
    both = F.size(F.array_intersect("x", "y"))
    return with_sets(pairs, sets, total).where(F.lit(100) * both >= F.lit(percent) * (F.col("a_n") + F.col("b_n") - both)).select("a", "b")


def beside_leader(led: DataFrame, sets: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """Per leader and class (a leader, b class): ``inner``, shingles that the leader holds too, and ``outer``, others that a further class of this leader holds.

    Two classes of one leader share no more than the smaller ``inner`` and what their ``outer`` have in common.
    """
    apart = with_sets(led, sets, total).select(F.col("a").alias("leader"), F.col("b").alias("cid"), F.size("y").cast("long").alias("n"), F.array_except("y", "x").alias("e"))
    apart = scratch.stash(apart.withColumn("inner", F.col("n") - F.size("e")), "beside")
    each = apart.select("leader", "cid", F.explode("e").alias("s")).withColumn("held", F.xxhash64("leader", "s"))
    held = each.groupBy("held").agg(F.count("*").alias("c")).where("c > 1")
    shingles = apart.agg(F.sum(F.size("e"))).first()[0] or 0
    outer = join_groups(each, held, "held", "c", shingles, inner=True).groupBy("leader", "cid").agg(F.collect_list("s").alias("outer"))
    return scratch.stash(apart.select("leader", "cid", "inner").join(outer, ["leader", "cid"], "left").withColumn("outer", F.coalesce("outer", F.array().cast("array<long>"))), "outer")


def apart_pairs(apart: DataFrame, may: Column, percent: int, total: int, split: int | None = None) -> DataFrame:
    """Pairs of classes of one leader, of different components, that may be similar.

    What a pair has in common is bounded by what either has in common with the leader and by the shingles
    beside it. A leader of more than ``split`` classes has them cut into blocks; each two blocks meet in a
    task of their own.
    """
    split = split or SPLIT
    crowd = apart.groupBy("leader").agg(F.count("*").alias("size")).where("size > 1")
    rows = join_groups(apart, crowd, "leader", "size", total, inner=True).withColumn("blocks", F.ceil(F.col("size") / split).cast("long")).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))

    def side(k: str) -> DataFrame:
        mine, other = ("i", "j") if k == "a" else ("j", "i")
        columns = (F.col(c).alias(f"{k}_{c}") for c in ("leader", "comp", "n", "m", "sig", "inner", "outer"))
        return rows.select(F.col("cid").alias(k), *columns, F.col("block").alias(f"{k}_{mine}"), every.alias(f"{k}_{other}"))

    same_task = (F.col("a_leader") == F.col("b_leader")) & (F.col("a_i") == F.col("b_i")) & (F.col("a_j") == F.col("b_j"))
    least = F.least("a_inner", "b_inner")
    rough = least + F.least(F.size("a_outer"), F.size("b_outer"))
    close = least + F.size(F.array_intersect("a_outer", "b_outer"))
    reach = [F.lit(100) * shared >= F.lit(percent) * (F.col("a_n") + F.col("b_n") - shared) for shared in (rough, close)]
    return side("a").join(side("b"), same_task & (F.col("a") < F.col("b")) & (F.col("a_comp") != F.col("b_comp")) & reach[0] & may & reach[1]).select("a", "b", "a_n", "b_n").distinct()


def grouped(docs: DataFrame, percent: int, width: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """One row a document: rid, id, h (text hash), n (set size), and of a document with a group its ``first``: smallest id of the component, its row and its text hash."""
    m = chunks_for(percent / 100)
    most = 2 * m - 1
    stash = scratch.stash
    rows = signature_table(docs, m, width, id_col, text_col, scratch)
    total = rows.count()
    in_buckets = total * m * PER_CHUNK
    full = rows.where("n > 0")
    classes = full.groupBy("key").agg(F.min(F.struct("id", "rid")).alias("rep"), F.count("*").alias("copies"))
    classes = full.join(classes.select(F.col("rep.rid").alias("rid"), "copies"), "rid").select(F.col("rid").alias("cid"), "id", "h", "n", "key", "sig", "copies")
    classes = stash(classes, "classes")

    plain = classes.select("cid", "id", "h", "n", "sig")
    entries = classes.select("cid", F.explode(index_keys(F.col("sig"), m)).alias("bucket"))
    crowded = entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = stash(join_groups(entries, crowded, "bucket", "size", in_buckets, inner=True).select("bucket", "cid"), "buckets")
    wanted = shared.select("cid").distinct()
    sets = set_table(docs, plain.join(wanted, "cid").select("cid", "id", "h"), width, id_col, text_col, scratch)
    # A class that is ruled out holds nothing for the others: what is left is counted again.
    able = stash(without_lone(sets, percent), "able")
    for _ in range(2):
        sets = stash(sets.join(hinted(able.select("cid")), "cid", "left_semi"), "sets")
        able = stash(without_lone(sets, percent), "able")
    able = stash(able.join(plain.select("cid", "sig"), "cid"), "able")
    members = shared.join(able.select("cid", (1 - F.col("m") / F.col("n")).alias("own")), "cid")
    leaders = members.groupBy("bucket").agg(F.min_by("cid", F.struct("own", "cid")).alias("leader"), F.count("*").alias("size")).where("size > 1")
    led = join_groups(members, leaders, "bucket", "size", in_buckets, inner=True).where("cid <> leader")
    led = stash(led.select(F.col("leader").alias("a"), F.col("cid").alias("b")).distinct(), "led")

    def side(name: str) -> DataFrame:
        return able.select(F.col("cid").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("n", "m", "sig")))

    # No intersection is larger than what either side shares with others.
    most_shared = F.least("a_m", "b_m")
    may = (F.lit(100) * most_shared >= F.lit(percent) * (F.col("a_n") + F.col("b_n") - most_shared)) & (distance(F.col("a_sig"), F.col("b_sig"), m) <= most)

    often = led.groupBy("a").agg(F.count("*").alias("pairs"))
    leading = join_groups(led, often.join(side("a"), "a"), "a", "pairs", total, inner=True)
    first = stash(leading.join(side("b"), "b").where(may).select("a", "b", "a_n", "b_n"), "pairs")
    links = stash(confirm(first, sets, percent, total), "links")
    comps = stash(connected_components(links, scratch=scratch), "comps")

    # What is still apart: classes that share a bucket, thus its leader, and are of different components.
    placed = led.select(F.col("a").alias("leader"), F.col("b").alias("cid")).join(comps.select(F.col("node").alias("cid"), "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    several = placed.groupBy("leader").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    apart = stash(join_groups(placed, several, "leader", "size", total, inner=True).select("leader", "cid", "comp"), "apart")
    beside = beside_leader(apart.select(F.col("leader").alias("a"), F.col("cid").alias("b")), sets, total, scratch)
    apart = apart.join(beside, ["leader", "cid"]).join(able, "cid").where(F.lit(100) * (F.col("inner") + F.size("outer")) >= F.lit(percent) * F.col("n"))
    second = stash(apart_pairs(stash(apart, "apart"), may, percent, total), "pairs")
    if not second.isEmpty():
        links = links.unionByName(confirm(second, sets, percent, total))
        comps = stash(connected_components(links, scratch=scratch), "comps")

    placed = classes.join(comps.select(F.col("node").alias("cid"), "comp"), "cid", "left")
    placed = placed.where("copies > 1 or comp is not null").select("key", "id", "cid", "h", "copies", F.coalesce("comp", "cid").alias("comp"))
    members_of = placed.groupBy("comp").agg(F.min(F.struct("id", "cid", "h")).alias("first"), F.count("*").alias("members"))
    known = stash(join_groups(placed, members_of, "comp", "members", total, inner=True).select("key", "copies", "first"), "placed")
    scratch.drop(but=[rows, known])
    return join_groups(rows.select("rid", "id", "h", "n", "key"), known, "key", "copies", total).withColumn("first", F.when(F.col("n") > 0, F.col("first")))


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_shingles, component_id, kept.

    Documents are linked if 100 x intersection >= ``percent`` x union of their shingle sets. A document
    without words has an empty set and is linked with nothing; one with fewer words than ``width`` has
    its whole word sequence as its one shingle. Null text counts as empty. Repeated rows of one id are
    copies of each other: all have the same component. ``component_id`` is the smallest id of the
    component. An empty table gives an empty table; other columns are ignored.
    """
    out = grouped(docs, percent, width, id_col, text_col, Scratch(docs.sparkSession))
    component = F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without the near duplicates of a row of smaller id, all columns as they are.

    Of repeated rows that share id and text one stays; documents without words all stay.
    """
    scratch = Scratch(docs.sparkSession)
    rows = grouped(docs, percent, width, id_col, text_col, scratch).where("first is not null and first.cid <> rid")
    again = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))
    gone = scratch.stash(rows.select(F.col("id").alias("_gone"), F.col("h").alias("_hash"), again.alias("_again")).distinct(), "gone")
    scratch.drop(but=[gone])

    def meets(side: DataFrame):
        return docs[id_col].eqNullSafe(side["_gone"]) & (F.xxhash64(whole_text(docs[text_col])) == side["_hash"])

    others, repeated = gone.where("not _again"), gone.where("_again")
    others = hinted(others)
    if repeated.isEmpty():
        return docs.join(others, meets(others), "left_anti")
    repeated = hinted(repeated)
    once = docs.join(repeated, meets(repeated), "left_semi").dropDuplicates([id_col, text_col])
    rest = docs.join(repeated, meets(repeated), "left_anti")
    return rest.join(others, meets(others), "left_anti").unionByName(once)
