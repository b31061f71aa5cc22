"""Benchmark decontamination by spaced-seed hashing, with DataFrame operations only.

Words are runs of letters and digits, lower-cased; in scripts without spaces each letter is one. A mask picks some of the positions of a short span;
the hash of the picked words is a seed, and words at the other positions may differ. The three masks
together hit every window of ``WINDOW`` words in which at most two words are substituted (all 66
placings were tried). Of a shorter item some run of a few words stays whole, however the words that may differ
are placed; items of under five words are matched exactly. Training seeds are first tested against a bitmap of the benchmark
seeds; the few that pass carry their neighbourhood to the join with the benchmark seeds, which carry theirs, and around
each hit the words are compared position by position: an overlap counts if a window of ``WINDOW``
words (or the whole item, if shorter) agrees in ``share`` of them.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitspark.llm.common import fits, hinted, stash, whole_text

#: Picked positions of the masks, which together find two substitutions in twelve words.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 4, 6, 7), (0, 2, 3, 6, 7, 8))
#: The positions that all three masks pick.
COMMON = (0, 2)
WINDOW, LEAST = 12, 5
#: Least and most bits of a bitmap as powers of two, and by how many it exceeds the number of seeds.
BITMAP_BITS, BITMAP_ROOM = (16, 26), 5
#: Parts that rows of one seed are dealt to where the benchmark's seeds are too many to broadcast.
SALTS = 16
#: Letters of scripts that don't put spaces between words, as ranges: script classes are slow.
UNSPACED = r"([\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3005-\u3007\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}])"


def words_of(text: Column) -> Column:
    """64-bit hashes of the words of a text."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), UNSPACED, " $1 "), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def masks_for(length: int, share: float) -> tuple[tuple[int, ...], ...]:
    """The masks that find an item of this many words; the first picked position is 0, so that a mask fits where words before it are missing.

    Of a short item, a run of words between those that may differ, or if that is under three words, all but those. They
    are tried all along the item, but for items of under ``LEAST`` words, where a mask is all of the item.
    """
    if length >= WINDOW:
        return MASKS
    if length < LEAST:
        return (tuple(range(length)),)
    differ = int((1 - share) * length + 1e-9)
    run = -(-(length - differ) // (differ + 1))
    if run >= 3:
        return (tuple(range(run)),)
    return tuple(dict.fromkeys(tuple(p - c[0] for p in c) for c in combinations(range(length), length - differ)))


def seed(words: Column, at: Column, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(*(F.get(words, at + p if p else at) for p in mask), F.lit(sum(1 << p for p in mask)))


def positions(words: Column, mask: tuple[int, ...]) -> Column:
    last = F.size(words) - mask[-1] - 1
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def bitmap_test(table: DataFrame, column: str, count: int):
    """A test that is true for every value of the column: one bit for each, in a bitmap whose size follows their number."""
    size = min(BITMAP_BITS[1], max(BITMAP_BITS[0], max(1, count).bit_length() + BITMAP_ROOM))
    slot = F.shiftrightunsigned(column, 64 - size)
    bits = table.select(F.shiftright(slot, 6).alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int")).alias("bit"))
    found = {r["cell"]: r["bits"] for r in bits.groupBy("cell").agg(F.bit_or("bit").alias("bits")).collect()}
    bitmap = F.split(F.lit(",".join(str(found.get(i, 0)) for i in range(1 << size - 6))), ",").cast("array<bigint>")

    def test(value: Column) -> Column:
        bit = F.shiftrightunsigned(value, 64 - size).bitwiseAND(F.lit(63).cast("long")).cast("int")
        return F.call_function("getbit", F.get(bitmap, F.shiftrightunsigned(value, 64 - size + 6).cast("int")), bit) == 1

    return test


def around(words: str, at: Column) -> tuple[Column, Column]:
    """How many of the words before a position are taken, and those with the words after it: ``3 * WINDOW`` at most."""
    back = F.least(at, F.lit(WINDOW))
    return back, F.slice(words, at - back + 1, back + 2 * WINDOW)


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", most_bytes: int | None = None
) -> DataFrame:
    """One row for each document and benchmark item that overlap: ids, hits, words that agree in the best window, first word, and how many words both have.

    A window may reach over an end of either text; what lies outside does not agree. An item of under ``LEAST``
    words overlaps where all its words occur in a row. Null text counts as empty and overlaps with nothing. Rows of
    ``docs`` that agree in id and text are one document here. Empty tables give an empty table; other
    columns are ignored. The benchmark's seeds, a neighbourhood each, are broadcast up to ``most_bytes``; beyond,
    both sides are shuffled by seed and salt.
    """
    if share < 1 - 2 / WINDOW - 0.04:
        raise ValueError("the masks find two substitutions in twelve words, no more")
    items = benchmark.select(F.col(item_id).alias("item"), words_of(whole_text(item_text)).alias("b")).where(F.size("b") > 0)
    items = stash(items.dropDuplicates(), "items")
    short = sorted(r[0] for r in items.where(F.size("b") < WINDOW).select(F.size("b")).distinct().collect())

    wanted = []
    for n in [WINDOW, *short]:
        of = items.where(F.size("b") >= WINDOW if n == WINDOW else F.size("b") == n)
        for mask in masks_for(n, share):
            at = of.select("item", "b", F.explode(positions(F.col("b"), mask)).alias("item_at"))
            back, near = around("b", F.col("item_at"))
            wanted.append(at.select(seed(F.col("b"), F.col("item_at"), mask).alias("seed"), "item", F.size("b").alias("n"), "item_at", back.alias("item_back"), near.alias("item_near")))
    seeds = wanted[0]
    for more in wanted[1:]:
        seeds = seeds.unionByName(more)
    seeds = stash(seeds, "seeds")

    in_seeds = bitmap_test(seeds, "seed", seeds.count())
    starts = items.where(F.size("b") >= WINDOW).select("b", F.explode(positions(F.col("b"), COMMON)).alias("at")).select(seed(F.col("b"), F.col("at"), COMMON).alias("seed"))
    in_starts = bitmap_test(starts, "seed", starts.count())

    def passing(at: Column, mask: tuple[int, ...], test) -> Column:
        """Those of the positions whose seed passes the test, as (at, seed)."""
        return F.filter(F.transform(at, lambda i: F.struct(i.alias("at"), seed(F.col("w"), i, mask).alias("seed"))), lambda x: test(x["seed"]))

    def candidates(mask: tuple[int, ...]) -> Column:
        """Positions of a document that may hit, with their seeds and the words around them."""
        at = F.filter("some", lambda i: i < F.size("w") - mask[-1]) if mask in MASKS else positions(F.col("w"), mask)

        def carried(x: Column) -> Column:
            back, near = around("w", x["at"])
            return F.struct(x["at"].alias("at"), x["seed"].alias("seed"), back.alias("back"), near.alias("near"))

        return F.transform(passing(at, mask, in_seeds), carried)

    # The common positions are tested first, so that most positions cost one short hash and not three.
    docs = docs.select(F.col(id_col).alias("doc"), words_of(whole_text(text_col)).alias("w"))
    docs = docs.select("doc", "w", F.transform(passing(positions(F.col("w"), COMMON), COMMON, in_starts), lambda x: x["at"]).alias("some"))
    hits = F.concat(*(candidates(m) for m in dict.fromkeys(m for n in [WINDOW, *short] for m in masks_for(n, share))))
    met = docs.select("doc", F.size("w").alias("doc_words"), F.explode_outer(hits).alias("x")).where("x is not null").select("doc", "doc_words", "x.*")
    if fits(seeds) if most_bytes is None else fits(seeds, most_bytes):
        met = met.join(F.broadcast(seeds), "seed")
    else:
        met = met.withColumn("salt", F.pmod(F.xxhash64("doc", "at"), F.lit(SALTS)))
        met = met.join(seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>"))), ["seed", "salt"])

    # Which words agree along the diagonal of the hit, in all windows that hold it: bits slide along, the most set count.
    lead, length = F.least("back", "item_back"), F.least(F.lit(WINDOW), F.col("n"))
    offsets = F.sequence(F.lit(0), lead + F.lit(2 * WINDOW - 1))
    agree = F.transform(offsets, lambda o: F.coalesce(F.get("near", F.col("back") - lead + o) == F.get("item_near", F.col("item_back") - lead + o), F.lit(False)).cast("long"))
    inside = F.call_function("shiftleft", F.lit(1).cast("long"), length) - 1
    best = F.aggregate(
        agree, F.struct(F.lit(0).cast("long").alias("bits"), F.lit(0).alias("best")),
        lambda s, x: F.struct((F.shiftleft(s["bits"], 1) + x).bitwiseAND(inside).alias("bits"), F.greatest(s["best"], F.bit_count((F.shiftleft(s["bits"], 1) + x).bitwiseAND(inside))).alias("best")),
        lambda s: s["best"],
    )
    met = met.withColumn("best", best).where(F.col("best") >= F.ceil(F.lit(share) * length - F.lit(1e-9)))
    found = met.groupBy("doc", "item").agg(F.count("*").alias("hits"), F.max("best").cast("long").alias("words"), F.min("at").cast("long").alias("first_word"), F.max("n").cast("long").alias("item_words"), F.max("doc_words").cast("long").alias("doc_words"))
    return found.select(F.col("doc").alias(id_col), F.col("item").alias(item_id), "hits", "words", "first_word", "item_words", "doc_words")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without an overlap, all columns as they are.

    An item of under ``LEAST`` words is common speech: it takes out only documents that consist of it.
    """
    mark = docs.select(F.col(id_col).alias("_id"), F.xxhash64(whole_text(text_col)).alias("_h"), F.col(text_col).alias("_t"))
    key = F.struct(F.col("_id").alias("id"), F.col("_h").alias("h"))
    marked = mark.select(key.alias("_key"), "_t")
    bad = find_overlaps(marked, benchmark, id_col="_key", text_col="_t", **options).where((F.col("item_words") >= LEAST) | (F.col("doc_words") <= F.col("item_words")))
    bad = stash(bad.select(F.col("_key.id").alias("_bad"), F.col("_key.h").alias("_badh")).distinct(), "contaminated")
    bad = hinted(bad)
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad"]) & (F.xxhash64(whole_text(docs[text_col])) == bad["_badh"]), "left_anti")
