"""Lines that many documents share, with DataFrame operations only.

Every document is cut into lines, and each line is hashed by its normalised form. The distinct hashes
of a document are exploded and counted, so a count is one of documents; partial sums run before the
exchange. Hashes over the threshold meet only hashes and positions again, never texts: the positions to
drop come back a row a document, and the text is put together from the positions that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitspark.llm.common import Scratch, fits, hinted, join_groups, whole_text

#: White space that is stripped from a line's ends, and the letters that are lower-cased.
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased; where all is ASCII, ``lower`` does just that."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def key_hash(key: Column, min_chars: int) -> Column:
    """128 bits of a key, from two hashes of different seeds; null for a key of fewer than ``min_chars`` code points."""
    return F.when(F.char_length(key) >= min_chars, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b")))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_rows: bool = False) -> DataFrame:
    """Per document: id, n_lines, n_dropped, text (the lines that stay, joined by a line end), and with ``keep_rows`` the whole row as ``row``.

    Lines end at a line feed; a null or empty text is one empty line. Keys of at least ``min_chars`` code points that
    stand in at least ``min_docs`` documents lose all their lines, also the first one and repeats within a document. Each
    row is a document, so a repeated row counts again, and so does one without an id. A document whose lines all go has
    an empty text. An empty table gives an empty table; columns of ``docs`` may have any name.

    A hot line meets no single task: counts are summed before the exchange, and the join with common lines sends those
    that hold more than a thousandth of all lines to every task (under a thousand such lines exist) and shuffles the rest.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select((F.struct("*") if keep_rows else F.struct(id_col, text_col)).alias("row"), F.monotonically_increasing_id().alias("rid"))
    rows = scratch.stash(rows, "rows").withColumn("lines", F.split(whole_text(F.col("row")[text_col]), "\n", -1))
    hashed = F.transform("lines", lambda line, i: F.struct(key_hash(line_key(line), min_chars).alias("hash"), i.alias("at")))
    # Equal lines of a document stand together once sorted; the first of them counts for the document.
    keyed = rows.select("rid", F.array_sort(F.filter(hashed, lambda x: x["hash"].isNotNull())).alias("sorted"))
    marked = F.transform("sorted", lambda x, i: F.struct(x["hash"].alias("hash"), x["at"].alias("at"), ((i == 0) | (F.get("sorted", i - 1)["hash"] != x["hash"])).alias("first")))
    keys = scratch.stash(keyed.select("rid", F.explode(marked).alias("k")).select("rid", "k.*"), "lines")
    common = keys.groupBy("hash").agg(F.count_if("first").alias("in_docs"), F.count("*").alias("n")).where(F.col("in_docs") >= min_docs).select("hash", "n")
    common = scratch.stash(common, "common")
    hits = keys.join(F.broadcast(common), "hash") if fits(common) else join_groups(keys, common, "hash", "n", keys.count(), inner=True)
    dropped = scratch.stash(hits.groupBy("rid").agg(F.collect_list("at").alias("dropped")), "dropped")
    out = rows.join(hinted(dropped), "rid", "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    text = F.when(F.col("dropped").isNull(), whole_text(F.col("row")[text_col])).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    scratch.discard(keys)
    return out.select(
        F.col("row")[id_col].alias(id_col), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), text.alias("text"), *(["row"] if keep_rows else [])
    )


def op13(docs: DataFrame) -> DataFrame:
    """The digests of ``drop_common_lines``: doc_id, n_lines, n_dropped, kept_sha256."""
    return drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
