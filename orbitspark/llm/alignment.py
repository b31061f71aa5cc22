"""Alignment of two tokenizers' tokens on the same bytes, by a transducer over dangling suffixes.

Tokens of both sides are taken in turn from the side that lags. The state is which side leads and the
bytes of its last token that the other side hasn't matched; a step depends on nothing but the state and
the next token, so steps are memoised, and a group closes where nothing is left over. Each step but the
first of a group links the new token with the one that leads.

Texts are cut where both tokenizers always cut, and each distinct piece goes through the transducer once
a worker. Documents keep their links as numbers of the slice's distinct pairs, so the second look, which
needs the counts of the whole corpus, joins a slice's pairs and not each document's.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitspark.llm.common import Scratch, whole_text
from orbitspark.llm.token_counts import byte_symbols
from orbitspark.llm.vocab import LETTER, MARK, ChunkTable, Cut, cut_at_spaces, load_tokenizer, per_text, slices, spread, tokenizer_path

#: What a piece model writes for a space, and for a byte.
SPACE_MARK = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
#: A pair's code: the first side's id above the second's.
SHIFT = 32


class ByteLevel:
    """Ids and bytes of tokens of a byte-level file; strings of special tokens are plain text."""

    def __init__(self, name: str):
        self.tokenizer = load_tokenizer(name)
        self.tokenizer.encode_special_tokens = True
        symbols = byte_symbols()
        self.bytes = {i: bytes(symbols[c] for c in t) if all(c in symbols for c in t) else t.encode() for t, i in self.tokenizer.get_vocab().items()}

    def encode(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]


class PieceModel:
    """Ids and bytes of tokens of a piece model. Its own leading space is left out: chunks bring theirs."""

    def __init__(self, name: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(tokenizer_path(name), "rb") as f:
            model.ParseFromString(f.read())
        model.normalizer_spec.add_dummy_prefix = False
        self.processor = SentencePieceProcessor(model_proto=model.SerializeToString())
        self.bytes = {}
        for i, p in enumerate(model.pieces):
            byte = BYTE_PIECE.fullmatch(p.piece) if p.type == p.BYTE else None
            self.bytes[i] = bytes([int(byte[1], 16)]) if byte else p.piece.replace(SPACE_MARK, " ").encode()
        #: A text may be cut before a space, and between a letter and a mark or line end, if no piece spans such a place.
        spans = re.compile(f"[^{SPACE_MARK}]{SPACE_MARK}|{LETTER}(?:{MARK}|\\n)|\\n{LETTER}")
        self.cuttable = not any(spans.search(p.piece) for p in model.pieces if p.type == p.NORMAL)

    def encode(self, chunks: list[str]) -> list[list[int]]:
        return self.processor.encode(chunks, num_threads=1)


class Transducer:
    """Groups and links of two sides' ids with the same bytes. ``steps`` memoises (state, next id) -> state; state 0 has no residual."""

    def __init__(self, first: dict[int, bytes], second: dict[int, bytes], limit: int = 500_000):
        self.bytes, self.limit = (first, second), limit
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple[int, bytes], int] = {(0, b""): 0}
        self.residuals: list[tuple[int, bytes]] = [(0, b"")]
        self.steps: dict[int, int] = {}

    def step(self, state: int, token: int) -> int:
        """The state after the next token of the side that lags; from state 0 that is the first side."""
        side, residual = self.residuals[state]
        lagging = 0 if state == 0 else 1 - side
        new = self.bytes[lagging][token]
        if len(new) <= len(residual):
            fits, then = residual.startswith(new), (side, residual[len(new) :])
        else:
            fits, then = new.startswith(residual), (lagging, new[len(residual) :])
        if not fits:
            raise ValueError("the two sides differ in their bytes")
        then = then if then[1] else (0, b"")
        if then not in self.states:
            self.states[then] = len(self.residuals)
            self.residuals.append(then)
        return self.states[then]

    def run(self, first: list[int], second: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
        """Ends (in the first, in the second list) of each group, and the code of each link in order."""
        if len(self.steps) > self.limit:
            self.clear()
        steps, residuals = self.steps, self.residuals
        ends, links, state, i, j, lead = [], [], 0, 0, 0, 0
        while i < len(first) or j < len(second):
            own = state == 0 or residuals[state][0] == 1  # the first side's turn
            token = first[i] if own else second[j]
            key = state << 32 | token << 1 | own
            then = steps.get(key)
            if then is None:
                then = steps[key] = self.step(state, token)
            if state:
                links.append(token << SHIFT | lead if own else lead << SHIFT | token)
            if own:
                i += 1
            else:
                j += 1
            if then == 0:
                ends.append((i, j))
            elif state == 0 or residuals[then][0] == (0 if own else 1):
                lead = token
            state = then
        return ends, links


class GroupTable(ChunkTable):
    """Link codes of chunks, with the sizes and the group string of each."""

    def __init__(self, first: str, second: str, limit: int = 400_000):
        self.first, self.second = ByteLevel(first), PieceModel(second)
        self.transducer = Transducer(self.first.bytes, self.second.bytes)
        super().__init__(self._links, np.int64, limit)

    def clear(self) -> None:
        super().clear()
        self.sizes = np.zeros((0, 4), np.int64)
        self.strings: list[bytes] = []

    def _links(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes, lens, sizes = [], [], []
        for i in range(0, len(chunks), 4096):
            part = chunks[i : i + 4096]
            for chunk, a, b in zip(part, self.first.encode(part), self.second.encode(part)):
                raw = chunk.encode()
                if b"".join(map(self.first.bytes.__getitem__, a)) != raw or b"".join(map(self.second.bytes.__getitem__, b)) != raw:
                    sizes.append((0, 0, 0, False))
                    self.strings.append(b"")
                    lens.append(0)
                    continue
                ends, links = self.transducer.run(a, b)
                starts = [(0, 0), *ends[:-1]]
                groups = [f"{','.join(map(str, a[i:k]))}|{','.join(map(str, b[j:m]))}" for (i, j), (k, m) in zip(starts, ends)]
                sizes.append((len(a), len(b), len(ends), True))
                self.strings.append(";".join(groups).encode())
                codes += links
                lens.append(len(links))
        self.sizes = np.concatenate([self.sizes, np.array(sizes, np.int64).reshape(-1, 4)])
        return np.array(codes, np.int64), np.array(lens, np.int64)

    def cut(self, texts: pa.Array) -> Cut:
        """Chunks of texts with a space before each; a text is one chunk where the second side could span a cut."""
        if not self.second.cuttable:
            d = texts.dictionary_encode()
            return Cut([" " + t for t in d.dictionary.to_pylist()], d.indices.to_numpy(), np.ones(len(texts), np.int64))
        cut = cut_at_spaces(texts, [])
        starts = np.cumsum(cut.counts) - cut.counts
        firsts, place = np.unique(cut.codes[starts], return_inverse=True)
        chunks = list(cut.chunks)
        at = dict(zip(chunks, range(len(chunks))))  # a table's chunks are distinct
        with_space = np.zeros(len(firsts), np.int64)
        for k, i in enumerate(firsts.tolist()):
            with_space[k] = at.setdefault(" " + chunks[i], len(chunks))
            if with_space[k] == len(chunks):
                chunks.append(" " + chunks[i])
        codes = cut.codes.astype(np.int64)
        codes[starts] = with_space[place]
        return Cut(chunks, codes, cut.counts)

    def align(self, texts: pa.Array) -> dict:
        """Sizes, group hashes and links of each text, the links as numbers of ``pairs``."""
        # A piece model's mark in a text comes back as a space, so such a text has no tokens; nor has an empty one.
        none = pc.or_(pc.match_substring(texts, SPACE_MARK), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        cut = self.cut(texts)
        slots = self.slots_of(cut.chunks)
        sizes = self.sizes[slots]
        ends = np.cumsum(cut.counts)
        none = none | (per_text(1 - sizes[:, 3][cut.codes], cut.counts) > 0)
        out = {c: np.where(none, 0, per_text(sizes[:, k][cut.codes], cut.counts)) for k, c in enumerate(("n_a", "n_b", "n_groups"))}
        strings = [self.strings[s] for s in slots.tolist()]
        codes = cut.codes.tolist()
        out["groups_sha256"] = [
            "" if skip else hashlib.sha256(b";".join([strings[c] for c in codes[e - n : e]])).hexdigest() for e, n, skip in zip(ends.tolist(), cut.counts.tolist(), none.tolist())
        ]
        # Distinct pairs over the distinct chunks first, then each text's links as numbers of those, summed.
        lens = self.lens[slots]
        pairs, number = np.unique(self.flat[spread(self.starts[slots], lens)], return_inverse=True)
        begin = np.cumsum(lens) - lens
        per_place = lens[cut.codes]
        link = number[spread(begin[cut.codes], per_place)]
        row = np.repeat(np.arange(len(texts)), per_text(per_place, cut.counts))
        link, row = link[~none[row]], row[~none[row]]
        both, times = np.unique(row * max(1, len(pairs)) + link, return_counts=True)
        row, link = both // max(1, len(pairs)), both % max(1, len(pairs))
        used, link = np.unique(link, return_inverse=True)
        out |= {"pairs": pairs[used], "links": np.bincount(link, times, len(used)).astype(np.int64), "row": row, "link": link.astype(np.int32), "times": times.astype(np.int32)}
        return out


_TABLES: dict = {}


def group_table(first: str, second: str) -> GroupTable:
    """One table a Python worker; it serves all tasks of the worker."""
    if (first, second) not in _TABLES:
        _TABLES[first, second] = GroupTable(first, second)
    return _TABLES[first, second]


DOCUMENT = "slice long, id long, n_a long, n_b long, n_groups long, groups_sha256 string, link array<int>, times array<int>"
PAIR = "at int, pair long, links long"


def align_slices(docs: DataFrame, first: str, second: str) -> DataFrame:
    """Rows of two kinds for documents (id, text), by slices of them: a row a document, its links as numbers ``at`` of its slice's pairs; and a row a distinct pair of a slice."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    fields = [(x.split()[0], kinds[x.split()[1]]) for x in f"{DOCUMENT}, {PAIR}".split(", ")]

    def rows(n: int, **columns) -> pa.RecordBatch:
        arrays = [pa.nulls(n, kind) if name not in columns else columns[name].cast(kind) if isinstance(columns[name], pa.Array) else pa.array(columns[name], kind) for name, kind in fields]
        return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])

    def run(batches):
        from pyspark import TaskContext

        table, number = group_table(first, second), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, j in slices(texts):
                found, n, number = table.align(texts[i:j]), j - i, number + 1
                here = lambda k: np.full(k, number)  # noqa: B023, E731
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(found["row"], minlength=n))]), pa.int32())
                lists = {c: pa.ListArray.from_arrays(offsets, pa.array(found[c], pa.int32())) for c in ("link", "times")}
                yield rows(n, slice=here(n), id=ids[i:j], **{c: found[c] for c in ("n_a", "n_b", "n_groups", "groups_sha256")}, **lists)
                k = len(found["pairs"])
                yield rows(k, slice=here(k), at=np.arange(k), pair=found["pairs"], links=found["links"])

    return docs.mapInArrow(run, f"{DOCUMENT}, {PAIR}")


def count_links(documents: pa.Table, pairs: pa.Table) -> pa.Table:
    """Links that are best, and the sum of pair counts over links, of the documents of one slice; ``pairs`` are the slice's (at, total, best)."""
    order = np.argsort(pairs.column("at").to_numpy())
    total, best = pairs.column("total").to_numpy()[order], pairs.column("best").to_numpy()[order].astype(np.int64)
    link, times = (documents.column(c).combine_chunks() for c in ("link", "times"))
    held, link, times = pc.list_value_length(link).to_numpy(), link.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    sums, bests = per_text(total[link] * times, held), per_text(best[link] * times, held)
    n_a, n_b, groups = (documents.column(c) for c in ("n_a", "n_b", "n_groups"))
    columns = [documents.column("id"), n_a, n_b, groups, pc.subtract(pc.add(n_a, n_b), groups), bests, sums, documents.column("groups_sha256")]
    return pa.table(columns, names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align_tokenizers(docs: DataFrame, first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) and the pair table (a, b, links, best).

    The first side encodes a space and the text, the second the text to which it adds its space. Groups end where
    tokens of both sides do; links are all pairs of tokens that share a byte. A pair's ``links`` are those of the whole corpus;
    it is ``best`` if no pair of its second id has more. A null or empty text, and one that a side doesn't give back byte
    for byte, has no tokens: zeros and an empty string. Repeated rows count and come again; ids are whole numbers or null; an empty
    table gives empty tables; other columns are ignored.

    A slice of about six MB of text, or of one longer text, has its documents in one task; its pairs, each once, are summed over all slices and
    joined back, so no exchange depends on how often a document or the corpus has a pair: a pair has a row a slice at most.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    aligned = scratch.stash(align_slices(rows, first, second), "slices", batch_bytes=16 << 20)
    pairs = aligned.where("pair is not null").select("slice", "at", "pair", "links")
    totals = pairs.groupBy("pair").agg(F.sum("links").alias("links")).withColumn("b", F.col("pair").bitwiseAND((1 << SHIFT) - 1))
    totals = scratch.stash(totals, "totals")
    # One row an id of the second vocabulary, whatever the corpus.
    most = totals.groupBy("b").agg(F.max("links").alias("most"))
    known = totals.join(F.broadcast(most), "b").select("pair", F.shiftright("pair", SHIFT).cast("int").alias("a"), F.col("b").cast("int").alias("b"), "links", (F.col("links") == F.col("most")).alias("best"))
    known = scratch.stash(known, "pairs")
    values = pairs.select("slice", "at", "pair").join(known.select("pair", F.col("links").alias("total"), "best"), "pair").select(F.col("slice").alias("of"), "at", "total", "best")
    documents = aligned.where("pair is null").select(*(x.split()[0] for x in DOCUMENT.split(", ")))
    schema = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    out = documents.groupBy("slice").cogroup(values.groupBy("of")).applyInArrow(count_links, schema)
    out = scratch.stash(out.withColumnRenamed("id", id_col), "aligned")
    scratch.drop(but=[out, known])
    return out, known.select("a", "b", "links", "best")
