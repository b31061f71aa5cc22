"""Subword lattice likelihood.

The lattice of a word (with a space before it) has an arc for every piece of an existing vocabulary that
occurs in it. The probability of a word is the sum over all segmentations into pieces, by a forward
recursion in log space; that of a text is the product over its words and its end, since no piece crosses
words. So the log10 score of a text is the marginal over all segmentations of all of it. The lattice of
each distinct word of the corpus runs once; its value then goes to the slices of texts that hold the word.

The vocabulary's own scores are the ranks of its pieces. Zipf's law makes first weights of them, and rounds
of expectation maximisation over all segmentations of all training words refit these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitspark.llm.common import WIDE_ROWS, Scratch, bucket_of_id, whole_text
from orbitspark.llm.vocab import cut_words, lean, per_text, slices, tokenizer_path

U = np.uint64
#: An odd multiplier for rolling hashes, one for table slots, and table sizes in bits.
BASE, SPREAD, TABLES = U(0x9E3779B97F4A7C15 | 1), U(0xD6E8FEB86659FD93), (18, 16, 16, 16)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words longer than this (in bytes, with the space) run alone, ``BLOCK`` positions at a time, the others in groups of equal length.
LONG, BLOCK = 48, 4096
#: Bytes of text in a slice, and of an Arrow batch.
SLICE, BATCH = 8_000_000, 16_000_000


def vocabulary_pieces(name: str) -> tuple[list[bytes], np.ndarray]:
    """Byte strings of a sentencepiece vocabulary and their first weights: all 256 bytes, and the pieces that lower-cased words can use.

    The n-th piece weighs 1 / n, a byte that is no piece as much as the last one.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
    rank = {bytes([b]): model.get_piece_size() for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in piece[1:] and piece == piece.translate(LOWER):
            rank[piece] = min(rank.get(piece, i), int(max(1.0, -model.get_score(i))))
    pieces = sorted(rank)
    return pieces, np.array([1.0 / rank[p] for p in pieces])


class Lattice:
    """Forward and backward recursions over the pieces; the last score is the end of word."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        self.log_p = np.append(log_p[:-1], -np.inf)  # the last slot: no such piece
        self.end = float(log_p[-1])
        self.none = len(pieces)
        self.widest = max(map(len, pieces))
        self.power = np.ones(self.widest + 1, U)
        np.multiply.accumulate(np.full(self.widest, BASE), out=self.power[1:])
        hashes = np.array([self._hash(p) for p in pieces], U)
        if len(set(hashes.tolist())) != len(pieces):
            raise ValueError("two pieces have the same hash")
        self.tables, left = [], np.arange(len(pieces))
        for k, bits in enumerate(TABLES):
            keys, ids = np.zeros(1 << bits, U), np.full(1 << bits, self.none, np.int32)
            slot = self._slot(hashes[left], k, bits)
            _, first = np.unique(slot, return_index=True)
            keys[slot[first]], ids[slot[first]] = hashes[left[first]], left[first]
            self.tables.append((bits, keys, ids))
            left = np.delete(left, first)
        if len(left):
            raise ValueError("the piece tables are full")

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def _slot(h: np.ndarray, k: int, bits: int) -> np.ndarray:
        return ((h * SPREAD) << U(k)) >> U(64 - bits)

    def ids(self, h: np.ndarray) -> np.ndarray:
        out = np.full(h.shape, self.none, np.int32)
        for k, (bits, keys, ids) in enumerate(self.tables):
            slot = self._slot(h, k, bits)
            out = np.where((keys[slot] == h) & (out == self.none), ids[slot], out)
        return out

    def _spans(self, prefix: np.ndarray, end: int) -> np.ndarray:
        """Piece ids of the spans that end at ``end``, shortest first; one row a span length."""
        lens = np.arange(1, min(end, self.widest) + 1)
        h = prefix[end][None, :] - prefix[end - lens] * self.power[lens][:, None]
        return self.ids(h)

    def groups(self, words: list[bytes]):
        """Indexes and byte matrix of the words of each length, in bounded groups."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lens, kind="stable")
        for n in np.unique(lens):
            same = order[np.searchsorted(lens[order], n) : np.searchsorted(lens[order], n, side="right")]
            step = max(1, 200_000 // int(n))
            for a in range(0, len(same), step):
                at = same[a : a + step]
                yield at, np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(len(at), n).T

    def forward(self, chars: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Log forward sums (position by word), and the piece ids of the spans that end at each position."""
        n, m = chars.shape
        prefix = np.zeros((n + 1, m), U)
        for i in range(n):
            prefix[i + 1] = prefix[i] * BASE + chars[i] + U(1)
        alpha, spans = np.zeros((n + 1, m)), [np.zeros((0, m), np.int32)]
        for end in range(1, n + 1):
            ids = self._spans(prefix, end)
            spans.append(ids)
            x = alpha[end - 1 :: -1][: len(ids)] + self.log_p[ids]
            top = x.max(axis=0)
            alpha[end] = top + np.log(np.exp(x - top).sum(axis=0))
        return alpha, spans

    def _long_blocks(self, word: bytes):
        """For each block of positions of one long word: its first position and the piece ids that end in it, one row a span length."""
        n = len(word)
        prefix = np.zeros(n + 1, U)
        h, base = 0, int(BASE)
        for i, c in enumerate(word):
            h = (h * base + c + 1) & 0xFFFFFFFFFFFFFFFF
            prefix[i + 1] = h
        lens = np.arange(1, self.widest + 1)[:, None]

        def block(a: int) -> np.ndarray:
            ends = np.arange(a + 1, min(a + BLOCK, n) + 1)[None, :]
            begins = np.maximum(ends - lens, 0)
            return np.where(ends >= lens, self.ids(prefix[ends] - prefix[begins] * self.power[lens]), self.none)

        return range(0, n, BLOCK), block

    def _long_forward(self, word: bytes) -> np.ndarray:
        starts, block = self._long_blocks(word)
        alpha = np.zeros(len(word) + 1)
        for a in starts:
            score = self.log_p[block(a)]
            for j in range(score.shape[1]):
                end = a + j + 1
                k = min(end, self.widest)
                x = alpha[end - k : end][::-1] + score[:k, j]
                top = x.max()
                alpha[end] = top + np.log(np.exp(x - top).sum())
        return alpha

    def _long_counts(self, word: bytes) -> np.ndarray:
        starts, block = self._long_blocks(word)
        alpha, n = self._long_forward(word), len(word)
        beta, total = np.full(n + 1, -np.inf), np.zeros(self.none + 1)
        beta[n] = 0.0
        for a in reversed(starts):
            ids = block(a)
            score, mass = self.log_p[ids], np.zeros(ids.shape)
            for j in range(ids.shape[1] - 1, -1, -1):
                end = a + j + 1
                k = min(end, self.widest)
                x = score[:k, j] + beta[end]
                mass[:k, j] = np.exp(x + alpha[end - k : end][::-1] - alpha[n])
                beta[end - k : end] = np.logaddexp(beta[end - k : end], x[::-1])
            total += np.bincount(ids.ravel(), mass.ravel(), minlength=self.none + 1)
        return total

    def log_marginals(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the marginal probability of each word and its end, over all segmentations into pieces."""
        out = np.zeros(len(words))
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for i in set(range(len(words))).difference(short):
            out[i] = self._long_forward(words[i])[-1]
        index = np.array(short, np.int64)
        for at, chars in self.groups([words[i] for i in short]):
            out[index[at]] = self.forward(chars)[0][-1]
        return out + self.end

    def expected_counts(self, words: list[bytes], times: np.ndarray | None = None) -> np.ndarray:
        """Expected use of each piece in the words, each taken so many times (once by default)."""
        times = np.ones(len(words)) if times is None else times
        total = np.zeros(self.none + 1)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for i in set(range(len(words))).difference(short):
            total += times[i] * self._long_counts(words[i])
        index = np.array(short, np.int64)
        for at, chars in self.groups([words[i] for i in short]):
            often = times[index[at]]
            alpha, spans = self.forward(chars)
            n = len(chars)
            beta = np.full(alpha.shape, -np.inf)
            beta[n] = 0.0
            for end in range(n, 0, -1):
                ids = spans[end]
                k = len(ids)
                x = self.log_p[ids] + beta[end]
                mass = np.exp(x + alpha[end - 1 :: -1][:k] - alpha[n]) * often
                total += np.bincount(ids.ravel(), mass.ravel(), minlength=self.none + 1)
                beta[end - k : end] = np.logaddexp(beta[end - k : end], x[::-1])
        return total[:-1]


def normal(pieces: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Log scores: pieces that start a word sum to one, and so do those that go on with one, with its end (the last)."""
    starts = np.array([p[:1] == b" " for p in pieces] + [False])
    return np.log(weights / np.where(starts, weights[starts].sum(), weights[~starts].sum()))


def train_pieces(words: DataFrame, vocabulary: str, rounds: int = 3) -> tuple[list[bytes], np.ndarray]:
    """The pieces and their log scores, the end of word last, from all training words (columns ``word`` and ``c``, how often).

    Each round sums expected counts on the executors; the driver gets one number a piece.
    """
    pieces, first = vocabulary_pieces(vocabulary)
    log_p = normal(pieces, np.append(first, first.mean()))
    for _ in range(rounds):
        model = words.sparkSession.sparkContext.broadcast((pieces, log_p))

        def run(batches, model=model):
            lattice = Lattice(*model.value)
            total = np.zeros(len(lattice.log_p))
            for batch in batches:
                times = batch.column(1).to_numpy().astype(float)
                total[:-1] += lattice.expected_counts([b" " + w for w in batch.column(0).to_pylist()], times)
                total[-1] += times.sum()
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["piece", "n"])

        found = words.select("word", "c").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas().sort_values("piece")
        expected = np.full(len(pieces) + 1, 0.01)
        expected[found["piece"].to_numpy(np.int64)] += found["n"].to_numpy()
        log_p = normal(pieces, expected)
    return pieces, log_p


def cut_texts(docs: DataFrame) -> DataFrame:
    """One row a slice of texts (columns id, train, text): its distinct words with their training counts, and of each text the numbers of its words and how often they occur."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33

        def one(values) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))

        for batch in batches:
            texts, train = batch.column(2), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in slices(texts, SLICE):
                cut = cut_words(texts[a:b], lower=True)
                n = max(1, len(cut.chunks))
                trained = np.bincount(cut.codes, np.repeat(train[a:b], cut.counts), minlength=len(cut.chunks)).astype(np.int64)
                pair, times = np.unique(np.repeat(np.arange(b - a), cut.counts) * n + cut.codes, return_counts=True)
                ends = np.searchsorted(pair // n, np.arange(1, b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()), one(batch.column(0).slice(a, b - a)), one(~train[a:b]), one(cut.counts), one(ends.astype(np.int32)),
                        one((pair % n).astype(np.int32)), one(times.astype(np.int32)), one(pa.array(cut.chunks, pa.binary())), one(trained),
                    ],
                    names=["slice", "ids", "held", "counts", "ends", "at", "times", "words", "trained"],
                )
                number += 1

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "train", "text").mapInArrow(run, f"slice long, ids array<{kind}>, held array<boolean>, counts array<long>, ends array<int>, at array<int>, times array<int>, words array<binary>, trained array<long>")


def word_scores(words: DataFrame, pieces: list[bytes], log_p: np.ndarray) -> DataFrame:
    """Adds to each distinct word the log10 of its marginal probability."""
    model = words.sparkSession.sparkContext.broadcast((pieces, log_p))

    def run(batches):
        lattice = Lattice(*model.value)
        for batch in batches:
            by_piece = lattice.log_marginals([b" " + w for w in batch.column(0).to_pylist()]) / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(by_piece)], names=["word", "c", "slices", "by_piece"])

    return words.select("word", "c", "slices").mapInArrow(run, "word binary, c long, slices long, by_piece double")


def most_common(scored: DataFrame, most: int) -> tuple[DataFrame, dict[bytes, tuple[int, float]]]:
    """The words held by the most slices, ``most`` of them at most, and what is known of each.

    The cut is found from a histogram of a few hundred steps.
    """
    step = F.floor(F.log2("slices") * 8).cast("int")
    taken, least = 0, 1 << 30
    for r in scored.where("slices > 1").groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect():
        taken += r["count"]
        if taken > most:
            break
        least = r["s"]
    top = scored.where("slices > 1").where(step >= least)
    rows = top.select("word", "c", "by_piece").toPandas()
    return top.select("word"), {bytes(w): (c, p) for w, c, p in zip(rows["word"], rows["c"], rows["by_piece"])}


def score_texts(docs: DataFrame, train: Column, vocabulary: str = "piece_bpe_32k.model", rounds: int = 3, frequent: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score all ``docs`` with a subword lattice and a smoothed word-unigram base, both learnt from the rows where ``train`` holds.

    Returns id, held_out (``train`` does not hold), n_tokens (words and one end), n_known, train_tokens,
    base_score and score, both log10. ``score`` is the marginal over all segmentations of the text into
    pieces; a text ends after each of its words with the share that ends have of the training tokens.
    Null text counts as empty: one token, the end. Repeated rows are scored again; equal texts have equal
    scores; other columns are ignored. With no training rows no token is known and the pieces keep their first
    weights. An empty table gives an empty table. Words of any length count as a whole.

    A slice sends each of its distinct words once, so no word is more than one row a slice in any shuffle. Values of
    the words that most slices hold, ``frequent`` at most, ride along with the tasks (a fixed bound) instead of being joined.
    """
    scratch = Scratch(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), whole_text(text_col).alias("text"))
    cut = scratch.stash(cut_texts(plain), "slices", BATCH, WIDE_ROWS)
    counts = cut.select(F.explode(F.arrays_zip("words", "trained")).alias("x")).groupBy(F.col("x.words").alias("word")).agg(F.sum("x.trained").alias("c"), F.count("*").alias("slices"))
    counts = scratch.stash(counts, "word-counts")
    seen, distinct = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_texts = cut.agg(F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0))).first()[0]
    train_tokens, distinct = seen + n_texts, distinct + (1 if n_texts else 0)
    end = (n_texts + 0.5) / (train_tokens + 1)
    of_end, of_more = float(np.log10(end)), float(np.log10(1 - end))
    base_end, base_all = float(np.log10(n_texts + 0.5)), float(np.log10(train_tokens + 0.5 * (distinct + 1)))
    known_end = 1 if n_texts else 0

    scored = scratch.stash(word_scores(counts, *train_pieces(counts.where("c > 0"), vocabulary, rounds)), "word-scores")
    top, known_words = most_common(scored, frequent)
    common = docs.sparkSession.sparkContext.broadcast(known_words)
    asked = cut.select(F.col("slice").alias("slice"), F.posexplode("words").alias("pos", "word")).join(F.broadcast(top), "word", "left_anti")
    values = asked.join(scored, "word").select("slice", "pos", "c", "by_piece")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        row = left.combine_chunks()
        flat = {c: row.column(c).chunk(0).flatten() for c in ("ids", "held", "counts", "ends", "at", "times", "words")}
        shared, nothing = common.value, (0.0, 0.0)
        of_word = np.array([shared.get(w, nothing) for w in flat["words"].to_pylist()], float).reshape(-1, 2)
        asked = right.column("pos").to_numpy()
        for k, c in enumerate(("c", "by_piece")):
            of_word[asked, k] = right.column(c).to_numpy()
        of_word = np.column_stack([np.log10(of_word[:, 0] + 0.5), of_word[:, 0] > 0, of_word[:, 1]])
        at, times, counts = flat["at"].to_numpy(), flat["times"].to_numpy(), flat["counts"].to_numpy()
        sums = per_text(of_word[at] * times[:, None], np.diff(flat["ends"].to_numpy(), prepend=0))
        n = counts + 1
        return pa.table(
            {
                "id": flat["ids"], "held_out": flat["held"], "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(np.rint(sums[:, 1]).astype(np.int64) + known_end),
                "base_score": pa.array(sums[:, 0] + base_end - n * base_all), "score": pa.array(sums[:, 2] + counts * of_more + of_end),
            }
        )

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    texts = cut.select(F.col("slice").alias("of"), "ids", "held", "counts", "ends", "at", "times", "words")
    out = scratch.stash(texts.groupBy("of").cogroup(values.groupBy("slice")).applyInArrow(finish, schema), "lattice-scores", BATCH)
    scratch.drop(but=[out])
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op1(docs: DataFrame) -> DataFrame:
    """All documents, learning from those whose crc32 of the id is not 1 modulo 5."""
    return score_texts(docs, bucket_of_id("doc_id") != 1)
