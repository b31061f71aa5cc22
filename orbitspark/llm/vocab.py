"""Tokenizer files, and values of text chunks through a bounded table in each Python worker.

Texts are cut and their distinct chunks found by Arrow kernels; Python sees each distinct chunk once
a batch. A text is cut only where the library's own pre-tokenizer always cuts, so the ids of the
chunks, one after another, are the ids of the whole text.
"""

from __future__ import annotations

import ctypes
import os
import re
import weakref
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: what any of the libraries takes for white space.
SPACES = "\t\n\v\f\r\x1c-\x1f \u0085\u00a0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A cut of a byte-level BPE text: one space between two characters that are not white space.
CLEAN_SPACE = re.compile(f"(?<=[^{SPACES}]) (?=[^{SPACES}])")
ODD_SPACE = f"[{SPACES}] | [{SPACES}]|^ | $|\\x01"
#: Further cuts: after a letter before one of these marks or a line end, and between a lone line end and a letter.
LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
MARK = "[.,:;!?|$&%*#)]"
#: Stands at the cuts.
AT = "\x01"


@dataclass
class Cut:
    """A batch of texts as distinct chunks, the chunk number of each place, and the places of each text."""

    chunks: list
    codes: np.ndarray
    counts: np.ndarray


def tokenizer_path(name: str) -> str:
    """``name`` as a path if it is one, else the file of that name among the public tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(name: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def lean() -> None:
    """Arrow buffers of this Python worker go back to the system when they are freed."""
    pa.set_memory_pool(pa.system_memory_pool())


def encoded(values: pa.Array, counts: np.ndarray) -> Cut:
    d = values.dictionary_encode()
    return Cut(d.dictionary.to_pylist(), d.indices.to_numpy(), counts)


def cut_at_spaces(texts: pa.Array, whole: list[str]) -> Cut:
    """Chunks of byte-level BPE texts, each with the space before it. Texts with one of the strings ``whole`` are one chunk."""
    marked = pc.replace_substring_regex(texts, f"({LETTER})({MARK}|\\n)", f"\\1{AT}\\2")
    marked = pc.replace_substring_regex(marked, f"([^{SPACES}{AT}])\\n({LETTER})", f"\\1\n{AT}\\2")
    lists = pc.split_pattern(pc.replace_substring(marked, " ", AT + " "), AT)
    odd = pc.match_substring_regex(texts, "|".join([ODD_SPACE, *map(re.escape, whole)]))
    if rows := np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
        own = []
        for i in rows:
            text = texts[i].as_py()
            one = AT in text or any(s in text for s in whole)
            own.append([text] if one else [" " + p if k else p for k, p in enumerate(CLEAN_SPACE.split(text))])
        index = np.arange(len(texts))
        index[rows] = len(texts) + np.arange(len(rows))
        lists = pa.concat_arrays([lists, pa.array(own, lists.type)]).take(pa.array(index))
    return encoded(lists.flatten(), np.diff(lists.offsets.to_numpy()).astype(np.int64))


def cut_lower_words(texts: pa.Array) -> Cut:
    """Chunks of lower-casing BPE texts that drop white space: words, and the marks after them."""
    return cut_words(pc.replace_substring_regex(pc.ascii_lower(texts), f"({LETTER})({MARK})", "\\1 \\2"))


def cut_words(texts: pa.Array, lower: bool = False) -> Cut:
    """Words between ASCII white space, as bytes; with ``lower``, A-Z lower-cased."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    values, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(values), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))]).astype(np.int64)
    offsets = before[offsets - offsets[0]]
    return encoded(values.filter(full).cast(pa.binary()), np.diff(offsets))


def slices(texts: pa.Array, most: int = 6_000_000):
    """Ranges of a batch with about ``most`` bytes each, one text at least."""
    lean()
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    edges = np.flatnonzero(np.diff(group, prepend=-1))
    yield from zip(edges.tolist(), [*edges[1:].tolist(), len(sizes)])


def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the values of each text (rows, if there are columns), given how many values each has."""
    sums = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of each range, one range after another."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)


_TABLES: weakref.WeakSet = weakref.WeakSet()


def trim() -> None:
    """Memory that this Python worker has freed goes back to the system, where the C library can do that."""
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def release(but: ChunkTable | None = None) -> None:
    """Empties the tables that other operators have left in this Python worker."""
    others = [t for t in _TABLES if t is not but and t.slots]
    for table in others:
        table.clear()
    if others:
        trim()


class ChunkTable:
    """Values of chunks, a varying number each, kept for one Python worker and emptied beyond ``limit`` chunks.

    ``fill(chunks)`` gives all values of new chunks in order, and how many each has.
    """

    def __init__(self, fill, dtype, limit: int = 700_000):
        self.fill, self.dtype, self.limit = fill, dtype, limit
        self.clear()
        _TABLES.add(self)

    def clear(self) -> None:
        self.slots: dict = {}
        self.used = 0
        self.lens, self.starts, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, self.dtype)

    def _add(self, chunks: list) -> None:
        values, lens = self.fill(chunks)
        n, k, total = len(self.slots), len(chunks), len(values)
        if n + k > len(self.lens):
            size = max(2 * len(self.lens), n + k)
            self.lens, self.starts = np.resize(self.lens, size), np.resize(self.starts, size)
        if self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, max(2 * len(self.flat), self.used + total))
        self.lens[n : n + k] = lens
        self.starts[n : n + k] = self.used + np.cumsum(lens) - lens
        self.flat[self.used : self.used + total] = values
        self.slots.update(zip(chunks, range(n, n + k)))
        self.used += total

    def slots_of(self, chunks: list) -> np.ndarray:
        release(but=self)
        if len(self.slots) > self.limit:
            self.clear()
        get = self.slots.get
        at = np.fromiter((get(c, -1) for c in chunks), np.int64, len(chunks))
        if len(new := np.flatnonzero(at < 0)):
            at[new] = len(self.slots) + np.arange(len(new))
            self._add([chunks[i] for i in new])
        return at

    def single(self, cut: Cut) -> np.ndarray:
        """The value of each place, where every chunk has one value."""
        slots = self.slots_of(cut.chunks)
        return self.flat[self.starts[slots]][cut.codes]

    def lookup(self, cut: Cut) -> tuple[np.ndarray, np.ndarray]:
        """All values of the batch in order, and how many each text has."""
        slots = self.slots_of(cut.chunks)[cut.codes]
        lens = self.lens[slots]
        return self.flat[spread(self.starts[slots], lens)], per_text(lens, cut.counts)


class WholeTextEncoder:
    """Ids of whole texts, the same as the library gives, for byte-level BPE and word-end BPE files."""

    def __init__(self, name: str, limit: int = 700_000):
        self.tokenizer = load_tokenizer(name)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special, (self.between, self.between_id) = list(special), max(special.items(), key=lambda x: x[1])
        self.spaced = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None
        self.table = ChunkTable(self._fill, np.uint32, limit)

    def encode_each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks in order, and how many each has.

        Many chunks go to the library as one text with a special token between them, at which it cuts.
        """
        joined = [self.between.join(chunks[i : i + 256]) + self.between for i in range(0, len(chunks), 256)]
        lists = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(lists) if lists else np.zeros(0, np.uint32)
        ends = np.flatnonzero(ids == self.between_id)
        return ids[ids != self.between_id], np.diff(ends, prepend=-1) - 1

    def _fill(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        chunks = keys if self.spaced else [k.decode() for k in keys]
        joined = "".join(chunks)
        marked = [i for i, c in enumerate(chunks) if any(s in c for s in self.special)] if any(s in joined for s in self.special) else []
        if not marked:
            return self.encode_each(chunks)
        plain = sorted(set(range(len(chunks))).difference(marked))
        lists: list = [None] * len(chunks)
        ids, lens = self.encode_each([chunks[i] for i in plain])
        for i, x in zip(plain, np.split(ids, np.cumsum(lens)[:-1])):
            lists[i] = x
        for i in marked:
            lists[i] = np.array(self.tokenizer.encode(chunks[i], add_special_tokens=False).ids, np.uint32)
        return np.concatenate(lists), np.array([len(x) for x in lists], np.int64)

    def cut_plain(self, texts: pa.Array) -> Cut:
        special = pc.match_substring_regex(texts, "|".join(map(re.escape, self.special)))
        return cut_words(texts) if pc.any(special).as_py() else cut_lower_words(texts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the number of ids of each text."""
        return self.table.lookup(cut_at_spaces(texts, self.special) if self.spaced else self.cut_plain(texts))


_ENCODERS: dict = {}


def encoder(name: str) -> WholeTextEncoder:
    """One encoder a Python worker; its table serves all tasks of the worker."""
    if name not in _ENCODERS:
        _ENCODERS[name] = WholeTextEncoder(name)
    return _ENCODERS[name]
