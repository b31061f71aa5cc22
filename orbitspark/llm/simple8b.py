"""Simple-8b coding of unsigned 64-bit integers, vectorised over blocks.

A word is 64 bits: a selector in the top 4 and up to 60 bits of payload, lowest value first.
Values are cut into blocks of ``BLOCK``; a block starts a new word, and the word number of each
block is kept, so any block decodes alone and all blocks decode at once. A value of more than
60 bits is an escape: a word with selector 0 and then the value as a raw word.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128
#: Values and bits of each selector; 0 is the escape, 15 a run of zeros.
SELECTORS = ((1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60), (BLOCK, 0))
U = np.uint64


def _by_run() -> np.ndarray:
    """Selector for each count of values that fit one word together."""
    best = np.zeros(BLOCK + 1, np.uint8)
    for run in range(1, BLOCK + 1):
        best[run] = next(s for s in range(1, 15) if SELECTORS[s][0] <= run)
    return best


BY_RUN = _by_run()


def bit_lengths(values: np.ndarray) -> np.ndarray:
    if len(values) and values.max() < len(SHORT):
        return SHORT[values]
    return _bit_lengths(values)


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.searchsorted(U(1) << np.arange(64, dtype=U), values, side="right").astype(np.uint8)


SHORT = _bit_lengths(np.arange(1 << 16, dtype=U))


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of ``values``, and the number of words of each block."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    grid = np.zeros(blocks * BLOCK, U)
    grid[:n] = values
    bits = bit_lengths(grid).reshape(blocks, BLOCK)
    # fits[i]: how many values from i on go into one word; a larger count never fits if a smaller doesn't.
    fits = np.zeros((blocks, BLOCK), np.uint8)
    widest = bits.copy()
    for k in range(1, 61):
        if k > 1:
            widest = np.maximum(widest[:, : BLOCK - k + 1], bits[:, k - 1 :]) if k <= BLOCK else widest[:, :0]
        ok = widest <= 60 // k
        if not ok.any():
            break
        fits[:, : BLOCK - k + 1] += ok
    # Near the end of a block a word may hold fewer values than its selector has room for.
    left = np.arange(BLOCK, 0, -1)
    selector = BY_RUN[fits]
    sizes = np.array([c for c, _ in SELECTORS], np.int64)
    zeros = (bits[:, ::-1] == 0).cumprod(axis=1, dtype=np.uint8)[:, ::-1].astype(bool) & (left > 60)[None, :]
    selector[zeros] = 15
    step = sizes[selector]

    # All blocks walk from word to word together; a flag marks each value that starts a word.
    step, begins = step.reshape(-1), np.zeros(blocks * BLOCK, bool)
    at, ends = np.arange(blocks) * BLOCK, np.minimum(np.arange(1, blocks + 1) * BLOCK, n)
    while len(at):
        begins[at] = True
        at = at + step[at]
        more = at < ends
        at, ends = at[more], ends[more]
    starts = np.flatnonzero(begins)
    row = starts // BLOCK
    chosen = selector.reshape(-1)[starts]
    words = chosen.astype(U) << U(60)
    padded = np.concatenate([grid, np.zeros(64, U)])
    block_end = (row + 1) * BLOCK
    for s in np.unique(chosen):
        count, width = SELECTORS[s]
        if s in (0, 15):
            continue
        hit = np.flatnonzero(chosen == s)
        word, first, end = words[hit], starts[hit], block_end[hit]
        for k in range(count):
            value = padded[first + k]
            if k:
                value = np.where(first + k < end, value, U(0))
            word |= value << U(k * width)
        words[hit] = word
    per_block = np.bincount(row, minlength=blocks)
    if len(escaped := np.flatnonzero(chosen == 0)):
        words = np.insert(words, escaped + 1, padded[starts[escaped]])
        per_block += np.bincount(row[escaped], minlength=blocks)
    return words, per_block


def decode(words: np.ndarray, per_block: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of these words; ``per_block`` has the words of each block, all of them whole but the last."""
    selector = (words >> U(60)).astype(np.int64)
    row = np.repeat(np.arange(len(per_block)), per_block)
    raw = np.zeros(len(words), bool)
    follows = -1
    for i in np.flatnonzero(selector == 0):
        if i != follows:  # a raw word may look like an escape itself
            raw[i + 1], follows = True, i + 1
    sizes = np.array([c for c, _ in SELECTORS], np.int64)[selector]
    sizes[raw] = 0
    before = np.cumsum(sizes) - sizes
    first_word = np.cumsum(per_block) - per_block
    starts = before - before[np.minimum(first_word, len(words) - 1)][row] + row * BLOCK if len(words) else before
    ends = np.minimum((row + 1) * BLOCK, n)
    out = np.zeros(len(per_block) * BLOCK, U)
    for s in np.unique(selector[~raw]):
        hit = np.flatnonzero((selector == s) & ~raw)
        count, width = SELECTORS[s]
        if s == 0:
            out[starts[hit]] = words[hit + 1]
        elif s != 15:
            mask = U((1 << width) - 1)
            for k in range(count):
                to = starts[hit] + k
                ok = to < ends[hit]
                out[to[ok]] = (words[hit[ok]] >> U(k * width)) & mask
    return out[:n]
