"""Token counts with a whole-token shortcut.

Offline, on the driver, every vocabulary string is encoded alone; those that come back as their
one token are the proven set (bounded by the vocabulary). In a text, a pre-token of that set
counts one without merging; only the other distinct pre-tokens go through the library's merges.
Counts per chunk of text are kept in a bounded cache per Python worker.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitspark.llm.common import whole_text
from orbitspark.llm.vocab import ChunkTable, WholeTextEncoder, cut_at_spaces, load_tokenizer, per_text, slices

#: Fixed value: the pre-token pattern of the byte-level BPE files.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """Byte for each symbol that byte-level vocabularies print instead of bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def prove_whole_tokens(name: str) -> frozenset[str]:
    """Vocabulary strings whose encoding alone is exactly their own token."""
    tokenizer, symbols = load_tokenizer(name), byte_symbols()
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    texts, ids = [], []
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        if token in special:
            continue
        try:
            texts.append(bytes(symbols[c] for c in token).decode())
            ids.append(i)
        except (KeyError, UnicodeDecodeError):
            continue
    found = tokenizer.encode_batch(texts, add_special_tokens=False)
    return frozenset(t for t, i, e in zip(texts, ids, found) if e.ids == [i])


class TokenCounter:
    def __init__(self, name: str, whole: frozenset[str]):
        import regex

        self.encoder, self.whole = WholeTextEncoder(name), whole
        self.pattern = regex.compile(PRE_TOKEN)
        self.table = ChunkTable(self._fill, np.int64)

    def _fill(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # Letters and digits beyond Latin may differ between Unicode versions: the library cuts those chunks.
        plain = [(c.isascii() or max(c) < "\u0250") and not any(s in c for s in self.encoder.special) for c in chunks]
        parts = [self.pattern.findall(c) if ok else [c] for c, ok in zip(chunks, plain)]
        rest = list({p for ps, ok in zip(parts, plain) for p in ps if not (ok and p in self.whole)})
        marked = [p for p in rest if any(s in p for s in self.encoder.special)]
        count = {p: len(self.encoder.tokenizer.encode(p, add_special_tokens=False).ids) for p in marked}
        rest = [p for p in rest if p not in count]
        count.update(zip(rest, self.encoder.encode_each(rest)[1].tolist()))
        get = count.get
        return np.array([sum([get(p, 1) for p in ps]) for ps in parts], np.int64), np.ones(len(parts), np.int64)

    def counts(self, texts: pa.Array) -> np.ndarray:
        cut = cut_at_spaces(texts, self.encoder.special)
        return per_text(self.table.single(cut), cut.counts)


_COUNTERS: dict = {}


def count_tokens(docs: DataFrame, name: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, UTF-8 bytes and tokens of the whole text, without added special tokens.

    Null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated rows; an empty
    table gives an empty table; other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(prove_whole_tokens(name))

    def run(batches):
        counter = _COUNTERS.get(name)
        if counter is None:
            counter = _COUNTERS[name] = TokenCounter(name, whole.value)
        for batch in batches:
            texts = batch.column(1)
            parts = [counter.counts(texts[a:b]) for a, b in slices(texts)]
            tokens = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    id_type = docs.schema[id_col].dataType.simpleString()
    text = whole_text(text_col)
    plain = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return plain.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
