"""Alignment of two tokenizers against brute force over byte ranges of whole texts."""

import bisect
import collections
import hashlib

import numpy as np
import pytest

from orbitspark.llm import alignment, vocab
from orbitspark.llm.common import table
from tests.llm.test_operators import docs_of, empty, random_text

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def brute(rows):
    """Per row (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and links of each id pair; from whole texts and byte offsets alone."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers.decoders import ByteLevel

    tok = vocab.load_tokenizer(A)
    tok.encode_special_tokens = True
    sp = SentencePieceProcessor(model_file=vocab.tokenizer_path(B))
    symbols = alignment.byte_symbols()
    assert ByteLevel().decode(["Ġa"]) == " a"

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    found, count = [], collections.Counter()
    for i, text in rows:
        text = text or ""
        a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text, num_threads=1)
        raw = (" " + text).encode()
        ba, bb = [bytes(symbols[c] for c in tok.id_to_token(x)) for x in a], [piece(x) for x in b]
        if not text or b"".join(ba) != raw or b"".join(bb) != raw:
            found.append((i, [], [], [], []))
            continue
        ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        cuts = sorted(set(ea) & set(eb))
        groups, links = [], []
        at = [[bisect.bisect_right(ends, e) for e in [0, *cuts]] for ends in (ea, eb)]
        for g in range(len(cuts)):
            ga, gb = (range(ends[g], ends[g + 1]) for ends in at)
            groups.append(f"{','.join(str(a[k]) for k in ga)}|{','.join(str(b[k]) for k in gb)}")
            links += [(a[x], b[y]) for x in ga for y in gb if max(ea[x] - len(ba[x]), eb[y] - len(bb[y])) < min(ea[x], eb[y])]
        count.update(links)
        found.append((i, a, b, groups, links))
    most = collections.Counter()
    for (x, y), n in count.items():
        most[y] = max(most[y], n)
    out = [(i, len(a), len(b), len(g), len(k), sum(count[p] == most[p[1]] for p in k), sum(count[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, k in found]
    return sorted(out, key=repr), count


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def check(df, rows):
    out, pairs = alignment.align_tokenizers(df)
    assert out.columns == COLUMNS
    want, count = brute(rows)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=repr) == want
    got = pairs.collect()
    assert {(r["a"], r["b"]): r["links"] for r in got} == count
    return want


@pytest.mark.parametrize("extra", [False, True])
def test_odd_texts(spark, extra):
    rng = np.random.default_rng(8)
    rows = [(i, random_text(rng, int(rng.integers(1, 40)))) for i in range(40)]
    rows += [(None, "no id"), (50, None), (51, ""), (52, " "), (53, "  two  spaces  "), (54, "tab\tand\nline\r\nends\n\n"), (55, "<|endoftext|> and <s> </s> <unk>"), (56, "a ▁ mark"), (57, "日本語 テキスト、です。 émigré ñ ﬁ"), (58, "🙂🙃 x🙂"), (59, "\x00\x01 nul"), (60, "<0x41> <0x0A>")]
    rows += [(61, rows[0][1]), (0, rows[0][1]), (62, "x" * 20_000), (63, random_text(rng, 20_000)), (64, "don't we're 12,345.67 $5 (a)b[c]"), (65, "   x 　 y"), (66, "á ë́"), (67, " lead"), (68, "trail ")]
    want = check(docs_of(spark, rows, extra), rows)
    assert sum(r[1] == 0 for r in want) == 3


def test_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    check(docs.repartition(3), rows)


def test_many_slices_of_a_task_and_whole_texts():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    texts = [random_text(rng, 30) for _ in range(50)] + ["", "a  b"]
    one = alignment.GroupTable(A, B)
    whole = one.align(pa.array(texts))
    one.second.cuttable = False
    again = one.align(pa.array(texts))
    assert all(np.array_equal(whole[c], again[c]) for c in ("n_a", "n_b", "n_groups", "groups_sha256", "pairs", "links", "row", "link", "times"))
    parts = [one.align(pa.array(texts[i : i + 7])) for i in range(0, len(texts), 7)]
    assert [x for p in parts for x in p["groups_sha256"]] == whole["groups_sha256"]


def test_transducer_states():
    t = alignment.Transducer({0: b"ab", 1: b"c", 2: b"abc"}, {0: b"a", 1: b"bc", 2: b"abc"})
    assert t.run([0, 1], [0, 1]) == ([(2, 2)], [0 << 32 | 0, 0 << 32 | 1, 1 << 32 | 1])
    assert t.run([2, 2], [2, 0, 1]) == ([(1, 1), (2, 3)], [2 << 32 | 2, 2 << 32 | 0, 2 << 32 | 1])
    steps = dict(t.steps)
    t.run([0, 1, 2], [0, 1, 2])
    assert t.steps == steps  # nothing new to learn
    with pytest.raises(ValueError):
        t.run([0], [1])


def test_empty(spark):
    out, pairs = alignment.align_tokenizers(empty(spark))
    assert out.columns == COLUMNS and out.count() == 0 and pairs.count() == 0
