"""Common lines against brute force."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitspark.llm import line_dedup
from orbitspark.llm.common import table
from tests.llm.test_operators import docs_of, empty

SPACE = " \t\n\x0b\f\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, min_docs, min_chars=1):
    """(id, lines, dropped, text) of each row, in the order of the rows."""
    keys = [[line.strip(SPACE).translate(LOWER) for line in (t or "").split("\n")] for _, t in rows]
    seen = collections.Counter(k for ks in keys for k in set(ks) if len(k) >= min_chars)
    out = []
    for (i, t), ks in zip(rows, keys):
        kept = [line for line, k in zip((t or "").split("\n"), ks) if seen[k] < min_docs]
        out.append((i, len(ks), len(ks) - len(kept), "\n".join(kept)))
    return out


def lines_of(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in df.collect()), key=repr)


def odd_rows():
    rng = np.random.default_rng(5)
    lines = ["All rights reserved.", "  all RIGHTS reserved.\t", "Été à la plage", "été à la plage", "", " \t", "unique", "ß", "ONE", "one", " wide ", "\x85"]
    rows = [(i, "\n".join([str(x) for x in rng.choice(lines, int(rng.integers(0, 9)))] + [f"own {i % 40}"])) for i in range(60)]
    return rows + [(None, None), (None, "one\none"), (61, ""), (62, "\n\n"), (63, "ONE"), (63, "ONE"), (64, "one\r\n" * 3), (65, "\n".join(f"line {k % 700}" for k in range(30_000)))]


@pytest.mark.parametrize("extra", [False, True])
@pytest.mark.parametrize("min_docs,min_chars", [(2, 1), (10, 1), (3, 4), (1, 1), (5, 0)])
def test_lines(spark, extra, min_docs, min_chars):
    rows = odd_rows()
    got = lines_of(line_dedup.drop_common_lines(docs_of(spark, rows, extra), min_docs, min_chars))
    assert got == sorted(brute(rows, min_docs, min_chars), key=repr)


def test_hot_line_and_shuffled_join(spark, monkeypatch):
    rows = [(i, f"hot\nrow {i % 900}\nrow {i % 900}") for i in range(4000)]
    want = sorted(brute(rows, 3), key=repr)
    assert lines_of(line_dedup.drop_common_lines(docs_of(spark, rows), 3)) == want
    monkeypatch.setattr(line_dedup, "fits", lambda df: False)
    monkeypatch.setattr(line_dedup, "hinted", lambda df: df)
    assert lines_of(line_dedup.drop_common_lines(docs_of(spark, rows), 3)) == want


def test_rows_travel_whole(spark):
    df = docs_of(spark, [(1, "a\nb"), (2, "a")], extra=True)
    out = line_dedup.drop_common_lines(df, 2, keep_rows=True).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == ["b", ""] and [r["row"]["text"] for r in out] == ["a\nb", "a"] and set(out[0]["row"].asDict()) == set(df.columns)
    assert line_dedup.drop_common_lines(empty(spark)).count() == 0 and line_dedup.op13(empty(spark)).columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


def test_no_python_on_the_way(spark, sf_dir):
    plan = line_dedup.op13(table(spark, sf_dir, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {tuple(r) for r in line_dedup.op13(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()}
    assert got == {(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute(rows, 10)}
    assert any(k for _, _, k, _ in got)
