"""Each operator on small tables against brute force, with nulls, empty and long texts, repeats, ties, and clashing names."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitspark.llm import common, components, decontaminate, exact_dedup, html_text, lattice_lm, near_dedup, packing, quality, sharding, token_counts, token_files, vocab
from orbitspark.llm.queries import QUERIES

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def docs_of(spark, rows, extra=False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(rows, DOC)
    if extra:  # names that operators use inside, in other case and meaning
        df = df.withColumns({c: F.lit(c) for c in ("rid", "id", "h", "n", "digest", "kept", "score", "size", "shard", "bin", "cell", "key", "row", "w", "word", "c", "set", "cid", "sig", "length", "file")})
    return df


def random_text(rng, n):
    return " ".join(rng.choice(WORDS, n)) + "."


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, blanks, copies, repeated rows, a null id, and one very long text."""
    rng = np.random.default_rng(3)
    rows = [(i, random_text(rng, int(rng.integers(1, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n "), (103, rows[5][1]), (104, rows[5][1].replace(" ", "\n")), (105, rows[5][1]), (5, rows[5][1]), (7, rows[7][1]), (None, "no id here at all"), (106, "ÀÉ ñ 日本 <|endoftext|> x")]
    rows += [(107, random_text(rng, 30_000)), (108, "x" * 50_000), (-4, rows[9][1])]
    return rows


@pytest.fixture(scope="module", params=[False, True])
def odd_docs(spark, odd, request):
    return docs_of(spark, odd, request.param)


def empty(spark):
    return spark.createDataFrame([], DOC)


def test_token_counts(spark, odd, odd_docs):
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(odd_docs).collect())
    tok = vocab.load_tokenizer("byte_bpe_50k.json")
    assert got == sorted((str(i), len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in odd)
    assert token_counts.count_tokens(empty(spark)).count() == 0


def test_token_files(spark, odd, odd_docs):
    folder = common.new_path(spark, "files")
    manifest = token_files.write_token_files(odd_docs, folder, max_ids=2000)
    rows = token_files.read_token_files(spark, folder, manifest, with_ids=True).orderBy("start").collect()
    tok = vocab.load_tokenizer("byte_bpe_50k.json")
    want = collections.Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in odd)
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == want
    keys = [-(10**9) if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert keys == sorted(keys) and manifest.count() >= 4
    start = 0
    for r in rows:
        assert r["start"] == start and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    assert token_files.round_trip(empty(spark)).count() == 0


def test_packing(spark, odd, odd_docs):
    rows = packing.pack_documents(odd_docs, with_ids=True, max_len=256).collect()
    tok = vocab.load_tokenizer("word_bpe_49k.json")
    want = collections.Counter(tuple(tok.encode(t or "", add_special_tokens=False).ids + [2]) for _, t in odd)
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows))) and {r["offset"] for r in rows} == {0}
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 256 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    by_length = [r["length"] for r in sorted(rows, key=lambda r: r["sequence_id"])]
    assert by_length == sorted(by_length, reverse=True)
    ids_of = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r["start"]):
        ids_of[(r["doc_id"], r["doc_tokens"])].append(r)
    for (doc, n), pieces in ids_of.items():
        times = sum(p["start"] == 0 for p in pieces)
        assert sum(p["length"] for p in pieces) == n * times
        if times == 1:
            assert want[tuple(i for p in pieces for i in p["ids"])] >= 1
    assert packing.pack_documents(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(odd_docs, max_len=1000)


def shard_laws(rows, shards, texts):
    for s in range(shards):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(shards)]
    share, largest = sum(sizes) / shards, max(r["size"] for r in rows)
    return sizes, share, largest


def test_sharding(spark, odd, odd_docs):
    rows = sharding.histogram_shards(odd_docs, 4).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in odd)
    sizes, share, largest = shard_laws(rows, 4, odd)
    assert max(abs(s - share) for s in sizes) <= 2 * (0.001 * share + largest)
    assert sharding.histogram_shards(empty(spark)).count() == 0
    assert sharding.histogram_shards(docs_of(spark, [(1, "a")]), 8).first()["slot"] == 0


def test_sharding_of_hot_texts(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "hot text " * 5 if i % 3 == 0 else random_text(rng, 20)) for i in range(6000)]
    for tolerance in (0.001, 0.02):
        got = sharding.histogram_shards(docs_of(spark, rows), 8, tolerance).collect()
        assert len(got) == len(rows)
        sizes, share, largest = shard_laws(got, 8, rows)
        assert max(abs(s - share) for s in sizes) <= 2 * (tolerance * share + largest)
    few = {r["shard"] for r in got if r["size"] == 46}
    assert 2 <= len(few) <= 4  # cut no more than its weight asks


def brute_dedup(rows):
    import re

    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    keep, count = {}, collections.Counter(norm)
    for (i, _), t in zip(rows, norm):
        keep[t] = min(keep.get(t, (9, 0)), (0, 0) if i is None else (1, i))
    return sorted((str(i), str(keep[t][1] if keep[t][0] else None), count[t], hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm)), len(count)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, odd, odd_docs, weak):
    digest = {"digest": lambda text: F.substring(F.sha2(text, 256), 1, 1)} if weak else {}
    out = exact_dedup.exact_duplicates(odd_docs, **digest)
    want, groups = brute_dedup(odd)
    rows = out.collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in rows) == want
    assert sum(r["kept"] for r in rows) == groups and all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])


def test_exact_dedup_keeps_rows(spark, odd, odd_docs):
    kept = exact_dedup.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == brute_dedup(odd)[1]
    assert kept.exceptAll(odd_docs).isEmpty()
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0


def test_exact_dedup_of_a_hot_group(spark):
    rows = [(i, "same  text" if i % 3 == 0 else f"text {i}") for i in range(4500)]
    got = exact_dedup.exact_duplicates(docs_of(spark, rows).repartition(6))
    assert got.where("keep_id = 0 and group_size = 1500").count() == 1500 and got.where("kept").count() == 3001


def test_exact_dedup_of_hot_groups_without_a_broadcast(spark, odd, odd_docs, monkeypatch):
    monkeypatch.setattr(common, "LIGHT", 4)
    rows = [*odd, *((10_000 + i, "same  text" if i % 3 == 0 else f"text {i % 50}") for i in range(900))]
    for digest in (lambda text: F.sha2(text, 256), lambda text: F.substring(F.sha2(text, 256), 1, 1)):
        out = exact_dedup.exact_duplicates(docs_of(spark, rows, True).repartition(5), digest, most_bytes=0).collect()
        want, groups = brute_dedup(rows)
        assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in out) == want and sum(r["kept"] for r in out) == groups


def test_exact_dedup_of_later_arrivals(spark, odd):
    """The same store takes a second and a third batch: the state goes on, and earlier rows may lose to later ones of a smaller id."""
    store, seen = common.new_path(spark, "store"), []
    for batch in (odd[10:], odd[:10] + [(-100, odd[20][1]), (5, odd[5][1]), (200, "new")], [], [(201, "new"), (-200, None)]):
        seen += batch
        out = exact_dedup.exact_duplicates(docs_of(spark, batch) if batch else empty(spark), store=store).collect()
        want, groups = brute_dedup(seen)
        assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in out) == want and sum(r["kept"] for r in out) == groups
    assert spark.conf.get(f"{exact_dedup.STORE}.rocksdb.maxMemoryUsageMB", None) is None


def test_join_groups(spark, monkeypatch):
    monkeypatch.setattr(common, "LIGHT", 10)
    rows = spark.createDataFrame([(k % 7 if k % 2 else 100, k) for k in range(400)] + [(None, -1), (999, -2)], "key long, v long")
    groups = rows.where("key is not null and key <> 999").groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("low"))
    want = {r["key"]: (r["n"], r["low"]) for r in groups.collect()}
    got = common.join_groups(rows, groups, "key", "n", 402).collect()
    assert len(got) == 402 and all((r["n"], r["low"]) == want.get(r["key"], (None, None)) for r in got)
    assert common.join_groups(rows, groups, "key", "n", 402, inner=True).count() == 400


def tokens(text):
    import re

    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def brute_overlaps(docs, bench, share=0.8):
    out = set()
    for d, t in docs:
        w = tokens(t)
        for item, b in bench:
            b = tokens(b)
            n = min(12, len(b))
            if not n:
                continue
            need = int(np.ceil(share * n - 1e-9))
            for shift in range(-len(w), len(b)) if len(w) < 5000 else ():
                same = [x == y for x, y in zip(w[max(0, -shift) :], b[max(0, shift) :])]
                if any(sum(same[i : i + n]) >= need for i in range(len(same))):
                    out.add((str(d), item))
    return out


def test_decontamination(spark, odd):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)]
    bench = [(k, " ".join(rng.choice(vocabulary, n))) for k, n in enumerate((40, 13, 12, 9, 6, 3, 25))] + [(8, None), (9, "")]
    docs = list(odd)
    for k in range(120):
        item = bench[k % 7][1].split()
        for _ in range(int(rng.integers(0, 4))):
            item[rng.integers(len(item))] = "other"
        cut = item[rng.integers(0, 3) : len(item) - rng.integers(0, 3)]
        words = [*rng.choice(vocabulary, rng.integers(0, 30)), *(w.upper() if k % 2 else w for w in cut), *rng.choice(vocabulary, rng.integers(0, 30))]
        docs.append((1000 + k, ("  " if k % 3 else ", ").join(words)))
    docs += [(1998, bench[5][1].upper()), (1999, f"before {bench[5][1]} after")]
    table = spark.createDataFrame(bench, "item_id long, text string")
    for extra in (False, True):
        df = docs_of(spark, docs, extra)
        want = brute_overlaps(docs, bench)
        for most_bytes in (None, 0):
            got = {(str(r["doc_id"]), r["item_id"]) for r in decontaminate.find_overlaps(df, table, most_bytes=most_bytes).collect()}
            assert got == want and len(want) > 40
        sizes = {k: len(tokens(t)) for k, t in bench}
        removed = {d for d, k in want if sizes[k] >= 5} | {str(i) for i, t in docs for _, b in bench if tokens(t) and tokens(t) == tokens(b)}
        assert removed < {d for d, _ in want}
        clean = decontaminate.keep_clean(df, table)
        assert clean.columns == df.columns and sorted(str(r["doc_id"]) for r in clean.select("doc_id").collect()) == sorted(str(i) for i, _ in docs if str(i) not in removed)
    assert decontaminate.find_overlaps(empty(spark), table).count() == 0
    assert decontaminate.find_overlaps(df, table.limit(0)).count() == 0


def test_decontamination_of_scripts_without_spaces(spark):
    bench = [(1, "昨日の夕方に公園を散歩していました"), (2, "วันนี้อากาศดีมาก"), (3, "我们在北京大学图书馆学习数学。")]
    docs = [("a", "Intro. その人は昨日の夕方に公園を散歩していましたと言う。"), ("b", "เขาบอกว่าวันนี้อากาศดีมากจริง"), ("c", "去年我们在上海大学图书馆学习数学和物理"), ("d", "天気がよければ、東京へ行きたい"), ("e", "plain words of another text")]
    found = decontaminate.find_overlaps(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(bench, "item_id int, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {("a", 1), ("b", 2), ("c", 3)}


def test_decontamination_of_every_length_and_substitution(spark):
    """All substitutions and cuts at both ends of a document that leave 0.8 of an item of 1 to 12 words, and one more."""
    from itertools import combinations

    bench = [(n, " ".join(f"i{n}x{j}" for j in range(n))) for n in range(1, 13)]
    docs, around = [], " ".join(f"f{j}" for j in range(15))
    for n, text in bench:
        most = n - int(np.ceil(0.8 * n - 1e-9))
        for changed in (c for k in range(min(n, most + 2)) for c in combinations(range(n), k)):
            words = [f"other{j}" if j in changed else w for j, w in enumerate(text.split())]
            docs.append((f"{n} within {changed}", f"{around} {' '.join(words)} {around}"))
            first, last = next(j for j in range(n) if j not in changed), max(j for j in range(n) if j not in changed) + 1
            docs.append((f"{n} start {changed}", " ".join(words[first:]) + " " + around))
            docs.append((f"{n} end {changed}", around + " " + " ".join(words[:last])))
            docs.append((f"{n} alone {changed}", " ".join(words[first:last])))
    want = {(d, int(d.split()[0])) for d, _ in docs if d.count(",") - d.count(",)") + (d[-2] != "(") <= int(d.split()[0]) - int(np.ceil(0.8 * int(d.split()[0]) - 1e-9))}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_overlaps(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(bench, "item_id int, text string")).collect()}
    assert got == want == brute_overlaps(docs, bench) and len(want) > 700


def test_decontamination_with_a_long_item(spark):
    """An item of 20,000 words takes as many seeds as words, each with a neighbourhood and not with the whole item."""
    rng = np.random.default_rng(8)
    words = [f"v{i}" for i in rng.integers(0, 9000, 20_000)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "three small words")], "item_id int, text string")
    docs = [(k, " ".join(["lead"] * 5 + words[a : a + 12] + ["tail"] * 5)) for k, a in enumerate((0, 7777, 19_988))] + [(9, " ".join(words[100:109])), (10, "Three small words!")]
    got = decontaminate.find_overlaps(docs_of(spark, docs), bench)
    assert sorted((r["doc_id"], r["item_id"], r["words"], r["item_words"]) for r in got.collect()) == [(0, 1, 12, 20_000), (1, 1, 12, 20_000), (2, 1, 12, 20_000), (10, 2, 3, 3)]


def test_decontamination_of_a_hot_passage(spark):
    """One passage in a third of the documents, with the join shuffled and salted."""
    rng = np.random.default_rng(9)
    item = " ".join(f"q{j}" for j in range(30))
    docs = [(k, random_text(rng, 30) + " " + (item if k % 3 == 0 else "")) for k in range(3000)]
    bench = spark.createDataFrame([(1, item)], "item_id int, text string")
    assert {r["doc_id"] for r in decontaminate.find_overlaps(docs_of(spark, docs), bench, most_bytes=0).collect()} == set(range(0, 3000, 3))
    assert decontaminate.keep_clean(docs_of(spark, docs), bench).count() == 2000


def shingles(text):
    w = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows, percent):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and 100 * n >= percent * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    low = {}
    for c, (i, _) in zip(comp, rows):
        low[c] = min(low.get(c, (9, 0)), (0, 0) if i is None else (1, i))
    return [low[c] for c in comp], [len(s) for s in sets]


@pytest.fixture(scope="module")
def near_rows(odd):
    rng = np.random.default_rng(6)
    base = [f"v{i}" for i in rng.integers(0, 5000, 150)]
    rows = list(odd)
    for k in range(90):
        w = list(base)
        for _ in range(int(rng.integers(0, 7))):
            w[rng.integers(len(w))] = f"z{rng.integers(0, 40)}"
        rows.append((2000 + k, " ".join(w[rng.integers(0, 4) :])))
    return rows


def test_near_duplicates(spark, near_rows):
    for extra, percent in ((False, 85), (True, 80)):
        df = docs_of(spark, near_rows, extra)
        low, sizes = brute_components(near_rows, percent)
        want = sorted((str(i), n, str(c[1] if c[0] else None), (i is None and not c[0]) or (i is not None and c == (1, i))) for (i, _), n, c in zip(near_rows, sizes, low))
        got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in near_dedup.near_duplicates(df, percent).collect())
        assert got == want
    kept = near_dedup.keep_one_of_each(df, 80)
    assert kept.columns == df.columns
    groups = collections.Counter(str(c) for c, n in zip(low, sizes) if n)
    assert kept.count() == len(groups) + sum(not n for n in sizes)
    assert near_dedup.near_duplicates(empty(spark)).count() == 0 and near_dedup.keep_one_of_each(empty(spark)).count() == 0


def test_near_duplicates_of_hot_groups(spark, near_rows, monkeypatch):
    """Buckets, leaders and hubs split into several tasks give the same result."""
    monkeypatch.setattr(common, "LIGHT", 4)
    monkeypatch.setattr(near_dedup, "SPLIT", 3)
    low, sizes = brute_components(near_rows, 85)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in near_dedup.near_duplicates(docs_of(spark, near_rows).repartition(4)).collect())
    assert got == sorted((str(i), n, str(c[1] if c[0] else None)) for (i, _), n, c in zip(near_rows, sizes, low))


def test_components_of_a_hub(spark):
    links = spark.range(1, 5000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).unionByName(spark.range(6000, 9000).select(F.col("id").alias("a"), F.lit(9000).cast("long").alias("b")))
    got = components.connected_components(links).groupBy("comp").count().collect()
    assert sorted((r["comp"], r["count"]) for r in got) == [(0, 5000), (6000, 3001)]


def test_components(spark):
    rng = np.random.default_rng(7)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (160, 2))] + [(k, k + 1) for k in range(400, 460)] + [(500, 600 + k) for k in range(50)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["comp"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lattice_scores(spark, odd, odd_docs):
    train = common.bucket_of_id("doc_id") != 1
    got = lattice_lm.score_texts(odd_docs, train, frequent=8).collect()
    words = lambda t: (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    c = collections.Counter()
    for i, t in odd:
        if not held(i):
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(words(t)) + 1, sum(w in c for w in [*words(t), None]), round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), None]), 5)) for i, t in odd)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 and np.isfinite(r["score"]) for r in got)
    assert lattice_lm.score_texts(empty(spark), train).count() == 0
    none = lattice_lm.score_texts(odd_docs, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and np.isfinite(r["score"]) for r in none)


def test_lattice_score_is_the_sum_over_all_segmentations(spark):
    """Two rounds of expectation maximisation and the scores of whole texts, by listing every segmentation of every word."""
    import math

    texts = [(0, "The cat  sat, the mat"), (1, "a catalog of mats"), (2, "THE end"), (3, None), (4, "sat sat\tnaïve"), (5, "zzq unseen"), (6, "the cat sat"), (11, ""), (13, "mats of a cat"), (3, None)]
    words = lambda t: (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    learn = [words(t) for i, t in texts if not held(i)]
    assert 0 < len(learn) < len(texts)
    counts = collections.Counter(w for ws in learn for w in ws)
    pieces, first = lattice_lm.vocabulary_pieces("piece_bpe_32k.model")
    known = set(pieces)

    def segmentations(word):
        if not word:
            yield []
        for k in range(1, len(word) + 1):
            if word[:k] in known:
                for rest in segmentations(word[k:]):
                    yield [word[:k], *rest]

    def normal(weight, end):
        starts, others = (sum(w for p, w in weight.items() if (p[:1] == b" ") == yes) for yes in (True, False))
        return {p: w / (starts if p[:1] == b" " else others + end) for p, w in weight.items()}, end / (others + end)

    prob, end = normal(dict(zip(pieces, first)), float(first.mean()))
    for _ in range(2):
        use = dict.fromkeys(pieces, 0.01)
        for w, c in counts.items():
            found = [(s, math.prod(prob[x] for x in s)) for s in segmentations(b" " + w)]
            for s, q in found:
                for x in s:
                    use[x] += c * q / sum(q for _, q in found)
        prob, end = normal(use, 0.01 + sum(counts.values()))
    ends = (len(learn) + 0.5) / (sum(counts.values()) + len(learn) + 1)
    want = sorted((i, round(sum(math.log10(end * sum(math.prod(prob[x] for x in s) for s in segmentations(b" " + w))) + math.log10(1 - ends) for w in words(t)) + math.log10(ends), 6)) for i, t in texts)
    for frequent in (0, 3, 1000):
        got = lattice_lm.score_texts(docs_of(spark, texts, True).repartition(3), common.bucket_of_id("doc_id") != 1, rounds=2, frequent=frequent)
        assert sorted((r["doc_id"], round(r["score"], 6)) for r in got.collect()) == want


def test_lattice_slices_are_read_few_at_a_time(spark, monkeypatch, tmp_path):
    """Slices are rows of megabytes, and a reader holds a row group: one has a few of them, however many a task writes."""
    import pyarrow.parquet as pq

    rng, written = np.random.default_rng(8), {}
    texts = [(i, " ".join(map(str, rng.integers(0, 3000, 6000)))) for i in range(40)]
    monkeypatch.setattr(lattice_lm, "SLICE", 10_000)
    monkeypatch.setattr(lattice_lm, "WIDE_ROWS", getattr(lattice_lm, "WIDE_ROWS", {}) | {"parquet.block.size": 1 << 16}, raising=False)
    monkeypatch.setattr(common, "new_path", lambda spark, name: written.setdefault(name, f"file://{tmp_path}/{name}"))
    monkeypatch.setattr(common.Scratch, "drop", lambda self, but: None)
    assert lattice_lm.score_texts(docs_of(spark, texts).coalesce(1), common.bucket_of_id("doc_id") != 1, rounds=0).count() == 40
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "slices").glob("*.parquet")]
    rows = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(rows) == 40 and max(rows) <= 5


def test_quality(spark, odd_docs):
    docs, labels = (common.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    rows = quality.op10(docs, labels).join(labels, "doc_id").where("held_out").collect()
    y, s = np.array([r["quality"] for r in rows]), np.array([r["score"] for r in rows])
    assert np.mean(s[y == 1][:, None] > s[y == 0][None, :]) > 0.98 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    model = quality.train(docs, labels)
    scored = quality.score_documents(odd_docs, model)
    assert scored.count() == odd_docs.count() and scored.where("score is null or score < 0 or score > 1").isEmpty()
    kept = quality.keep_accepted(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == scored.where("score >= 0.3").count()
    assert quality.score_documents(empty(spark), model).count() == 0
    flat = quality.train(docs, labels.limit(0))
    assert {r[0] for r in quality.score_documents(odd_docs, flat).select("score").distinct().collect()} == {0.5}
    nulls = labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0), (10**9, 1, 1)], "doc_id long, quality int, toxic int"))
    a, b = ({r["doc_id"]: r["score"] >= 0.3 for r in quality.score_documents(docs, quality.train(docs, t)).collect()} for t in (labels, nulls))
    assert sum(a[i] != b[i] for i in a) <= 0.005 * len(a)


def test_quality_score_is_the_logistic_of_the_feature_sum(spark, odd_docs):
    """The values by word, summed in slices, against the feature vector of each whole text."""
    import pyarrow as pa

    docs, labels = (common.table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    texts = [r["text"] or "" for r in docs.limit(50).collect()] + [r["text"] or "" for r in odd_docs.collect()] + ["x"]
    counts = quality.shares(pa.array(texts))
    x = np.array([quality.features(t) for t in texts])
    linear = ((counts[:, :-1] @ model["gram"]) - counts[:, -1] * model["usual"]) / (counts[:, -1] + quality.PRIOR) - model["least"]
    want = 1 / (1 + np.exp(-np.clip(quality.standard(x, model["mean"], model["scale"]) @ model["w"] + linear + model["shift"], -30, 30)))
    assert np.allclose(quality.worths(model, pa.array(texts)), want) and model["gram"].any()


def test_quality_labels_that_repeat_or_contradict(spark):
    docs, labels = (common.table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    rows = [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()]
    extra = spark.createDataFrame([(10**9, 0, 0), (10**9, 1, 0), (None, 1, 0), (rows[0][0], None, 0)] + rows * 2, labels.schema)
    more = docs.unionByName(docs).unionByName(docs.limit(1).withColumn("doc_id", F.lit(10**9).cast("long")))
    a, b = (quality.score_documents(docs, quality.train(d, t)) for d, t in ((docs, labels), (more, extra)))
    a, b = ({r["doc_id"]: r["score"] for r in x.collect()} for x in (a, b))
    assert all(abs(a[i] - b[i]) < 1e-6 for i in a)


def test_quality_learns_from_all_labelled_documents(spark, monkeypatch):
    """No label is left out, each document meets the other class, and the weights are where the loss over all pairs is least."""
    docs, labels = (common.table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    known = labels.where((common.bucket_of_id("doc_id") != 0) & F.col("quality").isNotNull()).join(docs.select("doc_id"), "doc_id")
    tables = []
    monkeypatch.setattr(quality, "BUCKET", 8)
    monkeypatch.setattr(quality, "LEAST", 4)
    real = quality.met_in_buckets
    monkeypatch.setattr(quality, "met_in_buckets", lambda *a: tables.append(real(*a).collect()) or real(*a))
    model = quality.train(docs, labels)
    kinds = [np.frombuffer(r["kinds"], "i1") for r in tables[-1]]
    assert len(kinds) > 1 and sum((y < 2).sum() for y in kinds) == known.count() and all(len(set(y % 2)) == 2 for y in kinds)
    assert model["gram"].any()
    rng = np.random.default_rng(3)
    z, good, w = rng.normal(size=(30, 4)), np.arange(30) < 11, rng.normal(size=4)
    d = (z[good][:, None] - z[~good][None]).reshape(-1, 4)
    p = 1 / (1 + np.exp(d @ w))
    assert np.allclose(quality.pair_sums(z, good, w), [len(d), *(-p @ d), *((d * (p * (1 - p))[:, None]).T @ d).ravel()])


def test_pages(spark):
    rows = [(1, "u", "<article><p>Hello, &lt;b&gt;</article>"), (2, None, None), (3, "v", ""), (1, "u", "<article><p>Hello, &lt;b&gt;</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_pages(df).collect())
    assert got == [(1, "Hello, <b>", 10), (1, "Hello, <b>", 10), (2, "", 0), (3, "", 0)]
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_pages_against_the_article(spark):
    import html
    import re

    for r in QUERIES["op7_tree_scoring"](spark, "/root/testdata/sf0.001").join(common.table(spark, "/root/testdata/sf0.001", "pages").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", b)))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b)
