"""The pipeline's stages on whole small tables: each does its work, and clean documents stay."""

import corpus_pipeline
from orbitspark.llm import common, decontaminate, quality
from tests.llm.test_operators import brute_components, brute_dedup

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "decontaminate", "pack"]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        out = common.stash(stage(spark, docs, SF), name)
        if name == "pack":
            assert {r["doc_id"] for r in out.collect()} == {i for i, _ in before}
            break
        assert out.columns == docs.columns and out.exceptAll(docs).isEmpty()
        after = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "quality":
            scored = quality.score_documents(docs, quality.train(docs, common.table(spark, SF, "labels")))
            assert after == {r["doc_id"] for r in scored.where("score >= 0.3").collect()}
        elif name == "exact_dedup":
            assert len(after) == brute_dedup(before)[1]
        elif name == "near_dedup":
            low, sizes = brute_components(before, 80)
            assert after == {i for (i, _), c, n in zip(before, low, sizes) if c == (1, i) or not n}
        else:
            bad = decontaminate.find_overlaps(docs, common.table(spark, SF, "benchmark"))
            assert after == {i for i, _ in before} - {r["doc_id"] for r in bad.collect()}
        docs = out


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_entry_works_without_the_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for name in ("__spark_entry__.py", "orbitspark"):
        src = os.path.join(root, name)
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(src) else shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


ODD = "doc_id long, text string, lang string, source string, n_chars long"


def odd_tables(spark, folder, docs, labels, benchmark):
    extra = ("rid", "id", "row", "n", "score", "digest", "kept", "first", "seed", "length")
    df = spark.createDataFrame(docs, ODD)
    df.withColumns({c: df["lang"] for c in extra}).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_run_on_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, ties, a very long text, null labels and items, and columns named like those the stages use."""
    base = common.table(spark, SF, "documents").collect()
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in base]
    item = " ".join(f"planted{i} words{i}" for i in range(20))
    docs += [(None, None, None, None, None), (None, base[3]["text"], "en", "s", 1), (10**6, "", "en", "s", 0), (10**6 + 1, " \n\t", None, "s", 3), docs[5], docs[5], (10**6 + 2, (base[0]["text"] + " ") * 300, "en", "s", 1), (10**6 + 3, base[1]["text"] + " " + item, "en", "s", 1)]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in common.table(spark, SF, "labels").collect()] + [(None, 1, 0), (7, None, None), (10**7, 1, None)]
    sf = odd_tables(spark, f"file://{tmp_path}/odd", docs, labels, [(1, item), (2, None), (None, ""), (3, "one")])
    rows = corpus_pipeline.run(spark, sf).collect()
    ids = {r["doc_id"] for r in rows}
    assert rows and 10**6 + 3 not in ids and len({(r["doc_id"], r["start"]) for r in rows if r["doc_id"] is not None}) == sum(r["doc_id"] is not None for r in rows)
    known = {d[0] for d in docs}
    assert ids <= known


def test_run_on_empty_tables(spark, tmp_path):
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in common.table(spark, SF, "documents").collect()]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in common.table(spark, SF, "labels").collect()]
    none = odd_tables(spark, f"file://{tmp_path}/none", docs, labels, [])
    assert corpus_pipeline.run(spark, none).count() > 0
    empty = odd_tables(spark, f"file://{tmp_path}/empty", [], [], [])
    assert corpus_pipeline.run(spark, empty).count() == 0
