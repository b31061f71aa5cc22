"""The registered queries of this subpackage: one an operator, each over its whole table."""

from __future__ import annotations

import corpus_pipeline
from orbitspark.llm import alignment, conversations, decontaminate, exact_dedup, html_text, lattice_lm, line_dedup, near_dedup, packing, quality, sharding, token_counts, token_files
from orbitspark.llm.common import table


def op1_lattice_lm(spark, sf_dir):
    return lattice_lm.op1(table(spark, sf_dir, "documents"))


def op2_histogram_shards(spark, sf_dir):
    return sharding.op2(table(spark, sf_dir, "documents"))


def op3_pack_binary(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_stream_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op5_spaced_seeds(spark, sf_dir):
    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simple8b(spark, sf_dir):
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op7_tree_scoring(spark, sf_dir):
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op8_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", counted["n_tokens"] > 1024)


def op10_quality(spark, sf_dir):
    return quality.op10(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_signature_repair(spark, sf_dir):
    return conversations.op11(table(spark, sf_dir, "conversations"))


def op12_suffix_transducer(spark, sf_dir):
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"))[0]


def op13_line_dedup(spark, sf_dir):
    return line_dedup.op13(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_lattice_lm, op2_histogram_shards, op3_pack_binary, op4_stream_dedup, op5_spaced_seeds, op6_simple8b, op7_tree_scoring, op8_minhash_near_dedup, op9_token_counts, op10_quality, op11_signature_repair, op12_suffix_transducer, op13_line_dedup)} | {"pipeline": corpus_pipeline.run}
SPACES = r"[\x20\x09-\x0D]+"
ENDS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The others need a tokenizer, a hash or a fit that SQL does not have; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_stream_dedup": f"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n""",
    "op8_minhash_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER}, '{SPACES}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w),
n AS (SELECT w.doc_id, count(s) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n AS n_shingles, m AS component_id, n.doc_id = m AS kept FROM n JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON n.doc_id = c.a""",
    "op13_line_dedup": f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {ENDS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id""",
}
