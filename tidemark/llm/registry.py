"""Queries of this subpackage: one for each operator, over whole tables, and the pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import audit, bpe, license_scan, packing, pieces, qda, quality_rules, simhash, substring, suffix_dedup, toxicity, trie, vptree
from .io import shared_dir, spread, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark, sf_dir):
    shared_dir(spark)
    return quality_rules.assess(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark, sf_dir):
    return substring.digests(table(spark, sf_dir, "documents"))


def op3_license_scan(spark, sf_dir):
    return license_scan.scan(spread(table(spark, sf_dir, "documents")))


def op4_vantage_point_search(spark, sf_dir):
    shared_dir(spark)
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_simhash_near_dedup(spark, sf_dir):
    shared_dir(spark)
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents")))


def op6_toxicity(spark, sf_dir):
    return toxicity.assess(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark, sf_dir):
    return qda.assess(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op9_bpe_round_trip(spark, sf_dir):
    return bpe.digests(spread(table(spark, sf_dir, "documents")), tokenizer_path())


def op10_best_fit_packing(spark, sf_dir):
    shared_dir(spark)
    return packing.pack(spread(table(spark, sf_dir, "documents")), tokenizer_path())


def op11_conversation_trie(spark, sf_dir):
    shared_dir(spark)
    return trie.prefix_trie(spread(table(spark, sf_dir, "conversations")))


def op12_sentencepiece_round_trip(spark, sf_dir):
    return pieces.digests(spread(table(spark, sf_dir, "documents")), tokenizer_path("piece_bpe_32k.model"))


def op13_filter_audit(spark, sf_dir):
    return audit.audit(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_quality_rules": op1_quality_rules,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_vantage_point_search": op4_vantage_point_search,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_sentencepiece_round_trip": op12_sentencepiece_round_trip,
    "op13_filter_audit": op13_filter_audit,
}
#: The other operators need hashes, regular-expression tables, learned models or tokenizers that SQL doesn't have, or take
#: too long there; tests/llm holds them against brute force.
ORACLES: dict[str, str] = {
    "op4_vantage_point_search": """
WITH v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op2_substring_dedup": r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM w),
windows AS (SELECT doc_id, p, list(x) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS l FROM words),
later AS (SELECT doc_id, p FROM windows WHERE len(l) = 20 QUALIFY row_number() OVER (PARTITION BY array_to_string(l, ' ') ORDER BY doc_id, p) > 1),
covered AS (SELECT DISTINCT doc_id, p + k AS p FROM later, (SELECT unnest(range(20)) AS k)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "op11_conversation_trie": """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS label, strlen(coalesce(text, '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL
),
own AS (SELECT conv_id, list({'label': label, 'size': size} ORDER BY turn NULLS FIRST, role, label) AS l FROM t GROUP BY conv_id),
steps AS (  -- CRC-32 of the decimal: each byte comes in, then eight shifts
  SELECT conv_id, l, flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: [unicode(substr(conv_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])) AS x FROM own
),
heads AS (
  SELECT conv_id, l,
    xor(list_reduce(list_prepend(4294967295::BIGINT, x), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295) % 9 AS h
  FROM steps
),
built AS (
  SELECT a.conv_id, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) AS p FROM heads AS a LEFT JOIN own AS b ON b.conv_id = a.conv_id - a.conv_id % 5
),
members AS (SELECT conv_id, p, d, list_transform(p[1:d], lambda x: x.label) AS k FROM (SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS d FROM built)),
nodes AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(any_value(p[d].size), 0) AS size, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(p) = d), '')) AS ends
  FROM members GROUP BY k, d
),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY ALL),
linked AS (SELECT nodes.*, coalesce(kids, 0) AS kids FROM nodes LEFT JOIN kids USING (k)),
sums AS (
  SELECT k[1:e] AS k, count(*) FILTER (kids = 0) AS leaves, sum((n - 1) * size) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM linked) GROUP BY ALL
)
SELECT a.conv_id, a.d::BIGINT AS depth, b.conv_id AS parent_conv_id, a.n::BIGINT AS n_convs, a.kids::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, a.ends AS ends_sha256
FROM linked AS a JOIN sums USING (k) LEFT JOIN nodes AS b ON a.d > 0 AND b.k = a.k[1:a.d - 1]
""",
    "op13_filter_audit": r"""
WITH d AS (
  SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS f
  FROM d LEFT JOIN l USING (doc_id)
),
counts AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, f),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
filter_orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letter AS a, letter AS b, letter AS c, letter AS d, letter AS e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
steps AS (SELECT o, s, substr(o, s, 1) AS own, substr(o, 1, s - 1) AS earlier FROM filter_orders, (SELECT unnest(range(1, 6)) AS s)),
met AS (
  SELECT part, o, s, own, f, n, good, toxic, contains(f, own) AS fails, earlier <> '' AND len(list_intersect(string_split(earlier, ''), string_split(f, ''))) > 0 AND f <> '' AS gone
  FROM counts, steps
),
said AS (
  SELECT part, o AS filter_order, s::INTEGER AS step, own,
    coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (f = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY part, o, s, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM said
""",
}
