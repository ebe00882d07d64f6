"""Registration of the training-data queries and of their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.llm import decontamination, html_text, language, language_model, line_dedup, merkle, minhash, mixing, packing, prefix_trie, sharding, token_counts, vector_dedup
from wayfind.llm.support import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leak_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), temperature=0.5, seed="mix-1")
    return mixed.select("doc_id", "text", "lang", "source", "n_chars", F.round("rate", 9).alias("rate"), "n_copies", "copy", "shuffle_key")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_table(table(spark, sf_dir, "documents"))


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_table(table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.text_table(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_table(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_table(table(spark, sf_dir, "conversations"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_table(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packing_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_sharding": op2_sharding,
    "op3_line_dedup": op3_line_dedup,
    "op4_vector_dedup": op4_vector_dedup,
    "op5_language_model": op5_language_model,
    "op6_minhash": op6_minhash,
    "op7_mixing": op7_mixing,
    "op8_html_text": op8_html_text,
    "op9_token_counts": op9_token_counts,
    "op10_language": op10_language,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle": op12_merkle,
    "op13_packing": op13_packing,
}

# One chain of jumps per document, kept up to 41 shards.
_JUMPS = """
WITH RECURSIVE jumps AS (
  SELECT doc_id, coalesce(doc_id, 0)::UHUGEINT AS key, -1::BIGINT AS bucket, 0::BIGINT AS jump FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL
  SELECT doc_id, k, jump, floor((jump + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT doc_id, jump, (key * 2862933555777941757 + 1) % 18446744073709551616::UHUGEINT AS k FROM jumps WHERE jump < 41)
), shards AS (
  SELECT doc_id, max(bucket) FILTER (bucket < 40)::INT AS shard, max(bucket) FILTER (bucket < 41)::INT AS grown_shard FROM jumps WHERE bucket >= 0 GROUP BY doc_id
)
"""

# Whether the CRC-32 of a number's digits is even, and its value, for every number in `ids`.
_CRC = """, tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))
), crc AS (
  SELECT id, xor(list_reduce(list_transform(string_split(id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS crc FROM ids, tab
)
"""

ORACLES = {
    "op2_sharding": _JUMPS
    + """, tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))
), bytes AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents
), crc AS (
  SELECT doc_id, n + 16 AS size, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)::BIGINT AS text_crc32 FROM bytes, tab
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), size, text_crc32)), 1, 8))::BIGINT % 256, doc_id) - 1 AS slot, grown_shard
FROM crc JOIN shards USING (doc_id)
""",
    "op3_line_dedup": """
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents
), s AS (
  SELECT doc_id, no, list_sort(list_distinct(list_filter(string_split(lower(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    ')), ' '), lambda w: w <> ''))) AS s FROM l
), g AS (
  SELECT s, len(s) AS n, min({'d': doc_id, 'l': no}) AS fst, row_number() OVER () AS id FROM s WHERE len(s) > 0 GROUP BY s
), w AS (
  SELECT id, n, fst, unnest(s) AS w FROM g
), f AS (
  SELECT w, count(*) AS c FROM w GROUP BY w
), r AS (
  SELECT id, n, fst, w, row_number() OVER (PARTITION BY id ORDER BY c, w) AS k FROM w JOIN f USING (w)
), p AS (
  SELECT id, n, fst, w FROM r WHERE k <= n - ceil(80 * n / 100.0) + 1
), c AS (
  SELECT DISTINCT a.id AS early, b.id AS late FROM p a JOIN p b ON a.w = b.w AND a.fst < b.fst AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), m AS (
  SELECT DISTINCT late FROM c JOIN g a ON a.id = early JOIN g b ON b.id = late
  WHERE 100 * len(list_intersect(a.s, b.s)) >= 80 * (a.n + b.n - len(list_intersect(a.s, b.s)))
), gone AS (
  SELECT s.doc_id, s.no FROM s JOIN g USING (s) LEFT JOIN m ON m.late = g.id WHERE m.late IS NOT NULL OR g.fst <> {'d': s.doc_id, 'l': s.no}
), t AS (
  SELECT doc_id, list(no ORDER BY no)::INT[] AS removed FROM gone GROUP BY doc_id
)
SELECT d.doc_id, len(string_split(d.text, chr(10)))::INT AS n_lines, len(coalesce(removed, []))::INT AS n_removed, coalesce(removed, []::INT[]) AS removed,
  array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(coalesce(removed, []), i - 1)), chr(10)) AS text
FROM documents d LEFT JOIN t USING (doc_id)
""",
    "op4_vector_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), n AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
""",
    "op6_minhash": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), links AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
""",
    "op7_mixing": """
WITH RECURSIVE sizes AS (
  SELECT source, sum(coalesce(octet_length(encode(text)), 0) + 1)::DOUBLE AS bytes FROM documents GROUP BY source
), rates AS (
  SELECT source, (sum(bytes) OVER ()) * sqrt(bytes) / (sum(sqrt(bytes)) OVER ()) / bytes AS rate FROM sizes
), cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS below FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), below + p * rate / (k + 1) FROM cdf WHERE k < 60
), drawn AS (
  SELECT d.*, ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents d
), counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, any_value(c.rate) AS rate, count(*) FILTER (c.below <= d.u)::INT AS n_copies
  FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source GROUP BY ALL
), copies AS (
  SELECT *, unnest(range(n_copies))::INT AS copy FROM counted
)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS rate, n_copies, copy,
  ('0x' || substr(md5('mix-1/order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS shuffle_key
FROM copies
""",
    "op11_prefix_trie": """
WITH ids AS (
  SELECT DISTINCT conv_id AS id FROM conversations WHERE conv_id IS NOT NULL
)"""
    + _CRC
    + """, own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
    ORDER BY turn NULLS FIRST, substr(sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))), 1, 32)) AS x
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), rebuilt AS (
  SELECT o.conv_id AS c, list_concat(coalesce(b.x, [])[1:(crc % 6)::INT], o.x[(crc % 6)::INT + 1:]) AS x
  FROM own o JOIN crc ON o.conv_id = id LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), prefixes AS (
  SELECT c, d, x[1:d] AS p, len(x) = d AS ends FROM (SELECT c, x, unnest(range(len(x) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends,
    CASE WHEN d > 0 THEN (count(*) - 1) * length(p[d].t) ELSE 0 END AS saved FROM prefixes GROUP BY p, d
), kids AS (
  SELECT n.p, count(k.d) AS n_children, any_value(n.conv_id) AS conv_id, any_value(n.n) AS n_convs, any_value(n.d) AS depth, any_value(n.ends) AS ends_sha256, any_value(n.saved) AS saved
  FROM nodes n LEFT JOIN nodes k ON k.d = n.d + 1 AND k.p[1:k.d - 1] = n.p GROUP BY n.p
)
SELECT a.conv_id, a.depth, (SELECT u.conv_id FROM nodes u WHERE u.d = a.depth - 1 AND u.p = a.p[1:a.depth - 1]) AS parent_conv_id, a.n_convs, a.n_children,
  count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens, a.ends_sha256
FROM kids a JOIN kids b ON b.depth >= a.depth AND b.p[1:a.depth] = a.p
GROUP BY a.p, a.conv_id, a.depth, a.n_convs, a.n_children, a.ends_sha256
""",
    "op12_merkle": """
WITH RECURSIVE ids AS (
  SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id IS NOT NULL
)"""
    + _CRC
    + """, fields AS (
  SELECT doc_id, source, text, concat(
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
    CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head,
    CASE WHEN coalesce(crc % 2 = 0, false) THEN replace(text, chr(10), '') ELSE text END AS other
  FROM documents LEFT JOIN crc ON doc_id = id
), hashed AS (
  SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    sha256(head || CASE WHEN other IS NULL THEN '-' ELSE strlen(other) || ':' || other END) AS tampered FROM fields
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM hashed
), lower AS (
  SELECT source, 0 AS level, pos, leaf AS h, n FROM leaves
  UNION ALL
  SELECT source, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM lower WHERE n > 1 GROUP BY source, level, pos // 3
), subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lower WHERE n = 1
), upper AS (
  SELECT 0 AS level, pos, subroot AS h, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM upper WHERE n > 1 GROUP BY level, pos // 3
), steps AS (
  SELECT doc_id, leaf, l.source, u.level, u.pos < l.pos // (3 ** u.level)::BIGINT AS before, u.pos, u.h
  FROM leaves l JOIN lower u ON l.source IS NOT DISTINCT FROM u.source AND u.n > 1 AND u.pos // 3 = l.pos // (3 ** (u.level + 1))::BIGINT AND u.pos <> l.pos // (3 ** u.level)::BIGINT
  UNION ALL
  SELECT doc_id, leaf, l.source, 1000 + u.level, u.pos < s.pos // (3 ** u.level)::BIGINT, u.pos, u.h
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN upper u ON u.n > 1 AND u.pos // 3 = s.pos // (3 ** (u.level + 1))::BIGINT AND u.pos <> s.pos // (3 ** u.level)::BIGINT
), levels AS (
  SELECT source, level FROM lower WHERE n > 1 GROUP BY ALL UNION ALL SELECT s.source, 1000 + level FROM subroots s, (SELECT DISTINCT level FROM upper WHERE n > 1)
), sides AS (
  SELECT doc_id, leaf, source, level, coalesce(string_agg(h, '' ORDER BY pos) FILTER (before), '') AS b, coalesce(string_agg(h, '' ORDER BY pos) FILTER (NOT before), '') AS a FROM steps GROUP BY doc_id, leaf, source, level
), paths AS (
  SELECT l.doc_id, l.leaf, l.source, l.tampered, coalesce(list({'b': coalesce(b, ''), 'a': coalesce(a, '')} ORDER BY v.level) FILTER (v.level IS NOT NULL), []) AS path
  FROM leaves l LEFT JOIN levels v ON l.source IS NOT DISTINCT FROM v.source
  LEFT JOIN sides s ON l.doc_id IS NOT DISTINCT FROM s.doc_id AND l.leaf = s.leaf AND l.source IS NOT DISTINCT FROM s.source AND v.level = s.level GROUP BY ALL
), folded AS (
  SELECT doc_id, leaf, source, path, 0 AS k, tampered AS h FROM paths
  UNION ALL
  SELECT doc_id, leaf, source, path, k + 1, sha256(path[k + 1].b || h || path[k + 1].a) FROM folded WHERE k < len(path)
)
SELECT doc_id, leaf, subroot, (SELECT h FROM upper WHERE n = 1) AS root, sha256(array_to_string(list_transform(path, lambda x: x.b || x.a), '')) AS proof_sha256,
  f.h AS folded_root, f.h = (SELECT h FROM upper WHERE n = 1) AS verified
FROM folded f JOIN subroots s ON f.source IS NOT DISTINCT FROM s.source WHERE k = len(path)
""",
}
