"""DuckDB twins of the catalog queries, written from the semantics and not from the plans."""

from __future__ import annotations

from wayfind.functions.text import STOPWORDS, SUFFIXES, SYNONYMS

# Tokens of the basic tokenizer: runs of [a-z0-9_-], two at least, each followed by its parts.
_TOKENS = """flatten(list_transform(regexp_extract_all(lower({0}), '[a-z0-9_-]{{2,}}'), lambda t:
  list_concat([t], CASE WHEN regexp_matches(t, '[-_]') THEN list_filter(string_split_regex(t, '[-_]'), lambda p: length(p) >= 2 AND p <> t) ELSE [] END)))"""

_BM25 = f"""
q AS (SELECT item_id AS query, unnest({_TOKENS.format("text")}) AS term FROM benchmark),
qt AS (SELECT query, term, count(*) AS qtf FROM q GROUP BY ALL),
d AS (SELECT doc_id AS doc, {_TOKENS.format("text")} AS tokens FROM documents),
st AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avg_length FROM d),
p AS (SELECT doc, len(tokens) AS length, unnest(tokens) AS term FROM d),
tf AS (SELECT doc, term, length, count(*) AS tf FROM p WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (
  SELECT query, doc, sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))) AS score
  FROM tf JOIN df USING (term) JOIN qt USING (term), st GROUP BY query, doc
)"""

_STOP = str(STOPWORDS)
_SUFFIX = SUFFIXES
_STEM = "CASE WHEN strlen(t) < 4 THEN t " + " ".join(f"WHEN t LIKE '%{s}' AND strlen(t) - {len(s)} >= 3 THEN t[:-{len(s) + 1}]" for s in _SUFFIX) + " ELSE t END"
_KEPT = """list_filter(flatten(list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{Nd}}_-]+'), lambda t:
  list_concat([t], CASE WHEN regexp_matches(t, '[-_]') THEN list_filter(string_split_regex(t, '[-_]'), lambda p: strlen(p) >= 2 AND p <> t) ELSE [] END))),
  lambda t: strlen(t) >= 2 AND NOT list_contains(""" + _STOP + """, t))"""
_SYN = f"MAP {SYNONYMS}"


def _advanced(text: str, synonyms: str = _SYN) -> str:
    kept = _KEPT.format(text)
    return f"list_concat(list_transform({kept}, lambda t: {_STEM}), flatten(list_transform({kept}, lambda t: coalesce({synonyms}[t], []))))"


def _fielded(request: str) -> str:
    return f"""
q AS (SELECT item_id AS query, unnest({_advanced(request)}) AS term FROM benchmark),
qt AS (SELECT query, term, count(*) AS qtf FROM q GROUP BY ALL),
ft AS (
  SELECT doc_id AS doc, 'name' AS field, 3.0 AS boost, {_advanced("string_split(text, chr(10))[1]")} AS tokens FROM documents
  UNION ALL SELECT doc_id, 'tags', 2.0, {_advanced("source")} FROM documents
  UNION ALL SELECT doc_id, 'category', 1.5, {_advanced("lang")} FROM documents
  UNION ALL SELECT doc_id, 'summary', 1.0, {_advanced("text")} FROM documents
),
av AS (SELECT field, avg(len(tokens)) AS avg_length FROM ft GROUP BY field),
p AS (SELECT doc, field, boost, len(tokens) AS length, unnest(tokens) AS term FROM ft),
tf AS (SELECT doc, field, boost, length, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(DISTINCT doc) AS df FROM tf GROUP BY term),
bm AS (
  SELECT query, doc, sum(qtf * boost * ln(((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))) AS score
  FROM tf JOIN df USING (term) JOIN av USING (field) JOIN qt USING (term) GROUP BY query, doc
)"""


def _top(source: str, k: int) -> str:
    return f"SELECT query, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rank FROM {source} QUALIFY rank <= {k}"


_QUOTED = """text || ' "' || coalesce(string_split(text, ' ')[3] || ' ', '') || coalesce(string_split(text, ' ')[4], '') || '"'"""
_AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"

#: The 50 nearest documents of each benchmark item by the cosine of hashed token and bigram vectors.
_NEAR = f"""i AS (SELECT 'd' AS side, doc_id AS id, {_TOKENS.format("text")} AS t FROM documents UNION ALL SELECT 'q', item_id, {_TOKENS.format("text")} FROM benchmark),
w AS (SELECT side, id, unnest(t) AS w, 1.0::DOUBLE AS x FROM i UNION ALL SELECT side, id, unnest(list_transform(range(1, len(t)), lambda k: t[k] || '_' || t[k + 1])), 0.5 FROM i),
h AS (SELECT side, id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h, x FROM w),
raw AS (SELECT side, id, h % 384 AS slot, sum(CASE WHEN h % 2 = 0 THEN -x ELSE x END) AS v FROM h GROUP BY ALL),
u AS (SELECT side, id, slot, v / sqrt(sum(v * v) OVER (PARTITION BY side, id)) AS v FROM raw WHERE v <> 0),
m AS (SELECT a.id AS query, b.id AS doc, round(sum(a.v * b.v), 6) AS sim FROM u a JOIN u b USING (slot) WHERE a.side = 'q' AND b.side = 'd' GROUP BY a.id, b.id),
near AS (SELECT * FROM m WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, doc) <= 50)"""

_CANDIDATES = f"""{_BM25},
{_NEAR},
nt AS (SELECT query, doc, score / max(score) OVER (PARTITION BY query) AS t FROM bm),
hits AS (SELECT query, doc, coalesce(t, 0) AS t, coalesce(sim, 0) AS sim FROM nt FULL JOIN near USING (query, doc)),
lb AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
cand AS (
  SELECT query, doc, round(t, 6) AS text, sim AS semantic, s AS source, coalesce(quality * 0.4::DOUBLE + 0.5::DOUBLE, CASE s WHEN 'local' THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END) AS trust,
    exp(-0.023::DOUBLE * (n_chars % 90)) AS freshness, CASE s WHEN 'local' THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS availability
  FROM hits JOIN (SELECT doc_id AS doc, n_chars, CASE WHEN substr(source, 4)::INT % 2 = 0 THEN 'local' ELSE 'remote' END AS s FROM documents) USING (doc) LEFT JOIN lb ON lb.doc_id = doc
),
scored AS (SELECT *, round(0.3::DOUBLE * text + 0.3::DOUBLE * semantic + 0.2::DOUBLE * trust + 0.1::DOUBLE * freshness + 0.1::DOUBLE * availability, 6) AS score FROM cand)"""

_NAMES = """
nm AS (
  SELECT lower(replace(n_name, '_', '-')) AS registry_host, 'dev-' || (s_suppkey % 40) AS developer_handle, 'agent-' || (s_suppkey % 60) AS entity_name,
    lower(replace(n_name, '_', '-')) || '/dev-' || (s_suppkey % 40) || '/agent-' || (s_suppkey % 60) AS fqan, s_suppkey % 80 AS entity_id, s_suppkey % 40 AS developer_id,
    s_suppkey AS registered_at, 'k' || (s_suppkey % 9) AS public_key
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
)"""

_EVENTS = """
ev AS (
  SELECT event_id AS seq, user_id AS entity_id, CASE event_type WHEN 'signup' THEN 'register' WHEN 'click' THEN 'update' WHEN 'purchase' THEN 'update' WHEN 'view' THEN 'agent_status' WHEN 'error' THEN 'deregister' END AS action,
    json_extract_string(props, '$.k')::INT AS k, epoch_us(ts) AS us, event_type FROM events
), an AS (
  SELECT *, 'key' || (k % 3) AS key, CASE WHEN k % 2 = 0 THEN 'active' ELSE 'inactive' END AS status, 'name-' || seq AS name, 'cat-' || (k % 10) AS category FROM ev
), pins AS (
  SELECT entity_id, min(seq) AS first_seq, arg_min(key, seq) AS pinned FROM an WHERE action IN ('register', 'update') GROUP BY entity_id
), au AS (
  SELECT an.*, CASE WHEN first_seq < seq THEN pinned END AS pin,
    CASE action WHEN 'register' THEN true WHEN 'update' THEN NOT coalesce(first_seq < seq, false) OR pinned = key ELSE coalesce(first_seq < seq, false) AND pinned = key END AS accepted
  FROM an LEFT JOIN pins USING (entity_id)
), es AS (
  SELECT entity_id, arg_max(name, seq) FILTER (action IN ('register', 'update')) AS name, arg_max(category, seq) FILTER (action IN ('register', 'update')) AS category,
    arg_min(key, seq) FILTER (action IN ('register', 'update')) AS pin,
    arg_max(CASE WHEN action = 'agent_status' THEN status ELSE 'active' END, seq) FILTER (action <> 'deregister') AS status,
    max(us) FILTER (action IN ('register', 'update')) AS received_us,
    coalesce(max(seq) FILTER (action = 'deregister') > coalesce(max(seq) FILTER (action IN ('register', 'update')), -1), false) AS tombstoned,
    arg_max(us, seq) FILTER (action = 'deregister') AS dead_us
  FROM au WHERE accepted GROUP BY entity_id
)"""

_ATTEST = """
att AS (
  SELECT l_suppkey AS entity_id, c_nationkey AS observer_registry, count(*) AS invocations, count(*) FILTER (l_returnflag <> 'R') AS successes, avg(l_quantity) * 40 AS lat, avg(l_discount) * 60 AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL
), rep AS (
  SELECT *, 0.4 * successes / invocations + 0.3 * least(rating / 5.0, 1.0) + 0.3 / (1 + exp((lat - 1000) / 300.0)) AS rep FROM att
)"""

_RTOKENS = """
rt AS (
  SELECT DISTINCT registry, token FROM (
    SELECT source AS registry, unnest(list_concat(regexp_extract_all(lower(text), '[a-z0-9_-]{2,}'), [lower(lang), lower(source)])) AS token FROM documents
  ) WHERE token <> ''
), qk AS (
  SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(text), '[a-z0-9_-]{2,}')) AS token FROM benchmark
)"""

_BITS = """(('0x' || substr(md5({0}), 1, 8))::BIGINT % 4792530 + i * CASE WHEN ('0x' || substr(md5({0}), 9, 8))::BIGINT % 4792530 = 0 THEN 1 ELSE ('0x' || substr(md5({0}), 9, 8))::BIGINT % 4792530 END) % 4792530"""

_GAPS = """
b AS (SELECT event_id, user_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)"""

_PLAN_BM25 = f"""
q AS (SELECT item_id AS query, unnest({_TOKENS.format("text")}) AS term FROM benchmark), qt AS (SELECT query, term, count(*) AS qtf FROM q GROUP BY ALL),
e AS (SELECT doc_id AS doc, substr(source, 4)::INT % 2 AS side, lang, source, n_chars, text, {_TOKENS.format("string_split(text, chr(10))[1] || ' ' || text || ' ' || source || ' ' || lang")} AS tokens FROM documents),
st AS (SELECT side, count(*) AS n_docs, avg(len(tokens)) AS avg_length FROM e GROUP BY side), p AS (SELECT doc, side, len(tokens) AS length, unnest(tokens) AS term FROM e),
tf AS (SELECT doc, side, term, length, count(*) AS tf FROM p WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT side, term, count(*) AS df FROM tf GROUP BY ALL),
bm AS (SELECT query, side, doc, sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))) AS score FROM tf JOIN df USING (side, term) JOIN st USING (side) JOIN qt USING (term) GROUP BY query, side, doc)"""

_PLAN_FIELDED = f"""
q AS (SELECT item_id AS query, unnest({_advanced("text")}) AS term FROM benchmark), qt AS (SELECT query, term, count(*) AS qtf FROM q GROUP BY ALL),
e AS (SELECT doc_id AS doc, substr(source, 4)::INT % 2 AS side, lang, source, n_chars, text FROM documents),
ft AS (
  SELECT doc, side, 'name' AS field, 3.0 AS boost, {_advanced("string_split(text, chr(10))[1]")} AS tokens FROM e
  UNION ALL SELECT doc, side, 'tags', 2.0, {_advanced("source")} FROM e
  UNION ALL SELECT doc, side, 'category', 1.5, {_advanced("lang")} FROM e
  UNION ALL SELECT doc, side, 'summary', 1.0, {_advanced("text")} FROM e
),
av AS (SELECT side, field, avg(len(tokens)) AS avg_length FROM ft GROUP BY ALL), st AS (SELECT side, count(*) AS n_docs FROM e GROUP BY side),
p AS (SELECT doc, side, field, boost, len(tokens) AS length, unnest(tokens) AS term FROM ft),
tf AS (SELECT doc, side, field, boost, length, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT side, term, count(DISTINCT doc) AS df FROM tf GROUP BY ALL),
bm AS (
  SELECT query, side, doc, sum(qtf * boost * ln((n_docs - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))) AS score
  FROM tf JOIN df USING (side, term) JOIN av USING (side, field) JOIN st USING (side) JOIN qt USING (term) GROUP BY query, side, doc
)"""


def _plan(keywords: str) -> str:
    vectors = "string_split(text, chr(10))[1] || ' ' || text || ' ' || source"
    return f"""WITH {_NAMES}, {keywords},
nt AS (SELECT query, side, doc, score / max(score) OVER (PARTITION BY query, side) AS text FROM bm),
i AS (SELECT side, doc AS id, {_TOKENS.format(vectors)} AS t FROM e UNION ALL SELECT 2, item_id, {_TOKENS.format("text")} FROM benchmark),
w AS (SELECT side, id, unnest(t) AS w, 1.0::DOUBLE AS x FROM i UNION ALL SELECT side, id, unnest(list_transform(range(1, len(t)), lambda k: t[k] || '_' || t[k + 1])), 0.5 FROM i),
h AS (SELECT side, id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h, x FROM w),
v AS (SELECT side, id, h % 384 AS slot, sum(CASE WHEN h % 2 = 0 THEN -x ELSE x END) AS v FROM h GROUP BY ALL),
u AS (SELECT side, id, slot, v / sqrt(sum(v * v) OVER (PARTITION BY side, id)) AS v FROM v WHERE v <> 0),
m AS (SELECT a.id AS query, b.side, b.id AS doc, round(sum(a.v * b.v), 6) AS sim FROM u a JOIN u b USING (slot) WHERE a.side = 2 AND b.side < 2 GROUP BY a.id, b.side, b.id),
near AS (SELECT * FROM m WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY query, side ORDER BY sim DESC, doc) <= 50),
lb AS (SELECT doc_id AS doc, max(quality) * 0.4::DOUBLE + 0.5::DOUBLE AS known FROM labels GROUP BY doc_id),
c AS (
  SELECT query, doc, CASE side WHEN 0 THEN 'local' ELSE 'remote' END AS source, coalesce(nt.text, 0) AS text, coalesce(sim, 0) AS semantic, coalesce(known, CASE side WHEN 0 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END) AS trust, exp(-0.023::DOUBLE * (n_chars % 90)) AS freshness,
    CASE side WHEN 0 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS usual, CASE n_chars % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS live
  FROM nt FULL JOIN near USING (query, side, doc) JOIN e USING (side, doc) LEFT JOIN lb USING (doc) WHERE doc % 11 <> 0 AND (query % 3 <> 0 OR doc % 5 <> 0)
),
s AS (SELECT *, round(0.3::DOUBLE * text + 0.3::DOUBLE * semantic + 0.2::DOUBLE * trust + 0.1::DOUBLE * freshness + 0.1::DOUBLE * usual, 6) AS score FROM c),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query, source ORDER BY score DESC, doc) <= 50),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank, count(*) OVER (PARTITION BY query) AS n FROM b),
one AS (SELECT entity_id AS doc, arg_min(fqan, (registered_at, fqan)) AS fqan, arg_min(developer_handle, (registered_at, fqan)) AS developer_handle FROM nm GROUP BY 1)
SELECT query, doc, source, round(text, 6) AS text, round(semantic, 6) AS semantic, trust, round(freshness, 6) AS freshness, live AS availability, score, rank, n AS n_distinct, n AS total_found, n > 10 AS has_more, fqan, developer_handle
FROM r LEFT JOIN one USING (doc) WHERE rank <= 10"""


ORACLES = {
    "bm25_topk": f"WITH {_BM25} {_top('bm', 10)}",
    "bm25_fielded_topk": f"WITH {_fielded('text')} {_top('bm', 10)}",
    "phrase_bonus": f"""WITH {_fielded(_QUOTED)},
ph AS (SELECT item_id AS query, lower(coalesce(string_split(text, ' ')[3] || ' ', '') || coalesce(string_split(text, ' ')[4], '')) AS phrase FROM benchmark),
bo AS (SELECT query, doc_id AS doc, 5.0 * count(*) AS bonus FROM ph JOIN documents ON contains(lower(text), phrase) OR contains(lower(source), phrase) OR contains(lower(lang), phrase) WHERE phrase <> '' GROUP BY ALL),
bs AS (SELECT query, doc, coalesce(score, 0) + coalesce(bonus, 0) AS score FROM bm FULL JOIN bo USING (query, doc))
{_top("bs", 10)}""",
    "corpus_statistics": f"WITH t AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term",
    "index_update": f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'fresh-token ' || lang || ' ' || source ELSE text END AS text FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 <> 1),
t AS (SELECT doc_id, unnest({_TOKENS.format("text")}) AS term FROM d) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term""",
    "stored_index_topk": "WITH changed AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'fresh-token ' || lang || ' ' || source ELSE text END AS text FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 <> 1), " + _BM25.replace("FROM documents", "FROM changed") + _top("bm", 10),
    "cosine_topk": """SELECT a.vec_id AS query, b.vec_id AS doc, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank
FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0 QUALIFY rank <= 10""",
    "cosine_by_label": "SELECT a.vec_id AS query, b.label, count(*) AS n FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.25 GROUP BY ALL",
    "token_hash_vectors": f"""WITH d AS (SELECT doc_id, {_TOKENS.format("text")} AS t FROM documents),
i AS (SELECT doc_id, unnest(t) AS w, 1.0::DOUBLE AS x FROM d UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda k: t[k] || '_' || t[k + 1])), 0.5 FROM d),
h AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h, x FROM i),
s AS (SELECT doc_id, (h % 384)::INT AS slot, sum(CASE WHEN h % 2 = 0 THEN -x ELSE x END) AS v FROM h GROUP BY ALL HAVING v <> 0)
SELECT doc_id, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM s""",
    "hybrid_weighted": f"WITH {_CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scored) SELECT query, doc, source, text, semantic, trust, round(freshness, 6) AS freshness, availability, score, rank FROM r WHERE rank <= 10 AND score >= 0.3",
    "hybrid_rrf": f"""WITH {_CANDIDATES}, r AS (SELECT query, doc, round(1 / (60.0 + row_number() OVER (PARTITION BY query ORDER BY text DESC, doc)) + 1 / (60.0 + row_number() OVER (PARTITION BY query ORDER BY semantic DESC, doc)) + 1 / (60.0 + row_number() OVER (PARTITION BY query ORDER BY round(trust, 6) DESC, doc)), 9) AS score FROM cand)
SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM r QUALIFY rank <= 10""",
    "candidates_dedupe": f"WITH {_CANDIDATES} SELECT query, doc, source, text FROM cand",
    "merge_hits": f"""WITH {_BM25},
{_NEAR},
k AS (SELECT query, doc, round(score, 6) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) <= 50)
SELECT query, doc, coalesce(score, 0) AS text, coalesce(sim, 0) AS semantic FROM k FULL JOIN near USING (query, doc)""",
    "search_page": f"WITH {_CANDIDATES}, r AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank, count(*) OVER (PARTITION BY query) AS n_distinct FROM scored) SELECT *, n_distinct > 10 AS has_more FROM r WHERE rank > 5 AND rank <= 10",
    "default_page": f"""WITH {_CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank, count(*) OVER (PARTITION BY query) AS n FROM scored)
SELECT query, doc, rank, n > 20 AS has_more, text AS text_relevance, semantic AS semantic_similarity, round(trust, 6) AS trust_score, round(freshness, 6) AS freshness, availability FROM r WHERE rank <= 20""",
    "search_plan": _plan(_PLAN_BM25),
    "search_plan_fielded": _plan(_PLAN_FIELDED),
    "vector_functions": """WITH u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS u FROM embeddings)
SELECT vec_id, round(list_sum(u), 6) AS along, 0.0::DOUBLE AS unequal, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS self, 70 AS padded, round(list_sum(u[1:10]), 6) AS first_ten, vec_id % 9 = 0 AS wrong FROM u""",
    "query_hashes": """SELECT item_id, sha256('{"item_id":' || item_id || ',"n":' || length(text) || '}') AS hash FROM benchmark""",
    "handle_filter": "SELECT 's-' || (c_custkey % 1500) AS developer_handle, c_custkey, s_suppkey AS developer_id FROM customer JOIN supplier ON s_suppkey = c_custkey % 1500",
    "keyword_filter": "SELECT p_partkey AS entity_id, p_name AS name, p_brand AS category FROM part WHERE (contains(lower(p_name), 'red') OR contains(lower(p_type), 'red') OR contains(lower(p_brand), 'red')) AND (contains(lower(p_type), 'econ') OR contains(lower(p_brand), 'econ'))",
    "remote_keyword_filter": "SELECT doc_id AS entity_id, source AS name FROM documents WHERE (contains(lower(text), 'license') OR contains(lower(source), 'license')) AND lang = 'en' AND doc_id % 4 <> 0",
    "any_tag_filter": "SELECT p_partkey, p_type, p_brand FROM part WHERE lower(p_type) IN ('economy', 'brand#3') OR lower(p_brand) IN ('economy', 'brand#3')",
    "capability_filter": "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE source IN ('src1', 'src2', 'src3') AND lang IN ('en', 'fr') AND quality >= 0.5 AND toxic = 0",
    "facets": "SELECT kind, value, count(*) AS n FROM (SELECT 'category' AS kind, p_brand AS value FROM part UNION ALL SELECT 'tag', unnest(list_distinct([p_type, p_name])) FROM part) GROUP BY ALL",
    "catalog_counts": "SELECT count(*) FILTER (doc_id % 2 = 0) AS local, count(*) FILTER (doc_id % 2 = 1 AND doc_id % 3 <> 0) AS remote, (SELECT count(*) FROM supplier) AS developers, count(*) FILTER (doc_id % 2 = 0 OR doc_id % 3 <> 0) AS estimated, 5 AS registries FROM documents",
    "list_page": "SELECT p_partkey AS entity_id, p_type AS category, p_size AS updated_at FROM part WHERE p_type = 'ECONOMY' ORDER BY p_size DESC, p_partkey LIMIT 25 OFFSET 50",
    "entity_patch": "SELECT p_partkey, CASE WHEN p_partkey % 20 = 0 THEN 'PATCHED' ELSE p_type END AS p_type, CASE WHEN p_partkey % 10 = 0 THEN p_size + 100 ELSE p_size END AS p_size, CASE WHEN p_partkey % 10 = 0 THEN 7 ELSE 0 END AS updated_at FROM part",
    "request_defaults": "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'service' ELSE 'agent' END AS entity_type, CASE WHEN p_size % 2 = 0 THEN p_name WHEN p_size % 3 = 0 THEN p_type END AS url, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS n_tags, '' AS public_url FROM part",
    "validate_entities": """WITH d AS (SELECT *, string_split(text, chr(10))[1] AS name, text AS summary, CASE WHEN doc_id % 3 = 0 THEN 'service' WHEN doc_id % 17 = 0 THEN 'robot' ELSE 'agent' END AS kind FROM documents),
r AS (SELECT doc_id, list_filter([CASE WHEN name = '' THEN 'name is required' END, CASE WHEN strlen(name) > 100 THEN 'name is too long' END, CASE WHEN doc_id % 13 = 0 OR source = '' THEN 'owner is required' END,
  CASE WHEN kind = 'agent' AND doc_id % 7 = 0 THEN 'entity_url is required' END, CASE WHEN coalesce(lang, '') = '' THEN 'category is required' END, CASE WHEN strlen(summary) > 200 THEN 'summary is too long' END,
  CASE WHEN doc_id % 23 > 20 THEN 'too many tags' END, CASE WHEN kind = 'robot' THEN 'unknown entity_type' END, CASE WHEN kind = 'service' AND doc_id % 2 = 1 THEN 'service_endpoint is required' END,
  CASE WHEN kind = 'service' AND doc_id % 5 = 0 THEN 'unknown pricing model' END], lambda x: x IS NOT NULL) AS r FROM d)
SELECT doc_id::VARCHAR AS entity_id, array_to_string(r, '; ') AS reasons, r[1] AS first_reason, len(r) = 0 AS valid FROM r""",
    "validate_developers": """SELECT 'developer' AS kind, s_suppkey AS key, concat_ws('; ', CASE WHEN s_suppkey % 4 = 0 OR s_nationkey % 8 = 0 THEN 'name is required' WHEN strlen(s_name) * (s_nationkey % 8) > 100 THEN 'name is too long' END, CASE WHEN s_acctbal <= 0 THEN 'public_key is required' END) AS reasons FROM supplier
UNION ALL SELECT 'name', s_suppkey, concat_ws('; ', CASE WHEN s_suppkey % 3 = 0 THEN 'entity_name is required' END, CASE WHEN s_suppkey % 5 = 0 THEN 'registry_host is required' END) FROM supplier""",
    "validate_handles": """WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents),
t AS (SELECT w FROM w UNION SELECT lower(w) || '-' FROM w WHERE length(w) > 4 UNION SELECT lower(w) || '--x' FROM w UNION SELECT 'admin')
SELECT w, CASE WHEN w IN ('system', 'admin', 'test', 'root', 'registry', 'anonymous', 'unknown') THEN 'reserved' WHEN w = '' THEN 'required' WHEN NOT regexp_full_match(w, '[a-z][a-z0-9-]{2,39}') THEN 'malformed' WHEN w LIKE '%-' THEN 'ends with a hyphen' WHEN contains(w, '--') THEN 'consecutive hyphens' END AS error FROM t""",
    "parse_fqan": """WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#:]+)', 1) AS host, CASE WHEN page_id % 3 = 0 THEN '2.1.0' WHEN page_id % 7 = 1 THEN '' END AS v, CASE WHEN page_id % 5 = 0 THEN 'text.summary' END AS c FROM pages)
SELECT page_id, host, CASE WHEN v IS NULL OR v <> '' THEN host || '/dev-' || page_id || '/agent' END AS base, nullif(v, '') AS version, CASE WHEN v IS NULL OR v <> '' THEN c END AS capability,
  CASE WHEN v IS NULL OR v <> '' THEN 'dev-' || page_id END AS handle, CASE WHEN v IS NULL OR v <> '' THEN 'agent' END AS name, CASE WHEN v = '' THEN 'empty version' END AS error FROM p""",
    "txt_records": "SELECT page_id, page_id % 3 = 1 AND page_id % 5 = 2 AS matches FROM pages",
    "names_join": f"WITH {_NAMES} SELECT s_suppkey AS entity_id, (SELECT arg_min(fqan, (registered_at, fqan)) FROM nm WHERE entity_id = s_suppkey) AS fqan, (SELECT arg_min(developer_handle, (registered_at, fqan)) FROM nm WHERE entity_id = s_suppkey) AS developer_handle FROM supplier",
    "resolve_name": f"""WITH {_NAMES},
rq AS (SELECT DISTINCT 'dev-' || (c_custkey % 45) AS handle, 'agent-' || (c_custkey % 65) AS name FROM customer),
lo AS (SELECT developer_handle AS handle, entity_name AS name, min(fqan) AS fqan, arg_min(entity_id, fqan) AS entity_id, arg_min(developer_id, fqan) AS developer_id FROM nm WHERE registered_at % 2 = 0 GROUP BY ALL),
re AS (SELECT developer_handle AS handle, entity_name AS name, min(fqan) AS fqan, arg_min(entity_id, fqan) AS entity_id FROM nm WHERE registered_at % 2 = 1 AND registered_at % 5 <> 0 GROUP BY ALL)
SELECT handle, name, coalesce(lo.fqan, re.fqan) AS fqan, CASE WHEN lo.fqan IS NOT NULL THEN lo.entity_id ELSE re.entity_id END AS entity_id,
  CASE WHEN lo.fqan IS NOT NULL THEN coalesce(CASE WHEN s_acctbal > 5000 THEN 'active' WHEN s_suppkey IS NOT NULL THEN 'inactive' END, 'unknown') WHEN re.fqan IS NOT NULL THEN 'unknown' END AS status,
  CASE WHEN lo.fqan IS NOT NULL THEN CASE WHEN lo.developer_id IN (SELECT s_suppkey FROM supplier) AND lo.developer_id % 2 = 0 THEN 'method-verified' ELSE 'self-claimed' END WHEN re.fqan IS NOT NULL THEN 'self-claimed' END AS tier,
  CASE WHEN coalesce(lo.fqan, re.fqan) IS NOT NULL THEN 0.5::DOUBLE END AS trust, CASE WHEN lo.fqan IS NOT NULL THEN 'local' WHEN re.fqan IS NOT NULL THEN 'remote' END AS found_in
FROM rq LEFT JOIN lo USING (handle, name) LEFT JOIN re USING (handle, name) LEFT JOIN supplier ON lo.entity_id = s_suppkey""",
    "resolve_fqan": f"""WITH {_NAMES}, rq AS (SELECT fqan FROM nm UNION SELECT fqan || '-x' FROM nm),
lo AS (SELECT * FROM nm WHERE registered_at % 2 = 0), re AS (SELECT * FROM nm WHERE registered_at % 2 = 1 AND registered_at % 5 <> 0)
SELECT fqan, coalesce(lo.entity_id, re.entity_id) AS entity_id, CASE WHEN lo.entity_id IS NOT NULL THEN 'local' WHEN re.entity_id IS NOT NULL THEN 'remote' END AS found_in, CASE WHEN coalesce(lo.entity_id, re.entity_id) IS NOT NULL THEN 1.0::DOUBLE END AS score
FROM rq LEFT JOIN lo USING (fqan) LEFT JOIN re USING (fqan)""",
    "lookup_entity": "SELECT p_partkey AS entity_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'far ' || p_name END AS p_name, CASE WHEN p_partkey % 2 = 0 THEN 'local' ELSE 'remote' END AS found_in FROM part",
    "registration_check": "SELECT c_custkey, c_custkey % 120 AS developer_id, 'k' || c_nationkey AS proof_key, CASE WHEN s_suppkey IS NULL THEN 'unknown developer' WHEN s_nationkey <> c_nationkey THEN 'key mismatch' END AS refused FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 120",
    "registration_insert": "SELECT c_custkey % 500 AS entity_id, c_custkey, CASE WHEN s_suppkey IS NOT NULL THEN 'already registered' WHEN row_number() OVER (PARTITION BY c_custkey % 500 ORDER BY c_custkey) > 1 THEN 'repeated in the batch' ELSE '' END AS reason FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 500",
    "name_availability": f"WITH {_NAMES}, h AS (SELECT developer_handle, min(entity_id) AS existing_id FROM nm GROUP BY 1) SELECT developer_handle, existing_id, existing_id IS NULL AS available FROM (SELECT DISTINCT 'dev-' || (c_custkey % 60) AS developer_handle FROM customer) LEFT JOIN h USING (developer_handle)",
    "name_conflicts": f"WITH {_NAMES} SELECT c_custkey, developer_handle AS handle, entity_name AS name, 'k' || (c_custkey % 9) AS public_key, public_key AS held_by FROM customer JOIN nm ON developer_handle = 'dev-' || (c_custkey % 40) AND entity_name = 'agent-' || (c_custkey % 60) WHERE public_key <> 'k' || (c_custkey % 9)",
    "developer_entities": "SELECT o_orderkey AS entity_id, o_custkey AS developer_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') QUALIFY rank <= 3",
    "names_by_host": f"WITH {_NAMES} SELECT fqan, entity_name FROM nm WHERE developer_handle = 'dev-7'",
    "latest_version": "SELECT o_custkey AS fqan, (o_orderkey % 4) || '.' || (o_orderkey % 10) AS version, o_orderkey AS entity_id FROM orders WHERE o_orderkey % 4 = 2 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY epoch_us(o_orderdate) + o_orderkey DESC, version DESC) = 1",
    "version_history": "SELECT fqan, version, entity_id, row_number() OVER w AS rank, lead(version) OVER w AS previous_version FROM (SELECT o_custkey AS fqan, (o_orderkey % 4) || '.' || (o_orderkey % 10) AS version, o_orderkey AS entity_id, epoch_us(o_orderdate) + o_orderkey AS r FROM orders) WINDOW w AS (PARTITION BY fqan ORDER BY r DESC, version DESC)",
    "announce_dedupe": f"""WITH RECURSIVE {_EVENTS}, o AS (SELECT entity_id, action, us, seq, row_number() OVER (PARTITION BY entity_id, action ORDER BY us, seq) AS i FROM ev),
r AS (
  SELECT entity_id, action, seq, i, us AS last, true AS kept FROM o WHERE i = 1
  UNION ALL
  SELECT o.entity_id, o.action, o.seq, o.i, CASE WHEN o.us - last >= 3600000000 THEN o.us ELSE last END, o.us - last >= 3600000000
  FROM r JOIN o ON o.entity_id = r.entity_id AND o.action IS NOT DISTINCT FROM r.action AND o.i = r.i + 1
) SELECT seq, entity_id, action FROM r WHERE kept""",
    "announce_forward": f"WITH {_EVENTS} SELECT seq, entity_id, k % 4 + 1 AS hop_count FROM ev WHERE k % 20 <> 0 AND k % 4 < 3",
    "announce_route": """WITH t AS (SELECT ['agent_announce', 'developer_announce', 'dev_handle', 'name_binding', 'registry_proof', 'peer_attestation', 'other'][event_id % 7 + 1] AS type FROM events)
SELECT type, CASE type WHEN 'agent_announce' THEN 'remote_entities' WHEN 'developer_announce' THEN 'remote_developers' WHEN 'dev_handle' THEN 'remote_developers' WHEN 'name_binding' THEN 'remote_names' WHEN 'registry_proof' THEN 'registry_proofs' WHEN 'peer_attestation' THEN 'peer_attestations' END AS target, count(*) AS n FROM t GROUP BY ALL""",
    "announce_authorize": f"WITH {_EVENTS} SELECT seq, entity_id, action, pin, accepted FROM au",
    "entity_state": f"WITH {_EVENTS} SELECT entity_id, name, category, pin, status, received_us, tombstoned, CASE WHEN tombstoned THEN dead_us END AS tombstone_us FROM es",
    "expire_tombstones": f"WITH {_EVENTS} SELECT entity_id, tombstoned FROM es WHERE NOT tombstoned OR dead_us + 86400000000 >= epoch_us({_AS_OF})",
    "developer_state": """WITH e AS (SELECT event_id AS seq, user_id AS developer_id, json_extract_string(props, '$.k')::INT AS k FROM events),
a AS (SELECT *, k % 2 = 0 AS p, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 10 = 0 THEN 'deregister' ELSE 'register' END WHEN k % 9 = 0 THEN 'release' WHEN k % 3 = 0 THEN 'verify' ELSE 'claim' END AS action FROM e)
SELECT developer_id, arg_max('n' || k, seq) FILTER (p AND action <> 'deregister') AS name, arg_max('k' || (k % 3), seq) FILTER (p AND action <> 'deregister') AS public_key,
  nullif(arg_max(CASE WHEN action = 'release' THEN '' ELSE 'h' || (k % 7) END, seq) FILTER (NOT p), '') AS dev_handle, coalesce(arg_max(action = 'verify', seq) FILTER (NOT p), false) AS dev_handle_verified,
  coalesce(max(seq) FILTER (action = 'deregister'), -1) > coalesce(max(seq) FILTER (p AND action <> 'deregister'), -1) AS tombstoned FROM a GROUP BY developer_id""",
    "name_state": """WITH e AS (SELECT event_id AS seq, user_id, json_extract_string(props, '$.k')::INT AS k FROM events)
SELECT 'h/d/' || user_id AS fqan, arg_max(user_id, seq) FILTER (k % 6 <> 0) AS entity_id, arg_max('1.' || k, seq) FILTER (k % 6 <> 0) AS version, coalesce(max(seq) FILTER (k % 6 = 0), -1) > coalesce(max(seq) FILTER (k % 6 <> 0), -1) AS tombstoned FROM e GROUP BY user_id""",
    "proof_state": "SELECT json_extract_string(props, '$.k')::INT AS registry_id, arg_max(event_type, event_id) AS domain, arg_max(user_id, event_id) AS proof FROM events GROUP BY 1",
    "record_expiry": "SELECT user_id FROM events GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-30 20:00:00'",
    "heartbeats_in_skew": "SELECT event_id, user_id FROM events WHERE event_id % 50 <> 0 AND abs(epoch_us(date_trunc('second', make_timestamp(epoch_us(ts) + (event_id % 121 - 60) * 1500000))) - epoch_us(ts)) <= 60000000",
    "liveness_sweep": "SELECT user_id, epoch_us(max(ts)) AS last_us FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-30 23:00:00'",
    "active_sessions": f"WITH {_GAPS}, s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS s FROM b) SELECT user_id, min(us) AS started_us, max(us) AS last_us, count(*) AS beats FROM s GROUP BY user_id, s",
    "became_active": f"WITH {_GAPS} SELECT event_id, user_id FROM b WHERE gap IS NULL OR gap > 3600000000",
    "over_limit": "SELECT user_id, epoch_us(date_trunc('hour', ts)) AS window_us, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 2",
    "activity_hourly": "SELECT epoch_us(date_trunc('hour', ts)) AS window_us, event_type, count(*) AS n FROM events GROUP BY ALL",
    "latency_summary": """WITH r AS (SELECT user_id % 5 AS kind, value, event_type <> 'error' AS ok FROM events), l AS (SELECT kind, list(value ORDER BY value) FILTER (ok) AS v, count(*) AS total, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed FROM r GROUP BY kind)
SELECT kind, total, ok, failed, v[floor((len(v) - 1) * 50 / 100.0)::INT + 1] AS p50, v[floor((len(v) - 1) * 90 / 100.0)::INT + 1] AS p90, v[floor((len(v) - 1) * 99 / 100.0)::INT + 1] AS p99, v[1] AS least, v[-1] AS most FROM l""",
    "reputation": f"WITH {_ATTEST} SELECT entity_id, observer_registry, invocations, successes, round(rep, 6) AS reputation FROM rep",
    "entity_trust": f"""WITH {_ATTEST}, w AS (SELECT *, CASE WHEN observer_registry < 10 THEN observer_registry / 10.0 ELSE 0.5 END AS w FROM rep)
SELECT entity_id, round(sum(w * rep) / sum(w), 6) AS trust, round(0.5 * (1 - exp(-count(*) / 3.0)) + 0.5 * (1 - exp(-sum(invocations) / 300.0)), 6) AS confidence, count(*) AS attestations, sum(invocations)::BIGINT AS invocations FROM w GROUP BY entity_id""",
    "verification_tiers": "SELECT o_custkey AS subject_id, count(DISTINCT o_orderpriority) AS n_attesters, CASE WHEN count(DISTINCT o_orderpriority) >= 3 THEN 'mesh-verified' ELSE 'self-announced' END AS tier FROM orders GROUP BY 1",
    "registry_tokens": f"WITH {_RTOKENS} SELECT registry, count(*) AS n_tokens FROM rt GROUP BY 1",
    "bloom_filters": f"WITH {_RTOKENS}, p AS (SELECT DISTINCT registry, {_BITS.format('token')} AS pos FROM rt, range(7) r(i)) SELECT registry, count(*) AS bits_set, sum(pos)::BIGINT AS pos_sum FROM p GROUP BY 1",
    "bloom_match": f"""WITH {_RTOKENS}, p AS (SELECT DISTINCT registry, {_BITS.format("token")} AS pos FROM rt, range(7) r(i)), n AS (SELECT DISTINCT query, token, {_BITS.format("token")} AS pos FROM qk, range(7) r(i)),
need AS (SELECT query, token, count(*) AS need FROM n GROUP BY ALL), got AS (SELECT query, token, registry, count(*) AS got FROM n JOIN p USING (pos) GROUP BY ALL)
SELECT query, registry, count(*) AS matches FROM got JOIN need USING (query, token) WHERE got = need GROUP BY ALL""",
    "registry_routing": f"""WITH {_RTOKENS}, m AS (SELECT query, registry, count(*) AS matches FROM qk JOIN rt USING (token) WHERE registry <> 'src3' GROUP BY ALL UNION ALL SELECT item_id, 'src3', 1 FROM benchmark)
SELECT query, registry, matches, row_number() OVER (PARTITION BY query ORDER BY matches DESC, registry) AS rank FROM m QUALIFY rank <= 5""",
    "federated_topk": f"""WITH {_RTOKENS}, c AS (SELECT query, registry, count(*) AS n FROM qk JOIN rt USING (token) GROUP BY ALL), m AS (SELECT query, registry, row_number() OVER (PARTITION BY query ORDER BY n DESC, registry) AS r FROM c QUALIFY r <= 3),
q AS (SELECT item_id AS query, unnest({_TOKENS.format("text")}) AS term FROM benchmark), qt AS (SELECT query, term, count(*) AS qtf FROM q GROUP BY ALL),
d AS (SELECT doc_id AS doc, source AS registry, {_TOKENS.format("string_split(text, chr(10))[1] || ' ' || text || ' ' || source || ' ' || lang")} AS tokens FROM documents), st AS (SELECT registry, count(*) AS n_docs, avg(len(tokens)) AS avg_length FROM d GROUP BY registry),
p AS (SELECT doc, registry, len(tokens) AS length, unnest(tokens) AS term FROM d), tf AS (SELECT doc, registry, term, length, count(*) AS tf FROM p WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT registry, term, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT query, registry, doc, round(sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))), 6) AS score
  FROM tf JOIN df USING (registry, term) JOIN st USING (registry) JOIN qt USING (term) JOIN m USING (query, registry) GROUP BY query, registry, doc)
SELECT query, registry, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank <= 5""",
    "advanced_tokens": f"""WITH k AS (SELECT item_id, {_KEPT.format("text")} AS k FROM benchmark),
t AS (SELECT item_id, unnest(list_concat(list_transform(k, lambda t: {_STEM}), flatten(list_transform(k, lambda t: coalesce(MAP {{'the': ['x'], 'thing': ['object', 'item']}}[t], []))), list_transform(range(1, len(k)), lambda i: k[i] || '_' || k[i + 1]))) AS token FROM k)
SELECT item_id, token, count(*) AS n FROM t GROUP BY ALL""",
    "entity_ids": """SELECT s_suppkey, 'zns:' || substr(sha256(s_name), 1, 32) AS agent_id, 'zns:dev:' || substr(sha256(s_name), 1, 32) AS developer_id, sha256('{"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || '}') AS fingerprint FROM supplier""",
}

#: Streams give what their batch twins give.
ORACLES |= {f"stream_{a}": ORACLES[b] for a, b in (("entities", "entity_state"), ("developers", "developer_state"), ("names", "name_state"), ("proofs", "proof_state"), ("tiers", "verification_tiers"), ("dedupe", "announce_dedupe"), ("became_active", "became_active"))}
ORACLES["stream_activity"] = f"WITH {_EVENTS} SELECT 'agent_announce_' || action AS type, count(*) AS n FROM au WHERE accepted GROUP BY ALL"
ORACLES["catalog_inserts"] = """SELECT s_suppkey AS entity_id, NULL::BIGINT AS c_custkey FROM supplier
UNION ALL SELECT c_custkey % 500, min(c_custkey) FROM customer WHERE c_custkey % 500 NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1"""
ORACLES["cards_read"] = """WITH c AS (SELECT CASE WHEN doc_id % 5 <> 0 THEN 'e' || doc_id END AS own, CASE WHEN doc_id % 7 = 0 THEN 'other' WHEN doc_id % 2 = 0 THEN 'e' || doc_id END AS wanted, *
  FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0)
SELECT coalesce(own, wanted) AS entity_id, CASE WHEN n_chars % 3 = 0 THEN 'online' ELSE 'degraded' END AS status, (doc_id % 4)::INT AS n_capabilities, source AS framework
FROM c WHERE (own IS NULL OR wanted IS NULL OR own = wanted) AND coalesce(own, wanted) IS NOT NULL"""
ORACLES["results_by_date"] = f"WITH r AS ({ORACLES['cosine_topk']}) SELECT *, '2024-01-02' AS query_date FROM r UNION ALL SELECT *, '2024-01-01' FROM r WHERE rank = 1"
ORACLES["named_embedder"] = f"""WITH d AS (SELECT doc_id, {_TOKENS.format("text")} AS t FROM documents),
i AS (SELECT doc_id, unnest(t) AS w, 1.0::DOUBLE AS x FROM d UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda k: t[k] || '_' || t[k + 1])), 0.5 FROM d),
h AS (SELECT w, list_reduce(list_transform(string_split(w, ''), lambda c: ascii(c)::UHUGEINT), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT) AS h FROM (SELECT DISTINCT w FROM i)),
s AS (SELECT doc_id, (h % 384)::INT AS slot, sum(CASE WHEN h % 2 = 1 THEN x ELSE -x END) AS v FROM i JOIN h USING (w) GROUP BY ALL HAVING v <> 0)
SELECT doc_id, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 4) AS value FROM s"""
