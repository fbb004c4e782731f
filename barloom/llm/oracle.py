"""DuckDB SQL for the queries that SQL can express."""

from barloom.llm.audit import audit_sql
from barloom.llm.codes import codes_sql
from barloom.llm.sharding import shards_sql
from barloom.llm.signs import near_sql

_EXACT = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)"""

_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.x, d.x) AS BIGINT) AS score
      FROM v q, v d WHERE q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id AND len(q.x) = len(d.x)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

ORACLE_SQL = {
    "op2_exact_dedup": _EXACT, "op5_topk": _TOPK, "op6_sharding": shards_sql(),
    "op11_filter_audit": audit_sql(), "op12_vector_codes": codes_sql(), "op13_near_vectors": near_sql(),
}
