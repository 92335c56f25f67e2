"""Explicit schemas of every table the engine reads or writes."""

from __future__ import annotations

DOCUMENTS = "doc_id STRING, title STRING, text STRING"
QUERIES = "query_id STRING, text STRING"
QRELS = "query_id STRING, doc_id STRING, relevance INT"
DOC_EMBEDDINGS = "doc_id STRING, content STRING, embedding ARRAY<DOUBLE>, embed_time DOUBLE, doc_pos BIGINT"
QUERY_EMBEDDINGS = "query_id STRING, text STRING, embedding ARRAY<DOUBLE>, embed_time DOUBLE, query_pos BIGINT"
PLAIN_VECTORS = "doc_id STRING, content STRING, embedding ARRAY<DOUBLE>, first_size INT, batch STRING"
SEALED_VECTORS = (
    "doc_key STRING, id_enc BINARY, vector_enc BINARY, text_enc BINARY, "
    "version BIGINT, pos BIGINT, first_size INT, batch STRING"
)
RESULTS = "query_id STRING, results ARRAY<STRUCT<rank: INT, doc_id: STRING, score: DOUBLE>>"
RUN_METRICS = "backend STRING, sample_size INT, metric STRING, value DOUBLE, at TIMESTAMP"
