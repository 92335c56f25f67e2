"""DuckDB statements that give the result of each registered query."""

from __future__ import annotations

UNIT = """
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
u AS MATERIALIZED (
  SELECT vec_id, label, norm,
         CASE WHEN norm > 0 THEN list_transform(e, lambda x: x / norm) ELSE e END AS u
  FROM n)
"""

PAIRS = UNIT + """,
s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_inner_product(q.u, d.u) AS score,
             CAST(q.label = d.label AS INTEGER) AS rel
      FROM u q, u d)
"""

HITS = PAIRS + """,
h AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
             doc_id, score, rel
      FROM s QUALIFY rank <= 5)
"""

OTHERS = PAIRS + """,
h AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
             doc_id, score, rel
      FROM s WHERE query_id <> doc_id QUALIFY rank <= 5)
"""

GAINS = """
o{n} AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY rel DESC) AS best FROM {hits}),
g{n} AS (SELECT {keys}, list(rel ORDER BY rank) AS rels,
             sum((2 ** rel - 1) / log2(rank + 1)) FILTER (WHERE rank <= 5) AS dcg,
             sum((2 ** rel - 1) / log2(best + 1)) FILTER (WHERE best <= 5) AS idcg
      FROM o{n} GROUP BY {keys}),
r{n} AS (SELECT *, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS ndcg FROM g{n})
"""


def gains(keys: str, n: str = "", hits: str = "h") -> str:
    """NDCG per ``keys`` of the relation ``hits`` as the relation ``r``, with suffix ``n``."""
    return GAINS.format(keys=keys, n=n, hits=hits)


NDCG = OTHERS + "," + gains("query_id")

TOPK = "WITH " + HITS + "SELECT query_id, rank, doc_id, round(score, 6) AS score FROM h"


def hashed(name: str, table: str, id_column: str, text: str) -> str:
    """Unit vectors of hashed token counts of a table as the relation ``name(id, u)``."""
    return f"""
{name}_tok AS (SELECT {id_column} AS id, unnest(regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+')) AS t FROM {table}),
{name}_cnt AS (SELECT id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS b, count(*) AS c
      FROM {name}_tok WHERE t <> '' GROUP BY ALL),
{name}_raw AS (SELECT d.{id_column} AS id, list(coalesce(c, 0)::DOUBLE ORDER BY p.b) AS e
      FROM {table} d CROSS JOIN (SELECT unnest(range(64)) AS b) p
      LEFT JOIN {name}_cnt c ON c.id = d.{id_column} AND c.b = p.b GROUP BY d.{id_column}),
{name} AS MATERIALIZED (
  SELECT id, CASE WHEN norm > 0 THEN list_transform(e, lambda x: x / norm) ELSE e END AS u
  FROM (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM {name}_raw))
"""


TEXT_HITS = hashed("dv", "documents", "doc_id", "text") + "," + hashed("bv", "benchmark", "item_id", "text") + """,
h AS (SELECT q.id AS query_id,
             CAST(row_number() OVER (PARTITION BY q.id ORDER BY round(list_inner_product(q.u, d.u), 12) DESC, d.id) AS INTEGER) AS rank,
             d.id AS doc_id, list_inner_product(q.u, d.u) AS score
      FROM bv q, dv d QUALIFY rank <= 5)
"""

CONTENT_HITS = hashed("dv", "(SELECT doc_id, source || chr(10) || text AS content FROM documents)", "doc_id", "content") \
    + "," + hashed("bv", "benchmark", "item_id", "text")

SIZES = "z AS (SELECT unnest([count(*) * 2 // 5, count(*) * 3 // 5, count(*)]) AS sample_size FROM documents)"

ORDERED = """
j AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
o AS (SELECT d.doc_id, j.doc_id IS NOT NULL AS judged,
             row_number() OVER (ORDER BY j.doc_id IS NULL, md5('42|' || d.doc_id), d.doc_id) AS pos
      FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id)
"""

CELLS = PAIRS + """,
c AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS cell
      FROM (SELECT vec_id FROM u ORDER BY md5('42|' || vec_id), vec_id LIMIT 16)),
f AS (SELECT s.query_id AS vec_id, c.cell, round(s.score, 12) AS fit
      FROM s JOIN c ON c.vec_id = s.doc_id),
a AS (SELECT vec_id, cell, fit FROM f
      QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY fit DESC, cell) = 1),
pp AS (SELECT vec_id AS query_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY fit DESC, cell) AS place
       FROM f WHERE cell IN (SELECT cell FROM a)),
p AS (SELECT query_id, cell FROM pp WHERE place <= 12),
ph AS (SELECT s.query_id, CAST(row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.doc_id) AS INTEGER) AS rank,
              s.doc_id, s.score
       FROM s JOIN a ON a.vec_id = s.doc_id JOIN p ON p.query_id = s.query_id AND p.cell = a.cell
       QUALIFY rank <= 5),
h AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
             doc_id, score
      FROM s QUALIFY rank <= 5)
"""

TREE = PAIRS + """,
w AS (SELECT vec_id FROM u ORDER BY md5('42|' || vec_id), vec_id LIMIT 64),
t AS (SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS branch
      FROM (SELECT vec_id FROM w ORDER BY md5('42|' || vec_id), vec_id LIMIT 8)),
b AS (SELECT s.query_id AS vec_id, branch, round(s.score, 12) AS fit FROM s JOIN t ON t.vec_id = s.doc_id),
n1 AS (SELECT vec_id, branch FROM b QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY fit DESC, branch) = 1),
c AS (SELECT vec_id, branch, branch * 1048576 + row_number() OVER (PARTITION BY branch ORDER BY vec_id) - 1 AS cell
      FROM n1 SEMI JOIN w USING (vec_id)),
f AS (SELECT s.query_id AS vec_id, c.branch, c.cell, round(s.score, 12) AS fit FROM s JOIN c ON c.vec_id = s.doc_id),
a AS (SELECT f.vec_id, cell FROM f JOIN n1 USING (vec_id, branch)
      QUALIFY row_number() OVER (PARTITION BY f.vec_id ORDER BY fit DESC, cell) = 1),
qb AS (SELECT vec_id, branch FROM b WHERE branch IN (SELECT branch FROM c WHERE cell IN (SELECT cell FROM a))
       QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY fit DESC, branch) <= 7),
p AS (SELECT f.vec_id AS query_id, cell FROM f JOIN qb USING (vec_id, branch) WHERE cell IN (SELECT cell FROM a)
      QUALIFY row_number() OVER (PARTITION BY f.vec_id ORDER BY fit DESC, cell) <= 50),
ph AS (SELECT s.query_id, CAST(row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.doc_id) AS INTEGER) AS rank,
              s.doc_id, s.score
       FROM s JOIN a ON a.vec_id = s.doc_id JOIN p ON p.query_id = s.query_id AND p.cell = a.cell
       QUALIFY rank <= 5),
h AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
             doc_id, score
      FROM s QUALIFY rank <= 5)
"""

ELEMENTS = "WITH " + UNIT + """
SELECT vec_id AS doc_id, CAST(unnest(range(len(u))) AS INTEGER) AS pos, round(unnest(u), 6) AS val FROM u"""

DOC_ELEMENTS = "WITH " + hashed("dv", "documents", "doc_id", "text") + """
SELECT id AS doc_id, CAST(unnest(range(64)) AS INTEGER) AS pos, round(unnest(u), 6) AS val FROM dv"""

# Shares hold fixed-point vectors with 30 fractional bits, and their scores are exact in those.
FIXED = UNIT + """,
z AS MATERIALIZED (SELECT vec_id, list_transform(u, lambda x: CAST(round(x * 1073741824) AS BIGINT)) AS z FROM u)
"""

DOC_IDS = "SELECT CAST(vec_id AS VARCHAR) AS doc_id FROM embeddings"

LOADS = "SELECT label AS size, count(*) AS count, round(sum(vec_id) / 100.0, 2) AS seconds FROM embeddings GROUP BY label"

def benchmark_sql(asked: str) -> str:
    """NDCG of the exact backends and of 12 of 16 cells, for the queries of the relation ``asked``."""
    return "WITH " + ORDERED + "," + SIZES + "," + CONTENT_HITS + f""",
        q AS (SELECT * FROM {asked}),
        s AS MATERIALIZED (SELECT q.id AS query_id, d.id AS doc_id, round(list_inner_product(q.u, d.u), 12) AS score FROM q, dv d),
        c AS (SELECT id, u, row_number() OVER (ORDER BY CAST(id AS VARCHAR)) - 1 AS cell
              FROM (SELECT id, u FROM dv ORDER BY md5('42|' || id), id LIMIT 16)),
        a AS (SELECT dv.id AS doc_id, cell FROM dv, c
              QUALIFY row_number() OVER (PARTITION BY dv.id ORDER BY round(list_inner_product(dv.u, c.u), 12) DESC, cell) = 1),
        p AS (SELECT q.id AS query_id, cell FROM q, c WHERE cell IN (SELECT cell FROM a)
              QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(list_inner_product(q.u, c.u), 12) DESC, cell) <= 12),
        b AS (SELECT 'exact' AS method, query_id, doc_id, score FROM s
              UNION ALL SELECT 'cells', query_id, doc_id, score FROM s JOIN a USING (doc_id) JOIN p USING (query_id, cell)),
        h0 AS (SELECT method, sample_size, query_id, doc_id,
                      row_number() OVER (PARTITION BY method, sample_size, query_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank
               FROM b JOIN o USING (doc_id) JOIN z ON o.pos <= z.sample_size QUALIFY rank <= 5),
        h AS (SELECT method, sample_size, query_id, rank, CAST(contains(d.text, m.text) AS INTEGER) AS rel
              FROM h0 JOIN documents d ON d.doc_id = h0.doc_id JOIN benchmark m ON m.item_id = h0.query_id),
        """ + gains("method, sample_size, query_id", "1") + """,
        e AS (SELECT 'plain' AS backend, 'exact' AS method UNION ALL SELECT 'sealed', 'exact' UNION ALL SELECT 'cells', 'cells'),
        w AS (SELECT e.backend, z.sample_size, q.id AS query_id, coalesce(r1.ndcg, 0) AS ndcg FROM e CROSS JOIN z CROSS JOIN q
              LEFT JOIN r1 ON r1.method = e.method AND r1.sample_size = z.sample_size AND r1.query_id = q.id),
        t AS (SELECT backend, sample_size, CAST(query_id AS VARCHAR) AS query_id, ndcg FROM w
              UNION ALL SELECT backend, sample_size, 'AVERAGE', avg(ndcg) FROM w GROUP BY ALL)
        SELECT backend, CAST(sample_size AS INTEGER) AS sample_size, query_id, round(ndcg, 6) AS ndcg FROM t"""


SQL: dict[str, str] = {
    "l2_norm": "WITH " + UNIT + "SELECT vec_id, round(norm, 6) AS norm FROM u",
    "normalize_vectors": ELEMENTS,
    "cosine_pairs": "WITH " + UNIT + """
        SELECT a.vec_id, round(list_inner_product(a.u, b.u) * a.norm * b.norm, 6) AS product,
               round(list_inner_product(a.u, b.u), 6) AS similarity,
               round(1 - list_inner_product(a.u, b.u), 6) AS distance
        FROM u a JOIN u b ON b.vec_id = a.vec_id + 1""",
    "exact_topk": TOPK,
    "exact_topk_blocks": TOPK,
    "topk_distance": "WITH " + HITS + "SELECT query_id, rank, doc_id, round(1 - score, 6) AS score FROM h",
    "sealed_topk": TOPK,
    "sealed_topk_texts": "WITH " + TEXT_HITS + "SELECT query_id, rank, doc_id, round(score, 6) AS score FROM h",
    # Opened ids are texts, and equal scores rank by them.
    "sealed_hits_texts": "WITH " + TEXT_HITS.replace(", d.id) AS INTEGER", ", CAST(d.id AS VARCHAR)) AS INTEGER") + """
        SELECT query_id, rank, h.doc_id, round(score, 6) AS score, coalesce(text, '') AS content
        FROM h JOIN documents d ON d.doc_id = h.doc_id""",
    "sealed_roundtrip": ELEMENTS,
    "sealed_docids": DOC_IDS,
    "open_lenient": DOC_IDS,
    "upsert_latest": "WITH " + UNIT + """
        SELECT vec_id AS doc_id, CAST(unnest(range(len(u))) AS INTEGER) AS pos,
               round(unnest(CASE WHEN label < 5 THEN list_reverse(u) ELSE u END), 6) AS val
        FROM u""",
    "append_keeps_duplicates": """
        SELECT count(*) + count(*) FILTER (WHERE label < 5) AS n_rows, count(*) AS n_docs FROM embeddings""",
    "store_count": """
        SELECT 'plain' AS backend, count(*) AS n_rows FROM embeddings
        UNION ALL SELECT 'sealed', count(*) FROM embeddings
        UNION ALL SELECT 'missing', 0""",
    "text_dump": "SELECT text AS content FROM documents",
    "corpus_counts": "SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM labels) AS n_qrels",
    "content_build": """
        SELECT doc_id, coalesce(CASE WHEN lang = 'en' THEN NULL ELSE source END, '') || chr(10) || coalesce(text, '') AS content
        FROM documents""",
    "defaults_fill": """
        SELECT doc_id, CASE WHEN lang = 'en' THEN text WHEN n_chars > 500 THEN source ELSE '' END AS content
        FROM documents""",
    "binary_relevance": "WITH " + TEXT_HITS + """
        SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(h.doc_id AS VARCHAR) AS doc_id, rank,
               CAST(coalesce(l.quality, 0) > 0 AS INTEGER) AS rel
        FROM h LEFT JOIN labels l ON l.doc_id = h.doc_id""",
    "qrels_dedup": """
        WITH q AS (SELECT d.source, l.doc_id, l.quality AS relevance, 1 AS pos FROM labels l JOIN documents d USING (doc_id)
                   UNION ALL SELECT d.source, l.doc_id, l.toxic, 2 FROM labels l JOIN documents d USING (doc_id))
        SELECT source AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, CAST(arg_max(relevance, pos) AS INTEGER) AS relevance
        FROM q GROUP BY ALL""",
    "dcg_at_5": "WITH " + NDCG + "SELECT CAST(query_id AS VARCHAR) AS query_id, round(dcg, 6) AS dcg FROM r",
    "idcg_at_5": "WITH " + NDCG + "SELECT CAST(query_id AS VARCHAR) AS query_id, round(idcg, 6) AS idcg FROM r",
    "ndcg_per_query": "WITH " + NDCG + """
        SELECT CAST(query_id AS VARCHAR) AS query_id, array_to_string(rels, ',') AS rels, round(ndcg, 6) AS ndcg FROM r""",
    "ndcg_average": "WITH " + NDCG + "SELECT 'AVERAGE' AS query_id, round(avg(ndcg), 6) AS ndcg FROM r",
    "ndcg_csv_rows": "WITH " + NDCG + """
        SELECT CAST(query_id AS VARCHAR) AS query_id, '[' || array_to_string(rels, ', ') || ']' AS rels,
               printf('%.6f', ndcg::DOUBLE) AS "NDCG@5" FROM r
        UNION ALL SELECT 'AVERAGE', '[''-'', ''-'', ''-'', ''-'', ''-'']', printf('%.6f', avg(ndcg)::DOUBLE) FROM r""",
    "nested_results": "WITH " + HITS + """
        SELECT query_id, len(list(doc_id)) AS n_hits, array_to_string(list(doc_id ORDER BY rank), ',') AS doc_ids,
               round(sum(score), 6) AS total FROM h GROUP BY query_id""",
    "json_results": "WITH " + HITS + """
        SELECT CAST(query_id AS VARCHAR) AS query_id, rank, CAST(doc_id AS VARCHAR) AS doc_id, round(score, 6) AS score FROM h""",
    "json_embeddings": ELEMENTS,
    "json_array_embeddings": ELEMENTS,
    "trec_qrels": """
        SELECT source AS query_id, CAST(l.doc_id AS VARCHAR) AS doc_id, CAST(quality AS INTEGER) AS relevance
        FROM labels l JOIN documents d USING (doc_id)""",
    "judged_semi": "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "unjudged_anti": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "distinct_judged": "SELECT DISTINCT doc_id FROM labels WHERE quality = 1",
    "sample_judged_first": "WITH " + ORDERED + """
        SELECT doc_id, judged FROM o WHERE pos <= (SELECT count(*) * 2 // 5 FROM documents)""",
    "sample_reservoir": "WITH " + ORDERED + """
        SELECT doc_id FROM o WHERE pos <= (SELECT count(*) * 3 // 5 FROM documents)""",
    "sample_sweep": "WITH " + ORDERED + "," + SIZES + """
        SELECT CAST(sample_size AS INTEGER) AS sample_size, doc_id, judged FROM o JOIN z ON pos <= sample_size""",
    "limit_queries": "SELECT vec_id AS query_id FROM embeddings ORDER BY vec_id LIMIT (SELECT count(*) // 3 FROM embeddings)",
    "limit_docs": "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT (SELECT count(*) // 2 FROM documents)",
    "hashed_embedding": DOC_ELEMENTS,
    "embed_batches": DOC_ELEMENTS,
    "hashed_search": "WITH " + TEXT_HITS + "SELECT query_id, rank, doc_id, round(score, 6) AS score FROM h",
    "passage_ndcg": "WITH " + TEXT_HITS.replace("h AS (", "h0 AS (") + """,
        h AS (SELECT query_id, rank, CAST(contains(d.text, b.text) AS INTEGER) AS rel
              FROM h0 JOIN documents d ON d.doc_id = h0.doc_id JOIN benchmark b ON b.item_id = h0.query_id),
        """ + gains("query_id") + """
        SELECT CAST(query_id AS VARCHAR) AS query_id, round(ndcg, 6) AS ndcg FROM r
        UNION ALL SELECT 'AVERAGE', round(avg(ndcg), 6) FROM r""",
    "ivf_assign": "WITH " + CELLS + "SELECT vec_id AS doc_id, CAST(cell AS INTEGER) AS cell, round(fit, 6) AS fit FROM a",
    "ivf_topk": TOPK,
    "ivf_probe_topk": "WITH " + CELLS + "SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ph",
    "ivf_join_topk": "WITH " + CELLS + "SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ph",
    # An exact hit is found as soon as its cell is probed; the probes are those of least recall 0.9 on 500 queries.
    "ivf_measured_topk": "WITH " + CELLS + """,
        w AS (SELECT vec_id AS query_id FROM embeddings ORDER BY md5('42|' || vec_id), vec_id LIMIT 500),
        t AS (SELECT unnest([1, 2, 4, 8, 16]) AS n),
        y AS (SELECT n, avg(CAST(place <= n AS INTEGER)) AS recall
              FROM t, h JOIN w USING (query_id) JOIN a ON a.vec_id = h.doc_id JOIN pp ON pp.query_id = h.query_id AND pp.cell = a.cell
              GROUP BY n),
        m AS (SELECT n, recall FROM y WHERE recall >= 0.9 ORDER BY n LIMIT 1)
        SELECT s.query_id, CAST(row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.doc_id) AS INTEGER) AS rank,
               s.doc_id, round(s.score, 6) AS score, CAST(m.n AS INTEGER) AS nprobe, round(m.recall, 6) AS recall
        FROM s JOIN a ON a.vec_id = s.doc_id JOIN pp ON pp.query_id = s.query_id AND pp.cell = a.cell JOIN m ON pp.place <= m.n
        QUALIFY rank <= 5""",
    "ivf_recall": "WITH " + CELLS + """
        SELECT h.query_id, count(ph.doc_id) / count(*) AS recall
        FROM h LEFT JOIN ph ON ph.query_id = h.query_id AND ph.doc_id = h.doc_id GROUP BY h.query_id""",
    "ivf_trained_topk": TOPK,
    "ivf_two_level_topk": "WITH " + TREE + "SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ph",
    "ivf_two_level_recall": "WITH " + TREE + """
        SELECT h.query_id, count(ph.doc_id) / count(*) AS recall
        FROM h LEFT JOIN ph ON ph.query_id = h.query_id AND ph.doc_id = h.doc_id GROUP BY h.query_id""",
    # Sixteen parts of four dimensions; the words of a part are those of the 64 vectors of lowest hash, in the order of ids.
    "code_recall": "WITH " + PAIRS + """,
        m AS (SELECT vec_id, p, u[4 * p + 1:4 * p + 4] AS x FROM u, (SELECT unnest(range(16)) AS p)),
        w AS (SELECT vec_id AS word, p, x AS w FROM m
              WHERE vec_id IN (SELECT vec_id FROM u ORDER BY md5('42|' || vec_id), vec_id LIMIT 64)),
        c AS (SELECT vec_id, m.p, word FROM m JOIN w ON m.p = w.p
              QUALIFY row_number() OVER (PARTITION BY vec_id, m.p
                  ORDER BY round(list_inner_product(x, x) - 2 * list_inner_product(x, w) + list_inner_product(w, w), 12), word) = 1),
        l AS (SELECT m.vec_id AS query_id, m.p, word, list_inner_product(x, w) AS part
              FROM m JOIN w ON m.p = w.p WHERE m.vec_id % 20 = 0),
        r AS (SELECT query_id, vec_id AS doc_id, round(sum(part), 12) AS near FROM l JOIN c ON c.p = l.p AND c.word = l.word GROUP BY ALL),
        k AS (SELECT query_id, doc_id FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY near DESC, doc_id) <= 100),
        f AS (SELECT query_id, doc_id, score FROM s JOIN k USING (query_id, doc_id)
              QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5),
        h AS (SELECT query_id, doc_id FROM s WHERE query_id % 20 = 0
              QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5)
        SELECT h.query_id, count(f.doc_id) / count(*) AS recall, round(sum(z.total), 6) AS total
        FROM h LEFT JOIN f USING (query_id, doc_id)
        JOIN (SELECT query_id, sum(score) / 5 AS total FROM f GROUP BY query_id) z ON z.query_id = h.query_id GROUP BY h.query_id""",
    "ndcg_compare": "WITH " + CELLS + """,
        lh AS (SELECT h.*, CAST(q.label = d.label AS INTEGER) AS rel FROM h
               JOIN u q ON q.vec_id = h.query_id JOIN u d ON d.vec_id = h.doc_id),
        lp AS (SELECT ph.*, CAST(q.label = d.label AS INTEGER) AS rel FROM ph
               JOIN u q ON q.vec_id = ph.query_id JOIN u d ON d.vec_id = ph.doc_id),
        """ + gains("query_id", "1", "lh") + "," + gains("query_id", "2", "lp") + """,
        b AS (SELECT CAST(query_id AS VARCHAR) AS query_id, r1.ndcg AS x, r2.ndcg AS y FROM r1 JOIN r2 USING (query_id)
              UNION ALL SELECT 'AVERAGE', (SELECT avg(ndcg) FROM r1), (SELECT avg(ndcg) FROM r2))
        SELECT query_id, round(x, 6) AS left_ndcg, round(y, 6) AS right_ndcg, round(y - x, 6) AS ndcg_gap FROM b""",
    "share_roundtrip": "WITH " + FIXED + """
        SELECT vec_id AS doc_id, CAST(unnest(range(len(z))) AS INTEGER) AS pos, round(unnest(z) / 1073741824.0, 6) AS val FROM z""",
    "share_topk": "WITH " + FIXED + """,
        s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id,
                     list_sum(list_transform(list_zip(q.z, d.z), lambda p: p[1]::HUGEINT * p[2])) AS dot
              FROM z q, z d)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, doc_id) AS INTEGER) AS rank,
               doc_id, round(CAST(dot AS DOUBLE) / 1152921504606846976.0, 6) AS score
        FROM s QUALIFY rank <= 5""",
    "share_probe_topk": "WITH " + CELLS + """,
        z AS MATERIALIZED (SELECT vec_id, list_transform(u, lambda x: CAST(round(x * 1073741824) AS BIGINT)) AS z FROM u),
        d AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id,
                     list_sum(list_transform(list_zip(q.z, d.z), lambda p: p[1]::HUGEINT * p[2])) AS dot
              FROM z q JOIN p ON p.query_id = q.vec_id JOIN a ON a.cell = p.cell JOIN z d ON d.vec_id = a.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, doc_id) AS INTEGER) AS rank,
               doc_id, round(CAST(dot AS DOUBLE) / 1152921504606846976.0, 6) AS score
        FROM d QUALIFY rank <= 5""",
    "load_log_format": "WITH l AS (" + LOADS + """)
        SELECT printf('[%d] count=%d, time=%.2fs', CAST(size AS BIGINT), count, CAST(seconds AS DOUBLE)) AS value FROM l""",
    "load_log_parse": "WITH l AS (" + LOADS + """)
        SELECT CAST(size AS INTEGER) AS size, count, CAST(seconds AS DOUBLE) AS seconds FROM l""",
    "ingest_metrics": """
        SELECT unnest(['total_time', 'wall_clock_time']) AS metric, count(*) AS n_docs FROM embeddings""",
    "ingest_observed": "WITH " + ORDERED + "," + SIZES + """,
        g AS (SELECT sample_size, count(*)::DOUBLE AS n, sum(n_chars / 1000.0::DOUBLE) AS t
              FROM o JOIN documents USING (doc_id) JOIN z ON pos <= sample_size GROUP BY sample_size)
        SELECT CAST(sample_size AS INTEGER) AS sample_size, 'n_docs' AS metric, n AS value FROM g
        UNION ALL SELECT CAST(sample_size AS INTEGER), 'embed_time', round(t, 3) FROM g""",
    "load_observed": "WITH " + ORDERED + "," + SIZES + """
        SELECT CAST(sample_size AS INTEGER) AS size, count(*) AS count FROM o JOIN z ON pos <= sample_size GROUP BY sample_size""",
    "skip_guard": "SELECT true AS first_run, false AS second_run, count(*) AS n_rows FROM embeddings",
    "backend_compare": "WITH " + CELLS + """
        SELECT query_id, count(*) FILTER (h.doc_id IS NOT NULL AND ph.doc_id IS NOT NULL) / 5.0::DOUBLE AS overlap,
               round(max(abs(h.score - ph.score)), 6) AS score_gap
        FROM h FULL JOIN ph USING (query_id, doc_id) GROUP BY query_id""",
    "limit_repeated": "SELECT n_chars, source FROM documents ORDER BY n_chars, source LIMIT (SELECT count(*) // 3 FROM documents)",
    "ingest_first_n": "SELECT vec_id AS doc_id FROM embeddings ORDER BY vec_id DESC LIMIT (SELECT count(*) // 4 FROM embeddings)",
    "ndcg_with_missing": "WITH " + CELLS + """,
        lh AS (SELECT h.*, CAST(q.label = d.label AS INTEGER) AS rel FROM h
               JOIN u q ON q.vec_id = h.query_id JOIN u d ON d.vec_id = h.doc_id WHERE h.query_id % 2 = 0),
        """ + gains("query_id", "1", "lh") + """,
        m AS (SELECT CAST(vec_id AS VARCHAR) AS query_id, coalesce(r1.ndcg, 0) AS ndcg
              FROM embeddings LEFT JOIN r1 ON r1.query_id = vec_id)
        SELECT query_id, round(ndcg, 6) AS ndcg FROM m UNION ALL SELECT 'AVERAGE', round(avg(ndcg), 6) FROM m""",
    "keyless_roundtrip": ELEMENTS,
    "new_ids": """
        SELECT count(*) AS n_rows, count(*) AS n_ids, count(*) FILTER (WHERE label < 5) AS n_given FROM embeddings""",
    "sized_files": "WITH " + SIZES + """
        SELECT CAST(sample_size AS INTEGER) AS size, sample_size AS n_docs, (SELECT count(*) FROM benchmark) AS n_queries FROM z""",
    "repeated_queries": "WITH " + HITS + "SELECT query_id, rank, doc_id, round(score, 6) AS score, true AS refused FROM h",
    "embed_once": DOC_ELEMENTS,
    "stream_ingest": ELEMENTS,
    "stream_search": TOPK,
    "benchmark_sweep": benchmark_sql("bv"),
    "benchmark_limited": benchmark_sql("bv ORDER BY id LIMIT 10"),
}
SQL["stream_upsert"] = SQL["upsert_latest"]
