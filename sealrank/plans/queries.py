"""The registered queries: each operator of the engine over whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealrank.functions.sealing import load_key, open_text, save_key
from sealrank.functions.text import content, first_text
from sealrank.functions.vectors import cosine, distance, dot, l2_norm, normalize, widen
from sealrank.operators import cell_tree, cells, codes, evaluation, sampling, shares
from sealrank.operators.embedding import deal_out, embed_distinct, embed_hashed, hashed_embedding, hashed_model
from sealrank.operators.packing import unpack_vectors
from sealrank.operators.search import search, without_self
from sealrank.operators.selection import first_rows
from sealrank.plans import pipeline
from sealrank.session import bound_batches, materialize, new_path, ship_package
from sealrank.sources import readers, writers
from sealrank.sources.stores import PlainStore, SealedStore
from sealrank.streaming.jobs import ingest_stream, read_stream, search_stream, table_stream, upsert_stream

K = 5
# The vectors have little structure: twelve of sixteen cells hold 0.9 of the true neighbours, see ivf_recall.
CELLS, PROBES = 16, 12
CODE_PARTS, CODE_WORDS, SURVIVORS = 16, 64, 100
TREE_CELLS, BRANCHES, BRANCH_PROBES, TREE_PROBES = 64, 8, 7, 50
LIMIT = 10
# Any 32 bytes do; on a cluster the caller brings a key table of their own.
DEMO_KEY = bytes(range(32))

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        bound_batches(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The embeddings as queries and as documents."""
    rows = table(spark, sf_dir, "embeddings")
    return (
        rows.select(F.col("vec_id").alias("query_id"), "embedding"),
        rows.select(F.col("vec_id").alias("doc_id"), "embedding", "label"),
    )


_key_paths: dict[str, str] = {}


def demo_key(spark: SparkSession) -> DataFrame:
    app = spark.sparkContext.applicationId
    if app not in _key_paths:
        _key_paths[app] = save_key(spark, DEMO_KEY, new_path(spark, "key"))
    return load_key(spark, _key_paths[app])


def sealed_store(spark: SparkSession, docs: DataFrame) -> SealedStore:
    store = SealedStore(spark, new_path(spark, "sealed"), demo_key(spark))
    store.add(docs, version=0)
    return store


def labelled(docs: DataFrame) -> DataFrame:
    """Documents of the embeddings table with their label as content."""
    return docs.select("doc_id", "embedding", F.col("label").cast("string").alias("content"))


def rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


def numbered(hits: DataFrame) -> DataFrame:
    """Opened ids are text; the tables count them."""
    return rounded(hits.withColumn("doc_id", F.col("doc_id").cast("bigint")))


def elements(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.posexplode("embedding").alias("pos", "val")).withColumn(
        "val", F.round("val", 6)
    )


def good_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("quality = 1")


def sizes(docs: DataFrame) -> list[int]:
    n = docs.count()
    return [n * 2 // 5, n * 3 // 5, n]


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark passages as embedded queries."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return embed_hashed(rows, "text")


def text_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages searched in the documents by their hashed embeddings."""
    docs = embed_hashed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", spread=True)
    return search(passages(spark, sf_dir), docs, K)


def label_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest other vectors, relevant where the label is that of the query. Labels are
    joined to the hits, so no pair is formed that was not retrieved."""
    queries, docs = vectors(spark, sf_dir)
    return by_label(without_self(search(queries, docs, K + 1), K), docs)


def by_label(hits: DataFrame, docs: DataFrame) -> DataFrame:
    labels = docs.select("doc_id", "label")
    return (
        hits.join(labels, "doc_id")
        .join(labels.select(F.col("doc_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")
        .select(
            F.col("query_id").cast("string").alias("query_id"), "rank", "doc_id", "score",
            (F.col("label") == F.col("query_label")).cast("int").alias("rel"),
        )
    )


def pooled_judgements(hits: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge each retrieved pair: relevant where the document holds the passage."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    asked = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("passage")
    )
    pairs = hits.select(*[F.col(c).cast("string").alias(c) for c in ("query_id", "doc_id")]).distinct()
    return pairs.join(docs, "doc_id").join(asked, "query_id").select(
        "query_id", "doc_id", F.contains("text", "passage").cast("int").alias("relevance")
    )


# Vectors


@query
def l2_norm_query(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.round(l2_norm(widen(F.col("embedding"))), 6).alias("norm"))


@query
def normalize_vectors(spark, sf_dir):
    _, docs = vectors(spark, sf_dir)
    return elements(docs.select("doc_id", normalize(widen(F.col("embedding"))).alias("embedding")))


@query
def cosine_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", widen(F.col("embedding")).alias("a"))
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    score = rows.join(following, "vec_id").select(
        "vec_id", dot(F.col("a"), F.col("b")).alias("product"), cosine(F.col("a"), F.col("b")).alias("score")
    )
    return score.select(
        "vec_id", F.round("product", 6).alias("product"), F.round("score", 6).alias("similarity"), F.round(distance(F.col("score")), 6).alias("distance")
    )


# Search


@query
def exact_topk(spark, sf_dir):
    return rounded(search(*vectors(spark, sf_dir), K))


@query
def exact_topk_blocks(spark, sf_dir):
    """A query table over the bound of a block, answered block by block."""
    return rounded(search(*vectors(spark, sf_dir), K, query_rows=256))


@query
def topk_distance(spark, sf_dir):
    queries, docs = vectors(spark, sf_dir)
    store = PlainStore(spark, new_path(spark, "plain"))
    store.add(labelled(docs))
    return numbered(pipeline.evaluate_plain(queries, store, K))


@query
def sealed_topk(spark, sf_dir):
    queries, docs = vectors(spark, sf_dir)
    return numbered(pipeline.evaluate_sealed(queries, sealed_store(spark, labelled(docs)), K))


@query
def sealed_topk_texts(spark, sf_dir):
    docs = embed_hashed(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), "content")
    # The id order of equal scores is that of the numbers, as in the table.
    opened = sealed_store(spark, docs).vectors().withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rounded(search(passages(spark, sf_dir), opened, K))


@query
def sealed_hits_texts(spark, sf_dir):
    """Hits with the texts of their documents; ids and texts are opened for the hits only."""
    docs = embed_hashed(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), "content")
    hits = pipeline.evaluate_sealed(passages(spark, sf_dir), sealed_store(spark, docs), K, texts=True)
    return numbered(hits)


@query
def sealed_roundtrip(spark, sf_dir):
    _, docs = vectors(spark, sf_dir)
    return elements(unpack_vectors(sealed_store(spark, labelled(docs)).vectors().select("doc_id", "vector")))


@query
def keyless_roundtrip(spark, sf_dir):
    """A store without a key: its columns hold plain bytes, and read back the same."""
    _, docs = vectors(spark, sf_dir)
    store = SealedStore(spark, new_path(spark, "open"), None)
    store.add(labelled(docs))
    readable = store.read().filter(F.col("id_enc").cast("string").cast("bigint").isNotNull())
    return elements(unpack_vectors(store.vectors(readable).select("doc_id", "vector")))


@query
def new_ids(spark, sf_dir):
    """Vectors of half the labels come without an id, and each gets a new one."""
    _, docs = vectors(spark, sf_dir)
    store = PlainStore(spark, new_path(spark, "plain"))
    store.add(labelled(docs.withColumn("doc_id", F.when(F.col("label") < 5, F.col("doc_id")))))
    return store.ids().agg(
        F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("n_ids"), F.count_if(F.col("doc_id").rlike("^[0-9]+$")).alias("n_given")
    )


@query
def sized_files(spark, sf_dir):
    """Embeddings of each sample in a file named after its size, and their queries beside them."""
    docs = table(spark, sf_dir, "documents")
    wanted = sizes(docs)
    sampled = sampling.sample_sweep(sampling.sample_ids(docs, good_docs(spark, sf_dir), wanted), wanted)
    pattern = new_path(spark, "sized") + "/doc_embeddings_{size}.json"
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    counts = []
    for size in wanted:
        path = writers.sized_path(pattern, size)
        writers.write_embeddings(sampled.filter(F.col("sample_size") == size).select("doc_id"), path, fmt="json")
        writers.write_embeddings(asked, writers.query_path(path), fmt="json")
        found = spark.read.schema("doc_id STRING").json(path).agg(F.lit(size).alias("size"), F.count("*").alias("n_docs"))
        queries = spark.read.schema("query_id STRING").json(writers.query_path(path)).agg(F.count("*").alias("n_queries"))
        counts.append(found.select("size", "n_docs", queries.scalar().alias("n_queries")))
    return functools.reduce(DataFrame.unionByName, counts)


@query
def repeated_queries(spark, sf_dir):
    """Queries that share an id are an error, and hits go with ids and not with positions."""
    queries, docs = vectors(spark, sf_dir)
    try:
        search(queries.union(queries.filter("query_id = 1")), docs, K)
        refused = False
    except ValueError:
        refused = True
    hits = search(queries.orderBy(F.desc("query_id")), docs, K)
    return rounded(hits).withColumn("refused", F.lit(refused))


@query
def sealed_docids(spark, sf_dir):
    _, docs = vectors(spark, sf_dir)
    path = new_path(spark, "ids")
    writers.write_ids(sealed_store(spark, labelled(docs)).ids(), path)
    return spark.read.schema("doc_id STRING").json(path)


@query
def open_lenient(spark, sf_dir):
    """A store with some ids left unsealed: those come back as they are."""
    _, docs = vectors(spark, sf_dir)
    store = sealed_store(spark, labelled(docs))
    tied = F.col("doc_key")
    label = open_text(F.col("text_enc"), store.key, tied)
    raw = open_text(F.col("id_enc"), store.key, tied).cast("binary")
    mixed = store.read().withColumn("id_enc", F.when(label < "5", raw).otherwise(F.col("id_enc")))
    return materialize(mixed, "mixed").select(open_text(F.col("id_enc"), store.key, tied, lenient=True).alias("doc_id"))


def twice_added(spark, sf_dir) -> SealedStore:
    _, docs = vectors(spark, sf_dir)
    store = sealed_store(spark, labelled(docs))
    store.add(labelled(docs.filter("label < 5").withColumn("embedding", F.reverse("embedding"))), version=1)
    return store


@query
def upsert_latest(spark, sf_dir):
    store = twice_added(spark, sf_dir)
    return elements(unpack_vectors(store.vectors(store.latest()).select("doc_id", "vector")))


@query
def append_keeps_duplicates(spark, sf_dir):
    rows = twice_added(spark, sf_dir).read().groupBy("doc_key").count()
    return rows.agg(F.sum("count").alias("n_rows"), F.count("*").alias("n_docs"))


@query
def store_count(spark, sf_dir):
    _, docs = vectors(spark, sf_dir)
    plain = PlainStore(spark, new_path(spark, "plain"))
    plain.add(labelled(docs))
    stores = {
        "plain": plain, "sealed": sealed_store(spark, labelled(docs)),
        "missing": PlainStore(spark, new_path(spark, "none")),
    }
    counts = [s.read().agg(F.lit(name).alias("backend"), F.count("*").alias("n_rows")) for name, s in stores.items()]
    return functools.reduce(DataFrame.unionByName, counts)


@query
def text_dump(spark, sf_dir):
    docs = contents(spark, sf_dir)
    store, path = PlainStore(spark, new_path(spark, "plain")), new_path(spark, "dump")
    store.add(embed_hashed(docs, "content", spread=True))
    writers.write_ids(store.content(), path)
    return spark.read.schema("content STRING").json(path)


# Corpus


@query
def corpus_counts(spark, sf_dir):
    docs, qrels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    n_docs, n_qrels = docs.agg(F.count("*").alias("n_docs")), qrels.agg(F.count("*").alias("n_qrels"))
    return n_docs.select("n_docs", n_qrels.scalar().alias("n_qrels"))


@query
def content_build(spark, sf_dir):
    title = F.when(F.col("lang") != "en", F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", content(title, F.col("text")).alias("content"))


@query
def defaults_fill(spark, sf_dir):
    documents = F.when(F.col("lang") == "en", F.col("text"))
    texts = F.when(F.col("n_chars") > 500, F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", first_text(documents, texts).alias("content"))


@query
def judged_semi(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sampling.keep(docs, sampling.judged_ids(good_docs(spark, sf_dir)))


@query
def unjudged_anti(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sampling.leave_out(docs, sampling.judged_ids(good_docs(spark, sf_dir)))


@query
def distinct_judged(spark, sf_dir):
    return sampling.judged_ids(good_docs(spark, sf_dir))


@query
def sample_judged_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return sampling.sample_ids(docs, good_docs(spark, sf_dir), sizes(docs)[:1]).select("doc_id", "judged")


@query
def sample_reservoir(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    picked = sampling.sample_ids(docs, good_docs(spark, sf_dir), sizes(docs)[1:2], intersect_corpus=False)
    path = new_path(spark, "sampled")
    writers.write_ids(picked.select("doc_id"), path)
    return spark.read.schema("doc_id BIGINT").json(path).orderBy("doc_id")


@query
def sample_sweep(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    wanted = sizes(docs)
    return sampling.sample_sweep(sampling.sample_ids(docs, good_docs(spark, sf_dir), wanted), wanted)


@query
def limit_queries(spark, sf_dir):
    asked = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("query_pos"))
    return pipeline.first_queries(asked, asked.count() // 3).select("query_id")


@query
def limit_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("doc_id").alias("doc_pos"))
    return first_rows(docs, "doc_pos", "doc_id", docs.count() // 2).select("doc_id", "text")


@query
def limit_repeated(spark, sf_dir):
    """Exactly a third of the rows, though keys repeat."""
    docs = table(spark, sf_dir, "documents").select("n_chars", "source")
    return first_rows(docs, "n_chars", "source", docs.count() // 3)


@query
def ingest_first_n(spark, sf_dir):
    _, docs = vectors(spark, sf_dir)
    store = SealedStore(spark, new_path(spark, "sealed"), demo_key(spark))
    pipeline.ingest_sealed(labelled(docs).withColumn("doc_pos", -F.col("doc_id")), store, n=docs.count() // 4)
    return store.ids().select(F.col("doc_id").cast("bigint").alias("doc_id"))


# Embedding


@query
def hashed_embedding_query(spark, sf_dir):
    docs = deal_out(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # Exploding the expression itself would repeat it in the filter Spark infers for it.
    embedded = docs.select("doc_id", hashed_embedding(F.col("text")).alias("embedding"))
    return elements(materialize(embedded, "hashed"))


@query
def embed_batches(spark, sf_dir):
    return elements(embed_hashed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", spread=True))


@query
def embed_once(spark, sf_dir):
    """Each distinct text embedded once, its vector given to all its rows."""
    return elements(embed_distinct(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", hashed_model(), 4096))


@query
def hashed_search(spark, sf_dir):
    return rounded(text_hits(spark, sf_dir))


# Evaluation


@query
def binary_relevance(spark, sf_dir):
    hits = materialize(text_hits(spark, sf_dir), "hits")
    qrels = hits.join(table(spark, sf_dir, "labels"), "doc_id").select(
        "query_id", "doc_id", F.col("quality").alias("relevance")
    )
    return evaluation.judge(hits, qrels).select("query_id", "doc_id", "rank", "rel")


@query
def qrels_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    one = rows.select(F.col("source").alias("query_id"), "doc_id", F.col("quality").alias("relevance"), F.lit(1).alias("pos"))
    two = rows.select(F.col("source").alias("query_id"), "doc_id", F.col("toxic").alias("relevance"), F.lit(2).alias("pos"))
    return evaluation.last_judgement(one.unionByName(two))


@query
def dcg_at_5(spark, sf_dir):
    return evaluation.query_ndcg(label_hits(spark, sf_dir), K).select("query_id", F.round("dcg", 6).alias("dcg"))


@query
def idcg_at_5(spark, sf_dir):
    return evaluation.query_ndcg(label_hits(spark, sf_dir), K).select("query_id", F.round("idcg", 6).alias("idcg"))


@query
def ndcg_per_query(spark, sf_dir):
    return evaluation.query_ndcg(label_hits(spark, sf_dir), K).select(
        "query_id", F.array_join(F.col("rels").cast("array<string>"), ",").alias("rels"), F.round("ndcg", 6).alias("ndcg")
    )


@query
def ndcg_average(spark, sf_dir):
    report = evaluation.ndcg_report(label_hits(spark, sf_dir), K).filter(F.col("query_id") == evaluation.AVERAGE)
    return report.select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query
def ndcg_csv_rows(spark, sf_dir):
    path = new_path(spark, "ndcg")
    writers.write_ndcg(evaluation.ndcg_report(label_hits(spark, sf_dir), K), path, K)
    return spark.read.schema("query_id STRING, rels STRING, `NDCG@5` STRING").option("header", True).csv(path)


@query
def passage_ndcg(spark, sf_dir):
    hits = materialize(text_hits(spark, sf_dir), "hits")
    judged = evaluation.judge(hits, pooled_judgements(hits, spark, sf_dir))
    return evaluation.ndcg_report(judged, K).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query
def ndcg_with_missing(spark, sf_dir):
    """Every second query finds nothing, and counts as 0."""
    queries, docs = vectors(spark, sf_dir)
    path, asked = new_path(spark, "missing"), queries.select("query_id")
    writers.write_results(search(queries, docs, K).filter("query_id % 2 = 0").withColumn("backend", F.lit("plain")),
                          path, asked.withColumn("backend", F.lit("plain")))
    hits = readers.read_results(spark, path)
    labels = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "label")
    own = labels.select(F.col("doc_id").alias("query_id"), F.col("label").alias("own"))
    same = hits.join(labels, "doc_id", "left").join(own, "query_id").withColumn("rel", F.coalesce((F.col("label") == F.col("own")).cast("int"), F.lit(0)))
    return evaluation.ndcg_report(same, K).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query
def nested_results(spark, sf_dir):
    nested = writers.nest_results(search(*vectors(spark, sf_dir), K))
    return nested.select(
        "query_id", F.size("results").cast("bigint").alias("n_hits"),
        F.array_join(F.col("results.doc_id").cast("array<string>"), ",").alias("doc_ids"),
        F.round(F.aggregate("results.score", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


@query
def json_results(spark, sf_dir):
    path = new_path(spark, "results")
    hits = search(*vectors(spark, sf_dir), K)
    writers.write_results(hits.withColumn("backend", F.lit("plain")), path)
    return rounded(readers.read_results(spark, path).select("query_id", "rank", "doc_id", "score"))


@query
def json_embeddings(spark, sf_dir):
    """Embeddings written as JSON, read back, loaded into the plain store."""
    _, docs = vectors(spark, sf_dir)
    path = new_path(spark, "json")
    wide = labelled(docs).withColumn("embedding", widen(F.col("embedding"))).withColumn("embed_time", F.lit(0.0))
    writers.write_embeddings(wide, path, fmt="json")
    store = PlainStore(spark, new_path(spark, "plain"))
    pipeline.load_plain(readers.read_doc_embeddings(spark, path, "json"), store)
    return elements(store.vectors().withColumn("embedding", normalize(F.col("embedding"))))


@query
def json_array_embeddings(spark, sf_dir):
    """Embeddings as JSON arrays, each cut into byte ranges and read in parallel, loaded into the plain store."""
    _, docs = vectors(spark, sf_dir)
    lines, arrays = new_path(spark, "json"), new_path(spark, "arrays")
    writers.write_embeddings(labelled(docs).withColumn("embedding", widen(F.col("embedding"))), lines, fmt="json")
    writers.write_json_arrays(spark.read.text(lines), arrays)
    store = PlainStore(spark, new_path(spark, "plain"))
    pipeline.load_plain(readers.read_doc_embeddings(spark, arrays, "json_array"), store)
    return elements(store.vectors().withColumn("embedding", normalize(F.col("embedding"))))


@query
def trec_qrels(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    path = new_path(spark, "trec")
    rows.select(F.concat_ws(" ", "source", F.lit("0"), "doc_id", "quality").alias("value")).write.text(path)
    return readers.read_qrels(spark, path, "trec")


# Cell index


def built_cells(spark, sf_dir) -> str:
    path = new_path(spark, "cells")
    cells.build_cells(vectors(spark, sf_dir)[1], path, CELLS)
    return path


@query
def ivf_assign(spark, sf_dir):
    rows = spark.read.parquet(f"{built_cells(spark, sf_dir)}/vectors")
    return rows.select("doc_id", F.col("cell").cast("int").alias("cell"), F.round("fit", 6).alias("fit"))


@query
def ivf_topk(spark, sf_dir):
    return rounded(cells.search_cells(vectors(spark, sf_dir)[0], built_cells(spark, sf_dir), K, PROBES))


@query
def ivf_probe_topk(spark, sf_dir):
    return rounded(cells.search_cells(vectors(spark, sf_dir)[0], built_cells(spark, sf_dir), K, PROBES, exact=False))


@query
def ivf_join_topk(spark, sf_dir):
    """More queries than go to every task: queries and vectors meet by cell."""
    return rounded(cells.search_cells(vectors(spark, sf_dir)[0], built_cells(spark, sf_dir), K, PROBES, exact=False, query_rows=64))


@query
def ivf_measured_topk(spark, sf_dir):
    """As many probes as reach 0.9 of the exact hits, with that number and its recall."""
    queries, docs = vectors(spark, sf_dir)
    path = built_cells(spark, sf_dir)
    nprobe, recall = pipeline.measured_probes(queries, docs, path, K)
    hits = rounded(cells.search_cells(queries, path, K, nprobe, exact=False))
    return hits.withColumns({"nprobe": F.lit(nprobe), "recall": F.round(F.lit(recall), 6)})


@query
def ivf_recall(spark, sf_dir):
    queries, docs = vectors(spark, sf_dir)
    found = cells.search_cells(queries, built_cells(spark, sf_dir), K, PROBES, exact=False)
    return evaluation.recall_at_k(found, search(queries, docs, K))


@query
def ivf_trained_topk(spark, sf_dir):
    queries, docs = vectors(spark, sf_dir)
    path = new_path(spark, "cells")
    cells.build_cells(docs, path, CELLS, rounds=5)
    return rounded(cells.search_cells(queries, path, K, PROBES))


def tree_hits(spark, sf_dir, **options) -> DataFrame:
    queries, docs = vectors(spark, sf_dir)
    path = new_path(spark, "tree")
    cell_tree.build_tree(docs, path, TREE_CELLS, BRANCHES)
    return cell_tree.search_tree(queries, path, K, BRANCH_PROBES, TREE_PROBES, **options)


@query
def ivf_two_level_topk(spark, sf_dir):
    return rounded(tree_hits(spark, sf_dir, query_rows=64))


@query
def ivf_two_level_recall(spark, sf_dir):
    return evaluation.recall_at_k(tree_hits(spark, sf_dir), search(*vectors(spark, sf_dir), K))


@query
def code_recall(spark, sf_dir):
    """Recall of the search by codes, on the queries whose ids are divisible by 20, and its hits' total score."""
    queries, docs = vectors(spark, sf_dir)
    asked = queries.filter("query_id % 20 = 0")
    codes.build_codes(docs.select("doc_id", "embedding"), path := new_path(spark, "codes"), CODE_PARTS, CODE_WORDS)
    found = materialize(codes.search_codes(asked, path, K, SURVIVORS), "found")
    totals = found.groupBy("query_id").agg(F.round(F.sum("score"), 6).alias("total"))
    return evaluation.recall_at_k(found, search(asked, docs, K)).join(totals, "query_id")


@query
def ndcg_compare(spark, sf_dir):
    """NDCG of the full search against that of the approximate one, per query and average."""
    queries, docs = vectors(spark, sf_dir)
    probed = cells.search_cells(queries, built_cells(spark, sf_dir), K, PROBES, exact=False)
    reports = (evaluation.ndcg_report(by_label(h, docs), K) for h in (search(queries, docs, K), probed))
    gaps = evaluation.compare_ndcg(*reports)
    return gaps.select("query_id", *[F.round(c, 6).alias(c) for c in ("left_ndcg", "right_ndcg", "ndcg_gap")])


# Shares


@query
def share_roundtrip(spark, sf_dir):
    _, docs = vectors(spark, sf_dir)
    first, second = (materialize(shares.split_vectors(docs, demo_key(spark), i), f"share{i}") for i in (0, 1))
    return elements(shares.join_shares(first, second))


@query
def share_topk(spark, sf_dir):
    queries, docs = vectors(spark, sf_dir)
    first, second = (materialize(shares.split_vectors(docs, demo_key(spark), i), f"share{i}") for i in (0, 1))
    return rounded(shares.search_shares(queries, first, second, K))


@query
def share_probe_topk(spark, sf_dir):
    """Share tables laid out by cell: only the documents of the probed cells are scored."""
    queries, docs = vectors(spark, sf_dir)
    path = new_path(spark, "share-cells")
    shares.build_share_cells(docs, demo_key(spark), path, CELLS)
    return rounded(shares.search_share_cells(queries, path, K, PROBES))


# Runs


def loads(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("size")).agg(
        F.count("*").alias("count"), F.round(F.sum("vec_id") / 100.0, 2).alias("seconds")
    )


@query
def load_log_format(spark, sf_dir):
    return writers.load_log_lines(loads(spark, sf_dir))


@query
def load_log_parse(spark, sf_dir):
    path = new_path(spark, "log")
    writers.append_load_log(loads(spark, sf_dir), path, start=True)
    return readers.read_load_log(spark, path)


@query
def ingest_metrics(spark, sf_dir):
    _, docs = vectors(spark, sf_dir)
    store, path = SealedStore(spark, new_path(spark, "sealed"), demo_key(spark)), new_path(spark, "metrics")
    pipeline.ingest_sealed(labelled(docs), store, metrics=path)
    n_docs = store.read().agg(F.count("*")).scalar()
    return writers.latest_metrics(spark, path).filter("value > 0").select("metric", n_docs.alias("n_docs"))


@query
def ingest_observed(spark, sf_dir):
    """Rows and embedding time per sample size as the ingest itself observed them."""
    docs = table(spark, sf_dir, "documents")
    wanted, path = sizes(docs), new_path(spark, "observed")
    chosen = sampling.sample_documents(docs.select("doc_id", "n_chars", F.col("text").alias("content")), good_docs(spark, sf_dir), wanted)
    timed = embed_hashed(chosen, "content").withColumn("embed_time", F.col("n_chars") / 1000.0)
    store = SealedStore(spark, new_path(spark, "sealed"), demo_key(spark))
    pipeline.ingest_sealed(timed, store, sizes=wanted, observed=path)
    return writers.latest_metrics(spark, path).select("sample_size", "metric", F.round("value", 3).alias("value"))


@query
def load_observed(spark, sf_dir):
    """The load log of the plain store: a line per sample size, counted by the job that loads."""
    docs = table(spark, sf_dir, "documents")
    wanted, log = sizes(docs), new_path(spark, "log")
    chosen = sampling.sample_documents(docs.select("doc_id", F.col("text").alias("content")), good_docs(spark, sf_dir), wanted)
    pipeline.load_plain(embed_hashed(chosen, "content"), PlainStore(spark, new_path(spark, "plain")), log, wanted)
    return readers.read_load_log(spark, log).select("size", "count")


@query
def skip_guard(spark, sf_dir):
    _, docs = vectors(spark, sf_dir)
    store = SealedStore(spark, new_path(spark, "sealed"), demo_key(spark))
    first, second = (pipeline.ingest_sealed(labelled(docs), store) for _ in range(2))
    return store.read().agg(
        F.lit(first).alias("first_run"), F.lit(second).alias("second_run"), F.count("*").alias("n_rows")
    )


@query
def backend_compare(spark, sf_dir):
    """The exact search of sealed vectors against the approximate one."""
    queries, docs = vectors(spark, sf_dir)
    opened = sealed_store(spark, labelled(docs)).vectors().withColumn("doc_id", F.col("doc_id").cast("bigint"))
    probed = cells.search_cells(queries, built_cells(spark, sf_dir), K, PROBES, exact=False)
    both = evaluation.compare_backends(search(queries, opened, K), probed, K)
    return both.withColumn("score_gap", F.round("score_gap", 6))


@query
def stream_ingest(spark, sf_dir):
    raw = table_stream(spark, f"{sf_dir}/embeddings.parquet", "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT")
    store = SealedStore(spark, new_path(spark, "sealed"), demo_key(spark))
    rows = raw.select(F.col("vec_id").alias("doc_id"), "embedding")
    ingest_stream(rows, store, new_path(spark, "offsets")).awaitTermination()
    return elements(unpack_vectors(store.vectors().select("doc_id", "vector")))


@query
def stream_search(spark, sf_dir):
    raw = table_stream(spark, f"{sf_dir}/embeddings.parquet", "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT")
    store = PlainStore(spark, new_path(spark, "plain"))
    store.add(labelled(vectors(spark, sf_dir)[1]))
    asked, path = raw.select(F.col("vec_id").alias("query_id"), "embedding"), new_path(spark, "answers")
    search_stream(asked, store, K, path, new_path(spark, "offsets")).awaitTermination()
    hits = spark.read.schema("query_id BIGINT, rank INT, doc_id STRING, score DOUBLE").parquet(path)
    return numbered(hits.select("query_id", "rank", "doc_id", "score"))


@query
def stream_upsert(spark, sf_dir):
    """Three files of versions, one a micro-batch: all vectors, newer ones of half the labels, and older ones too late."""
    _, docs = vectors(spark, sf_dir)
    path = new_path(spark, "versions")
    schema = "doc_id BIGINT, embedding ARRAY<FLOAT>, version BIGINT"
    newer = docs.filter("label < 5").withColumn("embedding", F.reverse("embedding"))
    late = docs.filter("label < 7").withColumn("embedding", F.transform("embedding", lambda x: -x))
    store = SealedStore(spark, new_path(spark, "sealed"), demo_key(spark))
    offsets = new_path(spark, "offsets")
    for rows, version in ((docs, 1), (newer, 3), (late, 0)):
        rows.select("doc_id", "embedding", F.lit(version).cast("bigint").alias("version")).write.mode("append").parquet(path)
        # Each run catches up and ends; the next one begins from the checkpoint with the state of the last.
        upsert_stream(read_stream(spark, path, schema), store, offsets).awaitTermination()
    return elements(unpack_vectors(store.vectors(store.latest()).select("doc_id", "vector")))


@query
def benchmark_sweep(spark, sf_dir):
    """Sample, embed, three backends over three sample sizes, and their NDCG report."""
    return benchmark(spark, sf_dir)


@query
def benchmark_limited(spark, sf_dir):
    """The same for the first queries only."""
    return benchmark(spark, sf_dir, LIMIT)


def benchmark(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.col("item_id").alias("query_pos"))
    wanted, path = sizes(docs), new_path(spark, "benchmark")
    embedded, queries = pipeline.prepare_corpus(
        docs, asked, good_docs(spark, sf_dir), wanted, embed_hashed, f"{path}/embeddings"
    )
    hits = pipeline.run_backends(embedded, queries, demo_key(spark), path, wanted, K, limit, CELLS, PROBES)
    report = pipeline.report_ndcg(hits, pooled_judgements(hits, spark, sf_dir), path, K)
    return report.select("backend", "sample_size", "query_id", F.round("ndcg", 6).alias("ndcg"))


QUERIES["l2_norm"] = QUERIES.pop("l2_norm_query")
QUERIES["hashed_embedding"] = QUERIES.pop("hashed_embedding_query")


def sealed_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: seal and store all vectors, search them with all vectors as queries,
    drop self hits and report NDCG@5 with its average."""
    ship_package(spark)
    queries, docs = vectors(spark, sf_dir)
    opened = sealed_store(spark, labelled(docs)).vectors().withColumn("doc_id", F.col("doc_id").cast("bigint"))
    hits = without_self(search(queries, opened, K + 1), K)
    return evaluation.ndcg_report(by_label(hits, docs), K)
