"""Headline timings on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and is then timed to the end of its result. The load
timings take embeddings of all documents from JSON, as the published load times do, and
report rows per second beside the seconds.
"""

from __future__ import annotations

import json
import os
import pathlib
import statistics
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from sealrank.functions.vectors import widen  # noqa: E402
from sealrank.operators import cell_tree, cells, codes, evaluation, shares  # noqa: E402
from sealrank.operators.embedding import embed_hashed  # noqa: E402
from sealrank.operators.search import search  # noqa: E402
from sealrank.plans import queries as registered  # noqa: E402
from sealrank.plans.pipeline import evaluate_sealed, load_plain  # noqa: E402
from sealrank.session import build_session, materialize, new_path, ship_package  # noqa: E402
from sealrank.sources.readers import read_doc_embeddings  # noqa: E402
from sealrank.sources.stores import PlainStore, SealedStore  # noqa: E402
from sealrank.sources.writers import write_json_arrays  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 2
# The published load times are of model vectors; this width stands for theirs.
WIDE = 1024
# Steps that take long run once to warm up and once for the time.
LONG = ("load_wide_json", "load_wide_json_array", "load_wide_json_50k", "load_wide_json_array_50k", "load_wide_json_array_100k")


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(CPUS, 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    asked, docs = registered.vectors(spark, SF_DIR)
    texts = registered.table(spark, SF_DIR, "documents").select("doc_id", F.col("text").alias("content"))
    key = registered.demo_key(spark)

    # Inputs of the timed steps.
    embedded = new_path(spark, "bench-embeddings")
    embed_hashed(texts, "content", spread=True).withColumn("doc_id", F.col("doc_id").cast("string")).write.json(embedded)
    wide = docs.withColumn("embedding", widen(F.col("embedding")))
    plain, sealed = PlainStore(spark, new_path(spark, "plain")), SealedStore(spark, new_path(spark, "sealed"), key)
    plain.add(wide)
    sealed.add(wide)
    index = new_path(spark, "cells")
    cells.build_cells(docs, index, 32)
    tree, coded = new_path(spark, "tree"), new_path(spark, "codes")
    cell_tree.build_tree(docs, tree, 64)
    codes.build_codes(docs, coded, 16, 64)
    split = [materialize(shares.split_vectors(docs, key, i), "share") for i in (0, 1)]
    n_docs = texts.count()

    def wide_records(copies: int):
        """A dense vector of ``WIDE`` numbers for each text; copies of a text get ids of their own."""
        every = texts.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        named = every.select(F.concat_ws("-", "doc_id", "copy").alias("doc_id"), "content")
        seed = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
        dense = F.transform(F.sequence(F.lit(1), F.lit(WIDE)), lambda i: F.sin(i * seed))
        return named.repartition(4 * int(CPUS)).withColumn("embedding", dense)

    lines, more = new_path(spark, "bench-wide"), new_path(spark, "bench-wide")
    wide_records(1).write.json(lines)
    wide_records(5).write.json(more)
    # One array in one file, as the published loads read it.
    arrays = {copies: new_path(spark, "bench-array") for copies in (1, 5, 10)}
    for copies, place in arrays.items():
        rows = wide_records(copies).select(F.to_json(F.struct("doc_id", "content", "embedding")).alias("value"))
        write_json_arrays(rows.coalesce(1), place)

    def load_array(copies: int):
        return load_plain(read_doc_embeddings(spark, arrays[copies], "json_array"), PlainStore(spark, new_path(spark, "plain")))

    def records():
        return read_doc_embeddings(spark, embedded, "json")

    steps = {
        "load_plain_json": lambda: load_plain(records(), PlainStore(spark, new_path(spark, "plain"))),
        "load_sealed_json": lambda: SealedStore(spark, new_path(spark, "sealed"), key).add(records()),
        "load_wide_json": lambda: load_plain(read_doc_embeddings(spark, lines, "json"), PlainStore(spark, new_path(spark, "plain"))),
        "load_wide_json_array": lambda: load_array(1),
        "load_wide_json_array_50k": lambda: load_array(5),
        "load_wide_json_array_100k": lambda: load_array(10),
        "load_wide_json_50k": lambda: load_plain(read_doc_embeddings(spark, more, "json"), PlainStore(spark, new_path(spark, "plain"))),
        "exact_topk": lambda: drain(search(asked, plain.vectors(), 5)),
        "sealed_topk": lambda: drain(search(asked, sealed.vectors(), 5)),
        "ivf_topk": lambda: drain(cells.search_cells(asked, index, 5, 8)),
        "ivf_probe_topk": lambda: drain(cells.search_cells(asked, index, 5, 8, exact=False)),
        "ivf_tree_topk": lambda: drain(cell_tree.search_tree(asked, tree, 5, 4, 16)),
        "code_topk": lambda: drain(codes.search_codes(asked, coded, 5, 100)),
        "sealed_hits": lambda: drain(evaluate_sealed(asked, sealed, 5, texts=True)),
        "exact_topk_blocks": lambda: drain(search(asked, plain.vectors(), 5, query_rows=256)),
        "share_topk": lambda: drain(shares.search_shares(asked, *split, 5)),
        "ndcg_report": lambda: drain(evaluation.ndcg_report(registered.label_hits(spark, SF_DIR), 5)),
        "embed_batches": lambda: drain(embed_hashed(texts, "content", spread=True)),
        "sample_sweep": lambda: drain(registered.sample_sweep(spark, SF_DIR)),
        "hashed_search": lambda: drain(registered.hashed_search(spark, SF_DIR)),
        "stream_ingest": lambda: drain(registered.stream_ingest(spark, SF_DIR)),
        "benchmark_sweep": lambda: drain(registered.benchmark_sweep(spark, SF_DIR)),
    }
    seconds = {}
    for name, step in steps.items():
        times = []
        for _ in range(2 if name in LONG else RUNS + 1):
            start = time.perf_counter()
            step()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({
        "metric": "total of the median query times",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": pathlib.Path(SF_DIR).name.removeprefix("sf"),
        "documents_loaded": n_docs,
        "load_plain_rows_per_sec": round(n_docs / seconds["load_plain_json"]),
        "load_sealed_rows_per_sec": round(n_docs / seconds["load_sealed_json"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
