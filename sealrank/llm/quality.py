"""Document quality by hierarchical empirical Bayes.

Evidence. Two logistic models, quality and toxicity, over hashed features of a text: its words, their
five-letter beginnings, and bands of a few shares. They are fitted on at most ``FIT_ROWS`` labelled
documents (twice that at worst), drawn by a hash of the id; the sample is small enough to be broadcast, so
fitting moves no text. Tasks take AdaGrad steps and their weights are averaged, by rows touched, each round.

Sites. The evidence of all documents is summed per host and per path. A host's rate is shrunk
towards the global rate, a path's towards its host's, as a Beta prior does:
(strength * prior + sum) / (strength + n). Each strength comes from the data by moments, hosts measured
around the global rate and paths around their host's, so that it is large where groups of one parent
differ little. A document's posterior odds are its own odds times the odds of its path, counted without
that document, over the global odds.

Groups are sums with map-side combining, so a host with a third of all documents is one row per
task. Scores are written once; the texts are read twice and never shuffled. The sample's features are
written once for all rounds.

Defined cases: a null host or path is a group of its own; a null text has the features of an empty
one; null or repeated labels are dropped or averaged; without labels every score is 0.5 before
shrinking; repeated rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealrank.llm.tables import written
from sealrank.llm.words import chunks, slices, texts_of

FIT_ROWS = 20_000
BITS = 18
ROUNDS = 3
EPOCHS = 2
RATE = 0.2
KINDS = ("quality", "toxic")
CHUNK_BYTES = 1 << 19


def _shares(text: bytes, words: list[bytes]) -> list[bytes]:
    """Bands of the shares of symbols, capitals, digits and different words, and of the length."""
    n = max(1, len(text))
    symbols = sum(map(text.count, b"#*$%&|<>")) / n
    capitals = sum(map(bytes.isupper, words)) / max(1, len(words))
    digits = sum(map(text.count, b"0123456789")) / n
    different = len(set(words)) / max(1, len(words))
    bands = zip(b"scdu", (symbols, capitals, digits, different))
    return [b"\n%c%d" % (name, int(10 * share)) for name, share in bands] + [b"\nn%d" % len(words).bit_length()]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Different feature numbers of each text, and where each text's begin."""
    names: list[bytes] = []
    counts = []
    for text in texts:
        words = text.split()
        own = {word.lower() for word in words}
        own = {*own, *(b"\n" + word[:5] for word in own), *_shares(text, words)}
        names.extend(own)
        counts.append(len(own))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _steps(weights: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fits the features of the task's labelled texts, one text at a time; yields changed rows: row, touched, and a change per kind."""
    own, squares = weights.copy(), np.full(weights.shape, 1e-3)
    touched = np.zeros(1 << BITS)
    for batch in batches:
        lists = batch.column("rows")
        bounds = np.asarray(lists.offsets)
        rows, bounds = np.asarray(lists.values)[bounds[0] : bounds[-1]], bounds - bounds[0]
        labels = np.stack([np.asarray(batch.column(kind)) for kind in KINDS])
        for _ in range(EPOCHS):
            for i in range(batch.num_rows):
                used = rows[bounds[i] : bounds[i + 1]]
                chance = 1 / (1 + np.exp(-np.clip(own[:, used].sum(axis=1), -30, 30)))
                error = chance - labels[:, i]
                squares[:, used] += (error * error)[:, None]
                own[:, used] -= RATE * error[:, None] / np.sqrt(squares[:, used])
        np.add.at(touched, rows, 1)
    used = np.flatnonzero(touched)
    change = (own - weights)[:, used] * touched[used]
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(touched[used]), *map(pa.array, change)], ["row", "touched", *KINDS])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of labelled texts."""
    for batch in slices(batches):
        rows, bounds = features(texts_of(batch.column("text")))
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(rows.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([lists, *(batch.column(kind) for kind in KINDS)], ["rows", *KINDS])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (kind, feature) from at most about ``fit_rows`` labelled documents."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.avg(kind).alias(kind) for kind in KINDS]).dropna()
    n = known.count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, fit_rows / max(1, n))))
    sample = known.where(share)
    if n > fit_rows and sample.count() > 2 * fit_rows:
        raise ValueError("the hash of the ids is too uneven to draw a bounded sample")
    # Bounded by 2 * fit_rows narrow rows.
    drawn = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", *KINDS)
    drawn = written(drawn.mapInArrow(_rows, "rows array<int>, " + ", ".join(f"{kind} double" for kind in KINDS)), "labelled")
    weights = np.zeros((len(KINDS), 1 << BITS))
    for _ in range(rounds if n else 0):
        shared = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            return _steps(shared.value, batches)

        changes = drawn.mapInArrow(run, "row long, touched double, " + ", ".join(f"{kind} double" for kind in KINDS))
        # At most 2**BITS rows.
        summed = changes.groupBy("row").agg(F.sum("touched").alias("touched"), *[F.sum(kind).alias(kind) for kind in KINDS]).toPandas()
        weights = weights.copy()
        weights[:, summed["row"]] += (summed[list(KINDS)].to_numpy() / summed[["touched"]].to_numpy()).T
        shared.unpersist()
    return weights


def evidence(docs: DataFrame, host: str, path: str, weights: np.ndarray) -> DataFrame:
    """doc_id, host, path and the probability of each kind from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, found = texts_of(batch.column("text")), []
            for a, b in chunks(texts, CHUNK_BYTES):
                rows, bounds = features(texts[a:b])
                found.append(np.add.reduceat(shared.value[:, rows], bounds[:-1], axis=1))
            logits = np.concatenate(found, axis=1) if found else np.zeros((len(KINDS), 0))
            chances = 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -12, 12)))
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in ("doc_id", "host", "path")), *map(pa.array, chances)], ["doc_id", "host", "path", *KINDS])

    rows = docs.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path"), "text")
    kinds = {field.name: field.dataType.simpleString() for field in rows.schema}
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, host {kinds['host']}, path {kinds['path']}, " + ", ".join(f"{kind} double" for kind in KINDS))


def _strengths(groups: DataFrame) -> dict[str, float]:
    """By moments: how many documents the prior of a group weighs, per kind.

    ``groups`` has n and sum_kind of each group, and of_n and of_kind, number and rate of the documents of the
    group above it. Groups of one parent scatter around its rate, of which they are a part themselves: that takes
    a share n / of_n of a group's noise, and of the spread, away.
    """
    n, rest = F.col("n"), 1 - F.col("n") / F.col("of_n")
    aggs = [F.sum("n").alias("n"), F.sum(n * rest).alias("free")]
    for kind in KINDS:
        rate = F.col(f"of_{kind}")
        aggs.append(F.sum(n * (F.col(f"sum_{kind}") / n - rate) ** 2).alias(f"spread_{kind}"))
        aggs += [F.sum(rate * (1 - rate) * rest).alias(f"chance_{kind}"), F.sum(n * rate * (1 - rate)).alias(f"noise_{kind}")]
    row = groups.agg(*aggs).first()
    out = {}
    for kind in KINDS:
        between = (row[f"spread_{kind}"] - row[f"chance_{kind}"]) / row["free"] if row["n"] and row["free"] > 1e-9 * row["n"] else 0.0
        out[kind] = float(np.clip(row[f"noise_{kind}"] / row["n"] / between - 1, 1, 1e6)) if between > 0 else 1e6
    return out


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, host: str, path: str, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per document: doc_id, p_quality, p_toxic, the shrunk rates of its host and path, and kept."""
    scores = written(evidence(docs, host, path, fit(docs, labels, fit_rows)), "evidence")
    sums = [F.sum(kind).alias(f"sum_{kind}") for kind in KINDS]
    paths = written(scores.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *sums), "paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(f"sum_{kind}").alias(f"sum_{kind}") for kind in KINDS]), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), *[F.sum(f"sum_{kind}").alias(kind) for kind in KINDS]).first()
    rates = {kind: min(max((total[kind] or 0) / max(1, total["n"] or 0), 1e-6), 1 - 1e-6) for kind in KINDS}
    whole = [F.lit(total["n"] or 0).alias("of_n"), *(F.lit(rates[kind]).alias(f"of_{kind}") for kind in KINDS)]
    by_host = _strengths(hosts.select("*", *whole))
    hosts = hosts.select(
        F.col("host").alias("__host"), F.col("n").alias("of_n"), *[(F.col(f"sum_{kind}") / F.col("n")).alias(f"of_{kind}") for kind in KINDS],
        *[((F.lit(by_host[kind] * rates[kind]) + F.col(f"sum_{kind}")) / (F.lit(by_host[kind]) + F.col("n"))).alias(f"host_{kind}") for kind in KINDS],
    )
    paths = written(paths.join(hosts, F.col("host").eqNullSafe(F.col("__host"))).drop("__host"), "shrunk")
    by_path = _strengths(paths)

    def path_rate(kind: str, own: Column | float, rows: int) -> Column:
        """A path's rate without ``own``, the sum of as many ``rows``."""
        prior = F.lit(by_path[kind])
        return (prior * F.col(f"host_{kind}") + F.col(f"sum_{kind}") - own) / (prior + F.col("n") - rows)

    paths = paths.withColumnsRenamed({"host": "__host", "path": "__path"})
    found = scores.join(paths, F.col("host").eqNullSafe(F.col("__host")) & F.col("path").eqNullSafe(F.col("__path")))
    found = found.select("*", *[path_rate(kind, F.lit(0.0), 0).alias(f"path_{kind}") for kind in KINDS])
    # A document's own evidence is in its odds already, so it is taken out of its path's rate.
    others = {kind: path_rate(kind, F.col(kind), 1) for kind in KINDS}
    posterior = {kind: 1 / (1 + F.exp(-(_logit(F.col(kind)) + _logit(others[kind]) - _logit(F.lit(rates[kind]))))) for kind in KINDS}
    return found.select(
        "doc_id", posterior["quality"].alias("p_quality"), posterior["toxic"].alias("p_toxic"),
        *[f"{level}_{kind}" for level in ("host", "path") for kind in KINDS],
        ((posterior["quality"] >= 0.5) & (posterior["toxic"] < 0.5)).alias("kept"),
    )
