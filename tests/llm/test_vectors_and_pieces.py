"""Whitening, importance resampling and SentencePiece ids against brute force and the library."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece

from sealrank.llm import resampling, sentencepieces, whitening
from sealrank.llm.queries import QUERIES
from tests.conftest import SF_DIR

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VECTORS = "vec_id long, embedding array<float>, label int, n long, component string, vector string, whitened string"


# Whitening


def plain_moments(x):
    wide = x.astype(object)
    return wide.T @ wide, list(wide.sum(axis=0))


@pytest.mark.parametrize("low, high", [(99_000, 101_000), (-(2**62), 2**62), (7, 8), (-3, 2**40)])
def test_moments_of_a_block_are_exact(low, high):
    x = np.random.default_rng(5).integers(low, high, (333, 6))
    x[:, 2] = x[0, 2]
    found = whitening.block_moments(x)
    products, sums = plain_moments(x)
    assert (found.products == products).all() and found.sums == sums and found.n == 333


def given_vectors(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    return {r["vec_id"]: r["embedding"] for r in rows}


def test_moments_over_tasks_are_exact(spark):
    docs = whitening.sound(spark.read.parquet(f"{SF_DIR}/embeddings.parquet").repartition(5))
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in given_vectors(spark).values()])
    products, sums = plain_moments(x)
    for rows in (64, 8192):
        found = whitening.moments(docs, rows=rows)
        assert found.n == len(x) and found.sums == sums and (found.products == products).all()


def test_whitening_equals_a_dense_computation(spark):
    found = QUERIES["op11_embedding_whitening"](spark, SF_DIR).toPandas()
    vectors = given_vectors(spark)
    ids = sorted(vectors)
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in vectors[i]] for i in ids])
    n, sums = len(x), x.sum(axis=0)
    assert len(found) == 8 * n and set(found["n"]) == {n}
    exact = (((n * x.astype(object) - sums.astype(object)) ** 2).sum(axis=1)).tolist()
    own = found[found["component"] == 1].set_index("vec_id")["deviation"]
    assert [own[i] for i in ids] == exact
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    for c in range(1, 9):
        points = found[found["component"] == c].set_index("vec_id").loc[ids]
        want = (x - x.mean(axis=0)) @ axes[:, -c] / math.sqrt(values[-c])
        got = points["whitened"].to_numpy()
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-8
        assert points["explained"].iloc[0] == pytest.approx(values[-c] / values.sum(), rel=1e-9)
    wide = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    error = np.abs(np.cov(wide.T, bias=True) - np.eye(8)).max()
    assert set(found["identity_error"]) == {found["identity_error"].iloc[0]} and found["identity_error"].iloc[0] < 1e-9 and error < 1e-9


def test_whitening_of_odd_rows(spark):
    good = [(i, [math.sin(i), math.cos(3 * i), 0.5], None, 1, "c", "v", "w") for i in range(30)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (104, [float("inf"), 1.0, 1.0])]
    rows = good + [good[0], good[0], (None, *good[1][1:])] + [(i, v, 1, 1, "c", "v", "w") for i, v in bad]
    found = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(found) == 33 * 3 and {r["n"] for r in found} == {33}
    assert sum(r["vec_id"] == 0 for r in found) == 9 and sum(r["vec_id"] is None for r in found) == 3
    # The third dimension is constant: two components with variance, the third has none.
    assert {r["component"] for r in found if r["whitened"] is None} == {3}
    assert {r["explained"] for r in found if r["component"] == 3} == {0.0}
    assert all(r["identity_error"] < 1e-9 for r in found)


def test_whitening_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(1, [0.1, 0.2])], "vec_id long, embedding array<float>")
    assert [(r["deviation"], r["whitened"]) for r in whitening.whiten(one).collect()] == [(0, None)] * 2
    none = whitening.whiten(one.limit(0))
    assert none.count() == 0 and none.columns == whitening.whiten(one).columns


def test_whitening_where_the_deviation_passes_a_long(spark):
    rows = [(i, [3e15 * (-1) ** i, 1.0 * i]) for i in range(4)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    sums = [sum(column) for column in zip(*x)]
    for r in found:
        exact = sum((4 * v - s) ** 2 for v, s in zip(x[r["vec_id"]], sums))
        assert r["deviation"] is None and r["deviation_digits"] == str(exact)


def test_vectors_of_different_width_are_an_error(spark):
    rows = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.1])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="width"):
        whitening.whiten(rows.coalesce(1)).collect()
    with pytest.raises(Exception, match="width"):
        whitening.whiten(rows.repartition(2, "vec_id")).collect()


# Importance resampling


def plain_buckets(text, longest, buckets):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [words[i : i + n] for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), sorted(zlib.crc32(" ".join(run).encode()) % buckets for run in runs)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_buckets_are_crcs(longest):
    random.seed(longest)
    texts = ["", " ", "Hello, World 12 a", "É x y ÀÉ", "z" * 5000 + " " + "q" * 64 + " " + "r" * 65 + " " + "s" * 128]
    texts += ["".join(random.choices("abc ABC.,é漢", k=random.randint(0, 300))) for _ in range(100)]
    found = resampling.bucket_features([text.encode() for text in texts], longest, 10_000)
    ends = np.cumsum(found.per_text)
    for i, text in enumerate(texts):
        own = sorted(found.buckets[ends[i] - found.per_text[i] : ends[i]].tolist())
        assert (found.words[i], own) == plain_buckets(text, longest, 10_000)


def test_a_span_is_looked_up_in_groups_of_bounded_size(monkeypatch):
    body = np.random.default_rng(3).integers(0, 256, 20_000).astype(np.uint8)
    starts, lengths = np.array([0, 1, 900]), np.array([1, 800, 19_000])
    want = [zlib.crc32(body[s : s + n].tobytes()) for s, n in zip(starts, lengths)]
    assert resampling.crc_spans(body, starts, lengths).tolist() == want
    monkeypatch.setattr(resampling, "AT_ONCE", 100)
    assert resampling.crc_spans(body, starts, lengths).tolist() == want


def plain_resample(docs, target, longest=1, buckets=10_000, seed=2024, least=20, percent=10):
    features = [plain_buckets(text, longest, buckets) for _, text in docs]
    s, t = [0] * buckets, [0] * buckets
    for counts, found in ((s, [f for _, f in features]), (t, [plain_buckets(text, longest, buckets)[1] for text in target])):
        for own in found:
            for bucket in own:
                counts[bucket] += 1
    all_s, all_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for (doc_id, _), (n_words, own) in zip(docs, features):
        weight = sum(gain[b] for b in own)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    eligible = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    place = {id(r): i + 1 for i, r in enumerate(eligible[: percent * len(eligible) // 100])}
    return sorted([(*r[:4], place.get(id(r))) for r in rows], key=str)


@pytest.mark.parametrize("longest, percent", [(1, 10), (2, 50), (1, 100)])
def test_resampling_equals_brute_force(spark, edge_docs, longest, percent):
    more = spark.createDataFrame([(50 + i, f"one two three four five {i} " * (i + 1)) for i in range(30)], "doc_id long, text string")
    docs = edge_docs.unionByName(more, allowMissingColumns=True).repartition(4)
    target = spark.createDataFrame([(1, "three four word3 and3"), (2, None), (3, "")], "item_id long, text string")
    found = resampling.resample(docs, target, longest, percent=percent)
    got = sorted([tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in found.collect()], key=str)
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got == plain_resample(plain, [r["text"] for r in target.collect()], longest, percent=percent)


def test_ranks_of_rows_that_repeat_and_of_ties(spark):
    rows = [(7, 30, 0, 5, True)] * 4000 + [(i, 30, 0, 5, True) for i in range(2000)] + [(1, 3, 0, 9, False)]
    scored = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long, eligible boolean").repartition(8)
    found = resampling.ranked(scored, 5000).collect()
    taken = sorted((r["rank"], r["doc_id"]) for r in found if r["rank"] is not None)
    assert [rank for rank, _ in taken] == list(range(1, 5001))
    assert [doc_id for _, doc_id in taken] == sorted([7] * 4000 + list(range(2000)))[:5000]
    assert len(found) == len(rows) and all(r["rank"] is None for r in found if not r["eligible"])


def test_resampling_of_no_rows(spark, edge_docs, no_docs):
    target = spark.createDataFrame([(1, "word1")], "item_id long, text string")
    assert resampling.resample(no_docs, target).count() == 0
    assert resampling.resample(edge_docs, target.limit(0)).count() == edge_docs.count()


def test_taking_the_drawn_documents(spark, edge_docs):
    target = spark.createDataFrame([(1, "word1")], "item_id long, text string")
    drawn = resampling.resample(edge_docs, target, percent=100)
    kept = resampling.take(edge_docs, drawn)
    assert kept.columns == edge_docs.columns
    assert kept.count() == drawn.filter("rank is not null").count()


# SentencePiece


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)


def ids_of(table, text):
    chunks = [table.segments[0].findall(chunk) for chunk in table.chunks(text)]
    return np.frombuffer(b"".join(table.encode_all(chunks)), "<u4").tolist()


def odd_texts():
    random.seed(11)
    letters = [" ", "a", "e", "t", "▁", "\n", "\r", "é", "漢", "😀", "\x00", "\t", "<", ">", "0", "s", "="]
    texts = ["".join(random.choices(letters, k=random.randint(0, 30))) for _ in range(3000)]
    texts += ["a" * 5000, " " * 3000, "ab" * 4000, "=" * 1000, "\r" * 999, "漢字" * 700, "x" * 321, "the" * 2000, "<s>", "�", "<0x41>"]
    return texts + ["".join(random.choices("abcdefghijklmnopqrstuvwxyzABC0123456789+/", k=20_000))]


def test_ids_are_those_of_the_library(library):
    table = sentencepieces.piece_table()
    names = [n for n in table.names[259 : table.base]]
    random.seed(12)
    joined = ["".join(random.choices(names, k=random.randint(1, 12))).replace("▁", " ") for _ in range(2000)]
    for text in odd_texts() + joined:
        assert ids_of(table, text) == library.encode(text), text[:80]


def test_pairs_fit_where_merging_yields_them():
    table = sentencepieces.piece_table()
    random.seed(13)
    valid = list(table.valid.values())
    left, right = (np.array(random.choices(valid, k=4000)) for _ in range(2))
    want = [sentencepieces.merge(table.names[a] + table.names[b], table.rank_of) == [table.names[a], table.names[b]] for a, b in zip(left, right)]
    assert table.fits(left, right).tolist() == want
    assert table.fits(left, right).tolist() == want  # now from the table of pairs


def test_long_texts_come_in_chunks(library, monkeypatch):
    monkeypatch.setattr(sentencepieces, "CHUNK", 40)
    table, decode = sentencepieces.piece_table(), sentencepieces.decoder()
    for text in ["a  b\n c " * 50, "word " * 100, "x" * 400, "é 😀\n" * 60, "\n" * 300, " " * 500]:
        gathered = sentencepieces.Encoded(1, 2, frozenset(sentencepieces.KINDS))
        chunks = list(table.chunks(text))
        for chunk in chunks:
            gathered.add(table.encode_all([table.segments[0].findall(chunk)])[0], decode)
        result = gathered.result()
        want = library.encode(text, add_bos=True, add_eos=True)
        assert result["ids"].tolist() == want and result["decoded"] == library.decode(want)
    assert len(chunks) == 1  # blanks only cannot be cut


def test_tables_that_are_full_begin_anew(library, monkeypatch):
    monkeypatch.setattr(sentencepieces, "WORDS", 10)
    table = sentencepieces.piece_table()
    for text in odd_texts()[:200]:
        assert ids_of(table, text) == library.encode(text)


def test_encoded_documents(spark, edge_docs, library):
    found = sentencepieces.encode(edge_docs, (*sentencepieces.DIGESTS, "ids", "decoded")).collect()
    want = []
    for row in edge_docs.collect():
        ids = library.encode(row["text"] or "", add_bos=True, add_eos=True)
        decoded = library.decode(ids)
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((row["doc_id"], len(ids), sha, hashlib.sha256(decoded.encode()).hexdigest(), ids, decoded))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_whole_table_against_the_library(spark, library):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op13_sentencepiece"](spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    for row in docs:
        ids = library.encode(row["text"] or "", add_bos=True, add_eos=True)
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got.pop(row["doc_id"]) == (len(ids), sha, hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert not got


def test_encoding_of_no_rows_and_of_bytes_that_are_not_text(spark, no_docs, library):
    assert sentencepieces.encode(no_docs).columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert sentencepieces.encode(no_docs).count() == 0
    bad = spark.sql("select 1 as doc_id, cast(x'61FF20' as string) as text")
    (row,) = sentencepieces.encode(bad).collect()
    assert row["ids"] == library.encode("a� ", add_bos=True, add_eos=True) and row["decoded"] == "a� "
