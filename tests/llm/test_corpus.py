"""The corpus operators against SQL, brute force and the edge cases that their docstrings define."""

import collections
import hashlib
import math
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from corpus_pipeline import STAGES, run
from sealrank.llm import components, exact, lines, lm, mixing, packing, quality, rules, simhash, substrings, token_counts
from sealrank.llm.tables import written
from sealrank.llm.queries import QUERIES, SQL
from tests.conftest import SF_DIR
from tests.oracle_check import connect, difference

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def rows_of(df):
    return sorted((tuple(row) for row in df.collect()), key=str)


def plain(docs):
    return [(row["doc_id"], row["text"] or "", row["source"]) for row in docs.collect()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR).toPandas(), connect(SF_DIR).execute(SQL[name]).df()) is None


def test_every_operator_is_registered():
    assert {name.split("_")[0] for name in QUERIES} == {*(f"op{n}" for n in range(1, 14)), "pipeline"}


# Packing


def test_ids_are_those_of_the_vocabulary_file(given_docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [text for _, text, _ in plain(given_docs)][:200] + ["", " a  b\n\n c", "don't 12é", " x y"]
    assert [packing.encoder()(t) for t in texts] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_ids_of_long_white_space_and_names_of_special_tokens():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for space in (" " * 1_000_000, "\n" * 1_000_000, " \t" * 5_000):
        for text in (space, f"a{space}b", f"a <|endoftext|>{space}"):
            assert packing.encoder()(text) == tokenizer.encode(text, add_special_tokens=False).ids
    short = "a" + " " * 9_999 + "b <|endoftext|> c"
    for text in (short, "a<|endoftext|>b", " <|endoftext|>  x", "<|endof<|endoftext|>text|>", "<|endoftext|>" * 3):
        assert packing.encoder()(text) == tokenizer.encode(text, add_special_tokens=False).ids
    assert packing.encoder()("a<|endoftext|>b") == [64, 50256, 65]


@pytest.mark.parametrize("which", ["edge_docs", "given_docs"])
def test_packing_is_whole_and_gapless(request, which):
    docs = request.getfixturevalue(which)
    found = packing.pack(docs).toPandas()
    want = collections.Counter()
    for doc_id, text, _ in plain(docs):
        ids = np.array([*packing.encoder()(text), 0], "<u4")
        first = len(ids) % 2048 or min(len(ids), 2048)
        edges = [0, *range(first, len(ids) + 1, 2048)]
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            want[(doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    got = found[["doc_id", "piece", "start", "length", "ids_crc32"]]
    got = collections.Counter((None if d != d else int(d), *map(int, rest)) for d, *rest in got.itertuples(index=False))
    assert got == want
    for _, own in found.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum()[:-1]] and own["length"].sum() <= 2048
    fewest = math.ceil(found["length"].sum() / 2048)
    assert found["sequence_id"].nunique() <= 1.05 * fewest + 5


def test_large_items_meet_at_most_twice():
    rng = np.random.default_rng(5)
    counts = np.bincount(rng.integers(1, 61, 4_000), minlength=61)
    runs = packing.plan(counts, 60)
    assert runs.groupby("length")["n"].sum().reindex(range(1, 61), fill_value=0).tolist() == counts[1:].tolist()
    held, large = collections.Counter(), collections.Counter()
    for run_ in runs.itertuples():
        for s in range(run_.sequence, run_.sequence + run_.n):
            held[s] += run_.length
            large[s] += run_.length > 20
    assert max(held.values()) <= 60 and max(large.values()) <= 2
    assert len(held) <= 1.02 * sum(held.values()) / 60 + 2


def test_piece_cuts():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


# Substrings


def brute_substrings(docs, length=20):
    texts = {}
    for doc_id, text, _ in docs:
        texts[(doc_id, text)] = words(text)
    seen, gone = {}, collections.defaultdict(set)
    for key in sorted(texts, key=lambda k: (k[0] is not None, k[0] or 0)):
        own = texts[key]
        for i in range(len(own) - length + 1):
            gram = tuple(own[i : i + length])
            if gram in seen:
                gone[key].update(range(i, i + length))
            seen.setdefault(gram, key)
    return {key: (len(own), len(gone[key]), hashlib.sha256(" ".join(w for i, w in enumerate(own) if i not in gone[key]).encode()).hexdigest()) for key, own in texts.items()}


def test_substrings_in_edge_cases(edge_docs):
    want = brute_substrings(plain(edge_docs))
    expected = sorted(((doc_id, *want[(doc_id, text)]) for doc_id, text, _ in plain(edge_docs)), key=str)
    found = substrings.remove_repeats(edge_docs)
    assert rows_of(found.select("doc_id", "n_words", "n_removed", "kept_sha256")) == expected


@pytest.mark.parametrize("length", [9, 20, 23])
def test_substrings_with_shared_passages(spark, length):
    rng = np.random.default_rng(length)
    passages = [" ".join(f"p{i}x{j}" for j in range(n)) for i, n in enumerate((length - 1, length, length + 9, 3 * length, 90))]
    texts = []
    for i in range(60):
        parts = [" ".join(f"r{rng.integers(4000)}" for _ in range(rng.integers(0, 25))) for _ in range(4)]
        texts.append(" ".join(x for p in zip(parts, rng.choice(passages, 4)) for x in p))
    texts.append("same " * 200)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    want = brute_substrings(plain(docs), length)
    expected = sorted(((i, *want[(i, t)]) for i, t in enumerate(texts)), key=str)
    assert rows_of(substrings.remove_repeats(docs, length).select("doc_id", "n_words", "n_removed", "kept_sha256")) == expected


# Language model


def test_base_score_and_gain(given_docs):
    found = lm.score(given_docs).toPandas().set_index("doc_id")
    tokens = {d: [*words(t.translate(LOWER)), "\n"] for d, t, _ in plain(given_docs)}
    out = {d for d in tokens if zlib.crc32(str(d).encode()) % 10 == 0}
    counts = collections.Counter(w for d, own in tokens.items() if d not in out for w in own)
    n, v = sum(counts.values()), len(counts)
    for d, own in tokens.items():
        row = found.loc[d]
        assert bool(row["held_out"]) == (d in out) and row["n_tokens"] == len(own) and row["train_tokens"] == n
        assert row["n_known"] == sum(w in counts for w in own)
        assert row["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
    held = found[found["held_out"]]
    assert held["score"].sum() > held["base_score"].sum() and (found["score"] < 0).all()


def test_rare_words_by_join_score_the_same(given_docs):
    few, many = (lm.score(given_docs, rounds=1, lexicon=size).toPandas().set_index("doc_id").sort_index() for size in (50, 1 << 17))
    assert np.allclose(few["base_score"], many["base_score"]) and (few["n_known"] == many["n_known"]).all()
    assert np.allclose(few["score"], many["score"], rtol=1e-6)


def test_words_of_one_class_depend_on_the_word_before(spark):
    texts = ["big cat", "tiny rat"] * 40 + ["big rat", "tiny cat", "one two six ten"]
    score = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    cat, rat = lm.Tokens([b"cat", b"rat"]).classes[[0, 2]]
    assert cat == rat
    assert (score[0] - score[80]) - (score[81] - score[1]) > 1


def plain_softmax(model, rows, bias):
    """The probabilities of one token, feature by feature."""
    logits = [float(bias[k]) + sum(float(model.weights[r, k]) for r in rows) for k in range(len(bias))]
    total = sum(math.exp(x) for x in logits)
    return [math.exp(x) / total for x in logits]


@pytest.mark.parametrize("lexicon", [1, 1 << 17])
@pytest.mark.parametrize("rounds", [0, 2])
def test_score_equals_plain_form(spark, monkeypatch, lexicon, rounds):
    texts = dict(enumerate(["a cat sat on a mat", "a rat sat", "", "the cat on the mat sat on a rat", "a new hat sat on it"] * 3))
    models = []
    train_weights = lm.train_weights
    monkeypatch.setattr(lm, "train_weights", lambda *args: models.append(train_weights(*args)) or models[0])
    found = lm.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), rounds=rounds, lexicon=lexicon).collect()
    model, = models
    assert bool(model.weights.any()) == bool(rounds)
    tokens = {i: lm.Tokens([t.encode()]) for i, t in texts.items()}
    groups = {i: list(zip([*t.split(), "\n"], map(int, tokens[i].groups))) for i, t in texts.items()}
    uni = collections.Counter(word for i in texts if zlib.crc32(str(i).encode()) % 10 for word in groups[i])
    n1, n2 = (sum(c == i for c in uni.values()) for i in (1, 2))
    d = float(np.clip(n1 / (n1 + 2 * n2), 0.1, 0.9)) if n1 else 0.1
    total, kinds = collections.Counter(), collections.Counter()
    for (_, g), n in uni.items():
        total[g] += n
        kinds[g] += 1
    for r in found:
        own, want = tokens[r["doc_id"]], 0.0
        of_class, of_sub = own.features(len(model.weights))
        for t, (word, g) in enumerate(groups[r["doc_id"]]):
            c, sub = divmod(g, lm.SUBS)
            want += math.log10(plain_softmax(model, of_class[:, t], model.class_bias)[c])
            n, v = (sum(x for group, x in of.items() if group // lm.SUBS == c) for of in (total, kinds))
            if not uni[word, g]:
                want += math.log10(d * v / n if n else 1.0)
                continue
            if c:
                want += math.log10(plain_softmax(model, of_sub[:, t], model.sub_bias[c])[sub])
            want += math.log10((1 - d * v / n) * (uni[word, g] - d) / (total[g] - d * kinds[g]))
        assert r["score"] == pytest.approx(want, rel=1e-4)


def test_one_step_is_the_gradient():
    rng = np.random.default_rng(2)
    rows = lm.LEAST_ROWS
    model = lm.Model(rng.normal(size=(rows, lm.CLASSES)).astype(np.float32), np.zeros(lm.CLASSES, np.float32), rng.normal(size=(lm.CLASSES, lm.SUBS)).astype(np.float32))
    found = lm.Tokens([b"the cat sat on the mat and the cat slept"])
    steps = lm.Steps(model)
    steps.learn(found)
    of_class, of_sub = found.features(rows)

    def gradient(features, biases, targets, weights):
        out = collections.defaultdict(lambda: np.zeros(lm.CLASSES))
        for t, target in targets:
            error = np.array(plain_softmax(model._replace(weights=weights), features[:, t], biases(t)))
            error[target] -= 1
            for r in features[:, t]:
                out[int(r)] += error
        return out

    want, squares = model.weights.astype(float), collections.defaultdict(lambda: 1e-6)
    plain_steps = (
        (of_class, lambda t: model.class_bias, [(t, int(c)) for t, c in enumerate(found.classes)]),
        (of_sub, lambda t: model.sub_bias[found.classes[t]], [(t, int(s)) for t, s in enumerate(found.subs) if found.classes[t]]),
    )
    for step in plain_steps:
        for r, g in gradient(*step, want.copy()).items():
            squares[r] += (g**2).sum() / lm.CLASSES
            want[r] -= lm.RATE * g / math.sqrt(squares[r])
    assert np.allclose(steps.model.weights, want, atol=1e-4)
    assert steps.touched.sum() == of_class.size + sum(of_sub.shape[0] for c in found.classes if c)


def test_group_sums_are_those_of_each_group():
    rng = np.random.default_rng(4)
    values, sizes = rng.normal(size=(50, 3)).astype(np.float32), np.array([1, 2, 3, 4, 5, 8, 9, 400])
    rows = rng.integers(0, 50, sizes.sum())
    want = [values[own].astype(float).sum(axis=0) for own in np.split(rows, np.cumsum(sizes)[:-1])]
    assert np.allclose(lm._group_sums(values, rows, sizes), want, rtol=1e-12)


def test_a_rare_word_of_a_text_is_one_entry_and_is_looked_up_by_one_shuffle(spark, monkeypatch):
    texts = ["the cat " * 4 + "zebra " * 50, "the cat zebra", None, "the yak cat yak " * 3]
    tables, written = {}, lm.written
    monkeypatch.setattr(lm, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    found = lm.score(spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, "")], "doc_id long, text string"), rounds=0, lexicon=0)
    entries = [(r["doc_id"], sum(w["tf"] for w in r["rare"]), len(r["rare"])) for r in tables["scores"].collect()]
    # The end of a text is an entry too.
    assert sorted(entries, key=str) == sorted([(0, 59, 4), (0, 59, 4), (1, 4, 4), (2, 1, 1), (3, 13, 4), (None, 1, 1)], key=str)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in found.collect() if r["doc_id"] is not None) == [(0, 59), (0, 59), (1, 4), (2, 1), (3, 13)]
    assert "partial_count(1)" not in found._jdf.queryExecution().toString()


def test_the_gain_is_trained(given_docs):
    untrained, trained = (lm.score(given_docs, rounds=n).where("held_out").agg({"score": "sum", "base_score": "sum"}).first() for n in (0, lm.ROUNDS))
    # Without training the history plays no part: what is left of the gain is the unseen words' larger mass.
    assert trained["sum(score)"] - untrained["sum(score)"] > 0.1 * abs(untrained["sum(score)"])
    assert trained["sum(score)"] > trained["sum(base_score)"]


def test_long_texts_in_pieces_have_the_same_tokens(monkeypatch):
    text = b" a  rat\n\n" + b"the cat sat on " * 40 + b"x" * 3000 + b" mat " + b" " * 400
    long = b"y" * 500
    whole = lm.Tokens([text])
    assert lm.Tokens([long]).hashes[0] == lm.mix(np.array([sum((121 + 1) * pow(lm._BASE, i, 1 << 64) for i in range(500)) % (1 << 64)], np.uint64))[0]
    hashes, features = whole.hashes, whole.features(lm.LEAST_ROWS)
    for piece in (50, 64, 333):
        monkeypatch.setattr(lm, "PIECE_BYTES", piece)
        monkeypatch.setattr(lm, "LONG_WORD", 128)
        lm._powers.cache_clear()
        parts = [found for _, _, found in lm.token_runs([text], piece)]
        assert len(parts) > 3 and (np.concatenate([p.hashes for p in parts]) == hashes).all()
        for i in range(2):
            assert (np.concatenate([p.features(lm.LEAST_ROWS)[i] for p in parts], axis=1) == features[i]).all()


@pytest.mark.parametrize("piece", [40])
def test_long_texts_score_the_same(spark, monkeypatch, piece):
    rows = [(i, "the cat sat on the mat and " * (1 + 5 * (i % 3)) + "rare%d" % i) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = rows_of(lm.score(docs, rounds=0).orderBy("doc_id"))
    scores = lm.Model.chances
    found = lm.Tokens([rows[2][1].encode()])
    model = lm.Model(np.random.default_rng(3).normal(size=(lm.LEAST_ROWS, lm.CLASSES)).astype(np.float32), np.zeros(lm.CLASSES, np.float32), np.zeros((lm.CLASSES, lm.SUBS), np.float32))
    monkeypatch.setattr(lm, "PIECE_BYTES", piece)
    cut = np.hstack([scores(model, part) for _, _, part in lm.token_runs([rows[2][1].encode()], piece)])
    assert np.allclose(cut, scores(model, found), rtol=1e-5)
    assert len(whole) == 9


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    found = lm.Tokens([b"The cat sat", b"", b"on the mat"])
    for features in found.features(lm.LEAST_ROWS):
        p = lm.softmax(rng.normal(size=(lm.LEAST_ROWS, lm.CLASSES)).astype(np.float32), np.zeros(lm.CLASSES, np.float32), features)
        assert len(p) == 9 and np.allclose(p.sum(axis=1), 1, atol=1e-5)
    assert found.hashes[0] == found.hashes[6] == lm.Tokens([b"the"]).hashes[0]


# SimHash


def brute_groups(fps, max_bits=4):
    linked = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_bits
    labels = np.arange(len(fps))
    while True:
        new = np.array([labels[row].min() for row in linked])
        if (new == labels).all():
            return labels
        labels = new


def test_simhash_equals_brute_force(given_docs):
    import xxhash

    docs = sorted(plain(given_docs))
    fps = []
    for _, text, _ in docs:
        own = words(text.translate(LOWER))
        grams = [" ".join(own[i : i + 4]) for i in range(max(1, len(own) - 3))] if own else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    fps = np.array(fps, np.uint64)
    found = simhash.digests(simhash.near_groups(given_docs)).toPandas().sort_values("doc_id")
    assert found["fingerprint"].tolist() == [f"{int(fp):016x}" for fp in fps]
    assert found["component_id"].tolist() == [docs[i][0] for i in brute_groups(fps)]


@pytest.mark.parametrize("blocks", [5, 6, 8])
def test_links_lose_no_group(spark, monkeypatch, blocks):
    rng = np.random.default_rng(blocks)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(600)], np.uint64)
    fps = np.unique(centres[rng.integers(0, 40, 600)] ^ flips)
    monkeypatch.setattr(simhash, "blocks_for", lambda n: blocks)
    monkeypatch.setattr(simhash, "TILE", 8)
    classes = spark.createDataFrame([(int(fp),) for fp in fps.view(np.int64)], "fp long")
    roots = {r["vertex"]: r["root"] for r in components.components(simhash.links(classes)).collect()}
    want, got = brute_groups(fps), [roots.get(int(fp), int(fp)) for fp in fps.view(np.int64)]
    assert len({*zip(want.tolist(), got)}) == len({*want.tolist()}) == len({*got})


def test_near_dedup_keeps_one_of_each_group(edge_docs):
    groups = {(r["doc_id"], r["component_id"]) for r in simhash.near_groups(edge_docs).collect()}
    kept = simhash.near_dedup(edge_docs)
    assert kept.columns == edge_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {component for _, component in groups}


def test_near_dedup_keeps_one_row_without_ids_or_with_repeated_ones(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, a), (None, a), (None, b), (1, b), (1, b), (1, c), (0, c)]
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, a), (0, c), (1, b)]


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["vertex"]: r["root"] for r in found} == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Mixing


def test_mix_meets_targets(given_docs):
    found = mixing.mix_report(given_docs, block_words=32, shard_blocks=64).toPandas()
    again = mixing.mix_report(given_docs, block_words=32, shard_blocks=64).toPandas()
    assert sorted(found.itertuples(index=False)) == sorted(again.itertuples(index=False))
    sizes = {d: len(words(t)) for d, t, _ in plain(given_docs)}
    source = {d: s for d, _, s in plain(given_docs)}
    assert found.set_index("doc_id")["size"].to_dict() == sizes and (found["taken"] <= 2 * found["size"]).all()
    own = found.assign(source=found["doc_id"].map(source)).groupby("source").agg({"taken": "sum", "target": "first", "source_size": "first"}).sort_index()
    weights = np.array([(5, 2, 1)[i % 3] for i in range(len(own))], float)
    target, whole = np.zeros(len(own)), 1.5 * own["source_size"].sum()
    free = np.ones(len(own), bool)
    while True:
        target = np.where(free, weights * (whole - target[~free].sum()) / max(weights[free].sum(), 1e-9), target)
        over = free & (target > 2 * own["source_size"])
        if not over.any():
            break
        target = np.where(over, 2 * own["source_size"], target)
        free &= ~over
    assert np.allclose(own["target"], target) and (abs(own["taken"] - target) <= 0.5).all()


def test_mix_in_edge_cases(edge_docs):
    found = mixing.mix_report(edge_docs).toPandas()
    assert len(found) == edge_docs.count() and (found["taken"] <= 2 * found["size"]).all()
    mixed = mixing.mixed_documents(edge_docs)
    assert mixed.columns == edge_docs.columns
    assert sum(len(words(r["text"])) for r in mixed.collect()) == found["taken"].sum()


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        k = np.arange(n)
        assert sorted(mixing.permute(k, np.full(n, n), np.full(n, 9, np.uint64))) == list(range(n))


# Quality classifier


def test_classifier_on_documents_it_has_not_seen(spark, given_docs):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    seen = labels.where("doc_id % 4 <> 0")
    found = quality.classify(given_docs, seen, "source", "lang").join(labels.where("doc_id % 4 = 0"), "doc_id").toPandas()
    junk = found["quality"] == 0
    assert found[junk]["kept"].mean() < 0.1 and found[~junk & (found["toxic"] == 0)]["kept"].mean() > 0.9


def test_small_sites_shrink_to_the_global_rate(spark):
    text = {1: "fine calm words of prose here", 0: "BAD $$$ ### junk junk"}
    docs = [(i, text[i % 2], "big", "a") for i in range(80)] + [(100, text[1], "one", "b")] + [(200 + i, text[1], "good", "c") for i in range(40)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    found = quality.classify(docs, labels, "source", "lang").toPandas().set_index("doc_id")
    assert found.loc[0, "host_quality"] < found.loc[100, "host_quality"] < found.loc[200, "host_quality"]
    assert found.loc[1, "kept"] and not found.loc[0, "kept"]


# Exact


@pytest.mark.parametrize("bucket_rows", [1, 3, 50_000])
def test_exact_with_small_buckets(edge_docs, bucket_rows):
    docs = plain(edge_docs)
    groups = collections.defaultdict(list)
    for doc_id, text, _ in docs:
        groups[text.translate(LOWER)].append(doc_id)
    want = []
    for doc_id, text, _ in docs:
        body = text.translate(LOWER)
        keep = max((d for d in groups[body] if d is not None), default=None)
        want.append((doc_id, keep, len(groups[body]), doc_id == keep, hashlib.sha256(body.encode()).hexdigest()))
    assert rows_of(exact.dedup_exact(edge_docs, bucket_rows)) == sorted(want, key=str)


def test_directory_doubles_until_buckets_fit(edge_docs, given_docs):
    _, index, directory, depth = exact.build_index(given_docs, 100)
    sizes = index.groupBy("bucket").count().toPandas()["count"]
    assert depth > 3 and sizes.max() <= 100
    local = directory.toPandas()
    assert local["local_depth"].min() <= depth and local.groupby("bucket")["local_depth"].nunique().max() == 1


def coarse_key(body):
    """A key of three bits, so that different texts share their keys."""
    return F.shiftleft(F.pmod(F.xxhash64(body), F.lit(8)), 61)


def test_texts_of_one_key_are_told_apart_in_its_chain(given_docs, monkeypatch):
    texts = given_docs.limit(300).select("doc_id", "text")
    docs = texts.unionByName(texts.where("doc_id % 3 = 0").select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.upper("text").alias("text")))
    want = rows_of(exact.dedup_exact(docs))
    monkeypatch.setattr(exact, "_key", coarse_key)
    _, index, _, _ = exact.build_index(docs, 2)
    assert index.agg(F.max("chain")).first()[0] > 20
    assert rows_of(exact.dedup_exact(docs, 2)) == want


def test_rows_answer_through_directory_and_buckets(given_docs, monkeypatch):
    docs = given_docs.select("doc_id", "text")
    build = exact.build_directory

    def one_bucket_lost(entries, bucket_rows):
        directory, depth = build(entries, bucket_rows)
        return directory.where(F.col("bucket") != directory.agg(F.min("bucket")).first()[0]), depth

    _, index, _, _ = exact.build_index(docs, 100)
    lost = index.join(index.agg(F.min("bucket").alias("bucket")), "bucket").agg(F.sum("group_size")).first()[0]
    monkeypatch.setattr(exact, "build_directory", one_bucket_lost)
    assert exact.dedup_exact(docs, 100).count() == docs.count() - lost


def test_only_texts_of_shared_keys_enter_the_index_with_their_bytes(edge_docs):
    _, index, _, _ = exact.build_index(edge_docs, 3)
    assert index.where("(group_size = 1) != (digest IS NULL)").isEmpty()


def test_native_operators_run_no_python(given_docs):
    for df in (exact.dedup_exact(given_docs), lines.drop_lines(given_docs, "source")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# Rules and lines


def test_rules_in_edge_cases(edge_docs):
    found = rules.judge(edge_docs).collect()
    by_words = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"]) for r in found)
    assert by_words == collections.Counter((d, len(words(t)), sum(map(len, words(t)))) for d, t, _ in plain(edge_docs))
    assert all(not r["kept"] for r in found if r["n_words"] < 10)
    cleaned = rules.clean(edge_docs)
    assert cleaned.columns == edge_docs.columns and cleaned.count() == sum(r["kept"] for r in found)


def test_failing_lines_go_and_the_rest_stays(spark):
    good = "The first sentence has enough words to pass on its own."
    bad = ["Home | News | About | Contact us | Help.", "All rights reserved.", "no sentence end here", "WHAT IS THIS NOISE!!", "a### b$$$ c%%%."]
    docs = spark.createDataFrame([(1, "\n".join([good, *bad, "", "A second one follows here, and it is different."])), (2, "\n".join(bad))], "doc_id long, text string")
    assert [r["text"] for r in rules.clean(docs, 70).collect()] == ["\n".join([good, "", "A second one follows here, and it is different."])]


def test_long_lines_may_mention_a_stock_phrase(spark):
    long = " ".join(f"word{i}" for i in range(20_000)) + " of the privacy policy."
    docs = spark.createDataFrame([(1, long), (2, "Read our privacy policy. " + "It goes on a bit. " * 4)], "doc_id long, text string")
    assert [(r["doc_id"], r["kept"], r["n_failed_lines"]) for r in rules.judge(docs).orderBy("doc_id").collect()] == [(1, True, 0), (2, False, 1)]


@pytest.mark.parametrize("line", ["这是一个完整的句子。", "这是真的吗？", "यह एक पूरा वाक्य है।", "هل هذه جملة كاملة؟"])
def test_sentences_of_other_scripts_pass(line):
    assert not rules.line_fails(line, line.split())


def test_lines_in_edge_cases(spark, edge_docs):
    found = lines.clean_pages(edge_docs, "source")
    assert found.columns == edge_docs.columns and found.count() == edge_docs.count()
    pages = [(i, f"menu \nown {i}\n\nmenu", "a") for i in range(10)] + [(20, "menu", None), (21, "menu", "b"), (22, None, "a")]
    pages = spark.createDataFrame(pages, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in lines.drop_lines(pages, "source").collect()}
    assert got == {**{i: f"own {i}\n" for i in range(10)}, 20: "menu", 21: "menu", 22: None}


def test_copies_of_a_page_do_not_empty_it(spark):
    page = "A first line of its own.\nA second line of its own."
    rows = [(i, f"menu\nown {i}" if i < 20 else page, "a") for i in range(30)]
    got = {r["doc_id"]: r["text"] for r in lines.clean_pages(spark.createDataFrame(rows, "doc_id long, text string, source string"), "source").collect()}
    assert got == {i: f"own {i}" if i < 20 else page for i in range(30)}


# Token counts


def test_counts_follow_edits(given_docs):
    encode = packing.encoder()
    found = {r["doc_id"]: r for r in token_counts.count_after_edits(given_docs).collect()}
    for doc_id, text, _ in plain(given_docs):
        new, at = "", 0
        for lo, hi, mask in token_counts.mask_edits(text):
            new, at = new + text[at:lo] + mask, hi
        row = found[doc_id]
        assert row["n_tokens"] == len(encode(text)) and row["n_tokens_after"] == len(encode(new + text[at:]))
        assert row["n_chars_encoded"] <= len(new) + len(text[at:])


@pytest.mark.parametrize("text", ["地址192.168.0.1在这里", "é192.168.0.1é"])
def test_addresses_beside_letters_of_any_script(spark, text):
    assert token_counts.mask_edits(text)
    assert [r["n_edits"] for r in token_counts.count_after_edits(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()] == [1]


def test_masks_are_those_of_the_plain_patterns():
    plain_masks = re.compile(r"([a-zA-Z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})|(\b\d{1,3}(?:\.\d{1,3}){3}\b)|(\+?\d[\d ()-]{7,}\d)", re.ASCII)
    rng = np.random.default_rng(5)
    texts = ["a@b.com_x@d.org", "1.2.3.4%x@d.org", "1.2.3.4.5.6.7.8@a.bc", "a@b.c", "1" + "-" * 30 + "2x@y.zz"]
    texts += ["".join(rng.choice(list("ab1.@-_ +2\u00e9"), 60, p=[0.15, 0.1, 0.2, 0.2, 0.1, 0.05, 0.05, 0.03, 0.02, 0.05, 0.05])) for _ in range(20_000)]
    for text in texts:
        found = [(*m.span(), token_counts.MASKS[m.lastindex - 1][1]) for m in plain_masks.finditer(text)]
        assert token_counts.mask_edits(text) == found, text
        assert not found or re.search(token_counts.ANY_MASK, text, re.ASCII)


def test_masks_of_long_words_take_linear_time(spark):
    texts = ["a" * 1_000_000, "1." * 500_000, "1.2.3.4%" * 125_000, "aB3+" * 250_000, "1" + " " * 1_000_000]
    start = time.monotonic()
    found = [len(token_counts.mask_edits(text)) for text in texts]
    assert found == [0, 125_000, 125_000, 0, 0] and time.monotonic() - start < 5
    docs = spark.createDataFrame([(text,) for text in texts], "text string").coalesce(1).cache()
    docs.count()
    start = time.monotonic()
    assert docs.where(docs["text"].rlike(token_counts.ANY_MASK)).count() == 2 and time.monotonic() - start < 5
    docs.unpersist()


def test_any_edit_anywhere():
    encode = packing.encoder()
    rng = np.random.default_rng(3)
    alphabet = list("ab  '\n1é.,s")
    for _ in range(300):
        text = "".join(rng.choice(alphabet, rng.integers(0, 120)))
        sizes = token_counts.leaf_sizes(text, 8)
        ends = np.cumsum([0, *sizes])
        counts = [len(encode(text[a:b])) for a, b in zip(ends, ends[1:])]
        assert sum(counts) == len(encode(text))
        marks = sorted(rng.choice(len(text) + 1, min(len(text) + 1, 4), replace=False).tolist())
        edits = [(a, b, "".join(rng.choice(alphabet, rng.integers(0, 5)))) for a, b in zip(marks[::2], marks[1::2])]
        new, at = "", 0
        for lo, hi, mask in edits:
            new, at = new + text[at:lo] + mask, hi
        assert token_counts.apply_edits(text, sizes, counts, edits, lambda s: len(encode(s)))[0] == len(encode(new + text[at:]))


# All of them


RUNS = {
    "pack": packing.pack, "remove_repeats": substrings.remove_repeats, "score": lm.score, "near_groups": simhash.near_groups,
    "near_dedup": simhash.near_dedup, "mix_report": mixing.mix_report, "mixed_documents": mixing.mixed_documents, "dedup_exact": exact.dedup_exact,
    "judge": rules.judge, "clean": rules.clean, "clean_pages": lambda d: lines.clean_pages(d, "source"), "token_counts": token_counts.count_after_edits,
    "classify": lambda d: quality.classify(d, d.selectExpr("doc_id", "1 AS quality", "0 AS toxic"), "source", "lang"),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_empty_table(no_docs, name):
    assert RUNS[name](no_docs).count() == 0


@pytest.mark.parametrize("name", ["score", "token_counts", "classify", "near_groups"])
def test_edge_rows_are_all_answered(edge_docs, name):
    assert RUNS[name](edge_docs).count() == edge_docs.count()


# Pipeline


def test_pipeline_equals_its_plain_form(spark, given_docs):
    docs = [(d, t, s) for d, t, s in plain(given_docs)]
    kept = []
    for d, text, s in docs:
        _, failed, ok, cleaned = rules._judged([text.encode()], rules.MAX_LOSS_PERCENT)
        if ok[0]:
            kept.append((d, cleaned[0], s))
    pages, holds = collections.Counter(s for *_, s in kept), collections.Counter()
    for _, text, s in kept:
        holds.update({(s, line.strip(" ")) for line in text.split("\n") if line.strip(" ")})
    drop = {k for k, n in holds.items() if n >= lines.MIN_PAGES and n > lines.MAX_RATIO * pages[k[0]]}
    kept = sorted((d, "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in drop), s) for d, t, s in kept)
    groups = brute_groups(np.array([simhash.fingerprint(t.encode()) for _, t, _ in kept], np.uint64))
    kept = [row for i, row in enumerate(kept) if groups[i] == i]

    stage = given_docs
    for i, (_, step) in enumerate(STAGES[:-1]):
        stage = written(step(spark, stage, SF_DIR), "stage")
        assert stage.columns == given_docs.columns
        if i == 2:
            assert sorted(plain(stage)) == kept
    sizes = sum(len(words(t)) for _, t, _ in kept)
    mixed = plain(stage)
    assert abs(sum(len(words(t)) for _, t, _ in mixed) - 1.5 * sizes) <= len({s for *_, s in kept})
    found = run(spark, SF_DIR).toPandas()
    whole = packing.pack(stage).toPandas()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(found[columns].itertuples(index=False)) == sorted(whole[columns].itertuples(index=False))
    assert found.groupby("sequence_id")["length"].sum().max() <= 2048


# Cases of several operators


NOT_UTF8 = "CAST(unhex('61FF62') AS STRING)"


def test_texts_that_are_not_utf8_are_answered(spark):
    docs = spark.range(3).selectExpr("id AS doc_id", f"concat({NOT_UTF8}, repeat(' word', 5 + CAST(id AS INT)), ' tail') AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    found = {r["doc_id"]: r for r in substrings.remove_repeats(docs).collect()}
    assert [found[i]["n_words"] for i in range(3)] == [7, 8, 9] and found[0]["kept_text"].startswith("a�b word")
    mixed = mixing.mixed_documents(docs).collect()
    assert mixed and all(set(r["text"].split()) <= {"a�b", "word", "tail"} for r in mixed)


def test_columns_keep_their_values_whatever_their_names(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(6)]
    docs = spark.createDataFrame(
        [(i, t, "s", 7, i + 50, "a", "b", "c", [1]) for i, t in enumerate(texts)],
        "doc_id long, text string, source string, __th int, n_lines long, __keep string, __d string, __stay string, __spans array<int>",
    )
    for found in (simhash.near_dedup(docs), mixing.mixed_documents(docs), lines.clean_pages(docs, "source")):
        assert found.columns == docs.columns
        for row in found.collect():
            assert row[3:] == (7, row["doc_id"] + 50, "a", "b", "c", [1])
    counted = lines.drop_lines(docs, "source")
    assert counted.columns.count("n_lines") == 1 and {r["n_lines"] for r in counted.collect()} == {1}


def sql_rows(df, sql):
    connection = duckdb.connect()
    connection.register("documents", df.toArrow())
    return connection.execute(sql).df()


def test_rules_and_their_sql_agree_on_hard_lines(spark):
    long = " ".join(f"word{i}" for i in range(60))
    texts = [
        f"{long} privacy policy {long}.", "See our privacy policy.\n" + long + ".", "Lisez la politique de confidentialité.\n" + long + ".",
        "Conditions d'utilisation du site.\n" + long + ".", "这是一个句子。后面还有一句话没有空格\n" + long + ".", "यह एक वाक्य है। और\n" + long + ".", "نص عربي؟\n" + long + ".",
        "one two. three\n" + long + ".", "one two.three\n" + long + ".", None, "", "\n\n",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = rules.judge(docs).toPandas()
    assert difference(found, sql_rows(docs, rules.ORACLE_SQL)) is None
    failed = dict(zip(found["doc_id"], found["n_failed_lines"]))
    assert [failed[i] for i in range(9)] == [0, 1, 1, 1, 0, 0, 0, 0, 1]


def test_lines_and_their_sql_agree_on_nulls(spark):
    rows = [(i, f"menu\nline {i}", None) for i in range(5)] + [(9, None, None), (10, None, "s"), (None, "menu", None)] + [(i, f"menu\nown {i}", "s") for i in range(20, 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = lines.drop_lines(docs, "source").toPandas()
    assert difference(found, sql_rows(docs, lines.ORACLE_SQL)) is None
    assert len(found) == len(rows) and not found["text"].fillna("").str.contains("menu").any()


@pytest.mark.parametrize("n_sources", [3, 64, 65, 5_000])
def test_shards_draw_from_any_number_of_sources(spark, n_sources):
    slots = [i % 7 + 1 for i in range(n_sources)]
    sources = spark.createDataFrame(list(enumerate(slots)), "src long, slots long")
    found, again = (mixing._draws(sources, 100, 5).toPandas().sort_values(["shard", "src"], ignore_index=True) for _ in range(2))
    assert found.equals(again) and not found.duplicated(["shard", "src"]).any()
    sizes = found.groupby("shard")["n"].sum()
    assert (sizes.iloc[:-1] == 100).all() and sizes.sum() == sum(slots)
    # Sources are drawn by weight: the heavier half gets its share of all draws.
    heavy = sum(s for s in slots if s > 4)
    assert abs(found.loc[found["src"] % 7 >= 4, "n"].sum() - heavy) <= 6 * math.sqrt(sum(slots))


def plain_strength(groups):
    """``groups``: (sum, n, rate of the parent, n of the parent)."""
    free = sum(n * (1 - n / of) for _, n, _, of in groups)
    total = sum(n for _, n, _, _ in groups)
    if free <= 1e-9 * total:
        return 1e6
    between = (sum(n * (s / n - r) ** 2 for s, n, r, _ in groups) - sum(r * (1 - r) * (1 - n / of) for _, n, r, of in groups)) / free
    noise = sum(n * r * (1 - r) for _, n, r, _ in groups) / total
    return min(max(noise / between - 1, 1), 1e6) if between > 0 else 1e6


def plain_posteriors(rows):
    """Per row of (host, path, p): rate of its host, rate of its path, posterior."""
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for host, path, p in rows:
        hosts[host].append(p)
        paths[host, path].append(p)
    rate = sum(p for _, _, p in rows) / len(rows)
    strength = plain_strength([(sum(v), len(v), rate, len(rows)) for v in hosts.values()])
    host_rate = {h: (strength * rate + sum(v)) / (strength + len(v)) for h, v in hosts.items()}
    below = plain_strength([(sum(v), len(v), sum(hosts[h]) / len(hosts[h]), len(hosts[h])) for (h, _), v in paths.items()])
    odds = lambda p: p / (1 - p)
    out = []
    for host, path, p in rows:
        own = paths[host, path]
        path_rate = (below * host_rate[host] + sum(own)) / (below + len(own))
        others = (below * host_rate[host] + sum(own) - p) / (below + len(own) - 1)
        post = odds(p) * odds(others) / odds(rate)
        out.append((host_rate[host], path_rate, post / (1 + post)))
    return out, below


def classified(spark, monkeypatch, rows):
    scores = spark.createDataFrame([(i, h, p, s, 1 - s) for i, (h, p, s) in enumerate(rows)], "doc_id long, host string, path string, quality double, toxic double")
    monkeypatch.setattr(quality, "fit", lambda *_: None)
    monkeypatch.setattr(quality, "evidence", lambda *_: scores)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    return quality.classify(scores, empty, "host", "path").toPandas().sort_values("doc_id")


def test_rates_and_posteriors_equal_their_plain_form(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(f"h{h}", f"p{p}", float(np.clip(rng.normal(0.2 + 0.1 * h, 0.1), 0.02, 0.98))) for h in range(6) for p in range(5) for _ in range(1 + 7 * (h + p) % 9)]
    rows += [(None, None, 0.7), (None, "p0", 0.4)]
    want, _ = plain_posteriors(rows)
    found = classified(spark, monkeypatch, rows)
    np.testing.assert_allclose(found[["host_quality", "path_quality", "p_quality"]].to_numpy(), np.array(want), rtol=1e-9)


def test_paths_are_measured_around_their_host(spark, monkeypatch):
    rows = [(h, f"p{i % 50}", p) for h, p in (("good", 0.9), ("bad", 0.1)) for i in range(200)]
    _, below = plain_posteriors(rows)
    found = classified(spark, monkeypatch, rows)
    assert below == 1e6 and np.allclose(found["path_quality"], found["host_quality"], atol=1e-5)


def test_mixing_hands_each_text_over_once(spark):
    rows = [(i, f"some words of text {i} " * 9, "en", f"s{i % 3}", 0) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = mixing.mixed_documents(docs, block_words=4)
    assert ".text AS text" not in mixed._jdf.queryExecution().executedPlan().toString() and mixed.columns == docs.columns
