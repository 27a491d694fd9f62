"""Every operator against a brute-force version, on tables with nulls, empty and long texts,
repeated rows and columns with clashing names, and on empty tables."""

import base64
import collections
import hashlib
import itertools
import math
import os
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from keystrand.llm import base, fingerprints, jaccard, licenses, mixing, outliers, packing, ppm, quality, queries, scratch, stats, tokens, warc
from keystrand.llm import text as X

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()),
                     *((n, T.StringType()) for n in ("size", "place", "x", "g", "cls", "token", "comp", "train", "h", "k0", "q_hash", "l_text", "label", "fingerprint", "slot", "m_source")))])


def messy():
    rng = random.Random(11)
    words = ["alpha", "Beta", "gamma", "délta", "eps", "zeta,", "eta", "theta.", "iota", "kappa", "naïve", "ΣΑΣ", "x1", "the", "of"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [None, "", "   \n\t", "one", "two words", "Same Text here for all of us now", "same text  here FOR all of us now", "\x1c odd \x85 gap", "é é", "😀 emoji 中文 字"]
    base = make(60)
    texts += [base, base, base.replace("alpha", "omega", 1), base + " extra", make(5), make(4), make(3000), "line one\nline one\nline one\n" * 20, "# $ % & | < >" * 10]
    texts += [make(rng.randint(1, 90)) for _ in range(30)]
    texts += ["Licensed under the MIT License. Copyright (c) 2020 Foo. All rights reserved.", "GNU General Public License v3, CC-BY 4.0 and cc by", "SPDX-License-Identifier: Apache-2.0 all-rights\nreserved", "accbyte ccé by", "nul\x00in\x7fword all\x00rights\x01reserved", "\u212aMIT LICENSE and mit l\u0130cense, L\u0130CENSED UNDER THE GPL 2"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, "é"]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[10], (None, base, "en", "s1", 1), (7777, base, None, None, 1)]
    return [(*r, *["clash"] * (len(DOCS) - 5)) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(messy(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def words(t):
    return WORD.findall(t or "")


def low(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def in_order(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, str(r)))


# -- kernels ----------------------------------------------------------------------


def test_word_kernels():
    texts = [r[1] for r in messy()] + ["a" * 5000 + " b"]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()).slice(2)):
        offsets, data = X.string_buffers(column)
        hashes, first = X.word_hashes(offsets, data)
        seen = {}
        for i, t in enumerate(column.to_pylist()):
            own = words(low(t))
            assert first[i + 1] - first[i] == len(own)
            for w, h in zip(own, hashes[first[i] : first[i + 1]]):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_long_text_is_cut_at_gaps(monkeypatch):
    monkeypatch.setattr(X, "_SEGMENT", 64)
    text = " ".join("w%d" % (i % 50) * (1 + i % 30) for i in range(300))
    a = X.word_hashes(*X.string_buffers(pa.array([text])))[0]
    monkeypatch.setattr(X, "_SEGMENT", 1 << 20)
    assert (a == X.word_hashes(*X.string_buffers(pa.array([text])))[0]).all()


def test_lookup():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 5000).astype(np.uint64))
    table = X.Lookup(keys)
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(np.array([3, 5], np.uint64)) == -1).all()


# -- 1: mixing ---------------------------------------------------------------------


def test_water_fill():
    assert mixing.water_fill([10, 10, 10], [5, 2, 1], 3) == [18.75, 7.5, 3.75]
    assert mixing.water_fill([1, 100], [5, 2], 3) == [3.0, 98.0]
    assert mixing.water_fill([], [], 3) == [] and mixing.water_fill([0, 7], [5, 2], 3) == [0.0, 7.0]


def test_split_quotas():
    quotas = [256, 700, 3, 0, 41]
    out = mixing.split_quotas(quotas, 7, 1)
    assert out.sum(axis=0).tolist() == quotas and max(out.sum(axis=1)) - min(out.sum(axis=1)) <= 1
    assert (out == mixing.split_quotas(quotas, 7, 1)).all()


def test_mixture(spark, docs, nothing):
    got = in_order(mixing.mixture(docs).select("doc_id", "size", "source_size", "target", "taken", F.size("shards")))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    assert sorted((str(r[0]), r[1]) for r in got) == sorted((str(i), len(words(t))) for i, t, _ in rows)
    assert got == in_order(mixing.mixture(docs.repartition(5)).select("doc_id", "size", "source_size", "target", "taken", F.size("shards")))
    assert all(r[4] == r[1] * r[5] <= 3 * r[1] for r in got)
    assert mixing.mixture(nothing).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    want = collections.Counter()
    for r in got:
        want[r[0]] += r[5]
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == +want


def test_mixture_meets_targets(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    big = d.unionAll(d.withColumn("doc_id", F.col("doc_id") + 10_000)).unionAll(d.withColumn("doc_id", F.col("doc_id") + 20_000)).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b"))
    rows = mixing.mixture(big).groupBy("target", "source_size").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.max("size").alias("most")).collect()
    assert len(rows) == 3
    for r in rows:
        assert r["size"] == r["source_size"] and abs(r["taken"] - r["target"]) <= r["most"]
    assert math.isclose(sum(r["target"] for r in rows), sum(r["size"] for r in rows))


def test_rows_that_repeat_are_split(spark):
    rows = [(7, "four words are here", "a")] * 100 + [(k, "one two", "b") for k in range(10)] + [(1, "x y z", None)] * 9
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mixture(d).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    assert len(got) == 3 and {r["n"] for r in got} == {100, 10, 9}
    assert all(abs(r["taken"] - r["target"]) <= r["size"] for r in got)
    again = mixing.mixture(d.repartition(2)).agg(F.sum("taken")).first()[0]
    assert again == sum(r["taken"] for r in got) == mixing.mix(d).agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]


# -- 2: language model -------------------------------------------------------------


def ppm_model(train):
    counts = collections.defaultdict(collections.Counter)
    k = ppm.ORDER

    def symbols(t):
        b = [255] * k + list(low(t).encode()) + [255]
        for i in range(k, len(b)):
            yield tuple(b[i - k : i]), b[i]

    for t in train:
        for ctx, s in symbols(t):
            for n in range(k + 1):
                counts[ctx[k - n :]][s] += 1

    def log_p(ctx, s):
        out, gone = 0.0, set()
        for n in range(k, -1, -1):
            own = counts.get(ctx[k - n :])
            if own is None:
                gone = set()
                continue
            live = {x: v for x, v in own.items() if x not in gone}
            if live:
                total = sum(live.values())
                if s in live:
                    return out + math.log10((live[s] - 0.5) / total)
                out += math.log10(0.5 * len(live) / total)
            gone = set(own)
        return out - math.log10(256 - len(gone))

    return lambda t: sum(log_p(c, s) for c, s in symbols(t)), log_p


def test_lm_scores(spark, docs, nothing):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [t or "" for i, t in rows if not held(i)]
    c = collections.Counter(w for t in train for w in [*words(low(t)), None])
    n, v = sum(c.values()), len(c)
    model, log_p = ppm_model(train)
    assert math.isclose(sum(10 ** log_p((255, 255, 97, 98, 99), s) for s in range(256)), 1)
    want = []
    for i, t in rows:
        own = [*words(low(t)), None]
        want.append((i, held(i), len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in own), model(t or "")))
    key = lambda r: (r[0] is None, r[0] or 0, round(r[6], 3))
    got = sorted((tuple(r) for r in ppm.score(docs).collect()), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], abs_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-5, abs_tol=1e-4)
    assert ppm.score(nothing).count() == 0
    alone = spark.createDataFrame([(i, "ab") for i in range(30) if held(i)], "doc_id long, text string")
    assert all(r["train_tokens"] == 0 and math.isclose(r["score"], -3 * math.log10(256), rel_tol=1e-6) for r in ppm.score(alone).collect())


# -- 3: quality --------------------------------------------------------------------


def test_quality_held_out_accuracy(spark):
    sf = SMALL.replace("0.001", "0.01")
    got = queries.op3_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    right, n, low_, high = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count(F.lit(1)), F.min("score"), F.max("score")).first()
    assert n > 80 and right > 0.97 and 0 < low_ < 0.5 < high < 1


def test_quality_edges(spark, docs, nothing, labels):
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(nothing, labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)


def test_discriminant_is_the_density_difference():
    rng = np.random.default_rng(2)
    m = quality.Discriminant(rng.normal(size=(2, 3)), np.stack([np.linalg.inv(np.linalg.cholesky(c)) for c in (np.eye(3) * 2, np.diag([1, 2, 3.0]))]), np.array([math.log(8), math.log(6)]), 0.3)
    x = rng.normal(size=(4, 3))
    log = lambda k, c: -0.5 * np.einsum("ij,jk,ik->i", x - m.means[k], np.linalg.inv(c), x - m.means[k]) - 0.5 * math.log(np.linalg.det(c))
    e = log(1, np.diag([1, 2, 3.0])) - log(0, np.eye(3) * 2) + 0.3
    assert np.allclose(m.evidence(x), np.sign(e) * np.log1p(abs(e)))


# -- 4: token counts ---------------------------------------------------------------


def test_token_counts(spark, docs, nothing):
    path = queries.tokenizer_path(spark, "piece_bpe_32k.model")
    counter = tokens.Counter(path)

    def brute(t):  # over the whole text, without pre-tokens or trie
        own = ("▁" + t.replace(" ", "▁")) if t else ""
        best = [(0.0, 0)]
        for d in range(1, len(own) + 1):
            options = [(best[s][0] + counter.scores[own[s:d]], best[s][1] + 1) for s in range(max(0, d - counter.longest), d) if own[s:d] in counter.scores]
            if own[d - 1] not in counter.scores:
                options.append((best[d - 1][0] + counter.unknown, best[d - 1][1] + len(own[d - 1].encode())))
            best.append(max(options, key=lambda o: o[0]))
        return best[-1][1]

    got = in_order(tokens.token_counts(docs, path).select("doc_id", "n_tokens"))
    assert got == sorted(((r["doc_id"], brute(r["text"] or "")) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0, str(r)))
    assert tokens.token_counts(nothing, path).count() == 0


def test_token_counts_as_the_library_has_them(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = queries.tokenizer_path(spark, "piece_bpe_32k.model")
    raw = bytearray(open(path, "rb").read())

    def number(i):
        value = shift = 0
        while True:
            value |= (raw[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if raw[i - 1] < 128:
                return value, i

    i = 0
    while i < len(raw):  # set model_type (field 3 of trainer_spec, field 2) to unigram
        tag, i = number(i)
        size, i = number(i)
        j = i
        while tag >> 3 == 2 and j < i + size:
            field, at = number(j)
            if field & 7 == 0:
                if field >> 3 == 3:
                    raw[at] = 1
                j = number(at)[1]
            elif field & 7 == 2:
                n, at = number(at)
                j = at + n
            else:
                j = at + (4 if field & 7 == 5 else 8)
        i += size
    unigram = sentencepiece.SentencePieceProcessor(model_proto=bytes(raw))
    counter = tokens.Counter(path, ranks=False)
    texts = ["the quick brown fox", "interesting international", "a", "hello world, again"]
    assert [n for n, _ in counter.count(texts)] == [len(unigram.nbest_encode(t, nbest_size=2, out_type=str)[0]) for t in texts]


# -- 5: similarity join ------------------------------------------------------------


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = words(low(t))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    low_ = collections.defaultdict(list)
    for k, (i, _) in enumerate(sets):
        low_[find(k)].append(i)
    return [(i, len(s), min((j for j in low_[find(k)] if j is not None), default=None)) for k, (i, s) in enumerate(sets)]


def near_copies(seed, groups=12):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 8, 40, 120, 300]))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                own[rng.randrange(len(own))] = f"v{rng.randint(0, 99)}"
            rows.append((len(rows), " ".join(own)))
    shared = " ".join(f"common{i}" for i in range(60))
    return rows + [(len(rows) + k, shared + " " + " ".join(f"own{k}.{i}" for i in range(rng.randint(1, 12)))) for k in range(25)]


@pytest.mark.parametrize("seed", [1, 2])
def test_similarity_join(spark, seed):
    rows = near_copies(seed)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert in_order(got) == sorted(brute_components(rows))


def test_similarity_join_edges(spark, docs, nothing, monkeypatch):
    want = sorted(brute_components([(r["doc_id"], r["text"]) for r in docs.collect()]), key=lambda r: (r[0] is None, r[0] or 0, str(r)))
    assert in_order(jaccard.join(docs)) == want
    monkeypatch.setattr(jaccard, "HOT", 2)  # every shingle that is met twice is dealt out
    monkeypatch.setattr(jaccard, "NEIGHBOURS", 2)
    monkeypatch.setattr(jaccard, "SALT_ROWS", 1)  # and its rows are dealt over as many salts
    assert in_order(jaccard.join(docs)) == want
    assert jaccard.join(nothing).count() == 0


def test_one_of_each(spark, docs, nothing):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    blank = sum(n == 0 for _, n, _ in want)
    assert kept.count() == blank + len({c for _, n, c in want if n})
    assert collections.Counter(r["doc_id"] for r in kept.collect() if words(r["text"])) == collections.Counter({c for _, n, c in want if n})
    assert jaccard.keep_one(nothing).count() == 0


def shuffled(spark):
    """Bytes that the session has written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_similarity_join_moves_little(spark):
    rng = random.Random(5)
    rows = []
    for k in range(150):  # texts of one shared passage and much of their own, which meet and don't link, and near copies
        own = " ".join(f"shared{i}" for i in range(90)).split() + [f"own{k}.{i}" for i in range(rng.randint(300, 400))]
        rows += [(len(rows) + j, " ".join([*own[: len(own) - 3 * j], *(f"new{k}.{j}.{i}" for i in range(3 * j))])) for j in range(1 + (k % 3 == 0))]
    before = shuffled(spark)
    got = in_order(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    moved = shuffled(spark) - before
    assert got == sorted(brute_components(rows))
    assert moved < 25 * sum(n for _, n, _ in got)


def test_sets_go_once_pairs_are_verified(spark):
    jaccard.join(spark.createDataFrame(near_copies(3), "doc_id long, text string"))
    folder = scratch.shared_dir(spark).removeprefix("file://") + "/keystrand"
    assert not [name for name in os.listdir(folder) if name.startswith("sets-")]


def test_packed_rows_and_sets():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5000):
        rows = np.empty(n, jaccard._ROW)
        rows["token"] = np.sort(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False)) >> jaccard._TOKEN_LOW << jaccard._TOKEN_LOW
        rows["cls"], rows["n"], rows["pos"] = rng.integers(-(1 << 63), 1 << 63, n), rng.integers(1, 3000, n), rng.integers(0, 600, n)
        packed = jaccard._pack(rows)
        assert np.array_equal(jaccard._unpack(pa.py_buffer(packed)), rows)
        assert n < 5000 or len(packed) < 17 * n
        keys = np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
        assert np.array_equal(jaccard._unpack_set(pa.py_buffer(jaccard._pack_set(keys))), keys)


def test_prefix_bound():
    for n in range(1, 500):
        assert n // 5 + 1 == n - -(-80 * n // 100) + 1


# -- 6: quality rules --------------------------------------------------------------


def base_stats(t):
    t = t or ""
    w, seen, dup, at = words(t), set(), 0, collections.defaultdict(list)
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    repeat = len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)})
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, repeat


def test_rules_base(docs, nothing, monkeypatch):
    got = in_order(outliers.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    want = []
    for r in docs.collect():
        s = base_stats(r["text"])
        want.append((r["doc_id"], *s, s[0] < 20 or 100 * s[4] > 30 * s[0]))
    assert got == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, str(r)))
    assert outliers.judge(docs).where("base_failed and kept").count() == 0
    assert outliers.judge(nothing).count() == 0
    monkeypatch.setattr(outliers, "BROADCAST_GROUPS", 0)  # models are joined by salted keys
    kept = outliers.keep_normal(docs)
    assert kept.columns == docs.columns and kept.count() == outliers.judge(docs).where("kept").count()


def test_random_texts_have_the_base_statistics():
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a ", "b ", "\n", "é", "# ", "|", "A "]) for _ in range(rng.randint(0, 200))) for _ in range(200)] + ["a b c\n" * k for k in range(12)] + [None]
    got = stats.statistics(pa.array(texts))
    assert [tuple(int(v) for v in r[:5]) for r in got] == [base_stats(t) for t in texts]


def best_subset(x, target=None):
    """The subset of least determinant, of all there are."""
    n, h = len(x), max(1, math.ceil(outliers.SHARE * len(x)))
    det = lambda own: np.linalg.slogdet(outliers.regularised(np.cov(x[own].T, bias=True) if len(own) > 1 else np.zeros((outliers.D,) * 2), n, target))[1]
    return np.array(min((list(c) for c in itertools.combinations(range(n), h)), key=det))


def test_small_groups_are_judged_by_their_own_best_subset(spark):
    sf = SMALL.replace("0.001", "0.01")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = d.select("doc_id", "lang", "source", "text").collect()
    s = stats.statistics(pa.array([r["text"] for r in rows]))
    x = stats.features(s)[:, outliers.AT]
    groups = collections.defaultdict(list)
    for k, r in enumerate(rows):
        if s[k, 0] >= 20 and 100 * s[k, 4] <= 30 * s[k, 0]:
            groups[r["lang"], r["source"]].append(k)
    groups = {g: np.array(at) for g, at in groups.items() if math.comb(len(at), math.ceil(outliers.SHARE * len(at))) <= 6000}
    few = {k for at in groups.values() for k in at.tolist()}
    assert len(groups) > 40
    d = d.where(F.col("doc_id").isin([rows[k]["doc_id"] for k in few]))
    own = {g: x[at][best_subset(x[at])] for g, at in groups.items()}
    target = sum(len(v) * np.cov(v.T, bias=True) for v in own.values() if len(v) > 1) / sum(map(len, own.values()))
    want = {}
    for at in groups.values():
        v = x[at][best_subset(x[at], target)]
        cov = np.cov(v.T, bias=True) if len(v) > 1 else np.zeros((outliers.D,) * 2)
        y = x[at] - v.mean(axis=0)
        dist = np.einsum("ij,jk,ik->i", y, np.linalg.inv(outliers.regularised(cov, len(at), target)), y)
        want |= {rows[k]["doc_id"]: q <= outliers.CUTOFF for k, q in zip(at.tolist(), dist)}
    got = {r["doc_id"]: r["kept"] for r in outliers.judge(d).collect()}
    assert got.keys() == want.keys() and 0 < sum(not v for v in want.values())
    assert got == want


@pytest.mark.parametrize("seed", range(6))
def test_concentration_finds_the_least_determinant(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rng.integers(4, 12), outliers.D)) * rng.choice([0.1, 1, 3])
    det = lambda own: np.linalg.slogdet(outliers.regularised(np.cov(x[own].T, bias=True), len(x)))[1]
    assert det(outliers.concentrate(x, starts=60)) <= det(best_subset(x)) + 1e-6


def test_concentration_ignores_outliers():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, outliers.D)), rng.normal(8, 0.1, size=(60, outliers.D))])
    own = outliers.concentrate(x)
    assert len(own) == math.ceil(outliers.SHARE * 360) and own.max() < 300


def test_rules_reject_junk_and_keep_clean(spark):
    sf = SMALL.replace("0.001", "0.1")
    got = outliers.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    share = {r["quality"]: r["k"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.99 and share[0] < 0.1


# -- 7: fingerprints ---------------------------------------------------------------


def canonical(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return " ".join(t.split())


def test_fingerprints(spark, docs, nothing):
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted((r["doc_id"], r["text"] or "") for r in unique.collect())
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(unique.repartition(5)).collect()}
    by = {}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + following[:n]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == float(canonical(t) == canonical(edited)) and r["near_next"] == float(canonical(t) == canonical(following))
        assert by.setdefault(canonical(t), r["fingerprint"]) == r["fingerprint"]
        assert (r["edited_fingerprint"] == r["fingerprint"]) == (canonical(t) == canonical(edited))
    assert len(set(by.values())) == len(by)
    assert fingerprints.fingerprints(docs).count() == docs.count()
    assert fingerprints.fingerprints(nothing).count() == 0
    one = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    assert fingerprints.fingerprints(one).first()["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_fingerprint_collisions_are_told_apart(spark):
    columns = {"fingerprint": ["d", "d", "d", "e"], "f_check": [1, 1, 2, 3], "canon": ["a", "a", "b", "c"], "salt": pa.array([0, 1, 1, 0], pa.int32())}
    batch = pa.RecordBatch.from_pydict(columns)
    rows = pa.Table.from_batches(list(fingerprints._distinct(iter([batch])))).to_pylist()
    assert [(r["canon"], r["salt"]) for r in rows if r["salt"] < 0] == [("a", -1), ("b", -1)]


# -- 8: licenses -------------------------------------------------------------------


def sweep(hits):
    labels, n, held = set(), 0, None
    for start, neg_end, priority, label in sorted(hits):
        end = -neg_end
        if held is None or start >= held[1]:
            if held:
                labels.add(held[3])
                n += 1
            held = (start, end, priority, label)
        elif end > held[1] and priority < held[2]:
            held = (start, end, priority, label)
    return (labels | {held[3]}, n + 1) if held else (set(), 0)


def test_license_scan(docs, nothing):
    names = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    signatures = licenses.rules()
    assert len(signatures) > 300
    got = collections.defaultdict(list)
    for r in licenses.scan(docs).collect():
        got[r["doc_id"]].append(r)
    for d in docs.collect():
        t = d["text"] or ""
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        places = sorted((i, v) for k, v in names.items() for i in range(len(w)) if tuple(w[i : i + len(k)]) == k)
        hits = [(m.start(), -m.end(), s.priority, s.label) for s in signatures if s.keyword in low(t) for m in re.finditer(s.pattern, low(t), re.ASCII)]
        labels, n = sweep(hits)
        r = got[d["doc_id"]].pop()
        assert r["n_words"] == len(w) and r["n_base"] == len(places)
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({v for _, v in places}))
        assert r["labels"] == ",".join(sorted({v for _, v in places} | labels)), t
        assert math.isclose(r["score"], 1 - 0.5 ** (len(places) + n))
    assert licenses.scan(nothing).count() == 0


def test_rule_matches_contain_their_keyword():
    for r in licenses.rules():
        plain = r.pattern.replace("\\", "")
        assert r.keyword in plain or (r.keyword == "licen" and "licen[sc]" in r.pattern) or r.keyword == "cc", r


def test_license_plan_is_native(spark):
    plan = queries.op8_license_scan(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


# -- 9: packing --------------------------------------------------------------------


def test_encode_special_tokens(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_path(spark, "word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    texts = ["a <|endoftext|> b", "plain text", "", *(f"x{a}y {a.upper()} z" for a in added), "\u4e2d <|endoftext|>"]
    assert packing.encode(texts, path) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert 49407 in np.frombuffer(packing.encode(texts[:1], path)[0], "<u4")


def test_encode_splits_words(spark, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_path(spark, "word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(5)
    signs = ["'", "s", "t", "re", "ve", "ll", "m", "d", "'S", "L", "r", "e", "1", "23", " ", "\n", "\t", "\x0b", "-", "!!", "\xe9", "\xc9", "\xdf", "\xff", "\xc5\xd8", "abcdefgh", "0", "\x00", "\xb2", "\xd7", "\u0130", "\u4e2d"]
    texts = ["", "'", "''", "'s", "''s", "'sure", "it's's", "!'s", "1's", "'r", "'re", "'l", "' s", "'", "s", *("x" * k for k in range(7, 35)), *("=" * k for k in range(15, 19)), *("\xe9" * k for k in (8, 9, 16, 17, 40))]
    texts += ["".join(rng.choices(signs[: 27 if k % 4 else None], k=rng.randint(1, 60))) for k in range(3000)]
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for most in (1 << 20, 500):
        assert packing.Encoder(path).encode(texts, most) == want
    monkeypatch.setattr(packing, "CACHE_BYTES", 1 << 15)  # both tables are given up many times
    small = packing.Encoder(path)
    assert small.encode(texts, 500) == want and small.encode(texts[::-1], 500) == want[::-1]


def test_encode_keeps_words(spark, monkeypatch):
    path = queries.tokenizer_path(spark, "word_bpe_49k.json")
    letters = "aeioustrnl"
    texts = [" ".join("".join(letters[int(c)] for c in f"{k:06d}") for k in range(a, a + 10_000)) for a in range(0, 120_000, 10_000)]
    encoder, asked, plain = packing.Encoder(path), [], packing.Encoder._word
    monkeypatch.setattr(packing.Encoder, "_word", lambda self, w: asked.append(w) or plain(self, w))
    first = encoder.encode(texts, 1 << 16)
    assert encoder.encode(texts, 1 << 16) == first and len(asked) == len(set(asked)) == 120_000
    assert encoder.young.nbytes + encoder.old.nbytes < packing.CACHE_BYTES


def test_packing(spark, docs, nothing):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_path(spark, "word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    want = collections.Counter()
    for d in docs.collect():
        ids = [*tok.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            own = ids[k : k + 64]
            want[(d["doc_id"], k // 64, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))] += 1
    rows = packing.packed(docs, path, capacity=64, block=40).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.packed(nothing, path).count() == 0


def test_pack_is_tight():
    rng = np.random.default_rng(7)
    for lengths in (rng.integers(1, 2049, 5000), np.clip(rng.lognormal(6, 1, 20_000).astype(int), 1, 2048), np.array([2048, 1, 1]), np.array([], int)):
        bins = packing.pack(lengths)
        if len(lengths):
            assert np.bincount(bins, weights=lengths).max() <= 2048 and set(bins) == set(range(bins.max() + 1))
            assert bins.max() + 1 <= 1.02 * max(np.ceil(lengths.sum() / 2048), (lengths > 1024).sum()) + 2


# -- 10: archives ------------------------------------------------------------------


def test_archives(spark, monkeypatch):
    rng = random.Random(9)
    html = [None, "", "<p>x</p>", "<p>x</p>", "é\r\n\r\nWARC/1.1\r\n", "long " * 40_000] + [f"<b>{rng.randint(0, 4)}</b>" for _ in range(20)]
    rows = [(i, f"http://Www.Ex{i % 3}.com:80/a b?q={i}#f", h, "clash") for i, h in enumerate(html)] + [(100, None, "y", "c"), (None, "::bad::[", "y", "c"), (2, "http://again.com", "<p>x</p>", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        revisit = i != first[h or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    assert in_order(warc.records(pages)) == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, str(r)))
    got = warc.captures(pages).select("url_key", "captured", "page_id").collect()
    keys = [(r[0], r[1], r[2] is None, r[2] or 0) for r in got]
    assert keys == sorted(keys) and len(keys) == len(rows)
    monkeypatch.setattr(warc, "WINDOW", 2)
    assert keys == [(r[0], r[1], r[2] is None, r[2] or 0) for r in warc.captures(pages).select("url_key", "captured", "page_id").collect()]
    runs = warc.index_runs(warc.write(pages, most_bytes=300))
    assert runs.select("archive").distinct().count() > 3
    assert warc.records(pages.limit(0)).count() == 0


def test_damaged_archive_is_found():
    raw = warc.record(1, "http://a.com/", b"payload", base64.b32encode(hashlib.sha1(b"payload").digest()).decode(), 1)
    assert warc.capture(raw)[2:5] == (1, "response", 7)
    with pytest.raises(ValueError):
        warc.capture(raw.replace(b"payload", b"paxload"))
    with pytest.raises(ValueError):
        warc.parse(raw[:-5])


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 8, 13):
        runs = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 12))) for _ in range(k)]
        got = [(runs[r][i], r, i) for r, i in warc.LoserTree(runs)]
        assert got == sorted((v, r, i) for r, run in enumerate(runs) for i, v in enumerate(run))


def test_url_key():
    assert warc.url_key("HTTP://User@Blog.Example.com:80/A/b?Q=1#top") == "com,example,blog)/a/b?q=1"
    assert warc.url_key("https://a.org:8443") == "org,a:8443)/" and warc.url_key("http://[bad") == "http://[bad"


def test_warc_oracle(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    want = sorted(con.sql(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({queries.ORACLE_SQL['op10_warc']})").fetchall())
    assert in_order(queries.op10_warc(spark, SMALL)) == want


# -- pipeline ----------------------------------------------------------------------


def test_pipeline(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    names, seen = d.columns, d
    ids = [{r[0] for r in d.select("doc_id").collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        seen = stage(spark, seen, SMALL)
        if k < 4:
            assert seen.columns == names
            seen = spark.createDataFrame(seen.toPandas(), d.schema)
            ids.append({r[0] for r in seen.select("doc_id").collect()})
            assert ids[-1] <= ids[-2]
    assert {r[0] for r in seen.select("doc_id").collect()} == ids[-1]
    lab = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    clean = {i for i, q in lab.items() if q == 1}
    assert len(clean & ids[1]) >= 0.97 * len(clean) and len({i for i, q in lab.items() if q == 0} & ids[1]) <= 2


@pytest.mark.parametrize("kind", ["messy", "empty"])
def test_stages_take_nulls_clashing_columns_and_empty_tables(spark, docs, nothing, kind):
    seen = docs if kind == "messy" else nothing
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, seen = seen, scratch.table(stage(spark, seen, SMALL), "stage-test")
        assert k == 4 or (seen.columns == docs.columns and (k == 3 or seen.count() <= before.count()))
        assert seen.count() == 0 or kind == "messy"
        seen = docs if kind == "messy" and k < 3 else seen  # each stage meets all the cases
    assert kind == "empty" or seen.count() > 0


def test_a_very_long_text(spark):
    long = "Some plain words of a very long text, line by line.\n" * 100_000
    d = spark.createDataFrame([(1, long, "en", "s"), (2, "short text", "en", "s")], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"]: r["n_words"] for r in outliers.judge(d).collect()} == {1: 1_100_000, 2: 2}
    rows = packing.packed(d, queries.tokenizer_path(spark, "word_bpe_49k.json")).where("doc_id = 1").collect()
    assert sum(r["length"] for r in rows) > 1_100_000 and {r["start"] for r in rows} == {2048 * k for k in range(len(rows))}
    assert {r["doc_id"]: r["n_chars"] for r in fingerprints.fingerprints(d).collect()} == {1: len(long), 2: 10}
    assert {r["doc_id"]: r["n_words"] for r in licenses.scan(d).collect()} == {1: 1_100_000, 2: 2}


def test_registered():
    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == list(queries.QUERIES) and len(queries.QUERIES) == 10


@pytest.mark.parametrize("name", list(base.QUERIES))
def test_base_columns_as_sql_has_them(spark, name):
    con = pytest.importorskip("duckdb").connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    got = base.QUERIES[name](spark, SMALL)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({base.ORACLE_SQL[name]})").fetchall()
    assert in_order(got) == sorted(want, key=lambda r: (r[0], str(r)))


def test_license_texts_are_found(spark):
    texts = [(k, "Intro.\n" + s.replace(" ", "\n   ", 3).capitalize() + ".", label) for k, (label, _, s) in enumerate(licenses._BODIES)]
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string, label string")).collect()}
    assert all(label in got[k] for k, _, label in texts)


def test_quality_fit_is_the_regularised_discriminant(spark, docs, labels):
    """Means, shrunk covariances, densities and logistic curve once more, from all rows at once."""
    rows = docs.collect()
    x = stats.features(stats.statistics(pa.array([r["text"] for r in rows])))
    held = [r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows]
    y = np.array([-1 if h or r["doc_id"] is None or r["doc_id"] >= 60 else r["doc_id"] % 2 for r, h in zip(rows, held)])
    own = [x[y == k] for k in (0, 1)]
    cov = [np.cov(o.T, bias=True) for o in own]
    pooled = sum(len(o) * c for o, c in zip(own, cov)) / sum(map(len, own))
    round_ = np.trace(pooled) / len(pooled) * np.eye(len(pooled))
    toward = lambda c: 0.95 * c + 0.05 * round_
    shrunk = [0.8 * toward(c) + 0.2 * toward(pooled) + 1e-9 * np.eye(len(pooled)) for c in cov]
    log = [-0.5 * (np.einsum("ij,jk,ik->i", x - o.mean(axis=0), np.linalg.inv(c), x - o.mean(axis=0)) + np.linalg.slogdet(c)[1]) for o, c in zip(own, shrunk)]
    e = log[1] - log[0] + math.log(len(own[1]) / len(own[0]))
    e = np.sign(e) * np.log1p(abs(e))
    binned = np.round(e[y >= 0] * 20) / 20
    slope, shift = quality.logistic(binned, y[y >= 0].astype(float), np.ones((y >= 0).sum()))
    want = sorted((str(r["doc_id"]), round(float(s), 6)) for r, s in zip(rows, 1 / (1 + np.exp(-(slope * e + shift)))))
    assert sorted((str(r["doc_id"]), round(r["score"], 6)) for r in quality.classify(docs, labels).collect()) == want
