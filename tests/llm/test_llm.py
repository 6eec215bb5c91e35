"""The corpus operators against brute force, SQL, round trips and held-out accuracy."""

from __future__ import annotations

import os
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import brute  # noqa: E402
import oracle_harness as H  # noqa: E402

from shoplens.llm import (common, embedding, exact_dedup, licences, minhash, mixing, packing, queries,  # noqa: E402
                          sharding, substring, suffix, toxicity)

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def documents(spark, rows, sources=None):
    """[(doc_id, text)] with extra columns that clash with results and internal names."""
    from pyspark.sql import functions as F

    data = [(d, t, "en", (sources or {}).get(d, "s"), len(t or "")) for d, t in rows]
    df = spark.createDataFrame(data, DOCS)
    for c in ("kept", "keep_id", "norm", "rid", "id", "uid", "shard", "slot", "epoch", "start", "part", "key", "_salt",
              "label", "score", "words", "text_sha256", "n_words", "group_id", "_times", "_sha"):
        df = df.withColumn(c, F.lit("x"))
    return df


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Exact and near copies, shared passages, nulls, empty, long and repeated rows, ties."""
    rng = random.Random(3)
    passage = prose(rng, 70)
    rows = [(i, prose(rng, rng.choice([1, 4, 5, 40, 49, 50, 51, 120, 300]))) for i in range(1, 40)]
    rows += [(100 + i, rows[i][1]) for i in range(12)]  # exact copies
    rows += [(200 + i, rows[i][1].upper()) for i in range(4)]
    rows += [(300 + i, prose(rng, 20) + " " + passage + " " + prose(rng, 25 + i)) for i in range(8)]
    for i in (7, 8, 16, 25, 26):  # near copies
        words = rows[i][1].split()
        for k in range(0, len(words), 30):
            words[k] = "edited" + words[k]
        rows.append((400 + i, " ".join(words)))
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "ä" * 200), (504, "ä" * 260), (505, passage), (500, None)]
    rows += [(506, "aß 日本語 " * 40), (507, "日本語 " * 40), (508, prose(rng, 8000)), (None, passage), (None, "lone")]
    rows += [rows[3], (0, passage + " tail")]
    rows += [(600, "a b " * 300), (601, "b a " * 300), (602, "\x00" * 120), (603, "\x00" * 80 + "x")]
    return rows


EMPTY: list = []


def collect(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# ------------------------------------------------------------------ SQL
@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    r = H.compare(queries.queries()[name](spark, SF), queries.oracle_sql()[name], H.duck(SF))
    assert r["ok"], r


# ------------------------------------------------------------------ 1
def test_mixing_covers_all_and_obeys_weights(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 30)) for i in range(300)] + [(1000, None), (1001, ""), (None, "a b c")]
    src = {i: "big" if i < 240 else "mid" if i < 290 else None for i in range(300)} | {1000: "none"}
    mix = mixing.mixture(documents(spark, rows, src), target_entropy=0.99, max_repeats=3.0, block_tokens=500).toPandas()
    assert set(mix["doc_id"].dropna()) == {r[0] for r in rows if r[0] is not None} and mix["doc_id"].isna().sum() >= 1
    tokens = mix.groupby(mix["source"].fillna("?"))["n_tokens"].sum()
    epochs = {"big": tokens["big"] / 7200, "mid": tokens["mid"] / 1500}
    assert 1.0 <= epochs["big"] < 1.02 and epochs["mid"] <= 3.0 + 0.05
    assert mix["epoch"].max() <= 2
    for _, block in mix.groupby("mix_block"):
        assert sorted(block["mix_slot"]) == list(range(len(block)))
    assert not mix.duplicated(["doc_id", "epoch", "n_tokens"]).any()


def test_mixing_budget_and_empty(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 20)) for i in range(200)]
    src = {i: "a" if i < 150 else "b" for i in range(200)}
    mix = mixing.mixture(documents(spark, rows, src), 1.0, 99.0, budget=2000, block_tokens=300).toPandas()
    per = mix.groupby("source")["n_tokens"].sum()
    assert per["a"] == per["b"] == 1000  # entropy share 1: equal weights
    assert mixing.mixture(documents(spark, EMPTY)).count() == 0
    docs = documents(spark, rows, src)
    out = mixing.mixed_documents(docs, target_entropy=0.99, max_repeats=2.0)
    assert out.columns == docs.columns and {r.doc_id for r in out.select("doc_id").collect()} == set(range(200))


# ------------------------------------------------------------------ 2
def exact_groups(rows):
    low = {c: c + 32 for c in range(65, 91)}
    rows = set((d, (t or "").translate(low)) for d, t in rows)
    ids: dict = {}
    for d, t in rows:
        ids.setdefault(t, []).append(d)
    out = []
    for d, t in rows:
        known = [x for x in ids[t] if x is not None]
        keep = max(known) if known else None
        out.append((d, keep, len(ids[t]), d == keep, brute._sha(t.encode())))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 5])
def test_exact_dedup(spark, corpus, bits):
    """With five bits nearly all chunk identifiers clash, and verification must tell them apart."""
    got = collect(exact_dedup.exact_dedup(documents(spark, corpus), id_bits=bits), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == exact_groups(corpus)


def test_exact_dedup_keeps_one_row(spark, corpus):
    docs = documents(spark, corpus)
    out = exact_dedup.kept_documents(docs)
    assert out.columns == docs.columns
    assert collect(out, "doc_id") == sorted([(r[0],) for r in exact_groups(corpus) if r[3]], key=str)
    assert exact_dedup.exact_dedup(documents(spark, EMPTY)).count() == 0


# ------------------------------------------------------------------ 3
@pytest.mark.parametrize("n_shards", [24, 5])
def test_shards(spark, corpus, n_shards):
    rows = corpus + [(2000 + i, "hot text") for i in range(60)] + [(3000 + i, f"pair {i // 2}") for i in range(40)]
    got = sharding.shards(documents(spark, rows), n_shards).toPandas()
    assert len(got) == len(rows)
    sizes = got.groupby("shard").size().reindex(range(n_shards), fill_value=0)
    assert sizes.max() - sizes.min() <= 1
    for _, s in got.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    want = sorted((d is None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    have = sorted((bool(np.isnan(d)) if isinstance(d, float) else d is None, 0 if d is None or d != d else int(d), int(s), int(c))
                  for d, s, c in zip(got["doc_id"].astype(object), got["size"], got["text_crc32"]))
    assert have == want
    # equal texts stay together unless a quota forbids it: the hot one needs 60 / quota shards, the others one
    quota = len(rows) // n_shards
    by_text = got.groupby("text_crc32")["shard"].nunique()
    counts = got.groupby("text_crc32").size()
    split = sum(by_text[c] > 1 for c in counts.index if counts[c] <= max(2, quota // 3))
    assert split <= 0.2 * (counts > 1).sum()
    assert by_text[zlib.crc32(b"hot text")] <= -(-60 // quota) + 3


@pytest.mark.parametrize("copies", [2, 5])
def test_shards_where_every_text_has_copies(spark, copies):
    """10,000 groups of equal rows: under 1 % are split, and counts are one apart at most."""
    rows = [(i, f"text {i // copies}") for i in range(10_000 * copies)]
    got = sharding.shards(documents(spark, rows)).toPandas()
    sizes = got.groupby("shard").size()
    assert len(sizes) == 24 and sizes.max() - sizes.min() <= 1
    assert got.groupby("shard")["slot"].agg(lambda s: sorted(s) == list(range(len(s)))).all()
    assert (got.groupby("text_crc32")["shard"].nunique() > 1).sum() < 100


def test_shards_cut_a_large_text_into_as_few_shards_as_it_needs(spark):
    """A third of all rows have one text, the others come in threes."""
    rows = [(i, "hot") for i in range(3000)] + [(10_000 + i, f"t {i // 3}") for i in range(6000)]
    got = sharding.shards(documents(spark, rows)).toPandas()
    assert got.groupby("shard").size().eq(375).all()
    by_text = got.groupby("text_crc32")["shard"].nunique()
    assert by_text[zlib.crc32(b"hot")] <= 8 + 4
    assert (by_text > 1).sum() - 1 <= 60


def test_shard_quotas_swap_and_fill():
    rng = random.Random(31)
    for _ in range(200):
        asked = {(s, t): rng.randrange(1, 50) for s in range(5) for t in range(5) if s != t and rng.random() < 0.6}
        free = {t: rng.randrange(-20, 40) for t in range(5)}
        got = sharding._quotas(asked, free)
        for t in range(5):
            net = sum(n for (_, to), n in got.items() if to == t) - sum(n for (s, _), n in got.items() if s == t)
            assert net <= max(0, free[t])
        assert all(min(n, asked.get((t, s), 0)) <= got[s, t] <= n for (s, t), n in asked.items())


def test_shards_small(spark):
    assert sharding.shards(documents(spark, EMPTY)).count() == 0
    got = sharding.shards(documents(spark, [(1, "a"), (2, None), (2, None)])).toPandas()
    assert len(got) == 3 and got.groupby("shard").size().max() == 1 and set(got["slot"]) == {0}
    got = sharding.shards(documents(spark, [(i, "same") for i in range(50)])).toPandas()
    assert sorted(got.groupby("shard").size()) == [2] * 22 + [3] * 2


# ------------------------------------------------------------------ 4
def test_toxicity_held_out(spark):
    rng = random.Random(5)
    bad = ["grubbish", "snorfle", "blatherskite", "quibblor"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice("ka lo mi tere suno bari vel tora ne".split()) + rng.choice(["", "ka", "mi", "ton"]) + str(rng.randrange(10))
                 for _ in range(80)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(80)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs = documents(spark, rows + [(5000, None), (5001, ""), (None, "ka lo"), (5002, "snorfle " * 3000)])
    lab = spark.createDataFrame(labels + [(None, 1, 1), (7777, 1, None)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, toxicity.train(docs, lab)).toPandas()
    assert len(out) == 904 and out["score"].between(0, 1).all() and ((out["score"] >= 0.5) == (out["predicted"] == 1)).all()
    held = out[out["held_out"] & (out["doc_id"] < 900)]
    assert set(held["doc_id"]) == {i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert ((held["doc_id"] % 4 == 0) == (held["predicted"] == 1)).mean() > 0.97
    clean = toxicity.clean_documents(docs, toxicity.train(docs, lab))
    assert clean.columns == docs.columns and clean.count() == (out["predicted"] == 0).sum()


def test_toxicity_of_long_texts(spark):
    """The toxic part of every text comes after more than 20,000 characters of ordinary words."""
    rng = random.Random(8)
    usual = [a + b + str(i) for a in "ka lo mi tere suno bari".split() for b in ("", "ka", "ton") for i in range(10)]
    bad = ["grubbish", "snorfle", "blatherskite", "quibblor", "wazzock", "numpty"]
    rows, labels = [], []
    for i in range(240):
        words = rng.choices(usual, k=4500)
        if i % 3 == 0:
            words += [w for _ in range(60) for w in (rng.choice(usual), rng.choice(bad))]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 3 == 0)))
    assert all(len(" ".join(t.split()[:4500])) > 20_000 for _, t in rows)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    model = toxicity.train(docs, lab)
    out = toxicity.toxicity(docs, model).toPandas()
    held = out[out["held_out"]]
    assert ((held["doc_id"] % 3 == 0) == (held["predicted"] == 1)).mean() > 0.95
    # every window counts: five hundred toxic words give other features than five at the same length
    cells = toxicity.Windows(model.toxic, model.ordinary).of
    few, many = (model.features(cells(" ".join(["snorfle"] * k + [usual[0]] * (5000 - k)))) for k in (5, 500))
    assert (many[:5] > few[:5]).all()


def test_toxicity_without_labels(spark):
    docs = documents(spark, [(1, "a"), (2, None)])
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, toxicity.train(docs, lab)).toPandas()
    assert (out["score"] < 0.01).all()
    assert toxicity.toxicity(documents(spark, EMPTY), toxicity.train(docs, lab)).count() == 0


# ------------------------------------------------------------------ 5
def vector_rows():
    rng = np.random.default_rng(8)
    rows = []
    for i in range(150):
        v = rng.standard_normal(64)
        rows.append((i, v.tolist(), int(rng.integers(3))))
    for i in range(60):  # near copies, also of copies
        d, v, label = rows[int(rng.integers(len(rows)))]
        w = np.array(v) + rng.standard_normal(64) * rng.choice([0.05, 0.2, 0.3])
        rows.append((200 + i, w.tolist(), label))
    rows += [(300 + i, rows[5][1], rows[5][2]) for i in range(20)]  # equal vectors
    rows += [(400, (np.array(rows[5][1]) * 1e200).tolist(), rows[5][2]), (401, rows[5][1], None), (402, None, 1), (403, [], 1),
             (404, [0.0] * 64, 1), (405, [float("nan")] * 64, 1), (406, [float("inf")] + [1.0] * 63, 1),
             (407, [None] + [1.0] * 63, 1), (408, rows[5][1][:32], rows[5][2]), (None, rows[5][1], rows[5][2]),
             (5, rows[5][1], rows[5][2])]
    return rows


def vectors_frame(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for c in ("rep", "uid", "v", "copies", "kept", "filter"):
        df = df.withColumn(c, F.lit(1))
    return df


@pytest.mark.parametrize("block", [1500, 6])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embedding, "BLOCK", block)
    rows = vector_rows()
    got = collect(embedding.near_duplicates(vectors_frame(spark, rows)), "vec_id", "n_links", "component_id", "kept")
    assert got == sorted(brute.vectors(rows), key=str)


@pytest.mark.parametrize("codewords", [16, 23, 32, 64])
def test_caps_find_pairs_at_every_code_size(codewords):
    """Random pairs just above the threshold share a filter, however fine the code."""
    rng = np.random.default_rng(codewords)
    for dim in (32, 64):
        caps = embedding.Caps(dim, codewords)
        a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.standard_normal((2, 400, dim)))
        b -= (a * b).sum(1, keepdims=True) * a
        b = 0.9301 * a + np.sqrt(1 - 0.9301 ** 2) * b / np.linalg.norm(b, axis=1, keepdims=True)
        assert np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(caps.passed(a), caps.passed(b))]) >= 0.99


def test_block_counts_a_link_in_its_smallest_filter_only(monkeypatch):
    """In chunks of few filters as in one go: a pair counts where no smaller filter is common."""
    monkeypatch.setattr(embedding, "NAMES", 5)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((3, 16))
    unit = embedding._unit(centre[rng.integers(0, 3, 40)] + 0.1 * rng.standard_normal((40, 16)))
    filters = [np.unique(np.append(rng.integers(0, 300, 12), 200)) for _ in range(40)]
    links, _ = embedding._block_links(unit, filters, np.ones(40), np.zeros(40, int), 200, 0.93)
    want = [sum(i != j and unit[i] @ unit[j] >= 0.93 and min(set(filters[i]) & set(filters[j])) == 200 for j in range(40))
            for i in range(40)]
    assert links.tolist() == want and 0 < sum(want)


def test_embeddings_empty(spark):
    assert embedding.near_duplicates(vectors_frame(spark, [])).count() == 0
    got = embedding.near_duplicates(vectors_frame(spark, [(1, None, 1), (2, [1.0, 2.0], 0)]))
    assert collect(got, "vec_id", "n_links", "component_id") == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_embeddings_recall(spark):
    df = common.table(spark, SF, "embeddings")
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in df.collect()]
    want = {r[0]: r[1] for r in brute.vectors(rows)}
    got = {r.vec_id: r.n_links for r in queries.queries()["op5_spherical_cap_filters"](spark, SF).collect()}
    assert all(got[k] <= want[k] for k in want) and sum(got.values()) >= 0.99 * sum(want.values())


# ------------------------------------------------------------------ 6, 7
def test_suffix_order():
    rng = random.Random(4)
    for k in (1, 2, 3, 200):
        for _ in range(40):
            s = bytes(rng.randrange(k) for _ in range(rng.randrange(1, 150)))
            order, _ = suffix.two_stage_sort(np.frombuffer(s, np.uint8))
            assert sorted(order) == list(range(len(s)))
            assert [s[i:i + 50] for i in order] == [s[i:i + 50] for i in sorted(range(len(s)), key=lambda i: s[i:])]


@pytest.mark.parametrize("chunk", [1_000_000, 100])
def test_suffix_repeats(spark, corpus, monkeypatch, chunk):
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    got = collect(suffix.remove_repeats(documents(spark, corpus)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.remove_bytes(corpus), key=str)


@pytest.mark.parametrize("bits", [5, 8])
def test_suffix_buckets_are_even(bits):
    text = np.random.default_rng(6).integers(97, 123, 2_000_000).astype(np.uint8)
    keys = suffix._seed_of_windows(text, suffix.LENGTH, bits)
    for found in (np.unique(keys), keys):  # distinct seeds, windows
        load = np.bincount((found >> np.uint64(suffix._rest_bits(bits))).astype(np.int64), minlength=1 << bits)
        assert len(load) == 1 << bits and load.max() < 1.3 * load.mean()


def test_substring_repeats(spark, corpus):
    got = collect(substring.remove_repeats(documents(spark, corpus)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.remove_words(corpus), key=str)


def test_repeats_empty(spark):
    for module in (suffix, substring):
        assert module.remove_repeats(documents(spark, EMPTY)).count() == 0
        got = module.remove_repeats(documents(spark, [(1, None), (2, ""), (None, None), (1, None)])).toPandas()
        assert len(got) == 4 and (got["n_removed"] == 0).all() and (got["kept_sha256"] == brute._sha(b"")).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", ["op6_two_stage_suffix_sort", "op7_seed_and_extend"])
def test_repeats_on_tables(spark, name):
    docs = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect()]
    got = queries.queries()[name](spark, SF)
    want = brute.remove_bytes(docs) if name.startswith("op6") else brute.remove_words(docs)
    assert collect(got, *got.columns) == sorted(want, key=str)


# ------------------------------------------------------------------ 8
def check_packing(spark, rows, packed, path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    want: Counter = Counter()
    total = 0
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for k in range(0, len(ids), 4096):
            piece = ids[k:k + 4096]
            want[(d, k // 4096, k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()))] += 1
    got = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places: dict = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096
    return len(places), -(-total // 4096)


def test_packing(spark, corpus):
    path = queries.tokenizer_path()
    rows = corpus + [(700, "it's DON'T <|endoftext|> 'S"), (701, "İstanbul Σίσυφος ǅ ﬁ"), (702, "x\x1cy z w"),
                     (703, "é é ²³ ½ 12ab3"), (704, "word " * 20_000)]
    used, least = check_packing(spark, rows, packing.pack(documents(spark, rows), path), path)
    assert used <= least + 1
    assert packing.pack(documents(spark, EMPTY), path).count() == 0


def test_bin_completion():
    rng = random.Random(6)
    for _ in range(60):
        limit = rng.choice([10, 30, 100])
        hist = Counter(rng.randint(1, limit) for _ in range(rng.randint(1, 200)))
        rows = packing.plan_bins(dict(hist), limit)
        fill: Counter = Counter()
        used: Counter = Counter()
        for length, _, per, bins, first, _ in rows:
            used[length] += per * bins
            for b in range(first, first + bins):
                fill[b] += per * length
        assert used == hist and max(fill.values()) <= limit
        assert sorted(fill) == list(range(len(fill)))


def fewest_bins(pieces, limit):
    """The optimum, over all subsets: (sequences, tokens in the last one)."""
    best = [(len(pieces) + 1, 0)] * (1 << len(pieces))
    best[0] = (0, limit)
    for some in range(1, 1 << len(pieces)):
        for i, x in enumerate(pieces):
            if some >> i & 1:
                bins, last = best[some ^ (1 << i)]
                best[some] = min(best[some], (bins, last + x) if last + x <= limit else (bins + 1, x))
    return best[-1][0]


def test_bin_completion_is_optimal_on_small_sets():
    rng = random.Random(3)
    sets = [([20, 24, 26, 29, 38, 40, 42, 50, 51, 52, 52, 60], 100)]
    for j in range(120):
        limit = rng.choice([30, 64, 100])
        sets.append(([rng.randint(1 if j % 2 else limit // 5, limit * 2 // 3) for _ in range(rng.randint(1, 11))], limit))
    for pieces, limit in sets:
        filled = packing.fill_bins(dict(Counter(pieces)), limit)
        assert Counter(x for f, n in filled for x in f * n) == Counter(pieces)
        assert max(sum(f) for f, _ in filled) <= limit
        least = fewest_bins(pieces, limit)
        assert sum(n for _, n in filled) == least >= packing.least_bins(dict(Counter(pieces)), limit)
    assert packing.fill_bins({}, 10) == [] and packing.fill_bins({10: 3}, 10) == [((10,), 3)]


def test_word_encoder_is_the_tokenizer():
    rng = random.Random(9)
    path = queries.tokenizer_path()
    fast, plain = packing.Encoder(path, most_words=2000), packing.Encoder(path)
    assert fast.ranks is not None
    plain.ranks = None
    letters = "abcdefghijklmnopqrstuvwxyzaaaeeeiii\u00e9\u00fc\u00f1\u00dfQZ09.,-'!"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(60)) for _ in range(120)]
    texts += ["", " \n ", "'s 'S it's a'lls ''re", "..,, 12,5 !?! a_b", "\x00 a \x00b", "<|endoftext|> x"]
    want = [np.array(fast.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for encoder in (fast, plain):
        assert [x for i in range(0, len(texts), 16) for x in encoder.encode(texts[i:i + 16])] == want
    # a table in which a token's own merges do not lead to it is refused
    first = {bytes([b, 0]): b for b in range(256)}
    assert packing._own_merges_lead_to([(b"a", b"b"), (b"ab", b"c"), (b"c", b"c\0")], first)
    assert not packing._own_merges_lead_to([(b"a", b"b"), (b"b", b"c"), (b"a", b"bc")], first)


# ------------------------------------------------------------------ 9
def test_licences(spark):
    s = licences.SENTENCES
    bsd = s["bsd_permit"].capitalize() + ":\n1. Keep.\n2. Also keep.\n" + s["bsd_asis"] + "."
    rows = [(1, "Some text.\nReleased under the MIT License.\nmore"), (2, "LICENSED  under the Apache-License, version 2.0."),
            (3, bsd), (4, s["bsd_asis"] + ". " + s["bsd_permit"] + "."), (5, None), (6, ""), (None, "licensed under CC BY-NC 4.0."),
            (7, f"{s['mit_grant']}. {s['mit_keep']}. x. y. {s['asis']}."), (8, f"{s['mit_grant']}. {'x. ' * 12}{s['mit_keep']}. {s['asis']}"),
            (1, "Some text.\nReleased under the MIT License.\nmore"), (9, "not licensed under the mit license agreement")]
    got = {r.doc_id: (r.licences, r.n_known) for r in licences.scan(documents(spark, rows)).collect()}
    assert got == {1: ("MIT", 1), 2: ("Apache-2.0", 1), 3: ("BSD", 2), 4: ("", 2), 5: ("", 0), 6: ("", 0), None: ("CC-BY-NC-4.0", 1),
                   7: ("MIT", 3), 8: ("", 3), 9: ("", 0)}
    assert licences.scan(documents(spark, EMPTY)).count() == 0


VERBATIM = [
    ("MIT", """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated \
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the \
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit \
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the \
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE \
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR \
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.""", 3),
    ("BSD", """Redistribution and use in source and binary forms, with or without modification, are permitted provided \
that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following \
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following \
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, \
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE \
DISCLAIMED.""", 2),
    ("GPL-2.0-or-later", """This program is free software; you can redistribute it and/or modify it under the terms of \
the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at \
your option) any later version.""", 2),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of \
the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at \
your option) any later version.""", 2),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the \
MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", 1),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in \
compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0""", 3),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", 1),
    ("CC0-1.0", """To the extent possible under law, the person who associated CC0 with this work has waived all copyright \
and related or neighboring rights to this work.""", 1),
]


MORE_LICENCES = {
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the
GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at
your option) any later version.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
your option) any later version.""",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)",
}


def known_by_search(text, known):
    """All spans between stops compared with all known sentences, in a text of words, stops and spaces only."""
    parts = [x for x in (" ".join(x.split()) for x in text.split(".")) if x]
    names, found, i, n = {k: name for name, k in known.items()}, [], 0, 0
    while i < len(parts):
        spans = [j for j in range(i + 1, len(parts) + 1) if " ".join(parts[i:j]) in names]
        if spans:
            found.append((n, names[" ".join(parts[i:spans[-1]])]))
        i, n = spans[-1] if spans else i + 1, n + 1
    return n, found


def test_licence_rules_against_brute_force():
    split = licences.finder(licences.SPLIT, licences.SOFT, licences.SENTENCES)
    for name, text in MORE_LICENCES.items():
        places: dict = {}
        for at, sentence in split(text)[1]:
            places.setdefault(sentence, []).append(at)
        assert {n for n, rule in licences.RULES if licences.follows(places, rule)} == {name}
    rng = random.Random(4)
    known = {"a": "one two", "b": "two three four", "c": "one two three"}
    find = licences.finder(licences.SPLIT, licences.SOFT, known)
    for _ in range(300):
        text = "".join(rng.choice(["one ", "two ", "three ", "four ", ". "]) for _ in range(rng.randint(0, 40)))
        assert find(text) == known_by_search(text, known)
    for _ in range(300):
        places = {x: sorted(rng.sample(range(60), rng.randint(0, 8))) for x in "abc"}
        rule = [rng.choice("abc") for _ in range(rng.randint(1, 3))]
        ends = places[rule[0]]
        for x in rule[1:]:
            ends = [p for p in places[x] if any(0 < p - e <= licences.GAP + 1 for e in ends)]
        assert licences.follows(places, rule) == bool(ends)


def test_licences_in_a_long_text_of_repeated_notices():
    import time

    s = licences.SENTENCES
    text = f"{s['mit_grant_2']}. {s['mit_keep']}. " * 12_000  # 8 MB, no rule is complete
    at = time.process_time()
    n, found = licences.finder(licences.SPLIT, licences.SOFT, s)(text)
    places: dict = {}
    for k, name in found:
        places.setdefault(name, []).append(k)
    assert n == len(found) == 24_000
    assert not any(licences.follows(places, rule) for _, rule in licences.RULES)
    assert time.process_time() - at < 10


def test_licences_verbatim_and_wrapped(spark):
    import textwrap

    rows, want = [], {}
    for i, (name, text, known) in enumerate(VERBATIM):
        def wrapped(width, prefix="", text=text):
            return "\n\n".join(textwrap.fill(x, width) for x in text.split("\n\n")).replace("\n", "\n" + prefix)

        for k, shape in enumerate([text, wrapped(72), wrapped(40, " * "), wrapped(60, "# ").replace("\n", "\r\n")]):
            rows.append((10 * i + k, shape))
            want[10 * i + k] = (name, known)
    got = {r.doc_id: r for r in licences.scan(documents(spark, rows)).collect()}
    assert {k: (r.licences, r.n_known) for k, r in got.items()} == want
    for i in range(len(VERBATIM)):  # wrapping changes no sentence count
        assert len({got[10 * i + k].n_sentences for k in range(4)}) == 1
    rows = [(1, "this is not licensed under the\nmit license agreement"), (2, "See\nlicensed under the\nMIT license\nfor more")]
    assert {r.doc_id: r.licences for r in licences.scan(documents(spark, rows)).collect()} == {1: "", 2: "MIT"}


# ------------------------------------------------------------------ 10
def test_alignment():
    rng = random.Random(9)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(0, 25))]
        b = [x for x in a if rng.random() > 0.1] + [rng.randrange(6) for _ in range(rng.randrange(3))]
        share = brute.aligned_share(a, b)
        got = minhash.alignment(a, b, 0.8)
        assert got == (pytest.approx(share) if share >= 0.8 - 1e-9 else 0.0)


@pytest.mark.parametrize("block", [1000, 5])
def test_near_duplicates(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = [r for r in corpus if r[0] is not None]
    got = minhash.near_duplicates(documents(spark, corpus))
    assert {r.doc_id for r in got.collect()} == {r[0] for r in corpus}
    want = brute.near_groups(rows)
    assert {r.doc_id: r.group_id for r in got.collect() if r.doc_id is not None} == want
    docs = documents(spark, corpus)
    kept = minhash.kept_documents(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, g in want.items() if d == g} | {None}


def test_links_within_a_block_lose_none():
    """Components by the block's links are those of all pairs; no pair that aligns is filtered out."""
    rng = random.Random(21)
    base = [[rng.randrange(40) for _ in range(n)] for n in (3, 12, 30, 200, 900)]
    texts = [[w if rng.random() > 0.08 else rng.randrange(400) for w in rng.choice(base)] for _ in range(70)]
    sequences = [minhash._mix(np.array(t, np.uint64)) for t in texts]
    block = minhash.Block(sequences)
    for i in range(len(texts)):
        near = {int(block.order[j]) for j in block.could_link(i, 0.8)}
        for j in block.order[i + 1:]:
            if minhash.alignment(texts[block.order[i]], texts[j], 0.8):
                assert int(j) in near
    labels = [rng.randrange(60) for _ in texts]
    links = minhash.links_within(sequences, labels, lambda i, others: np.ones(len(others), bool), 0.8)

    def components(pairs):
        root = list(range(len(texts)))
        for _ in texts:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    same = [(a, b) for a in range(len(texts)) for b in range(a) if labels[a] == labels[b]]
    every = [(a, b) for a in range(len(texts)) for b in range(a) if minhash.alignment(texts[a], texts[b], 0.8)]
    assert components(links + same) == components(every + same) and len(links) < len(texts)


def test_near_duplicates_of_repeated_rows_and_of_one_id_on_many_texts(spark):
    """Thousands of equal rows are one; an id on two texts joins their groups."""
    rng = random.Random(22)
    one, other = prose(rng, 60), prose(rng, 60)
    near = " ".join(["new", *one.split()[1:]])
    rows = [(7, one)] * 3000 + [(8, near), (9, other), (10, near), (10, other), (11, prose(rng, 30))]
    got = {r.doc_id: r.group_id for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == {7: 7, 8: 7, 9: 7, 10: 7, 11: 11}


def test_near_duplicates_of_long_texts(spark):
    rng = random.Random(23)
    words = prose(rng, 40_000, 30_000).split()
    edited = [w if i % 40 else "edited" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[:20_000])), (4, " ".join(words[::-1]))]
    got = {r.doc_id: r.group_id for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_near_duplicates_empty(spark):
    assert minhash.near_duplicates(documents(spark, EMPTY)).count() == 0
    got = minhash.near_duplicates(documents(spark, [(1, None), (2, ""), (3, "a"), (4, "A")]))
    assert collect(got, "doc_id", "group_id") == [(1, 1), (2, 1), (3, 3), (4, 3)]


def test_components(spark):
    rng = random.Random(11)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.id: r.component_id for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for l in links if l[0] != l[1] for x in l}
    for _ in root:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


# ------------------------------------------------------------------ pipeline
@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_pipeline(spark):
    import corpus_pipeline as P

    docs = common.table(spark, SF, "documents")
    names, texts = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = common.saved(stage(spark, docs, SF), "test")
        assert docs.columns == names
        after = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "exact dedup":
            assert sorted(d for d, _ in after) == sorted(r[0] for r in exact_groups(before) if r[3])
        if name == "MinHash near-dedup":
            assert sorted(d for d, _ in after) == sorted(d for d, g in brute.near_groups(before).items() if d == g)
        if name == "mixing":
            assert {d for d, _ in after} == {d for d, _ in before}
        texts = after
    packed = P.STAGES[-1][1](spark, docs, SF)
    used, least = check_packing(spark, texts, packed, queries.tokenizer_path())
    assert used <= least + 1
    assert P.run(spark, SF).count() == packed.count()
