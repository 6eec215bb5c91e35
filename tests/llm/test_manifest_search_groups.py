"""Merkle manifest, ranked search and group packing against brute force and round trips."""

from __future__ import annotations

import math
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shoplens.llm import group_packing, lexical, merkle, queries  # noqa: E402
from test_llm import documents, prose  # noqa: E402


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, line feeds, repeated rows and ids, ties."""
    rng = random.Random(5)
    out = [(i, prose(rng, rng.choice([1, 5, 40, 90, 300]), 60).replace(" w1", "\nW1")) for i in range(120)]
    out += [(200, None), (201, ""), (202, "\n"), (203, "ä日 本\n" * 900), (204, "!!! --- ..."), (None, "w1 w2\nw3"),
            (None, None), (5, "w1 w2"), (5, "w1 w2"), (6, out[7][1]), (300, prose(rng, 9000, 500)),
            (301, "W1 w1 wÄ wä w1"), (302, "<|endoftext|> it's  \n\n  2024 <|endoftext|>")]
    return out


# ------------------------------------------------------------------ Merkle manifest
def tree(level):
    levels = [level]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([merkle.sha("".join(last[i:i + 3])) for i in range(0, len(last), 3)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        s = i // 3 * 3
        out.append(("".join(level[s:i]), "".join(level[i + 1:s + 3])))
        i //= 3
    return out


def manifest_rows(data):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of (doc_id, source, lang, n, text)."""
    def leaf(values):
        return merkle.sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = defaultdict(list)
    for d, s, lang, n, t in data:
        groups[s].append((d is not None, d or 0, leaf((d, s, lang, n, t)), d, s, lang, n, t))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([r[2] for r in sorted(groups[s], key=lambda r: r[:3])]) for s in names]
    top = tree([t[-1][0] for t in trees])
    out = []
    for g, (name, levels) in enumerate(zip(names, trees)):
        for i, (_, _, h, d, s, lang, n, t) in enumerate(sorted(groups[name], key=lambda r: r[:3])):
            steps = path(levels, i) + path(top, g)
            at = h
            if d is not None and zlib.crc32(str(d).encode()) % 2 == 0 and t is not None:
                at = leaf((d, s, lang, n, t.replace("\n", "")))
            for a, b in steps:
                at = merkle.sha(a + at + b)
            out.append((d, h, levels[-1][0], top[-1][0], merkle.sha("".join(a + b for a, b in steps)), at,
                        at == top[-1][0]))
    return sorted(out, key=str)


COLS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def with_sources(spark, rows, source):
    data = [(d, source(i), None if i % 11 == 0 else "en", len(t or ""), t) for i, (d, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string")
    for c in ("key", "index", "n", "digest", "altered", "steps", "root", "_block", "level"):
        df = df.withColumn(c, F.lit("x"))
    return data, df


@pytest.mark.parametrize("source", [lambda i: None if i % 5 == 0 else ["", "a", "Z", "ä", "日"][i % 4],
                                    lambda i: "one", lambda i: f"s{i}" if i % 3 else "hot"])
def test_manifest_against_brute_force(spark, rows, source):
    data, df = with_sources(spark, rows, source)
    got = merkle.audit(df).select(*COLS).collect()
    assert sorted(map(tuple, got), key=str) == manifest_rows(data)
    assert any(r.verified for r in got) and not all(r.verified for r in got)


def test_manifest_of_many_blocks_and_log_positions(spark):
    """A source of three blocks, two rounds: the log is gapless, and children come before their parent."""
    few = [(i, f"t{i}\n") for i in range(2 * merkle.BLOCK + 700)]
    data, df = with_sources(spark, few, lambda i: "hot" if i < 2 * merkle.BLOCK + 1 else f"s{i % 7}")
    assert sorted(map(tuple, merkle.audit(df).select(*COLS).collect()), key=str) == manifest_rows(data)
    leaves = merkle.document_leaves(df)
    log = [r for part in merkle.append_log(leaves) for r in part.filter("key = '=hot'").collect()]
    assert sorted(r.position for r in log) == list(range(len(log)))
    done: dict = {}
    for r in sorted(log, key=lambda r: r.position):
        if r.level:  # children are complete before their parent
            children = [done[(r.level - 1, i)] for i in range(3 * r["index"], 3 * r["index"] + 3) if (r.level - 1, i) in done]
            assert r.digest == merkle.sha("".join(children))
        done[(r.level, r["index"])] = r.digest
    assert r.is_root


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 80, 82])
def test_position_in_closed_form(n):
    counts = [n]
    while counts[-1] > 1:
        counts.append(-(-counts[-1] // 3))
    order: list = []

    def walk(level, index):
        if level:
            for i in range(3 * index, min(3 * index + 3, counts[level - 1])):
                walk(level - 1, i)
        order.append((level, index))

    walk(len(counts) - 1, 0)
    assert merkle.height(n) == len(counts) - 1
    assert [merkle.position(lv, i, n, len(counts) - 1) for lv, i in order] == list(range(len(order)))


def test_proofs_of_some_leaves_only(spark, rows):
    _, df = with_sources(spark, rows, lambda i: "ab"[i % 2])
    leaves = merkle.document_leaves(df)
    tails, rounds, _ = merkle.manifest(leaves)
    some = merkle.paths(rounds, leaves.filter("doc_id in (3, 50)"), tails)
    whole = {r.digest: r.steps for r in merkle.paths(rounds, leaves, tails).collect()}
    got = some.collect()
    assert len(got) == 2 and all(whole[r.digest] == r.steps for r in got)
    assert merkle.audit(df.limit(0)).count() == 0


# ------------------------------------------------------------------ ranked search
def search_rows(docs, items, k=10):
    def terms(t):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower)

    bags = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for d, b in bags:
            m = 10 + (90 * sum(b.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if t in b)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, rank + 1, d, -s) for rank, (s, _, d) in enumerate(sorted(scores, key=str_safe)[:k])]
    return sorted(out, key=str)


def str_safe(score):
    return score[0], score[1], score[2] or 0


@pytest.fixture(scope="module")
def items(rows):
    rng = random.Random(8)
    out = [(i, prose(rng, rng.choice([1, 2, 6, 30]), 70)) for i in range(12)]
    return out + [(20, None), (21, ""), (22, "...\n"), (23, rows[3][1]), (23, "w1 w1 W1 wä"), (None, "w5 w6"),
                  (24, prose(rng, 400, 500)), (25, "nowhere"), (26, "日 ä日")]


@pytest.mark.parametrize("most_terms, grouped", [(lexical.MOST_TERMS, lexical.GROUPED), (25, 16)])
def test_search_against_brute_force(spark, rows, items, most_terms, grouped, monkeypatch):
    monkeypatch.setattr(lexical, "EVALUATED", 3)
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    clash = documents(spark, rows).withColumn("item_id", F.lit("x")).withColumn("n", F.lit("x"))
    got = lexical.search(clash, table, most_terms=most_terms).collect()
    assert sorted(map(tuple, got), key=str) == search_rows(rows, items)


def test_search_counts_long_texts_whole(spark):
    long = ("x " * 700_000) + "needle"
    docs = [(1, long), (2, "needle x y"), (3, "y")]
    table = spark.createDataFrame([(1, "needle")], "item_id long, text string")
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), table).collect()
    assert sorted(map(tuple, got), key=str) == search_rows(docs, [(1, "needle")])


def test_search_of_empty_tables(spark, rows, items):
    docs, table = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    assert lexical.search(docs.limit(0), table).count() == 0
    assert lexical.search(docs, table.limit(0)).count() == 0
    assert lexical.search(documents(spark, [(1, None)]), table).count() == 0


def test_masks_group_documents_with_the_same_terms():
    """Masks of over 64 terms, equal exactly where the sets of terms held are."""
    rng = np.random.default_rng(3)
    held = [np.flatnonzero(rng.random(150) < p) for p in (0.01, 0.02, 0.5) for _ in range(60)]
    held += held[:40]
    ends = np.append(0, np.cumsum([len(h) for h in held]))
    terms = np.concatenate(held)
    block = lexical.Block(np.arange(len(held)), np.full(len(held), 10), ends, terms, np.ones(len(terms), np.int64),
                          np.arange(150), len(held), 10 * len(held))
    rows = block.local(np.arange(150))
    group, masks, most = block.masks(rows)
    kinds = {tuple(h) for h in held}
    assert len(masks) == len(kinds)
    for d, h in enumerate(held):
        assert tuple(block.terms[rows][masks[group[d]]]) == tuple(h)
        assert block.score(rows, np.array([d]))[0] <= most[group[d]]


# ------------------------------------------------------------------ group packing
@pytest.fixture(scope="module")
def byte_path():
    return queries.tokenizer_path("byte_bpe_50k.json")


@pytest.mark.parametrize("limit, group_rows", [(1024, 4096), (64, 20)])
def test_group_packing_round_trip(spark, rows, byte_path, limit, group_rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(byte_path)
    clash = documents(spark, rows).withColumn("ids", F.lit("x")).withColumn("group", F.lit("x"))
    got = group_packing.pack(clash, byte_path, limit=limit, group_rows=group_rows).collect()
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])
    # each id in exactly one piece: pieces of a document are a partition of its ids (rows of one id taken together)
    by_doc = defaultdict(list)
    for r in got:
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
    for d, own in ids.items():
        for n, same in Counter(map(len, own)).items():
            pieces = by_doc.pop((d, n))
            covered = Counter(p for r in pieces for p in range(r.start, r.start + r.length))
            assert covered == {p: same for p in range(n)}
            valid = [x for x in own if len(x) == n]
            for r in pieces:
                assert r.ids_crc32 in {zlib.crc32(np.array(x[r.start:r.start + r.length], "<u4").tobytes())
                                       for x in valid}
    assert not by_doc
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == limit or at < limit and at & (at - 1) == 0  # no padding at all
    tokens = sum(len(x) for own in ids.values() for x in own)
    groups = -(-len(rows) // group_rows)
    assert len(sequences) <= tokens // limit + (limit.bit_length() + 1) * (groups + 1)


def test_first_fit_takes_the_first_sequence_with_room():
    rng = random.Random(4)
    for n in (1, 2, 3, 17, 400):
        sizes = [rng.randint(1, 100) for _ in range(n)]
        naive: list = []
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            for b in naive:
                if sum(sizes[j] for j in b) + sizes[i] <= 100:
                    b.append(i)
                    break
            else:
                naive.append([i])
        bins = group_packing.first_fit_decreasing(sizes, 100)
        assert bins == naive
        full = group_packing.fill_up(bins, sizes, 100)
        totals = sorted(sum(n for _, _, n in b) for b in full)
        assert all(t == 100 or t & (t - 1) == 0 for t in totals) and sum(totals) == sum(sizes)


def test_ranks_and_tokenizer_agree(byte_path):
    texts = ["", " ", "a  b\n\n c", "it's IT'S 'Ll", "ä" * 5000, "日本語 123456 !?#", " x y\u0000z", "😀👍🏽 " * 9,
             "<|endoftext|> x", "a" * 9000, " " * 9000, "\r\n\t " * 99, "é ١٢"]
    encoder = group_packing.ByteEncoder(byte_path)
    assert encoder.fast is not None
    for t in texts:
        assert encoder.encode(t).tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
    # a file that does not say the same as ranks goes to the tokenizer alone
    assert group_packing.ByteEncoder(queries.tokenizer_path()).fast is None


def test_group_packing_of_an_empty_table(spark, rows, byte_path):
    assert group_packing.pack(documents(spark, rows).limit(0), byte_path).count() == 0
    one = group_packing.pack(documents(spark, [(None, None)]), byte_path).collect()
    assert [(r.doc_id, r.start, r.length, r.doc_tokens, r.offset) for r in one] == [(None, 0, 1, 1, 0)]
