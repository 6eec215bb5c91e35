"""Repeated passages of words by seed and extend.

Seeds: of every window of ``window`` words, the least hash among its runs of
``seed`` words (winnowing).  Equal windows have equal seeds, wherever they
stand, so documents are joined on their seeds.  Extension: each seed that two
documents share is extended both ways to every window that it is the seed of;
windows are told apart by a fingerprint under their seed, and the smallest
document of each window is an aggregation.  Overlapping matched windows merge
into maximal repeats, whose words go from every document but the first.

Of equal word sequences only the first document is searched.  Seeds and windows
are grouped with map-side sums, so a passage that a third of
all documents share makes no large group; results return to the windows per
(window, salt).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, saved, with_group_totals

WINDOW, SEED = 50, 10
#: Stands for a null id: larger than every id.
LAST = (1 << 63) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def runs(units: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` units, composed by doubling."""
    n = len(units) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, piece, size, factor = None, 0, units, 1, 0xD1342543DE82EF95
    while True:
        if width & size:
            if out is None:
                out, done = piece, size
            else:
                m = len(piece) - done
                out = out[:m] * np.uint64(factor) + piece[done:]
                done += size
        if size * 2 > width:
            return _mix(out[:n])
        m = len(piece) - size
        piece = piece[:m] * np.uint64(factor) + piece[size:]
        factor = factor * factor & (1 << 64) - 1
        size *= 2


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    size, least = 1, values
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[:len(least) - (width - size)], least[width - size:]) if width > size else least


class Words:
    """The words of a text and their 64-bit hashes."""

    def __init__(self):
        import re

        import xxhash

        self.find, self.hash, self.known = re.compile(WORD).findall, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str) -> tuple[list[str], np.ndarray]:
        words, known = self.find(text), self.known
        if len(known) > 500_000:
            known.clear()
        for w in [w for w in set(words) if w not in known]:
            known[w] = self.hash(w.encode("utf-8", "surrogatepass"))
        return words, _mix(np.array([known[w] for w in words], np.uint64))


def _digest(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest()


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (hex, of
    the kept words joined by one space).

    A word goes if a window of ``window`` words that covers it also starts in a
    document with a smaller id; windows are those of the input.  Null and empty
    texts have no words.  A null id counts as larger than all others, and equal
    ids never take words from each other; rows repeated with one id and text
    give a row each.  An empty table gives an empty result; other columns are
    ignored."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    src = src.withColumn("rid", F.xxhash64("doc_id", "text"))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words_of = Words()
        for frame in frames:
            rows = []
            for text in frame["text"]:
                words, units = words_of(text)
                seeds = np.unique(window_minima(runs(units, seed), window - seed + 1)) if len(words) >= window else []
                rows.append((len(words), _digest(words), np.array(seeds, np.uint64).view(np.int64)))
            out = pd.DataFrame(rows, columns=["n_words", "kept_sha256", "seeds"])
            out["doc_id"], out["rid"] = frame["doc_id"].astype("Int64").to_numpy(), frame["rid"].to_numpy()
            yield out

    scanned = saved(src.mapInPandas(
        scan, "doc_id long, rid long, n_words long, kept_sha256 string, seeds array<long>"), "seeds")
    # equal word sequences: all but the smallest document lose every window, and need no search
    classes = with_group_totals(
        scanned.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "rid", "kept_sha256"), ["kept_sha256"], ["rid"],
        [F.min("id").alias("_m")], [F.min("_m").alias("first")])
    copies = saved(classes.filter("id > first").select("rid").distinct(), "copies")
    seeds = scanned.join(copies, "rid", "left_anti").select(F.explode("seeds").alias("seed"), "rid")
    shared = (seeds.groupBy("seed").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"))
              .filter("lo <> hi").select("seed"))
    wanted = seeds.join(shared, "seed").groupBy("rid").agg(F.collect_set("seed").alias("seeds"))
    # texts move once: those with a shared seed are kept for the extension and for the result
    part = saved(src.join(wanted, "rid"), "passages")

    def extend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words_of = Words()
        for frame in frames:
            for at in range(0, len(frame), 500):
                some, out = frame.iloc[at:at + 500], []
                for i, (rid, text, wanted_here) in enumerate(zip(some["rid"], some["text"], some["seeds"])):
                    _, units = words_of(text)
                    least = window_minima(runs(units, seed), window - seed + 1)
                    at_ = np.flatnonzero(np.isin(least, np.array(wanted_here, np.int64).view(np.uint64)))
                    if len(at_):
                        out.append((np.full(len(at_), rid), np.full(len(at_), i), at_, least[at_].view(np.int64),
                                    runs(units, window)[at_].view(np.int64)))
                if out:
                    rids, i, starts, s, print_ = (np.concatenate(x) for x in zip(*out))
                    ids = some["doc_id"].astype("Int64").fillna(LAST).astype("int64").to_numpy()
                    yield pd.DataFrame({"rid": rids, "id": ids[i], "start": starts, "seed": s, "print": print_})

    windows = part.mapInPandas(extend, "rid long, id long, start int, seed long, print long")
    matched = with_group_totals(
        windows, ["seed", "print"], ["rid"], [F.min("id").alias("_lo"), F.max("id").alias("_hi")],
        [F.min("_lo").alias("first"), F.max("_hi").alias("last")], salts=16, having=F.col("first") < F.col("last"))
    gone = matched.filter("id > first").groupBy("rid").agg(F.collect_set("start").alias("starts"))
    # each text once, however often its row repeats
    changed = saved(gone.join(part.select("rid", "text").dropDuplicates(["rid"]), "rid"), "changed")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words_of = Words()
        for frame in frames:
            rows = []
            for rid, text, starts in zip(frame["rid"], frame["text"], frame["starts"]):
                words, _ = words_of(text)
                edge = np.zeros(len(words) + 1, np.int32)
                starts = np.asarray(starts, np.int64)
                edge[starts] += 1
                edge[starts + window] -= 1
                keep = np.cumsum(edge)[:-1] == 0
                rows.append((rid, int((~keep).sum()), _digest([w for w, k in zip(words, keep) if k])))
            yield pd.DataFrame(rows, columns=["rid", "n_removed", "sha"])

    result = changed.mapInPandas(cut, "rid long, n_removed long, sha string")
    flagged = scanned.join(result, "rid", "left").join(copies.withColumn("copy", F.lit(True)), "rid", "left")
    copy = F.col("copy").isNotNull() & (F.col("n_words") >= window)
    return flagged.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(_digest([]))).otherwise(F.coalesce("sha", "kept_sha256")).alias("kept_sha256"))
