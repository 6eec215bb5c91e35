"""Toxicity by compression distance to two zstandard dictionaries.

From a bounded sample of labelled documents (whole texts), one dictionary is
trained on toxic and one on ordinary text.  Every word of a document is a
window; it is compressed with either dictionary, and the pair of lengths is its
*cell*.  Thresholds are calibrated on other labelled documents: each cell gets
the log ratio of its frequency in toxic and in ordinary text, cells that do not
speak clearly for toxic text count nothing, and a logistic curve turns a
document's features into a score: all its windows count, by their rate, against
chance at its length, and in its worst passage.  Whole texts are scored, window
by window, in the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: At most so many labelled documents of each class are learnt from.
TOXIC_SAMPLE, ORDINARY_SAMPLE = 2500, 7500
TOXIC_WORDS, ORDINARY_WORDS = 600, 2500
CELLS = 16
#: Windows of a passage; the worst passage of a text is a feature.
PASSAGE = 128
#: Follows each window, and ends either dictionary: the last bytes of an input are never matched.
PAD = b"\n0123456789abcdefghijklmnopqrstuvwxyz0123456789\n"
#: Words as they stand whose cells a task remembers.
KNOWN_WORDS = 100_000
_EDGES = ".,;:!?\"'()[]{}<>«»“”„-_*#|/\\"


def _words(text: str) -> list[str]:
    return [w for w in (x.strip(_EDGES) for x in text.lower().split()) if w]


def _compressor(words: list[str]):
    import zstandard as zs

    params = zs.ZstdCompressionParameters(
        strategy=zs.STRATEGY_BTOPT, min_match=3, window_log=15, hash_log=12, chain_log=13, search_log=5,
        target_length=32, write_content_size=False, write_checksum=False, write_dict_id=False,
        format=zs.FORMAT_ZSTD1_MAGICLESS)
    content = (" " + " ".join(reversed(words)) + " ").encode("utf-8", "replace") + PAD  # the best words come last
    dictionary = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=params)
    return zs.ZstdCompressor(dict_data=dictionary, compression_params=params)


class Windows:
    """The cells of a text's windows: compressed length with the toxic
    dictionary times :data:`CELLS` plus that with the ordinary one."""

    def __init__(self, toxic: list[str], ordinary: list[str]):
        self.compressors = _compressor(toxic), _compressor(ordinary)
        self.base = [len(c.compress(b"  " + PAD)) for c in self.compressors]
        self.cells: dict[str, int] = {}  # by word as it stands
        self.bare: dict[str, int] = {"": -1}  # by word without punctuation

    def _cell(self, raw: str) -> int:
        word = raw.strip(_EDGES)
        if word in self.bare:
            return self.bare[word]
        window = b" " + word.encode("utf-8", "replace") + b" " + PAD
        x, y = (min(max(len(c.compress(window)) - b, 0), CELLS - 1) for c, b in zip(self.compressors, self.base))
        self.bare[word] = x * CELLS + y
        return self.bare[word]

    def of(self, text: str) -> np.ndarray:
        """The cells of the text's windows, in order."""
        known, raw = self.cells, text.lower().split()
        new = [w for w in set(raw) if w not in known]
        if len(known) + len(new) > KNOWN_WORDS:
            known.clear()
            self.bare = {"": -1}
            new = set(raw)
        for w in new:
            known[w] = self._cell(w)
        found = np.array([known[w] for w in raw], np.int64)
        return found[found >= 0]


@dataclass
class Model:
    toxic: list[str]
    ordinary: list[str]
    weights: np.ndarray  # by cell
    chance: float  # mean weight of a window of ordinary text
    curve: np.ndarray  # of the features and a constant

    def features(self, cells: np.ndarray) -> np.ndarray:
        each = self.weights[cells] - self.chance
        n, above = max(1, len(cells)), float(each.sum())
        worst = float(np.add.reduceat(each, np.arange(0, len(each), PASSAGE)).max()) if len(each) else 0.0
        smooth = float(np.log1p(np.bincount(cells, minlength=len(self.weights))) @ self.weights)
        return np.array([above / n, above / math.sqrt(n), worst, smooth / math.sqrt(n), smooth, math.log(n), 1.0])

    def score(self, cells: np.ndarray) -> float:
        z = float(self.features(cells) @ self.curve)
        return 1.0 / (1.0 + math.exp(-min(max(z, -35.0), 35.0)))


def train_dictionaries(sample: DataFrame, n_toxic: int) -> tuple[list[str], list[str]]:
    """The words of the toxic dictionary (far more frequent in toxic text than
    chance allows) and of the ordinary one, best first.  ``sample`` has toxic
    (0 or 1) and t (text), ``n_toxic`` toxic rows.

    A word counts the smaller of its numbers of distinct predecessors and
    successors, so that copies of one document count once."""
    words_of = _words

    def neighbours(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 50):
                some, seen = frame.iloc[at:at + 50], set()
                for toxic, text in zip(some["toxic"].tolist(), some["t"]):
                    words = words_of(text)
                    seen.update((toxic, w, 0, v) for v, w in zip(["", *words], words))
                    seen.update((toxic, w, 1, v) for w, v in zip(words, [*words[1:], ""]))
                yield pd.DataFrame(list(seen), columns=["toxic", "word", "side", "other"])

    def number(toxic: int):
        return F.least(*[F.sum(((F.col("toxic") == toxic) & (F.col("side") == side)).cast("long")) for side in (0, 1)])

    words = saved(sample.select("toxic", "t").mapInPandas(neighbours, "toxic int, word string, side int, other string")
                  .distinct().groupBy("word").agg(number(1).alias("t"), number(0).alias("o")), "words")
    t, o = F.col("t"), F.col("o")
    sums = words.agg(F.sum("t"), F.sum("o")).first()
    share = (sums[0] or 0) / max(1, (sums[0] or 0) + (sums[1] or 0))
    expected = (t + o) * F.lit(share)
    excess = (t - expected) / F.sqrt(expected + 0.5)
    odd = [r.word for r in words.filter((t >= max(3, 0.004 * n_toxic)) & (excess > 3)
                                        & (t * (1 - share) > (o + 0.5) * (8 * share)))
           .orderBy(excess.desc(), "word").limit(TOXIC_WORDS).collect()]
    usual = [r.word for r in words.filter(o > 0).orderBy(o.desc(), "word").limit(ORDINARY_WORDS + TOXIC_WORDS).collect()]
    return odd, [w for w in usual if w not in set(odd)][:ORDINARY_WORDS]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(sample: DataFrame, n: int, m: int) -> Model:
    """Dictionaries from every other row of either class, thresholds and curve
    from the rest.  ``sample`` has toxic (``n`` rows with 1, ``m`` with 0), k
    (number within the class) and t (text).  Without documents of both classes,
    the score is the share of toxic documents (0 without any)."""
    if n < 2 or m < 2:
        share = (n + 1e-9) / (n + m + 2e-9) if n + m else 0.0
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model([], [], np.zeros(CELLS * CELLS), 0.0, np.array([0, 0, 0, 0, 0, 0, math.log(share / (1 - share))]))
    words = train_dictionaries(sample.filter("k % 2 = 0"), (n + 1) // 2)
    rest = sample.filter("k % 2 = 1")

    def numbers(of) -> tuple[np.ndarray, np.ndarray]:
        """The class of each row of the rest, and what ``of`` makes of its cells, as numbers."""
        def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            windows = Windows(*words)
            for frame in frames:
                frame["x"] = [of(windows.of(t)).astype("<f8").tobytes() for t in frame["t"]]
                yield frame[["toxic", "k", "x"]]

        got = rest.mapInPandas(rows, "toxic int, k int, x binary").toPandas().sort_values(["toxic", "k"])
        return got["toxic"].to_numpy(), np.array([np.frombuffer(x, "<f8") for x in got["x"]])

    toxic, counts = numbers(lambda cells: np.bincount(cells, minlength=CELLS * CELLS))
    smooth = np.log2(1 + counts)  # a document's repetitions of one word weigh less
    t, o = smooth[toxic == 1].sum(0), smooth[toxic == 0].sum(0)
    ratio = np.log((t + 0.5) / (t.sum() + 0.5 * len(t))) - np.log((o + 0.5) / (o.sum() + 0.5 * len(o)))
    ratio *= (t + o) / (t + o + 20)  # cells that few windows fall into say little
    weights, ordinary = np.where(ratio < 0.5, 0.0, ratio), counts[toxic == 0].sum(0)
    model = Model(*words, weights, float(ordinary @ weights / max(1.0, ordinary.sum())), np.zeros(7))
    toxic, x = numbers(model.features)
    model.curve = _logistic(x, toxic.astype(float))
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labelled documents outside the held-out fifth (crc32 of
    the id as text, mod 5, is 0): of either class those with the smallest
    hashed ids, at most :data:`TOXIC_SAMPLE` and :data:`ORDINARY_SAMPLE`, with
    their whole texts, which stay in the tasks; rows repeated with one id and
    text count once."""
    lab = (labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
           .groupBy(F.col("doc_id").cast("long").alias("i")).agg(F.max("toxic").alias("_toxic")))
    text = F.coalesce(docs[text_col], F.lit(""))
    src = docs.select(docs[id_col].cast("long").alias("i"), text.alias("t"), F.xxhash64(text).alias("h"))

    def sample(value: int, most: int) -> list[tuple]:
        ids = lab.filter(F.col("_toxic") == value).orderBy(F.xxhash64("i"), "i").limit(most).select("i")
        rows = (src.select("i", "h").join(F.broadcast(ids), "i")  # at most `most` ids
                .distinct().orderBy(F.xxhash64("i"), "i", "h").limit(most).collect())
        return [(value, k, r.i, r.h) for k, r in enumerate(rows)]

    toxic, ordinary = sample(1, TOXIC_SAMPLE), sample(0, ORDINARY_SAMPLE)
    picked = docs.sparkSession.createDataFrame(toxic + ordinary, "toxic int, k int, i long, h long")
    texts = src.join(F.broadcast(picked), ["i", "h"]).select("toxic", "k", "t").dropDuplicates(["toxic", "k"])
    return fit(saved(texts, "labelled"), len(toxic), len(ordinary))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's doc_id, held_out, score and predicted (1 if score >= 0.5).

    The score sees the whole text and nothing else; a null text scores as an
    empty one.  Rows stay as many as they are; a null id is not held out."""

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows = Windows(model.toxic, model.ordinary)
        for frame in frames:
            frame["score"] = [model.score(windows.of(t)) for t in frame["text"]]
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame[["doc_id", "score"]]

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return src.mapInPandas(scored, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the model does not predict toxic, with all their columns."""
    windows_of, names = model, docs.columns
    schema = docs.schema

    def keep(frames: Iterator) -> Iterator:
        import pyarrow as pa

        windows = Windows(windows_of.toxic, windows_of.ordinary)
        for batch in frames:
            ok = [windows_of.score(windows.of(t.as_py() or "")) < 0.5 for t in batch.column(names.index(text_col))]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(keep, schema)
